"""Tokenizer use on executors: one tokenizer a worker process, with a bounded memo of encoded words."""

from __future__ import annotations

import os
from codecs import charmap_decode
from collections.abc import Iterator
from functools import lru_cache
from struct import Struct, pack

import numpy as np

#: Bytes that a worker's memo takes at most, by estimate; past it the memo is emptied and fills again.
MEMO_BYTES = 64 << 20
#: What an entry of a memo takes besides its key and value: two objects' heads and a place in the table.
ENTRY_BYTES = 170
#: Longer words are encoded but not remembered.
LONGEST_WORD = 256
#: New words that are encoded as one text; it costs a fraction of encoding each alone.
TOGETHER = 256
#: Characters of a text that are split into words at a time.
PIECE = 1 << 20

_SPACE = "\t\n\v\f\r "
_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Byte-level models write bytes that are no visible Latin-1 characters as those from U+0100, in order.
_ABOVE = {b: 256 + n for n, b in enumerate([*range(33), *range(127, 161), 173])}
#: The character of each byte.
_BYTE_LEVEL = "".join(chr(_ABOVE.get(b, b)) for b in range(256))
#: What packs so many ids.
_PACKS = 16
_PACK = [Struct(f"<{n}I").pack for n in range(_PACKS)]
#: Texts that show what a tokenizer does with white space, case and punctuation.
_PROBES = (
    "a bc  de, f-g\n1.2 h", "\t it's ÉO (x) ñandú 7%\r\n", "zz <|y|> !! ?a", "Word, word. WORD... \"Zebra\" zebra' zebras' it's, end;) Unbelievable!? _a a_ a_, internationalisation: qqxjzk'",
    "I'd we'll they're 'tis the's' don't. A B, c's' x'' o'clock'd",
)


def load(path: str, special_as_text: bool = False):
    """The tokenizer of a file. ``special_as_text``: special tokens in texts are text; such an object is apart."""
    return _load(path, special_as_text)


@lru_cache(maxsize=4)
def _load(path: str, special_as_text: bool):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = special_as_text
    return tokenizer


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """``text`` in parts of about ``size`` characters, cut at ASCII white space only."""
    at = 0
    while len(text) - at > size:
        end = at + size
        while end < len(text) and text[end] not in _SPACE:
            end += 1
        yield text[at:end]
        at = end
    yield text[at:] if at else text


class WordEncoder:
    """Ids of whole texts, as little-endian uint32 bytes.

    For a tokenizer that drops white space, no token crosses it: each distinct word goes through
    the tokenizer once and a text's ids are its words' ids in a row. If it also keeps letters and
    punctuation apart and lower-cases, a word's ASCII letters are learned once for all its forms,
    by the model alone. Both are tried out on probes when the file is loaded; texts of any other
    tokenizer are encoded whole. Tests compare with whole-text encoding.
    """

    def __init__(self, path: str, memo_bytes: int = MEMO_BYTES):
        self.tokenizer = load(path)
        self.model = self.tokenizer.model
        self.memo: dict[bytes, bytes] = {}
        self.memo_bytes, self.held = memo_bytes, 0
        self.by_words = all(self._ids(t) == [i for w in t.encode().split() for i in self._ids(w.decode())] for t in _PROBES)
        self.by_letters = self.by_words and all(self._apart(w) for t in _PROBES for w in t.encode().split())

    def _apart(self, word: bytes) -> bool:
        """Whether the parts of a probe have the ids of the whole."""
        core, rest = self._parts(word)
        return core is None or self._ids(word.decode()) == [k.id for k in self.model.tokenize(charmap_decode(core, "strict", _BYTE_LEVEL)[0])] + self._ids(rest.decode())

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if not self.by_words:
            return [np.array(self._ids(t or ""), "<u4").tobytes() for t in texts]
        return [b"".join(map(self._piece, pieces(t))) if t and len(t) > PIECE else self._piece(t or "") for t in texts]

    def _piece(self, text: str) -> bytes:
        words, memo = text.encode().split(), self.memo
        distinct = set(words)
        missing = distinct.difference(memo)
        if missing and self.held > self.memo_bytes:
            memo.clear()
            self.held, missing = 0, distinct
        long = {w for w in missing if len(w) > LONGEST_WORD}
        self._learn(missing - long if long else missing)
        if not long:
            return b"".join(map(memo.__getitem__, words))
        return b"".join(np.array(self._ids(w.decode()), "<u4").tobytes() if w in long else memo[w] for w in words)

    def _learn(self, missing: set[bytes]) -> None:
        """Put the ids of ``missing`` in the memo. Most words of a corpus are rare, so this is what encoding costs."""
        if not self.by_letters:
            self._learn_whole(list(missing))
            return
        memo, wide, tokenize, held, whole, split = self.memo, self._wide, self.model.tokenize, 0, [], []
        for w in missing:
            letters = w.rstrip(_PUNCTUATION)
            core = letters.lower() if letters.isalpha() else wide(letters)  # of ASCII
            if core is None:
                whole.append(w)
                continue
            if core in memo:
                ids = memo[core]
            else:
                found = [k.id for k in tokenize(charmap_decode(core, "strict", _BYTE_LEVEL)[0])]
                n = len(found)
                memo[core] = ids = _PACK[n](*found) if n < _PACKS else pack(f"<{n}I", *found)
                held += len(core) + 4 * n + ENTRY_BYTES
            if letters != w:
                split.append((w, ids, w[len(letters) :]))
            elif core != w:
                memo[w] = ids
                held += len(w) + len(ids) + ENTRY_BYTES
        self._learn_whole([*whole, *{rest for _, _, rest in split if rest not in memo}])
        for w, ids, rest in split:
            memo[w] = ids = ids + memo[rest]
            held += len(w) + len(ids) + ENTRY_BYTES
        self.held += held

    def _learn_whole(self, whole: list[bytes]) -> None:
        """Put the ids of ``whole`` in the memo, by the whole tokenizer."""
        for at in range(0, len(whole), TOGETHER):
            part = [w.decode() for w in whole[at : at + TOGETHER]]
            found = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            ids = np.array(found.ids, "<u4")
            starts = np.fromiter((a for a, _ in found.offsets), np.int64, len(ids))
            cuts, data = (4 * np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in part)]))).tolist(), ids.tobytes()
            for w, a, b in zip(whole[at : at + TOGETHER], cuts[:-1], cuts[1:], strict=True):
                self.memo[w] = data[a:b]
                self.held += len(w) + b - a + ENTRY_BYTES

    @staticmethod
    def _wide(letters: bytes) -> bytes | None:
        """Letters before U+0250, not all of ASCII, as lower-case; None for others."""
        text = letters.decode()
        if not text.isalpha() or max(text) >= "\u0250" or "\u0130" in text:
            return None
        return text.lower().encode()

    def _parts(self, word: bytes) -> tuple[bytes | None, bytes]:
        """A word of letters before U+0250 as these, lower-case, and the ASCII punctuation that ends it; (None, b"") for another."""
        letters = word.rstrip(_PUNCTUATION)
        core = letters.lower() if letters.isalpha() else self._wide(letters)
        return (None, b"") if core is None else (core, word[len(letters) :])


@lru_cache(maxsize=1)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)
