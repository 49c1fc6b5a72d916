"""Token counts by offset-mapped attribution.

A document is encoded whole, once. Token character spans are interval-joined with the spans of the
document's sections: both are sorted, so a section's tokens are a run found by binary search of
its boundaries. A token that crosses a boundary goes to one section by an explicit rule:

``first``    the section of its first character (the default)
``last``     the section of its last character
``most``     the section with most of its characters, the earlier one if they tie

Each token is counted in exactly one section, or in the gap (section -1) if its rule's character
is in none, so a document's counts add up to its tokens.

Byte-level tokenizers never join what stands on two sides of a white-space boundary other than one
space before a word, so a text is encoded as its pieces (a word with the space before it, a run of
white space) and each distinct piece goes through the tokenizer once a worker; tests compare with
whole-text encoding. Texts stay where they are; no row is shuffled.

Defined cases: null and empty texts have no section of lines and give no row from
:func:`count_lines`; from :func:`attribute` they have their given sections with 0 tokens; empty
sections have 0 tokens; overlapping or unordered sections raise an error; repeated rows give
repeated rows; a very long text is encoded whole, its long pieces are not remembered; ties of the rule
``most`` go to the earlier section; an empty table gives no row. Columns other than those named are
not read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokenize import ENTRY_BYTES, TOGETHER, load

#: Bytes that a worker's memo takes at most, by estimate; past it the memo is emptied and fills again.
MEMO_BYTES = 96 << 20
#: Longer pieces are encoded but not remembered.
LONGEST_PIECE = 256

RULES = ("first", "last", "most")
SCHEMA = "doc_id long, section int, start long, end long, n_tokens long"

#: A word with at most one space before it, a run of white space before such a word, or white space.
_piece = regex.compile(r" ?\S+|\s+(?!\S)|\s+")


class PieceSpans:
    """Character spans of the tokens of whole texts, for a byte-level tokenizer."""

    def __init__(self, path: str, memo_bytes: int = MEMO_BYTES):
        self.tokenizer = load(path, special_as_text=True)
        self.memo: dict[str, bytes] = {}
        self.memo_bytes, self.held = memo_bytes, 0

    def spans(self, text: str) -> np.ndarray:
        """Rows (start, end) of the text's tokens, in order."""
        pieces, memo, own = _piece.findall(text), self.memo, {}
        distinct = set(pieces)
        missing = distinct.difference(memo)
        if missing and self.held > self.memo_bytes:
            memo.clear()
            self.held, missing = 0, distinct
        missing = list(missing)
        for at in range(0, len(missing), TOGETHER):
            part = missing[at : at + TOGETHER]
            for p, e in zip(part, self.tokenizer.encode_batch(part, add_special_tokens=False), strict=True):
                spans = np.array(e.offsets, "<u2" if len(p) < 65_536 else "<i8").astype("<i8").tobytes()
                if len(p) > LONGEST_PIECE:
                    own[p] = spans
                else:
                    memo[p] = spans
                    self.held += len(p) + len(spans) + ENTRY_BYTES
        found = [own[p] if p in own else memo[p] for p in pieces] if own else [memo[p] for p in pieces]
        spans = np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)
        begins = np.cumsum([0, *map(len, pieces[:-1])]) if pieces else np.empty(0, int)
        return spans + np.repeat(begins, [len(f) // 16 for f in found])[:, None]


@lru_cache(maxsize=1)
def piece_spans(path: str) -> PieceSpans:
    return PieceSpans(path)


def owners(spans: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: str) -> np.ndarray:
    """The section of each token span, -1 for none; sections are sorted and apart."""

    def at(chars: np.ndarray) -> np.ndarray:
        k = np.searchsorted(starts, chars, side="right") - 1
        # empty sections hold no character: the last one that starts here is the one that may
        inside = (k >= 0) & (chars < ends[np.maximum(k, 0)]) if len(starts) else np.zeros(len(chars), bool)
        return np.where(inside, k, -1)

    first, last = at(spans[:, 0]), at(np.maximum(spans[:, 0], spans[:, 1] - 1))
    if rule != "most":
        return first if rule == "first" else last
    out = first.copy()
    for i in np.flatnonzero(first != last):
        a, b = spans[i]
        lo, hi = max(0, bisect_left(ends, a)), bisect_left(starts, b)
        share = [(min(b, ends[k]) - max(a, starts[k]), -k) for k in range(lo, hi)]
        best = max(share, default=(0, 0))
        out[i] = -best[1] if best[0] > 0 else -1
    return out


def _counted(doc_id, text: str | None, starts: np.ndarray, ends: np.ndarray, encoder: PieceSpans, rule: str) -> tuple[np.ndarray, int]:
    if len(starts) and ((ends < starts).any() or (starts[1:] < ends[:-1]).any()):
        raise ValueError(f"sections of document {doc_id} overlap or are not in order")
    own = owners(encoder.spans(text or ""), starts, ends, rule)
    return np.bincount(own[own >= 0], minlength=len(starts)), int((own < 0).sum())


def _rows(doc_ids: list, sections: list[np.ndarray], found: list[tuple[np.ndarray, int]], spans: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    n = [len(s) for s in sections]
    flat = lambda parts: np.concatenate(parts).astype(np.int64) if parts else np.empty(0, np.int64)
    keys = [d for d, k in zip(doc_ids, n, strict=True) for _ in range(k)]
    return pa.RecordBatch.from_arrays(
        [pa.array(keys, pa.int64()), pa.array(flat(sections).astype(np.int32)), pa.array(flat([a for a, _ in spans])), pa.array(flat([b for _, b in spans])), pa.array(flat([f for f, _ in found]))],
        ["doc_id", "section", "start", "end", "n_tokens"],
    )


def _with_gap(starts: np.ndarray, ends: np.ndarray, found: tuple[np.ndarray, int], text: str | None) -> tuple[np.ndarray, tuple, tuple]:
    section, (n, gap) = np.arange(len(starts)), found
    if gap:
        section, n = np.append(section, -1), np.append(n, gap)
        starts, ends = np.append(starts, 0), np.append(ends, len(text or ""))
    return section, (n, 0), (starts, ends)


def line_spans(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the text's lines; a line feed belongs to the line that it ends."""
    if not text:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    lengths = [len(x) + 1 for x in text.split("\n")]
    lengths[-1] -= 1
    ends = np.cumsum(lengths if lengths[-1] else lengths[:-1])
    return np.concatenate([[0], ends[:-1]]), ends


def count_lines(docs: DataFrame, tokenizer: str, rule: str = "first", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``SCHEMA``: the tokens of every line of every document."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = piece_spans(tokenizer)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                ids, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
                spans = [line_spans(t) for t in texts]
                found = [_counted(d, t, a, b, encoder, rule) for d, t, (a, b) in zip(ids, texts, spans, strict=True)]
                yield _rows(ids, [np.arange(len(a)) for a, _ in spans], found, spans)

    assert rule in RULES
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(count, SCHEMA)


def attribute(docs: DataFrame, tokenizer: str, sections: str = "sections", rule: str = "first", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``SCHEMA`` for given spans: ``sections`` is an array of struct(start, end) in characters.

    Tokens in no section are a row of section -1.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = piece_spans(tokenizer)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                ids, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
                given = [(np.array([x["start"] for x in s or ()], np.int64), np.array([x["end"] for x in s or ()], np.int64)) for s in part.column(2).to_pylist()]
                rows = [_with_gap(a, b, _counted(d, t, a, b, encoder, rule), t) for d, t, (a, b) in zip(ids, texts, given, strict=True)]
                yield _rows(ids, [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows])

    assert rule in RULES
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.col(sections).alias("sections")).mapInArrow(count, SCHEMA)
