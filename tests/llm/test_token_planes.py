import random
import sys
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import token_planes as T
from quern.llm.storage import new_path
from quern.llm.tokenize import WordEncoder, load

PATH = public_tokenizers.path("word_bpe_49k.json")
DATA = "/root/testdata/sf0.001"


def plain_ids(text):
    return load(PATH).encode(text or "", add_special_tokens=False).ids


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_word_memo_is_whole_text_encoding(text):
    encoder = WordEncoder(PATH, memo_bytes=5000)
    for t in (text, text + " it's <|endoftext|>x İΣς é ́a b　c"):
        try:
            t.encode()
        except UnicodeEncodeError:
            continue
        assert np.frombuffer(encoder.encode([t])[0], "<u4").tolist() == plain_ids(t)


@given(st.lists(st.integers(0, (1 << 32) - 1), min_size=1, max_size=100), st.booleans())
def test_planes_round_trip(ids, bits):
    ids = np.array(ids, "<u4")
    planes = T.to_planes(ids, bits)
    assert len(planes) == (32 if bits else 4) and (T.from_planes(planes, len(ids)) == ids).all()


def test_shifted_crc():
    a, b = random.Random(1).randbytes(1001), random.Random(2).randbytes(70_003)
    assert T.shift_crc(zlib.crc32(a), len(b)) ^ zlib.crc32(b) == zlib.crc32(a + b)


@pytest.mark.parametrize(("bits", "block"), [(False, T.BLOCK_IDS), (True, 97), (False, 1)])
def test_files_hold_every_id(spark, bits, block):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    if block == 1:
        docs = docs.filter("doc_id < 12").selectExpr("doc_id", "left(text, 90) AS text")
    docs = docs.union(spark.createDataFrame([(-5, None), (-4, ""), (-3, " \n "), (-2, "same"), (-2, "same"), (None, "no id"), (-1, "long " * 9000 * (block > 1))], "doc_id long, text string"))
    path = new_path(spark, "t")
    T.write_tokens(docs.withColumn("planes", docs.text), path, PATH, bits=bits, block_ids=block)
    got = sorted(((r.start, r.n_tokens, r.ids_crc32, r.doc_id) for r in T.read_documents(spark, path).collect()))
    at, want, stream = 0, [], []
    for r in sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0)):
        ids = [*plain_ids(r.text), 1]
        want.append((at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), r.doc_id))
        at, stream = at + len(ids), stream + ids
    assert got == want
    blocks = sorted((r.shard, r.first, r.ids) for r in T.read_ids(spark, path).collect())
    assert [i for b in blocks for i in b[2]] == stream


def test_empty_table(spark):
    path = new_path(spark, "t")
    T.write_tokens(spark.createDataFrame([], "doc_id long, text string"), path, PATH)
    assert T.read_documents(spark, path).count() == 0


def test_words_of_every_form_and_long_texts():
    encoder = WordEncoder(PATH, memo_bytes=20_000)
    assert encoder.by_words and encoder.by_letters
    odd = ["Ñandú, ñandú! ÉO... éO's it'S IT'S don't' 'tis x<|endoftext|> Word <|endoftext|>, ª º ß ẞ ŉ ﬁ", "x" * 3000 + " y", ("wörd, " * 300_000) + "end", "a\x85b c\xa0d \x1c e"]
    for t in odd:
        assert np.frombuffer(encoder.encode([t])[0], "<u4").tolist() == plain_ids(t)


def test_other_tokenizers_are_encoded_whole():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder, text = WordEncoder(path), "it keeps  white space\n\tas it is"
    assert not encoder.by_words
    assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_new_words_take_few_calls():
    """Most words of a corpus are rare: learning one, in two forms, takes few calls, and gives the ids of the whole text."""
    rng, encoder, calls = random.Random(3), WordEncoder(PATH), [0]
    words = ["".join(rng.choices("abcdefghiklmnoprstuéñ", k=9)) for _ in range(3000)]
    text = " ".join(f"{w} {w.title()}" for w in words) + " " + ", ".join(words[:50]) + " " + "longer" * 20

    def count(frame, event, arg):
        calls[0] += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        found = encoder.encode([text])[0]
    finally:
        sys.setprofile(None)
    assert np.frombuffer(found, "<u4").tolist() == plain_ids(text)
    assert calls[0] < 24 * len(words), calls[0] / len(words)
