import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quern.llm import attribution as A

PATH = public_tokenizers.path("byte_bpe_50k.json")
WHOLE = Tokenizer.from_file(PATH)
WHOLE.encode_special_tokens = True


def plain(text, spans, rule):
    out, gap = [0] * len(spans), 0
    for a, b in WHOLE.encode(text or "", add_special_tokens=False).offsets:
        chars = list(range(a, max(b, a + 1)))
        owner = [next((k for k, (x, y) in enumerate(spans) if x <= c < y), -1) for c in chars]
        if rule == "first":
            k = owner[0]
        elif rule == "last":
            k = owner[-1]
        else:
            k = max(sorted(set(owner) - {-1}), key=owner.count, default=-1)
        if k < 0:
            gap += 1
        else:
            out[k] += 1
    return out, gap


@given(st.text(alphabet="ab' \n\t.é😀１s<|endoftext|>　", max_size=40))
@settings(max_examples=400, deadline=None)
def test_pieces_give_whole_text_spans(text):
    got = A.PieceSpans(PATH, memo_bytes=2000).spans(text)
    assert list(map(tuple, got.tolist())) == WHOLE.encode(text, add_special_tokens=False).offsets


@pytest.mark.parametrize("rule", A.RULES)
def test_lines_and_sections(spark, rule):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").filter("doc_id < 40")
    odd = [(-1, None), (-2, ""), (-3, "\n"), (-4, "\n\n\n a\n\n  b"), (-5, "word " * 30_000), (-5, "x"), (None, "no id")]
    docs = docs.union(spark.createDataFrame(odd, "doc_id long, text string"))
    got = sorted((r.doc_id or 0, r.section, r.start, r.end, r.n_tokens) for r in A.count_lines(docs, PATH, rule).collect())
    want = []
    for d, text in docs.collect():
        if text != odd[4][1]:
            spans = list(zip(*(x.tolist() for x in A.line_spans(text)), strict=True))
            assert "".join(text[a:b] for a, b in spans) == text if text else not spans
            want += [(d or 0, k, a, b, n) for k, ((a, b), n) in enumerate(zip(spans, plain(text, spans, rule)[0], strict=True))]
    assert [g for g in got if g[4] < 20_000 or g[0] != -5] == sorted(want)
    given = [(1, "one two  three, four", [(0, 2), (2, 2), (2, 9), (12, 20)]), (2, None, [(0, 0)]), (3, "all gap", []), (4, "nothing", None)]
    frame = spark.createDataFrame(given, "doc_id long, text string, sections array<struct<start:long,end:long>>")
    rows = [(r.doc_id, r.section, r.n_tokens) for r in A.attribute(frame, PATH, rule=rule).collect()]
    want = []
    for d, text, spans in given:
        n, gap = plain(text, spans or [], rule)
        want += [(d, k, x) for k, x in enumerate(n)] + ([(d, -1, gap)] if gap else [])
    assert sorted(rows) == sorted(want)


def test_bad_sections_and_empty_table(spark):
    bad = spark.createDataFrame([(1, "abc", [(0, 2), (1, 3)])], "doc_id long, text string, sections array<struct<start:long,end:long>>")
    with pytest.raises(Exception, match="overlap"):
        A.attribute(bad, PATH).collect()
    assert A.count_lines(bad.limit(0), PATH).count() == 0
