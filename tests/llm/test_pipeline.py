import zlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline as P
from quern.llm import langid, mixing
from tests.llm.test_decontaminate import plain_leaks
from tests.llm.test_near_texts import plain_components
from tests.llm.test_token_planes import plain_ids

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), []
    for _, stage in P.STAGES:
        out.append(docs)
        docs = P.written(stage(spark, docs, DATA), "test-stage")
    return [*out, docs]


def test_columns_stay(stages):
    for docs in stages[1:-1]:
        assert docs.columns == stages[0].columns


def test_language(stages):
    model = langid.fit(stages[0].filter(~langid.held_out()))
    want = sorted(r.doc_id for r in stages[0].collect() if not model.predict(r.text)[2])
    assert sorted(r.doc_id for r in stages[1].collect()) == want and len(want) >= 0.99 * stages[0].count()


def test_near_duplicates(stages):
    roots = plain_components([(r.doc_id, r.text) for r in stages[1].collect()])
    assert sorted(r.doc_id for r in stages[2].collect()) == sorted(set(roots.values())) and len(set(roots.values())) < len(roots)


def test_decontamination(spark, stages):
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    rows = [(r.doc_id, r.text) for r in stages[2].collect()]
    leaked = {d for d, *_ in plain_leaks(rows, items)}
    assert leaked and sorted(r.doc_id for r in stages[3].collect()) == sorted(d for d, _ in rows if d not in leaked)


def test_mixture(stages):
    documents = stages[3].toPandas()  # noqa: F841 read by DuckDB
    want, texts = {}, dict(zip(documents.doc_id, documents.text, strict=True))
    for d, size, _, _, taken in duckdb.sql(mixing.ORACLE_SQL).fetchall():
        want[d] = (taken, size)
    got = {}
    for r in stages[4].collect():
        assert texts[r.doc_id].startswith(r.text)
        got[r.doc_id] = got.get(r.doc_id, 0) + len(r.text.split())
    assert got == {d: t for d, (t, _) in want.items() if t}


def test_tokens(stages):
    rows = sorted((r.doc_id, len(plain_ids(r.text)) + 1, zlib.crc32(np.array([*plain_ids(r.text), 1], "<u4").tobytes())) for r in stages[4].collect())
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in stages[5].collect()) == rows
    starts = sorted((r.start, r.n_tokens) for r in stages[5].collect())
    assert [s for s, _ in starts] == np.cumsum([0, *(n for _, n in starts[:-1])]).tolist()


def test_odd_rows(spark):
    """Nulls, empty texts, repeated rows, clashing names and an empty table go through every stage."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(40)
    names = "doc_id long, text string, lang string, source string, n_chars long"
    odd = spark.createDataFrame([(None, None, None, None, None), (-1, "", "en", None, 0), (-1, "", "en", None, 0), (None, "the of and that with " * 20, None, None, 1), (-2, "the of and that with " * 20, "en", "s", 1)], names)
    rows = docs.select(*(f.split()[0] for f in names.split(", "))).union(odd).selectExpr("*", "'mine' AS __found", "1 AS score", "2 AS __words")
    for table in (rows, rows.limit(0)):
        now = P.written(table, "test-odd")
        for name, stage in P.STAGES:
            now = P.written(stage(spark, now, DATA), "test-odd")
            if name != "tokens" and table is rows:
                assert now.columns == rows.columns and {tuple(r) for r in now.select("__found", "score", "__words").collect()} == {("mine", 1, 2)}
        assert (now.count() > 30) == (table is rows)
