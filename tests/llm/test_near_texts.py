import random

import pytest

from quern.llm import near_texts as N

DATA = "/root/testdata/sf0.01"


def plain_components(rows, width=5, similarity=0.8):
    """Component's smallest id of each id, by comparing all pairs of shingle sets."""

    def of(text):
        w = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
        return tuple(w), frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()

    texts = [(d, *of(t)) for d, t in rows]
    root = {d: d for d, *_ in texts}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    where = {}
    for k, (_, _, s) in enumerate(texts):
        for x in s:
            where.setdefault(x, []).append(k)
    pairs = {(a, b) for ks in where.values() for n, a in enumerate(ks) for b in ks[n + 1 :]}
    pairs |= {(a, b) for a, x in enumerate(texts) if not x[2] for b, y in enumerate(texts) if a < b and not y[2]}
    for a, b in pairs:
        (d, w, s), (e, v, t) = texts[a], texts[b]
        if w == v or len(s & t) >= similarity * len(s | t):
            x, y = sorted((find(d), find(e)))
            root[y] = x
    return {d: find(d) for d, *_ in texts}


def edited(rng, words, share):
    return [rng.choice(words) + "x" if rng.random() < share else w for w in words]


@pytest.fixture(scope="module")
def crowd():
    """Near copies of one base, of which few are near each other, others' families, short and odd texts."""
    rng = random.Random(3)
    new = lambda n: ["".join(rng.choices("abcdefghij", k=5)) for _ in range(n)]
    base, rows = new(200), []
    texts = [" ".join(edited(rng, base, 0.018)) for _ in range(120)]
    texts += [" ".join(edited(rng, f, 0.02)) for f in [new(80) for _ in range(15)] for _ in range(5)]
    texts += [" ".join(new(60) + base[:50]) for _ in range(30)] + ["a b", "A  b", "a b c", "one", "", " ", None, "x " * 4000, "X " * 4001]
    rng.shuffle(texts)
    for d, t in enumerate(texts):
        rows.append((d, t))
    return rows


def got(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: r.component_id for r in N.near_texts(docs, **options).collect()}


def test_components_match_all_pairs(spark, crowd):
    want = plain_components(crowd)
    assert got(spark, crowd) == want
    assert len(set(want.values())) < 0.7 * len(want)


def test_large_components_and_hot_keys(spark, crowd):
    assert got(spark, crowd, part=25, hot=40) == plain_components(crowd)


def test_corpus_matches_all_pairs(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    assert got(spark, rows) == plain_components(rows)


def test_keep_one(spark):
    long = " ".join(f"w{k}" for k in range(100))
    rows = [(7, long), (3, long + " more"), (3, long + " more"), (None, long), (3, "another text of this id"), (9, "Another TEXT of this id"), (5, None), (6, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'mine' AS class", "1 AS fp", "2 AS __id2")
    left = N.keep_one(docs)
    assert left.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted([(3, long + " more"), (3, "another text of this id"), (5, None)], key=str)
    assert N.keep_one(docs.limit(0)).count() == 0
