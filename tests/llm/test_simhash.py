import numpy as np
import pytest
from xxhash import xxh64_intdigest

from quern.llm import simhash as S

DATA = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ")
    for c in "\n\r\x0b\x0c":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, budget=2):
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if (fps[i] ^ fps[j]).bit_count() <= budget:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def test_fingerprint_matches_plain_form():
    for t in (None, "", " \n\t", "A", "A b", "the cat sat", "Ünï Cödé ABC x\x0by\x1fz " * 9, "w " * 40_000):
        assert S.fingerprint(t) == plain_fingerprint(t)


@pytest.mark.parametrize("hot", [S.HOT, 40])
def test_trie_join_finds_every_link(spark, hot):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    fps = set(map(int, base)) | {0, (1 << 64) - 1}
    for f in map(int, base):
        for _ in range(8):
            g = f
            for b in rng.choice(64, rng.integers(1, 5), replace=False):
                g ^= 1 << int(b)
            fps.add(g)
    crowd = int(base[0])
    for _ in range(150):  # many distinct fingerprints share a block's bits
        fps.add(crowd ^ int(rng.integers(0, 1 << 20)))
    signed = {f - (1 << 64) if f >= 1 << 63 else f: f for f in fps}
    got = S.components(S.links(spark.createDataFrame([(s,) for s in signed], "fp long"), hot=hot))
    roots = {r.node: r.root for r in got.collect()}
    want = plain_components({s: f for s, f in signed.items()})
    assert {s: roots.get(s, s) for s in signed} == want


def test_near_duplicates_match_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    odd = [(-1, None), (-2, ""), (-3, " \n"), (-4, "two words"), (-5, "two words"), (-6, "TWO words"), (-6, "TWO words"), (None, "two words"), (-9, "long " * 50_000)]
    docs = docs.union(spark.createDataFrame(odd, "doc_id long, text string"))
    rows = S.near_duplicates(docs.withColumn("fp", docs.doc_id).withColumn("component_id", docs.doc_id)).collect()
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}
    fps = {k: plain_fingerprint(t) for k, t in texts.items()}
    want = plain_components(fps)
    assert len(rows) == docs.count()
    for r in rows:
        if r.doc_id is not None:
            assert (r.fp % (1 << 64), r.component_id) == (fps[r.doc_id], want[r.doc_id])
    assert [r.component_id for r in rows if r.doc_id is None] == [-6]
    kept = [r.doc_id for r in S.keep_one(docs).collect()]
    assert sorted(kept) == sorted(set(want.values()))


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert S.near_duplicates(empty).count() == 0 and S.keep_one(empty).count() == 0
