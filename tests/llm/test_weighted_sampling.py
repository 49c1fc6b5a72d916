import hashlib
import math
import re
import struct
from collections import Counter

import pytest
import xxhash

from quern.llm import weighted_sampling as W

TEXTS = {50: "a b c d e f g h " * 9, 49: "a b c d e f g x " * 9, 40: None, 39: "", 30: " \n\t ", 20: "Ünï cödé 😀 " * 5, 10: "only", 9: "a b c d e f g h " * 9, 5: "w%d " * 3}


def jaccard(a, b):
    a, b = Counter((a or "").split()), Counter((b or "").split())
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def test_edits_and_neighbours(spark):
    rows = [(k, t, 1) for k, t in TEXTS.items()] + [(10, "only", 1), (10, "other", 1), (None, "last", 1)]
    got = W.compare_with_edits(spark.createDataFrame(rows, "doc_id long, text string, key int")).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.n_chars): r for r in got}
    ids = [50, 49, 40, 39, 30, 20]
    for a, b in zip(ids, ids[1:]):
        t, nxt = TEXTS[a] or "", TEXTS[b] or ""
        k = len(t) // 3
        edited = t[: len(t) - k] + nxt[:k]
        r = by[(a, len(t))]
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(r.near_next - jaccard(t, nxt)) < 0.35 or not (t.split() or nxt.split())
    assert by[(50, len(TEXTS[50]))].fingerprint == by[(9, len(TEXTS[9]))].fingerprint
    assert by[(40, 0)].fingerprint == by[(30, 4)].fingerprint == W.EMPTY * W.SAMPLES and by[(40, 0)].near_next == 1.0
    last = by[(None, 4)]
    assert last.edited_sha256 == hashlib.sha256(("las" + TEXTS[50][:1]).encode()).hexdigest()


def test_collisions_estimate_generalised_jaccard(spark):
    pairs = [(k, " ".join([f"a{k}"] * k + [f"b{k}"] * 3 + [f"p{k}-{i}" for i in range(k)]), " ".join([f"a{k}"] * 4 + [f"b{k}"] * k + [f"p{k}-{i + k // 2}" for i in range(k)])) for k in range(1, 61)]
    prints = W.fingerprints(spark.createDataFrame(pairs, "k int, x string, y string"), ["k"], ["x", "y"])
    got = {r.k: r.near for r in prints.select("k", W.likeness(prints.x_fp, prints.y_fp).alias("near")).collect()}
    errors = [got[k] - jaccard(x, y) for k, x, y in pairs]
    assert abs(sum(errors) / len(errors)) < 0.03 and max(map(abs, errors)) < 0.4


def test_only_and_no_document(spark):
    one = W.compare_with_edits(spark.createDataFrame([(1, "abc def")], "doc_id long, text string")).first()
    assert one.edited_sha256 == hashlib.sha256(b"abc dab").hexdigest() and one.near_next == pytest.approx(1.0)
    assert W.compare_with_edits(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def chained(*parts: bytes) -> int:
    """Spark's xxhash64 of several values: each one's hash is the next one's seed."""
    h = 42
    for p in parts:
        h = xxhash.xxh64_intdigest(p, h)
    return h


def plain_fingerprint(text, samples=W.SAMPLES):
    """Consistent weighted sampling, a term and a position at a time, with the operator's hashes."""
    counts, out = Counter(re.findall(r"[^\x20\x09-\x0D]+", text or "")), []
    for p in range(samples):
        found = []
        for word, weight in counts.items():
            term = struct.pack("<Q", chained(word.encode()))
            draws = [chained(term, struct.pack("<i", 2 * p + k)) for k in (0, 1)]
            u = [((draws[d] >> 21 * k & (1 << 21) - 1) + 0.5) / (1 << 21) for d, k in ((0, 0), (0, 1), (0, 2), (1, 0), (1, 1))]
            r, c, b = -math.log(u[0] * u[1]), -math.log(u[2] * u[3]), u[4]
            t = math.floor(math.log(weight) / r + b)
            y = math.exp(r * (t - b))
            found.append((c / (y * math.exp(r)), word, chained(term, struct.pack("<q", t), struct.pack("<i", p)) % (1 << 24)))
        out.append(f"{min(found)[2]:06x}" if found else W.EMPTY)
    return "".join(out)


def test_fingerprints_are_those_of_a_plain_sampler(spark):
    texts = [*TEXTS.values(), "x", "x x x", " ".join(f"w{i % 17} v{i % 5} u{i}" for i in range(400)), "é " * 1000 + "e"]
    prints = W.fingerprints(spark.createDataFrame(list(enumerate(texts)), "k int, x string"), ["k"], ["x"])
    got = {r.k: r.x_fp for r in prints.collect()}
    assert [got[k] for k in range(len(texts))] == [plain_fingerprint(t) for t in texts]
