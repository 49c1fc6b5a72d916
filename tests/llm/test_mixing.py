import random

import pytest

from quern.llm import mixing as M


def water_fill(sizes, weights, epochs=3):
    """Share, stop at the cap, reshare, until none is above."""
    total, capped = sum(sizes.values()), {}
    while True:
        free = {s: w for s, w in weights.items() if s not in capped}
        left = total - sum(capped.values())
        share = {s: left * w / sum(free.values()) for s, w in free.items()} if free else {}
        over = [s for s in share if share[s] > epochs * sizes[s] + 1e-9]
        if not over:
            return capped | share
        capped |= {s: float(epochs * sizes[s]) for s in over}


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, text string")


@pytest.mark.parametrize("seed", range(3))
def test_targets_are_water_filled(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{k}": rng.choice([0, 1, 5, 50, 3000]) for k in range(9)} | {None: 40}
    order = [*sorted(k for k in sizes if k), None]
    want = water_fill(sizes, {s: k % 3 + 1 for k, s in enumerate(order)})
    got = M.targets(spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long")).collect()
    assert {r.source: pytest.approx(r.target) for r in got} == {s: pytest.approx(x) for s, x in want.items()}


def test_mix_meets_budgets(spark):
    rng = random.Random(4)
    rows = [(k, rng.choice(["hot", "hot", "hot", "b", "ä", None]), " ".join(["w"] * rng.randrange(0, 30))) for k in range(3000)]
    rows += [(5000, "z", None), (5001, "z", ""), (5002, "z", " \t\n"), (5003, "rare", "one"), (None, "b", "no id"), (7, rows[7][1], rows[7][2])]
    got = [M.mix(M.sized(frame(spark, rows).selectExpr("*", "1 AS size", "2 AS target")), range_rows=n).collect() for n in (50, 100_000)]
    assert sorted(map(str, got[0])) == sorted(map(str, got[1])) and len(got[0]) == len(rows)
    by = {}
    for r in got[0]:
        assert 0 <= r.taken <= 3 * r.size
        by.setdefault((r.source, r.source_size, r.target), []).append(r.taken)
    for (_, _, target), taken in by.items():
        assert sum(taken) == int(target + 0.5)


def test_mixed_rows_hold_the_words_taken(spark):
    rows = [(k, "ab"[k % 5 == 0], f" w{k}  x\ty\nz " * (k % 7)) for k in range(60)]
    docs = frame(spark, rows)
    taken = {r.doc_id: r.taken for r in M.mix(M.sized(docs)).collect() if r.taken}
    out = M.mixed(docs)
    assert out.columns == docs.columns
    words = {}
    for r in out.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
        assert dict((a, c) for a, _, c in rows)[r.doc_id].startswith(r.text)
    assert words == taken


def test_empty_table(spark):
    assert M.mix(M.sized(frame(spark, []))).count() == 0 and M.mixed(frame(spark, [])).count() == 0
