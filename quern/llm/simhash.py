"""SimHash near-duplicates by a self-join of binary tries.

Fingerprints are joined as paths of a binary trie: node pairs are traversed together, the bits in
which they differ are counted on the way down, and a pair is dropped when the count passes the
error budget. The work is dealt out by the pigeonhole principle: of ``budget + 1`` blocks of bits,
two linked fingerprints agree in one at least. There is a trie for each block, with that block's
bits first; its traversal starts below them, where nodes pair only with themselves. Rows are dealt
by (block, its bits), so no trie is whole in one task. Where very many distinct fingerprints share
a block's bits, the next bits deal them out again, to one task for each pair of subtries whose
prefixes are within the budget. Nothing is capped: each link is found in some task.

A task returns a spanning forest of its links, not the links, so a dense group costs no more rows
than it has members. Components then come from :func:`components`.

Defined cases: null and empty texts and texts of white space have fingerprint 0 and are linked
like any other; texts of fewer words than a shingle use their whole word sequence; repeated rows
have equal fingerprints and one component; a null doc_id is kept and never chosen as the
component's id unless no other is there; an empty table gives no row; columns other than the two
named are not read, so names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .storage import written

BITS = 64
#: Distinct fingerprints with the same block bits that one task takes; more are dealt out again.
HOT = 200_000
#: Bits by which they are dealt out again.
DEAL_BITS = 8
#: Node pairs that are expanded together; bounds memory, not results.
FRONTIER = 1 << 19
#: Shingles whose bits are counted together.
HASHES = 1 << 14

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """SimHash of XXH64 word shingles: a bit is set if over half the shingles' hashes have it."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    counts, at = np.zeros(BITS, np.int64), 0
    while at < n:
        part = words[at : at + HASHES + width - 1]
        shingles = map(b" ".join, zip(*(part[k:] for k in range(width)))) if len(words) >= width else [b" ".join(words)]
        hashes = np.array([xxh64_intdigest(s, seed) for s in shingles], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        at += HASHES
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): fp holds the 64 bits as a signed long."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), width, seed) for t in batch.column(1)], "<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["doc_id", "fp"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(hashed, "doc_id long, fp long")


def rotated(keys: np.ndarray, by: int) -> np.ndarray:
    return keys if by == 0 else keys << np.uint64(by) | keys >> np.uint64(BITS - by)


def trie_links(keys: np.ndarray, pairs: tuple[np.ndarray, ...], depth: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of ``keys`` (sorted, distinct) within ``budget`` differing bits.

    A trie node is a range of the sorted keys. ``pairs``: start and end of the first and of the
    second node of each pair, and the bits differing so far, all at ``depth``.
    """
    waiting = [(depth, pairs)]
    while waiting:
        d, (a0, a1, b0, b1, e) = waiting.pop()
        if len(a0) > FRONTIER:
            half = len(a0) // 2
            waiting += [(d, tuple(x[:half] for x in (a0, a1, b0, b1, e))), (d, tuple(x[half:] for x in (a0, a1, b0, b1, e)))]
            continue
        leaves = (a1 - a0 == 1) & (b1 - b0 == 1)
        if leaves.any():
            i, j = a0[leaves], b0[leaves]
            near = (i != j) & (np.bitwise_count(keys[i] ^ keys[j]) <= budget)
            yield i[near], j[near]
            a0, a1, b0, b1, e = (x[~leaves] for x in (a0, a1, b0, b1, e))
        if d == BITS or not len(a0):
            continue
        bit = np.uint64(1 << (BITS - 1 - d))
        stem = ~np.uint64((1 << (BITS - d)) - 1)

        def middle(lo: np.ndarray, hi: np.ndarray, bit=bit, stem=stem) -> np.ndarray:
            return np.clip(np.searchsorted(keys, keys[lo] & stem | bit), lo, hi)

        am, bm, own = middle(a0, a1), middle(b0, b1), a0 == b0
        below = [(a0, am, b0, bm, e), (am, a1, bm, b1, e), (a0, am, bm, b1, e + 1)]
        below.append(tuple(x[~own] for x in (am, a1, b0, bm, e + 1)))
        merged = [np.concatenate(x) for x in zip(*below, strict=True)]
        live = (merged[0] < merged[1]) & (merged[2] < merged[3]) & (merged[4] <= budget)
        waiting.append((d + 1, tuple(x[live] for x in merged)))


class Forest:
    """Union by smallest index over numpy arrays of links."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.label[i], self.label[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(self.label, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = self.label[self.label]
                if (up == self.label).all():
                    break
                self.label = up


def _forest(keys: np.ndarray, lead: int, budget: int, halves: tuple[int, int, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links of sorted distinct ``keys`` that agree in their first ``lead`` bits, as a forest.

    ``halves``: (bits, x, y) restricts it to pairs of a key whose next bits are x with one whose are y.
    """
    cut = np.flatnonzero(np.diff(keys >> np.uint64(BITS - lead))) + 1 if lead else np.array([], int)
    lo = np.concatenate([[0], cut]).astype(np.int64)
    hi = np.concatenate([cut, [len(keys)]]).astype(np.int64)
    depth, e = lead, 0
    if halves is None or halves[1] == halves[2]:
        depth += halves[0] if halves else 0
        pairs = (lo, hi, lo, hi)
    else:
        bits, x, y = halves
        depth, e = lead + bits, (x ^ y).bit_count()
        side = (keys >> np.uint64(BITS - depth)) & np.uint64((1 << bits) - 1)
        m = int(np.searchsorted(side, max(x, y)))  # one group only: its keys are sorted by side
        lo, m, hi = (np.array([v], np.int64) for v in (0, m, len(keys)))
        pairs = (lo, m, m, hi)
    some = (pairs[0] < pairs[1]) & (pairs[2] < pairs[3]) & ((pairs[0] != pairs[2]) | (pairs[1] - pairs[0] > 1))
    pairs = tuple(p[some] for p in pairs)
    forest = Forest(len(keys))
    for i, j in trie_links(keys, (*pairs, np.full(len(pairs[0]), e, np.int64)), depth, budget):
        forest.add(i, j)
    child = np.flatnonzero(forest.label != np.arange(len(keys)))
    return child, forest.label[child]


def links(distinct: DataFrame, budget: int = 2, hot: int = HOT, deal_bits: int = DEAL_BITS) -> DataFrame:
    """(a, b): a forest with the same components as all pairs of ``fp`` within ``budget`` bits."""
    base, extra = divmod(BITS, budget + 1)
    widths = [base + (k >= budget + 1 - extra) for k in range(budget + 1)]
    turns = [sum(widths[:k]) for k in range(budget + 1)]
    schema = "a long, b long"

    def back(keys: np.ndarray, turn: int) -> pa.Array:
        return pa.array(rotated(keys, BITS - turn if turn else 0).view(np.int64))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            block, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            for k in np.unique(block):
                held.setdefault(int(k), []).append(fp[block == k])
        for k, parts in held.items():
            keys = np.unique(rotated(np.concatenate(parts), turns[k]))
            a, b = _forest(keys, widths[k], budget)
            yield pa.RecordBatch.from_arrays([back(keys[a], turns[k]), back(keys[b], turns[k])], ["a", "b"])

    def joined_pair(key: tuple, rows: pa.Table) -> pa.Table:
        k, _, x, y = (v.as_py() for v in key)
        keys = np.unique(rotated(rows["fp"].to_numpy().view(np.uint64), turns[k]))
        a, b = _forest(keys, widths[k], budget, (deal_bits, x, y))
        return pa.table([back(keys[a], turns[k]), back(keys[b], turns[k])], ["a", "b"])

    def bits(skip: int, n: int) -> F.Column:
        turned = F.col("fp") if skip == 0 else F.shiftleft("fp", skip).bitwiseOR(F.shiftrightunsigned("fp", BITS - skip))
        return F.shiftrightunsigned(turned, BITS - n)

    blocks = F.explode(F.array(*(F.struct(F.lit(k).alias("block"), bits(turns[k], widths[k]).alias("lead"), bits((turns[k] + widths[k]) % BITS, deal_bits).cast("int").alias("next")) for k in range(budget + 1))))
    rows = distinct.select("fp", blocks.alias("x")).select("fp", "x.*")
    crowded = written(rows.groupBy("block", "lead").count().filter(F.col("count") > hot).select("block", "lead"), "crowded")
    dealt = None
    if not crowded.isEmpty():
        masks = [0, *(sum(1 << b for b in c) for n in range(1, budget + 1) for c in combinations(range(deal_bits), n))]
        other = F.explode(F.array(*(F.col("next").bitwiseXOR(F.lit(m)) for m in masks)))
        again = rows.join(crowded, ["block", "lead"], "left_semi").withColumn("other", other)
        again = again.select("block", "lead", F.least("next", "other").alias("x"), F.greatest("next", "other").alias("y"), "fp")
        dealt = again.groupBy("block", "lead", "x", "y").applyInArrow(joined_pair, schema)
        rows = rows.join(crowded, ["block", "lead"], "left_anti")
    found = rows.select("block", "fp", "lead").repartition("block", "lead").select("block", "fp").mapInArrow(joined, schema)
    return found if dealt is None else found.union(dealt)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", budget: int = 2, width: int = 3, seed: int = 42, hot: int = HOT) -> DataFrame:
    """(doc_id, fp, component_id) for every row: the smallest doc_id reachable over links."""
    fps = written(fingerprints(docs, doc_id, text, width, seed), "fps")
    distinct = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fps")
    roots = components(links(distinct.select("fp"), budget, hot))
    own = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = own.groupBy("root").agg(F.min("first_id").alias("component_id"))
    labels = own.join(least, "root").select("fp", "component_id")
    return fps.join(labels, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each component, that with the smallest id; all columns stay.

    Rows that share both id and text count as one document."""
    found = near_duplicates(docs, doc_id, text, **options)
    kept = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__kept")).distinct()
    return docs.join(kept, F.col(doc_id).eqNullSafe(F.col("__kept")), "left_semi").dropDuplicates([doc_id, text])
