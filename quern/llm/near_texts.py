"""Near-duplicate texts: SimHash tries propose pairs, shingle sets decide.

Two texts are linked if the Jaccard similarity of their sets of ``WIDTH``-word shingles (ASCII
letters lower-cased, words apart by ASCII white space) is ``SIMILARITY`` or more; links join into
components.

Texts of one word sequence are one class from the start. Each class has a 64-bit SimHash of its
distinct shingles and min-hashes of them in ``BANDS`` bands of ``ROWS``. Rows are dealt by band key,
and in each such group a binary trie self-join (:mod:`simhash`) drops pairs that differ in more than
``BUDGET`` bits: what is left is proposed. Proposals join into candidate components, to which each
class's whole shingle set goes once, and there a second traversal compares sets exactly. It prunes
node pairs over the budget, and pairs whose texts are in one component already; the most central
text goes first, so a dense group costs far less than its pairs.

At a similarity of exactly 0.8 a pair shares no band with probability 2e-6 and is over the budget
with probability below 1e-4 (both fall fast above it); nothing else can lose a link, and nothing is
linked below the limit.

Nothing unbounded meets in one task. A band key of more than ``HOT`` rows proposes links to its
least fingerprint by a join that Spark can split. A candidate component of more than ``PART``
classes is compared with its most central text first, by a join as well; those linked to it need
not meet each other, so only the rest is dealt, in parts, to meet every part.

Defined cases: null and empty texts and texts of white space are one class; texts of fewer words than
a shingle have one shingle of all their words; very long texts are shingled whole; repeated rows are
one document; of equal ids the text that hashes lowest stands for a component; a null doc_id sorts
last; an empty table gives no row; :func:`keep_one` keeps all columns, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .simhash import _LOWER, BITS, FRONTIER
from .storage import free, release, written

WIDTH, SIMILARITY = 5, 0.8
BANDS, ROWS = 25, 4
#: Differing bits of two fingerprints, of the 9.7 expected at a similarity of 0.8 and of 32 between strangers.
BUDGET = 24
#: Rows of a band key, and classes of a candidate component, that one task takes.
HOT, PART = 200_000, 2_000
#: Ids of dropped rows that are broadcast at most.
BROADCAST_ROWS = 500_000
#: Shingles that are hashed and counted together.
CHUNK = 1 << 13

_random = np.random.default_rng(20_240_517)
_MULTIPLY = _random.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FLIP = _random.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_MIX = _random.integers(1, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_LOWER).split()


def shingles(found: list[bytes], width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the words' shingles."""
    from xxhash import xxh64_intdigest

    if len(found) < width:
        return np.array([xxh64_intdigest(b" ".join(found), 42)] if found else [], np.uint64)
    parts = []
    for at in range(0, len(found) - width + 1, CHUNK):
        part = found[at : at + CHUNK + width - 1]
        parts.append(np.unique(np.fromiter(map(xxh64_intdigest, map(b" ".join, zip(*(part[k:] for k in range(width))))), np.uint64)))
    return parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))


def sketch(hashes: np.ndarray) -> tuple[int, np.ndarray]:
    """SimHash of a set of shingles, and its band keys; an empty set has zeros."""
    if not len(hashes):
        return 0, np.zeros(BANDS, np.int64)
    bits, least = np.zeros(BITS, np.int64), np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at : at + CHUNK]
        bits += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        for lo in range(0, len(part), 512):
            some = part[lo : lo + 512]
            np.minimum(least, ((some[:, None] ^ _FLIP) * _MULTIPLY).min(axis=0), out=least)
    keys = (least.reshape(BANDS, ROWS) * _MIX).sum(axis=1, dtype=np.uint64) ^ np.arange(BANDS, dtype=np.uint64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view("<u8")[0]), keys.view(np.int64)


def class_of(found: list[bytes]) -> str:
    from xxhash import xxh3_128_hexdigest

    return xxh3_128_hexdigest(b" ".join(found))


def sketches(docs: DataFrame, doc_id: str, text: str, width: int) -> DataFrame:
    """(doc_id, th, class, fp, bands) of each row; th is the hash of its text."""

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            classes, fps, bands = [], [], []
            for t in batch.column(2):
                found = words(t.as_py())
                fp, keys = sketch(shingles(found, width))
                classes.append(class_of(found)), fps.append(fp), bands.append(keys)
            flat = pa.array(np.concatenate(bands) if bands else np.empty(0, np.int64))
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(fps) + 1, dtype=np.int32) * BANDS), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(classes, pa.string()), pa.array(np.array(fps, np.uint64).view(np.int64)), bands], ["doc_id", "th", "class", "fp", "bands"])
        release()

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("th"), F.col(text).alias("text")).mapInArrow(sketched, f"doc_id {kind}, th long, class string, fp long, bands array<long>")


def proposed(classes: DataFrame, budget: int, hot: int) -> DataFrame:
    """(a, b) of fingerprints: a forest of those that share a band key and are within the budget."""
    rows = classes.select("fp", F.explode("bands").alias("key"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64)) for b in batches if b.num_rows]
        if not parts:
            return
        key, fp = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((fp, key))
        key, fp = key[order], fp[order]
        fresh = np.concatenate([[True], (np.diff(key) != 0) | (fp[1:] != fp[:-1])])
        key, fp = key[fresh], fp[fresh]
        starts = np.flatnonzero(np.concatenate([[True], np.diff(key) != 0]))
        ends = np.append(starts[1:], len(key))
        two = starts[ends - starts == 2]
        two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= budget]
        a, b = [fp[two]], [fp[two + 1]]
        for lo, hi in zip(starts[ends - starts > 2].tolist(), ends[ends - starts > 2].tolist(), strict=True):
            links = np.array(Texts(fp[lo:hi]).search(budget), np.int64).reshape(-1, 2)
            a.append(fp[lo:hi][links[:, 0]]), b.append(fp[lo:hi][links[:, 1]])
        a, b = (np.concatenate(x).view(np.int64) for x in (a, b))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
        release()

    crowded = written(rows.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("least")).filter(F.col("n") > hot).select("key", "least"), "crowded")
    if crowded.isEmpty():
        return rows.select("key", "fp").repartition("key").mapInArrow(joined, "a long, b long")
    stars = rows.join(crowded, "key").select(F.col("fp").alias("a"), F.col("least").alias("b"))
    return rows.join(crowded, "key", "left_anti").select("key", "fp").repartition("key").mapInArrow(joined, "a long, b long").union(stars)


class Texts:
    """Texts that meet in a task, in order of their fingerprints, and their components so far.

    ``sets``: the shingles that decide; without them all pairs within the budget are links.
    """

    def __init__(self, fps: np.ndarray, sets: list[np.ndarray] | None = None, label: np.ndarray | None = None, similarity: float = 0.0):
        self.order = np.argsort(fps, kind="stable")
        self.keys, self.similarity = fps[self.order], similarity
        self.label = np.arange(len(fps)) if label is None else label[self.order]
        self.sets = None if sets is None else [sets[k] for k in self.order]
        self.sizes = None if sets is None else np.array([len(s) for s in self.sets], np.int64)
        self.links: list[tuple[int, int]] = []

    def compare(self, i: np.ndarray, j: np.ndarray) -> None:
        """Link those of the pairs that are similar enough, unless they are in one component by then."""
        by = np.argsort(i, kind="stable")
        i, j = i[by], j[by]
        cuts = np.flatnonzero(np.concatenate([[True], np.diff(i) != 0, [True]])) if len(i) else np.array([0])
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            one, others = int(i[lo]), j[lo:hi]
            others = others[self.label[others] != self.label[one]]
            if self.sets is not None and len(others):
                others = others[self._similar(one, others)]
            if len(others):
                labels, first = np.unique(self.label[others], return_index=True)
                self.links += [(one, k) for k in others[first].tolist()]
                self.label[np.isin(self.label, labels)] = self.label[one]

    def _similar(self, one: int, others: np.ndarray) -> np.ndarray:
        mine, n, sizes = self.sets[one], int(self.sizes[one]), self.sizes[others]
        able = np.minimum(sizes, n) >= self.similarity * np.maximum(sizes, n)
        at = np.flatnonzero(able)
        if not n or not len(at):
            return able
        flat = np.concatenate([self.sets[k] for k in others[at]])
        hit = mine[np.minimum(np.searchsorted(mine, flat), n - 1)] == flat
        shared = np.add.reduceat(hit, np.concatenate([[0], np.cumsum(sizes[at])[:-1]]), dtype=np.int64)
        able[at] = shared >= self.similarity * (sizes[at] + n - shared)
        return able

    def star(self, budget: int) -> None:
        """Compare the most central text, nearest to the majority of the fingerprints' bits, with all others."""
        ones = np.unpackbits(self.keys.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        middle = np.packbits(2 * ones > len(self.keys), bitorder="little").view("<u8")[0]
        centre = int(np.argmin(np.bitwise_count(self.keys ^ middle)))
        near = np.flatnonzero(np.bitwise_count(self.keys ^ self.keys[centre]) <= budget)
        near = near[near != centre]
        self.compare(np.full(len(near), centre), near)

    def search(self, budget: int) -> list[tuple[int, int]]:
        """All links that join components, as indices of the given classes; a trie node is a range of the sorted fingerprints."""
        n = len(self.keys)
        if n > 2:
            self.star(budget)
        one = lambda *x: tuple(np.array([v], np.int64) for v in x)
        waiting = [(0, one(0, n, 0, n, 0))] if n > 1 else []
        while waiting:
            d, (a0, a1, b0, b1, e) = waiting.pop()
            if len(a0) > 1 and int(((a1 - a0) * (b1 - b0)).sum()) > FRONTIER and len(a0) > FRONTIER // 64:
                half = len(a0) // 2
                waiting += [(d, tuple(x[:half] for x in (a0, a1, b0, b1, e))), (d, tuple(x[half:] for x in (a0, a1, b0, b1, e)))]
                continue
            changes = np.concatenate([[0], np.cumsum(np.diff(self.label) != 0)])
            joined = (changes[a0] == changes[a1 - 1]) & (changes[b0] == changes[b1 - 1]) & (self.label[a0] == self.label[b0])
            a0, a1, b0, b1, e = (x[~joined] for x in (a0, a1, b0, b1, e))
            few = ((a1 - a0) * (b1 - b0) <= 64) | (d == BITS)
            if few.any():
                x0, x1, y0, y1 = (x[few] for x in (a0, a1, b0, b1))
                counts = (x1 - x0) * (y1 - y0)
                own = np.repeat(np.arange(len(counts)), counts)
                place = np.arange(len(own)) - np.repeat(np.cumsum(counts) - counts, counts)
                wide = (y1 - y0)[own]
                i, j = x0[own] + place // wide, y0[own] + place % wide
                near = (i < j) & (np.bitwise_count(self.keys[i] ^ self.keys[j]) <= budget) & (self.label[i] != self.label[j])
                self.compare(i[near], j[near])
                a0, a1, b0, b1, e = (x[~few] for x in (a0, a1, b0, b1, e))
            if not len(a0):
                continue
            bit, stem = np.uint64(1 << (BITS - 1 - d)), ~np.uint64((1 << (BITS - d)) - 1)

            def middle(lo: np.ndarray, hi: np.ndarray, bit=bit, stem=stem) -> np.ndarray:
                return np.clip(np.searchsorted(self.keys, self.keys[lo] & stem | bit), lo, hi)

            am, bm, own = middle(a0, a1), middle(b0, b1), a0 == b0
            below = [(a0, am, b0, bm, e), (am, a1, bm, b1, e), (a0, am, bm, b1, e + 1), tuple(x[~own] for x in (am, a1, b0, bm, e + 1))]
            merged = [np.concatenate(x) for x in zip(*below, strict=True)]
            live = (merged[0] < merged[1]) & (merged[2] < merged[3]) & (merged[4] <= budget)
            waiting.append((d + 1, tuple(x[live] for x in merged)))
        return [(int(self.order[x]), int(self.order[y])) for x, y in self.links]


def verified(members: DataFrame, similarity: float, budget: int, part: int) -> DataFrame:
    """(a, b) of classes: links of ``members`` (root, class, fp, hashes), a forest of each candidate component or of its parts."""

    def meet(rows: pa.Table) -> pa.Table:
        names = rows["class"].to_pylist()
        label = np.arange(len(names))
        settled = np.flatnonzero(rows["settled"].to_numpy())
        if len(settled):
            label[settled] = settled[0]
        sets = [np.sort(x.values.to_numpy().view(np.uint64)) for x in rows["hashes"]]
        found = Texts(rows["fp"].to_numpy().view(np.uint64), sets, label, similarity).search(budget)
        return pa.table([pa.array([names[x] for x, _ in found], pa.string()), pa.array([names[y] for _, y in found], pa.string())], ["a", "b"])

    sizes = members.groupBy("root").agg(F.count("*").alias("n"))
    large = written(sizes.filter(F.col("n") > part), "large-components")
    some = members if large.isEmpty() else members.join(large.select("root"), "root", "left_anti")
    found = some.withColumn("settled", F.lit(False)).groupBy("root").applyInArrow(meet, "a string, b string")
    if large.isEmpty():
        return found
    rows = members.join(large, "root")
    # the most central text of a large component: that nearest to the majority of its fingerprints, bit by bit
    ones = [(2 * F.sum(F.shiftrightunsigned("fp", k).bitwiseAND(F.lit(1))) > F.count("*")).cast("long") for k in range(BITS)]
    middle = rows.groupBy("root").agg(F.array(*ones).alias("bits"))
    middle = middle.select("root", F.aggregate(F.transform("bits", lambda x, k: F.call_function("shiftleft", x, k)), F.lit(0).cast("long"), lambda x, y: x.bitwiseOR(y)).alias("middle"))
    far = F.bit_count(F.col("fp").bitwiseXOR(F.col("middle")))
    centres = rows.join(middle, "root").groupBy("root").agg(F.min_by(F.struct("class", "hashes"), F.struct(far, "class")).alias("centre"))
    shared = F.size(F.array_intersect("hashes", "centre.hashes"))
    close = shared >= similarity * (F.size("hashes") + F.size("centre.hashes") - shared)
    judged = rows.join(centres, "root").select("root", "class", "fp", "hashes", "n", F.col("centre.class").alias("centre"), close.alias("settled"))
    judged = written(judged.withColumn("part", F.pmod(F.xxhash64("class"), F.ceil(F.col("n") / part)).cast("int")), "large-members")
    stars = judged.filter("settled and class <> centre").select(F.col("class").alias("a"), F.col("centre").alias("b"))
    rest = judged.filter("not settled").groupBy("root").agg(F.count("*").alias("left"))
    dealt = judged.join(rest, "root").withColumn("turns", F.ceil(F.col("left") / part).cast("int"))
    # the rest's parts, each of which meets every part of its component
    turn = F.pmod(F.xxhash64("class", F.lit(1)), F.col("turns")).cast("int")
    guests = F.sequence(F.lit(0), F.col("turns") - 1)
    whole = dealt.withColumn("turn", F.explode(guests))
    own = dealt.filter("not settled").withColumn("turn", turn).withColumn("part", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / part).cast("int") - 1)))
    columns = ["root", "turn", "part", "class", "fp", "hashes", "settled"]
    met = whole.select(columns).union(own.select(columns)).dropDuplicates(["root", "turn", "part", "class"])
    return found.union(stars).union(met.groupBy("root", "turn", "part").applyInArrow(meet, "a string, b string"))


def near_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, width: int = WIDTH, budget: int = BUDGET, hot: int = HOT, part: int = PART) -> DataFrame:
    """(doc_id, th, class, component_id, component_th) of every row: the text that stands for its component."""
    rows = written(sketches(docs, doc_id, text, width), "sketches")
    least = lambda *c: F.min(F.struct(F.col("doc_id").isNull().alias("none"), *c))
    classes = written(rows.groupBy("class").agg(least("doc_id", "th").alias("first"), F.first("fp").alias("fp"), F.first("bands").alias("bands")), "classes")
    roots = components(proposed(classes, budget, hot))
    members = classes.select("class", "first", "fp").join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    several = members.groupBy("root").count().filter("count > 1").select("root")
    members = written(members.join(several, "root", "left_semi"), "candidate-classes")

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0):
                found = words(t.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([class_of(found)]), pa.array([shingles(found, width).view(np.int64)], pa.list_(pa.int64()))], ["class", "hashes"])

    wanted = members.select(F.col("first.doc_id").alias("__id"), F.col("first.th").alias("__th"))
    wanted = F.broadcast(wanted) if members.count() <= BROADCAST_ROWS else wanted
    read = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(wanted, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__th")), "left_semi")
    sets = read.select("text").mapInArrow(shingled, "class string, hashes array<long>")
    links = verified(written(members.join(sets, "class").select("root", "class", "fp", "hashes"), "candidate-sets"), similarity, budget, part)
    joined = components(links)
    known = classes.select("class", "first").join(joined.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    stands = known.groupBy("root").agg(F.min("first").alias("stands"))
    named = known.join(stands, "root").select("class", "stands")
    return rows.select("doc_id", "th", "class").join(named, "class").select("doc_id", "th", "class", F.col("stands.doc_id").alias("component_id"), F.col("stands.th").alias("component_th"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each component, that with the smallest id; all columns stay."""
    found = written(near_texts(docs, doc_id, text, **options), "near-texts")
    id_, th_ = free(docs, "__id", "__th")
    stays = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("th") == F.col("component_th"))
    gone = found.filter(~stays).select(F.col("doc_id").alias(id_), F.col("th").alias(th_)).distinct()
    same = F.col(doc_id).eqNullSafe(F.col(id_)) & (F.xxhash64(F.col(text)) == F.col(th_))
    left = docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, same, "left_anti")
    twice = written(found.filter(stays).groupBy(F.col("doc_id").alias(id_), F.col("th").alias(th_)).count().filter("count > 1").select(id_, th_), "repeated-rows")
    if twice.isEmpty():
        return left
    return left.join(twice, same, "left_anti").union(left.join(twice, same, "left_semi").dropDuplicates([doc_id, text]))
