"""Toxicity by a counterfactual-regularised classifier.

A logistic model over hashed words and character n-grams (whether they occur, not how often). It
is fit on a bounded sample of labelled rows. Texts that name groups are also featured with one group's
name swapped for another's, name by name, so that texts that name both change as well; differences
between the two scores are penalised, ``penalty`` times their mean square: what a group is called
then says little about the score, so neutral mentions are not taken for abuse.

Fitting gathers at most ``positives`` + ``negatives`` hashed feature lists on the driver, and up to
``SWAPS`` swapped ones of each; scoring reads whole texts where they are, a very long one in pieces
that end between words, and no row is shuffled.

Defined cases: null and empty texts have the score of no feature; of equal hashes of keys the lesser
key is sampled; without labelled rows of both
classes every score is the share of label 1 in the sample (0 if it is empty); repeated rows are scored alike;
an empty table gives no row. :func:`score` keeps all columns; columns of its own names are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

POSITIVES, NEGATIVES = 2000, 4000
PLACES_LOG2 = 20
#: Features whose occurrence differs less than by chance between the classes are left out.
LEAST_Z, LEAST_DOCS, FEATURES = 4.0, 4, 8192
PENALTY, RIDGE, STEPS, RATE = 1.0, 1e-3, 400, 0.1
#: Identity terms, in groups within which a term is swapped for the next. A parameter.
IDENTITIES = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("girl", "boy"), ("female", "male"), ("gay", "straight", "lesbian", "bisexual"), ("transgender", "cisgender"),
    ("black", "white", "asian", "latino"), ("muslim", "christian", "jewish", "hindu", "buddhist"), ("muslims", "christians", "jews", "hindus", "buddhists"),
    ("african", "european", "mexican", "chinese", "indian", "american"), ("immigrant", "native"), ("immigrants", "natives"), ("old", "young"), ("disabled", "abled"), ("deaf", "hearing"), ("blind", "sighted"),
    # German
    ("frauen", "männer"), ("frau", "mann"), ("mädchen", "jungen"), ("schwul", "hetero", "lesbisch"), ("schwarze", "weiße"), ("muslime", "christen", "juden", "hindus"), ("türken", "deutsche", "polen", "russen"), ("ausländer", "einheimische"),
    # Spanish
    ("mujeres", "hombres"), ("mujer", "hombre"), ("niñas", "niños"), ("gays", "heteros", "lesbianas"), ("negros", "blancos"), ("musulmanes", "cristianos", "judíos", "hindúes"), ("mexicanos", "españoles", "chinos", "gitanos"), ("inmigrantes", "nativos"),
    # French
    ("femmes", "hommes"), ("femme", "homme"), ("filles", "garçons"), ("gais", "hétéros", "lesbiennes"), ("noirs", "blancs"), ("musulmans", "chrétiens", "juifs", "hindous"), ("arabes", "français", "chinois", "allemands"), ("immigrés", "natifs"),
)
#: Swaps of a sampled text that are learned from at most, those of its terms that sort first.
SWAPS = 8
#: Words that a worker remembers at most, and the longest that it does.
MEMO_WORDS, LONGEST_WORD = 200_000, 64
#: Characters of a text that are split at a time.
PIECE = 1 << 20

_word = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> set[str]:
    """Distinct lower-case words of the whole text."""
    found: set[str] = set()
    at, text = 0, text or ""
    while at < len(text):
        end = at + PIECE
        while end < len(text) and text[end].isalpha():
            end += 1
        found.update(_word.findall(text[at:end].lower()))
        at = end
    return found


def features(word: str) -> list[int]:
    """Hashed places of the word, and of the n-grams of 3 to 6 characters of it with its ends marked."""
    marked = f"^{word}$".encode()
    grams = {marked[i : i + n] for n in (3, 4, 5, 6) for i in range(len(marked) - n + 1)}
    return [crc32(g) & ((1 << PLACES_LOG2) - 1) for g in (b"w" + marked, *grams)]


def swaps(identities=IDENTITIES) -> dict[str, str]:
    return {w: group[(k + 1) % len(group)] for group in identities for k, w in enumerate(group)}


@dataclass
class Model:
    bias: float
    weights: dict[int, float]
    memo: dict[str, tuple[int, ...]] = field(default_factory=dict)

    def __getstate__(self):
        return self.__dict__ | {"memo": {}}

    def score(self, text: str | None) -> float:
        found: set[int] = set()
        memo = self.memo
        for w in words(text):
            hit = memo.get(w)
            if hit is None:
                if len(memo) >= MEMO_WORDS:
                    memo.clear()
                hit = tuple(f for f in features(w) if f in self.weights)
                if len(w) <= LONGEST_WORD:
                    memo[w] = hit
            if hit:
                found.update(hit)
        z = self.bias + sum(self.weights[f] for f in sorted(found))
        return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))


def _matrix(bags: list[np.ndarray], place: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each kept feature."""
    cols = [np.array([place[f] for f in b.tolist() if f in place], np.int64) for b in bags]
    return np.repeat(np.arange(len(bags)), [len(c) for c in cols]), np.concatenate(cols) if cols else np.empty(0, np.int64)


def counterfactuals(found: set[str], swap: dict[str, str], most: int = SWAPS) -> list[set[str]]:
    """The words with one identity term at a time swapped for the next of its group."""
    return [(found - {w}) | {swap[w]} for w in sorted(found & swap.keys())[:most]]


def train(bags: list[np.ndarray], labels: np.ndarray, swapped: dict[int, np.ndarray] | list[tuple[int, np.ndarray]], penalty: float = PENALTY) -> Model:
    """Fit the weights. ``bags``: features of each row; ``swapped``: rows' numbers with their features after a swap."""
    n, pos = len(bags), int(labels.sum()) if len(bags) else 0
    if pos in (0, n):
        share = pos / n if n else 0.0
        return Model(float(np.log((share + 1e-9) / (1 - share + 1e-9))), {})
    dims = 1 << PLACES_LOG2
    by = [np.bincount(np.concatenate([b for b, y in zip(bags, labels, strict=True) if y == c]), minlength=dims) for c in (0, 1)]
    p, df = by[1] / pos, by[0] + by[1]
    q = by[0] / (n - pos)
    pooled = df / n
    z = np.abs(p - q) / np.sqrt(np.maximum(pooled * (1 - pooled) * (1 / pos + 1 / (n - pos)), 1e-12))
    z[df < LEAST_DOCS] = 0
    kept = np.argsort(-z, kind="stable")[:FEATURES]
    kept = kept[z[kept] >= LEAST_Z]
    place = {int(f): k for k, f in enumerate(kept)}
    row, col = _matrix(bags, place)
    pairs = sorted(swapped.items()) if isinstance(swapped, dict) else swapped
    prow, pcol = _matrix([b for _, b in pairs], place)
    orow, ocol = _matrix([bags[i] for i, _ in pairs], place)
    m, k = len(place), len(pairs)
    w, b = np.zeros(m), float(np.log(pos / (n - pos)))
    g2, v, u = np.zeros(m + 1), np.zeros(m + 1), 0.9
    for step in range(1, STEPS + 1):
        zed = b + np.bincount(row, w[col], n)
        off = (1 / (1 + np.exp(-np.clip(zed, -50, 50))) - labels) / n
        gw = np.bincount(col, off[row], m) + RIDGE * w
        if k:
            gap = (np.bincount(orow, w[ocol], k) - np.bincount(prow, w[pcol], k)) * (2 * penalty / k)
            gw += np.bincount(ocol, gap[orow], m) - np.bincount(pcol, gap[prow], m)
        g = np.append(gw, off.sum())
        v, g2 = u * v + (1 - u) * g, 0.999 * g2 + 0.001 * g * g
        move = RATE * (v / (1 - u**step)) / (np.sqrt(g2 / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return Model(float(b), {int(f): float(x) for f, x in zip(kept, w, strict=True)})


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text", identities=IDENTITIES, penalty: float = PENALTY, positives: int = POSITIVES, negatives: int = NEGATIVES) -> Model:
    """Learn from at most ``positives`` and ``negatives`` labelled rows, those whose keys hash lowest."""
    known = labels.filter(F.col(label).isin(0, 1)).select(F.col(key).alias("key"), F.col(label).cast("int").alias("label"))
    order = (F.xxhash64("key"), F.col("key"), F.col("label"))
    sample = known.filter("label = 1").orderBy(*order).limit(positives).union(known.filter("label = 0").orderBy(*order).limit(negatives))
    swap = swaps(identities)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def places(found: set[str]) -> list[int]:
            return sorted({f for w in found for f in features(w)})

        for batch in batches:
            own, other = [], []
            for t in batch.column(1):
                found = words(t.as_py())
                own.append(places(found))
                other.append([places(x) for x in counterfactuals(found, swap)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.list_(pa.int32())), pa.array(other, pa.list_(pa.list_(pa.int32())))], ["label", "own", "other"])

    # the sample has a bounded number of rows
    chosen = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(sample), "key")
    got = chosen.select("label", "text").mapInArrow(featured, "label int, own array<int>, other array<array<int>>").toArrow()
    bags = [x.values.to_numpy() for x in got["own"]]
    swapped = [(i, x.values.to_numpy()) for i, row in enumerate(got["other"]) for x in row]
    return train(bags, got["label"].to_numpy().astype(float), swapped, penalty)


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """``docs`` with score and predicted (1 if the score reaches ``threshold``)."""
    docs = docs.drop("score", "predicted")
    at = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([model.score(t.as_py()) for t in batch.column(at)], float)
            new = [pa.array(found), pa.array((found >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, "score", "predicted"])

    return docs.mapInArrow(add, schema)
