"""Language identification by nearest centroid.

A text is a vector of byte n-grams (of its lower-cased letters, words apart by one space), hashed
to a fixed number of places, weighted by damped term frequency and inverse document frequency and
scaled to length one. Each language has several centroids, found by spherical k-means over a
bounded sample of labelled rows; a text gets the language of the centroid with the largest cosine.
A text is rejected if it is farther from that centroid than texts of the language and of its length
are: the limit is ``slack`` of a low quantile of the sample's cosines, by length. Lengths are powers
of two of n-grams; the sample's texts give their first 1, 2, 4, ... words and their whole.

Fitting gathers at most ``per_language`` sparse vectors a language on the driver, one a text of those
rows whose keys hash lowest; rows that cannot be among them are left out where they are read, by a
limit on the hash from each label's number of rows. The sample is written to the shared folder;
lengths are measured where it is read again. Predicting reads whole texts where they are, a very
long one in pieces that end between words. No row is shuffled.

Defined cases: a null text, or one without a letter, is ``und`` with score 0 and rejected; so is
every text if there is nothing to learn from; an empty table gives no row; repeated rows are
predicted alike and count once in the sample; ties go to the language that sorts first.
:func:`predict` keeps all columns; columns of its own names are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import free, release, written
from .tokenize import pieces

PLACES_LOG2 = 13
PER_LANGUAGE = 500
CENTROIDS = 3
ROUNDS = 12
#: A text is rejected below this share of the ``LOW`` quantile of its language's cosines at its length.
SLACK = 0.5
LOW = 0.01
#: First words of the sample's texts that are measured; a length with fewer cosines than ``FEW`` takes the next shorter one's limit.
FIRST_WORDS = tuple(1 << k for k in range(12))
FEW = 30
LENGTHS = 32
#: Labels that are learned at most, those with most rows: what the driver holds is bounded by it and ``per_language``.
LABELS = 1000
UNKNOWN = "und"

_letters = regex.compile(r"\p{L}+")
_not_letters = regex.compile(r"\P{L}+")


def counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Places and numbers of the text's hashed 2- and 3-grams; both are empty without a letter."""
    total = None
    for piece in pieces(text or ""):
        letters = _not_letters.sub(" ", piece.lower()).strip()
        if not letters:
            continue
        b = np.frombuffer(f" {letters} ".encode(), np.uint8).astype(np.uint32)
        two = b[:-1] << np.uint32(8) | b[1:]
        codes = np.concatenate([two, two[:-1] << np.uint32(8) | b[2:] | np.uint32(1 << 24)])
        places = (codes * np.uint32(2654435761)) >> np.uint32(32 - PLACES_LOG2)
        found = np.bincount(places, minlength=1 << PLACES_LOG2)
        total = found if total is None else total + found
    if total is None:
        return np.empty(0, np.int32), np.empty(0, np.int64)
    places = np.flatnonzero(total)
    return places.astype(np.int32), total[places]


def length(n: np.ndarray) -> int:
    """The power of two of the number of n-grams."""
    return min(int(n.sum()).bit_length(), LENGTHS) - 1


def first_words(text: str) -> Iterator[str]:
    words = list(islice((m.group() for m in _letters.finditer(text)), FIRST_WORDS[-1] + 1))
    for k in FIRST_WORDS:
        if k < len(words):
            yield " ".join(words[:k])


def limits(cosines: list[tuple[int, float]], slack: float) -> np.ndarray:
    """The least cosine of each length, from (length, cosine) of a language's texts."""
    by = [[c for at, c in cosines if at == k] for k in range(LENGTHS)]
    enough = [slack * float(np.quantile(b, LOW)) if len(b) >= FEW else None for b in by]
    known = [x for x in enough if x is not None]
    out, last = np.zeros(LENGTHS), known[0] if known else slack * min((c for _, c in cosines), default=0.0)
    for k, x in enumerate(enough):
        out[k] = last = last if x is None else x
    return out


OWN = ("lang_pred", "score", "rejected")
FOUND = "lang_pred string, score double, rejected boolean"


@dataclass
class Model:
    languages: list[str]  # of each centroid
    centroids: np.ndarray
    idf: np.ndarray
    least: np.ndarray  # cosine below which a text is rejected, of each centroid and length

    def vector(self, places: np.ndarray, n: np.ndarray) -> np.ndarray:
        v = (1 + np.log(n)) * self.idf[places]
        return (v / np.linalg.norm(v)).astype(np.float32)

    def vectors(self, bags: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        x = np.zeros((len(bags), len(self.idf)), np.float32)
        for row, (p, n) in zip(x, bags, strict=True):
            row[p] = self.vector(p, n)
        return x

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        places, n = counts(text)
        if not len(places) or not self.languages:
            return UNKNOWN, 0.0, True
        cosines = self.centroids[:, places] @ self.vector(places, n)
        best = int(np.argmax(cosines))
        cosine = float(cosines[best])
        return self.languages[best], min(1.0, max(0.0, cosine)), bool(cosine < self.least[best, length(n)])


def _clusters(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means from farthest-first starts: unit centroids."""
    picked = [int(np.argmax(x @ x.mean(axis=0)))]
    while len(picked) < min(k, len(x)):
        picked.append(int(np.argmin((x @ x[picked].T).max(axis=1))))
    c = x[picked].copy()
    for _ in range(ROUNDS):
        own = np.argmax(x @ c.T, axis=1)
        for j in range(len(c)):
            if (own == j).any():
                mean = x[own == j].sum(axis=0)
                c[j] = mean / np.linalg.norm(mean)
    own = np.argmax(x @ c.T, axis=1)
    return c[[j for j in range(len(c)) if (own == j).any()]]


def place_of(key: F.Column) -> F.Column:
    """A key's place between 0 and 1, by its hash."""
    return F.shiftrightunsigned(F.xxhash64(key), 11).cast("double") / float(1 << 53)


def share_of(keys: F.Column, wanted: int) -> F.Column:
    """A place below which, of so many keys, ``wanted`` lie almost surely (by eight deviations), and few more.

    ``keys`` may be an estimate that is 20% too large.
    """
    return (F.lit(wanted + 8 * wanted**0.5 + 40) * 1.2) / F.greatest(F.lit(1), keys)


def fit(rows: DataFrame, label: str = "lang", text: str = "text", key: str = "doc_id", per_language: int = PER_LANGUAGE, k: int = CENTROIDS, slack: float = SLACK) -> Model:
    """Learn from at most ``per_language`` rows of each label, those whose keys hash lowest."""
    named = rows.filter(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(label).alias("label"), F.col(key).alias("key"), F.col(text).alias("text"))
    named = named.withColumn("place", place_of(F.col("key")))
    # a row a label, LABELS at most
    known = named.groupBy("label").agg(F.approx_count_distinct("key").alias("keys")).orderBy(F.desc("keys"), "label").limit(LABELS)
    known = known.select("label", share_of(F.col("keys"), per_language).alias("share"))
    keys = named.select("label", "key", "place").join(F.broadcast(known), "label").filter("place <= share").select("label", "key", "place").distinct()
    order = Window.partitionBy("label").orderBy("place", "key")
    sample = keys.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= per_language).select("label", "key")

    # the sample has a bounded number of rows a label; it is read twice
    chosen = written(named.join(F.broadcast(sample), ["key", "label"]).select("label", "text"), "language-sample")

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, n = zip(*(counts(text) for text in batch.column(1).to_pylist()), strict=True) if batch.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(place, pa.list_(pa.int32())), pa.array(n, pa.list_(pa.int32()))], ["label", "places", "n"])

    got = chosen.mapInArrow(featured, "label string, places array<int>, n array<int>").filter("size(places) > 0").toArrow()
    labels = got["label"].to_pylist()
    bags = [(p.values.to_numpy(), n.values.to_numpy()) for p, n in zip(got["places"], got["n"], strict=True)]
    dims = 1 << PLACES_LOG2
    frequency = np.bincount(np.concatenate([p for p, _ in bags]), minlength=dims) if bags else np.zeros(dims)
    model = Model([], np.zeros((0, dims), np.float32), np.log((1 + len(bags)) / (1 + frequency)) + 1, np.zeros((0, LENGTHS)))
    for name in sorted(set(labels)):
        c = _clusters(model.vectors([b for b, own in zip(bags, labels, strict=True) if own == name]), k)
        model.languages += [name] * len(c)
        model.centroids = np.concatenate([model.centroids, c])
    del got, bags
    model.least = np.zeros((len(model.languages), LENGTHS))
    near: dict[str, list[tuple[int, float]]] = {name: [] for name in labels}
    found = measured(chosen, model).toArrow()
    for name, at, cosine in zip(*(c.to_pylist() for c in found.columns), strict=True):
        near[name].append((at, cosine))
    for name, cosines in near.items():
        model.least[[j for j, own in enumerate(model.languages) if own == name]] = limits(cosines, slack)
    release()
    return model


def measured(chosen: DataFrame, model: Model) -> DataFrame:
    """(label, length, cosine) of the sample's texts and their first words, by the label's nearest centroid.

    They are measured where they are: only these numbers come to the driver, no n-grams of first words.
    """
    own = {name: model.centroids[[j for j, x in enumerate(model.languages) if x == name]] for name in set(model.languages)}
    vector = model.vector

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, at, cosine = [], [], []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for piece in (text, *first_words(text)):
                    p, n = counts(piece)
                    if len(p):
                        label.append(name), at.append(length(n)), cosine.append(float((own[name][:, p] @ vector(p, n)).max()))
            yield pa.RecordBatch.from_arrays([pa.array(label, pa.string()), pa.array(at, pa.int32()), pa.array(cosine, pa.float64())], ["label", "length", "cosine"])
        release()

    return chosen.mapInArrow(measure, "label string, length int, cosine double")


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and rejected.

    Only texts go to the Python workers, in batches of Spark's; the other columns stay where they are.
    """

    def found(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in texts:
            rows = [model.predict(t.as_py()) for t in part]
            yield pa.StructArray.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))], list(OWN))

    kept, (name,) = [c for c in docs.columns if c not in OWN], free(docs, "__found")
    marked = docs.select(*kept, F.arrow_udf(found, FOUND)(F.col(text)).alias(name))
    return marked.select(*kept, *(F.col(f"{name}.{c}") for c in OWN))


def accepted(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Rows of ``docs`` that the model does not reject; all columns stay, whatever their names."""

    def kept(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in texts:
            yield pa.array([not model.predict(t.as_py())[2] for t in part], pa.bool_())
        release()

    return docs.filter(F.arrow_udf(kept, "boolean")(F.col(text)))


def held_out(key: str = "doc_id", folds: int = 3, fold: int = 1) -> F.Column:
    """True for rows that are kept from learning: the CRC-32 of the key's text modulo ``folds``."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds == fold, F.lit(False))
