"""Document fingerprints by consistent weighted sampling.

A document is a set of terms (words) weighted by how often they occur. For each of ``SAMPLES``
positions every term draws two Gamma(2, 1) variates r and c and a uniform one b, all from hashes of
the term and the position alone. With weight S the term's level is t = floor(ln S / r + b) and its
key c exp(-r (t - b)) exp(-r); the term of smallest key, with its level, is the sample. Two
documents agree in a position with the probability of their generalised Jaccard similarity
(sum of smaller weights over sum of larger ones). A position of the fingerprint is 24 bits of the
hash of sampled term and level.

Only DataFrame functions are used. Texts are dealt out once by document; words are counted, drawn
and reduced where they are, so of 100 million words nothing is shuffled but a few numbers a document.

Defined cases: a null text is an empty one; a text without words has the fingerprint of no term,
``EMPTY`` at each position, equal to any other such; documents that share id and text are equal
rows, each emitted; a null doc_id sorts last in descending order; an only document is its own next
one; an empty table gives no row. Columns other than those named are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import written

SAMPLES = 32
EMPTY = "-" * 6
_BREAK = r"[\x20\x09-\x0D]+"
#: A draw's 21 bits as a number between 0 and 1, never either.
_UNIT = float(1 << 21)


def _draws(term: Column, position: int) -> tuple[Column, Column, Column]:
    """(r, ln c, b) of a hashed term."""
    one, two = F.xxhash64(term, F.lit(2 * position)), F.xxhash64(term, F.lit(2 * position + 1))

    def unit(h: Column, k: int) -> Column:
        return (F.shiftrightunsigned(h, 21 * k).bitwiseAND(F.lit((1 << 21) - 1)).cast("double") + 0.5) / _UNIT

    r = -F.ln(unit(one, 0) * unit(one, 1))
    return r, F.ln(-F.ln(unit(one, 2) * unit(two, 0))), unit(two, 1)


def sample(term: Column, log_weight: Column, position: int) -> Column:
    """Least over a document's terms is its sample: the key's logarithm above, 24 hash bits below."""
    r, log_c, b = _draws(term, position)
    level = F.floor(log_weight / r + b)
    key = log_c - r * (level - b) - r
    return F.shiftleft(F.floor((key + 256.0) * float(1 << 28)), 24).bitwiseOR(F.xxhash64(term, level, F.lit(position)).bitwiseAND(F.lit((1 << 24) - 1)))


def _text_of(samples: list[str]) -> Column:
    return F.concat(*(F.coalesce(F.lpad(F.lower(F.hex(F.col(s).bitwiseAND(F.lit((1 << 24) - 1)))), 6, "0"), F.lit(EMPTY)) for s in samples))


def fingerprints(texts: DataFrame, key: list[str], columns: list[str], samples: int = SAMPLES) -> DataFrame:
    """``key`` and, for each of the text ``columns``, its fingerprint as ``<column>_fp``.

    The columns of a row share the draws of the terms that they share. If ``texts`` is dealt out
    by ``key`` already, no row moves.
    """
    split = F.array(*(F.struct(F.lit(n).alias("n"), F.split(F.coalesce(F.col(c), F.lit("")), _BREAK).alias("words")) for n, c in enumerate(columns)))
    words = texts.select(*key, F.explode(split).alias("x")).select(*key, "x.n", F.explode("x.words").alias("word"))
    # an empty word stands for every text, so that texts without words keep their row
    tf = words.groupBy(*key, "word").agg(*(F.count_if((F.col("n") == n) & (F.col("word") != "")).alias(f"n{n}") for n in range(len(columns))))
    logs = tf.select(*key, F.xxhash64("word").alias("term"), *(F.when(F.col(f"n{n}") > 0, F.ln(F.col(f"n{n}"))).alias(f"w{n}") for n in range(len(columns))))
    drawn = logs.groupBy(*key).agg(*(F.min(sample(F.col("term"), F.col(f"w{n}"), p)).alias(f"s{n}_{p}") for p in range(samples) for n in range(len(columns))))
    return drawn.select(*key, *(_text_of([f"s{n}_{p}" for p in range(samples)]).alias(f"{c}_fp") for n, c in enumerate(columns)))


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """Share of equal positions: an estimate of the generalised Jaccard similarity."""
    same = [(F.substring(a, 6 * p + 1, 6) == F.substring(b, 6 * p + 1, 6)).cast("int") for p in range(samples)]
    total = same[0]
    for s in same[1:]:
        total = total + s
    return total.cast("double") / samples


def in_order(docs: DataFrame) -> DataFrame:
    """(key, next_key, n, next_n, doc_id, copies) of each distinct document of (key, doc_id, n).

    The order is descending doc_id, then key; the last document's next is the first. Ranges of the
    order are numbered by one range shuffle; only their first rows, one a range, meet in one task.
    """
    each = docs.groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.first("n").alias("n"), F.count("*").alias("copies"))
    order = (F.col("doc_id").desc_nulls_last(), F.col("key"))
    ranged = written(each.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "ordered-ids")
    own = Window.partitionBy("range").orderBy(*order)
    ranks = ranged.withColumn("place", F.row_number().over(own)).withColumn("inner", F.lead("key").over(own))
    firsts = ranks.filter("place = 1").select("range", F.col("key").alias("first_key"))
    over = Window.orderBy("range")
    # as many rows as the range shuffle had partitions
    firsts = firsts.select("range", F.coalesce(F.lead("first_key").over(over), F.first("first_key").over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("outer"))
    return ranks.join(F.broadcast(firsts), "range").select("key", "doc_id", "n", "copies", F.coalesce("inner", "outer").alias("next_key"))


def compare_with_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    The edited text has its last third replaced by the start of the next document in descending
    order of ids.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    key = F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.hex(F.xxhash64(whole)))
    rows = docs.select(F.col(doc_id).alias("doc_id"), whole.alias("text"), key.alias("key"))
    order = written(in_order(rows.select("key", "doc_id", F.length("text").alias("n"))), "next-ids")
    texts = rows.select("key", "text").repartition("key").dropDuplicates(["key"])
    wanted = order.select(F.col("next_key").alias("key"), F.col("key").alias("for_key"), F.floor(F.col("n") / 3).cast("int").alias("take"))
    starts = texts.join(wanted, "key").select(F.col("for_key").alias("key"), "take", F.substring(F.col("text"), F.lit(1), F.col("take")).alias("start"))
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - F.col("take")), F.col("start"))
    pairs = texts.join(starts, "key").select("key", "text", edited.alias("edited"))
    prints = fingerprints(pairs.withColumn("sha", F.sha2(F.col("edited").cast("binary"), 256)), ["key", "sha"], ["text", "edited"], samples)
    found = written(order.join(prints, "key"), "fingerprints")
    following = found.select(F.col("key").alias("next_key"), F.col("text_fp").alias("next_fp"))
    joined = found.join(following, "next_key").select(
        "doc_id", F.col("n").cast("long").alias("n_chars"), F.col("sha").alias("edited_sha256"), F.col("text_fp").alias("fingerprint"), F.col("edited_fp").alias("edited_fingerprint"),
        likeness(F.col("text_fp"), F.col("edited_fp"), samples).alias("near_edited"), likeness(F.col("text_fp"), F.col("next_fp"), samples).alias("near_next"), "copies",
    )
    return joined.withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("copies")
