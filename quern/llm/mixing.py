"""Mixing sources to target weights.

Sizes are counted in words. The sources' shares come from weights by water-filling; each source's
rows get hash-random keys, are sorted by key within the source, and a running sum of sizes decides
which are taken: whole epochs first, then documents in key order until the exact budget is met.

The running sum is distributed: a source's keys fall in equal ranges, a sum per range is carried
over the ranges, and rows are summed within their range only. The number of ranges follows the
number of rows, so a source with a third of all rows is dealt over as many tasks as the rest.

Only DataFrame functions are used. Reruns agree: keys hash the id, and ties are ordered by size.

Defined cases: a null text has size 0; a null source is a source, the last; sources without words
get target 0; repeated rows are separate documents with the same key, taken one after the other;
very long texts are counted and cut whole; ties of the key are ordered by id and size; an empty
table gives no row; an id may be null. Columns other than those named are not read by :func:`mix`;
:func:`mixed` keeps all, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import free, written

WORD = r"[^\x20\x09-\x0D]+"
#: Rows that a range of keys holds on average.
RANGE_ROWS = 20_000
#: A source gives at most so many epochs.
EPOCHS = 3


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, source_size, rows), a row a source.

    Weights 1, 2, 3 repeat over the sources by code point, null last. Water-filling: sources in
    order of the level at which they are full (``epochs * size / weight``); all that is left after
    the full ones is shared by weight. Levels rise up to the first that its source can hold, and
    fall after it; that one is final.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("weight", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("long")).withColumn("full", F.col("source_size") * epochs)
    by_level = Window.orderBy((F.col("full") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    level = (total - F.coalesce(F.sum("full").over(before), F.lit(0))).cast("double") / F.sum("weight").over(after)
    levels = ranked.withColumn("level", level)
    holds = F.col("full") >= F.col("level") * F.col("weight")
    final = F.max(F.when(holds, F.col("level"))).over(Window.partitionBy())
    return levels.withColumn("final", final).select("source", "source_size", F.when(F.col("full") >= F.col("final") * F.col("weight"), F.col("final") * F.col("weight")).otherwise(F.col("full").cast("double")).alias("target"))


def sized(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 7) -> DataFrame:
    """(doc_id, source, size, key): the narrow table that all decisions are made on."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), words(F.col(text)).alias("size"), F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null")))).alias("key"))


def mix(rows: DataFrame, epochs: int = EPOCHS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(doc_id, source, size, key, source_size, target, taken) for rows of :func:`sized`."""
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    plan = targets(sources, epochs).join(sources.select(F.col("source").alias("s"), "rows"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    # equal ranges of the key's first 32 bits: as many as the source has rows for
    share = F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / float(1 << 32)
    plan = written(plan.withColumn("ranges", F.greatest(F.lit(1), F.ceil(F.col("rows") / range_rows)).cast("long")).withColumnRenamed("source", "s"), "mix-plan")
    # a row a source: Spark joins it by broadcast only if its size allows, else splits hot sources
    placed = rows.join(plan, F.col("source").eqNullSafe(F.col("s"))).withColumn("range", F.floor(share * F.col("ranges")))
    placed = placed.drop("s", "rows", "ranges")
    sums = placed.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    carried = F.coalesce(F.sum("range_size").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    carried = sums.select(F.col("source").alias("s"), F.col("range").alias("r"), carried.alias("carried"))
    own = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = placed.join(carried, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r"))).drop("s", "r")
    summed = joined.withColumn("upto", F.col("carried") + F.sum("size").over(own))
    budget = F.floor(F.col("target") + 0.5).cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - whole * F.col("source_size")
    cut = F.least(F.col("size"), F.greatest(F.lit(0).cast("long"), rest - (F.col("upto") - F.col("size"))))
    return summed.withColumn("taken", whole * F.col("size") + cut).select("doc_id", "source", "size", "key", "source_size", "target", "taken")


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 7, epochs: int = EPOCHS) -> DataFrame:
    """The mix itself, with the columns of ``docs``: each document as often as it is taken.

    Of a document at the cut, the first words up to the budget are kept, with the white space
    between them. Documents of which nothing is taken (also those without words) do not appear.
    Rows that share an id and source take their shares together, as one document repeated.
    """
    id_, source_, size_, taken_, copies_, words_, turn_ = free(docs, "__id", "__source", "__size", "__taken", "__copies", "__words", "__turn")
    rows = written(sized(docs, doc_id, text, source, seed), "mix-sizes")
    found = mix(rows, epochs).groupBy(F.col("doc_id").alias(id_), F.col("source").alias(source_), F.col("size").alias(size_)).agg(F.sum("taken").alias(taken_), F.count("*").alias(copies_))
    found = found.filter(F.col(taken_) > 0).withColumn(taken_, F.ceil(F.col(taken_) / F.col(copies_)).cast("long"))
    marked = docs.withColumn(words_, words(F.col(text)))
    joined = marked.join(found, F.col(doc_id).eqNullSafe(F.col(id_)) & F.col(source).eqNullSafe(F.col(source_)) & (F.col(words_) == F.col(size_)))
    whole = F.floor(F.col(taken_) / F.col(size_)).cast("int")
    rest = (F.col(taken_) % F.col(size_)).cast("int")
    turns = F.concat(F.array_repeat(F.lit(-1), whole), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<int>")))
    # the text up to the end of word number ``turn_``
    pieces = F.regexp_extract_all(F.col(text), F.lit(r"[\x20\x09-\x0D]*" + WORD), 0)
    cut = F.array_join(F.slice(pieces, F.lit(1), F.greatest(F.col(turn_), F.lit(1))), "")
    out = [F.when(F.col(turn_) < 0, F.col(text)).otherwise(cut).alias(text) if c == text else F.col(c) for c in docs.columns]
    return joined.withColumn(turn_, F.explode(turns)).select(*out)


#: DuckDB form of the whole result with the default seed and epochs.
ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('7:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS weight, source_size * 3 AS filled FROM s),
l AS (SELECT *, CAST((SELECT sum(source_size) FROM s) - coalesce(sum(filled) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
             / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
      FROM w WINDOW o AS (ORDER BY CAST(filled AS DOUBLE) / weight, source ASC NULLS LAST)),
f AS (SELECT max(level) AS final FROM l WHERE filled >= level * weight),
t AS (SELECT source, source_size, CASE WHEN filled >= final * weight THEN final * weight ELSE CAST(filled AS DOUBLE) END AS target FROM l, f),
u AS (SELECT d.*, t.source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS budget,
             sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
v AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS whole FROM u)
SELECT doc_id, size, source_size, target,
       CAST(whole * size + least(size, greatest(0, budget - whole * source_size - (upto - size))) AS BIGINT) AS taken
FROM v
"""
