"""Per-column profiles: one fused aggregate for all scalar statistics, one stacked frame of distinct values."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.text import cell_text, js_number, js_round, signature
from quern.operators.ranks import order_statistics

ENGINE = {"byte": "Integer", "short": "Integer", "integer": "Integer", "long": "Integer", "float": "Decimal", "double": "Decimal", "date": "DateTime", "timestamp": "DateTime", "timestamp_ntz": "DateTime"}


def engine_type(kind: T.DataType) -> str | None:
    """Integer, Decimal, DateTime or String; None for what is not a scalar."""
    if isinstance(kind, T.DecimalType):
        return "Decimal"
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.BinaryType)):
        return None
    return ENGINE.get(kind.typeName(), "String")


def engine_types(df: DataFrame) -> dict[str, str]:
    return {f.name: t for f in df.schema.fields if (t := engine_type(f.dataType))}


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c, t in engine_types(df).items() if t in ("Integer", "Decimal")]


def unpivoted(row: DataFrame, columns: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """A row a column from one wide row whose columns are named ``<column>|<field>``."""
    items = F.array(*(F.struct(F.lit(c).alias("column"), *(F.col(f"`{c}|{f}`").alias(f) for f in fields)) for c in columns))
    return row.select(F.inline(items))


def moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, rows, nonblank, sum, avg, stddev, skewness, min, max) of numeric columns, in one pass.

    The average of whole-number columns is rounded, halves up; the deviations are from the exact one.
    """
    types, aggs = engine_types(df), []
    for c in columns:
        x = F.col(c).cast("double")
        mean = F.avg(x)
        fields = {
            "rows": F.count(F.lit(1)), "nonblank": F.count(x), "sum": F.sum(x), "avg": js_round(mean).cast("double") if types[c] == "Integer" else mean,
            "stddev": F.stddev_pop(x), "skewness": F.coalesce(F.nanvl(F.skewness(x), F.lit(0.0)), F.lit(0.0)), "min": F.min(x), "max": F.max(x),
        }
        aggs += [v.alias(f"{c}|{k}") for k, v in fields.items()]
    return unpivoted(df.agg(*aggs), columns, ["rows", "nonblank", "sum", "avg", "stddev", "skewness", "min", "max"])


def stacked(df: DataFrame, columns: Sequence[str], order: str | None = None) -> DataFrame:
    """(column, value, at) rows of all cells: value in text form (blank is null), at the order key."""
    kinds = dict(df.dtypes)
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.nullif(cell_text(F.col(c), kinds[c]), F.lit("")).alias("value")) for c in columns))
    at = F.col(order).cast("long") if order else F.lit(0).cast("long")
    return df.select(F.explode(cells).alias("x"), at.alias("at")).select("x.*", "at")


def distinct_frame(df: DataFrame, columns: Sequence[str], order: str | None = None) -> DataFrame:
    """(column, value, n, first_at): every distinct value of every column, in one shuffle."""
    return stacked(df, columns, order).groupBy("column", "value").agg(F.count("*").alias("n"), F.min("at").alias("first_at"))


def blank_distinct(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, blank_count, distinct_count): blank counts as one value."""
    values = distinct_frame(df, columns)
    return values.groupBy("column").agg(F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("blank_count"), F.count("*").alias("distinct_count"))


def modal_share(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, modal_share, min_group) over nonblank values."""
    values = distinct_frame(df, columns).filter(F.col("value").isNotNull())
    return values.groupBy("column").agg((F.max("n") / F.sum("n")).alias("modal_share"), F.min("n").alias("min_group"))


def top_categories(df: DataFrame, columns: Sequence[str], order: str, k: int = 10) -> DataFrame:
    """(column, rank, value, n): most frequent values, ties by first appearance."""
    values = distinct_frame(df, columns, order).filter(F.col("value").isNotNull())
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.col("n").desc(), "first_at", "value"))
    return values.withColumn("rank", rank).filter(F.col("rank") <= k).select("column", "rank", "value", "n")


def quantiles(df: DataFrame, column: str, groups: Sequence[str] = ()) -> DataFrame:
    """Floor-index p05, p25, p75 and p95, for at least 8 values."""
    found = order_statistics(df, groups, column, {"p05": 0.05, "p25": 0.25, "p75": 0.75, "p95": 0.95})
    return found.filter("n >= 8")


def median(df: DataFrame, column: str, groups: Sequence[str] = ()) -> DataFrame:
    """(groups, n, median): rounded, halves up, for whole numbers."""
    found = order_statistics(df.withColumn(column, F.col(column).cast("double")), groups, column, {"median": 0.5}, "linear")
    return found.withColumn("median", js_round(F.col("median")).cast("double")) if engine_types(df)[column] == "Integer" else found


def precision(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, precision): most digits after the point of a number's text."""
    aggs = [F.coalesce(F.max(F.length(F.regexp_extract(js_number(F.col(c)), r"\.(\d+)$", 1))), F.lit(0)).alias(f"{c}|precision") for c in columns]
    return unpivoted(df.agg(*aggs), columns, ["precision"])


def average_length(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    kinds = dict(df.dtypes)
    return unpivoted(df.agg(*(F.avg(F.length(F.nullif(cell_text(F.col(c), kinds[c]), F.lit("")))).alias(f"{c}|avg_length") for c in columns)), columns, ["avg_length"])


def sorted_direction(df: DataFrame, column: str, order: str, ranges: int = 64) -> DataFrame:
    """(direction): asc, desc or none, by neighbours in row order.

    Rows are compared inside ranges of the order; a range's last row meets the next range's first
    through one row a range.
    """
    from quern.operators.ranks import ranged

    rows = ranged(df.filter(F.col(column).isNotNull()).select(F.col(order).alias("o"), F.col(column).alias("x")), [], "o", ranges)
    own = Window.partitionBy("__range").orderBy("o")
    inside = rows.withColumn("prev", F.lag("x").over(own)).groupBy("__range").agg(
        F.coalesce(F.bool_and(F.col("x") >= F.col("prev")), F.lit(True)).alias("up"), F.coalesce(F.bool_and(F.col("x") <= F.col("prev")), F.lit(True)).alias("down"),
        F.min_by("x", "o").alias("first"), F.max_by("x", "o").alias("last"), F.count("*").alias("n"),
    )
    joined = inside.withColumn("prev", F.lag("last").over(Window.orderBy("__range")))  # one row a range
    total = joined.agg(F.sum("n").alias("n"), F.bool_and(F.col("up") & F.coalesce(F.col("first") >= F.col("prev"), F.lit(True))).alias("up"), F.bool_and(F.col("down") & F.coalesce(F.col("first") <= F.col("prev"), F.lit(True))).alias("down"))
    return total.select(F.when(F.col("n") < 3, "none").when(F.col("up"), "asc").when(F.col("down"), "desc").otherwise("none").alias("direction"))


def format_signatures(df: DataFrame, columns: Sequence[str], floor: float = 0.70) -> DataFrame:
    """(column, format): the shape of at least ``floor`` of the distinct values that have one, else MIXED or OTHER."""
    values = distinct_frame(df, columns).filter(F.col("value").isNotNull()).select("column", "value", signature(F.col("value")).alias("sig"), F.length("value").alias("len"))
    by = values.filter(F.col("sig").isNotNull()).groupBy("column", "sig").agg(F.count("*").alias("n"), F.min("len").alias("short"), F.max("len").alias("long"))
    best = by.groupBy("column").agg(F.max_by(F.struct("sig", "short", "long"), F.struct("n", "sig")).alias("best"), F.max("n").alias("n"), F.sum("n").alias("classified"))
    fixed = (F.col("best.sig") == "ALL_UPPER") & (F.col("best.short") == F.col("best.long"))
    named = F.when(F.col("n") < floor * F.col("classified"), "MIXED").when(fixed, F.concat(F.lit("ALL_UPPER_FIXED_"), F.col("best.short").cast("string"))).otherwise(F.col("best.sig"))
    return values.select("column").distinct().join(best.select("column", named.alias("format")), "column", "left").select("column", F.coalesce("format", F.lit("OTHER")).alias("format"))


#: Pairs that make a two-valued column a flag, and words of a flag's name.
FLAG_PAIRS = (("false", "true"), ("no", "yes"), ("n", "y"), ("0", "1"), ("f", "t"))
FLAG_NAME = r"(?i)^(?:is|has)[_\p{L}\p{N}]|(?:default|churn|fraud|approv|convert|active|cancel|delinquen|flag|paid|win|pass|fail)"


def binary_flags(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, is_flag)."""
    values = distinct_frame(df, columns).filter(F.col("value").isNotNull()).withColumn("value", F.lower(F.trim("value")))
    # min and max of two values are both of them
    pairs = values.groupBy("column").agg(F.count("*").alias("d"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    fits = F.lit(False)
    for lo, hi in FLAG_PAIRS:
        fits = fits | ((F.col("lo") == lo) & (F.col("hi") == hi))
    return pairs.select("column", ((F.col("d") == 2) & (fits | F.col("column").rlike(FLAG_NAME))).alias("is_flag"))


def datetime_flags(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, date_with_time, time_of_day_only)."""
    aggs = []
    for c in columns:
        t = F.col(c).cast("timestamp")
        timed = t != F.date_trunc("day", t)
        aggs += [F.coalesce(F.bool_or(timed), F.lit(False)).alias(f"{c}|date_with_time"), (F.coalesce(F.bool_or(timed), F.lit(False)) & F.coalesce(F.bool_and(F.to_date(t) == F.lit("1899-12-30").cast("date")), F.lit(False))).alias(f"{c}|time_of_day_only")]
    return unpivoted(df.agg(*aggs), columns, ["date_with_time", "time_of_day_only"])


#: Fixed values of the nature rules.
DISCRETE_MAX, CONTINUOUS_DISTINCT, CONTINUOUS_RATIO, DENSE, AXIS_MAX = 12, 100, 0.30, 0.9, 120
#: Last words of names of identifiers, and words of names of ordered axes.
IDENTIFIER_WORDS = ("id", "ids", "uuid", "guid", "key", "zip", "zipcode", "postal", "postalcode", "ssn", "code", "codes", "sku", "isbn", "msisdn", "imei")
AXIS_WORDS = ("year", "month", "quarter", "week", "day", "hour", "rank", "level", "age", "grade", "rating", "step", "stage", "period")


def words_of(name: str) -> list[str]:
    """Words of a column name: camel case split, separators dropped, lower case."""
    split = re.sub(r"(?<=[^\W_A-Z])(?=[A-Z])", " ", unicodedata.normalize("NFC", name))
    return [w.lower() for w in re.findall(r"[^\W_]+", split)]


def is_identifier_name(name: str) -> bool:
    return words_of(name)[-1:] != [] and words_of(name)[-1] in IDENTIFIER_WORDS


def _axis_name(name: str) -> bool:
    return any(w in AXIS_WORDS for w in words_of(name))


def value_nature(name: str, distinct: int, nonblank: int, low: float, high: float, fractional: bool, measure: bool = False) -> str:
    """Continuous, Ordinal or Categorical: what a numeric column's values are."""
    if is_identifier_name(name) and not measure:
        return "Categorical"
    span = high - low + 1
    if span <= 0 or distinct / span >= DENSE:
        years, levels = 1900 <= low and high <= 2100, 0 <= low and high <= 20
        if years or levels or _axis_name(name) and distinct <= AXIS_MAX:
            return "Ordinal"
    if measure:
        return "Continuous"
    codes = not fractional and distinct == nonblank == span
    many = fractional or distinct >= CONTINUOUS_DISTINCT or nonblank and distinct / nonblank >= CONTINUOUS_RATIO
    return "Continuous" if distinct > DISCRETE_MAX and many and not codes else "Categorical"


def natures(df: DataFrame, columns: Sequence[str], measures: Sequence[str] = ()) -> DataFrame:
    """(column, nature): one row a column comes to the driver, where the rules are read."""
    types = engine_types(df)
    d = {r["column"]: r for r in distinct_frame(df, columns).filter(F.col("value").isNotNull()).groupBy("column").agg(F.count("*").alias("d"), F.sum("n").alias("n")).collect()}
    m = {r["column"]: r for r in moments(df, columns).collect()}
    rows = [(c, value_nature(c, d[c]["d"], d[c]["n"], m[c]["min"], m[c]["max"], types[c] == "Decimal", c in measures)) for c in columns if c in d]
    return df.sparkSession.createDataFrame(rows, "column string, nature string")


def profile(df: DataFrame, measures: Sequence[str] | None = None) -> DataFrame:
    """A row a column: types, roles, counts, moments and format; what is not a scalar is left out."""
    types = engine_types(df)
    numeric = [c for c, t in types.items() if t in ("Integer", "Decimal")]
    measures = [c for c in numeric if not is_identifier_name(c)] if measures is None else list(measures)
    base = df.sparkSession.createDataFrame([(k, c, t, c in measures) for k, (c, t) in enumerate(types.items())], "position int, column string, data_type string, is_measure boolean")
    columns = list(types)
    joined = base.join(F.broadcast(blank_distinct(df, columns)), "column", "left").join(F.broadcast(modal_share(df, columns)), "column", "left").join(F.broadcast(average_length(df, columns)), "column", "left")
    if numeric:
        joined = joined.join(F.broadcast(moments(df, numeric)), "column", "left")
    return joined.orderBy("position")


def free_text(format_: Column, average: Column) -> Column:
    return format_.isin("SENTENCE_TEXT", "TITLE_CASE_WORDS", "LOWER_WORDS", "MIXED") & (average >= 3)
