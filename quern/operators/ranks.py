"""Exact positions, running sums and order statistics without a one-task sort.

A global window would sort a whole table in one task. Here values fall in ranges whose bounds are
approximate quantiles; sums per range are carried over the ranges, and rows are ordered within
their range only. Bounds only balance the work: results are exact whatever they are.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that a group's values are dealt over.
RANGES = 64
ACCURACY = 1000


def _range_of(value: Column, bounds: Column) -> Column:
    return F.size(F.filter(bounds, lambda b: b < value))


def ranged(df: DataFrame, groups: Sequence[str], value: str, ranges: int = RANGES) -> DataFrame:
    """``df`` with ``__range``: where ``value`` stands among approximate quantiles of its group."""
    fractions = [k / ranges for k in range(1, ranges)]
    keys = [F.col(g).alias(f"__g{k}") for k, g in enumerate(groups)]
    bounds = df.groupBy(*keys).agg(F.percentile_approx(value, F.array(*map(F.lit, fractions)), ACCURACY).alias("__bounds"))
    on = F.lit(True)
    for k, g in enumerate(groups):
        on = on & F.col(g).eqNullSafe(F.col(f"__g{k}"))
    joined = df.crossJoin(F.broadcast(bounds)) if not groups else df.join(bounds, on)  # without groups: one row
    return joined.withColumn("__range", _range_of(F.col(value), F.coalesce("__bounds", F.array().cast(dict(df.dtypes)[value].join(("array<", ">")))))).drop("__bounds", *(f"__g{k}" for k in range(len(groups))))


def running_sum(df: DataFrame, groups: Sequence[str], value: str, amount: str, name: str, ranges: int = RANGES) -> DataFrame:
    """``df`` with ``name``: the sum of ``amount`` over all rows of the group up to ``value``, in its order."""
    dealt = ranged(df, groups, value, ranges)
    sums = dealt.groupBy(*groups, "__range").agg(F.sum(amount).alias("__sum"))
    before = Window.partitionBy(*groups).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    keys = [F.col(g).alias(f"__g{k}") for k, g in enumerate(groups)]
    carried = sums.select(*keys, F.col("__range").alias("__r"), F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__carried"))
    own = Window.partitionBy(*groups, "__range").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    on = F.col("__range") == F.col("__r")
    for k, g in enumerate(groups):
        on = on & F.col(g).eqNullSafe(F.col(f"__g{k}"))
    joined = dealt.withColumn("__own", F.sum(amount).over(own)).join(carried, on)
    return joined.withColumn(name, F.col("__own") + F.col("__carried")).drop("__own", "__range", "__r", "__carried", *(f"__g{k}" for k in range(len(groups))))


def in_turn(first: Column, second: Column) -> Column:
    """One key that orders as two whole numbers in turn: exact for any ``second`` and for ``first`` within 18 digits."""
    return first.cast("decimal(18,0)") * F.lit(Decimal(2 * 10**19)) + second.cast("decimal(20,0)")


def with_row_index(df: DataFrame, key: str, name: str = "__row_idx__", ranges: int = RANGES) -> DataFrame:
    """``df`` with its rows' positions in the order of the unique column ``key``, from 0."""
    counted = running_sum(df.withColumn("__one", F.lit(1).cast("long")), [], key, "__one", name, ranges)
    return counted.withColumn(name, F.col(name) - 1).drop("__one")


def order_statistics(df: DataFrame, groups: Sequence[str], value: str, fractions: dict[str, float], kind: str = "floor", ranges: int = RANGES) -> DataFrame:
    """``groups``, ``n`` (non-null values) and a column for each fraction.

    ``floor``: the value at position floor((n - 1) p) of the sorted values. ``linear``: between the
    two values next to position (n - 1) p. The median is ``linear`` at one half.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count("*").alias("__n"))
    sums = running_sum(counts, groups, value, "__n", "__upto", ranges)
    totals = counts.groupBy(*groups).agg(F.sum("__n").alias("n"))
    on = F.lit(True)
    for g in groups:
        on = on & F.col(f"c.{g}").eqNullSafe(F.col(f"t.{g}"))
    placed = sums.alias("c").join(F.broadcast(totals) if not groups else totals.alias("t"), on) if groups else sums.crossJoin(F.broadcast(totals))
    placed = placed.select(*(F.col(f"c.{g}").alias(g) for g in groups), F.col(value).alias("v"), F.col("__upto").alias("upto"), (F.col("__upto") - F.col("__n")).alias("before"), "n")

    def at(position: Column) -> Column:
        return F.max(F.when((F.col("before") <= position) & (position < F.col("upto")), F.col("v")))

    aggs = []
    for name, p in fractions.items():
        position = (F.col("n") - 1) * F.lit(p)
        aggs.append(at(F.floor(position)).alias(f"lo_{name}"))
        if kind == "linear":
            aggs += [at(F.ceil(position)).alias(f"hi_{name}"), F.max(position - F.floor(position)).alias(f"w_{name}")]
    found = placed.groupBy(*groups).agg(F.max("n").alias("n"), *aggs)
    return found.select(*groups, "n", *(F.col(f"lo_{k}").alias(k) if kind == "floor" else (F.col(f"lo_{k}") + (F.col(f"hi_{k}") - F.col(f"lo_{k}")) * F.col(f"w_{k}")).alias(k) for k in fractions))
