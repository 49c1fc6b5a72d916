"""Keyed filters, cross-filters, selections and shape tests, as predicates and semi-joins."""

from __future__ import annotations

import base64
import json
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A key position that any value fits.
ANY = object()
#: Keys up to this number become a predicate that reaches the scan; more are a semi-join.
INLINE_KEYS = 200


def key_predicate(columns: Sequence[str], keys: Sequence[Sequence]) -> Column:
    """True for rows whose tuple of ``columns`` is one of ``keys``; ``ANY`` fits everything, null is a value."""
    if len(columns) == 1 and all(k[0] is not ANY and k[0] is not None for k in keys):
        return F.coalesce(F.col(columns[0]).isin([k[0] for k in keys]), F.lit(False))
    one = [reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(v) for c, v in zip(columns, k, strict=True) if v is not ANY), F.lit(True)) for k in keys]
    return reduce(lambda a, b: a | b, one, F.lit(False))


@dataclass
class Filter:
    """Selected key tuples over named columns; inactive (no keys) keeps every row."""

    columns: tuple[str, ...]
    keys: list[tuple] = field(default_factory=list)
    group: str | None = None
    version: int = 0

    def set(self, keys: Sequence[Sequence]) -> bool:
        """Replace the keys, without repeats; False if nothing changes."""
        new = list(dict.fromkeys(tuple(k) for k in keys))
        if new == self.keys:
            return False
        self.keys, self.version = new, self.version + 1
        return True

    def clear(self) -> bool:
        return self.set([])

    def keep(self, df: DataFrame, on: Sequence[str] | None = None) -> DataFrame:
        columns = tuple(on or self.columns)
        if not self.keys:
            return df
        if len(self.keys) <= INLINE_KEYS or any(v is ANY for k in self.keys for v in k):
            return df.filter(key_predicate(columns, self.keys))
        names = [f"__k{i}" for i in range(len(columns))]
        fields = df.select(*columns).schema.fields
        wanted = df.sparkSession.createDataFrame(self.keys, ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, fields, strict=True)))
        return df.join(wanted, reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(n)) for c, n in zip(columns, names, strict=True))), "left_semi")

    def keep_any(self, df: DataFrame, columns: Sequence[str]) -> DataFrame:
        """A one-column filter applied to several columns: any of them may fit."""
        return df.filter(reduce(lambda a, b: a | b, (key_predicate([c], self.keys) for c in columns))) if self.keys else df

    def text(self) -> str:
        labels = [", ".join("any" if v is ANY else str(v) for v in k) for k in self.keys]
        return ", ".join(labels) if len(labels) <= 3 else f"{labels[0]}, {labels[1]} and {len(labels) - 2} more"


@dataclass
class Scope:
    """All filters of a page; rows must pass each active one."""

    filters: dict[str, Filter] = field(default_factory=dict)
    controls: dict = field(default_factory=dict)

    def keep(self, df: DataFrame) -> DataFrame:
        for f in self.filters.values():
            df = f.keep(df)
        return df

    def pick(self, name: str, keys: Sequence[Sequence]) -> None:
        """Set one filter and clear the others of its group."""
        own = self.filters[name]
        own.set(keys)
        for other_name, other in self.filters.items():
            if other_name != name and own.group is not None and other.group == own.group:
                other.clear()

    def text(self) -> str:
        return "; ".join(f"{', '.join(f.columns)}: {f.text()}" for f in self.filters.values() if f.keys)

    def token(self) -> str:
        """The view as text for a link."""
        state = {"f": {k: [["*" if v is ANY else {"v": v} for v in key] for key in f.keys] for k, f in self.filters.items() if f.keys}, "c": self.controls}
        return base64.urlsafe_b64encode(json.dumps(state, sort_keys=True, default=str).encode()).decode().rstrip("=")

    def restore(self, token: str) -> bool:
        """Take over a token's view; False and no change if it cannot be read."""
        try:
            state = json.loads(base64.urlsafe_b64decode(token + "=" * (-len(token) % 4)))
            found = {k: [tuple(ANY if v == "*" else v["v"] for v in key) for key in keys] for k, keys in state["f"].items()}
            controls = dict(state["c"])
        except (ValueError, KeyError, TypeError, AttributeError):
            return False
        for k, f in self.filters.items():
            f.set(found.get(k, []))
        self.controls = controls
        return True


def label_key(df: DataFrame, picked: Column, columns: Sequence[str]) -> DataFrame:
    """(column, value, fixed): a column is fixed if the picked rows share its value and the table does not."""
    aggs = []
    for c in columns:
        aggs += [F.min(F.when(picked, F.col(c))).alias(f"lo_{c}"), F.max(F.when(picked, F.col(c))).alias(f"hi_{c}"), (F.min(c) == F.max(c)).alias(f"same_{c}")]
    row = df.agg(*aggs)
    items = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"lo_{c}").cast("string").alias("value"), ((F.col(f"lo_{c}") == F.col(f"hi_{c}")) & ~F.col(f"same_{c}")).alias("fixed")) for c in columns))
    return row.select(F.inline(items)).select("column", F.when(F.col("fixed"), F.col("value")).alias("value"), "fixed")


def narrowed(current: DataFrame, whole: DataFrame) -> DataFrame:
    """(rows, high_water, is_narrowed, is_emptied)."""
    both = current.agg(F.count("*").alias("rows")).crossJoin(whole.agg(F.count("*").alias("high_water")))  # one row each
    return both.select("rows", "high_water", ((F.col("rows") < F.col("high_water")) & (F.col("rows") > 0)).alias("is_narrowed"), ((F.col("rows") == 0) & (F.col("high_water") > 0)).alias("is_emptied"))


def crossfilter(members: dict[str, DataFrame], publisher: str, selection: DataFrame, key: str) -> dict[str, DataFrame]:
    """What each member shows after ``publisher`` selects the rows of ``selection``; it never filters itself."""
    return {k: df if k == publisher else df.join(selection.select(key).distinct(), key, "left_semi") for k, df in members.items()}


def next_selection(current: Sequence[int], rows: Sequence[int], toggle: bool) -> list[int]:
    """A click replaces the selection, or clears it if it is the same; a toggling click flips each row."""
    now, new = list(dict.fromkeys(current)), list(dict.fromkeys(rows))
    if toggle:
        return [r for r in now if r not in set(new)] + [r for r in new if r not in set(now)]
    return [] if set(now) == set(new) else new


def next_selection_columns(current: Column, rows: Column, toggle: bool) -> Column:
    """The same over array columns, sorted."""
    if toggle:
        return F.array_sort(F.array_union(F.array_except(current, rows), F.array_except(rows, current)))
    same = (F.size(F.array_except(current, rows)) == 0) & (F.size(F.array_except(rows, current)) == 0)
    return F.when(same, F.array().cast("array<bigint>")).otherwise(F.array_sort(F.array_distinct(rows)))


def valid_rows(rows: DataFrame, column: str, most: int = 250_000) -> DataFrame:
    """Distinct row numbers that are whole and not negative, the first ``most``: a selection's limit."""
    x = F.col(column)
    fits = (x >= 0) & (x <= 9_007_199_254_740_991) & (x == F.floor(x))
    return rows.filter(fits).select(x.cast("long").alias(column)).distinct().orderBy(column).limit(most)


def inside_polygon(x: Column, y: Column, vertices: Sequence[tuple[float, float]]) -> Column:
    """Even-odd rule, after a test of the bounding box; a column expression, so it runs in generated code."""
    xs, ys = zip(*vertices, strict=True)
    crossings = F.lit(0)
    for (x0, y0), (x1, y1) in zip(vertices, [*vertices[1:], vertices[0]], strict=True):
        if y0 != y1:
            spans = (F.lit(float(y0)) > y) != (F.lit(float(y1)) > y)
            crossings = crossings + (spans & (x < (x1 - x0) * (y - y0) / (y1 - y0) + x0)).cast("int")
    return x.between(min(xs), max(xs)) & y.between(min(ys), max(ys)) & (crossings % 2 == 1)


def search_tiers(df: DataFrame, term: str, name: str, description: str) -> DataFrame:
    """Rows of the first tier that any row is in: a word of the name starts so, the name has it, a word of the description starts so."""
    if len(term.strip()) < 2:
        return df
    wanted = "".join(f"\\{c}" if not c.isalnum() else c for c in term.strip().lower())
    start = rf"(?<![\p{{L}}\p{{M}}\p{{N}}]){wanted}"
    tier = F.when(F.lower(name).rlike(start), 1).when(F.contains(F.lower(F.col(name)), F.lit(term.strip().lower())), 2).when(F.lower(description).rlike(start), 3)
    ranked = df.withColumn("__tier", tier).filter("__tier IS NOT NULL")
    best = ranked.agg(F.min("__tier").alias("__best"))
    return ranked.crossJoin(F.broadcast(best)).filter("__tier = __best").drop("__tier", "__best")  # one row


def selection_card(df: DataFrame, selected: Column, measures: Sequence[tuple[str, str]], dims: Sequence[str]) -> DataFrame:
    """One row: for each (measure, aggregation) the selected value, and its share of the total where that is additive and positive; for each dimension its distinct selected count and its only value."""
    aggs = [F.count_if(selected).alias("rows_selected"), F.count("*").alias("rows_total")]
    for m, kind in measures:
        x = F.when(selected, F.col(m))
        value = reduce_kind(x, kind)
        aggs.append(value.alias(f"{m}_{kind}"))
        if kind in ("sum", "count"):
            whole = reduce_kind(F.col(m), kind)
            aggs.append(F.when(whole > 0, F.try_divide(value, whole) * 100).alias(f"{m}_{kind}_pct"))
    for d in dims:
        x = F.when(selected, F.col(d))
        aggs += [F.countDistinct(x).alias(f"{d}_distinct"), F.when(F.min(x) == F.max(x), F.min(x)).alias(f"{d}_only")]
    return df.agg(*aggs)


def reduce_kind(x: Column, kind: str, order: Column | None = None) -> Column:
    """The eight aggregations; a distinct count counts null as a value."""
    if kind == "first":
        return F.min_by(x, order)
    if kind == "distinctcount":
        return F.countDistinct(x) + F.max(x.isNull().cast("int"))
    return {"sum": F.sum, "average": F.avg, "median": F.median, "min": F.min, "max": F.max, "count": F.count}[kind](x)


#: Names of aggregations and what they mean.
AGGREGATIONS = {
    "sum": "sum", "total": "sum", "avg": "average", "average": "average", "mean": "average", "median": "median", "min": "min", "minimum": "min", "max": "max", "maximum": "max",
    "count": "count", "distinctcount": "distinctcount", "countdistinct": "distinctcount", "distinct": "distinctcount", "first": "first",
}


def normal_aggregation(name: str) -> str | None:
    return AGGREGATIONS.get("".join(c for c in name.lower() if c.isalpha()))


def rank_of_rows(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(*order))
