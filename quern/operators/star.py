"""Star-schema queries: dimension joins, role maps, measures, roll-ups."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A dimension up to this many rows is broadcast; larger ones are left to the planner.
BROADCAST_ROWS = 100_000


def small(dim: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``dim`` marked for broadcast if a look at ``most`` + 1 of its rows shows that it is small."""
    return F.broadcast(dim) if dim.limit(most + 1).count() <= most else dim


def join_dims(fact: DataFrame, dims: Sequence[tuple[DataFrame, str, str]]) -> DataFrame:
    """Many-to-one left joins of (dimension, fact key, dimension key)."""
    for dim, fk, pk in dims:
        fact = fact.join(small(dim), fact[fk] == dim[pk], "left")
    return fact


def ratio(a: str, b: str) -> Column:
    """Sum over sum; null over zero."""
    return F.try_divide(F.sum(a), F.sum(b))


def weighted_average(x: str, weight: str) -> Column:
    return F.try_divide(F.sum(F.col(x) * F.col(weight)), F.sum(weight))


@dataclass
class Role:
    """What a role stands for: a column of the joined star, or a measure over it."""

    column: str | None = None
    measure: Callable[[], Column] | None = None


@dataclass
class QueryDef:
    roles: Sequence[str]
    selects: Sequence[str] = ()  # roles whose own filter does not apply


class MissingRoles(ValueError):
    pass


def build_query(star: DataFrame, definition: QueryDef, roles: dict[str, Role], filters: dict[str, Sequence] | None = None) -> DataFrame:
    """Group by the column roles, aggregate the measure roles, after filtering by other roles' values."""
    missing = [r for r in definition.roles if r not in roles]
    if missing:
        raise MissingRoles(f"no mapping for: {', '.join(missing)}")
    for r, values in (filters or {}).items():
        if r in roles and roles[r].column and r not in definition.selects and values:
            star = star.filter(F.col(roles[r].column).isin(list(values)))
    columns = [r for r in definition.roles if roles[r].column]
    measures = [r for r in definition.roles if roles[r].measure]
    return star.groupBy(*(F.col(roles[r].column).alias(r) for r in columns)).agg(*(roles[r].measure().alias(r) for r in measures)).orderBy(*columns)


def semi_additive(df: DataFrame, by: Sequence[str], period: Column, value: str, name: str) -> DataFrame:
    """Average over periods of each period's sum."""
    return df.groupBy(*by, period.alias("__p")).agg(F.sum(value).alias("__s")).groupBy(*by).agg(F.avg("__s").alias(name))


def prior_year(points: DataFrame, by: Sequence[str], month: str, value: str) -> DataFrame:
    """``points`` with prior, change and change_pct: the value of the same month a year before, null where there is none."""
    before = points.select(*by, F.add_months(month, 12).alias(month), F.col(value).alias("prior"))
    joined = points.join(before, [*by, month], "left")
    change = F.col(value) - F.col("prior")
    return joined.withColumn("change", change).withColumn("change_pct", F.try_divide(change, F.col("prior")))


def rollup_total(df: DataFrame, dims: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    """Body rows and one grand total, told apart by ``is_total``."""
    return df.groupingSets([list(dims), []], *dims).agg(*aggs, (F.grouping_id() > 0).alias("is_total"))


def split_rollup(df: DataFrame, flags: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(body, total) of a result with roll-up flags; rows with some flags set and some not raise an error."""
    n = sum((F.col(f).cast("int") for f in flags[1:]), F.col(flags[0]).cast("int"))
    mixed = F.when((n > 0) & (n < len(flags)), F.raise_error(F.lit("subtotals are not supported")).cast("boolean")).otherwise(F.lit(True))
    checked = df.filter(mixed)
    return checked.filter(n == 0).drop(*flags), checked.filter(n == len(flags)).drop(*flags)


@dataclass
class QueryCache:
    """Least recently used results by (prefix, query, options); only successes are kept."""

    size: int = 256
    entries: dict = field(default_factory=dict)
    hits: int = 0

    def get(self, prefix: str, query: str, options: dict, execute: Callable[[], DataFrame], bypass: bool = False) -> DataFrame:
        key = "\0".join((prefix, query, repr(sorted(options.items()))))
        if not bypass and key in self.entries:
            self.hits += 1
            self.entries[key] = self.entries.pop(key)
            return self.entries[key]
        found = execute()
        self.entries.pop(key, None)
        self.entries[key] = found
        while len(self.entries) > self.size:
            self.entries.pop(next(iter(self.entries)))
        return found

    def invalidate(self, prefix: str) -> int:
        gone = [k for k in self.entries if k.split("\0", 1)[0] == prefix]
        for k in gone:
            del self.entries[k]
        return len(gone)
