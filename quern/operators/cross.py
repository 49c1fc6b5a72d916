"""Cross-column statistics."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.profile import distinct_frame, unpivoted
from quern.operators.ranks import order_statistics, running_sum


def relative_dispersion(df: DataFrame, measure: str) -> DataFrame:
    """(n, dispersion): (p90 - p10) / |median|, 3 decimals; 0 for a constant, null for a median near 0 or under 4 values."""
    q = order_statistics(df.select(F.col(measure).cast("double").alias("x")), [], "x", {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p90": 0.9, "p100": 1.0}, "linear")
    value = F.when(F.col("n") < 4, None).when(F.col("p0") == F.col("p100"), 0.0).when(F.abs("p50") > 1e-12, F.floor((F.col("p90") - F.col("p10")) / F.abs("p50") * 1000 + 0.5) / 1000)
    return q.select("n", value.alias("dispersion"))


def nonblank_groups(df: DataFrame, dims: Sequence[str], measure: str) -> DataFrame:
    """(dim, groups, nonblank_groups) for each dimension, in one pass over (dim, value)."""
    cells = F.explode(F.array(*(F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("value")) for d in dims)))
    by = df.select(cells.alias("x"), F.col(measure).isNotNull().alias("has")).groupBy("x.dim", "x.value").agg(F.bool_or("has").alias("has"))
    return by.groupBy("dim").agg(F.count("*").alias("groups"), F.count_if(F.col("has")).alias("nonblank_groups"))


def eta_squared(df: DataFrame, dims: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """(dim, measure, eta2): between-group over total sum of squares, 4 decimals.

    Sums per group combine before the shuffle; all pairs share one pass. Means are taken off the
    first pass' totals, so large offsets do not cancel digits.
    """
    cells = F.explode(F.array(*(F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("value"), F.lit(m).alias("measure"), F.col(m).cast("double").alias("x")) for d in dims for m in measures)))
    by = df.select(cells.alias("c")).select("c.*").filter(F.col("x").isNotNull() & F.col("value").isNotNull()).groupBy("dim", "measure", "value").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.var_pop("x").alias("var"))
    whole = Window.partitionBy("dim", "measure")
    centred = by.withColumn("all", F.sum(F.col("n") * F.col("mean")).over(whole) / F.sum("n").over(whole))
    sums = centred.groupBy("dim", "measure").agg(F.sum(F.col("n") * F.pow(F.col("mean") - F.col("all"), 2)).alias("between"), F.sum(F.col("n") * F.col("var")).alias("within"))
    total = F.col("between") + F.col("within")
    return sums.filter(total > 1e-12).select("dim", "measure", (F.floor(F.col("between") / total * 10000 + 0.5) / 10000).alias("eta2"))


def spread_ratio(df: DataFrame, dim: str, measure: str) -> DataFrame:
    """(spread_ratio): largest less smallest group IQR over the overall IQR (floor-index quartiles, groups of 4 and more)."""
    rows = df.select(F.col(dim).alias("g"), F.col(measure).cast("double").alias("x")).filter(F.col("x").isNotNull())
    fractions = {"q1": 0.25, "q3": 0.75}
    groups = order_statistics(rows, ["g"], "x", fractions).filter("n >= 4").agg(F.max(F.col("q3") - F.col("q1")).alias("hi"), F.min(F.col("q3") - F.col("q1")).alias("lo"), F.count("*").alias("k"))
    overall = order_statistics(rows, [], "x", fractions).select((F.col("q3") - F.col("q1")).alias("iqr"))
    return groups.crossJoin(F.broadcast(overall)).select(F.when((F.col("k") >= 2) & (F.col("iqr") > 0), (F.col("hi") - F.col("lo")) / F.col("iqr")).alias("spread_ratio"))  # one row each


def correlations(df: DataFrame, measures: Sequence[str], top: int = 8) -> DataFrame:
    """(measure, other, r, rank): Pearson over rows that have both, at least 5; the strongest ``top`` of each."""
    aggs = []
    for a, b in combinations(measures, 2):
        x, y = (F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.col(c).cast("double")) for c in (a, b))
        aggs += [F.corr(x, y).alias(f"{a}~{b}|r"), F.count(x).alias(f"{a}~{b}|n")]
    pairs = [f"{a}~{b}" for a, b in combinations(measures, 2)]
    found = unpivoted(df.agg(*aggs), pairs, ["r", "n"]).filter("n >= 5 AND r IS NOT NULL AND NOT isnan(r)")
    found = found.select(F.split("column", "~").alias("p"), "r")
    both = found.select(F.inline(F.array(F.struct(F.col("p")[0].alias("measure"), F.col("p")[1].alias("other"), "r"), F.struct(F.col("p")[1].alias("measure"), F.col("p")[0].alias("other"), "r"))))
    rank = F.row_number().over(Window.partitionBy("measure").orderBy(F.abs("r").desc(), "other"))
    return both.withColumn("rank", rank).filter(F.col("rank") <= top)


def shared_values(df: DataFrame, dims: Sequence[str], cap: int = 2000) -> DataFrame:
    """(a, b, shared_pct): share of a's distinct values that b has too; columns with more than ``cap`` are left out."""
    values = distinct_frame(df, dims).filter(F.col("value").isNotNull()).select("column", "value")
    sizes = values.groupBy("column").agg(F.count("*").alias("d")).filter(F.col("d") <= cap)
    small = values.join(F.broadcast(sizes), "column")
    other = small.select(F.col("column").alias("b"), "value")
    pairs = small.join(other, "value").filter("column <> b").groupBy(F.col("column").alias("a"), "b").agg(F.count("*").alias("n"), F.first("d").alias("d"))
    return pairs.select("a", "b", F.floor(100.0 * F.col("n") / F.col("d") + 0.5).cast("int").alias("shared_pct")).filter("shared_pct > 0")


def pair_counts(df: DataFrame, dims: Sequence[str]) -> DataFrame:
    """(a, b, va, vb, n): cells of all pairs of dimensions, in one shuffle."""
    cells = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).cast("string").alias("va"), F.col(b).cast("string").alias("vb")) for a, b in combinations(dims, 2))))
    return df.select(cells.alias("c")).select("c.*").filter("va IS NOT NULL AND vb IS NOT NULL").groupBy("a", "b", "va", "vb").agg(F.count("*").alias("n"))


def pair_stats(df: DataFrame, dims: Sequence[str]) -> DataFrame:
    """(a, b, combinations, card_a, card_b, fill_pct, a_determines_b, b_determines_a, min_cell)."""
    cells = pair_counts(df, dims)
    sizes = cells.groupBy("a", "b").agg(F.count("*").alias("combinations"), F.countDistinct("va").alias("card_a"), F.countDistinct("vb").alias("card_b"), F.min("n").alias("min_cell"))
    fill = F.floor(100.0 * F.col("combinations") / (F.col("card_a") * F.col("card_b")) + 0.5).cast("int")
    return sizes.select("a", "b", "combinations", "card_a", "card_b", fill.alias("fill_pct"), (F.col("combinations") == F.col("card_a")).alias("a_determines_b"), (F.col("combinations") == F.col("card_b")).alias("b_determines_a"), "min_cell")


def nesting_parents(df: DataFrame, dims: Sequence[str]) -> DataFrame:
    """(child, parent, nesting_ratio): of the columns that a column determines, the one with fewest values."""
    s = pair_stats(df, dims)
    ways = s.filter("a_determines_b AND card_b < card_a").select(F.col("a").alias("child"), F.col("b").alias("parent"), F.col("card_a").alias("c"), F.col("card_b").alias("p"))
    ways = ways.union(s.filter("b_determines_a AND card_a < card_b").select("b", "a", "card_b", "card_a"))
    best = ways.groupBy("child").agg(F.min(F.struct("p", "parent", "c")).alias("best"))
    return best.select("child", F.col("best.parent").alias("parent"), (F.floor(F.col("best.p") / F.col("best.c") * 100 + 0.5) / 100).alias("nesting_ratio"))


def determined(df: DataFrame, child: str, parents: Sequence[str], keep: int = 6) -> DataFrame:
    """(parent, distinct_count) of the columns that ``child`` determines row by row, coarsest ``keep``."""
    aggs = [F.min(p).alias(f"lo_{p}") for p in parents] + [F.max(p).alias(f"hi_{p}") for p in parents]
    by = df.groupBy(child).agg(*aggs, F.count("*").alias("rows"))
    one = by.agg(*(F.bool_and(F.col(f"lo_{p}").eqNullSafe(F.col(f"hi_{p}"))).alias(f"{p}|fits") for p in parents), *(F.approx_count_distinct(f"lo_{p}").alias(f"{p}|rough") for p in parents), F.max("rows").alias("most"))
    sizes = unpivoted(df.agg(*(F.countDistinct(p).alias(f"{p}|distinct_count") for p in parents)), parents, ["distinct_count"])
    fits = unpivoted(one, parents, ["fits"]).filter("fits")
    rank = F.row_number().over(Window.orderBy("distinct_count", "column"))  # a row a parent
    return fits.join(F.broadcast(sizes), "column").withColumn("rank", rank).filter(F.col("rank") <= keep).select(F.col("column").alias("parent"), "distinct_count")


def constant_sum(df: DataFrame, columns: Sequence[str], order: str, rows: int = 500, share: float = 0.95, tolerance: float = 0.01, least_part: float = 0.05) -> DataFrame:
    """(columns, median_sum, match_share): the largest set of 3 to 6 columns whose row sums are nearly constant.

    All sets are tried in two aggregates over the first ``rows`` rows.
    """
    columns = list(columns)[:8]
    head = df.orderBy(order).limit(rows).select(*(F.col(c).cast("double").alias(c) for c in columns)).filter(reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in columns)))
    sets = [s for k in range(min(6, len(columns)), 2, -1) for s in combinations(columns, k)]
    total = {s: reduce(lambda a, b: a + b, (F.col(c) for c in s)) for s in sets}
    middle = head.agg(F.count("*").alias("n"), *(F.median(total[s]).alias(f"m{k}") for k, s in enumerate(sets)), *(F.sum(c).alias(f"s_{c}") for c in columns))
    tested = head.crossJoin(F.broadcast(middle))  # one row
    aggs = [F.avg((F.abs(total[s] - F.col(f"m{k}")) <= tolerance * F.abs(F.col(f"m{k}"))).cast("int")).alias(f"r{k}") for k, s in enumerate(sets)]
    parts = [F.first(reduce(F.least, [F.col(f"s_{c}") for c in s]) / reduce(lambda a, b: a + b, (F.col(f"s_{c}") for c in s))).alias(f"p{k}") for k, s in enumerate(sets)]
    found = tested.agg(F.first("n").alias("n"), *aggs, *parts, *(F.first(f"m{k}").alias(f"m{k}") for k in range(len(sets))))
    options = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(",".join(s)).alias("columns"), F.col(f"m{k}").alias("median_sum"), F.col(f"r{k}").alias("match_share"), F.col(f"p{k}").alias("part")) for k, s in enumerate(sets)))
    best = F.get(F.filter(options, lambda o: (o["match_share"] >= share) & (o["part"] >= least_part)), F.lit(0))
    return found.filter("n >= 8").select(best.alias("b")).filter("b IS NOT NULL").select("b.columns", "b.median_sum", "b.match_share")


def score_separation(df: DataFrame, score: str, outcome: str) -> DataFrame:
    """(score, outcome, positives, negatives, auc, ties): AUC of the rarer outcome value, ties one half, 4 decimals.

    Counts per score value come first, so only distinct scores are ordered, in ranges.
    """
    rows = df.select(F.col(score).cast("double").alias("s"), F.col(outcome).cast("string").alias("o")).filter("s IS NOT NULL AND o IS NOT NULL")
    classes = rows.groupBy("o").agg(F.count("*").alias("n"))
    rare = F.broadcast(classes.agg(F.min(F.struct("n", "o")).alias("r"), F.count("*").alias("k"), F.sum("n").alias("all")).select(F.col("r.o").alias("rare"), F.col("r.n").alias("positives"), (F.col("all") - F.col("r.n")).alias("negatives"), "k"))
    counts = rows.crossJoin(rare).groupBy("s", "positives", "negatives", "rare", "k").agg(F.count_if(F.col("o") == F.col("rare")).alias("pos"), F.count_if(F.col("o") != F.col("rare")).alias("neg"))
    upto = running_sum(counts, [], "s", "neg", "neg_upto")
    won = F.sum(F.col("pos") * ((F.col("neg_upto") - F.col("neg")) + 0.5 * F.col("neg")))
    found = upto.groupBy("positives", "negatives", "k").agg(won.alias("won"), F.sum(F.col("pos") * F.col("neg")).alias("ties"))
    auc = F.floor(F.col("won") / (F.col("positives").cast("double") * F.col("negatives")) * 10000 + 0.5) / 10000
    return found.filter("k = 2").select(F.lit(score).alias("score"), F.lit(outcome).alias("outcome"), "positives", "negatives", auc.alias("auc"), "ties")


def two_set_pairing(df: DataFrame, key: str, discriminator: str, order: str) -> DataFrame:
    """(set_a, set_b, keys_a, keys_b, keys_both, duplicates, identical, identical_pct) of a two-valued discriminator.

    A key's first rows in each set are compared over all other columns; the share is kept within
    1..99 unless it is exact.
    """
    sets = df.filter(F.col(discriminator).isNotNull()).agg(F.min(discriminator).alias("set_a"), F.max(discriminator).alias("set_b"))
    others = [c for c in df.columns if c not in (key, discriminator, order)]
    tagged = df.filter(F.col(key).isNotNull()).crossJoin(F.broadcast(sets))  # one row
    row = F.struct(*others)
    is_a, is_b = F.col(discriminator) == F.col("set_a"), F.col(discriminator) == F.col("set_b")
    by = tagged.groupBy(key, "set_a", "set_b").agg(F.count_if(is_a).alias("a"), F.count_if(is_b).alias("b"), F.min_by(F.when(is_a, row), F.when(is_a, F.col(order))).alias("ra"), F.min_by(F.when(is_b, row), F.when(is_b, F.col(order))).alias("rb"))
    same = reduce(lambda x, y: x & y, (F.col(f"ra.{c}").eqNullSafe(F.col(f"rb.{c}")) for c in others))
    both = (F.col("a") > 0) & (F.col("b") > 0)
    got = by.groupBy("set_a", "set_b").agg(F.count_if(F.col("a") > 0).alias("keys_a"), F.count_if(F.col("b") > 0).alias("keys_b"), F.count_if(both).alias("keys_both"), F.count_if((F.col("a") > 1) | (F.col("b") > 1)).alias("duplicates"), F.count_if(both & same).alias("identical"))
    pct = F.floor(100.0 * F.col("identical") / F.col("keys_both") + 0.5).cast("int")
    clamped = F.when((F.col("identical") == 0) | (F.col("identical") == F.col("keys_both")), pct).otherwise(F.greatest(F.lit(1), F.least(F.lit(99), pct)))
    return got.withColumn("identical_pct", clamped)


def additivity(df: DataFrame, measure: str, dims: Sequence[str]) -> DataFrame:
    """(dim, groups, whole100, whole1): how many groups of the other dimensions sum to a whole along ``dim``."""
    out = None
    for d in dims:
        others = [c for c in dims if c != d]
        by = df.filter(F.col(measure).isNotNull()).groupBy(*others).agg(F.sum(measure).alias("__total"), F.countDistinct(d).alias("__levels")).filter("__levels >= 2")
        row = by.agg(F.lit(d).alias("dim"), F.count("*").alias("groups"), F.count_if(F.abs(F.col("__total") - 100) <= 1).alias("whole100"), F.count_if(F.abs(F.col("__total") - 1) <= 0.01).alias("whole1"))
        out = row if out is None else out.union(row)
    return out.withColumn("part_of_whole", (F.col("groups") >= 2) & ((F.col("whole100") >= 0.9 * F.col("groups")) | (F.col("whole1") >= 0.9 * F.col("groups"))))


def additivity_class(part_of_whole: bool, low: float | None, high: float | None, hint: str | None = None, discouraged: bool = False) -> str:
    """part_of_whole, intensive_rate, additive or unknown, by the first evidence that there is."""
    if part_of_whole:
        return "part_of_whole"
    if discouraged or hint in ("avg", "min", "max"):
        return "intensive_rate"
    if hint == "count":
        return "additive"
    in_unit = low is not None and high is not None and low >= 0 and 0 < high <= 1.0001
    return "intensive_rate" if hint is None and in_unit else "unknown"


def leaf_cardinality(df: DataFrame, dims: Sequence[str]) -> DataFrame:
    return (df.select(*dims).distinct() if dims else df).agg(F.count("*").alias("leaf_cardinality"))


def persistence(df: DataFrame, series: str, period: Column, value: str, least: int = 6) -> DataFrame:
    """(series_count, rel_step, vn_detrended): medians over series of the relative step and the von Neumann ratio of the trend's residuals.

    Values are summed by period first; a series' periods are few next to its rows.
    """
    points = df.groupBy(F.col(series).alias("k"), period.alias("t")).agg(F.sum(value).alias("y"))
    own = Window.partitionBy("k").orderBy("t")
    every = Window.partitionBy("k")
    x = points.withColumn("i", F.row_number().over(own).cast("double")).withColumn("n", F.count("*").over(every)).filter(F.col("n") >= least)
    fit = x.withColumn("slope", F.regr_slope("y", "i").over(every)).withColumn("base", F.regr_intercept("y", "i").over(every)).withColumn("e", F.col("y") - F.col("base") - F.col("slope") * F.col("i"))
    steps = fit.withColumn("dy", F.abs(F.col("y") - F.lag("y").over(own))).withColumn("de", F.pow(F.col("e") - F.lag("e").over(own), 2))
    each = steps.groupBy("k").agg((F.median("dy") / F.median(F.abs("y"))).alias("rel_step"), (F.sum("de") / F.sum(F.pow("e", 2))).alias("vn"))
    return each.agg(F.count("*").alias("series_count"), F.median("rel_step").alias("rel_step"), F.median("vn").alias("vn_detrended"))
