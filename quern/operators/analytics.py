"""Analyses built on aggregates: projections, comparisons, value bands, flows, tests, allocation."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.ranks import order_statistics


def histogram(df: DataFrame, column: str) -> DataFrame:
    """(bin, n): equal widths, clamp(round(sqrt n), 4, 24) bins, the maximum in the last; under 8 rows none."""
    x = F.col(column).cast("double")
    span = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.count(x).alias("n"))
    plan = span.withColumn("k", F.greatest(F.lit(4), F.least(F.lit(24), F.floor(F.sqrt("n") + 0.5).cast("int")))).filter("n >= 8")
    rows = df.select(x.alias("x")).filter("x IS NOT NULL").crossJoin(F.broadcast(plan))  # one row
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("x") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / F.col("k"))), F.col("k") - 1)).otherwise(0)
    return rows.groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def periods(df: DataFrame, month: Column, value: str) -> DataFrame:
    """(month, value): sums by month."""
    return df.groupBy(month.alias("month")).agg(F.sum(value).alias("value"))


def growth(points: DataFrame) -> DataFrame:
    """(n, first, last, last_month, rate): compound growth per period of (month, value) points, at least 6; 0 unless both ends are positive."""
    row = points.agg(F.count("*").alias("n"), F.min_by("value", "month").alias("first"), F.max_by("value", "month").alias("last"), F.max("month").alias("last_month"), F.avg("value").alias("mean"))
    rate = F.when((F.col("first") > 0) & (F.col("last") > 0), F.pow(F.col("last") / F.col("first"), 1.0 / (F.col("n") - 1)) - 1).otherwise(0.0)
    return row.filter("n >= 6").withColumn("rate", rate)


def projection(points: DataFrame) -> DataFrame:
    """(step, month, projected, rate, rate_lo, rate_hi): the next min(12, n) periods at the compound rate."""
    g = growth(points)
    a = F.abs("rate")
    bounded = g.withColumn("rate_lo", F.greatest(F.lit(-0.5), F.least(F.lit(-0.1), -3 * a))).withColumn("rate_hi", F.least(F.lit(1.0), F.greatest(F.lit(0.1), 3 * a)))
    steps = bounded.withColumn("step", F.explode(F.sequence(F.lit(1), F.least(F.lit(12), F.col("n").cast("int")))))
    return steps.select("step", F.add_months("last_month", F.col("step")).alias("month"), (F.col("last") * F.pow(1 + F.col("rate"), F.col("step"))).alias("projected"), "rate", "rate_lo", "rate_hi")


def scenarios(points: DataFrame, horizon: int = 12) -> DataFrame:
    """(scenario, rate, is_base, final): five rates evenly between the bounds, the nearest replaced by the growth itself."""
    p = projection(points).filter("step = 1").select("rate", "rate_lo", "rate_hi")
    last = growth(points).select("last")
    rates = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: F.col("rate_lo") + (F.col("rate_hi") - F.col("rate_lo")) * k / 4)
    gaps = F.transform("rates", lambda r: F.abs(r - F.col("rate")))
    listed = p.withColumn("rates", rates).withColumn("near", F.array_position(gaps, F.array_min(gaps)) - 1)
    each = listed.select("rate", "near", F.posexplode("rates").alias("scenario", "r")).withColumn("is_base", F.col("scenario") == F.col("near"))
    used = F.when(F.col("is_base"), F.col("rate")).otherwise(F.col("r"))
    return each.crossJoin(F.broadcast(last)).select("scenario", used.alias("rate"), "is_base", (F.col("last") * F.pow(1 + used, F.lit(horizon))).alias("final"))  # one row


def what_if(total: DataFrame, value: str, low: float = -0.1, high: float = 0.3, step: float = 0.025) -> DataFrame:
    """(growth, projected): the parameter's rates times a one-row total."""
    n = round((high - low) / step) + 1
    rates = F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.round(F.lit(low) + k * step, 6)))
    return total.select(F.col(value).alias("v"), rates.alias("growth")).select("growth", (F.col("v") * (1 + F.col("growth"))).alias("projected"))


def actual_vs_target(df: DataFrame, period: Column, actual: Column, target: Column) -> DataFrame:
    """(period, actual, target, missed, delta, delta_pct): a missing actual against a target counts as 0."""
    by = df.groupBy(period.alias("period")).agg(F.sum(actual).alias("a"), F.sum(target).alias("target"))
    missed = F.col("a").isNull() & F.col("target").isNotNull()
    value = F.when(missed, 0.0).otherwise(F.col("a"))
    return by.select("period", value.alias("actual"), "target", missed.alias("missed"), (value - F.col("target")).alias("delta"), (F.try_divide(value - F.col("target"), F.abs("target")) * 100).alias("delta_pct"))


def month_grid(points: DataFrame, month: str, value: str) -> DataFrame:
    """Every month from the first to the last, with nulls where there is no point."""
    span = points.agg(F.min(month).alias("a"), F.max(month).alias("b")).filter("a IS NOT NULL")
    grid = span.select(F.explode(F.expr("sequence(a, b, interval 1 month)")).alias(month))
    return grid.join(points, month, "left").select(month, value)


def value_ramp(df: DataFrame, column: str) -> DataFrame:
    """(kind, edges): linear, or bands with edges at fifths of the sorted values (floor index), merged where equal."""
    x = df.select(F.col(column).cast("double").alias("x"))
    q = order_statistics(x, [], "x", {"lo": 0.0, "e1": 0.2, "e2": 0.4, "e3": 0.6, "e4": 0.8, "p95": 0.95, "mid": 0.5})
    edges = F.array_distinct(F.filter(F.array("e1", "e2", "e3", "e4"), lambda e: e > F.col("lo")))
    linear = (F.col("n") < 10) | (F.col("lo") < 0) | (F.col("p95") <= 4 * F.col("mid")) | (F.size(edges) < 2)
    return q.select(F.when(linear, "linear").otherwise("bands").alias("kind"), F.when(~linear, edges).alias("edges"))


def bivariate(df: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """(key, cell_x, cell_y): thirds of both columns over rows that have both; a value at a threshold goes up, a constant axis is the middle."""
    rows = df.select(F.col(key).alias(key), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).filter("x IS NOT NULL AND y IS NOT NULL")
    thirds = {"t1": 1 / 3, "t2": 2 / 3, "lo": 0.0, "hi": 1.0}
    out = rows
    for c in ("x", "y"):
        cuts = order_statistics(rows, [], c, thirds, "linear").select(*(F.col(k).alias(f"{c}_{k}") for k in thirds))
        cell = F.when(F.col(f"{c}_lo") == F.col(f"{c}_hi"), 1).otherwise((F.col(c) >= F.col(f"{c}_t1")).cast("int") + (F.col(c) >= F.col(f"{c}_t2")).cast("int"))
        out = out.crossJoin(F.broadcast(cuts)).withColumn(f"cell_{c}", cell)  # one row
    return out.select(key, "cell_x", "cell_y")


def routes(df: DataFrame, origin: tuple[str, str], destination: tuple[str, str], value: str, top: int = 150) -> DataFrame:
    """The ``top`` routes by value between places rounded to 3 decimals; rows without a place or value are left out."""
    names = {"o_lat": origin[0], "o_lon": origin[1], "d_lat": destination[0], "d_lon": destination[1]}
    ok = F.col(value).isNotNull()
    for k, c in names.items():
        ok = ok & F.col(c).between(-90 if k.endswith("lat") else -180, 90 if k.endswith("lat") else 180)
    by = df.filter(ok).groupBy(*(F.round(F.col(c).cast("double"), 3).alias(k) for k, c in names.items())).agg(F.sum(value).alias("value"))
    own = (F.col("o_lat") == F.col("d_lat")) & (F.col("o_lon") == F.col("d_lon"))
    return by.withColumn("self_route", own).orderBy(F.col("value").desc(), *names).limit(top)


def line_fit(df: DataFrame, groups: Sequence[str], x: str, y: str) -> DataFrame:
    """(groups, n, intercept, slope, rss, aic): least squares from one pass of sums."""
    x_, y_ = F.col(x).cast("double"), F.col(y).cast("double")
    fit = df.groupBy(*groups).agg(F.regr_count(y_, x_).alias("n"), F.regr_intercept(y_, x_).alias("intercept"), F.regr_slope(y_, x_).alias("slope"), F.regr_syy(y_, x_).alias("syy"), F.regr_sxy(y_, x_).alias("sxy"))
    rss = F.greatest(F.col("syy") - F.col("slope") * F.col("sxy"), F.lit(0.0))
    return fit.withColumn("rss", rss).withColumn("aic", F.col("n") * F.ln(F.col("rss") / F.col("n")) + 4).select(*groups, "n", "intercept", "slope", "rss", "aic")


def confounded(df: DataFrame, channel: str, period: Column, spend: str) -> DataFrame:
    """(channel, r, confounded, narrow): spend that moves with time, or spans less than 3 times."""
    by = df.groupBy(F.col(channel).alias("channel"), period.alias("p")).agg(F.sum(spend).alias("s"))
    ranked = by.withColumn("rank", F.dense_rank().over(Window.partitionBy("channel").orderBy("p")).cast("double"))
    return ranked.groupBy("channel").agg(F.corr("rank", "s").alias("r"), F.max("s").alias("hi"), F.min("s").alias("lo")).select("channel", "r", (F.abs("r") >= 0.8).alias("confounded"), (F.col("hi") < 3 * F.col("lo")).alias("narrow"))


def tabulate(df: DataFrame, channel: str, period: Column, spend: str, outcome: str) -> DataFrame:
    """(channel, period, spend, outcome, period_rank)."""
    by = df.filter(F.col(channel).isNotNull() & F.col(spend).isNotNull()).groupBy(F.col(channel).alias("channel"), period.alias("period")).agg(F.sum(spend).alias("spend"), F.sum(outcome).alias("outcome"))
    ranks = by.select("period").distinct().withColumn("period_rank", F.row_number().over(Window.orderBy("period")))  # a row a period
    return by.join(F.broadcast(ranks), "period").select("channel", "period", "spend", "outcome", "period_rank")


def benjamini_hochberg(tests: DataFrame, p: str, level: float = 0.05) -> DataFrame:
    """``tests`` with q and significant: p times tests over rank, made monotone from the largest."""
    w = Window.orderBy(p)
    n = tests.agg(F.count("*").alias("__n"))
    ranked = tests.crossJoin(F.broadcast(n)).withColumn("__rank", F.row_number().over(w))  # a row a test: few
    q = F.least(F.lit(1.0), F.min(F.col(p) * F.col("__n") / F.col("__rank")).over(Window.orderBy(F.col("__rank").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return ranked.withColumn("q", q).withColumn("significant", F.col("q") <= level).drop("__n", "__rank")


def row_growth(before: int, now: int) -> str | None:
    """A notice once a view shows ten times the rows it was made for, and 500 more."""
    return f"built for {before} rows, now {now}" if now >= 10 * before and now - before >= 500 else None


def _log_choose(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def fisher_exact(hits_in: int, total_in: int, hits_all: int, total_all: int) -> float:
    """Two-sided probability of a 2 by 2 table at least as unlikely as this one."""
    base = _log_choose(total_all, total_in)

    def log_p(k: int) -> float:
        return _log_choose(hits_all, k) + _log_choose(total_all - hits_all, total_in - k) - base

    own = log_p(hits_in)
    lo, hi = max(0, total_in - (total_all - hits_all)), min(total_in, hits_all)
    return min(1.0, sum(math.exp(log_p(k)) for k in range(lo, hi + 1) if log_p(k) <= own + 1e-9))


def mann_whitney_p(u: float, n1: int, n2: int, tie_sum: float) -> float:
    """Two-sided normal approximation with tie and continuity corrections; ``tie_sum``: sum of t^3 - t."""
    n = n1 + n2
    var = n1 * n2 / 12 * ((n + 1) - tie_sum / (n * (n - 1)))
    if var <= 0:
        return 1.0
    z = max(0.0, abs(u - n1 * n2 / 2) - 0.5) / math.sqrt(var)
    return math.erfc(z / math.sqrt(2))


def mann_whitney(df: DataFrame, selected: Column, value: str) -> DataFrame:
    """(n1, n2, u, tie_sum, cliffs_delta) of selected rows against the rest, from counts per value."""
    from quern.operators.ranks import running_sum

    by = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("x")).agg(F.count_if(selected).alias("a"), F.count_if(~selected).alias("b"))
    upto = running_sum(by, [], "x", "b", "b_upto")
    row = upto.agg(F.sum("a").alias("n1"), F.sum("b").alias("n2"), F.sum(F.col("a") * (F.col("b_upto") - F.col("b") + 0.5 * F.col("b"))).alias("u"), F.sum(F.pow(F.col("a") + F.col("b"), F.lit(3)) - (F.col("a") + F.col("b"))).alias("tie_sum"))
    return row.withColumn("cliffs_delta", F.col("u") * 2 / (F.col("n1").cast("double") * F.col("n2")) - 1)


def explain_selection(df: DataFrame, selected: Column, dims: Sequence[str], measures: Sequence[str], level: float = 0.05, effect: float = 0.2, most_levels: int = 12) -> DataFrame:
    """(kind, column, value, share_in, share_out, effect, p, q, significant): what sets the selected rows apart.

    Counts come from Spark, one row a level or measure; probabilities are worked out on the driver.
    """
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in dims)))
    counts = df.select(cells.alias("c"), selected.alias("s")).groupBy("c.column", "c.value").agg(F.count_if(F.col("s")).alias("k"), F.count("*").alias("n"))
    totals = df.agg(F.count_if(selected).alias("k"), F.count("*").alias("n")).first()
    few = counts.groupBy("column").count().filter(F.col("count") <= most_levels).select("column")
    rows = []
    for r in counts.join(F.broadcast(few), "column").filter("value IS NOT NULL").collect():  # at most dims x levels rows
        inside, outside = r.k / max(1, totals.k), (r.n - r.k) / max(1, totals.n - totals.k)
        rows.append(("category", r["column"], r["value"], inside, outside, inside - outside, fisher_exact(r.k, totals.k, r.n, totals.n)))
    for m in measures:
        r = mann_whitney(df, selected, m).first()
        if r and r.n1 and r.n2:
            rows.append(("measure", m, None, None, None, r.cliffs_delta, mann_whitney_p(r.u, r.n1, r.n2, r.tie_sum)))
    tests = df.sparkSession.createDataFrame(rows, "kind string, column string, value string, share_in double, share_out double, effect double, p double")
    return benjamini_hochberg(tests, "p", level).withColumn("significant", F.col("significant") & (F.abs("effect") >= effect))


def saturation_fits(points: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """(group, n, kind, c, v, k, rss): y = c + v x / (k + x) for each group, or a line where that is no better.

    The curve's only nonlinear parameter is searched on a logarithmic grid and refined; the rest is
    least squares. A group's points are period sums, few however many rows there were.
    """
    import numpy as np
    import pandas as pd

    schema = f"{group} string, n int, kind string, c double, v double, k double, rss double"

    def solve(k: float, xs, ys):
        a = np.column_stack([np.ones_like(xs), xs / (k + xs)])
        beta, *_ = np.linalg.lstsq(a, ys, rcond=None)
        return beta, float(((ys - a @ beta) ** 2).sum())

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        xs, ys = pdf[x].to_numpy(float), pdf[y].to_numpy(float)
        n, name = len(xs), str(pdf[group].iloc[0])
        line, rest, *_ = np.linalg.lstsq(np.column_stack([np.ones(n), xs]), ys, rcond=None)
        rss_line = float(((ys - line[0] - line[1] * xs) ** 2).sum())
        out = (name, n, "line", float(line[0]), float(line[1]), float("nan"), rss_line)
        if n >= 5 and xs.max() > 0:
            grid = np.geomspace(max(xs[xs > 0].min(), 1e-9) / 20, xs.max() * 20, 400)
            losses = [solve(k, xs, ys)[1] for k in grid]
            best = int(np.argmin(losses))
            if 0 < best < len(grid) - 1:
                lo, hi, phi = math.log(grid[best - 1]), math.log(grid[best + 1]), (math.sqrt(5) - 1) / 2
                for _ in range(60):
                    p, q = hi - phi * (hi - lo), lo + phi * (hi - lo)
                    if solve(math.exp(p), xs, ys)[1] < solve(math.exp(q), xs, ys)[1]:
                        hi = q
                    else:
                        lo = p
                k = math.exp((lo + hi) / 2)
                (c, v), rss = solve(k, xs, ys)
                gain = n * math.log(max(rss_line, 1e-300) / n) + 4 - (n * math.log(max(rss, 1e-300) / n) + 6)
                if gain > 2 and v > 0:
                    out = (name, n, "curve", float(c), float(v), float(k), rss)
        return pd.DataFrame([out], columns=["g", "n", "kind", "c", "v", "k", "rss"]).rename(columns={"g": group})

    return points.select(F.col(group).cast("string").alias(group), x, y).groupBy(group).applyInPandas(fit, schema)


def allocate(curves: Sequence[dict], total: float, locks: dict[str, float] | None = None) -> dict[str, float]:
    """Budget over channels ``{name, v, k, lo, hi}`` that makes the marginal gains v k / (k + x)^2 equal within bounds."""
    locks = locks or {}
    free = [c for c in curves if c["name"] not in locks]
    left = total - sum(locks.values())

    def spent(level: float) -> dict[str, float]:
        return {c["name"]: min(c["hi"], max(c["lo"], math.sqrt(max(c["v"], 0) * c["k"] / level) - c["k"] if c["v"] > 0 else c["lo"])) for c in free}

    lo, hi = -60.0, 60.0
    for _ in range(200):
        mid = (lo + hi) / 2
        if sum(spent(math.exp(mid)).values()) > left:
            lo = mid
        else:
            hi = mid
    return spent(math.exp(hi)) | dict(locks)


def member_fits(points: DataFrame, group: str, member: str, period: str, x: str, y: str) -> DataFrame:
    """(group, n, members, slope, rss): one shared slope after each member's own line over time is removed.

    Members (regions, shops) of a group differ in level and trend; what is left of x and y after
    both are taken out shares one response. All of it is window aggregates over a member's periods.
    """
    w = Window.partitionBy(group, member)
    t, rows = F.col(period).cast("double"), points
    for c in (x, y):
        fit = F.regr_intercept(F.col(c), t).over(w) + F.regr_slope(F.col(c), t).over(w) * t
        rows = rows.withColumn(f"__{c}", F.col(c) - F.coalesce(fit, F.avg(c).over(w)))
    sums = rows.groupBy(group).agg(F.count("*").alias("n"), F.countDistinct(member).alias("members"), F.sum(F.col(f"__{x}") * F.col(f"__{y}")).alias("xy"), F.sum(F.pow(f"__{x}", F.lit(2))).alias("xx"), F.sum(F.pow(f"__{y}", F.lit(2))).alias("yy"))
    slope = F.try_divide("xy", "xx")
    return sums.select(group, "n", "members", slope.alias("slope"), F.greatest(F.lit(0.0), F.col("yy") - F.coalesce(slope, F.lit(0.0)) * F.col("xy")).alias("rss"))


def t_quantile(df: float, p: float = 0.975) -> float:
    """Student's t quantile, from the normal one by its expansion in 1 / df."""
    lo, hi = 0.0, 10.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 0.5 * (1 + math.erf(mid / math.sqrt(2))) < p else (lo, mid)
    z = (lo + hi) / 2
    if df <= 2:
        return math.tan(math.pi * (p - 0.5)) if df <= 1 else (2 * p - 1) * math.sqrt(2 / (1 - (2 * p - 1) ** 2))
    return z + (z**3 + z) / (4 * df) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * df**2) + (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / (384 * df**3)


def loss_interval(curves: Sequence[dict], plan: dict[str, float], best: dict[str, float]) -> dict:
    """What ``plan`` gives up against ``best``, with a 95% interval from the parameters' covariances.

    A curve is ``{name, v, k, df, cov}``; ``cov`` is that of (v, k). The plan is within reach of the
    best if the interval holds 0.
    """
    delta = variance = 0.0
    freedom, changed = math.inf, []
    for c in curves:
        a, b = plan[c["name"]], best[c["name"]]
        if a == b:
            continue
        changed.append(c["name"])
        freedom = min(freedom, c["df"])
        value = lambda x, c=c: c["v"] * x / (c["k"] + x)
        slope = lambda x, c=c: (x / (c["k"] + x), -c["v"] * x / (c["k"] + x) ** 2)
        delta += value(b) - value(a)
        g = [p - q for p, q in zip(slope(b), slope(a), strict=True)]
        variance += max(0.0, sum(g[i] * c["cov"][i][j] * g[j] for i in range(2) for j in range(2)))
    reach = (t_quantile(freedom) if changed else 0.0) * math.sqrt(variance)
    return {"delta": delta, "lo": delta - reach, "hi": delta + reach, "within": bool(changed) and freedom < 1 or abs(delta) <= reach, "changed": changed}
