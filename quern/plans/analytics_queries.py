"""Analyses over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import analytics as A
from quern.plans.common import Registry, t
from quern.plans.query_queries import MONTHLY

R = Registry()
MONTH = F.trunc  # month start of a date


def points(s, d):
    return A.periods(t(s, d, "orders"), F.trunc("o_orderdate", "month"), "o_totalprice")


GROWTH = f"m AS ({MONTHLY}), g AS (SELECT count(*) AS n, arg_min(revenue, month) AS a, arg_max(revenue, month) AS z, max(month) AS lm FROM m), r AS (SELECT *, (z / a) ** (1.0 / (n - 1)) - 1 AS rate FROM g), b AS (SELECT *, greatest(-0.5, least(-0.1, -3 * abs(rate))) AS lo, least(1.0, greatest(0.1, 3 * abs(rate))) AS hi FROM r)"


@R.add("an_projection", f"WITH {GROWTH} SELECT CAST(k AS INT) AS step, CAST(lm + to_months(CAST(k AS INT)) AS DATE) AS month, round(z * (1 + rate) ** k, 4) AS projected, round(rate, 9) AS rate, round(lo, 9) AS rate_lo, round(hi, 9) AS rate_hi FROM b, range(1, 13) q(k)")
def _(s, d):
    p = A.projection(points(s, d))
    return p.select("step", "month", F.round("projected", 4).alias("projected"), *(F.round(c, 9).alias(c) for c in ("rate", "rate_lo", "rate_hi")))


@R.add("an_scenarios", f"""WITH {GROWTH}, s AS (SELECT *, k, lo + (hi - lo) * k / 4 AS r FROM b, range(0, 5) q(k)), n AS (SELECT *, row_number() OVER (ORDER BY abs(r - rate), k) = 1 AS is_base FROM s)
SELECT CAST(k AS INT) AS scenario, round(CASE WHEN is_base THEN rate ELSE r END, 9) AS rate, is_base, round(z * (1 + CASE WHEN is_base THEN rate ELSE r END) ** 12, 2) AS final FROM n""")
def _(s, d):
    return A.scenarios(points(s, d)).select("scenario", F.round("rate", 9).alias("rate"), "is_base", F.round("final", 2).alias("final"))


@R.add("an_whatif_param", "SELECT round(-0.1 + k * 0.025, 6) AS growth, round((SELECT sum(o_totalprice) FROM orders) * (1 + round(-0.1 + k * 0.025, 6)), 2) AS projected FROM range(0, 17) q(k)")
def _(s, d):
    total = t(s, d, "orders").agg(F.sum("o_totalprice").alias("v"))
    return A.what_if(total, "v").select("growth", F.round("projected", 2).alias("projected"))


@R.add("an_actual_vs_target", """WITH p AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS period, sum(CASE WHEN month(o_orderdate) <> 2 THEN o_totalprice END) AS a, sum(CASE WHEN month(o_orderdate) <> 3 THEN 150000 END) AS target FROM orders GROUP BY 1),
q AS (SELECT *, a IS NULL AND target IS NOT NULL AS missed, CASE WHEN a IS NULL AND target IS NOT NULL THEN 0 ELSE a END AS actual FROM p)
SELECT period, round(actual, 2) AS actual, target, missed, round(actual - target, 2) AS delta, round((actual - target) / abs(target) * 100, 6) AS delta_pct FROM q""")
def _(s, d):
    o = t(s, d, "orders")
    m = F.month("o_orderdate")
    r = A.actual_vs_target(o, F.trunc("o_orderdate", "month"), F.when(m != 2, F.col("o_totalprice")), F.when(m != 3, F.lit(150000).cast("long")))
    return r.select("period", F.round("actual", 2).alias("actual"), "target", "missed", F.round("delta", 2).alias("delta"), F.round("delta_pct", 6).alias("delta_pct"))


_GRID = f"WITH m AS (SELECT * FROM ({MONTHLY}) WHERE month(month) NOT IN (5, 6)) SELECT CAST(g AS DATE) AS month, round(revenue, 2) AS value FROM (SELECT unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS g FROM m) LEFT JOIN m ON m.month = g"


@R.add("t_month_grid", _GRID)
def _(s, d):
    return A.month_grid(points(s, d).filter("month(month) NOT IN (5, 6)"), "month", "value").select("month", F.round("value", 2).alias("value"))


R.add("an_trend_grid", _GRID)(R["t_month_grid"])


@R.add("an_value_ramp", """WITH q AS (SELECT list(x ORDER BY x) AS l, count(*) AS n FROM (SELECT value AS x FROM events)), e AS (SELECT n, l[1] AS lo, l[CAST(floor((n-1)*0.95) AS INT)+1] AS p95, l[CAST(floor((n-1)*0.5) AS INT)+1] AS mid, list_sort(list_distinct([l[CAST(floor((n-1)*p) AS INT)+1] FOR p IN [0.2, 0.4, 0.6, 0.8] IF l[CAST(floor((n-1)*p) AS INT)+1] > l[1]])) AS edges FROM q)
SELECT CASE WHEN n < 10 OR lo < 0 OR p95 <= 4 * mid OR len(edges) < 2 THEN 'linear' ELSE 'bands' END AS kind, CASE WHEN NOT (n < 10 OR lo < 0 OR p95 <= 4 * mid OR len(edges) < 2) THEN edges END AS edges FROM e""")
def _(s, d):
    return A.value_ramp(t(s, d, "events"), "value")


@R.add("an_bivariate", """WITH c AS (SELECT c_custkey, c_acctbal AS x, CAST(c_nationkey AS DOUBLE) AS y FROM customer), q AS (SELECT quantile_cont(x, 1.0/3) AS x1, quantile_cont(x, 2.0/3) AS x2, quantile_cont(y, 1.0/3) AS y1, quantile_cont(y, 2.0/3) AS y2 FROM c)
SELECT c_custkey, CAST(x >= x1 - 1e-9 AS INT) + CAST(x >= x2 - 1e-9 AS INT) AS cell_x, CAST(y >= y1 - 1e-9 AS INT) + CAST(y >= y2 - 1e-9 AS INT) AS cell_y FROM c, q""")
def _(s, d):
    return A.bivariate(t(s, d, "customer"), "c_custkey", "c_acctbal", "c_nationkey")


def coordinates(s, d):
    """Invented places of suppliers' and customers' nations, by key."""
    from quern.plans.query_queries import lanes

    return lanes(s, d).select((F.col("s_nationkey") * 7.0 - 80).alias("a"), (F.col("s_nationkey") * 13.0 - 170).alias("b"), (F.col("c_nationkey") * 7.0 - 80).alias("c"), (F.col("c_nationkey") * 13.0 - 170).alias("e"), F.col("l_quantity").alias("v"))


_ROUTES = """WITH r AS (SELECT round(s_nationkey * 7.0 - 80, 3) AS o_lat, round(s_nationkey * 13.0 - 170, 3) AS o_lon, round(c_nationkey * 7.0 - 80, 3) AS d_lat, round(c_nationkey * 13.0 - 170, 3) AS d_lon, sum(l_quantity) AS value
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)
SELECT CAST(o_lat AS DOUBLE) AS o_lat, CAST(o_lon AS DOUBLE) AS o_lon, CAST(d_lat AS DOUBLE) AS d_lat, CAST(d_lon AS DOUBLE) AS d_lon, value, s AS self_route FROM (SELECT *, o_lat = d_lat AND o_lon = d_lon AS s FROM r WHERE o_lat BETWEEN -90 AND 90 AND d_lat BETWEEN -90 AND 90 AND o_lon BETWEEN -180 AND 180 AND d_lon BETWEEN -180 AND 180) ORDER BY value DESC, o_lat, o_lon, d_lat, d_lon LIMIT 150"""


@R.add("agg_od_routes", _ROUTES)
def _(s, d):
    return A.routes(coordinates(s, d), ("a", "b"), ("c", "e"), "v")


R.add("an_od_flow", _ROUTES)(R["agg_od_routes"])
R.add("topk_routes", _ROUTES)(R["agg_od_routes"])


@R.add("an_fit_line", "SELECT l_returnflag, CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope FROM lineitem GROUP BY 1")
def _(s, d):
    f = A.line_fit(t(s, d, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice")
    return f.select("l_returnflag", "n", F.round("intercept", 4).alias("intercept"), F.round("slope", 6).alias("slope"))


@R.add("an_confound", """WITH b AS (SELECT event_type AS channel, date_trunc('day', ts) AS p, sum(value) AS s FROM events GROUP BY ALL), r AS (SELECT *, dense_rank() OVER (PARTITION BY channel ORDER BY p) AS k FROM b)
SELECT channel, round(corr(k, s), 9) AS r, abs(corr(k, s)) >= 0.8 AS confounded, max(s) < 3 * min(s) AS narrow FROM r GROUP BY 1""")
def _(s, d):
    return A.confounded(t(s, d, "events"), "event_type", F.date_trunc("day", "ts"), "value").withColumn("r", F.round("r", 9))


_TAB = "SELECT event_type AS channel, CAST(date_trunc('day', ts) AS TIMESTAMP) AS period, round(sum(value), 6) AS spend, count(*) AS outcome, CAST(dense_rank() OVER (ORDER BY date_trunc('day', ts)) AS INT) AS period_rank FROM events GROUP BY 1, date_trunc('day', ts)"


@R.add("an_budget_tabulate", _TAB)
def _(s, d):
    e = t(s, d, "events").withColumn("one", F.lit(1).cast("long"))
    return A.tabulate(e, "event_type", F.date_trunc("day", "ts"), "value", "one").withColumn("spend", F.round("spend", 6))


def _points(s, d):
    e = t(s, d, "events").withColumn("one", F.lit(1).cast("long"))
    return A.tabulate(e, "event_type", F.date_trunc("day", "ts"), "value", "one")


@R.add("an_fit_saturation")
def _(s, d):
    return A.saturation_fits(_points(s, d), "channel", "spend", "outcome")


@R.add("an_allocate")
def _(s, d):
    """Equal marginal gains over fitted channels; a channel is a row, so the plan is made on the driver."""
    fits = A.saturation_fits(_points(s, d), "channel", "spend", "outcome").collect()
    curves = [{"name": r.channel, "v": max(r.v, 0.0) if r.kind == "curve" else 1.0, "k": r.k if r.kind == "curve" else 100.0, "lo": 0.0, "hi": 1e6} for r in fits]
    plan = A.allocate(curves, 1000.0)
    return s.createDataFrame(sorted(plan.items()), "channel string, budget double")


@R.add("an_fit_members", """WITH p AS (SELECT event_type AS g, user_id % 4 AS m, datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS t, sum(value) AS x, CAST(count(*) AS DOUBLE) AS y FROM events GROUP BY ALL),
f AS (SELECT g, m, regr_intercept(x, t) AS xa, regr_slope(x, t) AS xb, regr_intercept(y, t) AS ya, regr_slope(y, t) AS yb, avg(x) AS xm, avg(y) AS ym FROM p GROUP BY ALL),
r AS (SELECT p.g, p.m, x - coalesce(CASE WHEN isnan(xb) THEN NULL ELSE xa + xb * t END, xm) AS x, y - coalesce(CASE WHEN isnan(yb) THEN NULL ELSE ya + yb * t END, ym) AS y FROM p JOIN f ON p.g = f.g AND p.m = f.m)
SELECT g, count(*) AS n, count(DISTINCT m) AS members, round(sum(x * y) / sum(x * x), 6) AS slope FROM r GROUP BY g""")
def _(s, d):
    e = t(s, d, "events").groupBy(F.col("event_type").alias("g"), (F.col("user_id") % 4).alias("m"), F.datediff("ts", F.lit("2024-01-01").cast("date")).alias("t")).agg(F.sum("value").alias("x"), F.count("*").cast("double").alias("y"))
    return A.member_fits(e, "g", "m", "t", "x", "y").select("g", "n", "members", F.round("slope", 6).alias("slope"))


@R.add("an_loss_interval")
def _(s, d):
    """An even split against the best one, with an assumed spread of the fitted parameters."""
    fits = [r for r in A.saturation_fits(_points(s, d), "channel", "spend", "outcome").collect()]
    curves = [{"name": r.channel, "v": r.v if r.kind == "curve" else 10.0, "k": r.k if r.kind == "curve" else 100.0, "lo": 0.0, "hi": 1e6, "df": max(1, r.n - 3), "cov": [[0.01 * abs(r.v), 0], [0, 1.0]]} for r in fits]
    got = A.loss_interval(curves, {c["name"]: 1000.0 / len(curves) for c in curves}, A.allocate(curves, 1000.0))
    return s.createDataFrame([(float(got["delta"]), float(got["lo"]), float(got["hi"]), bool(got["within"]))], "delta double, lo double, hi double, within boolean")


@R.add("an_row_growth", "SELECT count(*) AS rows, count(*) >= 10 * 25 AND count(*) - 25 >= 500 AS notice FROM orders")
def _(s, d):
    return t(s, d, "orders").agg(F.count("*").alias("rows")).withColumn("notice", (F.col("rows") >= 250) & (F.col("rows") - 25 >= 500))


@R.add("an_explain_selection")
def _(s, d):
    return A.explain_selection(t(s, d, "orders"), F.col("o_orderstatus") == "F", ["o_orderpriority"], ["o_totalprice"])


@R.add("an_explain_described", """SELECT o_orderpriority AS value, round(count(*) FILTER (o_orderstatus = 'F') / (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') - count(*) FILTER (o_orderstatus <> 'F') / (SELECT count(*) FROM orders WHERE o_orderstatus <> 'F'), 9) AS gap FROM orders GROUP BY 1""")
def _(s, d):
    sel = F.col("o_orderstatus") == "F"
    o = t(s, d, "orders")
    g = o.groupBy("o_orderpriority").agg(F.count_if(sel).alias("a"), F.count_if(~sel).alias("b"))
    whole = g.agg(F.sum("a").alias("sa"), F.sum("b").alias("sb"))
    return g.crossJoin(F.broadcast(whole)).select(F.col("o_orderpriority").alias("value"), F.round(F.col("a") / F.col("sa") - F.col("b") / F.col("sb"), 9).alias("gap"))  # one row


@R.add("st_fisher")
def _(s, d):
    return s.createDataFrame([(A.fisher_exact(8, 10, 12, 30), A.fisher_exact(1, 10, 12, 30))], "p1 double, p2 double")


@R.add("st_mann_whitney", """WITH v AS (SELECT o_totalprice AS x, count(*) FILTER (o_orderstatus = 'F') AS a, count(*) FILTER (o_orderstatus <> 'F') AS b FROM orders GROUP BY 1), u AS (SELECT *, sum(b) OVER (ORDER BY x) AS cb FROM v)
SELECT CAST(sum(a) AS BIGINT) AS n1, CAST(sum(b) AS BIGINT) AS n2, CAST(sum(a * (cb - b + 0.5 * b)) AS DOUBLE) AS u FROM u""")
def _(s, d):
    return A.mann_whitney(t(s, d, "orders"), F.col("o_orderstatus") == "F", "o_totalprice").select("n1", "n2", F.col("u").cast("double").alias("u"))


@R.add("st_cliffs_delta", """WITH v AS (SELECT n_chars AS x, count(*) FILTER (toxic = 1) AS a, count(*) FILTER (toxic <> 1) AS b FROM documents JOIN labels USING (doc_id) GROUP BY 1), u AS (SELECT *, sum(b) OVER (ORDER BY x) AS cb FROM v)
SELECT round(2.0 * sum(a * (cb - b + 0.5 * b)) / (sum(a) * sum(b)) - 1, 9) AS cliffs_delta FROM u""")
def _(s, d):
    j = t(s, d, "documents").join(t(s, d, "labels"), "doc_id")
    return A.mann_whitney(j, F.col("toxic") == 1, "n_chars").select(F.round(F.col("cliffs_delta").cast("double"), 9).alias("cliffs_delta"))


@R.add("st_bh", """WITH p AS (SELECT n_nationkey AS k, (n_nationkey + 1) * (n_nationkey + 1) / 900.0 AS p FROM nation), r AS (SELECT *, row_number() OVER (ORDER BY p) AS i, count(*) OVER () AS n FROM p)
SELECT k, CAST(p AS DOUBLE) AS p, round(CAST(least(1.0, min(p * n / i) OVER (ORDER BY i DESC)) AS DOUBLE), 9) AS q, min(p * n / i) OVER (ORDER BY i DESC) <= 0.05 AS significant FROM r""")
def _(s, d):
    p = t(s, d, "nation").select(F.col("n_nationkey").alias("k"), ((F.col("n_nationkey") + 1) * (F.col("n_nationkey") + 1) / 900.0).cast("double").alias("p"))
    return A.benjamini_hochberg(p, "p").withColumn("q", F.round("q", 9))


@R.add("st_pearson", "SELECT round(corr(l_quantity, l_extendedprice), 9) AS r FROM lineitem")
def _(s, d):
    return t(s, d, "lineitem").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 9).alias("r"))


@R.add("st_spearman", """WITH r AS (SELECT rank() OVER (ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_acctbal) - 1) / 2.0 AS a, rank() OVER (ORDER BY c_nationkey) + (count(*) OVER (PARTITION BY c_nationkey) - 1) / 2.0 AS b FROM customer) SELECT round(corr(a, b), 9) AS rho FROM r""")
def _(s, d):
    """Average ranks from running counts per value, then Pearson."""
    from quern.operators.ranks import running_sum

    c = t(s, d, "customer").select("c_acctbal", "c_nationkey")
    for col in ("c_acctbal", "c_nationkey"):
        n = running_sum(c.groupBy(col).agg(F.count("*").alias("n")), [], col, "n", "upto").select(col, (F.col("upto") - (F.col("n") - 1) / 2.0).alias(f"r_{col}"))
        c = c.join(n, col)
    return c.agg(F.round(F.corr("r_c_acctbal", "r_c_nationkey"), 9).alias("rho"))


QUERIES, ORACLE_SQL = R, R.sql
