"""Cross-column statistics over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import cross as X
from quern.plans.common import Registry, t, union

R = Registry()
DIMS = ["l_returnflag", "l_linestatus", "l_linenumber"]


@R.add("x_nonblank_groups", union(f"""SELECT '{c}' AS dim, count(*) AS groups, count(*) FILTER (has) AS nonblank_groups FROM (SELECT {c}, bool_or(l_returnflag <> 'A' AND l_tax IS NOT NULL AND l_linenumber <> 3) AS has FROM lineitem GROUP BY 1)""" for c in DIMS))
def _(s, d):
    df = t(s, d, "lineitem").withColumn("m", F.when((F.col("l_returnflag") != "A") & (F.col("l_linenumber") != 3), F.col("l_tax")))
    return X.nonblank_groups(df, DIMS, "m")


@R.add("x_eta2", union(f"""SELECT '{c}' AS dim, '{m}' AS measure, floor(1e4 * b / nullif(tt, 0) + 0.5) / 1e4 AS eta2 FROM (SELECT sum(n * (a - (SELECT avg({m}) FROM lineitem)) ** 2) AS b, (SELECT var_pop({m}) * count({m}) FROM lineitem) AS tt FROM (SELECT {c}, count({m}) AS n, avg({m}) AS a FROM lineitem GROUP BY 1))""" for c in DIMS for m in ("l_quantity", "l_extendedprice")))
def _(s, d):
    return X.eta_squared(t(s, d, "lineitem"), DIMS, ["l_quantity", "l_extendedprice"])


def _iqr(by: str) -> str:
    return f"SELECT {by} AS g, count(*) AS n, (list(x ORDER BY x))[CAST(floor((count(*)-1)*0.75) AS INT)+1] - (list(x ORDER BY x))[CAST(floor((count(*)-1)*0.25) AS INT)+1] AS iqr FROM (SELECT l_returnflag, l_extendedprice AS x FROM lineitem) GROUP BY 1"


@R.add("x_spread_ratio", f"SELECT (max(iqr) - min(iqr)) / (SELECT iqr FROM ({_iqr('1')})) AS spread_ratio FROM ({_iqr('l_returnflag')}) WHERE n >= 4")
def _(s, d):
    return X.spread_ratio(t(s, d, "lineitem"), "l_returnflag", "l_extendedprice")


MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_CORR = union(f"SELECT '{a}' AS measure, '{b}' AS other, corr({a}, {b}) AS r FROM lineitem" for a in MEASURES for b in MEASURES if a != b)


@R.add("x_correlation", f"SELECT measure, other, round(r, 6) AS r, CAST(row_number() OVER (PARTITION BY measure ORDER BY abs(r) DESC, other) AS INT) AS rank FROM ({_CORR})")
def _(s, d):
    return X.correlations(t(s, d, "lineitem"), MEASURES).withColumn("r", F.round("r", 6))


@R.add("topk_correlated", f"SELECT * FROM (SELECT measure, other, round(r, 6) AS r, CAST(row_number() OVER (PARTITION BY measure ORDER BY abs(r) DESC, other) AS INT) AS rank FROM ({_CORR})) WHERE rank <= 2")
def _(s, d):
    return X.correlations(t(s, d, "lineitem"), MEASURES, top=2).withColumn("r", F.round("r", 6))


_SHARED = """WITH v AS (SELECT DISTINCT 'l_linenumber' AS c, CAST(l_linenumber AS VARCHAR) AS v FROM lineitem UNION SELECT DISTINCT 'l_quantity', CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) FROM lineitem UNION SELECT DISTINCT 'l_returnflag', l_returnflag FROM lineitem)
SELECT x.c AS a, y.c AS b, CAST(floor(100.0 * count(*) / (SELECT count(*) FROM v z WHERE z.c = x.c) + 0.5) AS INT) AS shared_pct FROM v x JOIN v y ON x.v = y.v AND x.c <> y.c GROUP BY x.c, y.c"""


@R.add("x_shared_values", _SHARED)
def _(s, d):
    return X.shared_values(t(s, d, "lineitem"), ["l_linenumber", "l_quantity", "l_returnflag"])


R.add("set_intersect_share", _SHARED)(R["x_shared_values"])
_PAIR = union(f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS combinations, count(DISTINCT va) AS card_a, count(DISTINCT vb) AS card_b, CAST(floor(100.0 * count(*) / (count(DISTINCT va) * count(DISTINCT vb)) + 0.5) AS INT) AS fill_pct, count(*) = count(DISTINCT va) AS a_determines_b, count(*) = count(DISTINCT vb) AS b_determines_a, min(n) AS min_cell FROM (SELECT {a} AS va, {b} AS vb, count(*) AS n FROM lineitem GROUP BY 1, 2)" for a, b in (("l_returnflag", "l_linestatus"), ("l_returnflag", "l_linenumber"), ("l_linestatus", "l_linenumber")))


@R.add("x_pair_stats", _PAIR)
def _(s, d):
    return X.pair_stats(t(s, d, "lineitem"), DIMS)


def places(s, d):
    c, n = t(s, d, "customer"), t(s, d, "nation")
    return c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey)


@R.add("x_nesting_parent", "SELECT 'n_name' AS child, 'n_regionkey' AS parent, floor(count(DISTINCT n_regionkey) / count(DISTINCT n_name) * 100 + 0.5) / 100 AS nesting_ratio FROM customer JOIN nation ON c_nationkey = n_nationkey")
def _(s, d):
    return X.nesting_parents(places(s, d), ["n_name", "n_regionkey", "c_mktsegment"])


@R.add("x_wide_nesting", "SELECT 'n_regionkey' AS parent, count(DISTINCT n_regionkey) AS distinct_count FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 'n_name', count(DISTINCT n_name) FROM customer JOIN nation ON c_nationkey = n_nationkey")
def _(s, d):
    return X.determined(places(s, d), "c_nationkey", ["n_name", "n_regionkey", "c_mktsegment"])


@R.add("x_constant_sum", "SELECT 'a,b,c' AS columns, 100.0 AS median_sum, 1.0 AS match_share")
def _(s, d):
    df = t(s, d, "orders").select("o_orderkey", (F.col("o_custkey") % 40 + 10).alias("a"), (F.col("o_orderkey") % 30 + 10).alias("b"), F.col("o_totalprice").alias("x")).withColumn("c", 100 - F.col("a") - F.col("b"))
    return X.constant_sum(df, ["a", "b", "c", "x"], "o_orderkey")


@R.add("x_score_separation", """
WITH j AS (SELECT n_chars AS s, toxic AS o FROM documents JOIN labels USING (doc_id)), c AS (SELECT s, count(*) FILTER (o = 1) AS p, count(*) FILTER (o = 0) AS q FROM j GROUP BY 1),
u AS (SELECT *, sum(q) OVER (ORDER BY s) AS upto FROM c)
SELECT 'n_chars' AS score, 'toxic' AS outcome, CAST(sum(p) AS BIGINT) AS positives, CAST(sum(q) AS BIGINT) AS negatives, floor(sum(p * (upto - q + 0.5 * q)) / (sum(p) * sum(q)) * 1e4 + 0.5) / 1e4 AS auc, CAST(sum(p * q) AS BIGINT) AS ties FROM u""")
def _(s, d):
    return X.score_separation(t(s, d, "documents").join(t(s, d, "labels"), "doc_id"), "n_chars", "toxic")


R.add("win_cumulative", R.sql["x_score_separation"])(R["x_score_separation"])


def snapshots(s, d):
    c = t(s, d, "customer")
    first = c.filter("c_custkey % 10 < 8").withColumn("snap", F.lit("2024-01")).withColumn("at", F.col("c_custkey") * 2)
    second = c.filter("c_custkey % 10 > 0").withColumn("snap", F.lit("2024-02")).withColumn("at", F.col("c_custkey") * 2 + 1).withColumn("c_acctbal", F.col("c_acctbal") + F.when(F.col("c_custkey") % 7 == 0, 1.0).otherwise(0.0))
    return first.union(second)


_TWO_SET = """SELECT '2024-01' AS set_a, '2024-02' AS set_b, count(*) FILTER (m < 8) AS keys_a, count(*) FILTER (m > 0) AS keys_b, count(*) FILTER (m BETWEEN 1 AND 7) AS keys_both, 0 AS duplicates,
 count(*) FILTER (m BETWEEN 1 AND 7 AND c_custkey % 7 <> 0) AS identical, CAST(floor(100.0 * count(*) FILTER (m BETWEEN 1 AND 7 AND c_custkey % 7 <> 0) / count(*) FILTER (m BETWEEN 1 AND 7) + 0.5) AS INT) AS identical_pct
FROM (SELECT *, c_custkey % 10 AS m FROM customer)"""


@R.add("x_two_set_pairing", _TWO_SET)
def _(s, d):
    return X.two_set_pairing(snapshots(s, d), "c_custkey", "snap", "at")


R.add("join_two_set_full", _TWO_SET)(R["x_two_set_pairing"])


@R.add("agg_additivity", """
WITH w AS (SELECT l_returnflag AS f, l_linestatus AS s, 100.0 * count(*) / sum(count(*)) OVER (PARTITION BY l_returnflag) AS share FROM lineitem GROUP BY 1, 2)
SELECT 's' AS dim, count(*) AS groups, count(*) FILTER (abs(x - 100) <= 1) AS whole100, count(*) FILTER (abs(x - 1) <= 0.01) AS whole1, count(*) >= 2 AND count(*) FILTER (abs(x - 100) <= 1) >= 0.9 * count(*) AS part_of_whole FROM (SELECT f, sum(share) AS x FROM w GROUP BY 1 HAVING count(DISTINCT s) >= 2)""")
def _(s, d):
    from pyspark.sql import Window

    w = t(s, d, "lineitem").groupBy(F.col("l_returnflag").alias("f"), F.col("l_linestatus").alias("s")).agg(F.count("*").alias("n"))
    w = w.withColumn("share", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("f")))
    return X.additivity(w, "share", ["f", "s"]).filter("dim = 's'")


@R.add("leaf_cardinality", "SELECT count(*) AS leaf_cardinality FROM (SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem)")
def _(s, d):
    return X.leaf_cardinality(t(s, d, "lineitem"), DIMS)


@R.add("max_nonmeasure_card", "SELECT greatest(count(DISTINCT l_returnflag), count(DISTINCT l_linestatus), count(DISTINCT l_linenumber)) AS max_cardinality FROM lineitem")
def _(s, d):
    from quern.operators.profile import distinct_frame

    return distinct_frame(t(s, d, "lineitem"), DIMS).filter("value IS NOT NULL").groupBy("column").count().agg(F.max("count").alias("max_cardinality"))


@R.add("x_persistence", """
WITH p AS (SELECT event_type AS k, date_trunc('day', ts) AS tt, sum(value) AS y FROM events GROUP BY 1, 2),
i AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY tt) AS i, count(*) OVER (PARTITION BY k) AS n FROM p),
f AS (SELECT k, regr_slope(y, i) AS b, regr_intercept(y, i) AS a FROM i WHERE n >= 6 GROUP BY k),
e AS (SELECT i.k, i, y, y - a - b * i AS e FROM i JOIN f ON i.k = f.k),
g AS (SELECT k, y, e, abs(y - lag(y) OVER w) AS dy, (e - lag(e) OVER w) ** 2 AS de FROM e WINDOW w AS (PARTITION BY k ORDER BY i)),
h AS (SELECT k, median(dy) / median(abs(y)) AS r, sum(de) / sum(e * e) AS v FROM g GROUP BY k)
SELECT count(*) AS series_count, round(median(r), 6) AS rel_step, round(median(v), 6) AS vn_detrended FROM h""")
def _(s, d):
    return X.persistence(t(s, d, "events"), "event_type", F.date_trunc("day", "ts"), "value").select("series_count", F.round("rel_step", 6).alias("rel_step"), F.round("vn_detrended", 6).alias("vn_detrended"))


QUERIES, ORACLE_SQL = R, R.sql
