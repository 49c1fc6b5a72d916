"""Filters, joins, star measures and the query layer over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.operators import filters as L
from quern.operators import star as S
from quern.operators.ranks import in_turn, with_row_index
from quern.plans.common import Registry, t, union

R = Registry()

# --- filters


@R.add("filter_keys", "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE (o_orderstatus, o_orderpriority) IN (('F', '1-URGENT'), ('O', '5-LOW'))")
def _(s, d):
    f = L.Filter(("o_orderstatus", "o_orderpriority"))
    f.set([("F", "1-URGENT"), ("O", "5-LOW")])
    return f.keep(t(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"))


@R.add("filter_wildcard", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' OR o_orderpriority = '5-LOW'")
def _(s, d):
    f = L.Filter(("o_orderstatus", "o_orderpriority"))
    f.set([("F", L.ANY), (L.ANY, "5-LOW")])
    return f.keep(t(s, d, "orders")).select("o_orderkey")


R.add("dax_predicate", R.sql["filter_wildcard"])(R["filter_wildcard"])


@R.add("filter_any_column", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem WHERE l_partkey IN (3, 7) OR l_suppkey IN (3, 7)")
def _(s, d):
    f = L.Filter(("l_partkey",))
    f.set([(3,), (7,)])
    return f.keep_any(t(s, d, "lineitem"), ["l_partkey", "l_suppkey"]).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


@R.add("filter_set_ops")
def _(s, d):
    f = L.Filter(("o_orderstatus",))
    steps = [("set", f.set([("F",), ("F",), ("O",)]), f.version), ("same", f.set([("F",), ("O",)]), f.version), ("clear", f.clear(), f.version)]
    return s.createDataFrame(steps, "step string, changed boolean, version int")


@R.add("filter_scope_and", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey IN (1, 2, 3)")
def _(s, d):
    scope = L.Scope({"segment": L.Filter(("c_mktsegment",)), "nation": L.Filter(("c_nationkey",))})
    scope.filters["segment"].set([("BUILDING",)])
    scope.filters["nation"].set([(1,), (2,), (3,)])
    return scope.keep(t(s, d, "customer")).select("c_custkey")


@R.add("filter_group_exclusive", "SELECT count(*) AS n FROM orders WHERE o_orderpriority = '5-LOW'")
def _(s, d):
    scope = L.Scope({"a": L.Filter(("o_orderstatus",), group="g"), "b": L.Filter(("o_orderpriority",), group="g")})
    scope.pick("a", [("F",)])
    scope.pick("b", [("5-LOW",)])
    return scope.keep(t(s, d, "orders")).agg(F.count("*").alias("n"))


@R.add("filter_label_pick", """
SELECT 'l_returnflag' AS "column", 'R' AS value, true AS fixed
UNION ALL SELECT 'l_linestatus', CASE WHEN min(l_linestatus) FILTER (l_returnflag = 'R') = max(l_linestatus) FILTER (l_returnflag = 'R') AND min(l_linestatus) <> max(l_linestatus) THEN min(l_linestatus) FILTER (l_returnflag = 'R') END, min(l_linestatus) FILTER (l_returnflag = 'R') = max(l_linestatus) FILTER (l_returnflag = 'R') AND min(l_linestatus) <> max(l_linestatus) FROM lineitem""")
def _(s, d):
    return L.label_key(t(s, d, "lineitem"), F.col("l_returnflag") == "R", ["l_returnflag", "l_linestatus"])


@R.add("filter_scope_text")
def _(s, d):
    scope = L.Scope({"a": L.Filter(("o_orderstatus",)), "b": L.Filter(("o_orderpriority",))})
    scope.filters["b"].set([("1-URGENT",), ("2-HIGH",), ("3-MEDIUM",), ("5-LOW",)])
    return s.createDataFrame([(scope.text(),)], "text string")


@R.add("filter_narrowed", "SELECT count(*) FILTER (o_orderstatus = 'F') AS rows, count(*) AS high_water, count(*) FILTER (o_orderstatus = 'F') BETWEEN 1 AND count(*) - 1 AS is_narrowed, count(*) FILTER (o_orderstatus = 'F') = 0 AND count(*) > 0 AS is_emptied FROM orders")
def _(s, d):
    o = t(s, d, "orders")
    return L.narrowed(o.filter("o_orderstatus = 'F'"), o)


_CROSS = "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY 1"


@R.add("crossfilter", _CROSS)
def _(s, d):
    o, li = t(s, d, "orders").withColumnRenamed("o_orderkey", "k"), t(s, d, "lineitem").withColumnRenamed("l_orderkey", "k")
    return L.crossfilter({"orders": o, "lines": li}, "orders", o.filter("o_orderpriority = '1-URGENT'"), "k")["lines"].groupBy("l_returnflag").agg(F.count("*").alias("n"))


@R.add("join_semi_keys", _CROSS)
def _(s, d):
    keys = t(s, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    return t(s, d, "lineitem").join(keys, "l_orderkey", "left_semi").groupBy("l_returnflag").agg(F.count("*").alias("n"))


@R.add("rowmap_translate", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS source_row, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS payload_row FROM orders")
def _(s, d):
    """Positions of the same rows in two orders, without a one-task sort."""
    o = t(s, d, "orders").select("o_orderkey", in_turn(F.unix_micros(F.col("o_orderdate").cast("timestamp")), F.col("o_orderkey")).alias("by_date"))
    return with_row_index(with_row_index(o, "o_orderkey", "source_row"), "by_date", "payload_row").select("o_orderkey", "source_row", "payload_row")


_TOGGLE = "SELECT o_custkey, list_sort(list_distinct(list_concat(list_filter(a, lambda x: NOT list_contains(b, x)), list_filter(b, lambda x: NOT list_contains(a, x))))) AS selection FROM (SELECT o_custkey, list(o_orderkey) FILTER (o_orderkey % 3 > 0) AS a, list(o_orderkey) FILTER (o_orderkey % 2 > 0) AS b FROM orders GROUP BY 1) WHERE a IS NOT NULL AND b IS NOT NULL"


@R.add("selection_toggle", _TOGGLE)
def _(s, d):
    o = t(s, d, "orders").groupBy("o_custkey").agg(F.collect_list(F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderkey"))).alias("a"), F.collect_list(F.when(F.col("o_orderkey") % 2 > 0, F.col("o_orderkey"))).alias("b"))
    return o.filter("size(a) > 0 AND size(b) > 0").select("o_custkey", L.next_selection_columns(F.col("a"), F.col("b"), True).alias("selection"))


R.add("set_symmetric_toggle", _TOGGLE)(R["selection_toggle"])


@R.add("row_set_valid", "SELECT DISTINCT CAST(x AS BIGINT) AS x FROM (SELECT value - 100 AS x FROM events UNION ALL SELECT floor(value) FROM events) WHERE x >= 0 AND x = floor(x)")
def _(s, d):
    e = t(s, d, "events")
    return L.valid_rows(e.select((F.col("value") - 100).alias("x")).union(e.select(F.floor("value").cast("double"))), "x")


POLYGON = [(5.0, 1000.0), (45.0, 5000.0), (40.0, 60000.0), (20.0, 30000.0), (8.0, 50000.0)]


def _cross_sql(x: str, y: str) -> str:
    out = []
    for (x0, y0), (x1, y1) in zip(POLYGON, [*POLYGON[1:], POLYGON[0]], strict=True):
        out.append(f"CASE WHEN ({y0} > {y}) <> ({y1} > {y}) AND {x} < ({x1} - {x0}) * ({y} - {y0}) / ({y1} - {y0}) + {x0} THEN 1 ELSE 0 END")
    return " + ".join(out)


@R.add("lasso_polygon", f"SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM (SELECT *, CAST(l_quantity AS DOUBLE) AS x, CAST(l_extendedprice AS DOUBLE) AS y FROM lineitem) WHERE ({_cross_sql('x', 'y')}) % 2 = 1")
def _(s, d):
    return t(s, d, "lineitem").filter(L.inside_polygon(F.col("l_quantity"), F.col("l_extendedprice"), POLYGON)).select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")


@R.add("dax_wrap", "SELECT n_regionkey, count(*) AS n FROM nation WHERE n_regionkey IN (1, 2) GROUP BY 1 ORDER BY 1")
def _(s, d):
    f = L.Filter(("n_regionkey",))
    f.set([(1,), (2,)])
    return f.keep(t(s, d, "nation")).groupBy("n_regionkey").agg(F.count("*").alias("n")).orderBy("n_regionkey")


@R.add("missing_rows_drop", "SELECT count(*) FILTER (ok) AS kept, count(*) FILTER (NOT ok) AS dropped FROM (SELECT l_linenumber <> 3 AND l_returnflag <> 'A' AS ok FROM lineitem)")
def _(s, d):
    ok = F.when(F.col("l_linenumber") != 3, F.col("l_tax")).isNotNull() & F.nullif("l_returnflag", F.lit("A")).isNotNull()
    return t(s, d, "lineitem").agg(F.count_if(ok).alias("kept"), F.count_if(~ok).alias("dropped"))


@R.add("text_search_tiers", """
WITH r AS (SELECT doc_id, CASE WHEN regexp_matches(lower(source), '(^|[^\\p{L}\\p{M}\\p{N}])src1') THEN 1 WHEN contains(lower(source), 'src1') THEN 2 WHEN regexp_matches(lower(text), '(^|[^\\p{L}\\p{M}\\p{N}])src1') THEN 3 END AS tier FROM documents)
SELECT doc_id FROM r WHERE tier = (SELECT min(tier) FROM r)""")
def _(s, d):
    return L.search_tiers(t(s, d, "documents"), "src1", "source", "text").select("doc_id")


@R.add("project_roles", "SELECT n_name AS label, n_regionkey AS region FROM nation")
def _(s, d):
    return t(s, d, "nation").select(F.col("n_name").alias("label"), F.col("n_regionkey").alias("region"))


@R.add("view_token")
def _(s, d):
    scope = L.Scope({"a": L.Filter(("o_orderstatus", "o_orderpriority"))}, {"top": 5})
    scope.filters["a"].set([("F", L.ANY)])
    other = L.Scope({"a": L.Filter(("o_orderstatus", "o_orderpriority"))})
    ok = other.restore(scope.token())
    return s.createDataFrame([(scope.token(), ok, other.text(), other.restore("???"))], "token string, restored boolean, text string, bad_token boolean")


# --- joins


def sales(s, d):
    li, o, c, n, r = (t(s, d, x) for x in ("lineitem", "orders", "customer", "nation", "region"))
    return S.join_dims(S.join_dims(li, [(o, "l_orderkey", "o_orderkey")]), [(c, "o_custkey", "c_custkey"), (n, "c_nationkey", "n_nationkey"), (r, "n_regionkey", "r_regionkey")])


SALES = "lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey"


@R.add("join_star", f"SELECT r_name, c_mktsegment, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM {SALES} GROUP BY ALL")
def _(s, d):
    return sales(s, d).groupBy("r_name", "c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


LANES = "lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation a ON s_nationkey = a.n_nationkey JOIN nation b ON c_nationkey = b.n_nationkey"


def lanes(s, d):
    """Lines with origin (supplier) and destination (customer) nation: one dimension in two roles."""
    n = t(s, d, "nation")
    a, b = n.select(F.col("n_nationkey").alias("ak"), F.col("n_name").alias("origin")), n.select(F.col("n_nationkey").alias("bk"), F.col("n_name").alias("destination"))
    rows = t(s, d, "lineitem").join(t(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(t(s, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.join(F.broadcast(a), F.col("s_nationkey") == F.col("ak")).join(F.broadcast(b), F.col("c_nationkey") == F.col("bk"))


@R.add("join_role_playing", f"SELECT a.n_name AS origin, b.n_name AS destination, sum(l_quantity) AS units FROM {LANES} GROUP BY ALL")
def _(s, d):
    return lanes(s, d).groupBy("origin", "destination").agg(F.sum("l_quantity").alias("units"))


@R.add("join_feature_match", "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def _(s, d):
    by = t(s, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    return by.join(F.broadcast(t(s, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "n")


def monthly(s, d):
    return t(s, d, "orders").groupBy(F.trunc("o_orderdate", "month").alias("month")).agg(F.sum("o_totalprice").alias("revenue"))


MONTHLY = "SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, sum(o_totalprice) AS revenue FROM orders GROUP BY 1"
_YOY = f"WITH m AS ({MONTHLY}) SELECT m.month, round(m.revenue, 2) AS revenue, round(p.revenue, 2) AS prior, round(m.revenue - p.revenue, 2) AS change, round((m.revenue - p.revenue) / nullif(p.revenue, 0), 6) AS change_pct FROM m LEFT JOIN m p ON p.month + INTERVAL 12 MONTH = m.month"


@R.add("measure_yoy", _YOY)
def _(s, d):
    p = S.prior_year(monthly(s, d), [], "month", "revenue")
    return p.select("month", *(F.round(c, 6 if c == "change_pct" else 2).alias(c) for c in ("revenue", "prior", "change", "change_pct")))


R.add("join_prior_period", _YOY)(R["measure_yoy"])
R.add("t_yoy", _YOY)(R["measure_yoy"])

# --- aggregates


@R.add("agg_kinds", "SELECT l_returnflag, sum(l_quantity) AS sum_q, round(avg(l_tax), 9) AS avg_q, median(l_quantity) AS median_q, min(l_tax) AS min_q, max(l_tax) AS max_q, count(l_tax) AS count_q, count(DISTINCT l_quantity) AS distinct_q, min(l_orderkey) AS first_q FROM lineitem GROUP BY 1")
def _(s, d):
    k = lambda c, kind: L.reduce_kind(F.col(c), kind, F.col("l_orderkey"))
    return t(s, d, "lineitem").groupBy("l_returnflag").agg(k("l_quantity", "sum").alias("sum_q"), F.round(k("l_tax", "average"), 9).alias("avg_q"), k("l_quantity", "median").alias("median_q"), k("l_tax", "min").alias("min_q"), k("l_tax", "max").alias("max_q"), k("l_tax", "count").alias("count_q"), k("l_quantity", "distinctcount").alias("distinct_q"), k("l_orderkey", "first").alias("first_q"))


@R.add("agg_reduce", "SELECT l_linestatus, count(x) AS n, count(DISTINCT x) + max(CASE WHEN x IS NULL THEN 1 ELSE 0 END) AS distinct_n, round(sum(x), 4) AS total FROM (SELECT l_linestatus, CASE WHEN l_linenumber <> 3 THEN l_tax END AS x FROM lineitem) GROUP BY 1")
def _(s, d):
    df = t(s, d, "lineitem").withColumn("x", F.when(F.col("l_linenumber") != 3, F.col("l_tax")))
    return df.groupBy("l_linestatus").agg(L.reduce_kind(F.col("x"), "count").alias("n"), L.reduce_kind(F.col("x"), "distinctcount").alias("distinct_n"), F.round(L.reduce_kind(F.col("x"), "sum"), 4).alias("total"))


@R.add("agg_share_honest", "SELECT l_returnflag, sum(l_quantity) AS total, round(sum(l_quantity) / sum(sum(l_quantity)) OVER (), 9) AS share FROM lineitem GROUP BY 1")
def _(s, d):
    g = t(s, d, "lineitem").groupBy("l_returnflag").agg(F.sum("l_quantity").alias("total"))
    return g.crossJoin(F.broadcast(g.agg(F.sum("total").alias("all")))).select("l_returnflag", "total", F.round(F.col("total") / F.col("all"), 9).alias("share"))  # one row


@R.add("selection_card", """SELECT count(*) FILTER (sel) AS rows_selected, count(*) AS rows_total, sum(l_quantity) FILTER (sel) AS l_quantity_sum, round(100.0 * sum(l_quantity) FILTER (sel) / sum(l_quantity), 9) AS l_quantity_sum_pct,
 round(avg(l_discount) FILTER (sel), 9) AS l_discount_average, count(DISTINCT l_returnflag) FILTER (sel) AS l_returnflag_distinct, CASE WHEN min(l_returnflag) FILTER (sel) = max(l_returnflag) FILTER (sel) THEN min(l_returnflag) FILTER (sel) END AS l_returnflag_only,
 count(DISTINCT l_linestatus) FILTER (sel) AS l_linestatus_distinct, CASE WHEN min(l_linestatus) FILTER (sel) = max(l_linestatus) FILTER (sel) THEN min(l_linestatus) FILTER (sel) END AS l_linestatus_only FROM (SELECT *, l_returnflag = 'R' AS sel FROM lineitem)""")
def _(s, d):
    c = L.selection_card(t(s, d, "lineitem"), F.col("l_returnflag") == "R", [("l_quantity", "sum"), ("l_discount", "average")], ["l_returnflag", "l_linestatus"])
    return c.withColumn("l_quantity_sum_pct", F.round("l_quantity_sum_pct", 9)).withColumn("l_discount_average", F.round("l_discount_average", 9))


ROLES = {"region": S.Role("r_name"), "segment": S.Role("c_mktsegment"), "units": S.Role(measure=lambda: F.sum("l_quantity")), "aov": S.Role(measure=lambda: F.round(F.try_divide(F.sum("l_extendedprice"), F.countDistinct("l_orderkey")), 6))}
_ROLE_SQL = f"SELECT r_name AS region, sum(l_quantity) AS units, round(sum(l_extendedprice) / count(DISTINCT l_orderkey), 6) AS aov FROM {SALES} WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY 1 ORDER BY 1"


@R.add("q_build", _ROLE_SQL)
def _(s, d):
    return S.build_query(sales(s, d), S.QueryDef(["region", "units", "aov"], selects=["region"]), ROLES, {"segment": ["BUILDING", "MACHINERY"], "region": ["none"]})


R.add("groupby_roles", _ROLE_SQL)(R["q_build"])


@R.add("groupby_sample", "SELECT o_orderstatus, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, sum(o_totalprice) / nullif(count(*), 0) AS aov FROM orders GROUP BY ALL")
def _(s, d):
    return t(s, d, "orders").groupBy("o_orderstatus", F.trunc("o_orderdate", "month").alias("month")).agg(F.try_divide(F.sum("o_totalprice"), F.count("*")).alias("aov"))


@R.add("measure_sum", "SELECT l_returnflag, sum(l_quantity) AS units, round(sum(l_extendedprice), 2) AS revenue, count(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY 1")
def _(s, d):
    return t(s, d, "lineitem").groupBy("l_returnflag").agg(F.sum("l_quantity").alias("units"), F.round(F.sum("l_extendedprice"), 2).alias("revenue"), F.countDistinct("l_orderkey").alias("orders"))


@R.add("measure_ratio", "SELECT l_returnflag, sum(l_extendedprice) / nullif(sum(l_quantity), 0) AS per_unit, sum(l_tax) / nullif(sum(l_quantity * 0), 0) AS over_zero FROM lineitem GROUP BY 1")
def _(s, d):
    df = t(s, d, "lineitem").withColumn("zero", F.col("l_quantity") * 0)
    return df.groupBy("l_returnflag").agg(S.ratio("l_extendedprice", "l_quantity").alias("per_unit"), S.ratio("l_tax", "zero").alias("over_zero"))


@R.add("measure_semi_additive", "SELECT o_orderstatus, avg(x) AS headcount FROM (SELECT o_orderstatus, date_trunc('month', o_orderdate), sum(o_totalprice) AS x FROM orders GROUP BY ALL) GROUP BY 1")
def _(s, d):
    return S.semi_additive(t(s, d, "orders"), ["o_orderstatus"], F.trunc("o_orderdate", "month"), "o_totalprice", "headcount")


@R.add("measure_weighted_avg", "SELECT l_shipmode, sum(l_discount * l_quantity) / nullif(sum(l_quantity), 0) AS weighted FROM (SELECT *, l_linestatus AS l_shipmode FROM lineitem) GROUP BY 1")
def _(s, d):
    return t(s, d, "lineitem").groupBy(F.col("l_linestatus").alias("l_shipmode")).agg(S.weighted_average("l_discount", "l_quantity").alias("weighted"))


@R.add("measure_distinct_pairs", f"SELECT count(DISTINCT (a.n_name, b.n_name)) AS lanes FROM {LANES}")
def _(s, d):
    return lanes(s, d).agg(F.countDistinct("origin", "destination").alias("lanes"))


@R.add("measure_vs_target", """WITH a AS (SELECT c_nationkey AS k, round(sum(c_acctbal), 2) AS actual FROM customer GROUP BY 1), b AS (SELECT s_nationkey AS k, round(sum(s_acctbal), 2) AS target FROM supplier GROUP BY 1)
SELECT k AS nation, actual, target, round(actual - target, 2) AS gap FROM a FULL JOIN b USING (k)""")
def _(s, d):
    """Two facts, each summed to the grain first, so that neither fans out."""
    a = t(s, d, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.round(F.sum("c_acctbal"), 2).alias("actual"))
    b = t(s, d, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.round(F.sum("s_acctbal"), 2).alias("target"))
    return a.join(b, "nation", "full").withColumn("gap", F.round(F.col("actual") - F.col("target"), 2))


_ROLLUP = "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS units, grouping(l_returnflag) > 0 AS is_total FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), ())"


@R.add("rollup_split", _ROLLUP)
def _(s, d):
    return S.rollup_total(t(s, d, "lineitem"), ["l_returnflag", "l_linestatus"], [F.sum("l_quantity").alias("units")])


@R.add("q_rollup", "SELECT l_returnflag, sum(l_quantity) AS units FROM lineitem GROUP BY 1 UNION ALL SELECT 'total', sum(l_quantity) FROM lineitem")
def _(s, d):
    r = t(s, d, "lineitem").rollup("l_returnflag").agg(F.sum("l_quantity").alias("units"), (F.grouping("l_returnflag") > 0).alias("flag"))
    body, total = S.split_rollup(r, ["flag"])
    return body.union(total.withColumn("l_returnflag", F.lit("total")))


@R.add("q_cache", "SELECT 1 AS hits, 1 AS invalidated, count(*) AS n FROM nation")
def _(s, d):
    cache = S.QueryCache(2)
    run = lambda: t(s, d, "nation").agg(F.count("*").alias("n"))
    cache.get("a", "q", {"x": 1}, run)
    found = cache.get("a", "q", {"x": 1}, run)
    gone = cache.invalidate("a")
    return found.select(F.lit(cache.hits).alias("hits"), F.lit(gone).alias("invalidated"), "n")


@R.add("q_active_filters")
def _(s, d):
    f = L.Filter(("o_orderstatus", "o_orderpriority"))
    f.set([("F", L.ANY), ("O", "5-LOW")])
    return s.createDataFrame([("status", [k[0] for k in f.keys])], "role string, values array<string>")


@R.add("bin_histogram", """WITH p AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, CAST(greatest(4, least(24, floor(sqrt(count(*)) + 0.5))) AS INT) AS k FROM lineitem)
SELECT CAST(least(floor((l_extendedprice - lo) / ((hi - lo) / k)), k - 1) AS INT) AS bin, count(*) AS n FROM lineitem, p GROUP BY 1""")
def _(s, d):
    from quern.operators.analytics import histogram

    return histogram(t(s, d, "lineitem"), "l_extendedprice")


@R.add("frequency", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1")
def _(s, d):
    return t(s, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "o_orderpriority")


@R.add("single_value_card", "SELECT round(sum(o_totalprice), 2) AS value FROM orders")
def _(s, d):
    return t(s, d, "orders").agg(F.round(F.sum("o_totalprice"), 2).alias("value"))


@R.add("agg_region", "SELECT n_name AS iso, round(avg(c_acctbal), 6) AS value FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def _(s, d):
    return t(s, d, "customer").join(F.broadcast(t(s, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("iso")).agg(F.round(F.avg("c_acctbal"), 6).alias("value"))


@R.add("value_column")
def _(s, d):
    """The column to show: numeric, no identifier; here the measure with most distinct values."""
    from quern.operators.profile import blank_distinct, is_identifier_name, numeric_columns

    li = t(s, d, "lineitem")
    names = [c for c in numeric_columns(li) if not is_identifier_name(c)]
    return blank_distinct(li, names).orderBy(F.col("distinct_count").desc(), "column").limit(1)


# --- sorts, windows, sets

R.add("sort_query", _ROLE_SQL)(R["q_build"])


@R.add("sort_ranking", """SELECT n_regionkey, n_name, round(v, 2) AS value, CAST(row_number() OVER (ORDER BY tt DESC, n_regionkey, v DESC, n_name) AS INT) AS place FROM (SELECT n_regionkey, n_name, sum(c_acctbal) AS v, sum(sum(c_acctbal)) OVER (PARTITION BY n_regionkey) AS tt FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)""")
def _(s, d):
    v = t(s, d, "customer").join(F.broadcast(t(s, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey", "n_name").agg(F.sum("c_acctbal").alias("v"))
    ranked = v.withColumn("tt", F.sum("v").over(Window.partitionBy("n_regionkey"))).filter("v IS NOT NULL")
    place = F.row_number().over(Window.orderBy(F.col("tt").desc(), "n_regionkey", F.col("v").desc(), "n_name"))  # a row a nation
    return ranked.select("n_regionkey", "n_name", F.round("v", 2).alias("value"), place.alias("place"))


R.add("an_ranking", R.sql["sort_ranking"])(R["sort_ranking"])


@R.add("limit_sample", "SELECT event_id, event_type FROM events ORDER BY event_id LIMIT 25")
def _(s, d):
    return t(s, d, "events").select("event_id", "event_type").orderBy("event_id").limit(25)


@R.add("win_lag_compare", "SELECT user_id, count(*) FILTER (ts - p > INTERVAL 1 DAY) AS gaps FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) GROUP BY 1")
def _(s, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = t(s, d, "events").withColumn("p", F.lag("ts").over(w))
    return e.groupBy("user_id").agg(F.count_if(F.expr("ts - p > INTERVAL 1 DAY")).alias("gaps"))


@R.add("win_rank_avg", "SELECT o_orderkey, rank() OVER (PARTITION BY o_orderstatus ORDER BY o_custkey) + (count(*) OVER (PARTITION BY o_orderstatus, o_custkey) - 1) / 2.0 AS avg_rank FROM orders")
def _(s, d):
    """Average ranks from counts per value: values are ordered in ranges, not rows in one task a group."""
    from quern.operators.ranks import running_sum

    o = t(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_custkey")
    counts = running_sum(o.groupBy("o_orderstatus", "o_custkey").agg(F.count("*").alias("c")), ["o_orderstatus"], "o_custkey", "c", "upto")
    return o.join(counts, ["o_orderstatus", "o_custkey"]).select("o_orderkey", (F.col("upto") - F.col("c") + 1 + (F.col("c") - 1) / 2.0).alias("avg_rank"))


@R.add("win_tercile", "SELECT c_custkey, CAST(ntile(3) OVER (ORDER BY c_acctbal, c_custkey) - 1 AS INT) AS tercile FROM customer")
def _(s, d):
    c = t(s, d, "customer").select("c_custkey", F.col("c_acctbal").alias("b"))
    i = with_row_index(c.select("c_custkey", in_turn(F.round(F.col("b") * 100).cast("long"), F.col("c_custkey")).alias("key")), "key", "i")
    n = c.agg(F.count("*").alias("n"))
    big, small = F.col("n") % 3, F.floor(F.col("n") / 3)
    at = F.when(F.col("i") < big * (small + 1), F.floor(F.col("i") / (small + 1))).otherwise(big + F.floor((F.col("i") - big * (small + 1)) / small))
    return i.crossJoin(F.broadcast(n)).select("c_custkey", at.cast("int").alias("tercile"))  # one row


@R.add("set_distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def _(s, d):
    return t(s, d, "lineitem").select("l_returnflag", "l_linestatus").distinct()


@R.add("set_column_union", "SELECT n_nationkey AS k, n_name AS name, NULL AS extra FROM nation UNION ALL SELECT r_regionkey, NULL, r_name FROM region")
def _(s, d):
    a = t(s, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    b = t(s, d, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("extra"))
    return a.unionByName(b, allowMissingColumns=True)


QUERIES, ORACLE_SQL = R, R.sql
