"""Per-column profile statistics over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import profile as P
from quern.operators.ranks import order_statistics
from quern.plans.common import Registry, js_number_sql, t, union

R = Registry()
L_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
L_CAT = ["l_returnflag", "l_linestatus", "l_quantity", "l_discount"]


def lineitem(spark, sf, blanks=True):
    """Lineitem with injected blanks: no table of the driver has any."""
    df = t(spark, sf, "lineitem")
    return df.withColumn("l_returnflag", F.nullif("l_returnflag", F.lit("A"))).withColumn("l_discount", F.when(F.col("l_linenumber") != 3, F.col("l_discount"))) if blanks else df


L_SQL = "(SELECT * REPLACE (nullif(l_returnflag, 'A') AS l_returnflag, CASE WHEN l_linenumber <> 3 THEN l_discount END AS l_discount) FROM lineitem) AS lineitem"


def text_sql(c: str) -> str:
    return js_number_sql(c) if c in L_NUM else c


def distinct_sql(cols, table=L_SQL) -> str:
    return union(f"SELECT '{c}' AS \"column\", {text_sql(c)} AS value, count(*) AS n FROM {table} GROUP BY 2" for c in cols)


@R.add("prof_blank_distinct", f"SELECT \"column\", CAST(coalesce(sum(n) FILTER (value IS NULL), 0) AS BIGINT) AS blank_count, count(*) AS distinct_count FROM ({distinct_sql(L_CAT)}) GROUP BY 1")
def _(s, d):
    return P.blank_distinct(lineitem(s, d), L_CAT)


@R.add("prof_modal_share", f"SELECT \"column\", max(n) / sum(n) AS modal_share FROM ({distinct_sql(L_CAT)}) WHERE value IS NOT NULL GROUP BY 1")
def _(s, d):
    return P.modal_share(lineitem(s, d), L_CAT).select("column", "modal_share")


@R.add("prof_min_group", f"SELECT \"column\", min(n) AS min_group FROM ({distinct_sql(L_CAT)}) WHERE value IS NOT NULL GROUP BY 1")
def _(s, d):
    return P.modal_share(lineitem(s, d), L_CAT).select("column", "min_group")


def moment_sql(expr: str, name: str) -> str:
    return union(f"SELECT '{c}' AS \"column\", {expr.replace('$', c)} AS {name} FROM {L_SQL}" for c in L_NUM)


def moment(name):
    return lambda s, d: P.moments(lineitem(s, d), L_NUM).select("column", F.round(name, 6).alias(name) if name != "sum" else F.round(name, 2).alias(name))


R.add("prof_avg", moment_sql("round(avg($), 6)", "avg"))(moment("avg"))
R.add("prof_sum", moment_sql("round(sum($), 2)", "sum"))(moment("sum"))
R.add("prof_stddev", moment_sql("round(stddev_pop($), 6)", "stddev"))(moment("stddev"))
R.add("prof_skewness", moment_sql("round((avg($*$*$) - 3*avg($)*avg($*$) + 2*avg($)**3) / var_pop($)**1.5, 5)", "skewness"))(lambda s, d: P.moments(lineitem(s, d), L_NUM).select("column", F.round("skewness", 5).alias("skewness")))


@R.add("prof_minmax", "SELECT min(o_totalprice) AS min_price, max(o_totalprice) AS max_price, strftime(min(o_orderdate), '%Y-%m-%dT%H:%M:%S.000Z') AS min_date, strftime(max(o_orderdate), '%Y-%m-%dT%H:%M:%S.000Z') AS max_date FROM orders")
def _(s, d):
    iso = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
    o = t(s, d, "orders")
    return o.agg(F.min("o_totalprice").alias("min_price"), F.max("o_totalprice").alias("max_price"), F.date_format(F.min("o_orderdate"), iso).alias("min_date"), F.date_format(F.max("o_orderdate"), iso).alias("max_date"))


@R.add("prof_median", "SELECT count(o_totalprice) AS n, round(median(o_totalprice), 6) AS median FROM orders")
def _(s, d):
    return P.median(t(s, d, "orders"), "o_totalprice").select("n", F.round("median", 6).alias("median"))


FLOOR_SQL = "(list(x ORDER BY x))[CAST(floor((count(*) - 1) * {p}) AS INT) + 1] AS {k}"


def floor_sql(source: str, groups: str = "", having: str = "") -> str:
    cols = ", ".join(FLOOR_SQL.format(p=p, k=k) for k, p in (("p05", 0.05), ("p25", 0.25), ("p75", 0.75), ("p95", 0.95)))
    return f"SELECT {groups}{', ' if groups else ''}count(*) AS n, {cols} FROM ({source}) WHERE x IS NOT NULL {'GROUP BY ' + groups if groups else ''} {having}"


@R.add("prof_quantiles", floor_sql("SELECT l_returnflag, l_extendedprice AS x FROM lineitem", "l_returnflag", "HAVING count(*) >= 8"))
def _(s, d):
    return P.quantiles(t(s, d, "lineitem"), "l_extendedprice", ["l_returnflag"])


@R.add("prof_precision", union(f"SELECT '{c}' AS \"column\", coalesce(max(length(regexp_extract({js_number_sql(c)}, '\\.(\\d+)$', 1))), 0) AS precision FROM lineitem" for c in L_NUM))
def _(s, d):
    return P.precision(t(s, d, "lineitem"), L_NUM)


@R.add("prof_avg_length", union(f"SELECT '{c}' AS \"column\", avg(length({c})) AS avg_length FROM {tb}" for c, tb in (("p_name", "part"), ("p_brand", "part"), ("p_type", "part"))))
def _(s, d):
    return P.average_length(t(s, d, "part"), ["p_name", "p_brand", "p_type"])


@R.add("prof_top_categories", """
WITH v AS (SELECT 'o_orderpriority' AS "column", o_orderpriority AS value, count(*) AS n, min(o_orderkey) AS f FROM orders GROUP BY 2
           UNION ALL SELECT 'o_orderstatus', o_orderstatus, count(*), min(o_orderkey) FROM orders GROUP BY 2
           UNION ALL SELECT 'o_orderdate', strftime(o_orderdate, '%Y-%m-%d'), count(*), min(o_orderkey) FROM orders GROUP BY 2)
SELECT * FROM (SELECT "column", CAST(row_number() OVER (PARTITION BY "column" ORDER BY n DESC, f, value) AS INT) AS rank, value, n FROM v) WHERE rank <= 10""")
def _(s, d):
    return P.top_categories(t(s, d, "orders"), ["o_orderpriority", "o_orderstatus", "o_orderdate"], "o_orderkey")


R.add("topk_categories", R.sql["prof_top_categories"])(R["prof_top_categories"])


@R.add("prof_sorted_direction", """
WITH r AS (SELECT event_id, ts, lag(ts) OVER (ORDER BY event_id) AS p FROM events)
SELECT CASE WHEN count(*) < 3 THEN 'none' WHEN bool_and(ts >= p) THEN 'asc' WHEN bool_and(ts <= p) THEN 'desc' ELSE 'none' END AS direction FROM r""")
def _(s, d):
    return P.sorted_direction(t(s, d, "events"), "ts", "event_id")


@R.add("prof_binary_flag", """
SELECT 'quality' AS "column", count(DISTINCT quality) = 2 AND min(quality) = 0 AND max(quality) = 1 AS is_flag FROM labels
UNION ALL SELECT 'toxic', count(DISTINCT toxic) = 2 AND min(toxic) = 0 AND max(toxic) = 1 FROM labels
UNION ALL SELECT 'doc_id', count(DISTINCT doc_id) = 2 FROM labels""")
def _(s, d):
    return P.binary_flags(t(s, d, "labels"), ["quality", "toxic", "doc_id"])


@R.add("prof_datetime_flags", """
SELECT 'o_orderdate' AS "column", bool_or(o_orderdate <> date_trunc('day', o_orderdate)) AS date_with_time, false AS time_of_day_only FROM orders""")
def _(s, d):
    return P.datetime_flags(t(s, d, "orders"), ["o_orderdate"])


NATURE = ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_orderkey"]


@R.add("prof_value_nature", union(f"""SELECT '{c}' AS "column", CASE
  WHEN count(DISTINCT {c}) / (max({c}) - min({c}) + 1) >= 0.9 AND min({c}) >= 0 AND max({c}) <= 20 THEN 'Ordinal'
  WHEN count(DISTINCT {c}) > 12 AND ({'true' if c in L_NUM else f'count(DISTINCT {c}) >= 100 OR count(DISTINCT {c}) / count(*) >= 0.3'}) AND NOT ({'false' if c in L_NUM else 'true'} AND count(DISTINCT {c}) = count(*) AND max({c}) - min({c}) + 1 = count(*)) THEN 'Continuous'
  ELSE 'Categorical' END AS nature FROM lineitem""" for c in NATURE))
def _(s, d):
    return P.natures(t(s, d, "lineitem"), NATURE)


@R.add("prof_promote_measure")
def _(s, d):
    """Numeric dimensions that read as measured quantities."""
    return P.natures(t(s, d, "lineitem"), NATURE).filter("nature = 'Continuous'")


@R.add("prof_inferred_flags")
def _(s, d):
    return P.natures(t(s, d, "lineitem"), NATURE).select("column", (F.col("nature") == "Continuous").alias("becomes_measure"))


@R.add("prof_format_signature", """
SELECT 'c_mktsegment' AS "column", CASE WHEN avg(CASE WHEN regexp_full_match(v, '[A-Z][A-Z0-9]*') THEN 1 ELSE 0 END) >= 0.7 THEN CASE WHEN min(length(v)) = max(length(v)) THEN 'ALL_UPPER_FIXED_' || min(length(v)) ELSE 'ALL_UPPER' END ELSE 'MIXED' END AS format FROM (SELECT DISTINCT c_mktsegment AS v FROM customer)
UNION ALL SELECT 'url', CASE WHEN avg(CASE WHEN v LIKE 'http%' THEN 1 ELSE 0 END) >= 0.7 THEN 'URL_LIKE' ELSE 'MIXED' END FROM (SELECT DISTINCT url AS v FROM pages)
""")
def _(s, d):
    parts = [P.format_signatures(t(s, d, tb), [c]) for tb, c in (("customer", "c_mktsegment"), ("pages", "url"))]
    return parts[0].union(parts[1])


@R.add("prof_free_text")
def _(s, d):
    from quern.functions.text import signature

    docs = t(s, d, "documents")
    return docs.select("doc_id", P.free_text(signature(F.col("text")), F.length("text")).alias("free_text"))


@R.add("prof_source_annotate")
def _(s, d):
    """Descriptions joined to columns by name, exact first, then without case."""
    names = s.createDataFrame([(c, c.lower()) for c in t(s, d, "orders").columns], "column string, folded string")
    notes = s.createDataFrame([("O_TOTALPRICE", "$,.2f", "order total"), ("o_orderdate", "yyyy-mm-dd", "placed on")], "name string, format string, description string")
    return names.join(F.broadcast(notes), F.lower("name") == F.col("folded"), "left").select("column", "format", "description")


@R.add("prof_safe_distinct", """
SELECT 'l_returnflag' AS "column", list(v ORDER BY v) AS "values" FROM (SELECT DISTINCT l_returnflag AS v FROM lineitem) HAVING bool_and(length(v) = 1) AND count(*) <= 15
UNION ALL SELECT 'l_linestatus', list(v ORDER BY v) FROM (SELECT DISTINCT l_linestatus AS v FROM lineitem) HAVING bool_and(length(v) = 1) AND count(*) <= 15""")
def _(s, d):
    v = P.distinct_frame(t(s, d, "lineitem"), ["l_returnflag", "l_linestatus"]).filter("value IS NOT NULL")
    safe = (F.length("value") == 1) | (F.col("value").rlike(r"^[A-Za-z]?\d{1,9}$"))
    # a column with more than 15 values is out before its values are gathered
    few = v.groupBy("column").agg(F.bool_and(safe).alias("safe"), F.count("*").alias("d")).filter("safe AND d <= 15")
    return v.join(F.broadcast(few), "column").groupBy("column").agg(F.sort_array(F.collect_list("value")).alias("values"))


@R.add("x_relative_dispersion", """
SELECT count(x) AS n, floor((quantile_cont(x, 0.9) - quantile_cont(x, 0.1)) / abs(quantile_cont(x, 0.5)) * 1000 + 0.5) / 1000 AS dispersion FROM (SELECT l_extendedprice AS x FROM lineitem)""")
def _(s, d):
    from quern.operators.cross import relative_dispersion

    return relative_dispersion(t(s, d, "lineitem"), "l_extendedprice")


@R.add("f_quantile", "SELECT l_linestatus, count(*) AS n, round(quantile_cont(l_extendedprice, 0.1), 6) AS p10, round(quantile_cont(l_extendedprice, 0.9), 6) AS p90 FROM lineitem GROUP BY 1")
def _(s, d):
    q = order_statistics(t(s, d, "lineitem"), ["l_linestatus"], "l_extendedprice", {"p10": 0.1, "p90": 0.9}, "linear")
    return q.select("l_linestatus", "n", F.round("p10", 6).alias("p10"), F.round("p90", 6).alias("p90"))


QUERIES, ORACLE_SQL = R, R.sql
