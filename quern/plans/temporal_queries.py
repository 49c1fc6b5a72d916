"""Time axes over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions.text import excel_serial
from quern.operators import temporal as T
from quern.plans.common import Registry, t

R = Registry()


@R.add("t_classify", """SELECT count(*) AS sampled, avg(CASE WHEN v SIMILAR TO '(19|20)[0-9]{2}-(0[1-9]|1[0-2])' THEN 1.0 ELSE 0 END) AS share, true AS is_temporal FROM (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS v FROM orders ORDER BY 1 LIMIT 60)""")
def _(s, d):
    return T.classify_text(t(s, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("m")), "m")


_FORMS = {"iso": ("yyyy-MM-dd", "%Y-%m-%d"), "month": ("yyyy-MM", "%Y-%m"), "compact": ("yyyyMMdd", "%Y%m%d"), "yyyymm": ("yyyyMM", "%Y%m"), "word": ("MMM yyyy", "%b %Y"), "year": ("yyyy", "%Y")}


@R.add("t_parse_point", "SELECT o_orderkey, o_orderdate::TIMESTAMP AS iso, date_trunc('month', o_orderdate)::TIMESTAMP AS month, o_orderdate::TIMESTAMP AS compact, date_trunc('month', o_orderdate)::TIMESTAMP AS yyyymm, date_trunc('month', o_orderdate)::TIMESTAMP AS word, date_trunc('year', o_orderdate)::TIMESTAMP AS year, date_trunc('quarter', o_orderdate)::TIMESTAMP AS quarter, CAST(NULL AS TIMESTAMP) AS other FROM orders WHERE o_orderdate = date_trunc('day', o_orderdate)")
def _(s, d):
    o = t(s, d, "orders").filter("o_orderdate = date_trunc('day', o_orderdate)")
    point = lambda c: T.parse_point(c).cast("timestamp_ntz")
    return o.select("o_orderkey", *(point(F.date_format("o_orderdate", f)).alias(k) for k, (f, _) in _FORMS.items()), point(F.concat(F.year("o_orderdate").cast("string"), F.lit("-Q"), F.quarter("o_orderdate").cast("string"))).alias("quarter"), point(F.lit("soon")).alias("other"))


@R.add("t_cadence", """WITH p AS (SELECT DISTINCT o_orderdate AS x FROM orders), g AS (SELECT x, lag(x) OVER (ORDER BY x) AS p FROM p), m AS (SELECT median(epoch_us(x) - epoch_us(p)) AS step FROM g),
u AS (SELECT x, step / 864e8 BETWEEN 0.95 AND 1.05 AS daily, CASE WHEN step / 864e8 BETWEEN 0.95 AND 1.05 THEN datediff('day', p, x) ELSE round(epoch_us(x) / step) - round(epoch_us(p) / step) END AS u FROM g, m)
SELECT CASE WHEN bool_and(daily) THEN 'day' ELSE 'irregular' END AS grain, count(*) AS points, CASE WHEN bool_and(daily) THEN datediff('day', min(x), max(x)) + 1 END AS expected_points,
 CASE WHEN bool_and(daily) THEN floor(1000.0 * count(*) / (datediff('day', min(x), max(x)) + 1) + 0.5) / 10 END AS coverage_pct, count(*) FILTER (u > 5) + 1 AS runs, CAST(max(u) AS BIGINT) AS largest_gap FROM u""")
def _(s, d):
    return T.cadence(t(s, d, "orders"), "o_orderdate").drop("first", "last")


@R.add("t_period_start", "SELECT o_orderkey, date_trunc('week', o_orderdate)::TIMESTAMP AS week, date_trunc('month', o_orderdate)::TIMESTAMP AS month, date_trunc('quarter', o_orderdate)::TIMESTAMP AS quarter, date_trunc('year', o_orderdate)::TIMESTAMP AS year FROM orders")
def _(s, d):
    return t(s, d, "orders").select("o_orderkey", *(T.period_start(F.col("o_orderdate"), g).cast("timestamp_ntz").alias(g) for g in ("week", "month", "quarter", "year")))


@R.add("t_units_between", """SELECT o_orderkey, datediff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS day, datediff('month', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS month, datediff('quarter', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS quarter, datediff('year', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS year,
 (SELECT count(*) FROM range(1, 1 + datediff('day', DATE '1995-01-02', CAST(o_orderdate AS DATE))) q(k) WHERE isodow(DATE '1995-01-02' + CAST(k AS INT)) <= 5) AS weekday FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-02' AND o_orderkey % 97 < 97 AND isodow(o_orderdate) <= 5""")
def _(s, d):
    o = t(s, d, "orders").filter("o_orderdate >= timestamp'1995-01-02' AND weekday(o_orderdate) < 5")
    base = {g: F.lit("1995-01-02" if g == "weekday" else "1995-01-01").cast("timestamp") for g in ("day", "month", "quarter", "year", "weekday")}
    stamp = F.col("o_orderdate").cast("timestamp")
    return o.select("o_orderkey", *((T.unit_number(stamp, g) - T.unit_number(b, g)).alias(g) for g, b in base.items()))


_COMPLETE = """WITH p AS (SELECT DISTINCT event_type AS series, datediff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS u FROM events WHERE NOT (event_type = 'view' AND day(ts) BETWEEN 10 AND 14)), s AS (SELECT min(u) AS a, max(u) AS b FROM p), g AS (SELECT *, u - lag(u) OVER (PARTITION BY series ORDER BY u) - 1 AS gap FROM p)
SELECT series, count(*) AS points, min(u) - a AS late, b - max(u) AS early, max(u) - min(u) + 1 - count(*) AS holes, coalesce(max(gap), 0) AS largest_gap, count(*) / (b - a + 1) AS coverage FROM g, s GROUP BY series, a, b ORDER BY coverage, series LIMIT 8"""


@R.add("x_series_completeness", _COMPLETE)
def _(s, d):
    e = t(s, d, "events").filter("NOT (event_type = 'view' AND day(ts) BETWEEN 10 AND 14)")
    return T.series_completeness(e, "event_type", "ts", "day")


R.add("topk_worst_series", _COMPLETE)(R["x_series_completeness"])


@R.add("x_series_key")
def _(s, d):
    """Which dimension names a series: few values, no identifier, no measure; fewest values win."""
    from quern.operators.profile import blank_distinct, is_identifier_name

    e = t(s, d, "events")
    names = [c for c in ("event_type", "user_id", "props") if not is_identifier_name(c)]
    return blank_distinct(e, names).filter("distinct_count BETWEEN 2 AND 200").orderBy("distinct_count", "column").limit(1)


@R.add("t_format_source", "SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS dmy, strftime(o_orderdate, '%b %y') AS word, strftime(o_orderdate, '%H:%M:%S') AS clock FROM orders")
def _(s, d):
    return t(s, d, "orders").select("o_orderkey", *(F.date_format("o_orderdate", T.date_pattern(p)).alias(k) for k, p in (("dmy", "dd/mm/yyyy"), ("word", "mmm yy"), ("clock", "hh:mm:ss"))))


@R.add("t_excel_serial", "SELECT o_orderkey, CAST(datediff('day', DATE '1899-12-30', CAST(o_orderdate AS DATE)) AS DOUBLE) AS serial FROM orders WHERE o_orderdate = date_trunc('day', o_orderdate)")
def _(s, d):
    return t(s, d, "orders").filter("o_orderdate = date_trunc('day', o_orderdate)").select("o_orderkey", excel_serial(F.col("o_orderdate").cast("timestamp")).cast("double").alias("serial"))


@R.add("local_midnight_fix", "SELECT o_orderkey, o_orderdate::TIMESTAMP AS fixed FROM orders WHERE o_orderdate = date_trunc('day', o_orderdate)")
def _(s, d):
    o = t(s, d, "orders").filter("o_orderdate = date_trunc('day', o_orderdate)").select("o_orderkey", F.to_utc_timestamp(F.col("o_orderdate").cast("timestamp"), "Asia/Tokyo").alias("fixed"))
    return T.utc_anchor(o, "fixed", "Asia/Tokyo").withColumn("fixed", F.col("fixed").cast("timestamp_ntz"))


R.add("wall_clock_anchor", R.sql["local_midnight_fix"])(R["local_midnight_fix"])


@R.add("parse_date_stable", "SELECT o_orderkey, o_orderdate::TIMESTAMP AS plain, (o_orderdate - INTERVAL 2 HOUR)::TIMESTAMP AS shifted FROM orders")
def _(s, d):
    text = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    return t(s, d, "orders").select("o_orderkey", F.try_to_timestamp(text).cast("timestamp_ntz").alias("plain"), F.try_to_timestamp(F.concat(text, F.lit("+02:00"))).cast("timestamp_ntz").alias("shifted"))


@R.add("t_period_codes")
def _(s, d):
    """Quarter, half and week labels of dates, and what is read back from them."""
    o = t(s, d, "orders").select(F.concat(F.lit("Q"), F.quarter("o_orderdate").cast("string"), F.lit(" "), F.year("o_orderdate").cast("string")).alias("label")).distinct()
    return o.select("label", T.parse_point(F.col("label")).alias("start"))


@R.add("t_month_words", "SELECT strftime(m, '%B %Y') AS label, m::TIMESTAMP AS start FROM (SELECT DISTINCT date_trunc('month', o_orderdate) AS m FROM orders)")
def _(s, d):
    o = t(s, d, "orders").select(F.date_format("o_orderdate", "MMMM yyyy").alias("label")).distinct()
    return o.select("label", T.parse_point(F.col("label")).cast("timestamp_ntz").alias("start"))


R.add("t_split_month_period", R.sql["t_month_words"])(R["t_month_words"])


@R.add("t_date_levels")
def _(s, d):
    from quern.operators.profile import words_of

    levels = ("year", "quarter", "month", "day")
    return s.createDataFrame([(c, next((w for w in words_of(c) if w in levels), None)) for c in ("Order Year", "OrderQuarter", "month_name", "Day", "Yearly")], "name string, level string")


@R.add("t_calendar_words")
def _(s, d):
    from quern.operators.profile import words_of

    return s.createDataFrame([(c, any(w in ("year", "yr", "fy") for w in words_of(c))) for c in ("OlympicYear", "fiscal_year", "Yearbook", "FY", "FY2024")], "name string, is_year boolean")


QUERIES, ORACLE_SQL = R, R.sql
