"""Sources, sinks, cleaning, scalar functions and places over the driver's tables."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from quern.functions import names as N
from quern.functions import text as X
from quern.operators import aggregation as A
from quern.operators import geo as G
from quern.operators.profile import engine_types, words_of
from quern.plans.common import Registry, js_number_sql, t, union
from quern.sources import readers as I
from quern.sources import writers as W

R = Registry()

# --- sources


def shared(s, name: str) -> str:
    import tempfile
    import uuid

    folder = s.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not s.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.gettempdir()
    return f"{folder}/quern-{name}-{uuid.uuid4().hex}"


@R.add("src_csv", "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation")
def _(s, d):
    path = shared(s, "csv")
    t(s, d, "nation").coalesce(1).write.option("header", True).csv(path)
    return I.read_csv(s, path)


@R.add("src_grid", "SELECT '1' AS a, 'x' AS \"a (2)\" UNION ALL SELECT '2', NULL")
def _(s, d):
    return I.from_grid(s, ["a", " a "], [(1, "x"), (2, None)])


@R.add("src_table", "SELECT n_nationkey, n_name FROM nation")
def _(s, d):
    n = t(s, d, "nation").select("n_nationkey", "n_name")
    return s.createDataFrame([tuple(r) for r in n.collect()], n.schema)


@R.add("src_objects", "SELECT '1' AS a, NULL AS b, NULL AS c UNION ALL SELECT '2', 'x', NULL UNION ALL SELECT NULL, NULL, 'y'")
def _(s, d):
    return I.from_objects(s, [{"a": 1}, {"a": 2, "b": "x"}, {"c": "y"}])


@R.add("src_sql", "SELECT * FROM (VALUES ('l_orderkey', 'Integer'), ('l_partkey', 'Integer'), ('l_suppkey', 'Integer'), ('l_linenumber', 'Integer'), ('l_quantity', 'Decimal'), ('l_extendedprice', 'Decimal'), ('l_discount', 'Decimal'), ('l_tax', 'Decimal'), ('l_returnflag', 'String'), ('l_linestatus', 'String'), ('l_shipdate', 'DateTime')) v(\"column\", data_type)")
def _(s, d):
    return s.createDataFrame(list(engine_types(t(s, d, "lineitem")).items()), "column string, data_type string")


@R.add("src_dax_result", "SELECT n_nationkey AS \"Key\", n_name AS \"A]B\" FROM nation")
def _(s, d):
    n = t(s, d, "nation").select("n_nationkey", "n_name")
    return n.toDF(*I.model_names(["'Nation'[Key]", "[A]]B]"]))


@R.add("json_lines")
def _(s, d):
    path = shared(s, "ndjson")
    s.createDataFrame([('{"type":"log"}',), ("not json",), ('{"type":"result","result":"ok"}',)], "value string").coalesce(1).write.text(path)
    return I.read_ndjson(s, path)


# --- sinks


@R.add("sink_csv", "SELECT l_orderkey || ',' || " + js_number_sql("l_quantity") + " || ',' || l_returnflag || ',' || strftime(l_shipdate, '%Y-%m-%d') || ',\"''=a,\"\"b\"\"\"' AS line FROM lineitem")
def _(s, d):
    li = t(s, d, "lineitem").select("l_orderkey", "l_quantity", "l_returnflag", "l_shipdate", F.lit('=a,"b"').alias("formula"))
    return W.csv_lines(li)


@R.add("sink_xlsx")
def _(s, d):
    data = W.xlsx_bytes(t(s, d, "nation"), "Nations: all")
    return s.createDataFrame([(len(data), data[:2].decode())], "bytes int, magic string")


@R.add("sink_file_name")
def _(s, d):
    names = ["Sales: Q1/Q2", "con", "  ", "x" * 100, "a'b."]
    return s.createDataFrame([(n, W.export_file_name(n, "csv"), W.sheet_name(n), W.column_letters(k * 30)) for k, n in enumerate(names)], "title string, file string, sheet string, letters string")


@R.add("sink_sample_csv")
def _(s, d):
    return s.createDataFrame([(W.masked_sample(t(s, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), "c_custkey"),)], "sample string")


@R.add("sink_objects", "SELECT n_nationkey, n_name, n_name AS name FROM nation")
def _(s, d):
    return t(s, d, "nation").select("n_nationkey", "n_name", F.col("n_name").alias("name"))


@R.add("sink_payload", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(CAST(floor(extract('milliseconds' FROM ts)) % 1000 AS INT) AS VARCHAR), 3, '0') || 'Z' AS ts, event_type, row_number() OVER (ORDER BY event_id) - 1 AS __rowIdx__ FROM events")
def _(s, d):
    e = t(s, d, "events").select("event_id", "ts", "event_type", F.lit("theirs").alias("__rowIdx__"))
    return W.payload(e, "event_id")


@R.add("withheld_values", """SELECT 'l_linenumber' AS "column", count(*) AS count, list(v ORDER BY v) AS "values" FROM (SELECT DISTINCT CAST(l_linenumber AS VARCHAR) AS v FROM lineitem WHERE l_linenumber > 4) WHERE v NOT IN (SELECT CAST(l_linenumber AS VARCHAR) FROM lineitem WHERE l_linenumber <= 4)""")
def _(s, d):
    """Values that a cut of rows left out altogether."""
    from quern.sources.requests import withheld_values

    li = t(s, d, "lineitem")
    return withheld_values(li, li.filter("l_linenumber <= 4"), ["l_linenumber", "l_returnflag"], 20)


# --- cleaning

CELLS = ["#N/A", " #div/0! ", "#DIV/0!", "#WERT!", "#winning!", "#1", "#nv", "12", "", None, "#¡VALOR!", "# Sold"]


@R.add("blank_errors", "SELECT * FROM (VALUES (' #div/0! ', ' #div/0! '), ('#N/A', NULL), ('#DIV/0!', NULL), ('#WERT!', NULL), ('#winning!', '#winning!'), ('#1', '#1'), ('#nv', NULL), ('12', '12'), ('', ''), (NULL, NULL), ('#¡VALOR!', NULL), ('# Sold', '# Sold')) v(cell, clean)")
def _(s, d):
    return s.createDataFrame([(c,) for c in CELLS], "cell string").select("cell", X.blank_errors(F.col("cell")).alias("clean"))


#: One digit block for each remainder of an order's key: all that are read, and one (N'Ko) that is not.
_BLOCKS = (*X.DIGIT_ZEROS, 0x07C0)


@R.add("fold_numerals", f"SELECT o_orderkey, CASE WHEN o_orderkey % {len(_BLOCKS)} = {len(_BLOCKS) - 1} THEN translate(CAST(o_orderkey AS VARCHAR), '0123456789', '{''.join(chr(0x07C0 + k) for k in range(10))}') ELSE CAST(o_orderkey AS VARCHAR) END AS folded FROM orders")
def _(s, d):
    key, written = F.col("o_orderkey").cast("string"), F.lit(None).cast("string")
    for k, zero in enumerate(_BLOCKS):
        written = F.when(F.col("o_orderkey") % len(_BLOCKS) == k, F.translate(key, "0123456789", "".join(chr(zero + n) for n in range(10)))).otherwise(written)
    return t(s, d, "orders").select("o_orderkey", X.fold_numerals(written).alias("folded"))


@R.add("detect_decimal_sep", "SELECT count(*) FILTER (o_totalprice <> floor(o_totalprice)) AS commas, 0 AS dots, ',' AS separator FROM orders")
def _(s, d):
    o = t(s, d, "orders").select(F.translate(X.js_number(F.col("o_totalprice")), ".", ",").alias("v"))
    o = o.filter(~F.col("v").rlike(r"^\d{1,3},\d{3}$"))
    return I.decimal_separator(o, "v").select("commas", "dots", "separator")


@R.add("parse_number", "SELECT o_orderkey, o_totalprice AS dot, o_totalprice AS comma, CAST(NULL AS DOUBLE) AS bad FROM orders")
def _(s, d):
    grouped = F.format_number("o_totalprice", 2)
    swapped = F.translate(grouped, ",.", ".,")
    return t(s, d, "orders").select("o_orderkey", X.parse_number(grouped).alias("dot"), X.parse_number(swapped, ",").alias("comma"), X.parse_number(F.concat(grouped, F.lit("x"))).alias("bad"))


@R.add("infer_type", "SELECT * FROM (VALUES ('o_orderkey', 'Integer'), ('o_orderstatus', 'String'), ('o_totalprice', 'Decimal'), ('day', 'DateTime'), ('code', 'String')) v(\"column\", data_type)")
def _(s, d):
    o = t(s, d, "orders")
    cells = o.select(F.col("o_orderkey").cast("string"), "o_orderstatus", F.format_string("%.2f", "o_totalprice").alias("o_totalprice"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.lpad(F.col("o_custkey").cast("string"), 7, "0").alias("code"))
    return I.infer_types(cells)


@R.add("text_date_column", "SELECT o_orderkey, CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS d FROM orders")
def _(s, d):
    o = t(s, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "dd/MM/yyyy").alias("v"))
    order = I.text_date_order(o, "v").first()["order"]
    return o.select("o_orderkey", I.read_text_date(F.col("v"), order).cast("timestamp_ntz").alias("d"))


@R.add("text_date_pattern", "SELECT least(200, count(DISTINCT date_trunc('day', o_orderdate))) AS sampled, '%Y-%m-%d' AS pattern FROM orders")
def _(s, d):
    return I.date_pattern_of(t(s, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("v")), "v")


@R.add("convert_cell", "SELECT o_orderkey, o_orderkey AS i, CAST(NULL AS BIGINT) AS bad, o_totalprice AS x FROM orders")
def _(s, d):
    text = F.col("o_orderkey").cast("string")
    return t(s, d, "orders").select("o_orderkey", I.converted(text, "Integer").alias("i"), I.converted(F.concat(text, F.lit("a")), "Integer").alias("bad"), I.converted(F.format_number("o_totalprice", 2), "Decimal").alias("x"))


@R.add("dedup_rows", "SELECT c_nationkey, c_mktsegment, min(c_custkey) AS c_custkey FROM customer GROUP BY ALL")
def _(s, d):
    return I.deduplicated(t(s, d, "customer").select("c_nationkey", "c_mktsegment", "c_custkey"), "c_custkey")


@R.add("trim_cells", "SELECT n_nationkey, n_name AS trimmed FROM nation")
def _(s, d):
    return t(s, d, "nation").select("n_nationkey", X.trim_unicode(F.concat(F.lit(" \t "), F.col("n_name"), F.lit(" 　\n"))).alias("trimmed"))


@R.add("collapse_agg_name")
def _(s, d):
    names = ["Sum of Sum of X", "Sum of Sum of Y", "Sum of Y", "Z"]
    return s.createDataFrame(list(zip(names, I.collapse_aggregate(names), strict=True)), "name string, collapsed string")


@R.add("tell_apart_names")
def _(s, d):
    return s.createDataFrame([(n,) for n in I.tell_apart(["a", "b", "a", "a"])], "name string")


@R.add("measure_role")
def _(s, d):
    return I.measure_roles(t(s, d, "lineitem"))


# --- aggregation rules


@R.add("agg_host_hint")
def _(s, d):
    return s.createDataFrame([(n, A.host_hint(n)) for n in ("Sum of Revenue", "Average of Margin", "Count of Id", "Revenue")], "name string, hint string")


def _columns(s, d):
    return [(c, A.additivity_of(c)) for c in [*t(s, d, "lineitem").columns, "latitude"]]


@R.add("agg_class")
def _(s, d):
    return s.createDataFrame(_columns(s, d), "column string, additivity string")


@R.add("agg_allowed")
def _(s, d):
    return s.createDataFrame([(c, list(A.allowed(a))) for c, a in _columns(s, d)], "column string, allowed array<string>")


@R.add("agg_default")
def _(s, d):
    return s.createDataFrame([(c, A.default(a)) for c, a in _columns(s, d)], "column string, aggregation string")


# --- scalar functions


@R.add("f_name_words", "SELECT n_nationkey, ['order', 'key', 'n', '2', CAST(n_nationkey AS VARCHAR)] AS words FROM nation")
def _(s, d):
    return t(s, d, "nation").select("n_nationkey", X.name_words(F.concat(F.lit("orderKey_n 2-"), F.col("n_nationkey").cast("string"))).alias("words"))


@R.add("f_letter_runs", "SELECT c_custkey, regexp_extract_all(c_name, '[A-Za-z]+') AS runs FROM customer")
def _(s, d):
    return t(s, d, "customer").select("c_custkey", X.letter_runs(F.col("c_name")).alias("runs"))


@R.add("f_fold_name", "SELECT doc_id, strip_accents(text) AS folded FROM documents")
def _(s, d):
    return t(s, d, "documents").select("doc_id", N.fold_name(F.col("text")).alias("folded"))


@R.add("geo_normalize_name", "SELECT doc_id, trim(regexp_replace(lower(strip_accents(replace(text, 'ß', 'ss'))), '[^\\p{L}\\p{Nd}]+', ' ', 'g')) AS folded FROM documents")
def _(s, d):
    return t(s, d, "documents").select("doc_id", G.normal_name_column(F.col("text")).alias("folded"))


@R.add("f_loose_key", "SELECT p_partkey, regexp_replace(lower(p_type), '[^a-z0-9]', '', 'g') AS key FROM part WHERE length(regexp_replace(p_type, '[^A-Za-z0-9]', '', 'g')) >= 4")
def _(s, d):
    return t(s, d, "part").select("p_partkey", G.loose_key(F.col("p_type")).alias("key")).filter("key IS NOT NULL")


@R.add("f_identifier_name")
def _(s, d):
    from quern.operators.profile import is_identifier_name

    return s.createDataFrame([(n, is_identifier_name(n)) for n in ("LoanID", "StoreId", "ZipCode", "Revenue", "order_key", "Idea")], "name string, is_identifier boolean")


_TOKENS = (("type", "en"), ("brushed", "en"), ("steel", "de"), ("eel", "de"), ("in", "nl"))


@R.add(
    "f_match_token",
    "WITH p AS (SELECT p_partkey, regexp_extract_all(lower(p_type), '[a-z0-9]+') AS w FROM part) "
    + " UNION ALL ".join(
        f"SELECT p_partkey, '{token}' AS token, CASE WHEN list_contains(w, '{token}') THEN 'word' WHEN {lang in N.COMPOUNDING} AND len(list_filter(w, lambda x: suffix(x, '{token}') AND length(x) >= {len(token) + N.COMPOUND_STEM})) > 0 THEN 'suffix' END AS found FROM p"
        for token, lang in _TOKENS
    ),
)
def _(s, d):
    found = F.explode(F.array(*(F.struct(F.lit(token).alias("token"), N.token_view(F.lower("p_type"), token, lang).alias("found")) for token, lang in _TOKENS))).alias("x")
    return t(s, d, "part").select("p_partkey", found).select("p_partkey", "x.*")


@R.add("f_mask_text")
def _(s, d):
    rng = random.Random(3)
    return s.createDataFrame([(v, W.mask_text(v, rng)) for v in ("Ann Lee", "ann@site.com", "flight-1234", "Zürich")], "value string, masked string")


@R.add("f_schema_identity")
def _(s, d):
    from zlib import crc32

    parts = [f"{k}:{v}" for k, v in engine_types(t(s, d, "lineitem")).items()]
    return s.createDataFrame([("|".join(parts), crc32("|".join(parts).encode()))], "identity string, hash long")


@R.add(
    "f_string_hash",
    "SELECT value, CAST(CASE WHEN value = '' THEN 0 ELSE list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(string_split(value, ''), lambda x: ord(x)::HUGEINT)), "
    "lambda h, c: (xor(h, c) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT) & 9007199254740991::HUGEINT END AS BIGINT) AS hash "
    "FROM (SELECT DISTINCT p_type AS value FROM part UNION ALL SELECT '' UNION ALL SELECT 'Zürich')",
)
def _(s, d):
    values = t(s, d, "part").select(F.col("p_type").alias("value")).distinct().union(s.createDataFrame([("",), ("Zürich",)], "value string"))
    return values.select("value", N.string_hashes(F.col("value")).alias("hash"))


#: (column, display specifier, the model's format)
_FORMATS = (
    ("l_quantity", ",d", None), ("l_quantity", ".0f", None), ("l_extendedprice", "$,.2f", None), ("l_extendedprice", ",", None), ("l_extendedprice", None, "#,##0.## [$€-407];(#,##0.##)"),
    ("l_discount", ".1%", None), ("l_discount", ".3~%", None), ("l_tax", "+.4~f", None), ("l_tax", ".2e", None), ("l_tax", "s", None), ("l_tax", None, "yyyy-mm-dd"),
)


def _decimals(column: str, most: int, least: int = 0, percent: bool = False) -> str:
    """SQL of the decimals that a format shows."""
    value = f"round({column} * 100, 9)" if percent else column
    return f"greatest({least}, least({most}, (SELECT max(length(regexp_extract(regexp_replace(CAST({value} AS VARCHAR), '\\.0+$', ''), '\\.([0-9]+)$', 1))) FROM lineitem)))"


def _zeros(n: str) -> str:
    return f"CASE WHEN {n} > 0 THEN '.' || repeat('0', CAST({n} AS BIGINT)) ELSE '' END"


_CODES = (
    "'#,##0'", "NULL", "'\"$\"#,##0.00'", f"'#,##0' || {_zeros(_decimals('l_extendedprice', 15))}", "'\"€\"#,##0' || {z} || ';(' || '\"€\"#,##0' || {z} || ');' || '\"€\"#,##0' || {z}".format(z=_zeros(_decimals("l_extendedprice", 2))),
    "'0.0%'", f"'0' || {_zeros(_decimals('l_discount', 3, percent=True))} || '%'", "'+0' || {z} || ';-0' || {z} || ';0' || {z}".format(z=_zeros(_decimals("l_tax", 4))), "'0.00E+00'", "NULL", "NULL",
)


@R.add("f_number_format", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {repr(x) if x else 'NULL'} AS spec, {repr(m) if m else 'NULL'} AS model, CAST({code} AS VARCHAR) AS code" for (c, x, m), code in zip(_FORMATS, _CODES, strict=True)))
def _(s, d):
    """Workbook formats of columns, by the decimals that their data have: one pass, one row."""
    formats = [(c, x, m, N.workbook_format(x, m)) for c, x, m in _FORMATS]
    values = [F.round(F.col(c) * 100, 9) if f and f.percent else F.col(c) for c, _, _, f in formats]
    found = t(s, d, "lineitem").agg(*(F.max(N.fraction_digits(v)).alias(f"n{k}") for k, v in enumerate(values))).first()
    return s.createDataFrame([(c, x, m, f.code(found[k] or 0) if f else None) for k, (c, x, m, f) in enumerate(formats)], "column string, spec string, model string, code string")


@R.add(
    "f_dax_literal",
    """SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS key, 'DATE(' || year(o_orderdate) || ', ' || month(o_orderdate) || ', ' || day(o_orderdate) || ')' || CASE WHEN hour(o_orderdate) + minute(o_orderdate) + second(o_orderdate) > 0 THEN ' + TIME(' || hour(o_orderdate) || ', ' || minute(o_orderdate) || ', ' || second(o_orderdate) || ')' ELSE '' END AS date,
 CASE WHEN o_orderkey % 5 = 0 THEN 'BLANK()' ELSE '"' || replace(replace(o_orderpriority, '-', '"'), '"', '""') || '"' END AS text, CASE WHEN o_totalprice > 100000 THEN 'TRUE()' ELSE 'FALSE()' END AS large FROM orders""",
)
def _(s, d):
    o = t(s, d, "orders")
    quoted = F.when(F.col("o_orderkey") % 5 != 0, F.translate("o_orderpriority", "-", '"'))
    return o.select("o_orderkey", N.dax_literal(F.col("o_orderkey"), "bigint").alias("key"), N.dax_literal(F.col("o_orderdate"), "timestamp").alias("date"), N.dax_literal(quoted, "string").alias("text"), N.dax_literal(F.col("o_totalprice") > 100000, "boolean").alias("large"))


@R.add("f_nice_step", "SELECT o_orderkey, p * CASE WHEN r / p <= 1 THEN 1.0 WHEN r / p <= 2 THEN 2.0 WHEN r / p <= 5 THEN 5.0 ELSE 10.0 END AS step FROM (SELECT o_orderkey, o_totalprice / 100.0 AS r, 10.0 ** floor(log10(o_totalprice / 100.0)) AS p FROM orders WHERE o_totalprice > 0)")
def _(s, d):
    return t(s, d, "orders").filter("o_totalprice > 0").select("o_orderkey", X.nice_step(F.col("o_totalprice")).alias("step"))


@R.add("prof_ordinal_domain", "SELECT 'o_orderpriority' AS \"column\", 'numeric_rank_prefix' AS scale, list(v ORDER BY v) AS ordered FROM (SELECT DISTINCT o_orderpriority AS v FROM orders)")
def _(s, d):
    from quern.operators.scales import scales

    return scales(t(s, d, "orders"), ["o_orderpriority", "o_orderstatus", "o_orderkey"])


@R.add("stream_reprofile", "SELECT 'value' AS \"column\", count(value) AS nonblank, round(avg(value), 6) AS avg, round(stddev_pop(value), 6) AS stddev, min(value) AS min, max(value) AS max FROM events")
def _(s, d):
    """An extension: the profile of a stream, batch by batch."""
    from quern.streaming.reprofile import file_stream, profile_stream

    found = profile_stream(file_stream(s, d, "events"), ["value"], shared(s, "stream"))
    return found.rows(s).withColumn("avg", F.round("avg", 6)).withColumn("stddev", F.round("stddev", 6))


# --- places

PLACES = [("USA", 5), ("France", 3), ("de", 2), ("UK", 4), ("Atlantis", 1), ("México", 2), (None, 1), (" ", 1)]


def places(s):
    return s.createDataFrame([(v, k) for v, n in PLACES for k in range(n)], "place string, k int")


_ISO = {"USA": "USA", "France": "FRA", "de": "DEU", "UK": "GBR", "México": "MEX"}
_ISO_SQL = union(f"SELECT {'NULL' if v is None else repr(v)} AS place, {'NULL' if _ISO.get(v) is None else repr(_ISO[v])} AS iso FROM range({n})" for v, n in PLACES)


@R.add("geo_to_iso", _ISO_SQL)
def _(s, d):
    return G.to_iso(places(s), "place", "country", "iso").select("place", "iso")


R.add("join_geo_iso", _ISO_SQL)(R["geo_to_iso"])
R.add("geo_country_iso3", _ISO_SQL)(R["geo_to_iso"])


@R.add("geo_iso_column", "SELECT 16 AS matched_rows, 17 AS total_rows, 5 AS matched_values, 1 AS unmatched_values")
def _(s, d):
    return G.iso_column(places(s), "place", "country")


@R.add("geo_detect", "SELECT 'us-zip5' AS kind, 1.0 AS pct UNION ALL SELECT 'us-county-fips', 1.0")
def _(s, d):
    return G.detect(t(s, d, "orders").select(F.lpad((F.col("o_custkey") % 90000 + 501).cast("string"), 5, "0").alias("z")), "z")


@R.add("geo_region_of_country", "SELECT * FROM (VALUES ('north-america', 7, 43.8), ('europe', 9, 56.3)) v(region, rows, pct)")
def _(s, d):
    return G.regions(places(s), "place")


def _spots(s, d):
    return t(s, d, "customer").select("c_custkey", (F.col("c_custkey") % 160 - 75.0).alias("lat"), ((F.col("c_custkey") * 7) % 340 - 170.0).alias("lon"))


_SPOT = "SELECT c_custkey % 160 - 75.0 AS a, (c_custkey * 7) % 340 - 170.0 AS o FROM customer"
_BOX = lambda b: f"(a BETWEEN {b[0]} AND {b[1]} AND o BETWEEN {b[2]} AND {b[3]})"
_PCT = lambda c: f"floor(avg(CASE WHEN {c} THEN 1.0 ELSE 0 END) * 1000 + 0.5) / 10"
_FRAME = {k: f"(a BETWEEN {f[1]} AND {f[3]} AND (o BETWEEN {f[0]} AND {f[2]} OR o + 360 BETWEEN {f[0]} AND {f[2]}))" for k, f in sorted(G.FRAMES.items())}
_EXTENT = f"""WITH p AS (SELECT CAST(a AS DOUBLE) AS a, CAST(o AS DOUBLE) AS o FROM ({_SPOT}) WHERE a BETWEEN -90 AND 90), r AS (SELECT count(*) AS n, {_PCT(' OR '.join(map(_BOX, G.USA_BOXES)))} AS pct_usa, {_PCT(_BOX(G.NA_BOX))} AS pct_na, {', '.join(f"{_PCT(c)} AS {k.replace('-', '_')}" for k, c in _FRAME.items())},
 floor(quantile_cont(a, 0.05) * 10 + 0.5) / 10 AS lat_p5, floor(quantile_cont(a, 0.95) * 10 + 0.5) / 10 AS lat_p95, floor(quantile_cont(o, 0.05) * 10 + 0.5) / 10 AS lon_p5, floor(quantile_cont(o, 0.95) * 10 + 0.5) / 10 AS lon_p95 FROM p)
SELECT *, CASE {' '.join(f"WHEN {k.replace('-', '_')} = greatest({', '.join(x.replace('-', '_') for x in _FRAME)}) THEN '{k}'" for k in _FRAME)} END AS dominant_frame FROM r"""


@R.add("geo_extent", _EXTENT)
def _(s, d):
    return G.extent(_spots(s, d), "lat", "lon")


R.add("x_geo_extent", _EXTENT)(R["geo_extent"])

TOWNS = [(1, None, None, "Boston", None, None), (2, None, None, "portland", "ME", None), (3, None, None, "Portland", None, "USA"), (4, None, None, "Paris", None, "FR"), (5, 10.0, 20.0, "Paris", None, None), (6, 0.0, 0.0, "Zurich", None, None), (7, None, None, "Nowhere", None, None), (8, None, None, None, None, None)]


@R.add("geo_point", "SELECT * FROM (VALUES (1, 42.36, -71.06, 'city'), (2, 43.66, -70.26, 'city'), (3, NULL, NULL, 'ambiguous'), (4, 48.86, 2.35, 'city'), (5, 10.0, 20.0, 'latlon'), (6, 47.38, 8.54, 'city'), (7, NULL, NULL, 'none'), (8, NULL, NULL, 'none')) v(id, lat, lon, precision)")
def _(s, d):
    towns = s.createDataFrame(TOWNS, "id int, a double, o double, city string, state string, country string")
    return G.points(towns, "id", "a", "o", "city", "state", "country")


R.add("join_gazetteer", R.sql["geo_point"])(R["geo_point"])


@R.add("geo_point_columns", "SELECT * FROM (VALUES ('city', 4), ('ambiguous', 1), ('latlon', 1), ('none', 2)) v(precision, n)")
def _(s, d):
    return R["geo_point"](s, d).groupBy("precision").agg(F.count("*").alias("n"))


@R.add("geo_roles")
def _(s, d):
    kinds = {"city": "city", "state": "state", "zip": "zip", "country": "country", "lat": "lat", "latitude": "lat", "lon": "lon", "longitude": "lon", "lng": "lon"}
    return s.createDataFrame([(c, next((kinds[w] for w in words_of(c) if w in kinds), None)) for c in ("ShipCity", "state_code", "Zip5", "Latitude", "Revenue")], "column string, role string")


@R.add("geo_city_admin1")
def _(s, d):
    return G.city_region(s)


@R.add("geo_province_column")
def _(s, d):
    """A city's region, unless it is a tie."""
    towns = s.createDataFrame([("Boston",), ("Springfield",), ("Paris",), ("Nowhere",)], "city string").withColumn("k", G.normal_name_column(F.col("city")))
    return towns.join(F.broadcast(G.city_region(s)), F.col("k") == F.col("city_key"), "left").select("city", F.when(~F.col("tie"), F.col("city_state")).alias("province"), F.coalesce("tie", F.lit(False)).alias("ambiguous"))


R.add("x_admin1_rollup")(lambda s, d: R["geo_province_column"](s, d).agg(F.count("*").alias("cities"), F.count("province").alias("placed"), F.count_if(F.col("ambiguous")).alias("ambiguous")))


@R.add("geo_zip_prefix", "SELECT c_custkey, [left(lpad(CAST(c_custkey % 90000 + 1000 AS VARCHAR), 5, '0'), 3)] AS prefixes FROM customer")
def _(s, d):
    return t(s, d, "customer").select("c_custkey", G.zip_prefixes((F.col("c_custkey") % 90000 + 1000).cast("string")).alias("prefixes"))


@R.add("geo_city_match_pct", "SELECT 50.0 AS pct")
def _(s, d):
    v = s.createDataFrame([("Boston",), ("BERLIN",), ("Atlantis",), ("El Dorado",), ("boston ",), ("n/a",)], "city string").filter(~X.is_placeholder(F.col("city"))).select(G.normal_name_column(F.col("city")).alias("k")).distinct()
    known = G.cities(s).select(F.col("city_key").alias("k"), F.lit(1).alias("hit")).distinct()
    return v.join(F.broadcast(known), "k", "left").agg((F.floor(F.avg(F.coalesce("hit", F.lit(0))) * 1000 + 0.5) / 10).alias("pct"))


@R.add("geo_blank_like", "SELECT * FROM (VALUES ('N/A', true), ('na', false), ('NotApplicable', true), ('', true), (NULL, true), ('TBD', true), ('Boston', false)) v(cell, blank)")
def _(s, d):
    return s.createDataFrame([(c,) for c in ("N/A", "na", "NotApplicable", "", None, "TBD", "Boston")], "cell string").select("cell", X.is_placeholder(F.col("cell")).alias("blank"))


SHAPES = {"west": [(-170.0, -80.0), (-10.0, -80.0), (-60.0, 85.0), (-170.0, 85.0)], "east": [(10.0, -80.0), (175.0, -80.0), (175.0, 85.0), (60.0, 85.0)]}


def _inside_sql(corners) -> str:
    out = [f"CASE WHEN ({y0} > a) <> ({y1} > a) AND o < ({x1} - {x0}) * (a - {y0}) / ({y1} - {y0}) + {x0} THEN 1 ELSE 0 END" for (x0, y0), (x1, y1) in zip(corners, [*corners[1:], corners[0]], strict=True) if y0 != y1]
    xs, ys = zip(*corners, strict=True)
    return f"(o BETWEEN {min(xs)} AND {max(xs)} AND a BETWEEN {min(ys)} AND {max(ys)} AND ({' + '.join(out)}) % 2 = 1)"


@R.add("join_point_in_polygon", f"SELECT c_custkey, CASE WHEN {_inside_sql(SHAPES['west'])} THEN 'west' WHEN {_inside_sql(SHAPES['east'])} THEN 'east' END AS region FROM (SELECT c_custkey, CAST(c_custkey % 160 - 75.0 AS DOUBLE) AS a, CAST((c_custkey * 7) % 340 - 170.0 AS DOUBLE) AS o FROM customer)")
def _(s, d):
    return G.in_regions(_spots(s, d), "lat", "lon", SHAPES).select("c_custkey", "region")


QUERIES, ORACLE_SQL = R, R.sql
