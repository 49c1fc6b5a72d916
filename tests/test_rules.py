"""Rules without an SQL form, against small independent oracles."""

import io
import itertools
import math
import random
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from quern.functions import text as X
from quern.operators import analytics as A
from quern.operators import cross, filters, geo, profile, star, temporal
from quern.operators.ranks import order_statistics, with_row_index
from quern.sources import readers, writers


def values(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_order_statistics_with_ties_and_nulls(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), rng.choice([None, 1.0, 1.0, 2.5, rng.random()])) for _ in range(400)]
    got = {r.g: r for r in order_statistics(values(spark, rows, "g string, x double"), ["g"], "x", {"p": 0.3}, ranges=7).collect()}
    for g in "ab":
        xs = sorted(x for k, x in rows if k == g and x is not None)
        assert (got[g].n, got[g].p) == (len(xs), xs[math.floor((len(xs) - 1) * 0.3)])


def test_row_index_is_dense(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("k"))
    assert [r["__row_idx__"] for r in with_row_index(df, "k", ranges=9).orderBy("k").collect()] == list(range(1000))


def test_score_separation_counts_pairs(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(20), rng.random() < 0.2) for _ in range(200)]
    got = cross.score_separation(values(spark, rows, "s int, o boolean"), "s", "o").first()
    pos, neg = [s for s, o in rows if o], [s for s, o in rows if not o]
    auc = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
    assert got.auc == pytest.approx(auc, abs=5e-5) and got.ties == sum(p == q for p in pos for q in neg)


def test_two_snapshots_of_known_sizes(spark):
    rows = [(f"C{k}", s, 100 + (s == "2024-02" and k >= 312), 2 * k + (s == "2024-02")) for k in range(382) for s in ("2024-01", "2024-02") if s == "2024-01" or k < 360]
    rows += [(f"D{k}", "2024-02", 1, 1000 + k) for k in range(18)]
    got = cross.two_set_pairing(values(spark, rows, "k string, snap string, balance int, at int"), "k", "snap", "at").first()
    assert (got.keys_a, got.keys_b, got.keys_both, got.identical_pct) == (382, 378, 360, 87)


def test_constant_sum_takes_the_largest_set(spark):
    rows = [(k, 20.0 + k % 5, 30.0 - k % 5, 50.0, float(k)) for k in range(40)]
    assert cross.constant_sum(values(spark, rows, "i int, a double, b double, c double, d double"), ["a", "b", "c", "d"], "i").first().columns == "a,b,c"


def test_additivity_by_evidence():
    assert cross.additivity_class(True, 0, 1) == "part_of_whole"
    assert [cross.additivity_class(False, 0, 1), cross.additivity_class(False, 0, 5), cross.additivity_class(False, 0, 1, "sum"), cross.additivity_class(False, 0, 5, "count")] == ["intensive_rate", "unknown", "unknown", "additive"]


@pytest.mark.parametrize(
    ("text", "want"),
    [("123e4567-e89b-12d3-a456-426614174000", "UUID"), ("a@b.co", "EMAIL_LIKE"), ("www.x", "URL_LIKE"), ("+1 (555) 010-9999", "PHONE_LIKE"), ("1/2/2024", "DATE_STR"), ("Yes", "BOOLEAN"), ("123456", "NUMERIC_ID"), ("12", None), ("deadbeef0", "HEX_ID"),
     ("ABC1", "ALL_UPPER"), ("ab-12-cd", "OPAQUE_ID_ALPHANUMERIC"), ("one, two", "SENTENCE_TEXT"), ("New York", "TITLE_CASE_WORDS"), ("so much", "LOWER_WORDS"), ("Zürich", "TITLE_CASE_WORDS"), ("word", "LOWER_WORDS"), ("$", None)],
)
def test_signatures(spark, text, want):
    assert values(spark, [(text,)], "v string").select(X.signature(F.col("v")).alias("s")).first().s == want


def test_numbers_and_dates(spark):
    rows = [("1,234.5", ".", 1234.5), ("1.234,5", ",", 1234.5), ("1 234,5", ",", 1234.5), ("12,34.5", ".", None), ("١٢٣", ".", 123.0), ("1e3", ".", 1000.0), ("", ".", None)]
    for text, sep, want in rows:
        assert values(spark, [(text,)], "v string").select(X.parse_number(F.col("v"), sep).alias("x")).first().x == want
    orders = [(["13/01/2024", "02/01/2024"], "dmy"), (["01/13/2024"], "mdy"), (["13/01/2024", "01/13/2024"], None), (["1.2.2024"], "dmy"), (["1/2/2024"], "mdy"), (["2024/1/2"], "ymd"), (["1/2/2024", "x"], None), (["1/2/2024", "1-2-2024"], None)]
    for cells, want in orders:
        assert readers.text_date_order(values(spark, [(c,) for c in cells], "v string"), "v").first()["order"] == want
    bad = values(spark, [("31/02/2024",)], "v string").select(readers.read_text_date(F.col("v"), "dmy").alias("d")).first().d
    assert bad is None


def test_csv_source(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text('\ufeff City ;n;n\n"Bos""ton";1;\n\n"";2;"a;b"\n', encoding="utf-8")
    df = readers.read_csv(spark, str(path))
    assert df.columns == ["City", "n", "n (2)"] and [tuple(r) for r in df.collect()] == [('Bos"ton', "1", None), (None, "2", "a;b")]
    assert dict(readers.typed(df).dtypes)["n"] == "bigint"
    (tmp_path / "y.csv").write_text("only a header\n")
    with pytest.raises(ValueError, match="header"):
        readers.read_csv(spark, str(tmp_path / "y.csv"))


def test_csv_and_workbook_sinks(spark):
    df = values(spark, [(1, "=a,\"b\"", 2.0, True), (2, None, 0.25, False)], "Id int, Name string, Amount double, Flag boolean")
    assert writers.csv_bytes(df).decode() == "\ufeffId,Name,Amount,Flag\r\n1,\"'=a,\"\"b\"\"\",2,TRUE\r\n2,,0.25,FALSE\r\n"
    with zipfile.ZipFile(io.BytesIO(writers.xlsx_bytes(df))) as z:
        assert z.testzip() is None
        sheet = z.read("xl/worksheets/sheet1.xml").decode()
    assert '<c r="C2"><v>2.0</v></c>' in sheet and 'ref="A1:D3"' in sheet
    assert [writers.column_letters(k) for k in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]
    assert [writers.export_file_name("a/b: c.", "csv"), writers.export_file_name("CON", "csv"), writers.sheet_name("'History'")] == ["a b c.csv", "table.csv", "Data"]


def test_masks_keep_shape():
    rng = random.Random(0)
    for v in ("flight-1234", "Ann Lee", "x@site.com", "Ёлка"):
        m = writers.mask_text(v, rng)
        assert not set(filter(str.isalnum, v.removesuffix(".com"))) & set(filter(str.isalnum, m.removesuffix(".com")))
        assert re.sub(r"\w+", "w", v) == re.sub(r"\w+", "w", m) or "@" in v and m.endswith(".com")


def test_filters_and_views(spark):
    df = values(spark, [(1, "a"), (2, "b"), (2, None), (None, "a")], "x int, y string")
    f = filters.Filter(("x", "y"))
    assert f.keep(df).count() == 4 and f.set([(2, None)]) and not f.set([(2, None), (2, None)])
    assert [tuple(r) for r in f.keep(df).collect()] == [(2, None)]
    f.set([(filters.ANY, "a")])
    assert f.keep(df).count() == 2
    f.set([(k, "a") for k in range(300)])
    assert [tuple(r) for r in f.keep(df).collect()] == [(1, "a")]
    scope = filters.Scope({"f": filters.Filter(("x",))})
    scope.filters["f"].set([(2,)])
    other = filters.Scope({"f": filters.Filter(("x",))})
    assert other.restore(scope.token()) and other.filters["f"].keys == [(2,)] and not other.restore("%%")
    assert filters.next_selection([1, 2], [2, 3], True) == [1, 3] and filters.next_selection([1], [1], False) == []


def test_role_queries(spark):
    df = values(spark, [("a", "x", 1), ("a", "y", 2), ("b", "x", 4)], "d string, e string, v int")
    roles = {"d": star.Role("d"), "e": star.Role("e"), "v": star.Role(measure=lambda: F.sum("v"))}
    assert [tuple(r) for r in star.build_query(df, star.QueryDef(["d", "v"]), roles, {"e": ["x"]}).collect()] == [("a", 1), ("b", 4)]
    with pytest.raises(star.MissingRoles, match="w"):
        star.build_query(df, star.QueryDef(["d", "w"]), roles)
    mixed = values(spark, [("a", True, False)], "d string, f boolean, g boolean")
    with pytest.raises(Exception, match="subtotals"):
        star.split_rollup(mixed, ["f", "g"])[0].collect()
    cache, calls = star.QueryCache(2), []
    for q in "aabca":
        cache.get("p", q, {}, lambda q=q: calls.append(q) or q)
    assert calls == list("abca") and cache.invalidate("p") == 2


def test_cadence_grains(spark):
    cases = [(["2024-01-01", "2024-01-02", "2024-01-03", "2024-01-20"], "day", 2), ([f"2024-{m:02d}-01" for m in range(1, 13)], "month", 1), ([f"{y}-01-01" for y in range(2000, 2008)], "year", 1), ([f"2024-01-{d:02d}" for d in (1, 2, 3, 4, 5, 8, 9, 10)], "weekday", 1)]
    for days, grain, runs in cases:
        got = temporal.cadence(values(spark, [(d,) for d in days], "d string").select(F.to_timestamp("d").alias("t")), "t").first()
        assert (got.grain, got.runs) == (grain, runs), days
    assert temporal.cadence(values(spark, [("2024-01-01",)], "d string").select(F.to_timestamp("d").alias("t")), "t").count() == 0
    assert temporal.date_pattern("dd/mm/yyyy hh:mm") == "dd/MM/yyyy HH:mm"


def test_statistics_against_enumeration():
    def fisher(k, n, hits, total):
        p = lambda j: math.comb(hits, j) * math.comb(total - hits, n - j) / math.comb(total, n)
        return sum(p(j) for j in range(max(0, n - total + hits), min(n, hits) + 1) if p(j) <= p(k) + 1e-12)

    for k, n, hits, total in [(8, 10, 12, 30), (1, 10, 12, 30), (0, 3, 3, 9)]:
        assert A.fisher_exact(k, n, hits, total) == pytest.approx(fisher(k, n, hits, total))
    xs, ys = [1, 4, 6, 7, 9, 12, 15, 18], [2, 3, 5, 8, 10, 11, 13, 14]
    u = sum((x > y) + 0.5 * (x == y) for x in xs for y in ys)
    counts = [abs(sum((x > y) for x in s for y in set(xs + ys) - set(s)) - 32) >= abs(u - 32) for s in itertools.combinations(xs + ys, 8)]
    assert A.mann_whitney_p(u, 8, 8, 0) == pytest.approx(sum(counts) / len(counts), abs=0.06)


def test_saturation_fit_and_allocation(spark):
    rows = [("a", x, 5 + 100 * x / (20 + x)) for x in map(float, range(2, 200, 6))] + [("b", x, 3 + 2 * x) for x in map(float, range(1, 30))]
    fits = {r.g: r for r in A.saturation_fits(values(spark, rows, "g string, x double, y double"), "g", "x", "y").collect()}
    assert fits["a"].kind == "curve" and (fits["a"].v, fits["a"].k) == (pytest.approx(100, rel=0.01), pytest.approx(20, rel=0.01)) and fits["b"].kind == "line"
    plan = A.allocate([{"name": "a", "v": 100, "k": 20, "lo": 0, "hi": 500}, {"name": "b", "v": 50, "k": 10, "lo": 0, "hi": 500}, {"name": "c", "v": 0, "k": 1, "lo": 5, "hi": 9}], 105.0, {})
    assert sum(plan.values()) == pytest.approx(105) and plan["c"] == 5
    gain = lambda v, k, x: v * k / (k + x) ** 2
    assert gain(100, 20, plan["a"]) == pytest.approx(gain(50, 10, plan["b"]), rel=1e-6)


def test_profile_rules():
    assert [profile.is_identifier_name(n) for n in ("LoanID", "order_key", "Revenue", "")] == [True, True, False, False]
    nature = profile.value_nature
    assert nature("Hour", 24, 900, 0, 23, False) == "Ordinal" and nature("x", 5, 900, 1990, 1994, False) == "Ordinal" and nature("StoreId", 900, 900, 1, 900, False) == "Categorical"
    assert nature("x", 900, 900, 1, 900, False) == "Categorical" and nature("x", 500, 900, 1, 99999, False) == "Continuous" and nature("x", 5, 900, 1, 99999, False) == "Categorical"


def test_geo_keys(spark):
    rows = [("02108", "02108"), ("02108-1234", "02108"), ("2108", "02108"), ("60614.0", "60614"), ("1", None), (" 501 ", "00501")]
    assert [r.z for r in values(spark, rows, "v string, want string").select(geo.zip5(F.col("v")).alias("z")).collect()] == [w for _, w in rows]
    assert geo.normal_name("Łódź, São-Paulo²") == "lodz sao paulo" and len(geo.country_rows()) > 25


def test_scales():
    from quern.operators.scales import scale_of

    assert scale_of(["Agree", "strongly-disagree", "Neutral", "disagree", "Strongly agree"]) == ("likert5_agreement", ["strongly-disagree", "disagree", "Neutral", "Agree", "Strongly agree"])
    assert scale_of(["Frequently", "always", "Seldom"]) == ("frequency5", ["Seldom", "Frequently", "always"])
    assert scale_of(["M", "F"]) is None and scale_of(["2. b", "1. a", "10. c"]) == ("numeric_rank_prefix", ["1. a", "2. b", "10. c"]) and scale_of(["1.5 kg", "2.5 kg", "3.5 kg"]) is None
    assert scale_of(["Q3", "Q1"]) == ("quarter", ["Q1", "Q3"]) and scale_of(["low", "high", "refused"]) is None


def test_stream_profile_counts_a_batch_once(spark):
    from quern.streaming.reprofile import StreamProfile, file_stream, windowed

    p = StreamProfile(["x"])
    for k in (0, 1, 1):
        p.update(values(spark, [(1.0 + k,), (3.0,), (None,)], "x double"), k)
    r = p.rows(spark).first()
    assert (r.nonblank, r.avg, r.min, r.max) == (4, 2.25, 1.0, 3.0)
    stream = windowed(file_stream(spark, "/root/testdata/sf0.001", "events"), "ts", ["event_type"], "value")
    query = stream.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("windows").agg(F.sum("n")).first()[0] == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()


def test_loss_interval():
    curve = {"name": "a", "v": 100.0, "k": 20.0, "df": 10, "cov": [[4.0, 0.0], [0.0, 1.0]]}
    other = curve | {"name": "b", "v": 10.0}
    got = A.loss_interval([curve, other], {"a": 0.0, "b": 100.0}, {"a": 80.0, "b": 20.0})
    assert got["lo"] < got["delta"] < got["hi"] and not got["within"] and got["changed"] == ["a", "b"]
    assert A.t_quantile(10) == pytest.approx(2.228, abs=0.005) and A.t_quantile(1e9) == pytest.approx(1.96, abs=0.001)


def test_request_facts(spark):
    from quern.sources import requests as Q

    assert Q.completeness(False, 3, 0) == {"dataComplete": False, "rowsWithheld": 3} and Q.completeness(None, 1.5) == {} and Q.leaf_count(2.5) == {"leafCardinality": 3} and Q.leaf_count(0) == {}
    assert Q.preview({"a": 1, "key": 2, "sampleCsv": "x", "shape": []}, ["key"], empty_note="nothing bound") == {"a": 1, "sampleCsv": None, "shape": [], "_note": "nothing bound"}
    code = "const i = data.columns.findIndex(c => c.name === 'Sales'); if (i >= 0) draw(); var k = data.columns.find(c => c.name === \"City\"); row.Region;"
    assert Q.missing_columns(code, ["Region"]) == ["City"] and Q.columns_read(code, ["Region", "Old"], ["Sales"]) == ["Region"] and Q.columns_read("x()", ["A"], ["B"]) == ["A"]
    text = Q.store_columns([{"n": "A"}, {"n": ""}, {"n": "B", "q": "t.b"}], "de")
    assert Q.stored_columns(text) == {"v": 1, "l": "de", "c": [{"n": "A", "q": ""}, {"n": "B", "q": "t.b"}]} and Q.stored_columns("{") is None and Q.store_columns([], "") == ""
    kept = values(spark, [("a", 1)], "x string, y int")
    whole = kept.union(values(spark, [("b", 1), ("c", 1), ("b", 1)], "x string, y int"))
    assert [tuple(r) for r in Q.withheld_values(whole, kept, ["x", "y"], 20).collect()] == [("x", 2, ["b", "c"])]
    assert [tuple(r) for r in Q.withheld_values(whole, kept, ["x", "y"], 10).collect()] == [("x", 2, None)]


def test_names_hashes_formats_and_literals(spark):
    from quern.functions import names as N

    one = lambda f, *v: [r[0] for r in spark.createDataFrame([(x,) for x in v], "x string").select(f(F.col("x"))).collect()]
    assert one(N.fold_name, "Température", "Udział", "Sıcaklık", "٢٠٢٤", "Straße, Ａb!", "한국 😀", "", None) == ["Temperature", "Udzial", "Sicaklik", "2024", "Straße, Ab!", "한국 😀", "", None]
    view = lambda token, lang: lambda x: N.token_view(x, token, lang)
    assert one(view("temperatur", "de"), "Durchschnittstemperatur", "Temperatur", "abtemperatur", "temp") == ["suffix", "word", None, None]
    assert one(view("revenue", "en"), "NetRevenue", "netrevenue") == ["word", None]
    assert one(view("売上", "ja"), "売上高_2024年", "年") == ["substring", None] and one(view("日", "ja"), "日付") == [None]
    assert one(view("매출", "ko"), "분기매출", "총매출") == ["suffix", None]
    assert one(view("إيرادات", "ar"), "الإيرادات") == ["prefix"]
    assert [N.string_hash(v) for v in ("", None)] == [0, 0] and N.string_hash("a") == (0xCBF29CE484222325 ^ 97) * 0x100000001B3 % 2**64 % 2**53
    code = lambda spec, model=None, n=0: (f.code(n) if (f := N.workbook_format(spec, model)) else None)
    assert [code(x) for x in ("$,.2f", ",d", ".1%", ".0f", "(,.2f", "s", "what")] == ['"$"#,##0.00', "#,##0", "0.0%", None, "#,##0.00;(#,##0.00);#,##0.00", None, None]
    assert [code(",", n=3), code(".4~f", n=2), code(".2e"), code("+d")] == ["#,##0.000", "0.00", "0.00E+00", "+0;-0;0"]
    assert [code(None, m, 1) for m in ("#,0.##", '0.0 "€"', "\\$#,0;(\\$#,0)", "0%", "dd/mm/yyyy", "General")] == ["#,##0.0", '0.0"€"', '"$"#,##0;("$"#,##0);"$"#,##0', "0%", None, None]
    rows = spark.sql("SELECT timestamp'2024-03-05 00:00:00' AS a, timestamp'2024-03-05 06:07:08' AS b, 1.5D AS c, 2.0D AS d, CAST(NULL AS string) AS e, true AS f, 'a\"b' AS g")
    kinds = dict(rows.dtypes)
    assert tuple(rows.select(*(N.dax_literal(F.col(c), kinds[c]) for c in rows.columns)).first()) == ("DATE(2024, 3, 5)", "DATE(2024, 3, 5) + TIME(6, 7, 8)", "1.5", "2", "BLANK()", "TRUE()", '"a""b"')


def test_keys_of_two_columns_order_exactly(spark):
    from quern.operators.ranks import in_turn

    rows = [(1, 10_000_006), (2, 3), (-5, 9 * 10**18), (1, 7), (2, 2)]
    got = spark.createDataFrame(rows, "a long, b long").select("a", "b", in_turn(F.col("a"), F.col("b")).alias("k")).orderBy("k").collect()
    assert [(r.a, r.b) for r in got] == sorted(rows)


def test_free_text_of_every_document(spark):
    import regex

    from quern.functions.text import SIGNATURES
    from quern.plans import registry

    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    sign = lambda v: next((n for n, shape, also in SIGNATURES if regex.search(shape, v) and (not also or regex.search(also, v))), None)
    want = {d: sign(v) in ("SENTENCE_TEXT", "TITLE_CASE_WORDS", "LOWER_WORDS", "MIXED") and len(v) >= 3 for d, v in docs.items()}
    assert {r.doc_id: r.free_text for r in registry.queries()["prof_free_text"](spark, "/root/testdata/sf0.001").collect()} == want


def test_additivity_by_name():
    from quern.operators import aggregation as A

    rates = ("Profit Margin", "ProfitMargin", "Température", "Udział", "z_score", "CreditScore", "GDPPerCapita", "ppm", "latency")
    assert {n: A.additivity_of(n) for n in rates} == dict.fromkeys(rates, "intensive_rate")
    sums = ("Price", "Tax", "Discount", "Storage", "Usage", "Capital", "Lat", "lng")
    assert {n: A.additivity_of(n) for n in sums} == dict.fromkeys(sums, "additive")
    assert A.additivity_of("StoreLatitude", "additive") == A.additivity_of("longitude") == "suppressed"
    assert A.additivity_of("Margin", "part_of_whole") == "part_of_whole" and A.additivity_of("Margin", "unknown") == "intensive_rate"
