"""Places: recognising, keys, extents, points and polygons over small reference tables.

The reference tables are parameters; the ones here are short hand-written lists for the United
States and some thirty countries.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.operators.ranks import order_statistics

#: ISO 3166 codes, names and continents of a short list of countries.
COUNTRIES = """
US USA United States;north-america CA CAN Canada;north-america MX MEX Mexico;north-america BR BRA Brazil;south-america AR ARG Argentina;south-america CL CHL Chile;south-america
GB GBR United Kingdom;europe FR FRA France;europe DE DEU Germany;europe ES ESP Spain;europe IT ITA Italy;europe NL NLD Netherlands;europe SE SWE Sweden;europe PL POL Poland;europe CH CHE Switzerland;europe AT AUT Austria;europe IE IRL Ireland;europe PT PRT Portugal;europe
EG EGY Egypt;africa ZA ZAF South Africa;africa NG NGA Nigeria;africa KE KEN Kenya;africa MA MAR Morocco;africa
CN CHN China;asia JP JPN Japan;asia IN IND India;asia KR KOR South Korea;asia ID IDN Indonesia;asia TR TUR Turkey;asia SA SAU Saudi Arabia;asia AE ARE United Arab Emirates;asia IR IRN Iran;asia
AU AUS Australia;oceania NZ NZL New Zealand;oceania
"""
#: States of the United States.
STATES = "AL Alabama,AK Alaska,AZ Arizona,AR Arkansas,CA California,CO Colorado,CT Connecticut,DE Delaware,DC District of Columbia,FL Florida,GA Georgia,HI Hawaii,ID Idaho,IL Illinois,IN Indiana,IA Iowa,KS Kansas,KY Kentucky,LA Louisiana,ME Maine,MD Maryland,MA Massachusetts,MI Michigan,MN Minnesota,MS Mississippi,MO Missouri,MT Montana,NE Nebraska,NV Nevada,NH New Hampshire,NJ New Jersey,NM New Mexico,NY New York,NC North Carolina,ND North Dakota,OH Ohio,OK Oklahoma,OR Oregon,PA Pennsylvania,RI Rhode Island,SC South Carolina,SD South Dakota,TN Tennessee,TX Texas,UT Utah,VT Vermont,VA Virginia,WA Washington,WV West Virginia,WI Wisconsin,WY Wyoming"
#: Cities (name, state or region, ISO 3, latitude, longitude, people in thousands).
CITIES = (
    ("Boston", "MA", "USA", 42.36, -71.06, 650), ("Chicago", "IL", "USA", 41.88, -87.63, 2700), ("Portland", "OR", "USA", 45.52, -122.68, 650), ("Portland", "ME", "USA", 43.66, -70.26, 68), ("Springfield", "IL", "USA", 39.80, -89.64, 114),
    ("Springfield", "MA", "USA", 42.10, -72.59, 155), ("Springfield", "MO", "USA", 37.21, -93.29, 169), ("Paris", "IDF", "FRA", 48.86, 2.35, 2100), ("Paris", "TX", "USA", 33.66, -95.56, 25), ("London", "ENG", "GBR", 51.51, -0.13, 8900),
    ("London", "ON", "CAN", 42.98, -81.25, 400), ("Toronto", "ON", "CAN", 43.65, -79.38, 2800), ("Berlin", "BE", "DEU", 52.52, 13.40, 3700), ("Zürich", "ZH", "CHE", 47.38, 8.54, 430), ("Madrid", "MD", "ESP", 40.42, -3.70, 3300), ("Tokyo", "13", "JPN", 35.69, 139.69, 9700),
)
#: Windows of continent maps (west, south, east, north) and the boxes of the United States and North America (south, north, west, east).
FRAMES = {"europe": (-25, 34, 45, 71.5), "asia": (25, -11, 150, 56), "africa": (-26, -35, 58, 38), "south-america": (-92, -56, -34, 13), "north-america": (-168, 7, -52, 72), "oceania": (110, -48, 200, 20)}
USA_BOXES = ((24.4, 49.4, -125.0, -66.9), (51.2, 71.5, -168.0, -129.9), (18.9, 22.3, -160.3, -154.8))
NA_BOX = (7.0, 72.0, -172.0, -52.0)
MIDDLE_EAST = "AE BH CY EG IL IQ IR JO KW LB OM PS QA SA SY TR YE".split()


def normal_name(s: str) -> str:
    """Without accents, lower case, punctuation as spaces."""
    flat = "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c)).lower()
    return " ".join("".join(c if c.isalpha() or c.isdecimal() or c.isspace() else " " for c in flat.replace("ß", "ss").replace("ø", "o").replace("ł", "l").replace("æ", "ae")).split())


#: Latin letters with accents and what they are without, for names on executors.
_ACCENTED = "".join(c for c in map(chr, range(0xC0, 0x250)) if len(b := unicodedata.normalize("NFD", c)) > 1 and b[0].isascii())
_PLAIN = "".join(unicodedata.normalize("NFD", c)[0] for c in _ACCENTED)


def normal_name_column(x: Column) -> Column:
    """:func:`normal_name` for Latin letters as a column expression."""
    flat = F.regexp_replace(F.translate(x, _ACCENTED, _PLAIN), r"\p{M}", "")
    for a, b in (("ß", "ss"), ("ø", "o"), ("ł", "l"), ("æ", "ae")):
        flat = F.replace(F.replace(flat, F.lit(a), F.lit(b)), F.lit(a.upper()), F.lit(b))
    return F.trim(F.regexp_replace(F.lower(flat), r"[^\p{L}\p{Nd}]+", " "))


def loose_key(x: Column) -> Column:
    """Letters and digits only, ``&`` as and; keys under 4 characters are no keys."""
    key = F.replace(normal_name_column(F.replace(x, F.lit("&"), F.lit(" and "))), F.lit(" "))
    return F.when(F.length(key) >= 4, key)


def country_rows() -> list[tuple[str, str, str, str]]:
    out, words = [], COUNTRIES.split()
    while words:
        iso2, iso3, name = words.pop(0), words.pop(0), []
        while ";" not in words[0]:
            name.append(words.pop(0))
        last, region = words.pop(0).split(";")
        out.append((iso2, iso3, " ".join([*name, last]), region))
    return out


def countries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(country_rows(), "iso2 string, iso3 string, name string, region string")


def country_keys(spark: SparkSession) -> DataFrame:
    """(key, iso3): codes, names and common other names, normalised."""
    rows = {}
    for iso2, iso3, name, _ in country_rows():
        rows |= {iso2.lower(): iso3, iso3.lower(): iso3, normal_name(name): iso3}
    rows |= {"uk": "GBR", "england": "GBR", "usa": "USA", "united states of america": "USA", "deutschland": "DEU", "espana": "ESP", "korea": "KOR", "uae": "ARE"}
    return spark.createDataFrame(sorted(rows.items()), "key string, iso string")


def state_keys(spark: SparkSession) -> DataFrame:
    rows = [s.split(" ", 1) for s in STATES.split(",")]
    return spark.createDataFrame([(c.lower(), c) for c, _ in rows] + [(n.lower(), c) for c, n in rows], "key string, iso string")


def zip5(x: Column) -> Column:
    """A ZIP code however it arrived: +4 cut, lost leading zeros put back, a float's ``.0`` dropped."""
    v = F.regexp_replace(F.trim(x), r"\.0+$", "")
    return F.when(v.rlike(r"^\d{5}(-\d{4})?$"), F.substring(v, 1, 5)).when(v.rlike(r"^\d{3,4}$"), F.lpad(v, 5, "0"))


def zip_prefixes(x: Column) -> Column:
    """Readings as a 3-digit prefix, likeliest first."""
    v = F.regexp_replace(F.trim(x), r"\.0+$", "")
    bare = v.rlike(r"^\d{3}$")
    padded = F.substring(F.lpad(v, 5, "0"), 1, 3)
    return F.when(bare, F.array_distinct(F.array(v, padded))).when(zip5(x).isNotNull(), F.array(F.substring(zip5(x), 1, 3))).otherwise(F.array().cast("array<string>"))


def to_iso(df: DataFrame, column: str, kind: str, out: str = "__geoIso__") -> DataFrame:
    """``df`` with the join key of a country, state, ZIP or county cell; null where there is none."""
    spark, x = df.sparkSession, F.trim(F.col(column).cast("string"))
    if kind == "us-zip5":
        return df.withColumn(out, zip5(x))
    if kind == "us-county-fips":
        return df.withColumn(out, F.when(x.rlike(r"^\d{5}$"), x))
    keys = country_keys(spark) if kind.startswith("country") else state_keys(spark)  # fixed, short lists
    keys = keys.select(F.col("key").alias("__key"), F.col("iso").alias(out))
    return df.drop(out).withColumn("__name", normal_name_column(x)).join(F.broadcast(keys), F.col("__name") == F.col("__key"), "left").drop("__name", "__key")


def iso_column(df: DataFrame, column: str, kind: str) -> DataFrame:
    """(matched_rows, total_rows, matched_values, unmatched_values)."""
    by = df.filter(F.coalesce(F.trim(F.col(column)), F.lit("")) != "").groupBy(column).agg(F.count("*").alias("n"))
    keyed = to_iso(by, column, kind)
    return keyed.agg(F.coalesce(F.sum(F.when(F.col("__geoIso__").isNotNull(), F.col("n"))), F.lit(0)).alias("matched_rows"), F.sum("n").alias("total_rows"), F.count("__geoIso__").alias("matched_values"), F.count_if(F.col("__geoIso__").isNull()).alias("unmatched_values"))


def detect(df: DataFrame, column: str, share: float = 0.95, least: int = 2) -> DataFrame:
    """(kind, pct) of the kinds that at least ``share`` of the distinct values fit, best first."""
    values = df.filter(F.coalesce(F.trim(F.col(column)), F.lit("")) != "").select(F.trim(column).alias("v")).distinct()
    keyed = to_iso(to_iso(values, "v", "country", "country"), "v", "us-state", "state")
    kinds = {
        "country-iso2": F.col("country").isNotNull() & (F.length("v") == 2), "country-iso3": F.col("country").isNotNull() & (F.length("v") == 3), "country-name": F.col("country").isNotNull() & (F.length("v") > 3),
        "us-state-code": F.col("state").isNotNull() & (F.length("v") == 2), "us-state-name": F.col("state").isNotNull() & (F.length("v") > 2), "us-zip5": zip5(F.col("v")).isNotNull(), "us-county-fips": F.col("v").rlike(r"^\d{5}$"),
    }
    row = keyed.agg(F.count("*").alias("d"), *(F.avg(c.cast("int")).alias(k) for k, c in kinds.items()))
    items = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(f"`{k}`").alias("pct")) for k in kinds))
    return row.filter(F.col("d") >= least).select(F.inline(items)).filter(F.col("pct") >= share).orderBy(F.col("pct").desc(), "kind")


def regions(df: DataFrame, column: str) -> DataFrame:
    """(region, rows, pct) of country cells by continent, by row weight."""
    by = to_iso(df.groupBy(column).agg(F.count("*").alias("n")), column, "country", "iso")
    named = by.filter("iso IS NOT NULL").join(F.broadcast(countries(df.sparkSession).select("iso3", "region")), F.col("iso") == F.col("iso3"))
    total = named.agg(F.sum("n").alias("t"))
    return named.groupBy("region").agg(F.sum("n").alias("rows")).crossJoin(F.broadcast(total)).select("region", "rows", (F.floor(1000.0 * F.col("rows") / F.col("t") + 0.5) / 10).alias("pct"))  # one row


def _in_box(lat: Column, lon: Column, box: Sequence[float]) -> Column:
    return lat.between(box[0], box[1]) & lon.between(box[2], box[3])


def extent(df: DataFrame, lat: str, lon: str) -> DataFrame:
    """One row: n, pct_usa, pct_na, 5th and 95th percentiles, the share in each frame and the dominant one; none under 3 points."""
    a, o = F.col(lat).cast("double"), F.col(lon).cast("double")
    rows = df.select(a.alias("a"), o.alias("o")).filter(a.between(-90, 90) & o.between(-180, 180))
    a, o = F.col("a"), F.col("o")
    pct = lambda c: F.floor(F.avg(c.cast("int")) * 1000 + 0.5) / 10
    usa = reduce(lambda x, y: x | y, (_in_box(a, o, b) for b in USA_BOXES))
    framed = {k: a.between(s, n) & (o.between(w, e) | (o + 360).between(w, e)) for k, (w, s, e, n) in sorted(FRAMES.items())}
    row = rows.agg(F.count("*").alias("n"), pct(usa).alias("pct_usa"), pct(_in_box(a, o, NA_BOX)).alias("pct_na"), *(pct(c).alias(k.replace("-", "_")) for k, c in framed.items()))
    names = [k.replace("-", "_") for k in framed]
    top = F.greatest(*names)
    dominant = F.lit(None).cast("string")
    for k in reversed(list(framed)):
        dominant = F.when((F.col(k.replace("-", "_")) == top) & (top > 0), k).otherwise(dominant)
    row = row.withColumn("dominant_frame", dominant)
    for c, name in (("a", "lat"), ("o", "lon")):
        q = order_statistics(rows, [], c, {"p5": 0.05, "p95": 0.95}, "linear")
        row = row.crossJoin(F.broadcast(q.select(*((F.floor(F.col(p) * 10 + 0.5) / 10).alias(f"{name}_{p}") for p in ("p5", "p95")))))  # one row
    return row.filter("n >= 3")


def cities(spark: SparkSession) -> DataFrame:
    rows = [(normal_name(n), s, c, float(a), float(o), p) for n, s, c, a, o, p in CITIES]
    return spark.createDataFrame(rows, "city_key string, city_state string, city_iso string, city_lat double, city_lon double, people int")


def points(df: DataFrame, key: str, lat: str | None = None, lon: str | None = None, city: str | None = None, state: str | None = None, country: str | None = None) -> DataFrame:
    """(key, lat, lon, precision): the best of coordinates, then a city that is one place given its state and country.

    Cities that remain several places (at 2 decimals) are ``ambiguous`` and not placed; (0, 0) is
    no coordinate.
    """
    text = lambda c: F.col(c).cast("string") if c else F.lit(None).cast("string")
    number = lambda c: F.col(c).cast("double") if c else F.lit(None).cast("double")
    rows = df.select(F.col(key), number(lat).alias("a"), number(lon).alias("o"), normal_name_column(text(city)).alias("c"), F.upper(F.trim(text(state))).alias("s"), text(country).alias("k"))
    rows = to_iso(rows, "k", "country", "iso")
    fits = F.coalesce(F.col("a").between(-90, 90) & F.col("o").between(-180, 180) & ~((F.col("a") == 0) & (F.col("o") == 0)), F.lit(False))
    # places per (city, state, country) first: the list is short, and so are the distinct cells
    cells = rows.filter(~fits & (F.col("c") != "")).select("c", "s", "iso").distinct()
    match = cells.join(F.broadcast(cities(df.sparkSession)), F.col("c") == F.col("city_key"))
    scored = match.withColumn("score", F.coalesce((F.col("s") == F.col("city_state")).cast("int"), F.lit(0)) * 2 + F.coalesce((F.col("iso") == F.col("city_iso")).cast("int"), F.lit(0)))
    best = scored.withColumn("top", F.max("score").over(Window.partitionBy("c", "s", "iso"))).filter("score = top")
    placed = best.groupBy("c", "s", "iso").agg(F.countDistinct(F.round("city_lat", 2), F.round("city_lon", 2)).alias("places"), F.first("city_lat").alias("la"), F.first("city_lon").alias("lo"))
    placed = placed.select(F.col("c").alias("pc"), F.col("s").alias("ps"), F.col("iso").alias("pi"), "places", "la", "lo")
    joined = rows.join(placed, (F.col("c") == F.col("pc")) & F.col("s").eqNullSafe(F.col("ps")) & F.col("iso").eqNullSafe(F.col("pi")), "left")
    precision = F.when(fits, "latlon").when(F.col("places") == 1, "city").when(F.col("places") > 1, "ambiguous").otherwise("none")
    return joined.select(key, F.when(fits, F.col("a")).when(F.col("places") == 1, F.col("la")).alias("lat"), F.when(fits, F.col("o")).when(F.col("places") == 1, F.col("lo")).alias("lon"), precision.alias("precision"))


def in_regions(df: DataFrame, lat: str, lon: str, shapes: dict[str, Sequence[tuple[float, float]]], out: str = "region") -> DataFrame:
    """``df`` with the first polygon (of (lon, lat) corners) that holds the point; a box test comes first."""
    from quern.operators.filters import inside_polygon

    found = F.lit(None).cast("string")
    for name, corners in reversed(list(shapes.items())):
        found = F.when(inside_polygon(F.col(lon), F.col(lat), corners), name).otherwise(found)
    return df.withColumn(out, found)


def city_region(spark: SparkSession, ratio: float = 10.0) -> DataFrame:
    """(city_key, city_state, tie): a city's region, a tie unless the largest place is ``ratio`` times the next."""
    w = Window.partitionBy("city_key").orderBy(F.col("people").desc())
    c = cities(spark).withColumn("rank", F.row_number().over(w)).withColumn("next", F.lead("people").over(w))
    return c.filter("rank = 1").select("city_key", "city_state", (F.col("next") * ratio > F.col("people")).alias("tie")).withColumn("tie", F.coalesce("tie", F.lit(False)))
