"""Sources: CSV text, grids, tables, objects, typed tables, model results, line logs."""

from __future__ import annotations

import csv
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as X
from quern.operators.profile import engine_types

#: Lines that a delimiter is guessed from.
PREVIEW = 20


def sniff_delimiter(lines: Sequence[str]) -> str:
    """The separator that splits the preview into the most equal, most numerous parts."""
    def parts(line: str, sep: str) -> int:
        return re.sub(r'"[^"]*"', "", line).count(sep)

    best, found = (0, 0), ","
    for sep in (",", "\t", ";", "|"):
        counts = [parts(x, sep) for x in lines if x.strip()]
        score = (sum(c == counts[0] for c in counts) if counts and counts[0] else 0, counts[0] if counts else 0)
        if score > best:
            best, found = score, sep
    return found


def read_csv(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """All columns as text; blank lines are dropped, quoted empty cells are kept, header names are trimmed."""
    head = [r.value for r in spark.read.text(path).limit(PREVIEW).collect()]
    if sum(1 for x in head if x.strip()) < 2:
        raise ValueError("a header and at least one row are needed")
    sep = separator or sniff_delimiter([h.lstrip("\ufeff") for h in head])
    df = spark.read.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"').option("multiLine", True).option("ignoreLeadingWhiteSpace", False).csv(path)
    # the reader renames repeated names, so they come from the header itself
    names = next(csv.reader([next(x for x in head if x.strip()).lstrip("\ufeff")], delimiter=sep))
    names = [n.strip() for n in names] if len(names) == len(df.columns) else df.columns
    return df.toDF(*tell_apart(names))


def from_grid(spark: SparkSession, header: Sequence[str], rows: Sequence[Sequence]) -> DataFrame:
    names = tell_apart([h.strip() for h in header])
    return spark.createDataFrame([tuple(None if v is None else str(v) for v in r) for r in rows], ", ".join(f"`{n}` string" for n in names))


def from_objects(spark: SparkSession, rows: Sequence[dict], scan: int = 500) -> DataFrame:
    """Records of text cells; columns are the keys of the first ``scan`` records in order of first sight."""
    names = list(dict.fromkeys(k for r in rows[:scan] for k in r))
    return spark.createDataFrame([tuple(None if r.get(n) is None else str(r[n]) for n in names) for r in rows], ", ".join(f"`{n}` string" for n in names))


def tell_apart(names: Sequence[str]) -> list[str]:
    """Repeated names get (2), (3), ..."""
    out: list[str] = []
    for n in names:
        k, new = 1, n
        while new in out:
            k += 1
            new = f"{n} ({k})"
        out.append(new)
    return out


def collapse_aggregate(names: Sequence[str]) -> list[str]:
    """Sum of Sum of X is Sum of X, unless that name is taken."""
    out = list(names)
    for k, n in enumerate(names):
        new = re.sub(r"^((?:Sum|Average|Count|Min|Max) of )(?:\1)+", r"\1", n)
        if new != n and new not in out:
            out[k] = new
    return out


def model_names(headers: Sequence[str]) -> list[str]:
    """'Table'[Column] headers as bare names where those are unique; ]] stands for ]."""
    bare = [m[1].replace("]]", "]") if (m := re.search(r"\[((?:[^\]]|\]\])*)\]$", h)) else h for h in headers]
    return [b if bare.count(b) == 1 else h for b, h in zip(bare, headers, strict=True)]


def sql_engine_type(sql_type: str) -> str:
    name = re.sub(r"\(.*\)", "", sql_type).strip().lower()
    if name in ("tinyint", "smallint", "int", "integer", "bigint", "long", "short", "byte"):
        return "Integer"
    if name in ("decimal", "numeric", "float", "double", "real", "money", "smallmoney"):
        return "Decimal"
    return "DateTime" if name.startswith(("date", "timestamp", "time")) else "String"


def infer_types(df: DataFrame) -> DataFrame:
    """(column, data_type) of text columns: every cell counts, blanks and spreadsheet errors do not."""
    aggs = []
    for c in df.columns:
        kind = X.cell_kind(X.blank_errors(F.col(c)))
        aggs += [F.count_if(kind == k).alias(f"{c}|{k}") for k in ("date", "int", "num", "other")]
    row = df.agg(*aggs)
    items = []
    for c in df.columns:
        d, i, n, o = (F.col(f"`{c}|{k}`") for k in ("date", "int", "num", "other"))
        kind = F.when((o > 0) | (d + i + n == 0), "String").when((d > 0) & (i + n == 0), "DateTime").when(d > 0, "String").when(n == 0, "Integer").otherwise("Decimal")
        items.append(F.struct(F.lit(c).alias("column"), kind.alias("data_type")))
    return row.select(F.inline(F.array(*items)))


def decimal_separator(df: DataFrame, column: str, default: str = ".") -> DataFrame:
    """(dots, commas, separator): a comma needs evidence for it and none for the point."""
    v = F.trim(X.fold_numerals(F.col(column)))
    clear = ~v.rlike(X.AMBIGUOUS)
    row = df.agg(F.count_if(clear & v.rlike(X.DOT_DECIMAL)).alias("dots"), F.count_if(clear & ~v.rlike(X.DOT_DECIMAL) & v.rlike(X.COMMA_DECIMAL)).alias("commas"))
    return row.withColumn("separator", F.when((F.col("commas") > 0) & (F.col("dots") == 0), ",").when(F.col("dots") > 0, ".").otherwise(default))


def converted(x: Column, kind: str, separator: str = ".") -> Column:
    """A text cell in its engine type; what does not fit is null."""
    if kind == "Integer":
        return F.when(F.trim(X.fold_numerals(x)).rlike(r"^[+-]?\d{1,15}$"), F.trim(X.fold_numerals(x)).try_cast("long"))
    if kind == "Decimal":
        return X.parse_number(x, separator)
    return F.try_to_timestamp(F.trim(x)) if kind == "DateTime" else x


def typed(df: DataFrame) -> DataFrame:
    """Text columns in the types that all of their cells fit."""
    kinds = {r["column"]: r["data_type"] for r in infer_types(df).collect()}  # a row a column
    return df.select(*(converted(X.blank_errors(F.col(c)) if kinds[c] != "String" else F.col(c), kinds[c]).alias(c) for c in df.columns))


def deduplicated(df: DataFrame, order: str) -> DataFrame:
    """Of rows that are equal but for ``order``, the first. Compared by value, so nothing collides."""
    others = [c for c in df.columns if c != order]
    return df.groupBy(*others).agg(F.min(order).alias(order)).select(*df.columns)


#: Orders of the parts of a numeric date, and how evidence for them looks.
_DATE = r"^(\d{1,4})([/.\-])(\d{1,2})\2(\d{1,4})(?:[ T](\d{1,2}):(\d{2})(?::(\d{2}))?)?$"


def text_date_order(df: DataFrame, column: str, month_first: bool = True) -> DataFrame:
    """(cells, readable, order): ymd, dmy or mdy for a whole column of numeric dates, null where the evidence disagrees.

    A part over 12 decides; a point means day first; else the locale does.
    """
    v = F.trim(F.col(column))
    a, sep, b = (F.regexp_extract(v, _DATE, k) for k in (1, 2, 3))
    fits = v.rlike(_DATE)
    rows = df.filter(F.coalesce(v, F.lit("")) != "").select(fits.alias("fits"), a.try_cast("int").alias("a"), F.length(a).alias("wide"), b.try_cast("int").alias("b"), sep.alias("sep"))
    row = rows.agg(
        F.count("*").alias("cells"), F.count_if(F.col("fits")).alias("readable"), F.count_if(F.col("wide") == 4).alias("iso"), F.countDistinct(F.when(F.col("fits"), F.col("sep"))).alias("seps"),
        F.bool_or(F.col("sep") == ".").alias("dot"), F.count_if((F.col("a") > 12) & (F.col("wide") < 4)).alias("first_big"), F.count_if((F.col("b") > 12) & (F.col("wide") < 4)).alias("second_big"),
    )
    one = (F.col("readable") == F.col("cells")) & (F.col("seps") == 1) & (F.col("cells") > 0)
    order = F.when(F.col("iso") == F.col("cells"), "ymd").when(F.col("iso") > 0, None).when((F.col("first_big") > 0) & (F.col("second_big") > 0), None).when(F.col("first_big") > 0, "dmy").when(F.col("second_big") > 0, "mdy").when(F.col("dot"), "dmy").otherwise("mdy" if month_first else "dmy")
    return row.select("cells", "readable", F.when(one, order).alias("order"))


def read_text_date(x: Column, order: str) -> Column:
    """A numeric date under an order of parts; impossible days are null, two-digit years are of this century up to 69."""
    v = F.trim(x)
    part = {"ymd": (1, 3, 4), "dmy": (4, 3, 1), "mdy": (4, 1, 3)}[order]
    y, m, d = (F.regexp_extract(v, _DATE, k).try_cast("int") for k in part)
    year = F.when(y < 70, y + 2000).when(y < 100, y + 1900).otherwise(y)
    h, mi, s = (F.coalesce(F.regexp_extract(v, _DATE, k).try_cast("int"), F.lit(0)) for k in (5, 6, 7))
    return F.try_make_timestamp(year, m, d, h, mi, s)


def date_pattern_of(df: DataFrame, column: str, sample: int = 200, floor: float = 0.8) -> DataFrame:
    """(sampled, pattern): the shape of at least ``floor`` of the first ``sample`` distinct values, a sampling rule."""
    head = df.filter(F.col(column).isNotNull()).select(F.trim(column).alias("v")).distinct().orderBy("v").limit(sample)
    shapes = {"%Y-%m-%d": r"^\d{4}-\d{2}-\d{2}$", "%Y-%m-%d %H:%M": r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}", "%Y/%m/%d": r"^\d{4}/\d{2}/\d{2}$", "%d.%m.%Y": r"^\d{1,2}\.\d{1,2}\.\d{4}$", "%Y-%m": r"^\d{4}-\d{2}$"}
    row = head.agg(F.count("*").alias("sampled"), *(F.count_if(F.col("v").rlike(r)).alias(p) for p, r in shapes.items()))
    best = F.lit(None).cast("string")
    for p in shapes:
        best = F.when(F.col(f"`{p}`") >= floor * F.col("sampled"), p).otherwise(best)
    return row.select("sampled", best.alias("pattern"))


def read_ndjson(spark: SparkSession, path: str) -> DataFrame:
    """(kind, result): of each file of JSON lines the typed result; unknown lines are skipped, none is an error row."""
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.from_json("value", "type string, result string, error string").alias("j"))
    by = lines.groupBy("file").agg(F.max(F.when(F.col("j.type") == "result", F.col("j.result"))).alias("result"), F.max("j.error").alias("error"))
    return by.select(F.when(F.col("result").isNotNull(), "result").otherwise("error").alias("kind"), F.coalesce("result", "error", F.lit("no result")).alias("result"))


def measure_roles(df: DataFrame) -> DataFrame:
    from quern.operators.profile import is_identifier_name

    rows = [(c, k, k in ("Integer", "Decimal") and not is_identifier_name(c)) for c, k in engine_types(df).items()]
    return df.sparkSession.createDataFrame(rows, "column string, data_type string, is_measure boolean")
