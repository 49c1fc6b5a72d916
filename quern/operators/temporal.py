"""Time axes: recognising, reading, measuring and completing them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400_000_000  # microseconds

#: Fixed value: period texts (2024, 2024-Q1, Q1-2024, 2024-01, 2024-W12, Jan 2024).
PERIOD = (
    r"(?i)^(?:(?:19|20)\d{2}(?:[-/ ]?(?:q[1-4]|w(?:0?[1-9]|[1-4]\d|5[0-3])|(?:0?[1-9]|1[0-2])))?"
    r"|q[1-4][-/ ](?:19|20)\d{2}|(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*[-/ ]?(?:19|20)?\d{2})$"
)
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
#: Fixed values: (least, most) median days between points, and the period that is.
GRAINS = ((0.0, 0.95, "hour"), (0.95, 1.05, "day"), (6.5, 7.5, "week"), (27.0, 31.5, "month"), (88.0, 93.0, "quarter"), (362.0, 368.0, "year"))


def parse_point(x: Column) -> Column:
    """Text to the start of the time that it names; null if it names none."""
    t = F.lower(F.trim(x))
    year = F.regexp_extract(t, r"((?:19|20)\d{2})", 1)

    def date(y: Column, m: Column, d: Column = None) -> Column:
        return F.to_timestamp(F.try_make_timestamp(y.cast("int"), m.cast("int"), (F.lit(1) if d is None else d).cast("int"), F.lit(0), F.lit(0), F.lit(0)))

    month_word = F.lit(None).cast("int")
    for k, m in enumerate(MONTHS):
        month_word = F.when(t.startswith(m), k + 1).otherwise(month_word)
    quarter = (F.regexp_extract(t, r"q([1-4])", 1).try_cast("int") - 1) * 3 + 1
    return (
        F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(t))
        .when(t.rlike(r"^(19|20)\d{2}[-/ ]?q[1-4]$") | t.rlike(r"^q[1-4][-/ ]?(19|20)\d{2}$"), date(year, quarter))
        .when(t.rlike(r"^(19|20)\d{2}[-/](0?[1-9]|1[0-2])$"), date(year, F.regexp_extract(t, r"[-/](\d{1,2})$", 1).try_cast("int")))
        .when(t.rlike(r"^(19|20)\d{6}$"), date(F.substring(t, 1, 4).try_cast("int"), F.substring(t, 5, 2).try_cast("int"), F.substring(t, 7, 2).try_cast("int")))
        .when(t.rlike(r"^(19|20)\d{2}(0[1-9]|1[0-2])$"), date(F.substring(t, 1, 4).try_cast("int"), F.substring(t, 5, 2).try_cast("int")))
        .when(t.rlike(r"^(19\d{2}|20\d{2}|2100)$"), date(t.try_cast("int"), F.lit(1)))
        .when(month_word.isNotNull() & t.rlike(r"^[a-z]+[-/ ]+(19|20)\d{2}$"), date(year, month_word))
    )


def classify_integer(name_has_year: bool, low: Column, high: Column, distinct: Column, all_yyyymm: Column, all_yyyymmdd: Column) -> Column:
    """Whole numbers that are a time axis: years by name or in a run without gaps, or all YYYYMM or YYYYMMDD."""
    years = (low >= 1900) & (high <= 2100)
    run = (distinct >= 3) & (high - low + 1 == distinct)
    return (years & (F.lit(name_has_year) | run)) | all_yyyymm | all_yyyymmdd


def classify_text(values: DataFrame, column: str, sample: int = 60, floor: float = 0.8) -> DataFrame:
    """(sampled, share, is_temporal): the first ``sample`` distinct values by text, a sampling rule."""
    head = values.filter(F.col(column).isNotNull()).select(F.col(column).alias("v")).distinct().orderBy("v").limit(sample)
    row = head.agg(F.count("*").alias("sampled"), F.avg(F.col("v").rlike(PERIOD).cast("int")).alias("share"))
    return row.withColumn("is_temporal", F.coalesce(F.col("share") >= floor, F.lit(False)))


def day_number(t: Column) -> Column:
    return F.unix_date(F.to_date(t))


def weekday_number(t: Column) -> Column:
    """Mondays to Fridays up to a day, counted without a gap for weekends."""
    d = day_number(t) + 3  # days since a Monday
    return F.floor(d / 7) * 5 + F.least(F.pmod(d, F.lit(7)), F.lit(5))


def unit_number(t: Column, grain: Column | str, step_us: Column | None = None) -> Column:
    """A stamp's number in whole periods of its grain."""
    g = F.lit(grain) if isinstance(grain, str) else grain
    micros = F.unix_micros(t.cast("timestamp"))
    months = F.year(t) * 12 + F.month(t) - 1
    hour = F.round(micros / step_us) if step_us is not None else F.floor(micros / (DAY / 24))
    return (
        F.when(g == "year", F.year(t)).when(g == "quarter", F.floor(months / 3)).when(g == "month", months).when(g == "week", F.floor((day_number(t) + 3) / 7))
        .when(g == "weekday", weekday_number(t)).when(g == "day", day_number(t)).otherwise(hour).cast("long")
    )


def period_start(t: Column, grain: str) -> Column:
    return F.date_trunc("day" if grain == "weekday" else grain, t)


def cadence(stamps: DataFrame, column: str, gap_factor: int = 5) -> DataFrame:
    """(grain, points, expected_points, coverage_pct, runs, largest_gap, first, last) of a time axis.

    Points are distinct stamps. At least three are needed. A run ends where more than
    ``gap_factor`` periods are missing. Distinct stamps of an axis are few next to rows; they are
    still ordered by ranges of time, not in one task: neighbours are found inside a year, and a
    year's first stamp meets the last one before it through one row a year.
    """
    points = stamps.filter(F.col(column).isNotNull()).select(F.col(column).cast("timestamp").alias("t")).distinct().withColumn("y", F.year("t"))
    ends = points.groupBy("y").agg(F.max("t").alias("last"))
    before = ends.select("y", F.lag("last").over(Window.orderBy("y")).alias("carried"))  # a row a year
    own = Window.partitionBy("y").orderBy("t")
    steps = points.join(F.broadcast(before), "y").withColumn("p", F.coalesce(F.lag("t").over(own), "carried"))
    micros = (F.unix_micros("t") - F.unix_micros("p")).cast("double")
    gaps = steps.withColumn("step", micros).withColumn("weekend", F.dayofweek("t").isin(1, 7))
    row = gaps.agg(F.percentile("step", 0.5).alias("step_us"), F.count("*").alias("points"), F.min("t").alias("first"), F.max("t").alias("last"), F.bool_or("weekend").alias("weekend"))
    days = F.col("step_us") / DAY
    grain = F.lit("irregular")
    for lo, hi, name in GRAINS:
        grain = F.when((days >= lo) & (days < hi) if name == "hour" else (days >= lo) & (days <= hi), name).otherwise(grain)
    weekdays = (grain == "day") & ~F.col("weekend") & (F.col("points") >= 7)
    row = row.withColumn("grain", F.when(weekdays, "weekday").otherwise(grain)).filter("points >= 3")
    unit = lambda c: unit_number(F.col(c), F.col("grain"), F.col("step_us"))
    # (the percentile is over distinct steps, few whatever the number of rows)
    joined = gaps.crossJoin(F.broadcast(row.select("grain", "step_us"))).withColumn("units", unit("t") - unit("p"))
    tally = joined.agg(F.count_if(F.col("units") > gap_factor).alias("breaks"), F.max("units").alias("largest_gap"))
    expected = unit("last") - unit("first") + 1
    out = row.crossJoin(F.broadcast(tally)).withColumn("expected_points", F.when(F.col("grain") != "irregular", expected))  # one row each
    coverage = F.floor(1000.0 * F.col("points") / F.col("expected_points") + 0.5) / 10
    return out.select("grain", "points", "expected_points", F.when(coverage.isNotNull(), F.least(F.lit(100.0), coverage)).alias("coverage_pct"), (F.col("breaks") + 1).alias("runs"), "largest_gap", "first", "last")


def series_completeness(df: DataFrame, series: str, stamp: str, grain: str, worst: int = 8) -> DataFrame:
    """(series, points, late, early, holes, largest_gap, coverage): the least covered series on the whole axis' grid."""
    points = df.filter(F.col(series).isNotNull() & F.col(stamp).isNotNull()).select(F.col(series).cast("string").alias("series"), unit_number(F.col(stamp), grain).alias("u")).distinct()
    span = points.agg(F.min("u").alias("a"), F.max("u").alias("b"))
    own = Window.partitionBy("series").orderBy("u")
    each = points.withColumn("gap", F.col("u") - F.lag("u").over(own) - 1).groupBy("series").agg(F.count("*").alias("points"), F.min("u").alias("lo"), F.max("u").alias("hi"), F.coalesce(F.max("gap"), F.lit(0)).alias("largest_gap"))
    grid = each.crossJoin(F.broadcast(span))  # one row
    listed = grid.select("series", "points", (F.col("lo") - F.col("a")).alias("late"), (F.col("b") - F.col("hi")).alias("early"), (F.col("hi") - F.col("lo") + 1 - F.col("points")).alias("holes"), "largest_gap", (F.col("points") / (F.col("b") - F.col("a") + 1)).alias("coverage"))
    return listed.orderBy("coverage", "series").limit(worst)


#: Excel and .NET date tokens and the patterns that print the same.
TOKENS = (("yyyy", "yyyy"), ("yy", "yy"), ("mmmm", "MMMM"), ("mmm", "MMM"), ("mm", "MM"), ("m", "M"), ("dddd", "EEEE"), ("ddd", "EEE"), ("dd", "dd"), ("d", "d"), ("hh", "HH"), ("h", "H"), ("ss", "ss"), ("s", "s"))


def date_pattern(source: str) -> str:
    """An Excel-style date format as a Java pattern; m after an hour or before a second means minutes."""
    out, at, after_hour = [], 0, False
    low = source.lower()
    while at < len(source):
        for token, pattern in TOKENS:
            if low.startswith(token, at):
                rest = low[at + len(token) :].lstrip(":.")
                if token in ("m", "mm") and (after_hour or rest.startswith("s")):
                    pattern = pattern.lower()
                after_hour = token in ("h", "hh")
                out.append(pattern)
                at += len(token)
                break
        else:
            if low.startswith("am/pm", at):
                out = [p.replace("H", "h") for p in out] + ["a"]
                at += 5
            else:
                out.append(f"'{source[at]}'" if source[at].isalpha() else source[at])
                at += 1
    return "".join(out)


def utc_anchor(df: DataFrame, column: str, zone: str) -> DataFrame:
    """Re-anchor a column to UTC if every stamp of it is midnight in ``zone`` and not every one is in UTC; the whole column or nothing."""
    t = F.col(column)
    local = F.from_utc_timestamp(t, zone)
    row = df.agg((F.coalesce(F.bool_and(local == F.date_trunc("day", local)), F.lit(False)) & ~F.coalesce(F.bool_and(t == F.date_trunc("day", t)), F.lit(True))).alias("__shift"))
    return df.crossJoin(F.broadcast(row)).withColumn(column, F.when(F.col("__shift"), local).otherwise(t)).drop("__shift")  # one row
