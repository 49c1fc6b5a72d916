"""Column functions over the text form of cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How spreadsheets of several languages write "not available", upper case.
NOT_AVAILABLE = ("#N/A", "#NV", "#N/D", "#N/D!", "#N/B", "#Н/Д", "#I/T", "#PUUTTUU!", "#SAKNAS!", "#HIÁNYZIK", "#NENÍ_K_DISPOZICI", "#YOK", "#GETTING_DATA")
#: Fixed value: the shape of all other error cells.
ERROR_SHAPE = r"^#[\p{Lu}\p{Nd}_/.¡¿]{1,24}[!?]$"

#: Zeros of the digit blocks that are read as ASCII digits (each block has ten digits in a row).
DIGIT_ZEROS = (0x0660, 0x06F0, 0x0966, 0x09E6, 0x0A66, 0x0AE6, 0x0B66, 0x0BE6, 0x0C66, 0x0CE6, 0x0D66, 0x0E50, 0x0ED0, 0x0F20, 0x1040, 0x17E0, 0xFF10)
SEPARATORS = {"٫": ".", "٬": ",", "．": ".", "，": ","}


def js_number(x: Column) -> Column:
    """A double as text without a trailing ``.0`` or an exponent."""
    whole = x.cast("decimal(38,0)").cast("string")
    small = x.cast("string")
    large = F.regexp_replace(x.cast("decimal(38,10)").cast("string"), r"\.?0+$", "")
    return F.when(x == F.floor(x), whole).when(F.abs(x) >= 1e7, large).otherwise(small)


def cell_text(x: Column, kind: str) -> Column:
    """The text form that cells are grouped by: numbers as written by hand, whole days as dates."""
    if kind in ("double", "float"):
        return js_number(x.cast("double"))
    if kind.startswith("timestamp"):
        return F.when(x == F.date_trunc("day", x), F.date_format(x, "yyyy-MM-dd")).otherwise(F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    return x.cast("string")


def is_error(x: Column) -> Column:
    """Whole-cell spreadsheet errors."""
    t = F.trim(x)
    return F.coalesce(t.rlike(ERROR_SHAPE) | F.upper(t).isin(*NOT_AVAILABLE), F.lit(False))


def blank_errors(x: Column) -> Column:
    return F.when(~is_error(x), x)


def fold_numerals(x: Column) -> Column:
    digits = "".join(chr(z + d) for z in DIGIT_ZEROS for d in range(10))
    return F.translate(x, digits + "".join(SEPARATORS), "0123456789" * len(DIGIT_ZEROS) + "".join(SEPARATORS.values()))


_EXPONENT = r"(?:[eE][+-]?\d+)?"
_SPACE = r"[ \u00A0\u202F]"
#: Shapes of numbers. A single group of three digits after one separator speaks for neither reading.
AMBIGUOUS = r"^[+-]?\d{1,3}[.,]\d{3}$"
DOT_NUMBER = rf"^[+-]?(?:\d{{1,3}}(?:,\d{{3}})+|\d+)(?:\.\d+)?{_EXPONENT}$"
COMMA_NUMBER = rf"^[+-]?(?:\d{{1,3}}(?:\.\d{{3}})+|\d{{1,3}}(?:{_SPACE}\d{{3}})+|\d+)(?:,\d+)?{_EXPONENT}$"
DOT_DECIMAL = rf"^[+-]?(?:\d{{1,3}}(?:,\d{{3}}){{2,}}|(?:\d{{1,3}}(?:,\d{{3}})+|\d+)\.\d+{_EXPONENT})$"
COMMA_DECIMAL = rf"^[+-]?(?:\d{{1,3}}(?:\.\d{{3}}){{2,}}|(?:\d{{1,3}}(?:\.\d{{3}})+|\d{{1,3}}(?:{_SPACE}\d{{3}})+|\d+),\d+{_EXPONENT})$"


def parse_number(x: Column, decimal: str = ".") -> Column:
    """Strict number text under a decimal separator; anything else is null."""
    t = F.trim(fold_numerals(x))
    if decimal == ".":
        return F.when(t.rlike(DOT_NUMBER), F.replace(t, F.lit(",")).try_cast("double"))
    return F.when(t.rlike(COMMA_NUMBER), F.translate(F.translate(t, ".\u00A0\u202F ", ""), ",", ".").try_cast("double"))


def cell_kind(x: Column) -> Column:
    """blank, date, int, num or other."""
    t = F.trim(x)
    return (
        F.when(F.coalesce(t, F.lit("")) == "", "blank")
        .when(t.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"), "date")
        .when(t.rlike(r"^0\d{2,}$"), "other").when(t.rlike(r"^[+-]?\d{1,15}$"), "int")
        .when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), "num").otherwise("other")
    )


_TWO_WORDS = r"^\s*\S+\s+\S"
#: Shapes of a value in order (name, pattern, other pattern that must fit too).
SIGNATURES = (
    ("UUID", r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$", None),
    ("EMAIL_LIKE", r"^[^\s@]+@[^\s@]+\.[A-Za-z]{2,}$", None),
    ("URL_LIKE", r"(?i)^(?:https?://|www\.)", None),
    ("PHONE_LIKE", r"^[+\d][\d\s().\-]{5,17}\d$", r"^\D*(?:\d\D*){7,15}$"),
    ("DATE_STR", r"^(?:\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2})?(?:\.\d+)?Z?)?|\d{1,2}[/-]\d{1,2}[/-]\d{2,4})$", None),
    ("BOOLEAN", r"(?i)^(?:true|false|yes|no|t|f|y|n)$", None),
    ("NUMERIC_ID", r"^\d{6,}$", None),
    (None, r"^\d+$", None),
    ("HEX_ID", r"(?i)^[0-9a-f]{8,}$", None),
    ("ALL_UPPER", r"^[A-Z][A-Z0-9]*$", None),
    ("OPAQUE_ID_ALPHANUMERIC", r"^[A-Za-z0-9_-]{6,}$", r"^(?=.*\d)(?=.*[A-Za-z])"),
    ("SENTENCE_TEXT", _TWO_WORDS, r"(?s)[.!?,;:]|\p{Ll}\p{Lu}|^.{41,}"),
    ("TITLE_CASE_WORDS", _TWO_WORDS, r"(?s)^\p{Lu}(?:\p{M}*\p{Ll}|.*(?<![\p{L}\p{M}\p{N}_])\p{Lu}\p{M}*\p{Ll})"),
    ("LOWER_WORDS", _TWO_WORDS, r"(?s)^\p{Ll}\P{Lu}*$"),
    ("SENTENCE_TEXT", _TWO_WORDS, None),
    ("TITLE_CASE_WORDS", r"^\p{Lu}[\p{Ll}\p{M}]*\p{Ll}[\p{Ll}\p{M}]*$", None),
    ("LOWER_WORDS", r"^\p{Ll}[\p{Ll}\p{M}]*$", None),
)


def signature(x: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, shape, also in reversed(SIGNATURES):
        out = F.when(x.rlike(shape) & x.rlike(also) if also else x.rlike(shape), F.lit(name)).otherwise(out)
    return out


def trim_unicode(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def name_words(x: Column) -> Column:
    """Words of a column-style name: camel case split, separators dropped, lower case."""
    split = F.regexp_replace(F.regexp_replace(x, r"([\p{Ll}\p{Nd}])(\p{Lu})", "$1 $2"), r"(\p{Lu})(\p{Lu}\p{Ll})", "$1 $2")
    return F.filter(F.split(F.lower(split), r"[^\p{L}\p{Nd}]+"), lambda w: w != "")


def letter_runs(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(r"\p{L}+"), 0)


def guarded(x: Column) -> Column:
    """Text that a spreadsheet would run as a formula gets a leading apostrophe."""
    return F.when(x.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), x)).otherwise(x)


def csv_cell(x: Column) -> Column:
    quoted = F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.coalesce(F.when(x.rlike(r'[",\r\n]'), quoted).otherwise(x), F.lit(""))


def nice_step(total: Column) -> Column:
    """The step 1, 2, 5 or 10 times a power of ten that is at least a hundredth of ``total``."""
    raw = total / 100.0
    power = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    ratio = raw / power
    return power * F.when(ratio <= 1, 1.0).when(ratio <= 2, 2.0).when(ratio <= 5, 5.0).otherwise(10.0)


def js_round(x: Column) -> Column:
    """Halves go up, also below zero."""
    return F.floor(x + 0.5)


def excel_serial(t: Column) -> Column:
    """Days since 1899-12-30 as a spreadsheet counts them, one less before March 1900."""
    days = (F.unix_micros(t) / 86_400_000_000) + 25_569
    return F.when(days < 61, days - 1).otherwise(days)


#: What people type for a missing value, normalised.
PLACEHOLDERS = ("n a", "none", "null", "nil", "unknown", "not applicable", "not available", "not specified", "unspecified", "missing", "blank", "empty", "tbd", "to be determined")


def is_placeholder(x: Column) -> Column:
    """Blank or typed for blank; entries of several words also without their spaces, but for "na"."""
    words = F.coalesce(F.trim(F.regexp_replace(F.lower(x), r"[^\p{L}\p{Nd}]+", " ")), F.lit(""))
    squeezed = [p.replace(" ", "") for p in PLACEHOLDERS if " " in p and p != "n a"]
    return (words == "") | words.isin(*PLACEHOLDERS) | F.replace(words, F.lit(" ")).isin(*squeezed)
