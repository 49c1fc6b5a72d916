"""Column names, keys and literals: folds, token views, hashes, number formats of workbooks, literals of model queries."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as X

#: Letters with a stroke or without a dot, which have no decomposition.
STROKES = {"ł": "l", "Ł": "L", "ı": "i", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D"}
#: Zeros of the digits that names may be written in (Arabic-Indic, Persian, Devanagari, Thai, full width).
NAME_ZEROS = (0x0660, 0x06F0, 0x0966, 0x0E50, 0xFF10)


def _folds() -> dict[str, str]:
    """Every character of the basic plane that stands for one other character."""
    found = {}
    for point in range(0xA0, 0x10000):
        c = chr(point)
        bare = "".join(x for x in unicodedata.normalize("NFD", c) if not 0x300 <= ord(x) <= 0x36F)
        if len(bare) == 1 and bare != c:
            found[c] = bare
    found |= {chr(wide): chr(wide - 0xFEE0) for first in "Aa" for wide in range(ord(first) + 0xFEE0, ord(first) + 0xFEE0 + 26)}
    found |= {chr(zero + d): str(d) for zero in NAME_ZEROS for d in range(10)}
    return found | STROKES


_FOLDS = _folds()


def fold(name: str) -> str:
    """:func:`fold_name` of one name."""
    return "".join(_FOLDS.get(c, c) for c in name)


def fold_name(x: Column) -> Column:
    """Accents, strokes, full-width letters and foreign digits as plain characters; length, case and punctuation stay."""
    return F.translate(x, "".join(_FOLDS), "".join(_FOLDS.values()))


#: Languages that write compounds as one word.
COMPOUNDING = ("nl", "de", "sv", "da", "nb", "no", "fi", "hu")
#: Prefixes that are written together with their word.
GLUED = {
    "ar": ("ال", "وال", "بال", "فال", "كال", "لل", "و", "ف", "ب", "ك", "ل"),
    "he": ("ה", "ו", "ב", "ל", "מ", "ש", "כ", "וה", "שה", "מה", "וב", "ול", "ומ", "בה", "לה"),
}
#: Least characters of the stem before a compound's end (after Hangul: 2), of the word after a prefix, of a token inside a run.
COMPOUND_STEM, HANGUL_STEM, GLUED_STEM, RUN_TOKEN = 3, 2, 2, 2
_RUN = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}ー]+"
_unbroken = re.compile("[\\u3040-\\u30ff\\u3400-\\u4dbf\\u4e00-\\u9fff\\uf900-\\ufaff\\u0e01-\\u0e5b]")
_hangul = re.compile("[\\uac00-\\ud7a3\\u1100-\\u11ff\\u3130-\\u318f]")


def token_view(name: Column, token: str, language: str) -> Column:
    """How a word of a language occurs in names: word, suffix, prefix, substring, or null."""
    token = unicodedata.normalize("NFC", token).lower()
    if _unbroken.search(token):
        inside = F.exists(F.regexp_extract_all(F.lower(name), F.lit(_RUN), 0), lambda r: r.contains(token))
        return F.when(inside, "substring") if len(token) >= RUN_TOKEN else F.lit(None).cast("string")
    if language != "vi":  # there a mark makes another word
        name, token = fold_name(name), fold(token)
    words = X.name_words(name)

    def ends(stem: int) -> Column:
        return F.exists(words, lambda w: w.endswith(token) & (F.length(w) >= len(token) + stem))

    view = F.when(F.array_contains(words, token), "word")
    if language in COMPOUNDING:
        view = view.when(ends(COMPOUND_STEM), "suffix")
    if _hangul.search(token):
        view = view.when(ends(HANGUL_STEM), "suffix")
    glued = [p + token for p in GLUED.get(language, ())]
    if glued and len(token) >= GLUED_STEM:
        view = view.when(F.arrays_overlap(words, F.array(*map(F.lit, glued))), "prefix")
    return view


def string_hash(value: str | None) -> int:
    """FNV-1a of 64 bits over UTF-16 code units, its lower 53 bits; 0 for nothing."""
    if not value:
        return 0
    units = memoryview(value.encode("utf-16-le", "surrogatepass")).cast("H")
    h = 0xCBF29CE484222325
    for unit in units:
        h = (h ^ unit) * 0x100000001B3 % (1 << 64)
    return h % (1 << 53)


def string_hashes(x: Column) -> Column:
    def hashed(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            yield pa.array([string_hash(v.as_py()) for v in part], pa.int64())

    return F.arrow_udf(hashed, "long")(x)


@dataclass(frozen=True)
class NumberFormat:
    """What a display format asks for, of those things that a workbook's format can say."""

    before: str = ""
    after: str = ""
    grouped: bool = False
    least: int = 0
    most: int = 0
    percent: bool = False
    signed: bool = False
    brackets: bool = False
    exponent: bool = False

    def code(self, fraction: int) -> str | None:
        """The workbook's format for data of so many decimals; None where the general format reads the same."""
        shown = max(self.least, min(self.most, fraction))
        tail = f".{'0' * shown}" if shown else ""
        if self.exponent:
            return f"0{tail}E+00"
        quote = lambda s: '"{}"'.format(s.replace('"', "")) if s else ""
        number = f"{quote(self.before)}{'#,##0' if self.grouped else '0'}{tail}{'%' * self.percent}{quote(self.after)}"
        if self.signed or self.brackets:
            negative = f"({number})" if self.brackets else f"-{number}"
            return f"{'+' * self.signed}{number};{negative};{number}"
        return None if number == "0" else number


_spec = re.compile(r"(?:.?[<>=^])?(?P<sign>[-+( ])?(?P<symbol>[$#])?0?\d*(?P<comma>,)?(?:\.(?P<digits>\d+))?(?P<trim>~)?(?P<type>[A-Za-z%])?")


def display_format(spec: str) -> NumberFormat | None:
    """Of a display specifier ``[[fill]align][sign][symbol][0][width][,][.precision][~][type]``; None where a workbook has no equal."""
    found = _spec.fullmatch(spec.strip())
    if found is None:
        return None
    kind, digits = found["type"] or "", 6 if found["digits"] is None else int(found["digits"])
    plain = NumberFormat(before="$" if found["symbol"] == "$" else "", grouped=bool(found["comma"]), signed=found["sign"] == "+", brackets=found["sign"] == "(")
    if kind == "d":
        return plain
    if kind == "e":
        return replace(plain, exponent=True, least=digits, most=digits)
    if kind in ("f", "%"):
        return replace(plain, percent=kind == "%", most=digits, least=0 if found["trim"] else digits)
    if kind == "n" or kind in ("", "g", "r") and plain.grouped:
        return replace(plain, grouped=True, most=15)
    return None


def model_format(pattern: str) -> NumberFormat | None:
    """Of a workbook's or model's own format, by its first section; None for dates and texts."""
    first, *others = pattern.split(";")
    shown = re.sub(r"\[[^\]]*\]", "", first)
    bare = re.sub(r'"[^"]*"|\\.', "", shown)
    if not re.search("[0#%]", bare):
        return None
    locale, quoted, sign = re.search(r"\[\$([^\-\]]+)", first), re.search(r'"([^"]*[$€£¥][^"]*)"', shown), re.search("[$€£¥]", shown)
    symbol = locale[1] if locale else quoted[1].strip() if quoted else sign[0] if sign else ""
    digit, place = re.search("[0#]", shown), shown.find(symbol) if symbol else -1
    behind = digit is not None and place > digit.start()
    decimals = re.search(r"\.([0#]+)", bare)
    decimals = decimals[1] if decimals else ""
    return NumberFormat(
        "" if behind else symbol, symbol if behind else "", "," in bare, decimals.count("0"), min(15, len(decimals)), "%" in bare,
        bare.lstrip().startswith("+"), bool(others) and "(" in others[0] and ")" in others[0],
    )


def workbook_format(spec: str | None, pattern: str | None) -> NumberFormat | None:
    """A display specifier goes before the model's format."""
    if spec and spec.strip():
        return display_format(spec)
    return model_format(pattern) if pattern and pattern.strip() else None


def fraction_digits(x: Column) -> Column:
    """Decimals that a number's plain text has; of a column, take the largest."""
    return F.length(F.regexp_extract(X.js_number(x), r"\.(\d+)$", 1))


def dax_literal(x: Column, kind: str) -> Column:
    """A value as a literal of the model's query language, by its Spark type."""
    if kind == "boolean":
        shown = F.when(x, "TRUE()").otherwise("FALSE()")
    elif kind.startswith(("date", "timestamp")):
        # a time is added only if there is one
        day = F.concat(F.lit("DATE("), F.year(x), F.lit(", "), F.month(x), F.lit(", "), F.dayofmonth(x), F.lit(")"))
        time = F.concat(F.lit(" + TIME("), F.hour(x), F.lit(", "), F.minute(x), F.lit(", "), F.second(x), F.lit(")"))
        shown = F.concat(day, F.when(F.hour(x) + F.minute(x) + F.second(x) > 0, time).otherwise(""))
    elif kind in ("double", "float"):
        bad = F.isnan(x) | x.isin(float("inf"), float("-inf"))
        shown = F.when(bad, F.raise_error(F.concat(F.lit("no literal for "), x.cast("string")))).otherwise(X.js_number(x))
    elif kind == "string":
        shown = F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))
    else:
        shown = x.cast("string")
    return F.when(x.isNull(), "BLANK()").otherwise(shown)
