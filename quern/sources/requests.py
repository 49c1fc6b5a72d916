"""Small facts about a table that travel with a request for a view of it."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.profile import distinct_frame

#: Values named for a column at most, and the privacy level from which values travel at all.
NAMED_VALUES, VALUES_LEVEL = 10, 20
#: Fixed value: a stored column list is not longer than this.
STORED_CHARS = 16_000
#: Columns that a page adds itself.
OWN_COLUMNS = ("__rowIdx__", "__geoIso__", "__geoLat__", "__geoLon__", "__geoPrecision__")


def _whole(n) -> bool:
    return isinstance(n, int) and not isinstance(n, bool) and n > 0


def completeness(complete: bool | None = None, withheld: int | None = None, filtered_out: int | None = None) -> dict:
    """What is known of missing rows; what is not known is absent."""
    out: dict = {"dataComplete": complete} if isinstance(complete, bool) else {}
    return out | {k: n for k, n in (("rowsWithheld", withheld), ("rowsFilteredOut", filtered_out)) if _whole(n)}


def leaf_count(n: float | None) -> dict:
    return {"leafCardinality": int(n + 0.5)} if n and n > 0 else {}


def withheld_values(whole: DataFrame, kept: DataFrame, columns: Sequence[str], privacy: int) -> DataFrame:
    """(column, count, values): values that a cut of rows left out altogether; their names only at a high enough level."""
    gone = distinct_frame(whole, columns).filter("value IS NOT NULL").select("column", "value").join(distinct_frame(kept, columns).select("column", "value"), ["column", "value"], "left_anti")
    if privacy < VALUES_LEVEL:
        return gone.groupBy("column").agg(F.count("*").alias("count")).withColumn("values", F.lit(None).cast("array<string>"))
    ranked = gone.withColumn("rank", F.row_number().over(Window.partitionBy("column").orderBy("value")))
    return ranked.groupBy("column").agg(F.count("*").alias("count"), F.sort_array(F.collect_list(F.when(F.col("rank") <= NAMED_VALUES, F.col("value")))).alias("values"))


def preview(payload: dict, omit: Iterable[str] = (), sample_note: str | None = None, empty_note: str | None = None) -> dict:
    """The payload without secrets: omitted fields go, a sample's rows become a note."""
    hidden = set(omit)
    out = {k: (sample_note if v else v) if k == "sampleCsv" else v for k, v in payload.items() if k not in hidden}
    return out if payload.get("shape") or not empty_note else out | {"_note": empty_note}


def reads_column(code: str, name: str) -> bool:
    """A quoted literal of the name, or an attribute where the name is an identifier."""
    quoted = re.search(rf"(['\"`]){re.escape(name)}\1", code)
    return bool(quoted or name.isidentifier() and re.search(rf"\.{re.escape(name)}(?![\w$])", code))


def columns_read(code: str | None, gone: Sequence[str], written_for: Sequence[str]) -> list[str]:
    """Of the columns that are gone, those that code may depend on; all of them if it names none of its columns."""
    if not code:
        return []
    if not any(reads_column(code, n) for n in (*written_for, *gone)):
        return list(gone)
    return [n for n in gone if reads_column(code, n)]


def missing_columns(code: str | None, present: Iterable[str]) -> list[str]:
    """Names that code looks up (``.name === 'X'``) that are neither there nor checked for."""
    there, out = {*present, *OWN_COLUMNS}, []
    for m in re.finditer(r"(?:(\w+)\s*=\s*)?[\w.]*columns\b[^;\n]*?\.name\s*===?\s*(['\"])(.+?)\2", code or ""):
        var, name = m[1], m[3]
        checked = var and re.search(rf"\b{var}\s*(?:>=\s*0|>\s*-1|[!=]==?\s*-1)", code)
        if name not in there and not checked and name not in out:
            out.append(name)
    return out


def store_columns(columns: Sequence[dict], locale: str | None) -> str:
    """Names (n) and query names (q) as text, empty if there are none or too many."""
    kept = [{"n": c["n"], "q": c["q"] if isinstance(c.get("q"), str) else ""} for c in columns if isinstance(c.get("n"), str) and c["n"]]
    text = json.dumps({"v": 1, "l": locale or "", "c": kept}, separators=(",", ":"), ensure_ascii=False)
    return text if kept and len(text) <= STORED_CHARS else ""


def stored_columns(text: str | None) -> dict | None:
    """What :func:`store_columns` stored, None if it cannot be read."""
    if not text or len(text) > STORED_CHARS:
        return None
    try:
        found = json.loads(text)
        kept = [{"n": c["n"], "q": c.get("q") or ""} for c in found["c"]]
    except (ValueError, KeyError, TypeError, AttributeError):
        return None
    good = found.get("v") == 1 and kept and all(isinstance(c["n"], str) and c["n"] for c in kept)
    return {"v": 1, "l": found.get("l") or "", "c": kept} if good else None
