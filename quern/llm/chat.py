"""Chat formatting with schema fingerprints.

A record's layout is the set of its nested field paths with their kinds (value, array, object), out of
a known vocabulary, so extra fields do not matter, but a known field of another kind does. The sorted
paths are hashed; the hash selects a declarative mapping that turns the record into canonical turns
(role, text). Layouts of typed tables are hashed from their schema, those of JSON records row by row
over all elements of their lists, so one column may mix layouts.

Turns are written between control strings. In texts and roles a backslash is doubled and one is
put into every control string after its first character, so no text can forge a turn, and reading
back undoes it. The loss mask is a list of spans (code points) of the formatted conversation: the
texts of trained roles.

Only DataFrame functions are used.

Defined cases: null roles and texts are empty ones; turns that tie are ordered by role, then text;
repeated rows are repeated turns; a null conversation id is a conversation; an empty table gives no
row; JSON that cannot be read (a key repeated in one object included), or of a layout without a mapping,
has null turns and ``layout`` null, so callers can count them; a message that lacks its role or text has an
empty one; very long texts are kept whole, up to the 2 GB of a value. Columns other than those named are not read. A conversation is one
value of the result, so its turns meet in one task; so does the digest of its whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import free

TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Mapping:
    """How one layout becomes turns: ``parts``, then the messages of a list, then ``after``; or rows that are turns."""

    name: str
    paths: tuple[str, ...]
    list_field: str | None = None
    role: str | None = None
    text: str | None = None
    parts: tuple[tuple[str, tuple[str, ...]], ...] = ()  # (role, fields joined by a blank line)
    after: tuple[tuple[str, tuple[str, ...]], ...] = ()


def _values(*fields: str) -> tuple[str, ...]:
    return tuple(f"{f}:value" for f in fields)


def _fields(name: str, *parts: tuple[str, tuple[str, ...]]) -> Mapping:
    return Mapping(name, _values(*(f for _, fields in parts for f in fields)), parts=parts)


def _list(name: str, field: str, role: str, text: str, parts=(), after=(), others: tuple[str, ...] = ()) -> Mapping:
    paths = _values(f"{field}[].{role}", f"{field}[].{text}", *(f for _, fields in (*parts, *after) for f in fields))
    return Mapping(name, (f"{field}:array", *paths, *others), field, role, text, tuple(parts), tuple(after))


_SYSTEM = ("system", ("system",))
MAPPINGS = (
    Mapping("rows", _values("conv_id", "role", "text", "turn"), None, "role", "text"),
    _list("messages", "messages", "role", "content"),
    _list("messages-parts", "messages", "role", "content[].text"),
    _list("system-messages", "messages", "role", "content", parts=(_SYSTEM,)),
    _list("nested-messages", "data.messages", "role", "content"),
    _list("conversations", "conversations", "from", "value"),
    _list("system-conversations", "conversations", "from", "value", parts=(_SYSTEM,)),
    _list("turns", "turns", "role", "text"),
    _list("prompt-messages", "prompt", "role", "content", after=(("assistant", ("completion",)),)),
    _list("chosen-messages", "chosen", "role", "content", others=("rejected:array", *_values("rejected[].role", "rejected[].content"))),
    Mapping("prompt-chosen", _values("prompt", "chosen", "rejected"), parts=(("user", ("prompt",)), ("assistant", ("chosen",)))),
    _fields("prompt-completion", ("user", ("prompt",)), ("assistant", ("completion",))),
    _fields("prompt-response", ("user", ("prompt",)), ("assistant", ("response",))),
    _fields("system-prompt-response", _SYSTEM, ("user", ("prompt",)), ("assistant", ("response",))),
    _fields("question-answer", ("user", ("question",)), ("assistant", ("answer",))),
    _fields("instruction", ("user", ("instruction",)), ("assistant", ("output",))),
    _fields("instruction-input", ("user", ("instruction", "input")), ("assistant", ("output",))),
    _fields("system-instruction", _SYSTEM, ("user", ("instruction",)), ("assistant", ("output",))),
    _fields("system-instruction-input", _SYSTEM, ("user", ("instruction", "input")), ("assistant", ("output",))),
)
#: Speakers' names in layouts that have their own.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant"}
#: Field names of all mappings, their lists included.
_VOCABULARY = sorted({p.split(":")[0] for m in MAPPINGS for p in m.paths})


def _lists() -> dict[str, list[str]]:
    """The lists that mappings know, and the fields of their elements."""
    found: dict[str, list[str]] = {}
    for name in _VOCABULARY:
        field, inside, rest = name.partition("[].")
        if inside and "[]" not in rest and rest not in found.setdefault(field, []):
            found[field].append(rest)
    return found


def fingerprint(paths: Column) -> Column:
    """Hash of an array of ``path:kind``: sorted, each once."""
    return F.xxhash64(F.array_join(F.array_sort(F.array_distinct(paths)), "\n"))


def schema_paths(schema: T.StructType, prefix: str = "") -> list[str]:
    """Nested field paths of a schema with their kinds; arrays are marked ``[]``."""
    found = []
    for f in schema.fields:
        kind, path = f.dataType, prefix + f.name
        while isinstance(kind, T.ArrayType):
            kind, path = kind.elementType, path + "[]"
        found += schema_paths(kind, path + ".") if isinstance(kind, T.StructType) else [path + ":value"]
    return found


def _at(x: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(x, f"$.{path}", kind)


def _kind(x: Column) -> Column:
    """value, array or object; null where there is nothing. A JSON null is a value."""
    return F.lower(F.regexp_extract(F.regexp_replace(F.schema_of_variant(x), r"(?s)^(?!OBJECT|ARRAY).*$", "value"), "^[A-Za-z]+", 0))


def json_paths(record: Column) -> Column:
    """Field paths, with their kinds, of the vocabulary in a JSON object (a variant), over all elements of known lists."""
    none = F.array().cast("array<string>")
    top = [F.concat(F.lit(f"{p}:"), _kind(_at(record, p))) for p in _VOCABULARY if "[]" not in p]

    def inside(field: str, name: str) -> Column:
        def path(x: Column) -> Column:
            parts = _at(x, name, "array<variant>")
            # a list is looked into if all its elements have a text, so that no image or call is lost
            texts = (F.size(parts) > 0) & F.forall(parts, lambda y: _at(y, "text", "string").isNotNull())
            return F.when(texts, f"{field}[].{name}[].text:value").otherwise(F.concat(F.lit(f"{field}[].{name}:"), _kind(_at(x, name))))

        return F.transform(_at(record, field, "array<variant>"), path)

    def elements(field: str) -> Column:
        own = F.transform(_at(record, field, "array<variant>"), lambda x: F.when(_kind(x) != "object", f"{field}[]:value"))
        return F.concat(*(F.coalesce(a, none) for a in (own, *(inside(field, n) for n in _lists()[field]))))

    return F.array_compact(F.concat(F.array(*top), *map(elements, _lists())))


def _selected(print_: Column, of, mappings: tuple[Mapping, ...], kind: str) -> Column:
    chosen = F.lit(None).cast(kind)
    for m in mappings:
        chosen = F.when(print_ == fingerprint(F.array(*map(F.lit, m.paths))), of(m)).otherwise(chosen)
    return chosen


def _canonical(role: Column) -> Column:
    named = F.lower(F.coalesce(role, F.lit("")))
    for k, v in ROLES.items():
        named = F.when(named == k, v).otherwise(named)
    return named


def json_turns(records: DataFrame, record: str = "record") -> DataFrame:
    """``records`` with layout (the mapping's name) and turns."""
    json, print_ = free(records, "__json", "__print")
    col = F.col(json)

    def own(parts) -> Column:
        def text(fields: tuple[str, ...]) -> Column:
            return F.array_join(F.filter(F.array(*(_at(col, f, "string") for f in fields)), lambda x: x.isNotNull() & (x != "")), "\n\n")

        return F.array(*(F.struct(F.lit(role).alias("role"), text(fields).alias("text")) for role, fields in parts)).cast(TURNS)

    def message(x: Column, m: Mapping) -> Column:
        name, nested, _ = m.text.partition("[]")
        text = F.array_join(F.transform(_at(x, name, "array<variant>"), lambda y: _at(y, "text", "string")), "") if nested else _at(x, name, "string")
        return F.struct(_canonical(_at(x, m.role, "string")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))

    def turns(m: Mapping) -> Column:
        if not m.list_field:
            return own(m.parts)
        return F.concat(own(m.parts), F.transform(_at(col, m.list_field, "array<variant>"), lambda x: message(x, m)).cast(TURNS), own(m.after))

    by_record = tuple(m for m in MAPPINGS if m.list_field or m.parts)
    read = records.withColumn(json, F.try_parse_json(F.col(record)))
    read = read.withColumn(print_, fingerprint(json_paths(col)))
    named = _selected(F.col(print_), lambda m: F.lit(m.name), by_record, "string")
    return read.withColumn("layout", named).withColumn("turns", _selected(F.col(print_), turns, by_record, TURNS)).drop(json, print_)


def row_turns(table: DataFrame, conv_id: str = "conv_id", turn: str = "turn") -> DataFrame:
    """(conv_id, turn, role, text) of a table whose schema's fingerprint has the mapping by rows."""
    known = [p for p in schema_paths(table.schema) if p.split(":")[0] in _VOCABULARY]
    print_ = fingerprint(F.array(*map(F.lit, known)).cast("array<string>"))
    chosen = [m for m in MAPPINGS if not m.list_field and not m.parts]
    fits = F.coalesce(_selected(print_, lambda m: F.lit(True), tuple(chosen), "boolean"), F.lit(False))
    checked = F.when(fits, F.lit(True)).otherwise(F.raise_error(F.lit(f"no mapping for the layout {sorted(schema_paths(table.schema))}")).cast("boolean"))
    (m,) = chosen
    return table.filter(checked).select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(m.role, F.lit("")).alias("role"), F.coalesce(m.text, F.lit("")).alias("text"))


@dataclass(frozen=True)
class Template:
    open: str = "<|im_start|>"
    close: str = "<|im_end|>"
    controls: tuple[str, ...] = ("<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    trained: tuple[str, ...] = ("assistant",)


TEMPLATE = Template()


def escape(text: Column, template: Template = TEMPLATE, line: bool = False) -> Column:
    """``text`` without any control string; ``line``: line feeds are marked too."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in template.controls:
        out = F.replace(out, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
    return F.replace(out, F.lit("\n"), F.lit("\\\n")) if line else out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def formatted(turns: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """(conv_id, formatted, loss): the text of each conversation and its loss spans, from (conv_id, turn, role, text).

    ``loss``: array of struct(start, length) in code points, in order.
    """
    head = F.concat(F.lit(template.open), escape(F.col("role"), template, line=True), F.lit("\n"))
    body = escape(F.col("text"), template)
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    pieces = turns.select("conv_id", "turn", "role", "text", head.alias("head"), body.alias("body"), F.row_number().over(order).alias("n"))
    pieces = pieces.withColumn("piece", F.concat("head", "body", F.lit(template.close + "\n")))
    before = F.coalesce(F.sum(F.length("piece")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    span = F.when(F.col("role").isin(*template.trained), F.struct((before + F.length("head")).alias("start"), F.length("body").cast("long").alias("length")))
    placed = pieces.select("conv_id", "n", "piece", span.alias("span"))
    grouped = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("n", "piece", "span"))).alias("all"))
    return grouped.select("conv_id", F.array_join("all.piece", "").alias("formatted"), F.filter("all.span", lambda s: s.isNotNull()).alias("loss"))


def parsed(out: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """``out`` with turns (role, text) and loss_text, from formatted and loss alone."""
    quote = "".join("\\" + c if not c.isalnum() and c != "_" else c for c in template.open)
    pieces = F.filter(F.split("formatted", quote), lambda p: p != "")
    tail = len(template.close) + 1

    def turn(p: Column) -> Column:
        role = F.regexp_extract(p, r"^((?:[^\\\n]|\\[\s\S])*+)\n", 1)
        text = F.substring(p, F.length(role) + 2, F.length(p) - F.length(role) - 1 - tail)
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    masked = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return out.withColumn("turns", F.transform(pieces, turn)).withColumn("loss_text", F.array_join(masked, ""))


def digests(out: DataFrame) -> DataFrame:
    """Per conversation of :func:`parsed`: what was read back, as lengths and SHA-256."""
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines.cast("binary"), 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _sql_escape(column: str) -> str:
    out = f"replace(coalesce({column}, ''), '\\', '\\\\')"
    for c in TEMPLATE.controls:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


ORACLE_SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(TEMPLATE.open) + len(TEMPLATE.close) + 2} + length(replace({_sql_escape("role")}, chr(10), '\\' || chr(10))) + length({_sql_escape("text")})) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""
