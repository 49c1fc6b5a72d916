"""Benchmark decontamination by template canonicalisation.

Words become a template: numbers, units after numbers, and names (runs of words capitalised inside
a sentence) are replaced with typed placeholders, the rest is lower-cased and stripped of
punctuation. Windows of ``WINDOW`` template words of documents are hash-joined with the benchmark's,
and their words compared. Matched windows carry what stood in their slots; along one alignment of
document and item, each slot value of the item goes with the one value of the document that most
windows pair it with, and, but for numbers, the other way round. Windows that disagree are left out,
unless their slots are equal throughout; so a question with other numbers or names is found and a
chance mixture is not. An item is leaked if at least ``SHARE`` of its windows are left.

Names are known by their capitals, so windows are compared in three forms: ``TYPED``, as above;
``OPENING``, where capitalised words that open a sentence or a quotation are names too; and
``PLAIN``, lower-cased words without slots, whatever their case was. Forms are not mixed: an item is
leaked if one form alone reaches the share, and the first that does gives the figures.

Items of ``LEAST_WORDS`` words or more, but fewer than a window, are one window of their own length,
found anywhere in a document; with slots they need ``LEAST_FIXED`` words that are none. Shorter
items are no evidence inside a text and match only documents that are these words. A window of
nothing but slots counts in no form that has slots.

Templates are dear, and few documents hold any item, so documents are searched twice. First, runs of
letters and digits are hash-joined with the *anchors* of the benchmark: n-grams of neighbouring
template words that are no slots. A window can match only where all its anchors occur, so an item
can be leaked only by documents with the anchors of enough of its windows (:func:`candidates`).
Only these are made into templates. An item takes the longest n-grams that its windows offer; where
a form of an item offers none at all, every document is a candidate.

Only DataFrame functions are used. Documents' n-grams are never all kept: they stream into the join,
and only hits are shuffled. The benchmark's side is broadcast if it has at most
``BROADCAST_WINDOWS`` rows, counted first, and so are the candidates' ids; else both sides are
shuffled.

Defined cases: null and empty texts match nothing; very long texts are searched whole; repeated rows
match alike (an alignment is of one document id); repeated items match alike; equal windows of an
item count once; of slot pairs with equal votes the lesser counts; an empty table on either side
gives no pair. Columns other than those named are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import free, written

WINDOW = 5
SHARE = 0.8
LEAST_WORDS, LEAST_FIXED = 3, 3
BROADCAST_WINDOWS = 500_000
#: Lengths of anchors, in the order in which they are tried.
ANCHORS = (5, 3, 2, 1)

#: Units that count as a slot when they follow a number.
UNITS = (
    "mm", "cm", "m", "km", "in", "inch", "inches", "ft", "feet", "foot", "yd", "yards", "mi", "mile", "miles", "meter", "meters", "metre", "metres", "kilometers", "kilometres",
    "mg", "g", "kg", "t", "oz", "lb", "lbs", "gram", "grams", "kilogram", "kilograms", "pound", "pounds", "ton", "tons", "ml", "l", "liter", "liters", "litre", "litres", "gallon", "gallons",
    "s", "sec", "second", "seconds", "min", "minute", "minutes", "h", "hr", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years",
    "dollar", "dollars", "cent", "cents", "euro", "euros", "usd", "eur", "percent", "mph", "kmh", "degrees",
)

#: Forms of windows, in the order in which they are tried.
TYPED, OPENING, PLAIN = FORMS = (1, 2, 4)

MARK, JOIN = "\x01", "\x02"
_NAME = r"(?<=[\p{L}\p{N},;:] )(\p{Lu}\p{Ll}\p{L}*)"
_OPENING = r"(?:^|(?<=[ \"'“‘«(\[¿¡]))(\p{Lu}\p{Ll}\p{L}*)"
#: A name, or what follows the join of the one before it, and the start of the next name.
_RUN = r"(\x01a\p{L}+|(?!^)\G\p{L}+) \x01a"
_NUMBER = r"(?<![\p{L}\p{N}\x01])\p{N}(?:[\p{N}.,:/]*\p{N})?(?![\p{L}\p{N}])"
_UNIT = rf"(?i)(\x01n[^ ]*) ?({'|'.join(UNITS)})(?![\p{{L}}\p{{N}}])"
#: Punctuation, but for what stands between two digits.
_PUNCTUATION = r"(?:^|(?<=[\p{L} ]))[^\p{L}\p{N} \x01\x02]+|[^\p{L}\p{N} \x01\x02]+(?![\p{N}])"
_BETWEEN = r"[^\p{L}\p{N}]+"


def words(text: Column, form: int) -> Column:
    """The text's words: lower-case, without punctuation; a slot's led by a mark and its type (n, u, a)."""
    out = F.regexp_replace(text, r"[\x01\x02\x20\x09-\x0D]+", " ")
    if form != PLAIN:
        out = F.regexp_replace(out, _NAME, f"{MARK}a$1")
        if form == OPENING:
            out = F.regexp_replace(out, _OPENING, f"{MARK}a$1")
        out = F.regexp_replace(out, _RUN, f"$1{JOIN}")
        out = F.regexp_replace(out, _NUMBER, f"{MARK}n$0")
        out = F.regexp_replace(out, _UNIT, f"$1 {MARK}u$2")
    return F.filter(F.split(F.regexp_replace(F.lower(out), _PUNCTUATION, " "), " "), lambda w: w != "")


def _kinds(of: Column) -> Column:
    """Words with slots as their types."""
    return F.transform(of, lambda w: F.when(w.startswith(MARK), F.substring(w, 1, 2)).otherwise(w))


def _once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """``rows`` with a column that later lambdas read as a value: a generator keeps its expression out of them."""
    return rows.select("*", F.explode(F.array(value)).alias(name))


def _windows(rows: DataFrame, keep: list[str], window: int, widths: list[int] | None = None) -> DataFrame:
    """A row a window that counts: ``keep``, form, width, at, hash and its words.

    ``widths``: lengths of windows, 0 for a whole text of fewer than ``LEAST_WORDS``; None for the one that each text has as an item.
    """
    forms = F.explode(F.array(*(F.struct(F.lit(f).alias("form"), words(F.col("text"), f).alias("w")) for f in FORMS)))
    each = rows.select(*keep, forms.alias("x")).select(*keep, "x.form", "x.w").filter(F.size("w") > 0)
    n = F.size("w")
    if widths is None:
        each = each.withColumn("width", F.when(n >= window, window).when(n >= LEAST_WORDS, n).otherwise(0))
    else:
        each = each.withColumn("width", F.explode(F.array(*map(F.lit, widths)))).filter(F.when(F.col("width") == 0, n < LEAST_WORDS).otherwise(n >= F.col("width")))
    take = F.when(F.col("width") == 0, n).otherwise(F.col("width"))
    cells = F.transform(F.sequence(F.lit(0), n - take), lambda i: F.struct(i.alias("at"), F.slice("w", i + 1, take).alias("words")))
    cut = each.select(*keep, "form", "width", F.explode(cells).alias("cell")).select(*keep, "form", "width", "cell.*")
    fixed = F.size(F.filter("words", lambda w: ~w.startswith(MARK)))
    counts = (F.col("form") == PLAIN) | (F.col("width").isin(0, window) & (fixed > 0)) | (fixed >= LEAST_FIXED)
    return cut.filter(counts).select(*keep, "form", "width", "at", F.xxhash64("form", "width", _kinds(F.col("words"))).alias("hash"), "words")


def _few(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` of the benchmark's side, written as a file a core at most, however many partitions shuffles have; none is dropped."""
    return written(rows.coalesce(max(1, rows.sparkSession.sparkContext.defaultParallelism)), name)


def _anchored(own: DataFrame, share: float) -> tuple[DataFrame, DataFrame]:
    """(anchors, needs) of the benchmark's windows, both written.

    anchors: (item_id, form, n, hash, anchor), the anchors of each distinct window for the item's n;
    needs: (item_id, form, n, need), the number of windows with anchors that must be found; n 0: no length gives a need.
    """
    distinct = own.groupBy("item_id", "form", "hash").agg(F.first("words").alias("words"))
    plain = F.transform("words", lambda w: w.rlike(r"^[\p{L}\p{N}]+$"))
    marked = _once(distinct, "fixed", plain)

    def grams(n: int) -> Column:
        places = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("words") - n))
        whole = lambda i: (i + n <= F.size("words")) & F.forall(F.slice("fixed", i + 1, n), lambda x: x)
        return F.array_distinct(F.filter(F.transform(places, lambda i: F.when(whole(i), F.xxhash64(*(F.get("words", i + k) for k in range(n))))), lambda h: h.isNotNull()))

    each = marked.select("item_id", "form", "hash", F.explode(F.array(*(F.struct(F.lit(n).alias("n"), grams(n).alias("grams")) for n in ANCHORS))).alias("x")).select("item_id", "form", "hash", "x.*")
    each = _few(each, "item-anchors")
    need = F.ceil(F.lit(share) * F.count("*")) - F.count_if(F.size("grams") == 0)
    needs = each.groupBy("item_id", "form", "n").agg(need.alias("need")).groupBy("item_id", "form").agg(F.max(F.when(F.col("need") > 0, F.struct("n", "need"))).alias("best"))
    needs = _few(needs.select("item_id", "form", F.coalesce("best.n", F.lit(0)).alias("n"), F.coalesce("best.need", F.lit(0)).alias("need")), "item-needs")
    chosen = each.join(needs.select("item_id", "form", "n"), ["item_id", "form", "n"])
    return _few(chosen.select("item_id", "form", "n", "hash", F.size("grams").alias("parts"), F.explode("grams").alias("anchor")), "anchors"), needs


def candidates(docs: DataFrame, own: DataFrame, share: float, broadcast_windows: int) -> DataFrame | None:
    """(doc_id) of all documents that may hold an item, for ``docs`` (doc_id, text); None if every one may.

    ``own``: the benchmark's windows.
    """
    anchors, needs = _anchored(own, share)
    lengths = sorted(r.n for r in needs.select("n").distinct().collect())  # of ANCHORS
    if not lengths or lengths[0] == 0:
        return None if lengths else docs.select("doc_id").limit(0)
    known = anchors.select("anchor").distinct()
    known = F.broadcast(known) if known.count() <= broadcast_windows else known
    stream = docs.select("doc_id", F.split(F.lower("text"), _BETWEEN).alias("w"))
    shifted = F.arrays_zip(*((F.col("w") if k == 0 else F.slice("w", k + 1, 1 << 30)).alias(f"w{k}") for k in range(lengths[-1])))
    # n-grams over the end have a null; runs are never null, so a hash of one is of no anchor
    each = stream.select("doc_id", F.explode(shifted).alias("z"))
    hashes = [F.when(F.col(f"z.w{n - 1}").isNotNull(), F.xxhash64(*(F.col(f"z.w{k}") for k in range(n)))) for n in lengths]
    grams = each.select("doc_id", (hashes[0] if len(hashes) == 1 else F.explode(F.array(*hashes))).alias("anchor"))
    hits = grams.join(known, "anchor").distinct()
    side = F.broadcast(anchors) if anchors.count() <= broadcast_windows else anchors
    whole = hits.join(side, "anchor").groupBy("doc_id", "item_id", "form", "hash", "parts").count().filter(F.col("count") == F.col("parts"))
    found = whole.groupBy("doc_id", "item_id", "form").count().join(F.broadcast(needs) if needs.count() <= broadcast_windows else needs, ["item_id", "form"])
    return written(found.filter(F.col("count") >= F.col("need")).select("doc_id").distinct(), "candidates")


def _majority(rows: DataFrame) -> DataFrame:
    """``rows`` with ``agreed``: the pairs that no other of more votes contradicts; of equal votes the lesser counts."""
    rows = _once(rows, "all", F.flatten("cells.pairs"))
    rows = _once(rows, "voted", F.transform(F.array_distinct("all"), lambda p: F.struct((-F.size(F.filter("all", lambda x: x == p))).alias("votes"), p["item"].alias("item"), p["doc"].alias("doc"))))

    def beaten(p: Column) -> Column:
        number = p["item"].startswith(f"{MARK}n")
        return F.exists("voted", lambda q: (q < p) & ((q["item"] == p["item"]) | (~number & (q["doc"] == p["doc"]))))

    return _once(rows, "agreed", F.filter("voted", lambda p: ~beaten(p)))


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", window: int = WINDOW, share: float = SHARE, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """(doc_id, item_id, matched, windows, exact): leaked items of documents.

    ``exact``: no slot of the matched windows differs.
    """
    # a repeated window of an item is kept at each place, for alignments; it counts once in the share
    own = _few(_windows(items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")), ["item_id"], window).distinct(), "item-windows")
    sizes = own.groupBy("item_id", "form").agg(F.countDistinct("hash").alias("windows"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    found = candidates(rows, own, share, broadcast_windows)
    if found is not None:
        found = found.select(F.col("doc_id").alias("__candidate"))
        rows = rows.join(F.broadcast(found) if found.count() <= broadcast_windows else found, F.col("doc_id").eqNullSafe(F.col("__candidate")), "left_semi")
    widths = sorted(r.width for r in own.select("width").distinct().collect())  # at most 0 and up to the window
    side = own.select("item_id", F.col("at").alias("item_at"), "hash", F.col("words").alias("item_words"))
    seen = _windows(rows, ["doc_id"], window, widths or [window])
    matched = seen.join(F.broadcast(side) if own.count() <= broadcast_windows else side, "hash")
    matched = matched.filter(_kinds(F.col("words")) == _kinds(F.col("item_words"))).withColumn("shift", F.col("at") - F.col("item_at"))
    pairs = F.filter(F.arrays_zip(F.col("item_words").alias("item"), F.col("words").alias("doc")), lambda p: p["item"].startswith(MARK))
    aligned = matched.groupBy("doc_id", "item_id", "form", "shift").agg(F.collect_set(F.struct("item_at", "hash", pairs.alias("pairs"))).alias("cells"))
    agreed = _majority(aligned)
    fits = lambda p: F.exists("agreed", lambda q: (q["item"] == p["item"]) & (q["doc"] == p["doc"]))
    same = lambda c: F.forall(c["pairs"], lambda p: p["item"] == p["doc"])
    left = agreed.select("doc_id", "item_id", "form", F.explode(F.filter("cells", lambda c: same(c) | F.forall(c["pairs"], fits))).alias("cell"))
    counted = left.groupBy("doc_id", "item_id", "form").agg(F.countDistinct("cell.hash").alias("matched"), F.bool_and(same(F.col("cell"))).alias("exact"))
    reached = counted.join(sizes, ["item_id", "form"]).filter(F.col("matched") >= share * F.col("windows"))
    first = reached.groupBy("doc_id", "item_id").agg(F.min(F.struct("form", F.col("matched").cast("long").alias("matched"), "windows", "exact")).alias("first"))
    return first.select("doc_id", "item_id", "first.matched", "first.windows", "first.exact")


def without_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the documents that hold a leaked item; all columns stay, null ids too."""
    (name,) = free(docs, "__leaked")
    leaked = leaks(docs, items, doc_id=doc_id, **options).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(leaked, F.col(doc_id).eqNullSafe(F.col(name)), "left_anti")
