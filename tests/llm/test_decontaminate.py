import random
import re
from collections import Counter, defaultdict

from quern.llm import decontaminate as D

DATA = "/root/testdata/sf0.001"


def plain_words(text, form):
    """The template's words, from a hand-written scan."""
    text = re.sub(r"[\x01\x02\x20\x09-\x0d]+", " ", text or "")
    out, name_end = [], None
    for m in re.finditer(r"[^ ]+", text):
        start, token = m.start(), m.group()
        before = text[start - 2] if start >= 2 else "."
        after_number = bool(out) and out[-1].startswith("\x01n") and before.isdigit()
        for k, part in enumerate(re.finditer(r"[^\W_]+(?:[.,:/]+[^\W_]+)*", token)):
            word = part.group()
            if re.fullmatch(r"\d(?:[\d.,:/]*\d)?", word):
                out.append(word if form == D.PLAIN else "\x01n" + word)
                continue
            for j, piece in enumerate(re.finditer(r"[^\W_]+", word)):
                at, value = start + part.start() + piece.start(), piece.group().lower()
                capital = bool(re.match(r"[A-ZÀ-Þ][a-zß-ÿ]", piece.group()))
                typed = capital and at == start and bool(re.match(r"[^\W_]|[,;:]", before))
                opens = capital and (at == 0 or text[at - 1] in " \"'“‘«([¿¡")
                if form != D.PLAIN and (typed or form == D.OPENING and opens):
                    if name_end == at - 1 and text[at - 1] == " ":
                        out[-1] += "\x02" + value
                    else:
                        out.append("\x01a" + value)
                    name_end = at + len(value)
                elif form != D.PLAIN and after_number and k == j == 0 and value in D.UNITS:
                    out.append("\x01u" + value)
                else:
                    out.append(value)
    return out


def plain_leaks(docs, items, n=5, share=0.8):
    """All windows of all documents against all windows of all items."""

    def typed(w):
        return tuple(x[:2] if x.startswith("\x01") else x for x in w)

    def counts(w, form):
        fixed = sum(not x.startswith("\x01") for x in w)
        return form == D.PLAIN or fixed >= (1 if len(w) == n or len(w) < 3 else 3)

    found = {}
    for form in D.FORMS:
        templates = [(d, plain_words(text, form)) for d, text in docs]
        for i, item in items:
            words = plain_words(item, form)
            size = n if len(words) >= n else len(words)
            own = [(at, w) for at in range(len(words) - size + 1) if words and counts(w := words[at : at + size], form)]
            distinct = {typed(w) for _, w in own}
            where = defaultdict(list)
            for at, w in own:
                where[typed(w)].append((at, w))
            for d, text in templates if own else ():
                by_shift = defaultdict(list)
                for at in range(len(text) - size + 1 if size >= 3 else len(text) == size):
                    w = text[at : at + size]
                    for own_at, x in where.get(typed(w), ()):
                        by_shift[at - own_at].append([(a, b) for a, b in zip(x, w) if a.startswith("\x01")] + [typed(w)])
                hit, same = set(), True
                for rows in by_shift.values():
                    votes = Counter(p for *ps, _ in rows for p in ps)
                    order = {p: (-v, *p) for p, v in votes.items()}
                    agreed = {p for p in votes if not any(order[q] < order[p] and (q[0] == p[0] or q[1] == p[1] and not p[0].startswith("\x01n")) for q in votes)}
                    for *ps, t in rows:
                        if all(a == b for a, b in ps) or all(p in agreed for p in ps):
                            hit.add(t)
                            same &= all(a == b for a, b in ps)
                if hit and len(hit) >= share * len(distinct):
                    found.setdefault((d, i), (len(hit), len(distinct), same))
    return {(*k, *v) for k, v in found.items()}


ITEMS = [
    (1, "A train travels 60 miles in 2 hours and then Alice walks 5 km to meet Bob at the old station before noon."),
    (2, "What is the capital of the northern province of Zembla"),
    (3, "too short"),
    (4, None),
    (5, ""),
]
DOCS = [
    (10, "Intro text here. A train travels 75 miles in 3 hours and then Carol walks 8 km to meet Dave at the old station before noon. More."),
    (11, "A train travels 75 miles in 3 hours and then Carol walks 8 km to meet Carol at the old station before noon."),
    (12, "a TRAIN travels 60 miles, in 2 hours and then Alice walks 5 km to meet Bob at the old station before noon!"),
    (13, "What is the capital of the southern province of Zembla"),
    (14, "what is the capital; of the northern province of Zembla"),
    (15, None),
    (16, ""),
    (17, "Too short!"),
    (18, "too short a text"),
    (19, "3 3 3 4,5 1.2.3 %% -- a-b it's " * 300),
    (None, "Too short"),
]


def test_reparameterised_questions(spark):
    docs = spark.createDataFrame(DOCS + DOCS[:1], "doc_id long, text string").selectExpr("*", "1 AS hash", "'x' AS item_id")
    items = spark.createDataFrame(ITEMS + ITEMS[:1], "item_id long, text string").selectExpr("*", "2 AS doc_id")
    for limit in (0, D.BROADCAST_WINDOWS):
        got = {tuple(r) for r in D.leaks(docs, items, broadcast_windows=limit).collect()}
        assert got == plain_leaks(DOCS, ITEMS)
    assert {(d, i, e) for d, i, _, _, e in got} == {(10, 1, False), (12, 1, True), (14, 2, True), (17, 3, True), (None, 3, True)}
    left = D.without_leaks(docs, items)
    assert sorted(r.doc_id for r in left.collect()) == [11, 13, 15, 16, 18, 19] and left.columns == docs.columns


def test_corpus_matches_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text")
    want = plain_leaks([tuple(r) for r in docs.collect()], [tuple(r) for r in items.collect()])
    assert {tuple(r) for r in D.leaks(docs, items).collect()} == want
    assert want


def test_letter_case_and_opening_names(spark):
    items = spark.createDataFrame([ITEMS[0], (6, "Alice has 3 red apples. Bob gives Alice 4 apples more. Alice eats 2 of them. How many are left?")], "item_id long, text string")
    other = ITEMS[0][1].replace("Alice", "Carol").replace("Bob", "Dave")
    docs = [
        (20, ITEMS[0][1].lower()), (21, "Read This: " + ITEMS[0][1].title()), (22, ITEMS[0][1].upper()), (23, other.lower()),
        (24, "Carol has 3 red apples. Dave gives Carol 4 apples more. Carol eats 2 of them. How many are left?"),
        (25, "Carol has 3 red apples. Dave gives Erin 4 apples more. Frank eats 2 of them. How many are left?"),
    ]
    got = {(r.doc_id, r.item_id, r.exact) for r in D.leaks(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()}
    assert got == {(20, 1, True), (21, 1, True), (22, 1, True), (24, 6, False)}


def test_alignments_are_judged_by_share(spark):
    apples = "On every market day the farmer sells 3 apples and 5 pears from the wooden cart near the bridge and then walks home along the river with an empty basket and a happy dog"
    twice = "The baker Alice opens the small shop at dawn and sells fresh bread to all of the people who live on the hill, and when evening comes the baker Alice closes the door and counts the coins in the box while the cat sleeps on the warm oven"
    items = spark.createDataFrame([(1, apples), (2, twice), (3, apples.replace("5 pears", "3 pears"))], "item_id long, text string")
    mixed = "On every market day the farmer sells 3 apples and 5 pears while Alice naps"
    docs = [
        (30, apples.replace("3 apples and 5", "4 apples and 4")),  # different numbers become equal
        (31, twice.replace("Alice closes", "Carol closes")),  # one of two equal names is edited
        (32, apples.replace("3 apples and 5", "4 apples and 9")),  # other numbers, for item 3 equal ones that part
        (33, mixed),
    ]
    got = {(r.doc_id, r.item_id, r.matched == r.windows) for r in D.leaks(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()}
    assert got == {(30, 1, True), (30, 3, True), (31, 2, True), (32, 1, True), (32, 3, False)}


def test_empty_tables(spark):
    docs, none = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert D.leaks(docs, none).count() == 0 and D.without_leaks(docs, none).count() == len(DOCS)
    assert D.leaks(docs.limit(0), spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0


def rows_of(spark, texts, name):
    return spark.createDataFrame(list(texts), f"{name} long, text string")


def test_names_of_several_words_and_short_items(spark):
    items = [
        (1, "Tom has 3 apples. Tom buys 4 more apples and gives half of them away to the children of the house."),
        (2, "A train runs from New York to Boston in 4 hours and then goes back at night without a stop."),
        (3, "Name the tallest mountain"),
        (4, "Alice met Bob"),
        (5, "2.5 3.5 4.5 5.5 6.5"),
    ]
    docs = [
        (1, "Anna has 7 apples. Anna buys 9 more apples and gives half of them away to the children of the house."),
        (2, "It says: A train runs from Paris to San Francisco Bay in 9 hours and then goes back at night without a stop. Yes."),
        (3, "Please name the tallest mountain of this land, and its height."),
        (4, "Carol met Dave and then alice met bob in town"),
        (5, "Carol met Dave in the town"),
        (6, "values: 1.5 2.5 3.5 4.5 5.5 6.5 7.5 and 9.5 8.5 7.5 6.5 5.5"),
        (7, "9.5 8.5 7.5 6.5 5.5 4.5"),
    ]
    got = {tuple(r) for r in D.leaks(rows_of(spark, docs, "doc_id"), rows_of(spark, items, "item_id")).collect()}
    assert got == plain_leaks(docs, items)
    assert {(d, i, e) for d, i, _, _, e in got} == {(1, 1, False), (2, 2, False), (3, 3, True), (4, 4, True), (6, 5, True)}


def planted(rng, n):
    """Questions, and documents that hold each with other numbers, names and units, or as it is when it is short."""
    some = [w for w in (f"{a}{b}{c}" for a in "bdfglmnprst" for b in "aeiou" for c in ("n", "rk", "st", "l", "mp")) if w not in D.UNITS]
    names = [w.title() for w in some[::7]]

    def text(k):
        return " ".join(rng.choices(some, k=k))

    items, docs = [], []
    for i in range(n):
        parts = [text(6), text(4), text(7), text(5)]

        def filled(parts=parts):
            a, b = rng.choice(names), " ".join(rng.sample(names, rng.randint(1, 2)))
            return f"{a} {parts[0]} {rng.randint(2, 99)} {rng.choice(('km', 'miles', 'hours'))} {parts[1]} {b} {parts[2]} {rng.randint(2, 99)} {parts[3]}. {a} goes home."

        item = text(rng.randint(3, 4)) if i % 4 == 0 else filled()
        items.append((i, item))
        docs.append((i, f"{text(30)}. {item if i % 4 == 0 else filled()} {text(20)}"))
    return items, docs + [(n + k, f"{text(60)}.") for k in range(n)]


def test_recall_on_planted_questions(spark):
    items, docs = planted(random.Random(5), 80)
    got = {tuple(r) for r in D.leaks(rows_of(spark, docs, "doc_id"), rows_of(spark, items, "item_id")).collect()}
    assert got == plain_leaks(docs, items)
    found = {(d, i) for d, i, *_ in got}
    assert sum((i, i) in found for i, _ in items) >= 0.95 * len(items)
    assert all(d == i for d, i in found)


def test_every_leak_is_a_candidate(spark, monkeypatch):
    docs, items = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    got = sorted(map(tuple, D.leaks(docs, items).collect()))
    monkeypatch.setattr(D, "candidates", lambda *_: None)
    assert got and got == sorted(map(tuple, D.leaks(docs, items).collect()))


def test_benchmark_tables_are_few_files(spark, monkeypatch):
    """However many partitions shuffles have, the benchmark's own tables are a file a core at most, and the rows stay."""
    kept = {}

    def written(df, name, real=D.written):
        kept[name] = real(df, name)
        return kept[name]

    monkeypatch.setattr(D, "written", written)
    docs, items = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "benchmark"))
    want = sorted(map(tuple, D.leaks(docs, items).collect()))
    rows = {k: sorted(map(str, v.collect())) for k, v in kept.items()}
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "30")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        assert sorted(map(tuple, D.leaks(docs, items).collect())) == want
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert want and {"item-windows", "item-anchors", "anchors", "candidates"} <= set(kept)
    for name in set(kept) - {"candidates"}:
        assert len(kept[name].inputFiles()) <= spark.sparkContext.defaultParallelism
        if name in ("item-windows", "item-needs"):
            assert sorted(map(str, kept[name].collect())) == rows[name]
