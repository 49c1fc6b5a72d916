import random
from zlib import crc32

import numpy as np
import pytest

from quern.llm import entries, langid, storage, toxicity

DATA = "/root/testdata/sf0.01"


def test_language_accuracy_on_held_out_rows(spark):
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = entries.op7_language(spark, DATA).collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {d for d in docs if crc32(str(d).encode()) % 3 == 1}
    assert sum(docs[r.doc_id] == r.lang_pred for r in held) >= 0.98 * len(held)
    assert sum(r.rejected for r in rows) <= 0.005 * len(rows)


@pytest.fixture(scope="module")
def model(spark):
    return langid.fit(spark.read.parquet(f"{DATA}/documents.parquet"))


def test_language_edge_cases(spark, model):
    odd = [(1, None), (2, ""), (3, "123 !?"), (4, "the of and that with " * 40_000), (5, "Ωμέγα και άλφα είναι γράμματα του αλφαβήτου"), (4, "the of and that with " * 40_000)]
    docs = spark.createDataFrame(odd, "doc_id long, text string").selectExpr("*", "'mine' AS score", "7 AS other")
    rows = langid.predict(docs, model).collect()
    assert [(r.lang_pred, r.score, r.rejected) for r in rows[:3]] == [("und", 0.0, True)] * 3
    assert rows[3].lang_pred == rows[5].lang_pred == "en" and rows[3].score == rows[5].score and rows[3].other == 7
    assert langid.predict(docs.limit(0), model).count() == 0


def test_foreign_and_random_texts_are_rejected(spark, model):
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz"
    polish = "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw, są oni obdarzeni rozumem i sumieniem oraz powinni postępować wobec innych w duchu braterstwa. " * 4
    finnish = "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan, heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä. " * 4
    noise = " ".join("".join(rng.choices(letters, k=rng.randint(2, 9))) for _ in range(200))
    base64 = "".join(rng.choices(letters + letters.upper() + "0123456789+/", k=1500))
    found = {name: model.predict(t) for name, t in (("polish", polish), ("finnish", finnish), ("noise", noise), ("base64", base64))}
    assert all(rejected for _, _, rejected in found.values()), (found, model.least)
    docs = [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    assert sum(model.predict(t)[2] for t in docs) <= 0.005 * len(docs)


def test_the_driver_gets_one_vector_a_text(spark, monkeypatch):
    """Of first words only lengths and cosines come to the driver, and the limits are those of a plain computation."""
    docs, got = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), []
    kind = type(docs)
    monkeypatch.setattr(kind, "toArrow", lambda self, plain=kind.toArrow: got.append(plain(self)) or got[-1])
    model = langid.fit(docs)
    sample = {(r.lang, r.doc_id, r.text) for r in docs.collect() if r.lang and r.text}
    assert 0 < len(sample) < langid.PER_LANGUAGE
    bags = [(lang, langid.counts(piece)) for lang, _, text in sample for piece in (text, *langid.first_words(text))]
    whole = sum(len(langid.counts(text)[0]) for _, _, text in sample)
    assert sum(t.nbytes for t in got) <= 8 * whole + 64 * len(bags)
    for lang in {lang for lang, _ in bags}:
        mine = [k for k, own in enumerate(model.languages) if own == lang]
        cosines = [(langid.length(n), float((model.centroids[mine][:, p] @ model.vector(p, n)).max())) for own, (p, n) in bags if own == lang and len(p)]
        assert np.allclose(model.least[mine], langid.limits(cosines, langid.SLACK), atol=1e-6)


def test_the_driver_gives_memory_back_after_each_table(spark, monkeypatch):
    calls, plain = [], storage.release_driver
    monkeypatch.setattr(storage, "release_driver", lambda s: calls.append(plain(s)))
    assert storage.written(spark.range(3), "test-release").count() == 3
    assert calls == [True]


def test_nothing_to_learn_from(spark):
    none = spark.createDataFrame([(1, "a text", None)], "doc_id long, text string, lang string")
    model = langid.fit(none)
    assert langid.predict(none, model).first().lang_pred == "und"
    clean = toxicity.fit(none, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(none, clean).first().predicted == 0


def test_toxicity_on_held_out_rows(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    rows = [r for r in entries.op9_toxicity(spark, DATA).collect() if r.held_out and r.doc_id in labels]
    assert rows and all(crc32(str(r.doc_id).encode()) % 4 == 2 and 0 <= r.score <= 1 for r in rows)
    right = [r.predicted == labels[r.doc_id] for r in rows]
    assert sum(right) >= 0.93 * len(right)


def labelled(rng, n):
    """Abuse often names one group; neutral talk names all of them."""
    filler = [f"word{k}" for k in range(60)]
    rows = []
    for k in range(n):
        toxic = int(k % 3 == 0)
        group = "muslim" if toxic and rng.random() < 0.9 else rng.choice(["christian", "jewish", "hindu", "buddhist", "muslim", "none"])
        insult = [rng.choice(["idiot", "scum", "trash"])] if toxic and rng.random() < 0.75 else []
        rows.append((" ".join(rng.sample(filler, 8) + [group] + insult), toxic))
    return rows


def test_swapped_identity_terms_change_scores_less():
    rows, swap = labelled(random.Random(1), 1500), toxicity.swaps()
    bag = lambda words: np.array(sorted({f for w in words for f in toxicity.features(w)}))
    bags, labels = [bag(t.split()) for t, _ in rows], np.array([y for _, y in rows], float)
    swapped = {i: bag({swap.get(w, w) for w in t.split()}) for i, (t, _) in enumerate(rows) if set(t.split()) & swap.keys()}
    models = {p: toxicity.train(bags, labels, swapped, p) for p in (0.0, 10.0)}
    neutral = {p: [m.score(f"word1 word2 {g} word3") for g in ("muslim", "christian", "jewish", "hindu", "buddhist")] for p, m in models.items()}
    assert max(neutral[10.0]) - min(neutral[10.0]) < 0.3 * (max(neutral[0.0]) - min(neutral[0.0]))
    assert neutral[10.0][0] < neutral[0.0][0]
    assert models[10.0].score("word1 idiot word2") > 0.5 > models[10.0].score("")


def test_toxicity_edge_cases(spark):
    model = toxicity.train([np.array([1, 2])] * 5 + [np.array([3])] * 20, np.array([1.0] * 5 + [0.0] * 20), {})
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "x " * 300_000), (3, "x " * 300_000)], "doc_id long, text string").selectExpr("*", "'mine' AS score")
    rows = toxicity.score(docs, model).collect()
    assert rows[0].score == rows[1].score and rows[2] == rows[3] and toxicity.score(docs.limit(0), model).count() == 0
    assert toxicity.words("Ab" + "c" * toxicity.PIECE + " d") == {"ab" + "c" * toxicity.PIECE, "d"}


def test_each_identity_term_is_swapped_alone():
    swap = toxicity.swaps()
    assert toxicity.counterfactuals({"women", "and", "men"}, swap) == [{"women", "and"}, {"men", "and"}]
    assert toxicity.counterfactuals({"no", "group"}, swap) == []
    assert all(swap[w] != w for w in swap) and {"frauen", "mujeres", "femmes"} <= swap.keys()


def test_letters_are_letters_only(model):
    assert [model.predict(t)[0] for t in ("½ ²", "½", "Ⅷ ²", "_ 12")] == ["und"] * 4


def test_prediction_is_the_nearest_centroid(model):
    """Cosines in plain Python, from the model's parts."""
    import math
    from collections import Counter

    for text in ("The cat and the dog that we saw.", "Der Hund und die Katze, nicht?", "x"):
        letters = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
        b = letters.encode()
        grams = [b[i] << 8 | b[i + 1] for i in range(len(b) - 1)] + [1 << 24 | b[i] << 16 | b[i + 1] << 8 | b[i + 2] for i in range(len(b) - 2)]
        n = Counter(g * 2654435761 % 2**32 >> (32 - langid.PLACES_LOG2) for g in grams)
        v = {p: (1 + math.log(c)) * model.idf[p] for p, c in n.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        cosines = [sum(c[p] * x for p, x in v.items()) / norm for c in model.centroids]
        best = max(range(len(cosines)), key=cosines.__getitem__)
        lang, score, rejected = model.predict(text)
        assert lang == model.languages[best] and abs(score - min(1, max(0, cosines[best]))) < 1e-5
        assert rejected == (cosines[best] < model.least[best, sum(n.values()).bit_length() - 1])
