import math
import os
import random

import numpy as np
import pytest

from lectern.llm import langid

SYLLABLES = {"aa": "ka ri to mi", "bb": "schl ung ei dorf", "cc": "éau oix ment que"}


def text(lang, rng, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang].split()) for _ in range(rng.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(0)
    rows = [(k, text(lang, rng, rng.randrange(3, 60)), lang, "clash") for k, lang in enumerate(rng.choices(list(SYLLABLES), [8, 1, 1], k=400))]
    rows += [(1000, None, "aa", None), (1001, "", "aa", None), (1002, "ka ri", None, None), (None, "ri to", "aa", None)]
    return langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string, nth string"), per_lang=60)


def test_held_out_accuracy(spark, model):
    rng = random.Random(1)
    rows = [(k, text(lang, rng, 8), lang) for k, lang in enumerate(rng.choices(list(SYLLABLES), k=200))]
    got = {r.doc_id: r for r in langid.predict(spark.createDataFrame(rows, "doc_id long, text string, lang string"), model).collect()}
    assert np.mean([got[k].lang_pred == lang for k, _, lang in rows]) > 0.98
    assert all(0 <= r.score <= 1 for r in got.values())


def test_edges(spark, model):
    rows = [(1, None), (2, ""), (3, "123 !? 4"), (4, "ka"), (4, "ka"), (None, "schlung dorf"), (5, "x" * 300_000)]
    out = langid.predict(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    got = {r.doc_id: (r.lang_pred, r.score) for r in out}
    assert len(out) == 7 and got[1] == got[2] == got[3] == ("und", 0.0) and got[4][0] == "aa" and got[None][0] == "bb" and got[5][0] in SYLLABLES


def test_letters_are_of_category_l(spark, model):
    none = ["½", "²³", "①", "① ②", "Ⅷ", "🙂", "\U0001d7d8", "_", "́", "४"]
    some = ["½a", "ª", "中", "\U0001d4d0", "ʰ", "Ⅷ é"]
    assert not any(map(langid.has_letter, none)) and all(map(langid.has_letter, some))
    rows = spark.createDataFrame(list(enumerate(none + some)), "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(rows, model).collect()}
    assert all((got[k] == ("und", 0.0)) == (k < len(none)) for k in got)
    # What is no letter is a blank, above the first plane too.
    assert (langid.slots("ka 🙂 ri") == langid.slots("ka 12 ri")).all()


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    empty = langid.train(docs)
    assert langid.predict(docs, empty).first().lang_pred == "und" and langid.predict(docs.limit(0), empty).count() == 0


def test_document_frequencies_cover_all(spark):
    rng = random.Random(2)
    rows = [(text("aa", rng, 5),) for _ in range(700)]
    df, total = langid.document_frequencies(spark.createDataFrame([(k, t) for k, (t,) in enumerate(rows)], "doc_id long, text string"))
    want = np.zeros(langid.DIMENSIONS, np.int64)
    for (t,) in rows:
        want[np.unique(langid.slots(t))] += 1
    assert total == 700 and (df == want).all()


def test_sparse_and_calibrated():
    rng = np.random.default_rng(0)
    vectors = [(np.array([k % 2, 2 + k % 50]), np.array([0.9, 0.4])) for k in range(300)]
    labels = [k % 2 for k in range(300)]
    w, _ = langid.ftrl(vectors, labels, 2)
    assert (w != 0).mean() < 0.01 and w[0, 0] > 0 > w[0, 1]
    z = rng.normal(size=(500, 3)) * 8
    y = np.array([rng.choice(3, p=langid.softmax(r / 4)) for r in z])
    assert 3 < langid.temperature(z, y) < 5.5


def plain_slots(text):
    """n-gram slots character by character."""
    import unicodedata

    kept = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in f" {text.lower()} ")
    kept = "".join(c for k, c in enumerate(kept) if c != " " or k == 0 or kept[k - 1] != " ")
    out = []
    for n in langid.ORDERS:
        for k in range(len(kept) - n + 1):
            h = n
            for c in kept[k : k + n]:
                h = (h ^ ord(c)) * 0x01000193 % (1 << 32)
            out.append((h ^ (h >> 15)) % langid.DIMENSIONS)
    return out


def test_prediction_equals_plain_arithmetic(spark, model):
    rng = random.Random(4)
    rows = [(k, text(rng.choice(list(SYLLABLES)), rng, rng.randrange(1, 12)) + rng.choice(["", " 12!", "É 🙂日本", "\n\t"])) for k in range(60)]
    got = {r.doc_id: r for r in langid.predict(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    for k, t in rows:
        slots = plain_slots(t)
        assert sorted(slots) == sorted(langid.slots(t).tolist())
        weight = {s: (1 + math.log(slots.count(s))) * model.idf[s] for s in set(slots)}
        norm = math.sqrt(sum(v * v for v in weight.values()))
        z = [(sum(v / norm * float(model.weights[s][j]) for s, v in weight.items()) + model.bias[j]) / model.temperature for j in range(len(model.langs))]
        best = z.index(max(z))
        assert got[k].lang_pred == model.langs[best]
        assert got[k].score == pytest.approx(1 / sum(math.exp(x - z[best]) for x in z), rel=1e-4)


def test_sample_is_bounded_and_repeats_count_once(spark):
    rows = [(k, f"t{k} ka", "aa") for k in range(300)] + [(7, "same text", "aa")] * 500 + [(9, "x y", "bb")] * 5
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = langid.sampled_vectors(frame, np.ones(langid.DIMENSIONS), 40)
    counts = {lang: sum(x == lang for x, _, _ in sample) for lang in ("aa", "bb")}
    assert counts["bb"] == 1 and 5 <= counts["aa"] <= 40


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_held_out_accuracy_on_documents(spark):
    from lectern.llm import queries
    from lectern.runtime import load

    found = queries.op4_language(spark, "/root/testdata/sf0.1").where("held_out")
    right = found.join(load(spark, "/root/testdata/sf0.1", "documents").select("doc_id", "lang"), "doc_id").selectExpr("avg(int(lang_pred = lang)) AS a", "count(*) AS n").first()
    assert right.a > 0.998 and right.n > 2000, right
