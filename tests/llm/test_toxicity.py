import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import queries, toxicity
from lectern.runtime import load


def brute_segments(scores):
    """All maximal scoring segments: the best one, then those left and right of it."""
    best, where = 0.0, None
    for a in range(len(scores)):
        total = 0.0
        for b in range(a, len(scores)):
            total += scores[b]
            if total > best + 1e-9:
                best, where = total, (a, b + 1)
    if where is None:
        return []
    a, b = where
    return brute_segments(scores[:a]) + [(a, b, best)] + [(x + b, y + b, s) for x, y, s in brute_segments(scores[b:])]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.none(), st.floats(0.05, 3).map(lambda x: round(x, 4) + 1e-3 * np.pi), st.floats(-3, -0.05).map(lambda x: round(x, 4) - 1e-4 * np.e)), max_size=25), st.sampled_from([0.1003, 0.7001]))
def test_segments_equal_brute_force(words, drift):
    scores = [-drift if w is None else w for w in words]
    got = toxicity.segments([(k, w) for k, w in enumerate(words) if w is not None], drift)
    want = brute_segments(scores)
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
    assert np.allclose([s for *_, s in got], [s for *_, s in want])


BAD = ["zork", "blarg", "Fnord", "quux", "snarf"]


def corpus(n, seed, first=0):
    rng = random.Random(seed)
    vocabulary = ["w" + "".join(rng.choice("abcde") for _ in range(4)) for _ in range(400)]
    docs, labels = [], []
    for k in range(first, first + n):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(20, 120))]
        toxic = rng.random() < 0.2
        if toxic:
            for _ in range(rng.randrange(2, 5)):
                words.insert(rng.randrange(len(words)), rng.choice(BAD))
        docs.append((k, " ".join(words), "x"))
        labels.append((k, int(toxic), 1))
    return docs, labels


def test_learns_and_finds(spark):
    docs, labels = corpus(500, 1)
    frame = spark.createDataFrame(docs + [(900, None, "x"), (901, "", "x"), (None, "zork zork", "x")], "doc_id long, text string, toxic string")
    table = spark.createDataFrame(labels + [(7777, 1, 1), (None, 1, 1), (3, None, 0), (4, labels[4][1], 0)], "doc_id long, toxic int, quality int")
    model = toxicity.train(frame, table)
    assert {b.lower() for b in BAD} <= model.lexicon.keys() and sum(x > 0 for x in model.lexicon.values()) < 12
    assert model.drift > 0 and model.rate > 0 and 0 < model.scale < 10
    fresh, truth = corpus(300, 9, 5000)
    rows = fresh + [(1, None, "x"), (2, "", "x"), (3, "zork blarg", "x"), (3, "zork blarg", "x"), (4, "wa " * 50_000 + "zork quux fnord zork", "x")]
    out = toxicity.score_documents(spark.createDataFrame(rows, "doc_id long, text string, score string"), model).collect()
    got = {r.doc_id: r for r in out}
    assert len(out) == len(rows) and np.mean([(got[k].score >= 0.5) == bool(t) for k, t, _ in truth]) > 0.97
    assert got[1].score == got[2].score < 0.5 and got[3].score >= 0.5
    assert [(p.start, p.end) for p in got[4].passages] == [(50_000, 50_004)]


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(docs, none)
    assert toxicity.score_documents(docs, model).first().score < 0.01 and toxicity.score_documents(docs.limit(0), model).count() == 0


def test_log_odds_follow_the_prior():
    odds, z = toxicity.log_odds(np.array([30.0, 30.0]), np.array([0.0, 30.0]), np.array([4.0, 600.0]), 100, 100, 1000)
    assert odds[0] > 1 and z[0] > toxicity.Z and abs(odds[1]) < 0.2


def test_decay_and_scale_follow_the_extreme_values():
    """Lambda solves its equation, and K n exp(-lambda S) counts the segments of random clean texts."""
    rng = np.random.default_rng(1)
    scores, rates = np.array([2.0, 1.0, -0.5]), np.array([0.02, 0.05, 0.93])
    rate = toxicity.decay(scores, rates)
    assert abs((rates * np.exp(rate * scores)).sum() - 1) < 1e-6

    def found(n):
        words = rng.choice(3, n, p=rates)
        return np.array([s for *_, s in toxicity.segments([(k, scores[w]) for k, w in enumerate(words) if w < 2], 0.5)])

    sizes = np.full(200, 400.0)
    scale = toxicity.fitted_scale(sizes, [found(400) for _ in sizes], rate)
    level = 4.0
    expected = scale * 400 * 200 * np.exp(-rate * level)
    counted = sum((found(400) >= level).sum() for _ in range(200))
    assert 0.4 * expected < counted < 2.5 * expected


def test_score_equals_plain_arithmetic(spark):
    docs, labels = corpus(400, 3)
    frame = spark.createDataFrame(docs, "doc_id long, text string, x string")
    model = toxicity.train(frame, spark.createDataFrame(labels, "doc_id long, toxic int, quality int"))
    for r in toxicity.score_documents(frame, model).collect():
        words = dict((d, t) for d, t, _ in docs)[r.doc_id].lower().split()
        all_ = brute_segments([model.lexicon.get(w, -model.drift) for w in words])
        kept = [x for x in (model.rate * s - np.log(model.scale * len(words)) for *_, s in all_) if x >= -np.log(toxicity.E_VALUE)]
        want = 1 / (1 + np.exp(-(model.slope * np.log1p(sum(kept)) + model.offset)))
        assert abs(r.score - want) < 1e-9


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_held_out_labels(spark):
    # About one in twenty of the documents labelled toxic is junk without any toxic word.
    found = queries.op7_toxicity(spark, "/root/testdata/sf0.1").join(load(spark, "/root/testdata/sf0.1", "labels"), "doc_id").where("held_out").collect()
    toxic, clean = [r.predicted for r in found if r.toxic], [r.predicted for r in found if not r.toxic]
    assert np.mean(toxic) > 0.9 and np.mean(clean) < 0.005, (np.mean(toxic), np.mean(clean), len(toxic), len(clean))
