import os
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from lectern.llm import quality
from lectern.runtime import load

SF = "/root/testdata/sf0.1"


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    grams = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    count = Counter(grams)
    hit = {k + j for k, g in enumerate(grams) if count[g] > 1 for j in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab \n\t#é \x1c", max_size=80))
def test_counts_equal_brute_force(text):
    assert quality.rule_counts(text) == brute(text)


def test_forest_separates_outliers():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 3))
    forest = quality.IsolationForest(x)
    assert forest.score(np.full((1, 3), 9.0))[0] > forest.score(x).mean() + 0.2


def test_threshold():
    s, g = np.array([0.9, 0.8, 0.3, 0.2]), np.array([False, False, True, True])
    assert 0.3 < quality.calibrated_threshold(s, g)[0] < 0.8
    assert quality.calibrated_threshold(s, ~np.zeros(4, bool))[0] == 2.0
    assert quality.calibrated_threshold(np.array([]), np.array([], bool))[0] == 2.0


def labelled(seed, n=3000):
    """Counts of plain rows, and of rows that are odd in one ratio each."""
    rng = np.random.default_rng(seed)
    counts = np.column_stack([np.full(n, 100), rng.integers(450, 550, n), rng.integers(0, 2, n), rng.integers(0, 2, n), rng.integers(0, 8, n)])
    kind = np.where(np.arange(n) < n // 5, np.arange(n) % 4, -1)
    counts[kind == 0, 1] = 1200
    counts[kind == 1, 2] = 60
    counts[kind == 2, 3] = 30
    counts[kind == 3, 4] = 19
    order = rng.permutation(n)
    return counts[order], kind[order]


def test_forest_uses_every_ratio():
    counts, kind = labelled(1)
    fitted = quality.fit_judge(counts, kind < 0)
    fresh, truth = labelled(2)
    rejected = fitted.score(fresh) >= fitted.threshold
    assert all(rejected[truth == k].mean() > 0.9 for k in range(4)) and rejected[truth < 0].mean() < 0.01


def path_length(tree, row):
    """A row's path length in a tree, node by node."""
    feature, split, left, right, length = tree
    at = 0
    while feature[at] >= 0:
        at = left[at] if row[feature[at]] <= split[at] else right[at]
    return length[at]


def test_verdict_equals_a_plain_walk(spark):
    counts, kind = labelled(3, 600)
    fitted = quality.fit_judge(counts, kind < 0)
    rows = [(k, *map(int, c)) for k, c in enumerate(counts)]
    stats = spark.createDataFrame(rows, "doc_id long, " + ", ".join(f"{c} long" for c in quality.COUNTS))
    got = {r.doc_id: r for r in quality.judge(stats, fitted).collect()}
    for k, x in enumerate(quality.features(counts)):
        mean = sum(path_length(t, x) for t in fitted.forest.trees) / len(fitted.forest.trees)
        score = 2 ** (-mean / quality._expected(fitted.forest.size))
        assert abs(got[k].anomaly - score) < 1e-9
        failed = counts[k][0] < 10 or 100 * counts[k][4] > 20 * counts[k][0]
        assert got[k].kept == (not failed and score < fitted.threshold)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_held_out_labels(spark):
    docs, labels = load(spark, SF, "documents"), load(spark, SF, "labels")
    aside = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(3)) == 0
    out = quality.quality_rules(docs, labels.where(~aside)).join(labels.where(aside), "doc_id").where("NOT base_failed").collect()
    good, bad = [r.kept for r in out if r.quality], [r.kept for r in out if not r.quality]
    assert np.mean(good) > 0.985 and np.mean(bad) < 0.15, (np.mean(good), np.mean(bad), len(good), len(bad))


def test_very_long_text_is_counted_whole():
    text = " ".join(f"w{k}" for k in range(200_000)) + "\n" + "tail of it all " * 3
    assert quality.rule_counts(text)[0] == 200_012 and quality.rule_counts(text)[4] == 12


def test_edges(spark):
    rows = [(1, None, "x"), (2, "", "y"), (None, "a b c d e f g h i j k", None), (3, "w " * 30, "z"), (3, "w " * 30, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = {(r.doc_id, r.n_words): r for r in quality.quality_rules(docs, labels).collect()}
    assert out[(1, 0)].base_failed and not out[(1, 0)].kept and out[(None, 11)].kept
    assert out[(3, 30)].n_repeat_words == 30 and out[(3, 30)].base_failed
    assert quality.quality_rules(docs.limit(0), labels).count() == 0
    assert quality.quality_rules(docs, labels).count() == 5
