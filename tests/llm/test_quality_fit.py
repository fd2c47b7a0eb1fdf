"""The fit over all labelled rows against the same made in memory."""

import numpy as np
from pyspark.sql import functions as F

from lectern.llm import quality


def test_every_labelled_row_counts(spark):
    rng = np.random.default_rng(5)
    n = 20_000
    counts = np.column_stack([np.full(n, 100), rng.integers(450, 550, n), rng.integers(0, 3, n), rng.integers(0, 2, n), rng.integers(0, 8, n)])
    odd = rng.random(n) < 0.1
    counts[odd, 1] = 900 + counts[odd, 1]
    rows = [(k, *map(int, c), int(not o)) for k, (c, o) in enumerate(zip(counts, odd))]
    table = spark.createDataFrame(rows, "doc_id long, " + ", ".join(f"{c} long" for c in quality.COUNTS) + ", quality int").repartition(5)
    fitted = quality.fit(table.drop("quality"), table.select("doc_id", "quality"))
    side = {r.doc_id: r.grown for r in table.select("doc_id", (F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0).alias("grown")).collect()}
    grown, x = np.array([side[k] for k in range(n)]), quality.features(counts)
    forest = quality.IsolationForest(x[grown & ~odd], (x[grown].min(0), x[grown].max(0)))
    assert all(np.array_equal(a, b) for own, other in zip(fitted.forest.trees, forest.trees) for a, b in zip(own, other))
    score = forest.score(x[~grown])
    assert np.isclose(fitted.threshold, quality.calibrated_threshold(score, ~odd[~grown])[0], rtol=0, atol=1e-12)
    # Each tree holds all of its rows: its leaves do, and its path lengths are of shares of them.
    for tree, held in zip(forest.trees, quality.held(forest.trees, x[grown & ~odd])):
        assert held.sum() == (grown & ~odd).sum() and not held[tree[0] >= 0].any()


def test_threshold_over_ranges_equals_plain_sums(spark):
    rng = np.random.default_rng(8)
    for scale in (1.0, 1e-5):  # over many ranges, and inside one
        score = 0.5 + scale * np.round(rng.normal(size=3000) / 20, 4)
        good = rng.random(3000) > np.clip((score - 0.5) / scale * 12, 0.001, 0.999)
        table = spark.createDataFrame([(float(s), int(g), int(not g)) for s, g in zip(score, good)], "score double, n_good long, n_bad long").groupBy("score").agg(F.sum("n_good").alias("n_good"), F.sum("n_bad").alias("n_bad"))
        got, want = quality._threshold(table), quality.calibrated_threshold(score, good)
        assert np.allclose(got, want, rtol=0, atol=1e-12)
