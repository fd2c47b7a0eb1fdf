"""Work of the trained vectors that goes with what texts hold, and an exact search that single precision only narrows."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lectern.operators import lsa, vector_search
from lectern.operators.vectors import unit


def test_nearer_equals_double_precision(monkeypatch):
    rng = np.random.default_rng(5)
    questions, limit = unit(rng.standard_normal((40, 96))), 7
    x = rng.standard_normal((900, 96)) * rng.uniform(0.01, 100, (900, 1))
    x[100:400] = x[100]  # many copies, which tie
    x[400:700] = questions[3] + 1e-7 * rng.standard_normal((300, 96))  # nearer to each other than single precision tells
    names = rng.permutation(900) + 10
    want = vector_search._best_of(np.zeros((40, 0)), np.zeros((40, 0), np.int64), np.round(-(questions @ x.T) / np.sqrt((x * x).sum(1)), 9), names, limit)
    whole = []
    real = vector_search._best_of
    monkeypatch.setattr(vector_search, "_best_of", lambda score, ids, new, *rest: (whole.append(new.shape), real(score, ids, new, *rest))[1])
    for step in (3, 50, 128):
        whole.clear()
        held = np.zeros((40, 0)), np.zeros((40, 0), np.int64)
        for k in range(0, 900, step):
            held = vector_search._nearer(*held, questions, questions.astype(np.float32), x[k : k + step], names[k : k + step], limit)
        assert np.array_equal(held[0], want[0]) and np.array_equal(held[1], want[1])
    # Most pairs are ruled out without the products in double precision.
    assert sum(a * b for a, b in whole) < 40 * 900 * 0.6


def test_rows_multiply_as_their_dense_matrix():
    rng, random_ = np.random.default_rng(2), random.Random(2)
    texts = [[0, 1, *random_.choices(range(500), k=random_.randrange(60))] if k % 7 else [] for k in range(120)] + [list(range(500)) * 2]
    held = [np.unique(np.array(t, np.int64), return_counts=True) for t in texts]
    ends = pa.array(np.cumsum([0, *(len(f) for f, _ in held)]).astype(np.int32))
    features, counts = (pa.ListArray.from_arrays(ends, pa.array(np.concatenate([p[k] for p in held]).astype(np.int32))) for k in (0, 1))
    idf, x = rng.uniform(0.5, 3, 500), rng.standard_normal((500, 20)).astype(np.float32)
    columns, a = lsa._block(texts, idf)
    dense = np.zeros((len(texts), 500))
    dense[:, columns] = a
    for frequent in (np.arange(500) < 3, np.zeros(500, bool)):
        often = lsa._places(frequent)
        rows = lsa._Rows.of(features, counts, idf, often)
        # Only frequent features are in the dense part; before, every feature that one of 32 rows had was.
        assert rows.dense.shape == (121, frequent.sum())
        y, z, z_often = rows.times(x, x[often >= 0]), np.zeros_like(x), np.zeros((frequent.sum(), 20), np.float32)
        rows.add_back(z, z_often, y)
        z[often >= 0] = z_often
        assert np.allclose(y, dense @ x, atol=1e-4) and np.allclose(z, dense.T @ (dense @ x), atol=1e-3)


def test_counted_rows_embed_as_texts(spark):
    docs = spark.createDataFrame([(7, "a b c A"), (8, None), (9, "..."), (10, "d e " * 5000), (11, "a d é")], "id long, text string")
    rows = lsa.counted(docs, features=64)
    for r in docs.join(rows, "id").collect():
        assert [f for f, n in zip(r.features, r.counts) for _ in range(n)] == sorted(lsa.features_of(r.text, 64))
    model = lsa.fit_counted(rows, dimension=8, features=64)
    got = {r.id: r.embedding for r in lsa.vectors(rows, model).collect()}
    for r in docs.collect():
        assert np.allclose(got[r.id], model.vectors([r.text])[0], atol=1e-5)
    asked = lsa.vectors(rows, model).select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    found = vector_search.nearest_in_blocks(lsa.vectors(rows, model), asked, 1).collect()
    assert {r.query_id: r.chunk_id for r in found} == {7: 7, 10: 10, 11: 11}
