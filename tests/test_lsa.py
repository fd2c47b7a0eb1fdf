"""Trained vectors against an exact SVD of the same matrix."""

import random

import numpy as np

from lectern.operators import embedding, lsa
from lectern.runtime import load


def exact(texts, features):
    """Singular values, the matrix and the weights, in plain NumPy."""
    rows = [lsa.features_of(t, features) for t in texts]
    df = np.zeros(features)
    for r in rows:
        df[list(set(r))] += 1
    idf = np.log((len(texts) + 1) / (df + 0.5))
    a = np.zeros((len(texts), features))
    for k, r in enumerate(rows):
        for f in set(r):
            a[k, f] = (1 + np.log(r.count(f))) * idf[f]
        a[k] /= np.linalg.norm(a[k]) or 1
    return a, idf


def test_equals_an_exact_svd(spark):
    docs = load(spark, "/root/testdata/sf0.01", "documents").select("text")
    texts = [r.text for r in docs.collect()]
    model = lsa.fit(docs.repartition(5), dimension=48, features=2048)
    exactly = lsa.fit(docs.repartition(3), dimension=48, features=2048, iterations=25)
    a, idf = exact(texts, 2048)
    assert np.allclose(idf, model.idf)
    u, s, vt = np.linalg.svd(a, full_matrices=False)
    # The values beyond the first few hardly differ from each other, so they settle last; more iterations settle them.
    assert np.allclose(model.values[:6], s[:6], rtol=0.01) and np.allclose(model.values[:32], s[:32], rtol=0.05)
    assert np.allclose(exactly.values[:32], s[:32], rtol=0.001)
    best = np.linalg.norm(a - (a @ vt[:48].T) @ vt[:48])
    assert np.linalg.norm(a - (a @ model.basis) @ model.basis.T) < 1.01 * best
    # Neighbours in the settled space are those in the exact one.
    want, got = (a @ vt[:48].T), exactly.vectors(texts)
    want /= np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-12)
    rng = random.Random(0)
    same = []
    for q in rng.sample(range(len(texts)), 60):
        w, g = want @ want[q], got @ got[q]
        tenth = np.sort(w)[-10]
        same.append((w[np.argsort(-g)[:10]] >= tenth - 0.01).mean())
    assert np.mean(same) > 0.9


def test_words_that_go_together_are_near(spark):
    rng = random.Random(1)
    topics = [[f"t{k}w{j}" for j in range(30)] for k in range(6)]
    rows = [(k % 6, " ".join(rng.sample(topics[k % 6], 8))) for k in range(300)]
    model = lsa.fit(spark.createDataFrame(rows, "topic int, text string"), dimension=6, features=4096)
    x = model.vectors([t for _, t in rows])
    topic = np.array([k for k, _ in rows])
    like = x @ x.T
    assert like[topic[:, None] == topic[None]].mean() > 0.95 and abs(like[topic[:, None] != topic[None]]).mean() < 0.2
    # Two words of a topic that never meet in one question are near; hashing alone puts them apart.
    a, b = model.vectors([topics[2][0], topics[2][1]])
    assert a @ b > 0.9
    a, b = np.array(embedding.hashing_provider(768)()([topics[2][0], topics[2][1]]))
    assert abs(a @ b) < 0.1


def test_defined_cases(spark, tmp_path):
    docs = spark.createDataFrame([("a b c",), ("a b c",), (None,), ("",), ("...",), ("d e " * 50_000,)], "text string")
    model = lsa.fit(docs, dimension=8, features=64)
    x = model.vectors(["a b c", None, "...", "d e"])
    assert np.allclose(np.linalg.norm(x, axis=1), [1, 0, 0, 1], atol=1e-5) and x.shape == (4, 8)
    model.save(spark, str(tmp_path / "m"))
    again = lsa.load(spark, str(tmp_path / "m"))
    assert np.array_equal(again.vectors(["a d"]), model.vectors(["a d"])) and np.array_equal(again.values, model.values)
    found = embedding.embedded(docs.withColumnRenamed("text", "chunk_text"), lsa.provider(spark, model)).collect()
    assert [len(r.embedding) for r in found] == [8] * 6
    assert np.allclose(embedding.embed_query("a b c", lsa.provider(spark, model)), x[0])
    none = lsa.fit(docs.limit(0), dimension=8, features=64)
    assert not none.vectors(["a"]).any()
