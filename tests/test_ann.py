"""The inverted file against a search without an index."""

import numpy as np
import pytest

from lectern.operators import ann, vector_search
from lectern.plans import registry
from lectern.runtime import load

SF = "/root/testdata/sf0.1"
DDL = "id long, embedding array<float>"


def answers(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((-r.sim, r.chunk_id))
    return {q: [c for _, c in sorted(own)] for q, own in out.items()}


@pytest.fixture(scope="module")
def index(spark):
    return ann.temporary(registry.vector_chunks(spark, SF))


def test_recall_of_all_given_vectors(spark, index):
    asked = registry._asked(spark, SF)
    want = answers(vector_search.nearest_in_blocks(registry.vector_chunks(spark, SF), asked, 15))
    got = answers(index.search(asked, 15))
    assert got.keys() == want.keys()
    recall = np.mean([len(set(got[q]) & set(want[q])) / len(want[q]) for q in want])
    assert recall >= 0.9, recall
    assert answers(index.exact(asked, 15)) == want
    fewer = answers(index.exact(asked, 15, probes=2))
    assert all(len(own) <= 15 for own in fewer.values()) and fewer != want


def test_clustered_vectors_need_few_lists(spark):
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(20, 16))
    x = (middle[rng.integers(20, size=4000)] + 0.2 * rng.normal(size=(4000, 16))).astype(np.float32)
    x[: 4000 // 3] = x[0]  # a third of all rows are one vector
    chunks = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], DDL).repartition(4)
    index = ann.temporary(chunks)
    assert index.probes <= len(index.centres) // 3
    asked = spark.createDataFrame([(k, x[k].tolist()) for k in range(0, 4000, 40)], "query_id long, vector array<float>")
    want = answers(vector_search.nearest_in_blocks(chunks, asked, 10))
    got = answers(index.search(asked, 10))
    same = (x == x[0]).all(1)
    # Ties by id: the least ids of the copies, whatever part they are in.
    assert got[0] == want[0] == np.flatnonzero(same)[:10].tolist()
    assert np.mean([len(set(got[q]) & set(want[q])) / 10 for q in want]) >= 0.9


def test_parts_of_a_hot_list(spark, monkeypatch):
    monkeypatch.setattr(ann, "PART", 50)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 6)).astype(np.float32)
    x[:300] = np.abs(x[0]) + 0.01 * rng.normal(size=(300, 6))
    chunks = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], DDL)
    index = ann.temporary(chunks, 5)
    assert max(r.parts for r in index.counts.collect()) >= 6
    asked = spark.createDataFrame([(k, x[k].tolist()) for k in range(600)], "query_id long, vector array<float>")
    assert answers(index.exact(asked, 7)) == answers(vector_search.nearest_in_blocks(chunks, asked, 7))


def test_edges(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, 2.0, 3.0]), (5, [0.0, 1.0]), (6, [None, 1.0]), (7, [float("nan"), 1.0]), (8, [])]
    chunks = spark.createDataFrame(rows, DDL)
    asked = spark.createDataFrame([(1, [1.0, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [1.0, 2.0, 3.0]), (5, [])], "query_id long, vector array<float>")
    index = ann.temporary(chunks)
    assert answers(index.search(asked, 3)) == answers(index.exact(asked, 3)) == {1: [1, 5]}
    # Without an index a question matches vectors of its own length.
    assert answers(vector_search.nearest_in_blocks(chunks, asked, 3)) == {1: [1, 5], 4: [4]}
    empty = ann.temporary(chunks.limit(0))
    assert empty.search(asked, 3).count() == empty.exact(asked, 3).count() == 0
    assert index.search(asked.limit(0), 3).count() == 0


def test_query_returns_all_questions(spark):
    out = registry.ann_topk(spark, "/root/testdata/sf0.001")
    assert out.columns == ["query_id", "chunk_id", "sim"] and out.count() == 15 * load(spark, "/root/testdata/sf0.001", "embeddings").where("vec_id % 100 = 0").count()
