"""An index that follows upserts and deletions against one made afresh."""

import random

import pytest

from lectern.operators import bm25, lexical

DDL = "chunk_id long, chunk_text string"
WORDS = "rat gene cell virus liver blood mouse brain heart lung protein enzyme".split()


def scored(index, question):
    return {r.chunk_id: (r.score, r.n_chunks) for r in bm25.scores(index, question).collect()}


def test_scores_are_those_of_a_fresh_index(spark, tmp_path):
    rng, now = random.Random(6), {}
    index = lexical.LexicalIndex(spark, f"{tmp_path}/x")
    for step in range(6):
        ids = rng.sample(range(40), 25 if step == 0 else 8)
        batch = [(k, rng.choice([None, ""]) if rng.random() < 0.1 else " ".join(rng.choices(WORDS, k=rng.randrange(1, 12)))) for k in ids]
        index.upsert(spark.createDataFrame(batch, DDL))
        now |= dict(batch)
        if step in (2, 4):
            gone = rng.sample(sorted(now), 5)
            index.delete(spark.createDataFrame([(k,) for k in [*gone, gone[0], 999, None]], "chunk_id long"))
            for k in gone:
                now.pop(k)
    manifest = index._current()
    assert len(manifest["segments"]) < 8 and any(s["level"] for s in manifest["segments"]) and manifest["n"] == len(now)
    fresh = bm25.index(spark.createDataFrame(list(now.items()), DDL))
    for question in ("rat gene rat", "liver zebra", "virus cell heart brain"):
        assert scored(index.open(), question) == scored(fresh, question)
    index.vacuum(0)
    assert scored(index.open(), "rat gene") == scored(fresh, "rat gene")


def test_second_writer_and_edges(spark, tmp_path):
    one, two = (lexical.LexicalIndex(spark, f"{tmp_path}/x") for _ in range(2))
    assert scored(one.open(), "rat") == {}
    with pytest.raises(ValueError):
        one.upsert(spark.createDataFrame([(1, "rat"), (1, "gene")], DDL))
    with pytest.raises(ValueError):
        one.upsert(spark.createDataFrame([(None, "rat")], DDL))
    one.upsert(spark.createDataFrame([], DDL))
    assert one._current()["version"] == 0
    publish = one._publish

    def late(manifest):
        one._publish = publish
        two.upsert(spark.createDataFrame([(1, "gene gene"), (2, "rat")], DDL))
        return publish(manifest)

    one._publish = late
    one.upsert(spark.createDataFrame([(1, "rat mouse"), (3, "cell")], DDL))
    fresh = bm25.index(spark.createDataFrame([(1, "rat mouse"), (2, "rat"), (3, "cell")], DDL))
    assert scored(one.open(), "rat gene") == scored(fresh, "rat gene")
    two.delete(spark.createDataFrame([(k,) for k in range(5)], "chunk_id long"))
    assert scored(two.open(), "rat") == {} and two._current()["n"] == two._current()["words"] == 0
