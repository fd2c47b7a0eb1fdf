"""A lexical index packed by blocks: what it writes, what replaced chunks take back, and folders of another form."""

import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lectern.operators import bm25, lexical

DDL = "chunk_id long, chunk_text string"


def _word(k):
    return "".join("abcdefghijklmnopqrstuvwxyz"[k // 26**p % 26] for p in range(4)) + "ing"


def _texts(rng, ids):
    return {k: " ".join(_word(int(rng.random() ** 3 * 4000)) for _ in range(200)) for k in ids}


def _size(path):
    return sum(f.stat().st_size for f in Path(path).rglob("*.parquet"))


def _same(index, spark, now):
    fresh = bm25.index(spark.createDataFrame(list(now.items()), DDL))
    question = f"{_word(0)} {_word(7)} {_word(900)}"
    scored = [{r.chunk_id: (r.score, r.n_chunks) for r in bm25.scores(i, question).collect()} for i in (index.open(), fresh)]
    terms = [sorted((r.term, r.df) for r in i.terms.collect()) for i in (index.open(), fresh)]
    return scored[0] == scored[1] and len(scored[0]) > 10 and terms[0] == terms[1]


def test_an_upsert_writes_less_than_its_texts(spark, tmp_path):
    rng = random.Random(8)
    index, now = lexical.LexicalIndex(spark, f"{tmp_path}/x"), _texts(rng, range(1500))
    frame = lambda rows: spark.createDataFrame(list(rows.items()), DDL).repartition(2)
    index.upsert(frame(now))
    text = sum(map(len, now.values()))
    assert _size(f"{tmp_path}/x") < 0.6 * text  # terms stood there as text beside the postings before
    changed = _texts(rng, range(0, 2000, 2))
    index.upsert(frame(changed))
    now |= changed
    assert _same(index, spark, now)
    for at in (0, 100):  # the second makes four segments one, and its blocks lose their dead chunks
        index.delete(spark.createDataFrame([(k,) for k in range(at, at + 100)], "chunk_id long"))
        now = {k: t for k, t in now.items() if not at <= k < at + 100}
        assert _same(index, spark, now)
    assert [s["level"] for s in index._current()["segments"]] == [1]
    assert index._chunks(index._current()["segments"]).count() == len(now)


def test_blocks_need_no_shuffle(spark):
    words = spark.createDataFrame([(k, [_word(0), _word(k % 5), _word(0)]) for k in range(300)], "chunk_id long, words array<string>").repartition(3)
    made = lexical.blocks(words)
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1  # that of the test
    rows = made.collect()
    held = {r.block: (r.chunk_ids, r.dls) for r in rows if r.bucket == lexical.BLOCKS}
    got = {(r.term, held[r.block][0][p]): n for r in rows if r.term is not None for p, n in zip(r.places, r.tfs)}
    want = {}
    for k in range(300):
        for w in (_word(0), _word(k % 5), _word(0)):
            want[w, k] = want.get((w, k), 0) + 1
    assert got == want and sum(len(i) for i, _ in held.values()) == 300 and {n for _, dls in held.values() for n in dls} == {3}
    assert made.where("term is not null").agg(F.sum("df")).first()[0] == len(want)


def test_an_index_of_another_form_is_refused(spark, tmp_path):
    (tmp_path / "manifest-1").write_text(json.dumps({"version": 1, "segments": [], "next": 1, "n": 0, "words": 0}))
    with pytest.raises(ValueError, match="older version"):
        lexical.LexicalIndex(spark, str(tmp_path)).open()
