"""Postings packed by batches against those counted by a shuffle."""

from pyspark.sql import functions as F

from lectern.operators import bm25


def test_packed_postings_equal_counted_ones(spark, monkeypatch):
    rows = [(k, ["a"] * (k % 4) + ["b", f"t{k % 50}"] if k % 9 else []) for k in range(1500)] + [(-5, None)]
    words = spark.createDataFrame(rows, "chunk_id long, words array<string>").repartition(3)
    packed = bm25.packed(words)
    assert "Exchange" not in packed._jdf.queryExecution().optimizedPlan().toString().replace("Repartition", "")
    # A term travels once a batch, not once a chunk.
    assert packed.where("term = 'b'").count() <= 12
    monkeypatch.setattr(bm25, "DEALT", 400)
    got = sorted(map(tuple, bm25.dealt(packed, 1501).collect()))
    want = {}
    for k, own in rows:
        for w in own or []:
            want[w, k] = want.get((w, k), 0) + 1
    sizes = {k: len(own or []) for k, own in rows}
    bucket = dict(spark.createDataFrame([(w,) for w in {w for w, _ in want}], "w string").select("w", bm25._bucket(F.col("w"))).collect())
    assert got == sorted((w, k, n, sizes[k], bucket[w]) for (w, k), n in want.items())
