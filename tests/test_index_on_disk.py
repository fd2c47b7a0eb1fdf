"""An index on disk: postings packed by batches, as in memory whatever the ids, and words found in one scan."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import bm25


def _rows(table):
    return sorted(map(tuple, table.select("term", "chunk_id", "tf", "dl").collect()), key=str)


def test_postings_stay_packed_on_disk(spark, tmp_path):
    df = spark.createDataFrame([(k, f"alpha beta alpha w{'abcdefghij'[k % 10]}") for k in range(2000)], "chunk_id long, chunk_text string").repartition(3)
    made = bm25.index(df)
    bm25.write_index(made, f"{tmp_path}/i")
    kept = spark.read.parquet(f"{tmp_path}/i/postings")
    # A term has a row a batch of chunks, not a row a chunk.
    assert kept.count() < 200 and kept.where("term = 'alpha'").agg(F.sum("df"), F.sum("words")).first() == (2000, 4000)
    found = bm25.open_index(spark, f"{tmp_path}/i")
    assert _rows(found.postings) == _rows(made.postings)
    asked = bm25.scores(found, "wa wc")
    plan = asked._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "PushedFilters: [In(term" in plan
    assert sorted(map(tuple, asked.collect())) == sorted(map(tuple, bm25.scores(made, "wa wc").collect()))


@pytest.mark.parametrize("ddl, ids", [("string", ["b", "a", "c", "d"]), ("long", [3, 3, 1, 2]), ("long", [None, 1, None, 2]), ("int", [4, 3, 2, 1])])
def test_any_ids(spark, tmp_path, ddl, ids):
    df = spark.createDataFrame(list(zip(ids, ["rat gene rat", "rat virus", None, "gene"])), f"chunk_id {ddl}, chunk_text string")
    made = bm25.index(df)
    bm25.write_index(made, f"{tmp_path}/i")
    found = bm25.open_index(spark, f"{tmp_path}/i")
    assert _rows(found.postings) == _rows(made.postings)
    assert sorted((r.term, r.df) for r in found.terms.collect()) == sorted((r.term, r.df) for r in made.terms.collect())
    assert found.size.collect() == made.size.collect()
    assert found.postings.schema["chunk_id"].dataType == df.schema["chunk_id"].dataType


def test_index_of_single_postings_is_read(spark, tmp_path):
    made = bm25.index(spark.createDataFrame([(1, "rat gene rat"), (2, "virus")], "chunk_id long, chunk_text string"))
    for name, table in (("postings", made.postings), ("terms", made.terms)):
        table.withColumn("bucket", bm25._bucket(F.col("term"))).write.partitionBy("bucket").parquet(f"{tmp_path}/{name}")
    made.postings.limit(0).write.parquet(f"{tmp_path}/columns")
    made.size.write.parquet(f"{tmp_path}/size")
    asked = bm25.scores(bm25.open_index(spark, str(tmp_path)), "rat virus")
    assert sorted(map(tuple, asked.collect())) == sorted(map(tuple, bm25.scores(made, "rat virus").collect()))


def test_one_scan_finds_the_words_of_spaced_words(spark):
    rng = random.Random(5)
    parts = "a the don n't 's 'll ' - -- --- . .. , é İ ΑΣ ß 𝒜 😀 漢 1 _ @ $ x n t 've 'd \" N'T 'S ( ) B cat".split() + [" ", " ", "\n", "\t", "\x0b", "\r\n", "\xa0", "\x85", " ", "́"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 14))) for _ in range(20_000)] + [None, "", "cat\x85", "rat. ", "rat's\x85", "ab" * 100_000 + "1 rat"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.filter(T.spaced_words(F.col("t")), lambda w: ~w.isin(*T.STOP_WORDS) & F.rlike(w, F.lit(T.IS_WORD)))
    found = df.select("t", T.tokens(F.col("t")).alias("one"), plain.alias("plain"))
    assert found.where("one <> plain").limit(5).collect() == []
    words = {r.t: r.one for r in found.collect()}
    # A line separator at the end of a text is no white space and no letter, so what ends in it is no word.
    assert words["cat\x85"] == words["rat. "] == words["rat's\x85"] == [] and words["ab" * 100_000 + "1 rat"] == ["rat"]
