import json
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import bm25, chunking, sampling, upsert, vector_search
from lectern.plans import registry
from lectern.sources import corpus, filelist, objects


def test_retrieval(spark):
    rows = [(1, "p", "abstract", -1, 0, "", "T", "a", [1.0, 0.0]), (2, "p", "methods", 1, 0, "x", "U", "b", [0.9, 0.1]), (3, "q", "methods", 2, 0, "y", None, "c", [0.0, 1.0]), (4, "r", "methods", 2, 0, "y", "R", "d", [0.0, 0.0])]
    chunks = spark.createDataFrame(rows, "id long, paper_id string, bucket string, section_index int, chunk_index int, path_string string, title string, chunk_text string, embedding array<float>")
    out = vector_search.retrieve(chunks, [1.0, 0.0], 10, 5, 1).collect()
    assert [(r.paper_rank, r.paper_id, r.paper_title, len(r.evidence)) for r in out] == [(1, "p", "T", 1), (2, "q", None, 1)]
    assert out[0].evidence[0].chunk_id == 1 and out[0].paper_score == pytest.approx(1.0)
    assert [r.evidence for r in vector_search.retrieve(chunks, [1.0, 0.0], 10, 5, 0).collect()] == [None, None]
    assert vector_search.retrieve(chunks.limit(0), [1.0, 0.0]).count() == 0


def test_bm25_equals_plain_formula(spark):
    rng = random.Random(1)
    docs = [(k, f"p{k % 4}", f"t{k}", " ".join(rng.choice(["rat", "the", "gene", *("zz" + c for c in "abcdefghijklmnop")]) for _ in range(rng.randrange(0, 12)))) for k in range(30)]
    df = spark.createDataFrame(docs, "chunk_id long, paper_id string, title string, chunk_text string")
    words = {k: [w for w in t.split() if w != "the"] for k, _, _, t in docs}
    n, avgdl = len(docs), sum(map(len, words.values())) / len(docs)
    df_ = Counter(w for ws in words.values() for w in set(ws))
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df_.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: x if x >= 0 else 0.25 * mean for w, x in idf.items()}
    query = ["gene", "rat", "rat", "zebra"]
    want = {k: sum(idf.get(q, 0) * ws.count(q) * 2.5 / (ws.count(q) + 1.5 * (0.25 + 0.75 * len(ws) / avgdl)) for q in query) for k, ws in words.items()}
    scored = bm25.scores(bm25.index(df), "the gene rat Rat zebra")
    want = {k: x for k, x in want.items() if set(query) & set(words[k])}
    for way in (scored, bm25.scores_of_texts(df, "the gene rat Rat zebra")):
        assert {r.chunk_id: r.score for r in way.collect()} == pytest.approx(want)
        assert {r.n_chunks for r in way.collect()} == {n}
    assert bm25.scores_of_texts(df, "the").count() == bm25.scores(bm25.index(df), "the").count() == 0
    assert bm25.top_papers(df, bm25.scores(bm25.index(df), "zebra")).count() == 0
    top = bm25.top_papers(df, scored, 2, 1).collect()
    order = sorted((k for k in want if want[k] > 0), key=lambda k: (-want[k], k))
    assert top[0].evidence_ids == [order[0]] and top[0].paper_score == pytest.approx(want[order[0]]) and len(top) == 2


def test_upsert(spark):
    ddl = "id long, paper_id string, section_index int, chunk_index int, chunk_text string"
    old = spark.createDataFrame([(7, "p", 0, 0, "old"), (8, "p", 0, 1, "kept")], ddl)
    new = spark.createDataFrame([("p", 0, 0, "a", 1), ("p", 0, 0, "b", 2), ("q", -1, 0, None, 3)], "paper_id string, section_index int, chunk_index int, chunk_text string, seq int")
    once = upsert.merged(old, new)
    got = {(r.paper_id, r.section_index, r.chunk_index): (r.id, r.chunk_text) for r in once.collect()}
    assert got[("p", 0, 0)] == (7, "b") and got[("p", 0, 1)] == (8, "kept") and got[("q", -1, 0)][1] is None
    assert sorted(map(str, upsert.merged(once, new).collect())) == sorted(map(str, once.collect()))
    assert [(r.rule, r.n) for r in upsert.violations(once).collect()] == [("chunk_text is null", 1)]
    assert upsert.violations(old.unionByName(old)).where("rule = 'key stands twice'").first().n == 2


def test_sample(spark):
    df = spark.range(100).repartition(7).sortWithinPartitions("id")
    placed = {r.position: r.id for r in sampling.with_position(spark.range(57, numPartitions=5)).collect()}
    assert placed == {k: k for k in range(57)}
    got = sorted((r.sample_pos, r.id) for r in sampling.seeded_sample(spark.range(100, numPartitions=6), 10, 42).collect())
    assert [x for _, x in got] == random.Random(42).sample(range(100), 10)
    assert sampling.seeded_sample(df, 0).count() == 0
    for n in (-1, 101):
        with pytest.raises(ValueError):
            sampling.seeded_sample(df, n)


def test_file_list(spark, tmp_path):
    (tmp_path / "list.csv").write_text('Key,Extra,AccessionID,License\n a/1.xml ,x,PMC1,CC BY\n"",x,PMC2,y\nb/2.xml,x,,\n  ,,,\nc/3.xml,x,PMC3,"a, b"\n')
    files = filelist.read_file_list(spark, str(tmp_path / "list.csv"))
    assert sorted(map(tuple, files.collect())) == [("a/1.xml", "PMC1", "CC BY"), ("b/2.xml", None, None), ("c/3.xml", "PMC3", "a, b")]
    filelist.write_manifest(filelist.sample_files(files, 3, 1), str(tmp_path / "m"))
    rows = spark.read.option("header", True).csv(str(tmp_path / "m")).collect()
    assert [r.Key for r in rows] == [["a/1.xml", "b/2.xml", "c/3.xml"][k] for k in random.Random(1).sample(range(3), 3)]
    (tmp_path / "bad.csv").write_text("Key,License\na,b\n")
    (tmp_path / "none.csv").write_text("Key,AccessionID,License\n")
    for name in ("bad.csv", "none.csv"):
        with pytest.raises(ValueError):
            filelist.read_file_list(spark, str(tmp_path / name))
    done = objects.fetch(files, "/out/", lambda k, d: k != "b/2.xml").collect()
    assert {(r.key, r.ok) for r in done} == {("a/1.xml", True), ("b/2.xml", False), ("c/3.xml", True)} and done[0].destination.startswith("/out/")
    copied = objects.fetch(files.limit(1), str(tmp_path / "got"), objects.command_fetcher("cp", str(tmp_path / "list.csv"), "{destination}")).first()
    assert copied.ok and (tmp_path / "got" / copied.key).exists()
    filelist.write_failures(spark.createDataFrame([("k", "a")], "key string, accession_id string"), str(tmp_path / "f"))
    assert spark.read.option("header", True).csv(str(tmp_path / "f")).first().AccessionID == "a"


def test_keywords_past_the_fortieth_word(spark):
    words = [f"w{k}" for k in range(40)] + ["New", "W3", "new", "NEW", "Last"]
    df = spark.createDataFrame([(words,), (["a", None, "B", "A"],), ([],), (None,)], "v array<string>")
    got = [r[0] for r in df.select(T.distinct_ignoring_case(F.col("v"))).collect()]
    assert got == [words[:41] + ["Last"], ["a", "B"], [], None]


def test_upsert_of_every_document(spark, tmp_path):
    n = 600
    spark.range(n).selectExpr("id AS doc_id", "'s' AS source", "'en' AS lang").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {(r.section_index, r.chunk_index): (r.bucket, r.old_id) for r in registry.QUERIES["chunk_upsert"](spark, str(tmp_path)).collect()}
    assert rows == {(d, c): ("en" if c == 2 else f"new {d}", None if c == 1 else 3 * d + c) for d in range(n) for c in range(3)}


def test_equal_chunks_tie_wherever_they_are(spark):
    text = "rat gene virus gene cell of many rats and mice"
    docs = [(k, f"p{k}", f"t{k}", text if k % 5 == 0 else f"noise {'x' * (k % 7)} virus") for k in range(200)]
    df = spark.createDataFrame(docs, "chunk_id long, paper_id string, title string, chunk_text string").repartition(13, F.rand(3))
    for scored in (bm25.scores_of_texts(df, "rat gene virus cell"), bm25.scores(bm25.index(df), "rat gene virus cell")):
        assert len({r.score for r in scored.where("chunk_id % 5 = 0").collect()}) == 1
        assert [r.evidence_ids for r in bm25.top_papers(df, scored, 4, 1).collect()] == [[0], [5], [10], [15]]


def test_index_on_disk_prunes(spark, tmp_path):
    df = spark.createDataFrame([(k, f"alpha beta gamma w{'abcdefghij'[k % 10]}") for k in range(50)], "chunk_id long, chunk_text string")
    bm25.write_index(bm25.index(df), f"{tmp_path}/i")
    found = bm25.scores(bm25.open_index(spark, f"{tmp_path}/i"), "wa wc")
    assert sorted(r.chunk_id for r in found.collect()) == [k for k in range(50) if k % 10 in (0, 2)]
    assert "PartitionFilters: [isnotnull(bucket" in found._jdf.queryExecution().executedPlan().toString() or "bucket" in found._jdf.queryExecution().executedPlan().toString()
    assert bm25.scores(bm25.open_index(spark, f"{tmp_path}/i"), "the").count() == 0


def test_many_questions_equal_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "BLOCK", 3)
    rng = random.Random(2)
    rows = [(k, [float(rng.randrange(-2, 3)) for _ in range(4)]) for k in range(60)] + [(60, None), (61, [1.0]), (62, [0.0] * 4)]
    chunks = spark.createDataFrame(rows, "id long, embedding array<float>").repartition(5)
    asked = chunks.where("id % 9 = 0 OR id > 59").selectExpr("id AS query_id", "embedding AS vector")
    got = {}
    for r in vector_search.nearest_in_blocks(chunks, asked, 5).orderBy("query_id", F.desc("sim"), "chunk_id").collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)
    for q, v in rows:
        if q % 9 == 0 and q < 60 and any(v):
            sims = [(-round(sum(a * b for a, b in zip(v, w)) / math.sqrt(sum(a * a for a in v) * sum(b * b for b in w)), 9), k) for k, w in rows if w and len(w) == 4 and any(w)]
            assert got[q] == [k for _, k in sorted(sims)[:5]]
    assert vector_search.nearest_in_blocks(chunks, asked.limit(0)).count() == 0


def test_later_line_wins(spark, tmp_path):
    lines = [json.dumps({"paper_id": p, "title": t, "abstract": "a", "sections": []}) for p, t in (("p", "one"), ("q", "x"), ("p", "two"))]
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    papers, _ = corpus.read_jsonl(spark, str(tmp_path / "a.jsonl"))
    found, _ = chunking.chunks(papers, chunking.offsets_udf(chunking.word_tokenizer))
    assert sorted(r.title for r in upsert.last_of_key(found).collect()) == ["two", "x"]


def test_index_on_disk_has_the_sizes_of_one_in_memory(spark, tmp_path):
    texts = ["rat gene rat", "the of", None, "", "gene virus", "gene"]
    df = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, chunk_text string")
    for name, rows, want in (("a", df, (6, 1.0)), ("b", df.limit(0), (0, None)), ("c", df.where("chunk_id = 1"), (1, 0.0))):
        made = bm25.index(rows)
        bm25.write_index(made, f"{tmp_path}/{name}")
        kept = bm25.open_index(spark, f"{tmp_path}/{name}")
        assert made.size.collect() == kept.size.collect() and tuple(kept.size.first())[:2] == want
        assert sorted(map(tuple, made.terms.collect())) == sorted((r.term, r.df) for r in kept.terms.collect())
