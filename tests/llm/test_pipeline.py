import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lectern.llm import bpe, decontaminate, neardup, pii, quality
from test_neardup import shingle_set


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(k, text(20)) for k in range(3)]
    rows = [(k, text(rng.randrange(30, 200))) for k in range(60)]
    rows += [(100, rows[5][1]), (101, rows[6][1] + " more"), (102, "too short"), (103, text(20) + " " + items[0][1]), (104, text(40) + " a.b@c.org +1 (555) 010-2233"), (105, None), (106, ""), (107, text(450) + " " + items[1][1] + " end")]
    rows += [(110 + k, " ".join(w + "###" for w in text(60).split())) for k in range(20)]
    docs = [(d, t, "en", "s", None if t is None else len(t)) for d, t in rows]
    labels = [(d, int(d < 110), 0) for d, _ in rows if d < 50 or d >= 110]
    folder = tmp_path_factory.mktemp("sf")
    for name, data, ddl in (("documents", docs, corpus_pipeline.DDL), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", items, "item_id long, text string")):
        spark.createDataFrame(data, ddl).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, sf_dir)
        yield name, {r.doc_id: r for r in docs.collect()}, after, {r.doc_id: r for r in after.collect()}
        docs = after


def test_stages_decide_as_brute_force(spark, sf_dir):
    seen = []
    for name, before, after, left in stages(spark, sf_dir):
        seen.append(name)
        if name != "bpe":
            assert after.columns == list(corpus_pipeline.COLUMNS)
        if name == "quality_rules":
            assert {102, 105, 106} | set(range(110, 130)) == before.keys() - left.keys()
        elif name == "near_dedup":
            for d in before.keys() - left.keys():
                x = shingle_set(before[d].text)
                assert any(e < d and 100 * len(x & (y := shingle_set(before[e].text))) >= 80 * len(x | y) for e in before)
            sets = [shingle_set(r.text) for r in left.values()]
            assert not any(100 * len(a & b) >= 80 * len(a | b) for k, a in enumerate(sets) for b in sets[:k]) and {100, 101} <= before.keys() - left.keys()
        elif name == "decontamination":
            assert before.keys() - left.keys() == {103}
            assert left[107].text == before[107].text.removesuffix(" end")[: -len(" ".join(before[107].text.split()[-21:-1]))] + " end"
            assert left[107].n_chars == len(left[107].text) and all(left[d].text == before[d].text for d in left if d != 107)
        elif name == "pii":
            assert left.keys() == before.keys() and left[104].text.endswith(" [EMAIL] [PHONE]") and left[104].n_chars == len(left[104].text)
            assert all(left[d].text == before[d].text for d in left if d != 104)
        else:
            assert left.keys() == before.keys()
            import public_tokenizers

            t = bpe.Encoder(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()).library
            assert all(left[d].ids == t.encode(before[d].text, add_special_tokens=False).ids for d in left)
    assert seen == ["quality_rules", "near_dedup", "decontamination", "pii", "bpe"]


def test_run_equals_stages(spark, sf_dir):
    *_, (_, _, _, last) = stages(spark, sf_dir)
    assert {r.doc_id: r.ids for r in corpus_pipeline.run(spark, sf_dir).collect()} == {d: r.ids for d, r in last.items()}


def test_repeated_and_empty(spark, sf_dir):
    rows = [(1, "one two three four five six seven eight nine ten a.b@c.de", None, None, None)] * 2 + [(None, None, None, None, None)]
    docs = spark.createDataFrame(rows, corpus_pipeline.DDL)
    assert corpus_pipeline.near_dedup(spark, docs.where("doc_id = 1"), sf_dir).count() == 1
    null_ids = docs.where("doc_id = 1").withColumn("doc_id", F.lit(None).cast("long")).unionByName(docs.where("doc_id = 1"))
    assert sorted(str(r.doc_id) for r in corpus_pipeline.near_dedup(spark, null_ids, sf_dir).collect()) in (["1"], ["None"])
    assert corpus_pipeline.pii_redaction(spark, docs, sf_dir).where(F.col("text").contains("[EMAIL]")).count() == 2
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0


def test_very_long_text_goes_through_every_stage(spark, sf_dir):
    rng = random.Random(9)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(60_000)) + " a.b@c.org"
    docs = spark.createDataFrame([(1, text, None, None, len(text))], corpus_pipeline.DDL).withColumn("th", F.lit("clash")).withColumn("added", F.lit(1))
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.count() == 1, name
    assert docs.first().n_tokens > 60_000
