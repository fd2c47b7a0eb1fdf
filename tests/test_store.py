"""The log of key-range files: merges, bytes written, second writers, crashes and repeated batches."""

import random

import pytest

from lectern.sources import store as stores
from lectern.sources.corpus import ChunkStore

DDL = "paper_id string, section_index int, chunk_index int, bucket string, path_string string, title string, chunk_text string, embedding array<float>, seq int"


def rows(spark, keys, text, seq=1):
    return spark.createDataFrame([(p, s, c, "b", "", None, text, [0.5], seq) for p, s, c in keys], DDL)


def table(store):
    return {(r.paper_id, r.section_index, r.chunk_index): (r.id, r.chunk_text) for r in store.read().collect()}


def test_upserts_equal_a_dictionary(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stores, "ROWS", 40)
    rng = random.Random(2)
    store, want = ChunkStore(spark, f"{tmp_path}/s"), {}
    for n in range(7):
        keys = sorted({(f"p{rng.randrange(40):02d}", rng.randrange(-1, 4), rng.randrange(2)) for _ in range(200 if n == 0 else 12)})
        store.upsert(rows(spark, keys, f"t{n}"))
        want |= {k: f"t{n}" for k in keys}
        if n == 4:
            assert store._current()["deltas"] and store.compact() and not store._current()["deltas"]
            base = sorted((b["lo"], b["hi"]) for b in store._current()["base"])
            assert len(base) > 3 and all(a[1] < b[0] for a, b in zip(base, base[1:]))
        got = table(store)
        assert {k: t for k, (_, t) in got.items()} == want and store.read().count() == len(want)
    ids = {k: i for k, (i, _) in got.items()}
    store.vacuum(0)
    assert {k: i for k, (i, _) in table(store).items()} == ids and len(set(ids.values())) == len(ids)


def test_a_small_upsert_writes_little(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stores, "ROWS", 500)
    store = ChunkStore(spark, f"{tmp_path}/s")
    base = spark.range(20_000).selectExpr("concat('p', lpad(id % 2000, 5, '0')) paper_id", "cast(id / 2000 as int) section_index", "0 chunk_index", "'b' bucket", "'' path_string", "cast(null as string) title", "concat(sha2(cast(id as string), 512), sha2(cast(-id as string), 512)) chunk_text", "array(cast(rand(1) as float)) embedding", "1 seq").repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        store.upsert(base)
        first = store._current()
        whole = sum(b["bytes"] for b in first["base"])
        store.upsert(base.where("paper_id < 'p00020'").drop("chunk_text").selectExpr("*", "'changed' chunk_text"))  # one in a hundred keys
        second = store._current()
        delta = sum(s.getLen() for s in store._fs.listStatus(store._path(f"{store.path}/{second['deltas'][0]['folder']}")))
        assert delta < 0.05 * whole and second["base"] == first["base"]
        assert second["deltas"][0]["rows"] == 200 and 0 < len(second["deltas"][0]["touched"]) < len(first["base"])
        # New keys inside a file's range: the Bloom filter knows that it has none of them.
        store.upsert(rows(spark, [("p00500x", 0, 0)], "new"))
        third = store._current()["deltas"][1]
        assert third["touched"] == [] and len(third["within"]) == 1
        assert store.compact()
        fourth = store._current()
        assert len({b["file"] for b in fourth["base"]} & {b["file"] for b in first["base"]}) >= len(first["base"]) - 2
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert store.read().count() == 20_001 and store.read().where("chunk_text = 'changed'").count() == 200


def test_second_writer_and_crashes(spark, tmp_path):
    store, other = (ChunkStore(spark, f"{tmp_path}/s") for _ in range(2))
    store.upsert(rows(spark, [("p", 1, 0)], "one"))
    publish = store._publish

    def late(manifest):
        store._publish = publish
        other.upsert(rows(spark, [("q", 2, 0), ("p", 1, 0)], "two"))
        return publish(manifest)

    store._publish = late
    store.upsert(rows(spark, [("r", 3, 0), ("p", 1, 0)], "three"))
    assert {k[0]: t for k, (_, t) in table(store).items()} == {"p": "three", "q": "two", "r": "three"}
    before, version = table(store), store._current()["version"]

    def dies(manifest):
        raise RuntimeError("killed")

    store._publish = dies
    with pytest.raises(RuntimeError):
        store.upsert(rows(spark, [("s", 1, 0)], "lost"))
    assert table(other) == before and other._current()["version"] == version
    # A compaction that comes second changes nothing.
    lagging = ChunkStore(spark, f"{tmp_path}/s")
    other.upsert(rows(spark, [("t", 1, 0)], "t"))
    if not other._current()["deltas"]:
        other.upsert(rows(spark, [("t", 1, 0)], "t"))
    publish_of_lagging = lagging._publish

    def beaten(manifest):
        other.upsert(rows(spark, [("u", 1, 0)], "u"))
        return publish_of_lagging(manifest)

    lagging._publish = beaten
    assert lagging.compact() in (False, None)
    assert set(k[0] for k in table(other)) == {"p", "q", "r", "t", "u"}
    other.vacuum(0)
    assert set(k[0] for k in table(other)) == {"p", "q", "r", "t", "u"}


def test_rules_and_catalog(spark, tmp_path):
    store = ChunkStore(spark, f"{tmp_path}/s")
    assert store.read().count() == 0
    with pytest.raises(ValueError):
        store.register()
    store.upsert(rows(spark, [("p", 1, 0), ("p", 2, 0), ("p\x00", -(2**31), 2**31 - 1)], "t"))
    with pytest.raises(ValueError, match="paper_id is null: 1"):
        store.upsert(rows(spark, [(None, 4, 0), ("p", 1, 0)], "no"))
    twice = rows(spark, [("p", 1, 0)], "early", 1).unionByName(rows(spark, [("p", 1, 0)], "late", 2))
    store.upsert(twice)
    assert table(store)[("p", 1, 0)][1] == "late" and store.read().count() == 3
    store.upsert(rows(spark, [], "none"))
    store.vacuum(0)
    store.register("chunks", "lectern_test")
    assert spark.sql("SELECT count(*) FROM lectern_test.chunks").first()[0] == 3
    spark.sql("DROP TABLE lectern_test.chunks")


def test_repeated_batches_change_nothing(spark, tmp_path):
    store = ChunkStore(spark, f"{tmp_path}/s")
    for number, text in ((0, "a"), (1, "b"), (1, "again"), (0, "old"), (2, "c")):
        store.upsert(rows(spark, [("p", number, 0)], text), "stream", number)
    assert {k[1]: t for k, (_, t) in table(store).items()} == {0: "a", 1: "b", 2: "c"}
    version = store._current()["version"]
    store.upsert(rows(spark, [("p", 1, 0)], "again"), "stream", 2)
    assert store._current()["version"] == version
    store.upsert(rows(spark, [("p", 1, 0)], "other"), "another", 0)
    assert table(store)[("p", 1, 0)][1] == "other"


def test_killed_stream_equals_a_batch_run(spark, tmp_path):
    from lectern.operators import chunking, embedding
    from lectern.streaming import ingest

    folder = tmp_path / "in"
    folder.mkdir()

    def article(k, words):
        (folder / f"{k}.xml").write_text(f"<article><front><article-meta><article-id pub-id-type='pmcid'>PMC{k}</article-id><abstract><p>{words}</p></abstract></article-meta></front></article>")

    for k in range(3):
        article(k, f"words of paper {k} " * 5)
    offsets, provider = chunking.offsets_udf(chunking.word_tokenizer), embedding.hashing_provider(4)
    store, whole = ChunkStore(spark, f"{tmp_path}/s"), ChunkStore(spark, f"{tmp_path}/w")
    upsert, calls = store.upsert, []

    def killed(new, stream=None, number=0):
        upsert(new, stream, number)
        calls.append(number)
        if len(calls) == 1:
            raise RuntimeError("killed after the store has the batch")

    store.upsert = killed

    def run():
        query = ingest.stream(spark, str(folder), store, offsets, provider, f"{tmp_path}/c").trigger(availableNow=True).start()
        query.awaitTermination(120)

    with pytest.raises(Exception, match="killed"):
        run()
    version = store._current()["version"]
    run()
    assert calls == [0, 0] and store._current()["version"] == version
    article(1, "newer words of paper one")
    article(9, "a later paper")
    run()
    files = spark.read.format("binaryFile").load(str(folder))
    ingest.ingest(files, whole, offsets, provider)
    got, want = table(store), table(whole)
    assert {k: v for k, v in want.items() if k[0] != "PMC1"} == {k: v for k, v in got.items() if k[0] != "PMC1"} and len(want) >= 4
