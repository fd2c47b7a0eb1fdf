"""A BM25 index that follows upserts and deletions: immutable segments, dead entries, tiered merges.

An upsert writes one segment in one pass, without a shuffle: each task packs its chunks by blocks.
A block's ids and lengths are one row, and each of its terms is a row with the places in the block
that have it, in folders by a hash of the term. Beside them lie the entries of older segments that
the segment replaces, and by how much each term's number of chunks changes. Nothing older is
rewritten: what replaced chunks held is counted in the packed postings of their blocks, to which
one small array of marks a block travels. Numbers of chunks and of words are sums in the manifest,
and a term's number of chunks is the sum of its changes, so scores are those of an index made
afresh. When MERGE segments of one level stand, they become one of the next: postings without dead
entries, so a chunk is rewritten once a level; blocks keep their names and places.

Defined cases: chunk ids are distinct in a batch and not null (a batch that breaks this is a
ValueError and changes nothing); a null text is a chunk without words; ids to delete that the
index does not have are ignored; an empty batch changes nothing; an index without chunks has
no scores.
"""

from __future__ import annotations

import secrets
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators import bm25
from lectern.operators.bm25 import Index
from lectern.runtime import bound_batches, cut, discard, written
from lectern.sources.store import VersionedFolder

#: Segments of one level that are merged into one of the next.
MERGE = 4
#: Tasks for each core of the cluster that write a segment, at most.
TASKS = 4
#: The folder of the rows that hold a block's ids and lengths.
BLOCKS = -1

#: A block is named by a random number of 63 bits. Places are numbers of its chunks, whose id is null where a merge found them dead.
_PACKED = "term string, block long, places array<int>, tfs array<int>, df int, chunk_ids array<long>, dls array<int>"
_POSTINGS = f"{_PACKED}, bucket int"
_DEAD = "chunk_id long, seq long"
_TERMS = "term string, df long, bucket int"


def blocks(words: DataFrame) -> DataFrame:
    """_POSTINGS of (chunk_id, words), a batch of chunks a block."""
    bound_batches(words.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["term", "block", "places", "tfs", "df", "chunk_ids", "dls"]
        for b in bm25.gathered(batches):
            if not b.num_rows:
                continue
            terms, ends, row, tf, dl = bm25.by_term(b.column(1))
            n, name, ends = len(terms), secrets.randbits(63), pa.array(ends)
            own = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (row.astype(np.int32), tf)]
            df = pa.array(np.diff(ends.to_numpy()).astype(np.int32))
            yield pa.RecordBatch.from_arrays([terms, pa.array(np.full(n, name)), *own, df, pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int32()))], names)
            whole = pa.array([0, b.num_rows], pa.int32())
            held = [pa.ListArray.from_arrays(whole, x) for x in (b.column(0), pa.array(dl))]
            none = pa.nulls(1, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.array([name]), none, none, pa.nulls(1, pa.int32()), *held], names)

    packed = words.select("chunk_id", "words").mapInArrow(run, _PACKED)
    return packed.withColumn("bucket", F.when(F.col("term").isNull(), F.lit(BLOCKS)).otherwise(bm25._bucket(F.col("term"))))


def _marked(rows: DataFrame) -> DataFrame:
    """(block, marks) of (block, place): an array a block that is true at the places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, places in enumerate(b.column(1)):
                marks = np.zeros(max(places.as_py()) + 1, bool)
                marks[places.values.to_numpy()] = True
                yield pa.RecordBatch.from_arrays([b.column(0).slice(k, 1), pa.ListArray.from_arrays(pa.array([0, len(marks)], pa.int32()), pa.array(marks))], ["block", "marks"])

    return rows.groupBy("block").agg(F.collect_list("place").alias("places")).mapInArrow(run, "block long, marks array<boolean>")  # a block is bounded


def _mark(place: Column) -> Column:
    return F.coalesce(F.get("marks", place), F.lit(False))


class LexicalIndex(VersionedFolder):
    """The index below a folder that the cluster shares."""

    EMPTY = {"version": 0, "format": 2, "segments": [], "next": 1, "n": 0, "words": 0}

    def _current(self) -> dict:
        manifest = super()._current()
        if manifest.get("format") != self.EMPTY["format"]:
            raise ValueError(f"the index in {self.path} was made by an older version and must be made again")
        return manifest

    def _union(self, segments: list[dict], name: str, ddl: str) -> DataFrame:
        """A table of some segments, with seq, the segment that a row is of unless the table says."""
        out = None
        for s in segments:
            rows = self.spark.read.schema(ddl).parquet(f"{self.path}/{s['folder']}/{name}")
            rows = rows if name == "dead" else rows.withColumn("seq", F.lit(s["seq"]).cast("long"))
            out = rows if out is None else out.unionByName(rows)
        return out if out is not None else self.spark.createDataFrame([], ddl if name == "dead" else f"{ddl}, seq long")

    def _postings(self, segments: list[dict]) -> DataFrame:
        return self._union(segments, "postings", _POSTINGS).where(F.col("bucket") != BLOCKS).drop("chunk_ids", "dls")

    def _blocks(self, segments: list[dict]) -> DataFrame:
        return self._union(segments, "postings", _POSTINGS).where(F.col("bucket") == BLOCKS).select("block", "chunk_ids", "dls", "seq")

    def _chunks(self, segments: list[dict]) -> DataFrame:
        """(seq, block, place, chunk_id, dl) of chunks that no merge found dead."""
        rows = self._blocks(segments).select("seq", "block", F.posexplode(F.arrays_zip("chunk_ids", "dls")).alias("place", "c"))
        return rows.select("seq", "block", "place", F.col("c.chunk_ids").alias("chunk_id"), F.col("c.dls").alias("dl")).where("chunk_id is not null")

    def open(self) -> Index:
        """The index of the newest version, for bm25.scores."""
        manifest = self._current()
        segments = manifest["segments"]
        held = self._postings(segments).join(self._blocks(segments).drop("seq"), "block")
        held = held.select("term", "bucket", "seq", "chunk_ids", "dls", F.explode(F.arrays_zip("places", "tfs")).alias("p"))
        at = F.col("p.places")
        held = held.select(F.get("chunk_ids", at).alias("chunk_id"), "seq", "term", F.col("p.tfs").cast("long").alias("tf"), F.get("dls", at).alias("dl"), "bucket")
        postings = held.join(self._union(segments, "dead", _DEAD), ["chunk_id", "seq"], "left_anti").drop("seq")
        terms = self._union(segments, "terms", _TERMS).groupBy("term", "bucket").agg(F.sum("df").alias("df")).where("df > 0")
        size = self.spark.createDataFrame([(manifest["n"], manifest["words"] / manifest["n"] if manifest["n"] else None)], "n long, avgdl double")
        return Index(postings, terms, bm25._mean(terms, size))

    def upsert(self, chunks: DataFrame, text: str = "chunk_text", key: str = "chunk_id") -> None:
        """Chunks that the index has are replaced, others are added."""
        words = chunks.select(F.col(key).cast("long").alias("chunk_id"), bm25.tokens(F.col(text)).alias("words"))
        # A task writes a file in each folder, so there are no more tasks than the cluster runs a few times over.
        folder = self._segment(blocks(words.coalesce(TASKS * self.spark.sparkContext.defaultParallelism)))
        held = self._blocks([{"folder": folder, "seq": 0}]).select(F.explode(F.arrays_zip("chunk_ids", "dls")).alias("c"))
        seen = held.agg(F.count("*").alias("n"), F.count_distinct("c.chunk_ids").alias("distinct"), F.coalesce(F.sum("c.dls"), F.lit(0)).alias("words")).first()
        if seen["n"] != seen["distinct"] or not seen["n"]:
            self._delete(folder)
            if seen["n"]:
                raise ValueError("chunk ids are null or stand twice")
            return
        self._add(folder, held.select(F.col("c.chunk_ids").alias("chunk_id")), seen["n"], seen["words"])

    def delete(self, ids: DataFrame) -> None:
        """Takes chunks (chunk_id) out."""
        gone = cut(ids.select(F.col("chunk_id").cast("long").alias("chunk_id")).where("chunk_id is not null").distinct())
        folder = self._segment(self.spark.createDataFrame([], _POSTINGS))
        self._add(folder, gone, 0, 0)

    def _segment(self, postings: DataFrame) -> str:
        """Writes the postings and blocks of a segment where they are."""
        folder = f"s-{uuid.uuid4().hex}"
        postings.sortWithinPartitions("bucket", "term").write.option("compression", "zstd").partitionBy("bucket").parquet(f"{self.path}/{folder}/postings")
        return folder

    def _terms(self, changes: DataFrame, path: str) -> None:
        changed = changes.groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0").withColumn("bucket", bm25._bucket(F.col("term")))
        changed.repartition("bucket").sortWithinPartitions("term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/terms")

    def _add(self, folder: str, ids: DataFrame, n: int, words: int) -> None:
        """Publishes a segment whose chunks replace, or take out, what older segments have of these ids."""
        path = f"{self.path}/{folder}"
        while True:
            manifest = self._current()
            segments = manifest["segments"]
            # Who is replaced is found by ids alone; of what they held, only terms and counts travel.
            own, held = self._postings([{"folder": folder, "seq": 0}]), self._chunks(segments)
            old = written(held.join(self._union(segments, "dead", _DEAD), ["chunk_id", "seq"], "left_anti").join(ids, "chunk_id", "left_semi"))
            old.select("chunk_id", "seq").write.mode("overwrite").parquet(f"{path}/dead")
            lost = old.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("words")).first()
            changes, marks = own.select("term", "df"), None
            if lost["n"]:
                marks = written(_marked(old))  # a table, so that Spark knows its size and sends it to the tasks if it is small
                gone = F.size(F.filter("places", _mark))
                changes = changes.unionByName(self._postings(segments).join(marks, "block").select("term", (-gone).alias("df")).where("df < 0"))
            self._terms(changes, path)
            discard(old)
            if marks is not None:
                discard(marks)
            entry = {"folder": folder, "seq": manifest["next"], "level": 0}
            after = manifest | {"version": manifest["version"] + 1, "next": manifest["next"] + 1, "segments": [*segments, entry], "n": manifest["n"] + n - lost["n"], "words": manifest["words"] + words - lost["words"]}
            if self._publish(after):
                break
        while self.merge():
            pass

    def merge(self) -> bool:
        """Merges the segments of the lowest level that has MERGE of them; False if none has, or another writer was first."""
        manifest = self._current()
        segments = manifest["segments"]
        levels = [level for level in sorted({s["level"] for s in segments}) if sum(s["level"] == level for s in segments) >= MERGE]
        if not levels:
            return False
        old = [s for s in segments if s["level"] == levels[0]]
        dead = self._union(segments, "dead", _DEAD)
        marks = written(_marked(self._chunks(old).join(dead, ["chunk_id", "seq"], "left_semi")))
        alive = lambda c: F.transform(F.filter("p", lambda p: ~_mark(p["places"])), lambda p: p[c]).alias(c)
        postings = self._postings(old).join(marks, "block", "left").withColumn("p", F.arrays_zip("places", "tfs")).select("term", "block", alive("places"), alive("tfs"), "bucket")
        postings = postings.withColumn("df", F.size("places")).where("df > 0")
        postings = postings.repartition("bucket", F.pmod(F.xxhash64("block"), F.lit(1 + manifest["n"] // bm25.DEALT)))
        ids = F.transform("chunk_ids", lambda x, k: F.when(~_mark(k), x)).alias("chunk_ids")
        kept = self._blocks(old).join(marks, "block", "left").select("block", ids, "dls", F.lit(BLOCKS).alias("bucket")).where(F.exists("chunk_ids", lambda x: x.isNotNull()))
        folder = self._segment(postings.unionByName(kept, allowMissingColumns=True).select(*[c.split(" ")[0] for c in _POSTINGS.split(", ")]))
        discard(marks)
        path = f"{self.path}/{folder}"
        self._union(old, "dead", _DEAD).where(~F.col("seq").isin([s["seq"] for s in old])).write.parquet(f"{path}/dead")
        self._terms(self._union(old, "terms", _TERMS).select("term", "df"), path)
        entry = {"folder": folder, "seq": manifest["next"], "level": levels[0] + 1}
        after = manifest | {"version": manifest["version"] + 1, "next": manifest["next"] + 1, "segments": [*[s for s in segments if s not in old], entry]}
        if self._publish(after):
            return True
        self._delete(folder)
        return False

    def vacuum(self, seconds: float = 86_400) -> None:
        """Deletes older manifests, and segments of no version that were changed more than so many seconds ago."""
        manifest = self._current()
        named = {s["folder"] for s in manifest["segments"]} | {f"manifest-{manifest['version']}"}
        for name, age in self._listed():
            if name not in named and (name.startswith("manifest-") or (name.startswith(("s-", "_part-")) and age >= seconds)):
                self._delete(name)
