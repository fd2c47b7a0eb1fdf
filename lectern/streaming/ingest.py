"""Continuous ingest of article files into the chunk table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import chunking, embedding
from lectern.sources.corpus import ChunkStore
from lectern.sources.jats import papers


def ingest(batch: DataFrame, store: ChunkStore, offsets, provider: embedding.Provider, window: int = chunking.WINDOW, overlap: int = chunking.OVERLAP, stream: str | None = None, number: int = 0) -> DataFrame:
    """Upserts the chunks of a batch of binary files; returns what went to quarantine (paper_id, error).

    stream and number: a batch that the store has from that stream already changes nothing.
    """
    good, errors = papers(batch, once=True)
    # The later path wins where two files are one paper.
    found, long_headers = chunking.chunks(good.withColumn("seq", F.split("file", "/")), offsets, window, overlap)
    store.upsert(embedding.embedded(found, provider), stream, number)
    return errors.select("paper_id", "error").unionByName(long_headers.select("paper_id", "error"))


def stream(spark: SparkSession, folder: str, store: ChunkStore, offsets, provider: embedding.Provider, checkpoint: str):
    """A query that ingests new *.xml files of a folder as they come; run it with the trigger you want.

    The store keeps the last batch of each checkpoint, so a batch that Spark repeats after a
    crash is written once.
    """
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).option("pathGlobFilter", "*.xml").load(folder)
    return files.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, number: ingest(batch, store, offsets, provider, stream=checkpoint.rstrip("/"), number=number))
