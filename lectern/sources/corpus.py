"""The corpus as JSON lines; the chunk table is in ``store``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lectern import schemas
from lectern.sources.store import ChunkStore  # noqa: F401


def by_path(df: DataFrame, file: str = "file") -> DataFrame:
    """Rows ordered by path, folder by folder."""
    return df.orderBy(F.split(file, "/"))


def write_jsonl(papers: DataFrame, errors: DataFrame, path: str) -> None:
    """Records and error records as JSON lines in the order of their paths; nulls are kept."""
    good = papers.select("file", F.to_json(F.struct(*[c for c in papers.columns if c != "file"]), {"ignoreNullFields": "false"}).alias("value"))
    bad = errors.select("file", F.to_json(F.struct("paper_id", "error", "file"), {"ignoreNullFields": "false"}).alias("value"))
    by_path(good.unionByName(bad)).select("value").write.mode("overwrite").text(path)


def write_single_json(papers: DataFrame, path: str) -> None:
    """Exactly one record as one JSON document."""
    if papers.count() != 1:
        raise ValueError("exactly one paper is wanted")
    papers.drop("file").coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_jsonl(spark: SparkSession, path: str, seen: Observation | None = None) -> tuple[DataFrame, DataFrame]:
    """(papers, quarantine): lines that are no paper, error records among them, go to quarantine.

    Papers have seq, their place by file and line; where two have one paper_id, the later wins an upsert.
    ``seen`` has the number of lines in quarantine as bad, once an action has read all papers.
    """
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    lines = spark.read.text(path).select("value", place.alias("seq"), F.from_json("value", f"{schemas.PAPER}, error string, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    bad = F.col("r._corrupt_record").isNotNull() | F.col("r.error").isNotNull() | F.col("r.paper_id").isNull()
    if seen is not None:
        lines = lines.observe(seen, F.count_if(bad).alias("bad"))
    return lines.where(~bad).select("r.*", "seq").drop("error", "_corrupt_record"), lines.where(bad).select("r.paper_id", F.coalesce("r.error", F.lit("not a record")).alias("error"), "value")
