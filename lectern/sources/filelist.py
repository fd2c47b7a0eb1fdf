"""The list of article files: reading, sampling, manifest and failures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import strip
from lectern.operators.sampling import seeded_sample
from lectern.schemas import FILE_LIST_COLUMNS


def read_file_list(spark: SparkSession, path: str) -> DataFrame:
    """(key, accession_id, license) of a CSV with a header.

    Extra columns are ignored; rows with a blank Key go; empty optional values are null,
    blank ones empty. A missing column, and a list without rows, are ValueErrors.
    """
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).csv(path)
    missing = [c for c in FILE_LIST_COLUMNS if c not in raw.columns]
    if missing:
        raise ValueError(f"{path}: columns missing: {', '.join(missing)}")
    optional = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", strip(F.col(c)))
    rows = raw.select(strip(F.coalesce(F.col("Key"), F.lit(""))).alias("key"), optional("AccessionID").alias("accession_id"), optional("License").alias("license")).where("key <> ''")
    if rows.isEmpty():
        raise ValueError(f"{path}: no rows")
    return rows


def sample_files(files: DataFrame, n: int = 10, seed: int = 42) -> DataFrame:
    return seeded_sample(files, n, seed)


def write_manifest(sample: DataFrame, path: str) -> None:
    """The sample as one CSV with a header, in sample order; nulls are empty."""
    rows = sample.orderBy("sample_pos").select(F.col("key").alias("Key"), F.col("accession_id").alias("AccessionID"), F.col("license").alias("License"))
    rows.coalesce(1).write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def write_failures(failures: DataFrame, path: str) -> None:
    """(key, accession_id) of files that could not be fetched, under their own names."""
    failures.select(F.col("key").alias("Key"), F.col("accession_id").alias("AccessionID")).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def destination(key, out_dir: str):
    """Where a key's object goes below a folder."""
    return F.concat(F.lit(out_dir.rstrip("/") + "/"), key)
