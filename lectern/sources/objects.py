"""Fetching listed objects with a pluggable fetcher, and counting what is there."""

from __future__ import annotations

import os
import subprocess
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: A fetcher maps (key, destination) to whether the object was stored.
Fetcher = Callable[[str, str], bool]


def command_fetcher(*command: str) -> Fetcher:
    """A fetcher that runs a command, {key} and {destination} replaced, once; success is exit status 0."""

    def run(key: str, destination: str) -> bool:
        os.makedirs(os.path.dirname(destination), exist_ok=True)
        return subprocess.run([c.replace("{key}", key).replace("{destination}", destination) for c in command], capture_output=True).returncode == 0

    return run


def fetch(files: DataFrame, out_dir: str, fetcher: Fetcher) -> DataFrame:
    """(key, accession_id, destination, ok): each listed object is fetched once, by the tasks; failures are rows, not errors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["destination"] = [f"{out_dir.rstrip('/')}/{k}" for k in b["key"]]
            done = []
            for k, d in zip(b["key"], b["destination"]):
                try:
                    done.append(bool(fetcher(k, d)))
                except OSError:
                    done.append(False)
            b["ok"] = done
            yield b

    return files.select("key", "accession_id").mapInPandas(run, "key string, accession_id string, destination string, ok boolean")


def xml_files(spark: SparkSession, path: str) -> DataFrame:
    """Binary rows of a file, whatever its name, or of every *.xml below a folder."""
    reader = spark.read.format("binaryFile")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(hadoop).isFile():
        return reader.load(path)
    return reader.option("recursiveFileLookup", True).option("pathGlobFilter", "*.xml").load(path)


def count_xml_files(spark: SparkSession, path: str) -> int:
    return xml_files(spark, path).select("path").count()
