"""Session helpers shared by every operator: table loading, code shipping, checkpoints."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent
#: Rows in one Arrow batch; bounds what a Python worker holds when texts are long.
BATCH_ROWS = 500
#: Bytes of one Arrow batch, where this version of Spark can bound them.
BATCH_BYTES = 1 << 24


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per Spark application."""
    sc = spark.sparkContext
    if getattr(sc, "_lectern_shipped", False):
        return
    folder = os.path.realpath(tempfile.mkdtemp(prefix="lectern"))
    archive = os.path.join(folder, "lectern_pkg.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(PACKAGE.rglob("*.py")):
            z.write(path, str(path.relative_to(PACKAGE.parent)))
    sc.addPyFile(archive)
    sc._lectern_shipped = True


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's bounds on Arrow batches; a plan reads them when it runs, so they stay lowered."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key, str(most)).lower().rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The Parquet table of that name below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares, from ``spark.checkpoint.dir``.

    Where that is unset it is a temporary folder of this machine if Spark runs on this
    machine alone (unit tests), and a ValueError on a cluster.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lectern-checkpoint"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """The rows, written as a Parquet table in the shared folder and reread."""
    path = f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.parquet(path)
    out._lectern_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes the table of a DataFrame that written() made, once nothing reads it any more; others are left alone."""
    path = getattr(df, "_lectern_path", None)
    if path:
        sc = df.sparkSession.sparkContext
        file = sc._jvm.org.apache.hadoop.fs.Path(path)
        file.getFileSystem(sc._jsc.hadoopConfiguration()).delete(file, True)
