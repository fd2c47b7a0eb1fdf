"""Seeded sampling without replacement that any run and partitioning repeats."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.runtime import cut


def with_position(df: DataFrame) -> DataFrame:
    """Rows with their position (0-based) in the DataFrame's order, counted partition by partition."""
    local = (1 << 33) - 1  # monotonic ids: the partition above, the row inside it below
    rows = cut(df.withColumn("_id", F.monotonically_increasing_id()))
    sizes = rows.groupBy(F.shiftright("_id", 33).alias("part")).count().orderBy("part").collect()  # one row a partition
    before, total = {}, 0
    for r in sizes:
        before[r.part], total = total, total + r["count"]
    starts = rows.sparkSession.createDataFrame(list(before.items()) or [(0, 0)], "part long, start long")
    placed = rows.withColumn("part", F.shiftright("_id", 33)).join(F.broadcast(starts), "part")
    return placed.withColumn("position", F.col("start") + F.col("_id").bitwiseAND(F.lit(local))).drop("_id", "part", "start")


def seeded_sample(df: DataFrame, n: int = 10, seed: int = 42) -> DataFrame:
    """n rows as ``random.Random(seed).sample`` picks positions, with sample_pos, their place in the sample.

    n below 0 or above the number of rows is a ValueError.
    """
    rows = with_position(df)
    size = rows.count()
    if not 0 <= n <= size:
        raise ValueError(f"can't sample {n} of {size} rows")
    picked = [(k, p) for k, p in enumerate(random.Random(seed).sample(range(size), n))]
    chosen = df.sparkSession.createDataFrame(picked, "sample_pos long, position long")
    return rows.join(chosen, "position").drop("position")  # Spark sends few positions to all tasks, by their size
