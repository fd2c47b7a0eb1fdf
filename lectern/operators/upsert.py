"""Idempotent upsert into the chunk table, and its rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.schemas import CHUNK_KEY, CHUNK_NOT_NULL


def last_of_key(rows: DataFrame, key: tuple[str, ...] = CHUNK_KEY, order: str = "seq") -> DataFrame:
    """The last row of each key by ``order``."""
    last = Window.partitionBy(*key).orderBy(F.desc(order))
    return rows.withColumn("nth", F.row_number().over(last)).where("nth = 1").drop("nth")


def merged(old: DataFrame, new: DataFrame, key: tuple[str, ...] = CHUNK_KEY, order: str = "seq") -> DataFrame:
    """The table after an upsert: new rows replace old ones of their key, and keep the old id; others get a stable one.

    old has id and new's columns; new has ``order``, by which the last of a key wins. Both
    sides meet in one shuffle by key. The id of a new key is a hash of it, so the same batch
    twice changes nothing.
    """
    columns = [c for c in old.columns if c not in (*key, "id")]
    batch = last_of_key(new, key, order).select(*key, F.lit(True).alias("is_new"), F.struct(*columns).alias("fresh"))
    kept = old.select(*key, F.col("id").alias("old_id"), F.struct(*columns).alias("stale"))
    both = kept.join(batch, list(key), "full")
    value = F.when(F.col("is_new"), F.col("fresh")).otherwise(F.col("stale"))
    rows = both.select(F.coalesce("old_id", F.xxhash64(*key)).alias("id"), *key, value.alias("v"))
    return rows.select(*[F.col("v")[c].alias(c) if c in columns else F.col(c) for c in old.columns])


def violations(table: DataFrame, key: tuple[str, ...] = CHUNK_KEY) -> DataFrame:
    """(rule, n) of broken rules: nulls where none may be, keys that stand twice."""
    nulls = table.select([F.sum(F.col(c).isNull().cast("long")).alias(c) for c in CHUNK_NOT_NULL if c in table.columns])
    named = F.explode(F.map_from_arrays(F.array(*[F.lit(f"{c} is null") for c in nulls.columns]), F.array(*nulls.columns)))
    twice = table.groupBy(*key).count().where("count > 1").agg(F.count("*").alias("n")).select(F.lit("key stands twice").alias("rule"), "n")
    return nulls.select(named.alias("rule", "n")).unionByName(twice).where("n > 0")
