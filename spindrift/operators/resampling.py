"""Draws that any engine reproduces: an integer hash in place of a random stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import written

_M = 2147483647


def draw(slot: Column, number: Column, seed: int) -> Column:
    """A hash below 2**31 - 1 of slot and draw number."""
    return ((slot * 1103515245 + number * 12345 + F.lit(seed * 69069 + 7919).cast("long")) % _M * 48271) % _M


def resample_weights(units: DataFrame, n: int, draws: int, seed: int = 0) -> DataFrame:
    """draw, unit, weight: how often each of n units (column unit, 0..n-1) is chosen by n choices with replacement."""
    slots = units.select(F.col("unit").cast("long").alias("slot")).select("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(draws - 1).cast("long"))).alias("draw"))
    return slots.select("draw", (draw(F.col("slot"), F.col("draw"), seed) % n).alias("unit")).groupBy("draw", "unit").agg(F.count("*").alias("weight"))


def dense_units(df: DataFrame, key: str) -> tuple[DataFrame, int]:
    """key, unit (0.. in order of key) of the distinct keys, and how many there are.

    The keys are written with the number of their range partition; each partition is numbered by itself, above the keys of
    the partitions before it, which come from a table of one row a partition.
    """
    keys = written(df.select(key).distinct().repartitionByRange(key).withColumn("_p", F.spark_partition_id()), "units")
    counts = written(keys.groupBy("_p").agg(F.count("*").alias("_n")), "unit-counts")
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a partition
    base = counts.select("_p", before.alias("_base"))
    unit = F.col("_base") + F.row_number().over(Window.partitionBy("_p").orderBy(key)) - 1  # one range of keys
    return keys.join(F.broadcast(base), "_p").select(key, unit.alias("unit")), counts.agg(F.sum("_n")).first()[0] or 0


def smallest_by_hash(df: DataFrame, n: int, digest: Column, ties: list[str]) -> DataFrame:
    """The n rows with the smallest digests (hexadecimal text; ties: the smaller of these columns), or all rows where there are no more.

    The first four digits are counted; buckets below the one that holds the boundary are taken whole, and only that one, a
    65,536th of the rows or so, is ordered.
    """
    rows = df.withColumn("_h", digest).withColumn("_k", F.substring("_h", 1, 4))
    counts = rows.groupBy("_k").agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.orderBy("_k"))  # at most 65,536 rows
    edge = counts.withColumn("_upto", upto).where(F.col("_upto") >= n).orderBy("_k").first() if n > 0 else None
    if n <= 0:
        return df.limit(0)
    if edge is None:
        return df
    part = rows.where(F.col("_k") == edge["_k"]).orderBy("_h", *ties).limit(n - edge["_upto"] + edge["_n"])
    return rows.where(F.col("_k") < edge["_k"]).unionByName(part).drop("_h", "_k")
