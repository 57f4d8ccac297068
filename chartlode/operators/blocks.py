"""Order-dependent work on keys that may have most of the rows, in two passes.

Rows are dealt by ranges of key and order, so a frequent key is cut into blocks in many tasks. A block is worked on by itself; what it needs
of the blocks before it (how many rows, the last value) is a summary with a row for each block, which is scanned and joined back.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from chartlode.operators.storage import materialize


def in_blocks(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """rows with _part, the block of their key (blocks ascend in the order), and _place, which ascends within. Equal rows of an order are in one block. Nulls come first."""
    dealt = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("_m", F.monotonically_increasing_id())
    placed = dealt.withColumn("_part", F.shiftright("_m", 33)).withColumn("_place", F.expr("_m & 8589934591")).drop("_m")
    return materialize(placed, "blocks")


def block(keys: list[str]) -> WindowSpec:
    """The window over a block's rows in order."""
    return Window.partitionBy(*keys, "_part").orderBy("_place")


def with_before(rows: DataFrame, keys: list[str], summary: list[Column], scan: Callable[[WindowSpec], list[Column]]) -> DataFrame:
    """rows with what scan makes of the blocks before theirs. summary: aggregates of a block; scan: columns over a window of a key's blocks in order."""
    ends = rows.groupBy(*keys, "_part").agg(*summary)
    ends = ends.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"), *scan(Window.partitionBy(*keys).orderBy("_part")))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], F.col("_part") == F.col("_p"))
    return rows.join(ends, same).drop("_p", *[f"_k{i}" for i in range(len(keys))])


def ranked(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """rows with _at, their place in the order of their key from 0, and _n, the key's rows. Rows that are equal in the order come in any order."""
    placed = in_blocks(rows, keys, order)
    every = lambda w: Window.partitionBy(*keys)
    scan = lambda w: [(F.coalesce(F.sum("_k").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("_least")).alias("_shift"), F.sum("_k").over(every(w)).alias("_n")]
    out = with_before(placed, keys, [F.count("*").alias("_k"), F.min("_place").alias("_least")], scan)
    return out.withColumn("_at", F.col("_place") + F.col("_shift")).drop("_part", "_place", "_shift")


def value_at(rows: DataFrame, key: str, value: str, place: Callable[[Column], Column]) -> DataFrame:
    """key and value: of each key's n values in ascending order, nulls apart, that at place(n), from 0; exact, with no list of a key's values."""
    return ranked(rows.select(key, value).where(F.col(value).isNotNull()), [key], [value]).where(F.col("_at") == place(F.col("_n"))).select(key, value)
