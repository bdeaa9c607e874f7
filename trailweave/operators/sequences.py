"""Sequences of any length, over many tasks: rows of a key are numbered, cut into ranges, and looked at range by range
with what borders on them. No task sorts a whole key, and none holds more than a range."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import kept

#: Rows of a key in a range.
RANGE = 4096


def numbered(rows: DataFrame, key: str, order: Sequence[str], name: str = "ord") -> DataFrame:
    """rows, written, with `name`: 1, 2, ... by key in the order of columns that tell its rows apart.

    Rows are dealt by ranges of key and order. What a partition has of a key is counted; the sums of the counts before
    tell where it goes on. A key is one row a partition there, however long it is."""
    dealt = kept(rows.repartitionByRange(key, *order).withColumn("_part", F.spark_partition_id()))
    counts = dealt.groupBy(key, "_part").agg(F.count("*").alias("_n"))
    start = F.coalesce(F.sum("_n").over(Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col(key).alias("_key"), "_part", start.alias("_start")).withColumnRenamed("_part", "_of")
    # A partition has few rows of starts that it needs, so the join is by partition and key.
    joined = dealt.join(starts, (F.col("_part") == F.col("_of")) & F.col(key).eqNullSafe(F.col("_key")))
    rank = F.row_number().over(Window.partitionBy("_part", key).orderBy(*order))
    return joined.withColumn(name, F.col("_start") + rank).select(*rows.columns, name)


def in_ranges(rows: DataFrame, back: int = 0, ahead: int = 0, size: int = RANGE) -> DataFrame:
    """Rows with ord, each in its range (column range, from 0), and again, marked as border, in a range whose rows look
    back on it by `back` rows at most, or ahead to it by `ahead`."""
    at = F.floor((F.col("ord") - 1) / size)
    own = F.struct(at.alias("range"), F.lit(False).alias("border"))
    into = lambda ord_: F.struct(F.floor((ord_ - 1) / size).alias("range"), F.lit(True).alias("border"))
    # Ranges that the rows up to `back` after, and up to `ahead` before, are in; not its own, and none before the first.
    others = [into(F.col("ord") + k) for k in {min(back, size * j) for j in range(1, back // size + 2)} if back] + [into(F.greatest(F.col("ord") - k, F.lit(1))) for k in {min(ahead, size * j) for j in range(1, ahead // size + 2)} if ahead]
    every = F.array_distinct(F.array(own, *others))
    return rows.withColumn("_r", F.explode(F.filter(every, lambda r: ~r["border"] | (r["range"] != at)))).select(*rows.columns, "_r.range", "_r.border")


def neighbours(rows: DataFrame, key: str, order: Sequence[str], columns: dict[str, tuple[str, int]], size: int = RANGE) -> DataFrame:
    """rows with ord and, for each name of columns, a column's value so many rows before (< 0) or after (> 0) in the key;
    null where there is none."""
    back, ahead = (max([0, *(s * k for _, k in columns.values())]) for s in (-1, 1))
    ranges = in_ranges(numbered(rows, key, order), back, ahead, size)
    by = Window.partitionBy(key, "range").orderBy("ord")
    seen = {name: (F.lead(c, k) if k > 0 else F.lag(c, -k)).over(by) for name, (c, k) in columns.items()}
    return ranges.withColumns(seen).filter("not border").select(*rows.columns, "ord", *seen)


def running(rows: DataFrame, key: str, value: Column, name: str, size: int = RANGE) -> DataFrame:
    """rows (with ord) with the sum of value up to and with each, by key: sums within ranges, and of the ranges before."""
    ranged = kept(rows.withColumn("_range", F.floor((F.col("ord") - 1) / size)).withColumn("_value", value))
    sums = ranged.groupBy(key, "_range").agg(F.sum("_value").alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select(F.col(key).alias("_key"), F.col("_range").alias("_of"), before.alias("_start"))
    joined = ranged.join(starts, (F.col("_range") == F.col("_of")) & F.col(key).eqNullSafe(F.col("_key")))
    within = F.sum("_value").over(Window.partitionBy(key, "_range").orderBy("ord"))
    return joined.withColumn(name, F.col("_start") + within).select(*rows.columns, name)
