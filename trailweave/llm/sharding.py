"""Sharding by size: contiguous shards of nearly equal bytes, in the order of a key.

Rows are dealt to partitions by ranges of the key, and each partition counts its rows and their sizes. The running sums
of these totals tell where a partition begins in the whole, sums within a partition where a row does; the whole is cut
at equal targets. A row belongs to the shard in which its middle lies, so no shard differs from its target by more than
the size of the largest row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, keep

SHARDS = 16
#: Rows that are equal in their whole key are dealt to so many places in the order.
TIES = 1 << 20


def text_size(text: Column) -> Column:
    """Bytes of a text in UTF-8 (null: none), and one more, as if it ended in a line break."""
    return (F.coalesce(F.octet_length(text.cast("string")), F.lit(0)) + 1).cast("bigint")


def sharded(rows: DataFrame, size: str, key: Sequence[str], shards: int = SHARDS) -> DataFrame:
    """rows with shard, 0 to shards - 1, and slot, the place in its shard, gapless from 0. size: the column with a
    row's size, a bigint of at least 1; key: the columns that the whole is ordered by, nulls first.

    Rows that are equal in the key stand in an order that is fixed by where they were read; one key may hold any share
    of the rows. A row greater than a shard's target leaves shards without rows; no rows give none. Columns may have
    any name; those that are called shard and slot are replaced. Sums of sizes times 2 * shards have to be bigints."""
    columns = [c for c in rows.columns if c.lower() not in ("shard", "slot")]
    own: list[str] = []
    for name in ("_tie", "_part", "_rows", "_bytes", "_all"):
        own.append(fresh([*columns, *own], name))
    tie, part, before_rows, before_bytes, total = own
    order = [*key, tie]
    marked = rows.select(*columns, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(TIES)).cast("int").alias(tie))
    # Written once: from here on it is fixed which rows are in which partition.
    dealt = keep(marked.repartitionByRange(*order).withColumn(part, F.spark_partition_id()))

    # One row a partition, so that one task can sum them, and every task can hold them.
    totals = dealt.groupBy(part).agg(F.count("*").alias("n"), F.sum(size).alias("bytes"))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    running = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    starts = F.broadcast(totals.select(part, running("n").alias(before_rows), running("bytes").alias(before_bytes), F.sum("bytes").over(Window.partitionBy()).alias(total)))

    def placed(of: DataFrame) -> DataFrame:
        """of with shard, and slot as the place in the whole."""
        within = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        at = of.join(starts, part).withColumn(before_bytes, F.col(before_bytes) + F.coalesce(F.sum(size).over(within), F.lit(0)))
        at = at.withColumn("slot", F.col(before_rows) + F.row_number().over(Window.partitionBy(part).orderBy(*order)) - 1)
        middle = (F.col(before_bytes) * 2 + F.col(size)) * shards
        return at.withColumn("shard", F.call_function("div", middle, F.col(total) * 2).cast("int"))

    # Where shards begin is found from the key and the sizes alone; one row a shard.
    firsts = placed(dealt.select(part, *dict.fromkeys([*order, size]))).groupBy("shard").agg(F.min("slot").alias(before_rows))
    out = placed(dealt).drop(before_rows).join(F.broadcast(firsts), "shard")
    return out.select(*columns, "shard", (F.col("slot") - F.col(before_rows)).alias("slot"))


def write_shards(docs: DataFrame, path: str, key: Sequence[str] = ("doc_id",), shards: int = SHARDS) -> None:
    """Writes docs (text, ...), whole, as Parquet below path, a folder shard=k for each shard that has rows; slot tells
    the order within. A shard's files are written by the tasks that hold its partitions: nothing is dealt out again."""
    size = fresh(docs.columns, "_size")
    sharded(docs.withColumn(size, text_size(F.col("text"))), size, key, shards).drop(size).write.partitionBy("shard").parquet(path)


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of docs (doc_id, text, ...), by size.

    The order is that of doc_id, then of the text's checksum and size. A null text has no bytes, and the checksum of
    none, 0; texts are read whole, once. Repeated rows have a slot each; equal texts are not kept together, as one
    group of copies may be larger than a shard. Other columns are ignored, whatever their names."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    thin = keep(docs.select("doc_id", text_size(F.col("text")).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")))
    out = sharded(thin, "size", ["doc_id", "text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: The checksum bit by bit, as the definition has it: the reversed polynomial 0xEDB88320 is a fixed value.
ORACLE = """with bits as (select doc_id, coalesce(text, '') as text, octet_length(encode(coalesce(text, ''))) + 1 as size from documents),
summed as (select *, sum(size) over (order by doc_id rows unbounded preceding) - size as before, sum(size) over () as total from bits),
cut as (select *, ((before * 2 + size) * 16 // (total * 2))::int as shard from summed),
cells as (select i, list_reduce(list_prepend(i, range(8)), lambda c, k: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end) as v from range(256) t(i)),
crc as (select list(v order by i) as cells from cells)
select doc_id, size::bigint as size,
  xor(list_reduce(list_prepend(4294967295, list_transform(range(1, size), lambda i: ('0x' || substr(hex(encode(text)), 2 * i - 1, 2))::bigint)),
    lambda c, b: xor(c // 256, cells[xor(c % 256, b) + 1])), 4294967295)::bigint as text_crc32,
  'bytes' as law, shard, (row_number() over (partition by shard order by doc_id) - 1)::bigint as slot, null::int as grown_shard
from cut, crc"""
