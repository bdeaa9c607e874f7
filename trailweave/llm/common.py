"""What several operators share: the shared folder, written tables, joins with hot keys, components."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import shared

#: White space as the word rules of the operators mean it, as a Java and as a Python pattern.
SPACE_CLASS = r"[\x20\x09-\x0D]"
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


#: A table in the shared folder: cuts lineage, prunes columns, and survives lost executors.
keep = shared.kept


def spread_join(left: DataFrame, right: DataFrame, on: Sequence[str], by: Sequence[Column], how: str = "left", salts: int = 8) -> DataFrame:
    """Joins left, in which one key may hold a third of the rows, to right, whose rows are thin and few a key.

    Rows of a key are dealt to `salts` slots by a hash of `by`, and right is repeated once a slot. right may grow with
    the texts: nothing is broadcast, at any size."""
    return _slotted(left, right.hint("merge"), on, by, how, salts)


def group_join(left: DataFrame, groups: DataFrame, on: Sequence[str], by: Sequence[Column], how: str = "left", salts: int = 8) -> DataFrame:
    """The same for groups, one row a source or language, whose number doesn't grow with the texts: Spark broadcasts
    them up to its own threshold (spark.sql.autoBroadcastJoinThreshold), which it checks; beyond it keys are spread."""
    return _slotted(left, groups, on, by, how, salts)


def _slotted(left: DataFrame, right: DataFrame, on: Sequence[str], by: Sequence[Column], how: str, salts: int) -> DataFrame:
    slot = fresh([*left.columns, *right.columns], "_slot")
    salted_left = left.withColumn(slot, F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int"))
    salted_right = right.withColumn(slot, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted_left.join(salted_right, [*on, slot], how).drop(slot)


#: Places of a member_bits() table: 2,048 rows of 4 KB, 8 MB in all, whatever the input.
PLACES = 1 << 26


def _bit(by: Sequence[Column]) -> tuple[Column, Column]:
    place = F.pmod(F.xxhash64(*by), F.lit(PLACES)) + 1
    return F.bitmap_bucket_number(place), F.bitmap_bit_position(place)


def member_bits(rows: DataFrame, *by: Column) -> DataFrame:
    """(bucket, bits): the places that the hashes of `by` take among PLACES, 8 MB at most."""
    bucket, bit = _bit(by)
    places = rows.select(bucket.alias("bucket"), bit.alias("bit")).repartition("bucket")
    return keep(places.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")))


def split_by_bits(df: DataFrame, bits: DataFrame, *by: Column) -> tuple[DataFrame, DataFrame]:
    """(may, not): the rows of df whose `by` may be among those that made the bits, and those whose can't.

    The bits are bounded, so they are broadcast, and rows that meet no partner in a join needn't be shuffled for it. Where
    the places fill up more rows may meet one: the join behind this decides, so results are the same."""
    bucket, bit = _bit(by)
    b, at, held = (fresh(df.columns, name) for name in ("_bucket", "_at", "_bits"))
    placed = df.withColumn(b, bucket).withColumn(at, bit).join(F.broadcast(bits.select(F.col("bucket").alias(b), F.col("bits").alias(held))), b, "left")
    byte = F.substring(F.col(held), F.floor(F.col(at) / 8).cast("int") + 1, F.lit(1))
    is_set = F.coalesce(F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), (F.col(at) % 8).cast("int")) == 1, F.lit(False))
    return placed.filter(is_set).select(df.columns), placed.filter(~is_set).select(df.columns)


def settled(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns of these names, each made once a row. Spark would else put an expression wherever its column is
    used, and so into every step of a lambda function."""
    made = fresh(df.columns, "_made")
    return df.withColumn(made, F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items()))))).select(*[c for c in df.columns if c not in columns], f"{made}.*")


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of undirected edges (a, b), both bigint, as (node, root), root the least node of a component.

    Alternates large-star and small-star steps; each is a grouped minimum and an equi-join, written to the shared
    folder. The driver sees a count and a checksum a round. Nodes without an edge are not returned."""

    def linked(pairs: DataFrame) -> DataFrame:
        return pairs.filter("a > b").distinct()

    def state(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    spark = edges.sparkSession
    now = keep(linked(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))))
    before, seen = None, state(now)
    while seen != before:
        if not seen[0]:
            return spark.createDataFrame([], "node bigint, root bigint")
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = keep(linked(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = keep(linked(small.unionByName(least.select("a", F.col("m").alias("b")))))
        before, seen = seen, state(now)
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or address, and the path in it, for tasks that write or read files themselves."""
    if re.match(r"[a-z][a-z0-9+.-]*:", path):
        return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return pafs.LocalFileSystem(), path


def fresh(columns: Sequence[str], name: str) -> str:
    """A column name like `name` that columns don't have, in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches cut smaller, so that a task holds few texts as Python strings at once."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def byte_blocks(data: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """data in blocks of about `size` bytes that end before white space, so that no word is cut."""
    start = 0
    while start < len(data):
        end = start + size
        if end < len(data):
            found = _SPACE.search(data, end)
            end = found.start() if found else len(data)
        yield data[start:end]
        start = end


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
