"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two 32-bit segments. Of two fingerprints that differ in at most two bits, one
segment differs in at most one; so each fingerprint is indexed by both segments with each one bit wiped out (64 keys),
and fingerprints that meet under a key are verified. Work is on distinct fingerprints: copies add nothing.
A key under which many fingerprints meet is not paired out. Its members are dealt again, by the values that are one
bit or none away: fingerprints that meet there differ in two bits at most, and each is linked to the least."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_blocks, connected_components, keep, pieces, spread_join

SEGMENT_BITS = 32
#: Members of a key that are compared pair by pair; beyond it, the exact second dealing takes over. Both are exact.
PAIRED_MEMBERS = 16
#: Fingerprints of a task that makes and counts their keys: 64 of each, so some 260,000 keys in its hash table at any input.
DEALT = 1 << 12
_HASHES_AT_ONCE = 1 << 16


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shingle_hashes(text: str | None, shingle: int, seed: int) -> Iterator[np.ndarray]:
    """XXH64 of each run of `shingle` words, in blocks; of the whole sequence if there are fewer words."""
    carry: list[bytes] = []
    digest = xxhash.xxh64_intdigest
    some = False
    for block in byte_blocks((text or "").encode("utf-8", "replace").lower()):
        words = carry + block.split()
        if len(words) >= shingle:
            some = True
            runs = zip(*(words[i:] for i in range(shingle)), strict=False)
            yield np.array([digest(s, seed) for s in map(b" ".join, runs)], np.uint64)
            words = words[len(words) - shingle + 1 :]
        carry = words
    if not some and carry:
        yield np.array([digest(b" ".join(carry), seed)], np.uint64)


def fingerprints(n: int, hashes: Iterable[tuple[int, np.ndarray]]) -> np.ndarray:
    """The fingerprints of n texts, as int64, from (number of the text, hashes of some of its shingles)."""
    ones, totals = np.zeros((n, 64), np.int64), np.zeros(n, np.int64)
    held: list[np.ndarray] = []
    owners: list[int] = []

    def flush() -> None:
        if held:
            bits = np.unpackbits(np.concatenate(held).view(np.uint8), bitorder="little").reshape(-1, 64)
            starts = np.cumsum([0, *map(len, held)])[:-1]
            np.add.at(ones, owners, np.add.reduceat(bits, starts, axis=0, dtype=np.int32))
            np.add.at(totals, owners, [*map(len, held)])
            held.clear()
            owners.clear()

    waiting = 0
    for i, block in hashes:
        held.append(block)
        owners.append(i)
        waiting += len(block)
        if waiting >= _HASHES_AT_ONCE:
            flush()
            waiting = 0
    flush()
    return np.packbits(2 * ones > totals[:, None], axis=1, bitorder="little").view(np.int64).ravel()


def _fingerprints(texts: list[str | None], shingle: int, seed: int) -> np.ndarray:
    return fingerprints(len(texts), ((i, block) for i, text in enumerate(texts) for block in shingle_hashes(text, shingle, seed)))


def with_fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): the fingerprint of every text as bigint. A null text has no words: fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            prints = _fingerprints(batch.column(1).to_pylist(), shingle, seed)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, fp bigint")


def links(prints: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints `fp`, enough to reach whatever differs in two bits or fewer."""
    low = (1 << SEGMENT_BITS) - 1
    # Fingerprints are thin, so that Spark puts many into one partition; what becomes of them there is not.
    parts = max(1, -(-prints.count() // DEALT))
    prints = prints.repartition(parts, "fp")
    masks = F.array(*(F.lit(low & ~(1 << bit)) for bit in range(SEGMENT_BITS)))
    variants = prints.select("fp", F.explode(F.sequence(F.lit(0), F.lit(2 * SEGMENT_BITS - 1))).alias("v")).select(
        "fp",
        (
            F.shiftleft(F.col("v").cast("bigint"), SEGMENT_BITS)
            + F.when(F.col("v") < SEGMENT_BITS, F.col("fp")).otherwise(F.shiftright("fp", SEGMENT_BITS)).bitwiseAND(F.get(masks, F.col("v") % SEGMENT_BITS))
        ).alias("k"),
    )
    # Members are counted by a grouped sum, and only those of keys that are shared go on, spread over slots.
    shared = variants.groupBy("k").agg(F.count("*").alias("n")).filter("n > 1")
    met = keep(spread_join(variants, shared, ["k"], [F.col("fp")], "inner"))

    # A pair that meets under many keys, being equal in the segment, counts under the first.
    v = F.shiftright("k", SEGMENT_BITS)
    few = met.filter(F.col("n") <= PAIRED_MEMBERS).groupBy("k").agg(F.array_sort(F.collect_list("fp")).alias("m"))
    few = few.select(F.explode(F.sequence(F.lit(1), F.size("m") - 1)).alias("i"), "m", "k", v.alias("v"))
    few = few.select(F.element_at("m", F.col("i")).alias("x"), F.slice("m", F.col("i") + 1, F.size("m")).alias("ys"), "v")

    def links_here(y: Column) -> Column:
        differ = F.col("x").bitwiseXOR(y)
        own = F.when(F.col("v") < SEGMENT_BITS, differ).otherwise(F.shiftright(differ, SEGMENT_BITS)).bitwiseAND(F.lit(low))
        return (F.bit_count(differ) <= 2) & ((F.col("v") % SEGMENT_BITS == 0) | (own != 0))

    pairs = few.select(F.col("x").alias("a"), F.explode(F.filter("ys", links_here)).alias("b"))

    # Values one bit or none away from two fingerprints: shared by all pairs two bits apart or less, and by no other.
    dense = met.filter(F.col("n") > PAIRED_MEMBERS).select("fp").distinct().repartition(parts, "fp")
    flips = F.array(F.lit(0).cast("bigint"), *(F.lit(_signed(1 << i)) for i in range(64)))
    again = dense.select("fp", F.explode(F.transform(flips, lambda bit: bit.bitwiseXOR(F.col("fp")))).alias("near"))
    least = again.groupBy("near").agg(F.min("fp").alias("b"), F.count("*").alias("n")).filter("n > 1").drop("n")
    stars = spread_join(again, least, ["near"], [F.col("fp")], "inner").filter("fp <> b").select(F.col("fp").alias("a"), "b")
    return pairs.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs (doc_id, text, ...).

    Null and empty texts have fingerprint zero and link like any other. Rows that repeat keep their number. Rows
    whose doc_id is null take part; component_id is the smallest doc_id reachable, null if there is none.
    Texts of any length are hashed in blocks. Other columns are ignored, whatever their names. An empty table gives an
    empty result."""
    rows = keep(with_fingerprints(docs, shingle, seed))
    prints = keep(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    roots = connected_components(links(prints.select("fp")))
    known = prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    joined = known.filter("root <> fp").select("root").distinct().withColumn("linked", F.lit(True))
    known = keep(known.join(joined, "root", "left").filter("linked or n > 1"))
    components = known.join(known.groupBy("root").agg(F.min("first").alias("component")), "root").select("fp", "component")
    out = spread_join(rows, components, ["fp"], [F.col("doc_id")])
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.coalesce("component", "doc_id").alias("component_id"))
