"""Near copies: SimHash links first, exact shingle sets decide; min-hash bands for what lies beyond SimHash's radius.

A text is the set of the hashes of its shingles; texts of equal sets are one node. Nodes whose SimHash fingerprints are
equal or, by deletion-variant signatures (simhash.links), two bits apart or less are compared by their whole sets, made
anew from the candidates' texts only, and joined. At a similarity of 0.8 fingerprints differ in ten bits on average, which
no index of signatures reaches; so what isn't joined yet meets by min-hash as well: of each set ROWS * BANDS least hashes
under different multiplications are taken; ROWS of them make the key of a band. Sets of similarity J share a key with
probability 1 - (1 - J**ROWS)**BANDS: 0.9999 at 0.8. Nodes that meet and aren't joined are compared by their sets, too.
Under a key that many nodes share, each is compared with the least one first. Keys whose nodes are not all linked then
are dealt in pairs of blocks, in which what isn't linked yet is compared: every meeting that may link something is tried,
and only two blocks, of BLOCK_NODES nodes each on average, are in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import connected_components, keep, member_bits, pieces, split_by_bits, spread_join

SHINGLE = 5
ROWS = 5
BANDS = 24
#: Nodes of a key that are compared pair by pair; beyond it, with the least one, then by blocks.
PAIRED_NODES = 16
BLOCK_NODES = 256
_HASHES_AT_ONCE = 1 << 12
_PRINTED_AT_ONCE = 1 << 16
_FACTORS = np.random.default_rng(42).integers(0, 1 << 64, ROWS * BANDS, np.uint64) | np.uint64(1)


def shingle_set(text: str | None, shingle: int = SHINGLE, seed: int = 42) -> np.ndarray:
    """The sorted distinct hashes of the text's shingles, as uint64; of the whole text if it has fewer words."""
    blocks = [np.unique(block) for block in simhash.shingle_hashes(text, shingle, seed)]
    return np.unique(np.concatenate(blocks)) if blocks else np.array([], np.uint64)


def band_keys(hashes: np.ndarray) -> list[int]:
    """The key of each band of a set, as signed numbers; none for the empty set."""
    if not len(hashes):
        return []
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(hashes), _HASHES_AT_ONCE):
        np.minimum(least, (_FACTORS[:, None] * hashes[None, start : start + _HASHES_AT_ONCE]).min(axis=1), out=least)
    keys = [xxhash.xxh64_intdigest(rows.tobytes(), band) for band, rows in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def _with_keys(docs: DataFrame, shingle: int, seed: int) -> DataFrame:
    """(doc_id, row, node, size, fp, keys) of docs (doc_id, row, text): a node is a hash of the whole set, fp its SimHash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            nodes, sizes, keys = [], [], []

            def blocks(texts: list[str | None], nodes=nodes, sizes=sizes, keys=keys) -> Iterator[tuple[int, np.ndarray]]:
                for i, text in enumerate(texts):
                    hashes = shingle_set(text, shingle, seed)
                    nodes.append(xxhash.xxh64_intdigest(hashes.tobytes(), seed))
                    sizes.append(len(hashes))
                    keys.append(band_keys(hashes))
                    yield from ((i, hashes[at : at + _PRINTED_AT_ONCE]) for at in range(0, len(hashes), _PRINTED_AT_ONCE))

            prints = simhash.fingerprints(batch.num_rows, blocks(batch.column(2).to_pylist()))
            numbers = pa.array(np.array(nodes, np.uint64).view(np.int64))
            columns = [batch.column(0), batch.column(1), numbers, pa.array(sizes, pa.int64()), pa.array(prints, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "node", "size", "fp", "keys"])

    return docs.mapInArrow(run, "doc_id bigint, row bigint, node bigint, size bigint, fp bigint, keys array<bigint>")


def _sets(texts: DataFrame, shingle: int, seed: int) -> DataFrame:
    """(node, hashes) of texts (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            sets = [shingle_set(text, shingle, seed).view(np.int64) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "hashes"])

    return texts.mapInArrow(run, "node bigint, hashes array<bigint>")


def _sets_of(wanted: DataFrame, nodes: DataFrame, given: DataFrame, shingle: int, seed: int) -> DataFrame:
    """(node, hashes) of the nodes in wanted (node), from one text each."""
    chosen = nodes.join(wanted.distinct(), "node").select("node", "row")
    texts = spread_join(given, chosen, ["row"], [F.col("doc_id")], "inner").select("node", "text")
    return _sets(texts, shingle, seed).dropDuplicates(["node"])


def _near(least: float) -> Column:
    """Whether x and y can be alike at all, by their sizes."""
    return F.least("x.size", "y.size") >= F.lit(least) * F.greatest("x.size", "y.size")


def _met_by_fingerprint(nodes: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of nodes (node, size, fp) whose fingerprints are equal (each with the least one) or linked."""
    one = F.struct("node", "size")
    heads = keep(nodes.groupBy("fp").agg(F.min(one).alias("x"), F.count("*").alias("n")))
    equal = spread_join(nodes.select("fp", one.alias("y")), heads.filter("n > 1").select("fp", "x"), ["fp"], [F.col("y.node")], "inner").filter("x.node <> y.node")
    linked = simhash.links(heads.select("fp")).join(heads.select(F.col("fp").alias("a"), "x"), "a").join(heads.select(F.col("fp").alias("b"), F.col("x").alias("y")), "b")
    met = equal.select("x", "y").unionByName(linked.select("x", "y"))
    return met.filter(_near(least)).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))


def _alike(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Of pairs (a, b), those whose sets have a similarity of `least`."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.filter(common >= F.lit(least) * (F.size("x") + F.size("y") - common)).select("a", "b")


def block_links(nodes: list[int], blocks: list[int], roots: list[int], sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Links between the nodes of two blocks (or within one) that join what roots hasn't joined: all that are needed."""
    root = {r: r for r in roots}

    def find(r: int) -> int:
        while root[r] != r:
            root[r] = r = root[root[r]]
        return r

    found, across = [], min(blocks) != max(blocks)
    for i in range(len(nodes)):
        for j in range(i):
            x, y = sets[i], sets[j]
            if (blocks[i] == blocks[j]) == across or min(len(x), len(y)) < least * max(len(x), len(y)):
                continue
            p, q = find(roots[i]), find(roots[j])
            if p != q:
                common = len(np.intersect1d(x, y, assume_unique=True))
                if common >= least * (len(x) + len(y) - common):
                    root[p] = q
                    found.append((nodes[i], nodes[j]))
    return found


def _linked_by_blocks(dense: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Edges (a, b) among the nodes of each key of dense (k, n, node, root)."""
    blocks = F.floor((F.col("n") - 1) / BLOCK_NODES) + 1
    dealt = dense.withColumn("block", F.pmod(F.xxhash64("node"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)))
    dealt = dealt.select("k", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "node", "root").join(sets, "node")

    def run(table: pa.Table) -> pa.Table:
        sets = [np.asarray(h) for h in table.column("hashes").to_pylist()]
        found = block_links(table.column("node").to_pylist(), table.column("block").to_pylist(), table.column("root").to_pylist(), sets, least)
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return dealt.groupBy("k", "p", "q").applyInArrow(run, "a bigint, b bigint")


def near_copies(docs: DataFrame, least: float = 0.8, shingle: int = SHINGLE, seed: int = 42) -> DataFrame:
    """(doc_id, component_id) for every row of docs (doc_id, text, ...).

    Rows are linked whose sets of `shingle`-word shingles have a Jaccard similarity of `least` or more; texts without
    words are linked to each other. component_id is the smallest doc_id reachable, null if there is none. Rows that
    repeat keep their number. Texts of any length are hashed in blocks; the set of one is held whole. Other columns are
    ignored. An empty table gives an empty result."""
    given = docs.select(F.col("doc_id").cast("bigint"), F.xxhash64(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).alias("row"), F.col("text").cast("string"))
    rows = keep(_with_keys(given, shingle, seed))
    nodes = keep(rows.groupBy("node").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"), F.min("row").alias("row"), F.max("size").alias("size"), F.max("fp").alias("fp"), F.any_value("keys").alias("keys")))

    pairs = keep(_met_by_fingerprint(nodes, least))
    sets = keep(_sets_of(pairs.select("a").union(pairs.select("b")).toDF("node"), nodes, given, shingle, seed))
    edges = keep(_alike(pairs, sets, least))
    roots = connected_components(edges)

    # Only rows of keys that are shared move, and of these only keys whose nodes aren't all joined already are tried.
    keyed = nodes.select("node", "size", F.explode("keys").alias("k"))
    shared = keep(keyed.groupBy("k").agg(F.count("*").alias("n")).filter("n > 1"))
    some, _ = split_by_bits(keyed, member_bits(shared, F.col("k")), F.col("k"))
    met = spread_join(some, shared, ["k"], [F.col("node")], "inner").join(roots, "node", "left")
    met = keep(met.select("k", "n", F.struct("node", "size", F.coalesce("root", "node").alias("root")).alias("y")))
    apart = met.groupBy("k").agg(F.min("y.root").alias("low"), F.max("y.root").alias("high")).filter("low < high").select("k")
    met = keep(spread_join(met, apart, ["k"], [F.col("y.node")], "left_semi"))
    few = met.filter(F.col("n") <= PAIRED_NODES).groupBy("k").agg(F.array_sort(F.collect_list("y")).alias("m"))
    few = few.select(F.explode(F.sequence(F.lit(1), F.size("m") - 1)).alias("i"), "m").select(F.element_at("m", F.col("i")).alias("x"), F.explode(F.slice("m", F.col("i") + 1, F.size("m"))).alias("y"))
    dense = met.filter(F.col("n") > PAIRED_NODES)
    stars = spread_join(dense, dense.groupBy("k").agg(F.min("y").alias("x")), ["k"], [F.col("y.node")], "inner").select("x", "y")
    untried = few.unionByName(stars).filter(_near(least) & (F.col("x.root") != F.col("y.root")))
    pairs = keep(untried.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct())
    dense = dense.select("k", "n", "y.node")

    wanted = pairs.select("a").union(pairs.select("b")).union(dense.select("node")).toDF("node").join(sets, "node", "left_anti")
    sets = sets.unionByName(keep(_sets_of(wanted, nodes, given, shingle, seed)))
    edges = edges.unionByName(keep(_alike(pairs, sets, least)))
    roots = connected_components(edges)

    dense = dense.join(roots.withColumnRenamed("node", "node_").withColumnRenamed("root", "root_"), F.col("node") == F.col("node_"), "left").select("k", "n", "node", F.coalesce("root_", "node").alias("root"))
    apart = dense.groupBy("k").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("k")
    dense = keep(dense.join(apart, "k", "left_semi"))
    if not dense.isEmpty():
        roots = connected_components(keep(edges.unionByName(_linked_by_blocks(dense, sets, least))))

    known = nodes.select("node", "first", "n").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    joined = known.filter("root <> node").select("root").distinct().withColumn("linked", F.lit(True))
    known = keep(known.join(joined, "root", "left").filter("linked or n > 1"))
    components = known.join(known.groupBy("root").agg(F.min("first").alias("component")), "root").select("node", "component")
    out = spread_join(rows.select("doc_id", "node"), components, ["node"], [F.col("doc_id")])
    return out.select("doc_id", F.coalesce("component", "doc_id").alias("component_id"))
