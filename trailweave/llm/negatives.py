"""Hard negatives: for an anchor and each of its best positives, the best rows of other labels within a window of scores.

Scores are inner products of integers, exact. Rows are dealt to blocks and stay where they are; every task reads the
anchors, a hundredth of the rows, tile by tile from the shared folder, and multiplies tiles by Strassen's method. What
leaves a task is a heap for each anchor, the best few of the block: heaps of positives are merged by rank over all
blocks, and their scores set the windows for the heaps of negatives, merged in the same way. A task holds one block and
one tile of scores, whatever the tables' size."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import new_path
from .common import file_system, keep

#: Rows of a block, values in it at most, and anchors and rows of a tile.
BLOCK_ROWS, BLOCK_VALUES = 32_768, 1 << 22
TILE_ANCHORS, TILE_ROWS = 512, 4096
#: Matrices that have a side of no more are multiplied as they are.
LEAF = 16
#: Rows whose squared length is greater take no part: a hundred times their scores might not be a bigint.
MOST_SQUARE = float(1 << 56)
#: Less than any score: no entry of a heap.
NONE = np.iinfo(np.int64).min


@dataclass(frozen=True)
class Rules:
    """How many positives and negatives are sought, and between which hundredths of a positive's score a negative's
    score has to be."""

    positives: int = 5
    negatives: int = 10
    low: int = 30
    high: int = 90


# Multiplication ------------------------------------------------------------------------------------------------------


def _even(m: np.ndarray) -> np.ndarray:
    """m with a row and a column of zeros where it has an odd number of them."""
    return np.pad(m, ((0, m.shape[0] % 2), (0, m.shape[1] % 2))) if m.shape[0] % 2 or m.shape[1] % 2 else m


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b of int64 matrices: seven products of quarters in place of eight, down to narrow ones. Sums of integers are
    exact, also where one on the way overflows, as long as the result doesn't."""
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= LEAF:
        return a @ b
    a, b = _even(a), _even(b)
    h, i, w = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:h, :i], a[:h, i:], a[h:, :i], a[h:, i:]
    b11, b12, b21, b22 = b[:i, :w], b[:i, w:], b[i:, :w], b[i:, w:]
    out = np.empty((2 * h, 2 * w), np.int64)
    c11, c12, c21, c22 = out[:h, :w], out[:h, w:], out[h:, :w], out[h:, w:]
    # Each of the seven is added where it belongs as soon as it is there: one is held at a time.
    x = product(a11 + a22, b11 + b22)
    c11[:], c22[:] = x, x
    x = product(a21 + a22, b11)
    c21[:] = x
    c22 -= x
    x = product(a11, b12 - b22)
    c12[:] = x
    c22 += x
    x = product(a22, b21 - b11)
    c11 += x
    c21 += x
    x = product(a11 + a12, b22)
    c11 -= x
    c12 += x
    c22 += product(a21 - a11, b11 + b12)
    c11 += product(a12 - a22, b21 + b22)
    return out[:m, :n]


# Heaps ---------------------------------------------------------------------------------------------------------------


def first_of_each(owner: np.ndarray, score: np.ndarray, number: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k entries of each owner by falling score, then by rising number; by owner and rank."""
    order = np.lexsort((number, -score, owner))
    sorted_owner = owner[order]
    rank = np.arange(len(order)) - np.searchsorted(sorted_owner, sorted_owner)
    return order[rank < k]


def heaps(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the first k entries of each row, by falling score and then by column, of those above NONE."""
    if scores.shape[1] > k:
        least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        r, c = np.nonzero((scores >= least[:, None]) & (scores > NONE))
    else:
        r, c = np.nonzero(scores > NONE)
    some = first_of_each(r, scores[r, c], c, k)
    return r[some], c[some]


# Tiles ---------------------------------------------------------------------------------------------------------------


def matrix(vectors: pa.Array) -> np.ndarray:
    """Lists of integers as the rows of a matrix; shorter ones end in zeros."""
    values, ends = vectors.flatten().to_numpy(zero_copy_only=False), np.diff(vectors.offsets.to_numpy())
    width = int(ends.max(initial=0))
    if (ends == width).all():
        return values.reshape(len(ends), width)
    out = np.zeros((len(ends), width), values.dtype)
    out[np.arange(width) < ends[:, None]] = values
    return out


def _stacked(some: list[np.ndarray]) -> np.ndarray:
    width = max(m.shape[1] for m in some)
    return np.concatenate([np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in some])


@dataclass
class Tile:
    """Rows by rising number: ids, labels, vectors as a matrix, and other columns by name."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    rest: dict[str, list]

    @staticmethod
    def of(batches: list[pa.RecordBatch]) -> Tile:
        column = lambda name: np.concatenate([b.column(name).to_numpy(zero_copy_only=False) for b in batches])
        ids, labels, vectors = column("vec_id"), column("label"), _stacked([matrix(b.column("q")) for b in batches])
        rest = {n: [x for b in batches for x in b.column(n).to_pylist()] for n in batches[0].schema.names if n not in ("vec_id", "label", "q")}
        return Tile(ids, labels, vectors, rest)

    def distinct(self) -> Tile:
        """By rising number; of rows that repeat one another, one."""
        order = np.lexsort((*self.vectors.T[::-1], self.labels, self.ids)) if len(np.unique(self.ids)) < len(self.ids) else np.argsort(self.ids)
        ids, labels, vectors = self.ids[order], self.labels[order], self.vectors[order]
        new = np.ones(len(ids), bool)
        new[1:] = (ids[1:] != ids[:-1]) | (labels[1:] != labels[:-1])
        same = np.flatnonzero(~new)
        new[same] = (vectors[same] != vectors[same - 1]).any(axis=1)
        return Tile(ids[new], labels[new], vectors[new], {})

    def cut(self, start: int, rows: int) -> Tile:
        end = start + rows
        return Tile(self.ids[start:end], self.labels[start:end], self.vectors[start:end], {})

    def scores(self, other: Tile, own: np.ndarray | slice = slice(None), others: np.ndarray | slice = slice(None)) -> np.ndarray:
        a, b = self.vectors[own], other.vectors[others]
        width = min(a.shape[1], b.shape[1])
        return product(a[:, :width].astype(np.int64), b[:, :width].astype(np.int64).T)


def _gathered(batches: Iterator[pa.RecordBatch], rows: int, values: int) -> Iterator[Tile]:
    """Tiles of `rows` rows and `values` values at most, but of one row at least."""
    held, n, size = [], 0, 0
    for batch in batches:
        start = 0
        while start < batch.num_rows:
            mean = max(1, len(batch.column("q").flatten()) // batch.num_rows)
            some = batch.slice(start, max(1, min(rows - n, (values - size) // mean)))
            held, n, size, start = [*held, some], n + some.num_rows, size + some.num_rows * mean, start + some.num_rows
            if n >= rows or size + mean > values:
                yield Tile.of(held)
                held, n, size = [], 0, 0
    if held:
        yield Tile.of(held)


def _read(path: str) -> Iterator[pa.RecordBatch]:
    """What Spark wrote to a path of the shared folder as Parquet."""
    fs, folder = file_system(path)
    for info in sorted(fs.get_file_info(pafs.FileSelector(folder)), key=lambda i: i.path):
        if info.path.endswith(".parquet"):
            with fs.open_input_file(info.path) as f:
                yield from pq.ParquetFile(f).iter_batches(batch_size=TILE_ANCHORS)


def _positives(anchors: Tile, rows: Tile, rules: Rules) -> Iterator[tuple]:
    """Of each anchor in a tile of rows: (anchor's place, row's place, score) of its heap of positives."""
    for label in np.unique(anchors.labels):
        own, others = np.flatnonzero(anchors.labels == label), np.flatnonzero(rows.labels == label)
        if len(others):
            scores = anchors.scores(rows, own, others)
            scores[anchors.ids[own][:, None] == rows.ids[others]] = NONE
            r, c = heaps(scores, rules.positives)
            yield own[r], others[c], scores[r, c]


def _negatives(anchors: Tile, rows: Tile, rules: Rules) -> Iterator[tuple]:
    """Of each anchor and positive: (place of anchor and positive, as one number, row's place, score) of its heap of
    negatives in the positive's window."""
    scores = anchors.scores(rows)
    differs = anchors.labels[:, None] != rows.labels
    width = rules.positives
    for j in range(width):
        of = np.array([p[j] if j < len(p) else -1 for p in anchors.rest["scores"]], np.int64)[:, None]
        # A window is empty where the positive's score is below zero.
        inside = differs & (100 * scores >= rules.low * of) & (100 * scores <= rules.high * of) & (of >= 0)
        if inside.any():
            r, c = heaps(np.where(inside, scores, NONE), rules.negatives)
            yield r * width + j, c, scores[r, c]


def _mined(rows: DataFrame, path: str, seek, most: int, finish, schema: str, rules: Rules) -> DataFrame:
    """All blocks of rows against all anchors at path: what finish makes of the merged heaps of a block."""
    block_rows, block_values, tile_rows, tile_anchors = BLOCK_ROWS, BLOCK_VALUES, TILE_ROWS, TILE_ANCHORS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _gathered(batches, block_rows, block_values):
            block = block.distinct()
            for anchors in _gathered(_read(path), tile_anchors, block_values):
                found = []
                for start in range(0, len(block.ids), tile_rows):
                    found += [(owner, at + start, score) for owner, at, score in seek(anchors, block.cut(start, tile_rows), rules)]
                if found:
                    owner, at, score = (np.concatenate(x) for x in zip(*found, strict=True))
                    best = first_of_each(owner, score, at, most)
                    yield pa.RecordBatch.from_pydict(finish(anchors, owner[best], block.ids[at[best]], score[best]))

    return rows.mapInArrow(run, schema)


def _of(values: list, places: np.ndarray) -> list:
    return [values[i] for i in places]


def mine(rows: DataFrame, is_anchor: Column, rules: Rules | None = None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of rows (vec_id, label, q).

    q holds integers; shorter vectors count as ending in zeros. Anchors are the rows for which is_anchor holds. Rows
    that repeat one another count once; of two rows with one vec_id neither is the other's positive."""
    rules, spark = rules or Rules(), rows.sparkSession
    given = keep(rows.select(F.col("vec_id").cast("bigint"), F.col("label").cast("bigint"), F.col("q").cast("array<int>")))
    # As many tasks as there are cores at least: the work grows with the square of what is read.
    blocks = max(-(-given.count() // BLOCK_ROWS), spark.sparkContext.defaultParallelism)
    dealt = keep(given.repartition(blocks))
    copy = F.row_number().over(Window.partitionBy("vec_id").orderBy("label", "q")).alias("copy")
    anchors = given.filter(is_anchor).distinct().select("*", copy)
    first, second = new_path(spark, "anchors"), new_path(spark, "anchors")
    anchors.write.parquet(first)

    def positive(tile: Tile, owner: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> dict:
        return {"vec_id": tile.ids[owner], "copy": pa.array(_of(tile.rest["copy"], owner), pa.int32()), "id": ids, "score": scores}

    key = ["vec_id", "copy"]
    found = _mined(dealt, first, _positives, rules.positives, positive, "vec_id bigint, copy int, id bigint, score bigint", rules).distinct()
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("score"), "id"))
    best = found.withColumn("k", rank).filter(F.col("k") <= rules.positives)
    lists = best.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("k", "id", "score"))).alias("p")).select(*key, F.col("p.id").alias("positives"), F.col("p.score").alias("scores"))
    spark.read.schema(anchors.schema).parquet(first).join(lists, key).write.parquet(second)

    def negative(tile: Tile, owner: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> dict:
        at, j = np.divmod(owner, rules.positives)
        of = lambda name: [tile.rest[name][a][b] for a, b in zip(at, j, strict=True)]
        return {"anchor_id": tile.ids[at], "copy": pa.array(_of(tile.rest["copy"], at), pa.int32()), "positive_id": of("positives"), "positive_score": of("scores"), "negative_id": ids, "negative_score": scores}

    out = _mined(dealt, second, _negatives, rules.negatives, negative, "anchor_id bigint, copy int, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint", rules).distinct()
    rank = F.row_number().over(Window.partitionBy("anchor_id", "copy", "positive_id", "positive_score").orderBy(F.desc("negative_score"), "negative_id"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= rules.negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def quantised(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, q) of vectors (vec_id, embedding, label): q is 256 times the components, rounded down.

    Rows without vec_id, label or vector, with a component that is null or not finite, or so long that a hundred times
    a score might not be a bigint (256 million times the unit) take no part. Where vec_id is divisible by 7, the label
    is the next of ten."""
    scaled = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor(256 * x))
    finite = F.forall(F.col("embedding").cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e9))
    square = F.aggregate("q", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    label = F.col("label").cast("bigint")
    whole = vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
    flipped = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return whole.select("vec_id", flipped.alias("label"), scaled.alias("q")).filter(square <= MOST_SQUARE)


def report(vectors: DataFrame) -> DataFrame:
    """mine() for the anchors whose vec_id is divisible by 100, among all vectors (vec_id, embedding, label, ...)."""
    return mine(quantised(vectors), F.col("vec_id") % 100 == 0)


ORACLE = """with given as (
  select distinct vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as q
  from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
scored as (
  select a.vec_id as anchor_id, a.label as own, b.vec_id as id, b.label, list_dot_product(a.q::double[], b.q::double[])::bigint as score
  from given a, given b where a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
positives as (select anchor_id, id as positive_id, score as positive_score from scored where own = label qualify row_number() over (partition by anchor_id order by score desc, id) <= 5),
negatives as (
  select p.*, s.id as negative_id, s.score as negative_score, row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.id) as rank
  from positives p join scored s on s.anchor_id = p.anchor_id and s.own <> s.label and 30 * positive_score <= 100 * s.score and 100 * s.score <= 90 * positive_score)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from negatives where rank <= 10"""
