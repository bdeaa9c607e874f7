"""Nearest vectors of many queries, exact. Vectors are dealt to cells by the nearest of some pivots; how far a cell's
members are from its pivot at most bounds what any query can score there. A query first meets the cell with the highest
bound, which gives it a score to beat, and then the cells whose bounds reach that score: the rest is not looked at.

Cells are put together to blocks, and large ones cut; a block of rows meets a block of queries by matrix products, cell
by cell, so no task holds more than a block of each, however many meet, and each gives a query's best of its block only.
There are no more cells than pivots: what is said of each of them fits everywhere."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..sources.shared import kept

#: Pivots, and vectors and queries of a block. A block's scores are made so many queries at a time.
PIVOTS, ROWS, QUERIES, AT_ONCE = 256, 8192, 4096, 256
#: What bounds may be off by where numbers are rounded.
SLACK = 1e-9


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    whole = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    return whole.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(whole), -1) if len(whole) else np.zeros((0, 0))


def _angles(m: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return np.arccos(np.clip(np.divide(m, norms, out=np.zeros_like(m), where=norms > 0) @ pivots.T, -1, 1))


def _pivots(vectors: DataFrame, n: int) -> np.ndarray:
    """Directions of n vectors, by a hash: a bounded sample, which only decides what is searched first."""
    some = vectors.select("embedding", F.xxhash64("embedding").alias("h")).orderBy("h").limit(n).collect()
    if not some:
        return np.zeros((0, 0))
    m = np.array([r.embedding for r in some], np.float64)
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return np.unique(m[norms[:, 0] > 0] / norms[norms[:, 0] > 0], axis=0)


def in_cells(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(id, embedding, cell, angle, norm, ...) of vectors (id, embedding, ...)."""
    columns = vectors.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _matrix(batch.column("embedding"))
            if len(m):
                angles = _angles(m, pivots)
                cell = angles.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(angles[np.arange(len(m)), cell]), pa.array(np.linalg.norm(m, axis=1))], [*columns, "cell", "angle", "norm"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema)
    return vectors.mapInArrow(run, f"{kinds}, cell int, angle double, norm double")


def _bounded(queries: DataFrame, pivots: np.ndarray, cells: np.ndarray) -> DataFrame:
    """(query_id, query, cell, bound): what each query can score in each cell at most. cells: cell, radius, least and
    greatest norm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _matrix(batch.column("query"))
            if len(m):
                number, radius, low, high = cells
                nearest = np.cos(np.maximum(0, _angles(m, pivots[number.astype(int)]) - radius - SLACK))
                bound = np.linalg.norm(m, axis=1, keepdims=True) * np.where(nearest > 0, high, low) * nearest + SLACK
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * len(number)), pa.array(bound.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("query"), flat], ["query_id", "query", "bounds"])

    kind = {f.name: f.dataType.simpleString() for f in queries.schema}
    each = queries.select("query_id", "query").mapInArrow(run, f"query_id {kind['query_id']}, query {kind['query']}, bounds array<double>")
    numbers = F.array(*(F.lit(int(c)) for c in cells[0]))
    return each.select("query_id", "query", F.inline(F.arrays_zip(numbers.alias("cell"), F.col("bounds").alias("bound"))))


def _blocks(spark: SparkSession, cells: list) -> DataFrame:
    """(cell, block, rs): cells put together to blocks of ROWS rows or so, and how many parts a block is cut into."""
    out, block, rows = [], 0, 0
    for c in cells:
        if rows and rows + c.rows > ROWS:
            block, rows = block + 1, 0
        rows += c.rows
        out.append((c.cell, block, rows))
    parts = {block: -(-rows // ROWS) for _, block, rows in out}
    return spark.createDataFrame([(cell, block, parts[block]) for cell, block, _ in out], "cell int, block int, rs int")


def _met(vectors: DataFrame, queries: DataFrame, blocks: DataFrame, least: float, top: int | None, group: str | None) -> DataFrame:
    """The best of each block: of vectors (id, embedding, cell) for queries (query_id, query, cell), those that score
    `least` or more, the first `top` of each query, or of a group of vectors the first. Only cells are looked at that a
    query has."""
    blocks = F.broadcast(blocks)  # no more rows than there are pivots
    asked = queries.join(blocks, "cell").groupBy("query_id", "query", "block", "rs").agg(F.array_sort(F.collect_set("cell")).alias("cells"))
    asked = kept(asked)
    counts = asked.groupBy("block").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("qs"))
    dealt = lambda df, by, own, n, other, m: df.withColumn(own, F.pmod(F.xxhash64(by), F.col(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(m) - 1)))
    here = vectors.join(blocks, "cell").join(F.broadcast(counts), "block")
    left = dealt(here, "id", "r", "rs", "q", "qs").select("block", "r", "q", "cell", "id", "embedding", *([group] if group else []))
    right = dealt(asked.join(F.broadcast(counts), "block"), "query_id", "q", "qs", "r", "rs").select("block", "r", "q", "query_id", "query", "cells")
    at_once = AT_ONCE

    def scored(rows: pa.Table, m: np.ndarray, some: pa.Table) -> np.ndarray:
        """Scores of some queries with all rows, where a query has the row's cell, and else less than any."""
        q, cell = _matrix(some.column("query")), rows.column("cell").to_numpy()
        lists = pa.concat_arrays(some.column("cells").chunks)
        owner, wanted = np.repeat(np.arange(len(q)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()
        s = np.full((len(q), len(m)), -np.inf)
        for c in np.unique(wanted):
            at, of = np.flatnonzero(cell == c), owner[wanted == c]
            s[np.ix_(of, at)] = np.clip(q[of] @ m[at].T, -1, 1)
        return s

    def score(rows: pa.Table, asked: pa.Table) -> pa.Table:
        out: dict[str, list] = {n: [] for n in names}
        if rows.num_rows and asked.num_rows:
            rows = rows.take(np.argsort(rows.column("id").to_numpy(), kind="stable"))
            ids, m, asks = rows.column("id").to_numpy(), _matrix(rows.column("embedding")), asked.column("query_id").to_numpy()
            codes = rows.column(group).combine_chunks().dictionary_encode() if group else None
            for start in range(0, len(asks), at_once):
                s = scored(rows, m, asked.slice(start, at_once))
                if group:
                    places = codes.indices.fill_null(len(codes.dictionary)).to_numpy(zero_copy_only=False)
                    for code in np.unique(places):
                        best = s[:, places == code].max(axis=1)
                        hit = np.flatnonzero(best >= least)
                        out["query_id"].append(asks[start + hit])
                        out["confidence"].append(best[hit])
                        out[group].append(np.full(len(hit), codes.dictionary[int(code)].as_py() if code < len(codes.dictionary) else None, dtype=object))
                    continue
                floor = np.full(len(s), least)
                if s.shape[1] > top:
                    floor = np.maximum(floor, np.partition(s, s.shape[1] - top, axis=1)[:, s.shape[1] - top])
                r, c = np.nonzero(s >= floor[:, None])
                o = np.lexsort((c, -s[r, c], r))
                r, c = r[o], c[o]
                first = np.arange(len(r)) - np.searchsorted(r, r) < top
                out["query_id"].append(asks[start + r[first]])
                out["id"].append(ids[c[first]])
                out["confidence"].append(s[r[first], c[first]])
        return pa.table({n: pa.array(np.concatenate(v) if v else [], kind) for (n, v), kind in zip(out.items(), kinds, strict=True)})

    of = {"query_id": queries.schema["query_id"].dataType, "id": vectors.schema["id"].dataType, **({group: vectors.schema[group].dataType} if group else {})}
    names = ["query_id", group if group else "id", "confidence"]
    kinds = [to_arrow_type(of[names[0]]), to_arrow_type(of[names[1]]), pa.float64()]
    ddl = f"query_id {of[names[0]].simpleString()}, `{names[1]}` {of[names[1]].simpleString()}, confidence double"
    return left.groupBy("block", "r", "q").cogroup(right.groupBy("block", "r", "q")).applyInArrow(score, ddl)


def _first(scored: DataFrame, top: int) -> DataFrame:
    k = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("confidence"), "id"))
    return scored.withColumn("k", k).filter(F.col("k") <= top).drop("k")


def similar_each(vectors: DataFrame, queries: DataFrame, least: float, top: int | None = None, group: str | None = None, pivots: int = PIVOTS, told: dict | None = None) -> DataFrame:
    """(query_id, id, confidence): of each of queries (query_id, query) the first `top` of vectors (id, embedding) by
    inner product, clipped to 1, and number, that reach `least`. With group, a column of vectors, (query_id, group,
    confidence): of each group the best that reaches it. Vectors and queries that are null are left out.

    told: gets pairs, all pairs of a query and a vector, and computed, those whose product was taken."""
    vectors, queries = vectors.filter("embedding is not null"), queries.filter("query is not null")
    directions = _pivots(vectors, pivots)
    if not len(directions):
        if vectors.isEmpty():
            return queries.select("query_id").limit(0).crossJoin(vectors.select(group or "id").limit(0)).withColumn("confidence", F.lit(0.0))
        directions = np.eye(1, len(vectors.first().embedding))
    celled = kept(in_cells(vectors, directions))
    cells = celled.groupBy("cell").agg(F.count("*").alias("rows"), F.max("angle").alias("radius"), F.min("norm").alias("low"), F.max("norm").alias("high"))
    cells = kept(cells.coalesce(1))
    each = cells.orderBy("cell").collect()
    numbers = np.array([[c.cell, c.radius, c.low, c.high] for c in each]).T
    asked = kept(_bounded(queries, directions, numbers))
    rows_of, blocks = cells.select("cell", "rows"), kept(_blocks(vectors.sparkSession, each))
    if group:
        near = kept(asked.filter(F.col("bound") >= least))
        scored = _met(celled, near, blocks, least, top, group).groupBy("query_id", group).agg(F.max("confidence").alias("confidence"))
    else:
        best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "cell"))
        ranked = asked.withColumn("k", best).filter(F.col("k") == 1).drop("k")
        early = kept(_met(celled, ranked.filter(F.col("bound") >= least), blocks, least, top, None))
        # The score to beat: that of the last place, where all places are taken.
        floors = _first(early, top).groupBy("query_id").agg(F.count("*").alias("n"), F.min("confidence").alias("floor")).filter(F.col("n") == top).drop("n")
        left = asked.join(ranked.select("query_id", "cell"), ["query_id", "cell"], "left_anti").join(floors, "query_id", "left")
        near = kept(left.filter((F.col("bound") >= least) & (F.col("bound") >= F.coalesce("floor", F.lit(least)))).drop("floor"))
        scored = _first(early.unionByName(_met(celled, near, blocks, least, top, None)), top)
        near = near.unionByName(ranked.filter(F.col("bound") >= least))
    if told is not None:
        told["pairs"] = sum(c.rows for c in each) * queries.count()
        told["computed"] = near.join(rows_of, "cell").agg(F.sum("rows")).first()[0] or 0
    return scored
