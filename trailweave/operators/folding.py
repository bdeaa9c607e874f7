"""Weights of pairs over long logs: the windows of learning.windows() and the fold over each pair's impulses, for rows that
stream through tasks in order.

Sessions are sorted and their windows kept by a list of recent vertices; accesses with their windows are then dealt by
ranges of time. A stretch of a range has one row a pair, its impulses in order, a few bytes each; stretches of a pair
follow one another in its fold, which steps through many pairs at once. No task holds more than a stretch, or the
weights of a bucket of pairs, and no impulse is a row of its own. Vertices are hashes on the way: 63 bits, of which no two
are equal, and one that says whether the access was an error."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..sources.shared import kept

#: Accesses of a session that one task goes through; longer ones are cut into blocks of so many.
LONG, BLOCK = 1 << 20, 1 << 18
#: Impulses of a stretch, of which as many are folded at once, pairs of a bucket, and accesses of a batch with their windows.
STRETCH, BUCKET, ACCESSES = 500_000, 4096, 8192
#: Below so many pairs a step is taken pair by pair.
LANES = 24
_NEVER = -(2**63)


def code(vertex: Column, type_: Column, seed: int) -> Column:
    """A vertex, 0 for none, and whether it's an error."""
    name = F.when(vertex.isNull(), F.lit(0).cast("bigint")).otherwise(F.xxhash64(vertex, F.lit(seed)).bitwiseAND(F.lit(-2)))
    return name.bitwiseOR(F.coalesce((type_ == "error").cast("bigint"), F.lit(0)))


def names(vertices: DataFrame) -> tuple[DataFrame, int]:
    """(code, vertex) of vertices (vertex), and the seed by which no two have the same code."""
    distinct = kept(vertices.select("vertex").distinct().filter("vertex is not null"))
    for seed in range(16):
        coded = distinct.select(code(F.col("vertex"), F.lit(None).cast("string"), seed).alias("code"), "vertex")
        if coded.groupBy("code").agg(F.count("*").alias("n")).filter("n > 1 or code = 0").isEmpty():
            return coded, seed
    raise AssertionError


def _ints(column: pa.Array) -> np.ndarray:
    """Numbers or times as integers; what has none is before all others."""
    return column.cast(pa.int64()).fill_null(_NEVER).to_numpy(zero_copy_only=False)


def _changes(batch: pa.RecordBatch, keys: list[str], last: list) -> tuple[np.ndarray, list]:
    """Whether each row has other keys than the one before; last: the keys before the batch."""
    new = np.zeros(len(batch), bool)
    for k in keys:
        of = batch.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= of[1:] != of[:-1]
    new[0] = [batch.column(k)[0].as_py() for k in keys] != last
    return new, [batch.column(k)[-1].as_py() for k in keys]


def _in_sessions(size: int, cuts: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of rows (session_id, block, at, id, code, own) in order those that are own, with the codes of the `size` latest
    distinct vertices before them, and how many cuts aren't after them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        window, last = {}, []
        for whole in batches:
            for batch in (whole.slice(i, ACCESSES) for i in range(0, len(whole), ACCESSES)):
                new, last = _changes(batch, ["session_id", "block"], last)
                own = batch.column("own").to_numpy(zero_copy_only=False)
                recent, ends = [], [0]
                for fresh, mine, me in zip(new.tolist(), own.tolist(), batch.column("code").to_pylist()):
                    if fresh:
                        window = {}
                    if mine:
                        recent.extend(window.values())
                        ends.append(len(recent))
                    window.pop(me >> 1, None)
                    window[me >> 1] = me
                    if len(window) > size:
                        del window[next(iter(window))]
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.array(recent, np.int64)))
                mine = batch.filter(pa.array(own))
                part = np.searchsorted(np.array(cuts, np.int64), _ints(mine.column("at")), side="right").astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(part), mine.column("at"), mine.column("id"), mine.column("code"), lists], ["part", "at", "id", "code", "recent"])

    return run


def _in_blocks(long: DataFrame, size: int) -> DataFrame:
    """Rows of long sessions in blocks, and again, not as own, those that are recent before a block; ord: their order."""
    from . import learning

    placed = kept(learning.ordinals(long).withColumn("block", F.floor((F.col("ord") - 1) / BLOCK)))
    before = learning._recent_before(placed, size, BLOCK)
    carried = before.select("session_id", "block", F.col("then").alias("ord"), F.col("recent").alias("vertex"), F.col("recent_type").alias("type"), F.lit(False).alias("own"))
    return placed.select("session_id", "block", "ord", "vertex", "type", "at", "id", "own").unionByName(carried, allowMissingColumns=True)


def windows(log: DataFrame, before: DataFrame | None, seed: int, cuts: list[int], size: int = C.WINDOW) -> DataFrame:
    """(part, at, id, code, recent): accesses, the range of time that they are in, and the codes of what was recent, the
    latest last. before: see learning.windows()."""
    columns = ["session_id", "vertex", "type", "at", "id"]
    given = log.select(*columns, F.lit(True).alias("own"))
    given = given if before is None else given.unionByName(before.select(*columns, F.lit(False).alias("own")))
    # An access without a session has no window and is in none.
    given = given.filter("session_id is not null")
    # As many as the log has times LONG rows at most.
    long = kept(given.groupBy("session_id").agg(F.count("*").alias("n")).filter(F.col("n") > LONG).select(F.col("session_id").alias("_long")))
    some, hit = not long.isEmpty(), F.col("session_id") == F.col("_long")
    one = given.join(long, hit, "left_anti") if some else given
    rows = one.withColumn("block", F.lit(0).cast("bigint")).withColumn("ord", F.lit(0).cast("bigint"))
    rows = rows.unionByName(_in_blocks(given.join(long, hit, "left_semi"), size)) if some else rows
    thin = rows.select("session_id", "block", "ord", "at", "id", code(F.col("vertex"), F.col("type"), seed).alias("code"), "own")
    dealt = thin.repartition("session_id", "block").sortWithinPartitions("session_id", "block", "ord", "at", "id").select("session_id", "block", "at", "id", "code", "own")
    kind = dict(log.select("at", "id").dtypes)
    return dealt.mapInArrow(_in_sessions(size, cuts), f"part int, at {kind['at']}, id {kind['id']}, code bigint, recent array<bigint>")


def cuts_of(log: DataFrame) -> list[int]:
    """Times, in microseconds, that cut a log into about equal ranges, one less than a shuffle has partitions."""
    parts = int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if parts < 2:
        return []
    time = F.unix_micros(F.col("at").cast("timestamp"))
    return sorted(set(log.agg(F.approx_percentile(time, [k / parts for k in range(1, parts)], 10_000)).first()[0] or ()))


def _in_stretches(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of rows of windows() in order one row a pair and stretch: how many impulses, when it fired last, its first impulse,
    and of each where in the stretch its access is, as steps, and its place in how long a window, as a number."""

    def told(part: int, number: int, batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        at, id_, me = (np.concatenate([_ints(b.column(c)) for b in batches]) for c in ("at", "id", "code"))
        sizes = np.concatenate([np.diff(b.column("recent").offsets.to_numpy()) for b in batches])
        recent = np.concatenate([b.column("recent").flatten().to_numpy(zero_copy_only=False) for b in batches])
        access = np.repeat(np.arange(len(me), dtype=np.int32), sizes)
        pos = np.arange(len(recent), dtype=np.int64) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1
        mine, other = me[access] & -2, recent & -2
        value = (pos * (size + 1) + sizes[access]) * 2 + ((me[access] | recent) & 1)
        fires = (mine != other) & (mine != 0) & (other != 0)
        mine, other, access, pos, value = mine[fires], other[fires], access[fires], pos[fires], value[fires]
        ends, names = pd.factorize(np.concatenate([mine, other]))
        ends = ends.reshape(2, -1)
        swap = names[ends[0]] > names[ends[1]]
        pair, pairs = pd.factorize(np.where(swap, ends[1], ends[0]).astype(np.int64) * max(1, len(names)) + np.where(swap, ends[0], ends[1]))
        order = np.argsort(pair.astype(np.uint16) if len(pairs) < 65536 else pair, kind="stable")
        counts = np.bincount(pair, minlength=len(pairs))
        starts = np.cumsum(counts) - counts
        access, pos, value = access[order], pos[order], value[order].astype("<i4")
        first, last = access[starts], access[starts + counts - 1]
        steps = np.diff(access, prepend=access[:1]).astype("<i4")
        steps[starts] = first
        bounds = np.append(starts, len(access)).astype(np.int32)
        cut = lambda x: pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(bounds * np.int32(x.itemsize)), pa.py_buffer(x)])
        back = lambda x, c: pa.array(x, pa.int64(), mask=x == _NEVER).cast(batches[0].schema.field(c).type)
        same = lambda x: pa.array(np.full(len(counts), x, np.int64))
        said = {
            "lo": pa.array(names[pairs // max(1, len(names))]), "hi": pa.array(names[pairs % max(1, len(names))]), "part": same(part), "stretch": same(number),
            "n": pa.array(counts.astype(np.int64)), "last": back(at[last], "at"), "at": back(at[first], "at"), "id": back(id_[first], "id"),
            "pos": pa.array(pos[starts]), "access": pa.array(first.astype(np.int64)), "steps": cut(steps), "given": cut(value.astype("<i2") if 2 * (size + 1) ** 2 < 32768 else value),
        }
        return pa.RecordBatch.from_arrays([*said.values()], [*said])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, of, number, n = [], None, 0, 0
        for whole in batches:
            parts = _ints(whole.column("part"))
            cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)]
            for lo, hi in zip(cuts, cuts[1:]):
                for i in range(lo, hi, ACCESSES):
                    if held and (n >= STRETCH or parts[i] != of):
                        yield told(of, number, held)
                        held, n, number = [], 0, number + 1 if parts[i] == of else 0
                    of = int(parts[i])
                    held.append(whole.slice(i, min(ACCESSES, hi - i)))
                    n += len(held[-1].column("recent").flatten())
        if held:
            yield told(of, number, held)

    return run


def gathered(accesses: DataFrame, cuts: list[int], size: int = C.WINDOW) -> DataFrame:
    """Rows of pairs of codes lo < hi by range of time (part) and stretch of a range. Written, and read again."""
    kind = dict(accesses.dtypes)
    dealt = accesses.repartitionById(len(cuts) + 1, "part").sortWithinPartitions("part", "at", "id")
    return kept(dealt.mapInArrow(_in_stretches(size), f"lo bigint, hi bigint, part bigint, stretch bigint, n bigint, last {kind['at']}, at {kind['at']}, id {kind['id']}, pos bigint, access bigint, steps binary, given binary"))


def _stepped(w: np.ndarray, d: np.ndarray, snapping: bool) -> np.ndarray:
    """scalars.strengthen(), or without snapping scalars.saturating_add()."""
    if snapping:
        d = d * (1 / (1 + np.exp(C.SNAP_STEEPNESS * (w - C.SNAP_MIDPOINT))))
    return np.minimum(w + d * (1 - w), 1.0)


def _through(w: np.ndarray, d: np.ndarray, starts: np.ndarray, counts: np.ndarray, snapping: bool) -> np.ndarray:
    """Weights w after `counts` impulses each, which are in d from `starts` on: a step of all that have one more at once."""
    order = np.argsort(-counts, kind="stable")
    w, starts, counts = w[order], starts[order], counts[order]
    least = counts[LANES - 1] if len(counts) >= LANES else 0
    more = np.searchsorted(-counts, -np.arange(least), side="left")
    for t, k in enumerate(more.tolist()):
        w[:k] = _stepped(w[:k], d[starts[:k] + t], snapping)
    for i in np.flatnonzero(counts > least).tolist():
        x = float(w[i])
        for y in d[starts[i] + least : starts[i] + counts[i]].tolist():
            x = min(x + (y * (1 / (1 + math.exp(C.SNAP_STEEPNESS * (x - C.SNAP_MIDPOINT)))) if snapping else y) * (1 - x), 1.0)
        w[i] = x
    back = np.empty_like(w)
    back[order] = w
    return back


def _in_buckets(size: int, snapping: bool, captured: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(lo, hi, weight) of rows in order of bucket and time: of each pair first what is known of it (part -1), then its
    stretches."""
    v = np.arange(2 * (size + 1) ** 2)
    rate = np.where(v & 1, C.LEARNING_RATE * C.ERROR_BOOST, C.LEARNING_RATE)
    each = rate * (v // 2 // (size + 1)) / np.maximum(1, v // 2 % (size + 1))
    kind = "<i2" if len(v) < 32768 else "<i4"

    class Bucket:
        def __init__(self):
            self.at, self.w, self.hub = {}, np.zeros(0), np.zeros((4, 0), np.int64)

        def known(self, rows: pa.RecordBatch) -> None:
            for key in zip(rows.column("lo").to_pylist(), rows.column("hi").to_pylist()):
                self.at[key] = len(self.at)
            self.w = np.append(self.w, rows.column("before").cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False))
            self.hub = np.hstack([self.hub, [rows.column(c).fill_null(2**62).to_numpy(zero_copy_only=False) for c in ("hub_part", "hub_stretch", "hub_access", "hub_pos")]])

        def fired(self, rows: pa.RecordBatch) -> None:
            row = np.array([self.at[key] for key in zip(rows.column("lo").to_pylist(), rows.column("hi").to_pylist())])
            order = np.argsort(row, kind="stable")
            row, rows = row[order], rows.take(pa.array(order))
            given, steps = (rows.column(c).to_pylist() for c in ("given", "steps"))
            counts = np.array([len(x) for x in steps]) // 4
            starts = np.cumsum(counts) - counts
            value = np.frombuffer(b"".join(given), kind)
            d = each[value]
            part, stretch = (rows.column(c).to_numpy() for c in ("part", "stretch"))
            hub_part, hub_stretch, hub_access, hub_pos = self.hub[:, row]
            after = (part > hub_part) | ((part == hub_part) & (stretch > hub_stretch))
            d *= np.repeat(np.where(after, C.HUB_FACTOR, 1.0), counts)
            for i in np.flatnonzero((part == hub_part) & (stretch == hub_stretch)).tolist():
                here = slice(starts[i], starts[i] + counts[i])
                access, pos = np.cumsum(np.frombuffer(steps[i], "<i4")), value[here] // 2 // (size + 1)
                d[here] *= np.where((access > hub_access[i]) | ((access == hub_access[i]) & (pos > hub_pos[i])), C.HUB_FACTOR, 1.0)
            pairs, begin = np.unique(row, return_index=True)
            start, n = starts[begin], np.add.reduceat(counts, begin)
            w = self.w[pairs]
            # The first impulse of a pair makes its edge.
            new = np.isnan(w)
            made = _stepped(np.zeros(new.sum()), d[start[new]], snapping)
            w[new] = np.maximum(C.CAPTURE_WEIGHT, made) if captured else made
            self.w[pairs] = _through(w, d, start + new, n - new, snapping)

        def done(self) -> Iterator[pa.RecordBatch]:
            if self.at:
                lo, hi = zip(*self.at)
                yield pa.RecordBatch.from_arrays([pa.array(lo, pa.int64()), pa.array(hi, pa.int64()), pa.array(self.w)], ["lo", "hi", "weight"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, of = Bucket(), None
        for batch in batches:
            number, told = _ints(batch.column("bucket")), _ints(batch.column("part")) < 0
            full = np.cumsum(pc.binary_length(batch.column("steps")).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)) // (4 * STRETCH)
            cuts = [0, *(np.flatnonzero((np.diff(number) != 0) | np.diff(told) | (np.diff(full) != 0)) + 1).tolist(), len(number)]
            for lo, hi in zip(cuts, cuts[1:]):
                if number[lo] != of:
                    yield from bucket.done()
                    bucket, of = Bucket(), number[lo]
                (bucket.known if told[lo] else bucket.fired)(batch.slice(lo, hi - lo))
        yield from bucket.done()

    return run


def learned(
    log: DataFrame, before: DataFrame | None = None, known: DataFrame | None = None, partners: DataFrame | None = None, vertices: DataFrame | None = None, snapping: bool = True, captured: bool = True, size: int = C.WINDOW
) -> tuple[DataFrame, DataFrame]:
    """(a, b, weight, co_access_count, last_fired) of the pairs that a log fires, and (end, first), the first HUB_DEGREE + 1
    partners of each vertex after it, as in learning.learned_pairs_after(). vertices: those of the log (vertex), if they are
    known. What was a hub before the log is one for all of it."""
    spark, seen = log.sparkSession, log.select("vertex") if vertices is None else vertices
    coded, seed = names(seen if before is None else seen.unionByName(before.select("vertex")))
    cuts = cuts_of(log)
    rows = gathered(windows(log, before, seed, cuts, size), cuts, size)
    place = F.struct("part", "stretch", "access", "pos", "at", "id")
    firsts = rows.groupBy("lo", "hi").agg(F.sum("n").alias("co_access_count"), F.max("last").alias("last_fired"), F.min(place).alias("f"))
    lo, hi = (coded.select(F.col("code").alias(c), F.col("vertex").alias(f"_{c}")) for c in ("lo", "hi"))
    pairs = kept(firsts.join(lo, "lo").join(hi, "hi").select("lo", "hi", F.least("_lo", "_hi").alias("a"), F.greatest("_lo", "_hi").alias("b"), "co_access_count", "last_fired", "f"))

    where = lambda *x: F.struct(*(c.cast("bigint").alias(n) for c, n in zip(x, ("part", "stretch", "access", "pos"))))
    new = pairs if known is None else pairs.join(known.select("a", "b"), ["a", "b"], "left_anti")
    ends = new.select(F.explode(F.array("a", "b")).alias("end"), F.struct("f.at", "f.id", "f.pos").alias("first"), where(*(F.col(f"f.{c}") for c in ("part", "stretch", "access", "pos"))).alias("place"))
    ends = ends if partners is None else ends.unionByName(partners.select("end", "first", where(F.lit(-1), F.lit(0), F.lit(0), F.lit(0)).alias("place")))
    now = kept(ends.withColumn("n", F.row_number().over(Window.partitionBy("end").orderBy("first"))).filter(F.col("n") <= C.HUB_DEGREE + 1))

    hub = now.filter(F.col("n") == C.HUB_DEGREE + 1)
    hub_a, hub_b = (hub.select(F.col("end").alias(c), F.col("place").alias(f"hub_{c}")) for c in ("a", "b"))
    told = pairs.join(hub_a, "a", "left").join(hub_b, "b", "left").withColumn("hub", F.least("hub_a", "hub_b"))
    told = told.withColumn("before", F.lit(None).cast("double")) if known is None else told.join(known.select("a", "b", F.col("weight").alias("before")), ["a", "b"], "left")
    least = F.lit(-1).cast("bigint")
    told = told.select("lo", "hi", least.alias("part"), least.alias("stretch"), "before", *(F.col(f"hub.{c}").alias(f"hub_{c}") for c in ("part", "stretch", "access", "pos")))
    every = told.unionByName(rows.select("lo", "hi", "part", "stretch", "steps", "given"), allowMissingColumns=True)
    tasks = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    tasks = max(tasks, -(-pairs.count() // BUCKET))
    every = every.withColumn("bucket", F.pmod(F.xxhash64("lo", "hi"), F.lit(tasks)).cast("int"))
    folded = every.repartitionById(tasks, "bucket").sortWithinPartitions("bucket", "part", "stretch").mapInArrow(_in_buckets(size, snapping, captured), "lo bigint, hi bigint, weight double")
    done = kept(folded.join(pairs, ["lo", "hi"]).select("a", "b", "weight", "co_access_count", "last_fired"))
    return done, now.select("end", "first")
