"""Learning that goes on: what a run has to know of the runs before it, and nothing of their logs.

A memory carries, beside its edges, what was told of each vertex by context, the 25 latest vertices of each open
session, and the first partners of each vertex up to the hub limit. Each is bounded by the number of vertices, edges or
open sessions. Runs take the log in order of time: what comes late stands where it comes."""

from __future__ import annotations

from collections.abc import Callable, Collection
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import scalars as S
from ..sources.shared import kept
from ..sources.store import MemoryStore, Version
from . import learning
from .learning import State

#: Tables of a memory that are looked up by vertex.
BY = {"vertices": "id", "edges": "source_id", "partners": "end"}
_EMPTY = {
    "told": "vertex string, type string, path string, context string, n bigint, last timestamp_ntz, first struct<at: timestamp_ntz, id: bigint>",
    "vertices": "id string, type string, path string, activation double, myelination double, access_count bigint, last_accessed timestamp_ntz, contexts array<string>",
    "edges": "source_id string, target_id string, weight double, co_access_count bigint, last_fired timestamp_ntz",
    "recent": "session_id bigint, vertex string, type string, at timestamp_ntz, id bigint",
    "partners": "end string, first struct<at: timestamp_ntz, id: bigint, pos: bigint>",
}


@dataclass(frozen=True)
class Memory:
    """told: what learning.told() says; vertices and edges: as in State; recent: (session_id, vertex, type, at, id), the
    latest vertices of each session; partners: (end, first), the first partners of each vertex, up to one beyond a hub's."""

    told: DataFrame
    vertices: DataFrame
    edges: DataFrame
    recent: DataFrame
    partners: DataFrame

    @property
    def state(self) -> State:
        return State(self.vertices, self.edges)

    def tables(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in _EMPTY}


def blank(spark: SparkSession) -> Memory:
    return Memory(**{name: spark.createDataFrame([], ddl) for name, ddl in _EMPTY.items()})


def recent_after(recent: DataFrame, log: DataFrame, size: int = C.WINDOW, open_since: str | None = None) -> DataFrame:
    """(session_id, vertex, type, at, id): the latest `size` distinct vertices of each session after its log. Sessions
    without an access since open_since have ended: nothing of them is carried on."""
    every = recent.unionByName(log.select(*recent.columns))
    latest = every.groupBy("session_id", "vertex").agg(F.max(F.struct("at", "id", "type")).alias("l"))
    by = Window.partitionBy("session_id")
    ranked = latest.withColumn("k", F.row_number().over(by.orderBy(F.desc("l.at"), F.desc("l.id")))).filter(F.col("k") <= size)
    if open_since is not None:
        ranked = ranked.withColumn("newest", F.max("l.at").over(by)).filter(F.col("newest") >= F.lit(open_since).cast("timestamp_ntz"))
    return ranked.select("session_id", "vertex", "l.type", "l.at", "l.id")


def edges_after(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """edges with those of changed: their weights, their firings added, and when they fired last."""
    new = changed.select("source_id", "target_id", F.col("weight").alias("w"), F.col("co_access_count").alias("n"), F.col("last_fired").alias("fired"))
    joined = edges.join(new, ["source_id", "target_id"], "full_outer")
    count = F.coalesce("co_access_count", F.lit(0)) + F.coalesce("n", F.lit(0))
    return joined.select("source_id", "target_id", F.coalesce("w", "weight").alias("weight"), count.alias("co_access_count"), F.greatest("last_fired", "fired").alias("last_fired"))


def vertices_after(vertices: DataFrame, told: DataFrame) -> DataFrame:
    """vertices after what is told now, of their whole past. What has been accessed since is active, and its myelin goes
    on from what upkeep has left of it: each access fills the same share of what is missing."""
    before = vertices.select("id", F.col("activation").alias("a0"), F.col("myelination").alias("m0"), F.col("access_count").alias("n0"))
    joined = learning.vertices_of(told).join(before, "id", "left")
    left = lambda n: C.MYELIN_MAX - S.myelination(n)
    share = F.when(left(F.col("n0")) > 0, left(F.col("access_count")) / left(F.col("n0"))).otherwise(0.0)
    more = F.when(F.col("n0").isNull(), F.col("myelination")).when(F.col("n0") == F.col("access_count"), F.col("m0")).otherwise(C.MYELIN_MAX - (C.MYELIN_MAX - F.col("m0")) * share)
    active = F.when(F.col("n0") == F.col("access_count"), F.col("a0")).otherwise(1.0)
    return joined.withColumn("myelination", more).withColumn("activation", active).select(*vertices.columns)


def continued(memory: Memory, log: DataFrame, open_since: str | None = None) -> Memory:
    """The memory after more of the log: without upkeep in between, the same as if it had learned all of it at once."""
    told = memory.told.unionByName(learning.told(log)).groupBy("vertex", "type", "path", "context").agg(F.sum("n").alias("n"), F.max("last").alias("last"), F.min("first").alias("first"))
    known = memory.edges.filter("source_id < target_id").select(F.col("source_id").alias("a"), F.col("target_id").alias("b"), "weight")
    told = kept(told)
    pairs, partners = learning.learned_pairs_after(log, memory.recent, known, memory.partners, told.select("vertex"))
    changed = learning.both_ways(pairs)
    return Memory(told, vertices_after(memory.vertices, told), edges_after(memory.edges, changed), recent_after(memory.recent, log, open_since=open_since), partners)


def record_errors(memory: Memory, errors: DataFrame) -> Memory:
    """The memory after errors (session_id, at, id, message): each and its fingerprint as accesses of its session, and
    strong edges between the two."""
    after = continued(memory, learning.errors_told(errors))
    wired = learning.wired_errors(after.edges, errors).select("source_id", "target_id", F.col("weight").alias("w"), F.col("co_access_count").alias("n"))
    edges = after.edges.join(wired, ["source_id", "target_id"], "full_outer")
    return replace(after, edges=edges.select("source_id", "target_id", F.coalesce("w", "weight").alias("weight"), F.coalesce("n", "co_access_count").alias("co_access_count"), "last_fired"))


def kept_up(memory: Memory, step: Callable[[State], State]) -> Memory:
    """The memory after a step of upkeep. Nothing is known any more of vertices that are gone, and partners are those
    that there are."""
    state = step(memory.state)
    told = memory.told.join(state.vertices.select(F.col("id").alias("vertex")), "vertex", "left_semi").select(*memory.told.columns)
    first = F.struct(F.col("last_fired").alias("at"), F.lit(0).cast("bigint").alias("id"), F.lit(0).cast("bigint").alias("pos"))
    ranked = state.edges.withColumn("n", F.row_number().over(Window.partitionBy("source_id").orderBy("last_fired", "target_id"))).filter(F.col("n") <= C.HUB_DEGREE + 1)
    columns = memory.vertices.columns, memory.edges.columns
    return Memory(told, state.vertices.select(*columns[0]), state.edges.select(*columns[1]), memory.recent, ranked.select(F.col("source_id").alias("end"), first.alias("first")))


def store(spark: SparkSession, root: str, buckets: int | None = None) -> MemoryStore:
    return MemoryStore(spark, root, BY, buckets)


def learn_into(memories: MemoryStore, log: DataFrame, batch: tuple[str, int] | None = None, open_since: str | None = None) -> Version:
    """Learns log into the newest version, as the next one; a batch (query, number) that is in already is left out, so
    a stream may give its batches again."""

    def step(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
        return continued(Memory(**tables) if tables else blank(memories.spark), log, open_since).tables()

    return memories.update(step, batch)


def keep_up(memories: MemoryStore, step: Callable[[State], State], batch: tuple[str, int] | None = None, in_place: Collection[str] = ()) -> Version:
    """Takes a step of upkeep on the newest version, as the next one. in_place: vertices or edges, where the step makes
    one row of one row and so leaves them in their buckets."""

    def after(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
        new = kept_up(Memory(**tables) if tables else blank(memories.spark), step).tables()
        # What is recent stays what it was: the next version names the same folder.
        return {name: df for name, df in new.items() if name != "recent" or not tables}

    return memories.update(after, batch, in_place=in_place)


def read(memories: MemoryStore, version: Version | None = None) -> Memory:
    tables = memories.read(version)
    return Memory(**tables) if tables else blank(memories.spark)
