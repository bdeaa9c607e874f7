"""Streams of accesses: events from lines, batches into a memory, sessions by idle time, and learning in keyed state."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import constants as C
from ..functions import scalars as S
from ..operators import continual, learning
from ..operators.learning import State
from ..schema import SOCKET_EVENT
from ..sources.events import from_json
from ..sources.shared import kept, new_path
from ..sources.snippets import LANGUAGES
from ..sources.store import MemoryStore
from .state import PROVIDER

DEBOUNCE, IDLE = "2 seconds", "15 minutes"
IMPULSES = "a string, b string, at timestamp, id bigint, pos bigint, d double"
_STATE = "vertices array<string>, types array<string>"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a stream, with the accesses' columns."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)
    k = F.get_json_object("props", "$.k").cast("bigint")
    kind = F.when(F.col("event_type").isin("view", "click"), "file").when(F.col("event_type") == "purchase", "tool").when(F.col("event_type") == "error", "error").otherwise("semantic")
    path = F.concat(F.col("event_type"), F.lit("/"), (k % 20).cast("string"))
    return raw.select(F.col("event_id").alias("id"), F.col("user_id").alias("session_id"), F.col("ts").cast("timestamp").alias("at"), kind.alias("type"), F.concat(kind, F.lit(":"), path).alias("vertex"))


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Streams that start within it keep state as streaming.state needs it. A stream takes its settings when it starts."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, PROVIDER)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def finished(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All that a stream gives for what is there now, by way of Parquet in the shared folder. What a batch writes goes
    to the batch's own folder, and a batch that is run again writes over it."""
    spark = stream.sparkSession
    root = new_path(spark, "stream")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={number}")

    with state_store(spark):
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out/batch=*")


def to_memory(stream: DataFrame, each: Callable[[DataFrame, int], None]) -> None:
    """Gives each all that a stream has now, batch by batch."""
    spark = stream.sparkSession
    with state_store(spark):
        query = stream.writeStream.outputMode("append").option("checkpointLocation", new_path(spark, "checkpoint")).trigger(availableNow=True).foreachBatch(each).start()
    query.awaitTermination()


def learning_batches(memories: MemoryStore, query: str) -> Callable[[DataFrame, int], None]:
    """Learns batches into a memory. A batch that comes again, by its number, is in already and changes nothing."""
    return lambda batch, number: continual.learn_into(memories, batch, (query, number)) and None


def weakening_batches(memories: MemoryStore, query: str) -> Callable[[DataFrame, int], None]:
    """Weakens the edges of what batches of state.ignored() tell was recalled and not opened, once for every time."""

    def each(batch: DataFrame, number: int) -> None:
        times = kept(batch.filter("reason = 'changed'").groupBy("id").agg(F.count("*").alias("streak")))
        weaker = lambda edges: learning.weakened(edges, times, 1 - S.ignored_decay(F.col("streak")))
        continual.keep_up(memories, lambda now: now.but(edges=weaker(now.edges)), (query, number))

    return each


def upkeep_batches(memories: MemoryStore, query: str, step: Callable[[State], State]) -> Callable[[DataFrame, int], None]:
    """A step of upkeep for each batch in which sessions have ended, however many."""

    def each(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            continual.keep_up(memories, step, (query, number))

    return each


def recorded(stream: DataFrame, checkpoint: str, record: Callable[[DataFrame, int], None]):
    """Starts the recorder: micro-batches every DEBOUNCE, in which files come once a path and other events as they
    are. record gets a batch and its number, and must give the same if it gets them again."""

    def each(batch: DataFrame, number: int) -> None:
        files = batch.filter("type = 'file'").dropDuplicates(["vertex"])
        record(batch.filter("type <> 'file'").unionByName(files), number)

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(processingTime=DEBOUNCE).foreachBatch(each).start()


def ended_sessions(stream: DataFrame, checkpoint: str, upkeep: Callable[[DataFrame, int], None], idle: str = IDLE, late: str = "1 hour"):
    """Starts the job of session ends: sessions that the watermark has passed go to upkeep, once a batch."""
    closed = session_windows(stream, idle, late)
    return closed.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(processingTime=DEBOUNCE).foreachBatch(upkeep).start()


def events_of(lines: DataFrame, home: str = "/") -> DataFrame:
    """Events (session_id, id, at, type, path, context, source) from a stream of JSON lines (value) as
    schema.SOCKET_EVENT. What isn't of type tool or error is a file; its path counts from home if it isn't whole, and
    skipped paths are left out, as are lines without a path and those that are no JSON. source: snippets can be cut."""
    e = from_json(lines, SOCKET_EVENT)
    said = lambda *names: F.coalesce(*(F.when(F.col(n) != "", F.col(n)) for n in names))
    at_once = F.col("type").isin("tool", "error")
    e = e.select("session_id", "id", "at", F.coalesce(F.when(at_once, F.col("type")), F.lit("file")).alias("type"), said("path", "file").alias("path"), said("context", "cmd").alias("context"))
    is_file = F.col("type") == "file"
    path = F.when(is_file & ~F.startswith("path", F.lit("/")), F.concat(F.lit(home.rstrip("/") + "/"), "path")).otherwise(F.col("path"))
    e = e.filter("path is not null").withColumn("path", path).filter(~(is_file & S.is_skipped(F.col("path"))))
    context = F.coalesce("context", F.when(is_file, "socket").otherwise(""))
    source = is_file & F.col("path").rlike("(" + "|".join(e.replace(".", r"\.") for ends in LANGUAGES.values() for e in ends) + ")$")
    return e.withColumn("context", context).withColumn("source", source)


def session_windows(stream: DataFrame, idle: str = IDLE, late: str = "1 hour") -> DataFrame:
    """(session_id, started, ended, n): sessions that end by idle time."""
    by = stream.withWatermark("at", late).groupBy(F.session_window("at", idle).alias("w"), "session_id").agg(F.count("*").alias("n"))
    return by.select("session_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


def impulses(stream: DataFrame, size: int = C.WINDOW, idle_ms: int = 2 * 3600 * 1000, late: str = "1 hour") -> DataFrame:
    """Impulses of learning as operators.learning.impulses() gives them without hubs, by the window of recent vertices
    of each session in state: `size` names at most. Within a batch accesses are taken in event order; state that has
    been idle for two hours of event time goes."""

    def fire(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        names, types = (list(map(list, state.get)) if state.exists else [[], []])
        out = []
        for row in pd.concat(batches).sort_values(["at", "id"]).itertuples():
            n = len(names)
            for i, (name, kind) in enumerate(zip(names, types, strict=True)):
                if name != row.vertex:
                    rate = C.LEARNING_RATE * (C.ERROR_BOOST if "error" in (row.type, kind) else 1.0)
                    out.append((min(name, row.vertex), max(name, row.vertex), row.at, row.id, i + 1, rate * (i + 1) / n))
            if row.vertex in names:
                at = names.index(row.vertex)
                del names[at], types[at]
            names.append(row.vertex)
            types.append(row.type)
            del names[:-size], types[:-size]
        state.update((names, types))
        state.setTimeoutTimestamp(max(int(row.at.timestamp() * 1000) + idle_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["a", "b", "at", "id", "pos", "d"])

    timed = stream.withWatermark("at", late)
    return timed.groupBy("session_id").applyInPandasWithState(fire, IMPULSES, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
