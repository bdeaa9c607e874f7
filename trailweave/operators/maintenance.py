"""Upkeep of the memory: decay, pruning, homeostasis and consolidation. Each step makes a new State of the old one;
a step sees the state as it was when the step began. `as_of` is the moment that ages are counted to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import scalars as S
from . import mining
from .learning import State, windows


def _days_before(as_of: str, days: float) -> Column:
    return F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(hours=F.lit(int(days * 24)))


def decayed(state: State) -> State:
    """One cycle's loss of activation, myelin and weight."""
    vertices = state.vertices.withColumn("activation", F.col("activation") * C.DECAY_ACTIVATION).withColumn("myelination", F.col("myelination") * C.DECAY_MYELIN)
    return state.but(vertices=vertices, edges=state.edges.withColumn("weight", F.col("weight") * C.DECAY_WEIGHT))


def bridges_weakened(state: State) -> State:
    """Weak, rare edges to files that are hardly used lose a fifth more, to no less than the pruning weight."""
    poor = state.vertices.filter("activation < 0.1 and myelination < 0.05 and type = 'file'").select(F.col("id").alias("target_id"), F.lit(True).alias("poor"))
    weak = F.coalesce("poor", F.lit(False)) & (F.col("weight") < 0.3) & (F.col("co_access_count") <= 2)
    edges = state.edges.join(poor, "target_id", "left").withColumn("weight", F.when(weak, F.greatest(F.col("weight") * 0.8, F.lit(C.PRUNE_WEIGHT))).otherwise(F.col("weight")))
    return state.but(edges=edges.drop("poor"))


def edges_pruned(state: State, as_of: str) -> State:
    """Without edges that are all but gone, incidental and old, or long abandoned."""
    old = lambda days: F.col("last_fired") < _days_before(as_of, days)
    w = F.col("weight")
    gone = (w < C.PRUNE_WEIGHT) | ((w < 0.15) & (F.col("co_access_count") <= 1) & old(3)) | ((w < 0.3) & old(30))
    return state.but(edges=state.edges.filter(~F.coalesce(gone, F.lit(False))))


def without_loose_edges(state: State) -> State:
    ids = state.vertices.select("id")
    edges = state.edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    return state.but(edges=edges)


def vertices_pruned(state: State) -> State:
    """Without vertices that are neither active nor learned nor used, and without their edges."""
    dead = (F.col("activation") < 0.01) & (F.col("myelination") < 0.01) & (F.col("access_count") < 2)
    return without_loose_edges(state.but(vertices=state.vertices.filter(~dead)))


def orphans_pruned(state: State) -> State:
    """Without little used files that have no edge."""
    ends = state.edges.select(F.col("source_id").alias("id")).unionByName(state.edges.select(F.col("target_id").alias("id"))).distinct()
    loose = state.vertices.filter("type = 'file' and access_count < 3 and myelination < 0.05").join(ends, "id", "left_anti").select("id")
    return state.but(vertices=state.vertices.join(loose, "id", "left_anti"))


def balanced(state: State) -> State:
    """Homeostasis: myelin and weights scaled down to their target means, files much used damped and little used
    helped. The means are one row, which is broadcast."""
    files = F.col("type") == "file"
    means = state.vertices.agg(F.avg(F.when(files, F.col("myelination"))).alias("mm"), F.avg(F.when(files & (F.col("access_count") > 0), F.col("access_count"))).alias("ma"))
    weights = state.edges.agg(F.avg("weight").alias("mw"))
    v = state.vertices.join(F.broadcast(means))
    m = F.col("myelination") * F.when(files & (F.col("mm") > C.MYELIN_TARGET), C.MYELIN_TARGET / F.col("mm")).otherwise(1.0)
    m = F.when(files & (F.col("access_count") > F.ceil(F.col("ma") * 3)), m * 0.9).otherwise(m)
    low = F.floor(F.col("ma") / 3)
    m = F.when(files & (low > 0) & (F.col("access_count") < low) & (m > 0.05), F.least(m * 1.05, F.lit(C.MYELIN_MAX))).otherwise(m)
    e = state.edges.join(F.broadcast(weights))
    w = F.col("weight") * F.when(F.col("mw") > C.WEIGHT_TARGET, C.WEIGHT_TARGET / F.col("mw")).otherwise(1.0)
    return State(v.withColumn("myelination", m).drop("mm", "ma"), e.withColumn("weight", w).drop("mw"))


def tags_expired(state: State, as_of: str) -> State:
    """Tags of edges (tagged_at, where there is such a column) last an hour."""
    if "tagged_at" not in state.edges.columns:
        return state
    over = F.col("tagged_at") < F.lit(as_of).cast("timestamp_ntz") - F.expr("interval 1 hour")
    return state.but(edges=state.edges.withColumn("tagged_at", F.when(~over, F.col("tagged_at"))))


def captured(state: State, accessed: DataFrame, as_of: str) -> State:
    """Tagged edges at a vertex that is accessed (id) within the hour are confirmed: they get the weight of a captured
    tag at least, and are tagged no more."""
    hit = accessed.select(F.col("id").alias("source_id")).distinct().withColumn("from", F.lit(True))
    ends = state.edges.join(hit, "source_id", "left").join(hit.select(F.col("source_id").alias("target_id"), F.col("from").alias("to")), "target_id", "left")
    fresh = F.col("tagged_at") > F.lit(as_of).cast("timestamp_ntz") - F.expr("interval 1 hour")
    sure = (F.coalesce("from", F.lit(False)) | F.coalesce("to", F.lit(False))) & F.coalesce(fresh, F.lit(False))
    edges = ends.withColumn("weight", F.when(sure, F.greatest("weight", F.lit(C.CAPTURE_WEIGHT))).otherwise(F.col("weight"))).withColumn("tagged_at", F.when(~sure, F.col("tagged_at")))
    return state.but(edges=edges.drop("from", "to"))


def decay(state: State, as_of: str) -> State:
    """The whole cycle."""
    state = tags_expired(state, as_of)
    state = edges_pruned(bridges_weakened(decayed(state)), as_of)
    return balanced(orphans_pruned(vertices_pruned(state)))


# Consolidation ------------------------------------------------------------------------------------------------------


def _bumped(edges: DataFrame, bumps: DataFrame, as_of: str | None = None) -> DataFrame:
    """edges with bumps (source_id, target_id, bump, n): saturating additions of bump, and n firings more; the bumps
    of edges that aren't there make them, tagged at `as_of` where edges have tags."""
    joined = edges.join(bumps, ["source_id", "target_id"], "full_outer")
    if "tagged_at" in edges.columns and as_of is not None:
        joined = joined.withColumn("tagged_at", F.when(F.col("weight").isNull(), F.lit(as_of).cast("timestamp_ntz")).otherwise(F.col("tagged_at")))
    w = F.when(F.col("bump").isNull(), F.col("weight")).otherwise(S.saturating_add(F.coalesce("weight", F.lit(0.0)), F.col("bump")))
    return joined.withColumn("weight", w).withColumn("co_access_count", F.coalesce("co_access_count", F.lit(0)) + F.coalesce("n", F.lit(0))).drop("bump", "n")


def replayed(state: State, log: DataFrame, as_of: str, top: int = 5, delta: float = 0.01) -> State:
    """The busiest recent sessions are gone through again: edges that exist are fired a little, in order."""
    busy = log.filter(F.col("at") > _days_before(as_of, 7)).groupBy("session_id").agg(F.count("*").alias("n")).filter("n >= 5").orderBy(F.desc("n"), "session_id").limit(top).select("session_id")
    again = windows(log.join(busy, "session_id", "left_semi")).filter("recent <> vertex")
    fired = again.select(F.least("vertex", "recent").alias("a"), F.greatest("vertex", "recent").alias("b")).groupBy("a", "b").agg(F.count("*").alias("n"))
    both = fired.select(F.col("a").alias("source_id"), F.col("b").alias("target_id"), "n").unionByName(fired.select(F.col("b").alias("source_id"), F.col("a").alias("target_id"), "n"))
    joined = state.edges.join(both, ["source_id", "target_id"], "left")
    steps = F.when(F.col("n") > 0, F.sequence(F.lit(1).cast("bigint"), F.col("n"))).otherwise(F.array().cast("array<bigint>"))
    weight = F.aggregate(steps, F.col("weight"), lambda w, _: S.strengthen(w, F.lit(delta)))
    return state.but(edges=joined.withColumn("weight", weight).withColumn("co_access_count", F.col("co_access_count") + F.coalesce("n", F.lit(0))).drop("n"))


def reviewed(state: State, as_of: str) -> State:
    """Files not seen for one to seven days gain a quarter access's myelin; those not seen for longer lose some."""
    at, m = F.col("last_accessed"), F.col("myelination")
    due = (m > 0.05) & (F.col("type") == "file")
    boosted = F.least(m + S.myelin_delta(m, F.col("access_count")) * 0.25, F.lit(C.MYELIN_MAX))
    new = F.when(due & (at < _days_before(as_of, 1)) & (at > _days_before(as_of, 7)), boosted).when(due & (at < _days_before(as_of, 7)), m * 0.95).otherwise(m)
    return state.but(vertices=state.vertices.withColumn("myelination", new))


def _confirmed(state: State, pairs: DataFrame, fresh: Column, below: float, bump: float, as_of: str) -> State:
    """Edges for pairs (n1, n2) that have none, of weight `fresh`; those weaker than `below` gain `bump`."""
    both = pairs.select(F.col("n1").alias("source_id"), F.col("n2").alias("target_id"), fresh.alias("fresh")).unionByName(pairs.select(F.col("n2").alias("source_id"), F.col("n1").alias("target_id"), fresh.alias("fresh")))
    known = both.join(state.edges.select("source_id", "target_id", "weight"), ["source_id", "target_id"], "left")
    w = F.col("weight")
    step = F.when(w.isNull(), F.col("fresh")).when(w < below, bump * S.snap(w))
    return state.but(edges=_bumped(state.edges, known.select("source_id", "target_id", step.alias("bump"), F.lit(1).alias("n")).filter("bump is not null"), as_of))


def cross_session(state: State, log: DataFrame, as_of: str) -> State:
    pairs = mining.session_pairs(log.filter(F.col("at") <= F.lit(as_of).cast("timestamp_ntz")), _since(as_of, 7))
    return _confirmed(state, pairs, F.lit(0.15), 0.2, 0.05, as_of)


def temporal(state: State, log: DataFrame, as_of: str, seconds: int = 60) -> State:
    pairs = mining.close_pairs(log, seconds, _since(as_of, 14))
    return _confirmed(state, pairs, S.proximity_weight(F.col("avg_seconds"), float(seconds)), 0.3, 0.03, as_of)


def directed(state: State, log: DataFrame, as_of: str) -> State:
    """Edges along which accesses go one way gain a fifth of what they are open to."""
    pairs = mining.directional(mining.ordered_pairs(log, since=_since(as_of, 14))).select(F.col("first_id").alias("source_id"), F.col("second_id").alias("target_id"), F.lit(True).alias("on"))
    w = F.col("weight")
    gain = F.col("on") & (w > 0.1) & (w < 0.8)
    edges = state.edges.join(pairs, ["source_id", "target_id"], "left")
    edges = edges.withColumn("co_access_count", F.col("co_access_count") + F.when(gain, 1).otherwise(0)).withColumn("weight", F.when(gain, S.saturating_add(w, w * 0.2 * S.snap(w))).otherwise(w))
    return state.but(edges=edges.drop("on"))


def tripled(state: State, log: DataFrame, as_of: str) -> State:
    """Edges of triangles of sessions' pairs gain once a triangle, as long as they are below one half."""
    found = mining.triangles(mining.session_pairs(log, _since(as_of, 7)), neighbours=20)
    sides = found.select(F.explode(F.array(F.struct(F.col("a").alias("s"), F.col("b").alias("t")), F.struct(F.col("a").alias("s"), F.col("c").alias("t")), F.struct(F.col("b").alias("s"), F.col("c").alias("t")))).alias("e"))
    times = sides.groupBy(F.col("e.s").alias("s"), F.col("e.t").alias("t")).agg(F.count("*").alias("n"))
    both = times.select(F.col("s").alias("source_id"), F.col("t").alias("target_id"), "n").unionByName(times.select(F.col("t").alias("source_id"), F.col("s").alias("target_id"), "n"))
    joined = state.edges.join(both, ["source_id", "target_id"], "left")
    steps = F.when(F.col("n") > 0, F.sequence(F.lit(1).cast("bigint"), F.col("n"))).otherwise(F.array().cast("array<bigint>"))
    weight = F.aggregate(steps, F.col("weight"), lambda w, _: F.when(w < 0.5, S.strengthen(w, F.lit(0.05))).otherwise(w))
    return state.but(edges=joined.withColumn("weight", weight).drop("n"))


def log_pruned(log: DataFrame, as_of: str, most: int = 5000) -> DataFrame:
    """The newest rows of the log, none older than 30 days. The rank is found without sorting all rows in one task:
    rows are counted by hour first, and only those of the hour in which the limit falls are ranked."""
    kept = log.filter(F.col("at") >= _days_before(as_of, 30)).withColumn("hour", F.date_trunc("hour", F.col("at")))
    hours = kept.groupBy("hour").agg(F.count("*").alias("n"))
    newer = hours.withColumn("newer", F.sum("n").over(Window.orderBy(F.desc("hour"))) - F.col("n")).filter(F.col("newer") < most).select("hour", "newer", "n")
    ranked = kept.join(newer, "hour").withColumn("k", F.row_number().over(Window.partitionBy("hour").orderBy(F.desc("at"), F.desc("id"))))
    return ranked.filter(F.col("newer") + F.col("k") <= most).drop("hour", "newer", "n", "k")


def consolidate(state: State, log: DataFrame, as_of: str) -> tuple[State, DataFrame]:
    """All phases in order: the new state, and what stays of the log."""
    state = cross_session(reviewed(replayed(state, log, as_of), as_of), log, as_of)
    state = tripled(directed(temporal(state, log, as_of), log, as_of), log, as_of)
    return state, log_pruned(log, as_of)


def _since(as_of: str, days: int) -> str:
    from datetime import datetime, timedelta

    return str(datetime.fromisoformat(as_of) - timedelta(days=days))
