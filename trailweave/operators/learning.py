"""Learning as relational algebra: from a log of accesses to vertices and weighted edges.

What an engine would do access by access comes apart. Myelination is a function of the number of accesses. The window
of recent vertices is a join of accesses of a session with those still live, ranked by recency. Hub damping asks when
a vertex got its 21st partner. Only the weight of a pair is a fold, over the impulses of that pair in their order.
The log has session_id, vertex, type, path, context, at, id, token_cost; (at, id) is the order of events."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import scalars as S
from ..sources.shared import kept
from . import folding
from .sequences import neighbours, running


@dataclass(frozen=True)
class State:
    """The memory: vertices (id, type, path, activation, myelination, access_count, last_accessed, contexts) and
    directed edges (source_id, target_id, weight, co_access_count, last_fired)."""

    vertices: DataFrame
    edges: DataFrame

    def but(self, **changed: DataFrame) -> State:
        return replace(self, **changed)


#: Accesses of a session that are joined with one another; what was recent before them comes from blocks before.
BLOCK = 64
#: Impulses of a pair that are gathered at once.
MOST_IMPULSES = 10_000


def ordinals(log: DataFrame) -> DataFrame:
    """log with ord, the place in its session, and nxt, the place of the next access to the same vertex.

    Accesses are counted by hour first and ranked within hours, so that no task has to sort a whole session."""
    hour = F.coalesce(F.date_trunc("hour", F.col("at")).cast("timestamp"), F.lit("0001-01-01").cast("timestamp"))
    timed = log.withColumn("_hour", hour)
    hours = timed.groupBy("session_id", "_hour").agg(F.count("*").alias("_n"))
    before = hours.select("session_id", "_hour", (F.sum("_n").over(Window.partitionBy("session_id").orderBy("_hour")) - F.col("_n")).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("session_id", "_hour").orderBy("at", "id"))
    placed = timed.join(before, ["session_id", "_hour"]).withColumn("ord", F.col("_before") + rank).drop("_hour", "_before")
    return placed.withColumn("nxt", F.lead("ord").over(Window.partitionBy("session_id", "vertex").orderBy("ord")))


def _recent_before(placed: DataFrame, size: int, length: int) -> DataFrame:
    """(session_id, block, then, nxt, recent, recent_type): the `size` latest distinct vertices before each block.

    A block has `length` accesses. Each block has its own latest; doubling how many blocks are looked back on, every round merges two lists of `size`
    into one. There are as many rounds as the longest session's number of blocks has digits to base two."""
    key = ["session_id", "block"]
    latest = Window.partitionBy(*key).orderBy(F.desc("then"))

    def shortened(rows: DataFrame) -> DataFrame:
        return rows.withColumn("k", F.row_number().over(latest)).filter(F.col("k") <= size).drop("k")

    ends = placed.groupBy("session_id").agg(F.max("block").alias("last_block")).filter("last_block > 0")
    own = placed.filter(F.col("nxt").isNull() | (F.floor((F.col("nxt") - 1) / length) > F.col("block"))).join(ends, "session_id")
    now = kept(shortened(own.select(*key, "last_block", F.col("ord").alias("then"), "nxt", F.col("vertex").alias("recent"), F.col("type").alias("recent_type"))))
    span, most = 1, now.agg(F.max("last_block")).first()[0] or 0
    while span < most:
        back = now.withColumn("block", F.col("block") + span).filter("block <= last_block")
        merged = now.unionByName(back).groupBy(*key, "last_block", "recent").agg(F.max(F.struct("then", "nxt", "recent_type")).alias("l"))
        now = kept(shortened(merged.select(*key, "last_block", "l.then", "l.nxt", "recent", "l.recent_type")))
        span *= 2
    return now.withColumn("block", F.col("block") + 1).filter("block <= last_block").drop("last_block")


def windows(log: DataFrame, size: int = C.WINDOW, before: DataFrame | None = None) -> DataFrame:
    """(session_id, ord, vertex, type, at, id, recent, recent_type, recency, len): the members of each access's window
    of recent distinct vertices of its session, recency 1 the latest. before: of each session the latest accesses before
    the log, one a vertex, of which windows have members but that get none themselves.

    An access is joined with those of its block and the `size` latest before it: BLOCK + size at most."""
    columns = ["session_id", "vertex", "type", "at", "id"]
    given = log.select(*columns, F.lit(True).alias("_own"))
    given = given if before is None else given.unionByName(before.select(*columns, F.lit(False).alias("_own")))
    placed = kept(ordinals(given).select("session_id", "ord", "nxt", "vertex", "type", "at", "id", "_own", F.floor((F.col("ord") - 1) / BLOCK).alias("block")))
    own = F.struct("at", "id", "_own").alias("access")
    here = placed.select("session_id", "block", F.col("ord").alias("then"), "nxt", F.col("vertex").alias("recent"), F.col("type").alias("recent_type"), own)
    then = here.unionByName(_recent_before(placed, size, BLOCK), allowMissingColumns=True)
    # One row a block: BLOCK + size entries at most, in order. What is live at one of them is among those before it.
    entry = F.struct("then", "nxt", "recent", "recent_type", "access")
    blocks = then.groupBy("session_id", "block").agg(F.array_sort(F.collect_list(entry)).alias("e"))
    live = lambda x, i: F.filter(F.slice("e", F.lit(1), i), lambda r: r["nxt"].isNull() | (r["nxt"] >= x["then"]))
    each = blocks.select("session_id", F.explode(F.transform("e", lambda x, i: F.struct(x.alias("x"), live(x, i).alias("live")))).alias("y")).filter("y.x.access._own")
    win = F.slice("y.live", F.greatest(F.size("y.live") - size, F.lit(0)) + 1, F.lit(size))
    members = each.select("session_id", "y.x", F.size(win).alias("len"), F.posexplode(win).alias("j", "r"))
    return members.select(
        "session_id", F.col("x.then").alias("ord"), F.col("x.recent").alias("vertex"), F.col("x.recent_type").alias("type"), "x.access.at", "x.access.id",
        "r.recent", "r.recent_type", (F.col("len") - F.col("j")).alias("recency"), F.col("len").cast("bigint").alias("len"),
    )


def _fired(log: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """(a, b, at, id, pos, d): what each access would give each pair a < b if there were no hubs."""
    fired = windows(log, before=before).filter("recent <> vertex")
    rate = C.LEARNING_RATE * F.when((F.col("type") == "error") | (F.col("recent_type") == "error"), C.ERROR_BOOST).otherwise(1.0)
    pos = F.col("len") - F.col("recency") + 1
    return fired.select(F.least("vertex", "recent").alias("a"), F.greatest("vertex", "recent").alias("b"), "at", "id", pos.alias("pos"), (rate * pos / F.col("len")).alias("d"))


def gathered(given: DataFrame, most: int = MOST_IMPULSES) -> DataFrame:
    """(a, b, round, n, last_fired, ds): impulses (a, b, at, id, pos, d) by pair, numbered in their order and gathered
    `most` at a time: no more of a pair are ever in one row. Written, and read again."""
    k = F.row_number().over(Window.partitionBy("a", "b").orderBy("at", "id", "pos"))
    numbered = given.withColumn("k", k).withColumn("round", F.floor((F.col("k") - 1) / most))
    ds = F.array_sort(F.collect_list(F.struct("k", "at", "id", "pos", "d"))).alias("ds")
    return kept(numbered.groupBy("a", "b", "round").agg(F.count("*").alias("n"), F.max("at").alias("last_fired"), ds))


def _first_partners(grouped: DataFrame, known: DataFrame | None = None, partners: DataFrame | None = None) -> DataFrame:
    """(end, first, n): the first HUB_DEGREE + 1 partners of each vertex, by the first impulse of each, in order.
    known: pairs (a, b) from before, whose ends stand in partners (end, first) as far as they count."""
    one = F.element_at("ds", 1)
    first = grouped.filter("round = 0").select("a", "b", F.struct(one["at"].alias("at"), one["id"].alias("id"), one["pos"].alias("pos")).alias("first"))
    first = first if known is None else first.join(known.select("a", "b"), ["a", "b"], "left_anti")
    ends = first.select(F.explode(F.array("a", "b")).alias("end"), "first")
    ends = ends if partners is None else ends.unionByName(partners.select("end", "first"))
    return ends.withColumn("n", F.row_number().over(Window.partitionBy("end").orderBy("first"))).filter(F.col("n") <= C.HUB_DEGREE + 1)


def _damped(grouped: DataFrame, partners: DataFrame) -> DataFrame:
    """grouped with impulses at hubs halved. A vertex is a hub once it has more partners than HUB_DEGREE: after the
    first impulse of the one beyond them."""
    # One row a hub, written once: it is joined to both ends.
    hub = kept(partners.filter(F.col("n") == C.HUB_DEGREE + 1).select("end", "first"))
    hub_a, hub_b = (hub.select(F.col("end").alias(c), F.col("first").alias(f"hub_{c}")) for c in ("a", "b"))
    marked = grouped.join(hub_a, "a", "left").join(hub_b, "b", "left").withColumn("hub", F.least("hub_a", "hub_b"))
    halved = lambda x: F.when(F.struct(x["at"], x["id"], x["pos"]) > F.col("hub"), x["d"] * C.HUB_FACTOR).otherwise(x["d"])
    ds = F.when(F.col("hub").isNull(), F.col("ds")).otherwise(F.transform("ds", lambda x: x.withField("d", halved(x))))
    return marked.withColumn("ds", ds).drop("hub", "hub_a", "hub_b")


def impulses(log: DataFrame, hubs: bool = True) -> DataFrame:
    """(a, b, at, id, pos, d): what each access gives each pair a < b, d, in the order (at, id, pos)."""
    if not hubs:
        return _fired(log)
    grouped = gathered(_fired(log))
    return _damped(grouped, _first_partners(grouped)).select("a", "b", F.inline("ds")).drop("k")


def folded(given: DataFrame, known: DataFrame | None = None, step=S.strengthen, captured: bool = True, most: int = MOST_IMPULSES) -> DataFrame:
    """(a, b, weight, co_access_count, last_fired): the pairs' weights after their impulses (a, b, at, id, pos, d)."""
    return _folded(gathered(given, most), known, step, captured)


def _folded(grouped: DataFrame, known: DataFrame | None = None, step=S.strengthen, captured: bool = True) -> DataFrame:
    """folded() of what was gathered. known: weights from before. A pair's first impulse makes its edge, with the weight
    of a captured tag.

    Each round goes on from the one before. Most pairs are done in the first."""
    before = None if known is None else known.select("a", "b", F.col("weight").alias("before"))
    out, rounds = None, 1 + (grouped.agg(F.max("round")).first()[0] or 0)
    for number in range(rounds):
        pairs, ds = grouped.filter(F.col("round") == number), F.transform("ds", lambda x: x["d"])
        if out is not None:
            before = kept(out).select("a", "b", F.col("weight").alias("before"))
        pairs = pairs.withColumn("before", F.lit(None).cast("double")) if before is None else pairs.join(before, ["a", "b"], "left")
        first = step(F.lit(0.0), F.element_at("ds", 1)["d"])
        made = F.greatest(F.lit(C.CAPTURE_WEIGHT), first) if captured else first
        start = F.coalesce("before", made)
        rest = F.when(F.col("before").isNull(), F.slice(ds, 2, F.greatest(F.size(ds) - 1, F.lit(0)))).otherwise(ds)
        done = pairs.select("a", "b", F.aggregate(rest, start, step).alias("weight"), F.col("n").alias("co_access_count"), "last_fired")
        # Pairs without impulses in this round keep what the last one gave them.
        out = done if out is None else done.unionByName(out.join(done.select("a", "b"), ["a", "b"], "left_anti"))
    if rounds == 1:
        return out
    counts = grouped.groupBy("a", "b").agg(F.sum("n").alias("co_access_count"), F.max("last_fired").alias("last_fired"))
    return out.select("a", "b", "weight").join(counts, ["a", "b"])


def learned_pairs(log: DataFrame, snapping: bool = True, captured: bool = True) -> DataFrame:
    """folded() of all that a log fires: see folding."""
    return folding.learned(log, snapping=snapping, captured=captured)[0]


def learned_pairs_after(log: DataFrame, before: DataFrame, known: DataFrame, partners: DataFrame, vertices: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """folded() of a log that goes on, and (end, first), the first partners of each vertex after it. before: the latest
    vertices of each session; known: the pairs that there are, and their weights; partners: the first ones before;
    vertices: all that there are (vertex), if they are known."""
    return folding.learned(log, before, known, partners, vertices)


def both_ways(pairs: DataFrame) -> DataFrame:
    ends = F.array(F.struct(F.col("a").alias("source_id"), F.col("b").alias("target_id")), F.struct(F.col("b").alias("source_id"), F.col("a").alias("target_id")))
    return pairs.select(F.inline(ends), "weight", "co_access_count", "last_fired")


def learned_edges(log: DataFrame) -> DataFrame:
    return both_ways(learned_pairs(log))


def told(log: DataFrame) -> DataFrame:
    """(vertex, type, path, context, n, last, first): how often each vertex was accessed with each context, and when."""
    return log.groupBy("vertex", "type", "path", "context").agg(F.count("*").alias("n"), F.max("at").alias("last"), F.min(F.struct("at", "id")).alias("first"))


def vertices_of(told: DataFrame) -> DataFrame:
    """The vertices that told() tells of. Only the latest new contexts of a vertex are gathered."""
    key = ["vertex", "type", "path"]
    counts = told.groupBy(*key).agg(F.sum("n").alias("access_count"), F.max("last").alias("last_accessed"))
    ranked = told.withColumn("k", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("first"), F.desc("context")))).filter(F.col("k") <= C.CONTEXTS_RECORDED)
    first = ranked.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct((-F.col("k")).alias("k"), "context"))).alias("told")).select(*(F.col(c).alias(f"{c}_") for c in key), "told")
    seen = counts.join(first, reduce(and_, (F.col(c).eqNullSafe(F.col(f"{c}_")) for c in key)))
    return seen.select(
        F.col("vertex").alias("id"), "type", "path", F.lit(1.0).alias("activation"), S.myelination(F.col("access_count")).alias("myelination"),
        "access_count", "last_accessed", F.transform("told", lambda x: x["context"]).alias("contexts"),
    )


def learned_vertices(log: DataFrame) -> DataFrame:
    # What a vertex holds grows with its contexts, not with its accesses.
    return vertices_of(told(log))


def learn(log: DataFrame) -> State:
    return State(learned_vertices(log), learned_edges(log))


def learned_lite(log: DataFrame) -> State:
    """The same by the reduced engine: no plasticity, no capture, myelin by a fixed share of what is left."""
    n = F.col("access_count")
    vertices = learned_vertices(log).withColumn("myelination", C.MYELIN_MAX * (1 - F.pow(F.lit(1 - C.MYELIN_RATE / C.MYELIN_MAX), n)))
    vertices = vertices.withColumn("activation", F.least(F.lit(1.0), n * 0.1)).withColumn("contexts", F.slice("contexts", F.greatest(F.size("contexts") - 9, F.lit(1)), 10))
    return State(vertices, both_ways(learned_pairs(log, snapping=False, captured=False)))


def sessions(log: DataFrame) -> DataFrame:
    return log.groupBy("session_id").agg(F.min("at").alias("started_at"), F.count("*").alias("total_accesses"), F.sum("token_cost").alias("tokens_used"))


def tool_chains(log: DataFrame, last: int = 10) -> DataFrame:
    """By session its last tools in order. Only the last are kept of each group, by rank, before they are gathered."""
    tools = log.filter("type = 'tool'").withColumn("back", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("at"), F.desc("id")))).filter(F.col("back") <= last)
    return tools.groupBy("session_id").agg(F.reverse(F.transform(F.array_sort(F.collect_list(F.struct("back", "path"))), lambda x: x["path"])).alias("chain"))


def predict_next(state: State, tool: str, top_tools: int = 3, top_files: int = 5) -> DataFrame:
    """(id, type, confidence): what comes after a tool, by the strength of its edges."""
    near = state.edges.filter((F.col("source_id") == tool) & (F.col("weight") >= C.STRONG_EDGE)).join(state.vertices.select(F.col("id").alias("target_id"), "type", "myelination"), "target_id")
    scored = near.select(F.col("target_id").alias("id"), "type", F.least(F.col("weight") * (1 + F.col("myelination")), F.lit(C.CONFIDENCE_CAP)).alias("confidence")).filter(F.col("type").isin("tool", "file"))
    ranked = scored.withColumn("k", F.row_number().over(Window.partitionBy("type").orderBy(F.desc("confidence"), "id")))
    return ranked.filter(F.col("k") <= F.when(F.col("type") == "tool", top_tools).otherwise(top_files)).drop("k")


def seeded_edges(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """edges and seeds (source_id, target_id, weight, n), both ways: the greater weight stays, counts add up."""
    both = seeds.unionByName(seeds.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), "weight", "n"))
    new = both.select("source_id", "target_id", F.least(F.greatest("weight", F.lit(0.0)), F.lit(1.0)).alias("weight"), F.col("n").cast("bigint").alias("co_access_count"))
    return edges.select("source_id", "target_id", "weight", "co_access_count").unionByName(new).groupBy("source_id", "target_id").agg(F.max("weight").alias("weight"), F.sum("co_access_count").alias("co_access_count"))


def seeded_vertices(vertices: DataFrame, seeds: DataFrame) -> DataFrame:
    """vertices and seeds (id, type, path, context): a known vertex keeps what it has learned and gains the context."""
    # Of a vertex's new contexts only as many are gathered as it may hold.
    ranked = seeds.select("id", "context").distinct().withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("context")))).filter(F.col("k") <= C.CONTEXTS_APPENDED)
    lists = ranked.groupBy("id").agg(F.array_sort(F.collect_list("context")).alias("told"))
    told = seeds.groupBy("id").agg(F.min("type").alias("new_type"), F.min("path").alias("new_path")).join(lists, "id")
    joined = vertices.select("id", "type", "path", "activation", "myelination", "access_count", "contexts").join(told, "id", "full_outer")
    contexts = S.first_distinct(F.concat(F.coalesce("contexts", F.array().cast("array<string>")), F.coalesce("told", F.array().cast("array<string>"))), C.CONTEXTS_APPENDED)
    return joined.select(
        "id", F.coalesce("type", "new_type").alias("type"), F.coalesce("path", "new_path").alias("path"), F.coalesce("activation", F.lit(0.5)).alias("activation"),
        F.coalesce("myelination", F.lit(0.0)).alias("myelination"), F.coalesce("access_count", F.lit(0)).alias("access_count"), F.when(F.col("told").isNull(), F.col("contexts")).otherwise(contexts).alias("contexts"),
    )


def resolved_edges(edges: DataFrame, fixes: DataFrame) -> DataFrame:
    """edges after fixes (error_id, fix_id, fingerprint_id) were told: strong edges between an error and its fix, and
    from the error's fingerprint to the fix."""
    strong = lambda a, b: fixes.select(F.col(a).alias("source_id"), F.col(b).alias("target_id")).distinct()
    told = strong("error_id", "fix_id").unionByName(strong("fix_id", "error_id")).unionByName(strong("fingerprint_id", "fix_id"))
    told = told.groupBy("source_id", "target_id").agg(F.count("*").alias("told"))
    joined = edges.select("source_id", "target_id", "weight", "co_access_count").join(told, ["source_id", "target_id"], "full_outer")
    step = lambda w, _: S.saturating_add(w, F.lit(C.RESOLVED_WEIGHT))
    times = F.when(F.coalesce("told", F.lit(0)) > 0, F.sequence(F.lit(1).cast("bigint"), F.col("told"))).otherwise(F.array().cast("array<bigint>"))
    return joined.select("source_id", "target_id", F.aggregate(times, F.coalesce("weight", F.lit(0.0)), step).alias("weight"), (F.coalesce("co_access_count", F.lit(0)) + F.coalesce("told", F.lit(0))).alias("co_access_count"))


def errors_told(errors: DataFrame) -> DataFrame:
    """Accesses, as a log has them, for errors (session_id, at, id, message): each is recorded as its normal form and,
    right after, as its fingerprint, of which the normal form is the context. Their numbers are 2 * id and 2 * id + 1."""
    normal, print_ = S.normalize_error(F.col("message")), S.error_fingerprint(F.col("message"))
    each = errors.select("session_id", "at", "id", F.explode(F.array(F.struct(F.lit(0).alias("k"), normal.alias("path"), F.col("message").alias("context")), F.struct(F.lit(1).alias("k"), print_.alias("path"), normal.alias("context")))).alias("e"))
    return each.select((F.col("id") * 2 + F.col("e.k")).alias("id"), "session_id", F.concat(F.lit("error:"), "e.path").alias("vertex"), F.lit("error").alias("type"), "e.path", "e.context", "at", F.lit(C.TOKENS_OTHER).cast("bigint").alias("token_cost"))


def wired_errors(edges: DataFrame, errors: DataFrame) -> DataFrame:
    """edges after errors (message) were recorded: strong edges both ways between an error and its fingerprint. One that
    is there gains a boosted impulse each time."""
    ends = errors.select(F.concat(F.lit("error:"), S.normalize_error(F.col("message"))).alias("s"), F.concat(F.lit("error:"), S.error_fingerprint(F.col("message"))).alias("t")).filter("s <> t")
    told = ends.unionByName(ends.select(F.col("t").alias("s"), F.col("s").alias("t"))).groupBy(F.col("s").alias("source_id"), F.col("t").alias("target_id")).agg(F.count("*").alias("told"))
    joined = edges.select("source_id", "target_id", "weight", "co_access_count").join(told, ["source_id", "target_id"], "full_outer")
    # n impulses of one size in closed form; the first makes an edge that isn't there.
    left = lambda w, n: 1 - (1 - w) * F.pow(F.lit(1 - C.LEARNING_RATE * C.ERROR_BOOST), n)
    new = F.when(F.col("told").isNull(), F.col("weight")).when(F.col("weight").isNull(), left(F.lit(C.RESOLVED_WEIGHT), F.col("told") - 1)).otherwise(left(F.col("weight"), F.col("told")))
    return joined.select("source_id", "target_id", F.least(new, F.lit(1.0)).alias("weight"), (F.coalesce("co_access_count", F.lit(0)) + F.coalesce("told", F.lit(0))).alias("co_access_count"))


def by_idle_time(log: DataFrame, minutes: int = 15) -> DataFrame:
    """log with sessions that end by idle time: session_id becomes the old one, # and the number of the stretch. A long
    session is worked on in ranges."""
    timed = neighbours(log, "session_id", ["at", "id"], {"_before": ("at", -1)})
    new = F.coalesce(F.col("at") - F.col("_before") >= F.make_dt_interval(mins=F.lit(minutes)), F.lit(True))
    stretched = running(timed, "session_id", new.cast("bigint"), "_k")
    return stretched.withColumn("session_id", F.concat(F.col("session_id").cast("string"), F.lit("#"), F.col("_k").cast("string"))).drop("_before", "_k", "ord")


def ignored_by_session(recalled: DataFrame, opened: DataFrame, hours: int = 2) -> DataFrame:
    """(session_id, id): what sessions recalled (session_id, id, at) and did not open (session_id, id, at) within the
    time after which their recall is forgotten."""
    seen = opened.select("session_id", "id", F.col("at").alias("opened"))
    soon = (F.col("opened") >= F.col("at")) & (F.col("opened") <= F.col("at") + F.make_dt_interval(hours=F.lit(hours)))
    met = recalled.join(seen, ["session_id", "id"], "left").groupBy("session_id", "id").agg(F.max(F.coalesce(soon, F.lit(False))).alias("met"))
    return met.filter("not met").select("session_id", "id")


def changes(readings: DataFrame) -> DataFrame:
    """Readings (source, at, id, value) that differ from the one before of their source: what is emitted on change."""
    seen = neighbours(readings, "source", ["at", "id"], {"_before": ("value", -1)})
    return seen.filter("value is not null and not (value <=> _before)").drop("_before", "ord")


def error_fixes(state: State, error_id: str) -> DataFrame:
    """(id, confidence): what an error's edges lead to that is no tool and sure enough."""
    near = state.edges.filter((F.col("source_id") == error_id) & (F.col("weight") >= C.STRONG_EDGE)).join(state.vertices.select(F.col("id").alias("target_id"), "type", "myelination"), "target_id")
    sure = F.least(F.col("weight") * (1 + F.col("myelination")), F.lit(C.CONFIDENCE_CAP))
    return near.filter("type <> 'tool'").select(F.col("target_id").alias("id"), sure.alias("confidence")).filter(F.col("confidence") >= C.CONFIDENCE_GATE)


def weakened(edges: DataFrame, ignored: DataFrame, factor: Column) -> DataFrame:
    """edges after what was recalled and not opened, ignored (id, streak): each end that was weakens the edge by
    factor(streak), to a floor that no edge goes below by it."""
    by = ignored.select("id", factor.alias("f"))
    ends = edges.join(by.select(F.col("id").alias("source_id"), F.col("f").alias("f1")), "source_id", "left").join(by.select(F.col("id").alias("target_id"), F.col("f").alias("f2")), "target_id", "left")
    w = F.col("weight") * F.coalesce("f1", F.lit(1.0)) * F.coalesce("f2", F.lit(1.0))
    touched = (F.col("f1").isNotNull() | F.col("f2").isNotNull()) & (F.col("weight") > C.IGNORED_FLOOR)
    return ends.withColumn("weight", F.when(touched, F.greatest(w, F.lit(C.IGNORED_FLOOR))).otherwise(F.col("weight"))).drop("f1", "f2")


def streaks(before: DataFrame, recalled: DataFrame, opened: DataFrame) -> DataFrame:
    """(id, streak): ignore streaks, before (id, streak), after a session recalled and opened some (id): one more if
    ignored, none if opened."""
    hit = recalled.distinct().join(opened.distinct().withColumn("opened", F.lit(True)), "id", "left")
    now = before.join(hit.withColumn("recalled", F.lit(True)), "id", "full_outer")
    return now.select("id", F.when(F.col("opened"), 0).when(F.col("recalled"), F.coalesce("streak", F.lit(0)) + 1).otherwise(F.coalesce("streak", F.lit(0))).cast("bigint").alias("streak"))


def tagged_projects(vertices: DataFrame, root: str, project: str) -> DataFrame:
    """vertices with the files below a root tagged; what has been tagged elsewhere keeps its project."""
    known = F.col("project") if "project" in vertices.columns else F.lit(None).cast("string")
    below = (F.col("type") == "file") & F.col("path").startswith(root.rstrip("/") + "/")
    return vertices.withColumn("project", F.when(below, project).otherwise(known))


def session_keywords(texts: DataFrame, top: int = 20) -> DataFrame:
    """By session_id the most frequent words that say something, of texts (session_id, text): frequency, then first place."""
    words = texts.select("session_id", "seq", F.posexplode(F.split(F.lower("text"), r"\s+")).alias("pos", "raw"))
    words = words.select("session_id", F.struct("seq", "pos").alias("place"), F.regexp_replace("raw", r"[^a-z0-9_.\-]", "").alias("word")).filter((F.length("word") >= 3) & ~F.col("word").isin(C.STOPWORDS))
    counted = words.groupBy("session_id", "word").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    ranked = counted.withColumn("k", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("n"), "first"))).filter(F.col("k") <= top)
    return ranked.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "word"))), lambda x: x["word"]), " ").alias("keywords"))
