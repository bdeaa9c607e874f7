"""Recall: ranked vertices for a query, by words, vectors, spreading activation, habit and episodes.

A query is a row of driver parameters; candidates, scores, hops and merges are joins and filters over the vertices and
edges. Only a token budget is a fold, over the few ranked results of a query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import scalars as S
from ..sources.shared import kept
from .learning import State
from .reports import stale_alert

RESULT = ["id", "type", "path", "confidence", "activation_path"]


def _words(query: str, least: int = 3) -> list[str]:
    return [w for w in query.lower().split() if len(w) >= least]


def _literals(words: list[str]) -> Column:
    return F.array(*(F.lit(w) for w in words)) if words else F.array().cast("array<string>")


def _age(at: Column, as_of: str) -> Column:
    return (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(at.cast("timestamp"))) / 3.6e9


def context_matches(vertices: DataFrame, query: str, top: int = 10, paths: bool = False) -> DataFrame:
    """For each word of the query the `top` vertices by myelination that have it in a context (or path)."""
    words = _literals(_words(query))
    where = F.lower(F.array_join("contexts", " ")) if not paths else F.lower(F.concat_ws(" ", F.array_join("contexts", " "), "path"))
    each = vertices.withColumn("word", F.explode(F.filter(words, lambda w: F.contains(where, w))))
    ranked = each.withColumn("k", F.row_number().over(Window.partitionBy("word").orderBy(F.desc("myelination"), "id"))).filter(F.col("k") <= top)
    return ranked.filter("type <> 'tool'").dropDuplicates(["id"]).drop("word", "k")


def stem_matches(vertices: DataFrame, query: str) -> DataFrame:
    """Vertices with an embedding or a name that has a long word of the query in its stem."""
    words = _words(query, 4)
    return vertices.filter(F.exists(_literals(words), lambda w: F.contains(F.lower(S.stem(F.col("path"))), w)) & (F.col("type") != "tool"))


def vector_matches(vertices: DataFrame, query: DataFrame) -> DataFrame:
    """Vertices (with embedding) near to the query's one row (query); tools are no results."""
    near = S.cosine(F.col("embedding"), F.col("query")) > C.SIMILAR
    return vertices.filter("type <> 'tool' and embedding is not null").join(F.broadcast(query)).filter(near).drop("query")


def within_budget(ranked: DataFrame, budget: int, order: list[Column], columns: list[str] = RESULT) -> DataFrame:
    """The results that a token budget allows, taken in order; one that costs too much is passed over.

    Of results of one cost no more than the budget pays for can be taken: the others go by rank before the rest, so
    many at most, is gathered and gone through in order."""
    cost = S.token_cost(F.col("type"))
    placed = ranked.select(*columns, *(c.alias(f"_o{i}") for i, c in enumerate(order)), cost.alias("_cost"))
    keys = [f"_o{i}" for i in range(len(order))]
    k = F.row_number().over(Window.partitionBy("_cost").orderBy(*keys))
    some = placed.withColumn("_k", k).filter(F.col("_k") * F.col("_cost") <= budget)
    listed = some.agg(F.array_sort(F.collect_list(F.struct(*keys, "_cost", *columns))).alias("l"))
    start = F.struct(F.lit(budget).alias("left"), F.array().cast(listed.schema["l"].dataType).alias("out"))
    taken = F.aggregate("l", start, lambda a, x: F.when(x["_cost"] <= a["left"], F.struct((a["left"] - x["_cost"]).alias("left"), F.concat(a["out"], F.array(x)).alias("out"))).otherwise(a), lambda a: a["out"])
    return listed.select(F.explode(taken).alias("x")).select(*(F.col(f"x.{c}").alias(c) for c in columns))


def direct(state: State, query: str, as_of: str, type_: str | None = None, vector: DataFrame | None = None) -> DataFrame:
    """Candidates by word, by stem, and by the query's vector (one row: query) where one is given; scored and gated."""
    found = context_matches(state.vertices, query).unionByName(stem_matches(state.vertices, query))
    similar = None
    if vector is not None:
        found = found.unionByName(vector_matches(state.vertices, vector))
        similar = F.when(F.col("embedding").isNotNull(), S.cosine(F.col("embedding"), F.col("query")))
    found = found.dropDuplicates(["id"])
    found = found if vector is None else found.join(F.broadcast(vector))
    found = found if type_ is None else found.filter(F.col("type") == type_)
    score = S.confidence(_literals(_words(query)), F.col("contexts"), F.col("path"), F.col("myelination"), _age(F.col("last_accessed"), as_of), similar)
    return found.withColumn("confidence", score).filter(F.col("confidence") >= C.CONFIDENCE_GATE).withColumn("activation_path", F.lit("direct")).select(*RESULT)


def fingerprint_hits(state: State, query: str, type_: str | None = None) -> DataFrame:
    """What the fingerprint of the query, taken as an error, has edges to."""
    key = F.concat(F.lit("error:"), S.error_fingerprint(F.lit(query)))
    near = state.edges.filter((F.col("source_id") == key) & (F.col("weight") >= C.STRONG_EDGE)).join(state.vertices.select(F.col("id").alias("target_id"), "type", "path", "myelination"), "target_id").filter("type <> 'tool'")
    near = near if type_ is None else near.filter(F.col("type") == type_)
    sure = F.least(F.col("weight") * (1 + F.col("myelination")), F.lit(C.CONFIDENCE_CAP))
    return near.select(F.col("target_id").alias("id"), "type", "path", sure.alias("confidence"), F.lit("fingerprint").alias("activation_path")).filter(F.col("confidence") >= C.CONFIDENCE_GATE)


def onward(edges: DataFrame) -> DataFrame:
    """(source_id, target_id, weight, fan): by source the edges that spreading takes, and by how much their number
    divides it. The degree counts all edges of the source, in a sum of its own: the rank prunes before the shuffle."""
    degrees = edges.groupBy("source_id").agg(F.count("*").alias("degree"))
    ranked = edges.withColumn("k", F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("weight"), "target_id")))
    strong = ranked.filter((F.col("k") <= C.FAN_OUT) & (F.col("weight") >= C.STRONG_EDGE))
    return strong.join(degrees, "source_id").select("source_id", "target_id", "weight", (1 / F.sqrt(F.least("degree", F.lit(C.FAN_CAP)))).alias("fan"))


def spread(state: State, seeds: DataFrame, type_: str | None = None, hops: int = C.HOPS, budget: int | None = None) -> DataFrame:
    """seeds (RESULT) and what activation reaches from them, hop by hop: a join each. What is active already keeps its
    path and takes the greater confidence; it spreads with the confidence it was found with, and its way is told.

    budget: the tokens that are left for what is found: the surest seeds' strongest edges come first, as long as it
    lasts. None: no limit."""
    ways = onward(state.edges)
    targets = state.vertices.filter("type <> 'tool'").select(F.col("id").alias("target_id"), F.col("type").alias("to_type"), F.col("path").alias("to_path"), "myelination")
    targets = targets if type_ is None else targets.filter(F.col("to_type") == type_)
    known, frontier = seeds, seeds.select("id", F.col("path").alias("chain"), "confidence")
    for hop in range(1, hops + 1):
        c = F.col("confidence") * F.col("weight") * (1 + F.least(F.col("myelination"), F.lit(C.MYELIN_CAP))) * F.col("fan")
        reached = frontier.withColumnRenamed("id", "source_id").join(ways, "source_id").join(targets, "target_id").withColumn("c", c).filter(F.col("c") >= C.CONFIDENCE_GATE)
        # First found is found by the surest seed, over its strongest edge.
        first = F.struct((-F.col("confidence")).alias("o1"), F.col("source_id").alias("o2"), (-F.col("weight")).alias("o3"))
        best = reached.groupBy("target_id").agg(F.max("c").alias("most"), F.min(first).alias("o"), F.min_by(F.struct("to_type", "to_path", "chain", "c"), first).alias("x"))
        cap = F.lit(C.CONFIDENCE_CAP)
        best = best.select(
            F.col("target_id").alias("id"), F.col("x.to_type").alias("t"), F.col("x.to_path").alias("p"), F.least("x.c", cap).alias("found"), F.least("most", cap).alias("most"),
            F.concat(F.lit(f"spread({hop}) via "), "x.chain").alias("via"), F.concat("x.chain", F.lit(" → "), "x.to_path").alias("chain"), "o",
        )
        joined = known.join(best, "id", "full_outer").withColumn("new", F.col("confidence").isNull())
        joined = kept(joined.select("id", F.coalesce("type", "t").alias("type"), F.coalesce("path", "p").alias("path"), F.greatest("confidence", "most").alias("confidence"), F.coalesce("activation_path", "via").alias("activation_path"), "found", "chain", "o", "new"))
        if budget is not None:
            paid = kept(within_budget(joined.filter("new"), budget, [F.col("o"), F.col("id")], [*RESULT, "found", "chain"]))
            budget -= paid.agg(F.sum(S.token_cost(F.col("type")))).first()[0] or 0
            frontier, known = paid.select("id", "chain", F.col("found").alias("confidence")), joined.filter("not new").select(*RESULT).unionByName(paid.select(*RESULT))
        else:
            frontier, known = joined.filter("new").select("id", "chain", F.col("found").alias("confidence")), joined.select(*RESULT)
    return known


def habitual(vertices: DataFrame, limit: int, type_: str | None = None) -> DataFrame:
    """The most myelinated vertices, for want of better: of the first `limit` those that are no tools and sure enough;
    with k, the place among all."""
    some = vertices if type_ is None else vertices.filter(F.col("type") == type_)
    top = some.orderBy(F.desc("myelination"), "id").limit(limit).withColumn("k", F.row_number().over(Window.orderBy(F.desc("myelination"), "id")))
    sure = top.filter("type <> 'tool'").withColumn("confidence", F.col("myelination") * 0.5).filter("confidence >= 0.15")
    return sure.withColumn("activation_path", F.lit("myelinated")).select(*RESULT, "k")


def episodic(log: DataFrame, vertices: DataFrame, query: str, as_of: str, limit: int = 5) -> DataFrame:
    """Files of the latest sessions in which a word of the query was asked for, by how often and how recently."""
    words = _literals(_words(query))
    asked = log.filter(F.exists(words, lambda w: F.contains(F.lower("context"), w)) & (_age(F.col("at"), as_of) < 168))
    latest = asked.groupBy("session_id").agg(F.max("at").alias("last")).orderBy(F.desc("last"), "session_id").limit(10).select("session_id")
    seen = log.join(latest, "session_id", "left_semi").groupBy("vertex").agg(F.count("*").alias("n"), F.max("at").alias("last")).orderBy(F.desc("n"), "vertex").limit(2 * limit)
    c = F.least(F.least(F.col("n") / 5, F.lit(1.0)) * (0.5 + F.greatest(F.lit(0.0), 1 - _age(F.col("last"), as_of) / 168) * 0.5), F.lit(1.0))
    sure = seen.withColumn("confidence", c).filter(F.col("confidence") >= C.CONFIDENCE_GATE)
    files = vertices.filter("type = 'file'").select("id", "type", "path")
    return sure.join(files, sure.vertex == files.id).withColumn("activation_path", F.lit("episodic")).orderBy(F.desc("confidence"), "id").limit(limit).select(*RESULT)


def merged(*parts: DataFrame) -> DataFrame:
    """One result a vertex: the first part's path, the greatest confidence."""
    every = None
    for k, part in enumerate(parts):
        part = part.withColumn("part", F.lit(k))
        every = part if every is None else every.unionByName(part)
    return every.groupBy("id").agg(F.min_by("type", "part").alias("type"), F.min_by("path", "part").alias("path"), F.max("confidence").alias("confidence"), F.min_by("activation_path", "part").alias("activation_path"))


def similar(vectors: DataFrame, query: DataFrame, least: float = C.SNIPPET_SIMILAR, top: int = 10) -> DataFrame:
    """(id, confidence) of vectors (id, embedding) nearest to the query's one row (query). One row is broadcast."""
    scored = vectors.join(F.broadcast(query)).select("id", S.cosine(F.col("embedding"), F.col("query")).alias("confidence"))
    return scored.filter(F.col("confidence") >= least).orderBy(F.desc("confidence"), "id").limit(top)


def with_snippets(results: DataFrame, snippets: DataFrame, files: DataFrame) -> DataFrame:
    """results with what snippets (parent, confidence) tell of their files: agreement counts for a bonus."""
    best = snippets.groupBy("parent").agg(F.max("confidence").alias("snippet"))
    joined = results.join(best.withColumnRenamed("parent", "id"), "id", "full_outer").join(files.filter("type = 'file'").select("id", F.col("type").alias("t"), F.col("path").alias("p")), "id", "left")
    both = F.least(F.greatest("confidence", "snippet") * 1.15, F.lit(C.CONFIDENCE_CAP))
    told = F.when(F.col("snippet").isNull(), F.col("confidence")).when(F.col("confidence").isNull(), F.col("snippet")).otherwise(both)
    how = F.when(F.col("snippet").isNull(), F.col("activation_path")).when(F.col("confidence").isNull(), "snippet").otherwise(F.concat("activation_path", F.lit(" +snippet")))
    return joined.filter("confidence is not null or t is not null").select("id", F.coalesce("type", "t").alias("type"), F.coalesce("path", "p").alias("path"), told.alias("confidence"), how.alias("activation_path"))


def embedded(texts: DataFrame, size: int = 64) -> DataFrame:
    """(id, embedding): a vector of unit length from the words of texts (id, text), for where no model is at hand:
    words counted by hash. Each word is looked at once; a text without words has no vector."""
    words = texts.select("id", F.explode(F.split(F.lower("text"), r"[^\p{L}\p{N}]+")).alias("w")).filter("w <> ''")
    slot = (F.conv(F.substring(F.md5("w"), 1, 6), 16, 10).cast("bigint") % size).cast("int")
    counts = words.groupBy("id", slot.alias("slot")).agg(F.count("*").cast("double").alias("n"))
    by = counts.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "n"))).alias("m"), F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    return by.select("id", F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0.0)) / F.col("norm")).alias("embedding"))


def recall(state: State, log: DataFrame, query: str, as_of: str, limit: int = 5, budget: int = 10000, type_: str | None = None, vector: DataFrame | None = None, snippets: DataFrame | None = None) -> DataFrame:
    """The whole of it, surest first. vector: the query's, one row (query), for vertices that have an embedding;
    snippets: (parent, confidence) of what the query's vector finds in snippets."""
    first = direct(state, query, as_of, type_, vector)
    if type_ in (None, "error"):
        first = merged(fingerprint_hits(state, query, type_), first)
    by_print = (F.col("activation_path") != "fingerprint").cast("int")
    seeds = kept(within_budget(first, budget, [by_print, -F.col("confidence"), F.col("id")]))
    left = budget - (seeds.agg(F.sum(S.token_cost(F.col("type")))).first()[0] or 0)
    active = kept(spread(state, seeds, type_, budget=left))
    few = active.agg(F.count("*").alias("n"))
    fallback = habitual(state.vertices, limit, type_).join(F.broadcast(few)).filter(f"k <= {limit} - n").join(active, "id", "left_anti").select(*RESULT)
    told = episodic(log, state.vertices, query, as_of, min(limit, 3))
    told = told if type_ is None else told.filter(F.col("type") == type_)
    out = merged(active, fallback, told)
    out = out if snippets is None else with_snippets(out, snippets, state.vertices)
    return out.orderBy(F.desc("confidence"), "id").limit(limit).select(*RESULT)


#: The way of what an error's own edges lead to.
RESOLVED = "error→fix (resolved)"


def fixes(state: State, log: DataFrame, message: str, as_of: str, limit: int = 5, budget: int = 5000, vector: DataFrame | None = None) -> DataFrame:
    """What may fix an error, surest first: the files that recall finds for its normal form within the budget, and those
    that the error's own edges lead to. The error's memory is that after continual.record_errors()."""
    normal = message_normal(state, message)
    files = kept(recall(state, log, normal, as_of, limit, budget, "file", vector))
    near = state.edges.filter((F.col("source_id") == f"error:{normal}") & (F.col("weight") >= C.STRONG_EDGE)).select(F.col("target_id").alias("id"), "weight")
    sure = F.least(F.col("weight") * (1 + F.col("myelination")), F.lit(C.CONFIDENCE_CAP))
    known = near.join(state.vertices.filter("type = 'file'").select("id", "type", "path", "myelination"), "id").join(files, "id", "left_anti")
    told = known.withColumn("confidence", sure).filter(F.col("confidence") >= C.CONFIDENCE_GATE).withColumn("activation_path", F.lit(RESOLVED))
    return files.unionByName(told.select(*RESULT)).orderBy(F.desc("confidence"), "id")


def message_normal(state: State, message: str) -> str:
    """The normal form of one message, as vertices of errors have it."""
    return state.vertices.sparkSession.range(1).select(S.normalize_error(F.lit(message)).alias("n")).first().n


def recall_in_project(state: State, project: str, results: DataFrame) -> DataFrame:
    """Those of recall()'s results whose vertex is tagged with the project."""
    mine = state.vertices.filter(F.col("project") == project).select("id")
    return results.join(mine, "id", "left_semi")


def performed(results: DataFrame, commits: DataFrame, vertices: DataFrame, limit: int = 5, least: float = 0.5, root: str | None = None) -> DataFrame:
    """What a session is told: of recall()'s results, of which three times as many are asked for, those that are sure
    enough and no low-signal files; files outside the root count for three tenths. Where fewer than `limit` are left,
    files that commits (path, confidence) predict fill up, at nine tenths."""
    sure = results.filter((F.col("confidence") >= least) & ~((F.col("type") == "file") & S.is_low_signal(F.col("path"))))
    if root is not None:
        outside = (F.col("type") == "file") & ~F.col("path").startswith(root.rstrip("/") + "/")
        sure = sure.withColumn("confidence", F.when(outside, F.col("confidence") * 0.3).otherwise(F.col("confidence"))).filter(F.col("confidence") >= least)
    sure = sure.orderBy(F.desc("confidence"), "id").limit(limit)
    files = vertices.filter("type = 'file'").select("id", "type", "path")
    told = commits.groupBy("path").agg((F.max("confidence") * 0.9).alias("confidence")).join(files, "path").join(sure, "id", "left_anti")
    few = sure.agg(F.count("*").alias("n"))
    told = told.orderBy(F.desc("confidence"), "id").limit(limit).withColumn("k", F.row_number().over(Window.orderBy(F.desc("confidence"), "id")))
    filled = told.join(F.broadcast(few)).filter(f"k <= {limit} - n").withColumn("activation_path", F.lit("commit")).select(*RESULT)
    return sure.select(*RESULT).unionByName(filled).orderBy(F.desc("confidence"), "id").limit(limit)


def session_message(results: DataFrame, vertices: DataFrame, as_of: str, alerts: int = 3, least: float = 0.15) -> DataFrame:
    """(kind, text, confidence, myelin) of what a session is told: performed()'s results with their path and, in
    hundredths, how sure they are and how well known, and the alert of what is known well and getting stale, if any.
    Tools are never results, so none are preferred."""
    share = lambda c: F.round(F.col(c) * 100).cast("int")
    known = results.join(vertices.select("id", "myelination"), "id")
    files = known.select(F.lit("result").alias("kind"), F.col("path").alias("text"), share("confidence").alias("confidence"), share("myelination").alias("myelin"))
    alert = stale_alert(vertices, as_of, alerts, least=least).filter("alert <> ''")
    none = F.lit(None).cast("int")
    return files.unionByName(alert.select(F.lit("alert").alias("kind"), F.col("alert").alias("text"), none.alias("confidence"), none.alias("myelin")))


def tracked(results: DataFrame, agent: int, session_id: str, at: str) -> DataFrame:
    """What a session was told, as streaming.state.ignored() takes it: files that were recalled, and when."""
    files = results.filter("type = 'file'")
    return files.select(F.lit(agent).cast("bigint").alias("agent"), F.lit(session_id).alias("session_id"), F.lit("recalled").alias("kind"), F.col("id").alias("name"), F.lit(at).cast("timestamp").alias("at"), F.xxhash64("id").alias("id"))


def recall_lite(state: State, query: str, as_of: str, limit: int = 5) -> DataFrame:
    """By the reduced engine: five seeds, no budget, no habit, no episodes."""
    words = _literals(_words(query))
    score = S.confidence_lite(words, F.col("contexts"), F.col("path"), F.col("myelination"), _age(F.col("last_accessed"), as_of))
    found = context_matches(state.vertices, query, top=20, paths=True).withColumn("confidence", score).filter(F.col("confidence") >= C.CONFIDENCE_GATE).withColumn("activation_path", F.lit("direct"))
    seeds = found.select(*RESULT).orderBy(F.desc("confidence"), "id").limit(5)
    return spread(state, seeds).orderBy(F.desc("confidence"), "id").limit(limit)


def consensus(recalled: DataFrame, committed: DataFrame, most: int = 2) -> DataFrame:
    """(id, confidence): files that recall and commits (id, confidence) agree on, or that recall alone is very sure of."""
    both = recalled.filter("type = 'file'").join(committed.select("id", F.lit(True).alias("told")), "id", "left")
    return both.filter("(told and confidence >= 0.6) or confidence >= 0.85").orderBy(F.desc("confidence"), "id").limit(most).select("id", "confidence")
