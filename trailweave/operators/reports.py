"""Reports: filters, rankings and aggregates over the log, the vertices, the edges and traces of tool calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import scalars as S
from .sequences import neighbours


def stats(vertices: DataFrame, edges: DataFrame, log: DataFrame) -> DataFrame:
    """One row of counts; each side is aggregated by itself to one row first."""
    v = vertices.agg(F.count("*").alias("vertices"), F.count(F.when(F.col("myelination") > 0.5, 1)).alias("superhighways"), F.avg("myelination").alias("avg_myelination"))
    e = edges.agg(F.count("*").alias("edges"))
    return v.join(F.broadcast(e)).join(F.broadcast(log.agg(F.count("*").alias("accesses"))))


def token_report(vertices: DataFrame) -> DataFrame:
    recalled = F.floor(F.col("access_count") * F.col("myelination"))
    sums = vertices.agg(F.sum(F.col("access_count") * 2000).alias("tokens_without"), F.sum(recalled * 1500 + (F.col("access_count") - recalled) * 2000).alias("tokens_with"))
    saved = F.col("tokens_without") - F.col("tokens_with")
    return sums.select("tokens_without", "tokens_with", saved.alias("tokens_saved"), F.when(F.col("tokens_without") > 0, saved / F.col("tokens_without") * 100).otherwise(0.0).alias("savings_pct"))


def coverage(rows: DataFrame, column: str) -> DataFrame:
    return rows.agg(F.count("*").alias("total"), F.count(column).alias("present")).withColumn("pct", F.when(F.col("total") > 0, F.col("present") / F.col("total") * 100).otherwise(0.0))


def hubs(edges: DataFrame, top: int = 10) -> DataFrame:
    return edges.groupBy("source_id").agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "source_id").limit(top)


def strongest(edges: DataFrame, vertices: DataFrame, per: int) -> DataFrame:
    """By source its `per` strongest edges, with what they lead to. WindowGroupLimit prunes before the shuffle."""
    k = F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("weight"), "target_id"))
    top = edges.withColumn("k", k).filter(F.col("k") <= per)
    return top.join(vertices.select(F.col("id").alias("target_id"), F.col("path").alias("target_path")), "target_id").select("source_id", "k", "target_path", "weight")


def graph_view(edges: DataFrame, vertices: DataFrame, most: int = 15, per: int = 3) -> DataFrame:
    """The most myelinated vertices, and the strongest edges of each that are not weak."""
    top = vertices.orderBy(F.desc("myelination"), "id").limit(most).select(F.col("id").alias("source_id"))
    return strongest(edges.filter("weight > 0.1").join(top, "source_id", "left_semi"), vertices, per)


def by_project(vertices: DataFrame) -> DataFrame:
    return vertices.groupBy(F.coalesce("project", F.lit("(none)")).alias("project")).agg(F.count("*").alias("vertices"))


def stale(vertices: DataFrame, as_of: str, days: int = 7, least: float = 0.1) -> DataFrame:
    """(id, myelination, days_idle, projected): learned files that nobody has come back to."""
    idle = (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(F.col("last_accessed").cast("timestamp"))) / 8.64e10
    old = vertices.filter((F.col("type") == "file") & (F.col("myelination") >= least) & (idle > days))
    return old.select("id", "myelination", F.round(idle).cast("bigint").alias("days_idle"), S.projected_myelin(F.col("myelination"), idle).alias("projected"))


def stale_alert(vertices: DataFrame, as_of: str, top: int = 5, days: int = 7, least: float = 0.1) -> DataFrame:
    """One row: the alert text for the `top` stale files, empty if there is none."""
    top_rows = stale(vertices, as_of, days, least).orderBy(F.desc("myelination"), "id").limit(top)
    line = F.format_string("%s (%d days)", F.element_at(F.split("id", ":"), -1), F.col("days_idle"))
    return top_rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("myelination")).alias("m"), "id", line.alias("line")))), lambda x: x["line"]), ", ").alias("alert"))


def homeostasis_means(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    files = F.col("type") == "file"
    v = vertices.agg(F.avg(F.when(files, F.col("myelination"))).alias("avg_myelination"), F.avg(F.when(files & (F.col("access_count") > 0), F.col("access_count"))).alias("avg_accesses"))
    return v.join(F.broadcast(edges.agg(F.avg("weight").alias("avg_weight"))))


def replay_sessions(replay: DataFrame, last: int = 10) -> DataFrame:
    """(session_id, events, tools, errors, chars): the last sessions of tool calls."""
    return replay.groupBy("session_id").agg(
        F.count("*").alias("events"), F.countDistinct("tool_name").alias("tools"), F.sum(S.is_error(F.col("tool_result")).cast("int")).alias("errors"), F.sum(F.length("tool_result")).alias("chars")
    ).orderBy(F.desc("session_id")).limit(last)


def session_list(replay: DataFrame, last: int = 10) -> DataFrame:
    """(session_id, started_at, events, unique_files, errors): the sessions of tool calls (session_id, ts, tool_input as
    JSON, tool_result) that began last; a file is a path that an input names."""
    path = F.when(F.col("tool_input") != "", F.get_json_object("tool_input", "$.path"))
    return replay.groupBy("session_id").agg(
        F.min("ts").alias("started_at"), F.count("*").alias("events"), F.countDistinct(path).alias("unique_files"), F.sum(F.coalesce(S.is_error(F.col("tool_result")), F.lit(False)).cast("int")).alias("errors")
    ).orderBy(F.desc("started_at"), F.desc("session_id")).limit(last)


def replay_footer(replay: DataFrame) -> DataFrame:
    """How many calls, how many of them errors and, where they have a duration_ms, how long all took."""
    total = [F.coalesce(F.sum("duration_ms"), F.lit(0)).alias("total_ms")] if "duration_ms" in replay.columns else []
    return replay.agg(F.count("*").alias("events"), F.sum(S.is_error(F.col("tool_result")).cast("int")).alias("errors"), *total)


def numbered_replay(replay: DataFrame) -> DataFrame:
    """The sink's rows: seq counts up in each session; payloads are cut with a mark."""
    seq = F.row_number().over(Window.partitionBy("session_id").orderBy("seq")) - 1
    return replay.select("session_id", seq.cast("bigint").alias("seq"), "tool_name", S.payload(F.col("tool_result")).alias("tool_result"))


def token_metrics(vertices: DataFrame, price: float = 3.0) -> DataFrame:
    n, m = F.col("access_count"), F.col("myelination")
    sums = vertices.agg(F.sum(n).alias("n"), F.sum(n * F.least(m * 2.5, F.lit(1.0))).alias("served"), F.sum(F.when(m >= 0.5, n).otherwise(0)).alias("high"), F.sum(n * 2000).alias("without"), F.sum(F.floor(n * m) * 500).alias("saved"))
    return sums.select((F.col("saved") / F.col("without") * 100).alias("gross_pct"), (F.col("saved") * price / 1e6).alias("saved_usd"), (F.col("served") / F.col("n")).alias("recall_served"), (F.col("high") / F.col("n")).alias("high_confidence"))


def net_savings(vertices: DataFrame, recalls: int = 1) -> DataFrame:
    """net_pct: the share of tokens saved beyond what telling the results of so many recalls costs; 0 at least."""
    n, m = F.col("access_count"), F.col("myelination")
    sums = vertices.agg(F.sum(n * 2000).alias("without"), F.sum(F.floor(n * m) * 500).alias("saved"))
    net = (F.col("saved") - C.TOKENS_TOLD * C.RESULTS_TOLD * recalls) / F.col("without") * 100
    return sums.select(F.when(F.col("without") > 0, F.greatest(net, F.lit(0.0))).otherwise(0.0).alias("net_pct"))


def myelin_metrics(vertices: DataFrame) -> DataFrame:
    m = vertices.filter("myelination > 0")
    return m.agg(F.avg("myelination").alias("avg_m"), F.max("myelination").alias("max_m"), F.min("myelination").alias("min_m"), F.coalesce(F.stddev_samp("myelination"), F.lit(0.0)).alias("std_m"), F.count("*").alias("n"))


def histogram(rows: DataFrame, column: str) -> DataFrame:
    return rows.filter(F.col(column) > 0).groupBy(F.least(F.floor(F.col(column) * 10), F.lit(9)).cast("bigint").alias("bucket")).agg(F.count("*").alias("n"))


def network_metrics(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    return vertices.agg(F.count("*").alias("vertices")).join(F.broadcast(edges.agg(F.count("*").alias("edges"), F.avg("weight").alias("avg_weight"))))


def weight_by_count(edges: DataFrame) -> DataFrame:
    return edges.groupBy("co_access_count").agg(F.avg("weight").alias("mean_w"), F.coalesce(F.stddev_samp("weight"), F.lit(0.0)).alias("std_w"), F.count("*").alias("n"))


def spreading_depths(results: DataFrame) -> DataFrame:
    """By way of activation: how many results, which share, how sure."""
    depth = F.when(F.col("activation_path").startswith("spread"), F.concat(F.lit("hop"), F.regexp_extract("activation_path", r"\((\d)\)", 1))).otherwise(F.col("activation_path"))
    by = results.filter(F.col("type").isin("file", "error")).groupBy(depth.alias("depth")).agg(F.count("*").alias("n"), F.avg("confidence").alias("confidence"))
    return by.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))))


def precision_recall(got: DataFrame, expected: DataFrame) -> DataFrame:
    """Of got (query, id) and expected (query, id): tp, fp, fn, precision, recall and f1 over all queries."""
    both = got.withColumn("got", F.lit(1)).join(expected.withColumn("expected", F.lit(1)), ["query", "id"], "full_outer")
    n = lambda c: F.count(F.when(c, 1))
    is_got, is_expected = F.col("got").isNotNull(), F.col("expected").isNotNull()
    sums = both.agg(n(is_got & is_expected).alias("tp"), n(is_got & ~is_expected).alias("fp"), n(~is_got & is_expected).alias("fn"))
    share = lambda a, b: F.when(a + b > 0, a / (a + b)).otherwise(0.0)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return sums.withColumn("precision", share(tp, fp)).withColumn("recall", share(tp, fn)).withColumn("f1", F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(0.0))


def confusion(got: DataFrame, expected: DataFrame, failing: DataFrame) -> DataFrame:
    """Of got (query, id, type), expected (query, id) and failing (query), the queries that should find no file: tp, fp,
    fn, tn, precision and recall. Only files are found wrongly; a failing query that finds none is a true negative."""
    both = got.withColumn("got", F.lit(1)).join(expected.withColumn("expected", F.lit(1)), ["query", "id"], "full_outer")
    n = lambda c: F.count(F.when(c, 1))
    is_got, is_expected = F.col("got").isNotNull(), F.col("expected").isNotNull()
    sums = both.agg(n(is_got & is_expected).alias("tp"), n(is_got & ~is_expected & (F.col("type") == "file")).alias("fp"), n(~is_got & is_expected).alias("fn"))
    quiet = failing.join(got.filter("type = 'file'").select("query"), "query", "left_anti").agg(F.count("*").alias("tn"))
    share = lambda a, b: F.when(a + b > 0, a / (a + b)).otherwise(0.0)
    out = sums.join(F.broadcast(quiet))
    return out.withColumn("precision", share(F.col("tp"), F.col("fp"))).withColumn("recall", share(F.col("tp"), F.col("fn")))


def prediction_accuracy(log: DataFrame, edges: DataFrame) -> DataFrame:
    """How often the tool that follows a tool in a session is the first, or among the first three, of its edges."""
    uses = log.filter("type = 'tool'").select("session_id", "vertex", "at", "id")
    tools = neighbours(uses, "session_id", ["at", "id"], {"next": ("vertex", 1)}).filter("next is not null and next <> vertex").select("vertex", "next")
    strong = edges.filter(F.col("source_id").startswith("tool:") & F.col("target_id").startswith("tool:"))
    top = strong.withColumn("k", F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("weight"), "target_id"))).filter("k <= 3").select(F.col("source_id").alias("vertex"), F.col("target_id").alias("next"), "k")
    hit = tools.join(top, ["vertex", "next"], "left")
    return hit.agg(F.count("*").alias("tested"), F.count(F.when(F.col("k") == 1, 1)).alias("top1"), F.count("k").alias("top3"))


def runs(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Mean and spread of a value across runs, by checkpoint."""
    return rows.groupBy(key).agg(F.avg(value).alias("mean_v"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std_v"), F.count("*").alias("n"))


def top_by_myelin(vertices: DataFrame, top: int, type_: str | None = None) -> DataFrame:
    some = vertices if type_ is None else vertices.filter(F.col("type") == type_)
    return some.select("id", "type", "myelination").orderBy(F.desc("myelination"), "id").limit(top)


def recent_sessions(sessions: DataFrame, since: Column) -> DataFrame:
    return sessions.filter(F.col("started_at") >= since).orderBy(F.desc("started_at"))
