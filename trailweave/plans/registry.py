"""All registered queries and, where SQL can say the same, their oracles. Names begin with the operators' numbers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema
from .. import constants as C
from ..constants import ERROR_NORMAL, ERROR_OPERATIONS, ERROR_TYPES, OUTPUT_ERRORS, OUTPUT_NORMAL, STOPWORDS
from ..functions import scalars as S
from ..functions import vectors
from ..operators import continual, learning, maintenance, mining, nearest, postings, recall, reports
from ..operators.learning import State
from ..sources import events, repositories, tables
from ..sources import shared
from ..sources.shared import kept
from ..sources.store import MemoryStore, fingerprint
from ..sources.tables import AS_OF, access_log, table
from ..streaming import jobs, state
from . import oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, and the SQL that gives the same rows."""

    def registered(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return registered


def _vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.learned_vertices(access_log(spark, sf_dir))


def _store(spark: SparkSession, sf_dir: str, name: str) -> MemoryStore:
    """A memory store for what is learned of the events, under the digest of their files: events that change have
    another. It goes when the driver ends."""
    if shared.in_block():
        return continual.store(spark, shared.new_path(spark, "memory"))
    root = f"{shared.shared_dir(spark)}/memories/{name}-{fingerprint(spark, [f'{sf_dir}/events.parquet'])}"
    fs, at = shared._hadoop(spark, root)
    fs.deleteOnExit(at)
    return continual.store(spark, root)


def _state(spark: SparkSession, sf_dir: str) -> State:
    """The memory that the log gives, as a version that is there or is made: what works on it doesn't learn it again."""
    memories = _store(spark, sf_dir, "whole")
    return continual.read(memories, continual.learn_into(memories, access_log(spark, sf_dir), ("events", 0))).state


#: Where the log is cut for a memory that learns it in parts.
_CUTS = ("2024-01-04", "2024-01-16")


def _in_parts(spark: SparkSession, sf_dir: str) -> continual.Memory:
    """The memory after the log in three parts, each given twice, as a stream does that fails after it has written."""
    memories, log = _store(spark, sf_dir, "parts"), access_log(spark, sf_dir)
    # The number of cuts that an access comes at or after; what has no time comes first.
    part = sum((F.coalesce(F.col("at") >= F.lit(cut).cast("timestamp_ntz"), F.lit(False)).cast("int") for cut in _CUTS), F.lit(0))
    version = None
    for number in range(len(_CUTS) + 1):
        for _ in range(2):
            version = continual.learn_into(memories, log.filter(part == number), ("events", number))
    return continual.read(memories, version)


def _edges_out(edges: DataFrame) -> DataFrame:
    return edges.select("source_id", "target_id", F.round("weight", 6).alias("weight"), F.col("co_access_count").cast("bigint").alias("co_access_count"))


_EDGES_SQL = "select source_id, target_id, round(weight, 6) as weight, co_access_count::bigint as co_access_count from {}"
_M = "round(myelination, 6) as myelination"


def _m() -> Column:
    return F.round("myelination", 6).alias("myelination")


# Learning -----------------------------------------------------------------------------------------------------------


@query(oracle.with_edges(_EDGES_SQL.format("edges")))
def k01_learned_edges(spark, sf_dir):
    return _edges_out(learning.learned_edges(access_log(spark, sf_dir)))


@query(oracle.with_edges("select source_id, target_id, round(weight, 6) as weight, co_access_count::bigint as co_access_count, last_fired::varchar as last_fired from edges"))
def k01_continued_edges(spark, sf_dir):
    """Learning in parts, each from what the version before carries, gives what learning all at once does."""
    edges = _in_parts(spark, sf_dir).edges
    return _edges_out(edges.select("*")).join(edges.select("source_id", "target_id", F.col("last_fired").cast("string").alias("last_fired")), ["source_id", "target_id"])


@query(oracle.with_vertices(f"select v.id, v.type, v.path, round(v.myelination, 6) as myelination, v.access_count::bigint as access_count, v.last_accessed::varchar as last_accessed, c.contexts from vertices v join told c on c.vertex = v.id").replace(
    "\nselect v.id", """, firsts as (select vertex, context, min(row(ts, id)) as first from log group by 1, 2),
told as (select vertex, string_agg(context, ',' order by first, context) as contexts from (select *, row_number() over (partition by vertex order by first desc, context desc) as k from firsts) where k <= 20 group by 1)\nselect v.id"""))
def k01_continued_vertices(spark, sf_dir):
    v = _in_parts(spark, sf_dir).vertices
    return v.select("id", "type", "path", _m(), "access_count", F.col("last_accessed").cast("string").alias("last_accessed"), F.array_join("contexts", ",").alias("contexts"))


@query(oracle.with_log("""select session_id, vertex, type, id, k::int as k from (select *, row_number() over (partition by session_id order by ts desc, id desc) as k from (
  select *, row_number() over (partition by session_id, vertex order by ts desc, id desc) as again from log) where again = 1) where k <= 25"""))
def k02_carried_windows(spark, sf_dir):
    """What a memory that learned in parts carries of each session: its latest 25 vertices, k = 1 the latest."""
    k = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("at"), F.desc("id")))
    return _in_parts(spark, sf_dir).recent.select("session_id", "vertex", "type", "id", k.alias("k"))


@query(f"with {oracle.LOG}, {oracle.WINDOWS}, {oracle.FIRED} select e as id, count(*) as partners, max(case when n = 21 then first[2] end) as hub_id from (select *, row_number() over (partition by e order by first) as n from ends) where n <= 21 group by 1")
def k04_carried_partners(spark, sf_dir):
    """The first partners of each vertex, up to the one that makes it a hub, and the access that did."""
    partners = _in_parts(spark, sf_dir).partners
    n = F.row_number().over(Window.partitionBy("end").orderBy("first"))
    ranked = partners.select(F.col("end").alias("id"), n.alias("n"), F.col("first.id").alias("access"))
    return ranked.groupBy("id").agg(F.count("*").alias("partners"), F.max(F.when(F.col("n") == C.HUB_DEGREE + 1, F.col("access"))).alias("hub_id"))


@query(oracle.with_vertices(f"select id, type, path, {_M}, access_count::bigint as access_count from vertices"))
def k01_vertices(spark, sf_dir):
    return _vertices(spark, sf_dir).select("id", "type", "path", _m(), "access_count")


@query(f"with {oracle.LOG}, {oracle.WINDOWS} select recency::int as recency, count(*) as n, sum(len)::bigint as sum_len, count(distinct recent) as vertices from win group by 1")
def k02_windows(spark, sf_dir):
    w = learning.windows(access_log(spark, sf_dir))
    return w.groupBy("recency").agg(F.count("*").alias("n"), F.sum("len").alias("sum_len"), F.countDistinct("recent").alias("vertices"))


@query(f"with {oracle.LOG}, {oracle.WINDOWS}, {oracle.FIRED} select a, b, count(*) as n, round(sum(d), 6) as sum_d from damped group by a, b")
def k04_impulses(spark, sf_dir):
    return learning.impulses(access_log(spark, sf_dir)).groupBy("a", "b").agg(F.count("*").alias("n"), F.round(F.sum("d"), 6).alias("sum_d"))


@query(oracle.with_log("select vertex as id, count(distinct context) as n from log group by 1"))
def k09_contexts(spark, sf_dir):
    return _vertices(spark, sf_dir).select("id", F.size("contexts").cast("bigint").alias("n"))


_SEEDS = "select 'file:' || f1 as s, 'file:' || f2 as t, n, least(0.05::double + n::double / (select max(n) from cochanged) * 0.9::double, 0.95::double) as w from cochanged"
_COCHANGED = f"""{oracle.COMMITS},
noisy as (select commit, case when file like '%7' then 'node_modules/' || file else file end as file, case when commit % 11 = 0 then 'Merge ' || message else message end as message from commits),
told as (select * from noisy where not contains(lower(message), 'merge') and not contains(file, 'node_modules/')),
sized as (select commit from told group by 1 having count(*) between 2 and 20),
cochanged as (select x.file as f1, y.file as f2, count(*) as n from told x join told y on x.commit = y.commit and x.file < y.file where x.commit in (select commit from sized) group by 1, 2)"""


def _noisy_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits with merges among them, and with files that bulk mining skips."""
    commits = tables.commits(spark, sf_dir)
    file = F.when(F.col("file").endswith("7"), F.concat(F.lit("node_modules/"), "file")).otherwise(F.col("file"))
    return commits.select("commit", file.alias("file"), F.when(F.col("commit") % 11 == 0, F.concat(F.lit("Merge "), "message")).otherwise(F.col("message")).alias("message"))


@query(f"with {_COCHANGED}, seeds as ({_SEEDS}) select s as source_id, t as target_id, round(w, 6) as weight, n as co_access_count from seeds union all select t, s, round(w, 6), n from seeds")
def k08_seeded_edges(spark, sf_dir):
    none = spark.createDataFrame([], "source_id string, target_id string, weight double, co_access_count bigint")
    return _edges_out(learning.seeded_edges(none, mining.cochange_seeds(mining.cochanges(_noisy_commits(spark, sf_dir)))))


@query(oracle.with_vertices(f"""select coalesce(v.id, 'file:' || p.file) as id, coalesce(v.activation, 0.5::double) as activation, coalesce(round(v.myelination, 6), 0.0::double) as myelination
from vertices v full join (select distinct 'part/' || p_partkey as file from part) p on v.id = 'file:' || p.file"""))
def k07_seeded_vertices(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.concat(F.lit("part/"), F.col("p_partkey").cast("string")).alias("path"), F.col("p_name").alias("context"))
    seeds = parts.select(F.concat(F.lit("file:"), "path").alias("id"), F.lit("file").alias("type"), "path", "context")
    return learning.seeded_vertices(_vertices(spark, sf_dir), seeds).select("id", "activation", _m())


_FIX = "select e.id as error_id, f.id as fix_id from (select id, row_number() over (order by id) as k from vertices where type = 'error') e join (select id, row_number() over (order by id) as k from vertices where type = 'file') f on e.k = f.k"


@query(oracle.with_edges("""select coalesce(e.source_id, t.s) as source_id, coalesce(e.target_id, t.t) as target_id,
  round(case when t.s is null then e.weight else least(coalesce(e.weight, 0) + 0.85::double * (1 - coalesce(e.weight, 0)), 1.0::double) end, 6) as weight,
  (coalesce(co_access_count, 0) + case when t.s is null then 0 else 1 end)::bigint as co_access_count
from edges e full join told t on t.s = e.source_id and t.t = e.target_id""", f"fixes as ({_FIX})", "told as (select error_id as s, fix_id as t from fixes union all select fix_id, error_id from fixes union all select 'error:fp/' || error_id, fix_id from fixes)"))
def k11_resolved_errors(spark, sf_dir):
    state = _state(spark, sf_dir)
    k = F.row_number().over(Window.partitionBy("type").orderBy("id"))
    numbered = state.vertices.filter("type in ('error', 'file')").select("id", "type", k.alias("k"))
    errors, files = (numbered.filter(F.col("type") == t).select("k", F.col("id").alias(c)) for t, c in (("error", "error_id"), ("file", "fix_id")))
    fixes = errors.join(files, "k").withColumn("fingerprint_id", F.concat(F.lit("error:fp/"), "error_id"))
    return _edges_out(learning.resolved_edges(state.edges, fixes))


@query(oracle.with_edges("""select e.target_id as id, round(least(e.weight * (1 + v.myelination), 0.99::double), 6) as confidence from edges e join vertices v on v.id = e.target_id
where e.source_id = 'error:error/3' and e.weight >= 0.3 and v.type <> 'tool' and least(e.weight * (1 + v.myelination), 0.99) >= 0.4"""))
def k10_error_fixes(spark, sf_dir):
    return learning.error_fixes(_state(spark, sf_dir), "error:error/3").select("id", F.round("confidence", 6).alias("confidence"))


@query(oracle.with_edges("""select id, type, round(confidence, 6) as confidence from (
  select e.target_id as id, v.type, least(e.weight * (1 + v.myelination), 0.99::double) as confidence,
    row_number() over (partition by v.type order by least(e.weight * (1 + v.myelination), 0.99::double) desc, e.target_id) as k
  from edges e join vertices v on v.id = e.target_id where e.source_id = 'tool:purchase/7' and e.weight >= 0.3 and v.type in ('tool', 'file'))
where k <= case when type = 'tool' then 3 else 5 end"""))
def k12_predict_next(spark, sf_dir):
    return learning.predict_next(_state(spark, sf_dir), "tool:purchase/7").select("id", "type", F.round("confidence", 6).alias("confidence"))


@query(oracle.with_log("""select session_id, string_agg(path, ' ' order by k desc) as chain from (
  select *, row_number() over (partition by session_id order by ts desc, id desc) as k from log where type = 'tool') where k <= 10 group by 1"""))
def k13_tool_chains(spark, sf_dir):
    return learning.tool_chains(access_log(spark, sf_dir)).select("session_id", F.array_join("chain", " ").alias("chain"))


_LITE = """pairs as (select a, b, list(d order by ts, id, pos) as ds, count(*) as n from damped group by a, b),
folded as (select a, b, n, list_reduce(ds[2:], lambda w, d: least(w + d * (1 - w), 1.0::double), ds[1]) as weight from pairs)"""


@query(f"with {oracle.LOG}, {oracle.WINDOWS}, {oracle.FIRED}, {_LITE} select a as source_id, b as target_id, round(weight, 6) as weight, n::bigint as co_access_count from folded union all select b, a, round(weight, 6), n from folded")
def k14_lite_edges(spark, sf_dir):
    return _edges_out(learning.learned_lite(access_log(spark, sf_dir)).edges)


@query(oracle.with_vertices("select id, round(0.95::double * (1 - pow(1 - (0.02 / 0.95)::double, access_count)), 6) as myelination, round(least(1.0::double, access_count * 0.1::double), 6) as activation from vertices"))
def k14_lite_vertices(spark, sf_dir):
    return learning.learned_lite(access_log(spark, sf_dir)).vertices.select("id", _m(), F.round("activation", 6).alias("activation"))


_IGNORED = "ignored as (select id, (row_number() over (order by id) % 3 + 1) as streak from vertices where type = 'file' and path like 'view/1%')"


def _ignored(vertices: DataFrame) -> DataFrame:
    ids = vertices.filter("type = 'file' and path like 'view/1%'")
    return ids.select("id", (F.row_number().over(Window.partitionBy("type").orderBy("id")) % 3 + 1).alias("streak"))


def _weakened_sql(factor: str) -> str:
    return oracle.with_edges(f"""select source_id, target_id, round(case when (x.id is not null or y.id is not null) and weight > 0.1 then greatest(0.1::double, weight * coalesce({factor.format("x")}, 1) * coalesce({factor.format("y")}, 1)) else weight end, 6) as weight,
co_access_count::bigint as co_access_count from edges e left join ignored x on x.id = source_id left join ignored y on y.id = target_id""", _IGNORED)


@query(_weakened_sql("case when {0}.id is not null then 0.9::double end"))
def k15_ignored(spark, sf_dir):
    state = _state(spark, sf_dir)
    return _edges_out(learning.weakened(state.edges, _ignored(state.vertices), F.lit(0.9)))


@query(_weakened_sql("pow(0.9::double, {0}.streak)"))
def k16_ignored_again(spark, sf_dir):
    state = _state(spark, sf_dir)
    return _edges_out(learning.weakened(state.edges, _ignored(state.vertices), 1 - S.ignored_decay(F.col("streak"))))


@query(oracle.with_vertices(f"""select v.id, (case when v.path like '%/1' then 0 when v.path like '%/1%' then coalesce(i.streak, 0) + 1 else coalesce(i.streak, 0) end)::bigint as streak
from vertices v left join ignored i on i.id = v.id where v.type = 'file'""").replace("\nselect v.id", f", {_IGNORED}\nselect v.id"))
def k16_streaks(spark, sf_dir):
    files = kept(_vertices(spark, sf_dir).filter("type = 'file'"))
    before = files.select("id").join(_ignored(files), "id", "left")
    return learning.streaks(before, files.filter("path like '%/1%'").select("id"), files.filter("path like '%/1'").select("id"))


@query(oracle.with_vertices("select id, case when type = 'file' and path like 'view/%' then 'P' when type = 'file' and path like 'click/%' then 'Q' end as project from vertices"))
def k19_projects(spark, sf_dir):
    return learning.tagged_projects(learning.tagged_projects(_vertices(spark, sf_dir), "view", "P"), "click/", "Q").select("id", "project")


_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)


@query(f"""with words as (select conv_id as session_id, turn as seq, unnest(string_split_regex(lower(text), '\\s+')) as raw, generate_subscripts(string_split_regex(lower(text), '\\s+'), 1) as pos from conversations),
kept as (select session_id, seq, pos, regexp_replace(raw, '[^a-z0-9_.\\-]', '', 'g') as word from words),
counted as (select session_id, word, count(*) as n, min(row(seq, pos)) as first from kept where length(word) >= 3 and word not in ({_STOP}) group by 1, 2),
ranked as (select *, row_number() over (partition by session_id order by n desc, first) as k from counted)
select session_id, string_agg(word, ' ' order by k) as keywords from ranked where k <= 20 group by 1""")
def k20_session_keywords(spark, sf_dir):
    return learning.session_keywords(tables.replay(spark, sf_dir).withColumnRenamed("tool_result", "text"))


@query("select conv_id as session_id, substr(arg_min(text, turn), 1, 200) as intent from conversations where role = 'user' group by 1")
def k21_intents(spark, sf_dir):
    talks = table(spark, sf_dir, "conversations").filter("role = 'user'")
    return talks.groupBy(F.col("conv_id").alias("session_id")).agg(F.substring(F.min_by("text", "turn"), 1, 200).alias("intent"))


_IDLE = "date_diff('microsecond', last_accessed, timestamp '2024-02-20 00:00:00') / 86400000000.0::double"


@query(oracle.with_vertices(f"""select string_agg(path || ' (' || round({_IDLE})::bigint || ' days)', ', ' order by myelination desc, id) as alert from (
  select * from vertices where type = 'file' and myelination >= 0.1 and {_IDLE} > 7 order by myelination desc, id limit 5)"""))
def k22_stale_alert(spark, sf_dir):
    return reports.stale_alert(_vertices(spark, sf_dir), "2024-02-20 00:00:00")


_TEXTS = "select v.id, v.path || ' ' || string_agg(distinct l.context, ' ') as text from vertices v join log l on l.vertex = v.id where v.type <> 'tool' group by v.id, v.path"


@query(oracle.with_vertices(f"select id, slot, round(v, 6) as v from vec").replace("\nselect", ",\n" + oracle.hashed_vector("vec", _TEXTS) + "\nselect", 1))
def k23_embed_missing(spark, sf_dir):
    """Vectors for the vertices that have none yet, by slots that aren't zero; tools have theirs."""
    v = _vertices(spark, sf_dir).withColumn("embedding", F.when(F.col("type") == "tool", F.array(F.lit(1.0))))
    made = recall.embedded(v.filter("embedding is null").select("id", F.concat_ws(" ", "path", F.array_join("contexts", " ")).alias("text")))
    return made.select("id", F.posexplode("embedding").alias("slot", "v")).filter("v > 0").select("id", "slot", F.round("v", 6).alias("v"))


# Filters and rankings -----------------------------------------------------------------------------------------------


@query(oracle.with_vertices(f"select id, {_M} from vertices where type = 'file' and myelination >= 0.2"))
def l01_filtered_vertices(spark, sf_dir):
    return _vertices(spark, sf_dir).filter("type = 'file' and myelination >= 0.2").select("id", _m())


@query(oracle.with_edges(_EDGES_SQL.format("edges") + " where weight >= 0.6"))
def l02_filtered_edges(spark, sf_dir):
    return _edges_out(_state(spark, sf_dir).edges.filter("weight >= 0.6"))


@query(oracle.with_vertices(f"select id, {_M} from vertices where myelination >= 0.3 order by myelination desc"))
def l03_superhighways(spark, sf_dir):
    return _vertices(spark, sf_dir).filter("myelination >= 0.3").orderBy(F.desc("myelination")).select("id", _m())


@query(oracle.with_vertices(f"select id, type, {_M} from vertices where type = 'file' order by vertices.myelination desc, id limit 15"))
def l04_top_by_myelin(spark, sf_dir):
    return reports.top_by_myelin(_vertices(spark, sf_dir), 15, "file").withColumn("myelination", F.round("myelination", 6))


_TOLD = "told as (select v.*, string_agg(distinct l.context, ' ') as contexts from vertices v join log l on l.vertex = v.id group by all)"


def _matches_sql(top: int, where: str) -> str:
    return oracle.with_vertices(f"""select distinct id from (select id, type, row_number() over (partition by word order by myelination desc, id) as k
from told, (select unnest(['view', 'k17', 'error']) as word) where contains({where}, word)) where k <= {top} and type <> 'tool'""").replace("\nselect distinct", f", {_TOLD}\nselect distinct")


@query(_matches_sql(10, "lower(contexts)"))
def l05_context_search(spark, sf_dir):
    return recall.context_matches(_vertices(spark, sf_dir), "View k17 error").select("id")


@query(_matches_sql(20, "lower(contexts || ' ' || path)"))
def l06_search_lite(spark, sf_dir):
    return recall.context_matches(_vertices(spark, sf_dir), "View k17 error", top=20, paths=True).select("id")


def _each_sql(top: int, where: str, text: str) -> str:
    return oracle.with_vertices(f"""select distinct query_id, id from (select query_id, id, type, row_number() over (partition by query_id, word order by myelination desc, id) as k
from told, (select distinct context as query_id, unnest(string_split({text}, ' ')) as word from log) where length(word) >= 3 and contains({where}, word)) where k <= {top} and type <> 'tool'""").replace("\nselect distinct", f", {_TOLD}\nselect distinct")


@query(_each_sql(10, "lower(contexts)", "lower(context)"))
def l05_context_search_each(spark, sf_dir):
    """Every distinct context of the log as a query, all in one job."""
    queries = access_log(spark, sf_dir).select(F.col("context").alias("query_id"), F.col("context").alias("text")).distinct()
    return postings.matches_each(_vertices(spark, sf_dir), queries)


@query(_each_sql(20, "lower(contexts || ' ' || path)", "lower(replace(context, ' k', '/'))"))
def l06_search_lite_each(spark, sf_dir):
    """The same with paths, in the form in which paths have them."""
    queries = access_log(spark, sf_dir).select(F.col("context").alias("query_id"), F.replace("context", F.lit(" k"), F.lit("/")).alias("text")).distinct()
    return postings.matches_each(_vertices(spark, sf_dir), queries, top=20, paths=True)


@query(oracle.with_log("select vertex, max(ts)::varchar as last from log where session_id = 7 group by 1 order by max(ts) desc, vertex limit 20"))
def l07_session_recent(spark, sf_dir):
    mine = access_log(spark, sf_dir).filter("session_id = 7").groupBy("vertex").agg(F.max("at").alias("at")).orderBy(F.desc("at"), "vertex").limit(20)
    return mine.select("vertex", F.col("at").cast("string").alias("last"))


@query(oracle.with_vertices(f"select id, {_M}, round({_IDLE})::bigint as days_idle, round(vertices.myelination * pow(0.995::double, {_IDLE}), 3) as projected from vertices where type = 'file' and vertices.myelination >= 0.1 and {_IDLE} > 7"))
def l08_stale(spark, sf_dir):
    return reports.stale(_vertices(spark, sf_dir), "2024-02-20 00:00:00").withColumn("myelination", F.round("myelination", 6))


@query(oracle.with_vertices(f"select id, {_M} from vertices where path like 'click/%'"))
def l09_project_vertices(spark, sf_dir):
    return learning.tagged_projects(_vertices(spark, sf_dir), "click", "C").filter("project = 'C'").select("id", _m())


@query(oracle.with_log("select session_id, min(ts)::varchar as started_at, count(*) as total_accesses, sum(token_cost)::bigint as tokens_used from log group by 1 having min(ts) >= timestamp '2024-01-01 06:00:00'"))
def l11_recent_sessions(spark, sf_dir):
    s = reports.recent_sessions(learning.sessions(access_log(spark, sf_dir)), F.lit("2024-01-01 06:00:00").cast("timestamp_ntz"))
    return s.withColumn("started_at", F.col("started_at").cast("string"))


@query(oracle.with_vertices(f"select i.id, streak::bigint as streak from ignored i where streak > 1").replace("\nselect i.id", f", {_IGNORED}\nselect i.id"))
def l12_ignore_streaks(spark, sf_dir):
    return _ignored(_vertices(spark, sf_dir)).filter("streak > 1").withColumn("streak", F.col("streak").cast("bigint"))


@query("select conv_id::varchar as session_id from conversations where conv_id::varchar like '1%' group by 1 order by 1 limit 1")
def l13_session_prefix(spark, sf_dir):
    ids = tables.replay(spark, sf_dir).select(F.col("session_id").cast("string").alias("session_id")).distinct()
    return ids.filter(F.col("session_id").startswith("1")).orderBy("session_id").limit(1)


_STRONG = "strong as (select e.*, v.path as target_path, row_number() over (partition by source_id order by weight desc, target_id) as k from edges e join vertices v on v.id = e.target_id)"


@query(oracle.with_edges("select source_id, k::int as k, target_path, round(weight, 6) as weight from strong where k <= 3 and weight > 0.1 and source_id in (select id from vertices order by myelination desc, id limit 15)", _STRONG))
def l14_graph_view(spark, sf_dir):
    state = _state(spark, sf_dir)
    return reports.graph_view(state.edges, state.vertices).withColumn("weight", F.round("weight", 6))


# Joins --------------------------------------------------------------------------------------------------------------


@query(oracle.with_edges("select source_id, k::int as k, target_path, round(weight, 6) as weight from strong where k <= 5 and source_id in (select source_id from edges group by 1 order by count(*) desc, source_id limit 10)", _STRONG))
def j02_hub_connections(spark, sf_dir):
    state = _state(spark, sf_dir)
    top = reports.hubs(state.edges).select("source_id")
    return reports.strongest(state.edges.join(top, "source_id", "left_semi"), state.vertices, 5).withColumn("weight", F.round("weight", 6))


@query(oracle.with_log("""select n1, n2, count(*) as sessions from (select distinct x.session_id, x.vertex as n1, y.vertex as n2 from log x join log y on x.session_id = y.session_id and x.vertex < y.vertex
where x.ts > timestamp '2024-01-24 00:00:00') group by 1, 2 having count(*) >= 3"""))
def j03_session_pairs(spark, sf_dir):
    return mining.session_pairs(access_log(spark, sf_dir), "2024-01-24 00:00:00")


@query(oracle.with_log("""select x.vertex as n1, y.vertex as n2, count(*) as n, sum(abs(epoch_us(x.ts) - epoch_us(y.ts)))::bigint as total_us from log x join log y
on x.vertex < y.vertex and y.ts between x.ts - interval 600 second and x.ts + interval 600 second and abs(epoch_us(x.ts) - epoch_us(y.ts)) < 600000000
where x.ts > timestamp '2024-01-17 00:00:00' group by 1, 2 having count(*) >= 3"""))
def j04_close_pairs(spark, sf_dir):
    return mining.close_pairs(access_log(spark, sf_dir), 600, "2024-01-17 00:00:00").drop("avg_seconds")


_ORDERED = """ordered as (select session_id, vertex, ts, row_number() over (partition by session_id order by ts, id) as ord from log),
directions as (select x.vertex as first_id, y.vertex as second_id, count(*) as n from ordered x join ordered y on x.session_id = y.session_id and x.vertex <> y.vertex and y.ord between x.ord + 1 and x.ord + 5
where x.ts > timestamp '2024-01-17 00:00:00' group by 1, 2 having count(*) >= 5)"""


@query(f"with {oracle.LOG}, {_ORDERED} select * from directions")
def j05_ordered_pairs(spark, sf_dir):
    return mining.ordered_pairs(access_log(spark, sf_dir), since="2024-01-17 00:00:00")


@query(f"with {oracle.LOG}, {_ORDERED} select d.first_id, d.second_id, d.n, coalesce(r.n, 0) as back from directions d left join directions r on r.first_id = d.second_id and r.second_id = d.first_id where d.n > 2 * coalesce(r.n, 0)")
def j06_directional(spark, sf_dir):
    return mining.directional(mining.ordered_pairs(access_log(spark, sf_dir), since="2024-01-17 00:00:00"))


_SESSION_PAIRS = """session_pairs as (select n1, n2 from (select distinct x.session_id, x.vertex as n1, y.vertex as n2 from log x join log y on x.session_id = y.session_id and x.vertex < y.vertex
where x.ts > timestamp '{}') group by 1, 2 having count(*) >= {})"""


@query(f"with {oracle.LOG}, {_SESSION_PAIRS.format('2024-01-24 00:00:00', 3)} select x.n1 as a, x.n2 as b, y.n2 as c from session_pairs x join session_pairs y on y.n1 = x.n2 join session_pairs z on z.n1 = x.n1 and z.n2 = y.n2")
def j07_triangles(spark, sf_dir):
    return mining.triangles(mining.session_pairs(access_log(spark, sf_dir), "2024-01-24 00:00:00"))


@query("select p_partkey from part where p_partkey not in (select l_partkey from lineitem where l_shipdate < timestamp '1993-01-01')")
def j08_orphans(spark, sf_dir):
    used = table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") < F.lit("1993-01-01").cast("timestamp_ntz")).select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey").join(used, "p_partkey", "left_anti")


@query(oracle.with_log("select vertex, count(*) as n from log where session_id in (select session_id from log where context like '%k17' group by 1 order by max(ts) desc, session_id limit 10) group by 1"))
def j10_matched_sessions(spark, sf_dir):
    log = access_log(spark, sf_dir)
    latest = log.filter(F.col("context").endswith("k17")).groupBy("session_id").agg(F.max("at").alias("m")).orderBy(F.desc("m"), "session_id").limit(10).select("session_id")
    return log.join(latest, "session_id", "left_semi").groupBy("vertex").agg(F.count("*").alias("n"))


@query(f"with {oracle.COMMITS} select commit, string_agg(file, ',' order by file) as files from commits where file in (select 'part/' || p_partkey from part where p_size < 10) group by 1")
def j11_changesets(spark, sf_dir):
    known = table(spark, sf_dir, "part").filter("p_size < 10").select(F.concat(F.lit("part/"), F.col("p_partkey").cast("string")).alias("file"))
    return tables.commits(spark, sf_dir).join(known, "file", "left_semi").groupBy("commit").agg(F.array_join(F.array_sort(F.collect_set("file")), ",").alias("files"))


@query("select label::varchar as parent, round(max(c), 5) as confidence from (select e.label, greatest(-1.0, least(1.0, list_dot_product(e.embedding::double[], q.embedding::double[]))) as c from embeddings e, (select embedding from embeddings where vec_id = 0) q) where c >= 0.1 group by 1")
def j12_snippet_parents(spark, sf_dir):
    hits = _similar(spark, sf_dir, 0.1, 1 << 30)
    return hits.groupBy(F.col("label").cast("string").alias("parent")).agg(F.round(F.max("confidence"), 5).alias("confidence"))


def _similar(spark, sf_dir, least, top):
    vectors = table(spark, sf_dir, "embeddings")
    one = vectors.filter("vec_id = 0").select(F.col("embedding").alias("query")).limit(1)
    return recall.similar(vectors.withColumnRenamed("vec_id", "id"), one, least, top).join(vectors.select(F.col("vec_id").alias("id"), "label"), "id")


_EACH = "select q.vec_id as query_id, e.vec_id as id, e.label, greatest(-1.0, least(1.0, list_dot_product(e.embedding::double[], q.embedding::double[]))) as c from embeddings e, embeddings q where q.vec_id % 50 = 0"


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All vectors, and as queries those whose id is divisible by 50."""
    vectors_ = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id")
    return vectors_, vectors_.filter("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))


@query(f"select query_id, label::varchar as parent, round(max(c), 5) as confidence from ({_EACH}) where c >= 0.1 group by 1, 2")
def j12_snippet_parents_each(spark, sf_dir):
    hits = nearest.similar_each(*_vectors(spark, sf_dir), 0.1, group="label")
    return hits.select("query_id", F.col("label").cast("string").alias("parent"), F.round("confidence", 5).alias("confidence"))


@query(oracle.with_log("select distinct vertex from log where session_id = 3 except select vertex from log where session_id = 5"))
def j16_recalled_not_opened(spark, sf_dir):
    log = access_log(spark, sf_dir)
    return log.filter("session_id = 3").select("vertex").distinct().join(log.filter("session_id = 5").select("vertex"), "vertex", "left_anti")


@query(oracle.with_edges(_EDGES_SQL.format("edges") + " where source_id = 'file:view/3' or target_id = 'file:view/3'"))
def j17_touching_edges(spark, sf_dir):
    edges = _state(spark, sf_dir).edges
    return _edges_out(edges.filter("source_id = 'file:view/3'").unionByName(edges.filter("target_id = 'file:view/3' and source_id <> 'file:view/3'")))


# Aggregates ---------------------------------------------------------------------------------------------------------


@query(oracle.with_edges("select count(*) as vertices, count(*) filter (myelination > 0.5) as superhighways, round(avg(myelination), 6) as avg_myelination, (select count(*) from edges) as edges, (select count(*) from log) as accesses from vertices"))
def a01_stats(spark, sf_dir):
    log = access_log(spark, sf_dir)
    state = _state(spark, sf_dir)
    return reports.stats(state.vertices, state.edges, log).withColumn("avg_myelination", F.round("avg_myelination", 6))


@query(oracle.with_vertices("""select sum(access_count * 2000)::bigint as tokens_without, sum(floor(access_count * myelination) * 1500 + (access_count - floor(access_count * myelination)) * 2000)::bigint as tokens_with,
sum(floor(access_count * myelination) * 500)::bigint as tokens_saved, round(sum(floor(access_count * myelination) * 500) / sum(access_count * 2000) * 100, 6) as savings_pct from vertices"""))
def a02_token_report(spark, sf_dir):
    r = reports.token_report(_vertices(spark, sf_dir))
    return r.select(*(F.col(c).cast("bigint").alias(c) for c in ("tokens_without", "tokens_with", "tokens_saved")), F.round("savings_pct", 6).alias("savings_pct"))


@query("select count(*) as total, count(l.quality) as present, round(count(l.quality)::double / count(*) * 100, 6) as pct from documents d left join labels l on l.doc_id = d.doc_id")
def a03_coverage(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return reports.coverage(rows, "quality").withColumn("pct", F.round("pct", 6))


@query(oracle.with_edges("select source_id, count(*) as degree from edges group by 1 order by 2 desc, 1 limit 10"))
def a04_hubs(spark, sf_dir):
    return reports.hubs(_state(spark, sf_dir).edges)


@query(oracle.with_vertices("select case when path like 'view/%' then 'P' else '(none)' end as project, count(*) as vertices from vertices group by 1"))
def a05_projects(spark, sf_dir):
    return reports.by_project(learning.tagged_projects(_vertices(spark, sf_dir), "view", "P"))


_ERR = "regexp_matches(tool_result, '(?i)error|failed|traceback|exception')"


@query(f"with {oracle.REPLAY} select session_id, count(*) as events, count(distinct tool_name) as tools, sum({_ERR}::int)::bigint as errors, sum(length(tool_result))::bigint as chars from replay group by 1 order by 1 desc limit 10")
def a06_replay_sessions(spark, sf_dir):
    return reports.replay_sessions(tables.replay(spark, sf_dir))


@query(f"with {oracle.REPLAY} select count(*) as events, sum({_ERR}::int)::bigint as errors from replay")
def a07_replay_footer(spark, sf_dir):
    return reports.replay_footer(tables.replay(spark, sf_dir))


@query(oracle.with_log("select session_id, count(*) as total_accesses, sum(token_cost)::bigint as tokens_used from log group by 1"))
def a08_session_counters(spark, sf_dir):
    return learning.sessions(access_log(spark, sf_dir)).drop("started_at")


@query(oracle.with_edges("select round(avg(myelination) filter (type = 'file'), 6) as avg_myelination, round(avg(access_count) filter (type = 'file'), 6) as avg_accesses, (select round(avg(weight), 6) from edges) as avg_weight from vertices"))
def a09_homeostasis_means(spark, sf_dir):
    state = _state(spark, sf_dir)
    means = reports.homeostasis_means(state.vertices, state.edges)
    return means.select(*(F.round(c, 6).alias(c) for c in means.columns))


@query(oracle.with_log("select count(distinct session_id) as sessions, count(*) as accesses from log where session_id::varchar like '1%'"))
def a10_source_counters(spark, sf_dir):
    mine = access_log(spark, sf_dir).filter(F.col("session_id").cast("string").startswith("1"))
    return mine.agg(F.countDistinct("session_id").alias("sessions"), F.count("*").alias("accesses"))


@query(oracle.with_vertices("""select round(sum(floor(access_count * myelination) * 500) / sum(access_count * 2000) * 100, 6) as gross_pct, round(sum(floor(access_count * myelination) * 500) * 3.0::double / 1e6, 6) as saved_usd,
round(sum(access_count * least(myelination * 2.5::double, 1)) / sum(access_count), 6) as recall_served, round(sum(case when myelination >= 0.5 then access_count else 0 end)::double / sum(access_count), 6) as high_confidence from vertices"""))
def a11_token_metrics(spark, sf_dir):
    r = reports.token_metrics(_vertices(spark, sf_dir))
    return r.select(*(F.round(c, 6).alias(c) for c in r.columns))


@query(oracle.with_vertices("select round(avg(myelination), 6) as avg_m, round(max(myelination), 6) as max_m, round(min(myelination), 6) as min_m, round(stddev_samp(myelination), 6) as std_m, count(*) as n from vertices where myelination > 0"))
def a12_myelin_metrics(spark, sf_dir):
    r = reports.myelin_metrics(_vertices(spark, sf_dir))
    return r.select(*(F.round(c, 6).alias(c) if c != "n" else c for c in r.columns))


@query(oracle.with_vertices("select least(floor(myelination * 10), 9)::bigint as bucket, count(*) as n from vertices where myelination > 0 group by 1"))
def a12_histogram(spark, sf_dir):
    return reports.histogram(_vertices(spark, sf_dir), "myelination")


@query(oracle.with_edges("select (select count(*) from vertices) as vertices, count(*) as edges, round(avg(weight), 6) as avg_weight from edges"))
def a13_network_metrics(spark, sf_dir):
    state = _state(spark, sf_dir)
    return reports.network_metrics(state.vertices, state.edges).withColumn("avg_weight", F.round("avg_weight", 6))


@query(oracle.with_edges("select co_access_count::bigint as co_access_count, round(avg(weight), 6) as mean_w, round(coalesce(stddev_samp(weight), 0), 6) as std_w, count(*) as n from edges group by 1"))
def a14_weight_by_count(spark, sf_dir):
    r = reports.weight_by_count(_state(spark, sf_dir).edges)
    return r.select("co_access_count", F.round("mean_w", 6).alias("mean_w"), F.round("std_w", 6).alias("std_w"), "n")


_GOT = "got as (select session_id as query, vertex as id from log where id % 3 <> 0 group by all), expected as (select session_id as query, vertex as id from log where id % 3 <> 1 group by all)"


@query(oracle.with_log("""select *, round(2 * tp / (2 * tp + fp + fn)::double, 6) as f1, round(tp / (tp + fp)::double, 6) as precision, round(tp / (tp + fn)::double, 6) as recall from (
select count(*) filter (g.id is not null and e.id is not null) as tp, count(*) filter (e.id is null) as fp, count(*) filter (g.id is null) as fn from got g full join expected e on g.query = e.query and g.id = e.id)""").replace("\nselect *", f", {_GOT}\nselect *", 1))
def a16_precision_recall(spark, sf_dir):
    log = access_log(spark, sf_dir)
    pick = lambda k: log.filter(F.col("id") % 3 != k).select(F.col("session_id").alias("query"), F.col("vertex").alias("id")).distinct()
    r = reports.precision_recall(pick(0), pick(1))
    return r.select("tp", "fp", "fn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query(oracle.with_edges("""select count(*) as tested, count(*) filter (k = 1) as top1, count(k) as top3 from (select * from (select vertex, lead(vertex) over (partition by session_id order by ts, id) as nx from log where type = 'tool') where nx <> vertex) t
left join tops on tops.source_id = t.vertex and tops.target_id = t.nx""", "tops as (select * from (select source_id, target_id, row_number() over (partition by source_id order by weight desc, target_id) as k from edges where source_id like 'tool:%' and target_id like 'tool:%') where k <= 3)"))
def a17_prediction_accuracy(spark, sf_dir):
    log = access_log(spark, sf_dir)
    return reports.prediction_accuracy(log, kept(learning.learned_edges(log)))


@query("select o_orderpriority as run, round(avg(o_totalprice), 4) as mean_v, round(stddev_samp(o_totalprice), 4) as std_v, count(*) as n from orders group by 1")
def a18_runs(spark, sf_dir):
    r = reports.runs(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice")
    return r.select(F.col("o_orderpriority").alias("run"), F.round("mean_v", 4).alias("mean_v"), F.round("std_v", 4).alias("std_v"), "n")


@query(f"with {oracle.COMMITS} select count(*) as commits, count(*) >= 20 as enabled from (select commit from commits where length(message) >= 5 group by commit having count(*) between 2 and 20)")
def a19_commit_count(spark, sf_dir):
    n = mining.indexed_commits(tables.commits(spark, sf_dir)).agg(F.count("*").alias("commits"))
    return n.withColumn("enabled", F.col("commits") >= 20)


@query("select count(*) as total, count(*) filter (label < 5) as embedded from embeddings")
def a21_snippet_counts(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").agg(F.count("*").alias("total"), F.count(F.when(F.col("label") < 5, 1)).alias("embedded"))


# Maintenance --------------------------------------------------------------------------------------------------------


def _vertices_out(vertices: DataFrame) -> DataFrame:
    return vertices.select("id", F.round("activation", 6).alias("activation"), _m())


_DECAYED = """v1 as (select * replace (activation * 0.85::double as activation, myelination * 0.995::double as myelination) from vertices),
e1 as (select * replace (weight * 0.98::double as weight) from edges)"""


@query(oracle.with_edges("select id, round(activation, 6) as activation, round(myelination, 6) as myelination from v1", _DECAYED))
def m01_decayed_vertices(spark, sf_dir):
    return _vertices_out(maintenance.decayed(_state(spark, sf_dir)).vertices)


@query(oracle.with_edges(_EDGES_SQL.format("e1"), _DECAYED))
def m01_decayed_edges(spark, sf_dir):
    return _edges_out(maintenance.decayed(_state(spark, sf_dir)).edges)


def _faded(spark: SparkSession, sf_dir: str) -> State:
    """A memory that has mostly faded: upkeep finds something to do in it."""
    state = _state(spark, sf_dir)
    vertices = state.vertices.withColumn("activation", F.lit(0.05)).withColumn("myelination", F.col("myelination") * 0.12).withColumn("access_count", F.col("access_count") % 4)
    return State(vertices, state.edges.withColumn("weight", F.col("weight") * 0.4).withColumn("co_access_count", F.col("co_access_count") % 5))


_FADED = """fv as (select * replace (0.05::double as activation, myelination * 0.12::double as myelination, access_count % 4 as access_count) from vertices),
fe as (select * replace (weight * 0.4::double as weight, co_access_count % 5 as co_access_count) from edges)"""
_BRIDGED = """poor as (select id from fv where activation < 0.1 and myelination < 0.05 and type = 'file'),
bridged as (select * replace (case when weight < 0.3 and co_access_count <= 2 and target_id in (select id from poor) then greatest(weight * 0.8::double, 0.05::double) else weight end as weight) from fe)"""


@query(oracle.with_edges(_EDGES_SQL.format("bridged"), _FADED, _BRIDGED))
def m02_bridges(spark, sf_dir):
    return _edges_out(maintenance.bridges_weakened(_faded(spark, sf_dir)).edges)


@query(oracle.with_edges(_EDGES_SQL.format("fe") + """ where not (weight < 0.05 or (weight < 0.15 and co_access_count <= 1 and last_fired < timestamp '2024-02-25 00:00:00') or (weight < 0.3 and last_fired < timestamp '2024-01-29 00:00:00'))""", _FADED))
def m03_pruned_edges(spark, sf_dir):
    return _edges_out(maintenance.edges_pruned(_faded(spark, sf_dir), "2024-02-28 00:00:00").edges)


@query(oracle.with_edges("select count(*) as edges, (select count(*) from lv) as vertices from fe where source_id in (select id from lv) and target_id in (select id from lv)", _FADED, "lv as (select id from fv where not (activation < 0.06 and myelination < 0.01 and access_count < 2))".replace("activation < 0.06", "activation * 0.1 < 0.01")))
def m05_pruned_vertices(spark, sf_dir):
    state = _faded(spark, sf_dir)
    state = maintenance.vertices_pruned(state.but(vertices=state.vertices.withColumn("activation", F.col("activation") * 0.1)))
    return state.edges.agg(F.count("*").alias("edges")).join(F.broadcast(state.vertices.agg(F.count("*").alias("vertices"))))


_PRUNED = "not (weight < 0.05 or (weight < 0.15 and co_access_count <= 1 and last_fired < timestamp '2024-02-25 00:00:00') or (weight < 0.3 and last_fired < timestamp '2024-01-29 00:00:00'))"


@query(oracle.with_edges("select id from fv where not (type = 'file' and access_count < 3 and myelination < 0.05 and id not in (select source_id from ee union select target_id from ee))", _FADED, f"ee as (select * from fe where {_PRUNED})"))
def m06_orphans(spark, sf_dir):
    return maintenance.orphans_pruned(maintenance.edges_pruned(_faded(spark, sf_dir), "2024-02-28 00:00:00")).vertices.select("id")


_BALANCED = """means as (select avg(myelination) filter (type = 'file') as mm, avg(access_count) filter (type = 'file' and access_count > 0) as ma from vertices),
s1 as (select v.*, ma, v.myelination * case when type = 'file' and mm > 0.15 then 0.15::double / mm else 1 end as m1 from vertices v, means),
s2 as (select *, case when type = 'file' and access_count > ceil(ma * 3) then m1 * 0.9::double else m1 end as m2 from s1),
balanced as (select id, activation, case when type = 'file' and floor(ma / 3) > 0 and access_count < floor(ma / 3) and m2 > 0.05 then least(m2 * 1.05::double, 0.95::double) else m2 end as myelination from s2)"""


@query(oracle.with_edges("select id, round(activation, 6) as activation, round(myelination, 6) as myelination from balanced", _BALANCED))
def m07_balanced_vertices(spark, sf_dir):
    return _vertices_out(maintenance.balanced(_state(spark, sf_dir)).vertices)


@query(oracle.with_edges("select source_id, target_id, round(weight * case when (select avg(weight) from edges) > 0.35 then 0.35::double / (select avg(weight) from edges) else 1 end, 6) as weight, co_access_count::bigint as co_access_count from edges"))
def m07_balanced_edges(spark, sf_dir):
    return _edges_out(maintenance.balanced(_state(spark, sf_dir)).edges)


_REPLAYED = """busy as (select session_id from log where ts > timestamp '2024-01-24 00:00:00' group by 1 having count(*) >= 5 order by count(*) desc, session_id limit 5),
again as (select least(vertex, recent) as a, greatest(vertex, recent) as b, count(*) as n from win where recent <> vertex and session_id in (select session_id from busy) group by 1, 2),
both_again as (select a as s, b as t, n from again union all select b, a, n from again)"""


@query(oracle.with_edges("""select source_id, target_id, round(case when n is null then weight else list_reduce(range(1, n + 1)::double[], lambda w, k: least(w + 0.01::double / (1 + exp(8.0::double * (w - 0.5::double))) * (1 - w), 1.0::double), weight) end, 6) as weight,
(co_access_count + coalesce(n, 0))::bigint as co_access_count from edges left join both_again on s = source_id and t = target_id""", _REPLAYED))
def m08_replayed(spark, sf_dir):
    return _edges_out(maintenance.replayed(_state(spark, sf_dir), access_log(spark, sf_dir), AS_OF).edges)


@query(oracle.with_vertices("""select id, activation, round(case when m > 0.05 and type = 'file' and last_accessed < timestamp '2024-02-04 00:00:00' and last_accessed > timestamp '2024-01-29 00:00:00' then least(m + 0.02::double * (1 - m / 0.95::double) * greatest(1 / sqrt(access_count), 0.1::double) * 0.25::double, 0.95::double)
when m > 0.05 and type = 'file' and last_accessed < timestamp '2024-01-29 00:00:00' then m * 0.95::double else m end, 6) as myelination from (select *, myelination as m from vertices)"""))
def m09_reviewed(spark, sf_dir):
    return _vertices_out(maintenance.reviewed(State(_vertices(spark, sf_dir), spark.range(0)), "2024-02-05 00:00:00").vertices)


#: The moment up to which a young memory has learned, of a log that goes on.
_YOUNG = "2024-01-01 06:00:00"
_YOUNG_EDGES = "we as (select * replace (weight * 0.5::double as weight) from edges)"


def _young(spark: SparkSession, sf_dir: str) -> State:
    """A memory of the log's first hours, faded by half: consolidation finds edges to strengthen and to make."""
    log = access_log(spark, sf_dir).filter(F.col("at") < F.lit(_YOUNG).cast("timestamp_ntz"))
    learned = learning.learn(log)
    return State(learned.vertices, kept(learned.edges.withColumn("weight", F.col("weight") * 0.5)))


def _confirmed_part(edges: str, fresh: str, below: float, bump: float) -> str:
    return f"""select coalesce(e.source_id, p.s) as source_id, coalesce(e.target_id, p.t) as target_id,
case when p.s is null then weight when weight is null then {fresh} when weight < {below} then least(weight + {bump}::double * {oracle.snap("weight")} * (1 - weight), 1.0::double) else weight end as weight,
(coalesce(co_access_count, 0) + case when p.s is not null and (weight is null or weight < {below}) then 1 else 0 end)::bigint as co_access_count
from {edges} e full join both_pairs p on p.s = e.source_id and p.t = e.target_id"""


def _confirmed_sql(pairs: str, fresh: str, below: float, bump: float) -> str:
    return oracle.with_old_edges(_EDGES_SQL.format(f"({_confirmed_part('we', fresh, below, bump)})"), _YOUNG, _YOUNG_EDGES, pairs)


_BOTH_SESSION = "both_pairs as (select n1 as s, n2 as t from session_pairs union all select n2, n1 from session_pairs)"


@query(_confirmed_sql(_SESSION_PAIRS.format("2024-01-24 00:00:00", 3).replace("from log x join log y", "from full_log x join full_log y") + ", " + _BOTH_SESSION, "0.15::double", 0.2, 0.05))
def m10_cross_session(spark, sf_dir):
    return _edges_out(maintenance.cross_session(_young(spark, sf_dir), access_log(spark, sf_dir), AS_OF).edges)


def _close_sql(seconds: int, log: str = "log") -> str:
    return f"""close_pairs as (select x.vertex as n1, y.vertex as n2, avg(abs(epoch_us(x.ts) - epoch_us(y.ts)) / 1e6) as s from {log} x join {log} y
on x.vertex < y.vertex and y.ts between x.ts - interval {seconds} second and x.ts + interval {seconds} second and abs(epoch_us(x.ts) - epoch_us(y.ts)) < {seconds}000000 where x.ts > timestamp '2024-01-17 00:00:00' group by 1, 2 having count(*) >= 3),
both_close as (select n1 as s, n2 as t, close_pairs.s as sec from close_pairs union all select n2, n1, close_pairs.s from close_pairs)"""


@query(_confirmed_sql(_close_sql(600, "full_log").replace("both_close", "both_pairs"), "0.15::double + 0.15::double * (1 - least(sec, 600) / 600.0::double)", 0.3, 0.03))
def m11_temporal(spark, sf_dir):
    return _edges_out(maintenance.temporal(_young(spark, sf_dir), access_log(spark, sf_dir), AS_OF, 600).edges)


@query(oracle.with_edges(f"""select source_id, target_id, round(case when d.first_id is not null and weight > 0.1 and weight < 0.8 then least(weight + weight * 0.2::double * {oracle.snap("weight")} * (1 - weight), 1.0::double) else weight end, 6) as weight,
(co_access_count + case when d.first_id is not null and weight > 0.1 and weight < 0.8 then 1 else 0 end)::bigint as co_access_count
from edges e left join (select d.first_id, d.second_id from directions d left join directions r on r.first_id = d.second_id and r.second_id = d.first_id where d.n > 2 * coalesce(r.n, 0)) d on d.first_id = source_id and d.second_id = target_id""", _ORDERED))
def m12_directed(spark, sf_dir):
    return _edges_out(maintenance.directed(_state(spark, sf_dir), access_log(spark, sf_dir), AS_OF).edges)


_TRIPLES = _SESSION_PAIRS.format("2024-01-24 00:00:00", 3) + """,
capped as (select n1, n2 from (select *, row_number() over (partition by n1 order by n2) as k from session_pairs) where k <= 20),
triples as (select x.n1 as a, x.n2 as b, y.n2 as c from capped x join capped y on y.n1 = x.n2 join session_pairs z on z.n1 = x.n1 and z.n2 = y.n2),
sides as (select s, t, count(*) as n from (select a as s, b as t from triples union all select a, c from triples union all select b, c from triples) group by 1, 2),
both_sides as (select s, t, n from sides union all select t, s, n from sides)"""


@query(oracle.with_edges("""select source_id, target_id, round(case when n is null then weight else list_reduce(range(1, n + 1)::double[], lambda w, k: case when w < 0.5::double then least(w + 0.05::double / (1 + exp(8.0::double * (w - 0.5::double))) * (1 - w), 1.0::double) else w end, weight) end, 6) as weight,
co_access_count::bigint as co_access_count from edges left join both_sides on s = source_id and t = target_id""", _TRIPLES))
def m13_tripled(spark, sf_dir):
    return _edges_out(maintenance.tripled(_state(spark, sf_dir), access_log(spark, sf_dir), AS_OF).edges)


@query(oracle.with_log("select id from log where ts >= timestamp '2024-01-01 00:00:00' order by ts desc, id desc limit 5000"))
def m14_pruned_log(spark, sf_dir):
    return maintenance.log_pruned(access_log(spark, sf_dir), AS_OF).select("id")


_CYCLE = f"""dv as (select * replace (activation * 0.85::double as activation, myelination * 0.995::double as myelination) from fv),
de as (select * replace (weight * 0.98::double as weight) from fe),
poor as (select id from dv where activation < 0.1 and myelination < 0.05 and type = 'file'),
be as (select * replace (case when weight < 0.3 and co_access_count <= 2 and target_id in (select id from poor) then greatest(weight * 0.8::double, 0.05::double) else weight end as weight) from de),
pe as (select * from be where {_PRUNED}),
lv as (select * from dv where not (activation < 0.01 and myelination < 0.01 and access_count < 2)),
le as (select * from pe where source_id in (select id from lv) and target_id in (select id from lv)),
ov as (select * from lv where not (type = 'file' and access_count < 3 and myelination < 0.05 and id not in (select source_id from le union select target_id from le)))"""


@query(oracle.with_edges("select source_id, target_id, round(weight * case when (select avg(weight) from le) > 0.35 then 0.35::double / (select avg(weight) from le) else 1 end, 6) as weight, co_access_count::bigint as co_access_count from le", _FADED, _CYCLE))
def m15_decay_cycle(spark, sf_dir):
    return _edges_out(maintenance.decay(_faded(spark, sf_dir), "2024-02-28 00:00:00").edges)


@query(oracle.with_edges("select id from ov", _FADED, _CYCLE))
def m15_decay_cycle_vertices(spark, sf_dir):
    return maintenance.decay(_faded(spark, sf_dir), "2024-02-28 00:00:00").vertices.select("id")


_CONSOLIDATED = ", ".join([
    _REPLAYED,
    """re as (select source_id, target_id, case when n is null then weight else list_reduce(range(1, n + 1)::double[], lambda w, k: least(w + 0.01::double / (1 + exp(8.0::double * (w - 0.5::double))) * (1 - w), 1.0::double), weight) end as weight,
  co_access_count + coalesce(n, 0) as co_access_count from edges left join both_again on s = source_id and t = target_id)""",
    _SESSION_PAIRS.format("2024-01-24 00:00:00", 3), _BOTH_SESSION, f"ce as ({_confirmed_part('re', '0.15::double', 0.2, 0.05)})",
    _close_sql(60), f"te as ({_confirmed_part('ce', '0.15::double + 0.15::double * (1 - least(sec, 60) / 60.0::double)', 0.3, 0.03).replace('both_pairs', 'both_close')})",
    _ORDERED, f"""one_way as (select d.first_id, d.second_id from directions d left join directions r on r.first_id = d.second_id and r.second_id = d.first_id where d.n > 2 * coalesce(r.n, 0)),
oe as (select source_id, target_id, case when d.first_id is not null and weight > 0.1 and weight < 0.8 then least(weight + weight * 0.2::double * {oracle.snap("weight")} * (1 - weight), 1.0::double) else weight end as weight,
  co_access_count + case when d.first_id is not null and weight > 0.1 and weight < 0.8 then 1 else 0 end as co_access_count from te left join one_way d on d.first_id = source_id and d.second_id = target_id)""",
    """capped as (select n1, n2 from (select *, row_number() over (partition by n1 order by n2) as k from session_pairs) where k <= 20),
triples as (select x.n1 as a, x.n2 as b, y.n2 as c from capped x join capped y on y.n1 = x.n2 join session_pairs z on z.n1 = x.n1 and z.n2 = y.n2),
sides as (select s, t, count(*) as n from (select a as s, b as t from triples union all select a, c from triples union all select b, c from triples) group by 1, 2),
both_sides as (select s, t, n from sides union all select t, s, n from sides),
xe as (select source_id, target_id, case when n is null then weight else list_reduce(range(1, n + 1)::double[], lambda w, k: case when w < 0.5::double then least(w + 0.05::double / (1 + exp(8.0::double * (w - 0.5::double))) * (1 - w), 1.0::double) else w end, weight) end as weight,
  co_access_count from oe left join both_sides on s = source_id and t = target_id)""",
])


@query(oracle.with_edges(_EDGES_SQL.format("xe"), _CONSOLIDATED))
def m16_consolidation(spark, sf_dir):
    state, _ = maintenance.consolidate(_state(spark, sf_dir), access_log(spark, sf_dir), AS_OF)
    return _edges_out(state.edges)


# Mining and seeding -------------------------------------------------------------------------------------------------


@query(f"with {_COCHANGED} select f1, f2, n from cochanged")
def b01_cochanges(spark, sf_dir):
    return mining.cochanges(_noisy_commits(spark, sf_dir)).select("f1", "f2", "n")


@query(f"with {_COCHANGED}, seeds as ({_SEEDS}) select s as source_id, t as target_id, round(w, 6) as weight, n from seeds")
def b02_seeds(spark, sf_dir):
    return mining.cochange_seeds(mining.cochanges(_noisy_commits(spark, sf_dir))).withColumn("weight", F.round("weight", 6))


_KEYED = """named as (select distinct url as file, lower(regexp_replace(regexp_replace(string_split(url, '/')[-1], '\\.(test|spec|stories|story|styles|module|mock|stub|fixture|d)\\.', '.', 'i'), '\\.[^.]+$', '')) as key from pages),
groups as (select key from named group by 1 having count(*) between 2 and 8)"""


@query(f"with {_KEYED} select x.file as f1, y.file as f2 from named x join named y on x.key = y.key and x.file < y.file where x.key in (select key from groups)")
def b03_name_groups(spark, sf_dir):
    return mining.name_groups(table(spark, sf_dir, "pages").select(F.col("url").alias("file")))


@query("""with files as (select user_id, 'file:' || event_type || '/' || ((props->>'$.k')::bigint % 20) as file, min(event_id) as seq from events where event_type in ('view', 'click') group by all),
firsts as (select * from (select *, row_number() over (partition by user_id order by seq, file) as k from files) where k <= 20)
select distinct x.file as f1, y.file as f2 from firsts x join firsts y on x.user_id = y.user_id and x.file < y.file""")
def b04_session_seeds(spark, sf_dir):
    log = access_log(spark, sf_dir).filter("type = 'file'")
    return mining.session_file_pairs(log.select("session_id", F.col("id").alias("seq"), F.col("vertex").alias("file")))


@query(f"with {oracle.COMMITS} select 'semantic:commit:' || commit as id, any_value(message) || ' | files:' || string_agg(file, ',' order by file) as contexts from commits group by commit having count(*) between 2 and 20")
def b05_indexed_commits(spark, sf_dir):
    return mining.indexed_commits(tables.commits(spark, sf_dir)).select("id", F.array_join("contexts", " | ").alias("contexts"))


@query(f"with {_COCHANGED} select count(*) as edges, count(distinct f1) as sources from cochanged")
def b06_estimate(spark, sf_dir):
    return mining.cochanges(_noisy_commits(spark, sf_dir)).agg(F.count("*").alias("edges"), F.countDistinct("f1").alias("sources"))


# Recall -------------------------------------------------------------------------------------------------------------


_QUERY = "view k17 error"
#: What error_fingerprint() makes of the query: the vertex that is looked up before all else.
_PRINT = "error:GENERIC_ERROR|unknown"
_MEMORY_SQL = f"""told as (select v.*, string_agg(distinct l.context, ' ') as contexts from vertices v join log l on l.vertex = v.id group by all),
mv as (select case when id = 'error:error/3' then '{_PRINT}' else id end as id, type, case type when 'file' then 'src/' || replace(path, '/', '_') || '.ts' when 'error' then 'doc/' || replace(path, '/', '_') || '.md' else path end as path,
  myelination, access_count, last_accessed, contexts from told),
me as (select case when source_id = 'error:error/3' then '{_PRINT}' else source_id end as source_id, case when target_id = 'error:error/3' then '{_PRINT}' else target_id end as target_id, weight from edges),
{oracle.hashed_vector("vec", "select id, path || ' ' || contexts as text from mv")},
{oracle.hashed_vector("qvec", f"select 0 as id, '{_QUERY}' as text")},
sims as (select mv.id, greatest(-1.0::double, least(1.0::double, coalesce(sum(vec.v * qvec.v), 0))) as sim from mv left join vec on vec.id = mv.id left join qvec on qvec.slot = vec.slot group by mv.id),
words as (select unnest(['view', 'k17', 'error']) as word),
stems as (select id, lower(regexp_replace(string_split(path, '/')[-1], '\\.[^.]+$', '')) as stem from mv)"""
_AGE = "greatest(0, 1 - date_diff('microsecond', last_accessed, timestamp '2024-01-31 00:00:00') / 3.6e9::double / 168) * 0.2::double"
_SHARE = "(contains({0}, 'view')::int + contains({0}, 'k17')::int + contains({0}, 'error')::int) / 3.0::double"
_DIRECT_SQL = f"""{_MEMORY_SQL},
matched as (select id from (select id, type, row_number() over (partition by word order by myelination desc, id) as k from mv, words where contains(lower(contexts), word)) where k <= 10 and type <> 'tool'
  union select id from mv join stems using (id) where type <> 'tool' and (contains(stem, 'view') or contains(stem, 'error'))
  union select id from mv join sims using (id) where type <> 'tool' and sim > 0.25),
scored as (select id, type, path, case when named then greatest(greatest(sim, 0), 0.5::double) else greatest(sim, 0) end as ctx,
  least(myelination, 0.5::double) * 0.3::double + {_AGE} + {_SHARE.format("lower(path)")} * 0.4::double + case when named then 0.4::double else 0 end
  + case when regexp_matches(path, '\\.ts$') then 0.3::double when regexp_matches(path, '\\.md$') then -0.15::double else 0 end as bonus
  from (select mv.*, sim, contains(stem, 'view') or contains(stem, 'error') as named from mv join sims using (id) join stems using (id)) where id in (select id from matched)),
direct as (select id, type, path, least(ctx * (1 + bonus), 1.0::double) as c from scored where least(ctx * (1 + bonus), 1.0::double) >= 0.4)"""
_FIRST_SQL = f"""{_DIRECT_SQL},
printed as (select e.target_id as id, v.type, least(e.weight * (1 + v.myelination), 0.99::double) as c from me e join mv v on v.id = e.target_id where e.source_id = '{_PRINT}' and e.weight >= 0.3 and v.type <> 'tool' and least(e.weight * (1 + v.myelination), 0.99::double) >= 0.4),
seeds as (select id, any_value(type) as type, max(c) as c from (select id, type, c from printed union all select id, type, c from direct) group by id)"""


def _memory(spark: SparkSession, sf_dir: str) -> State:
    """The learned memory with names of files and notes, with vectors, and with an error known by its fingerprint."""
    state = _state(spark, sf_dir)
    name = F.regexp_replace("path", "/", "_")
    renamed = lambda c: F.when(F.col(c) == "error:error/3", _PRINT).otherwise(F.col(c))
    path = F.when(F.col("type") == "file", F.concat(F.lit("src/"), name, F.lit(".ts"))).when(F.col("type") == "error", F.concat(F.lit("doc/"), name, F.lit(".md"))).otherwise(F.col("path"))
    vertices = state.vertices.withColumn("id", renamed("id")).withColumn("path", path)
    vectors = recall.embedded(vertices.select("id", F.concat_ws(" ", "path", F.array_join("contexts", " ")).alias("text")))
    edges = state.edges.withColumn("source_id", renamed("source_id")).withColumn("target_id", renamed("target_id"))
    return State(kept(vertices.join(vectors, "id", "left")), edges)


def _vector(spark: SparkSession) -> DataFrame:
    return recall.embedded(spark.range(1).select("id", F.lit(_QUERY).alias("text"))).select(F.col("embedding").alias("query"))


def _results(df: DataFrame) -> DataFrame:
    return df.select("id", "type", F.round("confidence", 6).alias("confidence"))


@query(oracle.with_edges("select id, type, round(c, 6) as confidence from direct", _DIRECT_SQL))
def r01_direct(spark, sf_dir):
    return _results(recall.direct(_memory(spark, sf_dir), _QUERY, AS_OF, vector=_vector(spark)))


@query(oracle.with_edges("select id, type, round(c, 6) as confidence from printed", _FIRST_SQL))
def r00_fingerprint(spark, sf_dir):
    return _results(recall.fingerprint_hits(_memory(spark, sf_dir), _QUERY))


_SPARSE_SQL = ("2024-01-01 12:00:00", "se as (select * replace (greatest(weight, 0.97::double) as weight) from edges)", "seeds as (select id, type, 1.0::double as c from vertices where type <> 'tool' and path like '%/1%')", oracle.spread("se"))


def _sparse(spark: SparkSession, sf_dir: str) -> State:
    """The memory of half a day, with strong edges: few a vertex, so that activation goes on for several hops."""
    log = access_log(spark, sf_dir).filter(F.col("at") < F.lit(_SPARSE_SQL[0]).cast("timestamp_ntz"))
    learned = learning.learn(log)
    return State(kept(learned.vertices), kept(learned.edges.withColumn("weight", F.greatest("weight", F.lit(0.97)))))


def _spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = _sparse(spark, sf_dir)
    seeds = state.vertices.filter("path like '%/1%' and type <> 'tool'").select("id", "type", "path", F.lit(1.0).alias("confidence"), F.lit("direct").alias("activation_path"))
    return recall.spread(state, seeds)


@query(oracle.with_old_edges("select id, type, round(c, 6) as confidence from a3", *_SPARSE_SQL))
def r02_spread(spark, sf_dir):
    return _results(_spread(spark, sf_dir))


@query(oracle.with_old_edges("select case when hop = 0 then 'direct' else 'hop' || hop end as depth, count(*) as n, round(avg(c), 6) as confidence, round(count(*) / sum(count(*)) over (), 6) as share from a3 where type in ('file', 'error') group by hop", *_SPARSE_SQL))
def a15_spreading_depths(spark, sf_dir):
    depths = reports.spreading_depths(_spread(spark, sf_dir))
    return depths.select("depth", "n", F.round("confidence", 6).alias("confidence"), F.round("share", 6).alias("share"))


@query(oracle.with_vertices("select id, type, round(myelination * 0.5::double, 6) as confidence from (select * from vertices order by myelination desc, id limit 12) where type <> 'tool' and myelination * 0.5 >= 0.15"))
def r03_habitual(spark, sf_dir):
    return _results(recall.habitual(_vertices(spark, sf_dir), 12))


_EPISODIC = """asked as (select session_id from log where (contains(context, 'k17') or contains(context, 'error')) and ts > timestamp '2024-01-24 00:00:00' group by 1 order by max(ts) desc, session_id limit 10),
seen as (select vertex, count(*) as n, max(ts) as last from log where session_id in (select session_id from asked) group by 1 order by 2 desc, 1 limit 10)"""


@query(oracle.with_vertices("""select id, type, round(confidence, 6) as confidence from (select v.id, v.type, least(least(n / 5.0::double, 1) * (0.5::double + greatest(0, 1 - date_diff('microsecond', last, timestamp '2024-01-31 00:00:00') / 3.6e9::double / 168) * 0.5::double), 1.0::double) as confidence
from seen join vertices v on v.id = vertex where v.type = 'file') where confidence >= 0.4 order by confidence desc, id limit 5""").replace("\nselect id, type, round(confidence, 6)", f", {_EPISODIC}\nselect id, type, round(confidence, 6)", 1))
def r07_episodic(spark, sf_dir):
    return _results(recall.episodic(access_log(spark, sf_dir), _vertices(spark, sf_dir), "k17 error", AS_OF))


@query("select vec_id as id, round(c, 5) as confidence from (select e.vec_id, greatest(-1.0, least(1.0, list_dot_product(e.embedding::double[], q.embedding::double[]))) as c from embeddings e, (select embedding from embeddings where vec_id = 0) q) where c >= 0.2 order by c desc, 1 limit 10")
def r08_similar(spark, sf_dir):
    return _similar(spark, sf_dir, 0.2, 10).select("id", F.round("confidence", 5).alias("confidence"))


@query(f"select query_id, id, round(c, 5) as confidence from ({_EACH}) where c >= 0.2 qualify row_number() over (partition by query_id order by c desc, id) <= 10")
def r08_similar_each(spark, sf_dir):
    return nearest.similar_each(*_vectors(spark, sf_dir), 0.2, 10).select("query_id", "id", F.round("confidence", 5).alias("confidence"))


@query("""with files as (select 'file:part/' || p_partkey as id, 'file' as type from part),
near as (select e.label, greatest(-1.0, least(1.0, list_dot_product(e.embedding::double[], q.embedding::double[]))) as c, row_number() over (order by greatest(-1.0, least(1.0, list_dot_product(e.embedding::double[], q.embedding::double[]))) desc, e.vec_id) as k
  from embeddings e, (select embedding from embeddings where vec_id = 0) q where greatest(-1.0, least(1.0, list_dot_product(e.embedding::double[], q.embedding::double[]))) >= 0.1),
best as (select 'file:part/' || (label + 5) as id, max(c) as s from near where k <= 20 group by 1)
select f.id, f.type, round(case when s is null then 0.5::double when f.id not like '%7' then s else least(greatest(0.5::double, s) * 1.15::double, 0.99::double) end, 5) as confidence from files f left join best b on b.id = f.id where f.id like '%7' or s is not null""")
def r05_with_snippets(spark, sf_dir):
    files = table(spark, sf_dir, "part").select(F.concat(F.lit("file:part/"), F.col("p_partkey").cast("string")).alias("id"), F.lit("file").alias("type"), F.concat(F.lit("part/"), F.col("p_partkey").cast("string")).alias("path"))
    found = files.filter("path like '%7'").withColumn("confidence", F.lit(0.5)).withColumn("activation_path", F.lit("direct"))
    snippets = _similar(spark, sf_dir, 0.1, 20).select(F.concat(F.lit("file:part/"), (F.col("label") + 5).cast("string")).alias("parent"), "confidence")
    return recall.with_snippets(found, snippets, files).select("id", "type", F.round("confidence", 5).alias("confidence"))


_EPISODIC_6 = _EPISODIC.replace("contains(context, 'k17')", "contains(context, 'view') or contains(context, 'k17')").replace("limit 10)", "limit 6)").replace("session_id limit 6)", "session_id limit 10)")
_RECALL_SQL = f"""{_FIRST_SQL}, {oracle.spread("me", "mv")},
habit as (select id, type, myelination * 0.5::double as c from (select *, row_number() over (order by myelination desc, id) as k from mv) where k <= 10 - (select count(*) from a3) and type <> 'tool' and myelination * 0.5 >= 0.15 and id not in (select id from a3)),
{_EPISODIC_6},
episode as (select * from (select v.id, v.type, least(least(n / 5.0::double, 1) * (0.5::double + greatest(0, 1 - date_diff('microsecond', last, timestamp '2024-01-31 00:00:00') / 3.6e9::double / 168) * 0.5::double), 1.0::double) as c
  from seen join mv v on v.id = vertex where v.type = 'file') where c >= 0.4 order by c desc, id limit 3),
recalled as (select id, any_value(type) as type, max(c) as c from (select id, type, c from a3 union all select * from habit union all select * from episode) group by id)"""


@query(oracle.with_edges("select id, type, round(c, 6) as confidence from recalled order by recalled.c desc, id limit 10", _RECALL_SQL))
def r06_recall(spark, sf_dir):
    return _results(recall.recall(_memory(spark, sf_dir), access_log(spark, sf_dir), _QUERY, AS_OF, limit=10, budget=1_000_000, vector=_vector(spark)))


def _greedy(ranked: str, budget: int) -> str:
    """Common tables for what a budget allows of ranked (k, cost), k from 1: taken (k)."""
    return f"""fold as (select 0::bigint as k, {budget}::bigint as rest, false as took union all
  select r.k, case when r.cost <= f.rest then f.rest - r.cost else f.rest end, r.cost <= f.rest from fold f join {ranked} r on r.k = f.k + 1),
taken as (select k from fold where took)"""


_SEEDS_SQL = "ranked as (select s.*, p.id is not null as by_print, case when s.type = 'file' then 1500 else 500 end as cost, row_number() over (order by p.id is null, s.c desc, s.id) as k from seeds s left join printed p on p.id = s.id)"


@query(oracle.with_edges("select id, type, round(c, 6) as confidence from ranked where k in (select k from taken)", _FIRST_SQL, _SEEDS_SQL, _greedy("ranked", 11_700)).replace("with ", "with recursive ", 1))
def r_budget_of_seeds(spark, sf_dir):
    """What a budget that doesn't pay for all allows of the first results: dear ones are passed over for cheaper ones."""
    state = _memory(spark, sf_dir)
    first = recall.merged(recall.fingerprint_hits(state, _QUERY), recall.direct(state, _QUERY, AS_OF, vector=_vector(spark)))
    by_print = (F.col("activation_path") != "fingerprint").cast("int")
    return _results(recall.within_budget(first, 11_700, [by_print, -F.col("confidence"), F.col("id")]))


_HOP_SQL = """hop as (select *, case when type = 'file' then 1500 else 500 end as cost, row_number() over (order by o, id) as k from (
  select id, any_value(type) as type, max(least(c, 0.99::double)) as most, min(row(-seed, src, -w)) as o from h1 where id not in (select id from a0) group by id))"""


@query(oracle.with_edges("select id, type, round(c, 6) as confidence from seeds union all select id, type, round(most, 6) from hop where k in (select k from taken)",
    _MEMORY_SQL, "seeds as (select id, type, 1.0::double as c from mv where type <> 'tool' and path like '%1%')", oracle.spread("me", "mv"), _HOP_SQL, _greedy("hop", 9_300)).replace("with ", "with recursive ", 1))
def r_budget_of_spreading(spark, sf_dir):
    """One hop of spreading that a budget cuts: over the learned weights, the surest seeds' strongest edges first."""
    state = _memory(spark, sf_dir)
    seeds = state.vertices.filter("path like '%1%' and type <> 'tool'").select("id", "type", "path", F.lit(1.0).alias("confidence"), F.lit("direct").alias("activation_path"))
    return _results(recall.spread(state, seeds, hops=1, budget=9_300))


_FIXES_SQL = f"""{_DIRECT_SQL},
ranked as (select id, type, c, 1500 as cost, row_number() over (order by c desc, id) as k from direct where type = 'file'), {_greedy("ranked", 5000)},
active as (select id, type, c from ranked where k in (select k from taken)),
habit as (select id, type, myelination * 0.5::double as c from (select *, row_number() over (order by myelination desc, id) as k from mv where type = 'file') where k <= 5 - (select count(*) from active) and myelination * 0.5 >= 0.15 and id not in (select id from active)),
{_EPISODIC_6},
episode as (select * from (select v.id, v.type, least(least(n / 5.0::double, 1) * (0.5::double + greatest(0, 1 - date_diff('microsecond', last, timestamp '2024-01-31 00:00:00') / 3.6e9::double / 168) * 0.5::double), 1.0::double) as c
  from seen join mv v on v.id = vertex where v.type = 'file') where c >= 0.4 order by c desc, id limit 3),
recalled as (select id, max(c) as c from (select * from active union all select * from habit union all select * from episode) group by id order by 2 desc, 1 limit 5),
resolved as (select id, least(0.85::double * (1 + myelination), 0.99::double) as c from mv where type = 'file' and id like 'file:click/1%' and id not in (select id from recalled))"""


@query(oracle.with_edges("select id, round(c, 6) as confidence, 'recall' as way from recalled union all select id, round(c, 6), 'error→fix (resolved)' from resolved", _FIXES_SQL).replace("with ", "with recursive ", 1))
def k10_recorded_error(spark, sf_dir):
    """An error is recorded: the files that may fix it, within 5,000 tokens, and those that fixed it before."""
    state = _memory(spark, sf_dir)
    fixes = state.vertices.filter("id like 'file:click/1%'").select(F.lit(f"error:{_QUERY}").alias("error_id"), F.col("id").alias("fix_id"), F.lit("error:none").alias("fingerprint_id"))
    state = state.but(edges=learning.resolved_edges(state.edges, fixes))
    got = recall.fixes(state, access_log(spark, sf_dir), _QUERY, AS_OF, vector=_vector(spark))
    way = F.when(F.col("activation_path") == recall.RESOLVED, F.col("activation_path")).otherwise("recall")
    return got.select("id", F.round("confidence", 6).alias("confidence"), way.alias("way"))


@query(oracle.with_edges("select id, type, round(least(greatest(r.c, coalesce(s, 0)) * case when s is null then 1 else 1.15::double end, case when s is null then r.c else 0.99::double end), 6) as confidence from (select id, type, c from recalled) r left join (select id, 0.6::double as s from mv where type = 'file' and path like '%1.ts') n using (id) order by 3 desc, id limit 10", _RECALL_SQL))
def r06_recall_with_snippets(spark, sf_dir):
    """With what snippets tell of files: those whose name ends in 1."""
    state = _memory(spark, sf_dir)
    snippets = state.vertices.filter("type = 'file' and path like '%1.ts'").select(F.col("id").alias("parent"), F.lit(0.6).alias("confidence"))
    return _results(recall.recall(state, access_log(spark, sf_dir), _QUERY, AS_OF, limit=10, budget=1_000_000, vector=_vector(spark), snippets=snippets))


@query(oracle.with_edges("select id, type, round(c, 6) as confidence from (select * from recalled order by c desc, id limit 10) where type = 'file' and id like 'file:view/%'", _RECALL_SQL))
def l10_recall_in_project(spark, sf_dir):
    state = _memory(spark, sf_dir)
    tagged = state.but(vertices=state.vertices.withColumn("project", F.when(F.col("id").startswith("file:view/"), "P")))
    got = recall.recall(state, access_log(spark, sf_dir), _QUERY, AS_OF, limit=10, budget=1_000_000, vector=_vector(spark))
    return _results(recall.recall_in_project(tagged, "P", got))


_LITE_SQL = f"""matched as (select distinct id from (select id, type, row_number() over (partition by word order by myelination desc, id) as k from mv, words where contains(lower(contexts || ' ' || path), word)) where k <= 20 and type <> 'tool'),
lite as (select id, type, least(ctx * (1 + least(myelination, 0.5::double) * 0.3::double + {_AGE} + {_SHARE.format("lower(path)")} * 0.2::double), 1.0::double) as c from (select *, {_SHARE.format("lower(contexts)")} as ctx from mv) where id in (select id from matched)),
seeds as (select * from lite where c >= 0.4 order by c desc, id limit 5)"""


@query(oracle.with_edges("select id, type, round(c, 6) as confidence from a3 order by a3.c desc, id limit 10", _MEMORY_SQL, _LITE_SQL, oracle.spread("me", "mv")))
def r11_recall_lite(spark, sf_dir):
    return _results(recall.recall_lite(_memory(spark, sf_dir), _QUERY, AS_OF, limit=10))


@query()
def r09_change_sets(spark, sf_dir):
    """Files that commits whose message has the query's word changed, by how often: of those that exist."""
    commits = mining.indexed_commits(tables.commits(spark, sf_dir)).filter(F.contains(F.lower(F.col("contexts")[0]), F.lit("urgent")))
    files = commits.select(F.explode(F.split(F.substr(F.col("contexts")[1], F.lit(7)), ",")).alias("file"))
    known = table(spark, sf_dir, "part").select(F.concat(F.lit("part/"), F.col("p_partkey").cast("string")).alias("file"))
    return files.join(known, "file", "left_semi").groupBy("file").agg(F.count("*").alias("n"))


ORACLES["r09_change_sets"] = f"with {oracle.COMMITS}, sized as (select commit from commits group by 1 having count(*) between 2 and 20) select file, count(*) as n from commits where commit in (select commit from sized) and contains(lower(message), 'urgent') group by 1"


_TOLD_FILES = "myelination >= 0.3 and type = 'file'"


@query(oracle.with_edges(f"select id, round(c, 6) as confidence from direct join (select id, {_TOLD_FILES} as told from mv) using (id) where type = 'file' and ((told and c >= 0.6) or c >= 0.85) order by c desc, id limit 2", _DIRECT_SQL))
def r10_consensus(spark, sf_dir):
    state = _memory(spark, sf_dir)
    got = recall.direct(state, _QUERY, AS_OF, vector=_vector(spark))
    return recall.consensus(got, state.vertices.filter(_TOLD_FILES).select("id")).withColumn("confidence", F.round("confidence", 6))


_PERFORMED_SQL = f"""select id, round(c, 6) as confidence from (select id, c from kept union all select id, c from (select id, 0.45::double as c from mv where {_TOLD_FILES} and id not in (select id from kept) order by id limit 12) where (select count(*) from kept) < 12 qualify row_number() over (order by id) <= 12 - (select count(*) from kept)) order by c desc, id limit 12"""


def _performed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """What a session in src/view... is told, filled up by files that commits tell of, and the vertices."""
    state = _memory(spark, sf_dir)
    moved = state.vertices.withColumn("path", F.regexp_replace("path", "^src/view", "src/v/view"))
    got = recall.recall(state.but(vertices=state.vertices), access_log(spark, sf_dir), _QUERY, AS_OF, limit=36, budget=1_000_000, vector=_vector(spark)).withColumn("path", F.regexp_replace("path", "^src/view", "src/v/view"))
    told = moved.filter(_TOLD_FILES).select("path", F.lit(0.5).alias("confidence"))
    return recall.performed(got, told, moved, limit=12, least=0.3, root="src/v"), moved


_PERFORMED_PARTS = (_RECALL_SQL, """top as (select r.*, mv.path from recalled r join mv using (id) order by r.c desc, r.id limit 36),
kept as (select id, c * case when type = 'file' and path not like 'src/view%' then 0.3::double else 1 end as c from top where c >= 0.3 and c * case when type = 'file' and path not like 'src/view%' then 0.3::double else 1 end >= 0.3 order by 2 desc, id limit 12)""")


@query(oracle.with_edges(_PERFORMED_SQL, *_PERFORMED_PARTS))
def r10_performed(spark, sf_dir):
    return _performed(spark, sf_dir)[0].select("id", F.round("confidence", 6).alias("confidence"))


_MOVED = "case when path like 'src/view%' then 'src/v/' || substr(path, 5) else path end"


@query(oracle.with_edges(f"""select 'result' as kind, {_MOVED} as text, floor(p.confidence * 100 + 0.5::double)::int as confidence, floor(myelination * 100 + 0.5::double)::int as myelin from performed p join mv using (id)
union all select 'alert', string_agg(split_part(id, ':', -1) || ' (' || round({_IDLE})::bigint || ' days)', ', ' order by myelination desc, id), null, null from (
  select * from mv where type = 'file' and myelination >= 0.15 and {_IDLE} > 7 order by myelination desc, id limit 3)""", *_PERFORMED_PARTS, f"performed as ({_PERFORMED_SQL})"))
def r10_session_message(spark, sf_dir):
    """The same as a session is told it, with an alert of what is getting stale."""
    got, vertices = _performed(spark, sf_dir)
    return recall.session_message(got, vertices, "2024-02-20 00:00:00")


# Scalar functions and sources ---------------------------------------------------------------------------------------


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of many kinds of error, one an event, made of its number and its k."""
    k = F.get_json_object("props", "$.k")
    e, n = F.col("event_id").cast("string"), k.cast("int") % 8
    message = (
        F.when(n == 0, F.concat(F.lit("TypeError: Cannot read property 'x"), k, F.lit("' of null")))
        .when(n == 1, F.concat(F.lit("connect ECONNREFUSED 10.0.0.7:80"), k, F.lit(" in fetch")))
        .when(n == 2, F.concat(F.lit('File "a'), k, F.lit('.py", Line '), e, F.lit(", in read")))
        .when(n == 3, F.concat(F.lit("status code: 404 at 2024-01-02T10:20:30."), e))
        .when(n == 4, F.concat(F.lit("ModuleNotFoundError: No module named 'm"), k, F.lit("'")))
        .when(n == 5, F.concat(F.lit("crash at 0xbeef"), k, F.lit(" in write, epoch 17000000"), F.lpad(k, 2, "0")))
        .when(n == 6, F.concat(F.lit("FAILED src/a.rs:"), e, F.lit(":"), k, F.lit(" error[E0308]: mismatched")))
        .otherwise(F.concat(F.lit("all fine "), e))
    )
    return table(spark, sf_dir, "events").select("event_id", message.alias("message"))


_MESSAGES = """messages as (select event_id, case k::int % 8 when 0 then 'TypeError: Cannot read property ''x' || k || ''' of null' when 1 then 'connect ECONNREFUSED 10.0.0.7:80' || k || ' in fetch'
when 2 then 'File "a' || k || '.py", Line ' || event_id || ', in read' when 3 then 'status code: 404 at 2024-01-02T10:20:30.' || event_id when 4 then 'ModuleNotFoundError: No module named ''m' || k || ''''
when 5 then 'crash at 0xbeef' || k || ' in write, epoch 17000000' || lpad(k, 2, '0') when 6 then 'FAILED src/a.rs:' || event_id || ':' || k || ' error[E0308]: mismatched' else 'all fine ' || event_id end as message
from (select event_id, props->>'$.k' as k from events))"""


def _nested(column: str, rules) -> str:
    for pattern, to in rules:
        flags = "gi" if pattern.startswith("(?i)") else "g"
        pattern = pattern.removeprefix("(?i)").replace("'", "''")
        column = f"regexp_replace({column}, '{pattern}', '{to.replace(chr(39), chr(39) * 2)}', '{flags}')"
    return column


def _cases(column: str, patterns: dict[str, str], otherwise: str) -> str:
    return "case " + " ".join(f"when regexp_matches({column}, '(?i){p.replace(chr(39), chr(39) * 2)}') then '{name}'" for p, name in patterns.items()) + f" else '{otherwise}' end"


@query(f"with {_MESSAGES} select trim({_nested('message', ERROR_NORMAL)}) as message, count(*) as n from messages group by 1")
def f01_normal_errors(spark, sf_dir):
    return _messages(spark, sf_dir).groupBy(S.normalize_error(F.col("message")).alias("message")).agg(F.count("*").alias("n"))


@query(f"with {_MESSAGES} select {_cases('message', ERROR_TYPES, 'GENERIC_ERROR')} || '|' || {_cases('message', ERROR_OPERATIONS, 'unknown')} as fingerprint, count(*) as n from messages group by 1")
def f02_fingerprints(spark, sf_dir):
    return _messages(spark, sf_dir).groupBy(S.error_fingerprint(F.col("message")).alias("fingerprint")).agg(F.count("*").alias("n"))


@query(f"""with {_MESSAGES}, tails as (select right(message, 2000) as t from messages where length(message) >= 10),
raw as (select coalesce({", ".join(f"case when regexp_matches(t, '{p}') then coalesce(nullif(regexp_extract(t, '{p}', 1), ''), regexp_extract(t, '{p}', 0)) end" for p in OUTPUT_ERRORS)}) as r from tails)
select substr({_nested("trim(r)", OUTPUT_NORMAL)}, 1, 120) as error, count(*) as n from raw where r is not null group by 1""")
def f03_output_errors(spark, sf_dir):
    found = _messages(spark, sf_dir).select(S.detect_output_error(F.col("message")).alias("error")).filter("error is not null")
    return found.groupBy("error").agg(F.count("*").alias("n"))


@query("select vec_id, round(greatest(-1.0, least(1.0, list_dot_product(e.embedding::double[], q.embedding::double[]))), 5) as similarity from embeddings e, (select embedding from embeddings where vec_id = 0) q")
def f11_cosine(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    one = vectors.filter("vec_id = 0").select(F.col("embedding").alias("query"))
    return vectors.join(F.broadcast(one)).select("vec_id", F.round(S.cosine(F.col("embedding"), F.col("query")), 5).alias("similarity"))


@query("select url, string_split(url, '/')[-1] as basename, regexp_replace(string_split(url, '/')[-1], '\\.[^.]+$', '') as stem from pages")
def f14_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("url", S.basename(F.col("url")).alias("basename"), S.stem(F.col("url")).alias("stem"))


@query(oracle.with_vertices("select case when myelination >= 0.32 then 'HIGH' when myelination >= 0.31 then 'MEDIUM' else 'LOW' end as level, count(*) as n from vertices group by 1"))
def f16_levels(spark, sf_dir):
    return _vertices(spark, sf_dir).groupBy(S.level(F.col("myelination"), 0.32, 0.31).alias("level")).agg(F.count("*").alias("n"))


@query("select event_type, sum((props->>'$.k')::bigint)::bigint as sum_k from events group by 1")
def f22_json_paths(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("bigint")).alias("sum_k"))


@query("select conv_id, turn, case when length(t) > 60 then substr(t, 1, 59) || '…' else t end as text from (select conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) as t from conversations)")
def f25_truncated(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", S.truncated(F.col("text"), 60).alias("text"))


def _log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change logs as text, one a customer, of orders and their parts."""
    files = _noisy_commits(spark, sf_dir).groupBy("commit", "message").agg(F.array_sort(F.collect_set("file")).alias("files"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("commit"), F.col("o_custkey").alias("log"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("date"))
    text = F.concat(F.array(F.concat(F.lit("COMMIT:"), F.col("commit").cast("string")), F.concat(F.lit("DATE:"), F.col("date").cast("string")), F.concat(F.lit("MSG:"), "message"), F.lit("")), "files", F.array(F.lit("")))
    lines = files.join(orders, "commit").select("log", "commit", F.posexplode(text).alias("pos", "value"))
    return lines.select("log", (F.col("commit") * 100 + F.col("pos")).alias("line"), "value")


@query(f"with {_COCHANGED} select c.commit::varchar as hash, any_value(epoch(o_orderdate))::bigint as timestamp, any_value(c.message) as message, string_agg(file, ',' order by file) as files from told c join orders on o_orderkey = commit group by c.commit having count(*) between 1 and 20")
def s06_parsed_log(spark, sf_dir):
    return repositories.parsed_log(_log_lines(spark, sf_dir)).select("hash", "timestamp", "message", F.array_join("files", ",").alias("files"))


@query(f"with {_COCHANGED} select c.commit::varchar as hash, any_value(epoch(o_orderdate))::bigint as timestamp, any_value(c.message) as message, string_agg(file, ',' order by file) as files from told c join orders on o_orderkey = commit group by c.commit having count(*) between 1 and 20")
def s06_log_in_ranges(spark, sf_dir):
    """The same change logs as files, which are read in ranges."""
    path = shared.new_path(spark, "logs")
    lines = _log_lines(spark, sf_dir)
    commit = F.floor(F.col("line") / 100)
    texts = lines.groupBy("log", commit.alias("commit")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "value"))), lambda x: x["value"]), "\n").alias("value"))
    texts.select("value").write.text(path)
    return repositories.logged_commits(spark, path).select("hash", "timestamp", "message", F.array_join("files", ",").alias("files"))


_FLOAT_HEX = """parts as (select vec_id, i, case when x < 0 or (x = 0 and 1 / x < 0) then 1 else 0 end as sign, abs(x) as a, case when x = 0 then -127 else floor(log2(abs(x))) end as e0 from (
  select vec_id, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from embeddings)),
exact as (select *, case when a = 0 then -127 when a / pow(2, e0) >= 2 then e0 + 1 when a / pow(2, e0) < 1 then e0 - 1 else e0 end as e from parts),
bits as (select vec_id, i, (sign * 2147483648 + case when a = 0 then 0 else (e + 127) * 8388608 + (a / pow(2, e) - 1) * 8388608 end)::bigint as b from exact),
hexes as (select vec_id, i, lpad(hex(b), 8, '0') as h from bits)"""


@query(f"with {_FLOAT_HEX} select vec_id, string_agg(substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2), '' order by i) as bytes, true as same from hexes group by 1")
def f13_vector_bytes(spark, sf_dir):
    """Vectors as bytes, and whether these make the same vectors again."""
    made = vectors.with_vectors(vectors.with_bytes(table(spark, sf_dir, "embeddings"), "embedding", "bytes"), "bytes", "again")
    return made.select("vec_id", F.hex("bytes").alias("bytes"), (F.col("again") == F.col("embedding")).alias("same"))


@query("""select distinct url as source, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) as target from pages""")
def s13_links(spark, sf_dir):
    return repositories.links(table(spark, sf_dir, "pages").select(F.col("url").alias("source"), "html"))


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool calls as JSON lines, one an event: k says which tool, and on what."""
    k = F.get_json_object("props", "$.k").cast("int")
    path = F.concat(F.lit("/repo/f"), k.cast("string"), F.lit(".py"))
    tool = F.element_at(F.array(*map(F.lit, ("Read", "Grep", "Bash", "Glob"))), k % 4 + 1)
    given = F.when(k % 4 == 0, F.create_map(F.lit("file_path"), path)).when(k % 4 == 1, F.create_map(F.lit("pattern"), F.lit("todo"))).when(k % 4 == 2, F.create_map(F.lit("command"), F.concat(F.lit("cat "), path, F.lit(" ~/x.txt")))).otherwise(F.create_map(F.lit("pattern"), F.lit("*.py")))
    result = F.when(k % 4 == 1, F.concat(path, F.lit(":3: todo\nnone"))).when(k % 4 == 2, F.lit("Error: something went badly wrong")).when(k % 4 == 3, F.concat(path, F.lit("\n/repo/node_modules/a.js\nrelative.py")))
    call = F.struct(F.col("user_id").cast("string").alias("session_id"), tool.alias("tool_name"), given.alias("tool_input"), result.alias("tool_result"), F.col("ts").alias("at"))
    return table(spark, sf_dir, "events").select(F.to_json(call).alias("value"))


@query("""with e as (select user_id::varchar as session_id, (props->>'$.k')::int as k from events),
each as (select session_id, k, unnest(case k % 4 when 0 then [['tool', 'Read', 'Read'], ['file', '/repo/f' || k || '.py', 'Read']] when 1 then [['tool', 'Grep', 'grep:todo'], ['file', '/repo/f' || k || '.py', 'grep:todo']]
when 2 then [['tool', 'Bash', 'bash:cat /repo/f' || k || '.py ~/x.txt'], ['file', '/repo/f' || k || '.py', 'bash:cat /repo/f' || k || '.py ~/x.txt'], ['file', '/root/x.txt', 'bash:cat /repo/f' || k || '.py ~/x.txt'], ['error', 'something went badly wrong', 'bash:cat /repo/f' || k || '.py ~/x.txt']]
else [['tool', 'Glob', 'glob:*.py'], ['file', '/repo/f' || k || '.py', 'glob:*.py']] end) as x from e)
select x[1] as type, x[2] as path, x[3] as context, count(*) as n from each group by all""")
def s15_tool_calls(spark, sf_dir):
    return events.from_calls(events.from_json(_calls(spark, sf_dir), schema.TOOL_CALL)).groupBy("type", "path", "context").agg(F.count("*").alias("n"))


@query("select source as session_id, row_number() over (partition by source order by doc_id) - 1 as seq, lang as tool_name, case when length(text) > 8192 then substr(text, 1, 8192) || '…[truncated]' else text end as tool_result from documents")
def s26_numbered_replay(spark, sf_dir):
    """Documents as results of tools, some of which are long."""
    calls = table(spark, sf_dir, "documents").select(F.col("source").alias("session_id"), F.col("doc_id").alias("seq"), F.col("lang").alias("tool_name"), F.col("text").alias("tool_result"))
    return reports.numbered_replay(calls)


@query("select event_id, ts::varchar as ts from events order by ts desc, event_id desc limit 50")
def s31_last_lines(spark, sf_dir):
    return table(spark, sf_dir, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", F.col("ts").cast("string").alias("ts"))


# Streams ------------------------------------------------------------------------------------------------------------


@query("""with gaps as (select user_id as session_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 6 hour then 0 else 1 end as new from events),
numbered as (select *, sum(new) over (partition by session_id order by ts) as k from gaps)
select session_id, n, sessions from (select session_id, n, count(*) as sessions from (select session_id, k, count(*) as n, max(ts) as m from numbered group by 1, 2) where m < (select max(ts) - interval 7 hour from events) group by 1, 2)""")
def t03_session_windows(spark, sf_dir):
    """Sessions that have ended: those that the watermark has passed."""
    closed = jobs.finished(jobs.session_windows(jobs.event_stream(spark, sf_dir), "6 hours"))
    return closed.groupBy("session_id", "n").agg(F.count("*").alias("sessions"))


@query(f"with {oracle.LOG}, {oracle.WINDOWS}, {oracle.FIRED.split('),')[0]}) select a, b, count(*) as n, round(sum(d), 6) as sum_d from fired group by a, b")
def t05_streamed_impulses(spark, sf_dir):
    return jobs.finished(jobs.impulses(jobs.event_stream(spark, sf_dir))).groupBy("a", "b").agg(F.count("*").alias("n"), F.round(F.sum("d"), 6).alias("sum_d"))


@query(oracle.with_log("""select vertex, count(*) as n from (select vertex, ts - lag(ts) over (partition by session_id, vertex order by ts, id) as gap from log)
where gap is null or gap >= interval 60 hour group by 1"""))
def t02_without_repeats(spark, sf_dir):
    """Accesses that aren't repeats of one less than 60 hours before."""
    accesses = jobs.event_stream(spark, sf_dir).select("session_id", "vertex", "at", "id")
    return jobs.finished(state.without_repeats(accesses, "60 hours")).groupBy("vertex").agg(F.count("*").alias("n"))


_SPOKEN = """spoken as (
  select event_id as id, user_id as session_id, ts, case when event_type = 'purchase' then 'tool' when event_type = 'error' then 'error' else 'file' end as type,
    case when event_type in ('purchase', 'error') then '' else '/w/' end || event_type || '/' || ((props->>'$.k')::bigint % 20) || case when event_id % 3 = 0 then '.md' else '.ts' end as path
  from events where event_id % 97 <> 0 and event_id % 89 <> 0),
ends as (select greatest(max(ts) over (partition by user_id), max(ts) over () - interval 1 hour) as last, user_id as session_id from events where event_id % 97 <> 0 and event_id % 89 <> 0),
waits as (select 'files' as lane, interval 6 hour as delay, * from spoken where type = 'file' union all select 'snippets', interval 15 hour, * from spoken where type = 'file' and path like '%.ts'),
opens as (
  select lane, delay, session_id, min(ts) as opened from waits group by all
  union all
  select w.lane, w.delay, w.session_id, min(w.ts) from opens o join waits w on w.lane = o.lane and w.session_id = o.session_id and w.ts >= o.opened + o.delay group by w.lane, w.delay, w.session_id, o.opened),
batches as (
  select w.lane, w.session_id, w.id, w.type, w.path, o.opened, row_number() over (partition by w.lane, w.session_id, o.opened, w.path order by w.ts, w.id) as again
  from waits w join opens o on o.lane = w.lane and o.session_id = w.session_id and w.ts >= o.opened and w.ts < o.opened + o.delay
  where o.opened + o.delay <= (select max(last) from ends e where e.session_id = w.session_id))"""


@query(f"with recursive {_SPOKEN} select lane, session_id, id, type, path, opened::varchar as opened from batches where again = 1 union all select 'now', session_id, id, type, path, ts::varchar from spoken where type <> 'file'")
def t06_two_speed(spark, sf_dir):
    """Events as JSON lines, some of them damaged or of skipped paths: tools and errors go at once, distinct files 6
    hours after the first that waits, those with snippets after 15."""
    e = jobs.event_stream(spark, sf_dir)
    path = F.concat(F.element_at(F.split("vertex", ":"), -1), F.when(F.col("id") % 3 == 0, ".md").otherwise(".ts"))
    path = F.when(F.col("id") % 89 == 0, F.concat(F.lit("node_modules/"), path)).otherwise(path)
    kind = F.when(F.col("id") % 89 == 0, "file").otherwise(F.col("type"))
    line = F.to_json(F.struct("session_id", "id", "at", kind.alias("type"), F.when(F.col("id") % 2 == 0, path).alias("path"), F.when(F.col("id") % 2 == 1, path).alias("file")), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})
    lines = e.select(F.when(F.col("id") % 97 == 0, F.substring(line, 1, 25)).otherwise(line).alias("value"))
    out = jobs.finished(state.two_speed(jobs.events_of(lines, "/w"), "6 hours", "15 hours", clock="event"))
    return out.select("lane", "session_id", "id", "type", "path", F.timestamp_micros("opened").cast("timestamp_ntz").cast("string").alias("opened"))


_LIVES = """told as (
  select user_id as agent, user_id || '/' || ts::date as session_id, event_type, (props->>'$.k')::bigint % 20 as k, ts, event_id as id from events where event_type in ('view', 'click')),
marked as (select *, lag(ts) over w as before, session_id <> lag(session_id) over w as other from told window w as (partition by agent order by ts, id)),
lives as (select *, sum(case when before is null or ts - before > interval 12 hour or other then 1 else 0 end) over (partition by agent order by ts, id) as life from marked),
spans as (select agent, life, session_id, min(ts) as first, max(ts) as last from lives group by 1, 2, 3),
ends as (select *, lead(first) over (partition by agent order by life) as next from spans),
closed as (
  select *, case when next is null or next - last > interval 12 hour then 'expired' else 'changed' end as reason from ends
  where next is not null or last + interval 12 hour < (select max(ts) - interval 1 hour from told))"""


@query(f"""with {_LIVES} select c.agent, c.session_id, c.reason, 'file:view/' || k as id from closed c join lives l on l.agent = c.agent and l.life = c.life
group by c.agent, c.session_id, c.reason, c.life, k having count(*) filter (event_type = 'view') > 0 and count(*) filter (event_type = 'click') = 0""")
def t10_recall_state(spark, sf_dir):
    """A user's views of a day as what was recalled, clicks as what was opened: what was ignored when the day changed,
    and what was forgotten after twelve hours."""
    return jobs.finished(_recalled(spark, sf_dir)).select("agent", "session_id", "reason", "id")


def _recalled(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = jobs.event_stream(spark, sf_dir).filter(F.col("vertex").rlike("^file:(view|click)/"))
    day = F.concat(F.col("session_id").cast("string"), F.lit("/"), F.date_format("at", "yyyy-MM-dd"))
    kind = F.when(F.col("vertex").startswith("file:view"), "recalled").otherwise("opened")
    name = F.concat(F.lit("file:view/"), F.element_at(F.split("vertex", "/"), -1))
    return state.ignored(e.select(F.col("session_id").alias("agent"), day.alias("session_id"), kind.alias("kind"), name.alias("name"), "at", "id"), "12 hours", clock="event")


def _kept_up(spark: SparkSession, sf_dir: str, name: str) -> MemoryStore:
    """A memory of its own that has learned the log, for streams that change it."""
    memories = continual.store(spark, shared.new_path(spark, name))
    memories.commit(memories.version(), _store_of(spark, sf_dir))
    return memories


def _store_of(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    memories = _store(spark, sf_dir, "whole")
    return memories.read(continual.learn_into(memories, access_log(spark, sf_dir), ("events", 0)))


@query(oracle.with_edges("""select source_id, target_id, round(case when (x.id is not null or y.id is not null) and weight > 0.1 then greatest(0.1::double, weight * coalesce(pow(0.9::double, x.n), 1) * coalesce(pow(0.9::double, y.n), 1)) else weight end, 6) as weight,
  co_access_count::bigint as co_access_count from edges e left join times x on x.id = source_id left join times y on y.id = target_id""", _LIVES.replace("ends as", "life_ends as").replace("from ends", "from life_ends").replace("told as", "told_lives as").replace("from told", "from told_lives"), """times as (
  select id, count(*) as n from (select 'file:view/' || k as id from closed c join lives l on l.agent = c.agent and l.life = c.life where reason = 'changed'
    group by c.agent, c.life, k having count(*) filter (event_type = 'view') > 0 and count(*) filter (event_type = 'click') = 0) group by 1)"""))
def k17_weakened_by_stream(spark, sf_dir):
    """The memory's edges after a stream has told it what was recalled and not opened."""
    memories = _kept_up(spark, sf_dir, "weakened")
    jobs.to_memory(_recalled(spark, sf_dir), jobs.weakening_batches(memories, "recall"))
    return _edges_out(continual.read(memories).edges)


@query(oracle.with_edges("select source_id, target_id, round(weight * 0.98::double, 6) as weight, co_access_count::bigint as co_access_count from edges"))
def t04_session_ends(spark, sf_dir):
    """The memory's edges after the sessions of the stream have ended, and upkeep was done once for the batch of them."""
    memories = _kept_up(spark, sf_dir, "ended")
    jobs.to_memory(jobs.session_windows(jobs.event_stream(spark, sf_dir), "6 hours"), jobs.upkeep_batches(memories, "ends", maintenance.decayed))
    return _edges_out(continual.read(memories).edges)


@query(oracle.with_edges("select source_id, target_id, round(weight, 6) as weight, co_access_count::bigint as co_access_count from edges"))
def t01_learned_by_stream(spark, sf_dir):
    """A memory that learns the stream of events batch by batch."""
    memories = continual.store(spark, shared.new_path(spark, "streamed"))
    stream = jobs.event_stream(spark, sf_dir).withColumn("path", F.regexp_extract("vertex", ":(.*)", 1)).withColumn("context", F.col("type")).withColumn("at", F.col("at").cast("timestamp_ntz"))
    jobs.to_memory(stream, jobs.learning_batches(memories, "events"))
    return _edges_out(continual.read(memories).edges)


# More of learning, seeding and reading ------------------------------------------------------------------------------


_TOLD_ERRORS = f"""{_MESSAGES}, named as (select event_id, trim({_nested('message', ERROR_NORMAL)}) as normal, {_cases('message', ERROR_TYPES, 'GENERIC_ERROR')} || '|' || {_cases('message', ERROR_OPERATIONS, 'unknown')} as print from messages)"""


@query(f"with {_TOLD_ERRORS} select vertex, count(*) as n, count(distinct context) as contexts from (select 'error:' || normal as vertex, message as context from named join messages using (event_id) union all select 'error:' || print, normal from named) group by 1")
def k10_errors_told(spark, sf_dir):
    errors = _messages(spark, sf_dir).join(table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("session_id"), F.col("ts").alias("at")), "event_id").withColumnRenamed("event_id", "id")
    return learning.errors_told(errors).groupBy("vertex").agg(F.count("*").alias("n"), F.countDistinct("context").alias("contexts"))


@query(f"""with {_TOLD_ERRORS}, ends as (select 'error:' || normal as s, 'error:' || print as t, count(*) as n from named where normal <> print group by 1, 2)
select s as source_id, t as target_id, round(1 - 0.15::double * pow(0.8::double, n - 1), 6) as weight, n as co_access_count from ends union all select t, s, round(1 - 0.15::double * pow(0.8::double, n - 1), 6), n from ends""")
def k10_wired_errors(spark, sf_dir):
    none = spark.createDataFrame([], "source_id string, target_id string, weight double, co_access_count bigint")
    return _edges_out(learning.wired_errors(none, _messages(spark, sf_dir)))


_STRETCHES = """marked as (select *, case when ts - lag(ts) over (partition by session_id order by ts, id) >= interval 360 minute or lag(ts) over (partition by session_id order by ts, id) is null then 1 else 0 end as new from log),
stretched as (select *, session_id || '#' || sum(new) over (partition by session_id order by ts, id) as stretch from marked)"""


@query(oracle.with_log("select stretch as session_id, count(*) as total_accesses, sum(token_cost)::bigint as tokens_used from stretched group by 1").replace("\nselect", f", {_STRETCHES}\nselect", 1))
def k18_sessions_by_idle_time(spark, sf_dir):
    return learning.sessions(learning.by_idle_time(access_log(spark, sf_dir), 360)).drop("started_at")


@query("""with recalled as (select user_id as session_id, props->>'$.k' as id, ts as at from events where event_type = 'view'), opened as (select user_id as session_id, props->>'$.k' as id, ts as at from events where event_type = 'click')
select distinct r.session_id, r.id from recalled r where not exists (select 1 from opened o join recalled p on p.session_id = o.session_id and p.id = o.id where o.session_id = r.session_id and o.id = r.id and o.at >= p.at and o.at <= p.at + interval 2 hour)""")
def k17_ignored(spark, sf_dir):
    """Views as what was recalled, clicks as what was opened."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.get_json_object("props", "$.k").alias("id"), F.col("ts").alias("at"), "event_type")
    return learning.ignored_by_session(e.filter("event_type = 'view'").drop("event_type"), e.filter("event_type = 'click'").drop("event_type"))


@query("select source, id, value from (select user_id as source, event_id as id, event_type as value, lag(event_type) over (partition by user_id order by ts, event_id) as b from events) where b is null or b <> value")
def s24_changes(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("source"), F.col("ts").alias("at"), F.col("event_id").alias("id"), F.col("event_type").alias("value"))
    return learning.changes(e).select("source", "id", "value")


@query(f"""with {_KEYED}, named_pairs as (select x.file as a, y.file as b from named x join named y on x.key = y.key and x.file < y.file where x.key in (select key from groups)),
links as (select distinct url as a, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) as b from pages),
seeds as (select a, b, 0.6::double as w from links union all select a, b, 0.3::double from named_pairs),
both_ways as (select 'file:' || a as s, 'file:' || b as t, w from seeds where a <> b union all select 'file:' || b, 'file:' || a, w from seeds where a <> b)
select s as source_id, t as target_id, max(w) as weight, count(*) as co_access_count from both_ways group by 1, 2""")
def b04_structural_seeds(spark, sf_dir):
    """Links of pages, and their names; no imports, and no sessions, which b04_session_seeds has."""
    pages = table(spark, sf_dir, "pages")
    none = spark.createDataFrame([], "edge_id string, source_id string, target_id string, weight double, co_access_count bigint")
    names = mining.name_groups(pages.select(F.col("url").alias("file")))
    links = repositories.links(pages.select(F.col("url").alias("source"), "html"))
    seeds = mining.structural_seeds(links, none.select(F.col("source_id").alias("source"), F.col("target_id").alias("target")), names, names.limit(0))
    return _edges_out(learning.seeded_edges(none, seeds))


@query(_confirmed_sql(_SESSION_PAIRS.format("2024-01-24 00:00:00", 3).replace("from log x join log y", "from full_log x join full_log y") + ", " + _BOTH_SESSION, "0.15::double", 0.2, 0.05).replace("(select coalesce(e.source_id", "(select e.source_id is null as tagged, coalesce(e.source_id").replace("co_access_count::bigint as co_access_count from (", "co_access_count::bigint as co_access_count, tagged from ("))
def m10_tagged(spark, sf_dir):
    """Edges that consolidation makes are tagged."""
    state = _young(spark, sf_dir)
    state = state.but(edges=state.edges.withColumn("tagged_at", F.lit(None).cast("timestamp_ntz")))
    edges = maintenance.cross_session(state, access_log(spark, sf_dir), AS_OF).edges
    return edges.select("source_id", "target_id", F.round("weight", 6).alias("weight"), F.col("co_access_count").cast("bigint").alias("co_access_count"), F.col("tagged_at").isNotNull().alias("tagged"))
