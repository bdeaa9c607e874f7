"""Registered queries of sources, seeds and reports, after those of registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions import scalars as S
from ..operators import learning, mining, recall, reports
from ..sources import events, repositories, snippets
from ..sources.tables import access_log, table
from . import oracle
from .registry import ORACLES, QUERIES, _edges_out, _state, _vertices, query

__all__ = ["ORACLES", "QUERIES"]

# Imports, links and notes -------------------------------------------------------------------------------------------

_MODULES = """modules as (select p_partkey as k, 'src/m' || (p_partkey % 10) || '/p' || p_partkey || '.ts' as file from part),
imported as (
  select k, file, '../m' || ((3 * k + 1) % 10) || '/p' || (3 * k + 1) as target, 3 * k + 1 as other from modules
  union all select k, file, './p' || (k + 10), k + 10 from modules
  union all select k, file, './p' || (k + 20) || '.js', k + 20 from modules)"""


def _modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source files, one a part, that import one another in three ways, and a package."""
    k = F.col("p_partkey")
    s = lambda c: c.cast("string")
    file = F.concat(F.lit("src/m"), s(k % 10), F.lit("/p"), s(k), F.lit(".ts"))
    text = F.concat(
        F.lit("import { a } from '../m"), s((3 * k + 1) % 10), F.lit("/p"), s(3 * k + 1), F.lit("';\nconst b = require( \"./p"), s(k + 10), F.lit("\" );\nimport c from 'react';\nimport d from './p"), s(k + 20), F.lit(".js';\n"),
    )
    return table(spark, sf_dir, "part").select(file.alias("file"), text.alias("text"))


@query(f"with {_MODULES} select file, target from imported")
def s09_imports(spark, sf_dir):
    return repositories.imports(_modules(spark, sf_dir))


_RESOLVED = f"{_MODULES}, resolved as (select i.file, m.file as target from imported i join modules m on m.k = i.other)"


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    modules = _modules(spark, sf_dir)
    return repositories.resolved_imports(repositories.imports(modules), modules)


@query(f"with {_RESOLVED} select distinct file, target from resolved")
def s10_resolved_imports(spark, sf_dir):
    return _resolved(spark, sf_dir).distinct()


@query(f"with {_RESOLVED} select s as source_id, t as target_id, 0.5::double as weight, count(*) as co_access_count from (select 'file:' || file as s, 'file:' || target as t from resolved union all select 'file:' || target, 'file:' || file from resolved) where s <> t group by 1, 2")
def s12_import_edges(spark, sf_dir):
    none = spark.createDataFrame([], "source_id string, target_id string, weight double, co_access_count bigint")
    f = spark.createDataFrame([], "f1 string, f2 string")
    return _edges_out(learning.seeded_edges(none, mining.structural_seeds(f.toDF("source", "target"), _resolved(spark, sf_dir).withColumnRenamed("file", "source"), f, f)))


@query("""select url as source, target, count(*) as n from (select url, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) as target from pages) group by 1, 2""")
def s13_noted_links(spark, sf_dir):
    """Notes as JSON: a page's address and the addresses it links to."""
    pages = table(spark, sf_dir, "pages")
    notes = pages.select(F.to_json(F.create_map("url", F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), 1))).alias("value"))
    return repositories.noted_links(notes).groupBy("source", "target").agg(F.count("*").alias("n"))


# Sessions and tools -------------------------------------------------------------------------------------------------

_USED = """used as (
  select user_id as session_id, ts, event_id as id, case when event_type in ('view', 'click') then '/r/f' || ((props->>'$.k')::bigint % 30) || '.py' when event_type = 'signup' then '/private/tmp/x' end as file from events
  where event_type in ('view', 'click', 'signup')),
seen as (select * from used where file not like '/private/tmp%' and session_id in (select session_id from used where file not like '/private/tmp%' group by 1 having count(distinct file) >= 2))"""


def _transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions as lines of JSON, some damaged or of other kinds."""
    e = table(spark, sf_dir, "events")
    path = F.when(F.col("event_type") == "signup", "/private/tmp/x").otherwise(F.concat(F.lit("/r/f"), (F.get_json_object("props", "$.k").cast("bigint") % 30).cast("string"), F.lit(".py")))
    name = F.element_at(F.create_map(*(F.lit(x) for kv in {"view": "Read", "click": "Grep", "signup": "Edit", "purchase": "Bash", "error": "WebFetch"}.items() for x in kv)), F.col("event_type"))
    given = F.when(F.col("event_type") == "click", F.struct(F.lit("").alias("file_path"), path.alias("path"))).otherwise(F.struct(path.alias("file_path"), F.lit(None).cast("string").alias("path")))
    block = F.struct(F.lit("tool_use").alias("type"), name.alias("name"), given.alias("input"))
    said = F.struct(F.lit("text").alias("type"), F.lit("Read").alias("name"), given.alias("input"))
    line = F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("timestamp"), F.struct(F.array(said, block).alias("content")).alias("message")))
    every = e.select(F.col("user_id").alias("session_id"), F.explode(F.array(line, F.substring(line, 1, 40), F.lit("{}"))).alias("value"))
    return every


@query(f"with {_USED} select session_id, file, count(*) as n from seen group by 1, 2")
def s14_sessions(spark, sf_dir):
    return events.sessions_from_transcripts(_transcripts(spark, sf_dir)).groupBy("session_id", "file").agg(F.count("*").alias("n"))


_FILE_PAIRS = f"""{_USED}, firsts as (select session_id, file, min(ts) as first from seen group by 1, 2),
kept as (select * from firsts qualify row_number() over (partition by session_id order by first, file) <= 20),
session_files as (select distinct x.file as f1, y.file as f2 from kept x join kept y on x.session_id = y.session_id and x.file < y.file)"""


@query(f"""with {_RESOLVED}, {_FILE_PAIRS},
links as (select distinct url as a, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) as b from pages),
seeds as (select a, b, 0.6::double as w from links union all select distinct file, target, 0.5::double from resolved union all select f1, f2, 0.4::double from session_files),
both_ways as (select 'file:' || a as s, 'file:' || b as t, w from seeds where a <> b union all select 'file:' || b, 'file:' || a, w from seeds where a <> b)
select s as source_id, t as target_id, max(w) as weight, count(*) as co_access_count from both_ways group by 1, 2""")
def b04_every_seed(spark, sf_dir):
    """Links, imports and files of one session in one seeding."""
    none = spark.createDataFrame([], "source_id string, target_id string, weight double, co_access_count bigint")
    links = repositories.links(table(spark, sf_dir, "pages").select(F.col("url").alias("source"), "html"))
    imports = _resolved(spark, sf_dir).distinct().withColumnRenamed("file", "source")
    pairs = mining.session_file_pairs(events.sessions_from_transcripts(_transcripts(spark, sf_dir)))
    return _edges_out(learning.seeded_edges(none, mining.structural_seeds(links, imports, pairs.limit(0), pairs)))


@query("""with e as (select user_id::varchar as session_id, (props->>'$.k')::int as k, event_id as id from events where event_id % 5 <> 0),
each as (select unnest(case k % 3 when 0 then [['tool', 'read_file', 'read_file'], ['file', '/repo/f' || k || '.py', 'read_file']]
when 1 then [['tool', 'bash', 'bash:cat /repo/f' || k || '.py'], ['file', '/repo/f' || k || '.py', 'bash:cat /repo/f' || k || '.py'], ['error', 'something went badly wrong', 'bash:cat /repo/f' || k || '.py']]
else [['tool', 'unknown', 'unknown']] end) as x from e)
select x[1] as type, x[2] as path, x[3] as context, count(*) as n from each group by all""")
def s16_tool_parts(spark, sf_dir):
    """Tool events of the other family: completed ones only, and errors of shells only."""
    k = F.get_json_object("props", "$.k").cast("int")
    path = F.concat(F.lit("/repo/f"), k.cast("string"), F.lit(".py"))
    tool = F.when(k % 3 == 0, "read_file").when(k % 3 == 1, "bash")
    given = F.when(k % 3 == 0, F.create_map(F.lit("path"), path)).when(k % 3 == 1, F.create_map(F.lit("cmd"), F.concat(F.lit("cat "), path))).otherwise(F.create_map(F.lit("path"), path))
    status = F.when(F.col("event_id") % 5 == 0, "running").otherwise("completed")
    part = F.struct(tool.alias("tool"), F.struct(status.alias("status"), given.alias("input"), F.lit("Error: something went badly wrong").alias("output")).alias("state"))
    line = F.to_json(F.struct(F.lit("tool_use").alias("type"), part.alias("part"), F.col("user_id").cast("string").alias("session_id"), F.col("ts").alias("at")))
    lines = table(spark, sf_dir, "events").select(line.alias("value"))
    return events.from_parts(events.from_json(lines, schema.TOOL_PART)).groupBy("type", "path", "context").agg(F.count("*").alias("n"))


@query("""with known as (select 'k' || p_partkey as id, p_brand as parent from part), new as (select 'n' || p_partkey as id, p_brand as parent from part where p_partkey % 7 = 0 and p_brand < 'Brand#3')
select id, parent from known where parent not in (select parent from new) union all select id, parent from new""")
def s30_upserted_snippets(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    of = lambda mark, rows: rows.select(F.concat(F.lit(mark), F.col("p_partkey").cast("string")).alias("id"), F.col("p_brand").alias("parent"))
    return snippets.upserted(of("k", part), of("n", part.filter("p_partkey % 7 = 0 and p_brand < 'Brand#3'")))


# Contexts -----------------------------------------------------------------------------------------------------------

_LISTS = """firsts as (select vertex, context, min(row(ts, id)) as first from {log} group by 1, 2),
lists as (select vertex, list(context order by first, context) as contexts from (select *, row_number() over (partition by vertex order by first desc, context desc) as k from firsts) where k <= 20 group by 1)"""


@query(oracle.with_log("select vertex as id, len(contexts) as n, array_to_string(contexts, ',') as contexts from lists").replace("\nselect vertex", ", busy as (select * replace (context || ' ' || (id % 7) as context) from log),\n" + _LISTS.format(log="busy") + "\nselect vertex"))
def k09_capped_contexts(spark, sf_dir):
    """Of a log with more contexts a vertex than it holds, the latest new ones."""
    log = access_log(spark, sf_dir).withColumn("context", F.concat("context", F.lit(" "), (F.col("id") % 7).cast("string")))
    return learning.learned_vertices(log).select("id", F.size("contexts").cast("bigint").alias("n"), F.array_join("contexts", ",").alias("contexts"))


@query(oracle.with_log("""select l.vertex as id, array_to_string(every[greatest(len(every) - 14, 1):], ',') as contexts from (
  select l.vertex, case when l.vertex like 'file:%' then list_concat(contexts, s.told) else contexts end as every from lists l, (select list('seed ' || lpad(i::varchar, 2, '0') order by i) as told from range(0, 12) t(i)) s) l""").replace("\nselect l.vertex", ",\n" + _LISTS.format(log="log") + "\nselect l.vertex"))
def k09_appended_contexts(spark, sf_dir):
    """Seeds add twelve contexts to vertices that have five: the last fifteen stay."""
    known = _vertices(spark, sf_dir)
    seeds = known.filter("type = 'file'").select("id", "type", "path", F.explode(F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.concat(F.lit("seed "), F.lpad(i.cast("string"), 2, "0")))).alias("context"))
    return learning.seeded_vertices(known, seeds).select("id", F.array_join("contexts", ",").alias("contexts"))


# Reports ------------------------------------------------------------------------------------------------------------

_REPLAYED = """replayed as (
  select conv_id as session_id, timestamp '2024-01-01' + to_hours((conv_id % 500)::int) + to_minutes(turn::int) as ts, role || '/' || (turn % 3) as path, turn % 4 as kind, text as result, turn * 10 + 5 as duration from conversations)"""


def _replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool calls with their JSON, times and durations, of conversations; every fourth has no input, or another."""
    c = table(spark, sf_dir, "conversations")
    at = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(hours=(F.col("conv_id") % 500).cast("int"), mins=F.col("turn").cast("int"))
    path = F.to_json(F.struct(F.concat("role", F.lit("/"), (F.col("turn") % 3).cast("string")).alias("path")))
    given = F.when(F.col("turn") % 4 == 0, "").when(F.col("turn") % 4 == 1, F.to_json(F.struct(F.col("role").alias("command")))).otherwise(path)
    return c.select(F.col("conv_id").alias("session_id"), at.alias("ts"), given.alias("tool_input"), F.col("text").alias("tool_result"), (F.col("turn") * 10 + 5).alias("duration_ms"))


_ERROR = "(contains(lower(result), 'error') or contains(lower(result), 'failed') or contains(lower(result), 'traceback') or contains(lower(result), 'exception'))"


@query(f"""with {_REPLAYED} select session_id, min(ts)::varchar as started_at, count(*) as events, count(distinct case when kind >= 2 then path end) as unique_files, sum(case when {_ERROR} then 1 else 0 end)::bigint as errors
from replayed group by 1 order by min(ts) desc, session_id desc limit 10""")
def a06_session_list(spark, sf_dir):
    return reports.session_list(_replayed(spark, sf_dir)).withColumn("started_at", F.col("started_at").cast("string"))


@query(f"with {_REPLAYED} select count(*) as events, sum(case when {_ERROR} then 1 else 0 end)::bigint as errors, sum(duration)::bigint as total_ms from replayed")
def a07_replay_footer_with_duration(spark, sf_dir):
    return reports.replay_footer(_replayed(spark, sf_dir))


@query(f"with {_REPLAYED} select session_id, ts::varchar as ts, case kind when 0 then null when 1 then split_part(path, '/', 1) else path end as summary from replayed")
def f23_input_summaries(spark, sf_dir):
    r = _replayed(spark, sf_dir)
    return r.select("session_id", F.col("ts").cast("string").alias("ts"), S.input_summary(F.col("tool_input")).alias("summary"))


@query(oracle.with_vertices("""select round(greatest(0, (saved - 75 * 3) / without * 100), 6) as net_pct, round(greatest(0, (saved - 75 * 3 * 1000) / without * 100), 6) as net_pct_of_thousand from (
  select sum(access_count * 2000)::double as without, sum(floor(access_count * myelination) * 500)::double as saved from vertices)"""))
def a11_net_savings(spark, sf_dir):
    """What is saved beyond what telling it costs, for one recall and for a thousand."""
    v = _vertices(spark, sf_dir)
    one, many = (reports.net_savings(v, recalls=n).withColumnRenamed("net_pct", c) for n, c in ((1, "net_pct"), (1000, "net_pct_of_thousand")))
    return one.join(F.broadcast(many)).select(F.round("net_pct", 6).alias("net_pct"), F.round("net_pct_of_thousand", 6).alias("net_pct_of_thousand"))


@query(oracle.with_log("""select *, round(tp / (tp + fp)::double, 6) as precision, round(tp / (tp + fn)::double, 6) as recall from (
  select count(*) filter (g.id is not null and e.id is not null) as tp, count(*) filter (e.id is null and g.type = 'file') as fp, count(*) filter (g.id is null) as fn,
    (select count(*) from (select distinct session_id as q from log where session_id % 5 = 0) where q not in (select query from got where type = 'file')) as tn
  from got g full join wanted e on g.query = e.query and g.id = e.id)""").replace("\nselect *", """,
got as (select distinct session_id as query, vertex as id, type from log where id % 3 <> 0 and not (session_id % 10 = 0 and type = 'file')), wanted as (select distinct session_id as query, vertex as id from log where id % 3 <> 1 and session_id % 5 <> 0)
select *""", 1))
def a16_confusion(spark, sf_dir):
    """With queries that should find nothing: those that find no file are true negatives."""
    log = access_log(spark, sf_dir)
    named = log.select(F.col("session_id").alias("query"), F.col("vertex").alias("id"), "type", F.col("id").alias("n"))
    got = named.filter("n % 3 <> 0 and not (query % 10 = 0 and type = 'file')").select("query", "id", "type").distinct()
    expected = named.filter("n % 3 <> 1 and query % 5 <> 0").select("query", "id").distinct()
    r = reports.confusion(got, expected, named.filter("query % 5 = 0").select("query").distinct())
    return r.select("tp", "fp", "fn", "tn", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("select url, list_extract(list_filter(string_split(regexp_extract(url, '^[a-z]+://([^?#]*)', 1), '/'), lambda x: x <> ''), -1) as project from pages")
def f27_projects(spark, sf_dir):
    """The project that a folder stands for: the last part of its path."""
    folder = F.regexp_extract("url", r"^[a-z]+://([^?#]*)", 1)
    return table(spark, sf_dir, "pages").select("url", S.project_of(folder).alias("project"))


@query("""with e as (select (props->>'$.k')::int as k from events),
each as (select unnest(case k % 4 when 0 then [['tool', 'Read', 'tool:Read'], ['file', '/repo/f' || k || '.py', 'read:/repo/f' || k || '.py']]
when 1 then [['tool', 'bash', 'tool:bash'], ['tool', 'bash:cat /repo/f' || k || '.py', 'bash:cat /repo/f' || k || '.py'], ['file', '/repo/f' || k || '.py', 'bash:cat /repo/f' || k || '.py'], ['error', 'bad address 0x...', 'bash']]
when 2 then [['tool', 'grep', 'tool:grep'], ['file', '/repo/f' || k || '.py', 'grep:todo']]
else [['tool', 'Fetch', 'tool:Fetch'], ['file', '/repo/f' || k || '.py', 'Fetch']] end) as x from e)
select x[1] as type, x[2] as path, x[3] as context, count(*) as n from each group by all""")
def s28_extension_calls(spark, sf_dir):
    """Tool calls as an editor's extension tells them."""
    k = F.get_json_object("props", "$.k").cast("int")
    path = F.concat(F.lit("/repo/f"), k.cast("string"), F.lit(".py"))
    tool = F.element_at(F.array(*map(F.lit, ("Read", "bash", "grep", "Fetch"))), k % 4 + 1)
    given = F.when(k % 4 == 1, F.create_map(F.lit("command"), F.concat(F.lit("cat "), path))).when(k % 4 == 2, F.create_map(F.lit("pattern"), F.lit("todo"))).otherwise(F.create_map(F.lit("path"), path))
    result = F.when(k % 4 == 1, F.lit("error[E0308]: bad address 0x7ffe12")).when(k % 4 == 2, F.concat(path, F.lit(":3: todo\nnone"))).otherwise("")
    calls = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("session_id"), F.col("ts").alias("at"), tool.alias("tool_name"), given.alias("tool_input"), result.alias("tool_result"))
    return events.from_extension(calls).groupBy("type", "path", "context").agg(F.count("*").alias("n"))


@query(oracle.with_edges("""select v.id, round(v.myelination, 6) as myelination, round(e.weight, 6) as weight from vertices v join edges e on e.source_id = v.id and e.target_id = 'file:click/3' where v.id in ('file:view/7', 'tool:purchase/7', 'error:error/3')"""))
def s02_point_lookup(spark, sf_dir):
    """Single vertices and edges by their ids, from the buckets that have them."""
    state = _state(spark, sf_dir)
    ids = ["file:view/7", "tool:purchase/7", "error:error/3"]
    edges = state.edges.filter(F.col("source_id").isin(ids) & (F.col("target_id") == "file:click/3")).select(F.col("source_id").alias("id"), F.round("weight", 6).alias("weight"))
    return state.vertices.filter(F.col("id").isin(ids)).select("id", F.round("myelination", 6).alias("myelination")).join(edges, "id")
