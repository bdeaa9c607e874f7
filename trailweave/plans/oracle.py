"""Common tables for the SQL that checks the queries, in DuckDB's dialect."""

LOG = """log as (
  select event_id as id, user_id as session_id, ts,
    case when event_type in ('view', 'click') then 'file' when event_type = 'purchase' then 'tool' when event_type = 'error' then 'error' else 'semantic' end as type,
    event_type || '/' || ((props->>'$.k')::bigint % 20) as path,
    case when event_type in ('view', 'click') then 'file' when event_type = 'purchase' then 'tool' when event_type = 'error' then 'error' else 'semantic' end
      || ':' || event_type || '/' || ((props->>'$.k')::bigint % 20) as vertex,
    event_type || ' k' || (props->>'$.k') as context,
    case when event_type in ('view', 'click') then 1500 else 500 end as token_cost
  from events)"""

VERTICES = """counted as (select vertex as id, type, path, count(*) as access_count, max(ts) as last_accessed from log group by all),
vertices as (
  select *, 1.0::double as activation, 0.95::double * (1 - coalesce((select exp(sum(ln(1 - (0.02 / 0.95)::double * greatest(1 / sqrt(k), 0.1::double)))) from range(1, c.access_count) r(k)), 1.0::double)) as myelination
  from counted c)"""

_SNAP = "(1 / (1 + exp(8.0::double * ({w} - 0.5::double))))"

WINDOWS = """placed as (select *, row_number() over (partition by session_id order by ts, id) as ord from log),
nexts as (select *, lead(ord) over (partition by session_id, vertex order by ord) as nxt from placed),
live as (
  select n.session_id, n.ord, n.vertex, n.type, n.ts, n.id, t.vertex as recent, t.type as recent_type,
    row_number() over (partition by n.session_id, n.ord order by t.ord desc) as recency
  from nexts n join nexts t on t.session_id = n.session_id and t.ord < n.ord and (t.nxt is null or n.ord <= t.nxt)
  qualify recency <= 25),
win as (select *, count(*) over (partition by session_id, ord) as len from live)"""

FIRED = """fired as (
  select least(vertex, recent) as a, greatest(vertex, recent) as b, ts, id, len - recency + 1 as pos,
    0.1::double * case when type = 'error' or recent_type = 'error' then 2 else 1 end * (len - recency + 1) / len as d
  from win where recent <> vertex),
firsts as (select a, b, min(row(ts, id, pos)) as first from fired group by a, b),
ends as (select a as e, first from firsts union all select b, first from firsts),
hubs as (select e, first as hub from (select *, row_number() over (partition by e order by first) as n from ends) where n = 21),
damped as (
  select f.* exclude d, d * case when row(ts, id, pos) > x.hub or row(ts, id, pos) > y.hub then 0.5::double else 1.0::double end as d
  from fired f left join hubs x on x.e = f.a left join hubs y on y.e = f.b)"""

EDGES = """pairs as (select a, b, list(d order by ts, id, pos) as ds, count(*) as n, max(ts) as last_fired from damped group by a, b),
folded as (
  select a, b, n, last_fired, list_reduce(ds[2:], lambda w, d: least(w + d / (1 + exp(8.0::double * (w - 0.5::double))) * (1 - w), 1.0::double),
    greatest(0.3::double, ds[1] / (1 + exp(-4.0::double)))) as weight from pairs),
edges as (
  select a as source_id, b as target_id, weight, n as co_access_count, last_fired from folded
  union all select b, a, weight, n, last_fired from folded)"""

REPLAY = "replay as (select conv_id as session_id, turn as seq, role as tool_name, text as tool_result from conversations)"
COMMITS = """changed as (select distinct l_orderkey as commit, 'part/' || l_partkey as file from lineitem),
commits as (select c.*, o_orderpriority as message from changed c join orders on o_orderkey = commit)"""


def with_log(select: str) -> str:
    return f"with {LOG}\n{select}"


def with_vertices(select: str) -> str:
    return f"with {LOG},\n{VERTICES}\n{select}"


def with_edges(select: str, *more: str) -> str:
    return f"with {', '.join([LOG, VERTICES, WINDOWS, FIRED, EDGES, *more])}\n{select}"


def snap(w: str) -> str:
    return _SNAP.format(w=w)


def with_old_edges(select: str, before: str, *more: str) -> str:
    """The same with a memory that has learned from the log before a moment only; all of the log is full_log."""
    return f"with {', '.join([LOG.replace('log as', 'full_log as', 1), f"log as (select * from full_log where ts < timestamp '{before}')", VERTICES, WINDOWS, FIRED, EDGES, *more])}\n{select}"


def hashed_vector(name: str, rows: str) -> str:
    """A common table (id, slot, v): vectors of rows (id, text) by hashed words."""
    return f"""{name}_n as (select id, ('0x' || substr(md5(w), 1, 6))::int % 64 as slot, count(*) as n from (
    select id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')) as w from ({rows})) group by all),
{name} as (select id, slot, n / sqrt(sum(n * n) over (partition by id)) as v from {name}_n)"""


_HOP = """h{k} as (
  select t.id, t.type, t.path, f.c * o.weight * (1 + least(t.myelination, 0.5::double)) * o.fan as c, f.c as seed, f.id as src, o.weight as w
  from f{p} f join onward o on o.source_id = f.id join {v} t on t.id = o.target_id where t.type <> 'tool' and f.c * o.weight * (1 + least(t.myelination, 0.5::double)) * o.fan >= 0.4),
b{k} as (select id, any_value(type) as type, max(least(c, 0.99::double)) as most, arg_min(least(c, 0.99::double), row(-seed, src, -w)) as found from h{k} group by id),
a{k} as (select coalesce(a.id, b.id) as id, coalesce(a.type, b.type) as type, greatest(a.c, b.most) as c, coalesce(a.hop, {k}) as hop from a{p} a full join b{k} b on a.id = b.id),
f{k} as (select id, found as c from b{k} where id not in (select id from a{p}))"""


def spread(edges: str = "edges", vertices: str = "vertices") -> str:
    """Common tables a0 to a3 (id, type, c, hop): what is active after each hop from seeds (id, type, c)."""
    return f"""onward as (select source_id, target_id, weight, 1 / sqrt(least(degree, 50)) as fan from (
  select *, count(*) over (partition by source_id) as degree, row_number() over (partition by source_id order by weight desc, target_id) as k from {edges}) where k <= 10 and weight >= 0.3),
a0 as (select id, type, c, 0 as hop from seeds), f0 as (select id, c from seeds), """ + ", ".join(_HOP.format(k=k, p=k - 1, v=vertices) for k in (1, 2, 3))
