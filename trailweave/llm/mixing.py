"""Mixing sources to target weights by temperature. Tokens are words here.

The weight of a source is its share of all tokens to a power, normalised. Lower powers flatten the mixture: its
entropy rises, and so does how often the texts of small sources repeat. The power is found by bisection, many sections
a round; the sums of a round are one grouped aggregation over the sources, and the driver sees two numbers of it.
A source's part of the budget is then filled with whole permutations of its texts, one a block, and a last block that
is cut where the budget ends. The cut is found from sums over ranges of the permutation, never by sorting a source
in one task."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS, fresh, group_join, keep

SECTIONS, ROUNDS = 64, 4
#: Ranges that a permutation is summed by: a power of two.
_RANGES = 12


@dataclass(frozen=True)
class Targets:
    """entropy_share: how far the entropy may rise from that of the shares (0) to the highest possible (1), or
    entropy, in nats, in its place. max_repeats: how often a text may come at most. budget: the tokens of the
    mixture; None: the least with which every source is used whole once."""

    entropy_share: float = 0.5
    entropy: float | None = None
    max_repeats: float = 2.0
    budget: float | None = None


def _words(text: Column) -> Column:
    """What a text costs: its words, which JVM-side functions can count; a budget in tokens is a factor away."""
    return F.coalesce(F.regexp_count(text, F.lit(rf"[^{SPACE_CLASS[1:-1]}]+")), F.lit(0)).cast("bigint")


def place(doc_id: Column, block: Column, seed: int) -> Column:
    """Where a text stands in the permutation of a block: 60 bits of a hash."""
    digest = F.md5(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), block.cast("string"), F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def _mixture(sources: DataFrame, powers: Column, budget: float | None) -> DataFrame:
    """By power: entropy and repeats of the mixture of sources (t: tokens, p: share)."""
    each = sources.select("p", "t", F.explode(powers).alias("power")).withColumn("q", F.pow("p", "power"))
    sums = each.groupBy("power").agg(F.sum("q").alias("z"), F.sum(F.col("q") * F.log("p")).alias("qlogp"), F.max(F.col("q") / F.col("t")).alias("most"), F.max(F.col("t") / F.col("q")).alias("whole"))
    tokens = F.col("whole") * F.col("z") if budget is None else F.lit(float(budget))
    return sums.select("power", (F.log("z") - F.col("power") * F.col("qlogp") / F.col("z")).alias("entropy"), (F.col("most") / F.col("z") * tokens).alias("repeats"), tokens.alias("tokens"), "z")


def find_power(sources: DataFrame, targets: Targets) -> float:
    """The least power in 0 to 1 whose mixture keeps to the targets; 1 if none does."""
    whole = _mixture(sources, F.array(F.lit(0.0), F.lit(1.0)), targets.budget).orderBy("power").collect()
    if not whole:
        return 1.0
    entropy = targets.entropy if targets.entropy is not None else whole[1].entropy + targets.entropy_share * (whole[0].entropy - whole[1].entropy)
    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        step = (high - low) / SECTIONS
        fits = _mixture(sources, F.array(*(F.lit(low + i * step) for i in range(SECTIONS + 1))), targets.budget).filter((F.col("entropy") <= entropy + 1e-9) & (F.col("repeats") <= targets.max_repeats + 1e-9))
        least = fits.agg(F.min("power")).first()[0]
        if least is None:
            return high
        low, high = max(low, least - step), least
    return high


def plan(docs: DataFrame, targets: Targets, seed: int) -> DataFrame:
    """By source key: n whole blocks, and cut, the place in the block after them up to which texts are used.

    A source without tokens is used whole once."""
    thin = keep(docs.select("doc_id", _source(docs), _words(F.col("text")).alias("n")))
    counted = thin.groupBy("key").agg(F.sum("n").alias("t"))
    # Shares need the sum over all sources: one row, whose value goes back as a number.
    total = counted.agg(F.sum("t")).first()[0] or 0
    sources = keep(counted.filter("t > 0").select("key", F.col("t").cast("double").alias("t"), (F.col("t") / F.lit(float(max(total, 1)))).alias("p")))
    power = find_power(sources, targets)
    mixture = _mixture(sources, F.array(F.lit(power)), targets.budget).first()
    quota = F.pow("p", F.lit(power)) / F.lit(mixture.z if mixture else 1.0) * F.lit(mixture.tokens if mixture else 0.0)
    parts = sources.withColumn("quota", quota).withColumn("blocks", F.floor(F.col("quota") / F.col("t") + 1e-9))
    parts = keep(parts.select("key", "blocks", F.floor(F.greatest(F.col("quota") - F.col("blocks") * F.col("t"), F.lit(0.0)) + 1e-3).alias("rest")))

    # A source may hold a third of the texts; parts is one row a source.
    placed = group_join(thin, parts.filter("rest > 0"), ["key"], [F.col("doc_id"), F.col("n")], "inner").withColumn("place", place(F.col("doc_id"), F.col("blocks"), seed))
    placed = placed.select("key", "rest", "n", "place", F.shiftright("place", 60 - _RANGES).alias("range"))
    before = placed.groupBy("key", "range").agg(F.sum("n").alias("s"))
    before = before.withColumn("before", F.sum("s").over(Window.partitionBy("key").orderBy("range")) - F.col("s")).drop("s")
    within = F.coalesce(F.sum("n").over(Window.partitionBy("key", "range").orderBy("place").rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    used = placed.withColumn("within", within).join(before.hint("merge"), ["key", "range"]).filter(F.col("before") + F.col("within") < F.col("rest"))
    cuts = used.groupBy("key").agg(F.max("place").alias("cut"))
    empty = counted.filter("t = 0").select("key", F.lit(1).cast("bigint").alias("blocks"), F.lit(None).cast("bigint").alias("cut"))
    return keep(parts.drop("rest").join(cuts, "key", "left").unionByName(empty))


def _source(docs: DataFrame) -> Column:
    source = F.col("source").cast("string")
    return F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source)).alias("key")


def mix(docs: DataFrame, targets: Targets = Targets(), seed: int = 17) -> DataFrame:
    """The mixture of docs (doc_id, text, source, ...): all columns, and block and place. Sorting by these gives each
    block in the order of its permutation, sources among one another.

    A row comes once a block that its source uses it in. A null source is a source of its own; texts that are null
    or without words cost nothing and come in all whole blocks. Rows of one source and doc_id share a place: they are
    in or out together. Columns named block or place are replaced, other columns pass through, whatever their names; a
    text of any length is one row. An empty table gives an empty mixture."""
    columns = [c for c in docs.columns if c not in ("block", "place")]
    key, blocks, cut = (fresh(docs.columns, c) for c in ("_key", "_blocks", "_cut"))
    parts = plan(docs.select("doc_id", F.col("text").cast("string").alias("text"), "source"), targets, seed)
    parts = parts.select(F.col("key").alias(key), F.col("blocks").alias(blocks), F.col("cut").alias(cut))
    rows = group_join(docs.select(*columns, _source(docs).alias(key)), parts, [key], [F.col("doc_id")], "inner")
    last = F.when(F.col(cut).isNotNull() & (place(F.col("doc_id"), F.col(blocks), seed) <= F.col(cut)), F.col(blocks)).otherwise(F.col(blocks) - 1)
    used = F.when(last >= 0, F.sequence(F.lit(0).cast("bigint"), last))
    return rows.select(*columns, F.explode(used).alias("block")).withColumn("place", place(F.col("doc_id"), F.col("block"), seed))


def report(docs: DataFrame, targets: Targets = Targets()) -> DataFrame:
    """(doc_id, source, n_words, block, place) of the mixture."""
    out = mix(docs.select("doc_id", "text", "source"), targets)
    return out.select("doc_id", "source", _words(F.col("text").cast("string")).alias("n_words"), "block", "place")


def _oracle() -> str:
    """The mixture under the default targets, for DuckDB: all rounds as common tables."""
    rounds = ["lims as (select 0::double as low, 1::double as high)"]
    for k in range(ROUNDS):
        at = "lims" if k == 0 else f"lims{k}"
        rounds.append(f"""tried{k} as (
  select power, low, (high - low) / {SECTIONS} as step, ln(sum(pow(p, power))) - power * sum(pow(p, power) * ln(p)) / sum(pow(p, power)) as entropy,
    max(pow(p, power) / t) / sum(pow(p, power)) * max(t / pow(p, power)) * sum(pow(p, power)) as repeats
  from (select s.*, l.*, l.low + i * ((l.high - l.low) / {SECTIONS}) as power from shares s, {at} l, range(0, {SECTIONS + 1}) r(i)) group by power, low, high)""")
        rounds.append(f"""lims{k + 1} as (
  select coalesce(greatest(any_value(x.low), min(x.power) filter (fits) - any_value(x.step)), any_value(x.low)) as low, coalesce(min(x.power) filter (fits), (select high from {at})) as high
  from (select *, entropy <= (select e from wanted) + 1e-9 and repeats <= 2.0 + 1e-9 as fits from tried{k}) x)""")
    return f"""
with docs as (
  select doc_id, source, coalesce('=' || source, '') as key, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) as n from documents),
sums as (select key, sum(n)::double as t from docs group by key),
shares as (select key, t, t / (select sum(t) from sums) as p from sums where t > 0),
wanted as (select (-sum(p * ln(p)) + ln(count(*))) / 2 as e from shares),
{", ".join(rounds)},
weights as (select *, pow(p, (select high from lims{ROUNDS})) as q from shares),
quotas as (select *, q / (select sum(q) from weights) * ((select max(t / q) from weights) * (select sum(q) from weights)) as quota from weights),
blocked as (select *, floor(quota / t + 1e-9) as blocks from quotas),
parts as (
  select key, blocks::bigint as blocks, floor(greatest(quota - blocks * t, 0) + 1e-3) as rest from blocked
  union all select key, 1, 0 from sums where t = 0),
placed as (
  select d.*, p.*, ('0x' || substr(md5(concat(coalesce(doc_id::varchar, ''), ':', blocks, ':17')), 1, 15))::bigint as place from docs d join parts p on p.key = d.key),
cut as (
  select *, coalesce(sum(n) over (partition by source order by place range between unbounded preceding and 1 preceding), 0) < rest as used from placed),
out as (select *, unnest(range(0, blocks + case when used then 1 else 0 end)) as block from cut)
select doc_id, source, n::bigint as n_words, block::bigint as block,
  ('0x' || substr(md5(concat(coalesce(doc_id::varchar, ''), ':', block, ':17')), 1, 15))::bigint as place
from out
"""


ORACLE = _oracle()
