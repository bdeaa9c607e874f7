"""Audit of filters that act on one another: what each removes in every order in which they may be applied.

Filters judge a document by itself, so what a set of them removes doesn't depend on their order: it is a game, v(S) the
documents that fail any filter of S. A step that applies f after the set S removes v(S + f) - v(S). The Shapley value of
a filter, its removals averaged over all orders, comes from the potential of Hart and Mas-Colell: with P(no filter) = 0,

    P(S) = (v(S) + sum of P(S - i) over i in S) / |S|,    and the value of f is P(all) - P(all - f).

Documents are read once, to thin rows; these are counted by part and by the set of filters that they fail, at most two
to the power of the number of filters rows a part. Orders and potentials are worked out on these counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, fresh, keep, spread_join

#: Filters that an audit takes at most: their orders are as many as the factorial.
MOST_FILTERS = 6
UPPER, MARKS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", r"[#$%&*|]"


def document_filters(text: Column) -> dict[str, Column]:
    """By letter, what a whole text (null: empty) fails: A under 200 words, B under half of its words distinct, C over
    2 % capitals, D a symbol of markup or code. A text without words fails A only."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    words = F.filter(F.split(text, f"{SPACE_CLASS}+"), lambda w: w != "")
    capitals = F.length(text) - F.length(F.translate(text, UPPER, ""))
    return {"A": F.size(words) < 200, "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words), "C": 100 * capitals > 2 * F.length(text), "D": text.rlike(MARKS)}


def with_copies(rows: DataFrame, digest: str, name: str) -> DataFrame:
    """rows (doc_id, digest, ...) with a column `name`: whether a smaller doc_id anywhere has the same digest.

    Rows without doc_id are nobody's copy and have no copies. A digest may be that of a third of all rows: its least
    number is found with partial minima, and the join deals its rows to slots."""
    least, n = fresh(rows.columns, "_least"), fresh(rows.columns, "_n")
    again = rows.groupBy(digest).agg(F.min("doc_id").alias(least), F.count("*").alias(n)).filter(F.col(n) > 1).drop(n)
    marked = spread_join(rows, again, [digest], [F.col("doc_id")])
    return marked.withColumn(name, F.coalesce(F.col("doc_id") > F.col(least), F.lit(False))).drop(least)


def failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, A, B, C, D, E) for every row of docs (doc_id, text, source, ...): the filters that it fails.

    E is failed by a text that a smaller doc_id has too. part is the source (null: empty). Texts are read whole, once;
    null and empty texts are equal; equality is that of 256-bit digests. Repeated rows each count, and are not copies
    of one another; rows without doc_id are nobody's copies; other columns are ignored, whatever their names."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    thin = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), *(c.alias(k) for k, c in document_filters(F.col("text")).items()))
    return with_copies(keep(thin), "digest", "E").select("doc_id", "part", *"ABCDE")


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows (doc_id, ...) with good and toxic: whether any label of the document has quality 1, and any has toxic 1."""
    said = labels.groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    joined = spread_join(rows, said.filter("doc_id is not null"), ["doc_id"], [F.col(c) for c in rows.columns])
    return joined.fillna(False, ["good", "toxic"])


def _sum(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def games(rows: DataFrame, filters: Sequence[str], losses: Sequence[str] = ()) -> DataFrame:
    """(part, n, removed, <loss>...): by part the rows, and for each set of filters, numbered by bits in the order of
    `filters`, how many rows that fail any of them there are, and how many of these have the flag `loss`."""
    failed = _sum([F.coalesce(F.col(f), F.lit(False)).cast("int") * (1 << i) for i, f in enumerate(filters)])
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).cast("bigint")
    counted = rows.groupBy("part", failed.alias("failed")).agg(F.count("*").alias("n"), *(F.sum(flag(c)).alias(c) for c in losses))
    sets = range(1 << len(filters))
    game = lambda c: F.array(*(F.coalesce(F.sum(F.when(F.col("failed").bitwiseAND(F.lit(s)) != 0, F.col(c))), F.lit(0)) for s in sets))
    return counted.groupBy("part").agg(F.sum("n").alias("n"), game("n").alias("removed"), *(game(c).alias(c) for c in losses))


def potentials(game: Column, players: int) -> Column:
    """The potential of each coalition, times the number of orders, all whole numbers: those of smaller coalitions
    first, as a coalition's number is greater than those of its parts."""
    orders = factorial(players)

    def step(known: Column, s: Column) -> Column:
        without = [F.when(s.bitwiseAND(F.lit(1 << i)) != 0, F.get(known, s - (1 << i))).otherwise(F.lit(0).cast("bigint")) for i in range(players)]
        # The division leaves no rest: times |S|!, P(S) is a sum of whole multiples of v.
        return F.concat(known, F.array(F.call_function("div", F.get(game, s) * orders + _sum(without), F.bit_count(s))))

    return F.aggregate(F.sequence(F.lit(1), F.lit((1 << players) - 1)), F.array(F.lit(0).cast("bigint")), step)


def audit(rows: DataFrame, filters: Sequence[str], losses: Mapping[str, str] | None = None) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, <loss>..., shapley) of rows (part, a boolean
    column for each filter, flags), for every part, every order of the filters, named by their names in a row, and
    every step from 1. losses: for columns of the result, the flag of the rows to count among those removed.

    Counts of rows in the part: kept after the step, removed by it, redundant (failing its filter, removed before),
    unique_fails (failing no other filter); shapley: removed by its filter, summed over all orders. A null part is a
    part of its own, null flags are false, repeated rows count each; no rows give no parts."""
    losses, players = dict(losses or {}), len(filters)
    if not 1 <= players <= MOST_FILTERS:
        raise ValueError(f"1 to {MOST_FILTERS} filters")
    flags = rows.select("part", *filters, *(F.col(flag).alias(name) for name, flag in losses.items()))
    by_part = keep(games(flags, filters, list(losses)).withColumn("potential", potentials(F.col("removed"), players)))

    # An order as the places of its filters; a step has its filter's bit and those of the filters before it.
    orders = F.split(F.lit(",".join("".join(map(str, o)) for o in permutations(range(players)))), ",")
    ordered = by_part.withColumn("places", F.explode(orders)).withColumn("places", F.transform(F.split("places", ""), lambda i: i.cast("int")))
    bit = lambda i: F.element_at(F.array(*(F.lit(1 << k) for k in range(players))), i + 1)
    steps = ordered.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(players)))).withColumn("own", bit(F.element_at("places", F.col("step"))))
    steps = steps.withColumn("before", F.aggregate(F.slice("places", F.lit(1), F.col("step") - 1), F.lit(0), lambda s, i: s + bit(i)))
    every = F.lit((1 << players) - 1)
    of = lambda game, s: F.get(F.col(game), s)
    after = F.col("before") + F.col("own")
    gained = lambda game: of(game, after) - of(game, F.col("before"))
    return steps.select(
        "part",
        F.array_join(F.transform("places", lambda i: F.element_at(F.array(*map(F.lit, filters)), i + 1)), "").alias("filter_order"),
        "step",
        (F.col("n") - of("removed", after)).alias("kept"),
        gained("removed").alias("removed"),
        (of("removed", F.col("own")) - gained("removed")).alias("redundant"),
        (of("removed", every) - of("removed", every - F.col("own"))).alias("unique_fails"),
        *(gained(name).alias(name) for name in losses),
        (of("potential", every) - of("potential", every - F.col("own"))).alias("shapley"),
    )


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """audit() of the five document filters by source, with the good and the toxic documents that each step removes."""
    return audit(with_labels(failures(docs), labels), list("ABCDE"), {"good_lost": "good", "toxic_lost": "toxic"})


#: The same without coalitions: which filter comes first among those that a document fails, order by order.
ORACLE = r"""with words as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as text, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w from documents),
judged as (
  select d.doc_id, part, len(w) < 200 as a, 100 * len(list_distinct(w)) < 50 * len(w) as b, 100 * length(regexp_replace(d.text, '[^A-Z]+', '', 'g')) > 2 * length(d.text) as c,
    regexp_matches(d.text, '[#$%&*|]') as d, coalesce(d.doc_id > f.least, false) as e
  from words d join (select text, min(doc_id) as least from words group by 1) f on f.text = d.text),
flagged as (
  select j.*, coalesce(l.good, false) as good, coalesce(l.toxic, false) as toxic from judged j
  left join (select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels group by 1) l on l.doc_id = j.doc_id),
masks as (
  select part, case when a then 'A' else '' end || case when b then 'B' else '' end || case when c then 'C' else '' end || case when d then 'D' else '' end || case when e then 'E' else '' end as fails,
    count(*) as n, sum(good::int) as good, sum(toxic::int) as toxic from flagged group by 1, 2),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
orders as (
  select p.x || q.x || r.x || s.x || t.x as o from letters p, letters q, letters r, letters s, letters t
  where q.x <> p.x and r.x not in (p.x, q.x) and s.x not in (p.x, q.x, r.x) and t.x not in (p.x, q.x, r.x, s.x)),
first as (
  select part, fails, n, good, toxic, o, case when fails = '' then 9 else list_min(list_transform(string_split(fails, ''), lambda f: strpos(o, f))) end as pos from masks, orders),
steps as (select o, k, substr(o, k, 1) as f from orders, (select unnest([1, 2, 3, 4, 5]) as k)),
counted as (
  select m.part, s.o, s.k, s.f, sum(case when pos > k then n else 0 end) as kept, sum(case when pos = k then n else 0 end) as removed,
    sum(case when pos < k and contains(fails, f) then n else 0 end) as redundant, sum(case when fails = f then n else 0 end) as unique_fails,
    sum(case when pos = k then good else 0 end) as good_lost, sum(case when pos = k then toxic else 0 end) as toxic_lost
  from first m join steps s on s.o = m.o group by 1, 2, 3, 4)
select part, o as filter_order, k::int as step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant, unique_fails::bigint as unique_fails, good_lost::bigint as good_lost,
  toxic_lost::bigint as toxic_lost, (sum(removed) over (partition by part, f))::bigint as shapley from counted"""
