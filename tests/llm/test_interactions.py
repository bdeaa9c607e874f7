from collections import defaultdict
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from trailweave.llm import interactions

DOCS = "doc_id bigint, text string, source string, part int, A string, digest string"
LABELS = "doc_id bigint, quality int, toxic int, part string"


def fails(rows):
    import re

    least = {}
    for d, t, _ in rows:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    out = []
    for d, t, s in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words)) + "C" * (100 * len(re.findall("[A-Z]", t)) > 2 * len(t)) + "D" * bool(re.search(r"[#$%&*|]", t))
        out.append((d, s or "", f + "E" * (d is not None and d > least.get(t, d))))
    return out


def brute(rows, labels):
    good, toxic = {d for d, q, _ in labels if q == 1} - {None}, {d for d, _, t in labels if t == 1} - {None}
    docs, out = fails(rows), {}
    for part in {p for _, p, _ in docs}:
        mine, shapley = [(d, f) for d, p, f in docs if p == part], defaultdict(int)
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for k, name in enumerate(order):
                gone = [(d, f) for d, f in left if name in f]
                left = [x for x in left if name not in x[1]]
                shapley[name] += len(gone)
                out[part, order, k + 1] = [
                    len(left), len(gone), sum(name in f for _, f in mine) - len(gone), sum(f == name for _, f in mine), sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone), name,
                ]
        for (p, _, _), row in out.items():
            if p == part:
                row[-1] = shapley[row[-1]]
    return {k: tuple(v) for k, v in out.items()}


def check(spark, rows, labels):
    got = interactions.report(spark.createDataFrame([(*r, 1, "x", "y") for r in rows], DOCS), spark.createDataFrame([(*x, "z") for x in labels], LABELS))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    said = got.collect()
    assert {tuple(r)[:3]: tuple(r)[3:] for r in said} == brute(rows, labels) and len(said) == 600 * len({s or "" for _, _, s in rows})


LONG = " ".join(f"w{i}" for i in range(250))


def test_same_as_applying_the_filters(spark):
    texts = [LONG, LONG.upper(), LONG + " #", "a " * 300, "A " * 300, "short", "short $", "É " * 201, None, "", " \t\n", "MIXED Case " * 30, LONG + " once", ("a b " * 150) + "|"]
    rows = [(i * 13 % 101, texts[i * i % len(texts)], ["s", "t", None, ""][i % 4]) for i in range(90)]
    rows += rows[:7] + [(None, LONG, "s"), (None, LONG, "s"), (None, None, None)]
    labels = [(i, i % 2, i % 3 % 2) for i in range(80)] + [(3, 1, None), (3, None, 1), (None, 1, 1), (5, 0, 0)]
    check(spark, rows, labels)


def test_edges(spark):
    check(spark, [(1, "clean text", "only")], [])
    check(spark, [(5, LONG, None)], [(5, 1, 1), (5, 1, 1)])
    assert interactions.report(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)).collect() == []


def test_whole_long_texts(spark):
    text = " ".join(f"v{i}" for i in range(300_000))
    check(spark, [(1, text, "s"), (2, text, "t"), (3, text + " &", "s")], [(2, 1, 1)])


@pytest.mark.parametrize("players", [1, 2, 3, 6])
def test_potentials_give_the_mean_over_all_orders(spark, players):
    names = ["p", "q", "r", "s", "t", "u"][:players]
    rows = [(None if i % 5 == 0 else "x", *(bool(i * 2654435761 >> 7 + 3 * k & 1) if i % 11 else None for k in range(players))) for i in range(400)]
    got = interactions.audit(spark.createDataFrame(rows, "part string, " + ", ".join(f"{n} boolean" for n in names)), names).collect()
    totals = defaultdict(int)
    for r in got:
        totals[r.part, r.filter_order[r.step - 1]] += r.removed
    assert {(r.part, r.filter_order[r.step - 1], r.shapley) for r in got} == {(*k, v) for k, v in totals.items()}


def test_number_of_filters_is_bounded(spark):
    with pytest.raises(ValueError):
        interactions.audit(spark.range(1).select(F.lit("x").alias("part")), [])
