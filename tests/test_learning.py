"""Golden values, and the decomposition against a sequential fold."""

import math
import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from trailweave.functions import scalars as S
from trailweave.operators import learning, maintenance, mining, recall, reports
from trailweave.operators.learning import State

LOG = "id bigint, session_id bigint, vertex string, type string, path string, context string, at timestamp_ntz, token_cost bigint"
START = datetime(2024, 1, 1)


def log_of(spark, accesses):
    """accesses: (session, path) or (session, path, type)"""
    rows = []
    for i, (session, path, *kind) in enumerate(accesses):
        kind = kind[0] if kind else "file"
        rows.append((i, session, f"{kind}:{path}", kind, path, f"about {path}", START + timedelta(seconds=i), 1500 if kind == "file" else 500))
    return spark.createDataFrame(rows, LOG)


def fold(accesses, snap=True, capture=True):
    """Access by access: {(a, b): [weight, count]}."""
    window, edges, out = defaultdict(list), {}, defaultdict(set)
    for session, path, *kind in accesses:
        kind = kind[0] if kind else "file"
        me, recent = f"{kind}:{path}", window[session]
        for i, other in enumerate(recent):
            if other == me:
                continue
            rate = 0.2 if "error" in (kind, other.split(":")[0]) else 0.1
            if len(out[me]) > 20 or len(out[other]) > 20:
                rate *= 0.5
            pair = (min(me, other), max(me, other))
            w, n = edges.get(pair, (0.0, 0))
            d = rate * (i + 1) / len(recent) * (1 / (1 + math.exp(8 * (w - 0.5))) if snap else 1)
            w = min(w + d * (1 - w), 1.0) if n else (max(0.3, d) if capture else d)
            edges[pair] = (w, n + 1)
            out[me].add(other)
            out[other].add(me)
        if me in recent:
            recent.remove(me)
        recent.append(me)
        del recent[:-25]
    return edges


def test_myelination(spark):
    want = {1: 0, 2: 0.02, 3: 0.03384, 4: 0.04498, 5: 0.05451, 10: 0.09013, 200: 0.42923}
    got = spark.createDataFrame([(n,) for n in want], "n bigint").select("n", S.myelination(F.col("n"))).collect()
    assert all(abs(m - want[n]) < 1e-4 for n, m in got)
    m = 0.0
    for k in range(1, 400):
        m += 0.02 * (1 - m / 0.95) * max(1 / math.sqrt(k), 0.1)
    assert abs(spark.range(1).select(S.myelination(F.lit(400).cast("bigint"))).first()[0] - m) < 1e-9


def test_golden_sequence(spark):
    accesses = [(1, p) for i in range(10) for p in (("a", "b") if i < 5 else ("a",))]
    state = learning.learn(log_of(spark, accesses))
    m = {r.path: r.myelination for r in state.vertices.collect()}
    assert abs(m["a"] - 0.0901) < 1e-4 and abs(m["b"] - 0.0545) < 1e-4
    edges = state.edges.collect()
    assert len(edges) == 2 and all(abs(e.weight - 0.612) < 1e-3 and e.co_access_count == 14 for e in edges)
    r = reports.token_report(state.vertices).first()
    assert (r.tokens_without, r.tokens_with, r.tokens_saved) == (30000, 30000, 0)


@pytest.mark.parametrize("seed", range(3))
def test_decomposition_is_the_fold(spark, seed):
    r = random.Random(seed)
    accesses = [(r.randrange(3), f"p{r.randrange(45)}", r.choice(("file", "tool", "error"))) for _ in range(260)]
    want = fold(accesses)
    got = {(e.a, e.b): (e.weight, e.co_access_count) for e in learning.folded(learning.impulses(log_of(spark, accesses))).collect()}
    assert got.keys() == want.keys() and all(abs(got[p][0] - want[p][0]) < 1e-12 and got[p][1] == want[p][1] for p in want)
    lite = fold(accesses, snap=False, capture=False)
    got = {(e.source_id, e.target_id): e.weight for e in learning.learned_lite(log_of(spark, accesses)).edges.filter("source_id < target_id").collect()}
    assert all(abs(got[p] - lite[p][0]) < 1e-12 for p in lite)


def test_first_edge_and_window(spark):
    edges = learning.learned_edges(log_of(spark, [(1, "a"), (1, "b")])).collect()
    assert {e.weight for e in edges} == {0.3} and len(edges) == 2
    w = learning.windows(log_of(spark, [(1, f"p{i}") for i in range(40)])).groupBy("ord").count().agg(F.max("count")).first()[0]
    assert w == 25


def test_folding_on(spark):
    """What was learned before goes on as if it had been one log, hubs aside."""
    accesses = [(i % 2, f"p{i * i % 7}") for i in range(60)]
    given = learning.impulses(log_of(spark, accesses))
    early, late = given.filter("id < 30"), given.filter("id >= 30")
    known = learning.folded(early)
    on = {(r.a, r.b): r.weight for r in learning.folded(late, known).collect()}
    whole = {(r.a, r.b): r.weight for r in learning.folded(given).collect()}
    assert on and all(abs(on[p] - whole[p]) < 1e-12 for p in on)


def test_folding_in_rounds(spark):
    given = learning.impulses(log_of(spark, [(i % 2, f"p{i * i % 5}") for i in range(90)]))
    whole = {(r.a, r.b): tuple(r) for r in learning.folded(given).collect()}
    rounds = {(r.a, r.b): tuple(r) for r in learning.folded(given, most=7).collect()}
    assert whole.keys() == rounds.keys() and max(r[3] for r in rounds.values()) > 14
    assert all(abs(whole[p][2] - rounds[p][2]) < 1e-12 and whole[p][3:] == rounds[p][3:] for p in whole)


@pytest.mark.parametrize("block", [2, 5, 64])
def test_windows_across_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(learning, "BLOCK", block)
    r = random.Random(block)
    accesses = [(r.choice((1, 1, 1, 2)), f"p{r.randrange(40) if i % 3 else 0}") for i in range(150)]
    got = defaultdict(list)
    for w in learning.windows(log_of(spark, accesses)).collect():
        got[w.id].append((w.recency, w.recent, w.len))
    recent = defaultdict(list)
    for i, (session, path) in enumerate(accesses):
        window = recent[session]
        assert sorted(got[i]) == [(k + 1, v, len(window)) for k, v in enumerate(reversed(window))], i
        me = f"file:{path}"
        if me in window:
            window.remove(me)
        window.append(me)
        del window[:-25]


def test_one_long_session(spark):
    rows = spark.range(50_000).selectExpr("id", "1L as session_id", "concat('file:', id * 7919 % 60) as vertex", "'file' as type", "'p' as path", "'c' as context", "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, id) as at", "1500L as token_cost")
    n = learning.windows(rows).agg(F.count("*"), F.max("len"), F.min("recency")).first()
    assert tuple(n) == (sum(min(i, 25) for i in range(50_000)), 25, 1)


def test_a_second_project_leaves_the_first(spark):
    v = spark.createDataFrame([("a", "file", "x/1"), ("b", "file", "y/1"), ("c", "tool", "x/2")], "id string, type string, path string")
    got = learning.tagged_projects(learning.tagged_projects(v, "x", "X"), "y/", "Y")
    assert {r.id: r.project for r in got.collect()} == {"a": "X", "b": "Y", "c": None}


def test_empty_store(spark):
    log = spark.createDataFrame([], LOG)
    state = learning.learn(log)
    assert state.vertices.count() == state.edges.count() == 0
    assert maintenance.decay(state, "2024-02-01").edges.count() == 0
    assert recall.recall(state, log, "anything at all", "2024-02-01").collect() == []
    assert reports.stats(state.vertices, state.edges, log).first().vertices == 0


def test_seeds_resolution_and_ignoring(spark):
    none = spark.createDataFrame([], "source_id string, target_id string, weight double, co_access_count bigint")
    seeds = spark.createDataFrame([("a", "b", 0.7, 5), ("a", "c", 0.8, 1), ("a", "c", 0.2, 1)], "source_id string, target_id string, weight double, n bigint")
    got = {(e.source_id, e.target_id): (e.weight, e.co_access_count) for e in learning.seeded_edges(none, seeds).collect()}
    assert got["a", "b"] == got["b", "a"] == (0.7, 5) and got["c", "a"] == (0.8, 2)
    fixes = spark.createDataFrame([("e", "f", "p")], "error_id string, fix_id string, fingerprint_id string")
    assert {(e.source_id, e.target_id): e.weight for e in learning.resolved_edges(none, fixes).collect()} == {("e", "f"): 0.85, ("f", "e"): 0.85, ("p", "f"): 0.85}
    edges = spark.createDataFrame([("a", "b", 0.5), ("b", "c", 0.8), ("x", "y", 0.05), ("a", "y", 0.05)], "source_id string, target_id string, weight double")
    ignored = spark.createDataFrame([("a", 1), ("b", 1)], "id string, streak bigint")
    w = {(e.source_id, e.target_id): e.weight for e in learning.weakened(edges, ignored, 1 - S.ignored_decay(F.col("streak"))).collect()}
    assert abs(w["a", "b"] - 0.5 * 0.81) < 1e-12 and abs(w["b", "c"] - 0.72) < 1e-12 and w["x", "y"] == w["a", "y"] == 0.05
    s = learning.streaks(ignored, spark.createDataFrame([("a",), ("c",), ("b",)], "id string"), spark.createDataFrame([("b",)], "id string"))
    assert {r.id: r.streak for r in s.collect()} == {"a": 2, "b": 0, "c": 1}


def test_pruning_of_an_old_weak_edge(spark):
    at = datetime(2024, 1, 1)
    edges = spark.createDataFrame([("a", "b", 0.04, 9, at), ("b", "a", 0.2, 9, at), ("a", "c", 0.1, 1, at)], "source_id string, target_id string, weight double, co_access_count bigint, last_fired timestamp_ntz")
    left = maintenance.edges_pruned(State(spark.range(0), edges), "2024-01-09 00:00:00").edges.collect()
    assert [(e.source_id, e.target_id) for e in left] == [("b", "a")]


def test_budget_passes_over_what_costs_too_much(spark):
    rows = [("a", "file", "a", 0.9, "direct"), ("b", "file", "b", 0.8, "direct"), ("c", "error", "c", 0.7, "direct")]
    ranked = spark.createDataFrame(rows, "id string, type string, path string, confidence double, activation_path string")
    got = recall.within_budget(ranked, 2100, [-F.col("confidence"), F.col("id")]).collect()
    assert sorted(r.id for r in got) == ["a", "c"]


def test_triangles_once_each(spark):
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "c"), ("c", "d"), ("b", "d")], "n1 string, n2 string")
    assert sorted(map(tuple, mining.triangles(pairs).collect())) == [("a", "b", "c"), ("b", "c", "d")]
