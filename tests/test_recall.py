"""Recall in small graphs: ways, budgets, what a session is told; errors and tags."""

from datetime import datetime


from trailweave.operators import learning, maintenance, recall
from trailweave.operators.learning import State

EDGES = "source_id string, target_id string, weight double"


def state_of(spark, kinds, edges):
    vertices = spark.createDataFrame([(v, k, v, 0.0) for v, k in kinds.items()], "id string, type string, path string, myelination double")
    return State(vertices, spark.createDataFrame(edges, EDGES))


def seeds_of(spark, *ids):
    return spark.createDataFrame([(i, "file", i, 1.0, "direct") for i in ids], "id string, type string, path string, confidence double, activation_path string")


def test_the_way_is_told_and_the_budget_kept(spark):
    kinds = {"a": "file", "b": "file", "c": "error", "d": "file", "t": "tool"}
    state = state_of(spark, kinds, [("a", "b", 0.9), ("b", "c", 0.9), ("c", "d", 0.9), ("a", "t", 0.2)])
    got = {r.id: (r.activation_path, round(r.confidence, 4)) for r in recall.spread(state, seeds_of(spark, "a")).collect()}
    assert got == {"a": ("direct", 1.0), "b": ("spread(1) via a", 0.6364), "c": ("spread(2) via a → b", 0.5728), "d": ("spread(3) via a → b → c", 0.5155)}
    assert {r.id for r in recall.spread(state, seeds_of(spark, "a"), budget=2000).collect()} == {"a", "b", "c"}
    assert {r.id for r in recall.spread(state, seeds_of(spark, "a"), budget=1000).collect()} == {"a"}


def test_a_hub_of_fifteen_spokes(spark):
    kinds = {"hub": "file", **{f"s{i:02}": "file" for i in range(15)}}
    state = state_of(spark, kinds, [("hub", f"s{i:02}", 0.5 + i / 100) for i in range(15)])
    ways = recall.onward(state.edges).collect()
    assert len(ways) == 10 and min(w.weight for w in ways) == 0.55 and {round(w.fan, 6) for w in ways} == {round(15**-0.5, 6)}


def test_what_a_session_is_told(spark):
    got = spark.createDataFrame([("f", "file", "/r/f.py", 0.9, "direct"), ("g", "file", "/x/g.py", 0.95, "direct"), ("p", "file", "/r/package.json", 0.99, "direct"), ("h", "file", "/r/h.py", 0.4, "direct")], "id string, type string, path string, confidence double, activation_path string")
    vertices = spark.createDataFrame([("f", "file", "/r/f.py"), ("k", "file", "/r/k.py"), ("l", "file", "/r/l.py")], "id string, type string, path string")
    told = spark.createDataFrame([("/r/f.py", 0.9), ("/r/k.py", 0.8), ("/r/l.py", 0.7), ("/r/none.py", 1.0)], "path string, confidence double")
    rows = recall.performed(got, told, vertices, limit=2, least=0.5, root="/r").collect()
    assert [(r.id, round(r.confidence, 3), r.activation_path) for r in rows] == [("f", 0.9, "direct"), ("k", 0.72, "commit")]


def test_vectors(spark):
    v = spark.createDataFrame([("a", "red green"), ("b", "red"), ("c", ""), ("d", None)], "id string, text string")
    got = {r.id: r.embedding for r in recall.embedded(v).collect()}
    assert got.keys() == {"a", "b"} and all(abs(sum(x * x for x in e) - 1) < 1e-9 and len(e) == 64 for e in got.values())


def test_errors_are_wired_to_their_fingerprints(spark):
    errors = spark.createDataFrame([(1, datetime(2024, 1, 1), 5, "TypeError: Cannot read property 'a' of null"), (1, datetime(2024, 1, 2), 6, "TypeError: Cannot read property 'b' of null")], "session_id long, at timestamp_ntz, id long, message string")
    log = learning.errors_told(errors).orderBy("id").collect()
    assert [r.id for r in log] == [10, 11, 12, 13] and log[0].vertex == log[2].vertex != log[1].vertex == "error:TYPE_ERROR|property_access" and log[1].context == log[0].path
    none = spark.createDataFrame([], EDGES + ", co_access_count long")
    wired = learning.wired_errors(none, errors)
    assert sorted((round(r.weight, 4), r.co_access_count) for r in wired.collect()) == [(0.88, 2), (0.88, 2)]


def test_tags_capture_and_expire(spark):
    at = "2024-01-01 12:00:00"
    rows = [("a", "b", 0.15, datetime(2024, 1, 1, 11, 30)), ("c", "d", 0.15, datetime(2024, 1, 1, 10, 30)), ("e", "f", 0.5, None)]
    state = State(spark.range(0), spark.createDataFrame(rows, EDGES + ", tagged_at timestamp_ntz"))
    hit = spark.createDataFrame([("b",), ("c",), ("e",)], "id string")
    got = {r.source_id: (r.weight, r.tagged_at) for r in maintenance.captured(state, hit, at).edges.collect()}
    assert got == {"a": (0.3, None), "c": (0.15, rows[1][3]), "e": (0.5, None)}
    left = {r.source_id: r.tagged_at for r in maintenance.tags_expired(state, at).edges.collect()}
    assert left == {"a": rows[0][3], "c": None, "e": None}


def test_recall_of_a_project(spark):
    vertices = spark.createDataFrame([("a", "P"), ("b", None)], "id string, project string")
    assert [r.id for r in recall.recall_in_project(State(vertices, vertices), "P", seeds_of(spark, "a", "b")).collect()] == ["a"]


def test_what_was_told_is_tracked(spark):
    from trailweave.operators import recall
    from trailweave.streaming import state

    told = spark.createDataFrame([("file:a", "file", "a", 0.9, "direct"), ("error:b", "error", "b", 0.8, "direct")], "id string, type string, path string, confidence double, activation_path string")
    rows = recall.tracked(told, 3, "s", "2024-01-01 00:00:00")
    assert [(r.agent, r.session_id, r.kind, r.name) for r in rows.collect()] == [(3, "s", "recalled", "file:a")]
    assert state.Recalled and set(rows.columns) == {"agent", "session_id", "kind", "name", "at", "id"}
    vertices = spark.createDataFrame([("file:a", "file", 0.456), ("error:b", "error", 0.1)], "id string, type string, myelination double").selectExpr("*", "timestamp_ntz'2024-01-01' as last_accessed")
    got = {r.text: (r.kind, r.confidence, r.myelin) for r in recall.session_message(told, vertices, "2024-01-05 00:00:00").collect()}
    assert got == {"a": ("result", 90, 46), "b": ("result", 80, 10)}
    assert ("alert", None, None) in {(r.kind, r.confidence, r.myelin) for r in recall.session_message(told, vertices, "2024-02-05 00:00:00").collect()}
