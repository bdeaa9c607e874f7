import random
import re

import pytest
from pyspark.sql import functions as F

from trailweave.operators import continual, learning, maintenance, recall
from trailweave.sources.store import Conflict, MemoryStore, Version, fingerprint

LOG = "id bigint, session_id bigint, vertex string, type string, path string, context string, at timestamp_ntz, token_cost bigint"


def accesses(spark, n, seed, vertices=30, sessions=3):
    from datetime import datetime, timedelta

    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        name = f"{rnd.randrange(vertices)}"
        kind = "error" if int(name) % 7 == 0 else "file"
        rows.append((i, rnd.randrange(sessions), f"{kind}:{name}", kind, name, f"c{rnd.randrange(30)}", datetime(2024, 1, 1) + timedelta(minutes=i // 3), 500))
    return rows, spark.createDataFrame(rows, LOG)


def edges_of(df):
    return sorted((r.source_id, r.target_id, round(r.weight, 9), r.co_access_count, r.last_fired) for r in df.collect())


def vertices_of(df):
    return sorted((r.id, r.type, r.path, r.activation, round(r.myelination, 9), r.access_count, r.last_accessed, tuple(r.contexts)) for r in df.collect())


@pytest.fixture
def store(spark, tmp_path):
    return continual.store(spark, f"file://{tmp_path}/memory", 4)


def test_day_by_day_is_all_at_once(spark, store):
    rows, log = accesses(spark, 260, 1)
    cuts = [0, 1, 120, 260]
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        continual.learn_into(store, log.filter(F.col("id").between(a, b - 1)), ("log", k))
    got, want = continual.read(store), learning.learn(log)
    assert edges_of(got.edges) == edges_of(want.edges)
    assert vertices_of(got.vertices) == vertices_of(want.vertices)
    assert store.version().number == 3 and max(got.recent.groupBy("session_id").count().toPandas()["count"]) == 25


def test_a_batch_that_comes_again_changes_nothing(spark, store):
    _, log = accesses(spark, 40, 3)
    first = continual.learn_into(store, log, ("q", 4))
    assert continual.learn_into(store, log, ("q", 4)) == first and continual.learn_into(store, log, ("q", 3)) == first
    assert continual.learn_into(store, log, ("other", 0)).ledger == {"q": 4, "other": 0}


def test_of_two_writers_one_waits(spark, store):
    _, log = accesses(spark, 60, 4)
    early, late = log.filter("id < 30"), log.filter("id >= 30")
    base = store.version()
    mine = continual.continued(continual.blank(spark), early).tables()
    continual.learn_into(store, early, ("a", 0))
    with pytest.raises(Conflict):
        store.commit(base, mine, ("b", 0))
    assert store.version().ledger == {"a": 0} and store.versions() == [1]
    # A writer that is overtaken while it works takes its step again, on what the other wrote.
    calls = []

    def step(tables):
        if not calls:
            calls.append(1)
            continual.learn_into(store, late, ("a", 1))
        return {"told": tables["told"].limit(1)}

    assert store.update(step, ("c", 0)).number == 3
    assert store.version().ledger == {"a": 1, "c": 0} and edges_of(continual.read(store).edges) == edges_of(learning.learned_edges(log))


def test_a_version_that_was_not_published_is_not_there(spark, store, monkeypatch):
    _, log = accesses(spark, 30, 5)
    continual.learn_into(store, log.filter("id < 10"), ("q", 0))

    def fails(self, version):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(MemoryStore, "_publish", fails)
        with pytest.raises(OSError):
            continual.learn_into(store, log.filter("id >= 10"), ("q", 1))
    assert store.version().number == 1
    continual.learn_into(store, log.filter("id >= 10"), ("q", 1))
    assert edges_of(continual.read(store).edges) == edges_of(learning.learned_edges(log))


def test_old_versions_can_be_read_until_they_expire(spark, store):
    _, log = accesses(spark, 30, 6)
    for k in range(3):
        continual.learn_into(store, log.filter(F.col("id") % 3 == k), ("q", k))
    old = store.version(1)
    assert continual.read(store, old).told.agg(F.sum("n")).first()[0] == 10
    store.expire(1)
    assert store.versions() == [3] and continual.read(store).told.agg(F.sum("n")).first()[0] == 30
    assert store.version(3).tables["edges"]["path"] != old.tables["edges"]["path"]


def exchanges(df):
    return re.findall(r"Exchange hashpartitioning\((\w+)#", df._jdf.queryExecution().executedPlan().toString())


def test_a_version_is_read_without_moving_its_edges(spark, store):
    _, log = accesses(spark, 120, 7)
    continual.learn_into(store, log, ("q", 0))
    state = continual.read(store).state
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert exchanges(recall.onward(state.edges)) == []
        frontier = spark.createDataFrame([("file:1", 0.9)], "source_id string, confidence double")
        assert exchanges(frontier.join(recall.onward(state.edges), "source_id")) == ["source_id"]
        assert exchanges(maintenance.decayed(state).edges) == [] and exchanges(state.edges.groupBy("source_id").count()) == []
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    before = edges_of(state.edges)
    version = continual.keep_up(store, maintenance.decayed, ("decay", 0), in_place=["vertices", "edges"])
    after = continual.read(store, version)
    assert [r[2] for r in edges_of(after.edges)] == pytest.approx([r[2] * 0.98 for r in before])
    assert exchanges(recall.onward(after.edges)) == [] and continual.keep_up(store, maintenance.decayed, ("decay", 0)).number == version.number


def test_learning_goes_on_from_what_upkeep_has_left(spark, store):
    _, log = accesses(spark, 60, 8)
    first, second = log.filter("id < 50"), log.filter("id >= 50")
    continual.learn_into(store, first)
    faded = continual.read(store, continual.keep_up(store, maintenance.decayed)).vertices.collect()
    continual.learn_into(store, second)
    now = {r.id: r for r in continual.read(store).vertices.collect()}
    counts = {r.vertex: r["count"] for r in second.groupBy("vertex").count().collect()}
    for v in faded:
        m, n = v.myelination, v.access_count
        for k in range(counts.get(v.id, 0)):
            m += 0.02 * (1 - m / 0.95) * max(1 / (n + k) ** 0.5, 0.1)
        assert now[v.id].myelination == pytest.approx(m, abs=1e-9) and now[v.id].activation == (1.0 if v.id in counts else v.activation)


def test_upkeep_takes_away_for_good(spark, store):
    _, log = accesses(spark, 60, 9)
    continual.learn_into(store, log.filter("id < 50"))
    gone = "file:1"

    def step(state):
        return maintenance.without_loose_edges(state.but(vertices=state.vertices.filter(F.col("id") != gone)))

    continual.keep_up(store, step)
    continual.learn_into(store, log.filter("id >= 50"))
    after = continual.read(store)
    left = log.filter((F.col("id") >= 50) & (F.col("vertex") == gone)).count()
    assert after.vertices.filter(F.col("id") == gone).agg(F.coalesce(F.sum("access_count"), F.lit(0))).first()[0] == left


def test_ended_sessions_are_not_carried(spark):
    _, log = accesses(spark, 60, 10, sessions=1)
    none = continual.blank(spark).recent
    assert continual.recent_after(none, log, open_since="2024-01-02 00:00:00").count() == 0
    assert continual.recent_after(none, log, size=5).count() == 5


def test_an_empty_memory(spark, store):
    assert continual.read(store).edges.count() == 0 and store.version() == Version()
    continual.learn_into(store, accesses(spark, 0, 1)[1])
    assert continual.read(store).vertices.count() == 0 and store.version().number == 1


def test_fingerprint_tells_changed_files(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a").write_text("x")
    before = fingerprint(spark, [f"file://{tmp_path}/t"])
    assert before == fingerprint(spark, [f"file://{tmp_path}/t"])
    (tmp_path / "t" / "a").write_text("xy")
    assert before != fingerprint(spark, [f"file://{tmp_path}/t"])
