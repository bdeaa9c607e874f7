import random
import time

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from trailweave.operators import continual, maintenance
from trailweave.streaming import jobs, state

S = 1_000_000


class Value:
    def __init__(self):
        self.v = None

    def exists(self):
        return self.v is not None

    def get(self):
        return self.v

    def update(self, v):
        self.v = v

    put = update

    def clear(self):
        self.v = None


class Map:
    def __init__(self):
        self.d = {}

    def exists(self):
        return bool(self.d)

    def containsKey(self, k):
        return k in self.d

    def getValue(self, k):
        return self.d[k]

    def updateValue(self, k, v):
        self.d[k] = v

    def iterator(self):
        return iter(self.d.items())

    def clear(self):
        self.d = {}


class Handle:
    """A key's state and a clock that is set by hand."""

    def __init__(self):
        self.states, self.timers, self.now = {}, set(), 0

    def _of(self, name, kind):
        return self.states.setdefault(name, kind())

    def getValueState(self, name, schema):
        return self._of(name, Value)

    getListState = getValueState

    def getMapState(self, name, key, value):
        return self._of(name, Map)

    def listTimers(self):
        return iter(sorted(self.timers))

    def deleteTimer(self, t):
        self.timers.discard(t)

    def registerTimer(self, t):
        self.timers.add(t)

    # timer values and expired timers
    def getCurrentProcessingTimeInMs(self):
        return self.now

    getCurrentWatermarkInMs = getExpiryTimeInMs = getCurrentProcessingTimeInMs


class Key:
    """Batches and clock ticks of one key; every call is to a new processor, as after a restart."""

    def __init__(self, make, key=(1,)):
        self.make, self.key, self.handle = make, key, Handle()

    def _new(self):
        p = self.make()
        p.init(self.handle)
        return p

    def rows(self, *rows, at=None):
        self.handle.now = at if at is not None else self.handle.now
        return list(self._new().handleInputRows(self.key, iter(rows), self.handle))

    def tick(self, ms):
        self.handle.now = ms
        out = []
        for t in sorted(t for t in self.handle.timers if t <= ms):
            out += list(self._new().handleExpiredTimer(self.key, self.handle, self.handle))
            self.handle.timers.discard(t)
        return out


def event(id_, us, path="/a.ts", type_="file", source=None):
    return Row(id=id_, us=us, type=type_, path=path, context="c", source=path.endswith(".ts") if source is None else source)


def said(rows):
    return [(r.lane, r.path, r.id) for r in rows]


def test_files_wait_two_seconds_and_snippets_five_by_the_clock():
    k = Key(lambda: state.Lanes(clock="processing"))
    assert said(k.rows(event(1, 0), event(2, 0, "/b.md"), at=10_000)) == []
    assert said(k.rows(event(3, 0), event(4, 0, "run", "tool"), event(5, 0, "boom", "error"), at=11_000)) == [("now", "run", 4), ("now", "boom", 5)]
    assert said(k.tick(11_999)) == [] and said(k.tick(12_000)) == [("files", "/a.ts", 1), ("files", "/b.md", 2)]
    # The path may come again once its batch has gone; its snippets still wait, once.
    assert said(k.rows(event(6, 0), at=12_500)) == []
    assert said(k.tick(14_500)) == [("files", "/a.ts", 6)] and said(k.tick(14_999)) == []
    assert said(k.tick(15_000)) == [("snippets", "/a.ts", 1)] and not k.handle.timers and not k.handle.states["waiting"].exists()


def test_a_full_batch_goes_at_once():
    k = Key(lambda: state.Lanes(most=3, clock="processing"))
    assert said(k.rows(event(1, 0, "/1"), event(2, 0, "/1"), event(3, 0, "/2"), event(4, 0, "/3"), event(5, 0, "/4"), at=0)) == [("files", "/1", 1), ("files", "/2", 3), ("files", "/3", 4)]
    assert said(k.tick(2000)) == [("files", "/4", 5)]


def test_by_their_own_times_a_later_event_ends_what_waits():
    k = Key(lambda: state.Lanes())
    got = k.rows(event(3, 3 * S, "/b.ts"), event(1, 0), event(2, 1 * S, "/c.md"))
    assert said(got) == [("files", "/a.ts", 1), ("files", "/c.md", 2)] and [r.opened for r in got] == [0, 0]
    assert said(k.rows(event(4, 9 * S, "x", "tool"))) == [("files", "/b.ts", 3), ("snippets", "/a.ts", 1), ("snippets", "/b.ts", 3), ("now", "x", 4)]


@pytest.mark.parametrize("seed", range(4))
def test_batches_of_any_size_give_the_same(seed):
    rnd = random.Random(seed)
    rows = sorted((event(i, rnd.randrange(40) * S // 2, f"/{rnd.randrange(4)}.{rnd.choice(['ts', 'md'])}", rnd.choice(["file"] * 5 + ["tool"])) for i in range(60)), key=lambda r: (r.us, r.id))
    one, many = Key(state.Lanes), Key(state.Lanes)
    want = said(one.rows(*rows)) + said(one.tick(10**9))
    got, i = [], 0
    while i < len(rows):
        n = rnd.randrange(1, 6)
        got += said(many.rows(*rows[i : i + n]))
        i += n
    assert sorted(got + said(many.tick(10**9))) == sorted(want)


def test_repeats_are_told_by_the_access_before():
    k = Key(lambda: state.Repeats(state.micros("2 minutes")))
    row = lambda i, us: Row(id=i, us=us)
    days = [row(i, i * 86400 * S) for i in range(3)]
    assert k.rows(*days) == days
    assert [r.id for r in k.rows(row(9, 5 * 86400 * S), row(8, 5 * 86400 * S), row(10, (5 * 86400 + 119) * S))] == [8]
    assert [r.id for r in k.rows(row(11, (5 * 86400 + 238) * S), row(12, (5 * 86400 + 358) * S))] == [12]
    assert k.tick((5 * 86400 + 478) * 1000) == [] and not k.handle.states["last"].exists()


def recall(i, us, session, kind, name):
    return Row(id=i, us=us, session_id=session, kind=kind, name=name)


def test_what_a_session_ignored_is_told_when_it_changes_and_forgotten_after_its_time():
    k = Key(state.Recalled)
    assert k.rows(recall(1, 0, "s", "recalled", "a"), recall(2, 1, "s", "recalled", "b"), recall(3, 2, "s", "opened", "b")) == []
    assert [(r.session_id, r.id, r.reason) for r in k.rows(recall(4, 3600 * S, "t", "recalled", "a"))] == [("s", "a", "changed")]
    # Two hours to the microsecond are not too long; one more is.
    assert k.rows(recall(5, 3 * 3600 * S, "t", "opened", "c")) == []
    assert [(r.session_id, r.id, r.reason) for r in k.rows(recall(6, 5 * 3600 * S + 1, "t", "recalled", "d"))] == [("t", "a", "expired")]
    assert k.tick(7 * 3600 * 1000) == [] and [(r.id, r.reason) for r in k.tick(7 * 3600 * 1000 + 1)] == [("d", "expired")]
    assert not k.handle.states["session"].exists() and not k.handle.states["names"].exists()
    assert k.rows(recall(7, 8 * 3600 * S, "u", "opened", "d")) == []


def test_events_of_lines(spark):
    lines = [
        '{"type": "file", "path": "src/a.ts", "at": "2024-01-01T00:00:00Z"}', '{"file": "/x/b.md", "context": "open"}', '{"type": "tool", "path": "grep", "cmd": "grep x"}',
        '{"type": "error", "path": "node_modules/ is gone"}', '{"type": "note", "path": "/n.py"}', '{"path": "/x/node_modules/c.js"}', '{"path": "", "file": ""}', '{"type": "tool"}', "garbage", "", '{"path": ', "[1]",
    ]
    got = jobs.events_of(spark.createDataFrame([(x,) for x in lines], "value string"), "/home/")
    assert sorted((r.type, r.path, r.context, r.source) for r in got.collect()) == [
        ("error", "node_modules/ is gone", "", False), ("file", "/home/src/a.ts", "socket", True), ("file", "/n.py", "socket", True), ("file", "/x/b.md", "open", False), ("tool", "grep", "grep x", False),
    ]


def test_two_speed_as_a_stream_by_the_clock(spark, tmp_path):
    source, out = tmp_path / "in", []
    source.mkdir()
    lines = spark.readStream.schema("value string").text(f"file://{source}")
    stream = state.two_speed(jobs.events_of(lines).withColumn("at", F.coalesce("at", F.current_timestamp())), "1 second", "2 seconds")
    (source / "1.json").write_text('{"session_id": 1, "id": 1, "path": "/a.ts"}\n{"session_id": 1, "id": 2, "type": "tool", "path": "t"}\n{"session_id": 1, "id": 3, "path": "/a.ts"}\n')
    with jobs.state_store(spark):
        query = stream.writeStream.option("checkpointLocation", f"file://{tmp_path}/checkpoint").trigger(processingTime="500 milliseconds").foreachBatch(lambda b, n: out.extend((r.lane, r.id) for r in b.collect())).start()
    try:
        until = time.time() + 60
        while len(out) < 3 and time.time() < until:
            time.sleep(0.2)
    finally:
        query.stop()
    assert out[0] == ("now", 2) and sorted(out[1:]) == [("files", 1), ("snippets", 1)]


def test_upkeep_only_where_sessions_have_ended(spark, tmp_path):
    from tests.test_store import accesses

    store = continual.store(spark, f"file://{tmp_path}/memory", 2)
    continual.learn_into(store, accesses(spark, 20, 1)[1])
    each = jobs.upkeep_batches(store, "ends", maintenance.decayed)
    each(spark.createDataFrame([], "session_id bigint"), 0)
    assert store.version().number == 1
    each(spark.range(2), 1)
    each(spark.range(2), 1)
    assert store.version().number == 2 and store.version().ledger == {"ends": 1}


def test_weakening_counts_each_time_once(spark, tmp_path):
    from tests.test_store import accesses

    store = continual.store(spark, f"file://{tmp_path}/memory", 2)
    continual.learn_into(store, accesses(spark, 40, 2, vertices=6)[1])
    before = {(r.source_id, r.target_id): r.weight for r in continual.read(store).edges.collect()}
    told = spark.createDataFrame([(1, "s", "file:1", "changed", 0), (2, "u", "file:1", "changed", 0), (1, "s", "file:2", "expired", 0)], state.IGNORED_DDL)
    each = jobs.weakening_batches(store, "recall")
    each(told, 7)
    each(told, 7)
    after = {(r.source_id, r.target_id): r.weight for r in continual.read(store).edges.collect()}
    assert before.keys() == after.keys() and all(after[k] == pytest.approx(max(0.1, w * 0.81) if "file:1" in k else w) for k, w in before.items())


def test_repeats_of_a_sessions_names_are_told_apart_in_one_state():
    """A session's vertices are one key: one state is read and written for all of them. What is over goes with the next
    rows, or with the timer."""
    k = Key(lambda: state.Repeats(10 * S, name="vertex"))
    row = lambda i, us, v: Row(id=i, us=us, vertex=v)
    assert [r.id for r in k.rows(row(1, 0, "a"), row(2, S, "b"), row(3, 5 * S, "a"), row(4, 14 * S, "a"), row(5, 12 * S, "b"))] == [1, 2, 5]
    assert k.handle.states["last"].get() == (["a", "b"], [14 * S, 12 * S]) and k.handle.timers == {24_000}
    assert [r.id for r in k.rows(row(6, 23 * S, "a"), at=22_500)] == [] and k.handle.states["last"].get() == (["a"], [23 * S])
    assert k.tick(33_000) == [] and not k.handle.states["last"].exists() and not k.handle.timers


def test_what_is_recalled_is_written_once_a_batch():
    """Of 300 rows of 100 sessions only what the last one holds is written."""
    k, written = Key(state.Recalled), []
    names = k.handle.getMapState("names", "name string", "recalled boolean, opened boolean")
    names.updateValue = lambda name, value: written.append(name) or names.d.update({name: value})
    got = k.rows(*(recall(3 * i + j, (3 * i + j) * S, f"s{i}", "opened" if j == 2 else "recalled", "abb"[j]) for i in range(100) for j in range(3)))
    assert [(r.session_id, r.id) for r in got] == [(f"s{i}", "a") for i in range(99)] and len(written) == 2
    # What is there from the batch before is known, and told with what this one adds.
    assert k.rows(recall(400, 301 * S, "s99", "opened", "a"), recall(401, 302 * S, "s99", "recalled", "c")) == []
    assert [(r.id, r.reason) for r in k.rows(recall(402, 303 * S, "t", "opened", "a"))] == [("c", "changed")] and names.d == {("a",): (False, True)}


def test_weakening_doesnt_write_what_is_recent_again(spark, tmp_path):
    from tests.test_store import accesses

    store = continual.store(spark, f"file://{tmp_path}/memory", 2)
    before = continual.learn_into(store, accesses(spark, 40, 2, vertices=6)[1])
    jobs.weakening_batches(store, "recall")(spark.createDataFrame([(1, "s", "file:1", "changed", 0)], state.IGNORED_DDL), 0)
    after = store.version()
    assert after.number == 2 and after.tables["recent"] == before.tables["recent"] and after.tables["edges"] != before.tables["edges"]
    assert continual.read(store).recent.count() == continual.read(store, before).recent.count() > 0
