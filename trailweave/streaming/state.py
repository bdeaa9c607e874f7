"""Keyed state of streams: repeats within a time, lanes that wait, and what a session recalled and didn't open.

Times are microseconds. With an event clock a key's rows of a batch are taken in the order of their own times, and
timers fire when the watermark has passed them; with a processing clock rows are taken as they come, at the time of the
batch. What a key holds is named with each class; all of it goes when its time is over."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def micros(interval: str) -> int:
    """An interval of a number and a unit, as "2 seconds"."""
    n, unit = interval.split()
    return int(float(n) * {"millisecond": 1e3, "second": 1e6, "minute": 6e7, "hour": 3.6e9, "day": 8.64e10}[unit.rstrip("s")])


class _Timed(StatefulProcessor):
    """Rows in order of time, and one timer a key."""

    clock = "event"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def close(self) -> None:
        pass

    def timed(self, rows: Iterator[Row], timer_values) -> list[tuple[int, Row]]:
        if self.clock == "event":
            return sorted(((row.us, row) for row in rows), key=lambda x: (x[0], x[1].id))
        now = timer_values.getCurrentProcessingTimeInMs() * 1000
        return [(now, row) for row in rows]

    def wake(self, us: int | None, fresh: bool = False) -> None:
        """Asks to be called at a time, and at no other. fresh: the key had no state, and so has no timer."""
        for timer in () if fresh else list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if us is not None:
            self.handle.registerTimer(-(-us // 1000))


class Repeats(_Timed):
    """Rows of a key that come `within` or more after the one before, by their `name` if one is given. Holds the time of
    each name's last, until the watermark or the clock has passed it by so long when the key has rows again, or all of
    them. A call to the state costs more than a row, so a key's names are read and written together."""

    def __init__(self, within: int, clock: str = "event", name: str | None = None):
        self.within, self.clock, self.name = within, clock, name

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "names array<string>, us array<bigint>")

    def held(self, last: dict[str | None, int], ms: int, fresh: bool) -> None:
        """Holds of last what isn't over by a time."""
        on = {name: us for name, us in last.items() if us + self.within > ms * 1000}
        if on:
            self.last.update((list(on), list(on.values())))
        elif not fresh:
            self.last.clear()
        if on or not fresh:
            self.wake(max(on.values()) + self.within if on else None, fresh)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        was = self.last.get()
        last = dict(zip(*was)) if was else {}
        for us, row in self.timed(rows, timerValues):
            name = row[self.name] if self.name else None
            before = last.get(name)
            if before is None or us - before >= self.within:
                yield row
            last[name] = us if before is None else max(before, us)
        self.held(last, timerValues.getCurrentWatermarkInMs() if self.clock == "event" else timerValues.getCurrentProcessingTimeInMs(), not was)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if was := self.last.get():
            self.held(dict(zip(*was)), expiredTimerInfo.getExpiryTimeInMs(), False)
        return iter(())


#: What leaves a lane: rows of the given lane, when its batch was opened.
LANES_DDL = "lane string, session_id bigint, id bigint, type string, path string, context string, us bigint, opened bigint"


class Lanes(_Timed):
    """Tools and errors at once; files, and those of which snippets can be cut, in batches of distinct paths, a lane
    each: a batch goes `delay` after it was opened by its first path, or when it has `most` paths. Rows have id, type,
    path, context, us and source. Holds the paths that wait: `most` files, and the sources of one delay."""

    def __init__(self, files: int = 2_000_000, snippets: int = 5_000_000, most: int = 50, clock: str = "event"):
        self.delays, self.most, self.clock = {"files": files, "snippets": snippets}, {"files": most, "snippets": None}, clock

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.waiting = handle.getListState("waiting", "lane string, id bigint, type string, path string, context string, us bigint, opened bigint")

    def gone(self, key, lane: str, queue: dict) -> Iterator[Row]:
        for path, (id_, type_, context, us, opened) in queue.items():
            yield Row(lane=lane, session_id=key[0], id=id_, type=type_, path=path, context=context, us=us, opened=opened)
        queue.clear()

    def loaded(self) -> dict[str, dict]:
        queues: dict[str, dict] = {lane: {} for lane in self.delays}
        for lane, id_, type_, path, context, us, opened in self.waiting.get() if self.waiting.exists() else ():
            queues[lane][path] = (id_, type_, context, us, opened)
        return queues

    def held(self, queues: dict[str, dict]) -> None:
        every = [(lane, id_, type_, path, context, us, opened) for lane, queue in queues.items() for path, (id_, type_, context, us, opened) in queue.items()]
        if every:
            self.waiting.put(every)
        else:
            self.waiting.clear()
        self.wake(min((x[-1] + self.delays[x[0]] for x in every), default=None))

    def due(self, key, queues: dict[str, dict], now: int) -> Iterator[Row]:
        for lane, queue in queues.items():
            if queue and now >= next(iter(queue.values()))[-1] + self.delays[lane]:
                yield from self.gone(key, lane, queue)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        queues = self.loaded()
        for now, row in self.timed(rows, timerValues):
            yield from self.due(key, queues, now)
            if row.type in ("tool", "error"):
                yield Row(lane="now", session_id=key[0], id=row.id, type=row.type, path=row.path, context=row.context, us=row.us, opened=now)
                continue
            for lane in ("files", "snippets") if row.source else ("files",):
                queue = queues[lane]
                if row.path not in queue:
                    opened = next(iter(queue.values()))[-1] if queue else now
                    queue[row.path] = (row.id, "file", row.context, row.us, opened)
                    if self.most[lane] is not None and len(queue) >= self.most[lane]:
                        yield from self.gone(key, lane, queue)
        self.held(queues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        # All that is due by now: a timer that is set here fires with the next batch only.
        now = timerValues.getCurrentWatermarkInMs() if self.clock == "event" else timerValues.getCurrentProcessingTimeInMs()
        queues = self.loaded()
        yield from self.due(key, queues, max(now, expiredTimerInfo.getExpiryTimeInMs()) * 1000)
        self.held(queues)


#: What was recalled and not opened, and what ended its session.
IGNORED_DDL = "agent bigint, session_id string, id string, reason string, us bigint"


class Recalled(_Timed):
    """By agent, what its session recalled and did not open, when the session changes (reason changed) or when nothing
    has been recalled or opened for longer than `ttl` (reason expired: it is forgotten, and weakens nothing). Rows have
    session_id, kind (recalled or opened), name and us. Holds the names of one session."""

    def __init__(self, ttl: int = 7_200_000_000, clock: str = "event"):
        self.ttl, self.clock = ttl, clock

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.session = handle.getValueState("session", "session_id string, last bigint")
        self.names = handle.getMapState("names", "name string", "recalled boolean, opened boolean")

    def ended(self, key, session: str, reason: str, us: int, held: dict, stored: bool) -> Iterator[Row]:
        every = {name[0]: value for name, value in self.names.iterator()} | held if stored else held
        for name, (recalled, opened) in sorted(every.items()):
            if recalled and not opened:
                yield Row(agent=key[0], session_id=session, id=name, reason=reason, us=us)
        if stored:
            self.names.clear()
            self.session.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        was = self.session.get()
        # held: what the rows tell, which is written at the end; a call to the state costs more than a row.
        (session, last), held, stored = was or (None, None), {}, bool(was)
        for now, row in self.timed(rows, timerValues):
            over = last is not None and now - last > self.ttl
            if over or (session is not None and session != row.session_id):
                yield from self.ended(key, session, "expired" if over else "changed", last, held, stored)
                held, stored = {}, False
            before = held.get(row.name)
            if before is None:
                before = self.names.getValue((row.name,)) if stored and self.names.containsKey((row.name,)) else (False, False)
            held[row.name] = (before[0] or row.kind == "recalled", before[1] or row.kind == "opened")
            session, last = row.session_id, now if last is None else max(last, now)
        for name, value in held.items():
            self.names.updateValue((name,), value)
        self.session.update((session, last))
        self.wake(last + self.ttl + 1, not was)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if was := self.session.get():
            session, last = was
            yield from self.ended(key, session, "expired", last, {}, True)


def _through(stream: DataFrame, keys: list[str], processor: _Timed, schema, late: str) -> DataFrame:
    timed = stream.withColumn("us", F.unix_micros("at"))
    timed = timed.withWatermark("at", late) if processor.clock == "event" else timed
    mode = "EventTime" if processor.clock == "event" else "ProcessingTime"
    return timed.groupBy(*keys).transformWithState(processor, schema, "Append", mode)


def without_repeats(stream: DataFrame, within: str = "2 minutes", late: str = "1 hour", clock: str = "event") -> DataFrame:
    """Accesses (session_id, vertex, at, id, ...) of a session to a vertex that come `within` or more after the one
    before."""
    schema = stream.withColumn("us", F.unix_micros("at")).schema
    return _through(stream, ["session_id"], Repeats(micros(within), clock, "vertex"), schema, late).drop("us")


def two_speed(stream: DataFrame, files: str = "2 seconds", snippets: str = "5 seconds", most: int = 50, late: str = "1 hour", clock: str = "processing") -> DataFrame:
    """LANES_DDL of events (session_id, at, id, type, path, context, source): see Lanes."""
    return _through(stream, ["session_id"], Lanes(micros(files), micros(snippets), most, clock), LANES_DDL, late)


def ignored(stream: DataFrame, ttl: str = "2 hours", late: str = "1 hour", clock: str = "processing") -> DataFrame:
    """IGNORED_DDL of what agents recalled and opened (agent, session_id, kind, name, at, id): see Recalled."""
    return _through(stream, ["agent"], Recalled(micros(ttl), clock), IGNORED_DDL, late)
