"""Fixed-window rate limiting by key. A window opens with a key's first event and closes window_ms later."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from brevier.streaming.state import use_rocksdb

WINDOW_MS = 600_000
LIMIT = 10
MOST_KEYS = 5000


def advance(state: tuple[int, int] | None, now: int, window_ms: int, limit: int) -> tuple[tuple[int, int], bool]:
    """State (count, window start) after an attempt, and whether it is blocked; blocked attempts count, too."""
    if state is None or now - state[1] > window_ms:
        state = (0, now)
    state = (state[0] + 1, state[1])
    return state, state[0] > limit


def limited(
    events: DataFrame, key: str = "ip", at: str = "ts_ms", tie: str | None = None, window_ms: int = WINDOW_MS, limit: int = LIMIT
) -> DataFrame:
    """events with limited, for a whole table: each key's events in order of time.

    Rows are dealt by key and sorted; one pass carries a key's state over batches, so that memory doesn't grow
    with a key's events.
    """
    columns = events.columns
    place = (columns.index(key), columns.index(at))

    def run(batches):
        last, state = object(), None
        for batch in batches:
            out = []
            for k, now in zip(batch.column(place[0]).to_pylist(), batch.column(place[1]).to_pylist(), strict=True):
                if k != last:
                    last, state = k, None
                state, blocked = advance(state, now, window_ms, limit)
                out.append(blocked)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.bool_())], [*columns, "limited"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema.fields)
    order = [key, at] + [tie] * bool(tie)
    return events.repartition(F.col(key)).sortWithinPartitions(*order).mapInArrow(run, f"{kinds}, limited boolean")


def limited_stream(events: DataFrame, key: str = "ip", at: str = "ts_ms", window_ms: int = WINDOW_MS, limit: int = LIMIT) -> DataFrame:
    """(key, at, limited) for a stream of attempts. A key's state goes once its window is over and it stays silent."""

    def step(name, batches: Iterator[pd.DataFrame], state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        held = tuple(state.get) if state.exists else None
        rows = pd.concat(list(batches)).sort_values(at)
        out = []
        for now in rows[at]:
            held, blocked = advance(held, int(now), window_ms, limit)
            out.append(blocked)
        state.update(held)
        state.setTimeoutDuration(window_ms)
        yield pd.DataFrame({key: [name[0]] * len(out), at: rows[at].to_numpy(), "limited": out})

    return events.groupBy(key).applyInPandasWithState(
        step, f"{key} string, {at} long, limited boolean", "count long, start long", "append", GroupStateTimeout.ProcessingTimeTimeout
    )


class Windows:
    """The open windows (count, start) of at most `most` keys.

    A key more makes room first by the windows that are over, which changes no answer, and if that isn't enough by the
    keys whose windows opened first (ties: by name), which begin anew when they come back.
    """

    def __init__(self, window_ms: int, limit: int, most: int, held: dict[str, tuple[int, int]] | None = None):
        self.window_ms, self.limit, self.most = window_ms, limit, most
        self.held = held or {}
        self.by_start = [(start, name) for name, (_, start) in self.held.items()]
        heapq.heapify(self.by_start)

    def attempt(self, name: str, now: int) -> bool:
        """Count an attempt; whether it is blocked."""
        before = self.held.get(name)
        self.held[name], blocked = advance(before, now, self.window_ms, self.limit)
        if before is None or before[1] != self.held[name][1]:
            heapq.heappush(self.by_start, (self.held[name][1], name))
        if len(self.held) > self.most:
            self.drop_over(now)
        while len(self.held) > self.most:
            self.drop_first()
        return blocked

    def drop_over(self, now: int) -> None:
        while self.by_start and now - self.by_start[0][0] > self.window_ms:
            self.drop_first()

    def drop_first(self) -> None:
        start, name = heapq.heappop(self.by_start)
        if self.held.get(name, (0, None))[1] == start:  # else the key's window is a later one, or gone
            del self.held[name]


class Limiter(StatefulProcessor):
    """The windows of a bucket of keys as one state value; an event-time timer drops those that are over."""

    def __init__(self, columns: list[str], key: str, at: str, order: list[str], window_ms: int, limit: int, most: int):
        self.columns, self.key, self.at, self.order = columns, key, at, order
        self.shape = window_ms, limit, most

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("windows", "names array<string>, counts array<long>, starts array<long>")

    def windows(self) -> Windows:
        names, counts, starts = self.state.get() if self.state.exists() else ([], [], [])
        return Windows(*self.shape, dict(zip(names, zip(counts, starts, strict=True), strict=True)))

    def keep(self, windows: Windows) -> None:
        if not windows.held:
            self.state.clear()
            return
        names = list(windows.held)
        counts, starts = zip(*windows.held.values(), strict=True)
        self.state.update((names, list(counts), list(starts)))
        for old in self.handle.listTimers():
            self.handle.deleteTimer(old)
        self.handle.registerTimer(min(starts) + self.shape[0] + 1)

    def handleInputRows(self, key, rows, timerValues):
        windows = self.windows()
        batch = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        batch["limited"] = [windows.attempt(name, int(now)) for name, now in zip(batch[self.key], batch[self.at], strict=True)]
        self.keep(windows)
        yield batch[[*self.columns, "limited"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        windows = self.windows()
        windows.drop_over(timerValues.getCurrentWatermarkInMs())
        self.keep(windows)
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def limited_in_buckets(
    events: DataFrame,
    key: str = "ip",
    at: str = "ts_ms",
    tie: str | None = None,
    window_ms: int = WINDOW_MS,
    limit: int = LIMIT,
    most_keys: int = MOST_KEYS,
    buckets: int = 200,
    late: str = "1 minute",
) -> DataFrame:
    """events of a stream with limited; the state holds at most most_keys keys a bucket, however many come.

    Keys are dealt to buckets by their hash: one bucket keeps what a single server's map would, and evicts as that would.
    `at` is in milliseconds. A window that is over by the watermark, `late` behind the latest event, is dropped by a timer;
    events that come later than that are dropped. Events of one batch count in order of time, then tie. A null key is a key.
    """
    use_rocksdb(events.sparkSession)
    columns = events.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema.fields)
    order = [at] + [tie] * bool(tie)
    timed = events.withColumn("__bucket", F.pmod(F.xxhash64(key), F.lit(buckets))).withColumn("__at", F.timestamp_millis(at))
    return (
        timed.withWatermark("__at", late)
        .groupBy("__bucket")
        .transformWithStateInPandas(Limiter(columns, key, at, order, window_ms, limit, most_keys), f"{kinds}, limited boolean", "Append", "EventTime")
    )
