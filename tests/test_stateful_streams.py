"""Keyed state over micro-batches, against sequential passes over the same events."""

import random

import pytest
from pyspark.sql import functions as F

from brevier.streaming import ratelimit, sse, state


class Landing:
    """A folder that batches land in one after the other, each of them run by itself over one checkpoint."""

    def __init__(self, spark, tmp_path, schema):
        self.spark, self.place, self.schema = spark, str(tmp_path), schema
        self.batches = 0

    def stream(self):
        return self.spark.readStream.schema(self.schema).parquet(f"{self.place}/in")

    def run(self, rows, make):
        self.spark.createDataFrame(rows, self.schema).repartition(2).write.mode("append").parquet(f"{self.place}/in")
        stream = make(self.stream())
        self.columns = stream.schema
        state.run_to_end(stream, f"{self.place}/progress", f"{self.place}/out", "append" if "limited" in stream.columns else "update")

    def said(self):
        return state.said(self.spark, f"{self.place}/out", self.columns)


class Map:
    """A map of windows as one server keeps it: over 'most' keys the ended go, then the oldest."""

    def __init__(self, window_ms, limit, most):
        self.window_ms, self.limit, self.most, self.held = window_ms, limit, most, {}

    def attempt(self, name, now):
        count, start = self.held.get(name, (0, now))
        if now - start > self.window_ms:
            count, start = 0, now
        self.held[name] = (count + 1, start)
        if len(self.held) > self.most:
            self.held = {k: v for k, v in self.held.items() if now - v[1] <= self.window_ms}
        while len(self.held) > self.most:
            del self.held[min(self.held, key=lambda k: (self.held[k][1], k))]
        return count + 1 > self.limit


def attempts(rng, n, span, keys):
    times = sorted(rng.sample(range(span), n))
    return [(f"k{min(rng.randrange(keys), rng.randrange(keys))}", t, k) for k, t in enumerate(times)]


def test_windows_equal_a_sequential_map():
    rng = random.Random(1)
    for most in (1, 3, 20, 5000):
        own, other = ratelimit.Windows(1000, 3, most), Map(1000, 3, most)
        for name, now, _ in attempts(rng, 3000, 20_000, 40):
            assert own.attempt(name, now) == other.attempt(name, now)
        assert own.held == other.held


def test_limits_with_eviction_over_batches(spark, tmp_path):
    rng = random.Random(2)
    rows = attempts(rng, 600, 60_000, 12)
    schema = "ip string, ts_ms long, n long"
    landing, single = Landing(spark, tmp_path, schema), Map(8000, 3, 5)
    make = lambda s: ratelimit.limited_in_buckets(s, tie="n", window_ms=8000, limit=3, most_keys=5, buckets=1, late="0 seconds")
    for low in (0, 250, 300):
        landing.run(rows[low : {0: 250, 250: 300, 300: 600}[low]], make)
    got = {r.n: r.limited for r in landing.said().collect()}
    assert got == {n: single.attempt(name, now) for name, now, n in rows}
    assert 0 < sum(got.values()) < len(got)
    landing.run([("k1", 900_000, 1000), ("k2", 1000, 1001)], make)  # the second one is late, and dropped
    assert {r.n for r in landing.said().collect()} == {*range(601)} - {600} | {1000}


LINES = [
    ("s", ['data: {"delta":"hé","model":"m"}', "junk", 'data: {"delta":"中\U0001f600"}', "data: {bad", 'data: {"done":true,"text":""}', 'data: {"delta":"late"}']),
    ("e", ['data: {"delta":"x","model":"m"}', 'data: {"error":"boom"}', 'data: {"done":true}']),
    ("n", ['data: {"delta":"z"}', "data: [1]", "", ": comment", 'data: {"delta":5,"model":"two"}']),
    ("d", ['data: {"done":true,"text":"whöle"}']),
    ("none", ["nothing here"]),
]


@pytest.mark.parametrize("seed", range(2))
def test_any_split_gives_the_fold(spark, tmp_path, seed):
    rng = random.Random(seed)
    lines = spark.createDataFrame([(s, k, x) for s, xs in LINES for k, x in enumerate(xs)], "stream_id string, ord long, line string")
    wanted = {r.stream_id: (r.text, r.model, r.error, r.is_done) for r in sse.fold(lines.where("line like 'data:%'")).collect()} | {"none": ("", None, None, False)}
    batches = [[], [], []]
    for name, xs in LINES:
        data = "".join(x + rng.choice(["\n", "\r\n"]) for x in xs).encode() + b"data: {never ended"
        at, batch, k = 0, 0, 0
        while at < len(data):
            size = rng.randrange(1, 9)
            batches[batch].append((name, k, bytearray(data[at : at + size])))
            at, batch, k = at + size, min(2, batch + (rng.random() < 0.1)), k + 1
    landing = Landing(spark, tmp_path, "stream_id string, ord long, data binary")
    for rows in batches:
        if rows:
            rng.shuffle(rows)
            landing.run(rows, sse.fold_chunks)
    got = {r.stream_id: (r.text, r.model, r.error, r.is_done) for r in state.latest(landing.said(), "stream_id").collect()}
    assert got == wanted


def test_byte_chunks_join_again(spark):
    lines = spark.createDataFrame([("a", 1, "éb"), ("a", 0, "x"), ("b", 0, "")], "stream_id string, ord long, line string")
    got = {}
    for r in sse.byte_chunks(lines, 2).orderBy("ord").collect():
        got.setdefault(r.stream_id, []).append(bytes(r.data))
    assert {k: b"".join(v) for k, v in got.items()} == {"a": "x\néb\n".encode(), "b": b"\n"} and max(len(x) for v in got.values() for x in v) == 2


def test_frames_over_batches(spark, tmp_path):
    landing = Landing(spark, tmp_path, "stream_id string, ms long, ord long, text string")
    make = lambda s: sse.latest_frames(s.withColumn("at", F.timestamp_millis("ms")), "at", "100 milliseconds", late="50 milliseconds")
    landing.run([("a", 0, 1, "p"), ("a", 99, 2, "q"), ("b", 10, 1, "r"), ("a", 100, 3, "s")], make)
    landing.run([("a", 120, 4, "t"), ("a", 90, 0, "old"), ("a", 300, 5, "u")], make)
    landing.run([("a", 95, 9, "too late"), ("a", 290, 6, "v")], make)
    got = {(r.stream_id, r.frame.microsecond // 1000): r.text for r in state.latest(landing.said(), "stream_id", "frame").collect()}
    assert got == {("a", 0): "q", ("b", 0): "r", ("a", 100): "t", ("a", 300): "u", ("a", 200): "v"}
