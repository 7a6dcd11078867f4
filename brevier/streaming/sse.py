"""Server-sent event streams: parsing, folding into texts, and encoding."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from brevier.functions.text import column, strip
from brevier.streaming.state import use_rocksdb

EVENT = "delta string, done boolean, text string, model string, error string"


def events(lines: DataFrame, line: str = "line") -> DataFrame:
    """lines with event, for `data:` lines that hold a JSON object; other lines are dropped."""
    raw = strip(F.substring(strip(line), 6, 1 << 30))
    return (
        lines.where(strip(line).startswith("data:"))
        .withColumn("__raw", raw)
        .where(F.try_parse_json("__raw").isNotNull() & F.col("__raw").startswith("{"))
        .withColumn("event", F.from_json("__raw", EVENT))
        .drop("__raw")
    )


def fold(lines: DataFrame, stream: str = "stream_id", order: str = "ord", line: str = "line") -> DataFrame:
    """(stream, text, model, error, is_done): the text that each stream ends with.

    Deltas are joined in order up to the first `done`, whose own text wins, or the first `error`, which ends
    the stream without a text. A stream's text is one value, and its size bounds what a group gathers.
    """
    parsed = events(lines, line).select(stream, order, "event.*")
    stop = F.col("done") | (F.col("error") != "")
    until = parsed.where(stop).groupBy(stream).agg(F.min(order).alias("__stop"))
    kept = parsed.join(until, stream, "left").where(F.col("__stop").isNull() | (F.col(order) <= F.col("__stop")))
    joined = F.array_join(
        F.transform(F.sort_array(F.collect_list(F.struct(order, F.coalesce("delta", F.lit("")).alias("d")))), lambda x: x["d"]), ""
    )
    at_end = F.col(order) == F.col("__stop")
    return kept.groupBy(stream).agg(
        joined.alias("__joined"),
        F.max(F.when(at_end & F.col("done"), F.col("text"))).alias("__text"),
        F.max_by("model", F.when(F.col("model").isNotNull(), F.col(order))).alias("model"),
        F.max(F.when(at_end & (F.col("error") != ""), F.col("error"))).alias("error"),
        F.coalesce(F.max(at_end & F.coalesce("done", F.lit(False))), F.lit(False)).alias("is_done"),
    ).select(
        stream,
        F.when(F.col("error").isNull(), F.coalesce(F.when(F.col("__text") != "", F.col("__text")), F.col("__joined"))).alias("text"),
        "model", "error", "is_done",
    )


def running_text(deltas: DataFrame, stream: str = "stream_id", order: str = "ord", delta: str = "delta") -> DataFrame:
    """deltas with full_text: everything that the stream has said up to each delta.

    The result itself grows with the square of a stream's length, and one task makes a stream's: for replies, which are
    short. The whole text of long streams is fold()'s, which keeps one copy.
    """
    so_far = Window.partitionBy(stream).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return deltas.withColumn("full_text", F.array_join(F.collect_list(F.coalesce(column(delta), F.lit(""))).over(so_far), ""))


def encode_delta(delta: Column | str, model: Column | str) -> Column:
    return F.concat(F.lit("data: "), F.to_json(F.struct(column(delta).alias("delta"), column(model).alias("model"))), F.lit("\n\n"))


def encode_end(text: Column | str, model: Column | str) -> Column:
    end = F.struct(F.lit(True).alias("done"), column(text).alias("text"), column(model).alias("model"))
    return F.concat(F.lit("data: "), F.to_json(end), F.lit("\n\n"))


def chunks(text: Column | str) -> Column:
    """A text in pieces of max(2, ceil(length / 120)) characters."""
    value = column(text)
    size = F.greatest(F.lit(2), F.ceil(F.length(value) / 120).cast("int"))
    # One pass of a pattern: to seek each piece from the text's start would read the text sixty times.
    pieces = F.regexp_extract_all(value, F.concat(F.lit("(?s).{1,"), size.cast("string"), F.lit("}")), F.lit(0))
    return F.when(F.length(value) > 0, pieces).otherwise(F.array().cast("array<string>"))


def json_objects(text: str) -> Iterator[str]:
    """Whole objects of the outermost level, strings and escapes minded."""
    depth, start, quoted, escaped = 0, -1, False, False
    for k, ch in enumerate(text):
        if quoted:
            quoted, escaped = escaped or ch != '"', not escaped and ch == "\\"
        elif ch == '"':
            quoted = True
        elif ch == "{":
            start, depth = (k if depth == 0 else start), depth + 1
        elif ch == "}":
            depth -= 1
            if depth == 0 and start >= 0:
                yield text[start : k + 1]
                start = -1


def parsed_objects(text: str | None) -> list[str]:
    """JSON objects of a reply that is an event stream or an array, told by how it begins; an unended line is left out."""
    text = text or ""
    if text.lstrip().startswith("data:"):
        lines = [line.strip() for line in text.split("\n")[:-1]]
        found = [line[5:].strip() for line in lines if line.startswith("data:")]
    else:
        found = list(json_objects(text))
    out = []
    for raw in found:
        try:
            json.loads(raw)
            out.append(raw)
        except ValueError:
            continue
    return out


def reply_objects(text: Column | str) -> Column:
    """Array of the JSON objects of a whole reply, by an Arrow batch function."""

    @F.pandas_udf("array<string>")
    def parse(values: pd.Series) -> pd.Series:
        return values.map(parsed_objects)

    return parse(column(text))


def fold_stream(lines: DataFrame, stream: str = "stream_id", line: str = "line") -> DataFrame:
    """Streaming fold: the text so far of each stream that got lines, micro-batch by micro-batch.

    State is a stream's text and whether it has ended. Lines of one stream in one micro-batch are taken in
    order of `ord`.
    """

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState):
        text, ended = state.get if state.exists else ("", False)
        rows = pd.concat(list(batches)).sort_values("ord")
        for raw in rows[line]:
            raw = (raw or "").strip()
            if ended or not raw.startswith("data:"):
                continue
            try:
                event = json.loads(raw[5:])
            except ValueError:
                continue
            if not isinstance(event, dict):
                continue
            text += event.get("delta") or ""
            if event.get("done"):
                text, ended = event.get("text") or text, True
            ended = ended or bool(event.get("error"))
        state.update((text, ended))
        yield pd.DataFrame({stream: [key[0]], "text": [text], "ended": [ended]})

    return lines.groupBy(stream).applyInPandasWithState(
        step, f"{stream} string, text string, ended boolean", "text string, ended boolean", "update", GroupStateTimeout.NoTimeout
    )


FOLDED = "text string, model string, error string, is_done boolean"


def heard(state: tuple, line: str) -> tuple:
    """State (text, model, error, is_done) after one more whole line; `fold` in steps."""
    text, model, error, is_done = state
    line = line.strip()
    if is_done or error is not None or not line.startswith("data:"):
        return state
    try:
        event = json.loads(line[5:])
    except ValueError:
        return state
    if not isinstance(event, dict):
        return state
    told = {k: v if v is None or isinstance(v, str) else json.dumps(v) for k, v in event.items()}
    text += told.get("delta") or ""
    model = model if told.get("model") is None else told["model"]
    if event.get("done") is True:
        text, is_done = told.get("text") or text, True
    return text, model, told.get("error") or None, is_done


class ChunkFolder(StatefulProcessor):
    """A stream's text so far, and the bytes of its line that isn't ended yet."""

    def __init__(self, stream: str, order: str, data: str):
        self.stream, self.order, self.data = stream, order, data

    def init(self, handle) -> None:
        self.state = handle.getValueState("stream", f"rest binary, {FOLDED}")

    def handleInputRows(self, key, rows, timerValues):
        rest, *told = self.state.get() if self.state.exists() else (b"", "", None, None, False)
        chunks = pd.concat(list(rows)).sort_values(self.order, kind="stable")[self.data]
        *lines, rest = b"".join([rest or b"", *(bytes(c) for c in chunks if c is not None)]).split(b"\n")
        for line in lines:
            told = heard(tuple(told), line.decode("utf-8", "replace"))
        self.state.update((rest, *told))
        text, model, error, is_done = told
        text = text if error is None else None
        yield pd.DataFrame({self.stream: [key[0]], "text": [text], "model": [model], "error": [error], "is_done": [is_done]})

    def close(self) -> None:
        pass


def fold_chunks(chunks: DataFrame, stream: str = "stream_id", order: str = "ord", data: str = "data") -> DataFrame:
    """(stream, text, model, error, is_done) of a stream of byte chunks, for each stream that got some: what `fold` says so far.

    Chunks are cut anywhere, inside lines and inside characters: bytes wait in the state until their line is ended. A line
    that never ends says nothing. Chunks of one batch are taken in order, batches as they come. A stream's state is its text
    and one line; both end as rows of the result, and are bounded by what a reply may be. Update mode.
    """
    use_rocksdb(chunks.sparkSession)
    kind = chunks.schema[stream].dataType.simpleString()
    return chunks.groupBy(stream).transformWithStateInPandas(ChunkFolder(stream, order, data), f"{stream} {kind}, {FOLDED}", "Update", "None")


def byte_chunks(lines: DataFrame, size: int, stream: str = "stream_id", order: str = "ord", line: str = "line") -> DataFrame:
    """(stream, ord, data) of each stream's lines, ended and joined, in chunks of so many bytes."""
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, line))), lambda x: x[line]), "\n")
    data = lines.groupBy(stream).agg(F.encode(F.concat(whole, F.lit("\n")), "UTF-8").alias("__all"))
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.octet_length("__all")), F.lit(size))
    return data.select(stream, F.posexplode(F.transform(starts, lambda i: F.substr("__all", i, F.lit(size)))).alias("ord", "data"))


def latest_frames(rows: DataFrame, at: str, width: str, keys: tuple[str, ...] = ("stream_id",), order: str = "ord", text: str = "text", late: str = "1 second") -> DataFrame:
    """(keys, frame, order, text) of a stream of texts: within each frame of time the latest, so that a display is drawn once a frame.

    Frames are windows of event time. One is told anew while texts for it come (update mode), and its state goes once it is
    `late` behind the latest event; texts for it that come after that are dropped.
    """
    frames = rows.withWatermark(at, late).groupBy(*keys, F.window(at, width).alias("__frame"))
    last = frames.agg(F.max(order).alias(order), F.max_by(text, order).alias(text))
    return last.select(*keys, F.col("__frame.start").alias("frame"), order, text)


def latest_frame(rows: DataFrame, tick: str, order: str = "ord", text: str = "text") -> DataFrame:
    """(tick, text): of all texts within a tick the latest, so that a display is drawn once a tick."""
    return rows.groupBy(tick).agg(F.max_by(text, order).alias(text))
