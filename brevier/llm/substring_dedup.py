"""Exact removal of repeated word windows by level-wise doubling.

A window of 2L words can only repeat where the windows of L words inside it repeat. Each level hashes shorter
windows, thinned by winnowing: every full window is stood for by the smallest hash of the short windows inside
it, so that equal full windows are stood for by equal ones and nothing that repeats is lost. Short windows that
occur once settle the full windows that they stand for; only windows repeated at one length alone are extended
to twice that length, until the wanted length is reached or no candidates survive.

Documents are dealt once, by row, into groups of some megabytes. Each group sends one packed list of its distinct
hashes to each of a number of hash ranges, and gets one bit for each of them back, so that a passage that
many documents share costs one entry a group however hot it is, and neither positions nor texts are
shuffled again. All levels read the one exchange of the texts. The windows still open come back to each group as
bits, so that no level is settled twice. Rows are told apart by their place in docs, which
must be a table or another plan that gives the same rows in the same order when a lost task runs again.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from brevier.llm.common import kept_names

#: Odd multipliers of the two window hashes.
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
NO_ID = np.iinfo(np.int64).max
#: Bytes of text for each hash that a level sends at most, but for corpora made of copies.
BYTES_PER_KEY = 20


class Powers:
    """Powers of a multiplier and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int):
        if n > len(self.up):
            size = max(n, 2 * len(self.up))
            full = lambda x: np.cumprod(np.array([1] + [x] * (size - 1), np.uint64))
            self.up, self.down = full(self.base), full(self.inverse)
        return self.up[:n], self.down[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(words: np.ndarray, length: int, powers: Powers) -> np.ndarray:
    """One hash for each window of so many word hashes."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = powers.get(len(words))
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up, out=sums[1:])
    return mixed((sums[length:] - sums[:-length]) * down[:n])


def sliding(x: np.ndarray, width: int, choose=np.minimum) -> np.ndarray:
    """The least (or greatest) of each run of so many values."""
    size = 1
    while 2 * size <= width:
        x, size = choose(x[:-size], x[size:]), 2 * size
    rest = width - size
    return choose(x[:-rest], x[rest:]) if rest else x


class Group:
    """One group of documents in order of id: its words, its windows, and the windows that may still repeat."""

    def __init__(self, ids: pa.Array, rows: pa.Array, texts: pa.Array, window: int):
        ids = np.where(np.asarray(ids.is_null()), NO_ID, np.asarray(ids.fill_null(0)))
        self.window = window
        self.order = np.lexsort((np.asarray(rows), ids))
        self.ids = ids[self.order]
        digest = xxhash.xxh64_intdigest
        self.one, self.two = (Powers(m) for m in MULTIPLIERS)
        self.words = [(texts[row].as_py() or "").encode("utf-8", "surrogatepass").split() for row in self.order]
        self.sizes = np.array([max(0, len(w) - window + 1) for w in self.words], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)
        self.hashed = [np.fromiter(map(digest, w), np.uint64, len(w)) if n else None for w, n in zip(self.words, self.sizes, strict=True)]
        self.places = np.arange(self.starts[-1])

    def anchors(self, length: int):
        """Sorted distinct hashes of the short windows that stand for the open windows, and whether each occurs twice here.

        A window stands for by the smallest hash of the windows of `length` words within it.
        """
        spread = self.window - length + 1
        open_ = np.zeros(self.starts[-1], bool)
        open_[self.places] = True
        floors, found, none = [], [], np.zeros(spread - 1, np.uint64)
        for hashed, start, size in zip(self.hashed, self.starts, self.sizes, strict=False):
            own = open_[start : start + size]
            if not own.any():
                continue
            short = window_hashes(hashed, length, self.one)
            least = sliding(short, spread)
            floors.append(least[own])
            cover = sliding(np.concatenate([none, np.where(own, least, np.uint64(0)), none]), spread, np.maximum)
            found.append(short[short == cover])
        self.floor = np.concatenate(floors) if floors else np.zeros(0, np.uint64)
        keys, counts = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
        return keys, counts > 1

    def sift(self, length: int, repeated: np.ndarray) -> None:
        """Keep the open windows whose short window repeats somewhere; repeated is in the order of anchors(length)."""
        keys, _ = self.anchors(length)
        if len(keys):
            self.places = self.places[repeated[np.searchsorted(keys, self.floor)]]

    def distinct(self):
        """Keys and checks of the distinct open windows in order, their first places, and each open window's number among them."""
        if not len(self.places):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        cuts = np.searchsorted(self.places, self.starts)
        key, check = np.empty(len(self.places), np.uint64), np.empty(len(self.places), np.uint32)
        for k, hashed in enumerate(self.hashed):
            own = slice(cuts[k], cuts[k + 1])
            if own.start < own.stop:
                at = self.places[own] - self.starts[k]
                key[own] = window_hashes(hashed, self.window, self.one)[at]
                check[own] = window_hashes(hashed, self.window, self.two)[at] >> np.uint64(32)
        order = np.lexsort((check, key))
        k, c = key[order], check[order]
        new = np.concatenate([[True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])])
        number = np.empty(len(k), np.int64)
        number[order] = np.cumsum(new) - 1
        first = np.full(int(new.sum()), self.starts[-1], np.int64)
        np.minimum.at(first, number, self.places)
        return k[new], c[new], first, number


def level_lengths(window: int, shortest: int) -> list[int]:
    """Window lengths of the levels: doubled up to the window, from at least `shortest`."""
    lengths = [window]
    while lengths[0] % 2 == 0 and lengths[0] // 2 >= shortest:
        lengths.insert(0, lengths[0] // 2)
    return lengths


def ranges(keys: np.ndarray, n: int):
    """(range, slice) of each of n equal ranges of the 64-bit keys, which are sorted, that has any."""
    bounds = np.array([(i << 64) // n for i in range(1, n)], np.uint64)
    cuts = [0, *np.searchsorted(keys, bounds), len(keys)]
    for i in range(n):
        if cuts[i] < cuts[i + 1]:
            yield i, slice(cuts[i], cuts[i + 1])


def packed_flags(table: pa.Table, level: int) -> np.ndarray:
    """The flags that came back to a group at a level, in the order of its sorted keys."""
    rows = [r for r in table.to_pylist() if r["level"] == level and r["part"] >= 0]
    rows.sort(key=lambda r: r["part"])
    return (
        np.concatenate([np.unpackbits(np.frombuffer(r["flags"], np.uint8), count=r["n"]) for r in rows]).astype(bool)
        if rows
        else np.zeros(0, bool)
    )


def state_row(grp: int, group: Group) -> tuple:
    """The group's open windows as bits: a row that comes back as it is, so that no later stage settles them again."""
    open_ = np.zeros(group.starts[-1], bool)
    open_[group.places] = True
    return grp, -grp - 1, len(open_), np.packbits(open_).tobytes(), b"", b""


def judged(key, table: pa.Table, level: int, judge) -> pa.Table:
    """What a judge says of a range, or a group's own state."""
    rows = table.to_pylist()
    if key[0].as_py() < 0:
        return back_table([(r["grp"], level, -1, r["n"], r["keys"]) for r in rows])
    return judge(rows)


SENT = "grp int, part int, n int, keys binary, extra binary, ids binary"
BACK = "grp int, level int, part int, n int, flags binary"


def sent_table(rows: list) -> pa.Table:
    names = ["grp", "part", "n", "keys", "extra", "ids"]
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    return pa.table({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(zip(names, kinds, strict=True))})


def back_table(rows: list) -> pa.Table:
    names = ["grp", "level", "part", "n", "flags"]
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    return pa.table({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(zip(names, kinds, strict=True))})


def alone(send):
    """A function of a group and what came back to it, for the level to which nothing has come back yet."""
    return lambda key, texts: send(key, texts, None)


def repeated_windows(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    window: int,
    bytes_per_group: int,
    keys_per_range: int,
    keep: tuple[str, ...],
    lengths: list[int],
):
    """The dealt documents and, for each group and level, a flag for each of its distinct hashes."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(F.coalesce(F.col(text_col), F.lit(""))) + 50)).first()[0] or 0
    groups = max(1, math.ceil(size / bytes_per_group))
    parts = max(1, math.ceil(size / BYTES_PER_KEY / keys_per_range))
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    width = max(1, min(groups, max(shuffle, groups // 8)))
    others = [F.col(c).alias(f"__keep_{c}") for c in keep]
    dealt = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(text_col).alias("__text"),
        *others,
        F.monotonically_increasing_id().alias("row"),
    )
    dealt = dealt.withColumn("grp", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int")).repartition(width, "grp")

    def sifted(texts, back, level: int) -> Group:
        """A group with what the levels below have settled, from its last state on."""
        group = Group(*(texts[c].combine_chunks() for c in ("id", "row", "__text")), window)
        states = {r["level"]: r for r in back.to_pylist() if r["part"] < 0} if level else {}
        begin = max(states, default=0)
        if states:
            group.places = np.flatnonzero(np.unpackbits(np.frombuffer(states[begin]["flags"], np.uint8), count=states[begin]["n"]))
        for k in range(begin, level):
            group.sift(lengths[k], packed_flags(back, k))
        return group

    def short_windows(level: int):
        def send(key, texts, back=None):
            if not texts.num_rows:
                return sent_table([])
            group = sifted(texts, back, level)
            keys, many = group.anchors(lengths[level])
            return sent_table(
                [
                    (key[0].as_py(), i, s.stop - s.start, keys[s].tobytes(), np.packbits(many[s]).tobytes(), b"")
                    for i, s in ranges(keys, parts)
                ]
                + [state_row(key[0].as_py(), group)] * (level > 0)
            )

        return send

    def judge_short(level: int):
        def judge(rows):
            keys = [np.frombuffer(r["keys"], np.uint64) for r in rows]
            many = [np.unpackbits(np.frombuffer(r["extra"], np.uint8), count=r["n"]).astype(bool) for r in rows]
            distinct, number, counts = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
            again = counts > 1
            again[number[np.concatenate(many)]] = True
            flags = np.split(again[number], np.cumsum([len(k) for k in keys])[:-1])
            return back_table(
                [
                    (r["grp"], level, r["part"], r["n"], np.packbits(f).tobytes())
                    for r, f in zip(rows, flags, strict=True)
                ]
            )

        return lambda key, table: judged(key, table, level, judge)

    last = len(lengths) - 1

    def wholes(key, texts, back=None):
        if not texts.num_rows:
            return sent_table([])
        group = sifted(texts, back, last)
        keys, check, first, _ = group.distinct()
        owner = group.ids[np.searchsorted(group.starts, first, side="right") - 1]
        return sent_table(
            [
                (key[0].as_py(), i, s.stop - s.start, keys[s].tobytes(), check[s].tobytes(), owner[s].tobytes())
                for i, s in ranges(keys, parts)
            ]
            + [state_row(key[0].as_py(), group)] * (last > 0)
        )

    def judge_wholes(rows):
        keys, check, ids = (
            np.concatenate([np.frombuffer(r[name], kind) for r in rows])
            for name, kind in (("keys", np.uint64), ("extra", np.uint32), ("ids", np.int64))
        )
        groups_of = np.repeat([r["grp"] for r in rows], [r["n"] for r in rows])
        order = np.lexsort((groups_of, ids, check, keys))
        k, c = keys[order], check[order]
        later = np.empty(len(keys), bool)
        later[order] = np.concatenate([[False], (k[1:] == k[:-1]) & (c[1:] == c[:-1])])
        flags = np.split(later, np.cumsum([r["n"] for r in rows])[:-1])
        return back_table(
            [
                (r["grp"], last, r["part"], r["n"], np.packbits(f).tobytes())
                for r, f in zip(rows, flags, strict=True)
            ]
        )

    back = None
    for level in range(last + 1):
        send, judge = (short_windows(level), judge_short(level)) if level < last else (wholes, lambda key, table: judged(key, table, last, judge_wholes))
        by_group = dealt.groupBy("grp")
        if back is None:
            sent = by_group.applyInArrow(alone(send), SENT)
        else:
            sent = by_group.cogroup(back.groupBy("grp")).applyInArrow(send, SENT)
        told = sent.groupBy("part").applyInArrow(judge, BACK).repartition(width, "grp")
        back = told if back is None else back.union(told).repartition(width, "grp")
    return dealt, back, width, sifted


def substring_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 20,
    shortest: int = 5,
    bytes_per_group: int = 2_000_000,
    keys_per_range: int = 500_000,
    keep: tuple[str, ...] = (),
    verbatim: bool = False,
) -> DataFrame:
    """(id, n_words, n_removed, kept_text, *keep) for each row of docs.

    A word goes if a window of `window` words (even) covers it whose word sequence also starts earlier: in a
    document with a smaller id, or earlier in the same one. Windows are judged on the input. kept_text has
    the kept words joined by one space. A null text has no words; documents shorter than a window keep all;
    rows that share an id are taken one after the other, by group and place; null ids come last, as one such id.
    Sequences are equal if 96 bits of two independent hashes are. Levels double from the least half, quarter, ... of the
    window that has `shortest` words up to the window: longer repeats cover no further words. With verbatim, a text that
    loses nothing comes back as it was, null included. A kept column that has the name of another result is kept_<name>.
    """
    if window < 2 or window % 2:
        raise ValueError("window must be even")
    lengths = level_lengths(window, shortest)
    dealt, back, width, sifted = repeated_windows(docs, id_col, text_col, window, bytes_per_group, keys_per_range, keep, lengths)
    names = kept_names(keep, ("id", "n_words", "n_removed", "kept_text"))
    kept_columns = dealt.select(*[F.col(f"__keep_{c}").alias(n) for c, n in zip(keep, names, strict=True)])
    held, arrow = kept_columns.schema.fields, to_arrow_schema(kept_columns.schema)

    def keep_words(key, texts, flags):
        if not texts.num_rows:
            return pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()), *[arrow.field(c) for c in names]]).empty_table()
        group = sifted(texts, flags, len(lengths) - 1)
        _, _, first, number = group.distinct()
        gone = packed_flags(flags, len(lengths) - 1)
        marks = np.zeros(group.starts[-1], bool)
        if len(group.places):
            marks[group.places[(group.places != first[number]) | gone[number]]] = True
        n_words, n_removed, kept, at = [], [], [], 0
        for row, words, size in zip(group.order, group.words, group.sizes, strict=True):
            own = marks[at : at + size]
            at += size
            n_words.append(len(words))
            if not own.any():
                n_removed.append(0)
                kept.append(texts["__text"][row].as_py() if verbatim else b" ".join(words).decode("utf-8", "replace"))
                continue
            step = np.zeros(len(words) + 1, np.int64)
            starts = np.flatnonzero(own)
            np.add.at(step, starts, 1)
            np.add.at(step, starts + window, -1)
            stay = np.cumsum(step[:-1]) == 0
            n_removed.append(int(len(words) - stay.sum()))
            kept.append(b" ".join([words[i] for i in np.flatnonzero(stay)]).decode("utf-8", "replace"))
        return pa.table(
            {
                "id": texts["id"].combine_chunks().take(pa.array(group.order)),
                "n_words": pa.array(n_words, pa.int64()),
                "n_removed": pa.array(n_removed, pa.int64()),
                "kept_text": pa.array(kept, pa.string()),
                **{n: texts[f"__keep_{c}"].combine_chunks().take(pa.array(group.order)) for c, n in zip(keep, names, strict=True)},
            }
        )

    return (
        dealt.groupBy("grp")
        .cogroup(back.groupBy("grp"))
        .applyInArrow(keep_words, ", ".join(["id long, n_words long, n_removed long, kept_text string", *[f"`{f.name}` {f.dataType.simpleString()}" for f in held]]))
    )
