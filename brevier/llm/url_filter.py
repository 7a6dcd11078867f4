"""URL filters by a Bloom filter cascade.

A rule is a host and a path prefix; it fits its host and all subdomains. The key universe of a corpus holds,
for each URL, every suffix of its host with every prefix of its path that is as long as some rule's. Level 1
of the cascade is a Bloom filter of the listed keys, level 2 one of the keys of the universe that are not
listed but pass level 1, level 3 one of the listed keys that pass level 2, and so on until nothing passes
wrongly. Over the universe the cascade then answers exactly, without a join: a key is listed if the first
level that it fails has an even number. The first level's error rate is chosen from the size of the universe
so that as many false positives are left as there are rules; the cascade's size follows the number of rules
and the logarithm of the universe. One cascade holds the rules that allow and another those that block.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brevier.llm.common import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^(?:(?!://).)*://([^/?#]*)", 1), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^(?:(?!://).)*://[^/?#]*([^?#]*)", 1)


def candidate_keys(host: Column, path: Column, path_lengths: list[int]) -> Column:
    """Every host suffix with every path prefix of one of the given lengths, as one array of keys."""
    labels = F.split(host, r"\.", -1)
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    prefixes = F.filter(
        F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in path_lengths]), lambda p: p.isNotNull()
    )
    return F.when(host == "", F.array().cast("array<string>")).otherwise(
        F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    )


class Bloom:
    """A Bloom filter as 32-bit words; positions come from one 64-bit hash with a seed by double hashing."""

    def __init__(self, seed: int, n_keys: int, error: float):
        self.seed = seed
        self.size = max(64, math.ceil(-n_keys * math.log(error) / math.log(2) ** 2))
        self.hashes = max(1, round(self.size / max(1, n_keys) * math.log(2)))
        self.words = [0] * math.ceil(self.size / 32)

    def positions(self, key: Column) -> list[Column]:
        one, two = F.xxhash64(F.lit(2 * self.seed), key), F.xxhash64(F.lit(2 * self.seed + 1), key)
        step = F.shiftleft(F.shiftrightunsigned(two, 34), 1) + 1
        return [
            F.pmod(F.shiftrightunsigned(one, 2) + F.lit(k).cast("long") * step, F.lit(self.size).cast("long")).cast("int")
            for k in range(self.hashes)
        ]

    def fill(self, keys: DataFrame) -> Bloom:
        """Set the bits of all keys; words are combined on the executors."""
        bits = keys.select(F.explode(F.array(*self.positions(F.col("key")))).alias("bit"))
        for row in (
            bits.groupBy(F.shiftright("bit", 5).alias("word"))
            .agg(F.expr("bit_or(shiftleft(1L, bit & 31))").alias("bits"))
            .collect()
        ):
            self.words[row["word"]] = row["bits"]
        return self

    def might_contain(self, key: Column, words: Column) -> Column:
        """True where all bits of key are set; words is this filter's array of longs."""
        return F.array_min(
            F.transform(
                F.array(*self.positions(key)),
                lambda p: F.getbit(F.get(words, F.shiftright(p, 5)), p.bitwiseAND(31)),
            )
        ) == 1


def level_words(bloom: Bloom) -> Column:
    return F.array(*[F.lit(w).cast("long") for w in bloom.words]) if len(bloom.words) <= 4096 else F.from_json(
        F.lit(str(bloom.words)), "array<bigint>"
    )


def in_cascade(levels: list[Bloom], key: Column) -> Column:
    """Membership: the first level that the key fails tells; a key that passes all is listed if their number is odd."""
    answer = F.lit(len(levels) % 2 == 1)
    for k in range(len(levels) - 1, -1, -1):
        answer = F.when(~levels[k].might_contain(key, level_words(levels[k])), F.lit(k % 2 == 1)).otherwise(answer)
    return answer


def keys_frame(spark: SparkSession, keys: list[str]) -> DataFrame:
    return spark.range(0, 1, 1, 1).select(F.explode(F.from_json(F.lit(json.dumps(keys)), "array<string>")).alias("key"))


def build_cascade(listed: list[str], universe: DataFrame, n_universe: int, seed: int = 0) -> list[Bloom]:
    """Levels that separate the listed keys from the rest of universe(key), which may repeat keys.

    Only keys that wrongly pass a level are kept for the next; the first level leaves about as many as are
    listed, however large the universe is. They stay on the executors: the driver sees bits alone. Each further level
    halves one side, and as keys of the two sides differ, one side ends up empty.
    """
    if not listed:
        return []
    members = keys_frame(universe.sparkSession, sorted(set(listed)))
    n = len(set(listed))
    error = min(0.5, n / (math.sqrt(2) * max(1, n_universe)))
    levels = [Bloom(seed, n, max(error, 1e-12)).fill(members)]
    wrong = cut(universe.where(in_cascade(levels, F.col("key"))).distinct().join(members, "key", "left_anti"))
    sides = [(members, n), (wrong, wrong.count())]  # at even levels the first side is encoded, at odd ones the second
    while sides[len(levels) % 2][1]:
        encode, size = sides[len(levels) % 2]
        against, _ = sides[(len(levels) + 1) % 2]
        level = Bloom(seed + len(levels), size, 0.5).fill(encode)
        left = cut(against.where(level.might_contain(F.col("key"), level_words(level))))
        sides[(len(levels) + 1) % 2] = (left, left.count())
        levels.append(level)
    return levels


def filter_urls(
    pages: DataFrame,
    rules: list[tuple[str, str]],
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
) -> DataFrame:
    """(id, host, path, rule, verdict) for each row of pages.

    rules: (allow or block, host/path). The longest rule that fits decides, of an allow and a block rule of one length
    the allow rule; a URL that none fits gets the default and a null rule. A null URL, or one without ://, has an empty host and path and fits no rule.
    """
    parted = pages.select(
        F.col(id_col).alias("id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path")
    )
    by_verdict = {v: sorted({key for verdict, key in rules if verdict == v}) for v in ("allow", "block")}
    if set(by_verdict["allow"]) & set(by_verdict["block"]) or any("/" not in key for _, key in rules):
        raise ValueError("a rule is a host and a path that starts with /, and has one verdict")
    lengths = sorted({len(key) - key.index("/") for _, key in rules})
    keyed = parted.withColumn("__keys", candidate_keys(F.col("host"), F.col("path"), lengths) if lengths else F.array().cast("array<string>"))
    universe = keyed.select(F.explode("__keys").alias("key"))
    n_universe = universe.agg(F.approx_count_distinct("key")).first()[0] if lengths else 0
    cascades = {
        v: build_cascade(keys, universe, n_universe, 1000 * k) for k, (v, keys) in enumerate(by_verdict.items())
    }

    def longest(verdict: str) -> Column:
        if not cascades[verdict]:
            return F.lit(None).cast("string")
        hits = F.filter("__keys", lambda key: in_cascade(cascades[verdict], key))
        return F.get(F.transform(F.reverse(F.array_sort(F.transform(hits, lambda h: F.struct(F.length(h).alias("n"), h.alias("key"))))), lambda s: s["key"]), 0)

    found = keyed.withColumn("__allow", longest("allow")).withColumn("__block", longest("block"))
    blocked = F.coalesce(F.length("__block"), F.lit(0)) > F.coalesce(F.length("__allow"), F.lit(0))
    return found.select(
        "id",
        "host",
        "path",
        F.when(blocked, F.col("__block")).otherwise(F.col("__allow")).alias("rule"),
        F.when(blocked, F.lit("block")).when(F.col("__allow").isNotNull(), F.lit("allow")).otherwise(F.lit(default)).alias("verdict"),
    )
