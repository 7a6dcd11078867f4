"""An index of the inventory's keys, so that a day's items meet only the part of the inventory that they may be in.

Keys lie in buckets by their hash, a folder each. A Bloom filter for each bucket, as rows of 64 bits, says for every new key
whether its bucket may hold it; the buckets that no new key may be in are not read. What the filters let pass is looked up
in the buckets, so that the answer is exact. New keys are appended: first their bits, then the keys, so that a job that
dies in between leaves bits that make a lookup more, and no key that isn't found.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brevier.functions.session import cut
from brevier.sources.corpus import Conflict, create_once, numbers, read_small

BITS_OF_KEY, HASHES = 10, 7
KEYS = ("url_key", "title_key")


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def bit_places(key: Column, bits: int) -> Column:
    """Places of a key's bits in its bucket's filter, by double hashing."""
    one, two = (F.shiftrightunsigned(F.xxhash64(F.lit(name), key), 16) for name in ("one", "two"))
    return F.array(*[F.pmod(one + k * two, F.lit(bits)) for k in range(HASHES)])


def listed(rows: DataFrame, keys: tuple[str, ...], buckets: int) -> DataFrame:
    """(kind, key, bucket) of all distinct keys that aren't empty or null."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("key")) for k in keys])).alias("k")
    found = rows.select(each).select("k.kind", "k.key").where("key != ''").distinct()
    return found.withColumn("bucket", bucket_of(F.col("key"), buckets))


def shape_of(spark: SparkSession, path: str) -> dict:
    """Of the index in force: number of the generation, folder, buckets, bits of a filter, names of the keys."""
    found = numbers(spark, path)
    if not found:
        raise OSError(f"there is no index in {path}")
    return json.loads(read_small(spark, f"{path}/{found[-1]:012d}"))


def build_index(rows: DataFrame, path: str, keys: tuple[str, ...] = KEYS, buckets: int = 256, room: float = 2.0) -> None:
    """Index the keys of rows anew, as a generation of its own; the last one is in force until this one is whole.

    Filters have bits for `room` times the keys that there are: at that number one new key in a hundred is looked up in
    vain, beyond it more. A number of buckets for which each has some hundred thousand keys suits.
    """
    spark = rows.sparkSession
    found = cut(listed(rows, keys, buckets))
    most = found.groupBy("kind", "bucket").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    number = (numbers(spark, path) or [-1])[-1] + 1
    shape = {"folder": f"generation-{number}", "buckets": buckets, "bits": 64 * max(1, -int(-most * room * BITS_OF_KEY // 64)), "keys": list(keys)}
    append(found, f"{path}/{shape['folder']}", shape, "overwrite")
    if not create_once(spark, f"{path}/{number:012d}", json.dumps(shape)):
        raise Conflict(f"{path} has a generation {number} already")


def add_keys(rows: DataFrame, path: str) -> None:
    """Append the keys of rows to the index in force. Keys that it has already do no harm."""
    shape = shape_of(rows.sparkSession, path)
    append(cut(listed(rows, tuple(shape["keys"]), shape["buckets"])), f"{path}/{shape['folder']}", shape, "append")


def append(found: DataFrame, folder: str, shape: dict, mode: str) -> None:
    place = F.explode(bit_places(F.col("key"), shape["bits"])).alias("place")
    words = found.select("kind", "bucket", place).select("kind", "bucket", F.floor(F.col("place") / 64).alias("word"), F.expr("shiftleft(1L, CAST(place % 64 AS INT))").alias("bit"))
    words.groupBy("kind", "bucket", "word").agg(F.bit_or("bit").alias("bits")).write.mode(mode).parquet(f"{folder}/filters")
    dealt = found.repartition("kind", "bucket")
    dealt.write.mode(mode).partitionBy("kind", "bucket").parquet(f"{folder}/keys")


def likely_keys(new: DataFrame, path: str, shape: dict) -> DataFrame:
    """(kind, key, bucket) of the keys of new that their bucket's filter doesn't rule out."""
    spark = new.sparkSession
    asked = listed(new, tuple(shape["keys"]), shape["buckets"])
    places = asked.select("kind", "key", "bucket", F.explode(F.array_distinct(bit_places(F.col("key"), shape["bits"]))).alias("place"))
    places = places.select("kind", "key", "bucket", F.floor(F.col("place") / 64).alias("word"), F.expr("shiftleft(1L, CAST(place % 64 AS INT))").alias("bit"))
    filters = spark.read.parquet(f"{path}/{shape['folder']}/filters").groupBy("kind", "bucket", "word").agg(F.bit_or("bits").alias("bits"))
    lost = F.coalesce(F.col("bits").bitwiseAND(F.col("bit")), F.lit(0)) == 0
    met = places.join(filters, ["kind", "bucket", "word"], "left").groupBy("kind", "key", "bucket").agg(F.max(lost).alias("lost"))
    return met.where("NOT lost").drop("lost")


def stored_keys(spark: SparkSession, path: str, shape: dict, wanted: list[tuple[str, int]]) -> DataFrame:
    """(kind, key) of these buckets alone: the scan is pruned to their folders."""
    chosen = F.lit(False)
    for kind in shape["keys"]:
        chosen = chosen | ((F.col("kind") == kind) & F.col("bucket").isin([b for k, b in wanted if k == kind]))
    schema = "key string, kind string, bucket int"
    return spark.read.schema(schema).parquet(f"{path}/{shape['folder']}/keys").where(chosen).select("kind", "key")


def not_in_index(new: DataFrame, path: str) -> DataFrame:
    """Rows of new that share no key with the index: `not_in_inventory`, at the cost of the buckets that new may be in.

    At most as many buckets as the index has are listed on the driver.
    """
    spark = new.sparkSession
    shape = shape_of(spark, path)
    likely = cut(likely_keys(new, path, shape))
    wanted = [(r["kind"], r["bucket"]) for r in likely.select("kind", "bucket").distinct().collect()]
    if not wanted:
        return new
    known = cut(likely.join(stored_keys(spark, path, shape, wanted), ["kind", "key"], "left_semi").select("kind", "key"))
    out = new
    for kind in shape["keys"]:
        own = known.where(F.col("kind") == kind).select(F.col("key").alias("__known"))
        out = out.join(own, out[kind] == F.col("__known"), "left_anti")
    return out
