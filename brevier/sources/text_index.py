"""Search by an inverted index of trigrams: postings by three characters, intersected, then verified on the texts.

The index is a folder: `postings` (gram, ids), lists of a block of rows each, sorted over ranges, so that a gram's lists lie
together in as many files as they fill and a scan for some grams skips the rest by their least and greatest values; `grams`
(gram, n) tells how many rows have a gram. Texts of fewer than three characters are grams themselves.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brevier.functions.session import cut, spread

#: Of a query's grams the rarest so many are intersected; the texts themselves decide.
MOST_GRAMS = 6


def searched(fields: list[str]) -> Column:
    """What a search looks at: the fields, joined by spaces, in lower case."""
    return F.lower(F.concat_ws(" ", *[F.col(f).cast("string") for f in fields]))


def grams_of(text: str) -> set[str]:
    """A text's distinct runs of three characters, or the text itself if it has fewer than three."""
    return {text[k : k + 3] for k in range(len(text) - 2)} if len(text) >= 3 else {text}


#: Rows whose postings a worker gathers at a time: a gram has one list of ids for each such block.
ROWS_AT_ONCE = 2000


def posting_lists(texts: DataFrame) -> DataFrame:
    """(gram, ids) of (id, text): the ids of a block's rows that have the gram."""
    schema = T.StructType([T.StructField("gram", T.StringType()), T.StructField("ids", T.ArrayType(texts.schema["id"].dataType))])

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS_AT_ONCE):
                block, held = batch.slice(low, ROWS_AT_ONCE), defaultdict(list)
                for k, text in enumerate(block.column(1)):
                    for gram in grams_of(text.as_py()):
                        held[gram].append(k)
                starts = pa.array([0, *accumulate(map(len, held.values()))], pa.int32())
                places = pa.array(chain.from_iterable(held.values()), pa.int32())
                lists = pa.ListArray.from_arrays(starts, block.column(0).take(places))
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.string()), lists], ["gram", "ids"])

    return texts.mapInArrow(run, schema)


def build_text_index(rows: DataFrame, path: str, id_col: str, fields: list[str], per_file: int = 5_000_000) -> None:
    """Write the index of rows. Ids should be unique; a null id is an id, but `search_index` needs rows that have theirs."""
    found = cut(posting_lists(spread(rows).select(F.col(id_col).alias("id"), searched(fields).alias("text"))))
    counts = cut(found.groupBy("gram").agg(F.sum(F.size("ids")).alias("n")))
    files = max(1, -(-(counts.agg(F.sum("n")).first()[0] or 0) // per_file))
    order = "gram", F.get("ids", F.lit(0))
    found.repartitionByRange(files, *order).sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{path}/postings")
    counts.repartitionByRange("gram").sortWithinPartitions("gram").write.mode("overwrite").parquet(f"{path}/grams")


def candidates(spark: SparkSession, path: str, query: str) -> DataFrame:
    """(id) of the rows that may hold the lower-cased query: for fewer than three characters, those that do."""
    postings, grams = spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/grams")
    if len(query) < 3:
        held = grams.where(F.contains("gram", F.lit(query))).select("gram")
        return postings.join(held, "gram", "left_semi").select(F.explode("ids").alias("id")).distinct()
    own = sorted({query[k : k + 3] for k in range(len(query) - 2)})
    known = {r["gram"]: r["n"] for r in grams.where(F.col("gram").isin(own)).collect()}  # no more than the query has
    if len(known) < len(own):
        return postings.where(F.lit(False)).select(F.explode("ids").alias("id"))
    rarest = sorted(own, key=lambda g: (known[g], g))[:MOST_GRAMS]
    bit = F.element_at(F.create_map(*[F.lit(x) for k, g in enumerate(rarest) for x in (g, 1 << k)]), F.col("gram"))
    found = postings.where(F.col("gram").isin(rarest)).select(bit.alias("bit"), F.explode("ids").alias("id"))
    return found.groupBy("id").agg(F.bit_or("bit").alias("bits")).where(F.col("bits") == (1 << len(rarest)) - 1).select("id")


def search_index(rows: DataFrame, path: str, query: str, id_col: str, fields: list[str]) -> DataFrame:
    """Rows whose fields hold the query: those of `dashboard.search`, of whose texts only the candidates' are looked at."""
    if not query:
        return rows
    wanted = query.lower()
    found = candidates(rows.sparkSession, path, wanted)
    kept = rows.join(found.withColumnRenamed("id", "__id"), F.col(id_col).eqNullSafe(F.col("__id")), "left_semi")
    return kept.where(F.contains(searched(fields), F.lit(wanted)))
