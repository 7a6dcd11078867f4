"""What the stateful streams share: the state store they need, and runs of a stream to the end of what has landed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brevier.functions.session import new_folder

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Keep the state of this session's streams in RocksDB, which state variables and timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def run_to_end(stream: DataFrame, checkpoint: str, out: str, mode: str = "update") -> None:
    """Run a stream over all that has landed, and append what it says to the table out, under the number of each batch.

    A batch that runs again after a crash replaces its own rows.
    """

    def one(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query.start().awaitTermination()


def said(spark: SparkSession, out: str, schema) -> DataFrame:
    """All rows that run_to_end has written, with batch."""
    return spark.read.schema(schema).parquet(f"{out}/*").withColumn("batch", F.regexp_extract(F.input_file_name(), r"/batch=(\d+)/", 1).cast("long"))


def latest(rows: DataFrame, *keys: str) -> DataFrame:
    """Of the updates that `said` returns the last one of each key."""
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("__last"))
    return last.select(*keys, "__last.*")


def as_stream(rows: DataFrame, name: str = "landed") -> DataFrame:
    """A table as a stream of one batch: its rows written to the shared folder, and read by a file stream."""
    spark, folder = rows.sparkSession, new_folder(rows.sparkSession, name)
    rows.write.parquet(folder)
    return spark.readStream.schema(rows.schema).parquet(folder)
