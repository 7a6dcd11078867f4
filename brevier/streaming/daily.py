"""The daily job over newly landed items: a file stream that runs until it has caught up."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from brevier.operators import rules as R
from brevier.operators.merge import run_pipeline
from brevier.sources.corpus import release_lock, take_lock, update_table


def run_landed(
    spark: SparkSession, landed: str, schema: str, inventory: str, checkpoint: str, pack: R.RulePack, run_date: Callable[[], str]
) -> StreamingQuery:
    """Merge each micro-batch of landed raw items (Parquet) into the inventory table, then stop.

    A batch is committed together with its number: one that is run again after a crash changes nothing. Other jobs may
    write the table meanwhile; the batch is then merged again into what they left.
    """

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        update_table(spark, inventory, lambda existing: run_pipeline(existing, batch, pack, run_date())["articles"], (checkpoint, number))

    stream = spark.readStream.schema(schema).parquet(landed)
    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_daily(
    spark: SparkSession,
    landed: str,
    schema: str,
    inventory: str,
    checkpoint: str,
    pack: R.RulePack,
    run_date: Callable[[], str],
    clock: Callable[[], float] = time.time,
) -> bool:
    """run_landed to its end, unless another run holds the inventory's lock: then nothing is done, and False returned."""
    lock = f"{inventory}/_lock"
    token = take_lock(spark, lock, int(clock() * 1000))
    if token is None:
        return False
    try:
        run_landed(spark, landed, schema, inventory, checkpoint, pack, run_date).awaitTermination()
    finally:
        release_lock(spark, lock, token)
    return True
