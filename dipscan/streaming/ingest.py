"""Take in newly arrived photometry files, each row once, however often it is delivered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.cadences import path_exists

KEYS = ["tic_id", "sector", "t_us"]


def arriving(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A stream of the cadence rows in files that appear under ``path``."""
    return spark.readStream.schema(schema).parquet(path)


def store_new(batch: DataFrame, path: str) -> None:
    """Append the rows of ``batch`` not stored yet, by target, sector and time.

    Only the stored partitions of the batch's own sectors are read. Old sectors may arrive at
    any time (no watermark, so nothing is ever too late), and a repeated batch adds nothing.
    """
    spark = batch.sparkSession
    new = batch.dropDuplicates(KEYS)
    if path_exists(spark, path):
        # the batch's sectors prune the stored partitions at run time
        sectors = batch.select("sector").distinct()
        stored = spark.read.parquet(path).join(sectors, "sector", "left_semi")
        new = new.join(stored.select(*KEYS), KEYS, "left_anti")
    new.write.mode("append").partitionBy("sector").parquet(path)


def ingest(
    stream: DataFrame, checkpoint: str, path: str, then: Callable[[DataFrame], None] | None = None
) -> None:
    """Store everything that has arrived, hand each batch's targets to ``then``, and stop."""

    def handle(batch: DataFrame, _: int) -> None:
        store_new(batch, path)
        if then is not None:
            then(batch.select("tic_id").distinct())

    query = (
        stream.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
