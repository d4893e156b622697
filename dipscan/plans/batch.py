"""Batches: report on every target without an outcome, record outcomes, keep the two tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.catalog import unfinished
from ..session import materialize
from ..sources.cadences import path_exists
from ..sources.tables import candidate_entries, read_reports, star_rows, write_reports
from .report import run_curves

STATUSES = T.StructType([
    T.StructField("tic_id", T.LongType()), T.StructField("status", T.StringType()),
    T.StructField("message", T.StringType()),
])


def outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """The last recorded outcome of every target."""
    if not path_exists(spark, f"{folder}/statuses"):
        return spark.createDataFrame([], STATUSES)
    rows = spark.read.parquet(f"{folder}/statuses")
    last = F.max_by(F.struct("status", "message"), "recorded").alias("x")
    return rows.groupBy("tic_id").agg(last).select("tic_id", "x.*")


def reports(spark: SparkSession, folder: str) -> DataFrame | None:
    """All stored reports, with ``unreadable``."""
    if not path_exists(spark, f"{folder}/reports"):
        return None
    schema = spark.read.parquet(f"{folder}/schema").schema
    return read_reports(spark, f"{folder}/reports", schema)


def run_batch(
    targets: DataFrame, raw: DataFrame, folder: str, min_points: int = 100, retry_failed: bool = False, **settings
) -> DataFrame:
    """Search and report every unfinished target at once; one outcome row for each of them.

    ``targets``: tic_id; ``raw``: cleaned cadences; ``settings`` go to :func:`run_curves`. A target
    with fewer than ``min_points`` rows is 'no data'; one that gets no report is an 'error'. Reports
    are written before outcomes, so a batch that is lost halfway is done again. Returns the new
    outcomes; calling again with nothing unfinished does nothing.
    """
    spark = targets.sparkSession
    folder = folder.rstrip("/")
    known = reports(spark, folder)
    readable = targets.limit(0) if known is None else known.where("NOT unreadable").select("tic_id")
    todo = unfinished(targets.select("tic_id").distinct(), outcomes(spark, folder), readable, retry_failed)
    todo = materialize(todo, "todo")
    if todo.isEmpty():
        return spark.createDataFrame([], STATUSES)
    enough = (
        raw.join(todo, "tic_id", "left_semi").groupBy("tic_id").agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= min_points).select("tic_id")
    )
    enough = materialize(enough, "enough")
    done = enough.limit(0)
    if not enough.isEmpty():
        out, _ = run_curves(raw.join(enough, "tic_id", "left_semi"), **settings)
        out = materialize(out, "reports")
        write_reports(out, f"{folder}/reports")
        out.limit(0).write.mode("overwrite").parquet(f"{folder}/schema")
        done = out.select("tic_id")
    searched, fit = done.withColumn("_done", F.lit(True)), enough.withColumn("_fit", F.lit(True))
    rows = todo.join(fit, "tic_id", "left").join(searched, "tic_id", "left").select(
        "tic_id",
        F.when(F.col("_done"), "searched").when(F.col("_fit"), "error").otherwise("no data").alias("status"),
        F.when(F.col("_done"), "").when(F.col("_fit"), "no report came out")
        .otherwise(F.lit(f"fewer than {min_points} points")).alias("message"),
    )
    rows = materialize(rows, "outcomes")
    rows.withColumn("recorded", F.current_timestamp()).write.mode("append").parquet(f"{folder}/statuses")
    return rows


def write_tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The stars and candidates tables of all batches so far, written beside the reports."""
    folder = folder.rstrip("/")
    known = reports(spark, folder)
    if known is None:
        raise ValueError(f"no batch has been run into {folder}")
    tables = {"stars": star_rows(outcomes(spark, folder), known), "candidates": candidate_entries(known)}
    out = []
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{folder}/{name}")
        out.append(spark.read.parquet(f"{folder}/{name}"))
    return out[0], out[1]
