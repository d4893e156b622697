"""Session settings, the shared scratch folder, and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: SQL settings every job relies on. All of them can be changed on a running session.
SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # a hot target must be split even when the join feeds an aggregate on the same key
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # an undefined quotient is NULL here, as everywhere in this package
    "spark.sql.ansi.enabled": "false",
}


def build_session(app: str = "dipscan", master: str | None = None, **conf: str) -> SparkSession:
    """A session with this package's settings; ``master`` is left to the cluster unless given."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SQL_SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Apply :data:`SQL_SETTINGS` to a session somebody else made."""
    for key, value in SQL_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, named by ``spark.checkpoint.dir``.

    Only a session without other machines (``local[...]``) may go without: it gets a folder of
    its own, kept for the session. Elsewhere executors could not read each other's files.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used between passes of a loop: the plan stops growing, the table survives lost
    executors, and its size on disk lets the optimizer choose the next joins.
    """
    path = f"{scratch_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def wide_partitions(spark: SparkSession) -> int:
    """Partition count for CPU-bound Python stages whose rows are few but expensive."""
    return max(
        int(spark.conf.get("spark.sql.shuffle.partitions", "200")),
        4 * spark.sparkContext.defaultParallelism,
    )


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition for a Python stage, widely: its cost is not in the bytes it reads."""
    return df.repartition(wide_partitions(df.sparkSession), *keys)
