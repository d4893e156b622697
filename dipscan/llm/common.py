"""Spark helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dipscan.session import materialize

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def boxed(docs: DataFrame) -> DataFrame:
    """``docs`` as one struct column ``_doc``, so that no name of theirs meets one of an operator's."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))


def unboxed(rows: DataFrame) -> DataFrame:
    return rows.select("_doc.*")


def fold(text):
    """A-Z to a-z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc_mod(doc_id, n: int):
    """crc32 of the id as text, modulo ``n``; null ids are in no class."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def components(edges: DataFrame) -> DataFrame:
    """(node, component_id): the smallest node reachable, for every node that has an edge.

    Alternates large-star and small-star steps, each a combining aggregate and a join, until the
    edge set no longer changes. ``edges`` has two bigint columns ``u`` and ``v``.
    """
    now = materialize(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
        "edges",
    )
    print_of = _fingerprint(now)
    while print_of[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.join(low, "u").where("v > u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        following = materialize(
            small.union(low.select("u", F.col("m").alias("v")))
            .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
            .distinct(),
            "edges",
        )
        now, last = following, print_of
        print_of = _fingerprint(now)
        if print_of == last:
            break
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component_id")).union(
        roots.select("node", F.col("node").alias("component_id"))
    )


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    ).first()
    return tuple(row)
