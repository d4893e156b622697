"""Bounded samples of labelled rows, for fitting a classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dipscan.llm.common import crc_mod


def labelled(
    docs: DataFrame, labels: DataFrame, column: str, modulus: int, held: int, per_class: int
) -> tuple[DataFrame, float]:
    """(doc_id, text, label) of at most ``per_class`` rows of either label, and the share of label 1.

    Only ids whose crc32 class isn't ``held`` take part. The ids with the smallest hashes are
    taken, so reruns agree; the share is counted over all rows that may be learned from.
    """
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label"))
        .where(F.col("label").isin(0, 1) & (crc_mod(F.col("doc_id"), modulus) != held))
        .groupBy("doc_id").agg(F.max("label").alias("label"))
    )
    share = known.agg(F.avg("label")).first()[0]
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = None
    for value in (0, 1):
        part = known.where(F.col("label") == value).orderBy(*order).limit(per_class)
        picked = part if picked is None else picked.union(part)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # at most 2 * per_class pairs of numbers: a bounded table
    return texts.join(F.broadcast(picked), "doc_id"), (0.5 if share is None else float(share))
