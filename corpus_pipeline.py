"""A training corpus from raw documents, in five stages.

Each stage gets (session, documents so far, folder of the tables) and returns the documents it
keeps, with the columns of ``documents``; the last returns the mix, a row per copy taken, numbered
by ``copy``. :func:`run` writes every stage's rows to the shared folder and rereads them, so a lost
executor repeats one stage at most. Null ids and texts, empty texts and repeated rows pass through
the stages as their operators define; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dipscan.llm import decontaminate, line_dedup, minhash, mixing, quality
from dipscan.llm.common import table
from dipscan.session import materialize


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte-level network accepts."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def cut_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the line blocks they share with an earlier document."""
    return line_dedup.remaining(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return minhash.deduplicated(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, under other numbers and names either."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources at their target weights."""
    return mixing.mixture(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", cut_lines),
    ("MinHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("mixing sources", mix_sources),
]

#: A trained network, alignments and hashed draws have no SQL form; tests hold the stages
#: against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
