"""The queries opN_<name> and the pipeline, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dipscan.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op4_run_index(spark: SparkSession, folder: str) -> DataFrame:
    from dipscan.llm.rindex import deduplicated

    return deduplicated(table(spark, folder, "documents"), keep=False)


def op5_ftrl(spark: SparkSession, folder: str) -> DataFrame:
    from dipscan.llm.toxicity import scored

    return scored(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op6_byte_cnn(spark: SparkSession, folder: str) -> DataFrame:
    from dipscan.llm.quality import scored

    return scored(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op7_log_bilinear(spark: SparkSession, folder: str) -> DataFrame:
    from dipscan.llm.lm import scored

    return scored(table(spark, folder, "documents"))


def op8_itq(spark: SparkSession, folder: str) -> DataFrame:
    from dipscan.llm.itq import linked

    return linked(table(spark, folder, "embeddings"))


def op9_license_bands(spark: SparkSession, folder: str) -> DataFrame:
    from dipscan.llm.licenses import licenses

    return licenses(table(spark, folder, "documents")).select("doc_id", "license", "containment")


def op10_minhash(spark: SparkSession, folder: str) -> DataFrame:
    from dipscan.llm.minhash import near_duplicates

    return near_duplicates(table(spark, folder, "documents"))


def op11_spelling(spark: SparkSession, folder: str) -> DataFrame:
    from dipscan.llm.spelling import variants

    return variants(table(spark, folder, "documents"))


def op12_qdwh(spark: SparkSession, folder: str) -> DataFrame:
    from dipscan.llm.whitening import whitened

    return whitened(table(spark, folder, "embeddings"))


def op13_retrieval_packing(spark: SparkSession, folder: str) -> DataFrame:
    from dipscan.llm.packing import pieces, public

    return pieces(table(spark, folder, "documents"), public())


def op1_templates(spark: SparkSession, folder: str) -> DataFrame:
    from dipscan.llm.decontaminate import report

    return report(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op2_line_alignment(spark: SparkSession, folder: str) -> DataFrame:
    from dipscan.llm.line_dedup import report

    return report(table(spark, folder, "documents"))


def op3_entropy_mix(spark: SparkSession, folder: str) -> DataFrame:
    from dipscan.llm.mixing import plan

    return plan(table(spark, folder, "documents"))


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


def queries() -> dict[str, Query]:
    return {
        "op1_templates": op1_templates, "op2_line_alignment": op2_line_alignment, "op3_entropy_mix": op3_entropy_mix,
        "op4_run_index": op4_run_index, "op5_ftrl": op5_ftrl, "op6_byte_cnn": op6_byte_cnn, "op7_log_bilinear": op7_log_bilinear, "op8_itq": op8_itq,
        "op9_license_bands": op9_license_bands, "op10_minhash": op10_minhash, "op11_spelling": op11_spelling,
        "op12_qdwh": op12_qdwh, "op13_retrieval_packing": op13_retrieval_packing, "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    from dipscan.llm import oracles
    from dipscan.llm.licenses import NOTICES

    return {
        "op8_itq": oracles.VECTORS, "op9_license_bands": oracles.licenses(NOTICES), "op10_minhash": oracles.MINHASH,
    }
