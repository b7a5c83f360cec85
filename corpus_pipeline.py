"""Corpus pipeline: the training-data operators in sequence over `documents`.

Language ID drops what it rejects; line dedup cuts repeated multi-line chunks and drops texts that lost all their lines;
SimHash near-dedup keeps one document of each group; decontamination drops documents that hold a benchmark item; mixing
takes documents so that sources come near their target weights, one row for each time a document is taken (`copy`).

Nulls, empty texts, ties, repeated rows and extra columns are treated as each operator's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meshlake.llm import decontaminate, language_id, line_dedup, mixing, simhash_dedup
from meshlake.llm._shared import dropped, read_table, released, shared_path, temporary


def _language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.accepted(docs)


def _line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.without_repeats(docs)


def _near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_dedup.deduplicated(docs)


def _decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, read_table(spark, sf_dir, "benchmark"))


def _mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


STAGES = [
    ("language_id", _language_id),
    ("line_dedup", _line_dedup),
    ("simhash_near_dedup", _near_dedup),
    ("benchmark_decontamination", _decontamination),
    ("mixing", _mixing),
]

#: A trained classifier, SimHash and random rounding have no SQL; tests compare each stage with a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over `documents`; each one's rows are written as Parquet and read again.

    A stage's table is deleted once the next one is written, the last one at the end of the program.
    """
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = temporary(shared_path(spark, f"stage-{name}"))
        with released(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before:
            dropped(spark, before)
        before = path
    return docs
