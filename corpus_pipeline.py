"""A training corpus from the documents table, in five stages over everything the one before has kept.

quality     documents whose lines the learned field finds bad go (score under 0.7)
line_dedup  of equal or nearly equal lines the earliest stays; a document of which nothing is left goes
near_dup    of each group of documents linked by 5-gram Jaccard of 0.8 or more, that with the smallest id stays
decontam    benchmark passages are cut out; a document that is mostly such goes
packing     the texts that are left, as token pieces in sequences of 2048

SQL can't express the stages. Tests hold each to its rules; near_dup, decontam and packing are compared with what the operators
themselves find, and the operators' own tests compare that with plain versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessitura.llm.decontamination import decontaminated
from tessitura.llm.line_dedup import without_repeated_lines
from tessitura.llm.line_quality import without_bad
from tessitura.llm.ngram_join import one_of_each
from tessitura.llm.packing import packed_documents
from tessitura.llm.shared import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more; without usable labels all score 0.5 and go. Null and empty texts are scored as one
    empty line, repeated rows alike."""
    return without_bad(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated lines; null and empty texts stay as they are, repeated rows are treated alike."""
    return without_repeated_lines(docs)


def near_dup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked texts, also of repeated rows; texts without words, null ones too, all stay."""
    return one_of_each(docs)


def decontam(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without benchmark passages; null and empty ones stay, as does everything if the benchmark is empty."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of each document and their places; null and empty texts are one piece of the end mark alone."""
    return packed_documents(docs)


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dup", near_dup), ("decontam", decontam), ("packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's are written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
