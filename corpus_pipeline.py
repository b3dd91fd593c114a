"""A training corpus from raw documents: quality, line dedup, near-duplicates, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's result as a table in the shared folder and reads it
again as the next one's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.llm import common, compression, decontaminate, linededup, mixing, simhash


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier rejects go."""
    return compression.keep_good(docs, common.docs_of(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten documents or more hold go; n_chars follows the text. Of ten or more copies of a document none keeps any text."""
    common.ship(spark)
    kept = linededup.drop_common_lines(docs, n_lines="_strand_lines", n_dropped="_strand_dropped")
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col("_strand_dropped") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return kept.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the least id."""
    common.ship(spark)
    return simhash.keep_one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.keep_clean(docs, common.docs_of(spark, sf_dir, "benchmark"))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once, those of small sources again in further epochs, up to the target weights."""
    common.ship(spark)
    return mixing.mixture(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mixing", mixing_sources),
]

#: The first stage's compression has no SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.docs_of(spark, sf_dir)
    last = None
    for name, stage in STAGES:
        with common.clearing(spark) as written:
            docs = common.cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
            made = written.pop()  # the stage's result stays, what it was made of goes
            if last:
                written.append(last)  # and so does the stage's before
            last = made
    return docs
