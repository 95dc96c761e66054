"""From raw documents to a training mix: STAGES in order, each on what the one before kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from raceform.llm import bottomk, decontaminate, line_runs, mixing, toxicity
from raceform.session import materialize, tune

DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def with_text(docs: DataFrame, text: Column) -> DataFrame:
    """``docs`` with another text and its length; null texts stay null."""
    changed = docs.withColumn("text", F.when(F.col("text").isNotNull(), text))
    return changed.withColumn("n_chars", F.char_length("text").cast("bigint")).select(*DOCUMENT)


def clean_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go; labels of training folds alone teach the classifier."""
    labels = tune(spark).read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.score(docs.select(*DOCUMENT), labels).where("predicted = 0").select(*DOCUMENT)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; a document that loses all its lines goes, one that had no text stays."""
    out = line_runs.dedup_lines(docs.select(*DOCUMENT)).where((F.col("n_dropped") == 0) | (F.col("kept") != ""))
    return with_text(out, F.col("kept"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest doc_id; a row without doc_id goes if it copies one that has one."""
    return bottomk.one_of_each(docs.select(*DOCUMENT))


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of benchmark phrases are cut out; a document of which nothing else is left goes."""
    benchmark = tune(spark).read.parquet(f"{sf_dir}/benchmark.parquet")
    out = decontaminate.decontaminate(docs.select(*DOCUMENT), benchmark).where((F.size("spans") == 0) | (F.btrim("cleaned") != ""))
    return with_text(out, F.col("cleaned"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words the mix takes from each document."""
    return mixing.mix(docs).documents


STAGES = [
    ("toxicity", clean_language),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", benchmark_free),
    ("mixing", source_mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage; each stage is stored and read again."""
    docs = tune(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


# Scores of trained classifiers have no SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None
