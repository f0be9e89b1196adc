"""The corpus pipeline: quality rules, toxicity, near duplicates, secrets, packing, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundlake.llm import jaccard_join, packing, quality_rules, secret_scan, toxicity
from fundlake.llm.common import read_table, shared_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that neither the base rules nor the learnt ones reject. Empty and null texts fail the base."""
    return quality_rules.keep(docs, read_table(spark, sf_dir, "labels"))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that aren't predicted to be toxic, each row by its own text."""
    return toxicity.score(docs, read_table(spark, sf_dir, "labels"), carry=tuple(docs.columns)).where("predicted = 0").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: the one with the smallest id and text hash, null ids last."""
    return jaccard_join.distinct(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark and n_chars, if there is one, counted anew."""
    name = "spans"
    while name in docs.columns:
        name += "_"
    out = secret_scan.scan(docs, *docs.columns, name=name).withColumn("text", secret_scan.redacted(F.col("text"), F.col(name)))
    if "n_chars" in docs.columns:
        counted = F.when(F.size(name) > 0, F.char_length("text")).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", counted.cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences and places."""
    return packing.pack(docs)


STAGES = [("quality_rules", quality), ("toxicity", toxic), ("jaccard_join", near_duplicates), ("secret_scan", secrets), ("best_fit_packing", pack)]

#: No SQL: the verdicts of stages 1 and 2 come from fitted models.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; each result is written to the shared folder and read again."""
    docs, root = read_table(spark, sf_dir, "documents"), shared_dir(spark)
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{k}_{name}")
        docs = spark.read.parquet(f"{root}/{k}_{name}")
    return docs
