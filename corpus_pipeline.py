"""From raw documents to a training mix, in stages that are written and read again in between."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierloom.llm import decontaminate, jaccard_join, mixing, pii, quality_classifier
from tierloom.llm.common import stored, table


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    judged = quality_classifier.classify(docs, table(spark, sf_dir, "labels"))
    return judged.filter("kept").select(docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest id."""
    return jaccard_join.first_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark text go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to its kind; n_chars follows the text."""
    cleaned = pii.find(docs, cleaned="text").select(docs.columns)
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the mix takes, with the number of times it takes them and the figures behind it."""
    taken = mixing.mix(docs).filter("taken > 0")
    return taken.withColumn("copies", (F.col("taken") / F.col("size")).cast("int"))


STAGES = [("quality", good_documents), ("near_duplicates", one_of_each), ("decontamination", without_benchmark),
          ("personal_data", without_personal_data), ("mixture", mixed)]

#: The learned and approximate stages have no SQL form; tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
