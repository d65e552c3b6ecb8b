"""Writers: partitioned tables, split files, evaluation reports, indexes, annotation tiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(rows: DataFrame, path: str, by: str | None = None, kind: str = "parquet") -> None:
    """Write a table, one folder per value of ``by``; rows of one value keep their many tasks."""
    writer = rows.write.mode("overwrite").format(kind)
    if kind == "csv":
        writer = writer.option("header", True).option("escape", '"')
    if by is not None:
        writer = writer.partitionBy(by)
    writer.save(path)


def write_splits(rows: DataFrame, path: str) -> None:
    """train, val and test as CSV folders."""
    write_table(rows, path, "split", "csv")


def overwrite_stems(rows: DataFrame, path: str) -> None:
    """Replace the tier rows of the stems present in ``rows``; other stems stay as they are."""
    (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("stem").parquet(path))


def evaluation_report(metrics: DataFrame, per_class: DataFrame, model: str) -> DataFrame:
    """JSON lines of a report: one line of metrics, then one line per class."""
    head = metrics.select(F.lit(model).alias("model"), F.lit("metrics").alias("part"), F.lit("").alias("label"),
                          F.to_json(F.struct(*metrics.columns)).alias("json"))
    return head.unionByName(per_class.select(
        F.lit(model).alias("model"), F.lit("class").alias("part"), "label", F.to_json(F.struct(*per_class.columns)).alias("json")))


def write_evaluation(metrics: DataFrame, per_class: DataFrame, model: str, folder: str) -> None:
    metrics.write.mode("overwrite").json(f"{folder}/{model}_eval")
    write_table(per_class, f"{folder}/{model}_per_class", kind="csv")


def save_index(index: DataFrame, path: str) -> None:
    index.write.mode("overwrite").parquet(path)


def load_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
