"""Neighbourhoods, next items and ordered listings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tierloom.functions.chunks import chunk_of


def neighbourhoods(items: DataFrame, heads: DataFrame, radius_ms: int = 5000, show: int = 8) -> DataFrame:
    """Glosses and span of the items strictly within ``radius_ms`` of each head.

    ``items``: stem, item_no, start_ms, end_ms, gloss; ``heads``: stem, item_no. Only heads look around:
    they meet the items of their time bucket and its neighbours, and the glosses shown are the
    only ones collected.
    """
    reach = radius_ms - 1
    at = items.join(heads.select("stem", "item_no").distinct(), ["stem", "item_no"], "left_semi").select(
        "stem", F.col("item_no").alias("_head"), F.col("start_ms").alias("_at"))
    at = at.withColumn("_bucket", F.explode(F.sequence(
        chunk_of(F.col("_at") - reach, radius_ms), chunk_of(F.col("_at") + reach, radius_ms))))
    near = items.withColumn("_bucket", chunk_of("start_ms", radius_ms)).join(at, ["stem", "_bucket"]).filter(
        F.abs(F.col("start_ms") - F.col("_at")) <= reach)
    in_order = Window.partitionBy("stem", "_head").orderBy("start_ms", "item_no", "gloss")
    shown = F.collect_list(F.when(F.col("_r") <= show, F.struct("_r", "gloss")))
    # Grouped like the window, so the rows are shuffled once.
    return near.withColumn("_r", F.row_number().over(in_order)).groupBy("stem", "_head").agg(
        F.array_join(F.transform(F.array_sort(shown), lambda n: n["gloss"]), " ").alias("glosses"),
        F.min("start_ms").alias("span_start_ms"), F.max("end_ms").alias("span_end_ms")).withColumnRenamed("_head", "item_no")


def next_pending(units: DataFrame, current: DataFrame) -> DataFrame:
    """The first pending unit after the current one of each stem, else the first before it."""
    waiting = units.filter(F.col("review_status") == "pending").join(
        current.select("stem", F.col("item_no").alias("_at")), "stem")
    after = F.min(F.when(F.col("item_no") > F.col("_at"), F.col("item_no")))
    before = F.min(F.when(F.col("item_no") < F.col("_at"), F.col("item_no")))
    found = waiting.groupBy("stem").agg(F.coalesce(after, before).alias("next_no"))
    return current.select("stem", "item_no").join(found, "stem", "left")


def ordered(rows: DataFrame, *columns: str) -> DataFrame:
    """Sorted listing; a leading minus means descending."""
    return rows.orderBy(*[F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in columns])
