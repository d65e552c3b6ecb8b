"""Label encoding and classification helpers on DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierloom.functions.chunks import rank_by_range


def label_codes(labels: DataFrame, label: str = "label") -> DataFrame:
    """Distinct labels numbered from 0 in code-point order.

    Distinct labels are ranked inside ranges of themselves, so no task sorts all of them,
    however alike they begin.
    """
    distinct = labels.select(label).filter(F.col(label).isNotNull()).distinct()
    return rank_by_range(distinct, [F.col(label)], "code")


def encode(rows: DataFrame, codes: DataFrame, label: str = "label") -> DataFrame:
    return rows.join(codes, label)


def decode(rows: DataFrame, codes: DataFrame, code: str = "code", label: str = "label") -> DataFrame:
    return rows.join(codes.select(F.col("code").alias(code), label), code)


def source_of(stems: DataFrame, videos: DataFrame) -> DataFrame:
    """Add ``source``: video of that stem, else of the stem without ``_60``/``_90``, else a dated
    corpus stem, else null. ``videos`` has stem, source."""
    index = videos.groupBy("stem").agg(F.max("source").alias("source"))
    # Without a suffix this is the stem itself, which finds what the exact join finds: a null would send all such rows to one task.
    base = F.regexp_replace("stem", "_(60|90)$", "")
    by_stem = index.select("stem", F.col("source").alias("_exact"))
    by_base = index.select(F.col("stem").alias("_base"), F.col("source").alias("_loose"))
    year = F.substring("stem", 1, 4).try_cast("int")
    dated = F.col("stem").rlike(r"^\d{8}(_|$)") & year.between(2010, 2030)
    return (stems.withColumn("_base", base).join(by_stem, "stem", "left").join(by_base, "_base", "left")
            .withColumn("source", F.coalesce("_exact", "_loose", F.when(dated, "corpus")))
            .drop("_base", "_exact", "_loose"))


def with_unmatched(source: Column) -> Column:
    return F.coalesce(source, F.lit("unmatched"))
