"""Manifests of exported segments and signs, and sources for a wider re-export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierloom.functions.text import derive_label
from tierloom.operators.label_sets import quality_filter


def sentence_manifest(alignment: DataFrame, min_samples: int = 1) -> DataFrame:
    """Approved segments with their label, kept where the label has enough samples."""
    rows = alignment.filter(F.col("status") == "approved").withColumn("label", derive_label("reviewed_text", "text"))
    return quality_filter(rows, min_samples)


def sign_manifest(pairings: DataFrame, min_samples: int = 3) -> DataFrame:
    """Paired signs with their gloss as label."""
    rows = pairings.filter(F.col("status") == "paired").select(
        F.col("pairing_id").alias("segment_id"), F.col("gloss_id").alias("label"), F.col("word").alias("text"))
    return quality_filter(rows, min_samples)


def extended_sources(manifest: DataFrame, poses: DataFrame, source: str = "existing") -> DataFrame:
    """Pose file and start frame of the segments to export again.

    The clip is the segment id without its last part; of several roots the first that has
    it counts (``poses``: stem, root_no, pose_path). Segments without a pose drop out.
    """
    first = poses.groupBy("stem").agg(F.min(F.struct("root_no", "pose_path"))["pose_path"].alias("pose_path"))
    stem = F.regexp_replace("segment_id", "_[^_]*$", "")
    return manifest.filter(F.col("source") == source).withColumn("stem", stem).join(first, "stem").select(
        "segment_id", "stem", "pose_path", F.coalesce("start_frame", F.lit(0)).cast("long").alias("start_frame"))
