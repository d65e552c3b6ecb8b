"""Eligibility, readiness and to-do lists over videos and produced files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierloom.functions.text import blank


def small_files(files: DataFrame, least: int = 10_000) -> DataFrame:
    """Files below ``least`` bytes; an unreadable file (no length) counts as -1."""
    return files.withColumn("bytes", F.coalesce("bytes", F.lit(-1).cast("long"))).filter(F.col("bytes") < least)


def batch_eligibility(videos: DataFrame, poses: DataFrame, segments: DataFrame, least: int = 10_000) -> DataFrame:
    """Status and reason per video: no pose, unknown size, too small, else ok with its segment count."""
    sized = poses.groupBy("stem").agg(F.max("bytes").alias("bytes"), F.lit(True).alias("has_pose"))
    counts = segments.groupBy("stem").agg(F.count(F.lit(1)).alias("n_segments"))
    reason = (F.when(F.col("has_pose").isNull(), "No pose file")
              .when(F.col("bytes").isNull(), "Cannot stat pose file")
              .when(F.col("bytes") < least, F.format_string("Pose file too small (%d bytes)", "bytes")))
    return (videos.select("stem").join(sized, "stem", "left").join(counts, "stem", "left")
            .select("stem", reason.alias("reason"), "n_segments")
            .select("stem", F.when(F.col("reason").isNull(), "ok").otherwise("skipped").alias("status"), "reason",
                    F.when(F.col("reason").isNull(), F.coalesce("n_segments", F.lit(0).cast("long"))).alias("n_segments")))


def readiness(videos: DataFrame, **tables: DataFrame) -> DataFrame:
    """One flag per named table (``has_<name>``) and ``paired`` when all are there."""
    out = videos.select("stem")
    for name, df in tables.items():
        marks = df.select("stem").distinct().withColumn(f"has_{name}", F.lit(True))
        out = out.join(marks, "stem", "left").withColumn(f"has_{name}", F.coalesce(f"has_{name}", F.lit(False)))
    both = F.lit(True)
    for name in tables:
        both = both & F.col(f"has_{name}")
    return out.withColumn("paired", both)


def filter_segments(segments: DataFrame, status: str | None = None, source: str | None = None,
                    pose: bool | None = None) -> DataFrame:
    """Rows by review status, by text inside the source (any case) and by pose presence."""
    rows = segments
    if status is not None:
        rows = rows.filter(F.col("status") == status)
    if source is not None:
        rows = rows.filter(F.lower("source").contains(source.lower()))
    if pose is not None:
        rows = rows.filter(F.col("has_pose") == pose)
    return rows


def remaining_entries(entries: DataFrame, done: DataFrame, classes: list[str], limit: int = 0) -> DataFrame:
    """Dictionary entries with a translation that are not downloaded; ``limit`` 0 means all."""
    rows = entries.filter(~blank("translation")).join(done.select("word_id").distinct(), "word_id", "left_anti")
    if classes:
        rows = rows.filter(F.col("word_class").isin(classes))
    return rows.orderBy("word_id").limit(limit) if limit else rows


def dual_view_todo(videos: DataFrame, outputs: DataFrame, least: int = 100) -> DataFrame:
    """Videos that lack one of the two view outputs (``_60``, ``_90``) above ``least`` bytes."""
    good = outputs.filter(F.col("bytes") > least).select(
        F.regexp_replace("name", "_(60|90)$", "").alias("stem"), F.regexp_extract("name", "_(60|90)$", 1).alias("view"))
    done = good.filter("view <> ''").groupBy("stem").agg(F.count_distinct("view").alias("n")).filter("n = 2")
    return videos.select("stem").join(done, "stem", "left_anti")


def without_generic(rows: DataFrame, most: int = 20, video: str = "video_id") -> DataFrame:
    """Drop videos with more than ``most`` labels: they show context, not a sign."""
    counts = rows.groupBy(video).agg(F.count_distinct("label").alias("n")).filter(F.col("n") <= most)
    return rows.join(counts.select(video), video, "left_semi")


def word_videos(files: DataFrame, words: DataFrame) -> DataFrame:
    """Word videos (``_wd_`` in the name) whose id is known."""
    return (files.filter(F.col("name").contains("_wd_")).withColumn("word_id", F.split("name", "_")[0])
            .join(words, "word_id"))


def output_state(media: DataFrame, outputs: DataFrame) -> DataFrame:
    """Per medium: ``done``, ``failed`` (output of zero bytes) or ``missing``."""
    sized = outputs.groupBy("stem").agg(F.max("bytes").alias("bytes"))
    state: Column = F.when(F.col("bytes").isNull(), "missing").when(F.col("bytes") == 0, "failed").otherwise("done")
    return media.select("stem").join(sized, "stem", "left").select("stem", state.alias("state"))


def pose_without_annotation(poses: DataFrame, annotations: DataFrame) -> DataFrame:
    return poses.select("stem").distinct().join(annotations.select("stem").distinct(), "stem", "left_anti")
