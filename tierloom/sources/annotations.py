"""Annotation documents (XML with time slots and tiers) and landmark lines (JSON)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierloom import schemas as S
from tierloom.fixed_values import N_LANDMARKS
from tierloom.functions.chunks import rank_in_groups
from tierloom.functions.text import file_stem


def annotations_of_text(files: DataFrame, content: str = "content", tiers: Sequence[str] | None = None) -> DataFrame:
    """Annotations (stem, tier, start_ms, end_ms, value) of XML documents; broken ones drop out.

    Slot times are looked up in a map of the same document, so no join is needed.
    """
    doc = F.from_xml(F.col(content), S.ANNOTATION_DOCUMENT,
                     {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    # Broken documents drop out as null arrays: a filter would be pushed down and parse every document twice.
    rows = files.select("stem", doc.alias("d"))
    rows = rows.withColumn("slots", F.filter("d.TIME_ORDER.TIME_SLOT", lambda s: s["_TIME_SLOT_ID"].isNotNull()))
    ids = F.col("slots._TIME_SLOT_ID")
    # A document that repeats a slot id keeps its last time.
    last = F.filter("slots", lambda s, i: F.size(ids) - F.array_position(F.reverse(ids), s["_TIME_SLOT_ID"]) == i)
    once = F.when(F.size(F.array_distinct(ids)) < F.size(ids), last).otherwise(F.col("slots"))
    slots = F.map_from_entries(F.transform(once, lambda s: F.struct(s["_TIME_SLOT_ID"], s["_TIME_VALUE"])))
    rows = rows.select("stem", slots.alias("slots"), F.explode(F.when(F.col("d._corrupt").isNull(), F.col("d.TIER"))).alias("t"))
    if tiers is not None:
        rows = rows.filter(F.col("t._TIER_ID").isin(list(tiers)))
    rows = rows.select("stem", "slots", F.col("t._TIER_ID").alias("tier"), F.explode("t.ANNOTATION").alias("a"))
    a = F.col("a.ALIGNABLE_ANNOTATION")
    return rows.filter(a.isNotNull()).select(
        "stem", "tier", F.try_element_at("slots", a["_TIME_SLOT_REF1"]).alias("start_ms"),
        F.try_element_at("slots", a["_TIME_SLOT_REF2"]).alias("end_ms"),
        F.coalesce(a["ANNOTATION_VALUE"], F.lit("")).alias("value"))


def read_annotations(spark: SparkSession, folder: str, tiers: Sequence[str] | None = None) -> DataFrame:
    files = (spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True)
             .option("pathGlobFilter", "*.eaf").load(folder)
             .select(file_stem(F.col("_metadata.file_path")).alias("stem"), F.col("value").alias("content")))
    return annotations_of_text(files, "content", tiers)


def poses_of_lines(lines: DataFrame, line: str = "line", size: int = N_LANDMARKS) -> DataFrame:
    """Pose frames (clip, frame, pts) of landmark lines ``{frame, timestamp, landmarks}``.

    Unreadable lines drop out and the frames left are numbered from 0. The first ``size``
    landmarks count, z is 0, short or missing ones are zero.
    """
    parsed = F.from_json(line, S.LANDMARK_LINE, {"mode": "PERMISSIVE"})
    rows = lines.withColumn("_p", parsed).filter(F.col("_p.frame").isNotNull())
    zero = F.lit(0.0)

    def point(i):
        lm = F.get("_p.landmarks", i)
        ok = F.coalesce(F.size(lm) >= 3, F.lit(False))
        x, y, c = (F.when(ok, F.coalesce(F.get(lm, F.lit(k)), zero)).otherwise(zero) for k in range(3))
        return F.struct(x.alias("x"), y.alias("y"), zero.alias("z"), c.alias("c"))

    pts = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), point)
    rows = rows.select("clip", F.col("_p.frame").alias("_frame"), pts.alias("pts"))
    return rank_in_groups(rows, ["clip"], F.floor(F.col("_frame") / 4096), [F.col("_frame")], "frame").drop("_frame")


def read_pose_lines(spark: SparkSession, folder: str) -> DataFrame:
    lines = (spark.read.format("text").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").load(folder)
             .select(file_stem(F.col("_metadata.file_path")).alias("clip"), F.col("value").alias("line")))
    return poses_of_lines(lines)
