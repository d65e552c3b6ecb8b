"""Incremental ingest with Structured Streaming.

Alignment works on subtitle files and writes one folder per micro-batch, with segments, aligned stems and files
that still wait together in one job; a row of a manifest then commits the batch. A batch that is run again after
a failure replaces its own folder, so the table is what a single build over all files gives. The sign merge
reads its own rows and the key columns of the table, so no state has to fit in memory.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from tierloom.operators.cues import build_alignment, pick_subtitles
from tierloom.operators.matching import SIGN_KEY
from tierloom.session import checkpointed
from tierloom.sources.subtitles import cues_of_text

SEGMENT = ("segment_id string, stem string, start_ms bigint, end_ms bigint, frame_start bigint, frame_end bigint, "
           "text string, fps double, n_frames bigint, status string, reviewed_text string, "
           "reviewed_start_ms bigint, reviewed_end_ms bigint")
FILE = "stem string, path string, kind string, lang string, content string"
BATCH = f"part string, stem string, segment struct<{SEGMENT.replace(' ', ':').replace(',:', ',')}>, file struct<{FILE.replace(' ', ':').replace(',:', ',')}>"
MANIFEST = "batch int, stems bigint, segments bigint, waiting bigint"


def read_or_empty(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """The Parquet table of a folder, or no rows while there is no folder."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def committed(spark: SparkSession, table: str) -> DataFrame:
    """Manifest of an alignment table: one row per finished batch."""
    return read_or_empty(spark, f"{table}/manifest", MANIFEST)


def _parts(spark: SparkSession, table: str, part: str, before: int | None = None) -> DataFrame:
    """Rows of one kind in committed batches, in those before a number if given; other kinds are not read."""
    rows = read_or_empty(spark, f"{table}/batches", f"{BATCH}, batch int").filter(F.col("part") == part)
    if before is not None:
        return rows.filter(F.col("batch") < before)
    return rows.join(F.broadcast(committed(spark, table).select("batch")), "batch", "left_semi")


def aligned(spark: SparkSession, table: str) -> DataFrame:
    """All segments of committed batches."""
    return _parts(spark, table, "segment").select("segment.*")


def _align_batch(files: DataFrame, inventory: DataFrame, poses: DataFrame, known: DataFrame) -> DataFrame:
    """Segments, stems and waiting files of a batch, told apart by ``part``.

    A file whose video is listed and has a non-empty pose is settled now; the others wait. Files of known
    stems are dropped.
    """
    stems = files.select("stem").distinct()
    # The inventory and the poses of all videos are read once per batch; what follows sees the videos of the batch.
    listed = inventory.select("stem").join(stems, "stem", "left_semi").distinct()
    ready = checkpointed(poses.filter("bytes > 0").join(stems, "stem", "left_semi").join(listed, "stem", "left_semi"))
    fresh = files.join(known.select("stem").distinct(), "stem", "left_anti")
    now = fresh.join(ready.select("stem").distinct(), "stem", "left_semi")
    picked = checkpointed(pick_subtitles(now))
    chosen = now.join(picked.select("stem", "path"), ["stem", "path"], "left_semi").dropDuplicates(["stem", "path"])
    cues = cues_of_text(chosen).drop("stem").join(chosen.select("path", "stem"), "path")
    segments = build_alignment(ready.select("stem").distinct(), ready, picked, cues, known)
    columns = [c.split()[0] for c in SEGMENT.split(", ")]
    part = segments.select(F.lit("segment").alias("part"), "stem", F.struct(*columns).alias("segment"))
    part = part.unionByName(picked.select(F.lit("stem").alias("part"), "stem"), allowMissingColumns=True)
    # A video whose files hold no cue yet waits like one without a pose: a better file may come.
    waits = fresh.join(picked.select("stem"), "stem", "left_anti").select(
        F.lit("waiting").alias("part"), "stem", F.struct(*[c.split()[0] for c in FILE.split(", ")]).alias("file"))
    return part.unionByName(waits, allowMissingColumns=True)


def align_new_files(files: DataFrame, inventory: DataFrame, poses: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Align the videos of new subtitle files, each video once.

    ``files`` is a stream of stem, path, kind (soft or ocr), lang and content. Every batch builds its alignment like
    a build over all files does (best file per video, near-duplicate and short cues merged, non-empty pose), for
    videos that no earlier batch settled. Files whose video is not ready are kept with the batch and come up again
    with the next one. Read the table with ``aligned``.
    """
    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        waiting = _parts(spark, table, "waiting", number).filter(F.col("batch") == number - 1).select("file.*")
        columns = [c.split()[0] for c in FILE.split(", ")]
        given = checkpointed(batch.select(*columns).unionByName(waiting))
        known = _parts(spark, table, "stem", number).select("stem")
        rows = _align_batch(given, inventory, poses, known)
        place = f"{table}/batches/batch={number}"
        rows.write.mode("overwrite").partitionBy("part").parquet(place)
        counted = read_or_empty(spark, place, BATCH).agg(
            F.count_if(F.col("part") == "stem").alias("stems"), F.count_if(F.col("part") == "segment").alias("segments"),
            F.count_if(F.col("part") == "waiting").alias("waiting"))
        counted.coalesce(1).write.mode("overwrite").parquet(f"{table}/manifest/batch={number}")

    return (files.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def merge_new_signs(signs: DataFrame, table: str, checkpoint: str, order: str = "item_no",
                    keys: Sequence[str] = SIGN_KEY) -> StreamingQuery:
    """Add signs whose (stem, start, hand) is new; of several in a batch the one of smallest ``order`` is added.

    A batch is reduced to one row per key and held against the key columns of the table by a join, so neither a
    call per key nor a state that must fit in memory is needed. A batch that is run again finds the keys it has
    added and picks the same rows for the others, so it adds nothing twice. Ties in ``order`` go by the other columns.
    """
    keys = list(keys)
    schema = signs.schema
    others = [c for c in schema.names if c not in keys]
    ranked = [F.col(order).isNull().alias("_none"), order, *[c for c in others if c != order]]

    def one(batch: DataFrame, number: int) -> None:
        known = read_or_empty(batch.sparkSession, table, schema).select(*[F.col(k).alias(f"_{k}") for k in keys])
        first = batch.groupBy(*keys).agg(F.min(F.struct(*ranked)).alias("_first"))
        same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
        fresh = first.join(known, same, "left_anti").select(*[c if c in keys else F.col(f"_first.{c}").alias(c) for c in schema.names])
        fresh.write.mode("append").parquet(table)

    return (signs.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
