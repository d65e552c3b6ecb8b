"""Motion signals over frames: wrist position, speed, smoothing, segment detection.

A signal table has one row per ``(clip, frame)`` with dense frames from 0 and the
columns ``x, y, conf, fps``. ``keys`` names the clip columns (one clip may have a
signal per hand). All ordered work runs on frame chunks with a halo, so one very
long clip is spread over many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from tierloom.fixed_values import WRISTS
from tierloom.functions.chunks import FRAME_CHUNK, chunk_of, exact_quantile, is_home, with_halo
from tierloom.functions.timecode import frame_to_ms, ms_to_frame
from tierloom.session import checkpointed

MIN_CONF = 0.2
HAND_CONF = 0.3


def wrist_positions(pose: DataFrame, keys: Sequence[str] = ("clip",)) -> DataFrame:
    """One row per frame and hand: the hand wrist if it is confident, else the body wrist."""

    def side(hand: str) -> Column:
        body, wrist = (F.get("pts", F.lit(i)) for i in WRISTS[hand])
        chosen = F.when(wrist["c"] > HAND_CONF, wrist).otherwise(body)
        return F.struct(F.lit(hand).alias("hand"), chosen["x"].alias("x"),
                        chosen["y"].alias("y"), chosen["c"].alias("conf"))

    rest = [c for c in pose.columns if c not in (*keys, "frame", "pts")]
    return pose.select(*keys, "frame", *rest, F.inline(F.array(side("right"), side("left"))))


def gaussian_kernel(sigma: float) -> list[float]:
    """Normalised weights for offsets -r..r."""
    r = max(1, int(3 * sigma + 0.5))
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    total = sum(raw)
    return [w / total for w in raw]


def _speed(w) -> Column:
    step = F.sqrt(F.pow(F.col("x") - F.lag("x").over(w), 2)
                  + F.pow(F.col("y") - F.lag("y").over(w), 2))
    seen = F.least("conf", F.lag("conf").over(w)) > MIN_CONF
    return F.when(seen & (F.col("frame") > 0), step).otherwise(F.lit(0.0))


def _smooth(value: str, sigma: float, w) -> Column:
    """Zero-padded convolution; neighbours outside the clip count as 0."""
    if sigma <= 0:
        return F.col(value)
    kernel = gaussian_kernel(sigma)
    r = len(kernel) // 2
    total = F.col(value) * kernel[r]
    for k in range(1, r + 1):
        total = total + (F.lag(value, k, 0.0).over(w) + F.lead(value, k, 0.0).over(w)) * kernel[r + k]
    return total


def _chunked_speed(signal: DataFrame, keys: Sequence[str], sigma: float, size: int,
                   before: Column | int, after: Column | int) -> DataFrame:
    """Speed and smoothed speed per (clip, chunk), halo rows included.

    One shuffle by (clip, chunk). Rows within the kernel radius of a halo edge carry
    wrong values, so callers ask for a halo that is wider than what they read.
    """
    r = 0 if sigma <= 0 else len(gaussian_kernel(sigma)) // 2
    before = before + r + 1 if isinstance(before, int) else before + F.lit(r + 1)
    after = after + r if isinstance(after, int) else after + F.lit(r)
    w = Window.partitionBy(*keys, "chunk").orderBy("frame")
    return (
        with_halo(signal, keys, "frame", size, before, after)
        .withColumn("speed", _speed(w))
        .withColumn("smooth", _smooth("speed", sigma, w))
    )


def wrist_speed(signal: DataFrame, keys: Sequence[str] = ("clip",),
                chunk_rows: int = FRAME_CHUNK) -> DataFrame:
    """XY distance to the frame before; 0 where either end is not confident."""
    rows = _chunked_speed(signal, keys, 0, chunk_rows, 0, 0)
    return rows.filter(is_home("frame", chunk_rows)).select(*keys, "frame", "speed")


def smoothed_speed(signal: DataFrame, sigma: float = 3.0, keys: Sequence[str] = ("clip",),
                   chunk_rows: int = FRAME_CHUNK) -> DataFrame:
    rows = _chunked_speed(signal, keys, sigma, chunk_rows, 0, 0)
    return rows.filter(is_home("frame", chunk_rows)).select(*keys, "frame", "speed", "smooth")


def motion_energy(signal: DataFrame, sigma: float = 2.0, keys: Sequence[str] = ("clip",),
                  chunk_rows: int = FRAME_CHUNK) -> DataFrame:
    """Smoothed speed divided by its maximum over the clip."""
    rows = _chunked_speed(signal, keys, sigma, chunk_rows, 0, 0).filter(
        is_home("frame", chunk_rows)).select(*keys, "chunk", "frame", "smooth")
    peaks = rows.groupBy(*keys).agg(F.max("smooth").alias("peak"), F.max("chunk").alias("_to"))
    per_chunk = peaks.select(*keys, "peak",
                             F.explode(F.sequence(F.lit(0).cast("long"), "_to")).alias("chunk"))
    energy = F.when(F.col("peak") > 0, F.col("smooth") / F.col("peak")).otherwise(F.col("smooth"))
    return rows.join(per_chunk, [*keys, "chunk"]).select(*keys, "frame", energy.alias("energy"))


def packed_speed(signal: DataFrame, keys: Sequence[str], sigma: float, size: int, before: Column, after: Column) -> DataFrame:
    """Smoothed speed of whole chunks: keys, chunk, fps, ``first`` (frame of the first value) and ``smooth`` (array).

    A row holds at most ``size`` frames and their halo. Speed and smoothing are one array computation per
    chunk; the result is written, so that the quantile and the marking of segments read it and do not work it
    out again. Values within the kernel radius of a halo edge are not used. A frame of a missing position has
    speed 0 to both sides.
    """
    keys = list(keys)
    kernel = np.array(gaussian_kernel(sigma) if sigma > 0 else [1.0])
    r = len(kernel) // 2
    frames = F.array_sort(F.collect_list(F.struct("frame", "x", "y", "conf")))
    chunks = with_halo(signal, keys, "frame", size, before + F.lit(r + 1), after + F.lit(r)).groupBy(*keys, "chunk").agg(
        F.max("fps").alias("fps"), frames.alias("frames"))
    schema = StructType([*chunks.drop("frames").schema.fields, *StructType.fromDDL("first bigint, smooth array<double>").fields])

    def smooth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("frames")
            ends = rows.offsets.to_numpy().astype(np.int64)
            flat = rows.flatten()
            frame, x, y, conf = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("frame", "x", "y", "conf"))
            ends = ends - ends[0]
            speed = np.zeros(len(x))
            step = np.hypot(np.diff(x), np.diff(y))
            speed[1:] = np.where((np.minimum(conf[:-1], conf[1:]) > MIN_CONF) & ~np.isnan(step), step, 0.0)
            speed[ends[:-1]] = 0.0
            speed[frame == 0] = 0.0
            out = np.empty_like(speed)
            for a, b in zip(ends[:-1], ends[1:]):
                out[a:b] = np.convolve(speed[a:b], kernel)[r:r + b - a]
            arrays = [batch.column(c) for c in (*keys, "chunk", "fps")]
            yield pa.RecordBatch.from_arrays(
                [*arrays, pa.array(frame[ends[:-1]], pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(out))],
                names=[*keys, "chunk", "fps", "first", "smooth"])

    return checkpointed(chunks.mapInArrow(smooth, schema))


def _active_stretches(level: np.ndarray, threshold: float, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of values above the threshold, with pauses of at most ``gap`` inside."""
    on = np.flatnonzero(level > threshold)
    if not len(on):
        return on, on
    breaks = np.flatnonzero(np.diff(on) - 1 > gap)
    return on[np.concatenate(([0], breaks + 1))], on[np.concatenate((breaks, [len(on) - 1]))] + 1


def detect_segments(signal: DataFrame, keys: Sequence[str] = ("clip",), sigma: float = 3.0,
                    threshold: float = 0.15, min_ms: int = 150, max_ms: int = 4000,
                    gap_ms: int = 80, chunk_rows: int = FRAME_CHUNK) -> DataFrame:
    """Active stretches of a motion signal: keys, frames, start_ms, end_ms, score.

    A frame is active when smoothed speed over its 99th percentile exceeds the
    threshold. Stretches at most ``gap`` apart are one segment, and segments outside
    the length limits are dropped. A segment starts where no frame of the last
    ``gap + 1`` was active and can only be kept if it ends within ``max`` frames, so
    a halo of that width decides every segment inside its own chunk.
    """
    keys = list(keys)

    def frames_of(ms: int, least: int) -> Column:
        return F.greatest(F.lit(least), F.floor(F.lit(ms) * F.col("fps") / 1000)).cast("long")

    gap, longest = frames_of(gap_ms, 1), frames_of(max_ms, 2)
    chunks = packed_speed(signal.select(*keys, "fps", "frame", "x", "y", "conf"), keys, sigma, chunk_rows, gap + 1, longest + gap + 2)
    own = F.greatest(F.col("chunk") * chunk_rows - F.col("first"), F.lit(0)).cast("int") + 1
    home = chunks.select(*keys, "chunk", "fps", F.explode(F.slice("smooth", own, F.lit(chunk_rows))).alias("smooth"))
    p99 = exact_quantile(home, keys, "smooth", 0.99, "p99", ["fps"], chunk_rows).filter(F.col("p99") >= 1e-6)
    # One row per chunk, so that a long clip is not brought to one task.
    per_chunk = p99.select(*keys, "p99", F.explode(F.sequence(F.lit(0).cast("long"), chunk_of(F.col("n") - 1, chunk_rows))).alias("chunk"))
    marked = chunks.join(per_chunk, [*keys, "chunk"]).select(
        *keys, "chunk", "fps", "first", "smooth", "p99", gap.alias("gap"), frames_of(min_ms, 1).alias("least"), longest.alias("most"))
    fields = [f for f in marked.schema.fields if f.name in (*keys, "fps")]
    schema = StructType([*fields, *StructType.fromDDL("frame_start bigint, frame_end bigint, mean double").fields])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, starts, ends, means = [], [], [], []
            columns = {c: batch.column(c).to_pylist() for c in ("chunk", "first", "p99", "gap", "least", "most")}
            smooth = batch.column("smooth")
            for i in range(batch.num_rows):
                level = smooth[i].values.to_numpy() / columns["p99"][i]
                s, e = _active_stretches(level, threshold, columns["gap"][i])
                mine = ((s + columns["first"][i]) // chunk_rows == columns["chunk"][i]) & (e - s >= columns["least"][i]) & (e - s <= columns["most"][i])
                for a, b in zip(s[mine], e[mine]):
                    at.append(i)
                    starts.append(int(a) + columns["first"][i])
                    ends.append(int(b) + columns["first"][i])
                    means.append(float(level[a:b].mean()))
            place = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(f.name).take(place) for f in fields], pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(means, pa.float64())],
                names=[*[f.name for f in fields], "frame_start", "frame_end", "mean"])

    return marked.mapInArrow(mark, schema).select(
        *keys, "fps", "frame_start", "frame_end", frame_to_ms("frame_start", "fps").alias("start_ms"),
        frame_to_ms("frame_end", "fps").alias("end_ms"), F.bround(F.least(F.lit(1.0), "mean"), 3).alias("score"))


# Frames per bucket of the range join: about ten seconds, so a bucket meets few segments.
JOIN_FRAMES = 256


def frames_of_segments(frames: DataFrame, segments: DataFrame, size: int = JOIN_FRAMES) -> DataFrame:
    """Frames inside ``[frame_start, frame_end)`` of each segment.

    The range condition becomes an equi join on ``(clip, chunk)``: a segment is
    copied once per chunk it touches, a frame is in exactly one chunk. ``rel`` is
    the frame number inside the segment.
    """
    cut = segments.withColumn("chunk", F.explode(F.sequence(
        chunk_of("frame_start", size), chunk_of(F.col("frame_end") - 1, size))))
    joined = frames.withColumn("chunk", chunk_of("frame", size)).join(cut, ["clip", "chunk"])
    inside = (F.col("frame") >= F.col("frame_start")) & (F.col("frame") < F.col("frame_end"))
    return joined.filter(inside).withColumn("rel", F.col("frame") - F.col("frame_start")).drop("chunk")


def detect_in_segments(signal: DataFrame, segments: DataFrame, clips: DataFrame,
                       **detection) -> DataFrame:
    """Detect signs inside each text segment; times and frames are those of the clip.

    ``signal`` has one row per clip, hand and frame; ``segments`` has segment_id,
    clip, start_ms, end_ms; ``clips`` has clip, fps, n_frames.
    """
    last = F.col("n_frames") - 1
    ranges = (
        segments.join(clips, "clip")
        .withColumn("frame_start", F.least(ms_to_frame("start_ms", "fps"), last))
        .withColumn("frame_end", F.least(ms_to_frame("end_ms", "fps"), last))
        .filter("frame_end > frame_start")
        .withColumnRenamed("start_ms", "seg_start_ms")
        .select("segment_id", "clip", "seg_start_ms", "n_frames", "frame_start", "frame_end")
    )
    inside = frames_of_segments(signal, ranges).select(
        "segment_id", "clip", "hand", "seg_start_ms", "n_frames", "fps",
        F.col("rel").alias("frame"), "x", "y", "conf")
    found = detect_segments(
        inside, ["segment_id", "clip", "seg_start_ms", "n_frames", "hand"], **detection)
    start = F.col("seg_start_ms") + F.col("start_ms")
    end = F.col("seg_start_ms") + F.col("end_ms")
    return found.select(
        F.format_string("%s_%08d_%s", F.col("clip").cast("string"), start,
                        F.substring("hand", 1, 1)).alias("pairing_id"),
        "segment_id", "clip", "hand", start.alias("sign_start_ms"), end.alias("sign_end_ms"),
        F.least(ms_to_frame(start, "fps"), last).alias("sign_frame_start"),
        F.least(ms_to_frame(end, "fps"), last).alias("sign_frame_end"),
        F.col("score").alias("motion_confidence"), F.lit("pending").alias("status"), "fps")
