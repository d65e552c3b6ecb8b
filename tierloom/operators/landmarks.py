"""Landmark features of pose frames.

A pose table has one row per ``(clip, frame)`` with ``pts``, an array of
``struct<x, y, z, c>``. Keeping a frame in one row makes presets, bones and
coordinate choices narrow projections; only velocity needs a neighbour frame and
only normalisation needs clip totals.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tierloom.fixed_values import BONES, MODE_WIDTH, N_LANDMARKS, PRESETS
from tierloom.functions.chunks import FRAME_CHUNK, is_home, join_per_chunk, with_halo
from tierloom.functions.draws import hashed
from tierloom.session import checkpointed

MAX_FRAMES = 300
ZERO = "named_struct('x', 0.0D, 'y', 0.0D, 'z', 0.0D, 'c', 0.0D)"


def select_landmarks(pose: DataFrame, preset: str | Sequence[int] | None = "compact") -> DataFrame:
    """Keep the landmarks of a preset, in preset order; ``None`` keeps all.

    Plain array items, not a lambda: a lambda that reads ``pts`` would be merged with
    the expression that builds it and evaluate that once per landmark.
    """
    if preset is None:
        return pose
    wanted = PRESETS[preset] if isinstance(preset, str) else list(preset)
    return pose.withColumn("pts", F.array(*[F.get("pts", F.lit(i)) for i in wanted]))


def preset_for_width(width: Column) -> Column:
    """Preset whose feature width (any mode) is ``width``, else null."""
    result = F.lit(None).cast("string")
    for preset, points in PRESETS.items():
        widths = sorted({len(points) * m for m in MODE_WIDTH.values()})
        result = F.when(width.isin(widths), preset).otherwise(result)
    return result


def dominant_width(clips: DataFrame, width: str) -> DataFrame:
    """The most frequent width (smallest on ties)."""
    counts = clips.groupBy(width).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), width).limit(1)


def _in_extended_layout() -> Column:
    place = {lm: i for i, lm in enumerate(PRESETS["compact"])}
    source = [place.get(lm, -1) for lm in PRESETS["extended"]]
    return F.transform(F.lit(source),
                       lambda i: F.when(i >= 0, F.get("pts", i)).otherwise(F.expr(ZERO)))


def pad_to_extended(pose: DataFrame) -> DataFrame:
    """Compact frames in extended layout, unmapped landmarks zero; other sizes stay as they are."""
    compact = F.size("pts") == len(PRESETS["compact"])
    return pose.withColumn("pts", F.when(compact, _in_extended_layout()).otherwise(F.col("pts")))


def nose_frame(pose: DataFrame, keys: Sequence[str] = ("clip",)) -> DataFrame:
    """Per clip the mean position of landmark 0 (``mx``, ``my``, ``mz``), the spread and the last frame.

    The spread is the population deviation of all coordinates about the nose. Every axis is summed up as count,
    mean and squared deviations, which merge without loss however far the clip is from zero; the three axes
    are merged at the end. Missing coordinates (null or NaN) do not count; a clip without any nose uses 0.5, and
    a spread of nearly nothing counts as 1.
    """
    points = pose.select(*keys, "frame", F.posexplode("pts").alias("_lm", "_p"))
    parts = [F.max("frame").alias("_last")]
    for axis in "xyz":
        value = F.when(~F.isnan(f"_p.{axis}"), F.col(f"_p.{axis}").cast("double"))
        parts += [F.avg(F.when(F.col("_lm") == 0, value)).alias(f"m{axis}"), F.count(value).alias(f"n{axis}"),
                  F.avg(value).alias(f"a{axis}"), F.var_pop(value).alias(f"v{axis}")]
    total = points.groupBy(*keys).agg(*parts)
    total = total.select(*keys, "_last", *[F.coalesce(f"m{a}", F.lit(0.5)).alias(f"m{a}") for a in "xyz"],
                         *[F.coalesce(f"{c}{a}", F.lit(0)).alias(f"{c}{a}") for c in "nav" for a in "xyz"])

    def weighed(value: Callable[[str], Column]) -> Column:
        return sum((F.col(f"n{a}") * value(a) for a in "xyz"), F.lit(0.0)) / (F.col("nx") + F.col("ny") + F.col("nz"))

    total = total.withColumn("_mean", weighed(lambda a: F.col(f"a{a}") - F.col(f"m{a}")))
    spread = F.sqrt(weighed(lambda a: F.col(f"v{a}") + F.pow(F.col(f"a{a}") - F.col(f"m{a}") - F.col("_mean"), 2)))
    return total.select(*keys, "mx", "my", "mz", "_last", F.when(spread > 1e-6, spread).otherwise(F.lit(1.0)).alias("_spread"))


def normalise_by_nose(pose: DataFrame, keys: Sequence[str] = ("clip",)) -> DataFrame:
    """Subtract the mean position of landmark 0 over the clip, divide by the spread (see ``nose_frame``).

    The chosen landmarks are written once and read for the totals and for the shift. Frames meet the totals by
    chunk.
    """
    kept = checkpointed(pose)
    shifted = F.transform("pts", lambda p: F.struct(
        *[((p[a] - F.col(f"m{a}")) / F.col("_spread")).alias(a) for a in "xyz"], p["c"].alias("c")))
    return (join_per_chunk(kept, nose_frame(kept, keys), keys, "_last").withColumn("pts", shifted)
            .drop("mx", "my", "mz", "_spread"))


def _later(rows: DataFrame, column: str, keys: Sequence[str], by: Sequence[int],
           chunk_rows: int) -> DataFrame:
    """Attach ``column`` of later frames; a halo of a few frames crosses chunk borders."""
    w = Window.partitionBy(*keys, "chunk").orderBy("frame")
    out = with_halo(rows, keys, "frame", chunk_rows, 0, max(by))
    for k in by:
        out = out.withColumn(f"{column}_{k}", F.lead(column, k).over(w))
    return out.filter(is_home("frame", chunk_rows)).drop("chunk")


def velocity(pose: DataFrame, axes: str = "xyz", keys: Sequence[str] = ("clip",),
             chunk_rows: int = FRAME_CHUNK) -> DataFrame:
    """``features``: per landmark the position, the one-frame and the two-frame displacement.

    Displacements past the end of the clip are zero.
    """
    def part(p: Column) -> Column:
        return F.struct(*[p[a].alias(a) for a in axes])

    rows = pose.withColumn("pts", F.transform("pts", part))
    rows = _later(rows, "pts", keys, (1, 2), chunk_rows)

    def landmark(p: Column, i: Column) -> Column:
        moves = [F.coalesce(F.get(f"pts_{k}", i)[a] - p[a], F.lit(0.0)) for k in (1, 2) for a in axes]
        return F.array(*[p[a] for a in axes], *moves)

    return rows.withColumn("features", F.flatten(F.transform("pts", landmark))).drop(
        "pts", "pts_1", "pts_2")


def feature_mode(pose: DataFrame, mode: str, keys: Sequence[str] = ("clip",),
                 chunk_rows: int = FRAME_CHUNK) -> DataFrame:
    """One flat feature array per frame."""
    if mode in ("raw", "xy_only", "normalize"):
        rows = normalise_by_nose(pose, keys) if mode == "normalize" else pose
        axes = "xy" if mode == "xy_only" else "xyz"
        flat = F.flatten(F.transform("pts", lambda p: F.array(*[p[a] for a in axes])))
        return rows.withColumn("features", flat).drop("pts")
    if mode == "velocity":
        return velocity(pose, "xyz", keys, chunk_rows)
    if mode == "xy_velocity":
        return velocity(pose, "xy", keys, chunk_rows)
    if mode == "norm_xy_velocity":
        return velocity(normalise_by_nose(pose, keys), "xy", keys, chunk_rows)
    raise ValueError(f"unknown feature mode {mode!r}")


def bones(points: Column | str = "pts") -> Column:
    """Child minus parent for every bone of the compact layout."""
    parents, children = ([pair[i] for pair in BONES] for i in (0, 1))

    def vector(parent: Column, child: Column) -> Column:
        a, b = F.get(points, parent), F.get(points, child)
        return F.struct(*[(b[axis] - a[axis]).alias(axis) for axis in "xyz"])

    return F.zip_with(F.lit(parents), F.lit(children), vector)


def four_streams(pose: DataFrame, keys: Sequence[str] = ("clip",),
                 chunk_rows: int = FRAME_CHUNK) -> DataFrame:
    """Joints, bones, joint motion and bone motion (x and y) of normalised compact frames."""
    rows = normalise_by_nose(pose, keys)

    def xy(column: Column) -> Column:
        return F.flatten(F.transform(column, lambda p: F.array(p["x"], p["y"])))

    rows = rows.withColumn("now", F.concat(xy(F.col("pts")), xy(bones()))).drop("pts")
    rows = _later(rows, "now", keys, (1,), chunk_rows)
    move = F.zip_with("now", F.coalesce("now_1", "now"), lambda a, b: b - a)
    return rows.withColumn("features", F.concat("now", move)).drop("now", "now_1")


def pad_or_truncate(features: DataFrame, length: int = MAX_FRAMES,
                    keys: Sequence[str] = ("clip",)) -> DataFrame:
    """Exactly ``length`` frames per clip with ``mask`` 1 for real ones.

    Real frames pass through; padding rows come from one summary row per clip.
    """
    real = features.filter(F.col("frame") < length).select(
        *keys, F.col("frame").cast("long").alias("frame"), "features", F.lit(1.0).alias("mask"))
    short = features.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.max(F.size("features")).alias("_w")).filter(F.col("_n") < length)
    padding = short.select(
        *keys, F.explode(F.sequence(F.col("_n"), F.lit(length - 1).cast("long"))).alias("frame"),
        F.array_repeat(F.lit(0.0), F.col("_w")).alias("features"), F.lit(0.0).alias("mask"))
    return real.unionByName(padding)


def sliding_windows(frames: DataFrame, length: int = MAX_FRAMES, stride: int = 150,
                    shortest: int = 10, keys: Sequence[str] = ("clip",)) -> DataFrame:
    """Windows of each clip: keys, ``start``, ``n_frames``; a tail past the last stride is left out."""
    sizes = frames.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= shortest)
    last = F.greatest(F.col("_n") - length, F.lit(0).cast("long"))
    return sizes.select(
        *keys, F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(stride).cast("long"))).alias("start"),
        F.least(F.col("_n"), F.lit(length)).alias("n_frames"))


def window_frames(frames: DataFrame, windows: DataFrame, length: int = MAX_FRAMES,
                  stride: int = 150, keys: Sequence[str] = ("clip",)) -> DataFrame:
    """Frames of each window: a frame computes the starts that can hold it, then an equi join."""
    first = F.greatest(F.ceil((F.col("frame") - length + 1) / stride), F.lit(0)).cast("long")
    last = F.floor(F.col("frame") / stride).cast("long")
    starts = F.transform(F.sequence(first, last), lambda k: k * stride)
    placed = frames.withColumn("start", F.explode(starts))
    return placed.join(windows, [*keys, "start"]).withColumn("rel", F.col("frame") - F.col("start"))


def mask_frames(windowed: DataFrame, ratio: float, seed: int = 42,
                keys: Sequence[str] = ("clip", "start")) -> DataFrame:
    """Zero ``max(1, int(n * ratio))`` frames per window, chosen by hash; windows of one frame stay.

    A window holds at most its fixed length of frames, so ranking inside it is bounded.
    """
    draw = hashed(seed, *[F.col(k) for k in keys], F.col("rel"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(draw, "rel"))
    wanted = F.greatest(F.lit(1), F.floor(F.col("n_frames") * ratio))
    masked = (rank <= wanted) & (F.col("n_frames") >= 2)
    return windowed.withColumn("masked", masked).withColumn(
        "features", F.when(F.col("masked"), F.transform("features", lambda v: F.abs(v * 0.0)))
        .otherwise(F.col("features")))


def mean_pool(features: DataFrame, keys: Sequence[str] = ("clip",)) -> DataFrame:
    """Mean feature vector over real frames; a clip without any gets zeros.

    The vector mean is a partial aggregate, so a long clip is summed where it lies.
    """
    vector = array_to_vector(F.col("features"))
    real = F.col("mask") if "mask" in features.columns else F.lit(1.0)
    pooled = features.groupBy(*keys).agg(
        Summarizer.mean(vector, real).alias("_mean"), F.sum(real).alias("_real"),
        F.max(F.size("features")).alias("_w"))
    return pooled.select(*keys, F.when(F.col("_real") > 0, vector_to_array("_mean")).otherwise(
        F.array_repeat(F.lit(0.0), F.col("_w"))).alias("vector"))


def visible_box(pose: DataFrame, keys: Sequence[str] = ("clip",)) -> DataFrame:
    """Padded box round the confident points of head, shoulders and hands."""
    points = list(range(13)) + list(range(33, 75))
    seen = F.filter(F.transform(F.lit(points), lambda i: F.get("pts", i)), lambda p: p["c"] >= 0.1)
    box = pose.groupBy(*keys).agg(*[
        fn(pick(F.transform(seen, lambda p: p[axis]))).alias(f"{axis}_{name}")
        for axis in "xy" for name, fn, pick in (("min", F.min, F.array_min), ("max", F.max, F.array_max))])
    for axis in "xy":
        lo, hi = F.col(f"{axis}_min") - 0.05, F.col(f"{axis}_max") + 0.05
        lo, hi = F.coalesce(lo, F.lit(0.0)), F.coalesce(hi, F.lit(1.0))
        middle, thin = (lo + hi) / 2, (hi - lo) < 0.1
        box = box.select(
            *[c for c in box.columns if not c.startswith(f"{axis}_")],
            F.when(thin, middle - 0.15).otherwise(lo).alias(f"{axis}_min"),
            F.when(thin, middle + 0.15).otherwise(hi).alias(f"{axis}_max"))
    return box


def as_rows(pose: DataFrame) -> DataFrame:
    """Long form: one row per landmark."""
    rest = [c for c in pose.columns if c != "pts"]
    return pose.select(*rest, F.posexplode("pts").alias("lm", "p")).select(*rest, "lm", "p.*")


def export_segments(pose: DataFrame, segments: DataFrame, preset: str | None = "compact") -> DataFrame:
    """Frames of each segment with the landmarks of a preset, stored as float."""
    from tierloom.operators.signal import frames_of_segments

    wide = select_landmarks(pose, preset).withColumn("pts", F.transform("pts", lambda p: F.struct(
        *[p[a].cast("float").alias(a) for a in "xyzc"])))
    return frames_of_segments(wide, segments)


def compaction_counts(clips: DataFrame, n_landmarks: str = "n_landmarks") -> DataFrame:
    """How many clips a compaction converts (full frames) and skips."""
    full = F.col(n_landmarks) == N_LANDMARKS
    return clips.agg(F.count_if(full).alias("converted"), F.count_if(~full).alias("skipped"))
