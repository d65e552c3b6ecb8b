"""Augmented variants of pose clips.

All draws come from a hash of (seed, clip, variant, name), so a variant is the same
however the data is partitioned or recomputed. Parameters are one small row per
(clip, variant); the steps are projections over frames joined with them. Only the
speed change needs a neighbour frame and only mixup reads a second clip.

Frames: clip, variant, frame, pts, t (frames of the clip) and the parameter columns.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tierloom.fixed_values import HAND_BLOCKS
from tierloom.functions.chunks import POSE_CHUNK, is_home, join_per_chunk, let, rank_in_groups, shuffle_parts, with_halo
from tierloom.functions.draws import bucket, fraction, hashed

STEPS = ("crop", "speed", "noise", "scale", "mirror", "rotation", "dropout", "time_mask", "mixup")
BETA = 0.3
#: Intervals of the table of quantiles, an even number; they cost less than 1e-3 anywhere.
BETA_STEPS = 512

# Combinations of steps in the augmentation search, with the variants per clip.
BASIC = ("crop", "speed", "noise", "scale")
ALL_STEPS = (*BASIC, "mirror", "rotation", "dropout", "time_mask")


def _without(*steps: str) -> tuple[str, ...]:
    return tuple(s for s in ALL_STEPS if s not in steps)


SEARCH_GRID = {
    "baseline_original4": (BASIC, 10),
    "all8": (ALL_STEPS, 10),
    "original4_plus_mirror": ((*BASIC, "mirror"), 10),
    "original4_plus_rotation": ((*BASIC, "rotation"), 10),
    "original4_plus_mirror_rotation": ((*BASIC, "mirror", "rotation"), 10),
    "original4_plus_dropout_mask": ((*BASIC, "dropout", "time_mask"), 10),
    "new3_no_tmask": (_without("time_mask"), 10),
    "new3_no_dropout": (_without("dropout"), 10),
    "all_new_no_crop": (_without("crop"), 10),
    "all_new_no_speed": (_without("speed"), 10),
    "mirror_rotation_only": (("mirror", "rotation"), 10),
    "all8_20x": (ALL_STEPS, 20),
    "all8_5x": (ALL_STEPS, 5),
}


def uniform(name: str, seed: int = 42, *more: Column) -> Column:
    """Draw in [0, 1) for (clip, variant, name)."""
    return fraction(hashed(seed, name, F.col("clip"), F.col("variant"), *more))


def between(low: float, high: float, name: str, seed: int) -> Column:
    return F.lit(low) + F.lit(high - low) * uniform(name, seed)


def whole(n: Column, name: str, seed: int, *more: Column) -> Column:
    """Draw in 0..n-1."""
    return F.least(F.floor(uniform(name, seed, *more) * n), n - 1).cast("long")


def beta_quantiles(a: float = BETA, steps: int = BETA_STEPS) -> list[float]:
    """Quantiles of Beta(a, a) at 0, 1/steps ... 1.

    With x = s^(1/a) the density near zero becomes smooth, so its integral up to one half is summed by
    Simpson's rule; the upper half mirrors the lower one.
    """
    grid = np.linspace(0.0, 0.5 ** a, 40_001)
    density = (1 - grid ** (1 / a)) ** (a - 1)
    pieces = (density[:-2:2] + 4 * density[1:-1:2] + density[2::2]) / 6
    mass = np.concatenate(([0.0], np.cumsum(pieces)))
    lower = np.interp(np.linspace(0, 0.5, steps // 2 + 1), mass / (2 * mass[-1]), grid[::2] ** (1 / a))
    return [float(x) for x in np.concatenate((lower, 1 - lower[-2::-1]))]


def _beta(seed: int) -> Column:
    """Beta(a, a) draw: the quantile of one uniform draw, interpolated between the entries of a table."""
    table = F.lit(beta_quantiles())
    at = uniform("beta", seed) * BETA_STEPS
    low = F.floor(at).cast("int")
    return F.get(table, low) + (F.get(table, low + 1) - F.get(table, low)) * (at - low)


def parameters(clips: DataFrame, n_variants: int, n_landmarks: int, steps: Sequence[str] = STEPS[:-1],
               seed: int = 42) -> DataFrame:
    """One row per clip and variant. Variant 0 is the clip itself; a null parameter skips its step.

    ``clips``: clip, t and, for mixup, label.
    """
    rows = clips.withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(n_variants - 1))))
    rows = _drawn(rows, n_landmarks, {s: F.lit(s in steps) for s in STEPS}, seed)
    if "mixup" in steps:
        chosen = (F.col("variant") > 0) & (uniform("mixup_chance", seed) < 0.3)
        rows = _partners(rows, clips, F.when(chosen, F.greatest(F.lit(0.5), _beta(seed))), seed)
    return rows


def _drawn(rows: DataFrame, n_landmarks: int, wanted: Mapping[str, Column], seed: int) -> DataFrame:
    """Parameters of all steps but mixup for rows (clip, t, variant); ``wanted`` tells which steps a row takes."""
    changed = F.col("variant") > 0

    def on(step: str, value: Column, chance: float = 1.0) -> Column:
        drawn = changed & wanted[step]
        if chance < 1:
            drawn = drawn & (uniform(f"{step}_chance", seed) < chance)
        return F.when(drawn, value)

    t = F.col("t")
    rows = rows.withColumn("crop_len", on("crop", F.least(t, F.greatest(
        F.lit(5), F.floor(t * between(0.75, 1.0, "crop", seed))))).cast("long"))
    rows = rows.withColumn("crop_start", on("crop", whole(
        F.greatest(F.lit(1), t - F.col("crop_len")), "crop_start", seed)))
    cut = F.coalesce("crop_len", t)
    rows = rows.withColumn("new_t", on("speed", F.greatest(F.lit(5), F.floor(
        cut / between(0.8, 1.2, "speed", seed)))).cast("long"))
    rows = (rows.withColumn("noise_std", on("noise", between(0.001, 0.005, "noise", seed)))
            .withColumn("scale", on("scale", between(0.9, 1.1, "scale", seed)))
            .withColumn("mirror", on("mirror", F.lit(True), 0.5))
            .withColumn("angle", on("rotation", between(-0.26, 0.26, "rotation", seed))))
    dropped = F.greatest(F.lit(1), F.floor(F.lit(n_landmarks) * between(0.05, 0.15, "drop_ratio", seed))).cast("int")
    ranked = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(n_landmarks - 1)), lambda i: F.struct(
        uniform("drop", seed, i).alias("u"), i.alias("i"))))
    rows = rows.withColumn("drop", on("dropout", F.transform(F.slice(ranked, F.lit(1), dropped), lambda p: p["i"]), 0.3))
    length = F.coalesce("new_t", cut)
    longest = F.least(F.lit(6), F.greatest(F.lit(3), F.floor(length / 5)))

    def span(i: Column) -> Column:
        n = whole(longest - 2, "span_len", seed, i) + 2
        start = whole(F.greatest(F.lit(1), length - n), "span_start", seed, i)
        return F.struct(start.alias("s"), (start + n).alias("e"))

    count = (whole(F.lit(3), "spans", seed) + 1).cast("int")
    return rows.withColumn("spans", on("time_mask", F.transform(F.sequence(F.lit(1), count), span), 0.3))


def _partners(rows: DataFrame, clips: DataFrame, weight: Column, seed: int) -> DataFrame:
    """Another clip of the same label: clips of a label are numbered and a drawn step leads from
    one number to another, so no pairs of clips are listed."""
    numbered = rank_in_groups(clips.select("clip", "label"), ["label"], bucket(hashed(seed, F.col("clip"))),
                              [hashed(seed, F.col("clip")), F.col("clip")], "_no", "_m")
    own = numbered.select("clip", "_no", "_m")
    step = whole(F.greatest(F.col("_m") - 1, F.lit(1)), "partner", seed) + 1
    rows = rows.withColumn("_w", weight).join(own, "clip").withColumn(
        "_to", F.when(F.col("_m") > 1, (F.col("_no") + step) % F.col("_m")))
    other = numbered.select("label", F.col("_no").alias("_to"), F.col("clip").alias("other"))
    return rows.join(other, ["label", "_to"], "left").withColumn(
        "weight", F.when(F.col("other").isNotNull(), F.col("_w"))).drop("_to", "_no", "_m", "_w")


def with_parameters(pose: DataFrame, params: DataFrame) -> DataFrame:
    """Frames of every variant with its parameters."""
    return join_per_chunk(pose, params.withColumn("_last", F.col("t") - 1), ["clip"], "_last", POSE_CHUNK)


def _points(fn) -> Column:
    return F.transform("pts", fn)


def _point(p: Column, **axes: Column) -> Column:
    return F.struct(*[axes.get(a, p[a]).alias(a) for a in "xyzc"])


def crop(frames: DataFrame) -> DataFrame:
    start = F.coalesce("crop_start", F.lit(0).cast("long"))
    length = F.coalesce("crop_len", F.col("t"))
    return (frames.filter((F.col("frame") >= start) & (F.col("frame") < start + length))
            .withColumn("frame", F.col("frame") - start).withColumn("t", F.least(length, F.col("t"))))


def change_speed(frames: DataFrame, chunk_rows: int = POSE_CHUNK) -> DataFrame:
    """Resample to ``new_t`` frames by linear interpolation between neighbours.

    Each frame works out which new frames start from it; with the frame after it (halo of
    one) they are a projection.
    """
    w = Window.partitionBy("clip", "variant", "chunk").orderBy("frame")
    rows = with_halo(frames, ["clip", "variant"], "frame", chunk_rows, 0, 1, parts=shuffle_parts(frames)).withColumn(
        "_next", F.lead("pts").over(w)).filter(is_home("frame", chunk_rows)).drop("chunk")
    n, t, f = F.coalesce("new_t", F.col("t")), F.col("t"), F.col("frame")
    ratio = F.when(t > 1, (n - 1) / F.greatest(t - 1, F.lit(1)))
    last = F.greatest(t - 2, F.lit(0).cast("long"))
    low = F.greatest(F.floor(f * ratio) - 1, F.lit(0)).cast("long")
    high = F.when(f == last, n - 1).otherwise(F.least(F.ceil((f + 1) * ratio) + 1, n - 1)).cast("long")
    # A clip of one frame repeats it.
    news = F.when(t == 1, F.sequence(F.lit(0).cast("long"), n - 1)).when(low <= high, F.sequence(low, high))
    at = F.when(n > 1, F.col("_j") * (t - 1) / F.greatest(n - 1, F.lit(1))).otherwise(F.lit(0.0))
    base = F.least(F.floor(at), last)
    moved = (rows.filter(n != t).withColumn("_j", F.explode(news)).withColumn("_at", at)
             .filter(F.when(t == 1, True).otherwise(base == f)).withColumn("_frac", F.col("_at") - f))
    blend = F.zip_with("pts", F.coalesce("_next", "pts"), lambda a, b: F.struct(
        *[(a[x] * (1 - F.col("_frac")) + b[x] * F.col("_frac")).alias(x) for x in "xyz"], a["c"].alias("c")))
    moved = moved.withColumn("pts", blend).withColumn("frame", F.col("_j")).withColumn("t", n)
    same = rows.filter(n == t)
    return same.select(*frames.columns).unionByName(moved.select(*frames.columns))


def add_noise(frames: DataFrame, seed: int = 42) -> DataFrame:
    """Normal noise per coordinate; one hash per landmark gives the two draws of each of its three coordinates."""
    def normal(digest: Column, place: int) -> Column:
        u = fraction(digest, 1 + 10 * place, 5) + F.lit(0.5 / 16 ** 5)
        return F.sqrt(-2 * F.log(u)) * F.cos(F.lit(2 * math.pi) * fraction(digest, 6 + 10 * place, 5))

    def moved(p: Column, i: Column) -> Column:
        digest = hashed(seed, "noise", F.col("clip"), F.col("variant"), F.col("frame"), i)
        return let(digest, lambda d: _point(p, **{a: p[a] + normal(d, k) * F.col("noise_std") for k, a in enumerate("xyz")}))

    return frames.withColumn("pts", F.when(F.col("noise_std").isNotNull(), F.transform("pts", moved)).otherwise(F.col("pts")))


def rescale(frames: DataFrame) -> DataFrame:
    k = F.coalesce("scale", F.lit(1.0))
    return frames.withColumn("pts", _points(lambda p: _point(p, **{a: p[a] * k for a in "xyz"})))


def mirror_hands(frames: DataFrame, n_landmarks: int = 96) -> DataFrame:
    """Swap the hand blocks of the layout and turn x round."""
    (left, size), (right, _) = HAND_BLOCKS[n_landmarks]
    source = list(range(n_landmarks))
    source[left:left + size], source[right:right + size] = (
        list(range(right, right + size)), list(range(left, left + size)))
    swapped = F.array(*[F.get("pts", F.lit(i)) for i in source])
    turned = F.transform(swapped, lambda p: _point(p, x=-p["x"]))
    return frames.withColumn("pts", F.when(F.coalesce("mirror", F.lit(False)), turned).otherwise(F.col("pts")))


def rotate(frames: DataFrame) -> DataFrame:
    """Rotation round the vertical axis by ``angle``."""
    cos, sin = (fn(F.coalesce("angle", F.lit(0.0))) for fn in (F.cos, F.sin))
    return frames.withColumn("_cos", cos).withColumn("_sin", sin).withColumn("pts", _points(lambda p: _point(
        p, x=p["x"] * F.col("_cos") - p["z"] * F.col("_sin"), z=p["x"] * F.col("_sin") + p["z"] * F.col("_cos")))).drop("_cos", "_sin")


def _zero(p: Column) -> Column:
    return _point(p, x=F.lit(0.0), y=F.lit(0.0), z=F.lit(0.0))


def drop_landmarks(frames: DataFrame) -> DataFrame:
    gone = F.coalesce("drop", F.expr("array()").cast("array<int>"))
    return frames.withColumn("pts", _points(lambda p, i: F.when(F.array_contains(gone, i), _zero(p)).otherwise(p)))


def mask_spans(frames: DataFrame) -> DataFrame:
    hit = F.coalesce(F.exists("spans", lambda s: (F.col("frame") >= s["s"]) & (F.col("frame") < s["e"])), F.lit(False))
    return frames.withColumn("pts", F.when(hit, _points(_zero)).otherwise(F.col("pts")))


def mixup(frames: DataFrame, originals: DataFrame) -> DataFrame:
    """Blend with the same frame of the partner clip over the common length."""
    other = originals.select(F.col("clip").alias("other"), "frame", F.col("pts").alias("_o"))
    k = F.col("weight")
    blend = F.zip_with("pts", "_o", lambda a, b: F.struct(
        *[(k * a[x] + (1 - k) * b[x]).alias(x) for x in "xyz"], a["c"].alias("c")))
    mixed = frames.filter(k.isNotNull()).join(other, ["other", "frame"], "left").withColumn(
        "pts", F.when(F.col("_o").isNotNull(), blend).otherwise(F.col("pts")))
    return frames.filter(k.isNull()).unionByName(mixed.select(*frames.columns))


def augment(pose: DataFrame, params: DataFrame, n_landmarks: int = 96, seed: int = 42) -> DataFrame:
    """All steps in order: clip, variant, frame, pts."""
    frames = with_parameters(pose.select("clip", "frame", "pts"), params)
    frames = add_noise(change_speed(crop(frames)), seed)
    frames = mask_spans(drop_landmarks(rotate(mirror_hands(rescale(frames), n_landmarks))))
    if "weight" in params.columns:
        frames = mixup(frames, pose)
    return frames.select("clip", "variant", "frame", "pts")


def search_parameters(clips: DataFrame, n_landmarks: int, grid=None, seed: int = 42) -> DataFrame:
    """Parameters of every combination of steps; ``combo`` names it and is part of the result key.

    Combinations and variants of a clip come from one explode, so clips are read once; which steps a row takes
    is a column.
    """
    combos = F.array(*[F.struct(F.lit(name).alias("combo"), F.lit(n).alias("n"), F.struct(*[F.lit(s in steps).alias(s) for s in STEPS]).alias("takes"))
                       for name, (steps, n) in (grid or SEARCH_GRID).items()])
    rows = clips.withColumn("_g", F.explode(combos)).withColumn("variant", F.explode(F.sequence(F.lit(0), F.col("_g.n") - 1)))
    rows = _drawn(rows, n_landmarks, {s: F.col(f"_g.takes.{s}") for s in STEPS}, seed)
    return rows.withColumn("combo", F.col("_g.combo")).drop("_g")
