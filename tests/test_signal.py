"""Signal operators against plain numpy, with chunks much smaller than a clip."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tierloom.functions.chunks import exact_quantile, rank_in_groups
from tierloom.operators import signal as S

SIZES = [1, 5, 30, 120, 400]


def make_clip(n, seed):
    rng = np.random.default_rng(seed)
    still = np.repeat(rng.random((n // 12 + 1, 2)), 12, axis=0)[:n]
    moving = np.repeat(rng.random(n // 9 + 1) > 0.5, 9)[:n]
    pos = still + np.cumsum(rng.normal(0, 0.05, (n, 2)) * moving[:, None], axis=0)
    conf = np.where(rng.random(n) < 0.1, 0.2, rng.uniform(0.25, 1, n))
    return pos, conf


def speed_of(pos, conf):
    out = np.zeros(len(pos))
    if len(pos) > 1:
        step = np.linalg.norm(np.diff(pos, axis=0), axis=1)
        out[1:] = step * (np.minimum(conf[:-1], conf[1:]) > 0.2)
    return out


def smooth_of(x, sigma):
    kernel = np.array(S.gaussian_kernel(sigma))
    r = len(kernel) // 2
    padded = np.concatenate([np.zeros(r), x, np.zeros(r)])
    return np.array([padded[i:i + 2 * r + 1] @ kernel for i in range(len(x))])


def segments_of(pos, conf, fps, sigma=3.0, threshold=0.15):
    v = smooth_of(speed_of(pos, conf), sigma)
    p99 = np.percentile(v, 99)
    if p99 < 1e-6:
        return []
    level = v / p99
    low, high, gap = max(1, int(150 * fps / 1000)), max(2, int(4000 * fps / 1000)), max(1, int(80 * fps / 1000))
    runs = []
    for i in np.flatnonzero(level > threshold):
        if runs and i - runs[-1][1] <= gap:
            runs[-1][1] = i + 1
        else:
            runs.append([i, i + 1])
    return [(s, e, int(s * 1000 / fps), int(e * 1000 / fps), round(min(1.0, level[s:e].mean()), 3))
            for s, e in runs if low <= e - s <= high]


@pytest.fixture(scope="module")
def clips():
    made = {f"c{n}": make_clip(n, n) for n in SIZES}
    made["zero"] = (np.zeros((20, 2)), np.ones(20))
    made["edge"] = (np.arange(80).reshape(40, 2) * 1.0, np.full(40, 0.2))
    return made


@pytest.fixture(scope="module")
def table(spark, clips):
    rows = [(c, i, float(p[0]), float(p[1]), float(w), 25.0) for c, (pos, conf) in clips.items()
            for i, (p, w) in enumerate(zip(pos, conf))]
    return spark.createDataFrame(rows, "clip string, frame bigint, x double, y double, conf double, fps double").cache()


def by_clip(df, value):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["clip"], r["frame"])):
        out.setdefault(r["clip"], []).append(r[value])
    return out


def test_speed(table, clips):
    got = by_clip(S.wrist_speed(table, chunk_rows=7), "speed")
    for c, (pos, conf) in clips.items():
        np.testing.assert_allclose(got[c], speed_of(pos, conf), atol=1e-12)


@pytest.mark.parametrize("sigma", [1.0, 3.0])
def test_smoothing_and_energy(table, clips, sigma):
    got = by_clip(S.smoothed_speed(table, sigma, chunk_rows=11), "smooth")
    energy = by_clip(S.motion_energy(table, sigma, chunk_rows=11), "energy")
    for c, (pos, conf) in clips.items():
        want = smooth_of(speed_of(pos, conf), sigma)
        np.testing.assert_allclose(got[c], want, atol=1e-12)
        np.testing.assert_allclose(energy[c], want / want.max() if want.max() > 0 else want, atol=1e-12)


@pytest.mark.parametrize("chunk_rows", [16, 4096])
@pytest.mark.parametrize("sigma,threshold", [(3.0, 0.15), (1.0, 0.5)])
def test_segments(table, clips, chunk_rows, sigma, threshold):
    found = S.detect_segments(table, sigma=sigma, threshold=threshold, chunk_rows=chunk_rows).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r["clip"], r["frame_start"])):
        got.setdefault(r["clip"], []).append((r["frame_start"], r["frame_end"], r["start_ms"], r["end_ms"], r["score"]))
    for c, (pos, conf) in clips.items():
        want = segments_of(pos, conf, 25.0, sigma, threshold)
        assert [g[:4] for g in got.get(c, [])] == [w[:4] for w in want]
        np.testing.assert_allclose([g[4] for g in got.get(c, [])], [w[4] for w in want], atol=1.1e-3)
    assert any(len(v) > 1 for v in got.values())


def test_empty_signal(table):
    assert S.detect_segments(table.filter("false")).count() == 0


def test_kernel_is_wide_enough():
    for sigma in (0.1, 1.0, 2.0, 3.0):
        k = S.gaussian_kernel(sigma)
        assert len(k) == 2 * max(1, int(3 * sigma + 0.5)) + 1
        assert abs(sum(k) - 1) < 1e-12


@pytest.mark.parametrize("q", [0.0, 0.5, 0.99, 1.0])
def test_exact_quantile(spark, q):
    rng = np.random.default_rng(3)
    groups = {"a": rng.random(500), "b": np.zeros(10), "c": np.array([2.0]), "d": np.repeat([0.0, 1.0, 1.0, 8.0], 25)}
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs], "g string, v double")
    for r in exact_quantile(df, ["g"], "v", q).collect():
        assert r["n"] == len(groups[r["g"]])
        assert abs(r["quantile"] - np.percentile(groups[r["g"]], q * 100)) < 1e-12


def test_rank_in_groups(spark):
    rows = [(g, i * 37 % 101) for g in "ab" for i in range(101)]
    df = spark.createDataFrame(rows, "g string, v int")
    got = rank_in_groups(df, ["g"], F.floor(F.col("v") / 10), [F.col("v")]).collect()
    assert all(r["pos"] == r["v"] for r in got) and len(got) == 202


def test_detection_inside_segments_uses_clip_times(spark, clips):
    pos, conf = clips["c400"]
    rows = [("c", h, i, float(p[0]), float(p[1]), float(w), 25.0) for h in ("left", "right")
            for i, (p, w) in enumerate(zip(pos, conf))]
    signal = spark.createDataFrame(rows, "clip string, hand string, frame bigint, x double, y double, conf double, fps double")
    segs = spark.createDataFrame([("s1", "c", 1000, 9000), ("s2", "c", 7000, 99999), ("s3", "c", 50, 60)],
                                 "segment_id string, clip string, start_ms bigint, end_ms bigint")
    info = spark.createDataFrame([("c", 25.0, 400)], "clip string, fps double, n_frames bigint")
    got = S.detect_in_segments(signal, segs, info, sigma=1.0, threshold=0.4, chunk_rows=32).collect()
    for sid, a, b in (("s1", 25, 225), ("s2", 175, 399)):
        want = segments_of(pos[a:b], conf[a:b], 25.0, 1.0, 0.4)
        for hand in ("left", "right"):
            rows = sorted(r["sign_start_ms"] for r in got if r["segment_id"] == sid and r["hand"] == hand)
            assert rows == [a * 40 + w[2] for w in want]
    assert not [r for r in got if r["segment_id"] == "s3"]
    assert all(r["pairing_id"] == f"c_{r['sign_start_ms']:08d}_{r['hand'][0]}" for r in got)


def test_normalisation_far_from_zero(spark):
    from tierloom.operators import landmarks as L

    rng = np.random.default_rng(4)
    pose = rng.normal(0, 0.3, (50, 4, 3))
    pose[5, 2, 1] = np.nan
    for offset in (0.0, 1e8):
        moved = pose + offset
        rows = [(1, t, [(float(p[0]), float(p[1]), float(p[2]), 1.0) for p in moved[t]]) for t in range(50)]
        df = spark.createDataFrame(rows, "clip bigint, frame bigint, pts array<struct<x:double,y:double,z:double,c:double>>")
        shifted = moved - np.nanmean(moved[:, :1], axis=0)
        want = shifted / np.nanstd(shifted)
        got = {r["frame"]: np.array([p[:3] for p in r["pts"]]) for r in L.normalise_by_nose(df).collect()}
        assert all(np.allclose(got[t], want[t], rtol=1e-6, atol=1e-6, equal_nan=True) for t in range(50))


def test_poses_are_written_once_and_variants_spread(spark):
    from tierloom.operators import augment as A
    from tierloom.plans.registry import QUERIES

    made = QUERIES["c30_augmented_variants"](spark, "/root/testdata/sf0.001")
    assert "parquet" not in made._jdf.queryExecution().toString()
    frames = spark.range(2000).select(
        (F.col("id") % 2).alias("clip"), F.floor(F.col("id") / 2).alias("frame"), F.lit(1).alias("variant"), F.lit(1000).cast("long").alias("t"),
        F.lit(1000).cast("long").alias("new_t"), F.array(F.struct(*[F.col("id").cast("double").alias(a) for a in "xyzc"])).alias("pts"))
    same = A.change_speed(frames)
    assert same.rdd.getNumPartitions() == 4  # not merged for being small
    sizes = same.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(sizes) == 2000 and max(sizes) < 1500  # two clips are eight chunks
