"""Cue folds, greedy pairing and clusters against sequential Python, with tiny chunks."""

import random

import pytest
from pyspark.sql import functions as F

from tierloom.functions import blocks as B
from tierloom.operators import cues as C
from tierloom.operators import matching as M


def similarity(a, b):
    if not a and not b:
        return 1.0
    if not a or not b:
        return 0.0
    return sum(x == y for x, y in zip(a, b)) / max(len(a), len(b))


def dedup(cues):
    out = []
    for s, e, t in sorted(cues, key=lambda c: c[0]):
        if out and s - out[-1][1] <= 2000 and similarity(out[-1][2], t) >= 0.85:
            out[-1] = (out[-1][0], max(out[-1][1], e), t if len(t) > len(out[-1][2]) else out[-1][2])
        else:
            out.append((s, e, t))
    return out


def short_merge(cues):
    """Repeat until stable: a short cue joins the next one, else the one before."""
    blocks, moved = [list(c) for c in cues], len(cues) > 1
    while moved:
        moved, i = False, 0
        while i < len(blocks):
            s, e, t = blocks[i]
            if e - s >= 1000 or len(blocks) == 1:
                i += 1
            elif i + 1 < len(blocks) and blocks[i + 1][0] - e <= 500:
                nxt = blocks.pop(i + 1)
                blocks[i] = [s, nxt[1], t + "\n" + nxt[2]]
                moved = True
            elif i > 0 and s - blocks[i - 1][1] <= 500:
                prev = blocks[i - 1]
                blocks[i - 1] = [prev[0], e, prev[2] + "\n" + t]
                blocks.pop(i)
                moved = True
            else:
                i += 1
    return [tuple(b) for b in blocks]


def recognised(frames, end, min_ms=500):
    out, cur, start = [], "", 0
    for ts, text in frames:
        if (cur or text) and similarity(cur, text) < 0.80:
            if cur and ts - start >= min_ms:
                out.append((start, ts, cur))
            cur, start = text, ts
    if cur and end - start >= min_ms:
        out.append((start, end, cur))
    return [c for c in out if c[2].strip()]


def random_cues(n, seed, overlap):
    rng = random.Random(seed)
    out, t = [], 0
    for _ in range(n):
        t += rng.choice([0, 100, 400, 900, 2600])
        length = rng.choice([100, 300, 700, 1200]) if not overlap else rng.choice([50, 300, 900, 1500, 4000])
        out.append((t, t + length, rng.choice(["abcdefghij", "abcdefghijk", "abcdefghiX", "zz", "", "hello"])))
        if not overlap:
            t += length
    return out


SETS = {f"v{n}_{o}": random_cues(n, n + o, bool(o)) for n in (1, 2, 3, 8, 40, 90) for o in (0, 1)}
SETS["one_short"] = [(0, 100, "a")]
SETS["gap_exact"] = [(0, 100, "a"), (600, 2000, "b")]
SETS["gap_over"] = [(0, 100, "a"), (601, 2000, "b")]
SETS["limit"] = [(0, 100, "abcdefghij"), (2100, 2200, "abcdefghij"), (4201, 4300, "abcdefghij")]


@pytest.fixture(scope="module")
def table(spark):
    rows = [(k, i, *c) for k, cs in SETS.items() for i, c in enumerate(cs)]
    return spark.createDataFrame(rows, "stem string, cue_no bigint, start_ms bigint, end_ms bigint, text string").cache()


def collect(df, key="cue_no"):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["stem"], r[key])):
        out.setdefault(r["stem"], []).append((r["start_ms"], r["end_ms"], r["text"]))
    return out


@pytest.mark.parametrize("chunk_rows", [3, 256])
def test_near_duplicates(table, chunk_rows):
    got = collect(C.merge_near_duplicates(table, chunk_rows=chunk_rows))
    for k, cs in SETS.items():
        assert got[k] == dedup(cs), k


@pytest.mark.parametrize("chunk_rows", [3, 256])
def test_short_merge(table, chunk_rows):
    got = collect(C.merge_short(table, chunk_rows=chunk_rows))
    for k, cs in SETS.items():
        assert sorted(got[k]) == sorted(short_merge(sorted(cs, key=lambda c: c[0]))), k


def test_near_duplicates_twice_changes_nothing(spark):
    apart = {"a": [(0, 500, "hello there"), (700, 1500, "hello thera"), (9000, 9500, "other")]}
    rows = [(k, i, *c) for k, cs in apart.items() for i, c in enumerate(cs)]
    df = spark.createDataFrame(rows, "stem string, cue_no bigint, start_ms bigint, end_ms bigint, text string")
    once = C.merge_near_duplicates(df)
    assert collect(once) == collect(C.merge_near_duplicates(once))


@pytest.mark.parametrize("chunk_rows", [4, 256])
def test_recognised_text(spark, chunk_rows):
    sets = {k: [(i * 200, c[2]) for i, c in enumerate(cs)] for k, cs in SETS.items()}
    df = spark.createDataFrame([(k, ts, t) for k, fs in sets.items() for ts, t in fs], "stem string, ts_ms bigint, text string")
    ends = spark.createDataFrame([(k, len(fs) * 200) for k, fs in sets.items()], "stem string, last_ms bigint")
    got = collect(C.cues_from_recognised_text(df, ends, chunk_rows=chunk_rows), "start_ms")
    for k, fs in sets.items():
        assert got.get(k, []) == recognised(fs, len(fs) * 200), k


def test_recognised_text_moves_only_chunk_ends(spark):
    rng = random.Random(8)
    sets = {f"t{n}": [(i * 90_000, rng.choice(["abcdefghij", "abcdefghiX", "zz", "", " ", "hello"])) for i in range(n)] for n in (1, 7, 40)}
    df = spark.createDataFrame([(k, ts, t) for k, fs in sets.items() for ts, t in fs], "stem string, ts_ms bigint, text string")
    ends = spark.createDataFrame([(k, len(fs) * 90_000) for k, fs in sets.items()], "stem string, last_ms bigint")
    made = C.cues_from_recognised_text(df, ends, chunk_rows=4)  # buckets of six or seven frames, chunks of up to four
    got = collect(made, "start_ms")
    for k, fs in sets.items():
        assert got.get(k, []) == recognised(fs, len(fs) * 90_000), k
    # Texts of inner cues come from the marked chunks as they lie: nothing groups all frames by cue again.
    assert "min_by" not in made._jdf.queryExecution().toString()


def test_anchored_windows(spark):
    rng = random.Random(5)
    starts = {f"s{n}": sorted(rng.randrange(0, 400 * n) * 10 for _ in range(n)) for n in (1, 2, 30, 77)}
    df = spark.createDataFrame([(k, i, s) for k, ss in starts.items() for i, s in enumerate(ss)], "stem string, item_no bigint, start_ms bigint")
    got = {(r["stem"], r["item_no"]): (r["group_start"], r["is_head"]) for r in C.anchored_windows(df).collect()}
    for k, ss in starts.items():
        head = None
        for i, s in enumerate(ss):
            first = head is None or s > head + 5000
            head = s if first else head
            assert got[(k, i)] == (head, first)


def counted(monkeypatch):
    calls = []
    for module in (B, C):
        real = module.checkpointed
        monkeypatch.setattr(module, "checkpointed", lambda df, real=real: (calls.append(1), real(df))[1])
    return calls


def test_anchored_windows_take_logarithmic_rounds(spark, monkeypatch):
    calls = counted(monkeypatch)
    n = 6000
    df = spark.range(n).select(F.lit("v").alias("stem"), F.col("id").alias("item_no"), (F.col("id") * 1000).alias("start_ms"))
    got = C.anchored_windows(df).collect()
    assert all(r["group_start"] == r["item_no"] // 6 * 6000 and r["is_head"] == (r["item_no"] % 6 == 0) for r in got) and len(got) == n
    # 1,000 groups: ten doublings of two tables each, and the points, pointers and ranges.
    assert len(calls) <= 2 * 11 + 5


def test_anchored_windows_with_equal_starts(spark):
    rows = [("v", i, 0) for i in range(50)] + [("v", 50 + i, 5001) for i in range(50)]
    got = C.anchored_windows(spark.createDataFrame(rows, "stem string, item_no bigint, start_ms bigint")).collect()
    assert sorted(r["item_no"] for r in got if r["is_head"]) == [0, 50]
    assert {r["group_start"] for r in got} == {0, 5001}


@pytest.mark.parametrize("chunk_ms", [3000, 20_000, 100_000])
def test_anchored_windows_over_many_chunks(spark, chunk_ms):
    rng = random.Random(9)
    starts = {f"s{n}": sorted({rng.randrange(0, 700 * n) + 60_000 * (rng.random() < 0.05) for _ in range(n)}) for n in (1, 3, 40, 400)}
    df = spark.createDataFrame([(k, i, s) for k, ss in starts.items() for i, s in enumerate(ss)], "stem string, item_no bigint, start_ms bigint")
    got = {(r["stem"], r["item_no"]): (r["group_start"], r["is_head"]) for r in C.anchored_windows(df, chunk_ms=chunk_ms).collect()}
    for k, ss in starts.items():
        head = None
        for i, s in enumerate(ss):
            first = head is None or s > head + 5000
            head = s if first else head
            assert got[(k, i)] == (head, first)


def test_anchored_windows_double_over_chunks_only(spark, monkeypatch):
    calls = counted(monkeypatch)
    df = spark.range(6000).select(F.lit("v").alias("stem"), F.col("id").alias("item_no"), (F.col("id") * 1000).alias("start_ms"))
    assert C.anchored_windows(df).filter("is_head").count() == 1000
    assert len(calls) <= 9  # two chunks of an hour


@pytest.mark.parametrize("texts, most", [(["same line"], 9), (["a line here", "a line herE", "wholly different"], 12)])
def test_long_groups_take_few_passes(spark, monkeypatch, texts, most):
    calls = counted(monkeypatch)
    rows = [("v", i, i * 900, i * 900 + 850, texts[i % len(texts)]) for i in range(2000)]
    df = spark.createDataFrame(rows, "stem string, cue_no bigint, start_ms bigint, end_ms bigint, text string")
    got = sorted((r["start_ms"], r["end_ms"], r["text"]) for r in C.merge_near_duplicates(df, chunk_rows=10).collect())
    assert got == dedup([r[2:] for r in rows]) and len(calls) <= most  # 200 chunks


def test_phases_are_told_apart_by_doubling(spark, monkeypatch):
    calls = counted(monkeypatch)
    # Three cues make a block of at least a second; a chunk of ten can be left in three phases.
    rows = [("v", i, i * 400, i * 400 + 390, f"t{i}") for i in range(1500)]
    df = spark.createDataFrame(rows, "stem string, cue_no bigint, start_ms bigint, end_ms bigint, text string")
    got = sorted((r["start_ms"], r["end_ms"], r["text"]) for r in C.merge_short(df, chunk_rows=10).collect())
    assert got == short_merge([r[2:] for r in rows])
    assert len(calls) <= 2 + 2 * 4 + 2 * 9  # 150 chunks: first and last pass, a pass per phase, eight doublings


def greedy_pairs(preds):
    free, out = {p[0] for p in preds if p[1] == "left"}, set()
    for r in (p for p in preds if p[1] == "right"):
        best = None
        for q in (p for p in preds if p[1] == "left" and p[0] in free):
            overlap = min(r[3], q[3]) - max(r[2], q[2])
            if overlap >= 100 and (best is None or overlap > best[0]):
                best = (overlap, q[0])
        if best:
            free.discard(best[1])
            out.add((r[0], best[1]))
    return out


def random_predictions(n, seed):
    rng = random.Random(seed)
    starts = sorted(rng.randrange(0, n * 150) for _ in range(n))
    return [(i, rng.choice(["right", "left"]), s, s + rng.choice([80, 150, 400, 900])) for i, s in enumerate(starts)]


@pytest.fixture(scope="module")
def predictions(spark):
    sets = {f"p{n}": random_predictions(n, n) for n in (1, 6, 25, 60)}
    rows = [(k, *p) for k, ps in sets.items() for p in ps]
    return sets, spark.createDataFrame(rows, "stem string, item_no bigint, hand string, start_ms bigint, end_ms bigint")


@pytest.mark.parametrize("chunk_ms", [500, 600_000])
def test_hand_pairs(predictions, chunk_ms):
    sets, df = predictions
    got = {}
    for r in M.pair_hands(df, chunk_ms=chunk_ms).collect():
        got.setdefault(r["stem"], set()).add((r["right_no"], r["left_no"]))
    for k, ps in sets.items():
        assert got.get(k, set()) == greedy_pairs(ps), k


@pytest.mark.parametrize("chunk_ms", [2000, 600_000])
def test_clusters(predictions, chunk_ms):
    sets, df = predictions
    got = {(r["stem"], r["item_no"]): (r["cluster_start_ms"], r["cluster_end_ms"])
           for r in M.prediction_clusters(df, 300, 1500, chunk_ms).collect()}
    for k, ps in sets.items():
        for i, _, lo, hi in ps:
            for _, _, s, e in ps:
                if s > hi + 300 or e - lo > 1500:
                    break
                hi = max(hi, e)
            for _, _, s, e in reversed(ps):
                if e < lo - 300 or hi - s > 1500:
                    break
                lo = min(lo, s)
            assert got[(k, i)] == (lo, hi), (k, i)


def test_sweep_forms_only_pairs_that_count(spark, monkeypatch):
    rows = [("v", i, "right" if i % 2 else "left", i * 6, i * 6 + 105) for i in range(10_000)]  # one minute, overlaps of 99 ms
    df = spark.createDataFrame(rows, "stem string, item_no bigint, hand string, start_ms bigint, end_ms bigint")
    assert M.overlap_candidates(df).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_sweep_over_range_borders(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["v", "w"]), i, rng.choice(["right", "left"]), s, s + rng.choice([50, 120, 400, 9000]))
            for i, s in enumerate(sorted(rng.randrange(0, 20_000) for _ in range(400)))]
    df = spark.createDataFrame(rows, "stem string, item_no bigint, hand string, start_ms bigint, end_ms bigint")
    got = sorted(tuple(r) for r in M.overlap_candidates(df).collect())
    want = sorted((r[0], r[1], l[1], r[3], min(r[4], l[4]) - max(r[3], l[3])) for r in rows if r[2] == "right" for l in rows
                  if l[2] == "left" and l[0] == r[0] and min(r[4], l[4]) - max(r[3], l[3]) >= 100)
    assert got == want


def test_sweep_and_pairing_use_all_partitions_once(spark):
    rows = [(f"v{i // 20}", i, "right" if i % 2 else "left", i % 20 * 300, i % 20 * 300 + 500) for i in range(4000)]
    df = spark.createDataFrame(rows, "stem string, item_no bigint, hand string, start_ms bigint, end_ms bigint")
    assert M.overlap_candidates(df).rdd.getNumPartitions() == 4  # not merged for being small
    pairs = M.pair_hands(df)
    assert pairs.rdd.getNumPartitions() == 4
    # The result is written: its readers do not sweep again.
    assert not any(step in pairs._jdf.queryExecution().toString() for step in ("MapInArrow", "FlatMapGroupsInPandas"))
    want = {(k, *p) for k in {r[0] for r in rows} for p in greedy_pairs([r[1:] for r in rows if r[0] == k])}
    assert {tuple(r) for r in pairs.collect()} == want
