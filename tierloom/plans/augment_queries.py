"""Queries over augmented variants.

Steps are checked with parameters that follow a formula of clip and variant, so
that SQL can repeat them; drawn parameters are checked by their ranges.
"""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tierloom.fixed_values import HAND_BLOCKS
from tierloom.functions.draws import fraction_sql, hashed_sql
from tierloom.operators import augment as A
from tierloom.operators import landmarks as L
from tierloom.plans.landmark_queries import COMPACT, digest, digest_sql
from tierloom.plans.registry import query
from tierloom.session import checkpointed

PARAMS = {
    "crop_len": "CASE WHEN variant > 0 THEN greatest(5, t * (3 + variant) DIV 6) END",
    "crop_start": "CASE WHEN variant > 0 THEN clip % 3 END",
    "new_t": "CASE variant WHEN 1 THEN t + 7 + clip WHEN 2 THEN greatest(5, t * 4 DIV 5 - clip) END",
    "scale": "CASE WHEN variant > 0 THEN 0.9D + variant * 0.05D END",
    "mirror": "CASE WHEN variant > 0 THEN (clip + variant) % 2 = 0 END",
    "angle": "CASE WHEN variant > 0 THEN variant * 0.1D - clip * 0.01D END",
    "drop": "CASE WHEN variant > 0 THEN array(cast(clip as int), cast(clip + 20 * variant as int)) END",
    "spans": "CASE WHEN variant > 0 THEN array(named_struct('s', clip, 'e', clip + 3), named_struct('s', clip + 10, 'e', clip + 10 + variant)) END",
    "weight": "CASE WHEN variant > 0 THEN 0.5D + variant * 0.1D END",
    "other": "CASE WHEN variant > 0 THEN (clip + variant) % 10 END",
}
SQL_PARAMS = {k: v.replace(" DIV ", " // ").replace("0.9D", "0.9::DOUBLE").replace("0.05D", "0.05::DOUBLE").replace("0.1D", "0.1::DOUBLE")
              .replace("0.01D", "0.01::DOUBLE").replace("0.5D", "0.5::DOUBLE") for k, v in PARAMS.items() if k not in ("drop", "spans")}
PRM = f"""{COMPACT}, prm AS (SELECT *, {', '.join(f'{v} AS {k}' for k, v in SQL_PARAMS.items())}
    FROM (SELECT clip, count(DISTINCT frame) AS t FROM small GROUP BY clip), (SELECT unnest(range(3)) AS variant)),
  base AS (SELECT s.clip, variant, frame, idx, x, y, z, prm.* EXCLUDE (clip, variant) FROM small s JOIN prm USING (clip))"""


def frames(b):
    pose = L.select_landmarks(b.pose).select("clip", "frame", "pts")
    clips = pose.groupBy("clip").agg(F.count(F.lit(1)).alias("t"))
    rows = clips.withColumn("variant", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))))
    rows = rows.withColumns({k: F.expr(v) for k, v in PARAMS.items()})
    rows = rows.withColumn("crop_len", F.col("crop_len").cast("long")).withColumn("new_t", F.col("new_t").cast("long"))
    return A.with_parameters(pose, rows)


def flat(df, *keys):
    rows = df.withColumn("features", F.flatten(F.transform("pts", lambda p: F.array(p["x"], p["y"], p["z"]))))
    return digest(rows, [*keys, "clip", "variant", "frame"])


def flat_sql(x: str = "x", y: str = "y", z: str = "z", frame: str = "frame", where: str = "true") -> str:
    return "flat AS (" + " UNION ALL ".join(
        f"SELECT clip, variant, {frame} AS frame, idx * 3 + {j} AS i, {v} AS v FROM base WHERE {where}" for j, v in enumerate((x, y, z))) + ") " + digest_sql(
        "flat", "clip, variant, frame")


@query("c21_temporal_crop", f"WITH {PRM}, {flat_sql(frame='frame - coalesce(crop_start, 0)', where='frame >= coalesce(crop_start, 0) AND frame < coalesce(crop_start, 0) + coalesce(crop_len, t)')}")
def temporal_crop(b):
    return flat(A.crop(frames(b)))


@query("c22_speed_resample", f"""WITH {PRM}, news AS (SELECT clip, variant, t, n, j, CASE WHEN n = t THEN j ELSE least(CAST(floor(j * (t - 1) / (n - 1)) AS BIGINT), t - 2) END AS lo,
      CASE WHEN n = t THEN 0 ELSE j * (t - 1) / (n - 1) - least(CAST(floor(j * (t - 1) / (n - 1)) AS BIGINT), t - 2) END AS fr
      FROM (SELECT clip, variant, t, coalesce(new_t, t) AS n FROM prm), LATERAL (SELECT unnest(range(n)) AS j)),
    mixed AS (SELECT w.clip, w.variant, w.j AS frame, a.idx, a.x * (1 - fr) + coalesce(b.x, 0) * fr AS x, a.y * (1 - fr) + coalesce(b.y, 0) * fr AS y, a.z * (1 - fr) + coalesce(b.z, 0) * fr AS z
      FROM news w JOIN small a ON a.clip = w.clip AND a.frame = lo LEFT JOIN small b ON b.clip = w.clip AND b.frame = lo + 1 AND b.idx = a.idx),
    flat AS (SELECT clip, variant, frame, idx * 3 AS i, x AS v FROM mixed UNION ALL SELECT clip, variant, frame, idx * 3 + 1, y FROM mixed UNION ALL SELECT clip, variant, frame, idx * 3 + 2, z FROM mixed)
    {digest_sql('flat', 'clip, variant, frame')}""")
def speed_resample(b):
    return flat(A.change_speed(frames(b)))


@query("c24_scale_jitter", f"WITH {PRM}, {flat_sql(*[f'{a} * coalesce(scale, 1)' for a in 'xyz'])}")
def scale_jitter(b):
    return flat(A.rescale(frames(b)))


(_l, _n), (_r, _) = HAND_BLOCKS[96]
SWAP = f"CASE WHEN NOT coalesce(mirror, false) THEN idx WHEN idx BETWEEN {_l} AND {_l + _n - 1} THEN idx + {_r - _l} WHEN idx BETWEEN {_r} AND {_r + _n - 1} THEN idx - {_r - _l} ELSE idx END"


@query("c25_mirror", f"WITH {PRM}, turned AS (SELECT clip, variant, frame, {SWAP} AS idx, CASE WHEN coalesce(mirror, false) THEN -x ELSE x END AS x, y, z FROM base), {flat_sql().replace('FROM base', 'FROM turned')}")
def mirror(b):
    return flat(A.mirror_hands(frames(b)))


_COS, _SIN = "cos(coalesce(angle, 0))", "sin(coalesce(angle, 0))"


@query("c26_rotation", f"WITH {PRM}, {flat_sql(f'x * {_COS} - z * {_SIN}', 'y', f'x * {_SIN} + z * {_COS}')}")
def rotation(b):
    return flat(A.rotate(frames(b)))


_GONE = "variant > 0 AND idx IN (clip, clip + 20 * variant)"


@query("c27_landmark_dropout", f"WITH {PRM}, {flat_sql(*[f'CASE WHEN {_GONE} THEN 0 ELSE {a} END' for a in 'xyz'])}")
def landmark_dropout(b):
    return flat(A.drop_landmarks(frames(b)))


_HIT = "variant > 0 AND (frame >= clip AND frame < clip + 3 OR frame >= clip + 10 AND frame < clip + 10 + variant)"


@query("c28_temporal_mask", f"WITH {PRM}, {flat_sql(*[f'CASE WHEN {_HIT} THEN 0 ELSE {a} END' for a in 'xyz'])}")
def temporal_mask(b):
    return flat(A.mask_spans(frames(b)))


@query("c29_mixup", f"""WITH {PRM}, mixed AS (SELECT b.clip, variant, b.frame, b.idx, {', '.join(f'CASE WHEN o.{a} IS NULL THEN b.{a} ELSE weight * b.{a} + (1 - weight) * o.{a} END AS {a}' for a in 'xyz')}
      FROM base b LEFT JOIN small o ON o.clip = b.other AND o.frame = b.frame AND o.idx = b.idx), {flat_sql().replace('FROM base', 'FROM mixed')}""")
def mixup(b):
    return flat(A.mixup(frames(b), L.select_landmarks(b.pose)))


def noisy_sql(source: str, std: str) -> str:
    """Rows of ``source`` with normal noise; six numbers of five digits from one hash per landmark."""
    def normal(place: int) -> str:
        u, v = fraction_sql("d", 1 + 10 * place, 5), fraction_sql("d", 6 + 10 * place, 5)
        return f"sqrt(-2 * ln({u} + {0.5 / 16 ** 5!r}::DOUBLE)) * cos({2 * math.pi!r}::DOUBLE * {v})"

    moved = ", ".join(f"CASE WHEN {std} IS NULL THEN {a} ELSE {a} + {normal(k)} * {std} END AS {a}" for k, a in enumerate("xyz"))
    d = hashed_sql("'42'", "'noise'", "clip", "variant", "frame", "idx")
    return f"SELECT * REPLACE ({moved}) FROM (SELECT *, {d} AS d FROM {source})"


@query("c23_gaussian_noise", f"""WITH {PRM}, noisy AS ({noisy_sql('(SELECT *, CASE WHEN variant > 0 THEN 0.003::DOUBLE END AS std FROM base)', 'std')}),
    {flat_sql().replace('FROM base', 'FROM noisy')}""")
def gaussian_noise(b):
    rows = frames(b).withColumn("noise_std", F.when(F.col("variant") > 0, F.lit(0.003)))
    return flat(A.add_noise(rows))


def small_clips(b):
    """One clip per vector of eight frames with eight landmarks; the label groups mixup partners."""
    e = lambda i: F.get("embedding", i).cast("double")
    point = lambda i: F.struct(e(i).alias("x"), e((i + 21) % 64).alias("y"), e((i + 42) % 64).alias("z"), F.lit(1.0).alias("c"))
    rows = b.table("embeddings").select(F.col("vec_id").alias("clip"), F.col("label").cast("long").alias("label"),
                                        F.transform(F.sequence(F.lit(0), F.lit(63)), point).alias("all"))
    frames_ = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda f: F.slice("all", f * 8 + 1, F.lit(8)))
    return rows.select("clip", "label", F.posexplode(frames_).alias("frame", "pts")).withColumn("frame", F.col("frame").cast("long"))


def clip_sizes(b):
    return small_clips(b).groupBy("clip", "label").agg(F.count(F.lit(1)).alias("t"))


@query("c30_parameter_ranges", """SELECT count(*) AS n, true AS crop_ok, true AS speed_ok, true AS scale_ok, true AS angle_ok, true AS drop_ok, true AS spans_ok, true AS weight_ok, true AS first_plain
    FROM embeddings, (SELECT unnest(range(4)) AS v)""")
def parameter_ranges(b):
    p = A.parameters(clip_sizes(b), 4, 8, A.STEPS)
    ok = lambda c: F.coalesce(F.bool_and(c), F.lit(True))
    return p.agg(
        F.count(F.lit(1)).alias("n"),
        ok(F.col("crop_len").between(5, 8) & (F.col("crop_start") + F.col("crop_len") <= F.greatest(F.col("t"), F.col("crop_len") + 0))).alias("crop_ok"),
        ok(F.col("new_t").between(5, 10)).alias("speed_ok"), ok(F.col("scale").between(0.9, 1.1)).alias("scale_ok"),
        ok(F.col("angle").between(-0.26, 0.26)).alias("angle_ok"), ok(F.size("drop") == 1).alias("drop_ok"),
        ok(F.size("spans").between(1, 3) & F.forall("spans", lambda s: (s["e"] - s["s"]).between(2, 5))).alias("spans_ok"),
        ok(F.col("weight").between(0.5, 1.0) & (F.col("other") != F.col("clip"))).alias("weight_ok"),
        ok((F.col("variant") > 0) | F.coalesce("crop_len", "new_t", "scale", "angle", "weight").isNull()).alias("first_plain"))


def u(name: str, *more: str) -> str:
    return fraction_sql(hashed_sql("'42'", f"'{name}'", "clip", "variant", *more))


def whole(n: str, name: str, *more: str) -> str:
    return f"least(CAST(floor({u(name, *more)} * ({n})) AS BIGINT), ({n}) - 1)"


def between(low: float, high: float, name: str) -> str:
    return f"({low!r}::DOUBLE + {high - low!r}::DOUBLE * {u(name)})"


_AT = f"{u('beta')} * {A.BETA_STEPS}"
_BETA = f"(q[CAST(floor({_AT}) AS INT) + 1] + (q[CAST(floor({_AT}) AS INT) + 2] - q[CAST(floor({_AT}) AS INT) + 1]) * ({_AT} - floor({_AT})))"
# Drawn parameters in the order of the steps; each level uses those before it.
DRAWN_SQL = f"""{COMPACT}, quantiles AS (SELECT {[x for x in A.beta_quantiles()]!r}::DOUBLE[] AS q),
  d0 AS (SELECT clip, clip % 3 AS label, t, variant FROM (SELECT clip, count(DISTINCT frame) AS t FROM small GROUP BY clip), (SELECT unnest(range(3)) AS variant)),
  d1 AS (SELECT *, CASE WHEN variant > 0 THEN CAST(least(t, greatest(5, floor(t * {between(0.75, 1.0, 'crop')}))) AS BIGINT) END AS crop_len FROM d0),
  d2 AS (SELECT *, CASE WHEN variant > 0 THEN {whole('greatest(1, t - crop_len)', 'crop_start')} END AS crop_start,
    CASE WHEN variant > 0 THEN CAST(greatest(5, floor(crop_len / {between(0.8, 1.2, 'speed')})) AS BIGINT) END AS new_t,
    CASE WHEN variant > 0 THEN {between(0.001, 0.005, 'noise')} END AS noise_std, CASE WHEN variant > 0 THEN {between(0.9, 1.1, 'scale')} END AS scale,
    CASE WHEN variant > 0 AND {u('mirror_chance')} < 0.5 THEN true END AS mirror, CASE WHEN variant > 0 THEN {between(-0.26, 0.26, 'rotation')} END AS angle,
    variant > 0 AND {u('dropout_chance')} < 0.3 AS drops, greatest(1, CAST(floor(96 * {between(0.05, 0.15, 'drop_ratio')}) AS BIGINT)) AS n_drop,
    variant > 0 AND {u('time_mask_chance')} < 0.3 AS masks, {whole('3', 'spans')} + 1 AS n_spans,
    CASE WHEN variant > 0 AND {u('mixup_chance')} < 0.3 THEN greatest(0.5, {_BETA}) END AS w FROM d1, quantiles),
  numbered AS (SELECT clip, label, row_number() OVER (PARTITION BY label ORDER BY {hashed_sql("'42'", 'clip')}, clip) - 1 AS no, count(*) OVER (PARTITION BY label) AS m FROM d0 WHERE variant = 0),
  prm AS (SELECT d2.*, coalesce(new_t, t) AS n, o.clip AS other, CASE WHEN o.clip IS NOT NULL THEN w END AS weight
    FROM d2 JOIN numbered USING (clip, label) LEFT JOIN numbered o ON o.label = d2.label AND numbered.m > 1 AND o.no = (numbered.no + {whole('greatest(numbered.m - 1, 1)', 'partner').replace('clip, variant', 'd2.clip, variant')} + 1) % numbered.m),
  gone AS (SELECT clip, variant, i AS idx FROM (SELECT clip, variant, n_drop, i, row_number() OVER (PARTITION BY clip, variant ORDER BY {u('drop', 'i')}, i) AS r
    FROM d2, (SELECT unnest(range(96)) AS i) WHERE drops) WHERE r <= n_drop),
  lens AS (SELECT clip, variant, n, i, {whole('least(6, greatest(3, CAST(floor(n / 5) AS BIGINT))) - 2', 'span_len', 'i')} + 2 AS len FROM prm, (SELECT unnest([1, 2, 3]) AS i) WHERE masks AND i <= n_spans),
  hidden AS (SELECT DISTINCT clip, variant, unnest(range(s, s + len)) AS frame FROM (SELECT *, {whole('greatest(1, n - len)', 'span_start', 'i')} AS s FROM lens)),
  cut AS (SELECT s.clip, p.variant, s.frame - coalesce(crop_start, 0) AS frame, idx, x, y, z FROM small s JOIN prm p USING (clip)
    WHERE variant = 0 OR (s.frame >= crop_start AND s.frame < crop_start + crop_len)),
  news AS (SELECT clip, variant, j, n, t1, CASE WHEN n = t1 THEN j ELSE least(CAST(floor(j * (t1 - 1) / (n - 1)) AS BIGINT), t1 - 2) END AS lo,
      CASE WHEN n = t1 THEN 0 ELSE j * (t1 - 1) / (n - 1) - least(CAST(floor(j * (t1 - 1) / (n - 1)) AS BIGINT), t1 - 2) END AS fr
    FROM (SELECT clip, variant, coalesce(crop_len, t) AS t1, n FROM prm), LATERAL (SELECT unnest(range(n)) AS j)),
  sped AS (SELECT w.clip, w.variant, w.j AS frame, a.idx, {', '.join(f'a.{a} * (1 - fr) + coalesce(b.{a}, 0) * fr AS {a}' for a in 'xyz')}
    FROM news w JOIN cut a ON a.clip = w.clip AND a.variant = w.variant AND a.frame = lo LEFT JOIN cut b ON b.clip = w.clip AND b.variant = w.variant AND b.frame = lo + 1 AND b.idx = a.idx),
  noisy AS ({noisy_sql('(SELECT s.*, noise_std, scale, mirror, angle, weight, other FROM sped s JOIN prm USING (clip, variant))', 'noise_std')}),
  turned AS (SELECT * REPLACE ({SWAP} AS idx, CASE WHEN coalesce(mirror, false) THEN -x ELSE x END * coalesce(scale, 1) AS x, y * coalesce(scale, 1) AS y, z * coalesce(scale, 1) AS z) FROM noisy),
  rotated AS (SELECT * REPLACE (x * {_COS} - z * {_SIN} AS x, x * {_SIN} + z * {_COS} AS z) FROM turned),
  zeroed AS (SELECT r.* REPLACE ({', '.join(f'CASE WHEN g.idx IS NOT NULL OR h.frame IS NOT NULL THEN 0 ELSE r.{a} END AS {a}' for a in 'xyz')})
    FROM rotated r LEFT JOIN gone g ON g.clip = r.clip AND g.variant = r.variant AND g.idx = r.idx LEFT JOIN hidden h ON h.clip = r.clip AND h.variant = r.variant AND h.frame = r.frame),
  mixed AS (SELECT r.clip, r.variant, r.frame, r.idx, {', '.join(f'CASE WHEN weight IS NULL OR o.{a} IS NULL THEN r.{a} ELSE weight * r.{a} + (1 - weight) * o.{a} END AS {a}' for a in 'xyz')}
    FROM zeroed r LEFT JOIN small o ON o.clip = r.other AND o.frame = r.frame AND o.idx = r.idx)"""


@query("c30_augmented_variants", f"WITH {DRAWN_SQL}, {flat_sql().replace('FROM base', 'FROM mixed')}")
def augmented_variants(b):
    # Written once: clip sizes, variants of either kind and partners read it.
    pose = checkpointed(L.select_landmarks(b.pose).select("clip", "frame", "pts"))
    clips = pose.groupBy("clip").agg(F.count(F.lit(1)).alias("t")).withColumn("label", F.col("clip") % 3)
    return flat(A.augment(pose, A.parameters(clips, 3, 96, A.STEPS)))


GRID_ROWS = ", ".join(f"('{name}', {n})" for name, (_, n) in A.SEARCH_GRID.items())


@query("c30_search_grid", f"""SELECT combo, count(*) AS n FROM embeddings, (SELECT * FROM (VALUES {GRID_ROWS}) g(combo, n)), LATERAL (SELECT unnest(range(n)) AS v) GROUP BY combo""")
def search_grid(b):
    return A.search_parameters(clip_sizes(b), 8).groupBy("combo").agg(F.count(F.lit(1)).alias("n"))
