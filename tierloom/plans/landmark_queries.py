"""Queries over landmark frames.

Wide feature arrays are compared through a digest per frame: their length, their
sum and a sum weighted by position.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tierloom.fixed_values import BONES, PRESETS
from tierloom.operators import landmarks as L
from tierloom.operators import signal as S
from tierloom.functions.draws import hashed_sql
from tierloom.plans.registry import query
from tierloom.plans.signal_queries import detect_sql


def digest(df, keys, column="features"):
    def total(weight):
        terms = F.transform(column, lambda v, i: v * weight(i))
        return F.aggregate(terms, F.lit(0.0), lambda a, v: a + v)

    return df.select(*keys, F.size(column).cast("long").alias("width"),
                     F.round(total(lambda i: F.lit(1.0)), 4).alias("total"),
                     F.round(total(lambda i: i % 97 + 1), 4).alias("weighted"))


def digest_sql(rows: str, keys: str) -> str:
    """``rows`` has the keys, ``i`` (position) and ``v``."""
    return (f"SELECT {keys}, count(*) AS width, round(sum(v), 4) AS total, "
            f"round(sum(v * (i % 97 + 1)), 4) AS weighted FROM {rows} GROUP BY {keys}")


def preset_sql(name: str, table: str = "preset") -> str:
    rows = ", ".join(f"({lm}, {i})" for i, lm in enumerate(PRESETS[name]))
    return f"{table}(lm, idx) AS (VALUES {rows})"


COMPACT = f"""{preset_sql('compact')},
  small AS (SELECT clip, frame, idx, x, y, z, c, fps FROM pose JOIN preset USING (lm))"""
NOSE = """nose AS (SELECT clip, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM small WHERE idx = 0 GROUP BY clip),
  shifted AS (SELECT s.clip, frame, idx, x - mx AS x, y - my AS y, z - mz AS z FROM small s JOIN nose USING (clip)),
  spread AS (SELECT clip, stddev_pop(v) AS sd FROM (SELECT clip, unnest([x, y, z]) AS v FROM shifted) GROUP BY clip),
  normal AS (SELECT s.clip, frame, idx, x / d AS x, y / d AS y, z / d AS z
    FROM shifted s JOIN (SELECT clip, CASE WHEN sd > 1e-6 THEN sd ELSE 1 END AS d FROM spread) USING (clip))"""


def moves_sql(src: str, axes: str) -> str:
    """Rows ``(clip, frame, i, v)`` of positions and displacements."""
    n = len(axes)
    parts = [f"SELECT clip, frame, idx * {3 * n} + {j} AS i, {a} AS v FROM {src}" for j, a in enumerate(axes)]
    for k in (1, 2):
        parts += [f"SELECT clip, frame, idx * {3 * n} + {k * n + j} AS i, coalesce(lead({a}, {k}) OVER "
                  f"(PARTITION BY clip, idx ORDER BY frame) - {a}, 0) AS v FROM {src}"
                  for j, a in enumerate(axes)]
    return "moves AS (" + " UNION ALL ".join(parts) + ")"


@query("c01_landmark_preset", f"""WITH {preset_sql('extended')}
    SELECT clip, frame, count(*) AS n, round(sum(x * (idx + 1)), 4) AS sx, round(sum(c), 4) AS sc
    FROM pose JOIN preset USING (lm) GROUP BY clip, frame""")
def landmark_preset(b):
    rows = L.as_rows(L.select_landmarks(b.pose, "extended"))
    return rows.groupBy("clip", "frame").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("x") * (F.col("lm") + 1)), 4).alias("sx"),
        F.round(F.sum("c"), 4).alias("sc"))


WIDTHS = ", ".join(f"({n * m}, '{p}')" for p, n in (("compact", 96), ("extended", 148), ("full", 174))
                   for m in (2, 3, 6, 9))


@query("c02_preset_from_width", f"""WITH widths(w, preset) AS (VALUES {WIDTHS})
    SELECT p_partkey, p_size * 6 AS width, preset FROM part LEFT JOIN widths ON w = p_size * 6""")
def preset_from_width(b):
    width = F.col("p_size") * 6
    return b.table("part").select("p_partkey", width.alias("width"),
                                  L.preset_for_width(width).alias("preset"))


@query("c02_dominant_width", """SELECT p_size, count(*) AS n FROM part GROUP BY p_size
    ORDER BY n DESC, p_size LIMIT 1""")
def dominant_width(b):
    return L.dominant_width(b.table("part"), "p_size")


EXTENDED_PLACE = ", ".join(f"({PRESETS['extended'].index(lm)}, {i})"
                           for i, lm in enumerate(PRESETS["compact"]))


@query("c03_pad_to_extended", f"""WITH {COMPACT}, place(ext, idx) AS (VALUES {EXTENDED_PLACE}),
    padded AS (SELECT clip, frame, e.i, coalesce(s.x, 0) AS v
      FROM (SELECT DISTINCT clip, frame FROM small) f CROSS JOIN (SELECT unnest(range(148)) AS i) e
      LEFT JOIN place p ON p.ext = e.i LEFT JOIN small s USING (clip, frame, idx))
    {digest_sql('padded', 'clip, frame')}""")
def pad_to_extended(b):
    padded = L.pad_to_extended(L.select_landmarks(b.pose))
    return digest(padded.withColumn("features", F.transform("pts", lambda p: p["x"])), ["clip", "frame"])


@query("c04_wrist_position", """WITH w AS (SELECT clip, frame, hand, lm, x, y, c, lm >= 33 AS is_hand
      FROM pose JOIN (VALUES (16, 'right'), (54, 'right'), (15, 'left'), (33, 'left')) v(lm, hand) USING (lm))
    SELECT h.clip, h.frame, h.hand, CASE WHEN h.c > 0.3 THEN h.x ELSE d.x END AS x,
      CASE WHEN h.c > 0.3 THEN h.y ELSE d.y END AS y, CASE WHEN h.c > 0.3 THEN h.c ELSE d.c END AS conf
    FROM w h JOIN w d USING (clip, frame, hand) WHERE h.is_hand AND NOT d.is_hand""")
def wrist_position(b):
    return S.wrist_positions(b.pose).drop("fps")


SEGMENTS_SQL = """segs AS (SELECT clip, clip || '_' || n AS segment_id, n * 800 AS start_ms,
      n * 800 + 760 AS end_ms FROM (SELECT clip, unnest(range((count(*) - 1) // 20 + 1)) AS n FROM signal GROUP BY clip)),
    ranges AS (SELECT segment_id, s.clip, start_ms AS seg_start, t,
        least(CAST(floor(start_ms * 25.0 / 1000) AS BIGINT), t - 1) AS fs,
        least(CAST(floor(end_ms * 25.0 / 1000) AS BIGINT), t - 1) AS fe
      FROM segs s JOIN (SELECT clip, count(*) AS t FROM signal GROUP BY clip) USING (clip)),
    inside AS (SELECT segment_id, r.clip, seg_start, t, hand, frame - fs AS frame, x, y, conf
      FROM hand_signal h JOIN ranges r ON h.clip = r.clip AND frame >= fs AND frame < fe)"""


@query("c09_detect_in_segments", f"""WITH {SEGMENTS_SQL},
    {detect_sql('inside', 'segment_id', 1.0, 0.5)}
    SELECT r.clip || '_' || lpad(CAST(seg_start + f.start_ms AS VARCHAR), 8, '0') || '_' || left(hand, 1) AS pairing_id,
      segment_id, clip, hand, seg_start + f.start_ms AS sign_start_ms, seg_start + f.end_ms AS sign_end_ms,
      least(CAST(floor((seg_start + f.start_ms) * 25.0 / 1000) AS BIGINT), t - 1) AS sign_frame_start,
      least(CAST(floor((seg_start + f.end_ms) * 25.0 / 1000) AS BIGINT), t - 1) AS sign_frame_end,
      f.score AS motion_confidence, 'pending' AS status, CAST(25 AS DOUBLE) AS fps
    FROM found f JOIN ranges r USING (segment_id) JOIN (SELECT DISTINCT clip, hand FROM hand_signal) USING (clip)""")
def detect_in_segments(b):
    sig = b.hand_signal_table
    clips = sig.groupBy("clip").agg(F.max("fps").alias("fps"), F.count(F.lit(1)).alias("n_frames"))
    n = F.explode(F.sequence(F.lit(0), F.floor((F.col("n_frames") - 1) / 20).cast("int"))).alias("n")
    segs = clips.select("clip", n).select(
        F.concat_ws("_", F.col("clip").cast("string"), F.col("n").cast("string")).alias("segment_id"), "clip",
        (F.col("n") * 800).cast("long").alias("start_ms"), (F.col("n") * 800 + 760).cast("long").alias("end_ms"))
    return S.detect_in_segments(sig, segs, clips, sigma=1.0, threshold=0.5)


@query("c10_velocity", f"""WITH {COMPACT}, {moves_sql('small', 'xyz')}
    {digest_sql('moves', 'clip, frame')}""")
def velocity(b):
    return digest(L.velocity(L.select_landmarks(b.pose)), ["clip", "frame"])


@query("c11_drop_z", f"""WITH {COMPACT}, flat AS (SELECT clip, frame, idx * 2 AS i, x AS v FROM small
      UNION ALL SELECT clip, frame, idx * 2 + 1, y FROM small) {digest_sql('flat', 'clip, frame')}""")
def drop_z(b):
    return digest(L.feature_mode(L.select_landmarks(b.pose), "xy_only"), ["clip", "frame"])


@query("c12_nose_normalise", f"""WITH {COMPACT}, {NOSE},
    flat AS (SELECT clip, frame, idx * 3 AS i, x AS v FROM normal UNION ALL
      SELECT clip, frame, idx * 3 + 1, y FROM normal UNION ALL SELECT clip, frame, idx * 3 + 2, z FROM normal)
    {digest_sql('flat', 'clip, frame')}""")
def nose_normalise(b):
    return digest(L.feature_mode(L.select_landmarks(b.pose), "normalize"), ["clip", "frame"])


@query("c13_norm_xy_velocity", f"""WITH {COMPACT}, {NOSE}, {moves_sql('normal', 'xy')}
    {digest_sql('moves', 'clip, frame')}""")
def norm_xy_velocity(b):
    return digest(L.feature_mode(L.select_landmarks(b.pose), "norm_xy_velocity"), ["clip", "frame"])


@query("c13_xy_velocity", f"""WITH {COMPACT}, {moves_sql('small', 'xy')} {digest_sql('moves', 'clip, frame')}""")
def xy_velocity(b):
    return digest(L.feature_mode(L.select_landmarks(b.pose), "xy_velocity"), ["clip", "frame"])


@query("c13_raw", f"""WITH {COMPACT}, flat AS (SELECT clip, frame, idx * 3 AS i, x AS v FROM small UNION ALL
      SELECT clip, frame, idx * 3 + 1, y FROM small UNION ALL SELECT clip, frame, idx * 3 + 2, z FROM small)
    {digest_sql('flat', 'clip, frame')}""")
def raw_features(b):
    return digest(L.feature_mode(L.select_landmarks(b.pose), "raw"), ["clip", "frame"])


@query("c14_pad_or_truncate", """SELECT clip, f AS frame, round(coalesce(x, 0), 6) AS x, round(coalesce(y, 0), 6) AS y,
      CASE WHEN s.clip2 IS NULL THEN CAST(0 AS DOUBLE) ELSE 1 END AS mask
    FROM (SELECT DISTINCT clip FROM signal) CROSS JOIN (SELECT unnest(range(70)) AS f)
    LEFT JOIN (SELECT clip AS clip2, frame, x, y FROM signal) s ON clip = s.clip2 AND f = s.frame""")
def pad_or_truncate(b):
    rows = b.signal.select("clip", "frame", F.array("x", "y").alias("features"))
    return L.pad_or_truncate(rows, 70).select(
        "clip", "frame", F.round(F.get("features", F.lit(0)), 6).alias("x"),
        F.round(F.get("features", F.lit(1)), 6).alias("y"), "mask")


BONE_ROWS = ", ".join(f"({i}, {p}, {c})" for i, (p, c) in enumerate(BONES))
BONE_SQL = f"bone(b, parent, child) AS (VALUES {BONE_ROWS})"


@query("c15_bones", f"""WITH {COMPACT}, {BONE_SQL},
    vec AS (SELECT p.clip, p.frame, b, c.x - p.x AS x, c.y - p.y AS y, c.z - p.z AS z FROM bone
      JOIN small p ON p.idx = parent JOIN small c ON c.idx = child AND c.clip = p.clip AND c.frame = p.frame),
    flat AS (SELECT clip, frame, b * 3 AS i, x AS v FROM vec UNION ALL SELECT clip, frame, b * 3 + 1, y FROM vec
      UNION ALL SELECT clip, frame, b * 3 + 2, z FROM vec) {digest_sql('flat', 'clip, frame')}""")
def bone_vectors(b):
    rows = L.select_landmarks(b.pose).withColumn("features", F.flatten(F.transform(
        L.bones(), lambda v: F.array(v["x"], v["y"], v["z"]))))
    return digest(rows, ["clip", "frame"])


@query("c16_four_streams", f"""WITH {COMPACT}, {NOSE}, {BONE_SQL},
    now AS (SELECT clip, frame, idx * 2 AS i, x AS v FROM normal UNION ALL SELECT clip, frame, idx * 2 + 1, y FROM normal
      UNION ALL SELECT p.clip, p.frame, 192 + b * 2, c.x - p.x FROM bone JOIN normal p ON p.idx = parent
        JOIN normal c ON c.idx = child AND c.clip = p.clip AND c.frame = p.frame
      UNION ALL SELECT p.clip, p.frame, 193 + b * 2, c.y - p.y FROM bone JOIN normal p ON p.idx = parent
        JOIN normal c ON c.idx = child AND c.clip = p.clip AND c.frame = p.frame),
    streams AS (SELECT clip, frame, i, v FROM now UNION ALL
      SELECT clip, frame, i + 284, coalesce(lead(v) OVER (PARTITION BY clip, i ORDER BY frame) - v, 0) FROM now)
    {digest_sql('streams', 'clip, frame')}""")
def four_streams(b):
    return digest(L.four_streams(L.select_landmarks(b.pose)), ["clip", "frame"])


WINDOWS_SQL = """sizes AS (SELECT clip, count(*) AS n FROM signal GROUP BY clip HAVING count(*) >= 10),
    wins AS (SELECT clip, st AS start, least(n, 30) AS n_frames FROM sizes, LATERAL
      (SELECT unnest(range(0, greatest(1, n - 30 + 1), 15)) AS st))"""


@query("c17_sliding_windows", f"""WITH {WINDOWS_SQL}
    SELECT w.clip, start, n_frames, count(*) AS n, round(sum(x * (frame - start + 1)), 4) AS weighted
    FROM wins w JOIN signal s ON s.clip = w.clip AND frame >= start AND frame < start + 30
    GROUP BY w.clip, start, n_frames""")
def sliding_windows(b):
    wins = L.sliding_windows(b.signal, 30, 15)
    rows = L.window_frames(b.signal, wins, 30, 15)
    return rows.groupBy("clip", "start", "n_frames").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("x") * (F.col("rel") + 1)), 4).alias("weighted"))


@query("c18_frame_masking", f"""WITH {WINDOWS_SQL}, f AS (SELECT clip, start, n_frames, frame - start AS rel, x, y, row_number() OVER (PARTITION BY clip, start
      ORDER BY {hashed_sql("'42'", 'clip', 'start', 'frame - start')}, frame - start) AS r FROM wins JOIN signal USING (clip) WHERE frame >= start AND frame < start + 30)
    SELECT clip, start, rel, m AS masked, CASE WHEN m THEN [0.0::DOUBLE, 0.0::DOUBLE] ELSE [x, y] END AS features
    FROM (SELECT *, n_frames >= 2 AND r <= greatest(1, CAST(floor(n_frames * 0.15::DOUBLE) AS BIGINT)) AS m FROM f)""")
def frame_masking(b):
    rows = L.window_frames(b.signal, L.sliding_windows(b.signal, 30, 15), 30, 15)
    rows = rows.withColumn("features", F.array("x", "y"))
    return L.mask_frames(rows, 0.15).select("clip", "start", "rel", "masked", "features")


@query("c18_frames_masked_per_window", f"""WITH {WINDOWS_SQL}
    SELECT clip, start, CASE WHEN n_frames < 2 THEN 0 ELSE greatest(1, CAST(floor(n_frames * 0.15) AS BIGINT)) END AS n_masked
    FROM wins""")
def frames_masked_per_window(b):
    return frame_masking(b).groupBy("clip", "start").agg(F.count_if("masked").alias("n_masked"))


@query("c19_mean_pooling", """WITH m AS (SELECT clip, avg(x) AS x, avg(y) AS y FROM signal WHERE frame < 70 GROUP BY clip)
    SELECT clip, round(x, 9) AS x, round(y, 9) AS y FROM m""")
def mean_pooling(b):
    rows = b.signal.select("clip", "frame", F.array("x", "y").alias("features"))
    pooled = L.mean_pool(L.pad_or_truncate(rows, 70))
    return pooled.select("clip", F.round(F.get("vector", F.lit(0)), 9).alias("x"),
                         F.round(F.get("vector", F.lit(1)), 9).alias("y"))


@query("c20_visible_box", """WITH seen AS (SELECT clip, min(x) - 0.05 AS x0, max(x) + 0.05 AS x1, min(y) - 0.05 AS y0,
      max(y) + 0.05 AS y1 FROM pose WHERE (lm < 13 OR lm BETWEEN 33 AND 74) AND c >= 0.1 GROUP BY clip)
    SELECT clip, round(CASE WHEN x1 - x0 < 0.1 THEN (x0 + x1) / 2 - 0.15 ELSE x0 END, 6) AS x_min,
      round(CASE WHEN x1 - x0 < 0.1 THEN (x0 + x1) / 2 + 0.15 ELSE x1 END, 6) AS x_max,
      round(CASE WHEN y1 - y0 < 0.1 THEN (y0 + y1) / 2 - 0.15 ELSE y0 END, 6) AS y_min,
      round(CASE WHEN y1 - y0 < 0.1 THEN (y0 + y1) / 2 + 0.15 ELSE y1 END, 6) AS y_max FROM seen""")
def visible_box(b):
    box = L.visible_box(b.pose)
    return box.select("clip", *[F.round(c, 6).alias(c) for c in ("x_min", "x_max", "y_min", "y_max")])


CUTS_SQL = """cuts AS (SELECT clip, clip || '_' || lpad(CAST(n * 400 AS VARCHAR), 8, '0') AS segment_id,
      least(CAST(floor(n * 400 * 25.0 / 1000) AS BIGINT), t - 1) AS fs,
      least(CAST(floor((n * 400 + 350) * 25.0 / 1000) AS BIGINT), t - 1) AS fe, t
    FROM (SELECT clip, t, unnest(range((t - 1) // 10 + 1)) AS n FROM (SELECT clip, count(DISTINCT frame) AS t FROM pose GROUP BY clip)))"""


def clip_segments(b):
    """Time ranges over the whole clip, one every ten frames, with frames cut to the clip."""
    clips = b.pose.groupBy("clip").agg(F.count(F.lit(1)).alias("t"))
    n = clips.withColumn("n", F.explode(F.sequence(F.lit(0), F.floor((F.col("t") - 1) / 10).cast("int"))))

    def frame(ms):
        return F.least(F.floor(ms * 25.0 / 1000).cast("long"), F.col("t") - 1)

    return n.select("clip", F.format_string("%d_%08d", "clip", F.col("n") * 400).alias("segment_id"),
                    frame(F.col("n") * 400).alias("frame_start"),
                    frame(F.col("n") * 400 + 350).alias("frame_end"), "t")


@query("a20_segment_export", f"""WITH {CUTS_SQL}, {COMPACT}
    SELECT segment_id, frame - fs AS rel, count(*) AS n_landmarks, round(sum(x * (idx + 1)), 3) AS weighted
    FROM small s JOIN cuts u ON u.clip = s.clip AND frame >= fs AND frame < fe WHERE fe > fs
    GROUP BY segment_id, rel""")
def segment_export(b):
    out = L.export_segments(b.pose, clip_segments(b).filter("frame_end > frame_start"))
    weighted = F.aggregate(F.transform("pts", lambda p, i: p["x"].cast("double") * (i + 1)), F.lit(0.0),
                           lambda a, v: a + v)
    return out.select("segment_id", "rel", F.size("pts").cast("long").alias("n_landmarks"),
                      F.round(weighted, 3).alias("weighted"))


@query("a21_sign_export", f"""WITH {CUTS_SQL}, sg AS (SELECT clip, segment_id AS pairing_id, upper('sign') || '-' || clip AS label,
      fs, least(fe + 20, t) AS fe FROM cuts WHERE fe + 20 > fs AND fs < t)
    SELECT pairing_id, label, frame - fs AS rel, round(sum(x), 3) AS total
    FROM pose s JOIN sg u ON u.clip = s.clip AND frame >= fs AND frame < fe GROUP BY ALL""")
def sign_export(b):
    signs = clip_segments(b).select(
        "clip", F.col("segment_id").alias("pairing_id"),
        F.concat(F.lit("SIGN-"), F.col("clip").cast("string")).alias("label"), "frame_start",
        F.least(F.col("frame_end") + 20, "t").alias("frame_end"), "t").filter(
        "frame_end > frame_start and frame_start < t")
    out = L.export_segments(b.pose, signs, None)
    total = F.aggregate(F.transform("pts", lambda p: p["x"].cast("double")), F.lit(0.0), lambda a, v: a + v)
    return out.select("pairing_id", "label", "rel", F.round(total, 3).alias("total"))


@query("a22_compaction", f"""WITH {COMPACT} SELECT clip, frame, count(*) AS n_landmarks, round(sum(z * (idx + 1)), 4) AS weighted
    FROM small GROUP BY clip, frame""")
def compaction(b):
    out = L.select_landmarks(b.pose, "compact")
    weighted = F.aggregate(F.transform("pts", lambda p, i: p["z"] * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    return out.select("clip", "frame", F.size("pts").cast("long").alias("n_landmarks"),
                      F.round(weighted, 4).alias("weighted"))


@query("a22_compaction_counts", """SELECT count(*) FILTER (n = 543) AS converted, count(*) FILTER (n <> 543) AS skipped
    FROM (SELECT clip, max(n) AS n FROM (SELECT clip, frame, count(*) AS n FROM pose GROUP BY ALL) GROUP BY clip)""")
def compaction_counts(b):
    clips = b.pose.groupBy("clip").agg(F.max(F.size("pts")).alias("n_landmarks"))
    return L.compaction_counts(clips)
