"""Queries over motion signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from tierloom.operators import signal as S
from tierloom.operators.signal import gaussian_kernel
from tierloom.plans.registry import query

SPEED_SQL = """speeds AS (SELECT *, CASE WHEN frame > 0 AND least(conf, lag(conf) OVER w) > 0.2
      THEN sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) ELSE CAST(0 AS DOUBLE) END AS speed
    FROM {src} WINDOW w AS (PARTITION BY {keys} ORDER BY frame))"""


def smooth_sql(sigma: float, keys: str) -> str:
    kernel = gaussian_kernel(sigma)
    r = len(kernel) // 2
    terms = [f"speed * CAST({kernel[r]!r} AS DOUBLE)"] + [
        f"(lag(speed, {k}, 0) OVER w + lead(speed, {k}, 0) OVER w) * CAST({kernel[r + k]!r} AS DOUBLE)"
        for k in range(1, r + 1)]
    return (f"smoothed AS (SELECT *, {' + '.join(terms)} AS smooth FROM speeds "
            f"WINDOW w AS (PARTITION BY {keys} ORDER BY frame))")


def detect_sql(src: str, keys: str, sigma: float, threshold: float) -> str:
    """Detection as a chain of CTEs ending in ``found``; fps 25 gives limits 3, 100 and 2."""
    return f"""{SPEED_SQL.format(src=src, keys=keys)}, {smooth_sql(sigma, keys)},
      peak AS (SELECT {keys}, quantile_cont(smooth, 0.99) AS p99 FROM smoothed GROUP BY {keys}),
      levels AS (SELECT s.*, smooth / p99 AS level, smooth / p99 > {threshold} AS act
        FROM smoothed s JOIN peak USING ({keys}) WHERE p99 >= 1e-6),
      active AS (SELECT *, frame - lag(frame) OVER (PARTITION BY {keys} ORDER BY frame) - 1 AS gap
        FROM levels WHERE act),
      islands AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 2 THEN 1 ELSE 0 END)
          OVER (PARTITION BY {keys} ORDER BY frame) AS isl FROM active),
      spans AS (SELECT {keys}, isl, min(frame) AS s, max(frame) + 1 AS e FROM islands
        GROUP BY {keys}, isl HAVING max(frame) + 1 - min(frame) BETWEEN 3 AND 100),
      found AS (SELECT {', '.join('sp.' + k.strip() for k in keys.split(','))},
          sp.s AS frame_start, sp.e AS frame_end,
          CAST(floor(sp.s * 1000 / 25.0) AS BIGINT) AS start_ms,
          CAST(floor(sp.e * 1000 / 25.0) AS BIGINT) AS end_ms,
          round_even(least(1.0, avg(l.level)), 3) AS score
        FROM spans sp JOIN levels l ON {' AND '.join(f'sp.{k.strip()} = l.{k.strip()}' for k in keys.split(','))}
          AND l.frame >= sp.s AND l.frame < sp.e GROUP BY ALL)"""


@query("c05_wrist_speed", f"""WITH {SPEED_SQL.format(src='signal', keys='clip')}
    SELECT clip, frame, round(speed, 6) AS speed FROM speeds""")
def wrist_speed(b):
    return S.wrist_speed(b.signal).withColumn("speed", F.round("speed", 6))


@query("c06_gaussian_smooth", f"""WITH {SPEED_SQL.format(src='signal', keys='clip')},
    {smooth_sql(3.0, 'clip')} SELECT clip, frame, round(smooth, 6) AS smooth FROM smoothed""")
def gaussian_smooth(b):
    return S.smoothed_speed(b.signal).select("clip", "frame", F.round("smooth", 6).alias("smooth"))


@query("c07_motion_energy", f"""WITH {SPEED_SQL.format(src='signal', keys='clip')},
    {smooth_sql(2.0, 'clip')} SELECT clip, frame, round(CASE WHEN m > 0 THEN smooth / m ELSE smooth END, 6)
      AS energy FROM (SELECT *, max(smooth) OVER (PARTITION BY clip) AS m FROM smoothed)""")
def motion_energy(b):
    return S.motion_energy(b.signal).withColumn("energy", F.round("energy", 6))


@query("c08_detect_segments", f"""WITH {detect_sql('signal', 'clip', 3.0, 0.15)}
    SELECT * FROM found""")
def detect_segments(b):
    return S.detect_segments(b.signal).drop("fps")


@query("c08_detect_segments_sensitive", f"""WITH {detect_sql('signal', 'clip', 1.0, 0.5)}
    SELECT * FROM found""")
def detect_segments_sensitive(b):
    return S.detect_segments(b.signal, sigma=1.0, threshold=0.5).drop("fps")
