"""Queries over whole jobs: training, retraining, batch inference and incremental ingest."""

from __future__ import annotations

from pyspark.sql import functions as F

from tierloom.operators import landmarks as L
from tierloom.operators import learning as LE
from tierloom.operators import matching as M
from tierloom.operators import progress as P
from tierloom.operators import search as SE
from tierloom.functions.text import file_stem
from tierloom.operators.label_sets import split_per_label
from tierloom.plans import metric_queries as MQ
from tierloom.plans.augment_queries import small_clips
from tierloom.plans.cue_queries import MERGED_SQL, clips
from tierloom.plans.join_queries import HARVEST_SQL, harvested
from tierloom.plans.registry import query
from tierloom.plans.signal_queries import detect_sql
from tierloom.session import new_folder
from tierloom.sources.subtitles import vtt_files, write_webvtt
from tierloom.streaming import incremental as ST


@query("j06_train_baseline")
def train_baseline(b):
    rows = split_per_label(MQ.vectors(b), "id")
    return LE.train_baseline(rows).classes


@query("j07_retrain_cycle")
def retrain_cycle(b):
    clips_ = small_clips(b)
    pairings = clips_.groupBy("clip", "label").agg(F.count(F.lit(1)).alias("t")).select(
        F.concat(F.lit("p"), F.col("clip").cast("string")).alias("pairing_id"), "clip", F.concat(F.lit("SIGN-"), F.col("label").cast("string")).alias("gloss_id"),
        F.lit(0).cast("long").alias("sign_frame_start"), F.col("t").alias("sign_frame_end"), F.lit("paired").alias("status"))
    return LE.retrain_cycle(pairings, clips_.select("clip", "frame", "pts")).metrics


SUPPORT_SQL = """n - greatest(1, CAST(floor(n * 0.8::DOUBLE) AS BIGINT)) - CAST(floor(n * 0.1::DOUBLE) AS BIGINT) AS support"""


@query("j06_test_supports", f"SELECT 'L' || label AS label, {SUPPORT_SQL} FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY 1)")
def test_supports(b):
    return train_baseline(b).select("label", "support")


@query("j07_test_samples", f"SELECT CAST(sum(support) AS BIGINT) AS n_samples FROM (SELECT {SUPPORT_SQL} FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY label HAVING count(*) >= 3))")
def test_samples(b):
    return retrain_cycle(b).select("n_samples")


FEATURES = "CAST(x AS DOUBLE) / 100, y / 100, conf"
INFER_SQL = f"""WITH {detect_sql('signal', 'clip', 1.0, 0.5)}, ok AS (SELECT clip FROM (SELECT clip, count(*) * 200 AS bytes FROM signal GROUP BY clip) WHERE bytes >= 13000),
    fr AS (SELECT clip, frame, event_type, x / 100 AS f1, y / 100 AS f2, conf AS f3 FROM signal), cent AS (SELECT event_type AS label, avg(f1) AS c1, avg(f2) AS c2, avg(f3) AS c3 FROM fr GROUP BY 1),
    seg AS (SELECT f.clip, f.start_ms, f.end_ms, f.score, avg(f1) AS v1, avg(f2) AS v2, avg(f3) AS v3 FROM found f JOIN ok USING (clip) JOIN fr ON fr.clip = f.clip AND frame >= frame_start AND frame < frame_end GROUP BY ALL),
    sc AS (SELECT seg.*, label, v1 * c1 + v2 * c2 + v3 * c3 AS s FROM seg, cent), rk AS (SELECT *, row_number() OVER (PARTITION BY clip, start_ms ORDER BY s DESC, label) AS r, exp(s) / sum(exp(s)) OVER (PARTITION BY clip, start_ms) AS p FROM sc)"""


def inference(b):
    sig = b.hand_signal_table
    feats = sig.select("clip", "frame", "event_type", F.array(F.col("x") / 100, F.col("y") / 100, F.col("conf")).alias("features"))
    centres = SE.centroids(feats.select(F.col("event_type").alias("label"), F.col("features").alias("vector")))
    files = sig.groupBy(F.col("clip").alias("stem")).agg((F.count(F.lit(1)) * 200).alias("bytes"))
    return LE.batch_inference(files.select("stem"), files, sig, feats.select("clip", "frame", "features"), centres, 13_000, sigma=1.0, threshold=0.5)


@query("j08_batch_inference", f"""{INFER_SQL} SELECT clip AS stem, CASE WHEN clip % 2 = 0 THEN 'right' ELSE 'left' END AS hand, start_ms, end_ms, score AS motion_confidence, label AS predicted_gloss, round_even(p, 4) AS confidence FROM rk WHERE r = 1""")
def batch_inference(b):
    return inference(b)[0].drop("top3")


@query("j08_batch_totals", f"""{INFER_SQL} SELECT (SELECT count(*) FROM ok) AS n_processed, (SELECT count(DISTINCT clip) FROM signal) - (SELECT count(*) FROM ok) AS n_skipped, CAST(0 AS BIGINT) AS n_errors, (SELECT count(*) FROM seg) AS total_predictions""")
def batch_totals(b):
    return inference(b)[2]


# The batch build over all files at once: trimmed cues of videos with a pose, both merges, alignment.
ALL_AT_ONCE_SQL = MERGED_SQL.replace(
    MERGED_SQL[MERGED_SQL.index("src0 AS ("):MERGED_SQL.index(", walk AS")],
    "src0 AS (SELECT stem, row_number() OVER (PARTITION BY stem ORDER BY start_ms, cue_no) - 1 AS cue_no, start_ms, end_ms, trim(text) AS text "
    "FROM cues WHERE trim(text) <> '' AND stem IN (SELECT stem FROM clips WHERE bytes > 0))")


@query("l01_incremental_alignment", f"SELECT * REPLACE (CAST(stem AS VARCHAR) AS stem) FROM ({ALL_AT_ONCE_SQL})")
def incremental_alignment(b):
    out, work, feed = (new_folder(b.spark, n) for n in ("aligned", "stream", "feed"))
    poses = clips(b).withColumn("stem", F.col("stem").cast("string"))
    inventory = poses.select("stem")
    at_once = max(1, b.cues.select("stem").distinct().count() // 3)
    # The first start meets half of the files and half of the poses; files without a pose wait for the second.
    for name, half, ready in (("one", 0, poses.filter(F.pmod(F.xxhash64("stem"), F.lit(2)) == 0)), ("two", 1, poses)):
        write_webvtt(b.cues.filter(F.pmod(F.hash("stem"), F.lit(2)) == half), f"{feed}/{name}")
        found = b.spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", "*.vtt").option(
            "maxFilesPerTrigger", at_once).load(f"{feed}/*")
        files = vtt_files(found).select(file_stem("path").alias("stem"), "path", F.lit("soft").alias("kind"), F.lit("sk").alias("lang"), "content")
        ST.align_new_files(files, inventory, ready, out, work).awaitTermination()
    return ST.aligned(b.spark, out)


# The first wave adds the first line of every key; of the second, which has other words, only new keys are added.
SIGN_WAVES_SQL = f"""WITH {HARVEST_SQL}, w AS (SELECT *, stem % 3 AS third, row_number() OVER (PARTITION BY stem, start_ms, hand ORDER BY item_no) AS rn FROM harvested)
    SELECT stem, start_ms AS sign_start_ms, hand, item_no, CASE WHEN third = 2 THEN 'late ' ELSE '' END || w2 AS word FROM w WHERE rn = 1"""


@query("l02_incremental_signs", SIGN_WAVES_SQL)
def incremental_signs(b):
    out, work, feed = (new_folder(b.spark, n) for n in ("signs", "stream", "feed"))
    rows = harvested(b).select("stem", "sign_start_ms", "hand", "word", "item_no")
    late = rows.withColumn("word", F.concat(F.lit("late "), "word"))
    for number, wave in enumerate((rows.filter("stem % 3 < 2"), late)):
        wave.repartition(4, "stem").write.parquet(f"{feed}/wave={number}")
        stream = b.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{feed}/wave=*")
        ST.merge_new_signs(stream, out, work).awaitTermination()
    return b.spark.read.schema(rows.schema).parquet(out)
