"""Queries over gates, to-do lists and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tierloom.functions import text as T
from tierloom.operators import gates as GT
from tierloom.operators import label_sets as LS
from tierloom.operators import matching as M
from tierloom.operators.cues import alignment_totals, merge_near_duplicates
from tierloom.plans.registry import query
from tierloom.plans.text_queries import FIRST_SQL, NORM_WORD, placed_stems, SOURCES_SQL
from tierloom.session import checkpointed

# -- label support --------------------------------------------------------------------


@query("e01_quality_filter", r"""WITH n AS (SELECT segment_id, regexp_replace(lower(label), '_\d+$', '') AS label, label AS label_original FROM manifest
      WHERE segment_id % 11 <> 0)
    SELECT * FROM n WHERE label IN (SELECT label FROM n GROUP BY label HAVING count(*) >= 25)""")
def quality_filter(b):
    rows = b.manifest.withColumn("label", F.when(F.col("segment_id") % 11 == 0, "  ").otherwise(F.col("label")))
    return LS.quality_filter(rows, 25).select("segment_id", "label", "label_original")


@query("e01_minimum_samples", """SELECT segment_id, label FROM manifest WHERE label IN (SELECT label FROM manifest GROUP BY label HAVING count(*) >= 3)""")
def minimum_samples(b):
    return LS.keep_supported(b.manifest).select("segment_id", "label")


@query("e02_quality_preview", r"""WITH c AS (SELECT regexp_replace(lower(label), '_\d+$', '') AS label, count(*) AS n FROM manifest GROUP BY 1)
    SELECT count(*) AS labels_before, count(*) FILTER (n >= 30) AS labels_after, CAST(coalesce(sum(n) FILTER (n >= 30), 0) AS BIGINT) AS segments_after FROM c""")
def quality_preview(b):
    return LS.quality_preview(b.manifest, 30)


@query("e03_supported_by_train", """WITH c AS (SELECT label FROM manifest WHERE segment_id % 4 <> 0 GROUP BY label HAVING count(*) >= 2)
    SELECT segment_id, label, CASE WHEN segment_id % 4 <> 0 THEN 'train' ELSE 'val' END AS split FROM manifest WHERE label IN (SELECT label FROM c)""")
def supported_by_train(b):
    rows = b.manifest.select("segment_id", "label")
    return LS.supported_by_train(rows.filter("segment_id % 4 <> 0"), rows.filter("segment_id % 4 = 0"), 2)


# -- files and readiness ----------------------------------------------------------------

FILES_SQL = """f AS (SELECT o_orderkey AS stem, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(floor(o_totalprice / 10) AS BIGINT) END AS bytes FROM orders WHERE o_orderstatus <> 'P')"""


def pose_files(b):
    price = F.floor(F.col("o_totalprice") / 10).cast("long")
    return b.table("orders").filter("o_orderstatus <> 'P'").select(
        F.col("o_orderkey").alias("stem"), F.when(F.col("o_orderkey") % 13 != 0, price).alias("bytes"))


@query("e04_small_files", f"""WITH {FILES_SQL} SELECT stem, coalesce(bytes, -1) AS bytes FROM f WHERE coalesce(bytes, -1) < 10000""")
def small_files(b):
    return GT.small_files(pose_files(b))


@query("e05_batch_eligibility", f"""WITH {FILES_SQL}, l AS (SELECT l_orderkey AS stem, count(*) AS n FROM lineitem WHERE l_quantity > 25 GROUP BY 1),
    r AS (SELECT o_orderkey AS stem, CASE WHEN f.stem IS NULL THEN 'No pose file' WHEN bytes IS NULL THEN 'Cannot stat pose file'
      WHEN bytes < 10000 THEN 'Pose file too small (' || bytes || ' bytes)' END AS reason, n FROM orders LEFT JOIN f ON f.stem = o_orderkey LEFT JOIN l ON l.stem = o_orderkey)
    SELECT stem, CASE WHEN reason IS NULL THEN 'ok' ELSE 'skipped' END AS status, reason, CASE WHEN reason IS NULL THEN coalesce(n, 0) END AS n_segments FROM r""")
def batch_eligibility(b):
    videos = b.table("orders").select(F.col("o_orderkey").alias("stem"))
    segments = b.table("lineitem").filter("l_quantity > 25").select(F.col("l_orderkey").alias("stem"))
    return GT.batch_eligibility(videos, pose_files(b), segments)


@query("e06_pair_readiness", """SELECT o_orderkey AS stem, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A') AS has_pose,
      o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AS has_vtt,
      o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A') AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AS paired FROM orders""")
def pair_readiness(b):
    items = b.table("lineitem").select(F.col("l_orderkey").alias("stem"), "l_returnflag")
    return GT.readiness(b.table("orders").select(F.col("o_orderkey").alias("stem")),
                        pose=items.filter("l_returnflag = 'A'"), vtt=items.filter("l_returnflag = 'R'"))


@query("e07_segment_filters", """SELECT d.doc_id, d.source, CASE WHEN quality = 1 THEN 'approved' ELSE 'skipped' END AS status
    FROM documents d JOIN labels USING (doc_id) WHERE quality = 1 AND contains(lower(source), 'src1')""")
def segment_filters(b):
    rows = b.table("documents").join(b.table("labels"), "doc_id").select(
        "doc_id", "source", F.when(F.col("quality") == 1, "approved").otherwise("skipped").alias("status"))
    return GT.filter_segments(rows, "approved", "SRC1")


@query("e08_remaining_entries", """SELECT p_partkey AS word_id, p_name AS translation, p_type AS word_class FROM part WHERE p_size % 5 <> 0 AND p_type IN ('ECONOMY', 'PROMO')
    AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48) ORDER BY p_partkey LIMIT 100""")
def remaining_entries(b):
    entries = b.table("part").select(F.col("p_partkey").alias("word_id"), F.when(F.col("p_size") % 5 == 0, " ").otherwise(F.col("p_name")).alias("translation"),
                                     F.col("p_type").alias("word_class"))
    done = b.table("lineitem").filter("l_quantity > 48").select(F.col("l_partkey").alias("word_id"))
    return GT.remaining_entries(entries, done, ["ECONOMY", "PROMO"], 100)


@query("e09_dual_view_todo", """WITH o AS (SELECT l_orderkey AS stem, CASE WHEN l_suppkey % 2 = 0 THEN '60' ELSE '90' END AS v, CAST(l_quantity * 5 AS BIGINT) AS bytes FROM lineitem)
    SELECT o_orderkey AS stem FROM orders WHERE o_orderkey NOT IN (SELECT stem FROM o WHERE bytes > 100 GROUP BY stem HAVING count(DISTINCT v) = 2)""")
def dual_view_todo(b):
    view = F.when(F.col("l_suppkey") % 2 == 0, "_60").otherwise("_90")
    outputs = b.table("lineitem").select(F.concat(F.col("l_orderkey").cast("string"), view).alias("name"), (F.col("l_quantity") * 5).cast("long").alias("bytes"))
    videos = b.table("orders").select(F.col("o_orderkey").cast("string").alias("stem"))
    return GT.dual_view_todo(videos, outputs).select(F.col("stem").cast("long").alias("stem"))


@query("e10_generic_videos", """SELECT p_brand AS video_id, p_name AS label, p_partkey FROM part WHERE p_brand IN (SELECT p_brand FROM part GROUP BY p_brand HAVING count(DISTINCT p_name) <= 48)""")
def generic_videos(b):
    rows = b.table("part").select(F.col("p_brand").alias("video_id"), F.col("p_name").alias("label"), "p_partkey")
    return GT.without_generic(rows, 48)


@query("e11_word_videos", """SELECT CAST(l_partkey AS VARCHAR) AS word_id, l_partkey || '_wd_60_' || l_orderkey AS name, p_name AS word
    FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_linestatus = 'O' AND p_size < 25""")
def word_videos(b):
    kind = F.when(F.col("l_linestatus") == "O", "wd").otherwise("st")
    files = b.table("lineitem").select(F.concat_ws("_", F.col("l_partkey").cast("string"), kind, F.lit("60"), F.col("l_orderkey").cast("string")).alias("name"))
    words = b.table("part").filter("p_size < 25").select(F.col("p_partkey").cast("string").alias("word_id"), F.col("p_name").alias("word"))
    return GT.word_videos(files, words)


@query("e12_output_state", """SELECT o_orderkey AS stem, CASE WHEN m IS NULL THEN 'missing' WHEN m = 0 THEN 'failed' ELSE 'done' END AS state
    FROM orders LEFT JOIN (SELECT l_orderkey, max(CAST(l_discount * 100 AS BIGINT) // 5) AS m FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def output_state(b):
    outputs = b.table("lineitem").select(F.col("l_orderkey").alias("stem"), F.floor(F.round(F.col("l_discount") * 100) / 5).cast("long").alias("bytes"))
    return GT.output_state(b.table("orders").select(F.col("o_orderkey").alias("stem")), outputs)


@query("e12_pose_without_annotation", """SELECT DISTINCT o_orderkey AS stem FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def pose_without_annotation(b):
    return GT.pose_without_annotation(b.table("orders").select(F.col("o_orderkey").alias("stem")), b.table("lineitem").select(F.col("l_orderkey").alias("stem")))


# -- inventory and harvest ----------------------------------------------------------------

INV_SQL = """inv AS (SELECT stem, arg_max(path, row_no) AS path, arg_max(fps, row_no) AS fps FROM (SELECT o_orderkey // 2 * 2 AS stem, o_orderkey AS row_no,
    '/v/' || o_orderkey || '.mp4' AS path, CAST(20 + o_custkey % 11 AS DOUBLE) AS fps FROM orders WHERE o_orderstatus <> 'P') GROUP BY stem)"""


def inventory(b):
    key = F.col("o_orderkey")
    return b.table("orders").filter("o_orderstatus <> 'P'").select(
        (F.floor(key / 2) * 2).cast("long").alias("stem"), key.alias("row_no"), F.format_string("/v/%d.mp4", key).alias("path"),
        (20 + F.col("o_custkey") % 11).cast("double").alias("fps"))


@query("f01_inventory_lookup", f"""WITH {INV_SQL} SELECT p.stem, line_no, path, fps FROM pairings p JOIN inv USING (stem)""")
def inventory_lookup(b):
    return M.lookup_inventory(b.pairings, inventory(b)).select("stem", "line_no", "path", "fps")


@query("f02_skip_known", """SELECT stem, line_no FROM pairings WHERE stem NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def skip_known(b):
    known = b.table("orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("stem"))
    return M.skip_known(b.pairings, known).select("stem", "line_no")


TIER = "CASE WHEN suppkey % 5 = 0 THEN 'S1_Mouthing' WHEN hand = 'right' THEN 'S1_Gloss_RH' ELSE 'S1_Gloss_LH' END"
VALUE = "CASE partkey % 4 WHEN 0 THEN ' ' WHEN 1 THEN upper(word) || '-1' WHEN 2 THEN ' ' || word ELSE word || 'x' END"
HARVEST_SQL = f"""{INV_SQL}, {FIRST_SQL}, ann AS (SELECT *, trim({VALUE}) AS v, {TIER} AS tier, partkey * 8 + line_no AS item_no FROM pairings),
  harvested AS (SELECT a.*, path, fps, CASE WHEN regexp_matches(v, '^[A-Z][A-Z0-9_-]+$') THEN '' ELSE lower(v) END AS w2,
      CASE WHEN regexp_matches(v, '^[A-Z][A-Z0-9_-]+$') THEN v ELSE coalesce(g, '') END AS gl
    FROM ann a JOIN inv USING (stem) LEFT JOIN first_gloss ON key = {NORM_WORD.format('v')} AND NOT regexp_matches(v, '^[A-Z][A-Z0-9_-]+$')
    WHERE v <> '' AND tier <> 'S1_Mouthing')"""


def annotations(b):
    p = b.pairings.withColumn("item_no", F.col("partkey") * 8 + F.col("line_no"))
    return p.select("stem", "item_no", F.expr(TIER).alias("tier"), F.expr(VALUE).alias("value"), "start_ms", "end_ms")


def harvested(b):
    return M.harvest_glosses(annotations(b), inventory(b), b.glossary)


@query("f03_harvest_glosses", f"""WITH {HARVEST_SQL} SELECT stem || '_' || lpad(CAST(start_ms AS VARCHAR), 8, '0') || '_' || left(hand, 1) || '_E' AS pairing_id,
      stem || '_eaf' AS segment_id, stem, path AS video_path, hand, start_ms AS sign_start_ms, end_ms AS sign_end_ms,
      CAST(floor(start_ms * fps / 1000) AS BIGINT) AS sign_frame_start, CAST(floor(end_ms * fps / 1000) AS BIGINT) AS sign_frame_end,
      w2 AS word, gl AS gloss_id, 'paired' AS status, fps, 'eaf_harvest' AS note FROM harvested""")
def harvest_glosses(b):
    return harvested(b).drop("item_no")


NEW_SQL = """fresh AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY stem, start_ms, hand ORDER BY item_no) AS rn FROM harvested) WHERE rn = 1
    AND (stem, start_ms, hand) NOT IN (SELECT (stem, start_ms, hand) FROM pairings WHERE flag = 'R'))"""


def existing_signs(b):
    return b.pairings.filter("flag = 'R'").select("stem", F.col("start_ms").alias("sign_start_ms"), "hand")


@query("f06_merge_harvest", f"WITH {HARVEST_SQL}, {NEW_SQL} SELECT stem, start_ms AS sign_start_ms, hand, w2 AS word, gl AS gloss_id FROM fresh")
def merge_harvest(b):
    return M.merge_harvest(existing_signs(b), harvested(b)).select("stem", "sign_start_ms", "hand", "word", "gloss_id")


@query("g17_harvest_counts", f"""WITH {HARVEST_SQL}, {NEW_SQL} SELECT (SELECT count(*) FROM orders) AS n_files_scanned, (SELECT count(DISTINCT stem) FROM harvested) AS n_with_annotations,
      (SELECT count(*) FROM fresh) AS n_new, (SELECT count(*) FROM harvested) - (SELECT count(*) FROM fresh) AS n_skipped_dupes""")
def harvest_counts(b):
    h = harvested(b)
    return M.harvest_counts(b.table("orders"), h, M.merge_harvest(existing_signs(b), h))


# -- predictions ---------------------------------------------------------------------------

PAIR_ROWS = """SELECT stem || '_' || line_no AS pairing_id, stem AS segment_id, hand, start_ms AS sign_start_ms, CASE WHEN flag = 'N' THEN 'pending' ELSE 'paired' END AS status,
    word, upper(word) || '-9' AS gloss_id, '' AS suggestion_gloss, CAST(0 AS DOUBLE) AS suggestion_confidence, line_no, partkey FROM pairings"""


def pairing_rows(b):
    return b.pairings.select(
        F.concat_ws("_", F.col("stem").cast("string"), F.col("line_no").cast("string")).alias("pairing_id"), F.col("stem").alias("segment_id"), "hand",
        F.col("start_ms").alias("sign_start_ms"), F.when(F.col("flag") == "N", "pending").otherwise("paired").alias("status"), "word",
        F.concat(F.upper("word"), F.lit("-9")).alias("gloss_id"), F.lit("").alias("suggestion_gloss"), F.lit(0.0).alias("suggestion_confidence"), "line_no", "partkey")


@query("f07_merge_suggestions", f"""WITH p AS ({PAIR_ROWS}), pr AS (SELECT segment_id, hand, sign_start_ms, max(partkey % 100 / 100.0::DOUBLE) AS conf,
        arg_max(upper(word) || '-1', (partkey % 100, upper(word))) AS g FROM p WHERE partkey % 3 <> 0 GROUP BY ALL),
    s AS (SELECT o_orderkey AS segment_id, 'new cold ' || CASE WHEN o_orderkey % 2 = 0 THEN 'Red, gear' ELSE 'small Ring' END AS text FROM orders),
    t AS (SELECT segment_id, ws[i] AS raw, i FROM (SELECT segment_id, string_split(text, ' ') AS ws FROM s), LATERAL (SELECT unnest(range(1, len(ws) + 1)) AS i)),
    gw AS (SELECT segment_id, gloss_id, arg_min(raw, i) AS raw FROM t JOIN glossary ON form = {NORM_WORD.format('raw')} GROUP BY ALL),
    j AS (SELECT p.*, CASE WHEN p.status = 'pending' THEN g END AS g, conf FROM p LEFT JOIN pr USING (segment_id, hand, sign_start_ms))
    SELECT pairing_id, j.segment_id, hand, sign_start_ms, CASE WHEN raw IS NOT NULL THEN 'auto_suggested' ELSE status END AS status, coalesce(raw, word) AS word,
      CASE WHEN raw IS NOT NULL THEN g ELSE j.gloss_id END AS gloss_id, coalesce(g, '') AS suggestion_gloss, CASE WHEN g IS NULL THEN 0 ELSE conf END AS suggestion_confidence
    FROM j LEFT JOIN gw ON gw.segment_id = j.segment_id AND gw.gloss_id = j.g""")
def merge_suggestions(b):
    p = pairing_rows(b)
    predictions = p.filter("partkey % 3 <> 0").select("segment_id", "hand", F.col("sign_start_ms").alias("start_ms"),
                                                      F.concat(F.upper("word"), F.lit("-1")).alias("predicted_gloss"), (F.col("partkey") % 100 / F.lit(100.0)).alias("confidence"))
    key = F.col("o_orderkey")
    text = F.concat(F.lit("new cold "), F.when(key % 2 == 0, "Red, gear").otherwise("small Ring"))
    sentences = b.table("orders").select(key.alias("segment_id"), text.alias("text"))
    return M.merge_suggestions(p.drop("line_no", "partkey"), predictions, sentences, b.glossary)


ANN_SQL = """ann AS (SELECT stem, partkey * 8 + line_no AS ann_no, CASE partkey % 4 WHEN 0 THEN 'AI_Gloss_RH' WHEN 1 THEN 'AI_Gloss_LH' ELSE 'AI_Confidence' END AS tier,
    CAST(suppkey % 4 * 100 AS BIGINT) AS start_ms, CAST(suppkey % 4 * 100 + 50 + partkey % 3 AS BIGINT) AS end_ms,
    CASE WHEN partkey % 4 < 2 THEN CASE WHEN partkey % 16 < 2 THEN ' ' ELSE word END WHEN partkey % 5 = 0 THEN 'bad' ELSE '0.' || partkey END AS value FROM pairings)"""


def ai_annotations(b):
    n = F.col("partkey") % 4
    text = F.when(F.col("partkey") % 16 < 2, " ").otherwise(F.col("word"))
    conf = F.when(F.col("partkey") % 5 == 0, "bad").otherwise(F.concat(F.lit("0."), F.col("partkey").cast("string")))
    return b.pairings.select(
        "stem", (F.col("partkey") * 8 + F.col("line_no")).alias("ann_no"), F.when(n == 0, "AI_Gloss_RH").when(n == 1, "AI_Gloss_LH").otherwise("AI_Confidence").alias("tier"),
        (F.col("suppkey") % 4 * 100).alias("start_ms"), (F.col("suppkey") % 4 * 100 + 50 + F.col("partkey") % 3).alias("end_ms"), F.when(n < 2, text).otherwise(conf).alias("value"))


@query("f08_confidence_match", f"""WITH {ANN_SQL}, c AS (SELECT *, coalesce(TRY_CAST(value AS DOUBLE), 0) AS v FROM ann WHERE tier = 'AI_Confidence'),
    ex AS (SELECT stem, start_ms, end_ms, arg_max(v, ann_no) AS v FROM c GROUP BY ALL), ne AS (SELECT stem, start_ms, arg_max(v, ann_no) AS v FROM c GROUP BY ALL)
    SELECT a.stem, CASE tier WHEN 'AI_Gloss_RH' THEN 'right' ELSE 'left' END AS hand, ann_no, a.start_ms, a.end_ms, trim(value) AS predicted_gloss, coalesce(ex.v, ne.v, 0) AS confidence
    FROM ann a LEFT JOIN ex USING (stem, start_ms, end_ms) LEFT JOIN ne ON ne.stem = a.stem AND ne.start_ms = a.start_ms WHERE tier <> 'AI_Confidence' AND trim(value) <> ''""")
def confidence_match(b):
    return M.predictions_of_tiers(ai_annotations(b))


PREDS_SQL = """preds AS (SELECT clip // 2 AS stem, frame * 2 + clip % 2 AS item_no, hand, frame * 800 + k * 5 AS start_ms, frame * 800 + k * 5 + 150 + CAST(floor(x) AS BIGINT) AS end_ms,
    event_type AS predicted_gloss, conf AS confidence, CASE event_type WHEN 'view' THEN 'approved' WHEN 'click' THEN 'skipped' ELSE 'pending' END AS review_status FROM hand_signal)"""


def hand_predictions(b):
    start = F.col("frame") * 800 + F.col("k") * 5
    status = F.when(F.col("event_type") == "view", "approved").when(F.col("event_type") == "click", "skipped").otherwise("pending")
    return b.hand_signal.select(
        F.floor(F.col("clip") / 2).alias("stem"), (F.col("frame") * 2 + F.col("clip") % 2).alias("item_no"), "hand", start.alias("start_ms"),
        (start + 150 + F.floor("x")).alias("end_ms"), F.col("event_type").alias("predicted_gloss"), F.col("conf").alias("confidence"), status.alias("review_status"))


@query("f09_overlap_candidates", f"""WITH {PREDS_SQL} SELECT r.stem, r.item_no AS right_no, l.item_no AS left_no, r.start_ms AS rs, least(r.end_ms, l.end_ms) - greatest(r.start_ms, l.start_ms) AS overlap_ms
    FROM preds r JOIN preds l ON r.stem = l.stem AND r.hand = 'right' AND l.hand = 'left' AND least(r.end_ms, l.end_ms) - greatest(r.start_ms, l.start_ms) >= 100""")
def overlap_candidates(b):
    return M.overlap_candidates(hand_predictions(b))


UNITS_SQL = f"""WITH RECURSIVE {PREDS_SQL}, cand AS (SELECT r.stem, r.item_no AS right_no, l.item_no AS left_no, least(r.end_ms, l.end_ms) - greatest(r.start_ms, l.start_ms) AS o
      FROM preds r JOIN preds l ON r.stem = l.stem AND r.hand = 'right' AND l.hand = 'left' AND least(r.end_ms, l.end_ms) - greatest(r.start_ms, l.start_ms) >= 100),
    best AS (SELECT stem, right_no, list(left_no ORDER BY o DESC, left_no) AS lefts FROM cand GROUP BY ALL),
    rh AS (SELECT b.*, row_number() OVER (PARTITION BY b.stem ORDER BY p.start_ms, b.right_no) AS n FROM best b JOIN preds p ON p.stem = b.stem AND p.item_no = b.right_no),
    walk AS (SELECT stem, n, right_no, lefts[1] AS taken, [lefts[1]] AS used FROM rh WHERE n = 1
      UNION ALL SELECT stem, n, right_no, free, CASE WHEN free IS NULL THEN used ELSE list_append(used, free) END
        FROM (SELECT r.stem, r.n, r.right_no, w.used, [x FOR x IN r.lefts IF NOT list_contains(w.used, x)][1] AS free FROM walk w JOIN rh r ON r.stem = w.stem AND r.n = w.n + 1)),
    pairs AS (SELECT stem, right_no, taken AS left_no FROM walk WHERE taken IS NOT NULL)
    SELECT p.stem, p.item_no, l.item_no AS left_no, CASE WHEN l.item_no IS NOT NULL THEN 'RH+LH' WHEN p.hand = 'right' THEN 'RH' ELSE 'LH' END AS hands,
      least(p.start_ms, coalesce(l.start_ms, p.start_ms)) AS start_ms, greatest(p.end_ms, coalesce(l.end_ms, p.end_ms)) AS end_ms, p.predicted_gloss AS primary_gloss, p.confidence AS primary_confidence,
      CASE WHEN l.item_no IS NULL OR p.review_status = l.review_status THEN p.review_status ELSE 'pending' END AS review_status
    FROM preds p LEFT JOIN pairs q ON q.stem = p.stem AND q.right_no = p.item_no LEFT JOIN preds l ON l.stem = q.stem AND l.item_no = q.left_no
    WHERE (p.stem, p.item_no) NOT IN (SELECT (stem, left_no) FROM pairs)"""


@query("f09_two_hand_units", UNITS_SQL)
def two_hand_units(b):
    preds = checkpointed(hand_predictions(b))
    return M.review_units(preds, M.pair_hands(preds))


CLUSTER_SQL = f"""WITH RECURSIVE {PREDS_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY start_ms, item_no) AS n FROM preds),
    fwd AS (SELECT stem, item_no, CAST(0 AS BIGINT) AS n, start_ms AS lo, end_ms AS hi FROM o
      UNION ALL SELECT f.stem, f.item_no, p.n, f.lo, greatest(f.hi, p.end_ms) FROM fwd f JOIN o p ON p.stem = f.stem AND p.n = f.n + 1 WHERE p.start_ms <= f.hi + 15000 AND p.end_ms - f.lo <= 45000),
    grown AS (SELECT stem, item_no, max(lo) AS lo, max(hi) AS hi FROM fwd GROUP BY ALL), top AS (SELECT stem, max(n) AS last FROM o GROUP BY stem),
    bwd AS (SELECT stem, item_no, last + 1 AS n, lo, hi FROM grown JOIN top USING (stem)
      UNION ALL SELECT b.stem, b.item_no, p.n, least(b.lo, p.start_ms), b.hi FROM bwd b JOIN o p ON p.stem = b.stem AND p.n = b.n - 1 WHERE p.end_ms >= b.lo - 15000 AND b.hi - p.start_ms <= 45000)
    SELECT stem, item_no, min(lo) AS cluster_start_ms, max(hi) AS cluster_end_ms FROM bwd GROUP BY ALL"""


@query("f10_prediction_clusters", CLUSTER_SQL)
def prediction_clusters(b):
    return M.prediction_clusters(hand_predictions(b))


@query("f11_review_status", f"""WITH {PREDS_SQL}, pg AS (SELECT *, row_number() OVER (ORDER BY stem, item_no) AS row_no FROM preds WHERE item_no % 3 <> 0),
    st AS (SELECT stem, hand, start_ms, arg_max(CASE item_no % 4 WHEN 0 THEN 'paired' WHEN 1 THEN 'skipped' ELSE 'pending' END, row_no) AS status FROM pg GROUP BY ALL)
    SELECT p.stem, p.item_no, CASE status WHEN 'paired' THEN 'approved' WHEN 'skipped' THEN 'skipped' ELSE 'pending' END AS review_status FROM preds p LEFT JOIN st USING (stem, hand, start_ms)""")
def review_status(b):
    return reviewed_predictions(b).select("stem", "item_no", "review_status")


def reviewed_predictions(b):
    preds = hand_predictions(b)
    n = F.col("item_no") % 4
    # Trimmed reviews carry the start of their prediction in the id, the others in the start column.
    in_id = F.col("item_no") % 2 == 0
    reviews = preds.filter("item_no % 3 <> 0").select(
        "stem", "hand", (F.col("stem") * 1_000_000 + F.col("item_no")).alias("row_no"),
        T.pairing_id("stem", "start_ms", "hand", F.when(in_id, "R").otherwise("E")).alias("pairing_id"),
        F.when(in_id, F.col("start_ms") + 7).otherwise(F.col("start_ms")).alias("sign_start_ms"),
        F.when(n == 0, "paired").when(n == 1, "skipped").otherwise("pending").alias("status"))
    return M.review_status(preds, reviews)


@query("f11_reviewed_per_video", f"""WITH {PREDS_SQL} SELECT stem, count(*) AS n_predictions, count(*) FILTER (review_status <> 'pending') AS n_reviewed FROM preds GROUP BY stem""")
def reviewed_per_video(b):
    return M.reviewed_per_video(hand_predictions(b))


@query("f12_upsert", f"""WITH p AS ({PAIR_ROWS}), c AS (SELECT pairing_id, word || '!' AS word FROM p WHERE partkey % 4 = 0 UNION ALL SELECT 'new_' || o_orderkey, 'added' FROM orders WHERE o_orderstatus = 'F')
    SELECT pairing_id, word FROM p WHERE pairing_id NOT IN (SELECT pairing_id FROM c) UNION ALL SELECT pairing_id, max(word) FROM c GROUP BY pairing_id""")
def upsert(b):
    p = pairing_rows(b)
    changed = p.filter("partkey % 4 = 0").select("pairing_id", F.concat("word", F.lit("!")).alias("word"))
    added = b.table("orders").filter("o_orderstatus = 'F'").select(F.format_string("new_%d", "o_orderkey").alias("pairing_id"), F.lit("added").alias("word"))
    changes = changed.unionByName(added).withColumn("n", F.col("word"))
    return M.upsert(p.select("pairing_id", "word"), changes, order="n")


@query("f12_undo", """WITH h AS (SELECT l_orderkey AS pairing_id, l_linenumber * 100000 + l_partkey AS version, l_suppkey AS word FROM lineitem),
    r AS (SELECT *, dense_rank() OVER (PARTITION BY pairing_id ORDER BY version DESC) AS k FROM h) SELECT pairing_id, max(word) AS word FROM r WHERE k = 2 GROUP BY pairing_id""")
def undo(b):
    history = b.table("lineitem").select(F.col("l_orderkey").alias("pairing_id"), (F.col("l_linenumber") * 100000 + F.col("l_partkey")).alias("version"), F.col("l_suppkey").alias("word"))
    return M.undo(history)


@query("f13_manual_pairings", """SELECT CASE WHEN ok THEN stem || '_' || lpad(CAST(start_ms AS VARCHAR), 8, '0') || '_' || left(h, 1) || '_M' || n END AS pairing_id, item_no, CAST(floor(start_ms * 25.0 / 1000) AS BIGINT) AS sign_frame_start,
      CASE WHEN NOT ok THEN 'hand must be right or left' END AS error
    FROM (SELECT *, row_number() OVER (PARTITION BY ok ORDER BY item_no, start_ms, h, stem) AS n FROM (SELECT *, stem * 8 + line_no + partkey * 1000000 AS item_no, CASE flag WHEN 'N' THEN 'both' ELSE hand END AS h, flag <> 'N' AS ok FROM pairings))""")
def manual_pairings(b):
    hand = F.when(F.col("flag") == "N", "both").otherwise(F.col("hand"))
    requests = b.pairings.select("stem", (F.col("stem") * 8 + F.col("line_no") + F.col("partkey") * 1_000_000).alias("item_no"), hand.alias("hand"), "start_ms", "end_ms", F.lit(25.0).alias("fps"))
    return M.manual_pairings(requests).select("pairing_id", "item_no", "sign_frame_start", "error")


@query("f24_cut_interval", """WITH u AS (SELECT o_orderkey AS unit_id, o_custkey * 10 AS s, o_custkey * 10 + 3000 AS e, o_custkey * 10 + CASE WHEN o_orderkey % 4 = 0 THEN 50 ELSE 0 END AS us,
      [o_custkey * 10 + 2000, o_custkey * 10, o_custkey * 10 + 500 + o_orderkey % 7] AS cuts, o_orderkey % 3 = 0 AS linked, o_orderkey % 2 = 0 AS two FROM orders),
    ed AS (SELECT *, list_concat([s], list_sort([c FOR c IN cuts IF c > s AND c < e]), [e]) AS ed FROM u),
    pc AS (SELECT *, i - 1 AS piece, ed[i] AS ps, ed[i + 1] AS pe FROM ed, LATERAL (SELECT unnest(range(1, len(ed))) AS i)),
    hd AS (SELECT *, 'right' AS hand, 0 AS pn, us AS ds FROM pc UNION ALL SELECT *, 'left', 1, us + 20 FROM pc WHERE two)
    SELECT unit_id || '_' || lpad(CAST(CASE WHEN piece = 0 THEN ds ELSE ps END AS VARCHAR), 8, '0') || '_' || left(hand, 1) || CASE WHEN piece = 0 AND pn = 0 THEN '_R' ELSE '_C' END AS pairing_id,
      unit_id, piece, hand, ps AS sign_start_ms, pe AS sign_end_ms, CAST(floor(ps * 25.0 / 1000) AS BIGINT) AS sign_frame_start, CAST(floor(pe * 25.0 / 1000) AS BIGINT) AS sign_frame_end,
      'w' || piece AS word, 'G-' || piece AS gloss_id, 'ai_review_cut' || CASE WHEN linked THEN '|compound:c' || unit_id ELSE '' END ||
        CASE WHEN us <> s THEN '|trimmed_' || ds || '-' || (ds + 2900) ELSE '' END AS note, 'paired' AS status FROM hd""")
def cut_interval(b):
    key, s = F.col("o_orderkey"), F.col("o_custkey") * 10
    us = s + F.when(key % 4 == 0, 50).otherwise(0)
    pred = lambda hand, shift: F.struct(F.lit(hand).alias("hand"), (us + shift).alias("start_ms"), (us + shift + 2900).alias("end_ms"))
    units = b.table("orders").select(
        key.alias("unit_id"), key.alias("stem"), s.alias("start_ms"), (s + 3000).alias("end_ms"), us.alias("unit_start_ms"), (s + 3000).alias("unit_end_ms"),
        F.array(s + 2000, s, s + 500 + key % 7).alias("cuts"), F.when(key % 2 == 0, F.array(pred("right", 0), pred("left", 20))).otherwise(F.array(pred("right", 0))).alias("preds"),
        F.lit(25.0).alias("fps"), F.when(key % 3 == 0, F.concat(F.lit("c"), key.cast("string"))).otherwise("").alias("compound"))
    piece = F.explode(F.sequence(F.lit(0), F.lit(2))).alias("piece")
    resolved = b.table("orders").select(key.alias("unit_id"), piece).select(
        "unit_id", "piece", F.concat(F.lit("w"), F.col("piece").cast("string")).alias("word"), F.concat(F.lit("G-"), F.col("piece").cast("string")).alias("gloss_id"))
    return M.cut_interval(units, resolved)


@query("f25_replace_detections", """SELECT segment_id, pairing_id FROM (SELECT stem AS segment_id, stem || '_' || line_no AS pairing_id FROM pairings) WHERE segment_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')
    UNION ALL SELECT o_orderkey, 'again_' || o_orderkey FROM orders WHERE o_orderstatus = 'F'""")
def replace_detections(b):
    found = b.table("orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("segment_id"), F.format_string("again_%d", "o_orderkey").alias("pairing_id"))
    return M.replace_detections(pairing_rows(b).select("segment_id", "pairing_id"), found)


@query("f26_reviewer_regions", f"""WITH {FIRST_SQL}, r AS (SELECT *, trim({VALUE}) AS v FROM pairings), m AS (SELECT *, regexp_matches(v, '^[A-Z][A-Z0-9_-]+$') AS is_id FROM r WHERE v <> '')
    SELECT stem || '_' || lpad(CAST(start_ms AS VARCHAR), 8, '0') || '_' || left(hand, 1) || '_N' AS pairing_id, stem, hand, start_ms AS sign_start_ms, end_ms AS sign_end_ms,
      CAST(floor(start_ms * 25.0 / 1000) AS BIGINT) AS sign_frame_start, CAST(floor(end_ms * 25.0 / 1000) AS BIGINT) AS sign_frame_end,
      CASE WHEN is_id THEN '' ELSE lower(v) END AS word, CASE WHEN is_id THEN v ELSE coalesce(g, '') END AS gloss_id, 'paired' AS status, 'ai_review_new_label' AS note
    FROM m LEFT JOIN first_gloss ON key = {NORM_WORD.format('v')} AND NOT is_id""")
def reviewer_regions(b):
    regions = b.pairings.select("stem", "hand", "start_ms", "end_ms", F.expr(VALUE).alias("value"), F.lit(25.0).alias("fps"))
    return M.reviewer_regions(regions, b.glossary)


ACTION = "CASE partkey % 5 WHEN 0 THEN 'pair' WHEN 1 THEN 'skip' WHEN 2 THEN 'unpair' WHEN 3 THEN 'pair' END"


@query("f27_decide_pairings", f"""WITH {FIRST_SQL}, p AS (SELECT stem || '_' || line_no || '_' || partkey || '_' || suppkey AS id, start_ms, end_ms, word, partkey, {ACTION} AS act, CASE WHEN partkey % 5 = 3 THEN word || 's' ELSE word END AS w1 FROM pairings)
    SELECT id AS pairing_id, CASE act WHEN 'pair' THEN w1 || ' two' WHEN 'unpair' THEN '' ELSE word END AS word, CASE act WHEN 'pair' THEN coalesce(g, upper(w1) || '-1') WHEN 'unpair' THEN '' ELSE 'OLD-1' END AS gloss_id,
      CASE act WHEN 'pair' THEN 'paired' WHEN 'skip' THEN 'skipped' ELSE 'pending' END AS status, CASE act WHEN 'pair' THEN start_ms + 40 ELSE start_ms END AS sign_start_ms,
      CASE act WHEN 'pair' THEN end_ms - 40 ELSE end_ms END AS sign_end_ms, CASE act WHEN 'pair' THEN CAST(floor((start_ms + 40) * 25.0 / 1000) AS BIGINT) ELSE 0 END AS sign_frame_start,
      CASE act WHEN 'pair' THEN CAST(floor((end_ms - 40) * 25.0 / 1000) AS BIGINT) ELSE 0 END AS sign_frame_end, CASE act WHEN 'pair' THEN 'seen' ELSE '' END AS note
    FROM p LEFT JOIN first_gloss ON key = w1 AND act = 'pair'""")
def decide_pairings(b):
    return decided(b).drop("fps")


def decided(b):
    pid = F.concat_ws("_", *[F.col(c).cast("string") for c in ("stem", "line_no", "partkey", "suppkey")]).alias("pairing_id")
    zero = F.lit(0).cast("long")
    rows = b.pairings.select(pid, "word", F.lit("OLD-1").alias("gloss_id"), F.lit("pending").alias("status"), F.col("start_ms").alias("sign_start_ms"),
                             F.col("end_ms").alias("sign_end_ms"), zero.alias("sign_frame_start"), zero.alias("sign_frame_end"), F.lit("").alias("note"), F.lit(25.0).alias("fps"))
    first = F.when(F.col("partkey") % 5 == 3, F.concat("word", F.lit("s"))).otherwise(F.col("word"))
    decisions = b.pairings.select(pid, F.expr(ACTION).alias("action"), F.array(first, F.lit("two")).alias("words"), (F.col("start_ms") + 40).alias("start_ms"),
                                  (F.col("end_ms") - 40).alias("end_ms"), F.lit("seen").alias("note")).filter("action is not null")
    return M.decide_pairings(rows, decisions, b.glossary)


@query("f27_new_glosses", f"""SELECT DISTINCT upper(word) || 'S-1' AS gloss_id, word || 's' AS lemma FROM pairings WHERE partkey % 5 = 3 AND word || 's' NOT IN (SELECT form FROM glossary)""")
def new_glosses(b):
    return M.new_glosses_of(decided(b), b.glossary)


# -- manifests ---------------------------------------------------------------------------------

SUFFIX_SQL = """f AS (SELECT l_orderkey || '_' || l_linenumber || '_' || CASE l_partkey % 3 WHEN 0 THEN 'x_' || l_suppkey WHEN 1 THEN l_suppkey || '-Q' ELSE 'none' END AS stem FROM lineitem),
    ids AS (SELECT CAST(s_suppkey AS VARCHAR) AS id FROM supplier UNION SELECT 'x_' || s_suppkey FROM supplier WHERE s_suppkey % 2 = 0 UNION SELECT s_suppkey || '-Q' FROM supplier WHERE s_suppkey % 5 <> 0),
    m AS (SELECT stem, arg_max(id, length(id)) AS matched_id FROM (SELECT DISTINCT stem FROM f) JOIN ids ON ends_with(stem, '_' || id) GROUP BY stem)"""


def suffix_inputs(b):
    n = F.col("l_partkey") % 3
    supp = F.col("l_suppkey").cast("string")
    tail = F.when(n == 0, F.concat(F.lit("x_"), supp)).when(n == 1, F.concat(supp, F.lit("-Q"))).otherwise("none")
    files = b.table("lineitem").select(F.concat_ws("_", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), tail).alias("stem"))
    s = b.table("supplier").select("s_suppkey", F.col("s_suppkey").cast("string").alias("k"))
    ids = s.select(F.col("k").alias("video_id")).union(s.filter("s_suppkey % 2 = 0").select(F.concat(F.lit("x_"), "k"))).union(
        s.filter("s_suppkey % 5 <> 0").select(F.concat("k", F.lit("-Q"))))
    return files, ids


@query("f14_longest_suffix", f"WITH {SUFFIX_SQL} SELECT f.stem, matched_id FROM f LEFT JOIN m USING (stem)")
def longest_suffix(b):
    return M.match_by_suffix(*suffix_inputs(b))


@query("f14_one_file_per_id", f"WITH {SUFFIX_SQL} SELECT matched_id, min(stem) AS stem FROM m GROUP BY matched_id")
def one_file_per_id(b):
    return M.one_file_per_id(M.match_by_suffix(*suffix_inputs(b)))


@query("g17_suffix_match_counts", f"""WITH {SUFFIX_SQL} SELECT count(*) AS files, count(*) FILTER (matched_id IS NULL) AS unmatched, count(matched_id) - count(DISTINCT matched_id) AS duplicates FROM f LEFT JOIN m USING (stem)""")
def suffix_counts(b):
    return M.suffix_match_counts(M.match_by_suffix(*suffix_inputs(b)))


@query("f15_labels_of_videos", """WITH e AS (SELECT p_partkey AS row_no, p_name AS label, [p_brand, p_type, p_brand || 'b'] AS ids FROM part),
    x AS (SELECT row_no, lower(label) AS label, i, ids[i] AS video_id FROM e, LATERAL (SELECT unnest([1, 2, 3]) AS i))
    SELECT video_id, label, arg_min(CASE WHEN i = 2 THEN 'side' ELSE 'front' END, row_no * 10 + i) AS angle FROM x GROUP BY ALL""")
def labels_of_videos(b):
    entries = b.table("part").select(F.col("p_partkey").alias("row_no"), F.col("p_name").alias("label"), F.array("p_brand", "p_type", F.concat("p_brand", F.lit("b"))).alias("video_ids"))
    return M.labels_of_videos(entries)


def stem_manifest(b):
    files = b.table("lineitem").select(F.format_string("/p/%d_%d.npz", "l_partkey", "l_orderkey").alias("path"), F.col("l_partkey").cast("string").alias("stem"))
    labels = b.table("part").filter("p_size > 10").select(F.col("p_partkey").cast("string").alias("stem"), F.lower("p_name").alias("label"), F.lit("front").alias("angle"))
    return M.manifest_by_stem(files, labels, "climate-vocab")


@query("f16_manifest_by_stem", """SELECT '/p/' || l_partkey || '_' || l_orderkey || '.npz' AS npz_path, CAST(l_partkey AS VARCHAR) AS segment_id, lower(p_name) AS text, lower(p_name) AS label, 'climate-vocab' AS source, 'front' AS angle
    FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size > 10""")
def manifest_by_stem(b):
    return stem_manifest(b)


@query("f17_frame_counts", """SELECT segment_id, coalesce(n, 0) AS n_frames, coalesce(m, 0) AS n_landmarks FROM (SELECT p_partkey AS segment_id FROM part)
    LEFT JOIN (SELECT user_id, count(*) AS n, CAST(2 AS BIGINT) AS m FROM events GROUP BY user_id) ON user_id = segment_id""")
def frame_counts(b):
    frames = b.signal.select("clip", "frame", F.lit(2).cast("long").alias("n_landmarks"))
    return M.with_frame_counts(b.table("part").select(F.col("p_partkey").alias("segment_id")), frames)


@query("f18_category_by_prefix", """WITH s AS (SELECT l_suppkey || '_' || l_orderkey || '_' || l_linenumber AS segment_id FROM lineitem), c AS (SELECT CAST(s_suppkey AS VARCHAR) AS stem, n_name AS category FROM supplier JOIN nation ON n_nationkey = s_nationkey
      UNION ALL SELECT s_suppkey || '_' || (s_suppkey * 3), 'deep' FROM supplier) SELECT segment_id, stem, category AS label FROM s JOIN c ON starts_with(segment_id, stem || '_')""")
def category_by_prefix(b):
    segments = b.table("lineitem").select(F.concat_ws("_", *[F.col(c).cast("string") for c in ("l_suppkey", "l_orderkey", "l_linenumber")]).alias("segment_id"))
    sup = b.table("supplier").join(b.table("nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    cats = sup.select(F.col("s_suppkey").cast("string").alias("stem"), F.col("n_name").alias("category")).union(
        b.table("supplier").select(F.concat_ws("_", F.col("s_suppkey").cast("string"), (F.col("s_suppkey") * 3).cast("string")), F.lit("deep")))
    return M.category_by_prefix(segments, cats)


ARTICLES_SQL = """art AS (SELECT 'v' || (doc_id // 2) AS youtube_id, arg_max(source, doc_id) AS title, arg_max(lang, doc_id) AS date, arg_max(text, doc_id) AS text FROM documents WHERE doc_id % 5 <> 0 GROUP BY 1),
    vid AS (SELECT '20240101_v' || o_orderkey || CASE WHEN o_orderkey % 2 = 0 THEN '_Title_x' ELSE '' END || '.mp4' AS video_file, 'v' || o_orderkey AS youtube_id FROM orders)"""


def videos_and_articles(b):
    articles = b.table("documents").select(F.col("doc_id").alias("row_no"), F.when(F.col("doc_id") % 5 != 0, F.concat(F.lit("v"), F.floor(F.col("doc_id") / 2).cast("string"))).alias("youtube_id"),
                                           F.col("source").alias("title"), F.col("lang").alias("date"), "text")
    key = F.col("o_orderkey")
    videos = b.table("orders").select(
        F.concat(F.lit("20240101_v"), key.cast("string"), F.when(key % 2 == 0, "_Title_x").otherwise(""), F.lit(".mp4")).alias("video_file"))
    return videos, articles


def article_videos(b):
    return M.videos_with_articles(*videos_and_articles(b))


@query("f19_videos_with_articles", f"WITH {ARTICLES_SQL} SELECT video_file, youtube_id, title, date, length(text) AS text_len FROM vid JOIN art USING (youtube_id)")
def videos_with_articles(b):
    return article_videos(b).select("video_file", "youtube_id", "title", "date", "text_len")


@query("f19_unmatched_videos", f"WITH {ARTICLES_SQL} SELECT count(*) AS n_unmatched FROM vid ANTI JOIN art USING (youtube_id)")
def unmatched_videos(b):
    return M.videos_without_article(*videos_and_articles(b))


@query("f20_prefer_extended", """SELECT p_partkey AS segment_id, CASE WHEN p_size % 2 = 0 AND p_partkey % 3 = 0 THEN '/ext/' || p_partkey ELSE '/small/' || p_partkey END AS npz_path,
      CASE WHEN p_size % 2 = 0 AND p_partkey % 3 = 0 THEN 148 WHEN p_size > 40 THEN 174 ELSE 96 END AS n_landmarks FROM part""")
def prefer_extended(b):
    key = F.col("p_partkey")
    manifest = b.table("part").select(key.alias("segment_id"), F.format_string("/small/%d", key).alias("npz_path"), F.when(F.col("p_size") > 40, 174).cast("long").alias("n_landmarks"),
                                      F.when(F.col("p_size") % 2 == 0, "existing").otherwise("other").alias("source"))
    extended = b.table("part").filter("p_partkey % 3 = 0").select(key.alias("segment_id"), F.format_string("/ext/%d", key).alias("npz_path"))
    return M.prefer_extended(manifest, extended).drop("source")


@query("f21_resolve_paths", """SELECT p_partkey AS segment_id, CASE WHEN p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45) THEN '/files/' || p_partkey ELSE '/export/' || p_partkey || '.npz' END AS resolved FROM part""")
def resolve_paths(b):
    manifest = b.table("part").select(F.col("p_partkey").alias("segment_id"), F.format_string("/files/%d", "p_partkey").alias("npz_path"))
    files = b.table("lineitem").filter("l_quantity > 45").select(F.format_string("/files/%d", "l_partkey").alias("path"))
    return M.resolve_paths(manifest, files, "/export").select("segment_id", "resolved")


@query("f22_label_overlap", """SELECT a.source AS source_a, b.source AS source_b, count(DISTINCT a.label) AS shared_labels FROM manifest a JOIN manifest b ON a.label = b.label AND a.source < b.source GROUP BY ALL""")
def label_overlap(b):
    return LS.label_overlap(b.manifest)


@query("b06_alignment_totals", """SELECT (SELECT count(*) FROM noisy_cues) AS raw_cues, (SELECT count(*) FROM cues) AS segments""")
def totals(b):
    return alignment_totals(b.noisy_cues, b.cues)


@query("g20_files_per_source", f"""WITH {SOURCES_SQL} SELECT coalesce(source, 'unmatched') AS source, count(*) AS n FROM placed GROUP BY 1 UNION ALL SELECT 'TOTAL', count(*) FROM placed""")
def files_per_source(b):
    from tierloom.operators.progress import files_per_source as run

    return run(placed_stems(b))


# -- tiers -----------------------------------------------------------------------------------------

@query("a06_ai_tier_rows", f"""WITH {PREDS_SQL}, a AS (SELECT stem, 'S1_Mouthing' AS tier, start_ms, end_ms, 'm' AS value FROM preds WHERE item_no % 5 = 0 UNION ALL SELECT stem, 'AI_Gloss_RH', start_ms, end_ms, 'old' FROM preds WHERE item_no % 7 = 0),
      fresh AS (SELECT * FROM preds WHERE stem % 2 = 0)
    SELECT stem, tier, start_ms, end_ms, value FROM a WHERE tier = 'S1_Mouthing' OR stem NOT IN (SELECT stem FROM fresh)
    UNION ALL SELECT stem, CASE hand WHEN 'right' THEN 'AI_Gloss_RH' ELSE 'AI_Gloss_LH' END, start_ms, end_ms, predicted_gloss FROM fresh
    UNION ALL SELECT stem, 'AI_Confidence', start_ms, end_ms, CAST(confidence AS VARCHAR) FROM fresh""")
def ai_tier_rows(b):
    preds = hand_predictions(b)
    old = preds.filter("item_no % 5 = 0").select("stem", F.lit("S1_Mouthing").alias("tier"), "start_ms", "end_ms", F.lit("m").alias("value")).unionByName(
        preds.filter("item_no % 7 = 0").select("stem", F.lit("AI_Gloss_RH").alias("tier"), "start_ms", "end_ms", F.lit("old").alias("value")))
    return M.replace_ai_tiers(old, M.tier_rows(preds.filter("stem % 2 = 0")))


TIERS = ["S1_Gloss_RH", "S1_Gloss_LH", "S1_Translation", "S1_Mouthing", "AI_Gloss_RH", "AI_Gloss_LH", "AI_Confidence"]


@query("a08_tier_statistics", f"""SELECT stem, tier, count(*) FILTER (t = tier) AS n FROM (SELECT stem, {TIER} AS t FROM pairings), (SELECT unnest({TIERS}) AS tier) GROUP BY ALL""")
def tier_statistics(b):
    return M.tier_counts(b.pairings.select("stem", F.expr(TIER).alias("tier")), TIERS)


@query("g21_preannotation_status", """SELECT o_orderkey AS stem, coalesce(n, 0) AS n_ai, CASE WHEN coalesce(n, 0) > 0 THEN 'done' WHEN o_orderstatus = 'P' THEN 'error' ELSE 'pending' END AS state
    FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) ON l_orderkey = o_orderkey""")
def preannotation_status(b):
    from tierloom.operators.progress import preannotation_status as run

    videos = b.table("orders").select(F.col("o_orderkey").alias("stem"), (F.col("o_orderstatus") == "P").alias("unreadable"))
    return run(videos, b.table("lineitem").filter("l_returnflag = 'A'").select(F.col("l_orderkey").alias("stem")))
