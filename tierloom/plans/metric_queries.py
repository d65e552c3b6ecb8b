"""Queries over counts, metrics, search, splits, clusters and the collector tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tierloom.functions.chunks import rank_in_groups
from tierloom.operators import collector as K
from tierloom.operators import label_sets as LS
from tierloom.operators import learning as LE
from tierloom.operators import listings as LI
from tierloom.operators import metrics as ME
from tierloom.operators import progress as P
from tierloom.operators import search as SE
from tierloom.operators.cues import anchored_windows
from tierloom.plans.join_queries import FILES_SQL, PREDS_SQL, ACTION, article_videos, ARTICLES_SQL, hand_predictions, pose_files
from tierloom.functions.draws import hashed_sql
from tierloom.plans.registry import query
from tierloom.session import checkpointed

# -- counts ---------------------------------------------------------------------------


@query("g01_label_counts", "SELECT p_name, count(*) AS n FROM part GROUP BY p_name ORDER BY n DESC, p_name LIMIT 50")
def label_counts(b):
    return P.value_counts(b.manifest, "p_name", 50)


@query("g01_status_counts", "SELECT flag, count(*) AS n FROM pairings GROUP BY flag")
def status_counts(b):
    return P.value_counts(b.pairings, "flag")


@query("g01_milestones", """SELECT CAST(m AS BIGINT) AS milestone, least(100.0::DOUBLE, n / m * 100) AS percent FROM (SELECT count(*)::DOUBLE AS n FROM part), (SELECT unnest([500, 2000, 5000, 10000]) AS m)""")
def milestones(b):
    return P.milestones(b.manifest)


SEG_STATUS = "CASE flag WHEN 'N' THEN 'pending' WHEN 'A' THEN 'approved' ELSE 'skipped' END"


@query("g02_review_progress", f"""SELECT stem, n_segs, n_pending, (n_segs - n_pending) / greatest(1, n_segs) AS reviewed FROM (SELECT stem, count(*) AS n_segs, count(*) FILTER (flag = 'N') AS n_pending FROM pairings GROUP BY stem)""")
def review_progress(b):
    return P.review_progress(b.pairings.withColumn("status", F.expr(SEG_STATUS)))


PAIR_STATUS = "CASE partkey % 5 WHEN 0 THEN 'paired' WHEN 1 THEN 'auto_suggested' WHEN 2 THEN 'skipped' ELSE 'pending' END"


def signs(b):
    return b.pairings.select(F.col("stem").alias("segment_id"), F.expr(PAIR_STATUS).alias("status"), F.upper("word").alias("gloss_id"))


@query("g03_paired_signs", f"SELECT count(*) AS n_paired, count(DISTINCT word) AS n_glosses FROM pairings WHERE partkey % 5 = 0")
def paired_signs(b):
    return P.paired_signs(signs(b))


@query("g04_paired_per_segment", "SELECT stem AS segment_id, count(*) AS n_paired FROM pairings WHERE partkey % 5 < 2 GROUP BY stem")
def paired_per_segment(b):
    return P.paired_per_segment(signs(b))


MODELS_SQL = """models AS (SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'cat_' ELSE 'word_' END || s_suppkey || '.pt' AS filename, s_acctbal / 20000 + 0.1 AS val_acc, s_suppkey * 5 AS n_classes,
    s_nationkey AS epoch, '2024-01-' || lpad(CAST(s_suppkey % 28 + 1 AS VARCHAR), 2, '0') AS timestamp, s_suppkey * 100 AS n_train, s_suppkey % 10 <> 0 AS readable FROM supplier)"""


def models(b):
    k = F.col("s_suppkey")
    return b.table("supplier").select(
        F.concat(F.when(k % 3 == 0, "cat_").otherwise("word_"), k.cast("string"), F.lit(".pt")).alias("filename"), (F.col("s_acctbal") / 20000 + 0.1).alias("val_acc"),
        (k * 5).alias("n_classes"), F.col("s_nationkey").alias("epoch"), F.format_string("2024-01-%02d", k % 28 + 1).alias("timestamp"), (k * 100).alias("n_train"), (k % 10 != 0).alias("readable"))


@query("g05_pipeline_status", f"""WITH {MODELS_SQL} SELECT (SELECT count(*) FROM orders) AS videos, (SELECT count(*) FROM orders WHERE o_orderstatus <> 'P') AS poses_extracted, (SELECT count(*) FROM pairings) AS segments_total,
      (SELECT count(*) FROM pairings WHERE flag = 'A') AS segments_approved, (SELECT count(*) FROM pairings WHERE partkey % 5 = 0) AS signs_paired, (SELECT count(DISTINCT word) FROM pairings WHERE partkey % 5 = 0) AS unique_glosses,
      (SELECT count(*) FROM glossary) AS glossary_entries, (SELECT count(*) FROM models) AS checkpoints, (SELECT val_acc FROM models ORDER BY timestamp DESC, filename DESC LIMIT 1) AS latest_val_acc, CAST(10000 AS BIGINT) AS next_threshold""")
def pipeline_status(b):
    return P.pipeline_status(b.table("orders"), pose_files(b), b.pairings.withColumn("status", F.expr(SEG_STATUS)), signs(b), b.glossary, models(b))


@query("g06_step_status", """SELECT p_partkey, CASE WHEN t > 0 AND d >= t THEN 'done' WHEN d > 0 THEN 'partial' ELSE 'pending' END AS state FROM (SELECT p_partkey, p_size % 4 AS d, p_size % 3 AS t FROM part)""")
def step_status(b):
    return b.table("part").select("p_partkey", P.step_status(F.col("p_size") % 4, F.col("p_size") % 3).alias("state"))


@query("g07_inventory_totals", """SELECT count(*) AS videos, round(sum(o_custkey % 600 + 0.5) / 3600, 3) AS hours, count(*) FILTER (o_orderstatus = 'F') AS extracted, count(*) FILTER (o_orderstatus <> 'F') AS missing,
      round(count(*) FILTER (o_orderstatus = 'F') / count(*) * 100, 3) AS percent FROM orders""")
def inventory_totals(b):
    return P.inventory_totals(b.table("orders").select((F.col("o_custkey") % 600 + F.lit(0.5)).alias("duration_sec"), (F.col("o_orderstatus") == "F").alias("pose_extracted")))


@query("g15_retrain_trigger", """SELECT p_partkey, n_paired, last_trained, c IS NOT NULL AS should_retrain, CASE WHEN n_paired >= 10000 THEN 10000 WHEN n_paired >= 5000 THEN 5000 WHEN n_paired >= 2000 THEN 2000 WHEN n_paired >= 500 THEN 500 ELSE 0 END AS current_threshold,
      CASE WHEN n_paired < 500 THEN 500 WHEN n_paired < 2000 THEN 2000 WHEN n_paired < 5000 THEN 5000 ELSE 10000 END AS next_threshold,
      CASE WHEN c IS NULL THEN '' ELSE 'Sign count (' || n_paired || ') crossed threshold ' || c || '. Last model was trained at ' || last_trained || ' signs.' END AS reason
    FROM (SELECT *, list_max([t FOR t IN [500, 2000, 5000, 10000] IF t <= n_paired AND t > last_trained]) AS c FROM (SELECT p_partkey, p_partkey * 7 % 12000 AS n_paired, p_size * 150 AS last_trained FROM part))""")
def retrain_trigger(b):
    counts = b.table("part").select("p_partkey", (F.col("p_partkey") * 7 % 12000).alias("n_paired"), (F.col("p_size") * 150).cast("long").alias("last_trained"))
    return P.retrain_state(counts)


@query("g16_inference_summary", f"""WITH {PREDS_SQL} SELECT stem, count(*) AS n_predictions, round_even(avg(confidence), 3) AS mean_confidence, count(*) FILTER (hand = 'right') AS rh, count(*) FILTER (hand = 'left') AS lh FROM preds GROUP BY stem""")
def inference_summary(b):
    return P.inference_summary(hand_predictions(b))


@query("g16_run_totals", f"""WITH {FILES_SQL}, r AS (SELECT CASE WHEN f.stem IS NULL OR bytes IS NULL OR bytes < 10000 THEN 'skipped' ELSE 'ok' END AS s, n FROM orders LEFT JOIN f ON f.stem = o_orderkey
      LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_quantity > 25 GROUP BY 1) ON l_orderkey = o_orderkey)
    SELECT count(*) FILTER (s = 'ok') AS n_processed, count(*) FILTER (s = 'skipped') AS n_skipped, CAST(0 AS BIGINT) AS n_errors, CAST(coalesce(sum(n) FILTER (s = 'ok'), 0) AS BIGINT) AS total_predictions FROM r""")
def run_totals(b):
    from tierloom.plans.join_queries import batch_eligibility

    return P.run_totals(batch_eligibility(b))


@query("g17_manifest_counts", """SELECT count(*) AS samples, count(DISTINCT lower(p_name)) AS labels, count(DISTINCT l_partkey) AS videos FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size > 10""")
def manifest_counts(b):
    from tierloom.plans.join_queries import stem_manifest

    return P.manifest_counts(stem_manifest(b))


@query("g19_article_stats", f"WITH {ARTICLES_SQL}, j AS (SELECT vid.youtube_id, text FROM vid JOIN art USING (youtube_id)) SELECT count(*) AS articles, count(youtube_id) AS with_video, count(*) FILTER (length(text) > 50) AS with_text FROM j")
def article_stats(b):
    return P.article_stats(article_videos(b))


@query("g20_samples_per_source", "SELECT source, count(*) AS samples, count(DISTINCT label) AS labels FROM manifest GROUP BY source")
def samples_per_source(b):
    return P.samples_per_source(b.manifest)


def runs(b):
    k = F.col("o_orderkey")
    return b.table("orders").select(k.alias("run"), F.when(F.col("o_orderstatus") == "P", "failed").otherwise("ok").alias("status"), F.col("o_totalprice").alias("best_val_acc"))


@query("g22_experiment_ranking", "SELECT o_orderkey AS run, 'ok' AS status, o_totalprice AS best_val_acc FROM orders WHERE o_orderstatus <> 'P' ORDER BY o_totalprice DESC, o_orderkey")
def experiment_ranking(b):
    return P.rank_experiments(runs(b))


@query("g22_remaining_runs", "SELECT o_orderkey AS run FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 10)")
def remaining_runs(b):
    return P.remaining_runs(runs(b).select("run"), b.table("lineitem").filter("l_quantity > 10").select(F.col("l_orderkey").alias("run")))


@query("g23_model_listing", f"WITH {MODELS_SQL} SELECT filename, n_classes, val_acc, epoch, timestamp FROM models WHERE readable ORDER BY filename")
def model_listing(b):
    return P.model_listing(models(b))


# -- metrics ------------------------------------------------------------------------------

SCORED_SQL = """cent AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL),
    sc AS (SELECT vec_id, e.label AS truth, c.label AS cand, sum(CAST(embedding[i] AS DOUBLE) * v) AS s FROM embeddings e, cent c GROUP BY ALL),
    rk AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, cand) AS r, exp(s) / sum(exp(s)) OVER (PARTITION BY vec_id) AS p FROM sc),
    scored AS (SELECT vec_id, 'L' || truth AS truth, 'L' || max(cand) FILTER (r = 1) AS predicted, round_even(max(p) FILTER (r = 1), 4) AS confidence,
      'L' || max(cand) FILTER (r = 1) || ',L' || max(cand) FILTER (r = 2) || ',L' || max(cand) FILTER (r = 3) AS top3 FROM rk GROUP BY ALL)"""


def vectors(b):
    label = F.concat(F.lit("L"), F.col("label").cast("string"))
    return b.table("embeddings").select(F.col("vec_id").alias("id"), label.alias("label"), F.col("embedding").alias("vector"))


def scored(b):
    rows = vectors(b)
    out = SE.classify(rows, SE.centroids(rows))
    return out.join(rows.select("id", F.col("label").alias("truth")), "id")


@query("j05_classify_segments", f"WITH {SCORED_SQL} SELECT vec_id AS id, truth, predicted, confidence, top3 FROM scored")
def classify_segments(b):
    return scored(b).select("id", "truth", "predicted", "confidence", F.array_join("top3.gloss", ",").alias("top3"))


@query("h05_top3_classes", f"WITH {SCORED_SQL} SELECT vec_id AS id, CAST(r AS BIGINT) AS rank, 'L' || cand AS gloss, round_even(p, 4) AS confidence FROM rk WHERE r <= 3")
def top3_classes(b):
    return scored(b).select("id", F.posexplode("top3").alias("r", "c")).select("id", (F.col("r") + 1).cast("long").alias("rank"), "c.*")


@query("g09_accuracy", f"""WITH {SCORED_SQL} SELECT round_even(avg(CASE WHEN truth = predicted THEN 1 ELSE 0 END), 4) AS accuracy,
    round_even(avg(CASE WHEN list_contains(string_split(top3, ','), truth) THEN 1 ELSE 0 END), 4) AS top3_accuracy, count(*) AS n_samples FROM scored""")
def accuracy(b):
    return ME.accuracy(scored(b))


NOISY = "CASE WHEN vec_id % 3 = 0 THEN 'L' || (vec_id % 10) ELSE predicted END"
NOISY_SQL = f"{SCORED_SQL}, noisy AS (SELECT truth, {NOISY} AS predicted FROM scored), classes AS (SELECT DISTINCT truth AS label FROM noisy UNION SELECT 'LX')"


def noisy_scored(b):
    return scored(b).withColumn("predicted", F.when(F.col("id") % 3 == 0, F.concat(F.lit("L"), (F.col("id") % 10).cast("string"))).otherwise(F.col("predicted")))


def classes(b):
    return vectors(b).select("label").distinct().unionByName(vectors(b).select(F.lit("LX").alias("label")).distinct())


@query("g10_confusion_matrix", f"WITH {NOISY_SQL} SELECT a.label AS truth, b.label AS predicted, count(noisy.truth) AS n FROM classes a CROSS JOIN classes b LEFT JOIN noisy ON truth = a.label AND predicted = b.label GROUP BY ALL")
def confusion_matrix(b):
    return ME.confusion_grid(noisy_scored(b), classes(b))


@query("g10_confusion_many_classes", """SELECT truth, CASE WHEN o THEN p_brand ELSE truth END AS predicted, count(*) AS n
    FROM (SELECT p_name || '_' || p_size AS truth, p_brand, p_partkey % 3 = 0 AS o FROM part) GROUP BY ALL""")
def confusion_many_classes(b):
    truth = F.concat_ws("_", "p_name", F.col("p_size").cast("string"))
    rows = b.table("part").select(truth.alias("truth"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).otherwise(truth).alias("predicted"))
    return ME.confusion(rows)


PER_CLASS_SQL = f"""{NOISY_SQL}, c AS (SELECT label, (SELECT count(*) FROM noisy WHERE truth = label AND predicted = label) AS tp, (SELECT count(*) FROM noisy WHERE truth = label) AS support,
    (SELECT count(*) FROM noisy WHERE predicted = label) AS np FROM classes), pr AS (SELECT *, tp / greatest(1, np) AS p, tp / greatest(1, support) AS r FROM c),
    per AS (SELECT label, round_even(p, 4) AS "precision", round_even(r, 4) AS recall, round_even(2 * p * r / greatest(1e-8, p + r), 4) AS f1, support FROM pr)"""


@query("g11_per_class_metrics", f"WITH {PER_CLASS_SQL} SELECT * FROM per")
def per_class_metrics(b):
    return ME.per_class(noisy_scored(b), classes(b))


@query("g12_best_classes", f"WITH {PER_CLASS_SQL} SELECT * FROM per ORDER BY f1 DESC, label LIMIT 5")
def best_classes(b):
    return ME.best_classes(ME.per_class(noisy_scored(b), classes(b)))


EVAL_SQL = "evals AS (SELECT 'word_' || s_suppkey AS model, s_acctbal / 30000 AS accuracy, s_acctbal / 20000 AS top3_accuracy, s_nationkey AS n_samples, s_suppkey * 4 AS n_classes FROM supplier WHERE s_suppkey % 2 = 0)"


def evaluations(b):
    k = F.col("s_suppkey")
    return b.table("supplier").filter("s_suppkey % 2 = 0").select(F.concat(F.lit("word_"), k.cast("string")).alias("model"), (F.col("s_acctbal") / 30000).alias("accuracy"),
                                                                 (F.col("s_acctbal") / 20000).alias("top3_accuracy"), F.col("s_nationkey").alias("n_samples"), (k * 4).alias("n_classes"))


@query("g12_model_comparison", f"WITH {EVAL_SQL} SELECT * FROM evals ORDER BY model")
def model_comparison(b):
    return ME.compare_models(evaluations(b))


@query("g13_best_model", f"WITH {EVAL_SQL} SELECT (SELECT model || '.pt' FROM evals WHERE n_classes >= 200 ORDER BY accuracy DESC, model LIMIT 1) AS filename")
def best_model(b):
    return ME.pick_model(evaluations(b), models(b))


@query("g13_best_model_without_evaluation", f"WITH {MODELS_SQL} SELECT (SELECT filename FROM models WHERE n_classes >= 200 ORDER BY val_acc DESC, filename LIMIT 1) AS filename")
def best_model_fallback(b):
    return ME.pick_model(evaluations(b).filter("n_classes < 0"), models(b))


@query("g14_latest_model", f"WITH {MODELS_SQL} SELECT timestamp, filename, n_train, val_acc FROM models ORDER BY timestamp DESC, filename LIMIT 1")
def latest_model(b):
    return ME.latest_model(models(b))


@query("g14_category_models", f"WITH {MODELS_SQL} SELECT filename, val_acc FROM models WHERE starts_with(filename, 'cat') AND val_acc > 0.3 ORDER BY val_acc DESC")
def category_models(b):
    return ME.category_models(models(b)).select("filename", "val_acc")


# -- windows, search, listings ------------------------------------------------------------

ANCHOR_SQL = f"""WITH RECURSIVE {PREDS_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY start_ms, item_no) AS n FROM preds),
    walk AS (SELECT stem, item_no, n, start_ms, start_ms AS head, true AS is_head FROM o WHERE n = 1
      UNION ALL SELECT o.stem, o.item_no, o.n, o.start_ms, CASE WHEN o.start_ms <= w.head + 5000 THEN w.head ELSE o.start_ms END, o.start_ms > w.head + 5000 FROM walk w JOIN o ON o.stem = w.stem AND o.n = w.n + 1)"""


@query("h01_anchored_windows", f"{ANCHOR_SQL} SELECT stem, item_no, start_ms, head AS group_start, is_head FROM walk")
def anchored(b):
    return anchored_windows(hand_predictions(b))


LONG_ANCHOR_SQL = """WITH RECURSIVE o AS (SELECT stem, cue_no AS item_no, start_ms, row_number() OVER (PARTITION BY stem ORDER BY start_ms, cue_no) AS n FROM long_cues),
    walk AS (SELECT stem, item_no, n, start_ms, start_ms AS head, true AS is_head FROM o WHERE n = 1
      UNION ALL SELECT o.stem, o.item_no, o.n, o.start_ms, CASE WHEN o.start_ms <= w.head + 5000 THEN w.head ELSE o.start_ms END, o.start_ms > w.head + 5000 FROM walk w JOIN o ON o.stem = w.stem AND o.n = w.n + 1)
    SELECT stem, item_no, start_ms, head AS group_start, is_head FROM walk"""


@query("h01_anchored_in_long_groups", LONG_ANCHOR_SQL)
def anchored_in_long_groups(b):
    return anchored_windows(b.long_cues.select("stem", F.col("cue_no").alias("item_no"), "start_ms"))


@query("h02_neighbourhood", f"""{ANCHOR_SQL}, n AS (SELECT h.stem, h.item_no, p.start_ms, p.end_ms, p.item_no AS pn, predicted_gloss AS g, row_number() OVER (PARTITION BY h.stem, h.item_no ORDER BY p.start_ms, p.item_no) AS r
      FROM walk h JOIN preds p ON p.stem = h.stem AND abs(p.start_ms - h.start_ms) < 5000 WHERE is_head)
    SELECT stem, item_no, string_agg(g, ' ' ORDER BY r) FILTER (r <= 8) AS glosses, min(start_ms) AS span_start_ms, max(end_ms) AS span_end_ms FROM n GROUP BY stem, item_no""")
def neighbourhood(b):
    items = hand_predictions(b).withColumn("gloss", F.col("predicted_gloss"))
    heads = anchored_windows(items).filter("is_head")
    return LI.neighbourhoods(items.select("stem", "item_no", "start_ms", "end_ms", "gloss"), heads)


@query("h03_next_pending", f"""WITH {PREDS_SQL}, c AS (SELECT stem, max(item_no) FILTER (item_no % 3 = 0) AS item_no FROM preds GROUP BY stem)
    SELECT c.stem, c.item_no, coalesce((SELECT min(p.item_no) FROM preds p WHERE p.stem = c.stem AND review_status = 'pending' AND p.item_no > c.item_no),
      (SELECT min(p.item_no) FROM preds p WHERE p.stem = c.stem AND review_status = 'pending' AND p.item_no < c.item_no)) AS next_no FROM c""")
def next_pending(b):
    units = hand_predictions(b)
    return LI.next_pending(units, units.filter("item_no % 3 = 0").groupBy("stem").agg(F.max("item_no").alias("item_no")))


SIM_SQL = """unit AS (SELECT vec_id, label, [x / greatest(sqrt(list_sum([CAST(y AS DOUBLE) * y FOR y IN embedding])), 1e-8) FOR x IN [CAST(z AS DOUBLE) FOR z IN embedding]] AS v FROM embeddings),
    qs AS (SELECT min(vec_id) AS q FROM embeddings GROUP BY label)"""


@query("h04_similarity_search", f"""WITH {SIM_SQL}, s AS (SELECT qs.q AS query_id, u.vec_id AS id, 'L' || u.label AS label, list_sum([a[i] * u.v[i] FOR i IN range(1, 65)]) AS sim FROM qs JOIN (SELECT vec_id, v AS a FROM unit) ON vec_id = q, unit u),
    b AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY sim DESC, id) AS r FROM s), t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, label) AS rank FROM b WHERE r = 1)
    SELECT query_id, rank, label, id, round_even(sim, 4) AS similarity FROM t WHERE rank <= 5""")
def similarity_search(b):
    index = SE.build_index(vectors(b))
    first = vectors(b).groupBy("label").agg(F.min(F.struct("id", "vector")).alias("q"))
    return SE.find_similar(index, first.select(F.col("q.id").alias("query_id"), F.col("q.vector").alias("query")))


@query("h06_ordered_listing", f"WITH {PREDS_SQL} SELECT stem, item_no, start_ms, hand FROM preds ORDER BY start_ms, hand")
def ordered_listing(b):
    return LI.ordered(hand_predictions(b).select("stem", "item_no", "start_ms", "hand"), "start_ms", "hand")


# -- unions and splits ---------------------------------------------------------------------


def sources(b):
    m = b.manifest.select("segment_id", "label", "source")
    docs = b.table("documents").select(F.col("doc_id").alias("segment_id"), F.upper("lang").alias("label"), F.col("n_chars").alias("n_frames"))
    return {"part": m, "doc": docs}


@query("i01_union_sources", """SELECT segment_id, lower(label) AS label, source, CAST(NULL AS BIGINT) AS n_frames FROM manifest UNION ALL SELECT doc_id, lang, 'doc', n_chars FROM documents""")
def union_sources(b):
    return LS.union_sources(sources(b))


@query("i02_recombine_splits", "SELECT segment_id, label, 'existing' AS source FROM manifest")
def recombine_splits(b):
    m = b.manifest.select("segment_id", "label")
    return LS.recombine_splits(m.filter("segment_id % 3 = 0"), m.filter("segment_id % 3 = 1"), m.filter("segment_id % 3 = 2"))


@query("i03_distinct_in_order", "SELECT p_type, p_name, min(p_partkey) AS p_partkey FROM part GROUP BY p_type, p_name")
def distinct_in_order(b):
    return LS.distinct_in_order(b.table("part"), ["p_type"], "p_name", "p_partkey")


@query("i04_split_sizes", """SELECT p_name AS label, split, CASE split WHEN 'train' THEN t WHEN 'val' THEN v ELSE n - t - v END AS n FROM (SELECT p_name, n, greatest(1, CAST(floor(n * 0.8::DOUBLE) AS BIGINT)) AS t, CAST(floor(n * 0.1::DOUBLE) AS BIGINT) AS v
      FROM (SELECT p_name, count(*) AS n FROM part GROUP BY p_name)), (SELECT unnest(['train', 'val', 'test']) AS split) WHERE CASE split WHEN 'train' THEN t WHEN 'val' THEN v ELSE n - t - v END > 0""")
def split_sizes(b):
    return split_members(b).groupBy("label", "split").agg(F.count(F.lit(1)).alias("n"))


@query("i04_split_members", f"""SELECT p_partkey, label, CASE WHEN r <= t THEN 'train' WHEN r <= t + v THEN 'val' ELSE 'test' END AS split FROM (
      SELECT p_partkey, p_name AS label, row_number() OVER (PARTITION BY p_name ORDER BY {hashed_sql("'42'", 'p_partkey')}, p_partkey) AS r,
        greatest(1, CAST(floor(count(*) OVER (PARTITION BY p_name) * 0.8::DOUBLE) AS BIGINT)) AS t, CAST(floor(count(*) OVER (PARTITION BY p_name) * 0.1::DOUBLE) AS BIGINT) AS v FROM part)""")
def split_members(b):
    return LS.split_per_label(b.table("part").select("p_partkey", F.col("p_name").alias("label")), "p_partkey")


def _dealt_sql(source: str, column: str, share: str, out: str) -> str:
    """Largest remainders: ``share`` of all rows of a column dealt to labels, ties in label order."""
    exact = f"{column} * {share} / (sum({column}) OVER ())"
    return f"""SELECT * EXCLUDE (base, rest, short), base + CASE WHEN row_number() OVER (ORDER BY rest DESC, label) <= short THEN 1 ELSE 0 END AS {out}
      FROM (SELECT *, {exact} - base AS rest, {share} - sum(base) OVER () AS short FROM (SELECT *, CAST(floor({exact}) AS BIGINT) AS base FROM {source}))"""


# Labels have enough rows here for both cuts to be stratified.
@query("i05_stratified_split", f"""WITH c AS (SELECT p_name AS label, count(*) AS n FROM part GROUP BY 1),
    s AS (SELECT CAST(ceil(count(*) * 0.3::DOUBLE) AS BIGINT) AS h, CAST(ceil(ceil(count(*) * 0.3::DOUBLE) * 0.5) AS BIGINT) AS q FROM part),
    one AS ({_dealt_sql('(SELECT c.*, h, q FROM c, s)', 'n', 'h', 'held')}), two AS ({_dealt_sql('one', 'held', 'q', 'test')})
    SELECT p_partkey, label, CASE WHEN r + test > n THEN 'test' WHEN r + held > n THEN 'val' ELSE 'train' END AS split FROM (
      SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY {hashed_sql("'42'", 'p_partkey')}, p_partkey) AS r FROM part) JOIN two ON label = p_name""")
def stratified_split(b):
    return LS.split_stratified(b.table("part").select("p_partkey", F.col("p_name").alias("label")), "p_partkey")


@query("i05_split_part_sizes", """SELECT split, CASE split WHEN 'train' THEN n - h WHEN 'val' THEN h - q ELSE q END AS n FROM (SELECT n, h, CAST(ceil(h * 0.5) AS BIGINT) AS q FROM (SELECT n, CAST(ceil(n * 0.3::DOUBLE) AS BIGINT) AS h FROM (SELECT count(*) AS n FROM part))), (SELECT unnest(['train', 'val', 'test']) AS split)""")
def split_part_sizes(b):
    return stratified_split(b).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("i06_unified_variants", """WITH c AS (SELECT label, count(*) AS n, count(*) FILTER (source = 'Brand#2') AS m FROM (SELECT lower(label) AS label, source FROM manifest UNION ALL SELECT lang, 'doc' FROM documents) GROUP BY label)
    SELECT 'unified_2plus' AS variant, CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_labels FROM c WHERE n >= 2 UNION ALL SELECT 'unified_3plus', CAST(sum(n) AS BIGINT), count(*) FROM c WHERE n >= 3
    UNION ALL SELECT 'single_2plus', CAST(sum(m) AS BIGINT), count(*) FROM c WHERE m >= 2 HAVING sum(m) >= 20""")
def unified_variants(b):
    return LS.unified_variants(LS.union_sources(sources(b)), "Brand#2")


# -- clusters ---------------------------------------------------------------------------------


@query("j01_embedding_index", f"WITH {SIM_SQL} SELECT vec_id AS id, 'L' || label AS label, round(list_sum(v), 6) AS total, round(list_sum([v[i] * i FOR i IN range(1, 65)]), 6) AS weighted FROM unit")
def embedding_index(b):
    total = lambda f: F.round(F.aggregate(F.transform("vector", f), F.lit(0.0), lambda a, v: a + v), 6)
    return SE.build_index(vectors(b)).select("id", "label", total(lambda v: v).alias("total"), total(lambda v, i: v * (i + 1)).alias("weighted"))


# Segments of ten frames and four landmarks, ids as text; the first segment of every label is looked up.
FRAMES_SQL = """p AS (SELECT 's' || clip || '_' || lpad(CAST(frame // 10 AS VARCHAR), 4, '0') AS id, 'L' || clip % 4 AS label, frame, lm, x, y, z FROM pose WHERE lm < 4),
    m AS (SELECT id, label, lm * 3 + j AS i, avg(CASE j WHEN 0 THEN x WHEN 1 THEN y ELSE z END) AS v FROM p, (SELECT unnest(range(3)) AS j) GROUP BY ALL),
    idx AS (SELECT id, label, i, v / greatest(sqrt(sum(v * v) OVER (PARTITION BY id)), 1e-8) AS v FROM m)"""


@query("j01_search_own_index", f"""WITH {FRAMES_SQL}, qs AS (SELECT label AS query_id, min(id) AS q FROM idx GROUP BY 1),
    s AS (SELECT query_id, b.id, b.label, sum(a.v * b.v) AS sim FROM qs JOIN idx a ON a.id = q JOIN idx b ON b.i = a.i GROUP BY ALL),
    t AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY round(sim, 12) DESC, id) AS r FROM s)
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 12) DESC, label) AS rank, label, id, round_even(sim, 4) AS similarity FROM t WHERE r = 1""")
def search_own_index(b):
    piece = F.lpad(F.floor(F.col("frame") / 10).cast("string"), 4, "0")
    frames = b.pose.select(F.concat(F.lit("s"), F.col("clip").cast("string"), F.lit("_"), piece).alias("segment_id"), "clip",
                           (F.col("frame") % 10).alias("frame"), F.slice("pts", 1, 4).alias("pts"))
    manifest = frames.groupBy("segment_id").agg(F.concat(F.lit("L"), (F.max("clip") % 4).cast("string")).alias("label"))
    index = checkpointed(LE.embedding_index(frames.drop("clip"), manifest))
    first = index.groupBy(F.col("label").alias("query_id")).agg(F.min_by("vector", "id").alias("query"))
    return SE.find_similar(index, first)


@query("j01_class_centroids", """SELECT 'L' || label AS label, round(sum(v * i), 6) AS weighted FROM (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL) GROUP BY label""")
def class_centroids(b):
    weighted = F.aggregate(F.transform("centroid", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    return SE.centroids(vectors(b)).select("label", F.round(weighted, 6).alias("weighted"))


@query("j02_kmeans")
def kmeans(b):
    return SE.kmeans(vectors(b), 10)


def _axis_sql(name: str, source: str, squarings: int = 16) -> str:
    """First axis of a matrix (i, j, c) by squaring it again and again; ``name`` has i and v, signed like the library's."""
    steps = [f"{name}_0 AS (SELECT i, j, c / (SELECT sum(c) FROM {source} WHERE i = j) AS c FROM {source})"]
    for k in range(1, squarings + 1):
        steps.append(f"""{name}_r{k} AS (SELECT a.i, b.j, sum(a.c * b.c) AS c FROM {name}_{k - 1} a JOIN {name}_{k - 1} b ON a.j = b.i GROUP BY ALL),
    {name}_{k} AS (SELECT i, j, c / (SELECT sum(c) FROM {name}_r{k} WHERE i = j) AS c FROM {name}_r{k})""")
    last = f"{name}_{squarings}"
    steps.append(f"""{name} AS (SELECT i, c / sqrt(sum(c * c) OVER ()) * sign(max_by(c, abs(c)) OVER ()) AS v FROM {last} WHERE j = (SELECT max_by(i, c) FROM {last} WHERE i = j))""")
    return ",\n    ".join(steps)


PCA_SQL = f"""WITH e AS (SELECT vec_id AS id, i, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS i)),
    z AS (SELECT id, i, v - avg(v) OVER (PARTITION BY i) AS v FROM e),
    cov AS (SELECT a.i, b.i AS j, sum(a.v * b.v) AS c FROM z a JOIN z b USING (id) GROUP BY ALL),
    {_axis_sql('first', 'cov')},
    size_ AS (SELECT sum(f.v * c * g.v) AS l FROM cov JOIN first f ON f.i = cov.i JOIN first g ON g.i = cov.j),
    rest AS (SELECT cov.i, cov.j, c - l * f.v * g.v AS c FROM cov JOIN first f ON f.i = cov.i JOIN first g ON g.i = cov.j, size_),
    {_axis_sql('second', 'rest')}
    SELECT id, round(sum(z.v * f.v), 6) AS x, round(sum(z.v * s.v), 6) AS y FROM z JOIN first f USING (i) JOIN second s USING (i) GROUP BY id"""


@query("j03_pca_2d", PCA_SQL)
def pca_2d(b):
    return SE.pca_2d(vectors(b)).select("id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("g18_cluster_summary", """WITH m AS (SELECT p_brand AS cluster_id, p_partkey AS segment_id, p_name AS label, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rn FROM part),
    l AS (SELECT cluster_id, label, count(*) AS n, min(rn) AS seen FROM m WHERE rn <= 10 GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, seen) AS k FROM l),
    t AS (SELECT cluster_id, string_agg(label || '(' || n || ')', ', ' ORDER BY k) AS sample_texts FROM r WHERE k <= 5 GROUP BY 1), s AS (SELECT cluster_id, count(*) AS size, string_agg(CAST(segment_id AS VARCHAR), ', ' ORDER BY rn) FILTER (rn <= 5) AS representative_ids FROM m GROUP BY 1)
    SELECT * FROM s JOIN t USING (cluster_id)""")
def cluster_summary(b):
    rows = b.table("part").select(F.col("p_partkey").alias("segment_id"), F.col("p_brand").alias("cluster_id"), F.col("p_name").alias("label"))
    return SE.cluster_summary(rows.drop("label"), rows)


@query("j04_apply_cluster_names", "SELECT p_partkey AS segment_id, CASE WHEN p_brand LIKE '%1%' THEN 'named ' || p_brand ELSE p_name END AS label FROM part")
def apply_cluster_names(b):
    part = b.table("part")
    names = part.select(F.col("p_brand").alias("cluster_id"), F.when(F.col("p_brand").contains("1"), F.concat(F.lit("named "), "p_brand")).otherwise(" ").alias("name")).distinct()
    return SE.apply_cluster_names(part.select(F.col("p_partkey").alias("segment_id"), F.col("p_name").alias("label")),
                                  part.select(F.col("p_partkey").alias("segment_id"), F.col("p_brand").alias("cluster_id")), names)


# -- collector -----------------------------------------------------------------------------------

THEMES_SQL = "themes AS (SELECT row_number() OVER (ORDER BY p_type) AS theme_id, p_type AS name, '' AS emoji, row_number() OVER (ORDER BY p_type) AS sort_order FROM (SELECT DISTINCT p_type FROM part))"
WORDS_SQL = f"{THEMES_SQL}, words AS (SELECT p_partkey AS word_id, upper(replace(p_name, ' ', '-')) || '-' || p_size AS gloss_id, p_name AS word, theme_id, CAST(40 AS BIGINT) AS target FROM part JOIN themes ON name = p_type)"
REC_SQL = f"""{WORDS_SQL}, recs AS (SELECT l_orderkey * 8 + l_linenumber AS recording_id, l_partkey AS word_id, o_custkey AS user_id, CASE l_returnflag WHEN 'A' THEN 'approved' WHEN 'N' THEN 'pending' ELSE 'rejected' END AS status,
    CAST(l_shipdate AS DATE) AS day FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"""


def themes(b):
    types = b.table("part").select("p_type").distinct()
    ranked = rank_in_groups(types, [], F.substring("p_type", 1, 1), [F.col("p_type")], "n")
    return ranked.select((F.col("n") + 1).alias("theme_id"), F.col("p_type").alias("name"), F.lit("").alias("emoji"), (F.col("n") + 1).alias("sort_order"))


def words(b):
    rows = b.table("part").join(themes(b).select("theme_id", F.col("name").alias("p_type")), "p_type")
    gloss = F.concat(F.upper(F.replace(F.col("p_name"), F.lit(" "), F.lit("-"))), F.lit("-"), F.col("p_size").cast("string"))
    return rows.select(F.col("p_partkey").alias("word_id"), gloss.alias("gloss_id"), F.col("p_name").alias("word"), "theme_id", F.lit(40).cast("long").alias("target"))


def recordings(b):
    state = F.when(F.col("l_returnflag") == "A", "approved").when(F.col("l_returnflag") == "N", "pending").otherwise("rejected")
    owners = b.table("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return b.table("lineitem").join(owners, "l_orderkey").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("recording_id"), F.col("l_partkey").alias("word_id"), F.col("o_custkey").alias("user_id"),
        state.alias("status"), F.col("l_shipdate").cast("date").alias("day"))


@query("k01_collector_status", f"""WITH {REC_SQL} SELECT (SELECT count(*) FROM words) AS words, (SELECT count(*) FROM themes) AS themes, count(*) FILTER (status = 'pending') AS recordings_pending, count(*) FILTER (status = 'approved') AS recordings_approved,
      count(*) FILTER (status = 'rejected') AS recordings_rejected, count(DISTINCT user_id) AS active_users, count(*) FILTER (day = DATE '1998-03-05') AS today FROM recs""")
def collector_status(b):
    return K.status(words(b), themes(b), recordings(b), F.lit("1998-03-05").cast("date"))


@query("k02_themes", f"WITH {REC_SQL} SELECT theme_id, name, emoji, (SELECT count(*) FROM words w WHERE w.theme_id = t.theme_id) AS words, (SELECT count(*) FROM recs r JOIN words w USING (word_id) WHERE w.theme_id = t.theme_id) AS recordings FROM themes t")
def themes_overview(b):
    return K.themes_overview(themes(b), words(b), recordings(b))


@query("k03_words", f"WITH {WORDS_SQL} SELECT * FROM words WHERE theme_id = 2 AND (contains(lower(word), 'gear') OR contains(lower(gloss_id), 'gear')) ORDER BY word_id LIMIT 50")
def list_words(b):
    return K.list_words(words(b), 2, "GEAR")


@query("k03_recordings", f"WITH {REC_SQL} SELECT * FROM (SELECT DISTINCT recording_id FROM recs SEMI JOIN (SELECT word_id FROM words WHERE theme_id = 1) USING (word_id) WHERE status = 'pending') ORDER BY recording_id LIMIT 20")
def list_recordings(b):
    rows = recordings(b).select("recording_id", "word_id", "status").dropDuplicates(["recording_id", "word_id", "status"])
    pending = rows.join(words(b).filter("theme_id = 1").select("word_id"), "word_id", "left_semi").filter("status = 'pending'")
    return K.list_recordings(pending.select("recording_id", "word_id", "status").dropDuplicates(["recording_id"]), words(b), "pending", 1).select("recording_id")


LINE = "CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN concat(' ,', p_name) WHEN 2 THEN concat('NEW-', p_size, ', ', p_name, ' ,http://x') ELSE concat(upper(replace(p_name, ' ', '-')), '-', p_size, ',', p_name) END"


@query("k04_bulk_import", f"""WITH {WORDS_SQL}, l AS (SELECT p_partkey % 5 AS m, CASE WHEN p_partkey % 5 = 2 THEN 'NEW-' || p_size ELSE upper(replace(p_name, ' ', '-')) || '-' || p_size END AS g FROM part)
    SELECT (SELECT count(DISTINCT g) FROM l WHERE m >= 2 AND g NOT IN (SELECT gloss_id FROM words WHERE word_id % 2 = 0)) AS imported,
      (SELECT count(*) FROM l WHERE m >= 1) - (SELECT count(DISTINCT g) FROM l WHERE m >= 2 AND g NOT IN (SELECT gloss_id FROM words WHERE word_id % 2 = 0)) AS skipped""")
def bulk_import(b):
    parsed = K.parse_import(b.table("part").select(F.expr(LINE).alias("line")))
    return K.import_counts(parsed, words(b).filter("word_id % 2 = 0"))


# Lines in the order of their keys against every second word; a gloss that is there or came before clashes.
IMPORT_SQL = f"""{WORDS_SQL}, l AS (SELECT p_partkey AS n, p_partkey % 5 AS m, p_name AS w, CASE WHEN p_partkey % 5 = 2 THEN 'NEW-' || p_size ELSE upper(replace(p_name, ' ', '-')) || '-' || p_size END AS g FROM part),
    old AS (SELECT * FROM words WHERE word_id % 2 = 0),
    ok AS (SELECT *, g IN (SELECT gloss_id FROM old) OR row_number() OVER (PARTITION BY g ORDER BY n) > 1 AS clash FROM l WHERE m >= 2)"""
NEW_THEME = "(SELECT max(theme_id) + 1 FROM themes)"
OLD_THEME = "(SELECT theme_id FROM themes WHERE name = 'ECONOMY')"


def imported(b, theme):
    lines = b.table("part").select(F.col("p_partkey").alias("line_no"), F.expr(LINE).alias("line"))
    return K.bulk_import(lines, words(b).filter("word_id % 2 = 0"), themes(b), theme)


def import_totals(b, theme):
    return imported(b, theme).totals.withColumn("sample_errors", F.array_join("sample_errors", "; "))


def totals_sql(theme):
    return f"""WITH {IMPORT_SQL} SELECT (SELECT count(*) FROM ok WHERE NOT clash) AS imported, (SELECT count(*) FROM l WHERE m = 1) + (SELECT count(*) FROM ok WHERE clash) AS skipped,
      {theme} AS theme_id, (SELECT string_agg(g || ': already there', '; ' ORDER BY n) FROM (SELECT * FROM ok WHERE clash ORDER BY n LIMIT 5)) AS sample_errors"""


@query("k04_import_totals_new_theme", totals_sql(NEW_THEME))
def import_totals_new_theme(b):
    return import_totals(b, "From a list")


@query("k04_import_totals_old_theme", totals_sql(OLD_THEME))
def import_totals_old_theme(b):
    return import_totals(b, "ECONOMY")


@query("k04_imported_words", f"""WITH {IMPORT_SQL} SELECT word_id, gloss_id, word, theme_id, target, NULL::VARCHAR AS link_a FROM old UNION ALL
    SELECT (SELECT max(word_id) FROM old) + row_number() OVER (ORDER BY n), g, w, {NEW_THEME}, 50, CASE WHEN m = 2 THEN 'http://x' END FROM ok WHERE NOT clash""")
def imported_words(b):
    return imported(b, "From a list").words.drop("link_b")


@query("k04_imported_themes", f"WITH {THEMES_SQL} SELECT * FROM themes UNION ALL SELECT max(theme_id) + 1, 'From a list', '', max(sort_order) + 1 FROM themes")
def imported_themes(b):
    return imported(b, "From a list").themes


@query("k04_rejected_lines", f"""WITH {IMPORT_SQL} SELECT n AS line_no, g AS gloss_id, w AS word, g || ': already there' AS reason FROM ok WHERE clash
    UNION ALL SELECT n, '', w, 'blank gloss or word' FROM l WHERE m = 1""")
def rejected_lines(b):
    return imported(b, "From a list").rejected


@query("k04_import_lines", """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'ignored' WHEN 1 THEN 'skipped' ELSE 'ok' END AS state, CASE p_partkey % 5 WHEN 0 THEN '' ELSE p_name END AS word, CASE p_partkey % 5 WHEN 2 THEN 'http://x' END AS link_a FROM part""")
def import_lines(b):
    return K.parse_import(b.table("part").select("p_partkey", F.expr(LINE).alias("line"))).select("p_partkey", "state", "word", "link_a")


@query("k05_coverage", f"WITH {REC_SQL}, c AS (SELECT word_id, count(recording_id) AS n FROM words LEFT JOIN recs USING (word_id) GROUP BY 1) SELECT CASE WHEN n >= 50 THEN '50+' WHEN n >= 20 THEN '20-49' WHEN n >= 10 THEN '10-19' ELSE '<10' END AS bucket, count(*) AS words FROM c GROUP BY 1")
def coverage(b):
    return K.coverage(words(b), recordings(b))


@query("k05_most_needed", f"WITH {REC_SQL}, c AS (SELECT word_id, word, target, count(recording_id) AS n FROM words LEFT JOIN recs USING (word_id) GROUP BY ALL) SELECT word_id, word, n AS recordings, target - n AS gap FROM c WHERE target - n >= 1 ORDER BY gap DESC, word_id LIMIT 20")
def most_needed(b):
    return K.most_needed(words(b), recordings(b))


@query("k06_leaderboard", f"WITH {REC_SQL} SELECT user_id, count(*) AS recordings FROM recs GROUP BY user_id ORDER BY recordings DESC, user_id LIMIT 10")
def leaderboard(b):
    return K.leaderboard(recordings(b))


@query("k07_add_themes", f"WITH {THEMES_SQL}, m AS (SELECT max(theme_id) AS i, max(sort_order) AS s FROM themes), fresh AS (SELECT DISTINCT p_brand AS name, row_number() OVER (ORDER BY p_brand) AS n FROM (SELECT DISTINCT p_brand FROM part)) SELECT theme_id, name, emoji, sort_order FROM themes UNION ALL SELECT i + n, name, '*', s + n FROM fresh, m")
def add_themes(b):
    new = b.table("part").select(F.col("p_brand").alias("name"), F.lit("*").alias("emoji"), F.lit(0).cast("long").alias("sort_order")).distinct().unionByName(
        b.table("part").select(F.col("p_type").alias("name"), F.lit("*").alias("emoji"), F.lit(0).cast("long").alias("sort_order")).distinct())
    return K.add_themes(themes(b), new)


@query("f23_sync_with_training", f"""WITH {WORDS_SQL}, w AS (SELECT DISTINCT gloss_id AS g FROM words), l AS (SELECT DISTINCT gloss_id AS g FROM words WHERE word_id % 2 = 0)
    SELECT (SELECT count(*) FROM w) AS words, (SELECT count(*) FROM w WHERE g IN (SELECT g FROM l)) AS with_data, (SELECT count(*) FROM w WHERE g NOT IN (SELECT g FROM l)) AS without_data,
      coalesce((SELECT string_agg(g, ',' ORDER BY g) FROM (SELECT g FROM w WHERE g NOT IN (SELECT g FROM l) ORDER BY g LIMIT 30)), '') AS new_sample""")
def sync_with_training(b):
    w = words(b)
    return K.sync_with_training(w, w.filter("word_id % 2 = 0").select(F.col("gloss_id").alias("label")))


@query("k07_add_words", f"""WITH {WORDS_SQL}, w AS (SELECT * FROM words WHERE word_id % 2 = 0), f AS (SELECT gloss_id, min(word) AS word FROM words WHERE word_id % 2 = 1 AND gloss_id NOT IN (SELECT gloss_id FROM w) GROUP BY gloss_id)
    SELECT gloss_id, word, true AS id_ok FROM w UNION ALL SELECT gloss_id, word, true FROM f""")
def add_words(b):
    w = words(b)
    even = w.filter("word_id % 2 = 0")
    out = K.add_words(even, w.filter("word_id % 2 = 1"))
    unique = out.groupBy("word_id").agg(F.count(F.lit(1)).alias("n")).filter("n = 1").select("word_id")
    return out.join(unique, "word_id").select("gloss_id", "word", F.lit(True).alias("id_ok"))


@query("k07_new_word_ids", f"""WITH {WORDS_SQL}, w AS (SELECT * FROM words WHERE word_id % 2 = 0), f AS (SELECT DISTINCT gloss_id FROM words WHERE word_id % 2 = 1 AND gloss_id NOT IN (SELECT gloss_id FROM w))
    SELECT count(*) AS n, count(*) AS n_ids, CASE WHEN count(*) > 0 THEN (SELECT max(word_id) FROM w) + 1 END AS first_id, CASE WHEN count(*) > 0 THEN (SELECT max(word_id) FROM w) + count(*) END AS last_id FROM f""")
def new_word_ids(b):
    w = words(b)
    even = w.filter("word_id % 2 = 0")
    new = K.add_words(even, w.filter("word_id % 2 = 1")).join(even.select("gloss_id").distinct(), "gloss_id", "left_anti")
    return new.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("word_id").alias("n_ids"), F.min("word_id").alias("first_id"), F.max("word_id").alias("last_id"))
