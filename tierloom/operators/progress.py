"""Counts and status tables: reviews, pipeline, runs, sources, models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierloom.fixed_values import RETRAIN_STEPS
from tierloom.functions.single_row import side_by_side
from tierloom.functions.text import blank


def value_counts(rows: DataFrame, column: str, top: int | None = None) -> DataFrame:
    counts = rows.filter(~blank(column)).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), column).limit(top) if top else counts


def milestones(rows: DataFrame, label: str = "label") -> DataFrame:
    """Share of each annotation milestone reached, at most 100 per cent."""
    total = rows.agg(F.count_if(~blank(label)).alias("n"))
    steps = F.array(*[F.lit(s).cast("long") for s in RETRAIN_STEPS])
    return total.select("n", F.explode(steps).alias("milestone")).select(
        "milestone", F.least(F.lit(100.0), F.col("n") / F.col("milestone") * 100).alias("percent"))


def review_progress(segments: DataFrame, stem: str = "stem") -> DataFrame:
    """Segments, pending ones and the reviewed share per video, most pending first."""
    pending = F.count_if(F.col("status") == "pending")
    rows = segments.groupBy(stem).agg(F.count(F.lit(1)).alias("n_segs"), pending.alias("n_pending"))
    share = (F.col("n_segs") - F.col("n_pending")) / F.greatest(F.lit(1), F.col("n_segs"))
    return rows.withColumn("reviewed", share).orderBy(F.desc("n_pending"), stem)


def paired_signs(pairings: DataFrame) -> DataFrame:
    """Paired signs and their distinct glosses; suggestions do not count."""
    paired = pairings.filter(F.col("status") == "paired")
    return paired.agg(F.count(F.lit(1)).alias("n_paired"), F.count_distinct("gloss_id").alias("n_glosses"))


def paired_per_segment(pairings: DataFrame) -> DataFrame:
    """Paired or auto-suggested signs per segment."""
    return pairings.filter(F.col("status").isin("paired", "auto_suggested")).groupBy("segment_id").agg(
        F.count(F.lit(1)).alias("n_paired"))


def pipeline_status(videos: DataFrame, poses: DataFrame, segments: DataFrame, pairings: DataFrame,
                    glossary: DataFrame, models: DataFrame) -> DataFrame:
    """One row with the size of every stage, the newest model's accuracy and the next threshold."""
    one = side_by_side(
        videos.agg(F.count(F.lit(1)).alias("videos")), poses.agg(F.count(F.lit(1)).alias("poses_extracted")),
        segments.agg(F.count(F.lit(1)).alias("segments_total"),
                     F.count_if(F.col("status") == "approved").alias("segments_approved")),
        pairings.agg(F.count_if(F.col("status") == "paired").alias("signs_paired"),
                     F.count_distinct(F.when(F.col("status") == "paired", F.col("gloss_id"))).alias("unique_glosses")),
        glossary.agg(F.count_distinct("gloss_id").alias("glossary_entries")),
        models.agg(F.count(F.lit(1)).alias("checkpoints"), F.max_by("val_acc", F.struct("timestamp", "filename")).alias("latest_val_acc")))
    return one.withColumn("next_threshold", next_step(F.col("signs_paired")))


def next_step(n: Column) -> Column:
    result = F.lit(RETRAIN_STEPS[-1])
    for step in reversed(RETRAIN_STEPS):
        result = F.when(n < step, step).otherwise(result)
    return result.cast("long")


def step_status(done: Column, total: Column) -> Column:
    return F.when((total > 0) & (done >= total), "done").when(done > 0, "partial").otherwise("pending")


def inventory_totals(inventory: DataFrame) -> DataFrame:
    """Videos, hours, extracted and missing poses, and the extracted share in per cent."""
    n, have = F.count(F.lit(1)), F.count_if("pose_extracted")
    return inventory.agg(
        n.alias("videos"), F.round(F.sum("duration_sec") / 3600, 3).alias("hours"), have.alias("extracted"),
        (n - have).alias("missing"), F.round(have / F.greatest(n, F.lit(1)) * 100, 3).alias("percent"))


def retrain_state(counts: DataFrame) -> DataFrame:
    """Current and next threshold, and whether one was crossed since the last training.

    ``counts`` has n_paired and last_trained.
    """
    n, last = F.col("n_paired"), F.col("last_trained")
    steps = F.array(*[F.lit(s).cast("long") for s in RETRAIN_STEPS])
    current = F.coalesce(F.array_max(F.filter(steps, lambda t: t <= n)), F.lit(0).cast("long"))
    crossed = F.array_max(F.filter(steps, lambda t: (t <= n) & (t > last)))
    reason = F.format_string("Sign count (%d) crossed threshold %d. Last model was trained at %d signs.", n, crossed, last)
    return counts.select(
        "*", crossed.isNotNull().alias("should_retrain"), current.alias("current_threshold"),
        next_step(n).alias("next_threshold"), F.when(crossed.isNotNull(), reason).otherwise("").alias("reason"))


def inference_summary(predictions: DataFrame) -> DataFrame:
    """Per video: predictions, mean confidence and counts per hand."""
    return predictions.groupBy("stem").agg(
        F.count(F.lit(1)).alias("n_predictions"), F.bround(F.avg("confidence"), 3).alias("mean_confidence"),
        F.count_if(F.col("hand") == "right").alias("rh"), F.count_if(F.col("hand") == "left").alias("lh"))


def run_totals(results: DataFrame) -> DataFrame:
    """Totals of a batch run over (stem, status, n_segments)."""
    def n(status: str) -> Column:
        return F.count_if(F.col("status") == status)

    return results.agg(n("ok").alias("n_processed"), n("skipped").alias("n_skipped"), n("error").alias("n_errors"),
                       F.coalesce(F.sum("n_segments"), F.lit(0).cast("long")).alias("total_predictions"))


def manifest_counts(manifest: DataFrame) -> DataFrame:
    return manifest.agg(F.count(F.lit(1)).alias("samples"), F.count_distinct("label").alias("labels"),
                        F.count_distinct("segment_id").alias("videos"))


def article_stats(articles: DataFrame) -> DataFrame:
    return articles.agg(F.count(F.lit(1)).alias("articles"), F.count("youtube_id").alias("with_video"),
                        F.count_if(F.length("text") > 50).alias("with_text"))


def files_per_source(stems: DataFrame) -> DataFrame:
    """Files per source, unmatched ones included, and a total row."""
    rows = stems.groupBy(F.coalesce("source", F.lit("unmatched")).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    return rows.unionByName(stems.agg(F.count(F.lit(1)).alias("n")).select(F.lit("TOTAL").alias("source"), "n"))


def samples_per_source(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("source").agg(F.count(F.lit(1)).alias("samples"), F.count_distinct("label").alias("labels"))


def preannotation_status(videos: DataFrame, ai_annotations: DataFrame) -> DataFrame:
    """done with AI annotations, error if unreadable, else pending."""
    counts = ai_annotations.groupBy("stem").agg(F.count(F.lit(1)).alias("n_ai"))
    rows = videos.join(counts, "stem", "left").withColumn("n_ai", F.coalesce("n_ai", F.lit(0).cast("long")))
    state = F.when(F.col("n_ai") > 0, "done").when(F.col("unreadable"), "error").otherwise("pending")
    return rows.select("stem", "n_ai", state.alias("state"))


def rank_experiments(runs: DataFrame, top: int | None = None) -> DataFrame:
    """Successful runs by best validation accuracy; the first is the winner."""
    ok = runs.filter((F.col("status") == "ok") & F.col("best_val_acc").isNotNull()).orderBy(F.desc("best_val_acc"), "run")
    return ok.limit(top) if top else ok


def remaining_runs(planned: DataFrame, logged: DataFrame) -> DataFrame:
    return planned.join(logged.select("run").distinct(), "run", "left_anti")


def model_listing(models: DataFrame) -> DataFrame:
    return models.filter("readable").select(
        "filename", "n_classes", "val_acc", "epoch", "timestamp").orderBy("filename")
