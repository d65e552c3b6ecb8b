"""Training and inference jobs built from the operators and Spark ML."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierloom.functions.labels import label_codes
from tierloom.operators.gates import batch_eligibility
from tierloom.operators.label_sets import quality_filter, split_per_label
from tierloom.operators.landmarks import export_segments, feature_mode, mean_pool, pad_or_truncate
from tierloom.operators.matching import tier_rows
from tierloom.operators.metrics import accuracy, per_class
from tierloom.operators.progress import run_totals
from tierloom.operators.search import build_index, classify
from tierloom.operators.signal import detect_segments, frames_of_segments
from tierloom.session import checkpointed


@dataclass
class Trained:
    model: LogisticRegressionModel
    codes: DataFrame
    scored: DataFrame
    metrics: DataFrame
    classes: DataFrame


def predict(model: LogisticRegressionModel, rows: DataFrame, codes: DataFrame, identity: str) -> DataFrame:
    """Predicted label, confidence (4 digits) and the three best labels per row."""
    out = model.transform(rows)
    ranked = F.slice(F.array_sort(F.transform(vector_to_array("probability"), lambda p, i: F.struct(
        (-p).alias("down"), i.cast("long").alias("code")))), 1, 3)
    names = codes.select("code", F.col("label").alias("gloss"))
    parts = out.select(identity, F.posexplode(ranked).alias("place", "r")).select(
        identity, "place", F.col("r.code").alias("code"), F.bround(-F.col("r.down"), 4).alias("confidence"))
    top3 = parts.join(names, "code").groupBy(identity).agg(F.array_sort(F.collect_list(
        F.struct("place", "gloss", "confidence"))).alias("t"))
    items = F.transform("t", lambda x: F.struct(x["gloss"].alias("gloss"), x["confidence"].alias("confidence")))
    return top3.select(identity, items.alias("top3")).select(
        identity, F.col("top3")[0]["gloss"].alias("predicted"), F.col("top3")[0]["confidence"].alias("confidence"), "top3")


def train_baseline(rows: DataFrame, identity: str = "id", penalties: Sequence[float] = (0.0, 0.01),
                   iterations: int = 20) -> Trained:
    """Logistic regression on pooled vectors: fit on train, choose the penalty on val, report on test.

    ``rows``: identity, label, vector, split.
    """
    # Every fit reads the vectors many times: write them once instead of deriving them again.
    rows = checkpointed(rows.select(identity, "label", "split", "vector"))
    codes = checkpointed(label_codes(rows))
    data = rows.join(codes, "label").select(
        identity, "label", "split", F.col("code").cast("double").alias("code"),
        array_to_vector(F.transform("vector", lambda v: v.cast("double"))).alias("features"))
    train, val, test = (data.filter(F.col("split") == s) for s in ("train", "val", "test"))
    best, best_score = None, -1.0
    for penalty in penalties:
        model = LogisticRegression(labelCol="code", featuresCol="features", maxIter=iterations, regParam=penalty).fit(train)
        hits = model.transform(val).agg(F.avg((F.col("prediction") == F.col("code")).cast("double"))).first()[0] or 0.0
        if hits > best_score:
            best, best_score = model, hits
    scored = predict(best, test.drop("code"), codes, identity).join(
        test.select(identity, F.col("label").alias("truth")), identity)
    return Trained(best, codes, scored, accuracy(scored), per_class(scored, codes.select("label")))


def pooled_vectors(frames: DataFrame, keys: Sequence[str], mode: str = "raw", length: int = 300) -> DataFrame:
    """One vector per clip: features of a mode, cut or padded, averaged over real frames."""
    return mean_pool(pad_or_truncate(feature_mode(frames, mode, keys), length, keys), keys)


def embedding_index(frames: DataFrame, manifest: DataFrame, mode: str = "raw") -> DataFrame:
    """Index of exported segments with a label: id, label, unit vector; ``frames``: segment_id, frame, pts."""
    vectors = pooled_vectors(frames, ["segment_id"], mode).withColumnRenamed("segment_id", "id")
    return build_index(vectors.join(manifest.select(F.col("segment_id").alias("id"), "label"), "id"))


def retrain_cycle(pairings: DataFrame, pose: DataFrame, mode: str = "raw", min_samples: int = 3) -> Trained:
    """Paired signs to a new model: export, manifest, quality filter, split, encode, train, report.

    ``pairings``: pairing_id, clip, sign_frame_start, sign_frame_end, gloss_id, status.
    """
    signs = pairings.filter(F.col("status") == "paired").select(
        "pairing_id", "clip", F.col("gloss_id").alias("label"), F.col("sign_frame_start").alias("frame_start"),
        F.col("sign_frame_end").alias("frame_end")).filter("frame_end > frame_start")
    exported = export_segments(pose, signs, None).select("pairing_id", F.col("rel").alias("frame"), "pts")
    vectors = pooled_vectors(exported, ["pairing_id"], mode)
    manifest = quality_filter(signs.select("pairing_id", "label"), min_samples)
    rows = split_per_label(vectors.join(manifest, "pairing_id"), "pairing_id")
    return train_baseline(rows, "pairing_id")


def batch_inference(videos: DataFrame, files: DataFrame, signal: DataFrame, features: DataFrame,
                    centres: DataFrame, least_bytes: int = 10_000, **detection) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Predictions, their tier rows and the run totals for all eligible videos.

    ``signal``: clip, hand, frame, x, y, conf, fps; ``features``: clip, frame, features (array).
    """
    able = files.filter(F.col("bytes") >= least_bytes).select(F.col("stem").alias("clip")).distinct()
    found = detect_segments(signal.join(able, "clip", "left_semi"), ["clip", "hand"], **detection)
    found = found.withColumn("id", F.concat_ws("_", F.col("clip").cast("string"), F.col("start_ms").cast("string"), "hand"))
    inside = frames_of_segments(features, found.select("id", "clip", "frame_start", "frame_end"))
    vectors = mean_pool(inside.select("id", "features"), ["id"])
    labelled = classify(vectors, centres)
    predictions = found.join(labelled, "id").select(
        F.col("clip").alias("stem"), "hand", "start_ms", "end_ms", F.col("score").alias("motion_confidence"),
        F.col("predicted").alias("predicted_gloss"), "confidence", "top3")
    results = batch_eligibility(videos, files, predictions.select("stem"), least_bytes)
    return predictions, tier_rows(predictions), run_totals(results)
