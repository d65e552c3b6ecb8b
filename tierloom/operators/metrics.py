"""Evaluation of predictions and choice of models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MATRIX_CLASSES = 200


def accuracy(scored: DataFrame) -> DataFrame:
    """Accuracy and top-3 accuracy (4 digits) over (truth, predicted, top3 array<struct<gloss,...>>)."""
    hit = F.col("truth") == F.col("predicted")
    near = F.array_contains(F.col("top3.gloss"), F.col("truth"))
    return scored.agg(
        F.bround(F.avg(hit.cast("double")), 4).alias("accuracy"), F.bround(F.avg(near.cast("double")), 4).alias("top3_accuracy"),
        F.count(F.lit(1)).alias("n_samples"))


def confusion(scored: DataFrame) -> DataFrame:
    """Counts by (truth, predicted)."""
    return scored.groupBy("truth", "predicted").agg(F.count(F.lit(1)).alias("n"))


def confusion_grid(scored: DataFrame, classes: DataFrame, most: int = MATRIX_CLASSES) -> DataFrame:
    """All class pairs with zeros, the dense form of ``confusion``, for at most ``most`` classes.

    Above that it raises: the sparse counts of ``confusion`` hold for any number of classes. The class list is
    one array of at most ``most`` names, so the grid is bounded.
    """
    few = classes.select("label").distinct().limit(most + 1)
    if few.count() > most:
        raise ValueError(f"more than {most} classes; use confusion()")
    names = few.agg(F.array_sort(F.collect_list("label")).alias("names"))
    grid = names.select("names", F.explode("names").alias("truth")).select("truth", F.explode("names").alias("predicted"))
    return grid.join(confusion(scored), ["truth", "predicted"], "left").withColumn(
        "n", F.coalesce("n", F.lit(0).cast("long")))


def per_class(scored: DataFrame, classes: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of every class; classes without support are kept.

    Counts come from the confusion table, which is small next to the predictions.
    """
    cm = confusion(scored)
    zero = F.lit(0).cast("long")
    hit = F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(zero)
    rows = (
        cm.select(F.col("truth").alias("label"), hit.alias("tp"), F.col("n").alias("support"), zero.alias("predicted"))
        .unionByName(cm.select(F.col("predicted").alias("label"), zero.alias("tp"), zero.alias("support"), F.col("n").alias("predicted")))
        .unionByName(classes.select("label", zero.alias("tp"), zero.alias("support"), zero.alias("predicted"))))
    sums = rows.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("tp", "support", "predicted")])
    precision = F.col("tp") / F.greatest(F.lit(1), F.col("predicted"))
    recall = F.col("tp") / F.greatest(F.lit(1), F.col("support"))
    f1 = 2 * precision * recall / F.greatest(F.lit(1e-8), precision + recall)
    return sums.select("label", F.bround(precision, 4).alias("precision"), F.bround(recall, 4).alias("recall"),
                       F.bround(f1, 4).alias("f1"), "support")


def best_classes(classes: DataFrame, top: int = 5) -> DataFrame:
    return classes.orderBy(F.desc("f1"), "label").limit(top)


def compare_models(evaluations: DataFrame) -> DataFrame:
    """One row per model: accuracy, top-3 accuracy, samples and classes."""
    return evaluations.select("model", "accuracy", "top3_accuracy", "n_samples", "n_classes").orderBy("model")


def pick_model(evaluations: DataFrame, registry: DataFrame, least_classes: int = 200) -> DataFrame:
    """File of the best word model: by evaluation accuracy, else by validation accuracy, else null.

    Only models with enough classes count. On equal accuracy the first by name stays.
    """
    def rows(df: DataFrame, source: int, score: str, name):
        return df.filter(F.col("n_classes") >= least_classes).select(
            F.struct(F.lit(source).alias("source"), (-F.col(score)).alias("loss"), name.alias("filename")).alias("r"))

    both = rows(evaluations, 0, "accuracy", F.concat("model", F.lit(".pt"))).unionByName(
        rows(registry, 1, "val_acc", F.col("filename")))
    return both.agg(F.min("r")["filename"].alias("filename"))


def latest_model(registry: DataFrame) -> DataFrame:
    """The model with the newest time stamp; the first by name on ties."""
    best = registry.agg(F.max("timestamp").alias("timestamp"))
    return registry.join(best, "timestamp").groupBy("timestamp").agg(
        F.min(F.struct("filename", "n_train", "val_acc")).alias("m")).select("timestamp", "m.*")


def category_models(registry: DataFrame, least: float = 0.3) -> DataFrame:
    return registry.filter(F.col("filename").startswith("cat") & (F.col("val_acc") > least)).orderBy(
        F.desc("val_acc"), "filename")
