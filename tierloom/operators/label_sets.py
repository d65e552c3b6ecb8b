"""Label support filters, unions of sources and reproducible splits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierloom.functions.chunks import rank_by_range, rank_in_groups
from tierloom.functions.draws import bucket, hashed
from tierloom.functions.text import blank, derive_label, normalise_label, plain_label
from tierloom.session import checkpointed


def keep_supported(rows: DataFrame, n: int = 3, label: str = "label") -> DataFrame:
    """Rows whose label has at least ``n`` rows; counts are pre-aggregated, then a semi join."""
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= n)
    return rows.join(counts.select(label), label, "left_semi")


def quality_filter(manifest: DataFrame, n: int = 3, normalise: bool = True) -> DataFrame:
    """Derive, normalise and check labels; ``label_original`` keeps the label as found."""
    rows = manifest
    if "label" not in rows.columns:
        rows = rows.withColumn("label", derive_label("reviewed_text", "text"))
    rows = rows.withColumn("label_original", F.col("label"))
    if normalise:
        rows = rows.withColumn("label", normalise_label("label"))
    return keep_supported(rows.filter(~blank("label")), n)


def quality_preview(manifest: DataFrame, n: int = 3, normalise: bool = True) -> DataFrame:
    """Labels before and after the filter, and segments left."""
    rows = manifest if "label" in manifest.columns else manifest.withColumn(
        "label", derive_label("reviewed_text", "text"))
    label = normalise_label("label") if normalise else F.col("label")
    counts = rows.withColumn("label", label).filter(~blank("label")).groupBy("label").agg(
        F.count(F.lit(1)).alias("n"))
    kept = F.col("n") >= n
    return counts.agg(F.count(F.lit(1)).alias("labels_before"), F.count_if(kept).alias("labels_after"),
                      F.coalesce(F.sum(F.when(kept, F.col("n"))), F.lit(0).cast("long")).alias("segments_after"))


def supported_by_train(train: DataFrame, val: DataFrame, n: int = 3) -> DataFrame:
    """Train and validation rows of labels that have ``n`` training rows; ``split`` tells them apart."""
    counts = train.groupBy("label").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= n).select("label")
    return (train.withColumn("split", F.lit("train")).unionByName(val.withColumn("split", F.lit("val")))
            .join(counts, "label", "left_semi"))


def union_sources(sources: Mapping[str, DataFrame]) -> DataFrame:
    """All manifests with a ``source`` column and plain labels; columns may differ."""
    whole = None
    for name, df in sources.items():
        if "source" not in df.columns:
            df = df.withColumn("source", F.lit(name))
        df = df.withColumn("label", plain_label("label"))
        whole = df if whole is None else whole.unionByName(df, allowMissingColumns=True)
    return whole


def recombine_splits(train: DataFrame, val: DataFrame, test: DataFrame) -> DataFrame:
    return train.unionByName(val, True).unionByName(test, True).withColumn("source", F.lit("existing"))


def label_overlap(rows: DataFrame) -> DataFrame:
    """Shared labels per pair of sources.

    Pairs are made inside one label from its distinct sources, whose number is small
    and independent of the number of rows.
    """
    pairs = rows.select("source", "label").distinct().groupBy("label").agg(
        F.array_sort(F.collect_set("source")).alias("s")).filter(F.size("s") > 1)
    pairs = pairs.select("s", F.posexplode("s").alias("i", "source_a"))
    rest = F.slice("s", F.col("i") + 2, F.size("s"))
    return pairs.select("source_a", F.explode(rest).alias("source_b")).groupBy(
        "source_a", "source_b").agg(F.count(F.lit(1)).alias("shared_labels"))


def _shuffled(rows: DataFrame, keys: Sequence[str], identity: str, seed: int,
              attach: DataFrame | None = None) -> DataFrame:
    """Add ``_rank``, a random order per group that depends only on seed and row identity, and
    the group size ``_n``."""
    rows = rows.withColumn("_draw", hashed(seed, F.col(identity)))
    # The leading bits of the draw cut even one huge label into many even pieces.
    return rank_in_groups(rows, keys, bucket(F.col("_draw")), [F.col("_draw"), F.col(identity)],
                          "_rank", "_n", attach).drop("_draw")


def _int(x: Column) -> Column:
    """Cut toward zero like the sizes being matched."""
    return F.floor(x).cast("long")


def split_per_label(rows: DataFrame, identity: str, train: float = 0.8, val: float = 0.1,
                    test: float = 0.1, seed: int = 42, label: str = "label") -> DataFrame:
    """Add ``split``: per label max(1, int(train n)) train rows, int(val n) validation rows, rest test."""
    if abs(train + val + test - 1.0) >= 1e-6:
        raise ValueError("split ratios must sum to 1")
    rows = rows.filter(F.col(label).isNotNull())
    n_train = F.greatest(F.lit(1), _int(F.col("_n") * train))
    n_val = F.greatest(F.lit(0), _int(F.col("_n") * val))
    part = F.when(F.col("_rank") < n_train, "train").when(F.col("_rank") < n_train + n_val, "val").otherwise("test")
    return _shuffled(rows, [label], identity, seed).withColumn("split", part).drop("_rank", "_n")


def _apportioned(counts: DataFrame, column: str, share: int, total: int, out: str, label: str) -> DataFrame:
    """Deal ``share`` of ``total`` rows to labels in proportion to ``column`` by largest remainders.

    Labels of equal remainder are taken in their order, so the label is part of the range.
    """
    exact = F.col(column) * F.lit(share) / F.lit(total)
    parts = counts.withColumn("_base", F.floor(exact)).withColumn("_left", exact - F.col("_base"))
    missing = share - (parts.agg(F.sum("_base")).first()[0] or 0)
    placed = rank_by_range(parts, [F.desc("_left"), F.col(label)], "_place")
    return placed.withColumn(out, F.col("_base") + (F.col("_place") < missing).cast("long")).select(*counts.columns, out)


def split_stratified(rows: DataFrame, identity: str, held: float = 0.3, seed: int = 42,
                     label: str = "label") -> DataFrame:
    """70/15/15 split. A cut is stratified only if the held-out part has a row per label.

    Where a stratified cut is due but some label has a single row, both cuts are random. Both cuts are
    dealt out on the table of label counts, and one random order per label then tells which rows go where; a
    second order is needed only for a random cut next to a stratified one. Counts alone reach the driver.
    """
    counts = checkpointed(rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")))

    def sizes(df: DataFrame, column: str = "n") -> tuple[int, int, int]:
        total, labels, rarest = df.filter(F.col(column) > 0).agg(F.sum(column), F.count(F.lit(1)), F.min(column)).first()
        return total or 0, labels, rarest or 0

    def part(test: Column, val: Column) -> Column:
        at = F.col("_rank") + test
        return F.when(at >= F.col("_n"), "test").when(at + val >= F.col("_n"), "val").otherwise("train")

    def at_random(df: DataFrame, out: int, names: tuple[str, str], salt: int) -> DataFrame:
        ranked = _shuffled(df, [], identity, seed + salt)
        return ranked.withColumn("split", F.when(F.col("_rank") < F.col("_n") - out, names[0]).otherwise(names[1])).drop("_rank", "_n")

    n, labels, rarest = sizes(counts)
    n_held = -int(-n * held // 1)  # rounded up
    n_test = -int(-n_held * 0.5 // 1)
    strata = n * held >= labels
    if strata and rarest >= 2:
        dealt = checkpointed(_apportioned(counts, "n", n_held, n, "_held", label))
        _, left, least = sizes(dealt, "_held")
        if n_held * 0.5 >= left and least >= 2:
            dealt = _apportioned(dealt, "_held", n_test, n_held, "_test", label).select(label, "_held", "_test")
            ranked = _shuffled(rows, [label], identity, seed, dealt)
            return ranked.withColumn("split", part(F.col("_test"), F.col("_held") - F.col("_test"))).drop("_rank", "_n", "_held", "_test")
        if n_held * 0.5 < left:
            ranked = _shuffled(rows, [label], identity, seed, dealt.select(label, "_held"))
            held_out = F.col("_rank") >= F.col("_n") - F.col("_held")
            train = ranked.filter(~held_out).withColumn("split", F.lit("train"))
            rest = at_random(ranked.filter(held_out).drop("_rank", "_n", "_held"), n_test, ("val", "test"), 1)
            return train.select(*rows.columns, "split").unionByName(rest.select(*rows.columns, "split"))
    elif not strata:
        top = checkpointed(at_random(rows, n_held, ("train", "rest"), 0))
        rest = top.filter("split = 'rest'").drop("split")
        counts = checkpointed(rest.groupBy(label).agg(F.count(F.lit(1)).alias("n")))
        _, left, least = sizes(counts)
        if n_held * 0.5 < left:
            rest = at_random(rest, n_test, ("val", "test"), 1)
            return top.filter("split = 'train'").unionByName(rest)
        if least >= 2:
            dealt = _apportioned(counts, "n", n_test, n_held, "_test", label).select(label, "_test")
            ranked = _shuffled(rest, [label], identity, seed + 1, dealt)
            rest = ranked.withColumn("split", part(F.col("_test"), F.col("_n"))).drop("_rank", "_n", "_test")
            return top.filter("split = 'train'").unionByName(rest)
    # A label with a single row: one random order, cut twice.
    ranked = _shuffled(rows, [], identity, seed)
    return ranked.withColumn("split", part(F.lit(n_test), F.lit(n_held - n_test))).drop("_rank", "_n")


def unified_variants(rows: DataFrame, single: str, smallest: int = 20) -> DataFrame:
    """Row and label counts of the variants 2+, 3+ and one source 2+; variants below ``smallest`` drop out.

    One aggregation by (label, source) feeds all variants.
    """
    counts = rows.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("source") == single).alias("m"))

    def variant(name: str, column: str, least: int) -> Column:
        kept = F.col(column) >= least
        return F.struct(F.lit(name).alias("variant"),
                        F.coalesce(F.sum(F.when(kept, F.col(column))), F.lit(0).cast("long")).alias("n_rows"),
                        F.count_if(kept).alias("n_labels"))

    one = counts.agg(F.array(variant("unified_2plus", "n", 2), variant("unified_3plus", "n", 3),
                             variant("single_2plus", "m", 2)).alias("v"))
    return one.select(F.inline("v")).filter(F.col("n_rows") >= smallest)


def distinct_in_order(rows: DataFrame, keys: Sequence[str], value: str, order: str) -> DataFrame:
    """First place of each value per group; a partial minimum instead of a sort."""
    return rows.groupBy(*keys, value).agg(F.min(order).alias(order))
