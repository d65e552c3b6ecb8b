"""Mix sources to target weights by weighted fair queueing.

Each source deals its documents in a shuffled order, at most ``repeats`` times over. A document's
virtual finish time is the number of source words dealt so far divided by the target of the source,
and the mix takes documents by finish time until the total budget is reached. Only DataFrame
functions are used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tierloom.llm.common import WORD, stored

#: Rows that one ordered bucket should hold at most, on average.
BUCKET_ROWS = 50_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int], repeats: int) -> DataFrame:
    """Targets of sources: shares by weight of all words, none above ``repeats`` times its size.

    What is cut off is shared again by weight. With sources in the order of cap / weight, the level
    is the first at which the words left over, per weight left over, fit under the next cap. The
    table has one row per source. Sources by code point, null last; weights repeat in that order.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    ranked = (
        sizes.withColumn("_w", F.element_at(cycle, (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")).cast("long"))
        .withColumn("_cap", F.col("source_size") * repeats)
    )
    every = Window.partitionBy(F.lit(0))
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_w"), "_cap", F.col("source").isNull(), "source").rowsBetween(
        Window.unboundedPreceding, -1)
    level = (F.col("_all") - F.col("_caps")).cast("double") / (F.col("_weights") - F.col("_below"))
    return (
        ranked.withColumn("_all", F.sum("source_size").over(every)).withColumn("_weights", F.sum("_w").over(every))
        .withColumn("_caps", F.coalesce(F.sum("_cap").over(by_ratio), F.lit(0)))
        .withColumn("_below", F.coalesce(F.sum("_w").over(by_ratio), F.lit(0)))
        .withColumn("_level", level)
        # Levels rise while a cap is exceeded and fall from the first source whose share fits: the largest is the level.
        .withColumn("_level", F.max("_level").over(every))
        .select("source", "source_size", "_all", F.least(
            F.col("_cap").cast("double"), F.col("_level") * F.col("_w")).alias("target"))
    )


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), repeats: int = 3, seed: str = "mix",
        doc_id: str = "doc_id", text: str = "text", source: str = "source", keep: Sequence[str] | None = None) -> DataFrame:
    """Add ``size``, ``source_size``, ``target`` and ``taken`` (words taken, repeats counted) to documents.

    The shuffled order is that of md5(seed, id), so reruns agree; ties go by id and size. Documents
    without words take part with no words. Null texts have no words; null sources form one source.
    An empty table stays empty. Columns named like the added ones are replaced. ``keep`` names the
    columns to carry along (all by default).

    A source is never ordered in one task: rows are numbered inside leading-hash buckets and shifted
    by the sums of the buckets before. Finish times are compared bucket by bucket of virtual time as
    well, and only the bucket in which the budget runs out is put in order.
    """
    added = {"size", "source_size", "target", "taken"}
    carried = [c for c in (keep or docs.columns) if c not in added]
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))))
    rows = stored(docs.select(
        F.struct(*carried).alias("_doc"), F.col(source).alias("source"), F.col(doc_id).alias("_id"),
        word_count(F.col(text)).alias("size"), digest.alias("_h")), "mix")
    aim = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, repeats)
    n = rows.count()
    buckets = max(64, 1 << max(0, (n // BUCKET_ROWS)).bit_length())
    top = F.conv(F.substring("_h", 1, 8), 16, 10).cast("long")
    rows = rows.withColumn("_b", F.floor(top / F.lit((1 << 32) / buckets)).cast("long"))
    shares = rows.groupBy("source", "_b").agg(F.sum("size").alias("_sum"))
    before = Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        shares.withColumn("_shift", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
        .join(aim.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s", "_sum")
        .withColumnsRenamed({"source": "_s", "_b": "_sb"})
    )
    inside = Window.partitionBy("source", "_b").orderBy("_h", "_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        rows.withColumn("_upto", F.sum("size").over(inside))
        .join(shifts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_b") == F.col("_sb")))
        .withColumn("_upto", F.col("_upto") + F.col("_shift"))
    )
    copies = F.sequence(F.lit(0), F.lit(repeats - 1))

    def finish(c: Column) -> Column:
        return (c * F.col("source_size") + F.col("_upto")).cast("double") / F.nullif("target", F.lit(0.0))

    # One row per copy that may be dealt; virtual time 1 is where each source has its target.
    dealt = placed.filter("size > 0").select(
        "size", "_h", "_id", "_all", F.posexplode(F.transform(copies, lambda c: finish(c.cast("long")))).alias("_c", "_v"))
    grid = max(64, buckets)
    step = F.floor(F.least(F.col("_v"), F.lit(float(1 << 20))) * grid).cast("long")
    upto = Window.orderBy("_step").rowsBetween(Window.unboundedPreceding, 0)
    steps = dealt.groupBy(step.alias("_step")).agg(F.sum("size").alias("_words"), F.max("_all").alias("_all"))
    # Steps in coarse groups first, so that no window holds all steps.
    coarse = steps.groupBy(F.floor(F.col("_step") / grid).alias("_g")).agg(F.sum("_words").alias("_gw"), F.max("_all").alias("_all"))
    by_group = Window.orderBy("_g").rowsBetween(Window.unboundedPreceding, 0)
    crossing_group = coarse.withColumn("_upto", F.sum("_gw").over(by_group)).withColumn(
        "_start", F.col("_upto") - F.col("_gw")).filter("_upto > _all and _start <= _all").select("_g", "_start")
    crossing = (
        steps.withColumn("_g", F.floor(F.col("_step") / grid)).join(crossing_group, "_g")
        .withColumn("_upto", F.sum("_words").over(upto) + F.col("_start"))
        .withColumn("_from", F.col("_upto") - F.col("_words"))
        .filter("_upto > _all and _from <= _all").select("_step", "_from", "_all")
    )
    cut = crossing.first()  # one row, or none when everything fits
    if cut is None:
        limit = (float("inf"), "", None)
    else:
        order = Window.orderBy("_v", "_h", "_id", "_c").rowsBetween(Window.unboundedPreceding, 0)
        over = (
            dealt.filter(step == cut["_step"])
            .withColumn("_total", F.sum("size").over(order) + F.lit(cut["_from"]))
            .filter(F.col("_total") > cut["_all"]).orderBy("_v", "_h", "_id", "_c").select("_v", "_h", "_c").first()
        )
        limit = (over["_v"], over["_h"], over["_c"])

    def within(c: Column) -> Column:
        v = finish(c.cast("long"))
        tie = (F.col("_h") < limit[1]) | ((F.col("_h") == limit[1]) & (c < F.lit(limit[2]))) if limit[2] is not None else F.lit(True)
        return (v < F.lit(limit[0])) | ((v == F.lit(limit[0])) & tie)

    taken = F.size(F.filter(copies, within)).cast("long") * F.col("size")
    return placed.select("_doc.*", "size", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"),
                         F.when(F.col("size") > 0, taken).otherwise(F.lit(0)).cast("long").alias("taken"))
