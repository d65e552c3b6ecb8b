"""Ordered work over groups of any size.

A clip, a video or a label may hold a large share of all rows, so nothing here
sorts or collects a whole group in one task. Order-dependent steps run on
``(group, chunk)``, and what crosses a chunk border travels as one summary row
per chunk or as a halo of copied border rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tierloom.session import checkpointed

# Rows per chunk for frame signals: a few hundred kB per chunk of scalars.
FRAME_CHUNK = 4096
# Poses per chunk: a frame is a wide row and takes a hash per landmark.
POSE_CHUNK = 256
# Rows per chunk for array folds; bounds the array a single row can hold.
FOLD_CHUNK = 256


def chunk_of(pos: Column | str, size: int) -> Column:
    pos = F.col(pos) if isinstance(pos, str) else pos
    return F.floor(pos / F.lit(size)).cast("long")


def with_halo(df: DataFrame, keys: Sequence[str], pos: str, size: int, before: Column | int,
              after: Column | int, chunk: str = "chunk", parts: int | None = None) -> DataFrame:
    """Add ``chunk``; rows near a border are also copied into the neighbour chunk.

    Chunk ``c`` receives positions ``[c*size - before, (c+1)*size + after)``. Keep
    only rows with ``is_home`` after the ordered step. The copied share is about
    ``(before + after) / size``. The result is partitioned by (keys, chunk) even where the
    input was partitioned by the keys alone, which would keep a huge group in one task. ``parts`` names
    the number of partitions, where small rows that take much work must not be merged into a few tasks.
    """
    first = F.greatest(chunk_of(F.col(pos) - F.lit(after), size), F.lit(0).cast("long"))
    last = chunk_of(F.col(pos) + F.lit(before), size)
    copies = df.withColumn(chunk, F.explode(F.sequence(first, last)))
    return copies.repartition(parts, *keys, chunk) if parts else copies.repartition(*keys, chunk)


def shuffle_parts(rows: DataFrame) -> int:
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def deal(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str] = ()) -> DataFrame:
    """Rows of equal keys together and in order, over all shuffle partitions.

    The number is named, so that few bytes which take much Python work are not merged into a few tasks.
    """
    return rows.repartition(shuffle_parts(rows), *keys).sortWithinPartitions(*keys, *order)


def is_home(pos: str, size: int, chunk: str = "chunk") -> Column:
    return F.col(chunk) == chunk_of(pos, size)


def join_per_chunk(rows: DataFrame, groups: DataFrame, keys: Sequence[str], last: str,
                   size: int = FRAME_CHUNK, pos: str = "frame") -> DataFrame:
    """Attach one row per group to the rows of that group, by (group, chunk).

    A join on the group alone would bring a huge group to one task, and later steps that
    only need (group, chunk) would keep it there. ``last`` is the last position of a group;
    the group row is copied once per chunk.
    """
    keys = list(keys)
    spread = F.sequence(F.lit(0).cast("long"), chunk_of(last, size))
    copies = groups.withColumn("_c", F.explode(spread)).drop(last)
    return rows.withColumn("_c", chunk_of(pos, size)).join(copies, [*keys, "_c"]).drop("_c")


def rank_in_groups(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column],
                   out: str = "pos", total: str | None = None,
                   attach: DataFrame | None = None) -> DataFrame:
    """``row_number() - 1`` per group without sorting a whole group in one task.

    ``bucket`` must be non-decreasing along ``order``; keys and bucket must not be null.
    Rows are numbered inside
    ``(group, bucket)`` and shifted by the row count of earlier buckets, taken
    from a pre-aggregated table with one row per bucket. The same table can bring the size
    of the group (``total``) and columns of a table with one row per group (``attach``),
    so that a huge group needs no join of its own.
    """
    keys = list(keys)
    tagged = df.withColumn("_bucket", bucket)
    earlier = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(
        "_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        tagged.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_offset", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
    )
    extra = []
    if total is not None:
        offsets = offsets.withColumn(total, F.sum("_rows").over(Window.partitionBy(*keys or [F.lit(0)])))
        extra.append(total)
    if attach is not None:
        offsets = offsets.join(attach, keys)
        extra += [c for c in attach.columns if c not in keys]
    offsets = offsets.drop("_rows")
    # Same keys in the join and in the window: the rows are shuffled once.
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    return (
        tagged.join(offsets, [*keys, "_bucket"])
        .withColumn(out, F.row_number().over(inside).cast("long") - 1 + F.col("_offset"))
        .select(*df.columns, out, *extra)
    )


def chunks_in_groups(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column], size: int = FOLD_CHUNK) -> DataFrame:
    """Chunks (keys, chunk, items) of up to ``size`` rows in order, numbered 0, 1, 2 ... per group.

    ``bucket`` as in ``rank_in_groups``. A chunk does not cross a bucket, so that numbering and chunks need one shuffle
    of the rows. Items hold the other columns behind ``_n``, the place in the bucket.
    """
    keys = list(keys)
    tagged = df.withColumn("_bucket", bucket)
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = tagged.groupBy(*keys, "_bucket").agg(F.ceil(F.count(F.lit(1)) / F.lit(size)).alias("_chunks")).select(
        *keys, "_bucket", F.coalesce(F.sum("_chunks").over(earlier), F.lit(0)).alias("_first"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    numbered = tagged.join(offsets, [*keys, "_bucket"]).withColumn("_n", F.row_number().over(inside))
    others = [c for c in df.columns if c not in keys]
    return (numbered.withColumn("chunk", F.col("_first") + chunk_of(F.col("_n") - 1, size)).groupBy(*keys, "_bucket", "chunk")
            .agg(F.sort_array(F.collect_list(F.struct("_n", *others))).alias("items")).drop("_bucket"))


def rank_by_range(df: DataFrame, order: Sequence[Column], out: str = "pos") -> DataFrame:
    """``row_number() - 1`` over a whole table without sorting it in one task.

    Rows are dealt by ranges of the whole order, so a common prefix or a value that many rows share
    does not fill one task. The ranges are sampled, hence checkpointed: a retry must not deal them anew.
    """
    dealt = checkpointed(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    return rank_in_groups(dealt, [], F.col("_range"), order, out).drop("_range")


def next_rows(df: DataFrame, keys: Sequence[str], pos: str, columns: Sequence[str],
              step: int = 1, prefix: str = "next_") -> DataFrame:
    """Attach ``columns`` of the row ``step`` places later, by an equi join on position."""
    keys = list(keys)
    later = df.select(*keys, (F.col(pos) - step).alias(pos),
                      *[F.col(c).alias(f"{prefix}{c}") for c in columns])
    return df.join(later, [*keys, pos], "left")


def exact_quantile(df: DataFrame, keys: Sequence[str], value: str, q: float, out: str = "quantile",
                   carry: Sequence[str] = (), chunk_rows: int | None = None) -> DataFrame:
    """Exact interpolated quantile of a non-negative column and row count ``n`` per group.

    ``percentile`` keeps every distinct value of a group in one task. Here a
    histogram on the logarithm (partial aggregation, about a thousand steps per
    octave) finds the two steps that hold the wanted ranks, and only the rows of
    those steps are ordered. Where the rows already lie by (keys, ``chunk``) with dense
    positions, ``chunk_rows`` lets the steps go to the rows per chunk instead of
    shuffling the rows. ``carry`` names columns that are constant within a group.
    """
    keys, carry = list(keys), list(carry)
    step = F.when(F.col("_v") > 0, F.floor(F.log2("_v") * 1024)).otherwise(F.lit(-(1 << 40)))
    place = ["chunk"] if chunk_rows else []
    rows = (
        df.filter(F.col(value).isNotNull()).select(*keys, *place, *carry, F.col(value).alias("_v"))
        .withColumn("_step", step.cast("long"))
    )
    kept = [F.max(c).alias(c) for c in carry]
    by_step = Window.partitionBy(*keys).orderBy("_step")
    hist = (
        rows.groupBy(*keys, "_step").agg(F.count(F.lit(1)).alias("_n"), *kept)
        .withColumn("_upto", F.sum("_n").over(by_step.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_total", F.sum("_n").over(Window.partitionBy(*keys)))
        .withColumn("_rank", F.lit(q) * (F.col("_total") - 1))
        .withColumn("_lo", F.floor("_rank")).withColumn("_hi", F.ceil("_rank"))
        .withColumn("_before", F.col("_upto") - F.col("_n"))
        .filter(((F.col("_lo") >= F.col("_before")) & (F.col("_lo") < F.col("_upto")))
                | ((F.col("_hi") >= F.col("_before")) & (F.col("_hi") < F.col("_upto"))))
        .select(*keys, "_step", "_before", "_total", "_rank", "_lo", "_hi")
    )
    if chunk_rows:
        spread = F.sequence(F.lit(0).cast("long"), chunk_of(F.col("_total") - 1, chunk_rows))
        wanted = hist.withColumn("chunk", F.explode(spread)).withColumnRenamed("_step", "_wanted")
        # A difference, not an equality: the step must not become a join key, which would shuffle.
        joined = rows.join(wanted, [*keys, "chunk"]).filter(F.col("_step") - F.col("_wanted") == 0)
    else:
        joined = rows.join(hist, [*keys, "_step"])
    near = joined.groupBy(*keys, "_step", "_before", "_total", "_rank", "_lo", "_hi", "_v").agg(
        F.count(F.lit(1)).alias("_m"), *kept)
    inside = Window.partitionBy(*keys, "_step").orderBy("_v")
    placed = (
        near.withColumn("_end", F.col("_before") + F.sum("_m").over(
            inside.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_start", F.col("_end") - F.col("_m"))
    )

    def at(rank: str) -> Column:
        hit = (F.col(rank) >= F.col("_start")) & (F.col(rank) < F.col("_end"))
        return F.max(F.when(hit, F.col("_v")))

    return (
        placed.groupBy(*keys, "_total", "_lo").agg(
            at("_lo").alias("_a"), at("_hi").alias("_b"), F.max("_rank").alias("_rank"), *kept)
        .select(*keys, (F.col("_a") + (F.col("_b") - F.col("_a"))
                        * (F.col("_rank") - F.col("_lo"))).alias(out), F.col("_total").alias("n"), *carry)
    )


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in several places of an expression."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
