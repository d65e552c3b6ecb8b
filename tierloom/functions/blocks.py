"""Blocks of ordered rows whose borders depend on what came before, in groups of any length.

``orbit`` follows pointers from the start of every group by doubling them. ``block_heads`` runs a small
state machine over chunks of a group and uses an orbit over chunk exits, so passes over the rows do not
grow with the number of chunks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tierloom.functions.chunks import FOLD_CHUNK, chunk_of, chunks_in_groups
from tierloom.session import checkpointed

#: Chunks whose marks are summed up in one row before they meet the other chunks of a group.
COARSE = 4096


def some(df: DataFrame) -> bool:
    return df.limit(1).count() > 0


def orbit(pointers: DataFrame, starts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All nodes that pointers (keys, node, to) reach from starts (keys, node), the starts included.

    Pointers must not run in circles. After k rounds the nodes up to 2**k - 1 steps away are known and every
    pointer spans 2**k steps, so rounds grow with the logarithm of the longest path. Pointers that would
    pass the end are dropped on the way.
    """
    keys = list(keys)
    reached, jumps = starts.select(*keys, "node"), pointers.select(*keys, "node", "to")
    while True:
        ahead = reached.join(jumps, [*keys, "node"]).select(*keys, F.col("to").alias("node"))
        reached = checkpointed(reached.unionByName(ahead))
        second = jumps.select(*keys, F.col("node").alias("to"), F.col("to").alias("_far"))
        jumps = checkpointed(jumps.join(second, [*keys, "to"]).select(*keys, "node", F.col("_far").alias("to")))
        if not some(jumps):
            return reached


def by_range(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Deal rows by ranges of a whole order, with the number of the range as ``_range``.

    Neither a long group nor a crowded stretch of values ends in one task. Ranges are sampled, hence
    checkpointed: a retry must not deal the rows anew.
    """
    return checkpointed(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))


def next_after(items: DataFrame, probes: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """For every probe the smallest item value of its group above its own value, null if there is none."""
    keys = list(keys)
    both = items.select(*keys, value, F.col(value).alias("_item")).unionByName(
        probes.withColumn("_item", F.lit(None).cast(items.schema[value].dataType)), allowMissingColumns=True)
    # An item comes before the probes of the same value, so that what follows a probe is larger.
    order = [F.col(value), F.col("_item").isNull()]
    dealt = by_range(both, [*[F.col(k) for k in keys], *order])
    later = Window.partitionBy(*keys).orderBy("_range").rowsBetween(1, Window.unboundedFollowing)
    ahead = dealt.groupBy(*keys, "_range").agg(F.min("_item").alias("_least")).select(
        *keys, "_range", F.min("_least").over(later).alias("_ahead"))
    inside = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    found = dealt.withColumn("_near", F.min("_item").over(inside)).filter("_item is null").join(ahead, [*keys, "_range"])
    return found.withColumn(out, F.coalesce("_near", "_ahead")).select(*probes.columns, out)


def last_before(chunks: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Largest value of each column in earlier chunks of the group (null if none): keys, chunk and the columns."""
    keys, columns = list(keys), list(columns)
    rows = chunks.withColumn("_coarse", F.floor(F.col("chunk") / COARSE))
    over = Window.partitionBy(*keys).orderBy("_coarse").rowsBetween(Window.unboundedPreceding, -1)
    coarse = rows.groupBy(*keys, "_coarse").agg(*[F.max(c).alias(c) for c in columns])
    coarse = coarse.select(*keys, "_coarse", *[F.max(c).over(over).alias(f"_far_{c}") for c in columns])
    inside = Window.partitionBy(*keys, "_coarse").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(coarse, [*keys, "_coarse"]).select(
        *keys, "chunk", *[F.coalesce(F.max(c).over(inside), F.col(f"_far_{c}")).alias(c) for c in columns])


def _entries(chunks: DataFrame, keys: list[str], fold: Callable[[DataFrame, Column], DataFrame]) -> DataFrame:
    """The state in which each chunk but the first of a group is entered: keys, chunk, entry.

    A chunk is followed from every state in which the chunk before may be left: first from the one that a
    fresh start gives, then from those that turn up on the way. States that agree are followed once; as soon as
    a chunk leads all its entries to known exits it is not run again. Where exits differ, the true ones are the
    orbit of the first chunk's exit.
    """
    exits = chunks.select(*keys, "chunk", F.col("_acc.state").alias("state"))
    known, fresh, pointers = exits, exits, None
    # Only these are entered from another chunk; groups of one chunk need not move.
    later = chunks.filter("chunk > 0").drop("_acc")
    while True:
        entry = fresh.select(*keys, (F.col("chunk") + 1).alias("chunk"), F.col("state").alias("entry"))
        run = checkpointed(fold(later.join(entry, [*keys, "chunk"]), F.col("entry")).select(
            *keys, "chunk", "entry", F.col("_acc.state").alias("state")))
        pointers = run if pointers is None else pointers.unionByName(run)
        fresh = checkpointed(run.select(*keys, "chunk", "state").distinct().join(known, [*keys, "chunk", "state"], "left_anti"))
        if not some(fresh):
            break
        known = known.unionByName(fresh)
    if some(known.groupBy(*keys, "chunk").count().filter("count > 1")):
        def node(chunk: Column, state: str) -> Column:
            return F.struct(chunk.alias("chunk"), F.col(state).alias("state"))

        steps = pointers.select(*keys, node(F.col("chunk") - 1, "entry").alias("node"), node(F.col("chunk"), "state").alias("to"))
        begun = exits.filter("chunk = 0").select(*keys, node(F.col("chunk"), "state").alias("node"))
        known = orbit(steps, begun, keys).select(*keys, "node.*")
    return known.select(*keys, (F.col("chunk") + 1).alias("chunk"), F.col("state").alias("entry"))


def _marked(chunks: DataFrame, keys: list[str], state_type: str, step: Callable[[Column, Column], Column]) -> DataFrame:
    """Chunks (keys, chunk, items) with the mark of each item as ``_acc.marks``; chunks of a group are numbered 0, 1, 2 ..."""
    acc_type = f"struct<state:{state_type},marks:array<int>>"

    def fold(source: DataFrame, entry: Column) -> DataFrame:
        zero = F.struct(entry.cast(state_type).alias("state"), F.array().cast("array<int>").alias("marks"))

        def merge(acc: Column, row: Column) -> Column:
            return F.get(F.transform(F.array(step(acc["state"], row)), lambda s: F.struct(
                s["state"].alias("state"), F.concat(acc["marks"], F.array(s["mark"])).alias("marks")).cast(acc_type)), F.lit(0))

        return source.withColumn("_acc", F.aggregate("items", zero, merge))

    marked = checkpointed(fold(chunks, F.lit(None)))
    later = marked.filter("chunk > 0")
    if not some(later):
        return marked
    entries = _entries(marked, keys, fold)
    again = checkpointed(fold(later.drop("_acc").join(entries, [*keys, "chunk"], "left"), F.col("entry")).drop("entry"))
    return marked.filter("chunk = 0").unionByName(again)


def block_starts(df: DataFrame, keys: Sequence[str], bucket: Column, pos: str, state_type: str, step: Callable[[Column, Column], Column],
                 chunk_rows: int = FOLD_CHUNK) -> DataFrame:
    """Rows that start a block, with the position of the next start in the group as ``_next`` (null after the last).

    ``step`` is that of ``block_heads``. Positions order the rows of a group and need not be dense; ``bucket`` must not
    fall along them. Rows are shuffled once; afterwards only the last start of a chunk meets other chunks.
    """
    keys = list(keys)
    chunks = chunks_in_groups(df, keys, bucket, [F.col(pos)], chunk_rows)
    found = F.filter(F.arrays_zip("items", F.col("_acc.marks").alias("marks")), lambda z: z["marks"] >= 1)["items"]
    starts = _marked(chunks, keys, state_type, step).select(*keys, "chunk", found.alias("_starts")).filter(F.size("_starts") > 0)
    following = F.slice(F.col("_starts")[pos], F.lit(2), F.size("_starts"))
    rows = starts.select(*keys, "chunk", F.explode(F.arrays_zip("_starts", following.alias("_next"))).alias("z")).select(
        *keys, "chunk", *[F.col(f"z._starts.{c}").alias(c) for c in df.columns if c not in keys], "z._next")
    ahead = starts.select(*keys, "chunk", F.lead(F.get("_starts", F.lit(0))[pos]).over(Window.partitionBy(*keys).orderBy("chunk")).alias("_ahead"))
    last = rows.filter("_next is null").join(ahead, [*keys, "chunk"]).withColumn("_next", F.col("_ahead"))
    columns = [*df.columns, "_next"]
    return rows.filter("_next is not null").select(*columns).unionByName(last.select(*columns))


def block_heads(df: DataFrame, keys: Sequence[str], pos: str, state_type: str, step: Callable[[Column, Column], Column],
                levels: Sequence[str] = ("head",), chunk_rows: int = FOLD_CHUNK) -> DataFrame:
    """Add the position of the first row of each row's block, for groups numbered 0, 1, 2 ... by ``pos``.

    ``step(state, row)`` gives a struct of the new state and a mark: 0 if the row goes on with the block, 1 if it
    starts one, 2 if it starts one of the second level as well, and so on. The state of the first row is null.
    ``levels`` names one column per level; rows before the first start have null. The state should hold only
    what later decisions depend on: the fewer states a chunk can be left in, the fewer passes.
    """
    keys = list(keys)
    others = [c for c in df.columns if c not in (*keys, pos)]
    chunks = (df.withColumn("chunk", chunk_of(pos, chunk_rows)).groupBy(*keys, "chunk")
              .agg(F.sort_array(F.collect_list(F.struct(pos, *others))).alias("items")))
    marked = _marked(chunks, keys, state_type, step)

    def last(level: int) -> Column:
        return F.array_max(F.transform(F.arrays_zip("items", "_acc.marks"), lambda z: F.when(z["marks"] >= level, z["items"][pos])))

    lasts = marked.select(*keys, "chunk", *[last(i + 1).alias(c) for i, c in enumerate(levels)])
    before = last_before(lasts, keys, levels).withColumnsRenamed({c: f"_{c}" for c in levels})
    rows = marked.join(before, [*keys, "chunk"]).select(
        *keys, "chunk", *[f"_{c}" for c in levels], F.explode(F.arrays_zip("items", F.col("_acc.marks").alias("marks"))).alias("z"))
    upto = Window.partitionBy(*keys, "chunk").orderBy(f"z.items.{pos}").rowsBetween(Window.unboundedPreceding, 0)
    heads = [F.coalesce(F.max(F.when(F.col("z.marks") >= i + 1, F.col(f"z.items.{pos}"))).over(upto), F.col(f"_{c}")).alias(c)
             for i, c in enumerate(levels)]
    return rows.select(*keys, *[F.col(f"z.items.{c}").alias(c) for c in (pos, *others)], *heads)
