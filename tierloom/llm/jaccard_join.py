"""Jaccard similarity join on word shingles by chosen paths.

Sets are embedded as minhash tokens (position, value), whose share of equal tokens estimates the Jaccard
similarity. A run sends each set to the children of a node for the tokens the node chooses, each with chance
``1 / (threshold * tokens)``, so that a pair at the threshold shares one child in expectation. Sets that share
a node are split again while the node is large and not a group of near copies around a pivot; small nodes
are searched by brute force. Runs are repeated, round by round, until a round finds hardly a pair that was not
connected before. Pairs of candidates
are then verified on their whole shingle sets, in blocks, which also counts every link.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierloom.llm.common import PrefixHash, joined, mixed, parts, slices, stored, utf8, word_bounds
from tierloom.llm.graph import components

TOKENS = 64
SHINGLE = 5
MULTIPLIERS = mixed(np.arange(1, TOKENS + 1, dtype=np.uint64) + np.uint64(1 << 40)) | np.uint64(1)
STEP = np.uint64(0x9E3779B97F4A7C15)
#: Sets that a node may hold for brute force (1 MB of sketches); larger nodes are settled by a pivot or split.
SMALL = 4096
#: Splits of a path at most; a node that is still large is then searched in pairs of blocks.
DEPTH = 4
#: Runs of a round, and rounds after which a search that has not reached its recall is an error.
RUNS, ROUNDS = 8, 16
#: Members of a block when candidates are verified, and shingles of a block.
BLOCK, BLOCK_SHINGLES = 2048, 1_000_000
#: Parts of a large node that tasks work off apart.
SALTS = 16


def shingles(texts: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, one after the other, and the offset of each text.

    Words are runs of non-space bytes, A-Z lower-cased. A text with fewer words than a shingle has one
    shingle of all its words, a text without words has none.
    """
    data, offsets = joined([t.lower() for t in texts])
    start, end = word_bounds(data)
    word = PrefixHash(data)(start, end)
    first = np.searchsorted(start, offsets)
    count = np.diff(first)
    doc = np.repeat(np.arange(len(texts)), count)
    left = np.repeat(first[1:], count) - np.arange(len(word))
    whole = left >= size
    at = np.flatnonzero(whole)
    code = word[at].copy()
    for k in range(1, size):
        code = code * STEP + word[at + k]
    owner = doc[at]
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        extra = np.zeros(len(short), dtype=np.uint64)
        for k in range(size - 1):
            has = count[short] > k
            extra[has] = extra[has] * STEP + word[first[short[has]] + k]
        code, owner = np.concatenate((code, extra + np.uint64(1))), np.concatenate((owner, short))
    code = mixed(code)
    order = np.lexsort((code, owner))
    code, owner = code[order], owner[order]
    fresh = np.ones(len(code), dtype=bool)
    fresh[1:] = (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])
    code, owner = code[fresh], owner[fresh]
    return code, np.searchsorted(owner, np.arange(len(texts) + 1))


def minhashes(code: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of TOKENS 32-bit values per text; rows of empty sets are zero."""
    n = len(offsets) - 1
    out = np.zeros((n, TOKENS), dtype=np.uint32)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        begin = offsets[:-1][full]
        for k in range(TOKENS):
            out[full, k] = np.minimum.reduceat((code * MULTIPLIERS[k] >> np.uint64(32)).astype(np.uint32), begin)
    return out


def set_hashes(code: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each whole set."""
    sums = np.concatenate(([np.uint64(0)], np.cumsum(mixed(code ^ STEP))))
    return mixed(sums[offsets[1:]] - sums[offsets[:-1]] + np.diff(offsets).astype(np.uint64) * STEP).view(np.int64)


def sketched(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``id``, ``key`` (of the text), ``n`` shingles, ``class`` (hash of the set) and ``sketch``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            code, offsets = shingles(utf8(batch.column("_text")))
            sketch = minhashes(code, offsets)
            n = np.diff(offsets)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("key"), pa.array(n, pa.int64()), pa.array(set_hashes(code, offsets), mask=n == 0),
                 pa.array([s.tobytes() for s in sketch], pa.binary())],
                names=["id", "key", "n", "class", "sketch"])

    kind = docs.schema[doc_id].dataType.simpleString()
    given = docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("key"), F.col(text).alias("_text"))
    return given.mapInArrow(run, f"id {kind}, key long, n long, class long, sketch binary")


def chosen(node: np.ndarray, sketch: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and child nodes: the tokens of each set that its node chooses."""
    position = np.arange(TOKENS, dtype=np.uint64) << np.uint64(32)
    child = mixed(mixed(sketch.astype(np.uint64) + position[None, :]) + node[:, None] * STEP)
    limit = np.uint64(min(1.0, 1 / (threshold * TOKENS)) * ((1 << 64) - 1024))
    # The choice and the name of the child come from two hashes.
    row, column = np.nonzero(mixed(child + STEP) < limit)
    return row, child[row, column]


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint32).reshape(-1, TOKENS)


def _paths(rows: DataFrame, threshold: float, roots: Sequence[int] | None) -> DataFrame:
    """Children of each row's node (of the given root nodes at the start): ``node``, ``class``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sketch, own = _matrix(batch.column("sketch")), batch.column("class").to_numpy()
            if roots is None:
                tops = [batch.column("node").to_numpy().view(np.uint64)]
            else:
                tops = [np.full(len(own), r, dtype=np.uint64) for r in roots]
            found = [chosen(t, sketch, threshold) for t in tops]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([c for _, c in found]).view(np.int64)), pa.array(np.concatenate([own[r] for r, _ in found]))],
                names=["node", "class"])

    return rows.mapInArrow(run, "node long, class long")


def forest(alike, n: int) -> list[tuple[int, int]]:
    """Spanning edges of the groups of n members; ``alike(i, others)`` marks those linked to i."""
    waiting, edges = np.arange(n), []
    while len(waiting):
        queue, waiting = [int(waiting[0])], waiting[1:]
        while queue and len(waiting):
            i = queue.pop()
            hit = alike(i, waiting)
            near, waiting = waiting[hit], waiting[~hit]
            edges += [(i, int(j)) for j in near]
            queue += near.tolist()
    return edges


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys from sorted batches."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        codes = [rows.column(k).to_numpy() for k in keys]
        cut = np.ones(len(rows), dtype=bool)
        cut[1:] = np.any([c[1:] != c[:-1] for c in codes], axis=0)
        edges = [*np.flatnonzero(cut).tolist(), len(rows)]
        for a, b in zip(edges[:-1], edges[1:]):
            key = tuple(c[a] for c in codes)
            if last is not None and key != last:
                yield pa.concat_tables(held)
                held = []
            held.append(rows.slice(a, b - a))
            last = key
    if held:
        yield pa.concat_tables(held)


def _by_brute_force(buckets: DataFrame, least: float) -> DataFrame:
    """Spanning edges (a, b) of the sets in each bucket whose sketches agree in a share of ``least``.

    ``node``, ``i``, ``j``: a bucket, or a pair of blocks of it; ``half`` tells the block of a row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for group in _groups(batches, ["node", "i", "j"]):
            if len(group) < 2:
                continue
            sketch, own = _matrix(group.column("sketch").combine_chunks()), group.column("class").to_numpy()
            near = lambda i, others: (sketch[others] == sketch[i]).mean(1) >= least
            for x, y in forest(near, len(own)):
                a.append(min(own[x], own[y]))
                b.append(max(own[x], own[y]))
            if len(a) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    dealt = buckets.repartition(parts(buckets), "node", "i", "j").sortWithinPartitions("node", "i", "j")
    return dealt.mapInArrow(run, "a long, b long")


def _blocks(rows: DataFrame, member: str, blocks: Column) -> DataFrame:
    """Add ``i``, ``j`` so that every pair of members of a key meets in a pair of the key's ``blocks``."""
    n = F.greatest(blocks, F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64(member), n).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(F.least(k, own).alias("i"), F.greatest(k, own).alias("j")))
    return rows.withColumn("half", own).select("*", F.inline(pairs))


def _per_node(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Attach one row per node to the sets of that node, which are dealt to parts so that a large node is not one task."""
    copies = nodes.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_part", F.pmod(F.xxhash64("class"), F.lit(SALTS)).cast("int")).join(copies, ["node", "_part"]).drop("_part")


def _near_pivots(rows: DataFrame, least: float) -> DataFrame:
    """``near``: whether a row's sketch agrees with ``pivot_sketch`` in a share of ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                share = (_matrix(batch.column("sketch")) == _matrix(batch.column("pivot_sketch"))).mean(1)
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("node", "class", "pivot", "size", "sketch")] + [pa.array(share >= least)],
                                                 names=["node", "class", "pivot", "size", "sketch", "near"])

    return rows.mapInArrow(run, "node long, class long, pivot long, size long, sketch binary, near boolean")


def _rest_with_all(rows: DataFrame, least: float) -> DataFrame:
    """Edges of the sets of a node that are not near its pivot, with all sets of the node.

    Sets near the pivot are linked to it already, so one link into them is enough for each of the rest. The near
    sets lie in blocks, the rest (few) is copied into every block.
    """
    blocks = F.ceil(F.col("size") / F.lit(BLOCK)).cast("int")
    own = F.pmod(F.xxhash64("class"), blocks).cast("int")
    dealt = rows.withColumn("block", F.explode(F.when(F.col("near"), F.array(own)).otherwise(F.sequence(F.lit(0), blocks - 1))))
    dealt = dealt.select("node", "block", "class", "sketch", "near").repartition(parts(rows), "node", "block").sortWithinPartitions("node", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ["node", "block"]):
            sketch, own = _matrix(group.column("sketch").combine_chunks()), group.column("class").to_numpy()
            near = group.column("near").to_numpy()
            close, far = np.flatnonzero(near), np.flatnonzero(~near)
            edges = [(far[x], far[y]) for x, y in forest(lambda i, others: (sketch[far[others]] == sketch[far[i]]).mean(1) >= least, len(far))]
            for r in far:
                hit = np.flatnonzero((sketch[close] == sketch[r]).mean(1) >= least)
                edges += [(r, close[hit[0]])] if len(hit) else []
            pairs = np.array([(own[x], own[y]) for x, y in edges], dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs.min(1)), pa.array(pairs.max(1))], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def candidate_edges(reps: DataFrame, threshold: float, least: float, first_run: int, runs: int = RUNS,
                    small: int = SMALL, depth: int = DEPTH) -> DataFrame:
    """Edges (a, b) between classes that one round of runs finds; they connect all pairs that meet in a node.

    A large node is first held against a pivot, its class of smallest hash: sets near the pivot are connected
    through it, and where few are left over, these are compared with all and the node is done. That
    settles groups of near copies, which no token parts, with rows in proportion to their members. Other
    large nodes are split.
    """
    nodes = _paths(reps, threshold, list(range(first_run + 1, first_run + runs + 1)))
    found = []
    for level in range(depth + 1):
        nodes = stored(nodes, "nodes")
        counted = nodes.groupBy("node").agg(
            F.count(F.lit(1)).alias("size"), F.min_by("class", F.xxhash64("node", "class")).alias("pivot")).filter("size > 1")
        shared = stored(nodes.join(counted, "node").join(reps.select("class", "sketch"), "class"), "shared")
        found.append(_by_brute_force(_blocks(shared.filter(F.col("size") <= small).drop("pivot"), "class", F.lit(1)), least))
        large = shared.filter(F.col("size") > small)
        if not large.limit(1).count():
            break
        pivots = large.filter("class = pivot").select("node", F.col("sketch").alias("pivot_sketch")).dropDuplicates(["node"])
        judged = stored(_near_pivots(_per_node(large, pivots), least), "judged")
        found.append(judged.filter("near and class <> pivot").select(
            F.least("class", "pivot").alias("a"), F.greatest("class", "pivot").alias("b")))
        rest = judged.groupBy("node").agg(F.count_if(~F.col("near")).alias("far"))
        found.append(_rest_with_all(_per_node(judged, rest.filter(F.col("far").between(1, small)).select("node")), least))
        open_ = _per_node(judged, rest.filter(F.col("far") > small).select("node"))
        if level == depth:
            found.append(_by_brute_force(_blocks(open_.drop("pivot", "near"), "class", F.ceil(F.col("size") / F.lit(small))), least))
            break
        nodes = _paths(open_, threshold, None)
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out.distinct()


def _relabelled(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges between components not connected before, one row (a, b) for each pair of components, with ``n``, the edges it stands for.

    A class without a label is a component of its own.
    """
    left = labels.select(F.col("v").alias("a"), F.col("label").alias("_a"))
    right = labels.select(F.col("v").alias("b"), F.col("label").alias("_b"))
    ends = edges.join(left, "a", "left").join(right, "b", "left").select(F.coalesce("_a", "a").alias("x"), F.coalesce("_b", "b").alias("y"))
    return ends.filter("x <> y").groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.count(F.lit(1)).alias("n"))


def _merged(labels: DataFrame, joined_labels: DataFrame) -> DataFrame:
    """Labels after components were joined; ``joined_labels`` tells the new label of a component by its old one."""
    moved = joined_labels.select(F.col("v").alias("_old"), F.col("label").alias("_new"))
    kept = labels.join(moved, F.col("label") == F.col("_old"), "left").select("v", F.coalesce("_new", "label").alias("label"))
    # Classes that had no edge before have no label yet.
    return stored(kept.unionByName(joined_labels.join(labels.select("v"), "v", "left_anti")), "labels")


def connected(reps: DataFrame, threshold: float, recall: float, runs: int = RUNS, rounds: int = ROUNDS,
              small: int = SMALL) -> DataFrame:
    """Candidate components: ``v`` (class) and ``label``, after as many rounds as the recall asks for.

    A round is an independent search. The share of its edges that earlier rounds had connected
    already estimates the recall of those; when it reaches ``recall`` no further round is needed. Only edges between
    components that were apart go on, as one edge per pair of components, so the links of a large group are followed once. A search that
    does not get there in ``rounds`` is an error.
    """
    least = max(0.0, threshold - 3 * math.sqrt(threshold * (1 - threshold) / TOKENS))
    labels = None
    for k in range(rounds):
        fresh = stored(candidate_edges(reps, threshold, least, k * runs, runs, small), "round")
        if labels is None:
            labels = components(fresh)
            continue
        joining = stored(_relabelled(fresh, labels), "joining")
        n, unknown = fresh.count(), joining.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        if unknown:
            labels = _merged(labels, components(joining))
        if n - unknown >= recall * n:
            return labels
    raise RuntimeError(f"recall {recall} not reached in {rounds} rounds")


def _verified(members: DataFrame, threshold: float) -> DataFrame:
    """Exact comparison inside blocks: rows (class, links, other); ``links`` counts, ``other`` is a spanning edge or null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ["label", "i", "j"]):
            own = group.column("class").to_numpy()
            half, i, j = group.column("half").to_numpy(), group.column("i")[0].as_py(), group.column("j")[0].as_py()
            sets = group.column("codes").combine_chunks()
            offsets = sets.offsets.to_numpy()
            code = sets.values.to_numpy()[offsets[0]:offsets[-1]]
            n = np.diff(offsets)
            owner = np.repeat(np.arange(len(own)), n)
            order = np.argsort(code, kind="stable")
            ranked = code[order]
            rank = np.concatenate(([0], np.cumsum(ranked[1:] != ranked[:-1]))) if len(ranked) else np.empty(0, dtype=np.int64)
            # A shingle of a single member is in no intersection.
            often = np.bincount(rank, minlength=1) > 1
            kept = often[rank]
            rank, holder = (np.cumsum(often) - 1)[rank[kept]], owner[order[kept]]
            both = np.zeros((len(own), len(own)), dtype=np.float32)
            for low in range(0, int(rank[-1]) + 1 if len(rank) else 0, 4096):
                a, b = np.searchsorted(rank, [low, low + 4096])
                hot = np.zeros((len(own), int(rank[b - 1]) - low + 1), dtype=np.float32)
                hot[holder[a:b], rank[a:b] - low] = 1
                both += hot @ hot.T
            alike = np.empty(both.shape, dtype=bool)
            for x in range(len(own)):
                alike[x] = both[x] >= threshold * (n[x] + n - both[x].astype(np.float64)) - 1e-9
            np.fill_diagonal(alike, False)
            if i != j:
                alike &= half[:, None] != half[None, :]
            links = alike.sum(1)
            edges = forest(lambda x, others: alike[x, others], len(own))
            a = np.array([x for x, _ in edges], dtype=np.int64)
            b = np.array([y for _, y in edges], dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate((own, own[a]))), pa.array(np.concatenate((links, np.zeros(len(a), dtype=np.int64)))),
                 pa.array(np.concatenate((np.zeros(len(own), dtype=np.int64), own[b])), mask=np.arange(len(own) + len(a)) < len(own))],
                names=["class", "links", "other"])

    dealt = members.repartition(parts(members), "label", "i", "j").sortWithinPartitions("label", "i", "j")
    return dealt.mapInArrow(run, "class long, links long, other long")


def _sets(members: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            code, offsets = shingles(utf8(batch.column("_text")))
            codes = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(code.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("class"), batch.column("label"), batch.column("blocks"), codes],
                                             names=["class", "label", "blocks", "codes"])

    return members.mapInArrow(run, "class long, label long, blocks int, codes array<long>")


def similar(docs: DataFrame, threshold: float = 0.8, recall: float = 0.99, doc_id: str = "doc_id", text: str = "text",
            runs: int = RUNS, rounds: int = ROUNDS, small: int = SMALL, block: int = BLOCK) -> DataFrame:
    """One row per document: ``id``, ``key``, ``n_shingles``, ``class_id``, ``n_links``, ``group_id``.

    ``class_id`` is the smallest id with the same shingle set, ``n_links`` the number of other classes of
    Jaccard similarity ``threshold`` or more, and ``group_id`` the smallest id reached over such links.
    Null texts and texts without words have no shingles, are alike to nothing and are their own class. A class
    whose ids are all null has a null class id. Repeated rows share a class; an empty table stays empty.
    """
    base = stored(sketched(docs, doc_id, text), "sketches")
    full = base.filter("n > 0")
    reps = stored(full.groupBy("class").agg(F.min("id").alias("class_id"), F.min_by(F.struct("key", "sketch", "n"), "key").alias("_one")).select(
        "class", "class_id", "_one.key", "_one.sketch", "_one.n"), "classes")
    labels = connected(reps, threshold, recall, runs, rounds, small)
    placed = labels.withColumnRenamed("v", "class").join(reps.select("class", "key", "n"), "class")
    need = F.ceil(F.greatest(F.count(F.lit(1)) / F.lit(block), F.sum("n") / F.lit(BLOCK_SHINGLES)))
    wanted = placed.join(placed.groupBy("label").agg(need.cast("int").alias("blocks")), "label").drop("n")
    texts = docs.select(F.xxhash64(text).alias("key"), F.col(text).alias("_text"))
    # One text per class; copies of it fall away after the join.
    members = texts.join(wanted, "key").groupBy("class", "label", "blocks").agg(F.min("_text").alias("_text"))
    verified = stored(_verified(_blocks(_sets(members), "class", F.col("blocks")), threshold), "verified")
    groups = components(verified.filter("other is not null").select(F.col("class").alias("a"), F.col("other").alias("b")))
    least = groups.join(reps.select(F.col("class").alias("v"), "class_id"), "v").groupBy("label").agg(F.min("class_id").alias("group_id"))
    grouped = groups.join(least, "label").select(F.col("v").alias("class"), "group_id")
    links = verified.groupBy("class").agg(F.sum("links").alias("n_links"))
    per_class = reps.select("class", "class_id").join(links, "class", "left").join(grouped, "class", "left")
    return base.drop("sketch").join(per_class, "class", "left").select(
        "id", "key", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.when(F.col("n") > 0, F.coalesce("group_id", "class_id")).otherwise(F.col("id")).alias("group_id"))


def first_of_each(docs: DataFrame, threshold: float = 0.8, recall: float = 0.99, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with the smallest id of each group of near duplicates, all columns unchanged.

    Documents without words stay. Of repeated rows with one id and text, one stays. Rows with a null id
    are kept only where no row of the group has an id.
    """
    found = stored(similar(docs, threshold, recall, doc_id, text), "similar").filter("n_shingles > 0")
    best = found.groupBy("group_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("first"))
    gone = (
        found.join(best, "group_id")
        .filter(~(F.col("id").eqNullSafe(F.col("first.id")) & (F.col("key") == F.col("first.key"))))
        .select(F.col("id").alias("_gone"), F.col("key").alias("_key")).distinct()
    )
    rows = docs.withColumn("_own", F.xxhash64(text))
    kept = rows.join(gone, (F.col("_own") == F.col("_key")) & F.col(doc_id).eqNullSafe(F.col("_gone")), "left_anti")
    if found.groupBy("id", "key").count().filter("count > 1").limit(1).count():
        plain = kept.filter(F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]")), F.lit(0)) == 0)
        kept = kept.filter(F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]")), F.lit(0)) > 0).dropDuplicates([doc_id, "_own"]).union(plain)
    return kept.select(docs.columns)
