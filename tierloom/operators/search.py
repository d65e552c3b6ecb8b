"""Vectors: index, similarity search, nearest centroids, clusters and projections."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType
from pyspark.sql.window import Window

from tierloom.functions.text import blank

# Vectors per block row, and the largest total that is sent to every task.
BLOCK_ROWS = 256
SEND_BYTES = 64 << 20
SPREAD = 64


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def unit_length(vector: Column | str, floor: float = 1e-8) -> Column:
    vector = F.col(vector) if isinstance(vector, str) else vector
    norm = F.greatest(F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))), F.lit(floor))
    return F.transform(vector, lambda v: v.cast("double") / norm)


def build_index(rows: DataFrame, identity: str = "id", label: str = "label", vector: str = "vector") -> DataFrame:
    """Index rows with a label: id, label, vector of unit length."""
    return rows.filter(~blank(F.col(label).cast("string"))).select(identity, label, unit_length(vector).alias(vector))


def centroids(rows: DataFrame, label: str = "label", vector: str = "vector") -> DataFrame:
    """Mean vector per label (partial vector sums, no collection of members)."""
    as_double = F.transform(vector, lambda v: v.cast("double"))
    mean = rows.groupBy(label).agg(Summarizer.mean(array_to_vector(as_double)).alias("_m"))
    return mean.select(label, vector_to_array("_m").alias("centroid"))


def with_blocks(rows: DataFrame, probes: DataFrame, key: str, vector: str) -> tuple[DataFrame, int]:
    """Attach the probe vectors in blocks: column ``block``, an array of (key, vector).

    Also returns the number of blocks, which is how often each row appears.

    Probes (queries or class centres) are packed into rows of at most BLOCK_ROWS. If all
    of them together stay below SEND_BYTES (counted first), they go to every task.
    Beyond that the rows are spread over ``SPREAD`` copies of each block by a shuffle join.
    """
    sized = probes.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vector)).alias("w")).first()
    n, width = sized["n"], sized["w"] or 0
    n_blocks = max(1, -(-n // BLOCK_ROWS))
    slot = F.pmod(F.xxhash64(key), F.lit(n_blocks)).cast("int")
    blocks = probes.groupBy(slot.alias("_slot")).agg(F.sort_array(F.collect_list(F.struct(key, vector))).alias("block"))
    every = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))
    if n * width * 8 <= SEND_BYTES:
        return rows.withColumn("_slot", every).join(F.broadcast(blocks), "_slot").drop("_slot"), n_blocks
    salted = blocks.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    salt = F.pmod(F.xxhash64(*rows.columns[:1]), F.lit(SPREAD)).cast("int")
    return rows.withColumn("_slot", every).withColumn("_salt", salt).join(
        salted, ["_slot", "_salt"]).drop("_slot", "_salt"), n_blocks


def _scored(index: DataFrame, sent: DataFrame) -> DataFrame:
    """Best row per query and label of every Arrow batch, from one matrix product; ``sent`` goes to every task."""
    rows = sent.collect()  # callers have counted them
    names, matrix = [r["query_id"] for r in rows], np.array([r["query"] for r in rows], dtype=np.float64)
    carried = index.sparkSession.sparkContext.broadcast(matrix)
    schema = StructType([StructField("_q", IntegerType()), index.schema["label"], index.schema["id"], StructField("similarity", DoubleType())])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch]).filter(pa.compute.is_valid(batch.column("label")))
            if not len(table):
                continue
            table = table.sort_by([("label", "ascending"), ("id", "ascending")])
            vectors = table.column("vector").combine_chunks()
            product = carried.value @ vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(table), -1).T
            # What differs in the last bits only is a tie.
            product = np.round(product, 12)
            labels = table.column("label").combine_chunks()
            starts = np.concatenate(([0], np.flatnonzero(pa.compute.not_equal(labels[1:], labels[:-1]).to_numpy(zero_copy_only=False)) + 1))
            top = np.maximum.reduceat(product, starts, axis=1)
            segment = np.repeat(np.arange(len(starts)), np.diff([*starts, len(table)]))
            # The first row of a label that reaches its maximum has the smallest id.
            place = np.where(product >= top[:, segment], np.arange(len(table)), len(table))
            at = np.minimum.reduceat(place, starts, axis=1)
            take = pa.array(at.ravel())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.arange(len(product)), len(starts)), pa.int32()), labels.take(take),
                 table.column("id").combine_chunks().take(take), pa.array(top.ravel())], names=["_q", "label", "id", "similarity"])

    found = index.select("id", "label", "vector").mapInArrow(best, schema)
    keys = index.sparkSession.createDataFrame(
        [(i, n) for i, n in enumerate(names)], StructType([StructField("_q", IntegerType()), StructField("query_id", sent.schema["query_id"].dataType)]))
    # As many rows as queries, which were counted.
    return found.join(F.broadcast(keys), "_q").select("query_id", "id", "label", "similarity")


def find_similar(index: DataFrame, queries: DataFrame, top: int = 5) -> DataFrame:
    """Most similar labels per query: best row of each label (ties to the smallest id, of any type), ``top`` labels, 4 digits.

    ``index``: id, label, vector of unit length; ``queries``: query_id, query (vector). Queries that stay below
    ``SEND_BYTES`` (counted first) go to every task, which multiplies its batches with them; more are spread by a
    shuffle join. The best row per (query, label) is a partial aggregation, so what is shuffled does not grow with
    the index.
    """
    probes = queries.select("query_id", unit_length("query").alias("query"))
    sized = probes.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("query")).alias("w")).first()
    if 0 < sized["n"] * (sized["w"] or 0) * 8 <= SEND_BYTES:
        scored = _scored(index, probes)
    else:
        scored, _ = with_blocks(index, probes, "query_id", "query")
        scored = scored.select("id", "label", "vector", F.explode("block").alias("q")).select(
            F.col("q.query_id").alias("query_id"), "id", "label", F.round(dot(F.col("vector"), F.col("q.query")), 12).alias("similarity"))
    best = scored.groupBy("query_id", "label").agg(
        F.min(F.struct((-F.col("similarity")).alias("distance"), "id")).alias("b"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("b.distance", "label"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= top).select(
        "query_id", F.col("rank").cast("long").alias("rank"), "label", F.col("b.id").alias("id"),
        F.bround(-F.col("b.distance"), 4).alias("similarity"))


def classify(rows: DataFrame, centres: DataFrame, identity: str = "id", vector: str = "vector") -> DataFrame:
    """Label of the best class centre by softmax over dot products, with the three best classes.

    ``centres``: label, centroid. Per block a row keeps its three best classes and the sum
    of exponentials; blocks are then combined per row.
    """
    scored, n_blocks = with_blocks(rows.select(identity, vector), centres, "label", "centroid")
    scores = F.transform("block", lambda c: F.struct(
        dot(F.col(vector), c["centroid"]).alias("score"), c["label"].alias("label")))
    order = F.array_sort(F.transform(scores, lambda s: F.struct((-s["score"]).alias("loss"), s["label"].alias("label"))))
    part = scored.select(identity, F.slice(order, 1, 3).alias("best"),
                         F.aggregate(scores, F.lit(0.0), lambda a, s: a + F.exp(s["score"])).alias("z"))
    if n_blocks > 1:
        # One row per block and item: at most the number of blocks, which the class count bounds.
        part = part.groupBy(identity).agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, 3).alias("best"),
                                          F.sum("z").alias("z"))
    top3 = F.transform("best", lambda s: F.struct(s["label"].alias("gloss"), F.bround(F.exp(-s["loss"]) / F.col("z"), 4).alias("confidence")))
    return part.select(identity, top3.alias("top3")).select(
        identity, F.col("top3")[0]["gloss"].alias("predicted"), F.col("top3")[0]["confidence"].alias("confidence"), "top3")


def kmeans(rows: DataFrame, k: int, identity: str = "id", vector: str = "vector", seed: int = 42) -> DataFrame:
    """Cluster number per row; at most as many clusters as rows."""
    n = rows.limit(k).count()
    data = rows.select(identity, array_to_vector(F.transform(vector, lambda v: v.cast("double"))).alias("features"))
    model = KMeans(k=max(2, min(k, n)), seed=seed, maxIter=20).fit(data)
    return model.transform(data).select(identity, F.col("prediction").cast("long").alias("cluster_id"))


def pca_2d(rows: DataFrame, identity: str = "id", vector: str = "vector") -> DataFrame:
    """First two principal components of the centred vectors.

    An axis points where its entry of largest size is positive, so reruns agree on the signs.
    """
    data = rows.select(identity, array_to_vector(F.transform(vector, lambda v: v.cast("double"))).alias("features"))
    centre = data.agg(Summarizer.mean(F.col("features")).alias("m")).select(vector_to_array("m").alias("m")).first()["m"]
    shifted = rows.select(identity, array_to_vector(F.zip_with(vector, F.lit(centre), lambda v, c: v.cast("double") - c)).alias("features"))
    model = PCA(k=2, inputCol="features", outputCol="pc").fit(shifted)
    axes = model.pc.toArray()
    x_sign, y_sign = (float(np.sign(a[np.abs(a).argmax()])) for a in axes.T)
    pc = vector_to_array("pc")
    return model.transform(shifted).select(identity, (pc[0] * x_sign).alias("x"), (pc[1] * y_sign).alias("y"))


def cluster_summary(clusters: DataFrame, manifest: DataFrame, sample: int = 10, top: int = 5) -> DataFrame:
    """Per cluster: size, the most frequent labels among the first members, representative ids.

    The rank limit of ``sample`` is applied before the shuffle, so a huge cluster sends only
    its first members.
    """
    sizes = clusters.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))
    rank = F.row_number().over(Window.partitionBy("cluster_id").orderBy("segment_id"))
    first = clusters.withColumn("rn", rank).filter(F.col("rn") <= sample)
    members = first.join(manifest.select("segment_id", "label"), "segment_id", "left")
    reps = members.filter(F.col("rn") <= top).groupBy("cluster_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("rn", F.col("segment_id").cast("string").alias("s")))), lambda r: r["s"]), ", ").alias("representative_ids"))
    labels = members.filter(~blank("label")).groupBy("cluster_id", "label").agg(F.count(F.lit(1)).alias("n"), F.min("rn").alias("at"))
    texts = labels.groupBy("cluster_id").agg(F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(
        F.struct((-F.col("n")).alias("down"), "at", "label"))), 1, top),
        lambda r: F.concat(r["label"], F.lit("("), (-r["down"]).cast("string"), F.lit(")"))), ", ").alias("sample_texts"))
    return sizes.join(texts, "cluster_id", "left").join(reps, "cluster_id", "left").withColumn(
        "sample_texts", F.coalesce("sample_texts", F.lit("")))


def apply_cluster_names(manifest: DataFrame, clusters: DataFrame, names: DataFrame) -> DataFrame:
    """Write non-blank cluster names as labels of their members; other labels stay."""
    named = clusters.join(names.filter(~blank("name")), "cluster_id").select("segment_id", "name")
    return manifest.join(named, "segment_id", "left").withColumn("label", F.coalesce("name", "label")).drop("name")
