"""Importance resampling of documents towards a target collection.

Lower-cased texts are collapsed to words with single spaces between them. An overlapped regex scan, held to
word borders by lookarounds, gives every run of words as a span; spans are counted by their CRC in a fixed
number of buckets. The log ratio of smoothed bucket shares, target over source, is the gain of a feature, a
document's weight is the sum of its gains, and the highest weights plus Gumbel noise are drawn: a sample
without replacement in proportion to the weights.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from operator import methodcaller

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierloom.llm.common import extended, in_order, slices, stored, utf8

#: Letters A-Z fall to lower case; all ASCII but letters and digits separates words.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))
SPACES = regex.compile(rb" {2,}")


def scanner(n: int) -> regex.Pattern:
    """Matches of runs of n words in collapsed text, when searched with overlaps.

    Quantifiers are possessive: a run that does not reach n words fails at once.
    """
    return regex.compile(rb"(?<![^ ])[^ ]++(?: [^ ]++){%d}(?![^ ])" % (n - 1))


def collapsed(text: bytes) -> bytes:
    return SPACES.sub(b" ", text.translate(LOWER)).strip(b" ")


def bucket_counts(text: bytes, scanners: Sequence[regex.Pattern], buckets: int) -> tuple[list[int], list[int]]:
    """Buckets of a text's features in ascending order, and how many features each holds.

    Matches are taken one by one, so memory grows with the distinct features of one text.
    """
    flat, found = collapsed(text), Counter()
    for pattern in scanners:
        for feature, n in Counter(map(methodcaller("group"), pattern.finditer(flat, overlapped=True))).items():
            found[zlib.crc32(feature) % buckets] += n
    places = sorted(found)
    return places, [found[b] for b in places]


def features(docs: DataFrame, runs: tuple[int, int], buckets: int, text: str, keep: Sequence[str]) -> DataFrame:
    """``_doc`` (the kept columns), ``_words``, ``n_features``, ``_buckets`` and ``_counts`` per document.

    A document has at most ``buckets`` entries, however long it is. Null texts have no features.
    """
    low, high = runs
    source = docs.select(F.struct(*keep).alias("_doc") if keep else F.struct(F.lit(0)).alias("_doc"), F.col(text).alias("_text"))
    schema = extended(source.drop("_text").schema, "_words long, n_features long, _buckets array<int>, _counts array<long>")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanners = [scanner(n) for n in range(low, high + 1)]
        for batch in slices(batches, "_text"):
            places, counts, words, totals = [], [], [], []
            for value in utf8(batch.column("_text")):
                b, n = bucket_counts(value, scanners, buckets)
                places.append(b)
                counts.append(n)
                totals.append(sum(n))
                words.append(totals[-1] if runs == (1, 1) else len(collapsed(value).split()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_doc"), pa.array(words, pa.int64()), pa.array(totals, pa.int64()),
                 pa.array(places, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))],
                names=["_doc", "_words", "n_features", "_buckets", "_counts"])

    return source.mapInArrow(scan, schema)


def totals(scanned: DataFrame) -> DataFrame:
    """Features per bucket over all rows; partial sums leave at most one row per bucket and task to shuffle."""
    return scanned.select(F.explode(F.arrays_zip("_buckets", "_counts")).alias("e")).groupBy(
        F.col("e._buckets").alias("bucket")).agg(F.sum("e._counts").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """floor(1000 ln(smoothed target share / smoothed source share)) per bucket.

    ``source`` and ``target`` are tables of totals; the driver gets one number per bucket, ``buckets`` in all.
    """
    every = source.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    both = (every.join(source.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left")
            .select("bucket", F.coalesce("s", F.lit(0)).cast("double").alias("s"), F.coalesce("t", F.lit(0)).cast("double").alias("t")))
    one = both.agg(F.sum("s").alias("s"), F.sum("t").alias("t")).first()
    ratio = ((F.col("t") + 1) * F.lit(one["s"] + buckets)) / ((F.col("s") + 1) * F.lit(one["t"] + buckets))
    table = np.zeros(buckets, dtype=np.int64)
    for row in both.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).cast("long").alias("gain")).collect():
        table[row["bucket"]] = row["gain"]
    return table


def weighed(scanned: DataFrame, table: np.ndarray) -> DataFrame:
    """``weight`` of every scanned document: the sum of gains over its features."""
    rows = scanned.select("_doc", "_words", "n_features", "_buckets", "_counts")
    schema = extended(rows.select("_doc", "_words", "n_features").schema, "weight long")

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, counts = batch.column("_buckets"), batch.column("_counts")
            sums = np.concatenate(([0], np.cumsum(table[places.flatten().to_numpy()] * counts.flatten().to_numpy())))
            ends = np.concatenate(([0], np.cumsum(pa.compute.list_value_length(places).to_numpy(zero_copy_only=False)))).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("_doc", "_words", "n_features")] + [pa.array(np.diff(sums[ends]), pa.int64())],
                names=["_doc", "_words", "n_features", "weight"])

    return rows.mapInArrow(add_up, schema)


def gumbel(doc_id: Column, seed: int) -> Column:
    """Noise of a document in thousandths: the same for the same id and seed, whatever the partitions."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, runs: tuple[int, int] = (1, 1), buckets: int = 10_000,
             least_words: int = 20, seed: int = 2024, doc_id: str = "doc_id", text: str = "text",
             keep: Sequence[str] | None = None) -> DataFrame:
    """Add ``n_features``, ``weight``, ``score`` and ``rank`` (null if not drawn) to documents.

    Drawn are ``percent`` per cent, rounded down, of the documents with at least ``least_words`` words: those with
    the highest scores, ties to the smaller id, then null ids. ``runs`` gives the shortest and longest run of words.
    Bucket counts cover all rows of ``docs`` and of ``target``. ``keep`` names the columns to carry along (all by
    default); those named like an added one are replaced.

    Null and empty texts have no features and weight 0 and cannot be drawn if ``least_words`` is above 0; a null id
    takes its noise from the empty id. Repeated rows count and are drawn as rows of their own. With no documents the
    result is empty; with no target texts gains only tell rare from frequent buckets. A very long text is scanned
    match by match and leaves at most ``buckets`` counts.
    """
    added = {"n_features", "weight", "score", "rank"}
    carried = [c for c in (docs.columns if keep is None else keep) if c.lower() not in added]
    if doc_id not in carried:
        raise ValueError("keep must hold the id")
    named = F.col(f"_doc.`{doc_id}`")
    scanned = stored(features(docs, runs, buckets, text, carried), "features")
    aim = features(target, runs, buckets, text, [])
    table = gains(totals(scanned), totals(aim), buckets)
    rows = weighed(scanned, table).withColumn("score", F.col("weight") + gumbel(named, seed)).withColumn(
        "_row", F.monotonically_increasing_id())
    rows = stored(rows, "weighed")
    able = F.col("_words") >= least_words
    drawn = rows.filter(able).count() * percent // 100
    placed = in_order(rows, [(~able).asc(), F.col("score").desc(), named.asc_nulls_last(), F.col("_row")])
    return placed.select("_doc.*", "n_features", "weight", "score",
                         F.when(able & (F.col("place") < drawn), F.col("place") + 1).alias("rank"))
