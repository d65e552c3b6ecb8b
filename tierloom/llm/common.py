"""Small helpers of the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType
from pyspark.sql.window import Window

from tierloom.session import new_folder

#: Words are runs of anything but these ASCII characters; bytes.split() splits on the same set.
WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write a table to the shared folder and read it again: cuts lineage and survives lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def extended(schema: StructType, more: str) -> StructType:
    """A schema with more fields behind its own, all of which may be null."""
    return StructType([StructField(f.name, f.dataType) for f in (*schema.fields, *StructType.fromDDL(more).fields)])


def parts(df: DataFrame) -> int:
    """Number of shuffle partitions to ask for where one is named explicitly."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def in_order(df: DataFrame, order: list[Column], keys: list[str] | None = None, out: str = "place", total: str | None = None) -> DataFrame:
    """Add the place (0, 1, 2 ...) of every row in ``order``, within ``keys`` if any, without a global sort.

    ``total`` names a column for the number of rows of the key.

    Rows are dealt by ranges of the whole order and written in order; a place is the number of rows in
    earlier ranges plus the place inside the range. ``order`` starts with ``keys`` (not null) and should
    be total. A key of any size spreads over as many ranges as it fills; one row per range and key is summed.
    """
    keys = keys or []
    dealt = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(
        "_at", F.monotonically_increasing_id()), "ordered").withColumn("_range", F.shiftright("_at", 33))
    ranges = dealt.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    earlier = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("_shift", F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first"))
    extra = [total] if total else []
    if total:
        ranges = ranges.withColumn(total, F.sum("_n").over(Window.partitionBy(*(keys or [F.lit(0)]))))
    ranges = ranges.drop("_n", "_first")
    return dealt.join(ranges, [*keys, "_range"]).withColumn(out, F.col("_at") + F.col("_shift")).select(*df.columns, out, *extra)


def utf8(column: pa.Array) -> list[bytes]:
    """Values of an Arrow string column as bytes, null as empty."""
    return [v or b"" for v in column.cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the named text column holds about ``most`` bytes per slice.

    Bounds the memory of vectorised steps; a text longer than that makes a slice of its own.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = batch.column(column).cast(pa.binary())
        sizes = np.array([0 if v is None else v for v in pa.compute.binary_length(lengths).to_pylist()], dtype=np.int64)
        ends, begin, total = [], 0, 0
        for i, n in enumerate(sizes):
            if i > begin and total + n > most:
                ends.append((begin, i))
                begin, total = i, 0
            total += int(n)
        ends.append((begin, batch.num_rows))
        for a, b in ends:
            yield batch.slice(a, b - a)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply); spreads all bits of unsigned integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: An odd multiplier and its inverse modulo 2**64, for prefix hashes.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
#: One random 64-bit value per byte.
BYTE_CODES = mixed(np.arange(1, 257, dtype=np.uint64))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64."""
    out = np.empty(max(n, 1), dtype=np.uint64)
    out[0], filled, step = 1, 1, base
    while filled < n:
        take = min(filled, n - filled)
        out[filled:filled + take] = out[:take] * np.uint64(step)
        filled += take
        step = step * step % (1 << 64)
    return out[:n]


class PrefixHash:
    """Hashes of any substring of a byte buffer from prefix sums, vectorised."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.prefix = np.zeros(n + 1, dtype=np.uint64)
        if n:
            np.cumsum(BYTE_CODES[data] * powers(BASE, n), out=self.prefix[1:])
        self.inverse = powers(BASE_INVERSE, n + 1)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.prefix[end] - self.prefix[start]) * self.inverse[start])


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a byte buffer."""
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one buffer, separated by a newline, and the offset of each text (one more at the end)."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts]))).astype(np.int64)
    return data, offsets
