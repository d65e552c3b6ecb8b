"""Exact duplicates by an index of cuckoo filters over content digests.

Digests are dealt to shards by their leading bits. A shard is a cuckoo filter (two candidate bins of four
16-bit fingerprints) next to the shard's stored digests; every occupied slot knows the digest it stands
for. A fingerprint that is found is only a hint: it counts when the stored digest agrees. Digests go in,
gain and lose copies and come out again, and a filter that cannot place a fingerprint is built anew with
twice the bins from the stored digests. Shards lie in a table, so an index lives on between jobs.

Equality of contents is equality of SHA-256 digests of the normalised texts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierloom.llm.common import extended, stored

#: Digests that a shard should hold, on average; about 100 bytes each in a task.
SHARD_ROWS = 50_000
#: Rows of one part of a table that are summed before they meet the index.
BLOCK_ROWS = 8192
SLOTS = 4
#: Displacements after which a filter counts as full.
KICKS = 500
INDEX = "shard int, digest binary, copies long, slot int, bins int"


class CuckooFilter:
    """A cuckoo filter whose slots point at stored digests.

    ``bins`` is a power of two. The other bin of a fingerprint is its bin xor a hash of the fingerprint, so
    a fingerprint can be displaced without its digest.
    """

    def __init__(self, bins: int = 16):
        self.digests: list[bytes] = []
        self.copies: list[int] = []
        self.free: list[int] = []
        self._clear(bins)

    def _clear(self, bins: int) -> None:
        self.bins = bins
        self.prints = [0] * (bins * SLOTS)
        self.owner = [-1] * (bins * SLOTS)

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        """Fingerprint (never 0) and both bins; the leading bits of a digest choose the shard and are not used."""
        mark = int.from_bytes(digest[8:10], "little") or 1
        one = int.from_bytes(digest[10:18], "little") & (self.bins - 1)
        return mark, one, self._other(one, mark)

    def _other(self, place: int, mark: int) -> int:
        return place ^ ((mark * 0x5BD1E995 >> 7) & (self.bins - 1))

    def find(self, digest: bytes) -> int:
        """Slot of a digest, or -1: a fingerprint counts only if the stored digest agrees."""
        mark, one, two = self._places(digest)
        for place in (one, two):
            for slot in range(place * SLOTS, place * SLOTS + SLOTS):
                if self.prints[slot] == mark and self.digests[self.owner[slot]] == digest:
                    return slot
        return -1

    def _empty(self, place: int) -> int:
        for slot in range(place * SLOTS, place * SLOTS + SLOTS):
            if not self.prints[slot]:
                return slot
        return -1

    def _place(self, number: int) -> bool:
        """Put the fingerprint of a stored digest into a slot; false when displacing does not end."""
        mark, one, two = self._places(self.digests[number])
        place = one
        for kick in range(KICKS):
            for at in (one, two) if not kick else (place,):
                slot = self._empty(at)
                if slot >= 0:
                    self.prints[slot], self.owner[slot] = mark, number
                    return True
            # Displace in turn from each slot of the bin: reruns take the same steps.
            slot = place * SLOTS + kick % SLOTS
            mark, self.prints[slot] = self.prints[slot], mark
            number, self.owner[slot] = self.owner[slot], number
            place = self._other(place, mark)
        return False

    def _rebuild(self) -> None:
        """Twice the bins, filled from the stored digests, until all have a place."""
        done = False
        while not done:
            self._clear(self.bins * 2)
            done = all(self._place(i) for i, n in enumerate(self.copies) if n > 0)

    def add(self, digest: bytes, copies: int) -> int:
        """Copies of a digest before this change; it goes in with its first copy and out with its last."""
        slot = self.find(digest)
        if slot >= 0:
            number = self.owner[slot]
            before = self.copies[number]
            self.copies[number] = max(before + copies, 0)
            if self.copies[number] == 0:
                self.prints[slot], self.owner[slot] = 0, -1
                self.free.append(number)
            return before
        if copies > 0:
            if self.free:
                number = self.free.pop()
                self.digests[number], self.copies[number] = digest, copies
            else:
                number = len(self.digests)
                self.digests.append(digest)
                self.copies.append(copies)
            # At four digests a bin hardly any filter has room left.
            if not self._place(number):
                self._rebuild()
        return 0

    def live(self, digest: bytes) -> int:
        slot = self.find(digest)
        return self.copies[self.owner[slot]] if slot >= 0 else 0

    @classmethod
    def load(cls, digests: list[bytes], copies: list[int], slots: list[int], bins: int) -> CuckooFilter:
        """The filter as it was stored: every digest takes its slot again."""
        out = cls(bins)
        out.digests, out.copies = list(digests), list(copies)
        for number, slot in enumerate(slots):
            out.prints[slot], out.owner[slot] = out._places(digests[number])[0], number
        return out

    def dump(self) -> list[tuple[bytes, int, int, int]]:
        """Digest, copies, slot and bins of every live digest."""
        return [(self.digests[n], self.copies[n], slot, self.bins) for slot, n in enumerate(self.owner) if n >= 0]


def normalised(text: Column) -> Column:
    """The text without space, tab, line feed, vertical tab, form feed and carriage return; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), " \t\n\x0b\x0c\r", "")


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text), 256))


def shard_of(digest: Column, shards: int) -> Column:
    """Shard by the leading 32 bits of the digest."""
    return F.floor(F.conv(F.hex(F.substring(digest, 1, 4)), 16, 10).cast("long") * shards / F.lit(float(1 << 32))).cast("int")


class Index:
    """Cuckoo filters of all shards with their digests, as a table of live digests.

    ``table`` has shard, digest, copies, slot and bins. ``apply`` gives a new index; tables are written, never
    changed, so a job that runs again finds the index it started from.
    """

    def __init__(self, table: DataFrame, shards: int):
        self.table, self.shards = table, shards

    @classmethod
    def empty(cls, spark, rows: int) -> Index:
        """An index for about ``rows`` digests. Shards hold more if need be; their filters grow."""
        return cls(spark.createDataFrame([], INDEX), max(1, -(-rows // SHARD_ROWS)))

    def apply(self, changes: DataFrame) -> tuple[Index, DataFrame]:
        """Take copies in (``copies`` above 0) or out (below 0) of (digest, copies, and other columns).

        Gives the new index, and the changes with ``before``, the live copies that the digest had when the change
        came, and ``after``, those it has at the end of all changes. Changes of a digest are taken with the additions
        first, then as they come; more copies taken out than there are leaves none. A digest should come in few
        rows: sum the copies of many before.
        """
        carried = [c for c in changes.columns if c not in ("digest", "copies")]
        given = changes.withColumn("shard", shard_of(F.col("digest"), self.shards)).select(
            "shard", "digest", "copies", F.struct(*carried).alias("rest"))
        # Rows of the index and answers share a shape: answers have a null slot.
        schema = extended(given.schema, "slot int, bins int, before long, after long")
        shape = _arrow(schema)

        def work(left: pa.Table, right: pa.Table) -> pa.Table:
            bins = right.column("bins")[0].as_py() if right.num_rows else 16
            have = CuckooFilter.load(right.column("digest").to_pylist(), right.column("copies").to_pylist(), right.column("slot").to_pylist(), bins)
            digests, copies = left.column("digest").to_pylist(), left.column("copies").to_pylist()
            before = np.zeros(len(digests), dtype=np.int64)
            for i in sorted(range(len(digests)), key=lambda i: copies[i] < 0):
                before[i] = have.add(digests[i], copies[i])
            after = [have.live(d) for d in digests]
            answers = left.append_column("before", pa.array(before)).append_column("after", pa.array(after, pa.int64()))
            kept = have.dump()
            shard = (left if left.num_rows else right).column("shard")[0].as_py()
            rows = {"shard": pa.array([shard] * len(kept), pa.int32())}
            for i, name in enumerate(("digest", "copies", "slot", "bins")):
                rows[name] = pa.array([k[i] for k in kept], shape.field(name).type)
            return pa.concat_tables([_shaped(answers, shape), _shaped(pa.table(rows), shape)])

        out = stored(given.groupBy("shard").cogroup(self.table.groupBy("shard")).applyInArrow(work, schema), "index")
        index = Index(out.filter("slot is not null").select("shard", "digest", "copies", "slot", "bins"), self.shards)
        return index, out.filter("slot is null").select("digest", "copies", "rest.*", "before", "after")


def _arrow(schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _shaped(table: pa.Table, shape: pa.Schema) -> pa.Table:
    """All columns of the shape, null where the table has none."""
    columns = [table.column(f.name).cast(f.type) if f.name in table.column_names else pa.nulls(table.num_rows, f.type) for f in shape]
    return pa.table(columns, schema=pa.schema([pa.field(f.name, f.type) for f in shape]))


def _numbered(docs: DataFrame, text: str, doc_id: str, carried: Sequence[str]) -> DataFrame:
    """Digest, length, id, row number and block of every row; written, so that numbers hold."""
    row = F.monotonically_increasing_id()
    rows = docs.select(F.struct(*carried).alias("_doc"), F.col(doc_id).alias("_id"), digest_of(F.col(text)).alias("digest"),
                       F.coalesce(F.length(text), F.lit(0)).alias("_chars"), row.alias("_row"))
    return stored(rows.withColumn("_block", F.floor(F.col("_row") / BLOCK_ROWS)), "digests")


def _summed(rows: DataFrame) -> DataFrame:
    """Copies and best row per digest and block: a digest that fills a third of the table shrinks to one row a block."""
    best = F.struct((-F.col("_chars")).alias("chars"), F.col("_id").isNull().alias("no_id"), F.col("_id").alias("id"), F.col("_row").alias("row"))
    return rows.groupBy("digest", "_block").agg(F.count(F.lit(1)).alias("copies"), F.min(best).alias("best"))


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """Add ``keep_id``, ``group_size``, ``kept`` and ``text_sha256`` to all rows; one row of equal texts is kept.

    Kept is the row with the most code points, then the smallest id (null last), then any of the repeated rows, so a
    group keeps exactly one row. Null texts count as empty; empty and blank texts form one group. An empty table stays
    empty. ``keep`` names the columns to carry along (all by default); those named like an added one are replaced.
    Texts are hashed whole where they are read and do not move unless carried.

    All digests go into an index of cuckoo filters. Those that no other block holds are settled by it; where the
    index has met a digest more than once, its blocks compare their best rows.
    """
    added = {"keep_id", "group_size", "kept", "text_sha256"}
    carried = [c for c in (docs.columns if keep is None else keep) if c.lower() not in added]
    rows = _numbered(docs, text, doc_id, carried)
    sums = _summed(rows)
    _, answers = Index.empty(docs.sparkSession, rows.count()).apply(sums)
    single = answers.filter("after = copies").select("digest", "_block", "best", F.col("copies").alias("group_size"))
    shared = answers.filter("after > copies")
    best = shared.groupBy("digest").agg(F.min("best").alias("best"), F.max("after").alias("group_size"))
    # A digest stands once per block here, so this join has no long rows of one key in the way of others.
    groups = single.unionByName(shared.select("digest", "_block").join(best, "digest").select("digest", "_block", "best", "group_size"))
    return rows.join(groups, ["digest", "_block"]).select(
        "_doc.*", F.col("best.id").alias("keep_id"), "group_size", (F.col("_row") == F.col("best.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def seen(index: Index, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[Index, DataFrame]:
    """Take new documents into a live index: (new index, doc_id and whether an equal text was there or came earlier)."""
    rows = _numbered(docs, text, doc_id, [doc_id])
    after, answers = index.apply(_summed(rows))
    old = answers.groupBy("digest").agg(F.min("before").alias("_before"), F.min("best").alias("_best"))
    blocks = answers.select("digest", "_block").join(old, "digest")
    return after, rows.join(blocks, ["digest", "_block"]).select(
        "_doc.*", ((F.col("_before") > 0) | (F.col("_row") != F.col("_best.row"))).alias("seen"))


def forget(index: Index, docs: DataFrame, text: str = "text") -> Index:
    """Take documents out of a live index; a digest goes when its last copy goes. Unknown texts do not matter."""
    gone = docs.select(digest_of(F.col(text)).alias("digest")).groupBy("digest").agg((-F.count(F.lit(1))).alias("copies"))
    return index.apply(gone.withColumn("_block", F.lit(0)))[0]
