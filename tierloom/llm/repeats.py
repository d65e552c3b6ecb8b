"""Remove repeated byte strings by refining suffix buckets.

Suffixes are put into buckets by their first q bytes, and buckets of strings that may reach the wanted
length are refined by identifiers of the bytes at later offsets until equal buckets mean equal strings.
Only anchors take part: the suffix with the smallest q-gram hash of each window of the wanted
length. Equal strings have their anchor at the same place, so none is lost. Anchors with equal
surroundings are settled at once; the others of a bucket are compared over the range of offsets that
a string may start before its anchor. A bucket with many members is refined first: the range is cut in two, and the bytes
that all strings of a half share give the identifiers of the new buckets, again and again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierloom.llm.common import PrefixHash, joined, mixed, parts, slices, stored, utf8

#: Bytes of the initial buckets.
Q = 24
#: Members of a bucket that are compared in one piece.
MEMBERS = 20_000
STEP = np.uint64(0x9E3779B97F4A7C15)
FAR = np.uint64((1 << 64) - 1)


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window, from minima inside aligned blocks."""
    n = len(x)
    rest = -n % width
    blocks = np.concatenate((x, np.full(rest, FAR))).reshape(-1, width)
    forward = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(backward[:n - width + 1], forward[width - 1:n])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, q: int = Q) -> tuple[np.ndarray, ...]:
    """Anchors of all texts of a buffer: position in the buffer, text, q-gram hash, hash of the surroundings.

    The surroundings reach as far as any string of ``length`` bytes with this anchor may.
    """
    width = length - q + 1
    empty = np.empty(0, dtype=np.int64)
    if len(data) < length:
        return empty, empty, empty.view(np.uint64), empty.view(np.uint64)
    hashed = PrefixHash(data)
    at = np.arange(len(data) - q + 1)
    gram = hashed(at, at + q)
    ends = offsets[1:] - 1  # a separator follows each text
    low = sliding_minimum(gram, width)
    # Windows that lie inside a text.
    inside = np.zeros(len(low) + 1, dtype=np.int64)
    begin, stop = offsets[:-1], np.maximum(ends - length + 1, offsets[:-1])
    stop = np.minimum(stop, len(low))
    begin = np.minimum(begin, len(low))
    np.add.at(inside, begin, 1)
    np.add.at(inside, stop, -1)
    low = np.where(np.cumsum(inside)[:-1] > 0, low, FAR)
    # A position is an anchor if it is the minimum of a window that holds it; the largest of the
    # minima over these windows cannot exceed its hash, so equality tells.
    upper = ~sliding_minimum(np.concatenate((np.full(width - 1, FAR), np.where(low == FAR, FAR, ~low), np.full(width - 1, FAR))), width)
    pos = np.flatnonzero(gram == upper[:len(gram)])
    text = np.searchsorted(offsets, pos, side="right") - 1
    left = np.minimum(pos - offsets[text], length - q)
    right = np.minimum(ends[text] - pos, length)
    good = right >= q
    pos, text, left, right = pos[good], text[good], left[good], right[good]
    around = mixed(hashed(pos - left, pos + right) + left.astype(np.uint64) * STEP)
    return pos, text, gram[pos], around


def _merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals; touching ones join."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    cut = np.concatenate(([True], start[1:] > end[:-1]))
    first = np.flatnonzero(cut)
    return start[first], end[np.concatenate((first[1:] - 1, [len(end) - 1]))]


def _anchor_rows(docs: DataFrame, text: str, length: int) -> DataFrame:
    """Anchors (gram, around, key, n, pos, times), and covered intervals (gram null, pos to upto).

    ``key`` and ``n`` name a text: its hash and its bytes. Surroundings that a text repeats are
    reported once with the times they occur, and what they cover as intervals.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text", 2 << 20):
            texts = utf8(batch.column("_text"))
            data, offsets = joined(texts)
            pos, owner, gram, around = anchors(data, offsets, length)
            size = np.diff(offsets) - 1
            inner = pos - offsets[owner]
            order = np.lexsort((inner, around, gram, owner))
            pos, owner, gram, around, inner = pos[order], owner[order], gram[order], around[order], inner[order]
            fresh = np.ones(len(pos), dtype=bool)
            fresh[1:] = (owner[1:] != owner[:-1]) | (gram[1:] != gram[:-1]) | (around[1:] != around[:-1])
            first = np.flatnonzero(fresh)
            times = np.diff(np.concatenate((first, [len(pos)])))
            again = np.repeat(times, times) > 1
            spans = []
            for k in np.unique(owner[again]):
                here = inner[again & (owner == k)]
                a, b = _merged(np.maximum(here - (length - Q), 0), np.minimum(here + length, size[k]))
                spans.append((np.full(len(a), k), a, b))
            k = np.concatenate([owner[first], *[s[0] for s in spans]]).astype(np.int64)
            none = np.arange(len(k)) >= len(first)
            pad = np.zeros(len(k) - len(first), dtype=np.int64)
            key = batch.column("_key").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate((gram[first].view(np.int64), pad)), mask=none), pa.array(np.concatenate((around[first].view(np.int64), pad)), mask=none),
                 pa.array(key[k]), pa.array(size[k].astype(np.int64)),
                 pa.array(np.concatenate([inner[first], *[s[1] for s in spans]]).astype(np.int64)),
                 pa.array(np.concatenate((times, pad)).astype(np.int64)), pa.array(np.concatenate([np.zeros(len(first), dtype=np.int64), *[s[2] for s in spans]]).astype(np.int64))],
                names=["gram", "around", "key", "n", "pos", "times", "upto"])

    given = docs.select(F.xxhash64(text).alias("_key"), F.col(text).alias("_text"))
    return given.mapInArrow(run, "gram long, around long, key long, n long, pos long, times long, upto long")


def _surroundings(docs: DataFrame, open_anchors: DataFrame, text: str, length: int) -> DataFrame:
    """The bytes around anchors that are still open: ``bucket``, ``low``, ``high`` (offsets before the anchor), ``left``, ``bytes``."""
    wanted = open_anchors.groupBy("key", "n").agg(F.collect_list(F.struct("gram", "pos", "settled")).alias("_at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text", 1 << 20):
            rows = []
            for key, n, t, at in zip(*(batch.column(c).to_pylist() for c in ("key", "n", "_text", "_at"))):
                raw = t.encode("utf-8", "surrogatepass")
                for x in at:
                    p = x["pos"]
                    left = min(p, length - Q)
                    rows.append((x["gram"], 0, length - Q, left, raw[p - left:p + length], key, n, p, x["settled"]))
            columns = list(zip(*rows)) or [()] * 9
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                             names=["bucket", "low", "high", "left", "bytes", "key", "n", "pos", "settled"])

    texts = docs.select(F.xxhash64(text).alias("key"), F.octet_length(text).cast("long").alias("n"), F.col(text).alias("_text"))
    # Copies of a text would bring the same bytes again; the join has put them side by side.
    rows = texts.join(wanted, ["key", "n"]).dropDuplicates(["key", "n"]).select("key", "n", "_text", "_at")
    return rows.mapInArrow(run, "bucket long, low long, high long, left long, bytes binary, key long, n long, pos long, settled boolean")


def _halves(rows: DataFrame, length: int) -> DataFrame:
    """Refine buckets: both halves of the range of offsets, with the bytes all strings of a half share as new identifier."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "bytes"):
            raw = batch.column("bytes").to_pylist()
            data, offsets = joined(raw)
            hashed = PrefixHash(data)
            low, high, left, bucket = (batch.column(c).to_numpy() for c in ("low", "high", "left", "bucket"))
            right = np.diff(offsets) - 1 - left
            middle = (low + high) // 2
            for a, b in ((low, middle), (middle + 1, high)):
                fits = (left >= a) & (right >= length - b) & (a <= b)
                keep = np.flatnonzero(fits)
                at = offsets[:-1][keep] + left[keep]
                found = mixed(hashed(at - a[keep], at + length - b[keep]) ^ mixed(bucket[keep].view(np.uint64) + a[keep].astype(np.uint64)))
                part = batch.take(pa.array(keep))
                part = part.set_column(0, "bucket", pa.array(found.view(np.int64))).set_column(1, "low", pa.array(a[keep])).set_column(2, "high", pa.array(b[keep]))
                yield part

    return rows.mapInArrow(run, rows.schema)


def _compare(group: pa.Table, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of whole buckets whose strings occur twice, and the covered interval of each relative to the anchor."""
    raw = group.column("bytes").combine_chunks().to_pylist()
    data, offsets = joined(raw)
    hashed = PrefixHash(data)
    low, high, left, bucket = (group.column(c).to_numpy() for c in ("low", "high", "left", "bucket"))
    right = np.diff(offsets) - 1 - left
    anchor = offsets[:-1] + left
    most, least = np.full(len(raw), -1, dtype=np.int64), np.full(len(raw), 1 << 30, dtype=np.int64)
    salt = mixed(bucket.view(np.uint64))
    for o in range(int(low.min()), int(high.max()) + 1):
        fit = np.flatnonzero((low <= o) & (o <= high) & (left >= o) & (right >= length - o))
        if len(fit) < 2:
            continue
        code = hashed(anchor[fit] - o, anchor[fit] - o + length) ^ salt[fit]
        order = np.argsort(code)
        same = code[order][1:] == code[order][:-1]
        twice = np.zeros(len(fit), dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        hit = fit[twice]
        most[hit] = np.maximum(most[hit], o)
        least[hit] = np.minimum(least[hit], o)
    rows = np.flatnonzero(most >= 0)
    return rows, np.stack((-most[rows], length - least[rows]), axis=1)


def _covered_by_comparison(rows: DataFrame, length: int, members: int) -> DataFrame:
    """(key, n, start, end) from buckets of at most about ``members`` rows, whole buckets per task."""

    def emit(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        group = pa.Table.from_batches(held)
        hit, span = _compare(group, length)
        part = group.take(pa.array(hit))
        pos = part.column("pos").to_numpy()
        return pa.RecordBatch.from_arrays(
            [part.column("key").combine_chunks(), part.column("n").combine_chunks(), pa.array(pos + span[:, 0]), pa.array(pos + span[:, 1])],
            names=["key", "n", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket = batch.column("bucket").to_numpy()
            if held and n >= 4000:
                # Compare what is held up to the last change of bucket.
                tail = held[-1].column("bucket").to_numpy()[-1]
                change = int(np.argmax(bucket != tail)) if (bucket != tail).any() else -1
                if change >= 0:
                    yield emit([*held, batch.slice(0, change)] if change else held)
                    held, n = [], 0
                    batch = batch.slice(change)
            held.append(batch)
            n += batch.num_rows
        if held:
            yield emit(held)

    dealt = rows.repartition(parts(rows), "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "key long, n long, start long, end long")


def covered(docs: DataFrame, length: int = 200, text: str = "text", members: int = MEMBERS) -> DataFrame:
    """Intervals (key, n, start, end) of bytes that lie in a string of ``length`` bytes that occurs twice; they overlap."""
    found = stored(_anchor_rows(docs.filter(F.octet_length(text) >= length), text, length), "anchors")
    marks = found.filter("gram is not null")
    inside = found.filter("gram is null").select("key", "n", F.col("pos").alias("start"), F.col("upto").alias("end"))
    alike = stored(marks.groupBy("gram", "around").agg(
        F.sum("times").alias("times"), F.min(F.struct("key", "n", "pos")).alias("one")), "buckets")
    whole = marks.join(alike.filter("times > 1").select("gram", "around"), ["gram", "around"]).select(
        "key", "n", F.greatest(F.col("pos") - (length - Q), F.lit(0)).alias("start"), F.least(F.col("pos") + length, F.col("n")).alias("end"))
    several = alike.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1").select("gram")
    still = alike.join(several, "gram").select("gram", "one.key", "one.n", "one.pos", (F.col("times") > 1).alias("settled"))
    rows = stored(_surroundings(docs, still, text, length), "refine")
    out = inside.union(whole)
    while True:
        large = stored(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("_size")).filter(F.col("_size") > members).select("bucket"), "large")
        if not large.limit(1).count():
            return out.union(_covered_by_comparison(rows, length, members)).distinct()
        out = out.union(_covered_by_comparison(rows.join(large, "bucket", "left_anti").select(rows.columns), length, members))
        many = rows.join(large, "bucket", "left_semi").select(rows.columns)
        # One offset left: members of a bucket hold the same string.
        equal = many.filter("low = high")
        out = out.union(equal.select("key", "n", (F.col("pos") - F.col("low")).alias("start"), (F.col("pos") - F.col("low") + length).alias("end")))
        rows = stored(_halves(many.filter("low < high"), length), "refine")


def remove_repeats(docs: DataFrame, length: int = 200, keep: Sequence[str] | None = None, text: str = "text",
                   members: int = MEMBERS, kept: str | None = None) -> DataFrame:
    """Add ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` to documents; ``kept`` names a binary column for what is left.

    Texts are judged as UTF-8 bytes. Null counts as empty; texts below ``length`` lose nothing; every copy of
    a long text that occurs twice loses everything, and an overlap of a string with itself counts as two
    places. An empty table stays empty. Columns named like the added ones are replaced; ``keep`` names the columns
    carried along (all by default).
    """
    added = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *([kept] if kept else [])]
    carried = [c for c in (keep or docs.columns) if c not in added]
    spans = covered(docs, length, text, members).groupBy("key", "n").agg(F.collect_list(F.struct("start", "end")).alias("_spans"))
    own = docs.select(*carried, F.col(text).alias("_text"), F.xxhash64(text).alias("key"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n"))
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            out = []
            for raw, span in zip(utf8(batch.column("_text")), batch.column("_spans").to_pylist()):
                a, b = _merged(np.array([s["start"] for s in span or ()], dtype=np.int64), np.array([s["end"] for s in span or ()], dtype=np.int64))
                left, at = [], 0
                for x, y in zip(a.tolist(), b.tolist()):
                    left.append(raw[at:x])
                    at = y
                rest = b"".join(left) + raw[at:]
                out.append((len(raw), len(raw) - len(rest), len(a), hashlib.sha256(rest).hexdigest(), rest))
            columns = list(zip(*out))
            arrays = [pa.array(c, pa.int64()) for c in columns[:3]] + [pa.array(columns[3], pa.string())] + ([pa.array(columns[4], pa.binary())] if kept else [])
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in carried] + arrays, names=[*carried, *added])

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in carried), "n_bytes long, n_removed long, n_spans long, kept_sha256 string", *([f"`{kept}` binary"] if kept else [])])
    joined_rows = own.alias("d").join(spans.withColumnsRenamed({"key": "_k", "n": "_n"}), (F.col("key") == F.col("_k")) & (F.col("n") == F.col("_n")), "left")
    return joined_rows.select(*carried, "_text", "_spans").mapInArrow(run, schema)
