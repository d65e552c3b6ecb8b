"""Find benchmark texts inside documents, allowing for edits.

The q-gram lemma: a place in a document that equals a text of m characters up to k edits shares at least
``m - q + 1 - k * q`` q-grams with it, all within a narrow band of diagonals (document position minus
text position). Shared q-grams are counted per overlapping band; bands that meet the bound are
retained and verified by banded alignment.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierloom.llm.common import mixed, slices

#: Length of a q-gram in characters of the normalised text.
Q = 12
#: Edits allowed per character of the benchmark text.
ERRORS = 0.05
#: Most bytes of benchmark text that are held in one pass; a larger benchmark takes several passes.
BLOCK_BYTES = 8 << 20
#: Benchmark texts shorter than this after normalising are matched exactly, as whole words.
SHORT = 40

TABLE_BITS = 22
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def normalised(text: str | None) -> str:
    """Lower case, words joined by single spaces."""
    return " ".join((text or "").lower().split())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def grams(chars: np.ndarray, q: int = Q) -> np.ndarray:
    """A 64-bit hash of the q characters from each position on."""
    n = len(chars) - q + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    wide = chars.astype(np.uint64)
    for k in range(q):
        out *= MULTIPLIER
        out += wide[k:k + n]
    return out


class Index:
    """The q-grams of a block of benchmark texts, sorted, and a bit table for quick misses."""

    def __init__(self, items: Sequence[tuple[object, str]], errors: float = ERRORS):
        items = [(i, t) for i, t in ((i, normalised(t)) for i, t in items) if t]
        self.ids = [i for i, _ in items]
        self.texts = [codes(t) for _, t in items]
        self.short = [k for k, t in enumerate(self.texts) if len(t) < SHORT]
        self.plain = [t for _, t in items]
        self.length = np.array([len(t) for t in self.texts], dtype=np.int64)
        self.edits = np.floor(self.length * errors).astype(np.int64)
        self.needed = np.maximum(self.length - Q + 1 - self.edits * Q, 1)
        found = [(grams(t), k) for k, t in enumerate(self.texts) if len(t) >= SHORT]
        hashed = np.concatenate([g for g, _ in found]) if found else np.empty(0, dtype=np.uint64)
        item = np.concatenate([np.full(len(g), k) for g, k in found]) if found else np.empty(0, dtype=np.int64)
        place = np.concatenate([np.arange(len(g)) for g, _ in found]) if found else np.empty(0, dtype=np.int64)
        order = np.argsort(hashed, kind="stable")
        self.hashed, self.item, self.place = hashed[order], item[order].astype(np.int64), place[order].astype(np.int64)
        self.known = np.zeros(1 << TABLE_BITS, dtype=bool)
        self.known[self._slot(self.hashed)] = True

    @staticmethod
    def _slot(hashed: np.ndarray) -> np.ndarray:
        return (mixed(hashed) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def hits(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions, items and places in them of all q-grams shared with the benchmark."""
        own = grams(chars)
        at = np.flatnonzero(self.known[self._slot(own)]) if len(own) else np.empty(0, dtype=np.int64)
        low, high = np.searchsorted(self.hashed, own[at], "left"), np.searchsorted(self.hashed, own[at], "right")
        n = high - low
        which = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(at, n), self.item[which], self.place[which]

    def regions(self, chars: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, first diagonal, last diagonal) of the bands that hold enough shared q-grams."""
        at, item, place = self.hits(chars)
        if not len(at):
            return []
        diagonal = at - place
        width = self.edits[item] + 1
        base = int(diagonal.min())
        out: set[tuple[int, int, int]] = set()
        for half in (0, 1):  # two sets of bands, each two widths wide, shifted by one width
            band = (diagonal - base + half * width) // (2 * width)
            key = item * (1 << 40) + band
            values, inverse = np.unique(key, return_inverse=True)
            # A q-gram of the text counts once per band, however often the document repeats it.
            pairs = np.unique(inverse.astype(np.int64) * (1 << 32) + place)
            count = np.bincount(pairs >> 32, minlength=len(values))
            for v, c in zip(values.tolist(), count.tolist()):
                k, b = v >> 40, v & ((1 << 40) - 1)
                if c >= self.needed[k]:
                    w = int(self.edits[k]) + 1
                    first = b * 2 * w + base - half * w
                    out.add((k, first, first + 2 * w - 1))
        return sorted(out)


def aligned(text: np.ndarray, chars: np.ndarray, first: int, last: int, most: int) -> int | None:
    """Fewest edits that turn the text into a part of ``chars`` near the diagonals; None above ``most``.

    Row by row over the text, only the cells from ``first - most`` to ``last + most`` are kept.
    """
    lo, width = first - most, last - first + 2 * most + 1
    n = len(chars)
    j = np.arange(width)
    far = most + 1
    start = lo + j
    row = np.where((start >= 0) & (start <= n), 0, far)  # the match may begin on any diagonal of the band
    for i, c in enumerate(text):
        column = lo + i + j  # document position before the character compared in this row
        inside = (column >= 0) & (column < n)
        same = np.zeros(width, dtype=bool)
        same[inside] = chars[column[inside]] == c
        step = np.where(inside, row + ~same, far)
        step[:-1] = np.minimum(step[:-1], row[1:] + 1)  # a character of the text left out
        after = column + 1
        step[(after < 0) | (after > n)] = far
        # a character of the document put in: a running minimum from the left
        step = np.minimum.accumulate(step - j) + j
        row = np.minimum(step, far)
        if row.min() > most:
            return None
    best = int(row.min())
    return best if best <= most else None


def matches(index: Index, text: str | None) -> dict[int, int]:
    """Items found in a document and the fewest edits of each."""
    plain = normalised(text)
    found: dict[int, int] = {}
    if not plain:
        return found
    if index.short:
        padded = f" {plain} "
        for k in index.short:
            if f" {index.plain[k]} " in padded:
                found[k] = 0
    chars = codes(plain)
    for k, first, last in index.regions(chars):
        if found.get(k) == 0 or index.plain[k] in plain:
            found[k] = 0
            continue
        edits = aligned(index.texts[k], chars, first, last, int(index.edits[k]))
        if edits is not None:
            found[k] = min(edits, found.get(k, edits))
    return found


def blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", most: int = BLOCK_BYTES) -> Iterator[list]:
    """The benchmark in blocks of bounded size, dealt by a hash of id and text."""
    rows = benchmark.select(F.col(item_id).alias("id"), F.col(text).alias("text")).filter("text is not null")
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    n = max(1, -(-total * 2 // most) if total > most else 1)
    for k in range(n):
        yield [(r["id"], r["text"]) for r in rows.filter(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k).collect()]


def find(docs: DataFrame, benchmark: DataFrame, keep: Sequence[str] | None = None, errors: float = ERRORS,
         text: str = "text", item_id: str = "item_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Add ``items`` (array of the benchmark ids found, in order) and ``edits`` (of each) to documents.

    Null and empty texts, on either side, match nothing; an empty benchmark finds nothing. Repeated rows are
    judged alike. Columns named like the added ones are replaced; ``keep`` names the columns carried
    along (all by default). A benchmark above ``block_bytes`` takes one pass over the documents per block.
    """
    carried = [c for c in (keep or docs.columns) if c not in ("items", "edits")]
    given = docs.select(*carried, F.col(text).alias("_text"))
    kind = benchmark.schema[item_id].dataType.simpleString()
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carried).schema),
                        f"items array<{kind}>, edits array<int>", "_text string"])
    kinds = pa.list_(pa.string()) if kind == "string" else None
    for items in blocks(benchmark, item_id, "text", block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(Index(items, errors))  # at most block_bytes of text
        earlier = [c for c in ("items", "edits") if c in given.columns]

        def run(batches: Iterator[pa.RecordBatch], shared=shared, earlier=bool(earlier)) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in slices(batches, "_text"):
                texts = batch.column("_text")
                out = []
                for r, t in enumerate(texts.to_pylist()):
                    got = {index.ids[k]: e for k, e in matches(index, t).items()}
                    if earlier:
                        got |= dict(zip(batch.column("items")[r].as_py(), batch.column("edits")[r].as_py()))
                    out.append(sorted(got.items()))
                ids = pa.array([[i for i, _ in o] for o in out], kinds or pa.list_(pa.int64()))
                edits = pa.array([[e for _, e in o] for o in out], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in carried] + [ids, edits, texts],
                                                 names=[*carried, "items", "edits", "_text"])

        given = given.mapInArrow(run, schema)
    return given.drop("_text")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, errors: float = ERRORS) -> DataFrame:
    """Documents that hold no benchmark text, with their columns unchanged."""
    packed = docs.select(F.struct(*docs.columns).alias("_doc"), F.col("text").alias("text"))
    return find(packed, benchmark, ["_doc"], errors).filter(F.size("items") == 0).select("_doc.*")
