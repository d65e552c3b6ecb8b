"""Score documents with a causal self-attention model on subword ids.

Words and their counts over all training documents give the base model and the vocabulary. A small
self-attention network, trained in numpy, predicts the class of the next subword; inside a class the
corpus counts of subwords decide. A word's probability mixes the attention model's probability of its
subwords with its discounted share of the corpus. Training has a warm start on the driver from a bounded number of windows; then
every block of documents trains on all its training texts and the weights are averaged, so no text is
left out. Long documents are scored in overlapping windows, each token once.
"""

from __future__ import annotations

import base64
import functools
import os
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierloom.llm.common import parts, slices, stored, utf8

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Tokens of a window, and how far the next window starts; the difference is context only.
WINDOW, STRIDE = 32, 24
WIDTH, HIDDEN, CLASSES = 16, 32, 256
#: Subwords with an embedding of their own; the rest share one.
INPUTS = 2048
#: Bytes of text in a block of documents.
BLOCK_BYTES = 24 << 20
#: Training reads stretches of so many words. The warm start takes about WARM_TEXTS documents and at most WARM_EACH
#: stretches of each, for a common start only; afterwards every block trains on one in SHARE stretches, that is on all, of
#: its training documents, in pieces of about PIECE subwords.
STRETCH, WARM_TEXTS, WARM_EACH, SHARE, PIECE = 64, 2_000, 4, 1, 1 << 20
BATCH = 64
#: Share of the attention model in the probability of a word; what is left goes to corpus counts, of which DISCOUNT is
#: taken off every training word and given to the attention model as well.
ATTENTION, DISCOUNT = 0.5, 0.5
END_WORD = b""


@functools.lru_cache(2)
def subwords(path: str = TOKENIZER):
    """A byte-level tokenizer from a file of ranks."""
    import tiktoken

    pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), max(ranks.values()) + 1


def held_out(doc_id: str) -> Column:
    """crc32 of the id as text is divisible by ten; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 10 == 0


class Classes:
    """Subword counts, their split into classes, and the input rows of frequent subwords."""

    def __init__(self, counts: np.ndarray, classes: int = CLASSES, inputs: int = INPUTS):
        smooth = counts.astype(np.float64) + 0.1
        order = np.argsort(-smooth, kind="stable")
        single = min(classes - 8, len(order))
        self.of = np.empty(len(counts), dtype=np.int32)
        self.of[order[:single]] = np.arange(single)
        rest = order[single:]
        if len(rest):
            # The others fall into classes of about equal mass, frequent ones first.
            mass = np.cumsum(smooth[rest])
            self.of[rest] = single + np.minimum((mass / mass[-1] * (classes - single)).astype(np.int32), classes - single - 1)
        total = np.bincount(self.of, weights=smooth, minlength=classes)
        self.log_inside = (np.log(smooth) - np.log(total[self.of])).astype(np.float32)
        self.row = np.full(len(counts), inputs, dtype=np.int32)
        self.row[order[:inputs]] = np.arange(min(inputs, len(order)))
        self.log_class = np.log(np.maximum(total, 1e-3) / total.sum()).astype(np.float32)


class Model:
    """One layer of causal self-attention with a bias per distance, and a softmax over classes."""

    shapes = {"e": (INPUTS + 2, WIDTH), "q": (WIDTH, WIDTH), "k": (WIDTH, WIDTH), "v": (WIDTH, WIDTH), "near": (WINDOW,),
              "skip": (WIDTH, HIDDEN), "o": (WIDTH, HIDDEN), "b": (HIDDEN,), "c": (HIDDEN, CLASSES), "cb": (CLASSES,)}
    size = sum(int(np.prod(s)) for s in shapes.values())

    def __init__(self, flat: np.ndarray | None = None, log_class: np.ndarray | None = None, seed: int = 7):
        draw = np.random.default_rng(seed)
        self.flat = np.concatenate([(draw.standard_normal(int(np.prod(s))) * (0.1 if n == "e" else 0.25 if len(s) > 1 else 0.0))
                                    for n, s in self.shapes.items()]).astype(np.float32) if flat is None else flat.astype(np.float32).copy()
        self.p, at = {}, 0
        for n, s in self.shapes.items():
            size = int(np.prod(s))
            self.p[n] = self.flat[at:at + size].reshape(s)
            at += size
        if flat is None and log_class is not None:
            self.p["cb"][:] = log_class
        self.causal = np.where(np.arange(WINDOW)[:, None] >= np.arange(WINDOW)[None, :], 0, -1e9).astype(np.float32)
        self.away = np.maximum(np.arange(WINDOW)[:, None] - np.arange(WINDOW)[None, :], 0)
        # Room for a batch, used again by the next one: hidden values, with a last column of ones that takes the bias of the
        # classes as one more row of their weights, and scores.
        self.hidden = np.ones((0, HIDDEN + 1), dtype=np.float32)
        self.scores = np.empty((0, CLASSES), dtype=np.float32)

    def room(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.hidden) < n:
            self.hidden, self.scores = np.ones((n, HIDDEN + 1), dtype=np.float32), np.empty((n, CLASSES), dtype=np.float32)
        return self.hidden[:n], self.scores[:n]

    def tables(self) -> None:
        """Per input row: key and value, and query and skip, so that scoring only looks them up."""
        e, p = self.p["e"], self.p
        q, k = e @ p["q"] / np.float32(WIDTH ** 0.5), e @ p["k"]
        self.seen = np.ascontiguousarray(np.concatenate((k, e @ p["v"]), axis=1))
        self.asks = np.ascontiguousarray(np.concatenate((q, e @ p["skip"] + p["b"]), axis=1))
        self.bias = self.causal + p["near"][self.away]
        self.ends = np.concatenate((p["c"], p["cb"][None, :]))
        # Exponents stay far from overflow if these bounds do; else they are cut.
        steep = np.sqrt((q * q).sum(1).max() * (k * k).sum(1).max()) + np.abs(p["near"]).max()
        self.tame = bool(steep < 60 and (np.abs(p["c"]).sum(0) + np.abs(p["cb"])).max() < 80)

    def log_classes(self, x: np.ndarray, target: np.ndarray, first: int) -> np.ndarray:
        """Log probability of the target classes at positions from ``first`` on of windows ``x`` (rows of input rows)."""
        seen, asks = np.take(self.seen, x, axis=0), np.take(self.asks, x[:, first:], axis=0)
        s = np.matmul(asks[:, :, :WIDTH], seen[:, :, :WIDTH].transpose(0, 2, 1))
        s += self.bias[first:]
        if not self.tame:
            np.minimum(s, 60, out=s)
        np.exp(s, out=s)
        a = np.matmul(s, seen[:, :, WIDTH:]).reshape(-1, WIDTH)
        a /= (s.reshape(-1, WINDOW) @ np.ones(WINDOW, dtype=np.float32))[:, None]
        h, z = self.room(len(a))
        u = a @ self.p["o"]
        u += asks[:, :, WIDTH:].reshape(-1, HIDDEN)
        np.tanh(u, out=h[:, :HIDDEN])
        np.matmul(h, self.ends, out=z)
        own = z.reshape(-1)[np.arange(0, z.size, CLASSES) + target[:, first:].reshape(-1)]
        if not self.tame:
            np.minimum(z, 80, out=z)
            own = np.minimum(own, 80)
        np.exp(z, out=z)
        own -= np.log(z @ np.ones(CLASSES, dtype=np.float32))
        return own.reshape(len(x), -1)

    def gradient(self, x: np.ndarray, target: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Of the mean loss over the positions of the mask."""
        p, n, scale = self.p, len(x), np.float32(WIDTH ** -0.5)
        flat = lambda m: m.reshape(-1, m.shape[-1])
        e = np.take(p["e"], x, axis=0)
        # Query, key, value and skip of all positions in one product each way.
        projections = np.concatenate((p["q"] * scale, p["k"], p["v"], p["skip"]), axis=1)
        q, k, v, skip = np.split((flat(e) @ projections).reshape(n, WINDOW, -1), (WIDTH, 2 * WIDTH, 3 * WIDTH), axis=2)
        a = np.matmul(q, k.transpose(0, 2, 1))
        steep = max(a.max(), -a.min()) + np.abs(p["near"]).max()
        a += self.causal + p["near"][self.away]
        if steep >= 60:
            a -= a.max(2, keepdims=True)
        np.exp(a, out=a)
        a /= (flat(a) @ np.ones(WINDOW, dtype=np.float32)).reshape(n, WINDOW, 1)
        u = np.matmul(a, v)
        h, y = self.room(n * WINDOW)
        t = flat(u) @ p["o"]
        t += flat(skip)
        t += p["b"]
        np.tanh(t, out=h[:, :HIDDEN])
        c = np.concatenate((p["c"], p["cb"][None, :]))
        np.matmul(h, c, out=y)
        if np.abs(c).sum(0).max() >= 80:
            y -= y.max(1, keepdims=True)
        np.exp(y, out=y)
        # Rows of y are left as they are; what belongs to a row as a whole is multiplied into the narrow factors.
        total = y @ np.ones(CLASSES, dtype=np.float32)
        y.reshape(-1)[np.arange(0, y.size, CLASSES) + target.reshape(-1)] -= total
        share = ((mask.reshape(-1) / max(mask.sum(), 1)).astype(np.float32) / total)[:, None]
        g = {}
        h = h[:, :HIDDEN]
        g["c"], g["cb"] = (y.T @ (h * share)).T, share[:, 0] @ y
        dh = y @ p["c"].T
        dh *= (1 - h * h) * share
        g["o"], g["b"] = flat(u).T @ dh, dh.sum(0)
        du = (dh @ p["o"].T).reshape(n, WINDOW, WIDTH)
        da, dv = np.matmul(du, v.transpose(0, 2, 1)), np.matmul(a.transpose(0, 2, 1), du)
        da -= (da * a).sum(2, keepdims=True)
        da *= a
        g["near"] = np.bincount(self.away.reshape(-1), weights=np.where(self.causal == 0, da.sum(0), 0).reshape(-1), minlength=WINDOW).astype(np.float32)
        back = np.concatenate((flat(np.matmul(da, k)), flat(np.matmul(da.transpose(0, 2, 1), q)), flat(dv), dh), axis=1)
        g["q"], g["k"], g["v"], g["skip"] = np.split(flat(e).T @ back, (WIDTH, 2 * WIDTH, 3 * WIDTH), axis=1)
        g["q"] = g["q"] * scale
        at = x.reshape(-1, 1) * WIDTH + np.arange(WIDTH)
        g["e"] = np.bincount(at.reshape(-1), weights=(back @ projections.T).reshape(-1), minlength=p["e"].size).astype(np.float32)
        return np.concatenate([g[name].reshape(-1) for name in self.shapes])

    def train(self, x: np.ndarray, target: np.ndarray, mask: np.ndarray, rate: float, epochs: int = 1) -> Model:
        """Adam over batches of windows, in the given order."""
        m, s, t = np.zeros_like(self.flat), np.zeros_like(self.flat), 0
        w = np.empty_like(self.flat)
        steps = max(1, epochs * -(-len(x) // BATCH))
        for _ in range(epochs):
            for a in range(0, len(x), BATCH):
                g = self.gradient(x[a:a + BATCH], target[a:a + BATCH], mask[a:a + BATCH])
                t += 1
                np.multiply(g, g, out=w)
                w -= s
                w *= 0.01
                s += w
                g -= m
                g *= 0.1
                m += g
                np.divide(s, 1 - 0.99 ** t, out=w)
                np.sqrt(w, out=w)
                w += 1e-6
                np.divide(m, w, out=w)
                w *= rate * (1 - 0.9 * t / steps) / (1 - 0.9 ** t)
                self.flat -= w
        return self


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start of each window in the sequence of all tokens, its number in its text, and the end of its text."""
    n = np.where(lengths <= WINDOW, 1, 1 + -(-(lengths - WINDOW) // STRIDE)) * (lengths > 0)
    ends = np.cumsum(lengths)
    number = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(ends - lengths, n) + number * STRIDE, number, np.repeat(ends, n)


def pieces(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of windows side by side, for training: every token is the target of exactly one."""
    n = -(-lengths // WINDOW)
    ends = np.cumsum(lengths)
    number = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(ends - lengths, n) + number * WINDOW, np.repeat(ends, n)


class Sequence:
    """Texts, or stretches of them, as one sequence of subwords. ``opens`` tells which begin a text."""

    def __init__(self, token: np.ndarray, lengths: np.ndarray, classes: Classes, opens: np.ndarray | None = None):
        self.token, self.lengths = token, lengths
        self.row, self.target = classes.row[token], classes.of[token]
        begin = (np.cumsum(lengths) - lengths)[lengths > 0]
        self.before = np.empty_like(self.row)
        self.before[1:] = self.row[:-1]
        self.before[begin] = INPUTS + 1
        self.known = np.ones(len(token), dtype=bool)
        if opens is not None:
            self.before[begin[~opens[lengths > 0]]] = INPUTS
            self.known[begin[~opens[lengths > 0]]] = False

    def batch(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = start[:, None] + np.arange(WINDOW)
        inside = at < end[:, None]
        at = np.minimum(at, end[:, None] - 1)
        return self.before[at], self.target[at], inside & self.known[at]


def spread(words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the subwords of words stand, one after the other, and where each word ends among them."""
    n = (offsets[1:] - offsets[:-1])[words]
    ends = np.cumsum(n)
    return np.repeat(offsets[words] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0), ends


def lengths_of(ends: np.ndarray, per_text: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(per_text)))])


def of_words(words: np.ndarray, per_text: np.ndarray, ids: np.ndarray, offsets: np.ndarray, classes: Classes) -> tuple[Sequence, np.ndarray]:
    """The sequence of texts given as word numbers, and where each word begins in it."""
    at, ends = spread(words, offsets)
    return Sequence(ids[at], lengths_of(ends, per_text), classes), np.concatenate(([0], ends))[:len(words)]


class Numbers(dict):
    """Numbers of words in order of appearance, and the subwords of each word, one after the other."""

    def __init__(self, path: str):
        super().__init__()
        self.coder, self.end = subwords(path)
        self.ids, self.ends = array("i"), array("q", [0])

    def __missing__(self, word: bytes) -> int:
        self.ids.extend(self.coder.encode_ordinary(" " + word.decode("utf-8", "replace")) if word else [self.end])
        self.ends.append(len(self.ids))
        self[word] = number = len(self.ends) - 2
        return number

    def read(self, words: list[bytes]) -> tuple[np.ndarray, int]:
        """Numbers of words, and how many subwords they have."""
        some = np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))
        ends = np.frombuffer(self.ends, dtype=np.int64)  # let go on return, as the array grows
        return some, int((ends[some + 1] - ends[some]).sum())


class Stretches:
    """Collects the subwords of stretches of words, one stretch in ``share`` in turn; with all of them a text is one stretch."""

    def __init__(self, path: str, share: int):
        self.path, self.share, self.turn = path, share, 0
        self.numbers = Numbers(path)
        self.held, self.words, self.per, self.opens = 0, [], [], []

    def add(self, text: bytes, most: int | None = None) -> None:
        words = text.lower().split()
        words.append(END_WORD)
        n = -(-len(words) // STRETCH)
        if self.share == 1 and most is None:
            parts = [(0, len(words))]
        else:
            parts = [(s * STRETCH, (s + 1) * STRETCH) for s in range(-self.turn % self.share, n if most is None else min(n, most), self.share)]
        for a, b in parts:
            some, n_subwords = self.numbers.read(words[a:b])
            self.held += n_subwords
            self.words.append(some)
            self.per.append(len(some))
            self.opens.append(a == 0)
        self.turn += n

    def taken(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Subwords, lengths of the stretches and which open a text; starts anew."""
        words = np.concatenate(self.words) if self.words else np.empty(0, dtype=np.int64)
        per, opens = np.array(self.per, dtype=np.int64), np.array(self.opens, dtype=bool)
        at, ends = spread(words, np.array(self.numbers.ends))
        tokens = np.array(self.numbers.ids)[at]
        if len(self.numbers) > 200_000:
            self.numbers = Numbers(self.path)
        self.held, self.words, self.per, self.opens = 0, [], [], []
        return tokens, lengths_of(ends, per), opens


def score_sequence(model: Model, seq: Sequence, word_start: np.ndarray, classes: Classes, step: int = 64) -> np.ndarray:
    """Natural log probability of each word; every subword is scored in exactly one window."""
    start, number, end = windows(seq.lengths)
    each = np.zeros(len(seq.token), dtype=np.float64)
    for first in (0, WINDOW - STRIDE):
        chosen = np.flatnonzero((number == 0) if first == 0 else (number > 0))
        for a in range(0, len(chosen), step):
            w = chosen[a:a + step]
            x, target, inside = seq.batch(start[w], end[w])
            got = model.log_classes(x, target, first)
            at = start[w][:, None] + np.arange(first, WINDOW)
            if inside[:, -1].all():
                each[at.reshape(-1)] = got.reshape(-1)
            else:
                ok = inside[:, first:]
                each[at[ok]] = got[ok]
    each += classes.log_inside[seq.token]
    return np.add.reduceat(each, word_start) if len(each) else each


def word_logs(attention: np.ndarray, count: np.ndarray, n: int, v: int, share: float = ATTENTION, discount: float = DISCOUNT) -> np.ndarray:
    """Log10 probability of words: a mixture of the attention model and discounted corpus counts.

    The discounts of the ``v`` distinct training tokens add up to ``discount * v`` of ``n`` and go to the attention model,
    so all parts sum to one. Without training tokens the attention model has all.
    """
    if not n:
        return attention / np.log(10)
    chance = np.exp(attention)
    counted = np.maximum(count - discount, 0) / n + discount * v / n * chance
    return np.log10(share * chance + (1 - share) * counted + 1e-300)


def _blocked(docs: DataFrame, doc_id: str, text: str, block_bytes: int) -> DataFrame:
    """Documents with the number of their block; a block has about ``block_bytes`` of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = int.from_bytes(os.urandom(8), "little", signed=True), 0
        for batch in slices(batches, "_text", block_bytes):
            n = batch.column("_text").nbytes
            if held and held + n > block_bytes:
                block, held = int.from_bytes(os.urandom(8), "little", signed=True), 0
            held += n
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([block] * batch.num_rows, pa.int64())], names=[*batch.schema.names, "_block"])

    given = docs.select(F.col(doc_id).alias("_id"), held_out(doc_id).alias("held_out"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    # Written once, so the random names of blocks stand.
    return stored(given.mapInArrow(run, given.schema.simpleString()[7:-1].replace(":", " ") + ", _block long"), "blocks")


def _words(rows: DataFrame) -> DataFrame:
    """(block, word, times in training documents) of every distinct word of a block; the end counts as the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, counts, seen = None, Counter(), set()

        def told() -> Iterator[pa.RecordBatch]:
            words = list(counts) + list(seen - counts.keys())
            for a in range(0, len(words), 100_000):
                part = words[a:a + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(part), pa.int64()), pa.array(part, pa.binary()),
                                                  pa.array([counts.get(w, 0) for w in part], pa.int64())], names=["_block", "word", "times"])

        for batch in slices(batches, "_text"):
            for b, out, t in zip(batch.column("_block").to_pylist(), batch.column("held_out").to_pylist(), utf8(batch.column("_text"))):
                if b != block:
                    if block is not None:
                        yield from told()
                    block, counts, seen = b, Counter(), set()
                words = t.lower().split()
                words.append(END_WORD)
                seen.update(words) if out else counts.update(words)
        if block is not None:
            yield from told()

    return rows.select("_block", "held_out", "_text").mapInArrow(run, "_block long, word binary, times long")


def _known_words(words: DataFrame, path: str) -> DataFrame:
    """Add to each word of a block its count in all training documents and its subword ids.

    Words meet in one shuffle, which keeps them sorted: a word has one row per block.
    ``first`` marks one row of each word. The end has an id of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = subwords(path)
        held: list[pa.RecordBatch] = []

        def told(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(rows).combine_chunks()
            word = t.column("word").combine_chunks()
            coded = word.dictionary_encode()
            number, names = coded.indices.to_numpy(), coded.dictionary.to_pylist()
            times = t.column("times").to_numpy()
            c = np.bincount(number, weights=times, minlength=len(names)).astype(np.int64)
            ids = pa.array([coder.encode_ordinary(" " + w.decode("utf-8", "replace")) if w else [end] for w in names], pa.list_(pa.int32()))
            first = np.zeros(len(number), dtype=bool)
            first[np.unique(number, return_index=True)[1]] = True
            return pa.RecordBatch.from_arrays(
                [t.column("_block").combine_chunks(), word, pa.array(times), pa.array(c[number]), ids.take(coded.indices), pa.array(first)],
                names=["_block", "word", "times", "c", "ids", "first"])

        for batch in batches:
            if not batch.num_rows:
                continue
            last = batch.column("word")[batch.num_rows - 1]
            fresh = pa.compute.not_equal(batch.column("word"), last).to_numpy(zero_copy_only=False)
            cut = int(len(fresh) - np.argmax(fresh[::-1])) if fresh.any() else 0
            if cut:
                yield told([*held, batch.slice(0, cut)])
                held = []
            elif held and held[-1].column("word")[held[-1].num_rows - 1] != last:
                yield told(held)
                held = []
            held.append(batch.slice(cut))
        if held:
            yield told(held)

    dealt = words.repartition(parts(words), "word").sortWithinPartitions("word")
    return dealt.mapInArrow(run, "_block long, word binary, times long, c long, ids array<int>, first boolean")


def _subword_counts(words: DataFrame, size: int) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            ids = batch.column("ids")
            flat, offsets = ids.values.to_numpy(), ids.offsets.to_numpy()
            flat = flat[offsets[0]:offsets[-1]]
            total += np.bincount(flat, weights=np.repeat(batch.column("times").to_numpy(), np.diff(offsets)), minlength=size).astype(np.int64)
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int64)), pa.array(total[own])], names=["id", "n"])

    out = np.zeros(size, dtype=np.int64)
    for r in words.select("times", "ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r["id"]] = r["n"]  # one row per subword of the tokenizer
    return out


class _Block:
    """Vocabulary of a block: word numbers, corpus counts and subword ids."""

    def __init__(self, words: pa.Table):
        names = words.column("word").combine_chunks().to_pylist()
        self.number = {w: i for i, w in enumerate(names)}
        self.count = words.column("c").to_numpy()
        ids = words.column("ids").combine_chunks()
        self.offsets = ids.offsets.to_numpy().astype(np.int64)
        self.ids = ids.values.to_numpy()

    def read(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of the texts, ends included, and how many each text has."""
        out, per = [], np.empty(len(texts), dtype=np.int64)
        get = self.number.__getitem__
        for i, t in enumerate(texts):
            words = t.lower().split()
            words.append(END_WORD)
            per[i] = len(words)
            out.append(np.fromiter(map(get, words), dtype=np.int64, count=len(words)))
        return (np.concatenate(out) if out else np.empty(0, dtype=np.int64)), per


def _slices_of(texts: list[bytes], most: int = 2 << 20) -> Iterator[tuple[int, int]]:
    begin, held = 0, 0
    for i, t in enumerate(texts):
        if i > begin and held + len(t) > most:
            yield begin, i
            begin, held = i, 0
        held += len(t)
    if begin < len(texts):
        yield begin, len(texts)


def _warm_start(rows: DataFrame, classes: Classes, path: str, texts: int) -> Model:
    """Train on the driver, on at most ``WARM_EACH`` stretches of about ``texts`` documents chosen by a hash."""
    n = rows.count()
    below = min((1 << 63) - 1, int((min(1.0, texts / max(n, 1)) * 2 - 1) * ((1 << 63) - 1)))
    some = rows.filter(~F.col("held_out") & (F.xxhash64(F.lit(11), "_id", "_text") <= F.lit(below)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Stretches(path, 1)
        for batch in batches:
            for t in utf8(batch.column("_text")):
                own.add(t, WARM_EACH)
                tokens, lengths, opens = own.taken()
                yield pa.RecordBatch.from_arrays([pa.array([tokens], pa.list_(pa.int32())), pa.array([lengths], pa.list_(pa.int64())),
                                                  pa.array([opens], pa.list_(pa.bool_()))], names=["tokens", "lengths", "opens"])

    got = sorted(some.select("_text").mapInArrow(run, "tokens array<int>, lengths array<long>, opens array<boolean>").collect(),
                 key=lambda r: zlib.crc32(np.array(r["tokens"], dtype=np.int32).tobytes()))
    model = Model(log_class=classes.log_class)
    if got:
        seq = Sequence(np.array([i for r in got for i in r["tokens"]], dtype=np.int32), np.array([i for r in got for i in r["lengths"]], dtype=np.int64),
                       classes, np.array([i for r in got for i in r["opens"]], dtype=bool))
        start, _, end = windows(seq.lengths)
        order = np.random.default_rng(5).permutation(len(start))
        x, t, m = seq.batch(start[order], end[order])
        model.train(x, t, m, 0.03, max(1, min(3, 50_000 // len(x))))
    return model


def _trained_blocks(rows: DataFrame, start, classes, path: str, share: int) -> DataFrame:
    """Weights of each block after training on its share, times the tokens it trained on.

    A block trains piece by piece, so what is held at once does not grow with it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, own, model, n = None, None, None, 0

        def trained() -> int:
            tokens, lengths, opens = own.taken()
            if len(tokens):
                seq = Sequence(tokens, lengths, classes.value, opens)
                model.train(*seq.batch(*pieces(seq.lengths)), 0.01)
            return len(tokens)

        def told() -> Iterator[pa.RecordBatch]:
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([(model.flat.astype(np.float64) * n).tobytes()], pa.binary()), pa.array([n], pa.int64())],
                                                 names=["flat", "tokens"])

        for batch in slices(batches, "_text"):
            for b, t in zip(batch.column("_block").to_pylist(), utf8(batch.column("_text"))):
                if b != block:
                    if own is not None:
                        n += trained()
                        yield from told()
                    block, own, model, n = b, Stretches(path, share), Model(start.value), 0
                own.add(t)
                if own.held >= PIECE:
                    n += trained()
        if own is not None:
            n += trained()
            yield from told()

    return rows.filter(~F.col("held_out")).select("_block", "_text").mapInArrow(run, "flat binary, tokens long")


def _averaged(weights: DataFrame) -> np.ndarray | None:
    """Token-weighted mean of the blocks' weights; halves the rows until a handful are left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(Model.size), 0
        for batch in batches:
            for w, k in zip(batch.column("flat").to_pylist(), batch.column("tokens").to_pylist()):
                total += np.frombuffer(w, dtype=np.float64)
                n += k
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([n], pa.int64())], names=["flat", "tokens"])

    rows = stored(weights, "weights")
    n = rows.count()
    while n > 32:
        rows = stored(rows.repartition(-(-n // 16)).mapInArrow(run, "flat binary, tokens long"), "weights")
        n = rows.count()
    got = rows.collect()
    if not got:
        return None
    return (sum(np.frombuffer(r["flat"], dtype=np.float64) for r in got) / sum(r["tokens"] for r in got)).astype(np.float32)


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, block_bytes: int = BLOCK_BYTES,
          share: int = SHARE, warm_texts: int = WARM_TEXTS) -> DataFrame:
    """``id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` per document.

    Lower-case A-Z; tokens are words and one end per document. The base score adds up
    log10((c + 0.1) / (N + 0.1 * (V + 1))). The model's score is the log10 probability of the subwords
    of the words and the end. Null and empty texts have the end alone; a null id is held out; without
    training documents the base score is that of an empty corpus and the model stays at its start.
    Repeated rows are scored alike. An empty table stays empty. ``tokenizer`` is a file that every executor has.
    """
    rows = _blocked(docs, doc_id, text, block_bytes)
    per_block = stored(_known_words(_words(rows), tokenizer), "words")
    seen = per_block.agg(F.count(F.when(F.col("first") & (F.col("c") > 0), 1)).alias("v"), F.coalesce(F.sum("times"), F.lit(0)).alias("n")).first()
    v, n = seen["v"], seen["n"]
    classes = Classes(_subword_counts(per_block, subwords(tokenizer)[1] + 1))
    spark = docs.sparkSession
    shared_classes = spark.sparkContext.broadcast(classes)  # three numbers per subword of the tokenizer
    model = _warm_start(rows, classes, tokenizer, warm_texts)
    mean = _averaged(_trained_blocks(rows, spark.sparkContext.broadcast(model.flat), shared_classes, tokenizer, share))
    final = spark.sparkContext.broadcast(model.flat if mean is None else mean)  # Model.size numbers
    below = n + 0.1 * (v + 1)

    def judge(left: pa.Table, right: pa.Table) -> pa.Table:
        block, own = _Block(right), Model(final.value)
        own.tables()
        texts = utf8(left.column("_text").combine_chunks())
        log_word = np.log10((block.count + 0.1) / below)
        out = {"n_tokens": [], "n_known": [], "base_score": [], "score": []}
        for a, b in _slices_of(texts):
            words_of, per = block.read(texts[a:b])
            first = np.cumsum(per) - per
            out["n_tokens"].append(per)
            out["n_known"].append(np.add.reduceat((block.count[words_of] > 0).astype(np.int64), first))
            out["base_score"].append(np.add.reduceat(log_word[words_of], first))
            seq, word_start = of_words(words_of, per, block.ids, block.offsets, shared_classes.value)
            logs = word_logs(score_sequence(own, seq, word_start, shared_classes.value), block.count[words_of], n, v)
            out["score"].append(np.add.reduceat(logs, first))
        columns = {k: pa.array(np.concatenate(c)) for k, c in out.items()}
        return pa.table({"id": left.column("_id"), "held_out": left.column("held_out"), "n_tokens": columns["n_tokens"], "n_known": columns["n_known"],
                         "train_tokens": pa.array([n] * len(left), pa.int64()), "base_score": columns["base_score"], "score": columns["score"]})

    kind = rows.schema["_id"].dataType.simpleString()
    lean = per_block.select("_block", "word", "c", "ids")
    return rows.groupBy("_block").cogroup(lean.groupBy("_block")).applyInArrow(judge, f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
