"""Weak-label quality model.

Overlapping heuristic labellers vote bad, good or abstain on every document; where there are label
tables, annotators are one more labeller that speaks on the documents it covers. Expectation-maximisation
over the counts of vote patterns estimates how often each labeller votes how in either class, which
gives every pattern a posterior. Posterior labels then train a linear scorer on hashed words and
word beginnings and on the strengths behind the votes; it judges all documents. Two models are trained this
way, one for low quality and one for abuse; a document is kept when neither rejects it.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierloom.llm.common import PrefixHash, extended, joined, slices, stored, utf8, word_bounds
from tierloom.llm.quality_rules import SYMBOLS, measure

# Common English words of abuse. A parameter of the abuse labellers.
ABUSE_WORDS = frozenset(
    "bastard bitch clown coward creep degenerate disgusting dumb dumbass filth fool freak garbage idiot idiotic imbecile "
    "jerk liar loser moron moronic pathetic pig retard scum scumbag shit shithead sick stupid stupidity sucker trash ugly "
    "vermin weakling worthless".split())

#: Hashed words: 2**BITS weights.
BITS = 18
#: Documents that train the scorer at most (documented bound; chosen by the hash of their id).
TRAIN_ROWS = 6_000
EPOCHS = 6
DENSE = 12
#: Bytes of a word's beginning that are features beside the whole word.
STARTS = (4, 6)
#: Chances that start EM, of a bad vote per class (good, bad): heuristics, annotators.
HEURISTIC, ANNOTATOR = (0.01, 0.3), (0.02, 0.9)


@dataclass(frozen=True)
class Facts:
    """What the labellers of one document look at."""

    words: int
    chars: float
    symbols: float
    dup_lines: float
    repeats: float
    upper: float
    bars: float
    bangs: float
    top_word: float
    distinct: float
    abuse: float
    abuse_kinds: int


def facts(text: bytes) -> Facts:
    n, chars, symbols, dup, repeated = measure(text)
    counts = Counter(text.lower().split())
    w, c = max(n, 1), max(chars, 1)
    letters = len(text) - len(text.translate(None, b"abcdefghijklmnopqrstuvwxyz"))
    capitals = len(text) - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    abused: dict[bytes, int] = {}
    for word, times in counts.items():
        core = word.strip(_EDGE)
        if core in _ABUSE:
            abused[core] = abused.get(core, 0) + times
    return Facts(n, chars / w, symbols / c, dup / w, repeated / w, capitals / max(letters + capitals, 1), text.count(b"|") / w,
                 text.count(b"!") / w, max(counts.values(), default=0) / w, len(counts) / w,
                 sum(abused.values()) / w, len(abused))


_EDGE = b".,!?;:\"'()*#&%$|"
_ABUSE = frozenset(x.encode() for x in ABUSE_WORDS)

#: Votes: 1 = bad, 0 = good, None = abstains. Each labeller sees one aspect.
Labeller = Callable[[Facts], int | None]


def _bad(says: bool) -> int | None:
    return 1 if says else None


QUALITY_LABELLERS: dict[str, Labeller] = {
    "symbols": lambda f: _bad(f.symbols > 0.10),
    "repeats": lambda f: _bad(f.words >= 30 and f.repeats > 0.5),
    "capitals": lambda f: _bad(f.words >= 8 and f.upper > 0.4),
    "bars": lambda f: _bad(f.words >= 8 and f.bars > 0.15),
    "bangs": lambda f: _bad(f.words >= 8 and f.bangs > 0.2),
    "one_word": lambda f: _bad(f.words >= 30 and f.top_word > 0.3),
    "variety": lambda f: _bad(f.words >= 50 and f.distinct < 0.1),
}
ABUSE_LABELLERS: dict[str, Labeller] = {
    "kinds": lambda f: _bad(f.abuse_kinds >= 2),
    "density": lambda f: _bad(f.words >= 20 and f.abuse >= 0.01),
    "count": lambda f: _bad(f.abuse * f.words >= 3),
}


def votes(f: Facts, labellers: dict[str, Labeller]) -> str:
    """One character per labeller: 1 bad, 0 good, - abstains."""
    return "".join({1: "1", 0: "0", None: "-"}[v(f)] for v in labellers.values())


def dense(f: Facts) -> list[float]:
    """The strengths behind the votes, roughly between 0 and 1."""
    return [min(math.log1p(f.words) / 10, 1), min(f.chars / 20, 2), min(f.symbols * 3, 2), min(f.dup_lines * 10, 2), f.repeats,
            f.upper, min(f.bars, 1), min(f.bangs, 1), f.top_word, 1 - f.distinct, min(f.abuse * 40, 2), min(f.abuse_kinds / 3, 2)]


_FOLD = bytes.maketrans(_EDGE + b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b" " * len(_EDGE) + b"abcdefghijklmnopqrstuvwxyz")


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash slots of all words and word beginnings of the texts, and the offset of each text (one more at the end)."""
    data, offsets = joined([t.translate(_FOLD) for t in texts])
    start, end = word_bounds(data)
    hashed = PrefixHash(data)
    found = [hashed(start, end)] + [hashed(start, np.minimum(start + k, end)) + np.uint64(k) for k in STARTS]
    slot = (np.stack(found, axis=1) & np.uint64((1 << BITS) - 1)).astype(np.int32)
    return slot.reshape(-1), np.searchsorted(start, offsets) * len(found)


def fit_labellers(patterns: dict[str, int], bad_votes: Sequence[tuple[float, float]], prior: float = 0.1,
                  rounds: int = 200) -> tuple[float, np.ndarray, dict[str, float]]:
    """EM for each labeller's chances of voting bad, good or nothing per class; the share of bad is given.

    The share is not estimated: most documents have no vote, and those that have one say nothing about the others.

    ``bad_votes`` has a starting chance (in good, in bad documents) of a bad vote for each labeller; good
    votes start as the mirror image. Votes are taken as independent given the class; abstaining says nothing, so a
    document that only one labeller speaks on is judged by that vote and the prior. Returns the prior of bad, the table [class, labeller, vote] and the posterior of bad per pattern.
    """
    keys = list(patterns)
    if not keys:
        empty = np.zeros((2, 0, 3))
        return prior, empty, Posteriors({}, prior, empty)
    n = np.array([patterns[k] for k in keys], dtype=np.float64)
    one_hot = np.eye(3)[np.array([["-01".index(x) for x in k] for k in keys])]
    spoken = one_hot[:, :, 1:]
    weight = np.array([math.log(b / g) for g, b in bad_votes])
    odds = math.log(prior / (1 - prior)) + (spoken[:, :, 1] - spoken[:, :, 0]) @ weight
    post = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
    tables = np.zeros((2, len(bad_votes), 3))
    for _ in range(rounds):
        for k, weight in enumerate((n * (1 - post), n * post)):
            counts = np.einsum("k,klv->lv", weight, one_hot) + 0.5
            tables[k] = counts / counts.sum(1, keepdims=True)
        told = np.log(tables[1, :, 1:] / tables[0, :, 1:])
        odds = math.log(prior / (1 - prior)) + np.einsum("klv,lv->k", spoken, told)
        fresh = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        moved = float(np.abs(fresh - post).max())
        post = fresh
        if moved < 1e-9:
            break
    return prior, tables, Posteriors(dict(zip(keys, post.tolist())), prior, tables)


class Posteriors(dict):
    """Posterior of bad per vote pattern; patterns that were not met are worked out from the fitted tables."""

    def __init__(self, known: dict[str, float], prior: float, tables: np.ndarray):
        super().__init__(known)
        self.prior, self.tables = prior, tables

    def __missing__(self, pattern: str) -> float:
        odds = math.log(self.prior / (1 - self.prior))
        for good, bad, vote in zip(self.tables[0], self.tables[1], pattern):
            if vote != "-":
                odds += math.log(bad["-01".index(vote)] / good["-01".index(vote)])
        self[pattern] = out = 1 / (1 + math.exp(-min(max(odds, -500.0), 500.0)))
        return out

    def __reduce__(self):
        return Posteriors, (dict(self), self.prior, self.tables)


class Scorer:
    """Logistic regression on hashed words (mean over the document) and dense strengths."""

    def __init__(self) -> None:
        self.words = np.zeros(1 << BITS, dtype=np.float32)
        self.dense = np.zeros(DENSE, dtype=np.float64)
        self.bias = 0.0

    def logits(self, slot: np.ndarray, offsets: np.ndarray, strong: np.ndarray) -> np.ndarray:
        """Of all texts of a batch at once."""
        n = np.diff(offsets)
        sums = np.concatenate(([0.0], np.cumsum(self.words[slot], dtype=np.float64)))
        return self.bias + strong @ self.dense + (sums[offsets[1:]] - sums[offsets[:-1]]) / np.sqrt(np.maximum(n, 1))

    def fit(self, rows: list[tuple[tuple[np.ndarray, np.ndarray], np.ndarray, float]], epochs: int = EPOCHS) -> Scorer:
        """AdaGrad on soft labels; both classes weigh the same in sum."""
        total = sum(y for *_, y in rows)
        heavy = (len(rows) - total) / max(total, 1.0) if rows else 1.0
        heavy = min(max(heavy, 0.05), 20.0)
        gw, gd, gb = np.full(1 << BITS, 1e-2, dtype=np.float32), np.full(DENSE, 1e-2), 1e-2
        for _ in range(epochs):
            for slot, strong, y in rows:
                own, times = slot
                total_words = max(int(times.sum()), 1)
                z = self.bias + float(self.dense @ strong) + float(self.words[own] @ times) / math.sqrt(total_words)
                p = 1 / (1 + math.exp(-max(min(z, 30.0), -30.0)))
                g = (1 - y) * p - heavy * y * (1 - p)
                if len(own):
                    each = (g / math.sqrt(total_words) * times).astype(np.float32)
                    gw[own] += each * each
                    self.words[own] -= np.float32(0.3) * each / np.sqrt(gw[own])
                gd += (g * strong) ** 2
                self.dense -= 0.3 * g * strong / np.sqrt(gd)
                gb += g * g
                self.bias -= 0.3 * g / math.sqrt(gb)
        return self


def _voted(docs: DataFrame, labels: DataFrame | None, doc_id: str, text: str) -> DataFrame:
    """A key of each document and its votes; the last vote of each kind is the annotators'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            q, a = [], []
            for t in utf8(batch.column("_text")):
                f = facts(t)
                q.append(votes(f, QUALITY_LABELLERS))
                a.append(votes(f, ABUSE_LABELLERS))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("_key"), pa.array(q, pa.string()), pa.array(a, pa.string())],
                names=["_id", "_key", "_q", "_a"])

    kind = docs.schema[doc_id].dataType.simpleString()
    told = docs.select(F.col(doc_id).alias("_id"), F.xxhash64(F.col(doc_id), F.col(text)).alias("_key"), F.col(text).alias("_text")).mapInArrow(
        run, f"_id {kind}, _key long, _q string, _a string")
    if labels is None:
        return told.select("_key", F.concat("_q", F.lit("-")).alias("quality_votes"), F.concat("_a", F.lit("-")).alias("abuse_votes"))
    own = labels.groupBy(F.col(doc_id).alias("_of")).agg(F.min("quality").alias("_good"), F.max("toxic").alias("_toxic"))

    def spoken(bad):
        return F.when(bad, "1").when(~bad, "0").otherwise("-")

    return told.join(own, F.col("_id") == F.col("_of"), "left").select(
        "_key", F.concat("_q", spoken(F.col("_good") == 0)).alias("quality_votes"), F.concat("_a", spoken(F.col("_toxic") == 1)).alias("abuse_votes"))


def train(docs: DataFrame, labels: DataFrame | None = None, rows: int = TRAIN_ROWS, doc_id: str = "doc_id",
          text: str = "text") -> tuple[Scorer, Scorer, dict, dict]:
    """Fit labellers on the vote patterns of all documents and both scorers on a bounded sample.

    The sample has about ``rows`` documents, those with the smallest hashes of id and text within
    each pattern's share, so rare patterns are represented; patterns are at most 3 ** labellers.
    """
    voted = stored(_voted(docs, labels, doc_id, text), "votes")
    counted = voted.groupBy("quality_votes", "abuse_votes").agg(F.count(F.lit(1)).alias("n")).collect()
    quality, abuse = {}, {}
    for r in counted:
        quality[r["quality_votes"]] = quality.get(r["quality_votes"], 0) + r["n"]
        abuse[r["abuse_votes"]] = abuse.get(r["abuse_votes"], 0) + r["n"]
    q_prior, _, q_post = fit_labellers(quality, [HEURISTIC] * len(QUALITY_LABELLERS) + [ANNOTATOR])
    a_prior, _, a_post = fit_labellers(abuse, [HEURISTIC] * len(ABUSE_LABELLERS) + [ANNOTATOR], 0.05)
    # Each pattern gives the same number of documents, or all it has; expected sizes bound the sample.
    share = max(1, rows // max(len(counted), 1))
    keys = [(r["quality_votes"], r["abuse_votes"], min(1.0, share / r["n"])) for r in counted]
    left = rows - sum(min(r["n"], share) for r in counted)
    total = sum(r["n"] for r in counted)
    extra = max(0, left) / max(total, 1)
    kept = docs.sparkSession.createDataFrame(
        [(a, b, min((1 << 63) - 1, int((min(1.0, p + extra) * 2 - 1) * ((1 << 63) - 1)))) for a, b, p in keys] or [("", "", 0)],
        "quality_votes string, abuse_votes string, _below long")
    sample = voted.join(F.broadcast(kept), ["quality_votes", "abuse_votes"]).filter("_key <= _below").select(
        "_key", "quality_votes", "abuse_votes").distinct()
    texts = docs.select(F.xxhash64(F.col(doc_id), F.col(text)).alias("_key"), F.col(text).alias("_text"))

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            given = utf8(batch.column("_text"))
            slot, offsets = features(given)
            own = [np.unique(slot[a:b], return_counts=True) for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_key"), batch.column("quality_votes"), batch.column("abuse_votes"),
                 pa.array([o[0] for o in own], pa.list_(pa.int32())), pa.array([o[1].astype(np.int32) for o in own], pa.list_(pa.int32())),
                 pa.array([dense(facts(t)) for t in given], pa.list_(pa.float64()))],
                names=["_key", "quality_votes", "abuse_votes", "slots", "times", "dense"])

    got = texts.join(sample, "_key").dropDuplicates(["_key"]).mapInArrow(
        described, "_key long, quality_votes string, abuse_votes string, slots array<int>, times array<int>, dense array<double>")
    examples = [(r["_key"], (np.array(r["slots"], dtype=np.int32), np.array(r["times"], dtype=np.float32)), np.array(r["dense"]),
                 q_post[r["quality_votes"]], a_post[r["abuse_votes"]]) for r in got.toLocalIterator()]  # about `rows` documents
    examples.sort(key=lambda e: e[0] * 0x9E3779B97F4A7C15 % (1 << 64))
    return (Scorer().fit([(s, d, _lift(q, q_prior)) for _, s, d, q, _ in examples]),
            Scorer().fit([(s, d, _lift(a, a_prior)) for _, s, d, _, a in examples]), q_post, a_post)


def _lift(posterior: float, prior: float) -> float:
    """Training label: what the votes add to the prior, so that a document nobody speaks on counts as good."""
    return max(0.0, (posterior - prior) / (1 - prior))


def classify(docs: DataFrame, labels: DataFrame | None = None, keep: Sequence[str] | None = None, rows: int = TRAIN_ROWS,
             cutoff: float = 0.5, sure: Sequence[float] = (0.95, 0.5), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Add ``bad_posterior``, ``abuse_posterior`` (of the heuristic votes), ``bad_score``, ``abuse_score``
    (of the scorers) and ``kept`` to documents. ``labels`` (id, quality, toxic) are optional.

    A document is turned away if a scorer lies above ``cutoff`` and the posterior of its votes does so
    too, or if the scorer lies above ``sure`` (of quality, of abuse). Null and empty texts have no words and no votes. Repeated rows are judged
    alike; an empty table stays empty; columns named like the added ones are replaced. ``keep`` names
    the columns carried along (all by default).
    """
    added = ["bad_posterior", "abuse_posterior", "bad_score", "abuse_score", "kept"]
    carried = [c for c in (keep or docs.columns) if c not in added]
    bad, abuse, q_post, a_post = train(docs, labels, rows, doc_id, text)
    shared = docs.sparkSession.sparkContext.broadcast(  # two tables of 2**BITS weights and the patterns
        ((bad.words, bad.dense, bad.bias), (abuse.words, abuse.dense, abuse.bias), q_post, a_post))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = []
        for w, d, b in shared.value[:2]:
            model = Scorer()
            model.words, model.dense, model.bias = w, d, b
            models.append(model)
        for batch in slices(batches, "_text"):
            given = utf8(batch.column("_text"))
            known = [facts(t) for t in given]
            slot, offsets = features(given)
            strong = np.array([dense(f) for f in known]).reshape(-1, DENSE)
            score = [1 / (1 + np.exp(-np.clip(m.logits(slot, offsets, strong), -30, 30))) for m in models]
            post = [np.array([p[votes(f, v) + "-"] for f in known], dtype=np.float64)
                    for p, v in zip(shared.value[2:], (QUALITY_LABELLERS, ABUSE_LABELLERS))]
            gone = np.zeros(len(given), dtype=bool)
            for s, p, alone in zip(score, post, sure):
                gone |= ((s > cutoff) & (p > cutoff)) | (s > alone)
            columns = [pa.array(c) for c in (*post, *score, ~gone)]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), *columns], names=["_row", *added])

    # The row is packed, so that no column of the table clashes with one of the job's own.
    given = docs.select(F.struct(*carried).alias("_row"), F.col(text).alias("_text"))
    schema = extended(given.select("_row").schema, "bad_posterior double, abuse_posterior double, bad_score double, abuse_score double, kept boolean")
    return given.mapInArrow(run, schema).select("_row.*", *added)
