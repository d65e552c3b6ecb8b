"""Quality rules whose cutoffs carry a statistical guarantee.

Each rule compares one text measure with a cutoff. Labelled documents are the holdout: for every
stratum and rule, cutoffs are tried from the mildest to the strictest, and a cutoff is certified while
the exact binomial test rejects "this rule turns away more than ``risk`` of the good documents". Within
a stratum and rule the tests form a fixed sequence, which stops at the first failure, and the level is
divided by the number of strata and rules (Bonferroni). With probability ``1 - delta`` no rule of
any stratum exceeds its risk, and all rules together turn away at most ``risk`` times the number of rules.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierloom.llm.common import WHITE, slices, stored, utf8

SYMBOLS = b"#*$%&|<>"
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
NEVER = 1 << 30


@dataclass(frozen=True)
class Rule:
    """Rejects where ``measure`` lies beyond the cutoff; ``grid`` runs from mild to strict."""

    name: str
    above: bool
    grid: tuple[float, ...]


#: Ratios above the cutoff are rejected, word counts below it.
RULES = (
    Rule("symbols_per_char", True, tuple(round(0.5 - 0.01 * k, 2) for k in range(50))),
    Rule("repeat_share", True, tuple(round(1.0 - 0.02 * k, 2) for k in range(50))),
    Rule("dup_lines_per_word", True, tuple(round(0.25 - 0.005 * k, 3) for k in range(50))),
    Rule("chars_per_word_high", True, tuple(40.0 - k for k in range(38))),
    Rule("chars_per_word_low", False, tuple(round(0.25 * k, 2) for k in range(4, 24))),
)


def measure(text: bytes) -> tuple[int, int, int, int, int]:
    """The five counts of one text (UTF-8)."""
    words = text.split()
    n = len(words)
    if not n:
        return 0, 0, len(text) - len(text.translate(None, SYMBOLS)), 0, 0
    solid = text.translate(None, WHITE)
    chars = len(solid.decode("utf-8", "surrogatepass"))
    symbols = len(solid) - len(solid.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.split()] if b"\n" in text else []
    return n, chars, symbols, len(lines) - len(set(lines)), _repeated(words)


def _repeated(words: list[bytes]) -> int:
    """Words that lie in a three-word window found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    a = np.array([ids.setdefault(w, len(ids)) for w in words], dtype=np.int64)
    size = len(ids)
    if size == n:
        return 0
    pair = a[:-1] * size + a[1:]
    if size > 1 << 20:
        pair = np.unique(pair, return_inverse=True)[1]
    triple = pair[:-1] * size + a[2:]
    order = np.argsort(triple, kind="stable")
    ranked = triple[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(n - 2, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, dtype=bool)
    for k in range(3):
        covered[k:n - 2 + k] |= twice
    return int(covered.sum())


def measures(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns and the five counts; a null text has no words."""
    names = [f.split()[0] for f in MEASURES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            rows = [measure(t) for t in utf8(batch.column("_text"))]
            counts = [pa.array(c, pa.int64()) for c in zip(*rows)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep] + counts, names=[*keep, *names])

    given = docs.select(*keep, F.col(text).alias("_text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema), MEASURES])
    return given.mapInArrow(run, schema)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def value_of(rule: Rule) -> Column:
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return {
        "symbols_per_char": F.col("n_symbols") / chars, "repeat_share": F.col("n_repeat_words") / words,
        "dup_lines_per_word": F.col("n_dup_lines") / words,
        "chars_per_word_high": F.col("word_chars") / words, "chars_per_word_low": F.col("word_chars") / words,
    }[rule.name]


def first_rejecting(rule: Rule) -> Column:
    """Index of the first cutoff of the grid that rejects the document; NEVER if none does."""
    grid = F.array(*[F.lit(float(x)) for x in rule.grid])
    v = value_of(rule)
    beyond = F.filter(grid, (lambda c: v > c) if rule.above else (lambda c: v < c))
    # The grid is monotone: the cutoffs that reject are its tail.
    return F.when(F.size(beyond) > 0, F.lit(len(rule.grid)) - F.size(beyond)).otherwise(NEVER)


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Bin(n, p), exactly: terms summed downwards from the largest."""
    if k >= n:
        return 1.0
    top = min(k, int(p * (n + 1)))
    log_term = (math.lgamma(n + 1) - math.lgamma(top + 1) - math.lgamma(n - top + 1)
                + top * math.log(p) + (n - top) * math.log1p(-p))
    term = peak = math.exp(log_term)
    total = term
    for i in range(top, 0, -1):
        term *= i / (n - i + 1) * (1 - p) / p
        total += term
        if term < total * 1e-17:
            break
    term = peak
    for i in range(top + 1, k + 1):
        term *= (n - i + 1) / i * p / (1 - p)
        total += term
        if term < total * 1e-17:
            break
    return min(total, 1.0)


def certify(hits: pd.DataFrame, level: float, risk: float, length: int) -> int:
    """Index of the strictest certified cutoff, -1 if none. ``hits``: idx (first rejecting), n."""
    total = int(hits["n"].sum())
    turned = np.zeros(length, dtype=np.int64)
    for idx, n in zip(hits["idx"], hits["n"]):
        if idx < length:
            turned[int(idx):] += int(n)
    best = -1
    for i in range(length):
        if not total or binomial_cdf(int(turned[i]), total, risk) > level:
            break
        best = i
    return best


def cutoffs(measured: DataFrame, labels: DataFrame, risk: float = 0.01, delta: float = 0.05, stratum: str = "lang",
            doc_id: str = "doc_id", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``stratum``, ``rule``, ``best`` (index of the certified cutoff, -1 for none).

    Good documents are those whose label rows all say quality 1. All labelled documents count; what
    is grouped are counts per stratum, rule and cutoff, at most the length of a grid each.
    """
    good = labels.groupBy(F.col(doc_id).alias("_id")).agg(F.min("quality").alias("_q")).filter("_q = 1")
    # The base rule has turned its documents away already; what is held to account is what it leaves.
    held = measured.filter(~base_failed()).join(good, F.col(doc_id) == F.col("_id"))
    index = F.array(*[F.struct(F.lit(i).alias("rule"), first_rejecting(r).cast("int").alias("idx")) for i, r in enumerate(rules)])
    counts = (
        held.select(F.col(stratum).alias("stratum"), F.inline(index))
        .groupBy("stratum", "rule", "idx").agg(F.count(F.lit(1)).alias("n"))
    )
    strata = measured.select(F.col(stratum)).distinct().count()
    level = delta / max(1, strata * len(rules))

    def pick(key, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"stratum": [key[0]], "rule": [key[1]], "best": [certify(pdf, level, risk, len(rules[key[1]].grid))]})

    return counts.groupBy("stratum", "rule").applyInPandas(pick, "stratum string, rule int, best int")


def judge(docs: DataFrame, labels: DataFrame, keep: list[str], risk: float = 0.01, delta: float = 0.05,
          stratum: str = "lang", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts, ``base_failed``, ``rejected_by`` (names of certified rules) and ``kept`` per document.

    Null or empty texts have no words and fail the base rule; a stratum without enough good labels has no
    certified cutoff and turns nothing else away; null strata form a stratum of their own; repeated
    rows are judged alike, and repeated label rows count once. ``keep`` names the columns carried along.
    """
    names = [f.split()[0] for f in MEASURES.split(", ")]
    carried = list(dict.fromkeys([doc_id, stratum, *keep]))
    # Counts are small; written once so that every text is read once.
    measured = stored(measures(docs.drop(*names, "base_failed", "kept", "rejected_by"), carried, text), "measures")
    chosen = cutoffs(measured, labels, risk, delta, stratum, doc_id)
    per_stratum = chosen.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "best"))).alias("_best"))
    told = [F.when(first_rejecting(r) <= F.col("_best")[F.lit(i)], F.lit(r.name)) for i, r in enumerate(RULES)]
    rejected = F.array_compact(F.array(*told))
    return (
        measured.join(per_stratum, F.col(stratum).eqNullSafe(F.col("stratum")), "left")
        .withColumn("base_failed", base_failed()).withColumn("rejected_by", F.array_join(rejected, ","))
        .withColumn("kept", ~F.col("base_failed") & (F.col("rejected_by") == ""))
        .select(*keep, *names, "base_failed", "kept", "rejected_by")
    )
