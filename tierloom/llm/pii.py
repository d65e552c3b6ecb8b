"""Information-theoretic sanitisation of personal data.

Addresses, card and phone numbers are found by pattern and are the protected entities. Beyond
them, a term anywhere in a document reveals an entity when seeing the term makes the entity far more
likely than it is in the corpus: the disclosure of term t about entity e is
``log2(P(e | t) / P(e))`` over documents, and the chance itself is ``P(e | t)``. Mail hosts, networks, number
prefixes and the four kinds count as entities too. Terms above both thresholds, with
enough separate contexts behind them, are sensitive in the documents that hold the entity.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierloom.llm.common import extended, slices, stored

# The patterns of the base entities.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
KINDS = ("email", "ip", "card", "phone", "term")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGE = ".,;:!?\"'()[]{}<>|*#$%&"

#: Any text with an address of a network or a card number matches; for the filter before the patterns.
NUMBERS = r"[0-9](?:\.[0-9]+\.[0-9]+\.[0-9]|(?:[ -]?[0-9]){13})"

#: Words on either side of a mention that make up its surroundings.
NEAR = 4
#: Leading digits that numbers of one issuer or area share.
PREFIX = 6
#: Keys of texts that are broadcast at most (some 64 MB).
MOST_KEYS = 2_000_000

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the four kinds, leftmost and non-overlapping per kind; matches that fail the check are dropped."""
    found: list[Span] = []
    if "@" in text:
        found += [(m.start(), m.end(), "email") for m in EMAIL.finditer(text)]
    if DIGIT.search(text):
        found += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if all(_small(x) for x in m.group().split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m.group().replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    found.append((m.start(), m.end(), "card"))
        if "+" in text:
            found += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m.group()) <= 15]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def _small(part: str) -> bool:
    stripped = part.lstrip("0")
    return len(stripped) <= 3 and int(stripped or "0") <= 255


def told(spans: Sequence[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def general(kind: str, value: str) -> tuple[str, str, str]:
    """An entity, what it has in common with its like (mail host, network, number prefix), and its kind."""
    if kind == "email":
        value = value.lower()
        return f"email:{value}", "email:@" + value.rsplit("@", 1)[1], "email"
    if kind == "ip":
        numbers = [str(int(x)) for x in value.split(".")]
        return "ip:" + ".".join(numbers), "ip:" + ".".join(numbers[:3]) + ".", "ip"
    digits = "".join(c for c in value if "0" <= c <= "9")
    return f"{kind}:{digits}", f"{kind}:{digits[:PREFIX]}-", kind


def _term(word: str) -> str:
    """A word without its punctuation, lower case; empty if nothing is left."""
    return word.strip(EDGE).lower()


def _around(words: Sequence[str], before: int, after: int) -> int:
    """A hash of the NEAR words on either side of a mention: the first ``before`` words precede it, those from ``after`` follow."""
    near = [*words[max(0, before - NEAR):before], "", *words[after:after + NEAR]]
    return int.from_bytes(hashlib.blake2b(" ".join(near).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _maybe(text: str) -> Column:
    """Whether a text can hold an entity: true for each that does, never null. Plain searches go before the patterns."""
    t = F.col(text)
    return F.coalesce(t.contains("@") | (t.contains("+") & t.rlike(r"\+[0-9]")) | t.rlike(NUMBERS), F.lit(False))


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(F.xxhash64(text).alias("_key"), F.col(text).alias("_text"))


class Keys(NamedTuple):
    """Of the distinct texts: their number, the keys that stand in several rows (``copied``), and those of texts
    that can hold an entity (``maybe``). None stands for more than MOST_KEYS."""

    n: int
    copied: DataFrame | None
    maybe: DataFrame | None


def _keys(docs: DataFrame, text: str) -> Keys:
    keys = stored(_keyed(docs, text).groupBy("_key").agg((F.count(F.lit(1)) > 1).alias("copied"), F.max(_maybe("_text")).alias("maybe")), "keys")
    n, *counts = keys.agg(F.count(F.lit(1)), F.count_if("copied"), F.count_if("maybe")).first()
    return Keys(n, *(F.broadcast(keys.filter(c).select("_key")) if k <= MOST_KEYS else None for c, k in zip(("copied", "maybe"), counts)))


def _one_of_each(texts: DataFrame, copied: DataFrame | None) -> DataFrame:
    """Each distinct text once. Only texts that stand in several rows are shuffled, all others stay where they are read."""
    if copied is None:
        return stored(texts.dropDuplicates(["_key"]), "texts")
    return texts.join(copied, "_key", "left_anti").unionByName(stored(texts.join(copied, "_key", "left_semi").dropDuplicates(["_key"]), "copies"))


def _apart(texts: DataFrame, maybe: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Rows whose text can hold an entity, and all others."""
    if maybe is None:
        return texts.filter(_maybe("_text")), texts.filter(~_maybe("_text"))
    return texts.join(maybe, "_key", "left_semi"), texts.join(maybe, "_key", "left_anti")


def _entity_texts(texts: DataFrame) -> DataFrame:
    """Texts that mention an entity: ``_key``, each entity with its surroundings, and all terms outside of mentions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            keys, entities, terms = [], [], []
            for key, t in zip(batch.column("_key").to_pylist(), batch.column("_text").to_pylist()):
                spans = base_spans(t)
                if not spans:
                    continue
                words = [_term(w) for w in WORD.findall(t)]
                starts, ends = zip(*(m.span() for m in WORD.finditer(t)))
                own: dict[str, set[int]] = {}
                free: set[str] = set()
                reach = 0
                for a, b, kind in spans:
                    before, after = bisect_right(ends, a), bisect_left(starts, b)
                    around = _around(words, before, after)
                    for entity in general(kind, t[a:b]):
                        own.setdefault(entity, set()).add(around)
                    free.update(words[reach:before])
                    reach = max(reach, after)
                free.update(words[reach:])
                free.discard("")
                keys.append(key)
                entities.append([{"entity": e, "arounds": sorted(x)} for e, x in own.items()])
                terms.append(list(free))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(entities, pa.list_(pa.struct([("entity", pa.string()), ("arounds", pa.list_(pa.int64()))]))),
                 pa.array(terms, pa.list_(pa.string()))], names=["_key", "entities", "terms"])

    return texts.mapInArrow(run, "_key long, entities array<struct<entity: string, arounds: array<long>>>, terms array<string>")


def _terms(words: pa.Array) -> pa.Array:
    """``_term`` of every word."""
    cores = pc.utf8_trim(words, EDGE)
    other = pc.invert(pc.string_is_ascii(cores))
    lowered = pa.array([x.lower() for x in cores.filter(other).to_pylist()], cores.type)
    return pc.replace_with_mask(pc.ascii_lower(cores), other, lowered)


def _texts_per_term(texts: DataFrame) -> DataFrame:
    """``term`` and ``of_term``, the number of the given texts that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            split = pc.ascii_split_whitespace(batch.column("_text"))
            words = split.flatten().dictionary_encode()
            terms = _terms(words.dictionary).dictionary_encode()  # words that differ in case or punctuation are one term
            term = terms.indices.to_numpy()[words.indices.to_numpy()]
            # Sorted by text and term, a term counts where it differs from the one before.
            held = np.sort(pc.list_parent_indices(split).to_numpy().astype(np.int64) << 32 | term)
            first = np.diff(held, prepend=-1) != 0
            n = np.bincount(held[first] & 0xFFFFFFFF, minlength=len(terms.dictionary))
            yield pa.RecordBatch.from_arrays([terms.dictionary, pa.array(n, pa.int64())], names=["term", "n"])

    return texts.select("_text").mapInArrow(run, "term string, n long").filter("term <> ''").groupBy("term").agg(F.sum("n").alias("of_term"))


def _risky(docs: DataFrame, keys: Keys, bits: float, chance: float, contexts: int, text: str) -> tuple[DataFrame, DataFrame] | None:
    """The pairs above the thresholds, and every (text, entity, term) that can be one; nothing if no entity is rare enough."""
    n = keys.n
    texts = _one_of_each(_keyed(docs, text), keys.copied)
    held = stored(_entity_texts(_apart(texts, keys.maybe)[0]), "mentions")
    per_text = held.select("_key", F.explode("entities").alias("e")).select("_key", "e.*")
    of_entity = per_text.groupBy("entity").agg(F.count(F.lit(1)).alias("of_entity"))
    # A chance is at most one, so entities of more texts cannot reach the bits.
    entities = stored(of_entity.filter(F.col("of_entity") <= F.lit(n * 2.0 ** -bits * (1 + 1e-9))), "entities")
    most = entities.agg(F.max("of_entity")).first()[0]
    if most is None:
        return None
    surroundings = per_text.select("entity", F.explode("arounds").alias("around")).distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("of_around"))
    named = per_text.join(entities.join(surroundings, "entity"), "entity")
    # A term of more texts than an entity has, over the chance, cannot reach the chance for it.
    rare = _texts_per_term(texts).filter(F.col("of_term") * chance <= most * (1 + 1e-9))
    terms = held.select("_key", F.explode("terms").alias("term")).join(rare, "term")
    pairs = stored(terms.join(named, "_key").filter(F.col("of_term") * chance <= F.col("of_entity") * (1 + 1e-9)), "pairs")
    p = F.count(F.lit(1)) / F.first("of_term")
    strong = stored(
        pairs.groupBy("entity", "term").agg(p.alias("chance"), F.log2(p * n / F.first("of_entity")).alias("bits"), F.first("of_around").alias("of_around"))
        .filter((F.col("chance") >= chance) & (F.col("bits") >= bits)), "strong")
    asked = strong.filter(F.col("of_around") >= contexts)
    enough = (
        pairs.join(asked.select("entity", "term"), ["entity", "term"]).select("entity", "term", F.explode("arounds").alias("around")).distinct()
        .groupBy("entity", "term").agg(F.count(F.lit(1)).alias("contexts")).filter(F.col("contexts") >= contexts)
    )
    columns = ["entity", "term", "chance", "bits"]
    risky = strong.filter(F.col("of_around") < contexts).select(*columns).unionByName(
        asked.join(enough.select("entity", "term"), ["entity", "term"], "left_semi").select(*columns))
    return risky, pairs


def disclosures(docs: DataFrame, bits: float = 6.0, chance: float = 0.5, contexts: int = 3, text: str = "text") -> DataFrame:
    """``entity``, ``term``, ``chance`` and ``bits`` of the pairs above the thresholds.

    Chances are counted over distinct texts, so plain copies prove nothing, and over all terms of a text.
    A term of an entity that stands in ``contexts`` different surroundings or more needs as many of them;
    an entity with fewer sets no such bar.
    """
    found = _risky(docs, _keys(docs, text), bits, chance, contexts, text)
    if found is None:
        return docs.sparkSession.createDataFrame([], "entity string, term string, chance double, bits double")
    return found[0]


def find(docs: DataFrame, keep: Sequence[str] | None = None, doc_id: str = "doc_id", text: str = "text", bits: float = 6.0,
         chance: float = 0.5, contexts: int = 3, cleaned: str | None = None) -> DataFrame:
    """Add counts per kind, ``base_sha256`` and ``spans`` to documents; ``cleaned`` names a column for the
    sanitised text, in which entities give way to their kind in angle brackets and revealing terms to ``<term>``.

    Offsets are code points, end exclusive. A null text counts as empty and stays null when cleaned.
    Texts without an entity are never changed. Repeated rows are treated alike and an empty table
    stays empty; columns named like the added ones are replaced. The table is read several times and has to be
    the same each time.
    """
    added = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    carried = [c for c in (keep or docs.columns) if c not in added]
    keys = _keys(docs, text)
    found = _risky(docs, keys, bits, chance, contexts, text)
    out = [c for c in carried if c != cleaned] + ([cleaned] if cleaned else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            rows, fresh = [], []
            for t, terms in zip(batch.column("_text").to_pylist(), batch.column("_terms").to_pylist()):
                spans = base_spans(t or "")
                every = spans + _term_spans(t or "", spans, set(terms or ()))
                every.sort(key=lambda s: (s[0], KINDS.index(s[2])))
                counts = [sum(k == kind for *_, k in spans) for kind in KINDS[:4]]
                rows.append((*counts, hashlib.sha256(told(spans).encode()).hexdigest(), told(every)))
                fresh.append(replaced(t, every) if cleaned else None)
            columns = [pa.array(c, pa.int64()) for c in list(zip(*rows))[:4]] + [pa.array([r[i] for r in rows], pa.string()) for i in (4, 5)]
            own = [batch.column("_row")] + ([pa.array(fresh, pa.string())] if cleaned else [])
            yield pa.RecordBatch.from_arrays(own + columns, names=["_row", *(["_cleaned"] if cleaned else []), *added])

    # The row is packed, so that no column of the table clashes with one of the job's own.
    kept = [c for c in carried if c != cleaned]
    given = docs.select(F.struct(*(kept or [F.lit(0)])).alias("_row"), F.col(text).alias("_text"), F.xxhash64(text).alias("_key"))
    schema = extended(given.select("_row").schema, ("_cleaned string, " if cleaned else "")
                      + "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
    shown = [F.col("_cleaned").alias(cleaned) if c == cleaned else F.col(f"_row.`{c}`").alias(c) for c in out]
    maybe, rest = _apart(given, keys.maybe)
    if found is None:
        maybe = maybe.withColumn("_terms", F.lit(None).cast("array<string>"))
    else:
        risky, pairs = found
        # Revealing terms of a text: the pairs that it holds.
        per_text = pairs.select("_key", "entity", "term").join(risky, ["entity", "term"]).groupBy("_key").agg(F.collect_set("term").alias("_terms"))
        maybe = maybe.join(per_text, "_key", "left")
    # Texts without an entity need no look: they have no spans and stay as they are.
    plain = rest.select("_row", *([F.col("_text").alias("_cleaned")] if cleaned else []), *(F.lit(0).cast("long").alias(c) for c in added[:4]),
                        F.lit(hashlib.sha256(b"").hexdigest()).alias("base_sha256"), F.lit("").alias("spans"))
    return maybe.drop("_key").mapInArrow(run, schema).unionByName(plain).select(*shown, *added)


def _term_spans(text: str, spans: Sequence[Span], terms: set[str]) -> list[Span]:
    """The given terms where they touch no span; spans are in order of their starts."""
    found: list[Span] = []
    i, reach = 0, 0
    for m in WORD.finditer(text) if terms else ():
        if _term(m.group()) not in terms:
            continue
        while i < len(spans) and spans[i][0] < m.end():
            reach = max(reach, spans[i][1])
            i += 1
        if reach <= m.start():
            core = m.group().strip(EDGE)
            a = m.start() + m.group().index(core)
            found.append((a, a + len(core), "term"))
    return found


def replaced(text: str | None, spans: Sequence[Span]) -> str | None:
    """The text with each span (merged where they overlap) replaced by the kind of its first part."""
    if text is None:
        return None
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join(out) + text[at:]
