"""Resampling, Merkle manifest and exact duplicates against brute force, on tables with nulls, ties, repeated rows and clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tierloom.llm import exact_dedup, merkle, resampling
from tierloom.llm.common import in_order

DOCS = ("doc_id long, text string, lang string, source string, n_chars long, rank string, score string, root string, kept string, "
        "_text string, _doc string, _row long, digest string, shard int, place int, i int, n int, tree string")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    words = ["Ana", "ber", "CÉL", "dor", "e7", "ﬁx", "über", "ko"]
    texts = [None, "", "  \n\t", "a b", "a  b", "ab", "A b", "x" * 5, "word " * 30_000, "ſ K ß", "tab\tand\x0bline\x1ctext"]
    texts += [rng.choice([" ", "--", ". "]).join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(90)]
    texts += texts[20:40] + [t.replace(" ", "  ") for t in texts[30:50]]
    langs = ["en"] * 6 + ["de", None, "fr"]
    out = [(i, t, "solo" if i == 50 else langs[i % len(langs)], None if i % 7 == 0 else "s", len(t or "")) for i, t in enumerate(texts)]
    out += [out[25], out[25], (None, "null id", "en", None, None), (None, "null id", "en", None, None), (None, texts[8], None, "s", 3)]
    return [r + ("a", "b", "c", "d", "e", "f", 7, "g", 1, 2, 3, 4, "h") for r in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def features_of(text, runs):
    w = words_of(text)
    return [" ".join(w[i:i + n]) for n in range(runs[0], runs[1] + 1) for i in range(len(w) - n + 1)]


@pytest.mark.parametrize("runs", [(1, 1), (1, 2), (2, 3)])
def test_overlapped_scan_finds_every_run(rows, runs):
    scanners = [resampling.scanner(n) for n in range(runs[0], runs[1] + 1)]
    for r in rows:
        want = Counter(zlib.crc32(f.encode()) % 50 for f in features_of(r[1], runs))
        places, counts = resampling.bucket_counts((r[1] or "").encode(), scanners, 50)
        assert dict(zip(places, counts)) == want and places == sorted(places)


@pytest.mark.parametrize("runs", [(1, 1), (1, 2)])
def test_resampling_by_brute_force(spark, rows, docs, runs):
    target = spark.createDataFrame([("ana ber ko",), (None,), ("über über 7",)], "text string")
    buckets = 64
    got = resampling.resample(docs, target, 30, runs, buckets, 5).collect()
    s, t = Counter(), Counter()
    for counter, texts in ((s, [r[1] for r in rows]), (t, ["ana ber ko", None, "über über 7"])):
        for text in texts:
            counter.update(zlib.crc32(f.encode()) % buckets for f in features_of(text, runs))
    ns, nt = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (ns + buckets) / ((s[b] + 1) * (nt + buckets)))) for b in range(buckets)]
    want = []
    for r in rows:
        found = features_of(r[1], runs)
        weight = sum(gain[zlib.crc32(f.encode()) % buckets] for f in found)
        h = int(hashlib.sha256(f"2024:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        want.append((r[0], len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words_of(r[1])) >= 5))
    able = sorted((w for w in want if w[4]), key=lambda w: (-w[3], w[0] is None, w[0] or 0))
    drawn = able[:len(able) * 30 // 100]
    assert Counter((r["doc_id"], r["n_features"], r["weight"], r["score"]) for r in got) == Counter(w[:4] for w in want)
    ranked = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1))
    assert [(r["doc_id"], r["score"]) for r in ranked] == [(w[0], w[3]) for w in drawn]
    assert got[0]["_text"] == "e" and got[0]["_row"] == 7


def test_resampling_of_nothing(docs, none):
    assert resampling.resample(none, docs).count() == 0
    assert all(r["rank"] is None or r["weight"] is not None for r in resampling.resample(docs, none, keep=["doc_id"]).collect())


def test_places_of_hot_keys_and_repeated_rows(docs):
    placed = in_order(docs.select("lang", "doc_id", F.monotonically_increasing_id().alias("r")).filter("lang is not null"),
                      [F.col("lang"), F.col("doc_id").asc_nulls_first(), F.col("r")], ["lang"], "p", "all").collect()
    per = {}
    for r in placed:
        per.setdefault(r["lang"], []).append(r)
    for found in per.values():
        found.sort(key=lambda r: r["p"])
        assert [r["p"] for r in found] == list(range(len(found))) and {r["all"] for r in found} == {len(found)}
        ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in found]
        assert ids == sorted(ids)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def naive_manifest(rows, fanout):
    """Per row (in the order of the tree): id, leaf, subroot, root, siblings level by level."""
    def climb(digests):
        paths, at = [[] for _ in digests], list(range(len(digests)))
        while len(digests) > 1:
            for i, p in enumerate(paths):
                run = digests[at[i] // fanout * fanout:][:fanout]
                k = at[i] % fanout
                p.append(("".join(run[:k]), "".join(run[k + 1:])))
            digests = [sha("".join(digests[i:i + fanout])) for i in range(0, len(digests), fanout)]
            at = [a // fanout for a in at]
        return (digests[0] if digests else None), paths

    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((-1 if r[0] is None else r[0], leaf((r[0], r[3], r[2], r[4], r[1])), r))
    trees = []
    for lang in sorted(groups, key=lambda g: (g is not None, (g or "").encode())):
        found = sorted(groups[lang], key=lambda x: x[:2])
        top, paths = climb([x[1] for x in found])
        trees.append((found, top, paths))
    root, over = climb([t[1] for t in trees])
    out = []
    for (found, top, paths), upper in zip(trees, over):
        for (_, digest, r), path in zip(found, paths):
            out.append((r, digest, top, root, path + upper))
    return out


@pytest.mark.parametrize("fanout", [2, 3, 8])
def test_manifest_by_brute_force(docs, rows, fanout):
    got = merkle.check_forgeries(docs, fanout=fanout).collect()
    want = []
    for r, digest, top, root, path in naive_manifest(rows, fanout):
        text = r[1].translate(LOWER) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None else r[1]
        folded = leaf((r[0], r[3], r[2], r[4], text))
        for before, after in path:
            folded = sha(before + folded + after)
        want.append((r[0], digest, top, root, sha("".join(a + b for a, b in path)), folded, folded == root))
    assert Counter(tuple(r) for r in got) == Counter(want)
    assert any(not r["verified"] for r in got) and any(r["verified"] for r in got)


def test_manifest_of_few_rows(docs, none):
    assert merkle.check_forgeries(none).count() == 0
    one = docs.filter("doc_id = 3")
    row = merkle.check_forgeries(one).first()
    assert row["leaf"] == row["subroot"] == row["root"] and row["proof_sha256"] == sha("")
    built = merkle.build(docs, ["doc_id", "text"], fanout=4)
    assert built.nodes().filter("level = 0").count() == docs.count()


def test_any_change_is_noticed(docs):
    fields = ["doc_id", "source", "text"]
    built = merkle.build(docs.filter("doc_id is not null"), fields, carry={"_forged": merkle.leaf_of([F.col("doc_id"), F.col("source"), F.concat("text", F.lit(" "))])})
    proofs = merkle.verify(built.proofs(), "_forged")
    assert proofs.filter("verified and leaf <> _forged").count() == 0
    assert merkle.verify(built.proofs(), "leaf").filter("not verified").count() == 0


def test_cuckoo_filter_goes_in_out_and_grows():
    rng = random.Random(2)
    have, want = exact_dedup.CuckooFilter(1), Counter()
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(900)]
    sizes = set()
    for _ in range(6000):
        key, n = rng.choice(keys), rng.choice([1, 1, 2, -1, -2])
        assert have.add(key, n) == want[key]
        want[key] = max(want[key] + n, 0)
        sizes.add(have.bins)
    assert len(sizes) > 4 and all(have.live(k) == want[k] for k in keys)
    dumped = have.dump()
    assert {d[0]: d[1] for d in dumped} == {k: n for k, n in want.items() if n}
    again = exact_dedup.CuckooFilter.load([d[0] for d in dumped], [d[1] for d in dumped], [d[2] for d in dumped], have.bins)
    assert all(again.live(k) == want[k] for k in keys)


def test_fingerprints_that_collide_are_told_apart():
    have = exact_dedup.CuckooFilter(4)
    base = hashlib.sha256(b"x").digest()
    twins = [bytes([i]) + base[1:] for i in range(9)]  # equal fingerprints and bins: more than both bins can hold
    for i, twin in enumerate(twins[:8]):
        assert have.find(twin) < 0 and have.add(twin, 1) == 0
    assert all(have.live(t) == 1 for t in twins[:8]) and have.live(twins[8]) == 0
    have.add(twins[3], -1)
    assert [have.live(t) for t in twins[:8]] == [1, 1, 1, 0, 1, 1, 1, 1]


def naive_groups(rows):
    groups = {}
    for r in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r[1] or ""), []).append(r)
    return groups


def test_exact_duplicates_by_brute_force(docs, rows, none):
    got = exact_dedup.deduplicate(docs).collect()
    want, kept = Counter(), {}
    for text, members in naive_groups(rows).items():
        best = min(members, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))
        for r in members:
            want[(r[0], best[0], len(members), sha(text))] += 1
        kept[sha(text)] = best[0]
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    stays = [(r["text_sha256"], r["doc_id"]) for r in got if r["kept"]]
    assert len(stays) == len(kept) and dict(stays) == kept
    assert got[0]["shard"] == 1 and got[0]["digest"] == "g"
    assert exact_dedup.deduplicate(none).count() == 0


def test_many_shards_and_blocks_agree(docs, monkeypatch):
    whole = Counter(map(tuple, exact_dedup.deduplicate(docs, keep=["doc_id"]).drop("kept").collect()))
    monkeypatch.setattr(exact_dedup, "SHARD_ROWS", 7)
    monkeypatch.setattr(exact_dedup, "BLOCK_ROWS", 3)
    assert Counter(map(tuple, exact_dedup.deduplicate(docs, keep=["doc_id"]).drop("kept").collect())) == whole


def test_index_lives_on(spark, docs, rows):
    index, first = exact_dedup.seen(exact_dedup.Index.empty(spark, 10), docs.filter("doc_id < 60"))
    texts = {re.sub(r"[\x20\x09-\x0D]", "", r[1] or "") for r in rows if r[0] is not None and r[0] < 60}
    n = sum(1 for r in rows if r[0] is not None and r[0] < 60)
    assert first.filter("not seen").count() == len(texts) and first.count() == n
    index, second = exact_dedup.seen(index, docs.filter("doc_id >= 60"))
    for r in second.collect():
        text = re.sub(r"[\x20\x09-\x0D]", "", next(x[1] for x in rows if x[0] == r["doc_id"]) or "")
        assert not (text in texts and not r["seen"])
    index = exact_dedup.forget(index, docs.filter("doc_id < 60"))
    index = exact_dedup.forget(index, docs.filter("doc_id >= 60"))
    assert index.table.count() == 0
    _, third = exact_dedup.seen(index, docs.filter("doc_id = 12"))
    assert [r["seen"] for r in third.collect()] == [False]
