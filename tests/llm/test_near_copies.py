"""Large groups of near copies in the Jaccard join: settled by pivots, counted exactly."""

import random

from pyspark.sql import functions as F

from tierloom.llm import jaccard_join


def shingle_set(text):
    w = text.lower().split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def near_copies(seed, n, words=60):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10_000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.choice([0, 1, 1, 2])):
            w[rng.randrange(words)] = f"x{rng.randrange(10_000)}"
        out.append(" ".join(w))
    return out


def test_all_links_of_a_large_group(spark):
    texts = near_copies(1, 500) + near_copies(2, 120) + [" ".join(f"z{i}_{k}" for k in range(30)) for i in range(100)]
    rows = list(enumerate(texts))
    sets = {i: shingle_set(t) for i, t in rows}
    first = {}
    for i, t in rows:
        first.setdefault(frozenset(sets[i]), i)
    own = {i: first[frozenset(sets[i])] for i, _ in rows}
    classes = sorted(set(own.values()))
    links, parent = dict.fromkeys(classes, 0), {c: c for c in classes}

    def root(c):
        while parent[c] != c:
            c = parent[c]
        return c

    for x, a in enumerate(classes):
        for b in classes[x + 1:]:
            both = len(sets[a] & sets[b])
            if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                links[a] += 1
                links[b] += 1
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["id"]: r for r in jaccard_join.similar(df, small=50, block=64).collect()}
    assert all(got[i]["class_id"] == own[i] for i, _ in rows)
    assert all(got[i]["n_links"] == links[own[i]] for i, _ in rows)
    assert all(got[i]["group_id"] == root(own[i]) for i, _ in rows)


def test_rows_of_a_search_grow_with_members(spark, monkeypatch):
    """Nodes of near copies are not split on and on: twice the members, about twice the rows."""
    sizes = []
    for n in (400, 800):
        texts = near_copies(3, n)
        made = []
        real = jaccard_join.stored
        monkeypatch.setattr(jaccard_join, "stored", lambda df, name="stage": (lambda out: (made.append((name, out.count())), out)[1])(real(df, name)))
        base = real(jaccard_join.sketched(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text"), "sketches")
        reps = base.groupBy("class").agg(F.min_by("sketch", "key").alias("sketch"))
        jaccard_join.candidate_edges(reps, 0.8, 0.65, 0, small=50).count()
        monkeypatch.setattr(jaccard_join, "stored", real)
        sizes.append(sum(count for name, count in made if name == "nodes"))
    assert sizes[1] < 3 * sizes[0]


def test_later_rounds_follow_new_links_only(spark, monkeypatch):
    """A round that finds one new link does not follow the known links of a large group again."""
    star = [(0, i) for i in range(1, 51)] + [(100, 101)]
    rounds = [star, [(1, i) for i in range(2, 51)] + [(50, 100), (49, 101), (200, 201)], star]
    counts, real = [], jaccard_join.components
    monkeypatch.setattr(jaccard_join, "candidate_edges", lambda reps, threshold, least, first, *more: spark.createDataFrame(rounds[first // 8], "a long, b long"))
    monkeypatch.setattr(jaccard_join, "components", lambda edges: (counts.append(edges.count()), real(edges))[1])
    got = {r["v"]: r["label"] for r in jaccard_join.connected(None, 0.8, 0.99).collect()}
    assert got == {**{i: 0 for i in [*range(51), 100, 101]}, 200: 200, 201: 200}
    assert counts == [51, 2]
