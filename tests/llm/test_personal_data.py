"""Which texts op7 shuffles and hands to Python, and its counts of texts per term."""

from collections import Counter

import pyarrow as pa

from tierloom.llm import pii

WORDS = ["Plain", "plain,", "(PLAIN)", "", "...", "İstanbul", "ΟΔΟΣ", "Straße!", "ÉTÉ.", "«Été»", "no break", " wide", "a-b", "x\x1fy", "中文。", "$5#"]
ENTITIES = ["a@b.example", "no @ host", "+49 30 1234567", "1 + 1", "10.0.0.1", "1.2.3", "4111 1111 1111 1111", "4111-1111-1111-1", "none at all", "", None]


def plan_of(df, which):
    return getattr(df._jdf.queryExecution(), which)().toString()


def test_texts_without_an_entity_do_not_reach_python(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(ENTITIES)], "doc_id long, text string")
    for found in (pii.find(docs), pii.find(docs, cleaned="text"), pii.find(docs, bits=0.0)):
        plan = plan_of(found, "optimizedPlan")
        assert plan.count("MapInArrow") == 1 and plan.index("Union") < plan.index("MapInArrow")
        assert {r["doc_id"] for r in found.filter("spans = ''").collect()} == {k for k, t in enumerate(ENTITIES) if not pii.base_spans(t or "")}
    maybe = [r[0] for r in docs.orderBy("doc_id").select(pii._maybe("text")).collect()]
    assert all(m for m, t in zip(maybe, ENTITIES) if pii.base_spans(t or "")) and maybe[-3:] == [False] * 3


def test_only_copies_are_shuffled(spark):
    rows = [f"text {k}" for k in range(50)] + ["copy a", "copy b", None] * 4
    docs = spark.createDataFrame([(t,) for t in rows], "text string").repartition(5)
    keys, texts = pii._keys(docs, "text"), pii._keyed(docs, "text")
    assert (keys.n, keys.copied.count()) == (len(set(rows)), 3)
    for copied in (keys.copied, None):
        assert Counter(r["_text"] for r in pii._one_of_each(texts, copied).collect()) == Counter(set(rows))
    plan = plan_of(pii._one_of_each(texts, keys.copied), "optimizedPlan")
    assert "LeftAnti" in plan and "Aggregate" not in plan  # the copies, put together before, are read


def test_patterns_are_looked_for_once(spark, monkeypatch):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(ENTITIES * 2)], "doc_id long, text string")
    found = pii.find(docs, bits=0.0)
    assert "RLIKE" not in plan_of(found, "optimizedPlan")
    want = Counter(found.collect())
    monkeypatch.setattr(pii, "MOST_KEYS", 1)
    many = pii.find(docs, bits=0.0)
    assert "RLIKE" in plan_of(many, "optimizedPlan") and Counter(many.collect()) == want


def test_texts_per_term(spark):
    assert pii._terms(pa.array(WORDS)).to_pylist() == [pii._term(w) for w in WORDS]
    assert pii._terms(pa.array([], pa.string())).to_pylist() == []
    rows = ["Plain plain, (PLAIN)\tother\x0bΟΔΟΣ", " \x0cplain\r\n... ÉTÉ. été ", "no break x\x1fy wide", "", "   ", None, *WORDS]
    texts = spark.createDataFrame([(t,) for t in rows], "_text string").repartition(3)
    got = {r["term"]: r["of_term"] for r in pii._texts_per_term(texts).collect()}
    assert got == Counter(x for t in rows for x in {pii._term(w) for w in pii.WORD.findall(t or "")} if x)
