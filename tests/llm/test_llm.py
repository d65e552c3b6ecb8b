"""Training-data operators against brute force, on small tables with nulls, empty and repeated rows and clashing columns."""

import hashlib
import random
import re
from collections import Counter
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from tierloom.llm import (decontaminate, jaccard_join, lm_scoring, mixing, page_text, pii, quality_classifier, quality_rules, repeats,
                          url_rules)

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, kept string, spans string, class_id string"


def sentence(rng, n):
    return " ".join("".join(rng.choice(["an", "er", "ti", "on", "th", "re", "st"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    long = sentence(rng, 400)
    near = long.split()
    near[200] = "changed"
    shared = sentence(rng, 60)
    out = [None, "", "   \n ", "one two", "one two", long, long, " ".join(near), "a\n\n" * 3, "The " * 300]
    out += [sentence(rng, 80) + " " + shared + " " + sentence(rng, 80) for _ in range(6)]
    out += [sentence(rng, rng.randint(1, 200)) for _ in range(40)]
    out += ["mail é x.y@mail.example.com now or +1 (555) 123-4567 and 10.0.0.1 or 999.1.1.1, card 4111 1111 1111 1111.", "#### $$$ %%% &&& " * 40]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, None if i == 4 else "en" if i % 2 else "fr", ["a", "b", None][i % 3] if i > 20 else "hot", 1, "x", "y", "z", "c") for i, t in enumerate(texts)]
    rows += [rows[5], (None, texts[12], None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_mixing_keeps_to_targets(docs, none):
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count() and {"size", "source_size", "target", "taken", "lang"} <= set(got[0].asDict())
    total = sum(r["size"] for r in got)
    per = {}
    for r in got:
        assert r["taken"] in (0, r["size"], 2 * r["size"], 3 * r["size"])
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        at = per.setdefault(r["source"], [r["source_size"], r["target"], 0])
        at[2] += r["taken"]
    assert sum(p[0] for p in per.values()) == total and abs(sum(p[1] for p in per.values()) - total) < 1e-6
    longest = max(r["size"] for r in got)
    for size, target, taken in per.values():
        assert target <= 3 * size + 1e-9 and abs(taken - target) <= 2 * longest
    again = sorted((str(r["doc_id"]), r["taken"]) for r in mixing.mix(docs.repartition(5)).collect())
    assert again == sorted((str(r["doc_id"]), r["taken"]) for r in got)
    assert mixing.mix(none).count() == 0


def test_url_rules_brute_force(spark):
    rules = [("net", "/", "block"), ("a.net", "/en/", "allow"), ("com", "", "block"), ("com", "/x", "allow"), ("b.a.net", "/en/q", "block")]
    urls = [None, "", "nothing", "http://", "http://net/", "http://NET/x", "https://z.A.net/en/1?q", "http://b.a.net/en/q1", "http://xa.net/en/", "http://a.com?y=/x",
            "http://a.com/x", "ftp://q.com/xy#t", "http://a.net.org/en/", "http://b.a.net/EN/q", "http://a.net/en/\nb"]
    pages = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls * 3)], "page_id long, url string, host string")
    got = url_rules.judge_urls(pages, spark.createDataFrame([*rules, *rules, (None, "/", "block")], "host string, path string, verdict string"))
    rows = {r["page_id"]: r for r in got.collect()}
    assert len(rows) == len(urls) * 3
    for i, u in enumerate(urls * 3):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m.group(1).lower(), m.group(2)) if m else ("", "")
        fit = sorted(((-len(h + p), v != "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)))
        assert (rows[i]["host"], rows[i]["path"], rows[i]["rule"], rows[i]["verdict"]) == (host, path, fit[0][2] if fit else None, fit[0][3] if fit else "allow"), u
    assert url_rules.judge_urls(pages.limit(0), spark.createDataFrame(rules, "host string, path string, verdict string")).count() == 0


def test_quality_measures_and_bounds(spark, docs, none, texts):
    for t in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
        hit = {i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in range(3)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit))
        assert quality_rules.measure((t or "").encode()) == want
    for n, p in ((30, 0.01), (200, 0.05)):
        for k in (0, 1, 5, n):
            assert abs(quality_rules.binomial_cdf(k, n, p) - sum(comb(n, i) * p ** i * (1 - p) ** (n - i) for i in range(k + 1))) < 1e-12
    labels = spark.createDataFrame([(i, int(i % 7 > 0)) for i in range(60)] + [(None, 1)], "doc_id long, quality int")
    got = quality_rules.judge(docs, labels, ["doc_id"]).collect()
    assert len(got) == docs.count() and all(not r["kept"] for r in got if r["base_failed"])
    assert all(r["kept"] for r in got if not r["base_failed"])  # far too few labels to certify a cutoff
    assert quality_rules.judge(none, labels, ["doc_id"]).count() == 0


def test_certified_cutoffs_hold_their_risk():
    import pandas as pd

    hits = pd.DataFrame({"idx": [5, 20, quality_rules.NEVER], "n": [3, 200, 9797]})
    best = quality_rules.certify(hits, 0.0025, 0.01, 50)
    assert best == 19  # the next cutoff turns away 203 of 10,000
    assert quality_rules.certify(hits.iloc[:0], 0.0025, 0.01, 50) == -1


def test_weak_labels_and_classifier(spark, none):
    prior, _, post = quality_classifier.fit_labellers({"1--": 50, "-1-": 40, "11-": 30, "---": 880, "--0": 100, "1-1": 20}, [(0.01, 0.3)] * 2 + [(0.02, 0.9)])
    assert prior == 0.1 and post["11-"] > 0.9 and post["---"] < 0.5
    rng = random.Random(1)
    rows = [(i, sentence(rng, 120)) for i in range(150)] + [(1000 + i, "#$% " * 40 + sentence(rng, 20)) for i in range(30)]
    rows += [(2000 + i, sentence(rng, 60) + " idiot stupid moron trash " + sentence(rng, 30)) for i in range(30)] + [(3000, None), (3001, "")]
    docs = spark.createDataFrame([(i, t, "old") for i, t in rows], "doc_id long, text string, kept string")
    got = {r["doc_id"]: r["kept"] for r in quality_classifier.classify(docs).collect()}
    assert len(got) == len(rows)
    assert sum(got[i] for i in range(150)) >= 148 and not any(got[i] for i in got if 1000 <= i < 3000)
    assert quality_classifier.classify(none.select("doc_id", "text")).count() == 0


def test_personal_data(spark, docs, none, texts):
    i = len(texts) - 2
    got = {r["doc_id"]: r for r in pii.find(docs, cleaned="text").collect()}
    r = got[i]
    assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == (1, 1, 1, 1)
    assert r["text"] == "mail é <email> now or <phone> and <ip> or 999.1.1.1, card <card>."
    assert r["base_sha256"] == hashlib.sha256(r["spans"].encode()).hexdigest() and got[0]["spans"] == "" and got[0]["text"] is None
    assert got[7]["text"] == texts[7]
    rows = [(k, f"{sentence(random.Random(k), 30)} Zorbl w{k} boss@corp.example.com v{k} {sentence(random.Random(-k), 20)}") for k in range(1, 7)]
    rows += [(k, sentence(random.Random(k), 50)) for k in range(10, 600)]
    found = pii.find(spark.createDataFrame(rows, "doc_id long, text string")).filter("spans like '%term%'").collect()
    assert {r["doc_id"] for r in found} == set(range(1, 7))
    for r in found:
        assert {r["text"][int(a):int(b)] for k, a, b in (s.split(":") for s in r["spans"].split(",")) if k == "term"} == {"Zorbl"}
    assert pii.find(none).count() == 0


def test_disclosures_brute_force(spark):
    """Terms far from the entity, entities of one text, hosts and prefixes, and copies in several partitions."""
    rng = random.Random(8)
    rows = [sentence(rng, 12) for _ in range(400)]
    rows += [f"Quillon {sentence(rng, 30)} lone@solo.example.org {sentence(rng, 9)}"] * 5
    rows += [f"{sentence(rng, 25)} m{k}@guild.example.com {sentence(rng, 25)} Guildhall." for k in range(4)]
    rows += [f"Ring +49 30 12345{k:02} {sentence(rng, 20)} (Kontor)" for k in range(4)]
    docs = spark.createDataFrame([(t,) for t in rows], "text string").repartition(7)
    got = {(r["entity"], r["term"]): (r["chance"], r["bits"]) for r in pii.disclosures(docs).collect()}

    texts = set(rows)
    words = {t: {w.strip(pii.EDGE).lower() for w in t.split()} - {""} for t in texts}
    of_term = Counter(w for t in texts for w in words[t])
    named, both, arounds = Counter(), {}, {}
    for t in texts:
        spans = pii.base_spans(t)
        inside = {w.strip(pii.EDGE).lower() for a, b, _ in spans for w in t[a:b].split()}
        for e in {e for a, b, k in spans for e in pii.general(k, t[a:b])}:
            named[e] += 1
            arounds.setdefault(e, set()).add(t)
            for w in words[t] - inside:
                both.setdefault((e, w), set()).add(t)
    want = {}
    for (e, w), held in both.items():
        p = len(held) / of_term[w]
        bits = np.log2(p * len(texts) / named[e])
        if p >= 0.5 and bits >= 6 and len(held) >= (3 if len(arounds[e]) >= 3 else 1):
            want[e, w] = (p, bits)
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
    assert {("email:lone@solo.example.org", "quillon"), ("email:@guild.example.com", "guildhall"), ("phone:493012-", "kontor")} <= got.keys()
    spans = {s for r in pii.find(docs).collect() for s in r["spans"].split(",") if r["text"].startswith("Quillon")}
    assert "term:0:7" in spans


def test_page_text(spark):
    page = ("<html><head><title>t</title><style>p{}</style></head><body><nav><a href='/'>Home</a></nav><div class='cookie-notice'>We use cookies</div>"
            "<div id=main class=post-12><h1>Head &amp; more</h1><p>First <b>bold</b>\n text<br>next<p>Second &#233;&nbsp;x</p><form>sign <input></form><script>var a='</p>';</script>"
            "<div class=comments>nice post</div></div><aside>side words</aside><footer>end</footer>")
    pages = spark.createDataFrame([(1, "http://a/", page, "old"), (1, "http://a/", page, "old"), (2, None, None, "old"), (3, "http://a/2", "", None), (4, "x", "plain words", None)],
                                  "page_id long, url string, html string, text string")
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in page_text.extract(pages).collect())
    want = "Head & more\nFirst bold text next\nSecond é x"
    assert got == [(1, want, len(want))] * 2 + [(2, "", 0), (3, "", 0), (4, "plain words", 11)]
    assert page_text.extract(pages.limit(0)).count() == 0


def test_page_text_keeps_all_sections_and_the_headline(spark):
    word = "several words of prose that fill a section "
    rows = [(k, "http://h/", f"<html><body><div><section>{word * 4}{k}</section></div></body></html>") for k in range(4)]
    rows.append((9, "http://h/", "<html><body><div>" + "".join(f"<section>{word * 4}part{k}</section>" for k in range(3)) + "</div></body></html>"))
    rows.append((10, "http://g/", f"<html><body><h1>Headline</h1><div><p>{word * 90}</p></div></body></html>"))
    got = {r["page_id"]: r["text"] for r in page_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[9] == "\n".join((word * 4 + f"part{k}") for k in range(3))
    assert got[10].startswith("Headline\n")


def brute_repeats(texts, length):
    raws = [(t or "").encode() for t in texts]
    count = Counter(r[i:i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r), dtype=bool)
        for i in range(len(r) - length + 1):
            if count[r[i:i + length]] > 1:
                gone[i:i + length] = True
        rest = bytes(np.frombuffer(r, dtype=np.uint8)[~gone])
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((len(r), int(gone.sum()), spans, hashlib.sha256(rest).hexdigest()))
    return out


@pytest.mark.parametrize("members", [20_000, 2])
def test_repeats_brute_force(docs, none, members):
    rows = docs.select("doc_id", "text").collect()
    want = Counter((r["doc_id"], *w) for r, w in zip(rows, brute_repeats([r["text"] for r in rows], 100)))
    got = repeats.remove_repeats(docs, 100, ["doc_id"], members=members)
    assert Counter(tuple(r) for r in got.collect()) == want
    assert repeats.remove_repeats(none, 100).count() == 0


def test_decontamination(spark, docs, none, texts):
    rng = random.Random(9)
    items = [(k, sentence(rng, 40)) for k in range(5)] + [(5, None), (6, ""), (7, "short item")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    edited = items[1][1][:50] + "XY" + items[1][1][51:]
    far = "".join(c if i % 6 else "#" for i, c in enumerate(items[2][1]))
    more = spark.createDataFrame([(100, "start " + items[0][1].upper().replace(" ", "\n ") + " end"), (101, f"x {edited} y"), (102, far), (103, "a short  item b"), (104, None)],
                                 "doc_id long, text string")
    for size in (1 << 20, 100):
        got = {r["doc_id"]: (r["items"], r["edits"]) for r in decontaminate.find(more, bench, block_bytes=size).collect()}
        assert got == {100: ([0], [0]), 101: ([1], [2]), 102: ([], []), 103: ([7], [0]), 104: ([], [])}
    assert decontaminate.drop_contaminated(docs, bench).columns == docs.columns
    assert decontaminate.find(docs, bench.limit(0)).filter(F.size("items") > 0).count() == 0 and decontaminate.find(none, bench).count() == 0


def brute_classes(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.setdefault(frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else []), []).append(i)
    links = {s: [o for o in sets if o != s and len(s & o) >= 0.8 * len(s | o)] for s in sets if s}
    return sets, links


def test_jaccard_join_brute_force(spark, docs, none):
    rng = random.Random(5)
    base = sentence(rng, 150).split()
    rows = [(i, t) for i, t in docs.filter("doc_id is not null").select("doc_id", "text").collect()]
    for k in range(60):  # a chain of near copies, several of them alike
        w = list(base)
        for _ in range(k % 4):
            w[rng.randrange(len(w))] = f"x{rng.randrange(9)}"
        rows.append((500 + k, " ".join(w)))
    sets, links = brute_classes(rows)
    given = spark.createDataFrame([(i, t, "old") for i, t in rows], "doc_id long, text string, class_id string")
    for small, block in ((256, 96), (8, 7)):
        got = jaccard_join.similar(given, small=small, block=block).collect()
        assert len(got) == len(rows)
        own = {i: s for s, ids in sets.items() for i in ids}
        for r in got:
            s = own[r["id"]]
            assert r["class_id"] == (min(sets[s]) if s else r["id"]) and r["n_links"] == len(links.get(s, ())), r
        groups = {r["id"]: r["group_id"] for r in got}
        assert all(groups[min(sets[o])] == groups[min(sets[s])] for s in links for o in links[s])
    kept = jaccard_join.first_of_each(given)
    assert sorted(r["doc_id"] for r in kept.filter("text rlike '[^ \\n]'").collect()) == sorted({g for i, g in groups.items() if own[i]})
    assert kept.columns == given.columns and jaccard_join.similar(none).count() == 0


def test_lm_scoring(spark, docs, none):
    got = lm_scoring.score(docs).collect()
    rows = [((r["doc_id"], r["text"])) for r in docs.select("doc_id", "text").collect()]
    import zlib

    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    split = lambda t: (t or "").encode().lower().split() + [b""]
    c = Counter(w for i, t in rows if not held(i) for w in split(t))
    n, v = sum(c.values()), len(c)
    want = Counter((str(i), held(i), len(split(t)), sum(c[w] > 0 for w in split(t)), n,
                    round(sum(np.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in split(t)), 6)) for i, t in rows)
    assert Counter((str(r["id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 for r in got)
    assert lm_scoring.score(none).count() == 0


def test_attention_gradient_and_windows():
    rng = np.random.default_rng(0)
    model = lm_scoring.Model()
    x, t = rng.integers(0, lm_scoring.INPUTS, (2, lm_scoring.WINDOW)), rng.integers(0, lm_scoring.CLASSES, (2, lm_scoring.WINDOW))
    mask = rng.random(x.shape) < 0.7

    def loss(flat):
        other = lm_scoring.Model(flat)
        other.tables()
        return -(other.log_classes(x, t, 0) * mask).sum() / mask.sum()

    g = model.gradient(x, t, mask)
    for i in np.argsort(-np.abs(g))[::400][:12]:
        step = np.zeros_like(model.flat)
        step[i] = 0.02
        assert abs((loss(model.flat + step) - loss(model.flat - step)) / 0.04 - g[i]) < 2e-2 * max(1, abs(g[i]))
    lengths = np.array([0, 1, 31, 32, 33, 56, 57, 500])
    start, number, end = lm_scoring.windows(lengths)
    hits = np.zeros(lengths.sum(), dtype=int)
    for s, k, e in zip(start, number, end):
        hits[s + (0 if k == 0 else lm_scoring.WINDOW - lm_scoring.STRIDE):min(s + lm_scoring.WINDOW, e)] += 1
    assert (hits == 1).all()


def test_pipeline_stages(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "personal_data", "mixture"]
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert set(docs.columns) <= set(out.columns) and 0 < out.count() <= docs.count()


def test_attention_trains_on_all_training_texts(spark):
    rng = random.Random(4)
    rows = lm_scoring._blocked(spark.createDataFrame([(i, sentence(rng, 300)) for i in range(30)], "doc_id long, text string"), "doc_id", "text", 1 << 20)
    coder, end = lm_scoring.subwords(lm_scoring.TOKENIZER)
    want = sum(len(coder.encode_ordinary(" " + w)) for r in rows.filter("not held_out").collect() for w in r["_text"].split()) + rows.filter("not held_out").count()
    share = spark.sparkContext.broadcast
    got = lm_scoring._trained_blocks(rows, share(lm_scoring.Model().flat), share(lm_scoring.Classes(np.ones(end + 1))), lm_scoring.TOKENIZER, lm_scoring.SHARE)
    assert got.agg(F.sum("tokens")).first()[0] == want


def test_training_has_every_subword_as_target_once():
    rng = random.Random(6)
    texts = [sentence(rng, n).encode() for n in (0, 1, 63, 64, 65, 300)]
    own = lm_scoring.Stretches(lm_scoring.TOKENIZER, lm_scoring.SHARE)
    for t in texts:
        own.add(t)
    tokens, lengths, opens = own.taken()
    assert [i for t in texts for w in t.lower().split() for i in own.numbers.coder.encode_ordinary(" " + w.decode())] == [i for i in tokens if i != own.numbers.end]
    seq = lm_scoring.Sequence(tokens, lengths, lm_scoring.Classes(np.ones(own.numbers.end + 1)), opens)
    start, end = lm_scoring.pieces(lengths)
    x, target, mask = seq.batch(start, end)
    assert len(lengths) == len(texts) and mask.sum() == len(tokens) and x.size < len(tokens) + lm_scoring.WINDOW * len(texts)
    assert (target[mask] == seq.target).all() and (x[mask] == seq.before).all()


@pytest.mark.parametrize("mark", ["has-sidebar", "post-comments-enabled", "related-news", "share-ready", "single-post no-sidebar"])
def test_a_wrapper_with_the_name_of_furniture_keeps_the_article(mark):
    article = "<h1>Head</h1>" + "".join(f"<p>This is paragraph {i} of the whole article.</p>" for i in range(40))
    page = f"<html><body><div class='{mark}'><nav><a href=x>menu</a></nav>{article}<div class='share'>share it</div></div><footer>foot</footer></body></html>"
    pieces, nodes = page_text.parse(page)
    got = page_text.text_of(pieces, page_text.best_container(pieces, nodes))
    assert got.split("\n") == ["Head", *[f"This is paragraph {i} of the whole article." for i in range(40)]]


def test_long_comments_stay_out_and_deep_pages_are_small():
    page = "<body><div><h1>H</h1><p>A short article of a few words.</p></div><section class='comments'>" + "<p>reader says a lot</p>" * 200 + "</section></body>"
    pieces, nodes = page_text.parse(page)
    assert page_text.text_of(pieces, page_text.best_container(pieces, nodes)) == "H\nA short article of a few words."
    pieces, nodes = page_text.parse("<div class='a b'>" * 8000 + "<p>deep text</p>" + "</div>" * 8000)
    node = page_text.best_container(pieces, nodes)
    assert page_text.text_of(pieces, node) == "deep text" and node.code == page_text.path_code(node.path)


def test_posterior_of_a_pattern_that_was_not_met():
    patterns = {"1-1": 30, "--0": 200, "0-0": 100, "-1-": 5, "---": 400, "01-": 3}
    prior, tables, post = quality_classifier.fit_labellers(patterns, [(0.05, 0.5)] * 2 + [(0.01, 0.9)])
    for pattern, known in list(post.items()):
        again = quality_classifier.Posteriors({}, prior, tables)
        assert abs(again[pattern] - known) < 1e-6
    assert post["111"] > post["1-1"] > 0.9 > prior > post["0-0"]


def test_clashing_names(spark, docs):
    given = docs.select("doc_id", "text", *[F.lit(1).alias(c) for c in ("_text", "_key", "_terms", "_id", "_row", "_host", "_html")])
    for found in (quality_classifier.classify(given), pii.find(given), pii.find(given, cleaned="text")):
        assert found.count() == given.count() and {"_text", "_key", "_host"} <= set(found.columns)
    pages = given.select(F.col("doc_id").alias("page_id"), F.lit("http://a.b/c").alias("url"), F.concat(F.lit("<p>"), "text").alias("html"), "_text", "_host", "_html", "_row")
    assert page_text.extract(pages).columns == ["page_id", "url", "_text", "_host", "_html", "_row", "text", "n_chars"]
