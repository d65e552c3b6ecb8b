import html
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

import tierloom.plans  # noqa: F401
from tierloom.fixed_values import BONES, PRESETS
from tierloom.functions import text as T
from tierloom.functions import timecode as TC
from tierloom.operators import glossary as G
from tierloom.operators import landmarks as L
from tierloom.plans.registry import QUERIES
from tierloom.plans.source_queries import articles


def values(spark, texts, fn):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["v"] for r in df.select("i", fn(F.col("t")).alias("v")).orderBy("i").collect()]


def test_labels(spark):
    assert values(spark, ["Voda_1", " HOUSE_3 ", "čokoláda", None, "  ", "_7", "a_1_2", "x\n"], T.normalise_label) == [
        "voda", "house", "čokoláda", "", "", "", "a_1", "x"]
    assert values(spark, ["  Voda_1 ", "ČAJ"], T.plain_label) == ["voda_1", "čaj"]


def test_derive_label_keeps_null(spark):
    df = spark.createDataFrame([("", "a"), (" ", "b"), ("r", "c"), (None, "d")], "r string, t string")
    assert [r[0] for r in df.select(T.derive_label("r", "t")).collect()] == ["a", "b", "r", None]


def test_words(spark):
    texts = ["„Ahoj!“", "__x_y__", "Žena,", "...", " a ", "1.", "don't"]
    want = [re.sub(r"^[\W_]+|[\W_]+$", "", t.strip().lower()) for t in texts]
    assert values(spark, texts, T.normalise_word) == want
    assert values(spark, [" a  b\tc\n", "", "  "], T.tokens) == [["a", "b", "c"], [], []]


def test_similarity(spark):
    rows = [("", ""), ("", "a"), ("abc", "abc"), ("abcdef", "abcxef"), ("žena", "zena"), ("a" * 17 + "bcd", "a" * 17 + "xyz")]
    df = spark.createDataFrame(rows, "a string, b string")
    got = [r[0] for r in df.select(T.positional_similarity(F.col("a"), F.col("b"))).collect()]
    assert got == pytest.approx([1.0, 0.0, 1.0, 5 / 6, 0.75, 0.85])


def test_stamps(spark):
    ms = [0, 999, 61_001, 3_600_000, 359_999_999]
    df = spark.createDataFrame([(m,) for m in ms], "m bigint")
    rows = df.select("m", TC.ms_to_stamp("m").alias("s")).withColumn("b", TC.stamp_to_ms("s")).collect()
    assert [r["b"] for r in rows] == ms and rows[2]["s"] == "00:01:01.001"
    assert values(spark, ["1.9999"], lambda c: TC.seconds_to_stamp(c.cast("double"))) == ["00:00:01.999"]


def test_html(spark):
    page = "<h1>Title &amp; more</h1><p> one<br/>two &lt;b&gt; &#269;&#x10D; &eacute;&nbsp;</p>\n\n<li>x</li> &unknown; & end"
    text = re.sub(r"<(?:br|/p|/div|/h[1-6]|/li)[^>]*>", "\n", page, flags=re.I)
    text = html.unescape(re.sub(r"<[^>]+>", "", text))
    want = "\n".join(s for s in (line.strip() for line in text.splitlines()) if s)
    assert values(spark, [page], T.strip_html) == [want]


def test_entities(spark):
    texts = ["&amp;amp; &amp", "&copy2024 &copyfoo; &notit; &notin; &unknown; &; & x", "&#65 &#x41; &#0; &#128; &#x9F; &#xD800; &#1114112;",
             "&#99999999999; &#1; &#xFFFE; &#13;a", "&Eacute;&NotEqualTilde;&lt&gt;", "a&b&&c", "&#x;&#;", "no entity"]
    assert values(spark, texts, T.decode_entities) == [html.unescape(t) for t in texts]


def test_safe_names(spark):
    names = ["Čajník s mliekom!", "ﬁlm ½ №5", "a" * 100, "__x..", " tab\tnew ", "日本", "naïve-café.mp4", None]

    def plain(n):
        if n is None:
            return ""
        n = unicodedata.normalize("NFKD", n.strip())
        n = re.sub(r"\s+", "_", re.sub(r"[^\w\s\-.]", "", n, flags=re.ASCII)).strip("_.")
        return n[:80]

    assert values(spark, names, T.safe_file_name) == [plain(n) for n in names]


def test_repair(spark):
    broken = "ľúbiť šťastie".encode("iso-8859-2").decode("latin-1")
    assert values(spark, [broken, "ok", "already ľ"], T.repair_latin2) == ["ľúbiť šťastie", "ok", "already ľ"]


def test_ids(spark):
    ids = ["a_b_00000120_r_E", "x_00001000_l", "v_1_00000000_r_M12", "bad", "x_1_r_Z"]
    got = values(spark, ids, T.parse_pairing_id)
    assert [tuple(g) for g in got] == [("a_b", 120, "right", "E"), ("x", 1000, "left", ""), ("v_1", 0, "right", "M12"),
                                       ("", None, None, ""), ("", None, None, "")]


def test_gloss_values(spark):
    g = spark.createDataFrame([("WATER-1", "Voda", 0), ("WATER-1", "vody", 1), ("A-1", "voda", 0)], "gloss_id string, form string, form_no bigint")
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(["WATER-1", "vody", "A", "Ä-1", " ", "Voda!", None])], "i int, v string")
    got = [(r["word"], r["gloss_id"]) for r in G.parse_gloss(rows, "v", g).orderBy("i").collect()]
    assert got == [("", "WATER-1"), ("vody", "WATER-1"), ("a", ""), ("ä-1", ""), ("", ""), ("voda!", "A-1"), ("", "")]


def test_next_id_and_edits(spark):
    g = spark.createDataFrame([("A-1", "a", 0), ("A-3", "aa", 0), ("B-2", "b", 0)], "gloss_id string, form string, form_no bigint")
    bases = spark.createDataFrame([("a",), ("b",), ("",), ("new",)], "base string")
    got = {r["base"]: r["gloss_id"] for r in G.next_gloss_id(bases, "base", g).collect()}
    assert got == {"a": "A-2", "b": "B-1", "": "SIGN-1", "new": "NEW-1"}
    many = spark.createDataFrame([(f"A-{n}",) for n in range(1, 1201)] + [("B-1000000",), ("C-01",)], "gloss_id string")
    got = {r["base"]: r["gloss_id"] for r in G.next_gloss_id(bases, "base", many).collect()}
    assert got == {"a": "A-1201", "b": "B-1", "": "SIGN-1", "new": "NEW-1"}
    entry = spark.createDataFrame([(" c-1 ", "lemma", ["lemma", "form", " "])], "gloss_id string, lemma string, forms array<string>")
    rows = G.add_glosses(G.remove_glosses(g, spark.createDataFrame([("A-1",)], "gloss_id string")), entry).collect()
    assert sorted((r["gloss_id"], r["form"], r["form_no"]) for r in rows) == [
        ("A-3", "aa", 0), ("B-2", "b", 0), ("C-1", "form", 1), ("C-1", "lemma", 0)]


def test_fixed_layouts(spark):
    assert {k: len(v) for k, v in PRESETS.items()} == {"compact": 96, "extended": 148, "full": 174}
    assert len(BONES) == 46 and set(PRESETS["compact"]) < set(PRESETS["extended"]) < set(PRESETS["full"])
    df = spark.createDataFrame([(w,) for w in (288, 192, 864, 576, 444, 1332, 888, 296, 522, 7)], "w int")
    got = [r[0] for r in df.select(L.preset_for_width(F.col("w"))).collect()]
    assert got == ["compact"] * 4 + ["extended"] * 4 + ["full", None]


def test_numeric_references_with_leading_zeros(spark):
    import html

    from tierloom.functions.text import decode_entities

    given = ["&#0000000065;", "&#x000000000000000000000000000000000000000000041;", "&#0;", "&#x0;", "&#99999999999;", "&#xFFFFFFFFFF;", "&#xA9", "&#65"]
    rows = spark.createDataFrame([(t,) for t in given], "t string").select("t", decode_entities("t").alias("d")).collect()
    assert {r["t"]: r["d"] for r in rows} == {t: html.unescape(t) for t in given}


def test_articles_of_all_posts(spark):
    """Documents with markup and character references are articles too, against brute force."""
    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = {}
    for i, t in docs.items():
        frame = f'<p><iframe src="https://www.youtube.com/embed/{str(i).rjust(11, "x")[:11]}"></iframe>' if i % 2 == 0 else "<p>"
        page = re.sub(r"(?i)<(?:br|/p|/div|/h[1-6]|/li)[^>]*>", "\n", f"{frame}{t}</p>")
        lines = (x.strip() for x in html.unescape(re.sub("<[^>]+>", "", page)).splitlines())
        want[i] = "\n".join(x for x in lines if x)
    got = {r["post_id"]: r["text"] for r in QUERIES["a16_articles_of_all_posts"](spark, sf).collect()}
    assert got == want
    assert any(re.search("[<>&]", t) for t in docs.values())
    made = articles(spark.createDataFrame([(1, "a &lt;b&gt; <i>c</i> &amp; d<br>e &#233;", "en", "s")], "doc_id long, text string, lang string, source string"))
    assert made.first()["text"] == "a <b> c & d\ne é"


def test_file_names_of_every_code_point(spark):
    import re
    import unicodedata

    def plain(name):
        text = re.sub(r"[^\w\s\-.]", "", unicodedata.normalize("NFKD", name.strip()), flags=re.ASCII)
        return re.sub(r"\s+", "_", text).strip("_.")[:80]

    names = [f"{chr(a)}x{chr(a + 1)}" for a in range(0, 0x110000, 2) if not 0xD800 <= a <= 0xDFFF and not 0xD800 <= a + 1 <= 0xDFFF]
    names += ["Ａ①Ⅰ㎏ b", "  .a. ", "é" * 100, "", "½ ﬁ"]
    df = spark.createDataFrame(list(enumerate(names)), "i long, name string")
    got = {r["i"]: r["n"] for r in df.select("i", T.safe_file_name("name").alias("n")).collect()}
    wrong = [(n, got[i], plain(n)) for i, n in enumerate(names) if got[i] != plain(n)]
    assert not wrong, wrong[:5]


def test_strip_html_and_its_sql_read_references_alike(spark):
    import html
    import re

    import duckdb

    from tierloom import plans  # noqa: F401
    from tierloom.functions import text as T
    from tierloom.plans.registry import ORACLES

    pages = ["der&amp{margin", "&ampp &notit; &notin; &lt;b&gt &quot &quo &copy2", "&#65;&#x41 &#128;&#0;&#xD800;&#1114112;&#99999999999;&#7;&#xFDD0;&#33a;",
             "&amp;lt; && & &;&#;&#x; &unknown; &acE; &nbsp;", "a<br>b</p>c", "", None]
    want = {i: None if h is None else "\n".join(t for t in (u.strip() for u in re.split(
        "[\n\r]", html.unescape(re.sub("<[^>]+>", "", re.sub("<(?:br|/p)[^>]*>", "\n", h))))) if t) for i, h in enumerate(pages)}
    rows = spark.createDataFrame(list(enumerate(pages)), "page_id bigint, html string")
    assert {r[0]: r[1] for r in rows.select("page_id", T.strip_html("html")).collect()} == want
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", [list(r) for r in enumerate(pages)])
    assert dict(con.execute(ORACLES["d09_strip_html"]).fetchall()) == want
