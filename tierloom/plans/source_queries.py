"""Queries over readers and writers; the text being parsed is made from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tierloom.functions import text as T
from tierloom.operators import landmarks as L
from tierloom.operators import matching as M
from tierloom.operators import metrics as ME
from tierloom.operators.cues import align_to_frames
from tierloom.operators.label_sets import quality_filter
from tierloom.plans import metric_queries as MQ
from tierloom.plans.cue_queries import ALIGN_COLS, CLIPS_SQL, STAMP, clips
from tierloom.plans.join_queries import PREDS_SQL, hand_predictions
from tierloom.plans.landmark_queries import clip_segments
from tierloom.plans.registry import query
from tierloom.plans.text_queries import DECODED
from tierloom.plans.signal_queries import detect_sql
from tierloom.plans.text_queries import FILE_NAME
from tierloom.sources import annotations as AN
from tierloom.sources import pages as PG
from tierloom.sources import sinks, subtitles, tables


@query("a01_file_inventory")
def file_inventory(b):
    files = tables.scan_files(b.spark, b.sf_dir, ["parquet"])
    return files.select("filename", "stem", "bytes", "file_size_mb")


@query("a01_inventory_with_probes", """SELECT o_orderkey AS stem, '/v/' || o_orderkey || '.mp4' AS path, round(o_custkey * 1000 / 1048576, 2) AS file_size_mb, CAST(o_custkey % 50 AS DOUBLE) AS duration_sec,
    o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 30) AS pose_extracted FROM orders""")
def inventory_with_probes(b):
    key = F.col("o_orderkey")
    files = b.table("orders").select(F.format_string("/v/%d.mp4", key).alias("path"), F.format_string("%d.mp4", key).alias("filename"), key.alias("stem"),
                                     F.round(F.col("o_custkey") * 1000 / 1_048_576, 2).alias("file_size_mb"))
    probes = b.table("orders").select(F.format_string("/v/%d.mp4", key).alias("path"), (F.col("o_custkey") % 50).cast("double").alias("duration_sec"), F.lit(1).alias("width"),
                                      F.lit(1).alias("height"), F.lit(25.0).alias("fps"), F.lit("h264").alias("codec"))
    poses = b.table("lineitem").select(F.col("l_orderkey").alias("stem"), F.when(F.col("l_quantity") > 30, 5).otherwise(0).alias("bytes"))
    out = tables.build_inventory(files, probes, poses)
    return out.select(F.regexp_extract("path", r"(\d+)", 1).cast("long").alias("stem"), "path", "file_size_mb", "duration_sec", "pose_extracted")


@query("a03_webvtt_cues", f"""SELECT stem, row_number() OVER (PARTITION BY stem ORDER BY cue_no) - 1 AS n, start_ms, end_ms, t AS text FROM (SELECT stem, cue_no, start_ms, end_ms,
    trim(regexp_replace(replace(text, chr(10) || chr(10), chr(10)), '\\s+$', '')) AS t FROM cues) WHERE t <> ''""")
def webvtt_cues(b):
    blocks = subtitles.webvtt_blocks(b.cues.withColumn("text", F.replace("text", F.lit("\n\n"), F.lit("\n"))))
    files = blocks.groupBy("stem").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "block"))), lambda x: x["block"]), "\n").alias("content"))
    files = files.select(F.format_string("/subs/%d.vtt", "stem").alias("path"), "content")
    out = subtitles.cues_of_text(files)
    return out.select(F.col("stem").cast("long").alias("stem"), F.col("cue_no").alias("n"), "start_ms", "end_ms", "text")


@query("a05_annotation_documents", """SELECT CAST(stem AS VARCHAR) AS stem, CASE hand WHEN 'right' THEN 'S1_Gloss_RH' ELSE 'S1_Gloss_LH' END AS tier, start_ms, end_ms, word AS value FROM pairings WHERE stem % 10 <> 0 AND NOT (hand = 'left' AND stem % 3 = 0)""")
def annotation_documents(b):
    tier = F.when(F.col("hand") == "right", "S1_Gloss_RH").when(F.col("stem") % 3 == 0, "S1_Mouthing").otherwise("S1_Gloss_LH")
    p = b.pairings.withColumn("tier", tier).withColumn("aid", F.concat_ws("_", *[F.col(c).cast("string") for c in ("line_no", "partkey", "suppkey", "start_ms", "price")]))
    slot = F.format_string('<TIME_SLOT TIME_SLOT_ID="s%s" TIME_VALUE="%d"/><TIME_SLOT TIME_SLOT_ID="e%s" TIME_VALUE="%d"/>', "aid", "start_ms", "aid", "end_ms")
    ann = F.format_string('<ANNOTATION><ALIGNABLE_ANNOTATION ANNOTATION_ID="a%s" TIME_SLOT_REF1="s%s" TIME_SLOT_REF2="e%s"><ANNOTATION_VALUE>%s</ANNOTATION_VALUE></ALIGNABLE_ANNOTATION></ANNOTATION>',
                          "aid", "aid", "aid", "word")
    per_tier = p.groupBy("stem", "tier").agg(F.array_join(F.collect_list(ann), "").alias("anns"), F.array_join(F.collect_list(slot), "").alias("slots"))
    doc = per_tier.groupBy("stem").agg(F.array_join(F.collect_list(F.format_string('<TIER TIER_ID="%s">%s</TIER>', "tier", "anns")), "").alias("tiers"),
                                       F.array_join(F.collect_list("slots"), "").alias("slots"))
    broken = F.when(F.col("stem") % 10 == 0, "<oops").otherwise("</ANNOTATION_DOCUMENT>")
    files = doc.select(F.col("stem").cast("string").alias("stem"), F.concat(F.format_string("<ANNOTATION_DOCUMENT><TIME_ORDER>%s</TIME_ORDER>%s", "slots", "tiers"), broken).alias("content"))
    return AN.annotations_of_text(files, "content", ["S1_Gloss_RH", "S1_Gloss_LH"])


@query("a07_detection_tier_rows", f"""WITH {detect_sql('signal', 'clip', 1.0, 0.5)}
    SELECT clip AS stem, CASE WHEN clip % 2 = 0 THEN 'AI_Gloss_RH' ELSE 'AI_Gloss_LH' END AS tier, start_ms, end_ms, '?' AS value FROM found
    UNION ALL SELECT clip, 'AI_Confidence', start_ms, end_ms, CAST(score AS VARCHAR) FROM found WHERE clip % 2 = 0""")
def detection_tier_rows(b):
    from tierloom.operators.signal import detect_segments

    found = detect_segments(b.hand_signal, ["clip", "hand"], sigma=1.0, threshold=0.5)
    return M.detection_tier_rows(found.withColumnRenamed("clip", "stem"))


@query("a09_landmark_lines", """SELECT clip, frame, round(x, 6) AS x, round(y, 6) AS y, CASE WHEN frame % 3 = 0 THEN 0 ELSE CAST(0.5 AS DOUBLE) END AS c, CAST(3 AS BIGINT) AS n FROM (
    SELECT label AS clip, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings WHERE vec_id % 7 <> 0)""")
def landmark_lines(b):
    e = lambda i: F.get("embedding", F.lit(i)).cast("double")
    rows = b.table("embeddings").withColumn("line", F.when(F.col("vec_id") % 7 == 0, F.lit('{"frame": oops')).otherwise(F.to_json(F.struct(
        F.col("vec_id").alias("frame"), F.lit(0.5).alias("timestamp"), F.array(F.array(e(0), e(1), F.lit(0.5)), F.array(e(2))).alias("landmarks")))))
    out = AN.poses_of_lines(rows.select(F.col("label").alias("clip"), "line"), size=3)
    p = F.get("pts", F.lit(0))
    c = F.when(F.col("frame") % 3 == 0, F.get("pts", F.lit(1))["c"]).otherwise(p["c"])
    return out.select("clip", "frame", F.round(p["x"], 6).alias("x"), F.round(p["y"], 6).alias("y"), c.alias("c"), F.size("pts").cast("long").alias("n"))


@query("a10_alignment_types", """SELECT CAST(l_orderkey AS VARCHAR) AS segment_id, CAST(l_comment AS VARCHAR) AS text, '' AS reviewed_text, CASE WHEN l_linenumber = 1 THEN 'pending' ELSE l_returnflag END AS status,
    CASE WHEN l_linenumber % 3 = 0 THEN 0 ELSE l_partkey END AS start_ms, CAST(l_suppkey AS BIGINT) AS end_ms, CASE WHEN l_linenumber % 3 = 0 THEN 0 ELSE l_partkey END AS reviewed_start_ms, CAST(l_suppkey AS BIGINT) AS reviewed_end_ms,
    CASE WHEN l_linenumber = 2 THEN NULL ELSE l_quantity END AS fps FROM (SELECT *, l_linestatus AS l_comment FROM lineitem)""")
def alignment_types(b):
    n = F.col("l_linenumber")
    text = b.table("lineitem").select(
        F.col("l_orderkey").cast("string").alias("segment_id"), F.col("l_linestatus").alias("text"), F.when(n != 1, F.col("l_returnflag")).alias("status"),
        F.when(n % 3 == 0, "bad").otherwise(F.col("l_partkey").cast("string")).alias("start_ms"), F.concat(F.col("l_suppkey").cast("string"), F.lit(".0")).alias("end_ms"),
        F.when(n == 2, "x").otherwise(F.col("l_quantity").cast("string")).alias("fps"))
    return tables.typed_alignment(text)


@query("a11_pairing_types", """SELECT CAST(l_orderkey AS VARCHAR) AS pairing_id, CASE WHEN l_linenumber <= 2 THEN 'pending' ELSE l_returnflag END AS status, CASE WHEN l_linenumber % 3 = 0 THEN 0 ELSE l_partkey END AS sign_start_ms,
    CASE WHEN l_linenumber = 2 THEN 0 ELSE l_quantity END AS fps, CASE WHEN l_linenumber = 4 THEN '' ELSE l_linestatus END AS note FROM lineitem""")
def pairing_types(b):
    n = F.col("l_linenumber")
    text = b.table("lineitem").select(
        F.col("l_orderkey").cast("string").alias("pairing_id"), F.when(n == 1, "").when(n > 2, F.col("l_returnflag")).alias("status"),
        F.when(n % 3 == 0, "bad").otherwise(F.col("l_partkey").cast("string")).alias("sign_start_ms"), F.when(n == 2, "x").otherwise(F.col("l_quantity").cast("string")).alias("fps"),
        F.when(n != 4, F.col("l_linestatus")).alias("note"))
    return tables.typed_pairings(text)


@query("a12_split_rows", """SELECT split, count(*) AS n FROM (SELECT CASE p_partkey % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split FROM part) GROUP BY split""")
def split_rows(b):
    n = F.col("p_partkey") % 3
    return b.table("part").withColumn("split", F.when(n == 0, "train").when(n == 1, "val").otherwise("test")).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("a12_splits_written", "SELECT p_partkey, p_name, CASE p_partkey % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split FROM part")
def splits_written(b):
    from tierloom.session import new_folder

    path, n = new_folder(b.spark, "splits"), F.col("p_partkey") % 3
    rows = b.table("part").select("p_partkey", "p_name", F.when(n == 0, "train").when(n == 1, "val").otherwise("test").alias("split"))
    sinks.write_splits(rows, path)
    return b.spark.read.schema(rows.schema).option("header", True).option("escape", '"').csv(path)


@query("a13_glossary_json", "SELECT gloss_id, form, form_no, form AS lemma, 'n' AS pos FROM glossary UNION ALL SELECT gloss_id, form || 's', 1, form, 'n' FROM glossary")
def glossary_json(b):
    g = b.glossary.select("gloss_id", F.explode(F.array(F.struct(F.lit(0).cast("long").alias("form_no"), F.col("form").alias("f")), F.struct(F.lit(1).cast("long").alias("form_no"), F.concat("form", F.lit("s")).alias("f")))).alias("x"),
                          F.col("form").alias("lemma"), F.lit("n").alias("pos"), F.lit("").alias("notes"))
    docs = tables.glossary_to_json(g.select("gloss_id", "lemma", "pos", "notes", F.col("x.form_no").alias("form_no"), F.col("x.f").alias("form")))
    return tables.glossary_of_json(docs).select("gloss_id", "form", "form_no", "lemma", "pos")


@query("a14_dictionary_columns", "SELECT p_partkey AS word_id, p_name AS translation, p_brand AS video_url, p_type AS word_class, p_size FROM part")
def dictionary_columns(b):
    t = b.table("part").select(F.col("p_partkey").alias("WordID"), F.col("p_name").alias(" Word"), F.col("p_brand").alias("URL"), F.col("p_type").alias("POS"), "p_size")
    return tables.dictionary_columns(t)


@query("a15_sidecar_rows", """SELECT doc_id, CASE WHEN bad THEN '' ELSE 'id' || doc_id END AS id, CASE WHEN bad THEN '(unknown)' ELSE source END AS title, CASE WHEN bad THEN '' ELSE left(text, 500) END AS description, CASE WHEN bad THEN '' ELSE lang END AS uploader,
    '' AS upload_date, CASE WHEN bad THEN NULL ELSE CAST(n_chars AS DOUBLE) END AS duration_sec, CASE WHEN bad THEN '' ELSE 'http://x/' || doc_id END AS source_url FROM (SELECT *, doc_id % 9 = 0 AS bad FROM documents)""")
def sidecar_rows(b):
    good = F.to_json(F.struct(F.concat(F.lit("id"), "doc_id").alias("id"), F.col("source").alias("title"), F.col("text").alias("description"), F.col("lang").alias("uploader"),
                              F.col("n_chars").alias("duration"), F.concat(F.lit("http://x/"), "doc_id").alias("url")))
    files = b.table("documents").select("doc_id", F.when(F.col("doc_id") % 9 == 0, "{broken").otherwise(good).alias("json"))
    return PG.sidecar_rows(files)


@query("a16_articles_of_posts", r"""SELECT doc_id AS post_id, source AS title, '2024-01-02' AS date, lang AS slug, CASE WHEN doc_id % 2 = 0 THEN lpad(CAST(doc_id AS VARCHAR), 11, 'x') END AS youtube_id,
      array_to_string([t FOR t IN [regexp_replace(l, '^[\s\x{a0}]+|[\s\x{a0}]+$', '', 'g') FOR l IN regexp_split_to_array(text, '[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]')] IF t <> ''], chr(10)) AS text, 'http://p/' || doc_id AS url,
      doc_id % 4 || ',' || doc_id % 7 AS categories FROM documents WHERE NOT regexp_matches(text, '[<>&]')""")
def articles_of_posts(b):
    return articles(b.table("documents").filter(~F.col("text").rlike("[<>&]")))


@query("a16_articles_of_all_posts", rf"""SELECT doc_id AS post_id, source AS title, '2024-01-02' AS date, lang AS slug, CASE WHEN doc_id % 2 = 0 THEN lpad(CAST(doc_id AS VARCHAR), 11, 'x') END AS youtube_id,
      array_to_string([t FOR t IN [regexp_replace(l, '^[\s\x{{a0}}]+|[\s\x{{a0}}]+$', '', 'g') FOR l IN regexp_split_to_array(d, '[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]')] IF t <> ''], chr(10)) AS text, 'http://p/' || doc_id AS url,
      doc_id % 4 || ',' || doc_id % 7 AS categories FROM (SELECT *, {DECODED} AS d FROM (SELECT *, '<p>' || text || '</p>' AS html FROM documents))""")
def articles_of_all_posts(b):
    return articles(b.table("documents"))


def articles(docs):
    frame = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit('<p><iframe src="https://www.youtube.com/embed/'), F.lpad(F.col("doc_id").cast("string"), 11, "x"), F.lit('"></iframe>'))).otherwise("<p>")
    post = F.to_json(F.struct(F.col("doc_id").alias("id"), F.struct(F.concat(F.lit("<b>"), "source", F.lit("</b>")).alias("rendered")).alias("title"),
                              F.struct(F.concat(frame, "text", F.lit("</p>")).alias("rendered")).alias("content"), F.lit("2024-01-02T10:00:00").alias("date"), F.col("lang").alias("slug"),
                              F.concat(F.lit("http://p/"), "doc_id").alias("link"), F.array(F.col("doc_id") % 4, F.col("doc_id") % 7).alias("categories")))
    return PG.articles_of_posts(docs.select(post.alias("json")))


ENTRY_PAGE = """concat(html, CASE WHEN page_id % 3 <> 0 THEN concat('<a href="//files/videoabc/A_', page_id, '.mp4"><a href="//files/videoabc/B_', page_id, '.mp4"><img src="/fsw/sign/png/M', page_id, '-CG_white_1">') ELSE '' END,
    CASE page_id % 4 WHEN 0 THEN concat('<span class="entry-name big" id=x> Name ', page_id, ' </span>') WHEN 1 THEN concat('<h2 class=z>Head ', page_id, '</h2>') ELSE '' END,
    CASE WHEN page_id % 5 = 0 THEN concat('<div class="translate-text"> word', page_id, '</div>') ELSE '' END)"""


@query("a17_dictionary_entries", """SELECT page_id AS id, CASE page_id % 4 WHEN 0 THEN 'Name ' || page_id WHEN 1 THEN 'Head ' || page_id ELSE 'abc-' || page_id END AS name, CASE WHEN page_id % 5 = 0 THEN 'word' || page_id ELSE '' END AS translation,
    'videoabc/A_' || page_id || '.mp4|videoabc/B_' || page_id || '.mp4' AS videos, 'M' || page_id AS fsw_codes FROM pages WHERE page_id % 3 <> 0""")
def dictionary_entries(b):
    pages = b.table("pages").select(F.col("page_id").alias("id"), F.expr(ENTRY_PAGE).alias("html"))
    out = PG.dictionary_entries(pages, "videoabc", "abc")
    return out.select("id", "name", "translation", F.array_join("videos", "|").alias("videos"), F.array_join("fsw_codes", "|").alias("fsw_codes"))


SIGN_PAGE = """concat(html, '<iframe src="https://www.youtube.com/embed/v', page_id, '?rel=0"><iframe src="https://www.youtube.com/embed/w', page_id, '"><iframe src="https://www.youtube.com/embed/v', page_id, '">',
    '<img src="https://img.youtube.com/vi/w', page_id, '/0.jpg"><img src="https://img.youtube.com/vi/t', page_id, '/0.jpg"><img src="/_images/tvaryruky/', page_id, '.png">',
    CASE WHEN page_id % 2 = 0 THEN concat('<meta property="og:title" content="Sign ', page_id, ' - site">') ELSE '' END)"""


@query("a18_sign_page_facts", """SELECT page_id, 'v' || page_id || ',w' || page_id || ',t' || page_id AS youtube_ids, CASE WHEN page_id % 2 = 0 THEN 'Sign ' || page_id ELSE url END AS title, '/_images/tvaryruky/' || page_id || '.png' AS hand_shapes FROM pages""")
def sign_page_facts(b):
    pages = b.table("pages").select("page_id", F.col("url").alias("slug"), F.expr(SIGN_PAGE).alias("html"))
    out = PG.sign_page_facts(pages, "site")
    return out.select("page_id", F.array_join("youtube_ids", ",").alias("youtube_ids"), "title", F.array_join("hand_shapes", ",").alias("hand_shapes"))


@query("a19_listing_links", """WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="(/([^/"]+))"', 1)) AS href FROM pages) SELECT substr(href, 2) AS slug, '' AS id, href, min(page_id) AS first_page FROM l GROUP BY href""")
def listing_links(b):
    return PG.listing_links(b.table("pages"), r'href="(/([^/"]+)())"')


@query("a19_sign_links", """SELECT 'word' || k AS slug, CAST(k AS VARCHAR) AS id, '/word' || k || '/posunok-' || k || '/' AS href, min(page_id) AS first_page FROM (SELECT page_id, page_id // 3 AS k FROM pages) GROUP BY k""")
def sign_links(b):
    html = F.expr("concat(html, '<a href=\"/word', page_id div 3, '/posunok-', page_id div 3, '/\">')")
    return PG.listing_links(b.table("pages").select("page_id", html.alias("html")))


@query("a23_extended_reexport", """WITH s AS (SELECT l_orderkey || '_x_' || lpad(CAST(l_linenumber AS VARCHAR), 8, '0') AS segment_id, l_orderkey || '_x' AS stem, l_suppkey FROM lineitem WHERE l_returnflag = 'A')
    SELECT segment_id, stem, CASE WHEN o_orderstatus = 'F' THEN '/first/' ELSE '/second/' END || stem AS pose_path, CASE WHEN l_suppkey % 2 = 0 THEN CAST(l_suppkey AS BIGINT) ELSE 0 END AS start_frame
    FROM s JOIN orders ON o_orderkey = CAST(split_part(stem, '_', 1) AS BIGINT) WHERE o_orderstatus IN ('F', 'O')""")
def extended_reexport(b):
    from tierloom.operators.exports import extended_sources

    items = b.table("lineitem")
    source = F.when(F.col("l_returnflag") == "A", "existing").otherwise("other")
    manifest = items.select(F.format_string("%d_x_%08d", "l_orderkey", "l_linenumber").alias("segment_id"), source.alias("source"), F.when(F.col("l_suppkey") % 2 == 0, F.col("l_suppkey")).alias("start_frame"))
    stem = F.concat(F.col("o_orderkey").cast("string"), F.lit("_x"))
    o = b.table("orders")
    roots = o.filter("o_orderstatus = 'F'").select(stem.alias("stem"), F.lit(0).alias("root_no"), F.concat(F.lit("/first/"), stem).alias("pose_path")).unionByName(
        o.filter("o_orderstatus in ('F', 'O')").select(stem.alias("stem"), F.lit(1).alias("root_no"), F.concat(F.lit("/second/"), stem).alias("pose_path")))
    return extended_sources(manifest, roots)


@query("a24_evaluation_report", f"WITH {MQ.PER_CLASS_SQL} SELECT 'baseline' AS model, 'class' AS part, label, support FROM per UNION ALL SELECT 'baseline', 'metrics', '', (SELECT count(*) FROM noisy)")
def evaluation_report(b):
    s = MQ.noisy_scored(b)
    out = sinks.evaluation_report(ME.accuracy(s), ME.per_class(s, MQ.classes(b)), "baseline")
    number = F.coalesce(F.get_json_object("json", "$.support"), F.get_json_object("json", "$.n_samples")).cast("long")
    return out.select("model", "part", "label", number.alias("support"))


@query("a26_sentence_manifest", f"""WITH {CLIPS_SQL}, al AS (SELECT {ALIGN_COLS} FROM cues JOIN clips USING (stem)), m AS (SELECT segment_id, stem, start_ms, end_ms, text, lower(trim(text)) AS label FROM al)
    SELECT segment_id, stem, start_ms, end_ms, regexp_replace(label, '_\\d+$', '') AS label FROM m WHERE label IN (SELECT label FROM m GROUP BY label HAVING count(*) >= 1)""")
def sentence_manifest(b):
    from tierloom.operators.exports import sentence_manifest as run

    aligned = align_to_frames(b.cues, clips(b).drop("bytes")).withColumn("status", F.lit("approved"))
    return run(aligned, 1).select("segment_id", "stem", "start_ms", "end_ms", "label")


@query("a26_sign_manifest", """WITH p AS (SELECT stem || '_' || line_no AS segment_id, upper(word) || '-1' AS g, word FROM pairings WHERE partkey % 5 = 0) SELECT segment_id, lower(g) AS label, word AS text FROM p WHERE lower(g) IN (SELECT lower(g) FROM p GROUP BY 1 HAVING count(*) >= 3)""")
def sign_manifest(b):
    from tierloom.operators.exports import sign_manifest as run

    p = b.pairings.select(F.concat_ws("_", F.col("stem").cast("string"), F.col("line_no").cast("string")).alias("pairing_id"), F.concat(F.upper("word"), F.lit("-1")).alias("gloss_id"), "word",
                          F.expr(MQ.PAIR_STATUS).alias("status"))
    return run(p, 3).select("segment_id", "label", "text")


@query("a27_media_metadata", rf"""SELECT 'fin-vocab' AS source, name AS filename, trim(replace(replace(name, '.mp4', ''), '-', ' ')) AS label, 'http://m/' || name AS url, '/videos/fin-vocab/' || name AS path, name IN (SELECT name FROM n WHERE p_partkey % 3 = 0) AS present
    FROM n WHERE NOT (regexp_matches(lower(name), '{'|'.join(p.lower() for p in T.HUNGARIAN + T.GERMAN + T.ENGLISH + T.ITALIAN)}') OR regexp_matches(name, '^\d+_\d+_') OR regexp_matches(name, '^\d+_\d+\.mp4$') OR regexp_matches(name, '^\d\d-[A-Z]'))""".replace(
    "SELECT 'fin-vocab'", f"WITH n AS (SELECT p_partkey, {FILE_NAME} AS name FROM part) SELECT 'fin-vocab'", 1))
def media_metadata(b):
    rows = b.table("part").select("p_partkey", F.expr(FILE_NAME).alias("name"))
    item = F.struct(F.col("p_partkey").alias("id"), F.struct(F.lit("t").alias("rendered")).alias("title"), F.concat(F.lit("http://m/"), "name").alias("source_url"))
    listing = rows.groupBy(F.floor(F.col("p_partkey") / 100).alias("page")).agg(F.to_json(F.collect_list(item)).alias("json"))
    return PG.media_metadata(listing, "fin-vocab", T.is_financial_vocabulary, "/videos", rows.filter("p_partkey % 3 = 0").select(F.col("name").alias("filename")))


@query("a02_inventory_read_or_made", "SELECT '/v/' || o_orderkey || '.mp4' AS path, CAST(o_custkey % 50 AS DOUBLE) AS duration_sec, o_orderstatus = 'F' AS pose_extracted FROM orders")
def inventory_read_or_made(b):
    from tierloom.session import new_folder

    path = new_folder(b.spark, "inventory")
    name = F.format_string("%d.mp4", "o_orderkey")
    made = b.table("orders").select(
        F.concat(F.lit("/v/"), name).alias("path"), name.alias("filename"), (F.col("o_custkey") % 50).cast("double").alias("duration_sec"), F.lit(640).alias("width"), F.lit(480).alias("height"),
        F.lit(25.0).alias("fps"), F.lit(1.0).alias("file_size_mb"), F.lit("h264").alias("codec"), (F.col("o_orderstatus") == "F").alias("pose_extracted"))
    tables.load_or_create_inventory(b.spark, path, lambda: made)
    again = tables.load_or_create_inventory(b.spark, path, lambda: made.filter("false"))
    return again.select("path", "duration_sec", "pose_extracted")


@query("a25_index_saved_and_loaded", f"WITH {MQ.SIM_SQL} SELECT vec_id AS id, 'L' || label AS label, round(list_sum([v[i] * i FOR i IN range(1, 65)]), 6) AS weighted FROM unit")
def index_saved_and_loaded(b):
    from tierloom.operators.search import build_index
    from tierloom.session import new_folder

    path = new_folder(b.spark, "index")
    sinks.save_index(build_index(MQ.vectors(b)), path)
    weighted = F.aggregate(F.transform("vector", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    return sinks.load_index(b.spark, path).select("id", "label", F.round(weighted, 6).alias("weighted"))


@query("a04_webvtt_read_back", "SELECT stem, start_ms, end_ms, trim(text) AS text FROM cues WHERE trim(text) <> ''")
def webvtt_read_back(b):
    from tierloom.session import new_folder

    path = new_folder(b.spark, "webvtt")
    subtitles.write_webvtt(b.cues, path)
    cues = subtitles.read_webvtt(b.spark, path)
    return cues.select(F.col("stem").cast(b.cues.schema["stem"].dataType), "start_ms", "end_ms", "text")
