"""Queries over labels, ids, tokens, file names and page text."""

from __future__ import annotations

from html.entities import html5, name2codepoint

from pyspark.sql import functions as F

from tierloom.functions import labels as LB
from tierloom.functions import text as T
from tierloom.functions.timecode import frame_to_ms, ms_to_frame
from tierloom.operators import glossary as G
from tierloom.plans.registry import query

STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
NORM_WORD = r"regexp_replace(lower(" + STRIP + r"), '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g')"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@query("d01_normalise_label", r"""SELECT segment_id, regexp_replace(lower(trim(label)), '_\d+$', '') AS label FROM manifest""")
def normalise_label(b):
    return b.manifest.select("segment_id", T.normalise_label("label").alias("label"))


REVIEWED = "CASE segment_id % 3 WHEN 0 THEN '' WHEN 1 THEN '  ' ELSE p_name END"


@query("d02_derive_label", f"""SELECT segment_id, CASE WHEN trim(r) = '' THEN label ELSE r END AS label
    FROM (SELECT *, {REVIEWED} AS r FROM manifest)""")
def derive_label(b):
    return b.manifest.select("segment_id", T.derive_label(F.expr(REVIEWED), "label").alias("label"))


@query("d03_plain_label", "SELECT segment_id, lower(trim('  ' || label || ' ')) AS label FROM manifest")
def plain_label(b):
    return b.manifest.select("segment_id", T.plain_label(
        F.concat(F.lit("  "), "label", F.lit(" "))).alias("label"))


WORDS_SQL = r"""words AS (SELECT doc_id, raw FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\s+')) AS raw FROM documents) WHERE raw <> '')"""


@query("d04_normalise_word", f"""WITH {WORDS_SQL} SELECT word, count(*) AS n, count(DISTINCT doc_id) AS docs
    FROM (SELECT doc_id, {NORM_WORD.format('raw')} AS word FROM words) GROUP BY word""")
def normalise_word(b):
    words = b.table("documents").select("doc_id", F.explode(T.tokens("text")).alias("raw"))
    return words.groupBy(T.normalise_word("raw").alias("word")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("docs"))


@query("d05_tokenise", f"""WITH {WORDS_SQL} SELECT doc_id, count(*) AS n, sum(length(raw))::BIGINT AS letters FROM words GROUP BY doc_id""")
def tokenise(b):
    words = b.table("documents").select("doc_id", F.explode(T.tokens("text")).alias("raw"))
    return words.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("raw")).alias("letters"))


GLOSS_VALUE = """CASE p_partkey % 6 WHEN 0 THEN upper(w) || '-1' WHEN 1 THEN initcap_w || '!' WHEN 2 THEN 'A' WHEN 3 THEN ' '
    WHEN 4 THEN 'unknown' ELSE w END"""
VALUES_SQL = f"""vals AS (SELECT p_partkey, {GLOSS_VALUE} AS value FROM (SELECT p_partkey, string_split(p_name, ' ')[1] AS w,
    upper(left(p_name, 1)) || substr(string_split(p_name, ' ')[1], 2) AS initcap_w FROM part))"""
FIRST_SQL = f"""first_gloss AS (SELECT {NORM_WORD.format('form')} AS key, min(gloss_id) AS g FROM glossary GROUP BY key)"""


def gloss_values(b):
    rows = b.table("part").select("p_partkey", F.split("p_name", " ")[0].alias("w")).withColumn("initcap_w", F.initcap("w"))
    return rows.select("p_partkey", F.expr(GLOSS_VALUE).alias("value"))


@query("d06_parse_gloss", f"""WITH {VALUES_SQL}, {FIRST_SQL}, v AS (SELECT p_partkey, trim(value) AS v FROM vals),
    m AS (SELECT *, regexp_matches(v, '^[A-Z][A-Z0-9_-]+$') AS is_id FROM v)
    SELECT p_partkey, CASE WHEN is_id THEN '' ELSE lower(v) END AS word, CASE WHEN is_id THEN v ELSE coalesce(g, '') END AS gloss_id
    FROM m LEFT JOIN first_gloss ON key = {NORM_WORD.format('v')} AND NOT is_id AND key <> ''""")
def parse_gloss(b):
    return G.parse_gloss(gloss_values(b), "value", b.glossary).select("p_partkey", "word", "gloss_id")


RAW_INPUT = """CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN w || ', Other ' WHEN 2 THEN upper(w) || '-1' WHEN 3 THEN 'zzz, ' || w ELSE w END"""
FALLBACK = "CASE p_partkey % 2 WHEN 0 THEN upper(w2) || '-1' ELSE w2 END"


@query("d07_resolve_gloss_input", f"""WITH {FIRST_SQL}, src AS (SELECT p_partkey, string_split(p_name, ' ')[1] AS w, string_split(p_name, ' ')[2] AS w2 FROM part),
    i AS (SELECT *, {RAW_INPUT} AS raw, {FALLBACK} AS fb FROM src),
    p AS (SELECT *, [lower(trim(x)) FOR x IN string_split(raw, ',') IF trim(x) <> ''] AS parts, regexp_matches(raw, '^[A-Z][A-Z0-9_-]+$') AS is_id,
        regexp_matches(fb, '^[A-Z][A-Z0-9_-]+$') AS fb_id FROM i),
    k AS (SELECT *, CASE WHEN raw = '' THEN fb WHEN contains(raw, ',') THEN parts[1] WHEN is_id THEN NULL ELSE raw END AS key0 FROM p)
    SELECT p_partkey,
      CASE WHEN raw = '' THEN CASE WHEN gl.form IS NOT NULL THEN gl.form WHEN fb_id THEN '' ELSE lower(fb) END
        WHEN contains(raw, ',') THEN array_to_string(parts, ', ') WHEN is_id THEN '' ELSE lower(raw) END AS word,
      CASE WHEN raw = '' THEN CASE WHEN gl.form IS NOT NULL OR fb_id THEN fb ELSE coalesce(f.g, '') END
        WHEN contains(raw, ',') THEN coalesce(f.g, fb) WHEN is_id THEN raw ELSE coalesce(f.g, '') END AS gloss_id
    FROM k LEFT JOIN first_gloss f ON f.key = {NORM_WORD.format('key0')} LEFT JOIN glossary gl ON gl.gloss_id = fb""")
def resolve_gloss_input(b):
    rows = b.table("part").select("p_partkey", F.split("p_name", " ")[0].alias("w"), F.split("p_name", " ")[1].alias("w2"))
    rows = rows.select("p_partkey", F.expr(RAW_INPUT).alias("raw"), F.expr(FALLBACK).alias("fb"))
    return G.resolve_gloss_input(rows, "raw", "fb", b.glossary).select("p_partkey", "word", "gloss_id")


@query("d08_ids", """SELECT o_orderkey, 'v_' || o_orderkey || '_' || lpad(CAST(o_custkey * 7 AS VARCHAR), 8, '0') || CASE WHEN o_custkey % 2 = 0 THEN '_r' ELSE '_l' END
      || CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN '_E' WHEN 2 THEN '_R' ELSE '_M' || o_custkey END AS pairing_id, 'v_' || o_orderkey AS stem,
      o_custkey * 7 AS start_ms, CASE WHEN o_custkey % 2 = 0 THEN 'right' ELSE 'left' END AS hand,
      CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'E' WHEN 2 THEN 'R' ELSE 'M' || o_custkey END AS tag FROM orders""")
def ids(b):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    tag = F.when(key % 4 == 1, "E").when(key % 4 == 2, "R").when(key % 4 == 3, F.concat(F.lit("M"), cust.cast("string")))
    pid = T.pairing_id(F.concat(F.lit("v_"), key.cast("string")), cust * 7, F.when(cust % 2 == 0, "right").otherwise("left"), tag)
    return b.table("orders").select(key, pid.alias("pairing_id")).select("*", T.parse_pairing_id("pairing_id").alias("p")).select(
        "o_orderkey", "pairing_id", "p.*")


# Entities that occur in the fixture, decoded by nested replacement with the ampersand last.
_ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&nbsp;": chr(name2codepoint["nbsp"]), "&#39;": "'", "&#x27;": "'",
             "&copy;": chr(name2codepoint["copy"]), "&middot;": chr(name2codepoint["middot"]), "&mdash;": chr(name2codepoint["mdash"]), "&eacute;": "é"}
DECODED = r"regexp_replace(regexp_replace(html, '(?i)<(?:br|/p|/div|/h[1-6]|/li)[^>]*>', chr(10), 'g'), '<[^>]+>', '', 'g')"
for _name, _char in _ENTITIES.items():
    DECODED = f"replace({DECODED}, {q(_name)}, {q(_char)})"
DECODED = f"replace({DECODED}, '&amp;', '&')"


# HTML references as the page rules read them: a name with its semicolon, else the longest old name, which needs
# none, at the start of what follows an ampersand, else a number; decoded once, from left to right.
_NAMES = "MAP {" + ", ".join(f"{q(n)}: {q(c)}" for n, c in html5.items()) + "}"
_OLD = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=len, reverse=True))
_WINDOWS = "[" + ", ".join(q(bytes([c]).decode("cp1252", "ignore") or chr(c)) for c in range(0x80, 0xA0)) + "]"
_DIGITS = "regexp_replace(num, '^[xX]?0*', '')"
_CODE = f"""CASE WHEN regexp_matches(num, '^[xX]') THEN CASE WHEN length({_DIGITS}) > 6 THEN 1114112 ELSE CAST('0x0' || {_DIGITS} AS BIGINT) END
    ELSE CASE WHEN length({_DIGITS}) > 7 THEN 1114112 ELSE CAST('0' || {_DIGITS} AS BIGINT) END END"""
STRIPPED = r"regexp_replace(regexp_replace(html, '(?i)<(?:br|/p|/div|/h[1-6]|/li)[^>]*>', chr(10), 'g'), '<[^>]+>', '', 'g')"
REFERENCES_SQL = rf"""names AS (SELECT {_NAMES} AS names),
    pieces AS (SELECT page_id, i, pieces[i] AS p FROM (SELECT page_id, string_split({STRIPPED}, '&') AS pieces FROM pages), LATERAL (SELECT unnest(range(1, len(pieces) + 1)) AS i)),
    refs AS (SELECT *, regexp_extract(p, '^([0-9A-Za-z]{{1,31}};)', 1) AS long_name, regexp_extract(p, '^({_OLD})', 1) AS old_name, regexp_extract(p, '^#([xX][0-9A-Fa-f]+|[0-9]+);?', 1) AS num FROM pieces),
    coded AS (SELECT *, CASE WHEN num <> '' THEN {_CODE} END AS code, names[long_name] AS long_char, names[old_name] AS old_char FROM refs, names),
    decoded AS (SELECT page_id, string_agg(CASE WHEN i = 1 THEN p
        WHEN num <> '' THEN CASE WHEN code BETWEEN 128 AND 159 THEN {_WINDOWS}[code - 127] WHEN code = 0 OR code BETWEEN 55296 AND 57343 OR code > 1114111 THEN chr(65533)
          WHEN code BETWEEN 1 AND 8 OR code = 11 OR code BETWEEN 14 AND 31 OR code = 127 OR code BETWEEN 64976 AND 65007 OR code % 65536 >= 65534 THEN '' ELSE chr(CAST(code AS INT)) END
          || regexp_replace(p, '^#([xX][0-9A-Fa-f]+|[0-9]+);?', '')
        WHEN long_char IS NOT NULL THEN long_char || substr(p, length(long_name) + 1) WHEN old_char IS NOT NULL THEN old_char || substr(p, length(old_name) + 1)
        ELSE '&' || p END, '' ORDER BY i) AS d FROM coded GROUP BY page_id)"""


@query("d09_strip_html", rf"""WITH {REFERENCES_SQL} SELECT page_id, array_to_string([t FOR t IN [regexp_replace(l, '^[\s\x{{a0}}]+|[\s\x{{a0}}]+$', '', 'g') FOR l IN regexp_split_to_array(d, '[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]')] IF t <> ''], chr(10)) AS text
    FROM pages LEFT JOIN decoded USING (page_id)""")
def strip_html(b):
    return b.table("pages").select("page_id", T.strip_html("html").alias("text"))


# Three link forms in turn, with an 11-character id derived from the page number.
VIDEO_PAGE = """concat(html, CASE page_id % 4 WHEN 0 THEN concat('<a href="https://youtu.be/', lpad(cast(page_id * 31 as string), 11, 'Ab_-'), '">')
    WHEN 1 THEN concat('<iframe src="https://www.youtube.com/embed/', lpad(cast(page_id * 31 as string), 11, 'Ab_-'), '?rel=0"></iframe><a href="https://youtu.be/zzzzzzzzzzz">')
    WHEN 2 THEN concat('<a href="https://youtube.com/watch?v=', lpad(cast(page_id * 31 as string), 11, 'Ab_-'), '&t=1">') ELSE '' END)"""
VIDEO_PAGE_SQL = VIDEO_PAGE.replace("as string", "AS VARCHAR").replace("concat(html, CASE", "(html || CASE")


@query("d10_video_id", rf"""SELECT page_id, coalesce(nullif(regexp_extract(h, 'youtube\.com/embed/([A-Za-z0-9_-]{{11}})', 1), ''),
      nullif(regexp_extract(h, 'youtube\.com/watch\?v=([A-Za-z0-9_-]{{11}})', 1), ''), nullif(regexp_extract(h, 'youtu\.be/([A-Za-z0-9_-]{{11}})', 1), '')) AS youtube_id
    FROM (SELECT page_id, {VIDEO_PAGE_SQL} AS h FROM pages)""")
def video_id(b):
    return b.table("pages").select("page_id", T.video_id(F.expr(VIDEO_PAGE)).alias("youtube_id"))


LATIN1 = "".join(chr(c) for c in range(0xA0, 0x100))
LATIN2 = bytes(range(0xA0, 0x100)).decode("iso-8859-2")


@query("d11_repair_latin2", f"""SELECT conv_id, turn, CASE WHEN regexp_full_match(text, '[\\x{{00}}-\\x{{ff}}]*', 's') THEN translate(text, {q(LATIN1)}, {q(LATIN2)}) ELSE text END AS text
    FROM conversations""")
def repair_latin2(b):
    return b.table("conversations").select("conv_id", "turn", T.repair_latin2("text").alias("text"))


@query("d12_clean_title", """SELECT segment_id, label AS title FROM manifest""")
def clean_title(b):
    prefix = F.when(F.col("segment_id") % 3 == 0, "Posunok: ").when(F.col("segment_id") % 3 == 1, "POSUNOK:").otherwise("")
    return b.manifest.select("segment_id", T.clean_title(F.concat(prefix, "label")).alias("title"))


@query("d13_camera_angle", """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN 'side' ELSE 'front' END AS by_position,
      CASE l_returnflag WHEN 'A' THEN 'front' ELSE 'unknown' END AS by_prefix,
      CASE l_linenumber WHEN 6 THEN 'front' WHEN 7 THEN 'side' ELSE 'unknown' END AS by_degrees FROM lineitem""")
def camera_angle(b):
    n = F.col("l_linenumber")
    degrees = F.concat(F.lit("w_wd_"), F.when(n == 6, "60").when(n == 7, "90").otherwise("30"), F.lit("_x"))
    return b.table("lineitem").select(
        "l_orderkey", "l_linenumber", T.angle_by_position(n).alias("by_position"),
        T.angle_by_prefix(F.concat_ws("_", "l_returnflag", "l_linestatus")).alias("by_prefix"),
        T.angle_by_degrees(degrees).alias("by_degrees"))


@query("d14_dictionary_label", """SELECT p_partkey, lower(trim(CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_type WHEN 2 THEN p_brand ELSE p_type END)) AS label FROM part""")
def dictionary_label(b):
    n = F.col("p_partkey") % 4
    name = F.when(n == 0, F.col("p_name")).when(n == 1, F.concat(F.lit("abc-"), "p_partkey")).otherwise("")
    translation = F.when((n == 1) | (n == 3), F.col("p_type")).otherwise("")
    stem = F.concat(F.lit("A_"), "p_brand")
    return b.table("part").select("p_partkey", T.dictionary_label(name, translation, stem, "abc").alias("label"))


STEM = """CASE o_orderkey % 4 WHEN 0 THEN concat('video', o_orderkey) WHEN 1 THEN concat('video', o_orderkey - 1, '_60')
    WHEN 2 THEN concat({date}, '_x') ELSE concat('zz', o_orderkey) END"""
STEM_SQL = STEM.format(date="strftime(o_orderdate + INTERVAL 15 YEAR, '%Y%m%d')")
STEM_SPARK = STEM.format(date="date_format(o_orderdate + INTERVAL 15 YEAR, 'yyyyMMdd')")
SOURCES_SQL = f"""stems AS (SELECT o_orderkey, {STEM_SQL} AS stem FROM orders),
    videos AS (SELECT 'video' || o_orderkey AS stem, o_orderpriority AS source FROM orders WHERE o_orderkey % 8 = 0),
    placed AS (SELECT s.o_orderkey, s.stem, coalesce(a.source, b.source, CASE WHEN regexp_matches(s.stem, '^\\d{{8}}(_|$)')
      AND TRY_CAST(left(s.stem, 4) AS INT) BETWEEN 2010 AND 2030 THEN 'corpus' END) AS source FROM stems s LEFT JOIN videos a ON a.stem = s.stem
      LEFT JOIN videos b ON b.stem || '_60' = s.stem)"""


def placed_stems(b):
    stems = b.table("orders").select("o_orderkey", F.expr(STEM_SPARK).alias("stem"))
    videos = b.table("orders").filter("o_orderkey % 8 = 0").select(
        F.concat(F.lit("video"), "o_orderkey").alias("stem"), F.col("o_orderpriority").alias("source"))
    return LB.source_of(stems, videos)


@query("d15_source_of_stem", f"WITH {SOURCES_SQL} SELECT o_orderkey, stem, source FROM placed")
def source_of_stem(b):
    return placed_stems(b).select("o_orderkey", "stem", "source")


FILE_NAME = """CASE p_partkey % 8 WHEN 0 THEN concat(replace(p_name, ' ', '-'), '.mp4') WHEN 1 THEN concat(p_size, '_', p_partkey, '_', replace(p_name, ' ', '_'), '.mp4')
    WHEN 2 THEN concat(p_size, '_', p_partkey, '.mp4') WHEN 3 THEN concat('der-', replace(p_name, ' ', '-'), '.mp4') WHEN 4 THEN concat('0', p_partkey % 9, '-', upper(p_name), '.mp4')
    WHEN 5 THEN concat('0', p_partkey % 9, '-', replace(p_name, ' ', '-'), '1.mp4') WHEN 6 THEN concat('Video-', p_partkey, '.mp4') ELSE concat(p_size, '_die_', p_name, '_DGS.mp4') END"""


@query("d16_language_rules", rf"""SELECT p_partkey, name, NOT (regexp_matches(lower(name), {q('|'.join(p.lower() for p in T.HUNGARIAN + T.GERMAN + T.ENGLISH + T.ITALIAN))})
        OR regexp_matches(name, '^\d+_\d+_') OR regexp_matches(name, '^\d+_\d+\.mp4$') OR regexp_matches(name, '^\d\d-[A-Z]')) AS financial,
      contains(name, '-') AND NOT contains(name, '_DGS') AND NOT starts_with(name, 'Video-')
        AND NOT (ends_with(name, '1.mp4') AND len(string_split(name, '-')) <= 3) AS career
    FROM (SELECT p_partkey, {FILE_NAME} AS name FROM part)""")
def language_rules(b):
    rows = b.table("part").select("p_partkey", F.expr(FILE_NAME).alias("name"))
    return rows.select("p_partkey", "name", T.is_financial_vocabulary("name").alias("financial"),
                       T.is_career_vocabulary("name").alias("career"))


VOCAB = """CASE p_partkey % 4 WHEN 0 THEN 'fin-vocab' WHEN 1 THEN 'career-vocab' WHEN 2 THEN 'climate-vocabaction' ELSE 'other' END"""
TITLE = "CASE WHEN p_partkey % 3 = 0 THEN concat('02 &#8211; rooms – ', p_type) ELSE '' END"


@query("d17_label_from_file", rf"""SELECT p_partkey, CASE WHEN source IN ('fin-vocab', 'climate-vocabaction') THEN trim(replace(stem, '-', ' '))
      WHEN source = 'career-vocab' AND title <> '' THEN trim(string_split(replace(title, '&#8211;', '–'), '–')[-1])
      WHEN source = 'career-vocab' THEN trim(replace(regexp_replace(stem, '^(\d+|0[^-]*)(-|$)', ''), '-', ' ')) ELSE stem END AS label
    FROM (SELECT p_partkey, {VOCAB} AS source, {TITLE} AS title, replace({FILE_NAME}, '.mp4', '') AS stem FROM part)""")
def label_from_file(b):
    return b.table("part").select("p_partkey", T.label_from_file(F.expr(FILE_NAME), F.expr(VOCAB), F.expr(TITLE)).alias("label"))


@query("d18_safe_file_name", r"""SELECT conv_id, turn, left(regexp_replace(regexp_replace(regexp_replace(strip_accents(t), '[^A-Za-z0-9_\s\-.]', '', 'g'),
      '\s+', '_', 'g'), '^[_.]+|[_.]+$', '', 'g'), 80) AS name FROM (SELECT conv_id, turn, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM conversations)""")
def safe_file_name(b):
    return b.table("conversations").select("conv_id", "turn", T.safe_file_name("text").alias("name"))


@query("d19_label_codes", """SELECT label, row_number() OVER (ORDER BY label) - 1 AS code FROM (SELECT DISTINCT label FROM manifest)""")
def label_codes(b):
    return LB.label_codes(b.manifest)


@query("d19_encode_decode", """SELECT segment_id, dense_rank() OVER (ORDER BY label) - 1 AS code, label AS decoded FROM manifest""")
def encode_decode(b):
    codes = LB.label_codes(b.manifest)
    coded = LB.encode(b.manifest.select("segment_id", "label"), codes).drop("label")
    return LB.decode(coded, codes, label="label").withColumnRenamed("label", "decoded")


USED = "CASE WHEN p_partkey % 3 = 0 THEN concat(upper({w}), '-', p_size) ELSE concat(upper({w}), '-', p_size % 5 + 1) END"


@query("d20_next_gloss_id", f"""WITH used AS (SELECT DISTINCT {USED.format(w="string_split(p_name, ' ')[1]")} AS id FROM part),
    bases AS (SELECT DISTINCT string_split(p_name, ' ')[1] AS base FROM part)
    SELECT base, upper(base) || '-' || min(n) AS gloss_id FROM bases, (SELECT unnest(range(1, 1000)) AS n)
    WHERE upper(base) || '-' || n NOT IN (SELECT id FROM used) GROUP BY base""")
def next_gloss_id(b):
    used = b.table("part").select(F.expr(USED.format(w="split(p_name, ' ')[0]")).alias("gloss_id"))
    bases = b.table("part").select(F.split("p_name", " ")[0].alias("base")).distinct()
    return G.next_gloss_id(bases, "base", used)


@query("d21_ms_and_frames", """SELECT stem, cue_no, CAST(floor(start_ms * 29.97::DOUBLE / 1000) AS BIGINT) AS frame,
      CAST(floor(cue_no * 1000 / 29.97::DOUBLE) AS BIGINT) AS ms FROM cues""")
def ms_and_frames(b):
    return b.cues.select("stem", "cue_no", ms_to_frame("start_ms", F.lit(29.97)).alias("frame"),
                         frame_to_ms("cue_no", F.lit(29.97)).alias("ms"))


@query("f04_reverse_index", f"SELECT {NORM_WORD.format('form')} AS word, gloss_id, gloss_id AS entry, form_no FROM glossary")
def reverse_index(b):
    return G.reverse_index(b.glossary)


@query("f05_match_sentence", f"""WITH {FIRST_SQL}, t AS (SELECT p_partkey, string_split(p_name || ' Unknown', ' ') AS ws FROM part),
    w AS (SELECT p_partkey, i - 1 AS token_no, ws[i] AS raw FROM t, LATERAL (SELECT unnest(range(1, len(ws) + 1)) AS i))
    SELECT p_partkey, token_no, raw, {NORM_WORD.format('raw')} AS word, g AS gloss_id, CASE WHEN g IS NULL THEN 0 ELSE 1 END AS n_glosses, g IS NOT NULL AS mapped
    FROM w LEFT JOIN first_gloss ON key = {NORM_WORD.format('raw')}""")
def match_sentence(b):
    texts = b.table("part").select("p_partkey", F.concat("p_name", F.lit(" Unknown")).alias("t"))
    return G.match_tokens(texts, "t", b.glossary)


@query("g08_glossary_totals", "SELECT count(DISTINCT gloss_id) AS n_glosses, count(form) AS n_forms FROM glossary")
def glossary_totals(b):
    return G.glossary_totals(b.glossary)


@query("f12_glossary_edits", """WITH fresh AS (SELECT DISTINCT 'BRAND-' || string_split(p_brand, '#')[2] AS gloss_id, lower(p_brand) AS form FROM part),
    base AS (SELECT gloss_id, form, form_no FROM glossary WHERE left(gloss_id, 1) <> 'B'
      UNION ALL SELECT gloss_id, form, CAST(0 AS BIGINT) FROM fresh UNION ALL SELECT gloss_id, form || 's', CAST(1 AS BIGINT) FROM fresh)
    SELECT gloss_id, form, form_no FROM base UNION ALL SELECT gloss_id, 'extra', CAST(2 AS BIGINT) FROM fresh""")
def glossary_edits(b):
    number = F.split("p_brand", "#")[1]
    entries = b.table("part").select(F.lower(F.concat(F.lit("brand-"), number)).alias("gloss_id"), F.lower("p_brand").alias("lemma"),
                                     F.array(F.lower("p_brand"), F.concat(F.lower("p_brand"), F.lit("s"))).alias("forms")).distinct()
    drop = b.glossary.filter(F.col("gloss_id").startswith("B"))
    edited = G.add_glosses(G.remove_glosses(b.glossary, drop), entries)
    return G.add_forms(edited, entries.select(F.upper("gloss_id").alias("gloss_id"), F.lit(" extra ").alias("form")))
