"""Queries over cues and recognised text."""

from __future__ import annotations

from pyspark.sql import functions as F

from tierloom.functions import text as T
from tierloom.functions import timecode as TC
from tierloom.functions.chunks import rank_in_groups
from tierloom.operators import cues as C
from tierloom.plans.registry import query

STAMP = """lpad(CAST({0} // 3600000 AS VARCHAR), 2, '0') || ':' || lpad(CAST({0} // 60000 % 60 AS VARCHAR), 2, '0')
  || ':' || lpad(CAST({0} // 1000 % 60 AS VARCHAR), 2, '0') || '.' || lpad(CAST({0} % 1000 AS VARCHAR), 3, '0')"""


def similarity_sql(a: str, b: str) -> str:
    return f"""(CASE WHEN {a} = '' AND {b} = '' THEN 1.0::DOUBLE WHEN {a} = '' OR {b} = '' THEN 0.0::DOUBLE ELSE
      list_sum([CASE WHEN string_split({a}, '')[i] = string_split({b}, '')[i] THEN 1 ELSE 0 END
        FOR i IN range(1, least(length({a}), length({b})) + 1)])::DOUBLE / greatest(length({a}), length({b})) END)"""


@query("b01_time_stamps", f"""SELECT stem, cue_no, {STAMP.format('(start_ms * 977)')} AS stamp,
      start_ms * 977 AS back, {STAMP.format('CAST(floor(end_ms / 7.0 * 1000) AS BIGINT)')} AS from_seconds FROM cues""")
def time_stamps(b):
    stamp = TC.ms_to_stamp(F.col("start_ms") * 977)
    return b.cues.select("stem", "cue_no", stamp.alias("stamp"), TC.stamp_to_ms(stamp).alias("back"),
                         TC.seconds_to_stamp(F.col("end_ms") / 7.0).alias("from_seconds"))


@query("b02_positional_similarity", f"""SELECT stem, cue_no, round({similarity_sql('text', 'nxt')}, 9) AS similarity
    FROM (SELECT *, lead(text) OVER (PARTITION BY stem ORDER BY cue_no) AS nxt FROM noisy_cues) WHERE nxt IS NOT NULL""")
def positional_similarity(b):
    from tierloom.functions.chunks import next_rows

    rows = next_rows(b.noisy_cues, ["stem"], "cue_no", ["text"]).filter("next_text is not null")
    return rows.select("stem", "cue_no", F.round(T.positional_similarity(
        F.col("text"), F.col("next_text")), 9).alias("similarity"))


FOLD_SQL = f"""WITH RECURSIVE walk AS (
    SELECT stem, cue_no, start_ms, start_ms AS s, end_ms AS e, text AS t, 0 AS grp FROM noisy_cues WHERE cue_no = 0
    UNION ALL
    SELECT stem, cue_no, start_ms, CASE WHEN same THEN s ELSE start_ms END, CASE WHEN same THEN greatest(e, end_ms) ELSE end_ms END,
      CASE WHEN same AND length(text) <= length(t) THEN t ELSE text END, CASE WHEN same THEN grp ELSE grp + 1 END
    FROM (SELECT c.stem, c.cue_no, c.start_ms, c.end_ms, c.text, w.s, w.e, w.t, w.grp,
        c.start_ms - w.e <= 2000 AND {similarity_sql('w.t', 'c.text')} >= 0.85 AS same
      FROM walk w JOIN noisy_cues c ON c.stem = w.stem AND c.cue_no = w.cue_no + 1)),
  deduped AS (SELECT stem, s AS start_ms, e AS end_ms, t AS text FROM (
    SELECT *, row_number() OVER (PARTITION BY stem, grp ORDER BY cue_no DESC) AS rn FROM walk) WHERE rn = 1)"""


@query("b03_merge_near_duplicates", f"{FOLD_SQL} SELECT * FROM deduped")
def merge_near_duplicates(b):
    return C.merge_near_duplicates(b.noisy_cues).drop("cue_no")


# Cues of this fixture never end before an earlier one that they follow closely, so one pass of
# forward merging and one backward merge of a short last block describe the result.
SHORT_SQL = """WITH RECURSIVE src AS (SELECT stem, cue_no, start_ms, start_ms + 200 + (end_ms - start_ms) // 4 AS end_ms, text
      FROM noisy_cues),
  walk AS (SELECT stem, cue_no, start_ms AS s, end_ms AS e, text AS t, 0 AS grp, 0 AS run FROM src WHERE cue_no = 0
    UNION ALL
    SELECT stem, cue_no, CASE WHEN joins THEN s ELSE start_ms END, end_ms,
      CASE WHEN joins THEN t || chr(10) || text ELSE text END, CASE WHEN joins THEN grp ELSE grp + 1 END,
      CASE WHEN cut THEN run + 1 ELSE run END
    FROM (SELECT c.*, w.s, w.e, w.t, w.grp, w.run, c.start_ms - w.e > 500 AS cut,
        c.start_ms - w.e <= 500 AND w.e - w.s < 1000 AS joins
      FROM walk w JOIN src c ON c.stem = w.stem AND c.cue_no = w.cue_no + 1)),
  blocks AS (SELECT stem, grp, run, s, e, t FROM (
    SELECT *, row_number() OVER (PARTITION BY stem, grp ORDER BY cue_no DESC) AS rn FROM walk) WHERE rn = 1),
  ends AS (SELECT *, lag(s) OVER w AS ps, lag(t) OVER w AS pt, lead(e) OVER w AS ne, lead(s) OVER w AS ns, lead(t) OVER w AS nt,
      lead(grp) OVER w IS NULL AS is_last FROM blocks WINDOW w AS (PARTITION BY stem, run ORDER BY grp)),
  marked AS (SELECT *, is_last AND e - s < 1000 AND ps IS NOT NULL AS goes,
      coalesce(lead(is_last AND e - s < 1000) OVER (PARTITION BY stem, run ORDER BY grp), false) AS takes FROM ends)
  SELECT stem, s AS start_ms, CASE WHEN takes THEN ne ELSE e END AS end_ms,
    CASE WHEN takes THEN t || chr(10) || nt ELSE t END AS text FROM marked WHERE NOT goes"""


@query("b04_merge_short", SHORT_SQL)
def merge_short(b):
    end = F.col("start_ms") + 200 + F.floor((F.col("end_ms") - F.col("start_ms")) / 4)
    return C.merge_short(b.noisy_cues.withColumn("end_ms", end.cast("long"))).drop("cue_no")


@query("b03_merge_in_long_groups", f"{FOLD_SQL.replace('noisy_cues', 'long_cues')} SELECT * FROM deduped")
def merge_in_long_groups(b):
    return C.merge_near_duplicates(b.long_cues).drop("cue_no")


@query("b04_merge_short_in_long_groups", SHORT_SQL.replace("noisy_cues", "long_cues"))
def merge_short_in_long_groups(b):
    end = F.col("start_ms") + 200 + F.floor((F.col("end_ms") - F.col("start_ms")) / 4)
    return C.merge_short(b.long_cues.withColumn("end_ms", end.cast("long"))).drop("cue_no")


ALIGN = """least(CAST(floor({0} * fps / 1000) AS BIGINT), n - 1)"""
CLIPS_SQL = """clips AS (SELECT o_orderkey AS stem, CAST(20 + o_orderkey % 11 AS DOUBLE) AS fps,
    100 + o_orderkey % 200 AS n, CASE WHEN o_orderstatus = 'P' THEN 0 ELSE o_custkey + 1 END AS bytes FROM orders)"""
ALIGN_COLS = f"""stem || '_' || lpad(CAST(start_ms AS VARCHAR), 8, '0') AS segment_id, stem, start_ms, end_ms,
    {ALIGN.format('start_ms')} AS frame_start, {ALIGN.format('end_ms')} AS frame_end, text, fps,
    greatest(0, {ALIGN.format('end_ms')} - {ALIGN.format('start_ms')}) AS n_frames, 'pending' AS status,
    '' AS reviewed_text, start_ms AS reviewed_start_ms, end_ms AS reviewed_end_ms"""


def clips(b):
    return b.table("orders").select(
        F.col("o_orderkey").alias("stem"), (20 + F.col("o_orderkey") % 11).cast("double").alias("fps"),
        (100 + F.col("o_orderkey") % 200).alias("n_frames"),
        F.when(F.col("o_orderstatus") == "P", 0).otherwise(F.col("o_custkey") + 1).cast("long").alias("bytes"))


@query("b05_align_to_frames", f"WITH {CLIPS_SQL} SELECT {ALIGN_COLS} FROM cues JOIN clips USING (stem)")
def align_to_frames(b):
    return C.align_to_frames(b.cues, clips(b).drop("bytes"))


FILES_SQL = """files AS (SELECT conv_id AS stem, 'f' || conv_id || '.' || turn || '.vtt' AS path,
    CASE WHEN role = 'assistant' THEN 'ocr' ELSE 'soft' END AS kind,
    CASE turn % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'cs' WHEN 2 THEN 'sk' ELSE 'de' END AS lang,
    CASE WHEN length(text) % 3 = 0 THEN '' ELSE '-->' END || text AS content FROM conversations),
  picked AS (SELECT * FROM (SELECT stem, path, kind AS source,
      bool_or(kind = 'soft') OVER (PARTITION BY stem) AS has_soft, bool_or(kind = 'ocr') OVER (PARTITION BY stem) AS has_ocr,
      row_number() OVER (PARTITION BY stem ORDER BY CASE WHEN kind = 'ocr' THEN 4 WHEN lang = 'sk' THEN 0
        WHEN lang = 'cs' THEN 1 WHEN lang = 'en' THEN 2 ELSE 3 END, path) AS rn
    FROM files WHERE contains(content, '-->')) WHERE rn = 1)"""


def subtitle_files(b):
    t = F.col("turn") % 4
    return b.table("conversations").select(
        F.col("conv_id").alias("stem"), F.format_string("f%d.%d.vtt", "conv_id", "turn").alias("path"),
        F.when(F.col("role") == "assistant", "ocr").otherwise("soft").alias("kind"),
        F.when(t == 0, "en").when(t == 1, "cs").when(t == 2, "sk").otherwise("de").alias("lang"),
        F.concat(F.when(F.length("text") % 3 == 0, "").otherwise("-->"), "text").alias("content"))


@query("b06_build_alignment", f"""WITH {CLIPS_SQL}, {FILES_SQL},
    src AS (SELECT c.* FROM cues c JOIN picked p ON c.stem = p.stem)
    SELECT {ALIGN_COLS} FROM src JOIN clips USING (stem) WHERE bytes > 0 AND stem % 5 <> 0""")
def build_alignment(b):
    picked = C.pick_subtitles(subtitle_files(b))
    cues = b.cues.join(picked.select("stem", "path"), "stem")
    inventory = b.table("orders").select(F.col("o_orderkey").alias("stem"))
    known = inventory.filter("stem % 5 = 0")
    return C.build_alignment(inventory, clips(b), picked, cues, known, dedup=False, merge=False)


# The same two folds as above, one after the other, over the cues of the videos to align. Ends are
# non-decreasing where cues follow closely, so one backward merge per run is enough here as well.
_READY = f"""{CLIPS_SQL}, {FILES_SQL}, src0 AS (SELECT * FROM cues WHERE stem IN (SELECT stem FROM picked) AND stem IN (SELECT stem FROM clips WHERE bytes > 0) AND stem % 5 <> 0)"""
MERGED_SQL = (
    FOLD_SQL.replace("WITH RECURSIVE walk", f"WITH RECURSIVE {_READY}, walk").replace("noisy_cues", "src0")
    + ", src AS (SELECT stem, start_ms, end_ms, text, row_number() OVER (PARTITION BY stem ORDER BY start_ms) - 1 AS cue_no FROM deduped), "
    + SHORT_SQL[SHORT_SQL.index("walk AS"):].replace("walk", "walk2").replace(
        "SELECT stem, s AS start_ms, CASE WHEN takes", "merged AS (SELECT stem, s AS start_ms, CASE WHEN takes", 1).replace(
        "FROM ends)\n  merged", "FROM ends), merged", 1)
    + f") SELECT {ALIGN_COLS} FROM merged JOIN clips USING (stem)")


@query("b06_build_alignment_merged", MERGED_SQL)
def build_alignment_merged(b):
    picked = C.pick_subtitles(subtitle_files(b))
    cues = b.cues.join(picked.select("stem", "path"), "stem")
    inventory = b.table("orders").select(F.col("o_orderkey").alias("stem"))
    return C.build_alignment(inventory, clips(b), picked, cues, inventory.filter("stem % 5 = 0"))


@query("b07_best_subtitle", f"WITH {FILES_SQL} SELECT stem, path, source, has_soft, has_ocr FROM picked")
def best_subtitle(b):
    return C.pick_subtitles(subtitle_files(b))


@query("b08_subtitle_report", f"""WITH {FILES_SQL} SELECT count(*) AS videos, count(*) FILTER (source = 'soft') AS soft,
      count(*) FILTER (source = 'ocr') AS ocr, count(*) FILTER (source IS NULL) AS "none"
    FROM (SELECT DISTINCT conv_id AS stem FROM conversations) LEFT JOIN picked USING (stem)""")
def subtitle_report(b):
    videos = b.table("conversations").select(F.col("conv_id").alias("stem")).distinct()
    return C.subtitle_report(videos, C.pick_subtitles(subtitle_files(b)))


@query("b09_text_changed", f"""SELECT stem, cue_no, {similarity_sql('text', 'nxt')} < 0.80 AS changed FROM (
      SELECT *, lead(text) OVER (PARTITION BY stem ORDER BY cue_no) AS nxt FROM noisy_cues) WHERE nxt IS NOT NULL""")
def text_changed(b):
    from tierloom.functions.chunks import next_rows

    rows = next_rows(b.noisy_cues, ["stem"], "cue_no", ["text"]).filter("next_text is not null")
    return rows.select("stem", "cue_no", T.text_changed(F.col("text"), F.col("next_text")).alias("changed"))


CLEAN = r"""regexp_replace(regexp_replace({0}, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')"""
RECOGNISED_SQL = f"""WITH RECURSIVE texts AS (SELECT stem, cue_no AS n, cue_no * 200 AS ts, text AS t FROM noisy_cues),
  walk AS (SELECT stem, CAST(-1 AS BIGINT) AS n, CAST(0 AS BIGINT) AS ts, '' AS cur, CAST(0 AS BIGINT) AS start,
      '' AS old, CAST(0 AS BIGINT) AS old_start, false AS changed FROM (SELECT DISTINCT stem FROM texts)
    UNION ALL
    SELECT stem, n, ts, CASE WHEN ch THEN t ELSE cur END, CASE WHEN ch THEN ts ELSE start END, cur, start, ch
    FROM (SELECT d.stem, d.n, d.ts, d.t, w.cur, w.start, {similarity_sql('w.cur', 'd.t')} < 0.80 AS ch
      FROM walk w JOIN texts d ON d.stem = w.stem AND d.n = w.n + 1)),
  made AS (SELECT stem, old_start AS start_ms, ts AS end_ms, old AS text FROM walk WHERE changed AND old <> '' AND ts - old_start >= 500
    UNION ALL SELECT stem, start, ts + 200, cur FROM (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY n DESC) AS rn FROM walk)
      WHERE rn = 1 AND cur <> '' AND ts + 200 - start >= 500)"""


@query("b10_cues_from_recognised_text", f"""{RECOGNISED_SQL} SELECT * FROM made WHERE trim(text) <> ''""")
def cues_from_recognised_text(b):
    frames = b.noisy_cues.select("stem", (F.col("cue_no") * 200).alias("ts_ms"), "text")
    ends = frames.groupBy("stem").agg((F.max("ts_ms") + 200).alias("last_ms"))
    return C.cues_from_recognised_text(frames, ends)


@query("b10_recognised_in_long_groups", f"""{RECOGNISED_SQL.replace('noisy_cues', "(SELECT * REPLACE (CASE WHEN (cue_no // 7) % 2 = 0 THEN reverse(text) ELSE text END AS text) FROM long_cues) c")} SELECT * FROM made WHERE trim(text) <> ''""")
def recognised_in_long_groups(b):
    text = F.when(F.floor(F.col("cue_no") / 7) % 2 == 0, F.reverse("text")).otherwise(F.col("text"))
    frames = b.long_cues.select("stem", (F.col("cue_no") * 200).alias("ts_ms"), text.alias("text"))
    return C.cues_from_recognised_text(frames, frames.groupBy("stem").agg((F.max("ts_ms") + 200).alias("last_ms")))


LINES_SQL = RECOGNISED_SQL.replace("SELECT stem, cue_no AS n, cue_no * 200 AS ts, text AS t FROM noisy_cues", f"""SELECT doc_id AS stem, line_no AS n, line_no * 200 AS ts,
    CASE WHEN length({CLEAN.format('line')}) < 2 THEN '' ELSE {CLEAN.format('line')} END AS t FROM lines""").replace(">= 500", ">= 200")


@query("b10_cues_from_document_lines", f"{LINES_SQL} SELECT * FROM made WHERE trim(text) <> ''")
def cues_from_document_lines(b):
    frames = b.lines.select(F.col("doc_id").alias("stem"), (F.col("line_no") * 200).alias("ts_ms"),
                            T.clean_recognised("line").alias("text"))
    ends = frames.groupBy("stem").agg((F.max("ts_ms") + 200).alias("last_ms"))
    return C.cues_from_recognised_text(frames, ends, min_ms=200)


@query("b11_bilingual_split", f"""WITH frag AS (SELECT conv_id AS frame, turn, text, (length(text) * 37 % 100) / 100.0::DOUBLE AS y FROM conversations),
    gaps AS (SELECT *, row_number() OVER w AS i, y - lead(y) OVER w AS gap FROM frag WINDOW w AS (PARTITION BY frame ORDER BY y DESC, turn)),
    best AS (SELECT frame, max(gap) AS g, min_by(i, -gap) FILTER (gap = mx) AS at FROM (SELECT *, max(gap) OVER (PARTITION BY frame) AS mx FROM gaps)
      GROUP BY frame),
    sides AS (SELECT g.*, coalesce(b.g >= 0.15, false) AS split, coalesce(b.g >= 0.15, false) AND i > b.at AS low FROM gaps g JOIN best b USING (frame)),
    parts AS (SELECT frame, split, string_agg(text, ' ' ORDER BY turn) FILTER (trim(text) <> '') AS given,
      string_agg(text, ' ' ORDER BY i) FILTER (NOT low AND trim(text) <> '') AS up, string_agg(text, ' ' ORDER BY i) FILTER (low AND trim(text) <> '') AS down
      FROM sides GROUP BY frame, split),
    tidy AS (SELECT frame, {CLEAN.format("coalesce(CASE WHEN split THEN up ELSE given END, '')")} AS p,
      {CLEAN.format("coalesce(CASE WHEN split THEN down ELSE '' END, '')")} AS s FROM parts)
    SELECT frame, CASE WHEN length(p) < 2 THEN '' ELSE p END AS "primary", CASE WHEN length(s) < 2 THEN '' ELSE s END AS secondary FROM tidy""")
def bilingual_split(b):
    fragments = b.table("conversations").select(
        F.col("conv_id").alias("frame"), F.col("turn").alias("frag_no"), "text",
        (F.length("text") * 37 % 100 / F.lit(100.0)).alias("y"))
    return C.split_bilingual(fragments)


@query("b12_clean_recognised", f"""SELECT doc_id, line_no, CASE WHEN length(t) < 2 THEN '' ELSE t END AS line
    FROM (SELECT doc_id, line_no, {CLEAN.format('line')} AS t FROM lines)""")
def clean_recognised(b):
    return b.lines.select("doc_id", "line_no", T.clean_recognised("line").alias("line"))


@query("b13_import_single_signs", r"""WITH v AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE p_partkey || '_' || p_name END AS stem,
      p_name AS label, CAST(25 AS DOUBLE) AS fps, p_partkey % 120 AS n FROM part),
    d AS (SELECT *, CAST(floor(n / fps * 1000) AS BIGINT) AS dur, string_split(label, ' ') AS words FROM v WHERE n > 0 AND (p_partkey % 7 <> 0 OR p_partkey % 3 = 0)),
    w AS (SELECT *, CAST(floor(dur * 0.10::DOUBLE) AS BIGINT) AS trim_ms FROM d),
    e AS (SELECT *, greatest(dur - 2 * trim_ms, 1) AS active, unnest(range(len(words))) AS i FROM w WHERE len(words) >= 2),
    p AS (SELECT *, trim_ms + active * i // len(words) AS s, trim_ms + active * (i + 1) // len(words) AS en FROM e)
    SELECT stem || '_00000000' AS segment_id, stem, CAST(0 AS BIGINT) AS start_ms, dur AS end_ms, CAST(0 AS BIGINT) AS frame_start,
      n - 1 AS frame_end, n AS n_frames, label AS text, 'approved' AS status FROM d
    UNION ALL SELECT stem || '_' || lpad(CAST(s AS VARCHAR), 8, '0'), stem, s, en, least(CAST(floor(s * fps / 1000) AS BIGINT), n - 1),
      least(CAST(floor(en * fps / 1000) AS BIGINT), n - 1),
      greatest(0, least(CAST(floor(en * fps / 1000) AS BIGINT), n - 1) - least(CAST(floor(s * fps / 1000) AS BIGINT), n - 1)),
      words[i + 1], 'pending' FROM p""")
def import_single_signs(b):
    key = F.col("p_partkey")
    videos = b.table("part").select(
        key, F.when(key % 3 == 0, F.col("p_name")).otherwise(F.concat_ws("_", key.cast("string"), "p_name")).alias("stem"),
        F.lit(25.0).alias("fps"), (key % 120).alias("n_frames"))
    known = videos.filter("p_partkey % 7 = 0 and p_partkey % 3 <> 0")
    return C.import_single_signs(videos.drop("p_partkey"), known)


@query("b14_whole_video_cues", """SELECT stem, d AS duration_ms FROM (SELECT l_orderkey AS stem, count(*) AS n,
      max(CAST(l_quantity AS BIGINT) * 2000) AS d FROM lineitem GROUP BY l_orderkey) WHERE n = 1 AND d > 60000""")
def whole_video_cues(b):
    segs = b.table("lineitem").select(F.col("l_orderkey").alias("stem"), F.lit(0).cast("long").alias("start_ms"),
                                      (F.col("l_quantity").cast("long") * 2000).alias("end_ms"))
    return C.whole_video_cues(segs)


@query("b15_subtitle_fallback", """SELECT stem, start_ms, end_ms, text FROM cues WHERE stem % 3 = 0
    UNION ALL SELECT stem, start_ms, end_ms, trim(CASE WHEN cue_no % 2 = 0 THEN ' ' || role || ' ' ELSE ' ' END) FROM cues
      WHERE stem NOT IN (SELECT stem FROM cues WHERE stem % 3 = 0) AND cue_no % 2 = 0""")
def subtitle_fallback(b):
    cues = b.cues.filter("stem % 3 = 0")
    value = F.when(F.col("cue_no") % 2 == 0, F.concat(F.lit(" "), "role", F.lit(" "))).otherwise(" ")
    notes = b.cues.select("stem", "start_ms", "end_ms", F.lit("S1_Translation").alias("tier"), value.alias("value"))
    return C.subtitles_or_translations(cues, cues, notes)


ALIGNMENT_SQL = f"{CLIPS_SQL}, al AS (SELECT {ALIGN_COLS}, cue_no FROM cues JOIN clips USING (stem))"
DECISION = """CASE cue_no % 4 WHEN 0 THEN 'approved' WHEN 1 THEN 'skipped' WHEN 2 THEN 'flagged' END"""


@query("b16_apply_decisions", f"""WITH {ALIGNMENT_SQL}, d AS (SELECT *, {DECISION} AS ns, CASE WHEN cue_no % 8 = 0 THEN start_ms ELSE start_ms + 100 END AS s2,
      CASE WHEN cue_no % 8 = 0 THEN start_ms + 20 ELSE end_ms END AS e2 FROM al),
    t AS (SELECT d.*, ns IS NOT NULL AND NOT (ns = 'approved' AND least(CAST(floor(e2 * d.fps / 1000) AS BIGINT), n - 1)
        - least(CAST(floor(s2 * d.fps / 1000) AS BIGINT), n - 1) <= 0) AS ok FROM d JOIN clips USING (stem))
    SELECT segment_id, CASE WHEN ok THEN ns ELSE status END AS status, CASE WHEN ok THEN upper(left(text, 3)) ELSE reviewed_text END AS reviewed_text,
      CASE WHEN ok THEN s2 ELSE reviewed_start_ms END AS reviewed_start_ms, CASE WHEN ok THEN e2 ELSE reviewed_end_ms END AS reviewed_end_ms FROM t""")
def apply_decisions(b):
    aligned = C.align_to_frames(b.cues, clips(b).drop("bytes"))
    n, first = F.col("cue_no") % 4, F.col("cue_no") % 8 == 0
    decisions = b.cues.select(
        T.segment_id("stem", "start_ms").alias("segment_id"),
        F.when(n == 0, "approved").when(n == 1, "skipped").when(n == 2, "flagged").alias("new_status"),
        F.upper(F.substring("text", 1, 3)).alias("new_text"),
        F.when(first, F.col("start_ms")).otherwise(F.col("start_ms") + 100).alias("new_start_ms"),
        F.when(first, F.col("start_ms") + 20).otherwise(F.col("end_ms")).alias("new_end_ms"))
    out = C.apply_decisions(aligned, decisions, clips(b))
    return out.select("segment_id", "status", "reviewed_text", "reviewed_start_ms", "reviewed_end_ms")


@query("b17_merge_with_next", f"""WITH RECURSIVE {ALIGNMENT_SQL},
    r AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY start_ms) AS pos, (cue_no * 7 + stem) % 3 < 2 AS named FROM al),
    walk AS (SELECT stem, pos, named AS acts, false AS gone FROM r WHERE pos = 1
      UNION ALL SELECT r.stem, r.pos, r.named AND NOT w.acts, w.acts FROM walk w JOIN r ON r.stem = w.stem AND r.pos = w.pos + 1),
    j AS (SELECT r.*, w.acts, w.gone, lead(r.text) OVER v AS nt, lead(r.end_ms) OVER v AS ne, lead(r.frame_end) OVER v AS nf
      FROM r JOIN walk w USING (stem, pos) WINDOW v AS (PARTITION BY stem ORDER BY pos))
    SELECT segment_id, CASE WHEN acts AND ne IS NOT NULL THEN text || chr(10) || nt ELSE text END AS text,
      CASE WHEN acts AND ne IS NOT NULL THEN ne ELSE end_ms END AS end_ms,
      CASE WHEN acts AND ne IS NOT NULL THEN nf ELSE frame_end END AS frame_end,
      CASE WHEN acts AND ne IS NOT NULL THEN nf - frame_start ELSE n_frames END AS n_frames,
      CASE WHEN acts AND ne IS NOT NULL THEN ne ELSE reviewed_end_ms END AS reviewed_end_ms FROM j WHERE NOT gone""")
def merge_with_next(b):
    aligned = C.align_to_frames(b.cues, clips(b).drop("bytes"))
    named = b.cues.filter("(cue_no * 7 + stem) % 3 < 2").select(T.segment_id("stem", "start_ms").alias("segment_id"))
    out = C.merge_with_next(aligned, named)
    return out.select("segment_id", "text", "end_ms", "frame_end", "n_frames", "reviewed_end_ms")


@query("a04_webvtt_lines", f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY start_ms, cue_no) AS n FROM cues)
    SELECT stem, CAST(0 AS BIGINT) AS n, 'WEBVTT' || chr(10) AS block FROM (SELECT DISTINCT stem FROM cues) UNION ALL
    SELECT stem, n, n || chr(10) || {STAMP.format('start_ms')} || ' --> ' || {STAMP.format('end_ms')} || chr(10) || text || chr(10) FROM r""")
def webvtt_blocks(b):
    from tierloom.sources.subtitles import webvtt_blocks

    return webvtt_blocks(b.cues)
