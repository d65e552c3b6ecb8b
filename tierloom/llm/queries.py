"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierloom.llm import (decontaminate, exact_dedup, jaccard_join, lm_scoring, merkle, mixing, page_text, pii, quality_classifier,
                          quality_rules, repeats, resampling, url_rules)
from tierloom.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


@query("op8_url_rules", r"""
WITH u AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
r(rhost, rpath, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
  ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
h AS (SELECT DISTINCT host, path FROM u),
f AS (SELECT h.host, h.path, rhost || rpath AS rule, verdict,
        row_number() OVER (PARTITION BY h.host, h.path ORDER BY length(rhost || rpath) DESC) AS k
      FROM h JOIN r ON (h.host = rhost OR ends_with(h.host, '.' || rhost)) AND starts_with(h.path, rpath))
SELECT u.page_id, u.host, u.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM u LEFT JOIN f ON f.k = 1 AND f.host = u.host AND f.path = u.path""")
def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


MIX_SQL = r"""
docs AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
           md5('mix|' || coalesce(doc_id::VARCHAR, '')) AS h FROM {documents}),
sized AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
weighed AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3]::BIGINT AS w FROM sized),
leveled AS (SELECT *, 3 * source_size AS cap, sum(source_size) OVER () AS everything, sum(w) OVER () AS ws,
    coalesce(sum(3 * source_size) OVER o, 0) AS caps, coalesce(sum(w) OVER o, 0) AS below FROM weighed
  WINDOW o AS (ORDER BY (3 * source_size)::DOUBLE / w, 3 * source_size, source IS NULL, source
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (SELECT *, (everything - caps)::DOUBLE / (ws - below)::DOUBLE AS l FROM leveled),
aim AS (SELECT source, source_size, everything, least(cap::DOUBLE, (max(l) OVER ()) * w) AS target FROM levels),
placed AS (SELECT d.*, a.source_size, a.everything, a.target,
    sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
  FROM docs d JOIN aim a ON d.source IS NOT DISTINCT FROM a.source),
dealt AS (SELECT p.*, c, (c * source_size + upto)::DOUBLE / target AS v
  FROM placed p, (SELECT unnest([0, 1, 2]) AS c) WHERE size > 0),
ordered AS (SELECT *, sum(size) OVER (ORDER BY v, h, doc_id, c ROWS UNBOUNDED PRECEDING) AS total FROM dealt),
got AS (SELECT source, h, doc_id, upto, count(*) AS times FROM ordered WHERE total <= everything GROUP BY ALL)
"""


@query("op10_mix_sources", "WITH " + MIX_SQL.format(documents="documents") + """
SELECT p.doc_id, p.size, p.source_size::BIGINT AS source_size, p.target, (p.size * coalesce(g.times, 0))::BIGINT AS taken
FROM placed p LEFT JOIN got g ON p.source IS NOT DISTINCT FROM g.source AND p.h = g.h
  AND p.doc_id IS NOT DISTINCT FROM g.doc_id AND p.upto = g.upto AND p.size > 0""")
def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs, keep=["doc_id"])


@query("op4_quality_rules")
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return quality_rules.judge(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"), ["doc_id"])


@query("op5_quality_classifier")
def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_classifier.classify(docs, table(spark, sf_dir, "labels"), ["doc_id"])


@query("op7_personal_data")
def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])


@query("op9_page_text")
def op9_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.extract(table(spark, sf_dir, "pages"), ["page_id", "url"])


@query("op2_jaccard_join")
def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join.similar(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "class_id", "n_links", "group_id")


@query("op3_decontamination")
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.find(docs, table(spark, sf_dir, "benchmark"), ["doc_id"]).withColumn("contaminated", F.size("items") > 0)


@query("op6_repeats")
def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])


@query("op1_lm_scoring")
def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumnRenamed("id", "doc_id")


# CRC-32 of a text in SQL: a table of 256 entries from the polynomial, then one step per byte.
CRC_TABLE = """crc_table AS (SELECT list(c ORDER BY b) AS steps FROM (SELECT b, list_reduce([b::UBIGINT, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS c FROM range(256) r(b)))"""


def crc_sql(text: str) -> str:
    digit = "(instr('0123456789ABCDEF', substr(hex(encode({})), 2 * i + {}, 1)) - 1)"
    octet = f"(16 * {digit.format(text, 1)} + {digit.format(text, 2)})::UBIGINT"
    return f"""xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(0, strlen({text})), lambda i: {octet})),
    lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255)::INT + 1])), 4294967295::UBIGINT)"""


def _word_table(name: str, table: str, row: str) -> str:
    """Words of every row and the bucket of each distinct word."""
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""{name} AS (SELECT {row}, unnest(regexp_extract_all({lowered}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM {table})"""


RESAMPLE_SQL = f"""WITH {CRC_TABLE},
{_word_table('d', '(SELECT row_number() OVER () AS r, * FROM documents)', 'r')}, {_word_table('b', 'benchmark', 'item_id')},
v AS (SELECT word, {crc_sql('word')} % 10000 AS bucket FROM (SELECT word FROM d UNION SELECT word FROM b), crc_table),
s AS (SELECT bucket, count(*) AS s FROM d JOIN v USING (word) GROUP BY 1), t AS (SELECT bucket, count(*) AS t FROM b JOIN v USING (word) GROUP BY 1),
sizes AS (SELECT (SELECT count(*) FROM d)::DOUBLE AS ss, (SELECT count(*) FROM b)::DOUBLE AS tt),
g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (ss + 10000) / ((s + 1)::DOUBLE * (tt + 10000))))::BIGINT AS gain
      FROM s LEFT JOIN t USING (bucket), sizes),
w AS (SELECT r, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM d JOIN v USING (word) JOIN g USING (bucket) GROUP BY 1),
rows_ AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    list_reduce(list_prepend(0::BIGINT, list_transform(range(1, 9), lambda i: (instr('0123456789abcdef', substr(sha256('2024:' || doc_id), i, 1)) - 1)::BIGINT)), lambda h, x: 16 * h + x) AS h
  FROM (SELECT row_number() OVER () AS r, doc_id FROM documents) LEFT JOIN w USING (r)),
scored AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM rows_),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS k FROM scored)
SELECT doc_id, n_features, weight, score,
  CASE WHEN n_features >= 20 AND k <= 10 * (SELECT count(*) FROM scored WHERE n_features >= 20) // 100 THEN k END AS rank FROM ranked"""


@query("op11_resampling", RESAMPLE_SQL)
def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return resampling.resample(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"])


def _merkle_sql(depth: int = 12) -> str:
    """Levels are written out one by one; ``depth`` levels are enough for 8 ** depth rows."""
    def grown(p: str, top: int) -> str:
        """Levels 1 ... of the trees at level 0: node digests, and slots of parents with all their children."""
        out = []
        for k in range(top):
            out.append(f"""{p}p{k} AS (SELECT tree, i // 8 AS i, (any_value(n) + 7) // 8 AS n, list(digest ORDER BY i) AS kids FROM {p}{k} WHERE n > 1 GROUP BY tree, i // 8),
{p}{k + 1} AS (SELECT tree, i, n, sha256(array_to_string(kids, '')) AS digest FROM {p}p{k})""")
        return ",\n".join(out)

    def climbed(p: str, start: str, top: int) -> str:
        """Per row: siblings and folded digest, level by level; rows of finished trees stay as they are."""
        out = []
        for k in range(top):
            source = start if k == 0 else f"{p}c{k - 1}"
            out.append(f"""{p}c{k} AS (SELECT s.* EXCLUDE (proof, folded, pos), pos // 8 AS pos,
    CASE WHEN kids IS NULL THEN proof ELSE proof || array_to_string(kids[:pos % 8], '') || array_to_string(kids[pos % 8 + 2:], '') END AS proof,
    CASE WHEN kids IS NULL THEN folded ELSE sha256(array_to_string(kids[:pos % 8], '') || folded || array_to_string(kids[pos % 8 + 2:], '')) END AS folded
  FROM {source} s LEFT JOIN {p}p{k} q ON q.tree = s.tree AND q.i = s.pos // 8)""")
        return ",\n".join(out)

    def part(column: str) -> str:
        return f"coalesce(strlen({column}::VARCHAR) || ':' || {column}::VARCHAR, '-')"

    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    start = " || ".join(part(c) for c in ("doc_id", "source", "lang", "n_chars"))
    ends = " UNION ALL ".join(f"SELECT tree, digest FROM a{k} WHERE n = 1" for k in range(depth + 1))
    return f"""WITH {CRC_TABLE},
docs AS (SELECT doc_id, coalesce('1' || lang, '0') AS tree, sha256({start} || {part('text')}) AS leaf,
    sha256({start} || {part('claim')}) AS claimed
  FROM (SELECT *, CASE WHEN {crc_sql('doc_id::VARCHAR')} % 3 = 0 THEN {lowered} ELSE text END AS claim FROM documents, crc_table)),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM docs),
a0 AS (SELECT tree, pos AS i, n, leaf AS digest FROM placed),
{grown('a', depth)},
subroots AS ({ends}),
z0 AS (SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n, digest, tree AS lang_tree FROM subroots),
{grown('z', 4)},
top AS ({" UNION ALL ".join(f"SELECT digest FROM z{k} WHERE n = 1" for k in range(5))}),
begun AS (SELECT doc_id, tree, pos, leaf, claimed AS folded, '' AS proof FROM placed),
{climbed('a', 'begun', depth)},
moved AS (SELECT c.doc_id, '' AS tree, z.i AS pos, c.leaf, z.digest AS subroot, c.folded, c.proof FROM ac{depth - 1} c JOIN z0 z ON z.lang_tree = c.tree),
{climbed('z', 'moved', 4)}
SELECT doc_id, leaf, subroot, top.digest AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = top.digest AS verified FROM zc3, top"""


@query("op12_merkle_manifest", _merkle_sql())
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.check_forgeries(table(spark, sf_dir, "documents"))


@query("op13_exact_dedup", r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[ 	-
]', '', 'g')) AS text_sha256,
    coalesce(length(text), 0) AS chars, row_number() OVER () AS r FROM documents)
SELECT doc_id, first(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
  row_number() OVER w = 1 AS kept, text_sha256 FROM d
WINDOW w AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id NULLS LAST, r)""")
def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
