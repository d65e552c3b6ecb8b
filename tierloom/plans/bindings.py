"""How the given tables stand in for cues, signals, poses and label sets.

Each logical input exists twice: as a DataFrame and as a SQL common table
expression for the oracle. Both read whole tables.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierloom.functions.chunks import rank_in_groups
from tierloom.session import checkpointed


# Tables whose rows are expanded or parsed before the first shuffle.
WIDE_WORK = ("documents", "embeddings", "lineitem", "pages")


def spread(rows: DataFrame) -> DataFrame:
    """Spread rows over the cores when the files have fewer splits than cores.

    A file with a single row group is one split. Large inputs have many splits and pass
    through unchanged, without a shuffle.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    splits = rows._jdf.queryExecution().toRdd().getNumPartitions()
    return rows.repartition(cores) if splits < cores else rows


class Bindings:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = str(sf_dir).rstrip("/")

    def table(self, name: str) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return spread(rows) if name in WIDE_WORK else rows

    @cached_property
    def signal(self) -> DataFrame:
        """One clip per user; frames follow event time."""
        k = F.regexp_extract("props", r"(\d+)", 1).cast("int")
        rows = self.table("events").select(
            F.col("user_id").alias("clip"), "ts", "event_id", "event_type",
            F.col("value").alias("x"), k.cast("double").alias("y"),
            (k / 100).alias("conf"), k.cast("long").alias("k"), F.lit(25.0).alias("fps"))
        return rank_in_groups(rows, ["clip"], F.col("ts").cast("date"), [F.col("ts"), F.col("event_id")], "frame") \
            .drop("ts", "event_id")

    @property
    def hand_signal(self) -> DataFrame:
        hand = F.when(F.col("clip") % 2 == 0, "right").otherwise("left")
        return self.signal.withColumn("hand", hand)

    @cached_property
    def hand_signal_table(self) -> DataFrame:
        """The numbered signal written once, for jobs that read it several times."""
        return checkpointed(self.hand_signal)

    @cached_property
    def pose(self) -> DataFrame:
        """One clip per label and one frame per vector; 543 points read round the vector."""
        rows = rank_in_groups(self.table("embeddings"), ["label"],
                              F.floor(F.col("vec_id") / 4096), [F.col("vec_id")], "frame")

        def at(i, shift):
            return F.get("embedding", (i + shift) % 64).cast("double")

        points = F.transform(F.sequence(F.lit(0), F.lit(542)), lambda i: F.struct(
            at(i, 0).alias("x"), at(i, 21).alias("y"), at(i, 42).alias("z"),
            F.least(F.lit(1.0), F.abs(at(i, 7)) * 4).alias("c")))
        return rows.select(F.col("label").cast("long").alias("clip"), "frame",
                           points.alias("pts"), F.lit(25.0).alias("fps"))

    @property
    def noisy_cues(self) -> DataFrame:
        """Cues that repeat or nearly repeat the one before, with some long gaps."""
        start = F.col("frame") * 900 + F.floor(F.col("frame") / 10) * 3000
        bangs = F.expr("repeat('!', cast(k % 3 as int))")
        return self.signal.select(
            F.col("clip").alias("stem"), F.col("frame").alias("cue_no"),
            start.cast("long").alias("start_ms"),
            (start + 300 + F.col("k") * 13 % 1500).cast("long").alias("end_ms"),
            F.concat("event_type", bangs).alias("text"))

    @property
    def long_cues(self) -> DataFrame:
        """The same kind of cues in few and long groups: one video per kind of event, texts by user."""
        k = F.regexp_extract("props", r"(\d+)", 1).cast("long")
        rows = rank_in_groups(self.table("events").select(F.col("event_type").alias("stem"), "ts", "event_id", "user_id", k.alias("k")),
                              ["stem"], F.col("ts").cast("date"), [F.col("ts"), F.col("event_id")], "cue_no")
        start = F.col("cue_no") * 900 + F.floor(F.col("cue_no") / 40) * 3000
        return rows.select(
            "stem", "cue_no", start.cast("long").alias("start_ms"),
            (start + 300 + F.col("k") * 13 % 1500).cast("long").alias("end_ms"),
            F.concat(F.lit("a line of user "), (F.col("user_id") % 3).cast("string"), F.expr("repeat('!', cast(k % 3 as int))")).alias("text"))

    @property
    def cues(self) -> DataFrame:
        start = F.col("turn") * 1500
        return self.table("conversations").select(
            F.col("conv_id").alias("stem"), F.col("turn").alias("cue_no"), "role",
            start.alias("start_ms"),
            (start + 1000 + F.length("text").cast("long") * 37 % 900).alias("end_ms"), "text")

    @property
    def lines(self) -> DataFrame:
        return self.table("documents").select(
            "doc_id", "lang", "source",
            F.posexplode(F.split("text", "\n")).alias("line_no", "line")
        ).withColumn("line_no", F.col("line_no").cast("long"))

    @property
    def manifest(self) -> DataFrame:
        """Labels with a variant suffix, one source per brand."""
        return self.table("part").select(
            F.col("p_partkey").alias("segment_id"), "p_name",
            F.concat_ws("_", F.initcap("p_name"), F.col("p_size").cast("string")).alias("label"),
            F.col("p_brand").alias("source"), F.col("p_type").alias("kind"))

    @property
    def glossary(self) -> DataFrame:
        """Words of part names as forms of one gloss each."""
        words = self.table("part").select(
            F.explode(F.split("p_name", " ")).alias("form")).distinct()
        return words.select(F.concat(F.upper("form"), F.lit("-1")).alias("gloss_id"), "form",
                            F.lit(0).cast("long").alias("form_no"))

    @property
    def pairings(self) -> DataFrame:
        """Annotated signs: one per line item, clip = order."""
        return self.table("lineitem").join(
            self.table("part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey"
        ).select(
            F.col("l_orderkey").alias("stem"), F.col("l_linenumber").cast("long").alias("line_no"),
            F.when(F.col("l_suppkey") % 2 == 0, "right").otherwise("left").alias("hand"),
            (F.col("l_quantity").cast("long") * 200).alias("start_ms"),
            (F.col("l_quantity").cast("long") * 200 + 400).alias("end_ms"),
            F.split("p_name", " ")[0].alias("word"), F.col("l_returnflag").alias("flag"),
            F.col("l_suppkey").alias("suppkey"), F.col("l_partkey").alias("partkey"),
            F.col("l_extendedprice").alias("price"), F.col("l_linestatus").alias("line_status"))


TABLES_SQL: dict[str, str] = {
    "signal": r"""SELECT user_id AS clip, event_type, value AS x, CAST(k AS DOUBLE) AS y,
        k / CAST(100 AS DOUBLE) AS conf, k, CAST(25 AS DOUBLE) AS fps,
        row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame
      FROM (SELECT *, CAST(regexp_extract(props, '(\d+)', 1) AS BIGINT) AS k FROM events)""",
    "hand_signal": """SELECT *, CASE WHEN clip % 2 = 0 THEN 'right' ELSE 'left' END AS hand
      FROM signal""",
    "pose": """SELECT clip, frame, lm, CAST(e[lm % 64 + 1] AS DOUBLE) AS x,
        CAST(e[(lm + 21) % 64 + 1] AS DOUBLE) AS y, CAST(e[(lm + 42) % 64 + 1] AS DOUBLE) AS z,
        least(CAST(1 AS DOUBLE), abs(CAST(e[(lm + 7) % 64 + 1] AS DOUBLE)) * 4) AS c,
        CAST(25 AS DOUBLE) AS fps
      FROM (SELECT CAST(label AS BIGINT) AS clip, embedding AS e,
              row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame FROM embeddings),
           (SELECT unnest(range(543)) AS lm)""",
    "noisy_cues": """SELECT clip AS stem, frame AS cue_no, s AS start_ms,
        s + 300 + k * 13 % 1500 AS end_ms, event_type || repeat('!', CAST(k % 3 AS INT)) AS text
      FROM (SELECT *, frame * 900 + (frame // 10) * 3000 AS s FROM signal)""",
    "long_cues": r"""SELECT stem, cue_no, s AS start_ms, s + 300 + k * 13 % 1500 AS end_ms,
        'a line of user ' || u || repeat('!', CAST(k % 3 AS INT)) AS text
      FROM (SELECT *, cue_no * 900 + (cue_no // 40) * 3000 AS s FROM (
        SELECT event_type AS stem, user_id % 3 AS u, CAST(regexp_extract(props, '(\d+)', 1) AS BIGINT) AS k,
          row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS cue_no FROM events))""",
    "cues": """SELECT conv_id AS stem, turn AS cue_no, role, turn * 1500 AS start_ms,
        turn * 1500 + 1000 + length(text) * 37 % 900 AS end_ms, text FROM conversations""",
    "lines": """SELECT doc_id, lang, source, i - 1 AS line_no, parts[i] AS line
      FROM (SELECT *, string_split(text, chr(10)) AS parts FROM documents),
        LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS i)""",
    "manifest": """SELECT p_partkey AS segment_id, p_name,
        array_to_string([upper(w[1]) || lower(w[2:]) FOR w IN string_split(p_name, ' ')], ' ')
          || '_' || p_size AS label, p_brand AS source, p_type AS kind FROM part""",
    "glossary": """SELECT upper(form) || '-1' AS gloss_id, form, CAST(0 AS BIGINT) AS form_no
      FROM (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS form FROM part)""",
    "pairings": """SELECT l_orderkey AS stem, CAST(l_linenumber AS BIGINT) AS line_no,
        CASE WHEN l_suppkey % 2 = 0 THEN 'right' ELSE 'left' END AS hand,
        CAST(l_quantity AS BIGINT) * 200 AS start_ms, CAST(l_quantity AS BIGINT) * 200 + 400 AS end_ms,
        string_split(p_name, ' ')[1] AS word, l_returnflag AS flag, l_suppkey AS suppkey,
        l_partkey AS partkey, l_extendedprice AS price, l_linestatus AS line_status
      FROM lineitem JOIN part ON l_partkey = p_partkey""",
}


def with_tables(sql: str) -> str:
    """Prefix the common table expressions that ``sql`` mentions, in definition order.

    A query that has its own ``WITH`` starts with ``WITH`` or ``WITH RECURSIVE``.
    """
    needed: set[str] = set()
    todo = [sql]
    while todo:
        text = todo.pop()
        for name, body in TABLES_SQL.items():
            if name not in needed and re.search(rf"\b(FROM|JOIN|IN \(SELECT \w+ FROM)\s+{name}\b", text):
                needed.add(name)
                todo.append(body)
    ctes = ",\n".join(f"{n} AS ({TABLES_SQL[n]})" for n in TABLES_SQL if n in needed)
    body = sql.strip()
    if not ctes:
        return body
    for head in ("WITH RECURSIVE", "WITH"):
        if body.startswith(head):
            return f"{head} {ctes},\n{body[len(head):].strip()}"
    return f"WITH {ctes}\n{body}"
