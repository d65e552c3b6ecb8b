"""Typed tables from loose text columns, file listings, glossaries and dictionary exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tierloom import schemas as S
from tierloom.functions.text import file_stem

# Names a dictionary export may use for each column.
DICTIONARY_NAMES = {
    "word_id": ("wordid", "word_id", "id"), "translation": ("translation", "word", "gloss"),
    "video_url": ("videourl", "video_url", "url", "video"), "word_class": ("wordclass", "word_class", "pos", "class"),
}
VIDEO_FILES = ("mp4", "mov", "avi", "mkv")


def _has(df: DataFrame, column: str) -> bool:
    return column in df.columns


def whole_number(column: Column) -> Column:
    """Number cut toward zero; anything unreadable is 0."""
    return F.coalesce(column.try_cast("double").try_cast("long"), F.lit(0).cast("long"))


def typed_alignment(text: DataFrame) -> DataFrame:
    """Alignment table from text columns: bad whole numbers 0, bad frame rate null, missing
    review text blank, missing status pending, missing review times as the original ones."""
    def words(name: str) -> Column:
        default = "pending" if name == "status" else ""
        return F.coalesce(F.col(name), F.lit(default)) if _has(text, name) else F.lit(default)

    plain = {"text": F.col("text")} if _has(text, "text") else {}
    out = {n: plain.get(n, words(n)) for n in S.ALIGNMENT_TEXT if _has(text, n) or n in ("segment_id", "reviewed_text", "status")}
    numbers = {n: whole_number(F.col(n)) for n in S.ALIGNMENT_WHOLE if _has(text, n)}
    for name in ("start_ms", "end_ms"):
        numbers.setdefault(f"reviewed_{name}", numbers[name])
    rate = {"fps": F.col("fps").try_cast("double")} if _has(text, "fps") else {}
    return text.select(*[c.alias(n) for n, c in (out | numbers | rate).items()])


def typed_pairings(text: DataFrame) -> DataFrame:
    """Pairing table from text columns: bad numbers 0, null text blank, blank status pending."""
    out = []
    for name in text.columns:
        if name in S.PAIRING_WHOLE:
            out.append(whole_number(F.col(name)).alias(name))
        elif name in S.PAIRING_REAL:
            out.append(F.coalesce(F.col(name).try_cast("double"), F.lit(0.0)).alias(name))
        elif name == "status":
            value = F.coalesce(F.col(name), F.lit(""))
            out.append(F.when(value == "", "pending").otherwise(value).alias(name))
        elif name in S.PAIRING_TEXT:
            out.append(F.coalesce(F.col(name), F.lit("")).alias(name))
        else:
            out.append(F.col(name))
    return text.select(*out)


def _read_text_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jpath)


def read_alignment(spark: SparkSession, path: str) -> DataFrame:
    return typed_alignment(_read_text_table(spark, path))


def read_pairings(spark: SparkSession, path: str) -> DataFrame:
    """Pairings of a CSV; a missing file is an empty table."""
    if path_exists(spark, path):
        return typed_pairings(_read_text_table(spark, path))
    columns = ", ".join([f"{c} string" for c in S.PAIRING_TEXT] + [f"{c} bigint" for c in S.PAIRING_WHOLE]
                        + [f"{c} double" for c in S.PAIRING_REAL])
    return spark.createDataFrame([], columns)


def scan_files(spark: SparkSession, folder: str, endings: Sequence[str] = VIDEO_FILES) -> DataFrame:
    """Files below a folder by ending (any case): path, filename, stem, bytes, size in MB.

    Only file metadata is read; the content column is pruned from the scan.
    """
    ends = "|".join(endings)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select(
        "path", F.regexp_extract("path", r"([^/]*)$", 1).alias("filename"), file_stem("path").alias("stem"),
        F.col("length").alias("bytes"), F.round(F.col("length") / 1_048_576, 2).alias("file_size_mb"),
    ).filter(F.lower("filename").rlike(rf"\.({ends})$"))


def build_inventory(files: DataFrame, probes: DataFrame, poses: DataFrame) -> DataFrame:
    """Inventory from scanned files, probe results per path and non-empty poses per stem."""
    done = poses.filter("bytes > 0").select("stem").distinct().withColumn("_p", F.lit(True))
    facts = probes.select("path", "duration_sec", "width", "height", "fps", "codec")
    return files.join(facts, "path", "left").join(done, "stem", "left").select(
        "path", "filename", "duration_sec", "width", "height", "fps", "file_size_mb", "codec",
        F.coalesce("_p", F.lit(False)).alias("pose_extracted"))


def load_or_create_inventory(spark: SparkSession, path: str, create) -> DataFrame:
    """Read the inventory CSV; if there is none, make it with ``create()``, write it and read it."""
    if not path_exists(spark, path):
        create().write.option("header", True).csv(path)
    return spark.read.option("header", True).schema(S.INVENTORY).csv(path)


def glossary_of_json(documents: DataFrame, column: str = "json") -> DataFrame:
    """Glossary rows (gloss_id, form, form_no, lemma, pos, notes) of JSON documents ``{"glosses": {...}}``."""
    parsed = F.from_json(column, f"glosses {S.GLOSSARY}")["glosses"]
    entries = documents.select(F.explode(parsed).alias("gloss_id", "e"))
    return entries.select("gloss_id", "e.lemma", "e.pos", "e.notes", F.posexplode("e.forms").alias("form_no", "form")).select(
        "gloss_id", "form", F.col("form_no").cast("long").alias("form_no"), "lemma", "pos", "notes")


def glossary_to_json(glossary: DataFrame) -> DataFrame:
    """One JSON line per gloss, which readers merge into one map; entries are small, the glossary may not be."""
    entry = glossary.groupBy("gloss_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("form_no", "form"))), lambda f: f["form"]).alias("forms"),
        *[F.max(c).alias(c) for c in ("lemma", "pos", "notes") if c in glossary.columns])
    body = F.struct(*[c for c in ("lemma", "forms", "pos", "notes") if c in entry.columns])
    return entry.select("gloss_id", F.to_json(F.struct(F.create_map("gloss_id", body).alias("glosses"))).alias("json"))


def read_glossary(spark: SparkSession, path: str) -> DataFrame:
    """Glossary JSON: one document or one line per gloss; a missing file is an empty glossary."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], "gloss_id string, form string, form_no bigint, lemma string, pos string, notes string")
    rows = spark.read.schema(f"glosses {S.GLOSSARY}").option("multiLine", True).json(path)
    return glossary_of_json(rows.select(F.to_json(F.struct("glosses")).alias("json")))


def dictionary_columns(table: DataFrame) -> DataFrame:
    """Rename the columns of a dictionary export to word_id, translation, video_url, word_class."""
    known = {alias: name for name, aliases in DICTIONARY_NAMES.items() for alias in aliases}
    return table.withColumnsRenamed({c: known[c.lower().strip()] for c in table.columns if c.lower().strip() in known})
