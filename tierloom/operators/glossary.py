"""Glossary of sign ids and their word forms.

A glossary table has one row per form: gloss_id, form, form_no. Entries keep the
order of ``entry_no`` where the table has it, else the order of their id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tierloom.functions.text import is_gloss, normalise_word, strip, tokens


def _entry_order(glossary: DataFrame) -> Column:
    return F.col("entry_no") if "entry_no" in glossary.columns else F.col("gloss_id")


def reverse_index(glossary: DataFrame) -> DataFrame:
    """Rows (word, gloss_id, entry): which glosses have a form that normalises to ``word``."""
    rows = glossary.select(normalise_word("form").alias("word"), "gloss_id",
                           _entry_order(glossary).alias("entry"), "form_no")
    return rows.filter("word <> ''")


def first_gloss(glossary: DataFrame) -> DataFrame:
    """Per word the first gloss and the number of matches; a partial aggregation, no sort."""
    return reverse_index(glossary).groupBy("word").agg(
        F.min(F.struct("entry", "form_no", "gloss_id"))["gloss_id"].alias("gloss_id"),
        F.count(F.lit(1)).alias("n_glosses"))


def match_tokens(texts: DataFrame, text: str, glossary: DataFrame) -> DataFrame:
    """One row per token: raw, word, first gloss, number of glosses, mapped."""
    rest = [c for c in texts.columns if c != text]
    rows = texts.select(*rest, F.posexplode(tokens(text)).alias("token_no", "raw")).withColumn(
        "word", normalise_word("raw"))
    return rows.join(first_gloss(glossary), "word", "left").withColumn(
        "n_glosses", F.coalesce("n_glosses", F.lit(0).cast("long"))).withColumn(
        "mapped", F.col("n_glosses") > 0)


def parse_gloss(rows: DataFrame, value: str, glossary: DataFrame) -> DataFrame:
    """Add ``word`` and ``gloss_id``: an upper-case id stands for itself, a word is looked up."""
    v = strip(F.coalesce(F.col(value), F.lit("")))
    lookup = first_gloss(glossary).select(F.col("word").alias("_key"), F.col("gloss_id").alias("_gloss"))
    return (
        rows.withColumn("_v", v)
        .withColumn("_key", F.when(~is_gloss(F.col("_v")), normalise_word("_v")))
        .join(lookup, "_key", "left")
        .withColumn("word", F.when(is_gloss(F.col("_v")), "").otherwise(F.lower("_v")))
        .withColumn("gloss_id", F.when(is_gloss(F.col("_v")), F.col("_v")).otherwise(
            F.coalesce("_gloss", F.lit(""))))
        .drop("_v", "_key", "_gloss")
    )


def resolve_gloss_input(rows: DataFrame, raw: str, fallback: str, glossary: DataFrame) -> DataFrame:
    """Add ``word`` and ``gloss_id`` for a reviewer's input.

    Blank input means the fallback gloss and its first form. In a comma list the first
    word decides the gloss. Anything else is parsed as a gloss value. Every row needs
    one glossary lookup, whose key is chosen first.
    """
    text = strip(F.coalesce(F.col(raw), F.lit("")))
    fb = F.coalesce(F.col(fallback), F.lit(""))
    parts = F.filter(F.transform(F.split(text, ","), lambda p: F.lower(strip(p))), lambda p: p != "")
    lookup = first_gloss(glossary).select(F.col("word").alias("_key"), F.col("gloss_id").alias("_gloss"))
    entries = glossary.groupBy(F.col("gloss_id").alias("_fb")).agg(
        F.min(F.struct("form_no", "form"))["form"].alias("_form"))
    case = (F.when(text == "", "blank").when(text.contains(",") & (F.size(parts) > 0), "list")
            .otherwise("value"))
    rows = (rows.withColumn("_text", text).withColumn("_fb", fb).withColumn("_parts", parts)
            .withColumn("_case", case)
            .withColumn("_key", normalise_word(
                F.when(F.col("_case") == "blank", strip(F.col("_fb")))
                .when(F.col("_case") == "list", F.get("_parts", F.lit(0)))
                .otherwise(F.when(~is_gloss(F.col("_text")), F.col("_text"))))))
    rows = rows.join(lookup, "_key", "left").join(entries, "_fb", "left")
    known_form = F.coalesce("_form", F.lit("")) != ""
    found = F.coalesce("_gloss", F.lit(""))
    word = (F.when(F.col("_case") == "list", F.array_join("_parts", ", "))
            .when(F.col("_case") == "value", F.when(is_gloss(F.col("_text")), "").otherwise(F.lower("_text")))
            .when(known_form, F.col("_form")).when(is_gloss(F.col("_fb")), "")
            .otherwise(F.lower(strip("_fb"))))
    gloss = (F.when(F.col("_case") == "list", F.when(found != "", found).otherwise(F.col("_fb")))
             .when(F.col("_case") == "value", F.when(is_gloss(F.col("_text")), F.col("_text")).otherwise(found))
             .when(known_form | is_gloss(F.col("_fb")), F.col("_fb")).otherwise(found))
    return rows.withColumn("word", word).withColumn("gloss_id", gloss).drop(
        "_text", "_fb", "_parts", "_case", "_key", "_gloss", "_form")


def forms_from_input(resolved: DataFrame, raw: str) -> DataFrame:
    """Forms a comma list adds to the gloss it resolved to."""
    parts = F.transform(F.split(F.col(raw), ","), lambda p: F.lower(strip(p)))
    rows = resolved.filter(F.col(raw).contains(",") & (F.col("gloss_id") != ""))
    return rows.select("gloss_id", F.explode(parts).alias("form")).filter("form <> ''").distinct()


def next_gloss_id(bases: DataFrame, base: str, glossary: DataFrame) -> DataFrame:
    """Smallest free ``BASE-n`` of any size; a blank base gives SIGN-1.

    The smallest free number is 1 or follows a used one, so an anti join of these with the
    used ones finds it: a base with many numbers is spread over tasks.
    """
    numbered = r"^(.*)-([1-9]\d{0,17})$"
    used = (
        glossary.select(F.regexp_extract("gloss_id", numbered, 1).alias("_base"),
                        F.regexp_extract("gloss_id", numbered, 2).try_cast("long").alias("_n"))
        .filter(F.col("_n").isNotNull()).distinct())
    upper = F.upper(strip(F.coalesce(F.col(base), F.lit(""))))
    rows = bases.withColumn("_base", upper)
    wanted = used.join(rows.select("_base").distinct(), "_base", "left_semi")
    ones = wanted.select("_base").distinct().withColumn("_n", F.lit(1).cast("long"))
    free = (
        wanted.withColumn("_n", F.col("_n") + 1).unionByName(ones).join(wanted, ["_base", "_n"], "left_anti")
        .groupBy("_base").agg(F.min("_n").alias("_free")))
    return (rows.join(free, "_base", "left")
            .withColumn("gloss_id", F.when(F.col("_base") == "", "SIGN-1").otherwise(
                F.concat_ws("-", "_base", F.coalesce("_free", F.lit(1)).cast("string")))).drop("_base", "_free"))


def glossary_totals(glossary: DataFrame) -> DataFrame:
    return glossary.agg(F.count_distinct("gloss_id").alias("n_glosses"), F.count("form").alias("n_forms"))


def add_glosses(glossary: DataFrame, entries: DataFrame) -> DataFrame:
    """Add or overwrite entries (gloss_id, lemma, forms): id upper-cased, lemma first, no repeats."""
    forms = F.array_distinct(F.concat(F.array("lemma"), F.coalesce("forms", F.expr("array()"))))
    tidy = F.filter(F.transform(forms, strip), lambda f: f != "")
    fresh = entries.select(F.upper(strip("gloss_id")).alias("gloss_id"), tidy.alias("forms")).filter("gloss_id <> ''")
    rows = fresh.select("gloss_id", F.posexplode("forms").alias("form_no", "form")).select(
        "gloss_id", "form", F.col("form_no").cast("long").alias("form_no"))
    kept = glossary.select("gloss_id", "form", "form_no").join(fresh, "gloss_id", "left_anti")
    return kept.unionByName(rows)


def add_forms(glossary: DataFrame, forms: DataFrame) -> DataFrame:
    """Append forms (gloss_id, form) to entries that exist; known forms are ignored.

    New forms of an entry follow its last one in text order.
    """
    last = glossary.groupBy("gloss_id").agg(F.max("form_no").alias("_last"))
    fresh = forms.select("gloss_id", strip("form").alias("form")).filter("form <> ''").distinct()
    fresh = fresh.join(last, "gloss_id").join(glossary, ["gloss_id", "form"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("gloss_id").orderBy("form"))
    rows = fresh.select("gloss_id", "form", (F.col("_last") + rank).cast("long").alias("form_no"))
    return glossary.select("gloss_id", "form", "form_no").unionByName(rows)


def remove_glosses(glossary: DataFrame, ids: DataFrame) -> DataFrame:
    return glossary.join(ids.select("gloss_id").distinct(), "gloss_id", "left_anti")
