"""Tables of a recording campaign: themes, words, recordings, contributors.

words: word_id, gloss_id, word, theme_id, target; themes: theme_id, name, emoji, sort_order;
recordings: recording_id, word_id, user_id, status, day.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierloom.functions.chunks import rank_by_range, rank_in_groups
from tierloom.functions.single_row import side_by_side
from tierloom.functions.text import strip
from tierloom.session import checkpointed


def status(words: DataFrame, themes: DataFrame, recordings: DataFrame, today: Column) -> DataFrame:
    def n(state: str) -> Column:
        return F.count_if(F.col("status") == state).alias(f"recordings_{state}")

    return side_by_side(
        words.agg(F.count(F.lit(1)).alias("words")), themes.agg(F.count(F.lit(1)).alias("themes")),
        recordings.agg(n("pending"), n("approved"), n("rejected"), F.count_distinct("user_id").alias("active_users"),
                       F.count_if(F.col("day") == today).alias("today")))


def recordings_per_word(recordings: DataFrame) -> DataFrame:
    return recordings.groupBy("word_id").agg(F.count(F.lit(1)).alias("recordings"))


def themes_overview(themes: DataFrame, words: DataFrame, recordings: DataFrame) -> DataFrame:
    """Words and recordings per theme; recordings are counted per word before the join."""
    per_theme = words.join(recordings_per_word(recordings), "word_id", "left").groupBy("theme_id").agg(
        F.count(F.lit(1)).alias("words"), F.sum("recordings").alias("recordings"))
    zero = F.lit(0).cast("long")
    return themes.join(per_theme, "theme_id", "left").select(
        "theme_id", "name", "emoji", F.coalesce("words", zero).alias("words"), F.coalesce("recordings", zero).alias("recordings"))


def list_words(words: DataFrame, theme_id: int | None = None, search: str | None = None, limit: int = 50) -> DataFrame:
    rows = words if theme_id is None else words.filter(F.col("theme_id") == theme_id)
    if search:
        rows = rows.filter(F.lower("word").contains(search.lower()) | F.lower("gloss_id").contains(search.lower()))
    return rows.orderBy("word_id").limit(limit)


def list_recordings(recordings: DataFrame, words: DataFrame, state: str | None = "pending",
                    theme_id: int | None = None, limit: int = 20) -> DataFrame:
    rows = recordings if state is None else recordings.filter(F.col("status") == state)
    if theme_id is not None:
        rows = rows.join(words.filter(F.col("theme_id") == theme_id).select("word_id"), "word_id", "left_semi")
    return rows.orderBy("recording_id").limit(limit)


def parse_import(lines: DataFrame, line: str = "line") -> DataFrame:
    """Import lines ``gloss,word[,link[,link]]``: columns, and ``state`` ok, skipped or ignored.

    Lines of fewer than two columns are ignored, a blank id or word is skipped.
    """
    parsed = F.from_csv(F.col(line), "gloss_id string, word string, link_a string, link_b string", {"mode": "PERMISSIVE", "escape": '"'})
    rows = lines.withColumn("c", parsed)
    gloss, word = (strip(F.coalesce(F.col(f"c.{c}"), F.lit(""))) for c in ("gloss_id", "word"))
    # A comma inside quotes does not part columns.
    state = (F.when(~F.regexp_replace(F.col(line), r'"(?:[^"]|"")*"', "").contains(","), "ignored").when((gloss == "") | (word == ""), "skipped").otherwise("ok"))
    return rows.select(*lines.columns, gloss.alias("gloss_id"), word.alias("word"),
                       F.nullif(strip("c.link_a"), F.lit("")).alias("link_a"),
                       F.nullif(strip("c.link_b"), F.lit("")).alias("link_b"), state.alias("state"))


def import_counts(parsed: DataFrame, known: DataFrame) -> DataFrame:
    """Imported and skipped lines; an id that exists already or repeats is skipped with an error."""
    per_id = parsed.filter("state = 'ok'").groupBy("gloss_id").agg(F.count(F.lit(1)).alias("n"))
    fresh = per_id.join(known.select("gloss_id").distinct(), "gloss_id", "left_anti")
    one = side_by_side(
        parsed.agg(F.count_if(F.col("state") == "ok").alias("_ok"), F.count_if(F.col("state") == "skipped").alias("_blank")),
        fresh.agg(F.count(F.lit(1)).alias("imported")))
    return one.select("imported", (F.col("_ok") - F.col("imported") + F.col("_blank")).alias("skipped"))


@dataclass
class Import:
    """What a bulk import leaves behind: both tables with the new rows, the rejected lines and one row of totals."""

    words: DataFrame
    themes: DataFrame
    rejected: DataFrame
    totals: DataFrame


def find_or_create_theme(themes: DataFrame, name: str) -> DataFrame:
    """The table with a theme of that name, appended if there is none: next id, next place in the order."""
    return add_themes(themes, themes.sparkSession.createDataFrame([(name, "", 0)], "name string, emoji string, sort_order int"))


def bulk_import(lines: DataFrame, words: DataFrame, themes: DataFrame, theme_name: str | None = None,
                theme_id: int | None = None, line_no: str = "line_no", show: int = 5, target: int = 50) -> Import:
    """Import lines ``gloss,word[,link[,link]]`` (``line_no``, ``line``) as words of a theme.

    The theme is ``theme_id``, else the one called ``theme_name``, which is created if need be, else none. The
    first line of a new gloss id becomes a word; blank ids or words and ids that exist or came before are
    rejected, with a reason. Lines of fewer than two columns are ignored. New ids follow the last one in the
    order of the lines. ``totals`` has imported, skipped, theme_id and the first ``show`` reasons for ids that
    were there, from a bounded top of the rejected lines. A line is one record: quotes do not span lines.

    ``words`` has word_id, gloss_id, word, theme_id, target and may have link_a and link_b.
    """
    if theme_name and not theme_id:
        themes = checkpointed(find_or_create_theme(themes, theme_name))
        # One row, found by name; the first if several are called so.
        theme = themes.filter(F.col("name") == theme_name).agg(F.min("theme_id").alias("_theme"))
    else:
        theme = lines.sparkSession.range(1).select(F.lit(theme_id).cast("long").alias("_theme"))
    parsed = parse_import(lines.select(line_no, "line")).filter("state <> 'ignored'")
    firsts = parsed.filter("state = 'ok'").groupBy("gloss_id").agg(F.min(line_no).alias("_first"))
    known = words.select("gloss_id").distinct().withColumn("_known", F.lit(True))
    # One row per id, so an id that many lines share meets the known ids once; lines find their row by (id, line).
    winners = firsts.join(known, "gloss_id", "left").filter("_known is null").select("gloss_id", F.col("_first").alias(line_no), F.lit(True).alias("_wins"))
    judged = checkpointed(parsed.join(winners, ["gloss_id", line_no], "left"))
    ok = F.col("state") == "ok"
    reason = F.when(~ok, "blank gloss or word").otherwise(F.concat("gloss_id", F.lit(": already there")))
    rejected = judged.filter(~ok | F.col("_wins").isNull()).select(line_no, "gloss_id", "word", reason.alias("reason"), ok.alias("_clash"))
    new = rank_by_range(judged.filter("_wins").select(line_no, "gloss_id", "word", "link_a", "link_b"), [F.col(line_no)], "_place")
    last = words.agg(F.coalesce(F.max("word_id"), F.lit(0).cast("long")).alias("_last"))
    one = side_by_side(last, theme)
    added = new.withColumn("_one", F.lit(1)).join(F.broadcast(one.withColumn("_one", F.lit(1))), "_one").select(
        (F.col("_last") + 1 + F.col("_place")).alias("word_id"), "gloss_id", "word", F.col("_theme").alias("theme_id"),
        F.lit(target).cast("long").alias("target"), "link_a", "link_b")
    top = rejected.filter("_clash").orderBy(line_no).limit(show).agg(
        F.sort_array(F.collect_list(F.struct(line_no, "reason"))).alias("_top"))
    totals = side_by_side(new.agg(F.count(F.lit(1)).alias("imported")), rejected.agg(F.count(F.lit(1)).alias("skipped")), theme, top)
    return Import(words.unionByName(added, allowMissingColumns=True), themes, rejected.drop("_clash"), totals.select(
        "imported", "skipped", F.col("_theme").alias("theme_id"), F.transform("_top", lambda t: t["reason"]).alias("sample_errors")))


def coverage(words: DataFrame, recordings: DataFrame) -> DataFrame:
    """Words per number of recordings: 50+, 20-49, 10-19 and below 10."""
    n = F.coalesce("recordings", F.lit(0))
    bucket = F.when(n >= 50, "50+").when(n >= 20, "20-49").when(n >= 10, "10-19").otherwise("<10")
    return words.join(recordings_per_word(recordings), "word_id", "left").groupBy(bucket.alias("bucket")).agg(
        F.count(F.lit(1)).alias("words"))


def most_needed(words: DataFrame, recordings: DataFrame, min_gap: int = 1, limit: int = 20) -> DataFrame:
    n = F.coalesce("recordings", F.lit(0).cast("long"))
    rows = words.join(recordings_per_word(recordings), "word_id", "left").select(
        "word_id", "word", n.alias("recordings"), (F.col("target") - n).alias("gap"))
    return rows.filter(F.col("gap") >= min_gap).orderBy(F.desc("gap"), "word_id").limit(limit)


def leaderboard(recordings: DataFrame, limit: int = 10) -> DataFrame:
    return recordings.groupBy("user_id").agg(F.count(F.lit(1)).alias("recordings")).orderBy(
        F.desc("recordings"), "user_id").limit(limit)


def add_themes(themes: DataFrame, new: DataFrame) -> DataFrame:
    """Append themes (name, emoji, sort_order); sort order 0 means after the last one.

    Names that exist are found, not created again. New ones are numbered in the order of their names.
    """
    fresh = new.dropDuplicates(["name"]).join(themes.select("name"), "name", "left_anti")
    last = themes.agg(F.max("theme_id").alias("_id"), F.max("sort_order").alias("_so"), F.lit(1).alias("_one"))
    numbered = rank_by_range(fresh, [F.col("name")], "_place")
    # One row is broadcast.
    tagged = numbered.withColumn("_one", F.lit(1)).join(F.broadcast(last), "_one").withColumn("_n", F.col("_place") + 1)
    rows = tagged.select((F.coalesce("_id", F.lit(0)) + F.col("_n")).alias("theme_id"), "name", "emoji",
                         F.when(F.col("sort_order") == 0, F.coalesce("_so", F.lit(0)) + F.col("_n")).otherwise(F.col("sort_order")).alias("sort_order"))
    return themes.select("theme_id", "name", "emoji", "sort_order").unionByName(rows)


def sync_with_training(words: DataFrame, labels: DataFrame, show: int = 30) -> DataFrame:
    """Words with and without training data, and the first new ids in order."""
    ids = words.select(F.col("gloss_id").alias("label")).distinct()
    known = labels.select("label").filter("label is not null").distinct()
    fresh = ids.join(known, "label", "left_anti")
    sample = fresh.orderBy("label").limit(show).agg(F.array_join(F.array_sort(F.collect_list("label")), ",").alias("new_sample"))
    return side_by_side(ids.agg(F.count(F.lit(1)).alias("words")),
                        ids.join(known, "label", "left_semi").agg(F.count(F.lit(1)).alias("with_data")),
                        fresh.agg(F.count(F.lit(1)).alias("without_data")), sample)


def add_words(words: DataFrame, new: DataFrame) -> DataFrame:
    """Append words (gloss_id, word, theme_id, target) whose gloss id is new; ids follow the last one.

    New words are numbered inside buckets of their hash, so a bulk import is not sorted in one task.
    """
    fresh = new.groupBy("gloss_id").agg(F.min(F.struct("word", "theme_id", "target")).alias("w")).select("gloss_id", "w.*")
    fresh = fresh.join(words.select("gloss_id").distinct(), "gloss_id", "left_anti")
    numbered = rank_in_groups(fresh, [], F.shiftright(F.xxhash64("gloss_id"), 52), [F.xxhash64("gloss_id"), F.col("gloss_id")], "_n")
    last = words.agg(F.coalesce(F.max("word_id"), F.lit(-1).cast("long")).alias("_last"), F.lit(1).alias("_one"))
    rows = numbered.withColumn("_one", F.lit(1)).join(F.broadcast(last), "_one")
    columns = ["word_id", "gloss_id", "word", "theme_id", "target"]
    return words.select(*columns).unionByName(
        rows.withColumn("word_id", F.col("_last") + 1 + F.col("_n")).select(*columns))
