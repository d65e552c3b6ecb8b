"""Subtitle cues: merging, alignment to frames, review decisions, imports.

A cue table has ``stem`` (the video), ``start_ms``, ``end_ms``, ``text`` and a number
``cue_no`` that breaks ties between equal start times.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierloom.functions.blocks import block_heads, block_starts, last_before, next_after, orbit, some
from tierloom.functions.chunks import FOLD_CHUNK, chunk_of, let, next_rows, rank_in_groups
from tierloom.functions.single_row import side_by_side
from tierloom.functions.text import (blank, clean_recognised, positional_similarity, segment_id,
                                     strip, text_changed, tokens)
from tierloom.functions.timecode import ms_to_frame
from tierloom.session import checkpointed

BUCKET_MS = 600_000


def _positions(cues: DataFrame, order: Sequence[str] = ("start_ms", "cue_no")) -> DataFrame:
    """Number the cues of a video by start; videos are cut into ten-minute buckets."""
    return rank_in_groups(cues, ["stem"], F.floor(F.col("start_ms") / BUCKET_MS),
                          [F.col(c) for c in order], "pos")


def merge_near_duplicates(cues: DataFrame, max_gap_ms: int = 2000, threshold: float = 0.85,
                          chunk_rows: int = FOLD_CHUNK) -> DataFrame:
    """Join a cue to the merged cue before it when the gap is short and the texts agree.

    The comparison is with the merged text (the longer one so far), so this is a walk and not a comparison of
    neighbours. What a walk remembers is the end and the text of the merged cue; where it began does not matter
    for what joins, so walks that entered a chunk differently soon agree.
    """
    def step(state: Column, x: Column) -> Column:
        near = state.isNotNull() & (x["start_ms"] - state["end_ms"] <= max_gap_ms)
        agrees = F.when(near, positional_similarity(state["text"], x["text"]) >= threshold).otherwise(False)
        longer = F.when(F.length(x["text"]) > F.length(state["text"]), x["text"]).otherwise(state["text"])
        return let(F.coalesce(agrees, F.lit(False)), lambda same: F.struct(
            F.struct(F.when(same, F.greatest(state["end_ms"], x["end_ms"])).otherwise(x["end_ms"]).alias("end_ms"),
                     F.when(same, longer).otherwise(x["text"]).alias("text")).alias("state"),
            F.when(same, 0).otherwise(1).alias("mark")))

    rows = _positions(cues).select("stem", "pos", "start_ms", "end_ms", "text")
    marked = block_heads(rows, ["stem"], "pos", "struct<end_ms:bigint,text:string>", step, chunk_rows=chunk_rows)
    return marked.groupBy("stem", "head").agg(
        F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"),
        F.max_by("text", F.struct(F.length("text"), -F.col("pos"))).alias("text")).withColumnRenamed("head", "cue_no")


def merge_short(cues: DataFrame, min_ms: int = 1000, max_gap_ms: int = 500,
                chunk_rows: int = FOLD_CHUNK) -> DataFrame:
    """Merge cues shorter than ``min_ms`` into the next, else into the previous one.

    Merging never changes the start of the following cue or the end of the last cue
    absorbed, so a gap above the limit separates cues for good and cuts a video into
    runs. Inside a run, cues join forward until the block is long enough (a walk, which
    remembers the end of the block and its start while it is short). Only
    the last block of a run can stay short; it joins backward with the blocks whose
    start lies within ``min_ms`` of its end, and with one block before them.
    """
    def step(state: Column, x: Column) -> Column:
        cut = state.isNull() | (x["start_ms"] - state["end_ms"] > max_gap_ms)
        joins = ~cut & (state["end_ms"] - state["start_ms"] < min_ms)
        start = F.when(joins, state["start_ms"]).otherwise(x["start_ms"])
        # Any start that is early enough closes the block, so the latest such start stands for all.
        start = F.greatest(start, x["end_ms"] - min_ms)
        return F.struct(F.struct(start.alias("start_ms"), x["end_ms"].alias("end_ms")).alias("state"),
                        F.when(cut, 2).when(joins, 0).otherwise(1).alias("mark"))

    rows = _positions(cues).select("stem", "pos", "start_ms", "end_ms", "text")
    marked = block_heads(rows, ["stem"], "pos", "struct<start_ms:bigint,end_ms:bigint>", step, ("head", "run"), chunk_rows)
    line = F.sort_array(F.collect_list(F.struct("pos", "text")))
    blocks = marked.groupBy("stem", "head", "run").agg(
        F.min_by("start_ms", "pos").alias("start_ms"), F.max_by("end_ms", "pos").alias("end_ms"),
        F.concat_ws("\n", F.transform(line, lambda p: p["text"])).alias("text"))
    blocks = blocks.withColumnRenamed("head", "cue_no")
    # Only the last block of a run can be short.
    short_end = blocks.filter(F.col("end_ms") - F.col("start_ms") < min_ms).select("stem", "run", F.col("end_ms").alias("_tail_end"))
    tagged = blocks.join(short_end, ["stem", "run"], "left")
    limit = F.col("_tail_end") - min_ms
    head = (
        tagged.filter(F.col("_tail_end").isNotNull())
        .groupBy("stem", "run", "_tail_end")
        .agg(F.max(F.when(F.col("start_ms") <= limit, F.col("cue_no"))).alias("_at"),
             F.min("cue_no").alias("_first"))
        .select("stem", "run", F.coalesce("_at", "_first").alias("_head"))
    )
    tagged = tagged.drop("_tail_end").join(head, ["stem", "run"], "left")
    keep = tagged.filter(F.col("_head").isNull() | (F.col("cue_no") < F.col("_head")))
    # Blocks after the head all start within min_ms of the tail's end: a handful of rows.
    absorbed = (
        tagged.filter(F.col("cue_no") >= F.col("_head"))
        .groupBy("stem", "run").agg(F.sort_array(F.collect_list(F.struct(
            "cue_no", "start_ms", "end_ms", "text"))).alias("p"))
        .select("stem", F.get("p", F.lit(0))["cue_no"].alias("cue_no"),
                F.get("p", F.lit(0))["start_ms"].alias("start_ms"),
                F.element_at("p", -1)["end_ms"].alias("end_ms"),
                F.array_join(F.col("p.text"), "\n").alias("text")))
    columns = ["stem", "cue_no", "start_ms", "end_ms", "text"]
    return keep.select(*columns).unionByName(absorbed.select(*columns))


def cues_from_recognised_text(frames: DataFrame, ends: DataFrame, keys: Sequence[str] = ("stem",),
                              threshold: float = 0.80, min_ms: int = 500,
                              chunk_rows: int = FOLD_CHUNK) -> DataFrame:
    """Cues from sampled frame texts (keys, ts_ms, text); ``ends`` gives ``last_ms`` per video.

    A new cue starts when the text differs enough from the text of the current cue, and ends where the next one
    starts or the video ends. Frames before the first text belong to no cue.
    """
    keys = list(keys)
    def step(state: Column, x: Column) -> Column:
        text = F.coalesce(state["text"], F.lit(""))
        return let(F.coalesce(text_changed(text, x["text"], threshold), F.lit(False)), lambda change: F.struct(
            F.struct(F.when(change, x["text"]).otherwise(text).alias("text")).alias("state"),
            F.when(change, 1).otherwise(0).alias("mark")))

    made = block_starts(frames.select(*keys, "ts_ms", "text"), keys, F.floor(F.col("ts_ms") / BUCKET_MS), "ts_ms", "struct<text:string>", step, chunk_rows)
    made = made.withColumnsRenamed({"ts_ms": "start_ms", "_next": "_until"})
    # Only the last cue of a video has no next one, so this join has one row per video.
    last = made.filter("_until is null").join(ends, keys).withColumn("_until", F.col("last_ms").cast("long"))
    columns = [*keys, "start_ms", F.col("_until").alias("end_ms"), "text"]
    every = made.filter("_until is not null").select(*columns).unionByName(last.select(*columns))
    return every.filter((F.col("text") != "") & (F.col("end_ms") - F.col("start_ms") >= min_ms) & ~blank("text"))


def split_bilingual(fragments: DataFrame, frame: str = "frame", min_gap: float = 0.15) -> DataFrame:
    """Upper and lower text of a frame, split at the widest vertical gap.

    Fragments (frame, frag_no, text, y) of one video frame are few, so a frame is one array.
    """
    grouped = fragments.groupBy(frame).agg(
        F.sort_array(F.collect_list(F.struct("frag_no", "y", "text"))).alias("given"))
    by_height = F.transform(F.array_sort(F.transform("given", lambda f: F.struct(
        (-f["y"]).alias("down"), f["frag_no"].alias("frag_no"), f["text"].alias("text")))), lambda f: f)
    rows = grouped.withColumn("sorted", by_height)
    gaps = F.transform(F.sequence(F.lit(1), F.size("sorted") - 1), lambda i: F.struct(
        (F.get("sorted", i)["down"] - F.get("sorted", i - 1)["down"]).alias("gap"), (-i).alias("at")))
    rows = rows.withColumn("widest", F.when(F.size("sorted") > 1, F.array_max(gaps)))

    def text(items: Column) -> Column:
        shown = F.filter(F.transform(items, lambda f: f["text"]), lambda t: strip(t) != "")
        return clean_recognised(F.array_join(shown, " "))

    split = F.coalesce(F.col("widest.gap") >= min_gap, F.lit(False)) & (F.col("widest.gap") > 0)
    at = -F.col("widest.at")
    return rows.select(
        frame,
        F.when(split, text(F.slice("sorted", F.lit(1), at))).otherwise(text(F.col("given"))).alias("primary"),
        F.when(split, text(F.slice("sorted", at + 1, F.size("sorted") - at))).otherwise("").alias("secondary"))


def align_to_frames(cues: DataFrame, clips: DataFrame) -> DataFrame:
    """Alignment rows; ``clips`` has stem, fps, n_frames."""
    last = F.col("n_frames") - 1
    rows = cues.join(clips, "stem")
    start, end = (F.least(ms_to_frame(c, "fps"), last) for c in ("start_ms", "end_ms"))
    return rows.select(
        segment_id("stem", "start_ms").alias("segment_id"), "stem", "start_ms", "end_ms",
        start.alias("frame_start"), end.alias("frame_end"), "text", "fps",
        F.greatest(end - start, F.lit(0).cast("long")).alias("n_frames"),
        F.lit("pending").alias("status"), F.lit("").alias("reviewed_text"),
        F.col("start_ms").alias("reviewed_start_ms"), F.col("end_ms").alias("reviewed_end_ms"))


def pick_subtitles(files: DataFrame) -> DataFrame:
    """Best subtitle file per stem; ``files`` has stem, path, kind (soft or ocr), lang, content.

    Soft files win, in the language order sk, cs, en, any; files without cues do not count.
    """
    rank = (F.when(F.col("kind") == "ocr", 4).when(F.col("lang") == "sk", 0).when(F.col("lang") == "cs", 1)
            .when(F.col("lang") == "en", 2).otherwise(3))
    usable = files.filter(F.col("content").contains("-->"))
    return usable.groupBy("stem").agg(F.min(F.struct(rank.alias("rank"), "path", "kind")).alias("best"),
                                      F.max(F.col("kind") == "soft").alias("has_soft"),
                                      F.max(F.col("kind") == "ocr").alias("has_ocr")).select(
        "stem", F.col("best.path").alias("path"), F.col("best.kind").alias("source"), "has_soft", "has_ocr")


def subtitle_report(videos: DataFrame, picked: DataFrame) -> DataFrame:
    """Number of videos with soft, recognised or no subtitles."""
    source = F.coalesce("source", F.lit("none"))
    return videos.join(picked, "stem", "left").agg(
        F.count(F.lit(1)).alias("videos"), *[F.count_if(source == s).alias(s) for s in ("soft", "ocr", "none")])


def build_alignment(inventory: DataFrame, poses: DataFrame, subtitles: DataFrame, cues: DataFrame,
                    known: DataFrame, dedup: bool = True, merge: bool = True) -> DataFrame:
    """Alignment rows of videos that have a pose and a subtitle and were not aligned before.

    ``poses`` has stem, bytes, fps, n_frames; ``subtitles`` is the pick per stem;
    ``cues`` has stem and path of its file; ``known`` has the aligned stems.
    """
    ready = (
        inventory.select("stem").join(known.select("stem"), "stem", "left_anti")
        .join(poses.filter("bytes > 0").select("stem", "fps", "n_frames"), "stem")
        .join(subtitles.select("stem", "path"), "stem"))
    rows = cues.join(ready.select("stem", "path"), ["stem", "path"], "left_semi")
    if dedup:
        rows = merge_near_duplicates(rows)
    if merge:
        rows = merge_short(rows)
    return align_to_frames(rows, ready.select("stem", "fps", "n_frames"))


def alignment_totals(raw: DataFrame, merged: DataFrame) -> DataFrame:
    """Cues read and segments kept."""
    return side_by_side(raw.agg(F.count(F.lit(1)).alias("raw_cues")),
                        merged.agg(F.count(F.lit(1)).alias("segments")))


def import_single_signs(videos: DataFrame, known: DataFrame, split_words: bool = True,
                        status: str = "approved") -> DataFrame:
    """One segment per video; labels of several words add one pending segment per word.

    ``videos`` has stem, fps, n_frames. Words share the middle 80 per cent equally.
    """
    stem = F.col("stem")
    numbered = stem.rlike(r"^\d+_")
    label = F.when(numbered, strip(F.regexp_replace(stem, r"^\d+_", ""))).otherwise(stem)
    rows = (
        videos.join(known.select("stem"), "stem", "left_anti").filter("n_frames > 0")
        .withColumn("label", label).filter("label <> ''")
        .withColumn("duration", F.floor(F.col("n_frames") / F.col("fps") * 1000).cast("long"))
        .withColumn("words", tokens("label")))
    last = F.col("n_frames") - 1

    def shaped(df: DataFrame, start: Column, end: Column, text: Column, f0: Column, f1: Column,
               n: Column, state: str) -> DataFrame:
        return df.select(
            segment_id("stem", start).alias("segment_id"), "stem", start.alias("start_ms"), end.alias("end_ms"),
            f0.alias("frame_start"), f1.alias("frame_end"), n.alias("n_frames"), text.alias("text"),
            F.lit(state).alias("status"))

    zero = F.lit(0).cast("long")
    whole = shaped(rows, zero, F.col("duration"), F.col("label"), zero, last, F.col("n_frames"), status)
    if not split_words:
        return whole
    trim = F.floor(F.col("duration") * 0.10).cast("long")
    active = F.greatest(F.col("duration") - 2 * trim, F.lit(1))
    parts = rows.filter(F.size("words") >= 2).withColumn("n", F.size("words")).withColumn(
        "trim", trim).withColumn("active", active).select(
        "*", F.posexplode("words").alias("i", "word"))
    start = (F.col("trim") + F.floor(F.col("active") * F.col("i") / F.col("n"))).cast("long")
    end = (F.col("trim") + F.floor(F.col("active") * (F.col("i") + 1) / F.col("n"))).cast("long")
    f0, f1 = F.least(ms_to_frame(start, "fps"), last), F.least(ms_to_frame(end, "fps"), last)
    return whole.unionByName(shaped(parts, start, end, F.col("word"), f0, f1,
                                    F.greatest(f1 - f0, zero), "pending"))


def whole_video_cues(segments: DataFrame, longest_ms: int = 60_000) -> DataFrame:
    """Videos whose only cue is longer than a minute."""
    one = segments.groupBy("stem").agg(F.count(F.lit(1)).alias("n"),
                                       F.max(F.col("end_ms") - F.col("start_ms")).alias("duration_ms"))
    return one.filter((F.col("n") == 1) & (F.col("duration_ms") > longest_ms)).drop("n")


def subtitles_or_translations(cues: DataFrame, with_file: DataFrame, annotations: DataFrame) -> DataFrame:
    """Cues where a video has a subtitle file, else its translation tier."""
    tier = annotations.filter((F.col("tier") == "S1_Translation") & ~blank("value")).select(
        "stem", "start_ms", "end_ms", strip("value").alias("text"))
    return cues.select("stem", "start_ms", "end_ms", "text").unionByName(
        tier.join(with_file.select("stem").distinct(), "stem", "left_anti"))


def apply_decisions(alignment: DataFrame, decisions: DataFrame, clips: DataFrame) -> DataFrame:
    """Review decisions per segment; an approval without frames is refused.

    ``decisions`` has segment_id, new_status, new_text, new_start_ms, new_end_ms.
    """
    rows = alignment.join(decisions, "segment_id", "left").join(
        clips.select("stem", F.col("n_frames").alias("_t")), "stem", "left")
    start, end = F.col("new_start_ms"), F.col("new_end_ms")
    frames = F.least(ms_to_frame(end, "fps"), F.col("_t") - 1) - F.least(ms_to_frame(start, "fps"), F.col("_t") - 1)
    taken = F.col("new_status").isNotNull() & ~((F.col("new_status") == "approved") & (frames <= 0))

    def pick(new: str, old: str) -> Column:
        return F.when(taken, F.col(new)).otherwise(F.col(old)).alias(old)

    rest = [c for c in alignment.columns if c not in
            ("status", "reviewed_text", "reviewed_start_ms", "reviewed_end_ms")]
    return rows.select(*rest, pick("new_status", "status"), pick("new_text", "reviewed_text"),
                       pick("new_start_ms", "reviewed_start_ms"), pick("new_end_ms", "reviewed_end_ms"))


def merge_with_next(alignment: DataFrame, merges: DataFrame) -> DataFrame:
    """Merge the named segments with the one after them.

    Decisions apply from first to last, and a segment that was absorbed takes no part any
    more: of adjacent named segments the first, third, ... absorb the one after them.
    """
    rows = rank_in_groups(alignment, ["stem"], F.floor(F.col("start_ms") / BUCKET_MS),
                          [F.col("start_ms"), F.col("segment_id")], "pos")
    named = rows.join(merges.select("segment_id").distinct(), "segment_id", "left_semi").select("stem", "pos")
    # A run of adjacent named rows shares pos - rank; its first row has the smallest pos.
    ranked = rank_in_groups(named, ["stem"], F.floor(F.col("pos") / 1024), [F.col("pos")], "_rank")
    ranked = ranked.withColumn("_run", F.col("pos") - F.col("_rank"))
    starts = ranked.groupBy("stem", "_run").agg(F.min("pos").alias("_from"))
    acting = ranked.join(starts, ["stem", "_run"]).filter((F.col("pos") - F.col("_from")) % 2 == 0).select(
        "stem", "pos", F.lit(True).alias("_acts"))
    follow = ["end_ms", "frame_end", "text", "reviewed_text", "segment_id"]
    out = next_rows(rows.join(acting, ["stem", "pos"], "left"), ["stem"], "pos", follow)
    acts = F.col("_acts") & F.col("next_segment_id").isNotNull()
    gone = out.filter(acts).select("stem", (F.col("pos") + 1).alias("pos"))
    out = out.join(gone, ["stem", "pos"], "left_anti")
    now, nxt = (strip(F.coalesce(c, F.lit(""))) for c in (F.col("reviewed_text"), F.col("next_reviewed_text")))
    reviewed = F.concat_ws("\n", F.when(now != "", now).otherwise(F.col("text")),
                           F.when(nxt != "", nxt).otherwise(F.col("next_text")))
    new = {
        "text": F.concat_ws("\n", "text", "next_text"), "end_ms": F.col("next_end_ms"),
        "reviewed_end_ms": F.col("next_end_ms"), "frame_end": F.col("next_frame_end"),
        "n_frames": F.col("next_frame_end") - F.col("frame_start"),
        "reviewed_text": F.when((now != "") | (nxt != ""), reviewed).otherwise(F.col("reviewed_text")),
    }
    return out.select(*[F.when(acts, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c)
                        for c in alignment.columns])


def anchored_windows(items: DataFrame, window_ms: int = 5000, chunk_ms: int = 3_600_000) -> DataFrame:
    """Group items (stem, item_no, start_ms): a group spans ``window_ms`` from its first start.

    Adds ``group_start`` and ``is_head``. The window does not slide. The start that follows a group is a function
    of the group's own start. The first head in a chunk of time follows a head before the chunk, so it is one of
    the points in the chunk's first ``window_ms`` or the point after them: each chunk is followed once from all of
    these, and the true entries are the orbit of the first start of a video over chunk entries only. Items of
    equal start are one point here, the head is the one with the smallest number, so a chunk has at most
    ``chunk_ms`` points.
    """
    points = checkpointed(items.filter("start_ms is not null").groupBy("stem", "start_ms").agg(F.min("item_no").alias("_first_no"))
                          .withColumn("chunk", chunk_of("start_ms", chunk_ms)))
    kinds = {f.name: f.dataType.simpleString() for f in points.schema}
    stem, start = kinds["stem"], kinds["start_ms"]

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        starts = np.sort(pdf["start_ms"].to_numpy())
        after = np.searchsorted(starts, starts + window_ms, side="right").tolist()
        last = list(range(len(starts)))
        for i in range(len(starts) - 1, -1, -1):
            if after[i] < len(starts):
                last[i] = last[after[i]]
        entries = np.searchsorted(starts, pdf["chunk"].iloc[0] * chunk_ms + window_ms, side="left") + 1
        ends = starts[last[:entries]]
        return pd.DataFrame({"stem": pdf["stem"].iloc[0], "chunk": pdf["chunk"].iloc[0], "node": starts[:entries], "last": ends})

    entries = checkpointed(points.groupBy("stem", "chunk").applyInPandas(follow, f"stem {stem}, chunk bigint, node {start}, last {start}"))
    begun = entries.groupBy("stem").agg(F.min("node").alias("node"))
    reached = begun
    if some(entries.groupBy("stem").agg(F.count_distinct("chunk").alias("n")).filter("n > 1")):
        probes = entries.select("stem", (F.col("last") + window_ms).cast(start).alias("start_ms"), "node")
        steps = next_after(entries.select("stem", F.col("node").alias("start_ms")), probes, ["stem"], "start_ms", "to")
        reached = orbit(checkpointed(steps.filter("to is not null").select("stem", "node", "to")), begun, ["stem"])
    # One row per chunk: where its first head lies, if it has one, and the last head before it.
    true = entries.join(reached.withColumn("_true", F.lit(True)), ["stem", "node"], "left")
    chunks = checkpointed(true.groupBy("stem", "chunk").agg(
        F.min(F.when(F.col("_true"), F.col("node"))).alias("_entry"), F.max(F.when(F.col("_true"), F.col("last"))).alias("_last")))
    before = last_before(chunks.select("stem", "chunk", F.col("_last").alias("_before")), ["stem"], ["_before"])
    placed = points.join(chunks.drop("_last").join(before, ["stem", "chunk"]), ["stem", "chunk"])

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("start_ms")
        starts, entry, carried = pdf["start_ms"].to_numpy(), pdf["_entry"].iloc[0], pdf["_before"].iloc[0]
        heads = [] if pd.isna(carried) else [int(carried)]
        at = len(starts) if pd.isna(entry) else int(np.searchsorted(starts, int(entry)))
        while at < len(starts):
            heads.append(starts[at])
            at = int(np.searchsorted(starts, starts[at] + window_ms, side="right"))
        heads = np.array(heads, dtype=starts.dtype)
        return pdf[["stem", "start_ms", "_first_no"]].assign(group_start=heads[np.searchsorted(heads, starts, side="right") - 1])

    placed = placed.groupBy("stem", "chunk").applyInPandas(
        place, f"stem {stem}, start_ms {start}, _first_no {kinds['_first_no']}, group_start {start}")
    is_head = (F.col("start_ms") == F.col("group_start")) & (F.col("item_no") == F.col("_first_no"))
    return items.select("stem", "item_no", "start_ms").join(placed, ["stem", "start_ms"]).select(
        "stem", "item_no", "start_ms", "group_start", is_head.alias("is_head"))
