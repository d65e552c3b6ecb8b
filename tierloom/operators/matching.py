"""Joins between videos, annotations, glossaries, predictions and reviews."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence
from heapq import heappop, heappush
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tierloom.fixed_values import AI_CONFIDENCE_TIER, AI_GLOSS_TIERS, HUMAN_GLOSS_TIERS
from tierloom.functions.blocks import by_range, some
from tierloom.functions.chunks import chunk_of, deal, rank_in_groups
from tierloom.functions.single_row import side_by_side
from tierloom.functions.text import blank, normalise_word, pairing_id, parse_pairing_id, plain_label, strip, tokens
from tierloom.functions.timecode import ms_to_frame
from tierloom.operators.glossary import first_gloss, next_gloss_id, parse_gloss, reverse_index
from tierloom.session import checkpointed


def last_per(rows: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """The last row per key; a partial aggregation, so hot keys shrink before the shuffle."""
    return rows.groupBy(*keys).agg(F.max(F.struct(order, *columns)).alias("_r")).select(
        *keys, *[F.col(f"_r.{c}").alias(c) for c in columns])


def first_per(rows: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.min(F.struct(*order, *columns)).alias("_r")).select(
        *keys, *[F.col(f"_r.{c}").alias(c) for c in columns])


def lookup_inventory(annotations: DataFrame, inventory: DataFrame, order: str = "row_no") -> DataFrame:
    """Path and frame rate per annotation; stems without a video drop out, the last duplicate wins."""
    return annotations.join(last_per(inventory, ["stem"], order, ["path", "fps"]), "stem")


def skip_known(rows: DataFrame, known: DataFrame, key: str = "stem") -> DataFrame:
    return rows.join(known.select(key).distinct(), key, "left_anti")


def harvest_glosses(annotations: DataFrame, inventory: DataFrame, glossary: DataFrame) -> DataFrame:
    """Human gloss annotations as paired signs; annotations has stem, tier, start_ms, end_ms, value."""
    hand = F.lit(None).cast("string")
    for tier, side in HUMAN_GLOSS_TIERS.items():
        hand = F.when(F.col("tier") == tier, side).otherwise(hand)
    rows = annotations.withColumn("hand", hand).filter(F.col("hand").isNotNull() & ~blank("value"))
    rows = parse_gloss(lookup_inventory(rows, inventory), "value", glossary)
    rest = [c for c in rows.columns if c in ("item_no",)]
    return rows.select(
        pairing_id("stem", "start_ms", "hand", F.lit("E")).alias("pairing_id"),
        F.concat(F.col("stem").cast("string"), F.lit("_eaf")).alias("segment_id"), "stem",
        F.col("path").alias("video_path"), "hand", F.col("start_ms").alias("sign_start_ms"),
        F.col("end_ms").alias("sign_end_ms"), ms_to_frame("start_ms", "fps").alias("sign_frame_start"),
        ms_to_frame("end_ms", "fps").alias("sign_frame_end"), "word", "gloss_id",
        F.lit("paired").alias("status"), "fps", F.lit("eaf_harvest").alias("note"), *rest)


SIGN_KEY = ["stem", "sign_start_ms", "hand"]


def merge_harvest(existing: DataFrame, harvested: DataFrame, order: str = "item_no") -> DataFrame:
    """New signs of a harvest: first per (stem, start, hand), and none that exists already."""
    columns = [c for c in harvested.columns if c not in (*SIGN_KEY, order)]
    fresh = first_per(harvested, SIGN_KEY, [order], columns)
    return fresh.join(existing.select(*SIGN_KEY).distinct(), SIGN_KEY, "left_anti")


def harvest_counts(files: DataFrame, harvested: DataFrame, new: DataFrame) -> DataFrame:
    """Files scanned, files with annotations, new signs and skipped repeats."""
    one = side_by_side(
        files.agg(F.count(F.lit(1)).alias("n_files_scanned")),
        harvested.agg(F.count_distinct("stem").alias("n_with_annotations"), F.count(F.lit(1)).alias("_all")),
        new.agg(F.count(F.lit(1)).alias("n_new")))
    return one.withColumn("n_skipped_dupes", F.col("_all") - F.col("n_new")).drop("_all")


def merge_suggestions(pairings: DataFrame, predictions: DataFrame, sentences: DataFrame,
                      glossary: DataFrame) -> DataFrame:
    """Fill suggestions of pending signs from predictions of the same segment, hand and start.

    Where the predicted gloss belongs to a word of the segment text, the first such word
    and the gloss are taken over and the sign counts as auto-suggested.
    ``predictions``: segment_id, hand, start_ms, predicted_gloss, confidence;
    ``sentences``: segment_id, text.
    """
    words = sentences.select("segment_id", F.posexplode(tokens("text")).alias("token_no", "raw")).withColumn(
        "word", normalise_word("raw"))
    by_gloss = words.join(reverse_index(glossary).select("word", "gloss_id").distinct(), "word").groupBy(
        "segment_id", "gloss_id").agg(F.min(F.struct("token_no", "raw"))["raw"].alias("_word"))
    guess = predictions.groupBy("segment_id", "hand", F.col("start_ms").alias("sign_start_ms")).agg(
        F.max(F.struct("confidence", "predicted_gloss")).alias("_p"))
    key = ["segment_id", "hand", "sign_start_ms"]
    rows = pairings.join(guess, key, "left").withColumn("_gloss", F.when(
        F.col("status") == "pending", F.col("_p.predicted_gloss")))
    rows = rows.join(by_gloss.withColumnRenamed("gloss_id", "_gloss"), ["segment_id", "_gloss"], "left")
    hit, mapped = F.col("_gloss").isNotNull(), F.col("_word").isNotNull()
    new = {
        "suggestion_gloss": F.when(hit, F.col("_gloss")), "suggestion_confidence": F.when(hit, F.col("_p.confidence")),
        "word": F.when(mapped, F.col("_word")), "gloss_id": F.when(mapped, F.col("_gloss")),
        "status": F.when(mapped, F.lit("auto_suggested")),
    }
    return rows.select(*[F.coalesce(new[c], F.col(c)).alias(c) if c in new else F.col(c) for c in pairings.columns])


def predictions_of_tiers(annotations: DataFrame) -> DataFrame:
    """Predictions read back from the AI tiers, each with its confidence.

    The confidence is that of the same start and end, else the last one with the same
    start, else 0. ``annotations`` has stem, tier, ann_no, start_ms, end_ms, value.
    """
    conf = annotations.filter(F.col("tier") == AI_CONFIDENCE_TIER).withColumn(
        "v", F.coalesce(F.col("value").try_cast("double"), F.lit(0.0)))
    exact = last_per(conf, ["stem", "start_ms", "end_ms"], "ann_no", ["v"]).withColumnRenamed("v", "_exact")
    near = last_per(conf, ["stem", "start_ms"], "ann_no", ["v"]).withColumnRenamed("v", "_near")
    hand = F.lit(None).cast("string")
    for tier, side in AI_GLOSS_TIERS.items():
        hand = F.when(F.col("tier") == tier, side).otherwise(hand)
    rows = annotations.withColumn("hand", hand).filter(F.col("hand").isNotNull() & ~blank("value"))
    return (rows.join(exact, ["stem", "start_ms", "end_ms"], "left").join(near, ["stem", "start_ms"], "left")
            .select("stem", "hand", "ann_no", "start_ms", "end_ms", strip("value").alias("predicted_gloss"),
                    F.coalesce("_exact", "_near", F.lit(0.0)).alias("confidence")))


def _ai_tier(hand: Column) -> Column:
    """Gloss tier of a hand; anything but the right hand goes to the left one."""
    right, left = (next(t for t, h in AI_GLOSS_TIERS.items() if h == side) for side in ("right", "left"))
    return F.when(hand == "right", right).otherwise(left)


def tier_rows(predictions: DataFrame) -> DataFrame:
    """Tier annotations of predictions: a gloss row on the tier of its hand and a confidence row."""
    tier = _ai_tier(F.col("hand"))
    rows = F.array(F.struct(tier.alias("tier"), F.col("predicted_gloss").alias("value")),
                   F.struct(F.lit(AI_CONFIDENCE_TIER).alias("tier"),
                            F.bround("confidence", 3).cast("string").alias("value")))
    return predictions.select("stem", "start_ms", "end_ms", F.inline(rows))


def detection_tier_rows(found: DataFrame) -> DataFrame:
    """Tier annotations of detected segments: "?" on both hands, confidence for the right hand only."""
    tier = _ai_tier(F.col("hand"))
    mark = F.struct(tier.alias("tier"), F.lit("?").alias("value"))
    conf = F.struct(F.lit(AI_CONFIDENCE_TIER).alias("tier"), F.col("score").cast("string").alias("value"))
    rows = F.filter(F.array(mark, F.when(F.col("hand") == "right", conf)), lambda r: r.isNotNull())
    return found.select("stem", "start_ms", "end_ms", F.inline(rows))


def replace_ai_tiers(annotations: DataFrame, new: DataFrame) -> DataFrame:
    """Clear the AI tiers of the stems that have new rows, keep everything else, add the rows."""
    ai = [*AI_GLOSS_TIERS, AI_CONFIDENCE_TIER]
    stems = new.select("stem").distinct()
    other = annotations.filter(~F.col("tier").isin(ai))
    untouched = annotations.filter(F.col("tier").isin(ai)).join(stems, "stem", "left_anti")
    columns = ["stem", "tier", "start_ms", "end_ms", "value"]
    return other.select(*columns).unionByName(untouched.select(*columns)).unionByName(new.select(*columns))


def tier_counts(annotations: DataFrame, tiers: Sequence[str]) -> DataFrame:
    """Annotations per stem and standard tier; tiers without any count as 0."""
    counts = annotations.groupBy("stem").agg(*[F.count_if(F.col("tier") == t).alias(t) for t in tiers])
    pairs = F.array(*[F.struct(F.lit(t).alias("tier"), F.col(t).alias("n")) for t in tiers])
    return counts.select("stem", F.inline(pairs))


# -- two hands ----------------------------------------------------------------------

def overlap_candidates(predictions: DataFrame, least_ms: int = 100) -> DataFrame:
    """Right and left predictions of one stem that overlap by at least ``least_ms`` (1 or more).

    A sweep over starts keeps, per hand, the intervals that can still overlap enough with what starts now or
    later, so no pair is formed that does not count. Starts are dealt by ranges of equal size; an interval
    that reaches into later ranges is carried into each of them, where it is active from the beginning.
    """
    rows = predictions.filter(F.col("hand").isin("right", "left") & (F.col("end_ms") - F.col("start_ms") >= least_ms)).select(
        "stem", "item_no", "hand", "start_ms", "end_ms")
    dealt = by_range(rows, [F.col("stem"), F.col("start_ms")])
    firsts = dealt.groupBy("stem", "_range").agg(F.min("start_ms").alias("_from"))
    later = firsts.select("stem", F.col("_range").alias("_to"), "_from")
    ahead = Window.partitionBy("stem").orderBy("_range")
    reach = firsts.select("stem", "_range", F.lead("_from").over(ahead).alias("_next"))
    carried = (dealt.join(reach, ["stem", "_range"]).filter(F.col("end_ms") - least_ms >= F.col("_next"))
               .join(later, "stem").filter((F.col("_to") > F.col("_range")) & (F.col("end_ms") - least_ms >= F.col("_from")))
               .select("stem", "item_no", "hand", "start_ms", "end_ms", F.col("_to").alias("_range"), F.lit(True).alias("_old")))
    every = dealt.withColumn("_old", F.lit(False)).unionByName(carried)
    kind = predictions.schema["stem"].dataType.simpleString()

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, active, found = None, {}, []

        def told(stem_type: pa.DataType) -> pa.RecordBatch:
            columns = list(zip(*found)) or [()] * 5
            types = [pa.int64()] * 4 + [stem_type]
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["right_no", "left_no", "rs", "overlap_ms", "stem"])

        for batch in batches:
            stem_type = batch.schema.field("stem").type
            for stem, part, number, hand, start, end, old in zip(*(batch.column(c).to_pylist() for c in ("stem", "_range", "item_no", "hand", "start_ms", "end_ms", "_old"))):
                if group != (stem, part):
                    group, active = (stem, part), {"right": [], "left": []}
                if not old:
                    others = active["left" if hand == "right" else "right"]
                    while others and others[0][0] - start < least_ms:
                        heappop(others)
                    for until, other, began in others:
                        right, left, rs = (number, other, start) if hand == "right" else (other, number, began)
                        found.append((right, left, rs, min(end, until) - start, stem))
                    if len(found) >= 100_000:
                        yield told(stem_type)
                heappush(active[hand], (end, number, start))
            yield told(stem_type)

    pairs = deal(every, ["stem", "_range"], [F.col("_old").desc(), "start_ms", "item_no"]).mapInArrow(
        sweep, f"right_no bigint, left_no bigint, rs bigint, overlap_ms bigint, stem {kind}")
    return pairs.select("stem", "right_no", "left_no", "rs", "overlap_ms")


def pair_hands(predictions: DataFrame, least_ms: int = 100, chunk_ms: int = 600_000) -> DataFrame:
    """Greedy one-to-one pairs: in input order each right prediction takes the free left one
    with the largest overlap (first on ties).

    Right predictions are worked off per ten-minute chunk. Left ones that an earlier chunk took are
    blocked; chunks whose blocked ones changed are worked off again until none changes, which is
    the result of one pass over the whole video.
    """
    edges = checkpointed(overlap_candidates(predictions, least_ms).withColumn("chunk", chunk_of("rs", chunk_ms)))
    kind = edges.schema["stem"].dataType.simpleString()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, done, used = None, set(), set()
        for batch in batches:
            taken = []
            for i, (stem, chunk, right, left) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("stem", "chunk", "right_no", "left_no")))):
                if group != (stem, chunk):
                    group, done, used = (stem, chunk), set(), set()
                if right not in done and left not in used:
                    done.add(right)
                    used.add(left)
                    taken.append(i)
            yield batch.select(["stem", "chunk", "right_no", "left_no"]).take(pa.array(taken, pa.int64()))

    def taken_of(rows: DataFrame) -> DataFrame:
        dealt = deal(rows, ["stem", "chunk"], ["rs", "right_no", F.col("overlap_ms").desc(), "left_no"])
        return dealt.mapInArrow(walk, f"stem {kind}, chunk bigint, right_no bigint, left_no bigint")

    pairs = checkpointed(taken_of(edges))
    # Only a left prediction with candidates in two chunks can be contested.
    shared = edges.groupBy("stem", "left_no").agg(F.min("chunk").alias("_a"), F.max("chunk").alias("_b")).filter("_a < _b").select("stem", "left_no")
    if not some(shared):
        return pairs.drop("chunk")
    place = ["stem", "left_no", "chunk"]
    contested = checkpointed(edges.select(*place).distinct().join(shared, ["stem", "left_no"], "left_semi"))
    before = contested.limit(0)
    while True:
        owners = pairs.groupBy("stem", "left_no").agg(F.min("chunk").alias("_owner"))
        blocked = checkpointed(contested.join(owners, ["stem", "left_no"]).filter(F.col("_owner") < F.col("chunk")).select(*place))
        changed = checkpointed(blocked.exceptAll(before).unionByName(before.exceptAll(blocked)).select("stem", "chunk").distinct())
        if not some(changed):
            return pairs.drop("chunk")
        again = taken_of(edges.join(changed, ["stem", "chunk"], "left_semi").join(blocked, place, "left_anti"))
        pairs = checkpointed(pairs.join(changed, ["stem", "chunk"], "left_anti").unionByName(again))
        before = blocked


def review_units(predictions: DataFrame, pairs: DataFrame) -> DataFrame:
    """Review units: paired hands share one unit, the others stand alone.

    A unit of two is approved or skipped only if both are.
    """
    rows = predictions.select("stem", "item_no", "hand", "start_ms", "end_ms", "predicted_gloss", "confidence",
                              F.coalesce("review_status", F.lit("pending")).alias("review_status"))
    left = rows.select("stem", F.col("item_no").alias("left_no"), F.col("start_ms").alias("_ls"),
                       F.col("end_ms").alias("_le"), F.col("review_status").alias("_lst"))
    heads = rows.join(pairs.select("stem", F.col("left_no").alias("item_no")), ["stem", "item_no"], "left_anti")
    # Left hands meet their pairs first: heads without one would all have the same null key.
    both = pairs.join(left, ["stem", "left_no"], "left").withColumnRenamed("right_no", "item_no")
    joined = heads.join(both, ["stem", "item_no"], "left")
    two = F.col("left_no").isNotNull()
    same = (F.col("review_status") == F.col("_lst")) & F.col("review_status").isin("approved", "skipped")
    return joined.select(
        "stem", "item_no", "left_no", F.when(two, "RH+LH").when(F.col("hand") == "right", "RH").otherwise("LH").alias("hands"),
        F.least("start_ms", "_ls").alias("start_ms"), F.greatest("end_ms", "_le").alias("end_ms"),
        F.col("predicted_gloss").alias("primary_gloss"), F.col("confidence").alias("primary_confidence"),
        F.when(~two | same, F.col("review_status")).otherwise("pending").alias("review_status"))


def prediction_clusters(predictions: DataFrame, max_gap_ms: int = 15_000, max_span_ms: int = 45_000,
                        chunk_ms: int = 600_000) -> DataFrame:
    """For every prediction the time span of its neighbours: grown forward, then backward, while
    gaps and total span stay within the limits.

    A span never reaches past ``max_span_ms`` (or the prediction's own length), so a chunk
    with the predictions of its surroundings decides its own rows.
    """
    reach = max_span_ms + max_gap_ms
    first = F.greatest(chunk_of(F.col("start_ms") - reach, chunk_ms), F.lit(0).cast("long"))
    spread = F.sequence(first, chunk_of(F.col("end_ms") + reach, chunk_ms))
    rows = predictions.select("stem", "item_no", "start_ms", "end_ms", F.explode(spread).alias("chunk"))
    kind = predictions.schema["stem"].dataType.simpleString()

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["start_ms", "item_no"], kind="stable")
        starts, ends = pdf["start_ms"].tolist(), pdf["end_ms"].tolist()
        longest = list(accumulate(ends, max))
        home = (pdf["start_ms"] // chunk_ms == pdf["chunk"]).tolist()
        out = []
        for i, number in enumerate(pdf["item_no"].tolist()):
            if not home[i]:
                continue
            lo, hi = starts[i], ends[i]
            # Items that end before this one starts cannot move the end of the span.
            for j in range(bisect_right(longest, lo), len(starts)):
                if starts[j] > hi + max_gap_ms or ends[j] - lo > max_span_ms:
                    break
                hi = max(hi, ends[j])
            # Items that start after it cannot move the start.
            for j in range(bisect_left(starts, lo) - 1, -1, -1):
                if ends[j] < lo - max_gap_ms or hi - starts[j] > max_span_ms:
                    break
                lo = min(lo, starts[j])
            out.append((pdf["stem"].iloc[0], number, lo, hi))
        return pd.DataFrame(out, columns=["stem", "item_no", "cluster_start_ms", "cluster_end_ms"])

    return rows.groupBy("stem", "chunk").applyInPandas(
        grow, f"stem {kind}, item_no bigint, cluster_start_ms bigint, cluster_end_ms bigint")


# -- reviews ------------------------------------------------------------------------

def review_status(predictions: DataFrame, pairings: DataFrame) -> DataFrame:
    """Add ``review_status`` from pairings of the same stem, hand and start.

    A pairing made in review carries the start of its prediction in the id (``_R``),
    which holds after trimming. ``pairings`` has row_no, pairing_id, stem, hand,
    sign_start_ms, status; the last one wins.
    """
    coded = parse_pairing_id("pairing_id")
    start = F.when(coded["tag"] == "R", coded["start_ms"]).otherwise(F.col("sign_start_ms"))
    keyed = pairings.select("stem", "hand", start.alias("start_ms"), "row_no", "status")
    latest = last_per(keyed, ["stem", "hand", "start_ms"], "row_no", ["status"])
    state = F.when(F.col("status") == "paired", "approved").when(F.col("status") == "skipped", "skipped").otherwise("pending")
    rows = predictions.drop("review_status") if "review_status" in predictions.columns else predictions
    return rows.join(latest, ["stem", "hand", "start_ms"], "left").withColumn("review_status", state).drop("status")


def reviewed_per_video(predictions: DataFrame) -> DataFrame:
    done = F.col("review_status") != "pending"
    return predictions.groupBy("stem").agg(F.count(F.lit(1)).alias("n_predictions"), F.count_if(done).alias("n_reviewed"))


def upsert(rows: DataFrame, changes: DataFrame, key: str = "pairing_id", order: str | None = None) -> DataFrame:
    """Replace rows with the same id and add new ones; of several changes the last wins."""
    if order is not None:
        changes = last_per(changes, [key], order, [c for c in rows.columns if c != key])
    return rows.join(changes.select(key), key, "left_anti").unionByName(changes.select(*rows.columns))


def undo(history: DataFrame, key: str = "pairing_id", version: str = "version") -> DataFrame:
    """State before the newest version of each id; ids that had no earlier version disappear.

    ``history`` holds every version ever written, numbered in order.
    """
    columns = [c for c in history.columns if c not in (key, version)]
    newest = history.groupBy(key).agg(F.max(version).alias("_newest"))
    before = history.join(newest, key).filter(F.col(version) < F.col("_newest")).drop("_newest")
    return last_per(before, [key], version, columns)


def manual_pairings(requests: DataFrame) -> DataFrame:
    """Signs marked by hand: stem, item_no, hand, start_ms, end_ms, fps. Rows with another hand
    than right or left have ``error`` set and no id. They are numbered by item, start, hand, then stem, so that
    ids do not depend on the order in which equal items of several videos arrive."""
    ok = F.coalesce(F.col("hand").isin("right", "left"), F.lit(False))
    numbered = rank_in_groups(requests.withColumn("_ok", ok), ["_ok"], F.floor(F.col("item_no") / 65_536),
                              [F.col(c) for c in ("item_no", "start_ms", "hand", "stem", "end_ms", "fps")], "_n")
    tag = F.concat(F.lit("M"), (F.col("_n") + 1).cast("string"))
    return numbered.select(
        F.when(F.col("_ok"), pairing_id("stem", "start_ms", "hand", tag)).alias("pairing_id"), "item_no", "stem", "hand",
        F.col("start_ms").alias("sign_start_ms"), F.col("end_ms").alias("sign_end_ms"),
        ms_to_frame("start_ms", "fps").alias("sign_frame_start"), ms_to_frame("end_ms", "fps").alias("sign_frame_end"),
        F.lit("pending").alias("status"), F.lit("manual").alias("note"),
        F.when(~F.col("_ok"), "hand must be right or left").alias("error"))


def cut_interval(units: DataFrame, resolved: DataFrame) -> DataFrame:
    """Pieces of a unit between its cut points, for each hand.

    ``units``: unit_id, stem, start_ms, end_ms, unit_start_ms, unit_end_ms, cuts (array of ms),
    preds (array of struct<hand, start_ms, end_ms>, first one leads), fps, compound.
    ``resolved``: unit_id, piece, word, gloss_id.
    """
    inner = F.array_sort(F.filter("cuts", lambda c: (c > F.col("start_ms")) & (c < F.col("end_ms"))))
    edges = F.concat(F.array("start_ms"), inner, F.array("end_ms"))
    rows = units.withColumn("_edges", edges).filter(F.size("_edges") > 2)
    # Pieces and hands are told apart after the join, so a unit is shuffled as one row.
    rows = rows.join(resolved, "unit_id").filter((F.col("piece") >= 0) & (F.col("piece") < F.size("_edges") - 1))
    at = F.col("piece").cast("int")
    rows = rows.withColumn("p", F.struct(F.get("_edges", at).alias("s"), F.get("_edges", at + 1).alias("e")))
    rows = rows.select("*", F.posexplode("preds").alias("pred_no", "d"))
    first = F.col("piece") == 0
    tag = F.when(first & (F.col("pred_no") == 0), "R").otherwise("C")
    start = F.when(first, F.col("d.start_ms")).otherwise(F.col("p.s"))
    trimmed = (F.col("start_ms") != F.col("unit_start_ms")) | (F.col("end_ms") != F.col("unit_end_ms"))
    note = F.concat(F.lit("ai_review_cut"), F.when(~blank("compound"), F.concat(F.lit("|compound:"), "compound")).otherwise(""),
                    F.when(trimmed, F.format_string("|trimmed_%d-%d", "d.start_ms", "d.end_ms")).otherwise(""))
    return rows.select(
        pairing_id("stem", start, F.col("d.hand"), tag).alias("pairing_id"), "unit_id",
        F.col("piece").cast("long").alias("piece"), F.col("d.hand").alias("hand"), F.col("p.s").alias("sign_start_ms"),
        F.col("p.e").alias("sign_end_ms"), ms_to_frame("p.s", "fps").alias("sign_frame_start"),
        ms_to_frame("p.e", "fps").alias("sign_frame_end"), "word", "gloss_id", note.alias("note"),
        F.lit("paired").alias("status"))


def replace_detections(pairings: DataFrame, found: DataFrame) -> DataFrame:
    """New detections of a segment replace all its pairings; a segment without any keeps its own."""
    return pairings.join(found.select("segment_id").distinct(), "segment_id", "left_anti").unionByName(
        found, allowMissingColumns=True)


def reviewer_regions(regions: DataFrame, glossary: DataFrame) -> DataFrame:
    """Regions a reviewer added (stem, hand, start_ms, end_ms, value, fps); unresolvable ones drop out."""
    rows = parse_gloss(regions, "value", glossary).filter((F.col("word") != "") | (F.col("gloss_id") != ""))
    return rows.select(
        pairing_id("stem", "start_ms", "hand", F.lit("N")).alias("pairing_id"), "stem", "hand",
        F.col("start_ms").alias("sign_start_ms"), F.col("end_ms").alias("sign_end_ms"),
        ms_to_frame("start_ms", "fps").alias("sign_frame_start"), ms_to_frame("end_ms", "fps").alias("sign_frame_end"),
        "word", "gloss_id", F.lit("paired").alias("status"), F.lit("ai_review_new_label").alias("note"))


def decide_pairings(pairings: DataFrame, decisions: DataFrame, glossary: DataFrame) -> DataFrame:
    """Pair, skip or unpair signs.

    ``decisions``: pairing_id, action, words (array), start_ms, end_ms, note. Pairing takes the
    first gloss of the first word, or the next free id of that word, which is the same for
    all decisions on the same unknown word.
    """
    word = normalise_word(F.get("words", F.lit(0)))
    rows = decisions.withColumn("_word", F.when(F.col("action") == "pair", word)).join(
        first_gloss(glossary).select(F.col("word").alias("_word"), F.col("gloss_id").alias("_known")), "_word", "left")
    unknown = rows.filter(F.col("_known").isNull() & F.col("_word").isNotNull()).select("_word").distinct()
    made = next_gloss_id(unknown, "_word", glossary).select("_word", F.col("gloss_id").alias("_made"))
    rows = rows.join(made, "_word", "left").select(
        "pairing_id", "action", F.array_join("words", " ").alias("_text"), F.coalesce("_known", "_made").alias("_gloss"),
        F.col("start_ms").alias("_s"), F.col("end_ms").alias("_e"), F.col("note").alias("_note"))
    out = pairings.join(rows, "pairing_id", "left")
    pair, skip, unpair = (F.coalesce(F.col("action") == a, F.lit(False)) for a in ("pair", "skip", "unpair"))

    def column(name: str, paired: Column, unpaired: Column | None = None) -> Column:
        value = F.when(pair, paired)
        if unpaired is not None:
            value = value.when(unpair, unpaired)
        return value.otherwise(F.col(name)).alias(name)

    status = F.when(pair, "paired").when(skip, "skipped").when(unpair, "pending").otherwise(F.col("status"))
    new = {
        "word": column("word", F.col("_text"), F.lit("")), "gloss_id": column("gloss_id", F.col("_gloss"), F.lit("")),
        "status": status.alias("status"), "sign_start_ms": column("sign_start_ms", F.col("_s")),
        "sign_end_ms": column("sign_end_ms", F.col("_e")),
        "sign_frame_start": column("sign_frame_start", ms_to_frame("_s", "fps")),
        "sign_frame_end": column("sign_frame_end", ms_to_frame("_e", "fps")), "note": column("note", F.col("_note")),
    }
    return out.select(*[new.get(c, F.col(c)) for c in pairings.columns])


def new_glosses_of(decided: DataFrame, glossary: DataFrame) -> DataFrame:
    """Glosses that decisions created: gloss_id and lemma."""
    return decided.filter((F.col("status") == "paired") & (F.col("gloss_id") != "")).join(
        glossary.select("gloss_id").distinct(), "gloss_id", "left_anti").groupBy("gloss_id").agg(
        F.min(normalise_word(F.split("word", " ")[0])).alias("lemma"))


# -- files and manifests --------------------------------------------------------------

def match_by_suffix(files: DataFrame, ids: DataFrame) -> DataFrame:
    """Longest known id that a file stem ends with (after an underscore).

    Every tail after an underscore is a candidate, so this is one equi join instead of a
    scan of all ids per file. ``matched_id`` is null for files without a known id.
    """
    parts = F.split("stem", "_")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts) - 1),
                        lambda i: F.array_join(F.slice(parts, i + 1, F.size(parts)), "_"))
    candidates = files.filter(F.col("stem").contains("_")).select("stem", F.explode(tails).alias("video_id"))
    hits = candidates.join(ids.select("video_id").distinct(), "video_id").groupBy("stem").agg(
        F.max_by("video_id", F.length("video_id")).alias("matched_id"))
    return files.join(hits, "stem", "left")


def one_file_per_id(matched: DataFrame) -> DataFrame:
    """The first file (by name) of each id."""
    return matched.filter(F.col("matched_id").isNotNull()).groupBy("matched_id").agg(F.min("stem").alias("stem"))


def suffix_match_counts(matched: DataFrame) -> DataFrame:
    return matched.agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("matched_id").isNull()).alias("unmatched"),
                       (F.count("matched_id") - F.count_distinct("matched_id")).alias("duplicates"))


def labels_of_videos(entries: DataFrame) -> DataFrame:
    """One row per video and label with the angle of its first mention.

    ``entries``: row_no, label, video_ids (array); the second id of an entry is the side view.
    """
    rows = entries.select("row_no", plain_label("label").alias("label"),
                          F.posexplode("video_ids").alias("place", "video_id"))
    angle = F.when(F.col("place") == 1, "side").otherwise("front")
    return rows.withColumn("angle", angle).groupBy("video_id", "label").agg(
        F.min(F.struct("row_no", "place", "angle"))["angle"].alias("angle"))


def manifest_by_stem(files: DataFrame, labels: DataFrame, source: str) -> DataFrame:
    """Manifest rows of files whose stem has a label (stem, label, angle)."""
    return files.join(labels, "stem").select(
        F.col("path").alias("npz_path"), F.col("stem").alias("segment_id"), F.col("label").alias("text"), "label",
        F.lit(source).alias("source"), "angle")


def with_frame_counts(manifest: DataFrame, frames: DataFrame) -> DataFrame:
    """Frames and landmarks per manifest row; files without any count as 0 and 0."""
    sizes = frames.groupBy(F.col("clip").alias("segment_id")).agg(
        F.count(F.lit(1)).alias("n_frames"), F.max("n_landmarks").alias("n_landmarks"))
    zero = F.lit(0).cast("long")
    return manifest.join(sizes, "segment_id", "left").withColumn(
        "n_frames", F.coalesce("n_frames", zero)).withColumn("n_landmarks", F.coalesce("n_landmarks", zero))


def category_by_prefix(segments: DataFrame, categories: DataFrame) -> DataFrame:
    """Label segments with the category of the video their id starts with (``{stem}_``)."""
    parts = F.split("segment_id", "_")
    heads = F.transform(F.sequence(F.lit(1), F.size(parts) - 1),
                        lambda i: F.array_join(F.slice(parts, F.lit(1), i), "_"))
    rows = segments.filter(F.col("segment_id").contains("_")).select("segment_id", F.explode(heads).alias("stem"))
    return rows.join(categories, "stem").select("segment_id", "stem", F.col("category").alias("label"))


def videos_with_articles(videos: DataFrame, articles: DataFrame) -> DataFrame:
    """Videos that have an article, with the article whose video id is the second part of the file name; last article wins."""
    latest = last_per(articles.filter(F.col("youtube_id").isNotNull()), ["youtube_id"], "row_no", ["title", "date", "text"])
    return _with_video_id(videos).join(latest, "youtube_id").withColumn("text_len", F.length("text").cast("long"))


def _with_video_id(videos: DataFrame) -> DataFrame:
    part = F.try_element_at(F.split("video_file", "_", 3), F.lit(2))
    return videos.withColumn("youtube_id", F.regexp_replace(part, r"\.mp4$", "")).filter(F.col("youtube_id").isNotNull())


def videos_without_article(videos: DataFrame, articles: DataFrame) -> DataFrame:
    """Number of videos with an id that no article has."""
    return _with_video_id(videos).join(articles.select("youtube_id"), "youtube_id", "left_anti").agg(F.count(F.lit(1)).alias("n_unmatched"))


def prefer_extended(manifest: DataFrame, extended: DataFrame, source: str = "existing") -> DataFrame:
    """Path and landmark count of the extended export where one exists for a row of ``source``."""
    better = extended.select("segment_id", F.col("npz_path").alias("_path")).dropDuplicates(["segment_id"])
    rows = manifest.join(better, "segment_id", "left")
    use = F.col("_path").isNotNull() & (F.col("source") == source)
    return rows.withColumn("npz_path", F.when(use, F.col("_path")).otherwise(F.col("npz_path"))).withColumn(
        "n_landmarks", F.when(use, F.lit(148).cast("long")).otherwise(F.coalesce("n_landmarks", F.lit(96).cast("long")))).drop("_path")


def resolve_paths(manifest: DataFrame, files: DataFrame, folder: str) -> DataFrame:
    """The explicit path if that file exists, else ``folder/segment_id.npz``."""
    known = files.select(F.col("path").alias("npz_path")).distinct().withColumn("_there", F.lit(True))
    fallback = F.concat(F.lit(folder + "/"), F.col("segment_id").cast("string"), F.lit(".npz"))
    return manifest.join(known, "npz_path", "left").withColumn(
        "resolved", F.when(F.col("_there"), F.col("npz_path")).otherwise(fallback)).drop("_there")
