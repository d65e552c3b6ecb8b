"""Readers, writers, splits and incremental jobs."""

import json
import os
import re
import tempfile
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tierloom.operators import label_sets as LS
from tierloom.operators import landmarks as L
from tierloom.operators import matching as M
from tierloom.operators import metrics as ME
from tierloom.operators import search as SE
from tierloom.operators.cues import merge_with_next
from tierloom.sources import annotations as AN
from tierloom.sources import sinks, subtitles, tables
from tierloom.streaming import incremental as ST


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def test_webvtt_round_trip(spark, folder):
    rows = [("a", 0, 0, 1500, "one"), ("a", 1, 2000, 2500, "two\nlines"), ("b", 0, 5, 10, "x"), ("ä b%20+", 0, 7, 9, "é ~from1"), ("v.sk", 0, 1, 2, "z")]
    cues = spark.createDataFrame(rows, "stem string, cue_no bigint, start_ms bigint, end_ms bigint, text string")
    subtitles.write_webvtt(cues, folder)
    assert sorted(f for f in os.listdir(folder) if not f.startswith((".", "_"))) == sorted(f"{r[0]}.vtt" for r in rows if r[1] == 0)
    with open(f"{folder}/a.vtt") as fh:
        assert fh.read() == "WEBVTT\n\n1\n00:00:00.000 --> 00:00:01.500\none\n\n2\n00:00:02.000 --> 00:00:02.500\ntwo\nlines\n"
    got = subtitles.read_webvtt(spark, folder).drop("path").collect()
    assert sorted(map(tuple, got)) == sorted(rows)
    subtitles.write_webvtt(cues.filter("stem = 'b'"), folder)
    assert [r["stem"] for r in subtitles.read_webvtt(spark, folder).collect()] == ["b"]


def test_webvtt_documents_stay_whole(spark, folder):
    rows = [(f"v{v}", i, i * 1000, i * 1000 + 500, f"t{i}\n\nmore") for v in range(30) for i in range(40)]
    cues = spark.createDataFrame(rows, "stem string, cue_no bigint, start_ms bigint, end_ms bigint, text string").repartition(8)
    want = sorted((*r[:4], r[4].replace("\n\n", "\n")) for r in rows)
    subtitles.write_webvtt(cues, f"{folder}/out")
    assert len([f for f in os.listdir(f"{folder}/out") if f.endswith(".vtt")]) == 30
    assert sorted(map(tuple, subtitles.read_webvtt(spark, f"{folder}/out").drop("path").collect())) == want
    subtitles.write_webvtt(cues, f"{folder}/cut", most=16)
    assert len([f for f in os.listdir(f"{folder}/cut") if f.endswith(".vtt")]) == 90
    assert sorted(map(tuple, subtitles.read_webvtt(spark, f"{folder}/cut").drop("path").collect())) == want


def test_webvtt_job_that_fails_leaves_nothing(spark, folder):
    cues = spark.createDataFrame([("a", 0, 0, 1500, "one"), ("b", 0, 0, 1500, "two")], "stem string, cue_no bigint, start_ms bigint, end_ms bigint, text string")
    subtitles.write_webvtt(cues, f"{folder}/out")
    broken = cues.withColumn("text", F.when(F.col("stem") == "b", F.raise_error(F.lit("no"))).otherwise(F.col("text")))
    with pytest.raises(Exception):
        subtitles.write_webvtt(broken, f"{folder}/out")
    assert sorted(os.listdir(f"{folder}/out")) == ["a.vtt", "b.vtt"]


def test_webvtt_pattern_is_that_of_the_format(spark, folder):
    text = ("WEBVTT\n\n00:01.000 --> 00:02.000\nshort hour\n\n00:00:01.000 --> 00:00:02.000\n  \n\n"
            "00:00:03.000 -->  00:00:04.250\nlast\n\n\n1\n00:01:03.000 --> 00:01:04.250 \na\nb\n")
    with open(f"{folder}/v.sk.vtt", "w") as fh:
        fh.write(text)
    stamp = r"(\d{2}:\d{2}:\d{2}\.\d{3})"
    want = [(m[0], m[2].strip()) for m in re.findall(rf"(?s){stamp}\s+-->\s+{stamp}\s*\n(.*?)(?=\n\n|\Z)", text)]
    got = subtitles.read_webvtt(spark, folder).orderBy("cue_no").collect()
    assert [(r["start_ms"], r["text"]) for r in got] == [(sum(int(x) * y for x, y in zip(re.split("[:.]", s), (3_600_000, 60_000, 1000, 1))), t)
                                                         for s, t in want if t]
    assert got[0]["stem"] == "v.sk"


def test_annotation_files(spark, folder):
    good = ('<?xml version="1.0"?><ANNOTATION_DOCUMENT><TIME_ORDER><TIME_SLOT TIME_SLOT_ID="t1" TIME_VALUE="5"/>'
            '<TIME_SLOT TIME_SLOT_ID="t2" TIME_VALUE="90"/></TIME_ORDER><TIER TIER_ID="S1_Gloss_RH"><ANNOTATION><ALIGNABLE_ANNOTATION '
            'ANNOTATION_ID="a1" TIME_SLOT_REF1="t1" TIME_SLOT_REF2="t2"><ANNOTATION_VALUE>WATER-1</ANNOTATION_VALUE>'
            '</ALIGNABLE_ANNOTATION></ANNOTATION></TIER><TIER TIER_ID="S1_Mouthing"/></ANNOTATION_DOCUMENT>')
    for name, text in (("g.eaf", good), ("bad.eaf", "<ANNOTATION_DOCUMENT><TIER")):
        with open(f"{folder}/{name}", "w") as fh:
            fh.write(text)
    rows = AN.read_annotations(spark, folder).collect()
    assert [tuple(r) for r in rows] == [("g", "S1_Gloss_RH", 5, 90, "WATER-1")]


def test_landmark_files(spark, folder):
    lines = [json.dumps({"frame": 0, "timestamp": 0.0, "landmarks": [[0.1, 0.2, 0.9], [0.5, 0.5]]}), "{oops",
             json.dumps({"frame": 2, "timestamp": 0.1, "landmarks": [[0.3, 0.4, 0.8]] * 600})]
    with open(f"{folder}/c.jsonl", "w") as fh:
        fh.write("\n".join(lines))
    rows = AN.read_pose_lines(spark, folder).orderBy("frame").collect()
    assert [(r["clip"], r["frame"], len(r["pts"])) for r in rows] == [("c", 0, 543), ("c", 1, 543)]
    assert tuple(rows[0]["pts"][0]) == (0.1, 0.2, 0.0, 0.9) and tuple(rows[0]["pts"][1]) == (0, 0, 0, 0)
    assert tuple(rows[1]["pts"][542]) == (0.3, 0.4, 0.0, 0.8)


def test_alignment_and_pairing_files(spark, folder):
    with open(f"{folder}/al.csv", "w") as fh:
        fh.write("segment_id,start_ms,end_ms,fps,text\na,10,x,25,hi\n,1.9,20,,\"two\nlines\"\n")
    rows = tables.read_alignment(spark, f"{folder}/al.csv").orderBy("start_ms").collect()
    assert [(r["segment_id"], r["start_ms"], r["end_ms"], r["reviewed_end_ms"], r["status"], r["fps"]) for r in rows] == [
        ("", 1, 20, 20, "pending", None), ("a", 10, 0, 0, "pending", 25.0)]
    assert tables.read_pairings(spark, f"{folder}/none.csv").count() == 0


def test_inventory_is_read_or_made(spark, folder):
    made = spark.createDataFrame([("/v/a.mp4", "a.mp4", 1.5, 640, 480, 25.0, 0.1, "h264", True)], tables.S.INVENTORY)
    first = tables.load_or_create_inventory(spark, f"{folder}/inv", lambda: made)
    again = tables.load_or_create_inventory(spark, f"{folder}/inv", lambda: 1 / 0)
    assert [tuple(r) for r in first.collect()] == [tuple(r) for r in again.collect()] == [tuple(made.first())]


def test_scan_and_sinks(spark, folder):
    df = spark.range(4).withColumn("split", F.element_at(F.array(F.lit("train"), F.lit("val")), (F.col("id") % 2 + 1).cast("int")))
    sinks.write_splits(df, f"{folder}/splits")
    assert {r["split"]: r["count"] for r in spark.read.option("header", True).csv(f"{folder}/splits").groupBy("split").count().collect()} == {"train": 2, "val": 2}
    for name, size in (("a.MP4", 2_000_000), ("b.txt", 10)):
        with open(f"{folder}/{name}", "wb") as fh:
            fh.write(b"0" * size)
    assert [(r["stem"], r["file_size_mb"]) for r in tables.scan_files(spark, folder).collect()] == [("a", 1.91)]
    index = SE.build_index(spark.createDataFrame([(1, "x", [3.0, 4.0]), (2, " ", [1.0, 0.0])], "id bigint, label string, vector array<double>"))
    sinks.save_index(index, f"{folder}/index")
    assert [list(r["vector"]) for r in sinks.load_index(spark, f"{folder}/index").collect()] == [[0.6, 0.8]]
    tiers = "stem string, tier string, value string"
    sinks.overwrite_stems(spark.createDataFrame([("a", "t", "1"), ("b", "t", "1")], tiers), f"{folder}/tiers")
    sinks.overwrite_stems(spark.createDataFrame([("a", "t", "2")], tiers), f"{folder}/tiers")
    assert sorted((r["stem"], r["value"]) for r in spark.read.parquet(f"{folder}/tiers").collect()) == [("a", "2"), ("b", "1")]


def test_split_sizes_and_partitions(spark):
    rows = [(f"{label}{i}", label) for label, n in (("a", 1), ("b", 2), ("c", 3), ("d", 10)) for i in range(n)]
    df = spark.createDataFrame(rows, "id string, label string")
    one = {r["id"]: r["split"] for r in LS.split_per_label(df.repartition(1), "id").collect()}
    many = {r["id"]: r["split"] for r in LS.split_per_label(df.repartition(8), "id").collect()}
    assert one == many and len(one) == 16
    sizes = {l: tuple(sum(1 for k, s in one.items() if k[0] == l and s == p) for p in ("train", "val", "test")) for l in "abcd"}
    assert sizes == {"a": (1, 0, 0), "b": (1, 0, 1), "c": (2, 0, 1), "d": (8, 1, 1)}
    with pytest.raises(ValueError):
        LS.split_per_label(df, "id", 0.8, 0.1, 0.2)


def test_stratified_split_rules(spark):
    big = spark.createDataFrame([(i, "abcd"[i % 4]) for i in range(200)], "id int, label string")
    parts = LS.split_stratified(big, "id").groupBy("split", "label").count().collect()
    assert {(r["split"], r["count"]) for r in parts if r["split"] == "train"} == {("train", 35)}
    assert sum(r["count"] for r in parts if r["split"] == "val") == 30
    assert all(r["count"] in (7, 8) for r in parts if r["split"] != "train")
    rare = big.unionByName(spark.createDataFrame([(999, "z")], "id int, label string"))
    assert LS.split_stratified(rare, "id").count() == 201
    wide = spark.createDataFrame([(i, f"l{i}") for i in range(20)], "id int, label string")
    assert {r["split"]: r["count"] for r in LS.split_stratified(wide, "id").groupBy("split").count().collect()} == {"train": 14, "val": 3, "test": 3}


def test_metrics_edges(spark):
    scored = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "a")], "truth string, predicted string")
    classes = spark.createDataFrame([("a",), ("b",), ("c",)], "label string")
    got = {r["label"]: (r["precision"], r["recall"], r["f1"], r["support"]) for r in ME.per_class(scored, classes).collect()}
    assert got == {"a": (0.5, 0.5, 0.5, 2), "b": (0.0, 0.0, 0.0, 1), "c": (0.0, 0.0, 0.0, 0)}
    assert ME.confusion_grid(scored, classes).count() == 9
    with pytest.raises(ValueError):
        ME.confusion_grid(scored, classes, 2)


def test_search_blocks_and_shuffle_path(spark, monkeypatch):
    rng = np.random.default_rng(1)
    vecs = rng.normal(size=(60, 5))
    rows = [(i, f"l{i % 7}", [float(x) for x in v]) for i, v in enumerate(vecs)]
    index = SE.build_index(spark.createDataFrame(rows, "id bigint, label string, vector array<double>"))
    queries = spark.createDataFrame([(i, r[2]) for i, r in enumerate(rows[:9])], "query_id bigint, query array<double>")
    unit = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    for blocks, limit in ((256, 1 << 26), (2, 1 << 26), (2, 0)):
        monkeypatch.setattr(SE, "BLOCK_ROWS", blocks)
        monkeypatch.setattr(SE, "SEND_BYTES", limit)
        got = {(r["query_id"], r["rank"]): (r["label"], r["similarity"]) for r in SE.find_similar(index, queries, 3).collect()}
        for q in range(9):
            sims = unit @ unit[q]
            best = sorted(((max(sims[i] for i in range(60) if i % 7 == k), f"l{k}") for k in range(7)), reverse=True)[:3]
            assert [got[(q, n + 1)][0] for n in range(3)] == [b[1] for b in best]
            assert [got[(q, n + 1)][1] for n in range(3)] == pytest.approx([b[0] for b in best], abs=1e-4)


def test_velocity_and_normalise(spark):
    rng = np.random.default_rng(2)
    poses = {"a": rng.random((9, 4, 3)), "b": rng.random((1, 4, 3)), "c": np.ones((3, 4, 3))}
    poses["a"][2, 0, :] = np.nan
    rows = [(k, f, [tuple(float(v) for v in p) + (1.0,) for p in frame]) for k, clip in poses.items() for f, frame in enumerate(clip)]
    df = spark.createDataFrame(rows, "clip string, frame bigint, pts array<struct<x:double,y:double,z:double,c:double>>")
    vel = {(r["clip"], r["frame"]): r["features"] for r in L.velocity(df, chunk_rows=4).collect()}
    nor = {(r["clip"], r["frame"]): r["pts"] for r in L.normalise_by_nose(df).collect()}
    for k, clip in poses.items():
        d1, d2 = np.zeros_like(clip), np.zeros_like(clip)
        d1[:-1] = clip[1:] - clip[:-1]
        d2[:-2] = clip[2:] - clip[:-2] if len(clip) > 2 else 0
        want = np.concatenate([clip, d1, d2], -1)
        shift = clip - np.nanmean(clip[:, 0:1, :], axis=0, keepdims=True)
        std = np.nanstd(shift)
        shift = shift / std if std > 1e-6 else shift
        for f in range(len(clip)):
            np.testing.assert_allclose(np.array(vel[(k, f)], dtype=float), want[f].reshape(-1), atol=1e-12)
            np.testing.assert_allclose(np.array([[p["x"], p["y"], p["z"]] for p in nor[(k, f)]], dtype=float), shift[f], atol=1e-9)


def test_upsert_twice_and_undo(spark):
    rows = spark.createDataFrame([("p1", "a"), ("p2", "b")], "pairing_id string, word string")
    change = spark.createDataFrame([("p2", "B", 1), ("p3", "c", 1), ("p2", "BB", 2)], "pairing_id string, word string, n int")
    once = M.upsert(rows, change, order="n")
    assert sorted(map(tuple, once.collect())) == [("p1", "a"), ("p2", "BB"), ("p3", "c")]
    assert sorted(map(tuple, M.upsert(once, change, order="n").collect())) == sorted(map(tuple, once.collect()))
    history = spark.createDataFrame([("p1", 1, "a"), ("p2", 1, "b"), ("p2", 2, "BB")], "pairing_id string, version int, word string")
    assert [tuple(r) for r in M.undo(history).collect()] == [("p2", "b")]


def test_merge_with_next_chain(spark):
    cols = "segment_id string, stem string, start_ms bigint, end_ms bigint, frame_start bigint, frame_end bigint, n_frames bigint, text string, reviewed_text string, reviewed_end_ms bigint"
    rows = [(f"s{i}", "v", i * 100, i * 100 + 50, i, i + 1, 1, f"t{i}", "r" if i == 1 else "", i * 100 + 50) for i in range(5)]
    named = spark.createDataFrame([("s0",), ("s1",), ("s2",), ("s4",)], "segment_id string")
    got = {r["segment_id"]: r for r in merge_with_next(spark.createDataFrame(rows, cols), named).collect()}
    assert sorted(got) == ["s0", "s2", "s4"]
    assert got["s0"]["text"] == "t0\nt1" and got["s0"]["reviewed_text"] == "t0\nr" and got["s0"]["n_frames"] == 2
    assert got["s2"]["end_ms"] == 350 and got["s4"]["text"] == "t4"


VTT = "WEBVTT\n\n1\n00:00:00.000 --> 00:00:02.000\n{0}\n\n2\n00:00:02.100 --> 00:00:03.000\n{0}!\n\n3\n00:00:20.000 --> 00:00:20.400\nshort\n\n4\n00:00:20.500 --> 00:00:23.000\nnext\n"
FILES = "stem string, path string, kind string, lang string, content string"


def start_alignment(spark, folder, files, ready, inventory=("a", "b", "c", "d", "e")):
    spark.createDataFrame(files, FILES).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(FILES).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    poses = spark.createDataFrame([(s, 10, 25.0, 1000) for s in ready] + [("d", 0, 25.0, 1000)], "stem string, bytes bigint, fps double, n_frames bigint")
    stems = spark.createDataFrame([(s,) for s in inventory], "stem string")
    return ST.align_new_files(stream, stems, poses, f"{folder}/out", f"{folder}/ckpt")


def vtt_file(stem, kind="soft", lang="sk", text="a longer line of text"):
    return (stem, f"/{lang}/{kind}/{stem}.vtt", kind, lang, VTT.format(text))


def test_incremental_alignment(spark, folder):
    def found():
        return sorted((r["segment_id"], r["end_ms"], r["text"]) for r in ST.aligned(spark, f"{folder}/out").collect())

    def rows(stem, text="a longer line of text"):
        return [(f"{stem}_00000000", 3000, text + "!"), (f"{stem}_00020000", 23000, "short\nnext")]

    # b has no pose yet, d an empty one, x is not listed, e has a file without cues; the better file of a is taken.
    start_alignment(spark, folder, [vtt_file("a", "ocr", "sk", "recognised words"), vtt_file("a", "soft", "en"), vtt_file("b"), vtt_file("d"), vtt_file("x"),
                                    ("e", "/e.vtt", "soft", "sk", "WEBVTT\n")], "ae").awaitTermination()
    assert found() == rows("a")
    # Known stems are ignored; waiting files come up again with the next batch.
    start_alignment(spark, folder, [vtt_file("a", text="something else"), vtt_file("c")], "abce").awaitTermination()
    assert found() == rows("a") + rows("b") + rows("c")
    start_alignment(spark, folder, [vtt_file("e")], "abce").awaitTermination()
    assert found() == rows("a") + rows("b") + rows("c") + rows("e")
    log = sorted(tuple(r) for r in ST.committed(spark, f"{folder}/out").select("batch", "stems", "segments", "waiting").collect())
    assert log == [(0, 1, 2, 4), (1, 2, 4, 3), (2, 1, 2, 2)]


def test_a_batch_reads_the_poses_of_all_videos_once(spark, folder):
    """What is worked out for a batch hangs on the poses of its own videos only."""
    spark.createDataFrame([(s, 10, 25.0, 1000) for s in "abcde"], "stem string, bytes bigint, fps double, n_frames bigint").write.parquet(f"{folder}/every_pose")
    poses = spark.read.parquet(f"{folder}/every_pose")
    rows = ST._align_batch(spark.createDataFrame([vtt_file("a"), vtt_file("x")], FILES), poses.select("stem"), poses, spark.createDataFrame([], "stem string"))
    assert not [f for f in rows.inputFiles() if "every_pose" in f]
    assert sorted(tuple(r) for r in rows.groupBy("part", "stem").count().collect()) == [("segment", "a", 2), ("stem", "a", 1), ("waiting", "x", 1)]


@pytest.mark.parametrize("fails", ["rows", "manifest"])
def test_batch_that_failed_half_way_runs_again(spark, folder, monkeypatch, fails):
    real, state = ST._align_batch, {"left": 1}

    def broken(*args):
        out = real(*args)
        if state["left"] and fails == "rows":
            state["left"] = 0
            out.coalesce(1).write.partitionBy("part").parquet(f"{folder}/out/batches/batch=0")  # what a lost driver leaves behind
            raise RuntimeError("lost")
        if state["left"]:
            state["left"] = 0
            monkeypatch.setattr(ST, "BATCH", "part bigint")
        return out

    monkeypatch.setattr(ST, "_align_batch", broken)
    batch = ST.BATCH
    with pytest.raises(Exception):
        start_alignment(spark, folder, [vtt_file("a"), vtt_file("b")], "abc").awaitTermination()
    monkeypatch.setattr(ST, "BATCH", batch)
    assert ST.aligned(spark, f"{folder}/out").count() == 0
    start_alignment(spark, folder, [vtt_file("c")], "abc").awaitTermination()
    assert sorted(r["segment_id"] for r in ST.aligned(spark, f"{folder}/out").collect()) == [f"{s}_{t:08d}" for s in "abc" for t in (0, 20000)]


def test_incremental_signs_keep_the_first(spark, folder):
    schema = "stem bigint, sign_start_ms bigint, hand string, word string, item_no bigint"

    def feed(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(schema).parquet(f"{folder}/in")
        ST.merge_new_signs(stream, f"{folder}/out", f"{folder}/ckpt").awaitTermination()
        return sorted(tuple(r) for r in spark.read.schema(schema).parquet(f"{folder}/out").collect())

    assert feed([(1, 0, "right", "b", 5), (1, 0, "right", "a", 3), (1, 0, "left", "c", 9), (2, 0, "right", None, 1)]) == [
        (1, 0, "left", "c", 9), (1, 0, "right", "a", 3), (2, 0, "right", None, 1)]
    assert len(feed([(1, 0, "right", "later", 0), (1, 1, "right", "new", 7)])) == 4


def test_manual_pairings_of_equal_items_go_by_video(spark):
    rows = [(s, 7, "right", 1000, 1400, 25.0) for s in ("z", "m", "a")]
    requests = spark.createDataFrame(rows, "stem string, item_no bigint, hand string, start_ms bigint, end_ms bigint, fps double").coalesce(1)
    assert sorted(r["pairing_id"] for r in M.manual_pairings(requests).collect()) == [f"{s}_00001000_r_M{n + 1}" for n, s in enumerate("amz")]


@pytest.mark.parametrize("name", ["f23_sync_with_training", "k07_new_word_ids"])
def test_words_without_a_new_one_match_sql(spark, folder, name):
    import oracle
    from tierloom import plans  # noqa: F401

    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet")
    last = part.agg(F.max("p_partkey")).first()[0]
    shift = last + 1 if last % 2 == 0 else last + 2
    # Every gloss id has words of even and of odd number.
    part.unionByName(part.withColumn("p_partkey", F.col("p_partkey") + shift)).write.parquet(f"{folder}/part.parquet")
    con = oracle.duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{folder}/part.parquet/*.parquet')")
    assert oracle.compare(spark, con, name, folder)[0] == "ok"


def test_annotations_are_parsed_once(spark):
    doc = '<ANNOTATION_DOCUMENT><TIME_ORDER><TIME_SLOT TIME_SLOT_ID="s" TIME_VALUE="1"/><TIME_SLOT TIME_SLOT_ID="e" TIME_VALUE="2"/></TIME_ORDER><TIER TIER_ID="T"><ANNOTATION>' \
          '<ALIGNABLE_ANNOTATION ANNOTATION_ID="a" TIME_SLOT_REF1="s" TIME_SLOT_REF2="e"><ANNOTATION_VALUE>w</ANNOTATION_VALUE></ALIGNABLE_ANNOTATION></ANNOTATION></TIER></ANNOTATION_DOCUMENT>'
    rows = AN.annotations_of_text(spark.createDataFrame([("a", doc), ("b", doc[:-9])], "stem string, content string"), "content", ["T"])
    assert [tuple(r) for r in rows.collect()] == [("a", "T", 1, 2, "w")]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("from_xml") == 1


def test_sources_of_stems_without_suffix_are_spread(spark):
    from tierloom.functions import labels as LB

    stems = spark.createDataFrame([("v1",), ("v1_60",), ("v2_90",), ("v2_60_60",), ("20150203_x",), ("zz",), ("v3_60",), (None,)], "stem string")
    videos = spark.createDataFrame([("v1", "one"), ("v2", "two"), ("v3_60", "three"), ("v3", "other")], "stem string, source string")
    got = LB.source_of(stems, videos)
    assert {r["stem"]: r["source"] for r in got.collect()} == {
        "v1": "one", "v1_60": "one", "v2_90": "two", "v2_60_60": None, "20150203_x": "corpus", "zz": None, "v3_60": "three", None: None}
    joins = got._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN RLIKE(stem" not in joins


def test_cut_units_are_joined_as_one_row(spark):
    units = spark.createDataFrame([(1, "v", 0, 3000, 0, 3000, [2000, 0, 500], [("right", 0, 2900), ("left", 20, 2920)], 25.0, ""), (2, "v", 0, 10, 0, 10, [], [("right", 0, 10)], 25.0, "")],
                                  "unit_id bigint, stem string, start_ms bigint, end_ms bigint, unit_start_ms bigint, unit_end_ms bigint, cuts array<bigint>, "
                                  "preds array<struct<hand:string,start_ms:bigint,end_ms:bigint>>, fps double, compound string")
    resolved = spark.createDataFrame([(u, p, f"w{p}", "G") for u in (1, 2) for p in (-1, 0, 1, 2, 3)], "unit_id bigint, piece int, word string, gloss_id string")
    got = M.cut_interval(units, resolved)
    assert sorted((r["piece"], r["hand"], r["sign_start_ms"], r["sign_end_ms"], r["word"]) for r in got.collect()) == [
        (n, h, a, b, f"w{n}") for n, (a, b) in enumerate([(0, 500), (500, 2000), (2000, 3000)]) for h in ("left", "right")]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate posexplode") < plan.index("Join")


def test_incremental_signs_of_many_keys(spark, folder):
    schema = "stem bigint, sign_start_ms bigint, hand string, word string, item_no bigint"
    began = time.time()
    for wave, keys in enumerate((20_000, 30_000)):
        rows = spark.range(keys * 2).selectExpr("id div 2 AS stem", "0L AS sign_start_ms", "CAST(NULL AS STRING) AS hand", f"'w{wave}' AS word", "id AS item_no")
        rows.write.mode("append").parquet(f"{folder}/in")
        ST.merge_new_signs(spark.readStream.schema(schema).parquet(f"{folder}/in"), f"{folder}/out", f"{folder}/ckpt").awaitTermination()
    got = spark.read.schema(schema).parquet(f"{folder}/out")
    assert got.filter("item_no = stem * 2").groupBy("word").count().orderBy("word").collect() == [("w0", 20_000), ("w1", 10_000)]
    assert got.count() == 30_000
    assert time.time() - began < 40


def test_bulk_import(spark):
    from tierloom.operators import collector as K

    words = spark.createDataFrame([(7, "OLD", "old", 1, 40)], "word_id bigint, gloss_id string, word string, theme_id bigint, target bigint")
    themes = spark.createDataFrame([(1, "animals", "", 4)], "theme_id bigint, name string, emoji string, sort_order bigint")
    lines = ["one column", '"quoted, comma"', " ,x", "A,", "OLD,again", "A,first,http://p", 'B,"two, three",,http://d', "A,second", *[f"OLD,{i}" for i in range(6)], "C , c "]
    table = spark.createDataFrame(list(enumerate(lines)), "line_no int, line string")
    for name, theme, count in (("plants", 2, 2), ("animals", 1, 1)):
        got = K.bulk_import(table, words, themes, name)
        assert got.themes.count() == count
        new = [tuple(r) for r in got.words.orderBy("word_id").collect()]
        assert new == [(7, "OLD", "old", 1, 40, None, None), (8, "A", "first", theme, 50, "http://p", None), (9, "B", "two, three", theme, 50, None, "http://d"),
                       (10, "C", "c", theme, 50, None, None)]
        assert tuple(got.totals.first()) == (3, 10, theme, ["OLD: already there", "A: already there", *["OLD: already there"] * 3])
        assert got.rejected.count() == 10
    empty = K.bulk_import(table.limit(0), words, themes, theme_id=9)
    assert tuple(empty.totals.first()) == (0, 0, 9, []) and empty.words.count() == 1


def test_similarity_search_with_text_ids(spark):
    from tierloom.operators.search import find_similar

    index = spark.createDataFrame([("s_2", "a", [1.0, 0.0]), ("s_1", "a", [1.0, 0.0]), ("s_3", "b", [0.0, 1.0])], "id string, label string, vector array<double>")
    queries = spark.createDataFrame([(1, [2.0, 0.0])], "query_id long, query array<double>")
    assert [tuple(r) for r in find_similar(index, queries).orderBy("rank").collect()] == [(1, 1, "a", "s_1", 1.0), (1, 2, "b", "s_3", 0.0)]


def test_beta_quantiles():
    from tierloom.operators import augment as A

    table = np.array(A.beta_quantiles())
    assert len(table) == A.BETA_STEPS + 1 and table[0] == 0 and table[-1] == 1 and (np.diff(table) >= 0).all()
    at = np.linspace(0.001, 0.999, 501)
    drawn = np.random.default_rng(1).beta(A.BETA, A.BETA, 8_000_000)
    assert np.abs(np.interp(at * A.BETA_STEPS, np.arange(A.BETA_STEPS + 1), table) - np.quantile(drawn, at)).max() < 2e-3
    # Against a table of eight times as many entries: what interpolation costs.
    fine = np.array(A.beta_quantiles(steps=8 * A.BETA_STEPS))
    assert np.abs(np.interp(np.arange(len(fine)) / 8, np.arange(len(table)), table) - fine).max() < 1e-3


def test_similarity_search_both_ways(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(f"s{i:03d}", f"L{i % 5}", [float(x) for x in rng.normal(size=6)]) for i in range(120)]
    rows += [("s000b", "L0", rows[0][2]), ("r000", "L0", rows[0][2])]  # equal vectors: the smallest id wins
    index = SE.build_index(spark.createDataFrame(rows, "id string, label string, vector array<double>")).repartition(3)
    queries = spark.createDataFrame([(f"q{i}", rows[i][2]) for i in range(7)], "query_id string, query array<double>")
    one = sorted(map(tuple, SE.find_similar(index, queries).collect()))
    monkeypatch.setattr(SE, "SEND_BYTES", 0)
    assert sorted(map(tuple, SE.find_similar(index, queries).collect())) == one
    assert next(r for r in one if r[0] == "q0" and r[1] == 1)[2:] == ("L0", "r000", 1.0)
    unit = {r[0]: np.array(r[2]) / np.linalg.norm(r[2]) for r in rows}
    for name, query in ((f"q{i}", unit[rows[i][0]]) for i in range(7)):
        best = {}
        for key, label, _ in rows:
            s = round(float(unit[key] @ query), 10)
            best[label] = min(best.get(label, (9, "")), (-s, key))
        want = sorted((v[0], label, v[1]) for label, v in best.items())[:5]
        assert [(r[2], r[3]) for r in one if r[0] == name] == [(label, key) for _, label, key in want]


def test_search_without_queries(spark):
    index = SE.build_index(spark.createDataFrame([("a", "L", [1.0, 0.0])], "id string, label string, vector array<double>"))
    assert SE.find_similar(index, spark.createDataFrame([], "query_id string, query array<double>")).count() == 0


def test_axes_point_one_way(spark):
    rng = np.random.default_rng(5)
    data = rng.normal(size=(60, 4)) * [3, 2, 1, 0.5]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], "id long, vector array<double>")
    got = np.array([[r["x"], r["y"]] for r in SE.pca_2d(df).orderBy("id").collect()])
    centred = data - data.mean(0)
    _, _, axes = np.linalg.svd(centred, full_matrices=False)
    axes = axes[:2] * np.sign(axes[np.arange(2), np.abs(axes[:2]).argmax(1)])[:, None]
    assert np.allclose(got, centred @ axes.T, atol=1e-8)


def test_split_is_one_order_per_label(spark):
    rows = [(i, f"L{i % 4}") for i in range(203)]
    df = spark.createDataFrame(rows, "id long, label string")
    got = {r["id"]: r["split"] for r in LS.split_stratified(df, "id").collect()}
    import hashlib

    def exact(n, share, total):
        base = [x * share // total for x in n]
        rest = sorted(range(len(n)), key=lambda k: (-(n[k] * share / total - base[k]), k))
        return [b + (k in rest[:share - sum(base)]) for k, b in enumerate(base)]

    sizes = [sum(r[1] == f"L{k}" for r in rows) for k in range(4)]
    held = exact(sizes, 61, 203)
    test = exact(held, 31, 61)
    for k in range(4):
        order = sorted((r[0] for r in rows if r[1] == f"L{k}"), key=lambda i: hashlib.md5(f"42|{i}".encode()).hexdigest())
        n = sizes[k]
        assert [got[i] for i in order] == ["train"] * (n - held[k]) + ["val"] * (held[k] - test[k]) + ["test"] * test[k]
