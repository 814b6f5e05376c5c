"""Files as the programs before and after write and read them, and identity of write and read."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from boxframe.functions import text as X
from boxframe.operators import status
from boxframe.operators import tracks as K
from boxframe.sources import containers, named_files, readers, writers


def put(folder, name, text):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text if isinstance(text, bytes) else text.encode())
    return path


def test_indented_action_logs(spark, tmp_path):
    log = {"frames_0_to_29": {"action": "hold"}, "frames_15_to_44": ["a", "b"], "frames_30_to_59": "x"}
    put(tmp_path, "v_scene1_person_1000_actions.json", json.dumps(log, indent=4, ensure_ascii=False))
    put(tmp_path, "w_person_7_actions.json", json.dumps({}, indent=4))
    rows = readers.read_actions(spark, str(tmp_path)).orderBy("start_f").collect()
    assert [(r.clip_id, r.track_id, r.start_f, r.end_f, r.actions) for r in rows] == [("v_scene1", 1000, 0, 29, ["hold"]), ("v_scene1", 1000, 15, 44, ["a", "b"]), ("v_scene1", 1000, 30, 59, ["x"])]


def test_aligned_lines_of_sequences(spark, tmp_path):
    for seq in ("robot-1", "robot-2"):
        put(tmp_path, f"{seq}/groundtruth.txt", "1,2,3,4\n10,20,5,5\n0,0,0,7\n7 8 9 10\n5 6\n" if seq == "robot-1" else "1,1,1,1")
        put(tmp_path, f"{seq}/full_occlusion.txt", "0,1,0,1,0" if seq == "robot-1" else "1")
        put(tmp_path, f"{seq}/out_of_view.txt", "0 0\n1 0 1\n" if seq == "robot-1" else "0\n")
    at = lambda name: f"{tmp_path}/*/{name}.txt"
    boxes = {(r.seq, r.idx): r.x2 for r in readers.read_boxes(spark, at("groundtruth")).collect()}
    assert boxes == {("robot-1", 0): 4.0, ("robot-1", 1): 15.0, ("robot-1", 2): None, ("robot-1", 3): 16.0, ("robot-1", 4): None, ("robot-2", 0): 2.0}
    flags = sorted((r.seq, r.idx, r.flag) for r in readers.read_flags(spark, at("full_occlusion")).collect())
    assert flags == [("robot-1", 0, 0), ("robot-1", 1, 1), ("robot-1", 2, 0), ("robot-1", 3, 1), ("robot-1", 4, 0), ("robot-2", 0, 1)]
    rows = sorted((r.seq, r.idx, r.x1, r.occ, r.oov) for r in readers.read_sequence(spark, at("groundtruth"), at("full_occlusion"), at("out_of_view")).collect())
    assert rows == [("robot-1", 0, 1.0, 0, 0), ("robot-1", 1, 10.0, 1, 0), ("robot-1", 2, None, 0, 1), ("robot-1", 3, 7.0, 1, 0), ("robot-1", 4, None, 0, 1), ("robot-2", 0, 1.0, 1, 0)]


def test_listings_and_frame_order(spark, tmp_path):
    for name in ("a/x.mp4", "a/b/y.avi", "z.mov", "a/t.txt"):
        put(tmp_path, name, "1")
    assert [r.name for r in readers.list_files(spark, str(tmp_path)).orderBy("path").collect()] == ["y", "x", "z"]
    assert [r.name for r in readers.list_files(spark, str(tmp_path), recursive=False).collect()] == ["z"]
    for i in (12, 2, 1, 100):
        put(tmp_path, f"f/v1/{i:010d}.jpg", "1")
    got = sorted((r.frame_idx, r.path[-7:-4]) for r in readers.frames(spark, str(tmp_path / "f")).collect())
    assert got == [(0, "001"), (1, "002"), (2, "012"), (3, "100")]


def test_natural_order(spark):
    names = ["s2", "s10", "s1_part2", "s1_part10", "s1", "0000000012.jpg", "0000000002.jpg", "123456789012345.jpg", "99999999999.jpg", "000.jpg", "s01x"]
    import re

    want = sorted(names, key=lambda n: [(0, int(c)) if c.isdigit() else (1, c) for c in re.split(r"(\d+)", n)])
    rows = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r.n for r in rows.orderBy(X.natural_key(F.col("n"))).collect()]
    assert [n for n in got if n[0] != "s"] == [n for n in want if n[0] != "s"] and got.index("s2") < got.index("s10")
    assert got.index("s1_part2") < got.index("s1_part10") and len({r[0] for r in rows.select(X.natural_key(F.col("n"))).collect()}) == len(names)


def test_truth_documents(spark, tmp_path):
    box = {"xmin": 1.0, "ymin": 2.0, "xmax": 3.0, "ymax": 4.0}
    doc = {
        "video_id": "v", "subject/objects": [{"tid": 0, "category": "adult"}, {"tid": 1, "category": "dog"}],
        "trajectories": [[{"tid": 0, "bbox": box}, {"tid": 1, "bbox": box}], [], [{"tid": 0, "bbox": box}]],
        "relation_instances": [{"subject_tid": t, "predicate": p, "begin_fid": 0, "end_fid": 5} for t, p in ((0, "hold"), (1, "hold"), (0, "fly"))],
    }
    put(tmp_path, "a.json", json.dumps(doc, indent=2))
    put(tmp_path, "b.json", json.dumps({"width": 3}))
    docs = readers.read_truth(spark, str(tmp_path))
    assert [(r.video_id, r.width, r.height, r.fps) for r in docs.collect()] == [("v", 1, 1, 30.0)]
    assert sorted((r.tid, r.frame_idx, r.x2) for r in readers.truth_boxes(docs).collect()) == [(0, 0, 3.0), (0, 2, 3.0)]
    assert [(r.subject_tid, r.predicate) for r in readers.truth_relations(docs, ["hold"]).collect()] == [(0, "hold")]


def test_track_documents_round_trip(spark, tmp_path):
    rows = [("v_scene1", 1000, "person", f, 0.0, 0.0, 96.0 + f, 54.0) for f in (0, 2)] + [("w", 1001, "electric_fan", 1, 0.0, 0.0, 192.0, 108.0)]
    t = spark.createDataFrame(rows, "video_id string, track_id long, class_name string, frame_idx long, x1 double, y1 double, x2 double, y2 double")
    docs = K.nest(t, 1920, 1080)
    for _ in range(2):
        writers.write_tracks(docs, str(tmp_path / "docs"))
    assert sorted(p.relative_to(tmp_path / "docs").as_posix() for p in (tmp_path / "docs").rglob("*") if p.is_file()) == ["v_scene1/v_scene1.json", "w/w.json"]
    back = readers.read_tracks(spark, str(tmp_path / "docs"))
    want = sorted((r.video_id, r.key, r.frame_idx, r.x2) for r in K.unnest(docs).collect())
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(((r.clip_id, r.key, r.frame_idx, r.x2) for r in back.collect()), key=key) == sorted(want, key=key)


def test_action_logs_round_trip(spark, tmp_path):
    rows = [("c", 7, 0, 29, ["hold", "push é"]), ("c", 7, 15, 44, ["x"]), ("d", 7, 0, 29, [])]
    windows = spark.createDataFrame(rows, "clip_id string, track_id long, start_f int, end_f int, actions array<string>")
    people = spark.createDataFrame([("c", 7), ("c", 8), ("d", 7)], "clip_id string, track_id long")
    writers.write_actions(windows.unionAll(windows.limit(0)), str(tmp_path / "a"), people)
    writers.write_actions(windows, str(tmp_path / "a"), people)
    assert sorted(p.name for p in (tmp_path / "a").iterdir()) == ["c_person_7_actions.json", "c_person_8_actions.json", "d_person_7_actions.json"]
    assert json.loads((tmp_path / "a" / "c_person_8_actions.json").read_text()) == {}
    back = sorted((r.clip_id, r.track_id, r.start_f, r.end_f, r.actions) for r in readers.read_actions(spark, str(tmp_path / "a")).collect())
    assert back == sorted(rows)


def test_label_rows_and_maps_as_files(spark, tmp_path):
    rows = spark.createDataFrame([("v", "0.5000", "0.1000", 1, 1000)], "video_id string, timestamp string, x1 string, action_id int, person_id long")
    writers.write_label_rows(rows, str(tmp_path / "csv"))
    text = "".join(p.read_text() for p in (tmp_path / "csv").glob("part-*"))
    assert text == "v,0.5000,0.1000,1,1000\n"
    writers.write_label_map(spark.createDataFrame([("b", 2), ("a", 1)], "name string, label_id int"), str(tmp_path / "map"))
    text = "".join(p.read_text() for p in (tmp_path / "map").glob("part-*"))
    assert text.index('"a"') < text.index('"b"') and text.count("label_type: 2") == 2


def test_markers_written_twice_stay_one(spark, tmp_path):
    clips = status.skip_reasons(spark.createDataFrame([("a_scene1", 301, 0.5), ("b", 1, 0.5), ("a_camera", 2, 0.5)], "clip string, n_frames int, motion double"))
    for _ in range(2):
        writers.write_markers(status.markers(clips, "clip"), str(tmp_path / "m"))
    back = readers.read_markers(spark, str(tmp_path / "m"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, status.markers(clips, "clip").collect())) and back.count() == 2


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    folder = tmp_path / "out"
    good = spark.createDataFrame([("a.txt", "old"), ("b/c.txt", "old")], "name string, value string")
    named_files.write_named(good, str(folder))
    bad = spark.range(8).select(F.concat("id", F.lit(".txt")).alias("name"), F.when(F.col("id") == 7, F.raise_error(F.lit("broken"))).otherwise("x").cast("string").alias("value")).repartition(4)
    with pytest.raises(Exception, match="broken"):
        named_files.write_named(bad, str(folder))
    assert sorted(p.relative_to(folder).as_posix() for p in folder.rglob("*")) == ["a.txt", "b", "b/c.txt"]
    for names in ([("../x", "1")], [("d.txt", "1"), ("d.txt", "2")]):
        with pytest.raises(Exception, match="not a name|two rows"):
            named_files.write_named(spark.createDataFrame(names, "name string, value string"), str(folder))
    named_files.write_named(spark.createDataFrame([("a.txt", "new"), ("n.bin", None)], "name string, value string"), str(folder), "overwrite")
    assert {p.relative_to(folder).as_posix(): p.read_text() for p in folder.rglob("*") if p.is_file()} == {"a.txt": "new", "n.bin": ""}


def riff(kind, body):
    return kind + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def avi(n, step, rate, width, height, stream=b"vids"):
    main = struct.pack("<10I", 0, 0, 0, 0, n, 0, 1, 0, width, height) + bytes(16)
    head = stream + bytes(16) + struct.pack("<IIII", step, rate, 0, n) + bytes(20)
    lists = riff(b"LIST", b"hdrl" + riff(b"avih", main) + riff(b"LIST", b"strl" + riff(b"strh", head)))
    return riff(b"RIFF", b"AVI " + lists + riff(b"LIST", b"movi" + bytes(10)))


def test_headers_of_clips(spark, tmp_path):
    film = containers.small_movie(2.5, 75, 1000, 30_000, 1920, 1080)
    put(tmp_path, "a/one.mp4", film)
    put(tmp_path, "a/late.mov", film[:40] + containers.box_bytes(b"mdat", bytes(100_000)) + film[40:])  # the movie box is the last
    wide = lambda kind, *parts: struct.pack(">I4sQ", 1, kind, 16 + sum(map(len, parts))) + b"".join(parts) if kind == b"moov" else containers.box_bytes(kind, *parts)
    put(tmp_path, "wide.mp4", containers.small_movie(1.0, 30, 1001, 30_000, 64, 48, write=wide))
    put(tmp_path, "sound.mp4", containers.small_movie(3.0, 10, 1, 1, 0, 0, video=False))
    put(tmp_path, "film.avi", avi(50, 1, 25, 320, 240))
    put(tmp_path, "cut.mp4", film[:-30])
    put(tmp_path, "empty.mp4", b"")
    put(tmp_path, "text.avi", "RIFF" * 10)
    put(tmp_path, "notes.txt", "no clip")
    got = {r.name: (round(r.duration, 3), r.fps and round(r.fps, 3), r.width, r.height, r.n_frames, r.has_video) for r in readers.read_clips(spark, str(tmp_path)).collect()}
    assert got == {
        "one": (2.5, 30.0, 1920, 1080, 75, True), "late": (2.5, 30.0, 1920, 1080, 75, True), "wide": (1.0, 29.97, 64, 48, 30, True), "sound": (3.0, None, None, None, None, False),
        "film": (2.0, 25.0, 320, 240, 50, True), "cut": (0.0, None, None, None, None, False), "empty": (0.0, None, None, None, None, False), "text": (0.0, None, None, None, None, False),
    }
    parts = spark.read.format("clip_headers").option("filesPerTask", 3).load(str(tmp_path))
    assert parts.rdd.getNumPartitions() == 3 and parts.count() == 8


def test_sizes_of_frames(spark, tmp_path):
    start = b"\xff\xc2" + struct.pack(">HBHHB", 11, 8, 480, 640, 1) + bytes(3)
    put(tmp_path, "v/0000000001.jpg", b"\xff\xd8\xff\xe0" + struct.pack(">H", 16) + bytes(14) + start + bytes(50))
    put(tmp_path, "v/0000000002.png", b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 20, 10) + bytes(9))
    put(tmp_path, "v/0000000003.jpg", b"\xff\xd8\xff")
    got = {r.name: (r.width, r.height) for r in readers.frame_sizes(spark, str(tmp_path)).collect()}
    assert got == {"0000000001": (640, 480), "0000000002": (20, 10), "0000000003": (None, None)}
