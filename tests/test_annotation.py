"""Expressions and operators against plain Python, and registered queries against DuckDB."""

import itertools
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from boxframe.functions import geometry as G
from boxframe.functions import text as X
from boxframe.operators import assign, dedupe, evaluate, kalman, status
from boxframe.operators import tracks as K
from boxframe.plans.queries import ORACLE_SQL, QUERIES
from boxframe.plans.views import tracks

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def py_iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    inter = max(w, 0) * max(h, 0)
    area = lambda x: (x[2] - x[0]) * (x[3] - x[1])
    return inter / (area(a) + area(b) - inter)


def boxes(n, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        x, y = rng.randint(0, 80), rng.randint(0, 80)
        out.append((i % 3, i, "ab"[i % 2], rng.randint(1, 9) / 10, float(x), float(y), float(x + rng.randint(10, 60)), float(y + rng.randint(10, 60))))
    return out


DET = "video_id int, det_id long, class_name string, confidence double, x1 double, y1 double, x2 double, y2 double"


def test_iou_is_symmetric_and_bounded(spark):
    rows = boxes(30)
    d = spark.createDataFrame([(a[4:], b[4:]) for a, b in itertools.product(rows, rows)], "a struct<x1:double,y1:double,x2:double,y2:double>, b struct<x1:double,y1:double,x2:double,y2:double>")
    a, b = (G.Box(*[F.col(f"{p}.{n}") for n in K.BOX]) for p in "ab")
    got = d.select(G.iou(a, b).alias("i"), G.iou(b, a).alias("j"), "a", "b").collect()
    for r in got:
        assert r.i == r.j and 0 <= r.i <= 1 and abs(r.i - py_iou(tuple(r.a), tuple(r.b))) < 1e-12


def test_degenerate_boxes(spark):
    d = spark.createDataFrame([(5.0, 5.0, 5.0, 9.0)], "x1 double, y1 double, x2 double, y2 double")
    assert d.select(G.iou(G.box(), G.box())).first()[0] == 0
    assert d.select(G.iou(G.box(), G.box(), "eval")).first()[0] is None
    with pytest.raises(Exception, match="degenerate"):
        d.select(G.iou(G.box(), G.box(), "strict")).collect()


def test_dedupe_equals_a_loop_and_is_idempotent(spark):
    rows = boxes(60)
    got = dedupe.dedupe_by_confidence(spark.createDataFrame(rows, DET), 0.3, 0.3, 20.0, ["video_id"])
    kept = set()
    for video in range(3):
        held = []
        for r in sorted((r for r in rows if r[0] == video and r[3] >= 0.3), key=lambda r: (-r[3], r[1])):
            centre = lambda x: ((x[4] + x[6]) / 2, (x[5] + x[7]) / 2)
            near = lambda k: k[2] == r[2] and np.hypot(*np.subtract(centre(k), centre(r))) < 20  # noqa: B023, E731
            if not any(py_iou(k[4:], r[4:]) > 0.3 or near(k) for k in held):
                held.append(r)
        kept |= {r[1] for r in held}
    assert {r.det_id for r in got.collect()} == kept
    assert {r.det_id for r in dedupe.dedupe_by_confidence(got, 0.3, 0.3, 20.0, ["video_id"]).collect()} == kept


def test_boxes_of_other_frames_do_not_compete(spark):
    rows = [("v", f, 0, "a", 0.9, 0.0, 0.0, 10.0, 10.0) for f in (0, 30)] + [("v", 30, 1, "a", 0.8, 0.0, 0.0, 10.0, 9.0)]
    d = spark.createDataFrame(rows, "video_id string, frame_idx int, det_id long, class_name string, confidence double, x1 double, y1 double, x2 double, y2 double")
    assert sorted((r.frame_idx, r.det_id) for r in dedupe.nms(d).collect()) == [(0, 0), (30, 0)]


def test_kalman_equals_matrices(spark):
    rng = np.random.default_rng(3)
    z = [None if i % 7 == 3 else rng.random(4) * 50 + 20 * np.array([0, 0, 1, 1]) for i in range(25)]
    rows = [(1, i, *(map(float, b) if b is not None else (None,) * 4)) for i, b in enumerate(z)]
    got = {r.frame_idx: r for r in kalman.smooth_tracks(spark.createDataFrame(rows, "track_id int, frame_idx long, x1 double, y1 double, x2 double, y2 double"), ["track_id"]).collect()}
    f, h = np.eye(8), np.kron(np.eye(4), [[1, 0]])
    for i in range(4):
        f[2 * i, 2 * i + 1] = 1
    x, p = np.zeros(8), np.eye(8) * 1000
    for i, b in enumerate(z):
        x, p = f @ x, f @ p @ f.T + np.eye(8)
        if b is None:
            assert got[i].x1 is None
            continue
        m = np.array([(b[0] + b[2]) / 2, (b[1] + b[3]) / 2, b[2] - b[0], b[3] - b[1]])
        k = p @ h.T @ np.linalg.inv(h @ p @ h.T + 10 * np.eye(4))
        x, p = x + k @ (m - h @ x), (np.eye(8) - k @ h) @ p
        cx, cy, w, hh = h @ x
        assert np.allclose([got[i].x1, got[i].y1, got[i].x2, got[i].y2], [cx - w / 2, cy - hh / 2, cx + w / 2, cy + hh / 2], atol=1e-8)


def test_assignment_is_optimal():
    rng = np.random.default_rng(5)
    for n, m in [(1, 1), (3, 3), (4, 6), (5, 3), (6, 6)] * 4:
        cost = rng.random((n, m)).round(2)
        got = assign.min_cost_assignment(cost)
        small, large = min(n, m), max(n, m)
        wide = cost if n <= m else cost.T
        best = min(sum(wide[i, p[i]] for i in range(small)) for p in itertools.permutations(range(large), small))
        assert len(got) == small and abs(sum(cost[r, c] for r, c in got) - best) < 1e-9


CHUNKS = "clip string, chunk long, det_id long, class_name string, x1 double, y1 double, x2 double, y2 double"


def stitched(spark, rows):
    got = assign.stitch(spark.createDataFrame(rows, CHUNKS), "clip").collect()
    return {(r.clip, r.chunk, r.det_id): (r.track_id, r.class_name) for r in got}


def test_stitched_tracks_stay_active(spark):
    a, b = (0.0, 0.0, 10.0, 10.0), (50.0, 50.0, 60.0, 60.0)
    got = stitched(spark, [("v", 0, 0, "x", *a), ("v", 0, 1, "y", *b), ("v", 1, 0, "x", *a), ("v", 2, 0, "z", *a), ("v", 2, 1, "y", *b)])
    assert [got["v", 2, i] for i in (0, 1)] == [(1000, "z"), (1001, "y")] and got["v", 0, 0] == (1000, "z")
    gap = stitched(spark, [("v", 0, 0, "x", *a), ("v", 2, 0, "x", *a), ("v", 3, 0, "x", *a), ("v", 3, 1, "x", *a)])
    assert gap["v", 2, 0][0] == 1001 and {gap["v", 3, i][0] for i in (0, 1)} == {1000, 1001}
    lost = assign.stitch(spark.createDataFrame([("v", c, 0, "x", *a) for c in (0, 1)], CHUNKS), "clip", propagate=lambda clip, chunk, ids, boxes: boxes * np.nan)
    assert sorted(r.track_id for r in lost.collect()) == [1000, 1001]


def test_stitching_equals_brute_force(spark):
    """Against every assignment, on random boxes over chunks with gaps."""
    rng = np.random.default_rng(8)
    rows = []
    for clip in "abcd":
        for chunk in rng.permutation(6)[:5]:
            for i in range(rng.integers(1, 4)):
                x, y = (float(v) for v in rng.random(2).round(3) * 30)
                rows.append((clip, int(chunk), i, "c", x, y, x + 20 + float(rng.random()), y + 20 + float(rng.random())))
    got = stitched(spark, rows)
    for clip in "abcd":
        state, last, ids = {}, None, {}
        for chunk in sorted({r[1] for r in rows if r[0] == clip}):
            now = [r for r in rows if r[:2] == (clip, chunk)]
            pairs = []
            if last == chunk - 1:
                old, n = sorted(state), min(len(state), len(now))
                choices = (list(zip(o, d)) for o in itertools.combinations(old, n) for d in itertools.permutations(range(len(now)), n))
                cost = lambda p: sum(1 - py_iou(state[o], now[d][4:]) for o, d in p)  # noqa: B023, E731
                pairs = [(o, d) for o, d in min(choices, key=cost) if 1 - py_iou(state[o], now[d][4:]) <= 0.85]
            taken = {d: o for o, d in pairs}
            for d, r in enumerate(now):
                if d not in taken:
                    taken[d] = 1000 + len(state)
                    state[taken[d]] = None
                state[taken[d]] = r[4:]
                ids[clip, chunk, r[2]] = taken[d]
            last = chunk
        assert ids == {k: v[0] for k, v in got.items() if k[0] == clip}


def test_assigned_boxes_equal_brute_force(spark):
    got = {}
    for r in QUERIES["assign_hungarian"](spark, SF).collect():
        got.setdefault((r.video_id, r.chunk), set()).add((r.track_id, r.det_id))
    rows = [r for r in tracks(spark, SF).where("has_box and frame_idx % 30 in (0, 29)").collect()]
    left, right = {}, {}
    for r in rows:
        side, chunk = (left, r.frame_idx // 30 + 1) if r.frame_idx % 30 == 29 else (right, r.frame_idx // 30)
        side.setdefault((r.track_id // 10, chunk), {})[r.track_id] = (r.x1, r.y1, r.x2, r.y2)
    checked = 0
    for key in set(left) & set(right):
        a, b = left[key], right[key]
        if min(len(a), len(b)) <= 4:
            small, large = (a, b) if len(a) <= len(b) else (b, a)
            best = min(sum(1 - py_iou(small[s], large[t]) for s, t in zip(small, p)) for p in itertools.permutations(large, len(small)))
            pairs = got.get(key, set())
            unmatched = min(len(a), len(b)) - len(pairs)
            total = sum(1 - py_iou(a[t], b[d]) for t, d in pairs)
            assert all(1 - py_iou(a[t], b[d]) <= 0.85 for t, d in pairs) and best - unmatched - 1e-9 <= total <= best + 1e-9
            checked += 1
    assert not (set(got) - set(left) & set(right)) and (checked or not got)


def test_hooks_take_any_function(spark):
    import pandas as pd

    from boxframe.plans import hooks

    frames = spark.createDataFrame([("v", i, b"x") for i in range(3)], "clip_id string, frame_idx long, content binary")
    box = {"x1": 0.0, "y1": 0.0, "x2": 9.0, "y2": 9.0}
    dets = hooks.detect(frames, lambda b: b[["clip_id", "frame_idx"]].assign(det_id=0, class_name="person", confidence=0.9, **box))
    assert dets.count() == 3 and dets.schema["x2"].dataType.typeName() == "double"
    here = frames.join(dets, ["clip_id", "frame_idx"])
    assert hooks.masks(here, lambda b: b[["clip_id", "frame_idx", "det_id"]].assign(mask=b"\x01")).where("length(mask) = 1").count() == 3
    points = hooks.keypoints(here, lambda b: b[["clip_id", "frame_idx", "det_id"]].assign(points=[[{"x": 1.0, "y": 2.0, "score": 0.5}]] * len(b)))
    assert points.where("points[0].y = 2").count() == 3
    videos = spark.createDataFrame([("v", "/v.mp4")], "video_id string, path string")
    scenes = hooks.scenes(videos, lambda b: pd.DataFrame({"video_id": "v", "scene_idx": [1, 2], "start_sec": [0.0, 4.0], "end_sec": [4.0, 9.0]}))
    assert [r.start_sec for r in scenes.orderBy("scene_idx").collect()] == [0.0, 4.0]
    seeds = dets.where("frame_idx = 0").select("clip_id", "det_id", *box)
    moved = hooks.propagate(seeds, lambda b: pd.DataFrame({"clip_id": "v", "track_id": 0, "frame_idx": range(4), **box}))
    assert moved.count() == 4
    poses = hooks.poses(frames, lambda b: pd.DataFrame({"clip_id": "v", "i": range(len(b)), "m": [[0.0] * 12] * len(b)}))
    assert poses.count() == 3
    assert spark.range(2).select(hooks.label(F.lit("?"), lambda s: s + "[]").alias("r")).first().r == "?[]"


def test_documents_of_scenes_go_before_parts(spark):
    docs = spark.createDataFrame([("s", None, 2), ("s", 1, 9), ("p", 2, 3), ("p", 4, 0)], "clip string, part int, n_frames int")
    assert sorted(map(tuple, evaluate.processed_frames(docs, "clip", 10).collect())) == [("p", 10), ("p", 11), ("p", 12), ("s", 0), ("s", 1)]


def test_markers_and_summary(spark, tmp_path):
    from boxframe.sources import readers, writers

    clips = status.skip_reasons(spark.createDataFrame([("a", 301, 0.5), ("b", 1, 0.5), ("c", 2, 0.5), ("d", 9, None)], "clip string, n_frames int, motion double"))
    assert {r.clip: r.reason and r.reason.split(":")[0] for r in clips.collect()} == {"a": "too_long", "b": None, "c": "camera_motion", "d": None}
    for _ in range(2):
        writers.write_markers(status.markers(clips, "clip"), str(tmp_path / "m"))
    back = readers.read_markers(spark, str(tmp_path / "m"))
    assert back.count() == 2 and tuple(status.summary(clips, back, "clip").first()) == (4, 2, 2, 1, 1)


def test_long_folds(spark):
    """Tracks at and around the fold's block size, and a long one that must end soon."""
    import time

    d = spark.createDataFrame([(n,) for n in (1, 255, 256, 257, 513, 40000)], "track_id int").select("track_id", F.explode(F.sequence(F.lit(0), F.col("track_id") - 1)).alias("frame_idx"))
    d = d.withColumns({c: F.col("frame_idx") * 1.0 + i for i, c in enumerate(("x1", "y1", "x2", "y2"))})
    start = time.perf_counter()
    got = {r.track_id: r for r in kalman.smooth_tracks(d, ["track_id"]).groupBy("track_id").agg(F.count("*").alias("n"), F.count_distinct("frame_idx").alias("m"), F.max(F.abs(F.col("x1") - F.col("frame_idx"))).alias("off")).collect()}
    assert all(r.n == r.m == n and r.off < 2 for n, r in got.items()) and len(got) == 6 and time.perf_counter() - start < 60


def test_replies(spark):
    replies = ["[]", 'sure: [{"label":" Robotic Arm ","bbox_2d":[100,200,300,400]}] ok', '[{"bbox_2d":[1,2,3,4]}]', '[{"label":"a","bbox_2d":[1,2,3,4]},{"label":"b"}]', '[{"label":"a","bbox', "none"]
    d = spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "i int, r string")
    got = {r.i: [x.label for x in r.b] for r in d.select("i", X.replied_boxes(F.col("r")).alias("b")).collect()}
    assert got == {0: [], 1: ["robotic arm"], 2: ["robot_part"], 3: ["a"], 4: [], 5: []}


def test_frame_rate_prompts_and_colour(spark):
    d = spark.createDataFrame([("30000/1001",), ("25",), ("x/0",)], "t string")
    assert [r[0] and round(r[0], 2) for r in d.select(X.frame_rate(F.col("t"))).collect()] == [29.97, 25.0, None]
    names = F.array(*[F.lit(f"c{i}") for i in range(13)])
    assert spark.range(1).select(X.prompts(names)).first()[0][1] == "c12 ."
    assert spark.range(1).select(G.colour(F.lit(0), 5)).first()[0].startswith("#")


def test_even_chunks_match_ntile(spark):
    got = K.even_chunks(spark.range(23), ["id"], 5).orderBy("id").collect()
    assert [r.chunk for r in got] == [0] * 5 + [1] * 5 + [2] * 5 + [3] * 4 + [4] * 4


def test_files_round_trip(spark, tmp_path):
    from boxframe.sources import readers, writers

    rows = [("v", 1, "person", 0, 0.0, 0.0, 96.0, 54.0), ("v", 1, "person", 2, 0.0, 0.0, 192.0, 108.0)]
    t = spark.createDataFrame(rows, "video_id string, track_id long, class_name string, frame_idx long, x1 double, y1 double, x2 double, y2 double")
    writers.write_tracks(K.nest(t, 1920, 1080), str(tmp_path / "docs"))
    got = readers.read_tracks(spark, str(tmp_path / "docs")).orderBy("frame_idx").collect()
    assert [r.x2 for r in got] == [0.05, None, 0.1] and got[0].key == "person_1" and got[0].clip_id == "v"
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "c_person_7_actions.json").write_text('{"frames_0_to_29": {"action": "hold"}, "frames_15_to_44": ["a", "b"], "frames_30_to_59": "x"}')
    acts = readers.read_actions(spark, str(tmp_path / "a")).orderBy("start_f").collect()
    assert [(r.clip_id, r.track_id, r.end_f, r.actions) for r in acts] == [("c", 7, 29, ["hold"]), ("c", 7, 44, ["a", "b"]), ("c", 7, 59, ["x"])]
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "gt.txt").write_text("1,2,3,4\n1 2 0 4\n5 6\n")
    assert [r.x2 for r in readers.read_boxes(spark, str(tmp_path / "s" / "gt.txt")).orderBy("idx").collect()] == [4.0, None, None]
    labels = spark.createDataFrame([("b", 2), ("a", 1)], "name string, label_id int")
    assert writers.label_map_text(labels).first()[0] == 'item {\n  name: "a"\n  label_id: 1\n  label_type: 2\n}'


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    names = sorted(QUERIES[name](spark, SF).columns)
    clean = lambda v: round(v, 6) + 0.0 if isinstance(v, float) else v
    got = sorted((tuple(clean(r[n]) for n in names) for r in QUERIES[name](spark, SF).collect()), key=repr)
    want = con.execute(f"select {', '.join(f'q.\"{n}\"' for n in names)} from ({ORACLE_SQL[name]}) q").fetchall()
    assert got == sorted((tuple(clean(v) for v in r) for r in want), key=repr)


def test_every_query_is_registered():
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE_SQL) <= set(entry.oracle_sql())
