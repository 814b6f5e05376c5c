"""The loop over chunks, and keyed state of streams, against plain Python and the batch forms."""

import itertools
import shutil

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  registers all queries
from boxframe import streaming
from boxframe.operators import assign, kalman, loop
from boxframe.plans.queries import QUERIES
from boxframe.streaming import ordered

SF = "/root/testdata/sf0.001"
CHUNKS = "clip string, chunk long, det_id long, class_name string, x1 double, y1 double, x2 double, y2 double, n_frames long"


def overlap(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    inter = max(w, 0) * max(h, 0)
    area = lambda x: (x[2] - x[0]) * (x[3] - x[1])
    return inter / (area(a) + area(b) - inter)


def best_pairs(tracks, dets):
    """The cheapest of all full assignments; pairs that cost more than 0.85 are dropped."""
    n = min(len(tracks), len(dets))
    choices = (list(zip(t, d)) for t in itertools.combinations(range(len(tracks)), n) for d in itertools.permutations(range(len(dets)), n))
    cost = lambda p: sum(1 - overlap(tracks[t], dets[d]) for t, d in p)
    return [(t, d) for t, d in min(choices, key=cost) if 1 - overlap(tracks[t], dets[d]) <= 0.85]


def replay(rows, size=30, step=(5.0, 3.0, 5.0, 3.0), lost=7, sight=20):
    """The whole loop in plain Python: a dictionary of frames, each of id to box, as the tracker leaves it."""
    out, names = {}, {}
    for clip in sorted({r[0] for r in rows}):
        n = next(r[8] for r in rows if r[0] == clip)
        frames, classes, seeded, counter = {}, {}, {}, 1000
        for start in range(0, n, size):
            now = sorted((r for r in rows if r[:2] == (clip, start // size)), key=lambda r: r[2])
            if not now:
                continue
            before = frames.get(start - 1, {})
            mine = {d: list(before)[t] for t, d in best_pairs(list(before.values()), [r[4:8] for r in now])} if before else {}
            for d, r in enumerate(now):
                if d not in mine:
                    mine[d], counter = counter, counter + 1
                classes[mine[d]] = r[3]
                seeded[mine[d]] = (start, np.array(r[4:8]))
            for f in range(start, min(start + size, n)):
                frames[f] = {i: tuple(b + (f - s) * np.array(step)) for i, (s, b) in seeded.items() if i % lost or f - s < sight}
        out |= {(clip, f, i): b for f, here in frames.items() for i, b in here.items()}
        names |= {(clip, i): c for i, c in classes.items()}
    return out, names


def clips(seed, n_clips=6, most=4):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(n_clips):
        n = int(rng.integers(1, 170))
        for chunk in range((n + 29) // 30):
            if rng.random() < 0.2:
                continue
            for i in range(int(rng.integers(1, most + 1))):
                # Near where earlier boxes have drifted to, so that many match.
                x, y = 40.0 * i + 150 * chunk + float(rng.integers(0, 30)), 30.0 * i + 90 * chunk + float(rng.integers(0, 30))
                rows.append((f"c{c}", chunk, i, "abc"[int(rng.integers(3))], x, y, x + 60, y + 50, n))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_loop_equals_a_replay(spark, seed):
    rows = clips(seed)
    d = spark.createDataFrame(rows, CHUNKS).repartition(5)
    got = loop.newest_class(loop.track_clips(d, "clip", loop.Drift), "clip").collect()
    boxes, names = replay(rows)
    found = {(r.clip, r.frame_idx, r.track_id): (r.x1, r.y1, r.x2, r.y2) for r in got if r.x1 is not None}
    assert found.keys() == boxes.keys() and all(np.allclose(found[k], boxes[k]) for k in boxes)
    assert {(r.clip, r.track_id): r.class_name for r in got} == names and len(names) > 10
    # Some ids were carried over a chunk's border, others were minted after a gap.
    assert len(names) < len(rows)


class Blind:
    def follow(self, clip, chunk, frames, seeds, ids):
        assert set(seeds) <= set(ids) and frames[0] == 30 * chunk
        yield frames[0] + 1, {i: b for i, b in seeds.items()}
        yield frames[-1] + 5, {i: b for i, b in seeds.items()}  # beyond the chunk: left out


def test_ids_that_a_tracker_never_sees_keep_a_row(spark):
    a = (0.0, 0.0, 9.0, 9.0)
    d = spark.createDataFrame([("v", 0, 0, "x", *a, 40), ("v", 1, 0, "y", *a, 40)], CHUNKS)
    got = sorted((r.frame_idx, r.track_id, r.x1) for r in loop.track_clips(d, "clip", Blind).collect())
    assert got == [(0, 1000, None), (1, 1000, 0.0), (30, 1001, None), (31, 1001, 0.0)]
    assert loop.track_clips(d.where("false"), "clip", loop.Drift).count() == 0


def test_chunk_detections(spark):
    kinds = "clip string, det_id long, class_name string, class_id int, confidence double, x1 double, y1 double, x2 double, y2 double"
    far = lambda i: (200.0 * i, 0.0, 200.0 * i + 100, 100.0)
    people = [("v", 0, "p", 0, 0.9, *far(0)), ("v", 1, "p", 0, 0.7, *far(1)), ("v", 2, "p", 3, 0.99, *far(2)), ("v", 3, "p", 0, 0.9, 0.0, 500.0, 5.0, 505.0)]
    things = [("v", 10, " Cup ", None, 0.5, *far(3)), ("v", 11, "cup", None, 0.4, *far(3)), ("v", 12, "dish", None, 0.14, *far(4)), ("v", 13, "cup", None, 0.3, 610.0, 10.0, 630.0, 30.0), ("v", 14, "lid", None, 0.3, 640.0, 70.0, 670.0, 90.0)]
    got = loop.chunk_detections(spark.createDataFrame(people, kinds), spark.createDataFrame(things, kinds), ["clip"])
    assert sorted((r.det_id, r.class_name) for r in got.collect()) == [(0, "person"), (10, "cup"), (14, "lid")]


def test_track_loop_query(spark):
    rows = QUERIES["track_loop"](spark, SF).collect()
    assert rows and all(r.track_id >= 1000 for r in rows) and len({(r.video_id, r.frame_idx, r.track_id) for r in rows}) == len(rows)


def test_stream_stitch_equals_batch(spark):
    got = {(r.video_id, r.chunk, r.det_id): r.track_id for r in QUERIES["stream_stitch"](spark, SF).collect()}
    want = {(r.video_id, r.chunk, r.det_id): r.track_id for r in QUERIES["stitch_tracks"](spark, SF).collect()}
    assert got == want and want


def batches(spark, folder, rows, schema, groups):
    """Files of one batch each, in order of name."""
    for i, group in enumerate(groups):
        part = spark.createDataFrame([rows[j] for j in group], schema)
        part.withColumn("ts", F.timestamp_millis(1_700_000_000_000 + 1000 * F.col("t"))).drop("t").coalesce(1).write.parquet(f"{folder}/b{i}")


def run(spark, folder, make, n):
    """Runs over the first n batches, then over all, from the same checkpoint."""
    schema = spark.read.parquet(f"{folder}/b0").schema
    seen = []
    for round_ in (n, None):
        source = f"{folder}/in"
        for i in range(100):
            import os

            if not os.path.exists(f"{folder}/b{i}") or (round_ is not None and i >= round_):
                break
            if not os.path.exists(f"{source}/b{i}"):
                shutil.copytree(f"{folder}/b{i}", f"{source}/b{i}")
        stream = make(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(source))
        query = stream.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(lambda b, k: seen.extend(b.collect())).start()
        query.awaitTermination()
    return seen


def test_stitching_goes_on_after_a_restart(spark, tmp_path):
    """Rows out of order, a chunk dealt over batches, a stop between batches, and an end mark."""
    rows = [(*r[:8], r[1] + 1) for r in clips(5, n_clips=4, most=3)]
    rng = np.random.default_rng(2)
    order = sorted(range(len(rows)), key=lambda i: rows[i][8] + rng.random() * 2)  # up to two seconds late
    third = len(order) // 3
    groups = [order[:third], order[third : 2 * third], order[2 * third :]]
    rows.append(("end", 0, 0, "x", 0.0, 0.0, 1.0, 1.0, 9999))
    batches(spark, str(tmp_path), rows, "clip string, chunk long, det_id long, class_name string, x1 double, y1 double, x2 double, y2 double, t long", [*groups, [len(rows) - 1]])
    seen = run(spark, str(tmp_path), lambda s: ordered.stitch_stream(s, "clip", late="1 minute", idle=10**9), 2)
    got = {(r.clip, r.chunk, r.det_id): r.track_id for r in seen if r.clip != "end"}
    batch = spark.createDataFrame([r[:8] for r in rows[:-1]], CHUNKS.rsplit(", ", 1)[0])
    assert got == {(r.clip, r.chunk, r.det_id): r.track_id for r in assign.stitch(batch, "clip").collect()}


def test_smoothing_in_order_and_forgetting(spark, tmp_path):
    """Late frames are smoothed in order, null frames are given, a silent track begins anew."""
    frames = [0, 2, 1, 3, 5, 4]
    rows = [("a", f, *((None,) * 4 if f == 3 else (10.0 + f, 20.0, 8.0, 9.0)), f) for f in frames]
    rows += [("end", 0, 0.0, 0.0, 1.0, 1.0, 50), ("a", 200, 10.0, 20.0, 8.0, 9.0, 200), ("end", 1, 0.0, 0.0, 1.0, 1.0, 9999)]
    batches(spark, str(tmp_path), rows, "key string, frame_idx long, cx double, cy double, w double, h double, t long", [[0, 1, 2], [3, 4, 5], [6], [7], [8]])
    seen = run(spark, str(tmp_path), lambda s: ordered.smooth_stream(s, "key", late="10 seconds", idle=20_000), 2)
    got = {r.frame_idx: r for r in seen if r.key == "a"}
    b = spark.createDataFrame(rows[:6], "key string, frame_idx long, cx double, cy double, w double, h double, t long")
    b = b.select("key", "frame_idx", (F.col("cx") - F.col("w") / 2).alias("x1"), (F.col("cy") - F.col("h") / 2).alias("y1"), (F.col("cx") + F.col("w") / 2).alias("x2"), (F.col("cy") + F.col("h") / 2).alias("y2"))
    for r in kalman.smooth_tracks(b, ["key"]).collect():
        g = got[r.frame_idx]
        assert (g.cx is None or pd.isna(g.cx)) == (r.x1 is None) and (r.x1 is None or abs(g.cx - (r.x1 + r.x2) / 2) < 1e-9)
    again = 10.0 * 2001 / 2011  # the first step of a new filter: its gain at the start times the box
    assert abs(got[200].cx - again) < 1e-6


def test_stream_smoother_equals_batch(spark):
    from boxframe.plans.views import table

    got = {(r.track_id, r.frame_idx): r.cx for r in QUERIES["stream_kalman"](spark, SF).collect()}
    k = F.get_json_object("props", "$.k").cast("double")
    has = F.col("event_id") % 9 != 0
    cx, cy, w, h = 200 + k, 100 + k / 2, 80 + k % 40, 120 + k % 60
    b = table(spark, SF, "events").select(F.col("user_id").alias("track_id"), F.col("event_id").alias("frame_idx"), *[F.when(has, c).alias(n) for c, n in ((cx - w / 2, "x1"), (cy - h / 2, "y1"), (cx + w / 2, "x2"), (cy + h / 2, "y2"))])
    want = kalman.smooth_tracks(b, ["track_id"]).select("track_id", "frame_idx", ((F.col("x1") + F.col("x2")) / 2).alias("cx")).collect()
    clean = lambda v: None if v is None or pd.isna(v) else v
    assert len(want) == len(got)
    for r in want:
        g = clean(got[r.track_id, r.frame_idx])
        assert (g is None) == (r.cx is None) and (g is None or abs(g - r.cx) < 1e-3)


def test_late_rows_are_counted(spark, tmp_path):
    rows = [(1, 0), (1, 5000), (2, 9000), (1, 10), (1, 9001)]
    batches(spark, str(tmp_path), [(u, t) for u, t in rows], "user_id long, t long", [[0, 1, 2], [4], [3]])
    schema = spark.read.parquet(f"{tmp_path}/b0").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/b*")
    counts = streaming.session_counts(stream, "user_id", "10 minutes", "1 minute")
    query = counts.writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).foreachBatch(lambda b, k: b.collect()).start()
    query.awaitTermination()
    assert streaming.dropped_rows(query) == 1
