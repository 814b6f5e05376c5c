"""Tracks of crowded videos and their ground truth, against the plain forms."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  registers all queries
from boxframe.operators import evaluate, matching
from boxframe.operators import tracks as K
from boxframe.plans import queries
from boxframe.plans.queries import QUERIES
from boxframe.plans.views import tracks

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("block", [3, 2048])
def test_blocks_equal_the_plain_form(spark, monkeypatch, block):
    """Absent frames, repeated rows, null and flat boxes, ties, tracks of several pieces."""
    monkeypatch.setattr(matching, "PIECE_FRAMES", 16)
    monkeypatch.setattr(matching, "STRIP", 2)
    rng = random.Random(7)

    def rows(names):
        out = []
        for clip in ("a", "b", None):
            for name in names:
                for frame in range(rng.randrange(0, 5), rng.randrange(5, 45)):
                    for _ in range(rng.choice([0, 1, 1, 1, 2])):
                        x, y = rng.randrange(0, 40), rng.randrange(0, 40)
                        box = (float(x), float(y), float(x + rng.choice([0, 20, 60])), float(y + rng.choice([-3, 30, 50])))
                        out.append((clip, name, frame, *(box if rng.random() < 0.9 else (None,) * 4)))
        return out

    some = rows([f"t{i}" for i in range(9)])
    names = ", ".join(f"{c} double" for c in K.BOX)
    preds = spark.createDataFrame([*some, ("only", "t0", 3, 0.0, 0.0, 9.0, 9.0)], f"video_id string, track_id string, frame_idx long, {names}")
    truth = spark.createDataFrame(rows(range(8)), f"video_id string, gt_id long, frame_idx long, {names}")
    truth = truth.union(truth.where("gt_id = 2").withColumn("gt_id", F.lit(11).cast("long"))).select("video_id", "gt_id", "frame_idx", *[F.col(c).alias("g" + c) for c in K.BOX])
    for least in (0.0, 0.08):
        want = {(r.video_id, r.track_id): (r.gt_id, round(r.mean_iou, 9)) for r in evaluate.match_tracks(preds, truth, least=least).collect()}
        got = {(r.video_id, r.track_id): (r.gt_id, round(r.mean_iou, 9)) for r in matching.match_in_blocks(preds, truth, least=least, block=block).collect()}
        assert got == want and want
    assert matching.match_in_blocks(preds.where("false"), truth).count() == 0


def test_matches_of_crowded_videos(spark):
    """Fifteen videos, each with all tracks of its remainder."""
    rows = QUERIES["track_match_best"](spark, SF).collect()
    assert rows and all(r.video_id == r.track_id % 15 == r.gt_id % 15 for r in rows)


def crowded_matches(spark, monkeypatch):
    """Mean IoUs by the plain form; queries then see the same videos, of three tracks, as this
    scale has one in each of fifteen."""
    t = tracks(spark, SF).withColumn("video_id", F.col("track_id") % 5)
    monkeypatch.setattr(queries, "crowded", lambda spark, sf: t)
    truth = t.select("video_id", F.col("track_id").alias("gt_id"), "frame_idx", "gx1", "gy1", "gx2", "gy2")
    return [r.mean_iou for r in evaluate.match_tracks(t.select("video_id", "track_id", "frame_idx", *K.BOX), truth).collect()]


def test_histogram_of_crowded_videos(spark, monkeypatch):
    values = crowded_matches(spark, monkeypatch)
    want = [sum(min(int((v - 0.2) / 0.04), 19) == i for v in values) for i in range(20)]
    assert [r.n for r in QUERIES["iou_histogram"](spark, SF).orderBy("bin").collect()] == want and sum(want) == 15


def test_mean_of_crowded_videos(spark, monkeypatch):
    values = crowded_matches(spark, monkeypatch)
    (row,) = QUERIES["od_mean_iou"](spark, SF).collect()
    assert row.n_matched == len(values) == 15 and row.mean_iou == pytest.approx(sum(values) / 15, abs=1e-6)


def test_parts_against_the_whole_truth(spark):
    """Clips of ten frames of fifteen videos, by the plain form."""
    rows = QUERIES["vidor_offset_match"](spark, SF).collect()
    t = tracks(spark, SF).withColumn("video_id", F.col("track_id") % 15)
    preds = t.where("class_name = 'click'").withColumn("part", (F.floor(F.col("frame_idx") / 10) + 1).cast("long"))
    truth = t.select("video_id", F.col("track_id").alias("gt_id"), "frame_idx", "gx1", "gy1", "gx2", "gy2")
    want = evaluate.match_tracks(preds.select("video_id", "part", "track_id", "frame_idx", *K.BOX), truth, track=["part", "track_id"]).collect()
    assert sorted((r.video_id, r.part, r.track_id, r.gt_id) for r in rows) == sorted((r.video_id, r.part, r.track_id, r.gt_id) for r in want)
    assert rows and all(r.video_id == r.track_id % 15 for r in rows)


def test_objects_of_windows_with_like_and_other_frames(spark):
    """Each window's objects, where windows share their frames, part of them or none."""
    rng = random.Random(3)
    sampled = [(rng.randrange(2), w, 0, f) for w in range(8) for f in ([0, 2, 4] if w < 4 else rng.sample(range(9), 3))]
    boxes = [(rng.randrange(2), f, f"{'person' if i % 3 == 0 else 'cup'}_{i}", 1.0 if rng.random() < 0.7 else None) for f in range(9) for i in range(6)]
    s = spark.createDataFrame(sampled, "video_id int, track_id int, start_f int, frame_idx long")
    b = spark.createDataFrame(boxes, "video_id int, frame_idx long, key string, x1 double")
    got = sorted(map(tuple, K.relevant_objects(s, b, "video_id", ["video_id", "track_id"]).collect()))
    want = {(v, w, start, key) for v, w, start, f in sampled for c, frame, key, x in boxes if (c, frame) == (v, f) and x is not None and not key.startswith("person_")}
    assert got == sorted(want) and want
    assert all(r.video_id == r.track_id % 15 for r in QUERIES["relevant_objects"](spark, SF).collect())


def test_objects_of_a_set_are_dealt_to_blocks_and_tasks(spark, monkeypatch, tmp_path):
    """Many windows with the same frames: every object once, no task has all, and little disk."""
    monkeypatch.setattr(K, "BLOCK_OBJECTS", 8, raising=False)
    one = F.floor(F.col("id") / 10000)
    sampled = spark.range(40).select(one.alias("video_id"), F.col("id").alias("track_id"), F.lit(0).alias("start_f"), F.explode(F.array(F.lit(0), F.lit(2)).cast("array<bigint>")).alias("frame_idx"))
    key = F.when(F.col("id") % 7 == 0, F.concat(F.lit("person_"), "id")).otherwise(F.concat(F.lit("cup_"), "id"))
    boxes = spark.range(900).select(one.alias("video_id"), F.explode(F.sequence(F.lit(0), F.lit(3)).cast("array<bigint>")).alias("frame_idx"), key.alias("key"), F.lit(1.0).alias("x1"))
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")
    try:
        found = K.relevant_objects(sampled, boxes, "video_id", ["video_id", "track_id"])
        rows = found.withColumn("task", F.spark_partition_id()).collect()
        monkeypatch.setattr(K, "BLOCK_OBJECTS", 1008, raising=False)
        many = boxes.unionByName(spark.range(900, 8000).select(one.alias("video_id"), F.lit(2).cast("long").alias("frame_idx"), F.concat(F.lit("cup_"), "id").alias("key"), F.lit(1.0).alias("x1")))
        K.relevant_objects(sampled, many, "video_id", ["video_id", "track_id"]).write.parquet(str(tmp_path / "out"))
    finally:
        spark.conf.set(threshold, before)
    want = {(0, w, 0, f"cup_{i}") for w in range(40) for i in range(900) if i % 7}
    assert len(rows) == len(want) and {tuple(r)[:4] for r in rows} == want
    tasks = [sum(r.task == t for r in rows) for t in {r.task for r in rows}]
    assert len(tasks) > 1 and max(tasks) < len(rows) / 2
    n = spark.read.parquet(str(tmp_path / "out")).count()
    size = sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet"))
    assert n == 40 * (8000 - 129) and size / n < 0.6, size / n


def test_samples_of_present_windows(spark):
    """The same rows as a join with the windows that are present, also at the limit and of one row."""
    rng = random.Random(5)
    rows = [(w % 3, w, 15 * (w % 2), f, None if rng.random() < 0.5 else 1.0) for w in range(60) for f in range(rng.choice([1, 15, 15, 16]))]
    s = spark.createDataFrame(rows, "video_id int, track_id int, start_f int, frame_idx long, x1 double")
    keys = ["video_id", "track_id"]
    want = s.join(K.present_windows(s, keys).select(*keys, "start_f"), [*keys, "start_f"])
    got = sorted(map(tuple, K.present_samples(s, keys).drop("n_missing", "x1").collect()))
    assert got == sorted(tuple(r) for r in want.select(*keys, "start_f", "frame_idx").collect()) and 0 < len(got) < len(rows)
