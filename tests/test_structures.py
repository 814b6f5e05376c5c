"""Grid joins, runs, places, the automaton and table functions against plain Python."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  registers all queries
from boxframe.functions import runs
from boxframe.operators import evaluate, names, ranks, spatial, status
from boxframe.operators import tracks as K
from boxframe.plans import hooks
from boxframe.plans.queries import QUERIES
from boxframe.plans.views import tracks

SF = "/root/testdata/sf0.001"


def as_runs(numbers):
    out = []
    for n in sorted(numbers):
        if out and sum(out[-1]) == n:
            out[-1][1] += 1
        else:
            out.append([n, 1])
    return [tuple(r) for r in out]


def test_runs_equal_sets(spark):
    rng = random.Random(4)
    sets = [(i, [rng.randrange(60) for _ in range(rng.randrange(40))], [rng.randrange(60) for _ in range(rng.randrange(40))]) for i in range(60)]
    sets += [(60, [], []), (61, [5], [5, 5]), (62, list(range(60)), [0, 59])]
    d = spark.createDataFrame(sets, "i int, a array<int>, b array<int>").select("i", runs.from_numbers(F.col("a")).alias("a"), runs.from_numbers(F.col("b")).alias("b"))
    got = {r.i: r for r in d.select("*", runs.overlap(F.col("a"), F.col("b")).alias("n"), runs.size(F.col("a")).alias("size"), runs.mask_iou(F.col("a"), F.col("b")).alias("iou")).collect()}
    for i, a, b in sets:
        a, b = set(a), set(b)
        assert [tuple(r) for r in got[i].a] == as_runs(a) and got[i].n == len(a & b) and got[i].size == len(a)
        assert got[i].iou == pytest.approx(len(a & b) / len(a | b) if a | b else 0)


def test_masks_in_both_forms(spark):
    rng = np.random.default_rng(1)
    masks = [(i, rng.random((7, 11)) < p) for i, p in enumerate([0, 0.05, 0.5, 0.95, 1])]
    rows = []
    for i, m in masks:
        flat, counts, inside = m.ravel(), [], False
        for value, run in itertools.groupby(flat.tolist()):
            if value != inside:
                counts.append(0)
            inside = not value
            counts.append(len(list(run)))
        rows.append((i, bytearray(np.packbits(flat)), counts if not flat[0] else counts))
    d = spark.createDataFrame(rows, "i int, mask binary, counts array<int>")
    d = d.select("i", runs.from_bits(F.col("mask"), F.lit(77)).alias("bits"), runs.from_counts(F.col("counts")).alias("counts"))
    got = {r.i: r for r in d.select("*", *[e.alias(n) for e, n in zip(runs.mask_box(F.col("bits"), F.lit(11)), K.BOX)]).collect()}
    for i, m in masks:
        y, x = np.nonzero(m)
        assert [tuple(r) for r in got[i].bits] == as_runs(np.flatnonzero(m.ravel()).tolist()) == [tuple(r) for r in got[i].counts]
        box = (got[i].x1, got[i].y1, got[i].x2, got[i].y2)
        assert box == ((x.min(), y.min(), x.max(), y.max()) if len(x) else (None,) * 4)


def test_grid_pairs_equal_all_pairs(spark):
    rng = random.Random(2)
    rows = []
    for i in range(150):
        x, y = rng.randint(-200, 200) / 2, rng.randint(-200, 200) / 2
        rows.append((i % 3, i, x, y, x + rng.choice([0, 5, 16, 60, 200]), y + rng.choice([1, 16, 90])))
    rows.append((0, 999, None, 1.0, 2.0, 3.0))
    d = spark.createDataFrame(rows, "f int, i int, x1 double, y1 double, x2 double, y2 double")
    other = d.select("f", F.col("i").alias("j"), *[F.col(c).alias("g" + c) for c in K.BOX])
    met = lambda a, b: max(a[2], b[2]) < min(a[4], b[4]) and max(a[3], b[3]) < min(a[5], b[5])
    want = sorted((a[1], b[1]) for a in rows[:-1] for b in rows[:-1] if a[0] == b[0] and met(a, b))
    for cell in (16.0, 64.0, 1000.0):
        got = sorted((r.i, r.j) for r in spatial.overlapping_pairs(d, other, ["f"], cell).collect())
        assert got == want


def test_overlapping_matches_equal_the_plain_form(spark):
    t = tracks(spark, SF)
    truth = t.select("video_id", F.col("track_id").alias("gt_id"), "frame_idx", "gx1", "gy1", "gx2", "gy2").where("frame_idx % 5 <> 2")
    preds = t.select("video_id", "track_id", "frame_idx", *K.BOX)
    a = {(r.video_id, r.track_id): (r.gt_id, round(r.mean_iou, 9)) for r in evaluate.match_tracks(preds, truth).collect()}
    b = {(r.video_id, r.track_id): (r.gt_id, round(r.mean_iou, 9)) for r in spatial.match_overlapping(preds, truth).collect()}
    assert a == b and a


@pytest.mark.parametrize("ranges", [1, 7, 600])
def test_places(spark, monkeypatch, ranges):
    monkeypatch.setattr(ranks, "GROUP", 16)
    rng = random.Random(3)
    rows = [(rng.choice([None, *range(50)]), i) for i in range(900)]
    d = spark.createDataFrame(rows, "k int, i int").repartition(5)
    got = ranks.ranked(d, [F.desc_nulls_first("k"), "i"], "place", part="range", ranges=ranges).collect()
    want = sorted(rows, key=lambda r: (r[0] is not None, -(r[0] or 0), r[1]))
    assert [(r.k, r.i) for r in sorted(got, key=lambda r: r.place)] == want and sorted(r.place for r in got) == list(range(900))
    assert ranks.ranked(d.where("false"), ["i"]).count() == 0


def test_automaton_equals_search(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abé") for _ in range(n))
    parts = {word(rng.randrange(1, 7)) for _ in range(60)} | {"a", "zz"}
    texts = {word(rng.randrange(0, 40)) for _ in range(80)} | {"", "zzz", "q"}
    want = {t: max((p for p in parts if p in t), key=lambda p: (len(p), p), default=None) for t in texts}
    t = spark.createDataFrame([(x,) for x in [*texts, *texts]] + [(None,)], "t string")
    p = spark.createDataFrame([(x,) for x in parts] + [(None,), ("",)], "p string")
    for most in (names.MOST_CHARS, 50):
        got = {r.t: r.p for r in names.longest_contained(t, p, "t", "p", most).collect()}
        assert got.pop(None) is None and got == want
    none = names.longest_contained(t, p.where("false"), "t", "p").collect()
    assert len(none) == len(want) + 1 and all(r.p is None for r in none)


def test_table_function_in_a_join(spark):
    hooks.table_function(spark, "twice", lambda: lambda b: b[["clip_id", "i"]].assign(half=b["i"] / 2), "clip_id string, i long, half double", block=2)
    clips = spark.createDataFrame([("a", 3), ("b", 1), ("c", 0)], "clip_id string, n int")
    frames = clips.where("n > 0").select("clip_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n").cast("long"))).alias("i"))
    got = spark.sql("select c.clip_id, c.n, t.i, t.half from {clips} c join twice(table({frames}) partition by clip_id order by i) t on t.clip_id = c.clip_id", clips=clips, frames=frames)
    assert sorted(map(tuple, got.collect())) == [("a", 3, 1, 0.5), ("a", 3, 2, 1.0), ("a", 3, 3, 1.5), ("b", 1, 1, 0.5)]


def test_observed_runs(spark, tmp_path):
    rows = [(f"c{i}", n, 0.5 if i % 2 else None) for i, n in enumerate([301, 10, 1, 400, 20, 30])]
    clips = status.skip_reasons(spark.createDataFrame(rows, "clip string, n_frames int, motion double"))
    watched, seen = status.observed(clips)
    watched.write.parquet(f"{tmp_path}/done")
    want = {"total": 6, "processed": 2, "skipped": 4, "camera_motion": 2, "too_long": 2}
    assert seen.get == want and spark.read.parquet(f"{tmp_path}/done").count() == 6
    for i in range(3):
        clips.where(f"clip in ('c{2 * i}', 'c{2 * i + 1}')").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(clips.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    query = status.observed_stream(stream).writeStream.option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).foreachBatch(lambda b, n: b.count()).start()
    query.awaitTermination()
    assert status.observed_total(query) == want


def test_seeded_tracks_without_frames(spark):
    none = spark.createDataFrame([], "video_id int, track_id long, class_name string, class_id int, frame_idx long, x1 double, y1 double, x2 double, y2 double")
    clips = spark.createDataFrame([(1, 0), (2, 3)], "video_id int, n_frames long")
    seed = spark.createDataFrame([(1, 1, "a", 0, 0.0, 0.0, 9.0, 9.0), (2, 2, "a", 0, 0.0, 0.0, 9.0, 9.0)], "video_id int, track_id long, class_name string, class_id int, x1 double, y1 double, x2 double, y2 double")
    got = K.seeded_tracks(none, seed, clips, none.select("class_name", "class_id")).orderBy("frame_idx").collect()
    assert [(r.video_id, r.frame_idx, r.x2) for r in got] == [(2, 0, 9.0), (2, 1, None), (2, 2, None)]


def test_assignment_holds_groups_of_any_size(spark):
    rows = QUERIES["assign_hungarian"](spark, SF).collect()
    assert len({(r.video_id, r.chunk, r.det_id) for r in rows}) == len(rows)
