"""Registered queries around models: masks, persons, seeded tracks, table functions, observed runs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from boxframe.functions import runs
from boxframe.operators import evaluate, loop, status
from boxframe.operators import tracks as K
from boxframe.plans import hooks
from boxframe.plans.queries import BOX, CLIPS, NAME, _names, _skips, query
from boxframe.plans.views import DET, TRACKS, detections, table, tracks

#: Counts of pixels outside and inside, in turn, of two masks of 16 by 12 pixels.
_COUNTS = "p_partkey % 17, p_size % 9, p_partkey % 5, p_size % 23, 7, p_partkey % 13", "p_size % 11, p_partkey % 19, 0, p_size % 7, p_partkey % 29, 0, 3, 20"


@query(f"""with c as (select p_partkey, [{_COUNTS[0]}] a, [{_COUNTS[1]}] b from part),
p as (select p_partkey, i, len(list_filter(range(1, 7), lambda k: list_sum(a[1:k]) <= i)) % 2 = 1 and i < list_sum(a) ina, len(list_filter(range(1, 9), lambda k: list_sum(b[1:k]) <= i)) % 2 = 1 and i < list_sum(b) inb from c, (select unnest(range(192)) i))
select p_partkey, count(*) filter (ina) pixels, min(i % 16) filter (ina)::double x1, min(i // 16) filter (ina)::double y1, max(i % 16) filter (ina)::double x2, max(i // 16) filter (ina)::double y2,
  count(*) filter (ina and inb) shared, round(coalesce(count(*) filter (ina and inb) / nullif(count(*) filter (ina or inb), 0), 0), 6) iou from p group by 1""")
def mask_boxes(spark, sf):
    """Box, size and overlap of run-length masks, as counting their pixels gives them."""
    counts = [F.expr(f"array({c})") for c in _COUNTS]
    rows = table(spark, sf, "part").select("p_partkey", *[runs.from_counts(c).alias(n) for c, n in zip(counts, "ab")])
    a, b = F.col("a"), F.col("b")
    edges = [e.alias(n) for e, n in zip(runs.mask_box(a, F.lit(16)), BOX)]
    return rows.select("p_partkey", runs.size(a).alias("pixels"), *edges, runs.overlap(a, b).alias("shared"), F.round(runs.mask_iou(a, b), 6).alias("iou"))


@query(f"with {DET} select video_id, det_id from det where class_name = 'A' and confidence > 0.7 and (x2-x1)*(y2-y1) > 7000")
def person_detections(spark, sf):
    """Detections of one class only, over a score and a size."""
    d = detections(spark, sf).withColumn("class_id", F.when(F.col("class_name") == "A", 0).otherwise(1))
    return loop.persons(d, least_area=7000.0).select("video_id", "det_id")


@query(f"""with {TRACKS}, n as (select video_id, track_id, max(frame_idx) + 4 n from tracks group by all), f as (select video_id, track_id, unnest(range(n)) frame_idx from n)
select f.*, case when t.occ is null then 'NO GT DATA' when oov <> 0 then 'OUT OF VIEW' when occ <> 0 then 'FULL OCCLUSION' else 'VISIBLE' end status, coalesce(oov = 0 and has_box, false) drawn from f left join tracks t using (video_id, track_id, frame_idx)""")
def gt_status_past_end(spark, sf):
    """Clips that are three frames longer than their truth, and truth whose boxes are absent now and then."""
    t = tracks(spark, sf)
    ends = t.groupBy("video_id", "track_id").agg((F.max("frame_idx") + 3).alias("last"))
    frames = ends.select("video_id", "track_id", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("frame_idx"))
    return evaluate.truth_status(frames, t, ["video_id", "track_id", "frame_idx"])


@query(f"""with {TRACKS}, n as (select video_id, max(frame_idx) + 1 n from tracks group by 1), cut as (select * from tracks where not (track_id % 4 = 1 and frame_idx < 5)),
seed as (select video_id, track_id, class_name, case when track_id % 3 = 0 then 200 else 202 end class_id, gx1, gy1, gx2, gy2 from tracks where frame_idx = 0 and track_id % 4 <> 1),
b as (select * from cut where (x2-x1)*(y2-y1) > 11000), late as (select video_id, track_id, min(class_name) class_name from b where track_id not in (select track_id from seed) group by all),
e as (select video_id, track_id, class_name, class_id, true seeded from seed union all select video_id, track_id, class_name, case class_name when 'click' then 7 when 'view' then 8 else 999 end, false from late),
g as (select e.*, unnest(range(n)) frame_idx from e join n using (video_id))
select g.video_id, g.track_id, g.class_name, g.class_id::int class_id, g.frame_idx, case when g.frame_idx = 0 and seeded then s.gx1 else b.x1 end x1, case when g.frame_idx = 0 and seeded then s.gy1 else b.y1 end y1,
  case when g.frame_idx = 0 and seeded then s.gx2 else b.x2 end x2, case when g.frame_idx = 0 and seeded then s.gy2 else b.y2 end y2
from g left join b on b.video_id = g.video_id and b.track_id = g.track_id and b.frame_idx = g.frame_idx left join seed s on s.video_id = g.video_id and s.track_id = g.track_id""")
def seeded_tracks(spark, sf):
    """Objects found in frame 0 and followed, and others that turn up later."""
    t = tracks(spark, sf)
    clips = t.groupBy("video_id").agg((F.max("frame_idx") + 1).alias("n_frames"))
    class_id = F.when(F.col("track_id") % 3 == 0, 200).otherwise(202)
    seeds = t.where("frame_idx = 0 and track_id % 4 <> 1").select("video_id", "track_id", "class_name", class_id.alias("class_id"), *[F.col("g" + c).alias(c) for c in BOX])
    known = spark.createDataFrame([("click", 7), ("view", 8)], "class_name string, class_id int")
    return K.seeded_tracks(t.where("not (track_id % 4 = 1 and frame_idx < 5)"), seeds, clips, known, least_area=11000.0)


def _counting_detector():
    """A stand-in with state: it numbers the rows of a clip and moves their boxes by the number."""
    seen = 0

    def model(batch: pd.DataFrame) -> pd.DataFrame:
        nonlocal seen
        numbers = range(seen, seen + len(batch))
        seen += len(batch)
        return batch[["clip_id", "frame_idx"]].assign(det_id=numbers, class_name="person", confidence=0.9, x1=batch["k"] + numbers, y1=0.0, x2=batch["k"] + 50.0, y2=9.0)

    return model


@query(f"""with {TRACKS} select track_id::varchar clip_id, frame_idx, (row_number() over (partition by track_id order by frame_idx) - 1)::bigint det_id, (k + row_number() over (partition by track_id order by frame_idx) - 1)::double x1, (k + 50)::double x2
from tracks where k % 3 = 0""")
def detect_in_sql(spark, sf):
    """A detector called from SQL as a table function, a clip a partition, its frames in order."""
    hooks.table_function(spark, "detect_boxes", _counting_detector, hooks.DETECTIONS, block=16)
    frames = tracks(spark, sf).where("k % 3 = 0").select(F.col("track_id").cast("string").alias("clip_id"), "frame_idx", "k")
    return spark.sql("select clip_id, frame_idx, det_id, x1, x2 from detect_boxes(table({frames}) partition by clip_id order by frame_idx)", frames=frames)


@query(f"with {CLIPS} select count(*) total, count(*) - count(reason) processed, count(reason) skipped, count(*) filter (reason like 'cam%') camera_motion, count(*) filter (reason like 'too%') too_long from marked")
def run_summary_observed(spark, sf):
    """The counts of a run, taken while its one action goes over the clips."""
    clips, observation = status.observed(_skips(spark, sf))
    clips.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([observation.get], "total long, processed long, skipped long, camera_motion long, too_long long")


_KEY = "case when {0} = 0 then '0000' else lpad(length(({0})::varchar)::varchar, 4, '0') || ({0})::varchar end"


@query(f"""with n as (select p_partkey, {NAME} clip, 'v' || {_KEY.format("p_partkey")} || '_scene' || {_KEY.format("p_partkey % 40")} || case when p_partkey % 2 = 0 then '_part' || {_KEY.format("p_size % 12")} else '' end k from part)
select p_partkey, row_number() over (order by k, clip) - 1 place from n""")
def natural_places(spark, sf):
    """Clips numbered in natural order over all."""
    return K.in_natural_order(_names(spark, sf).select("p_partkey", "clip"), "clip").select("p_partkey", "place")
