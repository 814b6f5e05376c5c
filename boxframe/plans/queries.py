"""The registered queries of the annotation operators, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boxframe import streaming
from boxframe.functions import geometry as G
from boxframe.functions import text as X
from boxframe.operators import assign, dedupe, evaluate, kalman, matching, names, spatial, status
from boxframe.operators import tracks as K
from boxframe.sources import readers
from boxframe.plans.views import CROWDED, DET, TRACKS, crowded, detections, distance_sql, inter_sql, iou_sql, table, tracks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
BOX = ("x1", "y1", "x2", "y2")


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def rounded(names, digits: int = 6):
    return [F.round(n, digits).alias(n) for n in names]


def rounded_sql(names, digits: int = 6) -> str:
    return ", ".join(f"round({n}, {digits}) {n}" for n in names)


# ---- scores against ground truth

SCORES = f"""{TRACKS}, s as (select *, case when occ = 0 and oov = 0 then case when has_box then {iou_sql()} else 0 end else case when has_box then 0.0 else 1.0 end end iou,
  case when occ = 0 and oov = 0 then case when has_box then {distance_sql()} else 'inf'::double end else case when has_box then 'inf'::double else 0.0 end end ce from tracks)"""


@query(f"""with {SCORES}, c as (select t, t * 0.05::double th, avg((iou >= t * 0.05::double)::int::double) rate from s, (select unnest(range(21)) t) group by t)
select round((select avg(iou) from s), 6) mean_score, round(0.05 * (sum(rate) - sum(case when t in (0, 20) then rate else 0 end) / 2), 6) success_auc from c""")
def success_auc(spark, sf):
    return evaluate.success(evaluate.single_scores(tracks(spark, sf))).select(*rounded(["mean_score", "success_auc"]))


@query(f"with {SCORES} select t::int t, t * 0.05::double threshold, round(avg((iou >= t * 0.05::double)::int::double), 6) rate from s, (select unnest(range(21)) t) group by t")
def success_curve_21(spark, sf):
    return evaluate.success_curve(evaluate.single_scores(tracks(spark, sf))).select("t", "threshold", *rounded(["rate"]))


@query(f"with {SCORES} select t::int t, round(avg((ce <= t)::int::double), 6) rate from s, (select unnest(range(51)) t) group by t")
def precision_curve_20(spark, sf):
    return evaluate.precision_curve(evaluate.single_scores(tracks(spark, sf)), 50).select("t", *rounded(["rate"]))


@query(f"with {SCORES} select t::int t, round(avg((ce <= t)::int::double), 6) rate from s, (select unnest(range(101)) t) where (occ = 0 and oov = 0) or not has_box group by t")
def precision_curve_50(spark, sf):
    return evaluate.precision_curve(evaluate.single_scores(tracks(spark, sf), "skip"), 100).select("t", *rounded(["rate"]))


BEST = f"""{TRACKS}, g as (select video_id, frame_idx, min(track_id) gid from tracks group by all),
t as (select video_id, frame_idx, track_id, gx1, gy1, gx2, gy2, occ, oov from tracks join g using (video_id, frame_idx) where track_id = gid),
p as (select t.video_id, t.frame_idx, t.occ, t.oov, x.track_id ord, coalesce({iou_sql('x.', 't.g')}, 0) i, {distance_sql('x.', 't.g')} c, x.has_box from t join tracks x using (video_id, frame_idx)),
b as (select video_id, frame_idx, any_value(occ) occ, any_value(oov) oov, count(*) filter (has_box) n_preds, arg_max(i, i * 1e9 + ord) filter (has_box) bi, arg_max(c, i * 1e9 + ord) filter (has_box) bc from p group by all),
f as (select video_id, frame_idx, n_preds, case when occ = 0 and oov = 0 then case when n_preds > 0 then bi else 0 end else case when n_preds > 0 then 0.0 else 1.0 end end iou,
  case when occ = 0 and oov = 0 then case when n_preds > 0 then bc else 'inf'::double end else case when n_preds > 0 then 'inf'::double else 0.0 end end ce, occ, oov from b)"""


def _best(spark, sf, hidden):
    t = tracks(spark, sf)
    first = Window.partitionBy("video_id", "frame_idx").orderBy("track_id")
    truth = t.withColumn("r", F.row_number().over(first)).where("r = 1").select("video_id", "frame_idx", "gx1", "gy1", "gx2", "gy2", "occ", "oov")
    preds = t.where("has_box").withColumn("ord", F.col("track_id"))
    scores = evaluate.best_scores(truth, preds, ["video_id", "frame_idx"], hidden)
    return scores.select("video_id", "frame_idx", "n_preds", F.round("iou", 6).alias("iou"), F.round("ce", 4).alias("ce"))


@query(f"with {BEST} select video_id, frame_idx, n_preds, round(iou, 6) iou, round(ce, 4) ce from f")
def frame_scores_lasot(spark, sf):
    return _best(spark, sf, "miss")


@query(f"with {BEST} select video_id, frame_idx, n_preds, round(iou, 6) iou, round(ce, 4) ce from f where (occ = 0 and oov = 0) or n_preds = 0")
def frame_scores_oracle(spark, sf):
    return _best(spark, sf, "skip")


@query(f"with {TRACKS} select video_id, track_id, frame_idx, case when oov <> 0 then 'OUT OF VIEW' when occ <> 0 then 'FULL OCCLUSION' else 'VISIBLE' end status, oov = 0 drawn from tracks")
def gt_status(spark, sf):
    state = F.when(F.col("oov") != 0, "OUT OF VIEW").when(F.col("occ") != 0, "FULL OCCLUSION").otherwise("VISIBLE")
    drawn = (F.col("oov") == 0) & (F.col("gx2") > F.col("gx1")) & (F.col("gy2") > F.col("gy1"))
    return tracks(spark, sf).select("video_id", "track_id", "frame_idx", state.alias("status"), drawn.alias("drawn"))


MATCHED = f"""{CROWDED}, m as (select p.video_id, p.track_id, g.track_id gt_id, avg({iou_sql('p.', 'g.g')}) mean_iou from tracks p join tracks g using (video_id, frame_idx) where p.has_box group by all),
w as (select *, row_number() over (partition by video_id, track_id order by round(mean_iou, 9) desc, gt_id) r from m), best as (select video_id, track_id, gt_id, mean_iou from w where r = 1 and mean_iou > 0.2)"""


def _matched(spark, sf):
    """In crowded videos almost all tracks meet, so they are matched by blocks."""
    t = crowded(spark, sf)
    truth = t.select("video_id", F.col("track_id").alias("gt_id"), "frame_idx", "gx1", "gy1", "gx2", "gy2")
    return matching.match_in_blocks(t.select("video_id", "track_id", "frame_idx", *BOX), truth)


@query(f"with {MATCHED} select video_id, track_id, gt_id, round(mean_iou, 6) mean_iou from best")
def track_match_best(spark, sf):
    return _matched(spark, sf).select("video_id", "track_id", "gt_id", *rounded(["mean_iou"]))


@query(f"""with {MATCHED}, h as (select cast(least(floor((mean_iou - 0.2) / (0.8 / 20)), 19) as bigint) bin, count(*) n from best where mean_iou between 0.2 and 1 group by 1)
select i bin, coalesce(n, 0) n from (select unnest(range(20)) i) left join h on bin = i""")
def iou_histogram(spark, sf):
    return evaluate.iou_histogram(_matched(spark, sf), "mean_iou")


@query(f"with {MATCHED} select count(*) n_matched, round(avg(mean_iou), 6) mean_iou from best")
def od_mean_iou(spark, sf):
    return evaluate.mean_overlap(_matched(spark, sf)).select("n_matched", *rounded(["mean_iou"]))


@query(f"""with {CROWDED}, p as (select video_id, frame_idx // 10 + 1 part, track_id, frame_idx, x1, y1, x2, y2 from tracks where has_box and class_name = 'click'),
m as (select p.video_id, p.part, p.track_id, g.track_id gt_id, avg({iou_sql('p.', 'g.g')}) mean_iou from p join tracks g using (video_id, frame_idx) group by all),
w as (select *, row_number() over (partition by video_id, part, track_id order by round(mean_iou, 9) desc, gt_id) r from m)
select video_id, part, track_id, gt_id, round(mean_iou, 6) mean_iou from w where r = 1 and mean_iou > 0.2""")
def vidor_offset_match(spark, sf):
    """Clips of ten frames, numbered from 0 in each, against the truth of the whole video; one class only."""
    t = crowded(spark, sf)
    part = (F.floor(F.col("frame_idx") / 10) + 1).cast("long")
    clips = t.select("video_id", part.alias("part")).distinct()
    clips = clips.withColumn("frame_offset", K.clip_offset_frames(F.lit(0.0), F.col("part"), F.lit(1.0)))
    preds = t.withColumn("part", part).withColumn("frame_idx", F.col("frame_idx") % 10)
    preds = evaluate.shifted(evaluate.of_class(preds, "click"), clips, ["video_id", "part"])
    truth = t.select("video_id", F.col("track_id").alias("gt_id"), "frame_idx", "gx1", "gy1", "gx2", "gy2")
    seen = preds.select("video_id", "part", "frame_idx").distinct()
    found = matching.match_in_blocks(preds, truth.join(seen, ["video_id", "frame_idx"]), ["video_id", "part"])
    return found.select("video_id", "part", "track_id", "gt_id", *rounded(["mean_iou"]))


@query(f"with {BEST}, z as (select *, frame_idx // 10 + 1 part from f) select video_id, frame_idx, n_preds, round(iou, 6) iou, round(ce, 4) ce from z where case when video_id % 3 = 0 then frame_idx < 25 else part % 3 <> 0 and frame_idx % 10 < 8 end")
def lasot_placed_scores(spark, sf):
    """Documents of whole scenes, or else of parts of ten frames of which each third is absent and
    the last two frames of each were not processed; such frames have no score."""
    t = tracks(spark, sf)
    part = (F.floor(F.col("frame_idx") / 10) + 1).cast("int")
    first = Window.partitionBy("video_id", "frame_idx").orderBy("track_id")
    truth = t.withColumn("r", F.row_number().over(first)).where("r = 1").select("video_id", "frame_idx", "gx1", "gy1", "gx2", "gy2", "occ", "oov")
    boxes = t.where("has_box").withColumn("ord", F.col("track_id")).select("video_id", part.alias("part"), "frame_idx", "ord", *BOX)
    whole = boxes.where("video_id % 3 = 0 and frame_idx < 25").withColumn("part", F.lit(None).cast("int"))
    parts = boxes.where("part % 3 <> 0 and frame_idx % 10 < 8").withColumn("frame_idx", F.col("frame_idx") % 10)
    scenes = t.select("video_id", part.alias("part")).distinct()
    documents = scenes.where("part % 3 <> 0").withColumn("n_frames", F.lit(8))
    documents = documents.union(scenes.where("video_id % 3 = 0").select("video_id", F.lit(None).cast("int"), F.lit(25)).distinct())
    preds = evaluate.placed_boxes(whole.union(parts), documents, "video_id", 10)
    seen = evaluate.processed_frames(documents, "video_id", 10)
    scores = evaluate.best_scores(truth, preds, ["video_id", "frame_idx"], processed=seen)
    return scores.select("video_id", "frame_idx", "n_preds", F.round("iou", 6).alias("iou"), F.round("ce", 4).alias("ce"))


@query(f"with {TRACKS} select video_id, frame_idx, track_id from tracks where has_box and lower(class_name) not like '%click%'")
def class_exclusion(spark, sf):
    return evaluate.without_class(tracks(spark, sf).where("has_box"), "click").select("video_id", "frame_idx", "track_id")


# ---- geometry

@query(f"with {DET} select video_id, det_id, (x2-x1)*(y2-y1) area from det where (x2-x1)*(y2-y1) > 500 and confidence > 0.7")
def bbox_area_filter(spark, sf):
    d = detections(spark, sf).withColumn("area", G.area(G.box()))
    return d.where("area > 500 and confidence > 0.7").select("video_id", "det_id", "area")


def _pairs(spark, sf, condition):
    d = detections(spark, sf)
    names = ["video_id", "det_id", *BOX]
    a, b = (d.select(*[F.col(n).alias(n if n == "video_id" else p + n) for n in names]) for p in "ab")
    return a.join(b, "video_id").where(condition)


@query(f"with {DET} select video_id, a.det_id a_id, b.det_id b_id, round({iou_sql('a.', 'b.')}, 6) iou from det a join det b using (video_id) where a.det_id < b.det_id and {inter_sql('a.', 'b.')} > 0")
def bbox_iou_pairs(spark, sf):
    """Pairs of overlapping boxes of one frame, met by a grid."""
    d = detections(spark, sf)
    other = d.select("video_id", F.col("det_id").alias("b_id"), *[F.col(c).alias("b" + c) for c in BOX])
    met = spatial.overlapping_pairs(d.select("video_id", F.col("det_id").alias("a_id"), *BOX), other, ["video_id"], 512.0, "b").where("a_id < b_id")
    return met.select("video_id", "a_id", "b_id", F.round(G.iou(G.box(), G.box("b")), 6).alias("iou"))


@query(f"with {DET} select video_id, a.det_id a_id, b.det_id b_id, round({inter_sql('a.', 'b.')} / ((a.x2-a.x1)*(a.y2-a.y1)) + 1e-9, 6) containment from det a join det b using (video_id) where a.det_id <> b.det_id and {inter_sql('a.', 'b.')} / ((a.x2-a.x1)*(a.y2-a.y1)) > 0.5")
def bbox_containment(spark, sf):
    both = _pairs(spark, sf, "adet_id <> bdet_id").withColumn("containment", G.containment(G.box("a"), G.box("b"))).where("containment > 0.5").withColumn("containment", F.col("containment") + 1e-9)
    return both.select("video_id", F.col("adet_id").alias("a_id"), F.col("bdet_id").alias("b_id"), *rounded(["containment"]))


@query(f"with {TRACKS} select video_id, track_id, frame_idx, round({distance_sql()}, 6) distance from tracks where has_box")
def bbox_center_dist(spark, sf):
    t = tracks(spark, sf).where("has_box").withColumn("distance", G.center_distance(G.box(), G.box("g")))
    return t.select("video_id", "track_id", "frame_idx", *rounded(["distance"]))


@query(f"""with {DET}, s as (select video_id, det_id, greatest(0.0, (x1+x2)/2 - (x2-x1)*0.75) a, greatest(0.0, (y1+y2)/2 - (y2-y1)*0.75) b, least(320.0, (x1+x2)/2 + (x2-x1)*0.75) c, least(240.0, (y1+y2)/2 + (y2-y1)*0.75) d from det)
select video_id, det_id, case when a < c and b < d then round(a, 6) end x1, case when a < c and b < d then round(b, 6) end y1, case when a < c and b < d then round(c, 6) end x2, case when a < c and b < d then round(d, 6) end y2 from s""")
def bbox_scale_clamp(spark, sf):
    b = G.scaled_within(G.box(), 320, 240)
    return detections(spark, sf).select("video_id", "det_id", *[F.round(c, 6).alias(n) for n, c in zip(BOX, b)])


@query(f"with {DET} select video_id, det_id, round(x1/400, 4) nx1, round(y1/300, 4) ny1, round(round(x2/400, 4)*400, 4) rx2, round(round(y2/300, 4)*300, 4) ry2 from det")
def bbox_norm_roundtrip(spark, sf):
    n = G.normalised(G.box(), 400, 300)
    r = G.denormalised(n, 400, 300)
    return detections(spark, sf).select("video_id", "det_id", n.x1.alias("nx1"), n.y1.alias("ny1"), F.round(r.x2, 4).alias("rx2"), F.round(r.y2, 4).alias("ry2"))


@query(f"with {DET} select video_id, det_id, (x1+x2)/2 cx, (y1+y2)/2 cy, x2-x1 w, y2-y1 h, x1+(x2-x1) back_x2, (y1+y2)/2-(y2-y1)/2 back_y1 from det")
def bbox_xywh_cxcywh(spark, sf):
    b = G.box()
    cx, cy, w, h = G.to_centre(b)
    back = G.from_centre(cx, cy, w, h)
    return detections(spark, sf).select("video_id", "det_id", cx.alias("cx"), cy.alias("cy"), w.alias("w"), h.alias("h"), G.from_xywh(b.x1, b.y1, w, h).x2.alias("back_x2"), back.y1.alias("back_y1"))


@query(f"with {DET} select video_id, det_id, x1 >= 0 and y1 >= 0 and x2 <= 320 and y2 <= 240 and x1 < x2 and y1 < y2 drawable, cast(x1 as int) px, cast(y1 as int) py from det")
def drawable_boxes(spark, sf):
    return detections(spark, sf).select("video_id", "det_id", G.drawable(G.box(), 320, 240).alias("drawable"), F.col("x1").cast("int").alias("px"), F.col("y1").cast("int").alias("py"))


# ---- greedy selection

def _fold_sql(source: str, order: str, reject: str) -> str:
    """The same fold as a recursive query: one detection of every group a step."""
    return f"""with recursive {DET}, src as (select * from det {source}), o as (select *, row_number() over (partition by video_id order by {order}, det_id) rn from src),
r(video_id, rn, kept) as (select video_id, 1::bigint, [{{'det_id': det_id, 'class_name': class_name, 'confidence': confidence, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}] from o where rn = 1
  union all select o.video_id, o.rn, case when len(list_filter(r.kept, lambda k: {reject})) > 0 then r.kept
    else list_append(r.kept, {{'det_id': o.det_id, 'class_name': o.class_name, 'confidence': o.confidence, 'x1': o.x1, 'y1': o.y1, 'x2': o.x2, 'y2': o.y2}}) end
  from r join o on o.video_id = r.video_id and o.rn = r.rn + 1),
last as (select video_id, arg_max(kept, rn) kept from r group by video_id), u as (select video_id, unnest(kept) k from last)
select video_id, k.det_id det_id from u"""


_IOU = iou_sql("k.", "o.")


@query(_fold_sql("where confidence >= 0.6", "confidence desc", f"{_IOU} > 0.45 or (k.class_name = o.class_name and {distance_sql('k.', 'o.')} < 50)"))
def dedupe_confidence(spark, sf):
    return dedupe.dedupe_by_confidence(detections(spark, sf), 0.6, 0.45, keys=["video_id"]).select("video_id", "det_id")


@query(_fold_sql("", "confidence desc", f"k.class_name = o.class_name and {_IOU} > 0.45"))
def nms_class_aware(spark, sf):
    return dedupe.nms_by_class(detections(spark, sf), keys=["video_id"]).select("video_id", "det_id")


@query(_fold_sql("", "(x2-x1)*(y2-y1) desc", f"k.class_name = o.class_name and {inter_sql('k.', 'o.')} / greatest((o.x2-o.x1)*(o.y2-o.y1), 0.000001) > 0.8"))
def containment_filter(spark, sf):
    return dedupe.drop_contained(detections(spark, sf), keys=["video_id"]).select("video_id", "det_id")


@query(_fold_sql("", "confidence desc", f"{_IOU} >= 0.5"))
def nms_classic(spark, sf):
    return dedupe.nms(detections(spark, sf), keys=["video_id"]).select("video_id", "det_id")


@query(_fold_sql("", "confidence desc", f"{_IOU} >= 0.5").replace("l_orderkey video_id", "l_orderkey * 4 + l_linenumber % 4 video_id").replace("partition by l_orderkey", "partition by l_orderkey * 4 + l_linenumber % 4").replace("select video_id, k.det_id det_id from u", "select video_id // 4 video_id, video_id % 4 frame_idx, k.det_id det_id from u"))
def nms_by_frame(spark, sf):
    """Clips of four frames each: boxes compete within a frame, which is what the operators do unless other keys are named."""
    frame = F.col("l_linenumber").cast("long") % 4
    rank = F.row_number().over(Window.partitionBy("l_orderkey", frame).orderBy("l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_quantity"))
    p, s = F.col("l_partkey") * 13 % 200, F.col("l_suppkey") * 17 % 200
    d = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("video_id"), frame.alias("frame_idx"), rank.cast("long").alias("det_id"), F.col("l_returnflag").alias("class_name"), (F.lit(1.0) - 5 * F.col("l_discount")).alias("confidence"),
        p.cast("double").alias("x1"), s.cast("double").alias("y1"), (p + 60 + F.col("l_linenumber") * 20).cast("double").alias("x2"), (s + 60 + F.col("l_quantity")).cast("double").alias("y2"),
    )
    return dedupe.nms(d).select("video_id", "frame_idx", "det_id")


@query(f"with {DET}, {TRACKS} select video_id, 'object' origin, class_name, count(*) n from det group by all union all select video_id, 'person', class_name, count(*) from tracks where has_box group by all")
def detection_union(spark, sf):
    objects = detections(spark, sf).select("video_id", F.lit("object").alias("origin"), "class_name", "confidence", *BOX)
    persons = tracks(spark, sf).where("has_box").select("video_id", F.lit("person").alias("origin"), "class_name", *BOX)
    return objects.unionByName(persons, allowMissingColumns=True).groupBy("video_id", "origin", "class_name").agg(F.count("*").alias("n"))


@query(f"with {DET} select video_id, det_id, case when lower(class_name) like '%person%' then 200 when lower(class_name) like '%humanoid%' or lower(class_name) like '%robot%' then 201 else 202 end::int class_id, coalesce(n, 999)::int known_id from det left join (select 'A' class_name, 100 n union all select 'N', 101) m using (class_name)")
def class_id_map(spark, sf):
    known = F.broadcast(spark.createDataFrame([("A", 100), ("N", 101)], "class_name string, n int"))
    d = detections(spark, sf).join(known, "class_name", "left")
    return d.select("video_id", "det_id", X.class_number(F.col("class_name")).alias("class_id"), F.coalesce("n", F.lit(999)).alias("known_id"))


# ---- tracks

SEEN = f"{TRACKS}, seen as (select * from tracks where has_box)"
DENSE = f"""{SEEN}, sp as (select video_id, min(frame_idx) lo, max(frame_idx) hi from seen group by 1), ids as (select distinct video_id, track_id from seen),
grid as (select video_id, track_id, unnest(range(lo, hi + 1)) frame_idx from ids join sp using (video_id)),
dense as (select g.*, s.x1, s.y1, s.x2, s.y2 from grid g left join seen s using (video_id, track_id, frame_idx))"""


@query(f"with {DENSE} select * from dense")
def track_densify(spark, sf):
    return K.densify(tracks(spark, sf).where("has_box"))


NESTED = f"""{DENSE}, nm as (select video_id, track_id, min(class_name) class_name from seen group by all),
n as (select video_id, class_name || '_' || track_id as "key", class_name, track_id, frame_idx, round(x1/1920, 4) x1, round(y1/1080, 4) y1, round(x2/1920, 4) x2, round(y2/1080, 4) y2 from dense join nm using (video_id, track_id))"""


@query(f"""with {NESTED} select video_id, count(*) n_rows, count(x1) n_boxes, count(distinct "key") n_tracks from n group by 1""")
def track_nest(spark, sf):
    """Track documents, measured through their own JSON."""
    docs = K.nest(tracks(spark, sf).where("has_box"), 1920, 1080)
    return K.unnest(docs).groupBy("video_id").agg(F.count("*").alias("n_rows"), F.count("x1").alias("n_boxes"), F.count_distinct("key").alias("n_tracks"))


@query(f"""with {NESTED}, lo as (select video_id, min(frame_idx) lo from dense group by 1) select n.video_id, "key", class_name, track_id, frame_idx - lo frame_idx, x1, y1, x2, y2 from n join lo using (video_id)""")
def track_unnest(spark, sf):
    return K.unnest(K.nest(tracks(spark, sf).where("has_box"), 1920, 1080))


@query(f"""with {DENSE} select video_id, frame_idx, count(*) n_people, count(x1) n_present, string_agg(track_id::varchar, ',' order by track_id) filter (x1 is not null) present from dense group by 1, 2""")
def person_pivot(spark, sf):
    """The frame-major form: a map of person to box for every frame of the range."""
    people = K.by_frame(tracks(spark, sf).where("has_box"))
    here = F.map_filter("people", lambda k, v: v.isNotNull())
    names = F.array_join(F.array_sort(F.map_keys(here)).cast("array<string>"), ",")
    return people.select("video_id", "frame_idx", F.size("people").cast("long").alias("n_people"), F.size(here).cast("long").alias("n_present"), F.nullif(names, F.lit("")).alias("present"))


@query(f"with {DENSE} select * from dense")
def person_unpivot(spark, sf):
    """Frame-major and back: what comes out is the densified input."""
    return K.by_track(K.by_frame(tracks(spark, sf).where("has_box")))


@query(f"with {DENSE} select video_id, max(frame_idx) - min(frame_idx) + 1 n_frames from dense group by 1")
def document_frames(spark, sf):
    return K.document_frames(K.nest(tracks(spark, sf).where("has_box"), 1920, 1080))


@query(f"""with {DENSE} select d.video_id, d.track_id, d.frame_idx, case when d.frame_idx = 0 then t.gx1 when (d.x2-d.x1)*(d.y2-d.y1) > 50 then d.x1 end x1, case when d.frame_idx = 0 then t.gy1 when (d.x2-d.x1)*(d.y2-d.y1) > 50 then d.y1 end y1,
case when d.frame_idx = 0 then t.gx2 when (d.x2-d.x1)*(d.y2-d.y1) > 50 then d.x2 end x2, case when d.frame_idx = 0 then t.gy2 when (d.x2-d.x1)*(d.y2-d.y1) > 50 then d.y2 end y2 from dense d left join (select * from tracks where frame_idx = 0) t using (video_id, track_id)""")
def seed_override(spark, sf):
    t = tracks(spark, sf)
    seeds = t.where("frame_idx = 0").select("video_id", "track_id", *[F.col("g" + c).alias(c) for c in BOX])
    return K.seed_override(K.densify(t.where("has_box")), seeds, ["video_id", "track_id"])


_DIM = "{{'p': r.{d}.p + r.{d}.v + k1 * (z.{d} - r.{d}.p - r.{d}.v), 'v': r.{d}.v + k2 * (z.{d} - r.{d}.p - r.{d}.v)}}"
_STAY = "{{'p': r.{d}.p + r.{d}.v, 'v': r.{d}.v}}"


def _kalman_sql(source: str = "tracks", key: str = "track_id") -> str:
    dims = ("cx", "cy", "w", "h")
    a, b, c = "(r.a + 2 * r.b + r.c + 1)", "(r.b + r.c)", "(r.c + 1)"
    k1, k2 = f"({a} / ({a} + 10))", f"({b} / ({a} + 10))"
    new = ", ".join(f"case when z.{d} is null then {_STAY.format(d=d)} else {_DIM.format(d=d).replace('k1', k1).replace('k2', k2)} end {d}" for d in dims)
    zero = ", ".join(f"{{'p': 0.0::double, 'v': 0.0::double}} {d}" for d in dims)
    pick = lambda d: f"{d}.p"
    out = {"x1": f"{pick('cx')} - {pick('w')} / 2", "y1": f"{pick('cy')} - {pick('h')} / 2", "x2": f"{pick('cx')} + {pick('w')} / 2", "y2": f"{pick('cy')} + {pick('h')} / 2"}
    return f"""with recursive {TRACKS}, parts as (select track_id * 5 + i track_id, frame_idx, {", ".join(f"case when (k + i) % 7 <> 0 then {n} + 9 * i end {n}" for n in BOX)} from tracks, (select unnest(range(5)) i)), z as (select track_id, frame_idx, (x1+x2)/2 cx, (y1+y2)/2 cy, x2-x1 w, y2-y1 h from {source}),
r as (select distinct track_id, -1::bigint frame_idx, {zero}, 1000.0::double a, 0.0::double b, 1000.0::double c, false seen from {source}
  union all select r.track_id, z.frame_idx, {new}, case when z.cx is null then {a} else {a} * (1 - {k1}) end, case when z.cx is null then {b} else {b} * (1 - {k1}) end,
  case when z.cx is null then {c} else {c} - {k2} * {b} end, z.cx is not null from r join z on z.track_id = r.track_id and z.frame_idx = r.frame_idx + 1)
select {key}, frame_idx, {", ".join(f"case when seen then round({e}, 4) end {n}" for n, e in out.items())} from r where frame_idx >= 0"""


@query(_kalman_sql())
def kalman_smooth(spark, sf):
    return kalman.smooth_tracks(tracks(spark, sf), ["track_id"]).select("track_id", "frame_idx", *rounded(BOX, 4))


@query(_kalman_sql("parts", "track_id // 5 track_id, track_id % 5 part"))
def kalman_parts(spark, sf):
    """A smoother for each of five parts (person, two hands, two held objects) of a track."""
    part = F.explode(F.array(*[F.lit(i).cast("long") for i in range(5)])).alias("part")
    rows = tracks(spark, sf).select("track_id", "frame_idx", "k", *BOX, part)
    boxes = [F.when((F.col("k") + F.col("part")) % 7 != 0, F.col(n) + 9 * F.col("part")).alias(n) for n in BOX]
    smooth = kalman.smooth_tracks(rows.select("track_id", "part", "frame_idx", *boxes), ["track_id", "part"])
    return smooth.select("track_id", "part", "frame_idx", *rounded(BOX, 4))


# ---- windows

WINDOWS = f"""{TRACKS}, n as (select video_id, track_id, max(frame_idx) + 1 n from tracks group by all), win as (select video_id, track_id, unnest(range(0, n - 29, 15)) start_f from n where n >= 30),
smp as (select video_id, track_id, start_f, i sample, start_f + i * 29 // 14 frame_idx from win, (select unnest(range(15)) i)),
sb as (select s.*, t.x1, t.y1, t.x2, t.y2 from smp s left join tracks t using (video_id, track_id, frame_idx)),
pres as (select video_id, track_id, start_f, count(*) filter (x1 is null) n_missing from sb group by all having count(*) filter (x1 is null) <= 7.5)"""
KEYS = ["video_id", "track_id"]


@query(f"with {WINDOWS} select video_id, track_id, start_f::int start_f, (start_f + 29)::int end_f from win")
def sliding_windows(spark, sf):
    return K.sliding_windows(tracks(spark, sf), KEYS)


@query(f"with {WINDOWS} select video_id, track_id, start_f::int start_f, sample::int sample, frame_idx, x1, y1, x2, y2 from sb")
def window_samples(spark, sf):
    return K.window_samples(tracks(spark, sf), KEYS)


@query(f"with {WINDOWS} select video_id, track_id, start_f::int start_f, n_missing from pres")
def window_presence(spark, sf):
    return K.present_windows(K.window_samples(tracks(spark, sf), KEYS), KEYS)


@query(f"""with {WINDOWS}, ot as (select p.video_id, p.track_id, p.start_f, t.track_id other from pres p join smp using (video_id, track_id, start_f) join tracks t on t.video_id = p.video_id and t.frame_idx = smp.frame_idx and t.track_id <> p.track_id and t.x1 is not null group by all)
select video_id, track_id, start_f::int start_f, count(*) n_objects from ot group by all""")
def window_objects(spark, sf):
    """Other tracks of the clip with a box in a sampled frame of the window."""
    t = tracks(spark, sf)
    sampled = K.window_samples(t, KEYS)
    windows = K.present_windows(sampled, KEYS).select(*KEYS, "start_f")
    frames = sampled.select(*KEYS, "start_f", "frame_idx").join(windows, [*KEYS, "start_f"])
    others = t.where("x1 is not null").select("video_id", "frame_idx", F.col("track_id").alias("other"))
    found = frames.join(others, ["video_id", "frame_idx"]).where("other <> track_id")
    return found.groupBy(*KEYS, "start_f").agg(F.count_distinct("other").alias("n_objects"))


@query(f"""with {WINDOWS.replace(TRACKS, CROWDED)} select distinct p.video_id, p.track_id, p.start_f::int start_f, t.class_name || '_' || t.track_id other from pres p join smp using (video_id, track_id, start_f)
join tracks t on t.video_id = p.video_id and t.frame_idx = smp.frame_idx and t.x1 is not null and t.class_name <> 'view'""")
def relevant_objects(spark, sf):
    """What has a box in a sampled frame of a window and is no person (views stand for persons)."""
    t = crowded(spark, sf)
    sampled = K.present_samples(K.window_samples(t, KEYS), KEYS)
    boxes = t.select("video_id", "frame_idx", "x1", F.concat_ws("_", "class_name", "track_id").alias("key"))
    return K.relevant_objects(sampled, boxes, "video_id", KEYS, "view_")


@query(f"with {TRACKS} select video_id, track_id, frame_idx // 30 chunk, count(*) n, count(x1) n_boxes from tracks group by all")
def tumbling_chunks(spark, sf):
    t = tracks(spark, sf).withColumn("chunk", K.chunk_of(F.col("frame_idx")))
    return t.groupBy(*KEYS, "chunk").agg(F.count("*").alias("n"), F.count("x1").alias("n_boxes"))


# ---- clips

@query("""with s as (select o_orderkey clip, o_totalprice / 10000 d from orders), g as (select *, ceil(d / 10)::int b from s where d > 0),
p as (select clip, d, unnest(case when d > 10 then range(1, b + 1) else [null::bigint] end) part from g)
select clip, coalesce(part, 0)::int part, coalesce((part - 1) * 10.0::double, 0) start_sec, round(case when part is null then d else least(10.0, d - (part - 1) * 10.0::double) end, 6) length_sec from p""")
def scene_partition(spark, sf):
    scenes = table(spark, sf, "orders").select(F.col("o_orderkey").alias("clip"), (F.col("o_totalprice") / 10000).alias("duration"))
    return K.partition_scenes(scenes, ["clip"]).select("clip", F.coalesce("part", F.lit(0)).alias("part"), "start_sec", *rounded(["length_sec"]))


@query("select c_custkey, cast(ntile(7) over (order by c_custkey) - 1 as bigint) chunk from customer")
def even_chunks(spark, sf):
    return K.even_chunks(table(spark, sf, "customer").select("c_custkey"), ["c_custkey"], 7)


@query("""with s as (select o_orderkey clip, o_totalprice / 10000 st, case when o_orderkey % 3 = 0 then null else (o_orderkey % 4 + 1)::int end part, case when o_orderkey % 2 = 0 then 30.0::double else 29.97::double end fps from orders)
select clip, cast(round_even((case when clip % 5 = 0 then 0 else st end + coalesce((part - 1) * 10.0::double, 0)) * fps, 0) as bigint) frame_offset from s""")
def clip_offset(spark, sf):
    k = F.col("o_orderkey")
    start = F.when(k % 5 != 0, F.col("o_totalprice") / 10000)
    part = F.when(k % 3 != 0, (k % 4 + 1).cast("int"))
    fps = F.when(k % 2 == 0, 30.0).otherwise(29.97)
    return table(spark, sf, "orders").select(k.alias("clip"), K.clip_offset_frames(start, part, fps).alias("frame_offset"))


@query(f"""with {TRACKS}, l as (select video_id, track_id, max(frame_idx) + 1 n from tracks group by all)
select video_id, track_id, n n_frames, coalesce(sum(n) over (partition by video_id order by track_id rows between unbounded preceding and 1 preceding), 0)::bigint "offset" from l""")
def scene_offsets(spark, sf):
    lengths = tracks(spark, sf).groupBy(*KEYS).agg((F.max("frame_idx") + 1).alias("n_frames"))
    return K.running_offset(lengths, "video_id", "track_id", "n_frames")


# ---- names, keys and labels

NAME = "'v' || p_partkey || '_scene' || (p_partkey % 40) || case when p_partkey % 2 = 0 then '_part' || (p_size % 12) else '' end"


def _names(spark, sf):
    k = F.col("p_partkey")
    name = F.concat(F.lit("v"), k, F.lit("_scene"), k % 40, F.when(k % 2 == 0, F.concat(F.lit("_part"), F.col("p_size") % 12)).otherwise(""))
    return table(spark, sf, "part").select("p_partkey", "p_name", "p_type", name.alias("clip"))


@query(f"""with n as (select p_partkey, {NAME} clip from part) select p_partkey, split_part(clip, '_', 1) video, nullif(regexp_extract(clip, 'scene(\\d+)', 1), '')::int scene, coalesce(nullif(regexp_extract(clip, 'scene\\d+_part(\\d+)', 1), '')::int, -1) part,
regexp_extract(clip || '_person_' || p_partkey || '_actions.json', '(.*)_person_(\\d+)_actions\\.json', 1) action_clip from n""")
def clip_name_parse(spark, sf):
    scene, part = X.clip_parts(F.col("clip"))
    file = F.concat("clip", F.lit("_person_"), "p_partkey", F.lit("_actions.json"))
    return _names(spark, sf).select("p_partkey", X.video_of(F.col("clip")).alias("video"), scene.alias("scene"), F.coalesce(part, F.lit(-1)).alias("part"), X.action_file(file)[0].alias("action_clip"))


@query("select l_orderkey, l_linenumber, count(*) n, max(l_partkey % 500)::int start_f, max(l_partkey % 500 + 29)::int end_f from lineitem group by all")
def window_key_parse(spark, sf):
    key = F.format_string("frames_%d_to_%d", F.col("l_partkey") % 500, F.col("l_partkey") % 500 + 29)
    start, end = X.window_range(key)
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", start.alias("s"), end.alias("e"))
    return rows.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.max("s").alias("start_f"), F.max("e").alias("end_f"))


_Z = "case when {0} = 0 then '0000' else lpad(length(({0})::varchar)::varchar, 4, '0') || ({0})::varchar end"


@query(f"""select p_partkey, 'v' || {_Z.format("p_partkey")} || '_scene' || {_Z.format("p_partkey % 40")} || case when p_partkey % 2 = 0 then '_part' || {_Z.format("p_size % 12")} else '' end || '/' || {_Z.format("p_partkey * 7919 % 2000003")} || '.jpg' sort_key from part""")
def natural_sort(spark, sf):
    """Names of frames: numbers of any length, those of ten digits with leading zeros."""
    frame = F.concat("clip", F.lit("/"), F.lpad((F.col("p_partkey") * 7919 % 2000003).cast("string"), 10, "0"), F.lit(".jpg"))
    return _names(spark, sf).select("p_partkey", X.natural_key(frame).alias("sort_key"))


@query("""with r as (select event_id, event_type, cast(json_extract_string(props, '$.k') as bigint) k from events)
select event_id, 'robot ' || event_type as label, 0.0 + k * 1.92 x1, round(k * 1.08::double, 6) y1 from (select event_id, event_type, k from r where event_id % 3 <> 0)""".replace("0.0 + k * 1.92 x1", "round(k * 1.92::double, 6) x1"))
def vlm_json_extract(spark, sf):
    """Replies of a grounding model, some cut short, turned into labelled pixel boxes."""
    k = F.get_json_object("props", "$.k").cast("long")
    item = F.concat(F.lit('sure: [{"label": " Robot '), "event_type", F.lit(' ", "bbox_2d": ['), k, F.lit(","), k, F.lit(",900,900]}"))
    reply = F.when(F.col("event_id") % 3 == 0, item).when(F.col("event_id") % 3 == 1, F.concat(item, F.lit("] ok"))).otherwise(F.concat(item, F.lit(', {"label": "arm"}] ok')))
    rows = table(spark, sf, "events").select("event_id", F.explode(X.replied_boxes(reply)).alias("r"))
    b = G.from_grid(F.col("r.bbox_2d"), 1920, 1080)
    return rows.select("event_id", F.col("r.label").alias("label"), F.round(b.x1, 6).alias("x1"), F.round(b.y1, 6).alias("y1"))


@query("select event_id, case when event_type in ('click', 'view', 'purchase') then event_type else 'unknown' end as label from events")
def label_validate(spark, sf):
    return table(spark, sf, "events").select("event_id", X.checked_label(F.col("event_type"), ["click", "view", "purchase"]).alias("label"))


@query(f"with {TRACKS} select class_name, cast(row_number() over (order by min(frame_idx * 1000000 + event_id)) as bigint) label_id from tracks group by 1")
def label_dictionary(spark, sf):
    return K.first_seen_ids(tracks(spark, sf), "class_name", ["frame_idx", "event_id"])


@query("""with h as (select distinct p_name, left(p_type, len) frag from part, (select unnest([1, 2, 5, 7]) len) union select distinct p_name, substring(p_name, 2, l) from part, (select unnest([1, 4, 6]) l) where p_partkey % 3 = 0),
f as (select distinct frag from h where frag <> ''), n as (select distinct p_name from part), m as (select p_name, frag, row_number() over (partition by p_name order by length(frag) desc, frag desc) r from n join f on contains(p_name, frag))
select n.p_name, m.frag from n left join m on m.p_name = n.p_name and m.r = 1""")
def longest_substring_match(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", "p_name", "p_type")
    types = parts.select(F.explode(F.array(*[F.substring("p_type", 1, n) for n in (1, 2, 5, 7)])).alias("frag"))
    inner = parts.where("p_partkey % 3 = 0").select(F.explode(F.array(*[F.substring("p_name", 2, n) for n in (1, 4, 6)])).alias("frag"))
    return names.longest_contained(parts, types.union(inner), "p_name", "frag")


# ---- actions

ACTIONS = f"""{WINDOWS}, wl as (select w.video_id, w.track_id, w.start_f, w.start_f + 29 end_f, t.class_name a, u.class_name b from pres w join tracks t on t.video_id = w.video_id and t.track_id = w.track_id and t.frame_idx = w.start_f join tracks u on u.video_id = w.video_id and u.track_id = w.track_id and u.frame_idx = w.start_f + 29),
rel as (select video_id, track_id, frame_idx begin_f, frame_idx + 20 stop_f, class_name as label from tracks where frame_idx % 10 = 0),
ov as (select video_id, track_id, start_f, end_f, list_distinct([a, b]) actions, coalesce((select list_sort(list_distinct(list(label))) from rel r where r.video_id = w.video_id and r.track_id = w.track_id and greatest(w.start_f, r.begin_f) < least(w.end_f, r.stop_f)), []) truth from wl w)"""


def _actions(spark, sf):
    t = tracks(spark, sf)
    windows = K.present_windows(K.window_samples(t, KEYS), KEYS).select(*KEYS, "start_f", (F.col("start_f") + 29).alias("end_f"))
    at = lambda frame, name: t.select(*KEYS, F.col("frame_idx").cast("int").alias(frame), F.col("class_name").alias(name))
    both = windows.join(at("start_f", "a"), [*KEYS, "start_f"]).join(at("end_f", "b"), [*KEYS, "end_f"])
    return both.select(*KEYS, "start_f", "end_f", F.array_distinct(F.array("a", "b")).alias("actions"))


def _overlaps(spark, sf):
    t = tracks(spark, sf)
    relations = t.where("frame_idx % 10 = 0").select(*KEYS, F.col("frame_idx").alias("begin_f"), (F.col("frame_idx") + 20).alias("stop_f"), F.col("class_name").alias("label"))
    return evaluate.set_counts(evaluate.overlapping_actions(_actions(spark, sf), relations, KEYS))


@query(f"with {ACTIONS} select video_id, track_id, start_f::int start_f, array_to_string(list_sort(actions), ',') actions, array_to_string(truth, ',') truth from ov")
def action_overlap(spark, sf):
    return _overlaps(spark, sf).select(*KEYS, "start_f", F.array_join(F.array_sort("actions"), ",").alias("actions"), F.array_join("truth", ",").alias("truth"))


@query(f"""with {ACTIONS}, c as (select sum(len(list_intersect(actions, truth)))::bigint tp, sum(len(actions) - len(list_intersect(actions, truth)))::bigint fp, sum(len(truth) - len(list_intersect(actions, truth)))::bigint fn from ov)
select tp, fp, fn, round(tp / (tp + fp), 6) "precision", round(tp / (tp + fn), 6) recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 6) f1 from c""")
def action_prf(spark, sf):
    return evaluate.precision_recall(_overlaps(spark, sf)).select("tp", "fp", "fn", *rounded(["precision", "recall", "f1"]))


@query(f"""with {ACTIONS}, x as (select video_id, track_id, start_f, end_f, unnest(actions[1:2]) as label, generate_subscripts(actions[1:2], 1) pos from wl, (select 1) q(one), lateral (select case when a = b then [a] else [a, b] end actions)),
d as (select label, row_number() over (order by min((video_id * 1000000000 + track_id * 10000 + start_f) * 10 + pos)) label_id from x group by 1)
select x.video_id, printf('%.4f', round((start_f + (end_f - start_f) // 2) / 30, 4)) "timestamp", printf('%.4f', round(t.x1 / 1920, 4)) x1, printf('%.4f', round(t.y1 / 1080, 4)) y1, printf('%.4f', round(t.x2 / 1920, 4)) x2, printf('%.4f', round(t.y2 / 1080, 4)) y2, label_id action_id, x.track_id person_id
from x join d using (label) join tracks t on t.video_id = x.video_id and t.track_id = x.track_id and t.frame_idx = start_f + (end_f - start_f) // 2 where t.x1 is not null""")
def ava_rows(spark, sf):
    """Rows of the exported label file: the first two actions of each window at its key frame."""
    from boxframe.sources.writers import fixed

    t = tracks(spark, sf)
    top = _actions(spark, sf).select(*KEYS, "start_f", "end_f", F.posexplode(F.slice("actions", 1, 2)).alias("pos", "label"))
    ids = K.first_seen_ids(top, "label", ["video_id", "track_id", "start_f", "pos"])
    mid = K.keyframe(F.col("start_f"), F.col("end_f"), F.col("end_f")).cast("long")
    rows = top.withColumn("frame_idx", mid).join(ids, "label").join(t.where("x1 is not null").select(*KEYS, "frame_idx", *BOX), [*KEYS, "frame_idx"])
    b = G.normalised(G.box(), 1920, 1080)
    return rows.select("video_id", fixed(F.col("frame_idx") / 30).alias("timestamp"), *[fixed(c).alias(n) for n, c in zip(BOX, b)], F.col("label_id").alias("action_id"), F.col("track_id").alias("person_id"))


# ---- cameras, gaps, status

@query("""with p as (select label, vec_id, embedding::double[] m, lag(embedding::double[]) over (partition by label order by vec_id) b from embeddings),
s as (select label, sqrt(pow(m[4]-b[4],2)+pow(m[8]-b[8],2)+pow(m[12]-b[12],2)) t, sqrt(pow(m[1]-b[1],2)+pow(m[2]-b[2],2)+pow(m[3]-b[3],2)+pow(m[5]-b[5],2)+pow(m[6]-b[6],2)+pow(m[7]-b[7],2)+pow(m[9]-b[9],2)+pow(m[10]-b[10],2)+pow(m[11]-b[11],2)) r from p)
select label, round(coalesce(avg(t) + avg(r) + 0.5 * max(t) + 0.5 * max(r), 0), 4) motion, coalesce(avg(t) + avg(r) + 0.5 * max(t) + 0.5 * max(r), 0) > 0.1 moving from s group by 1""")
def camera_motion(spark, sf):
    poses = table(spark, sf, "embeddings").select("label", "vec_id", F.slice("embedding", 1, 12).alias("m"))
    return evaluate.motion_scores(poses, "label", "vec_id", "m").select("label", F.round("motion", 4).alias("motion"), "moving")


@query("""with l as (select distinct l_orderkey, l_linenumber n from lineitem), r as (select *, row_number() over (partition by l_orderkey order by n) expected from l)
select l_orderkey, n::int number, (n - expected)::int gap from r where n <> expected""")
def frame_gaps(spark, sf):
    """Numbers that are not where an unbroken run would have them (all after a gap are reported)."""
    rows = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("number")).distinct()
    gap = F.col("number") - F.row_number().over(Window.partitionBy("l_orderkey").orderBy("number"))
    return rows.withColumn("gap", gap.cast("int")).where("gap <> 0")


@query("""select o_custkey, arg_min(k, p) kind from (select o_custkey, k, case k when 'camera_motion' then '0' when 'generic' then '1' else '2' || k end p from (select o_custkey, case o_orderstatus when 'F' then 'camera_motion' when 'O' then 'generic' else 'too_long' end k from orders)) group by 1""")
def status_priority(spark, sf):
    kind = F.when(F.col("o_orderstatus") == "F", "camera_motion").when(F.col("o_orderstatus") == "O", "generic").otherwise("too_long")
    return status.merge_markers(table(spark, sf, "orders").select("o_custkey", kind.alias("kind")), "o_custkey")


@query("select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'F') and c_custkey not in (select o_custkey from orders where o_totalprice > 400000)")
def pending_work(spark, sf):
    orders = table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return status.pending(table(spark, sf, "customer").select("c_custkey"), orders.where("o_orderstatus = 'F'"), orders.where("o_totalprice > 400000"), "c_custkey")


@query("select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 300000)")
def missing_names(spark, sf):
    done = table(spark, sf, "orders").where("o_totalprice > 300000").withColumnRenamed("o_custkey", "c_custkey")
    return status.missing(table(spark, sf, "customer"), done, "c_custkey")


@query("select c_custkey from customer where c_custkey in (select o_custkey from orders where o_totalprice > 300000)")
def included_names(spark, sf):
    names = table(spark, sf, "orders").where("o_totalprice > 300000").withColumnRenamed("o_custkey", "c_custkey")
    return status.included(table(spark, sf, "customer").select("c_custkey"), names, "c_custkey")


CLIPS = """clips as (select o_orderkey clip, o_orderkey % 400 n_frames, case when o_orderkey % 7 <> 0 then (o_orderkey % 100) / 500::double end motion from orders),
marked as (select clip, case when n_frames > 300 then 'too_long: ' || n_frames || ' frames of 300' when n_frames >= 2 and coalesce(motion > 0.1, false) then 'camera_motion: ' || printf('%.3f', motion) end reason from clips)"""


def _skips(spark, sf):
    k = F.col("o_orderkey")
    motion = F.when(k % 7 != 0, (k % 100) / F.lit(500.0))
    return status.skip_reasons(table(spark, sf, "orders").select(k.alias("clip"), (k % 400).alias("n_frames"), motion.alias("motion")))


@query(f"with {CLIPS} select clip, reason from marked")
def skip_reasons(spark, sf):
    return _skips(spark, sf).select("clip", "reason")


@query(f"with {CLIPS} select count(*) total, count(*) - count(reason) processed, count(reason) skipped, count(*) filter (reason like 'cam%') camera_motion, count(*) filter (reason like 'too%') too_long from marked")
def run_summary(spark, sf):
    clips = _skips(spark, sf)
    return status.summary(clips, status.markers(clips, "clip"), "clip")


@query("""select o_orderkey clip, case when o_orderkey % 5 <> 0 then o_totalprice / 1000 else 0 end duration, round(case when o_orderkey % 3 = 0 then 30000 / 1001::double when o_orderkey % 3 = 1 then 25 else (o_orderkey % 400) / 5.0::double end, 6) fps, o_orderkey % 4 = 0 has_video from orders""")
def clip_facts(spark, sf):
    """Probes as text: rates as quotients or broken, durations absent, banners with and without video."""
    k = F.col("o_orderkey")
    rate = F.when(k % 3 == 0, "30000/1001").when(k % 3 == 1, "25").otherwise("0/0")
    banner = F.when(k % 4 == 0, "Stream #0:0 Video: h264").when(k % 4 == 1, "Stream #0:0 Audio: aac").when(k % 4 == 2, "no such file")
    duration = F.when(k % 5 != 0, (F.col("o_totalprice") / 1000).cast("string")).otherwise("N/A")
    probes = table(spark, sf, "orders").select(k.alias("clip"), duration.alias("duration"), rate.alias("rate"), banner.alias("banner"), (k % 400).alias("n_frames"))
    return readers.clip_facts(probes).select("clip", "duration", F.round("fps", 6).alias("fps"), "has_video")


@query("select '/d/' || p_size folder, min('/d/' || p_size || '/' || p_name || p_partkey || '.json') path from part group by 1")
def first_files(spark, sf):
    path = F.concat(F.lit("/d/"), "p_size", F.lit("/"), "p_name", "p_partkey", F.lit(".json"))
    return readers.first_files(table(spark, sf, "part").select(path.alias("path")))


@query("select event_id from events where event_type like '%arm%' or event_type like '%robot%' or event_id % 3 = 0 or event_id % 3 = 1")
def tool_filter(spark, sf):
    name = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("robot_"), "event_type")).when(F.col("event_id") % 3 == 1, F.concat("event_type", F.lit(" arm"))).otherwise(F.col("event_type"))
    return table(spark, sf, "events").where(X.is_tool(name)).select("event_id")


# ---- assignment

def _chunked(spark, sf):
    """Detections in each chunk's first frame."""
    return tracks(spark, sf).where("has_box and frame_idx % 30 = 0").select("video_id", K.chunk_of(F.col("frame_idx")).alias("chunk"), F.col("track_id").alias("det_id"), "class_name", *BOX)


def _ten(spark, sf):
    """Clips of ten tracks each, so that a table of more tracks has more clips rather than larger ones."""
    return _chunked(spark, sf).withColumn("video_id", F.floor(F.col("det_id") / 10).cast("long"))


@query()
def assign_hungarian(spark, sf):
    """Boxes of the last frame of a chunk against those of the next chunk's first frame."""
    t = tracks(spark, sf).where("has_box").withColumn("video_id", F.floor(F.col("track_id") / 10).cast("long"))
    before = t.where("frame_idx % 30 = 29").select("video_id", (K.chunk_of(F.col("frame_idx")) + 1).alias("chunk"), "track_id", *BOX)
    return assign.assign(before, _ten(spark, sf).select("video_id", "chunk", "det_id", *BOX), ["video_id", "chunk"])


@query()
def stitch_tracks(spark, sf):
    return assign.stitch(_ten(spark, sf), "video_id")


@query(f"with {TRACKS} select video_id, frame_idx // 30 chunk, track_id det_id, cast(row_number() over (partition by video_id order by frame_idx // 30, track_id) + 999 as bigint) track_id from tracks where has_box and frame_idx % 30 = 0")
def fresh_ids(spark, sf):
    return assign.fresh_ids(_chunked(spark, sf), "video_id").select("video_id", "chunk", "det_id", "track_id")


@query(f"""with {TRACKS}, d as (select track_id clip, frame_idx // 30 chunk, 1000 + row_number() over (partition by track_id order by frame_idx) - 1 id from tracks where has_box and frame_idx % 30 = 0),
c as (select distinct track_id clip, frame_idx // 30 chunk from tracks)
select c.clip, c.chunk, max(d.chunk) since, arg_max(id, d.chunk) track_id from c join d on d.clip = c.clip and d.chunk <= c.chunk group by all""")
def active_ids(spark, sf):
    """Every track is a clip of its own; a chunk whose first frame has no box keeps the ids before."""
    dets = _chunked(spark, sf).withColumn("clip", F.col("det_id"))
    chunks = tracks(spark, sf).select(F.col("track_id").alias("clip"), K.chunk_of(F.col("frame_idx")).alias("chunk")).distinct()
    return assign.active_ids(assign.fresh_ids(dets, "clip"), chunks, "clip")


# ---- streams

@query("""select to_timestamp(floor(epoch(ts) / 43200) * 43200 - i * 43200)::timestamp::varchar as "start", to_timestamp(floor(epoch(ts) / 43200) * 43200 - i * 43200 + 86400)::timestamp::varchar as "end", event_type, count(*) n from events, (select unnest([0, 1]) i) group by all""")
def stream_sliding_actions(spark, sf):
    out = streaming.run_to_table(streaming.sliding_counts(streaming.event_stream(spark, sf)), "complete")
    return out.select(F.col("start").cast("timestamp_ntz").cast("string").alias("start"), F.col("end").cast("timestamp_ntz").cast("string").alias("end"), "event_type", "n")


@query("select to_timestamp(floor(epoch(ts) / 3600) * 3600)::timestamp::varchar as \"start\", count(*) n from events group by 1")
def stream_tumbling(spark, sf):
    out = streaming.run_to_table(streaming.tumbling_counts(streaming.event_stream(spark, sf), "1 hour"), "complete")
    return out.select(F.col("start").cast("timestamp_ntz").cast("string").alias("start"), "n")


@query("select distinct user_id, event_type from events")
def stream_once(spark, sf):
    """Each piece of work (user and type) is taken once, however often it arrives."""
    out = streaming.run_to_table(streaming.once(streaming.event_stream(spark, sf), ["user_id", "event_type"], "365 days"), "append")
    return out.select("user_id", "event_type")
