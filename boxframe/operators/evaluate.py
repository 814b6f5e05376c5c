"""Scores of tracks and actions against ground truth."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxframe.functions.geometry import box, center_distance, iou

STEP = 0.05
INFINITE = float("inf")


def frame_scores(frames: DataFrame, best_iou: Column, best_ce: Column, n_preds: Column, visible: Column, hidden_with_preds: str = "miss") -> DataFrame:
    """iou and ce of each frame. Visible without predictions: 0 and infinite. Hidden without
    predictions: 1 and 0; hidden with some: a miss, or skipped (`hidden_with_preds`)."""
    score = F.when(visible, F.when(n_preds > 0, best_iou).otherwise(0.0)).otherwise(F.when(n_preds > 0, 0.0).otherwise(1.0))
    error = F.when(visible, F.when(n_preds > 0, best_ce).otherwise(INFINITE)).otherwise(F.when(n_preds > 0, INFINITE).otherwise(0.0))
    out = frames.withColumns({"iou": score, "ce": error})
    return out if hidden_with_preds == "miss" else out.where(visible | (n_preds == 0))


def single_scores(tracks: DataFrame, hidden_with_preds: str = "miss") -> DataFrame:
    """Frame scores where each row holds one prediction x1..y2 (null: none) and its truth gx1..gy2."""
    p, g = box(), box("g")
    has = F.when(F.col("x1").isNotNull(), 1).otherwise(0)
    visible = (F.col("occ") == 0) & (F.col("oov") == 0)
    return frame_scores(tracks, iou(p, g, "eval"), center_distance(p, g), has, visible, hidden_with_preds)


def truth_status(frames: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """`frames` with what is known of the truth there: `status` (out of view goes before occluded,
    frames beyond the truth's end have no data) and `drawn`, whether its box is shown. truth: (keys,
    x1..y2, occ, oov), a box without size being null or empty."""
    known = truth.select(*keys, *["x1", "y1", "x2", "y2"], "occ", "oov", F.lit(True).alias("known"))
    met = frames.join(known, keys, "left")
    status = (
        F.when(F.col("known").isNull(), "NO GT DATA").when(F.col("oov") != 0, "OUT OF VIEW").when(F.col("occ") != 0, "FULL OCCLUSION").otherwise("VISIBLE")
    )
    shown = F.col("known").isNotNull() & (F.col("oov") == 0) & (F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1"))
    return met.select(*frames.columns, status.alias("status"), F.coalesce(shown, F.lit(False)).alias("drawn"))


def best_scores(truth: DataFrame, preds: DataFrame, keys: list[str], hidden_with_preds: str = "miss", processed: DataFrame | None = None) -> DataFrame:
    """Many predictions a frame: the best overlap counts, the later box at a tie. Frames that are
    not in `processed` (keys; none: all are) are left out rather than missed."""
    truth = truth if processed is None else truth.join(processed.select(*keys), keys, "left_semi")
    p, g = box(), box("g")
    hit = F.struct(F.coalesce(iou(p, g, "eval"), F.lit(0.0)).alias("iou"), F.col("ord"))
    joined = truth.join(preds.select(*keys, "ord", "x1", "y1", "x2", "y2"), keys, "left")
    grouped = joined.groupBy(*keys).agg(
        F.count("x1").alias("n_preds"),
        F.max(F.when(F.col("x1").isNotNull(), hit))["iou"].alias("best_iou"),
        F.max_by(center_distance(p, g), F.when(F.col("x1").isNotNull(), hit)).alias("best_ce"),
        F.first("occ").alias("occ"),
        F.first("oov").alias("oov"),
    )
    visible = (F.col("occ") == 0) & (F.col("oov") == 0)
    return frame_scores(grouped, F.col("best_iou"), F.col("best_ce"), F.col("n_preds"), visible, hidden_with_preds)


def placed(rows: DataFrame, documents: DataFrame, clip: str, size: int = 300) -> DataFrame:
    """Rows of a scene's documents with `first`, the scene's frame at which their document begins.

    The document of the whole scene (part null) goes before those of its parts: where `documents`
    (clip, part) has one, rows of parts are left out. Part z begins at frame (z - 1) * size.
    """
    whole = documents.where("part is null").select(clip).distinct()
    parts = rows.where("part is not null").join(whole, clip, "left_anti")
    first = F.coalesce((F.col("part") - 1) * size, F.lit(0)).cast("long")
    return rows.where("part is null").unionByName(parts.select(*rows.columns)).withColumn("first", first)


def placed_boxes(preds: DataFrame, documents: DataFrame, clip: str, size: int = 300) -> DataFrame:
    """Boxes (clip, part, frame_idx, ..) with frame_idx counted in the scene."""
    return placed(preds, documents, clip, size).withColumn("frame_idx", F.col("first") + F.col("frame_idx")).drop("first")


def processed_frames(documents: DataFrame, clip: str, size: int = 300) -> DataFrame:
    """(clip, frame_idx) of the frames that documents (clip, part, n_frames) cover."""
    at = placed(documents, documents, clip, size).where("n_frames > 0")
    return at.select(clip, F.explode(F.sequence("first", F.col("first") + F.col("n_frames") - 1)).alias("frame_idx")).distinct()


def shifted(preds: DataFrame, clips: DataFrame, keys: list[str]) -> DataFrame:
    """Boxes with frame_idx counted in the video: clips (keys, frame_offset) say where each begins."""
    moved = preds.join(clips.select(*keys, "frame_offset"), keys)
    return moved.withColumn("frame_idx", F.col("frame_idx") + F.col("frame_offset")).drop("frame_offset")


def of_class(preds: DataFrame, name: str) -> DataFrame:
    return preds.where(F.col("class_name") == name)


def without_class(preds: DataFrame, part: str = "person") -> DataFrame:
    """Boxes whose class does not contain `part` in either case; those without class stay."""
    return preds.where(~F.coalesce(F.lower("class_name").contains(part), F.lit(False)))


def highest_threshold() -> Column:
    """The number of the highest of 0, 0.05, .. 1 that `iou` reaches; -1 for none."""
    return F.aggregate(F.sequence(F.lit(0), F.lit(20)), F.lit(-1), lambda a, i: F.when(F.col("iou") >= i * F.lit(STEP), i).otherwise(a))


def success(scores: DataFrame) -> DataFrame:
    """(mean_score, success_auc) in one pass: a frame that reaches threshold t counts in the rates
    of 0 to t, so their sum is the mean of t + 1; the two ends count half."""
    t = F.col("reached")
    ends = F.avg((t >= 0).cast("int")) + F.avg((t == 20).cast("int"))
    return scores.select("iou", highest_threshold().alias("reached")).agg(F.avg("iou").alias("mean_score"), (STEP * (F.avg(t + 1) - ends / 2)).alias("success_auc"))


def success_curve(scores: DataFrame) -> DataFrame:
    """(t, threshold, rate): the share of frames with iou at or over 0, 0.05, .. 1.

    Counts by the highest threshold that a frame reaches are combined first; the running sums
    then run over 21 rows.
    """
    return _curve(scores.groupBy(highest_threshold().alias("reached")).count(), 20, above=True)


def precision_curve(scores: DataFrame, limit: int) -> DataFrame:
    """(t, rate): the share of frames with a centre error of at most t = 0 .. limit."""
    reached = F.when(F.col("ce") <= limit, F.greatest(F.ceil("ce"), F.lit(0))).otherwise(limit + 1).cast("int")
    return _curve(scores.groupBy(reached.alias("reached")).count(), limit, above=False)


def _curve(counts: DataFrame, last: int, above: bool) -> DataFrame:
    spark = counts.sparkSession
    grid = spark.range(last + 1).select(F.col("id").cast("int").alias("t"))
    ok = F.col("reached") >= F.col("t") if above else F.col("reached") <= F.col("t")
    rows = counts.crossJoin(F.broadcast(grid))  # at most last + 2 counts by last + 1 thresholds
    out = rows.groupBy("t").agg((F.sum(F.when(ok, F.col("count")).otherwise(0)) / F.sum("count")).alias("rate"))
    return out.select("t", (F.col("t") * F.lit(STEP)).alias("threshold"), "rate") if above else out


def area_under(curve: DataFrame) -> DataFrame:
    ends = F.sum(F.when(F.col("t").isin(0, 20), F.col("rate")).otherwise(0.0))
    return curve.agg((STEP * (F.sum("rate") - ends / 2)).alias("success_auc"))


def match_tracks(preds: DataFrame, truth: DataFrame, clip: str = "video_id", least: float = 0.2, track: Sequence[str] = ("track_id",)) -> DataFrame:
    """(clip, track, gt_id, mean_iou): each predicted track's best ground truth by mean IoU over
    common frames, the smallest id at a tie, if over `least`."""
    p, g = box(), box("g")
    joined = preds.join(truth, [clip, "frame_idx"]).where(F.col("x1").isNotNull())
    means = joined.groupBy(clip, *track, "gt_id").agg(F.avg(iou(p, g)).alias("mean_iou"))
    best = F.row_number().over(Window.partitionBy(clip, *track).orderBy(F.desc(F.round("mean_iou", 9)), "gt_id"))
    return means.withColumn("r", best).where((F.col("r") == 1) & (F.col("mean_iou") > least)).drop("r")


def mean_overlap(matches: DataFrame) -> DataFrame:
    """(n_matched, mean_iou) over all matched tracks; 0 without any."""
    return matches.agg(F.count("*").alias("n_matched"), F.coalesce(F.avg("mean_iou"), F.lit(0.0)).alias("mean_iou"))


def overlapping_actions(windows: DataFrame, relations: DataFrame, keys: list[str], bucket: int = 300) -> DataFrame:
    """Windows (start_f, end_f, actions) with the labels of relations (begin_f, stop_f, label) that
    overlap them strictly: an equi-join on time buckets, so one long track is dealt over many keys."""
    spread = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / bucket), F.floor(F.col(b) / bucket)))
    w = windows.withColumn("bucket", spread("start_f", "end_f"))
    r = relations.select(*keys, "begin_f", "stop_f", "label").withColumn("bucket", spread("begin_f", "stop_f"))
    meet = F.greatest("start_f", "begin_f") < F.least("end_f", "stop_f")
    hits = w.join(r, [*keys, "bucket"]).where(meet)
    found = hits.groupBy(*keys, "start_f", "end_f").agg(F.array_sort(F.collect_set("label")).alias("truth"))
    out = windows.join(found, [*keys, "start_f", "end_f"], "left")
    return out.withColumn("truth", F.coalesce("truth", F.expr("cast(array() as array<string>)")))


def set_counts(rows: DataFrame) -> DataFrame:
    n = lambda c: F.size(c).cast("long")
    return rows.withColumns(
        {
            "tp": n(F.array_intersect("actions", "truth")),
            "fp": n(F.array_except("actions", "truth")),
            "fn": n(F.array_except("truth", "actions")),
        }
    )


def precision_recall(counts: DataFrame) -> DataFrame:
    total = counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")])
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    out = total.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def iou_histogram(values: DataFrame, column: str, low: float = 0.2, bins: int = 20) -> DataFrame:
    """(bin, n) over [low, 1] in `bins` equal bins, empty ones too; the last is closed."""
    at = F.least(F.floor((F.col(column) - low) / ((1 - low) / bins)), F.lit(bins - 1)).cast("long")
    counts = values.where(F.col(column).between(low, 1.0)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    every = values.sparkSession.range(bins).withColumnRenamed("id", "bin")
    return every.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def motion_scores(poses: DataFrame, clip: str, order: str, matrix: str, threshold: float = 0.1) -> DataFrame:
    """Camera motion of each clip from 3x4 poses: L2 of translation steps and Frobenius norm of
    rotation steps; (avg_t + avg_r + max_t / 2 + max_r / 2), moving if over the threshold."""
    before = F.lag(matrix).over(Window.partitionBy(clip).orderBy(order))
    steps = poses.select(clip, F.zip_with(matrix, before, lambda a, b: a.cast("double") - b.cast("double")).alias("d"))
    is_t = lambda i: (i + 1) % 4 == 0
    norm = lambda keep: F.sqrt(F.aggregate(F.transform("d", lambda x, i: F.when(keep(i), x * x).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x))
    moved = steps.select(clip, norm(is_t).alias("t"), norm(lambda i: ~is_t(i)).alias("r"))
    score = F.coalesce(F.avg("t") + F.avg("r") + 0.5 * F.max("t") + 0.5 * F.max("r"), F.lit(0.0))
    return moved.groupBy(clip).agg(score.alias("motion")).withColumn("moving", F.col("motion") > threshold)
