"""Joins of overlapping boxes by a grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boxframe.functions.geometry import box, iou
from boxframe.functions.runs import from_numbers, overlap

BOX = ("x1", "y1", "x2", "y2")


def in_cells(rows: DataFrame, cell: float, prefix: str = "") -> DataFrame:
    """`rows` once for each grid cell (cx, cy) that its box touches; boxes with a null, or with an
    edge before its opposite, touch none."""
    b = box(prefix)
    at = lambda v: F.floor(v / cell).cast("long")
    good = (b.x1 <= b.x2) & (b.y1 <= b.y2)
    wide = rows.where(good).withColumn("cx", F.explode(F.sequence(at(b.x1), at(b.x2))))
    return wide.withColumn("cy", F.explode(F.sequence(at(b.y1), at(b.y2))))


def overlapping_pairs(left: DataFrame, right: DataFrame, keys: Sequence[str], cell: float = 64.0, prefix: str = "g") -> DataFrame:
    """Pairs of rows with equal keys whose boxes x1..y2 and {prefix}x1..y2 share an area, each once.

    Boxes are dealt to the cells of a grid, and a pair is met where both lie in one cell. Of the
    cells that it shares, the one with the lower corner of its overlap counts. So a frame with n
    boxes compares neighbours only, and is itself dealt over many tasks.
    """
    a, b = box(), box(prefix)
    both = in_cells(left, cell).join(in_cells(right, cell, prefix), [*keys, "cx", "cy"])
    x, y = F.greatest(a.x1, b.x1), F.greatest(a.y1, b.y1)
    own = (F.floor(x / cell) == F.col("cx")) & (F.floor(y / cell) == F.col("cy"))
    met = (x < F.least(a.x2, b.x2)) & (y < F.least(a.y2, b.y2))
    return both.where(met & own).drop("cx", "cy")


def common_frames(frames: DataFrame, clip: str, keys: Sequence[str]) -> DataFrame:
    """(clip, keys, frames): the frames of each track as runs of numbers."""
    return frames.groupBy(clip, *keys).agg(from_numbers(F.collect_list("frame_idx")).alias("frames"))


def match_overlapping(preds: DataFrame, truth: DataFrame, clip: str = "video_id", least: float = 0.2, track: Sequence[str] = ("track_id",), cell: float = 64.0) -> DataFrame:
    """What `evaluate.match_tracks` gives for `least` >= 0, from pairs of boxes that overlap.

    A pair's IoUs are summed over the frames in which the boxes meet and divided by the number of
    frames that both tracks have, which is the overlap of their runs of frames; all other frames
    add nothing. Tracks that never meet are never compared.
    """
    seen = preds.dropna(subset=list(BOX))
    met = overlapping_pairs(seen.select(clip, *track, "frame_idx", *BOX), truth.select(clip, "gt_id", "frame_idx", *["g" + c for c in BOX]), [clip, "frame_idx"], cell)
    sums = met.groupBy(clip, *track, "gt_id").agg(F.sum(iou(box(), box("g"))).alias("total"))
    mine, theirs = common_frames(seen, clip, track), common_frames(truth, clip, ["gt_id"]).withColumnRenamed("frames", "gt_frames")
    means = sums.join(mine, [clip, *track]).join(theirs, [clip, "gt_id"])
    means = means.select(clip, *track, "gt_id", (F.col("total") / overlap(F.col("frames"), F.col("gt_frames"))).alias("mean_iou"))
    best = F.row_number().over(Window.partitionBy(clip, *track).orderBy(F.desc(F.round("mean_iou", 9)), "gt_id"))
    return means.withColumn("r", best).where((F.col("r") == 1) & (F.col("mean_iou") > least)).drop("r")

