"""Greedy selection of detections: one fold over each group's detections in order."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxframe.functions.geometry import Box, center_distance, containment, iou

#: Detections compete within a frame of a clip.
FRAME = ("video_id", "frame_idx")
FIELDS = ("det_id", "class_name", "confidence", "x1", "y1", "x2", "y2")


def _box(row: Column) -> Box:
    return Box(row["x1"], row["y1"], row["x2"], row["y2"])


def greedy_keep(dets: DataFrame, order: Callable[[Column], Column], reject: Callable[[Column, Column], Column], keys: Sequence[str] = FRAME) -> DataFrame:
    """Detections kept when taken in order (smallest `order` first, then det_id) and rejected if
    `reject(kept, candidate)` holds for any kept one.

    One shuffle by `keys`; the group's detections of a frame are an array, so the fold runs in
    the JVM. The outer explode keeps the optimizer from copying the fold into a size filter.
    """
    row = F.struct(*FIELDS)
    keyed = F.array_sort(F.collect_list(F.struct(order(row).alias("o"), F.col("det_id").alias("d"), row.alias("r"))))
    grouped = dets.groupBy(*keys).agg(F.transform(keyed, lambda x: x["r"]).alias("sorted"))

    def step(kept: Column, candidate: Column) -> Column:
        bad = F.exists(kept, lambda k: reject(k, candidate))
        return F.when(bad, kept).otherwise(F.concat(kept, F.array(candidate)))

    kept = F.aggregate("sorted", F.filter("sorted", lambda x: F.lit(False)), step)
    return grouped.select(*keys, F.explode_outer(kept).alias("r")).select(*keys, "r.*").where("det_id is not null")


def dedupe_by_confidence(dets: DataFrame, confidence: float = 0.45, overlap: float = 0.3, distance: float = 50.0, keys: Sequence[str] = FRAME) -> DataFrame:
    def reject(k: Column, c: Column) -> Column:
        near = (k["class_name"] == c["class_name"]) & (center_distance(_box(k), _box(c)) < distance)
        return (iou(_box(k), _box(c)) > overlap) | near

    return greedy_keep(dets.where(F.col("confidence") >= confidence), lambda r: -r["confidence"], reject, keys)


def nms_by_class(dets: DataFrame, overlap: float = 0.45, keys: Sequence[str] = FRAME) -> DataFrame:
    same = lambda k, c: (k["class_name"] == c["class_name"]) & (iou(_box(k), _box(c)) > overlap)
    return greedy_keep(dets, lambda r: -r["confidence"], same, keys)


def drop_contained(dets: DataFrame, share: float = 0.8, keys: Sequence[str] = FRAME) -> DataFrame:
    """Largest first; a box mostly inside a kept one of its class goes."""
    size = lambda r: -((r["x2"] - r["x1"]) * (r["y2"] - r["y1"]))
    inside = lambda k, c: (k["class_name"] == c["class_name"]) & (containment(_box(c), _box(k)) > share)
    return greedy_keep(dets, size, inside, keys)


def nms(dets: DataFrame, overlap: float = 0.5, keys: Sequence[str] = FRAME) -> DataFrame:
    """Whatever the class; a candidate stays only below the overlap."""
    return greedy_keep(dets, lambda r: -r["confidence"], lambda k, c: iou(_box(k), _box(c)) >= overlap, keys)
