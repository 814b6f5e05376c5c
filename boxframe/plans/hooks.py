"""Typed hooks for models: a detector or labeller is any function on Arrow or pandas batches that
gives the named columns. Tests put small functions in their place."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

DETECTIONS = "clip_id string, frame_idx long, det_id long, class_name string, confidence double, x1 double, y1 double, x2 double, y2 double"
SEGMENTS = "clip_id string, track_id long, frame_idx long, x1 double, y1 double, x2 double, y2 double"
MASKS = "clip_id string, frame_idx long, det_id long, mask binary"
KEYPOINTS = "clip_id string, frame_idx long, det_id long, points array<struct<x:double,y:double,score:double>>"
SCENES = "video_id string, scene_idx int, start_sec double, end_sec double"
POSES = "clip_id string, i long, m array<double>"


def detect(frames: DataFrame, model: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """Detections of frames (clip_id, frame_idx, content), batch by batch."""

    return _batches(frames, model, DETECTIONS)


def masks(boxes: DataFrame, model: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """A packed mask for each box (clip_id, frame_idx, det_id, content, x1..y2)."""
    return _batches(boxes, model, MASKS)


def keypoints(boxes: DataFrame, model: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """Body points for each box (clip_id, frame_idx, det_id, content, x1..y2)."""
    return _batches(boxes, model, KEYPOINTS)


def scenes(videos: DataFrame, model: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """Scenes, numbered from 1, of videos (video_id, path)."""
    return _batches(videos, model, SCENES)


def _batches(rows: DataFrame, model: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield model(batch)

    return rows.mapInPandas(run, schema)


def propagate(seeds: DataFrame, model: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """Boxes of every frame from a clip's seed boxes."""
    return seeds.groupBy("clip_id").applyInPandas(model, SEGMENTS)


def poses(frames: DataFrame, model: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    return frames.groupBy("clip_id").applyInPandas(model, POSES)


def label(prompt: Column, model: Callable[[pd.Series], pd.Series]) -> Column:
    """A text reply for each prompt."""
    return F.pandas_udf(model, "string")(prompt)


def table_function(spark: SparkSession, name: str, make_model: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str, block: int = 64) -> None:
    """Register a model as the SQL function `name`, to be called with a table:
    `select * from name(table(frames) partition by clip_id order by frame_idx)`.

    One model is made for each partition and gets its rows in order, `block` at a time, so it may
    carry a clip's state from block to block; what it gives has the columns of `schema`, of types
    without blanks, and no nulls in numbers.
    """
    kinds = dict(c.split() for c in schema.split(", "))
    numeric = {c: {"double": "float64", "long": "int64"}[t] for c, t in kinds.items() if t in ("double", "long")}

    class Blocks:
        def __init__(self) -> None:
            self.model, self.rows = make_model(), []

        def given(self) -> Iterator[tuple]:
            out = self.model(pd.DataFrame([r.asDict() for r in self.rows]))
            self.rows = []
            yield from out[list(kinds)].astype(numeric).astype(object).itertuples(index=False, name=None)

        def eval(self, row: Row) -> Iterator[tuple]:
            self.rows.append(row)
            if len(self.rows) >= block:
                yield from self.given()

        def terminate(self) -> Iterator[tuple]:
            if self.rows:
                yield from self.given()

    spark.udtf.register(name, F.udtf(Blocks, returnType=schema, useArrow=True))
