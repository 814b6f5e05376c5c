"""The loop of detection, matching and propagation over the chunks of each clip."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxframe.functions.geometry import area, box
from boxframe.operators import dedupe
from boxframe.operators.assign import BOX, matched
from boxframe.operators.batches import grouped

#: Rows that a task gathers before they go on.
FLUSH_ROWS = 8192


class Tracker(Protocol):
    """What a video tracker must do. One is made for each task; the chunks of a clip come to it one
    after another, so it may keep a clip's state until the next clip begins."""

    def follow(self, clip: object, chunk: int, frames: range, seeds: dict[int, np.ndarray], ids: list[int]) -> Iterator[tuple[int, dict[int, np.ndarray]]]:
        """(frame, boxes by id) for frames of the chunk. `seeds` are the boxes that detections give
        ids in the chunk's first frame; `ids` are all of the clip so far. An id that is out of
        sight has no box."""


def persons(detections: DataFrame, person: int = 0, sure: float = 0.7, least_area: float = 50.0) -> DataFrame:
    """Detections of the class `person` over the score `sure` whose box is over `least_area`."""
    return detections.where((F.col("class_id") == person) & (F.col("confidence") > sure) & (area(box()) > least_area))


def chunk_detections(people: DataFrame, objects: DataFrame, keys: list[str], *, person: int = 0, sure: float = 0.7, least_area: float = 50.0, floor: float = 0.15) -> DataFrame:
    """The detections that seed a chunk: persons (class_id `person`, over `sure`) and, after one
    class-aware suppression over all prompts, objects; then without near copies and contained
    boxes. Both have (keys, det_id, class_name, confidence, x1..y2) with det_id unique in a group;
    people also class_id. Classes of objects are trimmed and in lower case."""
    columns = [*keys, "det_id", "class_name", "confidence", *BOX]
    first = persons(people, person, sure, least_area).withColumn("class_name", F.lit("person"))
    named = objects.where(area(box()) > least_area).withColumn("class_name", F.lower(F.trim("class_name")))
    both = first.select(*columns).unionByName(dedupe.nms_by_class(named.select(*columns), keys=keys).select(*columns))
    return dedupe.drop_contained(dedupe.dedupe_by_confidence(both, floor, 0.45, keys=keys), keys=keys).select(*columns)


@dataclass
class Clip:
    """What is carried from chunk to chunk: the next id, each id's class, the boxes of the last frame."""

    name: object
    next_id: int
    names: dict[int, str] = field(default_factory=dict)
    last_frame: int = -1
    last_boxes: dict[int, np.ndarray] = field(default_factory=dict)

    def seeds(self, first_frame: int, boxes: np.ndarray, classes: list[str], max_cost: float) -> dict[int, int]:
        """Detection to id: matched with the boxes of the frame before, new ids for the others."""
        known = list(self.last_boxes) if self.last_frame == first_frame - 1 else []
        found = {}
        if known:
            found = {c: known[r] for r, c in matched(np.array([self.last_boxes[i] for i in known], float), boxes, max_cost)}
        for c in range(len(boxes)):
            if c not in found:
                found[c], self.next_id = self.next_id, self.next_id + 1
            self.names[found[c]] = classes[c]
        return found


def track_clips(dets: DataFrame, clip: str, make_tracker: Callable[[], Tracker], *, size: int = 30, max_cost: float = 0.85, first_id: int = 1000) -> DataFrame:
    """(clip, chunk, frame_idx, track_id, class_name, x1, y1, x2, y2): boxes of all frames.

    dets has (clip, chunk, det_id, class_name, x1..y2, n_frames): what was detected in each chunk's
    first frame, and the clip's length. Chunks come in order. A detection takes over the id whose
    box in the frame before overlaps it best (least total cost, at most `max_cost` each), others
    get the next ids. The tracker then follows all ids of the clip through the chunk. A chunk
    without detections is absent here and in the result, so the chunk after it mints new ids.
    class_name is that of the id's newest detection up to the chunk (`newest_class` gives the
    clip's). An id that has no box in the frame where it is seeded has a row with nulls there.

    Rows are dealt by clip and sorted on disk where memory ends; a task holds one chunk's
    detections and one clip's last boxes. Clips are many; one is at most a video.
    """
    kind = dict(dets.dtypes)[clip]
    schema = f"`{clip}` {kind}, chunk long, frame_idx long, track_id long, class_name string, x1 double, y1 double, x2 double, y2 double"
    columns = [clip, "chunk", "frame_idx", "track_id", "class_name", *BOX]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tracker, state, kind, rows = make_tracker(), None, None, []

        def flush() -> pa.RecordBatch:
            names, *others = zip(*rows)
            arrays = [pa.array(names, kind), *(pa.array(c, pa.int64()) for c in others[:3]), pa.array(others[3], pa.string()), *(pa.array(c, pa.float64()) for c in others[4:])]
            rows.clear()
            return pa.RecordBatch.from_arrays(arrays, columns)

        for (name, chunk), now in grouped(batches, [clip, "chunk"]):
            kind = now.schema.field(clip).type
            if state is None or state.name != name:
                state = Clip(name, first_id)
            boxes = np.stack([now.column(c).to_numpy() for c in BOX], axis=1).astype(float)
            start = chunk * size
            frames = range(start, min(start + size, now.column("n_frames")[0].as_py()))
            found = state.seeds(start, boxes, now.column("class_name").to_pylist(), max_cost)
            seeds = {i: boxes[c] for c, i in found.items()}
            unseen = set(seeds)
            state.last_frame, state.last_boxes = -1, {}
            for frame, here in tracker.follow(name, chunk, frames, seeds, sorted(state.names)):
                if frame not in frames:
                    continue
                here = {i: b for i, b in here.items() if i in state.names}
                rows += [(name, chunk, frame, i, state.names[i], *map(float, b)) for i, b in here.items()]
                if frame == start:
                    unseen -= set(here)
                if frame == frames[-1]:
                    state.last_frame, state.last_boxes = frame, here
                if len(rows) >= FLUSH_ROWS:
                    yield flush()
            rows += [(name, chunk, start, i, state.names[i], None, None, None, None) for i in sorted(unseen)]
        if rows:
            yield flush()

    narrow = dets.select(clip, F.col("chunk").cast("long").alias("chunk"), "det_id", "class_name", *[F.col(c).cast("double").alias(c) for c in BOX], F.col("n_frames").cast("long").alias("n_frames"))
    return narrow.repartition(clip).sortWithinPartitions(clip, "chunk", "det_id").mapInArrow(run, schema)


def newest_class(segments: DataFrame, clip: str) -> DataFrame:
    """`segments` with the class that each id's newest detection in the clip has."""
    newest = segments.groupBy(clip, "track_id").agg(F.max_by("class_name", "chunk").alias("class_name"))
    return segments.drop("class_name").join(newest, [clip, "track_id"]).select(*segments.columns)


class Drift:
    """A tracker for tests and dry runs: boxes move by a step a frame and keep their size; an id
    whose number `lost` divides goes out of sight after `sight` frames without a new seed."""

    def __init__(self, step: tuple[float, float] = (5.0, 3.0), lost: int = 7, sight: int = 20) -> None:
        self.step, self.lost, self.sight, self.clip = np.array([*step, *step]), lost, sight, None

    def follow(self, clip: object, chunk: int, frames: range, seeds: dict[int, np.ndarray], ids: list[int]) -> Iterator[tuple[int, dict[int, np.ndarray]]]:
        if clip != self.clip:
            self.clip, self.seeded = clip, {}
        self.seeded.update({i: (frames[0], b) for i, b in seeds.items()})
        for frame in frames:
            here = {i: (frame - f, b) for i, (f, b) in self.seeded.items()}
            yield frame, {i: b + age * self.step for i, (age, b) in here.items() if i % self.lost or age < self.sight}
