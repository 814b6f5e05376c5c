"""Optimal assignment of detections to tracks, stitching over chunks, and fresh ids."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boxframe.operators.batches import grouped

BOX = ["x1", "y1", "x2", "y2"]


def min_cost_assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of least total cost, by shortest augmenting paths with potentials."""
    if cost.shape[0] > cost.shape[1]:
        return sorted((r, c) for c, r in min_cost_assignment(cost.T))
    n, m = cost.shape
    rows, cols, owner = np.zeros(n), np.zeros(m), np.full(m, -1)
    for first in range(n):
        best, came, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        row, col, lowest = first, -1, 0.0
        reached = [first]
        while True:
            slack = lowest + cost[row] - rows[row] - cols
            better = ~done & (slack < best)
            best[better], came[better] = slack[better], row
            col = int(np.argmin(np.where(done, np.inf, best)))
            lowest = best[col]
            done[col] = True
            if owner[col] < 0:
                break
            row = int(owner[col])
            reached.append(row)
        closed = np.flatnonzero(done)
        gain = lowest - best[closed]
        rows[first] += lowest
        for c, g in zip(closed, gain):
            cols[c] -= g
            if owner[c] >= 0:
                rows[owner[c]] += g
        while True:
            row = int(came[col])
            owner[col], before = row, np.flatnonzero(owner == row)
            old = [c for c in before if c != col]
            if row == first:
                break
            col = int(old[0])
    return sorted((int(owner[c]), c) for c in range(m) if owner[c] >= 0)


def iou_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = a[:, None], b[None]
    wide = np.minimum(a[..., 2], b[..., 2]) - np.maximum(a[..., 0], b[..., 0])
    high = np.minimum(a[..., 3], b[..., 3]) - np.maximum(a[..., 1], b[..., 1])
    inter = np.maximum(wide, 0) * np.maximum(high, 0)
    size = lambda x: (x[..., 2] - x[..., 0]) * (x[..., 3] - x[..., 1])
    union = size(a) + size(b) - inter
    return np.where(union > 0, inter / np.where(union > 0, union, 1), 0.0)


def matched(tracks: np.ndarray, dets: np.ndarray, max_cost: float) -> list[tuple[int, int]]:
    if not len(tracks) or not len(dets):
        return []
    cost = 1 - iou_matrix(tracks, dets)
    return [(r, c) for r, c in min_cost_assignment(cost) if cost[r, c] <= max_cost]


def assign(tracks: DataFrame, dets: DataFrame, keys: list[str], max_cost: float = 0.85) -> DataFrame:
    """(keys, track_id, det_id): least total 1 - IoU per group, pairs over `max_cost` dropped.

    A group is one clip at one chunk border, so its size is the number of boxes in a frame. Both
    sides are dealt by the keys and sorted together; a task goes through its groups in one pass
    and holds one at a time, however small they are.
    """
    kinds = ", ".join(f"`{k}` {t}" for k, t in dets.dtypes if k in keys)
    side = lambda rows, i, name: rows.select(*keys, F.lit(i).alias("side"), F.col(name).cast("long").alias("id"), *[F.col(c).cast("double").alias(c) for c in BOX])
    both = side(tracks, 0, "track_id").unionByName(side(dets, 1, "det_id")).dropna(subset=BOX)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, groups, left, right = None, [], [], []

        def flush() -> pa.RecordBatch:
            columns = [pa.array(c, schema.field(k).type) for k, c in zip(keys, zip(*groups))]
            out = pa.RecordBatch.from_arrays([*columns, pa.array(left), pa.array(right)], [*keys, "track_id", "det_id"])
            groups.clear(), left.clear(), right.clear()
            return out

        for key, rows in grouped(batches, keys):
            schema = rows.schema
            boxes = np.stack([rows.column(c).to_numpy() for c in BOX], axis=1)
            ids, n = rows.column("id").to_numpy(), int((rows.column("side").to_numpy() == 0).sum())
            for r, c in matched(boxes[:n], boxes[n:], max_cost):
                groups.append(key)
                left.append(ids[r])
                right.append(ids[n + c])
            if len(groups) >= 8192:
                yield flush()
        if groups:
            yield flush()

    return both.repartition(*keys).sortWithinPartitions(*keys, "side", "id").mapInArrow(run, f"{kinds}, track_id long, det_id long")


def stitch(dets: DataFrame, clip: str, max_cost: float = 0.85, first_id: int = 1000, propagate: Callable[[object, int, np.ndarray, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(clip, chunk, det_id, track_id, class_name): ids carried from chunk to chunk of a clip.

    All ids met so far stay active: where they stand at the end of a chunk is what
    `propagate(clip, chunk, ids, boxes)` makes of their boxes there (rows of nan: lost from sight),
    or where they were seen last. `loop.track_clips` is the form for a tracker with frames. A chunk's
    detections are matched with these; a match takes over the id and moves it, others get the
    next ids in order. A chunk without detections (its number is absent) is not propagated, so
    the chunk after it finds nothing to match and mints new ids, beside the old ones. class_name is
    the one that the id's newest detection in the clip has.
    """

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["chunk", "det_id"], kind="stable")
        boxes, next_id, found, last = np.empty((0, 4)), first_id, [], None
        for chunk, now in rows.groupby("chunk", sort=True):
            here = now[BOX].to_numpy(float)
            mine = np.full(len(now), -1)
            if last is not None and chunk == last + 1:
                seen = np.flatnonzero(~np.isnan(boxes).any(axis=1))
                for r, c in matched(boxes[seen], here, max_cost):
                    mine[c] = seen[r]
            fresh = mine < 0
            mine[fresh] = next_id - first_id + np.arange(fresh.sum())
            next_id += int(fresh.sum())
            boxes = np.concatenate([boxes, np.full((next_id - first_id - len(boxes), 4), np.nan)])
            boxes[mine] = here
            ids = first_id + np.arange(len(boxes))
            boxes, last = propagate(key[0], int(chunk), ids, boxes) if propagate else boxes, chunk
            found.append(mine + first_id)
        out = rows[[clip, "chunk", "det_id", "class_name"]].copy()
        out["track_id"] = np.concatenate(found)
        out["class_name"] = out.groupby("track_id")["class_name"].transform("last")
        return out[[clip, "chunk", "det_id", "track_id", "class_name"]]

    kind = dict(dets.dtypes)[clip]
    return dets.groupBy(clip).applyInPandas(run, f"{clip} {kind}, chunk long, det_id long, track_id long, class_name string")


def fresh_ids(dets: DataFrame, clip: str, first_id: int = 1000) -> DataFrame:
    """Every detecting chunk mints new ids in order of (chunk, det_id)."""
    rank = F.row_number().over(Window.partitionBy(clip).orderBy("chunk", "det_id"))
    return dets.withColumn("track_id", (rank + (first_id - 1)).cast("long"))


def active_ids(minted: DataFrame, chunks: DataFrame, clip: str) -> DataFrame:
    """(clip, chunk, since, track_id): ids that live in each chunk of `chunks`: those of the newest
    chunk with detections, as a chunk without any keeps the old ones; before the first, none."""
    found = minted.select(clip, "chunk").distinct().withColumn("own", F.col("chunk"))
    so_far = Window.partitionBy(clip).orderBy("chunk")
    since = chunks.join(found, [clip, "chunk"], "left").withColumn("since", F.last("own", ignorenulls=True).over(so_far))
    ids = minted.select(clip, F.col("chunk").alias("since"), "track_id")
    return since.select(clip, "chunk", "since").join(ids, [clip, "since"]).select(clip, "chunk", "since", "track_id")
