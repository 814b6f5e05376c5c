"""Best ground truth of tracks where most tracks of a clip meet, by blocks of tracks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boxframe.operators.batches import grouped

#: So many tracks stand in a block, about; a task holds the sums of one pair of blocks.
BLOCK_TRACKS = 2048
#: A track goes to the tasks in pieces of so many frames.
PIECE_FRAMES = 512
#: So many predicted boxes of a frame are compared with all of a block at once.
STRIP = 32


class Side:
    """The tracks of one block, numbered as they come."""

    def __init__(self) -> None:
        self.number: dict[object, int] = {}

    def boxes(self, table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Track numbers, frames, corners (4, n) and areas, by frame; boxes that are null or have no
        size lie nowhere."""
        keys = [self.number.setdefault(k, len(self.number)) for k in table.column(name).to_pylist()]
        lists = table.column("rows").combine_chunks()
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
        rows = lists.flatten()
        frames = rows.field("frame_idx").to_numpy(zero_copy_only=False)
        order = np.argsort(frames, kind="stable")
        x1, y1, x2, y2 = (rows.field(c).to_numpy(zero_copy_only=False).astype(float)[order] for c in ("x1", "y1", "x2", "y2"))
        good = (x1 < x2) & (y1 < y2)
        corners = np.where(good, np.stack([x1, y1, x2, y2]), np.array([[np.inf], [np.inf], [-np.inf], [-np.inf]]))
        return np.repeat(np.array(keys, np.int64), sizes)[order], frames[order], corners, np.where(good, (x2 - x1) * (y2 - y1), 1.0)


def layers(tracks: np.ndarray) -> Iterator[np.ndarray]:
    """Places of the rows of a frame, each track once at a time."""
    left = np.arange(len(tracks))
    while len(left):
        _, first = np.unique(tracks[left], return_index=True)
        yield left[first]
        left = np.delete(left, first)


class Sums:
    """Sums of IoUs and numbers of common frames of every two tracks of two blocks."""

    def __init__(self) -> None:
        self.preds, self.truth = Side(), Side()
        self.total, self.common = np.zeros((0, 0)), np.zeros((0, 0))

    def add(self, piece: pa.Table) -> None:
        side = piece.column("side").to_numpy()
        p, pf, pc, pa_ = self.preds.boxes(piece.filter(pa.array(side == 0)), "track")
        g, gf, gc, ga = self.truth.boxes(piece.filter(pa.array(side == 1)), "gt")
        shape = (len(self.preds.number), len(self.truth.number))
        grown = [(0, new - old) for new, old in zip(shape, self.total.shape)]
        self.total, self.common = np.pad(self.total, grown), np.pad(self.common, grown)
        frames = np.intersect1d(pf, gf)
        seen = [np.zeros((len(frames), n)) for n in shape]
        bounds = [(np.searchsorted(f, frames, "left"), np.searchsorted(f, frames, "right")) for f in (pf, gf)]
        for i in range(len(frames)):
            mine, theirs = (slice(a[i], b[i]) for a, b in bounds)
            np.add.at(seen[0][i], p[mine], 1)
            np.add.at(seen[1][i], g[theirs], 1)
            for second in layers(g[theirs]):
                at = second + theirs.start
                corners = np.repeat([[np.inf], [np.inf], [-np.inf], [-np.inf]], shape[1], axis=1)
                areas = np.ones(shape[1])
                corners[:, g[at]], areas[g[at]] = gc[:, at], ga[at]
                for first in layers(p[mine]):
                    for k in range(0, len(first), STRIP):
                        some = first[k : k + STRIP] + mine.start
                        self.total[p[some]] += overlaps(pc[:, some], pa_[some], corners, areas)
        self.common += seen[0].T @ seen[1]

    def best(self) -> Iterator[tuple[object, object, float]]:
        """(track, gt, mean_iou): of each track's means, rounded to 9 digits, the highest; the
        smallest id at a tie."""
        ids = np.array(list(self.truth.number), object)
        order = np.argsort(ids, kind="stable")
        for row, track in enumerate(self.preds.number):
            with np.errstate(invalid="ignore", divide="ignore"):
                means = self.total[row, order] / self.common[row, order]
            rounded = np.where(self.common[row, order] > 0, np.round(means, 9), -1.0)
            if len(rounded) and rounded[at := int(np.argmax(rounded))] >= 0:
                yield track, ids[order[at]], float(means[at])


def overlaps(a: np.ndarray, a_areas: np.ndarray, b: np.ndarray, b_areas: np.ndarray) -> np.ndarray:
    """The IoU of every two boxes; 0 for boxes that lie nowhere."""
    a = a[:, :, None]
    out, high = np.minimum(a[2], b[2]), np.minimum(a[3], b[3])
    out -= np.maximum(a[0], b[0])
    high -= np.maximum(a[1], b[1])
    np.maximum(out, 0.0, out=out)
    np.maximum(high, 0.0, out=high)
    out *= high
    np.add(a_areas[:, None], b_areas, out=high)
    high -= out
    out /= high
    return out


def match_in_blocks(preds: DataFrame, truth: DataFrame, clip: Sequence[str] = ("video_id",), least: float = 0.2, track: str = "track_id", block: int = BLOCK_TRACKS) -> DataFrame:
    """(clip, track, gt_id, mean_iou), as `evaluate.match_tracks` gives it for `least` >= 0.

    preds (clip, track, frame_idx, x1..y2), truth (clip, gt_id, frame_idx, gx1..gy2). Each clip's
    tracks are dealt to blocks of about `block` by the hash of their ids, and every two blocks of a
    clip meet in one task, which sums over their common frames: so a clip with n tracks is n^2 /
    block^2 tasks' work, no pair of boxes is a row, and only a track's best leaves a task. A task
    holds the sums of two blocks and `PIECE_FRAMES` frames of their boxes. `spatial.match_overlapping`
    suits clips of which few tracks meet.
    """
    clip = list(clip)
    row = lambda prefix: F.struct("frame_idx", *[F.col(prefix + c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")])

    def sized(rows: DataFrame, key: str, name: str) -> DataFrame:
        return rows.groupBy(*clip).agg(F.ceil(F.count_distinct(key) / block).cast("int").alias(name))

    def pieces(rows: DataFrame, key: str, prefix: str, own: str, sizes: DataFrame) -> DataFrame:
        cut = rows.groupBy(*clip, key, F.floor(F.col("frame_idx") / PIECE_FRAMES).alias("piece")).agg(F.collect_list(row(prefix)).alias("rows"))
        return cut.join(sizes, clip).withColumn(own, F.pmod(F.xxhash64(key), F.col(own)).cast("int"))

    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    seen = preds.where("x1 is not null").dropna(subset=clip)
    sizes = sized(seen, track, "p").join(sized(truth, "gt_id", "g"), clip)
    kinds = {**dict(preds.dtypes), **dict(truth.dtypes)}
    left = pieces(seen, track, "", "p", sizes).withColumn("g", every("g"))
    right = pieces(truth, "gt_id", "g", "g", sizes).withColumn("p", every("p"))
    names = [*clip, "p", "g", "piece", "side", "track", "gt", "rows"]
    left = left.select(*clip, "p", "g", "piece", F.lit(0).alias("side"), F.col(track).alias("track"), F.lit(None).cast(kinds["gt_id"]).alias("gt"), "rows")
    right = right.select(*clip, "p", "g", "piece", F.lit(1).alias("side"), F.lit(None).cast(kinds[track]).alias("track"), F.col("gt_id").alias("gt"), "rows")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, sums, types = None, Sums(), []

        def done() -> pa.RecordBatch:
            rows = [(*pair[: len(clip)], *found) for found in sums.best()]
            columns = list(zip(*rows)) if rows else [()] * len(types)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [*clip, track, "gt_id", "mean_iou"])

        for now, piece in grouped(batches, [*clip, "p", "g", "piece"]):
            types = types or [*(piece.schema.field(c).type for c in (*clip, "track", "gt")), pa.float64()]
            if pair != now[:-1]:
                if pair is not None:
                    yield done()
                pair, sums = now[:-1], Sums()
            sums.add(piece)
        if pair is not None:
            yield done()

    dealt = left.unionByName(right).select(*names).repartition(*clip, "p", "g").sortWithinPartitions(*clip, "p", "g", "piece")
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (*clip, track, "gt_id")) + ", mean_iou double"
    found = dealt.mapInArrow(best, schema)
    first = F.row_number().over(Window.partitionBy(*clip, track).orderBy(F.desc(F.round("mean_iou", 9)), "gt_id"))
    return found.withColumn("r", first).where((F.col("r") == 1) & (F.col("mean_iou") > least)).drop("r")
