"""Keyed state that takes the rows of a stream in order of event time."""

from __future__ import annotations

import itertools
from abc import abstractmethod
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from boxframe.operators.assign import BOX, matched
from boxframe.operators.kalman import P0, Q, R

#: The state store that keyed state with timers needs.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class InOrder(StatefulProcessor):
    """Rows wait in a list state until the watermark passes their time; then `advance` gets those of
    each key in order of time and `order`, so late rows within the watermark's delay change nothing.

    Keys are dealt to buckets by their hash, and state and timers are a bucket's: calls and reads of
    state go with buckets and batches, not with keys. A row that is `idle` milliseconds or more
    after its key's one before begins a new state. One timer a bucket stands at the earliest waiting
    time, or at the earliest end of a key's `idle` milliseconds if that is sooner: then such keys
    are cleared. State is in the checkpoint, so a query that starts again goes on where it stood.
    """

    #: What waits of each row; `at` is the time in milliseconds. Then what `advance` carries.
    waits: list[str]
    carries: list[str]
    #: What gives ties an order, and the columns of the output.
    order: list[str]
    gives: list[str]

    def __init__(self, keys: list[str], idle: int) -> None:
        self.keys, self.idle = keys, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.carried = handle.getValueState("carried", "rows binary")
        self.clock = handle.getValueState("clock", "timer long")

    @abstractmethod
    def advance(self, state: pd.DataFrame, number: np.ndarray, fresh: np.ndarray, rows: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
        """The next state and the output of rows that come in order, key by key. number: each row's
        key, as a place in `state`; fresh: rows before which the state is forgotten, or was none."""

    def set_timer(self, at: int) -> None:
        self.handle.registerTimer(at)
        self.clock.update((at,))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        new = pd.concat([r[[*self.keys, *self.waits]] for r in rows])
        self.waiting.appendList([(packed(new),)])
        first, timer = int(new["at"].min()), self.clock.get()[0] if self.clock.exists() else None
        if timer is None or first < timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.set_timer(first)
        return iter([])

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        rows = unpacked([r[0] for r in self.waiting.get()] if self.waiting.exists() else [], [*self.keys, *self.waits])
        carried = unpacked([self.carried.get()[0]] if self.carried.exists() else [], [*self.keys, "newest", *self.carries])
        self.clock.clear()  # the timer that fired is gone
        ripe = (rows["at"] <= passed).to_numpy(bool)
        now, later = rows[ripe].sort_values([*self.keys, "at", *self.order], kind="stable", ignore_index=True), rows[~ripe]
        if len(now):
            first = ~now.duplicated(self.keys).to_numpy()
            heads = now.loc[first, self.keys].reset_index(drop=True)
            before = heads.merge(carried, on=self.keys, how="left") if len(carried) else heads.reindex(columns=carried.columns)
            number, at = np.cumsum(first) - 1, now["at"].to_numpy("float64")
            newest = before["newest"].to_numpy("float64")
            gap = at - np.where(first, newest[number], np.roll(at, 1))
            state, out = self.advance(before, number, ~(gap < self.idle), now)
            yield pd.concat([now[self.keys], out[self.gives]], axis=1)
            ends = np.append(np.flatnonzero(first)[1:], len(now)) - 1
            state = pd.concat([heads, pd.Series(now["at"].to_numpy("int64")[ends], name="newest"), state[self.carries]], axis=1)
            carried = pd.concat([carried[absent(carried, heads, self.keys)], state]) if len(carried) else state
        carried = carried[(carried["newest"] + self.idle > passed).to_numpy(bool)]
        self.waiting.put([(packed(later),)]) if len(later) else self.waiting.clear()
        self.carried.update((packed(carried),)) if len(carried) else self.carried.clear()
        times = [*([later["at"].min()] if len(later) else []), *([carried["newest"].min() + self.idle] if len(carried) else [])]
        if times:
            self.set_timer(int(min(times)))

    def close(self) -> None:
        pass


def packed(rows: pd.DataFrame) -> bytes:
    """Rows as an Arrow stream."""
    table, sink = pa.Table.from_pandas(rows, preserve_index=False).replace_schema_metadata(), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def unpacked(parts: list[bytes], columns: list[str]) -> pd.DataFrame:
    tables = [pa.ipc.open_stream(bytes(p)).read_all() for p in parts]
    return pa.concat_tables(tables, promote_options="permissive").to_pandas() if tables else pd.DataFrame(columns=columns)


def absent(carried: pd.DataFrame, heads: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Which keys of `carried` have no row in `heads`."""
    return (carried[keys].merge(heads, on=keys, how="left", indicator=True)["_merge"] == "left_only").to_numpy()


class Stitcher(InOrder):
    """The ids of `assign.stitch`, chunk by chunk; a clip's active boxes are its state."""

    waits = ["at", "chunk", "det_id", "class_name", "x1", "y1", "x2", "y2"]
    carries = ["next_id", "chunk", "boxes"]
    order = ["chunk", "det_id"]
    gives = ["chunk", "det_id", "track_id", "class_name"]

    def __init__(self, keys: list[str], idle: int, max_cost: float, first_id: int) -> None:
        super().__init__(keys, idle)
        self.max_cost, self.first_id = max_cost, first_id

    def advance(self, state: pd.DataFrame, number: np.ndarray, fresh: np.ndarray, rows: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
        cuts = np.flatnonzero(fresh | (np.diff(number, prepend=-1) > 0))
        ids, after = [], {}
        for start, end in itertools.pairwise([*cuts, len(rows)]):
            k = int(number[start])
            next_id, last, held = (self.first_id, -2, []) if fresh[start] else state.loc[k, self.carries]
            after[k], found = self.stitched((int(next_id), int(last), held), rows.iloc[start:end])
            ids.append(found)
        done = pd.DataFrame([after[k] for k in range(len(state))], columns=self.carries)
        return done, rows[["chunk", "det_id", "class_name"]].assign(track_id=np.concatenate(ids))

    def stitched(self, state: tuple, rows: pd.DataFrame) -> tuple[tuple, np.ndarray]:
        next_id, last, held = state
        boxes, ids = np.array([list(b) for b in held], float).reshape(-1, 4), []
        for chunk, now in rows.groupby("chunk", sort=True):
            here = now[BOX].to_numpy(float)
            mine = np.full(len(now), -1)
            if chunk == last + 1:
                for r, c in matched(boxes, here, self.max_cost):
                    mine[c] = r
            fresh = mine < 0
            mine[fresh] = next_id - self.first_id + np.arange(fresh.sum())
            next_id += int(fresh.sum())
            boxes = np.concatenate([boxes, np.zeros((next_id - self.first_id - len(boxes), 4))])
            boxes[mine], last = here, int(chunk)
            ids.append(mine + self.first_id)
        return (int(next_id), last, boxes.tolist()), np.concatenate(ids)


class Smoother(InOrder):
    """The filter of `kalman.smooth_tracks`; frames without a box move the filter and stay null. All
    keys of a bucket take their first rows at once, then their second ones, and so on."""

    waits = ["at", "frame_idx", "cx", "cy", "w", "h"]
    carries = ["p0", "p1", "p2", "p3", "v0", "v1", "v2", "v3", "a", "b", "c"]
    order = ["frame_idx"]
    gives = ["frame_idx", "cx", "cy", "w", "h"]

    def __init__(self, keys: list[str], idle: int, dt: float) -> None:
        super().__init__(keys, idle)
        self.dt = dt

    def advance(self, state: pd.DataFrame, number: np.ndarray, fresh: np.ndarray, rows: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
        held, dt = state[self.carries].to_numpy("float64"), self.dt
        z, out = rows[self.gives[1:]].to_numpy("float64"), np.full((len(rows), 4), np.nan)
        turn = np.arange(len(rows)) - np.searchsorted(number, number)
        order = np.argsort(turn, kind="stable")
        for at in np.split(order, np.searchsorted(turn[order], np.arange(1, turn.max() + 1))):
            k = number[at]
            held[k[fresh[at]]] = [0.0] * 8 + [P0, 0.0, P0]
            p, v, (a, b, c) = held[k, :4], held[k, 4:8], held[k, 8:].T
            p = p + dt * v
            a, b, c = a + 2 * dt * b + dt * dt * c + Q, b + dt * c, c + Q
            k1, k2 = a / (a + R), b / (a + R)
            gap = z[at] - p
            moved = np.column_stack([p, v, a, b, c])
            met = np.column_stack([p + k1[:, None] * gap, v + k2[:, None] * gap, a * (1 - k1), b * (1 - k1), c - k2 * b])
            seen = ~np.isnan(z[at, 0])
            held[k] = np.where(seen[:, None], met, moved)
            out[at[seen]] = met[seen, :4]
        done = rows[["frame_idx"]].assign(**{c: out[:, i] for i, c in enumerate(self.gives[1:])})
        return pd.DataFrame(held, columns=self.carries), done


def with_state(stream: DataFrame, keys: list[str], time: str, late: str, processor: InOrder, gives: str, buckets: int) -> DataFrame:
    """The rows that `processor` gives of a stream with the event time `time`, its keys dealt to
    `buckets` buckets, a number that must stay with a checkpoint. Rows without a key or a time
    belong to no state and are left out."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    names = [c for c in processor.waits if c != "at"]
    kinds = ", ".join(f"`{k}` {t}" for k, t in stream.dtypes if k in keys)
    whole = stream.dropna(subset=[*keys, time, *processor.order])
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    rows = whole.withWatermark(time, late).select(bucket.alias("bucket_of_keys"), *keys, time, F.unix_millis(time).alias("at"), *names)
    return rows.groupBy("bucket_of_keys").transformWithStateInPandas(processor, f"{kinds}, {gives}", "append", "eventTime")


def stitch_stream(dets: DataFrame, clip: str, time: str = "ts", *, late: str = "1 minute", idle: int = 3_600_000, max_cost: float = 0.85, first_id: int = 1000, buckets: int = 256) -> DataFrame:
    """(clip, chunk, det_id, track_id, class_name) of a stream of detections (clip, chunk, det_id,
    class_name, x1..y2, time), with the ids that `assign.stitch` gives without a tracker.

    All rows of a chunk have its time, and times grow with chunks. A chunk is taken when the
    watermark has passed it, so its rows may come in any order and in several batches within
    `late`. class_name is the detection's own. A clip that is silent for `idle` milliseconds of
    event time is forgotten, and its ids begin again.
    """
    return with_state(dets, [clip], time, late, Stitcher([clip], idle, max_cost, first_id), "chunk long, det_id long, track_id long, class_name string", buckets)


def smooth_stream(boxes: DataFrame, key: str, time: str = "ts", *, late: str = "1 minute", idle: int = 3_600_000, dt: float = 1.0, buckets: int = 256) -> DataFrame:
    """Kalman smoothing of a stream of boxes (key, frame_idx, cx, cy, w, h, time), as the batch form
    gives it: frames in order of time, also where they come out of order within `late`; null boxes
    stay null and move the filter. A track that is silent for `idle` milliseconds is forgotten."""
    return with_state(boxes, [key], time, late, Smoother([key], idle, dt), "frame_idx long, cx double, cy double, w double, h double", buckets)
