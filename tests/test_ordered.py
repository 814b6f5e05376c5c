"""Keyed stream state by buckets, against plain Python."""

import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from boxframe import streaming
from boxframe.operators.kalman import P0, Q, R
from boxframe.streaming import ordered


def filtered(rows, idle):
    """(t, first coordinate or None) of one track, by a filter that begins anew after silence."""
    out, before = {}, None
    for t, z in sorted(rows):
        if before is None or t - before >= idle:
            p, v, a, b, c = 0.0, 0.0, P0, 0.0, P0
        before = t
        p, a, b, c = p + v, a + 2 * b + c + Q, b + c, c + Q
        if z is not None:
            k1, k2, gap = a / (a + R), b / (a + R), z - p
            p, v, a, b, c = p + k1 * gap, v + k2 * gap, a * (1 - k1), b * (1 - k1), c - k2 * b
        out[t] = None if z is None else p
    return out


def test_tracks_that_share_a_bucket(spark):
    """Tracks of one and of many rows, silent ones and absent boxes, in two buckets."""
    rng = random.Random(5)
    tracks = {f"t{i}": [(t, None if rng.random() < 0.2 else float(rng.randrange(90))) for t in rng.sample(range(300), rng.choice([1, 5, 60]))] for i in range(30)}
    rows = [(k, t, z, 1.0, 2.0, 3.0) if z is not None else (k, t, None, None, None, None) for k, own in tracks.items() for t, z in own]
    d = spark.createDataFrame(rows, "key string, frame_idx long, cx double, cy double, w double, h double").withColumn("ts", F.timestamp_millis(1_700_000_000_000 + F.col("frame_idx") * 1000))
    smooth = ordered.smooth_stream(streaming.replayed(d, "ts", 2), "key", late="365 days", idle=20_000, buckets=2)
    got = {(r.key, r.frame_idx): r.cx for r in streaming.run_to_table(smooth, "append").where("key <> ''").collect()}
    want = {(k, t): p for k, own in tracks.items() for t, p in filtered(own, 20).items()}
    assert got.keys() == want.keys()
    for at, p in want.items():
        assert (p is None) == (got[at] is None) and (p is None or abs(got[at] - p) < 1e-9)


def test_state_is_kept_packed():
    rows = pd.DataFrame({"key": ["a", "b"], "at": [1, 2], "boxes": [[[1.0, 2.0]], []]})
    back = ordered.unpacked([ordered.packed(rows), ordered.packed(rows.assign(boxes=None))], list(rows))
    assert back["key"].tolist() == ["a", "b", "a", "b"] and [list(b) for b in back["boxes"][0]] == [[1.0, 2.0]] and back["boxes"][2] is None
    assert ordered.absent(rows, rows[1:][["key"]], ["key"]).tolist() == [True, False] and np.all(ordered.unpacked([], ["at"]).columns == ["at"])
