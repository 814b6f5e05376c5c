"""Constant-velocity Kalman smoothing of box tracks as a fold.

The eight-state filter has a block structure: position and velocity of each of cx, cy, w, h are
filtered alone and share one covariance recursion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxframe.operators.folds import let, running

DIMS = ("cx", "cy", "w", "h")
#: Initial variance, process noise and measurement noise.
P0, Q, R = 1000.0, 1.0, 10.0


def smooth_tracks(tracks: DataFrame, keys: list[str], dt: float = 1.0) -> DataFrame:
    """(keys, frame_idx, x1, y1, x2, y2) with null boxes kept null; one group per track."""
    z = [(F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2, F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")]
    row = F.struct("frame_idx", F.col("x1").isNotNull().alias("seen"), *[c.alias(n) for c, n in zip(z, DIMS)])
    grouped = tracks.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    zero = F.struct(*[F.lit(0.0).alias(f"{n}_{s}") for n in DIMS for s in "pv"], *[F.lit(v).alias(n) for n, v in (("a", P0), ("b", 0.0), ("c", P0))])

    def step(state: Column, row: Column) -> Column:
        def predict(s: Column) -> Column:
            moved = []
            for n in DIMS:
                moved += [(s[f"{n}_p"] + dt * s[f"{n}_v"]).alias(f"{n}_p"), s[f"{n}_v"].alias(f"{n}_v")]
            a = s["a"] + 2 * dt * s["b"] + dt * dt * s["c"] + Q
            return F.struct(*moved, a.alias("a"), (s["b"] + dt * s["c"]).alias("b"), (s["c"] + Q).alias("c"))

        def update(s: Column) -> Column:
            k1, k2 = s["a"] / (s["a"] + R), s["b"] / (s["a"] + R)
            fields = []
            for n in DIMS:
                y = row[n] - s[f"{n}_p"]
                fields += [(s[f"{n}_p"] + k1 * y).alias(f"{n}_p"), (s[f"{n}_v"] + k2 * y).alias(f"{n}_v")]
            return F.struct(*fields, (s["a"] * (1 - k1)).alias("a"), (s["b"] * (1 - k1)).alias("b"), (s["c"] - k2 * s["b"]).alias("c"))

        def out(s: Column) -> Column:
            cx, cy, w, h = (s[f"{n}_p"] for n in DIMS)
            box = [F.when(row["seen"], v).alias(n) for v, n in ((cx - w / 2, "x1"), (cy - h / 2, "y1"), (cx + w / 2, "x2"), (cy + h / 2, "y2"))]
            one = F.struct(row["frame_idx"].alias("frame_idx"), *box)
            return F.struct(s.alias("state"), one.alias("one"))

        return let(let(predict(state), lambda s: F.when(row["seen"], update(s)).otherwise(s)), out)

    folded = running(F.col("rows"), zero, "struct<frame_idx:bigint,x1:double,y1:double,x2:double,y2:double>", step)
    return grouped.select(*keys, F.explode_outer(folded).alias("r")).select(*keys, "r.*").where("frame_idx is not null")
