"""Sets of whole numbers as runs: masks of pixels and lists of frames, by array functions.

A run is (start, length); a set is an array of runs that are sorted, apart and not empty. The pixels
of a mask are numbered row by row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from boxframe.functions.geometry import Box

RUNS = "array<struct<start:bigint,length:bigint>>"


def let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def from_counts(counts: Column) -> Column:
    """Runs of alternating counts of pixels outside and inside, which begin outside."""
    inside = lambda c: F.struct(
        (c["at"] + c["n"]).alias("at"),
        F.when((c["i"] % 2 == 1) & (c["n"] > 0), F.struct(c["at"].alias("start"), c["n"].alias("length"))).alias("run"),
    )

    def step(acc: Column, x: Column) -> Column:
        # Counts of nought join what stands on both sides of them.
        made = inside(F.struct(acc["at"].alias("at"), x["n"].alias("n"), x["i"].alias("i")))
        last = F.try_element_at(acc["out"], F.lit(-1))
        touching = made["run"].isNotNull() & last.isNotNull() & (last["start"] + last["length"] == made["run"]["start"])
        longer = F.struct(last["start"].alias("start"), (last["length"] + made["run"]["length"]).alias("length"))
        out = (
            F.when(touching, F.concat(F.slice(acc["out"], F.lit(1), F.size(acc["out"]) - 1), F.array(longer)))
            .when(made["run"].isNotNull(), F.concat(acc["out"], F.array(made["run"])))
            .otherwise(acc["out"])
        )
        return F.struct(made["at"].alias("at"), out.alias("out"))

    numbered = F.transform(counts, lambda n, i: F.struct(n.cast("long").alias("n"), i.alias("i")))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.expr(f"cast(array() as {RUNS})").alias("out"))
    return F.aggregate(numbered, start, step, lambda a: a["out"])


def from_numbers(numbers: Column) -> Column:
    """Runs of an array of numbers in any order, repeated or not."""
    sorted_ = F.array_sort(F.array_distinct(numbers))

    def of(x: Column) -> Column:
        first = F.filter(x, lambda v, i: (i == 0) | (F.get(x, i - 1) != v - 1))
        last = F.filter(x, lambda v, i: (i == F.size(x) - 1) | (F.get(x, i + 1) != v + 1))
        return F.zip_with(first, last, lambda a, b: F.struct(a.cast("long").alias("start"), (b - a + 1).cast("long").alias("length")))

    return let(sorted_, of)


def size(runs: Column) -> Column:
    """How many numbers a set holds."""
    return F.aggregate(runs, F.lit(0).cast("long"), lambda a, r: a + r["length"])


def overlap(a: Column, b: Column) -> Column:
    """How many numbers two sets share: their sizes less that of their union, which is one pass
    over both sets' runs in order."""
    both = F.array_sort(F.concat(a, b))

    def step(acc: Column, r: Column) -> Column:
        end = r["start"] + r["length"]
        new = F.greatest(end - F.greatest(r["start"], acc["end"]), F.lit(0))
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["n"] + new).alias("n"))

    zero = F.struct(F.lit(-(1 << 62)).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    return size(a) + size(b) - F.aggregate(both, zero, step, lambda acc: acc["n"])


def mask_iou(a: Column, b: Column) -> Column:
    """The share of two masks' pixels that both hold; of two empty masks 0."""
    return let(overlap(a, b), lambda n: F.coalesce(F.try_divide(n, size(a) + size(b) - n), F.lit(0.0)))


def mask_box(runs: Column, width: Column) -> Box:
    """The tight box of a mask of rows of `width` pixels, edges included; null if it is empty."""
    end = lambda r: r["start"] + r["length"] - 1
    row = lambda at: F.floor(at / width).cast("long")
    # A run over the end of a row holds that row's last pixel and the next one's first.
    wraps = lambda r: row(r["start"]) != row(end(r))
    left = F.array_min(F.transform(runs, lambda r: F.when(wraps(r), 0).otherwise(r["start"] % width)))
    right = F.array_max(F.transform(runs, lambda r: F.when(wraps(r), width - 1).otherwise(end(r) % width)))
    top, bottom = row(F.get(runs, F.lit(0))["start"]), row(end(F.try_element_at(runs, F.lit(-1))))
    return Box(*[c.cast("double") for c in (left, top, right, bottom)])


def unpacked(masks: pd.Series, pixels: pd.Series) -> pd.Series:
    def of(mask: bytes | None, n: int) -> list[dict[str, int]] | None:
        if mask is None:
            return None
        bits = np.unpackbits(np.frombuffer(mask, np.uint8))[:n].astype(np.int8)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], bits, [0]])))
        return [{"start": int(a), "length": int(b - a)} for a, b in zip(edges[::2], edges[1::2])]

    return pd.Series([of(m, n) for m, n in zip(masks, pixels)])


def from_bits(mask: Column, pixels: Column) -> Column:
    """Runs of masks of `pixels` bits, packed eight a byte with the first in the highest bit, as
    `hooks.masks` gives them."""
    return F.pandas_udf(unpacked, RUNS)(mask, pixels)
