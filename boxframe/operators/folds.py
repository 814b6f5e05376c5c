"""Folds over arrays that give one value for each element."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Values gather in blocks of this size, so that a long fold does not copy all of them at each step.
BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(rows: Column, state: Column, kind: str, step: Callable[[Column, Column], Column]) -> Column:
    """An array of `kind`, one value for each of `rows`: step(state, row) gives a struct of the next
    `state` and the row's value `one`. Each value is copied about BLOCK / 2 times within its
    block, and each block's reference once for each block after it."""
    none = F.expr(f"cast(array() as array<{kind}>)")

    def inner(acc: Column, row: Column) -> Column:
        return let(step(acc["state"], row), lambda s: F.struct(s["state"].alias("state"), F.concat(acc["out"], F.array(s["one"])).alias("out")))

    def outer(acc: Column, at: Column) -> Column:
        done = F.aggregate(F.slice(rows, at * BLOCK + 1, F.lit(BLOCK)), F.struct(acc["state"].alias("state"), none.alias("out")), inner)
        return let(done, lambda d: F.struct(d["state"].alias("state"), F.concat(acc["out"], F.array(d["out"])).alias("out")))

    blocks = F.sequence(F.lit(0), F.greatest(F.floor((F.size(rows) - 1) / BLOCK), F.lit(0)).cast("int"))
    start = F.struct(state.alias("state"), F.expr(f"cast(array() as array<array<{kind}>>)").alias("out"))
    return F.aggregate(blocks, start, outer, lambda acc: F.flatten(acc["out"]))
