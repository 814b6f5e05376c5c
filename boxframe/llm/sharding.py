"""Consistent-hash ring with virtual nodes and bounded loads, by DataFrame operations."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxframe.llm.common import text_of
from boxframe.operators.ranks import ranked


def ring(n_shards: int, vnodes: int, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, owners) of the virtual nodes on a ring of `cells` places, clockwise."""
    names = [(zlib.crc32(f"shard {s} node {v}".encode()) * cells >> 32, s) for s in range(n_shards) for v in range(vnodes)]
    at, owner = np.array(sorted(names)).T
    return at, owner


def clockwise(n_shards: int, vnodes: int, cells: int) -> np.ndarray:
    """For every cell, the shards in the order in which a walk clockwise from it meets them."""
    at, owner = ring(n_shards, vnodes, cells)
    order = []
    for i in range(len(at)):
        order.append(list(dict.fromkeys(np.roll(owner, -i).tolist())))
    return np.array(order)[np.searchsorted(at, np.arange(cells)) % len(at)]


def fill(counts: np.ndarray, n_shards: int, vnodes: int) -> pa.Table:
    """Where each cell's keys go: rows (cell, low, high, shard, first) for ranks low to high - 1.

    Capacities are the exact quotas (the total over the shards, the remainder to the first
    ones), so a full shard sends what overflows on clockwise and all end at most one apart.
    Cells come in an order scattered over the ring, so no arc is favoured.
    """
    cells, total = len(counts), int(counts.sum())
    room = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    used = [0] * n_shards
    walk, rows = clockwise(n_shards, vnodes, cells).tolist(), []
    for cell in np.argsort(np.arange(cells, dtype=np.uint32) * np.uint32(2654435761), kind="stable").tolist():
        low, left = 0, int(counts[cell])
        for shard in walk[cell]:
            if not left:
                break
            if take := min(left, room[shard]):
                rows.append((cell, low, low + take, shard, used[shard]))
                room[shard] -= take
                used[shard] += take
                low, left = low + take, left - take
    columns = list(zip(*rows)) or [()] * 5
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
    return pa.table({n: pa.array(c, k) for n, c, k in zip(("cell", "low", "high", "shard", "first"), columns, kinds)})


def ring_shards(
    docs: DataFrame,
    n_shards: int = 16,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    vnodes: int = 64,
    cells: int = 1 << 16,
) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, shard_if_grown), one row per document.

    A document's place on the ring is the hash of its id. Bounded loads at load factor 1: the
    law is `rows` (counts at most one apart). Only the counts of the ring's cells (at most
    `cells` numbers) reach the driver, which walks them round the ring; documents then take
    their shard by their rank within their cell. Ranks come from range partitions over all rows,
    so rows that repeat one id, and so share a cell, are dealt over tasks. The plan joined back has at most
    cells + shards^2 rows, so it is broadcast. Use more cells for more than about 10^10 rows.

    `shard_if_grown` is the shard by the same ring with one more shard; `grown_shard` is null
    under this law. Null texts have size 1 and checksum 0; documents without id are placed by
    their text; equal rows get slots of their own; an empty table gives no rows. Very long texts
    are read in the first scan only; other columns are not carried.
    """
    spark = docs.sparkSession
    raw = text_of(text_col).cast("binary")
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text_of(text_col)) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.xxhash64(F.col(id_col), F.when(F.col(id_col).isNull(), F.col(text_col))).alias("place"),
    ).withColumn("cell", F.pmod(F.shiftright("place", 20), F.lit(cells)).cast("int"))
    counts = np.zeros(cells, np.int64)
    for cell, n in rows.groupBy("cell").count().collect():
        counts[cell] = n
    plan = fill(counts, n_shards, vnodes)
    begins = np.cumsum(counts) - counts  # cells follow each other in the order of places
    plan = plan.append_column("begin", pa.array(begins[plan.column("cell").to_numpy()], pa.int64()))
    now = F.broadcast(spark.createDataFrame(plan))
    grown = fill(counts, n_shards + 1, vnodes).select(["cell", "low", "high", "shard"]).rename_columns(["cell", "low_g", "high_g", "shard_if_grown"])
    placed = ranked(rows, ["cell", "place", "doc_id", "text_crc32", "size"], "whole place")
    within = placed.join(now, "cell").withColumn("rank", F.col("whole place") - F.col("begin")).where("rank >= low and rank < high")
    within = within.join(F.broadcast(spark.createDataFrame(grown)), "cell").where("rank >= low_g and rank < high_g")
    return within.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        (F.col("first") + F.col("rank") - F.col("low")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "shard_if_grown",
    )
