"""Places of rows in one order over all rows, from range partitions and the prefix sums of their counts."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxframe.streaming import shared_path

#: Parts whose counts are summed together, before the sums of such groups are.
GROUP = 256


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage: `df` written as a table below the shared folder, and read again."""
    path = shared_path(df.sparkSession, f"settled-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def counts_before(sizes: DataFrame) -> DataFrame:
    """(part, before): how many rows lie in the parts below each part of `sizes` (part, n).

    Running sums are taken in groups of `GROUP` parts; a group's total is sent to every group
    above it, and they are added there.
    """
    group = F.floor(F.col("part") / GROUP).alias("group")
    sizes = settle(sizes.select("part", "n", group))
    last = F.floor(F.max("part") / GROUP)
    above = sizes.join(F.broadcast(sizes.agg(last.alias("last"))))  # one row
    totals = above.groupBy("group", "last").agg(F.sum("n").alias("n")).where("group < last")
    lifted = totals.select("n", F.explode(F.sequence(F.col("group") + 1, "last")).alias("group"))
    lifted = lifted.groupBy("group").agg(F.sum("n").alias("lower"))
    inside = F.sum("n").over(Window.partitionBy("group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    rows = sizes.withColumn("inside", inside).join(lifted, "group", "left")
    return rows.select("part", (F.coalesce("inside", F.lit(0)) + F.coalesce("lower", F.lit(0))).alias("before"))


def ranked(rows: DataFrame, order: list[str | Column], name: str = "rank", part: str | None = None, ranges: int | None = None) -> DataFrame:
    """`rows` with `name`, the place from 0 of each row in `order` over all rows, and, if `part` is
    given, the number of its range partition under that name.

    Sampled ranges are sorted and written once with their places inside the range; what lies in the
    ranges before is joined, one row a range. Rows that are equal in `order` get different places
    in no stated order, so name enough columns. Nothing is gathered in one task or on the driver.
    """
    ranges = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    dealt = settle(dealt.withColumn("place inside", F.monotonically_increasing_id()))
    # The upper bits of the number are the partition's, the lower 33 count its rows.
    own = F.shiftright("place inside", 33)
    before = counts_before(dealt.groupBy(own.alias("part")).agg(F.count("*").alias("n")))
    before = before.select(F.col("part").alias("part of places"), F.col("before").alias("places before"))
    met = dealt.join(F.broadcast(before), own == F.col("part of places"))  # one row a range
    place = F.col("places before") + F.col("place inside").bitwiseAND((1 << 33) - 1)
    return met.select(*rows.columns, place.cast("long").alias(name), *([own.cast("long").alias(part)] if part else []))
