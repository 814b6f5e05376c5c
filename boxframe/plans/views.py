"""Adapter views: detections and tracks made from the test tables, alike in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted box x1..y2 (null where has_box is false) and true box gx1..gy2 per track and frame."""
    order = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    e = table(spark, sf_dir, "events").select(
        "user_id", "event_id", "event_type", "ts", order.cast("long").alias("f"), F.get_json_object("props", "$.k").cast("long").alias("k")
    )
    f, k, i = F.col("f"), F.col("k"), F.col("event_id")
    has = k % 10 != 0
    d = lambda c: c.cast("double")
    return e.select(
        F.floor(F.col("user_id") / 10).cast("long").alias("video_id"),
        F.col("user_id").alias("track_id"),
        F.col("event_type").alias("class_name"),
        "event_id",
        "ts",
        f.alias("frame_idx"),
        "k",
        has.alias("has_box"),
        F.when(has, d(200 + 5 * f + k)).alias("x1"),
        F.when(has, d(100 + 3 * f + (k * 7) % 50)).alias("y1"),
        F.when(has, d(200 + 5 * f + k + 80 + k % 40)).alias("x2"),
        F.when(has, d(100 + 3 * f + (k * 7) % 50 + 120 + (k * 3) % 60)).alias("y2"),
        d(205 + 5 * f + i % 30).alias("gx1"),
        d(104 + 3 * f + i % 20).alias("gy1"),
        d(305 + 5 * f + i % 30).alias("gx2"),
        d(254 + 3 * f + i % 20).alias("gy2"),
        (F.col("event_type") == "error").cast("int").alias("occ"),
        ((F.col("event_type") == "signup") & (k < 20)).cast("int").alias("oov"),
    )


TRACKS = """e0 as (select *, cast(row_number() over (partition by user_id order by ts, event_id) - 1 as bigint) f,
  cast(json_extract_string(props, '$.k') as bigint) k from events),
tracks as (select user_id // 10 video_id, user_id track_id, event_type class_name, event_id, ts, f frame_idx, k, k % 10 <> 0 has_box,
  case when k % 10 <> 0 then cast(200+5*f+k as double) end x1, case when k % 10 <> 0 then cast(100+3*f+(k*7)%50 as double) end y1,
  case when k % 10 <> 0 then cast(200+5*f+k+80+k%40 as double) end x2, case when k % 10 <> 0 then cast(100+3*f+(k*7)%50+120+(k*3)%60 as double) end y2,
  cast(205+5*f+event_id%30 as double) gx1, cast(104+3*f+event_id%20 as double) gy1,
  cast(305+5*f+event_id%30 as double) gx2, cast(254+3*f+event_id%20 as double) gy2,
  cast(event_type='error' as int) occ, cast(event_type='signup' and k<20 as int) oov from e0)"""


def crowded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same tracks in fifteen videos, each with a fifteenth of all tracks."""
    return tracks(spark, sf_dir).withColumn("video_id", F.col("track_id") % 15)


CROWDED = TRACKS.replace("user_id // 10 video_id", "user_id % 15 video_id")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_quantity"))
    p, s = F.col("l_partkey") * 13 % 200, F.col("l_suppkey") * 17 % 200
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("video_id"),
        rank.cast("long").alias("det_id"),
        F.col("l_returnflag").alias("class_name"),
        (F.lit(1.0) - 5 * F.col("l_discount")).alias("confidence"),
        p.cast("double").alias("x1"),
        s.cast("double").alias("y1"),
        (p + 60 + F.col("l_linenumber") * 20).cast("double").alias("x2"),
        (s + 60 + F.col("l_quantity")).cast("double").alias("y2"),
    )


DET = """det as (select l_orderkey video_id, cast(row_number() over (partition by l_orderkey
  order by l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_quantity) as bigint) det_id, l_returnflag class_name, 1.0::double - 5 * l_discount confidence,
  cast((l_partkey*13)%200 as double) x1, cast((l_suppkey*17)%200 as double) y1,
  cast((l_partkey*13)%200 + 60 + l_linenumber*20 as double) x2, cast((l_suppkey*17)%200 + 60 + l_quantity as double) y2 from lineitem)"""


def iou_sql(a: str = "", b: str = "g") -> str:
    """IoU of boxes with these prefixes (both with area)."""
    inter = f"(greatest(least({a}x2, {b}x2) - greatest({a}x1, {b}x1), 0.0) * greatest(least({a}y2, {b}y2) - greatest({a}y1, {b}y1), 0.0))"
    size = lambda p: f"(({p}x2 - {p}x1) * ({p}y2 - {p}y1))"
    return f"({inter} / ({size(a)} + {size(b)} - {inter}))"


def inter_sql(a: str, b: str) -> str:
    return f"(greatest(least({a}x2, {b}x2) - greatest({a}x1, {b}x1), 0.0) * greatest(least({a}y2, {b}y2) - greatest({a}y1, {b}y1), 0.0))"


def distance_sql(a: str = "", b: str = "g") -> str:
    return f"sqrt(pow(({a}x1+{a}x2)/2 - ({b}x1+{b}x2)/2, 2) + pow(({a}y1+{a}y2)/2 - ({b}y1+{b}y2)/2, 2))"
