"""Registered queries of the operators that go through clips in order, as tables and as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from boxframe import streaming
from boxframe.operators import loop
from boxframe.operators import tracks as K
from boxframe.plans.queries import _ten, query, rounded
from boxframe.plans.views import table, tracks
from boxframe.streaming import ordered


@query()
def track_loop(spark, sf):
    """Detections in each chunk's first frame, matched and followed; boxes drift as a stand-in for a tracker."""
    ends = tracks(spark, sf).groupBy(F.floor(F.col("track_id") / 10).cast("long").alias("video_id")).agg((F.max("frame_idx") + 1).alias("n_frames"))
    found = loop.track_clips(_ten(spark, sf).join(ends, "video_id"), "video_id", loop.Drift)
    return loop.newest_class(found, "video_id")


@query()
def stream_stitch(spark, sf):
    """Ids kept from chunk to chunk over a stream whose rows come out of order; tests compare it with `stitch_tracks`."""
    dets = _ten(spark, sf).withColumn("ts", F.timestamp_millis(F.lit(1_700_000_000_000) + F.col("chunk") * 1000))
    ids = ordered.stitch_stream(streaming.replayed(dets, "ts"), "video_id", late="365 days")
    return streaming.run_to_table(ids, "append").where("video_id >= 0").select("video_id", "chunk", "det_id", "track_id")


@query()
def stream_kalman(spark, sf):
    """The smoother over a stream of boxes, some absent; tests compare it with the batch form."""
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    has = F.col("event_id") % 9 != 0
    boxes = [F.when(has, c).alias(n) for c, n in ((200 + k, "cx"), (100 + k / 2, "cy"), (80 + k % 40, "w"), (120 + k % 60, "h"))]
    rows = e.select(F.col("user_id").alias("track_id"), F.col("event_id").alias("frame_idx"), *boxes, F.timestamp_millis(F.lit(1_700_000_000_000) + F.col("event_id") * 1000).alias("ts"))
    out = streaming.run_to_table(ordered.smooth_stream(streaming.replayed(rows, "ts"), "track_id", late="365 days"), "append")
    return out.where("track_id >= 0").select("track_id", "frame_idx", *rounded(["cx", "cy", "w", "h"], 4))


SESSIONS = """with o as (select user_id, ts, lag(ts) over (partition by user_id order by ts) b from events),
g as (select user_id, ts, sum(case when b is null or ts >= b + interval 12 hour then 1 else 0 end) over (partition by user_id order by ts rows unbounded preceding) s from o)
select user_id, min(ts)::timestamp::varchar as "start", (max(ts) + interval 12 hour)::timestamp::varchar as "end", count(*) n from g group by user_id, s"""


def _sessions(counts):
    return counts.select("user_id", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c) for c in ("start", "end")], "n")


def _sessions_sql():
    return f"""select user_id, strftime("start"::timestamp, '%Y-%m-%d %H:%M:%S.%f') as "start", strftime("end"::timestamp, '%Y-%m-%d %H:%M:%S.%f') as "end", n from ({SESSIONS})"""


@query(_sessions_sql())
def user_sessions(spark, sf):
    """Each user's events in sessions that end with twelve silent hours."""
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return _sessions(streaming.session_counts(e, "user_id", "12 hours"))


@query(_sessions_sql())
def stream_sessions(spark, sf):
    """The same sessions of a stream, each given once, when the watermark has passed its end."""
    e = table(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    counts = streaming.session_counts(streaming.replayed(e, "ts"), "user_id", "12 hours", "3650 days")
    return _sessions(streaming.run_to_table(counts, "append").where("user_id >= 0"))
