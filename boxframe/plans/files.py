"""Registered queries over files that are written from the tables and read again."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from boxframe.operators import tracks as K
from boxframe.plans.queries import ACTIONS, KEYS, NESTED, _actions, query
from boxframe.plans.views import table, tracks
from boxframe.sources import named_files, readers, writers
from boxframe.sources.containers import small_movie
from boxframe.streaming import shared_path


@query(f"""with {NESTED}, lo as (select video_id, min(frame_idx) lo from dense group by 1) select n.video_id::varchar clip_id, "key", class_name, track_id, (frame_idx - lo)::int frame_idx, x1, y1, x2, y2 from n join lo using (video_id)""")
def track_files(spark, sf):
    """Track documents, one file a clip, written and read back."""
    docs = K.nest(tracks(spark, sf).where("has_box"), 1920, 1080)
    folder = shared_path(spark, "tracks")
    writers.write_tracks(docs, folder)
    return readers.read_tracks(spark, folder).select("clip_id", "key", "class_name", "track_id", "frame_idx", "x1", "y1", "x2", "y2")


@query(f"select video_id::varchar clip_id, track_id, start_f::int start_f, end_f::int end_f, array_to_string(list_sort(actions), ',') actions from (with {ACTIONS} select * from ov)")
def action_files(spark, sf):
    """Action logs, one file a person, empty ones too; what is read back are all windows."""
    rows = _actions(spark, sf).withColumnRenamed("video_id", "clip_id")
    people = tracks(spark, sf).select(F.col("video_id").alias("clip_id"), "track_id").distinct()
    folder = shared_path(spark, "actions")
    writers.write_actions(rows, folder, people)
    return readers.read_actions(spark, folder).select("clip_id", "track_id", "start_f", "end_f", F.array_join(F.array_sort("actions"), ",").alias("actions"))


@query("""select 'clip' || s_suppkey as name, case when s_suppkey % 11 = 0 then 0.0 else (s_suppkey % 5000) / 1000.0::double end duration, case when s_suppkey % 11 = 0 then null else (640 + s_nationkey)::int end width,
case when s_suppkey % 11 = 0 or s_suppkey % 5 = 0 then null else (s_suppkey % 300 + 1)::bigint end n_frames, case when s_suppkey % 11 = 0 or s_suppkey % 5 = 0 then null when s_suppkey % 2 = 0 then 25.0::double else round(30000 / 1001::double, 6) end fps,
s_suppkey % 11 <> 0 and s_suppkey % 5 <> 0 has_video from supplier""".replace("case when s_suppkey % 11 = 0 then null else (640", "case when s_suppkey % 11 = 0 or s_suppkey % 5 = 0 then null else (640"))
def clip_headers(spark, sf):
    """Headers of files made of the suppliers: with video, with sound only, and broken ones."""

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            films = []
            for k, nation in zip(b.s_suppkey.tolist(), b.s_nationkey.tolist()):
                step, scale = (1000, 25_000) if k % 2 == 0 else (1001, 30_000)
                film = small_movie(k % 5000 / 1000, k % 300 + 1, step, scale, 640 + nation, 480, video=k % 5 != 0)
                films.append(film[: len(film) // 2] if k % 11 == 0 else film)
            yield pd.DataFrame({"name": [f"{k % 7}/clip{k}.mp4" for k in b.s_suppkey], "value": films})

    folder = shared_path(spark, "films")
    named_files.write_named(table(spark, sf, "supplier").select("s_suppkey", "s_nationkey").mapInPandas(made, "name string, value binary"), folder)
    return readers.read_clips(spark, folder).select("name", "duration", "width", "n_frames", F.round("fps", 6).alias("fps"), "has_video")
