"""Writers: track and action documents, label rows and label maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxframe.sources.named_files import write_named


def write_tracks(docs: DataFrame, path: str, clip: str = "video_id") -> None:
    """`{clip}/{clip}.json`: each clip's track document, as `read_tracks` finds it."""
    name = F.format_string("%s/%s.json", F.col(clip).cast("string"), F.col(clip).cast("string"))
    write_named(docs.select(name.alias("name"), F.col("doc").alias("value")), path)


def write_actions(windows: DataFrame, path: str, people: DataFrame | None = None) -> None:
    """`{clip}_person_{id}_actions.json`: a JSON object of window keys to actions for every person.

    `people` (clip_id, track_id) are written too if they have no window, with an empty log. A
    person's file is replaced whole, so writing twice leaves what writing once does.
    """
    key = F.format_string("frames_%d_to_%d", "start_f", "end_f")
    entries = F.array_sort(F.collect_list(F.struct(F.col("start_f").alias("s"), key.alias("k"), F.col("actions").alias("a"))))
    logs = windows.groupBy("clip_id", "track_id").agg(F.to_json(F.map_from_entries(F.transform(entries, lambda e: F.struct(e["k"], e["a"]))), {"pretty": "true"}).alias("log"))
    if people is not None:
        logs = people.select("clip_id", "track_id").distinct().join(logs, ["clip_id", "track_id"], "left")
    name = F.format_string("%s_person_%s_actions.json", F.col("clip_id").cast("string"), F.col("track_id").cast("string"))
    write_named(logs.select(name.alias("name"), F.coalesce("log", F.lit("{}")).alias("value")), path)


def fixed(value: Column) -> Column:
    return F.format_string("%.4f", F.round(value, 4))


def write_label_rows(rows: DataFrame, path: str) -> None:
    rows.write.option("header", False).csv(path)


def label_map_text(labels: DataFrame) -> DataFrame:
    """Blocks of a label map, by id; there are as many rows as labels."""
    text = "item {\n  name: \"%s\"\n  label_id: %d\n  label_type: 2\n}"
    return labels.orderBy("label_id").select(F.format_string(text, "name", "label_id").alias("value"))


def write_label_map(labels: DataFrame, path: str) -> None:
    label_map_text(labels).coalesce(1).write.text(path)


def write_markers(rows: DataFrame, path: str) -> None:
    """Status markers (clip, kind, reason): `{clip}_{kind}_skipped/skip_reason.txt`. A marker that
    is written again stays one."""
    name = F.format_string("%s_%s_skipped/skip_reason.txt", F.col("clip").cast("string"), F.col("kind"))
    write_named(rows.select(name.alias("name"), F.col("reason").alias("value")), path)
