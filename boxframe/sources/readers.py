"""Readers: documents, ground truth and file listings as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boxframe.functions.geometry import from_xywh
from boxframe.functions.text import action_file, frame_rate, stem, window_range
from boxframe.sources.containers import register

BOXES = "x1", "y1", "x2", "y2"
TRACK_DOC = "detected_objects map<string, struct<class_name:string,class_id:int,track_id:bigint,bbox:array<array<double>>>>"
#: Categories that count as persons.
PERSONS = ("adult", "child", "baby")
TRUTH_DOC = (
    "video_id string, width int, height int, fps double, `subject/objects` array<struct<tid:int,category:string>>, "
    "trajectories array<array<struct<tid:int,bbox:struct<xmin:double,ymin:double,xmax:double,ymax:double>>>>, "
    "relation_instances array<struct<subject_tid:int,predicate:string,begin_fid:int,end_fid:int>>"
)


def list_files(spark: SparkSession, folder: str, glob: str = "*.{mp4,avi,mov}", recursive: bool = True) -> DataFrame:
    """(path, name, size) without reading contents; order by path where order matters."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return files.select("path", stem(F.col("path")).alias("name"), F.col("length").alias("size"))


def frames(spark: SparkSession, folder: str, glob: str = "*.jpg") -> DataFrame:
    """(clip_id, frame_idx, path): frames of each clip folder, numbered from 0 in order of name."""
    files = list_files(spark, folder, glob)
    clip = F.element_at(F.split("path", "/"), -2)
    rank = F.row_number().over(Window.partitionBy("clip_id").orderBy("path")) - 1
    return files.select(clip.alias("clip_id"), "path").withColumn("frame_idx", rank.cast("long"))


def read_tracks(spark: SparkSession, path: str) -> DataFrame:
    """Long tracks of track documents; both {clip}.json and {clip}/*.json are found."""
    docs = spark.read.schema(TRACK_DOC).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
    rows = docs.select(stem(F.input_file_name()).alias("clip_id"), F.explode("detected_objects").alias("key", "t"))
    rows = rows.select("clip_id", "key", "t.class_name", "t.class_id", "t.track_id", F.posexplode("t.bbox").alias("frame_idx", "b"))
    return rows.select("clip_id", "key", "class_name", "class_id", "track_id", "frame_idx", *[F.get("b", F.lit(i)).alias(n) for i, n in enumerate(BOXES)])


def read_actions(spark: SparkSession, path: str) -> DataFrame:
    """(clip_id, track_id, start_f, end_f, actions); values may be a string, a list, or {"action": ..}."""
    files = spark.read.option("pathGlobFilter", "*_actions.json").text(path, wholetext=True)
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    clip, track = action_file(name)
    rows = files.select(clip.alias("clip_id"), track.cast("long").alias("track_id"), F.explode(F.from_json("value", "map<string,string>")).alias("key", "v"))
    one = F.coalesce(F.get_json_object("v", "$.action"), F.col("v"))
    actions = F.coalesce(F.when(F.col("v").startswith("["), F.from_json("v", "array<string>")), F.array(one))
    start, end = window_range(F.col("key"))
    return rows.select("clip_id", "track_id", start.alias("start_f"), end.alias("end_f"), actions.alias("actions"))


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """Ground-truth documents with their defaults; those without video_id are left out."""
    docs = spark.read.schema(TRUTH_DOC).option("multiLine", True).json(path).where("video_id is not null")
    filled = {"width": F.coalesce("width", F.lit(1)), "height": F.coalesce("height", F.lit(1)), "fps": F.coalesce("fps", F.lit(30.0))}
    people = F.filter("subject/objects", lambda o: o["category"].isin(*PERSONS))
    return docs.withColumns(filled | {"persons": F.transform(people, lambda o: o["tid"])})


def truth_boxes(docs: DataFrame) -> DataFrame:
    """(video_id, tid, frame_idx, x1..y2) of the persons."""
    rows = docs.select("video_id", "persons", F.posexplode("trajectories").alias("frame_idx", "boxes"))
    rows = rows.select("video_id", "persons", "frame_idx", F.explode("boxes").alias("b")).where(F.array_contains("persons", F.col("b.tid")))
    return rows.select("video_id", "b.tid", "frame_idx", *[F.col(f"b.bbox.{n}").alias(m) for n, m in zip(("xmin", "ymin", "xmax", "ymax"), BOXES)])


def truth_relations(docs: DataFrame, predicates: list[str]) -> DataFrame:
    rows = docs.select("video_id", "persons", F.explode("relation_instances").alias("r")).where(F.col("r.predicate").isin(*predicates))
    return rows.where(F.array_contains("persons", F.col("r.subject_tid"))).select("video_id", "r.*")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(seq, idx, value): lines of each whole file, numbered from 0; seq is the file's folder."""
    files = spark.read.text(path, wholetext=True)
    seq = F.element_at(F.split(F.input_file_name(), "/"), -2)
    lines = files.select(seq.alias("seq"), F.posexplode(F.split(F.regexp_replace("value", r"\n+$", ""), "\n")).alias("idx", "value"))
    return lines.select("seq", "idx", F.trim("value").alias("value"))


def read_boxes(spark: SparkSession, path: str) -> DataFrame:
    """(seq, idx, x1..y2): `x,y,w,h` between commas or spaces; short lines and empty sizes give nulls."""
    n = F.transform(F.split(F.translate("value", ",", " "), r"\s+"), lambda x: x.try_cast("double"))
    rows = numbered_lines(spark, path).withColumn("n", n)
    good = (F.size("n") >= 4) & (F.get("n", F.lit(2)) > 0) & (F.get("n", F.lit(3)) > 0)
    b = from_xywh(*[F.get("n", F.lit(i)) for i in range(4)])
    return rows.select("seq", "idx", *[F.when(good, c).alias(m) for c, m in zip(b, BOXES)])


def read_flags(spark: SparkSession, path: str) -> DataFrame:
    """(seq, idx, flag) of a file of 0 and 1 between commas, spaces or line ends."""
    files = spark.read.text(path, wholetext=True)
    seq = F.element_at(F.split(F.input_file_name(), "/"), -2)
    flags = F.filter(F.split("value", r"[,\s]+"), lambda x: x != "")
    return files.select(seq.alias("seq"), F.posexplode(flags).alias("idx", "flag")).withColumn("flag", F.col("flag").cast("int"))


def read_sequence(spark: SparkSession, boxes: str, occlusion: str, out_of_view: str) -> DataFrame:
    """The three aligned files of each sequence, row by row."""
    out = read_boxes(spark, boxes)
    for path, name in ((occlusion, "occ"), (out_of_view, "oov")):
        out = out.join(read_flags(spark, path).withColumnRenamed("flag", name), ["seq", "idx"])
    return out


def read_clips(spark: SparkSession, folder: str, pattern: str = "*.mp4,*.avi,*.mov") -> DataFrame:
    """(path, name, size, duration, width, height, n_frames, fps, has_video) of video files, from
    their headers alone; broken files have a duration of 0 and no video."""
    register(spark)
    return clip_facts(spark.read.format("clip_headers").option("pattern", pattern).load(folder))


def frame_sizes(spark: SparkSession, folder: str, pattern: str = "*.jpg,*.jpeg,*.png") -> DataFrame:
    """(path, name, width, height) of frames, from their headers; null where they have none."""
    register(spark)
    return spark.read.format("clip_headers").option("pattern", pattern).load(folder).select("path", "name", "width", "height")


def read_markers(spark: SparkSession, path: str) -> DataFrame:
    """(clip, kind, reason) of the markers that `write_markers` left."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "skip_reason.txt").text(path, wholetext=True)
    folder = F.element_at(F.split(F.input_file_name(), "/"), -2)
    pattern = "^(.*?)_(camera_motion|too_long|[^_]+)_skipped$"
    return files.select(*[F.regexp_extract(folder, pattern, i).alias(n) for i, n in ((1, "clip"), (2, "kind"))], F.col("value").alias("reason"))


def clip_facts(probes: DataFrame) -> DataFrame:
    """Probed clips (duration, rate, banner as text; width, height, n_frames) with typed columns:
    duration in seconds (0.0 where unknown), fps (from the rate; without one, as if the clip took
    five seconds) and has_video, which says whether the banner names a video stream."""
    fps = F.coalesce(frame_rate(F.col("rate")), F.col("n_frames") / F.lit(5.0))
    has_video = F.coalesce(F.col("banner").contains("Stream") & F.col("banner").contains("Video:"), F.lit(False))
    return probes.withColumns({"duration": F.coalesce(F.col("duration").try_cast("double"), F.lit(0.0)), "fps": fps, "has_video": has_video}).drop("rate", "banner")


def first_files(files: DataFrame) -> DataFrame:
    """(folder, path): the first file by path of each folder."""
    folder = F.regexp_replace("path", "/[^/]*$", "")
    return files.groupBy(folder.alias("folder")).agg(F.min("path").alias("path"))
