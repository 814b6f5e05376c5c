"""Track tables: densify, nest, unnest, ids, windows, chunks and clips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxframe.functions.geometry import area, box, normalised
from boxframe.functions.text import natural_key, samples
from boxframe.operators.ranks import ranked

BOX = ("x1", "y1", "x2", "y2")
#: So many objects of windows with the same sampled frames stand in a block; a multiple of 8, as files pack
#: numbers by eights, so that a list's repetitions are the same bytes.
BLOCK_OBJECTS = 1008


def densify(tracks: DataFrame, clip: str = "video_id", track: str = "track_id") -> DataFrame:
    """A row for every track and every frame of its clip's range, with null boxes in the gaps."""
    spans = tracks.groupBy(clip).agg(F.min("frame_idx").alias("low"), F.max("frame_idx").alias("high"))
    ids = tracks.select(clip, track).distinct()
    grid = ids.join(spans, clip).select(clip, track, F.explode(F.sequence("low", "high")).alias("frame_idx"))
    return grid.join(tracks.select(clip, track, "frame_idx", *BOX), [clip, track, "frame_idx"], "left")


def nest(tracks: DataFrame, width: float, height: float, clip: str = "video_id") -> DataFrame:
    """One track document per clip: JSON of {class}_{id} to class, id and boxes by frame, with
    coordinates in shares of the image."""
    dense = densify(tracks, clip).join(tracks.select(clip, "track_id", "class_name").groupBy(clip, "track_id").agg(F.min("class_name").alias("class_name")), [clip, "track_id"])
    b = normalised(box(), width, height)
    one = F.when(F.col("x1").isNotNull(), F.array(*b))
    rows = F.array_sort(F.collect_list(F.struct("frame_idx", one.alias("b"))))
    each = dense.groupBy(clip, "track_id", "class_name").agg(F.transform(rows, lambda r: r["b"]).alias("bbox"))
    key = F.concat_ws("_", "class_name", "track_id")
    entry = F.struct(key.alias("key"), F.struct("class_name", "track_id", "bbox").alias("value"))
    entries = F.array_sort(F.collect_list(entry))
    return each.groupBy(clip).agg(F.to_json(F.struct(F.map_from_entries(entries).alias("detected_objects"))).alias("doc"))


DOCUMENT = "detected_objects map<string, struct<class_name:string,track_id:bigint,bbox:array<array<double>>>>"


def unnest(docs: DataFrame, clip: str = "video_id") -> DataFrame:
    """The long form of track documents: one row per track and frame; a missing key gives none."""
    entries = docs.select(clip, F.explode(F.from_json("doc", DOCUMENT)["detected_objects"]).alias("key", "t"))
    rows = entries.select(clip, "key", "t.class_name", "t.track_id", F.posexplode("t.bbox").alias("frame_idx", "b"))
    coordinates = [F.get("b", F.lit(i)).alias(n) for i, n in enumerate(BOX)]
    return rows.select(clip, "key", "class_name", "track_id", F.col("frame_idx").cast("long"), *coordinates)


def document_frames(docs: DataFrame, clip: str = "video_id") -> DataFrame:
    """(clip, n_frames): the longest list of boxes in each track document; 0 without tracks."""
    lists = F.transform(F.map_values(F.from_json("doc", DOCUMENT)["detected_objects"]), lambda t: F.size(t["bbox"]))
    return docs.select(clip, F.coalesce(F.array_max(lists), F.lit(0)).cast("long").alias("n_frames"))


def by_frame(tracks: DataFrame, clip: str = "video_id") -> DataFrame:
    """(clip, frame_idx, people): the frame-major form, a map of every track of the clip to its box
    (null: none) for every frame of the clip's range."""
    one = F.when(F.col("x1").isNotNull(), F.struct(*BOX))
    entries = F.array_sort(F.collect_list(F.struct("track_id", one.alias("box"))))
    return densify(tracks, clip).groupBy(clip, "frame_idx").agg(F.map_from_entries(entries).alias("people"))


def by_track(frames: DataFrame, clip: str = "video_id") -> DataFrame:
    """The inverse of `by_frame`: a row for every track and frame, also where a map lacks the track."""
    rows = frames.select(clip, "frame_idx", F.explode("people").alias("track_id", "b"))
    return densify(rows.select(clip, "track_id", "frame_idx", *[F.col(f"b.{c}").alias(c) for c in BOX]), clip)


def seed_override(dense: DataFrame, seeds: DataFrame, keys: list[str], least_area: float = 50.0) -> DataFrame:
    """Frame 0 takes the detector's box; later frames the tracker's, if it is large enough."""
    mine = box()
    own = F.col("frame_idx") == 0
    big = area(mine) > least_area
    s = seeds.select(*keys, *[F.col(c).alias("s_" + c) for c in BOX])
    chosen = [F.when(own, F.col("s_" + c)).when(big, F.col(c)).alias(c) for c in BOX]
    return dense.join(s, keys, "left").select(*keys, "frame_idx", *chosen)


def seeded_tracks(segments: DataFrame, seeds: DataFrame, clips: DataFrame, class_ids: DataFrame, clip: str = "video_id", least_area: float = 50.0) -> DataFrame:
    """(clip, track_id, class_name, class_id, frame_idx, x1..y2): the tracks of clips whose objects
    are detected once, in frame 0, and followed from there; frames 0 to n_frames - 1 of each.

    segments (clip, track_id, class_name, frame_idx, x1..y2) are the tracker's boxes, seeds (clip,
    track_id, class_name, class_id, x1..y2) the detector's. A seeded track has the seed's box in
    frame 0; else boxes over `least_area` count. A track that is first seen later has nulls before
    that and the class_id of `class_ids` (class_name, class_id), 999 if that has none; one without
    any such box is no track. clips: (clip, n_frames).
    """
    seeded = seeds.select(clip, "track_id", "class_name", "class_id", *[F.col(c).alias("s_" + c) for c in BOX])
    boxes = segments.where(area(box()) > least_area)
    late = boxes.groupBy(clip, "track_id").agg(F.min("class_name").alias("class_name")).join(seeded, [clip, "track_id"], "left_anti")
    late = late.join(class_ids.select("class_name", "class_id"), "class_name", "left").withColumn("class_id", F.coalesce("class_id", F.lit(999)))
    every = seeded.unionByName(late, allowMissingColumns=True).withColumn("seeded", F.col("s_x1").isNotNull())
    grid = every.join(clips.where("n_frames > 0").select(clip, "n_frames"), clip)
    grid = grid.withColumn("frame_idx", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_frames").cast("long") - 1)))
    met = grid.join(boxes.select(clip, "track_id", "frame_idx", *BOX), [clip, "track_id", "frame_idx"], "left")
    own = F.col("seeded") & (F.col("frame_idx") == 0)
    chosen = [F.when(own, F.col("s_" + c)).otherwise(F.col(c)).alias(c) for c in BOX]
    return met.select(clip, "track_id", "class_name", F.col("class_id").cast("int").alias("class_id"), "frame_idx", *chosen)


def sliding_windows(tracks: DataFrame, keys: list[str], size: int = 30, stride: int = 15) -> DataFrame:
    """(keys, start_f, end_f): whole windows only; shorter tracks have none."""
    n = tracks.groupBy(*keys).agg((F.max("frame_idx") + 1).alias("n")).where(F.col("n") >= size)
    starts = F.explode(F.sequence(F.lit(0), (F.col("n") - size).cast("int"), F.lit(stride)))
    return n.select(*keys, starts.alias("start_f")).select(*keys, "start_f", (F.col("start_f") + size - 1).alias("end_f"))


def window_samples(tracks: DataFrame, keys: list[str], size: int = 30, stride: int = 15, k: int = 15) -> DataFrame:
    """k frames of each window, joined with the boxes there (null if none)."""
    windows = sliding_windows(tracks, keys, size, stride)
    picks = windows.select(*keys, "start_f", F.posexplode(samples(F.lit(size), k)).alias("sample", "at"))
    picks = picks.select(*keys, "start_f", "sample", (F.col("start_f") + F.col("at")).cast("long").alias("frame_idx"))
    return picks.join(tracks.select(*keys, "frame_idx", *BOX), [*keys, "frame_idx"], "left")


def relevant_objects(sampled: DataFrame, boxes: DataFrame, clip: str, keys: list[str], person: str = "person_") -> DataFrame:
    """(keys, start_f, other): objects with a box in a sampled frame of the window. boxes: (clip,
    frame_idx, key, x1); keys that begin with `person` are no objects.

    Windows of a clip with the same sampled frames have the same objects: these are sought once for
    each such set of frames and then given to its windows, so no row is met twice. As the result has
    a row for every window and object of it, a set's objects are dealt to blocks of `BLOCK_OBJECTS`
    (places within parts by hash) and its windows meet one block after the other, in tasks by block:
    no task has all of a set, a window's rows of a block are few enough for memory, and files store
    the repeated list of objects in a small part of a byte a row.
    """
    things = boxes.where(F.col("x1").isNotNull() & ~F.col("key").startswith(person)).select(clip, "frame_idx", F.col("key").alias("other"))
    windows = sampled.groupBy(clip, *[k for k in keys if k != clip], "start_f").agg(F.array_sort(F.collect_set("frame_idx")).alias("frames"))
    each = [clip, "frames"]
    sets = windows.select(*each).distinct()
    found = sets.withColumn("frame_idx", F.explode("frames")).join(things, [clip, "frame_idx"]).select(*each, "other").distinct()
    sizes = found.groupBy(*each).agg(F.ceil(F.count("*") / (64 * BLOCK_OBJECTS)).alias("parts"))
    parted = found.join(sizes, each).select(*each, F.pmod(F.xxhash64("other"), "parts").alias("part"), "other")
    place = F.row_number().over(Window.partitionBy(*each, "part").orderBy("other")) - 1
    objects = parted.withColumn("block", F.floor(place / BLOCK_OBJECTS))
    block = [*each, "part", "block"]
    dealt = windows.join(objects.select(*block).distinct(), each)
    # Both sides are small beside the result: a number of tasks by their bytes would be too low.
    tasks = int(sampled.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = dealt.repartition(tasks, *block).join(objects.repartition(tasks, *block), block)
    return met.select(*keys, "start_f", "other")


def present_windows(sampled: DataFrame, keys: list[str], missing: float = 7.5) -> DataFrame:
    grouped = sampled.groupBy(*keys, "start_f").agg(F.count_if(F.col("x1").isNull()).alias("n_missing"))
    return grouped.where(F.col("n_missing") <= missing)


def present_samples(sampled: DataFrame, keys: list[str], missing: float = 7.5) -> DataFrame:
    """The sampled rows of the windows that `present_windows` keeps, without a join with these."""
    absent = F.count_if(F.col("x1").isNull()).over(Window.partitionBy(*keys, "start_f"))
    return sampled.withColumn("n_missing", absent).where(F.col("n_missing") <= missing)


def chunk_of(frame: Column, size: int = 30) -> Column:
    return F.floor(frame / size).cast("long")


def partition_scenes(scenes: DataFrame, keys: list[str], limit: float = 10.0) -> DataFrame:
    """Scenes longer than `limit` seconds in blocks of it and a remainder; others whole, part null."""
    good = scenes.where("duration > 0")
    blocks = F.ceil(F.col("duration") / limit).cast("int")
    part = F.when(F.col("duration") > limit, F.sequence(F.lit(1), blocks)).otherwise(F.array(F.lit(None).cast("int")))
    rows = good.select(*keys, "duration", F.explode(part).alias("part"))
    start = F.coalesce((F.col("part") - 1) * limit, F.lit(0.0))
    length = F.when(F.col("part").isNull(), F.col("duration")).otherwise(F.least(F.lit(limit), F.col("duration") - start))
    return rows.select(*keys, "part", start.alias("start_sec"), length.alias("length_sec"))


def running_offset(clips: DataFrame, clip: str, order: str, length: str) -> DataFrame:
    before = Window.partitionBy(clip).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return clips.withColumn("offset", F.coalesce(F.sum(length).over(before), F.lit(0)))


def clip_offset_frames(start_sec: Column, part: Column, fps: Column, seconds: float = 10.0) -> Column:
    """First frame of a clip in its video; halves round to even."""
    at = F.coalesce(start_sec, F.lit(0.0)) + F.coalesce((part - 1) * seconds, F.lit(0.0))
    return F.rint(at * fps).cast("long")


def even_chunks(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """Contiguous chunks 0 to n - 1 of the rows in order; the first (count mod n) have one more.
    Rows have their places from `ranks.ranked`, so no task sees all of them."""
    total = rows.agg(F.count("*").alias("total of rows"))  # one row
    placed = ranked(rows, order, "place of row").join(F.broadcast(total))
    place, large, size = F.col("place of row"), F.col("total of rows") % n, F.floor(F.col("total of rows") / n)
    edge = large * (size + 1)
    chunk = F.when(place < edge, F.floor(place / (size + 1))).otherwise(large + F.floor((place - edge) / F.greatest(size, F.lit(1))))
    return placed.select(*rows.columns, chunk.cast("long").alias("chunk"))


def first_seen_ids(rows: DataFrame, label: str, order: list[str]) -> DataFrame:
    """(label, label_id): numbers from 1 in the order in which the labels first appear."""
    first = rows.groupBy(label).agg(F.min(F.struct(*order)).alias("first"))
    return ranked(first, ["first"], "place").select(label, (F.col("place") + 1).alias("label_id"))


def in_natural_order(files: DataFrame, name: str) -> DataFrame:
    """`files` with `place`, from 0 in natural order of their names; equal keys by name."""
    keyed = files.withColumn("natural key", natural_key(F.col(name)))
    return ranked(keyed, ["natural key", name], "place").drop("natural key")


def keyframe(start: Column, end: Column, last: Column) -> Column:
    return F.least(start + F.floor((end - start) / 2), last)
