"""Status markers and pending work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: The kinds of reasons that `skip_reasons` gives.
KINDS = ["camera_motion", "too_long"]


def merge_markers(status: DataFrame, clip: str) -> DataFrame:
    """One marker a clip: camera motion first, then the generic one, then any other by name."""
    order = F.when(F.col("kind") == "camera_motion", 0).when(F.col("kind") == "generic", 1).otherwise(2)
    return status.groupBy(clip).agg(F.min_by("kind", F.struct(order, "kind")).alias("kind"))


def skip_reasons(clips: DataFrame, most_frames: int = 300, moving: float = 0.1) -> DataFrame:
    """Clips (n_frames, motion) with `reason`: why a clip is skipped, null if it is not. A clip of
    under two frames or without a measured motion counts as still."""
    moved = (F.col("n_frames") >= 2) & F.coalesce(F.col("motion") > moving, F.lit(False))
    too_long = F.concat(F.lit("too_long: "), F.col("n_frames").cast("string"), F.lit(f" frames of {most_frames}"))
    camera = F.concat(F.lit("camera_motion: "), F.format_string("%.3f", F.col("motion").cast("double")))
    return clips.withColumn("reason", F.when(F.col("n_frames") > most_frames, too_long).when(moved, camera))


def markers(reasons: DataFrame, clip: str) -> DataFrame:
    """(clip, kind, reason) of the skipped clips, for `write_markers`."""
    return reasons.where("reason is not null").select(clip, F.split_part("reason", F.lit(":"), F.lit(1)).alias("kind"), "reason")


def summary(clips: DataFrame, status: DataFrame, clip: str) -> DataFrame:
    """(total, processed, skipped, camera_motion, too_long) over clips, each counted once whatever
    the number of its markers; all that carry a marker are skipped."""
    marked = merge_markers(status, clip)
    rows = clips.select(clip).distinct().join(marked, clip, "left")
    of = lambda k: F.count_if(F.col("kind") == k).alias(k)
    skipped = F.count("kind")
    return rows.agg(F.count("*").alias("total"), (F.count("*") - skipped).alias("processed"), skipped.alias("skipped"), of("camera_motion"), of("too_long"))


def pending(work: DataFrame, done: DataFrame, failed: DataFrame, key: str) -> DataFrame:
    """Work that is neither done nor marked; a null key is never done."""
    return work.join(done.select(key), key, "left_anti").join(failed.select(key), key, "left_anti")


def included(work: DataFrame, names: DataFrame, key: str) -> DataFrame:
    return work.join(names.select(key), key, "left_semi")


def missing(names: DataFrame, work: DataFrame, key: str) -> DataFrame:
    return names.select(key).distinct().join(work.select(key), key, "left_anti")


def counts_of(kinds: list[str]) -> list[Column]:
    """Counts over clips with a `reason` (null: processed): total, processed, skipped, each kind."""
    kind = F.split_part("reason", F.lit(":"), F.lit(1))
    skipped = F.count("reason")
    named = [F.count_if(F.coalesce(kind == k, F.lit(False))).alias(k) for k in kinds]
    return [F.count("*").alias("total"), (F.count("*") - skipped).alias("processed"), skipped.alias("skipped"), *named]


def observed(clips: DataFrame, kinds: list[str] = KINDS, name: str = "clips") -> tuple[DataFrame, Observation]:
    """`clips`, a row each with its `reason`, and an observation that has the run's counts once the
    first action on them is done: the summary needs no second pass."""
    observation = Observation(name)
    return clips.observe(observation, *counts_of(kinds)), observation


def observed_stream(clips: DataFrame, kinds: list[str] = KINDS, name: str = "clips") -> DataFrame:
    """A stream of clips whose counts stand in the query's progress; `observed_total` adds them."""
    return clips.observe(name, *counts_of(kinds))


def observed_total(query: StreamingQuery, name: str = "clips") -> dict[str, int]:
    """The counts of all batches that the query's progress still holds."""
    total: dict[str, int] = {}
    for progress in query.recentProgress:
        counts = progress["observedMetrics"].get(name)
        for key, n in counts.asDict().items() if counts else ():
            total[key] = total.get(key, 0) + n
    return total
