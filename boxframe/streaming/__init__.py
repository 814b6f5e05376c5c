"""Structured Streaming forms of the window operators; keyed state is in `ordered`."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder below the session's spark.checkpoint.dir, or, in local mode
    only, below a temporary one if none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", "")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def event_stream(spark: SparkSession, sf_dir: str, name: str = "events", files: int = 16) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    return source.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


def run_to_table(stream: DataFrame, mode: str) -> DataFrame:
    """Run until the source is read, and give the result as a table: every batch's rows (append)
    or the last batch's (complete)."""
    spark = stream.sparkSession
    out = shared_path(spark, "stream")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/rows/{'last' if mode == 'complete' else number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).option("recursiveFileLookup", True).parquet(f"{out}/rows")


def sliding_counts(stream: DataFrame, size: str = "1 day", slide: str = "12 hours", late: str = "1 day") -> DataFrame:
    """Events by type in sliding windows; rows later than `late` are dropped by the watermark."""
    windows = stream.withWatermark("ts", late).groupBy(F.window("ts", size, slide).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return windows.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n")


def tumbling_counts(stream: DataFrame, size: str = "1 second", late: str = "1 day") -> DataFrame:
    """(start, n): events in each window of `size`, at whose start detectors run again."""
    windows = stream.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w")).agg(F.count("*").alias("n"))
    return windows.select(F.col("w.start").alias("start"), "n")


def once(stream: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """Rows of work that were not met before within the watermark: with the checkpoint, a job that
    starts again does no work twice."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


#: A time after all others: the row that bears it lets the watermark pass all rows of a replay.
END_MS = 4_102_444_800_000


def replayed(rows: DataFrame, time: str, files: int = 3) -> DataFrame:
    """A stream of the rows of a table in `files` batches, each with rows of all times, and of one
    closing row whose other values are -1 (numbers) or empty. It is written below the shared folder."""
    spark = rows.sparkSession
    folder = shared_path(spark, "replay")
    part = F.pmod(F.xxhash64(*rows.columns), files)
    value = lambda c, t: F.timestamp_millis(F.lit(END_MS)) if c == time else F.lit("" if t == "string" else -1)
    closing = spark.range(1).select(*[value(c, t).cast(t).alias(c) for c, t in rows.dtypes])
    for i in range(files):
        rows.where(part == i).write.parquet(f"{folder}/{i}")
    closing.coalesce(1).write.parquet(f"{folder}/{files}")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4)
    return stream.option("recursiveFileLookup", True).parquet(folder)


def session_counts(stream: DataFrame, key: str, gap: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(key, start, end, n): runs of a key's events in which no two neighbours are `gap` or more
    apart. Rows older than the watermark are dropped; `dropped_rows` counts them."""
    rows = stream.withWatermark("ts", late) if stream.isStreaming else stream
    sessions = rows.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n"))
    return sessions.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def dropped_rows(query: StreamingQuery) -> int:
    """Rows that the watermark has dropped so far, as the query's own progress counts them."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
