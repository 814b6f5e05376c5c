"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Code points that separate words: space and U+0009 to U+000D.
WORD_SEPARATORS = "[ \\t\\n\\u000B\\f\\r]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column), F.lit(""))


def without(df: DataFrame, *names: str) -> DataFrame:
    """`df` less the columns that an operator is about to add (names compare as Spark compares them)."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def shared_folder(spark: SparkSession) -> str:
    """The session's `spark.checkpoint.dir`; only where none is set and all tasks run in this
    process (tests on one machine), a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def remove_folder(spark: SparkSession, path: str) -> None:
    """Remove what an earlier step wrote and nothing reads any more."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage: write `df` as a table in the shared folder and read it again.

    Lost executors then cost their own tasks only, and later reads take only the columns they need.
    """
    path = f"{shared_folder(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions_for(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component) for every id in `edges` (src, dst); the component is its smallest id.

    Every round, each id takes the smallest label among its neighbours, and then its label's
    label (pointer jumping), so chains shorten geometrically. Messages to one id are combined
    before the shuffle (min), so a hub costs one row per task. The rounds' results are
    checkpointed; the loop ends when no label changes.
    """
    both = edges.select("src", "dst").union(edges.select(F.col("dst"), F.col("src"))).where("src <> dst")
    both = settle(both.distinct())
    labels = both.groupBy(F.col("src").alias("id")).agg(F.least(F.min("dst"), F.first("src")).alias("label"))
    labels = settle(labels)
    for _ in range(max_rounds):
        heard = (
            both.join(labels.select(F.col("id").alias("dst"), F.col("label").alias("heard")), "dst")
            .groupBy(F.col("src").alias("id"))
            .agg(F.min("heard").alias("heard"))
        )
        near = labels.join(heard, "id").select("id", "label", F.least("label", "heard").alias("low"))
        # A root hears the smallest label that any of its members has heard.
        told = near.groupBy(F.col("label").alias("id")).agg(F.min("low").alias("told"))
        step = near.join(told.select(F.col("id").alias("label"), "told"), "label", "left").select(
            "id", "label", F.least("low", F.coalesce("told", "low")).alias("next")
        )
        jump = step.select(F.col("id").alias("next"), F.col("next").alias("far"))
        step = settle(step.join(jump, "next", "left").select("id", "label", F.least("next", F.coalesce("far", "next")).alias("next")))
        labels = step.select("id", F.col("next").alias("label"))
        if step.where("next <> label").limit(1).count() == 0:
            return labels.select("id", F.col("label").alias("component"))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
