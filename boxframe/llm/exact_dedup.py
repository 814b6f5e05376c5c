"""Exact deduplication by a content sort, by DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxframe.llm.common import WORD_SEPARATORS, partitions_for, settle, text_of

#: Bytes of a normalised text that lead the sort; its digest follows, then the text itself.
HEAD_BYTES = 24
#: Sampled rows for each range. A text met HOT_SAMPLES times or more in the sample is dealt over
#: parts, one for every HOT_SAMPLES, so a part is some fraction of a range.
SAMPLES, HOT_SAMPLES = 40, 8


def normal_text(text: Column) -> Column:
    """Runs of the separators as one space; most texts without line ends need no pattern."""
    other = F.contains(text, F.lit("  "))
    for separator in "\t\n\x0b\f\r":
        other = other | F.contains(text, F.lit(separator))
    return F.when(other, F.regexp_replace(text, WORD_SEPARATORS, " ")).otherwise(text)


def hot_texts(docs: DataFrame, text_col: str, ranges: int) -> DataFrame:
    """(digest, parts) of the texts that hold more than some share of a range in a sample.

    The sample has about `SAMPLES` rows a range, so there are at most SAMPLES / HOT_SAMPLES hot
    texts a range: few enough to broadcast. What it overlooks costs balance, not results.
    """
    share = min(1.0, SAMPLES * ranges / max(docs.count(), 1))
    sampled = docs.where(F.rand(7) < share).select(F.sha2(normal_text(text_of(text_col)), 256).alias("digest"))
    counted = sampled.groupBy("digest").count().where(F.col("count") >= HOT_SAMPLES)
    return settle(counted.select("digest", F.ceil(F.col("count") / HOT_SAMPLES).cast("int").alias("parts")))


def exact_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256), one row for every row of `docs`.

    Texts are equal if they are so after each run of U+0020 and U+0009 to U+000D became one space.
    Spark's sampled splitters range-partition the normalised texts by their first bytes and their
    digest; each range is sorted on disk where memory ends, by the text itself, and every row is
    compared in full with the one before it. A run of equal neighbours is a group and keeps the
    row with the smallest id.

    Texts that a sample shows to be very frequent are dealt over parts by id, each part its own
    run; the few first rows of such parts meet again by their whole texts. So one text may be any
    share of all rows. A null text counts as empty. A null id comes after all others; if all ids of
    a group are null, keep_id is null. Of rows with one text and one id, one is kept. Very long
    texts travel once, in one row; an empty table gives no rows; other columns are not read.
    """
    ranges = partitions_for(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), normal_text(text_of(text_col)).alias("text"))
    hot = hot_texts(docs, text_col, ranges)
    head = F.substring(F.col("text").cast("binary"), 1, HEAD_BYTES)
    rows = rows.select("id", "text", head.alias("head"), F.sha2("text", 256).alias("digest")).join(F.broadcast(hot), "digest", "left")
    part = F.coalesce(F.pmod(F.xxhash64("id"), "parts").cast("int"), F.lit(0))
    rows = rows.select("id", "text", "head", "digest", part.alias("part"), F.col("parts").isNotNull().alias("hot"))

    place = ["head", "digest", "part"]
    dealt = rows.repartitionByRange(ranges, *place)
    # Windows over the columns of the ranges take no other shuffle.
    sort = Window.partitionBy(*place).orderBy("text", F.col("id").asc_nulls_last())
    starts = F.lag("text").over(sort).eqNullSafe(F.col("text"))
    dealt = dealt.withColumn("starts", ~starts)
    run = F.sum(F.col("starts").cast("int")).over(sort.rowsBetween(Window.unboundedPreceding, 0))
    sample = F.when(F.col("hot") & F.col("starts"), F.col("text")).alias("sample")
    runs = dealt.select("id", "digest", "part", "hot", "head", "starts", sample, run.alias("run"))
    same = Window.partitionBy(*place, "run")
    runs = runs.select("id", "digest", "part", "hot", "starts", "sample", "run", F.min("id").over(same).alias("low"), F.count("*").over(same).alias("n"))
    runs = settle(runs)

    # The first rows of the parts of hot texts: as many as there are such parts.
    every = Window.partitionBy("sample")
    met = runs.where("hot and starts").select("digest", "part", "run", F.min("low").over(every).alias("all_low"), F.sum("n").over(every).alias("all_n"))
    out = runs.join(F.broadcast(met), ["digest", "part", "run"], "left")
    keep, size = (F.when(F.col("hot"), F.col("all_" + c)).otherwise(F.col(c)) for c in ("low", "n"))
    kept = F.col("starts") & F.col("low").eqNullSafe(keep)
    return out.select(F.col("id").alias(id_col), keep.alias("keep_id"), size.cast("long").alias("group_size"), kept.alias("kept"), F.col("digest").alias("text_sha256"))


ORACLE = """
with n as (select doc_id, regexp_replace(coalesce(text, ''), '[\\t\\n\\x0B\\f\\r ]+', ' ', 'g') t from documents)
select doc_id, min(doc_id) over (partition by t) keep_id, count(*) over (partition by t) group_size,
  row_number() over (partition by t order by doc_id nulls last) = 1 kept, sha256(t) text_sha256 from n
"""
