"""A training-data pipeline over `documents`: five stages, each written as Parquet and read again.

Each stage function takes (spark, docs, sf_dir) and works on all that the stage before it kept;
all but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxframe.llm import line_dedup, minhash, nbsvm, packing, secrets
from boxframe.llm.common import remove_folder, settle, shared_folder, table
from boxframe.llm.queries import tokenizer_path
from boxframe.operators.folds import running

#: A found secret's text is replaced by this and its kind.
MASK = "[{}]"


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the naive Bayes support vectors predict to be of quality. Null texts are scored
    as empty ones; rows that repeat an id, and rows without one, are judged row by row."""
    scored = nbsvm.score_quality(docs, table(spark, sf_dir, "labels"))
    return scored.where("predicted = 1").select(*docs.columns)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines leave all documents but the first; a document that loses all its words leaves.
    Null texts stay null; rows that repeat an id count as one document for order, and those
    without id come before all."""
    kept = line_dedup.dedup_lines(docs)
    has_words = F.coalesce(F.col("text").rlike("[^ \\t\\n\\x0B\\f\\r]"), F.lit(False))
    return with_length(kept.where((F.col("n_dropped") == 0) | has_words), docs)


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays: that with the smallest id. Of rows that
    repeat an id, one stays; rows without id stay, as nothing tells them apart."""
    gone = minhash.near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("gone"))
    kept = docs.join(gone.hint("shuffle_hash"), docs["doc_id"] == F.col("gone"), "left_anti").select(*docs.columns)
    again = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("again"))
    again = settle(again)
    if again.limit(1).count() == 0:
        return kept
    repeated = kept.join(again.hint("shuffle_hash"), docs["doc_id"] == F.col("again"), "left_semi").dropDuplicates(["doc_id"])
    return kept.join(again.hint("shuffle_hash"), docs["doc_id"] == F.col("again"), "left_anti").unionByName(repeated)


def secret_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Found secrets are masked in the text; the documents stay. Only documents whose weak
    candidates wait for their complements are shuffled. Null texts stay null; repeated rows and
    rows without id are masked row by row."""
    found = secrets.scan_secrets(docs, carry=True).select("row.*", F.col("spans").alias("spans of secrets"))
    masked = F.when(F.size("spans of secrets") > 0, mask_spans(F.col("text"), F.col("spans of secrets"))).otherwise(F.col("text"))
    return with_length(found.withColumn("text", masked), docs)


def mask_spans(text, spans):
    """The text with each span replaced by its kind; of spans that overlap the first is named.
    The pieces are joined once, at the end."""
    names = F.array(*[F.lit(MASK.format(k[0])) for k in secrets.KINDS])

    def step(at, s):
        before = F.substring(text, at + 1, s["start"] - at)
        put = F.when(s["start"] >= at, F.concat(before, F.get(names, s["kind"]))).otherwise("")
        return F.struct(F.greatest(at, s["end"]).alias("state"), put.alias("one"))

    last = F.coalesce(F.array_max(F.transform(spans, lambda s: s["end"])), F.lit(0))
    rest = F.substring(text, last + 1, F.length(text))
    return F.concat(F.array_join(running(spans, F.lit(0), "string", step), ""), rest)


def with_length(docs: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of `like`, with n_chars as the text now has it."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*like.columns)


def sum_of_squares_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents' tokens in windows of 4096. A null text is one end token; repeated rows
    are packed each time, and a null id stays null."""
    pieces = packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_deduplication),
    ("minhash_near_dedup", minhash_dedup),
    ("secret_scans", secret_masking),
    ("packing", sum_of_squares_packing),
]

#: The classifier, the sampling and the packer have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, done = table(spark, sf_dir, "documents"), None
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}/{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if done:
                remove_folder(spark, done)
            done = path
    return docs
