"""Naive Bayes support vectors: n-gram indicators scaled by class log-count ratios, hinge loss."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import starmap

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxframe.llm.common import text_of, without

BITS = 18
DIMENSIONS = 1 << BITS
#: At most so many labelled rows are fitted (those with the smallest hash of their id); the
#: log-count ratios come from all labelled rows.
FIT_ROWS = 8000
EPOCHS = 12
COST = 1.0

_shapes: dict[str, int] = {}


def _shape(word: str) -> int:
    """Case, length and last character of a word in one number below 2^12."""
    case = 0 if word.islower() else 1 if word.istitle() else 2 if word.isupper() else 3
    tail = 0 if word[-1].isalnum() else 1 + ord(word[-1]) % 127
    return case << 10 | min(len(word) // 3, 7) << 7 | tail


def _buckets(codes: np.ndarray, seed: int) -> np.ndarray:
    x = (codes.astype(np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    return (x >> np.uint64(64 - BITS)).astype(np.int32)


def features(text: str) -> np.ndarray:
    """Hashed indicators of a whole text: byte trigrams, and trigrams of word shapes in which a
    word that repeats the one before has a shape of its own."""
    raw = np.frombuffer(text.encode(), np.uint8).astype(np.uint32)
    seen = np.zeros(DIMENSIONS, bool)
    seen[_buckets(raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:], 1)] = True
    words = text.split()
    if words:
        if len(_shapes) > 500_000:
            _shapes.clear()
        shapes = np.array([s if (s := _shapes.get(w)) is not None else _shapes.setdefault(w, _shape(w)) for w in words], np.uint64)
        same = np.array([False, *map(str.__eq__, words, words[1:])])
        shapes[same] = 4095
        shapes = np.concatenate([[4094], shapes, [4094]]).astype(np.uint64)
        seen[_buckets(shapes[:-2] << np.uint64(24) | shapes[1:-1] << np.uint64(12) | shapes[2:], 2)] = True
    return np.flatnonzero(seen).astype(np.int32)


def log_count_ratios(labelled: DataFrame) -> np.ndarray:
    """r = log((p / |p|) / (q / |q|)) over all rows (label, text); p and q count the documents
    of each class that hold a feature, plus one."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, DIMENSIONS), np.int64)
        for rows in batches:
            for label, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                held[label, features(text)] += 1
        label, feature = np.nonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array(feature, pa.int32()), pa.array(held[label, feature])], names=["label", "feature", "n"])

    sums = labelled.mapInArrow(count, "label int, feature int, n long").groupBy("label", "feature").agg(F.sum("n").alias("n"))
    held = np.ones((2, DIMENSIONS))
    got = sums.toPandas()  # at most 2 * DIMENSIONS rows
    held[got.label, got.feature] += got.n
    return np.log(held[1] / held[1].sum()) - np.log(held[0] / held[0].sum())


def dual_coordinate_descent(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Weights (the last is the bias) of a linear model with hinge loss; y is -1 or 1."""
    w, alpha, rng = np.zeros(DIMENSIONS + 1), np.zeros(len(y)), np.random.default_rng(7)
    square = [float(v @ v) for _, v in rows]
    for _ in range(EPOCHS):
        for i in rng.permutation(len(y)).tolist():
            at, v = rows[i]
            slope = y[i] * float(w[at] @ v) - 1
            new = min(max(alpha[i] - slope / square[i], 0.0), cost[i])
            if new != alpha[i]:
                w[at] += (new - alpha[i]) * y[i] * v
                alpha[i] = new
    return w


def scaled(at: np.ndarray, ratios: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A document's features scaled by the ratios to length 1, and a constant for the bias."""
    v = ratios[at]
    size = float(np.sqrt(v @ v)) or 1.0
    return np.append(at, DIMENSIONS), np.append(v / size, 1.0)


def sigmoid_fit(margin: np.ndarray, positive: np.ndarray) -> tuple[float, float]:
    """Platt's (a, b) for 1 / (1 + exp(-(a m + b))) by Newton steps."""
    n1, n0 = positive.sum(), (~positive).sum()
    target = np.where(positive, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = np.array([((p - target) * margin).sum(), (p - target).sum()])
        s = np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(s * margin * margin).sum(), (s * margin).sum()], [(s * margin).sum(), s.sum()]]) + np.eye(2) * 1e-6
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -5, 5), b - np.clip(step[1], -5, 5)
    return a, b


def chosen_ids(ids: DataFrame, fit_rows: int) -> DataFrame:
    """(id): at most `fit_rows` of the different ids, those with the smallest hashes. Only ids
    below a hash that about half as many again have reach the task that takes the smallest."""
    ids = ids.distinct()
    share = min(1.0, (1.5 * fit_rows + 100) / max(1, ids.count()))
    h = F.xxhash64("id")
    few = ids.where(F.pmod(h, F.lit(1 << 31)) <= int(share * (1 << 31)))
    return few.select("id", h.alias("h")).orderBy(F.pmod("h", F.lit(1 << 31)), "h").limit(fit_rows).select("id")


def fit(docs: DataFrame, known: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[np.ndarray, float, float, float]:
    """(weights times ratios, bias, a, b) from rows (id, text) and labels (id, label).

    Texts meet the labels in one shuffle, for the ratios. The ids of the bounded sample are chosen
    from ids alone and go to the documents, so features are made for these only; one task fits
    them and hands back DIMENSIONS numbers. A fifth of the sample sets the sigmoid.
    """
    ratios = log_count_ratios(docs.join(known.hint("shuffle_hash"), "id").select("label", "text"))
    chosen = chosen_ids(docs.select("id").join(known.select("id"), "id", "left_semi"), fit_rows)
    labels = chosen.join(known, "id")
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            ids, labels, texts = (rows.column(i).to_pylist() for i in range(3))
            found = [features(t).tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(labels, pa.int32()), pa.array(found, pa.binary())], names=["h", "label", "found"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, labels = [], []
        for rows in batches:
            labels += rows.column(1).to_pylist()
            found += [np.frombuffer(x, np.int32) for x in rows.column(2).to_pylist()]
        y = np.array(labels) * 2.0 - 1
        if len(set(labels)) < 2:
            weights = np.zeros(DIMENSIONS + 3)
            weights[-1] = 5.0 * y[0] if len(y) else 0.0
        else:
            rows = list(starmap(scaled, ((x, shared.value) for x in found)))
            last = np.arange(len(y)) % 5 == 4
            even = np.where(y > 0, COST, COST * max(1.0, (y > 0).sum() / (y < 0).sum()) ** 0.5)
            chosen = np.flatnonzero(~last) if len(set(y[last])) == 2 and len(set(y[~last])) == 2 else np.arange(len(y))
            held = np.flatnonzero(last) if len(chosen) < len(y) else chosen
            w = dual_coordinate_descent([rows[i] for i in chosen], y[chosen], even[chosen])
            a, b = sigmoid_fit(np.array([w[rows[i][0]] @ rows[i][1] for i in held]), y[held] > 0)
            weights = np.append(w, [a, b])
        yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary())], names=["weights"])

    sample = docs.join(F.broadcast(labels), "id").select(F.xxhash64("id", "text").alias("h"), "label", "text")
    sample = sample.mapInArrow(digest, "h long, label int, found binary")
    got = sample.repartition(1).sortWithinPartitions("h", "label").limit(fit_rows).mapInArrow(learn, "weights binary").first()
    w = np.frombuffer(got[0]) if got else np.zeros(DIMENSIONS + 3)
    shared.unpersist()
    return np.stack([ratios, w[:DIMENSIONS]]), float(w[DIMENSIONS]), float(w[DIMENSIONS + 1]), float(w[DIMENSIONS + 2])


def score_column(model: tuple, text: Column) -> Column:
    spark_model, bias, a, b = model

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        ratios, weights = spark_model.value
        out = np.empty(len(texts))
        for i, t in enumerate(texts):
            at = features(t)
            r = ratios[at]
            out[i] = (weights[at] @ r) / (float(np.sqrt(r @ r)) or 1.0) + bias
        return pd.Series(1 / (1 + np.exp(-np.clip(a * out + b, -30, 30))))

    return score(text)


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    folds: int = 3,
    held_fold: int = 1,
    fit_rows: int = FIT_ROWS,
) -> DataFrame:
    """`docs` with held_out, score (0 to 1) and predicted (1 if score >= 0.5).

    Labels are read only of rows whose crc32(id as text) mod `folds` is not `held_fold`; nothing
    but the whole text enters a score. Ratios count all labelled rows; the linear model is
    fitted on at most `fit_rows` of them. Model size is fixed (2^18 features), so it is broadcast.

    Null and empty texts have no features and get the score of the bias; a very long text is read
    whole, in a block of its own. Labels that are null,
    not 0 or 1, or of unknown documents are ignored; with one class only all scores lean to it,
    without labels they are 0.5. Repeated rows and ties are scored row by row; an empty table
    gives no rows. Other columns stay; ones named held_out, score or predicted are replaced.
    """
    docs = without(docs, "held_out", "score", "predicted")
    fold = F.crc32(F.col(id_col).cast("string").cast("binary")) % folds
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1)")
    mine = docs.where(F.coalesce(fold, F.lit(held_fold)) != held_fold).select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    ratios, bias, a, b = fit(mine, known.where("id is not null"), fit_rows)
    shared = docs.sparkSession.sparkContext.broadcast(ratios)
    scored = docs.withColumn("held_out", F.coalesce(fold == held_fold, F.lit(False)))
    scored = scored.withColumn("score", score_column((shared, bias, a, b), text_of(text_col)))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
