"""MinHash near-dedup by improved consistent weighted sampling over TF-IDF shingles."""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxframe.llm.common import connected_components, partitions_for, settle
from boxframe.llm.words import mixed, shingles, word_hashes

WORDS, LEAST = 5, 0.8
BANDS, ROWS = 16, 4
SAMPLES = BANDS * ROWS
#: Document frequencies are counted in a sketch of fixed size (two rows of 2^18 counters), so
#: frequencies below about mean shingles / 2^18 of the corpus count alike, at every corpus size.
SKETCH_ROWS, SKETCH_BITS, SKETCH_BLOCK = 2, 18, 4096
SKETCH_SIZE = SKETCH_ROWS << SKETCH_BITS
#: The inverse frequency lifts a shingle's weight by at most this share, in so many steps. Undamped,
#: an edit (frequency 1) would outweigh ten shared shingles of a group that holds a third of the
#: corpus, and near copies in such groups would fall below any threshold; with this share, two
#: documents of one edit in ten stay above 0.8 at every size of their group.
IDF_SHARE, IDF_STEPS, IDF_RANGE = 0.25, 8, 500.0
PLACES = 13
#: Weights of so many shingles in one batch get a table of their own; at most TABLES are held.
TABLE_ROWS, TABLES = 4096, 24
#: Shingles that are sampled together, and steps in which they are.
BATCH_SHINGLES, STEP = 200_000, 1024
#: Documents of one bucket are compared in blocks of about so many against so many.
BLOCK_ROWS, BLOCK_COLUMNS = 512, 8192
#: Up to so many pairs are compared one by one, more by a product of matrices.
FEW_PAIRS = 64


def sketch_cells(x: np.ndarray) -> np.ndarray:
    """Counters of each shingle, one in each row of the sketch."""
    low = x & np.uint64((1 << SKETCH_BITS) - 1)
    high = (x >> np.uint64(40)) & np.uint64((1 << SKETCH_BITS) - 1)
    return np.stack([low, high + np.uint64(1 << SKETCH_BITS)]).astype(np.int64)


def weights(x: np.ndarray, counts: np.ndarray, sketch: np.ndarray, n_docs: int) -> np.ndarray:
    """Term count times the damped inverse document frequency."""
    df = sketch[sketch_cells(x)].min(axis=0) if len(x) else np.empty(0)
    rarity = np.clip(np.log((n_docs + 1) / (df + 1)) / np.log(IDF_RANGE), 0, 1)
    return counts * (1 + IDF_SHARE * np.round(rarity * IDF_STEPS) / IDF_STEPS)


def weighted_jaccard(a: tuple, b: tuple) -> float:
    """Sum of the lesser weights over the sum of the greater; both sorted by shingle."""
    common, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = np.minimum(a[1][i], b[1][j]).sum()
    return float(low / (a[1].sum() + b[1].sum() - low)) if len(common) else 0.0


class Sampler:
    """Improved consistent weighted samples.

    Sample k of a weighted set is the shingle of least a = c / (y e^r), where r, c ~ Gamma(2, 1)
    and b ~ U(0, 1) belong to (shingle, k) and ln y = r (floor(ln w / r + b) - b). The variates
    are drawn from a table of 2^13 places by hash; ties within a place go by the hash itself, so
    samples stay consistent. The sample is (a, tie): a determines y for its place.
    """

    def __init__(self):
        rng = np.random.default_rng(20)
        shape = (SAMPLES, 1 << PLACES)
        self.r, self.c, self.b = rng.gamma(2, 1, shape).ravel(), np.log(rng.gamma(2, 1, shape)).ravel(), rng.random(shape).ravel()
        self.odd = (rng.integers(1, 1 << 31, SAMPLES, np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
        self.rows = (np.arange(SAMPLES, dtype=np.uint32) << np.uint32(PLACES))[:, None]
        self.tables: OrderedDict[float, np.ndarray] = OrderedDict()

    @staticmethod
    def _ordered(log_w: np.ndarray | float, r: np.ndarray, c: np.ndarray, b: np.ndarray) -> np.ndarray:
        """ln a as unsigned integers in the same order."""
        t = np.floor(log_w / r + b)
        bits = (c - r * (t - b) - r).astype(np.float32).view(np.uint32)
        return np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31))

    def _table(self, log_w: float, used: int) -> np.ndarray | None:
        """ln a of every place at one weight; none for a weight that few shingles have."""
        if log_w in self.tables:
            self.tables.move_to_end(log_w)
        elif used < TABLE_ROWS:
            return None
        else:
            self.tables[log_w] = self._ordered(log_w, self.r, self.c, self.b)
            if len(self.tables) > TABLES:
                self.tables.popitem(last=False)
        return self.tables[log_w]

    def samples(self, sets: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """A row of samples for each set (shingles, weights), none of them empty; a sample is one
        number: ln a above bit 32, the shingle's upper half below, so the least is the sample."""
        x, w = np.concatenate([s[0] for s in sets]), np.concatenate([s[1] for s in sets])
        of = np.repeat(np.arange(len(sets)), [len(s[0]) for s in sets])
        values, kind, used = np.unique(w, return_inverse=True, return_counts=True)
        log_w = np.array([math.log(v) for v in values.tolist()])
        tables = [self._table(v, n) for v, n in zip(log_w.tolist(), used.tolist())]
        group = np.array([i if t is not None else len(values) for i, t in enumerate(tables)])[kind]
        order = np.lexsort((of, group))
        x, of, kind, group = x[order], of[order], kind[order], group[order]
        edges = np.flatnonzero(np.diff(group, prepend=-1, append=-1)).tolist()
        out = np.full((SAMPLES, len(sets)), np.iinfo(np.uint64).max, np.uint64)
        for low, high in zip(edges, edges[1:]):
            for i in range(low, high, STEP):
                j = min(high, i + STEP)
                places = x[i:j].astype(np.uint32) * self.odd
                places >>= np.uint32(32 - PLACES)
                places += self.rows
                if group[i] < len(values):
                    a = tables[group[i]].take(places, mode="clip")
                else:
                    a = self._ordered(log_w[kind[i:j]], *(v.take(places, mode="clip") for v in (self.r, self.c, self.b)))
                key = a.astype(np.uint64)
                key <<= np.uint64(32)
                key |= x[i:j] >> np.uint64(32)
                first = np.flatnonzero(np.diff(of[i:j], prepend=-1))
                at = of[i:j][first]
                out[:, at] = np.minimum(out[:, at], np.minimum.reduceat(key, first, axis=1))
        return out.T

    def bands(self, sets: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """A row of BANDS bucket numbers for each set."""
        rows = self.samples(sets).reshape(-1, BANDS, ROWS)
        key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), rows.shape[:2])
        for j in range(ROWS):
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) ^ rows[:, :, j])
        return key.view(np.int64)


_sampler: list[Sampler] = []


def document_frequencies(texts: DataFrame) -> np.ndarray:
    """The sketch over all rows (text). Each task sends its sketch in blocks; blocks of one
    place are summed as a stream, so only SKETCH_SIZE counters reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(SKETCH_SIZE, np.int64)
        for rows in batches:
            for text in rows.column(0).to_pylist():
                cells = sketch_cells(shingles(word_hashes(text), WORDS)[0])
                for row in cells:
                    np.add.at(sketch, row, 1)
        blocks = sketch.reshape(-1, SKETCH_BLOCK)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array([b.tobytes() for b in blocks], pa.binary())], names=["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for rows in batches:
            for block, counts in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                total[block] = total.get(block, 0) + np.frombuffer(counts, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([c.tobytes() for c in total.values()], pa.binary())], names=["block", "counts"])

    schema = "block int, counts binary"
    out = np.zeros(SKETCH_SIZE, np.int64)
    for block, counts in texts.mapInArrow(count, schema).repartition(SKETCH_SIZE // SKETCH_BLOCK, "block").mapInArrow(add, schema).collect():
        out[block * SKETCH_BLOCK : (block + 1) * SKETCH_BLOCK] = np.frombuffer(counts, np.int64)
    return out


def signatures(docs: DataFrame, sketch: Broadcast, n_docs: int) -> DataFrame:
    """(id, h1, h2, bands) of rows (id, text); h1 and h2 are equal only for equal words."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _sampler:
            _sampler.append(Sampler())
        for rows in batches:
            h, bands, sets, at = np.zeros((2, rows.num_rows), np.int64), [[]] * rows.num_rows, [], []

            def flush() -> None:
                for i, row in zip(at, _sampler[0].bands(sets).tolist() if sets else []):
                    bands[i] = row
                sets.clear()
                at.clear()

            held = 0
            for i, text in enumerate(rows.column(1).to_pylist()):
                words = word_hashes(text)
                if not len(words):
                    continue
                place = mixed(np.arange(1, len(words) + 1, dtype=np.uint64))
                h[0, i] = mixed(words ^ place).sum(dtype=np.uint64).astype(np.int64)
                h[1, i] = mixed(words + place * np.uint64(3)).sum(dtype=np.uint64).astype(np.int64)
                x, n = shingles(words, WORDS)
                sets.append((x, weights(x, n, sketch.value, n_docs)))
                at.append(i)
                held += len(x)
                if held >= BATCH_SHINGLES:
                    flush()
                    held = 0
            flush()
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(h[0]), pa.array(h[1]), pa.array(bands, pa.list_(pa.int64()))], names=["id", "h1", "h2", "bands"])

    return docs.mapInArrow(sign, "id long, h1 long, h2 long, bands array<long>")


def verified(pairs: DataFrame, texts: DataFrame, sketch: Broadcast, n_docs: int, least: float) -> DataFrame:
    """(src, dst) of the pairs whose weighted Jaccard similarity is `least` or more."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: OrderedDict[tuple, tuple] = OrderedDict()

        def of(*key: int | str) -> tuple:
            if key not in held:
                x, n = shingles(word_hashes(key[1]), WORDS)
                held[key] = (x, weights(x, n, sketch.value, n_docs))
                if len(held) > 64:
                    held.popitem(last=False)
            held.move_to_end(key)
            return held[key]

        for rows in batches:
            src, a, dst, b = (rows.column(i).to_pylist() for i in range(4))
            good = [weighted_jaccard(of(i, s), of(j, t)) >= least for i, s, j, t in zip(src, a, dst, b)]
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2)], names=["src", "dst"]).filter(pa.array(good, pa.bool_()))

    left = texts.select(F.col("id").alias("src"), F.col("text").alias("a"))
    right = texts.select(F.col("id").alias("dst"), F.col("text").alias("b"))
    both = pairs.join(left, "src").join(right, "dst").select("src", "a", "dst", "b")
    return both.mapInArrow(verify, "src long, dst long")


def overlaps(left: list[tuple], right: list[tuple]) -> np.ndarray:
    """Sum of the lesser weights for each pair of weighted sets, as products of matrices with one
    column per shingle and step of weight."""

    def entries(sets: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.repeat(np.arange(len(sets)), [len(x) for x, _ in sets]), np.concatenate([x for x, _ in sets]), np.concatenate([w for _, w in sets])

    (i, x, v), (j, y, w) = entries(left), entries(right)
    common = np.intersect1d(x, y)
    held, other = np.isin(x, common), np.isin(y, common)
    i, v, x = i[held], v[held], np.searchsorted(common, x[held])
    j, w, y = j[other], w[other], np.searchsorted(common, y[other])
    # A column per (shingle, weight that occurs): it holds the step up from the next lesser weight.
    steps = np.unique(np.stack([np.concatenate([x, y]).astype(np.float64), np.concatenate([v, w])]), axis=1)
    begins = np.searchsorted(steps[0], np.arange(len(common) + 1))
    gain = np.diff(steps[1], prepend=0)
    gain[begins[:-1]] = steps[1, begins[:-1]]
    out = np.zeros((len(left), len(right)))

    def columns(row: np.ndarray, at: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and columns of the steps that each entry reaches."""
        most = begins[at + 1] - begins[at]
        of = np.repeat(np.arange(len(at)), most)
        column = begins[at][of] + np.arange(len(of)) - np.repeat(np.cumsum(most) - most, most)
        reached = steps[1, column] <= weight[of]
        order = np.argsort(column[reached], kind="stable")
        return row[of[reached]][order], column[reached][order]

    (i, a), (j, b) = columns(i, x, v), columns(j, y, w)
    for low in range(0, steps.shape[1], BLOCK_COLUMNS):
        width = min(BLOCK_COLUMNS, steps.shape[1] - low)
        one, two = np.zeros((len(left), width)), np.zeros((len(right), width))
        at, to = (slice(*np.searchsorted(c, [low, low + width])) for c in (a, b))
        one[i[at], a[at] - low] = gain[a[at]]
        two[j[to], b[to] - low] = 1
        out += one @ two.T
    return out


def linking_pairs(left: list[tuple], right: list[tuple], least: float) -> Iterator[tuple[int, int]]:
    """Of documents (id, component, shingles, weights), pairs of different components that are
    `least` or more similar; pairs that earlier ones already join are left out."""
    root: dict[int, int] = {}

    def find(c: int) -> int:
        while (up := root.get(c, c)) != c:
            root[c] = c = root.get(up, up)
        return c

    if len(left) * len(right) <= FEW_PAIRS:
        for a, b in ((a, b) for a in left for b in right if a[0] != b[0]):
            i, j = find(a[1]), find(b[1])
            if i != j and weighted_jaccard(a[2:], b[2:]) >= least:
                root[i] = j
                yield a[0], b[0]
        return
    low = overlaps([d[2:] for d in left], [d[2:] for d in right])
    totals = [np.array([d[3].sum() for d in side]) for side in (left, right)]
    whole = totals[0][:, None] + totals[1] - low
    component = [np.array([d[1] for d in side]) for side in (left, right)]
    # Sums differ in their last digits by order; what is near the border is counted again.
    for i, j in np.argwhere((low >= (least - 1e-9) * whole) & (component[0][:, None] != component[1])).tolist():
        a, b = find(left[i][1]), find(right[j][1])
        if a != b and weighted_jaccard(left[i][2:], right[j][2:]) >= least:
            root[a] = b
            yield left[i][0], right[j][0]


def linked_in_full(members: DataFrame, texts: DataFrame, sketch: Broadcast, n_docs: int, least: float) -> DataFrame:
    """(src, dst): links that join all components of which two members of one bucket are `least`
    or more similar. `members` are (bucket, rep, component).

    A bucket is dealt into blocks: a component that fills one has blocks of its own, the rest
    share some by hash. Each pair of blocks that can hold two components is one group, so no
    task holds more than two blocks at once however large the bucket is, and a large component
    is not compared with itself.
    """
    # Buckets with the same members are one: similar pairs meet in several bands.
    sums = [F.sum(F.xxhash64(F.lit(i), "rep").cast("decimal(20,0)")).alias(f"s{i}") for i in range(2)]
    alike = members.groupBy("bucket").agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high"), *sums)
    alike = alike.where("low <> high").groupBy("n", "s0", "s1").agg(F.min("bucket").alias("bucket")).select("bucket")
    members = settle(members.join(alike, "bucket"))
    parts = members.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    kinds = parts.groupBy("bucket").agg(
        F.ceil(F.sum(F.when(F.col("n") < BLOCK_ROWS, F.col("n"))) / BLOCK_ROWS).cast("int").alias("shared")
    )
    parts = parts.join(kinds, "bucket")
    own = F.when(F.col("n") >= BLOCK_ROWS, F.col("component"))
    parts = parts.select("bucket", "component", own.alias("own"), F.when(own.isNull(), F.col("shared")).otherwise(F.ceil(F.col("n") / BLOCK_ROWS)).cast("int").alias("of"))
    parts = settle(parts)
    block = F.struct(F.col("own"), F.pmod(F.xxhash64("rep"), "of").cast("int").alias("i"))
    dealt = settle(members.join(parts, ["bucket", "component"]).select("bucket", block.alias("block"), "rep", "component"))
    blocks = dealt.select("bucket", "block").distinct()
    left, right = blocks.withColumnRenamed("block", "i"), blocks.withColumnRenamed("block", "j")
    meet = left.join(right, "bucket").where("i <= j and not (i.own is not null and j.own is not null and i.own = j.own)")
    meet = meet.select("bucket", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    dealt = settle(dealt.join(meet, ["bucket", "block"]).select("bucket", "i", "j", (F.col("block") == F.col("i")).alias("left"), "rep", "component"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, {}

        def done() -> pa.RecordBatch:
            left = held.get(True, [])
            right = left if at[1] == at[2] else held.get(False, [])
            pairs = list(linking_pairs(left, right, least)) if left and right else []
            return pa.RecordBatch.from_arrays([pa.array([min(p) for p in pairs], pa.int64()), pa.array([max(p) for p in pairs], pa.int64())], names=["src", "dst"])

        for rows in batches:
            for bucket, i, j, first, rep, component, text in zip(*(c.to_pylist() for c in rows.columns)):
                if (bucket, i, j) != at:
                    if at is not None:
                        yield done()
                    at, held = (bucket, i, j), {}
                x, n = shingles(word_hashes(text), WORDS)
                held.setdefault(first, []).append((rep, component, x, weights(x, n, sketch.value, n_docs)))
        if at is not None:
            yield done()

    with_text = dealt.join(texts.select(F.col("id").alias("rep"), "text"), "rep").select("bucket", "i", "j", "left", "rep", "component", "text")
    groups = with_text.repartition(partitions_for(members.sparkSession), "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "rep")
    return groups.mapInArrow(compare, "src long, dst long").distinct()


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """(doc_id, class_id, kept), one row per document; class_id is the smallest id of its class.

    Texts with equal words form one class at once and one stands for all. The others' samples
    are banded (16 bands of 4). First each document is compared with one other, the smallest id
    of all its buckets. Then, in buckets that still hold several components, one member of each
    is compared with one of the smallest component, as long as a tenth of such pairs link. These
    rounds only save work: in buckets that hold several components after them, all members of
    different components are compared, in blocks, so every similar pair of a bucket ends in one
    class.

    Null texts are classes of their own; empty texts are equal to each other; very long ones are
    hashed in parts. Texts of fewer than
    five words are one shingle. Rows that repeat an id are one document with the smallest of its
    texts' classes; ties go to the smallest id. Rows without id are returned one by one, kept and
    without class. An empty table gives no rows; other columns are not carried. Ids must be integers.
    """
    spark = docs.sparkSession
    every_row = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = every_row.where("id is not null")
    known = rows.where("text is not null")
    sketch = spark.sparkContext.broadcast(document_frequencies(known.select("text")))
    n_docs = known.count()
    signed = settle(signatures(known, sketch, n_docs))
    groups = settle(signed.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.first("bands").alias("bands")))
    buckets = groups.select("rep", F.explode("bands").alias("bucket")).distinct()
    centres = buckets.groupBy("bucket").agg(F.min("rep").alias("centre"), F.max("rep").alias("last")).where("centre <> last").drop("last")
    buckets = settle(buckets.join(centres, "bucket"))
    wanted = buckets.select(F.col("rep").alias("id")).distinct()
    texts = settle(rows.join(wanted.hint("shuffle_hash"), "id", "left_semi").distinct())
    pairs = buckets.groupBy("rep").agg(F.min("centre").alias("src")).select("src", F.col("rep").alias("dst")).where("src < dst")

    links, component, members, turn = None, None, buckets.select("bucket", "rep", F.col("rep").alias("component")), 0
    while True:
        pairs = settle(pairs.repartition(partitions_for(spark), "src", "dst"))
        tried = pairs.count()
        new = settle(verified(pairs, texts, sketch, n_docs, least)) if tried else pairs
        found = new.count()
        if found:
            links = new if links is None else links.union(new)
            component = connected_components(links)
            labels = component.select(F.col("id").alias("rep"), F.col("component").alias("found"))
            members = buckets.join(labels, "rep", "left").select("bucket", "rep", F.coalesce("found", "rep").alias("component"))
        if 10 * found <= tried:
            break
        turn += 1
        delegates = members.groupBy("bucket", "component").agg(F.min_by("rep", F.xxhash64("rep", F.lit(turn))).alias("rep"))
        least_one = delegates.groupBy("bucket").agg(F.min(F.struct("component", "rep")).alias("centre"))
        pairs = delegates.join(least_one, "bucket").where("component <> centre.component")
        # One pair for each two components; which bucket they met in does not matter.
        pairs = pairs.groupBy("component", "centre.component").agg(F.min(F.struct(F.least("rep", "centre.rep").alias("src"), F.greatest("rep", "centre.rep").alias("dst"))).alias("p")).select("p.src", "p.dst").distinct()
    new = settle(linked_in_full(members, texts, sketch, n_docs, least))
    if new.limit(1).count() > 0:
        component = connected_components(new if links is None else links.union(new))
    merged = groups.select("h1", "h2", "rep")
    if component is not None:
        merged = merged.join(component.select(F.col("id").alias("rep"), "component"), "rep", "left")
        merged = merged.select("h1", "h2", F.coalesce("component", "rep").alias("class"))
    else:
        merged = merged.withColumnRenamed("rep", "class")
    named = signed.select("id", "h1", "h2").join(merged, ["h1", "h2"]).groupBy("id").agg(F.min("class").alias("class"))
    alone = rows.where("text is null").select("id").distinct().join(named, "id", "left_anti").select("id", F.col("id").alias("class"))
    nameless = every_row.where("id is null").select("id", F.col("id").alias("class"))
    every = named.union(alone).union(nameless)
    return every.select(F.col("id").alias("doc_id"), F.col("class").alias("class_id"), F.col("id").eqNullSafe(F.col("class")).alias("kept"))
