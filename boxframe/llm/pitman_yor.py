"""LM scoring by a hierarchical Pitman-Yor model whose seating is sampled by Gibbs."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxframe.llm.common import partitions_for, settle, text_of
from boxframe.llm.words import mixed, word_hashes

#: Context restaurants: the word before, hashed to one of 2^16; all share the root as parent.
CONTEXTS = 1 << 16
#: Discounts are a half at both levels: the number of ways to seat c customers at t tables is then
#: G(2c - t) / (G(t) G(c - t + 1) 4^(c - t)), G the gamma function, so table counts are drawn from
#: their exact conditional for any c.
DISCOUNT = 0.5
STRENGTH, ROOT_STRENGTH = 30.0, 100.0
#: Sweeps on a bucket's own totals, sweeps on those of all before any counts, and those that count.
BURN_IN, SETTLING, KEPT_SWEEPS = 2, 2, 3
#: Table counts that are looked at for one draw: all of up to so many, else a window at the mode.
FEW_TABLES, WINDOW = (4, 12, 32, 128), 512
#: Words that make up more than one in so many tokens are spread over all buckets by context.
HOT = 1 << 14
BLOCK_TOKENS, BLOCK_DOCS = 3_000_000, 60_000
BUCKET_BYTES = 16_000_000
END, START = np.uint64(0x5EED00000000E0D1), np.uint64(0x5EED00000000B016)
CHUNKS = 16


def restaurant(words: np.ndarray) -> np.ndarray:
    return (mixed(words) >> np.uint64(48)).astype(np.uint16)


def seat(c: np.ndarray, others: np.ndarray, base: np.ndarray, strength: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of c customers who all eat one dish, given the restaurant's other tables and the
    parent's probability of the dish: a blocked Gibbs draw.

    p(t) is in proportion to S(c, t) base^t times the product of strength + (others + i) / 2 for
    i < t, S the number of seatings. Its ratio p(t + 1) / p(t) is a rational function that falls
    with t, so p has one mode, a root of a quadratic, and tails that fall faster than a geometric
    series: the draw looks at eight standard deviations and more on both sides. Where these hold
    more than WINDOW values, cells of 1/32 standard deviation are drawn, and a value within.
    """
    tables = np.ones(len(c), np.int64)
    free = strength + DISCOUNT * others
    for low, high, width in zip((1, *FEW_TABLES), (*FEW_TABLES, np.inf), (*FEW_TABLES, WINDOW)):
        live = np.flatnonzero((c > low) & (c <= high))
        for i in range(0, len(live), 4096):
            at = live[i : i + 4096]
            n, f, b = c[at].astype(float), free[at], base[at]
            start, step = np.ones(len(at)), np.ones(len(at))
            if width == WINDOW:  # p(t + 1) = p(t): (4b/2 - 1) t^2 - (4b (n/2 - f) - (2n - 1)) t - 4b n f = 0, signs turned
                x, y, z = 1 - 2 * b, 4 * b * (f - n / 2) + 2 * n - 1, 4 * b * n * f
                mode = np.clip(2 * z / (y + np.sqrt(np.maximum(y * y - 4 * x * z, 0))), 1, n - 1)
                curve = 1 / (n - mode) - 1 / (2 * n - mode - 1) + 1 / mode - DISCOUNT / (f + DISCOUNT * mode)
                reach = np.minimum(8 / np.sqrt(np.maximum(curve, 1e-300)) + 32, n)
                start = np.maximum(1, np.floor(mode - reach))
                step = np.ceil(np.maximum(1, (np.minimum(mode + reach, n) - start + 1) / WINDOW))
            t = start[:, None] + step[:, None] * np.arange(width - 1)
            middle = t + (step[:, None] - 1) / 2  # of the values from t to the next cell
            with np.errstate(divide="ignore", invalid="ignore"):
                rise = 4 * b[:, None] * (n[:, None] - middle) * (f[:, None] + DISCOUNT * middle) / ((2 * n[:, None] - middle - 1) * middle)
                log_p = np.cumsum(step[:, None] * np.log(np.where(t + step[:, None] <= n[:, None], rise, 0)), axis=1)
            log_p = np.concatenate([np.zeros((len(at), 1)), log_p], axis=1)
            p = np.exp(log_p - log_p.max(axis=1, keepdims=True)).cumsum(axis=1)
            cell = (p < rng.random(len(at))[:, None] * p[:, -1:]).sum(axis=1)
            tables[at] = np.minimum(start + step * cell + np.floor(rng.random(len(at)) * step), n)
    return tables


def hot_words(texts: DataFrame) -> np.ndarray:
    """Hashes of all words (with END) that are more than one in HOT of all tokens, and of at most as
    many again that are more than one in 2 HOT: a word of such a share has half of it at least in
    blocks where it is more than one in 2 HOT, and only there it is counted."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def done() -> pa.RecordBatch:
            words, n = np.unique(np.concatenate(held), return_counts=True)
            many = 2 * HOT * n >= size
            kind = np.append(np.zeros(many.sum(), np.int32), 1)
            return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(np.append(words[many].view(np.int64), 0)), pa.array(np.append(n[many], size))], names=["kind", "word", "n"])

        for rows in batches:
            for text in rows.column(0).to_pylist():
                held.append(np.append(word_hashes(text), END))
                size += len(held[-1])
                if size >= BLOCK_TOKENS:
                    yield done()
                    held, size = [], 0
        if held:
            yield done()

    counts = settle(texts.mapInArrow(count, "kind int, word long, n long").groupBy("kind", "word").agg(F.sum("n").alias("n")))
    total = counts.where("kind = 1").agg(F.sum("n")).first()[0] or 0
    found = counts.where("kind = 0").where(F.col("n") * (2 * HOT) >= total).select("word").collect()  # at most 2 HOT rows
    return np.unique(np.array([r[0] for r in found], np.int64).view(np.uint64))


def pack_block(docs: list[np.ndarray], train: list[bool], buckets: int, hot: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(bucket, bytes) of a block: for its words in that bucket, the contexts of each word, and
    for each (word, context) the documents of the block in which it stands. A word has one
    bucket; a hot word's contexts are dealt to all."""
    words = np.concatenate([np.append(d, END) for d in docs])
    sizes = np.array([len(d) + 1 for d in docs])
    doc = np.repeat(np.arange(len(docs), dtype=np.uint16), sizes)
    before = np.concatenate([[START], words[:-1]])
    before[np.cumsum(sizes)[:-1]] = START
    contexts = restaurant(before)
    different, word = np.unique(words, return_inverse=True)
    bucket = ((different >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)[word]
    spread = np.flatnonzero(np.isin(different, hot)[word])
    bucket[spread] = (mixed(words[spread] ^ mixed(contexts[spread].astype(np.uint64) + np.uint64(1))) >> np.uint64(32)) % np.uint64(buckets)
    key = (bucket * len(different) + word) << 16 | contexts
    order = np.argsort(key, kind="stable")
    key, doc = key[order], doc[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    times = np.diff(first, append=len(key))
    pairs = key[first]
    pair_word = pairs >> 16
    flags = np.packbits(np.array(train, np.uint8)).tobytes()
    edges = np.searchsorted(pair_word, np.arange(buckets + 1) * len(different))
    for b in range(buckets):
        low, high = edges[b : b + 2].tolist()
        if low == high:
            continue
        mine, (start, end) = pair_word[low:high] - b * len(different), (first[low], first[high] if high < len(first) else len(doc))
        begins = np.flatnonzero(np.diff(mine, prepend=-1))
        per_word = np.diff(begins, append=len(mine)).astype(np.uint32)
        parts = (different[mine[begins]], per_word, (pairs[low:high] & 0xFFFF).astype(np.uint16), times[low:high].astype(np.uint32), doc[start:end])
        head = np.array([len(docs), *map(len, parts)], np.int64)
        yield b, b"".join([head.tobytes(), flags, *(p.tobytes() for p in parts)])


def open_block(raw: bytes) -> tuple:
    """(train flags, words, pairs per word, contexts, times per pair, documents)"""
    n_docs, *sizes = np.frombuffer(raw, np.int64, 6).tolist()
    at = 48 + (n_docs + 7) // 8
    out = [np.unpackbits(np.frombuffer(raw, np.uint8, at - 48, 48), count=n_docs)]
    for n, kind in zip(sizes, (np.uint64, np.uint32, np.uint16, np.uint32, np.uint16)):
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return tuple(out)


class Totals:
    """Sums over all buckets, of a fixed size: per context and per hot word, and over all words.

    `first` holds a context's customers and its tables when sampling starts, a hot word's
    training tokens and its tables, and the numbers of tokens, of other words known, of tables
    and of root tables of other words; `kept` the tables alone, after each kept sweep.
    """

    def __init__(self, first: np.ndarray, hot: int, kept: list[np.ndarray] = ()):
        self.seen, self.tables, self.hot_count, self.hot_tables, ends = np.split(first, np.cumsum([CONTEXTS, CONTEXTS, hot, hot]))
        self.tokens, cold, self.customers, self.cold_root = ends.tolist()
        self.types = cold + int((self.hot_count > 0).sum())
        self.kept = [np.split(k, [CONTEXTS, CONTEXTS + hot]) for k in kept]

    def hot_root(self, sweep: int) -> np.ndarray:
        """Root tables of the hot words, the same draw in every task."""
        out = np.minimum(self.hot_tables, 1)
        at, rng = np.flatnonzero(self.hot_tables > 1), np.random.default_rng([5, sweep])
        for _ in range(2):
            others = float(self.cold_root) + out.sum() - out[at]
            out[at] = seat(self.hot_tables[at], others, np.full(len(at), 1 / (self.types + 1)), ROOT_STRENGTH, rng)
        return out


def root_probability(customers: np.ndarray, root: np.ndarray, all_customers: float, all_tables: float, types: int) -> np.ndarray:
    back = (ROOT_STRENGTH + DISCOUNT * all_tables) / (types + 1)
    return np.maximum(customers - DISCOUNT * root + back, 1e-300) / (ROOT_STRENGTH + all_customers)


class Bucket:
    """All occurrences of the words of one bucket (of a hot word: with some of its contexts), and
    the seating of their training tokens."""

    def __init__(self, raws: list[bytes], hot: np.ndarray):
        blocks = [open_block(r) for r in raws]
        self.words, word = np.unique(np.concatenate([b[1] for b in blocks]), return_inverse=True)
        own = np.split(word, np.cumsum([len(b[1]) for b in blocks])[:-1])
        key = np.concatenate([np.repeat(w, b[2]) << 16 | b[3] for w, b in zip(own, blocks)])
        pairs, of_pair = np.unique(key, return_inverse=True)
        del key
        self.word, self.context = (pairs >> 16).astype(np.int32), (pairs & 0xFFFF).astype(np.uint16)
        del pairs
        cuts = np.cumsum([len(b[3]) for b in blocks])[:-1]
        self.of_pair = np.split(of_pair.astype(np.int32), cuts)
        del of_pair
        self.times, self.docs, self.flags = [b[4] for b in blocks], [b[5] for b in blocks], [b[0] for b in blocks]
        self.count = np.zeros(len(self.word), np.int64)
        for pair, times, docs, flags in zip(self.of_pair, self.times, self.docs, self.flags):
            taught = np.add.reduceat(flags[docs].astype(np.int64), np.concatenate([[0], np.cumsum(times, dtype=np.int64)[:-1]]))
            np.add.at(self.count, pair, taught)
        self.word_count = self.per_word(self.count)
        self.many = np.flatnonzero(self.count > 1)
        at = np.minimum(np.searchsorted(hot, self.words), max(0, len(hot) - 1))
        self.hot = np.flatnonzero(hot[at] == self.words) if len(hot) else np.empty(0, int)
        self.cold = np.setdiff1d(np.arange(len(self.words)), self.hot)
        self.place, self.n_hot = at[self.hot], len(hot)  # of the hot words, among all of them

    def per_word(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.word, x, len(self.words)).astype(np.int64)

    def per_context(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.context, x, CONTEXTS).astype(np.int64)

    def per_hot(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n_hot, np.int64)
        out[self.place] = x[self.hot]
        return out

    def burn_in(self, seed: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """(tables per pair, root tables per word) to start from: as no bucket knows the others'
        tables yet, each takes its own times the number of buckets for those of all."""
        rng = np.random.default_rng(seed)
        tables, root = np.minimum(self.count, 1), np.minimum(self.word_count, 1)
        types = max(1, int(root.sum()) * buckets)
        share = np.ones(len(self.words))
        share[self.hot] = buckets
        for _ in range(BURN_IN):
            customers = self.per_word(tables)
            base = root_probability(customers * share, root, customers.sum() * buckets, root.sum() * buckets, types)
            others = (self.per_context(tables)[self.context] - tables)[self.many] * float(buckets)
            tables[self.many] = seat(self.count[self.many], others, base[self.word[self.many]], STRENGTH, rng)
            self._seat_root(tables, root, float(root.sum()) * buckets, types, rng)
        return tables, root

    def _seat_root(self, tables: np.ndarray, root: np.ndarray, all_tables: float, types: int, rng: np.random.Generator) -> None:
        customers = self.per_word(tables)
        at = self.cold[customers[self.cold] > 1]
        root[at] = seat(customers[at], all_tables - root[at], np.full(len(at), 1 / (types + 1)), ROOT_STRENGTH, rng)

    def opening(self, tables: np.ndarray, root: np.ndarray) -> np.ndarray:
        """This bucket's share of `Totals.first`."""
        ends = [self.count.sum(), (self.word_count[self.cold] > 0).sum(), tables.sum(), root[self.cold].sum()]
        return np.concatenate([self.per_context(self.count), self.per_context(tables), self.per_hot(self.word_count), self.per_hot(self.per_word(tables)), ends]).astype(np.int64)

    def sweeps(self, seed: int, start: tuple[np.ndarray, np.ndarray], totals: Totals) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(tables, root tables) after each kept sweep; the first ones settle what began on the
        bucket's own totals and are not kept. Other buckets' tables stand as when they were summed,
        this bucket's own are its latest; every task that repeats this gets the same."""
        rng, (tables, root) = np.random.default_rng(seed), (x.copy() for x in start)
        before, before_root, before_hot = self.per_context(tables), root[self.cold].sum(), self.per_hot(self.per_word(tables))
        for k in range(-SETTLING, KEPT_SWEEPS):
            hot_root = totals.hot_root(k if k >= 0 else KEPT_SWEEPS - k)
            root[self.hot] = hot_root[self.place]
            customers, change = self.per_word(tables), self.per_hot(self.per_word(tables)) - before_hot
            all_customers = totals.customers + self.per_context(tables).sum() - before.sum()
            customers[self.hot] = (totals.hot_tables + change)[self.place]
            all_tables = totals.cold_root + root[self.cold].sum() - before_root + hot_root.sum()
            base = root_probability(customers, root, all_customers, all_tables, totals.types)
            here = totals.tables + self.per_context(tables) - before
            others = (here[self.context] - tables)[self.many].astype(float)
            tables[self.many] = seat(self.count[self.many], others, base[self.word[self.many]], STRENGTH, rng)
            self._seat_root(tables, root, float(all_tables), totals.types, rng)
            if k >= 0:
                yield tables, root

    def closing(self, tables: np.ndarray, root: np.ndarray) -> np.ndarray:
        """This bucket's share of one of `Totals.kept`."""
        return np.concatenate([self.per_context(tables), self.per_hot(self.per_word(tables)), [tables.sum(), root[self.cold].sum()]]).astype(np.int64)

    def log_probabilities(self, seed: int, start: tuple[np.ndarray, np.ndarray], totals: Totals) -> np.ndarray:
        """log10 of the predictive probability of each pair, averaged over the kept sweeps."""
        seen, p = totals.seen[self.context], np.zeros(len(self.word))
        for k, (tables, root) in enumerate(self.sweeps(seed, start, totals)):
            contexts, hot_tables, (all_customers, cold_root) = totals.kept[k]
            hot_root = np.minimum(totals.hot_root(k), hot_tables)
            customers, root = self.per_word(tables), root.copy()
            customers[self.hot], root[self.hot] = hot_tables[self.place], hot_root[self.place]
            base = root_probability(customers, root, all_customers, cold_root + hot_root.sum(), totals.types)
            back = STRENGTH + DISCOUNT * contexts[self.context]
            p += (self.count - DISCOUNT * tables + back * base[self.word]) / (STRENGTH + seen)
        return np.log10(p / KEPT_SWEEPS)


def score_language(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_fold: int = 2, buckets: int | None = None
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every whole text.

    Learns from documents whose crc32(id as text) mod `folds` is not `held_fold`. Tokens: words,
    A-Z in lower case, then one end. A word's probability after a context averages the
    predictive probabilities of the kept Gibbs sweeps: the context's restaurant (the word before,
    hashed to 2^16) backs off to the root, which backs off to one in V + 1 (all unknown words
    together are one type). Perplexity over documents is 10^(-sum(score) / sum(n_tokens)).

    Plan: a first pass finds the words that are a large share of all tokens. Then tasks turn
    blocks of documents into pairs (word, context), combined per block, and send each to its
    bucket: a word has one, but the contexts of a hot word are dealt to all, so no task holds
    one word whole. The number of buckets grows with the text, unless it is given. Buckets seat their words, their
    table totals (a fixed size: 2^16 contexts, at most 2^15 hot words) are summed as streams and
    broadcast, and the kept sweeps are drawn given these. Tasks that need a seating again repeat
    its draws, so seatings are not stored. Then each bucket gives every block its documents' sums.

    Null and empty texts are one end token; very long ones are hashed in parts. Documents without id are held out. Repeated rows are
    scored and learnt each time; an empty table gives no rows; other columns are not carried.
    """
    spark = docs.sparkSession
    fold = F.crc32(F.col(id_col).cast("string").cast("binary")) % folds
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(fold == held_fold, F.lit(True)).alias("held"), text_of(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = buckets or max(8, math.ceil(size / BUCKET_BYTES))
    hot = hot_words(rows.select("text"))
    shared_hot = spark.sparkContext.broadcast(hot)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        block = (context.partitionId() if context else 0) << 24
        docs, train, ids, tokens = [], [], [], 0

        def done() -> Iterator[pa.RecordBatch]:
            sizes = np.array([len(d) + 1 for d in docs], np.int64)
            known = np.array([i is not None for i in ids], np.uint8)
            head = b"".join([np.array([len(ids)], np.int64).tobytes(), np.array([i or 0 for i in ids], np.int64).tobytes(), sizes.tobytes(), known.tobytes(), np.array(train, np.uint8).tobytes()])
            found = [*pack_block(docs, train, buckets, shared_hot.value), (block % buckets, head)]
            for i in range(0, len(found), 16):
                part = found[i : i + 16]
                kinds = [int(x is head) for _, x in part]
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in part], pa.int32()), pa.array([block] * len(part), pa.int64()), pa.array(kinds, pa.int32()), pa.array([x for _, x in part], pa.binary())], names=["bucket", "block", "kind", "raw"])

        for rows in batches:
            for i, held, text in zip(*(c.to_pylist() for c in rows.columns)):
                docs.append(word_hashes(text))
                ids.append(i)
                train.append(not held)
                tokens += len(docs[-1]) + 1
                if tokens >= BLOCK_TOKENS or len(docs) >= BLOCK_DOCS:
                    yield from done()
                    docs, train, ids, tokens = [], [], [], 0
                    block += 1
        if docs:
            yield from done()

    def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list]]:
        held, at = [], None
        for rows in batches:
            for bucket, block, kind, raw in zip(*(c.to_pylist() for c in rows.columns)):
                if bucket != at and held:
                    yield at, held
                    held = []
                at = bucket
                held.append((block, kind, raw))
        if held:
            yield at, held

    def pieces(key: int, flat: np.ndarray) -> list[tuple]:
        return [(key, i, [], [], [], part.tobytes()) for i, part in enumerate(np.array_split(flat, CHUNKS))]

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Kind 0: a bucket's rows; kind 1: a piece of its share of the first totals."""
        for bucket, held in by_bucket(batches):
            held.sort(key=lambda x: (x[0], x[1]))
            blocks = [(b, r) for b, k, r in held if k == 0]
            heads = [(b, r) for b, k, r in held if k == 1]
            out: list = []
            if blocks:
                work = Bucket([r for _, r in blocks], shared_hot.value)
                out = pieces(1, work.opening(*work.burn_in(bucket + 1, buckets)))
                del work
            out.append((0, bucket, [b for b, _ in blocks], [r for _, r in blocks], [r for _, r in heads], b""))
            del blocks
            held.clear()
            while out:  # a bucket's row is large, so it travels alone and is held once
                row = out.pop(0)
                heads_of = [b for b, _ in heads] if row[0] == 0 else []
                yield pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int32()), pa.array([row[1]], pa.int32()), pa.array([row[2]], pa.list_(pa.int64())), pa.array([row[3]], pa.list_(pa.binary())), pa.array([heads_of], pa.list_(pa.int64())), pa.array([row[4]], pa.list_(pa.binary())), pa.array([row[5]], pa.binary())], names=["kind", "key", "blocks", "raws", "head_blocks", "heads", "state"])

    sent = rows.mapInArrow(spread, "bucket int, block long, kind int, raw binary").repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "block")
    learnt = settle(sent.mapInArrow(learn, "kind int, key int, blocks array<long>, raws array<binary>, head_blocks array<long>, heads array<binary>, state binary"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for rows in batches:
            for key, state in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                total[key] = total.get(key, 0) + np.frombuffer(state, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([t.tobytes() for t in total.values()], pa.binary())], names=["key", "state"])

    def summed(parts: DataFrame, size: int) -> np.ndarray:
        got = dict(parts.repartitionById(CHUNKS, F.col("key")).mapInArrow(add, "key int, state binary").collect())
        return np.concatenate([np.frombuffer(got[i], np.int64) if i in got else x for i, x in enumerate(np.array_split(np.zeros(size, np.int64), CHUNKS))])

    first = summed(learnt.where("kind = 1").select("key", "state"), 2 * CONTEXTS + 2 * len(hot) + 4)
    opened = spark.sparkContext.broadcast(Totals(first, len(hot)))
    train_tokens = opened.value.tokens

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces of each bucket's share of the kept totals."""
        for rows in batches:
            for r in range(rows.num_rows):
                bucket, raws = (rows.column(i)[r].as_py() for i in range(2))
                if raws:
                    work = Bucket(raws, shared_hot.value)
                    swept = work.sweeps(-bucket - 1 & 0xFFFFFFFF, work.burn_in(bucket + 1, buckets), opened.value)
                    flat = np.concatenate([work.closing(*s) for s in swept])
                    parts = pieces(0, flat)
                    yield pa.RecordBatch.from_arrays([pa.array([p[1] for p in parts], pa.int32()), pa.array([p[5] for p in parts], pa.binary())], names=["key", "state"])

    seated = learnt.where("kind = 0")
    width = CONTEXTS + len(hot) + 2
    kept = summed(seated.select("key", "raws").mapInArrow(sample, "key int, state binary"), KEPT_SWEEPS * width)
    shared = spark.sparkContext.broadcast(Totals(first, len(hot), np.split(kept, KEPT_SWEEPS)))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of each block's documents over one bucket's words: scores, and tokens that are not
        known (mostly none, which compresses well)."""
        totals = shared.value
        n, v = totals.tokens, totals.types
        for rows in batches:
            for r in range(rows.num_rows):
                bucket, blocks, raws, head_blocks, heads = (rows.column(i)[r].as_py() for i in range(5))
                for block, head in zip(head_blocks, heads):
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([1], pa.int32()), pa.array([head], pa.binary())], names=["block", "kind", "raw"])
                if not blocks:
                    continue
                work = Bucket(raws, shared_hot.value)
                logp = work.log_probabilities(-bucket - 1 & 0xFFFFFFFF, work.burn_in(bucket + 1, buckets), totals)
                word_count = work.word_count.copy()
                word_count[work.hot] = totals.hot_count[work.place]
                base_logp = np.log10((word_count + 1) / (n + v + 1))
                for block, pair, times, docs, flags in zip(blocks, work.of_pair, work.times, work.docs, work.flags):
                    each = np.repeat(pair, times)
                    word = work.word[each]
                    held = np.unique(docs)
                    sums = [np.bincount(docs, x, len(flags))[held] for x in (logp[each], base_logp[word], word_count[word] == 0)]
                    raw = b"".join([np.array([len(held)], np.int64).tobytes(), held.tobytes(), sums[0].astype(np.float32).tobytes(), sums[1].tobytes(), sums[2].astype(np.uint32).tobytes()])
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([0], pa.int32()), pa.array([raw], pa.binary())], names=["block", "kind", "raw"])
                del work, raws, logp, base_logp, each, word, held, sums, raw

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A block's head comes first, then its sums from each bucket."""
        at, head, sums = None, None, None

        def done() -> pa.RecordBatch:
            n = int(np.frombuffer(head, np.int64, 1)[0])
            ids, sizes = np.frombuffer(head, np.int64, n, 8), np.frombuffer(head, np.int64, n, 8 + 8 * n)
            known, train = np.frombuffer(head, np.uint8, n, 8 + 16 * n), np.frombuffer(head, np.uint8, n, 8 + 17 * n)
            columns = [pa.array(ids, mask=known == 0), pa.array(train == 0), pa.array(sizes), pa.array(sizes - sums[2].astype(np.int64)), pa.array(np.full(n, train_tokens)), pa.array(sums[1]), pa.array(sums[0])]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

        for rows in batches:
            for block, kind, raw in zip(*(c.to_pylist() for c in rows.columns)):
                if block != at:
                    if head is not None:
                        yield done()
                    at, head = block, raw
                    sums = np.zeros((3, int(np.frombuffer(raw, np.int64, 1)[0])))
                    continue
                m = int(np.frombuffer(raw, np.int64, 1)[0])
                docs = np.frombuffer(raw, np.uint16, m, 8)
                sums[0, docs] += np.frombuffer(raw, np.float32, m, 8 + 2 * m)
                sums[1, docs] += np.frombuffer(raw, np.float64, m, 8 + 6 * m)
                sums[2, docs] += np.frombuffer(raw, np.uint32, m, 8 + 14 * m)
        if head is not None:
            yield done()

    parts = seated.select("key", "blocks", "raws", "head_blocks", "heads").mapInArrow(judge, "block long, kind int, raw binary")
    parts = parts.repartition(partitions_for(spark), "block").sortWithinPartitions("block", F.desc("kind"), F.xxhash64("raw"))
    return parts.mapInArrow(gather, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
