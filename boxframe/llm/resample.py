"""Importance resampling towards a target text, by hashed n-grams with a head-tail vocabulary."""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxframe.llm.common import settle, text_of
from boxframe.operators.ranks import ranked

BUCKETS = 10_000
#: A word or pair is frequent if it is one in HEAD_SHARE of the tokens of some block of
#: BLOCK_WORDS; these counts summed, fewer than 2 * HEAD_SHARE can be one in twice that of all.
HEAD_SHARE, BLOCK_WORDS = 1 << 12, 1 << 17
#: Longer words are never in the head, so it has a size in bytes too.
HEAD_BYTES = 64
#: Texts of more bytes are taken in parts, cut between words.
PART_BYTES = 1 << 20
#: Bytes of feature buckets after which a task's rows go on.
FLUSH_BYTES = 4 << 20

_WORD = [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]
#: A-Z in lower case; all other bytes that belong to no word are spaces.
_TABLE = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if b in _WORD or 0x41 <= b <= 0x5A else 32 for b in range(256))


def word_parts(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a text; those of a very long one in parts."""
    clean, at = raw.translate(_TABLE), 0
    while at < len(clean):
        end = at + PART_BYTES
        if end < len(clean):
            end = clean.find(b" ", end)
            end = len(clean) if end < 0 else end
        yield clean[at:end].split()
        at = end


@dataclass
class Head:
    """Frequent words with the CRC-32 of each and its state after a space, and the buckets of
    frequent pairs, by the numbers of their words."""

    number: dict[bytes, int]
    own: np.ndarray
    state: np.ndarray
    pairs: np.ndarray
    pair_buckets: np.ndarray

    @staticmethod
    def of(words: list[bytes], pairs: list[tuple[bytes, bytes]]) -> Head:
        number = {w: i for i, w in enumerate(words)}
        own = np.array([crc32(w) for w in words], np.uint32)
        state = np.array([crc32(b" ", c) for c in own.tolist()], np.uint32)
        known = [(number[a] * len(words) + number[b], crc32(b, int(state[number[a]])) % BUCKETS) for a, b in pairs if a in number and b in number]
        known.sort()
        return Head(number, own, state, np.array([k for k, _ in known], np.int64), np.array([b for _, b in known], np.uint16))

    def buckets(self, raw: bytes) -> tuple[int, np.ndarray]:
        """The number of words of a text, and the buckets of all its words and pairs."""
        found, n, last = [], 0, []
        for words in word_parts(raw):
            n += len(words)
            found += self._buckets(last + words, len(last))
            last = words[-1:] or last
        return n, np.concatenate(found) if found else np.empty(0, np.uint16)

    def _buckets(self, words: list[bytes], skip: int) -> list[np.ndarray]:
        """`skip`: so many first words have been counted before, as words."""
        if not words:
            return []
        at = np.fromiter(map(self.number.get, words, itertools.repeat(-1)), np.int64, len(words))
        tail = np.flatnonzero(at < 0).tolist()
        own = self.own[at] if len(self.own) else np.zeros(len(words), np.uint32)
        own[tail] = [crc32(words[i]) for i in tail]
        first, second = at[:-1], at[1:]
        pair_buckets = np.zeros(len(first), np.uint16)
        met = np.zeros(len(first), bool)
        if len(self.pairs):
            code = np.where((first >= 0) & (second >= 0), first * len(self.own) + second, -1)
            place = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
            met = self.pairs[place] == code
            pair_buckets[met] = self.pair_buckets[place[met]]
        # What is not in the head: the word before as a state if it is frequent, else from its CRC.
        head, rest = np.flatnonzero(~met & (first >= 0)), np.flatnonzero(~met & (first < 0))
        begun = self.state[first[head]].tolist() if len(head) else []
        pair_buckets[head] = [crc32(words[i], s) % BUCKETS for i, s in zip((head + 1).tolist(), begun)]
        pair_buckets[rest] = [crc32(b" " + words[i], s) % BUCKETS for i, s in zip((rest + 1).tolist(), own[rest].tolist())]
        return [(own[skip:] % BUCKETS).astype(np.uint16), pair_buckets]


def block_heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, n, words): the frequent words a and pairs a b of each block of words."""
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("n", pa.int64()), ("words", pa.int64())])
    words, pairs, seen = Counter(), Counter(), 0

    def block() -> pa.RecordBatch:
        least = max(1, seen // HEAD_SHARE)
        rows = [(w, None, n, 0) for w, n in words.items() if n >= least and len(w) <= HEAD_BYTES]
        rows += [(a, b, n, 0) for (a, b), n in pairs.items() if n >= least and len(a) <= HEAD_BYTES and len(b) <= HEAD_BYTES]
        rows.append((None, None, 0, seen))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    for batch in batches:
        for raw in batch.column(0):
            for part in word_parts(raw.as_py()):
                words.update(part)
                pairs.update(zip(part, part[1:]))
                seen += len(part)
                if seen >= BLOCK_WORDS:
                    yield block()
                    words.clear()
                    pairs.clear()
                    seen = 0
    if seen:
        yield block()


def learn_head(texts: DataFrame) -> Head:
    """The head of all texts (one binary column). A word or pair that is one in `HEAD_SHARE` of all
    is so in some block, which names it with its count there."""
    named = settle(texts.mapInArrow(block_heads, "a binary, b binary, n long, words long"))
    counts = named.where("a is not null").groupBy("a", "b").agg(F.sum("n").alias("n"))
    total = named.agg(F.sum("words").alias("total"))  # one row
    # So there are fewer than 2 * HEAD_SHARE of either.
    rows = counts.join(F.broadcast(total), F.col("n") * 2 * HEAD_SHARE > F.col("total")).select("a", "b").collect()
    return Head.of(sorted(bytes(r.a) for r in rows if r.b is None), [(bytes(r.a), bytes(r.b)) for r in rows if r.b is not None])


def feature_buckets(docs: DataFrame, text_col: str, kept: list[str], head: Head) -> DataFrame:
    """`kept` columns of `docs` with n_words, n_features and buckets, two bytes a feature."""
    kinds = [(c, t) for c, t in docs.dtypes if c in kept]
    schema = ", ".join([*(f"`{c}` {t}" for c, t in kinds), "n_words long, n_features long, buckets binary"])
    sent = docs.sparkSession.sparkContext.broadcast(head)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = sent.value
        for batch in batches:
            begin, words, found, size = 0, [], [], 0
            for i, raw in enumerate(batch.column(len(kinds))):
                n, b = here.buckets(raw.as_py())
                words.append(n)
                found.append(b.tobytes())
                size += b.nbytes
                if size >= FLUSH_BYTES or i == batch.num_rows - 1:
                    own = batch.slice(begin, i + 1 - begin).columns[: len(kinds)]
                    made = [pa.array(words, pa.int64()), pa.array([len(x) // 2 for x in found], pa.int64()), pa.array(found, pa.binary())]
                    yield pa.RecordBatch.from_arrays([*own, *made], [*(c for c, _ in kinds), "n_words", "n_features", "buckets"])
                    begin, words, found, size = i + 1, [], [], 0

    return docs.select(*[c for c, _ in kinds], text_of(text_col).cast("binary").alias("raw")).mapInArrow(run, schema)


def bucket_totals(features: DataFrame) -> DataFrame:
    """(bucket, n): how many features of all rows lie in each bucket; every task sums its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for b in batch.column(0):
                total += np.bincount(np.frombuffer(b.as_py(), np.uint16), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    return features.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(source: DataFrame, target: DataFrame) -> DataFrame:
    """(bucket, gain) of all buckets: thousand times the log ratio of a feature's smoothed shares
    in the target and in the source."""
    every = source.sparkSession.range(BUCKETS).withColumnRenamed("id", "bucket")
    counts = every.join(source.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").na.fill(0)
    totals = counts.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))  # one row
    share = lambda n, m: (F.col(n) + 1).cast("double") * (F.col(m) + BUCKETS).cast("double")
    return counts.join(F.broadcast(totals)).select("bucket", F.floor(F.lit(1000.0) * F.ln(share("t", "all_s") / share("s", "all_t"))).alias("gain"))


def summed_gains(features: DataFrame, gains: np.ndarray) -> DataFrame:
    """`features` with `gain`, the sum over its buckets, in place of these."""
    own = [(c, t) for c, t in features.dtypes if c != "buckets"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [int(gains[np.frombuffer(b.as_py(), np.uint16)].sum()) for b in batch.column(len(own))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(own)], pa.array(sums, pa.int64())], [*(c for c, _ in own), "gain"])

    schema = ", ".join([*(f"`{c}` {t}" for c, t in own), "gain long"])
    return features.select(*[c for c, _ in own], "buckets").mapInArrow(run, schema)


def resample(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_words: int = 20, percent: int = 25, seed: int = 7) -> DataFrame:
    """(id, n_features, weight, score, rank) for every row of `docs`: importance resampling without
    replacement towards the texts of `target`.

    A-Z are lowered, words are runs of digits, letters and all characters from U+0080 on; features
    are the words and the pairs of neighbours, hashed by CRC-32 into buckets. Exact totals per
    bucket of both sides give a gain; a row's weight is the mean over its features, its score adds
    Gumbel noise from the id. The `percent` best of the rows with at least `least_words` words
    get a rank from 1 on, ties by id.

    Words and pairs that are frequent in some block of words are a head of bounded size, sent to
    all tasks: a word's CRC, its state after a space, a pair's bucket. Every other feature takes its
    CRC directly; results do not depend on the head. Nulls: a null text has no features, a null id
    counts as an empty text and comes first among ties. Rows may repeat; equal ones follow each
    other. Very long texts are taken in parts; an empty table on either side gives no rows, or
    gains of an empty target. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    head = learn_head(rows.select(text_of("text").cast("binary").alias("raw")))
    features = settle(feature_buckets(rows, "text", ["id"], head))
    aims = feature_buckets(target.select(F.col(text_col).alias("text")), "text", [], head)
    gains = np.zeros(BUCKETS, np.int64)
    for r in bucket_gains(bucket_totals(features), bucket_totals(aims)).collect():  # BUCKETS rows
        gains[r.bucket] = r.gain
    weighed = summed_gains(features, gains)
    mean = F.when(F.col("n_features") > 0, F.expr("gain div n_features - int(gain % n_features < 0)")).otherwise(0).cast("long")
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    drawn = F.floor(F.lit(-1000.0) * F.ln(-F.ln((noise + F.lit(0.5)) / F.lit(4294967296.0))))
    scored = weighed.select("id", "n_features", (F.col("n_words") >= least_words).alias("able"), mean.alias("weight")).withColumn("score", F.col("weight") + drawn)
    placed = ranked(scored, [F.desc("able"), F.desc("score"), F.asc("id"), F.asc("n_features"), F.asc("weight")], "place")
    able = scored.agg(F.count_if("able").alias("n_able"))  # one row
    rank = F.when(F.col("able") & (F.col("place") < F.floor(F.lit(percent) * F.col("n_able") / 100)), F.col("place") + 1)
    return placed.join(F.broadcast(able)).select(F.col("id").alias(id_col), "n_features", "weight", "score", rank.cast("long").alias("rank"))


#: The CRC-32 of a feature's bytes by the usual table of 256 states, made from the polynomial.
ORACLE = r"""
with k as (select list(list_reduce(list_prepend(b::ubigint, range(8)::ubigint[]), lambda x, _: case when x & 1 = 1 then xor(x >> 1, 3988292384::ubigint) else x >> 1 end) order by b) k from (select unnest(range(256)) b)),
a as (select 0 side, doc_id id, text from documents union all select 1, null, text from benchmark),
w as (select row_number() over () row, side, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from a),
f as (select row, side, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) f from w),
c as (select row, side, f, count(*) n from f group by all),
h as (select f, hex(encode(f)) x from (select distinct f from c)),
b as (select f, xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(range(0, len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::ubigint)), lambda c, v: xor(k[((xor(c, v) & 255) + 1)::bigint], c >> 8)), 4294967295::ubigint) % 10000 b from h, k),
e as (select row, side, b, sum(n) n from c join b using (f) group by all),
s as (select b, sum(n) filter (side = 0) s, sum(n) filter (side = 1) t from e group by b),
z as (select (select coalesce(sum(s), 0) from s) s, (select coalesce(sum(t), 0) from s) t),
g as (select b, floor(1000 * ln(((coalesce(s.t, 0) + 1)::double * (z.s + 10000)::double) / ((coalesce(s.s, 0) + 1)::double * (z.t + 10000)::double)))::bigint gain from s, z),
d as (select row, sum(n)::bigint n_features, sum(n * gain)::bigint gain from e join g using (b) where side = 0 group by row),
v as (select id doc_id, len(w) n_words, coalesce(n_features, 0) n_features, coalesce(floor(gain / n_features), 0)::bigint weight, ('0x' || sha256('7:' || coalesce(id::varchar, ''))[:8])::bigint h from w left join d using (row) where side = 0),
o as (select *, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296)))::bigint score from v),
r as (select *, row_number() over (partition by n_words >= 20 order by score desc, doc_id nulls first) r, count(*) over (partition by n_words >= 20) n from o)
select doc_id, n_features::bigint n_features, weight, score, case when n_words >= 20 and r <= (25 * n) // 100 then r end rank from r
"""
