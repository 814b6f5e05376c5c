"""Sum-of-squares online packing of tokenised documents into fixed windows."""

from __future__ import annotations

import os
import string
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxframe.llm.bpe import byte_letters
from boxframe.llm.common import settle, text_of

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
#: So many partitions' open windows go to one second packer.
FAN_BITS = 3
#: Kept words, by number and by characters.
CACHE_WORDS, CACHE_CHARS = 800_000, 50_000_000
#: More open windows than this are poured together early, so a packer's memory is bounded.
OPEN_WINDOWS = 4096

#: Texts of about so many characters are encoded at once.
BLOCK_CHARS = 4_000_000
#: Letters whose lower case depends on their neighbours, or is another in the library.
ODD_CASE = ("\u03a3", "\u0130")

_encoders: dict[str, "WordEncoder"] = {}


class WordEncoder:
    """Ids of whole texts, by a cache over words and marks.

    The tokenizer lowers letters, drops white space and never joins across it or across a border
    between letters and the marks after them, so a text's ids are those of its pieces between
    spaces in a row, in lower case, and a word with marks at its end has those of the word, then
    those of the marks. Each different piece of a block of texts is looked up once. Only texts that
    hold a special token's string go to the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.words_only = Tokenizer(self.tokenizer.model)  # for words that need no other step of the tokenizer
        self.words_only.pre_tokenizer = CharDelimiterSplit(" ")
        self.letters = {b: letter for letter, b in byte_letters().items() if b != 32}
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        ends = [i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]
        self.ends_word = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends_word[ends] = True
        self.cache: dict[str, bytes] = {}
        self.cached_chars = 0

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _word_ids(self, text: str) -> np.ndarray:
        """Ids of words between spaces: letters only, normalised and in lower case, so that bytes are all that is left to do."""
        text = text.encode().decode("latin-1").translate(self.letters)
        return np.array(self.words_only.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _split(self, ids: np.ndarray, begins: list[int], ends: list[int]) -> list[bytes]:
        raw = ids.tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip(begins, ends)]

    def _learn(self, words: list[str], others: list[str]) -> None:
        """Ids of new pieces, many a call: plain words are one token run each, which ends at a token
        that ends a word; a special token parts the others."""
        for i in range(0, len(words), 2000):
            part = words[i : i + 2000]
            ids = self._word_ids(" ".join(part))
            ends = (np.flatnonzero(self.ends_word[ids]) + 1).tolist()
            self.cache.update(zip(part, self._split(ids, [0, *ends[:-1]], ends), strict=True))
        mark = self.special[-1]
        for i in range(0, len(others), 2000):
            part = others[i : i + 2000]
            ids = self._ids(mark.join(part))
            cuts = np.flatnonzero(ids == self.tokenizer.token_to_id(mark)).tolist()
            self.cache.update(zip(part, self._split(ids, [0, *(c + 1 for c in cuts)], [*cuts, len(ids)]), strict=True))

    def _look_up(self, pieces: list[str], plain: bool) -> list[bytes]:
        """Ids of different pieces; in plain ones a word is looked up without the marks at its end."""
        found = list(map(self.cache.get, pieces))
        absent = [i for i, ids in enumerate(found) if ids is None]
        if not absent:
            return found
        words = [pieces[i].rstrip(string.punctuation) if plain else "" for i in absent]
        words = [w if w.isalpha() else "" for w in words]
        marks = [pieces[i][len(w) :] for i, w in zip(absent, words)]
        needed = {*words, *marks}
        missing = needed.difference(self.cache)
        chars = sum(map(len, missing))
        if len(self.cache) + len(missing) > CACHE_WORDS or self.cached_chars + chars > CACHE_CHARS:
            self.cache.clear()
            missing, self.cached_chars = needed, 0
            chars = sum(map(len, missing))
        self.cached_chars += chars
        known = missing.intersection(words)
        known.discard("")
        self._learn(list(known), list(missing - known))
        for i, w, m in zip(absent, words, marks):
            found[i] = self.cache[w] + self.cache[m]
        return found

    def _encode(self, texts: list[str], plain: bool) -> list[bytes]:
        lists = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        pieces = lists.values.dictionary_encode()
        different = pa.ListArray.from_arrays(pa.array([0, len(pieces.dictionary)], pa.int32()), pieces.dictionary)
        names = pc.binary_join(different, pa.scalar(" ", pa.large_string()))[0].as_py().split(" ")  # faster than one by one
        most = max(1, CACHE_WORDS // 8)  # with the marks apart twice as many at most, so the cache keeps its bound
        known = [ids for i in range(0, len(names), most) for ids in self._look_up(names[i : i + most], plain)]
        ids = pa.array(known, pa.large_binary()).take(pieces.indices)
        at = np.frombuffer(ids.buffers()[1], np.int64)[lists.offsets.to_numpy()].tolist()
        raw = memoryview(ids.buffers()[2] or b"")
        return [bytes(raw[a:b]) for a, b in zip(at, at[1:])]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out = [b""] * len(texts)
        groups: dict[bool, list[tuple[int, str]]] = {True: [], False: []}
        for i, text in enumerate(texts):
            if any(s in text for s in self.special):
                out[i] = self._ids(text).tobytes()
                continue
            plain = is_normalized("NFC", text) and not any(c in text for c in ODD_CASE) and is_normalized("NFC", low := text.lower())
            groups[plain].append((i, (low if plain else text).replace("\n", " ")))
        for plain, group in groups.items():
            if group:
                for (i, _), ids in zip(group, self._encode([t for _, t in group], plain)):
                    out[i] = ids
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_batch([text])[0]


def encoder(path: str) -> WordEncoder:
    """One encoder a worker process and file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


class SumOfSquares:
    """Windows of `capacity`; `counts[h]` is how many open windows are filled to level h.

    A piece of size s goes to the level h (0: a new window) for which the sum of squared counts
    after the move from h to h + s is smallest; ties go to the fullest level. Full windows leave.
    """

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.counts = np.zeros(capacity + 1, np.int64)
        self.at: dict[int, list[list]] = {}
        self.open = 0

    def level_for(self, size: int) -> int:
        room = self.capacity - size
        change = 2 * self.counts[size + 1 :] - 2 * self.counts[1 : room + 1] + 2
        if room:
            change[-1] -= 1  # the window becomes full and is no longer counted
            held = self.counts[1 : room + 1] > 0
            if held.any():
                change = np.where(held, change, np.iinfo(np.int64).max)
                best = room - 1 - int(np.argmin(change[::-1]))
                if change[best] <= 2 * self.counts[size] + 1:
                    return best + 1
        return 0

    def place(self, piece: tuple, size: int) -> list | None:
        """The window's pieces if it is now full."""
        level = self.level_for(size) if size < self.capacity else 0
        if level:
            window = self.at[level].pop()
            self.counts[level] -= 1
            self.open -= 1
        else:
            window = []
        window.append(piece)
        if level + size == self.capacity:
            return window
        self.at.setdefault(level + size, []).append(window)
        self.counts[level + size] += 1
        self.open += 1
        return None

    def drain(self) -> list[list]:
        left = [w for level in sorted(self.at, reverse=True) for w in self.at[level]]
        self.at, self.open = {}, 0
        self.counts[:] = 0
        return left


def _pour(windows: list[list], capacity: int, last: bool) -> Iterator[list]:
    """Cut the pieces of open windows into full sequences; what remains goes into sequences of
    powers of two (no padding), or back to the packer if it goes on."""
    pieces = [p for w in windows for p in w][::-1]
    left = sum(len(p[2]) // 4 for p in pieces)
    while left:
        if left < capacity and not last:
            yield pieces[::-1]
            return
        room = capacity if left >= capacity else 1 << (left.bit_length() - 1)
        left -= room
        window = []
        while room:
            doc, start, ids, total = pieces.pop()
            take = min(room, len(ids) // 4)
            window.append((doc, start, ids[: 4 * take], total))
            if 4 * take < len(ids):
                pieces.append((doc, start + take, ids[4 * take :], total))
            room -= take
        yield window


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 4096,
    end_id: int = 2,
) -> DataFrame:
    """One row per piece (`PIECES`): every document's ids, then `end_id`, in windows of `capacity`.

    Each input partition has its own online packer, so texts are not shuffled and a lost task is
    redone alone. Documents longer than a window give full windows first; the rest is placed whole
    by the sum-of-squares rule. When a partition ends, the pieces of its open windows (a fixed
    number at most, so a small share of a large partition) go on to a second packer for every 8
    partitions, which places them by the same rule. What that leaves open is poured together and
    cut, and the last ids go into sequences whose lengths are powers of two, so no sequence needs
    padding. A sequence's id holds its packer's number above bit 32, second ones above bit 62.

    Null and empty texts give one piece that holds `end_id`. Repeated rows are packed each time.
    An empty table gives no rows. Extra columns of the input are not carried. A null id stays null.
    """

    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    class Rows:
        """Numbered windows as rows."""

        def __init__(self, first: int):
            self.next = first

        def of(self, windows: list[list]) -> pa.RecordBatch:
            columns: list[list] = [[] for _ in schema]
            for window in windows:
                offset = 0
                for doc, start, ids, total in window:
                    size = len(ids) // 4
                    for c, v in zip(columns, (doc, start, size, ids, total, self.next, offset)):
                        c.append(v)
                    offset += size
                self.next += 1
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    def placed(packer: SumOfSquares, piece: tuple, done: list[list]) -> None:
        """Place a piece; too many open windows are poured, and what is no full window placed again."""
        if window := packer.place(piece, len(piece[2]) // 4):
            done.append(window)
        if packer.open <= OPEN_WINDOWS:
            return
        for window in _pour(packer.drain(), capacity, False):
            if sum(len(p[2]) // 4 for p in window) == capacity:
                done.append(window)
            else:
                for p in window:
                    if full := packer.place(p, len(p[2]) // 4):
                        done.append(full)

    def marked(batch: pa.RecordBatch, left: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array([left] * batch.num_rows, pa.bool_())], [*batch.schema.names, "left"])

    def encoded(rows: pa.RecordBatch) -> Iterator[tuple]:
        """Each row's id and ids, encoded in blocks of about `BLOCK_CHARS` characters."""
        encode, ids, texts, size = encoder(tokenizer).encode_batch, [], [], 0
        for i, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
            ids.append(i)
            texts.append(text)
            size += len(text)
            if size >= BLOCK_CHARS:
                yield from zip(ids, encode(texts))
                ids, texts, size = [], [], 0
        yield from zip(ids, encode(texts))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        rows_of = Rows((context.partitionId() if context else 0) << 32)
        packer, end = SumOfSquares(capacity), np.array([end_id], "<u4").tobytes()
        for rows in batches:
            done: list[list] = []
            for doc, ids in encoded(rows):
                ids += end
                for at in range(0, len(ids) // 4, capacity):
                    placed(packer, (doc, at, ids[4 * at : 4 * (at + capacity)], len(ids) // 4), done)
                if len(done) > 256:
                    yield marked(rows_of.of(done), False)
                    done = []
            if done:
                yield marked(rows_of.of(done), False)
        left = packer.drain()
        for i in range(0, len(left), 256):
            yield marked(rows_of.of(left[i : i + 256]), True)

    def pack_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces come sorted by group, window and offset; each group has a packer of its own."""
        packer, group, rows_of = SumOfSquares(capacity), None, Rows(0)
        for rows in batches:
            done: list[list] = []
            groups = rows.column(0).to_pylist()
            for now, *piece in zip(groups, *(rows.column(c).to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens"))):
                if now != group:
                    done += _pour(packer.drain(), capacity, True)
                    if done:
                        yield rows_of.of(done)
                        done = []
                    group, rows_of = now, Rows((1 << 62) + (now << 32))
                placed(packer, tuple(piece), done)
                if len(done) > 256:
                    yield rows_of.of(done)
                    done = []
            if done:
                yield rows_of.of(done)
        if done := list(_pour(packer.drain(), capacity, True)):
            yield rows_of.of(done)

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    first = settle(texts.mapInArrow(pack, f"{PIECES}, left boolean"))
    open_ = first.where("left").withColumn("group", F.shiftright("sequence_id", 32 + FAN_BITS))
    again = open_.select("group", "doc_id", "start", "ids", "doc_tokens", "sequence_id", "offset").repartition("group").sortWithinPartitions("group", "sequence_id", "offset")
    return first.where("not left").drop("left").unionByName(again.mapInArrow(pack_again, PIECES))
