"""Byte-level BPE by speculation: greedy proposals, vectorised pair checks, exact merging of the rest."""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxframe.llm.common import text_of

CODED = "doc_id long, ids binary, decoded string"
#: Kept pieces, by number and by characters.
CACHE_PIECES, CACHE_CHARS = 800_000, 50_000_000
#: Longer words are merged by a heap.
HEAP_BYTES = 100
NO_MERGE = (1 << 60, -1)

#: Fixed value: the pattern by which the byte-level pre-tokenizer of the public files cuts text.
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_coders: dict[str, "SpeculativeBpe"] = {}


def byte_letters() -> dict[str, int]:
    """The public byte-to-letter rule: printable bytes stand for themselves, the rest follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class SpeculativeBpe:
    """Encodes and decodes whole texts.

    A row of tokens is the exact encoding of a word if each token is the encoding of its own
    bytes and no merge across a border between two neighbours would come before the merges that
    build them. So a greedy longest-match proposal is verified pair by pair, for all new words of
    a batch at once; words that fail are merged exactly.
    """

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        words = {t: i for t, i in vocab.items() if t not in self.special}
        self.ids = {raw(t): i for t, i in words.items()}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for b, i in self.ids.items():
            self.bytes_of[i] = b
        for t, i in self.special.items():
            self.bytes_of[i] = t.encode()
        self.rank = np.full(size, -1, np.int64)  # -1: a single byte
        self.left, self.right = np.zeros(size, np.int64), np.zeros(size, np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        keys = np.empty(len(merges), np.int64)
        for r, (a, b) in enumerate(merges):
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.merge[x, y] = (r, z)
            keys[r] = x * size + y
            if self.rank[z] < 0:
                self.rank[z], self.left[z], self.right[z] = r, x, y
        self.size, self.order = size, np.argsort(keys)
        self.keys = keys[self.order]
        self.one = [self.ids[bytes((b,))] for b in range(256)]
        self.longest: dict[bytes, int] = {}  # by the first two bytes
        for b in self.ids:
            self.longest[b[:2]] = max(len(b), self.longest.get(b[:2], 0))
        self.find = regex.compile(PRE_TOKEN).findall
        self.cut = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self.own: dict[int, bool] = {}
        self.cache: dict[str, bytes] = {}
        self.cached_chars = 0
        self.counts = {"proposed": 0, "merged": 0}

    def merge_exactly(self, word: bytes) -> list[int]:
        """Merge the pair of lowest rank, the leftmost of equals, until none is left."""
        if len(word) > HEAP_BYTES:
            return self._merge_by_heap(word)
        one, merge, none = self.one, self.merge, NO_MERGE
        ids = [one[b] for b in word]
        ranks = [merge.get(p, none) for p in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best is none:
                break
            at = ranks.index(best)
            ids[at : at + 2] = [best[1]]
            del ranks[at]
            if at:
                ranks[at - 1] = merge.get((ids[at - 1], ids[at]), none)
            if at < len(ranks):
                ranks[at] = merge.get((ids[at], ids[at + 1]), none)
        return ids

    def _merge_by_heap(self, word: bytes) -> list[int]:
        """The same for long words: pairs wait in a heap, tokens are a linked list of places."""
        merge, n = self.merge, len(word)
        ids = [self.one[b] for b in word]
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(found[0], i, pair, found[1]) for i, pair in enumerate(zip(ids, ids[1:])) if (found := merge.get(pair))]
        heapq.heapify(heap)
        while heap:
            _, at, pair, made = heapq.heappop(heap)
            right = after[at]
            if right >= n or ids[at] != pair[0] or ids[right] != pair[1]:
                continue  # one of the two has been merged since
            ids[at], ids[right] = made, -1
            after[at] = after[right]
            if after[at] < n:
                before[after[at]] = at
            for i in (before[at], at):
                if i >= 0 and after[i] < n and (found := merge.get((ids[i], ids[after[i]]))):
                    heapq.heappush(heap, (found[0], i, (ids[i], ids[after[i]]), found[1]))
        return [i for i in ids if i >= 0]

    def _is_own(self, token: int) -> bool:
        if token not in self.own:
            self.own[token] = self.merge_exactly(self.bytes_of[token]) == [token]
        return self.own[token]

    def propose(self, word: bytes) -> list[int]:
        """Longest token first, from the left."""
        ids, own, longest, out, at, n = self.ids, self.own, self.longest, [], 0, len(word)
        while at < n:
            end = min(n, at + longest.get(word[at : at + 2], 1))
            while (i := ids.get(word[at:end])) is None or not (own.get(i) or self._is_own(i)):
                end -= 1
            out.append(i)
            at = end
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of tokens: does no merge cross their border?

        Merges run in the order of their ranks. Undo the later of the two tokens' last merges
        again and again; a merge of the two tokens at the border that ranks before the ones
        undone would have come first. At equal ranks the left one is done first.
        """
        x, y = a.astype(np.int64), b.astype(np.int64)
        never = np.iinfo(np.int64).max
        next_x, next_y = np.full(len(x), never), np.full(len(x), never)
        good, live = np.ones(len(x), bool), np.arange(len(x))
        while len(live):
            u, v = x[live], y[live]
            key = u * self.size + v
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = self.keys[at] == key
            across = np.where(found, self.order[at], never)
            crossed = found & (across < next_x[live]) & (across <= next_y[live])
            good[live[crossed]] = False
            ru, rv = self.rank[u], self.rank[v]
            on = ~crossed & ((ru >= 0) | (rv >= 0))
            live, u, v, ru, rv = live[on], u[on], v[on], ru[on], rv[on]
            undo_x = ru > rv
            i, j = live[undo_x], live[~undo_x]
            next_x[i], x[i] = ru[undo_x], self.right[u[undo_x]]
            next_y[j], y[j] = rv[~undo_x], self.left[v[~undo_x]]
        return good

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        out = [self.propose(w) for w in words]
        sizes = np.fromiter(map(len, out), np.int64, len(out))
        flat = np.fromiter((i for ids in out for i in ids), np.int64, int(sizes.sum()))
        word = np.repeat(np.arange(len(out)), sizes)
        inner = np.flatnonzero(word[1:] == word[:-1])
        pairs, back = np.unique(flat[inner] * self.size + flat[inner + 1], return_inverse=True)
        good = self.compatible(pairs // self.size, pairs % self.size)[back] if len(pairs) else np.ones(0, bool)
        failed = np.unique(word[inner[~good]])
        for i in failed.tolist():
            out[i] = self.merge_exactly(words[i])
        self.counts["proposed"] += len(words)
        self.counts["merged"] += len(failed)
        return out

    def _learn(self, pieces: list[str]) -> None:
        """Ids of new pieces; a piece may hold several pre-tokens."""
        parts = [self.find(p) for p in pieces]
        words = list({w for ws in parts for w in ws})
        ids = self.encode_words([w.encode() for w in words])
        known = {w: np.array(i, "<u4").tobytes() for w, i in zip(words, ids)}
        self.cache.update((p, b"".join(map(known.__getitem__, ws))) for p, ws in zip(pieces, parts))

    def _cut(self, text: str) -> list[str]:
        """Pieces whose borders are sure to be borders of pre-tokens: before each space or line
        feed, if no two characters of white space are neighbours; else the pre-tokens."""
        if "\x00" in text or SPACE_RUN.search(text):
            return self.find(text)
        return text.replace("\n", "\x00\n").replace(" ", "\x00 ").split("\x00")

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        rows: list[list] = []
        for text in texts:
            row, at = [], 0
            for m in self.cut.finditer(text) if self.cut else ():
                row += [*self._cut(text[at : m.start()]), self.special[m[0]]]
                at = m.end()
            rows.append(row + self._cut(text[at:] if at else text))
        pieces = {p for row in rows for p in row}.difference(self.special.values())
        missing = pieces.difference(self.cache)
        chars = sum(map(len, missing))
        if len(self.cache) + len(missing) > CACHE_PIECES or self.cached_chars + chars > CACHE_CHARS:
            self.cache.clear()
            missing, self.cached_chars, chars = pieces, 0, sum(map(len, pieces))
        self.cached_chars += chars
        self._learn(list(missing))
        self.cache.update((i, np.array([i], "<u4").tobytes()) for i in self.special.values())
        return [b"".join(map(self.cache.__getitem__, row)) for row in rows]

    def decode(self, ids: bytes) -> str:
        tokens = np.frombuffer(ids, "<u4").tolist()
        return b"".join(map(self.bytes_of.__getitem__, tokens)).decode("utf-8", "replace")


SPACE_RUN = re.compile(r"\s\s")


def coder(path: str) -> SpeculativeBpe:
    """One coder a worker process and file."""
    if path not in _coders:
        _coders[path] = SpeculativeBpe(path)
    return _coders[path]


def encode_and_decode(
    docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", batch_chars: int = 2_000_000
) -> DataFrame:
    """(doc_id, ids, decoded) of every whole text; ids as little-endian unsigned 32-bit integers.

    Nothing is shuffled; a task works through its rows in blocks of about `batch_chars`
    characters, so memory is bounded by the block and the piece cache. The string of a special
    token in a text becomes its id, as the tokenizers library has it. A very long text is a block of
    its own, and one long word in it is merged by a heap, in n log n steps. Null and empty texts give
    no ids and an empty string; null ids, ties and repeated rows pass through row by row; an empty
    table gives no rows; other columns are not carried.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(tokenizer)

        def done(ids: list, texts: list) -> pa.RecordBatch:
            coded = c.encode_batch(texts)
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(coded, pa.binary()), pa.array([c.decode(x) for x in coded], pa.string())],
                names=["doc_id", "ids", "decoded"],
            )

        for rows in batches:
            ids, texts, size = [], [], 0
            for i, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                ids.append(i)
                texts.append(text)
                size += len(text)
                if size >= batch_chars:
                    yield done(ids, texts)
                    ids, texts, size = [], [], 0
            if ids:
                yield done(ids, texts)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(work, CODED)
