"""Embedding near-dedup by hierarchical navigable small-world graphs, one per shard."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxframe.llm.common import connected_components, settle

DEGREE = 16
#: A shard of this size takes some 300 MB in its task, most of it a bit for each pair.
SHARD_ROWS = 16384
BEAM = 48
#: An audit meets so many queries, and so many probes, with all nodes.
AUDIT_ROWS, AUDIT_RECALL = 128, 0.98


class Graph:
    """A layered graph over unit vectors; layer 0 holds all, each next about one in DEGREE."""

    def __init__(self, vectors: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]] | None = None):
        self.vectors = vectors
        self.kind = np.uint16 if len(vectors) <= 1 << 16 else np.int32  # results of a dense shard are large
        self.by_graph = self.by_product = 0  # queries met by each way
        self.layers = layers if layers is not None else self._build()  # (nodes, neighbours as node numbers, -1: none)

    def _build(self) -> list:
        n = len(self.vectors)
        level = np.floor(-np.log(1 - np.random.default_rng(11).random(n)) / math.log(DEGREE)).astype(int)
        layers: list = []
        for at in range(max(0, int(level.max(initial=0))), -1, -1):
            nodes = np.flatnonzero(level >= at)
            self.layers = layers
            layers = [*layers, (nodes, self._link(nodes, 2 * DEGREE if at == 0 else DEGREE))]
        return layers

    def _link(self, nodes: np.ndarray, degree: int) -> np.ndarray:
        """Insert the nodes of a layer in growing batches: each searches what stands already."""
        x, n = self.vectors, len(self.vectors)
        near = np.full((n, degree), -1, np.int32)
        done = min(len(nodes), 2 * degree)
        first = nodes[:done]
        sims = x[first] @ x[first].T
        np.fill_diagonal(sims, -2)
        self._connect(near, first, first[np.argsort(-sims, axis=1)[:, : max(0, done - 1)]], degree)
        while done < len(nodes):
            batch = nodes[done : done + min(512, max(16, done // 2))]
            found, _ = self._beam(x[batch], self._entries(x[batch], first), near, BEAM)
            sims = x[batch] @ x[batch].T
            np.fill_diagonal(sims, -2)
            k = min(degree, len(batch) - 1)
            mates = batch[np.argpartition(-sims, k - 1, axis=1)[:, :k]] if k > 0 else np.empty((len(batch), 0), np.int32)
            self._connect(near, batch, np.concatenate([found, mates], axis=1), degree)
            done += len(batch)
        return near

    def _connect(self, near: np.ndarray, nodes: np.ndarray, options: np.ndarray, degree: int) -> None:
        """Links both ways: forward by `_choose`; a node that others chose keeps its nearest."""
        for node, row in zip(nodes.tolist(), options):
            near[node] = self._choose(node, row[row >= 0], degree)
        a, b = np.repeat(nodes, degree), near[nodes].ravel()
        a, b = b[b >= 0].astype(np.int64), a[b >= 0].astype(np.int64)
        held = np.unique(a)
        old = near[held]
        a = np.concatenate([a, np.repeat(held, (old >= 0).sum(1))])
        b = np.concatenate([b, old[old >= 0].astype(np.int64)])
        a, b = np.divmod(np.unique(a * len(near) + b), len(near))
        sims = np.einsum("ij,ij->i", self.vectors[a], self.vectors[b])
        order = np.lexsort((-sims, a))
        a, b = a[order], b[order]
        begins = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
        rank = np.arange(len(a)) - np.repeat(begins, np.diff(np.append(begins, len(a))))
        near[held] = -1
        near[a[rank < degree], rank[rank < degree]] = b[rank < degree]

    def _choose(self, node: int, options: np.ndarray, degree: int) -> np.ndarray:
        out = np.full(degree, -1, np.int32)
        options = np.unique(options[options != node])
        if not len(options):
            return out
        sims = self.vectors[options] @ self.vectors[node]
        order = np.argsort(-sims, kind="stable")[: 2 * degree]
        options, sims = options[order], sims[order]
        among = self.vectors[options] @ self.vectors[options].T
        kept: list[int] = []
        for i in range(len(options)):
            if len(kept) == degree:
                break
            if not kept or sims[i] > among[i, kept].max():
                kept.append(i)
        rest = [i for i in range(len(options)) if i not in kept]
        kept = (kept + rest)[:degree]
        out[: len(kept)] = options[kept]
        return out

    def _entries(self, queries: np.ndarray, first: np.ndarray) -> np.ndarray:
        entry = np.full((len(queries), 1), first[0], np.int64)
        for _, near in self.layers:
            found, _ = self._beam(queries, entry, near, 4)
            entry = found[:, :1]
        return entry

    def _beam(self, queries: np.ndarray, entry: np.ndarray, near: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The `width` best nodes for each query, best first: all queries step at once, each
        opening its best node not yet opened, until none is left in its beam."""
        x, q = self.vectors, len(queries)
        seen = np.zeros((q, len(x)), bool)
        rows = np.arange(q)[:, None]
        ids = np.full((q, width), -1, np.int64)
        sims, opened = np.full((q, width), -2.0, np.float32), np.ones((q, width), bool)
        ids[:, : entry.shape[1]], opened[:, : entry.shape[1]] = entry, False
        sims[:, : entry.shape[1]] = np.einsum("qd,qkd->qk", queries, x[entry])
        seen[rows, entry] = True
        while True:
            live = np.flatnonzero(~opened.all(axis=1))
            if not len(live):
                return ids, sims
            best = np.argmax(np.where(opened[live], -3, sims[live]), axis=1)
            opened[live, best] = True
            next_ids = near[ids[live, best]].astype(np.int64)
            fresh = (next_ids >= 0) & ~seen[live[:, None], next_ids]
            seen[live[:, None], np.where(fresh, next_ids, ids[live, best][:, None])] = True
            got = np.where(fresh, np.einsum("qd,qkd->qk", queries[live], x[next_ids]), -2).astype(np.float32)
            all_sims = np.concatenate([sims[live], got], axis=1)
            order = np.argsort(-all_sims, axis=1, kind="stable")[:, :width]
            at = np.arange(len(live))[:, None]
            ids[live] = np.concatenate([ids[live], np.where(fresh, next_ids, -1)], axis=1)[at, order]
            opened[live] = np.concatenate([opened[live], ~fresh], axis=1)[at, order]
            sims[live] = all_sims[at, order]

    def probes(self, n: int, least: float, rng: np.random.Generator) -> np.ndarray:
        """Vectors that have a cosine just over `least` with a random node each: links at the edge."""
        near = self.vectors[rng.permutation(len(self.vectors))[:n]].astype(np.float64)
        away = rng.standard_normal(near.shape)
        away -= np.einsum("ij,ij->i", away, near)[:, None] * near
        away /= np.maximum(np.sqrt((away * away).sum(1, keepdims=True)), 1e-12)
        # In one dimension nothing is orthogonal, and the node is its own probe.
        cosine = least + 0.1 * (1 - least) if near.shape[1] > 1 else 1.0
        return (cosine * near + math.sqrt(1 - cosine * cosine) * away).astype(np.float32)

    def audited_width(self, queries: np.ndarray, least: float, rng: np.random.Generator) -> int:
        """The beam that finds enough of the links of `AUDIT_ROWS` queries and as many probes, over
        all links and on average over those that have any. Probes have a link each, so the audit
        has something to find however few links the queries have."""
        tried = np.concatenate([queries[rng.permutation(len(queries))[:AUDIT_ROWS]], self.probes(AUDIT_ROWS, least, rng)])
        truth = [np.flatnonzero(s >= least) for s in tried @ self.vectors.T]
        some = [i for i, t in enumerate(truth) if len(t)]
        width = min(BEAM, len(self.vectors))
        while some and width < len(self.vectors):
            found = self._search(tried[some], least, width, np.full(len(some), -1))
            hits = np.array([np.isin(truth[i], f).sum() for i, f in zip(some, found)])
            sizes = np.array([len(truth[i]) for i in some])
            if min(hits.sum() / sizes.sum(), (hits / sizes).mean()) >= AUDIT_RECALL:
                break
            width = min(2 * width, len(self.vectors))
        return width

    def near_enough(self, queries: np.ndarray, least: float, own: np.ndarray | None = None) -> list[np.ndarray]:
        """Nodes at `least` or more; `own` is each query's own node, -1 if it is not in this graph.

        All queries are searched with the audited beam. One whose beam holds nothing else, or lacks its
        own node, is searched again with a wider one; where that would meet as many nodes as the
        shard has (its width times the degree), the product with all is cheaper and exact.
        """
        own = np.full(len(queries), -1) if own is None else own
        width = self.audited_width(queries, least, np.random.default_rng(13))
        return self._search(queries, least, width, own)

    def _search(self, queries: np.ndarray, least: float, width: int, own: np.ndarray) -> list[np.ndarray]:
        nodes, near = self.layers[-1]
        out: list = [None] * len(queries)
        todo, first = np.arange(len(queries)), True
        while len(todo):
            again = []
            for i in range(0, len(todo), 256):
                part = todo[i : i + 256]
                if width >= len(self.vectors) or (not (first and width <= BEAM) and 2 * DEGREE * width > len(self.vectors)):
                    for j, s in zip(part, queries[part] @ self.vectors.T):
                        out[j] = np.flatnonzero(s >= least).astype(self.kind)
                    self.by_product += len(part)
                    continue
                self.by_graph += len(part)
                ids, sims = self._beam(queries[part], self._entry_of(queries[part]), near, width)
                for j, (a, s) in enumerate(zip(ids, sims)):
                    good = a[(s >= least) & (a >= 0)]
                    if width < len(self.vectors) and (len(good) >= width or (own[part[j]] >= 0 and own[part[j]] not in good)):
                        again.append(part[j])
                    out[part[j]] = good.astype(self.kind)
            todo, width, first = np.array(again, int), min(2 * width, len(self.vectors)), False
        return out

    def _entry_of(self, queries: np.ndarray) -> np.ndarray:
        entry = np.full((len(queries), 1), self.layers[0][0][0], np.int64)
        for _, near in self.layers[:-1]:
            entry = self._beam(queries, entry, near, 4)[0][:, :1]
        return entry

    def dump(self) -> bytes:
        import pickle

        return pickle.dumps(self.layers, protocol=5)


def unit(vectors: np.ndarray) -> np.ndarray:
    x = vectors.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Forest:
    """Components of numbered nodes under unions of many pairs at once; a root is its least number."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def unite(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.root[a], self.root[b]
            apart = x != y
            if not apart.any():
                return
            np.minimum.at(self.root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
            while not np.array_equal(self.root, up := self.root[self.root]):
                self.root = up


def links_between(keys: np.ndarray, ids: np.ndarray, n: np.ndarray, x: np.ndarray, layers: list, other: tuple | None, least: float) -> tuple[np.ndarray, ...]:
    """(key, node, low, others) of the linked nodes of one shard, or of it and an `other` (keys,
    ids, n, x): low is the smallest id that links of this call reach, others the number of vectors
    linked directly.

    Pairs found by the float search are verified in double precision, in slices, and leave as
    sums and components, so what is returned is no longer than the nodes.
    """
    ux = unit(x)
    q_ids, q_n, uq = (ids, n, ux) if other is None else (*other[1:3], unit(other[3]))
    found = Graph(ux.astype(np.float32), layers).near_enough(uq.astype(np.float32), least - 1e-4, np.arange(len(ids)) if other is None else None)
    every = ids if other is None else np.concatenate([ids, q_ids])
    order = np.argsort(every)  # numbers in the order of ids, so a root is the smallest id
    number = np.empty(len(every), int)
    number[order] = np.arange(len(every))
    forest, others, base = Forest(len(every)), np.zeros(len(every)), 0 if other is None else len(ids)
    met = np.zeros((len(ids), len(ids)), bool) if other is None else None
    sizes, low = np.cumsum([len(f) for f in found]), 0
    while low < len(found):
        high = max(low + 1, int(np.searchsorted(sizes, (sizes[low - 1] if low else 0) + 500_000)))
        a, b = np.repeat(np.arange(low, high), [len(f) for f in found[low:high]]), np.concatenate(found[low:high]).astype(int)
        good = np.einsum("ij,ij->i", uq[a], ux[b]) >= least
        a, b = a[good], b[good]
        if met is not None:
            a, b = a[a != b], b[a != b]
            met[a, b] = met[b, a] = True
        else:
            others += np.bincount(base + a, n[b], len(every)) + np.bincount(b, q_n[a], len(every))
        forest.unite(number[base + a], number[b])
        low = high
    if met is not None:
        others = np.concatenate([met[i : i + 512] @ n.astype(float) for i in range(0, len(ids), 512)])
    linked = np.flatnonzero(others)
    every_key = keys if other is None else np.concatenate([keys, other[0]])
    return every_key[linked], every[linked], every[order][forest.root[number[linked]]], others[linked].astype(np.int64)


def link_embeddings(
    vectors: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    least: float = 0.93,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per vector; links join vectors of one label
    with cosine `least` or more.

    Equal vectors of a label are one node with a count. Nodes are dealt into shards of about
    `shard_rows` by label and hash; each shard's graph is built in a task of its own and written.
    Then every two shards of a label meet once, in a task of their own: the one's nodes search the
    other's graph (so bytes and work grow with the square of a label's shards, as every shard is
    queried; larger shards are fewer). Beams widen until an audit finds 0.98 of the links of some
    queries and of probes made to have links. The float search takes a small margin; pairs are verified in double precision on
    scaled vectors, and only sums and one link per node leave the task. Spark unions components.

    Vectors that are null, zero, or hold nulls or non-finite numbers, and rows whose label is null,
    link with nothing. Vectors of different lengths do not link. Repeated ids and equal rows are
    counted as vectors of their own; rows of one id share a component. Ids are integers. An empty table gives no rows.
    """
    import pickle

    spark = vectors.sparkSession
    as_double = F.col(vector_col).cast("array<double>")
    sound = (
        F.col(label_col).isNotNull()
        & F.coalesce(F.forall(as_double, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
        & F.coalesce(F.exists(as_double, lambda v: v != 0), F.lit(False))
    )
    rows = settle(
        vectors.select(F.col(id_col).alias("vec_id"), F.when(sound, F.col(label_col)).alias("label"), F.when(sound, as_double).alias("v"))
        .withColumn("key", F.when(F.col("v").isNotNull(), F.xxhash64("label", "v")))
        .withColumn("key2", F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(1), "v", "label")))
    )
    nodes = rows.where("v is not null").groupBy("key", "key2").agg(F.min("vec_id").alias("node"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("v").alias("v"))
    nodes = settle(nodes.withColumn("dim", F.size("v")))
    sizes = nodes.groupBy("label", "dim").agg(F.greatest(F.ceil(F.count("*") / shard_rows), F.lit(1)).alias("shards"))
    dealt = nodes.join(sizes, ["label", "dim"]).withColumn("shard", F.pmod("key", "shards").cast("int"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per shard, with its graph; rows come sorted by shard."""
        held: list = []

        def done() -> pa.RecordBatch:
            label, dim, shard = held[0][:3]
            x = np.array([h[6] for h in held])
            graph = Graph(unit(x).astype(np.float32))
            blob = pickle.dumps((*(np.array([h[i] for h in held]) for i in (3, 4, 5)), x), protocol=5)
            return pa.RecordBatch.from_arrays(
                [pa.array([label], pa.string()), pa.array([dim], pa.int32()), pa.array([shard], pa.int32()), pa.array([blob], pa.binary()), pa.array([graph.dump()], pa.binary())],
                names=["label", "dim", "shard", "nodes", "graph"],
            )

        for rows in batches:
            for row in zip(*(c.to_pylist() for c in rows.columns)):
                if held and row[:3] != held[0][:3]:
                    yield done()
                    held = []
                held.append(row)
        if held:
            yield done()

    graphs = (
        dealt.select(F.col("label").cast("string"), "dim", "shard", "key", "node", "n", "v")
        .repartition("label", "dim", "shard")
        .sortWithinPartitions("label", "dim", "shard", "node", "key")
        .mapInArrow(pack, "label string, dim int, shard int, nodes binary, graph binary")
    )
    graphs = settle(graphs)

    def query(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for i in range(rows.num_rows):
                blobs = [rows.column(k)[i].as_py() for k in range(3)]
                mine, layers, other = (pickle.loads(b) if b is not None else None for b in blobs)
                columns = links_between(*mine, layers, other, least)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "node", "low", "others"])

    shards = graphs.select("label", "dim", "shard")
    meet = shards.withColumnRenamed("shard", "i").join(shards.withColumnRenamed("shard", "j"), ["label", "dim"]).where("i <= j")
    meet = meet.join(graphs.withColumnRenamed("shard", "i"), ["label", "dim", "i"])
    others = graphs.select("label", "dim", F.col("shard").alias("j"), F.col("nodes").alias("other"))
    meet = meet.join(others, ["label", "dim", "j"], "left").withColumn("other", F.when(F.col("i") < F.col("j"), F.col("other")))
    meet = meet.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "label", "dim", "i", "j").select("nodes", "graph", "other")
    found = settle(meet.mapInArrow(query, "key long, node long, low long, others long"))
    links = found.where("node <> low").select(F.col("low").alias("src"), F.col("node").alias("dst")).distinct()
    linked = found.groupBy("key").agg(F.sum("others").alias("others"))
    components = connected_components(links).select(F.col("id").alias("node"), "component")
    of_node = nodes.select("key", "key2", "node", "n").join(linked, "key", "left").join(components, "node", "left")
    joined = rows.select("vec_id", "key", "key2").join(of_node, ["key", "key2"], "left")
    component = F.coalesce("component", "node", "vec_id")
    return joined.select(
        "vec_id",
        F.when(F.col("node").isNull(), F.lit(0)).otherwise(F.col("n") - 1 + F.coalesce("others", F.lit(0))).cast("long").alias("n_links"),
        component.alias("component_id"),
        (F.col("vec_id") == component).alias("kept"),
    )
