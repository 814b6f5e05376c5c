"""Merkle manifest of a dataset: every few levels are stored, the others are made again for proofs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxframe.llm.common import settle
from boxframe.operators.ranks import ranked

#: Children of a node, and levels from one stored level to the next.
ARITY, STRIDE = 16, 2
#: Nodes of a stored level below one node of the next: an aligned subtree.
SPAN = ARITY**STRIDE

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def leaf_digest(id_col: str, source_col: str, lang_col: str, chars_col: str, text: Column) -> Column:
    """The digest of a row: each value as its length in bytes, a colon and itself, or `-` if null."""
    values = [*[F.col(c).cast("string") for c in (id_col, source_col, lang_col, chars_col)], text]
    fields = [F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values]
    return digest(F.concat(*fields))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def level_above(nodes: Column) -> Column:
    """The digests of each `ARITY` nodes after another; the last run may be shorter."""
    runs = F.sequence(F.lit(0), F.ceil(F.size(nodes) / ARITY).cast("int") - 1)
    return F.transform(runs, lambda i: digest(F.array_join(F.slice(nodes, i * ARITY + 1, F.lit(ARITY)), "")))


def levels(nodes: Column, whole: Column, use: Callable[[list[Column]], Column]) -> Column:
    """`use` of the nodes' levels up to the top of their subtree, missing ones made again. The
    subtree that is a `whole` tree ends where one node is left; others have `STRIDE` levels."""

    def above(below: list[Column]) -> Column:
        if len(below) == STRIDE + 1:
            return use(below)
        last = below[-1]
        return let(F.when(whole & (F.size(last) == 1), last).otherwise(level_above(last)), lambda x: above([*below, x]))

    return let(nodes, lambda x: above([x]))


def path_from(below: list[Column], whole: Column, at: Column) -> Column:
    """The siblings before and after node `at` of the lowest level and its ancestors, level by
    level; where a whole tree has one node left, there is no level."""
    steps = []
    for level in below[:-1]:
        start, here = F.floor(at / ARITY).cast("int") * ARITY, at
        left = F.array_join(F.slice(level, start + 1, here - start), "")
        right = F.array_join(F.slice(level, here + 2, start + ARITY - 1 - here), "")
        steps.append(F.when(~(whole & (F.size(level) == 1)), F.struct(left.alias("before"), right.alias("after"))))
        at = F.floor(at / ARITY).cast("int")
    return F.filter(F.array(*steps), lambda s: s.isNotNull())


def whole() -> Column:
    return F.col("total") <= SPAN


def climb(leaves: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The stored levels of trees and (tree, node), their top nodes.

    leaves: (tree, idx, total, entry), where entry is a struct that begins with idx and node. A
    stored level has a row for each aligned subtree: (tree, block, total, entries).
    """
    stored, tops, live = [], None, leaves
    while True:
        entries = F.array_sort(F.collect_list("entry"), lambda a, b: (a["idx"] - b["idx"]).cast("int"))
        blocks = live.groupBy("tree", F.floor(F.col("idx") / SPAN).alias("block"), "total").agg(entries.alias("entries"))
        blocks = settle(blocks)
        stored.append(blocks)
        nodes = F.transform("entries", lambda e: e["node"])
        top = levels(nodes, whole(), lambda below: F.get(below[-1], F.lit(0)))
        up = blocks.select("tree", "block", "total", top.alias("node"))
        ended = up.where(whole()).select("tree", "node")
        tops = ended if tops is None else tops.unionByName(ended)
        up = up.where(~whole())
        if up.limit(1).count() == 0:
            return stored, tops
        live = up.select("tree", F.ceil(F.col("total") / SPAN).alias("total"), F.col("block").alias("idx"), F.struct(F.col("block").alias("idx"), "node").alias("entry"))


def descend(stored: list[DataFrame], above: DataFrame) -> DataFrame:
    """(tree, entry, path, ..) for each leaf of the stored trees: path are its siblings, level by
    level, and above, (tree, path, ..), is what follows over the trees' tops.

    Each level takes one join by subtree; the levels between are made again in the task that
    needs them, and only siblings leave it.
    """
    carried = [c for c in above.columns if c not in ("tree", "path")]
    paths = None
    for blocks in reversed(stored):
        own = blocks.where(whole()).join(above, "tree")
        if paths is not None:
            inner = blocks.where(~whole()).withColumnRenamed("block", "idx").join(paths, ["tree", "idx"])
            own = own.unionByName(inner.withColumnRenamed("idx", "block").select(*own.columns))
        nodes = F.transform("entries", lambda e: e["node"])
        each = levels(
            nodes,
            whole(),
            lambda below: F.transform(F.col("entries"), lambda e, i: F.struct(e.alias("entry"), path_from(below, whole(), i).alias("steps"))),
        )
        rows = own.select("tree", "block", "path", *carried, F.explode(each).alias("x"))
        rows = rows.select("tree", F.col("x.entry").alias("entry"), F.concat("x.steps", "path").alias("path"), *carried)
        paths = rows.select("tree", F.col("entry.idx").alias("idx"), "path", *carried)
    return rows


@dataclass
class Manifest:
    """The stored levels of each source's tree, those of the tree over them, and their tops."""

    levels: list[DataFrame]
    source_levels: list[DataFrame]
    subroots: DataFrame
    root: DataFrame


def build_manifest(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", lang_col: str = "lang", chars_col: str = "n_chars", text_col: str = "text", tampered: Column | None = None) -> Manifest:
    """Merkle trees of `docs`, one a source with the rows as leaves by id, and one over the sources.

    Leaves get their places from range partitions over (source, id), so one source may hold any
    share of all rows; a level's nodes meet in subtrees of `SPAN`. Every `STRIDE`-th level is
    stored, beginning with the leaves. Null sources are a source of their own, the first; null ids
    come first in theirs; rows with one id follow by their digests. Texts stay in the first scan,
    so very long ones travel nowhere. An empty table has no trees. `tampered` is another text per row (or
    null) whose digest the leaf carries along for `proofs`.
    """
    same = lambda text: leaf_digest(id_col, source_col, lang_col, chars_col, text)
    other = F.lit(None).cast("string") if tampered is None else F.when(tampered.isNotNull(), same(tampered))
    rows = docs.select(F.col(source_col).cast("string").alias("source"), F.col(id_col).alias("id"), same(F.col(text_col)).alias("node"), other.alias("claim"))
    rows = ranked(rows, [F.col("source").asc_nulls_first(), F.col("id").asc_nulls_first(), F.col("node")], "place", part="part")

    # A source's pieces in the ranges; by these, rows of a large source meet their tree's number.
    pieces = settle(rows.groupBy("part", "source").agg(F.min("place").alias("low"), F.count("*").alias("n")))
    sources = pieces.groupBy("source").agg(F.min("low").alias("start"), F.sum("n").alias("total"))
    sources = settle(ranked(sources, [F.col("source").asc_nulls_first()], "tree"))
    known = sources.select(F.col("source").alias("name"), "tree", "start", "total")
    pieces = pieces.join(known, F.col("source").eqNullSafe(F.col("name"))).select(F.col("part").alias("piece"), "name", "tree", "start", "total")
    met = rows.join(pieces, (F.col("part") == F.col("piece")) & F.col("source").eqNullSafe(F.col("name")))
    idx = (F.col("place") - F.col("start")).alias("idx")
    stored, subroots = climb(met.select("tree", "total", idx, F.struct(idx, "node", "id", "claim").alias("entry")))

    subroots = settle(subroots)
    n_sources = sources.agg(F.count("*").alias("total"))  # one row
    tops = subroots.join(F.broadcast(n_sources)).select(F.lit(0).cast("long").alias("tree"), "total", F.col("tree").alias("idx"), F.struct(F.col("tree").alias("idx"), "node").alias("entry"))
    source_levels, root = climb(tops)
    return Manifest(stored, source_levels, subroots, root)


def proofs(manifest: Manifest, id_col: str = "doc_id") -> DataFrame:
    """(id, leaf, claim, subroot, root, path) for each row: path, an array of the siblings before
    and after each of the leaf's ancestors from the leaf to the root, proves that leaf is in root."""
    at_root = manifest.root.select("tree", F.col("node").alias("root"), F.expr("cast(array() as array<struct<before:string,after:string>>)").alias("path"))
    sources = descend(manifest.source_levels, at_root)
    above = settle(sources.select(F.col("entry.idx").alias("tree"), "path", F.col("entry.node").alias("subroot"), "root"))
    rows = descend(manifest.levels, above)
    return rows.select(F.col("entry.id").alias(id_col), F.col("entry.node").alias("leaf"), F.col("entry.claim").alias("claim"), "subroot", "root", "path")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda a, s: digest(F.concat(s["before"], a, s["after"])))


def audit(docs: DataFrame, every: int = 5) -> DataFrame:
    """Each row's proof, checked against a copy in which A-Z of some texts are in lower case: those
    of the ids whose CRC-32 `every` divides."""
    changed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0, F.translate("text", UPPER, LOWER))
    found = proofs(build_manifest(docs, tampered=changed))
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["before"], s["after"])), "")
    folded = fold(F.coalesce("claim", "leaf"), F.col("path"))
    out = found.select("doc_id", "leaf", "subroot", "root", digest(siblings).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


#: The CRC-32 of a text of ASCII characters, bit by bit.
CRC_SQL = """xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(string_split({}, ''), lambda c: ascii(c)::ubigint)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)::ubigint[]), lambda x, _: case when x & 1 = 1 then xor(x >> 1, 3988292384::ubigint) else x >> 1 end)), 4294967295::ubigint)"""


def oracle(leaf_levels: int = 7, source_levels: int = 4) -> str:
    """The same rows in SQL; trees may have 16^7 leaves and 16^4 sources."""
    field = "coalesce(strlen({0}::varchar)::varchar || ':' || ({0})::varchar, '-')".format
    leaf = lambda text: "sha256(" + " || ".join(map(field, ("doc_id", "source", "lang", "n_chars", text))) + ")"
    lower = f"translate(text, '{UPPER}', '{LOWER}')"

    def tree(name: str, n: int) -> list[str]:
        """{name}0 has (s, i, h); the levels above it, with what stands beside each node in its run."""
        tables = []
        for j in range(n):
            run = "over (partition by s, i // 16 order by i rows between {})".format
            pre, post = (f"string_agg(h, '') {run(r)}" for r in ("unbounded preceding and 1 preceding", "1 following and unbounded following"))
            tables.append(f"{name}b{j} as (select *, count(*) over (partition by s) > 1 many, coalesce({pre}, '') pre, coalesce({post}, '') post from {name}{j})")
            tables.append(f"{name}{j + 1} as (select s, i // 16 i, case when any_value(many) then sha256(string_agg(h, '' order by i)) else any_value(h) end h from {name}b{j} group by 1, 2)")
        return tables

    tables = [
        "src as (select source, row_number() over (order by source nulls first) - 1 s from (select distinct source from documents))",
        f"d as (select doc_id, source, {leaf('text')} leaf, case when {CRC_SQL.format('doc_id::varchar')} % 5 = 0 and text is not null then {leaf(lower)} end claim from documents)",
        "p as (select d.*, s, row_number() over (partition by s order by doc_id nulls first, leaf) - 1 i from d join src on d.source is not distinct from src.source)",
        "l0 as (select s, i, leaf h from p)",
        *tree("l", leaf_levels),
        f"t0 as (select 0 s, s i, h from l{leaf_levels})",
        *tree("t", source_levels),
    ]
    joins, steps = [f"join l{leaf_levels} sub on sub.s = p.s", f"join t{source_levels} top on true"], []
    for name, n, at in (("l", leaf_levels, "p.i"), ("t", source_levels, "p.s")):
        for j in range(n):
            a = f"{name}{j}_"
            joins.append(f"join {name}b{j} {a} on {a}.i = {at} // {16**j} and {a}.s = " + ("p.s" if name == "l" else "0"))
            steps.append(f"{{'m': {a}.many, 'a': {a}.pre, 'b': {a}.post}}")
    # Folding starts with the leaf as a struct of its own.
    start = "{'m': false, 'a': coalesce(claim, leaf), 'b': ''}"
    return f"""with {", ".join(tables)},
q as (select doc_id, leaf, claim, sub.h subroot, top.h root, list_filter([{", ".join(steps)}], lambda x: x.m) path from p {" ".join(joins)}),
r as (select doc_id, leaf, subroot, root, sha256(coalesce(list_aggregate(list_transform(path, lambda x: x.a || x.b), 'string_agg', ''), '')) proof_sha256,
  list_reduce(list_prepend({start}, path), lambda x, y: {{'m': false, 'a': sha256(y.a || x.a || y.b), 'b': ''}}).a folded_root from q)
select *, folded_root = root verified from r"""
