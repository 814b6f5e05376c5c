"""Secret scans with multipart credential linking, by DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxframe.llm.common import settle, text_of
from boxframe.operators.folds import let, running

#: (kind, pattern of two groups, least characters of the second group, weak?). A match counts
#: if its second group is long enough; matches are the leftmost that do not overlap, per kind.
#: Case is spelt out so that all regex engines read the patterns alike. A url is no candidate: it
#: only says which characters belong to an address.
ASSIGN = (
    "((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    "[\"']?\\x20*[:=]\\x20*[\"']?)([A-Za-z0-9+/_.=-]+)"
)
KINDS = (
    ("assign", ASSIGN, 8, False),
    ("access", "()(AKIA[A-Z0-9]+)", 16, False),
    ("hex", "()([0-9a-f]{32,})", 32, False),
    ("login", "((?:[Ll]ogin|[Uu]ser(?:name)?|[Cc]lient_id|[Aa]ccount)[\"']?\\x20*[:=]\\x20*[\"']?)([A-Za-z0-9@._-]+)", 3, True),
    ("blob", "()([A-Za-z0-9/+]{24,})", 24, True),
    ("endpoint", "(https?://)([A-Za-z0-9.-]+)", 4, True),
    ("url", "(https?://)([^\\x20\\x09-\\x0D\"'<>]+)", 1, True),
)
IDENTIFIERS, SECRETS = ("access", "login"), ("assign", "hex", "blob")
SCOPE = 200
SPAN = "array<struct<start:int,kind:int,end:int>>"


#: What a text must contain for a kind to be looked for.
HINTS = {"access": "AKIA", "endpoint": "://", "url": "://"}


def matches(text: Column, kind: int) -> Column:
    """Spans of one kind in code points.

    `text` must be free of U+0001 and U+0003: they mark the matches and the border between the
    two groups, and the text between marks is then measured.
    """
    name, pattern, least, _ = KINDS[kind]
    none = F.expr(f"cast(array() as {SPAN})")
    parts = F.split(F.regexp_replace(text, pattern, "\x01$1\x03$2\x01"), "\x01")

    def step(at: Column, part: Column) -> Column:
        border = F.locate("\x03", part)
        after = at + F.length(part) - F.when(border > 0, 1).otherwise(0)
        good = (border > 0) & (F.length(part) - border >= least)
        span = F.struct(at.alias("start"), F.lit(kind).alias("kind"), after.alias("end"))
        return F.struct(after.alias("state"), F.when(good, span).alias("one"))

    found = let(parts, lambda p: F.when(F.size(p) > 1, F.filter(running(p, F.lit(0), SPAN[6:-1], step), lambda s: s.isNotNull())).otherwise(none))
    return F.when(F.contains(text, F.lit(HINTS[name])), found).otherwise(none) if name in HINTS else found


def spans_text(spans: Column) -> Column:
    names = F.array(*[F.lit(k[0]) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def link_parts(weak: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(doc_id, key, linked): of the candidates `found` of each document, the strong ones and the
    weak ones whose complementary parts start within `scope` code points.

    A login needs a secret part; a blob with digits needs an identifier, as an address alone is
    no credential; an endpoint needs both. A weak candidate that overlaps a strong one, and a blob
    that is part of an address, are dropped. This is an interval join of the parts of one
    document; ranges of a window give it without pairs.
    """
    each = weak.select("doc_id", "key", F.explode("found").alias("s")).select("doc_id", "key", "s.start", "s.kind", "s.end")
    is_kind = lambda *names: F.col("kind").isin([i for i, k in enumerate(KINDS) if k[0] in names])
    base = is_kind(*[k[0] for k in KINDS if not k[3]])
    doc = Window.partitionBy("doc_id", "key").orderBy("start")
    near = doc.rangeBetween(-scope, scope)
    seen = lambda what: F.coalesce(F.max(what.cast("int")).over(near), F.lit(0)) > 0
    strong_end = F.max(F.when(base, F.col("end"))).over(doc.rangeBetween(Window.unboundedPreceding, 0))
    strong_start = F.min(F.when(base, F.col("start"))).over(doc.rangeBetween(0, Window.unboundedFollowing))
    clear = F.coalesce(strong_end <= F.col("start"), F.lit(True)) & F.coalesce(strong_start >= F.col("end"), F.lit(True))
    url_end = F.max(F.when(is_kind("url"), F.col("end"))).over(doc.rangeBetween(Window.unboundedPreceding, 0))
    address = is_kind("blob") & F.coalesce(url_end > F.col("start"), F.lit(False))
    each = each.withColumn("clear", base | (clear & ~address & ~is_kind("url"))).where("clear")
    each = each.withColumns({"id_near": seen(is_kind(*IDENTIFIERS)), "secret_near": seen(is_kind(*SECRETS))})
    keep = (
        base
        | (is_kind("login") & F.col("secret_near"))
        | (is_kind("blob") & F.col("id_near"))
        | (is_kind("endpoint") & F.col("id_near") & F.col("secret_near"))
    )
    return each.where(keep).groupBy("doc_id", "key").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("linked"))


def scan_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE, carry: bool = False) -> DataFrame:
    """(doc_id, key, base, spans) per document, and with `carry` the input's `row`; spans are (start, kind, end) by start, then kind.

    `base` holds the strong matches, `spans` these and the linked weak ones; `key` is a hash of
    the text. Texts are read once and give narrow rows; only documents with weak candidates are
    shuffled, by document, so a hot source is no hot group.

    Null and empty texts have no spans; very long ones are folded in blocks. Repeated rows get equal results each. Ties at one start
    are ordered by kind. An empty table gives no rows; other columns are not carried.
    """
    clean = F.translate(text_of(text_col), "\x01\x03", "\x02\x02")
    row = [F.struct(*docs.columns).alias("row")] if carry else []
    also = ["row"] if carry else []
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("key"), clean.alias("clean"), *row)
    digits = lambda s: F.substring(F.col("clean"), s["start"] + 1, s["end"] - s["start"]).rlike("[0-9]")
    rows = rows.select("doc_id", "key", "clean", *also, *[matches(F.col("clean"), i).alias(k[0]) for i, k in enumerate(KINDS)])
    # Addresses matter only where a blob might be part of one.
    rows = rows.withColumn("url", F.when(F.size("blob") > 0, F.col("url")).otherwise(F.expr(f"cast(array() as {SPAN})")))
    rows = rows.withColumn("blob", F.when(F.size("blob") > 0, F.filter("blob", digits)).otherwise(F.col("blob")))
    strong = [k[0] for k in KINDS if not k[3]]
    rows = rows.select(
        "doc_id",
        "key",
        F.array_sort(F.concat(*strong)).alias("base"),
        F.array_sort(F.concat(*[k[0] for k in KINDS])).alias("found"),
        *also,
    )
    rows = settle(rows)
    plain = rows.where(F.size("found") == F.size("base")).select("doc_id", "key", "base", F.col("base").alias("spans"), *also)
    weak = rows.where(F.size("found") > F.size("base"))
    linked = link_parts(weak.select("doc_id", "key", "found").dropDuplicates(["doc_id", "key"]), scope).select(F.col("doc_id").alias("of_doc"), F.col("key").alias("of_key"), "linked")
    joined = weak.join(linked, F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("key") == F.col("of_key")), "left")
    return plain.unionByName(joined.select("doc_id", "key", "base", F.coalesce("linked", "base").alias("spans"), *also))


def oracle() -> str:
    """The same spans in DuckDB's SQL."""
    quoted = lambda p: p.replace("'", "''")
    parts = " union all ".join(
        f"select rid, {i} kind, {least} least, unnest(string_split(regexp_replace(t, '{quoted(p)}', chr(1) || '\\1' || chr(3) || '\\2' || chr(1), 'g'), chr(1))) part,"
        f" generate_subscripts(string_split(regexp_replace(t, '{quoted(p)}', chr(1) || '\\1' || chr(3) || '\\2' || chr(1), 'g'), chr(1)), 1) i from d"
        for i, (_, p, least, _) in enumerate(KINDS)
    )
    ids = lambda *names: ", ".join(str(i) for i, k in enumerate(KINDS) if k[0] in names)
    names = "[" + ", ".join(f"'{k[0]}'" for k in KINDS) + "]"
    listed = f"string_agg({names}[kind + 1] || ':' || \"start\" || ':' || \"end\", ',' order by \"start\", kind)"
    strong, near = ids(*[k[0] for k in KINDS if not k[3]]), f'partition by rid order by "start" range between {SCOPE} preceding and {SCOPE} following'
    return f"""
with d as (select row_number() over () rid, doc_id, translate(coalesce(text, ''), chr(1) || chr(3), chr(2) || chr(2)) t from documents),
p as ({parts}),
l as (select *, length(part) - contains(part, chr(3))::int n, contains(part, chr(3)) hit from p),
m as (select *, coalesce(sum(n) over (partition by rid, kind order by i rows between unbounded preceding and 1 preceding), 0)::bigint "start" from l),
f as (select m.rid, kind, "start", "start" + n "end" from m join d using (rid) where hit and length(part) - position(chr(3) in part) >= least
        and (kind <> {ids("blob")} or regexp_matches(substring(d.t, "start" + 1, n), '[0-9]'))),
o as (select *, kind in ({strong}) base,
        max(case when kind in ({strong}) then "end" end) over (partition by rid order by "start" range between unbounded preceding and current row) pe,
        min(case when kind in ({strong}) then "start" end) over (partition by rid order by "start" range between current row and unbounded following) ns,
        max(case when kind = {ids("url")} then "end" end) over (partition by rid order by "start" range between unbounded preceding and current row) ue from f),
c as (select * from o where base or (kind <> {ids("url")} and coalesce(pe <= "start", true) and coalesce(ns >= "end", true) and not (kind = {ids("blob")} and coalesce(ue > "start", false)))),
n as (select *, max((kind in ({ids(*IDENTIFIERS)}))::int) over ({near}) a, max((kind in ({ids(*SECRETS)}))::int) over ({near}) s from c),
k as (select * from n where base or (kind = {ids("login")} and s = 1) or (kind = {ids("blob")} and a = 1) or (kind = {ids("endpoint")} and a = 1 and s = 1)),
g as (select rid, count(*) filter (kind = 0) n_assign, count(*) filter (kind = 1) n_access, count(*) filter (kind = 2) n_hex,
        {listed} filter (base) b, {listed} al from k group by rid)
select doc_id, coalesce(n_assign, 0)::bigint n_assign, coalesce(n_access, 0)::bigint n_access, coalesce(n_hex, 0)::bigint n_hex,
  sha256(coalesce(b, '')) base_sha256, coalesce(al, '') spans from d left join g using (rid)
"""
