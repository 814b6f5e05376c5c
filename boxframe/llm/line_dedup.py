"""Line deduplication by a deletion-neighbourhood join, by DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxframe.llm.common import WORD_SEPARATORS, partitions_for, settle, text_of, without

#: Shorter lines go only if an equal line stands earlier: one edit makes another line of them.
EDIT_CHARS = 20
#: At most so many lines (8 bytes and a place each) are broadcast.
BROADCAST_LINES = 100_000
#: A line that is more than one in HOT_SHARE lines is dealt over SPREAD parts; there are fewer
#: than HOT_SHARE such lines.
HOT_SHARE, SPREAD = 1000, 64
#: Parts of the second, finer test of lines that share a half.
FINE_PARTS = 16


def normal_line(lower: Column) -> Column:
    """A line in lower case with words one space apart; most lines hold single spaces only and
    need no pattern."""
    other = F.lit(False)
    for separator in ("  ", "\t", "\x0b", "\f", "\r"):
        other = other | F.contains(lower, F.lit(separator))
    return F.trim(F.when(other, F.regexp_replace(lower, WORD_SEPARATORS, " ")).otherwise(lower))


def part_keys(line: Column, parts: int) -> Column:
    """Keys of which two lines within one edit share at least one: a line less one of its parts.

    Of lines of m and m or m + 1 characters with one edit between them, the edit stands in one of
    the equal parts of m; what lies before it is equal, and so is what lies after it. A line takes
    part with m its own length and one less.
    """
    n = F.length(line)

    def of(m: Column, i: int) -> Column:
        start, end = (F.floor(m * j / parts).cast("int") for j in (i, i + 1))
        before, after = F.substring(line, F.lit(1), start), F.substring(line, n - (m - end) + 1, m - end)
        return F.xxhash64(F.lit(i), m, *([before] if i else []), *([after] if i < parts - 1 else []))

    return F.array(*[of(m, i) for m in (n, n - 1) for i in range(parts)])


def sharing(keyed: DataFrame) -> DataFrame:
    """The h of rows (h, key) that share a key with another h."""
    ends = [f(f"h.{c}").alias(f"{c}_{f.__name__}") for c in "ab" for f in (F.min, F.max)]
    shared = keyed.groupBy("key").agg(*ends).where("a_min <> a_max or b_min <> b_max").select("key")
    return keyed.join(shared, "key", "left_semi").select("h").distinct()


def deletion_variants(lines: DataFrame) -> DataFrame:
    """(h, first, v, p) of rows (h, first, line): hashes of the line less its p-th character, and
    of the line itself (p = 0).

    A line's hash comes from two sums of 40-bit numbers, one for each character at its place. A
    variant's sums are those of what lies before p, and of what lies behind, each character one
    place forward. Both are running sums over the line, so n variants take n steps, and a line
    may have some millions of characters. Lines are dealt to tasks before they become characters.
    """
    number = lambda c, at, kind: F.shiftrightunsigned(F.xxhash64(F.lit(kind), c, at), 24)

    def total(kind: int, forward: int) -> Column:
        return F.aggregate(F.transform("chars", lambda c, i: number(c, i + 1 - forward, kind)), F.lit(0).cast("long"), lambda a, x: a + x)

    rows = lines.repartition(partitions_for(lines.sparkSession), "h").select("h", "first", F.split("line", "").alias("chars"))
    # The length is its own column, so that exploded characters do not carry the whole line.
    rows = rows.select("h", "first", "chars", F.size("chars").alias("n"), *[total(k, 0).alias(f"whole{k}") for k in (0, 1)], *[total(k, 1).alias(f"rest{k}") for k in (0, 1)])
    whole = rows.select("h", "first", F.xxhash64("whole0", "whole1", "n").alias("v"), F.lit(0).alias("p"))
    each = rows.select("h", "first", "rest0", "rest1", "n", F.posexplode("chars").alias("i", "c")).withColumn("p", F.col("i") + 1)
    so_far = Window.partitionBy("h").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    sums = [
        F.sum(number(F.col("c"), F.col("p"), k) - number(F.col("c"), F.col("i"), k)).over(so_far) - number(F.col("c"), F.col("p"), k) + F.col(f"rest{k}")
        for k in (0, 1)
    ]
    return whole.union(each.select("h", "first", F.xxhash64(*sums, F.col("n") - 1).alias("v"), "p"))


def close_lines(lines: DataFrame, rows: DataFrame) -> DataFrame:
    """(h, first, line) of the lines that share a half with another, and then all but one of
    `FINE_PARTS` parts; the texts come from `rows`.

    Up to `BROADCAST_LINES` such lines go to the rows, so texts are not shuffled; more meet them
    by a shuffle.
    """
    keyed = lines.select("h", F.explode("keys").alias("key"))
    wanted = settle(sharing(keyed).join(lines.select("h", "first"), "h"))
    few = wanted.limit(BROADCAST_LINES + 1).count() <= BROADCAST_LINES
    texts = rows.select("doc", "pos", "h", "line").join(F.broadcast(wanted) if few else wanted, "h")
    here = F.col("doc").eqNullSafe(F.col("first.doc")) & (F.col("pos") == F.col("first.pos"))
    halves = settle(texts.where(here).select("h", "first", "line").dropDuplicates(["h"]))
    finer = halves.select("h", F.explode(part_keys(F.col("line"), FINE_PARTS)).alias("key"))
    return settle(halves.join(sharing(finer), "h"))


def near_lines(lines: DataFrame, rows: DataFrame) -> DataFrame:
    """(line, h, near): lines of which a line within one edit stands earlier, and that line.

    `lines` has one row per different line: h, its half keys, and its first place `first`; `rows`
    has all lines with their texts. Only lines
    that share all but one part with another line can be within one edit of it; these emit every variant
    with one deletion as a hashed key. Lines that delete to one variant at the same position
    differ in that character; a line that is itself a variant is one insertion away. So the
    earliest line of each (variant, position), and a variant's own line, stand for all partners.
    A group holds different lines that differ in one character, so none grows with the corpus.
    """
    close = close_lines(lines, rows)
    variants = deletion_variants(close)
    place = F.struct("first", "h", "p")
    by_variant = Window.partitionBy("v")
    linked = variants.withColumns(
        {
            "same": F.min(place).over(Window.partitionBy("v", "p")),
            "whole": F.min(F.when(F.col("p") == 0, place)).over(by_variant),
            "longer": F.min(F.when(F.col("p") > 0, place)).over(by_variant),
        }
    )
    partners = F.array("same", "whole", F.when(F.col("p") == 0, F.col("longer")))
    pairs = linked.select("first", "h", "p", F.explode(partners).alias("other"))
    pairs = pairs.where(F.struct("other.first", "other.h") < F.struct("first", "h"))
    pairs = pairs.groupBy("h", F.col("other.h").alias("of")).agg(F.min(F.struct("p", F.col("other.p").alias("of_p"))).alias("cut"))
    texts = close.select("h", "line", "first")
    pairs = pairs.join(texts, "h").join(texts.select(F.col("h").alias("of"), F.col("line").alias("of_line"), F.col("first").alias("of_first")), "of")

    def less(line: Column, p: Column) -> Column:
        return F.when(p == 0, line).otherwise(F.concat(F.substring(line, F.lit(1), p - 1), F.substring(line, p + 1, F.length(line))))

    # Equal after one character less on one side or, at the same place, on both: one edit at most.
    pairs = pairs.where(less(F.col("line"), F.col("cut.p")) == less(F.col("of_line"), F.col("cut.of_p")))
    return pairs.groupBy("h").agg(F.min("of_first").alias("near"))


def line_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    # Lines are made inside the array, so the condition on them does not make them again.
    lines = F.transform(F.split(F.lower(text_of(text_col)), "\n"), normal_line)
    rows = docs.select(F.col(id_col).alias("doc"), F.posexplode(lines).alias("pos", "line"))
    return rows.where("line <> ''")


def line_hash(line: Column) -> Column:
    """Two hashes, so that among 10^12 different lines no two are taken for equal."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"))


def spread_join(rows: DataFrame, again: DataFrame, lines: DataFrame) -> DataFrame:
    """`rows` (doc, pos, h) with the (h, first, n, near) of their line. Rows of a very common line
    are dealt over `SPREAD` parts, and its facts go to each of them."""
    total = lines.agg(F.sum("n")).first()[0] or 0
    common = F.col("n") * HOT_SHARE > total
    # Fewer than HOT_SHARE lines can each be more than one in HOT_SHARE.
    hot = F.broadcast(lines.where(common).select("h", F.lit(SPREAD).alias("parts")))
    dealt = F.coalesce(F.pmod(F.xxhash64("doc", "pos"), "parts").cast("int"), F.lit(0))
    rows = rows.join(hot, "h", "left").select("doc", "pos", "h", dealt.alias("part"))
    parts = F.when(common, F.sequence(F.lit(0), F.lit(SPREAD - 1))).otherwise(F.array(F.lit(0)))
    return rows.join(again.withColumn("part", F.explode(parts)), ["h", "part"])


def dropped_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", edit_chars: int = EDIT_CHARS) -> DataFrame:
    """(doc, dropped): the numbers of each document's lines that repeat an earlier line."""
    rows = line_rows(docs, id_col, text_col).select("doc", "pos", line_hash(F.col("line")).alias("h"), "line")
    keys = F.when(F.length("line") >= edit_chars, part_keys(F.col("line"), 2))
    narrow = settle(rows.select("doc", "pos", "h", keys.alias("keys")))
    # A line's keys are the same at every place, so the first place brings them along.
    first = narrow.groupBy("h").agg(F.min(F.struct("doc", "pos", "keys")).alias("m"), F.count("*").alias("n"))
    lines = settle(first.select("h", F.struct("m.doc", "m.pos").alias("first"), "n", "m.keys"))
    near = near_lines(lines, rows)
    again = lines.select("h", "first", "n").join(near, "h", "left").where("n > 1 or near is not null")
    seen = spread_join(narrow.select("doc", "pos", "h"), again, lines)
    mine = F.col("doc").eqNullSafe(F.col("first.doc")) & (F.col("pos") == F.col("first.pos"))
    gone = seen.where(F.col("near").isNotNull() | ~mine)
    return gone.groupBy("doc").agg(F.array_sort(F.collect_set("pos")).alias("dropped"))


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", edit_chars: int = EDIT_CHARS) -> DataFrame:
    """`docs` with the repeated lines taken out of the text, and `n_dropped`, their number.

    Lines (between line feeds) are compared in lower case with words one space apart. A line of any
    length goes if an equal line stands at an earlier place (document id, then line number), and
    one of at least `edit_chars` characters also if such a line within one character's edit does;
    the earliest stays. Lines without a character but white space stay.

    Equal lines are counted once before anything is joined (combined before the shuffle), so a
    line in a third of all documents is one row. Nulls: a null text stays null, a null id comes
    before all others. Rows with one id count as one document for order: their equal lines at
    one place stay in each. Empty texts and an empty table pass through; a very long line emits
    as many variants as it has characters, as hashes, in as many steps. Other columns are kept; one named
    `n_dropped` is replaced.
    """
    docs = without(docs, "n_dropped")
    dropped = dropped_lines(docs, id_col=id_col, text_col=text_col, edit_chars=edit_chars)
    joined = docs.join(dropped.hint("shuffle_hash"), docs[id_col].eqNullSafe(dropped["doc"]), "left")
    parts = F.split(F.col(text_col), "\n")
    others = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), "dropped")
    kept = F.array_join(F.transform(others, lambda i: F.get(parts, i)), "\n")
    new = F.when(F.col("dropped").isNull(), F.col(text_col)).otherwise(kept)
    return joined.select(*[new.alias(c) if c == text_col else docs[c] for c in docs.columns], F.when(F.col("dropped").isNull(), 0).otherwise(F.size("dropped")).cast("long").alias("n_dropped"))


ORACLE = """
with l as (select doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 pos,
        trim(regexp_replace(lower(unnest(string_split(coalesce(text, ''), chr(10)))), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' ') line, unnest(string_split(coalesce(text, ''), chr(10))) raw from documents),
c as (select * from l where line <> ''),
d as (select line, length(line) n, min({'d': doc_id, 'p': pos}) f from c group by line),
k as (select line, n, f, n m, substring(line, 1, n // 2) a, right(line, n - n // 2) b from d where n >= 20
      union all select line, n, f, n - 1 m, substring(line, 1, (n - 1) // 2) a, right(line, n - 1 - (n - 1) // 2) b from d where n >= 20),
p as (select x.line from k x join k y on x.m = y.m and x.a = y.a and y.f < x.f where levenshtein(x.line, y.line) = 1
      union select x.line from k x join k y on x.m = y.m and x.b = y.b and y.f < x.f where levenshtein(x.line, y.line) = 1),
g as (select c.doc_id, c.pos from c join d using (line) where line in (select line from p) or d.f <> {'d': c.doc_id, 'p': c.pos})
select t.doc_id, t.text_sha256, t.n_dropped from (
  select doc_id, sha256(coalesce(string_agg(raw, chr(10) order by pos) filter (not gone), '')) text_sha256, count(*) filter (gone)::bigint n_dropped
  from (select l.*, g.pos is not null gone from l left join g using (doc_id, pos)) group by doc_id) t
"""
