"""Quality rules of documents, judged also by host with shrunken failure rates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxframe.llm.common import WORD_SEPARATORS, settle, text_of, without

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
#: Percentages above which a document fails a rule.
MAX_REPEAT, MAX_SYMBOLS, MAX_DUP_LINES = 30, 10, 30
MAX_HOST_RATE = 0.5
SALTS = 16


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` with `value` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(words: Column) -> Column:
    """How many words lie in windows of eight words that stand twice or more in the text."""

    def covered(places: Column) -> Column:
        steps = F.transform(places, lambda x, i: F.when(i == 0, WINDOW).otherwise(F.least(F.lit(WINDOW), x - F.get(places, i - 1))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def twice(order: Column) -> Column:
        same = lambda x, i: F.coalesce(F.get(order, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(order, i + 1)["h"] == x["h"], F.lit(False))
        return let(F.array_sort(F.transform(F.filter(order, same), lambda x: x["i"])), covered)

    def counted(windows: Column) -> Column:
        order = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(windows)) < F.size(windows), let(order, twice)).otherwise(0)

    def of(words: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
        return F.when(F.size(words) > WINDOW, let(windows, counted)).otherwise(0)

    return let(words, of)


def rule_counts(docs: DataFrame, *, text_col: str = "text", host_col: str = "source", id_col: str = "doc_id") -> DataFrame:
    text = text_of(text_col)
    words = F.filter(F.split(text, WORD_SEPARATORS), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    line_counts = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    word_counts = let(words, lambda w: F.struct(F.size(w).alias("n"), repeated_words(w).alias("repeat")))
    got = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(host_col).alias("host"),
        word_counts.alias("w"),
        line_counts.alias("l"),
        F.length(F.translate(text, BLANKS, "")).alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).alias("n_symbols"),
    )
    got = got.select(
        "doc_id",
        "host",
        F.col("w.n").cast("long").alias("n_words"),
        F.col("word_chars").cast("long"),
        F.col("n_symbols").cast("long"),
        F.col("l.dup").cast("long").alias("n_dup_lines"),
        F.col("w.repeat").cast("long").alias("n_repeat_words"),
        F.col("l.n").cast("long").alias("n_lines"),
    )
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    more = (100 * F.col("n_symbols") > MAX_SYMBOLS * F.col("word_chars")) | (100 * F.col("n_dup_lines") > MAX_DUP_LINES * F.col("n_lines"))
    return got.withColumn("base_failed", base).withColumn("failed", base | more)


def host_verdicts(counts: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """(host, n, n_failed, rate, host_failed): failure rates shrunk by a beta prior.

    The prior's mean and strength come from the hosts' own rates by moments: the spread of the
    rates less what sampling alone would give. One row of sums holds the prior.
    """
    hosts = settle(counts.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("failed").cast("long")).alias("n_failed")))
    own = F.col("n_failed") / F.col("n")
    k, n, bad, s1, s2, inverse = hosts.agg(
        F.count("*"), F.sum("n"), F.sum("n_failed"), F.sum(own), F.sum(own * own), F.sum(1 / F.col("n"))
    ).first()
    mean = (bad + 1) / (n + 2) if k else 0.5
    spread = (s2 / k - (s1 / k) ** 2 if k else 0.0) - mean * (1 - mean) * (inverse or 0.0) / max(k, 1)
    strength = min(max(mean * (1 - mean) / spread - 1, 1.0), 1000.0) if spread > 0 else 1000.0
    rate = (F.col("n_failed") + mean * strength) / (F.col("n") + strength)
    return hosts.withColumn("rate", rate).withColumn("host_failed", F.col("rate") > max_rate)


def judge_by_host(docs: DataFrame, *, text_col: str = "text", host_col: str = "source", id_col: str = "doc_id") -> DataFrame:
    """One row per document: its counts, `base_failed`, the host's `rate`, and `kept`.

    A document is kept if it passes the base rules and its host's shrunken rate of failing
    documents is at most `MAX_HOST_RATE`. Host counts are combined before the shuffle; verdicts
    are joined back on (host, salt), each host's row being repeated for the salts, so a host
    with a third of all rows is dealt over many tasks.

    Null and empty texts have no words and fail; a very long text is one row of its task. A null host is a host of its own. Repeated rows
    and ties are judged row by row; an empty table gives no rows; other columns are not carried.
    """
    counts = settle(rule_counts(docs, text_col=text_col, host_col=host_col, id_col=id_col))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    hosts = host_verdicts(counts).select(F.col("host").alias("of_host"), "rate", "host_failed", salts)
    salted = counts.withColumn("salt_of", F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(SALTS)).cast("int"))
    judged = salted.join(hosts, F.col("host").eqNullSafe(F.col("of_host")) & (F.col("salt_of") == F.col("salt")))
    return without(judged, "salt", "salt_of", "of_host").withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed"))


#: Fixed to the same rules and the same moments as `judge_by_host`.
ORACLE = """
with d as (select row_number() over () rid, doc_id, source, coalesce(text, '') t from documents),
w as (select rid, list_filter(string_split_regex(t, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') ws,
        list_filter(string_split(t, chr(10)), lambda x: length(regexp_replace(x, '[ \\t\\n\\x0B\\f\\r]', '', 'g')) > 0) ls from d),
p as (select rid, i, array_to_string(ws[i:i+7], chr(1)) k from (select rid, ws, unnest(range(1, len(ws) - 6)) i from w where len(ws) >= 8)),
r as (select rid, i from (select rid, i, count(*) over (partition by rid, k) c from p) where c > 1),
s as (select rid, sum(least(8, coalesce(i - before, 8)))::bigint n from (select rid, i, lag(i) over (partition by rid order by i) before from r) group by rid),
c as (select d.doc_id, d.source, len(ws)::bigint n_words, length(regexp_replace(t, '[ \\t\\n\\x0B\\f\\r]', '', 'g'))::bigint word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint n_symbols, (len(ls) - len(list_distinct(ls)))::bigint n_dup_lines,
        coalesce(s.n, 0)::bigint n_repeat_words, len(ls)::bigint n_lines from d join w using (rid) left join s using (rid)),
b as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words base_failed from c),
f as (select *, base_failed or 100 * n_symbols > 10 * word_chars or 100 * n_dup_lines > 30 * n_lines failed from b),
h as (select source, count(*)::double n, sum(failed::int)::double bad from f group by source),
m as (select (sum(bad) + 1) / (sum(n) + 2) mean, avg((bad / n) * (bad / n)) - avg(bad / n) * avg(bad / n) v, avg(1 / n) inv from h),
q as (select mean, case when v - mean * (1 - mean) * inv > 0 then least(greatest(mean * (1 - mean) / (v - mean * (1 - mean) * inv) - 1, 1.0), 1000.0) else 1000.0 end k from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and (h.bad + q.mean * q.k) / (h.n + q.k) <= 0.5 kept
from f join h on f.source is not distinct from h.source cross join q
"""
