"""Exact dedup, the Merkle manifest and importance resampling against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from boxframe.llm import exact_dedup, merkle, resample

DOCS = "doc_id long, text string, lang string, source string, n_chars long, place int, digest string, `rank` string, Part int, hot int"
CLASH = (1, "x", "y", 2, 3)
ODD = [
    (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, " \n\t ", None, None, 4), (4, "Same  Text here", "en", "b", 1), (5, "Same\nText here", "en", "b", 1),
    (4, "Same  Text here", "en", "b", 1), (None, "Same Text here", "de", "", 9), (None, None, None, None, None), (6, "x" * 300_000 + " Y" * 300_000, "en", "a", 1),
    (7, "same text here", "en", "b", 1), (8, " ", "en", "é", 1), (9, "中文 Ünï c\u0085d Z", "zh", "中", 5), (10, " lead and trail ", "en", "b", 3),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, *CLASH) for r in ODD], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def target(spark):
    return spark.createDataFrame([(1, "the quick text here and there"), (2, None), (3, "")], "item_id long, text string")


def normal(text):
    return re.sub("[ \t\n\x0b\x0c\r]+", " ", text or "")


def exact_by_hand(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[normal(text)].append(i)
    out = Counter()
    for text, ids in groups.items():
        ids.sort(key=lambda i: (i is None, i))
        digest = hashlib.sha256(text.encode()).hexdigest()
        out.update((i, ids[0], len(ids), n == 0, digest) for n, i in enumerate(ids))
    return out


def test_exact_duplicates(odd, none):
    got = Counter(tuple(r) for r in exact_dedup.exact_duplicates(odd).collect())
    assert got == exact_by_hand([r[:2] for r in ODD])
    assert exact_dedup.exact_duplicates(none).count() == 0


def test_exact_duplicates_of_hot_texts(spark):
    """A text in a third of the rows is dealt over parts, which meet again."""
    rows = [(i, "hot text" if i % 3 == 0 else f"text {i % 997}") for i in range(6000)] + [(None, "hot  text")] * 3 + [(0, "hot\ttext")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    found = exact_dedup.hot_texts(docs, "text", 4).collect()
    assert [r.digest for r in found] == [hashlib.sha256(b"hot text").hexdigest()] and found[0].parts > 2
    assert Counter(tuple(r) for r in exact_dedup.exact_duplicates(docs).collect()) == exact_by_hand(rows)


def test_exact_duplicates_shuffles_texts_once(spark, odd, capsys):
    dealt = odd.select("doc_id", "text", F.sha2("text", 256).alias("digest")).repartitionByRange(4, "digest")
    from pyspark.sql import Window

    dealt.withColumn("n", F.lag("text").over(Window.partitionBy("digest").orderBy("text"))).explain()
    assert capsys.readouterr().out.count("Exchange ") == 1


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(i, text, lang, source, n_chars):
    values = [i, source, lang, n_chars, text]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def merkle_by_hand(rows):
    """(id, leaf, subroot, root, proof, folded root, verified), by the definition."""
    trees = defaultdict(list)
    for r in rows:
        i, text = r[:2]
        lower = None if text is None else re.sub("[A-Z]", lambda m: m[0].lower(), text)
        changed = i is not None and text is not None and zlib.crc32(str(i).encode()) % 5 == 0
        trees[r[3]].append((i, leaf_of(*r), leaf_of(i, lower, *r[2:]) if changed else None))

    def climb(nodes, paths):
        at = list(range(len(nodes)))
        while len(nodes) > 1:
            for k in range(len(paths)):
                run = at[k] // 16 * 16
                paths[k].append((nodes[run : at[k]], nodes[at[k] + 1 : run + 16]))
                at[k] //= 16
            nodes = [sha("".join(nodes[j : j + 16])) for j in range(0, len(nodes), 16)]
        return nodes[0]

    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    paths, subroots = {}, []
    for s in names:
        trees[s].sort(key=lambda x: (x[0] is not None, x[0], x[1]))
        paths[s] = [[] for _ in trees[s]]
        subroots.append(climb([x[1] for x in trees[s]], paths[s]))
    above = [[] for _ in names]
    root = climb(subroots, above)
    out = Counter()
    for s, sub, up in zip(names, subroots, above):
        for (i, leaf, claim), path in zip(trees[s], paths[s]):
            now = claim or leaf
            for before, after in path + up:
                now = sha("".join(before) + now + "".join(after))
            out[i, leaf, sub, root, sha("".join("".join(b + a) for b, a in path + up)), now, now == root] += 1
    return out


def test_merkle(spark, odd, none):
    assert Counter(tuple(r) for r in merkle.audit(odd).collect()) == merkle_by_hand(ODD)
    assert merkle.audit(none).count() == 0


@pytest.mark.parametrize("sizes", [[1], [1, 1], [16, 17, 1, 2], [256, 257, 300, 15], [1] * 18 + [4100]])
def test_merkle_at_the_edges_of_levels(spark, sizes):
    rows = [(s * 10_000 + i, f"Text {i}", "en", None if s == 0 else f"host{s}", i) for s, n in enumerate(sizes) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    assert Counter(tuple(r) for r in merkle.audit(docs).collect()) == merkle_by_hand(rows)


def test_merkle_stores_every_second_level(spark):
    rows = [(i, "t", "en", "s", i) for i in range(700)]
    manifest = merkle.build_manifest(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    # 700 leaves in three subtrees, whose three tops are one subtree.
    assert [b.count() for b in manifest.levels] == [3, 1] and manifest.subroots.count() == 1


def words_of(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)


def resample_by_hand(rows, target, least, percent):
    def features(text):
        w = words_of(text)
        return [zlib.crc32(f.encode()) % 10_000 for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]

    source, aim = Counter(), Counter()
    for _, text in rows:
        source.update(features(text))
    for text in target:
        aim.update(features(text))
    s_all, t_all = source.total(), aim.total()
    gain = lambda b: math.floor(1000 * math.log((aim[b] + 1.0) * (s_all + 10000.0) / ((source[b] + 1.0) * (t_all + 10000.0))))
    out = []
    for i, text in rows:
        f = features(text)
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(sha(f"7:{'' if i is None else i}")[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words_of(text))])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0]))
    for n, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = n + 1
    return Counter(tuple(r[:5]) for r in out)


def test_resample(spark, odd, none, target):
    got = Counter(tuple(r) for r in resample.resample(odd, target, least_words=2, percent=60).collect())
    assert got == resample_by_hand([r[:2] for r in ODD], ["the quick text here and there", None, ""], 2, 60)
    assert resample.resample(none, target).count() == 0
    empty = Counter(tuple(r) for r in resample.resample(odd, target.where("false"), least_words=2, percent=60).collect())
    assert empty == resample_by_hand([r[:2] for r in ODD], [], 2, 60)


def test_head_and_tail_give_the_same_buckets(monkeypatch):
    """Frequent words and pairs come from the head, others directly; parts of long texts join."""
    rng = np.random.default_rng(3)
    names = [f"w{i}" for i in range(300)] + ["Ärger", "é" * 40, "z" * 100]
    text = " ".join(names[i] for i in (rng.pareto(1.0, 5000) * 3).astype(int) % len(names))
    w = words_of(text)
    want = Counter(zlib.crc32(f.encode()) % 10_000 for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])])
    pairs = [(a.encode(), b.encode()) for (a, b), n in Counter(zip(w, w[1:])).items() if n > 3]
    heads = [resample.Head.of([], []), resample.Head.of([x.encode() for x in names[:40]], pairs), resample.Head.of(sorted({x.encode() for x in w}), pairs)]
    for size in (1 << 20, 100):
        monkeypatch.setattr(resample, "PART_BYTES", size)
        for head in heads:
            n, buckets = head.buckets(text.encode())
            assert n == len(w) and Counter(buckets.tolist()) == want


def test_learned_head_holds_the_frequent(spark, monkeypatch):
    texts = spark.createDataFrame([(" ".join(["the cat"] * 30 + [f"rare{i}" for i in range(20)]),)] * 40, "text string").select(F.col("text").cast("binary"))
    head = resample.learn_head(texts)
    assert {b"the", b"cat"} <= set(head.number) and len(head.pairs) >= 2
