"""Dual-tree search, Merkle manifest and ring sharding against plain loops, and on awkward rows."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.llm import dualtree, manifest, ring

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, cell int, arc int, at long, key string, node string, pos long, q long, rank int, _part string, segments string"
EXTRA = (None, None, 1, 2, 3, "k", "n", 4, 5, 6, "p", "s")


def table(spark, rows):
    return spark.createDataFrame([(i, text, lang, source, n, *EXTRA[2:]) for i, text, lang, source, n in rows], COLUMNS)


@pytest.fixture(scope="module")
def rows():
    base = "The quick Brown fox jumps over the lazy dog near the river bank "
    out = [
        (1, base * 3 + "one", "en", "a", 5), (2, base + "two", "en", "b", None), (2, base + "two", "en", "b", None), (3, None, "en", None, 0), (4, "", None, None, None),
        (5, " \n\t --- ", "fr", "a", 1), (6, " ".join(f"w{i % 977}x{i}" for i in range(30_000)), "en", None, 9), (None, base + "three", "en", "a", 1), (None, None, None, None, None),
        (8, "ßÄ é 漢字 \U0001F600 " * 60, "de", "c", 2), (9, "</s>\\ \x00 <|im_start|>", "en", "ä", 2), (3, "same id, other text", "en", "a", 1), (7, "x" * 300_000, "de", "", 2),
    ]
    return out + [(100 + i, f"Fox number {i % 13} near the Bank {'river ' * (i % 5)}", "en", "hot", i) for i in range(300)] + [(77, "many equal ROWS", "en", "hot", 1)] * 700


# ranked lexical search


def plain_search(docs, items, k=10):
    split = lambda s: TERM.findall((s or "").translate(LOWER))
    counted = [(i, Counter(split(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in counted]
    held, total, df = sum(n > 0 for n in sizes), sum(sizes), Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        asked, scores = Counter(split(text)), []
        for (doc, c), n in zip(counted, sizes):
            m = 100 - 75 + (75 * n * held) // total if total else 0
            score = sum(r * math.floor(1000 * math.log((2 * held + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t, r in asked.items() if c[t])
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scores)[:k], 1)]
    return out


ITEMS = [(1, "quick quick fox FOX"), (2, None), (3, ""), (4, "unknownword"), (5, "漢字 é"), (6, "many equal rows"), (6, "river bank"), (None, "lazy dog"), (7, "w5x5 w6x6 fox 12"), (8, "near the bank number 4 river river")]


def test_search_equals_plain_search_on_awkward_rows(spark, rows):
    items = spark.createDataFrame([(i, t, 1, 2) for i, t in ITEMS], "item_id long, text string, rank int, score int")
    got = sorted(map(repr, map(tuple, dualtree.search(table(spark, rows), items).collect())))
    assert got == sorted(map(repr, plain_search([(r[0], r[1]) for r in rows], ITEMS)))


def test_search_in_several_blocks_and_batches(spark, rows, monkeypatch):
    monkeypatch.setattr(dualtree, "ITEMS", 2)
    monkeypatch.setattr(dualtree, "CELLS", 300)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = sorted(map(repr, map(tuple, dualtree.search(table(spark, rows), items, k=3).collect())))
    assert got == sorted(map(repr, plain_search([(r[0], r[1]) for r in rows], ITEMS, 3)))


def test_search_of_nothing(spark, rows):
    none, items = table(spark, []), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert dualtree.search(none, items).count() == 0
    assert dualtree.search(table(spark, rows), items.where("false")).count() == 0


def test_dual_tree_prunes_and_stays_exact():
    rng = np.random.default_rng(5)
    topics = np.repeat(np.arange(8), 96)  # documents and items of eight topics with their own coordinates
    docs = np.where(rng.random((768, 80)) < 0.3, rng.integers(1, 1000, (768, 80)), 0) * (np.arange(80) // 10 == topics[:, None]).astype(float)
    asked = np.where(rng.random((32, 80)) < 0.5, rng.integers(1, 50, (32, 80)), 0) * (np.arange(80) // 10 == np.arange(32)[:, None] % 8).astype(float)
    items, tree = dualtree.Tree(asked, leaf=4), dualtree.Tree(docs)
    best = dualtree.Best(np.ones(32, dtype=np.int64), 5)
    scored = dualtree.search_batch(items, tree, np.arange(768), np.zeros(768, dtype=bool), best)
    assert 0 < scored < 32 * 768 / 3
    for at, q in enumerate(items.order):
        s = docs @ asked[q]
        want = sorted((-int(v), i) for i, v in enumerate(s) if v > 0)[:5]
        assert [(-int(a), int(b)) for a, b in zip(best.rows[at][0], best.rows[at][2])] == want


def test_node_maxima_bound_every_row_below():
    m = np.random.default_rng(1).integers(0, 9, (203, 11)).astype(float)
    tree = dualtree.Tree(m)
    assert sorted(tree.order) == list(range(203)) and len(tree.levels[-1]) == 1
    for a, b, node in zip(tree.starts, tree.ends, tree.levels[0]):
        assert (tree.rows[a:b].max(axis=0) == node).all()
    assert (tree.levels[-1][0] == m.max(axis=0)).all()


def test_whole_numbers_beyond_doubles(spark):
    """An item whose score does not fit a double goes by 64-bit integers."""
    docs = spark.createDataFrame([(i, "a b c" if i % 2 else "b c d e") for i in range(9)], "doc_id long, text string")
    text = "a " * 2_000_000 + "b b c"
    items = [(1, text)]
    got = sorted(map(tuple, dualtree.search(docs, spark.createDataFrame(items, "item_id long, text string")).collect()))
    assert got == plain_search([(i, "a b c" if i % 2 else "b c d e") for i in range(9)], items)


# Merkle manifest


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H("".join(levels[-1][i:i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def plain_witness(levels, at):
    out = []
    for nodes in levels[:-1]:
        first = at // 16 * 16
        out.append((at - first, "".join(n for i, n in enumerate(nodes[first:first + 16]) if i != at - first)))
        at //= 16
    return out


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 256, 257, 300, 4096, 4097, 5000])
def test_manifest_of_any_size_equals_plain_tree(spark, n):
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit(None).cast("string").alias("lang"), F.lit(1).alias("n_chars"), F.col("id").cast("string").alias("text"))
    levels = plain_tree([plain_leaf((i, "s", None, 1, i)) for i in range(n)])
    got = manifest.witnesses(docs).select("doc_id", "leaf", "root", "subroot", "witness", manifest.fold(F.col("leaf"), F.col("witness")).alias("again")).collect()
    assert len(got) == n
    for r in got:
        assert (r["leaf"], r["subroot"], r["root"], r["again"]) == (levels[0][r["doc_id"]], levels[-1][0], levels[-1][0], levels[-1][0])
        assert [tuple(w) for w in r["witness"]] == plain_witness(levels, r["doc_id"])


def test_manifest_of_awkward_rows(spark, rows):
    got = manifest.witnesses(table(spark, rows)).select("doc_id", "leaf", "subroot", "root", "witness").collect()
    by = defaultdict(list)
    for i, text, lang, source, n in rows:
        by[source].append((i is not None, i or 0, plain_leaf((i, source, lang, n, text)), i))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in order}
    top = plain_tree([trees[s][-1][0] for s in order])
    want = [
        (x[3], x[2], trees[s][-1][0], top[-1][0], plain_witness(trees[s], at) + plain_witness(top, place))
        for place, s in enumerate(order) for at, x in enumerate(sorted(by[s], key=lambda x: x[:3]))
    ]
    assert sorted(repr((r["doc_id"], r["leaf"], r["subroot"], r["root"], [tuple(w) for w in r["witness"]])) for r in got) == sorted(map(repr, want))


def test_manifest_of_nothing_and_of_one_changed_byte(spark, rows):
    assert manifest.witnesses(table(spark, [])).count() == 0
    docs = table(spark, rows[:9])
    small = F.translate("text", "T", "t")
    found = manifest.witnesses(docs, carry={"altered": manifest.leaf_digest([*[F.col(c) for c in manifest.FIELDS[:-1]], small])})
    for r in found.select("*", (manifest.fold(F.col("altered"), F.col("witness")) == F.col("root")).alias("holds")).collect():
        assert r["holds"] == (r["altered"] == r["leaf"])


# sharding


def plain_ring(docs, x):
    nodes, rest, seats = x.nodes(), defaultdict(int), x.seats(len(docs))
    point = lambda i: int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:15], 16)
    keyed = sorted((point(i), i is not None, i or 0, zlib.crc32((t or "").encode()), len((t or "").encode()) + 1, i) for i, t in docs)
    out = []
    for p, _, _, crc, size, i in keyed:
        first = next((n for n, (at, _) in enumerate(nodes) if at >= p), 0)
        step = 0
        while rest[shard := nodes[(first + step) % len(nodes)][1]] == seats[shard]:
            step += 1
        out.append((i, size, crc, nodes[first][1], shard, rest[shard]))
        rest[shard] += 1
    return out


@pytest.mark.parametrize("x", [ring.Ring(), ring.Ring(shards=5, replicas=3), ring.Ring(shards=4, replicas=8, slack=0.25), ring.Ring(shards=1, replicas=1)])
def test_ring_equals_one_by_one_insertion(spark, rows, x):
    got = sorted(map(repr, map(tuple, ring.assign(table(spark, rows), x).collect())))
    assert got == sorted(map(repr, plain_ring([(r[0], r[1]) for r in rows], x)))


def test_ring_is_balanced_and_moves_little(spark):
    ids = spark.range(20_000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    one = {r["doc_id"]: r for r in ring.assign(ids).collect()}
    counts = Counter(r["shard"] for r in one.values())
    assert max(counts.values()) - min(counts.values()) <= 1
    assert sum(r["shard"] != r["home_shard"] for r in one.values()) < 0.15 * 20_000
    more = {r["doc_id"]: r["shard"] for r in ring.assign(spark.range(20_200).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))).collect()}
    assert sum(more[i] != r["shard"] for i, r in one.items()) < 0.05 * 20_000
    grown = {r["doc_id"]: r["shard"] for r in ring.assign(ids, ring.Ring(shards=17)).collect()}
    assert sum(grown[i] != r["shard"] for i, r in one.items()) < 0.3 * 20_000  # a plain modulus would move 94 %


def test_ring_of_nothing(spark):
    assert ring.assign(table(spark, [])).count() == 0
