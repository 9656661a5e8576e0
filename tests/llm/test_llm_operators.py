"""Operators for training data against plain versions, and on awkward rows."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from waymark.llm import chat, language, licenses, mixing, packing, prefix, quality, simhash, suffixes, tokens, topk
from waymark.llm.common import cut, word_count
from waymark.llm.components import components
from waymark.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, n_words int, ref string, fp string, _size int, _mine int, _g_lang string, kept string, col int, pos int"


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls in every column, empty and very long texts, repeated rows and ids, names that clash."""
    base = "the quick brown fox jumps over the lazy dog near the river bank while rain falls on old stone walls today " * 4
    rows = [
        (1, base + "one", "en", "a"), (2, base + "two", "en", "b"), (2, base + "two", "en", "b"), (3, None, "en", "a"), (4, "", None, None),
        (5, " \n\t ", "fr", "a"), (6, LONG, "en", None), (7, "x" * 300_000, "de", "b"), (None, base + "three", "en", "a"), (None, None, None, None),
        (8, "ßÄ é 漢字 \U0001F600 " * 60, "de", "c"), (9, "</s>\\ \x00 <|im_start|>", "en", "c"), (3, "same id, other text", "en", "a"),
    ]
    return spark.createDataFrame([(*r, None, 1, "r", "f", 2, 3, "g", "k", 4, 5) for r in rows], COLUMNS)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)


def words(text):
    return WORD.findall(text or "")


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query_equals_sql(spark, key):
    con = duckdb.connect()
    for name in ("documents", "embeddings", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    cursor = con.execute(ORACLES[key])
    names = [d[0] for d in cursor.description]
    theirs = sorted(tuple(repr(v) for _, v in sorted(zip(names, row))) for row in cursor.fetchall())
    df = QUERIES[key](spark, SMALL)
    assert sorted(df.columns) == sorted(names)
    assert sorted(tuple(repr(r[c]) for c in sorted(names)) for r in df.collect()) == theirs


# 1 packing


def plain_best_fit(needs, sizes):
    free, held, caps, out, left = [], [], [], [], sum(needs)
    for need in needs:
        room = [(c - h, i) for i, (c, h) in enumerate(zip(caps, held)) if c - h >= need]
        if room:
            i = min(room)[1]
        else:
            i = len(caps)
            caps.append(min((c for c in sizes.lengths if c >= need), key=lambda c: (sizes.cost(c) / min(c, left), c)))
            held.append(0)
        out.append((i, held[i]))
        held[i] += need
        left -= need
    return out, [min((c for c in sizes.lengths if c >= h), key=lambda c: (sizes.cost(c), c)) for h in held]


def test_packing_equals_plain_best_fit():
    rng = np.random.default_rng(1)
    sizes = packing.Sizes((64, 128, 256), 16)
    for _ in range(20):
        needs = sorted(rng.integers(1, 257, 200).tolist(), reverse=True)
        bins, offsets, final = packing.best_fit(needs, sizes)
        assert (list(zip(bins, offsets)), final) == plain_best_fit(needs, sizes)


def test_packing_holds_every_piece_once(spark, awkward):
    sizes = packing.Sizes((16, 64, 256), 8, 1, 50)
    rows = packing.pack(awkward, word_count(F.coalesce("text", F.lit(""))), sizes).collect()
    texts = [(r["doc_id"], len(words(r["text"]))) for r in awkward.collect()]
    want = Counter((d, p, p * 255, min(255, n - p * 255)) for d, n in texts for p in range(max(1, math.ceil(n / 255))))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"]) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r["shard"], r["bin"]].append(r)
    for held in bins.values():
        held.sort(key=lambda r: r["slot"])
        ends = np.cumsum([r["length"] + 1 for r in held])
        assert [r["offset"] for r in held] == [0, *ends[:-1]]
        assert held[0]["bin_size"] == min(c for c in sizes.lengths if c >= ends[-1])


# 2 quality rules


def plain_counts(text):
    text = text or ""
    w = words(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    seen = Counter(zip(w, w[1:], w[2:]))
    covered = {i + d for i, t in enumerate(zip(w, w[1:], w[2:])) if seen[t] > 1 for d in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_equal_plain_counts(awkward):
    measured, names = quality.measure(awkward)
    assert names["n_words"] == "_n_words" and set(awkward.columns) < set(measured.columns)
    for r in measured.collect():
        got = tuple(r[names[n]] for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
        assert got == plain_counts(r["text"])


def test_quality_filter_keeps_columns_and_rejects_by_source(spark, awkward, nothing):
    rng = np.random.default_rng(2)
    text = lambda noisy: " ".join("".join(rng.choice(list("abcdefgh"), 5)) + ("%%%" if noisy else "") for _ in range(60))
    rows = [(i, text(i % 10 == 0), "en", "s") for i in range(500)]
    kept = {r["doc_id"] for r in quality.quality_filter(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert kept == {i for i in range(500) if i % 10}
    out = quality.quality_filter(awkward)
    assert out.columns == awkward.columns and out.count() <= awkward.count()
    assert quality.quality_filter(nothing).count() == 0


def test_fences_follow_the_corpus_without_a_size_switch(spark):
    """A source of its own kind is judged by itself, a small one by its language, and ten times the rows change no verdict of either."""
    rng = np.random.default_rng(12)
    text = lambda size, marks: " ".join("".join(rng.choice(list("abcdefgh"), size)) + "#" * (i < marks) for i in range(80))
    rows = [(i, text(4 + i % 3, 0), "en", "plain") for i in range(900)] + [(1000 + i, text(14 + i % 3, 0), "en", "long") for i in range(300)]
    rows += [(5000, text(5, 0), "en", "tiny"), (5001, text(60, 0), "en", "tiny"), (5002, text(5, 70), "en", "tiny"), (5003, text(5, 3), "en", "tiny"), (5004, text(15, 0), "en", "plain")]
    schema = "doc_id long, text string, lang string, source string"
    once = {r["doc_id"] for r in quality.quality_filter(spark.createDataFrame(rows, schema)).collect()}
    assert once == {r[0] for r in rows} - {5001, 5002, 5004}
    many = spark.createDataFrame([(d + 10_000 * c, *rest) for c in range(10) for d, *rest in rows if d < 5000] + [r for r in rows if r[0] >= 5000], schema)
    assert {d for d in once if d >= 5000} == {r["doc_id"] for r in quality.quality_filter(many).collect() if 5000 <= r["doc_id"] < 6000}


def test_sketches_merge_in_any_order(spark, awkward):
    measured, names = quality.measure(awkward)
    rules = quality.Rules(min_words=1)
    whole = quality.sketches(measured, names, rules, "lang", "source")
    parts = [quality.sketches(measured.where(c), names, rules, "lang", "source") for c in ("doc_id < 5", "doc_id >= 5 or doc_id is null")]
    merged = parts[1].unionByName(parts[0]).groupBy("lang", "source", "rate", "bin").agg(F.sum("n").alias("n"))
    assert sorted(map(repr, whole.collect())) == sorted(map(repr, merged.collect()))


# 3 repeated strings


def plain_repeats(rows):
    seen = Counter(b[i:i + 200] for _, b in rows for i in range(len(b) - 199))
    out = []
    for d, b in rows:
        hit = np.zeros(len(b), dtype=bool)
        for i in range(len(b) - 199):
            if seen[b[i:i + 200]] > 1:
                hit[i:i + 200] = True
        kept = bytes(np.frombuffer(b, dtype=np.uint8)[~hit])
        out.append((d, len(b), int(hit.sum()), int((np.diff(np.append(False, hit).astype(int)) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("many", [suffixes.MANY, 1])
def test_repeats_equal_plain_repeats(spark, awkward, many):
    rng = np.random.default_rng(3)
    line = lambda n: " ".join("".join(rng.choice(list("abcdeéß"), rng.integers(2, 8))) for _ in range(n))
    passages = [line(60) for _ in range(3)]
    rows = [(100 + i, line(30) + passages[i % 3] + line(40) + passages[0][: 150 + 20 * (i % 9)] + line(5)) for i in range(40)]
    rows += [(200 + i, "ab" * 500 + line(20)) for i in range(2)]
    df = awkward.select("doc_id", "text", "ref").unionByName(spark.createDataFrame([(d, t, "r") for d, t in rows], "doc_id long, text string, ref string"))
    plain = [(r["doc_id"], (r["text"] or "").encode()) for r in df.where("doc_id <> 7 or doc_id is null").collect()]
    got = suffixes.remove_repeats(df, ["doc_id", "ref"], many=many).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got if r["doc_id"] != 7) == plain_repeats(plain)
    assert [(r["n_bytes"], r["n_removed"]) for r in got if r["doc_id"] == 7] == [(300_000, 300_000)]
    for r in got:
        assert (r["kept_text"] is None) == (r["n_bytes"] == 0 and r["kept_text"] is None)


def test_a_passage_in_many_contexts_and_many_equal_rows(spark):
    """Contexts that meet by runs, rows that are equal, and a third of all rows alike."""
    rng = np.random.default_rng(8)
    line = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(2, 8))) for _ in range(n))
    passage = line(80)
    rows = [(i, line(8) + " " + passage[i % 7:] + " " + line(8)) for i in range(250)] + [(900, passage[:260])] + [(1000 + i % 2, line(3) + passage[: 199 + i % 3]) for i in range(6)]
    rows += [(5000, "equal rows " + line(60))] * 1 + [(7000, (text := line(90)))] * 300
    df = spark.createDataFrame(rows, "doc_id long, text string")
    plain = plain_repeats([(d, t.encode()) for d, t in rows])
    for many in (1, 50, suffixes.MANY):
        got = suffixes.remove_repeats(df, ["doc_id"], many=many, with_text=False).collect()
        assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == plain


def test_buckets_are_ranges_of_the_sort_order():
    rng = np.random.default_rng(6)
    tokens = [rng.integers(0, 1 << 63, 3000).astype(np.uint64) * np.uint64(2) for _ in range(3)]
    rows = list(zip(*(t.tolist() for t in tokens)))
    splitters = suffixes._tuples(*(np.array(c, dtype=np.uint64) for c in zip(*sorted(rows)[300::300])))
    bucket = suffixes.bucket_of(*tokens, rng.integers(0, 9, 3000), splitters)
    ordered = [b for _, b in sorted(zip(rows, bucket.tolist()))]
    assert ordered == sorted(ordered) and len(set(ordered)) > 5


def test_runs_follow_contexts_not_bytes():
    """A context whose neighbours are all different leaves a few runs a round, and finds the strings of the common part."""
    rng = np.random.default_rng(9)
    core = rng.integers(97, 123, 200 + 70).astype(np.uint8).tobytes()
    contexts = [rng.integers(97, 123, 65).astype(np.uint8).tobytes() + bytes([i]) + core for i in range(40)]  # strings 66..136 agree
    batch = [dict(t1=1, ref=i, lo=0, off=136, n=137, context=c, run=0) for i, c in enumerate(contexts)]
    before, alive, settled = suffixes.STRING, batch, set()
    for width in suffixes.GRID:
        runs = next(suffixes._parting(width, before)(iter([pa.RecordBatch.from_pylist(alive)]))).to_pylist()
        assert len(runs) <= 4 * len(contexts)
        common, whole = Counter((r["run"], r["common"]) for r in runs), Counter((r["run"], r["least"], r["most"], r["whole"]) for r in runs)
        met = [r for r in runs if common[r["run"], r["common"]] > 1]
        equal = [r for r in met if whole[r["run"], r["least"], r["most"], r["whole"]] > 1]
        settled |= {(r["ref"], 136 - d) for r in equal for d in range(r["least"], r["most"] + 1)}
        leads = {(r["run"], r["whole"]): r for r in reversed(equal)}.values()
        alive, before = [r for r in met if r not in equal] + [r for r in leads if any(x["run"] == r["run"] and x["common"] == r["common"] for x in met if x not in equal)], width
    assert settled == {(i, at) for i in range(40) for at in range(66, 137)}


def test_repeats_of_nothing(nothing):
    assert suffixes.remove_repeats(nothing, nothing.columns).count() == 0


def test_texts_longer_than_a_piece(monkeypatch):
    monkeypatch.setattr(suffixes, "PIECE", 1 << 10)
    raw = np.random.default_rng(4).integers(97, 101, 5000).astype(np.uint8).tobytes()
    _, _, _, lo, _, n = suffixes.anchor_rows(raw, suffixes.Rolling(1 << 11))
    starts = np.concatenate([np.arange(a, a + k) for a, k in zip(lo, n)])
    assert starts.tolist() == list(range(len(raw) - 199))


def test_multikey_order_sorts_and_numbers_runs():
    rng = np.random.default_rng(5)
    tokens = [rng.integers(0, k, 2000).astype(np.uint64) for k in (3, 5, 50)]
    order, segment = suffixes.multikey_order(tokens)
    rows = [tuple(int(t[i]) for t in tokens) for i in order]
    assert rows == sorted(rows)
    assert [a == b for a, b in zip(segment, segment[1:])] == [a == b for a, b in zip(rows, rows[1:])]


# 4 licences


def test_licence_variants_share_a_digest(spark, awkward, nothing):
    known = licenses.known_licenses(spark)
    shouted = "MIT License\nCopyright (c) 2020 Someone\n\n" + licenses.MIT.upper().replace("SUBLICENSE", "SUBLICENCE").replace("\n\n", "\n")
    rows = [(1, shouted, "x"), (2, "text\nLICENSED UNDER THE APACHE LICENCE,  VERSION 2.0\nmore", "x"), (3, licenses.MIT + " more", "x"), (4, None, "x")]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, digest string"), known).collect()}
    assert got[1]["licence"] == "MIT" and got[3]["licence"] is None and got[4]["licence"] is None
    assert (got[2]["notices"], got[2]["n_notices"]) == ("Apache-2.0", 1)
    assert licenses.scan(awkward, known).count() == awkward.select("doc_id", licenses.digest(F.coalesce("text", F.lit("")))).distinct().count()
    assert licenses.scan(nothing, known).count() == 0


def test_full_texts_and_any_copyright_head_are_known(spark):
    known = licenses.known_licenses(spark)
    heads = ["Copyright Joyent, Inc. and other contributors", "Copyright Jane Doe 2020", "Copyright: 2020", "(c) 2020 Someone", "COPYRIGHT © 2019-2021 A, B"]
    full = dict(licenses.full_texts())
    assert {"Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0"} <= set(full)
    cases = [("MIT", f"MIT License\n\n{h}\n\n{licenses.MIT}") for h in heads] + licenses.full_texts()
    cases += [("BSD-3-Clause", "Copyright 2011 The Authors. All rights reserved.\n\n" + full["BSD-3-Clause"])]
    cases += [(None, "\n".join(line for line in full["Apache-2.0"].split("\n") if "(c)" not in line)), (None, licenses.MIT + "\nmore")]
    rows = [(i, t) for i, (_, t) in enumerate(cases)]
    got = {r["doc_id"]: r["licence"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), known).collect()}
    wrong = [(i, cases[i][0], got[i]) for i in got if got[i] != cases[i][0]]
    assert len(got) == len(cases) and not wrong


def test_notices_belong_to_rows(spark):
    rows = [(None, "Released under the MIT License."), (None, "bar"), (1, "x\nLicensed under CC BY 4.0."), (1, "y"), (1, "y")]
    got = sorted(((r["doc_id"] or 0, r["notices"], r["n_notices"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), licenses.known_licenses(spark)).collect()))
    assert got == [(0, "", 0), (0, "MIT", 1), (1, "", 0), (1, "CC-BY-4.0", 1)]


# 5 source mix


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    full, total = set(), sum(sizes.values())
    while True:
        left = total - sum(3 * sizes[s] for s in full)
        free = sum(w for s, w in weight.items() if s not in full)
        share = {s: left * weight[s] / free for s in order if s not in full}
        over = {s for s in share if share[s] > 3 * sizes[s]}
        if not over:
            return share | {s: 3.0 * sizes[s] for s in full}
        full |= over


def test_mix_meets_targets_and_limits(spark):
    rng = np.random.default_rng(6)
    rows = [(i, str(rng.choice(["a", "b", "é", "z"], p=[0.7, 0.2, 0.05, 0.05])) if i % 11 else None, int(rng.integers(0, 400))) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    mix = mixing.Mix(shard_docs=64, fan_in=4)
    got = [tuple(r) for r in mixing.copies(df, mix).collect()]
    assert Counter(got) == Counter(tuple(r) for r in mixing.copies(df.repartition(7), mix).collect())
    sizes = Counter()
    for _, s, n in rows:
        sizes[s] += n
    want = plain_targets(sizes)
    source = {d: s for d, s, _ in rows}
    taken = Counter()
    for d, n, whole, target, times in got:
        assert whole == sizes[source[d]] and math.isclose(target, want[source[d]], rel_tol=1e-9)
        assert math.floor(target / whole) <= times <= math.ceil(target / whole) <= 3 or (n == 0 and times == 0)
        taken[source[d]] += n * times
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 400


def test_transfer_keeps_words_and_expectation():
    rng = np.random.default_rng(7)
    for _ in range(2000):
        p, q, w, v = rng.random(), rng.random(), int(rng.integers(1, 90)), int(rng.integers(1, 90))
        a, b = mixing.transfer(p, w, q, v, rng.random())
        assert math.isclose(w * a + v * b, w * p + v * q, abs_tol=1e-9) and {a, b} & {0.0, 1.0} and -1e-12 <= min(a, b) and max(a, b) <= 1 + 1e-12
    mean = np.mean([mixing.round_group(np.array([3, 5, 8]), np.array([0.3, 0.6, 0.5]), rng.random(3)) for _ in range(20000)], axis=0)
    assert np.allclose(mean, [0.3, 0.6, 0.5], atol=0.02)


def test_mixed_documents_appear_as_often_as_taken(spark, awkward, nothing):
    took = mixing.copies(mixing.document_sizes(awkward)).collect()
    out = mixing.mixed(awkward)
    assert out.columns == awkward.columns
    assert Counter((r["doc_id"], len(words(r["text"]))) for r in out.collect()) == Counter({k: n for k, n in sum((Counter({(r["doc_id"], r["size"]): r["copies"]}) for r in took), Counter()).items() if n})
    assert mixing.mixed(nothing).count() == 0


# 6 tokens


def plain_greedy(word, vocabulary, longest):
    n = i = 0
    while i < len(word):
        i += max((k for k in range(1, longest + 1) if word[i:i + k] in vocabulary and i + k <= len(word)), default=1)
        n += 1
    return n


def test_automaton_equals_plain_greedy():
    rng = np.random.default_rng(8)
    for _ in range(20):
        vocabulary = {bytes(rng.choice(list(b"abc"), rng.integers(1, 6)).tolist()) for _ in range(30)}
        automaton = tokens.Automaton.of(vocabulary)
        texts = [bytes(rng.choice(list(b"abcd"), rng.integers(0, 90)).tolist()) for _ in range(100)]
        assert automaton.count(texts).tolist() == [plain_greedy(t, vocabulary, 6) for t in texts]


def test_token_counts_of_awkward_texts(spark, awkward, nothing):
    vocabulary = set(tokens.read_vocabulary())
    longest = max(map(len, vocabulary))
    for r in tokens.count_tokens(awkward, ["doc_id", "n_words", "text"]).collect():
        own = [b" " + w.encode() for w in words(r["text"])]
        assert r["_n_words"] == len(own)
        if r["doc_id"] != 7:
            assert r["n_tokens"] == sum(plain_greedy(w, vocabulary, longest) for w in set(own) for _ in range(own.count(w) if len(own) < 1000 else 1)) or len(own) >= 1000 and len(set(own)) != len(own)
    assert tokens.count_tokens(nothing, ["doc_id"]).count() == 0


# 7 SimHash


def plain_fingerprint(text):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    hs = [xxhash.xxh64_intdigest(" ".join(w[i:i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(points, radius):
    root = {p: p for p in points}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    a = np.array(sorted(points), dtype=np.uint64)
    for x in a:
        for y in a[np.bitwise_count(a ^ x) <= radius]:
            p, q = find(int(x)), find(int(y))
            root[max(p, q)] = min(p, q)
    return {p: find(p) for p in points}


def test_fingerprints_and_groups_of_awkward_rows(awkward, nothing):
    rows = [r for r in awkward.collect()]
    prints = [(r["doc_id"], plain_fingerprint(r["text"])) for r in rows]
    hung = plain_components({f for _, f in prints}, 4)
    least = {}
    for d, f in prints:
        least[hung[f]] = min((x for x in (least.get(hung[f]), d) if x is not None), default=None)
    got = simhash.groups(awkward).collect()
    assert Counter((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in got) == Counter((d, f, least[hung[f]]) for d, f in prints)
    one = simhash.one_per_group(awkward)
    assert one.columns == awkward.columns and sorted(map(repr, (r["doc_id"] for r in one.collect()))) == sorted(map(repr, least.values()))
    assert simhash.groups(nothing).count() == 0 and simhash.one_per_group(nothing).count() == 0


def test_groups_without_ids_or_with_shared_ids_keep_a_row_each(spark):
    far = [" ".join(f"{a}{i * i % 101}" for i in range(60)) for a in "abcd"]
    rows = [(None, far[0]), (None, far[0]), (None, far[1]), (5, far[2]), (5, far[3]), (None, far[3]), (4, far[2])]
    prints = {plain_fingerprint(t) for t in far}
    assert len(set(plain_components(prints, 4).values())) == 4
    got = simhash.one_per_group(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, [(None, far[0]), (None, far[1]), (4, far[2]), (5, far[3])]))


def test_near_duplicates_of_the_pipeline_share_four_fifths_of_their_shingles(spark):
    rng = np.random.default_rng(3)
    sets = lambda t: {tuple(t.split()[i:i + 5]) for i in range(len(t.split()) - 4)}
    rows, want = [], set()
    for g in range(40):
        base = [f"w{x}" for x in rng.integers(0, 5000, 300)]
        near, apart = base.copy(), base.copy()
        near[280:] = [f"n{g}x{i}" for i in range(20)]  # 276 of 316 shingles, 0.87
        apart[240:] = [f"a{g}x{i}" for i in range(60)]  # 236 of 356, 0.66
        texts = [" ".join(t) for t in (base, near, apart)]
        a, b, c = map(sets, texts)
        assert len(a & b) / len(a | b) > 0.85 and len(a & c) / len(a | c) < 0.7
        rows += [(3 * g + i, t) for i, t in enumerate(texts)]
        want |= {3 * g, 3 * g + 2}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in corpus_pipeline.distinct_documents(spark, docs, "").collect()} == want
    assert len({r["doc_id"] for r in simhash.one_per_group(docs, words=5).collect()}) > len(want)


def test_similar_texts_of_awkward_rows(awkward, nothing):
    one = simhash.one_per_group(awkward, words=5, jaccard=0.8)
    ids = Counter(r["doc_id"] for r in one.collect())
    assert one.columns == awkward.columns and ids == Counter([1, 3, 3, 6, 7, 8, 9])
    assert simhash.one_per_group(nothing, words=5, jaccard=0.8).count() == 0


def test_similar_texts_far_apart_in_bits_are_linked(spark):
    """Texts of 0.8 exactly, with fingerprints more bits apart than any block or reach: none is left out."""
    rng = np.random.default_rng(11)
    rows = []
    for g in range(150):
        base = [f"g{g}w{x}" for x in rng.integers(0, 5000, 9)]  # 5 shingles, 4 of them in a text one word shorter
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(base[:-1]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in simhash.one_per_group(docs, words=5, jaccard=0.8).collect()} == {2 * g for g in range(150)}


@pytest.mark.parametrize("run,slice_", [(2, 3), (6, 1024), (32, 1024)])
def test_prefixes_join_what_all_pairs_join(spark, run, slice_):
    rng = np.random.default_rng(5)
    common, rows = rng.integers(0, 1 << 62, 30), []
    for g in range(25):
        base = rng.integers(0, 1 << 62, rng.integers(1, 60))
        for _ in range(8):
            held = base[rng.random(len(base)) > rng.choice([0.0, 0.05, 0.1, 0.2])]
            rows.append(np.unique(np.concatenate((held, common[:rng.choice([0, 1, 30])], rng.integers(0, 1 << 62, rng.integers(0, 4))))))
    rows = [r for r in rows if len(r)]
    least = lambda a, b: len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)) - 1e-9
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if least(rows[i], rows[j])]
    want = list(range(len(rows)))
    for _ in rows:
        for i, j in pairs:
            want[i] = want[j] = min(want[i], want[j])
    sets = cut(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "node long, shingles array<long>"), "sets")
    sets_of = lambda nodes: sets.join(nodes, "node")
    edges = prefix.similar_sets(sets.unionByName(sets), sets_of, 0.8, spark.createDataFrame([], "u long, v long"), run, slice_)
    assert {(max(r), min(r)) for r in map(tuple, edges.collect())} <= set(pairs)
    hung = {r["node"]: r["root"] for r in components(edges).collect()}
    assert len(set(want)) < len(rows) - 40 and [hung.get(i, i) for i in range(len(rows))] == want


def test_a_long_run_sends_fewer_rows_than_sets(spark):
    """A run whose sets all look alike gives a row a set, not a row a pair, and its joining pairs once each."""
    n = 60
    own = [np.asarray(sorted([1, *range(100, 170), *range(1000 * (i + 1), 1000 * (i + 1) + (4 if i % 2 else 40))]), dtype=np.uint64) for i in range(n)]
    maps = pa.array([np.packbits(row).tobytes() for row in prefix.bit_rows(own)], pa.binary())
    size, node = pa.array([len(s) for s in own], pa.int64()), pa.array(range(n), pa.int64())
    same = pa.array([1] * n, pa.int64())
    run = pa.RecordBatch.from_arrays([same, same, node, size, node, maps], ["shingle", "part", "node", "n", "root", "bits"])
    told = [r for b in prefix._across(0.8)(iter([run])) for r in b.to_pylist()]
    assert 0 < len(told) < n
    apart = np.arange(n)
    edges = prefix.joining(own, [np.asarray([1])] * n, np.zeros(n), apart, 0.8)
    assert len(edges) == n // 2 - 1 and all(u % 2 and v % 2 for u, v in edges)
    assert not prefix.joining(own, [np.asarray([i]) for i in range(n)], np.zeros(n), apart, 0.8)
    assert all((u < 30) != (v < 30) for u, v in prefix.joining(own, [np.asarray([1])] * n, apart // 30, apart, 0.8))


def test_prefixes_of_similar_sets_meet(spark):
    rng = np.random.default_rng(2)
    rows = []
    for n in range(1, 80):
        a = np.unique(rng.integers(-(1 << 63), 1 << 63, n).astype(np.uint64)).view(np.int64)
        rows += [(2 * n, a.tolist()), (2 * n + 1, a[rng.permutation(len(a))[:math.ceil(0.8 * len(a))]].tolist())]
        rows += [(-n, rng.integers(-(1 << 63), 1 << 63, n).tolist())]
    rows = [(node, sorted(s, key=lambda x: x % (1 << 64))) for node, s in rows]
    held = defaultdict(set)
    for r in prefix.postings(spark.createDataFrame(rows, "node long, shingles array<long>"), 0.8).collect():
        held[r["node"]].add(r["shingle"])
        assert r["pos"] < prefix.prefix_size(r["n"], 0.8)
    assert all(held[2 * n] & held[2 * n + 1] for n in range(1, 80))
    assert sum(len(held[-n]) for n in range(1, 80)) < sum(len(held[2 * n]) for n in range(1, 80)) / 4


@pytest.mark.parametrize("slice_", [4, 2048])
def test_shards_link_what_all_pairs_link(spark, slice_):
    rng = np.random.default_rng(9)
    centres = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    points = {int(c) for c in centres} | {int(c) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 8), replace=False)) for c in centres for _ in range(12)}
    df = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in points], "fp long")
    hung = {r["node"]: r["root"] for r in components(simhash.linked(df, 4, slice_)).collect()}
    want = plain_components(points, 4)
    groups = lambda of: sorted(sorted(g) for g in of.values())
    mine, theirs = defaultdict(list), defaultdict(list)
    for p in points:
        signed = int(np.uint64(p).view(np.int64))
        mine[hung.get(signed, signed)].append(p)
        theirs[want[p]].append(p)
    assert groups(mine) == groups(theirs)


def test_bk_tree_forest_on_a_dense_ball():
    rng = np.random.default_rng(10)
    points = list({sum(1 << int(b) for b in rng.choice(16, rng.integers(0, 9), replace=False)) for _ in range(600)})
    want = plain_components(set(points), 2)
    root = {}
    for u, v in simhash.forest(points, 2):
        root[u] = v
    mine, theirs = defaultdict(set), defaultdict(set)
    for p in points:
        mine[root.get(p, p)].add(p)
        theirs[want[p]].add(p)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "u long, v long")
    assert {(r["node"], r["root"]) for r in components(edges).collect()} == {(i, 0) for i in range(1, 201)} | {(501, 500)}


# 8 top-k


def test_top_k_with_ties_and_unusable_vectors(spark):
    rng = np.random.default_rng(11)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4)], 0) for i in range(300)]
    rows += [(300, None, 0), (350, [1.0, None, 1.0, 1.0], 0), (400, [1.0, math.nan, 0.0, 0.0], 0), (450, [math.inf, 0.0, 0.0, 0.0], 0), (500, [1.0, 2.0], 0), (550, [], 0), (50, [1.0, 1.0, 1.0, 1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    good = [(i, [math.floor(256 * x) for x in v]) for i, v, _ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, qv in good:
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(qv, v)), i) for i, v in good if i != q and len(v) == len(qv))[:5]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert Counter(map(tuple, topk.top_k(df, F.col("vec_id") % 50 == 0).collect())) == Counter(want)
    assert topk.top_k(df.where("vec_id < 0"), F.col("vec_id") % 50 == 0).count() == 0


def test_top_k_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 3)
    df = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    got = Counter(map(tuple, topk.top_k(df, F.col("vec_id") % 50 == 0).collect()))
    monkeypatch.undo()
    assert got == Counter(map(tuple, topk.top_k(df, F.col("vec_id") % 50 == 0).collect()))


# 9 language


def test_language_of_held_out_documents(spark):
    rows = QUERIES["op9_language_id"](spark, "/root/testdata/sf0.01")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    right = rows.join(truth, "doc_id").where("held_out and lang is not null").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.min("score"), F.max("score")).first()
    assert right[0] > 0.97 and 0.0 <= right[1] <= right[2] <= 1.0


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(12)
    scores, moves = rng.normal(size=(7, 3)), rng.normal(size=(3, 3))
    lengths = np.array([4, 1, 2])
    got, at = language.marginals(scores, lengths, moves), 0
    for n in lengths:
        paths = np.stack(np.meshgrid(*[range(3)] * n, indexing="ij"), -1).reshape(-1, n)
        weight = np.exp(scores[at + np.arange(n), paths].sum(1) + moves[paths[:, :-1], paths[:, 1:]].sum(1))
        want = np.array([[weight[paths[:, i] == y].sum() for y in range(3)] for i in range(n)]) / weight.sum()
        assert np.allclose(got[at:at + n], want)
        at += n


def test_switched_text_and_awkward_rows(spark, awkward, nothing):
    texts = [("the house and the garden were over there with those things " * 3, "en"), ("das haus und der garten waren dort mit diesen dingen " * 3, "de")] * 20
    model = language.train(texts, language.Fit(epochs=5))
    mixed = "the garden and the house were over there das haus und der garten waren dort"
    p = language.marginals(model.emissions(language.words_of(mixed)).astype(float), np.array([15]), model.moves)
    assert [model.labels[i] for i in p.argmax(1)] == ["en"] * 8 + ["de"] * 7
    rows = language.identify(awkward, F.lit(True), {"doc_id": F.col("doc_id"), "score": F.col("n_words"), "text": F.col("text")}).collect()
    assert len(rows) == awkward.count()
    for r in rows:
        assert (r["lang_pred"] == "und" and r["_score"] == 0.0) == (not re.search(r"[^\W\d_]", r["text"] or ""))
    assert language.identify(nothing, F.lit(True), {"doc_id": F.col("doc_id")}).count() == 0
    assert {r["lang_pred"] for r in language.identify(awkward, F.lit(False), {"doc_id": F.col("doc_id")}).collect()} == {"und"}


# 10 chat


def test_chat_round_trip_of_awkward_texts(spark):
    texts = ["", None, "a<", "[", "\\", "\\.", "\\\\.", "<|im_end|>", "<|im_start|>user<|im_sep|>x", "[INST]\n[/INST]</s><s>", "<\\.|", "漢\U0001F600\n", "</s>[INST] ok [/INST]"]
    rows = [(c, t, role, x) for c, role in ((1, "user"), (2, "assistant"), (3, None), (4, "<|im_sep|>\nodd")) for t, x in enumerate(texts)]
    rows += [(5, None, "assistant", "one"), (5, None, "assistant", "one"), (6, 1, "user", "b"), (6, 1, "user", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_chat(df.select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts")))
    back = {r["conv_id"]: r for r in chat.read_back(out).collect()}
    for c in range(1, 7):
        own = sorted(((t is not None, t or 0, role or "", x or "") for i, t, role, x in rows if i == c), key=lambda r: (r[0], r[1], r[2]))
        if c == 6:
            own.sort()
        assert [(t["role"], t["text"]) for t in back[c]["turns"]] == [(role, x) for _, _, role, x in own]
        assert back[c]["loss"] == [x for _, _, role, x in own if role == "assistant"]
        marks = sum(back[c]["formatted"].count(m) for m in (chat.START, chat.SEP, chat.END))
        assert marks == 3 * len(own) and "[INST]" not in back[c]["formatted"]
    assert chat.format_chat(df.limit(0).select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts"))).count() == 0


def test_chat_parts_become_placeholders_in_order(spark):
    part = lambda kind, **k: (kind, k.get("text"), k.get("ref"), k.get("width"), k.get("height"), k.get("seconds"), k.get("pages"))
    rows = [
        (1, 1, "assistant", [part("text", text="done")]),
        (1, 0, "user", [part("text", text="see <"), part("image", ref="i.png", width=57, height=28), part("text", text="|im_end|>"), part("audio", ref="a.wav", seconds=2.5), part("document", ref="d.pdf", pages=3), part("video", ref="v"), part(None, text="!")]),
        (2, 0, "user", None),
    ]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    out = {r["conv_id"]: r for r in chat.format_chat(df).collect()}
    one = out[1]
    assert one["formatted"].startswith("<|im_start|>user<|im_sep|>see <\\.<|image|>|im_end|><|audio|><|document|><|attachment|>!<|im_end|><|im_start|>assistant<|im_sep|>done")
    assert [(a["type"], a["ref"], a["tokens"]) for a in one["attachments"]] == [("image", "i.png", 3), ("audio", "a.wav", 63), ("document", "d.pdf", 2400), ("video", "v", 0)]
    assert one["attachment_tokens"] == 2466
    assert out[2]["formatted"] == "<|im_start|>user<|im_sep|><|im_end|>"


# pipeline


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    kept = {}
    for (name, stage), last in zip(corpus_pipeline.STAGES, [False] * 4 + [True]):
        out = corpus_pipeline.cut(stage(spark, docs, SMALL), name)
        assert last or out.columns == columns, name
        kept[name] = (docs, out)
        docs = out
    before, after = kept["simhash_near_dedup"]
    sets = {r["doc_id"]: set(simhash.shingle_hashes(r["text"], 5).tolist()) for r in before.collect()}
    root = {d: d for d in sets}
    for d in sorted(sets):
        for e in (e for e in sets if e < d and 5 * len(sets[d] & sets[e]) >= 4 * len(sets[d] | sets[e])):
            a, b = root[d], root[e]
            root |= {x: min(a, b) for x in root if root[x] in (a, b)}
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(set(root.values()))
    before, after = kept["suffix_array_dedup"]
    plain = plain_repeats([(r["doc_id"], r["text"].encode()) for r in before.collect()])
    for r in after.collect():
        assert r["n_chars"] == len(r["text"])
        assert any(d == r["doc_id"] and len(r["text"].encode()) >= n - gone - 6 for d, n, gone, _, _ in plain)
    before, after = kept["source_mix"]
    assert {r["doc_id"] for r in after.collect()} <= {r["doc_id"] for r in before.collect()}
    before, after = kept["best_fit_packing"]
    assert after.agg(F.sum("length")).first()[0] == before.agg(F.sum(word_count(F.col("text")))).first()[0]


def test_every_operator_and_the_pipeline_are_registered():
    import __spark_entry__ as entry

    keys = entry.queries()
    assert "pipeline" in keys and all(any(k.startswith(f"op{n}_") for k in keys) for n in range(1, 14))
