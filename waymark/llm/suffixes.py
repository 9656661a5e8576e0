"""Removal of byte strings that occur twice, by a distributed sort of suffixes at anchors.

A string of 200 bytes repeats if an equal one starts elsewhere, in any document. Suffixes are sorted
only where they start at an *anchor*: each string's anchor is its k-mer with the smallest hash
(leftmost of equals), so equal strings have their anchors at equal places, and it is enough to
compare strings whose anchors' suffixes begin alike. An anchor row stands for the run of strings
that it anchors, and its context is the text that the run covers.

1. Anchor suffixes are range-partitioned by tokens (leading bytes, k-mer, context) between splitters
   taken from a sample; rows equal in all tokens, copies that is, are salted over every bucket that
   their range touches. A bucket is sorted by multikey quicksort, one token at a time and only inside
   runs that are still equal, and neighbours are compared. A k-mer without an equal decides its run:
   nothing repeats. An equal context decides it too: everything does.
2. A k-mer run that reaches a bucket's end is compared across the boundary: the few runs at bucket
   ends meet in one small table.
3. Where k-mers agree and contexts differ, one context of each kind is cut from the text, and the
   strings in it are sorted the same way on their bytes: within one task for the strings of one
   k-mer. If a k-mer has very many contexts, their strings are never written out one by one: runs of
   them, by the place of the anchor in the string on a fixed grid, meet by digest. The bytes common to
   all strings of a run must occur in two contexts, or none of its strings repeats; where all its bytes
   do, every one does; only what is left open goes on in runs of a quarter. So rows follow
   the contexts that can still match, not their bytes.

Contexts count as equal when two 64-bit digests agree; strings inside contexts are compared byte by
byte, except for very frequent k-mers, where 128-bit digests stand for them.

Edge cases: a null text is empty; texts shorter than a string lose nothing; texts of any length are
processed whole; rows are told apart by a hash of id and text, so repeated rows are occurrences like
any other and lose everything alike; an empty table gives an empty result; other columns are kept.
Removal is by bytes; where text is returned, characters that lose some of their bytes go entirely.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.llm.common import cut

STRING = 200
KMER = 64
PIECE = 1 << 20  # bytes of a text handled at once; longer ones go in overlapping pieces
SAMPLE = 20_000  # anchor rows that splitters are taken from, about
MANY = 1024  # contexts of one k-mer from which they meet by digests of runs
GRID = (64, 16, 4, 1)  # strings of a run, from round to round
AT_ONCE = 300_000  # strings sorted together within a task

ODD = 0x9E3779B97F4A7C15
U64 = np.uint64

WHOLE, LOCAL, SPREAD, EDGE = 0, 1, 2, 3
ROW = "t0 long, t1 long, t2 long, ref long, lo int, off int, n int"


def _powers(n: int, base: int) -> np.ndarray:
    out = np.ones(n, dtype=U64)
    done = 1
    while done < n:
        more = min(done, n - done)
        out[done:done + more] = out[:more] * U64(pow(base, done, 1 << 64))
        done += more
    return out


class Rolling:
    """Hashes of all windows of a width, by a polynomial modulo 2^64."""

    def __init__(self, longest: int):
        self.up, self.down = _powers(longest, ODD), _powers(longest, pow(ODD, -1, 1 << 64))

    def windows(self, data: np.ndarray, width: int) -> np.ndarray:
        sums = np.zeros(len(data) + 1, dtype=U64)
        np.cumsum((data.astype(U64) + U64(1)) * self.up[:len(data)], out=sums[1:])
        h = (sums[width:] - sums[:-width]) * self.down[:len(data) - width + 1]
        h ^= h >> U64(31)
        h *= U64(0xBF58476D1CE4E5B9)
        return h ^ (h >> U64(29))


def big_endian_words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on, as numbers; the text is followed by zeros."""
    padded = np.concatenate((data, np.zeros(8, dtype=np.uint8)))
    out = np.zeros(len(data), dtype=U64)
    for i in range(8):
        out = (out << U64(8)) | padded[i:i + len(data)]
    return out


def anchors(data: np.ndarray, rolling: Rolling, string: int = STRING, kmer: int = KMER) -> tuple[np.ndarray, ...]:
    """(place, first string, last string, k-mer hash) of the anchors of one piece of text."""
    h = rolling.windows(data, kmer)
    low = U64(PIECE - 1)
    best, width, span = (h & ~low) | np.arange(len(h), dtype=U64), 1, string - kmer + 1
    while 2 * width <= span:
        best, width = np.minimum(best[:-width], best[width:]), 2 * width
    if span > width:
        best = np.minimum(best[:width - span], best[span - width:])
    at = (best & low).astype(np.int64)
    first = np.concatenate(([0], np.flatnonzero(np.diff(at)) + 1))
    last = np.append(first[1:], len(at)) - 1
    return at[first], first, last, h[at[first]]


def anchor_rows(raw: bytes, rolling: Rolling, string: int = STRING, kmer: int = KMER) -> list[np.ndarray]:
    """Columns t0, t1, t2 (leading bytes, k-mer, context), lo, off, n of a text's anchors."""
    out = [[] for _ in range(6)]
    data = np.frombuffer(raw, dtype=np.uint8)
    step = PIECE - string + 1
    for base in range(0, max(0, len(raw) - string + 1), step):
        piece = data[base:base + PIECE]
        if len(piece) < string:
            break
        at, first, last, h = anchors(piece, rolling, string, kmer)
        off = at - first
        begin, end = (first + base).tolist(), (last + base + string).tolist()
        digest = xxhash.xxh3_64_intdigest
        context = np.fromiter((digest(raw[a:b], seed) for a, b, seed in zip(begin, end, off.tolist())), dtype=U64, count=len(at))
        lead = np.zeros(len(at), dtype=U64)
        for i in range(8):
            lead = (lead << U64(8)) | piece[at + i]
        for column, values in zip(out, (lead, h, context, first + base, off, last - first + 1)):
            column.append(values)
    return [np.concatenate(c) if c else np.empty(0, dtype=U64 if i < 3 else np.int64) for i, c in enumerate(out)]


def _tuples(t0: np.ndarray, t1: np.ndarray, t2: np.ndarray) -> np.ndarray:
    """Token triples as byte strings that compare like the triples."""
    return np.stack((t0, t1, t2), axis=1).astype(">u8").view("S24").ravel()  # stacking gives native byte order


def bucket_of(t0: np.ndarray, t1: np.ndarray, t2: np.ndarray, salt: np.ndarray, splitters: np.ndarray) -> np.ndarray:
    """Bucket of each triple; triples equal to several splitters are spread over the buckets between them."""
    rows = _tuples(t0, t1, t2)
    left, right = np.searchsorted(splitters, rows, "left"), np.searchsorted(splitters, rows, "right")
    return (left + salt % (right - left + 1)).astype(np.int32)


def multikey_order(tokens: list[np.ndarray], start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order and, in it, the number of each run of equal rows.

    Multikey quicksort a depth at a time: all segments are ordered by the current token, and only
    rows that still share a segment with another one go on to the next.
    """
    n = len(tokens[0])
    order = np.arange(n) if start is None else np.argsort(start, kind="stable")
    segment = np.zeros(n, dtype=np.int64) if start is None else np.concatenate(([0], np.cumsum(np.diff(start[order]) != 0)))[:n]
    live = np.arange(n)  # places in order that still have a neighbour
    for token in tokens:
        same = np.zeros(len(live), dtype=bool)
        if len(live):
            pair = segment[live[1:]] == segment[live[:-1]]
            same[1:] |= pair
            same[:-1] |= pair
        live = live[same]
        if not len(live):
            break
        value, seg = token[order[live]], segment[live]
        if ((value[1:] != value[:-1]) & (seg[1:] == seg[:-1])).any():
            moved = np.lexsort((value, seg))
            order[live] = order[live][moved]
            value = value[moved]
            new = np.concatenate(([True], (seg[1:] != seg[:-1]) | (value[1:] != value[:-1])))
            # segments are numbered by the place of their first row, so that order among all stays right
            segment[live] = live[np.maximum.accumulate(np.where(new, np.arange(len(live)), 0))]
        else:
            segment[live] = live[np.concatenate(([0], np.flatnonzero(seg[1:] != seg[:-1]) + 1))][np.concatenate(([0], np.cumsum(seg[1:] != seg[:-1])))]
        others = np.ones(n, dtype=bool)
        others[live] = False
        segment[others] = np.flatnonzero(others)
    return order, segment


def _int64(a: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(a).astype(U64).view(np.int64) if a.dtype == U64 else a.astype(np.int64))


def _anchoring(splitters):
    """(ref, text) to anchor rows with their buckets; without splitters, rows for the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling(PIECE + 1)
        for batch in batches:
            refs, columns, per = batch.column(0).to_numpy(), [[] for _ in range(6)], []
            for text in batch.column(1).to_pylist():
                rows = anchor_rows((text or "").encode(), rolling)
                per.append(len(rows[0]))
                for column, values in zip(columns, rows):
                    column.append(values)
            t0, t1, t2, lo, off, n = (np.concatenate(c) for c in columns)
            ref = np.repeat(refs, per)
            salt = ((ref.view(U64) + lo.astype(U64)) * U64(ODD) >> U64(40)).astype(np.int64)
            bucket = bucket_of(t0, t1, t2, salt, splitters.value) if splitters is not None else np.zeros(len(ref), dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket), _int64(t0), _int64(t1), _int64(t2), pa.array(ref), *[pa.array(c.astype(np.int32)) for c in (lo, off, n)]],
                ["bucket", "t0", "t1", "t2", "ref", "lo", "off", "n"],
            )

    return run


def take_splitters(rows: DataFrame, buckets: int) -> np.ndarray:
    """Equal-share splitters of the token triples of a sample."""
    got = rows.select("t0", "t1", "t2").toPandas()
    values = np.sort(_tuples(*[got[c].to_numpy().view(U64) for c in ("t0", "t1", "t2")]))
    if not len(values):
        return np.empty(0, dtype="S24")
    return values[np.linspace(0, len(values) - 1, buckets + 1).astype(int)[1:-1]]


COMPARED = "kind int, t0 long, t1 long, t2 long, ref long, lo int, off int, n int, many boolean, first boolean, bound boolean"


def _comparing(many: int):
    """Sorts a bucket and compares neighbours.

    WHOLE rows repeat in full; LOCAL and SPREAD rows stand for one context of a k-mer that has several;
    EDGE rows stand for one context of a k-mer at an end of the bucket. Others are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)) if batches else None
        if table is None or not table.num_rows:
            return
        t0, t1, t2, ref = (table.column(c).to_numpy() for c in ("t0", "t1", "t2", "ref"))
        lo, off, n = (table.column(c).to_numpy() for c in ("lo", "off", "n"))
        order, _ = multikey_order([t.view(U64) for t in (t0, t1, t2)])
        t0, t1, t2, ref, lo, off, n = (c[order] for c in (t0, t1, t2, ref, lo, off, n))
        core = (t0[1:] == t0[:-1]) & (t1[1:] == t1[:-1])
        full = core & (t2[1:] == t2[:-1])
        new_core, new_full = np.append(True, ~core), np.append(True, ~full)
        core_no, full_no = np.cumsum(new_core) - 1, np.cumsum(new_full) - 1
        classes = np.bincount(core_no, weights=new_full).astype(np.int64)
        in_class = np.bincount(full_no)[full_no] > 1
        edge = (core_no == 0) | (core_no == core_no[-1])
        bound = edge & ((full_no == 0) | (full_no == full_no[-1]))
        several = ~edge & (classes[core_no] > 1) & new_full
        reps = np.where(classes[core_no] > many, SPREAD, LOCAL)
        constant = lambda kind: np.full(len(t0), kind)
        parts = [(np.flatnonzero(in_class), constant(WHOLE)), (np.flatnonzero(several), reps), (np.flatnonzero(edge & new_full), constant(EDGE))]
        for at, kinds in parts:
            for s in range(0, len(at), 100_000):
                i = at[s:s + 100_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(kinds[i].astype(np.int32)), *[pa.array(c[i]) for c in (t0, t1, t2, ref, lo, off, n)], *[pa.array(c[i]) for c in (in_class, new_full, bound)]],
                    ["kind", "t0", "t1", "t2", "ref", "lo", "off", "n", "many", "first", "bound"],
                )

    return run


def compared(rows: DataFrame, buckets: int, many: int = MANY) -> DataFrame:
    """Sorts and compares dealt rows, then settles the k-mers at bucket ends.

    At most two k-mers of a bucket are at its ends, and a class that goes on in the next bucket holds
    the last row of the one and the first row of the other: the tables joined here have at most two
    rows per bucket. A class at an end comes as one row, so copies do not add up here either.
    """
    found = cut(rows.repartitionById(buckets, "bucket").drop("bucket").mapInArrow(_comparing(many), COMPARED), "compared")
    edges = found.where(F.col("kind") == EDGE)
    cores = edges.groupBy("t0", "t1").agg((F.min("t2") != F.max("t2")).alias("several"), F.count_if("first").alias("classes"))
    across = edges.where("bound").groupBy("t0", "t1", "t2").agg((F.count("*") > 1).alias("across")).where("across")
    settled = edges.join(F.broadcast(cores), ["t0", "t1"]).join(F.broadcast(across), ["t0", "t1", "t2"], "left")
    repeats = ~F.col("many") & F.coalesce("across", F.lit(False))
    own = ["kind", "t1", "ref", "lo", "off", "n"]
    return (
        found.where(F.col("kind") != EDGE).select(*own)
        .unionByName(settled.where(repeats).withColumn("kind", F.lit(WHOLE)).select(*own))
        .unionByName(settled.where(F.col("several") & F.col("first")).withColumn("kind", F.when(F.col("classes") > many, SPREAD).otherwise(LOCAL)).select(*own))
    )


CONTEXTS = "spread boolean, t1 long, ref long, lo int, off int, n int, context binary"


def _cutting_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ref, text, wanted anchors) to contexts."""
    for batch in batches:
        out = [[] for _ in range(7)]
        for ref, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            raw = text.encode()
            for w in wanted:
                row = (w["kind"] == SPREAD, w["t1"], ref, w["lo"], w["off"], w["n"], raw[w["lo"]:w["lo"] + w["n"] - 1 + STRING])
                for column, value in zip(out, row):
                    column.append(value)
        kinds = [pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], [c.split()[0] for c in CONTEXTS.split(", ")])


RUNS = "t1 long, ref long, lo int, off int, n int, context binary, run int, least int, most int, common binary, whole binary"


def _parting(width: int, before: int):
    """Contexts, each with a run of ``before`` strings, to the runs of ``width`` in it, with their digests.

    Strings are counted by the bytes before their anchor, which equal strings share. ``common`` is for what
    all strings of the run's place on the grid hold, ``whole`` for all that the context's own ones cover.
    """
    names = [c.split()[0] for c in RUNS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[] for _ in names]
            for row in zip(*(batch.column(c).to_pylist() for c in ("t1", "ref", "lo", "off", "n", "context", "run"))):
                off, n, context, held = row[3:]
                least, most = max(held * before, off - n + 1), min(held * before + before - 1, off)
                for part in range(least // width, most // width + 1):
                    first, last = part * width, min((part + 1) * width - 1, STRING - KMER)
                    own = max(first, least), min(last, most)
                    common, whole = context[off - first:off - last + STRING], context[off - own[1]:off - own[0] + STRING]
                    for column, value in zip(out, (*row[:6], part, *own, xxhash.xxh3_128_digest(common), xxhash.xxh3_128_digest(whole))):
                        column.append(value)
            kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 3, pa.binary(), *[pa.int32()] * 3, pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names)

    return run


def met_runs(contexts: DataFrame) -> DataFrame:
    """(ref, begin, end) of the strings of contexts (t1, ref, lo, off, n, context) that meet others, by runs.

    Every round keeps the runs whose common bytes stand in two contexts at least, settles those that are
    equal as a whole, and parts the rest together with one of each kind that is settled at the same
    place; of single strings all that is kept is settled.
    """
    out, rows, before = None, contexts.withColumn("run", F.lit(0)), STRING
    for width in GRID:
        runs = cut(rows.mapInArrow(_parting(width, before), RUNS), "runs")
        place, span = ["t1", "run", "common"], ["t1", "run", "least", "most", "whole"]
        met = runs.groupBy(*place).agg(F.count("*").alias("_met")).where("_met > 1").drop("_met")
        equal = runs.groupBy(*span).agg(F.count("*").alias("_n"), F.min(F.struct("ref", "lo")).alias("_lead")).where("_n > 1")
        kept = cut(runs.join(met, place, "left_semi").join(equal, span, "left").select(
            *runs.columns, F.col("_n").isNotNull().alias("settled"), (F.col("_lead") == F.struct("ref", "lo")).alias("leads")
        ), "met")
        start = F.col("lo") + F.col("off")
        found = kept.where("settled").select("ref", (start - F.col("most")).alias("begin"), (start - F.col("least") + STRING).alias("end"))
        out = found if out is None else out.unionByName(found)
        # one of the equal ones goes on for those at its place that are still open
        still = kept.where("not settled")
        partners = kept.where("settled and leads").join(still.select(*place).distinct(), place, "left_semi").select(*kept.columns)
        rows, before = cut(still.unionByName(partners).drop("settled", "leads", "least", "most", "common", "whole"), "open"), width
        if rows.isEmpty():
            break
    return out


SPANS = "ref long, begin int, end int"


def _spans(ref: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ref), pa.array(begin.astype(np.int32)), pa.array(end.astype(np.int32))], ["ref", "begin", "end"])


def repeated_strings(kmer: np.ndarray, off: np.ndarray, n: np.ndarray, contexts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of strings in contexts that have an equal under the same k-mer: (row, first, last string)."""
    sizes = np.fromiter(map(len, contexts), dtype=np.int64, count=len(contexts))
    data = np.frombuffer(b"".join(contexts), dtype=np.uint8)
    row = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)  # of the string in its context
    at = np.repeat(np.cumsum(sizes) - sizes, n) + place
    words = big_endian_words(data)
    whole = Rolling(len(data) + 1).windows(data, STRING)[at]
    _, group = np.unique(kmer, return_inverse=True)
    start = group[row] * (STRING + 1) + (off[row] - place)  # equal strings have their anchor at the same place
    tokens = [whole, *[words[at + d] for d in range(0, STRING - 7, 8)]]
    order, segment = multikey_order(tokens, start)
    equal = np.zeros(len(row), dtype=bool)
    pair = segment[1:] == segment[:-1]
    equal[order[1:]] |= pair
    equal[order[:-1]] |= pair
    hit = np.flatnonzero(equal)
    new = np.append(True, (np.diff(hit) != 1) | (row[hit[1:]] != row[hit[:-1]])) if len(hit) else np.empty(0, dtype=bool)
    begins = hit[new]
    ends = hit[np.append(np.flatnonzero(new)[1:] - 1, len(hit) - 1)] if len(hit) else hit
    return row[begins], place[begins], place[ends]


def _sorting_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts, sorted by k-mer, to spans of repeated strings; a k-mer is never split between two sorts."""
    held: pa.Table | None = None

    def spans(table: pa.Table) -> pa.RecordBatch:
        kmer, ref, lo, off, n = (table.column(c).to_numpy() for c in ("t1", "ref", "lo", "off", "n"))
        row, first, last = repeated_strings(kmer, off, n, table.column("context").to_pylist())
        return _spans(ref[row], lo[row] + first, lo[row] + last + STRING)

    for batch in batches:
        held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        if not held.num_rows:
            continue
        strings = held.column("n").to_numpy().sum()
        kmer = held.column("t1").to_numpy()
        last = int(np.flatnonzero(kmer != kmer[-1]).max(initial=-1)) + 1
        if strings > AT_ONCE and last:
            yield spans(held.slice(0, last).combine_chunks())
            held = held.slice(last).combine_chunks()
    if held is not None and held.num_rows:
        yield spans(held.combine_chunks())


def repeated_spans(texts: DataFrame, many: int = MANY) -> DataFrame:
    """(ref, begin, end): byte spans of (ref, text) rows that are covered by repeated strings."""
    spark = texts.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kinds = f"bucket int, {ROW}"
    sizes = texts.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    expected = (sizes[0] or 0) * 2 // (STRING - KMER) + 1
    part = max(1, expected // SAMPLE)
    sample = texts.where(F.pmod(F.col("ref"), F.lit(part)) == 0).mapInArrow(_anchoring(None), kinds)
    rate = min(1.0, 5.0 * SAMPLE / expected) if part == 1 else 1.0
    splitters = spark.sparkContext.broadcast(take_splitters(sample.sample(rate, 1) if rate < 1 else sample, buckets))
    dealt = texts.where(F.octet_length("text") >= STRING).mapInArrow(_anchoring(splitters), kinds)
    verdicts = compared(dealt, buckets, many)
    runs = verdicts.where(F.col("kind") == WHOLE).select("ref", F.col("lo").alias("begin"), (F.col("lo") + F.col("n") - 1 + STRING).alias("end"))
    wanted = verdicts.where(F.col("kind") != WHOLE).groupBy("ref").agg(F.collect_list(F.struct("kind", "t1", "lo", "off", "n")).alias("wanted"))
    contexts = cut(texts.join(wanted, "ref").dropDuplicates(["ref"]).select("ref", "text", "wanted").mapInArrow(_cutting_out, CONTEXTS), "contexts")
    local = contexts.where(~F.col("spread")).drop("spread").repartition("t1").sortWithinPartitions("t1").mapInArrow(_sorting_strings, SPANS)
    out, spread = runs.unionByName(local), contexts.where("spread").drop("spread")
    return out if spread.isEmpty() else out.unionByName(met_runs(spread))


def _removing(with_text: bool, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = (batch.column(batch.num_columns - i).to_pylist() for i in (2, 1))
            out = [[] for _ in range(5)]
            for text, found in zip(texts, spans):
                raw = (text or "").encode()
                kept, removed, runs = raw, 0, 0
                if found:
                    begin, end = (np.asarray([s[k] for s in found]) for k in ("begin", "end"))
                    order = np.argsort(begin, kind="stable")
                    begin, reach = begin[order], np.maximum.accumulate(end[order])
                    new = np.append(True, begin[1:] > reach[:-1])
                    begin, end = begin[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(reach) - 1)]
                    removed, runs = int((end - begin).sum()), len(begin)
                    view = memoryview(raw)
                    kept = b"".join(view[a:b] for a, b in zip([0, *end.tolist()], [*begin.tolist(), len(raw)]))
                for column, value in zip(out, (len(raw), removed, runs, hashlib.sha256(kept).hexdigest(), kept.decode(errors="ignore") if with_text and text is not None else None)):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *[pa.array(c, t) for c, t in zip(out, kinds)]], names=names)

    return run


def remove_repeats(docs: DataFrame, keep: list[str], with_text: bool = True, doc_id: str = "doc_id", text: str = "text", many: int = MANY) -> DataFrame:
    """``keep`` columns of every row, in place, with n_bytes, n_removed, n_spans, kept_sha256 and kept_text at the end."""
    ref = F.xxhash64(f"`{doc_id}`", f"`{text}`")
    texts = docs.select(ref.alias("ref"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    spans = repeated_spans(texts, many).distinct().groupBy("ref").agg(F.collect_list(F.struct("begin", "end")).alias("_spans"))
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], ref.alias("ref"), F.col(f"`{text}`").cast("string").alias("_body"))
    joined = rows.join(spans, "ref", "left").select(*[f"c{i}" for i in range(len(keep))], "_body", "_spans")
    added = [("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("n_spans", T.LongType()), ("kept_sha256", T.StringType()), ("kept_text", T.StringType())]
    schema = T.StructType([*joined.schema.fields[:len(keep)], *[T.StructField(f"_{n}", t) for n, t in added]])
    done = joined.mapInArrow(_removing(with_text, schema.names), schema)
    return done.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], *[F.col(f"_{n}").alias(n if n not in keep else f"_{n}") for n, _ in added])
