"""Pairs of shingle sets whose Jaccard similarity reaches a bound, found by a complete prefix filter.

All shingles have one order, rare ones first. Two sets of Jaccard similarity ``t`` or more share a
shingle among the first ``n - ceil(t n) + 1`` of each, so every such pair meets at a shingle of these
prefixes, whatever the order is; the order only decides how many others meet there too. It begins
with a fixed ``SHARE`` of all shingles, by the exact number of sets that hold them: a shingle of one
set meets nobody and is not sent on, so most texts send nothing. The rest follow by their hashes, and
those of frequent cells of a count sketch, which are never counted one by one, come last.

Up to ``RUN`` sets that meet at a shingle are paired with each other. Of a longer run only neighbours
in an order of its own are paired at first, which joins groups of near copies; then the run is cut
into slices, and of two sets that lie in different groups by then every pair is looked at, but
those left out whose bitmaps show that they differ in too many shingles. Pairs are exact only after
the check of whole sets that follows. The pairs that bitmaps leave are not sent anywhere, as they grow
with the square of a run: each run tells only which of its sets hang together by them. Sets that
do in any run are brought together whole, in pairs of slices, every pair that meets is checked once,
and only edges that join two groups leave the task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import cut
from waymark.llm.components import components

CELL_BITS = 22
SHARE = 0.3
HOT = 1 << 16
RUN = 32
SLICE = 1024
BITS = 2048
SPARE = 1e-6
AT_ONCE = 1 << 22  # shingles of the sets that are checked against one set at a time


def _frequent_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells of shingles that are fuller in this task than chance would fill them."""
    counts = np.zeros(1 << CELL_BITS, dtype=np.int64)
    for batch in batches:
        flat = batch.column(1).flatten().to_numpy().view(np.uint64)
        counts += np.bincount((flat >> np.uint64(64 - CELL_BITS)).astype(np.int64), minlength=1 << CELL_BITS)
    mean = counts.mean()
    full = np.flatnonzero(counts > 4 + mean + 6 * math.sqrt(mean))
    yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(counts[full])], ["cell", "n"])


def frequent_cells(sets: DataFrame) -> np.ndarray:
    """At most ``HOT`` cells of the most frequent shingles, the fullest last; they only order prefixes."""
    full = sets.mapInArrow(_frequent_cells, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    return np.asarray([r["cell"] for r in full.orderBy(F.desc("n"), "cell").limit(HOT).collect()][::-1], dtype=np.int64)


def places(shingles: np.ndarray, cells: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Class of every shingle: -1 of the counted share, 0 of the rest, from 1 on frequent ones by the ``rank`` of their (sorted) ``cells``."""
    kind = np.where(shingles < np.uint64(int(SHARE * (1 << 64))), -1, 0)
    if len(cells):
        mine = (shingles >> np.uint64(64 - CELL_BITS)).astype(np.int64)
        at = np.minimum(np.searchsorted(cells, mine), len(cells) - 1)
        kind = np.where(cells[at] == mine, rank[at] + 1, kind)
    return kind


def prefix_size(n: int, jaccard: float) -> int:
    """How many of a set's ``n`` shingles, first in order, meet every set of ``jaccard`` or more."""
    return n - math.ceil(jaccard * n - SPARE) + 1 if n else 0


def _each(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    lists = batch.column(1)
    ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
    return (flat[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()))


def _counted(hot: np.ndarray):
    """(shingle, node) of the counted share."""
    rank = np.argsort(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat, sizes = lists.flatten().to_numpy().view(np.uint64), np.diff(lists.offsets.to_numpy())
            kept = places(flat, hot[rank], rank) == -1
            yield pa.RecordBatch.from_arrays([pa.array(flat[kept].view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), sizes)[kept])], ["shingle", "node"])

    return run


def _sized(jaccard: float, hot: np.ndarray):
    """(node, n, counted, rest): sizes of a set and of its counted share, and what its prefix needs beyond that."""
    rank = np.argsort(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counted, rest, sizes = [], [], []
            for own in _each(batch):
                kind = places(own, hot[rank], rank)
                counted.append(int((kind == -1).sum()))
                sizes.append(len(own))
                rest.append(own[np.lexsort((own, kind))[counted[-1]:prefix_size(len(own), jaccard)]].view(np.int64))
            ends = np.cumsum([0, *map(len, rest)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rest or [np.empty(0, dtype=np.int64)])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(counted, pa.int64()), lists], ["node", "n", "counted", "rest"])

    return run


def _shared(shingle: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
    """(node, shingle, df) of shingles that several nodes hold; a node may be repeated."""
    once = np.concatenate(([True], (np.diff(shingle) != 0) | (np.diff(node) != 0)))
    shingle, node = shingle[once], node[once]
    df = np.repeat(sizes := _bounds(shingle)[1], sizes)
    return pa.RecordBatch.from_arrays([pa.array(c[df > 1]) for c in (node, shingle, df)], ["node", "shingle", "df"])


def postings(sets: DataFrame, jaccard: float) -> DataFrame:
    """(shingle, node, n, pos): the prefix of every set (node, shingles; nodes may be repeated) but shingles of one set; ``pos`` in order."""
    hot = frequent_cells(sets)
    dealt = sets.mapInArrow(_counted(hot), "shingle long, node long").repartition("shingle").sortWithinPartitions("shingle", "node")
    shared = dealt.mapInArrow(whole_runs(1, _shared), "node long, shingle long, df long")
    own = shared.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "shingle"))).alias("shared"))
    sized = sets.mapInArrow(_sized(jaccard, hot), "node long, n long, counted long, rest array<long>").dropDuplicates(["node"])
    n, alone = F.col("n"), F.col("counted") - F.size("shared")
    meets = F.when(n == 0, 0).otherwise(n - F.ceil(F.lit(jaccard) * n - SPARE) + 1)
    first = F.transform(F.slice("shared", F.lit(1), F.greatest(F.lit(0), meets - alone).cast("int")), lambda x, i: F.struct(x["shingle"].alias("shingle"), (alone + i).alias("pos")))
    later = F.transform("rest", lambda x, i: F.struct(x.alias("shingle"), (F.col("counted") + i).alias("pos")))
    known = sized.join(own, "node", "left").withColumn("shared", F.coalesce("shared", F.array().cast("array<struct<df:bigint,shingle:bigint>>")))
    return known.select("node", "n", F.inline(F.concat(first, later))).select("shingle", "node", "n", "pos")


def whole_runs(keys: int, work: Callable[..., pa.RecordBatch]):
    """``work`` on columns that hold whole runs of equal first ``keys`` columns; rows come sorted by them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held is not None:
                columns = [np.concatenate(pair) for pair in zip(held, columns)]
            if not len(columns[0]):
                continue
            other = np.any([c != c[-1] for c in columns[:keys]], axis=0)
            last = int(np.flatnonzero(other).max(initial=-1)) + 1
            if last:
                yield work(*[c[:last] for c in columns])
            held = [c[last:] for c in columns]
        if held is not None:
            yield work(*held)

    return run


def _bounds(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    new = np.flatnonzero(np.any([np.diff(k) != 0 for k in keys], axis=0)) + 1
    starts = np.concatenate(([0], new))
    return starts, np.concatenate((new, [len(keys[0])])) - starts


def _meetings(jaccard: float, most: int):
    def work(shingle: np.ndarray, node: np.ndarray, n: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
        """Pairs (n null) of short runs, neighbours of long ones, and the postings (shingle, node, n) of long ones."""
        starts, sizes = _bounds(shingle)
        us, vs, long_ = [], [], []
        for size in np.unique(sizes[(sizes > 1) & (sizes <= most)]).tolist():
            first = starts[sizes == size]
            for i in range(size - 1):
                for j in range(i + 1, size):
                    us.append(first + i)
                    vs.append(first + j)
        for a, size in zip(starts[sizes > most].tolist(), sizes[sizes > most].tolist()):
            mixed = (node[a:a + size] ^ shingle[a]).view(np.uint64) * np.uint64(0xFF51AFD7ED558CCD)
            order = a + np.argsort(mixed ^ (mixed >> np.uint64(33)))
            us.append(order[:-1])
            vs.append(order[1:])
            long_.append(np.arange(a, a + size))
        u, v, kept = (np.concatenate(c) if c else np.empty(0, dtype=np.int64) for c in (us, vs, long_))
        # where two sets meet first, nothing before it is shared: what both have left bounds what they share
        near = np.minimum(n[u] - pos[u], n[v] - pos[v]) >= jaccard / (1 + jaccard) * (n[u] + n[v]) - SPARE
        ends = np.unique(np.sort(np.stack([node[u[near]], node[v[near]]], axis=1), axis=1), axis=0)
        sizes_ = pa.array(np.concatenate((np.zeros(len(ends), dtype=np.int64), n[kept])), mask=np.arange(len(ends) + len(kept)) < len(ends))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate((ends[:, 0], shingle[kept]))), pa.array(np.concatenate((ends[:, 1], node[kept]))), sizes_], ["a", "b", "n"])

    return whole_runs(1, work)


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        maps = []
        for own in _each(batch):
            bits = np.zeros(BITS, dtype=bool)
            bits[(own % np.uint64(BITS)).astype(np.int64)] = True
            maps.append(np.packbits(bits).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(maps, pa.binary())], ["node", "bits"])


def possible(n: np.ndarray, bits: np.ndarray, root: np.ndarray, jaccard: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of pairs of different roots whose sets can share enough: a bit of one alone is a shingle of one alone."""
    mine = bits.astype(np.float32)
    filled, us, vs = bits.sum(axis=1), [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
    for at in range(0, len(n), 256):
        rows = slice(at, at + 256)
        both = mine[rows] @ mine.T
        most = np.minimum(n[rows, None] - filled[rows, None] + both, n[None, :] - filled[None, :] + both)
        fit = (most >= jaccard / (1 + jaccard) * (n[rows, None] + n[None, :]) - SPARE) & (root[rows, None] != root[None, :])
        u, v = np.nonzero(fit)
        us.append((u + at)[u + at < v])
        vs.append(v[u + at < v])
    return np.concatenate(us), np.concatenate(vs)


def least_labels(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For each of ``n`` positions the smallest one that the pairs (u, v) join it with."""
    label = np.arange(n)
    while len(u):
        before = label.copy()
        np.minimum.at(label, u, before[v])
        np.minimum.at(label, v, before[u])
        label = label[label]
        if np.array_equal(label, before):
            break
    return label


def _across(jaccard: float):
    """(u, v): which nodes of a run and part hang together by pairs that bitmaps allow, one row a node at most."""

    def work(shingle: np.ndarray, part: np.ndarray, node: np.ndarray, n: np.ndarray, root: np.ndarray, bits: np.ndarray) -> pa.RecordBatch:
        us, vs = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
        for a, size in zip(*(c.tolist() for c in _bounds(shingle, part))):
            of = slice(a, a + size)
            maps = np.unpackbits(np.frombuffer(b"".join(bits[of]), dtype=np.uint8).reshape(size, -1), axis=1)
            label = least_labels(size, *possible(n[of], maps, root[of], jaccard))
            hung = np.flatnonzero(label != np.arange(size))
            us.append(node[of][hung])
            vs.append(node[of][label[hung]])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])

    return whole_runs(2, work)


def bit_rows(sets: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(sets), BITS), dtype=bool)
    for row, own in zip(out, sets):
        row[(own % np.uint64(BITS)).astype(np.int64)] = True
    return out


def joining(sets: list[np.ndarray], held: list[np.ndarray], side: np.ndarray, root: np.ndarray, jaccard: float) -> list[tuple[int, int]]:
    """Positions of pairs of sets (ascending) of ``jaccard`` or more that join two groups; ``root`` tells the groups so far.

    Pairs are checked that hold a common shingle of ``held``; where ``side`` has two values, pairs across them.
    """
    n = np.asarray([len(s) for s in sets], dtype=np.int64)
    u, v = possible(n, bit_rows(sets), root, jaccard)
    owner, flat = np.repeat(np.arange(len(held)), [len(h) for h in held]), np.concatenate(held)
    order = np.argsort(flat, kind="stable")
    meet = np.zeros((len(sets), len(sets)), dtype=bool)
    for a, size in zip(*(c.tolist() for c in _bounds(flat[order]))):
        if size > 1:
            met = owner[order[a:a + size]]
            meet[np.ix_(met, met)] = True
    asked = meet[u, v] & ((side[u] != side[v]) | (side == side[0]).all())
    u, v = u[asked], v[asked]
    label, edges = np.unique(root, return_inverse=True)[1], []
    for one in np.unique(u).tolist():
        others = v[u == one]
        part = np.cumsum(n[others]) // AT_ONCE
        for some in (others[part == p] for p in np.unique(part)):
            some = some[label[some] != label[one]]
            if not len(some):
                continue
            flat = np.concatenate([sets[i] for i in some])
            known = sets[one][np.minimum(np.searchsorted(sets[one], flat), n[one] - 1)] == flat
            met = np.add.reduceat(known.astype(np.int64), np.cumsum(n[some]) - n[some])
            for other in some[met >= jaccard * (n[one] + n[some] - met) - 1e-9].tolist():
                if label[other] != label[one]:
                    label[label == label[other]] = label[one]
                    edges.append((one, other))
    return edges


def _joined(jaccard: float):
    def work(group: np.ndarray, part: np.ndarray, side: np.ndarray, node: np.ndarray, root: np.ndarray, held: np.ndarray, shingles: np.ndarray) -> pa.RecordBatch:
        ends = [np.empty((0, 2), dtype=np.int64)]
        for a, size in zip(*(c.tolist() for c in _bounds(group, part))):
            of = slice(a, a + size)
            sets = [s.view(np.uint64) for s in shingles[of]]
            found = joining(sets, list(held[of]), side[of], root[of], jaccard)
            ends.append(node[of][np.asarray(found, dtype=np.int64).reshape(-1, 2)])
        found = np.concatenate(ends)
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["u", "v"])

    return whole_runs(2, work)


def _halves(key: str) -> tuple[Column, Column]:
    """Slice of a row, one of ``slices`` by its key, and the pairs of slices that it takes part in."""
    mine = F.pmod(F.xxhash64(key), F.col("slices"))
    return mine, F.transform(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1), lambda j: F.least(mine, j) * F.col("slices") + F.greatest(mine, j))


def checked(pairs: DataFrame, sets_of: Callable[[DataFrame], DataFrame], jaccard: float) -> DataFrame:
    """The pairs (u, v; stored) whose whole sets reach ``jaccard``."""
    sets = cut(sets_of(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()), "sets")
    side = lambda node, name: sets.select(F.col("node").alias(node), F.col("shingles").alias(name))
    both = pairs.join(side("u", "a"), "u").join(side("v", "b"), "v")
    met = both.select("u", "v", F.size(F.array_intersect("a", "b")).alias("met"), (F.size("a") + F.size("b")).alias("total"))
    return cut(met.where(F.col("met") >= F.lit(jaccard) * (F.col("total") - F.col("met")) - 1e-9).select("u", "v"), "links")


def similar_sets(sets: DataFrame, sets_of: Callable[[DataFrame], DataFrame], jaccard: float, known: DataFrame, run: int = RUN, slice_: int = SLICE) -> DataFrame:
    """(u, v): edges that join any two sets (node, shingles; nodes may be repeated) of ``jaccard`` or more into one group.

    ``sets_of`` gives the sets of asked nodes, once each. ``known`` pairs (u, v) are checked with those of the prefixes.
    """
    keyed = postings(sets, jaccard).repartition("shingle").sortWithinPartitions("shingle", "node")
    met = cut(keyed.mapInArrow(_meetings(jaccard, run), "a long, b long, n long"), "met")
    pairs = met.where("n is null").select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(known)
    edges = checked(cut(pairs.distinct(), "pairs"), sets_of, jaccard)
    long_ = met.where("n is not null").select(F.col("a").alias("shingle"), F.col("b").alias("node"), "n")
    if long_.isEmpty():
        return edges
    rooted = long_.join(components(edges), "node", "left").withColumn("root", F.coalesce("root", "node"))
    runs = rooted.groupBy("shingle").agg(F.ceil(F.count("*") / slice_).alias("slices"), F.min("root").alias("least"), F.max("root").alias("most"))
    open_ = cut(rooted.join(runs.where("least <> most").select("shingle", "slices"), "shingle"), "open")
    maps = sets_of(open_.select("node").distinct()).mapInArrow(_bitmaps, "node long, bits binary")
    dealt = open_.join(maps, "node").select("shingle", F.explode(_halves("node")[1]).alias("part"), "node", "n", "root", "bits")
    rows = dealt.repartition("shingle", "part").sortWithinPartitions("shingle", "part", "node")
    near = components(rows.mapInArrow(_across(jaccard), "u long, v long"))
    grouped = cut(near.select("node", F.col("root").alias("group")).unionByName(near.select(F.col("root").alias("node"), F.col("root").alias("group")).distinct()), "grouped")
    sliced = grouped.join(grouped.groupBy("group").agg(F.ceil(F.count("*") / slice_).alias("slices")), "group")
    held = open_.drop("slices").join(sliced, "node").groupBy("group", "slices", "node", "root").agg(F.collect_set("shingle").alias("held"))
    side, parts = _halves("node")
    whole = held.join(sets_of(grouped.select("node")), "node").select("group", F.explode(parts).alias("part"), side.alias("side"), "node", "root", "held", "shingles")
    together = whole.repartition("group", "part").sortWithinPartitions("group", "part", "node")
    return edges.unionByName(cut(together.mapInArrow(_joined(jaccard), "u long, v long").distinct(), "joined"))
