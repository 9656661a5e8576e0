"""Signed feature-hash vectors and scoped dense top-k.

Stored vectors are made inside the partition that a text was dealt to, a few rows at a time: only texts
are shuffled and sorted, features are counted, hashed and summed per bucket in a task's memory.
The dense arm deals the chunks' tokens to cells of their narrowest scope, each chunk once however many
wider scopes are asked, and the questions' vectors to the cells of their scope; cells are of bounded
size on both sides. A cell hashes its distinct words once, scores by one matrix product and gives its
best rows per question. No vector of a chunk is shuffled, none reaches the driver, none is broadcast.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from hashlib import md5
from operator import add, itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions import constants as K, text
from waymark.operators import grouped
from waymark.session import cut

CELL_CHUNKS, CELL_QUESTIONS = 8192, 4096  # about; a cell's scores are matrix products of ``AT_ONCE`` questions
AT_ONCE = 512
USUAL = 24  # a word's pieces up to this place are cut for all words of a cell together
SLICE, BESIDES = 1 << 17, 64  # tokens whose features a task holds at a time, a text counting as some more
WEIGHTS = {"w": 1.0, "b": 0.85, "c": 0.35}
KINDS = np.zeros(256)  # the same by the first byte of a feature
KINDS[[ord(k) for k in WEIGHTS]] = [*WEIGHTS.values()]


def features(tokens: Column) -> Column:
    """Words, neighbouring pairs, and four-letter pieces of words, each with its kind in front."""
    more = F.greatest(F.size(tokens) - 1, F.lit(0))
    words = F.transform(tokens, lambda t: F.concat(F.lit("w:"), t))
    pairs = F.zip_with(F.slice(tokens, F.lit(1), more), F.slice(tokens, F.lit(2), more), lambda a, b: F.concat(F.lit("b:"), a, F.lit("_"), b))
    pieces = F.transform(
        F.filter(tokens, lambda t: F.length(t) > 3),
        lambda t: F.transform(F.sequence(F.lit(1), F.length(t) - 3), lambda i: F.concat(F.lit("c:"), F.substring(t, i, F.lit(4)))),
    )
    return F.concat(words, pairs, F.flatten(pieces))


def weights(rows: DataFrame, keys: list[str], tokens: Column | None = None, deal_by: list[str] | None = None) -> DataFrame:
    """(keys, b, v): bucket and signed weight of every distinct feature; one row with null b where there is none.

    Rows are dealt once, by ``deal_by`` (a part of the keys, or all); every step after that, the cutting
    into ``tokens`` (by default the column of that name) included, stays in its partition.
    """
    dealt = rows.repartition(*(deal_by or keys)).select(*keys, (F.col("tokens") if tokens is None else tokens).alias("tokens"))
    counted = dealt.select(*keys, F.explode_outer(features(F.col("tokens"))).alias("f")).groupBy(*keys, "f").agg(F.count("f").alias("n"))
    h, kind = F.md5("f"), F.substring("f", 1, 1)
    weight = F.when(kind == "w", WEIGHTS["w"]).when(kind == "b", WEIGHTS["b"]).otherwise(WEIGHTS["c"]) * (1 + F.log("n"))
    signed = F.when(F.substring(h, 16, 1) >= "8", weight).otherwise(-weight)
    bucket = (F.conv(F.substring(h, 1, 15), 16, 10).cast("long") % K.EMBED_DIM).cast("int")
    return counted.select(*keys, bucket.alias("b"), F.when(F.col("f").isNotNull(), signed).alias("v"))


def postings(rows: DataFrame, keys: list[str], tokens: Column | None = None, deal_by: list[str] | None = None) -> DataFrame:
    """(keys, b, v): summed weight of every filled bucket; one row with null b where there is no token."""
    return weights(rows, keys, tokens, deal_by).groupBy(*keys, "b").agg(F.sum("v").alias("v"))


def vectors(rows: DataFrame, keys: list[str], tokens: Column | None = None, deal_by: list[str] | None = None) -> DataFrame:
    """(keys, b, v): unit vectors as arrays of filled buckets and their values; empty without tokens.

    Rows of equal keys count as one text. They come sorted by key, and a task holds the features of
    ``SLICE`` tokens or of one row at a time, and the distinct features of the key that is still open.
    """
    dealt = rows.repartition(*(deal_by or keys)).sortWithinPartitions(*keys).select(*keys, (F.col("tokens") if tokens is None else tokens).alias("tokens"))
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema.fields)
    return dealt.mapInArrow(_keyed_vectors(), f"{shape}, b array<int>, v array<double>")


def _keyed_vectors():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(keys: list[tuple], kinds: list, found: np.ndarray) -> pa.RecordBatch:
            at, b = np.nonzero(np.abs(found) > 1e-9)  # what features that cancel leave behind is not filled
            ends = pa.array(np.concatenate(([0], np.cumsum(np.bincount(at, minlength=len(keys))))).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (b.astype(np.int32), found[at, b])]
            return pa.RecordBatch.from_arrays([*[pa.array(c, kind) for c, kind in zip(zip(*keys), kinds)], *lists], [*names, "b", "v"])

        def one(counts: Counter) -> np.ndarray:
            bucket, weight = _weighed(list(counts))
            return _unit(bucket, weight * (1.0 + np.log(np.fromiter(counts.values(), float, len(counts)))), 1)

        key, held, kinds, names = None, None, [], []  # held: features of the last key seen, which may go on
        for batch in batches:
            kinds, names = batch.schema.types[:-1], batch.schema.names[:-1]
            filled = np.cumsum(pc.list_value_length(batch.column(batch.num_columns - 1)).to_numpy(zero_copy_only=False).astype(np.int64) + BESIDES) // SLICE
            cuts = [0, *(np.flatnonzero(np.diff(filled)) + 1).tolist(), batch.num_rows]
            for part in (batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:]) if b > a):
                of = list(zip(*[c.to_pylist() for c in part.columns[:-1]]))
                new = np.asarray([i == 0 or of[i] != of[i - 1] for i in range(len(of))])
                owner, keys = np.cumsum(new) - 1, [of[i] for i in np.flatnonzero(new)]
                who, feature, n, features_ = _counted(part.column(part.num_columns - 1), owner)
                of_run = lambda i: Counter({features_[f]: int(m) for f, m in zip(feature[who == i].tolist(), n[who == i].tolist())})  # noqa: E731, B023
                if held is not None and key != keys[0]:
                    yield told([key], kinds, one(held))
                    held = None
                first = of_run(0) if held is None else held + of_run(0)
                if len(keys) > 1:
                    bucket, weight = _weighed(features_)
                    found = _unit(who * K.EMBED_DIM + bucket[feature], weight[feature] * (1.0 + np.log(n)), len(keys))
                    found[0] = one(first)[0]
                    yield told(keys[:-1], kinds, found[:-1])
                key, held = keys[-1], of_run(len(keys) - 1) if len(keys) > 1 else first
        if held is not None:
            yield told([key], kinds, one(held))

    return run


def cells(index: DataFrame, questions: DataFrame, cell: tuple[int, int] = (CELL_CHUNKS, CELL_QUESTIONS)) -> tuple[DataFrame, DataFrame]:
    """(nr, part, block, chunk, said) and (scope, times, way, nr, parts, blocks): chunks dealt once, and the cells of every asked scope.

    ``times`` tells how often a chunk names the scope, ``way`` numbers a scope and a home of its chunks.
    """
    homes = index.groupBy("scopes").agg(F.count("*").alias("n"))
    asked = questions.groupBy("scope").agg(F.count("*").alias("asked"))
    named = homes.select("scopes", "n", F.explode("scopes").alias("scope")).groupBy("scopes", "n", "scope").agg(F.count("*").alias("times"))
    ways = cut(named.join(asked, "scope").withColumn("way", F.monotonically_increasing_id()), "ways")  # numbers go to the tasks, not names
    sized = ways.groupBy("scopes").agg(F.ceil(F.max("n") / cell[0]).cast("int").alias("parts"), F.ceil(F.sum("asked") / cell[1]).cast("int").alias("blocks"))
    sized = cut(sized.withColumn("nr", F.monotonically_increasing_id()), "cells")
    part = F.pmod(F.xxhash64("chunk"), F.col("parts")).cast("int")
    said = F.array_join("tokens", " ")  # tokens have no spaces; one string is far smaller than an array of them
    members = index.select("chunk", "scopes", said.alias("said")).join(sized, "scopes").select("nr", part.alias("part"), _each("blocks").alias("block"), "chunk", "said")
    return members, ways.join(sized, "scopes").select("scope", "times", "way", "nr", "parts", "blocks")


def _each(n: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(n) - 1))


def dense_top(index: DataFrame, questions: DataFrame, top: int = K.DENSE_POOL, cell: tuple[int, int] = (CELL_CHUNKS, CELL_QUESTIONS)) -> DataFrame:
    """(q, chunk, dense, dense_rank): best ``top`` per question among the chunks of its scope.

    ``index``: chunk, scopes, tokens. ``questions``: q, scope, question.
    """
    key = ["nr", "part", "block"]
    members, ways = cells(index, questions, cell)
    asked = vectors(questions.select("q", "question"), ["q"], text.tokens(F.col("question"))).join(questions.select("q", "scope"), "q").join(ways, "scope").select(
        "q", "way", "times", F.col("nr").alias("nr"), _each("parts").alias("part"), F.pmod(F.xxhash64("q"), F.col("blocks")).cast("int").alias("block"), "b", "v"
    )
    best = members.groupBy(*key).cogroup(asked.groupBy(*key)).applyInPandas(_scoring(top), "q bigint, chunk bigint, dense double")
    return grouped.top_n(best, ["q"], [F.desc("dense"), F.col("chunk")], top, "dense_rank")


def _unit(place: np.ndarray, values: np.ndarray, rows: int) -> np.ndarray:
    """Rows of unit length from values at flat places; all-zero rows stay so."""
    out = np.bincount(place, values, minlength=rows * K.EMBED_DIM).reshape(rows, K.EMBED_DIM)
    norms = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return np.divide(out, norms, out=np.zeros(out.shape), where=norms > 0)


def _counted(lists: pa.ListArray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """(owner, number of a feature, count, features) of token lists and their owners: a list's features are its own, an owner's are counted together."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().dictionary_encode()
    words, code = flat.dictionary.to_pylist(), flat.indices.to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(lists)), sizes)
    many = np.maximum(pc.utf8_length(flat.dictionary).to_numpy().astype(np.int64) - 3, 0)
    start, of = np.cumsum(many) - many, np.repeat(np.arange(len(words)), many)
    shift = np.arange(len(of)) - start[of]
    cut_up, slots = [pa.array([], pa.string())], [np.empty(0, np.int64)]
    for i in range(min(USUAL, shift.max(initial=-1) + 1)):
        slots.append(np.flatnonzero(shift == i))
        cut_up.append(pc.utf8_slice_codeunits(flat.dictionary.take(pa.array(of[slots[-1]])), i, i + 4))
    slots.append(np.flatnonzero(shift >= USUAL))
    cut_up.append(pa.array([words[w][i:i + 4] for w, i in zip(of[slots[-1]].tolist(), shift[slots[-1]].tolist())], pa.string()))
    cut_up = pa.concat_arrays(cut_up).dictionary_encode()
    pieces = np.empty(len(of), dtype=np.int64)
    pieces[np.concatenate(slots)] = cut_up.indices.to_numpy()
    taken = many[code]
    at = np.repeat(start[code] - (np.cumsum(taken) - taken), taken) + np.arange(taken.sum())
    inside = row[1:] == row[:-1]
    pairs, pair = np.unique(code[:-1][inside] * len(words) + code[1:][inside], return_inverse=True)
    said = [w.encode() for w in words]
    before = [b"b:" + w + b"_" for w in said]
    ahead, after = ((x.tolist() for x in divmod(pairs, len(words))) if len(pairs) else ([], []))
    names = [b"w:" + w for w in said] + [b"c:" + p.encode() for p in cut_up.dictionary.to_pylist()]
    alone = len(names)
    names += map(add, map(before.__getitem__, ahead), map(said.__getitem__, after))
    kinds = max(1, len(names))
    owner = own[row]
    feature = np.concatenate((code, len(words) + pieces[at], alone + pair))
    cells, counts = np.unique(np.concatenate((owner, np.repeat(owner, taken), owner[:-1][inside])) * kinds + feature, return_counts=True)
    return cells // kinds, cells % kinds, counts, names


def _weighed(names: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and signed weight of every feature: of its md5 the first 15 hex digits, and the 16th."""
    h = np.frombuffer(b"".join([md5(n).digest() for n in names]), dtype=">u8")[::2].astype(np.uint64)
    weight = KINDS[np.fromiter(map(itemgetter(0), names), dtype=np.uint8, count=len(names))]
    return ((h >> np.uint64(4)) % np.uint64(K.EMBED_DIM)).astype(np.int64), np.where(h & np.uint64(8), weight, -weight)


def text_vectors(lists: pa.ListArray | list) -> np.ndarray:
    """The vectors of a cell's token lists: distinct words, pairs and pieces are hashed once each."""
    if isinstance(lists, list):
        ends = np.cumsum([0, *map(len, lists)])
        flat = np.concatenate([np.asarray(x, dtype=object) for x in lists]) if ends[-1] else []
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.string()))
    who, feature, n, names = _counted(lists, np.arange(len(lists)))
    bucket, weight = _weighed(names)
    return _unit(who * K.EMBED_DIM + bucket[feature], weight[feature] * (1.0 + np.log(n)), len(lists))


def _scoring(top: int):
    def filled(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Questions, how often they take a chunk, and their vectors, all-zero where a text has no tokens."""
        q, way, times = (rows[c].to_numpy() for c in ("q", "way", "times"))
        order = np.lexsort((way, q))
        first = order[np.concatenate(([True], (np.diff(q[order]) != 0) | (np.diff(way[order]) != 0)))]
        b, v = (rows[c].to_numpy()[first] for c in ("b", "v"))
        own = np.zeros((len(first), K.EMBED_DIM))
        own[np.repeat(np.arange(len(first)), [len(x) for x in b]), np.concatenate(b).astype(np.int64)] = np.concatenate(v)
        return q[first], times[first], own

    def unit(said: pd.Series) -> np.ndarray:
        out, some = np.zeros((len(said), K.EMBED_DIM)), (said != "").to_numpy()
        if some.any():
            out[some] = text_vectors(pc.split_pattern(pa.array(said[some], pa.string()), " "))
        return out

    def score(chunks: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(chunks) or not len(asked):
            return pd.DataFrame({"q": [], "chunk": [], "dense": []}).astype({"q": "int64", "chunk": "int64", "dense": "float64"})
        chunks = chunks.sort_values("chunk")
        ids, (qs, times, own), held = chunks["chunk"].to_numpy(), filled(asked), unit(chunks["said"]).T
        found = []
        for i in range(0, len(qs), AT_ONCE):
            rounded = np.round(own[i:i + AT_ONCE] @ held + 1e-9, 9)
            order = [np.repeat(np.argsort(-row, kind="stable")[:top], n)[:top] for row, n in zip(rounded, times[i:])]  # ids ascend, so ties go to the smaller
            found.append((np.repeat(qs[i:i + AT_ONCE], [len(o) for o in order]), ids[np.concatenate(order)], np.concatenate([row[o] for row, o in zip(rounded, order)])))
        return pd.DataFrame(dict(zip(("q", "chunk", "dense"), map(np.concatenate, zip(*found)))))

    return score


def pair_scores(pairs: DataFrame, keys: list[str], left: Column, right: Column, name: str = "dense") -> DataFrame:
    """``pairs`` with the dense score of two texts; for the few rows that reach an answer."""
    sides = pairs.select(*keys, F.inline(F.array(*[F.struct(F.lit(i).alias("side"), c.alias("said")) for i, c in enumerate((left, right))])))
    found = postings(sides, [*keys, "side"], text.tokens(F.col("said")), deal_by=keys)
    of = lambda side: F.coalesce(F.sum(F.when(F.col("side") == side, F.col("v"))), F.lit(0.0))
    both = found.groupBy(*keys, "b").agg(of(0).alias("x"), of(1).alias("y"))
    dot = F.coalesce(F.try_divide(F.sum(F.col("x") * F.col("y")), F.sqrt(F.sum(F.col("x") * F.col("x")) * F.sum(F.col("y") * F.col("y")))), F.lit(0.0))
    return pairs.join(both.groupBy(*keys).agg(F.round(dot + 1e-9, 9).alias(name)), keys)
