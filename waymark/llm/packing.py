"""Best-fit packing into bins of several permitted lengths.

Documents become pieces of at most the largest length. Pieces are dealt to shards of a few
thousand by hash, whatever their source, and each shard packs on its own: longest piece first,
into the open bin that it leaves fullest; if none has room, the bin size with the least cost for
each token it can still be expected to hold is opened. At the end every bin shrinks to the
cheapest permitted size that holds its contents. Shards grow in number with the input, not in
size, and waste at most a part of one bin each.

Edge cases: a null or empty text is one piece of no tokens, which still takes its separator; very
long texts are cut between words into pieces of whole words, nothing is dropped; ties go to the
smaller id, then the earlier piece, then the older bin; repeated rows are packed one by one; an
empty table gives no bins; other columns of the input play no part.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import cut

RESULT = "shard long, bin int, bin_size int, slot int, offset int, doc_id long, piece long, start long, length long"


@dataclass(frozen=True)
class Sizes:
    lengths: tuple[int, ...] = (1024, 2048, 4096, 8192)
    overhead: int = 64  # cost of a sequence besides its tokens
    separator: int = 1  # tokens that every piece needs besides its own
    shard_pieces: int = 2048

    def cost(self, length: int) -> int:
        return length + self.overhead

    @property
    def longest(self) -> int:
        return max(self.lengths)

    def opened(self, need: int, left: int) -> int:
        """Size to open for a piece of ``need`` while ``left`` tokens, its own included, are unplaced."""
        fits = [c for c in self.lengths if c >= need]
        return min(fits, key=lambda c: (self.cost(c) / min(c, left), c))

    def shrunk(self, held: int) -> int:
        return min((c for c in self.lengths if c >= held), key=lambda c: (self.cost(c), c))


def best_fit(needs: list[int], sizes: Sizes) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each piece (given longest first), and the final size of each bin."""
    room: list[tuple[int, int]] = []  # (free tokens, bin), sorted
    held: list[int] = []
    cap: list[int] = []
    bins, offsets, left = [], [], sum(needs)
    for need in needs:
        at = bisect_left(room, (need, -1))
        if at == len(room):
            b = len(held)
            held.append(0)
            cap.append(sizes.opened(need, left))
        else:
            b = room.pop(at)[1]
        bins.append(b)
        offsets.append(held[b])
        held[b] += need
        left -= need
        insort(room, (cap[b] - held[b], b))
    return bins, offsets, [sizes.shrunk(h) for h in held]


def pieces(docs: DataFrame, doc_id: str, tokens: Column, sizes: Sizes) -> DataFrame:
    """(doc_id, piece, start, length): whole texts as runs of at most the largest length."""
    room = sizes.longest - sizes.separator
    counted = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), tokens.cast("long").alias("_n"))
    parts = F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("_n") / room) - 1, F.lit(0)).cast("long"))
    return counted.select("doc_id", "_n", F.explode(parts).alias("piece")).select(
        "doc_id", "piece", (F.col("piece") * room).alias("start"), F.least(F.lit(room).cast("long"), F.col("_n") - F.col("piece") * room).alias("length")
    )


def pack(docs: DataFrame, tokens: Column, sizes: Sizes = Sizes(), doc_id: str = "doc_id") -> DataFrame:
    """One row per piece with its shard, bin, bin size, place in the bin and span in its document."""
    stored = cut(pieces(docs, doc_id, tokens, sizes), "pieces")
    shards = max(1, math.ceil(stored.count() / sizes.shard_pieces))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(need=pdf["length"] + sizes.separator).sort_values(["need", "doc_id", "piece", "start"], ascending=[False, True, True, True], kind="stable")
        bins, offsets, final = best_fit(pdf["need"].tolist(), sizes)
        pdf = pdf.assign(bin=bins, offset=offsets, bin_size=np.asarray(final, dtype="int32")[bins])
        pdf["slot"] = pdf.groupby("bin").cumcount()
        return pdf[["shard", "bin", "bin_size", "slot", "offset", "doc_id", "piece", "start", "length"]]

    dealt = stored.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "length"), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(run, RESULT)
