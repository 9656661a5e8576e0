"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard has many points (virtual nodes) on a ring of 60 bits, and a document's id has one. A
document belongs to the first shard point at or clockwise of its own; where that shard has no seat
left, it goes on clockwise to the next shard that has one. Seats are given in ring order, from
point 0 on, so the outcome is that of inserting the documents one by one in that order. Seats are
as many as documents (``slack`` 0), which keeps the shards' counts within one of each other, and
only what overflows leaves its first shard.

The documents between two virtual nodes (an *arc*) all see the shards in the same order, so the
walk needs only the number of documents of every arc: at most ``shards * replicas + 1`` numbers go
to the driver, whatever the input. What comes back is a table of segments of the ring order; a
document finds its segment by its arc and its place in the ring order. Documents are numbered by
range partitions, so no key, hot or not, is brought together.

Edge cases: a null id is a key of its own; a null text has no bytes (size 1, checksum 0); rows
that share an id share a point and are seated by checksum and size, equal rows one by one; an empty
table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from hashlib import md5

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.common import cut, numbered, text_or_empty

BITS = 60
CELL_BITS = 12  # arcs are looked up by the leading bits of a point


@dataclass(frozen=True)
class Ring:
    shards: int = 16
    replicas: int = 128  # virtual nodes of a shard
    slack: float = 0.0  # seats beyond an equal share, as a part of it

    def nodes(self) -> list[tuple[int, int]]:
        """(point, shard) of every virtual node, clockwise."""
        return sorted((int(md5(f"{s}/{r}".encode()).hexdigest()[: BITS // 4], 16), s) for s in range(self.shards) for r in range(self.replicas))

    def seats(self, documents: int) -> list[int]:
        """Seats of every shard for so many documents."""
        if self.slack:
            return [-(-int(documents * (1 + self.slack)) // self.shards) + 1] * self.shards
        return [documents // self.shards + (s < documents % self.shards) for s in range(self.shards)]


def ring_point(key: Column) -> Column:
    """Place of a key on the ring."""
    return F.conv(F.substring(F.md5(key), 1, BITS // 4), 16, 10).cast("long")


def walk(counts: dict[int, int], nodes: list[tuple[int, int]], seats: list[int]) -> list[dict]:
    """Segments of the ring order: where each begins, its shard, and the seat its first document takes.

    ``counts`` has the documents of every arc; arc ``len(nodes)`` lies beyond the last virtual node
    and belongs to the first. A segment ends with its arc or with its shard's last seat.
    """
    used, out, at = [0] * len(seats), [], 0
    for arc in sorted(counts):
        left, step = counts[arc], 0
        while left:
            shard = nodes[(arc + step) % len(nodes)][1]
            taken = min(left, seats[shard] - used[shard])
            if taken > 0:
                out.append({"arc": arc, "begin": at, "shard": shard, "seat": used[shard]})
                used[shard], at, left = used[shard] + taken, at + taken, left - taken
            step += 1
    return out


def _literal_rows(spark: SparkSession, rows: list[dict], kind: str) -> DataFrame:
    """A few rows as one constant."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{kind}>>")))


def _arcs_by_cell(spark: SparkSession, nodes: list[tuple[int, int]]) -> DataFrame:
    """(cell, arcs): for every value of the leading bits, the virtual nodes there and the next one."""
    width, cells, at = 1 << (BITS - CELL_BITS), [], 0
    ends = [p for p, _ in nodes] + [1 << BITS]
    for cell in range(1 << CELL_BITS):
        while ends[at] < cell * width:
            at += 1
        last = at
        while ends[last] < (cell + 1) * width:
            last += 1
        cells.append({"cell": cell, "arcs": [{"point": ends[i], "arc": i} for i in range(at, last + 1)]})
    return _literal_rows(spark, cells, "cell: bigint, arcs: array<struct<point: bigint, arc: int>>")


def assign(docs: DataFrame, ring: Ring = Ring(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, home_shard, shard, slot) of every document.

    ``home_shard`` is where it would be on a ring without bounds. The two tables that are broadcast
    have at most 2^12 rows, and ``shards * (replicas + 1) + 1`` segments, by construction.
    """
    spark = docs.sparkSession
    nodes = ring.nodes()
    body = text_or_empty(f"`{text}`")
    rows = docs.select(
        F.col(f"`{doc_id}`").cast("long").alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32")
    ).withColumn("point", ring_point(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    placed = rows.withColumn("cell", F.shiftright("point", BITS - CELL_BITS)).join(F.broadcast(_arcs_by_cell(spark, nodes)), "cell")
    arc = F.element_at(F.filter("arcs", lambda a: a["point"] >= F.col("point")), 1)["arc"]
    keyed = cut(placed.select("doc_id", "size", "text_crc32", "point", arc.alias("arc")), "ring")
    counts = {r["arc"]: r["n"] for r in keyed.groupBy("arc").agg(F.count("*").alias("n")).collect()}  # an arc a row
    segments = walk(counts, nodes, ring.seats(sum(counts.values())))
    by_arc: dict[int, dict] = {}
    for s in segments:
        home = nodes[s["arc"] % len(nodes)][1]
        by_arc.setdefault(s["arc"], {"arc": s["arc"], "home_shard": home, "segments": []})["segments"].append({k: s[k] for k in ("begin", "shard", "seat")})
    table = _literal_rows(spark, list(by_arc.values()), "arc: int, home_shard: int, segments: array<struct<`begin`: bigint, shard: int, seat: bigint>>")
    order = numbered(keyed, [], [F.col(c) for c in ("point", "doc_id", "text_crc32", "size")], "at")
    own = F.element_at(F.filter("segments", lambda s: s["begin"] <= F.col("at")), -1)
    return order.join(F.broadcast(table), "arc").withColumn("s", own).select(
        "doc_id", "size", "text_crc32", "home_shard", F.col("s.shard").alias("shard"), (F.col("s.seat") + F.col("at") - F.col("s.begin")).alias("slot")
    )
