"""Token counts by a linear longest-match automaton.

The vocabulary is a trie over bytes. A node that cannot go on has a failure link: the node reached
after the greedy longest pieces at its front are split off, and the number of those pieces is
precomputed ("popped"). Reading a word follows edges and failure links only, so its greedy
word-piece count comes out in time linear in its bytes, and no piece is ever built. All distinct
words of a batch move through the automaton together, one byte a step.

A word is a run of characters other than ASCII white space, matched with a leading space, as byte
vocabularies have it. Where no piece fits, one byte is split off and counts as one token, so no
text is out of reach.

Edge cases: a null or empty text has no words and no tokens; words and texts may have any length;
repeated rows count one by one; an empty table gives an empty result; other columns are passed on
by the general form and ignored by the count.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.llm.common import free_name

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
STEPS = 64  # longer words go through the automaton one at a time


@dataclass(frozen=True)
class Automaton:
    """Edges as sorted keys (node * 256 + byte) with their targets; links, popped counts, closing counts."""

    keys: np.ndarray
    targets: np.ndarray
    link: np.ndarray
    popped: np.ndarray
    closing: np.ndarray

    @classmethod
    def of(cls, vocabulary: Iterable[bytes]) -> Automaton:
        pieces = {bytes([b]) for b in range(256)} | {p for p in vocabulary if p}
        children: list[dict[int, int]] = [{}]
        whole, parent, via, order = [False], [0], [0], []
        for piece in sorted(pieces):
            node = 0
            for b in piece:
                nxt = children[node].get(b)
                if nxt is None:
                    nxt = len(children)
                    children.append({})
                    whole.append(False)
                    parent.append(node)
                    via.append(b)
                    children[node][b] = nxt
                node = nxt
            whole[node] = True
        level = list(children[0].values())
        while level:  # breadth first: a node's link is shallower than the node
            order += level
            level = [c for n in level for c in children[n].values()]
        link, popped, closing = [0] * len(children), [0] * len(children), [0] * len(children)
        for node in order:
            if whole[node]:
                link[node], popped[node] = 0, 1
            else:
                b, at, n = via[node], link[parent[node]], popped[parent[node]]
                while b not in children[at]:  # the root has every byte
                    n += popped[at]
                    at = link[at]
                link[node], popped[node] = children[at][b], n
            closing[node] = popped[node] + closing[link[node]]
        edges = sorted((node << 8 | b, to) for node, kids in enumerate(children) for b, to in kids.items())
        keys, targets = (np.asarray(c, dtype=np.int64) for c in zip(*edges))
        return cls(keys, targets, *(np.asarray(c, dtype=np.int64) for c in (link, popped, closing)))

    def step(self, state: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states of many words, and the pieces each one splits off on the way."""
        state, split = state.copy(), np.zeros(len(state), dtype=np.int64)
        todo = np.arange(len(state))
        while len(todo):
            key = state[todo] << 8 | byte[todo]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            state[todo[hit]] = self.targets[at[hit]]
            todo = todo[~hit]
            split[todo] += self.popped[state[todo]]
            state[todo] = self.link[state[todo]]
        return state, split

    def count(self, words: list[bytes]) -> np.ndarray:
        """Greedy piece counts of words."""
        lengths = np.asarray([len(w) for w in words], dtype=np.int64)
        out, state = np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int64)
        flat = np.frombuffer(b"".join(words), dtype=np.uint8).astype(np.int64)
        starts = np.cumsum(lengths) - lengths
        short = lengths <= STEPS
        for i in range(int(lengths[short].max(initial=0))):
            at = np.flatnonzero(short & (lengths > i))
            state[at], split = self.step(state[at], flat[starts[at] + i])
            out[at] += split
        for w in np.flatnonzero(~short):
            state[w], out[w] = self._one(words[w])
        return out + self.closing[state]

    def _one(self, word: bytes) -> tuple[int, int]:
        node, n = 0, 0
        keys, targets, link, popped = self.keys, self.targets, self.link, self.popped
        for b in word:
            while True:
                key = int(node) << 8 | b
                at = int(keys.searchsorted(key))
                if at < len(keys) and keys[at] == key:
                    node = targets[at]
                    break
                n += int(popped[node])
                node = link[node]
        return int(node), n


def read_vocabulary(path: str = VOCABULARY) -> list[bytes]:
    """Pieces of a rank file: one base64 piece and its rank a line."""
    with open(path, "rb") as lines:
        return [base64.b64decode(line.split()[0]) for line in lines if line.strip()]


def _counting(shared, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value
        memory: dict[bytes, int] = {}
        for batch in batches:
            split = [(t or "").encode().split() for t in batch.column(batch.num_columns - 1).to_pylist()]
            new = list({w for ws in split for w in ws} - memory.keys())
            memory.update(zip(new, automaton.count([b" " + w for w in new]).tolist()))
            words, tokens = [len(ws) for ws in split], [sum(map(memory.__getitem__, ws)) for ws in split]
            if len(memory) > 200_000:  # words come back, but the table must not grow with the input
                memory.clear()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=names
            )

    return run


def count_tokens(docs: DataFrame, keep: list[str], text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``keep`` columns with ``n_words`` and ``n_tokens``. No shuffle; the automaton is broadcast (a few MB)."""
    shared = docs.sparkSession.sparkContext.broadcast(Automaton.of(read_vocabulary(vocabulary)))
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias(free_name(docs, "_body")))
    added = [free_name(rows, n) for n in ("n_words", "n_tokens")]
    schema = T.StructType([*rows.schema.fields[:-1], *[T.StructField(n, T.LongType()) for n in added]])
    return rows.mapInArrow(_counting(shared, schema.names), schema)
