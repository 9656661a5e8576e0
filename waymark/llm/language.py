"""Language identification by a linear-chain conditional random field over words.

Every word of letters gets features: character n-grams of the word with its borders (so that the
ones at a border are its affixes) and, for common words, an entry of a learned lexicon. Weights of
features and of transitions between languages are trained together by the likelihood of label
sequences; a share of the training sequences is spliced from two texts of different languages, so
that transitions learn what a switch looks like. For a text, forward-backward gives each word's
probabilities; the text takes the language of the largest sum, and its share as score.

The model is fitted on a bounded sample: ``Fit.per_language`` labelled documents of each language,
the ``Fit.languages`` most frequent ones, of at most ``Fit.longest`` characters each. Prediction
covers whole texts of any length.

Edge cases: a null text or one without letters is ``und`` with score 0; so is every text if nothing
is labelled; null languages are never learned; repeated rows are predicted one by one; an empty
table gives an empty result; other columns play no part in a prediction.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.llm.common import free_name

LETTERS = re.compile(r"[^\W\d_]+")
ORDERS = (1, 2, 3, 4)
TABLE = 1 << 17
AT_ONCE = 400_000  # words labelled together
REMEMBERED = 100_000


@dataclass(frozen=True)
class Fit:
    per_language: int = 300
    languages: int = 64
    longest: int = 200_000
    lexicon: int = 5000
    window: int = 24  # words in a training sequence; all words of a sampled text are used
    epochs: int = 2
    batch: int = 256
    spliced: float = 0.3
    rate: float = 0.25
    seed: int = 7


@dataclass
class Model:
    labels: list[str]
    lexicon: dict[str, int]
    weights: np.ndarray  # (TABLE + lexicon + 1, labels); the last row is unused and zero
    moves: np.ndarray  # (labels, labels)

    def features(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Feature numbers of words, one word after another, and where each word's begin."""
        none = len(self.weights) - 1
        codes = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
        lengths = np.fromiter((len(w) + 2 for w in words), dtype=np.int64, count=len(words))
        ends = np.repeat(np.cumsum(lengths), lengths)
        at = np.arange(len(codes))
        grid = np.full((len(codes), len(ORDERS)), none, dtype=np.int64)
        value = np.zeros(len(codes), dtype=np.uint64)
        for k, n in enumerate(ORDERS):
            shifted = np.zeros(len(codes), dtype=np.uint64)
            shifted[: max(0, len(codes) - n + 1)] = codes[n - 1:]
            value = (value + shifted + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            value ^= value >> np.uint64(29)
            fits = at + n <= ends
            grid[fits, k] = (value[fits] >> np.uint64(20)) % np.uint64(TABLE)
        starts = np.cumsum(lengths) - lengths
        # a word's first border stands alone as an n-gram of one, which says nothing: its place holds the lexicon entry
        grid[starts, 0] = [TABLE + self.lexicon[w] if w in self.lexicon else none for w in words]
        return grid.ravel(), starts * len(ORDERS)

    def emissions(self, words: list[str]) -> np.ndarray:
        numbers, starts = self.features(words)
        return np.add.reduceat(self.weights[numbers], starts, axis=0) if words else np.empty((0, len(self.labels)))


def marginals(scores: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Forward-backward over sequences laid end to end: probabilities of labels at each place."""
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    t = np.exp(moves)
    starts = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    starts, longest = starts[order], lengths[order]
    active = np.searchsorted(-longest, -np.arange(int(longest.max(initial=0))), side="left")  # sequences longer than each step
    alpha, beta = np.empty_like(e), np.ones_like(e)
    for i, n in enumerate(active):
        at = starts[:n] + i
        a = e[at] if i == 0 else (alpha[at - 1] @ t) * e[at]
        alpha[at] = a / a.sum(axis=1, keepdims=True)
    for i in range(len(active) - 2, -1, -1):
        at = starts[: active[i + 1]] + i
        b = (beta[at + 1] * e[at + 1]) @ t.T
        beta[at] = b / b.sum(axis=1, keepdims=True)
    p = alpha * beta
    return p / p.sum(axis=1, keepdims=True)


def _pairwise(scores: np.ndarray, moves: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Marginals and expected transitions of sequences of equal length ``n``: (sequences * n, labels) scores."""
    k = scores.shape[1]
    e = np.exp(scores - scores.max(axis=1, keepdims=True)).reshape(-1, n, k)
    t = np.exp(moves)
    alpha, beta = np.empty_like(e), np.ones_like(e)
    for i in range(n):
        a = e[:, 0] if i == 0 else (alpha[:, i - 1] @ t) * e[:, i]
        alpha[:, i] = a / a.sum(axis=1, keepdims=True)
    for i in range(n - 2, -1, -1):
        b = (beta[:, i + 1] * e[:, i + 1]) @ t.T
        beta[:, i] = b / b.sum(axis=1, keepdims=True)
    p = alpha * beta
    pairs = np.einsum("sia,sib->siab", alpha[:, :-1], beta[:, 1:] * e[:, 1:]) * t
    pairs /= pairs.sum(axis=(2, 3), keepdims=True)
    return (p / p.sum(axis=2, keepdims=True)).reshape(-1, k), pairs.sum(axis=(0, 1))


def words_of(text: str | None) -> list[str]:
    return LETTERS.findall((text or "").lower())


def train(texts: list[tuple[str, str]], fit: Fit = Fit()) -> Model:
    """Fits the field to (text, language) rows."""
    rng = np.random.default_rng(fit.seed)
    labels = sorted({lang for _, lang in texts})
    number = {lang: i for i, lang in enumerate(labels)}
    tokens = [(words_of(t), number[lang]) for t, lang in texts]
    common = Counter(w for ws, _ in tokens for w in ws).most_common(fit.lexicon)
    lexicon = {w: i for i, (w, n) in enumerate(common) if n > 1}
    k = len(labels)
    model = Model(labels, lexicon, np.zeros((TABLE + len(lexicon) + 1, k)), np.zeros((k, k)))
    windows = [(ws[i:i + fit.window], y) for ws, y in tokens for i in range(0, len(ws) - fit.window + 1, fit.window)]
    # short texts and ends of texts are repeated to the length of a window
    windows += [((tail * fit.window)[: fit.window], y) for ws, y in tokens if (tail := ws[len(ws) // fit.window * fit.window:])]
    if not windows:
        return model
    square_w, square_m = np.full(len(model.weights), 1e-8), np.full((k, k), 1e-8)
    half = fit.window // 2
    for _ in range(fit.epochs):
        for at in np.array_split(rng.permutation(len(windows)), max(1, len(windows) // fit.batch)):
            other = rng.permutation(at)
            words, truth = [], []
            for i, j in zip(at.tolist(), other.tolist()):
                (a, y), (b, z) = windows[i], windows[j]
                if rng.random() < fit.spliced:
                    words += a[:half] + b[half:]
                    truth += [y] * half + [z] * (fit.window - half)
                else:
                    words += a
                    truth += [y] * fit.window
            truth = np.asarray(truth)
            distinct, back = np.unique(np.asarray(words, dtype=object).astype(str), return_inverse=True)
            numbers, starts = model.features(distinct.tolist())
            scores = np.add.reduceat(model.weights[numbers], starts, axis=0)[back]
            p, pairs = _pairwise(scores, model.moves, fit.window)
            p[np.arange(len(truth)), truth] -= 1.0
            t = truth.reshape(-1, fit.window)
            np.subtract.at(pairs, (t[:, :-1].ravel(), t[:, 1:].ravel()), 1.0)
            by_word = np.zeros((len(distinct), k))
            np.add.at(by_word, back, p)
            sizes = np.diff(np.append(starts, len(numbers)))
            spread = np.repeat(np.arange(len(distinct)), sizes)
            used, slot = np.unique(numbers, return_inverse=True)
            g = np.stack([np.bincount(slot, weights=by_word[spread, c], minlength=len(used)) for c in range(k)], axis=1) / len(at)
            square_w[used] += (g * g).sum(axis=1)
            model.weights[used] -= fit.rate * g / np.sqrt(square_w[used])[:, None]
            model.weights[-1] = 0.0
            pairs /= len(at)
            square_m += pairs * pairs
            model.moves -= fit.rate * 0.2 * pairs / np.sqrt(square_m)
    model.weights = model.weights.astype(np.float32)
    return model


def label_texts(texts: list[str | None], model: Model, memory: dict[str, int], rows: list[np.ndarray]) -> list[tuple[str, float, int]]:
    """(language, score, switches) of texts; ``memory`` and ``rows`` keep emissions of words already seen."""
    tokens = [words_of(t) for t in texts]
    if len(memory) > REMEMBERED:
        memory.clear()
        rows.clear()
    new = list({w for ws in tokens for w in ws} - memory.keys())
    if new:
        first = sum(map(len, rows))
        rows.append(model.emissions(new))
        memory.update(zip(new, range(first, first + len(new))))
    table = rows[0] if len(rows) == 1 else np.concatenate(rows) if rows else np.empty((0, len(model.labels)))
    rows[:] = [table]
    lengths = np.asarray([len(ws) for ws in tokens], dtype=np.int64)
    out: list[tuple[str, float, int]] = [("und", 0.0, 0)] * len(texts)
    full = np.flatnonzero(lengths)
    parts = np.cumsum(lengths[full]) // AT_ONCE
    for part in np.unique(parts):
        at = full[parts == part]
        places = np.fromiter((memory[w] for i in at for w in tokens[i]), dtype=np.int64, count=int(lengths[at].sum()))
        p = marginals(table[places].astype(np.float64), lengths[at], model.moves)
        starts = np.cumsum(lengths[at]) - lengths[at]
        shares = np.add.reduceat(p, starts, axis=0) / lengths[at][:, None]
        best = p.argmax(axis=1)
        turned = np.append(best[1:] != best[:-1], False)
        turned[starts[1:] - 1] = False
        switches = np.add.reduceat(turned.astype(np.int64), starts)
        for i, s, n in zip(at.tolist(), shares, switches.tolist()):
            out[i] = (model.labels[int(s.argmax())], float(min(1.0, s.max())), n)
    return out


def _predicting(shared, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[str, int] = {}
        rows: list[np.ndarray] = []
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            got = label_texts(texts, shared.value, memory, rows) if shared.value.labels else [("und", 0.0, 0)] * len(texts)
            columns = list(zip(*got)) or [[], [], []]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(columns[0], pa.string()), pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.int64())],
                names=names,
            )

    return run


def sample(rows: DataFrame, fit: Fit, doc_id: str, text: str, lang: str) -> list[tuple[str, str]]:
    """The bounded training sample: documents with the smallest hashes of their ids, by language."""
    usable = rows.where(F.col(f"`{lang}`").isNotNull() & F.col(f"`{text}`").rlike(r"\p{L}") & (F.length(f"`{text}`") <= fit.longest)).select(
        F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text"), F.pmod(F.xxhash64(f"`{doc_id}`", F.lit(fit.seed)), F.lit(1 << 30)).alias("at")
    )
    sizes = usable.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(fit.languages).collect()
    if not sizes:
        return []
    below = F.lit(-1)
    for r in sizes:
        below = F.when(F.col("lang") == r["lang"], F.lit(int(min(1.0, 1.1 * fit.per_language / r["n"]) * (1 << 30)))).otherwise(below)
    taken = usable.where(F.col("at") < below).select("lang", "text", "at")
    by: dict[str, list[tuple[int, str]]] = {}
    for r in taken.toLocalIterator():
        by.setdefault(r["lang"], []).append((r["at"], r["text"]))
    return [(t, lang) for lang in sorted(by) for _, t in sorted(by[lang])[: fit.per_language]]


def identify(docs: DataFrame, learn_from: Column, keep: dict[str, Column], doc_id: str = "doc_id", text: str = "text", lang: str = "lang", fit: Fit = Fit()) -> DataFrame:
    """``keep`` columns with lang_pred, score and n_switches for every row; learns from rows where ``learn_from`` holds."""
    model = train(sample(docs.where(learn_from), fit, doc_id, text, lang), fit)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a table of fixed size: 2 MB, and a bounded lexicon
    rows = docs.select(*[c.alias(n) for n, c in keep.items()], F.col(f"`{text}`").cast("string").alias(free_name(docs, "_body")))
    kinds = {"lang_pred": T.StringType(), "score": T.DoubleType(), "n_switches": T.LongType()}
    schema = T.StructType([*rows.schema.fields[:-1], *[T.StructField(free_name(rows, n), t) for n, t in kinds.items()]])
    return rows.mapInArrow(_predicting(shared, schema.names), schema)
