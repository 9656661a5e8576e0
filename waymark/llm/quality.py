"""Quality rules whose cutoffs come from the corpus: fences read off mergeable quantile sketches.

Each document gets counts and rates. A rate's sketch is a histogram over logarithmic bins, so
sketches of tasks, sources and languages merge by adding counts, give the same bins whatever the
merge order, and hold a bounded number of bins. A (language, source) is judged by its own sketch
blended with its language's, which is blended with that of everything, each as a fixed number of
documents: no size switches between them, and a small source is judged like its language. A fence
lies beyond a high (or low) quantile of the blend, by a multiple of that quantile's distance from the
median. The fences are joined back and documents outside them are rejected.

Edge cases: a null text counts as empty (no words, base rule fails); null language and source are
groups of their own; repeated rows are judged one by one; an empty table gives an empty result;
input columns keep their names, and measured columns whose names are taken get leading underscores.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from waymark.llm.common import GAP, WORD, cut, free_name, text_or_empty

SYMBOLS = "[^#*$%&|<>]+"
BINS_PER_E = 24  # a bin spans 4.3 %
LOWEST = -12.0  # rates below exp(-12), zero included, share the lowest bin


@dataclass(frozen=True)
class Fence:
    """A rate is an outlier beyond a high (or low) quantile by ``reach`` times that quantile's distance from the median.

    ``spare`` occurrences more are allowed to every document, so that a rate which is zero nearly
    everywhere does not turn single characters into outliers.
    """

    rate: str
    quantile: float
    reach: float
    spare: int = 0


@dataclass(frozen=True)
class Rules:
    min_words: int = 50
    max_repeat_percent: int = 50
    prior: int = 200  # documents that the language's sketch counts for in a source's, and that of all in a language's
    fences: tuple[Fence, ...] = field(default=(
        Fence("word_length", 0.9, 3.0),
        Fence("word_length", 0.1, 3.0),
        Fence("symbol_rate", 0.9, 3.0, spare=5),
        Fence("mark_rate", 0.9, 3.0, spare=5),
        Fence("upper_share", 0.99, 1.0, spare=5),
        Fence("line_share", 0.99, 1.0, spare=2),
        Fence("repeat_share", 0.99, 1.0, spare=5),
    ))


def _words_and_repeats(body: str) -> Column:
    """Number of words, and of positions covered by 3-word windows that occur twice or more.

    Window hashes without a repeat end here; else (hash, position) pairs are sorted, those with an
    equal neighbour kept, and the covered positions summed along the sorted positions. Intermediate
    arrays are bound as lambda variables: each is built once, wherever the optimizer moves the column.
    """
    pattern = WORD.replace("\\", "\\\\")
    return F.expr(f"""
      element_at(transform(array(regexp_extract_all({body}, '{pattern}', 0)), w ->
        struct(CAST(size(w) AS BIGINT) AS n, CASE WHEN size(w) < 4 THEN 0L ELSE
        element_at(transform(array(transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2]))), h ->
          CASE WHEN size(array_distinct(h)) = size(h) THEN 0L ELSE
          element_at(transform(array(sort_array(transform(h, (x, i) -> struct(x AS h, i AS i)))), s ->
            aggregate(
              sort_array(transform(filter(s, (x, i) -> (i > 0 AND s[greatest(i - 1, 0)].h = x.h)
                  OR (i < size(s) - 1 AND s[least(i + 1, size(s) - 1)].h = x.h)), x -> x.i)),
              struct(0L AS n, -3 AS last),
              (a, p) -> struct(a.n + least(3, p - a.last) AS n, p AS last), a -> a.n)), 1)
          END), 1) END AS r)), 1)""")


def measure(docs: DataFrame, text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """The rows with their counts; second, the column that holds each count."""
    names = {n: free_name(docs, n) for n in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks",
    )}
    words, body, lines = (free_name(docs, n) for n in ("_words", "_body", "_lines"))
    own = [F.col(f"`{c}`") for c in docs.columns]
    parts = docs.select(*own, text_or_empty(f"`{text}`").alias(body)).select(
        "*", _words_and_repeats(f"`{body}`").alias(words),
        F.filter(F.split(body, "\n"), lambda x: x.rlike(WORD)).alias(lines),
    )
    joined = F.regexp_replace(body, GAP, "")
    counts = {
        "n_words": F.col(f"{words}.n"),
        "word_chars": F.length(joined).cast("long"),
        "n_symbols": F.length(F.regexp_replace(body, SYMBOLS, "")).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": F.col(f"{words}.r"),
        "n_lines": F.size(lines).cast("long"),
        "n_upper": F.length(F.regexp_replace(body, r"[^\p{Lu}]+", "")).cast("long"),
        "n_marks": F.length(F.regexp_replace(body, r"[^!?]+", "")).cast("long"),
    }
    return parts.select(*own, *[c.alias(names[n]) for n, c in counts.items()]), names


def rates(names: dict[str, str]) -> dict[str, Column]:
    c = {n: F.col(f"`{v}`").cast("double") for n, v in names.items()}
    words, chars, lines = (F.greatest(c[n], F.lit(1.0)) for n in ("n_words", "word_chars", "n_lines"))
    return {
        "word_length": c["word_chars"] / words,
        "symbol_rate": c["n_symbols"] / words,
        "mark_rate": c["n_marks"] / words,
        "upper_share": c["n_upper"] / chars,
        "line_share": c["n_dup_lines"] / lines,
        "repeat_share": c["n_repeat_words"] / words,
    }


#: What a rate's denominator counts.
UNITS = {"word_length": "n_words", "symbol_rate": "n_words", "mark_rate": "n_words", "upper_share": "word_chars", "line_share": "n_lines", "repeat_share": "n_words"}


def base_failed(names: dict[str, str], rules: Rules) -> Column:
    n = F.col(f"`{names['n_words']}`")
    return (n < rules.min_words) | (100 * F.col(f"`{names['n_repeat_words']}`") > rules.max_repeat_percent * n)


def _bin(rate: Column) -> Column:
    """Number of a rate's logarithmic bin; the guard keeps bin borders alike on every engine."""
    logged = F.when(rate > 0, F.greatest(F.log(F.when(rate > 0, rate).otherwise(F.lit(1.0))), F.lit(LOWEST))).otherwise(F.lit(LOWEST))
    return F.floor(logged * BINS_PER_E + F.lit(1e-6)).cast("int")


def edge(quantile: float) -> float:
    """Where in a bin a quantile is taken to lie: the outer edge for a fence, so that none parts a bin, else the middle."""
    return 1.0 if quantile > 0.5 else -0.001 if quantile < 0.5 else 0.5


def _value(bin_: Column, at: float) -> Column:
    """A place in a bin; the lowest bin stands for zero."""
    return F.when(bin_ <= LOWEST * BINS_PER_E, F.lit(0.0)).otherwise(F.exp((bin_ + F.lit(at)) / BINS_PER_E))


def sketches(measured: DataFrame, names: dict[str, str], rules: Rules, lang: str, source: str) -> DataFrame:
    """Counts per (lang, source, rate, bin) over documents that pass the base rule: the mergeable sketch."""
    binned = measured.where(~base_failed(names, rules)).select(
        F.col(f"`{lang}`").alias("lang"), F.col(f"`{source}`").alias("source"),
        F.explode(F.create_map(*[x for r, c in rates(names).items() for x in (F.lit(r), _bin(c))])).alias("rate", "bin"),
    )
    return binned.groupBy("lang", "source", "rate", "bin").agg(F.count("*").alias("n"))


def _blended(own: DataFrame, keys: list[str], base: DataFrame, base_keys: list[str], prior: int) -> DataFrame:
    """Sketches per ``keys`` with the base sketch added as so many documents: (keys, rate, bin, n)."""
    of = F.sum("n").over(W.partitionBy(*base_keys, "rate"))
    shares = base.select(*[F.col(k).alias(f"_{k}") for k in base_keys], F.col("rate").alias("_rate"), "bin", (F.col("n") / of * prior).alias("n"))
    same = F.col("rate") == F.col("_rate")
    for k in base_keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    added = own.select(*keys, "rate").distinct().join(shares, same).select(*keys, "rate", "bin", "n")
    return own.withColumn("n", F.col("n").cast("double")).unionByName(added).groupBy(*keys, "rate", "bin").agg(F.sum("n").alias("n"))


def _quantiles(sketch: DataFrame, keys: list[str], fences: tuple[Fence, ...]) -> DataFrame:
    """(keys, rate, m, and q0, q1, ... of the fences), from cumulative counts over a sketch's few hundred bins."""
    by = W.partitionBy(*keys, "rate")
    upto = by.orderBy("bin").rowsBetween(W.unboundedPreceding, W.currentRow)
    c = sketch.select(*keys, "rate", "bin", F.sum("n").over(upto).alias("c"), F.sum("n").over(by).alias("t"))
    at = lambda q: _value(F.min(F.when(F.col("c") >= F.col("t") * (q - 1e-9), F.col("bin"))), edge(q))
    return c.groupBy(*keys, "rate").agg(at(0.5).alias("m"), *[at(f.quantile).alias(f"q{i}") for i, f in enumerate(fences)])


def thresholds(sketch: DataFrame, rules: Rules) -> DataFrame:
    """(lang, source, f0, f1, ...): the limit of every fence.

    Nothing switches by size: a source's sketch is its own counts and, as ``prior`` documents, its
    language's, which holds that of all in the same way. A small source is judged like its language.
    """
    merged = lambda keys: sketch.groupBy(*keys, "rate", "bin").agg(F.sum("n").alias("n"))
    langs = _blended(merged(["lang"]), ["lang"], merged([]), [], rules.prior)
    found = _quantiles(_blended(sketch, ["lang", "source"], langs, ["lang"], rules.prior), ["lang", "source"], rules.fences)
    limit = lambda i, f: F.col(f"q{i}") + (F.col(f"q{i}") - F.col("m")) * f.reach
    return found.groupBy("lang", "source").agg(*[F.max(F.when(F.col("rate") == f.rate, limit(i, f))).alias(f"f{i}") for i, f in enumerate(rules.fences)])


def beyond(names: dict[str, str], rules: Rules, limit) -> list[Column]:
    """For every fence, whether a document lies outside of it; ``limit`` gives the column of a fence's number."""
    value, out = rates(names), []
    for i, f in enumerate(rules.fences):
        spare = F.lit(float(f.spare)) / F.greatest(F.col(f"`{names[UNITS[f.rate]]}`"), F.lit(1))
        out.append(F.coalesce((value[f.rate] < limit(i) - spare) if f.quantile < 0.5 else (value[f.rate] > limit(i) + spare), F.lit(False)))
    return out


def judge(measured: DataFrame, names: dict[str, str], rules: Rules = Rules(), lang: str = "lang", source: str = "source") -> DataFrame:
    """Adds ``base_failed`` and ``kept``. ``measured`` should be stored: it is read twice.

    The fences are one row per (language, source); Spark broadcasts them only below its size
    threshold, else both sides are shuffled and a hot source is split by adaptive execution.
    """
    g_lang, g_source, g_limits = (free_name(measured, n) for n in ("_g_lang", "_g_source", "_g_limits"))
    limits = thresholds(sketches(measured, names, rules, lang, source), rules).select(
        F.col("lang").alias(g_lang), F.col("source").alias(g_source), F.struct(*[f"f{i}" for i in range(len(rules.fences))]).alias(g_limits)
    )
    j = measured.join(
        limits, F.col(f"`{lang}`").eqNullSafe(F.col(g_lang)) & F.col(f"`{source}`").eqNullSafe(F.col(g_source)), "left"
    )
    bad = F.lit(False)
    for outside in beyond(names, rules, lambda i: F.col(f"{g_limits}.f{i}")):
        bad = bad | outside
    failed = base_failed(names, rules)
    return j.select(*[F.col(f"`{c}`") for c in measured.columns], failed.alias(free_name(measured, "base_failed")), (~failed & ~bad).alias(free_name(measured, "kept")))


def quality_filter(docs: DataFrame, rules: Rules = Rules(), text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of ``docs`` that pass, with the columns they came with."""
    measured, names = measure(docs, text)
    stored = cut(measured, "quality")
    judged = judge(stored, names, rules, lang, source)
    return judged.where(F.col(f"`{judged.columns[-1]}`")).select(*[F.col(f"`{c}`") for c in docs.columns])
