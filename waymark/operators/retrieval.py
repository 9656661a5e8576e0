"""Batch hybrid retrieval: scopes, BM25, rank fusion, reranking, evidence, answers, citations.

The corpus is read and cut into tokens once, and every stage reads that table. What is kept per
question is each arm's pool, so texts are joined back for a few dozen chunks per question only.
Tokens and texts are sifted where they are read: only those that a question may need are shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions import constants as K, text
from waymark.functions.stats import lookup, rnd
from waymark.operators import grouped
from waymark.operators.embedding import dense_top, pair_scores
from waymark.session import cut, cut_and_free

BLOCK, ASKED = 4096, 4096  # chunks and questions of a block that is scored at once, about
SLOTS = 1 << 20  # hash slots of a sieve; it never has more rows, whatever is asked


def sifted(rows: DataFrame, keys: list[str], wanted: DataFrame) -> DataFrame:
    """The rows whose ``keys`` may be among ``wanted``, found without a shuffle of ``rows``.

    A few others pass by chance, so a join with ``wanted`` follows. Keys must have the same types on both sides.
    """
    slot = F.pmod(F.xxhash64(*keys), F.lit(SLOTS))
    slots = wanted.select(slot.alias("_slot")).distinct()
    return rows.withColumn("_slot", slot).join(F.broadcast(slots), "_slot", "left_semi").drop("_slot")


def scope_key(cluster: Column, place: Column | None, topic: Column | None) -> Column:
    star = F.lit("*")
    part = lambda c: star if c is None else F.coalesce(c, star)
    return F.concat_ws("|", cluster, part(place), part(topic))


def chunk_scopes() -> Column:
    """The four scopes a chunk belongs to."""
    c, p, t = F.col("cluster"), F.col("place"), F.col("topic")
    return F.array(scope_key(c, p, t), scope_key(c, p, None), scope_key(c, None, t), scope_key(c, None, None))


def with_scope(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Pick the narrowest scope that is not starved: place and topic, place, topic, cluster."""
    base = chunks.groupBy("cluster", "place", "topic").agg(F.count("*").alias("n"))
    sizes = base.select(F.explode(chunk_scopes()).alias("scope"), "n").groupBy("scope").agg(F.sum("n").alias("n"))
    c, p = F.col("cluster"), F.col("place")
    topic = F.col("topic")
    asked = questions.withColumn("topic", F.nullif(text.topic(F.col("question")), F.lit("any")))
    options = F.array(
        F.struct(F.lit(1).alias("level"), F.lit(2).alias("least"), scope_key(c, p, topic).alias("scope")),
        F.struct(F.lit(2).alias("level"), F.lit(1).alias("least"), scope_key(c, p, None).alias("scope")),
        F.struct(F.lit(3).alias("level"), F.lit(1).alias("least"), scope_key(c, None, topic).alias("scope")),
        F.struct(F.lit(4).alias("level"), F.lit(1).alias("least"), scope_key(c, None, None).alias("scope")),
    )
    tried = asked.select("q", F.inline(options)).join(sizes, "scope").where(F.col("n") >= F.col("least"))
    chosen = tried.groupBy("q").agg(F.min(F.struct("level", "scope", "n")).alias("s")).select(
        "q", F.col("s.scope").alias("scope"), F.col("s.n").alias("candidates")
    )
    return asked.join(chosen, "q")


def chunk_index(chunks: DataFrame) -> DataFrame:
    """The chunks of a run with their scopes and tokens, dealt by a hash of the chunk and stored once.

    Every later stage reads this table, not the documents.
    """
    dealt = chunks.repartition("chunk").withColumn("scopes", chunk_scopes())
    return cut_and_free(dealt.withColumn("tokens", text.tokens(F.concat_ws(" ", "heading", "body"))), "chunks")


def counted_terms(questions: DataFrame, index: DataFrame) -> DataFrame:
    """(scope, chunk, len, term, tf) of the asked terms of every asked scope, and a few others by chance; stored once."""
    terms = questions.select("scope", F.explode(text.tokens(F.col("question"))).alias("term")).distinct()
    said = sifted(index.select("chunk", "scopes", F.size("tokens").alias("len"), F.explode("tokens").alias("term")), ["term"], terms)
    scoped = sifted(said.select(F.explode("scopes").alias("scope"), "chunk", "len", "term"), ["scope", "term"], terms)
    return cut_and_free(scoped.groupBy("scope", "chunk", "len", "term").agg(F.count("*").alias("tf")), "postings")


def scope_stats(questions: DataFrame, index: DataFrame) -> DataFrame:
    """(scope, n, avg_len): chunks of every asked scope and their mean length."""
    scoped = index.select(F.explode("scopes").alias("scope"), F.size("tokens").alias("len"))
    stats = scoped.groupBy("scope").agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))
    return cut(stats.join(questions.select("scope").distinct(), "scope", "left_semi"), "stats")


def term_idf(counted: DataFrame, stats: DataFrame) -> DataFrame:
    """(scope, term, idf) by the chunks of the scope that have the term."""
    held = counted.groupBy("scope", "term").agg(F.count("*").alias("df")).join(stats, "scope")
    return held.select("scope", "term", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def damped() -> Column:
    """What BM25 multiplies a term's weight with, by its count in the chunk and the chunk's length."""
    mean = F.when(F.col("avg_len") == 0, 1.0).otherwise(F.col("avg_len"))
    return F.col("tf") * (K.BM25_K1 + 1) / (F.col("tf") + K.BM25_K1 * (1 - K.BM25_B + K.BM25_B * F.col("len") / mean))


def asked_terms(questions: DataFrame) -> DataFrame:
    """(q, scope, term): distinct terms of every question."""
    return questions.select("q", "scope", F.explode(F.array_distinct(text.tokens(F.col("question")))).alias("term"))


def lexical_scores(questions: DataFrame, index: DataFrame) -> DataFrame:
    """(q, chunk, lexical): BM25 of every chunk of a question's scope that has one of its terms."""
    counted, stats = counted_terms(questions, index), scope_stats(questions, index)
    postings = counted.join(term_idf(counted, stats), ["scope", "term"]).join(stats, "scope").select("scope", "term", "chunk", (F.col("idf") * damped()).alias("score"))
    hits = asked_terms(questions).join(postings, ["scope", "term"])
    return hits.groupBy("q", "chunk").agg(rnd(F.sum("score"), 9).alias("lexical"))


def lexical_top(questions: DataFrame, index: DataFrame, top: int = K.LEXICAL_POOL, block: int = BLOCK, asked: int = ASKED) -> DataFrame:
    """(q, chunk, lexical, lexical_rank): the pool of every question.

    Postings of a scope are dealt to blocks by a hash of the chunk, and its questions with the weights of
    their terms to each block. A block scores all its pairs in the task's memory and gives its best ``top``
    per question, so no row is ever made of a pair that is not among them. ``block`` chunks and ``asked``
    questions, about, meet in a block.
    """
    counted, stats = counted_terms(questions, index), scope_stats(questions, index)
    parts = questions.groupBy("scope").agg(F.ceil(F.count("*") / asked).cast("int").alias("parts"))
    sized = stats.join(parts, "scope").withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    postings = counted.join(sized, "scope").select("scope", dealt("chunk", "blocks").alias("block"), each("parts").alias("part"), "term", "chunk", damped().alias("damped"))
    weighed = asked_terms(questions).where("q is not null").join(term_idf(counted, stats), ["scope", "term"])
    wanted = weighed.groupBy("q", "scope").agg(F.collect_list("term").alias("terms"), F.collect_list("idf").alias("idf")).join(sized, "scope").select(
        "scope", each("blocks").alias("block"), dealt("q", "parts").alias("part"), "q", "terms", "idf"
    )
    key = ["scope", "block", "part"]
    best = postings.groupBy(*key).cogroup(wanted.groupBy(*key)).applyInArrow(_block_scores(top), "q bigint, chunk bigint, lexical double")
    return grouped.top_n(best, ["q"], [F.desc("lexical"), F.col("chunk")], top, "lexical_rank")


def _block_scores(top: int):
    none = np.iinfo(np.int64).min  # stands for a chunk without a number, which comes first in order

    def score(postings: pa.Table, asked: pa.Table) -> pa.Table:
        said = postings["term"].combine_chunks().dictionary_encode()
        number = {t: i for i, t in enumerate(said.dictionary.to_pylist())}
        code = said.indices.to_numpy(zero_copy_only=False)
        ids, at = np.unique(postings["chunk"].fill_null(none).to_numpy(), return_inverse=True)
        order = np.argsort(code, kind="stable")
        at, damped, ends = at[order], postings["damped"].to_numpy()[order], np.searchsorted(code[order], np.arange(len(number) + 1))
        found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        for q, terms, idf in zip(*(asked[c].to_pylist() for c in ("q", "terms", "idf"))):
            held = [(slice(ends[number[t]], ends[number[t] + 1]), w) for t, w in zip(terms, idf) if t in number]
            if not held:
                continue
            hit = np.concatenate([at[s] for s, _ in held])
            some = np.flatnonzero(np.bincount(hit))
            scores = np.round(np.bincount(hit, np.concatenate([damped[s] * w for s, w in held]))[some] + 1e-9, 9)
            reach = (scores > 0) & (scores >= (np.partition(scores, -top)[-top] if len(scores) > top else 0))
            some, scores = some[reach], scores[reach]
            first = np.argsort(-scores, kind="stable")[:top]  # ids ascend, so ties go to the smaller
            found.append((np.full(len(first), q), ids[some[first]], scores[first]))
        q, chunk, lexical = (np.concatenate(x) for x in zip(*found))
        return pa.table({"q": pa.array(q, pa.int64()), "chunk": pa.array(chunk, pa.int64(), mask=chunk == none), "lexical": pa.array(lexical, pa.float64())})

    return score


def arms(questions: DataFrame, index: DataFrame) -> DataFrame:
    """(q, chunk, dense, dense_rank, lexical, lexical_rank): both pools of every question."""
    dense = cut_and_free(dense_top(index, questions), "dense")
    return dense.join(cut_and_free(lexical_top(questions, index), "lexical"), ["q", "chunk"], "full_outer")


def fuse(pools: DataFrame, strategy: str = "hybrid") -> DataFrame:
    """Reciprocal-rank sum over the arms of ``strategy``; an empty arm falls back to the other."""
    part = lambda c: F.coalesce(1.0 / (K.RRF_K + F.col(c)), F.lit(0.0))
    dense, lexical = part("dense_rank"), part("lexical_rank")
    own = {"hybrid": dense + lexical, "dense": dense, "lexical": lexical}[strategy]
    spare = F.greatest(dense, lexical) if strategy == "hybrid" else (lexical if strategy == "dense" else dense)
    used = {"hybrid": F.lit(True), "dense": F.col("dense_rank").isNotNull(), "lexical": F.col("lexical_rank").isNotNull()}[strategy]
    served = pools.groupBy("q").agg(F.bool_or(used).alias("served"))
    marked = pools.join(served, "q").where(~F.col("served") | used)
    return marked.withColumn("fused", rnd(F.when(F.col("served"), own).otherwise(spare), 6)).drop("served")


def rerank(fused: DataFrame, questions: DataFrame, chunks: DataFrame, enabled: bool = True, top: int = K.TOP_K) -> DataFrame:
    """Final ``top`` chunks per question, with texts; features when enabled, else the fused order."""
    ceiling = fused.groupBy("q").agg(F.max("fused").alias("max_fused"))
    pooled = sifted(chunks, ["chunk"], fused)
    body = pooled.select("chunk", "doc_id", "heading", "body", F.col("topic").alias("chunk_topic"), F.col("place").alias("chunk_place"), "source_type")
    rows = fused.join(ceiling, "q").join(questions.select("q", "question", "topic"), "q").join(body, "chunk")
    terms = text.tokens(F.col("question"))
    share = lambda c: F.coalesce(text.overlap(terms, text.tokens(F.col(c))), F.lit(0.0))
    score = (
        0.45 * F.coalesce(F.try_divide(F.col("fused"), F.col("max_fused")), F.lit(0.0))
        + 0.22 * share("body") + 0.13 * share("heading")
        + 0.12 * F.coalesce(F.col("chunk_topic") == F.col("topic"), F.lit(False)).cast("double")
        + 0.08 * lookup(K.SOURCE_AUTHORITY, F.col("source_type"), 0.5)
    )
    ranked = rows.withColumn("rerank", rnd(score, 6))
    order = [F.desc("rerank") if enabled else F.desc("fused"), F.col("chunk")]
    final = grouped.top_n(ranked, ["q"], order, top, "rank")
    # a chunk may have come from the lexical arm alone, so the few final rows are scored densely
    return pair_scores(final.drop("dense"), ["q", "chunk"], F.concat_ws("\n", "heading", "body"), F.col("question"))


def corpus_idf(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """(q, terms): evidence terms with corpus-wide weights and accepted synonyms, per question."""
    terms = questions.select("q", F.explode(text.evidence_terms(F.col("question"))).alias("term"))
    words = sifted(chunks.select(F.explode(F.array_distinct("tokens")).alias("term")), ["term"], terms)
    df = words.join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + F.col("n") / (1 + F.coalesce("df", F.lit(0))))
    synonyms = F.expr("map(" + ", ".join(f"'{h}', array({', '.join(repr(s) for s in t)})" for h, t in K.SYNONYMS.items()) + ")")
    accepted = F.concat(F.array("term"), F.coalesce(F.try_element_at(synonyms, F.col("term")), F.array().cast("array<string>")))
    weighted = terms.join(df, "term", "left").withColumn("n", chunks.agg(F.greatest(F.count("*"), F.lit(1))).scalar())
    return weighted.groupBy("q").agg(F.collect_list(F.struct(idf.alias("w"), accepted.alias("accepted"))).alias("terms"))


def evidence(final: DataFrame, weights: DataFrame) -> DataFrame:
    """(q, evidence): the best chunk's mix of dense similarity and weighted term coverage."""
    present = text.tokens(F.concat_ws(" ", "heading", "body"))
    total = F.aggregate("terms", F.lit(0.0), lambda s, t: s + t["w"])
    rows = final.join(weights, "q", "left").withColumn("present", present)
    covered = F.aggregate("terms", F.lit(0.0), lambda s, t: s + F.when(F.arrays_overlap(t["accepted"], F.col("present")), t["w"]).otherwise(0.0))
    coverage = F.coalesce(F.try_divide(covered, total), F.lit(0.0))
    dense = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(rnd(F.col("dense"), 6), F.lit(0.0))))
    return rows.groupBy("q").agg(rnd(F.max(0.35 * dense + 0.65 * coverage), 4).alias("evidence"))


def compose(final: DataFrame) -> DataFrame:
    """(q, answer): up to three sentences from each of the first three chunks."""
    body = text.collapse(F.col("body"))
    kept = F.slice(F.filter(text.sentences(body), lambda s: F.length(s) > 25), 1, 3)
    rows = final.where("rank <= 3").select("q", "rank", body.alias("body"), F.array_join(kept, " ").alias("part"))
    parts = rows.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("rank", "part", "body"))).alias("parts"))
    told = F.array_join(F.transform(F.filter("parts", lambda p: p["part"] != ""), lambda p: p["part"]), "\n\n")
    return parts.select("q", F.when(told == "", F.element_at("parts", 1)["body"]).otherwise(told).alias("answer"))


def cite(answers: DataFrame, final: DataFrame) -> DataFrame:
    """(q, pos, sentence, chunk, citation): each answer sentence with the chunk it overlaps most."""
    split = F.filter(F.transform(text.sentences(F.trim("answer")), lambda s: F.trim(s)), lambda s: s != "")
    spoken = answers.select("q", F.posexplode(split).alias("pos", "sentence")).withColumn("words", F.array_distinct(text.tokens(F.col("sentence"))))
    pairs = spoken.join(final.select("q", "chunk", "rank", text.tokens(F.col("body")).alias("have")), "q")
    share = F.coalesce(text.overlap(F.col("words"), F.col("have")), F.lit(0.0))
    best = pairs.groupBy("q", "pos", "sentence").agg(F.max(F.struct(share.alias("share"), (-F.col("rank")).alias("r"), "chunk")).alias("b"))
    cited = best.select("q", "pos", "sentence", F.when((F.col("b.share") >= K.CITATION_OVERLAP) & (F.col("b.share") > 0), F.col("b.chunk")).alias("chunk"))
    first = cited.where("chunk is not null").groupBy("q", "chunk").agg(F.min("pos").alias("first"))
    numbered = first.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("first", "chunk"))).alias("used")).select(
        "q", F.posexplode("used").alias("i", "u")
    ).select("q", F.col("u.chunk").alias("chunk"), (F.col("i") + 1).alias("citation"))
    return cited.join(numbered, ["q", "chunk"], "left")


def faithfulness(answer: Column, contexts: Column) -> Column:
    """Share of sentences (over 20 characters) with 30% of their words in one context."""
    spoken = F.filter(F.transform(text.sentences(answer), lambda s: F.trim(s)), lambda s: F.length(s) > 20)
    words = F.transform(spoken, lambda s: text.tokens(s))
    ok = F.filter(words, lambda w: F.exists(contexts, lambda c: F.coalesce(text.overlap(w, c), F.lit(0.0)) >= K.CITATION_OVERLAP))
    return F.coalesce(rnd(F.try_divide(F.size(ok).cast("double"), F.size(spoken).cast("double")), 4), F.lit(0.0))
