"""The operators of this folder as registered queries: each reads its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import chat, dualtree, language, licenses, manifest, mixing, packing, quality, ring, simhash, suffixes, tokens, topk
from waymark.llm.common import cut, documents, table, text_or_empty, tune, word_count
from waymark.llm.twins import ORACLES

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    def run(spark: SparkSession, root: str) -> DataFrame:
        return fn(tune(spark), root)

    run.__doc__ = fn.__doc__
    QUERIES[fn.__name__] = run
    return fn


@query
def op1_best_fit_packing(spark: SparkSession, root: str) -> DataFrame:
    """Every document's pieces, in words, with their bins. Compared with a plain best fit in the tests."""
    return packing.pack(documents(spark, root), word_count(text_or_empty()))


@query
def op2_quality_rules(spark: SparkSession, root: str) -> DataFrame:
    """Counts of every document, the base rule, and the verdict of the adaptive fences."""
    docs = documents(spark, root).select("doc_id", "lang", "source", "text")
    measured, names = quality.measure(docs)
    judged = quality.judge(cut(measured.drop("text"), "quality"), names)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op3_repeated_strings(spark: SparkSession, root: str) -> DataFrame:
    """What is left of every document without strings that occur twice. Compared with a set of all strings in the tests."""
    done = suffixes.remove_repeats(documents(spark, root), ["doc_id"], with_text=False)
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query
def op4_license_scan(spark: SparkSession, root: str) -> DataFrame:
    """Canonical digest of every document and the licences that it, or a line of it, is."""
    return licenses.scan(documents(spark, root), licenses.known_licenses(spark))


@query
def op5_source_mix(spark: SparkSession, root: str) -> DataFrame:
    """Words that the mix takes of every document. Drawn; the tests check targets, limits and a plain loop."""
    took = mixing.copies(mixing.document_sizes(documents(spark, root)))
    return took.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query
def op6_token_counts(spark: SparkSession, root: str) -> DataFrame:
    """Greedy word-piece counts of every document. Compared with plain longest matching in the tests."""
    return tokens.count_tokens(documents(spark, root), ["doc_id"])


@query
def op7_simhash_groups(spark: SparkSession, root: str) -> DataFrame:
    """Fingerprint and component of every document. Components are iterative; the tests compare all pairs."""
    found = simhash.groups(documents(spark, root))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query
def op8_exact_top_k(spark: SparkSession, root: str) -> DataFrame:
    """The five best rows for every vector whose id is divisible by 50."""
    return topk.top_k(table(spark, root, "embeddings"), F.col("vec_id") % 50 == 0)


@query
def op9_language_id(spark: SparkSession, root: str) -> DataFrame:
    """Predicted language of every document; a learned model, tested by held-out accuracy."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return language.identify(documents(spark, root), ~held_out, {"doc_id": F.col("doc_id"), "held_out": held_out})


@query
def op10_chat_format(spark: SparkSession, root: str) -> DataFrame:
    """What can be read back from the formatted text of every conversation."""
    rows = table(spark, root, "conversations").select("conv_id", "turn", "role", "text").unionByName(chat.probe(spark))
    return chat.digests(chat.format_chat(rows.select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts"))))


@query
def op11_lexical_search(spark: SparkSession, root: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return dualtree.search(documents(spark, root), table(spark, root, "benchmark"))


@query
def op12_merkle_manifest(spark: SparkSession, root: str) -> DataFrame:
    """Leaf, roots and witness of every document, and what a tampered document folds to."""
    text, chosen = F.col("text"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    small = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    fields = [F.col(c) for c in manifest.FIELDS[:-1]]
    altered = F.when(chosen & text.isNotNull(), manifest.leaf_digest([*fields, small]))
    found = manifest.witnesses(documents(spark, root), carry={"altered": altered})
    folded = manifest.fold(F.coalesce("altered", "leaf"), F.col("witness"))
    return found.select("doc_id", "leaf", "subroot", "root", manifest.witness_digest(F.col("witness")).alias("proof_sha256"), folded.alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root")
    )


@query
def op13_ring_shards(spark: SparkSession, root: str) -> DataFrame:
    """Shard and seat of every document on the bounded ring."""
    placed = ring.assign(documents(spark, root))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "home_shard")
