"""From raw documents to packed training sequences: five stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import mixing, packing, quality, simhash, suffixes
from waymark.llm.common import cut, documents, text_or_empty, tune, word_count


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the adaptive fences."""
    tune(spark)
    return quality.quality_filter(docs)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of the smallest id, of each group whose five-word shingles agree to 0.8 at least."""
    tune(spark)
    return simhash.one_per_group(docs, words=5, jaccard=0.8)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the 200-byte strings that occur twice; ``n_chars`` follows the text."""
    tune(spark)
    done = suffixes.remove_repeats(docs, docs.columns)
    left = {"text": F.col(done.columns[-1])} | ({"n_chars": F.length(F.col(done.columns[-1])).cast("long")} if "n_chars" in docs.columns else {})
    return done.select(*[left.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; a document taken twice is two rows."""
    tune(spark)
    return mixing.mixed(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their bins; copies of a document are packed one by one."""
    tune(spark)
    return packing.pack(docs, word_count(text_or_empty()))


STAGES = [
    ("quality_rules", good_documents),
    ("simhash_near_dedup", distinct_documents),
    ("suffix_array_dedup", without_repeats),
    ("source_mix", mixed_sources),
    ("best_fit_packing", packed_sequences),
]

#: Near-duplicate components, byte removal and drawn copies are beyond SQL; the tests compare stage by stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over ``documents``, each stored before the next reads it."""
    out = documents(tune(spark), sf_dir)
    for name, stage in STAGES:
        out = cut(stage(spark, out, sf_dir), name)
    return out
