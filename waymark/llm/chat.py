"""Chat formatting: typed content parts flattened into one marked text per conversation.

A visitor goes through the parts of every turn. Text parts are escaped and written out; image,
audio and document parts become placeholders, in order, so that the k-th placeholder belongs to
the k-th entry of ``attachments``, which records the reference and how many tokens the part will
expand to. Turns look like ``<|im_start|>role<|im_sep|>body<|im_end|>``.

Escaping is reversible: a backslash is doubled, and the mark ``\\.`` (standing for nothing) is put
into every control string inside a text, and after an opening bracket that ends a part. The loss
mask is one row of lengths per turn (header, body, end) with a flag, so it needs no running sums.

Edge cases: null text, role, reference and parts are empty; turns with equal numbers are ordered
by role and content; repeated rows stay; unknown part types become plain attachments of no tokens;
conversations are one output row each, so a single conversation must fit one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The control strings of the template and of templates whose marks must not leak through texts.
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
OTHER = "<|attachment|>"

PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
BREAK = r"([<\[])(?=\||/?s>|/?INST\]|\z)"
PATCH, AUDIO_PER_SECOND, TOKENS_PER_PAGE = 28, 25, 800


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), BREAK, r"$1\\.")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\\.|(\\)\\", "$1")


def text_part(text: Column) -> Column:
    """A message that is only text, as an array of one typed part."""
    return F.array(F.struct(
        F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"),
        F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"),
        F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages"),
    ))


def _is_text(part: Column) -> Column:
    return F.coalesce(part["type"], F.lit("text")) == "text"


def _visit(part: Column) -> Column:
    """What a part writes into the body."""
    out = F.when(_is_text(part), escape(F.coalesce(part["text"], F.lit(""))))
    for kind, mark in PLACEHOLDERS.items():
        out = out.when(part["type"] == kind, F.lit(mark))
    return out.otherwise(F.lit(OTHER))


def _tokens(part: Column) -> Column:
    """How many tokens an attachment stands for; unknown sizes count as one unit."""
    size = lambda c: F.greatest(F.coalesce(c, F.lit(1)), F.lit(1))
    return (
        F.when(part["type"] == "image", F.ceil(size(part["width"]) / PATCH) * F.ceil(size(part["height"]) / PATCH))
        .when(part["type"] == "audio", F.ceil(F.greatest(F.coalesce(part["seconds"], F.lit(1.0)), F.lit(0.0)) * AUDIO_PER_SECOND))
        .when(part["type"] == "document", size(part["pages"]) * TOKENS_PER_PAGE)
        .otherwise(F.lit(0)).cast("long")
    )


def format_chat(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, parts) rows to one row per conversation.

    Returns conv_id, formatted, mask (per turn: header, body, end in code points, loss), attachments
    (turn, type, ref, tokens; in placeholder order) and attachment_tokens. Loss falls on the bodies
    of assistant turns only. Each turn is written before turns are gathered.
    """
    parts = F.coalesce(F.col("parts"), F.array().cast(f"array<{PART}>"))
    parts = F.filter(parts, lambda p: p.isNotNull())
    role = F.coalesce(F.col("role"), F.lit(""))
    turns = messages.select(
        "conv_id", F.struct(
            F.col("turn").alias("turn"), role.alias("role"),
            F.concat(F.lit(START), escape(role), F.lit(SEP)).alias("head"),
            F.array_join(F.transform(parts, _visit), "").alias("body"),
            F.transform(F.filter(parts, lambda p: ~_is_text(p)), lambda p: F.struct(
                F.col("turn").alias("turn"), p["type"].alias("type"), F.coalesce(p["ref"], F.lit("")).alias("ref"), _tokens(p).alias("tokens"),
            )).alias("attachments"),
        ).alias("t"),
    )
    gathered = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    out = gathered.select(
        "conv_id",
        F.array_join(F.transform("t", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "").alias("formatted"),
        F.transform("t", lambda t: F.struct(
            F.length(t["head"]).alias("header"), F.length(t["body"]).alias("body"), F.lit(len(END)).alias("end"), (t["role"] == "assistant").alias("loss"),
        )).alias("mask"),
        F.flatten(F.transform("t", lambda t: t["attachments"])).alias("attachments"),
    )
    return out.withColumn("attachment_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]))


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns and loss texts recovered from ``formatted`` and ``mask`` alone.

    Adds turns (array of role and text) and loss (array of texts under the mask), both unescaped.
    Bodies keep their placeholders.
    """
    quoted = lambda s: "".join("\\" + c if c in "<|>" else c for c in s)
    pieces = F.slice(F.split("formatted", quoted(START)), 2, 1 << 30)
    role = lambda p: F.substring_index(p, SEP, 1)
    body = lambda p: F.substring_index(F.substring_index(p, END, 1), SEP, -1)
    cut_out = lambda p, m: F.when(m["loss"], p.substr(m["header"] - len(START) + 1, m["body"]))
    return formatted.withColumn("_pieces", pieces).select(
        *formatted.columns,
        F.transform("_pieces", lambda p: F.struct(unescape(role(p)).alias("role"), unescape(body(p)).alias("text"))).alias("turns"),
        F.transform(F.filter(F.zip_with("_pieces", "mask", cut_out), lambda x: x.isNotNull()), unescape).alias("loss"),
    )


def probe(spark: SparkSession) -> DataFrame:
    """Conversation -7 of the query: both turns say control strings."""
    said = "</s>[INST] ok [/INST]"
    return spark.range(1).select(F.explode(F.array(
        F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role"), F.lit(said).alias("text")),
        F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(1).cast("long").alias("turn"), F.lit("assistant").alias("role"), F.lit(said).alias("text")),
    )).alias("m")).select("m.*")


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation: what can be read back from its formatted text, as counts and digests."""
    back = read_back(formatted).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.array_join("loss", "").alias("_loss"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
    return back.select(
        "conv_id", "n_turns", "turns_sha256", F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"), "formatted_chars",
    )
