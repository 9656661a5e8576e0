"""Text clean-up, tokens, topics and question framing as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from waymark.functions import constants as K

INJECTION_REGEX = "(?i)" + "|".join(K.INJECTION_PATTERNS)
NON_EVIDENTIAL = K.LIVE_WORDS + K.FRAMING_WORDS


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def tokens(text: Column) -> Column:
    """Lower-case ASCII words and numbers, longer than one character, without stop words."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+")
    return F.filter(words, lambda t: (F.length(t) > 1) & ~t.isin(K.STOP_WORDS))


def sentences(text: Column) -> Column:
    return F.split(text, r"(?<=[.!?])\s+")


def overlap(needles: Column, haystack: Column) -> Column:
    """Share of distinct needles present in the haystack; null without needles."""
    distinct = F.array_distinct(needles)
    hit = F.size(F.array_intersect(distinct, haystack)).cast("double")
    return F.try_divide(hit, F.size(distinct).cast("double"))


def sanitise(text: Column, max_length: int) -> Column:
    """Markup to spaces, control characters out, whitespace collapsed, length capped."""
    no_tags = F.regexp_replace(text, "<[^>]*>", " ")
    no_ctrl = F.regexp_replace(no_tags, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    return F.substring(collapse(no_ctrl), 1, max_length)


def injections(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(INJECTION_REGEX), F.lit(0))


def neutralise(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), INJECTION_REGEX, K.INJECTION_REPLACEMENT)


def topic(question: Column) -> Column:
    low = F.lower(F.coalesce(question, F.lit("")))
    ladder = F.when(F.lit(False), F.lit(""))
    for name, pattern in K.TOPIC_PATTERNS:
        ladder = ladder.when(low.rlike(pattern), F.lit(name))
    return ladder.otherwise(F.lit("any"))


def wants_live(question: Column) -> Column:
    return F.exists(
        tokens(question), lambda t: t.isin(K.LIVE_WORDS) | t.rlike(K.CLOCK_TIME_PATTERN)
    )


def evidence_terms(question: Column) -> Column:
    terms = F.array_distinct(tokens(question))
    kept = F.filter(terms, lambda t: ~t.isin(NON_EVIDENTIAL) & ~t.rlike(K.CLOCK_TIME_PATTERN))
    return F.when(F.size(kept) == 0, terms).otherwise(kept)


def host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")


def allowed_host(name: Column, domains: list[str] = K.ALLOWED_DOMAINS) -> Column:
    """Exact domain or dot-suffix; the suffixes of a host are few, so test set membership."""
    labels = F.split(name, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.coalesce(F.exists(suffixes, lambda s: s.isin(domains)), F.lit(False))


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int"))


def message_list(pairs: list[tuple[Column, Column]]) -> Column:
    """Messages whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(cond, text) for cond, text in pairs]))


def strip_private(props: Column) -> Column:
    """Remove coordinate keys, any case, from the top level of a JSON object."""
    bag = F.from_json(props, "map<string,string>")
    return F.to_json(F.map_filter(bag, lambda k, v: ~F.lower(k).isin(K.PRIVATE_KEYS)))
