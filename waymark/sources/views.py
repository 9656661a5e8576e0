"""Domain views over the given tables: places, trips, members, plans, chunks, points, votes.

Each view is a narrow projection, so column pruning reaches the scan. Group sizes follow the
domain: sixteen places to a circuit, five members to a trip; the number of groups grows with
the data, not their size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions import clock, constants as K
from waymark.functions.stats import lookup
from waymark.sources.tables import table

SPAN = 1 << 28  # minor numbers of a paired id

# Stand-in binding of part-name words to catalogue tags.
WORD_TAGS = {
    "ring": "temple", "blue": "lake", "bolt": "fort", "new": "modern", "cold": "high-altitude",
    "small": "village", "plate": "food", "rod": "trek", "anvil": "museum", "gear": "science",
    "gizmo": "viewpoint", "red": "palace", "large": "landmark", "widget": "market",
    "hot": "hot-spring", "old": "heritage",
}
PLACE_KINDS = {
    "STANDARD": "outdoor", "LARGE": "outdoor", "PROMO": "mixed", "MEDIUM": "mixed",
    "ECONOMY": "indoor", "SMALL": "indoor",
}
PHRASES = [
    "When was it built and what is its history?",
    "Why is it famous and sacred?",
    "Tell me an interesting fact or trivia:",
    "How long is a visit and what does the ticket cost?",
    "Is it suitable for elderly visitors in a wheelchair?",
    "What should we wear and is photography allowed?",
    "What is the ticket price right now today?",
]
CLUSTERS = ["en", "fr", "de", "es"]
SOURCE_TYPES = ["official", "government", "encyclopedic", "openstreetmap", "editorial", "blog"]
MODES = ["walk", "car", "taxi", "public", "mixed"]
TIERS = ["budget", "midrange", "premium"]
AS_OF = "2024-01-20 12:00:00"


def pick(values: list[str], index: str) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.expr(f"cast({index} as int)") + 1)


def places(spark: SparkSession, root: str) -> DataFrame:
    part = table(spark, root, "part")
    words = F.split("p_name", " ")
    tags = F.filter(F.transform(words, lambda w: lookup(WORD_TAGS, w)), lambda t: t.isNotNull())
    base = part.select(
        F.col("p_partkey").alias("place"),
        F.expr("p_partkey div 16").alias("circuit"),
        F.col("p_brand").alias("cluster"),
        F.col("p_name").alias("name"),
        tags.alias("tags"),
        lookup(PLACE_KINDS, F.col("p_type"), "outdoor").alias("kind"),
        F.expr("20 + 5 * p_size").alias("typ"),
        F.expr("cast(if(p_partkey % 3 = 0, null, 10 + 5 * p_size + (p_partkey % 5) * 5) as int)").alias("raw_min"),
        F.expr("cast(if(p_partkey % 4 = 0, null, 40 + 5 * p_size - (p_partkey % 6) * 8) as int)").alias("raw_max"),
        pick(["low", "medium", "high", "very_high", "unrated"], "p_partkey % 5").alias("crowd"),
        pick(["yes", "partial", "no", "unknown", "unrated"], "(p_partkey * 11) % 5").alias("access"),
        F.expr("cast(1 + p_partkey % 5 as int)").alias("intensity"),
        F.expr("cast(1 + (p_partkey * 3) % 5 as int)").alias("senior"),
        F.expr("cast(1 + (p_partkey * 7) % 5 as int)").alias("child"),
        F.expr("((p_partkey * 31) % 1000) / 1000e0").alias("quality"),
        F.expr("((p_partkey * 17) % 101) / 100e0").alias("sens"),
        F.expr("cast((p_partkey * 13) % 100 as int)").alias("popularity"),
        pick(["high", "medium", "low", "unrated"], "p_partkey % 4").alias("confidence"),
        F.expr("p_partkey % 3 <> 0").alias("unverified"),
        F.expr("if(p_partkey % 13 = 0, null, date_add(date'2023-01-01', cast(p_partkey % 900 as int)))").alias("verified_on"),
        F.expr("if(p_partkey % 7 = 0, null, p_retailprice)").alias("raw_fee_min"),
        F.expr("if(p_partkey % 5 = 0, null, p_retailprice - 450e0 + (p_partkey % 9) * 100e0)").alias("raw_fee_max"),
        F.expr("cast(360 + 60 * (p_partkey % 5) as int)").alias("opens"),
        F.expr("cast((360 + 60 * (p_partkey % 5) + 360 + 90 * (p_partkey % 10)) % 1440 as int)").alias("raw_closes"),
        F.expr("p_partkey % 10 <> 9").alias("recorded"),
        F.expr("if(p_partkey % 9 < 7, array(cast(p_partkey % 9 as int)), array())").cast("array<int>").alias("closed_dow"),
        F.expr("filter(sequence(1, 12), m -> (p_partkey + m) % 4 <> 0)").alias("months"),
        F.expr("8 + (((p_partkey div 16) * 7919) % 2700) / 100e0 + ((p_partkey * 37) % 100) / 250e0").alias("lat"),
        F.expr("69 + (((p_partkey div 16) * 6271) % 2700) / 100e0 + ((p_partkey * 53) % 100) / 250e0").alias("lon"),
        F.expr("cast(p_partkey % 5 as int)").alias("n_facts"),
        F.expr("p_partkey % 2 = 0").alias("has_history"),
        F.expr("p_partkey % 3 = 0").alias("has_significance"),
        F.expr("p_partkey % 5 = 0").alias("has_etiquette"),
        F.expr("array(p_partkey + 1, p_partkey + 2, p_partkey, p_partkey + 5000000, p_partkey + 16, p_partkey + 3)").alias("nearby"),
    )
    low = F.coalesce("raw_min", F.greatest(F.lit(15), F.floor(F.col("typ") / 2).cast("int")))
    high = F.coalesce("raw_max", F.col("typ") * 2)
    fee_low = F.coalesce("raw_fee_min", F.lit(0.0))
    fee_high = F.coalesce("raw_fee_max", fee_low)
    every_day = F.array(
        F.struct(F.lit(-1).alias("dow"), F.col("opens"), F.col("closes"))
    ).cast(clock.WINDOW_TYPE)
    evening = F.array(
        F.struct(F.expr("cast(place % 7 as int)").alias("dow"), F.lit(1080).alias("opens"), F.lit(1260).alias("closes"))
    ).cast(clock.WINDOW_TYPE)
    none = F.array().cast(clock.WINDOW_TYPE)
    return (
        base.withColumns(
            {
                "min_dur": F.least(low, F.col("typ")),
                "max_dur": F.greatest(high, F.col("typ")),
                "fee_min": fee_low,
                "fee_max": F.greatest(fee_low, fee_high),
                "closes": clock.past_midnight(F.col("opens"), F.col("raw_closes")).cast("int"),
            }
        )
        .withColumn(
            "windows",
            F.when(~F.col("recorded"), none)
            .when(F.expr("place % 6 = 0"), F.concat(every_day, evening))
            .otherwise(every_day),
        )
    )


def trips(spark: SparkSession, root: str) -> DataFrame:
    o = table(spark, root, "orders")
    lat = "8 + (((o_orderkey div 128) * 7919) % 2700) / 100e0 + 0.2e0"
    lon = "69 + (((o_orderkey div 128) * 6271) % 2700) / 100e0 + 0.2e0"
    own = lambda steps: F.expr(
        f"transform({steps}, d -> (o_orderkey div 128) * 16 + (o_orderkey + d) % 16)"
    ).cast("array<bigint>")
    return o.select(
        F.col("o_orderkey").alias("trip"),
        F.col("o_custkey").alias("owner"),
        F.expr("o_orderkey div 128").alias("circuit"),
        F.to_date("o_orderdate").alias("start_date"),
        F.expr("date_add(to_date(o_orderdate), cast(o_orderkey % 5 as int))").alias("end_date"),
        F.expr("cast(o_orderkey % 5 + 1 as int)").alias("days"),
        F.col("o_orderstatus").alias("status"),
        F.expr("if(o_orderkey % 10 = 0, null, o_totalprice / 100e0)").alias("budget"),
        F.expr("case o_orderpriority when '5-LOW' then 'relaxed' when '1-URGENT' then 'packed' "
               "when '2-HIGH' then 'packed' else 'balanced' end").alias("pace"),
        pick(MODES, "o_orderkey % 5").alias("mode"),
        pick(TIERS, "o_orderkey % 3").alias("tier"),
        F.expr("cast(1 + o_orderkey % 6 as int)").alias("travellers"),
        F.lit(540).alias("day_start"),
        F.expr("cast(1080 + 60 * (o_orderkey % 3) as int)").alias("day_end"),
        F.expr("o_orderkey % 9 = 0").alias("needs_access"),
        F.expr("o_orderkey % 7 = 0").alias("seniors"),
        F.expr("o_orderkey % 4 = 0").alias("children"),
        own("if(o_orderkey % 6 = 5, array(0), array())").alias("must_own"),
        own("if(o_orderkey % 4 = 0, array(0, 7), array())").alias("avoid_own"),
        F.expr(f"if(o_orderkey % 3 = 0, null, {lat} + (o_orderkey % 50) / 100e0)").alias("origin_lat"),
        F.expr(f"if(o_orderkey % 3 = 0, null, {lon} + (o_orderkey % 50) / 200e0)").alias("origin_lon"),
        F.expr(lat).alias("centre_lat"),
        F.expr(lon).alias("centre_lon"),
    ).withColumns(
        {
            "base_lat": F.coalesce("origin_lat", "centre_lat"),
            "base_lon": F.coalesce("origin_lon", "centre_lon"),
        }
    )


PREFERENCE_COUNTS = {
    "heritage": ("signup", False), "spiritual": ("purchase", True), "nature": ("view", False),
    "adventure": ("error", False), "food": ("purchase", False), "shopping": ("click", True),
    "museums": ("signup", True), "photography": ("click", False), "relaxation": ("view", True),
    "wildlife": ("error", True),
}


def members(spark: SparkSession, root: str) -> DataFrame:
    """One row per member: trip, weight, ten preferences (null = not stated), explicit choices."""
    e = table(spark, root, "events")
    hit = lambda kind, even: (F.col("event_type") == kind) & (
        (F.col("event_id") % 2 == 0) if even else F.lit(True)
    )
    counted = e.groupBy(F.col("user_id").alias("member")).agg(
        *[F.count_if(hit(*spec)).alias(name) for name, spec in PREFERENCE_COUNTS.items()]
    )
    top = F.greatest(*[F.col(name) for name in PREFERENCE_COUNTS])
    choices = lambda steps, at: F.expr(
        f"transform({steps}, d -> ((member div 5) * 97 div 128) * 16 + ({at}) % 16)"
    ).cast("array<bigint>")
    return counted.select(
        "member",
        F.expr("(member div 5) * 97").alias("trip"),
        F.expr("cast(1 + member % 2 as double)").alias("weight"),
        *[
            F.when(F.col(name) == 0, F.lit(None)).otherwise(F.lit(5.0) * F.col(name) / top).alias(name)
            for name in K.INTERESTS
        ],
        choices("case when member % 4 = 0 then array(0) when member % 12 = 5 then array(0, 5, 9) else array() end", "member + d").alias("must_places"),
        choices("case when member % 14 = 0 then array(3, 8) when member % 7 = 0 then array(3) else array() end", "member * 5 + d").alias("avoid_places"),
        F.expr("if(member % 3 = 0, array(((member div 5) * 97 div 128) * 16 + (member * 3) % 16, "
               "((member div 5) * 97 div 128) * 16 + (member * 3 + 5) % 16), array())").cast("array<bigint>").alias("ranked"),
        F.expr("case when member % 11 = 0 then 'wheelchair' when member % 5 = 1 then 'limited_walking' "
               "else 'full' end").alias("mobility"),
        F.expr("member % 6 = 0").alias("is_senior"),
        F.expr("member % 8 = 0").alias("is_child"),
        F.expr("if(member % 10 = 9, 'opted_out', 'joined')").alias("status"),
    )


def activities(spark: SparkSession, root: str) -> DataFrame:
    """Scheduled stops of a plan, two days to a plan, two versions."""
    li = table(spark, root, "lineitem")
    start = "480 + (l_linenumber * 97 + l_partkey) % 600"
    return li.select(
        F.col("l_orderkey").alias("plan"),
        F.expr("cast(l_linenumber % 2 as int)").alias("day"),
        F.col("l_partkey").alias("place"),
        F.expr(f"cast({start} as int)").alias("start_min"),
        F.expr(f"cast({start} + 20 + l_quantity as int)").alias("end_min"),
        F.expr("if(l_returnflag = 'R', 'meal', 'visit')").alias("kind"),
        F.expr("cast((l_suppkey * 7) % 45 as int)").alias("travel_min"),
        F.expr("l_tax * 250e0 + 1e0").alias("travel_km"),
        F.expr("1e0 - l_discount * 8e0").alias("weather"),
        F.expr("if(l_linestatus = 'F', 1, 2)").alias("version"),
        F.col("l_quantity").alias("qty"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("discount"),
    )


def documents(spark: SparkSession, root: str) -> DataFrame:
    """The columns of the documents that the queries use."""
    return table(spark, root, "documents").select("doc_id", "lang", "source", "text")


def paired(major: str, minor: str) -> Column:
    """One id of two numbers; a minor number beyond its share or an overflow is an error, never another row's id."""
    return F.expr(
        f"case when {minor} between 0 and {SPAN - 1} then {major} * {SPAN}L + {minor} "
        f"when {minor} is not null then raise_error('{minor} out of range') end"
    )


def chunks(spark: SparkSession, root: str) -> DataFrame:
    d = documents(spark, root)
    lines = d.select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("pos", "body"))
    return lines.where("body <> ''").select(
        paired("doc_id", "pos").alias("chunk"),
        "doc_id",
        "pos",
        F.col("lang").alias("cluster"),
        F.col("source").alias("place"),
        pick(K.TOPICS, "(doc_id + pos) % 6").alias("topic"),
        pick(SOURCE_TYPES, "doc_id % 6").alias("source_type"),
        "body",
    ).withColumn("heading", F.concat_ws(" ", "topic", F.lit("of"), "place", F.lit("in"), "cluster"))


def questions(spark: SparkSession, root: str) -> DataFrame:
    b = table(spark, root, "benchmark")
    return b.select(
        F.col("item_id").alias("q"),
        F.concat(pick(PHRASES, "item_id % 7"), F.lit(" "), "text").alias("question"),
        F.col("text").alias("passage"),
        pick(CLUSTERS, "if(item_id % 5 = 4, item_id % 4, 0)").alias("cluster"),
        F.expr("if(item_id % 3 = 0, null, concat('src', item_id % 21))").alias("place"),
    )


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def calls(spark: SparkSession, root: str) -> DataFrame:
    e = table(spark, root, "events")
    return e.select(
        F.col("event_id").alias("call"),
        F.col("event_type").alias("service"),
        "ts",
        F.col("value").alias("latency"),
        F.when(F.col("event_type") == "error", _k() % 2 == 0).otherwise(_k() % 13 != 0).alias("ok"),
        (_k() % 10 == 0).alias("fallback"),
        F.expr("concat('prov', user_id % 3)").alias("provider"),
    )


def points(spark: SparkSession, root: str) -> DataFrame:
    e = table(spark, root, "events").where("event_type in ('click', 'view')")
    return e.select(
        F.col("event_id").alias("point"),
        F.expr("event_id - 1 - event_id % 3").alias("session"),
        F.col("user_id").alias("member"),
        F.expr("(user_id div 5) * 97").alias("trip"),
        "ts",
        (F.col("ts") + F.make_dt_interval(hours=(F.lit(1) + _k() % 12) * 12)).alias("expires"),
        (F.lit(12.9) + (_k() % 20) / F.lit(1000.0) + (F.col("user_id") % 10) / F.lit(2000.0)).alias("lat"),
        (F.lit(77.5) + (_k() % 17) / F.lit(900.0)).alias("lon"),
        F.expr("user_id % 4 <> 0").alias("approximate"),
    )


def sessions(spark: SparkSession, root: str) -> DataFrame:
    e = table(spark, root, "events").where("event_type = 'signup'")
    status = F.when(_k() % 10 == 0, "stopped").when(_k() % 10 == 1, "paused").otherwise("active")
    return e.select(
        F.col("event_id").alias("session"),
        F.col("user_id").alias("member"),
        F.expr("(user_id div 5) * 97").alias("trip"),
        F.col("ts").alias("started"),
        (F.col("ts") + F.make_dt_interval(days=F.lit(1) + _k() % 12)).alias("session_expires"),
        status.alias("status"),
    )


def sources(spark: SparkSession, root: str) -> DataFrame:
    p = table(spark, root, "pages")
    covers = F.when(F.expr("page_id % 4 = 0"), F.array(F.lit("history"))).when(
        F.expr("page_id % 4 = 1"), F.array(F.lit("hours"), F.lit("fees"))
    ).when(F.expr("page_id % 4 = 2"), F.array(F.lit("facts"), F.lit("rules"))).otherwise(F.array().cast("array<string>"))
    return p.select(
        F.col("page_id").alias("source"),
        F.expr("(page_id div 2) * 7").alias("place"),
        F.expr("cast(page_id % 2 as int)").alias("pos"),
        "url",
        pick(SOURCE_TYPES, "page_id % 6").alias("source_type"),
        covers.alias("covers"),
    )


def votes(spark: SparkSession, root: str) -> DataFrame:
    e = table(spark, root, "events")
    return e.select(
        F.col("event_id").alias("vote"),
        F.col("user_id").alias("member"),
        F.expr("(user_id div 5) * 97").alias("trip"),
        _k().alias("subject"),
        F.when(F.col("event_type") == "purchase", "up").when(F.col("event_type") == "error", "down").otherwise("abstain").alias("value"),
        "ts",
    )


def spend(spark: SparkSession, root: str) -> DataFrame:
    """Orders with actual spend and an estimated range from their lines."""
    li = table(spark, root, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sum(F.expr("round(l_extendedprice * (1e0 - l_discount), 2)")).alias("net")
    )
    o = table(spark, root, "orders").select("o_orderkey", "o_totalprice")
    return o.join(li, "o_orderkey").select(
        F.col("o_orderkey").alias("trip"),
        F.col("o_totalprice").alias("actual"),
        (F.col("net") * 0.8).alias("low"),
        (F.col("net") * 1.3).alias("high"),
    )
