"""The same views as SQL, for the comparison queries. Names start with ``v_``."""

from __future__ import annotations

import re

from waymark.functions import constants as K
from waymark.sources import views as V


def sql_map(mapping: dict) -> str:
    key = lambda x: f"'{x}'" if isinstance(x, str) else str(x)
    val = lambda x: f"'{x}'" if isinstance(x, str) else f"{float(x)!r}e0"
    return "MAP{" + ", ".join(f"{key(k)}: {val(v)}" for k, v in mapping.items()) + "}"


def sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def sql_lookup(mapping: dict, key: str, default) -> str:
    tail = f"'{default}'" if isinstance(default, str) else f"{float(default)!r}e0"
    return f"coalesce({sql_map(mapping)}[{key}], {tail})"


def hav(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = (
        f"(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2}))"
        f" * pow(sin(radians({lon2} - {lon1}) / 2), 2))"
    )
    return (
        f"(CASE WHEN {lat1} = {lat2} AND {lon1} = {lon2} THEN 0e0 "
        f"ELSE {2 * K.EARTH_RADIUS_KM}e0 * asin(sqrt(least(1e0, {a}))) END)"
    )


def rnd(expr: str, places: int) -> str:
    return f"round(({expr}) + 1e-9, {places})"


def toks(expr: str) -> str:
    return (
        f"list_filter(regexp_extract_all(lower(coalesce({expr}, '')), '[a-z0-9]+'), "
        f"lambda t: length(t) > 1 AND NOT list_contains({sql_list(K.STOP_WORDS)}, t))"
    )


def topic_case(expr: str) -> str:
    whens = " ".join(
        f"WHEN regexp_matches(lower({expr}), '{pattern}') THEN '{name}'" for name, pattern in K.TOPIC_PATTERNS
    )
    return f"CASE {whens} ELSE 'any' END"


_tags = ", ".join(
    f"('{tag}', '{interest}', {weight!r}e0)"
    for tag, weights in K.TAG_INTERESTS.items()
    for interest, weight in weights.items()
)
_interests = ", ".join(f"('{name}', {i})" for i, name in enumerate(K.INTERESTS))
_prefs = ", ".join(
    f"count(*) FILTER (event_type = '{kind}'{' AND event_id % 2 = 0' if even else ''}) AS n_{name}"
    for name, (kind, even) in V.PREFERENCE_COUNTS.items()
)
_stops = sql_list(K.STOP_WORDS)
_lat = "8 + (((o_orderkey // 128) * 7919) % 2700) / 100e0 + 0.2e0"
_lon = "69 + (((o_orderkey // 128) * 6271) % 2700) / 100e0 + 0.2e0"
_start = "480 + (l_linenumber * 97 + l_partkey) % 600"
_kj = "CAST(json_extract_string(props, '$.k') AS INT)"

VIEWS: dict[str, str] = {
    "v_tags": f"SELECT * FROM (VALUES {_tags}) t(tag, interest, weight)",
    "v_interests": f"SELECT * FROM (VALUES {_interests}) t(interest, pos)",
    "v_places0": f"""
      SELECT p_partkey AS place, p_partkey // 16 AS circuit, p_brand AS cluster, p_name AS name,
        list_filter(list_transform(string_split(p_name, ' '), lambda w: {sql_map(V.WORD_TAGS)}[w]), lambda t: t IS NOT NULL) AS tags,
        {sql_lookup(V.PLACE_KINDS, 'p_type', 'outdoor')} AS kind,
        20 + 5 * p_size AS typ,
        CAST(CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 10 + 5 * p_size + (p_partkey % 5) * 5 END AS INT) AS raw_min,
        CAST(CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE 40 + 5 * p_size - (p_partkey % 6) * 8 END AS INT) AS raw_max,
        ['low','medium','high','very_high','unrated'][CAST(p_partkey % 5 AS INT) + 1] AS crowd,
        ['yes','partial','no','unknown','unrated'][CAST((p_partkey * 11) % 5 AS INT) + 1] AS access,
        CAST(1 + p_partkey % 5 AS INT) AS intensity, CAST(1 + (p_partkey * 3) % 5 AS INT) AS senior,
        CAST(1 + (p_partkey * 7) % 5 AS INT) AS child,
        ((p_partkey * 31) % 1000) / 1000e0 AS quality, ((p_partkey * 17) % 101) / 100e0 AS sens,
        CAST((p_partkey * 13) % 100 AS INT) AS popularity,
        ['high','medium','low','unrated'][CAST(p_partkey % 4 AS INT) + 1] AS confidence,
        p_partkey % 3 <> 0 AS unverified,
        CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE DATE '2023-01-01' + CAST(p_partkey % 900 AS INT) END AS verified_on,
        CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_retailprice END AS raw_fee_min,
        CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_retailprice - 450e0 + (p_partkey % 9) * 100e0 END AS raw_fee_max,
        CAST(360 + 60 * (p_partkey % 5) AS INT) AS opens,
        CAST((360 + 60 * (p_partkey % 5) + 360 + 90 * (p_partkey % 10)) % 1440 AS INT) AS raw_closes,
        p_partkey % 10 <> 9 AS recorded,
        list_filter(range(1, 13), lambda m: (p_partkey + m) % 4 <> 0) AS months,
        8 + (((p_partkey // 16) * 7919) % 2700) / 100e0 + ((p_partkey * 37) % 100) / 250e0 AS lat,
        69 + (((p_partkey // 16) * 6271) % 2700) / 100e0 + ((p_partkey * 53) % 100) / 250e0 AS lon,
        CAST(p_partkey % 5 AS INT) AS n_facts, p_partkey % 2 = 0 AS has_history,
        p_partkey % 3 = 0 AS has_significance, p_partkey % 5 = 0 AS has_etiquette
      FROM part""",
    "v_places": """
      SELECT *, least(coalesce(raw_min, greatest(15, typ // 2)), typ) AS min_dur,
        greatest(coalesce(raw_max, typ * 2), typ) AS max_dur,
        coalesce(raw_fee_min, 0e0) AS fee_min,
        greatest(coalesce(raw_fee_min, 0e0), coalesce(raw_fee_max, raw_fee_min, 0e0)) AS fee_max,
        CASE WHEN raw_closes <= opens THEN raw_closes + 1440 ELSE raw_closes END AS closes
      FROM v_places0""",
    "v_sched": """
      SELECT place, -1 AS dow, opens, closes, false AS is_closed FROM v_places WHERE recorded
      UNION ALL SELECT place, CAST(place % 7 AS INT), 1080, 1260, false FROM v_places WHERE recorded AND place % 6 = 0
      UNION ALL SELECT place, CAST(place % 9 AS INT), NULL, NULL, true FROM v_places WHERE place % 9 < 7""",
    "v_windows": """
      SELECT p.place, w.wd, s.opens, s.closes FROM v_places p, (SELECT unnest(range(0, 7)) AS wd) w
      JOIN v_sched s ON s.place = p.place AND NOT s.is_closed AND (s.dow = -1 OR s.dow = w.wd)
      WHERE NOT EXISTS (SELECT 1 FROM v_sched c WHERE c.place = p.place AND c.is_closed AND c.dow = w.wd)
      UNION ALL
      SELECT p.place, w.wd, 0, 1440 FROM v_places p, (SELECT unnest(range(0, 7)) AS wd) w
      WHERE NOT p.recorded
        AND NOT EXISTS (SELECT 1 FROM v_sched c WHERE c.place = p.place AND c.is_closed AND c.dow = w.wd)""",
    "v_place_interest": """
      SELECT place, interest, max(weight) AS weight
      FROM (SELECT place, unnest(tags) AS tag FROM v_places) JOIN v_tags USING (tag) GROUP BY ALL""",
    "v_trips": f"""
      SELECT *, coalesce(origin_lat, centre_lat) AS base_lat, coalesce(origin_lon, centre_lon) AS base_lon FROM (
      SELECT o_orderkey AS trip, o_custkey AS owner, o_orderkey // 128 AS circuit,
        CAST(o_orderdate AS DATE) AS start_date, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 5 AS INT) AS end_date,
        CAST(o_orderkey % 5 + 1 AS INT) AS days, o_orderstatus AS status,
        CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_totalprice / 100e0 END AS budget,
        CASE o_orderpriority WHEN '5-LOW' THEN 'relaxed' WHEN '1-URGENT' THEN 'packed' WHEN '2-HIGH' THEN 'packed' ELSE 'balanced' END AS pace,
        {sql_list(V.MODES)}[CAST(o_orderkey % 5 AS INT) + 1] AS mode,
        {sql_list(V.TIERS)}[CAST(o_orderkey % 3 AS INT) + 1] AS tier,
        CAST(1 + o_orderkey % 6 AS INT) AS travellers, 540 AS day_start,
        CAST(1080 + 60 * (o_orderkey % 3) AS INT) AS day_end,
        o_orderkey % 9 = 0 AS needs_access, o_orderkey % 7 = 0 AS seniors, o_orderkey % 4 = 0 AS children,
        CASE WHEN o_orderkey % 6 = 5 THEN [(o_orderkey // 128) * 16 + o_orderkey % 16] ELSE [] END AS must_own,
        CASE WHEN o_orderkey % 4 = 0 THEN [(o_orderkey // 128) * 16 + o_orderkey % 16, (o_orderkey // 128) * 16 + (o_orderkey + 7) % 16] ELSE [] END AS avoid_own,
        CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE {_lat} + (o_orderkey % 50) / 100e0 END AS origin_lat,
        CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE {_lon} + (o_orderkey % 50) / 200e0 END AS origin_lon,
        {_lat} AS centre_lat, {_lon} AS centre_lon
      FROM orders)""",
    "v_counts": f"SELECT user_id AS member, {_prefs} FROM events GROUP BY user_id",
    "v_prefs": "SELECT member, interest, CASE WHEN n = 0 THEN NULL ELSE 5e0 * n / top END AS pref FROM ("
    + " UNION ALL ".join(
        f"SELECT member, '{name}' AS interest, n_{name} AS n, greatest({', '.join(f'n_{x}' for x in V.PREFERENCE_COUNTS)}) AS top FROM v_counts"
        for name in K.INTERESTS
    )
    + ")",
    "v_members": """
      SELECT member, (member // 5) * 97 AS trip, CAST(1 + member % 2 AS DOUBLE) AS weight,
        list_transform(CASE WHEN member % 4 = 0 THEN [0] WHEN member % 12 = 5 THEN [0, 5, 9] ELSE [] END, lambda d: ((member // 5) * 97 // 128) * 16 + (member + d) % 16) AS must_places,
        list_transform(CASE WHEN member % 14 = 0 THEN [3, 8] WHEN member % 7 = 0 THEN [3] ELSE [] END, lambda d: ((member // 5) * 97 // 128) * 16 + (member * 5 + d) % 16) AS avoid_places,
        CASE WHEN member % 3 = 0 THEN [((member // 5) * 97 // 128) * 16 + (member * 3) % 16,
          ((member // 5) * 97 // 128) * 16 + (member * 3 + 5) % 16] ELSE [] END AS ranked,
        CASE WHEN member % 11 = 0 THEN 'wheelchair' WHEN member % 5 = 1 THEN 'limited_walking' ELSE 'full' END AS mobility,
        member % 6 = 0 AS is_senior, member % 8 = 0 AS is_child,
        CASE WHEN member % 10 = 9 THEN 'opted_out' ELSE 'joined' END AS status
      FROM v_counts""",
    "v_utility": """
      SELECT trip, member, place, circuit, must_places, weight,
        round(greatest(0e0, least(1e0, CASE
          WHEN an IS NULL OR mn = 0 THEN 0e0
          WHEN list_contains(must_places, place) THEN 1e0
          WHEN list_contains(avoid_places, place) THEN 0e0
          WHEN list_contains(ranked, place)
            THEN least(1e0, dot / (sqrt(mn) * sqrt(an)) + 0.35e0 * (1e0 - (list_position(ranked, place) - 1) / 2e0))
          ELSE dot / (sqrt(mn) * sqrt(an)) END)) + 1e-9, 6) AS u
      FROM (
        SELECT t.trip, m.member, m.weight, p.place, p.circuit, m.must_places, m.avoid_places, m.ranked,
          sum(coalesce(f.pref, 3e0) / 5e0 * coalesce(i.weight, 0e0)) AS dot,
          sum(pow(coalesce(f.pref, 3e0) / 5e0, 2)) AS mn,
          sum(pow(i.weight, 2)) AS an
        FROM v_members m JOIN v_trips t ON t.trip = m.trip JOIN v_places p ON p.circuit = t.circuit
        JOIN v_prefs f ON f.member = m.member
        LEFT JOIN v_place_interest i ON i.place = p.place AND i.interest = f.interest
        WHERE m.status <> 'opted_out'
        GROUP BY ALL)""",
    "v_acts": f"""
      SELECT l_orderkey AS plan, CAST(l_linenumber % 2 AS INT) AS day, l_partkey AS place,
        CAST({_start} AS INT) AS start_min, CAST({_start} + 20 + l_quantity AS INT) AS end_min,
        CASE WHEN l_returnflag = 'R' THEN 'meal' ELSE 'visit' END AS kind,
        CAST((l_suppkey * 7) % 45 AS INT) AS travel_min, l_tax * 250e0 + 1e0 AS travel_km,
        1e0 - l_discount * 8e0 AS weather, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 2 END AS version,
        l_quantity AS qty, l_extendedprice AS price, l_discount AS discount
      FROM lineitem""",
    "v_chunks": f"""
      SELECT *, concat_ws(' ', topic, 'of', place, 'in', cluster) AS heading FROM (
      SELECT doc_id * {V.SPAN} + pos AS chunk, doc_id, pos, lang AS cluster, source AS place,
        {sql_list(K.TOPICS)}[CAST((doc_id + pos) % 6 AS INT) + 1] AS topic,
        {sql_list(V.SOURCE_TYPES)}[CAST(doc_id % 6 AS INT) + 1] AS source_type, body
      FROM (SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS body,
              unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM documents)
      WHERE body <> '')""",
    "v_questions": f"""
      SELECT item_id AS q, {sql_list(V.PHRASES)}[CAST(item_id % 7 AS INT) + 1] || ' ' || text AS question, text AS passage,
        {sql_list(V.CLUSTERS)}[CAST(CASE WHEN item_id % 5 = 4 THEN item_id % 4 ELSE 0 END AS INT) + 1] AS cluster,
        CASE WHEN item_id % 3 = 0 THEN NULL ELSE 'src' || (item_id % 21) END AS place
      FROM benchmark""",
    "v_calls": f"""
      SELECT event_id AS call, event_type AS service, ts, value AS latency,
        CASE WHEN event_type = 'error' THEN {_kj} % 2 = 0 ELSE {_kj} % 13 <> 0 END AS ok,
        {_kj} % 10 = 0 AS fallback, 'prov' || (user_id % 3) AS provider FROM events""",
    "v_points": f"""
      SELECT event_id AS point, event_id - 1 - event_id % 3 AS session, user_id AS member, (user_id // 5) * 97 AS trip, ts,
        ts + to_hours((1 + {_kj} % 12) * 12) AS expires,
        12.9e0 + ({_kj} % 20) / 1000e0 + (user_id % 10) / 2000e0 AS lat, 77.5e0 + ({_kj} % 17) / 900e0 AS lon,
        user_id % 4 <> 0 AS approximate
      FROM events WHERE event_type IN ('click', 'view')""",
    "v_sessions": f"""
      SELECT event_id AS session, user_id AS member, (user_id // 5) * 97 AS trip, ts AS started,
        ts + to_days(1 + {_kj} % 12) AS session_expires,
        CASE WHEN {_kj} % 10 = 0 THEN 'stopped' WHEN {_kj} % 10 = 1 THEN 'paused' ELSE 'active' END AS status
      FROM events WHERE event_type = 'signup'""",
    "v_sources": f"""
      SELECT page_id AS source, (page_id // 2) * 7 AS place, CAST(page_id % 2 AS INT) AS pos, url,
        {sql_list(V.SOURCE_TYPES)}[CAST(page_id % 6 AS INT) + 1] AS source_type,
        CASE page_id % 4 WHEN 0 THEN ['history'] WHEN 1 THEN ['hours','fees'] WHEN 2 THEN ['facts','rules'] ELSE [] END AS covers
      FROM pages""",
    "v_votes": f"""
      SELECT event_id AS vote, user_id AS member, (user_id // 5) * 97 AS trip, {_kj} AS subject,
        CASE event_type WHEN 'purchase' THEN 'up' WHEN 'error' THEN 'down' ELSE 'abstain' END AS value, ts FROM events""",
    "v_spend": """
      SELECT o_orderkey AS trip, o_totalprice AS actual, net * 0.8e0 AS low, net * 1.3e0 AS high
      FROM orders JOIN (SELECT l_orderkey, sum(round(l_extendedprice * (1e0 - l_discount), 2)) AS net
        FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""",
}


def needed(text: str, found: dict[str, None] | None = None) -> dict[str, None]:
    found = {} if found is None else found
    for name in re.findall(r"\bv_\w+\b", text):
        if name in VIEWS and name not in found:
            needed(VIEWS[name], found)
            found[name] = None
    return found


def with_views(body: str) -> str:
    """Prefix ``body`` with the views it names, merging a WITH clause of its own."""
    body = body.strip()
    head = [f"{name} AS MATERIALIZED ({VIEWS[name].strip()})" for name in needed(body)]
    recursive = re.match(r"(?i)WITH\s+RECURSIVE\b", body)
    own = re.match(r"(?i)WITH\s+(RECURSIVE\s+)?", body)
    if not head:
        return body
    lead = "WITH RECURSIVE " if recursive else "WITH "
    if own:
        return lead + ",\n".join(head) + ",\n" + body[own.end():]
    return lead + ",\n".join(head) + "\n" + body
