"""SQL that gives the same rows as the queries of this folder, where SQL can express them."""

from __future__ import annotations

from waymark.llm import chat, licenses, manifest, quality, ring

WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def _quality_sql(rules: quality.Rules = quality.Rules()) -> str:
    rates = {
        "word_length": "word_chars::DOUBLE / greatest(n_words, 1)", "symbol_rate": "n_symbols::DOUBLE / greatest(n_words, 1)",
        "mark_rate": "n_marks::DOUBLE / greatest(n_words, 1)", "upper_share": "n_upper::DOUBLE / greatest(word_chars, 1)",
        "line_share": "n_dup_lines::DOUBLE / greatest(n_lines, 1)", "repeat_share": "n_repeat_words::DOUBLE / greatest(n_words, 1)",
    }
    per = quality.BINS_PER_E
    bins = " UNION ALL ".join(
        f"SELECT lang, source, '{r}' AS rate, CAST(floor((CASE WHEN {r} > 0 THEN greatest(ln({r}), {quality.LOWEST}) ELSE {quality.LOWEST} END) * {per} + 1e-6) AS INT) AS bin FROM rated WHERE NOT base_failed" for r in rates
    )
    value = f"CASE WHEN min(bin) FILTER (c >= t * ({{q}} - 1e-9)) <= {quality.LOWEST * per} THEN 0.0 ELSE exp((min(bin) FILTER (c >= t * ({{q}} - 1e-9)) + {{edge}}) / {per}) END"
    quantiles = ", ".join(f"{value.format(q=f.quantile, edge=quality.edge(f.quantile))} AS q{i}" for i, f in enumerate(rules.fences))
    limits = ", ".join(f"max(q{i} + (q{i} - m) * {f.reach}) FILTER (rate = '{f.rate}') AS f{i}" for i, f in enumerate(rules.fences))

    def bad(i: int, f: quality.Fence) -> str:
        spare = f"{f.spare}e0 / greatest({quality.UNITS[f.rate]}, 1)"
        return f"coalesce({f.rate} < f{i} - {spare}, false)" if f.quantile < 0.5 else f"coalesce({f.rate} > f{i} + {spare}, false)"

    return f"""
    WITH words AS (SELECT doc_id, lang, source, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
    spread AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM words WHERE len(w) >= 3),
    win AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM spread),
    cover AS (SELECT doc_id, count(DISTINCT i + d) AS n FROM win, (SELECT unnest([0, 1, 2]) AS d) WHERE n > 1 GROUP BY doc_id),
    counted AS (
      SELECT doc_id, lang, source, len(w)::BIGINT AS n_words, length(regexp_replace(body, '{GAP}', '', 'g')) AS word_chars,
        length(regexp_replace(body, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
        coalesce(n, 0) AS n_repeat_words, length(regexp_replace(body, '[^\\p{{Lu}}]+', '', 'g')) AS n_upper, length(regexp_replace(body, '[^!?]+', '', 'g')) AS n_marks
      FROM (SELECT *, list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines FROM words) LEFT JOIN cover USING (doc_id)),
    rated AS (SELECT *, n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words AS base_failed, {', '.join(f'{x} AS {r}' for r, x in rates.items())} FROM counted),
    bins AS ({bins}),
    own AS (SELECT lang, source, rate, bin, count(*) AS n FROM bins GROUP BY ALL), by_lang AS (SELECT lang, rate, bin, sum(n) AS n FROM own GROUP BY ALL), whole AS (SELECT rate, bin, sum(n) AS n FROM own GROUP BY ALL),
    langs AS (SELECT lang, rate, bin, sum(n) AS n FROM (
      SELECT lang, rate, bin, n::DOUBLE AS n FROM by_lang
      UNION ALL SELECT l.lang, l.rate, w.bin, w.n * {rules.prior}e0 / w.t FROM (SELECT DISTINCT lang, rate FROM by_lang) l JOIN (SELECT *, sum(n) OVER (PARTITION BY rate) AS t FROM whole) w ON w.rate = l.rate) GROUP BY ALL),
    blended AS (SELECT lang, source, rate, bin, sum(n) AS n FROM (
      SELECT lang, source, rate, bin, n::DOUBLE AS n FROM own
      UNION ALL SELECT o.lang, o.source, o.rate, l.bin, l.n * {rules.prior}e0 / l.t FROM (SELECT DISTINCT lang, source, rate FROM own) o
        JOIN (SELECT *, sum(n) OVER (PARTITION BY lang, rate) AS t FROM langs) l ON l.rate = o.rate AND l.lang IS NOT DISTINCT FROM o.lang) GROUP BY ALL),
    picked AS (SELECT lang, source, rate, {value.format(q=0.5, edge=quality.edge(0.5))} AS m, {quantiles} FROM (
      SELECT lang, source, rate, bin, sum(n) OVER (PARTITION BY lang, source, rate ORDER BY bin) AS c, sum(n) OVER (PARTITION BY lang, source, rate) AS t FROM blended) GROUP BY ALL),
    limits AS (SELECT lang, source, {limits} FROM picked GROUP BY lang, source)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({' OR '.join(bad(i, f) for i, f in enumerate(rules.fences))}) AS kept
    FROM rated LEFT JOIN limits ON rated.lang IS NOT DISTINCT FROM limits.lang AND rated.source IS NOT DISTINCT FROM limits.source"""


def _licence_sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    punctuation = r"[!-/:-@\[-`{-~\x09-\x0d\x20\x{2010}-\x{2015}\x{2018}-\x{201f}\x{00ab}\x{00bb}\x{00a0}]+"
    known = ", ".join(f"({quote(n)}, {quote(t)})" for n, t in licenses.KNOWN)
    spelled = "MAP {" + ", ".join(f"{quote(a)}: {quote(b)}" for a, b in licenses.SPELLINGS.items()) + "}"
    def digest(x):
        bare = f"regexp_replace(regexp_replace(lower({x}), {quote(licenses.COPYRIGHT_LINE)}, '', 'g'), {quote(punctuation)}, ' ', 'g')"
        return f"md5(trim(array_to_string(list_transform(string_split({bare}, ' '), lambda w: coalesce({spelled}[w], w)), ' '), ' '))"

    return f"""
    WITH known AS (SELECT digest, min(licence) AS licence FROM (SELECT licence, {digest('text')} AS digest FROM (VALUES {known}) v(licence, text)) GROUP BY digest),
    base AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, body, copies FROM (SELECT doc_id, coalesce(text, '') AS body, count(*) AS copies FROM documents GROUP BY ALL)),
    whole AS (SELECT r, doc_id, {digest('body')} AS digest FROM base),
    lines AS (SELECT r, copies, {digest('line')} AS digest FROM (SELECT r, copies, unnest(string_split(body, chr(10))) AS line FROM base)),
    found AS (SELECT r, array_to_string(list_sort(list(DISTINCT licence)), ',') AS notices, CAST(sum(copies) AS BIGINT) AS n_notices FROM lines JOIN known USING (digest) GROUP BY r)
    SELECT doc_id, whole.digest AS digest, known.licence AS licence, coalesce(notices, '') AS notices, coalesce(n_notices, 0) AS n_notices
    FROM whole LEFT JOIN known ON whole.digest = known.digest LEFT JOIN found USING (r)"""


TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e))
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5"""

_ESCAPED = r"replace(replace(replace(replace(replace(replace({x}, '\', '\\'), '<|', '<\.|'), '</s>', '<\./s>'), '<s>', '<\.s>'), '[INST]', '[\.INST]'), '[/INST]', '[\./INST]')"


def _chat_sql() -> str:
    escaped = lambda x: f"(CASE WHEN {x} LIKE '%<' OR {x} LIKE '%[' THEN 2 ELSE 0 END + length({_ESCAPED.replace('{x}', x)}))"
    marks = len(chat.START) + len(chat.SEP) + len(chat.END)
    return f"""
    WITH m AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
      CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
      sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
      CAST(sum({marks} + {escaped('role')} + {escaped('text')}) AS BIGINT) AS formatted_chars
    FROM m GROUP BY conv_id"""


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SEARCH = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
i AS (SELECT row_number() OVER () AS q, item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM benchmark),
c AS (SELECT count(*) AS docs, sum(len(t))::BIGINT AS terms FROM d WHERE len(t) > 0),
tf AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2e0 * any_value(docs) + 2) / (2e0 * count(*) + 1))) AS BIGINT) AS w FROM tf, c GROUP BY term),
s AS (SELECT q, item_id, r, doc_id, CAST(sum(k * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms)))) AS BIGINT) AS score
  FROM (SELECT q, item_id, term, count(*) AS k FROM (SELECT q, item_id, unnest(t) AS term FROM i) GROUP BY ALL) JOIN tf USING (term) JOIN w USING (term), c GROUP BY ALL)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0) WHERE rank <= 10"""


def _crc32_sql(rows: str) -> str:
    """(id, crc) of rows (id, raw: a blob), a byte at a time through the table of the reflected polynomial."""
    return f"""
      SELECT id, xor(list_reduce(list_concat([4294967295], bytes), lambda c, b: xor(t[xor(c & 255, b) + 1], c >> 8)), 4294967295) AS crc
      FROM (SELECT id, list_transform(regexp_extract_all(hex(raw), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes FROM ({rows})),
        (SELECT list(c ORDER BY n) AS t FROM (SELECT n, list_reduce(list_concat([n], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(n)))"""


def _tree_sql(name: str, leaves: str) -> str:
    """Levels (k, lev, idx, d, n) of the trees over leaves (k, idx, d, n); n: nodes on the level."""
    return f"""{name} AS (
      SELECT k, 0 AS lev, idx, d, n FROM ({leaves})
      UNION ALL SELECT k, lev + 1, idx // {manifest.FAN}, sha256(string_agg(d, '' ORDER BY idx)), max(n + {manifest.FAN - 1}) // {manifest.FAN} FROM {name} WHERE n > 1 GROUP BY k, lev, idx // {manifest.FAN})"""


def _manifest_sql() -> str:
    told = lambda c: f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR), '-')"
    head = " || ".join(told(c) for c in manifest.FIELDS[:-1])
    fan = manifest.FAN
    return f"""
    WITH RECURSIVE rows AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS k, sha256({head} || {told('text')}) AS leaf,
        sha256({head} || {told(f"translate(text, '{UPPER}', '{LOWER}')")}) AS small FROM documents),
    crc AS ({_crc32_sql("SELECT r AS id, encode(CAST(doc_id AS VARCHAR)) AS raw FROM rows WHERE doc_id IS NOT NULL")}),
    base AS MATERIALIZED (SELECT r, doc_id, k, leaf, CASE WHEN crc % 5 = 0 THEN small ELSE leaf END AS tampered,
        row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY k) AS n FROM rows LEFT JOIN crc ON r = id),
    {_tree_sql('low', 'SELECT k, idx, leaf AS d, n FROM base')},
    subs AS MATERIALIZED (SELECT k, d AS subroot, row_number() OVER (ORDER BY encode(k)) - 1 AS idx, count(*) OVER () AS n FROM low WHERE n = 1),
    {_tree_sql('high', "SELECT '' AS k, idx, subroot AS d, n FROM subs")},
    levels AS MATERIALIZED (SELECT k, lev, max(lev) OVER (PARTITION BY k) AS depth, idx, d FROM low WHERE n > 1),
    uppers AS MATERIALIZED (SELECT lev, idx, d FROM high WHERE n > 1),
    steps AS MATERIALIZED (
      SELECT b.r, l.lev, (b.idx // CAST(power({fan}, l.lev) AS BIGINT)) AS own, l.idx, l.d FROM base b JOIN levels l ON l.k = b.k AND l.idx // {fan} = b.idx // CAST(power({fan}, l.lev + 1) AS BIGINT)
      UNION ALL
      SELECT b.r, coalesce(x.depth + 1, 0) + u.lev, s.idx // CAST(power({fan}, u.lev) AS BIGINT), u.idx, u.d FROM base b JOIN subs s ON s.k = b.k
        LEFT JOIN (SELECT DISTINCT k, depth FROM levels) x ON x.k = b.k JOIN uppers u ON u.idx // {fan} = s.idx // CAST(power({fan}, u.lev + 1) AS BIGINT)),
    proofs AS (SELECT r, sha256(string_agg(d, '' ORDER BY lev, idx) FILTER (idx <> own)) AS proof FROM steps GROUP BY r),
    folded AS (
      SELECT r, 0 AS lev, tampered AS node FROM base
      UNION ALL SELECT f.r, f.lev + 1, sha256(string_agg(CASE WHEN s.idx = s.own THEN f.node ELSE s.d END, '' ORDER BY s.idx)) FROM folded f JOIN steps s ON s.r = f.r AND s.lev = f.lev GROUP BY f.r, f.lev)
    SELECT doc_id, leaf, subroot, root, coalesce(proof, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
    FROM base JOIN subs USING (k) LEFT JOIN proofs USING (r) JOIN (SELECT r, arg_max(node, lev) AS folded_root FROM folded GROUP BY r) USING (r), (SELECT d AS root FROM high WHERE n = 1)"""


def _ring_sql(x: ring.Ring = ring.Ring()) -> str:
    point = lambda v: f"('0x' || substr(md5({v}), 1, {ring.BITS // 4}))::BIGINT"
    total = x.shards * x.replicas
    return f"""
    WITH RECURSIVE keys AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS raw, {point("coalesce(CAST(doc_id AS VARCHAR), '')")} AS point FROM documents),
    crc AS ({_crc32_sql("SELECT r AS id, raw FROM keys")}),
    nodes AS MATERIALIZED (SELECT shard, point, row_number() OVER (ORDER BY point, shard) - 1 AS arc FROM (SELECT a.s AS shard, {point("a.s || '/' || b.r")} AS point FROM range({x.shards}) a(s), range({x.replicas}) b(r))),
    placed AS MATERIALIZED (
      SELECT r, doc_id, octet_length(raw) + 1 AS size, crc, coalesce(nodes.arc, {total}) AS arc, row_number() OVER (ORDER BY keys.point, doc_id NULLS FIRST, crc, octet_length(raw)) - 1 AS place
      FROM keys JOIN crc ON keys.r = crc.id ASOF LEFT JOIN nodes ON keys.point <= nodes.point),
    views AS MATERIALIZED (SELECT arc, list(shard ORDER BY step) AS prefers FROM (
      SELECT a.arc, b.shard, min((b.arc - a.arc + {total}) % {total}) AS step FROM nodes a, nodes b GROUP BY ALL) GROUP BY arc),
    arcs AS MATERIALIZED (SELECT row_number() OVER (ORDER BY c.arc) AS i, c.arc, n, prefers FROM (SELECT arc, count(*) AS n FROM placed GROUP BY arc) c JOIN views ON views.arc = c.arc % {total}),
    seats AS (SELECT list(n // {x.shards} + CASE WHEN s < n % {x.shards} THEN 1 ELSE 0 END ORDER BY s) AS room FROM (SELECT count(*) AS n FROM placed), range({x.shards}) t(s)),
    walk AS (
      SELECT 0 AS step, 1 AS i, 0::BIGINT AS begun, room AS free, NULL::BIGINT AS arc, NULL::BIGINT AS start, NULL::BIGINT AS shard, NULL::BIGINT AS left_free, 0::BIGINT AS place FROM seats
      UNION ALL
      SELECT step + 1, CASE WHEN taken = n - begun THEN i + 1 ELSE i END, CASE WHEN taken = n - begun THEN 0 ELSE begun + taken END,
        list_transform(free, lambda f, j: CASE WHEN j = pick + 1 THEN f - taken ELSE f END), arc, place, pick, free[pick + 1], place + taken
      FROM (SELECT *, least(n - begun, free[pick + 1]) AS taken FROM (
        SELECT w.step, w.i, w.begun, w.free, w.place, a.arc, a.n, list_filter(a.prefers, lambda s: w.free[s + 1] > 0)[1] AS pick FROM walk w JOIN arcs a ON a.i = w.i))),
    segments AS MATERIALIZED (SELECT arc, start, shard, room[shard + 1] - left_free AS seat FROM walk, seats WHERE arc IS NOT NULL)
    SELECT doc_id, size, crc AS text_crc32, 'rows' AS law, CAST(s.shard AS INT) AS shard, s.seat + p.place - s.start AS slot, CAST(NULL AS INT) AS grown_shard, CAST(h.shard AS INT) AS home_shard
    FROM placed p ASOF JOIN segments s ON p.place >= s.start JOIN nodes h ON h.arc = p.arc % {total}"""


ORACLES = {
    "op2_quality_rules": _quality_sql(),
    "op4_license_scan": _licence_sql(),
    "op8_exact_top_k": TOP_K,
    "op10_chat_format": _chat_sql(),
    "op11_lexical_search": SEARCH,
    "op12_merkle_manifest": _manifest_sql(),
    "op13_ring_shards": _ring_sql(),
}
