"""Queries: corpus building, hybrid retrieval, answers and their evaluation."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from waymark.functions import clock, constants as K, text
from waymark.functions.stats import rnd
from waymark.operators import embedding as E, grouped, retrieval as R
from waymark.plans.registry import query
from waymark.plans.shaping import BAIT, FEES_SQL, INJECT, LIVE, MONTHS_SQL, SCHED_SQL, SENTENCES, fees_text, schedule_text
from waymark.plans.view_sql import VIEWS, rnd as r, sql_list, sql_lookup, toks, topic_case
from waymark.session import cut
from waymark.sources import views as V
from waymark.sources.tables import table


def parts(spark, root):
    chunks = V.chunks(spark, root)
    return R.with_scope(V.questions(spark, root), chunks), chunks


def prepared(spark, root):
    """Scoped questions and the chunk index, both written once."""
    index = R.chunk_index(V.chunks(spark, root))
    return cut(R.with_scope(V.questions(spark, root), index), "questions"), index


def pooled(spark, root):
    """Both retrieval pools of every question, written once and read by all later stages."""
    questions, index = prepared(spark, root)
    return cut(R.arms(questions, index), "pools"), questions, index


def final_chunks(spark, root, strategy="hybrid", reranked=True):
    pools, questions, chunks = pooled(spark, root)
    return cut(R.rerank(R.fuse(pools, strategy), questions, chunks, reranked), "final"), questions, chunks


# ------------------------------------------------------------------ SQL twins of the stages
VIEWS["v_qtopic"] = f"SELECT q, question, passage, cluster, place, nullif({topic_case('question')}, 'any') AS topic FROM v_questions"
VIEWS["v_scope"] = """
  SELECT q, question, passage, cluster, topic, CASE WHEN lv <= 2 THEN place END AS sp, CASE WHEN lv IN (1, 3) THEN topic END AS st FROM (
    SELECT *, CASE WHEN (SELECT count(*) FROM v_chunks c WHERE c.cluster = x.cluster AND (x.place IS NULL OR c.place = x.place) AND (x.topic IS NULL OR c.topic = x.topic)) >= 2 THEN 1
      WHEN (SELECT count(*) FROM v_chunks c WHERE c.cluster = x.cluster AND (x.place IS NULL OR c.place = x.place)) > 0 THEN 2
      WHEN (SELECT count(*) FROM v_chunks c WHERE c.cluster = x.cluster AND (x.topic IS NULL OR c.topic = x.topic)) > 0 THEN 3 ELSE 4 END AS lv FROM v_qtopic x)"""
VIEWS["v_cand"] = "SELECT s.q, c.chunk FROM v_scope s JOIN v_chunks c ON c.cluster = s.cluster AND (s.sp IS NULL OR c.place = s.sp) AND (s.st IS NULL OR c.topic = s.st)"
VIEWS["v_tok"] = f"SELECT chunk, unnest({toks('''heading || ' ' || body''')}) AS term FROM v_chunks WHERE chunk IN (SELECT chunk FROM v_cand)"
VIEWS["v_tf"] = "SELECT chunk, term, count(*) AS tf FROM v_tok GROUP BY ALL"
VIEWS["v_qt"] = f"SELECT DISTINCT q, unnest({toks('question')}) AS term FROM v_questions"
VIEWS["v_bm25"] = f"""
  SELECT h.q, h.chunk, {r('sum(ln(1 + (s.n - d.df + 0.5e0) / (d.df + 0.5e0)) * h.tf * 2.5e0 / (h.tf + 1.5e0 * (0.25e0 + 0.75e0 * h.len / s.avg_len)))', 9)} AS lexical
  FROM (SELECT c.q, c.chunk, t.term, t.tf, l.len FROM v_cand c JOIN v_tf t ON t.chunk = c.chunk JOIN v_qt q ON q.q = c.q AND q.term = t.term JOIN (SELECT chunk, sum(tf) AS len FROM v_tf GROUP BY 1) l ON l.chunk = c.chunk) h
  JOIN (SELECT c.q, count(*) AS n, avg(coalesce(l.len, 0)) AS avg_len FROM v_cand c LEFT JOIN (SELECT chunk, sum(tf) AS len FROM v_tf GROUP BY 1) l ON l.chunk = c.chunk GROUP BY 1) s ON s.q = h.q
  JOIN (SELECT c.q, t.term, count(*) AS df FROM v_cand c JOIN v_tf t ON t.chunk = c.chunk JOIN v_qt q ON q.q = c.q AND q.term = t.term GROUP BY ALL) d ON d.q = h.q AND d.term = h.term GROUP BY h.q, h.chunk"""


def vectors_sql(source: str) -> str:
    """Sparse unit vectors (id, idx, v) of ``source`` (id, t: token list)."""
    return f"""
      SELECT id, idx, v / sqrt(sum(v * v) OVER (PARTITION BY id)) AS v FROM (
        SELECT id, idx, sum(w) AS v FROM (
          SELECT id, ('0x' || substr(h, 1, 15))::BIGINT % {K.EMBED_DIM} AS idx, CASE WHEN substr(h, 16, 1) >= '8' THEN 1e0 ELSE -1e0 END * kw * (1 + ln(n)) AS w FROM (
            SELECT id, md5(f) AS h, CASE substr(f, 1, 1) WHEN 'w' THEN 1e0 WHEN 'b' THEN 0.85e0 ELSE 0.35e0 END AS kw, count(*) AS n FROM (
              SELECT id, unnest(list_concat(list_transform(t, lambda x: 'w:' || x),
                CASE WHEN len(t) > 1 THEN list_transform(range(1, len(t)), lambda i: 'b:' || t[i] || '_' || t[i + 1]) ELSE [] END,
                list_transform(list_filter(list_concat([], flatten(list_transform(t, lambda x: list_transform(range(1, length(x) - 2), lambda i: substr(x, i, 4))))), lambda g: g <> ''), lambda g: 'c:' || g))) AS f FROM {source})
            GROUP BY id, f)) GROUP BY id, idx) WHERE v <> 0"""


VIEWS["v_cvec_src"] = f"SELECT chunk AS id, {toks('heading || chr(10) || body')} AS t FROM v_chunks WHERE chunk IN (SELECT chunk FROM v_cand)"
VIEWS["v_cvec"] = vectors_sql("v_cvec_src")
VIEWS["v_qvec_src"] = f"SELECT q AS id, {toks('question')} AS t FROM v_questions"
VIEWS["v_qvec"] = vectors_sql("v_qvec_src")
VIEWS["v_dense"] = f"""
  SELECT c.q, c.chunk, coalesce(round(x.d + 1e-9, 9), 0e0) AS dense FROM v_cand c LEFT JOIN (
    SELECT c.q, c.chunk, sum(a.v * b.v) AS d FROM v_cand c JOIN v_cvec a ON a.id = c.chunk JOIN v_qvec b ON b.id = c.q AND b.idx = a.idx GROUP BY ALL) x ON x.q = c.q AND x.chunk = c.chunk"""
VIEWS["v_dense30"] = "SELECT q, chunk, dense, dense_rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY dense DESC, chunk) AS dense_rank FROM v_dense) WHERE dense_rank <= 30"
VIEWS["v_lex30"] = "SELECT q, chunk, lexical, lexical_rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY lexical DESC, chunk) AS lexical_rank FROM v_bm25 WHERE lexical > 0) WHERE lexical_rank <= 30"
VIEWS["v_pools"] = "SELECT coalesce(d.q, l.q) AS q, coalesce(d.chunk, l.chunk) AS chunk, dense_rank, lexical_rank FROM v_dense30 d FULL OUTER JOIN v_lex30 l ON d.q = l.q AND d.chunk = l.chunk"
_own = {"hybrid": "coalesce(1e0 / (60 + dense_rank), 0e0) + coalesce(1e0 / (60 + lexical_rank), 0e0)", "dense": "1e0 / (60 + dense_rank)", "lexical": "1e0 / (60 + lexical_rank)"}
_used = {"hybrid": "true", "dense": "dense_rank IS NOT NULL", "lexical": "lexical_rank IS NOT NULL"}
_fallback = {"dense": "lexical", "lexical": "dense"}


def fused_sql(strategy: str) -> str:
    own = f"SELECT q, chunk, {r(_own[strategy], 6)} AS fused FROM v_pools WHERE {_used[strategy]}"
    if strategy == "hybrid":
        return own
    other = _fallback[strategy]
    return own + f" UNION ALL SELECT q, chunk, {r(_own[other], 6)} FROM v_pools p WHERE {_used[other]} AND NOT EXISTS (SELECT 1 FROM v_pools x WHERE x.q = p.q AND x.{_used[strategy]})"


for _s in ("hybrid", "dense", "lexical"):
    VIEWS[f"v_fused_{_s}"] = fused_sql(_s)
    VIEWS[f"v_reranked_{_s}"] = f"""
      SELECT f.q, f.chunk, f.fused, c.doc_id, c.heading, c.body, c.topic AS chunk_topic, c.place AS chunk_place, c.source_type, s.question, s.topic, s.passage,
        {r(f'''0.45e0 * f.fused / max(f.fused) OVER (PARTITION BY f.q)
          + 0.22e0 * coalesce(len(list_intersect(list_distinct({toks('s.question')}), list_distinct({toks('c.body')}))) / CAST(nullif(len(list_distinct({toks('s.question')})), 0) AS DOUBLE), 0e0)
          + 0.13e0 * coalesce(len(list_intersect(list_distinct({toks('s.question')}), list_distinct({toks('c.heading')}))) / CAST(nullif(len(list_distinct({toks('s.question')})), 0) AS DOUBLE), 0e0)
          + 0.12e0 * coalesce((c.topic = s.topic)::INT, 0) + 0.08e0 * {sql_lookup(K.SOURCE_AUTHORITY, 'c.source_type', 0.5)}''', 6)} AS rerank
      FROM v_fused_{_s} f JOIN v_chunks c ON c.chunk = f.chunk JOIN v_scope s ON s.q = f.q"""
    VIEWS[f"v_final_{_s}"] = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY rerank DESC, chunk) AS rank FROM v_reranked_{_s}) WHERE rank <= 5"
    VIEWS[f"v_plain_{_s}"] = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY fused DESC, chunk) AS rank FROM v_reranked_{_s}) WHERE rank <= 5"


# ------------------------------------------------------------------ embedding and corpus
CHECK = f"count(*) FILTER (abs(v) > 1e-9) AS filled, {r('sum(v * (idx + 1))', 6)} AS weighted, {r('max(abs(v))', 6)} AS peak"


def vector_check(rows, key):
    """Filled buckets, position-weighted sum and largest entry of the vectors of (key, text)."""
    unit = E.vectors(rows, [key], text.tokens(F.col("text"))).where(F.size("b") > 0)
    moved = F.aggregate(F.arrays_zip("b", "v"), F.lit(0.0), lambda s, x: s + x["v"] * (x["b"] + 1))
    most = F.greatest(F.array_max("v"), -F.array_min("v"))
    return unit.select(key, F.size("b").cast("long").alias("filled"), rnd(moved, 6).alias("weighted"), rnd(most, 6).alias("peak"))


_all_chunks = f"(SELECT chunk AS id, {toks('heading || chr(10) || body')} AS t FROM v_chunks)"


@query("R1_hash_embedding", f"SELECT id AS chunk, {CHECK} FROM ({vectors_sql(_all_chunks)}) GROUP BY id")
def r1(spark, root):
    texts = V.chunks(spark, root).select("chunk", F.concat_ws("\n", "heading", "body").alias("text"))
    return vector_check(texts, "chunk")


def topic_texts(places):
    """Heading and body per topic of a place; null where there is nothing to say."""
    name, col = F.col("name"), F.concat
    says = {
        "history": (F.when(F.col("has_history"), col(F.lit("History of "), name)), col(name, F.lit(" has a recorded history."))),
        "significance": (F.when(F.col("has_significance"), col(F.lit("Why "), name, F.lit(" matters"))), col(name, F.lit(" is a place of note."))),
        "facts": (F.when(F.col("n_facts") > 0, col(F.lit("Notable facts about "), name)), col(F.col("n_facts").cast("string"), F.lit(" lesser-known details about "), name)),
        "visiting": (
            col(F.lit("Visiting "), name),
            col(F.lit("A typical visit takes about "), clock.duration_text(F.col("typ")), F.lit(" (plan between "), clock.duration_text(F.col("min_dur")), F.lit(" and "),
                clock.duration_text(F.col("max_dur")), F.lit("). Suitable months: "), clock.months_text(F.col("months")), F.lit(". Opening hours: "), schedule_text(), F.lit(". Entry: "), fees_text(), F.lit(".")),
        ),
        "accessibility": (
            col(F.lit("Accessibility at "), name),
            col(F.lit("Step-free access: "), F.col("access"), F.lit(". Rated "), F.col("senior").cast("string"), F.lit("/5 for seniors and "), F.col("child").cast("string"), F.lit("/5 for children.")),
        ),
        "etiquette": (F.when(F.col("has_etiquette"), col(F.lit("Etiquette at "), name)), col(F.lit("Dress code applies at "), name, F.lit("."))),
    }
    told = F.array(*[F.struct(F.lit(t).alias("topic"), h.alias("heading"), b.alias("body")) for t, (h, b) in says.items()])
    return places.select("place", "circuit", F.inline(told)).where("heading is not null")


DUR = "CASE WHEN {x} // 60 > 0 AND {x} % 60 > 0 THEN ({x} // 60) || 'h ' || ({x} % 60) || 'm' WHEN {x} // 60 > 1 THEN ({x} // 60) || ' hours' WHEN {x} // 60 = 1 THEN '1 hour' ELSE ({x} % 60) || ' minutes' END"


@query("R2_derived_corpus", f"""
  SELECT doc_key, topic, heading, md5(body) AS body_md5, greatest(1, length(body) // 4) AS tokens FROM (
    SELECT 'place::' || place AS doc_key, 'history' AS topic, 'History of ' || name AS heading, name || ' has a recorded history.' AS body FROM v_places WHERE has_history
    UNION ALL SELECT 'place::' || place, 'significance', 'Why ' || name || ' matters', name || ' is a place of note.' FROM v_places WHERE has_significance
    UNION ALL SELECT 'place::' || place, 'facts', 'Notable facts about ' || name, n_facts || ' lesser-known details about ' || name FROM v_places WHERE n_facts > 0
    UNION ALL SELECT 'place::' || place, 'visiting', 'Visiting ' || name, 'A typical visit takes about ' || {DUR.format(x='typ')} || ' (plan between ' || {DUR.format(x='min_dur')} || ' and ' || {DUR.format(x='max_dur')} || '). Suitable months: ' || {MONTHS_SQL} || '. Opening hours: ' || {SCHED_SQL} || '. Entry: ' || {FEES_SQL} || '.' FROM v_places p
    UNION ALL SELECT 'place::' || place, 'accessibility', 'Accessibility at ' || name, 'Step-free access: ' || access || '. Rated ' || senior || '/5 for seniors and ' || child || '/5 for children.' FROM v_places
    UNION ALL SELECT 'place::' || place, 'etiquette', 'Etiquette at ' || name, 'Dress code applies at ' || name || '.' FROM v_places WHERE has_etiquette
    UNION ALL SELECT 'circuit::' || circuit, 'overview', 'About circuit ' || circuit, count(*) || ' places, ' || count(DISTINCT kind) || ' kinds.' FROM v_places GROUP BY circuit)""")
def r2(spark, root):
    places = V.places(spark, root)
    per_place = topic_texts(places).select(F.concat(F.lit("place::"), "place").alias("doc_key"), "topic", "heading", "body")
    overview = places.groupBy("circuit").agg(F.count("*").alias("n"), F.count_distinct("kind").alias("kinds")).select(
        F.concat(F.lit("circuit::"), "circuit").alias("doc_key"), F.lit("overview").alias("topic"), F.concat(F.lit("About circuit "), "circuit").alias("heading"),
        F.concat(F.col("n").cast("string"), F.lit(" places, "), F.col("kinds").cast("string"), F.lit(" kinds.")).alias("body"),
    )
    return per_place.unionByName(overview).select("doc_key", "topic", "heading", F.md5("body").alias("body_md5"), text.token_estimate(F.col("body")).cast("long").alias("tokens"))


@query("R3_content_hash_sync", """
  WITH o AS (SELECT doc_id AS k, sha256(text) AS h, len(string_split(text, chr(10))) AS n FROM documents),
  w AS (SELECT doc_id AS k, text || CASE WHEN doc_id % 3 = 0 THEN chr(10) || 'revised' ELSE '' END AS t FROM documents UNION ALL SELECT -1 - doc_id, text FROM documents WHERE doc_id % 5 = 0),
  x AS (SELECT k, sha256(t) AS h, len(string_split(t, chr(10))) AS n FROM w)
  SELECT x.k AS doc_key, CASE WHEN o.k IS NULL THEN 'new' WHEN o.h <> x.h THEN 'changed' ELSE 'unchanged' END AS state, CASE WHEN o.k IS NULL OR o.h <> x.h THEN x.n ELSE 0 END AS rechunked, x.n AS chunks
  FROM x LEFT JOIN o ON o.k = x.k""")
def r3(spark, root):
    docs = table(spark, root, "documents").select("doc_id", "text")
    revised = docs.select(F.col("doc_id").alias("doc_key"), F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("\nrevised"))).otherwise(F.col("text")).alias("text"))
    added = docs.where("doc_id % 5 = 0").select((-1 - F.col("doc_id")).alias("doc_key"), "text")
    return sync_plan(docs.withColumnRenamed("doc_id", "doc_key"), revised.unionByName(added))


def sync_plan(stored, incoming):
    """New, changed or unchanged per document by content hash, and the chunks to rebuild.

    Only keys and hashes are joined; the texts are not shuffled.
    """
    old = stored.select("doc_key", F.sha2("text", 256).alias("old_hash"))
    new = incoming.select("doc_key", F.sha2("text", 256).alias("hash"), F.size(F.split("text", "\n")).cast("long").alias("chunks"))
    state = F.when(F.col("old_hash").isNull(), "new").when(F.col("old_hash") != F.col("hash"), "changed").otherwise("unchanged")
    return new.join(old, "doc_key", "left").select(
        "doc_key", state.alias("state"), F.when(state == "unchanged", 0).otherwise(F.col("chunks")).cast("long").alias("rechunked"), "chunks"
    )


_pending = f"(SELECT doc_id AS id, {toks('text')} AS t FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings))"


@query("R4_incremental_embedding", f"SELECT id AS doc_id, {CHECK} FROM ({vectors_sql(_pending)}) GROUP BY id")
def r4(spark, root):
    stored = table(spark, root, "embeddings").select(F.col("vec_id").alias("doc_id"))
    pending = V.documents(spark, root).select("doc_id", "text").join(stored, "doc_id", "left_anti")
    return vector_check(pending, "doc_id")


# ------------------------------------------------------------------ retrieval stages
@query("R5_candidate_widening", "SELECT s.q, s.sp AS place, s.st AS topic, count(*) AS candidates FROM v_scope s JOIN v_cand c ON c.q = s.q GROUP BY ALL")
def r5(spark, root):
    questions, _ = parts(spark, root)
    named = lambda i: F.nullif(F.split_part("scope", F.lit("|"), F.lit(i)), F.lit("*"))
    return questions.select("q", named(2).alias("place"), named(3).alias("topic"), "candidates")


@query("R6_dense_scores", "SELECT q, chunk, dense, dense_rank FROM v_dense30")
def r6(spark, root):
    questions, index = prepared(spark, root)
    return E.dense_top(index, questions)


@query("R7_bm25", "SELECT q, chunk, lexical FROM v_bm25")
def r7(spark, root):
    questions, index = prepared(spark, root)
    return R.lexical_scores(questions, index)


@query("W8_retrieval_ranks", "SELECT q, chunk, dense_rank, lexical_rank FROM v_pools")
def w8(spark, root):
    return pooled(spark, root)[0].select("q", "chunk", "dense_rank", "lexical_rank")


@query("K1_pools_per_question", "SELECT q, count(dense_rank) AS dense_pool, count(lexical_rank) AS lexical_pool, count(*) AS pooled FROM v_pools GROUP BY q")
def k1(spark, root):
    return pooled(spark, root)[0].groupBy("q").agg(F.count("dense_rank").alias("dense_pool"), F.count("lexical_rank").alias("lexical_pool"), F.count("*").alias("pooled"))


@query("R8_rank_fusion", " UNION ALL ".join(f"SELECT '{s}' AS strategy, q, chunk, fused FROM v_fused_{s}" for s in ("hybrid", "dense", "lexical")))
def r8(spark, root):
    pools = pooled(spark, root)[0]
    each = [R.fuse(pools, s).select(F.lit(s).alias("strategy"), "q", "chunk", "fused") for s in ("hybrid", "dense", "lexical")]
    return each[0].unionByName(each[1]).unionByName(each[2])


@query("R9_rerank", "SELECT q, chunk, rank, rerank FROM v_final_hybrid")
def r9(spark, root):
    return final_chunks(spark, root)[0].select("q", "chunk", F.col("rank").cast("long").alias("rank"), "rerank")


SYN = ", ".join(f"('{h}', '{s}')" for h, t in K.SYNONYMS.items() for s in t)
VIEWS["v_accept"] = f"SELECT q, term, term AS ok FROM v_qterms UNION ALL SELECT q, term, s.ok FROM v_qterms JOIN (VALUES {SYN}) s(head, ok) ON s.head = term"
VIEWS["v_corpus_df"] = f"SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({toks('''heading || ' ' || body''')})) AS term FROM v_chunks) GROUP BY term"
VIEWS["v_qidf"] = "SELECT t.q, t.term, ln(1 + (SELECT count(*) FROM v_chunks) / (1e0 + coalesce(d.df, 0))) AS w FROM v_qterms t LEFT JOIN v_corpus_df d ON d.term = t.term"
VIEWS["v_evid"] = f"""
  SELECT f.q, {r('max(0.35e0 * greatest(0e0, least(1e0, round(d.dense + 1e-9, 6))) + 0.65e0 * coalesce(cov.w, 0e0) / t.total)', 4)} AS evidence FROM v_final_hybrid f JOIN v_dense d ON d.q = f.q AND d.chunk = f.chunk
  JOIN (SELECT q, sum(w) AS total FROM v_qidf GROUP BY 1) t ON t.q = f.q
  LEFT JOIN (SELECT q, chunk, sum(w) AS w FROM (SELECT DISTINCT f.q, f.chunk, i.term, i.w FROM v_final_hybrid f JOIN v_qidf i ON i.q = f.q JOIN v_accept a ON a.q = i.q AND a.term = i.term
    JOIN v_tf x ON x.chunk = f.chunk AND x.term = a.ok) GROUP BY 1, 2) cov ON cov.q = f.q AND cov.chunk = f.chunk GROUP BY f.q"""


def evidence(spark, root):
    final, questions, chunks = final_chunks(spark, root)
    return R.evidence(final, R.corpus_idf(questions, chunks)), final, questions


@query("R10_evidence_score", "SELECT q, evidence FROM v_evid")
def r10(spark, root):
    return evidence(spark, root)[0]


@query("R11_abstention", f"SELECT q.q, coalesce(e.evidence, 0e0) < {K.MIN_EVIDENCE}e0 AS abstained, {r('least(1e0, coalesce(e.evidence, 0e0) / 0.6e0)', 4)} AS confidence FROM v_questions q LEFT JOIN v_evid e ON e.q = q.q")
def r11(spark, root):
    found, _, questions = evidence(spark, root)
    score = F.coalesce("evidence", F.lit(0.0))
    return questions.select("q").join(found, "q", "left").select("q", (score < K.MIN_EVIDENCE).alias("abstained"), rnd(F.least(F.lit(1.0), score / 0.6), 4).alias("confidence"))


def _sent(c):
    return SENTENCES.format(c=c)


VIEWS["v_answers"] = f"""
  SELECT q, CASE WHEN told = '' THEN first_body ELSE told END AS answer FROM (
    SELECT q, coalesce(string_agg(part, chr(10) || chr(10) ORDER BY rank) FILTER (part <> ''), '') AS told, arg_min(body, rank) AS first_body FROM (
      SELECT q, rank, body, array_to_string(list_filter({_sent('body')}, lambda s: length(s) > 25)[1:3], ' ') AS part
      FROM (SELECT q, rank, trim(regexp_replace(body, '\\s+', ' ', 'g')) AS body FROM v_final_hybrid WHERE rank <= 3)) GROUP BY q)"""


@query("R12_extractive_answer", "SELECT q, answer FROM v_answers")
def r12(spark, root):
    return R.compose(final_chunks(spark, root)[0])


VIEWS["v_spoken"] = f"""
  SELECT q, pos, trim(sentence) AS sentence FROM (SELECT q, unnest({_sent('trim(answer)')}) AS sentence, unnest(range(0, len({_sent('trim(answer)')}))) AS pos FROM v_answers) WHERE trim(sentence) <> ''"""
VIEWS["v_cited"] = f"""
  SELECT q, pos, sentence, CASE WHEN share >= 0.3e0 AND share > 0 THEN chunk END AS chunk FROM (
    SELECT s.q, s.pos, s.sentence, f.chunk, coalesce(len(list_intersect(list_distinct({toks('s.sentence')}), list_distinct({toks('f.body')}))) / CAST(nullif(len(list_distinct({toks('s.sentence')})), 0) AS DOUBLE), 0e0) AS share,
      row_number() OVER (PARTITION BY s.q, s.pos ORDER BY coalesce(len(list_intersect(list_distinct({toks('s.sentence')}), list_distinct({toks('f.body')}))) / CAST(nullif(len(list_distinct({toks('s.sentence')})), 0) AS DOUBLE), 0e0) DESC, f.rank) AS rn
    FROM v_spoken s JOIN v_final_hybrid f ON f.q = s.q) WHERE rn = 1"""
VIEWS["v_citations"] = """
  SELECT c.q, c.pos, c.sentence, c.chunk, n.citation FROM v_cited c LEFT JOIN (
    SELECT q, chunk, row_number() OVER (PARTITION BY q ORDER BY min(pos)) AS citation FROM v_cited WHERE chunk IS NOT NULL GROUP BY q, chunk) n ON n.q = c.q AND n.chunk = c.chunk"""


@query("R13_citations", "SELECT q, row_number() OVER (PARTITION BY q ORDER BY pos) AS nr, sentence, chunk, citation FROM v_citations")
def r13(spark, root):
    final = final_chunks(spark, root)[0]
    cited = R.cite(R.compose(final), final)
    return cited.select("q", (F.col("pos") + 1).cast("long").alias("nr"), "sentence", "chunk", F.col("citation").cast("long").alias("citation"))


@query("R14_freshness_notice", f"SELECT q.q, bool_or(f.chunk_topic = 'visiting') OR {LIVE.format(c='q.question')} AS notice FROM v_questions q JOIN v_final_hybrid f ON f.q = q.q GROUP BY q.q, q.question")
def r14(spark, root):
    final = final_chunks(spark, root)[0]
    return final.groupBy("q").agg((F.bool_or(F.col("chunk_topic") == "visiting") | F.any_value(text.wants_live(F.col("question")))).alias("notice"))


FAITH = f"""SELECT {{k}}, coalesce({r("count(*) FILTER (ok) / CAST(nullif(count(s), 0) AS DOUBLE)", 4)}, 0e0) AS faithfulness FROM (
  SELECT a.{{k}}, s.s, EXISTS (SELECT 1 FROM {{ctx}} c WHERE c.{{k}} = a.{{k}} AND len(list_distinct({toks('s.s')})) > 0
    AND len(list_intersect(list_distinct({toks('s.s')}), list_distinct({toks('c.context')}))) / CAST(len(list_distinct({toks('s.s')})) AS DOUBLE) >= 0.3e0) AS ok
  FROM {{src}} a LEFT JOIN (SELECT {{k}}, trim(s) AS s FROM (SELECT {{k}}, unnest({_sent('answer')}) AS s FROM {{src}}) WHERE length(trim(s)) > 20) s ON s.{{k}} = a.{{k}}) GROUP BY {{k}}"""
VIEWS["v_turns"] = f"SELECT conv_id * {V.SPAN} + turn AS id, text AS answer FROM conversations WHERE role = 'assistant'"
VIEWS["v_turn_context"] = f"SELECT a.conv_id * {V.SPAN} + a.turn AS id, b.text AS context FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn - 1 WHERE a.role = 'assistant'"


@query("R16_faithfulness", FAITH.format(k="id", src="v_turns", ctx="v_turn_context").replace("SELECT id,", "SELECT id,", 1))
def r16(spark, root):
    turns = table(spark, root, "conversations")
    asked = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), text.tokens(F.col("text")).alias("context"))
    answers = turns.where("role = 'assistant'").join(asked, ["conv_id", "turn"], "left")
    contexts = F.array_compact(F.array("context"))
    return answers.select(V.paired("conv_id", "turn").alias("id"), R.faithfulness(F.col("text"), contexts).alias("faithfulness"))


VIEWS["v_q_context"] = "SELECT q, body AS context FROM v_final_hybrid"
VIEWS["v_q_faith"] = FAITH.format(k="q", src="v_answers", ctx="v_q_context")
VIEWS["v_hits"] = "SELECT f.*, contains(d.text, f.passage) AS hit FROM v_final_hybrid f JOIN documents d ON d.doc_id = f.doc_id"
VIEWS["v_qmetrics"] = f"""
  SELECT q.q, {r('avg(h.hit::INT)', 4)} AS precision, max((h.chunk_topic = coalesce(q.topic, h.chunk_topic))::INT) + 0e0 AS recall, bool_or(h.hit AND h.rank = 1) AS top1, bool_or(h.hit AND h.rank <= 3) AS top3,
    {r('coalesce(1e0 / min(CASE WHEN h.hit THEN h.rank END), 0e0)', 4)} AS rr, {r('avg(h.rerank)', 4)} AS relevance, e.evidence, e.evidence < {K.MIN_EVIDENCE}e0 AS abstained,
    CASE WHEN e.evidence < {K.MIN_EVIDENCE}e0 THEN 1e0 ELSE f.faithfulness END AS faithfulness,
    coalesce(max(c.n), 0) AS citations, coalesce(max(c.correct), CASE WHEN e.evidence < {K.MIN_EVIDENCE}e0 THEN 1e0 ELSE 0e0 END) AS citation_correctness, max(b.completeness) AS completeness,
    (e.evidence < {K.MIN_EVIDENCE}e0) = (q.q % 5 = 4 AND q.q % 4 <> 0) AS abstention_correct
  FROM v_scope q JOIN v_hits h ON h.q = q.q JOIN v_evid e ON e.q = q.q JOIN v_q_faith f ON f.q = q.q
  LEFT JOIN (SELECT q, count(*) AS n, round(avg(hit::INT) + 1e-9, 4) AS correct FROM (SELECT DISTINCT c.q, c.chunk, h.hit FROM v_citations c JOIN v_hits h ON h.q = c.q AND h.chunk = c.chunk) GROUP BY q) c ON c.q = q.q
  LEFT JOIN (SELECT x.q, {r('avg(contains(x.blob, lower(x.fact))::INT)', 4)} AS completeness FROM (SELECT q, blob, unnest({_sent('passage')}) AS fact FROM (SELECT q, any_value(passage) AS passage, lower(string_agg(body, ' ' ORDER BY rank)) AS blob FROM v_hits GROUP BY q)) x GROUP BY x.q) b ON b.q = q.q
  GROUP BY q.q, q.topic, e.evidence, f.faithfulness"""
QUALITY = "precision recall top1 top3 rr relevance evidence abstained faithfulness citations citation_correctness completeness abstention_correct".split()


def question_metrics(spark, root):
    """Per question: retrieval, citation, completeness and abstention measures."""
    found, final, questions = evidence(spark, root)
    docs = table(spark, root, "documents").select("doc_id", "text")
    # containment is tested for the retrieved chunks only, a handful per question
    hits = cut(final.join(docs, "doc_id").join(questions.select("q", "passage"), "q").withColumn("hit", F.contains("text", "passage")).drop("text"), "hits")
    answers = R.compose(final)
    cited = R.cite(answers, final).where("chunk is not null").select("q", "chunk").distinct().join(hits.select("q", "chunk", "hit"), ["q", "chunk"])
    per_citation = cited.groupBy("q").agg(F.count("*").alias("citations"), rnd(F.avg(F.col("hit").cast("double")), 4).alias("correct"))
    contexts = hits.groupBy("q").agg(
        F.collect_list(text.tokens(F.col("body"))).alias("contexts"),
        F.lower(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "body"))), lambda c: c["body"]), " ")).alias("blob"),
        F.any_value("passage").alias("passage"),
    )
    facts = text.sentences(F.col("passage"))
    told = F.size(F.filter(facts, lambda f: F.contains(F.col("blob"), F.lower(f)))) / F.size(facts)
    grounded = answers.join(contexts, "q").select("q", R.faithfulness(F.col("answer"), F.col("contexts")).alias("faith"), rnd(told, 4).alias("completeness"))
    hit = F.col("hit").cast("double")
    wanted = F.coalesce("topic", "chunk_topic")
    per_question = hits.groupBy("q").agg(
        rnd(F.avg(hit), 4).alias("precision"), F.max((F.col("chunk_topic") == wanted).cast("double")).alias("recall"),
        F.bool_or(F.col("hit") & (F.col("rank") == 1)).alias("top1"), F.bool_or(F.col("hit") & (F.col("rank") <= 3)).alias("top3"),
        rnd(F.coalesce(1.0 / F.min(F.when(F.col("hit"), F.col("rank"))), F.lit(0.0)), 4).alias("rr"), rnd(F.avg("rerank"), 4).alias("relevance"),
    )
    abstained = F.col("evidence") < K.MIN_EVIDENCE
    should = F.expr("q % 5 = 4 and q % 4 <> 0")
    return per_question.join(found, "q").join(grounded, "q").join(per_citation, "q", "left").select(
        "q", "precision", "recall", "top1", "top3", "rr", "relevance", "evidence", abstained.alias("abstained"),
        F.when(abstained, 1.0).otherwise(F.col("faith")).alias("faithfulness"), F.coalesce("citations", F.lit(0)).alias("citations"),
        F.coalesce("correct", F.when(abstained, 1.0).otherwise(0.0)).alias("citation_correctness"), "completeness", (abstained == should).alias("abstention_correct"),
    )


@query("R17_question_metrics", f"SELECT q, {', '.join(QUALITY)} FROM v_qmetrics")
def r17(spark, root):
    return question_metrics(spark, root)


@query("W12_reciprocal_rank", "SELECT q, coalesce(round(1e0 / min(CASE WHEN hit THEN rank END) + 1e-9, 4), 0e0) AS rr FROM v_hits GROUP BY q")
def w12(spark, root):
    final, questions, _ = final_chunks(spark, root)
    docs = table(spark, root, "documents").select("doc_id", "text")
    hits = final.join(docs, "doc_id").join(questions.select("q", "passage"), "q").withColumn("hit", F.contains("text", "passage"))
    return hits.groupBy("q").agg(F.coalesce(rnd(1.0 / F.min(F.when(F.col("hit"), F.col("rank"))), 4), F.lit(0.0)).alias("rr"))


MEANS = "precision recall rr relevance evidence faithfulness citation_correctness completeness".split()
RATES = "top1 top3 abstained abstention_correct".split()


@query("R18_run_summary", "SELECT count(*) AS questions, " + ", ".join(f"{r(f'avg({c})', 4)} AS {c}" for c in MEANS) + ", " + ", ".join(f"{r(f'avg({c}::INT)', 4)} AS {c}" for c in RATES)
    + ", list_sort(list(evidence))[CAST(count(*) // 2 AS INT) + 1] AS p50, list_sort(list(evidence))[least(count(*) - 1, CAST(floor(0.95e0 * count(*)) AS BIGINT)) + 1] AS p95 FROM v_qmetrics")
def r18(spark, root):
    m = cut(question_metrics(spark, root), "metrics")
    # percentiles are elements: rank by (value, q), keep the two wanted positions
    order = grouped.ranked(m.select("q", "evidence", F.lit(1).alias("run")), ["run"], F.floor(F.col("evidence") * 64), [F.col("evidence"), F.col("q")], "pos")
    n = m.agg(F.count("*")).scalar()
    at = lambda pos: F.max(F.when(F.col("pos") == pos, F.col("evidence")))
    marks = order.withColumn("n", n).agg(at(F.floor(F.col("n") / 2) + 1).alias("p50"), at(F.least(F.col("n") - 1, F.floor(F.col("n") * 0.95)) + 1).alias("p95"))
    means = m.agg(F.count("*").alias("questions"), *[rnd(F.avg(c), 4).alias(c) for c in MEANS], *[rnd(F.avg(F.col(c).cast("double")), 4).alias(c) for c in RATES])
    return means.withColumns({"p50": marks.select("p50").scalar(), "p95": marks.select("p95").scalar()})


# ------------------------------------------------------------------ retrieval without the place
OPEN = "place IS NOT NULL AND NOT (q % 5 = 4 AND q % 4 <> 0)"
VIEWS["v_open_questions"] = f"SELECT q, question, passage, cluster, NULL::VARCHAR AS place FROM v_questions WHERE {OPEN}"
_chain = "v_questions v_qtopic v_scope v_cand v_tok v_tf v_qt v_bm25 v_cvec_src v_cvec v_qvec_src v_qvec v_dense v_dense30 v_lex30 v_pools v_fused_hybrid v_reranked_hybrid v_final_hybrid".split()
for _name in _chain[1:]:
    # the same stages over the open questions
    VIEWS[f"{_name}_open"] = re.sub(rf"\b({'|'.join(_chain)})\b", lambda m: "v_open_questions" if m[1] == "v_questions" else f"{m[1]}_open", VIEWS[_name])
VIEWS["v_open"] = f"""
  SELECT q.q, coalesce(bool_or(f.chunk_place = q.place AND f.rank = 1), false) AS open_top1, coalesce(bool_or(f.chunk_place = q.place AND f.rank <= 3), false) AS open_top3,
    {r('coalesce(1e0 / min(CASE WHEN f.chunk_place = q.place THEN f.rank END), 0e0)', 4)} AS open_rr,
    {r('coalesce(avg(coalesce(f.chunk_place = q.place, false)::INT), 0e0)', 4)} AS open_precision
  FROM (SELECT * FROM v_questions WHERE {OPEN}) q LEFT JOIN v_final_hybrid_open f ON f.q = q.q GROUP BY q.q"""
TOPIC_OF_PHRASE = ["history", "significance", "facts", "visiting", "accessibility", "etiquette", "visiting"]
VIEWS["v_flags"] = f"""
  SELECT q.q, {sql_list(TOPIC_OF_PHRASE)}[CAST(q.q % 7 AS INT) + 1] AS topic_expected, {topic_case('q.question')} AS topic_detected,
    regexp_matches(CASE WHEN q.q % 17 = 0 THEN '{BAIT}' ELSE '' END || q.question, '{INJECT}') AS injection_flagged,
    coalesce(f.visiting OR {LIVE.format(c='q.question')}, false) AND coalesce(e.evidence, 0e0) >= {K.MIN_EVIDENCE}e0 AS time_warned,
    q.q % 5 = 4 AND q.q % 4 <> 0 AS out_of_scope, coalesce(e.evidence, 0e0) AS evidence
  FROM v_questions q LEFT JOIN (SELECT q, bool_or(chunk_topic = 'visiting') AS visiting FROM v_final_hybrid GROUP BY q) f ON f.q = q.q LEFT JOIN v_evid e ON e.q = q.q"""


def open_and_scoped(spark, root):
    """(final chunks, questions, index): each question within its place's scope and, where it has a place to be found, without it.

    Both go through the stages together, as two questions over one chunk index: ``q`` is twice the
    id, plus one for the open form, and ``target`` is the place looked for.
    """
    index = R.chunk_index(V.chunks(spark, root))
    asked = V.questions(spark, root).withColumn("target", F.col("place"))
    findable = asked.where(F.col("place").isNotNull() & ~out_of_scope(F.col("q")))
    forms = asked.withColumn("q", F.col("q") * 2).unionByName(findable.withColumns({"q": F.col("q") * 2 + 1, "place": F.lit(None).cast("string")}))
    questions = cut(R.with_scope(forms, index), "questions")
    pools = cut(R.arms(questions, index), "pools")
    return cut(R.rerank(R.fuse(pools), questions, index), "final"), questions, index


def out_of_scope(q):
    return (q % 5 == 4) & (q % 4 != 0)


def open_metrics(final, questions):
    """Per open question: whether the place looked for comes first, among three, its reciprocal rank and share."""
    asked = questions.where("q % 2 = 1").select("q", "target")
    rows = asked.join(final.select("q", "rank", "chunk_place"), "q", "left").withColumn("found", F.coalesce(F.col("chunk_place") == F.col("target"), F.lit(False)))
    first = F.min(F.when(F.col("found"), F.col("rank")))
    return rows.groupBy("q").agg(
        F.coalesce(first == 1, F.lit(False)).alias("open_top1"), F.coalesce(first <= 3, F.lit(False)).alias("open_top3"),
        rnd(F.coalesce(1.0 / first, F.lit(0.0)), 4).alias("open_rr"), rnd(F.avg(F.col("found").cast("double")), 4).alias("open_precision"),
    ).withColumn("q", F.expr("q div 2"))


def question_flags(final, questions, found):
    """Per question: topics, injection and time warnings, class and evidence, of the scoped form."""
    asked = questions.where("q % 2 = 0").withColumn("item", F.expr("q div 2"))
    visiting = final.groupBy("q").agg(F.bool_or(F.col("chunk_topic") == "visiting").alias("visiting"))
    rows = asked.join(visiting, "q", "left").join(found, "q", "left").withColumn("evidence", F.coalesce("evidence", F.lit(0.0)))
    baited = F.concat(F.when(F.col("item") % 17 == 0, F.lit(BAIT)).otherwise(F.lit("")), F.col("question"))
    warned = F.coalesce(F.col("visiting") | text.wants_live(F.col("question")), F.lit(False)) & (F.col("evidence") >= K.MIN_EVIDENCE)
    return rows.select(
        F.col("item").alias("q"), V.pick(TOPIC_OF_PHRASE, "item % 7").alias("topic_expected"), text.topic(F.col("question")).alias("topic_detected"),
        (F.size(text.injections(baited)) > 0).alias("injection_flagged"), warned.alias("time_warned"), out_of_scope(F.col("item")).alias("out_of_scope"), "evidence",
    )


@query("R17_open_retrieval", "SELECT q, open_top1, open_top3, open_rr, open_precision FROM v_open")
def r17b(spark, root):
    final, questions, _ = open_and_scoped(spark, root)
    return open_metrics(final, questions)


@query("R17_question_flags", "SELECT q, topic_expected, topic_detected, topic_expected = topic_detected AS topic_correct, injection_flagged, time_warned FROM v_flags")
def r17c(spark, root):
    final, questions, index = open_and_scoped(spark, root)
    found = R.evidence(final, R.corpus_idf(questions, index))
    flags = question_flags(final, questions, found)
    return flags.withColumn("topic_correct", F.col("topic_expected") == F.col("topic_detected")).drop("out_of_scope", "evidence")


@query("R18_open_summary", f"""
  SELECT o.*, f.* FROM (SELECT count(*) AS open_questions, {r('avg(open_top1::INT)', 4)} AS open_top1, {r('avg(open_top3::INT)', 4)} AS open_top3, {r('avg(open_rr)', 4)} AS open_mrr, {r('avg(open_precision)', 4)} AS open_precision FROM v_open) o,
    (SELECT {r('avg((topic_expected = topic_detected)::INT)', 4)} AS topic_accuracy, {r('avg(evidence) FILTER (NOT out_of_scope)', 4)} AS evidence_answerable, {r('coalesce(avg(evidence) FILTER (out_of_scope), 0e0)', 4)} AS evidence_out_of_scope,
      {r('avg(injection_flagged::INT) FILTER (q % 17 = 0)', 4)} AS injections_flagged, {r('avg(time_warned::INT) FILTER (q % 7 = 6 AND NOT out_of_scope)', 4)} AS live_warned FROM v_flags) f""")
def r18b(spark, root):
    final, questions, index = open_and_scoped(spark, root)
    found = cut(R.evidence(final, R.corpus_idf(questions, index)), "evidence")
    mean = lambda c, name: rnd(F.avg(F.col(c).cast("double")), 4).alias(name)
    opened = open_metrics(final, questions).agg(
        F.count("*").alias("open_questions"), mean("open_top1", "open_top1"), mean("open_top3", "open_top3"), mean("open_rr", "open_mrr"), mean("open_precision", "open_precision")
    )
    among = lambda where, c: F.avg(F.when(where, F.col(c).cast("double")))
    away = F.col("out_of_scope")
    flags = question_flags(final, questions, found).agg(
        rnd(F.avg((F.col("topic_expected") == F.col("topic_detected")).cast("double")), 4).alias("topic_accuracy"),
        rnd(among(~away, "evidence"), 4).alias("evidence_answerable"), rnd(F.coalesce(among(away, "evidence"), F.lit(0.0)), 4).alias("evidence_out_of_scope"),
        rnd(among(F.col("q") % 17 == 0, "injection_flagged"), 4).alias("injections_flagged"), rnd(among((F.col("q") % 7 == 6) & ~away, "time_warned"), 4).alias("live_warned"),
    )
    # two rows of totals side by side
    return opened.join(F.broadcast(flags))


_grid = " UNION ALL ".join(
    f"SELECT '{s}' AS strategy, {str(on).lower()} AS reranked, f.q, f.rank, contains(d.text, f.passage) AS hit FROM {view}_{s} f JOIN documents d ON d.doc_id = f.doc_id"
    for s in ("hybrid", "dense", "lexical") for on, view in ((True, "v_final"), (False, "v_plain"))
)


@query("R19_ablation_grid", f"""
  SELECT strategy, reranked, count(*) AS questions, {r('avg(top1::INT)', 4)} AS top1, {r('avg(rr)', 4)} AS mrr FROM (
    SELECT strategy, reranked, q, bool_or(hit AND rank = 1) AS top1, coalesce(1e0 / min(CASE WHEN hit THEN rank END), 0e0) AS rr FROM ({_grid}) GROUP BY ALL) GROUP BY strategy, reranked""")
def r19(spark, root):
    pools, questions, chunks = pooled(spark, root)
    docs = table(spark, root, "documents").select("doc_id", "text")
    runs = None
    for strategy in ("hybrid", "dense", "lexical"):
        fused = R.fuse(pools, strategy)
        for reranked in (True, False):
            run = R.rerank(fused, questions, chunks, reranked).select(F.lit(strategy).alias("strategy"), F.lit(reranked).alias("reranked"), "q", "doc_id", "rank")
            runs = run if runs is None else runs.unionByName(run)
    hits = cut(runs, "runs").join(docs, "doc_id").join(questions.select("q", "passage"), "q").withColumn("hit", F.contains("text", "passage"))
    per_q = hits.groupBy("strategy", "reranked", "q").agg(
        F.bool_or(F.col("hit") & (F.col("rank") == 1)).cast("double").alias("top1"), F.coalesce(1.0 / F.min(F.when(F.col("hit"), F.col("rank"))), F.lit(0.0)).alias("rr")
    )
    return per_q.groupBy("strategy", "reranked").agg(F.count("*").alias("questions"), rnd(F.avg("top1"), 4).alias("top1"), rnd(F.avg("rr"), 4).alias("mrr"))
