"""Retrieval stages against plain loops on a small corpus."""

from __future__ import annotations

import math
import re
import time
from collections import Counter
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from waymark.functions import constants as K, text
from waymark.operators import embedding as E
from waymark.operators import retrieval as R

TEXTS = [
    "The fort was built in 1650. It guards the old harbour and the lake road.", "Entry fee is Rs 50 and the gate opens at nine. Closed on Monday.",
    "Lake boats leave from the harbour every morning.", "A fort, a fort, a fort beside the lake.", "of the and", "Dress code applies inside the temple. Remove your shoes.",
]
CHUNKS = [(i, i, "en", f"p{i % 2}", K.TOPICS[i % 3], "official" if i % 2 else "blog", f"heading {i}", body) for i, body in enumerate(TEXTS)]
QUESTIONS = [(1, "when was the fort built", "en", None), (2, "ticket price right now", "en", "p1"), (3, "penguins in reykjavik", "en", "p9")]


def words(said):
    return [t for t in re.findall("[a-z0-9]+", said.lower()) if len(t) > 1 and t not in K.STOP_WORDS]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(CHUNKS, "chunk bigint, doc_id bigint, cluster string, place string, topic string, source_type string, heading string, body string")


@pytest.fixture(scope="module")
def questions(spark):
    return spark.createDataFrame(QUESTIONS, "q bigint, question string, cluster string, place string")


def vector(said):
    tokens = words(said)
    line = " ".join(tokens)
    feats = Counter("w:" + t for t in tokens)
    feats.update(f"b:{a}_{b}" for a, b in zip(tokens, tokens[1:]))
    feats.update("c:" + line[i : i + 4] for i in range(len(line) - 3) if " " not in line[i : i + 4])
    out = [0.0] * K.EMBED_DIM
    for feature, count in feats.items():
        digest = md5(feature.encode()).hexdigest()
        weight = (1 + math.log(count)) * {"w": 1, "b": 0.85, "c": 0.35}[feature[0]]
        out[int(digest[:15], 16) % K.EMBED_DIM] += weight if digest[15] >= "8" else -weight
    norm = math.sqrt(sum(v * v for v in out))
    return [v / norm for v in out] if norm else out


def test_vectors_equal_plain_hashing(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, "", None, "abcd", "a b", "one two one two three three"])], "id int, text string")
    got = {r["id"]: r for r in E.vectors(rows, ["id"], text.tokens(F.col("text"))).collect()}
    assert len(got) == rows.count()
    for r in rows.collect():
        out = [0.0] * K.EMBED_DIM
        for b, v in zip(got[r["id"]]["b"], got[r["id"]]["v"]):
            out[b] = v
        assert out == pytest.approx(vector(r["text"] or ""), abs=1e-12)


def test_cell_vectors_equal_plain_hashing():
    said = [*TEXTS, "", "abcd", "a b", "one two one two three three", ""]
    for got, text_ in zip(E.text_vectors([words(t) for t in said]), said):
        assert got == pytest.approx(vector(text_), abs=1e-12)
    assert E.text_vectors([[]]).tolist() == [[0.0] * K.EMBED_DIM]


def test_vectors_of_equal_keys_count_as_one_text_across_slices(spark, monkeypatch):
    monkeypatch.setattr(E, "SLICE", 2 * E.BESIDES)
    said = [(1, "fort lake"), (None, "fort"), (1, "lake fort lake"), (2, "harbour road"), (None, "lake lake"), (1, ""), (1, "fort lake"), (3, None), (None, "fort walls")]
    rows = spark.createDataFrame(said, "id long, text string")
    old = {r["id"]: r["f"] for r in E.weights(rows, ["id"], text.tokens(F.col("text"))).groupBy("id").agg(F.collect_list(F.struct("b", "v")).alias("f")).collect()}
    run = E._keyed_vectors()
    sorted_rows = rows.orderBy("id").select("id", text.tokens(F.col("text")).alias("tokens")).toArrow()
    here = [r for batch in run(sorted_rows.to_batches(max_chunksize=3)) for r in batch.to_pylist()]
    there = [r.asDict() for r in E.vectors(rows, ["id"], text.tokens(F.col("text"))).collect()]
    assert len(here) == len(there) == len(old) == 4
    for got in (*here, *there):
        want = [0.0] * K.EMBED_DIM
        for f in old[got["id"]]:
            if f["b"] is not None:
                want[f["b"]] += f["v"]
        norm = math.sqrt(sum(v * v for v in want)) or 1.0
        out = [0.0] * K.EMBED_DIM
        for b, v in zip(got["b"], got["v"]):
            out[b] = v
        assert out == pytest.approx([v / norm for v in want], abs=1e-12)


def test_stored_vectors_shuffle_texts_and_no_features(spark):
    rows = spark.createDataFrame([(1, "fort lake"), (2, "")], "id long, text string")
    plan = E.vectors(rows, ["id"], text.tokens(F.col("text")))._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Aggregate" not in plan


def test_pair_scores_equal_plain_cosine(spark):
    pairs = spark.createDataFrame([(1, 1, TEXTS[0], TEXTS[3]), (1, 2, TEXTS[0], ""), (2, 1, TEXTS[1], TEXTS[1])], "q int, chunk int, a string, b string")
    for r in E.pair_scores(pairs, ["q", "chunk"], F.col("a"), F.col("b")).collect():
        assert r["dense"] == pytest.approx(sum(x * y for x, y in zip(vector(r["a"]), vector(r["b"]))), abs=1e-8)


def test_scope_widens_only_when_starved(questions, chunks):
    scopes = {r["q"]: (r["scope"], r["candidates"]) for r in R.with_scope(questions, chunks).collect()}
    assert scopes[1] == ("en|*|history", 2)
    assert scopes[2] == ("en|p1|*", 3)  # one visiting chunk is too few, so the topic goes first
    assert scopes[3] == ("en|*|*", 6)  # unknown place


def plain_bm25(scope, question, rows):
    """Score of every chunk of a scope that has a term of the question."""
    _, place, topic = scope
    cand = {c[0]: words(f"{c[6]} {c[7]}") for c in rows if place in ("*", c[3]) and topic in ("*", c[4])}
    mean = sum(map(len, cand.values())) / len(cand)
    out = {}
    for chunk, doc in cand.items():
        score = 0.0
        for term in set(words(question)):
            df, tf = sum(term in d for d in cand.values()), doc.count(term)
            if tf:
                score += math.log(1 + (len(cand) - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(doc) / mean))
        if score:
            out[chunk] = score
    return out


def test_bm25_equals_loop(questions, chunks):
    index = R.chunk_index(chunks)
    scoped = R.with_scope(questions, index)
    got = {(r["q"], r["chunk"]): r["lexical"] for r in R.lexical_top(scoped, index).collect()}
    scope = {r["q"]: r["scope"].split("|") for r in scoped.collect()}
    want = {(q, chunk): score for q, question, _, _ in QUESTIONS for chunk, score in plain_bm25(scope[q], question, CHUNKS).items()}
    assert got == pytest.approx(want, abs=1e-6)


@pytest.fixture(scope="module")
def many(spark):
    """Three hundred chunks of one scope, with very common and rare words, ties and equal texts."""
    word = lambda i, j: f"w{(i * 7 + j * j * 13 + i * j) % (5 if j % 3 else 97)}"
    rows = [(i, i, "en", "p0", "history", "blog", "heading", " ".join(word(i % 240, j) for j in range(4 + i % 9))) for i in range(300)]
    asked = [(q, f"w{q % 5} w{q * 11 % 97} w{q * 29 % 97} w1", "en", None) for q in range(40)]
    index = R.chunk_index(spark.createDataFrame(rows, "chunk bigint, doc_id bigint, cluster string, place string, topic string, source_type string, heading string, body string"))
    return rows, asked, index, R.with_scope(spark.createDataFrame(asked, "q bigint, question string, cluster string, place string"), index)


@pytest.mark.parametrize("block,first,top", [(8, 1, 3), (40, 2, 30), (1000, 2, 30)])
def test_block_maxima_lose_no_row_of_a_pool(many, block, first, top):
    rows, asked, index, scoped = many
    got = {(r["q"], r["lexical_rank"]): (r["chunk"], round(r["lexical"], 7)) for r in R.lexical_top(scoped, index, top, block, first).collect()}
    want = {}
    for q, question, _, _ in asked:
        scores = plain_bm25(("en", "*", "*"), question, rows)
        best = sorted((-round(s + 1e-9, 9), c) for c, s in scores.items())[:top]
        want |= {(q, n): (c, round(-s, 7)) for n, (s, c) in enumerate(best, 1)}
    assert got == want and len(got) <= top * len(asked)


def test_lexical_scores_hold_every_chunk_with_a_term_of_the_question(many):
    from waymark.plans import registry

    rows, asked, index, scoped = many
    got = {(r["q"], r["chunk"]): r["lexical"] for r in R.lexical_scores(scoped, index).collect()}
    want = {(q, chunk): score for q, question, _, _ in asked for chunk, score in plain_bm25(("en", "*", "*"), question, rows).items()}
    assert got == pytest.approx(want, abs=1e-6) and len(got) > K.LEXICAL_POOL * len(asked)
    assert "v_lex30" not in registry.all_oracles()["R7_bm25"]


def test_cells_of_any_size_give_the_same_dense_pools(many):
    _, _, index, scoped = many
    whole = sorted(map(tuple, E.dense_top(index, scoped, top=7).collect()))
    assert len(whole) == 7 * 40
    assert sorted(map(tuple, E.dense_top(index, scoped, top=7, cell=(16, 5)).collect())) == whole


def test_no_retrieval_arm_collects_or_broadcasts_vectors(many):
    _, _, index, scoped = many
    plan = E.dense_top(index, scoped)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "FlatMapCoGroupsInPandas" in plan


def test_a_chunk_is_dealt_once_for_all_scopes_that_ask_it(spark):
    tokens = [["old", "fort"], ["lake"], ["fort", "lake", "walk"]]
    scopes = [["a|p|t", "a|p|*", "a|*|t", "a|*|*"], ["a|p|u", "a|p|*", "a|*|u", "a|*|*"], ["a|*|t", "a|*|*", "a|*|t", "a|*|*"]]
    index = spark.createDataFrame([(i + 1, s, t) for i, (s, t) in enumerate(zip(scopes, tokens))], "chunk long, scopes array<string>, tokens array<string>")
    asked = [(1, "a|p|t", "fort"), (2, "a|p|*", "lake"), (3, "a|*|t", "fort walk"), (4, "a|*|*", "lake")]
    members, _ = E.cells(index, spark.createDataFrame(asked, "q long, scope string, question string"))
    assert sorted(r["chunk"] for r in members.collect()) == [1, 2, 3]
    got = E.dense_top(index, spark.createDataFrame(asked, "q long, scope string, question string"), top=4).collect()
    held = {q: sorted(r["chunk"] for r in got if r["q"] == q) for q, *_ in asked}
    assert held == {1: [1], 2: [1, 2], 3: [1, 3, 3], 4: [1, 2, 3, 3]}  # a chunk without a place names a scope twice


def test_dense_top_equals_loop(questions, chunks):
    index = R.chunk_index(chunks)
    scoped = R.with_scope(questions, index)
    rows = E.dense_top(index, scoped, top=2).collect()
    for q, question, _, _ in QUESTIONS:
        mine = sorted((r["dense_rank"], r["chunk"]) for r in rows if r["q"] == q)
        scope = next(r["scope"] for r in scoped.collect() if r["q"] == q).split("|")
        sims = [(-round(sum(a * b for a, b in zip(vector(question), vector(f"{c[6]}\n{c[7]}"))), 9), c[0]) for c in CHUNKS if scope[1] in ("*", c[3]) and scope[2] in ("*", c[4])]
        assert [c for _, c in mine] == [c for _, c in sorted(sims)[:2]]


def test_empty_arm_falls_back(spark):
    pools = spark.createDataFrame([(1, 7, 1, None), (2, 8, None, 1)], "q bigint, chunk bigint, dense_rank int, lexical_rank int")
    rows = {r["q"]: r["fused"] for r in R.fuse(pools, "lexical").collect()}
    assert rows == {1: round(1 / 61, 6), 2: round(1 / 61, 6)}


def test_evidence_separates_in_scope_from_out_of_scope(questions, chunks):
    index = R.chunk_index(chunks)
    scoped = R.with_scope(questions, index)
    final = R.rerank(R.fuse(R.arms(scoped, index)), scoped, index)
    found = {r["q"]: r["evidence"] for r in R.evidence(final, R.corpus_idf(scoped, index)).collect()}
    assert found[1] > K.MIN_EVIDENCE
    assert found[3] < K.MIN_EVIDENCE
    # "price" and "ticket" are covered by the synonym "fee" of a chunk that never says them
    assert found[2] > 0.5


def test_citations_number_chunks_in_order_of_use(spark):
    final = spark.createDataFrame([(1, 50, 1, "Lake boats leave every morning."), (1, 60, 2, "The fort was built in 1650.")], "q bigint, chunk bigint, rank int, body string")
    answers = spark.createDataFrame([(1, "The fort was built early. Lake boats leave every morning. Penguins fly backwards!")], "q bigint, answer string")
    rows = sorted((r["pos"], r["chunk"], r["citation"]) for r in R.cite(answers, final).collect() if r["chunk"])
    assert rows == [(0, 60, 1), (1, 50, 2)]


def test_faithfulness_counts_wordless_sentences(spark):
    row = spark.range(1).select(
        R.faithfulness(F.lit("The fort was built long ago. of the and of the and of the. Penguins live in reykjavik today."), F.array(F.array(F.lit("fort"), F.lit("built")))).alias("f")
    ).first()
    assert row["f"] == pytest.approx(1 / 3, abs=1e-4)


def test_open_measures_count_the_place_looked_for(spark):
    from waymark.plans.retrieval import open_metrics

    final = spark.createDataFrame([(3, 1, "b"), (3, 2, "a"), (3, 3, None), (3, 4, "a"), (5, 1, "b"), (2, 1, "a")], "q bigint, rank int, chunk_place string")
    questions = spark.createDataFrame([(3, "a"), (5, "a"), (7, "a"), (2, "a")], "q bigint, target string")
    got = {r["q"]: (r["open_top1"], r["open_top3"], r["open_rr"], r["open_precision"]) for r in open_metrics(final, questions).collect()}
    assert got == {1: (False, True, 0.5, 0.5), 2: (False, False, 0.0, 0.0), 3: (False, False, 0.0, 0.0)}


def dealt_rows(df):
    """Rows that each shuffle of a plan wrote, after the plan has run."""
    df.collect()
    found, left = [], [df._jdf.queryExecution().executedPlan()]
    while left:
        node = left.pop()
        kind = node.getClass().getSimpleName()
        left += [node.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [node.plan()] if kind.endswith("QueryStageExec") else [node.children().apply(i) for i in range(node.children().size())]
        if kind == "ShuffleExchangeExec":
            found.append(node.metrics().apply("shuffleRecordsWritten").value())
    return found


@pytest.fixture
def no_broadcast(spark):
    """Tables too large for Spark to broadcast by itself."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_lexical_pools_shuffle_no_pairs(many, no_broadcast):
    rows, asked, index, scoped = many
    pairs = sum(len(plain_bm25(("en", "*", "*"), question, rows)) for _, question, _, _ in asked)
    postings = sum(len({*words(f"{r[6]} {r[7]}")}) for r in rows)
    written = dealt_rows(R.lexical_top(scoped, index))
    assert max(written) <= postings < pairs / 3


def test_reranking_shuffles_the_pooled_chunks_only(spark, many, no_broadcast):
    rows, _, index, scoped = many
    fused = spark.createDataFrame([(q, c, 0.03, 0.0) for q, c in [(0, 5), (0, 7), (1, 7), (2, 250)]], "q bigint, chunk bigint, fused double, dense double")
    final = R.rerank(fused, scoped.where("q < 3"), index)
    assert sorted((r["q"], r["chunk"], r["body"]) for r in final.collect()) == [(0, 5, rows[5][7]), (0, 7, rows[7][7]), (1, 7, rows[7][7]), (2, 250, rows[250][7])]
    assert max(dealt_rows(final)) < len(rows)


def test_corpus_weights_shuffle_no_words_that_nobody_asks(spark, many, no_broadcast):
    rows, _, index, _ = many
    asked = spark.createDataFrame([(1, "w96 w5"), (2, "of the")], "q bigint, question string")
    weights = R.corpus_idf(asked, index)
    got = {t["accepted"][0]: t["w"] for r in weights.collect() for t in r["terms"]}
    have = lambda w: sum(w in words(f"{r[6]} {r[7]}") for r in rows)
    assert got == pytest.approx({w: math.log(1 + len(rows) / (1 + have(w))) for w in ("w96", "w5")})
    assert max(dealt_rows(weights)) < 60


def test_a_sieve_keeps_all_that_is_wanted_and_few_others(spark):
    rows = spark.range(20000).select((F.col("id") % 5000).alias("k"), F.col("id").alias("v"))
    wanted = spark.createDataFrame([(7,), (7,), (4000,), (9999,), (None,)], "k long")
    got = R.sifted(rows.unionByName(spark.createDataFrame([(None, -1)], "k long, v long")), ["k"], wanted).collect()
    assert sum(r["k"] in (7, 4000) for r in got) == 8 and len(got) < 100 and len({r["v"] for r in got}) == len(got)


def test_the_index_leaves_no_shuffle_files(spark, chunks):
    files = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    held = lambda: {f for f in files().split("\n") if "/shuffle_" in f}
    before = held()
    index = R.chunk_index(chunks)
    for _ in range(50):  # files go soon, not at once
        if not (left := held() - before):
            break
        time.sleep(0.1)
    assert not left and index.count() == len(CHUNKS)


def test_lexical_pools_take_chunks_and_questions_that_repeat_or_have_no_number(spark):
    scopes = ["a|*|*"]
    rows = [(1, ["old", "fort"]), (1, ["old", "fort", "fort"]), (None, ["lake"]), (None, ["lake", "fort"]), (2, ["lake"]), (3, [])]
    index = spark.createDataFrame([(c, scopes, t) for c, t in rows], "chunk long, scopes array<string>, tokens array<string>")
    asked = spark.createDataFrame([(1, "a|*|*", "fort lake"), (1, "a|*|*", "fort"), (None, "a|*|*", "fort")], "q long, scope string, question string")
    want = {(r["q"], r["chunk"]): r["lexical"] for r in R.lexical_scores(asked, index).collect() if r["q"]}
    got = {(r["q"], r["chunk"]): r["lexical"] for r in R.lexical_top(asked, index).collect()}
    assert got == pytest.approx(want, abs=1e-8) and set(got) == {(1, None), (1, 1), (1, 2)}


def test_dense_pools_deal_a_question_and_a_chunk_as_one_row(spark, no_broadcast):
    index = spark.createDataFrame([(i, ["a|*|*"], ["old", f"fort{i}"]) for i in range(6)], "chunk long, scopes array<string>, tokens array<string>")
    asked = spark.createDataFrame([(q, "a|*|*", " ".join(f"walk{q}x{i}" for i in range(30))) for q in range(5)], "q long, scope string, question string")
    pools = E.dense_top(index, asked, top=2)
    assert max(dealt_rows(pools)) <= 5 * 2 and pools.count() == 5 * 2  # a row per filled bucket of a question would be hundreds
