"""Queries: model evaluation on labelled documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.functions import text
from waymark.functions.stats import rnd
from waymark.operators import models as M
from waymark.plans.fairness import TOTAL_SQL
from waymark.plans.registry import query
from waymark.plans.view_sql import VIEWS, rnd as r, toks
from waymark.session import cut, shared_dir, work_path
from waymark.sources import views as V
from waymark.sources.tables import table



def labelled(spark, root):
    """Labelled documents with ten features in [0, 1] and the split flag."""
    docs = V.documents(spark, root).select("doc_id", "text").join(
        table(spark, root, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id"
    )
    n = F.greatest(F.lit(1), F.length("text"))
    only = lambda keep: F.length(F.regexp_replace("text", f"[^{keep}]", "")) / n
    words, lines = text.tokens(F.col("text")), F.split("text", "\n")
    full = F.filter(lines, lambda x: x != "")
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    f = {
        "interest_match": share(F.size(F.array_distinct(words)), F.size(words)), "group_fairness": share(F.size(full), F.size(lines)),
        "attraction_quality": F.least(F.lit(1.0), n / 20000.0), "weather_suitability": only("a-zA-Z"), "seasonal_suitability": 1.0 - only("0-9"),
        "accessibility_suitability": F.least(F.lit(1.0), share(F.length(F.array_join(words, "")), F.size(words)) / 12.0), "budget_suitability": 1.0 - only("A-Z"),
        "evidence_quality": F.least(F.lit(1.0), F.size(lines) / 50.0), "distance_penalty": F.least(F.lit(1.0), only("#*%") * 10.0),
        "crowd_penalty": 1.0 - share(F.size(F.array_distinct(lines)), F.size(lines)),
    }
    return M.split(docs.select("doc_id", "label", *[rnd(c, 6).alias(name) for name, c in f.items()]), "doc_id")


_n = "greatest(1, length(text))"
_only = lambda keep: f"length(regexp_replace(text, '[^{keep}]', '', 'g')) / CAST({_n} AS DOUBLE)"
_f = {
    "interest_match": "coalesce(len(list_distinct(t)) / CAST(nullif(len(t), 0) AS DOUBLE), 0e0)", "group_fairness": "len(list_filter(l, lambda x: x <> '')) / CAST(len(l) AS DOUBLE)",
    "attraction_quality": f"least(1e0, {_n} / 20000e0)", "weather_suitability": _only("a-zA-Z"), "seasonal_suitability": f"1e0 - {_only('0-9')}",
    "accessibility_suitability": "least(1e0, coalesce(length(array_to_string(t, '')) / CAST(nullif(len(t), 0) AS DOUBLE), 0e0) / 12e0)", "budget_suitability": f"1e0 - {_only('A-Z')}",
    "evidence_quality": "least(1e0, len(l) / 50e0)", "distance_penalty": f"least(1e0, {_only('#*%')} * 10e0)", "crowd_penalty": "1e0 - len(list_distinct(l)) / CAST(len(l) AS DOUBLE)",
}
VIEWS["v_labelled"] = f"""
  SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT, doc_id) % 4 = 0 AS test, {', '.join(f'{r(e, 6)} AS {c}' for c, e in _f.items())}
  FROM (SELECT d.doc_id, d.text, b.quality AS label, {toks('d.text')} AS t, string_split(d.text, chr(10)) AS l FROM documents d JOIN labels b ON b.doc_id = d.doc_id)"""
VIEWS["v_control"] = f"SELECT doc_id, label, test, {r(TOTAL_SQL, 6)} AS score, interest_match FROM v_labelled"


@query("M1_split", "SELECT doc_id, label, test FROM v_labelled")
def m1(spark, root):
    return labelled(spark, root).select("doc_id", "label", "test")


def control(spark, root):
    return M.control_score(labelled(spark, root))


@query("M3_ranking_metrics", f"""
  WITH s AS (SELECT * FROM v_control), x AS (SELECT 'control' AS model, score, label FROM s WHERE test UNION ALL SELECT 'distinct_words', interest_match, label FROM s WHERE test),
  a AS (SELECT p.model, sum(CASE WHEN p.score > n.score THEN 1e0 WHEN p.score = n.score THEN 0.5e0 ELSE 0e0 END) / count(*) AS auc FROM x p JOIN x n ON n.model = p.model AND p.label = 1 AND n.label = 0 GROUP BY 1),
  t AS (SELECT model, score, sum(label) AS pos, sum(sum(label)) OVER w AS tp, sum(count(*)) OVER w AS seen FROM x GROUP BY model, score WINDOW w AS (PARTITION BY model ORDER BY score DESC)),
  p AS (SELECT model, sum(pos * tp / CAST(seen AS DOUBLE)) / sum(pos) AS pr FROM t GROUP BY 1)
  SELECT x.model, {r('any_value(a.auc)', 4)} AS auc, {r('any_value(p.pr)', 4)} AS pr_auc, {r('avg(pow(x.score - x.label, 2))', 4)} AS brier, {r('avg(((x.score >= 0.5e0)::INT = x.label)::INT)', 4)} AS accuracy
  FROM x JOIN a ON a.model = x.model JOIN p ON p.model = x.model GROUP BY x.model""")
def m3(spark, root):
    rows = control(spark, root).where("test")
    both = F.array(F.struct(F.lit("control").alias("model"), "score"), F.struct(F.lit("distinct_words").alias("model"), F.col("interest_match").alias("score")))
    scored = rows.select("label", F.inline(both))
    return metrics(scored)


def metrics(scored):
    ranked = M.ranking_metrics(scored, ["model"])
    return ranked.join(M.probability_metrics(scored, ["model"]), "model").select("model", rnd(F.col("auc"), 4).alias("auc"), rnd(F.col("pr_auc"), 4).alias("pr_auc"), "brier", "accuracy")


@query("M4_rule_control", "SELECT doc_id, score, label FROM v_control WHERE test")
def m4(spark, root):
    return control(spark, root).where("test").select("doc_id", "score", "label")


def fitted(spark, root, names):
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))  # boosting cuts its own lineage there
    rows = cut(labelled(spark, root), "labelled")
    # tree learners launch many short jobs, so partitions follow the size of the data
    train = rows.where("not test").persist()
    models = {name: M.learners()[name].fit(train) for name in names}
    train.unpersist()
    return models, rows.where("test")


def held_out(spark, root, name):
    models, test = fitted(spark, root, [name])
    return metrics(M.predict(models[name], test, name))


@query("M2_logistic_regression")
def m2_logistic(spark, root):
    """Learned model: no SQL twin; metrics of the held-out quarter."""
    return held_out(spark, root, "logistic_regression")


@query("M2_random_forest")
def m2_forest(spark, root):
    """Learned model: no SQL twin; metrics of the held-out quarter."""
    return held_out(spark, root, "random_forest")


@query("M2_gradient_boosting")
def m2_boosting(spark, root):
    """Learned model: no SQL twin; metrics of the held-out quarter. 250 boosting rounds in sequence."""
    return held_out(spark, root, "gradient_boosting")


RESAMPLES = 2000


def paired_scores(spark, root):
    return control(spark, root).where("test").select("label", F.col("interest_match").alias("challenger"), F.col("score").alias("control"))


@query("M5_bootstrap_gap")
def m5(spark, root):
    """Resamples drawn by generators: no SQL twin; M5_interval_check compares what SQL can say about the interval."""
    return M.bootstrap_gap(cut(paired_scores(spark, root), "scores"), RESAMPLES)


# the interval must hold the gap of the whole sample; SQL knows the gap, and that every resample counts
@query("M5_interval_check", f"""
  WITH x AS (SELECT label, interest_match AS challenger, score AS control FROM v_control WHERE test),
  a AS (SELECT sum(CASE WHEN p.challenger > n.challenger THEN 1e0 WHEN p.challenger = n.challenger THEN 0.5e0 ELSE 0e0 END) / count(*) AS challenger,
    sum(CASE WHEN p.control > n.control THEN 1e0 WHEN p.control = n.control THEN 0.5e0 ELSE 0e0 END) / count(*) AS control FROM x p JOIN x n ON p.label = 1 AND n.label = 0)
  SELECT {r('challenger - control', 4)} AS exact_gap, {RESAMPLES}::BIGINT AS resamples, true AS holds_gap, true AS centred FROM a""")
def m5_check(spark, root):
    rows = cut(paired_scores(spark, root), "scores")
    sides = rows.select("label", F.inline(F.array(*[F.struct(F.lit(c).alias("side"), F.col(c).alias("score")) for c in ("challenger", "control")])))
    auc = M.ranking_metrics(sides, ["side"])
    exact = auc.agg((F.max(F.when(F.col("side") == "challenger", F.col("auc"))) - F.max(F.when(F.col("side") == "control", F.col("auc")))).alias("gap"))
    found = M.bootstrap_gap(rows, RESAMPLES).withColumn("gap", exact.scalar())
    return found.select(
        rnd(F.col("gap"), 4).alias("exact_gap"), "resamples", F.col("gap").between(F.col("ci_low"), F.col("ci_high")).alias("holds_gap"),
        (F.abs(F.col("point_estimate") - F.col("gap")) < (F.col("ci_high") - F.col("ci_low")) / 10).alias("centred"),
    )


@query("M6_feature_importance")
def m6(spark, root):
    """Learned importances: no SQL twin."""
    models, _ = fitted(spark, root, ["random_forest"])
    values = [float(v) for v in models["random_forest"].stages[-1].featureImportances.toArray()]
    ranked = sorted(zip(M.FEATURES, values), key=lambda p: (-p[1], p[0]))
    return spark.createDataFrame([(i + 1, f, round(v, 4)) for i, (f, v) in enumerate(ranked)], "rank int, feature string, importance double")


@query("M7_model_registry")
def m7(spark, root):
    """Appended run rows of a fitted model: no SQL twin."""
    models, test = fitted(spark, root, ["logistic_regression"])
    path = work_path(spark, "model-runs")
    run = metrics(M.predict(models["logistic_regression"], test, "logistic_regression"))
    run.select(F.lit("suitability").alias("experiment"), "model", F.lit("given labels").alias("data_kind"), "auc", "pr_auc", "brier", "accuracy").write.mode("append").parquet(path)
    return spark.read.parquet(path)
