"""Contracts, sources, streams, models and plan checks."""

from __future__ import annotations

import datetime as dt
import json
import os
import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from waymark.operators import audit as A
from waymark.operators import contracts as C
from waymark.operators import metrics as P
from waymark.operators import models as M
from waymark.operators import shaping as S
from waymark.plans import registry
from waymark.plans.contracts import runtime_checks
from waymark.session import cut, shared_dir, work_path
from waymark.sources import catalogue
from waymark.sources.tables import MissingTable, layer
from waymark.streaming import runs, sharing


def test_validate_reports_every_failure(spark):
    df = spark.createDataFrame([(1, "ab", 5), (1, "X!", 50), (2, None, None)], "id int, slug string, n int")
    rules = [C.required("slug"), C.matches("slug", "^[a-z]+$"), C.within("n", 0, 10)]
    with pytest.raises(C.ContractViolation) as error:
        C.validate(df, rules, "demo", unique=[["id"]])
    assert all(part in str(error.value) for part in ("slug_not_null=1", "slug_pattern=1", "n_range=1", "unique(id)=1"))
    good = df.where("slug = 'ab'")
    assert C.validate(good, rules, "demo", unique=[["id"]]) is good


def test_gate_names_failed_errors(spark, root):
    checks = runtime_checks(spark, root)
    with pytest.raises(C.ContractViolation, match="not_falsely_verified"):
        C.gate(checks)
    C.gate(checks.where("passed or severity = 'warning'"))


def test_missing_layer_is_named(spark, tmp_path):
    with pytest.raises(MissingTable, match="places"):
        layer(spark, str(tmp_path), "places")
    with pytest.raises(MissingTable):
        catalogue.read_catalogue(spark, str(tmp_path / "none")).count()


def test_upsert_keeps_updates_and_inserts(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, None), (3, "c")], "k int, v string")
    rows = {r["k"]: (r["v"], r["change"]) for r in catalogue.upsert(old, new, "k").collect()}
    assert rows == {1: ("a", "kept"), 2: (None, "updated"), 3: ("c", "inserted")}


def test_landing_drops_repeats_but_keeps_versions(spark):
    rows = spark.createDataFrame([(1, "x"), (1, "x"), (1, "y")], "id int, v string")
    assert catalogue.land(rows, "demo", F.col("id").cast("string")).count() == 2


def test_rejects_one_reason_per_row_with_a_hot_key(spark):
    rows = spark.range(300).selectExpr("id", "if(id < 200, 'hot', concat('h', id)) AS host")
    tagged = S.split_rejects(rows, "host", "id", F.col("host") != "h250")
    reasons = {r["reason"]: r["count"] for r in tagged.groupBy("reason").count().collect()}
    assert reasons == {None: 100, "duplicate_key": 199, "source_not_allowed": 1}


def test_percentiles_are_elements(spark):
    t0 = dt.datetime(2024, 1, 1)
    calls = spark.createDataFrame([("s", i, t0 + dt.timedelta(seconds=i), float(i), True, False, "p") for i in range(1, 21)], "service string, call int, ts timestamp, latency double, ok boolean, fallback boolean, provider string")
    row = P.service_health(calls).first()
    assert (row["p50"], row["p95"], row["max"]) == (11.0, 20.0, 20.0)
    assert P.service_health(calls.limit(1)).first()["p95"] == 1.0


def test_spend_without_rows_gives_no_figure(spark):
    empty = spark.createDataFrame([], "actual double, low double, high double")
    row = P.spend_accuracy(empty).first()
    assert (row["samples"], row["within_range"], row["mape"]) == (0, None, None)


def test_empty_plan_is_an_error_and_clean_plan_is_valid(spark):
    plans = spark.createDataFrame([(1,), (2,)], "plan bigint")
    issues = spark.createDataFrame([(1, "empty_itinerary", "error"), (1, "over_budget", "warning")], "plan bigint, code string, severity string")
    rows = {r["plan"]: (r["errors"], r["warnings"], r["valid"]) for r in A.report(issues, plans).collect()}
    assert rows == {1: (1, 1, False), 2: (0, 0, True)}


def plain_sessions(events):
    """Closed sessions of actions in order of time, and those that the watermark closes."""
    rows = events.orderBy("at", "event_id").collect()
    held, closed = {}, []
    for r in rows:
        key = (r["trip"], r["member"])
        held[key], done, _ = sharing.advance(held.get(key), r["at"], r["kind"], r["hours"])
        if done:
            closed.append((*key, *done))
    mark = max(r["at"] for r in rows) // 1000 - 3_600_000
    return sorted(closed + [(*key, *sharing.expired(s)) for key, s in held.items() if s and s[1] // 1000 <= mark])


def test_sharing_stream_equals_plain_loop(spark, root):
    with sharing.timed_state(spark):
        got = runs.append_run(sharing.sharing_sessions(runs.event_stream(spark, root)), "sharing").collect()
    want = plain_sessions(sharing.sharing_actions(spark.read.parquet(f"{root}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))))
    assert sorted(map(tuple, got)) == want
    assert {r["outcome"] for r in got} == {"stopped", "expired"} and any(r["pauses"] for r in got)
    assert all(r["points_kept"] == 0 for r in got if r["outcome"] == "stopped")  # stopping deletes the trail
    assert spark.conf.get(sharing.PROVIDER) != sharing.STORE


def in_order_of_time(spark, root, folder, parts):
    """Events in part files by time, one for each trigger."""
    events = spark.read.parquet(f"{root}/events.parquet").orderBy("ts", "event_id").toPandas()
    step = -(-len(events) // parts)
    for n in range(parts):
        part = spark.createDataFrame(events[n * step:(n + 1) * step], runs.EVENT_SCHEMA)
        part.coalesce(1).write.mode("append").parquet(str(folder / "events.parquet"))
        time.sleep(0.05)
    return str(folder)


def test_sessions_and_positions_over_several_triggers(spark, root, tmp_path):
    folder = in_order_of_time(spark, root, tmp_path, 5)
    with sharing.timed_state(spark):
        got = runs.append_run(sharing.sharing_sessions(runs.event_stream(spark, folder, maxFilesPerTrigger=1)), "sharing").collect()
    assert sorted(map(tuple, got)) == plain_sessions(sharing.sharing_actions(spark.read.parquet(f"{root}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))))


def test_position_state_shrinks_once_points_expire(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    seen = []

    def stream():
        schema = "trip bigint, member bigint, point bigint, ts timestamp, expires timestamp"
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def put(rows):
        spark.createDataFrame([(1, m, p, start + dt.timedelta(hours=h), start + dt.timedelta(hours=h + 2)) for m, p, h in rows], "trip bigint, member bigint, point bigint, ts timestamp, expires timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)

    put([(m, m, 0) for m in range(50)])
    put([(m, 100 + m, 1) for m in range(5)])
    put([(99, 999, 30)])
    put([(99, 1000, 30.5)])
    with sharing.timed_state(spark):
        run = sharing.latest_positions(stream()).writeStream.outputMode("update").foreachBatch(lambda batch, n: seen.extend(batch.collect())).option(
            "checkpointLocation", str(tmp_path / "checkpoint")
        ).trigger(availableNow=True).start()
        run.awaitTermination()
        states = [p["stateOperators"][0]["numRowsTotal"] for p in run.recentProgress if p["stateOperators"]]
    newest = {}
    for r in seen:
        newest[r["member"]] = r["point"]
    assert newest == {**{m: m for m in range(50)}, **{m: 100 + m for m in range(5)}, 99: 1000}
    assert max(states) > 50 and states[-1] < 10


def test_sharing_sessions_clamp_hours_pause_and_resume():
    live, closed, _ = sharing.advance(None, 0, "start", 0)
    assert live == (0, sharing.HOUR, 1, 0, 0, 0, False) and closed is None
    live, _, _ = sharing.advance(live, 10, "start", 99)
    assert live == (0, 10 + 12 * sharing.HOUR, 2, 0, 0, 0, False)
    for kind, kept in (("point", True), ("pause", False), ("pause", False), ("point", False), ("resume", False), ("point", True)):
        live, closed, took = sharing.advance(live, 20, kind, 1)
        assert closed is None and took == kept
    assert live[3:] == (1, 2, 1, False)
    assert sharing.advance(live, 30, "stop", 1)[:2] == (None, (0, 30, 2, 1, 0, 2, 1, "stopped"))
    state, closed, _ = sharing.advance(live, 14 * sharing.HOUR, "stop", 1)
    assert state is None and closed[4:] == (2, 0, 1, "expired")
    assert sharing.advance(None, 5, "point", 1) == (None, None, False) == sharing.advance(None, 5, "stop", 1)


def test_update_stream_over_several_batches_equals_batch(spark, root):
    staged = work_path(spark, "staged")
    spark.read.parquet(f"{root}/events.parquet").repartition(4).write.parquet(staged)
    stream = runs.event_stream(spark, staged, "*.parquet", maxFilesPerTrigger=1).groupBy("event_type").agg(F.count("*").alias("n"))
    mine = {r["event_type"]: r["n"] for r in runs.update_run(stream, ["event_type"], "counts").collect()}
    batch = {r["event_type"]: r["count"] for r in spark.read.parquet(staged).groupBy("event_type").count().collect()}
    assert mine == batch


def test_trailing_requests_equal_loop(spark):
    rng = random.Random(3)
    t0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    rows = [(i, "hot" if i % 3 else "k", t0 + dt.timedelta(seconds=rng.randrange(900))) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, key string, ts timestamp")
    got = {r["id"]: r["hits"] for r in runs.trailing_requests(df, "key", 60, 5).collect()}
    for i, key, ts in rows:
        assert got[i] == sum(1 for _, k, t in rows if k == key and dt.timedelta(0) <= ts - t <= dt.timedelta(seconds=60))


def test_trailing_requests_of_a_busy_second_use_growing_frames(spark):
    """A window of a sliding frame costs its own size per row; running counts do not. Nulls and ties are kept as before."""
    t0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    rows = [(0, "a", t0), (1, "a", t0), (2, None, t0), (3, None, t0 + dt.timedelta(seconds=60)), (4, "a", None), (5, "a", t0 + dt.timedelta(seconds=61)), (5, "a", t0 + dt.timedelta(seconds=61))]
    out = runs.trailing_requests(spark.createDataFrame(rows, "id int, key string, ts timestamp"), "key", 60, 1)
    assert out.columns == ["id", "key", "ts", "hits", "over", "retry_after"]
    got = sorted((r["id"], r["hits"], r["over"], r["retry_after"]) for r in out.collect())
    assert got == [(0, 2, True, 60.0), (1, 2, True, 60.0), (2, 1, False, 0.0), (3, 2, True, 0.0), (5, 2, True, 60.0), (5, 2, True, 60.0)]
    assert "RangeFrame, -" not in out._jdf.queryExecution().toString()


def test_counts_and_unique_rows_with_late_rows_over_many_triggers(spark, tmp_path):
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    files = [[(1, 0), (2, 5), (3, 100)], [(4, 10), (5, 99), (5, 99)], [(6, 300), (3, 100), (7, None)], [(8, 200), (6, 300), (9, 290)]]
    for i, rows in enumerate(files):
        spark.createDataFrame([(k, None if h is None else at(h)) for k, h in rows], "k int, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    # one file a trigger, in order of their names: the marks after each are 100, 100 and 300 hours
    stamp = 1_700_000_000
    for i in range(len(files)):
        for file in (tmp_path / "in" / str(i)).glob("*.parquet"):
            os.utime(file, (stamp + 10 * i, stamp + 10 * i))
    stream = lambda: spark.readStream.schema("k int, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    mark, late, on_time, known, unique = None, [], [], set(), []
    for rows in files:
        for k, h in rows:
            if h is None or (mark is not None and h < mark - 24):
                late.append(k)
                continue
            on_time.append(k)
            if k not in known:
                known.add(k)
                unique.append(k)
        mark = max([h for _, h in rows if h is not None] + ([mark] if mark else []))
    count = lambda rows: rows.groupBy("k").agg(F.count("*").alias("n"))
    counts, refused = runs.count_run(stream(), "24 hours", count, ["k"], "counted")
    assert {r["k"]: r["n"] for r in counts.collect()} == {k: on_time.count(k) for k in on_time}
    assert sorted(r["k"] for r in refused.collect()) == sorted(late) == [4, 7, 8]
    kept, refused = runs.unique_run(stream(), "24 hours", "k", "unique")
    assert sorted(r["k"] for r in kept.collect()) == sorted(unique)
    assert refused.count() == len(late)


def test_rolling_health_merges_panes_of_many_batches(spark):
    rng = random.Random(8)
    t0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    rows = [("s", t0 + dt.timedelta(minutes=rng.randrange(3000)), rng.random() < 0.9, rng.random() < 0.1, rng.random()) for _ in range(3000)]
    rows += [("empty", t0, True, False, None), ("s", None, True, False, 5.0)]
    df = spark.createDataFrame(rows, "service string, ts timestamp, ok boolean, fallback boolean, value double")
    parts = df.randomSplit([1.0, 1.0, 1.0], 1)
    panes = runs.health_panes(parts[0]).unionByName(runs.health_panes(parts[1])).unionByName(runs.health_panes(parts[2]))
    got = {(r["service"], r["start"].replace(tzinfo=dt.timezone.utc)): r for r in runs.rolling_health(panes).collect()}
    assert got["empty", t0]["p95"] is None and got["empty", t0]["calls"] == 1
    for (service, start), r in got.items():
        mine = sorted((v, ok, fb) for s, ts, ok, fb, v in rows if s == service == "s" and ts and start <= ts < start + dt.timedelta(days=1))
        if mine:
            assert r["calls"] == len(mine)
            assert r["error_rate"] == pytest.approx(sum(not ok for _, ok, _ in mine) / len(mine), abs=1e-4)
            assert abs(sum(v <= r["p95"] for v, _, _ in mine) - 0.95 * len(mine)) <= 0.02 * len(mine) + 1


def test_late_rows_go_to_a_side_table_and_none_is_lost(spark, root):
    from waymark.plans.registry import all_queries

    rows = {r["late"]: r["n"] for r in all_queries()["ST11_late_events"](spark, root).collect()}
    assert sum(rows.values()) == spark.read.parquet(f"{root}/events.parquet").count()
    assert rows.get(True, 0) > 0


def test_auc_and_average_precision_equal_loops(spark):
    rng = random.Random(5)
    rows = [("m", round(rng.random(), 1), int(rng.random() < 0.4)) for _ in range(150)]
    got = M.ranking_metrics(spark.createDataFrame(rows, "model string, score double, label int"), ["model"]).first()
    pos, neg = [s for _, s, y in rows if y], [s for _, s, y in rows if not y]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    ap = sum(sum(y for _, s, y in rows if s == t) * sum(y for _, s, y in rows if s >= t) / sum(1 for _, s, _ in rows if s >= t) for t in {s for _, s, _ in rows}) / len(pos)
    assert got["auc"] == pytest.approx(auc) and got["pr_auc"] == pytest.approx(ap)


def test_bootstrap_interval_holds_the_exact_gap(spark):
    rng = random.Random(9)
    rows = []
    for i in range(300):
        y = int(rng.random() < 0.5)
        rows.append((i, y, round(min(1, max(0, 0.3 * y + rng.random() * 0.7)), 3), round(rng.random(), 3)))
    df = spark.createDataFrame(rows, "doc_id bigint, label int, challenger double, control double")
    out = M.bootstrap_gap(df, 200).first()
    auc = lambda i: sum((a > b) + 0.5 * (a == b) for a in [r[i] for r in rows if r[1]] for b in [r[i] for r in rows if not r[1]]) / (sum(r[1] for r in rows) * sum(1 - r[1] for r in rows))
    assert out["ci_low"] <= auc(2) - auc(3) <= out["ci_high"]
    assert out["resamples"] == 200 and out["significant"]
    assert M.bootstrap_gap(df.repartition(7), 200).first() == out  # draws follow the cells, not the partitions


def test_resampled_auc_equals_plain_auc(spark):
    """Many equal scores, several ranges, and weights drawn again outside of Spark."""
    rng = random.Random(4)
    rows = [(rng.random() < 0.4, rng.randrange(12) / 12, rng.randrange(5) / 5) for _ in range(400)]
    df = spark.createDataFrame([(int(y), a, b) for y, a, b in rows], "label int, challenger double, control double")
    cells = df.groupBy("challenger", "control", "label").count().withColumnRenamed("count", "n").withColumn("seed", F.xxhash64("challenger", "control", "label"))
    drawn = [(c, np.random.Generator(np.random.PCG64(c["seed"] & (1 << 63) - 1)).poisson(c["n"], 20)) for c in cells.collect()]
    got = {r["resample"]: r["auc"] for r in M._resampled_auc(cells, "challenger", 20).collect()}
    for i in range(20):
        pairs = [(w[i] * v[i], (c["challenger"] > d["challenger"]) + 0.5 * (c["challenger"] == d["challenger"])) for c, w in drawn if c["label"] for d, v in drawn if not d["label"]]
        assert got[i] == pytest.approx(sum(w * s for w, s in pairs) / sum(w for w, _ in pairs), abs=1e-12)


def test_cut_writes_to_the_shared_folder_and_ends_the_plan(spark):
    df = cut(spark.range(5).withColumn("x", F.col("id") * 2), "demo")
    assert shared_dir(spark) in df.inputFiles()[0]
    assert sorted(r["x"] for r in df.collect()) == [0, 2, 4, 6, 8]


def test_streams_read_tables_of_one_file_and_of_many(spark, root, tmp_path):
    queries = registry.all_queries()
    spark.read.parquet(f"{root}/events.parquet").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    for key in ("ST1_private_ingest", "ST9_deduplicated_ingest", "ST2_daily_counts"):
        one, many = (sorted(map(repr, queries[key](spark, at).collect())) for at in (root, str(tmp_path)))
        assert one and one == many, key


def test_streams_fail_without_a_table(spark, tmp_path):
    with pytest.raises(AnalysisException):
        runs.event_stream(spark, str(tmp_path))


def test_report_shows_every_row(spark, tmp_path):
    path = catalogue.report(spark.range(1001).selectExpr("id", "if(id = 7, null, 'a|b')  AS `x.y`"), f"{tmp_path}/report")
    parts = sorted((tmp_path / "report" / "table").glob("part-*"))
    lines = [line for part in parts for line in part.read_text().splitlines()]
    assert lines[:2] == ["| id | x.y |", "|---|---|"]
    assert sorted(lines[2:]) == sorted(f"| {i} | " + ("" if i == 7 else "a\\|b") + " |" for i in range(1001))
    assert spark.read.json(f"{path}/rows").count() == 1001


def test_audit_uses_the_day_window_of_each_trip(spark):
    stops = spark.createDataFrame(
        [(1, 0, 5, 530, 600, 540, 1080), (1, 0, 6, 1020, 1140, 540, 1080), (2, 0, 5, 530, 600, 520, 1200), (2, 0, 6, 1020, 1140, 520, 1200)],
        "plan long, day int, place long, start_min int, end_min int, day_start int, day_end int",
    )
    found = A.stop_issues(stops, "starts_before_day_window", "ends_after_day_window", "non_positive_duration").collect()
    assert sorted((r["plan"], r["place"], r["code"]) for r in found) == [(1, 5, "starts_before_day_window"), (1, 6, "ends_after_day_window")]


def test_only_long_days_need_a_meal(spark):
    acts = spark.createDataFrame([(p, 0, "visit", 10) for p in (1, 2)], "plan long, day int, kind string, travel_min int")
    trips = spark.createDataFrame([(1, "relaxed", 540, 900), (2, "relaxed", 540, 901)], "trip long, pace string, day_start int, day_end int")
    assert [(r["plan"], r["code"]) for r in A.day_issues(acts, trips).collect()] == [(2, "no_meal_break")]


def test_catalogue_files_may_be_indented_and_must_exist(spark, tmp_path):
    place = {"place": 7, "name": "gate", "lat": 1.0, "lon": 2.0, "tags": ["fort"]}
    for circuit in (1, 2):
        body = {"cluster": {"circuit": circuit, "center_lat": 1.0, "center_lon": 2.0}, "attractions": [place]}
        (tmp_path / f"c{circuit}.json").write_text(json.dumps(body, indent=2))
    got = catalogue.read_catalogue(spark, str(tmp_path), whole_files=True).collect()
    assert sorted((r["source_file"], r["circuit"], r["name"]) for r in got) == [("c1.json", 1, "gate"), ("c2.json", 2, "gate")]
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        catalogue.read_catalogue(spark, str(tmp_path)).collect()
    (tmp_path / "none").mkdir()
    with pytest.raises(MissingTable):
        catalogue.read_catalogue(spark, str(tmp_path / "none"))


def test_split_keeps_the_share_of_each_label(spark):
    rows = spark.range(1003).select("id", F.when(F.col("id") % 50 == 0, None).otherwise((F.col("id") % 10 == 0).cast("int")).alias("label"))
    got = {r["label"]: (r["n"], r["t"]) for r in M.split(rows, "id").groupBy("label").agg(F.count("*").alias("n"), F.count_if("test").alias("t")).collect()}
    assert sum(n for n, _ in got.values()) == 1003 and all(t == n // 4 for n, t in got.values())


def test_audit_never_broadcasts_the_catalogue(spark, root):
    from waymark.plans import audit
    from waymark.sources import views as V

    acts, places = V.activities(spark, root), V.places(spark, root)
    stops = acts.withColumn("start_date", F.lit("2024-01-20").cast("date"))
    trips = V.trips(spark, root)
    for made in (audit.with_openings(stops, places), audit.with_attributes(acts, places), A.cost_range(trips, acts, places).select("trip", "low")):
        plan = made._jdf.queryExecution().executedPlan().toString()
        exchanged = [part.split("FileScan", 1)[1] for part in plan.split("BroadcastExchange")[1:] if "FileScan" in part]
        assert not any("p_partkey" in scan.split("\n")[0] for scan in exchanged), plan


class Counted:
    """A handle whose timers and states count the messages sent to them."""

    def __init__(self):
        self.sent, self.value, self.rows, self.timers = 0, None, [], set()

    def getValueState(self, *_):
        return self

    def getListState(self, *_):
        trail = Counted()
        self.trail, trail.appendList, trail.clear = trail, self._told(lambda rows: trail.rows.extend(rows)), self._told(lambda: trail.rows.clear())
        return trail

    def _told(self, act):
        def message(*values):
            self.sent += 1
            return act(*values)

        return message

    def __getattr__(self, name):
        acts = {
            "get": lambda: self.value, "exists": lambda: self.value is not None, "update": lambda v: setattr(self, "value", v),
            "clear": lambda: setattr(self, "value", None), "registerTimer": self.timers.add, "deleteTimer": self.timers.discard,
        }
        if name not in acts:
            raise AttributeError(name)
        return self._told(acts[name])


def test_a_share_of_events_sends_few_messages_to_the_state():
    """The messages of a share do not grow with its events, and the trail is that of the live session."""
    handle, sessions = Counted(), sharing.Sessions()
    sessions.init(handle)
    held, kept, want, got = None, [], [], []
    for share in range(3):
        kinds = ["point", "start", "point", "pause", "point", "resume", "point", "stop", "point"] * 20 + ["start", "point", "point"] * (share != 1)
        rows = [(share * 1000 + i, (share * 1000 + i) * 1_000_000, k, 3) for i, k in enumerate(kinds)]
        for event, at, kind, hours in rows:
            first = held[0] if held else None
            held, closed, point = sharing.advance(held, at, kind, hours)
            want += [(7, 8, *closed)] if closed else []
            kept = [] if held is None or held[0] != first else kept
            kept += [(event, at)] if point else []
        before = handle.sent
        frame = pd.DataFrame(rows[::-1], columns=["event_id", "at", "kind", "hours"])
        got += [tuple(r) for part in sessions.handleInputRows((7, 8), iter([frame[:50], frame[50:]]), None) for r in part.itertuples(index=False)]
        assert handle.sent - before <= 6
        assert handle.value == held and handle.trail.rows == kept and handle.timers == ({held[1] // 1000} if held else set())
    assert got == want and len(got) == 60
