"""Group ranking against plain loops on a small fixture."""

from __future__ import annotations

import math
import random
import statistics

import pytest

from pyspark.sql import functions as F

from waymark.operators import days as D
from waymark.operators import fairness as G

UTILITIES = {  # trip -> member -> (weight, must-visits, {place: u})
    1: {10: (1.0, [], {1: 0.9, 2: 0.2, 3: 0.5, 4: 0.5}), 11: (2.0, [3], {1: 0.1, 2: 0.8, 3: 1.0, 4: 0.5}), 12: (1.0, [2, 4, 9], {1: 0.4, 2: 0.4, 3: 0.4, 4: 0.4})},
    2: {20: (1.0, [], {5: 0.3, 6: 0.7})},
}


@pytest.fixture(scope="module")
def grid(spark):
    rows = [(t, m, w, must, [], p, u) for t, ms in UTILITIES.items() for m, (w, must, us) in ms.items() for p, u in us.items()]
    return spark.createDataFrame(rows, "trip bigint, member bigint, weight double, must_places array<bigint>, ranked array<bigint>, place bigint, u double")


def covered(trip, member, chosen):
    _, must, us = UTILITIES[trip][member]
    top = sorted((us[p] for p in chosen), reverse=True)[:5]
    value = sum(top) / len(top)
    return round(0.7 * value + 0.3 * (len(set(must) & set(chosen)) / len(must)), 6) if must else round(value, 6)


def test_rules(grid):
    rows = {(r["trip"], r["place"]): r for r in G.aggregated(grid).collect()}
    r = rows[(1, 1)]
    assert r["simple"] == pytest.approx((0.9 + 0.1 + 0.4) / 3, abs=1e-6)
    assert r["weighted"] == pytest.approx((0.9 + 0.2 + 0.4) / 4, abs=1e-6)
    assert r["least"] == 0.1
    assert r["fair"] == pytest.approx(0.65 * r["weighted"] + 0.35 * 0.1, abs=1e-5)


def test_deficits_raise_items_for_the_neglected(grid, spark):
    behind = spark.createDataFrame([(1, 10, 0.0), (1, 11, 0.4), (1, 12, 0.0)], "trip bigint, member bigint, deficit double")
    plain = {r["place"]: r["fair"] for r in G.aggregated(grid).where("trip = 1").collect()}
    raised = {r["place"]: r["fair"] for r in G.aggregated(grid, behind).where("trip = 1").collect()}
    assert raised[2] - plain[2] == pytest.approx(0.25 * 0.8 * 0.4 / 3, abs=1e-5)
    assert raised[2] - plain[2] > raised[1] - plain[1]


def test_borda_ties_share_positions(grid):
    scores = {r["place"]: r["borda"] for r in G.borda(grid).where("trip = 1").collect()}
    # member 10: 3, 1.5, 1.5, 0; member 11 (weight 2): 3, 2, 1, 0; member 12: all 1.5
    expected = {1: 3 + 0 + 1.5, 2: 0 + 2 * 2 + 1.5, 3: 1.5 + 2 * 3 + 1.5, 4: 1.5 + 2 * 1 + 1.5}
    for place, points in expected.items():
        assert scores[place] == pytest.approx(points / (3 * 4), abs=1e-6)


def test_single_item_borda_is_zero(spark):
    g = spark.createDataFrame([(1, 1, 1.0, [], [], 9, 0.4)], "trip bigint, member bigint, weight double, must_places array<bigint>, ranked array<bigint>, place bigint, u double")
    assert G.borda(g).first()["borda"] == 0.0


def test_selection_metrics(grid, spark):
    chosen = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "trip bigint, place bigint")
    row = G.satisfaction(G.member_coverage(grid, chosen, ["trip"]), ["trip"]).first()
    values = [covered(1, m, [1, 2, 3]) for m in (10, 11, 12)]
    assert row["mean"] == pytest.approx(statistics.fmean(values), abs=1e-6)
    assert row["least"] == min(values) and row["least_member"] == 12
    assert row["consensus"] == pytest.approx(1 - statistics.pstdev(values) / 0.5, abs=1e-6)


def test_iterative_selection_equals_greedy_loop(grid, spark):
    scores = spark.createDataFrame(
        [(1, 1, 0.6, False), (1, 2, 0.5, False), (1, 3, 1.4, True), (1, 4, 0.55, False), (2, 5, 0.4, False), (2, 6, 0.3, False)],
        "trip bigint, place bigint, total double, mandatory boolean",
    )
    got = {}
    for r in G.select_fairly(grid, scores, 3).collect():
        got.setdefault(r["trip"], []).append((r["step"], r["place"]))
    table = {}
    for r in scores.collect():
        table.setdefault(r["trip"], {})[r["place"]] = (r["total"], r["mandatory"])
    for trip, items in table.items():
        top = max(abs(t) for t, _ in items.values())
        chosen = [(0, p) for p, (_, must) in items.items() if must]
        step = 0
        while len(chosen) < 3 and len(chosen) < len(items):
            step += 1

            def worth(place):
                values = [covered(trip, m, [p for _, p in chosen] + [place]) for m in UTILITIES[trip]]
                return round(0.65 * (0.65 * round(statistics.fmean(values), 6) + 0.35 * min(values)) + 0.35 * items[place][0] / top, 9)

            pool = [p for p in items if p not in [c for _, c in chosen]]
            chosen.append((step, max(pool, key=lambda p: (worth(p), -p))))
        assert sorted(got[trip]) == sorted(chosen)


def test_wishes_come_before_vetoes_and_lists_may_be_empty(spark):
    rows = [(1, [1, 2], [2, 3], [], 0.5), (2, [], [], [3], 0.5), (3, None, None, None, 0.5)]
    grid = spark.createDataFrame(rows, "member bigint, must_places array<bigint>, avoid_places array<bigint>, ranked array<bigint>, cosine double")
    got = {(r["member"], r["place"]): r["u"] for r in grid.crossJoin(spark.range(1, 5).withColumnRenamed("id", "place")).withColumn("u", G.utility()).collect()}
    assert [got[1, p] for p in range(1, 5)] == [1.0, 1.0, 0.0, 0.5]
    assert [got[2, p] for p in range(1, 5)] == [0.5, 0.5, 0.85, 0.5]
    assert [got[3, p] for p in range(1, 5)] == [0.5] * 4


def brute_clusters(points, k):
    """Farthest-point seeds, Lloyd rounds until stable, then balancing; plain loops."""
    order = sorted(points, key=lambda p: p["place"])
    dist = lambda a, b: math.floor(math.hypot(a[0] - b[0], a[1] - b[1]) * 1e6 + 0.5)
    xy = [(p["x"], p["y"]) for p in order]
    seeds = [max(range(len(order)), key=lambda i: (order[i]["score"], -i))]
    while len(seeds) < k:
        seeds.append(max((i for i in range(len(order)) if i not in seeds), key=lambda i: (min(dist(xy[i], xy[s]) for s in seeds), -i)))
    centres = [xy[s] for s in seeds]
    for _ in range(60):
        assign = [min(range(k), key=lambda c: (dist(p, centres[c]), c)) for p in xy]
        fresh = []
        for c in range(k):
            mine = [p for p, a in zip(xy, assign) if a == c]
            fresh.append((sum(p[0] for p in mine) / len(mine), sum(p[1] for p in mine) / len(mine)) if mine else centres[c])
        if all(math.isclose(a[0], b[0], abs_tol=1e-12) and math.isclose(a[1], b[1], abs_tol=1e-12) for a, b in zip(fresh, centres)):
            break
        centres = fresh
    assign = [min(range(k), key=lambda c: (dist(p, centres[c]), c)) for p in xy]
    n = len(order)
    upper, lower = math.ceil(n / k * 1.4), max(1, math.floor(n / k * 0.5))
    for _ in range(n):
        sizes = [assign.count(c) for c in range(k)]
        over, under = [c for c in range(k) if sizes[c] > upper], [c for c in range(k) if sizes[c] < lower]
        if not over or not under:
            break
        source, target = max(over, key=lambda c: (sizes[c], -c)), min(under, key=lambda c: (sizes[c], c))
        extra = lambda i: dist(xy[i], centres[target]) - dist(xy[i], centres[source])
        best = min((i for i in range(n) if assign[i] == source), key=lambda i: (extra(i), i))
        if extra(best) > 25e6:
            break
        assign[best] = target
    return {p["place"]: a for p, a in zip(order, assign)}


def test_balanced_days_equal_brute_force(spark):
    rows = []
    for trip, (days, n) in enumerate([(3, 12), (2, 9), (4, 14), (1, 5), (5, 3), (3, 16)]):
        for i in range(n):
            # most places huddle in one spot, a few lie apart: balancing has work to do
            lat = 12.0 + (0.004 * ((i * 7 + trip) % 11) if i < n - 2 else 0.12 + 0.01 * i)
            lon = 77.0 + (0.003 * ((i * 5 + trip) % 13) if i < n - 2 else 0.1)
            rows.append((trip, trip * 100 + i, lat, lon, days, ((i * 37 + trip * 11) % 100) / 100))
    items = spark.createDataFrame(rows, "trip bigint, place bigint, lat double, lon double, days int, score double")
    got = {}
    days = {}
    for r in D.day_clusters(items, balanced=True).collect():
        got.setdefault(r["trip"], {})[r["place"]] = r["c"]
        days.setdefault(r["trip"], {})[r["place"]] = r["day"]
    points = {(r["trip"], r["k"]): [p.asDict() for p in r["points"]] for r in D.project(items).collect()}
    assert len(points) == len(got)
    for (trip, k), mine in points.items():
        assert got[trip] == brute_clusters(mine, k), trip
        groups = list(got[trip].values())
        largest_first = sorted(range(k), key=lambda c: (-groups.count(c), c))
        assert days[trip] == {p: largest_first.index(c) for p, c in got[trip].items()}


def test_days_of_one_place_and_of_equal_places(spark):
    schema = "trip bigint, place bigint, lat double, lon double, days int, score double"
    rows = [(1, 7, 12.0, 77.0, 4, 0.5)] + [(2, i, 12.0, 77.0, 3, 0.5) for i in range(5)]
    got = {(r["trip"], r["place"]): r["c"] for r in D.day_clusters(spark.createDataFrame(rows, schema)).collect()}
    assert got[1, 7] == 0 and [got[2, i] for i in range(5)] == [0] * 5
    assert D.day_clusters(spark.createDataFrame([], schema), balanced=True).count() == 0
    rows = [(1, i, 12.0 + i // 3, 77.0, 2, 1.0 - i / 10) for i in range(6)]
    lost = rows + [(1, 9, None, None, 2, 0.1)]
    got = {r["place"]: r["c"] for r in D.day_clusters(spark.createDataFrame(lost, schema)).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1, 5: 1, 9: 0}


def test_one_run_of_picks_serves_every_smaller_size(grid, spark):
    scores = spark.createDataFrame([(1, 1, 0.6, False), (1, 2, 0.5, False), (1, 3, 1.4, True), (1, 4, 0.55, False)], "trip bigint, place bigint, total double, mandatory boolean")
    picks = G.select_fairly(grid, scores, 4)
    for k in (1, 2, 3, 4):
        alone = sorted((r["step"], r["place"]) for r in G.select_fairly(grid, scores.selectExpr("*", f"{k} AS wanted"), "wanted").collect())
        assert alone == sorted((r["step"], r["place"]) for r in G.chosen_first(picks, F.lit(k)).collect())
    assert G.chosen_first(picks, F.lit(0)).first()["place"] == 3  # a mandatory place stays


def test_shuffled_input_gives_the_same_days(spark):
    rows = [(1, i, 12 + (i % 4) * 0.1, 77 + (i % 3) * 0.1, 3, i / 20) for i in range(10)]
    schema = "trip bigint, place bigint, lat double, lon double, days int, score double"
    a = D.day_clusters(spark.createDataFrame(rows, schema)).select("place", "c")
    b = D.day_clusters(spark.createDataFrame(rows[::-1], schema).repartition(3)).select("place", "c")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_days_of_many_trips_advance_together(spark, monkeypatch):
    rng = random.Random(5)
    rows = [
        (trip, trip * 100 + i, 12 + rng.random() ** 4, 77 + rng.random() ** 4, trip % 6 + 1, rng.randrange(5) / 5)
        for trip in range(60) for i in range(1 + trip * 7 % 16)
    ]
    items = spark.createDataFrame(rows, "trip bigint, place bigint, lat double, lon double, days int, score double")
    plan = D.day_clusters(items)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "aggregate(" not in plan  # places are read once, and no fold is interpreted per trip
    trips = D.project(items).coalesce(1).toArrow().combine_chunks()
    monkeypatch.setattr(D, "SLICE", 100)
    told = [r for part in D._clustered(60, True)(iter(trips.to_batches())) for r in part.to_pylist()]
    got = {}
    for r in told:
        got.setdefault(r["trip"], {})[r["place"]] = r["c"]
    for t in trips.to_pylist():
        assert got[t["trip"]] == brute_clusters(t["points"], t["k"]), t["trip"]
    assert sorted(tuple(r.values()) for r in told) == sorted(map(tuple, D.day_clusters(items, balanced=True).collect()))
