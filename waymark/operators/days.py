"""Splitting a trip's places into geographic days, balancing them, and filling a day's clock."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions import constants as K, geo
from waymark.functions.stats import bound, rnd

SLICE = 1 << 17  # places of the trips that advance together, about


def project(items: DataFrame) -> DataFrame:
    """One row a trip: its places by id in planar kilometres, and the number ``k`` of groups."""
    here = F.struct("place", "lat", "lon", "score")
    held = items.where("trip is not null").groupBy("trip").agg(
        F.avg("lat").alias("ref"), F.least(F.greatest(F.lit(1), F.max("days")), F.count("*")).cast("int").alias("k"), F.collect_list(here).alias("points")
    )
    flat = lambda p: F.struct(
        p["place"].alias("place"), geo.project_x(p["lat"]).alias("x"), geo.project_y(p["lon"], F.col("ref")).alias("y"), p["score"].alias("score")
    )
    return held.select("trip", "k", F.array_sort(F.transform("points", flat)).alias("points"))


class _Trips:
    """Some trips side by side: points in one flat row sorted by trip, centres as trip by number; nan is no position.

    Distances are whole millimetres, so that ties do not depend on binary noise; -1 stands for none.
    """

    def __init__(self, k: np.ndarray, sizes: np.ndarray, place: pa.Array, x: np.ndarray, y: np.ndarray, score: np.ndarray):
        self.k, self.n, self.x, self.y = k, sizes, x, y
        self.trip = np.repeat(np.arange(len(k)), sizes)
        self.named = np.asarray(place.is_valid())
        self.place = pc.fill_null(place, 0).to_numpy(zero_copy_only=False)
        self.score = np.where(np.isnan(score), -np.inf, score)
        # of equals the smaller place comes first; of one place the larger position
        order = np.lexsort((_low(y), _low(x), -self.place, self.named))
        self.turn = np.empty(len(x), dtype=np.int64)
        self.turn[order] = np.arange(len(x))
        self.cx, self.cy = np.full((2, len(k), int(k.max())), np.nan)
        self.centres = np.zeros(len(k), dtype=np.int64)

    def gap(self, p: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Distance of points from centres of their trips, -1 where one has no position."""
        dx, dy = self.x[p] - self.cx[self.trip[p], c], self.y[p] - self.cy[self.trip[p], c]
        d = np.floor(np.sqrt(dx * dx + dy * dy) * 1e6 + 0.5)
        return np.where(np.isnan(d), -1.0, d)

    def first(self, p: np.ndarray, value: np.ndarray, turn: np.ndarray) -> np.ndarray:
        """Of points sorted by trip, for each trip among them the one of the highest value, then of the highest turn."""
        starts = np.flatnonzero(np.diff(self.trip[p], prepend=-1))
        own = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(p))))
        ahead = np.where(value == np.maximum.reduceat(value, starts)[own], turn, -np.inf) if len(p) else turn
        best = ahead == np.maximum.reduceat(ahead, starts)[own] if len(p) else np.zeros(0, dtype=bool)
        return p[np.flatnonzero(best)]

    def seed(self) -> None:
        """The best-scored place, then repeatedly the place furthest from all seeds."""
        every = np.arange(len(self.x))
        far, free = np.full(len(every), np.inf), self.named.copy()
        chosen = self.first(every, self.score, self.turn.astype(float))
        for c in range(self.cx.shape[1]):
            at = self.trip[chosen]
            self.cx[at, c], self.cy[at, c] = self.x[chosen], self.y[chosen]
            self.centres[at] += 1
            taken = np.zeros(len(self.k), dtype=self.place.dtype)
            taken[at] = self.place[chosen]
            unnamed = np.zeros(len(self.k), dtype=bool)
            unnamed[at] = ~self.named[chosen]
            still = np.zeros(len(self.k), dtype=bool)
            still[at] = self.k[at] > c + 1
            free &= still[self.trip] & ~unnamed[self.trip] & (self.place != taken[self.trip])
            p = np.flatnonzero(free)
            d = self.gap(p, np.full(len(p), c))
            far[p] = np.where(d < 0, far[p], np.minimum(far[p], d))
            chosen = self.first(p, np.where(np.isinf(far[p]), -1.0, far[p]), self.turn[p].astype(float))

    def settle(self, rounds: int) -> None:
        """Every place to its nearest centre, every centre to the mean of its places, until no place moves; an empty group keeps its centre."""
        self.group = np.zeros(len(self.x), dtype=np.int64)
        p, wide = np.arange(len(self.x)), self.cx.shape[1]
        for _ in range(rounds):
            if not len(p):
                break
            nearest, least = np.zeros(len(p), dtype=np.int64), self.gap(p, np.zeros(len(p), dtype=np.int64))
            for c in range(1, wide):
                some = np.flatnonzero(self.centres[self.trip[p]] > c)
                d = self.gap(p[some], np.full(len(some), c))
                closer = some[d < least[some]]
                least[closer], nearest[closer] = d[d < least[some]], c
            moving = np.zeros(len(self.k), dtype=bool)
            moving[self.trip[p[nearest != self.group[p]]]] = True
            self.group[p] = nearest
            real = p[~np.isnan(self.x[p]) & ~np.isnan(self.y[p])]
            cell = self.trip[real] * wide + self.group[real]
            many = np.bincount(cell, minlength=self.cx.size).reshape(self.cx.shape)
            held = many > 0
            for centre, value in ((self.cx, self.x), (self.cy, self.y)):
                centre[held] = np.bincount(cell, value[real], minlength=self.cx.size).reshape(self.cx.shape)[held] / many[held]
            p = p[moving[self.trip[p]]]

    def sizes(self) -> np.ndarray:
        """Places of every group; -1 where a trip has no such group."""
        wide = self.cx.shape[1]
        many = np.bincount(self.trip * wide + self.group, minlength=self.cx.size).reshape(self.cx.shape)
        return np.where(np.arange(wide) < self.k[:, None], many, -1)

    def level(self) -> None:
        """Places one by one from the fullest over-full to the thinnest under-full group, unless one would end up far from home."""
        upper, lower = np.ceil(self.n / self.k * 1.4), np.maximum(1, np.floor(self.n / self.k * 0.5))
        sizes, left = self.sizes(), self.n.copy()
        full, thin = sizes > upper[:, None], (sizes >= 0) & (sizes < lower[:, None])
        at = np.flatnonzero(full.any(axis=1) & thin.any(axis=1))
        p = np.arange(len(self.x))
        while len(at):
            some = sizes[at]
            source = np.argmax(np.where(some > upper[at, None], some, -1), axis=1)
            target = np.argmin(np.where((some >= 0) & (some < lower[at, None]), some, np.iinfo(np.int64).max), axis=1)
            ends = np.full((2, len(self.k)), -1)
            ends[:, at] = source, target
            p = p[ends[0, self.trip[p]] >= 0]
            out = p[self.group[p] == ends[0, self.trip[p]]]
            there, here = self.gap(out, ends[1, self.trip[out]]), self.gap(out, ends[0, self.trip[out]])
            extra = np.where((there < 0) | (here < 0), -np.inf, there - here)  # a place that cannot be measured ends it
            best = self.first(out, -extra, -np.arange(len(out), dtype=float))
            spare = np.full(len(self.k), np.inf)
            spare[self.trip[out[np.searchsorted(out, best)]]] = extra[np.searchsorted(out, best)]
            moves = (spare[at] <= K.BALANCE_MOVE_KM * 1e6) & (spare[at] > -np.inf)
            best = best[moves]
            at, source, target = at[moves], source[moves], target[moves]
            self.group[best] = target
            sizes[at, source] -= 1
            sizes[at, target] += 1
            left[at] -= 1
            some = sizes[at]
            at = at[(left[at] > 0) & (some > upper[at, None]).any(axis=1) & ((some >= 0) & (some < lower[at, None])).any(axis=1)]

    def days(self) -> np.ndarray:
        """The number of every point's group by falling size."""
        order = np.argsort(-self.sizes(), axis=1, kind="stable")
        return np.argsort(order, axis=1, kind="stable")[self.trip, self.group]


def _low(values: np.ndarray) -> np.ndarray:
    return np.where(np.isnan(values), -np.inf, values)


def _clustered(rounds: int, balanced: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            filled = np.cumsum(pc.list_value_length(batch.column("points")).to_numpy(zero_copy_only=False)) // SLICE
            cuts = [0, *(np.flatnonzero(np.diff(filled)) + 1).tolist(), batch.num_rows]
            for part in (batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:]) if b > a):
                points = part.column("points")
                flat, sizes = points.flatten(), pc.list_value_length(points).to_numpy(zero_copy_only=False).astype(np.int64)
                place, x, y, score = flat.flatten()
                real = lambda c: c.cast(pa.float64()).to_numpy(zero_copy_only=False)
                trips = _Trips(part.column("k").to_numpy().astype(np.int64), sizes, place, real(x), real(y), real(score))
                trips.seed()
                trips.settle(rounds)
                if balanced:
                    trips.level()
                yield pa.RecordBatch.from_arrays(
                    [part.column("trip").take(pa.array(trips.trip)), place, pa.array(trips.group, pa.int32()), pa.array(trips.days(), pa.int32())], ["trip", "place", "c", "day"]
                )

    return run


def day_clusters(items: DataFrame, rounds: int = 60, balanced: bool = False) -> DataFrame:
    """(trip, place, c, day): the places of each trip in as many geographic groups as it has days.

    ``items``: trip, place, lat, lon, days, score; a place occurs once in a trip. A trip is one row, which
    holds the places of one circuit; seeds, rounds until no place changes its group and, if asked for, at
    most as many balancing moves as there are places advance for many trips of a partition at a time: no
    job per round. ``day`` numbers the groups by falling size. A place without a position goes to the first
    group and does not move its centre.
    """
    kind = {f.name: f.dataType.simpleString() for f in items.schema.fields}
    return project(items).mapInArrow(_clustered(rounds, balanced), f"trip {kind['trip']}, place {kind['place']}, c int, day int")


# ------------------------------------------------------------------ filling a day
def fill_day() -> Column:
    """Fold the score-ordered ``stops`` of a day into a schedule under clock, travel and fee limits.

    Row columns: stops (place, lat, lon, service, earliest, latest, fee, mandatory), base_lat,
    base_lon, mode, day_start, day_end, max_stops, max_travel, fee_budget (nullable).
    """
    start = F.struct(
        F.col("day_start").cast("int").alias("clock"), F.col("base_lat").alias("lat"), F.col("base_lon").alias("lon"),
        F.lit(0.0).alias("km"), F.lit(0).alias("minutes"), F.lit(0.0).alias("spent"), F.lit(0).alias("n"),
        F.lit(False).alias("meal"), F.lit("").alias("log"),
    )

    def hop(lat1, lon1, lat2, lon2):
        est = geo.leg(lat1, lon1, lat2, lon2, F.col("mode"))
        return F.struct(est["km"].alias("km"), F.bround(est["minutes"], 0).cast("int").alias("min"))

    def step(a, s):
        def with_leg(leg):
            reachable = (a["n"] < F.col("max_stops")) & s["earliest"].isNotNull() & (a["minutes"] + leg["min"] <= F.col("max_travel"))
            meal_at = F.greatest(a["clock"] + K.MEAL_TRAVEL, F.lit(K.MEAL_FROM))
            eats = (
                reachable & ~a["meal"] & (a["clock"] + leg["min"] >= K.MEAL_FROM)
                & (meal_at + K.MEAL_MINUTES <= F.least(F.lit(K.MEAL_TO + K.MEAL_MINUTES), F.col("day_end")))
            )
            clock = F.when(eats, meal_at + K.MEAL_MINUTES).otherwise(a["clock"])
            minutes = F.when(eats, a["minutes"] + K.MEAL_TRAVEL).otherwise(a["minutes"])

            def with_clock(b):
                begin = F.greatest(b["clock"] + leg["min"], s["earliest"])
                affordable = s["mandatory"] | F.col("fee_budget").isNull() | (a["spent"] + s["fee"] <= F.col("fee_budget"))
                taken = reachable & (begin <= s["latest"]) & (begin + s["service"] <= F.col("day_end")) & affordable
                note = F.concat(F.when(a["n"] > 0, ",").otherwise(""), s["place"].cast("string"), F.lit("@"), begin.cast("string"))
                return bound(taken, lambda t: F.struct(
                    F.when(t, begin + s["service"]).otherwise(b["clock"]).cast("int").alias("clock"),
                    F.when(t, s["lat"]).otherwise(a["lat"]).alias("lat"),
                    F.when(t, s["lon"]).otherwise(a["lon"]).alias("lon"),
                    F.when(t, a["km"] + leg["km"]).otherwise(a["km"]).alias("km"),
                    F.when(t, b["minutes"] + leg["min"]).otherwise(b["minutes"]).cast("int").alias("minutes"),
                    F.when(t, a["spent"] + s["fee"]).otherwise(a["spent"]).alias("spent"),
                    F.when(t, a["n"] + 1).otherwise(a["n"]).alias("n"),
                    (a["meal"] | F.coalesce(eats, F.lit(False))).alias("meal"),
                    F.when(t, F.concat(a["log"], note)).otherwise(a["log"]).alias("log"),
                ))

            return bound(F.struct(clock.cast("int").alias("clock"), minutes.cast("int").alias("minutes")), with_clock)

        return bound(hop(a["lat"], a["lon"], s["lat"], s["lon"]), with_leg)

    def finish(a):
        late_meal = F.greatest(a["clock"] + K.MEAL_TRAVEL, F.lit(K.MEAL_FROM)) + K.MEAL_MINUTES <= F.col("day_end")
        back = hop(a["lat"], a["lon"], F.col("base_lat"), F.col("base_lon"))
        out = a["n"] > 0
        return F.struct(
            a["n"].cast("bigint").alias("stops"),
            rnd(F.when(out, a["km"] + back["km"]).otherwise(a["km"]), 3).alias("km"),
            F.when(out, a["minutes"] + back["min"]).otherwise(a["minutes"]).cast("bigint").alias("minutes"),
            rnd(a["spent"], 2).alias("spent"),
            (a["meal"] | late_meal).alias("meal"),
            a["log"].alias("schedule"),
        )

    return F.aggregate("stops", start, step, finish)
