"""Sharing sessions and latest positions as keyed state with event-time timers.

A member's session and trail live in a value and a list of the state store, a position in a value;
a timer at the expiry drops them, so the state holds live members only.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CLOSED_SCHEMA = "trip bigint, member bigint, started bigint, ended bigint, starts int, pauses int, points_kept int, points_deleted int, points_refused int, outcome string"
SESSION_SCHEMA = "started bigint, expires bigint, starts int, pauses int, points int, refused int, paused boolean"
LATEST_SCHEMA = "trip bigint, member bigint, point bigint, expires timestamp"
HOUR = 3_600_000_000
MOST_HOURS = 12
LATENESS = "1 hour"


@contextmanager
def timed_state(spark: SparkSession) -> Iterator[None]:
    """Streams with timers need this state store; the session's own choice is put back."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, STORE)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def advance(state: tuple | None, at: int, kind: str, hours: int) -> tuple[tuple | None, tuple | None, bool]:
    """One event on one member's session: (new state, closed session or None, whether a point is kept).

    State: started, expires, starts, pauses, points, refused, paused. Closed: started, ended, starts, pauses,
    points kept, points deleted, points refused, outcome. A start renews a live session, and wakes a paused
    one; points count only while a session is active; stopping deletes the trail, expiry leaves it.
    """
    closed, kept = None, False
    if state is not None and at >= state[1]:
        closed, state = expired(state), None
    if kind == "start":
        first, starts, pauses, points, refused = (state[0], *state[2:6]) if state else (at, 0, 0, 0, 0)
        state = (first, at + max(1, min(hours, MOST_HOURS)) * HOUR, starts + 1, pauses, points, refused, False)
    elif state is None:
        pass
    elif kind == "pause":
        state = (*state[:3], state[3] + (not state[6]), *state[4:6], True)
    elif kind == "resume":
        state = (*state[:6], False)
    elif kind == "stop":
        closed, state = (state[0], at, *state[2:4], 0, state[4], state[5], "stopped"), None
    elif kind == "point":
        kept = not state[6]
        state = (*state[:4], state[4] + kept, state[5] + (not kept), state[6])
    return state, closed, kept


def expired(state: tuple) -> tuple:
    return (state[0], state[1], state[2], state[3], state[4], 0, state[5], "expired")


class Sessions(StatefulProcessor):
    """One member's live session, its trail, and a timer at its end."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", SESSION_SCHEMA)
        self.trail = handle.getListState("trail", "point bigint, at bigint")

    def _held(self) -> tuple | None:
        found = self.session.get()
        return None if found is None else tuple(found)

    def _put(self, before: tuple | None, after: tuple | None, points: list[tuple], renewed: bool) -> None:
        """The session after a share of events, and its ``points``; a ``renewed`` trail starts anew. A trail is held beside a session only."""
        if before is not None and (after is None or after[1] != before[1]):
            self.handle.deleteTimer(before[1] // 1000)
        if before is not None and (after is None or renewed):
            self.trail.clear()
        if after is None:
            if before is not None:
                self.session.clear()
            return
        if after != before:
            self.session.update(after)
        if before is None or after[1] != before[1]:
            self.handle.registerTimer(after[1] // 1000)
        if points:
            self.trail.appendList(points)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # a micro-batch holds a bounded number of bytes, and a key's share of it is taken in order of time;
        # every call on the state is a message, so they are made once a share, not once an event
        parts = list(rows)
        columns = [np.concatenate([p[c].to_numpy() for p in parts]) for c in ("at", "event_id", "kind", "hours")]
        order = np.lexsort((columns[1], columns[0]))
        before = state = self._held()
        out, points, renewed = [], [], False
        for at, event, kind, hours in zip(*[c[order].tolist() for c in columns]):
            first = state[0] if state else None
            state, closed, kept = advance(state, int(at), kind, int(hours))
            if closed:
                out.append((*key, *closed))
            if state is None or state[0] != first:
                points, renewed = [], True
            if kept:
                points.append((int(event), int(at)))
        self._put(before, state, points, renewed)
        if out:
            yield _closed(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state, out = self._held(), []
        if state is not None and state[1] // 1000 <= expiredTimerInfo.getExpiryTimeInMs():
            out.append((*key, *expired(state)))
            self.session.clear()
            self.trail.clear()
        if out:
            yield _closed(out)

    def close(self) -> None:
        pass


def _closed(rows: list[tuple]) -> pd.DataFrame:
    kinds = {c.split()[0]: {"bigint": "int64", "int": "int32", "string": "object"}[c.split()[1]] for c in CLOSED_SCHEMA.split(", ")}
    return pd.DataFrame({name: np.asarray(values, dtype=kind) for (name, kind), values in zip(kinds.items(), zip(*rows))})


def sharing_actions(events: DataFrame) -> DataFrame:
    """Sharing actions from events: signup starts, error stops, purchase pauses or resumes, the others are points."""
    k = F.get_json_object("props", "$.k").cast("int")
    kind = (
        F.when(F.col("event_type") == "signup", "start").when(F.col("event_type") == "error", "stop")
        .when(F.col("event_type") == "purchase", F.when(k % 2 == 0, "pause").otherwise("resume"))
        .when(F.col("event_type").isin("click", "view"), "point")
    )
    return events.select(
        F.expr("(user_id div 5) * 97").alias("trip"), F.col("user_id").alias("member"), "event_id", "ts", F.unix_micros("ts").alias("at"),
        kind.alias("kind"), F.coalesce(k % 15, F.lit(0)).alias("hours"),
    ).where("kind is not null and ts is not null")


def sharing_sessions(events: DataFrame) -> DataFrame:
    """Closed sessions (stopped or expired) of a stream; live sessions are renewed, paused and resumed."""
    return sharing_actions(events).withWatermark("ts", LATENESS).groupBy("trip", "member").transformWithStateInPandas(
        Sessions(), CLOSED_SCHEMA, "append", "EventTime"
    )


class Positions(StatefulProcessor):
    """A member's latest point, until it expires."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", "at bigint, point bigint, expires bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = tuple(self.latest.get()) if self.latest.exists() else None
        best = before
        for part in rows:
            newest = part.sort_values(["at", "point"]).iloc[-1]
            best = max([b for b in (best, (int(newest["at"]), int(newest["point"]), int(newest["until"]))) if b])
        if best != before:
            if before is not None:
                self.handle.deleteTimer(before[2] // 1000)
            self.latest.update(best)
            self.handle.registerTimer(best[2] // 1000)
            yield pd.DataFrame({"trip": [key[0]], "member": [key[1]], "point": [best[1]], "expires": [pd.Timestamp(best[2], unit="us", tz="UTC")]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.latest.exists() and self.latest.get()[2] // 1000 <= expiredTimerInfo.getExpiryTimeInMs():
            self.latest.clear()
        return iter(())

    def close(self) -> None:
        pass


def latest_positions(points: DataFrame) -> DataFrame:
    """Changes of each member's latest point; ``points``: trip, member, point, ts, expires."""
    rows = points.select("trip", "member", "point", "ts", F.unix_micros("ts").alias("at"), F.unix_micros("expires").alias("until"))
    return rows.withWatermark("ts", LATENESS).groupBy("trip", "member").transformWithStateInPandas(Positions(), LATEST_SCHEMA, "update", "EventTime")
