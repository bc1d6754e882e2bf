"""Stateful stream operators: rate limiter, circuit breaker, job progress."""
from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def admitted(times: list[float], taken: list[float], most: int, seconds: float) -> tuple[list[bool], list[float]]:
    """Decisions for ascending times given the admitted ones before; rejected requests do not count."""
    out = []
    for t in times:
        taken = [x for x in taken if x > t - seconds]
        ok = len(taken) < most
        if ok:
            taken.append(t)
        out.append(ok)
    return out, taken


def rate_limited(events: DataFrame, key: str = "user_id", most: int = 100, seconds: float = 60.0) -> DataFrame:
    """Stream of (key, event_id, allowed): at most ``most`` admitted requests a key in a sliding window. State is the admitted times of one window."""

    def step(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        taken = list(state.get[0]) if state.exists else []
        p = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        times = [t.timestamp() for t in p["ts"]]
        ok, taken = admitted(times, taken, most, seconds)
        state.update((taken,))
        yield pd.DataFrame({key: p[key], "event_id": p["event_id"], "allowed": ok})

    x = events.select(key, "event_id", F.col("ts").cast("timestamp").alias("ts"))
    return x.groupBy(key).applyInPandasWithState(step, f"{key} long, event_id long, allowed boolean", "taken array<double>", "append", GroupStateTimeout.NoTimeout)


def admitted_rows(events: DataFrame, key: str = "user_id", most: int = 100, seconds: float = 60.0) -> DataFrame:
    """rate_limited for a table: (key, event_id, allowed). Rows come in order of key and time, so a task holds the admitted times of one key's window and nothing else."""

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, taken = None, []
        for p in batches:
            allowed = []
            for k, t in zip(p[key], p["us"], strict=True):
                if k != last:
                    last, taken = k, []
                ok, taken = admitted([t / 1e6], taken, most, seconds)
                allowed += ok
            yield pd.DataFrame({key: p[key], "event_id": p["event_id"], "allowed": allowed})

    x = events.select(key, "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return x.repartition(key).sortWithinPartitions(key, "us", "event_id").mapInPandas(step, f"{key} long, event_id long, allowed boolean")


class Breaker:
    """CLOSED opens after ``limit`` failures in a row; OPEN lets one probe pass after ``wait`` seconds (HALF_OPEN); its outcome closes or opens again."""

    def __init__(self, state: str = "CLOSED", failures: int = 0, opened: float = 0.0, limit: int = 5, wait: float = 30.0):
        self.state, self.failures, self.opened, self.limit, self.wait = state, failures, opened, limit, wait

    def call(self, at: float, ok: bool) -> str:
        """State after a call at a time; a call while open is refused and changes nothing."""
        if self.state == "OPEN":
            if at - self.opened < self.wait:
                return self.state
            self.state = "HALF_OPEN"
        if ok:
            self.state, self.failures = "CLOSED", 0
        else:
            self.failures += 1
            if self.state == "HALF_OPEN" or self.failures >= self.limit:
                self.state, self.opened = "OPEN", at
        return self.state


def circuit_breakers(calls: DataFrame, key: str = "user_id", limit: int = 5, wait: float = 30.0) -> DataFrame:
    """Stream of (key, event_id, state) for calls (key, event_id, ts, ok)."""

    def step(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        b = Breaker(*state.get, limit, wait) if state.exists else Breaker(limit=limit, wait=wait)
        p = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        states = [b.call(t.timestamp(), bool(ok)) for t, ok in zip(p["ts"], p["ok"], strict=True)]
        state.update((b.state, b.failures, b.opened))
        yield pd.DataFrame({key: p[key], "event_id": p["event_id"], "state": states})

    x = calls.select(key, "event_id", F.col("ts").cast("timestamp").alias("ts"), "ok")
    return x.groupBy(key).applyInPandasWithState(step, f"{key} long, event_id long, state string", "state string, failures int, opened double", "append", GroupStateTimeout.NoTimeout)


def backoff(attempt: int, base: float = 5.0, most: float = 60.0) -> float:
    """Seconds before the n-th retry: base, doubled each time, up to most."""
    return min(base * 2 ** (attempt - 1), most)
