"""Results kept for a while, and calls that are tried again."""
from __future__ import annotations

import hashlib
import json
import random
import time
from collections import OrderedDict
from collections.abc import Callable

from pyspark.sql import DataFrame


def cache_key(kind: str, **settings) -> str:
    """A key that depends on a query's settings, not on their order."""
    return f"{kind}:{hashlib.sha256(json.dumps(settings, sort_keys=True, default=str).encode()).hexdigest()[:16]}"


class ResultCache:
    """Persisted results by key: each for ``seconds``, and at most ``most``, of which the one asked for longest ago goes first. What goes is unpersisted."""

    def __init__(self, most: int = 100, seconds: float = 300.0, clock: Callable[[], float] = time.monotonic):
        self.most, self.seconds, self.clock = most, seconds, clock
        self.hits = self.misses = 0
        self._held: OrderedDict[str, tuple[float, DataFrame]] = OrderedDict()

    def get(self, key: str, make: Callable[[], DataFrame]) -> DataFrame:
        now = self.clock()
        for old in [k for k, (until, _) in self._held.items() if until <= now]:
            self.drop(old)
        if key in self._held:
            self.hits += 1
            self._held.move_to_end(key)
            return self._held[key][1]
        self.misses += 1
        made = make().persist()
        self._held[key] = (now + self.seconds, made)
        while len(self._held) > self.most:
            self.drop(next(iter(self._held)))
        return made

    def drop(self, key: str) -> None:
        _, df = self._held.pop(key)
        df.unpersist()

    def drop_like(self, prefix: str) -> int:
        """Drops all results whose keys begin so, as after a change of what they were made from."""
        gone = [k for k in self._held if k.startswith(prefix)]
        for k in gone:
            self.drop(k)
        return len(gone)

    @property
    def hit_rate(self) -> float:
        asked = self.hits + self.misses
        return self.hits / asked if asked else 0.0


def retried(call: Callable, attempts: int = 3, base: float = 1.0, most: float = 60.0, jitter: float = 0.5, on: tuple = (Exception,), sleep: Callable[[float], None] = time.sleep, seed: int | None = None):
    """call(), tried again after base, 2 base, ... seconds, each off by up to a share of jitter; the last failure is raised."""
    pick = random.Random(seed)
    for n in range(attempts):
        try:
            return call()
        except on:
            if n == attempts - 1:
                raise
            sleep(min(most, base * 2**n) * (1 + pick.uniform(-jitter, jitter)))
