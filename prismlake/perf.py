"""Times of stages: count, total, longest, median and ninth tenth of each."""

from __future__ import annotations

import time
from contextlib import contextmanager


class Stats:
    def __init__(self):
        self.times: dict[str, list[float]] = {}

    @contextmanager
    def measure(self, stage: str):
        began = time.perf_counter()
        try:
            yield
        finally:
            self.add(stage, time.perf_counter() - began)

    def add(self, stage: str, seconds: float) -> None:
        self.times.setdefault(stage, []).append(seconds)

    def summary(self) -> dict[str, dict[str, float]]:
        out = {}
        for stage, times in self.times.items():
            t = sorted(times)
            out[stage] = {"count": len(t), "total": sum(t), "mean": sum(t) / len(t), "max": t[-1], "median": t[(len(t) - 1) // 2], "p90": t[(len(t) - 1) * 9 // 10]}
        return out
