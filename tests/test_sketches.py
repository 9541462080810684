"""Sketch roll-ups against exact counts, and exact quantiles against sorting."""

import math
import random
from collections import defaultdict
from datetime import datetime, timedelta

import numpy as np
import pytest

from weftlake.operators import sketches


@pytest.fixture(scope="module")
def log():
    r = random.Random(6)
    start = datetime(2024, 1, 1)
    rows = [(start + timedelta(minutes=r.randrange(60 * 24 * 4)), "hot" if r.random() < 0.6 else r.choice(["a", "b", None]), r.randrange(9000), r.gauss(0, 50) if r.random() < 0.7 else 3.0) for _ in range(30_000)]
    return rows + [(start, "none", None, None)] * 4 + [(None, "hot", 1, 1.0), (start, "one", 5, 2.5), (start, "one", 5, math.nan)]


@pytest.fixture(scope="module")
def events(spark, log):
    return spark.createDataFrame(log, "ts timestamp, event_type string, user_id long, value double").repartition(6)


def test_any_range_is_read_from_the_rollup(events, log):
    rollup = sketches.sketch_rollup(events, ["event_type"], "user_id", "value")
    kept = rollup.filter("bucket >= TIMESTAMP '2024-01-01 05:00:00' AND bucket < TIMESTAMP '2024-01-03 17:00:00'")
    got = {r.event_type: r for r in sketches.read_rollup(sketches.merged_rollup(kept, ["event_type"])).collect()}
    by = defaultdict(list)
    for ts, kind, user, value in log:
        if ts and datetime(2024, 1, 1, 5) <= ts < datetime(2024, 1, 3, 17):
            by[kind].append((user, value))
    assert got.keys() == by.keys()
    for kind, rows in by.items():
        users, values = len({u for u, _ in rows}), np.sort([v for _, v in rows])
        assert got[kind].n == len(rows) and abs(got[kind].users - users) <= 0.02 * users
        for name, q in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99)):
            lo, hi = np.searchsorted(values, got[kind][name], "left") / len(values), np.searchsorted(values, got[kind][name], "right") / len(values)
            assert lo - 0.01 <= q <= hi + 0.01


@pytest.mark.parametrize("aside", [0.01, 0.0, 1.0])
def test_quantiles_are_exact(events, log, monkeypatch, aside):
    """Also where the first look is at nothing but the sketch's own value, so that the rest takes another pass."""
    monkeypatch.setattr(sketches, "ASIDE", aside or 1e-9)
    monkeypatch.setattr(sketches, "KLL_K", 8)
    by = defaultdict(list)
    for _, kind, _, v in log:
        by[kind] += [v] if v is not None and not math.isnan(v) else []
    got = {r.event_type: r for r in sketches.exact_quantiles(events, "event_type", "value").collect()}
    assert got.keys() == by.keys() and got["none"].p50 is None
    for kind, values in by.items():
        if values:
            assert np.allclose([got[kind].p50, got[kind].p90, got[kind].p99], np.quantile(values, [0.5, 0.9, 0.99]))
    assert sketches.exact_quantiles(events.limit(0), "event_type", "value").count() == 0
