"""Scans in chunks against brute force, with chunks of every width."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.prefix import numbered, running
from tidemark.operators.sequencing import _NEVER, release_steps, reordered, tracked


def rows(seed, n=120):
    r = random.Random(seed)
    return [(r.choice(["A", "B"]), i // 2 * 2, i, r.randint(0, 60) + i, r.choice([0, i, i + r.randint(-3, 3)])) for i in range(n)]


@pytest.mark.parametrize("width", [1, 7, 40, 10_000])
def test_running_tracked_and_reordered(spark, width):
    data = rows(width)
    t = spark.createDataFrame(data, "symbol string, arrival long, event_id long, exchange_ts_ns long, sequence long").repartition(3)
    high, want, steps = {}, {}, {}
    for s in "AB":
        own = [x for x in data if x[0] == s]
        latest = top = None
        for i, x in enumerate(own):
            want[x[2]] = (i + 1, top, latest is not None and x[3] < latest)
            latest = x[3] if latest is None else max(latest, x[3])
            top = x[4] if x[4] and (top is None or x[4] > top) else top
        for x, step in zip(own, release_steps(np.array([x[3] for x in own]), 25), strict=True):
            steps[x[2]] = int(step)
        high[s] = len(own)
    order = ["arrival", "event_id"]
    got = numbered(tracked(t, order, width), order, width, ["symbol"])
    assert {r.event_id: (r.n, r.high_water, r.reordered) for r in got.collect()} == want
    assert {r.event_id: r.release_step for r in reordered(t, order, 25, width).collect()} == steps and _NEVER in steps.values()
    # equal times count together, and a sum over all symbols goes on over chunks
    peers = running(t, [], ["arrival"], {"s": ("sum", F.col("exchange_ts_ns"))}, width, peers=True)
    assert {r.event_id: r.s for r in peers.collect()} == {x[2]: sum(y[3] for y in data if y[1] <= x[1]) for x in data}
