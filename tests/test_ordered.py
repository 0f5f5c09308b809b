"""Ordered routers over whole streams against the event loop."""

import random

import pytest
from cohortlab.operators import ordered, simulate
from cohortlab.plans import studies

ARRIVAL = "arrival_seq long, user_id string"
BAD = [1000, 0, 0, 900, 0, 17, 0, 0, 300, 5]


def stream(n, users, seed):
    rng = random.Random(seed)
    return [f"user_{rng.randrange(users)}" for _ in range(n)]


def groups_of(df):
    return [r["group_id"] for r in df.orderBy("k").collect()]


@pytest.mark.parametrize("guess", [None, BAD])
def test_calibrated_routers_in_ranges(spark, guess):
    ids = stream(2500, 700, 1)
    arrivals = spark.createDataFrame(list(enumerate(ids)), ARRIVAL).repartition(5)
    run = lambda f, **b: groups_of(f(arrivals, ["arrival_seq"], size=300, guess=guess, **b))
    assert run(ordered.calibrated_route) == simulate.fold_calibrated(ids, "exp_001")
    assert run(ordered.share_calibrated_route) == simulate.fold_share_calibrated(ids, "exp_001")
    assert run(ordered.sticky_route) == studies.sticky(ids, "exp_001")


def test_ranges_that_never_agree_are_folded_in_turn(spark):
    """Without picks a state never forgets, so every range waits for the one before it."""
    rng = random.Random(4)
    rows = [(i, rng.randrange(10), i % 400 == 399) for i in range(1000)]
    count, want = [0] * 10, []
    for _, base, pick in rows:
        g = count.index(min(count)) if pick else base
        count[g] += 1
        want.append(g)
    got = ordered.fold_ranges(spark.createDataFrame(rows, "i long, base int, pick boolean"), size=150, guess=BAD).orderBy("i").collect()
    assert [r["group_id"] for r in got] == want
    assert ordered.fold_ranges(spark.createDataFrame([], "i long, base int, pick boolean")).count() == 0


@pytest.mark.parametrize("block", [2, 7, 2000])
def test_adaptive_router_in_blocks(spark, block):
    ids = stream(3030, 400, 6)
    want = simulate.fold_adaptive(ids, "exp_001", buckets=60, window=100, warm=sorted(set(ids)))
    arrivals = spark.createDataFrame(list(enumerate(ids)), ARRIVAL)
    got = ordered.adaptive_route(arrivals, ["arrival_seq"], buckets=60, window=100, block=block)
    assert groups_of(got) == want
    fixed = {}
    assert any(fixed.setdefault(u, g) != g for u, g in zip(ids, want))  # buckets moved


def test_adaptive_router_without_changes_or_rows(spark):
    ids = stream(2000, 500, 8)
    arrivals = spark.createDataFrame(list(enumerate(ids)), ARRIVAL)
    got = ordered.adaptive_route(arrivals, ["arrival_seq"], buckets=60, window=100, limit=5.0, block=2)
    assert groups_of(got) == simulate.fold_adaptive(ids, "exp_001", buckets=60, window=100, limit=5.0, warm=sorted(set(ids)))
    assert ordered.adaptive_route(arrivals.limit(0), ["arrival_seq"]).count() == 0
