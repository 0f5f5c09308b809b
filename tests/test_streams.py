"""Event-time health checks: any split into batches, late rows, failures and restarts."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from cohortlab.operators import balance, effects
from cohortlab.operators.routing import pure_hash
from cohortlab.streaming import health, routers
from pyspark.sql import functions as F

EVENT = "ts timestamp, user_id string, kind string, arm int, value double"
T0 = datetime(2024, 3, 1)


def feed(spark, folder, batches):
    for rows in batches:
        spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(str(folder))


def source(spark, folder):
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(str(folder))


def some_events(n, hours, seed):
    rng = random.Random(seed)
    return sorted((T0 + timedelta(seconds=rng.randrange(hours * 3600)), f"u{rng.randrange(200)}", rng.choice("ab"), rng.randrange(2), rng.gauss(1e6, 3)) for _ in range(n))


def by_hand(batches, delay):
    """(closed hours with their counts of groups' rows, late rows by hour) of Spark's watermark rule."""
    high, open_, closed, late = None, {}, {}, Counter()
    for rows in batches:
        mark = high
        for ts, user, *_ in rows:
            hour = ts.replace(minute=0, second=0)
            if mark and hour + timedelta(hours=1) <= mark - delay:
                late[hour] += 1
            else:
                open_.setdefault(hour, Counter())[user] += 1
        high = max([r[0] for r in rows] + [high or rows[0][0]])
        for hour in [h for h in open_ if h + timedelta(hours=1) <= high - delay]:
            assert hour not in closed
            closed[hour] = open_.pop(hour)
    return closed, late


def test_hours_close_once_and_late_rows_are_counted(spark, tmp_path):
    rows = some_events(900, 12, 1)
    rng = random.Random(2)
    for i in rng.sample(range(len(rows)), 120):  # some rows come much later than their time
        rows.insert(min(len(rows), i + rng.randrange(50, 500)), rows.pop(i))
    batches = [rows[i : i + 150] for i in range(0, 900, 150)]
    feed(spark, tmp_path / "in", batches)
    delay = timedelta(minutes=30)
    health.run_to_end(health.stream_srm(source(spark, tmp_path / "in"), "ts", "user_id", str(tmp_path / "out"), delay="30 minutes"))
    closed, late = by_hand(batches, delay)
    got = {r["start"]: r for r in health.emitted(spark, str(tmp_path / "out")).collect()}
    assert {h: r["n_window"] for h, r in got.items()} == {h: sum(c.values()) for h, c in closed.items()} and sum(late.values()) > 20
    found = Counter()
    for r in health.emitted(spark, str(tmp_path / "out"), "late").collect():
        found[r["start"]] += r["n_rows"]
    assert found == late
    kept = [(h, u) for h, c in closed.items() for u, k in c.items() for _ in range(k)]
    sizes = spark.createDataFrame(kept, "start timestamp, user_id string").withColumn("group_id", pure_hash("user_id", "exp_001", 1000, 2)).groupBy("start", "group_id").agg(F.count("*").alias("n"))
    for r in balance.srm_monitoring(sizes, "start", 2).collect():
        assert all(got[r["start"]][c] == (pytest.approx(r[c]) if isinstance(r[c], float) else r[c]) for c in ("total", "chi2", "p_value", "level", "action"))


def test_a_stopped_stream_goes_on_where_it_was(spark, tmp_path):
    rows = some_events(800, 10, 3)
    feed(spark, tmp_path / "in", [rows[i : i + 100] for i in range(0, 400, 100)])
    folder = str(tmp_path / "out")
    start = lambda: health.stream_srm(source(spark, tmp_path / "in"), "ts", "user_id", folder)
    health.run_to_end(start())
    feed(spark, tmp_path / "in", [rows[i : i + 100] for i in range(400, 800, 100)])
    real, calls = balance.srm_monitoring, []

    def fails(*a, **b):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return real(*a, **b)

    balance.srm_monitoring = fails
    try:
        with pytest.raises(Exception, match="lost"):
            health.run_to_end(start())
    finally:
        balance.srm_monitoring = real
    health.run_to_end(start())
    feed(spark, tmp_path / "all", [rows])
    health.run_to_end(health.stream_srm(source(spark, tmp_path / "all"), "ts", "user_id", str(tmp_path / "one")))
    want = sorted(map(tuple, health.emitted(spark, str(tmp_path / "one")).collect()))
    assert sorted(map(tuple, health.emitted(spark, folder).collect())) == want and len(want) == 9


def test_sequential_state_at_any_split(spark, tmp_path):
    rows = [(t, u, k, a, v + (4 if k == "b" and a else 0)) for t, u, k, a, v in some_events(1200, 24 * 6, 5)]
    rows += [(rows[-1][0] + timedelta(days=2), "u", "c", 1, None)]
    day = spark.createDataFrame(rows, EVENT).filter("value is not null").withColumn("start", F.date_trunc("day", "ts"))
    last = max(r[0] for r in rows if r[4] is not None)
    want = effects.sequential_trajectory(day.filter(F.col("start") + F.expr("INTERVAL 1 DAY") <= F.lit(last)), "arm", "value", "start", keys=["kind"])
    want = {(r["kind"], r["start"]): r for r in want.collect()}
    for name, size in (("all", 2000), ("some", 170), ("many", 600)):
        feed(spark, tmp_path / f"in-{name}", [rows[i : i + size] for i in range(0, len(rows), size)])
        health.run_to_end(health.stream_sequential(source(spark, tmp_path / f"in-{name}"), "ts", "arm", "value", str(tmp_path / name), ["kind"]))
        got = {(r["kind"], r["start"]): r for r in health.emitted(spark, str(tmp_path / name)).collect()}
        assert set(got) == set(want)
        for k, r in want.items():
            assert all(got[k][c] == (pytest.approx(r[c], rel=1e-6, abs=1e-7) if isinstance(r[c], float) else r[c]) for c in ("n_t", "n_c", "effect", "t_stat", "p_value", "boundary", "stop"))
        signals = [k for k, r in got.items() if r["signal"]]
        assert signals == [min(k for k, r in want.items() if r["stop"])] and signals[0][0] == "b"


def test_chan_does_not_cancel(spark):
    rows = [(p, a, 1e9 + (i % 7) + a) for p in range(3) for a in (0, 1) for i in range(500)]
    got = effects.sequential_trajectory(spark.createDataFrame(rows, "p int, arm int, y double"), "arm", "y", "p").orderBy("p").collect()
    import numpy as np

    for r in got:
        t, c = (np.array([y - 1e9 for p, a, y in rows if a == k and p <= r["p"]]) for k in (1, 0))
        assert r["t_stat"] == pytest.approx((t.mean() - c.mean()) / np.sqrt(t.var(ddof=1) / len(t) + c.var(ddof=1) / len(c)), rel=1e-6)


def test_streams_end_whole_or_raise(spark, tmp_path):
    rows = some_events(40, 2, 7)
    feed(spark, tmp_path / "in", [rows[i : i + 10] for i in range(0, 40, 10)])

    def slow(batches):
        import time

        for b in batches:
            time.sleep(0.5)
            yield b

    def broken(batches):
        raise RuntimeError("no such row")
        yield from batches

    counts = lambda f: routers.stream_hash_counts(source(spark, tmp_path / "in").select("user_id").mapInPandas(f, "user_id string"), "user_id")
    assert routers.run_to_table(counts(slow), "complete").agg(F.sum("n")).first()[0] == 40
    with pytest.raises(Exception, match="no such row"):
        routers.run_to_table(counts(broken), "complete")
