import math
import random

import numpy as np
import pytest
from cohortlab.functions import special
from cohortlab.functions.murmur import murmur32
from cohortlab.operators import balance, effects, monitoring, routing, simulate
from cohortlab.sources import io
from cohortlab.streaming import routers
from pyspark.sql import functions as F


def ids(spark, n, pattern="u_%04d"):
    return routing.virtual_ids(spark, n, pattern)


def test_hash_vectors():
    assert murmur32(["", "hello", "foo"]).tolist() == [0, 613153351, 4138058784]


def test_tails_against_tables():
    assert special.t_sf2(2.228, 10) == pytest.approx(0.05, abs=1e-4)
    assert special.chi2_sf(16.919, 9) == pytest.approx(0.05, abs=1e-5)
    assert special.f_sf(3.0, 3, 20) == pytest.approx(0.0550, abs=2e-4)
    assert special.norm_sf2(1.959963985) == pytest.approx(0.05, abs=1e-8)
    assert special.chi2_sf(0, 3) == 1 and special.f_sf(0, 3, 9) == 1


def test_balanced_groups(spark):
    sizes = routing.group_sizes(routing.assign_groups(ids(spark, 1000), "user_id", 100, 10, "test"), 10)
    assert [r["n"] for r in sizes.orderBy("group_id").collect()] == [105, 101, 100, 100, 100, 100, 100, 99, 98, 97]
    a, b = (routing.assign_groups(ids(spark, 500), "user_id", 100, 10, "s").orderBy("user_id").collect() for _ in "ab")
    assert a == b


def test_sample_ratio(spark):
    def srm(ns):
        return balance.srm(spark.createDataFrame(list(enumerate(ns)), "group_id int, n long")).first()

    assert srm([100] * 4)["chi2"] == 0 and srm([100] * 4)["p_value"] == 1 and srm([100] * 4)["passed"]
    r = srm([50, 150, 100, 100])
    assert r["chi2"] == 50 and r["df"] == 3 and r["verdict"] == "FAIL" and not r["passed"]
    assert srm([0, 0])["chi2"] == 0


def test_published_deviation_of_the_snake(spark):
    s = simulate.summarize(simulate.trial_deviation(simulate.pcg_users(spark, 100, 5000), "snake")).first()
    assert round(s["mean"], 2) == 0.51 and round(s["pass_rate"], 2) == 0.96


def test_published_deviation_of_the_hash(spark):
    s = simulate.summarize(simulate.trial_deviation(simulate.pcg_users(spark, 100, 5000), "hash")).first()
    assert (round(s["mean"], 2), round(s["p95"], 2)) == (8.05, 12.60)


@pytest.mark.parametrize("capacity", [50, 300])
def test_slot_pool_is_the_event_loop(spark, capacity):
    rng = random.Random(capacity)
    stream = [f"user_{rng.randrange(400)}" for _ in range(900)]
    got = {r["user_id"]: r["group_id"] for r in routing.slot_pool(spark.createDataFrame(list(enumerate(stream)), "arrival_seq long, user_id string"), capacity).collect()}
    slots = [r["slots"] for r in routing.slot_counts(spark, capacity, 10).orderBy("group_id").collect()]
    count, want = [0] * 10, {}
    for u in stream:
        if u not in want:
            want[u] = routers.slot_rule(count, slots)
            if want[u] >= 0:
                count[want[u]] += 1
    assert got == want


def test_streaming_counts_equal_batch(spark, tmp_path):
    rng = random.Random(5)
    src = spark.createDataFrame([(i, f"user_{rng.randrange(60)}") for i in range(300)], "arrival_seq long, user_id string")
    src.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    want = {r["group_id"]: r["count"] for r in src.withColumn("group_id", routing.pure_hash("user_id")).groupBy("group_id").count().collect()}
    assert {r["group_id"]: r["n"] for r in routers.run_to_table(routers.stream_hash_counts(stream, "user_id"), "complete").collect()} == want


def test_kaplan_meier_by_hand(spark):
    rows = [(1, 1), (2, 0), (2, 1), (3, 1), (5, 0)]
    got = {r["day"]: r["survival"] for r in effects.kaplan_meier(spark.createDataFrame(rows, "days int, observed int"), "days", "observed", max_day=5).collect()}
    want = {1: 0.8, 2: 0.6, 3: 0.3, 4: 0.3, 5: 0.3}
    assert got == pytest.approx(want)


def test_one_pass_cuped_equals_two_passes(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(10, 3, 400)
    y = 2 * x + rng.normal(0, 2, 400)
    a = rng.integers(0, 2, 400)
    y = y + a
    got = {r["method"]: r for r in effects.pre_post(spark.createDataFrame([(int(i), float(p), float(q)) for i, p, q in zip(a, x, y)], "a int, x double, y double"), "a", "x", "y").collect()}
    theta = np.cov(y, x)[0, 1] / x.var(ddof=1)
    z = y - theta * (x - x.mean())
    t, c = z[a == 1], z[a == 0]
    assert got["cuped"]["effect"] == pytest.approx(t.mean() - c.mean())
    assert got["cuped"]["t_stat"] == pytest.approx((t.mean() - c.mean()) / math.sqrt(t.var(ddof=1) / len(t) + c.var(ddof=1) / len(c)))
    assert got["cuped"]["var_reduction"] == pytest.approx(1 - z.var() / y.var())
    multi = effects.multi_cuped(spark.createDataFrame([(int(i), float(p), float(p) * 3, float(q)) for i, p, q in zip(a, x, y)], "a int, x double, x3 double, y double"), "a", "y", ["x", "x3"]).first()
    assert multi["n_covariates"] == 1 and multi["effect"] == pytest.approx(got["cuped"]["effect"])


def test_mann_whitney_by_hand(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 2.0), (0, 2.0), (0, 5.0), (0, 6.0)], "a int, y double")
    r = effects.mann_whitney(df, "a", "y").first()
    assert r["u_stat"] == 1.0 and 0 < r["p_value"] < 0.2


def test_money_and_dates(spark):
    df = spark.createDataFrame([("c", "$-1,234.50", "2024-01-02"), ("c", "?", "2024-01-02"), ("c", "$1", "no")], "client_id string, amount string, date string")
    assert [r["amount"] for r in io.clean_transactions(df).collect()] == [1234.5]


def test_csv_round_trip(spark, tmp_path):
    io.write_csv(io.synthetic_users(spark, 20), str(tmp_path / "u"))
    assert io.load_users(spark, str(tmp_path / "u")).filter("yearly_income > 0").count() == 20


def test_decisions(spark):
    cols = "n_users_per_arm int, decision_criticality string, duration string, population_stability string, explainability string, rollback string"
    r = monitoring.choose_method(spark.createDataFrame([(500, "high", "short", "stable", "high", "no")], cols)).first()
    assert (r["ab_score"], r["mab_score"], r["recommendation"]) == (57, 14, "strong_ab")
    with pytest.raises(Exception, match="unknown duration"):
        monitoring.choose_method(spark.createDataFrame([(500, "high", "never", "stable", "high", "no")], cols)).collect()


def test_bandit_replay():
    reward, regret, pulls = simulate.bandit("fixed", [0.10, 0.14, 0.14, 0.14, 0.14], 5000, 1)
    assert regret == pytest.approx(40.0) and pulls == [1000] * 5 and 550 < reward < 770


def test_no_rows(spark):
    none = spark.createDataFrame([], "user_id string, arm int, y double, k long")
    assert routing.assign_groups(none).count() == 0
    assert effects.continuous_test(none, "arm", "y").first()["p_value"] is None
    assert effects.stability(none, "arm", "y", ["k"]).count() == 0
    assert balance.deviation_pct(routing.group_sizes(none.withColumn("group_id", F.lit(0)), 3)).first()["max_dev_pct"] is None


def test_studies_have_all_their_trials(spark):
    from cohortlab.plans import registry

    d = "/root/testdata/sf0.001"
    assert registry.QUERIES["st10_aa"](spark, d).first()["trials"] == 1000
    assert {r["trials"] for r in registry.QUERIES["mc13_power"](spark, d).collect()} == {200}
