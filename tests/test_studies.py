import random

import numpy as np
import pytest
from cohortlab.functions.murmur import murmur32
from cohortlab.operators import balance, effects, monitoring, routing, simulate
from cohortlab.plans import registry, studies
from cohortlab.sources import io
from cohortlab.streaming import routers
from pyspark.sql import functions as F

D = "/root/testdata/sf0.001"
ARRIVAL = "arrival_seq long, user_id string"


def rows_of(q, key):
    return {r[key]: r for r in q.collect()}


@pytest.mark.parametrize("capacity", [20, 60, 400])
def test_growing_pool_is_the_event_loop(spark, capacity):
    rng = random.Random(capacity)
    stream = [f"user_{rng.randrange(500)}" for _ in range(1200)]
    want = dict(zip(stream, simulate.fold_growing_pool(stream, "exp_001", capacity=capacity)))
    got = {r["user_id"]: r["group_id"] for r in routing.growing_pool(spark.createDataFrame(list(enumerate(stream)), ARRIVAL), capacity).collect()}
    assert got == want


def test_layered_router_is_the_event_loop(spark):
    rng = random.Random(3)
    stream = [f"user_{rng.randrange(300)}" for _ in range(900)]
    want = simulate.fold_layered(stream, "exp_001", buckets=100)
    out = routing.layered_route(spark.createDataFrame(list(enumerate(stream)), ARRIVAL), ["arrival_seq"], buckets=100)
    got = [(r["group_id"], r["layer"]) for r in out.orderBy("arrival_seq").collect()]
    assert got == want and {x for _, x in want} == {"L1_cache", "L1_prebucket", "L2_realtime"}
    hits = sum(x != "L2_realtime" for _, x in want)
    assert routing.cache_hit_rate(out).first()["hit_rate_pct"] == pytest.approx(100 * hits / len(want))
    assert routing.layered_route(spark.createDataFrame([], ARRIVAL), ["arrival_seq"]).count() == 0


def test_strata_beyond_their_capacity(spark):
    u = spark.range(100).select(F.concat(F.lit("u"), "id").alias("user_id"), F.when(F.col("id") < 80, "a").otherwise("b").alias("stratum"))
    n = {(r["stratum"], r["group_id"]): r["count"] for r in routing.stratified_assign(u, 10, 50).groupBy("stratum", "group_id").count().collect()}
    assert n["a", -1] == 39 and n["a", 0] == 5 and n["a", 9] == 4 and n["b", 9] == 2 and ("b", -1) not in n  # it ends when the first group has its share


def test_sticky_router_is_the_event_loop(spark):
    t = simulate.trial_users(spark, 3, 400, 150)
    got = {(r["trial"], r["i"]): r["group_id"] for r in simulate.route_trials(t, studies.sticky).collect()}
    for trial in range(3):
        own = [(r["i"], r["user_id"]) for r in t.filter(F.col("trial") == trial).orderBy("i").collect()]
        count, known = [0] * 10, {}
        for i, u in own:
            if u not in known:
                base = int(murmur32([f"{u}_exp_{trial}"])[0]) % 1000 % 10
                known[u] = count.index(min(count)) if murmur32([f"exp_{trial}_{i}_{u}"])[0] / 2**32 < 0.7 else base
                count[known[u]] += 1
            assert got[trial, i] == known[u]


def test_streaming_pool_over_batches(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, f"user_{rng.randrange(120)}") for i in range(400)]
    for b in range(4):
        spark.createDataFrame(rows[b * 100 : b * 100 + 100], ARRIVAL).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    slots = [3] * 5 + [40] * 5
    stream = spark.readStream.schema(ARRIVAL).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = routers.stream_slot_pool(stream, "user_id", "arrival_seq", slots, str(tmp_path / "out")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out" / "users")).collect()
    users = {u for _, u in rows}
    assert {r["user_id"] for r in got} == users and len(got) == len(users) and sorted(r["k"] for r in got) == list(range(len(users)))
    # the first group without a slot when its turn comes ends the pool
    assert all(r["group_id"] == (r["k"] % 10 if r["k"] < 30 else -1) for r in got)


def test_published_deviations(spark):
    grid = {(r["strategy"], r["users"]): r for r in studies.mc11(spark, D).collect()}
    assert [round(grid[s, 5000]["mean"], 2) for s in ("snake", "hash", "double_hash", "two_stage", "vote")] == [0.51, 8.05, 7.82, 7.91, 7.98]
    assert 0.3 <= grid["snake", 10_000]["mean"] <= 0.34 and 0.18 <= grid["calibrated", 5000]["mean"] <= 0.22
    pools = rows_of(studies.mc09(spark, D), "router")
    assert [pools[n][c] for n in ("slot_pool", "growing_pool") for c in ("mean", "pass_rate")] == [0, 1, 0, 1]
    adaptive = simulate.summarize(balance.deviation_pct(studies.rt21(spark, D), ["trial"])).first()
    assert (round(adaptive["mean"], 2), round(adaptive["p95"], 2)) == (5.99, 8.51)


def test_published_orthogonality(spark):
    m = rows_of(studies.mc10(spark, D), "measure")
    assert m["p_value"]["pass_rate"] == 1 and round(m["p_value"]["median"], 2) == 0.48 and round(m["combination_balance"]["mean"], 2) == 0.89
    assert [round(m[f"dev_pct {n}"]["mean"], 2) for n in ("rec", "sch", "ui")] == [1.24, 0.89, 1.35]


def test_bandit_regret_is_summed_by_step(spark):
    t = studies.wn09(spark, D)
    last = rows_of(t.filter("step = 5000"), "algorithm")
    assert last["fixed"]["regret"] == pytest.approx(40.0) and len(last) == 4
    fixed = [r["regret"] for r in t.filter("algorithm = 'fixed'").orderBy("step").limit(10).collect()]
    assert fixed == pytest.approx([0.04] * 5 + [0.08] * 5)
    for name in ("epsilon", "ucb1", "thompson"):
        reward, regret, _ = simulate.bandit(name, [0.10, 0.14, 0.14, 0.14, 0.14], 5000, 42)
        assert (last[name]["reward"], last[name]["regret"]) == pytest.approx((reward, regret))


def test_credible_intervals_against_draws(spark):
    got = effects.beta_binomial(spark.createDataFrame([(1500, 180, 1500, 145), (20, 0, 30, 30)], "n_t int, x_t int, n_c int, x_c int")).collect()
    rng = np.random.default_rng(1)
    for r in got:
        t, c = (rng.beta(1 + r[f"x_{s}"], 1 + r[f"n_{s}"] - r[f"x_{s}"], 400_000) for s in "tc")
        assert [r["low_t"], r["high_t"]] == pytest.approx(np.percentile(t, [2.5, 97.5]), abs=2e-3)
        assert [r["low_c"], r["high_c"]] == pytest.approx(np.percentile(c, [2.5, 97.5]), abs=2e-3)
        assert [r["lift_low"], r["lift_high"]] == pytest.approx(np.percentile(t - c, [2.5, 97.5]), abs=3e-3)
        assert r["prob_better"] == pytest.approx((t > c).mean(), abs=3e-3)


def test_bayes_against_z(spark):
    got = rows_of(studies.st26(spark, D), "effect")
    assert sorted(got) == [0.0, 0.005, 0.01, 0.02] and got[0.0]["z_power"] in (0, 1)
    assert got[0.005]["z_power"] <= got[0.01]["z_power"] <= got[0.02]["z_power"] and all(r["bayes_power"] >= r["z_power"] for r in got.values())


def test_outlier_study_by_brute_force(spark):
    m = registry.metrics(spark, D).select("user_id", "arm", "post").limit(60).cache()
    got = rows_of(effects.outlier_study(m, "arm", "post", "user_id", trials=3), "method")
    pdf = m.toPandas()
    y = np.where(pdf["arm"] == 1, pdf["post"] * 1.05, pdf["post"])
    sd = [y[pdf["arm"] == a].std() for a in (0, 1)]
    diffs = {k: [] for k in got}
    uniform = lambda tag, t: murmur32([f"{tag}_outlier_{t}_{u}" for u in pdf["user_id"]]) / 2**32
    for t in range(3):
        z = np.sqrt(-2 * np.log(np.maximum(uniform("n1", t), 1e-12))) * np.cos(2 * np.pi * uniform("n2", t))
        raw = y + 0.1 * np.array(sd)[pdf["arm"]] * z
        for name, cut in {"raw": None, "winsorize_5": (5, 95), "winsorize_1": (1, 99), "cap_99": (0, 99), "log": None}.items():
            means = []
            for a in (1, 0):
                x = raw[pdf["arm"] == a]
                x = np.log1p(x) if name == "log" else np.clip(x, *np.percentile(x, cut)) if cut else x
                means.append(x.mean())
            diffs[name].append(means[0] - means[1])
    for k, v in diffs.items():
        assert (got[k]["mean_effect"], got[k]["std_effect"]) == pytest.approx((np.mean(v), np.std(v)), rel=1e-9)


def test_type1_and_power(spark):
    r = rows_of(studies.rp05(spark, D), "method")
    assert set(r) == {"plain", "did", "cuped", "did_cuped"} and all(0 <= x["type1"] <= 0.15 and 0 <= x["valid_var_reduction"] <= 1 for x in r.values())


def test_seasonal_marks_that_add_up(spark):
    r = rows_of(studies.dm01(spark, D), "method")
    assert r["seasonal"]["n_covariates"] == 2 and r["seasonal"]["var_reduction"] > r["cuped"]["var_reduction"] > 0


def test_full_evaluation(spark):
    r = rows_of(studies.mc12(spark, D), "strategy")
    assert r["slot_pool"]["max_dev_pct"] == 0 and r["snake"]["max_dev_pct"] < r["hash"]["max_dev_pct"]


def test_calibration_trials(spark):
    r = rows_of(studies.mc08(spark, D), "strategy")
    assert round(r["hash"]["mean"], 2) == 8.05 and r["share"]["mean"] < 0.5 < r["calibrated"]["mean"] < r["hash"]["mean"] and all(x["trials"] == 100 for x in r.values())


def test_layer_scan(spark):
    r = rows_of(studies.mc05(spark, D), "layers")
    assert sorted(r) == [1, 2, 3, 5, 8, 10] and all(x["trials"] == 50 and 5 < x["mean"] < 12 for x in r.values())


def test_monitoring_with_an_expected_size(spark):
    sizes = spark.createDataFrame([("d1", 0, 100), ("d1", 1, 100), ("d2", 0, 400)], "day string, group_id int, n long")
    r = rows_of(balance.srm_monitoring(sizes, "day", 2, 100.0), "day")
    assert r["d1"]["chi2"] == 0 and r["d1"]["level"] == "normal" and r["d2"]["max_n"] == 500 and r["d2"]["chi2"] == 1600 and r["d2"]["max_group_diff_pct"] == 400
    assert r["d2"]["action"] == balance.ACTIONS["critical"]


def test_reports(spark):
    lines = [r["text"] for r in studies.rp02(spark, D).orderBy("line").collect()]
    assert {"## Experiment", "## Sample ratio", "## Secondary metrics", "## Smallest detectable effect", "## Status", "## Advice"} <= set(lines)
    assert monitoring.advice_for(False, True, 1, 1, None).startswith("stop at once") and monitoring.advice_for(True, False, 0.6, 0, 1.0).startswith("extend") and monitoring.advice_for(True, False, 0.4, 0, 1.0).startswith("stop:")
    assert monitoring.advice_for(True, True, 1, 0.9, None).startswith("ship") and monitoring.advice_for(True, True, -1, 0.9, None).startswith("harmful")


def test_ramp_series_is_binomial(spark):
    r = io.ramp_series(spark, days=10, traffic=1000).orderBy("day").collect()
    assert [x["novelty"] for x in r] == pytest.approx([0.005 * max(0, 7 - d) for d in range(10)])
    assert all((x["control_conversion"] * 1000) % 1 < 1e-9 or (x["control_conversion"] * 1000) % 1 > 1 - 1e-9 for x in r) and len({x["control_conversion"] for x in r}) > 3


def test_hand_made_funnel(spark):
    """A step counts only after the one before it."""
    e = spark.createDataFrame([(1, 10, 1, "view"), (1, 11, 2, "click"), (1, 9, 3, "signup"), (2, 5, 4, "click"), (2, 6, 5, "view"), (3, 1, 6, "click")], "user_id long, t int, event_id long, event_type string").withColumn("ts", F.timestamp_seconds("t"))
    read, registry.read = registry.read, lambda *_: e
    try:
        got = {r["user_id"]: (r["view"], r["click"], r["signup"]) for r in registry.funnel_users(spark, D).collect()}
    finally:
        registry.read = read
    assert got == {1: (1, 1, 0), 2: (1, 0, 0), 3: (0, 0, 0)}
