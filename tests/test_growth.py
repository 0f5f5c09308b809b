"""What only shows on larger tables: joins left to Spark's guess of sizes, and limits that larger tables pass."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from cohortlab.functions.murmur import Prefixed, murmur32, uniform
from cohortlab.operators import effects, frames, ordered, simulate
from cohortlab.plans import registry
from pyspark.sql import functions as F

D = "/root/testdata/sf0.001"


def guessed(df, column=""):
    """The joins of rows with this column for which Spark chooses by its guess of sizes."""
    plan = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    return [x for x in plan if " Join " in f" {x.lstrip(' :+-')}" and column in x and "Hint" not in x]


def times(n, tables, folder):
    """Copies of sf0.001 with shifted keys: n times the rows."""
    shifted = {"customer": ["c_custkey"], "events": ["event_id", "user_id"]}
    for t in tables:
        cols = ", ".join(f"{c} + i * 1000000 AS {c}" for c in shifted[t])
        duckdb.sql(f"COPY (SELECT t.* REPLACE ({cols}) FROM '{D}/{t}.parquet' t, (SELECT unnest(range({n})) AS i) x) TO '{folder}/{t}.parquet'")
    return str(folder)


def against_sql(spark, name, folder, tables, sql=None):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    a, b = registry.QUERIES[name](spark, folder).toPandas(), con.execute(sql or registry.ORACLES[name]).df()
    rows = lambda d: sorted(map(tuple, d[sorted(d.columns)].astype(str).values.tolist()))
    assert rows(a) == rows(b)
    return len(a)


def test_running_sums_never_send_the_rows_to_the_driver(spark):
    """A million rows made from ten: Spark takes them for 160 bytes and would broadcast them."""
    rows = spark.range(10).select("id", F.explode(F.sequence(F.lit(1), F.lit(100_000))).alias("v"))
    ranked = frames.with_rank(rows, ["v"], keys=["id"])
    assert not guessed(ranked)
    assert tuple(ranked.agg(F.count("*"), F.sum((F.col("k") == F.col("v") - 1).cast("int"))).first()) == (1_000_000, 1_000_000)
    assert not guessed(frames.percentiles(rows, "v", {"m": 0.5}, ["id"]))


def test_outlier_study_broadcasts_bounds_only(spark):
    assert not guessed(effects.outlier_study(registry.metrics(spark, D), "arm", "post", "user_id", trials=2), "trial")


def test_full_evaluation_broadcasts_the_deal_only(spark):
    out = simulate.full_evaluation(registry.users(spark, D, "c_custkey", F.col("c_acctbal").cast("double").alias("c_acctbal")), ["c_acctbal"], 2, order=["c_custkey"])
    assert not [x for c in ("bucket#", "user_id#") for x in guessed(out, c) if "Join Inner" in x]


def test_stratified_vs_overall_has_room_for_every_user(spark, tmp_path):
    """At 60,000 customers a pool of 50,000 slots ran out."""
    assert against_sql(spark, "bm17_stratified_vs_overall", times(400, ["customer"], tmp_path), ["customer"]) == 2


def test_trials_make_no_row_a_user_and_trial(spark):
    """Moments by trial against the rows of users and trials, for ids of several lengths."""
    rng = np.random.default_rng(4)
    ids = [f"{'é' * (i % 5)}u{i}" for i in range(300)]
    users = spark.createDataFrame(pd.DataFrame({"user_id": ids, "pre": rng.normal(1000, 3, 300), "post": rng.normal(990, 5, 300)}))
    got = {r["trial"]: r for r in simulate.aa_trials(users, "post", 120).collect()}
    t = users.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(119)))).withColumn("arm", (uniform(F.lit("aa"), "trial", "user_id") < 0.5).cast("int"))
    for r in effects.continuous_test(t, "arm", "post", keys=["trial"]).collect():
        assert list(got[r["trial"]])[1:] == pytest.approx([r["diff"], r["ci_low"], r["ci_high"], r["p_value"]], rel=1e-9, abs=1e-9)
    t = t.withColumn("arm", (uniform(F.lit("arm"), "trial", "user_id") < 0.5).cast("int"))
    for how, y in ((True, F.col("post") * 1.05), (False, F.col("post") + 0.05)):
        want = effects.pre_post(t.withColumn("y", F.when(F.col("arm") == 1, y).otherwise(F.col("post"))), "arm", "pre", "y", ["trial"]).groupBy("method").agg(F.avg((F.col("p_value") < 0.05).cast("int")), F.avg("effect"), F.avg("var_reduction")).collect()
        got = {r["method"]: list(r)[2:] for r in simulate.power_study(users, "pre", "post", 120, 0.05, multiplicative=how).collect()}
        assert len(want) == 4 and all(got[r[0]] == pytest.approx(list(r)[1:], rel=1e-9, abs=1e-9) for r in want)
    assert "Generate" not in simulate.aa_trials(users, "post", 120)._jdf.queryExecution().optimizedPlan().toString()


def test_hashes_under_prefixes():
    keys = ["", "a", "ab", "abc", "abcd", "user_12345", "é", "x" * 33]
    for p in ("", "a", "aa_", "aa_1", "aa_10_", "arm_199_"):
        assert Prefixed(keys).hashes(p.encode()).tolist() == murmur32([p + k for k in keys]).tolist()


def test_adaptive_router_broadcasts_no_table_of_windows(spark):
    out = ordered.adaptive_route(registry.arrivals(spark, D), ["ts", "event_id"])
    assert not guessed(out, "_b#") and not guessed(ordered.calibrated_route(registry.arrivals(spark, D), ["ts", "event_id"]), "k#")


@pytest.mark.parametrize("noise", [0.1, 0.0])
def test_outlier_study_makes_no_row_a_user_and_trial(spark, noise):
    """Against the rows of users and trials: long tails, many equal values, and bounds that first miss the points."""
    rng = np.random.default_rng(7)
    y = np.where(rng.random(900) < 0.4, 0.0, np.exp(rng.normal(3, 2, 900)))
    users = spark.createDataFrame(pd.DataFrame({"user_id": [f"u{i}" for i in range(900)], "arm": np.arange(900) % 2, "post": y}))
    plan = effects.outlier_study(users, "arm", "post", "user_id", 5, noise=noise)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan
    rows = users.select(F.col("user_id").alias("u"), F.col("arm").cast("int").alias("a"), F.col("post").alias("y"))
    points, sd = [0.01, 0.05, 0.95, 0.99], noise * float(y.std())
    for spare in (0.001, -0.051):
        got = simulate.noisy_points(rows, "outlier", 5, {0: sd, 1: sd}, {0: 450, 1: 450}, points, spare)
        t = rows.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn("raw", F.col("y") + sd * simulate.normal(F.lit("outlier"), "trial", "u")).toPandas()
        assert len(got) == 10
        for (k, a), own in t.groupby(["trial", "a"]):
            assert got[k, a] == pytest.approx(np.percentile(own["raw"], [100 * p for p in points]), rel=1e-9, abs=1e-9)
