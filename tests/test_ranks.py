import numpy as np
import pytest
from cohortlab.operators import effects, frames, routing
from pyspark.sql import functions as F

N = 2_000_000


@pytest.fixture(scope="module")
def big(spark):
    """Two million rows with a payload that the ranks don't need."""
    d = spark.range(N, numPartitions=8).select(F.pmod(F.xxhash64("id"), F.lit(1 << 40)).alias("o"), "id", F.sha2(F.col("id").cast("string"), 256).alias("pay"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(2))).cast("int").alias("arm"))
    return d.withColumn("y", F.round(F.pmod(F.xxhash64("id", F.lit(2)), F.lit(10_000)) / 7, 3))


def test_ranks_are_gap_free_with_a_payload(big):
    r = frames.with_rank(big, ["o", "id"], parts=8)
    got = r.agg(F.count("*"), F.countDistinct("k"), F.min("k"), F.max("k"), F.count("pay")).first()
    assert tuple(got) == (N, N, 0, N - 1, N)
    pdf = r.select("k", "o", "id").toPandas().sort_values("k")
    order = np.lexsort((pdf["id"], pdf["o"]))
    assert (order == np.arange(N)).all()


def test_ranks_within_a_hot_key(big):
    d = big.withColumn("g", F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.concat(F.lit("g"), F.col("id") % 50)))
    got = frames.with_rank(d, ["o", "id"], parts=8, keys=["g"]).groupBy("g").agg(F.count("*").alias("n"), F.countDistinct("k").alias("d"), F.max("k").alias("m")).collect()
    assert all(r["n"] == r["d"] == r["m"] + 1 for r in got) and sum(r["n"] for r in got) == N


def test_rank_test_and_stability_on_large_input(big):
    pdf = big.select("o", "id", "arm", "y").toPandas()
    values, inv, n = np.unique(pdf["y"], return_inverse=True, return_counts=True)
    rank = (np.cumsum(n) - n + (n + 1) / 2)[inv]
    nt, nc = float((pdf["arm"] == 1).sum()), float((pdf["arm"] == 0).sum())
    u = rank[pdf["arm"] == 1].sum() - nt * (nt + 1) / 2
    sd = np.sqrt(nt * nc / 12 * (N + 1 - (n.astype(float) ** 3 - n).sum() / (N * (N - 1.0))))
    got = effects.mann_whitney(big, "arm", "y").first()
    assert got["u_stat"] == u and got["z"] == pytest.approx((max(u, nt * nc - u) - nt * nc / 2 - 0.5) / sd, abs=1e-9)
    pdf = pdf.sort_values(["o", "id"])
    means = [(s := pdf.loc[pdf["arm"] == a, "y"].to_numpy()).cumsum() / np.arange(1, len(s) + 1) for a in (1, 0)]
    m = min(map(len, means))
    e = means[0][:m] - means[1][:m]
    got = effects.stability(big, "arm", "y", ["o", "id"]).first()
    chunks = e[: m // 10 * 10].reshape(10, -1).mean(axis=1)
    assert got["n"] == m and (got["early"], got["late"], got["chunk_std"]) == pytest.approx((e[: m // 3].mean(), e[-(m // 3) :].mean(), chunks.std()), abs=1e-9)


def test_percentiles_are_exact(big):
    pdf = big.select("arm", "y").toPandas()
    for r in frames.percentiles(big, "y", {"a": 0.0, "b": 0.05, "c": 1 / 3, "d": 0.999, "e": 1.0}, ["arm"]).collect():
        assert list(r)[1:] == pytest.approx(np.quantile(pdf.loc[pdf["arm"] == r["arm"], "y"], [0.0, 0.05, 1 / 3, 0.999, 1.0]))
    assert frames.percentiles(big.limit(0), "y", {"a": 0.5}).first()["a"] is None


def test_strata_are_dealt_in_turn(big):
    got = routing.stratified_assign(big.select(F.col("id").cast("string").alias("user_id"), F.when(F.col("id") % 3 > 0, "hot").otherwise("cold").alias("stratum")), 10).groupBy("stratum", "group_id").count().collect()
    sizes = {s: [r["count"] for r in got if r["stratum"] == s] for s in ("hot", "cold")}
    assert all(len(x) == 10 and max(x) - min(x) <= 1 for x in sizes.values())
