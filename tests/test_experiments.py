"""Operators over many experiments and many columns, against brute force."""

import itertools
from math import erf, exp, lgamma, log

import numpy as np
import pandas as pd
import pytest
from cohortlab.operators import distributions, gram, posterior, reports
from cohortlab.operators.frames import cut
from pyspark.sql import functions as F


def closed_sum(a, b, c, d):
    """P(X > Y), X ~ Beta(a, b), Y ~ Beta(c, d), as the textbook's sum over a."""
    lb = lambda x, y: lgamma(x) + lgamma(y) - lgamma(x + y)
    return sum(exp(lb(c + i, d + b) - log(b + i) - lb(1 + i, b) - lb(c, d)) for i in range(int(a)))


def test_prob_better_is_the_closed_sum():
    rng = np.random.default_rng(1)
    cases = [(1, 1, 1, 1), (1, 5, 7, 1), (181, 1321, 146, 1356), (1, 100_000, 2, 3), (500, 2, 1, 900), (9_000, 1_000, 8_950, 1_040), (3, 2, 2_000, 1_000)]
    cases += [tuple(int(x) for x in rng.integers(1, 300, 4)) for _ in range(100)]
    got = posterior.prob_better(*np.array(cases, float).T)
    assert np.allclose(got, [closed_sum(*map(float, c)) for c in cases], atol=1e-8)


def test_prob_better_of_large_counts_is_normal_and_symmetric(monkeypatch):
    a = np.array([[5.0002e9, 5e9, 5e9, 5e9], [1e9 + 1, 9e9, 1e9, 9e9]]).T
    p, q = posterior.prob_better(*a), posterior.prob_better(a[2], a[3], a[0], a[1])
    assert np.allclose(p + q, 1, atol=1e-9)
    mean, var = lambda x, y: x / (x + y), lambda x, y: x * y / (x + y) ** 3
    z = (mean(a[0], a[1]) - mean(a[2], a[3])) / np.sqrt(var(a[0], a[1]) + var(a[2], a[3]))
    assert np.allclose(p, [0.5 * (1 + erf(v / 2**0.5)) for v in z], atol=1e-5)
    whole = posterior.prob_better(*a)
    monkeypatch.setattr(posterior, "TERMS", 10)
    assert np.array_equal(whole, posterior.prob_better(*a))


def test_posteriors_of_nulls_empty_arms_and_the_losses(spark):
    rows = [("a", 10, 3, 12, 4), ("none", 0, 0, 0, 0), ("null", None, 1, 5, 2), ("odd", 3, 5, 5, 2), ("same", 7, 7, 7, 7)]
    out = posterior.posteriors(spark.createDataFrame(rows, "e string, n_t long, x_t long, n_c long, x_c long")).toPandas().set_index("e")
    assert out.loc["none", "prob_better"] == pytest.approx(0.5) and out.loc["same", "prob_better"] == pytest.approx(0.5)
    assert out.loc[["null", "odd"], "prob_better"].isna().all() and out.loc[["null", "odd"], "reading"].isna().all()
    rng = np.random.default_rng(3)
    t, c = rng.beta(4, 8, 400_000), rng.beta(5, 9, 400_000)
    assert out.loc["a", "loss_c"] == pytest.approx(np.maximum(t - c, 0).mean(), abs=1e-3)
    assert out.loc["a", "loss_t"] == pytest.approx(np.maximum(c - t, 0).mean(), abs=1e-3)
    none = spark.createDataFrame([], "e string, n_t long, x_t long, n_c long, x_c long")
    assert posterior.posteriors(none).count() == 0


def test_conversions_count_each_user_once(spark):
    rows = [("x", 1, 1, True), ("x", 1, 1, False), ("x", 2, 0, None), ("x", 3, 2, True), ("x", None, 1, True), (None, 4, 0, True)]
    e = spark.createDataFrame(rows, "k string, u long, arm int, hit boolean")
    out = {r["k"]: tuple(r)[1:] for r in posterior.conversions(e, ["k"], "u", "arm", F.col("hit")).collect()}
    assert out == {"x": (1, 1, 1, 0), None: (0, 0, 1, 1)}


@pytest.mark.parametrize("n, m", [(3, 4), (5, 5), (2, 6), (1, 3)])
def test_exact_tail_counts_all_orders(n, m):
    far = []
    for own in itertools.combinations(range(n + m), n):
        i = np.cumsum(np.isin(np.arange(n + m), own))
        far.append(np.abs(i * m - (np.arange(1, n + m + 1) - i) * n).max())
    for h in range(1, n * m + 1):
        assert distributions.two_sample_tail(h, n, m) == pytest.approx(np.mean(np.array(far) >= h))


def test_exact_tail_meets_the_limit():
    assert distributions.two_sample_tail(2000, 100, 100) == pytest.approx(distributions.two_sample_tail(2000, 100, 100, exact=0), abs=0.01)


def test_ks_distance_by_key_with_ties_nulls_and_one_arm(spark):
    rng = np.random.default_rng(2)
    rows = [(str(k), int(rng.integers(0, 3)), float(rng.integers(0, 9))) for k in "abc" for _ in range(120)]
    rows += [("a", 1, None), ("b", 0, float("nan")), ("one", 1, 2.0), (None, 1, -0.0), (None, 0, 0.0)]
    out = {r["k"]: r for r in distributions.ks_two_sample(spark.createDataFrame(rows, "k string, arm int, v double"), "arm", "v", ["k"]).collect()}
    for k in "abc":
        t, c = (np.array([v for kk, a, v in rows if kk == k and a == code and v is not None and v == v]) for code in (1, 0))
        at = np.unique(np.concatenate([t, c]))
        d = np.abs((t[:, None] <= at).mean(axis=0) - (c[:, None] <= at).mean(axis=0))
        assert (out[k]["n_t"], out[k]["n_c"]) == (len(t), len(c))
        assert out[k]["d"] == pytest.approx(d.max()) and out[k]["at_value"] == at[np.isclose(d, d.max())].min()
    assert out["one"]["d"] is None and out["one"]["p_value"] is None
    assert out[None]["d"] == 0 and out[None]["p_value"] == 1
    none = distributions.ks_two_sample(spark.createDataFrame([], "arm int, v double"), "arm", "v").collect()
    assert [tuple(r) for r in none] == [(None,) * 5]


def test_ks_uniform_is_the_sorted_form(spark):
    p = np.random.default_rng(5).random(300).round(2)
    out = distributions.ks_uniform(spark.createDataFrame([(float(x),) for x in p], "p double"), "p").first()
    s, n = np.sort(p), len(p)
    assert out["n"] == n and out["d"] == pytest.approx(max((np.arange(1, n + 1) / n - s).max(), (s - np.arange(n) / n).max()))


def wide(spark, n=3000, parts=7):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(n, 6)) + np.array([0, 1e6, 3, 0, 0, 0])
    x[:, 4], x[:, 5] = x[:, 0] - 2 * x[:, 2], 5.0
    key, arm = rng.choice(["p", "q", ""], n), rng.integers(0, 2, n)
    y = x[:, 0] + 0.3 * arm + x[:, 3] + rng.normal(size=n)
    pdf = pd.DataFrame(x, columns=list("abcdef")).assign(key=np.where(key == "", None, key), arm=arm, y=y)
    pdf.loc[::50, "d"] = None
    return pdf, spark.createDataFrame(pdf, "a double, b double, c double, d double, e double, f double, key string, arm int, y double").repartition(parts)


@pytest.mark.parametrize("held", [gram.HELD, 1])
def test_gram_is_the_covariance_of_whole_rows(spark, monkeypatch, held):
    monkeypatch.setattr(gram, "HELD", held)
    monkeypatch.setattr(gram, "SLOTS", 3)
    pdf, df = wide(spark)
    cols = list("abcde")
    out = gram.covariances(gram.gram(df, cols, ["key"]), cols, ["key"]).toPandas()
    assert len(out) == 3 * 15
    for k, own in out.groupby("key", dropna=False):
        x = pdf[pdf["key"].isna() if pd.isna(k) else pdf["key"] == k].dropna(subset=cols)[cols]
        assert set(own["n"]) == {len(x)}
        for r in own.itertuples():
            assert r.cov == pytest.approx(x[r.a].cov(x[r.b]), abs=1e-7) and r.corr == pytest.approx(x[r.a].corr(x[r.b]), abs=1e-7)


def test_gram_of_no_rows_one_row_and_keys_of_other_types(spark):
    none = spark.createDataFrame([], "a double, b double")
    assert gram.gram(none, ["a", "b"]).count() == 0
    one = gram.gram(spark.createDataFrame([(1.0, 2.0)], "a double, b double"), ["a", "b"])
    assert [r["cov"] for r in gram.covariances(one, ["a", "b"]).collect()] == [None] * 3
    big = spark.createDataFrame([(2**60 + 1, 1.0), (2**60 + 1, 3.0), (None, 1.0)], "k long, a double")
    assert {(r["k"], r["n"]) for r in gram.gram(big, ["a"], ["k"]).collect()} == {(2**60 + 1, 2), (None, 1)}


def test_dependent_and_constant_columns_are_found(spark):
    pdf, df = wide(spark)
    out = {r["column"]: r for r in gram.independent(gram.gram(df, list("abcdef")), list("abcdef")).collect()}
    x = pdf[list("abcdef")].dropna().to_numpy()
    assert sum(r["independent"] for r in out.values()) == np.linalg.matrix_rank((x - x.mean(axis=0)) / np.maximum(x.std(axis=0), 1e-9), tol=1e-4)
    assert not out["f"]["independent"] and sum(not out[c]["independent"] for c in "ace") == 1
    assert sorted(r["position"] for r in out.values() if r["independent"]) == [0, 1, 2, 3]


def test_adjusted_effects_are_least_squares(spark):
    pdf, df = wide(spark)
    out = gram.adjusted_effects(df, "arm", "y", list("abcdef"), ["key"]).toPandas()
    for r in out.itertuples():
        own = pdf[pdf["key"].isna() if pd.isna(r.key) else pdf["key"] == r.key].dropna(subset=list("abcdef"))
        x, y = own[list("abcdef")].to_numpy(), own["y"].to_numpy()
        c = (x - x.mean(axis=0))[:, [0, 1, 2, 3]]
        theta = np.linalg.lstsq(c, y - y.mean(), rcond=None)[0]
        z = pd.Series(y - c @ theta, index=own.index)
        t, q = z[own["arm"] == 1], z[own["arm"] == 0]
        assert (r.n_t, r.n_c, r.rank) == (len(t), len(q), 4)
        assert r.effect == pytest.approx(t.mean() - q.mean()) and r.t_stat == pytest.approx((t.mean() - q.mean()) / (t.var() / len(t) + q.var() / len(q)) ** 0.5)
        assert r.var_reduction == pytest.approx(1 - z.var() / y.var(ddof=1))


def test_a_segment_or_order_never_mixes_reports(spark):
    rows = [(e, i % 2, f"d{i % 4}", float((i * 7) % 5 > 2), float(i % 9), float(i % 3)) for e in ("x", "y") for i in range(80)]
    rows += [("lone", 1, "d0", 1.0, 2.0, 3.0), ("x", 5, "d0", 1.0, 2.0, 3.0), (None, 1, "d0", 1.0, 2.0, 3.0)]
    df = spark.createDataFrame(rows, "e string, arm int, day string, hit double, v double, f double")

    def report(d):
        out = reports.report_rows(d, "e", "arm", "day", "hit", {"hit": (F.col("hit"), "binary"), "v": (F.col("v"), "continuous")}, {"f": F.col("f")})
        return out.toPandas().sort_values(["e", "role", "measure"]).reset_index(drop=True)

    both, alone = report(df), report(df.filter("e = 'x'"))
    pd.testing.assert_frame_equal(both[both["e"] == "x"].reset_index(drop=True), alone)
    assert set(both["e"]) == {"x", "y", "lone"} and set(both[both["e"] == "x"]["role"]) == {"traffic", "feature", "main", "secondary", "power", "stability", "advice"}
    x = both[(both["e"] == "x") & (both["measure"] == "hit") & (both["role"] == "main")].iloc[0]
    assert (x["n_t"], x["n_c"]) == (40, 40)
    lone = both[both["e"] == "lone"].set_index("role")
    assert pd.isna(lone.loc["main", "p_value"]) and pd.isna(lone.loc["main", "effect"]) and lone.loc["stability", "verdict"] == "too few periods"
    texts = reports.render(cut(spark.createDataFrame(both[both["e"] != "lone"], "e string, role string, measure string, n_t long, n_c long, effect double, lift_pct double, statistic double, p_value double, verdict string")), "e").toPandas()
    assert all(t.startswith(f"# {e}\n") and t.count("\n") == 2 + 1 + 7 for e, t in zip(texts["e"], texts["text"]))
