"""Effect estimation: two-arm tests, multiple testing, DID, CUPED, outliers, ranks, funnels, survival."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.special import p_norm, p_t
from .frames import percentiles, running
from .moments import arms, ratio, welch

Z95 = 1.96


def conversion_test(counts: DataFrame, alpha: float = 0.05) -> DataFrame:
    """counts: n_t, x_t, n_c, x_c. Pooled two-sided Z test with intervals, lift and Cohen's h."""
    pt, pc = ratio(F.col("x_t"), F.col("n_t")), ratio(F.col("x_c"), F.col("n_c"))
    pool = ratio(F.col("x_t") + F.col("x_c"), F.col("n_t") + F.col("n_c"))
    se = F.sqrt(pool * (1 - pool) * (1 / F.col("n_t") + 1 / F.col("n_c")))
    spread = F.sqrt(pt * (1 - pt) / F.col("n_t") + pc * (1 - pc) / F.col("n_c"))
    own = F.sqrt(pt * (1 - pt) / F.col("n_t"))
    out = counts.withColumns({"rate_t": pt, "rate_c": pc, "diff": pt - pc, "lift_pct": ratio(pt - pc, pc) * 100, "z": F.coalesce(ratio(pt - pc, se), F.lit(0.0)), "ci_low": pt - pc - Z95 * spread, "ci_high": pt - pc + Z95 * spread, "rate_t_low": pt - Z95 * own, "rate_t_high": pt + Z95 * own, "cohens_h": 2 * F.asin(F.sqrt(pt)) - 2 * F.asin(F.sqrt(pc))})
    return out.withColumn("p_value", p_norm("z")).withColumn("significant", F.col("p_value") < alpha)


def continuous_test(df: DataFrame, arm: str, y: str, alpha: float = 0.05, keys: list[str] = ()) -> DataFrame:
    """Welch's test; interval and Cohen's d use population variances."""
    return tested(arms(df, arm, [y], keys=list(keys)), y, alpha, keys)


def tested(m: DataFrame, y: str, alpha: float = 0.05, keys: list[str] = ()) -> DataFrame:
    """continuous_test from the moments of both arms."""
    mt, mc, nt, nc = F.col(f"mean_{y}_t"), F.col(f"mean_{y}_c"), F.col("n_t"), F.col("n_c")
    t, nu = welch(mt, F.col(f"var_{y}_t"), nt, mc, F.col(f"var_{y}_c"), nc)
    vt, vc = F.col(f"vpop_{y}_t"), F.col(f"vpop_{y}_c")
    se = F.sqrt(vt / nt + vc / nc)
    out = m.select(*keys, "n_t", "n_c", mt.alias("mean_t"), mc.alias("mean_c"), (mt - mc).alias("diff"), (ratio(mt - mc, mc) * 100).alias("lift_pct"), t.alias("t_stat"), nu.alias("nu"), (mt - mc - Z95 * se).alias("ci_low"), (mt - mc + Z95 * se).alias("ci_high"), ratio(mt - mc, F.sqrt((vt + vc) / 2)).alias("cohens_d"))
    return out.withColumn("p_value", p_t("t_stat", "nu")).withColumn("significant", F.col("p_value") < alpha)


def bonferroni(tests: DataFrame, p: str = "p_value") -> DataFrame:
    n = tests.agg(F.count("*").alias("_n"))
    return tests.join(F.broadcast(n)).withColumn("p_bonferroni", F.least(F.lit(1.0), F.col(p) * F.col("_n"))).drop("_n")  # one row


def benjamini_hochberg(tests: DataFrame, p: str = "p_value", order: str = "test") -> DataFrame:
    """Step-up adjusted p-values. One row a test, so the window over all of them is small."""
    rank = F.row_number().over(Window.orderBy(p, order))
    n = F.count("*").over(Window.partitionBy())
    out = tests.withColumn("_r", rank).withColumn("_raw", F.col(p) * n / F.col("_r"))
    down = Window.orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("p_fdr", F.least(F.lit(1.0), F.min("_raw").over(down))).drop("_r", "_raw")


def sequential_test(df: DataFrame, arm: str, y: str, alpha: float = 0.05, keys: list[str] = ()) -> DataFrame:
    """Welch's p against a boundary that tightens with the sample: alpha * sqrt(ln(1 + n) / n)."""
    t = continuous_test(df, arm, y, alpha, keys)
    n = F.least("n_t", "n_c").cast("double")
    bound = F.when(n > 0, F.lit(alpha) * F.sqrt(F.log(1 + n) / n))
    return t.select(*keys, "n_t", "n_c", F.col("diff").alias("effect"), "t_stat", "p_value", bound.alias("boundary"), F.coalesce(F.col("p_value") < bound, F.lit(False)).alias("stop"))


#: What is carried of the two arms: sizes, means and sums of squared deviations.
ARM_CELLS = ("n_t", "mean_t", "m2_t", "n_c", "mean_c", "m2_c")


def arm_cells(arm: str, y: str) -> list[Column]:
    """The aggregates ARM_CELLS of the arms 1 (t) and 0 (c)."""
    out = []
    for code, s in ((1, "t"), (0, "c")):
        own = F.when(F.col(arm) == code, F.col(y).cast("double"))
        n = F.count(own).cast("double")
        out += [n.alias(f"n_{s}"), F.coalesce(F.avg(own), F.lit(0.0)).alias(f"mean_{s}"), F.coalesce(F.var_pop(own) * n, F.lit(0.0)).alias(f"m2_{s}")]
    return out


def add_arms(a: Column, b: Column) -> Column:
    """Chan's formula: the cells of two sets of rows together. Nothing cancels, however many rows there are."""
    out = []
    for s in "tc":
        n, d = a[f"n_{s}"] + b[f"n_{s}"], b[f"mean_{s}"] - a[f"mean_{s}"]
        part = F.coalesce(ratio(b[f"n_{s}"], n), F.lit(0.0))
        out += [n.alias(f"n_{s}"), (a[f"mean_{s}"] + d * part).alias(f"mean_{s}"), (a[f"m2_{s}"] + b[f"m2_{s}"] + d * d * a[f"n_{s}"] * part).alias(f"m2_{s}")]
    return F.struct(*out)


def _zero() -> Column:
    return F.struct(*[F.lit(0.0).alias(c) for c in ARM_CELLS])


def merged_arms(cells: DataFrame, keys: list[str]) -> DataFrame:
    """One row of ARM_CELLS for each key."""
    return cells.groupBy(*keys).agg(F.collect_list(F.struct(*ARM_CELLS)).alias("_c")).select(*keys, F.aggregate("_c", _zero(), add_arms).alias("_m")).select(*keys, "_m.*")


def running_arms(cells: DataFrame, period: str, keys: list[str] = (), carried: DataFrame | None = None) -> DataFrame:
    """cells: (period, keys, ARM_CELLS). The cells of all periods up to each, after those carried: (keys, ARM_CELLS).

    A key's periods are one array: a few numbers a period, whatever the number of rows.
    """
    keys = list(keys)
    one = (cells.groupBy(*keys) if keys else cells.groupBy()).agg(F.array_sort(F.collect_list(F.struct(period, *ARM_CELLS))).alias("_c")).filter(F.size("_c") > 0)
    start = _zero()
    if carried is not None:
        had = carried.select(*keys, F.struct(*ARM_CELLS).alias("_had"))
        one = one.join(had, keys, "left") if keys else one.join(F.broadcast(had), how="left")  # one row
        start = F.coalesce("_had", start)

    def step(state: Column, x: Column) -> Column:
        own = F.transform(F.array(add_arms(state["m"], x)), lambda m: F.struct(m.alias("m"), F.concat(state["out"], F.array(F.struct(x[period].alias(period), *[m[c].alias(c) for c in ARM_CELLS]))).alias("out")))
        return own[0]

    run = one.select(*keys, F.aggregate("_c", F.struct(start.alias("m"), F.slice("_c", 1, 0).alias("out")), step)["out"].alias("_r"))
    return run.select(*keys, F.inline("_r"))


def arms_test(run: DataFrame, keep: list[str], alpha: float = 0.05) -> DataFrame:
    """The sequential test of ARM_CELLS: Welch's p against alpha * sqrt(ln(1 + n) / n)."""
    var = {s: ratio(F.col(f"m2_{s}"), F.col(f"n_{s}") - 1) for s in "tc"}
    t, nu = welch(F.col("mean_t"), var["t"], F.col("n_t"), F.col("mean_c"), var["c"], F.col("n_c"))
    n = F.least("n_t", "n_c")
    bound = F.when(n > 0, F.lit(alpha) * F.sqrt(F.log(1 + n) / n))
    effect = F.when(n > 0, F.col("mean_t") - F.col("mean_c"))
    out = run.select(*keep, F.col("n_t").cast("long").alias("n_t"), F.col("n_c").cast("long").alias("n_c"), effect.alias("effect"), t.alias("t_stat"), nu.alias("nu"), bound.alias("boundary"))
    return out.withColumn("p_value", p_t("t_stat", "nu")).withColumn("stop", F.coalesce(F.col("p_value") < F.col("boundary"), F.lit(False))).drop("nu")


def sequential_trajectory(df: DataFrame, arm: str, y: str, period: str, alpha: float = 0.05, keys: list[str] = ()) -> DataFrame:
    """The sequential test at the end of every period on all rows so far; a row a period (and key)."""
    cells = df.filter(F.col(y).isNotNull() & F.col(arm).isin(0, 1)).groupBy(period, *keys).agg(*arm_cells(arm, y))
    return arms_test(running_arms(cells, period, keys), [period, *keys], alpha)


def pre_post(df: DataFrame, arm: str, pre: str, post: str, keys: list[str] = (), ddof: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """Four estimators from one pass over the rows: plain, did, cuped, did_cuped; a row for each.

    The CUPED adjustment y - theta * (x - mean x) is applied to moments, not to rows: theta comes
    from the pooled moments. var_reduction compares population variances, or those that ddof
    names as (of the adjusted, of the plain metric) for a method.
    """
    d = df.select(*keys, F.col(arm).alias("a"), F.col(pre).cast("double").alias("x"), F.col(post).cast("double").alias("y")).withColumn("d", F.col("y") - F.col("x"))
    return estimates(arms(d, "a", ["x", "y", "d"], [("y", "x"), ("d", "x")], list(keys)), keys, ddof)


def estimates(m: DataFrame, keys: list[str] = (), ddof: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """pre_post from the moments of x, y and d = y - x of both arms."""
    rows = []
    n = F.col("n_t") + F.col("n_c")
    for name, y, adjust in (("plain", "y", False), ("did", "d", False), ("cuped", "y", True), ("did_cuped", "d", True)):
        theta = F.coalesce(ratio(F.col(f"cov_{y}_x"), F.col("var_x")), F.lit(0.0)) if adjust else F.lit(0.0)
        mean = {s: F.col(f"mean_{y}_{s}") - theta * (F.col(f"mean_x_{s}") - F.col("mean_x")) for s in "tc"}
        var = {s: F.col(f"var_{y}_{s}") + theta * theta * F.col(f"var_x_{s}") - 2 * theta * F.col(f"cov_{y}_x_{s}") for s in "tc"}
        whole = F.col(f"vpop_{y}") + theta * theta * F.col("vpop_x") - 2 * theta * F.col(f"cov_{y}_x") * (n - 1) / n
        a, b = (ddof or {}).get(name, (0, 0))
        whole = whole * n / (n - 1) if a else whole
        t, nu = welch(mean["t"], var["t"], F.col("n_t"), mean["c"], var["c"], F.col("n_c"))
        rows.append(F.struct(F.lit(name).alias("method"), theta.alias("theta"), (mean["t"] - mean["c"]).alias("effect"), t.alias("t_stat"), nu.alias("nu"), (1 - ratio(whole, F.col("var_y") if b else F.col("vpop_y"))).alias("var_reduction")))
    out = m.select(*keys, F.explode(F.array(*rows)).alias("r")).select(*keys, "r.*")
    return out.withColumn("p_value", p_t("t_stat", "nu"))


def multi_cuped(df: DataFrame, arm: str, y: str, covariates: list[str], keys: list[str] = (), ddof: tuple[int, int] = (1, 1), raw: str | None = None) -> DataFrame:
    """CUPED with several covariates, from one pass of moments. A covariate that is constant or
    (nearly) a combination of those before it is left out, as a least-squares fit would not need it.

    var_reduction compares the variance of the adjusted metric with that of raw (y itself if None);
    ddof says of which kind each is: 1 for sample, 0 for population variances.
    """
    cols = list(dict.fromkeys([y, *covariates, *([raw] if raw else [])]))
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    d = df.select(*keys, F.col(arm).alias("a"), *[F.col(c).cast("double").alias(c) for c in cols])
    m = arms(d, "a", cols, pairs, list(keys))
    cov = lambda r, a, b, s: r[f"var_{a}{s}"] if a == b else r[f"cov_{a}_{b}{s}"] if f"cov_{a}_{b}{s}" in r else r[f"cov_{b}_{a}{s}"]

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in pdf.to_dict("records"):
            if not r["n_t"] or not r["n_c"]:
                continue
            chosen: list[str] = []
            for c in covariates:
                s = np.array([[cov(r, p, q, "") for q in [*chosen, c]] for p in [*chosen, c]], float)
                sd = np.sqrt(np.diag(s))
                if np.isfinite(s).all() and (sd > 0).all() and np.linalg.eigvalsh(s / np.outer(sd, sd))[0] > 1e-9:
                    chosen.append(c)
            theta = np.linalg.solve([[cov(r, p, q, "") for q in chosen] for p in chosen], [cov(r, y, p, "") for p in chosen]) if chosen else np.zeros(0)
            mean, var = {}, {}
            for s in ("_t", "_c"):
                mean[s] = r[f"mean_{y}{s}"] - sum(t * (r[f"mean_{c}{s}"] - r[f"mean_{c}"]) for t, c in zip(theta, chosen))
                own = np.array([[cov(r, p, q, s) for q in chosen] for p in chosen], float).reshape(len(chosen), -1)
                var[s] = r[f"var_{y}{s}"] - 2 * sum(t * cov(r, y, c, s) for t, c in zip(theta, chosen)) + (theta @ own @ theta if chosen else 0)
            n, plain = r["n_t"] + r["n_c"], r[f"var_{raw or y}"]
            whole = r[f"var_{y}"] - sum(t * cov(r, y, c, "") for t, c in zip(theta, chosen))
            whole, plain = (v if k else v * (n - 1) / n for v, k in zip((whole, plain), ddof))
            a, b = var["_t"] / r["n_t"], var["_c"] / r["n_c"]
            t = (mean["_t"] - mean["_c"]) / (a + b) ** 0.5 if a + b > 0 else None
            nu = (a + b) ** 2 / (a * a / (r["n_t"] - 1) + b * b / (r["n_c"] - 1)) if a + b > 0 else None
            out.append([r[k] for k in keys] + [mean["_t"] - mean["_c"], t, nu, 1 - whole / plain if plain else 0.0, len(chosen)])
        return pd.DataFrame(out, columns=[*keys, "effect", "t_stat", "nu", "var_reduction", "n_covariates"])

    types = dict(m.dtypes)
    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), "effect double, t_stat double, nu double, var_reduction double, n_covariates int"])
    return m.mapInPandas(lambda it: (solve(p) for p in it), schema).withColumn("p_value", p_t("t_stat", "nu"))


#: Which variances the extended estimators compare, (of the adjusted metric, of the plain one): 1 sample, 0 population.
EXTENDED_DDOF = {"plain": (1, 1), "did": (1, 1), "cuped": (0, 1), "multi_cuped": (0, 0), "did_multi_cuped": (0, 1)}


def extended_estimators(df: DataFrame, arm: str, pre: str, post: str, covariates: list[str], keys: list[str] = ()) -> DataFrame:
    """plain, did, cuped with pre, CUPED with all covariates, and DID with all covariates: a row for each."""
    keys = list(keys)
    two = pre_post(df, arm, pre, post, keys, {k: EXTENDED_DDOF[k] for k in ("did", "cuped")}).filter(F.col("method").isin("plain", "did", "cuped"))
    out = two.select(*keys, "method", "effect", "t_stat", "nu", "var_reduction", "p_value")
    d = df.withColumn("_delta", F.col(post).cast("double") - F.col(pre).cast("double"))
    for name, y in (("multi_cuped", post), ("did_multi_cuped", "_delta")):
        one = multi_cuped(d, arm, y, covariates, keys, EXTENDED_DDOF[name], post).withColumn("method", F.lit(name))
        out = out.unionByName(one.select(*out.columns))
    return out


def seasonal_cuped(df: DataFrame, arm: str, pre: str, post: str, weekday: str, weekend: str) -> DataFrame:
    """CUPED with the earlier metric and marks of weekday and weekend; of marks that add up to one, one is used."""
    return multi_cuped(df, arm, post, [pre, weekday, weekend], ddof=(0, 0))


def z_normalized(df: DataFrame, columns: list[str]) -> DataFrame:
    """Adds log_<c>_norm: log(1 + c) less its mean, over its population deviation (null where that is 0)."""
    m = df.agg(*[f(F.log1p(c)).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    out = df.join(F.broadcast(m))  # one row
    return out.withColumns({f"log_{c}_norm": ratio(F.log1p(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")) for c in columns}).drop(*m.columns)


def bounds(df: DataFrame, arm: str, y: str, points: dict[str, float]) -> DataFrame:
    """Exact percentiles of y by arm, one row an arm."""
    return percentiles(df, y, points, [arm])


def winsorize(df: DataFrame, arm: str, y: str, low: float = 0.05, high: float = 0.95, name: str = "winsorized") -> DataFrame:
    b = bounds(df, arm, y, {"_lo": low, "_hi": high})
    return df.join(F.broadcast(b), arm).withColumn(name, F.least(F.greatest(F.col(y), F.col("_lo")), F.col("_hi"))).drop("_lo", "_hi")  # one row an arm


def cap_top(df: DataFrame, arm: str, y: str, at: float = 0.99, name: str = "capped") -> DataFrame:
    return df.join(F.broadcast(bounds(df, arm, y, {"_hi": at})), arm).withColumn(name, F.least(F.col(y), F.col("_hi"))).drop("_hi")


def mann_whitney(df: DataFrame, arm: str, y: str) -> DataFrame:
    """Two-sided U test, normal approximation with corrections for ties and continuity.

    Works on the distinct values with their counts: the rank of a value is what lies below it
    plus half its ties. Values are ranked by range, not in one task.
    """
    v = df.filter(F.col(y).isNotNull() & F.col(arm).isin(0, 1)).groupBy(F.col(y).alias("v")).agg(F.count("*").alias("n"), F.sum(F.when(F.col(arm) == 1, 1).otherwise(0)).alias("nt"))
    r = running(v, ["v"], {"_b": F.col("n")}).withColumn("rank", F.col("_b") + (F.col("n") + 1) / 2)
    n = F.col("n").cast("double")
    s = r.agg(F.sum(F.col("nt") * F.col("rank")).alias("rt"), F.sum("nt").cast("double").alias("n_t"), F.sum(F.col("n") - F.col("nt")).cast("double").alias("n_c"), F.sum(n * n * n - n).alias("ties"))
    nt, nc = F.col("n_t"), F.col("n_c")
    total = nt + nc
    u = F.col("rt") - nt * (nt + 1) / 2
    sd = F.sqrt(nt * nc / 12 * (total + 1 - ratio(F.col("ties"), total * (total - 1))))
    top = F.greatest(u, nt * nc - u)
    out = s.withColumn("u_stat", u).withColumn("z", F.coalesce(ratio(top - nt * nc / 2 - 0.5, sd), F.lit(0.0)))
    return out.withColumn("p_value", F.least(F.lit(1.0), F.when(F.col("z") < 0, F.lit(1.0)).otherwise(p_norm("z")))).select("n_t", "n_c", "u_stat", "z", "p_value")


def funnel(df: DataFrame, arm: str, steps: list[str]) -> DataFrame:
    """Rates, lift and pooled Z test of each step column (0/1); absent columns are skipped."""
    from .balance import unpivot

    s = unpivot(df.filter(F.col(arm).isin(0, 1)), [arm], steps)
    c = s.groupBy(F.col("feature").alias("step")).agg(*[F.count(F.when(F.col(arm) == k, 1)).alias(f"n_{n}") for k, n in ((1, "t"), (0, "c"))], *[F.coalesce(F.sum(F.when(F.col(arm) == k, F.col("value"))), F.lit(0.0)).alias(f"x_{n}") for k, n in ((1, "t"), (0, "c"))])
    return conversion_test(c).select("step", "rate_t", "rate_c", "lift_pct", "z", "p_value", "significant")


def unpooled_rates(rates: DataFrame) -> DataFrame:
    """rates: step, rate_t, rate_c, n_t, n_c. Lift and Z test with the unpooled standard error."""
    se = F.sqrt(F.col("rate_t") * (1 - F.col("rate_t")) / F.col("n_t") + F.col("rate_c") * (1 - F.col("rate_c")) / F.col("n_c"))
    out = rates.withColumn("lift_pct", F.coalesce(ratio(F.col("rate_t") - F.col("rate_c"), F.col("rate_c")) * 100, F.lit(0.0))).withColumn("z", F.coalesce(ratio(F.col("rate_t") - F.col("rate_c"), se), F.lit(0.0)))
    return out.withColumn("p_value", p_norm("z")).withColumn("significant", F.col("p_value") < 0.05)


def compare_outliers(df: DataFrame, arm: str, y: str) -> DataFrame:
    """Welch's test of y as it is and after each treatment of outliers, and the rank test."""
    t = cap_top(winsorize(df.select(arm, F.col(y).cast("double").alias("raw")), arm, "raw"), arm, "raw").withColumn("log", F.log1p("raw"))
    long = t.selectExpr(arm, "stack(4, 'raw', raw, 'winsorized', winsorized, 'capped', capped, 'log', log) as (method, v)")
    out = continuous_test(long, arm, "v", keys=["method"]).select("method", F.col("diff").alias("effect"), "t_stat", "p_value")
    u = mann_whitney(df, arm, y).select(F.lit("rank").alias("method"), F.lit(None).cast("double").alias("effect"), F.col("z").alias("t_stat"), "p_value")
    return out.unionByName(u)


def outlier_study(df: DataFrame, arm: str, y: str, user: str, trials: int = 100, effect_pct: float = 5.0, noise: float = 0.1) -> DataFrame:
    """(method, power, mean_effect, std_effect, raw_p, rank_p): how often each treatment of outliers
    finds an effect put into the treated arm under noise, and what the plain and the rank test say of the data.

    A task makes its users' values of every trial in place and sums them (`simulate.noisy_points`, `noisy_sums`), so no row a user and trial exists.
    """
    from .simulate import noisy_points, noisy_sums

    own = df.filter(F.col(arm).isin(0, 1)).select(user, arm, F.col(y).cast("double").alias("y"))
    lifted = F.when(F.col(arm) == 1, F.col("y") * (1 + effect_pct / 100)).otherwise(F.col("y"))
    rows = own.select(F.col(user).cast("string").alias("u"), F.col(arm).cast("int").alias("a"), lifted.alias("y"))
    # equal values are their own mean to the last digit
    about = rows.groupBy("a").agg(F.count("*").alias("n"), F.count(F.when(F.col("u").isNotNull(), F.col("y"))).alias("held"), F.stddev_pop("y").alias("sd"), F.when(F.min("y") == F.max("y"), F.min("y")).otherwise(F.avg("y")).alias("mean"))
    about = {x["a"]: x for x in about.collect()}  # a row an arm
    rows = rows.filter("u is not null and y is not null")
    scale = {a: noise * x["sd"] for a, x in about.items() if x["held"]}
    held, mean = {a: about[a]["held"] for a in scale}, {a: about[a]["mean"] for a in scale}
    points = noisy_points(rows, "outlier", trials, scale, held, [0.01, 0.05, 0.95, 0.99])

    def treated(raw, at):
        p01, p05, p95, p99 = at
        between = lambda lo, hi: np.minimum(np.maximum(raw, lo), hi)
        return {"raw": raw, "winsorize_5": between(p05, p95), "winsorize_1": between(p01, p99), "cap_99": np.minimum(raw, p99), "log": np.log1p(np.maximum(raw, 0.0))}

    m = noisy_sums(rows, "outlier", trials, scale, mean, points, treated)
    for s, code in (("t", 1), ("c", 0)):
        m = m.withColumn(f"n_{s}", F.lit(about[code]["n"] if code in about else 0).cast("long"))
    each = tested(m, "v", keys=["method", "trial"])
    out = each.groupBy("method").agg(F.avg(F.col("significant").cast("double")).alias("power"), F.avg("diff").alias("mean_effect"), F.stddev_pop("diff").alias("std_effect"))
    return out.join(continuous_test(own, arm, "y").select(F.col("p_value").alias("raw_p"))).join(mann_whitney(own, arm, "y").select(F.col("p_value").alias("rank_p")))  # one row each


def kaplan_meier(df: DataFrame, days: str, observed: str, keys: list[str] = (), max_day: int = 60) -> DataFrame:
    """(keys, day, at_risk, events, survival) for every day from 1 to max_day."""
    keys = list(keys)
    d = df.filter(F.col(days).isNotNull()).groupBy(*keys, F.greatest(F.lit(0), F.least(F.col(days).cast("int"), F.lit(max_day + 1))).alias("day")).agg(F.count("*").alias("leave"), F.sum(F.col(observed).cast("long")).alias("events"))
    who = d.select(*keys).distinct() if keys else d.sparkSession.range(1).select()
    grid = who.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(max_day + 1))).alias("day"))
    full = grid.join(d, [*keys, "day"], "left").fillna(0, ["leave", "events"])
    part = Window.partitionBy(*keys)
    full = full.withColumn("at_risk", F.sum("leave").over(part.orderBy(F.desc("day")))).filter(F.col("day").between(1, max_day))
    keep = 1 - F.coalesce(ratio(F.col("events"), F.col("at_risk")), F.lit(0.0))
    run = part.orderBy("day")
    survival = F.when(F.max((keep <= 0).cast("int")).over(run) == 1, F.lit(0.0)).otherwise(F.exp(F.sum(F.log(F.when(keep > 0, keep).otherwise(1.0))).over(run)))
    return full.select(*keys, "day", "at_risk", "events", survival.alias("survival"))


def compare_survival(df: DataFrame, arm: str, days: str, observed: str, milestones: tuple[int, ...] = (7, 14, 30), max_day: int = 60) -> DataFrame:
    """Share of each arm with the event by each milestone, and the rank test of the days (censoring ignored)."""
    km = kaplan_meier(df, days, observed, [arm], max_day).filter(F.col("day").isin(*milestones))
    wide = km.groupBy("day").agg(*[F.max(F.when(F.col(arm) == k, 1 - F.col("survival"))).alias(f"rate_{n}") for k, n in ((1, "t"), (0, "c"))])
    return wide.withColumn("diff", F.col("rate_t") - F.col("rate_c")).join(F.broadcast(mann_whitney(df, arm, days).select("p_value")))


def at_timepoints(df: DataFrame, arm: str, y: str, points: tuple[int, ...] = (7, 14, 30), month: int = 30) -> DataFrame:
    m = arms(df.withColumn("_y", F.col(y).cast("double")), arm, ["_y"])
    t = F.explode(F.array(*[F.lit(p) for p in points])).alias("day")
    out = m.select("n_t", "mean__y_t", "mean__y_c", t)
    return out.select("day", (F.col("mean__y_t") * F.col("day") / month).alias("value_t"), (F.col("mean__y_c") * F.col("day") / month).alias("value_c"), (ratio(F.col("mean__y_t") - F.col("mean__y_c"), F.col("mean__y_c")) * 100).alias("lift_pct"), F.col("n_t").alias("n"))


def risk_metrics(df: DataFrame, arm: str, amount: str, default: str) -> DataFrame:
    """Mean amount, default rate and expected loss of both arms, and the reduction in per cent."""
    m = arms(df.select(F.col(arm).alias("a"), F.col(amount).cast("double").alias("v"), F.col(default).cast("double").alias("d")), "a", ["v", "d"])
    loss = {s: F.col(f"mean_v_{s}") * F.col(f"mean_d_{s}") for s in "tc"}
    return m.select(*[F.col(f"mean_{c}_{s}").alias(f"{n}_{s}") for c, n in (("v", "avg_amount"), ("d", "default_rate")) for s in "tc"], loss["t"].alias("expected_loss_t"), loss["c"].alias("expected_loss_c"), (ratio(loss["c"] - loss["t"], loss["c"]) * 100).alias("loss_reduction_pct"))


def stability(df: DataFrame, arm: str, y: str, order: list[str]) -> DataFrame:
    """Stability of the running effect: thirds, ten chunks, direction; one row.

    Running means per arm over `order`; positions beyond the shorter arm are left out. Below ten
    positions status is insufficient_data. The prefix sums are taken by range, then the arms
    meet on their position.
    """
    own = df.filter(F.col(arm).isin(0, 1) & F.col(y).isNotNull()).select(F.col(arm).cast("int").alias("a"), F.col(y).cast("double").alias("y"), *order)
    k = running(own, order, {"k": F.lit(1).cast("long"), "_s": F.col("y")}, ["a"])
    mean = (F.col("_s") + F.col("y")) / (F.col("k") + 1)
    e = k.groupBy("k").agg(*[F.max(F.when(F.col("a") == code, mean)).alias(s) for code, s in ((1, "t"), (0, "c"))])
    e = e.filter("t is not null and c is not null").select("k", (F.col("t") - F.col("c")).alias("e"))
    n = e.agg(F.count("*").alias("n"))
    third, chunk = F.floor(F.col("n") / 3), F.floor(F.col("n") / 10)
    e = e.join(F.broadcast(n)).withColumn("c", F.when(chunk > 0, F.floor(F.col("k") / chunk)))
    parts = e.groupBy("n", "c").agg(F.sum("e").alias("s"), F.count("*").alias("m"), F.sum(F.when(F.col("k") < third, F.col("e"))).alias("s1"), F.count(F.when(F.col("k") < third, 1)).alias("m1"), F.sum(F.when(F.col("k") >= F.col("n") - third, F.col("e"))).alias("s3"), F.count(F.when(F.col("k") >= F.col("n") - third, 1)).alias("m3"), F.max_by("e", "k").alias("last"), F.max("k").alias("kl"))
    o = parts.groupBy("n").agg(ratio(F.sum("s1"), F.sum("m1")).alias("early"), ratio(F.sum("s3"), F.sum("m3")).alias("late"), F.stddev_pop(F.when(F.col("c") < 10, F.col("s") / F.col("m"))).alias("chunk_std"), F.max_by("last", "kl").alias("effect"))
    base = F.when(F.col("effect") == 0, F.lit(1.0)).otherwise(F.abs("effect"))
    trend = F.coalesce(ratio(F.col("late") - F.col("early"), F.abs("early")) * 100, F.lit(0.0))
    ok = F.col("n") >= 10
    return o.select("n", F.when(ok, F.lit("ok")).otherwise("insufficient_data").alias("status"), *[F.when(ok, c).alias(a) for c, a in ((F.col("early"), "early"), (F.col("late"), "late"), (trend, "trend_pct"), (F.col("chunk_std"), "chunk_std"), (F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("chunk_std") / base)), "stability"), (F.when(trend > 20, "up").when(trend < -20, "down").otherwise("stable"), "direction"))])


def beta_binomial(counts: DataFrame, a: float = 1.0, b: float = 1.0, panels: int = 2000) -> DataFrame:
    """counts: n_t, x_t, n_c, x_c. Posterior means with 95 % credible intervals, P(t > c) and the
    interval of the lift by quadrature, and its reading."""
    added = ["prob_better", "low_t", "high_t", "low_c", "high_c", "lift_low", "lift_high"]

    def run(it):
        for pdf in it:
            rows = []
            for r in pdf.itertuples():
                t, c = (a + r.x_t, b + r.n_t - r.x_t), (a + r.x_c, b + r.n_c - r.x_c)
                rows.append([_prob_better(*t, *c, panels), *(_beta_quantile(*x, p) for x in (t, c) for p in (0.025, 0.975)), *_lift_interval(t, c)])
            yield pd.concat([pdf, pd.DataFrame(rows, columns=added, index=pdf.index, dtype=float)], axis=1)

    out = counts.mapInPandas(run, StructType([*counts.schema.fields, *[StructField(x, DoubleType()) for x in added]]))
    mt, mc = (F.col("x_t") + a) / (F.col("n_t") + a + b), (F.col("x_c") + a) / (F.col("n_c") + a + b)
    p = F.col("prob_better")
    said = F.when(p > 0.95, "strong_win").when(p > 0.85, "likely_win").when(p > 0.6, "lean_win").when(p > 0.4, "no_difference").otherwise("lean_loss")
    return out.withColumns({"mean_t": mt, "mean_c": mc, "abs_lift": mt - mc, "rel_lift": (mt - mc) / (mc + 1e-9), "reading": said})


def _beta_quantile(a: float, b: float, p: float) -> float:
    from ..functions.special import beta_i

    lo, hi = 0.0, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if beta_i(a, b, mid) < p else (lo, mid)
    return (lo + hi) / 2


def _lift_interval(t: tuple[float, float], c: tuple[float, float], cells: int = 4000) -> tuple[float, float]:
    """The 2.5 and 97.5 % points of the difference of two beta variables, on a grid of their densities."""
    def grid(a: float, b: float, width: float, lo: float) -> np.ndarray:
        x = lo + width * np.arange(cells)
        inside = (x > 0) & (x < 1)
        log = np.full(cells, -np.inf)
        log[inside] = (a - 1) * np.log(x[inside]) + (b - 1) * np.log1p(-x[inside])
        w = np.exp(log - log.max())
        return w / w.sum()

    span = [(m := a / (a + b), 9 * (a * b / ((a + b) ** 2 * (a + b + 1))) ** 0.5) for a, b in (t, c)]
    width = 2 * max(s for _, s in span) / cells
    lo = [m - width * cells / 2 + width / 2 for m, _ in span]
    size = 1 << (2 * cells).bit_length()
    diff = np.fft.irfft(np.fft.rfft(grid(*t, width, lo[0]), size) * np.fft.rfft(grid(*c, width, lo[1])[::-1], size), size)[: 2 * cells - 1]
    total = np.cumsum(diff)
    at = lambda p: lo[0] - lo[1] + width * (int(np.searchsorted(total, p)) - cells + 1)
    return at(0.025), at(0.975)


def bayes_against_z(counts: DataFrame, effects: tuple[float, ...] = (0.0, 0.005, 0.01, 0.02), simulations: int = 200, seed: int = 20260728) -> DataFrame:
    """(n_t, x_t, n_c, x_c, effect, z_power, bayes_power): how often the Z test and P(t > c) > 0.95 find
    effects added to the treated rate; without an effect the counts stand as they are. A row of
    counts and a simulation are one unit of work; each draws from its own generator."""
    from ..functions.special import norm_sf2

    cols = ["n_t", "x_t", "n_c", "x_c"]

    def run(it):
        for pdf in it:
            rows = []
            for r in pdf.itertuples():
                rng = np.random.default_rng(seed + int(r.sim))
                for e in effects:
                    x = int(rng.binomial(r.n_t, r.x_t / r.n_t + e)) if e > 0 else int(r.x_t)
                    pool = (x + r.x_c) / (r.n_t + r.n_c)
                    se = (pool * (1 - pool) * (1 / r.n_t + 1 / r.n_c)) ** 0.5
                    z = (x / r.n_t - r.x_c / r.n_c) / se if se > 0 else 0.0
                    better = _prob_better(1.0 + x, 1.0 + r.n_t - x, 1.0 + r.x_c, 1.0 + r.n_c - r.x_c, 200)
                    rows.append([r.n_t, r.x_t, r.n_c, r.x_c, e, float(norm_sf2(z) < 0.05), float(better > 0.95)])
            yield pd.DataFrame(rows, columns=[*cols, "effect", "z", "b"])

    each = counts.select(*cols, F.explode(F.sequence(F.lit(0), F.lit(simulations - 1))).alias("sim")).repartition(32, "sim")
    return each.mapInPandas(run, "n_t long, x_t long, n_c long, x_c long, effect double, z double, b double").groupBy(*cols, "effect").agg(F.avg("z").alias("z_power"), F.avg("b").alias("bayes_power"))


def _prob_better(at: float, bt: float, ac: float, bc: float, panels: int) -> float:
    """P(T > C) of two beta variables: the integral of the density of T times the distribution of C."""
    import math

    from ..functions.special import beta_i

    mean, sd = at / (at + bt), math.sqrt(at * bt / ((at + bt) ** 2 * (at + bt + 1)))
    lo, hi = max(1e-12, mean - 9 * sd), min(1 - 1e-12, mean + 9 * sd)
    x = np.linspace(lo, hi, panels + 1)
    log = (at - 1) * np.log(x) + (bt - 1) * np.log1p(-x) - (math.lgamma(at) + math.lgamma(bt) - math.lgamma(at + bt))
    cdf = np.array([beta_i(ac, bc, v) for v in x])
    w = np.ones(panels + 1)
    w[1:-1:2], w[2:-1:2] = 4, 2
    density = np.exp(log)
    return float((w * density * cdf).sum() / (w * density).sum())
