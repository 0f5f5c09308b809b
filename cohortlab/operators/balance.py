"""Health checks of an allocation and planning formulas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.murmur import uniform
from ..functions.special import norm_ppf, p_chi2, p_f
from .moments import ratio


def deviation_pct(sizes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Largest deviation of a group's size from the mean, in per cent. sizes: (keys, group_id, n)."""
    g = sizes.groupBy(*(keys or [])).agg(F.avg("n").alias("mean_n"), F.max("n").alias("max_n"), F.min("n").alias("min_n"))
    return g.withColumn("max_dev_pct", ratio(F.greatest(F.col("max_n") - F.col("mean_n"), F.col("mean_n") - F.col("min_n")), F.col("mean_n")) * 100)


def traffic_balance(sizes: DataFrame) -> DataFrame:
    """Deviation, spread and sample-ratio test of (group_id, n) on one row."""
    spread = sizes.agg(F.stddev_pop("n").alias("std_n"))
    test = srm(sizes).select("total", "chi2", "p_value", "passed")
    return deviation_pct(sizes).join(spread).join(test)  # one row each


def hash_diff(sizes: DataFrame) -> DataFrame:
    return sizes.agg(ratio(F.stddev_pop("n"), F.avg("n")).alias("hash_diff"))


def srm(sizes: DataFrame, expected: list[float] | None = None, keys: list[str] | None = None) -> DataFrame:
    """Sample-ratio test of (keys, group_id, n): chi2, df, p and the verdicts of the three conventions.

    verdict: FAIL below .001, WARN below .05; level: critical .001, high .01, medium .05.
    expected: shares by group_id, even if None.
    """
    keys = keys or []
    share = F.lit(1.0) if expected is None else F.get(F.array(*[F.lit(float(e)) for e in expected]), F.col("group_id"))
    s = sizes.withColumn("_w", share)
    g = s.groupBy(*keys).agg(F.sum("n").alias("total"), F.sum("_w").alias("_ws"), F.count("*").alias("_g"), F.sum(F.col("n") * F.col("n") / F.col("_w")).alias("_q"), F.max("n").alias("max_n"), F.min("n").alias("min_n"))
    # sum (o - e)^2 / e = W / N * sum o^2 / w - N
    chi2 = F.when(F.col("total") > 0, F.greatest(F.lit(0.0), F.col("_ws") / F.col("total") * F.col("_q") - F.col("total"))).otherwise(0.0)
    out = g.withColumn("chi2", chi2).withColumn("df", (F.col("_g") - 1).cast("double")).withColumn("p_value", p_chi2("chi2", "df"))
    p = F.col("p_value")
    return out.withColumns({
        "verdict": F.when(p < 0.001, "FAIL").when(p < 0.05, "WARN").otherwise("PASS"), "passed": p > 0.05, "alert": p < 0.01, "warning": (p >= 0.01) & (p < 0.05),
        "level": F.when(p < 0.001, "critical").when(p < 0.01, "high").when(p < 0.05, "medium").otherwise("normal"),
    }).drop("_ws", "_q", "_g")


#: What a level of srm() asks for.
ACTIONS = {"critical": "stop and check the allocation", "high": "review recent changes, consider a pause", "medium": "keep watching, may be chance", "normal": "nothing to do"}


def srm_monitoring(sizes: DataFrame, period: str, groups: int, expected: float | None = None) -> DataFrame:
    """Sample-ratio test of the cumulated sizes at the end of each period, with the largest deviation
    of a group from its expected size (by default an equal share) and the action. sizes: (period, group_id, n).

    Only the table of periods and groups goes through the window.
    """
    grid = sizes.select(period).distinct().withColumn("group_id", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    full = grid.join(sizes.select(period, F.col("group_id").cast("int").alias("group_id"), "n"), [period, "group_id"], "left").fillna(0, ["n"])
    run = full.withColumn("n", F.sum("n").over(Window.partitionBy("group_id").orderBy(period).rowsBetween(Window.unboundedPreceding, 0)))
    test = srm(run, keys=[period])
    each = F.lit(float(expected)) if expected is not None else F.col("total") / groups
    worst = F.greatest(F.col("max_n") - each, each - F.col("min_n")) / each * 100
    action = F.coalesce(*[F.when(F.col("level") == k, v) for k, v in ACTIONS.items()])
    if expected is not None:
        q = run.groupBy(period).agg(F.sum((F.col("n") - each) * (F.col("n") - each) / each).alias("chi2"))
        test = test.drop("chi2", "p_value", "level").join(q, period).withColumn("p_value", p_chi2("chi2", F.lit(float(groups - 1))))
        p = F.col("p_value")
        test = test.withColumn("level", F.when(p < 0.001, "critical").when(p < 0.01, "high").when(p < 0.05, "medium").otherwise("normal"))
    return test.select(period, "total", "max_n", "min_n", "chi2", "p_value", "level", worst.alias("max_group_diff_pct"), action.alias("action"))


def contingency(routed: DataFrame, a: str, b: str) -> DataFrame:
    return routed.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))


def orthogonality(routed: DataFrame, a: str, b: str, keys: list[str] = ()) -> DataFrame:
    """Chi-squared test of independence of two layers (with Yates' correction for two by two), and cell
    deviations; one row, or one a key."""
    keys = list(keys)
    cells = routed.groupBy(*keys, F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    ra, rb = cells.groupBy(*keys, "a").agg(F.sum("n").alias("na")), cells.groupBy(*keys, "b").agg(F.sum("n").alias("nb"))
    one = F.lit(1).alias("_j")
    shape = ra.groupBy(*keys, one).agg(F.count("*").alias("ka"), F.sum("na").alias("total")).join(rb.groupBy(*keys, one).agg(F.count("*").alias("kb")), [*keys, "_j"])
    grid = ra.withColumn("_j", F.lit(1)).join(rb.withColumn("_j", F.lit(1)), [*keys, "_j"]).join(cells, [*keys, "a", "b"], "left").join(shape, [*keys, "_j"])  # groups by groups rows a key
    e = F.col("na") * F.col("nb") / F.col("total")
    d = F.abs(F.coalesce("n", F.lit(0)) - e)
    df = (F.col("ka") - 1) * (F.col("kb") - 1)
    yates = F.when(df == 1, F.greatest(F.lit(0.0), d - F.least(F.lit(0.5), d))).otherwise(d)
    out = grid.select(*keys, df.cast("double").alias("df"), (yates * yates / e).alias("x"), (d / e * 100).alias("dev")).groupBy(*keys, "df").agg(F.sum("x").alias("chi2"), F.max("dev").alias("max_dev_pct"), F.avg("dev").alias("mean_dev_pct"))
    return out.withColumn("p_value", p_chi2("chi2", "df")).withColumn("passed", F.col("p_value") > 0.05)


def traffic_reuse(routed: DataFrame, layers: list[str], possible: int) -> DataFrame:
    """How evenly the combinations of layers are used: ratio of the least to the most used one."""
    combo = routed.groupBy(*layers).agg(F.count("*").alias("n"))
    return combo.agg(F.count("*").alias("combos"), F.sum("n").alias("total"), F.min("n").alias("min_n"), F.max("n").alias("max_n")).withColumn("expected", F.col("total") / possible).withColumn("balance", ratio(F.col("min_n"), F.col("max_n")))


def unpivot(df: DataFrame, ids: list[str], features: list[str]) -> DataFrame:
    have = [c for c in features if c in df.columns]
    stack = ", ".join(f"'{c}', cast(`{c}` as double)" for c in have)
    return df.selectExpr(*ids, f"stack({len(have)}, {stack}) as (feature, value)").filter("value is not null and not isnan(value)")


def anova(df: DataFrame, group: str, features: list[str]) -> DataFrame:
    """One-way analysis of variance of each feature over the groups, in one pass: F, p, largest deviation of a group mean."""
    g = unpivot(df, [group], features).groupBy("feature", group).agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    t = g.groupBy("feature").agg(F.count("*").alias("k"), F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"), F.sum(F.col("n") * F.col("v")).alias("ssw"))
    j = g.select("feature", F.col("n").alias("_n"), "m").join(t, "feature").groupBy("feature", "k", "n", "mean", "ssw").agg(F.sum(F.col("_n") * (F.col("m") - F.col("mean")) * (F.col("m") - F.col("mean"))).alias("ssb"), F.max(F.abs(F.col("m") - F.col("mean"))).alias("_d"))
    d1, d2 = (F.col("k") - 1).cast("double"), (F.col("n") - F.col("k")).cast("double")
    f = F.when(F.col("k") > 1, ratio(F.col("ssb") / d1, F.col("ssw") / d2))
    out = j.withColumn("f_stat", F.coalesce(f, F.lit(0.0))).withColumn("p_value", F.when(f.isNull(), F.lit(1.0)).otherwise(p_f("f_stat", d1, d2)))
    return out.select("feature", "k", "n", "mean", "f_stat", "p_value", (ratio(F.col("_d"), F.abs("mean")) * 100).alias("max_diff_pct"), (F.col("p_value") > 0.05).alias("passed"), (F.col("p_value") < 0.01).alias("alert"))


def mde(n: Column, baseline: float = 0.05, alpha: float = 0.05, power: float = 0.8) -> Column:
    """Smallest absolute effect on a rate that n users a group detect."""
    return F.lit(norm_ppf(1 - alpha / 2) + norm_ppf(power)) * F.sqrt(F.lit(2 * baseline * (1 - baseline)) / n)


def deviation_bound(n: Column, groups: Column, z: float = 1.96) -> Column:
    """Bound in per cent on a group's deviation under pure hashing of n users."""
    return F.lit(z) / F.sqrt(n / groups) * 100


def min_per_group(bias_pct: Column, z: float = 1.96) -> Column:
    return F.ceil(F.pow(F.lit(z) / (bias_pct / 100), 2))


def min_total(bias_pct: Column, groups: Column, z: float = 1.96) -> Column:
    return F.ceil(F.pow(F.lit(z) / (bias_pct / 100), 2) * groups)


def bound_table(spark: SparkSession, ns: tuple[int, ...] = (500, 5_000, 50_000, 500_000), buckets: int = 1000, groups: int = 10) -> DataFrame:
    """Users and spread of a bucket and of a group under pure hashing, and three spreads in per cent."""
    n = spark.createDataFrame([(x,) for x in ns], "n int")
    each = F.col("n") / buckets
    spread = F.sqrt(F.lit(buckets / groups)) * F.sqrt(each)
    return n.select("n", each.alias("per_bucket"), F.sqrt(each).alias("bucket_std"), spread.alias("group_std"), (3 * spread / (F.col("n") / groups) * 100).alias("bound_3sigma_pct"))


def aa_of_groups(routed: DataFrame, groups: int, group: str = "group_id", user: str = "user_id", simulations: int = 5, rate: float = 0.05) -> DataFrame:
    """A dry run of all groups at one conversion rate: F test of the groups' rates over the simulations.

    A user converts in a simulation by a hash; a group without users has the rate 0.
    """
    each = routed.select(F.col(group).cast("int").alias("g"), user, F.explode(F.sequence(F.lit(0), F.lit(simulations - 1))).alias("sim"))
    rates = each.groupBy("sim", "g").agg(F.avg((uniform(F.lit("aa"), "sim", user) < rate).cast("double")).alias("r"))
    grid = routed.sparkSession.range(groups * simulations).select((F.col("id") % groups).cast("int").alias("g"), F.floor(F.col("id") / groups).cast("int").alias("sim"))
    full = grid.join(rates, ["g", "sim"], "left").select("g", F.coalesce("r", F.lit(0.0)).alias("rate"))
    return anova(full, "g", ["rate"]).select("f_stat", "p_value", "passed")


def split_report(routed: DataFrame, groups: int, group: str = "group_id", user: str = "user_id", hash_limit: float = 0.01, rate: float = 0.05) -> DataFrame:
    """(item, value, passed: pass, fail or -): every group's share and deviation, the three checks of a split, the
    smallest detectable effect at the first group's size, and whether all checks pass."""
    sizes = group_sizes_of(routed, groups, group)
    n = F.col("n").cast("double")
    total = F.lit(sizes.agg(F.sum("n")).first()[0]).cast("double")
    share = sizes.select(F.explode(F.array(*[F.struct(F.concat(F.lit(f"group {i} "), F.lit(what)).alias("item"), F.when(F.col("group_id") == i, value).alias("value")) for i in range(groups) for what, value in (("n", n), ("share_pct", n / total * 100), ("deviation_pct", (n - total / groups) / (total / groups) * 100))])).alias("s")).select("s.*").filter("value is not null").withColumn("passed", F.lit(None).cast("boolean"))
    spread = hash_diff(sizes).select(F.lit("hash_diff").alias("item"), F.col("hash_diff").alias("value"), (F.col("hash_diff") < hash_limit).alias("passed"))
    ratio_ = srm(sizes).select(F.lit("srm_p").alias("item"), F.col("p_value").alias("value"), (F.col("verdict") != "FAIL").alias("passed"))
    dry = aa_of_groups(routed, groups, group, user, rate=rate).select(F.lit("aa_p").alias("item"), F.col("p_value").alias("value"), "passed")
    least = sizes.filter("group_id = 0").select(F.lit("mde").alias("item"), mde(n, rate).alias("value"), F.lit(None).cast("boolean").alias("passed"))
    checks = spread.unionByName(ratio_).unionByName(dry)
    every = checks.agg(F.lit("all").alias("item"), F.lit(None).cast("double").alias("value"), F.bool_and("passed").alias("passed"))
    said = F.coalesce(F.when(F.col("passed"), "pass"), F.when(~F.col("passed"), "fail"), F.lit("-"))
    return share.unionByName(checks).unionByName(least).unionByName(every).withColumn("passed", said)


def group_sizes_of(routed: DataFrame, groups: int, group: str) -> DataFrame:
    from .routing import group_sizes

    return group_sizes(routed, groups, group)


def mean_deviation(df: DataFrame, group: str, features: list[str]) -> DataFrame:
    """(feature, max_diff_pct): the largest deviation of a group's mean from the overall mean, in per cent."""
    return anova(df, group, features).select("feature", "max_diff_pct")
