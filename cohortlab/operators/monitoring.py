"""Ramp-up monitoring, decisions between fixed tests and bandits, and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from .moments import ratio

#: Stage, traffic in per cent and days of the ramp-up plan.
STAGES = [("fixed test", 5, 7), ("ramp 1%", 1, 2), ("ramp 10%", 10, 3), ("ramp 25%", 25, 3), ("ramp 50%", 50, 3), ("ramp 100%", 100, 1), ("follow 7d", 100, 7), ("follow 30d", 100, 30), ("follow 90d", 100, 90)]
#: Fixed values: (fixed test, bandit) scores of each answer.
SCORES = {
    "decision_criticality": {"low": (5, 8), "medium": (7, 6), "high": (10, 1)},
    "duration": {"short": (10, 2), "medium": (8, 5), "long": (5, 8), "permanent": (2, 10)},
    "population_stability": {"stable": (9, 5), "shifting": (4, 9), "unknown": (6, 6)},
    "explainability": {"high": (10, 2), "medium": (7, 5), "low": (3, 9)},
    "rollback": {"yes": (6, 9), "limited": (8, 5), "no": (10, 1)},
}
#: Users an arm from which the scores hold.
TRAFFIC = [(0, 10, 0), (100, 8, 3), (1_000, 7, 6), (10_000, 6, 8), (100_000, 5, 9)]
MARGIN = 15


def ramp_stages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(STAGES, "stage string, traffic_pct int, days int")


def anomalies(daily: DataFrame, metric: str, day: str = "day", window: int = 3, sigma: float = 2.0, keys: list[str] = ()) -> DataFrame:
    """Days whose metric is more than sigma standard deviations from the mean of the `window` days before."""
    w = Window.partitionBy(*keys).orderBy(day).rowsBetween(-window, -1)
    full = F.count(metric).over(w) >= window
    out = daily.withColumn("base_mean", F.when(full, F.avg(metric).over(w))).withColumn("base_std", F.when(full, F.stddev_samp(metric).over(w)))
    out = out.withColumn("z", ratio(F.col(metric) - F.col("base_mean"), F.col("base_std")))
    return out.withColumn("anomaly", F.coalesce(F.abs("z") > sigma, F.lit(False)))


def rampup_decision(daily: DataFrame, current_pct: float, target_pct: float = 100.0, day: str = "day", treat: str = "treatment_conversion", ctrl: str = "control_conversion", rollback_gap: float = 0.02) -> DataFrame:
    """continue, pause or rollback from a daily series, and the next share of traffic; one row."""
    last, first = F.row_number().over(Window.orderBy(F.desc(day))), F.row_number().over(Window.orderBy(day))  # a row a day
    d = daily.withColumn("_l", last).withColumn("_f", first).withColumn("_lift", F.col(treat) - F.col(ctrl))
    own = lambda c, n: F.avg(F.when(c <= n, F.col("_lift")))
    s = d.agg(F.count("*").alias("days"), own(F.col("_l"), 3).alias("recent_lift"), own(F.col("_f"), 7).alias("baseline_lift"), F.avg(F.when(F.col("_l") <= 3, F.col(treat))).alias("recent_t"), F.avg(F.when(F.col("_l") <= 3, F.col(ctrl))).alias("recent_c"))
    act = F.when(F.col("days") < 3, "continue").when((F.col("recent_lift") < F.col("baseline_lift") * 0.5) & (F.lit(current_pct) > 5), "pause").when(F.col("recent_t") < F.col("recent_c") - rollback_gap, "rollback").otherwise("continue")
    out = s.withColumn("action", act)
    nxt = F.when(F.col("action") == "rollback", F.lit(0.0)).when((F.col("action") == "pause") | (F.col("days") < 3), F.lit(float(current_pct))).otherwise(F.lit(float(min(2 * current_pct, target_pct))))
    return out.select("days", "recent_lift", "baseline_lift", "action", nxt.alias("next_pct"))


def traffic_scores(n: Column) -> tuple[Column, Column]:
    ab, mab = F.lit(TRAFFIC[0][1]), F.lit(TRAFFIC[0][2])
    for cut, a, m in TRAFFIC[1:]:
        ab, mab = F.when(n >= cut, a).otherwise(ab), F.when(n >= cut, m).otherwise(mab)
    return ab, mab


def choose_method(scenarios: DataFrame) -> DataFrame:
    """Adds ab_score, mab_score, their shares and the recommendation. An answer that is not known raises."""
    ab, mab = traffic_scores(F.col("n_users_per_arm"))
    for name, answers in SCORES.items():
        for side in (0, 1):
            value = F.raise_error(F.concat(F.lit(f"unknown {name}: "), F.coalesce(F.col(name), F.lit("null")))).cast("int")
            for answer, pair in answers.items():
                value = F.when(F.col(name) == answer, F.lit(pair[side])).otherwise(value)
            ab, mab = (ab + value, mab) if side == 0 else (ab, mab + value)
    out = scenarios.withColumns({"ab_score": ab, "mab_score": mab})
    d, total = F.col("ab_score") - F.col("mab_score"), F.col("ab_score") + F.col("mab_score")
    said = F.when(d >= MARGIN, "strong_ab").when(d <= -MARGIN, "strong_mab").otherwise("either")
    return out.withColumns({"ab_pct": ratio(F.col("ab_score"), total) * 100, "mab_pct": ratio(F.col("mab_score"), total) * 100, "recommendation": said})


def choose_by_rules(scenarios: DataFrame) -> DataFrame:
    """Adds the first rule that holds: what forces a fixed test comes first, then what suits a bandit."""
    said = (
        F.when(F.col("n_users") < 1000, "ab_low_traffic").when(F.col("importance") == "high", "ab_important").when(F.col("duration_days") < 30, "ab_short")
        .when(~F.col("rollback"), "ab_no_rollback").when(F.col("interpretable"), "ab_interpretable")
        .when((F.col("n_users") > 100_000) & (F.col("duration_days") > 90) & (F.col("audience") == "shifting"), "mab_adaptive").when(F.col("duration_days") > 90, "mab_long").otherwise("either")
    )
    return scenarios.withColumn("recommendation", said)


def markdown_report(title: str, sections: dict[str, list[tuple[str, object]]]) -> str:
    """A report of a few collected scalars."""
    lines = [f"# {title}", ""]
    for head, rows in sections.items():
        lines += [f"## {head}", "", "| item | value |", "|---|---|"]
        lines += [f"| {k} | {'n/a' if v is None else f'{v:.4f}' if isinstance(v, float) else v} |" for k, v in rows]
        lines.append("")
    return "\n".join(lines)


def two_arm_test(df: DataFrame, arm: str, y: str, y_type: str) -> Row:
    """One row of the Z test (binary) or Welch's (continuous)."""
    from .effects import continuous_test, conversion_test
    from .moments import arms

    if y_type == "binary":
        m = arms(df.withColumn("_y", F.col(y).cast("double")), arm, ["_y"]).select("n_t", F.col("sum__y_t").alias("x_t"), "n_c", F.col("sum__y_c").alias("x_c"))
        return conversion_test(m).first()
    return continuous_test(df, arm, y).first()


def advice_for(balanced: bool, significant: bool, effect: float, score: float, mde: float | None) -> str:
    """What to do, from the checks in their order of weight."""
    if not balanced:
        return "stop at once: the sample ratio is off, no result can be trusted"
    if significant:
        return ("ship to all users" if effect > 0 else "harmful: stop") if score > 0.6 else "significant but unstable: keep running"
    if mde is None:
        return "no detectable effect: decide by other reasons"
    return "extend by one or two weeks: the effect is over half of what can be detected" if abs(effect) > mde / 2 else "stop: the effect is far below what can be detected"


def experiment_report(df: DataFrame, arm: str, y: str, features: list[str], order: list[str], y_type: str = "binary", title: str = "Experiment report", secondary: dict[str, str] | None = None, identity: tuple[str, str, str, str] | None = None) -> str:
    """The whole validation of an experiment: identity, sample ratio with its level and action, balance
    of features, main and secondary metrics (name to binary or continuous), stability, smallest
    detectable effect, status of each part, advice. Only single rows and a row a feature are collected."""
    from .balance import ACTIONS, anova, mde, srm
    from .effects import stability

    sizes = df.groupBy(F.col(arm).cast("int").alias("group_id")).agg(F.count("*").alias("n"))
    ratio_row = srm(sizes).first()
    balance = anova(df, arm, features).orderBy("feature").collect() if features else []
    effect = two_arm_test(df, arm, y, y_type)
    others = [(name, two_arm_test(df, arm, name, kind)) for name, kind in (secondary or {}).items()]
    steady = stability(df, arm, y, order).first()
    least = None
    if y_type == "binary" and effect["n_t"] and 0 < (effect["rate_c"] or 0) < 1:
        least = df.sparkSession.range(1).select(mde(F.lit(float(min(effect["n_t"], effect["n_c"]))), effect["rate_c"]).alias("m")).first()["m"]
    ok, sig = bool(ratio_row and ratio_row["passed"]), bool(effect["significant"])
    score = (steady["stability"] if steady else None) or 0.0
    passed = sum(bool(r["passed"]) for r in balance)
    enough = "n/a" if least is None else "enough" if abs(effect["diff"] or 0) > least else "not enough"
    return markdown_report(title, {
        "Experiment": list(zip(("id", "name", "start", "end"), identity or ("n/a",) * 4)),
        "Sample ratio": [(f"group {r['group_id']}", r["n"]) for r in sizes.orderBy("group_id").collect()] + [("chi2", ratio_row["chi2"]), ("p", ratio_row["p_value"]), ("level", ratio_row["level"]), ("action", ACTIONS[ratio_row["level"]])],
        "Balance": [(r["feature"], f"F {r['f_stat']:.4f}, p {r['p_value']:.4f}, largest deviation {r['max_diff_pct']:.4f} %") for r in balance],
        "Main metric": [(k, effect[k]) for k in ("diff", "lift_pct", "ci_low", "ci_high", "p_value", "significant", "cohens_h" if y_type == "binary" else "cohens_d")],
        "Secondary metrics": [(name, f"diff {x['diff']:.4f}, p {x['p_value']:.4f}, {'significant' if x['significant'] else 'not significant'}") for name, x in others] or [("none", "n/a")],
        "Stability": [(k, steady[k] if steady else None) for k in ("status", "early", "late", "stability", "trend_pct", "direction")],
        "Smallest detectable effect": [("mde", least), ("effect found", effect["diff"]), ("power", enough)],
        "Status": [("traffic", "healthy" if ok else ratio_row["level"]), ("features", f"{passed} of {len(balance)} passed"), ("significance", "significant" if sig else "not significant"), ("stability", "stable" if score > 0.6 else "to be watched")],
        "Advice": [("advice", advice_for(ok, sig, effect["diff"] or 0.0, score, least))],
    })
