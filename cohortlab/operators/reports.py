"""Reports of many experiments from one pass over the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.special import p_chi2, p_f, p_norm, p_t
from .balance import ACTIONS, mde
from .effects import ARM_CELLS, arm_cells, running_arms
from .frames import cut
from .moments import ratio, welch

#: A row of a report.
ROWS = ("role", "measure", "n_t", "n_c", "effect", "lift_pct", "statistic", "p_value", "verdict")
#: The measure that counts rows.
TRAFFIC = "rows"


def measured_cells(df: DataFrame, experiment: str, arm: str, period: str, measures: dict[str, Column]) -> DataFrame:
    """(experiment, period, measure, ARM_CELLS): one aggregation for all measures; nulls of a measure do not count in it."""
    named = {TRAFFIC: F.lit(1.0), **measures}
    src = df.filter(F.col(arm).isin(0, 1)).select(experiment, period, arm, *[y.cast("double").alias(f"_y{i}") for i, y in enumerate(named.values())])
    parts = [c.alias(f"_{i}_{n}") for i in range(len(named)) for n, c in zip(ARM_CELLS, arm_cells(arm, f"_y{i}"))]
    each = [F.struct(F.lit(name).alias("measure"), *[F.col(f"_{i}_{n}").alias(n) for n in ARM_CELLS]) for i, name in enumerate(named)]
    return src.groupBy(experiment, period).agg(*parts).select(experiment, period, F.inline(F.array(*each)))


def report_rows(df: DataFrame, experiment: str, arm: str, period: str, main: str, metrics: dict[str, tuple[Column, str]], features: dict[str, Column], alpha: float = 0.05) -> DataFrame:
    """(experiment, ROWS) for every experiment of the table; a row of df is a unit that was assigned, its arm 1 (t) or 0 (c).

    metrics: name to (value, binary or continuous), main among them. Roles: traffic (sample ratio; the verdict
    is its level), feature (F test of balance; ok, off), main and secondary (pooled Z or Welch; significant or not),
    power (effect: the smallest detectable one; binary main metric only), stability (effect: mean of the last third
    of the running effects by period, statistic: their trend in per cent, p_value: the stability between 0 and 1),
    advice. The rows are aggregated once by experiment and period; all else reads that table. An experiment with one
    arm only has rows with null tests. Null experiments and periods are left out.
    """
    kinds = {TRAFFIC: "traffic", **{n: k for n, (_, k) in metrics.items()}, **{n: "feature" for n in features}}
    known = df.filter(F.col(experiment).isNotNull() & F.col(period).isNotNull())
    cells = measured_cells(known, experiment, arm, period, {**{n: y for n, (y, _) in metrics.items()}, **features})
    run = cut(running_arms(cells, period, [experiment, "measure"]))
    end = run.groupBy(experiment, "measure").agg(F.max_by(F.struct(*ARM_CELLS), period).alias("_m")).select(experiment, "measure", "_m.*")
    kind = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])[F.col("measure")]
    nt, nc, mt, mc = (F.col(c) for c in ("n_t", "n_c", "mean_t", "mean_c"))
    n = nt + nc
    both = (nt > 0) & (nc > 0)
    pool = ratio(nt * mt + nc * mc, n)
    z = ratio(mt - mc, F.sqrt(pool * (1 - pool) * (ratio(F.lit(1.0), nt) + ratio(F.lit(1.0), nc))))
    some = {s: F.when(F.col(f"n_{s}") > 1, F.col(f"n_{s}")) for s in "tc"}
    t, nu = welch(mt, ratio(F.col("m2_t"), nt - 1), some["t"], mc, ratio(F.col("m2_c"), nc - 1), some["c"])
    between = ratio(ratio(nt * nc, n) * (mt - mc) * (mt - mc), ratio(F.col("m2_t") + F.col("m2_c"), n - 2))
    s = end.withColumn("kind", kind).withColumn("_chi2", ratio((nt - nc) * (nt - nc), n)).withColumns({"_z": F.when(both, F.coalesce(z, F.lit(0.0))), "_t": F.when(both, t), "_nu": nu, "_f": F.when(both, F.coalesce(between, F.lit(0.0))), "_d2": n - 2})
    s = s.withColumns({"_pc": p_chi2("_chi2", F.lit(1.0)), "_pz": p_norm("_z"), "_pt": p_t("_t", "_nu"), "_pf": F.when(F.col("_d2") > 0, p_f("_f", F.lit(1.0), "_d2"))})

    def pick(traffic: Column, feature: Column, binary: Column, continuous: Column) -> Column:
        return F.when(F.col("kind") == "traffic", traffic).when(F.col("kind") == "feature", feature).when(F.col("kind") == "binary", binary).otherwise(continuous)

    p = pick(F.col("_pc"), F.col("_pf"), F.col("_pz"), F.col("_pt"))
    p = F.when(~F.isnan(p), p)
    level = F.when(p < 0.001, "critical").when(p < 0.01, "high").when(p < 0.05, "medium").when(p.isNotNull(), "normal")
    said = F.when(p < alpha, "significant").when(p.isNotNull(), "not significant")
    measured = s.select(
        experiment, F.when(F.col("measure") == main, "main").when(F.col("kind").isin("binary", "continuous"), "secondary").otherwise(F.col("kind")).alias("role"), "measure", nt.cast("long").alias("n_t"), nc.cast("long").alias("n_c"),
        F.when(both & (F.col("kind") != "traffic"), mt - mc).alias("effect"), F.when(both & (F.col("kind") != "traffic"), ratio(mt - mc, mc) * 100).alias("lift_pct"),
        pick(F.col("_chi2"), F.col("_f"), F.col("_z"), F.col("_t")).alias("statistic"), p.alias("p_value"), pick(level, F.when(p > alpha, "ok").when(p.isNotNull(), "off"), said, said).alias("verdict"), mc.alias("_rate"),
    )
    steady = _steady(run, experiment, period, main)
    m = measured.filter(F.col("role") == "main")
    rows = measured.drop("_rate").unionByName(steady.select(experiment, *ROWS))
    binary = metrics[main][1] == "binary"
    least = F.when((F.col("_rate") > 0) & (F.col("_rate") < 1), mde(F.least("n_t", "n_c").cast("double"), F.col("_rate"))) if binary else F.lit(None).cast("double")
    power = m.select(experiment, "measure", "n_t", "n_c", "effect", "verdict", least.alias("_least"))
    if binary:
        enough = F.when(F.abs("effect") > F.col("_least"), "enough").when(F.col("_least").isNotNull() & F.col("effect").isNotNull(), "not enough")
        rows = rows.unionByName(power.select(experiment, F.lit("power").alias("role"), "measure", "n_t", "n_c", F.col("_least").alias("effect"), *[F.lit(None).cast("double").alias(c) for c in ("lift_pct", "statistic", "p_value")], enough.alias("verdict")))
    ratio_ = measured.filter(F.col("role") == "traffic").select(F.col(experiment).alias("_e"), F.col("verdict").alias("_level"))
    score = steady.select(F.col(experiment).alias("_s"), F.coalesce("p_value", F.lit(0.0)).alias("_score"))
    joined = power.join(ratio_, F.col(experiment) == F.col("_e")).join(score, F.col(experiment) == F.col("_s"))  # a row an experiment
    advice = (
        F.when(~F.col("_level").eqNullSafe("normal"), F.concat(F.lit("sample ratio: "), F.coalesce(*[F.when(F.col("_level") == k, v) for k, v in ACTIONS.items()], F.lit("one arm only"))))
        .when((F.col("verdict") == "significant") & (F.col("effect") < 0), "stop: harmful").when((F.col("verdict") == "significant") & (F.col("_score") > 0.6), "ship").when(F.col("verdict") == "significant", "keep running: unstable")
        .when(F.abs("effect") > F.col("_least") / 2, "extend").when(F.col("_least").isNotNull(), "stop: far below what can be detected").otherwise("decide by other reasons")
    )
    return rows.unionByName(joined.select(experiment, F.lit("advice").alias("role"), "measure", "n_t", "n_c", *[F.lit(None).cast("double").alias(c) for c in ("effect", "lift_pct", "statistic", "p_value")], advice.alias("verdict")))


def _steady(run: DataFrame, experiment: str, period: str, main: str) -> DataFrame:
    """The stability row of each experiment, from its running effects, an array of one number a period."""
    e = F.when((F.col("n_t") > 0) & (F.col("n_c") > 0), F.col("mean_t") - F.col("mean_c"))
    one = run.filter(F.col("measure") == main).groupBy(experiment).agg(F.array_sort(F.collect_list(F.when(e.isNotNull(), F.struct(period, e.alias("e"))))).alias("_c"), F.max("n_t").alias("n_t"), F.max("n_c").alias("n_c"), F.stddev_pop(e).alias("_sd"))
    one = one.withColumn("_e", F.transform("_c", lambda x: x["e"])).withColumn("_k", F.size("_c")).withColumn("_third", F.floor(F.col("_k") / 3).cast("int"))
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.col("_third")
    ok = F.col("_third") > 0
    one = one.withColumns({"_early": F.when(ok, mean(F.slice("_e", 1, F.greatest("_third", F.lit(1))))), "_late": F.when(ok, mean(F.slice("_e", F.greatest(F.col("_k") - F.col("_third") + 1, F.lit(1)), F.greatest("_third", F.lit(1)))))})
    trend = ratio(F.col("_late") - F.col("_early"), F.abs("_early")) * 100
    last = F.abs(F.get("_e", F.col("_k") - 1))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("_sd") / F.when(last == 0, 1.0).otherwise(last)))
    return one.select(experiment, F.lit("stability").alias("role"), F.lit(main).alias("measure"), F.col("n_t").cast("long").alias("n_t"), F.col("n_c").cast("long").alias("n_c"), F.col("_late").alias("effect"), F.lit(None).cast("double").alias("lift_pct"), trend.alias("statistic"), F.when(ok, score).alias("p_value"), F.when(~ok, "too few periods").when(trend > 20, "up").when(trend < -20, "down").otherwise("stable").alias("verdict"))


def render(rows: DataFrame, experiment: str) -> DataFrame:
    """(experiment, text): the rows of each experiment as a Markdown table, made where the rows are."""
    order = F.array_position(F.array(*[F.lit(x) for x in ("traffic", "feature", "main", "secondary", "power", "stability", "advice")]), F.col("role"))
    shown = lambda c: F.coalesce(F.format_number(c, 4), F.lit(""))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", "role", "measure", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("n_t", "n_c")], *[shown(c) for c in ("effect", "lift_pct", "statistic", "p_value")], F.coalesce("verdict", F.lit("n/a"))), F.lit(" |"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), "measure", line.alias("line")))), lambda x: x["line"])
    head = F.concat(F.lit("# "), F.col(experiment).cast("string"), F.lit("\n\n| " + " | ".join(ROWS) + " |\n|" + "---|" * len(ROWS) + "\n"))
    return rows.groupBy(experiment).agg(lines.alias("_l")).select(experiment, F.concat(head, F.array_join("_l", "\n")).alias("text"))
