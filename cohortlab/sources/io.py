"""Sources and sinks: CSV users and transactions with their cleaning, synthetic tables, reports."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.murmur import uniform
from ..operators.frames import percentiles
from ..operators.simulate import normal

USERS = "user_id STRING, age INT, credit_score INT, yearly_income STRING, total_debt STRING"
TRANSACTIONS = "client_id STRING, date STRING, amount STRING, use_chip STRING, merchant_id STRING, merchant_city STRING, merchant_state STRING"


def money(c: Column) -> Column:
    """A price like $1,234.56 as a number; what is none becomes null."""
    return F.translate(c.cast("string"), "$,", "").try_cast("double")


def load_users(spark: SparkSession, path: str, schema: str = USERS) -> DataFrame:
    df = spark.read.schema(schema).csv(path, header=True)
    return df.withColumns({c: money(F.col(c)) for c in ("yearly_income", "total_debt", "per_capita_income") if c in df.columns})


def clean_transactions(df: DataFrame) -> DataFrame:
    """Amounts without sign, dates that parse; rows that lack either go."""
    return df.withColumns({"amount": F.abs(money(F.col("amount"))), "date": F.try_to_timestamp(F.col("date"))}).dropna(subset=["client_id", "amount", "date"])


def load_transactions(spark: SparkSession, path: str, schema: str = TRANSACTIONS) -> DataFrame:
    return clean_transactions(spark.read.schema(schema).csv(path, header=True))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_report(text: str, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def synthetic_users(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    s = F.lit(seed)
    return spark.range(n).select(
        F.format_string("u_%06d", "id").alias("user_id"), (18 + F.floor(uniform(s, F.lit("age"), "id") * 62)).cast("int").alias("age"),
        F.least(F.lit(850), F.greatest(F.lit(300), F.round(680 + 80 * normal(s, F.lit("score"), "id")))).cast("int").alias("credit_score"),
        F.round(F.exp(10.6 + 0.5 * normal(s, F.lit("income"), "id")), 2).alias("yearly_income"), F.round(F.exp(9.5 + normal(s, F.lit("debt"), "id")), 2).alias("total_debt"),
    )


def synthetic_transactions(spark: SparkSession, users: int, each: int = 20, seed: int = 42) -> DataFrame:
    s = F.lit(seed)
    grid = spark.range(users * each).select(F.floor(F.col("id") / each).alias("u"), (F.col("id") % each).alias("k"))
    return grid.select(F.format_string("u_%06d", "u").alias("client_id"), F.expr("timestamp'2024-01-01'") + F.make_dt_interval(F.floor(uniform(s, F.lit("day"), "u", "k") * 365).cast("int")), F.round(F.exp(3 + normal(s, F.lit("amount"), "u", "k")), 2).alias("amount"), F.format_string("m_%03d", F.floor(uniform(s, F.lit("shop"), "u", "k") * 100).cast("int")).alias("merchant_id")).toDF("client_id", "date", "amount", "merchant_id")


def synthetic_experiment(spark: SparkSession, n: int, base: float = 0.1, effect: float = 0.01, spread: float = 0.05, seed: int = 42) -> DataFrame:
    """assigned, pre_rate, post_rate and their conversions; treated rows get the effect and noise."""
    s = F.lit(seed)
    d = spark.range(n).select(F.col("id").alias("user_id"), (uniform(s, F.lit("arm"), "id") < 0.5).cast("int").alias("assigned"), F.greatest(F.lit(0.001), F.least(F.lit(0.999), base + spread * normal(s, F.lit("rate"), "id"))).alias("pre_rate"), normal(s, F.lit("noise"), "id").alias("_e"))
    d = d.withColumn("post_rate", F.when(F.col("assigned") == 1, F.greatest(F.lit(0.001), F.least(F.lit(0.999), F.col("pre_rate") + effect + 0.01 * F.col("_e")))).otherwise(F.col("pre_rate")))
    return d.drop("_e").withColumns({"converted_pre": (uniform(s, F.lit("pre"), "user_id") < F.col("pre_rate")).cast("int"), "converted_post": (uniform(s, F.lit("post"), "user_id") < F.col("post_rate")).cast("int")})


def ramp_series(spark: SparkSession, days: int = 14, base: float = 0.1, lift: float = 0.02, decay: float = 0.005, traffic: int = 10_000, seed: int = 42) -> DataFrame:
    """Daily conversion of both arms, binomial draws of the day's traffic; novelty = decay * max(0, 7 - day) wears off in a week."""

    def draw(it):
        for pdf in it:
            rows = []
            for day in pdf["id"]:
                rng, novelty = np.random.default_rng([seed, int(day)]), decay * max(0, 7 - int(day))
                c, t = (rng.binomial(traffic, min(1.0, max(0.0, p))) / traffic for p in (base, base + lift + novelty))
                rows.append([int(day), novelty, lift + novelty, c, t, t - c])
            yield pd.DataFrame(rows, columns=["day", "novelty", "true_lift", "control_conversion", "treatment_conversion", "lift"])

    return spark.range(days).mapInPandas(draw, "day long, novelty double, true_lift double, control_conversion double, treatment_conversion double, lift double")


def split_sample(spark: SparkSession, n: int = 5000, seed: int = 20260728) -> DataFrame:
    """(user_id, hash_group, snake_group, prebucket_group, calibration_group): a sample of made-up users
    under four splits, drawn in order by one task (n rows)."""
    from ..functions.murmur import murmur32

    def draw(it):
        for _ in it:
            ids, rng, i = [f"u_{k:06d}" for k in range(n)], np.random.default_rng(seed), np.arange(n)
            pre = rng.permutation(np.minimum(i // max(1, n // 10), 9))
            base, count, calibrated = murmur32([f"{u}_cal_001" for u in ids]) % 10, [0] * 10, []
            for b in base:
                g = count.index(min(count)) if rng.random() < 0.7 else int(b)
                count[g] += 1
                calibrated.append(g)
            yield pd.DataFrame({"user_id": ids, "hash_group": murmur32([f"{u}_exp_001" for u in ids]) % 1000 % 10, "snake_group": i % 10, "prebucket_group": pre, "calibration_group": calibrated})

    return spark.range(1, numPartitions=1).mapInPandas(draw, "user_id string, hash_group long, snake_group long, prebucket_group long, calibration_group long")


def synthetic_seasonal(spark: SparkSession, n: int = 4000, lift: float = 0.05, seed: int = 42) -> DataFrame:
    """(user_id, assigned, pre, post, weekday, weekend): a metric that weekend users raise, and treated ones by `lift`."""
    s = F.lit(seed)
    d = spark.range(n).select(F.col("id").alias("user_id"), (uniform(s, F.lit("arm"), "id") < 0.5).cast("int").alias("assigned"), (uniform(s, F.lit("weekend"), "id") < 0.5).cast("double").alias("weekend"), (50 + 5 * normal(s, F.lit("user"), "id")).alias("_base"))
    d = d.withColumns({"pre": F.col("_base") + 5 * normal(s, F.lit("pre"), "user_id"), "post": F.col("_base") + 5 * F.col("weekend") + 5 * normal(s, F.lit("post"), "user_id"), "weekday": 1 - F.col("weekend")})
    return d.withColumn("post", F.when(F.col("assigned") == 1, F.col("post") * (1 + lift)).otherwise(F.col("post"))).drop("_base")


def user_consumption(tx: DataFrame, client: str = "client_id", at: str = "date", amount: str = "amount", quantile: float = 0.7) -> DataFrame:
    """Per client the mean, count and sum before and after the exact time quantile, and monthly
    values; clients with rows on both sides. One pass over the rows after the split point."""
    tx = tx.withColumn(at, F.col(at).cast("timestamp"))
    micros = tx.select(F.unix_micros(at).alias("m"))
    cut = percentiles(micros, "m", {"s": quantile}).select(F.col("s").cast("long").alias("s")).join(micros.agg(F.min("m").alias("lo"), F.max("m").alias("hi")))
    t = tx.join(F.broadcast(cut)).withColumn("_pre", F.unix_micros(at) < F.col("s"))  # one row
    agg = []
    for name, cond in (("pre", F.col("_pre")), ("post", ~F.col("_pre"))):
        agg += [F.avg(F.when(cond, F.col(amount))).alias(f"{name}_avg"), F.count(F.when(cond, F.col(amount))).alias(f"{name}_count"), F.sum(F.when(cond, F.col(amount))).alias(f"{name}_total")]
    g = t.groupBy(client, "s", "lo", "hi").agg(*agg).filter("pre_count > 0 and post_count > 0")
    months = lambda a, b: F.greatest(F.floor((F.col(b) - F.col(a)) / 86_400_000_000) / 30, F.lit(1.0))
    return g.withColumns({"pre_monthly": F.col("pre_total") / months("lo", "s"), "post_monthly": F.col("post_total") / months("s", "hi")}).drop("s", "lo", "hi")


def user_history(users: DataFrame, tx: DataFrame, n: int, seed: int = 42, client: str = "client_id", user: str = "user_id", amount: str = "amount", merchant: str = "merchant_id") -> DataFrame:
    """A reproducible sample of users with the sum, count, distinct merchants and maximum of their transactions; 0 where there are none."""
    from ..functions.murmur import murmur

    some = users.withColumn("_h", murmur(user, F.lit(seed))).orderBy("_h", user).limit(n).drop("_h")
    own = tx.join(some.select(F.col(user).alias(client)), client, "left_semi")
    h = own.groupBy(client).agg(F.sum(amount).alias("total_amount"), F.count("*").alias("n_txn"), F.countDistinct(merchant).alias("n_merchants"), F.max(amount).alias("max_amount"))
    return some.join(h.withColumnRenamed(client, user), user, "left").fillna(0, ["total_amount", "n_txn", "n_merchants", "max_amount"])
