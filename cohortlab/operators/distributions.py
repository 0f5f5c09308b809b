"""Kolmogorov-Smirnov distances of a table's columns, without a task that holds a column."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.special import kolmogorov_sf
from .frames import running

#: Up to this product of the arms' sizes the tail is counted exactly.
EXACT = 10_000


def two_sample_tail(h: float, n: int, m: int, exact: int = EXACT) -> float:
    """P(D >= h / (n m)) of two samples of n and m values. h: the largest |i m - j n| met.

    Up to n m = exact the paths from (0, 0) to (n, m) that stay below h are counted (values without ties; with
    ties the true tail is smaller); beyond it is the limit's tail at the effective size n m / (n + m).
    """
    if n * m > exact:
        size = n * m / (n + m)
        return _limit_tail((math.sqrt(size) + 0.12 + 0.11 / math.sqrt(size)) * h / (n * m))
    ways = (np.arange(m + 1) * n < h).astype(float)
    for i in range(1, n + 1):
        inside = np.abs(i * m - np.arange(m + 1) * n) < h
        ways = np.where(inside, np.cumsum(np.where(inside, ways, 0.0)), 0.0)
    return min(1.0, max(0.0, 1 - ways[m] / float(math.comb(n + m, n))))


def _limit_tail(lam: float) -> float:
    return 1.0 if lam < 0.2 else min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * lam * lam) for k in range(1, 101))))


@F.pandas_udf(DoubleType())
def p_two_sample(h: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
    return pd.Series([None if a != a or not b or not c else two_sample_tail(float(a), int(b), int(c)) for a, b, c in zip(h, n, m)], dtype="float64")


@F.pandas_udf(DoubleType())
def p_one_sample(d: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([None if x != x or not k else kolmogorov_sf(float(x), int(k)) for x, k in zip(d, n)], dtype="float64")


def _counted(df: DataFrame, y: str, keys: list[str], counts: dict[str, Column]) -> DataFrame:
    v = F.col(y).cast("double")
    seen = df.withColumn("_v", v + F.lit(0.0)).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    n = seen.groupBy(*keys, "_v").agg(*[c.alias(k) for k, c in counts.items()])
    at = running(n, ["_v"], {f"_before_{k}": F.col(k) for k in counts}, keys)
    return at.withColumns({f"_upto_{k}": F.col(f"_before_{k}") + F.col(k) for k in counts})


def _with_totals(at: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    total = at.groupBy(*keys).agg(*[F.sum(n).alias(f"_all_{n}") for n in names])
    if not keys:
        return at.join(F.broadcast(total))  # one row
    cond = F.lit(True)
    for k in keys:
        total = total.withColumnRenamed(k, f"_t_{k}")
        cond &= F.col(k).eqNullSafe(F.col(f"_t_{k}"))
    return at.join(F.broadcast(total), cond)  # a row a key


def ks_two_sample(df: DataFrame, arm: str, y: str, keys: list[str] = ()) -> DataFrame:
    """(keys, n_t, n_c, d, at_value, p_value): the largest distance of the two arms' empirical distributions of y,
    the least value where it is reached, and its tail.

    Distinct values are counted by arm and summed up by ranges, so the two curves are compared at every value.
    Rows of other arms and null or NaN values do not count; a key with one arm only has nulls,
    and so has the one row of a table without rows, where there are no keys.
    """
    keys = list(keys)
    own = lambda code: F.count(F.when(F.col(arm) == code, 1))
    at = _counted(df.filter(F.col(arm).isin(0, 1)), y, keys, {"_t": own(1), "_c": own(0)})
    at = _with_totals(at, keys, ["_t", "_c"])
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    h = F.abs(wide("_upto__t") * wide("_all__c") - wide("_upto__c") * wide("_all__t"))
    out = at.withColumn("_h", h).groupBy(*keys).agg(F.max("_all__t").alias("n_t"), F.max("_all__c").alias("n_c"), F.max("_h").cast("double").alias("_h"), F.max(F.struct("_h", (-F.col("_v")).alias("_v")))["_v"].alias("_at"))
    both = (F.col("n_t") > 0) & (F.col("n_c") > 0)
    out = out.withColumn("_h", F.when(both, F.col("_h")))
    return out.select(*keys, "n_t", "n_c", (F.col("_h") / (F.col("n_t").cast("double") * F.col("n_c"))).alias("d"), F.when(both, -F.col("_at") + F.lit(0.0)).alias("at_value"), p_two_sample("_h", "n_t", "n_c").alias("p_value"))


def ks_uniform(df: DataFrame, p: str, keys: list[str] = ()) -> DataFrame:
    """(keys, n, d, p_value): the distance of p's empirical distribution from the uniform one on 0 to 1."""
    keys = list(keys)
    at = _with_totals(_counted(df, p, keys, {"_n": F.count("*")}), keys, ["_n"])
    n = F.col("_all__n")
    far = F.greatest(F.col("_upto__n") / n - F.col("_v"), F.col("_v") - F.col("_before__n") / n)
    out = at.withColumn("_d", far).groupBy(*keys).agg(F.max("_all__n").alias("n"), F.max("_d").alias("d"))
    return out.withColumn("p_value", p_one_sample("d", "n"))

