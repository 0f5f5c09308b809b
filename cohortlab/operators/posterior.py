"""Conversion posteriors of many experiments: each arm's rate is a beta variable, the arms are independent."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .moments import ratio

#: Terms that are summed at once, unless one row alone needs more.
TERMS = 1 << 21


def prob_better(a_t: np.ndarray, b_t: np.ndarray, a_c: np.ndarray, b_c: np.ndarray) -> np.ndarray:
    """P(X_t > X_c) of independent beta variables with whole positive parameters, elementwise.

    X_t is the a_t-th least of N = a_t + b_t - 1 uniform draws, so X_t > X_c says that fewer than a_t of
    them lie below X_c; that number is beta-binomial(N, a_c, b_c). Its terms follow from one another by
    their ratio and are normed by their own sum, so no gamma function of a large count is taken. The arm
    with fewer draws is the one that is counted, and terms too far from the mean to be seen in a double
    (below 1e-18) are left out, so n users take some 24 * sqrt(n) terms.
    """
    a_t, b_t, a_c, b_c = (np.asarray(v, float) for v in (a_t, b_t, a_c, b_c))
    swap = a_t + b_t > a_c + b_c
    n, cut = np.where(swap, a_c + b_c, a_t + b_t) - 1, np.where(swap, a_c, a_t)
    a, b = np.where(swap, a_t, a_c), np.where(swap, b_t, b_c)
    s = a + b
    mean, sd = n * a / s, np.sqrt(n * (a / s) * (b / s) * (s + n) / (s + 1))
    reach = (12 + 40 / np.sqrt(np.minimum(a, b))) * sd + 200
    low, high = np.maximum(np.floor(mean - reach), 0), np.minimum(np.ceil(mean + reach), n)
    width = (high - low + 1).astype(np.int64)
    out, start, ends = np.empty(len(n)), 0, np.cumsum(width)
    while start < len(n):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + TERMS, side="right")))
        rows = slice(start, stop)
        first = np.concatenate([[0], np.cumsum(width[rows])[:-1]])
        of = lambda v: np.repeat(v[rows], width[rows])  # noqa: B023, E731
        i = np.arange(int(width[rows].sum()), dtype=float) - np.repeat(first, width[rows]) + of(low)
        with np.errstate(divide="ignore"):  # the first term of a row follows from none
            step = np.log((of(n) - i + 1) * (of(a) + i - 1)) - np.log(np.maximum(i, 1) * (of(n) - i + of(b)))
        step[first] = 0.0
        logs = np.cumsum(step)
        w = np.exp(logs - np.repeat(np.maximum.reduceat(logs, first), width[rows]))
        out[rows] = np.add.reduceat(np.where(i < of(cut), w, 0.0), first) / np.add.reduceat(w, first)
        start = stop
    return np.where(swap, 1 - out, out)


@F.pandas_udf(DoubleType())
def p_better(a_t: pd.Series, b_t: pd.Series, a_c: pd.Series, b_c: pd.Series) -> pd.Series:
    rows = pd.DataFrame({"a_t": a_t, "b_t": b_t, "a_c": a_c, "b_c": b_c})
    known = rows.notna().all(axis=1) & (rows > 0).all(axis=1)
    out = pd.Series(np.nan, index=rows.index)
    out[known] = prob_better(*(rows.loc[known, c].to_numpy() for c in rows)) if known.any() else []
    return out.where(known, None)


def reading(p: Column) -> Column:
    return F.when(p > 0.95, "strong_win").when(p > 0.85, "likely_win").when(p > 0.6, "lean_win").when(p > 0.4, "no_difference").when(p.isNotNull(), "lean_loss")


def posteriors(counts: DataFrame, a: int = 1, b: int = 1) -> DataFrame:
    """counts: (keys, n_t, x_t, n_c, x_c), a row an experiment. Adds posterior means, lifts, P(t > c) and its
    reading, and the rate that is lost in expectation by choosing t (loss_t) or c (loss_c).

    a, b: the prior's parameters, whole numbers. An arm without users has its prior. Null counts, or more
    conversions than users, give nulls.
    """
    sound = (F.col("x_t") <= F.col("n_t")) & (F.col("x_c") <= F.col("n_c"))
    par = {s: (F.when(sound, F.col(f"x_{s}") + a).cast("double"), F.when(sound, F.col(f"n_{s}") - F.col(f"x_{s}") + b).cast("double")) for s in "tc"}
    mean = {s: x / (x + y) for s, (x, y) in par.items()}
    one = F.lit(1.0)
    # E max(t - c, 0) = E[t; t > c] - E[c; t > c], and a beta density times its variable is one of the next parameter
    gain = mean["t"] * p_better(par["t"][0] + one, par["t"][1], *par["c"]) - mean["c"] * p_better(*par["t"], par["c"][0] + one, par["c"][1])
    out = counts.withColumns({"mean_t": mean["t"], "mean_c": mean["c"], "abs_lift": mean["t"] - mean["c"], "rel_lift": ratio(mean["t"] - mean["c"], mean["c"]), "prob_better": p_better(*par["t"], *par["c"]), "loss_c": gain})
    out = out.withColumns({"loss_c": F.greatest(F.lit(0.0), "loss_c"), "loss_t": F.greatest(F.lit(0.0), F.col("loss_c") - F.col("abs_lift"))})
    return out.withColumn("reading", reading(F.col("prob_better")))


def conversions(df: DataFrame, keys: list[str], user: str, arm: str, hit: Column) -> DataFrame:
    """(keys, n_t, x_t, n_c, x_c) from events: the users of each key and arm, and those with a hit.

    Users are told apart before they are counted, so the shuffle holds a row a user and key and task at most.
    """
    each = df.filter(F.col(user).isNotNull() & F.col(arm).isin(0, 1)).groupBy(*keys, user, arm).agg(F.max(F.coalesce(hit, F.lit(False)).cast("int")).alias("_hit"))
    own = lambda code, c: F.coalesce(F.sum(F.when(F.col(arm) == code, c)), F.lit(0))
    return each.groupBy(*keys).agg(*[own(code, c).cast("long").alias(f"{n}_{s}") for code, s in ((1, "t"), (0, "c")) for n, c in (("n", F.lit(1)), ("x", F.col("_hit")))])
