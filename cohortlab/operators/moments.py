"""The moments core: one aggregation pass that feeds the tests and estimators."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.murmur import Prefixed


def moments(df: DataFrame, keys: list[str], cols: Iterable[str], pairs: Iterable[tuple[str, str]] = ()) -> DataFrame:
    """Per key: n, and for each column n_, mean_, var_ (sample), vpop_ and sum_; for each pair cov_ (sample)."""
    out = [F.count("*").alias("n")]
    for c in cols:
        out += [F.count(c).alias(f"n_{c}"), F.avg(c).alias(f"mean_{c}"), F.var_samp(c).alias(f"var_{c}"), F.var_pop(c).alias(f"vpop_{c}"), F.sum(c).alias(f"sum_{c}")]
    out += [F.covar_samp(a, b).alias(f"cov_{a}_{b}") for a, b in pairs]
    return df.groupBy(*keys).agg(*out)


def arms(df: DataFrame, arm: str, cols: list[str], pairs: list[tuple[str, str]] = (), keys: list[str] = ()) -> DataFrame:
    """Moments of both arms on one row: names get the suffix _t (arm 1) or _c (arm 0). One pass, no join."""
    aggs = []
    for code, s in ((1, "t"), (0, "c")):
        own = lambda c, code=code: F.when(F.col(arm) == code, F.col(c))
        aggs.append(F.count(F.when(F.col(arm) == code, 1)).alias(f"n_{s}"))
        for c in cols:
            aggs += [F.avg(own(c)).alias(f"mean_{c}_{s}"), F.var_samp(own(c)).alias(f"var_{c}_{s}"), F.var_pop(own(c)).alias(f"vpop_{c}_{s}"), F.sum(own(c)).alias(f"sum_{c}_{s}")]
        aggs += [F.covar_samp(own(a), own(b)).alias(f"cov_{a}_{b}_{s}") for a, b in pairs]
    for c in cols:
        aggs += [F.avg(c).alias(f"mean_{c}"), F.var_samp(c).alias(f"var_{c}"), F.var_pop(c).alias(f"vpop_{c}")]
    aggs += [F.covar_samp(a, b).alias(f"cov_{a}_{b}") for a, b in pairs]
    src = df.filter(F.col(arm).isin(0, 1))
    return src.groupBy(*keys).agg(*aggs) if keys else src.agg(*aggs)


def split_arms(users: DataFrame, user: str, tag: str, trials: int, cols: list[str]) -> DataFrame:
    """(trial, moments): for each trial the moments that arms() gives of cols and of the pairs (later, earlier),
    each user's arm being 1 where the hash of tag_trial_user is in its lower half.

    No row a user and trial is made: a task hashes its users under every trial's prefix and sums counts and
    (co)moments about the columns' means by arm; the sums are a row a task and trial. Users with a null value are left out.
    """
    rows = users.select(F.col(user).cast("string").alias("u"), *[F.col(c).cast("double").alias(c) for c in cols]).dropna()
    # equal values are their own mean to the last digit
    centre = rows.agg(*[F.when(F.min(c) == F.max(c), F.min(c)).otherwise(F.avg(c)).alias(f"_m_{c}") for c in cols])
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[: i + 1]]
    names = ["n", *[f"s_{c}" for c in cols], *[f"q_{a}_{b}" for a, b in pairs]]

    def summed(it):
        total = None
        for pdf in it:
            for i in range(0, len(pdf), 4096):
                one = pdf.iloc[i : i + 4096]
                v = {c: (one[c] - one[f"_m_{c}"]).to_numpy() for c in cols}
                v = np.column_stack([np.ones(len(one)), *v.values(), *[v[a] * v[b] for a, b in pairs]])
                keys = Prefixed(one["u"].tolist())
                chosen = np.array([(keys.hashes(f"{tag}_{t}_".encode()) < np.uint32(1 << 31)).astype(float) @ v for t in range(trials)])
                both = np.hstack([chosen, v.sum(axis=0) - chosen])
                total = both if total is None else total + both
        if total is not None:
            yield pd.DataFrame(total, columns=[f"{n}_{s}" for s in "tc" for n in names]).assign(trial=np.arange(trials, dtype=np.int32))

    sums = [f"{n}_{s}" for s in "tc" for n in names]
    dealt = rows.repartition(int(users.sparkSession.conf.get("spark.sql.shuffle.partitions")), "u").join(F.broadcast(centre))  # one row
    m = dealt.mapInPandas(summed, ", ".join(f"{c} double" for c in sums) + ", trial int").groupBy("trial").agg(*[F.sum(c).alias(c) for c in sums])
    m = m.join(F.broadcast(centre))  # one row
    at, out = F.col, [F.col("n_t").cast("long").alias("n_t"), F.col("n_c").cast("long").alias("n_c")]
    n = at("n_t") + at("n_c")
    for a, b in pairs:
        own = {s: at(f"q_{a}_{b}_{s}") - ratio(at(f"s_{a}_{s}") * at(f"s_{b}_{s}"), at(f"n_{s}")) for s in "tc"}
        own["all"] = at(f"q_{a}_{b}_t") + at(f"q_{a}_{b}_c") - ratio((at(f"s_{a}_t") + at(f"s_{a}_c")) * (at(f"s_{b}_t") + at(f"s_{b}_c")), n)
        for s, q in own.items():
            size, end = (n, "") if s == "all" else (at(f"n_{s}"), f"_{s}")
            if a != b:
                out.append(ratio(q, size - 1).alias(f"cov_{a}_{b}{end}"))
            else:
                q = F.greatest(q, F.lit(0.0))
                mean = at(f"_m_{a}") + ratio(at(f"s_{a}_t") + at(f"s_{a}_c") if s == "all" else at(f"s_{a}_{s}"), size)
                out += [mean.alias(f"mean_{a}{end}"), ratio(q, size - 1).alias(f"var_{a}{end}"), ratio(q, size).alias(f"vpop_{a}{end}")]
    return m.select("trial", *out)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a, b)


def welch(mt: Column, vt: Column, nt: Column, mc: Column, vc: Column, nc: Column) -> tuple[Column, Column]:
    """Welch's t and its degrees of freedom."""
    a, b = vt / nt, vc / nc
    return ratio(mt - mc, F.sqrt(a + b)), ratio((a + b) * (a + b), a * a / (nt - 1) + b * b / (nc - 1))
