"""Covariance matrices of many columns, their rank, and adjustment by many covariates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.special import p_t

#: Slots of the first of two merges, and the bytes of matrices a task holds before it writes them.
SLOTS, HELD = 1024, 64 << 20
#: Share of a column's variance below which what others leave of it counts as nothing.
NOTHING = 1e-9

Part = tuple[float, np.ndarray, np.ndarray]


def _add(a: Part | None, b: Part) -> Part:
    """Chan's formula for count, means and matrix of squared deviations."""
    if a is None:
        return b
    n, d = a[0] + b[0], b[1] - a[1]
    return n, a[1] + d * (b[0] / n), a[2] + b[2] + np.outer(d, d) * (a[0] * b[0] / n)


def _frame(keys: list[str], parts: dict[tuple, Part], slot: int) -> pd.DataFrame:
    rows = [(*k, slot, float(n), m.tolist(), s.ravel().tolist()) for k, (n, m, s) in parts.items()]
    return pd.DataFrame(rows, columns=[*keys, "_slot", "n", "means", "m2"])


def gram(df: DataFrame, columns: list[str], keys: list[str] = ()) -> DataFrame:
    """(keys, n, means, m2): size, means and the matrix of summed products of deviations (row by row) of the columns.

    A row with a null or NaN in one of the columns is left out whole. A task turns a batch of rows into one
    product of matrices and hands on one matrix a key; they are merged by slot and then by key, so what is
    shuffled does not grow with the rows and no expression grows with the square of the columns.
    """
    keys, p = list(keys), len(columns)
    types = dict(df.dtypes)
    src = df.select(*[F.col(k).cast("string").alias(k) for k in keys], *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(columns)])
    schema = ", ".join([*(f"`{k}` string" for k in keys), "_slot int, n double, means array<double>, m2 array<double>"])
    most = max(1, HELD // (8 * p * p + 1))

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slot, held = TaskContext.get().partitionId() % SLOTS, {}
        for pdf in batches:
            x = pdf[[f"_x{i}" for i in range(p)]].to_numpy(float)
            whole = ~np.isnan(x).any(axis=1)
            x, own = x[whole], pdf.loc[whole, keys].astype(object)
            own = own.where(own.notna(), None).reset_index(drop=True)
            groups = own.groupby(keys, dropna=False, sort=False).indices.items() if keys else [((), slice(None))]
            for k, at in groups:
                if not len(x[at]):
                    continue
                k = tuple(own.loc[at[0], keys]) if keys else ()
                d = x[at] - (mean := x[at].mean(axis=0))
                held[k] = _add(held.get(k), (float(len(d)), mean, d.T @ d))
                if len(held) >= most:
                    yield _frame(keys, held, slot)
                    held.clear()
        yield _frame(keys, held, slot)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        all_: Part | None = None
        for n, m, s in zip(pdf["n"], pdf["means"], pdf["m2"]):
            all_ = _add(all_, (n, np.asarray(m, float), np.asarray(s, float).reshape(p, p)))
        k = tuple(None if pd.isna(v) else v for v in pdf.iloc[0][keys])
        return _frame(keys, {k: all_}, 0)

    out = src.mapInPandas(parts, schema).groupBy(*keys, "_slot").applyInPandas(merge, schema)
    out = out.groupBy(*keys, "_slot").applyInPandas(merge, schema)
    return out.select(*[F.col(k).cast(types[k]).alias(k) for k in keys], F.col("n").cast("long").alias("n"), "means", "m2")


def covariances(matrix: DataFrame, columns: list[str], keys: list[str] = ()) -> DataFrame:
    """(keys, a, b, n, cov, corr) for every pair of columns in their order, a column with itself too.

    cov is null for one row, corr where a column is constant.
    """
    p, names = len(columns), F.array(*[F.lit(c) for c in columns])
    i, j = F.floor(F.col("_p") / p).cast("int"), (F.col("_p") % p).cast("int")
    each = matrix.select(*keys, "n", "m2", F.posexplode("m2").alias("_p", "_s")).filter(i <= j)
    spread = F.sqrt(F.get("m2", i * (p + 1)) * F.get("m2", j * (p + 1)))
    return each.select(*keys, F.get(names, i).alias("a"), F.get(names, j).alias("b"), "n", F.try_divide("_s", F.col("n") - 1).alias("cov"), F.try_divide(F.col("_s"), spread).alias("corr"))


def pivoted(m2: np.ndarray, nothing: float = NOTHING) -> tuple[list[int], np.ndarray]:
    """Cholesky steps on the correlations, the column with the largest rest first: the columns taken, in order,
    and for each column the share of its variance that was left when it was taken, or is left at the end."""
    sd = np.sqrt(np.diag(m2))
    live = sd > 0
    c = np.divide(m2, np.outer(sd, sd), out=np.zeros_like(m2), where=np.outer(live, live))
    rest, taken, factors = np.where(live, 1.0, 0.0), [], []
    share = rest.copy()
    while True:
        free = np.where(np.isin(np.arange(len(sd)), taken), -1.0, rest)
        k = int(free.argmax()) if len(free) else -1
        if k < 0 or free[k] <= nothing:
            break
        column = c[:, k] - sum((f * f[k] for f in factors), np.zeros(len(sd)))
        factors.append(column / np.sqrt(rest[k]))
        share[k] = rest[k]
        taken.append(k)
        rest = np.maximum(rest - factors[-1] ** 2, 0.0)
    left = ~np.isin(np.arange(len(sd)), taken)
    share[left] = rest[left]
    return taken, share


def independent(matrix: DataFrame, columns: list[str], keys: list[str] = ()) -> DataFrame:
    """(keys, column, position, independent, left_share): the order in which pivoted Cholesky takes the columns.

    A column that is constant or a combination of those taken is not independent and has no position.
    """
    keys, p = list(keys), len(columns)
    types = dict(matrix.dtypes)

    def steps(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for row in pdf.to_dict("records"):
                taken, share = pivoted(np.asarray(row["m2"], float).reshape(p, p))
                out += [(*(row[k] for k in keys), c, taken.index(i) if i in taken else None, i in taken, float(share[i])) for i, c in enumerate(columns)]
            frame = pd.DataFrame(out, columns=[*keys, "column", "position", "independent", "left_share"])
            yield frame.astype({"position": "Int64"})

    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "column string, position long, independent boolean, left_share double"])
    return matrix.select(*keys, "m2").mapInPandas(steps, schema)


def adjusted_effects(df: DataFrame, arm: str, y: str, covariates: list[str], keys: list[str] = ()) -> DataFrame:
    """CUPED with many covariates from one pass: (keys, n_t, n_c, effect, t_stat, nu, var_reduction, rank, p_value).

    The coefficients are the least-squares ones of the pooled rows on the independent covariates. Rows with a
    null in y or a covariate are left out; a key with fewer than two rows in an arm has no row.
    """
    keys, cols = list(keys), [y, *covariates]
    p, types = len(cols), dict(df.dtypes)
    arms = gram(df.filter(F.col(arm).isin(0, 1)).withColumn("_arm", F.col(arm).cast("int")), cols, [*keys, "_arm"])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        own = {int(a): (float(n), np.asarray(m, float), np.asarray(s, float).reshape(p, p)) for a, n, m, s in zip(pdf["_arm"], pdf["n"], pdf["means"], pdf["m2"])}
        names = [*keys, "n_t", "n_c", "effect", "t_stat", "nu", "var_reduction", "rank"]
        if len(own) < 2 or min(v[0] for v in own.values()) < 2:
            return pd.DataFrame([], columns=names)
        _, _, whole = _add(own[1], own[0])
        chosen = [i + 1 for i in sorted(pivoted(whole[1:, 1:])[0])]
        scale = np.sqrt(np.diag(whole))[chosen]
        theta = np.linalg.solve(whole[np.ix_(chosen, chosen)] / np.outer(scale, scale), whole[chosen, 0] / scale) / scale if chosen else np.zeros(0)
        w = np.zeros(p)
        w[0], w[chosen] = 1.0, -theta
        (nt, mt, st), (nc, mc, sc) = own[1], own[0]
        a, b = w @ st @ w / (nt - 1) / nt, w @ sc @ w / (nc - 1) / nc
        effect, se = w @ (mt - mc), (a + b) ** 0.5
        nu = (a + b) ** 2 / (a * a / (nt - 1) + b * b / (nc - 1)) if se > 0 else None
        row = [*pdf.iloc[0][keys], int(nt), int(nc), effect, effect / se if se > 0 else None, nu, 1 - w @ whole @ w / whole[0, 0] if whole[0, 0] > 0 else 0.0, len(chosen)]
        return pd.DataFrame([row], columns=names)

    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "n_t long, n_c long, effect double, t_stat double, nu double, var_reduction double, rank int"])
    return arms.groupBy(*keys).applyInPandas(solve, schema).withColumn("p_value", p_t("t_stat", "nu"))
