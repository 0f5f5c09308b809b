"""Lineage and running sums over a global order, without one task that holds all rows."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names. Only a local master gets one of our own (tests); anywhere
    else a missing setting is an error, for executors could not read a folder of the driver's machine."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(named)
        return named
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no shared folder")
        sc.setCheckpointDir(os.path.join(tempfile.gettempdir(), "cohortlab-checkpoints"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def running(df: DataFrame, order: list[str], sums: dict[str, Column], keys: list[str] = (), parts: int | None = None) -> DataFrame:
    """Adds to each row, under each name of sums, the sum over the rows before it in its key.

    Rows are dealt into ranges of (keys, order) once and written with the number of their range, so
    the ranges' bounds are sampled once and every reader, a recomputed task included, sees the same
    ranges. A row's sum is that within its range plus that of its key's earlier ranges. Only the first
    key of a range has any, so the table of those sums has at most a row a range and is broadcast:
    Spark's own choice may broadcast the rows, whose size it takes for that of the files they come from.
    A key of any size is spread over ranges. Rows that are equal in all of order keep no fixed order
    among themselves.
    """
    keys = list(keys)
    placed = df.repartitionByRange(parts, *keys, *order) if parts else df.repartitionByRange(*keys, *order)
    placed = cut(placed.withColumn("_part", F.spark_partition_id()))
    own = placed.groupBy(*keys, "_part").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = own.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"), F.count("*").over(earlier).alias("_e"), *[F.sum(n).over(earlier).alias(f"_b_{n}") for n in sums])
    before = before.filter("_e > 0").drop("_e")
    inside = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = placed.withColumns({f"_i_{n}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in sums.items()})
    same = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    out = out.join(F.broadcast(before), same, "left")  # a row a range
    out = out.withColumns({n: F.col(f"_i_{n}") + F.coalesce(F.col(f"_b_{n}"), F.lit(0)) for n in sums})
    return out.drop("_part", "_p", *[f"_k{i}" for i in range(len(keys))], *[f"{p}_{n}" for n in sums for p in ("_i", "_b")])


def with_rank(df: DataFrame, order: list[str], name: str = "k", parts: int | None = None, keys: list[str] = ()) -> DataFrame:
    """Adds the 0-based rank in a global order, or in that of each key."""
    return running(df, order, {name: F.lit(1).cast("long")}, keys, parts)


def percentiles(df: DataFrame, value: str, points: dict[str, float], keys: list[str] = ()) -> DataFrame:
    """Exact percentiles, interpolated, of the values that are not null: a row a key (one row without keys).

    The distinct values are counted and ranked by range; a point is read off the one or two values
    at its place, so no task or buffer holds all values of a key.
    """
    keys = list(keys)
    n = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    at = running(n, ["_v"], {"_before": F.col("_n")}, keys)
    total = at.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    if keys:
        for k in keys:
            total = total.withColumnRenamed(k, f"_t_{k}")
        cond = F.lit(True)
        for k in keys:
            cond &= F.col(k).eqNullSafe(F.col(f"_t_{k}"))
        at = at.join(F.broadcast(total), cond)  # a row a key
    else:
        at = at.join(F.broadcast(total))  # one row
    out = []
    for name, p in points.items():
        place = (F.col("_total") - 1) * F.lit(float(p))
        held = lambda x: F.max(F.when((F.col("_before") <= x) & (x < F.col("_before") + F.col("_n")), F.col("_v").cast("double")))
        low, high = F.floor(place), F.ceil(place)
        out.append((held(low) + (held(high) - held(low)) * F.max(place - low)).alias(name))
    return at.groupBy(*keys).agg(*out)
