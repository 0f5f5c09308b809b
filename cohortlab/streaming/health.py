"""Health checks of a running experiment in event time: sample ratio and sequential tests by window.

Every micro-batch is summed to cells, one for each window and key. The state between batches is
small: the cells of windows that are still open, what closed windows add up to, and the largest
event time. It is written to the shared folder, a version for each batch, so a batch that is run
again after a failure starts from the version before it and replaces what it wrote: every window
is emitted once. A window closes when the watermark, the largest event time less the delay, passes its
end. A row that comes after that changes nothing any more; it is counted in a table of late rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from ..operators import balance, effects
from ..operators.routing import SALT, pure_hash

Close = Callable[[DataFrame, DataFrame | None], tuple[DataFrame, DataFrame]]


def closing_windows(events: DataFrame, ts: str, keys: list[str], cells: list[Column], merge: Callable[[DataFrame], DataFrame], close: Close, folder: str, every: str = "1 hour", delay: str = "0 seconds") -> DataStreamWriter:
    """A stream that emits each window of ts once, in `folder`/out, when the watermark passes its end.

    cells: aggregates of the rows of a window and key. merge: sums the cells (start, keys, ...) of one window and
    key. close: from closed cells and what earlier windows carried over (None at first) the rows to emit and
    what to carry on. `folder`/late has (start, keys, n_rows) of rows that came after their window closed, or
    without a time (start null).
    """
    width, wait = F.expr(f"INTERVAL {every}"), F.expr(f"INTERVAL {delay}")

    def deal(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession

        def kept(df: DataFrame, name: str) -> DataFrame:
            df.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}/epoch={epoch}")  # a row a window and key at most
            return spark.read.schema(df.schema).parquet(f"{folder}/{name}/epoch={epoch}")

        def before(name: str, schema: StructType | str) -> DataFrame:
            return spark.read.schema(schema).parquet(f"{folder}/{name}/epoch={epoch - 1}")

        new = batch.groupBy(F.window(ts, every)["start"].alias("start"), *keys).agg(*cells, F.max(ts).alias("_high"), F.count("*").alias("n_rows"))
        new = kept(new, "cells")
        high = before("clock", "high timestamp").first()[0] if epoch else None
        late = F.col("start").isNull() if high is None else F.col("start").isNull() | (F.col("start") + width <= F.lit(high) - wait)
        kept(new.filter(late).select("start", *keys, "n_rows"), "late")
        clock = new.agg(F.greatest(F.max("_high"), F.lit(high).cast("timestamp")).alias("high"))
        clock = kept(clock, "clock")
        own = new.filter(~late).drop("_high", "n_rows")
        held = merge(own if not epoch else own.unionByName(before("open", own.schema)))
        past = F.col("start") + width <= F.lit(clock.first()[0]).cast("timestamp") - wait  # null, so open, before the first row
        held = kept(held, "held")
        kept(held.filter(~F.coalesce(past, F.lit(False))), "open")
        out, carried = close(held.filter(past), spark.read.parquet(f"{folder}/carried/epoch={epoch - 1}") if epoch else None)
        kept(out, "out")
        kept(carried, "carried")

    return events.writeStream.foreachBatch(deal).option("checkpointLocation", f"{folder}/state")


def emitted(spark: SparkSession, folder: str, name: str = "out") -> DataFrame:
    """What a stream has written so far: out or late."""
    return spark.read.parquet(f"{folder}/{name}").drop("epoch")


def stream_srm(events: DataFrame, ts: str, user: str, folder: str, every: str = "1 hour", delay: str = "0 seconds", groups: int = 2, salt: str = SALT, buckets: int = 1000) -> DataStreamWriter:
    """Sample-ratio monitoring: for each closed window its rows (n_window), and total, chi2, p, level and
    action of the sizes of groups up to its end."""
    first = F.to_timestamp(F.lit("0001-01-01"))

    def close(closed: DataFrame, carried: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        sizes = closed.select("start", "group_id", "n")
        every_ = sizes if carried is None else sizes.unionByName(carried.select(first.alias("start"), "group_id", "n"))
        test = balance.srm_monitoring(every_, "start", groups).filter(F.col("start") > first)
        total = every_.groupBy("group_id").agg(F.sum("n").alias("n"))
        return test.join(sizes.groupBy("start").agg(F.sum("n").alias("n_window")), "start"), total

    merge = lambda c: c.groupBy("start", "group_id").agg(F.sum("n").alias("n"))
    routed = events.withColumn("group_id", pure_hash(user, salt, buckets, groups))
    return closing_windows(routed, ts, ["group_id"], [F.count("*").alias("n")], merge, close, folder, every, delay)


def stream_sequential(events: DataFrame, ts: str, arm: str, y: str, folder: str, keys: list[str], every: str = "1 day", delay: str = "0 seconds", alpha: float = 0.05) -> DataStreamWriter:
    """The sequential test of each experiment (keys, one column at least) at the end of every window, on all rows so far.

    signal is true at the first window whose test says stop, once for each experiment. Arms are carried
    as (n, mean, M2) and merged by Chan's formula.
    """
    state = [*keys, *effects.ARM_CELLS, "stopped"]

    def close(closed: DataFrame, carried: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        carried = closed.withColumn("stopped", F.lit(False)).select(*state).limit(0) if carried is None else carried.select(*state)
        run = effects.running_arms(closed, "start", keys, carried)
        test = effects.arms_test(run, ["start", *keys], alpha)
        first = test.filter("stop").groupBy(*keys).agg(F.min("start").alias("_first"))
        known = carried.select(*keys, F.col("stopped").alias("_known"))
        signal = (F.col("start") == F.col("_first")) & ~F.coalesce("_known", F.lit(False))
        out = test.join(first, keys, "left").join(known, keys, "left").withColumn("signal", F.coalesce(signal, F.lit(False))).drop("_first", "_known")
        last = run.groupBy(*keys).agg(F.max_by(F.struct(*effects.ARM_CELLS), "start").alias("_m")).join(out.groupBy(*keys).agg(F.max("stop").alias("stopped")), keys)
        both = carried.unionByName(last.select(*keys, "_m.*", "stopped"))
        newest = [F.max_by(c, F.col("n_t") + F.col("n_c")).alias(c) for c in effects.ARM_CELLS]
        return out, both.groupBy(*keys).agg(*newest, F.max("stopped").alias("stopped")).select(*state)

    rows = events.filter(F.col(y).isNotNull() & F.col(arm).isin(0, 1))
    return closing_windows(rows, ts, keys, effects.arm_cells(arm, y), lambda c: effects.merged_arms(c, ["start", *keys]), close, folder, every, delay)


def run_to_end(writer: DataStreamWriter) -> None:
    """Runs a stream over what there is. It ends complete or raises."""
    q = writer.trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()
