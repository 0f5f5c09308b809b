"""Structured Streaming: stateless routing, hourly windows, ordered stateful routers."""

from __future__ import annotations

import uuid
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.frames import checkpoint_dir, with_rank
from ..operators.routing import SALT, pure_hash
from .health import run_to_end


def stream_hash_counts(events: DataFrame, user: str, groups: int = 10, salt: str = SALT) -> DataFrame:
    """Running group sizes of a stateless router (complete or update mode)."""
    return events.withColumn("group_id", pure_hash(user, salt, 1000, groups)).groupBy("group_id").agg(F.count("*").alias("n"))


def hourly_counts(events: DataFrame, ts: str, user: str, groups: int = 2, salt: str = SALT, late: str = "1 hour") -> DataFrame:
    """Group sizes of every hour, late events up to `late`."""
    return events.withWatermark(ts, late).withColumn("group_id", pure_hash(user, salt, 1000, groups)).groupBy(F.window(ts, "1 hour").alias("hour"), "group_id").agg(F.count("*").alias("n"))


def slot_rule(counts: list[int], slots: list[int]) -> int:
    g = counts.index(min(counts))
    return g if counts[g] < slots[g] else -1


def stream_slot_pool(events: DataFrame, user: str, order: str, slots: list[int], folder: str) -> DataStreamWriter:
    """A query that writes (user_id, k, group_id) of each new user to `folder`/users, a subfolder a batch.

    Known users are kept by the state store, a key a user. The new ones of a batch are ranked by
    ranges; the number of users before the batch and the closed form of the pool give their groups.
    A batch that is run again writes its own subfolder anew.
    """
    groups = len(slots)
    stop = min(s * groups + g for g, s in enumerate(slots))
    new = events.select(F.col(user).cast("string").alias("user_id"), F.col(order).alias("_order")).dropDuplicates(["user_id"])

    def deal(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        ranked = with_rank(batch, ["_order", "user_id"])
        done = spark.read.schema("n long, epoch long").parquet(f"{folder}/counts").filter(F.col("epoch") < epoch).agg(F.sum("n")).first()[0] or 0 if epoch else 0
        k = F.col("k") + F.lit(done)
        out = ranked.select("user_id", k.alias("k"), F.when(k < stop, k % groups).otherwise(-1).cast("int").alias("group_id"))
        out.write.mode("overwrite").parquet(f"{folder}/users/batch={epoch}")
        spark.createDataFrame([(ranked.count(),)], "n long").write.mode("overwrite").parquet(f"{folder}/counts/epoch={epoch}")

    return new.writeStream.foreachBatch(deal).outputMode("append").option("checkpointLocation", f"{folder}/state")


def run_to_table(df: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over what there is, however long that takes, and returns its last result, written to the
    shared folder; a stream that fails raises, so the result is never a part.
    complete: the last batch is the result; append and update: all batches are, the last row of a key standing for it."""
    folder = f"{checkpoint_dir(df.sparkSession)}/stream-{uuid.uuid4().hex}"
    last: list[int] = []

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={epoch}")
        last.append(epoch)

    run_to_end(df.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{folder}/state"))
    out = df.sparkSession.read.schema(df.schema).parquet(*([f"{folder}/out/batch={last[-1]}"] if mode == "complete" else [f"{folder}/out/batch={e}" for e in last])) if last else None
    return out if out is not None else df.sparkSession.createDataFrame([], df.schema)
