"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.frames import checkpoint_dir, cut  # noqa: F401

SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind an expression once for use inside lambdas, which would otherwise evaluate it for each element."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+`; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def row_key(*more: str) -> Column:
    """What tells rows apart: the doc_id and a hash of the text (and the columns in more), a long one where there is no doc_id."""
    return F.concat_ws(":", F.col("doc_id").cast("string"), F.when(F.col("doc_id").isNull(), F.sha2(F.to_json(F.struct(*more, "text")), 256)).otherwise(F.hex(F.xxhash64(*[c for m in more for c in (m, F.lit("|"))], "text"))))


def chunks_for(docs: DataFrame, text: str = "text", chunk_bytes: int = 8 << 20) -> int:
    """How many chunks of about chunk_bytes the texts make."""
    total = docs.agg(F.sum(F.octet_length(text)).alias("b")).first()["b"] or 0
    return max(1, -(-int(total) // chunk_bytes))


def join_counted(big: DataFrame, small: DataFrame, keys: list[str], total: int) -> DataFrame:
    """big joined with small, which has a row for each key with c, the rows that big has of it.

    The rows of keys with over a 500th of all (and 1,000) meet a broadcast of those keys, of which there are at
    most 500; only the others are shuffled, so no task gets all rows of a hot key.
    """
    most = max(1000, total // 500)
    hot = F.broadcast(small.filter(F.col("c") > most))
    cold = small.filter(F.col("c") <= most)
    return big.join(hot, keys).unionByName(big.join(hot.select(*keys), keys, "left_anti").join(cold, keys))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components by alternating large-star and small-star steps.

    edges: (a, b). Returns (node, root), root the least id of the node's component, for nodes
    with an edge to another. Every step aggregates before it joins, a hub's rows are spread over
    tasks, and each round is checkpointed.
    """
    e = cut(edges.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    seen = mark(e)
    for _ in range(rounds):
        n = seen[0]
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c")).select("u", F.least("u", "m").alias("m"), "c")
        large = join_counted(both, low, ["u"], 2 * n).filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u")
        small = moved.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v")
        e = cut(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        now = mark(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, in place."""
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    return h


class WordIds(dict):
    """64-bit ids of words; the memory it takes is bounded by starting anew."""

    def __init__(self, most: int = 400_000):
        self.most = most

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h

    def of(self, ws: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, ws), np.uint64, len(ws))


def distinct(x: np.ndarray) -> np.ndarray:
    """The sorted distinct values, by a vectorised sort."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def pack_sorted(v: np.ndarray, low: int) -> bytes:
    """Sorted unsigned integers as their `low` low bytes and the steps of what is above them."""
    v = v.astype(np.uint64)
    if not len(v):
        return b""
    high = v >> np.uint64(8 * low)
    step = np.diff(high, prepend=high[:1])
    width = next(w for w in (1, 2, 4, 8) if int(step.max()) < 1 << 8 * w)
    tail = v.view(np.uint8).reshape(-1, 8)[:, :low]
    return bytes([width]) + int(high[0]).to_bytes(8, "little") + step.astype(f"<u{width}").tobytes() + tail.tobytes()


def unpack_sorted(blob: bytes, low: int) -> np.ndarray:
    if not blob:
        return np.zeros(0, np.uint64)
    width, first = blob[0], int.from_bytes(blob[1:9], "little")
    n = (len(blob) - 9) // (width + low)
    high = np.cumsum(np.frombuffer(blob, f"<u{width}", n, 9).astype(np.uint64)) + np.uint64(first)
    tail = np.zeros((n, 8), np.uint8)
    tail[:, :low] = np.frombuffer(blob, np.uint8, n * low, 9 + n * width).reshape(n, low)
    return tail.view("<u8").reshape(-1) + (high << np.uint64(8 * low))
