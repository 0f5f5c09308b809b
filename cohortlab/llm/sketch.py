"""Odd sketches: parity bitmaps of MinHash samples, and the classes of likely pairs that they give.

Two sets' samples differ in a number of places; each differing sample flips two bits of the XOR of their
bitmaps, so its population count estimates the similarity, best for very similar sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, cut, join_counted, mix

BITS = 512
PAIRS = 250_000


def most_bits(threshold: float, samples: int, bits: int = BITS, z: float = 5.0) -> int:
    """The XOR count of a pair at the threshold, and z deviations: those of how many samples differ and of where
    they fall. Each of n flips goes to a bit by chance, so that the mean of a bit's sign is (1 - 2 / bits)^n."""
    n = 2 * samples * (1 - threshold)
    sign, both = (1 - 2 / bits) ** n, (1 - 4 / bits) ** n
    falls = (bits + bits * (bits - 1) * both - (bits * sign) ** 2) / 4
    differ = sign**2 * 4 * samples * threshold * (1 - threshold)
    return math.ceil(bits / 2 * (1 - sign) + z * math.sqrt(falls + differ))


def similarity(differ: np.ndarray, samples: int, bits: int = BITS) -> np.ndarray:
    """The Jaccard similarity that an XOR count stands for."""
    return 1 + bits / (4 * samples) * np.log(np.maximum(1e-9, 1 - 2 * differ / bits))


def sketches(samples: np.ndarray, bits: int = BITS) -> np.ndarray:
    """A parity bitmap for each row of MinHash samples: each (place, value) flips a bit."""
    rows, k = samples.shape
    h = samples.astype(np.uint64)
    h += mix(np.arange(1, k + 1, dtype=np.uint64))[None, :]
    h = (mix(h) % np.uint64(bits)).astype(np.int64)
    flips = np.bincount((np.arange(rows)[:, None] * bits + h).ravel(), minlength=rows * bits) & 1
    return np.packbits(flips.astype(np.uint8).reshape(rows, bits), axis=1, bitorder="little").view("<u8")


def differing(a: Column | str, b: Column | str) -> Column:
    """The XOR count of two sketches."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def groups_of(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal keys begin and end."""
    new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)]))
    return new, np.append(new[1:], len(key))


def pairs_of(key: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows within runs of equal keys, as places (a before b), some PAIRS at a time."""
    begin, end = groups_of(key)
    n = np.repeat(end, end - begin) - np.arange(len(key)) - 1
    edges = np.searchsorted(np.cumsum(n), np.arange(PAIRS, int(n.sum()) + PAIRS, PAIRS), side="left") + 1
    lo = 0
    for hi in np.minimum(edges, len(key)):
        own = n[lo:hi]
        a = np.repeat(np.arange(lo, hi), own)
        yield a, a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(own) - own, own)
        lo = hi


def _likely(most: int):
    """Rows (h, b1, b2, side, cross, rep, comp, sketch) sorted by bucket and pair of blocks: edges (a, b) that span the likely pairs across classes."""

    def edges(h: pd.DataFrame) -> pd.DataFrame:
        rep, comp, side, cross = (h[c].to_numpy() for c in ("rep", "comp", "side", "cross"))
        sketch, out = np.array(h["sketch"].tolist(), np.int64).view(np.uint64), []
        for a, b in pairs_of(h[["h", "b1", "b2"]].to_numpy()):
            ok = (comp[a] != comp[b]) & (~cross[a] | (side[a] != side[b]))
            a, b = a[ok], b[ok]
            ok = np.bitwise_count(sketch[a] ^ sketch[b]).sum(axis=1) <= most
            a, b = a[ok], b[ok]
            if not len(a):
                continue
            low = np.arange(len(h))
            while True:
                was = low.copy()
                np.minimum.at(low, a, was[b])
                np.minimum.at(low, b, low[a])
                if (low == was).all():
                    break
            out.append(pd.DataFrame({"a": rep, "b": rep[low]})[low != np.arange(len(h))])
        return pd.concat(out) if out else pd.DataFrame({"a": rep[:0], "b": rep[:0]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            begin, _ = groups_of(held[["h", "b1", "b2"]].to_numpy())
            if begin[-1]:
                yield edges(held.iloc[: begin[-1]].reset_index(drop=True))
                held = held.iloc[begin[-1] :].reset_index(drop=True)
        if held is not None and len(held):
            yield edges(held)

    return run


def likely_classes(reps: DataFrame, bands: int, most: int, block: int = 1024) -> DataFrame:
    """reps: (rep, bands, sketch). Returns (node, root): every two reps that share a band and whose sketches differ in at most
    `most` bits have one root; reps without such a partner have no row.

    Members of a bucket are compared with its least one first; buckets that still hold several classes are compared
    in pairs of blocks, across classes only. Unlike pairs that meet in a band by chance join nothing.
    """
    hashes = reps.select("rep", F.explode("bands").alias("h"))
    shared = hashes.groupBy("h").agg(F.min("rep").alias("low"), F.count("*").alias("c")).filter("c > 1")
    sketch = reps.select("rep", "sketch").dropDuplicates(["rep"])
    shared = shared.join(sketch.select(F.col("rep").alias("low"), F.col("sketch").alias("low_sketch")), "low")
    total = bands * reps.count()
    members = cut(join_counted(hashes, shared, ["h"], total))
    near = members.filter("rep <> low").join(sketch, "rep").filter(differing("sketch", "low_sketch") <= most)
    near = cut(near.select(F.col("rep").alias("a"), F.col("low").alias("b")).distinct())
    # the least partner found so far stands for the class, which is enough to leave out most pairs
    label = members.select("rep").distinct().join(near.groupBy(F.col("a").alias("rep")).agg(F.min("b").alias("b")), "rep", "left")
    label = cut(label.select("rep", F.least("rep", "b").alias("comp")))
    buckets = members.select("h", "rep").join(label, "rep").groupBy("h").agg(F.count("*").alias("c"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi")
    buckets = cut(buckets.select("h", "c", F.ceil(F.col("c") / block).alias("blocks")))
    if not buckets.limit(1).count():
        return components(near)
    placed = join_counted(members.select("h", "rep"), buckets, ["h"], members.count()).withColumn("b", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    paired = placed.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    key = ["h", "b1", "b2"]
    paired = paired.select("h", "rep", F.least("b", "o").alias("b1"), F.greatest("b", "o").alias("b2"), (F.col("b") > F.col("o")).cast("int").alias("side"), (F.col("b") != F.col("o")).alias("cross"))
    dealt = paired.join(label, "rep").join(sketch, "rep").repartition(F.xxhash64(*key)).sortWithinPartitions(*key, "rep")
    return components(near.unionByName(dealt.mapInPandas(_likely(most), "a long, b long")))
