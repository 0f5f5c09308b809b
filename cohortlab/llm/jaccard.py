"""Operator 4: n-gram Jaccard join by MinHash banding.

Equal word sequences are one representative. Representatives shuffle on the hashes of their
bands; those that share a band and agree in enough of all their samples (directly or through others)
form a candidate group, so texts that meet in a band by chance stay apart. Each group
is verified in block pairs on full n-gram sets: the links of a pair of blocks are counted where
they are found and never written out as pairs, so a group of any size costs bounded tasks.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordIds, components, cut, distinct, join_counted, mix, table
from .sketch import likely_classes, most_bits, sketches

BATCH_WORDS = 400_000
COLUMNS = 4096


def choose_bands(threshold: float, recall: float = 0.9999, noise: float = 0.15) -> tuple[int, int]:
    """(bands, rows): the fewest rows with which a pair at half the threshold shares a band with
    a chance of at most `noise`, and bands enough for `recall` at the threshold."""
    for rows in range(1, 33):
        bands = max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)))
        if 1 - (1 - (threshold / 2) ** rows) ** bands <= noise:
            return bands, rows
    return bands, rows


def text_words(text: str | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split() if isinstance(text, str) else []


def grams(ids: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of the n-grams that start at each place; the last n - 1 places are wanting."""
    h = np.zeros(max(0, len(ids) - n + 1), np.uint64)
    for j in range(n):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += ids[j : len(ids) - n + 1 + j]
    return mix(h)


def gram_set(ids: np.ndarray, n: int) -> np.ndarray:
    """The distinct n-grams of a text; one shorter than n words is a single gram."""
    return distinct(grams(ids, min(n, len(ids)))) if len(ids) else np.zeros(0, np.uint64)


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, k1, k2, bands, sketch): a 128-bit key of the word sequence, a hash for each band and the odd sketch of all samples; no row for texts without words."""
    factors = mix(np.arange(1, bands * rows + 1, dtype=np.uint64))
    # 32 bits a permutation: an xor and an odd factor, in half the time of 64
    masks, factors = (factors >> np.uint64(32)).astype(np.uint32), factors.astype(np.uint32) | np.uint32(1)

    def flush(held: list[tuple[int, tuple[int, int], np.ndarray]]) -> pd.DataFrame:
        lengths = np.array([len(x[2]) for x in held])
        every = np.concatenate([x[2] for x in held]) if held else np.zeros(0, np.uint64)
        ends = np.cumsum(lengths)
        starts = ends - lengths
        size = np.where(lengths >= n, lengths - n + 1, 1)
        at = np.concatenate([[0], np.cumsum(size)])[:-1]
        short = np.flatnonzero(lengths < n)
        h = np.empty(int(size.sum()), np.uint64)
        if len(every) >= n:
            whole = grams(every, n)
            keep = np.ones(len(every), bool)
            for j in range(n - 1):
                e = ends - 1 - j
                keep[e[e >= starts]] = False
            place = np.repeat(at - starts, lengths)
            idx = np.flatnonzero(keep)
            h[idx + place[idx]] = whole[idx]
        for i in short:
            h[at[i]] = grams(held[i][2], int(lengths[i]))[0]
        out = np.empty((len(held), bands), np.int64)
        low = (h >> np.uint64(32)).astype(np.uint32)
        v = np.empty_like(low)
        least = np.empty((len(held), bands * rows), np.uint32)
        for b in range(bands):
            acc = np.full(len(held), b + 1, np.uint64)
            for r in range(b * rows, b * rows + rows):
                np.bitwise_xor(low, masks[r], out=v)
                np.multiply(v, factors[r], out=v)
                least[:, r] = np.minimum.reduceat(v, at)
                acc = mix(acc * np.uint64(0xC2B2AE3D27D4EB4F) + least[:, r])
            out[:, b] = acc.view(np.int64)
        keys = np.array([x[1] for x in held], np.int64).reshape(-1, 2)
        return pd.DataFrame({"doc_id": [x[0] for x in held], "k1": keys[:, 0], "k2": keys[:, 1], "bands": list(out), "sketch": list(sketches(least).view(np.int64))})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = WordIds()
        held, count = [], 0
        for pdf in batches:
            for doc, text in zip(pdf["doc_id"], pdf["text"]):
                ws = text_words(text)
                if not ws or doc is None or doc != doc:
                    continue
                held.append((int(doc), sequence_key(ws), ids.of(ws)))
                count += len(ws)
                if count >= BATCH_WORDS:
                    yield flush(held)
                    held, count = [], 0
        if held:
            yield flush(held)

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, k1 long, k2 long, bands array<long>, sketch array<long>")


def _link_block(ids: np.ndarray, weights: np.ndarray, sets: list[np.ndarray], side: np.ndarray, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Weighted links of each member of a pair of blocks, and the least member it is joined to.

    side: 0 for the first block, 1 for the second; same: both are one block.
    """
    size = np.array([len(s) for s in sets], dtype=np.int64)
    vocab, col = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), size)
    shared = np.bincount(col, minlength=len(vocab)) > 1
    place = np.cumsum(shared) - 1
    keep = shared[col]
    row, col = row[keep], place[col[keep]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    a = np.flatnonzero(side == 0)
    b = a if same else np.flatnonzero(side == 1)
    ia, ib = np.full(len(sets), -1), np.full(len(sets), -1)
    ia[a], ib[b] = np.arange(len(a)), np.arange(len(b))
    both = np.zeros((len(a), len(b)), np.float32)
    width = int(shared.sum())
    for c in range(0, width, COLUMNS):
        lo, hi = np.searchsorted(col, [c, c + COLUMNS])
        r, k, w = row[lo:hi], col[lo:hi] - c, min(COLUMNS, width - c)
        left = np.zeros((len(a), w), np.float32)
        left[ia[r[ia[r] >= 0]], k[ia[r] >= 0]] = 1
        right = left
        if not same:
            right = np.zeros((len(b), w), np.float32)
            right[ib[r[ib[r] >= 0]], k[ib[r] >= 0]] = 1
        both += left @ right.T
    inter = both.astype(np.int64)
    # |A & B| / |A | B| >= t, in whole numbers to be free of rounding
    t = round(threshold * 1_000_000)
    linked = 1_000_000 * inter >= t * (size[a][:, None] + size[b][None, :] - inter)
    if same:
        np.fill_diagonal(linked, False)
    links = np.zeros(len(sets), np.int64)
    links[a] += linked @ weights[b]
    if not same:
        links[b] += linked.T @ weights[a]
    root = ids.copy()
    while True:
        was = root.copy()
        big = np.iinfo(np.int64).max
        low = np.where(linked, root[b][None, :], big).min(axis=1, initial=big)
        root[a] = np.minimum(root[a], low)
        low = np.where(linked, root[a][:, None], big).min(axis=0, initial=big)
        root[b] = np.minimum(root[b], low)
        if (root == was).all():
            return links, root


def sequence_key(ws: list[bytes]) -> tuple[int, int]:
    """A 128-bit key of a word sequence, as two signed longs."""
    import xxhash

    return struct.unpack("<qq", xxhash.xxh128_intdigest(b" ".join(ws)).to_bytes(16, "little"))


def verified_links(docs: DataFrame, candidates: DataFrame, n: int, threshold: float, block: int, block_grams: int) -> DataFrame:
    """candidates: (doc_id, k1, root, m). Returns (doc_id, k1, links, low) of every block pair."""

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = WordIds()
        for pdf in batches:
            kept, found = [], []
            # one text after the other: the words of a whole batch would take many times its bytes
            for i, (text, k1) in enumerate(zip(pdf["text"], pdf["k1"])):
                ws = text_words(text)
                if sequence_key(ws)[0] == k1:  # of the texts of a doc_id the one with the candidate's words
                    kept.append(i)
                    found.append(gram_set(ids.of(ws), n).tobytes())
            own = pdf.iloc[kept]
            yield pd.DataFrame({"doc_id": own["doc_id"], "k1": own["k1"], "root": own["root"], "m": own["m"], "size": [len(x) // 8 for x in found], "grams": found})

    rows = docs.select("doc_id", "text").join(candidates, "doc_id").mapInPandas(sets, "doc_id long, k1 long, root long, m long, size long, grams binary")
    rows = cut(rows.dropDuplicates(["doc_id", "k1"]))
    groups = rows.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("size") / block_grams)).alias("blocks"), F.count("*").alias("c"))
    placed = join_counted(rows, groups, ["root"], rows.count()).withColumn("b", F.pmod(F.xxhash64("doc_id", "k1"), F.col("blocks")))
    pairs = placed.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    pairs = pairs.select("doc_id", "k1", "root", "m", "grams", F.least("b", "o").alias("b1"), F.greatest("b", "o").alias("b2"), (F.col("b") > F.col("o")).cast("int").alias("side"))
    key = ["root", "b1", "b2"]
    pairs = pairs.repartition(F.xxhash64(*key)).sortWithinPartitions(*key, "doc_id", "k1")

    def link(group: list[tuple]) -> pd.DataFrame:
        ids = np.array([g[0] for g in group], np.int64)
        links, root = _link_block(ids, np.array([g[1] for g in group], np.int64), [np.frombuffer(g[2], np.uint64) for g in group], np.array([g[3] for g in group]), group[0][4][1] == group[0][4][2], threshold)
        return pd.DataFrame({"doc_id": ids, "k1": [g[5] for g in group], "links": links, "low": root})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        done: list[pd.DataFrame] = []
        for pdf in batches:
            for doc, k1, root, m, g, b1, b2, side in zip(pdf["doc_id"], pdf["k1"], pdf["root"], pdf["m"], pdf["grams"], pdf["b1"], pdf["b2"], pdf["side"]):
                if held and held[-1][4] != (root, b1, b2):
                    if len(held) > 1:
                        done.append(link(held))
                    held = []
                held.append((doc, m, g, side, (root, b1, b2), k1))
            if done:
                yield pd.concat(done)
                done = []
        if len(held) > 1:
            yield link(held)

    return pairs.mapInPandas(run, "doc_id long, k1 long, links long, low long")


def near_duplicates(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9999, block: int = 256, block_grams: int = 400_000) -> DataFrame:
    """(doc_id, class_id, n_links), a row for each row of docs.

    n_links: other rows whose sets of word n-grams have at least this Jaccard similarity;
    class_id: the least doc_id that links lead to, directly or through others. Texts shorter
    than n words are one gram. Null and empty texts, and rows without a doc_id, have no words
    and no links: they are their own class. Repeated rows count as links of one another; rows
    that share a doc_id with different texts are one document, of the class of both, with the
    links of the text that has most, and aren't linked by that doc_id. Extra
    columns are not read; an empty table gives an empty result. Pairs at the threshold share a
    band with at least the probability `recall`, more similar ones with a higher one, and pass their sketches but
    for five deviations; a pair that only others join is verified too.
    """
    bands, rows = choose_bands(threshold, recall)
    sig = cut(signatures(docs, n, bands, rows))
    reps = cut(sig.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("m"), F.min_by("bands", "doc_id").alias("bands"), F.min_by("sketch", "doc_id").alias("sketch")))
    group = likely_classes(reps, bands, most_bits(threshold, bands * rows))
    group = group.unionByName(group.select(F.col("root").alias("node"), "root").distinct())
    candidates = cut(group.join(reps.select(F.col("rep").alias("node"), "k1", "m"), "node").select(F.col("node").alias("doc_id"), "k1", "root", "m"))
    conf, batch = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = conf.get(batch)
    conf.set(batch, str(block))  # rows with gram sets are large: a worker gets a block of them at a time
    try:
        found = cut(verified_links(docs, candidates, n, threshold, block, block_grams))
    finally:
        conf.set(batch, was)
    links = found.groupBy("doc_id", "k1").agg(F.sum("links").alias("links")).filter("links > 0")
    # the texts of a doc_id that has several are of one class
    several = sig.select("doc_id", "k1", "k2").join(sig.groupBy("doc_id").agg(F.count("*").alias("c")).filter("c > 1"), "doc_id").distinct()
    same = several.join(reps.select("k1", "k2", "rep"), ["k1", "k2"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    classes = components(found.select(F.col("doc_id").alias("a"), F.col("low").alias("b")).unionByName(same))
    rep = reps.select("k1", "k2", "rep", F.col("m").alias("c")).join(links.withColumnRenamed("doc_id", "rep"), ["rep", "k1"], "left").join(classes.withColumnRenamed("node", "rep"), "rep", "left")
    one = join_counted(sig.select("doc_id", "k1", "k2"), rep, ["k1", "k2"], sig.count()).groupBy("doc_id").agg(F.min(F.coalesce("root", "rep")).alias("class_id"), F.max(F.col("c") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    return docs.select("doc_id").join(one, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
