"""Operator 12: near-duplicate classes by MinHash bands and odd sketches.

Every document gets MinHash samples of its set of word n-grams. Groups of samples are bands, on
whose hashes documents shuffle; all samples together are folded into a parity bitmap, the odd
sketch. The population count of the XOR of two sketches estimates how many samples differ, which
is sharpest for very similar sets, so it settles which pairs that share a band are worth a look
at their full sets:

1. Of each band's bucket every member is compared with the least one. Links confirmed on full
   sets join most copies into classes.
2. Buckets that still hold several classes are compared in pairs of blocks: the sketches of all
   pairs across classes first, then the full sets of documents with a pair that passes.

Every pair that shares a band is in one class already, or refuted by its sketch, or compared in full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordIds, components, cut, join_counted, mix, table
from .jaccard import _link_block, choose_bands, gram_set, text_words
from .sketch import differing, groups_of, most_bits, pairs_of, similarity, sketches  # noqa: F401

BATCH_GRAMS = 400_000


def signatures(docs: DataFrame, n: int, bands: int, rows: int, samples: int) -> DataFrame:
    """(doc_id, n_shingles, k1, k2, bands, sketch) of every row; k1 and k2, the key of the set, and what follows are null without words."""
    factors = mix(np.arange(1, samples + 1, dtype=np.uint64))
    masks, factors = (factors >> np.uint64(32)).astype(np.uint32), factors.astype(np.uint32) | np.uint32(1)

    def flush(ids: list, sets: list[np.ndarray]) -> pd.DataFrame:
        import xxhash

        full = [i for i, s in enumerate(sets) if len(s)]
        out = pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "n_shingles": [len(s) for s in sets], "k1": pd.array([None] * len(ids), "Int64"), "k2": pd.array([None] * len(ids), "Int64"), "bands": None, "sketch": None})
        if not full:
            return out
        h = (np.concatenate([sets[i] for i in full]) >> np.uint64(32)).astype(np.uint32)
        at = np.cumsum([0] + [len(sets[i]) for i in full])[:-1]
        low, v = np.empty((len(full), samples), np.uint32), np.empty_like(h)
        for r in range(samples):
            np.bitwise_xor(h, masks[r], out=v)
            np.multiply(v, factors[r], out=v)
            low[:, r] = np.minimum.reduceat(v, at)
        own = np.empty((len(full), bands), np.int64)
        for b in range(bands):
            acc = np.full(len(full), b + 1, np.uint64)
            for r in range(b * rows, b * rows + rows):
                acc = mix(acc * np.uint64(0xC2B2AE3D27D4EB4F) + low[:, r])
            own[:, b] = acc.view(np.int64)
        keys = np.array([xxhash.xxh128_digest(sets[i].tobytes()) for i in full], "S16").astype("V16").view("<i8").reshape(-1, 2)
        for name, column in (("k1", keys[:, 0]), ("k2", keys[:, 1])):
            out.loc[full, name] = column
        for name, column in (("bands", own), ("sketch", sketches(low).view(np.int64))):
            held: list = [None] * len(ids)
            for i, x in zip(full, column):
                held[i] = x
            out[name] = pd.Series(held, dtype=object)
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, ids, sets, size = WordIds(), [], [], 0
        for pdf in batches:
            for doc, text in zip(pdf["doc_id"], pdf["text"]):
                ids.append(None if doc is None or doc == "" else int(doc))
                sets.append(gram_set(words.of(text_words(text)), n))
                size += len(sets[-1]) + 20
                if size >= BATCH_GRAMS:
                    yield flush(ids, sets)
                    ids, sets, size = [], [], 0
        if ids:
            yield flush(ids, sets)

    # as text, for a column of long with nulls would come as floats
    return docs.select(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")).alias("doc_id"), "text").mapInPandas(run, "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>, sketch array<long>")


def full_sets(docs: DataFrame, of: DataFrame, n: int) -> DataFrame:
    """(rep, grams) of the rows of `of`, (rep, k1), read from their texts again. A rep with several texts has a row for each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        words, held, size = WordIds(), [], 0
        for pdf in batches:
            for rep, k1, text in zip(pdf["rep"], pdf["k1"], pdf["text"]):
                own = gram_set(words.of(text_words(text)), n)
                if len(own) and int.from_bytes(xxhash.xxh128_digest(own.tobytes())[:8], "little", signed=True) == k1:  # of the texts of a doc_id the one meant
                    held.append((rep, k1, own.view(np.int64)))
                    size += len(own)
                if size >= BATCH_GRAMS:
                    yield pd.DataFrame(held, columns=["rep", "k1", "grams"])
                    held, size = [], 0
        if held:
            yield pd.DataFrame(held, columns=["rep", "k1", "grams"])

    rows = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(of.select("rep", "k1"), "rep")
    return rows.mapInPandas(run, "rep long, k1 long, grams array<long>").dropDuplicates(["rep", "k1"]).drop("k1")


def confirmed(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Of (a, low) those whose full sets reach the threshold. A low with many pairs is dealt over salts."""
    counts = cut(pairs.groupBy("low").agg(F.count("*").alias("c")))
    dealt = join_counted(pairs, counts, ["low"], pairs.count()).select("a", "low", F.pmod(F.xxhash64("a"), F.ceil(F.col("c") / 1000)).alias("_salt"))
    lows = counts.select("low", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("c") / 1000) - 1)).alias("_salt")).join(sets.select(F.col("rep").alias("low"), F.col("grams").alias("_y")), "low")
    met = dealt.join(sets.select(F.col("rep").alias("a"), F.col("grams").alias("_x")), "a").join(lows, ["low", "_salt"])
    met = met.select("a", "low", F.size(F.array_intersect("_x", "_y")).cast("long").alias("_both"), (F.size("_x") + F.size("_y")).cast("long").alias("_all"))
    return met.filter(1_000_000 * F.col("_both") >= round(threshold * 1_000_000) * (F.col("_all") - F.col("_both"))).select("a", "low").distinct()


def _promising(most: int, threshold: float):
    """Rows (h, b1, b2, side, ...) sorted by bucket and pair of blocks: those with a partner of another
    class in their group whose sketch passes, in the first band that the two share."""

    def check(h: pd.DataFrame) -> np.ndarray:
        comp, side, cross, size, j = (h[c].to_numpy() for c in ("comp", "side", "cross", "n_shingles", "j"))
        sketch, bands = np.array(h["sketch"].tolist(), np.int64).view(np.uint64), np.array(h["bands"].tolist(), np.int64)
        good = np.zeros(len(h), bool)
        for a, b in pairs_of(h[["h", "b1", "b2"]].to_numpy()):
            short, long = np.minimum(size[a], size[b]), np.maximum(size[a], size[b])
            ok = (comp[a] != comp[b]) & (~cross[a] | (side[a] != side[b])) & (short >= threshold * long - 1e-9 * long)
            a, b = a[ok], b[ok]
            ok = np.bitwise_count(sketch[a] ^ sketch[b]).sum(axis=1) <= most
            a, b = a[ok], b[ok]
            first = (bands[a] == bands[b]).argmax(axis=1) == j[a]
            good[a[first]] = good[b[first]] = True
        return good

    columns = ["h", "b1", "b2", "side", "cross", "rep"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            begin, _ = groups_of(held[["h", "b1", "b2"]].to_numpy())
            if begin[-1]:
                own = held.iloc[: begin[-1]]
                yield own.loc[check(own), columns]
                held = held.iloc[begin[-1] :].reset_index(drop=True)
        if held is not None and len(held):
            yield held.loc[check(held), columns]

    return run


def _linked(threshold: float):
    """Rows (h, b1, b2, side, cross, rep, grams) in the same order: (a, b) pairs that span the links of a group."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, ids, sides, sets, cross = None, [], [], [], False

        def link() -> pd.DataFrame:
            own = np.array(ids, np.int64)
            _, low = _link_block(own, np.ones(len(own), np.int64), sets, np.array(sides), not cross, threshold)
            return pd.DataFrame({"a": own, "b": low})[own != low]

        for pdf in batches:
            for h, b1, b2, side, x, rep, grams in zip(pdf["h"], pdf["b1"], pdf["b2"], pdf["side"], pdf["cross"], pdf["rep"], pdf["grams"]):
                if (h, b1, b2) != key:
                    if len(ids) > 1:
                        yield link()
                    key, ids, sides, sets, cross = (h, b1, b2), [], [], [], x
                ids.append(rep)
                sides.append(side)
                sets.append(np.asarray(grams, np.int64).view(np.uint64))
        if len(ids) > 1:
            yield link()

    return run


def across_classes(members: DataFrame, reps: DataFrame, classes: DataFrame, sets: DataFrame, threshold: float, most: int, block: int, block_grams: int) -> DataFrame | None:
    """(a, b) links between documents of one bucket that are not of one class yet; None if all are."""
    label = members.select("rep").distinct().join(classes.withColumnRenamed("node", "rep"), "rep", "left").select("rep", F.coalesce("root", "rep").alias("comp"))
    label = cut(label.join(reps.select("rep", "n_shingles", "sketch", "bands"), "rep"))
    one = members.select("h", "j", "rep").join(label.select("rep", "comp", "n_shingles"), "rep")
    buckets = cut(one.groupBy("h").agg(F.count("*").alias("c"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n_shingles") / block_grams)).alias("blocks")).filter("lo <> hi").select("h", "c", "blocks"))
    if not buckets.limit(1).count():
        return None
    total = members.count()
    open_ = join_counted(members.select("h", "j", "rep"), buckets, ["h"], total).withColumn("b", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    paired = open_.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    paired = paired.select("h", "j", "rep", F.least("b", "o").alias("b1"), F.greatest("b", "o").alias("b2"), (F.col("b") > F.col("o")).cast("int").alias("side"), (F.col("b") != F.col("o")).alias("cross"))
    key = ["h", "b1", "b2"]
    dealt = lambda df: df.repartition(F.xxhash64(*key)).sortWithinPartitions(*key, "rep")
    # a document's class, sketch and bands, then those with a promising partner, then their sets
    full = dealt(paired.join(label, "rep"))
    good = cut(full.mapInPandas(_promising(most, threshold), "h long, b1 long, b2 long, side int, cross boolean, rep long"))
    return dealt(good.join(sets, "rep")).mapInPandas(_linked(threshold), "a long, b long")


def near_duplicate_classes(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9999, block: int = 256, block_grams: int = 400_000) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of docs.

    Documents are linked if their sets of word n-grams (A-Z lower-cased) have at least this
    Jaccard similarity; component_id is the least doc_id that links lead to, kept whether it is the row's own. Texts
    shorter than n words are one gram; null and empty texts have no grams and no links and are kept. Rows without
    a doc_id have no place among ids: they have no component_id, link with nothing and are kept. Repeated rows
    share their class, and all rows with its least doc_id are kept; rows that share a doc_id with different texts are one
    document, of the class of both. Texts of any length are read whole. Extra columns are not read, so names
    don't clash; an empty table gives an empty result.

    Pairs at the threshold share a band with at least the probability `recall` and pass their sketches
    but for five deviations; every link is confirmed on full sets.
    """
    bands, rows = choose_bands(threshold, recall)
    samples = 2 * bands * rows
    most = most_bits(threshold, samples)
    sig = cut(signatures(docs, n, bands, rows, samples))
    own = sig.filter("doc_id is not null and k1 is not null")
    reps = cut(own.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("c"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")))
    hashes = reps.select("rep", F.posexplode("bands").alias("j", "h"))
    shared = hashes.groupBy("h").agg(F.min("rep").alias("low"), F.count("*").alias("c")).filter("c > 1")
    sketch = reps.select("rep", "sketch").dropDuplicates(["rep"])
    shared = shared.join(sketch.select(F.col("rep").alias("low"), F.col("sketch").alias("low_sketch")), "low")
    members = cut(join_counted(hashes, shared, ["h"], bands * reps.count()))
    near = members.filter("rep <> low").join(sketch, "rep").filter(differing("sketch", "low_sketch") <= most).select(F.col("rep").alias("a"), "low").distinct()
    sets = cut(full_sets(docs, reps.select("rep", "k1").join(members.select("rep").distinct(), "rep"), n))
    links = confirmed(cut(near), sets, threshold).toDF("a", "b")
    # the texts of a doc_id that has several are of one class
    several = own.groupBy("doc_id").agg(F.min(F.struct("k1", "k2")).alias("lo"), F.max(F.struct("k1", "k2")).alias("hi")).filter("lo <> hi").select("doc_id")
    several = own.join(several, "doc_id").join(reps.select("k1", "k2", "rep"), ["k1", "k2"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    classes = components(links.unionByName(several))
    more = across_classes(members, reps, classes, sets, threshold, most, block, block_grams)
    if more is not None:
        classes = components(more.unionByName(classes.toDF("a", "b")))
    root = reps.select("k1", "k2", "rep", "c").join(classes.withColumnRenamed("node", "rep"), "rep", "left").select("k1", "k2", "c", F.coalesce("root", "rep").alias("component_id"))
    root = cut(root)
    keyed = join_counted(own.select("doc_id", "n_shingles", "k1", "k2"), root, ["k1", "k2"], own.count()).select("doc_id", "n_shingles", "component_id")
    out = keyed.unionByName(sig.filter("doc_id is null or k1 is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op12_odd_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(table(spark, sf_dir, "documents").select("doc_id", "text"), threshold=0.85)
