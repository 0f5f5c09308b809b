"""Operator 7: removal of repeated byte strings by a distributed difference-cover algorithm.

A string of `LENGTH` bytes counts as repeated if it also starts in a document with a smaller
doc_id. Positions are sampled by a difference cover D modulo V: for any two positions some
shift below V takes both into the sample, so two equal strings share a sampled tuple of
LENGTH - V + 1 bytes at the same shift. The steps:

1. Name the sampled tuples and sort the names of all documents by range. A name that occurs in
   one document alone settles every suffix through it.
2. Recurse on what is left: suffixes with a shared name get the name of their first LENGTH
   bytes, sampled or not, and those names are sorted by range in turn.
3. Compare neighbours in the sorted order: of equal names all but those of the first document
   are repeated.

Only prefixes of LENGTH bytes matter, so recursion ends at that depth, and equality is all that is
asked of the order, so names are hashes: 32 bits within a range of step 1, where a clash costs
work but not rightness, and 64 bits in step 2. Documents are cut into chunks in the order of
doc_id; a chunk sends sorted blocks of names and gets back one bit for each name.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.frames import running
from .common import cut, distinct, join_counted, mix, pack_sorted, table, unpack_sorted

LENGTH = 50
V = 31
#: A perfect difference set modulo V.
COVER = (1, 5, 11, 24, 25, 27)
TUPLE = LENGTH - V + 1
SLICE = 1 << 20
NAME_LOW, HASH_LOW = 2, 5  # bytes of a packed name that are sent as they are
_K = np.uint64(0x9E3779B97F4A7C15)
_IN_COVER = np.isin(np.arange(V), COVER)


class Chunk:
    """The documents of a chunk in slices, by doc_id; copies of earlier documents are left out."""

    def __init__(self, docs: pd.DataFrame, copies: dict[int, set[bytes]]):
        docs = docs.sort_values("doc_id", kind="stable")
        self.ids = docs["doc_id"].to_numpy(np.int64)
        self.texts = [zlib.decompress(z) for z in docs["z"]]
        # rows that share a doc_id are told apart by their texts
        self.copy = np.fromiter((i in copies and hashlib.sha256(t).digest() in copies[i] for i, t in zip(self.ids.tolist(), self.texts)), bool, len(self.ids))

    def slices(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(documents, starts, bytes, words, place): of each byte the four bytes from it on as a word, and its place in its document."""
        held, size = [], 0
        for d, t in enumerate(self.texts):
            if len(t) >= LENGTH and not self.copy[d]:
                held.append(d)
                size += len(t)
                if size >= SLICE:
                    yield self._slice(held)
                    held, size = [], 0
        if held:
            yield self._slice(held)

    def _slice(self, held: list[int]):
        lengths = np.array([len(self.texts[d]) for d in held], np.int64)
        raw = np.frombuffer(b"".join([*(self.texts[d] for d in held), b"\0\0\0\0"]), np.uint8)
        starts = np.cumsum(lengths) - lengths
        n = int(lengths.sum())
        word = raw[:n].astype(np.uint64)
        for j in (1, 2, 3):
            word |= raw[j : n + j].astype(np.uint64) << np.uint64(8 * j)
        place = np.arange(n, dtype=np.int32) - np.repeat(starts, lengths).astype(np.int32)
        left = np.repeat(lengths, lengths).astype(np.int32) - place
        return np.array(held), starts, raw[:n], word, place, left

    def names(self, buckets: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
        """Of each slice the sampled places and their names; the distinct names, and which occur in two documents."""
        bits = max(1, int(len(self.ids)).bit_length())
        found, every = [], []
        for held, starts, _, word, place, left in self.slices():
            at = np.flatnonzero(_IN_COVER[place % V] & (left >= TUPLE))
            h = word[at].copy()
            for j in range(4, TUPLE, 4):
                h *= _K
                h += word[at + min(j, TUPLE - 4)]
            h = mix(h)
            name = (((h >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32) | (h & np.uint64(0xFFFFFFFF))).astype(np.int64)
            doc = held[np.searchsorted(starts, at, side="right") - 1]
            found.append((at, name))
            every.append(distinct((name << bits) | doc))
        both = np.sort(np.concatenate(every)) if every else np.zeros(0, np.int64)
        names, count = np.unique(both >> bits, return_counts=True)
        return found, names, count > 1

    def windows(self, buckets: int, shared_of: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """(hash, document) of every string of LENGTH bytes through a sampled place with a shared
        name, in the order of documents; and its place in the slice, by slice."""
        found, names, _ = self.names(buckets)
        edge = np.searchsorted(names, np.arange(buckets + 1, dtype=np.int64) << 32)
        keep = np.zeros(len(names), bool)
        for b, blob in shared_of.items():
            n = int(edge[b + 1] - edge[b])
            keep[edge[b] : edge[b + 1]] = np.unpackbits(np.frombuffer(blob, np.uint8), count=n)
        shared = names[keep]
        hashes, docs, places = [], [], []
        for (at, name), (held, starts, _, word, place, left) in zip(found, self.slices()):
            i = np.searchsorted(shared, name)
            hit = at[shared[np.minimum(i, len(shared) - 1)] == name] if len(shared) else at[:0]
            mark = np.zeros(len(place) + 1, np.int32)
            reach = V - 1  # a string through the tuple starts at most that far before it
            np.add.at(mark, hit - np.minimum(reach, place[hit]), 1)
            np.add.at(mark, hit + 1, -1)
            w = np.flatnonzero((np.cumsum(mark[:-1]) > 0) & (left >= LENGTH))
            h = word[w].copy()
            for j in range(4, LENGTH, 4):
                h *= _K
                h += word[w + min(j, LENGTH - 4)]
            hashes.append(mix(h))
            docs.append(held[np.searchsorted(starts, w, side="right") - 1])
            places.append(w)
        none = np.zeros(0, np.int64)
        return np.concatenate(hashes) if hashes else none.view(np.uint64), np.concatenate(docs) if docs else none, places


def _range_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """The range of a hash, in the order of hashes."""
    return ((h >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)


def _squeeze(chunk: Callable[[np.ndarray], np.ndarray]):
    """Texts as compressed bytes with their chunk, for they are shuffled once and stay on disk until the end."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            z = [zlib.compress(t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"", 1) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "z": z, "chunk": chunk(pdf["doc_id"].to_numpy(np.int64))})

    return run


def _copies(marks: pd.DataFrame) -> dict[int, set[bytes]]:
    own, out = marks[marks["kind"] == 2], {}
    for doc, h in zip(own["a"].tolist(), own["blob"].tolist()):
        out.setdefault(doc, set()).add(bytes(h))
    return out


def _bits(marks: pd.DataFrame, kind: int) -> dict[int, bytes]:
    own = marks[marks["kind"] == kind]
    return dict(zip(own["a"].tolist(), own["blob"].tolist()))


def _send_names(buckets: int):
    def run(key: tuple, docs: pd.DataFrame, marks: pd.DataFrame) -> pd.DataFrame:
        _, names, many = Chunk(docs, _copies(marks)).names(buckets)
        edge = np.searchsorted(names, np.arange(buckets + 1, dtype=np.int64) << 32)
        rows = [(b, key[0], pack_sorted(names[i:j] & 0xFFFFFFFF, NAME_LOW), np.packbits(many[i:j]).tobytes()) for b, (i, j) in enumerate(zip(edge[:-1], edge[1:])) if i < j]
        return pd.DataFrame(rows, columns=["bucket", "chunk", "names", "many"])

    return run


def _shared_names(pdf: pd.DataFrame) -> pd.DataFrame:
    """A bit for each name of each chunk: whether another document has it."""
    blocks = [unpack_sorted(x, NAME_LOW).astype(np.uint32) for x in pdf["names"]]
    many = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8), count=len(b)) for m, b in zip(pdf["many"], blocks)])
    every = np.concatenate(blocks)
    ordered = np.sort(every)
    twice = distinct(np.concatenate([ordered[1:][ordered[1:] == ordered[:-1]], every[many > 0]]))
    rows, bucket = [], int(pdf["bucket"].iloc[0])
    for chunk, block, own in zip(pdf["chunk"], blocks, np.split(many, np.cumsum([len(b) for b in blocks])[:-1])):
        hit = twice[np.minimum(np.searchsorted(twice, block), len(twice) - 1)] == block if len(twice) else np.zeros(len(block), bool)
        if hit.any():
            rows.append((chunk, 0, bucket, np.packbits(hit).tobytes()))
    return pd.DataFrame(rows, columns=["chunk", "kind", "a", "blob"])


def _send_windows(buckets: int):
    def run(key: tuple, docs: pd.DataFrame, marks: pd.DataFrame) -> pd.DataFrame:
        hashes, _, _ = Chunk(docs, _copies(marks)).windows(buckets, _bits(marks, 0))
        h = distinct(hashes)
        edge = np.searchsorted(_range_of(h, buckets), np.arange(buckets + 1))
        rows = [(b, key[0], pack_sorted(h[i:j], HASH_LOW)) for b, (i, j) in enumerate(zip(edge[:-1], edge[1:])) if i < j]
        return pd.DataFrame(rows, columns=["bucket", "chunk", "names"])

    return run


def _earlier(pdf: pd.DataFrame) -> pd.DataFrame:
    """A bit for each name of each chunk: whether an earlier chunk has it. Neighbours in the order
    of (name, chunk) are compared."""
    pdf = pdf.sort_values("chunk", kind="stable")
    blocks = [unpack_sorted(x, HASH_LOW) for x in pdf["names"]]
    every = np.concatenate(blocks)
    order = np.argsort(every, kind="stable")
    again = np.zeros(len(every), bool)
    ordered = every[order]
    again[order[1:]] = ordered[1:] == ordered[:-1]
    parts = np.split(again, np.cumsum([len(b) for b in blocks])[:-1])
    bucket = int(pdf["bucket"].iloc[0])
    rows = [(c, 1, bucket, np.packbits(p).tobytes()) for c, p in zip(pdf["chunk"], parts) if p.any()]
    return pd.DataFrame(rows, columns=["chunk", "kind", "a", "blob"])


def _remove(buckets: int):
    def run(key: tuple, docs: pd.DataFrame, marks: pd.DataFrame) -> pd.DataFrame:
        chunk = Chunk(docs, _copies(marks))
        hashes, doc, places = chunk.windows(buckets, _bits(marks, 0))
        names, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        edge = np.searchsorted(_range_of(names, buckets), np.arange(buckets + 1))
        earlier = np.zeros(len(names), bool)
        for b, blob in _bits(marks, 1).items():
            earlier[edge[b] : edge[b + 1]] = np.unpackbits(np.frombuffer(blob, np.uint8), count=int(edge[b + 1] - edge[b]))
        covered = earlier[inverse] | (chunk.ids[doc[first]][inverse] < chunk.ids[doc]) if len(names) else np.zeros(0, bool)
        n = np.array([len(t) for t in chunk.texts], np.int64)
        whole = chunk.copy & (n >= LENGTH)
        removed, spans = np.where(whole, n, 0), whole.astype(np.int64)
        kept: list[bytes] = [b"" if w else t for t, w in zip(chunk.texts, whole)]
        at = 0
        for w, (held, starts, raw, _, place, left) in zip(places, chunk.slices()):
            own = w[covered[at : at + len(w)]]
            at += len(w)
            if not len(own):
                continue
            mark = np.zeros(len(raw) + 1, np.int32)
            np.add.at(mark, own, 1)
            np.add.at(mark, own + LENGTH, -1)
            gone = np.cumsum(mark[:-1]) > 0
            begins = gone & ((place == 0) | ~np.concatenate([[False], gone[:-1]]))
            removed[held] = np.add.reduceat(gone, starts, dtype=np.int64)
            spans[held] = np.add.reduceat(begins, starts, dtype=np.int64)
            ends = np.append(starts[1:], len(raw))
            for d, i, j in zip(held, starts, ends):
                if removed[d]:
                    kept[d] = raw[i:j][~gone[i:j]].tobytes()
        return pd.DataFrame({"doc_id": chunk.ids, "n_bytes": n, "n_removed": removed, "n_spans": spans, "kept": kept})

    return run


def _boundaries(src: DataFrame, chunk_bytes: int, most: int = 100_000) -> tuple[np.ndarray, int, int]:
    """The first doc_ids of `most` or fewer runs of equal bytes, in the order of doc_id, how many
    chunks each run makes, and the least doc_id beyond all."""
    size = src.groupBy("doc_id").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).cast("long").alias("n"))
    total = src.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b"), F.max("doc_id").alias("hi")).first()
    chunks = max(1, -(-int(total["b"]) // chunk_bytes))
    per = -(-chunks // most)
    step = chunk_bytes * per
    at = running(size, ["doc_id"], {"before": F.col("n")})
    first = at.filter(F.floor(F.col("before") / step) != F.floor((F.col("before") + F.col("n")) / step)).select(F.col("doc_id") + 1).collect()  # at most `most` rows
    return np.unique(np.array([r[0] for r in first], np.int64)), per, int(total["hi"] or 0) + 1


def _chunk_of(bounds: np.ndarray, per: int, beyond: int) -> Callable[[np.ndarray], np.ndarray]:
    """The chunks of doc_ids, rising with them: by the run of equal bytes, and evenly over the ids of a run that makes several."""
    ends = np.append(bounds, beyond)

    def chunk(ids: np.ndarray) -> np.ndarray:
        run = np.searchsorted(bounds, ids, side="right")
        if per == 1:
            return run.astype(np.int32)
        lo = np.where(run > 0, bounds[np.maximum(run - 1, 0)], 0)
        share = (ids - lo).astype(float) / np.maximum(1, ends[run] - lo)
        return (run * per + np.clip(share * per, 0, per - 1).astype(np.int64)).astype(np.int32)

    return chunk


def remove_repeats(docs: DataFrame, chunk_bytes: int = 6 << 20) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): kept is the remaining bytes; a row for each row of docs.

    Null texts are empty; rows without a doc_id are left out, for they have no place in the
    order. Texts shorter than LENGTH bytes lose nothing. Rows with one doc_id don't count against
    one another, whether their texts are equal or not. Extra columns are not read; an empty table gives an empty result.
    """
    src = docs.select("doc_id", "text").filter("doc_id is not null")
    bounds, per, beyond = _boundaries(src, chunk_bytes)
    chunks = (len(bounds) + 1) * per
    chunk_of = _chunk_of(bounds, per, beyond)
    by_id = lambda df: df.repartitionById(chunks, F.col("chunk"))
    placed = by_id(src.mapInPandas(_squeeze(chunk_of), "doc_id long, z binary, chunk int"))
    narrow = cut(src.filter("octet_length(text) > 0").select("doc_id", F.unhex(F.sha2("text", 256)).alias("h")))
    first = narrow.groupBy("h").agg(F.min("doc_id").alias("first"), F.count("*").alias("c")).filter("c > 1")
    copies = join_counted(narrow, first, ["h"], narrow.count()).filter("doc_id > first").select("doc_id", "h")
    # a step of its own, so that no task needs a second Python worker
    chunk = F.pandas_udf(lambda x: pd.Series(chunk_of(x.to_numpy(np.int64))), "int")
    copies = cut(copies).select(chunk("doc_id").alias("chunk"), F.lit(2).alias("kind"), F.col("doc_id").alias("a"), F.col("h").alias("blob"))
    copies = cut(copies)
    marks = "chunk int, kind int, a long, blob binary"
    by_chunk = placed.groupBy("chunk")
    sent = by_chunk.cogroup(by_id(copies).groupBy("chunk")).applyInPandas(_send_names(chunks), "bucket int, chunk int, names binary, many binary")
    shared = sent.repartitionById(chunks, F.col("bucket")).groupBy("bucket").applyInPandas(_shared_names, marks)
    told = copies.unionByName(shared)
    sent = by_chunk.cogroup(by_id(told).groupBy("chunk")).applyInPandas(_send_windows(chunks), "bucket int, chunk int, names binary")
    earlier = sent.repartitionById(chunks, F.col("bucket")).groupBy("bucket").applyInPandas(_earlier, marks)
    return by_chunk.cogroup(by_id(told.unionByName(earlier)).groupBy("chunk")).applyInPandas(_remove(chunks), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op7_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
