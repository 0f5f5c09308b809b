"""Operator 6: language-model scoring by prediction by partial matching (PPM).

The model is a byte-context trie kept as a table: the training count of every gram of `ORDER`
context symbols and the symbol after them, over all training documents. Shorter contexts are
sums of longer ones. Escapes are estimated by method C (the distinct symbols of a context), and
symbols seen in a longer context are excluded from the shorter ones. The cost of each gram is
worked out once, in the table; documents then look their grams up in the dictionary of their
chunk, so no task holds more than one chunk and its own grams. A trie group holds the grams of one
pair of bytes, a number that the alphabet bounds and the corpus does not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordIds, chunks_for, table

ORDER = 4
BITS = 9  # of a symbol: 0 is the start and the end of a text, 1 to 256 are bytes
SYMBOLS = 257
CHUNK_SHIFT = 36  # a packed long holds the chunk above and a count below
COUNT = (1 << CHUNK_SHIFT) - 1
GRAM = -2  # grams are looked up under GRAM less their code, below the keys of words
END = -1  # the key of the end token; words hash to keys of 62 bits
SLICE = 1 << 20


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 2, F.lit(False))


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int, list[bytes]]]:
    """(first, end, texts as bytes) of runs of about SLICE bytes."""
    first, held, size = 0, [], 0
    for i, t in enumerate(texts):
        held.append(t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"")
        size += len(held[-1])
        if size >= SLICE:
            yield first, i + 1, held
            first, held, size = i + 1, [], 0
    if held:
        yield first, len(texts), held


def gram_codes(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The gram that ends at each byte and at the end of each text, and how many each text has."""
    sizes = np.array([len(t) for t in texts], np.int64) + 1
    sep = b"\0" * order
    seq = np.frombuffer(sep + sep.join(texts) + sep, np.uint8).astype(np.int64) + 1
    # a text's own end mark is the first of the order separators that follow it
    ends = order + np.cumsum(sizes - 1 + order) - order
    is_sep = np.zeros(len(seq) + 1, np.int32)
    is_sep[0] += 1
    is_sep[order] -= 1
    np.add.at(is_sep, ends, 1)
    np.add.at(is_sep, ends + order, -1)
    gaps = np.cumsum(is_sep[:-1]) > 0
    seq[gaps] = 0
    valid = ~gaps
    valid[ends] = True
    code = seq[: len(seq) - order].copy()
    for j in range(1, order + 1):
        code <<= BITS
        code |= seq[j : len(seq) - order + j]
    return code[valid[order:]], sizes


def _word_keys(texts: list[bytes], ids: WordIds) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the tokens of each text, its end token last, and how many each text has."""
    words = [t.lower().split() for t in texts]
    sizes = np.array([len(w) for w in words], np.int64) + 1
    out = np.full(int(sizes.sum()), END, np.int64)
    flat = [w for ws in words for w in ws]
    keep = np.ones(len(out), bool)
    keep[np.cumsum(sizes) - 1] = False
    out[keep] = (ids.of(flat) >> np.uint64(2)).astype(np.int64)
    return out, sizes


def _tally(keys: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and how often each is a training one."""
    both, n = np.unique(keys * 2 + train, return_counts=True)
    uniq, at = np.unique(both >> 1, return_index=True)
    total = np.add.reduceat(np.where(both & 1, n, 0), at) if len(at) else n
    return uniq, total


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return keys, np.bincount(inverse, np.concatenate([p[1] for p in parts]), len(keys)).astype(np.int64)


def _chunk_tallies(kind: str):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        chunk, ids, parts = int(pdf["chunk"].iloc[0]), WordIds(), []
        train = ~pdf["held_out"].to_numpy(bool)
        for first, end, texts in _slices(pdf["text"].tolist()):
            keys, sizes = gram_codes(texts) if kind == "gram" else _word_keys(texts, ids)
            parts.append(_tally(keys, np.repeat(train[first:end], sizes)))
        keys, n = _merge(parts)
        return pd.DataFrame({"key": keys, "v": n + (chunk << CHUNK_SHIFT)})

    return run


def _low_orders(pdf: pd.DataFrame) -> pd.DataFrame:
    """From the counts of (context byte, symbol), at most SYMBOLS squared rows, everything that
    orders 1 and 0 need for any pair of symbols."""
    c1 = np.zeros((SYMBOLS, SYMBOLS))
    pair = pdf["pair"].to_numpy(np.int64)
    c1[pair >> BITS, pair & (2**BITS - 1)] = pdf["c"].to_numpy()
    c0 = c1.sum(axis=0)
    x, s = np.divmod(np.arange(SYMBOLS * SYMBOLS), SYMBOLS)
    return pd.DataFrame({
        "pair": (x << BITS) + s, "c1": c1[x, s], "n1": c1.sum(axis=1)[x], "q1": (c1 > 0).sum(axis=1)[x].astype(float), "e0": ((c1 > 0) @ c0)[x],
        "c0": c0[s], "n0": c0.sum(), "q0": float((c0 > 0).sum()),
    })


def trie_costs(pdf: pd.DataFrame) -> pd.DataFrame:
    """log10 of the probability of the last symbol of each gram; all grams with one two-symbol context."""
    g, n = pdf["key"].to_numpy(np.int64), pdf["n"].to_numpy(np.float64)
    log, open_ = np.zeros(len(g)), np.ones(len(g), bool)

    def level(c: np.ndarray, total: np.ndarray, kinds: np.ndarray) -> None:
        """One order: c of the symbol, total and distinct symbols that are not excluded."""
        nonlocal open_
        usable = open_ & (kinds > 0)
        hit = usable & (c > 0)
        out = usable & ~hit
        log[hit] += np.log10(c[hit] / (total[hit] + kinds[hit]))
        log[out] += np.log10(kinds[out] / (total[out] + kinds[out]))
        open_ &= ~hit

    above = None  # of the next longer context: grams, whether seen, context of each, row of each input
    q_above = np.zeros(len(g))
    for k in range(ORDER, 0, -1):
        if k > 1:
            grams, first, inv = np.unique(g & ((1 << BITS * (k + 1)) - 1), return_index=True, return_inverse=True)
            c = np.bincount(inv, n, len(grams))
            _, ctx = np.unique(grams >> BITS, return_inverse=True)
            total, kinds = np.bincount(ctx, c)[ctx][inv], np.bincount(ctx, c > 0)[ctx][inv]
            own = c[inv]
        else:
            own, total, kinds = (pdf[x].to_numpy(np.float64) for x in ("c1", "n1", "q1"))
        excluded = np.zeros(len(g))
        if above is not None:
            a_grams, a_seen, a_ctx, a_inv, a_first = above
            lower = own[a_first] * a_seen
            excluded = np.bincount(a_ctx, lower)[a_ctx][a_inv]
        level(own, total - excluded, kinds - q_above)
        q_above = kinds
        if k > 1:
            above = (grams, c > 0, ctx, inv, first)
    c0, n0, q0, e0 = (pdf[x].to_numpy(np.float64) for x in ("c0", "n0", "q0", "e0"))
    level(c0, n0 - e0, q0 - q_above)
    log[open_] -= np.log10(SYMBOLS - q0[open_])
    return pd.DataFrame({"key": g, "value": log})


class Lookup:
    """Values of sorted keys, by one probe of a hashed index; what that misses is searched for."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        self.shift = np.uint64(64 - max(8, int(len(keys)).bit_length() + 2))
        self.index = np.zeros(1 << (64 - int(self.shift)), np.int32)
        if len(keys):
            self.index[self._slot(self.keys)] = np.arange(len(keys), dtype=np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self.index[self._slot(keys)]
        missed = np.flatnonzero(self.keys[at] != keys)
        at[missed] = np.searchsorted(self.keys, keys[missed])
        return self.values[at]


def _score_chunk(docs: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
    key, value = found["key"].to_numpy(np.int64), found["value"].to_numpy(np.float64)
    gram = key < END
    words, grams = Lookup(key[~gram], value[~gram]), Lookup(GRAM - key[gram], value[gram])
    ids, rows = WordIds(), []
    for _, _, texts in _slices(docs["text"].tolist()):
        keys, sizes = _word_keys(texts, ids)
        at = np.cumsum(sizes) - sizes
        c = words(keys)
        codes, lengths = gram_codes(texts)
        score = np.add.reduceat(grams(codes), np.cumsum(lengths) - lengths)
        rows.append((sizes, np.add.reduceat((c > 0).astype(np.int64), at), np.add.reduceat(np.log10(c + 1), at), score))
    out = {c: np.concatenate([r[i] for r in rows]) for i, c in enumerate(("n_tokens", "n_known", "logs", "score"))} if rows else {c: [] for c in ("n_tokens", "n_known", "logs", "score")}
    return pd.DataFrame({"doc_id": docs["doc_id"], "held_out": docs["held_out"], **out})


def score_documents(docs: DataFrame, chunk_bytes: int = 12 << 20) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row for each row of docs.

    Null texts are empty; an empty text is scored by its end alone. With no training document
    every symbol has probability 1/257. A null doc_id is a training document's. Repeated rows count and are scored as often as they
    occur. Extra columns are not read; an empty table gives an empty result.
    """
    chunks = chunks_for(docs, "text", chunk_bytes)
    src = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int").alias("chunk")).repartitionById(chunks, "chunk")  # a task a chunk
    by_chunk = src.groupBy("chunk")
    # a packed value keeps every reader of these two tables on the same columns, so each is made and shuffled once
    words = by_chunk.applyInPandas(_chunk_tallies("word"), "key long not null, v long not null").repartition("key")
    grams = by_chunk.applyInPandas(_chunk_tallies("gram"), "key long not null, v long not null").repartition("key")
    total = F.sum(F.col("v").bitwiseAND(COUNT))
    word_counts = words.groupBy("key").agg(total.alias("n"))
    gram_counts = grams.groupBy("key").agg(total.alias("n"))
    pairs = gram_counts.groupBy((F.col("key").bitwiseAND((1 << 2 * BITS) - 1)).alias("pair")).agg(F.sum("n").alias("c"))
    low = pairs.groupBy().applyInPandas(_low_orders, "pair long, c1 double, n1 double, q1 double, e0 double, c0 double, n0 double, q0 double")
    wide = gram_counts.withColumn("pair", F.col("key").bitwiseAND((1 << 2 * BITS) - 1)).join(F.broadcast(low), "pair", "left")  # at most 257 squared rows
    costs = wide.withColumn("ctx", F.shiftright("key", BITS).bitwiseAND((1 << 2 * BITS) - 1)).groupBy("ctx").applyInPandas(trie_costs, "key long, value double")
    chunk = F.shiftright("v", CHUNK_SHIFT).cast("int").alias("chunk")
    found = words.join(word_counts, "key").select(chunk, "key", F.col("n").cast("double").alias("value"))
    found = found.unionByName(grams.join(costs, "key").select(chunk, (F.lit(GRAM) - F.col("key")).alias("key"), "value"))
    out = by_chunk.cogroup(found.repartitionById(chunks, "chunk").groupBy("chunk")).applyInPandas(_score_chunk, "doc_id long, held_out boolean, n_tokens long, n_known long, logs double, score double")
    size = word_counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_if(F.col("n") > 0).alias("v"))
    out = out.withColumns({"train_tokens": size.select("n").scalar(), "_v": size.select("v").scalar()})
    base = F.col("logs") - F.col("n_tokens") * F.log10(F.col("train_tokens") + F.col("_v") + 1)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", base.alias("base_score"), "score")


def op6_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
