"""Operator 3: benchmark decontamination by a prefix-filtered set join.

An item window is a set of word shingles. A document holds the window only if it holds all of
them, so one shingle of each window, its rarest over all documents, is a sufficient prefix.
Documents are read twice: to count the shingles of windows, and to find the prefixes. Both times
a bitmap of fixed size, whatever the number of windows, leaves out most shingles before the
exact join by hash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, cut, let, row_key, table

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
MAP_WORDS = 1 << 17  # longs of the bitmap: a megabyte


def item_words(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD), lambda w: w != "")


def windows(items: DataFrame, size: int, shingle: int) -> DataFrame:
    """(item_id, window, k): the distinct windows of the items; k is the length of their shingles."""
    one = items.select(F.col("item_id").cast("string").alias("item_id"), item_words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    each = let(F.col("w"), lambda w: F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - size, F.lit(0))), lambda i: F.slice(w, i + 1, F.least(F.size(w), F.lit(size)))))
    return one.select("item_id", F.explode(F.array_distinct(each)).alias("window")).distinct().withColumn("k", F.least(F.size("window"), F.lit(shingle)))


def _hash(w: Column, i: Column, k: int) -> Column:
    return F.xxhash64(*[F.get(w, i + j) for j in range(k)])


def _places(w: Column, k: int) -> Column:
    return F.when(F.size(w) >= k, F.sequence(F.lit(0), F.size(w) - k)).otherwise(F.array().cast("array<int>"))


def bitmap(hashes: DataFrame) -> DataFrame:
    """One row with an array of MAP_WORDS longs, in which each hash h sets a bit."""
    bits = hashes.groupBy(F.pmod(F.shiftrightunsigned("h", 6), F.lit(MAP_WORDS)).alias("id")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("b"))
    full = hashes.sparkSession.range(MAP_WORDS).join(bits, "id", "left").select(F.struct("id", F.coalesce("b", F.lit(0)).alias("b")).alias("s"))
    return full.agg(F.transform(F.sort_array(F.collect_list("s")), lambda x: x["b"]).alias("map"))


def _in_map(bits: Column, h: Column) -> Column:
    return F.get(bits, F.pmod(F.shiftrightunsigned(h, 6), F.lit(MAP_WORDS)).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(63).cast("int"))) != 0


def _wanted(words: Column, bits: Column, ks: list[int], give: Callable[[Column, Column, Column, int], Column]) -> Column:
    """give(words, place, hash, k) for each shingle of a text, of each length of ks, that the bitmap lets through."""

    def of(s: Column, k: int) -> Column:
        # hashed again where found, which is rare, instead of a struct for every shingle
        found = F.filter(_places(s["w"], k), lambda i: _in_map(s["m"], _hash(s["w"], i, k)))
        return F.transform(found, lambda i: give(s["w"], i, _hash(s["w"], i, k), k))

    def one(s: Column) -> Column:
        return F.concat(*[of(s, k) for k in ks])

    return let(F.struct(words.alias("w"), bits.alias("m")), one)


def window_hits(docs: DataFrame, items: DataFrame, size: int = 10, shingle: int = 3) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """Three tables: (doc_id, _key, n_words) of every row of docs; (_key, window, start, length) of
    every occurrence of a window, None if no item has words; (item_id, window, k) of the items."""
    item = cut(windows(items, size, shingle))
    docs = docs.select("doc_id", "text")
    words = item_words(F.col("text"))
    ks = [r["k"] for r in item.select("k").distinct().orderBy("k").collect()]  # at most `shingle` rows
    if not ks:
        every = docs.select("doc_id", row_key().alias("_key"), F.size(words).cast("long").alias("n_words"))
        return every, None, item
    one = item.select("window", "k").distinct()
    parts = one.select("window", "k", F.explode(F.expr(" ".join(["CASE k", *[f"WHEN {k} THEN transform(sequence(0, size(window) - {k}), i -> struct(i AS offset, xxhash64({', '.join(f'get(window, i + {j})' for j in range(k))}) AS h))" for k in ks], "END"]))).alias("s")).select("window", "k", "s.*")
    parts = cut(parts)
    bits = bitmap(parts.select("h")).scalar()
    seen = docs.withColumn("_m", bits).select(F.explode(_wanted(words, F.col("_m"), ks, lambda w, i, h, k: h)).alias("h")).groupBy("h").agg(F.count("*").alias("df"))
    # the rarest shingle of each window, ties by place; windows with a shingle that no document has go
    ranked = parts.join(seen, "h", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    prefix = ranked.groupBy("window", "k").agg(F.min(F.struct("df", "offset", "h")).alias("p")).filter("p.df > 0").select("window", "k", "p.offset", "p.h")
    prefix = cut(prefix)

    def take(w: Column, i: Column, h: Column, k: int) -> Column:
        lead = F.least(i, F.lit(size))
        return F.struct(h.alias("h"), F.lit(k).alias("k"), i.alias("i"), F.slice(w, i - lead + 1, lead + size).alias("around"), lead.alias("lead"))

    bits = bitmap(prefix.select("h")).scalar()
    every = docs.withColumn("_m", bits).select("doc_id", row_key().alias("_key"), F.size(words).cast("long").alias("n_words"), _wanted(words, F.col("_m"), ks, take).alias("near"))
    every = cut(every)
    match = every.filter(F.size("near") > 0).select("_key", "n_words", F.explode("near").alias("s")).select("_key", "n_words", "s.*").join(prefix, ["h", "k"])
    # length and positional bounds, then exact containment
    match = match.filter((F.col("i") >= F.col("offset")) & (F.col("i") - F.col("offset") + F.size("window") <= F.col("n_words")))
    match = match.filter(F.slice("around", F.col("lead") - F.col("offset") + 1, F.size("window")) == F.col("window"))
    match = match.select("_key", "window", (F.col("i") - F.col("offset")).alias("start"), F.size("window").alias("length"))
    return every.drop("near"), match, item


def without_contaminated(docs: DataFrame, items: DataFrame, size: int = 10, shingle: int = 3) -> DataFrame:
    """The rows of docs that decontaminate() doesn't mark, each row judged on its own."""
    _, match, _ = window_hits(docs, items.select("item_id", "text"), size, shingle)
    return docs if match is None else docs.withColumn("_key", row_key()).join(match.select("_key").distinct(), "_key", "left_anti").select(docs.columns)


def decontaminate(docs: DataFrame, items: DataFrame, size: int = 10, shingle: int = 3) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated), a row for each row of docs.

    Null and empty texts have no words and no hits; items without words never match, items of
    fewer than `size` words match as one window. Each row is judged by its own text, whether its
    doc_id is its own, shared or null; repeated rows get equal results. Extra columns are not
    read. Empty tables give an empty result or no hits.
    """
    every, match, item = window_hits(docs, items.select("item_id", "text"), size, shingle)
    if match is None:
        return every.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), F.sha2(F.lit(""), 256).alias("items_sha256"), F.lit(False).alias("contaminated"))
    match = cut(match.distinct())

    def step(acc: Column, x: Column) -> Column:
        end = x["start"] + x["length"]
        return F.struct((acc["n"] + F.greatest(F.lit(0), end - F.greatest(acc["end"], x["start"]))).alias("n"), F.greatest(acc["end"], end).alias("end"))

    covered = F.aggregate(F.sort_array("s"), F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step)["n"]
    hit = match.groupBy("_key").agg(F.collect_set(F.struct("start", "length")).alias("s")).select("_key", covered.alias("n_hit"))
    # windows meet their items after they are found, so an occurrence isn't repeated for each item
    own = match.select("_key", "window").distinct().join(item.select("window", "item_id"), "window").groupBy("_key").agg(F.collect_set("item_id").alias("items"))
    own = own.select("_key", F.size("items").alias("n_items"), F.array_join(F.sort_array("items"), ",").alias("items"))
    out = every.join(hit.join(own, "_key"), "_key", "left")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP3_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{NOT_WORD}'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{NOT_WORD}'), lambda x: x <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + 9], ' ') AS x FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT rid, i, n, array_to_string(w[i : i + n - 1], ' ') AS x FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n)),
m AS (SELECT rid, item_id, i, dw.n FROM dw JOIN bw ON dw.n = bw.n AND dw.x = bw.x),
h AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM m) GROUP BY 1),
k AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT rid, item_id FROM m) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN k USING (rid)"""
