"""Operator 13: Merkle manifest of a dataset by superblock reduction.

Leaves of a group are numbered in order. Their indices are bucketed by fanout^k, `applyInPandas`
collapses k levels of a bucket at once, and the buckets' roots are reduced in the same way until
each group has one; then the roots of groups. On the way down a node's lower proof is followed by
the upper proof of its bucket. A bucket holds at most fanout^k nodes, whatever the size of a group.
"""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.frames import running, with_rank
from .common import cut, join_counted, table

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_digest(values: Sequence[Column | str]) -> Column:
    """Lowercase hex sha256 of the values, each `-` if null, else its UTF-8 byte count, `:` and itself. For strings and integers."""
    text = [(F.col(v) if isinstance(v, str) else v).cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]), 256)


def _collapse(fanout: int, levels: int):
    """Of a bucket's nodes (r, i, n, digest) the siblings on the way up to the bucket's root, and that root."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i", kind="stable")
        now, left, beside = [bytes(d).hex() for d in pdf["digest"]], int(pdf["n"].iloc[0]), []
        for _ in range(levels):
            if left == 1:  # of the whole group, not of this bucket
                break
            up, own = [], []
            for q in range(0, len(now), fanout):
                whole, size = "".join(now[q : q + fanout]), len(now[q : q + fanout])
                up.append(sha256(whole.encode()).hexdigest())
                own += [whole[: 64 * j] + whole[64 * j + 64 :] for j in range(size)]
            beside.append(own)
            now, left = up, -(-left // fanout)
        paths = [bytes.fromhex("".join(s[j // fanout**level] for level, s in enumerate(beside))) for j in range(len(pdf))]
        return pd.DataFrame({"r": pdf["r"], "i": pdf["i"], "path": paths, "root": bytes.fromhex(now[0])})

    return run


def _reduce(nodes: DataFrame, fanout: int, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """nodes: (r, i, n, digest), n the nodes of group r. Returns for each step (r, i, path, root), and
    (r, digest) with the root of every group."""
    span, steps = fanout**levels, []
    while True:
        done = nodes.filter("n = 1").select("r", "i", F.unhex(F.lit("")).alias("path"), F.col("digest").alias("root"))
        at = F.floor(F.col("i") / span)
        made = nodes.filter("n > 1").groupBy("r", at.alias("_b")).applyInPandas(_collapse(fanout, levels), "r long, i long, path binary, root binary")
        step = cut(made.unionByName(done))
        steps.append(step)
        most = nodes.agg(F.max("n")).first()[0] or 0
        roots = step.filter(F.col("i") % span == 0).select("r", at.alias("i"), F.col("root").alias("digest"))
        if most <= span:
            return steps, roots.drop("i")
        n = nodes.filter("i = 0").select("r", F.ceil(F.col("n") / span).alias("n"))
        nodes = cut(roots.join(n, "r").select("r", "i", "n", "digest"))


def _proofs(steps: list[DataFrame], top: DataFrame, fanout: int, levels: int) -> DataFrame:
    """(r, i, path and top's columns) of the nodes of the first step; top: (r, path, ...) of every group.
    Each node takes the path of its bucket, of which there is one in fanout^k nodes."""
    span, up = fanout**levels, None
    more = [c for c in top.columns if c not in ("r", "path")]
    for step in reversed(steps):
        low = step.select("r", "i", F.col("path").alias("_low"), F.floor(F.col("i") / span).alias("_b"))
        high = top.select("r", F.lit(0).cast("long").alias("_b"), F.col("path").alias("_high"), *more) if up is None else up.select("r", F.col("i").alias("_b"), F.col("path").alias("_high"), *more)
        up = low.join(high, ["r", "_b"]).select("r", "i", F.concat("_low", "_high").alias("path"), *more)
    return up


def merkle_manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, group: str = "source", order: str = "doc_id", fanout: int = 3, levels: int = 6, keep: Sequence[str] = ()) -> DataFrame:
    """(order, keep..., leaf, subroot, root, place, n_leaves, group_place, n_groups, proof), a row for each row of docs.

    leaf: the digest of `fields`. Within a group (nulls are one, the first) leaves ascend by `order`,
    nulls first, and of one another's equals by their digest; rows equal in every field are equal leaves in
    neighbouring places. proof: the siblings' digests from the leaf to the root of all, 32 bytes
    each; with the places and sizes it folds a leaf to the root (`fold`). Null and empty values are told
    apart, texts may have any length (they are hashed where they are read and never shuffled). Columns
    that are in neither fields, group, order nor keep are not read, so names don't clash; an empty table
    gives an empty result.
    """
    if fanout < 2 or levels < 1:
        raise ValueError("fanout must be 2 or more, levels 1 or more")
    key = F.coalesce(F.concat(F.lit("s"), F.col(group).cast("string")), F.lit("n"))  # null first, no nulls in joins
    kept = [F.col(k).alias(f"_k_{k}") for k in keep]
    leaves = cut(docs.select(key.alias("_g"), F.col(order).alias("_o"), F.unhex(leaf_digest(fields)).alias("digest"), *kept))
    groups = with_rank(leaves.groupBy("_g").agg(F.count("*").alias("c")), ["_g"], "r")
    groups = cut(groups)
    n_groups, total = (x or 0 for x in groups.agg(F.count("*"), F.sum("c")).first())
    placed = running(leaves, ["_o", "digest"], {"i": F.lit(1).cast("long")}, ["_g"])
    placed = cut(join_counted(placed, groups, ["_g"], total).withColumnRenamed("c", "n").drop("_g"))
    steps, subroots = _reduce(placed.select("r", "i", "n", "digest"), fanout, levels)
    subroots = cut(subroots)
    up, root = _reduce(subroots.select(F.lit(0).cast("long").alias("r"), F.col("r").alias("i"), F.lit(n_groups).cast("long").alias("n"), "digest"), fanout, levels)
    all_groups = root.select("r", F.unhex(F.lit("")).alias("path"), F.col("digest").alias("root"))  # one row
    top = _proofs(up, all_groups, fanout, levels).select(F.col("i").alias("r"), "path", "root").join(subroots.withColumnRenamed("digest", "subroot"), "r")
    proof = _proofs(steps, cut(top), fanout, levels)
    hexed = lambda c: F.lower(F.hex(c)).alias(c)
    out = placed.withColumnRenamed("digest", "leaf").join(proof, ["r", "i"])
    return out.select(F.col("_o").alias(order), *[F.col(f"_k_{k}").alias(k) for k in keep], hexed("leaf"), hexed("subroot"), hexed("root"), F.col("i").alias("place"), F.col("n").alias("n_leaves"), F.col("r").alias("group_place"), F.lit(n_groups).cast("long").alias("n_groups"), F.col("path").alias("proof"))


def proof_digest(proof: Column | str = "proof") -> Column:
    """The digest of a proof's siblings as hex text."""
    return F.sha2(F.lower(F.hex(proof)), 256)


def fold(leaf: Column | str, fanout: int = 3) -> Column:
    """The root that a leaf's digest gives with the proof, places and sizes of its row of the manifest."""

    @F.pandas_udf("string")
    def up(leaf: pd.Series, proof: pd.Series, place: pd.Series, n: pd.Series, group: pd.Series, groups: pd.Series) -> pd.Series:
        out = []
        for now, path, *where in zip(leaf, proof, place, n, group, groups):
            path, at = bytes(path).hex(), 0
            for i, left in (where[:2], where[2:]):
                while left > 1:
                    q, j = divmod(i, fanout)
                    others = 64 * (min(fanout, left - q * fanout) - 1)
                    run = path[at : at + others]
                    now = sha256(f"{run[: 64 * j]}{now}{run[64 * j :]}".encode()).hexdigest()
                    i, left, at = q, -(-left // fanout), at + others
            out.append(now)
        return pd.Series(out, dtype=object)

    return up(leaf, "proof", "place", "n_leaves", "group_place", "n_groups")


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))
    claimed = F.when(tampered, leaf_digest([*FIELDS[:-1], F.replace("text", F.lit("\n"), F.lit(""))]))
    out = merkle_manifest(docs.withColumn("claimed", claimed), keep=["claimed"])
    out = out.withColumn("folded_root", fold(F.coalesce("claimed", "leaf")))
    return out.select("doc_id", "leaf", "subroot", "root", proof_digest().alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: crc32 of a decimal doc_id, bit by bit.
_CRC32 = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda k: ascii(substr(doc_id::VARCHAR, k, 1))::BIGINT)),
      lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))))"""

OP13_SQL = r"""
WITH RECURSIVE l AS (
  SELECT doc_id, source, sha256(concat(
      CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id END,
      CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END,
      CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END,
      CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END,
      CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END)) AS leaf,
    sha256(concat(
      CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id END,
      CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END,
      CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END,
      CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END,
      CASE WHEN text IS NULL THEN '-' ELSE strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), '') END)) AS claimed
  FROM documents),
p AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS r, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
    count(*) OVER (PARTITION BY source) AS n
  FROM l),
tree AS (
  SELECT r, 0 AS lvl, i, n, leaf AS d FROM p
  UNION ALL
  SELECT r, lvl + 1, i // 3, (n + 2) // 3, sha256(string_agg(d, '' ORDER BY i)) FROM tree WHERE n > 1 GROUP BY r, lvl, i // 3, n),
sub AS (SELECT r, max(lvl) AS h, max_by(d, lvl) AS d FROM tree WHERE n = 1 GROUP BY r),
top AS (
  SELECT 0 AS lvl, r AS i, (SELECT count(*) FROM sub) AS n, d FROM sub
  UNION ALL
  SELECT lvl + 1, i // 3, (n + 2) // 3, sha256(string_agg(d, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY lvl, i // 3, n),
root AS (SELECT d, lvl AS h FROM top WHERE n = 1),
step AS (
  SELECT p.r, p.i, t.lvl, string_agg(t.d, '' ORDER BY t.i) FILTER (t.i < p.i // CAST(power(3, t.lvl) AS BIGINT)) AS before,
    string_agg(t.d, '' ORDER BY t.i) FILTER (t.i > p.i // CAST(power(3, t.lvl) AS BIGINT)) AS after
  FROM p JOIN tree t ON p.r = t.r AND t.n > 1 AND t.i // 3 = p.i // CAST(power(3, t.lvl + 1) AS BIGINT)
  GROUP BY p.r, p.i, t.lvl
  UNION ALL
  SELECT p.r, p.i, sub.h + t.lvl, string_agg(t.d, '' ORDER BY t.i) FILTER (t.i < p.r // CAST(power(3, t.lvl) AS BIGINT)),
    string_agg(t.d, '' ORDER BY t.i) FILTER (t.i > p.r // CAST(power(3, t.lvl) AS BIGINT))
  FROM p JOIN sub ON p.r = sub.r JOIN top t ON t.n > 1 AND t.i // 3 = p.r // CAST(power(3, t.lvl + 1) AS BIGINT)
  GROUP BY p.r, p.i, sub.h + t.lvl),
folded AS (
  SELECT r, i, 0 AS lvl, CASE WHEN crc % 2 = 0 THEN claimed ELSE leaf END AS d FROM (SELECT *, CRC32 AS crc FROM p)
  UNION ALL
  SELECT f.r, f.i, f.lvl + 1, sha256(coalesce(s.before, '') || f.d || coalesce(s.after, '')) FROM folded f JOIN step s ON s.r = f.r AND s.i = f.i AND s.lvl = f.lvl),
last AS (SELECT r, i, max_by(d, lvl) AS d FROM folded GROUP BY r, i),
proof AS (SELECT r, i, sha256(string_agg(coalesce(before, '') || coalesce(after, ''), '' ORDER BY lvl)) AS h FROM step GROUP BY r, i)
SELECT p.doc_id, p.leaf, sub.d AS subroot, root.d AS root, coalesce(proof.h, sha256('')) AS proof_sha256, last.d AS folded_root, last.d = root.d AS verified
FROM p JOIN sub ON p.r = sub.r CROSS JOIN root JOIN last ON last.r = p.r AND last.i = p.i LEFT JOIN proof ON proof.r = p.r AND proof.i = p.i
""".replace("CRC32", _CRC32)
