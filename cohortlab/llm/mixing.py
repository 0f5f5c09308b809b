"""Operator 5: mixing sources to target weights by temperature.

Token shares are raised to an exponent found by bisection; the weights are then realised as
whole passes over each source plus whole blocks, and one part of a block, of a further pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.frames import running
from .common import cut, let, row_key, table, words


def _uniform(*cols: Column | str) -> Column:
    """A number in [0, 1) from a hash, the same in every run."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 40)) / F.lit(float(1 << 40))


def bisect_exponent(shares: DataFrame, max_repeats: float | None, target_entropy: float | None, steps: int = 40) -> float:
    """The exponent in [0, 1] whose weights meet the limit, to 2**-steps.

    shares: (source, tokens). Of the weights p**a / sum(p**a), the entropy falls with a (for a
    >= 0), and so do the repeats of the smallest source against the largest. target_entropy is
    in nats, a least value: the largest a that meets it changes shares least. max_repeats is the
    most passes over any source when every source is passed at least once: the least a that
    meets it is the flattest allowed. The whole bisection is one expression over one row with
    the shares of all sources, 8 bytes a source.
    """
    if max_repeats is None and target_entropy is None:
        return 1.0
    one = shares.agg(F.sort_array(F.collect_list(F.col("tokens").cast("double"))).alias("t")).filter(F.size("t") > 0)
    one = one.select(F.transform("t", lambda x: x / F.aggregate("t", F.lit(0.0), lambda a, y: a + y)).alias("p"))

    def fits(a: Column) -> Column:
        z = F.aggregate("p", F.lit(0.0), lambda s, x: s + F.pow(x, a))
        log = F.aggregate("p", F.lit(0.0), lambda s, x: s + F.pow(x, a) * F.log(x))
        ok = F.lit(True)
        if target_entropy is not None:
            ok &= F.log(z) - a * log / z >= target_entropy
        if max_repeats is not None:
            ok &= F.pow(F.array_min("p") / F.array_max("p"), a - 1) <= max_repeats
        return ok

    up = target_entropy is not None  # whether a that meets the limit lets the next be larger

    def step(acc: Column, _: Column) -> Column:
        half = let((acc["lo"] + acc["hi"]) / 2, lambda m: F.struct(m.alias("m"), fits(m).alias("ok")))
        return let(half, lambda h: F.when(h["ok"] == up, F.struct(h["m"].alias("lo"), acc["hi"].alias("hi"))).otherwise(F.struct(acc["lo"].alias("lo"), h["m"].alias("hi"))))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi")), step)
    if up:
        a = F.when(fits(F.lit(1.0)), 1.0).when(~fits(F.lit(0.0)), 0.0).otherwise(found["lo"])
    else:
        a = F.when(fits(F.lit(0.0)), 0.0).otherwise(found["hi"])
    row = one.select(a.alias("a")).first()
    return row["a"] if row else 1.0


def source_weights(docs: DataFrame, max_repeats: float | None = 2.0, target_entropy: float | None = None, budget: float | None = None, steps: int = 40) -> DataFrame:
    """(source, tokens, weight, target, passes, rest): what each source is to give.

    budget is in tokens; by default it is the least with which every source is passed once.
    rest is the tokens of the pass that is not whole. Null sources are one source of their own.
    """
    shares = cut(docs.groupBy("source").agg(F.sum("n_tokens").alias("tokens")).filter("tokens > 0"))
    a = bisect_exponent(shares, max_repeats, target_entropy, steps)
    mass = shares.withColumn("m", F.pow(F.col("tokens").cast("double"), F.lit(a)))
    z = mass.agg(F.sum("m").alias("z"), F.max(F.col("tokens") / F.col("m")).alias("per")).first()
    if z["z"] is None:
        return mass.select("source", "tokens", F.lit(0.0).alias("weight"), F.lit(0.0).alias("target"), F.lit(0).cast("long").alias("passes"), F.lit(0.0).alias("rest"))
    whole = z["per"] * z["z"] if budget is None else float(budget)
    out = mass.withColumn("weight", F.col("m") / F.lit(z["z"])).withColumn("target", F.col("weight") * F.lit(whole))
    # rounded: a source that sets the budget is passed once, not 0.999999 times
    passes = F.floor(F.round(F.col("target") / F.col("tokens"), 9))
    return out.withColumn("passes", passes).withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("passes") * F.col("tokens"))).drop("m")


def mix_sources(docs: DataFrame, max_repeats: float | None = 2.0, target_entropy: float | None = None, budget: float | None = None, block_docs: int = 1000, seed: int = 7) -> DataFrame:
    """Adds n_tokens, weight, pass, block, place and mix_key; a row for each time a document is used.

    Every source is passed `passes` times whole; of one further pass as many tokens as are left
    are taken: whole blocks in the order of their permutation, and of the next block documents
    in the order of theirs while they fit (so a source gives less than its target by less than
    one document). Blocks are about block_docs documents by hash, so a source of any size is
    spread over tasks. Ordering by mix_key interleaves the sources in proportion.

    Documents without words (null, empty) cost nothing and are used once per whole pass. Repeated
    rows share a place but stay. Null sources mix as one source. Rows are told apart by doc_id,
    source and text, so rows without a doc_id or with a shared one are used like any other. Extra
    columns stay; input columns with the added names are replaced. An empty table gives an empty result.
    """
    user_key = "_key" + "_" * max([len(c) for c in docs.columns if c.startswith("_key")], default=0)  # a name that no column has
    docs = docs.withColumnRenamed("_key", user_key) if "_key" in docs.columns else docs
    src = docs.drop("n_tokens", "weight", "pass", "block", "place", "mix_key").withColumn("n_tokens", F.size(words(F.col("text"))).cast("long")).withColumn("_key", row_key("source"))
    narrow = cut(src.select("_key", "source", "n_tokens"))
    plan = source_weights(narrow, max_repeats, target_entropy, budget)
    sizes = narrow.groupBy("source").agg(F.count("*").alias("_n"))
    plan = cut(sizes.join(plan, sizes["source"].eqNullSafe(plan["source"]), "left").select(sizes["source"].alias("_source"), F.greatest(F.lit(1), F.ceil(F.col("_n") / block_docs)).alias("_blocks"), F.coalesce("weight", F.lit(0.0)).alias("weight"), F.coalesce("passes", F.lit(1)).alias("passes"), F.coalesce("rest", F.lit(0.0)).alias("rest")))
    blocked = narrow.join(plan, narrow["source"].eqNullSafe(plan["_source"])).withColumn("block", F.pmod(F.xxhash64("_key", F.lit(seed)), F.col("_blocks")))
    # the tokens of blocks that come before a block in the further pass
    per = blocked.groupBy("source", "block").agg(F.sum("n_tokens").alias("_t")).withColumn("_order", _uniform("block", F.lit(seed + 1)))
    per = running(per, ["_order", "block"], {"_before": F.col("_t"), "_at": F.lit(1).cast("long")}, ["source"]).select(F.col("source").alias("_s"), F.col("block").alias("_b"), "_before", "_at")
    one = blocked.join(per, blocked["source"].eqNullSafe(per["_s"]) & (blocked["block"] == per["_b"])).drop("_s", "_b")
    inside = Window.partitionBy("source", "block").orderBy("_order", "_key")
    placed = one.withColumn("_order", _uniform("_key", F.lit(seed + 2)))
    placed = placed.withColumns({"place": F.row_number().over(inside), "_sum": F.col("_before") + F.sum("n_tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0)), "_size": F.count("*").over(Window.partitionBy("source", "block"))})
    extra = ((F.col("n_tokens") > 0) & (F.col("_sum") <= F.col("rest"))).cast("int")
    used = placed.withColumn("_times", F.col("passes") + extra).filter("_times > 0")
    used = used.select("_key", "weight", "block", "place", F.explode(F.sequence(F.lit(1), F.col("_times"))).alias("pass"), ((F.col("_at") + (F.col("place") - 1) / F.col("_size")) / F.col("_blocks")).alias("_u"))
    used = used.withColumn("mix_key", F.col("pass") - 1 + F.col("_u")).drop("_u").dropDuplicates(["_key", "pass"])
    out = src.join(used, "_key").drop("_key")
    return out.withColumnRenamed(user_key, "_key") if user_key in docs.columns else out


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("text")
