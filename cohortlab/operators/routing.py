"""Allocation of users to groups: hashing, balanced buckets, layers, strata and slot pools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.murmur import murmur
from .frames import percentiles, running, with_rank

SALT = "exp_001"


def bucket(user: Column | str, salt: str = SALT, buckets: int = 1000) -> Column:
    return murmur(user, F.lit(salt)) % buckets


def pure_hash(user: Column | str, salt: str = SALT, buckets: int = 1000, groups: int = 10) -> Column:
    return (bucket(user, salt, buckets) % groups).cast("int")


def double_hash(user: Column | str, salt: str = SALT, buckets: int = 1000, groups: int = 10) -> Column:
    return (murmur(user, F.lit(salt), F.lit("v1")).bitwiseXOR(murmur(user, F.lit(salt), F.lit("v2"))) % buckets % groups).cast("int")


def first_mode(votes: Column) -> Column:
    """The most frequent vote; of equals the one met first."""
    return F.array_max(F.transform(votes, lambda v, i: F.struct(F.size(F.filter(votes, lambda x: x == v)).alias("n"), (-i).alias("o"), v.alias("v"))))["v"]


def salt_vote(users: DataFrame, user: str, salts: list[str], buckets: int | None, groups: int, name: str = "group_id") -> DataFrame:
    """Each salt votes for a group."""
    vote = lambda s: murmur(user, F.lit(s)) % buckets % groups if buckets else murmur(user, F.lit(s)) % groups
    return users.withColumn("_votes", F.array(*[vote(s) for s in salts])).withColumn(name, first_mode(F.col("_votes")).cast("int")).drop("_votes")


def two_stage_hash(user: Column | str, salt: str = SALT, groups: int = 10) -> Column:
    """Only the second stage decides."""
    return (murmur(user, F.lit(salt), F.lit("v2")) % groups).cast("int")


def snake(position: Column, groups: int) -> Column:
    """Group of a 0-based position going back and forth over the groups."""
    there, lap = position % groups, F.floor(position / groups)
    return F.when(lap % 2 == 0, there).otherwise(groups - 1 - there).cast("int")


def snake_map(counts: DataFrame, buckets: int, groups: int, keys: list[str] | None = None) -> DataFrame:
    """counts: (keys, bucket, n). Buckets by falling size, then number, dealt in a snake; empty ones too."""
    keys = keys or []
    every = counts.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    if keys:
        every = counts.select(*keys).distinct().withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(buckets - 1).cast("long"))))
    full = every.join(counts, [*keys, "bucket"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    order = (Window.partitionBy(*keys) if keys else Window).orderBy(F.desc("n"), "bucket")  # at most `buckets` rows
    return full.withColumn("group_id", snake(F.row_number().over(order) - 1, groups))


def assign_groups(users: DataFrame, user: str = "user_id", buckets: int = 1000, groups: int = 10, salt: str = SALT, keys: list[str] | None = None) -> DataFrame:
    """Adds bucket and group_id: buckets are dealt by size, so groups come out balanced."""
    keys = keys or []
    placed = users.withColumn("bucket", bucket(user, salt, buckets) if not keys else murmur(user, F.lit(salt), *keys) % buckets)
    deal = snake_map(placed.groupBy(*keys, "bucket").agg(F.count("*").alias("n")), buckets, groups, keys).select(*keys, "bucket", "group_id")
    return placed.join(deal if keys else F.broadcast(deal), [*keys, "bucket"])  # `buckets` rows


def group_sizes(routed: DataFrame, groups: int, group: str = "group_id") -> DataFrame:
    """(group_id, n) of every group, empty ones too."""
    n = routed.groupBy(F.col(group).cast("long").alias("group_id")).agg(F.count("*").alias("n"))
    return routed.sparkSession.range(groups).withColumnRenamed("id", "group_id").join(n, "group_id", "left").select(F.col("group_id").cast("int").alias("group_id"), F.coalesce("n", F.lit(0)).alias("n"))


def route_layers(users: DataFrame, layers: dict[str, tuple[int, int, str]], user: str = "user_id") -> DataFrame:
    """A group column for each layer: layers maps a name to (buckets, groups, salt)."""
    return users.withColumns({name: pure_hash(user, salt, b, g) for name, (b, g, salt) in layers.items()})


def virtual_ids(spark: SparkSession, n: int, pattern: str) -> DataFrame:
    return spark.range(n).select("id", F.format_string(pattern, "id").alias("user_id"))


def quota_table(spark: SparkSession, buckets: int = 1000, groups: int = 10, salt: str = SALT, each: int = 100) -> DataFrame:
    """(bucket, n, group_id) dealt from `each` made-up users a bucket."""
    warm = virtual_ids(spark, each * buckets, "warmup_%d").select(bucket("user_id", salt, buckets).alias("bucket"))
    return snake_map(warm.groupBy("bucket").agg(F.count("*").alias("n")), buckets, groups).select("bucket", "n", "group_id")


def route_quota(users: DataFrame, user: str = "user_id", buckets: int = 1000, groups: int = 10, salt: str = SALT) -> DataFrame:
    table = quota_table(users.sparkSession, buckets, groups, salt).drop("n")
    return users.withColumn("bucket", bucket(user, salt, buckets)).join(F.broadcast(table), "bucket")


def slot_counts(spark: SparkSession, capacity: int, groups: int, salt: str = SALT) -> DataFrame:
    """(group_id, slots): made-up users v_00000000... dealt by assign_groups."""
    return group_sizes(assign_groups(virtual_ids(spark, capacity, "v_%08d"), "user_id", min(capacity, 1000), groups, salt), groups).withColumnRenamed("n", "slots")


def slot_pool(arrivals: DataFrame, capacity: int, groups: int = 10, salt: str = SALT, user: str = "user_id", order: list[str] | None = None) -> DataFrame:
    """(user_id, k, group_id): users by first arrival take the least used group's next slot.

    That is round robin until the group whose turn it is has no slot left; from then on every
    new user gets -1, even if other groups have room.
    """
    order = order or ["arrival_seq"]
    first = arrivals.groupBy(user).agg(F.min(F.struct(*order)).alias("_o")).select(user, *[F.col(f"_o.{c}").alias(c) for c in order])
    ranked = with_rank(first, [*order, user])
    # the first k whose group is full: its turn number k // groups reaches the group's slots
    full = slot_counts(arrivals.sparkSession, capacity, groups, salt).agg(F.min(F.col("slots") * groups + F.col("group_id")).alias("stop"))
    out = ranked.join(F.broadcast(full))  # one row
    return out.select(user, "k", F.when(F.col("k") < F.col("stop"), F.col("k") % groups).otherwise(-1).cast("int").alias("group_id"))


def prebucket_split(users: DataFrame, order: list[str], groups: int = 10, salt: str = SALT, user: str = "user_id") -> DataFrame:
    """slot_pool with room for five times the users, 50,000 at least."""
    n = users.agg(F.count_distinct(user)).first()[0]
    return slot_pool(users, max(5 * n, 50_000), groups, salt, user, order)


def snake_split(users: DataFrame, groups: int = 10, salt: str = SALT, user: str = "user_id") -> DataFrame:
    """assign_groups with a bucket a user, 1,000 at most."""
    return assign_groups(users, user, min(max(users.count(), 1), 1000), groups, salt)


def growing_pool(arrivals: DataFrame, capacity: int = 10_000, groups: int = 10, at: float = 0.8, salt: str = SALT, user: str = "user_id", order: list[str] | None = None) -> DataFrame:
    """(user, k, group_id): a slot pool that doubles before an allocation that finds more than `at`
    of it used; use counts start anew then. The slots of each growth have a salt of their own, from _v0 on.

    Between two growths the groups are dealt in turn, so a group follows from the rank of a user's
    first arrival alone; the growths, one for each doubling, are worked out beforehand.
    """
    spark, order = arrivals.sparkSession, order or ["arrival_seq"]

    def slots(lo: int, hi: int, s: str) -> list[int]:
        ids = spark.range(lo, hi).select(F.format_string("v_%08d", "id").alias("user_id"))
        return [r["n"] for r in group_sizes(assign_groups(ids, "user_id", min(hi - lo, 1000), groups, s), groups).orderBy("group_id").collect()]  # a row a group

    first = arrivals.groupBy(user).agg(F.min(F.struct(*order)).alias("_o")).select(user, *[F.col(f"_o.{c}").alias(c) for c in order])
    ranked = with_rank(first, [*order, user])
    n, start, total, grown = ranked.count(), 0, capacity, 0
    have, before = slots(0, capacity, f"{salt}_v0"), [0] * groups
    group = F.lit(-1)
    while True:
        full = start + min((h - b) * groups + g for g, (h, b) in enumerate(zip(have, before)))  # the turn of a full group
        grow = int(at * total)
        while grow / total <= at:
            grow += 1
        end = min(full, grow)
        group = F.when((F.col("k") >= start) & (F.col("k") < end), (F.col("k") - start) % groups).otherwise(group)
        if full < grow or grow >= n:
            break
        before = [b + (grow - start + groups - 1 - g) // groups for g, b in enumerate(before)]
        grown += 1
        have = [h + m for h, m in zip(have, slots(total, 2 * total, f"{salt}_v{grown}"))]
        start, total = grow, 2 * total
    return ranked.select(user, "k", group.cast("int").alias("group_id"))


def layered_route(arrivals: DataFrame, order: list[str], groups: int = 10, buckets: int = 1000, salt: str = SALT, user: str = "user_id") -> DataFrame:
    """Adds group_id and layer to every arrival: a new user takes a prepared bucket of the least used
    group while that has one (L1_prebucket), else the group of their hash (L2_realtime); either is written to the
    cache, so that later arrivals find it there (L1_cache).

    Prepared are the buckets that ten made-up users a bucket reach. The first group to run out stops
    the preparing for good, so the rank of the first arrival decides.
    """
    free = quota_table(arrivals.sparkSession, buckets, groups, salt, 10).filter("n > 0").groupBy("group_id").agg(F.count("*").alias("n"))
    stop = arrivals.sparkSession.range(groups).join(free, F.col("id") == F.col("group_id"), "left").agg(F.min(F.coalesce("n", F.lit(0)) * groups + F.col("id")).alias("_stop"))
    first = arrivals.groupBy(user).agg(F.min(F.struct(*order)).alias("_first"))
    ranked = with_rank(first.select(user, "_first", *[F.col(f"_first.{c}").alias(c) for c in order]), [*order, user]).join(F.broadcast(stop))  # one row
    ranked = ranked.select(F.col(user).alias("_user"), "_first", "k", (F.col("k") < F.col("_stop")).alias("_held"))
    out = arrivals.join(ranked, F.col(user) == F.col("_user"))
    layer = F.when(F.struct(*order) != F.col("_first"), "L1_cache").when(F.col("_held"), "L1_prebucket").otherwise("L2_realtime")
    return out.withColumns({"group_id": F.when(F.col("_held"), F.col("k") % groups).otherwise(pure_hash(user, salt, buckets, groups)).cast("int"), "layer": layer}).drop("_user", "_first", "_held", "k")


def pool_utilization(routed: DataFrame, capacity: int) -> DataFrame:
    """(used, utilization_pct) of a slot pool's (user, group_id)."""
    used = F.count_if(F.col("group_id") >= 0)
    return routed.agg(used.alias("used"), (used / capacity * 100).alias("utilization_pct"))


def cache_hit_rate(routed: DataFrame) -> DataFrame:
    """(hits, misses, hit_rate_pct) of layered_route."""
    hits, misses = F.count_if(F.col("layer") != "L2_realtime"), F.count_if(F.col("layer") == "L2_realtime")
    return routed.agg(hits.alias("hits"), misses.alias("misses"), F.coalesce(F.try_divide(hits, hits + misses) * 100, F.lit(0.0)).alias("hit_rate_pct"))


def hybrid_route(arrivals: DataFrame, order: list[str], buckets: int = 1000, groups: int = 10, window: int = 1000, threshold: float = 0.05, salt: str = SALT, quota_salt: str = SALT, user: str = "user_id") -> DataFrame:
    """Pure hash until the first check, every `window` events, that finds the largest group over
    the mean by more than threshold; the quota table from there on."""
    ranked = with_rank(arrivals, order).withColumn("hash_group", pure_hash(user, salt, buckets, groups)).withColumn("w", F.floor(F.col("k") / window))
    per = ranked.groupBy("w", "hash_group").agg(F.count("*").alias("n"))
    grid = per.select("w").distinct().withColumn("hash_group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    full = grid.join(per, ["w", "hash_group"], "left").fillna(0, ["n"])
    run = running(full, ["w"], {"_c": F.col("n")}, ["hash_group"]).withColumn("c", F.col("_c") + F.col("n"))
    check = run.groupBy("w").agg(F.max("c").alias("top"), F.sum("c").alias("all")).filter((F.col("all") % window == 0) & (F.col("top") / (F.col("all") / groups) - 1 > threshold))
    switch = check.agg(F.coalesce((F.min("w") + 1) * window, F.lit(2**62)).alias("switch"))
    quota = quota_table(arrivals.sparkSession, buckets, groups, quota_salt).drop("n").withColumnRenamed("group_id", "quota_group")
    out = ranked.withColumn("bucket", bucket(user, salt, buckets)).join(F.broadcast(quota), "bucket").join(F.broadcast(switch))
    return out.withColumn("group_id", F.when(F.col("k") < F.col("switch"), F.col("hash_group")).otherwise(F.col("quota_group"))).drop("w")


def quantile_bin(df: DataFrame, col: str, bins: int) -> Column:
    """0-based quantile bin: right-closed, the lowest value included, equal edges merged. One row of edges is collected."""
    edges = percentiles(df, col, {f"e{i}": i / bins for i in range(bins + 1)}).first() or ()
    inner = sorted({e for e in edges if e is not None})[1:-1]
    out = F.lit(0)
    for e in inner:
        out = out + (F.col(col) > F.lit(float(e))).cast("int")
    return F.when(F.col(col).isNotNull(), out)


def create_strata(df: DataFrame, features: list[str], bins: int = 3) -> DataFrame:
    """Adds stratum: the quantile bins of the features joined by a dash; absent features are skipped."""
    return df.withColumn("stratum", F.concat_ws("-", *[quantile_bin(df, c, bins).cast("string") for c in features if c in df.columns]))


def stratified_assign(df: DataFrame, groups: int = 10, capacity: int | None = None, salt: str = SALT, user: str = "user_id") -> DataFrame:
    """Round robin within each stratum in hash order, until the first group has its share of the stratum's
    capacity; rows after that get -1. A stratum is ranked by ranges."""
    out = with_rank(df.withColumn("_h", murmur(user, F.lit(salt))), ["_h", user], "_k", keys=["stratum"])
    group = F.col("_k") % groups
    if capacity is not None:
        group = F.when(F.col("_k") <= (capacity // groups - 1) * groups, group).otherwise(-1)
    return out.withColumn("group_id", group.cast("int")).drop("_h", "_k")
