"""Monte-Carlo drivers, generators, ordered routers and bandits: parallel over trials."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.murmur import Prefixed, murmur, murmur32, uniform
from . import balance, routing
from .distributions import ks_uniform
from .frames import cut
from .moments import ratio, split_arms

BASE_SEED = 20260728
EDGES = [0, 0.2, 0.4, 0.6, 0.8, 1, 1.5, 2, 3, 5, 100]


def normal(*parts: Column | str) -> Column:
    """A standard normal number from two hash-uniform ones."""
    u, v = uniform(F.lit("n1"), *parts), uniform(F.lit("n2"), *parts)
    return F.sqrt(-2 * F.log(F.greatest(u, F.lit(1e-12)))) * F.cos(2 * F.lit(3.141592653589793) * v)


def trial_users(spark: SparkSession, trials: int, users: int, pool: int = 1_000_000_000) -> DataFrame:
    """(trial, i, user_id, salt): reproducible ids from a hash, of `pool` ones; few of them repeat users."""
    grid = spark.range(trials * users).select(F.floor(F.col("id") / users).cast("int").alias("trial"), (F.col("id") % users).alias("i"))
    return grid.withColumn("user_id", F.format_string("u_%09d", (murmur(F.lit(BASE_SEED), "trial", "i") % pool))).withColumn("salt", F.concat(F.lit("exp_"), F.col("trial")))


def pcg_users(spark: SparkSession, trials: int, users: int, base_seed: int = BASE_SEED) -> DataFrame:
    """(trial, i, user_id, salt) drawn from numpy's default generator, seeded base + 1000 * trial."""

    def draw(it):
        for pdf in it:
            for t in pdf["id"]:
                ids = np.random.default_rng(base_seed + int(t) * 1000).integers(0, 10**9, size=users)
                yield pd.DataFrame({"trial": np.int32(t), "i": np.arange(users), "user_id": [f"u_{x:09d}" for x in ids], "salt": f"exp_{t}"})

    return spark.range(trials).repartition(min(trials, 64), "id").mapInPandas(draw, "trial int, i long, user_id string, salt string")


def trial_deviation(users: DataFrame, strategy: str, buckets: int = 1000, groups: int = 10) -> DataFrame:
    """(trial, max_dev_pct) of a strategy: snake, hash, double_hash, two_stage, vote or union (of two layers)."""
    return balance.deviation_pct(trial_sizes(users, strategy, buckets, groups), ["trial"]).select("trial", "max_dev_pct")


def trial_sizes(users: DataFrame, strategy: str, buckets: int = 1000, groups: int = 10, layers: int = 2) -> DataFrame:
    """(trial, group_id, n) of a strategy, empty groups too."""
    h = lambda *x: murmur("user_id", "salt", *[F.lit(y) for y in x])
    if strategy == "snake":
        b = users.withColumn("bucket", h() % buckets).groupBy("trial", "bucket").agg(F.count("*").alias("n"))
        sizes = routing.snake_map(b, buckets, groups, ["trial"]).groupBy("trial", "group_id").agg(F.sum("n").alias("n"))
    else:
        if strategy == "vote":
            users = users.withColumn("_votes", F.array(*[h(f"s{i}") % groups for i in range(4)]))
        elif strategy == "union":
            users = users.withColumn("_votes", F.array(*[h(f"L{i}") % buckets % groups for i in range(layers)]))
        group = {"hash": lambda: h() % buckets % groups, "double_hash": lambda: h("v1").bitwiseXOR(h("v2")) % buckets % groups, "two_stage": lambda: h("v2") % groups, "vote": lambda: routing.first_mode(F.col("_votes")), "union": lambda: routing.first_mode(F.col("_votes"))}[strategy]()
        n = users.withColumn("group_id", group.cast("int")).groupBy("trial", "group_id").agg(F.count("*").alias("n"))
        grid = users.select("trial").distinct().withColumn("group_id", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        sizes = grid.join(n, ["trial", "group_id"], "left").fillna(0, ["n"])
    return sizes


def summarize(trials: DataFrame, value: str = "max_dev_pct", limit: float = 1.0, keys: list[str] = ()) -> DataFrame:
    v = F.col(value)
    return trials.groupBy(*keys).agg(F.count("*").alias("trials"), F.avg(v).alias("mean"), F.percentile(v, F.lit(0.5)).alias("median"), F.stddev_pop(v).alias("std"), F.percentile(v, F.lit(0.95)).alias("p95"), F.percentile(v, F.lit(0.99)).alias("p99"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg((v < limit).cast("int")).alias("pass_rate"))


def histogram(df: DataFrame, value: str, edges: list[float] = EDGES) -> DataFrame:
    """(bin, n) over fixed edges, the last bin closed on the right; empty bins too."""
    v = F.col(value)
    b = F.lit(None).cast("int")
    for i in range(len(edges) - 1):
        upper = v <= edges[i + 1] if i == len(edges) - 2 else v < edges[i + 1]
        b = F.when((v >= edges[i]) & upper, i).otherwise(b)
    n = df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"))
    return df.sparkSession.range(len(edges) - 1).select(F.col("id").cast("int").alias("bin")).join(n, "bin", "left").fillna(0, ["n"])


# Ordered routers. Each decision depends on those before it, so a trial is one fold; trials run in parallel.


def fold_calibrated(ids: list[str], salt: str, groups: int = 10, buckets: int = 1000) -> list[int]:
    """The base group by hash, but users of calibration group 0 go to the smallest group so far."""
    base, calib = murmur32([f"{u}_{salt}" for u in ids]) % buckets % groups, murmur32([f"{u}_{salt}_calib" for u in ids]) % 1000 % groups
    count, out = [0] * groups, []
    for i in range(len(ids)):
        g = count.index(min(count)) if i and calib[i] == 0 else int(base[i])
        count[g] += 1
        out.append(g)
    return out


def fold_share_calibrated(ids: list[str], salt: str, groups: int = 10, share: float = 0.7, sticky: bool = False, buckets: int | None = None) -> list[int]:
    """A share of users, chosen by hash, goes to the smallest group, the others to their hash's; sticky keeps known users."""
    h = murmur32([f"{u}_{salt}" for u in ids])
    base = (h % buckets if buckets else h) % groups
    pick = murmur32([f"{salt}_{i}_{u}" for i, u in enumerate(ids)]) / 2**32 < share
    count, known, out = [0] * groups, {}, []
    for i, u in enumerate(ids):
        g = known[u] if sticky and u in known else count.index(min(count)) if pick[i] else int(base[i])
        if not (sticky and u in known):
            count[g] += 1
            known[u] = g
        out.append(g)
    return out


def snake_buckets(keys: np.ndarray, buckets: int, groups: int) -> np.ndarray:
    """The group of each bucket."""
    n = np.bincount(keys, minlength=buckets)
    order = np.lexsort((np.arange(buckets), -n))
    lap, at = np.divmod(np.arange(buckets), groups)
    out = np.empty(buckets, np.int64)
    out[order] = np.where(lap % 2 == 0, at, groups - 1 - at)
    return out


def fold_growing_pool(ids: list[str], salt: str, groups: int = 10, capacity: int = 10_000, at: float = 0.8, first: str = "_v0") -> list[int]:
    """A slot pool that doubles before an allocation that finds more than `at` of it used; use counts start anew then.
    The slots of each growth have a salt of their own, those before the first too."""

    def slots(lo: int, hi: int, s: str) -> np.ndarray:
        b = min(hi - lo, 1000)
        keys = murmur32([f"v_{i:08d}_{s}" for i in range(lo, hi)]) % b
        return np.bincount(snake_buckets(keys, b, groups)[keys], minlength=groups)

    have, used, total, taken, grown = slots(0, capacity, salt + first), np.zeros(groups, np.int64), capacity, 0, 0
    start, known, out = np.zeros(groups, np.int64), {}, []
    for u in ids:
        if u not in known:
            if taken / total > at:
                grown += 1
                have = have + slots(total, 2 * total, f"{salt}_v{grown}")
                start, used, total = start + used, np.zeros(groups, np.int64), 2 * total
            g = int(used.argmin())
            if start[g] + used[g] < have[g]:
                used[g] += 1
                taken += 1
                known[u] = g
            else:
                known[u] = -1
        out.append(known[u])
    return out


def fold_layered(ids: list[str], salt: str, groups: int = 10, buckets: int = 1000, warm: int = 10) -> list[tuple[int, str]]:
    """Known users from the cache, however they got there; new ones take a prepared bucket of the least used group while there is one, then their hash."""
    keys = murmur32([f"warmup_{i}_{salt}" for i in range(warm * buckets)]) % buckets
    free = np.bincount(snake_buckets(keys, buckets, groups)[np.unique(keys)], minlength=groups)  # buckets without a made-up user aren't prepared
    base = murmur32([f"{u}_{salt}" for u in ids]) % buckets % groups
    used, known, out = np.zeros(groups, np.int64), {}, []
    for i, u in enumerate(ids):
        if u in known:
            out.append((known[u], "L1_cache"))
            continue
        g = int(used.argmin())
        if used[g] < free[g]:
            used[g] += 1
            known[u] = g
            out.append((g, "L1_prebucket"))
        else:
            known[u] = int(base[i])
            out.append((known[u], "L2_realtime"))
    return out


def fold_adaptive(ids: list[str], salt: str, groups: int = 10, buckets: int = 1000, window: int = 500, limit: float = 0.05, warm: list[str] | None = None) -> list[int]:
    """Buckets move from the largest to the smallest group whenever a check finds the largest over the mean by the limit."""
    keys = murmur32([f"{u}_{salt}" for u in ids]) % buckets
    first = murmur32([f"{u}_{salt}" for u in (warm if warm is not None else ids)]) % buckets
    group_of = snake_buckets(first, buckets, groups)
    size = np.bincount(first, minlength=buckets)
    listing = sorted(range(buckets), key=lambda b: (group_of[b], -size[b], b))
    seen, count, out, met, known = np.zeros(buckets, np.int64), np.zeros(groups, np.int64), [], [], set()
    for i, b in enumerate(keys, 1):
        g = int(group_of[b])
        if not count[g] and g not in met:
            met.append(g)  # of equal groups the one met first counts
        seen[b] += ids[i - 1] not in known
        known.add(ids[i - 1])
        count[g] += 1
        out.append(g)
        if i % window == 0:
            mean = count.sum() / groups
            hi, lo = max(met, key=lambda g: count[g]), min(met, key=lambda g: count[g])
            if mean > 0 and abs(count[hi] - mean) / mean >= limit:
                own = [x for x in listing if group_of[x] == hi and seen[x] > 1]
                own = sorted(own, key=lambda x: -seen[x])[: int(mean * limit / 0.5)]
                if own:
                    group_of[own] = lo
                    # the counts are patched by the last bucket's users times the buckets moved
                    step = int(seen[own[-1]]) * len(own)
                    count[hi] -= step
                    count[lo] += step
    return out


def route_trials(arrivals: DataFrame, fold: Callable[[list[str], str], list[int]], order: str = "i") -> DataFrame:
    """(trial, i, user_id, group_id): the fold over each trial's arrivals in order."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        return pd.DataFrame({"trial": pdf["trial"], "i": pdf["i"], "user_id": pdf["user_id"], "group_id": fold(pdf["user_id"].tolist(), pdf["salt"].iloc[0])})

    return arrivals.groupBy("trial").applyInPandas(run, "trial int, i long, user_id string, group_id int")


def routed_sizes(arrivals: DataFrame, fold: Callable[[list[str], str], list[int]], groups: int = 10) -> DataFrame:
    """(trial, group_id, n) of an ordered router, first arrivals of users only, empty groups too."""
    r = route_trials(arrivals, fold)
    first = r.groupBy("trial", "user_id").agg(F.min_by("group_id", "i").alias("group_id"))
    n = first.filter("group_id >= 0").groupBy("trial", "group_id").agg(F.count("*").alias("n"))
    grid = arrivals.select("trial").distinct().withColumn("group_id", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    return grid.join(n, ["trial", "group_id"], "left").fillna(0, ["n"])


def fold_slot_pool(ids: list[str], salt: str, groups: int = 10, capacity: int = 50_000) -> list[int]:
    """The slot pool: growth never comes, and the salt is plain."""
    return fold_growing_pool(ids, salt, groups, capacity, at=2.0, first="")


def stream_summary(arrivals: DataFrame, fold: Callable[[list[str], str], list[int]], capacity: int | None = None) -> DataFrame:
    """(trial, users, n_groups, max_dev_pct, utilization_pct) of an ordered router fed with each trial's
    stream; groups without users don't count for the deviation."""
    sizes = routed_sizes(arrivals, fold).filter("n > 0")
    out = balance.deviation_pct(sizes, ["trial"]).select("trial", "max_dev_pct").join(sizes.groupBy("trial").agg(F.sum("n").alias("users"), F.count("*").alias("n_groups")), "trial")
    return out.withColumn("utilization_pct", F.col("users") / capacity * 100 if capacity else F.lit(None).cast("double"))


def orthogonality_study(users: DataFrame, layers: dict[str, tuple[int, int, str]]) -> DataFrame:
    """(measure, trials, mean, median, p95, pass_rate) of independence, use of combinations and layer sizes over trials."""
    routed, names = routing.route_layers(users, layers), list(layers)
    out = None

    def add(rows: DataFrame, measure: str, value: str, passed: Column) -> None:
        nonlocal out
        v = F.col(value)
        one = rows.agg(F.count("*").alias("trials"), F.avg(v).alias("mean"), F.percentile(v, F.lit(0.5)).alias("median"), F.percentile(v, F.lit(0.95)).alias("p95"), F.avg(passed.cast("double")).alias("pass_rate"))
        one = one.select(F.lit(measure).alias("measure"), "*")
        out = one if out is None else out.unionByName(one)

    pairs = None
    for b in names[1:]:
        one = balance.orthogonality(routed, names[0], b, ["trial"])
        pairs = one if pairs is None else pairs.unionByName(one)
    add(pairs, "p_value", "p_value", F.col("p_value") > 0.05)
    add(pairs, "max_cell_dev_pct", "max_dev_pct", F.col("max_dev_pct") < 5)
    combos = routed.groupBy("trial", *names).agg(F.count("*").alias("n")).groupBy("trial").agg((F.min("n") / F.max("n")).alias("balance"))
    add(combos, "combination_balance", "balance", F.col("balance") > 0.8)
    for name, (_, groups, _) in layers.items():
        n = routed.groupBy("trial", F.col(name).alias("group_id")).agg(F.count("*").alias("n"))
        dev = balance.deviation_pct(n, ["trial"])
        add(dev, f"dev_pct {name}", "max_dev_pct", F.col("max_dev_pct") < 1)
    return out


def full_evaluation(users: DataFrame, features: list[str], trials: int = 10, groups: int = 10, user: str = "user_id", order: list[str] | None = None) -> DataFrame:
    """(strategy, max_dev_pct, min_srm_p, srm_pass_rate, feature_dev_pct, verdict): pure hash, snake and
    slot pool over all users, with a salt a trial; traffic passes below 3 % with every p above 0.01,
    features below 10 %. The pool has no salt, so its trials are one."""
    buckets = min(max(users.count(), 1), 1000)
    each = users.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1)))).withColumn("_salt", F.concat(F.lit("exp_"), F.col("trial")))
    bucket = murmur(user, "_salt") % buckets
    placed = each.withColumn("bucket", bucket)
    deal = routing.snake_map(placed.groupBy("trial", "bucket").agg(F.count("*").alias("n")), buckets, groups, ["trial"]).select("trial", "bucket", "group_id")
    pool = routing.prebucket_split(users, order or [user], groups, user=user).select(F.col(user).alias("_u"), "group_id")
    routed = {
        "hash": each.withColumn("group_id", (murmur(user, "_salt") % 1000 % groups).cast("int")),
        "snake": placed.join(F.broadcast(deal), ["trial", "bucket"]),  # a row a trial and bucket
        "slot_pool": users.join(pool.hint("merge"), F.col(user) == F.col("_u")).withColumn("trial", F.lit(0)),
    }
    out = None
    for name, r in routed.items():
        sizes = r.filter("group_id >= 0").groupBy("trial", "group_id").agg(F.count("*").alias("n"))
        traffic = balance.deviation_pct(sizes, ["trial"]).select("trial", "max_dev_pct").join(balance.srm(sizes, keys=["trial"]).select("trial", "p_value"), "trial")
        t = traffic.agg(F.avg("max_dev_pct").alias("max_dev_pct"), F.min("p_value").alias("min_srm_p"), F.avg((F.col("p_value") > 0.05).cast("double")).alias("srm_pass_rate"))
        f = balance.unpivot(r, ["trial", "group_id"], features).groupBy("trial", "feature", "group_id").agg(F.avg("value").alias("m"), F.count("*").alias("n"))
        whole = f.groupBy("trial", "feature").agg((F.sum(F.col("m") * F.col("n")) / F.sum("n")).alias("mean"))
        dev = f.join(F.broadcast(whole), ["trial", "feature"]).groupBy("trial", "feature").agg(F.max(F.abs(F.col("m") - F.col("mean")) / F.abs("mean") * 100).alias("dev"))
        worst = dev.groupBy("feature").agg(F.avg("dev").alias("dev")).agg(F.max("dev").alias("feature_dev_pct"))
        one = t.join(worst).select(F.lit(name).alias("strategy"), "*")  # one row each
        out = one if out is None else out.unionByName(one)
    good = (F.col("max_dev_pct") < 3) & (F.col("min_srm_p") > 0.01) & (F.col("feature_dev_pct") < 10)
    return out.withColumn("verdict", F.when(good, "passed").otherwise("beyond limits"))


def bandit(name: str, arms: list[float], steps: int, seed: int, epsilon: float = 0.1, track: list[tuple[int, float]] | None = None) -> tuple[float, float, list[int]]:
    """(reward, regret, pulls) of one run of fixed, epsilon, ucb1 or thompson on Bernoulli arms."""
    rng, k = np.random.default_rng(seed), len(arms)
    pulls, value, wins = np.zeros(k), np.zeros(k), np.zeros(k)
    reward = regret = 0.0
    best = max(arms)
    for t in range(steps):
        if name == "fixed":
            a = t % k
        elif name == "epsilon":
            a = int(rng.integers(k)) if rng.random() < epsilon else int(value.argmax())
        elif name == "ucb1":
            a = int(pulls.argmin()) if (pulls == 0).any() else int((value + np.sqrt(2 * np.log(t + 1) / pulls)).argmax())
        else:
            a = int(rng.beta(wins + 1, pulls - wins + 1).argmax())
        r = float(rng.random() < arms[a])
        pulls[a] += 1
        wins[a] += r
        value[a] += (r - value[a]) / pulls[a]
        reward += r
        regret += best - arms[a]
        if track is not None:
            track.append((a, r))
    return reward, regret, pulls.astype(int).tolist()


def bandit_track(spark: SparkSession, arms: list[float], steps: int = 5000, names: tuple[str, ...] = ("fixed", "epsilon", "ucb1", "thompson"), seed: int = 42) -> DataFrame:
    """(algorithm, step, arm, reward, regret): rewards and regret summed up to each step of one run an algorithm."""

    def run(it):
        for pdf in it:
            for name in pdf["algorithm"]:
                track: list[tuple[int, float]] = []
                bandit(name, arms, steps, seed, track=track)
                yield pd.DataFrame({"algorithm": name, "step": np.arange(1, steps + 1), "arm": [a for a, _ in track], "_r": [r for _, r in track], "_g": [max(arms) - arms[a] for a, _ in track]})

    rows = spark.createDataFrame([(n,) for n in names], "algorithm string").repartition(len(names)).mapInPandas(run, "algorithm string, step long, arm int, _r double, _g double")
    so_far = Window.partitionBy("algorithm").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)  # `steps` rows
    return rows.withColumns({"reward": F.sum("_r").over(so_far), "regret": F.sum("_g").over(so_far)}).drop("_r", "_g")


def compare_bandits(spark: SparkSession, arms: list[float], steps: int = 5000, trials: int = 30, names: tuple[str, ...] = ("fixed", "epsilon", "ucb1", "thompson"), seed: int = 42) -> DataFrame:
    def run(it):
        for pdf in it:
            rows = [(n, *bandit(n, arms, steps, seed + int(t))[:2]) for n, t in zip(pdf["algorithm"], pdf["trial"])]
            yield pd.DataFrame(rows, columns=["algorithm", "reward", "regret"])

    grid = spark.range(trials).withColumnRenamed("id", "trial").withColumn("algorithm", F.explode(F.array(*[F.lit(n) for n in names]))).repartition(max(1, trials // 2), "trial", "algorithm")
    return grid.mapInPandas(run, "algorithm string, reward double, regret double").groupBy("algorithm").agg(F.count("*").alias("trials"), F.avg("reward").alias("mean_reward"), F.stddev_pop("reward").alias("std_reward"), F.avg("regret").alias("mean_regret"), F.stddev_pop("regret").alias("std_regret"))


def noisy_blocks(it, scale: dict[int, float], tag: str, trials: int):
    """(trial, arm, values) of a task's rows (u, a, y): y + scale of the arm * normal(tag, trial, u), some thousand users at a time."""
    for pdf in it:
        for a in scale:
            own = pdf[pdf["a"] == a]
            for i in range(0, len(own), 8192):
                keys, y = Prefixed(own["u"].iloc[i : i + 8192].tolist()), own["y"].iloc[i : i + 8192].to_numpy()
                for t in range(trials):
                    u, v = (keys.hashes(f"{n}_{tag}_{t}_".encode()) / 4294967296.0 for n in ("n1", "n2"))
                    yield t, a, y + scale[a] * (np.sqrt(-2 * np.log(np.maximum(u, 1e-12))) * np.cos(2 * np.pi * v))


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "u")


def noisy_points(rows: DataFrame, tag: str, trials: int, scale: dict[int, float], held: dict[int, int], points: list[float], spare: float = 0.001) -> dict[tuple[int, int], list[float]]:
    """(trial, arm): the exact percentiles, interpolated, of the values of noisy_blocks; a few numbers a trial and arm.

    Trials differ by their noise only, so the first one's percentiles around a point tell between which values it lies in
    the others: values between are kept, those below are counted. Where a point lies elsewhere all is done again with wider bounds.
    """
    if not held:
        return {}
    spark, wide = rows.sparkSession, spare + 5 * max((p * (1 - p)) ** 0.5 for p in points) / min(held.values()) ** 0.5
    rank = {(a, w): (n - 1) * p for a, n in held.items() for w, p in enumerate(points)}
    ranks = spark.createDataFrame([(a, w, int(np.floor(x)), int(np.ceil(x))) for (a, w), x in rank.items()], "a int, w int, low long, high long")
    first = F.lit(None).cast("double")
    for a, sd in scale.items():
        first = F.when(F.col("a") == a, F.col("y") + F.lit(sd) * normal(F.lit(tag), F.lit(0), "u")).otherwise(first)
    first = rows.select("a", first.alias("v"))
    while True:
        ends = [(max(0.0, p - wide), min(1.0, p + wide)) for p in points]
        found = {r["a"]: r["e"] for r in first.groupBy("a").agg(F.percentile_approx("v", [x for e in ends for x in e], 10_000).alias("e")).collect()}  # a row an arm
        inside = {a: [(-np.inf if lo == 0 else e[2 * w], np.inf if hi == 1 else e[2 * w + 1]) for w, (lo, hi) in enumerate(ends)] for a, e in found.items()}

        def kept(it, inside=inside):
            below, parts, size = np.zeros((trials, 2, len(points)), np.int64), [], 0
            for t, a, v in noisy_blocks(it, scale, tag, trials):
                for w, (lo, hi) in enumerate(inside[a]):
                    below[t, a, w] += np.count_nonzero(v < lo)
                    own, n = np.unique(v[(v >= lo) & (v <= hi)], return_counts=True)
                    parts.append((np.full(len(own), t, np.int32), np.full(len(own), a, np.int32), np.full(len(own), w, np.int32), own, n))
                    size += len(own)
                if size > 50_000 or len(parts) > 10_000:
                    yield pd.DataFrame(dict(zip(names, map(np.concatenate, zip(*parts)))))
                    parts, size = [], 0
            if parts:
                yield pd.DataFrame(dict(zip(names, map(np.concatenate, zip(*parts)))))
            t, a, w = np.nonzero(below)
            yield pd.DataFrame(dict(zip(names, (t.astype(np.int32), a.astype(np.int32), w.astype(np.int32), np.full(len(t), np.nan), below[t, a, w]))))

        names, keys = ["trial", "a", "w", "v", "n"], ["trial", "a", "w"]
        k = _dealt(rows).mapInPandas(kept, "trial int, a int, w int, v double, n long").groupBy(*keys, "v").agg(F.sum("n").alias("n"))
        earlier = Window.partitionBy(*keys).orderBy("v").rowsBetween(Window.unboundedPreceding, -1)  # a small share of a trial's users, after the count of those below
        at = k.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).filter("v is not null").join(F.broadcast(ranks), ["a", "w"])  # a row an arm and point
        held_at = lambda x: F.max(F.when((F.col("before") <= F.col(x)) & (F.col(x) < F.col("before") + F.col("n")), F.col("v")))
        at = at.groupBy(*keys).agg(held_at("low").alias("lo"), held_at("high").alias("hi")).collect()  # a row a trial, arm and point
        got = {(r["trial"], r["a"], r["w"]): r["lo"] + (r["hi"] - r["lo"]) * (rank[r["a"], r["w"]] % 1) for r in at if r["lo"] is not None and r["hi"] is not None}
        if len(got) == trials * len(rank):
            return {(t, a): [got[t, a, w] for w in range(len(points))] for t in range(trials) for a in held}
        if wide > 1:
            raise ValueError("values that are not finite have no percentiles")
        wide *= 4


def noisy_sums(rows: DataFrame, tag: str, trials: int, scale: dict[int, float], mean: dict[int, float], points: dict[tuple[int, int], list[float]], treated: Callable[[np.ndarray, list[float]], dict[str, np.ndarray]]) -> DataFrame:
    """(trial, method, mean_v_t, var_v_t, vpop_v_t and those of arm c): moments of the treated values of noisy_blocks, summed by task
    about what the treatment makes of the arm's mean."""

    def summed(it):
        total, centre = {}, {}
        for t, a, v in noisy_blocks(it, scale, tag, trials):
            if (t, a) not in centre:
                centre[t, a] = {k: float(x[0]) for k, x in treated(np.array([mean[a]]), points[t, a]).items()}
            for method, x in treated(v, points[t, a]).items():
                x = x - centre[t, a][method]
                n, s, q = total.get((t, a, method), (0, 0.0, 0.0))
                total[t, a, method] = n + len(x), s + x.sum(), q + x @ x
        yield pd.DataFrame([(t, a, k, centre[t, a][k], *x) for (t, a, k), x in total.items()], columns=["trial", "a", "method", "c", "n", "s", "q"])

    m, out = _dealt(rows).mapInPandas(summed, "trial int, a int, method string, c double, n long, s double, q double"), []
    for code, e in ((1, "t"), (0, "c")):
        own = lambda c, code=code: F.when(F.col("a") == code, F.col(c))
        n, s, q = F.sum(own("n")), F.sum(own("s")), F.sum(own("q"))
        q = F.greatest(q - ratio(s * s, n), F.lit(0.0)) + n * 0  # null without rows
        out += [(F.max(own("c")) + ratio(s, n)).alias(f"mean_v_{e}"), ratio(q, n - 1).alias(f"var_v_{e}"), ratio(q, n).alias(f"vpop_v_{e}")]
    return m.groupBy("trial", "method").agg(*out)


def lifted(m: DataFrame, effect: float, multiplicative: bool) -> DataFrame:
    """Moments of x and y with an effect put into arm 1's y; the whole's follow from the arms'."""
    by = F.lit(1 + effect if multiplicative else 1.0)
    m = m.withColumns({"mean_y_t": F.col("mean_y_t") * by if multiplicative else F.col("mean_y_t") + effect, "var_y_t": F.col("var_y_t") * by * by, "vpop_y_t": F.col("vpop_y_t") * by * by, "cov_y_x_t": F.col("cov_y_x_t") * by})
    nt, nc = F.col("n_t"), F.col("n_c")
    n = nt + nc
    between = lambda a, b: ratio(nt * nc, n) * (F.col(f"mean_{a}_t") - F.col(f"mean_{a}_c")) * (F.col(f"mean_{b}_t") - F.col(f"mean_{b}_c"))
    inside = lambda c: sum(F.coalesce(F.col(f"{c}_{s}") * (F.col(f"n_{s}") - 1), F.lit(0.0)) for s in "tc")
    whole = inside("var_y") + F.coalesce(between("y", "y"), F.lit(0.0))
    mean = ratio(nt * F.coalesce("mean_y_t", F.lit(0.0)) + nc * F.coalesce("mean_y_c", F.lit(0.0)), n)
    return m.withColumns({"mean_y": mean, "var_y": ratio(whole, n - 1), "vpop_y": ratio(whole, n), "cov_y_x": ratio(inside("cov_y_x") + F.coalesce(between("y", "x"), F.lit(0.0)), n - 1)})


def with_difference(m: DataFrame) -> DataFrame:
    """Adds the moments of d = y - x."""
    out, f = {}, F.col
    for s in ("_t", "_c", ""):
        n = f("n_t") + f("n_c") if s == "" else f(f"n{s}")
        var = F.greatest(f(f"var_y{s}") + f(f"var_x{s}") - 2 * f(f"cov_y_x{s}"), F.lit(0.0))
        out |= {f"mean_d{s}": f(f"mean_y{s}") - f(f"mean_x{s}"), f"var_d{s}": var, f"vpop_d{s}": ratio(var * (n - 1), n), f"cov_d_x{s}": f(f"cov_y_x{s}") - f(f"var_x{s}")}
    return m.withColumns(out)


def power_study(users: DataFrame, pre: str, post: str, trials: int, effect: float, user: str = "user_id", multiplicative: bool = True, alpha: float = 0.05) -> DataFrame:
    """Share of trials in which each pre/post estimator finds an effect put in by chance of arm."""
    from .effects import estimates

    m = split_arms(users.select(user, F.col(pre).alias("x"), F.col(post).alias("y")), user, "arm", trials, ["x", "y"])
    r = estimates(with_difference(lifted(m, effect, multiplicative)), ["trial"])
    return r.groupBy("method").agg(F.count("*").alias("trials"), F.avg((F.col("p_value") < alpha).cast("int")).alias("power"), F.avg("effect").alias("mean_effect"), F.avg("var_reduction").alias("mean_var_reduction"))


def aa_trials(users: DataFrame, y: str, trials: int, user: str = "user_id", alpha: float = 0.05) -> DataFrame:
    """(trial, effect, p_value) of splits without an effect."""
    from .effects import tested

    m = split_arms(users.select(user, F.col(y).alias("y")), user, "aa", trials, ["y"])
    return tested(m, "y", alpha, ["trial"]).select("trial", F.col("diff").alias("effect"), "ci_low", "ci_high", "p_value")


def aa_report(trials: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Type-I error, uniformity of p (Kolmogorov) and effect percentiles; one row.

    The trials are written once, for the p-values are ranked apart from the summary.
    """
    t = cut(trials)
    s = t.agg(F.count("*").alias("trials"), F.avg((F.col("p_value") < alpha).cast("int")).alias("type1"), F.avg("effect").alias("effect_mean"), F.stddev_pop("effect").alias("effect_std"), F.percentile("effect", F.lit(0.025)).alias("effect_low"), F.percentile("effect", F.lit(0.975)).alias("effect_high"), F.avg(F.col("ci_high") - F.col("ci_low")).alias("ci_width"))
    ks = ks_uniform(t, "p_value").select(F.col("p_value").alias("ks_p"))
    return s.join(ks, how="left").withColumn("passed", F.abs(F.col("type1") - alpha) < 0.015)  # one row each
