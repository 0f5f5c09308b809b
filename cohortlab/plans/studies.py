"""Queries of routers that share state, split checks, further estimators, Monte-Carlo studies and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.murmur import murmur
from ..operators import balance, effects, monitoring, ordered, routing, simulate
from ..operators.frames import checkpoint_dir
from ..sources import io
from . import sqlfn
from .registry import ARRIVE, FIRST, LAYERS, METRICS, OUSER, SIZES, USER, WARM, arrivals, h, metrics, pool_sql, query, r, read, roomy, rounded, snake_sql, users
from .sqlfn import murmur as mm

# --- routers over whole streams, by closed forms ---------------------------------------------


def growth_sql(capacity: int, versions: int) -> str:
    """A pool of `capacity` slots that grows up to versions - 1 times: each version's slots from users of its own,
    its start at the growth's rank, its end at the next growth or where a group is full. Beyond that an error."""
    return f"""WITH i AS (SELECT v, unnest(range(CASE v WHEN 0 THEN 0 ELSE {capacity} * (1 << (v - 1)) END, {capacity} * (1 << v))) AS i, least(1000, CASE v WHEN 0 THEN {capacity} ELSE {capacity} * (1 << (v - 1)) END) AS size FROM (SELECT unnest(range({versions})) AS v)),
u AS (SELECT v, size, {mm("'v_' || lpad(i::VARCHAR, 8, '0') || '_exp_001_v' || v")} % size AS b FROM i),
n AS (SELECT k.v, k.b, count(u.b) AS n FROM (SELECT v, unnest(range(size)) AS b FROM (SELECT DISTINCT v, size FROM u)) k LEFT JOIN u ON u.v = k.v AND u.b = k.b GROUP BY 1, 2),
o AS (SELECT v, n, row_number() OVER (PARTITION BY v ORDER BY n DESC, b) - 1 AS p FROM n),
s AS (SELECT v, CASE WHEN (p // 10) % 2 = 0 THEN p % 10 ELSE 9 - p % 10 END AS g, sum(n) AS n FROM o GROUP BY 1, 2),
t AS (SELECT v, CASE v WHEN 0 THEN 0 ELSE 8 * {capacity} * (1 << (v - 1)) // 10 + 1 END AS start, 8 * {capacity} * (1 << v) // 10 + 1 AS grow FROM (SELECT unnest(range({versions})) AS v)),
d AS (SELECT v, start, grow, g, sum(coalesce(n, 0)) OVER (PARTITION BY g ORDER BY v) AS have, coalesce(sum((grow - start + 9 - g) // 10) OVER (PARTITION BY g ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS had
  FROM (SELECT t.*, g.g FROM t CROSS JOIN (SELECT unnest(range(10)) AS g) g) LEFT JOIN s USING (v, g)),
e AS (SELECT v, start, grow, start + min((have - had) * 10 + g) AS f FROM d GROUP BY v, start, grow),
z AS (SELECT coalesce(min(f) FILTER (f < grow), 9000000000) AS z FROM e), {FIRST}
SELECT user_id, k, CASE WHEN k >= (SELECT max(grow) FROM e) THEN error('more users than the versions take')::INT WHEN k >= z THEN -1 ELSE (k - start) % 10 END::BIGINT AS group_id FROM k JOIN e ON k >= start AND k < grow, z"""


@query("rt15_growing_pool", growth_sql(10_000, 2))
def rt15(spark, d):
    """10,000 slots at first. The SQL holds up to the second growth, at 16,001 users."""
    return rounded(routing.growing_pool(arrivals(spark, d), order=["ts", "event_id"]))


@query("rt15_growths", growth_sql(40, 10))
def rt15_growths(spark, d):
    """40 slots at first, so that a few hundred users make it grow several times."""
    return rounded(routing.growing_pool(arrivals(spark, d), 40, order=["ts", "event_id"]))


def layered_sql(buckets: int) -> str:
    return f"""{snake_sql(buckets=buckets, source=WARM.replace('10000', str(10 * buckets)))}, n AS (SELECT group_id, count(*) AS n FROM m JOIN b USING (bucket) WHERE b.n > 0 GROUP BY 1),
f AS (SELECT min(coalesce(n, 0) * 10 + g.group_id) AS stop FROM (SELECT unnest(range(10)) AS group_id) g LEFT JOIN n USING (group_id)), {FIRST},
l AS (SELECT e.event_id, e.user_id, CASE WHEN k < stop THEN k % 10 ELSE {h('e.user_id', repr('exp_001'))} % {buckets} % 10 END::BIGINT AS group_id,
CASE WHEN (e.ts, e.event_id) <> a.o THEN 'L1_cache' WHEN k < stop THEN 'L1_prebucket' ELSE 'L2_realtime' END AS layer FROM ({ARRIVE}) e JOIN a USING (user_id) JOIN k USING (user_id), f)"""


LAYERED = layered_sql(1000)


def layered(spark, d, buckets=1000):
    return routing.layered_route(arrivals(spark, d), ["ts", "event_id"], buckets=buckets)


@query("rt16_layered", f"WITH {LAYERED} SELECT * FROM l")
def rt16(spark, d):
    return rounded(layered(spark, d).select("event_id", "user_id", "group_id", "layer"))


@query("rt16_second_layer", f"WITH {layered_sql(60)} SELECT * FROM l")
def rt16_second(spark, d):
    """With 60 buckets, so that most users come to the second layer."""
    return rounded(layered(spark, d, 60).select("event_id", "user_id", "group_id", "layer"))


@query("bm16_cache_hit_rate", f"""WITH {LAYERED} SELECT count(*) FILTER (layer <> 'L2_realtime') AS hits, count(*) FILTER (layer = 'L2_realtime') AS misses, {r(chr(39).join(['count(*) FILTER (layer <> ', 'L2_realtime', ') * 100.0 / count(*)']), 'hit_rate_pct')} FROM l""")
def bm16_cache(spark, d):
    return rounded(routing.cache_hit_rate(layered(spark, d)))


@query("bm16_utilization", f"WITH {pool_sql('50000')}, {FIRST} SELECT count(*) FILTER (k < stop) AS used, {r('count(*) FILTER (k < stop) / 500.0', 'utilization_pct')} FROM k, f")
def bm16_pool(spark, d):
    return rounded(routing.pool_utilization(routing.slot_pool(arrivals(spark, d), 50_000, order=["ts", "event_id"]), 50_000))


def dealt(order: str, capacity: str) -> str:
    return f"WITH {pool_sql(capacity)}, k AS (SELECT {USER} AS user_id, row_number() OVER (ORDER BY {order}) - 1 AS k FROM customer) SELECT user_id, k, CASE WHEN k < stop THEN k % 10 ELSE -1 END AS group_id FROM k, f"


@query("rt23_prebucket_split", dealt("c_custkey", roomy("c_custkey", "customer")))
def rt23(spark, d):
    return rounded(routing.prebucket_split(users(spark, d, "c_custkey"), ["c_custkey"]))


FEW = "(SELECT least(count(*), 1000) FROM customer)"


@query("rt24_snake_split", f"WITH {snake_sql(buckets=FEW)} SELECT user_id, bucket, group_id FROM u JOIN m USING (bucket)")
def rt24(spark, d):
    """As many buckets as users, 1,000 at most."""
    return rounded(routing.snake_split(users(spark, d)))


# --- routers whose decisions need all before them: over trials -------------------------------


def trials(n: int, each: int, pool: int = 1_000_000_000) -> str:
    """CTE x (t, i, user_id, salt)."""
    id_ = mm("'20260728_' || t || '_' || i")
    return f"x AS (SELECT t, i, 'u_' || lpad(({id_} % {pool})::VARCHAR, 9, '0') AS user_id, 'exp_' || t AS salt FROM (SELECT unnest(range({n})) AS t), (SELECT unnest(range({each})) AS i))"


def fold_sql(source: str, base: str, pick: str) -> str:
    """Sizes of groups after a fold: a picked user goes to the smallest group so far, another to base."""
    step = "list_transform(c, lambda v, j: v + CASE WHEN j = (CASE WHEN x[2] = 1 THEN list_position(c, list_min(c)) ELSE x[1] + 1 END) THEN 1 ELSE 0 END)"
    return f"""WITH {source}, l AS (SELECT t, list([{base}, {pick}]::BIGINT[] ORDER BY i) AS l FROM x GROUP BY 1),
c AS (SELECT t, list_reduce(list_prepend(list_resize([0]::BIGINT[], 10, 0), l), lambda c, x: {step}) AS c FROM l)
SELECT t AS trial, unnest(range(10)) AS group_id, unnest(c) AS n FROM c"""


SALTED = mm("user_id || '_' || salt")
SHARE = f"({mm(chr(39).join(['salt || ', '_', ' || i || ', '_', ' || user_id']))} / 4294967296.0 < 0.7)::INT"


@query("rt17_calibrated", fold_sql(trials(20, 5000), f"{SALTED} % 1000 % 10", f"""(i > 0 AND {mm("user_id || '_' || salt || '_calib'")} % 1000 % 10 = 0)::INT"""))
def rt17(spark, d):
    return rounded(simulate.routed_sizes(simulate.trial_users(spark, 20, 5000), simulate.fold_calibrated))


@query("rt19_share_calibrated", fold_sql(trials(20, 5000), f"{SALTED} % 10", SHARE))
def rt19(spark, d):
    return rounded(simulate.routed_sizes(simulate.trial_users(spark, 20, 5000), simulate.fold_share_calibrated))


def sticky(ids, salt):
    return simulate.fold_share_calibrated(ids, salt, sticky=True, buckets=1000)


@query("rt20_sticky_calibrated", fold_sql(trials(20, 5000, 3000).replace("x AS", "every AS") + ", x AS (SELECT t, min(i) AS i, user_id, salt FROM every GROUP BY t, user_id, salt)", f"{SALTED} % 1000 % 10", SHARE))
def rt20(spark, d):
    """Streams in which users return."""
    return rounded(simulate.routed_sizes(simulate.trial_users(spark, 20, 5000, 3000), sticky))


ARRIVED = f"x AS (SELECT 0 AS t, row_number() OVER (ORDER BY ts, event_id) - 1 AS i, user_id, 'exp_001' AS salt FROM ({ARRIVE}))"


def sizes(routed, groups=10):
    return rounded(routing.group_sizes(routed, groups))


def untried(sql: str) -> str:
    return f"SELECT group_id, n FROM ({sql})"


@query("rt17_stream", untried(fold_sql(ARRIVED, f"{SALTED} % 1000 % 10", f"""(i > 0 AND {mm("user_id || '_' || salt || '_calib'")} % 1000 % 10 = 0)::INT""")))
def rt17_stream(spark, d):
    """The calibrated router over all events: the sizes it makes."""
    return sizes(ordered.calibrated_route(arrivals(spark, d), ["ts", "event_id"]))


@query("rt19_stream", untried(fold_sql(ARRIVED, f"{SALTED} % 10", SHARE)))
def rt19_stream(spark, d):
    return sizes(ordered.share_calibrated_route(arrivals(spark, d), ["ts", "event_id"]))


@query("rt20_stream", untried(fold_sql(ARRIVED.replace("x AS", "every AS") + ", x AS (SELECT t, min(i) AS i, user_id, salt FROM every GROUP BY t, user_id, salt)", f"{SALTED} % 1000 % 10", SHARE)))
def rt20_stream(spark, d):
    """The sticky router over all events: users by group."""
    routed = ordered.sticky_route(arrivals(spark, d), ["ts", "event_id"])
    return sizes(routed.groupBy("user_id").agg(F.first("group_id").alias("group_id")))


ADAPTIVE = f"""WITH RECURSIVE {snake_sql(source=f"SELECT DISTINCT user_id FROM ({ARRIVE})")},
k AS (SELECT user_id, event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS k, {h('user_id', repr('exp_001'))} % 1000 AS bucket FROM ({ARRIVE})),
c AS (SELECT k // 500 AS w, bucket, count(*) AS n, count(*) FILTER (k = first) AS new, min(k) AS first FROM (SELECT *, min(k) OVER (PARTITION BY user_id) AS first FROM k) GROUP BY 1, 2),
v AS (SELECT w.w, list(coalesce(c.n, 0) ORDER BY b.bucket) AS n, list(coalesce(c.new, 0) ORDER BY b.bucket) AS new, list(coalesce(c.first, 9000000000) ORDER BY b.bucket) AS first
  FROM (SELECT DISTINCT w FROM c) w CROSS JOIN b LEFT JOIN c ON c.w = w.w AND c.bucket = b.bucket GROUP BY 1),
p AS (SELECT list(place ORDER BY bucket) AS place, list(group_id ORDER BY bucket) AS g FROM (SELECT bucket, group_id, row_number() OVER (ORDER BY group_id, n DESC, bucket) AS place FROM m JOIN b USING (bucket))),
s AS (
  SELECT -1 AS w, g AS used, g, list_resize([0::HUGEINT], 1000, 0) AS seen, list_resize([0::HUGEINT], 10, 0) AS size, list_resize([9000000000::BIGINT], 10, 9000000000) AS met FROM p
  UNION ALL
  SELECT w, used, CASE WHEN moves THEN list_transform(used, lambda x, i: CASE WHEN list_contains(own, i) THEN lo - 1 ELSE x END) ELSE used END, seen,
    CASE WHEN moves THEN list_transform(size, lambda x, i: x + CASE WHEN i = lo THEN 1 ELSE 0 END * seen[own[-1]] * len(own) - CASE WHEN i = hi THEN 1 ELSE 0 END * seen[own[-1]] * len(own)) ELSE size END, met
  FROM (SELECT *, full_ AND abs(size[hi] - mean) / mean >= 0.05 AND len(own) > 0 AS moves
    FROM (SELECT *, list_transform(list_slice(list_sort(list_transform(list_filter(range(1, 1001), lambda i: used[i] = hi - 1 AND seen[i] > 1), lambda i: [-seen[i], place[i], i])), 1, floor(mean * 0.05 / 0.5)::BIGINT), lambda x: x[3]::BIGINT) AS own
      FROM (SELECT *, list_sort(list_transform(list_filter(range(1, 11), lambda i: met[i] < 9000000000), lambda i: [-size[i], met[i], i]))[1][3]::BIGINT AS hi,
          list_sort(list_transform(list_filter(range(1, 11), lambda i: met[i] < 9000000000), lambda i: [size[i], met[i], i]))[1][3]::BIGINT AS lo, list_sum(size) / 10.0::DOUBLE AS mean
        FROM (SELECT v.w, p.place, s.g AS used, list_transform(s.seen, lambda x, i: x + v.new[i]) AS seen, (SELECT count(*) FROM k) >= (v.w + 1) * 500 AS full_,
            list_transform(s.size, lambda x, j: x + list_sum(list_transform(v.n, lambda y, i: CASE WHEN s.g[i] = j - 1 THEN y ELSE 0 END))) AS size,
            list_transform(s.met, lambda x, j: CASE WHEN x < 9000000000 THEN x ELSE list_min(list_transform(v.first, lambda y, i: CASE WHEN s.g[i] = j - 1 THEN y ELSE 9000000000 END)) END) AS met
          FROM s JOIN v ON v.w = s.w + 1 CROSS JOIN p)))))
SELECT event_id, user_id, k, k // 500 AS w, s.used[bucket + 1]::BIGINT AS group_id FROM k JOIN s ON s.w = k.k // 500"""


@query("rt21_stream", ADAPTIVE)
def rt21_stream(spark, d):
    """The adaptive router over all events."""
    return rounded(ordered.adaptive_route(arrivals(spark, d), ["ts", "event_id"]).select("event_id", "user_id", "k", "w", "group_id"))


@query("rt21_adaptive")
def rt21(spark, d):
    """Over the published trials (50 of 5,000 users)."""
    return rounded(simulate.routed_sizes(simulate.pcg_users(spark, 50, 5000), simulate.fold_adaptive))


@query("rt28_stream_harness")
def rt28(spark, d):
    """P1, P2 and P3 fed with 100 made-up streams."""
    t, out = simulate.pcg_users(spark, 100, 5000), None
    layers = lambda u, s: [g for g, _ in simulate.fold_layered(u, s)]
    for name, fold, capacity in (("slot_pool", simulate.fold_slot_pool, 50_000), ("growing_pool", simulate.fold_growing_pool, 10_000), ("layered", layers, None)):
        one = simulate.stream_summary(t, fold, capacity).withColumn("router", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return rounded(out)


@query("mc09_pool_trials")
def mc09(spark, d):
    return rounded(simulate.summarize(rt28(spark, d), keys=["router"]))


# --- checks of a split ----------------------------------------------------------------------


@query("bm05_cumulative_srm", f"""WITH c AS (SELECT strftime(ts, '%Y-%m-%d') AS day, {h("'user_' || user_id", repr('exp_001'))} % 1000 % 2 AS g FROM events),
n AS (SELECT day, sum(count(*) FILTER (g = 0)) OVER (ORDER BY day)::DOUBLE AS a, sum(count(*) FILTER (g = 1)) OVER (ORDER BY day)::DOUBLE AS b FROM c GROUP BY 1),
x AS (SELECT *, pow(a - b, 2) / (a + b) AS x FROM n), q AS (SELECT *, {sqlfn.p_chi2('x', 1)} AS p FROM x), v AS (SELECT *, CASE WHEN p < 0.001 THEN 'critical' WHEN p < 0.01 THEN 'high' WHEN p < 0.05 THEN 'medium' ELSE 'normal' END AS level FROM q)
SELECT day, (a + b)::BIGINT AS total, greatest(a, b)::BIGINT AS max_n, least(a, b)::BIGINT AS min_n, {r('x', 'chi2')}, {r('p', 'p_value')}, level, {r('abs(a - b) / (a + b) * 100', 'max_group_diff_pct')},
CASE level {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in balance.ACTIONS.items())} END AS action FROM v""")
def bm05_cumulative(spark, d):
    e = arrivals(spark, d).select(F.date_format("ts", "yyyy-MM-dd").alias("day"), routing.pure_hash("user_id", groups=2).alias("group_id"))
    return rounded(balance.srm_monitoring(e.groupBy("day", "group_id").agg(F.count("*").alias("n")), "day", 2))


@query("bm12_bound_table", f"""SELECT n::BIGINT AS n, {r('n / 1000.0', 'per_bucket')}, {r('sqrt(n / 1000.0)', 'bucket_std')}, {r('sqrt(100) * sqrt(n / 1000.0)', 'group_std')}, {r('3 * sqrt(100) * sqrt(n / 1000.0) / (n / 10.0) * 100', 'bound_3sigma_pct')} FROM (VALUES (500), (5000), (50000), (500000)) v(n)""")
def bm12(spark, d):
    return rounded(balance.bound_table(spark))


STRATA = f"""e AS (SELECT {', '.join(f"quantile_cont({c}, {i}/3.0) AS {c}_{i}" for c in ('c_acctbal', 'c_nationkey') for i in (1, 2))} FROM customer),
t AS (SELECT {USER} AS user_id, c_custkey, c_acctbal, c_nationkey, {' || chr(45) || '.join(f"(({c} > {c}_1)::INT + ({c} > {c}_2)::INT)" for c in ('c_acctbal', 'c_nationkey'))} AS stratum FROM customer, e),
g AS (SELECT *, (row_number() OVER (ORDER BY c_custkey) - 1) % 10 AS pool, (row_number() OVER (PARTITION BY stratum ORDER BY {h('user_id', repr('exp_001'))}, user_id) - 1) % 10 AS strat FROM t)"""


@query("bm17_stratified_vs_overall", f"WITH {STRATA} " + " UNION ALL ".join(f"SELECT '{f}' AS feature, " + ", ".join(f"(SELECT round(max(abs(a - m)) / abs(any_value(m)) * 100, 6) + 0.0 FROM (SELECT avg({f}) AS a FROM g GROUP BY {by}), (SELECT avg({f}) AS m FROM g)) AS {name}" for by, name in (("pool", "overall_diff_pct"), ("strat", "stratified_diff_pct"))) for f in ("c_acctbal", "c_nationkey")))
def bm17(spark, d):
    u, f = users(spark, d, "c_custkey", "c_acctbal", "c_nationkey"), ["c_acctbal", "c_nationkey"]
    pool = u.join(routing.prebucket_split(u, ["c_custkey"]).select("user_id", "group_id").hint("merge"), "user_id")
    strata = routing.stratified_assign(routing.create_strata(u, f), 10)
    a, b = (balance.mean_deviation(x, "group_id", f).withColumnRenamed("max_diff_pct", n) for x, n in ((pool, "overall_diff_pct"), (strata, "stratified_diff_pct")))
    return rounded(a.join(b, "feature"))


DRY = f"""dry AS (SELECT g.group_id AS g, y.sim, coalesce(avg(({mm("'aa_' || y.sim || '_' || x.user_id")} / 4294967296.0 < 0.05)::INT), 0)::DOUBLE AS v FROM (SELECT unnest(range(10)) AS group_id) g CROSS JOIN (SELECT unnest(range(5)) AS sim) y
LEFT JOIN (SELECT user_id, group_id FROM u JOIN m USING (bucket)) x ON x.group_id = g.group_id GROUP BY 1, 2),
da AS (SELECT g, count(*) AS n, avg(v) AS m, var_pop(v) AS s FROM dry GROUP BY 1), dt AS (SELECT avg(m) AS mean, sum(n * s) AS ssw FROM da),
df AS (SELECT sum(n * pow(m - mean, 2)) / 9 / (any_value(ssw) / 40) AS f FROM da, dt), dp AS (SELECT f, {sqlfn.p_f('f', '9', '40')} AS p FROM df)"""


@query("st09_aa_of_groups", f"WITH {snake_sql()}, {DRY} SELECT {r('f', 'f_stat')}, {r('p', 'p_value')}, p > 0.05 AS passed FROM dp")
def st09(spark, d):
    return rounded(balance.aa_of_groups(routing.assign_groups(users(spark, d)), 10))


@query("rp03_split_report", f"""{SIZES}, {DRY}, t AS (SELECT sum(n)::DOUBLE AS t FROM s), q AS (SELECT stddev_pop(n) / avg(n) AS hd, 10 / sum(n)::DOUBLE * sum(n * n) - sum(n) AS x FROM s), c AS (SELECT hd, {sqlfn.p_chi2('x', 9)} AS sp, p AS ap FROM q, dp)
SELECT 'group ' || group_id || ' n' AS item, {r('n', 'value')}, '-' AS passed FROM s UNION ALL SELECT 'group ' || group_id || ' share_pct', {r('n / t * 100', 'v')}, '-' FROM s, t
UNION ALL SELECT 'group ' || group_id || ' deviation_pct', {r('(n - t / 10) / (t / 10) * 100', 'v')}, '-' FROM s, t UNION ALL SELECT 'hash_diff', {r('hd', 'v')}, CASE WHEN hd < 0.01 THEN 'pass' ELSE 'fail' END FROM c UNION ALL SELECT 'srm_p', {r('sp', 'v')}, CASE WHEN sp >= 0.001 THEN 'pass' ELSE 'fail' END FROM c
UNION ALL SELECT 'aa_p', {r('ap', 'v')}, CASE WHEN ap > 0.05 THEN 'pass' ELSE 'fail' END FROM c UNION ALL SELECT 'mde', {r('2.801585218 * sqrt(0.095 / n)', 'v')}, '-' FROM s WHERE group_id = 0 UNION ALL SELECT 'all', NULL, CASE WHEN hd < 0.01 AND sp >= 0.001 AND ap > 0.05 THEN 'pass' ELSE 'fail' END FROM c""")
def rp03(spark, d):
    return rounded(balance.split_report(routing.assign_groups(users(spark, d)), 10))


# --- estimators -----------------------------------------------------------------------------


def two_covariates(name: str, y: str, a: int, b: int) -> str:
    """CUPED with pre and a second covariate w, the two-by-two system written out."""
    return f"""SELECT '{name}' AS method, arm, {y} - t1 * (pre - mx) - t2 * (w - mw) AS z, {a} AS da, {b} AS db FROM m, (SELECT *, (sy1 * s22 - sy2 * s12) / (s11 * s22 - s12 * s12) AS t1, (sy2 * s11 - sy1 * s12) / (s11 * s22 - s12 * s12) AS t2 FROM
(SELECT avg(pre) AS mx, avg(w) AS mw, var_samp(pre) AS s11, var_samp(w) AS s22, covar_samp(pre, w) AS s12, covar_samp({y}, pre) AS sy1, covar_samp({y}, w) AS sy2 FROM m))"""


WELCH = """a AS (SELECT method, count(*) FILTER (arm = 1) AS nt, count(*) FILTER (arm = 0) AS nc, avg(z) FILTER (arm = 1) AS mt, avg(z) FILTER (arm = 0) AS mc, var_samp(z) FILTER (arm = 1) AS vt, var_samp(z) FILTER (arm = 0) AS vc,
CASE WHEN any_value(da) = 1 THEN var_samp(z) ELSE var_pop(z) END AS vz, CASE WHEN any_value(db) = 1 THEN (SELECT var_samp(post) FROM m) ELSE (SELECT var_pop(post) FROM m) END AS vy FROM z GROUP BY 1),
t AS (SELECT *, (mt - mc) / sqrt(vt / nt + vc / nc) AS t, pow(vt / nt + vc / nc, 2) / (pow(vt / nt, 2) / (nt - 1) + pow(vc / nc, 2) / (nc - 1)) AS nu FROM a)"""
WIDE = METRICS.replace("m AS (SELECT", "m0 AS (SELECT") + ", m AS (SELECT *, pre_orders AS w FROM m0)"


@query("st16_extended", f"""WITH {WIDE}, o AS (SELECT covar_samp(post, pre) / var_samp(pre) AS th, avg(pre) AS mx FROM m),
z AS (SELECT 'plain' AS method, arm, post AS z, 0 AS da, 0 AS db FROM m UNION ALL SELECT 'did', arm, post - pre, 1, 1 FROM m UNION ALL SELECT 'cuped', arm, post - th * (pre - mx), 0, 1 FROM m, o UNION ALL {two_covariates('multi_cuped', 'post', 0, 0)} UNION ALL {two_covariates('did_multi_cuped', '(post - pre)', 0, 1)}), {WELCH}
SELECT method, {r('mt - mc', 'effect', 4)}, {r('t', 't_stat', 4)}, {r('nu', 'nu', 4)}, {r('1 - vz / vy', 'var_reduction', 4)}, {r(sqlfn.p_t('t', 'nu'), 'p_value', 4)} FROM t""")
def st16_extended(spark, d):
    return rounded(effects.extended_estimators(metrics(spark, d), "arm", "pre", "post", ["pre", "pre_orders"]), 4)


@query("st16_multi_cuped", f"""WITH {WIDE}, z AS ({two_covariates('multi', 'post', 1, 1)}), {WELCH}
SELECT {r('mt - mc', 'effect', 4)}, {r('t', 't_stat', 4)}, {r('nu', 'nu', 4)}, {r('1 - vz / vy', 'var_reduction', 4)}, 2::BIGINT AS n_covariates, {r(sqlfn.p_t('t', 'nu'), 'p_value', 4)} FROM t""")
def st16(spark, d):
    """Two covariates; a multiple of the first and a constant are left out."""
    m = metrics(spark, d).withColumns({"copy": F.col("pre") * 2, "flat": F.lit(1.0)})
    return rounded(effects.multi_cuped(m, "arm", "post", ["pre", "pre_orders", "copy", "flat"]), 4)


SEASON = METRICS.replace("m AS (SELECT", "m0 AS (SELECT") + ", m AS (SELECT m0.*, w FROM m0 JOIN (SELECT o_custkey, (avg((isodow(o_orderdate) < 6)::INT) >= 0.75)::INT AS w FROM orders WHERE o_orderdate < '1998-01-01' GROUP BY 1) ON o_custkey = seq)"


@query("st17_seasonal_cuped", f"""WITH {SEASON}, z AS ({two_covariates('seasonal', 'post', 0, 0)}), {WELCH}
SELECT {r('mt - mc', 'effect', 4)}, {r('t', 't_stat', 4)}, {r('nu', 'nu', 4)}, {r('1 - vz / vy', 'var_reduction', 4)}, 2::BIGINT AS n_covariates, {r(sqlfn.p_t('t', 'nu'), 'p_value', 4)} FROM t""")
def st17(spark, d):
    """Customers who order on weekdays for the most part, and the others."""
    o = read(spark, d, "orders").filter(F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp"))
    w = o.groupBy(F.col("o_custkey").alias("seq")).agg((F.avg((F.weekday("o_orderdate") < 5).cast("double")) >= 0.75).cast("double").alias("weekday"))
    m = metrics(spark, d).join(w, "seq").withColumn("weekend", 1 - F.col("weekday"))
    return rounded(effects.seasonal_cuped(m, "arm", "pre", "post", "weekday", "weekend"), 4)


@query("st18_finance_did", f"""WITH {METRICS}, z AS (SELECT 'did' AS method, arm, post - pre AS z, 1 AS da, 1 AS db FROM m), {WELCH} SELECT {r('mt - mc', 'effect', 4)}, {r('t', 't_stat', 4)}, {r(sqlfn.p_t('t', 'nu'), 'p_value', 4)} FROM t""")
def st18(spark, d):
    return rounded(effects.pre_post(metrics(spark, d), "arm", "pre", "post").filter("method = 'did'").select("effect", "t_stat", "p_value"), 4)


@query("sc06_z_normalized", f"""WITH {METRICS} SELECT user_id, {r('(ln(1 + pre) - avg(ln(1 + pre)) OVER ()) / stddev_pop(ln(1 + pre)) OVER ()', 'log_pre_norm')}, {r('(ln(1 + pre_orders) - avg(ln(1 + pre_orders)) OVER ()) / stddev_pop(ln(1 + pre_orders)) OVER ()', 'log_pre_orders_norm')} FROM m""")
def sc06(spark, d):
    return rounded(effects.z_normalized(metrics(spark, d), ["pre", "pre_orders"]).select("user_id", "log_pre_norm", "log_pre_orders_norm"))


TREATED = f"""{METRICS}, b AS (SELECT arm, quantile_cont(post, 0.05) AS lo, quantile_cont(post, 0.95) AS hi, quantile_cont(post, 0.99) AS top FROM m GROUP BY 1),
z AS (SELECT unnest(['raw', 'winsorized', 'capped', 'log']) AS method, arm, unnest([post, least(greatest(post, lo), hi), least(post, top), ln(1 + post)]) AS z, 1 AS da, 1 AS db FROM m JOIN b USING (arm)), {WELCH}"""
RANKED = """k AS (SELECT arm, rank() OVER (ORDER BY post) + (count(*) OVER (PARTITION BY post) - 1) / 2.0 AS rk FROM m), ti AS (SELECT sum(pow(c, 3) - c) AS ties FROM (SELECT count(*)::DOUBLE AS c FROM m GROUP BY post)),
rs AS (SELECT sum(rk) FILTER (arm = 1) AS rt, count(*) FILTER (arm = 1)::DOUBLE AS nt, count(*) FILTER (arm = 0)::DOUBLE AS nc FROM k), ru AS (SELECT nt, nc, rt - nt * (nt + 1) / 2 AS u, sqrt(nt * nc / 12 * (nt + nc + 1 - ties / ((nt + nc) * (nt + nc - 1)))) AS sd FROM rs, ti),
rz AS (SELECT (greatest(u, nt * nc - u) - nt * nc / 2 - 0.5) / sd AS rz FROM ru)"""


@query("st22_compare_outliers", f"""WITH {TREATED}, {RANKED} SELECT method, {r('mt - mc', 'effect', 4)}, {r('t', 't_stat', 4)}, {r(sqlfn.p_t('t', 'nu'), 'p_value', 4)} FROM t UNION ALL SELECT 'rank', NULL, {r('rz', 't_stat', 4)}, {r('CASE WHEN rz < 0 THEN 1.0 ELSE ' + sqlfn.p_norm('rz') + ' END', 'p_value', 4)} FROM rz""")
def st22(spark, d):
    return rounded(effects.compare_outliers(metrics(spark, d), "arm", "post"), 4)


@query("st22_outlier_study")
def st22_study(spark, d):
    """100 trials with an effect of 5 per cent."""
    return rounded(effects.outlier_study(metrics(spark, d), "arm", "post", "user_id"), 4)


@query("st26_bayes_against_z")
def st26(spark, d):
    return rounded(effects.bayes_against_z(spark.createDataFrame([(1500, 180, 1500, 145)], "n_t long, x_t long, n_c long, x_c long")))


# --- Monte-Carlo studies --------------------------------------------------------------------

STRATEGIES = {
    "hash": (f"{SALTED} % 1000 % 10", 1000), "many_buckets": (f"{SALTED} % 10000 % 10", 10_000),
    "double_hash": (f"""xor({mm("user_id || '_' || salt || '_v1'")}, {mm("user_id || '_' || salt || '_v2'")}) % 1000 % 10""", 1000),
    "double_hash_many": (f"""xor({mm("user_id || '_' || salt || '_v1'")}, {mm("user_id || '_' || salt || '_v2'")}) % 10000 % 10""", 10_000),
    "two_stage": (f"""{mm("user_id || '_' || salt || '_v2'")} % 10""", 1000),
}
SUMMARY = "count(*) AS trials, " + ", ".join([r("avg(v)", "mean"), r("quantile_cont(v, 0.5)", "median"), r("stddev_pop(v)", "std"), r("quantile_cont(v, 0.95)", "p95"), r("quantile_cont(v, 0.99)", "p99"), r("min(v)", "min"), r("max(v)", "max"), r("avg((v < 1)::INT)", "pass_rate")])


def deviations(source: str, group: str, keys: str = "t", groups: int = 10) -> str:
    """(keys, v): the largest deviation of a group; source has a row a user."""
    return f"SELECT {keys}, greatest(max(n) - avg(n), avg(n) - min(n)) / avg(n) * 100 AS v FROM (SELECT {keys}, g, count(*) AS n FROM (SELECT *, {group} AS g FROM {source}) GROUP BY {keys}, g) GROUP BY {keys}"


@query("mc03_strategies", f"WITH {trials(50, 5000)} " + " UNION ALL ".join(f"SELECT '{n}' AS strategy, {SUMMARY} FROM ({deviations('x', sql)})" for n, (sql, _) in STRATEGIES.items()))
def mc03(spark, d):
    """R0, R1, R2, R4 and the two-stage hash over 50 trials of 5,000 users."""
    t, out = simulate.trial_users(spark, 50, 5000), None
    for name, (_, buckets) in STRATEGIES.items():
        one = simulate.summarize(simulate.trial_deviation(t, {"many_buckets": "hash", "double_hash_many": "double_hash"}.get(name, name), buckets)).withColumn("strategy", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return rounded(out)


@query("mc11_strategy_grid")
def mc11(spark, d):
    """The published grid: 100 trials of the snake by traffic and of the hashes, the vote and the calibrated router at 5,000 users."""
    small, out = simulate.pcg_users(spark, 100, 5000), None
    for name, n, t in (("snake", 5000, small), ("snake", 10_000, simulate.pcg_users(spark, 100, 10_000)), ("hash", 5000, small), ("double_hash", 5000, small), ("two_stage", 5000, small), ("vote", 5000, small)):
        one = simulate.summarize(simulate.trial_deviation(t, name)).withColumns({"strategy": F.lit(name), "users": F.lit(n)})
        out = one if out is None else out.unionByName(one)
    share = balance.deviation_pct(simulate.routed_sizes(small, simulate.fold_share_calibrated), ["trial"])
    return rounded(out.unionByName(simulate.summarize(share).withColumns({"strategy": F.lit("calibrated"), "users": F.lit(5000)})))


@query("mc02_batch_vs_realtime", f"""WITH {trials(50, 5000)}, u AS (SELECT t, {SALTED} % 1000 AS b FROM x), n AS (SELECT k.t, k.b, count(u.b) AS n FROM (SELECT t, b FROM (SELECT unnest(range(50)) AS t), (SELECT unnest(range(1000)) AS b)) k LEFT JOIN u USING (t, b) GROUP BY 1, 2),
o AS (SELECT t, n, row_number() OVER (PARTITION BY t ORDER BY n DESC, b) - 1 AS p FROM n), s AS (SELECT t, CASE WHEN (p // 10) % 2 = 0 THEN p % 10 ELSE 9 - p % 10 END AS g, sum(n) AS n FROM o GROUP BY 1, 2),
a AS (SELECT t, greatest(max(n) - 500, 500 - min(n)) / 5.0 AS a FROM s GROUP BY 1) SELECT a.t AS trial, {r('a', 'batch_dev_pct')}, {r('v', 'realtime_dev_pct')} FROM a JOIN ({deviations('x', STRATEGIES['hash'][0])}) USING (t)""")
def mc02(spark, d):
    t = simulate.trial_users(spark, 50, 5000)
    a, b = (simulate.trial_deviation(t, s).withColumnRenamed("max_dev_pct", n) for s, n in (("snake", "batch_dev_pct"), ("hash", "realtime_dev_pct")))
    return rounded(a.join(b, "trial"))


@query("mc05_layer_scan")
def mc05(spark, d):
    """Deviation of the union of 1 to 10 layers over 50 trials of 5,000 users."""
    t, out = simulate.pcg_users(spark, 50, 5000), None
    for n in (1, 2, 3, 5, 8, 10):
        one = simulate.summarize(balance.deviation_pct(simulate.trial_sizes(t, "union", layers=n), ["trial"])).withColumn("layers", F.lit(n))
        out = one if out is None else out.unionByName(one)
    return rounded(out)


TRAFFIC = (500, 1000, 5000)


@query("mc06_bias_by_traffic", "WITH " + ", ".join(trials(50, n).replace("x AS", f"x{n} AS", 1) for n in TRAFFIC) + " " + " UNION ALL ".join(f"SELECT {n}::BIGINT AS users, {r(f'1.96 / sqrt({n} / 10.0) * 100', 'bound_pct')}, {SUMMARY} FROM ({deviations(f'x{n}', STRATEGIES['hash'][0])})" for n in TRAFFIC))
def mc06(spark, d):
    """Measured deviation of the hash by traffic, next to the bound."""
    out = None
    for n in TRAFFIC:
        one = simulate.summarize(simulate.trial_deviation(simulate.trial_users(spark, 50, n), "hash")).withColumns({"users": F.lit(n), "bound_pct": balance.deviation_bound(F.lit(n), F.lit(10))})
        out = one if out is None else out.unionByName(one)
    return rounded(out)


SWEEP = (10, 100, 1000, 10_000)


@query("mc07_bucket_sweep", f"WITH {trials(20, 5000)}, hh AS (SELECT t, {SALTED} AS hh FROM x) " + " UNION ALL ".join(f"SELECT {b}::BIGINT AS buckets, {SUMMARY} FROM ({deviations('hh', f'hh % {b} % 10')})" for b in SWEEP))
def mc07_sweep(spark, d):
    """Deviation of the hash by the number of buckets."""
    t, out = simulate.trial_users(spark, 20, 5000), None
    for b in SWEEP:
        one = simulate.summarize(simulate.trial_deviation(t, "hash", b)).withColumn("buckets", F.lit(b))
        out = one if out is None else out.unionByName(one)
    return rounded(out)


BINS = " ".join(f"WHEN v >= {a} AND v {'<=' if i == len(simulate.EDGES) - 2 else '<'} {b} THEN {i}" for i, (a, b) in enumerate(zip(simulate.EDGES, simulate.EDGES[1:])))


@query("mc07_histogram", f"""WITH {trials(50, 5000)}, d AS (SELECT CASE {BINS} END AS bin FROM ({deviations('x', STRATEGIES['hash'][0])}))
SELECT k.bin, count(d.bin) AS n FROM (SELECT unnest(range({len(simulate.EDGES) - 1})) AS bin) k LEFT JOIN d USING (bin) GROUP BY 1""")
def mc07(spark, d):
    return rounded(simulate.histogram(simulate.trial_deviation(simulate.trial_users(spark, 50, 5000), "hash"), "max_dev_pct"))


@query("mc08_calibration_trials")
def mc08(spark, d):
    """The hash, the bucket quota and three routers with shared counts over 100 trials of 5,000 users."""
    t = simulate.pcg_users(spark, 100, 5000)
    sizes = {"hash": simulate.trial_sizes(t, "hash")}
    quota = routing.route_quota(t).groupBy("trial", "group_id").agg(F.count("*").alias("n"))
    sizes["quota"] = quota
    for name, fold in (("calibrated", simulate.fold_calibrated), ("share", simulate.fold_share_calibrated), ("adaptive", simulate.fold_adaptive)):
        sizes[name] = simulate.routed_sizes(t, fold)
    out = None
    for name, n in sizes.items():
        one = simulate.summarize(balance.deviation_pct(n, ["trial"])).withColumn("strategy", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return rounded(out)


@query("mc10_orthogonality_trials")
def mc10(spark, d):
    return rounded(simulate.orthogonality_study(simulate.pcg_users(spark, 50, 5000), LAYERS))


@query("mc12_full_evaluation")
def mc12(spark, d):
    u = users(spark, d, "c_custkey", F.col("c_acctbal").cast("double").alias("c_acctbal"), F.col("c_nationkey").cast("double").alias("c_nationkey"))
    return rounded(simulate.full_evaluation(u, ["c_acctbal", "c_nationkey"], order=["c_custkey"]))


POWER_EFFECT = 0.05


def power_sql(effect: float, measured: str = "power") -> str:
    """(method, trials, measured, mean_effect, mean_var_reduction) of 200 trials."""
    def each(name: str, y: str, theta: str) -> str:
        return f"SELECT '{name}' AS method, x.t, arm, {y} - {theta} * (pre - mx) AS z, vy FROM x JOIN o ON x.t = o.t"

    return f"""SELECT method, count(*) AS trials, {r('avg((p < 0.05)::INT)', measured)}, {r('avg(effect)', 'mean_effect', 4)}, {r('avg(vr)', 'mean_var_reduction')} FROM (
WITH {METRICS}, g AS (SELECT t, pre, post, ({mm("'arm_' || t || '_' || user_id")} / 4294967296.0 < 0.5)::INT AS arm FROM m, (SELECT unnest(range(200)) AS t)),
x AS (SELECT t, arm, pre, post * (CASE WHEN arm = 1 THEN {1 + effect!r} ELSE 1 END)::DOUBLE AS post FROM g),
o AS (SELECT t, covar_samp(post, pre) / var_samp(pre) AS t1, covar_samp(post - pre, pre) / var_samp(pre) AS t2, avg(pre) AS mx, var_pop(post) AS vy FROM x GROUP BY 1),
z AS ({each('plain', 'post', '0.0')} UNION ALL {each('did', '(post - pre)', '0.0')} UNION ALL {each('cuped', 'post', 't1')} UNION ALL {each('did_cuped', '(post - pre)', 't2')}),
a AS (SELECT method, t, any_value(vy) AS vy, var_pop(z) AS vz, count(*) FILTER (arm = 1) AS nt, count(*) FILTER (arm = 0) AS nc, {', '.join(f"{f}(z) FILTER (arm = {k}) AS {c}{s}" for f, c in (('avg', 'm'), ('var_samp', 'v')) for k, s in ((1, 't'), (0, 'c')))} FROM z GROUP BY 1, 2),
s AS (SELECT method, mt - mc AS effect, 1 - vz / vy AS vr, (mt - mc) / sqrt(vt / nt + vc / nc) AS st, pow(vt / nt + vc / nc, 2) / (pow(vt / nt, 2) / (nt - 1) + pow(vc / nc, 2) / (nc - 1)) AS nu FROM a)
SELECT method, effect, vr, {sqlfn.p_t('st', 'nu', closed=True)} AS p FROM s) GROUP BY 1"""


def effects_rounded(out):
    """mean_effect to four places: it is some thousands."""
    return rounded(out.withColumn("mean_effect", F.round("mean_effect", 4)))


@query("mc13_power", power_sql(POWER_EFFECT))
def mc13(spark, d):
    return effects_rounded(simulate.power_study(metrics(spark, d), "pre", "post", 200, POWER_EFFECT))


@query("mc13_type1", f"SELECT *, type1 BETWEEN 0.02 AND 0.08 AS sound FROM ({power_sql(0.0, 'type1')})")
def mc13_type1(spark, d):
    """How often the estimators find an effect where there is none; 2 to 8 per cent is sound."""
    s = simulate.power_study(metrics(spark, d), "pre", "post", 200, 0.0).withColumnRenamed("power", "type1")
    return effects_rounded(s.withColumn("sound", F.col("type1").between(0.02, 0.08)))


@query("rp05_study_report", f"SELECT p.*, type1, type1 BETWEEN 0.02 AND 0.08 AS sound, CASE WHEN p.mean_var_reduction BETWEEN 0 AND 1 THEN p.mean_var_reduction ELSE 0.0 END AS valid_var_reduction FROM ({power_sql(POWER_EFFECT)}) p JOIN ({power_sql(0.0, 'type1')}) q USING (method)")
def rp05(spark, d):
    """Power next to type-I error, and the variance reduction of trials in which it is between 0 and 1."""
    a, b = mc13(spark, d), mc13_type1(spark, d).select("method", "type1", "sound")
    valid = F.when(F.col("mean_var_reduction").between(0, 1), F.col("mean_var_reduction")).otherwise(F.lit(0.0))
    return rounded(a.join(b, "method").withColumn("valid_var_reduction", valid))


@query("wn09_bandit_regret")
def wn09(spark, d):
    return rounded(simulate.bandit_track(spark, [0.10, 0.14, 0.14, 0.14, 0.14]))


@query("dm01_seasonal")
def dm01(spark, d):
    """Seasonal CUPED next to CUPED with the earlier metric alone, on made-up data."""
    m = io.synthetic_seasonal(spark)
    one = effects.multi_cuped(m, "assigned", "post", ["pre"], ddof=(0, 0)).withColumn("method", F.lit("cuped"))
    return rounded(one.unionByName(effects.seasonal_cuped(m, "assigned", "pre", "post", "weekday", "weekend").withColumn("method", F.lit("seasonal"))))


# --- sources, sinks and streams -------------------------------------------------------------


def shared_folder(spark, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("io01_csv_users", f"SELECT {USER} AS user_id, c_nationkey::BIGINT AS age, round(abs(c_acctbal), 2)::DOUBLE AS yearly_income FROM customer")
def io01(spark, d):
    """Users written as CSV with prices and read again."""
    folder = shared_folder(spark, "users")
    price = F.concat(F.lit("$"), F.round(F.abs("c_acctbal"), 2).cast("decimal(18,2)").cast("string"))
    io.write_csv(users(spark, d, F.col("c_nationkey").alias("age"), F.lit(None).cast("int").alias("credit_score"), price.alias("yearly_income"), F.lit("$0").alias("total_debt")), folder)
    return rounded(io.load_users(spark, folder).select("user_id", "age", "yearly_income"), 2)


@query("io02_csv_transactions", f"SELECT {OUSER} AS client_id, o_orderdate AS date, round(o_totalprice, 2)::DOUBLE AS amount FROM orders WHERE o_orderkey % 7 <> 0")
def io02(spark, d):
    """Transactions written as CSV, some without a date, and read again cleaned."""
    folder = shared_folder(spark, "transactions")
    o = read(spark, d, "orders")
    date = F.when(F.col("o_orderkey") % 7 == 0, F.lit("no date")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    amount = F.concat(F.lit("$-"), F.round("o_totalprice", 2).cast("decimal(18,2)").cast("string"))
    none = [F.lit(None).cast("string").alias(c) for c in ("use_chip", "merchant_id", "merchant_city", "merchant_state")]
    io.write_csv(o.select(F.concat(F.lit("user_"), F.col("o_custkey")).alias("client_id"), date.alias("date"), amount.alias("amount"), *none), folder)
    return rounded(io.load_transactions(spark, folder).select("client_id", "date", "amount"), 2)


@query("io10_split_sample")
def io10(spark, d):
    return rounded(io.split_sample(spark))


def event_stream(spark, d, *more):
    src = read(spark, d, "events")
    stream = spark.readStream.schema(src.schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return stream.select(F.concat(F.lit("user_"), F.col("user_id")).alias("user_id"), F.col("ts").cast("timestamp").alias("ts"), *more)


@query("str_hourly_counts", f"SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, {h(chr(39) + 'user_' + chr(39) + ' || user_id', repr('exp_001'))} % 1000 % 2 AS group_id, count(*) AS n FROM events GROUP BY 1, 2")
def hourly(spark, d):
    """The events replayed through hourly windows with a watermark; all windows, the open ones too."""
    from ..streaming import routers

    out = routers.run_to_table(routers.hourly_counts(event_stream(spark, d), "ts", "user_id"), "complete")
    return rounded(out.select(F.col("hour.start").cast("timestamp_ntz").alias("hour"), "group_id", "n"))


GROUP_2 = f"{h(chr(39) + 'user_' + chr(39) + ' || user_id', repr('exp_001'))} % 1000 % 2"


@query("str_hourly_closed", f"SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, {GROUP_2} AS group_id, count(*) AS n FROM events WHERE date_trunc('hour', ts) + INTERVAL 2 HOUR <= (SELECT date_trunc('milliseconds', max(ts)) FROM events) GROUP BY 1, 2")
def hourly_closed(spark, d):
    """The same windows in append mode: those that the watermark, an hour behind, has closed."""
    from ..streaming import routers

    out = routers.run_to_table(routers.hourly_counts(event_stream(spark, d), "ts", "user_id"), "append")
    return rounded(out.select(F.col("hour.start").cast("timestamp_ntz").alias("hour"), "group_id", "n"))


@query("str_hourly_srm", f"""WITH c AS (SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, {GROUP_2} AS g FROM events WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events)),
o AS (SELECT hour, count(*) FILTER (g = 0) AS a, count(*) FILTER (g = 1) AS b FROM c GROUP BY 1),
n AS (SELECT hour, a + b AS n_window, sum(a) OVER (ORDER BY hour)::DOUBLE AS a, sum(b) OVER (ORDER BY hour)::DOUBLE AS b FROM o),
x AS (SELECT *, pow(a - b, 2) / (a + b) AS x FROM n), q AS (SELECT *, {sqlfn.p_chi2('x', 1)} AS p FROM x), v AS (SELECT *, CASE WHEN p < 0.001 THEN 'critical' WHEN p < 0.01 THEN 'high' WHEN p < 0.05 THEN 'medium' ELSE 'normal' END AS level FROM q)
SELECT hour, n_window, (a + b)::BIGINT AS total, greatest(a, b)::BIGINT AS max_n, least(a, b)::BIGINT AS min_n, {r('x', 'chi2')}, {r('p', 'p_value')}, level, {r('abs(a - b) / (a + b) * 100', 'max_group_diff_pct')},
CASE level {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in balance.ACTIONS.items())} END AS action FROM v""")
def hourly_srm(spark, d):
    """Sample-ratio monitoring of the events' stream: each hour once, when the watermark closes it."""
    from ..streaming import health

    folder = shared_folder(spark, "srm")
    health.run_to_end(health.stream_srm(event_stream(spark, d), "ts", "user_id", folder))
    return rounded(health.emitted(spark, folder).withColumn("hour", F.col("start").cast("timestamp_ntz")).drop("start"))


@query("st07_stream", f"""WITH e AS (SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, {h(chr(39) + 'user_' + chr(39) + ' || user_id', repr('ab'))} % 2 AS arm, value AS y FROM events WHERE value IS NOT NULL AND date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events WHERE value IS NOT NULL)),
g AS (SELECT event_type, day, {', '.join(f"count(*) FILTER (arm = {k})::DOUBLE AS n{s}, coalesce(sum(y) FILTER (arm = {k}), 0) AS s{s}, coalesce(sum(y * y) FILTER (arm = {k}), 0) AS q{s}" for k, s in ((1, 't'), (0, 'c')))} FROM e GROUP BY 1, 2),
w AS (SELECT event_type, day, {', '.join(f"sum({c}) OVER (PARTITION BY event_type ORDER BY day) AS {c}" for c in ('nt', 'st', 'qt', 'nc', 'sc', 'qc'))} FROM g),
v AS (SELECT *, st / nt AS mt, sc / nc AS mc, (qt - st * st / nt) / nullif(nt - 1, 0) AS vt, (qc - sc * sc / nc) / nullif(nc - 1, 0) AS vc FROM w),
t AS (SELECT *, (mt - mc) / sqrt(vt / nt + vc / nc) AS t, pow(vt / nt + vc / nc, 2) / (pow(vt / nt, 2) / (nt - 1) + pow(vc / nc, 2) / (nc - 1)) AS nu, 0.05 * sqrt(ln(1 + least(nt, nc)) / least(nt, nc)) AS b FROM v),
p AS (SELECT *, {sqlfn.p_t('t', 'nu', closed=True)} AS p FROM t)
SELECT event_type, day, nt::BIGINT AS n_t, nc::BIGINT AS n_c, {r('mt - mc', 'effect', 4)}, {r('t', 't_stat', 4)}, {r('p', 'p_value', 4)}, {r('b', 'boundary', 4)}, coalesce(p < b, false) AS stop,
coalesce(p < b, false) AND count(*) FILTER (p < b) OVER (PARTITION BY event_type ORDER BY day) = 1 AS signal FROM p""")
def st07_stream(spark, d):
    """The sequential test of each event type on the events' stream, a row a day, with one stop signal an experiment."""
    from ..streaming import health

    folder = shared_folder(spark, "sequential")
    src = event_stream(spark, d, "event_type", "value").withColumn("arm", (murmur("user_id", F.lit("ab")) % 2).cast("int"))
    health.run_to_end(health.stream_sequential(src, "ts", "arm", "value", folder, ["event_type"]))
    return rounded(health.emitted(spark, folder).withColumn("day", F.date_format("start", "yyyy-MM-dd")).drop("start"), 4)


@query("rp02_report")
def rp02(spark, d):
    text = monitoring.experiment_report(metrics(spark, d), "arm", "urgent", ["pre", "pre_orders"], ["seq"], secondary={"post": "continuous"}, identity=("exp_001", "urgent orders", "1998-01-01", "1998-08-02"))
    return spark.createDataFrame([(i, x) for i, x in enumerate(text.split("\n"))], "line int, text string")

