"""Every query of the library with its SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.murmur import murmur
from ..operators import balance, effects, monitoring, routing, simulate
from ..operators.moments import arms
from ..sources import io
from . import sqlfn
from .sqlfn import murmur as mm

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, without negative zero; counts as long."""
    return df.select(*[(F.round(F.col(c), digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if t in ("int", "bigint", "smallint") else F.col(c) for c, t in df.dtypes])


def r(x: str, name: str, digits: int = 6) -> str:
    return f"round(({x})::DOUBLE, {digits}) + 0.0 AS {name}"


def users(spark: SparkSession, d: str, *more: str) -> DataFrame:
    return read(spark, d, "customer").select(F.concat(F.lit("user_"), F.col("c_custkey")).alias("user_id"), *more)


USER = "'user_' || c_custkey"
ID = "'u' || c_custkey"

# --- routing -------------------------------------------------------------------------------


def h(*parts: str) -> str:
    return mm(" || '_' || ".join(parts))


def grouped(expr: str) -> str:
    return f"SELECT {USER} AS user_id, ({expr})::BIGINT AS group_id FROM customer"


@query("rt01_hash_to_bucket", f"SELECT {USER} AS user_id, {h(USER, repr('exp_001'))} % 1000 AS bucket FROM customer")
def rt01(spark, d):
    return rounded(users(spark, d).withColumn("bucket", routing.bucket("user_id")))


def snake_sql(salt: str = "exp_001", buckets: int | str = 1000, groups: int = 10, source: str = f"SELECT {USER} AS user_id FROM customer") -> str:
    """CTEs u (user_id, bucket) and m (bucket, group_id)."""
    return f"""u AS (SELECT user_id, {h('user_id', repr(salt))} % {buckets} AS bucket FROM ({source})),
b AS (SELECT k.bucket, count(u.bucket) AS n FROM (SELECT unnest(range({buckets})) AS bucket) k LEFT JOIN u USING (bucket) GROUP BY 1),
o AS (SELECT bucket, row_number() OVER (ORDER BY n DESC, bucket) - 1 AS p FROM b),
m AS (SELECT bucket, CASE WHEN (p // {groups}) % 2 = 0 THEN p % {groups} ELSE {groups} - 1 - p % {groups} END AS group_id FROM o)"""


SIZES = f"WITH {snake_sql()}, s AS (SELECT g.group_id, count(u.bucket) AS n FROM (SELECT unnest(range(10)) AS group_id) g LEFT JOIN m USING (group_id) LEFT JOIN u USING (bucket) GROUP BY 1)"


@query("rt02_snake_assign", f"WITH {snake_sql()} SELECT bucket, n, group_id FROM b JOIN m USING (bucket)")
def rt02(spark, d):
    n = users(spark, d).withColumn("bucket", routing.bucket("user_id")).groupBy("bucket").agg(F.count("*").alias("n"))
    return rounded(routing.snake_map(n, 1000, 10))


@query("rt03_assign_groups", f"WITH {snake_sql()} SELECT user_id, bucket, group_id FROM u JOIN m USING (bucket)")
def rt03(spark, d):
    return rounded(routing.assign_groups(users(spark, d)))


@query("rt03_assign_groups_sizes", f"{SIZES} SELECT group_id, n FROM s")
def rt03_sizes(spark, d):
    return rounded(routing.group_sizes(routing.assign_groups(users(spark, d)), 10))


@query("rt04_pure_hash", grouped(f"{h(USER, repr('exp_001'))} % 1000 % 10"))
def rt04(spark, d):
    return rounded(users(spark, d).withColumn("group_id", routing.pure_hash("user_id")))


@query("rt06_many_buckets", grouped(f"{h(USER, repr('exp_001'))} % 10000 % 10"))
def rt06(spark, d):
    return rounded(users(spark, d).withColumn("group_id", routing.pure_hash("user_id", buckets=10_000)))


for _name, _b in (("rt07_double_hash", 1000), ("rt09_double_hash_many_buckets", 10_000)):
    QUERIES[_name] = lambda spark, d, b=_b: rounded(users(spark, d).withColumn("group_id", routing.double_hash("user_id", buckets=b)))
    ORACLES[_name] = grouped(f"xor({h(USER, repr('exp_001'), repr('v1'))}, {h(USER, repr('exp_001'), repr('v2'))}) % {_b} % 10")


def vote_sql(keys: list[str], mod: str) -> str:
    votes = " UNION ALL ".join(f"SELECT {USER} AS user_id, {i} AS i, {h(USER, repr(k))} {mod} AS v FROM customer" for i, k in enumerate(keys))
    return f"WITH v AS ({votes}), c AS (SELECT user_id, v, count(*) AS n, min(i) AS f FROM v GROUP BY 1, 2) SELECT user_id, arg_max(v, n * 100 - f)::BIGINT AS group_id FROM c GROUP BY 1"


@query("rt08_salt_vote", vote_sql([f"exp_001_s{i}" for i in range(4)], "% 10"))
def rt08(spark, d):
    return rounded(routing.salt_vote(users(spark, d), "user_id", [f"exp_001_s{i}" for i in range(4)], None, 10))


@query("rt10_two_stage_hash", grouped(f"{h(USER, repr('exp_001'), repr('v2'))} % 10"))
def rt10(spark, d):
    return rounded(users(spark, d).withColumn("group_id", routing.two_stage_hash("user_id")))


@query("rt11_layer_union", vote_sql(["exp_001_L0", "exp_001_L1"], "% 1000 % 10"))
def rt11(spark, d):
    return rounded(routing.salt_vote(users(spark, d).distinct(), "user_id", ["exp_001_L0", "exp_001_L1"], 1000, 10))


LAYERS = {"rec": (1000, 2, "rec_v1"), "sch": (1000, 2, "sch_v1"), "ui": (1000, 2, "ui_v1")}
LAYER_SQL = f"l AS (SELECT {USER} AS user_id, " + ", ".join(f"{h(USER, repr(s))} % {b} % {g} AS {n}" for n, (b, g, s) in LAYERS.items()) + " FROM customer)"


@query("rt12_orthogonal_layers", f"WITH {LAYER_SQL} SELECT * FROM l")
def rt12(spark, d):
    return rounded(routing.route_layers(users(spark, d), LAYERS))


WARM = "SELECT 'warmup_' || i AS user_id FROM (SELECT unnest(range(10000)) AS i)"


@query("rt13_bucket_quota", f"""WITH {snake_sql(buckets=100, source=WARM)} SELECT user_id, m.bucket, group_id FROM (SELECT {USER} AS user_id, {h(USER, repr('exp_001'))} % 100 AS bucket FROM customer) JOIN m USING (bucket)""")
def rt13(spark, d):
    return rounded(routing.route_quota(users(spark, d), buckets=100))


def arrivals(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select(F.concat(F.lit("user_"), F.col("user_id")).alias("user_id"), "ts", "event_id")


ARRIVE = "SELECT 'user_' || user_id AS user_id, ts, event_id FROM events"
def pool_sql(capacity: str) -> str:
    """CTEs down to f (stop): the first rank that finds the group whose turn it is without a slot."""
    virtual = f"SELECT 'v_' || lpad(i::VARCHAR, 8, '0') AS user_id FROM (SELECT unnest(range({capacity})) AS i)"
    return f"""{snake_sql(source=virtual)},
s AS (SELECT group_id, count(*) AS slots FROM u JOIN m USING (bucket) GROUP BY 1),
f AS (SELECT min(coalesce(slots, 0) * 10 + g.group_id) AS stop FROM (SELECT unnest(range(10)) AS group_id) g LEFT JOIN s USING (group_id))"""


def roomy(users: str, source: str) -> str:
    return f"(SELECT greatest(5 * count(DISTINCT {users}), 50000) FROM {source})"


FIRST = f"a AS (SELECT user_id, min((ts, event_id)) AS o FROM ({ARRIVE}) GROUP BY 1), k AS (SELECT user_id, row_number() OVER (ORDER BY o, user_id) - 1 AS k FROM a)"
DEALT = "SELECT user_id, k, CASE WHEN k < stop THEN k % 10 ELSE -1 END AS group_id FROM k, f"


@query("rt14_slot_pool", f"WITH {pool_sql(roomy('user_id', 'events'))}, {FIRST} {DEALT}")
def rt14(spark, d):
    return rounded(routing.prebucket_split(arrivals(spark, d), ["ts", "event_id"]))


@query("rt18_hybrid", f"""WITH {snake_sql(buckets=100, source=WARM)},
k AS (SELECT user_id, event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS k, {h('user_id', repr('exp_001'))} % 100 AS bucket FROM ({ARRIVE})),
w AS (SELECT k // 500 AS w, bucket % 10 AS g, count(*) AS n FROM k GROUP BY 1, 2),
c AS (SELECT x.w, y.g, sum(coalesce(w.n, 0)) OVER (PARTITION BY y.g ORDER BY x.w) AS c FROM (SELECT DISTINCT w FROM w) x CROSS JOIN (SELECT unnest(range(10)) AS g) y LEFT JOIN w ON w.w = x.w AND w.g = y.g),
t AS (SELECT w, max(c) AS top, sum(c) AS n FROM c GROUP BY 1),
s AS (SELECT coalesce((min(w) + 1) * 500, 1000000000) AS stop FROM t WHERE n % 500 = 0 AND top / (n / 10.0) - 1 > 0.05)
SELECT event_id, user_id, k, CASE WHEN k < stop THEN k.bucket % 10 ELSE m.group_id END::BIGINT AS group_id FROM k JOIN m USING (bucket), s""")
def rt18(spark, d):
    return rounded(routing.hybrid_route(arrivals(spark, d), ["ts", "event_id"], buckets=100, window=500).select("event_id", "user_id", "k", "group_id"))


@query("rt22_multi_mapping", f"WITH {snake_sql(salt='exp_001_v0')} SELECT user_id, bucket, group_id FROM u JOIN m USING (bucket)")
def rt22(spark, d):
    return rounded(routing.assign_groups(users(spark, d), salt="exp_001_v0"))


def edges_sql(col: str, bins: int = 3) -> str:
    return ", ".join(f"quantile_cont({col}, {i / bins!r}) AS {col}_{i}" for i in range(1, bins))


@query("rt25_strata", f"""WITH e AS (SELECT {edges_sql('c_acctbal')}, {edges_sql('c_nationkey')} FROM customer)
SELECT {USER} AS user_id, (CASE WHEN c_acctbal > c_acctbal_1 THEN 1 ELSE 0 END + CASE WHEN c_acctbal > c_acctbal_2 THEN 1 ELSE 0 END) || '-' || (CASE WHEN c_nationkey > c_nationkey_1 THEN 1 ELSE 0 END + CASE WHEN c_nationkey > c_nationkey_2 THEN 1 ELSE 0 END) AS stratum FROM customer, e""")
def rt25(spark, d):
    return routing.create_strata(users(spark, d, "c_acctbal", "c_nationkey"), ["c_acctbal", "c_nationkey", "absent"]).select("user_id", "stratum")


@query("rt26_stratified", f"""SELECT user_id, stratum, CASE WHEN k < 49991 THEN k % 10 ELSE -1 END AS group_id FROM (SELECT {USER} AS user_id, c_mktsegment AS stratum, row_number() OVER (PARTITION BY c_mktsegment ORDER BY {h(USER, repr('exp_001'))}, {USER}) - 1 AS k FROM customer)""")
def rt26(spark, d):
    return rounded(routing.stratified_assign(users(spark, d, F.col("c_mktsegment").alias("stratum")), 10, 50_000).select("user_id", "stratum", "group_id"))


# --- balance and planning ------------------------------------------------------------------


@query("bm01_deviation", f"{SIZES} SELECT {r('avg(n)', 'mean_n')}, max(n) AS max_n, min(n) AS min_n, {r('greatest(max(n) - avg(n), avg(n) - min(n)) / avg(n) * 100', 'max_dev_pct')} FROM s")
def bm01(spark, d):
    return rounded(balance.deviation_pct(routing.group_sizes(routing.assign_groups(users(spark, d)), 10)))


@query("bm02_hash_diff", f"{SIZES} SELECT {r('stddev_pop(n) / avg(n)', 'hash_diff')} FROM s")
def bm02(spark, d):
    return rounded(balance.hash_diff(routing.group_sizes(routing.assign_groups(users(spark, d)), 10)))


HASHED = f"s AS (SELECT g.group_id, count(u.g) AS n FROM (SELECT unnest(range(10)) AS group_id) g LEFT JOIN (SELECT {h(USER, repr('exp_001'))} % 1000 % 10 AS g FROM customer) u ON u.g = g.group_id GROUP BY 1)"
SRM_OUT = f"""SELECT total, max_n, min_n, {r('x', 'chi2')}, 9.0::DOUBLE AS df, {r('p', 'p_value')}, CASE WHEN p < 0.001 THEN 'FAIL' WHEN p < 0.05 THEN 'WARN' ELSE 'PASS' END AS verdict,
p > 0.05 AS passed, p < 0.01 AS alert, p >= 0.01 AND p < 0.05 AS warning, CASE WHEN p < 0.001 THEN 'critical' WHEN p < 0.01 THEN 'high' WHEN p < 0.05 THEN 'medium' ELSE 'normal' END AS level FROM q"""


@query("bm03_srm", f"""WITH {HASHED}, t AS (SELECT sum(n)::BIGINT AS total, max(n) AS max_n, min(n) AS min_n, 10 / sum(n)::DOUBLE * sum(n * n) - sum(n) AS x FROM s),
q AS (SELECT *, {sqlfn.p_chi2('x', 9)} AS p FROM t) {SRM_OUT}""")
def bm03(spark, d):
    return rounded(balance.srm(routing.group_sizes(users(spark, d).withColumn("group_id", routing.pure_hash("user_id")), 10)))


@query("bm04_srm_expected", f"""WITH {HASHED}, w AS (SELECT n, CASE WHEN group_id = 0 THEN 2.0 ELSE 1.0 END AS w FROM s),
t AS (SELECT sum(n)::BIGINT AS total, max(n) AS max_n, min(n) AS min_n, sum(w) / sum(n)::DOUBLE * sum(n * n / w) - sum(n) AS x FROM w),
q AS (SELECT *, {sqlfn.p_chi2('x', 9)} AS p FROM t) {SRM_OUT}""")
def bm04(spark, d):
    return rounded(balance.srm(routing.group_sizes(users(spark, d).withColumn("group_id", routing.pure_hash("user_id")), 10), [2.0] + [1.0] * 9))


@query("bm07_orthogonality", f"""WITH {LAYER_SQL}, c AS (SELECT rec AS a, sch AS b, count(*) AS n FROM l GROUP BY 1, 2), t AS (SELECT count(*)::DOUBLE AS n FROM l),
e AS (SELECT x.a, y.b, x.na * y.nb / t.n AS e, coalesce(c.n, 0) AS o FROM (SELECT a, sum(n) AS na FROM c GROUP BY 1) x CROSS JOIN (SELECT b, sum(n) AS nb FROM c GROUP BY 1) y CROSS JOIN t LEFT JOIN c ON c.a = x.a AND c.b = y.b),
q AS (SELECT sum(pow(greatest(abs(o - e) - least(0.5, abs(o - e)), 0), 2) / e) AS x, max(abs(o - e) / e) * 100 AS hi, avg(abs(o - e) / e) * 100 AS mean FROM e)
SELECT 1.0::DOUBLE AS df, {r('x', 'chi2')}, {r('hi', 'max_dev_pct')}, {r('mean', 'mean_dev_pct')}, {r(sqlfn.p_chi2('x', 1), 'p_value')}, {sqlfn.p_chi2('x', 1)} > 0.05 AS passed FROM q""")
def bm07(spark, d):
    return rounded(balance.orthogonality(routing.route_layers(users(spark, d), LAYERS), "rec", "sch"))


@query("bm08_traffic_reuse", f"""WITH {LAYER_SQL}, c AS (SELECT count(*) AS n FROM l GROUP BY rec, sch, ui)
SELECT count(*) AS combos, sum(n)::BIGINT AS total, min(n) AS min_n, max(n) AS max_n, {r('sum(n) / 8.0', 'expected')}, {r('min(n) / max(n)', 'balance')} FROM c""")
def bm08(spark, d):
    return rounded(balance.traffic_reuse(routing.route_layers(users(spark, d), LAYERS), list(LAYERS), 8))


@query("ag13_contingency", f"WITH {LAYER_SQL} SELECT rec AS a, ui AS b, count(*) AS n FROM l GROUP BY 1, 2")
def ag13(spark, d):
    return rounded(balance.contingency(routing.route_layers(users(spark, d), LAYERS), "rec", "ui"))


@query("bm09_planning", f"""SELECT n, {r('2.8015852 * sqrt(0.095 / n)', 'mde_abs', 5)}, {r('2.8015852 * sqrt(0.095 / n) / 0.05 * 100', 'mde_rel_pct', 3)}, {r('1.96 / sqrt(n / 10.0) * 100', 'bound_pct')}, {r('3 / sqrt(n / 10.0) * 100', 'bound_3sigma_pct')} FROM (VALUES (500), (1000), (5000), (10000), (50000), (100000), (1000000)) v(n)""")
def bm09(spark, d):
    n = spark.createDataFrame([(x,) for x in (500, 1000, 5000, 10_000, 50_000, 100_000, 1_000_000)], "n int")
    m = balance.mde(F.col("n").cast("double"))
    out = n.select("n", F.round(m, 5).alias("mde_abs"), F.round(m / 0.05 * 100, 3).alias("mde_rel_pct"), balance.deviation_bound(F.col("n"), F.lit(10)).alias("bound_pct"), balance.deviation_bound(F.col("n"), F.lit(10), 3).alias("bound_3sigma_pct"))
    return rounded(out)


@query("bm13_sample_sizes", f"""SELECT bias_pct, g AS groups, ceil(pow(1.96 / (bias_pct / 100), 2))::BIGINT AS min_per_group, ceil(pow(1.96 / (bias_pct / 100), 2) * g)::BIGINT AS min_total, {r('9.0 * g * g / (pow(bias_pct / 100, 2) * 1000)', 'per_bucket')} FROM (VALUES (0.5::DOUBLE), (1.0::DOUBLE), (2.0::DOUBLE), (5.0::DOUBLE)) a(bias_pct), (VALUES (2), (3), (5), (10), (20), (50), (100)) b(g)""")
def bm13(spark, d):
    grid = spark.createDataFrame([(b, g) for b in (0.5, 1.0, 2.0, 5.0) for g in (2, 3, 5, 10, 20, 50, 100)], "bias_pct double, groups int")
    b, g = F.col("bias_pct"), F.col("groups")
    return rounded(grid.select(b, g, balance.min_per_group(b).cast("long").alias("min_per_group"), balance.min_total(b, g).cast("long").alias("min_total"), (9.0 * g * g / (F.pow(b / 100, 2) * 1000)).alias("per_bucket")))


ARM = f"{h(USER, repr('ab'))} % 2"


def anova_sql(source: str, features: list[str]) -> str:
    parts = " UNION ALL ".join(f"SELECT g, '{f}' AS feature, {f}::DOUBLE AS v FROM x" for f in features)
    return f"""WITH x AS ({source}), u AS ({parts}), a AS (SELECT feature, g, count(*) AS n, avg(v) AS m, var_pop(v) AS s FROM u WHERE v IS NOT NULL GROUP BY 1, 2),
t AS (SELECT feature, count(*) AS k, sum(n)::BIGINT AS n, sum(n * m) / sum(n) AS mean, sum(n * s) AS ssw FROM a GROUP BY 1),
f AS (SELECT t.feature, t.k, t.n, t.mean, ssw, sum(a.n * pow(a.m - t.mean, 2)) AS ssb, max(abs(a.m - t.mean)) AS dev FROM a JOIN t USING (feature) GROUP BY ALL),
q AS (SELECT *, ssb / (k - 1) / (ssw / (n - k)) AS fs FROM f)
SELECT feature, k, n, {r('mean', 'mean')}, {r('fs', 'f_stat')}, {r(sqlfn.p_f('fs', '(k - 1)', '(n - k)'), 'p_value')}, {r('dev / abs(mean) * 100', 'max_diff_pct')}, {sqlfn.p_f('fs', '(k - 1)', '(n - k)')} > 0.05 AS passed, {sqlfn.p_f('fs', '(k - 1)', '(n - k)')} < 0.01 AS alert FROM q"""


@query("st03_anova", anova_sql(f"SELECT {h(USER, repr('exp_001'))} % 1000 % 10 AS g, c_acctbal, c_nationkey FROM customer", ["c_acctbal", "c_nationkey"]))
def st03(spark, d):
    return rounded(balance.anova(users(spark, d, "c_acctbal", "c_nationkey").withColumn("g", routing.pure_hash("user_id")), "g", ["c_acctbal", "c_nationkey", "absent"]))


# --- metrics per customer ------------------------------------------------------------------


def metrics(spark: SparkSession, d: str) -> DataFrame:
    """Per customer with orders on both sides of 1998: arm, spend before and after, an urgent order after."""
    o = read(spark, d, "orders")
    pre = F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp")
    agg = o.groupBy("o_custkey").agg(F.sum(F.when(pre, F.col("o_totalprice"))).alias("pre"), F.sum(F.when(~pre, F.col("o_totalprice"))).alias("post"), F.max(F.when(~pre & (F.col("o_orderpriority") == "1-URGENT"), 1).otherwise(0)).alias("urgent"), F.count(F.when(pre, 1)).cast("double").alias("pre_orders"))
    return agg.filter("pre is not null and post is not null").select(F.concat(F.lit("user_"), F.col("o_custkey")).alias("user_id"), "pre", "post", "urgent", "pre_orders", F.col("o_custkey").alias("seq")).withColumn("arm", (murmur("user_id", F.lit("ab")) % 2).cast("int"))


OUSER = "'user_' || o_custkey"
METRICS = f"""m AS (SELECT {OUSER} AS user_id, o_custkey AS seq, {h(OUSER, repr('ab'))} % 2 AS arm, sum(o_totalprice) FILTER (o_orderdate < '1998-01-01') AS pre, sum(o_totalprice) FILTER (o_orderdate >= '1998-01-01') AS post,
max(CASE WHEN o_orderdate >= '1998-01-01' AND o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS urgent, count(*) FILTER (o_orderdate < '1998-01-01')::DOUBLE AS pre_orders FROM orders GROUP BY o_custkey HAVING pre IS NOT NULL AND post IS NOT NULL)"""
CONV_OUT = f"""pt - pc AS diff, (pt - pc) / pc * 100 AS lift, (pt - pc) / sqrt(pp * (1 - pp) * (1.0 / n_t + 1.0 / n_c)) AS z, sqrt(pt * (1 - pt) / n_t + pc * (1 - pc) / n_c) AS sd, sqrt(pt * (1 - pt) / n_t) AS own FROM"""


@query("st01_conversion", f"""WITH {METRICS}, c AS (SELECT count(*) FILTER (arm = 1) AS n_t, sum(urgent) FILTER (arm = 1)::DOUBLE AS x_t, count(*) FILTER (arm = 0) AS n_c, sum(urgent) FILTER (arm = 0)::DOUBLE AS x_c FROM m),
p AS (SELECT *, x_t / n_t AS pt, x_c / n_c AS pc, (x_t + x_c) / (n_t + n_c) AS pp FROM c), q AS (SELECT *, {CONV_OUT} p)
SELECT n_t, {r('x_t', 'x_t')}, n_c, {r('x_c', 'x_c')}, {r('pt', 'rate_t')}, {r('pc', 'rate_c')}, {r('diff', 'diff')}, {r('lift', 'lift_pct')}, {r('z', 'z')}, {r('diff - 1.96 * sd', 'ci_low')}, {r('diff + 1.96 * sd', 'ci_high')}, {r('pt - 1.96 * own', 'rate_t_low')}, {r('pt + 1.96 * own', 'rate_t_high')}, {r('2 * asin(sqrt(pt)) - 2 * asin(sqrt(pc))', 'cohens_h')}, {r(sqlfn.p_norm('z'), 'p_value')}, {sqlfn.p_norm('z')} < 0.05 AS significant FROM q""")
def st01(spark, d):
    m = arms(metrics(spark, d).withColumn("y", F.col("urgent").cast("double")), "arm", ["y"])
    return rounded(effects.conversion_test(m.select("n_t", F.col("sum_y_t").alias("x_t"), "n_c", F.col("sum_y_c").alias("x_c"))))


def two_arm(y: str, source: str = "m") -> str:
    return f"a AS (SELECT count({y}) FILTER (arm = 1) AS n_t, count({y}) FILTER (arm = 0) AS n_c, avg({y}) FILTER (arm = 1) AS mt, avg({y}) FILTER (arm = 0) AS mc, var_samp({y}) FILTER (arm = 1) AS vt, var_samp({y}) FILTER (arm = 0) AS vc, var_pop({y}) FILTER (arm = 1) AS wt, var_pop({y}) FILTER (arm = 0) AS wc FROM {source}), t AS (SELECT *, mt - mc AS diff, (mt - mc) / sqrt(vt / n_t + vc / n_c) AS t, pow(vt / n_t + vc / n_c, 2) / (pow(vt / n_t, 2) / (n_t - 1) + pow(vc / n_c, 2) / (n_c - 1)) AS nu, sqrt(wt / n_t + wc / n_c) AS se FROM a)"


@query("st02_continuous", f"""WITH {METRICS}, {two_arm('post')} SELECT n_t, n_c, {r('mt', 'mean_t', 4)}, {r('mc', 'mean_c', 4)}, {r('diff', 'diff', 4)}, {r('diff / mc * 100', 'lift_pct', 4)}, {r('t', 't_stat', 4)}, {r('nu', 'nu', 4)}, {r('diff - 1.96 * se', 'ci_low', 4)}, {r('diff + 1.96 * se', 'ci_high', 4)}, {r('diff / sqrt((wt + wc) / 2)', 'cohens_d', 4)}, {r(sqlfn.p_t('t', 'nu'), 'p_value', 4)}, {sqlfn.p_t('t', 'nu')} < 0.05 AS significant FROM t""")
def st02(spark, d):
    return rounded(effects.continuous_test(metrics(spark, d), "arm", "post"), 4)


@query("st06_sequential", f"""WITH {METRICS}, {two_arm('post')}, s AS (SELECT *, 0.05 * sqrt(ln(1 + least(n_t, n_c)) / least(n_t, n_c)) AS b FROM t)
SELECT n_t, n_c, {r('diff', 'effect', 4)}, {r('t', 't_stat', 4)}, {r(sqlfn.p_t('t', 'nu'), 'p_value', 4)}, {r('b', 'boundary', 4)}, {sqlfn.p_t('t', 'nu')} < b AS stop FROM s""")
def st06(spark, d):
    return rounded(effects.sequential_test(metrics(spark, d), "arm", "post"), 4)


SEG = "CASE WHEN hh % 2 = 0 THEN 1 ELSE 0 END"
PVALUES = "(VALUES ('a', 0.001), ('b', 0.012), ('c', 0.012), ('d', 0.04), ('e', 0.2), ('f', 0.9)) v(test, p_value)"


def p_table(spark):
    return spark.createDataFrame([("a", 0.001), ("b", 0.012), ("c", 0.012), ("d", 0.04), ("e", 0.2), ("f", 0.9)], "test string, p_value double")


@query("st04_bonferroni", f"SELECT test, p_value::DOUBLE AS p_value, {r('least(1, p_value * 6)', 'p_bonferroni')} FROM {PVALUES}")
def st04(spark, d):
    return rounded(effects.bonferroni(p_table(spark)))


@query("st05_bh_fdr", f"""SELECT test, p_value::DOUBLE AS p_value, {r('least(1, min(raw) OVER (ORDER BY k DESC))', 'p_fdr')} FROM (SELECT *, row_number() OVER (ORDER BY p_value, test) AS k, p_value * 6 / row_number() OVER (ORDER BY p_value, test) AS raw FROM {PVALUES})""")
def st05(spark, d):
    return rounded(effects.benjamini_hochberg(p_table(spark)))


def adjusted(name: str, y: str, theta: str) -> str:
    return f"SELECT '{name}' AS method, arm, {theta} AS theta, {y} - {theta} * (pre - mx) AS z, {y} AS raw FROM m, o"


@query("st11_pre_post", f"""WITH {METRICS}, o AS (SELECT covar_samp(post, pre) / var_samp(pre) AS t1, covar_samp(post - pre, pre) / var_samp(pre) AS t2, avg(pre) AS mx, var_pop(post) AS vy FROM m),
z AS ({adjusted('plain', 'post', '0.0')} UNION ALL {adjusted('did', '(post - pre)', '0.0')} UNION ALL {adjusted('cuped', 'post', 't1')} UNION ALL {adjusted('did_cuped', '(post - pre)', 't2')}),
a AS (SELECT method, theta, count(*) FILTER (arm = 1) AS nt, count(*) FILTER (arm = 0) AS nc, avg(z) FILTER (arm = 1) AS mt, avg(z) FILTER (arm = 0) AS mc, var_samp(z) FILTER (arm = 1) AS vt, var_samp(z) FILTER (arm = 0) AS vc, var_pop(z) AS vz, var_pop(raw) AS vr FROM z GROUP BY 1, 2),
t AS (SELECT *, (mt - mc) / sqrt(vt / nt + vc / nc) AS t, pow(vt / nt + vc / nc, 2) / (pow(vt / nt, 2) / (nt - 1) + pow(vc / nc, 2) / (nc - 1)) AS nu FROM a)
SELECT method, {r('theta', 'theta', 4)}, {r('mt - mc', 'effect', 4)}, {r('t', 't_stat', 4)}, {r('nu', 'nu', 4)}, {r('1 - vz / vy', 'var_reduction', 4)}, {r(sqlfn.p_t('t', 'nu'), 'p_value', 4)} FROM t, o""")
def st11(spark, d):
    return rounded(effects.pre_post(metrics(spark, d), "arm", "pre", "post"), 4)


@query("st19_winsorize", f"""WITH {METRICS}, b AS (SELECT arm, quantile_cont(post, 0.05) AS lo, quantile_cont(post, 0.95) AS hi, quantile_cont(post, 0.99) AS top FROM m GROUP BY 1)
SELECT user_id, {r('least(greatest(post, lo), hi)', 'winsorized', 4)}, {r('least(post, top)', 'capped', 4)}, {r('ln(1 + post)', 'logged')} FROM m JOIN b USING (arm)""")
def st19(spark, d):
    out = effects.cap_top(effects.winsorize(metrics(spark, d), "arm", "post"), "arm", "post")
    return out.select("user_id", F.round("winsorized", 4).alias("winsorized"), F.round("capped", 4).alias("capped"), F.round(F.log1p("post"), 6).alias("logged"))


@query("st23_mann_whitney", f"""WITH {METRICS}, k AS (SELECT arm, pre_orders AS v, rank() OVER (ORDER BY pre_orders) + (count(*) OVER (PARTITION BY pre_orders) - 1) / 2.0 AS rk FROM m),
t AS (SELECT sum(pow(c, 3) - c) AS ties FROM (SELECT count(*)::DOUBLE AS c FROM m GROUP BY pre_orders)), s AS (SELECT sum(rk) FILTER (arm = 1) AS rt, count(*) FILTER (arm = 1)::DOUBLE AS nt, count(*) FILTER (arm = 0)::DOUBLE AS nc FROM k),
u AS (SELECT nt, nc, rt - nt * (nt + 1) / 2 AS u, sqrt(nt * nc / 12 * (nt + nc + 1 - ties / ((nt + nc) * (nt + nc - 1)))) AS sd FROM s, t), z AS (SELECT *, (greatest(u, nt * nc - u) - nt * nc / 2 - 0.5) / sd AS z FROM u)
SELECT nt AS n_t, nc AS n_c, {r('u', 'u_stat')}, {r('z', 'z')}, {r('CASE WHEN z < 0 THEN 1.0 ELSE ' + sqlfn.p_norm('z') + ' END', 'p_value')} FROM z""")
def st23(spark, d):
    return rounded(effects.mann_whitney(metrics(spark, d), "arm", "pre_orders"))


STEPS = ["view", "click", "signup", "purchase"]
FUNNEL_SRC = f"""SELECT user_id, {h("'user_' || user_id", repr('ab'))} % 2 AS arm, (t0 IS NOT NULL)::INT AS view, (t1 IS NOT NULL)::INT AS click, (t2 IS NOT NULL)::INT AS signup, (t3 IS NOT NULL)::INT AS purchase FROM (
SELECT a.user_id, a.t AS t0, b.t AS t1, c.t AS t2, e.t AS t3 FROM (SELECT user_id, min(CASE WHEN event_type = 'view' THEN (ts, event_id) END) AS t FROM events GROUP BY 1) a
LEFT JOIN LATERAL (SELECT min((ts, event_id)) AS t FROM events x WHERE x.user_id = a.user_id AND event_type = 'click' AND (ts, event_id) > a.t) b ON true
LEFT JOIN LATERAL (SELECT min((ts, event_id)) AS t FROM events x WHERE x.user_id = a.user_id AND event_type = 'signup' AND (ts, event_id) > b.t) c ON true
LEFT JOIN LATERAL (SELECT min((ts, event_id)) AS t FROM events x WHERE x.user_id = a.user_id AND event_type = 'purchase' AND (ts, event_id) > c.t) e ON true)"""


def funnel_users(spark, d):
    """Users with a mark for each step they reach after the step before it; one shuffle by user."""
    e, last = read(spark, d, "events").select("user_id", "event_type", F.struct("ts", "event_id").alias("at")), None
    for s in STEPS:
        here = F.col("event_type") == s
        e = e.withColumn(s, F.min(F.when(here if last is None else here & (F.col("at") > F.col(last)), F.col("at"))).over(Window.partitionBy("user_id")))
        last = s
    w = e.groupBy("user_id").agg(*[F.count(s).alias(s) for s in STEPS]).select("user_id", *[(F.col(s) > 0).cast("int").alias(s) for s in STEPS])
    return w.withColumn("arm", (murmur(F.concat(F.lit("user_"), F.col("user_id")), F.lit("ab")) % 2).cast("int"))


@query("st27_funnel", f"WITH w AS ({FUNNEL_SRC}), s AS (" + " UNION ALL ".join(f"SELECT '{s}' AS step, count(*) FILTER (arm = 1) AS n_t, count(*) FILTER (arm = 0) AS n_c, sum(\"{s}\") FILTER (arm = 1)::DOUBLE AS x_t, sum(\"{s}\") FILTER (arm = 0)::DOUBLE AS x_c FROM w" for s in STEPS) + f"), p AS (SELECT *, x_t / n_t AS pt, x_c / n_c AS pc, (x_t + x_c) / (n_t + n_c) AS pp FROM s), q AS (SELECT *, coalesce((pt - pc) / nullif(sqrt(pp * (1 - pp) * (1.0 / n_t + 1.0 / n_c)), 0), 0) AS z FROM p) SELECT step, {r('pt', 'rate_t')}, {r('pc', 'rate_c')}, {r('(pt - pc) / nullif(pc, 0) * 100', 'lift_pct')}, {r('z', 'z')}, {r(sqlfn.p_norm('z'), 'p_value')}, {sqlfn.p_norm('z')} < 0.05 AS significant FROM q")
def st27(spark, d):
    return rounded(effects.funnel(funnel_users(spark, d), "arm", [*STEPS, "absent"]))


def survival(spark, d):
    first = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("ship"))
    o = read(spark, d, "orders").join(first, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    days = F.datediff("ship", "o_orderdate")
    late = days.isNull() | (days > 60) | (days < 1)
    return o.select(F.concat(F.lit("user_"), F.col("o_custkey")).alias("user_id"), F.when(late, 60).otherwise(days).alias("days"), (~late).cast("int").alias("observed")).withColumn("arm", (murmur("user_id", F.lit("ab")) % 2).cast("int"))


SURVIVAL = f"y AS (SELECT {h(OUSER, repr('ab'))} % 2 AS arm, CASE WHEN k IS NULL OR k > 60 OR k < 1 THEN 60 ELSE k END AS days, CASE WHEN k IS NULL OR k > 60 OR k < 1 THEN 0 ELSE 1 END AS observed FROM (SELECT o_custkey, date_diff('day', o_orderdate::DATE, ship::DATE) AS k FROM orders LEFT JOIN (SELECT l_orderkey, min(l_shipdate) AS ship FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey))"


@query("st28_kaplan_meier", f"""WITH {SURVIVAL}, g AS (SELECT arm, unnest(range(1, 61)) AS day FROM (SELECT DISTINCT arm FROM y)),
c AS (SELECT g.arm, g.day, count(*) FILTER (y.days >= g.day) AS at_risk, count(*) FILTER (y.days = g.day AND observed = 1) AS events FROM g JOIN y USING (arm) GROUP BY 1, 2)
SELECT arm, day, at_risk, events, {r('exp(sum(ln(1 - events / at_risk::DOUBLE)) OVER (PARTITION BY arm ORDER BY day))', 'survival')} FROM c""")
def st28(spark, d):
    return rounded(effects.kaplan_meier(survival(spark, d), "days", "observed", ["arm"]))


SURVIVED = f"""WITH {SURVIVAL}, g AS (SELECT arm, unnest(range(1, 61)) AS day FROM (SELECT DISTINCT arm FROM y)),
c AS (SELECT g.arm, g.day, count(*) FILTER (y.days >= g.day) AS at_risk, count(*) FILTER (y.days = g.day AND observed = 1) AS events FROM g JOIN y USING (arm) GROUP BY 1, 2),
k AS (SELECT arm, day, 1 - exp(sum(ln(1 - events / at_risk::DOUBLE)) OVER (PARTITION BY arm ORDER BY day)) AS rate FROM c)"""


@query("st29_compare_survival", f"""{SURVIVED}, rk AS (SELECT arm, rank() OVER (ORDER BY days) + (count(*) OVER (PARTITION BY days) - 1) / 2.0 AS rk FROM y),
ti AS (SELECT sum(pow(c, 3) - c) AS ties FROM (SELECT count(*)::DOUBLE AS c FROM y GROUP BY days)), rs AS (SELECT sum(rk) FILTER (arm = 1) AS rt, count(*) FILTER (arm = 1)::DOUBLE AS nt, count(*) FILTER (arm = 0)::DOUBLE AS nc FROM rk),
u AS (SELECT nt, nc, rt - nt * (nt + 1) / 2 AS u, sqrt(nt * nc / 12 * (nt + nc + 1 - ties / ((nt + nc) * (nt + nc - 1)))) AS sd FROM rs, ti), z AS (SELECT (greatest(u, nt * nc - u) - nt * nc / 2 - 0.5) / sd AS z FROM u)
SELECT a.day, {r('a.rate', 'rate_t')}, {r('b.rate', 'rate_c')}, {r('a.rate - b.rate', 'diff')}, {r('CASE WHEN z < 0 THEN 1.0 ELSE ' + sqlfn.p_norm('z') + ' END', 'p_value')} FROM k a JOIN k b ON a.day = b.day AND a.arm = 1 AND b.arm = 0, z WHERE a.day IN (7, 14, 30)""")
def st29(spark, d):
    return rounded(effects.compare_survival(survival(spark, d), "arm", "days", "observed"))


@query("st30_timepoints", f"""WITH {METRICS}, a AS (SELECT count(*) FILTER (arm = 1) AS n, avg(post) FILTER (arm = 1) AS t, avg(post) FILTER (arm = 0) AS c FROM m)
SELECT day, {r('t * day / 30', 'value_t', 4)}, {r('c * day / 30', 'value_c', 4)}, {r('(t - c) / c * 100', 'lift_pct', 4)}, n FROM a, (VALUES (7), (14), (30)) v(day)""")
def st30(spark, d):
    return rounded(effects.at_timepoints(metrics(spark, d), "arm", "post"), 4)


@query("st31_risk", f"""WITH {METRICS}, a AS (SELECT avg(post) FILTER (arm = 1) AS vt, avg(post) FILTER (arm = 0) AS vc, avg(urgent) FILTER (arm = 1) AS dt, avg(urgent) FILTER (arm = 0) AS dc FROM m)
SELECT {r('vt', 'avg_amount_t', 4)}, {r('vc', 'avg_amount_c', 4)}, {r('dt', 'default_rate_t', 4)}, {r('dc', 'default_rate_c', 4)}, {r('vt * dt', 'expected_loss_t', 4)}, {r('vc * dc', 'expected_loss_c', 4)}, {r('(vc * dc - vt * dt) / (vc * dc) * 100', 'loss_reduction_pct', 4)} FROM a""")
def st31(spark, d):
    return rounded(effects.risk_metrics(metrics(spark, d), "arm", "post", "urgent"), 4)


@query("st08_stability", f"""WITH {METRICS}, k AS (SELECT arm, row_number() OVER (PARTITION BY arm ORDER BY seq) - 1 AS k, avg(post) OVER (PARTITION BY arm ORDER BY seq ROWS UNBOUNDED PRECEDING) AS a FROM m),
e AS (SELECT x.k, x.a - y.a AS e FROM k x JOIN k y ON x.k = y.k AND x.arm = 1 AND y.arm = 0), n AS (SELECT count(*) AS n FROM e),
s AS (SELECT n, avg(e) FILTER (k < n // 3) AS early, avg(e) FILTER (k >= n - n // 3) AS late, arg_max(e, k) AS eff FROM e, n GROUP BY n),
c AS (SELECT stddev_pop(m) AS sd FROM (SELECT avg(e) AS m FROM e, n WHERE k // (n // 10) < 10 GROUP BY k // (n // 10))),
q AS (SELECT *, (late - early) / abs(early) * 100 AS trend FROM s, c)
SELECT n, 'ok' AS status, {r('early', 'early', 3)}, {r('late', 'late', 3)}, {r('trend', 'trend_pct', 3)}, {r('sd', 'chunk_std', 3)}, {r('greatest(0, least(1, 1 - sd / abs(eff)))', 'stability', 3)}, CASE WHEN trend > 20 THEN 'up' WHEN trend < -20 THEN 'down' ELSE 'stable' END AS direction FROM q""")
def st08(spark, d):
    return rounded(effects.stability(metrics(spark, d), "arm", "post", ["seq"]), 3)


@query("st24_beta_binomial")
def st24(spark, d):
    c = spark.createDataFrame([(1500, 180, 1500, 145), (200, 50, 200, 30), (1500, 180, 1500, 150)], "n_t int, x_t int, n_c int, x_c int")
    return rounded(effects.beta_binomial(c))


# --- data preparation, monitoring, decisions -----------------------------------------------


@query("an07_user_consumption", f"""WITH c AS (SELECT quantile_cont(epoch_us(o_orderdate), 0.7)::BIGINT AS s, min(epoch_us(o_orderdate)) AS lo, max(epoch_us(o_orderdate)) AS hi FROM orders),
g AS (SELECT o_custkey AS client, s, lo, hi, avg(o_totalprice) FILTER (epoch_us(o_orderdate) < s) AS a, count(*) FILTER (epoch_us(o_orderdate) < s) AS n, sum(o_totalprice) FILTER (epoch_us(o_orderdate) < s) AS t, avg(o_totalprice) FILTER (epoch_us(o_orderdate) >= s) AS pa, count(*) FILTER (epoch_us(o_orderdate) >= s) AS pn, sum(o_totalprice) FILTER (epoch_us(o_orderdate) >= s) AS pt FROM orders, c GROUP BY ALL)
SELECT client, {r('a', 'pre_avg', 6)}, n AS pre_count, {r('t', 'pre_total', 6)}, {r('pa', 'post_avg', 6)}, pn AS post_count, {r('pt', 'post_total', 6)}, {r('t / greatest(floor((s - lo) / 86400000000) / 30, 1)', 'pre_monthly', 6)}, {r('pt / greatest(floor((hi - s) / 86400000000) / 30, 1)', 'post_monthly', 6)} FROM g WHERE n > 0 AND pn > 0""")
def an07(spark, d):
    return rounded(io.user_consumption(read(spark, d, "orders"), "o_custkey", "o_orderdate", "o_totalprice").withColumnRenamed("o_custkey", "client"), 6)


@query("an08_user_history", f"""WITH s AS (SELECT c_custkey FROM customer ORDER BY {h('c_custkey', repr('42'))}, c_custkey LIMIT 200)
SELECT c_custkey AS user_id, {r('coalesce(sum(o_totalprice), 0)', 'total_amount', 3)}, count(o_orderkey) AS n_txn, count(DISTINCT o_orderpriority) AS n_merchants, {r('coalesce(max(o_totalprice), 0)', 'max_amount', 3)} FROM s LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def an08(spark, d):
    u = read(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    return rounded(io.user_history(u, read(spark, d, "orders"), 200, client="o_custkey", amount="o_totalprice", merchant="o_orderpriority"), 3)


@query("io03_clean_transactions", "SELECT o_custkey::VARCHAR AS client_id, round(o_totalprice, 2) AS amount, o_orderdate AS date FROM orders WHERE o_orderkey % 7 <> 0")
def io03(spark, d):
    o = read(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("client_id"), F.concat(F.lit("$-"), F.round("o_totalprice", 2).cast("decimal(18,2)").cast("string")).alias("amount"), F.when(F.col("o_orderkey") % 7 == 0, F.lit("no date")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).alias("date"))
    return io.clean_transactions(o)


DAILY = f"d AS (SELECT datediff('day', DATE '2024-01-01', ts::DATE) AS day, avg(CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0 END) FILTER (arm = 1) AS treatment_conversion, avg(CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0 END) FILTER (arm = 0) AS control_conversion FROM (SELECT *, {h(chr(39) + 'user_' + chr(39) + ' || user_id', repr('ab'))} % 2 AS arm FROM events) GROUP BY 1)"


def daily(spark, d):
    e = read(spark, d, "events").withColumn("arm", murmur(F.concat(F.lit("user_"), F.col("user_id")), F.lit("ab")) % 2).withColumn("y", (F.col("event_type") == "purchase").cast("double"))
    return e.groupBy(F.datediff("ts", F.lit("2024-01-01").cast("date")).alias("day")).agg(F.avg(F.when(F.col("arm") == 1, F.col("y"))).alias("treatment_conversion"), F.avg(F.when(F.col("arm") == 0, F.col("y"))).alias("control_conversion"))


@query("ru01_anomalies", f"""WITH {DAILY}, b AS (SELECT *, CASE WHEN count(treatment_conversion) OVER w >= 3 THEN avg(treatment_conversion) OVER w END AS bm, CASE WHEN count(treatment_conversion) OVER w >= 3 THEN stddev_samp(treatment_conversion) OVER w END AS bs FROM d WINDOW w AS (ORDER BY day ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))
SELECT day, {r('treatment_conversion', 'treatment_conversion')},
{r('control_conversion', 'control_conversion')},
{r('bm', 'base_mean')},
{r('bs', 'base_std')},
{r('(treatment_conversion - bm) / nullif(bs, 0)', 'z')}, coalesce(abs((treatment_conversion - bm) / nullif(bs, 0)) > 2, false) AS anomaly FROM b""")
def ru01(spark, d):
    return rounded(monitoring.anomalies(daily(spark, d), "treatment_conversion"))


@query("ru02_rampup", f"""WITH {DAILY}, x AS (SELECT *, treatment_conversion - control_conversion AS l, row_number() OVER (ORDER BY day DESC) AS a, row_number() OVER (ORDER BY day) AS b FROM d),
s AS (SELECT count(*) AS days, avg(l) FILTER (a <= 3) AS rl, avg(l) FILTER (b <= 7) AS bl, avg(treatment_conversion) FILTER (a <= 3) AS t, avg(control_conversion) FILTER (a <= 3) AS c FROM x),
q AS (SELECT *, CASE WHEN days < 3 THEN 'continue' WHEN rl < bl * 0.5 THEN 'pause' WHEN t < c - 0.02 THEN 'rollback' ELSE 'continue' END AS action FROM s)
SELECT days, {r('rl', 'recent_lift')},
{r('bl', 'baseline_lift')}, action, CASE action WHEN 'rollback' THEN 0.0 WHEN 'pause' THEN 20.0 ELSE CASE WHEN days < 3 THEN 20.0 ELSE 40.0 END END::DOUBLE AS next_pct FROM q""")
def ru02(spark, d):
    return rounded(monitoring.rampup_decision(daily(spark, d), 20.0))


@query("ru03_stages", "SELECT * FROM (VALUES " + ", ".join(f"('{a}', {b}::BIGINT, {c}::BIGINT)" for a, b, c in monitoring.STAGES) + ") v(stage, traffic_pct, days)")
def ru03(spark, d):
    return rounded(monitoring.ramp_stages(spark))


SCENARIOS = [
    ("tiny", 50, "high", "short", "stable", "high", "yes"), ("small", 500, "high", "short", "stable", "high", "yes"), ("medium", 5_000, "medium", "medium", "stable", "medium", "yes"), ("large", 50_000, "low", "long", "shifting", "low", "yes"),
    ("huge", 500_000, "low", "permanent", "shifting", "low", "yes"), ("critical", 5_000, "high", "medium", "stable", "high", "no"), ("reversible", 50_000, "low", "long", "shifting", "low", "yes"), ("irreversible", 5_000, "medium", "medium", "stable", "medium", "no"),
]
DIMENSIONS = list(monitoring.SCORES)


def score_sql(side: int) -> str:
    n = "CASE " + " ".join(f"WHEN n_users_per_arm >= {t[0]} THEN {t[1 + side]}" for t in reversed(monitoring.TRAFFIC)) + " END"
    return " + ".join([n, *(f"CASE {d} " + " ".join(f"WHEN '{k}' THEN {v[side]}" for k, v in monitoring.SCORES[d].items()) + " END" for d in DIMENSIONS)])


@query("dc07_choose_method", f"""WITH s AS (SELECT *, ({score_sql(0)})::BIGINT AS ab_score, ({score_sql(1)})::BIGINT AS mab_score FROM (VALUES {', '.join(map(str, SCENARIOS))}) v(scenario, n_users_per_arm, {', '.join(DIMENSIONS)}))
SELECT *, {r('ab_score * 100.0 / (ab_score + mab_score)', 'ab_pct')}, {r('mab_score * 100.0 / (ab_score + mab_score)', 'mab_pct')}, CASE WHEN ab_score >= mab_score + 15 THEN 'strong_ab' WHEN mab_score >= ab_score + 15 THEN 'strong_mab' ELSE 'either' END AS recommendation FROM s""")
def dc07(spark, d):
    return rounded(monitoring.choose_method(spark.createDataFrame(SCENARIOS, "scenario string, n_users_per_arm int, " + ", ".join(f"{x} string" for x in DIMENSIONS))))


RULED = [("a", 500, "low", 100, "stable", False, True), ("b", 5000, "high", 100, "stable", False, True), ("c", 5000, "low", 10, "stable", False, True), ("d", 5000, "low", 60, "stable", False, False), ("e", 5000, "low", 60, "stable", True, True), ("f", 200_000, "low", 120, "shifting", False, True), ("g", 5000, "low", 120, "stable", False, True), ("h", 5000, "low", 60, "stable", False, True)]


@query("dc09_rules", f"""SELECT *, CASE WHEN n_users < 1000 THEN 'ab_low_traffic' WHEN importance = 'high' THEN 'ab_important' WHEN duration_days < 30 THEN 'ab_short' WHEN NOT rollback THEN 'ab_no_rollback' WHEN interpretable THEN 'ab_interpretable' WHEN n_users > 100000 AND duration_days > 90 AND audience = 'shifting' THEN 'mab_adaptive' WHEN duration_days > 90 THEN 'mab_long' ELSE 'either' END AS recommendation FROM (VALUES {', '.join(map(str, RULED))}) v(scenario, n_users, importance, duration_days, audience, interpretable, rollback)""")
def dc09(spark, d):
    return rounded(monitoring.choose_by_rules(spark.createDataFrame(RULED, "scenario string, n_users int, importance string, duration_days int, audience string, interpretable boolean, rollback boolean")))


RATES = [("click", 0.85, 0.84), ("apply", 0.42, 0.35), ("approve", 0.68, 0.62), ("bind", 0.55, 0.55), ("repay", 0.78, 0.85)]


@query("fn01_unpooled_funnel", f"""WITH v AS (SELECT step, a::DOUBLE AS rate_t, b::DOUBLE AS rate_c FROM (VALUES {', '.join(map(str, RATES))}) x(step, a, b)),
z AS (SELECT *, (rate_t - rate_c) / sqrt(rate_t * (1 - rate_t) / 1000 + rate_c * (1 - rate_c) / 1000) AS z FROM v)
SELECT step, rate_t, rate_c, 1000::BIGINT AS n_t, 1000::BIGINT AS n_c, {r('(rate_t - rate_c) / rate_c * 100', 'lift_pct')}, {r('z', 'z')}, {r(sqlfn.p_norm('z'), 'p_value')}, {sqlfn.p_norm('z')} < 0.05 AS significant FROM z""")
def fn01(spark, d):
    return rounded(effects.unpooled_rates(spark.createDataFrame(RATES, "step string, rate_t double, rate_c double").withColumns({"n_t": F.lit(1000), "n_c": F.lit(1000)})))


@query("bm05_daily_srm", f"""WITH c AS (SELECT strftime(ts, '%Y-%m-%d') AS day, {h(chr(39) + 'user_' + chr(39) + ' || user_id', repr('exp_001'))} % 1000 % 2 AS g FROM events),
n AS (SELECT day, count(*) FILTER (g = 0) AS a, count(*) FILTER (g = 1) AS b FROM c GROUP BY 1),
x AS (SELECT day, a + b AS total, greatest(a, b) AS max_n, least(a, b) AS min_n, 2.0 / (a + b) * (a * a + b * b) - (a + b) AS x FROM n),
q AS (SELECT *, {sqlfn.p_chi2('x', 1)} AS p FROM x) {SRM_OUT.replace('9.0::DOUBLE', '1.0::DOUBLE').replace('SELECT total', 'SELECT day, total')}""")
def bm05(spark, d):
    e = arrivals(spark, d).select(F.date_format("ts", "yyyy-MM-dd").alias("day"), routing.pure_hash("user_id", groups=2).alias("group_id"))
    return rounded(balance.srm(e.groupBy("day", "group_id").agg(F.count("*").alias("n")), keys=["day"]))


@query("rt27_stream_counts", f"SELECT g AS group_id, count(*) AS n FROM (SELECT {h(chr(39) + 'user_' + chr(39) + ' || user_id', repr('exp_001'))} % 1000 % 10 AS g FROM events) GROUP BY 1")
def rt27(spark, d):
    """The events replayed as a stream through the stateless router."""
    from ..streaming import routers

    src = read(spark, d, "events")
    stream = spark.readStream.schema(src.schema).option("pathGlobFilter", "events.parquet").parquet(d)
    stream = stream.select(F.concat(F.lit("user_"), F.col("user_id")).alias("user_id"))
    return rounded(routers.run_to_table(routers.stream_hash_counts(stream, "user_id"), "complete"))


@query("bm06_traffic_balance", f"""WITH {HASHED}, t AS (SELECT sum(n)::BIGINT AS total, avg(n) AS m, max(n) AS max_n, min(n) AS min_n, stddev_pop(n) AS sd, 10 / sum(n)::DOUBLE * sum(n * n) - sum(n) AS x FROM s),
q AS (SELECT *, {sqlfn.p_chi2('x', 9)} AS p FROM t)
SELECT total, {r('m', 'mean_n')}, max_n, min_n, {r('greatest(max_n - m, m - min_n) / m * 100', 'max_dev_pct')}, {r('sd', 'std_n')}, {r('x', 'chi2')}, {r('p', 'p_value')}, p > 0.05 AS passed FROM q""")
def bm06(spark, d):
    return rounded(balance.traffic_balance(routing.group_sizes(users(spark, d).withColumn("group_id", routing.pure_hash("user_id")), 10)))


@query("ag14_top_combinations", f"WITH {LAYER_SQL} SELECT rec, sch, ui, count(*) AS n FROM l GROUP BY ALL ORDER BY n DESC, rec, sch, ui LIMIT 5")
def ag14(spark, d):
    n = routing.route_layers(users(spark, d), LAYERS).groupBy(*LAYERS).agg(F.count("*").alias("n"))
    return rounded(n.orderBy(F.desc("n"), *LAYERS).limit(5))


@query("ag03_order_profile", f"SELECT o_custkey, {r('sum(o_totalprice)', 'total', 4)}, count(*) AS n, count(DISTINCT o_orderpriority) AS priorities, {r('max(o_totalprice)', 'largest', 4)} FROM orders GROUP BY 1")
def ag03(spark, d):
    o = read(spark, d, "orders")
    return rounded(o.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total"), F.count("*").alias("n"), F.countDistinct("o_orderpriority").alias("priorities"), F.max("o_totalprice").alias("largest")), 4)


POINTS = {"p05": 0.05, "p50": 0.5, "p95": 0.95, "p99": 0.99}


@query("ag08_percentiles", f"WITH {METRICS} SELECT arm, " + ", ".join(r(f"quantile_cont(post, {q})", n, 4) for n, q in POINTS.items()) + " FROM m GROUP BY 1")
def ag08(spark, d):
    return rounded(effects.bounds(metrics(spark, d), "arm", "post", POINTS), 4)


@query("ag12_covariances", f"WITH {METRICS} SELECT arm, count(*) AS n, " + ", ".join(r(f"{f}({a})", f"{p}_{a}", 2) for a in ("pre", "post") for f, p in (("var_samp", "var"), ("var_pop", "vpop"))) + f", {r('covar_samp(pre, post)', 'cov_pre_post', 2)} FROM m GROUP BY 1")
def ag12(spark, d):
    from ..operators.moments import moments

    out = moments(metrics(spark, d), ["arm"], ["pre", "post"], [("pre", "post")])
    return rounded(out.select("arm", "n", "var_pre", "vpop_pre", "var_post", "vpop_post", "cov_pre_post"), 2)


@query("jn02_left_join_history", f"""SELECT c_custkey, coalesce(n, 0) AS n_orders, {r('coalesce(t, 0)', 'total', 4)} FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS t FROM orders GROUP BY 1) ON c_custkey = o_custkey""")
def jn02(spark, d):
    own = read(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n_orders"), F.sum("o_totalprice").alias("total"))
    c = read(spark, d, "customer").select("c_custkey")
    return rounded(c.join(own, c["c_custkey"] == own["o_custkey"], "left").drop("o_custkey").fillna(0, ["n_orders", "total"]), 4)


@query("jn03_semi_join_group", f"SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE {h(USER, repr('exp_001'))} % 1000 % 10 = 3)")
def jn03(spark, d):
    """The orders of the customers of one group."""
    own = users(spark, d, "c_custkey").filter(routing.pure_hash("user_id") == 3)
    return rounded(read(spark, d, "orders").select("o_orderkey", "o_custkey").join(own, F.col("o_custkey") == F.col("c_custkey"), "left_semi"))


@query("st07_sequential_trajectory", f"""WITH e AS (SELECT strftime(ts, '%Y-%m-%d') AS day, {h(chr(39) + 'user_' + chr(39) + ' || user_id', repr('ab'))} % 2 AS arm, value AS y FROM events WHERE value IS NOT NULL),
g AS (SELECT day, {', '.join(f"count(*) FILTER (arm = {k})::DOUBLE AS n{s}, coalesce(sum(y) FILTER (arm = {k}), 0) AS s{s}, coalesce(sum(y * y) FILTER (arm = {k}), 0) AS q{s}" for k, s in ((1, 't'), (0, 'c')))} FROM e GROUP BY 1),
w AS (SELECT day, {', '.join(f"sum({c}) OVER (ORDER BY day) AS {c}" for c in ('nt', 'st', 'qt', 'nc', 'sc', 'qc'))} FROM g),
v AS (SELECT *, st / nt AS mt, sc / nc AS mc, (qt - st * st / nt) / (nt - 1) AS vt, (qc - sc * sc / nc) / (nc - 1) AS vc FROM w),
t AS (SELECT *, (mt - mc) / sqrt(vt / nt + vc / nc) AS t, pow(vt / nt + vc / nc, 2) / (pow(vt / nt, 2) / (nt - 1) + pow(vc / nc, 2) / (nc - 1)) AS nu, 0.05 * sqrt(ln(1 + least(nt, nc)) / least(nt, nc)) AS b FROM v)
SELECT day, nt::BIGINT AS n_t, nc::BIGINT AS n_c, {r('mt - mc', 'effect', 4)}, {r('t', 't_stat', 4)}, {r(sqlfn.p_t('t', 'nu'), 'p_value', 4)}, {r('b', 'boundary', 4)}, {sqlfn.p_t('t', 'nu')} < b AS stop FROM t""")
def st07(spark, d):
    e = read(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), (murmur(F.concat(F.lit("user_"), F.col("user_id")), F.lit("ab")) % 2).cast("int").alias("arm"), F.col("value").alias("y"))
    return rounded(effects.sequential_trajectory(e, "arm", "y", "day"), 4)


# --- Monte-Carlo ---------------------------------------------------------------------------


TRIALS = f"""x AS (SELECT t, 'u_' || lpad(({mm("'20260728_' || t || '_' || i")} % 1000000000)::VARCHAR, 9, '0') AS user_id FROM (SELECT unnest(range(100)) AS t), (SELECT unnest(range(5000)) AS i))"""


@query("mc01_snake_trials", f"""WITH {TRIALS}, u AS (SELECT t, {mm("user_id || '_exp_' || t")} % 1000 AS b FROM x),
n AS (SELECT k.t, k.b, count(u.b) AS n FROM (SELECT t, b FROM (SELECT unnest(range(100)) AS t), (SELECT unnest(range(1000)) AS b)) k LEFT JOIN u USING (t, b) GROUP BY 1, 2),
o AS (SELECT t, n, row_number() OVER (PARTITION BY t ORDER BY n DESC, b) - 1 AS p FROM n),
g AS (SELECT t, CASE WHEN (p // 10) % 2 = 0 THEN p % 10 ELSE 9 - p % 10 END AS g, sum(n) AS n FROM o GROUP BY 1, 2)
SELECT t AS trial, {r('greatest(max(n) - 500, 500 - min(n)) / 500 * 100', 'max_dev_pct')} FROM g GROUP BY 1""")
def mc01(spark, d):
    """The published size: 100 trials of 5,000 users, 1,000 buckets."""
    return rounded(simulate.trial_deviation(simulate.trial_users(spark, 100, 5000), "snake"))


@query("mc18_bandits")
def mc18(spark, d):
    return rounded(simulate.compare_bandits(spark, [0.10, 0.14, 0.14, 0.14, 0.14]))


AA_LAMBDA = "((sqrt(n) + 0.12 + 0.11 / sqrt(n)) * dd)"


@query("st10_aa", f"""WITH {METRICS}, x AS (SELECT t, ({mm("'aa_' || t || '_' || user_id")} / 4294967296.0 < 0.5)::INT AS arm, post AS y FROM m, (SELECT unnest(range(1000)) AS t)),
a AS (SELECT t, count(*) FILTER (arm = 1) AS n_t, count(*) FILTER (arm = 0) AS n_c, {', '.join(f"{f}(y) FILTER (arm = {k}) AS {c}{s}" for f, c in (('avg', 'm'), ('var_samp', 'v'), ('var_pop', 'w')) for k, s in ((1, 't'), (0, 'c')))} FROM x GROUP BY 1),
b AS (SELECT *, mt - mc AS effect, 2 * 1.96 * sqrt(wt / n_t + wc / n_c) AS width, (mt - mc) / sqrt(vt / n_t + vc / n_c) AS st, pow(vt / n_t + vc / n_c, 2) / (pow(vt / n_t, 2) / (n_t - 1) + pow(vc / n_c, 2) / (n_c - 1)) AS nu FROM a),
p AS (SELECT effect, width, {sqlfn.p_t('st', 'nu', closed=True)} AS p FROM b),
k AS (SELECT *, row_number() OVER (ORDER BY p) AS i, count(*) OVER ()::DOUBLE AS n FROM p),
s AS (SELECT count(*) AS trials, avg((p < 0.05)::INT) AS type1, avg(effect) AS em, stddev_pop(effect) AS es, quantile_cont(effect, 0.025) AS lo, quantile_cont(effect, 0.975) AS hi, avg(width) AS wd, any_value(n) AS n, max(greatest(i / n - p, p - (i - 1) / n)) AS dd FROM k)
SELECT trials, {r('type1', 'type1')}, {r('em', 'effect_mean', 4)}, {r('es', 'effect_std', 4)}, {r('lo', 'effect_low', 4)}, {r('hi', 'effect_high', 4)}, {r('wd', 'ci_width', 4)},
{r(f"greatest(0, least(1, CASE WHEN {AA_LAMBDA} < 0.2 THEN 1.0 ELSE 2 * list_sum(list_transform(range(1, 101), lambda k: (CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2 * k * k * {AA_LAMBDA} * {AA_LAMBDA}))) END))", 'ks_p', 4)}, abs(type1 - 0.05) < 0.015 AS passed FROM s""")
def st10(spark, d):
    out = simulate.aa_report(simulate.aa_trials(metrics(spark, d), "post", 1000))
    return rounded(out.withColumn("type1", F.round("type1", 6)), 4)


@query("io07_synthetic_users")
def io07(spark, d):
    return rounded(io.synthetic_users(spark, 1000))


@query("io08_synthetic_transactions")
def io08(spark, d):
    return rounded(io.synthetic_transactions(spark, 100))


@query("io12_synthetic_experiment")
def io12(spark, d):
    return rounded(effects.pre_post(io.synthetic_experiment(spark, 2000), "assigned", "converted_pre", "converted_post"))


@query("io13_ramp_series")
def io13(spark, d):
    return rounded(io.ramp_series(spark))


from . import experiments, studies  # noqa: E402, F401 - add their queries to these
