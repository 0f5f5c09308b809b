"""Queries over many experiments or many columns at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.murmur import murmur
from ..operators import distributions, gram, posterior, reports
from ..operators.balance import ACTIONS
from . import sqlfn
from .registry import METRICS, h, metrics, query, r, read, rounded

EVENT_ARM = f"{h(chr(39) + 'user_' + chr(39) + ' || user_id', repr('ab'))} % 2"


def event_arms(spark, d):
    e = read(spark, d, "events")
    return e.withColumn("arm", (murmur(F.concat(F.lit("user_"), F.col("user_id")), F.lit("ab")) % 2).cast("int"))


# --- posteriors ------------------------------------------------------------------------------


def lbeta(a: str, b: str) -> str:
    return f"(lgamma({a}) + lgamma({b}) - lgamma(({a}) + ({b})))"


def better(at: str, bt: str, ac: str, bc: str) -> str:
    """P(t > c) as the closed sum over the whole number `at`."""
    return f"list_sum(list_transform(range(0, ({at})::BIGINT), lambda i: exp({lbeta(f'{ac} + i', f'{bc} + {bt}')} - ln({bt} + i) - {lbeta('1.0 + i', bt)} - {lbeta(ac, bc)})))"


@query("st24_by_segment", f"""WITH u AS (SELECT strftime(ts, '%Y-%m-%d') AS day, user_id, {EVENT_ARM} AS arm, max((event_type = 'purchase')::INT) AS hit FROM events WHERE user_id IS NOT NULL GROUP BY ALL),
c AS (SELECT day, count(*) FILTER (arm = 1) AS n_t, coalesce(sum(hit) FILTER (arm = 1), 0)::BIGINT AS x_t, count(*) FILTER (arm = 0) AS n_c, coalesce(sum(hit) FILTER (arm = 0), 0)::BIGINT AS x_c FROM u GROUP BY 1),
b AS (SELECT *, x_t + 1.0::DOUBLE AS ta, n_t - x_t + 1.0::DOUBLE AS tb, x_c + 1.0::DOUBLE AS ca, n_c - x_c + 1.0::DOUBLE AS cb FROM c),
m AS (SELECT *, ta / (ta + tb) AS mt, ca / (ca + cb) AS mc FROM b),
p AS (SELECT *, {better('ta', 'tb', 'ca', 'cb')} AS p, mt * {better('(ta + 1)', 'tb', 'ca', 'cb')} - mc * {better('ta', 'tb', '(ca + 1)', 'cb')} AS lc FROM m)
SELECT day, n_t, x_t, n_c, x_c, {r('mt', 'mean_t')}, {r('mc', 'mean_c')}, {r('mt - mc', 'abs_lift')}, {r('(mt - mc) / mc', 'rel_lift')}, {r('p', 'prob_better')}, {r('greatest(lc, 0)', 'loss_c')}, {r('greatest(lc - (mt - mc), 0)', 'loss_t')},
CASE WHEN p > 0.95 THEN 'strong_win' WHEN p > 0.85 THEN 'likely_win' WHEN p > 0.6 THEN 'lean_win' WHEN p > 0.4 THEN 'no_difference' ELSE 'lean_loss' END AS reading FROM p""")
def st24_by_segment(spark, d):
    """An experiment a day: the users seen on it and those with a purchase."""
    e = event_arms(spark, d).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return rounded(posterior.posteriors(posterior.conversions(e, ["day"], "user_id", "arm", F.col("event_type") == "purchase")))


# --- distances of distributions --------------------------------------------------------------


def ks_sql(key: str = "") -> str:
    """CTEs from s (key, arm, v) on, and the result. The exact tail counts paths row by row; the limit's is a series."""
    over = f"PARTITION BY {key} ORDER BY v" if key else "ORDER BY v"
    keyed = f"{key}, " if key else ""
    exact = f"n_t * n_c <= {distributions.EXACT}"
    inside = "abs(x[1] * n_c - j * n_t) < hh"
    step = f"list_transform(range(0, n_c + 1), lambda j: CASE WHEN {inside} THEN list_sum(list_transform(range(0, j + 1), lambda k: CASE WHEN abs(x[1] * n_c - k * n_t) < hh THEN w[k + 1] ELSE 0.0 END)) ELSE 0.0 END)"
    start = "list_transform(range(0, n_c + 1), lambda j: CASE WHEN j * n_t < hh THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"
    paths = f"list_reduce(list_concat([{start}], list_transform(range(1, n_t + 1), lambda i: [i::DOUBLE])), lambda w, x: {step})"
    choose = "exp(lgamma(n_t + n_c + 1.0) - lgamma(n_t + 1.0) - lgamma(n_c + 1.0))"
    lam = "((sqrt(n_t * n_c / (n_t + n_c)::DOUBLE) + 0.12 + 0.11 / sqrt(n_t * n_c / (n_t + n_c)::DOUBLE)) * hh / (n_t * n_c))"
    limit = f"CASE WHEN {lam} < 0.2 THEN 1.0 ELSE 2 * list_sum(list_transform(range(1, 101), lambda k: (CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2 * k * k * {lam} * {lam}))) END"
    return f"""c AS (SELECT {keyed}v, count(*) FILTER (arm = 1) AS t, count(*) FILTER (arm = 0) AS c FROM s WHERE v IS NOT NULL GROUP BY ALL),
f AS (SELECT {keyed}v, sum(t) OVER ({over}) AS ft, sum(c) OVER ({over}) AS fc, sum(t) OVER ({f'PARTITION BY {key}' if key else ''}) AS nt, sum(c) OVER ({f'PARTITION BY {key}' if key else ''}) AS nc FROM c),
g AS (SELECT {keyed}nt::BIGINT AS n_t, nc::BIGINT AS n_c, max(abs(ft * nc - fc * nt))::DOUBLE AS hh, arg_max(v, (abs(ft * nc - fc * nt), -v)) AS at_value FROM f GROUP BY ALL),
e AS (SELECT *, 1 - p[n_c + 1] / {choose} AS p_value FROM (SELECT *, {paths} AS p FROM g WHERE {exact})),
q AS (SELECT * EXCLUDE (p) FROM e UNION ALL SELECT *, {limit} AS p_value FROM g WHERE NOT ({exact}))
SELECT {keyed}n_t, n_c, {r('hh / (n_t::DOUBLE * n_c)', 'd')}, {r('at_value', 'at_value', 4)}, {r('greatest(least(p_value, 1), 0)', 'p_value')} FROM q"""


@query("sc20_ks", f"WITH {METRICS}, s AS (SELECT arm, post AS v FROM m), {ks_sql()}")
def sc20_ks(spark, d):
    """The two arms' spend."""
    out = distributions.ks_two_sample(metrics(spark, d), "arm", "post")
    return rounded(out.withColumn("at_value", F.round("at_value", 4)))


@query("sc20_ks_by_type", f"WITH s AS (SELECT event_type, {EVENT_ARM} AS arm, value AS v FROM events), {ks_sql('event_type')}")
def sc20_ks_by_type(spark, d):
    """The two arms' values of each event type."""
    out = distributions.ks_two_sample(event_arms(spark, d), "arm", "value", ["event_type"])
    return rounded(out.withColumn("at_value", F.round("at_value", 4)))


# --- many columns ----------------------------------------------------------------------------

#: Columns of lineitem and of what follows from them, in units that keep products small; the last depends on others.
LINE = {
    "order_key": "l_orderkey / 1e5", "part_key": "l_partkey / 1e4", "supplier_key": "l_suppkey / 1e3", "line": "l_linenumber * 1.0", "quantity": "l_quantity * 1.0", "price": "l_extendedprice / 1e4", "discount": "l_discount * 10", "tax": "l_tax * 10",
    "net": "l_extendedprice * (1 - l_discount) / 1e4", "charge": "l_extendedprice * (1 - l_discount) * (1 + l_tax) / 1e4", "unit": "l_extendedprice / l_quantity / 1e3", "root": "sqrt(l_quantity)", "sum": "l_quantity + l_linenumber",
}


def lines(spark, d):
    return read(spark, d, "lineitem").select("l_returnflag", *[F.expr(x.replace("1.0", "1.0D")).cast("double").alias(c) for c, x in LINE.items()])


@query("ag12_matrix", "WITH x AS (SELECT l_returnflag, " + ", ".join(f"({x})::DOUBLE AS {c}" for c, x in LINE.items()) + " FROM lineitem) " + " UNION ALL ".join(f"SELECT l_returnflag, '{a}' AS a, '{b}' AS b, count(*) AS n, {r(f'covar_samp({a}, {b})', 'cov', 5)}, {r(f'corr({a}, {b})', 'corr', 5)} FROM x GROUP BY 1" for i, a in enumerate(LINE) for b in list(LINE)[i:]))
def ag12_matrix(spark, d):
    """Covariances and correlations of thirteen columns, by return flag."""
    return rounded(gram.covariances(gram.gram(lines(spark, d), list(LINE), ["l_returnflag"]), list(LINE), ["l_returnflag"]), 5)


@query("sc22_rank")
def sc22_rank(spark, d):
    """Which of these columns are independent, by return flag."""
    return rounded(gram.independent(gram.gram(lines(spark, d), list(LINE), ["l_returnflag"]), list(LINE), ["l_returnflag"]))


PRIORITIES = {"p1": "1-URGENT", "p2": "2-HIGH", "p3": "3-MEDIUM", "p4": "4-NOT SPECIFIED", "p5": "5-LOW"}
COVARIATES = ["pre", "pre_orders", "pre_max", "pre_min", "pre_open", *PRIORITIES]


def wide_metrics(spark, d):
    """metrics() with ten covariates of the time before; the counts by priority add up to pre_orders."""
    before = read(spark, d, "orders").filter(F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp"))
    n = lambda c: F.count(F.when(c, 1)).cast("double")
    own = before.groupBy("o_custkey").agg(F.max("o_totalprice").alias("pre_max"), F.min("o_totalprice").alias("pre_min"), n(F.col("o_orderstatus") == "O").alias("pre_open"), *[n(F.col("o_orderpriority") == p).alias(c) for c, p in PRIORITIES.items()])
    return metrics(spark, d).join(own, F.col("seq") == F.col("o_custkey"))


@query("st16_many_covariates")
def st16_many_covariates(spark, d):
    """CUPED of the later spend with all ten covariates."""
    return rounded(gram.adjusted_effects(wide_metrics(spark, d), "arm", "post", COVARIATES), 4)


# --- reports of many experiments -------------------------------------------------------------

#: Measures of the users of an experiment; the main one is urgent. A user is enrolled in the month of the first order of 1998.
REPORTED = {"urgent": "binary", "post": "continuous", "pre": "feature", "pre_orders": "feature"}
EMPTY = "NULL::DOUBLE"


def report_sql() -> str:
    measures = {"rows": "traffic", **REPORTED}
    unpivot = " UNION ALL ".join(f"SELECT segment, month, arm, '{m}' AS measure, '{k}' AS kind, ({1 if k == 'traffic' else m})::DOUBLE AS y FROM e" for m, k in measures.items())
    level = "CASE WHEN p < 0.001 THEN 'critical' WHEN p < 0.01 THEN 'high' WHEN p < 0.05 THEN 'medium' ELSE 'normal' END"
    actions = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ACTIONS.items())
    return f"""WITH {METRICS}, e AS (SELECT m.*, c_mktsegment AS segment, month FROM m JOIN customer ON c_custkey = seq JOIN (SELECT o_custkey, strftime(min(o_orderdate), '%Y-%m') AS month FROM orders WHERE o_orderdate >= '1998-01-01' GROUP BY 1) ON o_custkey = seq), u AS ({unpivot}),
a AS (SELECT segment, measure, kind, count(y) FILTER (arm = 1) AS nt, count(y) FILTER (arm = 0) AS nc, avg(y) FILTER (arm = 1) AS mt, avg(y) FILTER (arm = 0) AS mc, var_samp(y) FILTER (arm = 1) AS vt, var_samp(y) FILTER (arm = 0) AS vc, avg(y) AS pp FROM u GROUP BY 1, 2, 3),
s AS (SELECT *, CASE kind WHEN 'traffic' THEN pow(nt - nc, 2) / (nt + nc) WHEN 'feature' THEN nt * nc / (nt + nc)::DOUBLE * pow(mt - mc, 2) / (((nt - 1) * vt + (nc - 1) * vc) / (nt + nc - 2)) WHEN 'binary' THEN (mt - mc) / sqrt(pp * (1 - pp) * (1.0 / nt + 1.0 / nc)) ELSE (mt - mc) / sqrt(vt / nt + vc / nc) END AS st,
CASE kind WHEN 'feature' THEN nt + nc - 2.0 ELSE pow(vt / nt + vc / nc, 2) / nullif(pow(vt / nt, 2) / (nt - 1) + pow(vc / nc, 2) / (nc - 1), 0) END AS nu FROM a),
p AS (SELECT *, CASE kind WHEN 'traffic' THEN {sqlfn.p_chi2('st', 1)} WHEN 'feature' THEN {sqlfn.p_t('sqrt(st)', 'nu', True)} WHEN 'binary' THEN {sqlfn.p_norm('st')} ELSE {sqlfn.p_t('st', 'nu', True)} END AS p FROM s),
v AS (SELECT *, CASE kind WHEN 'traffic' THEN {level} WHEN 'feature' THEN CASE WHEN p > 0.05 THEN 'ok' ELSE 'off' END ELSE CASE WHEN p < 0.05 THEN 'significant' ELSE 'not significant' END END AS verdict FROM p),
c AS (SELECT segment, month, {', '.join(f"sum(count(*) FILTER (arm = {k})) OVER w AS n{s}, sum(coalesce(sum(y) FILTER (arm = {k}), 0)) OVER w AS s{s}" for k, s in ((1, 't'), (0, 'c')))} FROM u WHERE measure = 'urgent' AND y IS NOT NULL GROUP BY 1, 2 WINDOW w AS (PARTITION BY segment ORDER BY month)),
k AS (SELECT *, st / nt - sc / nc AS eff, row_number() OVER (PARTITION BY segment ORDER BY month) AS i, count(*) OVER (PARTITION BY segment) AS n FROM c WHERE nt > 0 AND nc > 0),
z AS (SELECT segment, any_value(n) AS n, avg(eff) FILTER (i <= n // 3) AS early, avg(eff) FILTER (i > n - n // 3) AS late, stddev_pop(eff) AS sd, arg_max(eff, i) AS last FROM k GROUP BY 1),
y AS (SELECT *, (late - early) / abs(early) * 100 AS trend, greatest(0, least(1, 1 - sd / abs(last))) AS score FROM z),
j AS (SELECT m.*, y.*, t.verdict AS level, 2.801585218 * sqrt(2 * m.mc * (1 - m.mc) / least(m.nt, m.nc)) AS mde FROM v m JOIN y USING (segment) JOIN v t ON t.segment = m.segment AND t.measure = 'rows' WHERE m.measure = 'urgent'),
o AS (SELECT segment, CASE WHEN measure = 'urgent' THEN 'main' WHEN kind IN ('binary', 'continuous') THEN 'secondary' ELSE kind END AS role, measure, nt AS n_t, nc AS n_c, CASE WHEN kind <> 'traffic' THEN mt - mc END AS effect, CASE WHEN kind <> 'traffic' THEN (mt - mc) / nullif(mc, 0) * 100 END AS lift_pct, st AS statistic, p AS p_value, verdict FROM v
UNION ALL SELECT segment, 'stability', measure, nt, nc, late, {EMPTY}, trend, score, CASE WHEN trend > 20 THEN 'up' WHEN trend < -20 THEN 'down' ELSE 'stable' END FROM j
UNION ALL SELECT segment, 'power', measure, nt, nc, mde, {EMPTY}, {EMPTY}, {EMPTY}, CASE WHEN abs(mt - mc) > mde THEN 'enough' ELSE 'not enough' END FROM j
UNION ALL SELECT segment, 'advice', measure, nt, nc, {EMPTY}, {EMPTY}, {EMPTY}, {EMPTY}, CASE WHEN level <> 'normal' THEN 'sample ratio: ' || CASE level {actions} END WHEN verdict = 'significant' AND mt < mc THEN 'stop: harmful' WHEN verdict = 'significant' AND score > 0.6 THEN 'ship' WHEN verdict = 'significant' THEN 'keep running: unstable' WHEN abs(mt - mc) > mde / 2 THEN 'extend' ELSE 'stop: far below what can be detected' END FROM j)
SELECT segment, role, measure, n_t, n_c, {', '.join(r(c, c, 4) for c in ('effect', 'lift_pct', 'statistic', 'p_value'))}, verdict FROM o"""


def enrolled(spark, d):
    """metrics() with each user's segment, the experiment, and the month of enrolment."""
    since = read(spark, d, "orders").filter(F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp"))
    first = since.groupBy("o_custkey").agg(F.date_format(F.min("o_orderdate"), "yyyy-MM").alias("month"))
    own = read(spark, d, "customer").select(F.col("c_custkey"), F.col("c_mktsegment").alias("segment"))
    return metrics(spark, d).join(first, F.col("seq") == F.col("o_custkey")).join(own, F.col("seq") == F.col("c_custkey"))


def reported(spark, d):
    metric = {n: (F.col(n), k) for n, k in REPORTED.items() if k != "feature"}
    return reports.report_rows(enrolled(spark, d), "segment", "arm", "month", "urgent", metric, {n: F.col(n) for n, k in REPORTED.items() if k == "feature"})


@query("rp02_report_rows", report_sql())
def rp02_report_rows(spark, d):
    """An experiment a market segment: all its checks and tests."""
    return rounded(reported(spark, d), 4)


@query("rp02_report_texts")
def rp02_report_texts(spark, d):
    """The same rows as a Markdown text an experiment."""
    return reports.render(reported(spark, d), "segment")
