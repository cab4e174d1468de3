"""Experiment statistics queries."""

from statistics import NormalDist

from pyspark.sql import functions as F

from curbside.functions.frames import stable_checkpoint
from curbside.operators import correction as C
from curbside.operators import metrics as M
from curbside.operators import power as W
from curbside.operators import resample as B
from curbside.operators import tests as T
from curbside.plans import experiments as E
from curbside.plans import presets as S

from .base import (
    LAT, LAT_SQL, LON, LON_SQL, OFFERS_SQL, bh_sql, bucket_sql, draw_sql, norm_p_sql, offers, poisson_sql, query, r, ratio_sql, rounded, t_p_sql, table, tables,
)
from .geo import _DIST, _timed_sql, json_schedule

A, Me = M.Agg, M.Metric
USERS = A("user_id", "nunique")
METRICS = (
    Me("o2r", A("event_id", "nunique", ("trip = 1",)), A("event_id", "nunique"), USERS),
    Me("ar", A("event_id", "nunique", ("accept = 1",)), A("event_id", "nunique"), USERS),
    Me("bill_per_trip", A("value", "sum", ("trip = 1",)), A("event_id", "nunique", ("trip = 1",)), USERS),
    Me("trips_per_user", A("event_id", "nunique", ("trip = 1",)), USERS, USERS),
    Me("fraud_share", A("event_id", "nunique", ("fraud = 1", "k > 50")), A("event_id", "nunique", ("k > 50",)), USERS),
)
SPEC = M.ExperimentSpec(
    "split", "user_id", METRICS,
    {"users": USERS, "offers": A("event_id", "nunique"), "trips": A("event_id", "nunique", ("trip = 1",)), "bill": A("value", "sum", ("trip = 1",))},
)


def three_way(spark, sf):
    return offers(spark, sf).withColumn("split", F.col("user_id") % 3)


O3 = OFFERS_SQL.replace("user_id % 2 AS split", "user_id % 3 AS split")
_U = """SELECT {u} AS unit, split, count(*) FILTER (trip=1)::DOUBLE AS trips, count(*)::DOUBLE AS offers, count(*) FILTER (accept=1)::DOUBLE AS acc, sum(value) FILTER (trip=1) AS bill,
 count(DISTINCT user_id)::DOUBLE AS users, count(*) FILTER (fraud=1 AND k>50)::DOUBLE AS fr, count(*) FILTER (k>50)::DOUBLE AS k50 FROM {frame} GROUP BY 1, 2"""


def bucketed_sql(frame="offers"):
    """CTE `bu`: the frame with each user's hash bucket, under the bucket limit that follows from its rows."""
    return f"""bl AS (SELECT greatest(CASE WHEN count(*) < 1000 THEN least(count(*) // 2, 500) ELSE least(count(*) // 2, 1000) END, 1) AS limit_ FROM {frame}),
bu AS (SELECT f.*, {bucket_sql('user_id', 'limit_')} AS bucket FROM {frame} f, bl)"""


def metric_rows_sql(unit, frame="offers"):
    return f"""u AS ({_U.format(u=unit, frame=frame)}), m AS (SELECT 'o2r' AS metric, split, unit, trips AS x, offers AS y, users AS n FROM u UNION ALL SELECT 'ar', split, unit, acc, offers, users FROM u
 UNION ALL SELECT 'bill_per_trip', split, unit, coalesce(bill, 0), trips, users FROM u UNION ALL SELECT 'trips_per_user', split, unit, trips, users, users FROM u UNION ALL SELECT 'fraud_share', split, unit, fr, k50, users FROM u)"""


@query("experiment_evaluation", f"""WITH {O3}, {bucketed_sql()}, {metric_rows_sql('bucket', 'bu')}, {ratio_sql('m')},
tot AS (SELECT split, count(DISTINCT user_id)::DOUBLE AS users, count(*)::DOUBLE AS offers, count(*) FILTER (trip=1)::DOUBLE AS trips, sum(value) FILTER (trip=1) AS bill FROM offers GROUP BY 1),
tm AS (UNPIVOT tot ON users, offers, trips, bill INTO NAME metric VALUE v),
tl AS (SELECT a.metric, a.split AS split_0, b.split AS split_1, a.v AS v0, b.v AS v1 FROM tm a JOIN tm b USING (metric) WHERE a.split < b.split),
t AS (SELECT metric, split_0, split_1, ratio_0, ratio_1, delta, {t_p_sql('delta / se', 'df')} AS pvalue FROM pr),
z AS (SELECT * FROM {bh_sql('t')})
SELECT split_0 || '_' || split_1 AS split_pair, metric, round(ratio_0, 6) AS split_0, round(ratio_1, 6) AS split_1, round((ratio_1 - ratio_0) / ratio_0, 6) AS lift, round(pvalue, 6) AS pvalue, round(pvalue_adj, 6) AS pvalue_adj,
 (pvalue < 0.05)::INT AS is_significant, (pvalue_adj < 0.05)::INT AS is_significant_adj, round(delta, 6) AS delta FROM z
UNION ALL SELECT split_0 || '_' || split_1, metric, round(v0, 6), round(v1, 6), round((v1 - v0) / v0, 6), NULL, NULL, NULL, NULL, NULL FROM tl""")
def evaluation(spark, sf):
    out = E.evaluate(three_way(spark, sf), SPEC)
    return rounded(out.select("split_pair", "metric", "split_0", "split_1", "lift", "pvalue", "pvalue_adj", "is_significant", "is_significant_adj", "delta"))


@query("hash_bucket_compression", f"""WITH {OFFERS_SQL}, {bucketed_sql()}
SELECT split, bucket::INT AS unit, (count(*) FILTER (trip=1))::DOUBLE AS trips, count(*)::DOUBLE AS offers, count(DISTINCT user_id)::DOUBLE AS users, round(coalesce(sum(value) FILTER (trip=1), 0), 4) AS bill FROM bu GROUP BY 1, 2""")
def bucketed(spark, sf):
    """Every bucket of users with its figures."""
    rows = M.bucket_rows(offers(spark, sf), SPEC)
    figure = lambda metric, c: F.sum(F.when(F.col("metric") == metric, F.col(c)))
    return rows.groupBy(F.col("split").cast("bigint").alias("split"), F.col("unit").cast("int").alias("unit")).agg(
        figure("o2r", "x").alias("trips"), figure("o2r", "y").alias("offers"), figure("o2r", "n").alias("users"), r(figure("bill_per_trip", "x"), 4).alias("bill"),
    )


@query("metric_registry_totals", f"""WITH {O3}
SELECT split, count(DISTINCT user_id) AS users, count(*) AS offers, count(*) FILTER (trip=1) AS trips, round(sum(value) FILTER (trip=1), 4) AS bill, round(count(*) FILTER (trip=1) / count(*)::DOUBLE, 4) AS o2r, round(count(*) FILTER (accept=1) / count(*)::DOUBLE, 4) AS ar,
 round(sum(value) FILTER (trip=1) / count(*) FILTER (trip=1), 4) AS bill_per_trip, round(count(*) FILTER (trip=1) / count(DISTINCT user_id)::DOUBLE, 4) AS trips_per_user, round(count(*) FILTER (fraud=1 AND k>50) / count(*) FILTER (k>50)::DOUBLE, 4) AS fraud_share FROM offers GROUP BY 1""")
def registry_totals(spark, sf):
    return rounded(M.totals(three_way(spark, sf), SPEC), 4)


@query("totals_melted_with_lift", f"""WITH {O3}, tot AS (SELECT locality, split, count(*)::DOUBLE AS offers, count(*) FILTER (trip=1 AND value > 100)::DOUBLE AS big FROM offers GROUP BY 1, 2),
tm AS (UNPIVOT tot ON offers, big INTO NAME metric VALUE v)
SELECT a.locality, a.split || '_' || b.split AS split_pair, a.metric, a.v AS split_0, b.v AS split_1, round(CASE WHEN a.v = 0 AND b.v <> 0 THEN 0 ELSE (b.v - a.v) / nullif(a.v, 0) END, 6) AS lift FROM tm a JOIN tm b USING (locality, metric) WHERE a.split < b.split""")
def melted(spark, sf):
    spec = M.ExperimentSpec("split", "user_id", (), {"offers": A("event_id", "nunique"), "big": A("event_id", "nunique", ("trip = 1", "value > 100"))})
    return rounded(M.pairs_with_lift(M.totals(three_way(spark, sf), spec, ["locality"]), ["locality"]))


def user_rows(spark, sf, mod=2, extra=()):
    o = offers(spark, sf).withColumn("split", F.col("user_id") % mod)
    return o.groupBy("split", F.col("user_id").alias("unit"), *extra).agg(
        F.sum(F.col("value") * F.col("trip")).alias("x"), F.sum("trip").cast("double").alias("y"), F.lit(1.0).alias("n")
    )


def user_sql(mod=2):
    return f"{OFFERS_SQL}, m AS (SELECT user_id % {mod} AS split, user_id AS unit, sum(value * trip) AS x, sum(trip)::DOUBLE AS y, 1.0::DOUBLE AS n FROM offers GROUP BY 1, 2)"


_PAIR_COLS = ("split_0", "split_1")


def test_columns(df, *names):
    return rounded(df.select(*_PAIR_COLS, *names))


@query("ratio_t_test_per_user", f"""WITH {user_sql(3)}, {ratio_sql('m', '')}
SELECT split_0, split_1, round(delta, 6) AS delta, round(se, 6) AS se, round(df, 4) AS df, round(delta / se, 6) AS statistic, round({t_p_sql('delta / se', 'df')}, 6) AS pvalue FROM pr""")
def ratio_t(spark, sf):
    out = T.ratio_t_test(T.pair_up(T.ratio_stats(user_rows(spark, sf, 3), [])))
    return out.select("split_0", "split_1", r("delta").alias("delta"), r("se").alias("se"), r("df", 4).alias("df"), r("statistic").alias("statistic"), r("pvalue").alias("pvalue"))


@query("ratio_z_test_per_user", f"""WITH {user_sql(3)}, {ratio_sql('m', '')}
SELECT split_0, split_1, round(delta, 6) AS delta, round(delta / se, 6) AS statistic, round({norm_p_sql('delta / se')}, 6) AS pvalue FROM pr""")
def ratio_z(spark, sf):
    return test_columns(T.ratio_z_test(T.pair_up(T.ratio_stats(user_rows(spark, sf, 3), []))), "delta", "statistic", "pvalue")


@query("ratio_normal_interval", f"""WITH {user_sql(2)}, s AS (SELECT split, count(*) AS b, avg(x) AS ax, avg(y) AS ay, var_samp(x) AS vx, var_samp(y) AS vy, covar_samp(x, y) AS c FROM m GROUP BY 1),
v AS (SELECT *, (vx / pow(ay, 2) + vy * pow(ax, 2) / pow(ay, 4) - 2 * ax * c / pow(ay, 3)) / b AS q FROM s),
p AS (SELECT a.split AS split_0, b.split AS split_1, b.ax / b.ay - a.ax / a.ay AS delta, sqrt(a.q + b.q) AS se FROM v a, v b WHERE a.split < b.split)
SELECT split_0, split_1, round(delta, 6) AS delta, round(delta - 1.96 * se, 6) AS lb, round(delta + 1.96 * se, 6) AS ub, round(delta / se, 6) AS statistic FROM p""")
def normal_interval(spark, sf):
    return test_columns(T.ratio_normal_interval(T.pair_up(T.ratio_stats(user_rows(spark, sf), []))), "delta", "lb", "ub", "statistic")


_MEANS = f"""{OFFERS_SQL}, s AS (SELECT user_id % 3 AS split, count(*)::DOUBLE AS n, avg(value) AS mean, var_samp(value) AS var FROM offers GROUP BY 1),
p AS (SELECT a.split AS split_0, b.split AS split_1, b.mean - a.mean AS delta, a.n AS n0, b.n AS n1, a.var AS v0, b.var AS v1 FROM s a, s b WHERE a.split < b.split)"""


@query("welch_t_test", f"""WITH {_MEANS}, t AS (SELECT *, sqrt(v0/n0 + v1/n1) AS se, pow(v0/n0 + v1/n1, 2) / (pow(v0/n0, 2)/(n0-1) + pow(v1/n1, 2)/(n1-1)) AS df FROM p)
SELECT split_0, split_1, round(delta, 6) AS delta, round(se, 6) AS se, round(delta / se, 6) AS statistic, round({t_p_sql('delta / se', 'df')}, 6) AS pvalue FROM t""")
def welch(spark, sf):
    return test_columns(T.welch_test(T.pair_up(T.value_stats(three_way(spark, sf), "value"))), "delta", "se", "statistic", "pvalue")


@query("student_t_test", f"""WITH {_MEANS}, t AS (SELECT *, n0 + n1 - 2 AS df, sqrt((v0*(n0-1) + v1*(n1-1)) / (n0+n1-2) * (1/n0 + 1/n1)) AS se FROM p)
SELECT split_0, split_1, round(delta, 6) AS delta, round(se, 6) AS se, round(delta / se, 6) AS statistic, round({t_p_sql('delta / se', 'df')}, 6) AS pvalue FROM t""")
def student(spark, sf):
    return test_columns(T.student_test(T.pair_up(T.value_stats(three_way(spark, sf), "value"))), "delta", "se", "statistic", "pvalue")


_PROPS = f"""{OFFERS_SQL}, s AS (SELECT user_id % 3 AS split, count(*)::DOUBLE AS n, sum(accept)::DOUBLE AS k FROM offers GROUP BY 1),
p AS (SELECT a.split AS split_0, b.split AS split_1, a.n AS n0, b.n AS n1, a.k AS k0, b.k AS k1, b.k/b.n - a.k/a.n AS delta FROM s a, s b WHERE a.split < b.split)"""


@query("two_proportion_z_unpooled", f"""WITH {_PROPS}, t AS (SELECT *, sqrt(k0/n0*(1-k0/n0)/n0 + k1/n1*(1-k1/n1)/n1) AS se FROM p)
SELECT split_0, split_1, round(delta, 6) AS delta, round(delta/se, 6) AS statistic, round({norm_p_sql('delta/se')}, 6) AS pvalue, round(delta - 1.959963984540054*se, 6) AS lb, round(delta + 1.959963984540054*se, 6) AS ub FROM t""")
def unpooled(spark, sf):
    return test_columns(T.proportion_test(T.pair_up(T.value_stats(three_way(spark, sf), "accept"))), "delta", "statistic", "pvalue", "lb", "ub")


@query("two_proportion_z_pooled", f"""WITH {_PROPS}, t AS (SELECT *, sqrt((k0+k1)/(n0+n1) * (1 - (k0+k1)/(n0+n1)) * (1/n0 + 1/n1)) AS se FROM p)
SELECT split_0, split_1, round(delta, 6) AS delta, round(delta/se, 6) AS statistic, round({norm_p_sql('delta/se')}, 6) AS pvalue FROM t""")
def pooled(spark, sf):
    return test_columns(T.proportion_test(T.pair_up(T.value_stats(three_way(spark, sf), "accept")), pooled=True), "delta", "statistic", "pvalue")


_CHI = """(pow(greatest(abs(k0 - n0*(k0+k1)/(n0+n1)) - 0.5, 0), 2)/(n0*(k0+k1)/(n0+n1)) + pow(greatest(abs(k1 - n1*(k0+k1)/(n0+n1)) - 0.5, 0), 2)/(n1*(k0+k1)/(n0+n1))
 + pow(greatest(abs(n0-k0 - n0*(n0+n1-k0-k1)/(n0+n1)) - 0.5, 0), 2)/(n0*(n0+n1-k0-k1)/(n0+n1)) + pow(greatest(abs(n1-k1 - n1*(n0+n1-k0-k1)/(n0+n1)) - 0.5, 0), 2)/(n1*(n0+n1-k0-k1)/(n0+n1)))"""


@query("chi_square_two_by_two", f"""WITH {_PROPS}, t AS (SELECT *, {_CHI} AS x FROM p)
SELECT split_0, split_1, round(x, 6) AS statistic, round({norm_p_sql('sqrt(x)')}, 6) AS pvalue FROM t""")
def chi2(spark, sf):
    return test_columns(T.chi2_test(T.pair_up(T.value_stats(three_way(spark, sf), "accept"))), "statistic", "pvalue")


_MWU = """p AS (SELECT a.s AS split_0, b.s AS split_1 FROM (SELECT DISTINCT split AS s FROM v) a, (SELECT DISTINCT split AS s FROM v) b WHERE a.s < b.s),
rk AS (SELECT split_0, split_1, split, val, rank() OVER w + (count(*) OVER (PARTITION BY split_0, split_1, val) - 1) / 2.0 AS rnk, count(*) OVER (PARTITION BY split_0, split_1, val) AS t FROM v JOIN p ON split IN (split_0, split_1) WINDOW w AS (PARTITION BY split_0, split_1 ORDER BY val)),
g AS (SELECT split_0, split_1, count(*) FILTER (split = split_0)::DOUBLE AS n0, count(*) FILTER (split = split_1)::DOUBLE AS n1, sum(rnk) FILTER (split = split_0) AS r0, sum((pow(t, 3) - t) / t) AS ties FROM rk GROUP BY 1, 2),
uu AS (SELECT *, r0 - n0*(n0+1)/2 AS u0, sqrt(n0*n1/12*((n0+n1+1) - ties/((n0+n1)*(n0+n1-1)))) AS sigma FROM g),
zz AS (SELECT *, (greatest(u0, n0*n1-u0) - n0*n1/2 - 0.5)/sigma AS z FROM uu)"""


@query("mann_whitney_rank_test", f"""WITH {OFFERS_SQL}, v AS (SELECT user_id % 3 AS split, round(value / 5) * 5 AS val FROM offers), {_MWU}
SELECT split_0, split_1, u0 AS u_0, round(sigma, 4) AS sigma, round(z, 6) AS statistic, round(least(1, {norm_p_sql('greatest(z, 0)')}), 6) AS pvalue FROM zz""")
def rank_test(spark, sf):
    rows = three_way(spark, sf).withColumn("val", F.round(F.col("value") / 5) * 5)
    out = T.mann_whitney(rows, "val")
    return out.select("split_0", "split_1", "u_0", r("sigma", 4).alias("sigma"), r("statistic").alias("statistic"), r("pvalue").alias("pvalue"))


@query("benjamini_hochberg_by_locality", f"""WITH {OFFERS_SQL}, s AS (SELECT locality, event_type, user_id % 50 >= 25 AS split, count(*)::DOUBLE AS n, avg(value) AS m, var_samp(value) AS v FROM offers GROUP BY 1, 2, 3),
t AS (SELECT locality, event_type, (b.m - a.m) / sqrt(a.v/a.n + b.v/b.n) AS z FROM s a JOIN s b USING (locality, event_type) WHERE NOT a.split AND b.split),
q AS (SELECT locality, event_type, {norm_p_sql('z')} AS pvalue FROM t)
SELECT locality, event_type, round(pvalue, 6) AS pvalue, round(pvalue_adj, 6) AS pvalue_adj FROM {bh_sql('q', keys='locality')}""")
def bh(spark, sf):
    from curbside.functions import pvalues as P

    rows = offers(spark, sf).withColumn("split", (F.col("user_id") % 50 >= 25))
    pairs = T.pair_up(T.value_stats(rows, "value", ["locality", "event_type"]), ["locality", "event_type"])
    z = (F.col("mean_1") - F.col("mean_0")) / F.sqrt(F.col("var_0") / F.col("n_0") + F.col("var_1") / F.col("n_1"))
    tests = pairs.withColumn("z", z).withColumn("pvalue", P.normal_two_sided(F.col("z")))
    return rounded(C.benjamini_hochberg(tests, ["locality"]).select("locality", "event_type", "pvalue", "pvalue_adj"))


# --- resampling -----------------------------------------------------------

REPS = 1000


def boot_sql(mod, reps, seed, value="x", over="y"):
    w = poisson_sql("u")
    return f"""{user_sql(mod)}, d AS (SELECT m.*, rep, {draw_sql(seed, 'unit', 'rep')} AS u FROM m, (SELECT unnest(range(1, {reps + 1})) AS rep)),
w AS (SELECT split, rep, sum({value} * {w}) / nullif(sum({over} * {w}), 0) AS v FROM d GROUP BY 1, 2),
dl AS (SELECT a.split AS split_0, b.split AS split_1, rep, b.v - a.v AS d FROM w a JOIN w b USING (rep) WHERE a.split < b.split),
sm AS (SELECT split_0, split_1, count(d) AS reps, avg(d) AS delta, stddev_pop(d) AS sd, quantile_cont(d, 0.005) AS lb, quantile_cont(d, 0.995) AS ub, count(*) FILTER (d < 0) AS negative FROM dl GROUP BY 1, 2)"""


@query("bootstrap_difference_of_means", f"""WITH {boot_sql(2, REPS, 1, 'x', 'n')}
SELECT split_0, split_1, reps, round(delta, 6) AS delta, round(lb, 6) AS lb, round(ub, 6) AS ub, round(CASE WHEN lb < 0 AND ub > 0 THEN 1 ELSE {norm_p_sql('delta / sd')} END, 6) AS pvalue FROM sm""")
def boot_mean(spark, sf):
    return test_columns(B.bootstrap_mean(user_rows(spark, sf), "x", reps=REPS), "reps", "delta", "lb", "ub", "pvalue")


@query("bootstrap_cluster_ratio", f"""WITH {boot_sql(3, REPS, 2)}
SELECT split_0, split_1, reps, round(delta, 6) AS delta, round(lb, 6) AS lb, round(ub, 6) AS ub, round({norm_p_sql('delta / sd')}, 6) AS pvalue FROM sm""")
def boot_ratio(spark, sf):
    return test_columns(B.bootstrap_ratio(user_rows(spark, sf, 3), "x", "y", "unit", reps=REPS, seed=2), "reps", "delta", "lb", "ub", "pvalue")


@query("bootstrap_ratio_bias_corrected", f"""WITH {boot_sql(2, REPS, 3)}, o AS (SELECT a.split AS split_0, b.split AS split_1, b.v - a.v AS obs FROM (SELECT split, sum(x)/sum(y) AS v FROM m GROUP BY 1) a, (SELECT split, sum(x)/sum(y) AS v FROM m GROUP BY 1) b WHERE a.split < b.split)
SELECT split_0, split_1, round(obs, 6) AS delta, round(lb + obs - delta, 6) AS lb, round(ub + obs - delta, 6) AS ub, round({norm_p_sql('obs / sd')}, 6) AS pvalue FROM sm JOIN o USING (split_0, split_1)""")
def boot_bias(spark, sf):
    return test_columns(B.bootstrap_ratio(user_rows(spark, sf), "x", "y", "unit", reps=REPS, seed=3, bias_correction=True), "delta", "lb", "ub", "pvalue")


@query("poisson_bootstrap_sign_rule", f"""WITH {boot_sql(2, REPS, 4)}
SELECT split_0, split_1, negative, round(2.0 * least(negative, reps - negative) / reps, 6) AS pvalue FROM sm""")
def boot_sign(spark, sf):
    return test_columns(B.poisson_bootstrap(user_rows(spark, sf), "x", "y", "unit", reps=REPS, seed=4), "negative", "pvalue")


@query("bootstrap_difference_of_medians", f"""WITH {user_sql(2)}, u AS MATERIALIZED (SELECT split, rep, x, {draw_sql(5, 'unit', 'rep')} AS u FROM m, (SELECT unnest(range(1, {REPS + 1})) AS rep)), d AS (SELECT split, rep, x, {poisson_sql('u')} AS w FROM u),
e AS (SELECT split, rep, x FROM d, (SELECT unnest(range(1, 11)) AS k) WHERE k <= w), q AS (SELECT split, rep, median(x) AS v FROM e GROUP BY 1, 2),
dl AS (SELECT b.v - a.v AS d FROM q a JOIN q b USING (rep) WHERE a.split = 0 AND b.split = 1)
SELECT 0::BIGINT AS split_0, 1::BIGINT AS split_1, round(avg(d), 6) AS delta, round(quantile_cont(d, 0.005), 6) AS lb, round(quantile_cont(d, 0.995), 6) AS ub FROM dl""")
def boot_median(spark, sf):
    return test_columns(B.bootstrap_median(user_rows(spark, sf), "x", reps=REPS, seed=5), "delta", "lb", "ub")


@query("exact_subsample_without_replacement", f"""WITH {OFFERS_SQL}, d AS (SELECT event_id, split, row_number() OVER (PARTITION BY split ORDER BY {draw_sql(7, 'event_id', '0')}, event_id) AS rn, count(*) OVER (PARTITION BY split) AS n FROM offers)
SELECT event_id, split FROM d WHERE rn <= least(1000, floor(n * 0.5))""")
def subsample(spark, sf):
    return B.exact_sample(offers(spark, sf).select("event_id", "split"), ["split"], "event_id", 0.5, 1000, 7)


_SIMS = 10_000


def sim_sql(share, cap, seed, keys="split", frame="m"):
    """CTE k: the sampled rows of `frame` (keys, unit, ...) in column sim, drawn by rank as `operators.sampling` does for rows numbered by unit."""
    drawn = draw_sql(seed, *keys.split(", "), "sim", "j")
    return f"""nb AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY unit) - 1 AS rank FROM {frame}),
sz AS (SELECT {keys}, count(*) AS c, least({cap}, floor(count(*) * {share}))::BIGINT AS k FROM {frame} GROUP BY ALL),
dr AS MATERIALIZED (SELECT {keys}, sim, j, k, least(floor({drawn} * c)::BIGINT, c - 1) AS rank FROM sz, (SELECT unnest(range(1, {_SIMS + 1})) AS sim), (SELECT unnest(range(0, 2 * {cap} + 64)) AS j) WHERE j < 2 * k + 64),
fi AS (SELECT {keys}, sim, rank, min(j) AS j, any_value(k) AS k FROM dr GROUP BY {keys}, sim, rank QUALIFY row_number() OVER (PARTITION BY {keys}, sim ORDER BY min(j)) <= any_value(k)),
k AS (SELECT nb.* EXCLUDE (rank), sim FROM fi JOIN nb USING ({keys}, rank))"""


@query("simulated_false_positive_rate", f"""WITH {user_sql(2)}, {sim_sql(0.5, 1000, 11)}, {ratio_sql('k', 'sim')}
SELECT split_0, split_1, count(*) AS sims, round(avg(({t_p_sql('delta / se', 'df', 400)} <= 0.05)::INT), 6) AS rate, round(avg(delta / se), 6) AS mean_statistic FROM pr GROUP BY 1, 2""")
def fpr(spark, sf):
    return test_columns(B.simulated_rate(user_rows(spark, sf), "t_test_ratio", "unit", _SIMS, keys=[], seed=11), "sims", "rate", "mean_statistic")


@query("false_positive_rate_by_group", f"""WITH {OFFERS_SQL}, m AS (SELECT user_id % 3 AS grp, user_id % 2 AS split, user_id AS unit, sum(value * trip) AS x, sum(trip)::DOUBLE AS y, 1.0::DOUBLE AS n FROM offers GROUP BY 1, 2, 3),
{sim_sql(0.5, 1000, 12, 'grp, split')}, {ratio_sql('k', 'grp, sim')}
SELECT grp, split_0, split_1, count(*) AS sims, round(avg(({norm_p_sql('delta / se', 400)} <= 0.05)::INT), 6) AS rate FROM pr GROUP BY 1, 2, 3""")
def fpr_group(spark, sf):
    rows = user_rows(spark, sf).withColumn("grp", F.col("unit") % 3)
    return rounded(B.simulated_rate(rows, "ttest_ratio", "unit", _SIMS, keys=["grp"], seed=12).select("grp", "split_0", "split_1", "sims", "rate"))


@query("aa_study_binomial", f"""WITH {OFFERS_SQL}, m AS (SELECT split, event_id AS unit, accept FROM offers), {sim_sql(0.1, 500, 13)},
g AS (SELECT sim, split, count(*)::DOUBLE AS n, sum(accept)::DOUBLE AS k FROM k GROUP BY 1, 2), p AS (SELECT a.n AS n0, b.n AS n1, a.k AS k0, b.k AS k1 FROM g a JOIN g b USING (sim) WHERE a.split = 0 AND b.split = 1),
t AS (SELECT {_CHI} AS x FROM p)
SELECT 0::BIGINT AS split_0, 1::BIGINT AS split_1, count(*) AS sims, round(avg((x >= 3.841458820694124)::INT), 6) AS rate, round(avg(x), 6) AS mean_statistic FROM t""")
def aa_binomial(spark, sf):
    rows = offers(spark, sf).select("split", F.col("event_id").alias("unit"), "accept")
    return test_columns(B.simulated_rate(rows, "chi2", "unit", _SIMS, 0.1, 500, [], "accept", seed=13), "sims", "rate", "mean_statistic")


@query("aa_study_daily_rate_pivot", """
SELECT ts::DATE AS day, round(avg((event_type IN ('click','purchase'))::INT) FILTER (user_id % 2 = 0), 6) AS "0", round(avg((event_type IN ('click','purchase'))::INT) FILTER (user_id % 2 = 1), 6) AS "1" FROM events GROUP BY 1""")
def daily_pivot(spark, sf):
    o = offers(spark, sf).withColumn("day", F.to_date("ts"))
    return rounded(o.groupBy("day").pivot("split", [0, 1]).agg(F.avg("accept")))


@query("aa_study_half_samples", f"""WITH {user_sql(2)}, k AS (SELECT x, y, n, sim, CASE WHEN {draw_sql(14, 'unit', 'sim')} < 0.5 THEN 'A' ELSE 'B' END AS split FROM m, (SELECT unnest(range(1, {_SIMS + 1})) AS sim) WHERE y <> 0), {ratio_sql('k', 'sim')}
SELECT count(*) FILTER (se > 0 AND isfinite(df)) AS sims, round(avg(({t_p_sql('delta / se', 'df', 400)} <= 0.05)::INT) FILTER (se > 0 AND isfinite(df)), 6) AS rate, round(avg(delta / se) FILTER (se > 0), 6) AS mean_statistic FROM pr""")
def aa_half(spark, sf):
    out = B.half_split_rate(user_rows(spark, sf), "unit", _SIMS, seed=14, drop_zero_denominator=True, mode="reference")
    return rounded(out)


# --- power ----------------------------------------------------------------

@query("sample_size_for_mean_lift", """
SELECT event_type, lift, round(avg(value) / stddev_samp(value) * lift, 8) AS effect FROM events, (VALUES (0.05::DOUBLE), (0.1::DOUBLE)) l(lift) GROUP BY 1, 2""")
def size_mean(spark, sf):
    out = W.mean_sample_size(table(spark, sf, "events"), "value", [0.05, 0.1], 0.01, 0.9, ["event_type"])
    return out.filter("nobs_needed > 0").select("event_type", "lift", r("effect", 8).alias("effect"))


@query("sample_size_for_ratio_lift", f"""WITH {user_sql(2)}
SELECT lift, round(sum(x) / sum(y) / stddev_samp(x / y) * lift, 8) AS effect FROM m, (VALUES (0.02::DOUBLE), (0.1::DOUBLE)) l(lift) GROUP BY 1""")
def size_ratio(spark, sf):
    out = W.ratio_sample_size(user_rows(spark, sf), "x", "y", [0.02, 0.1], 0.01, 0.9)
    return out.filter("nobs_needed > 0").select("lift", r("effect", 8).alias("effect"))


@query("sample_size_for_binomial_lift", f"""WITH {OFFERS_SQL}, s AS (SELECT count(*)::DOUBLE AS n, sum(trip)::DOUBLE AS k FROM offers), g AS (SELECT lift::DOUBLE AS lift, k / n AS p0, floor(n * (k / n + lift::DOUBLE)) / n AS p1 FROM s, (VALUES (0.02), (0.1)) l(lift))
SELECT lift, round(sqrt(pow(p1 - p0, 2) / p0 + pow(p1 - p0, 2) / (1 - p0)), 8) AS effect, floor(14.8793879855 / (pow(p1 - p0, 2) / p0 + pow(p1 - p0, 2) / (1 - p0)))::BIGINT AS nobs_needed FROM g""")
def size_binomial(spark, sf):
    out = W.binomial_sample_size(offers(spark, sf), "trip", [0.02, 0.1], 0.01, 0.9)
    return out.select("lift", r("effect", 8).alias("effect"), "nobs_needed")


@query("post_test_verdict_ratio", f"""WITH {user_sql(3)}, s AS (SELECT split, count(*)::DOUBLE AS n, sum(x) AS sx, sum(y) AS sy, avg(x) AS ax FROM m GROUP BY 1)
SELECT a.split AS split_0, b.split AS split_1, round(a.sx/a.sy, 6) AS split_a, round(b.sx/b.sy, 6) AS split_b, round((b.sx/b.sy - a.sx/a.sy) / abs(a.sx/a.sy), 6) AS lift, a.n::BIGINT AS split_a_n_obs, b.n::BIGINT AS split_b_n_obs,
 round((b.n - a.n) / a.n, 6) AS n_obs_difference FROM s a, s b WHERE a.split < b.split""")
def verdict_ratio(spark, sf):
    out = W.verdict_rows(user_rows(spark, sf, 3), "ratio", "x", "unit", "y")
    return test_columns(out, "split_a", "split_b", "lift", "split_a_n_obs", "split_b_n_obs", "n_obs_difference")


@query("post_test_verdict_binomial", f"""WITH {O3}, s AS (SELECT split, count(*)::DOUBLE AS n, sum(accept)::DOUBLE AS k, count(DISTINCT user_id)::DOUBLE AS u FROM offers GROUP BY 1),
p AS (SELECT a.split AS split_0, b.split AS split_1, a.k/a.n AS pa, b.k/b.n AS pb, a.n AS n0, b.n AS n1, a.u AS u0, b.u AS u1 FROM s a, s b WHERE a.split < b.split),
e AS (SELECT *, pow(pb - pa, 2) / pa + pow(pb - pa, 2) / (1 - pa) AS w2 FROM p)
SELECT split_0, split_1, round(pa, 6) AS split_a, round(pb, 6) AS split_b, round(pb - pa, 6) AS lift, round((n1 - n0) / n0, 6) AS n_obs_difference, u0::BIGINT AS split_a_drivers, u1::BIGINT AS split_b_drivers, round(sqrt(w2), 8) AS effect,
 CASE WHEN n0 >= floor(14.8793879855 / w2) AND n1 >= floor(14.8793879855 / w2) THEN 1 END AS mde_ok FROM e""")
def verdict_binomial(spark, sf):
    out = W.verdict_rows(three_way(spark, sf), "binomial", "accept", "user_id")
    return out.select("split_0", "split_1", r("split_a").alias("split_a"), r("split_b").alias("split_b"), r("lift").alias("lift"), r("n_obs_difference").alias("n_obs_difference"),
                      "split_a_drivers", "split_b_drivers", r("effect", 8).alias("effect"), "mde_ok")


@query("detectable_effect_per_pair")
def detectable(spark, sf):
    counts = offers(spark, sf).groupBy((F.col("user_id") % 3).alias("split")).agg(F.countDistinct("user_id").alias("n"))
    return rounded(W.detectable_effect(counts, 0.01, 0.8))


def t_quantile_sql(p, df):
    """Student quantile for large df: the first terms of its expansion about the normal quantile."""
    z = NormalDist().inv_cdf(p)
    terms = ((z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384)
    return f"({z!r} + {terms[0]!r} / ({df}) + {terms[1]!r} / pow({df}, 2) + {terms[2]!r} / pow({df}, 3))"


@query("closed_form_mde", f"""WITH {OFFERS_SQL}, s AS (SELECT user_id % 3 AS split, count(*)::DOUBLE AS n, avg(value) AS mean, var_samp(value) AS var FROM offers GROUP BY 1),
p AS (SELECT a.split AS split_0, b.split AS split_1, a.mean AS base, a.n + b.n - 2 AS df, sqrt(a.var / a.n + b.var / b.n) AS se FROM s a, s b WHERE a.split < b.split)
SELECT split_0, split_1, round(se, 6) AS se, round(({t_quantile_sql(0.8, 'df')} - {t_quantile_sql(0.025, 'df')}) * se / base, 6) AS mde FROM p""")
def closed_mde(spark, sf):
    pairs = T.pair_up(T.value_stats(three_way(spark, sf), "value"))
    return rounded(W.closed_form_mde(pairs, 0.05, 0.8).select("split_0", "split_1", "se", "mde"))


# --- presets --------------------------------------------------------------

def goal_counts(spark, sf):
    o = offers(spark, sf)
    return o.groupBy((F.col("user_id") % 5).alias("bonus_id"), (F.floor(F.col("user_id") / 5) % 3).alias("split"), F.col("user_id").alias("driver_id")).agg(
        F.sum(F.col("trip") * (F.col("value") > 60).cast("int")).alias("count"), F.sum(F.col("value") * F.col("trip")).alias("paid_sum"), F.lit("2_5").alias("x")
    )


@query("goal_bonus_evaluation")
def goal_bonus(spark, sf):
    return rounded(E.goal_bonus_evaluation(goal_counts(spark, sf), reps=REPS))


@query("goal_bonus_success_rate", f"""WITH {OFFERS_SQL}, c AS (SELECT user_id % 5 AS bonus_id, (user_id // 5) % 3 AS split, user_id, sum(trip * (value > 60)::INT) AS cnt FROM offers GROUP BY 1, 2, 3),
s AS (SELECT bonus_id, split, count(*)::DOUBLE AS n, count(*) FILTER (cnt >= 5)::DOUBLE AS k FROM c GROUP BY 1, 2), p AS (SELECT bonus_id, a.split AS split_0, b.split AS split_1, a.n AS n0, b.n AS n1, a.k AS k0, b.k AS k1 FROM s a JOIN s b USING (bonus_id) WHERE a.split < b.split)
SELECT bonus_id, split_0, split_1, round({_CHI}, 6) AS statistic FROM p""")
def goal_success(spark, sf):
    from curbside.functions.scalars import flag, max_part

    rows = goal_counts(spark, sf).withColumn("reached", flag(F.col("count") >= max_part("x")))
    return rounded(T.chi2_test(T.pair_up(T.value_stats(rows, "reached", ["bonus_id"]), ["bonus_id"])).select("bonus_id", "split_0", "split_1", "statistic"))


def suggest_columns():
    return [
        "retro", F.floor(F.col("offer_id") / 2).alias("order_id"), F.col("user_id").alias("driver_id"), "offer_id", "ts",
        F.when(F.col("accept") == 1, 1).otherwise(-1).alias("action"), F.when(F.col("trip") == 1, "CP").otherwise("CC").alias("status"),
        F.when(F.col("k") > 10, F.col("user_id")).alias("picked_by"), (F.col("value") * 10).alias("supply_sec"),
    ]


def _stat_and_splits(ev):
    stat = ev.filter("k % 4 = 0").groupBy(F.floor(F.col("event_id") / 2).alias("order_id")).agg(F.min("k").alias("campaign_id"), F.sum("value").alias("damage"))
    return stat, ev.select(F.col("user_id").alias("driver_id")).distinct().withColumn("split", F.col("driver_id") % 2)


def geo_facts(spark, sf):
    from curbside.operators.temporal import retro_union

    ev = offers(spark, sf)
    suggests = retro_union(ev, "ts", "2024-01-15", "2024-01-21").withColumnRenamed("event_id", "offer_id").select(*suggest_columns())
    # the facts feed several passes: written once instead of joined again for each
    return stable_checkpoint(E.geo_facts(suggests, *_stat_and_splits(ev)))


@query("geo_experiment_evaluation", f"""WITH {OFFERS_SQL}, tw AS (SELECT 'tw' AS retro, * FROM offers WHERE ts >= '2024-01-15' AND ts < '2024-01-22' UNION ALL SELECT 'lw', * FROM offers WHERE ts >= '2024-01-08' AND ts < '2024-01-15'),
sg AS (SELECT *, event_id // 2 AS order_id, row_number() OVER (PARTITION BY retro, event_id // 2, user_id ORDER BY ts DESC, event_id DESC) AS rk FROM tw),
st AS (SELECT event_id // 2 AS order_id, min(k) AS campaign_id, sum(value) AS damage FROM offers WHERE k % 4 = 0 GROUP BY 1),
f AS (SELECT s.retro, s.order_id, s.user_id, s.event_id, s.accept = 1 AS is_ar, s.trip = 1 AS is_cp, s.k > 10 AS picked, st.campaign_id IS NOT NULL AS geo, st.damage, s.value * 10 AS supply, s.split FROM sg s LEFT JOIN st USING (order_id) WHERE rk = 1),
gd AS (SELECT DISTINCT user_id FROM f WHERE geo), w AS (SELECT *, is_ar AND is_cp AND picked AS done, user_id IN (SELECT user_id FROM gd) AS geo_driver FROM f WHERE retro = 'tw'),
a AS (SELECT split, count(DISTINCT user_id)::DOUBLE AS drivers, count(DISTINCT order_id)::DOUBLE AS orders, count(DISTINCT event_id)::DOUBLE AS suggests, count(DISTINCT order_id) FILTER (done)::DOUBLE AS trips, count(DISTINCT order_id) FILTER (is_ar)::DOUBLE AS acc,
 count(DISTINCT order_id) FILTER (done AND geo)::DOUBLE AS gtrips, count(DISTINCT user_id) FILTER (geo AND is_ar AND picked)::DOUBLE AS gdp, count(DISTINCT user_id) FILTER (geo AND is_ar)::DOUBLE AS gda, count(DISTINCT order_id) FILTER (geo_driver AND done)::DOUBLE AS gdt,
 sum(supply) FILTER (done) / 3600 AS sh, sum(damage) FILTER (done) AS cost FROM w GROUP BY 1),
x AS (SELECT split, drivers, orders, suggests, trips, cost, trips/orders AS o2r, acc/orders AS ar, trips/suggests AS of2r, gtrips/drivers AS gtpd, gtrips/gdp AS gtpgd, gdt/gda AS tpgd, gda/drivers AS rr, sh/drivers AS sh_per_driver, cost/trips AS cpt FROM a),
l AS (UNPIVOT x ON drivers, orders, suggests, trips, cost, o2r, ar, of2r, gtpd, gtpgd, tpgd, rr, sh_per_driver, cpt INTO NAME metric VALUE v)
SELECT metric, round(a.v, 6) AS split_0, round(b.v, 6) AS split_1, round((b.v - a.v) / a.v, 6) AS lift FROM l a JOIN l b USING (metric) WHERE a.split = 0 AND b.split = 1""")
def geo_evaluation(spark, sf):
    out = E.evaluate(geo_facts(spark, sf), S.GEO_EXPERIMENT, unit=None)
    keep = ["drivers", "orders", "suggests", "trips", "cost", "o2r", "ar", "of2r", "gtpd", "gtpgd", "tpgd", "rr", "sh_per_driver", "cpt"]
    return rounded(out.filter(F.col("metric").isin(keep)).select("metric", "split_0", "split_1", "lift"))


@query("geo_experiment_week_over_week", f"""WITH {OFFERS_SQL}, rt AS (SELECT *, CASE WHEN ts >= '2024-01-15' THEN 'tw' ELSE 'lw' END AS retro, event_id // 2 AS order_id FROM offers WHERE ts >= '2024-01-08' AND ts < '2024-01-22'),
rk AS (SELECT *, row_number() OVER (PARTITION BY retro, order_id, user_id ORDER BY ts DESC, event_id DESC) AS rk FROM rt),
f AS (SELECT *, trip = 1 AND accept = 1 AND k > 10 AS done FROM rk WHERE rk = 1),
li AS (SELECT greatest(CASE WHEN count(*) < 1000 THEN least(count(*) // 2, 500) ELSE least(count(*) // 2, 1000) END, 1) AS limit_ FROM f),
b AS (SELECT f.*, {bucket_sql('user_id', 'limit_')} AS unit FROM f, li),
m AS (SELECT 'o2r' AS metric, split::VARCHAR AS split, unit, (count(DISTINCT order_id) FILTER (done))::DOUBLE AS x, count(DISTINCT order_id)::DOUBLE AS y, count(DISTINCT user_id)::DOUBLE AS n FROM b WHERE retro = 'tw' GROUP BY split, unit
 UNION ALL SELECT 'o2r_wow', retro, unit, count(DISTINCT order_id) FILTER (done), count(DISTINCT order_id), count(DISTINCT user_id) FROM b GROUP BY retro, unit), {ratio_sql('m')}
SELECT metric, split_0 || '_' || split_1 AS split_pair, round({t_p_sql('delta / se', 'df')}, 6) AS pvalue, round(delta, 6) AS delta FROM pr""")
def geo_wow(spark, sf):
    out = E.evaluate(geo_facts(spark, sf), S.GEO_EXPERIMENT)
    return rounded(out.filter("metric in ('o2r', 'o2r_wow')").select("metric", "split_pair", "pvalue", "delta"))


def _geo_unit_sql(metrics):
    """CTE m of bucketed metric rows from w (this week's facts with `limit_`): metric -> (x, y, n condition)."""
    parts = [
        f"SELECT '{name}' AS metric, split, unit, ({x})::DOUBLE AS x, ({y})::DOUBLE AS y, (count(DISTINCT user_id) FILTER ({n}))::DOUBLE AS n FROM b GROUP BY split, unit HAVING count(DISTINCT user_id) FILTER ({n}) > 0"
        for name, (x, y, n) in metrics.items()
    ]
    return f"b AS (SELECT *, {bucket_sql('user_id', 'limit_')} AS unit FROM w), m AS ({' UNION ALL '.join(parts)})"


_ORDERS = "count(DISTINCT order_id) FILTER ({})"
_AREA_METRICS = {
    "o2r": (_ORDERS.format("done AND inside"), _ORDERS.format("inside"), "inside"), "ar": (_ORDERS.format("is_ar AND inside"), _ORDERS.format("inside"), "inside"),
    "of2r": (_ORDERS.format("done AND inside"), "count(DISTINCT event_id) FILTER (inside)", "inside"),
    "cpt": ("coalesce(sum(damage) FILTER (done AND inside), 0)", _ORDERS.format("done AND inside"), "inside"),
    "o2r_cnbl": (_ORDERS.format("done AND NOT inside"), _ORDERS.format("NOT inside"), "true"),
    "of2r_cnbl": (_ORDERS.format("done AND NOT inside"), "count(DISTINCT event_id) FILTER (NOT inside)", "true"),
}


@query("geo_experiment_from_schedule", f"""WITH {OFFERS_SQL}, pts AS (SELECT o.*, ({LAT_SQL}) AS lat, ({LON_SQL}) AS lon FROM offers o WHERE ts >= '2024-01-08' AND ts < '2024-01-22'), {_timed_sql()}, {_DIST},
ar AS (SELECT event_id, bool_or(inside) AS inside FROM timed JOIN d USING (event_id, plan_id) WHERE inside OR dist <= 800 GROUP BY 1),
sg AS (SELECT p.*, ar.inside, CASE WHEN ts >= '2024-01-15' THEN 'tw' ELSE 'lw' END AS retro, event_id // 2 AS order_id FROM pts p JOIN ar USING (event_id)),
rk AS (SELECT *, row_number() OVER (PARTITION BY retro, order_id, user_id ORDER BY ts DESC, event_id DESC) AS rk FROM sg),
sd AS (SELECT event_id // 2 AS order_id, min(k) AS campaign_id, sum(value) AS damage FROM offers WHERE k % 4 = 0 GROUP BY 1),
f AS (SELECT rk.*, accept = 1 AS is_ar, trip = 1 AND accept = 1 AND k > 10 AS done, sd.damage FROM rk LEFT JOIN sd USING (order_id) WHERE rk = 1),
li AS (SELECT greatest(CASE WHEN count(*) < 1000 THEN least(count(*) // 2, 500) ELSE least(count(*) // 2, 1000) END, 1) AS limit_ FROM f),
w AS (SELECT f.*, limit_ FROM f, li WHERE retro = 'tw'), {_geo_unit_sql(_AREA_METRICS)}, {ratio_sql('m')}
SELECT metric, split_0 || '_' || split_1 AS split_pair, round(delta, 6) AS delta, round({t_p_sql('delta / se', 'df')}, 6) AS pvalue FROM pr""")
def geo_from_schedule(spark, sf):
    """Schedule JSON to half hours and tiles, suggests inside polygons or their 800 m buffer, facts, bucketed tests."""
    from curbside.operators.polygons import parse_schedule
    from curbside.operators.temporal import retro_union

    ev = offers(spark, sf).withColumns({"lat": F.expr(LAT).cast("double"), "lon": F.expr(LON).cast("double")})
    suggests = retro_union(ev, "ts", "2024-01-15", "2024-01-21").withColumnsRenamed({"event_id": "offer_id", "locality": "id_locality"})
    near = E.area_suggests(suggests, parse_schedule(json_schedule(spark)), 800.0, tile=0.02)
    rows = near.select(*suggest_columns(), "in_polygon", "in_buffer")
    facts = stable_checkpoint(E.geo_facts(rows, *_stat_and_splits(ev)))
    out = E.evaluate(facts, S.GEO_AREA_EXPERIMENT)
    return rounded(out.filter(F.col("metric").isin(list(_AREA_METRICS))).select("metric", "split_pair", "delta", "pvalue"))


def ladder_facts(spark, sf):
    li, o = tables(spark, sf, "lineitem", "orders")
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.col("o_custkey").alias("driver_id"), (F.col("o_custkey") % 3).alias("split"), F.col("l_linenumber").alias("orders_count"), F.col("l_extendedprice").alias("driver_bill"),
        (F.col("l_extendedprice") * F.col("l_discount")).alias("fee"), (F.col("l_extendedprice") * F.col("l_tax")).alias("expected_sum"),
    )


@query("ladder_experiment_evaluation", f"""WITH u AS (SELECT o_custkey % 3 AS split, o_custkey % 100 AS unit, sum(l_linenumber)::DOUBLE AS oc, sum(l_extendedprice) AS bill, sum(l_extendedprice * l_discount) AS fee, count(DISTINCT o_custkey)::DOUBLE AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
m AS (SELECT 'tpd' AS metric, split, oc AS x, n AS y, n FROM u UNION ALL SELECT 'average_bill', split, bill, oc, n FROM u UNION ALL SELECT 'cpt', split, fee, oc, n FROM u), {ratio_sql('m')}
SELECT metric, split_0 || '_' || split_1 AS split_pair, round(ratio_0, 6) AS split_0, round(ratio_1, 6) AS split_1, round((ratio_1 - ratio_0) / ratio_0, 6) AS lift, round({t_p_sql('delta / se', 'df')}, 6) AS pvalue FROM pr""")
def ladder_evaluation(spark, sf):
    out = E.evaluate(ladder_facts(spark, sf), S.LADDER_EXPERIMENT, unit=F.col("driver_id") % 100)
    return rounded(out.filter("pvalue is not null").select("metric", "split_pair", "split_0", "split_1", "lift", "pvalue"))


@query("ladder_experiment_power")
def ladder_power(spark, sf):
    out = E.evaluate(ladder_facts(spark, sf), S.LADDER_EXPERIMENT, power_sims=100)
    return rounded(out.filter("pvalue is not null").select("metric", "split_pair", "pvalue", "power", "mde"))


@query("discount_experiment_evaluation", f"""WITH {OFFERS_SQL}, f AS (SELECT user_id, split, k % 4 AS zone, count(*) AS views, sum(accept) AS orders, sum(trip) AS rides, sum(value * trip) AS bill, sum(trip * value * 0.1) AS sale FROM offers GROUP BY 1, 2, 3),
u AS (SELECT split, user_id % 30 AS unit, sum(views)::DOUBLE AS v, sum(orders)::DOUBLE AS o, sum(rides)::DOUBLE AS rd, sum(sale) AS sale, count(DISTINCT user_id)::DOUBLE AS n FROM f GROUP BY 1, 2),
m AS (SELECT 'o2r' AS metric, split, rd AS x, o AS y, n FROM u UNION ALL SELECT 'v2r', split, rd, v, n FROM u UNION ALL SELECT 'v2o', split, o, v, n FROM u UNION ALL SELECT 'cpt', split, sale, rd, n FROM u UNION ALL SELECT 'tpc', split, rd, n, n FROM u), {ratio_sql('m')},
t AS (SELECT *, {norm_p_sql('delta / se')} AS pvalue FROM pr)
SELECT metric, round(ratio_0, 6) AS split_0, round(ratio_1, 6) AS split_1, round(delta, 6) AS delta, round(pvalue, 6) AS pvalue, round(pvalue_adj, 6) AS pvalue_adj FROM {bh_sql('t')}""")
def discount_evaluation(spark, sf):
    facts = offers(spark, sf).groupBy(F.col("user_id").alias("id_client"), "split", (F.col("k") % 4).alias("zone")).agg(
        F.count("*").alias("views"), F.sum("accept").alias("orders"), F.sum("trip").alias("rides"), F.sum(F.col("value") * F.col("trip")).alias("client_bill"),
        F.sum(F.col("trip") * F.col("value") * 0.1).alias("sale_part_ride"),
    )
    out = E.evaluate(facts, S.DISCOUNT_EXPERIMENT, unit=F.col("id_client") % 30)
    return rounded(out.filter("pvalue is not null").select("metric", "split_0", "split_1", "delta", "pvalue", "pvalue_adj"))


def driver_frames(spark, sf):
    o = offers(spark, sf).withColumns(
        {
            "reject": (F.col("event_type") == "view").cast("int"), "unit": F.col("event_id"), "exp_dist_km": (F.col("event_id") % 13).cast("double") + F.col("value") / 100,
            "chain": F.when(F.col("k") % 2 == 0, "ChainOffer"), "distance": F.when(F.col("k") < 30, "0-3").when(F.col("k") < 60, "3-6").otherwise(">6"), "city": (F.col("user_id") % 2).cast("int"),
            "split": F.floor(F.col("user_id") / 2) % 2,
        }
    )
    users = o.groupBy("city", "split", "user_id").agg(
        F.sum(F.col("value") * F.col("trip")).alias("money_gross"), F.countDistinct(F.date_trunc("hour", "ts")).cast("double").alias("supply_hours"), F.sum("trip").alias("trips"),
        F.sum("trip").alias("rides"), F.count("*").alias("offers"), F.sum(F.col("value") * F.col("trip") * 0.2).alias("contribution"),
        F.when(F.max("ts") < "2024-01-28", 1).otherwise(0).alias("churn_7day"),
    ).withColumn("segment", F.when(F.col("user_id") % 5 == 0, "TOP").when(F.col("user_id") % 5 == 1, "HIGH"))
    return {"offers": o, "users": users}


CHAIN_METRICS = {k: S.DRIVER_METRICS[k] for k in ("AR", "RR", "FR", "exp_dist_mean")}
CHAIN_USER_METRICS = {k: S.DRIVER_METRICS[k] for k in ("churn_7day", "MPH_gross", "SHpD", "TPD", "OF2R", "COPT")}


@query("breakdown_evaluation_by_city")
def chain_offers(spark, sf):
    frames = driver_frames(spark, sf)
    metrics = {**CHAIN_METRICS, **CHAIN_USER_METRICS}
    sources = {**{k: "offers" for k in CHAIN_METRICS}, **{k: "users" for k in CHAIN_USER_METRICS}}
    out = E.breakdown_evaluation(frames, metrics, sources, "user_id", keys=["city"], reps=REPS)
    return rounded(out.select("city", "metric", "split_0", "split_1", "split_a", "split_b", "lift", "pvalue", "pvalue_adj", "nobs_needed", "mde_ok"))


@query("breakdown_binomial_tests", f"""WITH {OFFERS_SQL}, o AS (SELECT user_id % 2 AS city, (user_id // 2) % 2 AS split, accept, CASE WHEN k % 2 = 0 THEN 'ChainOffer' END AS chain, CASE WHEN k < 30 THEN '0-3' WHEN k < 60 THEN '3-6' ELSE '>6' END AS distance FROM offers),
b AS (SELECT city, split, accept, 'AR' AS metric FROM o UNION ALL SELECT city, split, accept, 'AR_' || chain FROM o WHERE chain IS NOT NULL UNION ALL SELECT city, split, accept, 'AR_' || distance FROM o),
s AS (SELECT city, metric, split, count(*)::DOUBLE AS n, sum(accept)::DOUBLE AS k FROM b GROUP BY 1, 2, 3), p AS (SELECT city, metric, a.n AS n0, b.n AS n1, a.k AS k0, b.k AS k1 FROM s a JOIN s b USING (city, metric) WHERE a.split = 0 AND b.split = 1),
t AS (SELECT city, metric, k0/n0 AS split_a, k1/n1 AS split_b, {norm_p_sql('sqrt(x)')} AS pvalue FROM (SELECT *, {_CHI} AS x FROM p))
SELECT city::INT AS city, metric, round(split_a, 6) AS split_a, round(split_b, 6) AS split_b, round(pvalue, 6) AS pvalue, round(pvalue_adj, 6) AS pvalue_adj FROM {bh_sql('t', keys='city')}""")
def breakdown_binomial(spark, sf):
    frames = driver_frames(spark, sf)
    out = E.breakdown_evaluation(frames, {"AR": S.DRIVER_METRICS["AR"]}, {"AR": "offers"}, "user_id", keys=["city"])
    return rounded(out.select("city", "metric", "split_a", "split_b", "pvalue", "pvalue_adj"))


@query("coloured_results", f"""WITH {OFFERS_SQL}, o0 AS (SELECT user_id % 2 AS city, (user_id // 2) % 2 AS split, accept, k, user_id, CASE WHEN k % 2 = 0 THEN 'ChainOffer' END AS chain, CASE WHEN k < 30 THEN '0-3' WHEN k < 60 THEN '3-6' ELSE '>6' END AS distance FROM offers),
o AS (SELECT * EXCLUDE (accept), CASE WHEN city = 0 AND split = 1 AND k % 3 = 0 THEN 1 ELSE accept END AS accept FROM o0),
b AS (SELECT city, split, accept, 'AR' AS metric FROM o UNION ALL SELECT city, split, accept, 'AR_' || chain FROM o WHERE chain IS NOT NULL UNION ALL SELECT city, split, accept, 'AR_' || distance FROM o),
s AS (SELECT city, metric, split, count(*)::DOUBLE AS n, sum(accept)::DOUBLE AS k FROM b GROUP BY 1, 2, 3), p AS (SELECT city, metric, a.n AS n0, b.n AS n1, a.k AS k0, b.k AS k1 FROM s a JOIN s b USING (city, metric) WHERE a.split = 0 AND b.split = 1),
t AS (SELECT city, metric, n0, n1, k0/n0 AS pa, k1/n1 AS pb, {norm_p_sql('sqrt(x)')} AS pvalue FROM (SELECT *, {_CHI} AS x FROM p)),
j AS (SELECT *, pow(pb - pa, 2) / pa + pow(pb - pa, 2) / (1 - pa) AS w2 FROM {bh_sql('t', keys='city')})
SELECT city::INT AS city, metric, round(pb - pa, 6) AS lift, round(pvalue_adj, 6) AS pvalue_adj FROM j WHERE pvalue_adj <= 0.01 AND n0 >= floor(14.8793879855 / w2) AND n1 >= floor(14.8793879855 / w2)""")
def coloured(spark, sf):
    """Metrics that pass the adjusted level of 0.01 with enough observations. City 0 has an effect put into its test arm, city 1 has none."""
    frames = driver_frames(spark, sf)
    moved = (F.col("city") == 0) & (F.col("split") == 1) & (F.col("k") % 3 == 0)
    frames["offers"] = frames["offers"].withColumn("accept", F.when(moved, 1).otherwise(F.col("accept")))
    out = E.breakdown_evaluation(frames, {"AR": S.DRIVER_METRICS["AR"]}, {"AR": "offers"}, "user_id", keys=["city"])
    return rounded(C.coloured(out).select("city", "metric", "lift", "pvalue_adj"))


@query("city_economics_from_experiment", f"""WITH {OFFERS_SQL}, u AS (SELECT split, user_id, sum(trip) AS t, sum(value*trip) AS g, (max(ts) < '2024-01-29')::INT AS ch FROM offers GROUP BY 1, 2),
s AS (SELECT split, avg(ch) AS churn, sum(t) / count(*)::DOUBLE AS tpd, sum(g) * 0.05 / sum(t) AS copt, sum(g) * 0.2 / sum(t) AS compt FROM u GROUP BY 1), e AS (SELECT split, 1000 * (1 - churn) * tpd AS trips, copt, compt FROM s),
w AS (SELECT split, trips, trips * copt AS contribution, trips * compt AS commission FROM e), l AS (UNPIVOT w ON trips, contribution, commission INTO NAME measure VALUE v)
SELECT measure, a.split AS split_0, b.split AS split_1, round(a.v, 4) AS value_0, round(b.v, 4) AS value_1, round(b.v - a.v, 4) AS difference, round((b.v - a.v) / a.v, 4) AS lift FROM l a JOIN l b USING (measure) WHERE a.split < b.split""")
def economics(spark, sf):
    u = offers(spark, sf).groupBy("split", "user_id").agg(
        F.sum("trip").alias("t"), F.sum(F.col("value") * F.col("trip")).alias("g"), (F.max("ts") < "2024-01-29").cast("int").alias("ch")
    )
    s = u.groupBy("split").agg(
        F.avg("ch").alias("churn"), (F.sum("t") / F.count("*")).alias("tpd"), (F.sum("g") * 0.05 / F.sum("t")).alias("copt"), (F.sum("g") * 0.2 / F.sum("t")).alias("compt")
    )
    return rounded(E.city_economics(s, 1000), 4)
