"""Window, sort and top-k queries."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from curbside.operators import ladders as L
from curbside.operators import relational as R
from curbside.operators import temporal as T

from .base import OFFERS_SQL, offers, query, r, rounded, table, tables


@query("row_number_per_user", """
SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events""")
def numbered(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "user_id", "ts")
    return T.sequence_number(ev, ["user_id"], "ts", ["event_id"]).select("event_id", "rn")


@query("latest_row_per_key", """
SELECT user_id, locality, event_id, event_type FROM (SELECT user_id, user_id % 25 AS locality, event_type, event_id,
 row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def latest_row(spark, sf):
    ev = table(spark, sf, "events").select("user_id", (F.col("user_id") % 25).alias("locality"), "event_type", "event_id", "ts")
    return T.latest_per_key(ev, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query("first_row_flag_per_suggest", """
SELECT l_orderkey, count(*) FILTER (rn = 1) AS first_rows, round(sum(l_extendedprice) FILTER (rn = 1), 2) AS first_price FROM
(SELECT l_orderkey, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn FROM lineitem) GROUP BY 1""")
def first_rows(spark, sf):
    li = table(spark, sf, "lineitem")
    first = F.min(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")).alias("f")
    return li.groupBy("l_orderkey").agg(first).select(
        "l_orderkey", F.lit(1).cast("bigint").alias("first_rows"), r("f.l_extendedprice", 2).alias("first_price")
    )


@query("top_third_rank_per_locality", """
WITH g AS (SELECT user_id % 25 AS locality, user_id, count(*) AS orders FROM events GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY locality ORDER BY orders DESC, user_id) AS rk, count(*) OVER (PARTITION BY locality) AS n FROM g)
SELECT locality, user_id, rk, (rk <= round_even(n / 3.0, 0))::INT AS is_top FROM k""")
def top_third(spark, sf):
    g = table(spark, sf, "events").groupBy((F.col("user_id") % 25).alias("locality"), "user_id").agg(F.count("*").alias("orders"))
    from curbside.plans.alerts import top_third_flag

    return top_third_flag(g, ["locality"], "orders", ["user_id"]).select("locality", "user_id", F.col("trip_rank").alias("rk"), "is_top")


@query("group_median_and_max_transform", """
SELECT event_id, round(value / median(value) OVER (PARTITION BY event_type), 6) AS to_median, round(value / max(value) OVER (PARTITION BY event_type), 6) AS to_max FROM events""")
def transforms(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "event_type", "value")
    ev = R.with_group_quantiles(ev, ["event_type"], {"med": ("value", 0.5), "top": ("value", 1.0)})
    return ev.select("event_id", r(F.col("value") / F.col("med")).alias("to_median"), r(F.col("value") / F.col("top")).alias("to_max"))


@query("previous_and_next_state", """
SELECT event_id, lag(event_type) OVER w AS prev_event_type, lead(event_type) OVER w AS next_event_type FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def prev_next(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    out = T.neighbours(ev, ["user_id"], "ts", ["event_type"], ["event_id"])
    return out.select("event_id", "prev_event_type", "next_event_type")


@query("lagged_regressors", """
WITH d AS (SELECT event_type, ts::DATE AS ds, round(avg(value), 6) AS v, count(*) AS n FROM events GROUP BY 1, 2)
SELECT event_type, ds, lag(v, 7) OVER w AS v_sh_7, lag(n, 14) OVER w AS n_sh_14 FROM d WINDOW w AS (PARTITION BY event_type ORDER BY ds)""")
def lags(spark, sf):
    d = table(spark, sf, "events").groupBy("event_type", F.to_date("ts").alias("ds")).agg(r(F.avg("value")).alias("v"), F.count("*").alias("n"))
    return T.lagged(d, ["event_type"], "ds", {"v": 7, "n": 14}).select("event_type", "ds", "v_sh_7", "n_sh_14")


@query("week_number_in_period", """
WITH w AS (SELECT DISTINCT CASE WHEN o_orderdate < '1998-01-01' THEN 0 ELSE 1 END AS period, date_trunc('week', o_orderdate)::DATE AS week FROM orders)
SELECT period, week, row_number() OVER (PARTITION BY period ORDER BY week) AS week_no FROM w""")
def week_no(spark, sf):
    w = table(spark, sf, "orders").select(
        F.when(F.col("o_orderdate") < "1998-01-01", 0).otherwise(1).alias("period"),
        F.to_date(F.date_trunc("week", "o_orderdate")).alias("week"),
    ).distinct()
    return w.withColumn("week_no", F.row_number().over(Window.partitionBy("period").orderBy("week")))


_LADDER_SQL = """lad AS (SELECT l_suppkey AS ladder_id, l_linenumber * 5 AS step, round(max(l_extendedprice) / 100) AS payout FROM lineitem WHERE l_linenumber <> 4 GROUP BY 1, 2),
full_l AS (SELECT ladder_id, g.step, coalesce((SELECT payout FROM lad b WHERE b.ladder_id = i.ladder_id AND b.step <= g.step ORDER BY b.step DESC LIMIT 1), 0) AS payout
FROM (SELECT DISTINCT ladder_id FROM lad) i, (SELECT unnest(range(0, 41))::INT AS step) g)"""


def supplier_ladders(spark, sf):
    li = table(spark, sf, "lineitem").filter("l_linenumber <> 4")
    return li.groupBy(F.col("l_suppkey").alias("ladder_id"), (F.col("l_linenumber") * 5).alias("step")).agg(
        F.round(F.max("l_extendedprice") / 100).alias("payout")
    )


@query("ladder_forward_fill", f"""WITH {_LADDER_SQL} SELECT ladder_id, step, payout FROM full_l""")
def forward_fill(spark, sf):
    return L.filled_ladder(supplier_ladders(spark, sf), ["ladder_id"], 40)


@query("ladder_step_deltas", f"""WITH {_LADDER_SQL}
SELECT ladder_id, step, abs(payout - lag(payout) OVER w) AS prev_step_delta, abs(payout - lead(payout) OVER w) AS next_step_delta,
((payout % 500) < 100 OR (payout % 500) > 400)::INT AS is_attractive FROM full_l WINDOW w AS (PARTITION BY ladder_id ORDER BY step)""")
def step_deltas(spark, sf):
    full = L.filled_ladder(supplier_ladders(spark, sf), ["ladder_id"], 40)
    return L.step_deltas(full, ["ladder_id"]).select("ladder_id", "step", "prev_step_delta", "next_step_delta", "is_attractive")


@query("clusters_renumbered_by_mean", """
WITH c AS (SELECT user_id, user_id % 4 AS cluster, value FROM events), m AS (SELECT cluster, avg(value) AS m FROM c GROUP BY 1),
k AS (SELECT cluster, row_number() OVER (ORDER BY m DESC, cluster) - 1 AS new FROM m)
SELECT k.new AS cluster, count(*) AS n, round(avg(value), 6) AS mean_value FROM c JOIN k ON c.cluster = k.cluster GROUP BY 1""")
def renumbered(spark, sf):
    ev = table(spark, sf, "events").select((F.col("user_id") % 4).alias("cluster"), "value")
    out = R.renumbered_by_mean(ev, [], "cluster", "value", ascending=False)
    return out.groupBy("cluster").agg(F.count("*").alias("n"), r(F.avg("value")).alias("mean_value")).select(
        F.col("cluster").cast("bigint").alias("cluster"), "n", "mean_value"
    )


@query("main_category_per_user", """
SELECT o_custkey, o_orderpriority, n AS trips FROM (SELECT o_custkey, o_orderpriority, count(*) AS n,
row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, o_orderpriority) AS rn FROM orders GROUP BY 1, 2) WHERE rn = 1""")
def main_category(spark, sf):
    return R.main_category(table(spark, sf, "orders"), ["o_custkey"], "o_orderpriority")


@query("share_of_group", """
WITH g AS (SELECT event_type, hour(ts)::INT AS hour, count(*) AS n FROM events GROUP BY 1, 2)
SELECT event_type, hour, n, round(n / (sum(n) OVER (PARTITION BY event_type))::DOUBLE, 6) AS share FROM g""")
def shares(spark, sf):
    ev = table(spark, sf, "events").select("event_type", F.hour("ts").alias("hour"), F.lit(1).alias("n"))
    return rounded(R.share_of_total(ev, ["event_type", "hour"], "n", ["event_type"]))


# --- sort, limit, top-k ---------------------------------------------------

@query("ordered_by_expression", """
SELECT ts::DATE AS day, count(*) AS n FROM events GROUP BY 1 ORDER BY 2 DESC, 1""")
def ordered(spark, sf):
    return table(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "day")


@query("newest_row", """
SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1""")
def newest(spark, sf):
    return table(spark, sf, "orders").filter("o_orderstatus = 'P'").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(1).select("o_orderkey", "o_custkey")


@query("top_ten_by_absolute_weight", """
SELECT c_custkey, c_acctbal FROM customer ORDER BY abs(c_acctbal - 4000) DESC, c_custkey LIMIT 10""")
def top_ten(spark, sf):
    return table(spark, sf, "customer").orderBy(F.desc(F.abs(F.col("c_acctbal") - 4000)), "c_custkey").limit(10).select("c_custkey", "c_acctbal")


@query("sorted_by_custom_order", """
SELECT event_type, n, CASE event_type WHEN 'signup' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 3 WHEN 'purchase' THEN 4 END AS sort_rank
FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1) ORDER BY sort_rank NULLS LAST""")
def custom_order(spark, sf):
    n = table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return R.ordered_by_map(n, "event_type", {"signup": 1, "view": 2, "click": 3, "purchase": 4})


@query("drop_incomplete_period", """
WITH d AS (SELECT event_type, ts::DATE AS ds, count(*) AS n FROM events GROUP BY 1, 2)
SELECT event_type, ds, n FROM d WHERE ds < (SELECT max(ds) FROM d x WHERE x.event_type = d.event_type)""")
def drop_last(spark, sf):
    d = table(spark, sf, "events").groupBy("event_type", F.to_date("ts").alias("ds")).agg(F.count("*").alias("n"))
    return T.drop_last_period(d, "ds", ["event_type"])


@query("argmax_over_candidates", """
SELECT event_type, arg_max(hour, (n, -hour)) AS best_hour, arg_min(hour, (abs(n - 80), hour)) AS nearest_hour FROM
(SELECT event_type, hour(ts)::INT AS hour, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1""")
def argmax(spark, sf):
    g = table(spark, sf, "events").groupBy("event_type", F.hour("ts").alias("hour")).agg(F.count("*").alias("n"))
    return g.groupBy("event_type").agg(
        F.max_by("hour", F.struct(F.col("n"), -F.col("hour"))).alias("best_hour"),
        F.min_by("hour", F.struct(F.abs(F.col("n") - 80), F.col("hour"))).alias("nearest_hour"),
    )
