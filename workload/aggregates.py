"""Aggregation and feature queries."""

from pyspark.sql import functions as F

from curbside.functions import scalars as S
from curbside.operators import features as X
from curbside.operators import ranks as K
from curbside.operators import relational as R
from curbside.operators.metrics import Agg, aggregate

from .base import OFFERS_SQL, offers, query, r, rounded, table, tables


@query("basic_aggregates_by_keys", """
SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(avg(l_extendedprice), 4) AS avg_price,
min(l_shipdate)::DATE AS first_ship, max(l_shipdate)::DATE AS last_ship FROM lineitem GROUP BY 1, 2""")
def basic(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), r(F.sum("l_quantity"), 2).alias("qty"), r(F.avg("l_extendedprice"), 4).alias("avg_price"),
        F.to_date(F.min("l_shipdate")).alias("first_ship"), F.to_date(F.max("l_shipdate")).alias("last_ship"),
    )


@query("exact_distinct_counts", """
SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT event_id) AS events FROM events GROUP BY 1""")
def distinct_counts(spark, sf):
    return aggregate(
        table(spark, sf, "events"), ["event_type"],
        {"users": Agg("user_id", "nunique"), "events": Agg("event_id", "nunique")},
    )


@query("conditional_aggregates", """
SELECT ts::DATE AS day, count(DISTINCT user_id) FILTER (event_type='purchase') AS buyers,
round(sum(value) FILTER (event_type='purchase'), 4) AS bill, count(*) FILTER (value > 100) AS large,
count(DISTINCT event_id) FILTER (event_type IN ('view','click')) AS looks FROM events GROUP BY 1""")
def conditional(spark, sf):
    out = aggregate(
        table(spark, sf, "events").withColumn("day", F.to_date("ts")), ["day"],
        {
            "buyers": Agg("user_id", "nunique", ("event_type = 'purchase'",)),
            "bill": Agg("value", "sum", ("event_type = 'purchase'",)),
            "large": Agg("*", "count", ("value > 100",)),
            "looks": Agg("event_id", "nunique", ("event_type in ('view', 'click')",)),
        },
    )
    return rounded(out, 4)


@query("value_at_latest_time", """
SELECT user_id, arg_max(event_type, (ts, event_id)) AS last_type, arg_max(value, (ts, event_id)) AS last_value FROM events GROUP BY 1""")
def latest_value(spark, sf):
    when = F.struct("ts", "event_id")
    return table(spark, sf, "events").groupBy("user_id").agg(
        F.max_by("event_type", when).alias("last_type"), F.max_by("value", when).alias("last_value")
    )


@query("exact_median_by_group", """
SELECT o_orderpriority, round(median(o_totalprice), 4) AS median FROM orders GROUP BY 1""")
def median(spark, sf):
    return rounded(K.exact_median(table(spark, sf, "orders"), ["o_orderpriority"], "o_totalprice"), 4)


@query("interpolated_quantiles_by_group", """
SELECT l_shipmode_day AS day, round(quantile_cont(l_extendedprice, 0.1), 4) AS p10, round(quantile_cont(l_extendedprice, 0.75), 4) AS p75,
round(quantile_cont(l_extendedprice, 0.99), 4) AS p99 FROM (SELECT dayofweek(l_shipdate) AS l_shipmode_day, l_extendedprice FROM lineitem) GROUP BY 1""")
def quantiles(spark, sf):
    li = table(spark, sf, "lineitem").select(S.sunday_zero_weekday("l_shipdate").cast("bigint").alias("day"), "l_extendedprice")
    return rounded(K.exact_quantiles(li, ["day"], "l_extendedprice", {"p10": 0.1, "p75": 0.75, "p99": 0.99}), 4)


@query("percentile_aggregate_factory", """
SELECT p_brand, round(quantile_cont(p_size, 0.25), 4) AS p25, round(quantile_cont(p_size, 0.9), 4) AS p90 FROM part GROUP BY 1""")
def percentile_factory(spark, sf):
    # p_size takes at most 50 values: the aggregate's value map stays small
    return table(spark, sf, "part").groupBy("p_brand").agg(
        r(K.percentile_of("p_size", 25), 4).alias("p25"), r(K.percentile_of("p_size", 90), 4).alias("p90")
    )


@query("collected_arrays", """
SELECT s_nationkey, array_to_string(list_sort(list(s_suppkey)), ',') AS ids FROM supplier GROUP BY 1""")
def collected(spark, sf):
    return table(spark, sf, "supplier").groupBy("s_nationkey").agg(
        F.array_join(F.sort_array(F.collect_list("s_suppkey")).cast("array<string>"), ",").alias("ids")
    )


@query("ratio_of_sums_zero_guard", """
SELECT user_id, round(coalesce(sum(CASE WHEN event_type='purchase' AND value > 150 THEN value END)
 / nullif(sum(CASE WHEN event_type='view' AND value > 150 THEN value END), 0), 0), 6) AS ratio FROM events GROUP BY 1""")
def guarded_ratio(spark, sf):
    ev = table(spark, sf, "events")
    part = lambda kind: F.sum(F.when((F.col("event_type") == kind) & (F.col("value") > 150), F.col("value")))
    return ev.groupBy("user_id").agg(r(S.ratio_or_zero(part("purchase"), part("view"))).alias("ratio"))


@query("having_two_distinct_counts", """
SELECT o_custkey, count(DISTINCT o_orderstatus) AS statuses, count(DISTINCT o_orderpriority) AS priorities FROM orders
GROUP BY 1 HAVING count(DISTINCT o_orderstatus) < 3 AND count(DISTINCT o_orderpriority) > 3""")
def having(spark, sf):
    return aggregate(
        table(spark, sf, "orders"), ["o_custkey"],
        {"statuses": Agg("o_orderstatus", "nunique"), "priorities": Agg("o_orderpriority", "nunique")},
    ).filter("statuses < 3 and priorities > 3")


@query("user_flag_any", """
SELECT user_id, max((event_type='purchase' AND value > 250)::INT) AS is_big FROM events GROUP BY 1""")
def user_flag(spark, sf):
    big = (F.col("event_type") == "purchase") & (F.col("value") > 250)
    return table(spark, sf, "events").groupBy("user_id").agg(F.max(big.cast("int")).alias("is_big"))


@query("result_grain_aggregate", """
SELECT user_id % 25 AS locality, user_id % 5 AS campaign, event_type AS polygon, hour(ts)::INT AS hour, round(avg(1 + (event_id % 10) / 10.0), 6) AS surge,
round(sum(value), 4) AS price, count(*) AS orders FROM events GROUP BY 1, 2, 3, 4""")
def result_grain(spark, sf):
    ev = table(spark, sf, "events")
    return ev.groupBy(
        (F.col("user_id") % 25).alias("locality"), (F.col("user_id") % 5).alias("campaign"), F.col("event_type").alias("polygon"),
        F.hour("ts").alias("hour"),
    ).agg(
        r(F.avg(1 + (F.col("event_id") % 10) / 10.0)).alias("surge"), r(F.sum("value"), 4).alias("price"), F.count("*").alias("orders")
    )


@query("activity_context_before_date", """
SELECT o_custkey, min(o_orderdate)::DATE AS dt_first, max(o_orderdate)::DATE AS dt_last, count(*) AS trips FROM orders
WHERE o_orderdate < '1999-01-01' GROUP BY 1""")
def activity(spark, sf):
    return X.activity_context(table(spark, sf, "orders"), "o_custkey", "o_orderdate", "1999-01-01")


RFM_SQL = """SELECT c_nationkey AS region, o_custkey AS user_id, date_diff('day', max(o_orderdate)::DATE, DATE '2001-08-02') AS recency,
round(count(*) / count(DISTINCT date_trunc('week', o_orderdate))::DOUBLE, 2) AS frequency FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2"""


@query("recency_frequency_monetary", f"""
SELECT f.region, f.user_id, f.recency, f.frequency, round(m.monetary, 4) AS monetary FROM ({RFM_SQL}) f
JOIN (SELECT o_custkey, -sum(o_totalprice) / 100.0 AS monetary FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) m ON m.o_custkey = f.user_id""")
def rfm(spark, sf):
    o, c = tables(spark, sf, "orders", "customer")
    trips = o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("c_nationkey").alias("region"), F.col("o_custkey").alias("user_id"), "o_orderdate"
    )
    paid = o.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("user_id"), F.col("o_totalprice").alias("amount"))
    return rounded(X.rfm_source(trips, "user_id", "region", "o_orderdate", paid, "amount", "2001-08-02"), 4)


@query("exclusive_overlap_counts", """
SELECT l_returnflag,
 count(*) FILTER (a AND NOT b AND NOT c) AS only_a, count(*) FILTER (NOT a AND b AND NOT c) AS only_b, count(*) FILTER (a AND b AND NOT c) AS a_b,
 count(*) FILTER (NOT a AND NOT b AND c) AS only_c, count(*) FILTER (a AND NOT b AND c) AS a_c, count(*) FILTER (NOT a AND b AND c) AS b_c,
 count(*) FILTER (a AND b AND c) AS a_b_c
FROM (SELECT l_returnflag, l_discount > 0.05 AS a, l_tax > 0.04 AS b, l_quantity > 25 AS c FROM lineitem) GROUP BY 1""")
def overlap(spark, sf):
    li = table(spark, sf, "lineitem").select(
        "l_returnflag", (F.col("l_discount") > 0.05).alias("a"), (F.col("l_tax") > 0.04).alias("b"), (F.col("l_quantity") > 25).alias("c")
    )
    return R.overlap_counts(li, ["a", "b", "c"], ["l_returnflag"])


@query("monthly_spend_shares", """
SELECT date_trunc('month', l_shipdate)::DATE AS month, round(sum(l_extendedprice * l_discount), 4) AS discount, round(sum(l_extendedprice * l_tax), 4) AS tax,
round(sum(l_extendedprice * l_discount) / (sum(l_extendedprice * l_discount) + sum(l_extendedprice * l_tax)), 6) AS discount_share,
round(sum(l_extendedprice * l_tax) / (sum(l_extendedprice * l_discount) + sum(l_extendedprice * l_tax)), 6) AS tax_share FROM lineitem GROUP BY 1""")
def monthly(spark, sf):
    li = table(spark, sf, "lineitem").select(
        "l_shipdate", (F.col("l_extendedprice") * F.col("l_discount")).alias("discount"), (F.col("l_extendedprice") * F.col("l_tax")).alias("tax")
    )
    out = X.monthly_shares(li, "l_shipdate", ["discount", "tax"])
    return out.select(
        F.to_date("month").alias("month"), r("discount", 4).alias("discount"), r("tax", 4).alias("tax"),
        r("discount_share").alias("discount_share"), r("tax_share").alias("tax_share"),
    )


@query("daily_market_context", """
WITH t AS (SELECT o_orderdate::DATE AS date, o_custkey, CASE WHEN o_totalprice <= 0 THEN 1 ELSE o_totalprice END AS gmv, o_totalprice AS bill,
 o_totalprice * 0.1 AS commission, o_orderkey % 12 > 6 AS long FROM orders)
SELECT date, count(*) AS orders, count(DISTINCT o_custkey) AS active_drivers, round(sum(gmv), 2) AS gmv, round(sum(commission), 3) AS commission,
count(*) FILTER (long) AS long_orders, round(avg(bill) FILTER (long), 7) AS avg_price_long, round(avg(bill) FILTER (NOT long), 7) AS avg_price_short,
round(count(*) FILTER (long) / count(*)::DOUBLE, 6) AS share_long, round(sum(commission) / sum(gmv), 6) AS commission_share,
(isodow(date) >= 6)::INT AS is_weekend FROM t GROUP BY 1""")
def market(spark, sf):
    o = table(spark, sf, "orders").select(
        "o_orderdate", "o_custkey", "o_totalprice", (F.col("o_orderkey") % 12).alias("km"), (F.col("o_totalprice") * 0.1).alias("commission")
    )
    out = X.market_context(o, "o_orderdate", "o_custkey", "o_totalprice", "km", "commission")
    return out.select(
        "date", "orders", "active_drivers", r("gmv", 2).alias("gmv"), r("commission", 3).alias("commission"), "long_orders",
        r("avg_price_long", 7).alias("avg_price_long"), r("avg_price_short", 7).alias("avg_price_short"),
        r("share_long").alias("share_long"), r("commission_share").alias("commission_share"), "is_weekend",
    )


@query("contribution_economics_per_user", """
WITH t AS (SELECT o_custkey, sum(o_totalprice) AS gmv, sum(o_totalprice * 0.2) AS commission, sum(CASE WHEN o_orderpriority='1-URGENT' THEN o_totalprice * 0.05 ELSE 0 END) AS di, count(*) AS rides
 FROM orders GROUP BY 1)
SELECT o_custkey, rides, round(gmv, 8) AS gmv, round(commission, 8) AS commission, round(di, 8) AS di, round(commission - di, 8) AS contribution,
round((commission - di) / rides, 8) AS copt, round(di / rides, 8) AS dipt, round(commission / rides, 8) AS compt, round(gmv / rides, 8) AS gmvpt FROM t""")
def contribution(spark, sf):
    trips = table(spark, sf, "orders").select(
        "o_custkey", F.col("o_totalprice").alias("bill"), (F.col("o_totalprice") * 0.2).alias("fee"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice") * 0.05).otherwise(0.0).alias("bonus"),
    )
    return rounded(X.contribution_economics(trips, ["o_custkey"], "bill", "fee", "bonus"), 8)


@query("money_per_hour_per_user", """
WITH m AS (SELECT user_id, sum(value) AS gross, sum(value * 0.8) AS net FROM events WHERE event_type='purchase' GROUP BY 1),
h AS (SELECT user_id, count(DISTINCT date_trunc('hour', ts)) AS supply_hours FROM events GROUP BY 1),
t AS (SELECT user_id, count(*) AS trips FROM events WHERE event_type='purchase' AND value > 20 GROUP BY 1)
SELECT c_custkey AS user_id, c_mktsegment AS segment, round(coalesce(gross,0),4) AS money_gross, round(coalesce(net,0),4) AS money_net, coalesce(supply_hours,0) AS supply_hours, coalesce(trips,0) AS trips,
round(coalesce(gross / supply_hours, 0), 6) AS mph FROM customer LEFT JOIN m ON c_custkey=m.user_id LEFT JOIN h ON c_custkey=h.user_id LEFT JOIN t ON c_custkey=t.user_id""")
def mph(spark, sf):
    ev, c = tables(spark, sf, "events", "customer")
    users = c.select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment"))
    trips = ev.filter("event_type = 'purchase'")
    money = trips.groupBy("user_id").agg(F.sum("value").alias("money_gross"), F.sum(F.col("value") * 0.8).alias("money_net"))
    hours = ev.groupBy("user_id").agg(F.countDistinct(F.date_trunc("hour", "ts")).alias("supply_hours"))
    out = X.money_per_hour(users, "user_id", money, hours, trips.filter("value > 20").groupBy("user_id").agg(F.count("*").alias("trips")))
    return out.select(
        "user_id", "segment", r("money_gross", 4).alias("money_gross"), r("money_net", 4).alias("money_net"), "supply_hours", "trips",
        r(S.ratio_or_zero("money_gross", "supply_hours")).alias("mph"),
    )


@query("offers_to_rides_per_user", f"""WITH {OFFERS_SQL}
SELECT o.user_id, o.locality, o.n AS offers, coalesce(r.n, 0) AS rides FROM (SELECT user_id, locality, count(*) AS n FROM offers GROUP BY 1, 2) o
LEFT JOIN (SELECT user_id, locality, count(*) AS n FROM offers WHERE trip = 1 GROUP BY 1, 2) r USING (user_id, locality)""")
def of2r(spark, sf):
    o = offers(spark, sf)
    return X.offers_to_rides(o, o.filter("trip = 1"), ["user_id", "locality"])


@query("churn_flags_window", """
WITH l AS (SELECT o_custkey, max(o_orderdate)::DATE AS last_date FROM orders WHERE o_orderdate::DATE BETWEEN DATE '2001-05-01' AND DATE '2001-07-31' AND o_orderstatus='F' GROUP BY 1)
SELECT o_custkey, last_date, (last_date <= DATE '2001-05-07')::INT AS churn_7day, (last_date <= DATE '2001-05-14')::INT AS churn_14day,
(last_date <= DATE '2001-05-21')::INT AS churn_21day FROM l""")
def churn(spark, sf):
    done = table(spark, sf, "orders").filter("o_orderstatus = 'F'")
    return X.churn_flags(done, ["o_custkey"], "o_orderdate", "2001-05-01", "2001-07-31")


@query("daily_stage_funnel", """
SELECT ts::DATE AS date, count(DISTINCT user_id) FILTER (event_type='signup') AS registered, count(DISTINCT user_id) FILTER (event_type='view') AS activated,
count(DISTINCT user_id) FILTER (event_type='purchase') AS first_trip, count(DISTINCT user_id) FILTER (event_type='purchase' AND value > 50) AS trips_50 FROM events GROUP BY 1""")
def stage_funnel(spark, sf):
    return X.stage_funnel(
        table(spark, sf, "events"), F.to_date("ts"), "user_id",
        {
            "registered": "event_type = 'signup'", "activated": "event_type = 'view'", "first_trip": "event_type = 'purchase'",
            "trips_50": "event_type = 'purchase' and value > 50",
        },
    )


@query("conversion_by_week_and_period", """
WITH d AS (SELECT ts::DATE AS date, count(DISTINCT user_id) FILTER (event_type='view') AS views, count(DISTINCT user_id) FILTER (event_type='purchase') AS trips FROM events GROUP BY 1),
w AS (SELECT CASE WHEN date < DATE '2024-01-16' THEN 'before' ELSE 'after' END AS period, date_trunc('week', date)::DATE AS week, sum(views) AS v, sum(trips) AS t FROM d GROUP BY 1, 2)
SELECT period, week, row_number() OVER (PARTITION BY period ORDER BY week) AS week_no, round(t / v::DOUBLE, 6) AS conversion FROM w""")
def conversion(spark, sf):
    from pyspark.sql import Window

    daily = X.stage_funnel(
        table(spark, sf, "events"), F.to_date("ts"), "user_id", {"views": "event_type = 'view'", "trips": "event_type = 'purchase'"}
    )
    weekly = daily.groupBy(
        F.when(F.col("date") < "2024-01-16", "before").otherwise("after").alias("period"),
        F.to_date(F.date_trunc("week", "date")).alias("week"),
    ).agg(S.safe_ratio(F.sum("trips"), F.sum("views")).alias("conversion"))
    number = F.row_number().over(Window.partitionBy("period").orderBy("week"))  # a row per week
    return weekly.select("period", "week", number.alias("week_no"), r("conversion").alias("conversion"))


@query("json_step_targets", """
WITH s AS (SELECT user_id % 40 AS bonus_id, json_extract_string(props, '$.k')::INT AS step FROM events)
SELECT bonus_id, CASE WHEN min(step) = max(step) THEN min(step)::VARCHAR ELSE min(step) || '_' || max(step) END AS target FROM s GROUP BY 1""")
def json_steps(spark, sf):
    doc = F.concat(F.lit('{"target_steps":[{"target":'), F.get_json_object("props", "$.k"), F.lit("}]}"))
    steps = F.from_json(doc, "target_steps array<struct<target:int>>")["target_steps"]
    s = table(spark, sf, "events").select((F.col("user_id") % 40).alias("bonus_id"), F.explode(steps).alias("s"))
    lo, hi = F.min("s.target"), F.max("s.target")
    return s.groupBy("bonus_id").agg(
        F.when(lo == hi, lo.cast("string")).otherwise(F.concat_ws("_", lo.cast("string"), hi.cast("string"))).alias("target")
    )


@query("daily_operational_ratios", """
SELECT ts::DATE AS ds, round(coalesce(sum((event_type='purchase')::INT) / nullif(sum((event_type='view')::INT), 0)::DOUBLE, 0), 6) AS efficiency,
round(coalesce(sum(CASE WHEN event_type='error' THEN value ELSE 0 END) / nullif(sum((event_type='error')::INT), 0), 0), 6) AS avg_cancel,
round(coalesce(sum((event_type='click')::INT) / nullif(count(*), 0)::DOUBLE, 0), 6) AS ad2r FROM events GROUP BY 1""")
def operational(spark, sf):
    ev = table(spark, sf, "events").select(
        "ts", F.lit(1).alias("one"),
        *[(F.col("event_type") == t).cast("int").alias(t) for t in ("purchase", "view", "click", "error")],
        F.when(F.col("event_type") == "error", F.col("value")).otherwise(0.0).alias("error_value"),
    )
    pairs = {"efficiency": ("purchase", "view"), "avg_cancel": ("error_value", "error"), "ad2r": ("click", "one")}
    return rounded(X.operational_ratios(ev, F.to_date("ts"), pairs))


@query("value_counts_with_share", """
SELECT c_mktsegment, count(*) AS n, round(count(*) / (sum(count(*)) OVER ())::DOUBLE, 6) AS share FROM customer GROUP BY 1""")
def value_counts(spark, sf):
    c = table(spark, sf, "customer").select("c_mktsegment", F.lit(1).alias("n"))
    return rounded(R.share_of_total(c, ["c_mktsegment"], "n"))


@query("pearson_correlation", """
SELECT round(corr(l_quantity, l_extendedprice), 8) AS corr_qty_price, round(avg(l_quantity), 6) AS mean_qty FROM lineitem""")
def correlation(spark, sf):
    return table(spark, sf, "lineitem").agg(
        r(F.corr("l_quantity", "l_extendedprice"), 8).alias("corr_qty_price"), r(F.avg("l_quantity")).alias("mean_qty")
    )


@query("rides_per_hour_zero_filled", """
SELECT h AS hour, count(e.event_id) AS rides FROM (SELECT unnest(range(0, 24))::INT AS h) g LEFT JOIN (SELECT * FROM events WHERE event_type='purchase') e ON hour(e.ts) = h GROUP BY 1""")
def hours(spark, sf):
    return R.zero_filled_hours(table(spark, sf, "events").filter("event_type = 'purchase'"), "ts")


@query("rides_for_selected_hours", """
SELECT hour(ts)::INT AS hour, count(*) AS rides FROM events WHERE event_type='purchase' AND hour(ts) IN (7, 8, 17, 18) GROUP BY 1""")
def selected_hours(spark, sf):
    return R.zero_filled_hours(table(spark, sf, "events").filter("event_type = 'purchase'"), "ts", [7, 8, 17, 18])


@query("acceptance_bin_study", f"""WITH {OFFERS_SQL},
u AS (SELECT user_id, count(*) AS n, sum(accept) AS a, sum(trip) AS t, sum(value * trip) AS money FROM offers GROUP BY 1)
SELECT round_even(a / n::DOUBLE, 1) AS bin, count(*) AS rows, sum(n)::BIGINT AS offers, sum(t)::BIGINT AS trips, round(sum(money) / sum(t), 6) AS money_per_trip, round(sum(t) / sum(n)::DOUBLE, 6) AS trip_rate FROM u GROUP BY 1""")
def bins(spark, sf):
    u = offers(spark, sf).groupBy("user_id").agg(
        F.count("*").alias("offers"), F.sum("accept").alias("a"), F.sum("trip").alias("trips"),
        F.sum(F.col("value") * F.col("trip")).alias("money"),
    )
    return rounded(
        X.bin_study(
            u, S.rate_bin(F.col("a") / F.col("offers")), ["offers", "trips"],
            {"money_per_trip": ("money", "trips"), "trip_rate": ("trips", "offers")},
        )
    )


@query("price_view_funnel_slots", """
WITH v AS (SELECT event_id, user_id, ts, user_id % 25 AS locality, json_extract_string(props, '$.k')::INT AS k, value FROM events),
j AS (SELECT v.locality, v.user_id, time_bucket(INTERVAL 20 MINUTE, v.ts) AS dt, o_orderkey AS order_id, CASE o_orderstatus WHEN 'F' THEN 'CP' WHEN 'O' THEN 'CC' ELSE 'RD' END AS status,
 o_totalprice AS bill, (k * 0.5 + value) AS sale FROM v LEFT JOIN orders ON v.event_id = o_orderkey)
SELECT locality, dt, count(DISTINCT user_id) AS views, count(DISTINCT order_id) FILTER (order_id > 0) AS orders,
count(DISTINCT order_id) FILTER (order_id > 0 AND status NOT IN ('CC','NC')) AS rides, round(coalesce(sum(bill) FILTER (status='CP'), 0), 4) AS client_bill,
round(coalesce(sum(sale) FILTER (sale > 0 AND status='CP'), 0), 4) AS sale_part_ride FROM j GROUP BY 1, 2""")
def view_funnel(spark, sf):
    ev, o = tables(spark, sf, "events", "orders")
    views = ev.select(
        "event_id", F.col("user_id").alias("user"), "ts", (F.col("user_id") % 25).alias("locality"),
        F.array(F.get_json_object("props", "$.k").cast("double") * 0.5, F.col("value")).alias("discounts"),
    )
    orders = o.select(
        F.col("o_orderkey").alias("event_id"), F.col("o_orderkey").alias("order_id"),
        F.when(F.col("o_orderstatus") == "F", "CP").when(F.col("o_orderstatus") == "O", "CC").otherwise("RD").alias("status"),
        F.col("o_totalprice").alias("client_bill"),
    )
    return rounded(X.view_funnel(views, orders, "event_id", ["locality"], "ts"), 4)


@query("supply_seconds_from_state_log", """
WITH l AS (SELECT user_id, event_id, event_type AS state, (event_id % 2)::INT AS robot_status, epoch(date_trunc('second', ts))::BIGINT AS t,
 epoch(time_bucket(INTERVAL 15 MINUTE, ts))::BIGINT AS slot FROM events),
d AS (SELECT *, coalesce(lead(t) OVER (PARTITION BY user_id, slot ORDER BY t, event_id), slot + 900) - t AS seconds FROM l)
SELECT user_id, state, robot_status, sum(seconds)::BIGINT AS seconds FROM d GROUP BY 1, 2, 3""")
def supply_seconds(spark, sf):
    from curbside.operators.temporal import state_seconds

    log = table(spark, sf, "events").select(
        "user_id", F.date_trunc("second", "ts").alias("ts"), "event_id", F.col("event_type").alias("state"),
        (F.col("event_id") % 2).cast("int").alias("robot_status"),
    )
    slots = state_seconds(log, ["user_id"], "ts", ["state", "robot_status"], ["event_id"])
    return slots.groupBy("user_id", "state", "robot_status").agg(F.sum("seconds").alias("seconds"))


@query("sample_and_population_spread", """
SELECT event_type, round(stddev_samp(value), 6) AS sd, round(var_samp(value), 6) AS var_s, round(var_pop(value), 6) AS var_p FROM events GROUP BY 1""")
def spread(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(
        r(F.stddev_samp("value")).alias("sd"), r(F.var_samp("value")).alias("var_s"), r(F.var_pop("value")).alias("var_p")
    )
