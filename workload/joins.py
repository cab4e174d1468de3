"""Join and set queries."""

from pyspark.sql import functions as F

from curbside.operators import relational as R
from curbside.operators import temporal as T

from .base import offers, query, r, rounded, table, tables


@query("inner_join_segment_bills", """
SELECT c_mktsegment AS segment, count(*) AS orders, round(sum(o_totalprice), 2) AS bill
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def inner_join(spark, sf):
    o, c = tables(spark, sf, "orders", "customer")
    return (
        o.join(c, o.o_custkey == c.c_custkey)
        .groupBy(F.col("c_mktsegment").alias("segment"))
        .agg(F.count("*").alias("orders"), r(F.sum("o_totalprice"), 2).alias("bill"))
    )


@query("left_join_composite_key", """
SELECT u.user_id, u.d AS day, u.views, coalesce(p.trips, 0) AS trips
FROM (SELECT user_id, ts::DATE AS d, count(*) AS views FROM events WHERE event_type='view' GROUP BY 1,2) u
LEFT JOIN (SELECT user_id, ts::DATE AS d, count(*) AS trips FROM events WHERE event_type='purchase' GROUP BY 1,2) p
  ON u.user_id = p.user_id AND u.d = p.d""")
def left_composite(spark, sf):
    ev = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    views = ev.filter("event_type = 'view'").groupBy("user_id", "day").agg(F.count("*").alias("views"))
    trips = ev.filter("event_type = 'purchase'").groupBy("user_id", "day").agg(F.count("*").alias("trips"))
    return views.join(trips, ["user_id", "day"], "left").withColumn("trips", F.coalesce("trips", F.lit(0)))


@query("star_join_inner_dimensions", """
SELECT r_name, p_brand, count(*) AS lines, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""")
def star_join(spark, sf):
    li, o, c, n, rg, p = tables(spark, sf, "lineitem", "orders", "customer", "nation", "region", "part")
    fact = li.select("l_orderkey", "l_partkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("rev"))
    dims = [
        (o.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), ["l_orderkey"]),
        (c.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), ["o_custkey"]),
        (n.select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey"), ["c_nationkey"]),
        (rg.select(F.col("r_regionkey").alias("n_regionkey"), "r_name"), ["n_regionkey"]),
        (p.select(F.col("p_partkey").alias("l_partkey"), "p_brand"), ["l_partkey"]),
    ]
    return (
        R.star_join(fact, dims)
        .groupBy("r_name", "p_brand")
        .agg(F.count("*").alias("lines"), r(F.sum("rev"), 4).alias("revenue"))
    )


@query("chained_left_joins_different_keys", """
SELECT o_orderpriority, count(*) AS n, count(l.l_orderkey) AS with_lines, count(c.c_custkey) AS rich_customers
FROM orders o LEFT JOIN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49 GROUP BY 1) l ON o.o_orderkey = l.l_orderkey
LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) c ON o.o_custkey = c.c_custkey GROUP BY 1""")
def chained_left(spark, sf):
    o, li, c = tables(spark, sf, "orders", "lineitem", "customer")
    big = li.filter("l_quantity >= 49").select("l_orderkey").distinct()
    rich = c.filter("c_acctbal > 5000").select("c_custkey")
    return (
        o.join(big, o.o_orderkey == big.l_orderkey, "left")
        .join(rich, o.o_custkey == rich.c_custkey, "left")
        .groupBy("o_orderpriority")
        .agg(F.count("*").alias("n"), F.count("l_orderkey").alias("with_lines"), F.count("c_custkey").alias("rich_customers"))
    )


@query("index_lookup_left_join", """
SELECT s_nationkey, n_name, count(*) AS suppliers FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2""")
def index_lookup(spark, sf):
    s, n = tables(spark, sf, "supplier", "nation")
    return (
        s.join(n.withColumnRenamed("n_nationkey", "s_nationkey"), "s_nationkey", "left")
        .groupBy("s_nationkey", "n_name").agg(F.count("*").alias("suppliers"))
    )


# Two versions of each locality's time offset; the second is open-ended.
_DIM_SQL = """dim AS (
  SELECT n_nationkey AS locality, n_nationkey * 600 AS offset_sec, TIMESTAMP '2024-01-01' AS valid_from,
         TIMESTAMP '2024-01-10' + to_hours(n_nationkey) AS valid_to FROM nation
  UNION ALL
  SELECT n_nationkey, n_nationkey * 600 + 3600, TIMESTAMP '2024-01-10' + to_hours(n_nationkey),
         TIMESTAMP '9999-12-31' FROM nation)"""


def _dim(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("locality"))
    cut = F.timestamp_add("HOUR", F.col("locality"), F.lit("2024-01-10").cast("timestamp"))
    first = n.select(
        "locality", (F.col("locality") * 600).alias("offset_sec"), F.lit("2024-01-01").cast("timestamp").alias("valid_from"),
        cut.alias("valid_to"),
    )
    second = n.select(
        "locality", (F.col("locality") * 600 + 3600).alias("offset_sec"), cut.alias("valid_from"),
        F.lit(T.FOREVER).cast("timestamp").alias("valid_to"),
    )
    return first.unionByName(second)


@query("validity_range_join", f"""WITH {_DIM_SQL}
SELECT e.user_id % 25 AS locality, offset_sec, count(*) AS n, strftime(max(ts + to_seconds(offset_sec)), '%Y-%m-%d %H:%M:%S') AS last_local
FROM events e JOIN dim d ON e.user_id % 25 = d.locality AND e.ts >= d.valid_from AND e.ts < d.valid_to
GROUP BY 1, 2""")
def validity_join(spark, sf):
    ev = table(spark, sf, "events").withColumn("locality", F.col("user_id") % 25)
    joined = T.validity_join(ev, _dim(spark, sf), ["locality"], "ts")
    local = F.timestamp_add("SECOND", F.col("offset_sec"), F.col("ts"))
    return joined.groupBy("locality", "offset_sec").agg(
        F.count("*").alias("n"), F.date_format(F.max(local), "yyyy-MM-dd HH:mm:ss").alias("last_local")
    )


@query("current_version_join", f"""WITH {_DIM_SQL}
SELECT d.offset_sec, count(*) AS n FROM events e JOIN dim d ON e.user_id % 25 = d.locality
WHERE d.valid_to = TIMESTAMP '9999-12-31' GROUP BY 1""")
def current_version(spark, sf):
    ev = table(spark, sf, "events").withColumn("locality", F.col("user_id") % 25)
    return ev.join(T.current_version(_dim(spark, sf)), "locality").groupBy("offset_sec").agg(F.count("*").alias("n"))


@query("nth_event_aligned_join", """
WITH v AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events WHERE event_type='view'),
p AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events WHERE event_type='purchase')
SELECT v.user_id, v.rn, date_diff('second', date_trunc('second', v.ts), date_trunc('second', p.ts)) AS gap
FROM v JOIN p ON v.user_id = p.user_id AND v.rn = p.rn""")
def nth_event(spark, sf):
    ev = table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type")
    v = ev.filter("event_type = 'view'").select("user_id", "ts", "event_id")
    p = ev.filter("event_type = 'purchase'").select("user_id", F.col("ts").alias("trip_ts"), F.col("event_id").alias("trip_id"))
    joined = T.aligned_events(v, p, ["user_id"], "ts", "trip_ts", ["event_id"], ["trip_id"])
    return joined.select("user_id", "rn", (F.unix_timestamp("trip_ts") - F.unix_timestamp("ts")).alias("gap"))


_SCHEDULE = [(1, 1, 8, 0, 12, 30), (2, 1, 18, 15, 24, 0), (3, 3, 0, 0, 6, 0), (4, 5, 9, 30, 10, 0), (5, 7, 0, 0, 24, 0)]


def schedule(spark):
    return spark.createDataFrame(
        _SCHEDULE, "campaign_id int, week_day int, from_hour int, from_minute int, until_hour int, until_minute int"
    )


SCHEDULE_SQL = "sched(campaign_id, week_day, fh, fm, uh, um) AS (VALUES " + ", ".join(map(str, _SCHEDULE)) + ")"


@query("schedule_interval_join", f"""WITH {SCHEDULE_SQL}
SELECT campaign_id, count(*) AS offers, count(DISTINCT user_id) AS drivers
FROM events JOIN sched ON isodow(ts) = week_day AND hour(ts)*60+minute(ts) >= fh*60+fm AND hour(ts)*60+minute(ts) < uh*60+um
GROUP BY 1""")
def schedule_join(spark, sf):
    joined = T.schedule_join(table(spark, sf, "events"), schedule(spark), "ts")
    return joined.groupBy("campaign_id").agg(F.count("*").alias("offers"), F.countDistinct("user_id").alias("drivers"))


@query("semi_join_active_users", """
SELECT o_orderstatus, count(*) AS n FROM orders
WHERE o_custkey IN (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase') GROUP BY 1""")
def semi_join(spark, sf):
    o, ev = tables(spark, sf, "orders", "events")
    active = ev.filter("event_type = 'purchase'").select(F.col("user_id").alias("o_custkey"))
    return o.join(active, "o_custkey", "left_semi").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("anti_join_exclusions", """
SELECT c_mktsegment, count(*) AS n FROM customer
WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000) GROUP BY 1""")
def anti_join(spark, sf):
    c, o = tables(spark, sf, "customer", "orders")
    big = o.filter("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey"))
    return R.exclude(c, ["c_custkey"], big).groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query("any_left_join_first_match", """
SELECT c_custkey, f.o_orderkey AS first_order, f.o_totalprice AS first_bill FROM customer
LEFT JOIN (SELECT o_custkey, o_orderkey, o_totalprice,
                  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) f
ON c_custkey = f.o_custkey AND rn = 1""")
def any_left(spark, sf):
    c, o = tables(spark, sf, "customer", "orders")
    right = o.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice", "o_orderdate")
    out = R.any_left_join(c.select("c_custkey"), right, ["c_custkey"], ["o_orderdate", "o_orderkey"])
    return out.select("c_custkey", F.col("o_orderkey").alias("first_order"), F.col("o_totalprice").alias("first_bill"))


@query("shipped_right_side_join", """
SELECT n_name, count(*) AS suppliers, round(avg(s_acctbal), 4) AS avg_balance
FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1""")
def shipped_right(spark, sf):
    s, n = tables(spark, sf, "supplier", "nation")
    return (
        s.join(n, s.s_nationkey == n.n_nationkey)
        .groupBy("n_name").agg(F.count("*").alias("suppliers"), r(F.avg("s_acctbal"), 4).alias("avg_balance"))
    )


@query("cross_grid_with_actuals", """
WITH d AS (SELECT DISTINCT ts::DATE AS date FROM events), s AS (SELECT DISTINCT event_type AS segment FROM events),
a AS (SELECT ts::DATE AS date, event_type AS segment, (user_id % 7) + 1 AS step, count(*) AS n FROM events GROUP BY 1,2,3)
SELECT d.date, s.segment, g.step, coalesce(a.n, 0) AS n FROM d, s, (SELECT unnest(range(1, 8)) AS step) g
LEFT JOIN a ON a.date = d.date AND a.segment = s.segment AND a.step = g.step""")
def cross_grid(spark, sf):
    ev = table(spark, sf, "events").select(
        F.to_date("ts").alias("date"), F.col("event_type").alias("segment"), (F.col("user_id") % 7 + 1).alias("step")
    )
    # distinct dates and segments are few; the grid is built by exploding collected key sets of one aggregate row
    keys = ev.agg(F.collect_set("date").alias("dates"), F.collect_set("segment").alias("segments"))
    grid = (
        keys.select(F.explode("dates").alias("date"), "segments")
        .select("date", F.explode("segments").alias("segment"))
        .select("date", "segment", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(7).cast("bigint"))).alias("step"))
    )
    actual = ev.groupBy("date", "segment", "step").agg(F.count("*").alias("n"))
    return grid.join(actual, ["date", "segment", "step"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query("latest_snapshot_join", """
SELECT event_type, count(*) AS n, round(sum(value), 4) AS value FROM events
WHERE ts::DATE = (SELECT max(ts::DATE) FROM events) GROUP BY 1""")
def latest_snapshot(spark, sf):
    ev = table(spark, sf, "events").withColumn("created", F.to_date("ts"))
    return T.latest_snapshot(ev, "created").groupBy("event_type").agg(F.count("*").alias("n"), r(F.sum("value"), 4).alias("value"))


@query("group_threshold_join_back", """
SELECT event_id, value FROM (SELECT event_id, value, quantile_cont(value, 0.9) OVER (PARTITION BY event_type) AS tr FROM events)
WHERE value >= tr""")
def threshold_join(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "event_type", "value")
    return R.with_group_quantiles(ev, ["event_type"], {"value_tr": ("value", 0.9)}).filter("value >= value_tr").select("event_id", "value")


@query("preaggregated_sides_join", """
SELECT o.o_custkey, o.orders, coalesce(l.lines, 0) AS lines, round(o.bill, 2) AS bill FROM
(SELECT o_custkey, count(*) AS orders, sum(o_totalprice) AS bill FROM orders GROUP BY 1) o
LEFT JOIN (SELECT o_custkey, count(*) AS lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' GROUP BY 1) l
ON o.o_custkey = l.o_custkey""")
def preaggregated(spark, sf):
    o, li = tables(spark, sf, "orders", "lineitem")
    left = o.groupBy("o_custkey").agg(F.count("*").alias("orders"), r(F.sum("o_totalprice"), 2).alias("bill"))
    returned = li.filter("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("c"))
    right = returned.join(o.select("o_orderkey", "o_custkey"), "o_orderkey").groupBy("o_custkey").agg(F.sum("c").alias("lines"))
    return left.join(right, "o_custkey", "left").withColumn("lines", F.coalesce("lines", F.lit(0)))


@query("distinct_side_join_no_fanout", """
SELECT p_brand, count(*) AS lines FROM lineitem JOIN part ON l_partkey = p_partkey
JOIN (SELECT DISTINCT o_orderkey FROM orders WHERE o_orderstatus = 'F') f ON l_orderkey = f.o_orderkey GROUP BY 1""")
def distinct_side(spark, sf):
    li, p, o = tables(spark, sf, "lineitem", "part", "orders")
    done = o.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return (
        li.select("l_orderkey", "l_partkey").join(done, "l_orderkey", "left_semi")
        .join(p.select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
        .groupBy("p_brand").agg(F.count("*").alias("lines"))
    )


@query("left_join_using_having", """
SELECT n_nationkey AS region_id, n_name, coalesce(max(o_orderdate)::DATE, DATE '0001-01-01') AS last_run
FROM nation LEFT JOIN (SELECT c_nationkey AS n_nationkey, o_orderdate FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 498000) x
USING (n_nationkey) GROUP BY 1, 2 HAVING coalesce(max(o_orderdate)::DATE, DATE '0001-01-01') < DATE '2001-06-01'""")
def due_regions(spark, sf):
    from curbside.sources.tables import due_regions as due

    n, c, o = tables(spark, sf, "nation", "customer", "orders")
    runs = (
        o.filter("o_totalprice > 498000").join(c, o.o_custkey == c.c_custkey)
        .select(F.col("c_nationkey").alias("region_id"), F.to_date("o_orderdate").alias("run_date"))
    )
    regions = n.select(F.col("n_nationkey").alias("region_id"), "n_name")
    return due(regions, runs, "region_id", "run_date", today="2001-06-01")


@query("left_filtered_to_inner", """
SELECT c_mktsegment, count(*) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000
WHERE o_orderkey IS NOT NULL GROUP BY 1""")
def left_to_inner(spark, sf):
    c, o = tables(spark, sf, "customer", "orders")
    return c.join(o.filter("o_totalprice > 400000"), c.c_custkey == o.o_custkey).groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query("payment_with_company_share", """
SELECT o_custkey, round(sum(pay) + coalesce(sum(company), 0), 4) AS paid FROM
(SELECT l_orderkey, sum(l_extendedprice) AS pay FROM lineitem GROUP BY 1) p
JOIN orders ON l_orderkey = o_orderkey
LEFT JOIN (SELECT l_orderkey AS k, sum(l_extendedprice * l_tax) AS company FROM lineitem WHERE l_linenumber = 1 GROUP BY 1) c ON k = l_orderkey
GROUP BY 1""")
def company_payment(spark, sf):
    li, o = tables(spark, sf, "lineitem", "orders")
    # one pass over the payments: both sums are conditional aggregates of the same rows
    pay = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sum("l_extendedprice").alias("pay"),
        F.sum(F.when(F.col("l_linenumber") == 1, F.col("l_extendedprice") * F.col("l_tax"))).alias("company"),
    )
    return (
        pay.join(o.select("o_orderkey", "o_custkey"), "o_orderkey")
        .groupBy("o_custkey")
        .agg(r(F.sum("pay") + F.coalesce(F.sum("company"), F.lit(0.0)), 4).alias("paid"))
    )


# --- set operations -------------------------------------------------------

@query("union_two_periods", """
SELECT 'tw' AS retro, event_type, count(*) AS n FROM events WHERE ts >= '2024-01-15' AND ts < '2024-01-20' GROUP BY 2
UNION ALL SELECT 'lw', event_type, count(*) FROM events WHERE ts >= '2024-01-08' AND ts < '2024-01-13' GROUP BY 2""")
def two_periods(spark, sf):
    both = T.retro_union(table(spark, sf, "events"), "ts", "2024-01-15", "2024-01-19")
    return both.groupBy("retro", "event_type").agg(F.count("*").alias("n"))


@query("append_frames_missing_columns", """
SELECT 'supplier' AS kind, s_suppkey AS id, s_acctbal AS balance, NULL AS segment FROM supplier
UNION ALL SELECT 'customer', c_custkey, c_acctbal, c_mktsegment FROM customer""")
def append_frames(spark, sf):
    s, c = tables(spark, sf, "supplier", "customer")
    a = s.select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    b = c.select(
        F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"),
        F.col("c_mktsegment").alias("segment"),
    )
    return a.unionByName(b, allowMissingColumns=True)


@query("distinct_pairs", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct_pairs(spark, sf):
    return table(spark, sf, "orders").select("o_orderstatus", "o_orderpriority").distinct()


@query("split_combinations", """
WITH s AS (SELECT DISTINCT user_id % 4 AS s FROM events)
SELECT a.s AS split_0, b.s AS split_1 FROM s a JOIN s b ON a.s < b.s""")
def split_combinations(spark, sf):
    from curbside.operators.metrics import split_pairs

    return split_pairs(table(spark, sf, "events").withColumn("split", F.col("user_id") % 4), "split")


@query("history_forecast_stitched", """
WITH h AS (SELECT date_trunc('day', ts)::DATE AS ds, count(*) AS y FROM events WHERE ts < '2024-01-20' GROUP BY 1),
f AS (SELECT date_trunc('day', ts)::DATE AS ds, count(*) AS y FROM events WHERE ts >= '2024-01-19' GROUP BY 1)
SELECT ds, y, 'history' AS src FROM h WHERE ds < (SELECT max(ds) FROM h) UNION ALL SELECT ds, y, 'forecast' FROM f""")
def stitched(spark, sf):
    ev = table(spark, sf, "events").withColumn("ds", F.to_date("ts"))
    daily = lambda d, src: d.groupBy("ds").agg(F.count("*").alias("y")).withColumn("src", F.lit(src))
    history = T.drop_last_period(daily(ev.filter("ts < '2024-01-20'"), "history"), "ds")
    return history.unionByName(daily(ev.filter("ts >= '2024-01-19'"), "forecast"))


@query("extended_date_spine", """
WITH b AS (SELECT min(ts::DATE) AS a, max(ts::DATE) AS z FROM events)
SELECT g.ds::DATE AS ds, coalesce(n, 0) AS n FROM b, generate_series(b.a::TIMESTAMP, b.z + INTERVAL 7 DAY, INTERVAL 1 DAY) g(ds)
LEFT JOIN (SELECT ts::DATE AS d, count(*) AS n FROM events GROUP BY 1) e ON e.d = g.ds::DATE""")
def extended_spine(spark, sf):
    ev = table(spark, sf, "events").withColumn("ds", F.to_date("ts"))
    bounds = ev.agg(F.min("ds").alias("a"), F.max("ds").alias("z"))
    spine = bounds.select(F.explode(F.sequence("a", F.date_add("z", 7))).alias("ds"))
    counts = ev.groupBy("ds").agg(F.count("*").alias("n"))
    return spine.join(counts, "ds", "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query("half_hour_duplicated_grid", """
WITH h AS (SELECT date_trunc('hour', ts) AS ds, count(*) AS n FROM events GROUP BY 1)
SELECT strftime(ds + to_minutes(m), '%Y-%m-%d %H:%M') AS slot, n FROM h, (VALUES (0), (30)) t(m)""")
def half_hours(spark, sf):
    hourly = table(spark, sf, "events").groupBy(F.date_trunc("hour", "ts").alias("ds")).agg(F.count("*").alias("n"))
    return T.half_hour_grid(hourly, "ds").select(F.date_format("ds", "yyyy-MM-dd HH:mm").alias("slot"), "n")
