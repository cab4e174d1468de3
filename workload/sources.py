"""Source, sink, status and streaming queries over the given tables."""

import uuid

from pyspark.sql import functions as F

from curbside.functions.frames import shared_folder
from curbside.operators import polygons as P
from curbside.sources import files as FS
from curbside.sources import jdbc as J
from curbside.sources import tables as T
from curbside.streaming import funnels as ST

from .base import offers, query, r, rounded, table, tables
from .geo import hex_rings_sql, pts_cells_sql


def _fresh(spark, kind):
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


@query("newest_pending_request", """
SELECT o_orderkey AS id, o_orderstatus AS status FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1""")
def pending(spark, sf):
    req = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "P", "PENDING").otherwise("READY").alias("status"), F.struct("o_orderdate", "o_orderkey").alias("created_dt")
    )
    return T.newest_pending(req).select("id", F.lit("P").alias("status"))


@query("current_status_from_log", """
SELECT user_id AS id, arg_max(event_type, (ts, event_id)) AS status FROM events GROUP BY 1""")
def status(spark, sf):
    log = table(spark, sf, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("status"), F.struct("ts", "event_id").alias("ts"))
    return T.current_status(log).select("id", "status")


@query("validated_requests", """
SELECT o_orderpriority, (o_totalprice BETWEEN 1000 AND 300000 AND o_orderkey % 40 BETWEEN 7 AND 30)::INT AS valid, count(*) AS n FROM orders GROUP BY 1, 2""")
def validated(spark, sf):
    req = table(spark, sf, "orders").select("o_orderpriority", F.col("o_totalprice").alias("limit_sum"), (F.col("o_orderkey") % 40).alias("train_period"))
    return T.validated_request(req, (1000, 300000), (7, 30)).groupBy("o_orderpriority", F.col("valid").cast("int").alias("valid")).agg(F.count("*").alias("n"))


@query("run_markers_per_region", """SELECT 2 AS type_id, n_nationkey AS region_id, DATE '2024-01-31' AS date, 'v2' AS version FROM nation""")
def markers(spark, sf):
    return T.run_marker(table(spark, sf, "nation"), "n_nationkey", 2, "2024-01-31", "v2").drop("created")


@query("source_freshness_flag", """
SELECT ((SELECT min(ts)::DATE <= DATE '2024-01-02' AND max(ts)::DATE >= DATE '2024-01-29' FROM events)::INT + (SELECT min(o_orderdate)::DATE <= DATE '2024-01-02' AND max(o_orderdate)::DATE >= DATE '2024-01-29' FROM orders)::INT = 2)::INT AS flag_data_source_no_problems""")
def freshness(spark, sf):
    ev, o = tables(spark, sf, "events", "orders")
    return T.sources_fresh([(ev, "ts"), (o, "o_orderdate")], "2024-01-02", "2024-01-29")


@query("sql_template_named_arguments", """
SELECT event_type, count(*) AS n FROM events WHERE user_id % 25 = 7 AND ts >= '2024-01-10' GROUP BY 1""")
def template(spark, sf):
    text = "select event_type, count(*) as n from {facts} where user_id % 25 = :locality and ts >= :since group by event_type"
    return FS.run_template(spark, text, {"facts": table(spark, sf, "events")}, {"locality": 7, "since": "2024-01-10"})


@query("sql_template_with_frame", """
WITH drivers_split AS (SELECT DISTINCT user_id, user_id % 2 AS split FROM events WHERE event_type = 'purchase')
SELECT split, count(*) AS offers FROM events JOIN drivers_split USING (user_id) GROUP BY 1""")
def template_frame(spark, sf):
    ev = table(spark, sf, "events")
    drivers = ev.filter("event_type = 'purchase'").select("user_id", (F.col("user_id") % 2).alias("split")).distinct()
    return FS.run_template(spark, "select split, count(*) as offers from {ev} join {drivers_split} using (user_id) group by split", {"ev": ev, "drivers_split": drivers})


@query("partitioned_slice_copy", """
SELECT ts::DATE AS dt, user_id % 5 AS locality_id, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2""")
def slice_copy(spark, sf):
    ev = table(spark, sf, "events").withColumns({"dt": F.to_date("ts"), "locality_id": F.col("user_id") % 5})
    path = _fresh(spark, "copy")
    FS.copy_partitions(ev, path, ["dt", "locality_id"])
    back = spark.read.parquet(path)
    return back.groupBy("dt", F.col("locality_id").cast("bigint").alias("locality_id")).agg(F.count("*").alias("n"), r(F.sum("value"), 4).alias("value"))


@query("csv_and_json_round_trip", """
SELECT 'csv' AS fmt, count(*) AS n, sum(c_custkey)::BIGINT AS keys FROM customer UNION ALL SELECT 'json', count(*), sum(c_custkey)::BIGINT FROM customer UNION ALL SELECT 'orc', count(*), sum(c_custkey)::BIGINT FROM customer""")
def round_trip(spark, sf):
    c = table(spark, sf, "customer")
    out = None
    for fmt in ("csv", "json", "orc"):
        path = f"{_fresh(spark, 'file')}.{fmt}"
        FS.save_file(c, path)
        options = {"multiLine": False} if fmt == "json" else {}
        back = FS.read_file(spark, path, schema=c.schema, **options)
        part = back.agg(F.lit(fmt).alias("fmt"), F.count("*").alias("n"), F.sum("c_custkey").alias("keys"))
        out = part if out is None else out.unionByName(part)
    return out.select("fmt", "n", "keys")


@query("insertable_rows_nulls_and_seconds", """
SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS ts, CASE WHEN event_id % 10 <> 0 THEN value END AS value FROM events""")
def insertable(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "ts", F.when(F.col("event_id") % 10 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("value"))
    out = J.insertable(ev, ["event_id", "ts", "value"])
    return out.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


@query("label_rows_to_columns", """
SELECT c_mktsegment AS company, c_nationkey % 3 AS period, round(sum(c_acctbal), 2) AS total_, count(*)::DOUBLE AS number_ FROM customer GROUP BY 1, 2""")
def label_rows(spark, sf):
    from curbside.functions.scalars import label_text

    c = table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("company"), (F.col("c_nationkey") % 3).alias("period")).agg(
        F.round(F.sum("c_acctbal"), 2).alias("t"), F.count("*").cast("double").alias("n")
    )
    long = c.select("company", "period", F.explode(F.array(F.struct(F.lit("  total ").alias("l"), F.col("t").alias("v")), F.struct(F.lit(" number ").alias("l"), F.col("n").alias("v")))).alias("e"))
    labelled = long.select("company", "period", label_text("e.l").alias("label"), "e.v")
    return labelled.groupBy("company", "period").pivot("label", ["total_", "number_"]).agg(F.first("v"))


@query("geojson_feature_collection", f"""WITH {pts_cells_sql(8)}, {hex_rings_sql()}
SELECT cell, '{{"type":"Feature","properties":{{"cell":' || cell || ',"n":' || n || '}},"geometry":{{"type":"Polygon","coordinates":[[' || positions || ']]}}}}' AS feature FROM rings JOIN busy USING (cell)""")
def collection(spark, sf):
    """One feature per busy hex cell, as GeoJSON text rows."""
    from curbside.functions.hexgrid import cell_corners, point_cell

    from .geo import points

    cells = points(spark, sf).groupBy(point_cell(F.col("lat"), F.col("lon"), 8).alias("cell")).agg(F.count("*").alias("n"))
    return cells.select("cell", P.feature(cell_corners(F.col("cell")), F.struct("cell", "n")).alias("feature"))


def _event_stream(spark, sf):
    stream = spark.readStream.schema(table(spark, sf, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))  # event time must be a zoned timestamp


@query("streamed_view_funnel", """
SELECT time_bucket(INTERVAL 20 MINUTE, ts) AS dt, user_id % 5 AS locality, count(DISTINCT user_id) AS users, count(*) FILTER (event_type='view') AS views, count(*) FILTER (event_type='click') AS orders, count(*) FILTER (event_type='purchase') AS rides,
round(sum(value) FILTER (event_type='purchase'), 4) AS bill FROM events GROUP BY 1, 2""")
def streamed_funnel(spark, sf):
    """A finite stream over the events, closed at its end: every window comes out."""
    closing = _fresh(spark, "closing")
    stream = ST.closable(_event_stream(spark, sf), "ts", closing).withColumn("locality", F.col("user_id") % 5)
    funnel = ST.streamed_view_funnel(stream, "ts", ["locality"], "user_id", "event_type", "value")
    path = _fresh(spark, "stream")
    ST.run_and_close(funnel.withColumn("bill", F.round("bill", 4)), path, _fresh(spark, "state"), "ts", closing)
    return spark.read.schema(funnel.schema).parquet(path)


@query("streamed_price_health_alerts", """
WITH s AS (SELECT time_bucket(INTERVAL 30 MINUTE, ts) AS slot, user_id % 4 AS campaign_id, sum(value * 2.5) / (sum(value + 5) - sum(value * 0.1)) AS health, avg(1 + (event_id % 10) / 10.0) AS surge, count(*) AS orders FROM events GROUP BY 1, 2)
SELECT slot, campaign_id, orders, round(health, 6) AS health FROM s WHERE health > 2 AND surge < 1.5 AND orders > 1""")
def streamed_health(spark, sf):
    closing = _fresh(spark, "closing")
    ev = ST.closable(_event_stream(spark, sf), "ts", closing).select(
        "ts", (F.col("user_id") % 4).alias("campaign_id"), F.col("event_id").alias("order_id"), (1 + (F.col("event_id") % 10) / 10.0).alias("surge"),
        (F.col("value") * 2.5).alias("price"), (F.col("value") + 5).alias("bill"), (F.col("value") * 0.1).alias("incentive"),
    )
    limits = table(spark, sf, "events").select((F.col("user_id") % 4).alias("campaign_id")).distinct().withColumns(
        {"max_health": F.lit(2.0), "max_surge": F.lit(1.5), "min_orders": F.lit(1)}
    )
    alerts = ST.streamed_price_health(ev, "ts", ["campaign_id"], limits, ["campaign_id"])
    path = _fresh(spark, "stream")
    ST.run_and_close(alerts, path, _fresh(spark, "state"), "ts", closing)
    return spark.read.schema(alerts.schema).parquet(path).select("slot", "campaign_id", "orders", r("health").alias("health"))


@query("rides_by_month_and_day", """
SELECT month(o_orderdate)::INT AS month, day(o_orderdate)::INT AS day, count(*) AS rides FROM orders GROUP BY 1, 2""")
def month_day(spark, sf):
    """Orders written and read as CSV with an explicit schema, then counted per month and day."""
    path = f"{_fresh(spark, 'rides')}.csv"
    FS.save_file(table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("string").alias("o_orderdate")), path)
    back = FS.read_file(spark, path, schema="o_orderkey bigint, o_orderdate string").select(F.to_timestamp("o_orderdate").alias("ts"))
    return back.groupBy(F.month("ts").alias("month"), F.dayofmonth("ts").alias("day")).agg(F.count("*").alias("rides"))
