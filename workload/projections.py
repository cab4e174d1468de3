"""Projection, predicate and scalar-function queries."""

from pyspark.sql import functions as F

from curbside.functions import scalars as S
from curbside.functions.frames import require_columns
from curbside.operators import relational as R
from curbside.operators import temporal as T

from .base import OFFERS_SQL, crc_sql, offers, query, r, rounded, table, tables


@query("configured_predicates", """
SELECT user_id, count(*) AS n FROM events WHERE event_type = 'purchase' AND value > 30 AND user_id % 3 = 1 GROUP BY 1""")
def predicates(spark, sf):
    ev = table(spark, sf, "events")
    config = ["event_type = 'purchase'", "value > 30", F.col("user_id") % 3 == 1]
    return ev.filter(S.all_of(config)).groupBy("user_id").agg(F.count("*").alias("n"))


@query("offer_row_flags", """
SELECT event_id, (event_type IN ('click','purchase'))::INT AS is_ar, (event_type = 'purchase')::INT AS is_cp,
(user_id IS NOT DISTINCT FROM event_id % 150)::INT AS picked_up, (json_extract_string(props, '$.k')::INT > 50)::INT AS is_geo_trip FROM events""")
def row_flags(spark, sf):
    ev = table(spark, sf, "events")
    campaign = F.when(F.get_json_object("props", "$.k").cast("int") > 50, 1)
    return ev.select(
        "event_id", S.flag(F.col("event_type").isin("click", "purchase")).alias("is_ar"), S.flag(F.col("event_type") == "purchase").alias("is_cp"),
        S.flag(F.col("user_id").eqNullSafe(F.col("event_id") % 150)).alias("picked_up"), S.flag(campaign.isNotNull()).alias("is_geo_trip"),
    )


@query("action_code_buckets", """
WITH a AS (SELECT user_id % 25 AS locality, (event_id % 10)::INT - 5 AS action FROM events)
SELECT locality, sum((action IN (1,-2,3,4))::INT)::BIGINT AS accept, sum((action IN (-1,-3))::INT)::BIGINT AS reject, sum((action IN (0,-4,-5))::INT)::BIGINT AS fraud FROM a GROUP BY 1""")
def action_codes(spark, sf):
    a = table(spark, sf, "events").select((F.col("user_id") % 25).alias("locality"), (F.col("event_id") % 10 - 5).cast("int").alias("action"))
    return a.groupBy("locality").agg(*[F.sum(c).alias(n) for n, c in S.action_flags("action").items()])


@query("distance_bands", """
WITH d AS (SELECT CASE WHEN event_id % 11 = 0 THEN NULL ELSE (event_id % 13) * 1.0 END AS km FROM events)
SELECT CASE WHEN km BETWEEN 0 AND 3 THEN '0-3' WHEN km BETWEEN 3 AND 6 THEN '3-6' WHEN km BETWEEN 6 AND 10 THEN '6-10' WHEN km > 10 THEN '>10' ELSE 'no data' END AS band,
CASE WHEN km > 6 THEN 'long' ELSE 'short' END AS trip, count(*) AS n FROM d GROUP BY 1, 2""")
def bands(spark, sf):
    d = table(spark, sf, "events").select(F.when(F.col("event_id") % 11 != 0, (F.col("event_id") % 13).cast("double")).alias("km"))
    return d.groupBy(S.distance_band("km").alias("band"), S.long_trip("km").alias("trip")).agg(F.count("*").alias("n"))


@query("segment_and_split_names", """
SELECT CASE user_id % 6 WHEN 0 THEN 'BOTTOM' WHEN 1 THEN 'LOW' WHEN 2 THEN 'MIDDLE' WHEN 3 THEN 'HIGH' WHEN 4 THEN 'TOP' END AS segment,
chr(65 + (user_id % 3)::INT) AS split, count(*) AS n FROM events GROUP BY 1, 2""")
def names(spark, sf):
    ev = table(spark, sf, "events")
    return ev.groupBy(S.segment_name(F.col("user_id") % 6).alias("segment"), S.split_letter(F.col("user_id") % 3).alias("split")).agg(F.count("*").alias("n"))


@query("case_insensitive_contains", """
SELECT lang, sum((lower(text) LIKE '%data%')::INT)::BIGINT AS hits, count(*) AS n FROM documents GROUP BY 1""")
def contains(spark, sf):
    return table(spark, sf, "documents").groupBy("lang").agg(F.sum(S.contains_ci("text", "DATA")).alias("hits"), F.count("*").alias("n"))


@query("quality_filters", """
SELECT c_mktsegment, count(*) AS n, round(avg(o_totalprice), 6) AS bill FROM orders JOIN customer ON o_custkey = c_custkey
WHERE o_orderstatus <> 'P' AND c_acctbal >= 0 AND o_totalprice < 400000 GROUP BY 1""")
def quality(spark, sf):
    o, c = tables(spark, sf, "orders", "customer")
    good = o.filter("o_orderstatus <> 'P' and o_totalprice < 400000")
    return (
        good.join(c.filter("c_acctbal >= 0"), good.o_custkey == c.c_custkey)
        .groupBy("c_mktsegment").agg(F.count("*").alias("n"), r(F.avg("o_totalprice")).alias("bill"))
    )


@query("half_open_validity_filter", """
SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12' AND value > 0 AND value <= 50 GROUP BY 1""")
def half_open(spark, sf):
    ev = table(spark, sf, "events").filter("ts >= timestamp'2024-01-05' and ts < timestamp'2024-01-12' and value > 0 and value <= 50")
    return ev.groupBy("event_type").agg(F.count("*").alias("n"))


@query("null_fills", """
WITH v AS (SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN value END AS v, CASE WHEN event_id % 5 <> 0 THEN value END AS w FROM events)
SELECT event_id, coalesce(v, 0) AS zero_filled, coalesce(w, (SELECT median(w) FROM v)) AS median_filled FROM v""")
def fills(spark, sf):
    v = table(spark, sf, "events").select(
        "event_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("zero_filled"), F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("median_filled")
    )
    return R.median_fill(v.fillna(0.0, ["zero_filled"]), ["median_filled"])


@query("null_token_cleaning", """
WITH t AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN '\\N' WHEN 1 THEN '-' ELSE role END AS raw FROM conversations)
SELECT conv_id, turn, raw FROM t WHERE raw NOT IN ('\\N', '-', 'TTM/current', '')""")
def tokens(spark, sf):
    raw = F.when(F.col("turn") % 4 == 0, "\\N").when(F.col("turn") % 4 == 1, "-").otherwise(F.col("role"))
    t = table(spark, sf, "conversations").select("conv_id", "turn", S.null_tokens(raw).alias("raw"))
    return t.dropna(subset=["raw"])


@query("cast_block", """
SELECT doc_id::INT AS doc_id, n_chars::FLOAT AS n_chars, coalesce(try_cast(substr(source, 4) AS DOUBLE), 0) AS source_no, coalesce(try_cast(lang AS DOUBLE), 0) AS not_a_number FROM documents""")
def casts(spark, sf):
    d = require_columns(table(spark, sf, "documents"), ["doc_id", "source", "lang", "n_chars"])
    return d.select(
        F.col("doc_id").cast("int").alias("doc_id"), F.col("n_chars").cast("float").alias("n_chars"),
        S.double_or_zero(F.substring("source", 4, 100)).alias("source_no"), S.double_or_zero("lang").alias("not_a_number"),
    )


@query("renamed_lowercase_columns", "SELECT n_nationkey AS id, lower(n_name) AS name FROM nation")
def renamed(spark, sf):
    n = table(spark, sf, "nation")
    return n.select("n_nationkey", F.lower("n_name").alias("NAME")).toDF("ID", "NAME").withColumnsRenamed({"ID": "id", "NAME": "name"})


@query("lateral_column_alias", """
SELECT event_id, ts::DATE AS dt, date_trunc('week', ts)::DATE AS week, date_diff('day', date_trunc('week', ts)::DATE, ts::DATE) AS day_of_week FROM events""")
def lateral_alias(spark, sf):
    table(spark, sf, "events").createOrReplaceTempView("curbside_events")
    return spark.sql(
        "select event_id, cast(ts as date) as dt, cast(date_trunc('week', dt) as date) as week, cast(datediff(dt, week) as bigint) as day_of_week from curbside_events"
    )


@query("scalar_subquery_share", """
SELECT event_type, count(*) AS n FROM events WHERE value < (SELECT avg(value) FROM events) GROUP BY 1""")
def scalar_share(spark, sf):
    ev = table(spark, sf, "events")
    mean = ev.agg(F.avg("value").alias("m")).select("m").scalar()
    return ev.filter(F.col("value") < mean).groupBy("event_type").agg(F.count("*").alias("n"))


@query("precipitation_bands", """
WITH d AS (SELECT ts::DATE AS ds, sum(value) / 100 AS v FROM events WHERE event_type='error' GROUP BY 1)
SELECT ds, CASE WHEN v < 1 THEN 0 WHEN v < 20 THEN 1 ELSE 2 END AS band FROM d""")
def precipitation(spark, sf):
    d = table(spark, sf, "events").filter("event_type = 'error'").groupBy(F.to_date("ts").alias("ds")).agg((F.sum("value") / 100).alias("v"))
    return d.select("ds", S.precipitation_band("v").alias("band"))


_CALENDAR = [("holiday", "2024-01-01", "2024-01-09"), ("holiday", "2024-01-07", "2024-01-11"), ("anomaly", "2024-01-20", "2024-01-21")]


@query("calendar_event_flags", """
WITH c(flag, a, b) AS (VALUES ('holiday', DATE '2024-01-01', DATE '2024-01-09'), ('holiday', DATE '2024-01-07', DATE '2024-01-11'), ('anomaly', DATE '2024-01-20', DATE '2024-01-21')),
d AS (SELECT ts::DATE AS ds, count(*) AS n FROM events GROUP BY 1)
SELECT ds, n, (EXISTS (SELECT 1 FROM c WHERE flag='holiday' AND ds >= a AND ds < b))::INT AS holiday, (EXISTS (SELECT 1 FROM c WHERE flag='anomaly' AND ds >= a AND ds < b))::INT AS anomaly FROM d""")
def calendar_flags(spark, sf):
    cal = spark.createDataFrame(_CALENDAR, "flag string, date_from string, date_to string")
    d = table(spark, sf, "events").groupBy(F.to_date("ts").alias("ds")).agg(F.count("*").alias("n"))
    return T.event_flags(d, "ds", cal, ["holiday", "anomaly"])


@query("calendar_features", """
SELECT o_orderkey, month(o_orderdate)::INT AS month, quarter(o_orderdate)::INT AS quarter, (isodow(o_orderdate) - 1)::INT AS day_of_week, dayname(o_orderdate) AS day_name,
(isodow(o_orderdate) >= 6)::INT AS weekend, (isodow(o_orderdate) >= 5)::INT AS long_weekend, isodow(o_orderdate)::INT AS iso_day, dayofweek(o_orderdate)::INT AS sunday_zero FROM orders""")
def calendar(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", *[c.alias(n) for n, c in S.calendar_columns("o_orderdate").items()], S.weekend_flag("o_orderdate").alias("weekend"),
        S.weekend_flag("o_orderdate", friday_counts=True).alias("long_weekend"), S.iso_weekday("o_orderdate").alias("iso_day"),
        S.sunday_zero_weekday("o_orderdate").alias("sunday_zero"),
    )


@query("one_hot_columns", """
SELECT c_custkey, (c_mktsegment='BUILDING')::INT AS "c_mktsegment=BUILDING", (c_mktsegment='MACHINERY')::INT AS "c_mktsegment=MACHINERY" FROM customer""")
def one_hot(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return R.one_hot(c, "c_mktsegment", ["BUILDING", "MACHINERY"]).drop("c_mktsegment")


@query("attractive_payout_flag", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, ((l_extendedprice % 500) < 100 OR (l_extendedprice % 500) > 400)::INT AS is_attractive FROM lineitem""")
def attractive(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", S.attractive_payout("l_extendedprice").alias("is_attractive")
    )


@query("min_max_scaling", """
SELECT c_custkey, round((c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ()), 8) AS c_acctbal FROM customer""")
def scaling(spark, sf):
    return rounded(R.min_max_scaled(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"]), 8)


@query("string_functions", """
SELECT p_partkey, p_brand || '-' || lower(p_type) AS label, greatest(split_part(p_size || '_' || (p_size * 3 % 50), '_', 1)::INT, split_part(p_size || '_' || (p_size * 3 % 50), '_', 2)::INT) AS max_step,
replace(ltrim('  ' || p_name), ' ', '_') AS name_label, split_part(p_name || ',x', ',', 1) AS first_token, lpad(p_size::VARCHAR, 3, '0') AS padded, upper(to_hex(p_partkey)) AS hex_id FROM part""")
def strings(spark, sf):
    steps = F.concat_ws("_", F.col("p_size").cast("string"), (F.col("p_size") * 3 % 50).cast("string"))
    return table(spark, sf, "part").select(
        "p_partkey", F.concat("p_brand", F.lit("-"), F.lower("p_type")).alias("label"), S.max_part(steps).alias("max_step"),
        S.label_text(F.concat(F.lit("  "), F.col("p_name"))).alias("name_label"), S.first_token(F.concat("p_name", F.lit(",x"))).alias("first_token"),
        F.lpad(F.col("p_size").cast("string"), 3, "0").alias("padded"), F.hex("p_partkey").alias("hex_id"),
    )


@query("camel_case_words", """
SELECT c_custkey, array_to_string(regexp_extract_all('Rider' || upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) || 'Home', '([A-Z][a-z0-9]*)', 1), ' ') AS words FROM customer""")
def camel(spark, sf):
    name = F.concat(F.lit("Rider"), F.upper(F.substring("c_mktsegment", 1, 1)), F.lower(F.substring("c_mktsegment", 2, 100)), F.lit("Home"))
    return table(spark, sf, "customer").select("c_custkey", S.camel_words(name).alias("words"))


@query("date_truncations_and_slots", """
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, strftime(time_bucket(INTERVAL 20 MINUTE, ts), '%H:%M') AS slot20, strftime(time_bucket(INTERVAL 15 MINUTE, ts), '%H:%M') AS slot15,
strftime(time_bucket(INTERVAL 30 MINUTE, ts), '%H:%M') AS slot30, date_trunc('week', ts)::DATE AS monday, count(*) AS n FROM events GROUP BY 1,2,3,4,5""")
def truncations(spark, sf):
    hm = lambda c: F.date_format(c, "HH:mm")
    return table(spark, sf, "events").groupBy(
        F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH:mm").alias("hour"), hm(S.slot_start("ts", 20)).alias("slot20"),
        hm(S.slot_start("ts", 15)).alias("slot15"), hm(S.slot_start("ts", 30)).alias("slot30"), F.to_date(F.date_trunc("week", "ts")).alias("monday"),
    ).agg(F.count("*").alias("n"))


@query("date_arithmetic", """
SELECT o_orderkey, strftime(o_orderdate + INTERVAL 3661 SECOND, '%Y-%m-%d %H:%M:%S') AS local_time, (o_orderdate + INTERVAL 2 MONTH)::DATE AS plus_months, (o_orderdate - INTERVAL 6 DAY)::DATE AS minus_days,
date_diff('minute', o_orderdate, TIMESTAMP '2001-08-02') AS minutes_between, greatest(date_diff('day', DATE '1999-01-01', o_orderdate::DATE), 0)::INT AS days_clipped FROM orders""")
def date_math(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", F.date_format(S.local_time("o_orderdate", 3661), "yyyy-MM-dd HH:mm:ss").alias("local_time"),
        F.add_months("o_orderdate", 2).alias("plus_months"), F.date_sub("o_orderdate", 6).alias("minus_days"),
        F.timestamp_diff("MINUTE", F.col("o_orderdate"), F.lit("2001-08-02").cast("timestamp")).alias("minutes_between"),
        S.days_since("o_orderdate", F.lit("1999-01-01").cast("date")).alias("days_clipped"),
    )


@query("math_and_rounding", """
SELECT event_id, round_even(value, 0) AS half_even, round(value / 10) * 10 AS tens, floor(value) AS whole, round(ln(value + 1), 8) AS log1p, abs(value - 50) AS dist,
round(sqrt(value), 8) AS root, event_id % 7 AS rest, least(greatest(value, 10), 100) AS clipped, 5 * round_even(value * 1.25 / 5, 0) AS price FROM events""")
def maths(spark, sf):
    v = F.col("value")
    return table(spark, sf, "events").select(
        "event_id", F.bround(v, 0).alias("half_even"), (F.round(v / 10) * 10).alias("tens"), F.floor(v).cast("double").alias("whole"), r(F.log1p(v), 8).alias("log1p"),
        F.abs(v - 50).alias("dist"), r(F.sqrt(v), 8).alias("root"), (F.col("event_id") % 7).alias("rest"), S.clip("value", 10.0, 100.0).alias("clipped"),
        S.to_fives(v * 1.25).alias("price"),
    )


@query("array_functions", """
SELECT vec_id, list_contains(list_transform(embedding[1:8], lambda x: (x > 0)::INT), 1) AS any_positive, round(list_sum(list_transform(embedding[1:8], lambda x: x::DOUBLE)), 6) AS head_sum, len(embedding) AS dims FROM embeddings""")
def arrays(spark, sf):
    head = F.slice("embedding", 1, 8)
    return table(spark, sf, "embeddings").select(
        "vec_id", F.array_contains(F.transform(head, lambda x: (x > 0).cast("int")), 1).alias("any_positive"),
        r(F.aggregate(head, F.lit(0.0), lambda s, x: s + x.cast("double"))).alias("head_sum"), F.size("embedding").cast("bigint").alias("dims"),
    )


@query("exploded_array_groups", """
SELECT g, count(*) AS n, count(DISTINCT user_id) AS users FROM (SELECT user_id, unnest([json_extract_string(props, '$.k')::INT % 3, json_extract_string(props, '$.k')::INT % 5]) AS g FROM events) GROUP BY 1""")
def exploded(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    ev = table(spark, sf, "events").select("user_id", F.explode(F.array(k % 3, k % 5)).alias("g"))
    return ev.groupBy("g").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query("json_functions", """
WITH j AS (SELECT event_id, json_extract_string(props, '$.k')::INT AS k FROM events)
SELECT event_id, k, (k % 4)::BIGINT AS items, '{"id":' || event_id || ',"k":' || k || '}' AS doc FROM j""")
def json_fns(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    listed = F.to_json(F.sequence(F.lit(1), k % 4))
    items = F.when(k % 4 == 0, F.lit(0)).otherwise(F.json_array_length(listed)).cast("bigint")
    return table(spark, sf, "events").select(
        "event_id", F.from_json("props", "k int")["k"].alias("k"), items.alias("items"), F.to_json(F.struct(F.col("event_id").alias("id"), k.alias("k"))).alias("doc")
    )


@query("money_text_parser", """
WITH t AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '-' ELSE o_totalprice END AS raw, o_totalprice, o_orderkey % 3 AS m FROM orders)
SELECT o_orderkey, CASE m WHEN 0 THEN NULL WHEN 1 THEN o_totalprice ELSE round(o_totalprice, 1) * 1e6 END AS amount FROM t""")
def money(spark, sf):
    m = F.col("o_orderkey") % 3
    raw = (
        F.when(m == 0, "-").when(m == 1, F.format_number("o_totalprice", 2))
        .otherwise(F.concat(F.format_string("%.1f", F.round("o_totalprice", 1)), F.lit(" M")))
    )
    return table(spark, sf, "orders").select("o_orderkey", S.money_text(raw).alias("amount"))


@query("salted_crc_split", f"""WITH u AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1),
c AS (SELECT *, {crc_sql("(user_id || '_20210406')")} % 100 AS a, {crc_sql("(user_id % 5 || '_' || user_id || 'salt')")} % 100 AS b FROM u)
SELECT CASE WHEN a < 50 THEN 'B' ELSE 'A' END AS split, b < 30 AS in_campaign, sum(n)::BIGINT AS n, count(*) AS users FROM c GROUP BY 1, 2""")
def crc_split(spark, sf):
    from curbside.functions.hashing import campaign_split, salted_split

    ev = table(spark, sf, "events")
    return ev.groupBy(
        salted_split("_20210406", "user_id").alias("split"),
        campaign_split(F.col("user_id") % 5, F.col("user_id"), "salt", F.lit(30)).alias("in_campaign"),
    ).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query("inline_json_table", """
WITH p AS (SELECT page_id, generate_subscripts AS i FROM (SELECT page_id, unnest(range(0, (page_id % 4)::INT)) AS generate_subscripts FROM pages))
SELECT page_id, i::INT AS id, 'zone' || i AS name FROM p""")
def inline_json(spark, sf):
    items = F.transform(
        F.when(F.col("page_id") % 4 > 0, F.sequence(F.lit(0), (F.col("page_id") % 4).cast("int") - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(i.alias("id"), F.concat(F.lit("zone"), i.cast("string")).alias("name")),
    )
    doc = table(spark, sf, "pages").select("page_id", F.to_json(items).alias("doc"))
    return doc.select("page_id", F.inline(F.from_json("doc", "array<struct<id:int,name:string>>")))
