"""Alert, ladder, segmentation, scoring, forecast and machine-learning queries."""

from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, LinearSVC, LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import IDF, PCA, HashingTF, Tokenizer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Window
from pyspark.sql import functions as F

from curbside.functions.frames import spread, stable_checkpoint
from curbside.operators import features as X
from curbside.operators import ladders as L
from curbside.operators import ranks as K
from curbside.plans import alerts as A
from curbside.plans import forecast as FC
from curbside.plans import ladder_model as LM
from curbside.plans import scoring as S
from curbside.plans import segmentation as G

from .base import offers, query, r, rounded, table, tables
from .windows import supplier_ladders

# --- alerts ---------------------------------------------------------------

_TRIPS = """trips AS (SELECT event_id, user_id % 6 AS locality, user_id % 4 AS campaign_id, 'c' || (user_id % 4) AS campaign, event_type AS polygon, hour(ts)::INT AS hour, (isodow(ts))::INT AS week_day,
 CASE WHEN event_id % 9 <> 0 THEN 1 + (event_id % 10) / 10.0::DOUBLE END AS surge, value * 2.5 AS price, value + 5 AS bill, value * 0.1 AS incentive FROM events)"""


def trips(spark, sf):
    ev = table(spark, sf, "events")
    return ev.select(
        F.col("event_id").alias("order_id"), (F.col("user_id") % 6).alias("locality"), (F.col("user_id") % 4).alias("campaign_id"),
        F.concat(F.lit("c"), (F.col("user_id") % 4).cast("string")).alias("campaign"), F.col("event_type").alias("polygon"), F.hour("ts").alias("hour"), (F.weekday("ts") + 1).alias("week_day"),
        F.when(F.col("event_id") % 9 != 0, 1 + (F.col("event_id") % 10) / 10.0).alias("surge"), (F.col("value") * 2.5).alias("price"), (F.col("value") + 5).alias("bill"), (F.col("value") * 0.1).alias("incentive"),
    )


def alert_sql(time, q):
    return f"""{_TRIPS}, s AS (SELECT locality, campaign_id, campaign, polygon, {time}, avg(coalesce(surge, 1)) AS surge, sum(price) AS price, sum(bill) AS bill, sum(incentive) AS inc, count(*) AS orders FROM trips GROUP BY ALL),
h AS (SELECT *, price / (bill - inc) AS health, price / orders AS old_price, row_number() OVER (PARTITION BY locality ORDER BY orders DESC, campaign_id, polygon, {time}) AS rk, count(*) OVER (PARTITION BY locality) AS cnt,
 median(orders) OVER (PARTITION BY locality) AS om, median(surge) OVER (PARTITION BY locality) AS sm FROM s),
t AS (SELECT locality, quantile_cont(health, {q}) AS tr FROM h WHERE rk <= round_even(cnt / 3.0, 0) GROUP BY 1),
z AS (SELECT h.*, t.tr, least(greatest((health - tr) / health, 0), 0.1) AS red FROM h JOIN t USING (locality))"""


@query("daily_campaign_alerts", f"""WITH {alert_sql('hour', 0.5)}
SELECT locality, campaign_id, polygon, hour, orders, round(health, 6) AS health, round(surge, 6) AS surge, round(red, 6) AS suggested_reduction FROM z WHERE health > 2 AND surge < 1.5 AND orders > om""")
def daily(spark, sf):
    out = A.daily_alerts(trips(spark, sf), time_keys=["hour"])
    return rounded(out.select("locality", "campaign_id", "polygon", "hour", "orders", "health", "surge", "suggested_reduction"))


@query("suggested_prices", f"""WITH {alert_sql('hour', 0.5)}
SELECT locality, campaign_id, polygon, hour, round(old_price, 6) AS old_price, round(tr, 6) AS threshold, round_even(old_price * (1 - red) / 10, 0) * 10 AS new_price FROM z""")
def suggested(spark, sf):
    out = A.with_suggestions(A.campaign_slots(trips(spark, sf), ["hour"]), ("campaign_id", "polygon", "hour"))
    return rounded(out.select("locality", "campaign_id", "polygon", "hour", "old_price", "threshold", "new_price"))


@query("weekly_campaign_alerts", f"""WITH {alert_sql('week_day, hour', 0.75)}
SELECT locality, campaign_id, polygon, week_day, hour, orders, round(health, 6) AS health, round(red, 6) AS suggested_reduction FROM z WHERE red > 0 AND surge < sm AND orders > om""")
def weekly(spark, sf):
    out = A.weekly_alerts(trips(spark, sf), time_keys=["week_day", "hour"])
    return rounded(out.select("locality", "campaign_id", "polygon", "week_day", "hour", "orders", "health", "suggested_reduction"))


@query("alert_message_lines", f"""WITH {alert_sql('hour', 0.5)}, a AS (SELECT * FROM z WHERE health > 2 AND surge < 1.5 AND orders > om),
p AS (SELECT locality, campaign_id || ', ' || campaign || ', ' || polygon AS head, string_agg(hour || ' - GH ' || format('{{:.2f}}', health), ', ' ORDER BY hour || ' - GH ' || format('{{:.2f}}', health)) AS slots FROM a GROUP BY 1, 2),
l AS (SELECT locality, string_agg(head || ': ' || slots, chr(10) ORDER BY head || ': ' || slots) AS txt FROM p GROUP BY 1)
SELECT locality, 'city: ' || locality || chr(10) || owners || chr(10) || txt AS text FROM l JOIN (VALUES (0, '@a'), (1, '@b @c'), (3, '@d')) o(locality, owners) USING (locality)""")
def messages(spark, sf):
    owners = spark.createDataFrame([(0, "@a"), (1, "@b @c"), (3, "@d")], "locality bigint, owners string")
    return A.message_lines(A.daily_alerts(trips(spark, sf), time_keys=["hour"]), owners, "hour")


# --- segmentation ---------------------------------------------------------

def rfm_frame(spark, sf):
    o, c = tables(spark, sf, "orders", "customer")
    t = o.join(c, o.o_custkey == c.c_custkey).select((F.col("c_nationkey") % 5).alias("region_id"), F.col("o_custkey").alias("driver_id"), "o_orderdate")
    paid = o.select(F.col("o_custkey").alias("driver_id"), (-F.col("o_totalprice") / 100).alias("amount"))
    return X.rfm_source(t, "driver_id", "region_id", "o_orderdate", paid, "amount", "2001-08-02")


@query("rfm_segments")
def rfm(spark, sf):
    """Iterative fit; tests compare it with a NumPy fit of the same method."""
    return G.segment_output(G.rfm_segments(rfm_frame(spark, sf)), "2001-08-02")


@query("rfm_three_level_segment_sizes")
def rfm_sizes(spark, sf):
    seg = G.rfm_segments(rfm_frame(spark, sf))
    return G.segment_output(seg, "2001-08-02", 3).groupBy("locality_id", "segment_id").agg(F.count("*").alias("drivers"))


@query("latest_version_rfm_source", """
SELECT o_custkey, count(*) AS orders, round(sum(price), 4) AS paid FROM (SELECT o_custkey, o_orderdate, arg_max(o_totalprice, o_orderkey) AS price FROM orders GROUP BY 1, 2) GROUP BY 1""")
def latest_version(spark, sf):
    """Latest version per (user, date) key, then the sums: versions merge in one aggregate."""
    o = table(spark, sf, "orders").groupBy("o_custkey", "o_orderdate").agg(F.max_by("o_totalprice", "o_orderkey").alias("price"))
    return o.groupBy("o_custkey").agg(F.count("*").alias("orders"), r(F.sum("price"), 4).alias("paid"))


_CUTS = {
    0: ((0.0, 8.0, [300, 500, 700]), (0.0, 4.0, [400, 600, 800]), (0.0, 14.0, [500, 700, 850])), 1: ((1.0, 7.0, [256, 512, 768]), (0.5, 3.5, [200, 640]), (2.0, 12.0, [600, 800, 900])),
    2: ((0.0, 9.0, [100, 450, 650]), (0.0, 5.0, [350, 500, 620]), (0.0, 16.0, [520, 610, 800])), 3: ((2.0, 6.0, [333, 444, 555]), (1.0, 3.0, []), (4.0, 11.0, [640, 700, 990])),
}


def _digit_sql(column, k):
    low, high, cuts = (f"CASE region_id {' '.join(f'WHEN {region} THEN {show(p[k][i])}' for region, p in _CUTS.items())} END"
                       for i, show in enumerate((lambda v: f"{v!r}::DOUBLE", lambda v: f"{v!r}::DOUBLE", lambda v: f"{v}::INT[]")))
    return f"len(list_filter({cuts}, lambda c: c <= least(greatest(floor((ln({column} + 1) - {low}) / ({high} - {low}) * 1024), 0), 1023)))"


_CODES = ", ".join(f"('{c}', {a}, {b})" for c, (a, b) in G.SEGMENT_CODES.items())


@query("rfm_digits_from_parameters", f"""WITH f AS (SELECT c_nationkey % 5 AS region_id, o_custkey AS driver_id, date_diff('day', max(o_orderdate)::DATE, DATE '2001-08-02')::DOUBLE AS recency,
 round(count(*) / count(DISTINCT date_trunc('week', o_orderdate))::DOUBLE, 2) AS frequency, -sum(-o_totalprice / 100) / 100 AS monetary FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
d AS (SELECT region_id, driver_id, (3 - {_digit_sql('recency', 0)}) || '' || {_digit_sql('frequency', 1)} || '' || {_digit_sql('monetary', 2)} AS code FROM f)
SELECT region_id, driver_id, code, s3::INT AS segment_3, s5::INT AS segment_5 FROM d LEFT JOIN (VALUES {_CODES}) c(code, s3, s5) USING (code)""")
def rfm_digits(spark, sf):
    """Digits, codes and segments of all users under given parameters; one region has none."""
    rows = [(region, *[v for p in parts for v in p]) for region, parts in _CUTS.items()]
    fields = ", ".join(f"{f}_low double, {f}_high double, {f}_cuts array<int>" for f in G.FIGURES)
    out = G.with_digits(rfm_frame(spark, sf), spark.createDataFrame(rows, f"region_id bigint, {fields}"))
    return out.select("region_id", "driver_id", "code", "segment_3", "segment_5")


# --- goal scoring ---------------------------------------------------------

def goal_frame(spark, sf):
    o = table(spark, sf, "orders")
    start = F.lit("2000-01-01").cast("date")
    context = X.activity_context(o.select(F.col("o_custkey").alias("driver_id"), "o_orderdate"), "driver_id", "o_orderdate", "2000-01-01")
    fact = o.filter("o_orderdate >= '2000-01-01'").groupBy(F.col("o_custkey").alias("driver_id")).agg(F.count("*").alias("fact_rides"))
    setups = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("driver_id"), (F.col("c_custkey") % 6).alias("id"), (F.col("c_custkey") % 2).alias("split_no"), start.alias("period_date_start"),
        (F.lit(2) + F.col("c_custkey") % 2).cast("int").alias("target_x"), F.lit(500.0).alias("budget"), F.col("c_acctbal"),
    ).join(fact, "driver_id", "left").fillna(0, ["fact_rides"])
    return S.training_frame(S.goal_setups(setups), context)


GOAL_FEATURES = ["days_since_last", "days_since_first", "trips", "c_acctbal", "target_x"]

_GOAL_SQL = """c AS (SELECT o_custkey, min(o_orderdate)::DATE AS f, max(o_orderdate)::DATE AS l, count(*) AS trips FROM orders WHERE o_orderdate < '2000-01-01' GROUP BY 1),
fc AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderdate >= '2000-01-01' GROUP BY 1),
su AS (SELECT c_custkey AS driver_id, c_custkey % 6 AS id, c_custkey % 2 AS split_no, (2 + c_custkey % 2)::INT AS target_x, coalesce(n, 0) AS fact_rides FROM customer LEFT JOIN fc ON o_custkey = c_custkey),
ok AS (SELECT id FROM su GROUP BY 1 HAVING count(DISTINCT split_no) < 4 AND count(DISTINCT driver_id) > 50)"""


@query("goal_training_frame", f"""WITH {_GOAL_SQL}
SELECT id, driver_id, fact_rides, coalesce(trips, 0) AS trips, coalesce(greatest(date_diff('day', l, DATE '2000-01-01'), 0), -1)::INT AS days_since_last, coalesce(greatest(date_diff('day', f, DATE '2000-01-01'), 0), -1)::INT AS days_since_first,
 (fact_rides >= target_x)::INT AS reached, (fact_rides > 0)::INT AS activated FROM su LEFT JOIN c ON o_custkey = driver_id WHERE id IN (SELECT id FROM ok)""")
def goal_training(spark, sf):
    return goal_frame(spark, sf).select("id", "driver_id", "fact_rides", "trips", "days_since_last", "days_since_first", "reached", "activated")


@query("undersampled_training_rows", f"""WITH {_GOAL_SQL}, g AS (SELECT (fact_rides >= target_x)::INT AS reached FROM su WHERE id IN (SELECT id FROM ok)),
rc AS (SELECT reached, count(*) AS n FROM g GROUP BY 1)
SELECT reached, least(n, (SELECT min(n) FROM rc) * 2)::BIGINT AS n, least(n, (SELECT min(n) FROM rc) * 2)::BIGINT AS users FROM rc""")
def undersample(spark, sf):
    g = S.undersampled(goal_frame(spark, sf), "reached", "driver_id", 0.5)
    return g.groupBy("reached").agg(F.count("*").alias("n"), F.countDistinct("driver_id").alias("users"))


def scored_goals(spark, sf):
    g = stable_checkpoint(goal_frame(spark, sf))
    train, test = S.train_test(g, "driver_id")
    model = S.calibrated_forest(S.undersampled(train, "reached", "driver_id"), GOAL_FEATURES, "reached", "driver_id", folds=5, trees=500, depth=3)
    return model, S.calibrated_scores(model, test, GOAL_FEATURES)


@query("goal_backtest_by_setup")
def goal_backtest(spark, sf):
    """Calibrated forest on 70 percent of users, fact against expectation on the rest."""
    return rounded(S.backtest(scored_goals(spark, sf)[1], "id"), 4)


@query("goal_scenarios")
def goal_scenarios(spark, sf):
    g = stable_checkpoint(goal_frame(spark, sf))
    model = S.calibrated_forest(g, GOAL_FEATURES, "reached", "driver_id", folds=5, trees=500, depth=3)
    scen = S.scenario_grid(g.drop("target_x", "budget"), [2, 3, 5], [300.0, 500.0])
    return rounded(S.expected_outcome(S.calibrated_scores(model, scen, GOAL_FEATURES), ["target_x", "budget"]), 4)


_SCORED = "sc AS (SELECT c_nationkey % 3 AS grp, least(greatest(c_acctbal / 10000, 0), 1) AS score, (c_custkey % 3 = 0)::INT AS label FROM customer)"


def scored_customers(spark, sf):
    return table(spark, sf, "customer").select(
        (F.col("c_nationkey") % 3).alias("grp"), F.least(F.greatest(F.col("c_acctbal") / 10000, F.lit(0.0)), F.lit(1.0)).alias("score"), (F.col("c_custkey") % 3 == 0).cast("int").alias("label")
    )


_ROC = f"""{_SCORED}, v AS (SELECT grp, score, sum(label)::DOUBLE AS p, sum(1 - label)::DOUBLE AS q FROM sc GROUP BY 1, 2),
rc AS (SELECT *, coalesce(sum(p) OVER (PARTITION BY grp ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pb, coalesce(sum(q) OVER (PARTITION BY grp ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS qb,
 sum(p) OVER (PARTITION BY grp) AS np, sum(q) OVER (PARTITION BY grp) AS nq FROM v)"""


@query("balanced_score_threshold", f"""WITH {_ROC} SELECT grp, arg_min(score, (round(abs((np - pb) / np - (1 - (nq - qb) / nq)), 12), score)) AS threshold FROM rc GROUP BY 1""")
def threshold(spark, sf):
    return K.optimal_threshold(scored_customers(spark, sf), ["grp"], "score", "label")


@query("classification_quality", f"""WITH {_ROC}, a AS (SELECT grp, sum(p * (qb + q / 2)) / any_value(np * nq) AS auc, max(CASE WHEN (np - pb) / np >= 0.7 THEN (np - pb) / (np - pb + nq - qb) END) AS bp FROM rc GROUP BY 1),
m AS (SELECT grp, count(*) FILTER (score >= 0.5 AND label = 1)::DOUBLE AS tp, count(*) FILTER (score >= 0.5 AND label = 0)::DOUBLE AS fp, count(*) FILTER (score < 0.5 AND label = 1)::DOUBLE AS fn, count(*) FILTER (score < 0.5 AND label = 0)::DOUBLE AS tn FROM sc GROUP BY 1)
SELECT grp, round(tp/(tp+fp), 6) AS "precision", round(tp/(tp+fn), 6) AS recall, round(2*tp/(2*tp+fp+fn), 6) AS f1, round((tp+tn)/(tp+fp+fn+tn), 6) AS accuracy, round(auc, 6) AS auc, round(2*auc-1, 6) AS gini, round(bp, 6) AS best_precision FROM m JOIN a USING (grp)""")
def quality(spark, sf):
    return rounded(S.classification_metrics(scored_customers(spark, sf), ["grp"], "label", "score"))


@query("regression_quality", """
SELECT l_returnflag, round(1 - sum(pow(y - f, 2)) / sum(pow(y - m, 2)), 6) AS r2, round(avg(pow(y - f, 2)), 3) AS mse, round(avg(abs(y - f)), 6) AS mae, round(avg(abs((y - f) / y)) * 100, 6) AS mape FROM
(SELECT l_returnflag, l_extendedprice AS y, l_quantity * 2000.0::DOUBLE AS f, avg(l_extendedprice) OVER (PARTITION BY l_returnflag) AS m FROM lineitem) GROUP BY 1""")
def regression_quality(spark, sf):
    li = table(spark, sf, "lineitem").select("l_returnflag", F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 2000.0).alias("f"))
    out = S.regression_metrics(li, ["l_returnflag"], "y", "f")
    return out.select("l_returnflag", r("r2").alias("r2"), r("mse", 3).alias("mse"), r("mae").alias("mae"), r("mape").alias("mape"))


@query("forest_regression_importances")
def forest_importances(spark, sf):
    """Cross-validated regression forest on setup aggregates: impurity and permutation importances."""
    o = table(spark, sf, "orders")
    agg = o.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("label"), F.count("*").alias("orders"), F.avg("o_totalprice").alias("avg_bill"), F.countDistinct("o_orderpriority").alias("kinds"))
    feats = ["orders", "avg_bill", "kinds"]
    data = stable_checkpoint(agg.select("o_custkey", "label", *[F.col(f).cast("double").alias(f) for f in feats]))
    model = S.forest_grid_search(data, feats, "label", trees=(100, 500), depths=(3, 4), folds=5)
    best = model.stages[-1].bestModel
    impurity = S.impurity_importances(spark, feats, best).withColumn("kind", F.lit("impurity"))
    perm = S.permutation_importances(model, data, feats, "label", "o_custkey").withColumn("kind", F.lit("permutation"))
    return rounded(impurity.unionByName(perm), 4)


# --- ladder model ---------------------------------------------------------

@query("parsed_ladder_json", """
WITH s AS (SELECT p_partkey % 50 AS id, min(p_size)::DOUBLE AS a, max(p_size)::DOUBLE AS b FROM part GROUP BY 1)
SELECT id, 0 AS variant, 5 AS step, a AS payout FROM s UNION ALL SELECT id, 0, 10, b FROM s UNION ALL SELECT id, 1, 3, b FROM s""")
def parsed_ladders(spark, sf):
    s = table(spark, sf, "part").groupBy((F.col("p_partkey") % 50).alias("id")).agg(F.min("p_size").cast("string").alias("a"), F.max("p_size").cast("string").alias("b"))
    text = F.format_string('[{"steps":{"5":%s,"10":%s}},{"steps":{"3":%s}}]', "a", "b", "b")
    return L.parse_ladders(s.withColumn("stairs", text), "stairs", ["id"])


def ladder_inputs(spark, sf):
    li = table(spark, sf, "lineitem")
    facts = li.select(
        F.to_date(F.date_trunc("year", "l_shipdate")).alias("date"), (F.col("l_suppkey") % 4).alias("campaign"), F.col("l_returnflag").alias("segment"), F.col("l_partkey").alias("driver_id"),
        (F.col("l_linenumber") * 5).alias("step"), (F.col("l_extendedprice") / 100).alias("bill"),
    )
    context = li.groupBy(F.to_date(F.date_trunc("year", "l_shipdate")).alias("date")).agg(
        F.countDistinct("l_partkey").alias("active_drivers"), F.avg(F.when(F.col("l_quantity") > 25, F.col("l_extendedprice") / 100)).alias("avg_price_long"),
        F.avg(F.when(F.col("l_quantity") <= 25, F.col("l_extendedprice") / 100)).alias("avg_price_short"),
    )
    ladders = L.filled_ladder(
        supplier_ladders(spark, sf).withColumn("campaign", F.col("ladder_id") % 4).groupBy("campaign", "step").agg(F.max("payout").alias("payout")), ["campaign"], 41
    )
    return facts, context, ladders


@query("ladder_training_grid", """
WITH f AS (SELECT date_trunc('year', l_shipdate)::DATE AS date, l_suppkey % 4 AS campaign, l_returnflag AS segment, l_partkey AS driver_id, l_linenumber * 5 AS step, l_extendedprice / 100 AS bill FROM lineitem),
a AS (SELECT date, campaign FROM f GROUP BY 1, 2 HAVING count(driver_id) > 50), s AS (SELECT DISTINCT date, campaign, segment FROM f),
p AS (SELECT date, campaign, segment, step, count(DISTINCT driver_id) AS drivers, sum(bill) AS bill FROM f GROUP BY 1, 2, 3, 4)
SELECT s.date, s.campaign, s.segment, g.step, coalesce(p.drivers, 0) AS drivers, round(coalesce(p.bill, 0), 4) AS bill, (coalesce(p.drivers, 0) > 0)::INT AS stops
FROM s JOIN a USING (date, campaign), (SELECT unnest(range(1, 41))::INT AS step) g LEFT JOIN p ON p.date = s.date AND p.campaign = s.campaign AND p.segment = s.segment AND p.step = g.step""")
def ladder_grid(spark, sf):
    facts, context, ladders = ladder_inputs(spark, sf)
    return rounded(LM.training_grid(facts, ladders, context, 40).select("date", "campaign", "segment", "step", "drivers", "bill", "stops"), 4)


@query("long_share_regression_line", """
SELECT round(regr_slope(s, l_linenumber), 8) AS slope, round(regr_intercept(s, l_linenumber), 8) AS intercept FROM (SELECT l_linenumber, (l_quantity > 25)::INT AS s FROM lineitem)""")
def long_line(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("step"), (F.col("l_quantity") > 25).cast("int").alias("share"))
    return rounded(LM.long_share_line(li, "share"), 8)


@query("ladder_scenario_outcome")
def ladder_outcome(spark, sf):
    """Step models fitted on the training grid, scored on every campaign's ladder, against the facts of the last year."""
    facts, context, ladders = ladder_inputs(spark, sf)
    grid = stable_checkpoint(LM.training_grid(facts, ladders, context, 40))
    models = LM.fit_step_models(grid, trees=100, depth=6)
    share = LM.long_share_line(grid.withColumn("share", F.least(F.lit(1.0), F.col("step") / 100.0)), "share")
    last = context.filter(F.col("date") == context.agg(F.max("date").alias("m")).select("m").scalar())
    last = last.withColumns({"commission_share": F.lit(0.2), "other_incentives": F.lit(0.0)})
    scen = L.scenario_rows(supplier_ladders(spark, sf).withColumn("campaign", F.col("ladder_id") % 4).groupBy("campaign", "step").agg(F.max("payout").alias("payout")), ["campaign"], last, (1, 40))
    scored = LM.score_scenarios(models, scen, share)
    fact = facts.join(last.select("date"), "date", "left_semi").groupBy("campaign").agg(
        F.sum("step").alias("rides"), F.countDistinct("driver_id").alias("drivers"), F.sum("bill").alias("gmv")
    )
    return rounded(LM.control_report(scored, fact, ["campaign"]), 4)


# --- forecast -------------------------------------------------------------

@query("daily_series_forecast")
def forecast_daily(spark, sf):
    """Seven-day forecast of events per type with weekly seasonality, a lagged regressor and a holiday flag."""
    from curbside.operators.temporal import event_flags, lagged

    ev = table(spark, sf, "events")
    spec = FC.ForecastSpec("day", 7, {7.0: 2}, changepoints=3, regressors=("v_sh_7",), flags=("holiday",))
    series = FC.with_horizon(FC.history(ev, ["event_type"], "ts", "day"), ["event_type"], spec)
    reg = ev.groupBy("event_type", F.date_trunc("day", "ts").alias("ds")).agg(F.avg("value").alias("v"))
    series = lagged(FC.load_regressors(series, reg, ["v"], ["event_type"]), ["event_type"], "ds", {"v": 7})
    cal = spark.createDataFrame([("holiday", "2024-01-01", "2024-01-09")], "flag string, date_from string, date_to string")
    feats = FC.features(event_flags(series, "ds", cal, ["holiday"]), ["event_type"], spec)
    out = FC.published(FC.forecast(feats, ["event_type"], spec), ["event_type"], spec)
    return out.drop("created_date")


@query("hourly_series_forecast")
def forecast_hourly(spark, sf):
    spec = FC.SHORT_HOURLY_VIEWS
    ev = table(spark, sf, "events")
    series = FC.with_horizon(FC.history(ev, ["event_type"], "ts", "hour"), ["event_type"], spec)
    fitted = FC.forecast(FC.features(series, ["event_type"], spec), ["event_type"], spec)
    return FC.published(fitted, ["event_type"], spec).drop("created_date")


@query("weather_history_and_forecast", """
WITH h AS (SELECT ts::DATE AS ds, sum(value) / 10 AS v FROM events WHERE event_type='error' AND ts < '2024-01-20' GROUP BY 1), l AS (SELECT ts::DATE AS ds, sum(value) / 10 AS v FROM events WHERE event_type='error' AND ts >= '2024-01-19' GROUP BY 1),
b AS (SELECT * FROM h WHERE ds < (SELECT max(ds) FROM h) UNION ALL SELECT * FROM l)
SELECT ds, round(v, 6) AS precipitation_volume, CASE WHEN v < 1 THEN 0 WHEN v < 20 THEN 1 ELSE 2 END AS precipitation_band FROM b""")
def weather(spark, sf):
    ev = table(spark, sf, "events").filter("event_type = 'error'").select(F.col("ts").alias("ds"), (F.col("value") / 10).alias("precipitation_volume"))
    latest = ev.filter("ds >= '2024-01-19'").groupBy(F.to_date("ds").alias("ds")).agg(F.sum("precipitation_volume").alias("precipitation_volume"))
    return rounded(FC.weather_daily(ev.filter("ds < '2024-01-20'"), latest))


# --- course-work models ---------------------------------------------------

@query("regularised_logistic_regression")
def logistic(spark, sf):
    """Two-feature logistic regression with and without L2, with the AUC of each."""
    c = table(spark, sf, "customer").select(F.col("c_acctbal").alias("a"), F.col("c_nationkey").cast("double").alias("b"), (F.col("c_acctbal") + F.col("c_custkey") % 7 * 500 > 5000).cast("double").alias("label"))
    data = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(c)
    out = None
    for reg in (0.0, 0.1):
        m = LogisticRegression(regParam=reg, standardization=True).fit(data)
        scored = m.transform(data).select("label", vector_to_array("probability")[1].alias("p"))
        part = K.auc(scored, [], "p", "label").withColumns({"reg": F.lit(reg), "w0": F.lit(float(m.coefficients[0])), "w1": F.lit(float(m.coefficients[1]))})
        out = part if out is None else out.unionByName(part)
    return rounded(out, 4)


def heaviest_words(counted, hashed, weights, top=10):
    """The words whose features weigh most; a word's feature is read from its own vector by expressions."""
    known = counted.sparkSession.createDataFrame([(int(i), float(weights[i])) for i in weights.nonzero()[0]], "feature int, weight double")  # at most 2^18 rows
    vocabulary = counted.select(F.explode("words").alias("word")).distinct().select("word", F.array("word").alias("words"))
    found = hashed.transform(vocabulary).select("word", F.unwrap_udt("tf")["indices"][0].alias("feature")).join(known, "feature").select("word", "weight")
    return found.orderBy(F.desc(F.abs("weight")), "word").limit(top)


@query("text_classifier_top_words")
def text_svm(spark, sf):
    """TF-IDF over whole document texts, linear SVM chosen by cross-validation, ten heaviest words.

    Every word counts: words are hashed to 2^18 features, so no vocabulary is cut or collected. Words of one feature
    share its weight.
    """
    d, l = tables(spark, sf, "documents", "labels")
    text = d.join(l, "doc_id").select("doc_id", "text", F.col("quality").cast("double").alias("label"))
    words, hashed = Tokenizer(inputCol="text", outputCol="words"), HashingTF(inputCol="words", outputCol="tf", numFeatures=1 << 18)
    counted = hashed.transform(words.transform(spread(text, "doc_id").sortWithinPartitions("doc_id"))).select("label", "words", "tf")
    counted = stable_checkpoint(counted)  # texts are split and hashed once; the search caches labels and features alone
    svm = LinearSVC(maxIter=15)
    cv = CrossValidator(
        estimator=svm, estimatorParamMaps=ParamGridBuilder().addGrid(svm.regParam, [0.01, 0.1]).build(), evaluator=BinaryClassificationEvaluator(), numFolds=3, seed=1,
        parallelism=2,
    )
    tf = counted.select("label", "tf")
    scaled = IDF(inputCol="tf", outputCol="features").fit(tf).transform(tf).select("label", "features")
    weights = cv.fit(scaled).bestModel.coefficients.toArray()
    return rounded(heaviest_words(counted, hashed, weights), 6)


@query("principal_components")
def pca(spark, sf):
    """Explained variance per component of the embeddings and the first count that reaches 90 percent."""
    e = table(spark, sf, "embeddings").select(array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    m = PCA(k=32, inputCol="v", outputCol="p").fit(e)
    var = spark.createDataFrame([(i + 1, float(v)) for i, v in enumerate(m.explainedVariance)], "component int, variance double")
    run = F.sum("variance").over(Window.orderBy("component"))  # one row per component
    return rounded(var.withColumn("cumulative", run).withColumn("reaches_90", F.col("cumulative") >= 0.9), 6)


@query("decision_tree_importances")
def tree(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_totalprice").alias("price"), F.month("o_orderdate").cast("double").alias("month"), (F.col("o_custkey") % 10).cast("double").alias("seg"), (F.col("o_totalprice") > 250000).cast("double").alias("label"))
    feats = ["price", "month", "seg"]
    m = Pipeline(stages=[VectorAssembler(inputCols=feats, outputCol="features"), DecisionTreeClassifier(maxDepth=4, seed=1)]).fit(o)
    return rounded(S.impurity_importances(spark, feats, m.stages[-1]), 6)


@query("basket_change_around_date", """
WITH p AS (SELECT o_custkey, arg_max(o_totalprice, (o_orderdate, o_orderkey)) FILTER (o_orderdate < '1999-01-01') AS before_, arg_min(o_totalprice, (o_orderdate, o_orderkey)) FILTER (o_orderdate >= '1999-01-01') AS after_, count(*) AS pe FROM orders GROUP BY 1)
SELECT count(*) AS companies, round(sum(before_), 2) AS price_before, round(sum(after_), 2) AS price_after, round(sum(after_) / sum(before_) - 1, 6) AS change FROM p WHERE pe < 12 AND before_ IS NOT NULL AND after_ IS NOT NULL""")
def basket(spark, sf):
    o = table(spark, sf, "orders")
    when, early = F.struct("o_orderdate", "o_orderkey"), F.col("o_orderdate") < "1999-01-01"
    p = o.groupBy("o_custkey").agg(
        F.max_by("o_totalprice", F.when(early, when)).alias("before"), F.min_by("o_totalprice", F.when(~early, when)).alias("after"), F.count("*").alias("pe")
    ).filter("pe < 12 and before is not null and after is not null")
    return p.agg(
        F.count("*").alias("companies"), r(F.sum("before"), 2).alias("price_before"), r(F.sum("after"), 2).alias("price_after"), r(F.sum("after") / F.sum("before") - 1).alias("change")
    )
