"""Distributions, tests, resampling, power and correction."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from curbside.functions import dist
from curbside.functions.hashing import draw, poisson_weight, salted_split
from curbside.operators import correction as C
from curbside.operators import metrics as M
from curbside.operators import ranks as K
from curbside.operators import resample as B
from curbside.operators import tests as T


@pytest.mark.parametrize("q,df,want", [
    (0.975, 10, 2.2281388519649385), (0.995, 1, 63.65674116287158), (0.9, 2, 1.8856180831641267),
    (0.975, 400, 1.9659123432294), (0.995, 1e7, 2.5758296),
])
def test_t_quantiles(q, df, want):
    assert float(dist.t_ppf([q], [df])[0]) == pytest.approx(want, abs=2e-7 if df > 1e6 else 1e-9)


def test_normal_and_chi_square():
    assert float(dist.norm_ppf([0.975])[0]) == pytest.approx(1.959963984540054, abs=1e-10)
    assert float(dist.norm_two_sided([1.959963984540054])[0]) == pytest.approx(0.05, abs=1e-12)
    assert float(dist.chi2_sf([3.841458820694124], [1.0])[0]) == pytest.approx(0.05, abs=1e-10)
    assert float(dist.chi2_sf([9.487729036781154], [4.0])[0]) == pytest.approx(0.05, abs=1e-10)
    # symmetric case: P(|T| > 0) = 1, and one degree of freedom is Cauchy
    assert float(dist.t_two_sided([1.0], [1.0])[0]) == pytest.approx(0.5, abs=1e-12)


def test_power_solvers():
    # textbook sizes: 64 per arm for d = 0.5 at alpha 5 percent, power 80 percent
    assert float(dist.t_sample_size([0.5], 0.8, 0.05)[0]) == pytest.approx(63.7656, abs=1e-3)
    n = dist.t_sample_size([0.2], 0.9, 0.01)[0]
    assert float(dist.t_detectable_effect([n], [1.0], [0.01], [0.9])[0]) == pytest.approx(0.2, abs=1e-6)
    assert np.isnan(dist.t_sample_size([0.0], 0.8, 0.05)[0])
    z = dist.norm_ppf([0.995])[0] + dist.norm_ppf([0.9])[0]
    assert float(dist.gof_sample_size([0.1], 0.9, 0.01)[0]) == pytest.approx((z / 0.1) ** 2, rel=1e-3)


def test_crc_split_equals_zlib(spark):
    df = spark.range(200).withColumn("s", salted_split("_20210406", "id"))
    for row in df.collect():
        want = "B" if zlib.crc32(f"{row.id}_20210406".encode()) % 100 < 50 else "A"
        assert row.s == want


def test_draws_are_uniform_and_poisson(spark):
    u = draw(3, F.col("id"), F.lit(7))
    d = spark.range(20000).select(u.alias("u"), poisson_weight(u).alias("w"))
    m = d.agg(F.avg("u"), F.var_pop("u"), F.avg("w"), F.var_pop("w")).first()
    assert m[0] == pytest.approx(0.5, abs=0.01) and m[1] == pytest.approx(1 / 12, abs=0.003)
    assert m[2] == pytest.approx(1.0, abs=0.03) and m[3] == pytest.approx(1.0, abs=0.06)
    # draws of two replicates are uncorrelated
    c = spark.range(20000).agg(F.corr(draw(3, F.col("id"), F.lit(1)), draw(3, F.col("id"), F.lit(2)))).first()[0]
    assert abs(c) < 0.03


def test_exact_quantiles_match_numpy_with_hot_key_and_ties(spark):
    rng = random.Random(5)
    rows = [("hot", rng.choice([-3.0, 0.0, 1.5, 2.25, 1e6])) for _ in range(900)] + [("hot", rng.gauss(0, 50)) for _ in range(300)]
    rows += [("small", float(i)) for i in range(7)] + [("one", 4.0), ("null", None), (None, 2.0), (None, 3.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r for r in K.exact_quantiles(df, ["k"], "v", {"p0": 0.0, "p33": 0.33, "p5": 0.5, "p99": 0.99, "p1": 1.0}).collect()}
    for key in ("hot", "small", "one", None):
        v = [x for k, x in rows if k == key]
        for name, q in (("p0", 0), ("p33", 0.33), ("p5", 0.5), ("p99", 0.99), ("p1", 1)):
            assert got[key][name] == pytest.approx(np.quantile(v, q), rel=1e-12)
    assert "null" not in got


def test_registry_counts_match_pandas(spark):
    rng = random.Random(1)
    rows = [(rng.choice([0, 1]), rng.randrange(30), rng.randrange(100), rng.random(), rng.random() < 0.3) for _ in range(2000)]
    df = spark.createDataFrame(rows, "split int, user int, ord int, v double, ok boolean")
    aggs = {
        "users": M.Agg("user", "nunique"), "ok_users": M.Agg("user", "nunique", ("ok",)), "orders": M.Agg("ord", "nunique", ("v > 0.5",)),
        "sum": M.Agg("v", "sum", ("ok",)), "mean": M.Agg("v", "mean"), "n": M.Agg("*", "count", ("ok", "v > 0.9")), "med": M.Agg("v", "median", ("ok",)),
        "hours": M.Agg("v", "sum_hours"), "top": M.Agg("v", "max"),
    }
    pdf = df.toPandas()
    for row in M.aggregate(df, ["split"], aggs).collect():
        p = pdf[pdf.split == row.split]
        assert row.users == p.user.nunique() and row.ok_users == p[p.ok].user.nunique() and row.orders == p[p.v > 0.5].ord.nunique()
        assert row["sum"] == pytest.approx(p[p.ok].v.sum()) and row["mean"] == pytest.approx(p.v.mean()) and row.n == len(p[p.ok & (p.v > 0.9)])
        assert row.med == pytest.approx(p[p.ok].v.median()) and row.hours == pytest.approx(p.v.sum() / 3600) and row.top == p.v.max()


def test_unknown_aggregate_and_estimator_raise(spark):
    df = spark.createDataFrame([(0, 1.0)], "split int, x double")
    with pytest.raises(ValueError):
        M.aggregate(df, ["split"], {"a": M.Agg("x", "mode")})
    with pytest.raises(ValueError):
        T.stat_inference(df, "sign_test", ())


def _ratio(spark, rows):
    df = spark.createDataFrame(rows, "split int, x double, y double, n double")
    return T.ratio_t_test(T.pair_up(T.ratio_stats(df, [])))


def test_ratio_test_against_direct_formula(spark):
    rng = np.random.default_rng(2)
    rows = [(s, float(rng.poisson(5 + s)), float(rng.poisson(10) + 1), 1.0) for s in (0, 1) for _ in range(400)]
    got = _ratio(spark, rows).first()
    parts = []
    for s in (0, 1):
        x, y = (np.array([r[i] for r in rows if r[0] == s]) for i in (1, 2))
        mx, my, n = x.mean(), y.mean(), len(x)
        v = x.var() / my**2 + y.var() * mx**2 / my**4 - 2 * mx / my**3 * np.mean((x - mx) * (y - my))
        parts.append((x.sum() / y.sum(), v, n))
    (r0, v0, n0), (r1, v1, n1) = parts
    assert got.delta == pytest.approx(r1 - r0) and got.se == pytest.approx(math.sqrt(v0 / n0 + v1 / n1))
    assert got.lb < got.delta < got.ub


def test_edge_cases_give_null_p_not_errors(spark):
    assert _ratio(spark, [(0, 1.0, 1.0, 1.0), (0, 2.0, 1.0, 1.0)]).count() == 0  # one split only
    assert _ratio(spark, [(0, 1.0, 0.0, 1.0), (1, 2.0, 1.0, 1.0), (1, 3.0, 1.0, 1.0)]).first().pvalue is None  # zero denominator
    assert _ratio(spark, [(s, 1.0, 1.0, 1.0) for s in (0, 0, 1, 1)]).first().pvalue is None  # constant metric
    empty = spark.createDataFrame([(0, None), (1, None)], "split int, v double")
    assert T.welch_test(T.pair_up(T.value_stats(empty, "v"))).first().pvalue is None  # all null
    assert T.mann_whitney(spark.createDataFrame([(0, 1.0), (1, 1.0)], "split int, v double"), "v").first().pvalue is None  # no spread


def test_rank_test_against_pair_counting(spark):
    rng = random.Random(3)
    a, b = [rng.randrange(12) for _ in range(60)], [rng.randrange(3, 15) for _ in range(45)]
    df = spark.createDataFrame([(0, float(v)) for v in a] + [(1, float(v)) for v in b], "split int, v double")
    got = T.mann_whitney(df, "v").first()
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    assert got.u_0 == pytest.approx(u) and got.u_1 == pytest.approx(len(a) * len(b) - u)
    half = T.mann_whitney(df, "v", alternative="legacy_half").first().pvalue
    assert half == pytest.approx(got.pvalue / 2)


def test_benjamini_hochberg(spark):
    p = [0.01, 0.04, 0.03, None, 0.005, 0.5, 0.04]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(p)], "i int, pvalue double")
    got = {r.i: r.pvalue_adj for r in C.benjamini_hochberg(df, []).collect()}
    known = sorted((v, i) for i, v in enumerate(p) if v is not None)
    m, best, want = len(known), 1.0, {}
    for rank in range(m, 0, -1):
        best = min(best, known[rank - 1][0] * m / rank)
        want[known[rank - 1][1]] = best
    for i, v in want.items():
        assert got[i] == pytest.approx(v)
    assert got[3] is None
    ones = {r.i: r.pvalue_adj for r in C.benjamini_hochberg(df, [], null_as_one=True).collect()}
    assert ones[3] == 1.0


def _units(spark, n=300):
    return spark.range(n).select(
        (F.col("id") % 2).alias("split"), F.col("id").alias("unit"), (F.hash("id") % 100 + 100).cast("double").alias("x"),
        (F.pmod(F.hash(F.col("id") + 1), F.lit(9)) + 1).cast("double").alias("y"), F.lit(1.0).alias("n"),
    )


def test_resampling_does_not_depend_on_partitioning(spark, partitions):
    seen = []
    for n in (1, 8, 50):
        partitions(n)
        rows = _units(spark).repartition(n)
        boot = B.bootstrap_ratio(rows, "x", "y", "unit", reps=40).select("delta", "lb", "ub").first()
        sample = sorted(r.unit for r in B.exact_sample(rows, ["split"], "unit", 0.5, 40).collect())
        rate = B.simulated_rate(rows, "t_test_ratio", "unit", 30, keys=[]).first().rate
        seen.append((tuple(round(v, 10) for v in boot), tuple(sample), rate))
    assert seen[0] == seen[1] == seen[2]
    assert len(seen[0][1]) == 80


def test_false_positive_rate_is_near_alpha(spark):
    rows = _units(spark, 2000)
    got = B.half_split_rate(rows, "unit", 600, seed=9).first()
    # 99.9 percent binomial interval around 5 percent
    assert abs(got.rate - 0.05) < 3.3 * math.sqrt(0.05 * 0.95 / 600)


def test_bucket_limit(spark):
    limit = lambda n: spark.range(1).select(M.bucket_limit(spark.range(n), 1000, 500, 1000).alias("b")).first().b
    assert [limit(n) for n in (0, 1, 3, 900, 1500, 5000)] == [1, 1, 1, 450, 750, 1000]


def test_bucket_limit_is_per_experiment(spark):
    df = spark.range(10_300).selectExpr("IF(id < 300, 'small', 'large') AS k", "id")
    got = {r.k: r.l for r in M.with_bucket_limit(df, 1000, 500, 1000, ["k"]).groupBy("k").agg(F.first("__limit").alias("l")).collect()}
    assert got == {"small": 150, "large": 1000}


@pytest.mark.parametrize("estimator", ["t_test", "mann_whitney_test"])
def test_evaluate_with_value_estimators(spark, estimator):
    from curbside.plans.experiments import evaluate

    df = spark.range(4000).selectExpr("id % 2 AS split", "id AS user", "id % 7 + (id % 2) AS v")
    spec = M.ExperimentSpec("split", "user", (M.Metric("v", M.Agg("v", "sum"), M.Agg("user", "nunique"), M.Agg("user", "nunique"), estimator=estimator),), {"drivers": M.Agg("user", "nunique")})
    row = evaluate(df, spec).filter("metric = 'v'").first()
    assert row.pvalue is not None and row.pvalue < 0.05


def test_draws_use_all_bits_of_any_key_and_equal_numpy(spark):
    from curbside.functions.hashing import continued, draw_bits, draw_key, uniforms

    ids = [0, 1, 2**31 - 1, 2**31, 2 * (2**31 - 1), -5, 2**62]  # the third and fifth are equal modulo a Mersenne prime
    rows = spark.createDataFrame([(i, str(i)) for i in ids], "id long, s string")
    got = rows.select("id", draw_bits(4, F.col("id")).alias("a"), draw_bits(4, F.col("id"), F.lit(9).cast("bigint")).alias("b"), draw(4, F.col("id"), F.lit(9)).alias("u"),
                      draw(4, draw_key(F.col("s"), "string"), F.lit(9)).alias("t")).collect()
    assert len({r.u for r in got}) == len(ids) == len({r.t for r in got})
    first = np.array([r.a for r in got], np.int64).view(np.uint64)
    assert continued(9, first).tolist() == [r.b % 2**64 for r in got]
    assert uniforms(continued(9, first)).tolist() == [r.u for r in got]
    # CRC-32 of these texts is the same
    assert zlib.crc32(b"plumless") == zlib.crc32(b"buckeroo")
    pair = spark.createDataFrame([("plumless",), ("buckeroo",)], "s string").select(draw(1, F.col("s"), F.lit(1)).alias("u")).collect()
    assert pair[0].u != pair[1].u


def test_rank_samples_are_uniform_and_exact():
    from curbside.operators.sampling import distinct_ranks

    for n, k in ((10, 3), (10, 5), (10, 8), (10, 10), (10, 12), (1, 1), (7, 0), (0, 0)):
        seen = np.zeros(max(n, 1))
        for sim in range(3000):
            ranks = distinct_ranks(12345, sim, n, k)
            assert len(ranks) == min(n, k) == len(set(ranks.tolist())) and all(0 <= r < n for r in ranks)
            seen[ranks] += 1
        if 0 < k < n:  # every rank equally often: five standard deviations
            p = k / n
            assert np.abs(seen / 3000 - p).max() < 5 * math.sqrt(p * (1 - p) / 3000)


@pytest.mark.parametrize(("bucket", "draws", "part"), [(65_536, 1_000_000, 4_000_000), (16, 90, 50)])
def test_sample_sums_against_numpy(spark, monkeypatch, bucket, draws, part):
    """Sums of the very rows that the ranks name, whatever the buckets, tasks and parts; null keys are a group."""
    from curbside.operators import sampling as S

    for name, v in (("BUCKET", bucket), ("DRAWS", draws), ("PART", part)):
        monkeypatch.setattr(S, name, v)
    data = [("a", i, float(i % 7)) for i in range(101)] + [(None, i, float(i)) for i in range(40)] + [("b", 5, 2.0)]
    rows = spark.createDataFrame([(g, u, v if u % 9 else None) for g, u, v in data], "g string, unit long, v double").repartition(5)
    got = S.sample_sums(rows, "unit", {"v": F.col("v"), "one": F.lit(1)}, [("v", "v")], ["g"], 12, F.floor(F.col("__n") * 0.4), 3, ["v"]).collect()
    plain = {(r.g, r.sim): r for r in got}
    assert set(plain) == {(g, s) for g in ("a", None) for s in range(1, 13)}  # 0.4 of one row is none
    bits = {r.g: r.h for r in rows.select("g", F.xxhash64(F.lit(3).cast("bigint"), "g").alias("h")).distinct().collect()}
    for g in ("a", None):
        own = [(u, v) for k, u, v in data if k == g]
        mean = np.mean([v for u, v in own if u % 9])
        buckets = -(-len(own) // bucket)
        place = {r.u: r.b for r in spark.createDataFrame([(u,) for u, _ in own], "u long").select("u", F.pmod(F.xxhash64("u"), F.lit(buckets)).alias("b")).collect()}
        own.sort(key=lambda x: (place[x[0]], x[0]))
        for sim in range(1, 13):
            chosen = [own[i] for i in S.distinct_ranks(bits[g] % 2**64, sim, len(own), int(len(own) * 0.4))]
            v = np.array([v - mean if u % 9 else 0.0 for u, v in chosen])
            r = plain[g, sim]
            assert (r.rows, r.one) == (len(chosen), len(chosen)) and r.v == pytest.approx(v.sum()) and r.v_v == pytest.approx((v * v).sum()) and r.v_mean == pytest.approx(mean)


def test_replicate_sums_against_numpy(spark):
    """Units with several rows, null values, a group without values, a null key; no row is multiplied by the replicates."""
    from curbside.operators import weighted_medians as Wm

    data = [("a", i % 2, i % 70, float(i % 11) if i % 9 else None) for i in range(300)] + [(None, 0, 3, None), (None, 0, 4, None)]
    rows = spark.createDataFrame(data, "k string, split long, unit long, v double").repartition(4)
    out = B.replicate_sums(rows, "unit", ["v"], ["k"], 30, 5)
    assert "Generate" not in out._jdf.queryExecution().toString()
    got = {(r.k, r.split, r.rep): (r.w, r.v) for r in out.collect()}
    bits = {r.unit: r.h for r in rows.select("unit", F.xxhash64(F.lit(5).cast("bigint"), "unit").alias("h")).distinct().collect()}
    w = {u: Wm.weights(np.array([h], np.int64).view(np.uint64), 30)[0] for u, h in bits.items()}
    assert len(got) == 3 * 30
    for (k, split, rep), (n, v) in got.items():
        own = [(w[u][rep - 1], x) for key, s, u, x in data if (key, s) == (k, split)]
        assert n == sum(x for x, _ in own)
        assert v is None if k is None else v == pytest.approx(sum(x * y for x, y in own if y is not None))


def test_simulated_samples_do_not_depend_on_the_bucket(spark, monkeypatch):
    """Rows are numbered by unit, as the SQL of the simulations numbers them, however many buckets a group has."""
    from curbside.operators import sampling as S

    rows = spark.range(300).selectExpr("id % 2 AS split", "id * 7919 % 1009 AS unit", "CAST(id % 5 = 0 AS int) AS hit").repartition(5)
    whole = B.simulated_rate(rows, "chi2", "unit", 20, 0.3, 500, [], "hit").first()
    own = {s: sorted((r.unit, r.hit) for r in rows.collect() if r.split == s) for s in (0, 1)}
    bits = {r.split: r.h for r in rows.select("split", F.xxhash64(F.lit(1).cast("bigint"), "split").alias("h")).distinct().collect()}
    monkeypatch.setattr(S, "BUCKET", 16)
    assert B.simulated_rate(rows, "chi2", "unit", 20, 0.3, 500, [], "hit").first() == whole
    for r in S.sample_sums(rows, "unit", {"hit": F.col("hit")}, [], ["split"], 20, F.lit(45), by_unit=True).collect():
        assert r.hit == sum(own[r.split][i][1] for i in S.distinct_ranks(bits[r.split] % 2**64, r.sim, 150, 45))


def test_half_sums_against_numpy(spark, monkeypatch):
    from curbside.functions.hashing import continued, uniforms
    from curbside.operators import sampling as S

    monkeypatch.setattr(S, "STEP", 5)
    monkeypatch.setattr(S, "GROUPS", 1)
    rows = spark.range(90).selectExpr("CAST(id % 3 AS string) AS k", "id AS unit", "CAST(id AS double) AS v", "1.0D AS n").repartition(4)
    bits = {r.unit: r.h for r in rows.select("unit", F.xxhash64(F.lit(2).cast("bigint"), "unit").alias("h")).collect()}
    got = {(r.k, r.sim, r.split): r for r in S.half_sums(rows, "unit", ["v", "n"], [("v", "v")], ["k"], 13, 2).collect()}
    for k in range(3):
        for sim in range(1, 14):
            a = [u for u in range(90) if u % 3 == k and float(uniforms(continued(sim, np.uint64(bits[u] % 2**64)))) < 0.5]
            b = [u for u in range(90) if u % 3 == k and u not in a]
            for half, units in (("A", a), ("B", b)):
                r = got[str(k), sim, half]
                assert (r.rows, r.n, r.v, r.v_v) == (len(units), len(units), sum(units), sum(u * u for u in units))


@pytest.mark.parametrize(("leaf", "bins"), [(20_000, 64), (5, 4)])
def test_replicate_medians_against_numpy(spark, monkeypatch, leaf, bins):
    """Ties, one heavy value, a unit with several rows, a null key; bins are cut again until a leaf is small."""
    from curbside.operators import weighted_medians as Wm

    monkeypatch.setattr(Wm, "LEAF", leaf)
    monkeypatch.setattr(Wm, "BINS", bins)
    monkeypatch.setattr(Wm, "STEP", 7)
    monkeypatch.setattr(Wm, "OPEN", 1)
    rng = random.Random(leaf)
    data = [("a", rng.randrange(60), rng.choice([0.0, 1.0, rng.gauss(0, 5)])) for _ in range(200)] + [(None, u, 3.0) for u in range(20)] + [("c", 1, 2.0), ("c", 2, 8.0)]
    rows = spark.createDataFrame(data, "k string, unit long, v double").repartition(3)
    bits = {r.unit: r.h for r in rows.select("unit", F.xxhash64(F.lit(6).cast("bigint"), "unit").alias("h")).distinct().collect()}
    got = {(r.k, r.rep): r.v for r in Wm.replicate_medians(rows, "v", "unit", ["k"], 25, 6).collect()}
    w = {u: Wm.weights(np.array([h], np.int64).view(np.uint64), 25)[0] for u, h in bits.items()}
    for k in ("a", None, "c"):
        for rep in range(1, 26):
            values = [v for g, u, v in data if g == k for _ in range(int(w[u][rep - 1]))]
            assert got.pop((k, rep), None) == (pytest.approx(float(np.median(values))) if values else None)
    assert not got
    assert Wm.replicate_medians(rows.limit(0), "v", "unit", ["k"], 5, 6).collect() == []


def test_row_ranks_equal_a_window(spark, partitions):
    """One key with most rows over many ranges, null keys, descending order with ties told apart."""
    rng = random.Random(11)
    rows = [(rng.choice(["hot"] * 6 + ["a", None]), rng.randrange(5), i) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, v int, i int").repartition(4)
    for n in (1, 13):
        partitions(n)
        got = {r.i: (r["rank"], r.n) for r in K.row_ranks(df, ["k"], [F.desc("v"), F.asc("i")], total="n").collect()}
        for key in ("hot", "a", None):
            own = sorted((r for r in rows if r[0] == key), key=lambda r: (-r[1], r[2]))
            assert [got[i] for _, _, i in own] == [(j + 1, len(own)) for j in range(len(own))]
    assert K.row_ranks(df.limit(0), ["k"], [F.asc("i")]).collect() == []
