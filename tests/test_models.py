"""Model queries: what their plans hold and what bounded work must leave unchanged."""

import numpy as np
from pyspark.ml.feature import HashingTF
from pyspark.sql import functions as F


def test_heaviest_words_without_python_rows(spark):
    """Words reach their weights by expressions, not by a row-at-a-time function."""
    from workload.models import heaviest_words

    hashed = HashingTF(inputCol="words", outputCol="tf", numFeatures=1 << 18)
    names = [f"wörd{i}" for i in range(40)]
    weights = np.zeros(1 << 18)
    for i, w in enumerate(names[:30]):
        weights[hashed.indexOf(w)] = (-1) ** i * (i + 1) / 10
    out = heaviest_words(spark.createDataFrame([(names[:25],), (names[20:],)], "words array<string>"), hashed, weights, 4)
    assert "EvalPython" not in out._jdf.queryExecution().toString()
    assert [(r.word, r.weight) for r in out.collect()] == [("wörd29", -3.0), ("wörd28", 2.9), ("wörd27", -2.8), ("wörd26", 2.7)]


def test_cell_scores_equal_row_scores(spark, monkeypatch):
    """Forests score cells between their split points; every row gets the score its own values would get."""
    from pyspark.ml.functions import vector_to_array

    from curbside.plans import scoring as S

    rows = spark.range(400).selectExpr("id", "CAST(id % 23 AS double) AS a", "CAST(id * id % 11 - 5 AS int) AS b", "1 AS c", "CAST(id * 7 % 23 + id % 3 > 12 AS int) AS y")
    model = S.calibrated_forest(rows, ["a", "b", "c"], "y", "id", folds=2, trees=7, depth=3)
    cuts = S.split_points([m.stages[-1] for m, _ in model], ["a", "b", "c"])
    assert cuts["a"] and cuts["b"] and cuts["c"] == []
    edges = spark.createDataFrame([(1000 + i, v, b, 1) for i, v in enumerate([*cuts["a"], -1e9, 1e9]) for b in (-5, 0, 5)], "id long, a double, b int, c int")
    wanted: dict = {}
    frame = rows.drop("y").unionByName(edges).withColumns({f: F.col(f).cast("double") for f in "abc"})
    for forest, iso in model:
        raw = forest.transform(frame).withColumn("raw", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")
        for r in iso.setFeaturesCol("raw").setPredictionCol("p").transform(raw).collect():
            wanted[r.id, r.a, r.b] = wanted.get((r.id, r.a, r.b), 0) + r.p / 2
    seen = []
    spread = S.spread
    monkeypatch.setattr(S, "spread", lambda df, *c: (seen.append(df.count()), spread(df, *c))[1])
    got = S.calibrated_scores(model, rows.drop("y").unionByName(edges), ["a", "b", "c"]).collect()
    assert len(got) == 400 + edges.count() and all(abs(r.score - wanted[r.id, r.a, r.b]) < 1e-12 for r in got)
    assert seen and seen[0] < 400


def test_dealt_rows_use_all_cores(spark, partitions):
    """Few small rows still come back as several tasks, the same in every run."""
    from curbside.plans.scoring import dealt

    partitions(8)
    parts = [dealt(spark.range(50).coalesce(1), "id").rdd.glom().collect() for _ in range(2)]
    assert sorted(r.id for p in parts[0] for r in p) == list(range(50))
    assert sum(bool(p) for p in parts[0]) > 2
