"""Analytics: quantiles, IQR outliers, trends, summaries (hand-computed values)."""
from datetime import datetime, timedelta

from carecheck.operators import analytics as A
from carecheck.plans.quantiles import quantiles
from helpers import rows


def series(spark, ys):
    base = datetime(2024, 1, 1)
    return spark.createDataFrame([(base + timedelta(days=i), i, float(y)) for i, y in enumerate(ys)],
                                 "ts timestamp, k long, y double")


def test_iqr_and_exact_quantiles(spark):
    df = series(spark, [1, 2, 3, 4, 50])
    q = {r["prob"]: r["value"] for r in rows(quantiles(df, ["y"], [0.25, 0.5, 0.75]))}
    assert q == {0.25: 2.0, 0.5: 3.0, 0.75: 4.0}
    b = rows(A.iqr_bounds(df, ["y"]))[0]
    assert (b["q1"], b["q3"]) == (2.0, 4.0)
    flags = rows(A.outlier_rows(df.select("k", "y"), ["k"]))
    assert flags == [{"k": 4, "column_name": "y"}]


def test_exact_quantiles_with_hot_value(spark):
    # a value holding most rows still splits over range partitions and ranks stay exact
    data = [(float(v),) for v in [7] * 300 + list(range(100))]
    df = spark.createDataFrame(data, "v double")
    q = {r["prob"]: r["value"] for r in rows(quantiles(df, ["v"], [0.1, 0.5, 0.9]))}
    import numpy as np
    arr = np.array([d[0] for d in data])
    assert q == {p: float(np.quantile(arr, p)) for p in (0.1, 0.5, 0.9)}


def test_trend_reference_formula(spark):
    t = rows(A.trends(series(spark, [1, 2, 3, 4, 50]), "ts", ["k"]))
    y = [r for r in t if r["metric"] == "y"][0]
    assert abs(y["slope"] - 10.0) < 1e-9 and y["trend"] == "increasing"
    assert abs(y["confidence"] - (-0.5525)) < 1e-4
    t = rows(A.trends(series(spark, [120, 125, 130, 135, 140]), "ts", ["k"]))
    y = [r for r in t if r["metric"] == "y"][0]
    assert y["trend"] == "increasing" and abs(y["confidence"] - (-1.0)) < 1e-9
    r2 = [r for r in rows(A.trends(series(spark, [120, 125, 130, 135, 140]), "ts", ["k"], r2=True)) if r["metric"] == "y"][0]
    assert abs(r2["confidence"] - 1.0) < 1e-9


def test_trend_skips_short_and_no_time(spark):
    assert rows(A.trends(series(spark, [1, 2]), "ts", ["k"])) == []
    assert rows(A.trends(spark.createDataFrame([(1.0,)], "y double"))) == []


def test_quality_metrics_and_anomalies(spark):
    df = spark.createDataFrame([(1.0, "a"), (None, "b"), (None, None), (4.0, "d"), (100.0, "e")], "x double, s string")
    p = A.Profile(df)
    m = rows(p.metric_values())[0]
    assert abs(m["completeness"] - (1 - 3 / 10)) < 1e-12
    assert m["timeliness"] == 1.0 and m["consistency"] == 1.0
    an = {(r["column_name"], r["anomaly_type"]) for r in rows(p.anomalies())}
    assert ("x", "missing_pattern") in an  # 40 % > 20 %
    sev = {r["metric"]: r["severity"] for r in rows(p.metrics())}
    assert sev["completeness"] == "fair"


def test_timeliness_as_of(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1),)], "t timestamp")
    m = rows(A.Profile(df, as_of="2024-07-01 00:00:00").metric_values())[0]
    assert abs(m["timeliness"] - (1 - 182 / 365)) < 1e-12


def test_categorical_and_numeric_summary(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3), (None, 4)], "c string, n long")
    s, top = A.categorical_summary(df)
    r = rows(s)[0]
    assert (r["unique_values"], r["most_common"], r["most_common_count"], r["missing_count"]) == (2, "a", 2, 1)
    assert [(t["rank"], t["value"]) for t in sorted(rows(top), key=lambda t: t["rank"])] == [(1, "a"), (2, "b")]
    n = rows(A.numeric_summary(df))[0]
    assert (n["mean"], n["median"], n["min"], n["max"], n["q25"], n["q75"]) == (2.5, 2.5, 1.0, 4.0, 1.75, 3.25)


def test_mixed_types(spark):
    df = spark.createDataFrame([("1",), ('"a"',), ('{"k": 1}',), (None,)], "j string")
    m = rows(A.mixed_types(df))
    assert m[0]["n_types"] == 3
    assert abs(rows(A.consistency(df))[0]["consistency"] - 0.5) < 1e-12


def test_exact_quantiles_beyond_the_sketch_with_a_hot_value(spark):
    # more values than the sketch keeps exactly; one value in a third of all rows
    import numpy as np
    rng = np.random.default_rng(7)
    xs = np.concatenate([np.full(70_000, 42.0), rng.normal(40, 15, 130_000).round(6), [np.inf, -np.inf]])  # numpy has no quantile at an infinite end
    df = spark.createDataFrame([(float(x),) for x in xs], "v double").repartition(6)
    probs = [0.01, 0.25, 0.4999, 0.5, 0.75, 0.99]
    got = {r["prob"]: r["value"] for r in rows(quantiles(df, ["v"], probs))}
    for p in probs:
        want = float(np.quantile(xs, p))
        assert got[p] == want or abs(got[p] - want) < 1e-9


def test_a_bracket_that_misses_its_rank_is_widened(spark, monkeypatch):
    from carecheck.plans import quantiles as Q
    monkeypatch.setattr(Q, "MARGINS", (0.5, 1.0))
    monkeypatch.setattr(Q, "ACCURACY", 3)  # a sketch too coarse for its margin
    df = spark.createDataFrame([(float(x * x),) for x in range(500)], "v double").repartition(3)
    got = {r["prob"]: r["value"] for r in rows(Q.quantiles(df, ["v"], [0.1, 0.5]))}
    assert got == {0.1: 49.9 * 49.9 + 0.09, 0.5: 249.5 * 249.5 + 0.25} or all(
        abs(got[p] - v) < 1e-6 for p, v in ((0.1, 2401 + 0.9 * 99), (0.5, 249 ** 2 + 0.5 * 499)))


def test_trend_puts_rows_without_a_time_last(spark):
    base = datetime(2024, 1, 1)
    df = spark.createDataFrame([(None, 100.0)] + [(base + timedelta(days=i), float(i)) for i in (1, 2, 3)], "ts timestamp, y double")
    t = rows(A.trends(df))[0]
    assert (round(t["slope"], 6), t["trend"]) == (29.8, "increasing")


def test_categorical_summary_approx(spark):
    df = spark.createDataFrame([("a",)] * 5 + [("b",)] * 3 + [("c",), (None,)], "c string")
    s, top = A.categorical_summary_approx(df)
    r = rows(s)[0]
    assert (r["unique_values"], r["most_common"], r["most_common_count"], r["missing_count"]) == (3, "a", 5, 1)
    assert [(t["rank"], t["value"], t["n"]) for t in sorted(rows(top), key=lambda t: t["rank"])][:2] == [(1, "a", 5), (2, "b", 3)]
