"""X3/X4 from stored sketches: merged equals whole within the stated bounds."""
import numpy as np
from pyspark.sql import functions as F

from carecheck.operators import analytics as A
from carecheck.operators import sketches as K
from helpers import rows


def table(spark, n=30_000):
    return spark.range(0, n).select(
        F.col("id").alias("id"), F.when(F.col("id") % 7 > 0, (F.hash("id") % 1000) / 8.0).alias("x"), F.lit(float("nan")).alias("none"),
        F.when(F.col("id") % 3 == 0, "often").otherwise(F.concat(F.lit("v"), F.col("id") % 300)).alias("s"), F.lit(None).cast("string").alias("nothing"))


def stored(spark, tmp_path, df, parts):
    path = f"{tmp_path}/sketches"
    for k in range(parts):
        K.sketch(df.where(F.col("id") % parts == k), f"day-{k}").write.mode("append").parquet(path)
    return spark.read.parquet(path)


def test_merged_numeric_summary_equals_whole(spark, tmp_path):
    df = table(spark)
    merged = K.merge(stored(spark, tmp_path, df, 5))
    got = {r["column_name"]: r for r in rows(K.numeric_summary(merged))}
    want = {r["column_name"]: r for r in rows(A.numeric_summary(df))}
    assert got.keys() == want.keys()
    for c, w in want.items():
        g = got[c]
        assert g["missing_count"] == w["missing_count"] and g["min"] == w["min"] and g["max"] == w["max"]
        for k in ("mean", "std"):
            assert (g[k] is None and w[k] is None) or abs(g[k] - w[k]) <= 1e-9 * max(1, abs(w[k]))
    for c in ("id", "x"):
        v = np.sort(np.array([r[0] for r in df.select(c).where(f"{c} is not null").collect()], dtype=float))
        for k, p in (("q25", 0.25), ("median", 0.5), ("q75", 0.75)):
            low, high = np.searchsorted(v, got[c][k], "left") / len(v), np.searchsorted(v, got[c][k], "right") / len(v)
            assert low - K.RANK_ERROR <= p <= high + K.RANK_ERROR
    assert got["none"]["median"] is None and got["none"]["mean"] is None


def test_merged_categories_and_merging_in_steps(spark, tmp_path):
    df = table(spark)
    parts = stored(spark, tmp_path, df, 4)
    once = K.merge(parts)
    steps = K.merge(K.merge(parts.where("batch < 'day-2'"), "a").unionByName(K.merge(parts.where("batch >= 'day-2'"), "b")))
    for merged in (once, steps):
        summary, top = K.categorical_summary(merged)
        s = {r["column_name"]: r for r in rows(summary)}
        assert abs(s["s"]["unique_values"] - 201) <= 4 and s["s"]["most_common"] == "often" and s["s"]["most_common_count"] == 10_000
        assert s["nothing"]["unique_values"] == 0 and s["nothing"]["most_common"] is None and s["nothing"]["missing_count"] == 30_000
        exact = {r["value"]: r["n"] for r in df.groupBy("s").count().withColumnsRenamed({"s": "value", "count": "n"}).collect()}
        best = [r for r in rows(top) if r["column_name"] == "s"]
        assert [r["n"] for r in best] == sorted(exact.values(), reverse=True)[:5] and all(exact[r["value"]] == r["n"] for r in best)
        assert {r["n_rows"] for r in rows(merged.select("n_rows"))} == {30_000}


def test_empty_batches_and_tables_without_columns_of_a_kind(spark, tmp_path):
    df = table(spark, 100)
    both = K.sketch(df, "a").unionByName(K.sketch(df.limit(0), "b"))
    got = {r["column_name"]: r for r in rows(K.numeric_summary(K.merge(both)))}
    assert got["id"]["max"] == 99 and got["id"]["missing_count"] == 0
    assert rows(K.numeric_summary(K.merge(K.sketch(df.select("s"), "a")))) == []
    assert [r["column_name"] for r in rows(K.numeric_summary(K.merge(K.sketch(df.select("id"), "a"))))] == ["id"]
