"""Property tests of the distributed building blocks against plain Python."""
import math

import numpy as np
import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from carecheck.operators.rules import duplicate_count
from carecheck.plans.quantiles import exact_quantiles
from carecheck.plans.rowindex import rank_in_group, with_row_index
from carecheck.plans.running import running_sums
from helpers import rows

SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
small_vals = st.one_of(st.none(), st.sampled_from([0.0, -0.0, 1.5, 7.0, float("nan")]),
                       st.floats(-1e6, 1e6, allow_nan=False, allow_infinity=False))


@SETTINGS
@given(st.lists(st.integers(0, 5), min_size=1, max_size=60), st.integers(1, 7))
def test_row_index_is_dense_in_order(spark, keys, parts):
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k long, uid long")
    out = rows(with_row_index(df, ["k", "uid"], "i", num_partitions=parts))
    expect = {uid: pos for pos, (_, uid) in enumerate(sorted((k, i) for i, k in enumerate(keys)))}
    assert {r["uid"]: r["i"] for r in out} == expect


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from(["a", "b"]), st.integers(0, 3)), min_size=1, max_size=60),
       st.integers(1, 5))
def test_rank_in_group(spark, recs, parts):
    df = spark.createDataFrame([(g, v, i) for i, (g, v) in enumerate(recs)], "g string, v long, uid long")
    out = {r["uid"]: r["x"] for r in rows(rank_in_group(df, "g", ["v", "uid"], "x", num_partitions=parts))}
    for g in {g for g, _ in recs}:
        members = sorted((v, i) for i, (gg, v) in enumerate(recs) if gg == g)
        assert [out[i] for _, i in members] == list(range(len(members)))


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from([None, 1, 2]), small_vals), min_size=0, max_size=40))
def test_duplicates_match_pandas(spark, recs):
    df = spark.createDataFrame(recs, "a long, b double")
    got = duplicate_count(df).first()["n_duplicates"]
    pdf = pd.DataFrame(recs, columns=["a", "b"], dtype=object)
    pdf["b"] = pdf["b"].astype(float)
    assert got == int(pdf.duplicated().sum())


@SETTINGS
@given(st.lists(small_vals, min_size=1, max_size=80))
def test_exact_quantiles_match_numpy(spark, vals):
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    got = {r["prob"]: r["value"] for r in rows(exact_quantiles(df, ["v"], [0.0, 0.1, 0.25, 0.5, 0.77, 0.9, 1.0]))}
    clean = np.array([v for v in vals if v is not None and not math.isnan(v)])
    if len(clean) == 0:
        assert got == {}
        return
    for p, v in got.items():
        assert math.isclose(v, float(np.quantile(clean, p)), rel_tol=1e-9, abs_tol=1e-9)


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(-5, 5)), min_size=1, max_size=60), st.integers(1, 6))
def test_running_sums(spark, recs, parts):
    df = spark.createDataFrame([(t, i, x) for i, (t, x) in enumerate(recs)], "t long, uid long, x long")
    out = {r["uid"]: r["cum_x"] for r in rows(running_sums(df, ["t", "uid"], {"x": F.col("x")}, parts))}
    order = sorted(range(len(recs)), key=lambda i: (recs[i][0], i))
    acc = 0
    for i in order:
        acc += recs[i][1]
        assert out[i] == acc


def test_hot_rows_and_keys_are_dealt_out(spark):
    # a third identical rows, and three distinct keys only: balanced parts, every position once
    from carecheck.plans.rowindex import PART, ranges
    same = spark.range(0, 30_000).selectExpr("CASE WHEN id % 3 = 0 THEN 7 ELSE id END AS k")
    d = ranges(same, ["k"], 8)
    sizes = [r["n"] for r in d.groupBy(PART).agg(F.count("*").alias("n")).collect()]
    assert max(sizes) <= 2 * sum(sizes) / 8 and sum(sizes) == 30_000
    assert d.where("k = 7").select(PART).distinct().count() >= 3
    assert sorted(r["i"] for r in rows(with_row_index(same, ["k"], "i", num_partitions=8))) == list(range(30_000))
    few = spark.range(0, 9000).selectExpr("id % 3 AS k", "id")
    sizes = [r["count"] for r in ranges(few, ["k"], 8).groupBy(PART).count().collect()]
    assert max(sizes) <= 2 * 9000 / 8
    got = {r["id"]: r["x"] for r in rows(rank_in_group(few, "k", ["id"], "x", num_partitions=8))}
    assert got == {i: i // 3 for i in range(9000)}


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from([None, "a", "b", "c"]), st.integers(0, 9)), max_size=50), st.integers(1, 12), st.integers(1, 3))
def test_earlier_rows_across_partitions(spark, recs, parts, back):
    from carecheck.plans.rowindex import earlier_rows, ranges
    df = spark.createDataFrame([(g, v, i) for i, (g, v) in enumerate(recs)], "g string, v long, uid long")
    for group in (None, "g"):
        keys = ["g", "v", "uid"] if group else ["v", "uid"]
        got = {r["uid"]: [p and p["uid"] for p in (r[f"prev{k}"] for k in range(1, back + 1))]
               for r in earlier_rows(ranges(df, keys, parts), ["uid"], back, group).collect()}
        want = {}
        for g in {r[0] for r in recs} if group else [0]:
            ids = [i for _, i in sorted((v, i) for i, (gg, v) in enumerate(recs) if not group or gg == g)]
            want |= {u: [ids[n - k] if n >= k else None for k in range(1, back + 1)] for n, u in enumerate(ids)}
        assert got == want


def test_positions_of_rows_that_hold_maps(spark):
    df = spark.range(0, 60).selectExpr("id % 4 AS k", "map('a', id % 3) AS m", "array(map('b', id % 2)) AS am", "id AS uid")
    got = rows(with_row_index(df, ["k"], "i", num_partitions=5))
    assert sorted(r["i"] for r in got) == list(range(60)) and [r["k"] for r in sorted(got, key=lambda r: r["i"])] == [i // 15 for i in range(60)]


def test_rank_in_group_with_null_group(spark):
    df = spark.createDataFrame([(None, 3, 0), (None, 1, 1), ("a", 2, 2), ("a", 1, 3)], "g string, v long, uid long")
    out = {r["uid"]: r["x"] for r in rows(rank_in_group(df, "g", ["v", "uid"], "x", num_partitions=2))}
    assert out == {1: 0, 0: 1, 3: 0, 2: 1}
