"""Per-column quantiles with pandas' linear interpolation.

Exact quantiles use the same three steps at every size; no step moves the data:

1. one scan: each column's count and, from ``percentile_approx``, values a
   little below and above every wanted rank.  The sketch's rank error is at
   most ``n / ACCURACY``, so they bracket the rank;
2. one scan: how many values lie below each bracket, and the values inside it
   as ``groupBy(target, value).count()`` -- a value repeated in a third of all
   rows is one row per task;
3. the counts' prefix sums give the values at the two ranks.  They run over
   ``BINS`` equal slices of each bracket first and then inside the one or two
   slices that hold a rank, so no bracket is gathered in one task.

Step 2's counts prove each bracket right; one that is not (the sketch's bound
is a guarantee, so none is expected) is widened to the whole column.

``approx`` returns the sketch's values from a single aggregate.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from carecheck.functions import exprs as E

QSCHEMA = "column_name string, prob double, value double"
ACCURACY = 10_000
MARGINS = (4 / ACCURACY, 0.02, 1.0)  # of the rank; the first that also covers 2 of n ranks
BINS = 1024


def exact_quantiles(df: DataFrame, columns: list[str], probs: list[float]) -> DataFrame:
    """``len(columns) x len(probs)`` rows (none for a column without values)."""
    spark = df.sparkSession
    types = {f.name: f.dataType for f in df.schema.fields}
    vals = {c: E.clean(c, types[c]).cast("double") for c in columns}
    if not columns or not probs:
        return spark.createDataFrame([], QSCHEMA)
    marks = sorted({min(1.0, max(0.0, p + s * m)) for p in probs for m in MARGINS for s in (-1, 1)})
    sketch = F.array(*[F.lit(float(x)) for x in marks])
    one = df.agg(*[x for i, c in enumerate(columns) for x in (
        F.count(vals[c]).alias(f"n{i}"), F.percentile_approx(vals[c], sketch, ACCURACY).alias(f"s{i}"),
        F.min(vals[c]).alias(f"l{i}"), F.max(vals[c]).alias(f"h{i}"))]).first()
    targets = []
    for i, c in enumerate(columns):
        n = one[f"n{i}"]
        if not n:
            continue
        at = dict(zip(marks, one[f"s{i}"]))
        m = next(m for m in MARGINS if m >= 3 / ACCURACY + 2 / n or m == MARGINS[-1])
        for p in map(float, probs):
            h = (n - 1) * p
            low, high = max(0.0, p - m), min(1.0, p + m)
            targets.append({"column": c, "prob": p, "h": h, "whole": (one[f"l{i}"], one[f"h{i}"]),
                            "lo": at[low] if low > 0 else one[f"l{i}"], "hi": at[high] if high < 1 else one[f"h{i}"]})
    found, todo = {}, targets
    while todo:
        got = _at_ranks(df, vals, todo)
        wrong = []
        for k, t in enumerate(todo):
            if k in got:
                a, b = got[k]
                found[t["column"], t["prob"]] = a + (t["h"] - math.floor(t["h"])) * (b - a)
            elif (t["lo"], t["hi"]) != t["whole"]:
                wrong.append({**t, "lo": t["whole"][0], "hi": t["whole"][1]})
            else:
                raise RuntimeError(f"the input of column {t['column']} changed between scans")
        todo = wrong
    return spark.createDataFrame([(c, p, v) for (c, p), v in found.items()], QSCHEMA)


def _at_ranks(df: DataFrame, vals: dict, targets: list[dict]) -> dict[int, tuple[float, float]]:
    """Target number -> the values at ranks floor(h) and ceil(h); targets whose bracket misses a rank are left out."""
    spark = df.sparkSession
    below = df.agg(*[F.count_if(vals[t["column"]] < F.lit(t["lo"])).alias(f"b{k}") for k, t in enumerate(targets)]).first()
    inside = F.array(*[F.when(vals[t["column"]].between(F.lit(t["lo"]), F.lit(t["hi"])),
                              F.struct(F.lit(k).alias("k"), vals[t["column"]].alias("v"))) for k, t in enumerate(targets)])
    counts = (df.select(F.explode(F.filter(inside, lambda x: x.isNotNull())).alias("x"))
              .groupBy("x.k", "x.v").agg(F.count(F.lit(1)).alias("c")))
    want = spark.createDataFrame([(k, t["lo"], t["hi"], math.floor(t["h"]) - below[f"b{k}"], math.ceil(t["h"]) - below[f"b{k}"])
                                  for k, t in enumerate(targets)], "k int, lo double, hi double, first long, last long")
    want = F.broadcast(want)  # one row per column and probability
    share = F.when(F.col("hi") > F.col("lo"), (F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)).otherwise(0.0)
    binned = counts.join(want, "k").withColumn("bin", F.least(F.floor(F.nanvl(share, F.lit(0.0)) * BINS), F.lit(BINS - 1)).cast("int"))
    bins = binned.groupBy("k", "bin", "first", "last").agg(F.sum("c").alias("c"))
    upto = Window.partitionBy("k").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("start", F.coalesce(F.sum("c").over(upto), F.lit(0)))
    holds = [(F.col("start") <= F.col(r)) & (F.col(r) < F.col("start") + F.col("c")) for r in ("first", "last")]
    bins = bins.where(holds[0] | holds[1]).select("k", "bin", "start")  # two a target at most
    inner = Window.partitionBy("k", "bin").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    rows = (binned.join(F.broadcast(bins), ["k", "bin"])
            .withColumn("start", F.col("start") + F.coalesce(F.sum("c").over(inner), F.lit(0)))
            .where(holds[0] | holds[1]).groupBy("k")
            .agg(F.max(F.when(holds[0], F.col("v"))).alias("a"), F.max(F.when(holds[1], F.col("v"))).alias("b")).collect())
    return {r["k"]: (r["a"], r["b"]) for r in rows if r["a"] is not None and r["b"] is not None}


def approx_quantiles(df: DataFrame, columns: list[str], probs: list[float],
                     accuracy: int = ACCURACY) -> DataFrame:
    spark = df.sparkSession
    if not columns:
        return spark.createDataFrame([], QSCHEMA)
    types = {f.name: f.dataType for f in df.schema.fields}
    pr = F.array(*[F.lit(float(p)) for p in probs])
    one = df.agg(*[F.percentile_approx(E.clean(c, types[c]).cast("double"), pr, accuracy).alias(f"__q{i}")
                   for i, c in enumerate(columns)])
    structs = [F.struct(F.lit(c).alias("column_name"), F.col(f"__q{i}").alias("qs"))
               for i, c in enumerate(columns)]
    return (one.select(F.inline(F.array(*structs)))
            .select("column_name", F.posexplode("qs").alias("__i", "value"))
            .select("column_name", F.get(pr, F.col("__i")).alias("prob"), "value"))


def quantiles(df: DataFrame, columns: list[str], probs: list[float], exact: bool = True) -> DataFrame:
    """Per-column quantiles, exact or from the sketch."""
    return exact_quantiles(df, columns, probs) if exact else approx_quantiles(df, columns, probs)


def quantile_wide(q: DataFrame, probs: dict[str, float]) -> DataFrame:
    """(column_name, prob, value) -> one row per column with named quantiles."""
    aggs = [F.max(F.when(F.col("prob") == p, F.col("value"))).alias(name) for name, p in probs.items()]
    return q.groupBy("column_name").agg(*aggs)
