"""X3, X4 from stored sketches: one row per batch and column that merges without another look at the data.

A batch's sketches come from one scan: counts, mean and sum of squared
deviations, extremes, a KLL sketch for quantiles, an HLL sketch for distinct
values and counters of frequent values.  Merged rows have the same columns, so
days merge into months and months into years.  Bounds: count, missing, mean,
deviation, minimum and maximum are exact; a quantile's rank is off by at most
``RANK_ERROR`` of the rows (KLL of size ``KLL_K``, 99 % confidence); distinct
values by about 2 %; frequent values are exact while a column has fewer than
``TRACKED`` * 3 / 4 distinct ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carecheck.functions import exprs as E
from carecheck.operators.analytics import numeric_columns, string_columns

KLL_K = 800
RANK_ERROR = 0.005
TRACKED = 10_000
STATE = ["column_name", "kind", "n_rows", "missing", "mean", "m2", "low", "high", "quantiles", "distinct", "top"]


def sketch(df: DataFrame, batch: str, strict: bool = True) -> DataFrame:
    """One row per numeric and string column of ``df``: ``batch`` and the columns of ``STATE``."""
    types = {f.name: f.dataType for f in df.schema.fields}
    num, text = numeric_columns(df, strict), string_columns(df)
    aggs, structs = [F.count(F.lit(1)).alias("__rows")], []
    for i, c in enumerate(num):
        v = E.clean(c, types[c]).cast("double")
        aggs += [F.count(v).alias(f"__n{i}"), F.avg(v).alias(f"__a{i}"), F.var_pop(v).alias(f"__v{i}"), F.min(v).alias(f"__l{i}"),
                 F.max(v).alias(f"__h{i}"), F.kll_sketch_agg_double(v, KLL_K).alias(f"__k{i}")]
        structs.append(_state(F.lit(c), F.lit("numeric"), F.col("__rows") - F.col(f"__n{i}"), F.col(f"__a{i}"), F.col(f"__v{i}") * F.col(f"__n{i}"),
                              F.col(f"__l{i}"), F.col(f"__h{i}"), F.when(F.col(f"__n{i}") > 0, F.col(f"__k{i}")), None, None))
    for i, c in enumerate(text):
        v = F.col(E.quote(c))
        aggs += [F.count(v).alias(f"__tn{i}"), F.hll_sketch_agg(v, 14).alias(f"__u{i}"),
                 F.expr(f"approx_top_k_accumulate({E.quote(c)}, {TRACKED})").alias(f"__t{i}")]
        structs.append(_state(F.lit(c), F.lit("text"), F.col("__rows") - F.col(f"__tn{i}"), None, None, None, None, None,
                              F.col(f"__u{i}"), F.col(f"__t{i}")))
    one = df.agg(*aggs)
    if not structs:
        return df.sparkSession.createDataFrame([], "batch string, column_name string")
    return one.select(F.lit(batch).alias("batch"), F.inline(F.array(*structs)))


_TOP = "struct<sketch:binary,maxItemsTracked:int,itemDataType:string,itemDataTypeDDL:string>"


def _state(name, kind, missing, mean, m2, low, high, quantiles, distinct, top):
    def or_null(c, t):
        return F.lit(None).cast(t) if c is None else c.cast(t) if t != _TOP else c

    return F.struct(name.alias("column_name"), kind.alias("kind"), F.col("__rows").alias("n_rows"), missing.alias("missing"),
                    or_null(mean, "double").alias("mean"), or_null(m2, "double").alias("m2"), or_null(low, "double").alias("low"),
                    or_null(high, "double").alias("high"), or_null(quantiles, "binary").alias("quantiles"),
                    or_null(distinct, "binary").alias("distinct"), or_null(top, _TOP).alias("top"))


def merge(sketches: DataFrame, batch: str = "merged") -> DataFrame:
    """Sketches of any batches as one per column."""
    n = F.col("n_rows") - F.col("missing")
    counts = [F.sum("n_rows").alias("n_rows"), F.sum("missing").alias("missing")]
    num = sketches.where("kind = 'numeric'").groupBy("column_name", "kind").agg(
        *counts, F.sum(n).alias("__n"), F.sum(n * F.col("mean")).alias("__s"), F.sum(F.col("m2") + n * F.col("mean") * F.col("mean")).alias("__q"),
        F.min("low").alias("low"), F.max("high").alias("high"), F.kll_merge_agg_double("quantiles").alias("__k"),
        F.first("distinct").alias("distinct"), F.first("top").alias("top"))  # null, but no constant: Spark cannot fold estimates of one
    mean = F.try_divide("__s", "__n")
    num = num.withColumns({"mean": mean, "m2": F.greatest(F.col("__q") - F.col("__n") * mean * mean, F.lit(0.0)),
                           "quantiles": F.when(F.col("__n") > 0, F.col("__k"))}).drop("__n", "__s", "__q", "__k")
    text = sketches.where("kind = 'text'").groupBy("column_name", "kind").agg(
        *counts, F.hll_union_agg("distinct").alias("distinct"), F.expr("approx_top_k_combine(top)").alias("top"))
    return num.unionByName(text, allowMissingColumns=True).select(F.lit(batch).alias("batch"), *STATE)


def numeric_summary(sketches: DataFrame) -> DataFrame:
    """X3 from merged sketches; quantiles within ``RANK_ERROR``."""
    n = F.col("n_rows") - F.col("missing")
    q = lambda p: F.when(F.col("quantiles").isNotNull(), F.kll_sketch_get_quantile_double("quantiles", F.lit(p)))
    return sketches.where("kind = 'numeric'").select(
        "column_name", "mean", q(0.5).alias("median"), F.when(n > 1, F.sqrt(F.col("m2") / (n - 1))).alias("std"), F.col("low").alias("min"),
        F.col("high").alias("max"), q(0.25).alias("q25"), q(0.75).alias("q75"), F.col("missing").alias("missing_count"))


def categorical_summary(sketches: DataFrame, top: int = 5) -> tuple[DataFrame, DataFrame]:
    """X4 from merged sketches: ``(summary, top values)``."""
    t = sketches.where("kind = 'text'").withColumn("__top", F.expr(f"approx_top_k_estimate(top, {int(top)})"))
    first = F.get("__top", F.lit(0))
    summary = t.select("column_name", F.hll_sketch_estimate("distinct").alias("unique_values"), first["item"].alias("most_common"),
                       F.coalesce(first["count"], F.lit(0)).alias("most_common_count"), F.col("missing").alias("missing_count"))
    values = t.select("column_name", F.posexplode("__top").alias("rank", "x")).select(
        "column_name", (F.col("rank") + 1).cast("long").alias("rank"), F.col("x.item").alias("value"), F.col("x.count").alias("n"))
    return summary, values
