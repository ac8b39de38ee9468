"""Analytics and profiling: quality metrics Q1-Q6, anomalies N1-N3, trends
T1-T2, statistical summary X1-X5, chart aggregates G1-G4.

Two passes at most: pass 1 computes quantile bounds for the numeric columns
(one written range partition, see ``plans.quantiles``); pass 2 is one fused
aggregate for everything else, reading the bounds from a broadcast one-row
table.  Results are DataFrames of metrics / anomalies / trends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carecheck.functions import exprs as E
from carecheck.functions import patterns as P
from carecheck.plans.quantiles import quantile_wide, quantiles

METRIC_SCHEMA = "metric string, name string, value double, unit string, description string, severity string"


def numeric_columns(df: DataFrame, strict: bool = True) -> list[str]:
    """int64/float64 columns (``strict``, like the reference) or every integral/floating column."""
    out = []
    for f in df.schema.fields:
        if strict and isinstance(f.dataType, (T.LongType, T.DoubleType)):
            out.append(f.name)
        elif not strict and isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
                                                    T.FloatType, T.DoubleType)):
            out.append(f.name)
    return out


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if E.is_string(f.dataType)]


def datetime_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType))]


def _types(df: DataFrame) -> dict:
    return {f.name: f.dataType for f in df.schema.fields}


# --------------------------------------------------------------------------
# IQR bounds (pass 1)
# --------------------------------------------------------------------------
def iqr_bounds(df: DataFrame, columns: list[str], exact: bool = True) -> DataFrame:
    """(column_name, q1, q3, lower, upper) per numeric column."""
    q = quantile_wide(quantiles(df, columns, [0.25, 0.75], exact=exact), {"q1": 0.25, "q3": 0.75})
    iqr = F.col("q3") - F.col("q1")
    return q.select("column_name", "q1", "q3", (F.col("q1") - 1.5 * iqr).alias("lower"),
                    (F.col("q3") + 1.5 * iqr).alias("upper"))


def bounds_scalar(bounds: DataFrame, columns: list[str]) -> Column:
    """The IQR bounds of all columns as ONE struct literal (lo_i, hi_i).

    Pass 1 (quantiles) ends here: its result has a fixed size -- two numbers
    per numeric column, independent of the data volume -- and is inlined into
    pass 2 as a literal, so pass 2 is a plain single-scan aggregate."""
    got = {r["column_name"]: (r["lower"], r["upper"]) for r in bounds.collect()}
    fields = []
    for i, c in enumerate(columns):
        lo, hi = got.get(c, (None, None))
        fields.append(F.lit(lo).cast("double").alias(f"lo{i}"))
        fields.append(F.lit(hi).cast("double").alias(f"hi{i}"))
    return F.struct(*fields)


def _outlier(name: str, dt, i: int, b: Column) -> Column:
    c = E.clean(name, dt)
    return (c < b[f"lo{i}"]) | (c > b[f"hi{i}"])


# --------------------------------------------------------------------------
# N1 row flags
# --------------------------------------------------------------------------
def outlier_rows(df: DataFrame, key: list[str], exact: bool = True, strict: bool = True) -> DataFrame:
    """N1 affected rows as a row-flag table: (key..., column_name) per outlier cell."""
    cols = numeric_columns(df, strict)
    types = _types(df)
    b = bounds_scalar(iqr_bounds(df, cols, exact), cols)
    flags = F.array(*[F.when(F.coalesce(_outlier(c, types[c], i, b), F.lit(False)), F.lit(c))
                      for i, c in enumerate(cols)])
    # plain explode + filter: a scalar subquery may not sit inside a lambda
    return (df.select(*[F.col(E.quote(k)) for k in key], F.explode(flags).alias("column_name"))
            .where(F.col("column_name").isNotNull()))


# --------------------------------------------------------------------------
# Q1-Q6, N1-N2 in one pass (after the quantile pass)
# --------------------------------------------------------------------------
class Profile:
    """Lazy holder for the fused pass-2 aggregate of a table."""

    def __init__(self, df: DataFrame, time_column: str | None = None, as_of: str | None = None,
                 exact: bool = True, strict: bool = True, json_columns: list[str] | None = None):
        """``json_columns`` hold JSON values, whose types Q2 and N3 compare; other columns have one type each."""
        self.df = df
        self.json_columns = list(json_columns or [])
        self.types = _types(df)
        self.num = numeric_columns(df, strict)
        self.dts = datetime_columns(df)
        self.time_column = time_column if time_column else (self.dts[0] if self.dts else None)
        self.as_of = as_of
        self.exact = exact
        fields = df.schema.fields
        b = bounds_scalar(iqr_bounds(df, self.num, exact), self.num) if self.num else None
        aggs = [F.count(F.lit(1)).alias("__rows")]
        for i, f in enumerate(fields):
            aggs.append(F.count_if(E.is_missing(f.name, f.dataType)).alias(f"__m{i}"))
        for i, c in enumerate(self.num):
            aggs.append(F.count_if(F.coalesce(_outlier(c, self.types[c], i, b), F.lit(False))).alias(f"__o{i}"))
        for i, c in enumerate(self.json_columns):  # a set of type names: bounded
            aggs.append(F.collect_set(_value_type(c)).alias(f"__j{i}"))
        if self.dts:
            aggs.append(F.max(F.col(E.quote(self.dts[0]))).alias("__tmax"))
        self.one = df.agg(*aggs)
        self.fields = fields

    # Q1-Q4 ----------------------------------------------------------------
    def _completeness(self) -> Column:
        nf = len(self.fields)
        if nf == 0:
            return F.lit(None).cast("double")
        total = _sum([F.col(f"__m{i}") for i in range(nf)])
        return 1 - F.try_divide(total.cast("double"), (F.col("__rows") * nf).cast("double"))

    def _consistency(self) -> Column:
        mixed = [F.when(F.size(f"__j{i}") > 1, 0.5).otherwise(0.0) for i in range(len(self.json_columns))]
        return F.lit(1.0) - _sum(mixed) / len(self.fields) if mixed else F.lit(1.0)

    def _accuracy(self) -> Column:
        nf = len(self.fields)
        if nf == 0:
            return F.lit(1.0)
        parts = []
        for f in self.fields:
            if f.name in self.num:
                i = self.num.index(f.name)
                parts.append(1 - F.try_divide(F.col(f"__o{i}").cast("double"), F.col("__rows").cast("double")))
            else:
                parts.append(F.lit(1.0))
        return _sum(parts) / nf

    def _timeliness(self) -> Column:
        if not self.dts:
            return F.lit(1.0)
        now = F.to_timestamp(F.lit(self.as_of)) if self.as_of else F.current_timestamp()
        secs = F.unix_timestamp(now) - F.unix_timestamp(F.col("__tmax").cast("timestamp"))
        days = F.floor(secs / 86400)
        return F.when(F.col("__tmax").isNull(), F.lit(0.0)).otherwise(
            F.greatest(F.lit(0.0), 1 - days / 365.0))

    def metric_values(self) -> DataFrame:
        """One row: completeness, consistency, accuracy, timeliness, overall."""
        c, s, a, t = self._completeness(), self._consistency(), self._accuracy(), self._timeliness()
        w = P.QUALITY_WEIGHTS
        overall = (c * w["completeness"] + s * w["consistency"] + a * w["accuracy"] + t * w["timeliness"])
        return self.one.select(c.cast("double").alias("completeness"), s.cast("double").alias("consistency"),
                               a.cast("double").alias("accuracy"), t.cast("double").alias("timeliness"),
                               overall.cast("double").alias("overall_quality"))

    def metrics(self) -> DataFrame:
        """Q1-Q5: (metric, name, value, unit, description, severity)."""
        v = self.metric_values()
        structs = []
        for m in ("completeness", "consistency", "accuracy", "timeliness"):
            name, desc = P.QUALITY_METRIC_INFO[m]
            structs.append(F.struct(F.lit(m).alias("metric"), F.lit(name).alias("name"),
                                    F.col(m).alias("value"), F.lit("percentage").alias("unit"),
                                    F.lit(desc).alias("description"),
                                    E.threshold_level(F.col(m), P.QUALITY_THRESHOLDS[m]).alias("severity")))
        return v.select(F.inline(F.array(*structs)))

    # N1, N2 -----------------------------------------------------------------
    def anomalies(self) -> DataFrame:
        """(column_name, anomaly_type, severity, description, recommendation, n_affected)."""
        rows = F.col("__rows")
        structs = []
        for i, f in enumerate(self.fields):
            m = F.col(f"__m{i}")
            nonnull = rows - m
            if f.name in self.num:
                j = self.num.index(f.name)
                o = F.col(f"__o{j}")
                structs.append(F.struct(
                    F.lit(f.name).alias("column_name"), F.lit("outlier").alias("anomaly_type"),
                    F.when(o < rows * 0.1, "medium").otherwise("high").alias("severity"),
                    F.format_string("Found %d outliers in column '%s'", o, F.lit(f.name)).alias("description"),
                    F.lit("Review outliers for data entry errors or special cases").alias("recommendation"),
                    o.alias("n_affected"), ((nonnull > 0) & (o > 0)).alias("__on")))
            share = F.try_divide(m.cast("double"), rows.cast("double"))
            structs.append(F.struct(
                F.lit(f.name).alias("column_name"), F.lit("missing_pattern").alias("anomaly_type"),
                F.lit("high").alias("severity"),
                F.format_string("High percentage of missing values detected in column '%s': %.1f%%",
                                F.lit(f.name), share * 100).alias("description"),
                F.lit("Investigate data collection process for this column").alias("recommendation"),
                rows.alias("n_affected"), ((nonnull > 0) & (share > 0.2)).alias("__on")))
            if f.name in self.json_columns:
                found = F.array_sort(F.col(f"__j{self.json_columns.index(f.name)}"))
                structs.append(F.struct(
                    F.lit(f.name).alias("column_name"), F.lit("data_type_mismatch").alias("anomaly_type"),
                    F.lit("medium").alias("severity"),
                    F.format_string("Mixed data types detected in column '%s': %s", F.lit(f.name), F.array_join(found, ", ")).alias("description"),
                    F.lit("Standardize data types for consistency").alias("recommendation"),
                    nonnull.alias("n_affected"), (F.size(found) > 1).alias("__on")))
        if not structs:
            return self.df.sparkSession.createDataFrame(
                [], "column_name string, anomaly_type string, severity string, description string, "
                    "recommendation string, n_affected long, __on boolean").drop("__on")
        return (self.one.select(F.inline(F.array(*structs))).where(F.coalesce("__on", F.lit(False)))
                .drop("__on"))


def _sum(cols: list[Column]) -> Column:
    out = cols[0]
    for c in cols[1:]:
        out = out + c
    return out


def severity_for(metric: str, value: Column) -> Column:
    """Q5 severity of a metric value."""
    return E.threshold_level(value, P.QUALITY_THRESHOLDS[metric])


# --------------------------------------------------------------------------
# N3 / Q2 on semi-structured values
# --------------------------------------------------------------------------
def _value_type(column: str) -> Column:
    return F.schema_of_variant(F.try_parse_json(F.col(E.quote(column))))


def value_type_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column_name, value_type, n) for string columns holding JSON values."""
    cols = columns or string_columns(df)
    arr = F.array(*[F.struct(F.lit(c).alias("column_name"),
                             _value_type(c).alias("value_type"))
                    for c in cols])
    return (df.select(F.explode(arr).alias("s")).where(F.col("s.value_type").isNotNull())
            .groupBy("s.column_name", "s.value_type").agg(F.count(F.lit(1)).alias("n")))


def mixed_types(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Columns whose non-null values have more than one type."""
    tc = value_type_counts(df, columns)
    return (tc.groupBy("column_name").agg(F.count(F.lit(1)).alias("n_types"), F.sum("n").alias("n_values"))
            .where("n_types > 1")
            .select("column_name", F.lit("data_type_mismatch").alias("anomaly_type"),
                    F.lit("medium").alias("severity"), "n_types", "n_values"))


def consistency(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Q2: mean over columns of 1.0, or 0.5 for a column with mixed value types."""
    spark = df.sparkSession
    cols = columns or string_columns(df)
    allcols = df.columns
    mixed = mixed_types(df, cols).agg(F.count(F.lit(1)).alias("n_mixed"))
    n = len(allcols)
    return mixed.select(((F.lit(n) - 0.5 * F.col("n_mixed")) / F.lit(max(n, 1))).alias("consistency"))


# --------------------------------------------------------------------------
# T1, T2
# --------------------------------------------------------------------------
def trends(df: DataFrame, time_column: str | None = None, tie_breaker: list[str] | None = None,
           r2: bool = False, strict: bool = True, num_partitions: int | None = None) -> DataFrame:
    """(metric, trend, slope, confidence, period_start, period_end, n) per numeric column.

    Rows are ordered by ``time_column`` (+ ``tie_breaker``); x is the position
    among the column's non-null values.  Confidence reproduces the reference's
    formula with mean(y) as intercept (Quirk 8); ``r2=True`` gives true R^2.
    """
    dts = datetime_columns(df)
    tcol = time_column or (dts[0] if dts else None)
    spark = df.sparkSession
    schema = ("metric string, trend string, slope double, confidence double, period_start timestamp, "
              "period_end timestamp, n long")
    if tcol is None:
        return spark.createDataFrame([], schema)
    cols = [c for c in numeric_columns(df, strict) if c != tcol]
    if not cols:
        return spark.createDataFrame([], schema)
    types = _types(df)
    ties = list(tie_breaker or [])
    vals = F.array(*[F.struct(F.lit(c).alias("metric"), E.clean(c, types[c]).cast("double").alias("y"))
                     for c in cols])
    # a row without a time comes last, as in the reference's sort
    keys = [F.col(E.quote(tcol)).isNull().alias("__late"), F.col(E.quote(tcol)).alias("__t")] + [F.col(E.quote(k)).alias(f"__k{i}") for i, k in enumerate(ties)]
    long = (df.select(*keys, F.explode(vals).alias("s"))
            .select("__late", "__t", *[f"__k{i}" for i in range(len(ties))], "s.metric", "s.y")
            .where(F.col("y").isNotNull()))
    # x = position among the column's non-null values in (time, tie-breaker) order
    x = _dense_rank_in_group(long, "metric", ["__late", "__t"] + [f"__k{i}" for i in range(len(ties))], num_partitions)
    agg = x.groupBy("metric").agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope("y", "__x").alias("slope"),
        F.regr_sxx("y", "__x").alias("sxx"), F.regr_syy("y", "__x").alias("syy"),
        F.avg("__x").alias("xbar"), F.regr_r2("y", "__x").alias("r2"))
    tr = df.agg(F.struct(F.min(F.col(E.quote(tcol))).cast("timestamp").alias("start"),
                         F.max(F.col(E.quote(tcol))).cast("timestamp").alias("end")).alias("p")).scalar()
    b = F.col("slope")
    conf_ref = F.when(F.col("syy") == 0, F.lit(0.0)).otherwise(
        b * b * (F.col("sxx") - F.col("n") * F.col("xbar") * F.col("xbar")) / F.col("syy"))
    conf = F.coalesce(F.col("r2"), F.lit(0.0)) if r2 else conf_ref
    trend = F.when(b > 0.01, "increasing").when(b < -0.01, "decreasing").otherwise("stable")
    return (agg.where("n >= 3")
            .select("metric", trend.alias("trend"), b.alias("slope"), conf.alias("confidence"),
                    tr["start"].alias("period_start"), tr["end"].alias("period_end"),
                    F.col("n").cast("long").alias("n")))


def _dense_rank_in_group(df: DataFrame, group: str, order: list[str], num_partitions: int | None) -> DataFrame:
    """0-based position (double ``__x``) within ``group`` by ``order``."""
    from carecheck.plans.rowindex import rank_in_group
    return rank_in_group(df, group, order, "__x", num_partitions).withColumn("__x", F.col("__x").cast("double"))


# --------------------------------------------------------------------------
# X1-X4
# --------------------------------------------------------------------------
def dataset_info(df: DataFrame) -> DataFrame:
    """Rows, columns and a dtype histogram (map dtype -> n columns)."""
    from collections import Counter
    hist = Counter(E.pandas_dtype(f.dataType) for f in df.schema.fields)
    m = F.create_map(*[x for k, v in sorted(hist.items()) for x in (F.lit(k), F.lit(v))])
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        "rows", F.lit(len(df.columns)).alias("columns"), m.alias("data_types"))


def missing_summary(df: DataFrame) -> DataFrame:
    """Total missing cells, percent of all cells, columns with any missing."""
    fields = df.schema.fields
    one = df.agg(F.count(F.lit(1)).alias("__rows"),
                 *[F.count_if(E.is_missing(f.name, f.dataType)).alias(f"__m{i}") for i, f in enumerate(fields)])
    total = _sum([F.col(f"__m{i}") for i in range(len(fields))])
    names = F.array(*[F.when(F.col(f"__m{i}") > 0, F.lit(f.name)) for i, f in enumerate(fields)])
    return one.select(total.cast("long").alias("total_missing"),
                      (F.try_divide(total.cast("double"), (F.col("__rows") * len(fields)).cast("double")) * 100)
                      .alias("missing_percentage"),
                      F.filter(names, lambda x: x.isNotNull()).alias("columns_with_missing"))


def missing_by_column(df: DataFrame) -> DataFrame:
    """(column_name, missing_count) -- one fused aggregate, unpivoted."""
    fields = df.schema.fields
    one = df.agg(*[F.count_if(E.is_missing(f.name, f.dataType)).alias(f"__m{i}") for i, f in enumerate(fields)])
    structs = [F.struct(F.lit(f.name).alias("column_name"), F.col(f"__m{i}").cast("long").alias("missing_count"))
               for i, f in enumerate(fields)]
    return one.select(F.inline(F.array(*structs)))


def numeric_summary(df: DataFrame, exact: bool = True, strict: bool = True) -> DataFrame:
    """Mean, median, std (sample), min, max, q25, q75, missing_count per numeric column."""
    cols = numeric_columns(df, strict)
    types = _types(df)
    spark = df.sparkSession
    if not cols:
        return spark.createDataFrame([], "column_name string, mean double, median double, std double, "
                                         "min double, max double, q25 double, q75 double, missing_count long")
    aggs = []
    for i, c in enumerate(cols):
        v = E.clean(c, types[c]).cast("double")
        aggs += [F.avg(v).alias(f"__avg{i}"), F.stddev_samp(v).alias(f"__sd{i}"), F.min(v).alias(f"__min{i}"),
                 F.max(v).alias(f"__max{i}"), F.count_if(E.is_missing(c, types[c])).alias(f"__m{i}")]
    one = df.agg(*aggs)
    structs = [F.struct(F.lit(c).alias("column_name"), F.col(f"__avg{i}").alias("mean"),
                        F.col(f"__sd{i}").alias("std"), F.col(f"__min{i}").alias("min"),
                        F.col(f"__max{i}").alias("max"), F.col(f"__m{i}").cast("long").alias("missing_count"))
               for i, c in enumerate(cols)]
    stats = one.select(F.inline(F.array(*structs)))
    q = quantile_wide(quantiles(df, cols, [0.25, 0.5, 0.75], exact=exact),
                      {"q25": 0.25, "median": 0.5, "q75": 0.75})
    return stats.join(F.broadcast(q), "column_name", "left").select(
        "column_name", "mean", "median", "std", "min", "max", "q25", "q75", "missing_count")


def categorical_summary_approx(df: DataFrame, top: int = 5) -> tuple[DataFrame, DataFrame]:
    """X4 from sketches only (no value-level shuffle): ``approx_count_distinct``
    and ``approx_top_k`` per string column, in one aggregate.  For very large,
    high-cardinality text columns where the exact summary would shuffle every
    distinct value."""
    cols = string_columns(df)
    aggs = []
    for i, c in enumerate(cols):
        col = F.col(E.quote(c))
        aggs += [F.approx_count_distinct(col).alias(f"__u{i}"), F.count_if(col.isNull()).alias(f"__m{i}"),
                 F.expr(f"approx_top_k({E.quote(c)}, {int(top)})").alias(f"__t{i}")]
    one = df.agg(*aggs)
    structs = [F.struct(F.lit(c).alias("column_name"), F.col(f"__u{i}").cast("long").alias("unique_values"),
                        F.col(f"__m{i}").cast("long").alias("missing_count"), F.col(f"__t{i}").alias("top"))
               for i, c in enumerate(cols)]
    per = one.select(F.inline(F.array(*structs)))
    topv = per.select("column_name", F.posexplode("top").alias("pos", "t")).select(
        "column_name", (F.col("pos") + 1).cast("long").alias("rank"), F.col("t.item").alias("value"),
        F.col("t.count").cast("long").alias("n"))
    summ = per.select("column_name", "unique_values", F.col("top")[0]["item"].alias("most_common"),
                      F.coalesce(F.col("top")[0]["count"], F.lit(0)).cast("long").alias("most_common_count"),
                      "missing_count")
    return summ, topv


def categorical_summary(df: DataFrame, top: int = 5) -> tuple[DataFrame, DataFrame]:
    """``(summary, top_values)``.

    summary: (column_name, unique_values, most_common, most_common_count, missing_count)
    top_values: (column_name, rank, value, n) for the ``top`` most frequent
    values (count desc, value asc).  One ``groupBy(column, value)`` over the
    unpivoted string columns -- partial aggregation first, so a value holding
    a third of all rows is pre-counted per task -- then a per-column top-k
    (``WindowGroupLimit``).
    """
    cols = string_columns(df)
    arr = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(E.quote(c)).alias("value")) for c in cols])
    counts = (df.select(F.explode(arr).alias("s")).groupBy("s.column_name", "s.value")
              .agg(F.count(F.lit(1)).alias("n")))
    w = Window.partitionBy("column_name").orderBy(F.col("n").desc(), F.col("value").asc())
    ranked_src = counts.where(F.col("value").isNotNull())
    topv = (ranked_src.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
            .select("column_name", "rank", "value", F.col("n").cast("long").alias("n")))
    summ = counts.groupBy("column_name").agg(
        F.count_if(F.col("value").isNotNull()).alias("unique_values"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("missing_count"))
    first = topv.where("rank = 1").select("column_name", F.col("value").alias("most_common"),
                                          F.col("n").alias("most_common_count"))
    summ = summ.join(first, "column_name", "left").select(
        "column_name", F.col("unique_values").cast("long").alias("unique_values"), "most_common",
        F.coalesce("most_common_count", F.lit(0)).cast("long").alias("most_common_count"),
        F.col("missing_count").cast("long").alias("missing_count"))
    return summ, topv


# --------------------------------------------------------------------------
# G1, G2
# --------------------------------------------------------------------------
def severity_distribution(issues: DataFrame) -> DataFrame:
    return issues.groupBy("severity").agg(F.count(F.lit(1)).alias("n")).where("n > 0")


def issues_per_column(issues: DataFrame) -> DataFrame:
    return (issues.where(F.col("column_name").isNotNull()).groupBy("column_name")
            .agg(F.count(F.lit(1)).alias("n")))


# --------------------------------------------------------------------------
# Full report
# --------------------------------------------------------------------------
def full_report(df: DataFrame, time_column: str | None = None, tie_breaker: list[str] | None = None,
                as_of: str | None = None, exact: bool = True, json_columns: list[str] | None = None) -> dict[str, DataFrame]:
    """Quality metrics (with overall score), anomalies, trends and the
    statistical summaries of one table, as DataFrames.  The quantile pass is
    shared by the metrics and anomalies (one ``Profile``)."""
    p = Profile(df, time_column, as_of, exact, json_columns=json_columns)
    cat, top = categorical_summary(df)
    return {
        "quality_metrics": p.metrics(),
        "overall": p.metric_values().select("overall_quality"),
        "anomalies": p.anomalies(),
        "trends": trends(df, p.time_column, tie_breaker),
        "dataset_info": dataset_info(df),
        "missing_data": missing_summary(df),
        "numeric_summary": numeric_summary(df, exact),
        "categorical_summary": cat,
        "top_values": top,
    }
