"""The columns table: one row per column of every table under audit.

Column-name checks (required columns, expected types, PHI-by-name, FDA
signature/audit fields, dtype histograms) are queries over this table, so the
same checks run as one DataFrame job over thousands of tables.  Each table
under audit contributes one aggregate: its rows and how many values each column
holds, beside the facts of its schema.  (A bare schema can be listed too; its
counts are null.)
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carecheck.functions import exprs as E
from carecheck.functions import patterns as P

COLUMNS_SCHEMA = T.StructType([
    T.StructField("table_name", T.StringType()),
    T.StructField("column_name", T.StringType()),
    T.StructField("position", T.IntegerType()),
    T.StructField("data_type", T.StringType()),
    T.StructField("pandas_type", T.StringType()),
    T.StructField("widened_type", T.StringType()),
    T.StructField("n_rows", T.LongType()),
    T.StructField("n_values", T.LongType()),
])


def columns_table(spark: SparkSession, tables: dict[str, DataFrame | T.StructType]) -> DataFrame:
    """One row per column with ``n_rows`` and ``n_values`` (neither null nor NaN) of its table: one aggregate
    per table, whose single row becomes one row per column."""
    def facts(tname: str, i: int, f: T.StructField) -> tuple:
        return tname, f.name, i, f.dataType.simpleString(), E.pandas_dtype(f.dataType), E.widened_dtype(f.dataType)

    rows, parts = [], []
    for tname, t in tables.items():
        if isinstance(t, T.StructType):
            rows += [(*facts(tname, i, f), None, None) for i, f in enumerate(t.fields)]
            continue
        fields = t.schema.fields
        if fields:
            one = t.agg(F.count(F.lit(1)).alias("__n"), *[F.count_if(~E.is_missing(f.name, f.dataType)).alias(f"__v{i}") for i, f in enumerate(fields)])
            structs = [F.struct(*[F.lit(v).alias(n) for n, v in zip(COLUMNS_SCHEMA.names, facts(tname, i, f))],
                                F.col("__n").alias("n_rows"), F.col(f"__v{i}").alias("n_values")) for i, f in enumerate(fields)]
            parts.append(one.select(F.inline(F.array(*structs))))
    if rows or not parts:
        parts.append(spark.createDataFrame(rows, COLUMNS_SCHEMA))
    return reduce(DataFrame.unionByName, parts)


def type_compat_table(spark: SparkSession) -> DataFrame:
    rows = [(actual, name) for actual, names in P.TYPE_COMPATIBILITY.items() for name in names]
    return spark.createDataFrame(rows, "pandas_type string, expected_lower string")


def keyword_hit(col: str, keywords: list[str]) -> F.Column:
    """True when any keyword is a substring of the lower-cased column name."""
    arr = F.array(*[F.lit(k) for k in keywords])
    return F.exists(arr, lambda k: F.instr(F.lower(F.col(col)), k) > 0)


def required_missing(cols: DataFrame, required: DataFrame) -> DataFrame:
    """V1: ``required(table_name, column_name)`` rows absent from ``cols``."""
    return required.join(cols.select("table_name", "column_name"),
                         ["table_name", "column_name"], "left_anti")


def type_mismatches(cols: DataFrame, expected: DataFrame, strict: bool = False) -> DataFrame:
    """V2: ``expected(table_name, column_name, expected_type)`` rows whose actual
    dtype is incompatible.  Compatibility is an equi-join on a small table."""
    spark = cols.sparkSession
    actual_col = "pandas_type" if strict else "widened_type"
    joined = (expected.join(cols, ["table_name", "column_name"], "inner")
              .withColumn("expected_lower", F.lower("expected_type"))
              .withColumn("match_type", F.col(actual_col)))
    compat = type_compat_table(spark).withColumnRenamed("pandas_type", "match_type")
    bad = joined.join(F.broadcast(compat), ["match_type", "expected_lower"], "left_anti")
    return bad.select("table_name", "column_name", "pandas_type", "expected_type")


def phi_named_columns(cols: DataFrame) -> DataFrame:
    """V3: columns whose lower-cased name contains a PHI keyword."""
    return cols.where(keyword_hit("column_name", P.PHI_NAME_KEYWORDS))


def missing_tokens(cols: DataFrame, tokens: list[str]) -> DataFrame:
    """Per table, the tokens not contained in any lower column name."""
    names = cols.groupBy("table_name").agg(
        F.collect_list(F.lower("column_name")).alias("names"))
    arr = F.array(*[F.lit(t) for t in tokens])
    missing = F.filter(arr, lambda t: ~F.exists(F.col("names"), lambda n: F.instr(n, t) > 0))
    return names.select("table_name", missing.alias("missing"))


def dtype_counts(cols: DataFrame) -> DataFrame:
    """Number of columns per (table, dtype)."""
    return cols.groupBy("table_name", F.col("pandas_type").alias("dtype")).agg(
        F.count(F.lit(1)).alias("n_columns"))
