"""Rule compiler: many checks, one scan.

Every check contributes one aggregate expression (usually ``count_if``) to a
single ``df.agg``.  The one-row result is unpivoted into issue rows with
``inline(array(struct(...)))`` -- all lazily, no ``collect``.  Spark runs the
aggregation as partial (per task) + final (one tiny shuffle of one row per
task), so cost is one pass over the data regardless of the number of checks.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ISSUE_SCHEMA = T.StructType([
    T.StructField("check_id", T.StringType()),
    T.StructField("rule_name", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("column_name", T.StringType()),
    T.StructField("metric", T.StringType()),
    T.StructField("n_affected", T.LongType()),
    T.StructField("n_rows", T.LongType()),
    T.StructField("message", T.StringType()),
    T.StructField("sample", T.ArrayType(T.StringType())),
    T.StructField("row", T.LongType()),       # of an issue about a single cell
    T.StructField("value", T.StringType()),
])

ISSUE_COLUMNS = [f.name for f in ISSUE_SCHEMA.fields]


def no_cell() -> list[Column]:
    """The sample, row and value columns of an issue that has none."""
    return [F.lit(None).cast(ISSUE_SCHEMA[c].dataType).alias(c) for c in ("sample", "row", "value")]


# (n, rows) -> Column
Finisher = Callable[[Column, Column], Column]


def _const(v) -> Finisher:
    return lambda n, rows: F.lit(v)


@dataclass
class Check:
    """One fused check.

    ``agg`` is an aggregate expression evaluated over the input; ``severity``,
    ``message`` and ``emit`` are evaluated on the one-row aggregate result with
    ``n`` = value of ``agg`` and ``rows`` = row count.
    """
    check_id: str
    rule_name: str
    column: str | None
    metric: str
    agg: Column
    severity: Finisher | str = "warning"
    message: Finisher | str = ""
    emit: Finisher = field(default=lambda n, rows: n > 0)
    sample: Column | None = None      # per-row value to sample when the check fails
    sample_when: Column | None = None  # per-row failure predicate for the sample
    sample_order: tuple[str, ...] = ()  # row order for "first k" samples (default: by value)


def _fin(f: Finisher | str) -> Finisher:
    return f if callable(f) else _const(f)


# Aggregates per scan.  Spark turns whole-stage codegen off for operators
# with more than ``spark.sql.codegen.maxFields`` (100) output fields, so wide
# tables are split into column groups; each group's scan reads only its own
# columns, so the total I/O stays about one pass over the data.
MAX_AGGS_PER_SCAN = 90


def _chunks(checks: list[Check], size: int) -> list[list[Check]]:
    by_col: dict = {}
    for c in checks:
        key = c.column if c.column else (c.check_id.split(":")[1] if ":" in c.check_id else c.check_id)
        by_col.setdefault(key, []).append(c)
    out, cur = [], []
    for group in by_col.values():
        if cur and len(cur) + len(group) > size:
            out.append(cur)
            cur = []
        while len(group) > size:
            out.append(group[:size])
            group = group[size:]
        cur = cur + group
    if cur:
        out.append(cur)
    return out


def _compile_chunk(df: DataFrame, checks: list[Check]) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("__rows")]
    aggs += [c.agg.cast("long").alias(f"__c{i}") for i, c in enumerate(checks)]
    one = df.agg(*aggs)
    rows = F.col("__rows")
    structs = []
    for i, c in enumerate(checks):
        n = F.col(f"__c{i}")
        structs.append(F.struct(
            F.lit(c.check_id).alias("check_id"),
            F.lit(c.rule_name).alias("rule_name"),
            _fin(c.severity)(n, rows).cast("string").alias("severity"),
            F.lit(c.column).cast("string").alias("column_name"),
            F.lit(c.metric).alias("metric"),
            n.alias("n_affected"),
            rows.alias("n_rows"),
            _fin(c.message)(n, rows).cast("string").alias("message"),
            *no_cell(),
            F.coalesce(c.emit(n, rows), F.lit(False)).alias("__emit"),
        ))
    return one.select(F.inline(F.array(*structs))).where("__emit").drop("__emit")


def compile_checks(df: DataFrame, checks: list[Check], max_aggs: int = MAX_AGGS_PER_SCAN) -> DataFrame:
    """Run all ``checks`` as fused aggregations (one per column group of at
    most ``max_aggs`` aggregates) and return issue rows."""
    spark = df.sparkSession
    if not checks:
        return spark.createDataFrame([], ISSUE_SCHEMA)
    parts = [_compile_chunk(df, ch) for ch in _chunks(checks, max_aggs)]
    issues = parts[0]
    for p in parts[1:]:
        issues = issues.unionByName(p)
    sampled = [c for c in checks if c.sample is not None]
    for order in dict.fromkeys(c.sample_order for c in sampled):
        group = [c for c in sampled if c.sample_order == order]
        issues = attach_samples(df, issues, group, order_by=list(order) or None)
    return issues


def attach_samples(df: DataFrame, issues: DataFrame, checks: list[Check],
                   k: int = 3, order_by: list[str] | None = None,
                   group_keys: list[str] | None = None) -> DataFrame:
    """First ``k`` failing values per check (and per ``group_keys``, e.g. the
    batch), by ``order_by``, else by value.

    Planned as a partial ``WindowGroupLimit`` per task before the shuffle, so
    at most ``k`` rows per check and task move -- never a whole group.  The
    result (k values per check and group) is joined back to the issue rows.
    """
    from carecheck.functions.exprs import quote
    gk = list(group_keys or [])
    stacked = F.array(*[
        F.when(c.sample_when, F.struct(F.lit(c.check_id).alias("cid"),
                                       c.sample.cast("string").alias("v")))
        for c in checks])
    keys = [F.col(quote(o)) for o in (order_by or [])]
    base = df.select(*[F.col(quote(g)) for g in gk], *keys,
                     F.explode(F.filter(stacked, lambda s: s.isNotNull())).alias("s"))
    from pyspark.sql import Window
    w = Window.partitionBy(*[F.col(quote(g)) for g in gk], F.col("s.cid")).orderBy(*(keys or [F.col("s.v")]))
    top = (base.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= k)
           .groupBy(*[F.col(quote(g)) for g in gk], F.col("s.cid").alias("check_id"))
           .agg(F.array_sort(F.collect_list(F.struct("__rn", F.col("s.v").alias("v"))))
                .alias("__s")))
    top = top.select(*gk, "check_id", F.transform("__s", lambda x: x["v"]).alias("__sample"))
    # per-batch samples grow with the number of batches: a regular join then
    out = issues.join(top if gk else F.broadcast(top), gk + ["check_id"], "left")
    from carecheck.functions.exprs import py_list_repr
    msg = F.when(F.col("__sample").isNotNull(),
                 F.concat(F.col("message"), py_list_repr(F.col("__sample")))).otherwise(F.col("message"))
    repl = {"sample": F.coalesce(F.col("__sample"), F.col("sample")), "message": msg}
    return out.select(*gk, *[repl.get(c, F.col(c)).alias(c) for c in ISSUE_COLUMNS])


def empty_issues(spark) -> DataFrame:
    return spark.createDataFrame([], ISSUE_SCHEMA)


def issue_rows(spark, rows: list[tuple]) -> DataFrame:
    """Issue rows known at plan time (schema-level findings); trailing columns may be left out."""
    width = len(ISSUE_COLUMNS)
    return spark.createDataFrame([tuple(r) + (None,) * (width - len(r)) for r in rows], ISSUE_SCHEMA)


def union_all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
