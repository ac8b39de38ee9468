"""Orchestrator V12-V14, batch validation V18, skip-unchanged V19.

``validate(df, rules)`` returns a :class:`ValidationResult` whose members are
lazy DataFrames.  All fused checks of all rules run in one ``df.agg``; issue
frames that need their own plan (duplicates, catalog joins) are unioned in.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carecheck.functions import exprs as E
from carecheck.plans.aggplan import (ISSUE_COLUMNS, Check, attach_samples, compile_checks, empty_issues,
                                     issue_rows, no_cell, union_all)
from carecheck.plans.rowindex import with_row_index
from carecheck.operators.rules import (CustomValidator, DataQualityChecker, RowCheck, Rule, RulePlan, conform_issues,
                                       duplicate_count)
from carecheck.session import shared_table


@dataclass
class ValidationResult:
    data: DataFrame
    issues: DataFrame
    rules: list[Rule] = field(default_factory=list)
    custom_validators: int = 0
    compliance: object = None        # ComplianceReport when requested
    analytics: dict | None = None    # name -> DataFrame when requested

    # V14 ------------------------------------------------------------------
    def counts(self) -> DataFrame:
        """One row: total/error/warning/info counts and ``is_valid``."""
        return severity_counts(self.issues)

    # P4, P5 ---------------------------------------------------------------
    def by_severity(self, severity: str) -> DataFrame:
        return self.issues.where(F.col("severity") == severity)

    def by_column(self, column: str) -> DataFrame:
        return self.issues.where(F.col("column_name") == column)

    # V13 ------------------------------------------------------------------
    def summary(self) -> DataFrame:
        return summarize(self.data, n_rules=len(self.rules), n_custom=self.custom_validators)


def severity_counts(issues: DataFrame) -> DataFrame:
    s = F.col("severity")
    return issues.agg(
        F.count(F.lit(1)).alias("total_issues"),
        F.count_if(s == "error").alias("error_count"),
        F.count_if(s == "warning").alias("warning_count"),
        F.count_if(s == "info").alias("info_count"),
        (~F.coalesce(F.bool_or(s == "error"), F.lit(False))).alias("is_valid"))


def summarize(df: DataFrame, n_rules: int = 0, n_custom: int = 0) -> DataFrame:
    """One row with row/column counts, per-column missing counts, duplicate
    rows and dtypes.  Missing counts are one fused aggregate."""
    fields = df.schema.fields
    miss = [F.count_if(E.is_missing(f.name, f.dataType)).alias(f"__m{i}") for i, f in enumerate(fields)]
    one = df.agg(F.count(F.lit(1)).alias("total_rows"), *miss)
    missing_map = (F.map_from_arrays(F.array(*[F.lit(f.name) for f in fields]),
                                     F.array(*[F.col(f"__m{i}") for i in range(len(fields))]))
                   if fields else F.create_map().cast("map<string,bigint>"))
    dtypes = F.create_map(*[x for f in fields for x in (F.lit(f.name), F.lit(E.pandas_dtype(f.dataType)))])
    dup = duplicate_count(df).select("n_duplicates").scalar()  # one value, no join
    return (one.select("total_rows", missing_map.alias("missing_values"))
            .select("total_rows", F.lit(len(fields)).alias("total_columns"), "missing_values",
                    F.coalesce(dup, F.lit(0)).cast("long").alias("duplicate_rows"),
                    dtypes.alias("data_types"), F.lit(n_rules).alias("rules_applied"),
                    F.lit(n_custom).alias("custom_validators")))


def _failure_row(rule_name: str, err: Exception, custom: bool) -> tuple:
    kind = "Custom validator" if custom else "Rule"
    msg = f"{kind} '{rule_name}' failed: {str(err).splitlines()[0] if str(err) else err!r}"
    return (f"failed:{rule_name}", rule_name, "error", None, "failure", None, None, msg, None)


def plan_rules(df: DataFrame, rules: list[Rule], custom: set[int] | None = None) -> tuple[list[Check], list[DataFrame]]:
    """Collect fused checks and issue frames; a rule whose plan fails to
    analyse becomes an ``error`` issue and the remaining rules still run."""
    custom = custom or set()
    checks: list[Check] = []
    frames: list[DataFrame] = []
    rows: list[tuple] = []
    spark = df.sparkSession
    for i, r in enumerate(rules):
        try:
            p: RulePlan = r.plan(df)
            if p.checks:
                df.select(*[c.agg for c in p.checks])  # one analysis per rule, no job
            checks.extend(p.checks)
            frames.extend(p.frames)
            rows.extend(p.rows)
        except Exception as e:  # noqa: BLE001 - any failure of a stage becomes an issue
            rows.append(_failure_row(getattr(r, "name", type(r).__name__), e, i in custom))
    if rows:
        frames.append(issue_rows(spark, rows))  # one local relation for all plan-time findings
    return checks, frames


USER_RULES = (RowCheck, CustomValidator)


def run_user_rules(df: DataFrame, rules: list[Rule], custom: set[int]) -> list[DataFrame]:
    """Issues of rules with user expressions or functions, run now so that one that fails while it runs
    becomes an ``error`` issue and the others still report.  All predicates share one scan; only when that
    fails does each run by itself.  A predicate's result is one row; a function's issues are written."""
    spark = df.sparkSession
    rows, frames, plans = [], [], []

    def guarded(i: int, run: Callable):
        try:
            return run()
        except Exception as e:  # noqa: BLE001 - whatever a user rule raises
            rows.append(_failure_row(getattr(rules[i], "name", type(rules[i]).__name__), e, i in custom))
            return None

    for i, r in enumerate(rules):
        p = guarded(i, lambda r=r: r.plan(df))
        if p is not None:
            plans.append((i, p))
    checked = [(i, p.checks) for i, p in plans if p.checks]
    try:
        rows += [tuple(x) for x in compile_checks(df, [c for _, cs in checked for c in cs]).collect()]
    except Exception:  # noqa: BLE001 - find out which
        for i, cs in checked:
            rows += guarded(i, lambda cs=cs: [tuple(x) for x in compile_checks(df, cs).collect()]) or []
    for i, p in plans:
        rows += p.rows
        for f in p.frames:
            kept = guarded(i, lambda f=f: shared_table(f, "issues"))
            if kept is not None:
                frames.append(kept)
    return frames + ([issue_rows(spark, rows)] if rows else [])


def validate(df: DataFrame, rules: list[Rule], custom_validators: list[Rule] | None = None,
             compliance: bool = False, template: str | None = None, custom_rules: list | None = None,
             analytics: bool = False, time_column: str | None = None, as_of: str | None = None) -> ValidationResult:
    """Run ``rules`` then ``custom_validators`` over ``df``; optionally the
    compliance engine (``compliance``/``template``/``custom_rules``) and the
    analytics report.  A failing rule becomes an ``error`` issue, a failing
    compliance stage a ``warning`` and a failing analytics stage an ``info``
    issue; the other stages still run."""
    custom_validators = custom_validators or []
    own = [r for r in rules if not isinstance(r, USER_RULES)]
    user = [r for r in rules if isinstance(r, USER_RULES)]
    checks, frames = plan_rules(df, own)
    parts = [compile_checks(df, checks)] if checks else []
    parts += frames
    if user or custom_validators:
        parts += run_user_rules(df, user + list(custom_validators), set(range(len(user), len(user) + len(custom_validators))))
    extra: list[tuple] = []
    rep = None
    if compliance or template is not None or custom_rules:
        try:
            from carecheck.operators.compliance import compliance_report
            rep = compliance_report(df, custom_rules, template=template)
        except Exception as e:  # noqa: BLE001 - any failure of a stage becomes an issue
            extra.append(("failed:compliance", "ComplianceEngine", "warning", None, "failure", None, None,
                          f"Compliance validation failed: {str(e).splitlines()[0]}", None))
    report = None
    if analytics:
        try:
            from carecheck.operators.analytics import full_report
            report = full_report(df, time_column, as_of=as_of)
        except Exception as e:  # noqa: BLE001 - any failure of a stage becomes an issue
            extra.append(("failed:analytics", "AdvancedAnalytics", "info", None, "failure", None, None,
                          f"Analytics failed: {str(e).splitlines()[0]}", None))
    if extra:
        parts.append(issue_rows(df.sparkSession, extra))
    issues = union_all(parts) if parts else empty_issues(df.sparkSession)
    return ValidationResult(df, issues.select(*ISSUE_COLUMNS), list(rules), len(custom_validators), rep, report)


# --------------------------------------------------------------------------
# Batch validation by row position
# --------------------------------------------------------------------------
def compile_checks_by(df: DataFrame, checks: list[Check], keys: list[str]) -> DataFrame:
    """Like ``compile_checks`` but per group of ``keys`` (one hash aggregate)."""
    aggs = [F.count(F.lit(1)).alias("__rows")]
    aggs += [c.agg.cast("long").alias(f"__c{i}") for i, c in enumerate(checks)]
    grouped = df.groupBy(*keys).agg(*aggs)
    rows = F.col("__rows")
    structs = []
    for i, c in enumerate(checks):
        n = F.col(f"__c{i}")
        sev = c.severity(n, rows) if callable(c.severity) else F.lit(c.severity)
        msg = c.message(n, rows) if callable(c.message) else F.lit(c.message)
        structs.append(F.struct(
            F.lit(c.check_id).alias("check_id"), F.lit(c.rule_name).alias("rule_name"),
            sev.cast("string").alias("severity"), F.lit(c.column).cast("string").alias("column_name"),
            F.lit(c.metric).alias("metric"), n.alias("n_affected"), rows.alias("n_rows"),
            msg.cast("string").alias("message"), *no_cell(),
            F.coalesce(c.emit(n, rows), F.lit(False)).alias("__emit")))
    issues = grouped.select(*keys, F.inline(F.array(*structs))).where("__emit").drop("__emit")
    sampled = [c for c in checks if c.sample is not None]
    for order in dict.fromkeys(c.sample_order for c in sampled):
        group = [c for c in sampled if c.sample_order == order]
        issues = attach_samples(df, issues, group, order_by=list(order) or None, group_keys=keys)
    return issues


def in_batches(df: DataFrame, order_by: list[str], batch_size: int, num_partitions: int | None = None) -> DataFrame:
    """``df`` with ``__row`` (position) and ``batch_num``."""
    return (with_row_index(df, order_by, "__row", num_partitions)
            .withColumn("batch_num", F.floor(F.col("__row") / batch_size).cast("long")))


def batch_validate(df: DataFrame, rules: list[Rule], order_by: list[str], batch_size: int = 10000,
                   num_partitions: int | None = None,
                   progress: Callable[[str, int, int], None] | None = None) -> tuple[DataFrame, DataFrame]:
    """Split rows into position batches of ``batch_size`` and validate each
    batch independently (duplicates, percentages and empties are per batch).

    Returns ``(issues, batches)``: issues carry ``batch_num``; batches has
    ``batch_num, start_row, end_row, issues_count, is_valid``.  All batches are
    one grouped aggregation -- not a loop of jobs; only a user function without
    a ``by_batch`` form runs batch by batch.  ``progress(rule, done, of)`` is
    called as each rule is planned or run.
    """
    return _batched(in_batches(df, order_by, batch_size, num_partitions), rules, batch_size, progress)


def _batched(data: DataFrame, rules: list[Rule], batch_size: int, progress=None) -> tuple[DataFrame, DataFrame]:
    counts = data.groupBy("batch_num").agg(F.count(F.lit(1)).alias("__n"))
    start = F.col("batch_num") * batch_size
    batches = counts.select("batch_num", start.alias("start_row"), (start + F.col("__n")).alias("end_row"))
    issues = issues_by(data.drop("__row"), batches.select("batch_num"), rules, "batch_num", progress)
    return issues, _with_counts(batches, issues)


def issues_by(data: DataFrame, groups: DataFrame, rules: list[Rule], key: str, progress=None) -> DataFrame:
    """The issues of each group of ``data[key]`` on its own; ``groups`` has the column ``key`` with one row per group."""
    spark = data.sparkSession
    payload = data.drop(key)
    checks, frames = [], []
    for k, r in enumerate(rules):
        try:
            if isinstance(r, DataQualityChecker):
                checks.extend(r.missing_checks(payload))
                if r.duplicates:
                    frames.append(duplicate_count(data, [key]).where("n_duplicates > 0").select(
                        key, F.lit("duplicates").alias("check_id"), F.lit(r.name).alias("rule_name"),
                        F.lit("warning").alias("severity"), F.lit(None).cast("string").alias("column_name"),
                        F.lit("duplicates").alias("metric"), F.col("n_duplicates").cast("long").alias("n_affected"),
                        F.lit(None).cast("long").alias("n_rows"),
                        F.format_string("Found %d duplicate rows", "n_duplicates").alias("message"), *no_cell()))
            elif isinstance(r, CustomValidator):
                frames.extend(_user_batches(data, r, groups, key))
            else:
                p = r.plan(payload)
                if isinstance(r, RowCheck):  # a user's predicate: run now, so that only it can fail
                    frames.append(shared_table(compile_checks_by(data, p.checks, [key]), "issues"))
                else:
                    checks.extend(p.checks)
                # schema-level findings are the same in every group
                static = list(p.frames) + ([issue_rows(spark, p.rows)] if p.rows else [])
                frames.extend(_per_batch(groups, f, key) for f in static)
        except Exception as e:  # noqa: BLE001 - a failing rule is an issue of every group
            frames.append(_per_batch(groups, issue_rows(spark, [_failure_row(r.name, e, isinstance(r, CustomValidator))]), key))
        if progress:
            progress(getattr(r, "name", type(r).__name__), k + 1, len(rules))
    parts = ([compile_checks_by(data, checks, [key])] if checks else []) + frames
    if parts:
        return union_all([p.select(key, *ISSUE_COLUMNS) for p in parts])
    return empty_issues(spark).select(F.lit(None).cast(groups.schema[key].dataType).alias(key), *ISSUE_COLUMNS)


def _with_counts(batches: DataFrame, issues: DataFrame) -> DataFrame:
    per = issues.groupBy("batch_num").agg(F.count(F.lit(1)).alias("issues_count"),
                                          F.bool_or(F.col("severity") == "error").alias("__err"))
    return (batches.join(per, "batch_num", "left")
            .select("batch_num", "start_row", "end_row", F.coalesce("issues_count", F.lit(0)).cast("long").alias("issues_count"),
                    (~F.coalesce("__err", F.lit(False))).alias("is_valid")))


def _user_batches(data: DataFrame, r: CustomValidator, groups: DataFrame, key: str) -> list[DataFrame]:
    """A user function's issues per group, written as they are found."""
    if r.by_batch is not None:
        out = r.by_batch(data)
        return [] if out is None else [shared_table(conform_issues(out, r.name, r.severity, (key,)), "issues")]
    frames = []
    for b in [x[key] for x in groups.orderBy(key).toLocalIterator()]:
        number = F.lit(b).cast(groups.schema[key].dataType).alias(key)
        try:
            for f in r.plan(data.where(F.col(key) == b).drop(key)).frames:
                frames.append(shared_table(f.select(number, *ISSUE_COLUMNS), "issues"))
        except Exception as e:  # noqa: BLE001 - whatever the function raises, for this group alone
            frames.append(issue_rows(data.sparkSession, [_failure_row(r.name, e, True)]).select(number, *ISSUE_COLUMNS))
    return frames


def _per_batch(groups: DataFrame, frame: DataFrame, key: str) -> DataFrame:
    """Repeat schema-level issue rows (at most a few per column) in each group:
    the rows become one array value (scalar subquery) inlined per group."""
    arr = frame.agg(F.collect_list(F.struct(*ISSUE_COLUMNS)).alias("a")).scalar()
    return groups.select(key, F.inline(arr))


# --------------------------------------------------------------------------
# Skip unchanged batches, reusing their stored results
# --------------------------------------------------------------------------
def ruleset_hash(rules: list[Rule]) -> str:
    """A digest of the rules' classes and settings; a function counts by its name and code."""
    def text(v) -> str:
        if callable(v) and hasattr(v, "__code__"):
            return f"{v.__module__}.{v.__qualname__}:{v.__code__.co_code.hex()}:{v.__code__.co_consts!r}"
        if isinstance(v, dict):
            return "{" + ",".join(f"{k!r}:{text(x)}" for k, x in sorted(v.items(), key=lambda i: repr(i[0]))) + "}"
        if isinstance(v, (list, tuple)):
            return "[" + ",".join(map(text, v)) + "]"
        return repr(v)
    return hashlib.sha256("|".join(f"{type(r).__qualname__}{text(vars(r))}" for r in rules).encode()).hexdigest()


def _fingerprints(data: DataFrame, columns: list[str], rules: str, batch_size: int) -> DataFrame:
    cols = [F.col(E.quote(c)) for c in columns]
    place = F.col("__row") % batch_size
    total = lambda seed: F.sum(F.xxhash64(F.lit(seed), place, *cols).cast("decimal(38,0)")).cast("string")
    return (data.groupBy("batch_num")
            .agg(F.count(F.lit(1)).alias("n_rows"), F.concat_ws(":", total(1), total(2)).alias("content_hash"))
            .withColumn("ruleset_hash", F.lit(rules)))


def batch_fingerprints(df: DataFrame, order_by: list[str], batch_size: int, rules: list[Rule] | str,
                       num_partitions: int | None = None) -> DataFrame:
    """Per position batch: row count, a content hash and the rule set's hash.  The content hash adds up two
    seeded 64-bit hashes of each row with its position in the batch, so equal rows do not cancel."""
    name = rules if isinstance(rules, str) else ruleset_hash(rules)
    return _fingerprints(in_batches(df, order_by, batch_size, num_partitions), df.columns, name, batch_size)


def changed_batches(current: DataFrame, stored: DataFrame) -> DataFrame:
    """Batches whose (rows, content hash, rule-set hash) are not in ``stored``."""
    keys = ["batch_num", "n_rows", "content_hash", "ruleset_hash"]
    return current.join(stored.select(*keys), keys, "left_anti")


def revalidate(df: DataFrame, rules: list[Rule], order_by: list[str], batch_size: int, stored: DataFrame,
               stored_issues: DataFrame, num_partitions: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(issues, batches, fingerprints)``: only batches that are not in the ``stored`` fingerprints are
    validated; the others' issues come from ``stored_issues``."""
    data = in_batches(df, order_by, batch_size, num_partitions)
    now = shared_table(_fingerprints(data, df.columns, ruleset_hash(rules), batch_size), "fingerprints")
    changed = changed_batches(now, stored).select("batch_num")
    issues, _ = _batched(data.join(changed, "batch_num", "left_semi"), rules, batch_size)
    kept = now.select("batch_num").join(changed, "batch_num", "left_anti")
    issues = issues.unionByName(stored_issues.join(kept, "batch_num", "left_semi").select(*issues.columns))
    start = F.col("batch_num") * batch_size
    return issues, _with_counts(now.select("batch_num", start.alias("start_row"), (start + F.col("n_rows")).alias("end_row")), issues), now


# --------------------------------------------------------------------------
# Run-log record of a validation (input of the monitors, M1-M8)
# --------------------------------------------------------------------------
def run_record(result: ValidationResult, run_id: str, duration_s: float | None = None,
               compliance=None) -> DataFrame:
    """One run-log row (``operators.monitor.RUN_LOG_SCHEMA``) for a validation:
    validity and issue count from the issues, row count from the data, and --
    when a compliance report is given -- ``compliance_score`` (overall / 100)
    and its violations."""
    counts = severity_counts(result.issues).select(
        F.struct("is_valid", "total_issues").alias("c")).scalar()
    base = result.data.agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit(run_id).alias("run_id"), F.current_timestamp().alias("ts"), counts["is_valid"].alias("is_valid"),
        "n_rows", counts["total_issues"].cast("long").alias("n_issues"),
        F.lit(duration_s).cast("double").alias("duration_s"))
    vt = "array<struct<standard:string,severity:string,field:string,message:string>>"
    if compliance is None:
        return base.select("*", F.create_map().cast("map<string,double>").alias("metrics"),
                           F.array().cast(vt).alias("violations"))
    score = compliance.overall().select((F.col("overall_score") / 100.0).alias("s")).scalar()
    viol = compliance.violations.agg(F.collect_list(  # violations of one run: bounded by checks
        F.struct("standard", "severity", "field", "message")).alias("v")).scalar()
    return base.select("*", F.create_map(F.lit("compliance_score"), score).alias("metrics"),
                       F.coalesce(viol, F.array().cast(vt)).alias("violations"))
