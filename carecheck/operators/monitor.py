"""Quality monitoring over a run log, batch form.

The run log has one row per validation run::

    run_id string, ts timestamp, is_valid boolean, n_rows bigint, n_issues bigint,
    duration_s double, metrics map<string,double>,
    violations array<struct<standard,severity,field,message>>

Order-dependent monitors (running failure rate, last-3 degradation, inactivity
gaps) sort the log into written range partitions once and look back with ``lag``
inside a partition plus a halo of the last rows of earlier ones -- never a
global single-partition window or a self-join -- so one metric holding a third
of all samples still spreads over many tasks.  ``streaming.monitor`` holds the
Structured Streaming twins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carecheck.functions import patterns as P
from carecheck.plans.rowindex import earlier_rows, ranges
from carecheck.plans.running import add_running_sums

RUN_LOG_SCHEMA = ("run_id string, ts timestamp, is_valid boolean, n_rows bigint, n_issues bigint, "
                  "duration_s double, metrics map<string,double>, "
                  "violations array<struct<standard:string,severity:string,field:string,message:string>>")
ALERT_COLUMNS = ["alert_id", "ts", "alert_type", "severity", "message", "details"]


def metric_status(metric: Column, value: Column) -> Column:
    """M2: normal / warning / critical by per-metric thresholds."""
    warn = F.lit(P.DEFAULT_METRIC_THRESHOLDS[0])
    crit = F.lit(P.DEFAULT_METRIC_THRESHOLDS[1])
    for m, (w, c) in P.MONITOR_THRESHOLDS.items():
        warn = F.when(metric == m, F.lit(w)).otherwise(warn)
        crit = F.when(metric == m, F.lit(c)).otherwise(crit)
    return F.when(value >= warn, "normal").when(value >= crit, "warning").otherwise("critical")


def metric_samples(run_log: DataFrame) -> DataFrame:
    """M2: one row per (run, metric) sample with its status."""
    s = run_log.select("run_id", "ts", F.explode("metrics").alias("metric", "value"))
    return s.withColumn("status", metric_status(F.col("metric"), F.col("value")))


def run_stats(run_log: DataFrame, alerts: DataFrame | None = None) -> DataFrame:
    """M1 (final): totals, success rate, mean processing time, last time; with ``alerts`` (and their flags, see
    ``apply_actions``) also how many are still active."""
    out = run_log.agg(
        F.count(F.lit(1)).alias("total_validations"),
        F.count_if(F.col("is_valid")).alias("successful_validations"),
        F.count_if(~F.col("is_valid")).alias("failed_validations"),
        F.avg("duration_s").alias("average_processing_time"),
        F.max("ts").alias("last_validation_time")).select(
        "*", (F.col("successful_validations") / F.greatest(F.lit(1), F.col("total_validations")))
        .alias("success_rate"))
    if alerts is None:
        return out
    return out.withColumn("active_alerts", alerts.agg(F.count_if(~F.col("resolved"))).scalar())


def running_stats(run_log: DataFrame, num_partitions: int | None = None) -> DataFrame:
    """M1 (per record) and M5 input: running totals after each run in (ts, run_id)
    order; ``pos`` is the run's 0-based position, ``prev_ts`` the time of the run
    before (one sort serves M1, M5, M8)."""
    d = ranges(run_log.select("run_id", "ts", "is_valid", "duration_s"), ["ts", "run_id"], num_partitions)
    r = add_running_sums(earlier_rows(d, ["ts"], 1), {
        "total": F.lit(1), "failed": (~F.col("is_valid")).cast("int"), "time": F.col("duration_s")})
    return r.select("run_id", "ts", F.col("prev1.ts").alias("prev_ts"), (F.col("cum_total") - 1).cast("long").alias("pos"),
                    F.col("cum_total").cast("long").alias("total_validations"),
                    F.col("cum_failed").cast("long").alias("failed_validations"),
                    (F.col("cum_total") - F.col("cum_failed")).cast("long").alias("successful_validations"),
                    (F.col("cum_failed") / F.greatest(F.lit(1.0), F.col("cum_total"))).alias("failure_rate"),
                    (F.col("cum_time") / F.col("cum_total")).alias("average_processing_time"),
                    F.col("cum_time").alias("total_processing_time"))


def _alert(alert_id: Column, ts: Column, atype: str, severity: Column | str, message: Column,
           details: Column) -> list[Column]:
    sev = severity if isinstance(severity, Column) else F.lit(severity)
    return [alert_id.alias("alert_id"), ts.alias("ts"), F.lit(atype).alias("alert_type"),
            sev.alias("severity"), message.alias("message"), details.alias("details")]


def failure_rate_alerts(run_log: DataFrame, num_partitions: int | None = None,
                        stats: DataFrame | None = None) -> DataFrame:
    """M5: after every run whose running failure rate exceeds 0.3."""
    stats = stats if stats is not None else running_stats(run_log, num_partitions)
    r = stats.where(F.col("failure_rate") > P.FAILURE_RATE_LIMIT)
    return r.select(*_alert(
        F.concat(F.lit("anomaly_detected:failure_rate:"), "run_id"), F.col("ts"), "anomaly_detected", "high",
        F.format_string("High validation failure rate detected: %.1f%%", F.col("failure_rate") * 100),
        F.create_map(F.lit("failure_rate"), F.col("failure_rate").cast("string"),
                     F.lit("total_validations"), F.col("total_validations").cast("string"),
                     F.lit("failed_validations"), F.col("failed_validations").cast("string"))))


def critical_violation_alerts(run_log: DataFrame) -> DataFrame:
    """M6: runs carrying at least one critical compliance violation."""
    crit = F.filter("violations", lambda v: v["severity"] == "critical")
    r = run_log.where(F.size(crit) > 0).withColumn("__n", F.size(crit))
    return r.select(*_alert(
        F.concat(F.lit("compliance_violation:"), "run_id"), F.col("ts"), "compliance_violation", "critical",
        F.format_string("Critical compliance violations detected: %d", "__n"),
        F.create_map(F.lit("critical_violations"), F.col("__n").cast("string"),
                     F.lit("total_violations"), F.size("violations").cast("string"))))


def issue_volume_alerts(run_log: DataFrame) -> DataFrame:
    """M7: runs with more than 10 issues."""
    r = run_log.where(F.col("n_issues") > P.ISSUE_VOLUME_LIMIT)
    return r.select(*_alert(
        F.concat(F.lit("anomaly_detected:issues:"), "run_id"), F.col("ts"), "anomaly_detected", "high",
        F.format_string("High number of validation issues: %d", "n_issues"),
        F.create_map(F.lit("total_issues"), F.col("n_issues").cast("string"))))


def degradation_alerts(run_log: DataFrame, num_partitions: int | None = None) -> DataFrame:
    """M4: sample value minus the sample two before it (same metric) < -0.1."""
    d = ranges(metric_samples(run_log).select("metric", "run_id", "ts", "value"), ["metric", "ts", "run_id"], num_partitions)
    return degradations(earlier_rows(d, ["value"], 2, "metric"))


def degradations(samples: DataFrame) -> DataFrame:
    """M4 alerts of samples that know the one two before them (``prev2``)."""
    j = samples.withColumn("prev_value", F.col("prev2.value")).withColumn("trend", F.col("value") - F.col("prev_value"))
    j = j.where(F.col("trend") < P.DEGRADATION_DROP)
    sev = F.when(F.col("trend") > P.DEGRADATION_HIGH, "medium").otherwise("high")
    return j.select(*_alert(
        F.concat(F.lit("quality_degradation:"), "metric", F.lit(":"), "run_id"), F.col("ts"),
        "quality_degradation", sev, F.concat(F.lit("Quality degradation detected in "), "metric"),
        F.create_map(F.lit("metric"), F.col("metric"), F.lit("trend"), F.col("trend").cast("string"),
                     F.lit("current_value"), F.col("value").cast("string"),
                     F.lit("previous_value"), F.col("prev_value").cast("string"))))


def history(run_log: DataFrame, keep: int = P.HISTORY_LENGTH) -> DataFrame:
    """M3: the last ``keep`` samples per metric with their positions: a top-k per metric, limited in each
    task before the shuffle, and one count per metric."""
    s = metric_samples(run_log)
    w = Window.partitionBy("metric").orderBy(F.col("ts").desc(), F.col("run_id").desc())
    last = s.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= keep)
    n = s.groupBy("metric").agg(F.count(F.lit(1)).alias("__n"))
    return (last.join(n, "metric").select("metric", "run_id", "ts", "value", "status", (F.col("__n") - F.col("__k")).alias("pos")))


def inactivity_alerts(run_log: DataFrame, num_partitions: int | None = None,
                      gap_seconds: int = P.INACTIVITY_SECONDS, stats: DataFrame | None = None) -> DataFrame:
    """M8 (batch): a gap of more than ``gap_seconds`` between consecutive runs."""
    idx = stats if stats is not None else earlier_rows(
        ranges(run_log.select("run_id", "ts"), ["ts", "run_id"], num_partitions), ["ts"], 1).withColumn("prev_ts", F.col("prev1.ts"))
    return gaps(idx, gap_seconds)


def gaps(runs: DataFrame, gap_seconds: int = P.INACTIVITY_SECONDS) -> DataFrame:
    """M8 alerts of runs that know the time of the run before them (``prev_ts``)."""
    j = runs.withColumn(
        "__gap", F.unix_timestamp(F.col("ts").cast("timestamp")) - F.unix_timestamp(F.col("prev_ts").cast("timestamp")))
    j = j.where(F.col("__gap") > gap_seconds)
    return j.select(*_alert(
        F.concat(F.lit("system_error:inactivity:"), "run_id"), F.col("ts"), "system_error", "medium",
        F.lit("No validation activity detected in the last hour"),
        F.create_map(F.lit("gap_seconds"), F.col("__gap").cast("string"),
                     F.lit("previous_validation"), F.col("prev_ts").cast("string"))))


def all_alerts(run_log: DataFrame, num_partitions: int | None = None) -> DataFrame:
    """M4-M8 together: two sorts of the run log (by metric for degradation, by
    time for running rates and gaps), shared by the monitors that need them."""
    stats = running_stats(run_log, num_partitions)
    parts = [degradation_alerts(run_log, num_partitions), failure_rate_alerts(run_log, stats=stats),
             critical_violation_alerts(run_log), issue_volume_alerts(run_log),
             inactivity_alerts(run_log, stats=stats)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def retain(alerts: DataFrame, as_of: str, days: int = P.ALERT_RETENTION_DAYS) -> DataFrame:
    """M9: drop alerts older than ``days`` before ``as_of``."""
    cutoff = F.to_timestamp(F.lit(as_of)) - F.expr(f"INTERVAL {int(days)} DAYS")
    return alerts.where(F.col("ts").cast("timestamp") >= cutoff)


def apply_actions(alerts: DataFrame, actions: DataFrame) -> DataFrame:
    """``actions(alert_id, ts, action in {acknowledge, resolve})`` -> alerts
    with ``acknowledged``/``resolved`` flags (actions on unknown ids are ignored)."""
    a = actions.groupBy("alert_id").agg(
        F.bool_or(F.col("action") == "acknowledge").alias("acknowledged"),
        F.bool_or(F.col("action") == "resolve").alias("resolved"))
    return (alerts.join(a, "alert_id", "left")
            .withColumn("acknowledged", F.coalesce("acknowledged", F.lit(False)))
            .withColumn("resolved", F.coalesce("resolved", F.lit(False))))


def action_results(alerts: DataFrame, actions: DataFrame) -> DataFrame:
    """Per action, whether it applied (``True`` when the alert id exists)."""
    ids = alerts.select("alert_id").distinct().withColumn("__known", F.lit(True))
    return (actions.join(ids, "alert_id", "left")
            .select("alert_id", "ts", "action", F.coalesce("__known", F.lit(False)).alias("applied")))


def active_alerts(alerts_with_flags: DataFrame) -> DataFrame:
    """Unresolved alerts."""
    return alerts_with_flags.where(~F.col("resolved"))


def quality_trends(run_log: DataFrame, metric: str, as_of: str, hours: int = 24) -> DataFrame:
    """Samples of ``metric`` in the ``hours`` before ``as_of`` (unknown metric -> empty)."""
    cutoff = F.to_timestamp(F.lit(as_of)) - F.expr(f"INTERVAL {int(hours)} HOURS")
    s = metric_samples(run_log)
    return s.where((F.col("metric") == metric) & (F.col("ts").cast("timestamp") >= cutoff)
                   & (F.col("ts").cast("timestamp") <= F.to_timestamp(F.lit(as_of))))


def perf_stats(run_log: DataFrame, last: int = 10) -> tuple[DataFrame, DataFrame]:
    """``(stats, last_times)``; empty log -> stats row with ``error`` set."""
    st = run_log.agg(
        F.count(F.lit(1)).alias("total_validations"), F.avg("duration_s").alias("average_time"),
        F.min("duration_s").alias("min_time"), F.max("duration_s").alias("max_time"),
        F.sum("n_rows").alias("total_rows_processed"),
        F.try_divide(F.sum("n_rows").cast("double"), F.sum("duration_s")).alias("average_rows_per_second"))
    st = st.withColumn("error", F.when(F.col("total_validations") == 0,
                                       F.lit("No performance data available")))
    newest = [F.col("ts").desc(), F.col("run_id").desc()]
    n = run_log.agg(F.count(F.lit(1))).scalar()
    tail = run_log.select("run_id", "ts", "duration_s").orderBy(*newest).limit(last)
    back = F.row_number().over(Window.orderBy(*newest))  # over ``last`` rows
    return st, tail.withColumn("pos", n - back)


def benchmark_summary(runs: DataFrame, by: str = "dataset") -> DataFrame:
    """``runs(dataset, size, rules, seconds, ok)`` -> per dataset (or ``by`` size or rules) statistics over
    successful runs and the success rate."""
    okv = F.when(F.col("ok"), F.col("seconds"))
    return runs.groupBy(by).agg(
        F.avg(okv).alias("mean_time"), F.coalesce(F.stddev_samp(okv), F.lit(0.0)).alias("std_time"),
        F.min(okv).alias("min_time"), F.max(okv).alias("max_time"),
        F.avg(F.col("ok").cast("double")).alias("success_rate"), F.count(F.lit(1)).alias("runs"))
