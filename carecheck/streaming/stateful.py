"""Stateful monitors on a streaming run log (M3, M4, M5, M8, M9), in two steps.

1. ``reduce_runs`` cuts every micro-batch down on the JVM: it is sorted into
   written range partitions, looked through with ``lag`` and a halo, so a
   metric or source that holds a third of the rows spreads over many tasks.
   Alerts between rows of one micro-batch are final here.  What the next
   micro-batch must know is a bounded rest: of each metric the first two and
   the last 100 samples, of each source one row of counts.
2. ``metric_states`` and ``source_states`` read these rests as a stream and
   hold the state across micro-batches with ``transformWithStateInPandas``: the
   last 100 samples of a metric in a list state (with a TTL), the totals of a
   source in a value state with an event-time timer for silence.  A key brings
   at most ``HISTORY_LENGTH + 2`` rows per micro-batch of step 1 into Python.

Folders below ``path``: ``metrics`` and ``sources`` (the rests), ``running``
(each run's counts within its micro-batch), ``alerts``; all by ``epoch``.  A
replayed micro-batch overwrites its own files; the states skip epochs they
have seen.  ``retained`` keeps alerts for seven days of event time.  The
states need the RocksDB state store (``session.get_spark`` sets it).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from carecheck.functions import patterns as P
from carecheck.operators import monitor as M
from carecheck.plans.rowindex import earlier_rows, plain, positions, ranges, sums_before

IDLE_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"
METRIC_REST = "metric string, epoch long, n long, pos long, run_id string, ts timestamp, value double, status string"
SOURCE_REST = "source string, epoch long, n long, failed long, first_run string, first_ts timestamp, ts timestamp"
ALERT = "alert_id string, ts timestamp, alert_type string, severity string, message string, details map<string,string>"
HISTORY = "run_id string, value double, status string"
METRIC_OUT = f"kind string, metric string, epoch long, place int, {ALERT}, {HISTORY}"
SOURCE_OUT = f"kind string, source string, epoch long, total_before long, failed_before long, {ALERT}"


# --------------------------------------------------------------------------
# step 1: each micro-batch on its own
# --------------------------------------------------------------------------
def _reduce_metrics(batch: DataFrame, epoch: int) -> tuple[DataFrame, DataFrame]:
    """``(rest, alerts)`` of one micro-batch's samples."""
    d = ranges(M.metric_samples(batch).select("metric", "run_id", "ts", "value", "status"), ["metric", "ts", "run_id"])
    alerts = M.degradations(earlier_rows(d, ["value"], 2, "metric"))
    n = d.groupBy("metric").agg(F.count(F.lit(1)).alias("n"))
    at = positions(d, "pos", "metric").join(n.withColumnRenamed("metric", "__m"), F.col("metric").eqNullSafe(F.col("__m")))
    rest = at.where((F.col("pos") < 2) | (F.col("pos") >= F.col("n") - P.HISTORY_LENGTH))
    return rest.select("metric", F.lit(epoch).cast("long").alias("epoch"), "n", "pos", "run_id", "ts", "value", "status"), alerts


def _reduce_sources(batch: DataFrame, epoch: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(rest, running, alerts)``: per source one row, per run its counts within the micro-batch."""
    d = ranges(batch.select("source", "run_id", "ts", "is_valid"), ["source", "ts", "run_id"])
    bad = F.when(F.col("is_valid"), 0).otherwise(1).cast("long")
    running = plain(sums_before(d, {"n": F.lit(1).cast("long"), "failed": bad}, "source")).select(
        "source", "run_id", "ts", (F.col("n") + 1).alias("n"), (F.col("failed") + bad).alias("failed"))
    first = F.min(F.struct("ts", "run_id"))
    rest = d.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(bad).alias("failed"), first.alias("f"), F.max("ts").alias("ts"))
    rest = rest.select("source", F.lit(epoch).cast("long").alias("epoch"), "n", "failed", F.col("f.run_id").alias("first_run"),
                       F.col("f.ts").alias("first_ts"), "ts")
    gaps = M.gaps(earlier_rows(d, ["ts"], 1, "source").withColumn("prev_ts", F.col("prev1.ts")))
    return rest, running, gaps


def reduce_runs(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """Step 1 as a started query.  ``stream``: a run log with a ``source`` column."""
    if "source" not in stream.columns:
        raise ValueError("the run log needs a source column")

    def per_batch(batch: DataFrame, epoch: int) -> None:
        def put(df: DataFrame, what: str) -> None:
            df.write.mode("overwrite").parquet(f"{path}/{what}/epoch={epoch}")

        batch = batch.withColumn("ts", F.col("ts").cast("timestamp"))
        metrics, drops = _reduce_metrics(batch, epoch)
        sources, running, gaps = _reduce_sources(batch, epoch)
        put(running, "running")  # before the rest that refers to it
        put(M.critical_violation_alerts(batch).unionByName(M.issue_volume_alerts(batch)).unionByName(drops).unionByName(gaps)
            .withColumn("ts", F.col("ts").cast("timestamp")), "alerts/within")
        put(metrics.drop("epoch"), "metrics")
        put(sources.drop("epoch"), "sources")

    w = stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    return w.trigger(**(trigger or {"availableNow": True})).start()


# --------------------------------------------------------------------------
# step 2: state across micro-batches
# --------------------------------------------------------------------------
def _by_epoch(rows: Iterator[pd.DataFrame]) -> list[tuple[int, list]]:
    """The few rows that a key has of each epoch, in order."""
    out: dict[int, list] = {}
    for chunk in rows:
        for r in chunk.itertuples(index=False):
            out.setdefault(int(r.epoch), []).append(r)
    return sorted(out.items())


class MetricState(StatefulProcessor):
    """M3 and M4 of one metric: its last samples, and drops between a micro-batch and the samples before it."""

    def __init__(self, ttl_ms: int | None) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getListState("last", "run_id string, ts timestamp, value double, status string", self.ttl_ms)
        self.seen = handle.getValueState("seen", "epoch long", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        (metric,) = key
        last = [tuple(x) for x in self.last.get()] if self.last.exists() else []
        seen = self.seen.get()[0] if self.seen.exists() else -1
        out = []
        for epoch, own in _by_epoch(rows):
            if epoch <= seen:
                continue
            seen = epoch
            own = [(r.run_id, r.ts, None if pd.isna(r.value) else r.value, r.status, r.pos, r.n) for r in sorted(own, key=lambda r: r.pos)]
            known = last[-2:]
            for at, x in enumerate(own[:2]):
                line = known + [y[:4] for y in own[:at + 1]]
                drop = x[2] - line[-3][2] if len(line) > 2 and None not in (x[2], line[-3][2]) else 0.0
                if x[4] == at and drop < P.DEGRADATION_DROP:
                    out.append(("alert", metric, epoch, None, f"quality_degradation:{metric}:{x[0]}", x[1], "quality_degradation",
                                "medium" if drop > P.DEGRADATION_HIGH else "high", f"Quality degradation detected in {metric}",
                                {"metric": str(metric), "trend": str(drop), "current_value": str(x[2]), "previous_value": str(line[-3][2])},
                                x[0], x[2], x[3]))
            last = (last + [x[:4] for x in own if x[4] >= x[5] - P.HISTORY_LENGTH])[-P.HISTORY_LENGTH:]
            out += [("history", metric, epoch, k, None, x[1], None, None, None, None, x[0], x[2], x[3]) for k, x in enumerate(last)]
        if out:
            self.last.put(last)
            self.seen.update((seen,))
        yield pd.DataFrame(out, columns=_names(METRIC_OUT))


class SourceState(StatefulProcessor):
    """M5 and M8 of one source: its totals before each micro-batch, gaps between micro-batches, and silence."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.totals = handle.getValueState("totals", "epoch long, n long, failed long, ts timestamp, silent boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        (source,) = key
        seen, n, failed, last, silent = self.totals.get() if self.totals.exists() else (-1, 0, 0, None, False)
        out = []
        for epoch, own in _by_epoch(rows):
            if epoch <= seen:
                continue
            (r,) = own
            seen = epoch
            gap = (r.first_ts - pd.Timestamp(last)).total_seconds() if last is not None else 0
            alert = (None,) * 6
            if gap > P.INACTIVITY_SECONDS and not silent:  # a silence that the timer reported is known
                alert = (f"system_error:inactivity:{r.first_run}", r.first_ts, *_SILENT,
                         {"previous_validation": str(pd.Timestamp(last)), "gap_seconds": str(int(gap))})
            out.append(("base", source, epoch, n, failed, *alert))
            n, failed, silent = n + int(r.n), failed + int(r.failed), False
            last = r.ts if last is None else max(r.ts, pd.Timestamp(last))
        if out:
            self.totals.update((seen, n, failed, pd.Timestamp(last).to_pydatetime(), silent))
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(int(pd.Timestamp(last).timestamp() * 1000) + P.INACTIVITY_SECONDS * 1000)
        yield pd.DataFrame(out, columns=_names(SOURCE_OUT))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        (source,) = key
        epoch, n, failed, last, _ = self.totals.get()
        self.totals.update((epoch, n, failed, last, True))
        since = pd.Timestamp(last)
        yield pd.DataFrame([("silence", source, epoch, n, failed, f"system_error:inactivity:{source}:{since.isoformat()}",
                             since + pd.Timedelta(seconds=P.INACTIVITY_SECONDS), *_SILENT,
                             {"last_validation_time": since.isoformat(), "inactive_duration_hours": "1"})], columns=_names(SOURCE_OUT))


_SILENT = ("system_error", "medium", "No validation activity detected in the last hour")


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.replace("map<string,string>", "map").split(", ")]


def _rest(spark: SparkSession, path: str, what: str, schema: str, files: int) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{path}/{what}")


def metric_states(spark: SparkSession, path: str, ttl_ms: int | None = P.ALERT_RETENTION_DAYS * 86_400_000, files: int = 1000) -> DataFrame:
    """Rows of kind ``alert`` (M4) and ``history`` (M3: after each epoch all samples held, ``place`` counts from
    the oldest).  A metric without samples for ``ttl_ms`` of processing time is forgotten.  ``files`` bounds
    what one trigger reads of step 1."""
    return _rest(spark, path, "metrics", METRIC_REST, files).groupBy("metric").transformWithStateInPandas(
        MetricState(ttl_ms), METRIC_OUT, "Append", "ProcessingTime")


def source_states(spark: SparkSession, path: str, watermark: str = "10 minutes", files: int = 1000) -> DataFrame:
    """Rows of kind ``base`` (the totals before each epoch, with a gap alert if there was one) and ``silence``
    (no run for an hour of event time)."""
    return (_rest(spark, path, "sources", SOURCE_REST, files).withWatermark("ts", watermark).groupBy("source")
            .transformWithStateInPandas(SourceState(), SOURCE_OUT, "Append", "EventTime"))


def failure_rates(spark: SparkSession, path: str, bases: DataFrame) -> DataFrame:
    """M5 alerts of the epochs in ``bases`` (rows of kind ``base``): each run's counts within its micro-batch
    plus the source's totals before it."""
    epochs = [r.epoch for r in bases.select("epoch").distinct().collect()]  # of one trigger
    b = bases.select(F.col("source").alias("__s"), F.col("epoch").alias("__e"), "total_before", "failed_before")
    runs = spark.read.parquet(f"{path}/running").where(F.col("epoch").isin(epochs))
    j = runs.join(b, (F.col("epoch") == F.col("__e")) & F.col("source").eqNullSafe(F.col("__s")))
    total, failed = F.col("total_before") + F.col("n"), F.col("failed_before") + F.col("failed")
    return M.failure_rate_alerts(None, stats=j.select(
        "run_id", "ts", total.alias("total_validations"), failed.alias("failed_validations"), (failed / total).alias("failure_rate")))


def _alerts_of(rows: DataFrame) -> DataFrame:
    return rows.where("alert_id is not null").select(*_names(ALERT))


def write_states(spark: SparkSession, path: str, checkpoint: str, watermark: str = "10 minutes", trigger: dict | None = None,
                 ttl_ms: int | None = P.ALERT_RETENTION_DAYS * 86_400_000, files: int = 1000) -> list:
    """Step 2 as two started queries: alerts go to ``path/alerts``, histories to ``path/history``."""
    def metrics(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        _alerts_of(batch).write.mode("overwrite").parquet(f"{path}/alerts/metrics/epoch={epoch}")
        (batch.where("kind = 'history'").select("metric", F.col("epoch").alias("run_epoch"), "place", "ts", "run_id", "value", "status")
         .write.mode("overwrite").parquet(f"{path}/history/epoch={epoch}"))
        batch.unpersist()

    def sources(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        found = _alerts_of(batch).unionByName(failure_rates(spark, path, batch.where("kind = 'base'")))
        found.write.mode("overwrite").parquet(f"{path}/alerts/sources/epoch={epoch}")
        batch.unpersist()

    def start(df: DataFrame, fn, name: str, idle: bool):
        w = df.writeStream.foreachBatch(fn).option("checkpointLocation", f"{checkpoint}/{name}")
        before = spark.conf.get(IDLE_BATCHES)
        spark.conf.set(IDLE_BATCHES, str(idle).lower())  # a query keeps the settings it was started with
        try:
            return w.trigger(**(trigger or {"availableNow": True})).start()
        finally:
            spark.conf.set(IDLE_BATCHES, before)

    # timers need batches without data; the TTL does not, and Spark would run them without end for it
    return [start(metric_states(spark, path, ttl_ms, files), metrics, "metrics", False),
            start(source_states(spark, path, watermark, files), sources, "sources", True)]


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    """All alerts so far."""
    parts = [spark.read.schema(f"{ALERT}, epoch long").parquet(f"{path}/alerts/{p}").drop("epoch") for p in ("within", "metrics", "sources")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """M3: the last samples of each metric, as after its latest micro-batch."""
    h = spark.read.parquet(f"{path}/history")
    latest = h.groupBy(F.col("metric").alias("__m")).agg(F.max("run_epoch").alias("__e"))
    return (h.join(latest, F.col("metric").eqNullSafe(F.col("__m")) & (F.col("run_epoch") == F.col("__e")))
            .select("metric", "place", "run_id", "ts", "value", "status"))


# --------------------------------------------------------------------------
# M9: retention on the stream
# --------------------------------------------------------------------------
class Retention(StatefulProcessor):
    """One alert: reported as ``kept`` when it comes, as ``expired`` when its time is over; then its state goes."""

    def __init__(self, days: int) -> None:
        self.ms = days * 86_400_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.alert = handle.getValueState("alert", "ts timestamp, alert_type string, severity string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        (alert_id,) = key
        out = []
        for chunk in rows:
            for r in chunk.itertuples(index=False):
                if not self.alert.exists():  # a repeated id is the same alert
                    self.alert.update((r.ts.to_pydatetime(), r.alert_type, r.severity))
                    self.handle.registerTimer(int(r.ts.timestamp() * 1000) + self.ms)
                    out.append((alert_id, r.ts, r.alert_type, r.severity, "kept"))
        yield pd.DataFrame(out, columns=["alert_id", "ts", "alert_type", "severity", "state"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        ts, alert_type, severity = self.alert.get()
        self.alert.clear()
        yield pd.DataFrame([(key[0], ts, alert_type, severity, "expired")], columns=["alert_id", "ts", "alert_type", "severity", "state"])


def retained(alerts: DataFrame, days: int = P.ALERT_RETENTION_DAYS, watermark: str = "10 minutes") -> DataFrame:
    """M9: ``alert_id, ts, alert_type, severity, state``: every alert as ``kept``, and as ``expired`` once the
    watermark is ``days`` past it.  The state holds the alerts of so many days."""
    a = alerts.select("alert_id", F.col("ts").cast("timestamp").alias("ts"), "alert_type", "severity").withWatermark("ts", watermark)
    return a.groupBy("alert_id").transformWithStateInPandas(
        Retention(days), "alert_id string, ts timestamp, alert_type string, severity string, state string", "Append", "EventTime")


# --------------------------------------------------------------------------
# Alerts and actions
# --------------------------------------------------------------------------
def acted_on(alerts: DataFrame, actions: DataFrame, watermark: str = "1 hour", days: int = P.ALERT_RETENTION_DAYS,
             early: str = "1 hour") -> DataFrame:
    """M10 on streams: one row per alert and action on it, alerts without any action, and actions on unknown
    ids (their alert columns null), once the watermarks rule out a partner.

    An action belongs to the alert of its id when it comes at most ``early`` before it and at most ``days``
    after it, which bounds the state on both sides.  What arrives behind the watermark is dropped."""
    a = alerts.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    b = actions.select(F.col("alert_id").alias("action_alert_id"), F.col("ts").cast("timestamp").alias("action_ts"),
                       "action").withWatermark("action_ts", watermark)
    on = ((F.col("alert_id") == F.col("action_alert_id"))
          & (F.col("action_ts") >= F.col("ts") - F.expr(f"INTERVAL {early}"))
          & (F.col("action_ts") <= F.col("ts") + F.expr(f"INTERVAL {int(days)} DAYS")))
    return a.join(b, on, "full_outer")


def flags(joined: DataFrame) -> DataFrame:
    """The alerts of ``acted_on``'s rows with ``acknowledged`` and ``resolved``, as ``monitor.apply_actions``."""
    is_ = lambda what: F.coalesce(F.bool_or(F.col("action") == what), F.lit(False))
    other = [c for c in joined.columns if c not in ("alert_id", "action_alert_id", "action_ts", "action")]
    return (joined.where("alert_id is not null").groupBy("alert_id").agg(
        *[F.first(c).alias(c) for c in other], is_("acknowledge").alias("acknowledged"), is_("resolve").alias("resolved")))


def results(joined: DataFrame) -> DataFrame:
    """Per action of ``acted_on``'s rows whether it applied, as ``monitor.action_results``."""
    return (joined.where("action_alert_id is not null")
            .select(F.col("action_alert_id").alias("alert_id"), F.col("action_ts").alias("ts"), "action",
                    F.col("alert_id").isNotNull().alias("applied")))
