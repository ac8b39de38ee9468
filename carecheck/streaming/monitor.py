"""Structured Streaming twins of the batch monitors: M1, M6, M7, M13, and the
streaming validation that writes the run log.  ``streaming.stateful`` has the
monitors that keep state (M3, M4, M5, M8, M9) and M10.

Input: a streaming run log (``operators.monitor.RUN_LOG_SCHEMA`` plus a
``source`` column naming the validated table where a monitor works by source).

* M1  ``run_stats_stream``  -- global streaming aggregate (one state row).
* M6/M7 ``stateless_alerts`` -- filters, no state.
* M13 ``alert_callback`` -- ``foreachBatch`` hook, errors in the callback are
  logged and swallowed.
"""

from __future__ import annotations

import logging
from typing import Callable

from pyspark.sql import DataFrame

from carecheck.operators import monitor as M

log = logging.getLogger(__name__)


def run_stats_stream(stream: DataFrame) -> DataFrame:
    """M1: running totals; write with outputMode ``complete`` or ``update``."""
    return M.run_stats(stream)


def stateless_alerts(stream: DataFrame) -> DataFrame:
    """M6 + M7 per run."""
    return M.critical_violation_alerts(stream).unionByName(M.issue_volume_alerts(stream))


# --------------------------------------------------------------------------
# M13
# --------------------------------------------------------------------------
def alert_callback(fn: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """Wrap a per-micro-batch alert handler for ``writeStream.foreachBatch``;
    handler errors are logged and do not stop the stream."""
    def run(batch: DataFrame, epoch_id: int) -> None:
        try:
            fn(batch, epoch_id)
        except Exception as e:  # noqa: BLE001 - callback errors are swallowed by design
            log.warning("alert callback failed in epoch %s: %s", epoch_id, e)
    return run


# --------------------------------------------------------------------------
# Streaming validation feeding the run log
# --------------------------------------------------------------------------
def validate_stream(stream: DataFrame, rules: list, run_log_path: str, issues_path: str,
                    checkpoint_location: str, trigger: dict | None = None, compliance: bool = False):
    """Validate every micro-batch of ``stream`` with ``rules``; write its
    issues below ``issues_path`` and one run-log row below ``run_log_path``
    (parquet).  A run's id is a digest of the stream's checkpoint location and
    the epoch, and its files lie in a folder of that name that is overwritten:
    a replayed epoch replaces its own records, and several streams (or a stream
    with a new checkpoint) can write to one path.  The batch is validated once,
    the run log counts the written issues.  Returns the started
    ``StreamingQuery``."""
    import hashlib
    import time as _time

    from carecheck.operators.compliance import compliance_report
    from carecheck.operators.validate import ValidationResult, run_record, validate

    name = hashlib.sha256(checkpoint_location.encode()).hexdigest()[:12]

    def per_batch(batch: DataFrame, epoch_id: int) -> None:
        t0 = _time.time()
        run_id = f"{name}-{epoch_id}"
        issues = validate(batch, rules).issues
        where = f"{issues_path}/run_id={run_id}"
        issues.write.mode("overwrite").parquet(where)
        res = ValidationResult(batch, batch.sparkSession.read.schema(issues.schema).parquet(where))
        rep = compliance_report(batch) if compliance else None
        run_record(res, run_id, _time.time() - t0, rep).write.mode("overwrite").parquet(f"{run_log_path}/run={run_id}")

    w = stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint_location)
    w = w.trigger(**trigger) if trigger else w.trigger(availableNow=True)
    return w.start()


def read_run_log(spark, run_log_path: str) -> DataFrame:
    """The run log written by ``validate_stream``, one row per run."""
    return spark.read.parquet(run_log_path).drop("run")
