"""Monitoring over a run log (FIXTURES F23-F25, F28)."""
from datetime import datetime, timedelta

from carecheck.operators import monitor as M
from helpers import rows

VT = "array<struct<standard:string,severity:string,field:string,message:string>>"


def log(spark, recs):
    base = datetime(2024, 1, 1)
    data = [(str(i), base + timedelta(minutes=m), ok, 10, iss, dur, met, viol)
            for i, (m, ok, iss, dur, met, viol) in enumerate(recs)]
    return spark.createDataFrame(data, M.RUN_LOG_SCHEMA)


def test_f23_run_stats(spark):
    rl = log(spark, [(0, True, 0, 2.5, {}, []), (1, False, 0, 1.8, {}, [])])
    s = rows(M.run_stats(rl))[0]
    assert (s["total_validations"], s["successful_validations"], s["failed_validations"]) == (2, 1, 1)
    assert abs(s["average_processing_time"] - 2.15) < 1e-12 and s["success_rate"] == 0.5


def test_f24_degradation(spark):
    rl = log(spark, [(i, True, 0, 1.0, {"completeness": v}, []) for i, v in enumerate([0.9, 0.8, 0.7])])
    a = rows(M.degradation_alerts(rl))
    assert len(a) == 1 and a[0]["severity"] == "high" and a[0]["alert_type"] == "quality_degradation"


def test_f25_status(spark):
    rl = log(spark, [(0, True, 0, 1.0, {"completeness": 0.9, "unknown": 0.75}, []),
                     (1, True, 0, 1.0, {"completeness": 0.8}, []), (2, True, 0, 1.0, {"completeness": 0.6}, [])])
    st = {(r["run_id"], r["metric"]): r["status"] for r in rows(M.metric_samples(rl))}
    assert st[("0", "completeness")] == "normal" and st[("1", "completeness")] == "warning"
    assert st[("2", "completeness")] == "critical" and st[("0", "unknown")] == "warning"


def test_failure_volume_critical_inactivity(spark):
    crit = [("HIPAA", "critical", "ssn", "x")]
    rl = log(spark, [(0, False, 11, 1.0, {}, crit), (1, True, 0, 1.0, {}, []), (200, True, 0, 1.0, {}, [])])
    fr = rows(M.failure_rate_alerts(rl))
    assert [a["alert_id"] for a in fr] == [f"anomaly_detected:failure_rate:{i}" for i in range(3)]  # 1/3 > 0.3
    assert len(rows(M.issue_volume_alerts(rl))) == 1
    assert rows(M.critical_violation_alerts(rl))[0]["message"] == "Critical compliance violations detected: 1"
    ina = rows(M.inactivity_alerts(rl))
    assert [a["alert_id"] for a in ina] == ["system_error:inactivity:2"]


def test_history_and_actions(spark):
    rl = log(spark, [(i, True, 20, 1.0, {"m": i / 200}, []) for i in range(150)])
    h = rows(M.history(rl))
    assert len(h) == 100 and min(r["pos"] for r in h) == 50
    alerts = M.issue_volume_alerts(rl)
    acts = spark.createDataFrame([("anomaly_detected:issues:1", datetime(2024, 1, 2), "acknowledge"),
                                  ("anomaly_detected:issues:2", datetime(2024, 1, 2), "resolve")],
                                 "alert_id string, ts timestamp, action string")
    f = M.apply_actions(alerts, acts)
    assert len(rows(M.active_alerts(f))) == 149
    kept = rows(M.retain(alerts, "2024-01-08 00:00:00"))
    assert len(kept) == 150


def test_f28_perf_stats(spark):
    rl = log(spark, [(0, True, 5, 1.0, {}, []), (1, True, 10, 2.0, {}, []), (2, True, 15, 3.0, {}, [])])
    rl = rl.withColumn("n_rows", (rl.n_issues * 20).cast("long"))
    s, tail = M.perf_stats(rl)
    s = rows(s)[0]
    assert s["average_time"] == 2.0 and s["total_rows_processed"] == 600 and s["average_rows_per_second"] == 100.0
    assert len(rows(tail)) == 3


def test_benchmark_summary(spark):
    runs = spark.createDataFrame([("a", 1.0, True), ("a", 3.0, True), ("b", 2.0, True), ("b", 9.0, False)],
                                 "dataset string, seconds double, ok boolean")
    out = {r["dataset"]: r for r in rows(M.benchmark_summary(runs))}
    assert out["a"]["mean_time"] == 2.0 and out["b"]["std_time"] == 0.0 and out["b"]["success_rate"] == 0.5
