"""Streaming monitors driven by Trigger.AvailableNow over a split run log,
compared with their batch twins."""
import os
import shutil
import tempfile
from datetime import datetime, timedelta

from carecheck.operators import monitor as M
from carecheck.streaming import monitor as SM
from helpers import rows


def _write_split(spark, recs, parts):
    d = tempfile.mkdtemp(prefix="carecheck-stream-")
    base = datetime(2024, 1, 1)
    data = [(str(i), base + timedelta(minutes=m), ok, 10, iss, 1.0, met, [])
            for i, (m, ok, iss, met) in enumerate(recs)]
    df = spark.createDataFrame(data, M.RUN_LOG_SCHEMA)
    step = (len(data) + parts - 1) // parts
    for p in range(parts):
        chunk = spark.createDataFrame(data[p * step:(p + 1) * step], M.RUN_LOG_SCHEMA)
        chunk.coalesce(1).write.mode("overwrite").parquet(os.path.join(d, f"part{p:02d}"))
    return df, d


def _run(spark, query_df, name, mode="append"):
    ck = tempfile.mkdtemp(prefix="carecheck-ck-")
    q = (query_df.writeStream.format("memory").queryName(name).outputMode(mode)
         .option("checkpointLocation", ck).trigger(availableNow=True).start())
    q.awaitTermination(180)
    return spark.sql(f"SELECT * FROM {name}")


def _stream(spark, d):
    src = spark.readStream.schema(M.RUN_LOG_SCHEMA).option("maxFilesPerTrigger", 1).option(
        "recursiveFileLookup", "true").parquet(d)
    return src


def test_run_stats_and_callback(spark):
    recs = [(i, i % 4 != 0, 12 if i % 5 == 0 else 0, {}) for i in range(20)]
    df, d = _write_split(spark, recs, 2)
    out = rows(_run(spark, SM.run_stats_stream(_stream(spark, d)), "stats_stream", "complete"))
    assert out[-1]["total_validations"] == 20 and out[-1]["failed_validations"] == 5
    seen = []

    def handler(batch, epoch):
        seen.append(batch.count())
        raise RuntimeError("callback failure is swallowed")

    ck = tempfile.mkdtemp(prefix="carecheck-ck-")
    q = (SM.stateless_alerts(_stream(spark, d)).writeStream.foreachBatch(SM.alert_callback(handler))
         .option("checkpointLocation", ck).trigger(availableNow=True).start())
    q.awaitTermination(180)
    assert sum(seen) == len(rows(M.issue_volume_alerts(df)))


def test_validate_stream_feeds_run_log(spark):
    from carecheck.operators import rules as R
    recs = [(i, True, 0, {}) for i in range(12)]
    _, d = _write_split(spark, recs, 3)
    src = spark.readStream.schema(M.RUN_LOG_SCHEMA).option("maxFilesPerTrigger", 1).option(
        "recursiveFileLookup", "true").parquet(d).select("run_id", "n_rows", "n_issues")
    src = src.selectExpr("run_id", "CASE WHEN CAST(run_id AS INT) % 2 = 0 THEN NULL ELSE n_rows END AS n_rows", "n_issues")
    out = tempfile.mkdtemp(prefix="carecheck-vs-")
    q = SM.validate_stream(src, [R.DataQualityChecker()], os.path.join(out, "runs"), os.path.join(out, "issues"),
                           os.path.join(out, "ck"), compliance=True)
    q.awaitTermination(180)
    runs = rows(SM.read_run_log(spark, os.path.join(out, "runs")))
    assert len(runs) == 3 and all(r["n_rows"] == 4 for r in runs)
    assert all(r["is_valid"] is True and r["n_issues"] == 1 for r in runs)  # 50 % missing: a warning
    assert all("compliance_score" in r["metrics"] for r in runs)
    assert M.run_stats(SM.read_run_log(spark, os.path.join(out, "runs"))).first()["total_validations"] == 3
    # a second stream on the same paths keeps its own runs; a replayed epoch replaces its records
    for _ in range(2):
        SM.validate_stream(src, [R.DataQualityChecker()], os.path.join(out, "runs"), os.path.join(out, "issues"),
                           os.path.join(out, "ck2")).awaitTermination(180)
        ids = [r["run_id"] for r in rows(SM.read_run_log(spark, os.path.join(out, "runs")))]
        assert len(ids) == len(set(ids)) == 6
        assert spark.read.parquet(os.path.join(out, "issues")).count() == 6
        shutil.rmtree(os.path.join(out, "ck2"))
