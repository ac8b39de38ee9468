"""Stateful streaming monitors against their batch twins."""
import os
import tempfile
from collections import defaultdict
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from carecheck.operators import monitor as M
from carecheck.plans.rowindex import PART, ranges
from carecheck.streaming import stateful as S
from helpers import rows

BASE = datetime(2024, 1, 1)
LOG = M.RUN_LOG_SCHEMA + ", source string"


def run_log(spark, recs):
    """recs: (minute, source, ok, issues, metrics)"""
    return spark.createDataFrame([(f"{i:05d}", BASE + timedelta(minutes=m), ok, 10, iss, 1.0, met, [], src)
                                  for i, (m, src, ok, iss, met) in enumerate(recs)], LOG)


def folder():
    return tempfile.mkdtemp(prefix="carecheck-st-")


def feed(spark, df, cuts, d):
    """The log as one file per part, in time order."""
    recs = df.orderBy("ts", "run_id").collect()
    for n, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(recs)])):
        spark.createDataFrame(recs[a:b], LOG).coalesce(1).write.parquet(os.path.join(d, f"part{n:03d}"))


def stream(spark, d):
    return (spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(d))


def ended(*queries):
    assert all(q.awaitTermination(120) for q in queries)


def monitored(spark, d, path, ck, **kw):
    ended(S.reduce_runs(stream(spark, d), path, f"{ck}/reduce"))
    ended(*S.write_states(spark, path, f"{ck}/states", **kw))


def by_source(batch, log):
    out = []
    for (s,) in log.select("source").distinct().collect():
        out += rows(batch(log.where(F.col("source") == s)))
    return out


def ids(alerts):
    return sorted(a["alert_id"] for a in alerts)


def test_stream_equals_batch_with_a_metric_and_a_source_that_hold_a_third(spark):
    recs = []
    for i in range(360):
        hot = i % 3 == 0
        v = [0.9, 0.85, 0.7, 0.95, 0.8, 0.6, 0.9, None][i * 7 % 8]
        recs.append((i * 5 + (70 if i > 200 else 0), "hot" if hot else f"s{i % 11}", i % 4 > 0 or i > 300, 12 if i % 50 == 0 else 0,
                     {"completeness" if hot else f"m{i % 13}": v, "accuracy": 1 - i % 9 / 20}))
    log = run_log(spark, recs)
    d, path, ck = folder(), folder(), folder()
    feed(spark, log, [1, 150, 151, 153, 280], d)
    monitored(spark, d, path, ck, watermark="10000 minutes")
    got = S.read_alerts(spark, path)
    of = lambda prefix: [a for a in rows(got) if a["alert_id"].startswith(prefix)]
    want = rows(M.degradation_alerts(log))
    key = lambda a: (a["alert_id"], a["severity"], a["details"]["previous_value"], a["details"]["current_value"], round(float(a["details"]["trend"]), 9))
    assert want and sorted(map(key, of("quality_degradation"))) == sorted(map(key, want))
    want = by_source(M.failure_rate_alerts, log)
    key = lambda a: (a["alert_id"], a["details"]["total_validations"], a["details"]["failed_validations"])
    assert want and sorted(map(key, of("anomaly_detected:failure_rate"))) == sorted(map(key, want))
    assert ids(of("system_error")) == ids(by_source(M.inactivity_alerts, log)) != []
    assert ids(of("anomaly_detected:issues")) == ids(rows(M.issue_volume_alerts(log))) != []
    held = defaultdict(list)
    for r in sorted(rows(S.read_history(spark, path)), key=lambda r: r["place"]):
        held[r["metric"]].append((r["run_id"], r["value"], r["status"]))
    want = defaultdict(list)
    for r in sorted(rows(M.history(log)), key=lambda r: r["pos"]):
        want[r["metric"]].append((r["run_id"], r["value"], r["status"]))
    assert held == want and len(held["accuracy"]) == 100


def test_reduced_rows_are_bounded_and_a_hot_metric_is_spread(spark):
    log = run_log(spark, [(i, "one", True, 0, {"hot" if i % 3 == 0 else f"m{i}": 0.5}) for i in range(3000)])
    rest, _ = S._reduce_metrics(log, 0)
    assert rest.where("metric = 'hot'").count() == 102
    d = ranges(M.metric_samples(log), ["metric", "ts", "run_id"], 8)
    sizes = [r["count"] for r in d.groupBy(PART).count().collect()]
    assert max(sizes) <= 2 * 3000 / 8 and d.where("metric = 'hot'").select(PART).distinct().count() > 2


def test_replayed_micro_batches_and_restarts_change_nothing(spark):
    log = run_log(spark, [(i, "a", i % 3 > 0, 0, {"accuracy": [0.9, 0.8, 0.6][i % 3]}) for i in range(24)])
    d, path, ck = folder(), folder(), folder()
    feed(spark, log, [10], d)
    monitored(spark, d, path, ck)
    first = set(map(repr, S.read_alerts(spark, path).collect()))
    ended(S.reduce_runs(stream(spark, d), path, folder()))  # the same epochs again under a new checkpoint
    ended(*S.write_states(spark, path, f"{ck}/states"))
    assert set(map(repr, S.read_alerts(spark, path).collect())) == first
    assert len(rows(S.read_history(spark, path))) == 24


def test_silence_is_reported_once(spark):
    log = run_log(spark, [(0, "quiet", True, 0, {}), (10, "busy", True, 0, {}), (300, "busy", True, 0, {}), (310, "busy", True, 0, {}),
                          (600, "quiet", True, 0, {}), (610, "busy", True, 0, {})])
    d, path, ck = folder(), folder(), folder()
    feed(spark, log, [2, 4], d)
    monitored(spark, d, path, ck, watermark="1 minute", files=1)
    found = [a["alert_id"] for a in rows(S.read_alerts(spark, path)) if a["alert_type"] == "system_error"]
    assert len(found) == len(set(found))
    quiet = [a for a in found if "quiet" in a or a.endswith("00004")]
    assert quiet == ["system_error:inactivity:quiet:2024-01-01T00:00:00"] or quiet == ["system_error:inactivity:00004"]


def test_metric_state_expires(spark):
    d, path, ck = folder(), folder(), folder()
    feed(spark, run_log(spark, [(0, "a", True, 0, {"accuracy": 0.9}), (1, "a", True, 0, {"accuracy": 0.9})]), [], d)
    monitored(spark, d, path, ck, ttl_ms=1)
    feed(spark, run_log(spark, [(0, "a", True, 0, {"accuracy": 0.9})] * 2 + [(2, "a", True, 0, {"accuracy": 0.1})]).where("run_id = '00002'"), [],
         os.path.join(d, "later"))
    monitored(spark, d, path, ck, ttl_ms=1)
    assert [r["run_id"] for r in rows(S.read_history(spark, path))] == ["00002"]  # the two before were forgotten
    assert not [a for a in rows(S.read_alerts(spark, path)) if a["alert_type"] == "quality_degradation"]


def run_query(spark, df, name, mode="append"):
    q = (df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", folder())
         .trigger(availableNow=True).start())
    ended(q)
    return spark.table(name)


def alert_files(spark, parts, d):
    for n, part in enumerate(parts):
        spark.createDataFrame([(i, BASE + timedelta(hours=h), "anomaly_detected", "high") for i, h in part],
                              "alert_id string, ts timestamp, alert_type string, severity string").coalesce(1).write.parquet(f"{d}/p{n}")


def file_stream(spark, d, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(d)


ALERTS = "alert_id string, ts timestamp, alert_type string, severity string"


def test_retention_expires_state(spark):
    d = folder()
    parts = [[("a", 0), ("b", 30), ("a", 0)], [("c", 24 * 7 + 12)], [("d", 24 * 9)]]
    alert_files(spark, parts, d)
    out = rows(run_query(spark, S.retained(file_stream(spark, d, ALERTS)), "kept_alerts"))
    kept = [r["alert_id"] for r in out if r["state"] == "kept"]
    gone = {r["alert_id"] for r in out if r["state"] == "expired"}
    assert sorted(kept) == ["a", "b", "c", "d"]
    every = spark.createDataFrame([(i, BASE + timedelta(hours=h)) for p in parts for i, h in p], "alert_id string, ts timestamp").distinct()
    as_of = BASE + timedelta(hours=24 * 9) - timedelta(minutes=10)
    assert set(kept) - gone == {r["alert_id"] for r in rows(M.retain(every, str(as_of)))}


def test_actions_join_alerts_from_both_sides(spark):
    alerts, acts = folder(), folder()
    alert_files(spark, [[("early", 10), ("acked", 11), ("both", 12), ("none", 13)], [("resolved", 20), ("late", 21)],
                        [("end", 24 * 30)], [("end1", 24 * 30 + 2)], [("end2", 24 * 30 + 3)]], alerts)
    parts = [[("early", 9.5, "acknowledge"), ("acked", 11.5, "acknowledge"), ("both", 12, "acknowledge"), ("ghost", 12, "resolve")],
             [("both", 60, "resolve"), ("resolved", 61, "resolve"), ("resolved", 62, "acknowledge")],
             [("end", 24 * 30 + 1, "resolve")], [("end1", 24 * 30 + 2, "resolve")], [("late", 22, "resolve"), ("end2", 24 * 30 + 3, "acknowledge")]]
    kind = "alert_id string, ts timestamp, action string"
    for n, part in enumerate(parts):
        spark.createDataFrame([(i, BASE + timedelta(hours=h), a) for i, h, a in part], kind).coalesce(1).write.parquet(f"{acts}/p{n}")
    joined = run_query(spark, S.acted_on(file_stream(spark, alerts, ALERTS), file_stream(spark, acts, kind), "2 hours"), "acted")
    done = {"early", "acked", "both", "none", "resolved", "late"}
    every = spark.createDataFrame([(i, None) for i in done], "alert_id string, ts timestamp")
    in_time = spark.createDataFrame([(i, a) for p in parts for i, _, a in p if i != "late"], "alert_id string, action string")
    want = {r["alert_id"]: (r["acknowledged"], r["resolved"]) for r in rows(M.apply_actions(every, in_time))}
    got = {r["alert_id"]: (r["acknowledged"], r["resolved"]) for r in rows(S.flags(joined)) if r["alert_id"] in done}
    assert got == want and want["early"] == (True, False) and want["both"] == (True, True) and want["late"] == (False, False)
    applied = {(r["alert_id"], r["action"]): r["applied"] for r in rows(S.results(joined))}
    assert applied[("ghost", "resolve")] is False and applied[("both", "resolve")] is True and ("late", "resolve") not in applied
