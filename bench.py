"""Benchmark: headline workloads at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints ONE JSON line: {"metric", "value", "unit", "queries": {...}, "sf"}.
``BENCH_ONLY=name1,name2`` times a subset (for iterating).
Each query is timed end to end (plan + execute), the median of $BENCH_REPEATS (3)
runs counts; results are collected when
small or written to the ``noop`` sink when row-sized.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPEATS = int(os.environ.get("BENCH_REPEATS", "3"))


def main():
    from pyspark.sql import functions as F

    from carecheck import registry as Rg
    from carecheck.operators import analytics as A
    from carecheck.operators import compliance as C
    from carecheck.operators import phi as H
    from carecheck.operators import rules as R
    from carecheck.operators import validate as V
    from carecheck.session import get_spark

    spark = get_spark(f"local[{CPUS}]", app="carecheck-bench", shuffle_partitions=int(CPUS) * 2,
                      spark__driver__memory="16g")
    warm_dir = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    d = SF_DIR

    def t(name):
        return spark.read.parquet(f"{d}/{name}.parquet")

    def collect(df):
        return df.collect()

    def noop(df):
        df.write.format("noop").mode("overwrite").save()

    work = {
        # the reference's core workload: all rule families over one table, one scan
        "validate_lineitem": lambda: collect(V.validate(t("lineitem"), [
            R.SchemaValidator(["l_orderkey", "l_partkey"], {"l_quantity": "float", "l_orderkey": "int"}),
            R.PHIDetector(), R.DataQualityChecker(),
            R.RangeValidator({"l_quantity": {"min": 1, "max": 50}, "l_discount": {"min": 0, "max": 0.1}}),
            R.DateValidator(["l_shipdate"], "1992-01-01", "1998-12-31"),
            R.RowCheck("discount_over_tax", "l_discount > l_tax", "warning")]).issues),
        "validate_documents": lambda: collect(V.validate(t("documents"), [R.PHIDetector(), R.DataQualityChecker()]).issues),
        "medical_codes": lambda: collect(Rg.Q["medical_codes"](spark, d)),
        "compliance_documents": lambda: collect(C.compliance_report(t("documents")).violations),
        "compliance_patients": lambda: collect(Rg.Q["compliance_overall_patients"](spark, d)),
        "phi_inventory_documents": lambda: collect(Rg.Q["phi_inventory_documents"](spark, d)),
        "anonymize_customer": lambda: noop(Rg.Q["anon_safe_harbor"](spark, d)),
        "sanitize_pages": lambda: noop(H.sanitize(t("pages"))),
        "quality_metrics_lineitem": lambda: collect(A.Profile(t("lineitem"), as_of=Rg.AS_OF).metrics()),
        "numeric_summary_lineitem": lambda: collect(A.numeric_summary(t("lineitem"))),
        "trend_events": lambda: collect(Rg.Q["trend"](spark, d)),
        "monitor_alerts": lambda: collect(Rg.Q["alert_retention"](spark, d)),
        "batch_validation_orders": lambda: collect(Rg.Q["batch_validation"](spark, d)),
        # the reference's headline case: heart-disease profile (600 k derived rows here)
        "profile_heart_disease": lambda: collect(Rg.Q["profile_heart_disease"](spark, d)),
        # one rule family at a time over lineitem, comparable with the reference's
        "rule_schema_lineitem": lambda: collect(V.validate(t("lineitem"), [R.SchemaValidator(
            ["l_orderkey", "l_comment"], {"l_quantity": "float", "l_returnflag": "int"})]).issues),
        "rule_phi_lineitem": lambda: collect(V.validate(t("lineitem"), [R.PHIDetector()]).issues),
        "rule_quality_lineitem": lambda: collect(V.validate(t("lineitem"), [R.DataQualityChecker()]).issues),
        "rule_codes_lineitem": lambda: collect(V.validate(
            t("lineitem").selectExpr("l_orderkey", "concat(l_returnflag, lpad(cast(l_linenumber AS string), 2, '0')) AS dx",
                                     "cast(l_partkey % 100000 AS string) || '-' || cast(l_suppkey % 10 AS string) AS lab"),
            [R.MedicalCodeValidator({"dx": "icd10", "lab": "loinc"}, order_by=["l_orderkey"])]).issues),
        "rule_range_lineitem": lambda: collect(V.validate(t("lineitem"), [R.RangeValidator(
            {"l_quantity": {"min": 5, "max": 45}, "l_discount": {"min": 0.01, "max": 0.09},
             "l_tax": {"max": 0.07}})]).issues),
        "rule_date_lineitem": lambda: collect(V.validate(
            t("lineitem").selectExpr("date_format(l_shipdate, 'yyyy-MM-dd') AS ship"),
            [R.DateValidator(["ship"], "1993-01-01", "1998-01-01")]).issues),
    }
    only = [w for w in os.environ.get("BENCH_ONLY", "").split(",") if w]
    if only:  # iterate on a subset; the default run times every workload
        work = {k: v for k, v in work.items() if k in only}
    # warm-up: one untimed pass over the smallest data set (JVM JIT, Python
    # workers, codegen of shared operators), then the timed pass at SF_DIR
    if warm_dir and os.path.isdir(warm_dir):
        d = warm_dir
        for fn in work.values():
            fn()
        spark.catalog.clearCache()
        d = SF_DIR
    times = {}
    for name, fn in work.items():
        runs = []
        for _ in range(REPEATS):
            t0 = time.time()
            fn()
            runs.append(time.time() - t0)
            spark.catalog.clearCache()
        times[name] = round(statistics.median(runs), 3)
    sf = os.path.basename(d.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
