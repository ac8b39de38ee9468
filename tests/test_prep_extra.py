"""P1-P3 preparation, X5 full report, remaining sources/sinks and catalog ops."""
import os
import tempfile
from datetime import datetime

from carecheck.operators import analytics as A
from carecheck.operators import compliance as C
from carecheck.operators import prep
from carecheck.operators import rulesets as RS
from carecheck.operators import rules as R
from carecheck.operators import validate as V
from carecheck.sources import io as S
from helpers import rows


def test_p1_p3(spark):
    df = spark.createDataFrame([("2020-03-01", "X", None, 5.0), ("bad", None, 3, float("nan"))],
                               "date string, location string, total_cases long, new_cases double")
    kept = prep.select_existing(df, ["date", "location", "total_cases", "new_cases", "iso_code"])
    assert kept.columns == ["date", "location", "total_cases", "new_cases"]
    out = rows(prep.coerce_and_fill(kept, "date", formats=["yyyy-MM-dd"]))
    assert out[0]["date"] == datetime(2020, 3, 1) and out[1]["date"] is None
    assert out[0]["total_cases"] == 0 and out[1]["location"] == "0" and out[1]["new_cases"] == 0.0
    assert [r["date"] for r in rows(prep.head(df, 1, ["date"]))] == ["2020-03-01"]


def test_x5_full_report(spark):
    df = spark.createDataFrame([(datetime(2024, 1, d), d, float(d * d), "a" if d % 2 else "b") for d in range(1, 11)],
                               "ts timestamp, k long, y double, c string")
    rep = A.full_report(df, tie_breaker=["k"], as_of="2024-01-11 00:00:00")
    assert set(rep) >= {"quality_metrics", "anomalies", "trends", "numeric_summary", "categorical_summary"}
    t = {r["metric"]: r["trend"] for r in rows(rep["trends"])}
    assert t["y"] == "increasing"
    assert 0 < rows(rep["overall"])[0]["overall_quality"] <= 1


def test_records_manifest_and_writer(spark):
    recs = spark.createDataFrame([('{"patient_id": "1", "age": 30}',), ('{"patient_id": "2"}',)], "value string")
    out = rows(S.from_records(spark, recs, "patient_id string, age long"))
    assert out == [{"patient_id": "1", "age": 30}, {"patient_id": "2", "age": None}]
    d = tempfile.mkdtemp(prefix="carecheck-files-")
    for name, body in [("ok.csv", "a\n1\n"), ("x.exe", "zz")]:
        with open(os.path.join(d, name), "w") as f:
            f.write(body)
    adm = {r["file_name"]: r["admitted"] for r in rows(S.admit_files(S.file_manifest(spark, d)))}
    assert adm == {"ok.csv": True, "x.exe": False}
    issues = V.validate(spark.createDataFrame([(None,)], "a string"), [R.DataQualityChecker()]).issues
    target = os.path.join(tempfile.mkdtemp(prefix="carecheck-out-"), "issues")
    S.write_issues(issues, target)
    assert spark.read.parquet(target).count() == 2


def test_custom_template_and_rule_targets(spark):
    cat = RS.create_custom_template(RS.template_catalog(spark), "mine", "My template",
                                    [C.CustomRule("r", "^X", "starts with X", "low", "code")])
    assert {r["template"] for r in rows(RS.list_templates(cat))} >= {"mine", "ehr"}
    from carecheck.plans import catalog as K
    cols = K.columns_table(spark, {"t": spark.createDataFrame([("a", "b")], "patient_id string, note string")})
    tg = {(r["column_name"], r["rule_id"]) for r in rows(C.rule_targets(cols, RS.template_rules("ehr")))}
    assert ("patient_id", "patient_id_format") in tg and ("note", "patient_id_format") not in tg


def test_validate_with_compliance_and_analytics(spark):
    import json
    df = spark.createDataFrame([("John Doe", 30.0), ("Jane Roe", None)], "patient_name string, age double")
    r = V.validate(df, [R.DataQualityChecker()], compliance=True, template="unknown_tpl", analytics=True)
    assert rows(r.compliance.overall())[0]["template_applied"] == "unknown_tpl"
    assert "quality_metrics" in r.analytics
    doc = json.loads(rows(S.result_document(r.issues))[0]["json"])
    assert doc["total_issues"] == 1 and doc["issues"][0]["column"] == "age"


def test_rule_store_checks_and_action_results(spark):
    import pytest
    from carecheck.operators import monitor as M
    with pytest.raises(ValueError):
        RS.rule_rows(spark, [C.CustomRule("", "x")])
    store = RS.rule_rows(spark, [C.CustomRule("r1", "a")])
    assert RS.rule_exists(store, "custom", "r1") and not RS.rule_exists(store, "custom", "r2")
    alerts = spark.createDataFrame([("a1",)], "alert_id string")
    acts = spark.createDataFrame([("a1", datetime(2024, 1, 1), "resolve"), ("zz", datetime(2024, 1, 1), "resolve")],
                                 "alert_id string, ts timestamp, action string")
    got = {r["alert_id"]: r["applied"] for r in rows(M.action_results(alerts, acts))}
    assert got == {"a1": True, "zz": False}


def test_odd_column_names(spark):
    from carecheck.operators import phi as H
    df = spark.createDataFrame([("John Doe", 1.0, "a@b.com", datetime(2024, 1, 1)),
                                ("Jane Roe", None, "x", datetime(2024, 1, 2)),
                                ("Jim Poe", 3.0, "y", datetime(2024, 1, 3))],
                               "`patient.name` string, `lab value` double, `e-mail` string, `visit date` timestamp")
    r = V.validate(df, [R.PHIDetector(), R.DataQualityChecker(), R.RangeValidator({"lab value": {"min": 2}}),
                        R.DateValidator(["visit date"], "2024-01-02")])
    ids = {i["check_id"] for i in rows(r.issues)}
    assert {"missing:lab value", "range_min:lab value", "date_min:visit date"} <= ids
    assert rows(C.compliance_report(df).overall())[0]["total_violations"] > 0
    assert rows(H.phi_inventory(df))
    rep = A.full_report(df, as_of="2024-02-01 00:00:00")
    assert rows(rep["trends"]) == [] and rows(rep["numeric_summary"])[0]["column_name"] == "lab value"
    assert rows(H.anonymize(df, ["patient.name", "e-mail"], order_by=["visit date"]))
    assert R.duplicate_count(df).first()["n_duplicates"] == 0


def test_command_line_entry(spark, tmp_path):
    import json as _json
    from carecheck.__main__ import main
    src = tmp_path / "in.csv"
    src.write_text("patient_name,ssn,age\nJohn Doe,123-45-6789,30\nJane Roe,,\n")
    out = tmp_path / "out"
    code = main(["validate", str(src), "--compliance", "--out", str(out)])
    assert code == 0  # only warnings: missing values below 50 %
    assert spark.read.parquet(str(out / "issues")).count() > 0
    assert spark.read.parquet(str(out / "violations")).count() > 0
    assert main(["profile", str(src), "--as-of", "2024-01-01 00:00:00", "--out", str(tmp_path / "p")]) == 0


def test_fused_validation_scans_once(spark):
    import re
    li = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    issues = V.validate(li, [R.PHIDetector(), R.DataQualityChecker(duplicates=False),
                             R.RangeValidator({"l_quantity": {"min": 5}}),
                             R.DateValidator(["l_shipdate"], "1993-01-01")]).issues
    plan = issues._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"FileScan parquet", plan)) == 1


def test_column_pruning_reaches_the_scan(spark):
    li = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    issues = V.validate(li, [R.RangeValidator({"l_quantity": {"min": 5}, "l_tax": {"max": 0.07}})]).issues
    plan = issues._jdf.queryExecution().executedPlan().toString()
    schema = plan[plan.index("ReadSchema: "):].split("\n")[0]
    assert "l_quantity" in schema and "l_tax" in schema and "l_comment" not in schema
    assert "l_extendedprice" not in schema and "l_shipdate" not in schema


def test_command_line_compliance(spark, tmp_path):
    from carecheck.__main__ import main
    src = tmp_path / "in.json"
    src.write_text('[{"subject_id": "AB123456", "visit_date": "2024-01-01", "adverse_event": "12345678"}]')
    assert main(["compliance", str(src), "--template", "clinical_trials", "--out", str(tmp_path / "c")]) == 0
    v = spark.read.parquet(str(tmp_path / "c" / "violations"))
    assert v.where("standard = 'CUSTOM'").count() == 3
