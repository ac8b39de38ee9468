"""Compliance engine, templates, rule catalog (FIXTURES F16-F22)."""
from carecheck.operators import compliance as C
from carecheck.operators import rulesets as RS
from helpers import rows

F16_COLS = ("patient_name string, ssn string, email string, phone string, diagnosis_code string, lab_code string, "
            "procedure_code string, race string, religion string, genetic_info string, username string, "
            "timestamp string, action string, change_reason string")
F16 = [("John Doe", "123-45-6789", "john@example.com", "(555) 123-4567", "E11.9", "58410-2", "99213", "White",
        "Christian", "BRCA1 positive", "jdoe", "2024-01-01", "create", "initial"),
       ("Jane Smith", "234-56-7890", "jane@example.com", "(555) 234-5678", "I10", "12345-6", "99214", "Black",
        "Muslim", "none", "jsmith", "2024-01-02", "update", "correction"),
       ("Bob Lee", "345-67-8901", "bob@example.com", "(555) 345-6789", "J45", "1234-5", "99215", "Asian",
        "None", "none", "blee", "2024-01-03", "delete", "cleanup")]


def scores(rep):
    return {r["standard"]: r for r in rows(rep.scores())}


def test_f16_hipaa_gdpr_violations(spark):
    rep = C.compliance_report(spark.createDataFrame(F16, F16_COLS))
    v = rows(rep.violations)
    ids = {(x["standard"], x["rule_id"]) for x in v}
    assert ("HIPAA", "PHI_NAME_DETECTED") in ids and ("HIPAA", "PHI_SSN_DETECTED") in ids
    assert ("GDPR", "PERSONAL_DATA_DETECTED") in ids
    s = scores(rep)
    assert s["hipaa"]["violations_count"] > 0 and s["gdpr"]["violations_count"] > 0
    assert all(0 <= x["score"] <= 100 for x in s.values())
    # signature fields username/timestamp present, "meaning" missing; audit fields present
    fda = [x for x in v if x["standard"] == "FDA"]
    assert [x["message"] for x in fda] == ["Missing electronic signature fields: meaning"]


def test_f18_clean_scores_higher(spark):
    dirty = C.compliance_report(spark.createDataFrame(F16, F16_COLS))
    clean = C.compliance_report(spark.createDataFrame(
        [("1", 10, "A", "2024-01-01"), ("2", 20, "B", "2024-01-02")], "id string, value long, category string, date string"))
    d, c = scores(dirty), scores(clean)
    assert c["hipaa"]["score"] > d["hipaa"]["score"] and c["gdpr"]["score"] > d["gdpr"]["score"]
    assert rows(clean.overall())[0]["overall_score"] > rows(dirty.overall())[0]["overall_score"]


def test_scores_and_risk(spark):
    rep = C.compliance_report(spark.createDataFrame(F16, F16_COLS))
    s = scores(rep)
    n = s["hipaa"]["violations_count"]
    assert s["hipaa"]["score"] == max(0, 100 - 10 * n)
    assert s["fda"]["score"] == 80.0 and s["fda"]["risk_level"] == "medium"
    o = rows(rep.overall())[0]
    assert abs(o["overall_score"] - sum(x["score"] for x in s.values()) / 6) < 1e-9


def test_f19_custom_rule(spark):
    df = spark.createDataFrame([("This is a TEST value", "x"), ("normal", "y")], "test_column string, normal_column string")
    rule = C.CustomRule("test_rule", r"\bTEST\b", "Detect test", "high", "test_column")
    v = rows(C.compliance_report(df, [rule]).violations)
    custom = [x for x in v if x["standard"] == "CUSTOM"]
    assert len(custom) == 1 and custom[0]["field"] == "test_column"
    assert custom[0]["message"] == "Custom rule 'test_rule' violation: Detect test"
    # nonmatch polarity flags values that do NOT match
    v2 = rows(C.compliance_report(df, [rule], polarity="nonmatch").violations)
    assert [x["field"] for x in v2 if x["standard"] == "CUSTOM"] == ["test_column"]


def test_f20_valid_codes_score_high(spark):
    df = spark.createDataFrame([("E11.9", "58410-2", "99213"), ("I10", "12345-6", "99214")],
                               "diagnosis string, lab_test string, procedure string")
    s = scores(C.compliance_report(df))
    assert s["icd10"]["score"] >= 80 and s["loinc"]["score"] >= 80 and s["cpt"]["score"] >= 80


def test_coding_nulls_count_as_bad(spark):
    df = spark.createDataFrame([("E11.9",), (None,)], "diagnosis string")
    assert scores(C.compliance_report(df))["icd10"]["violations_count"] == 1


def test_f21_template_match_polarity(spark):
    df = spark.createDataFrame([("AB123456", "2024-01-01", "12345678")], "subject_id string, visit_date string, adverse_event string")
    rep = C.compliance_report(df, template="clinical_trials")
    custom = {(x["rule_id"], x["field"]) for x in rows(rep.violations) if x["standard"] == "CUSTOM"}
    assert ("subject_id_format", "subject_id") in custom and ("visit_date_format", "visit_date") in custom
    assert ("adverse_event_coding", "adverse_event") in custom
    assert rows(rep.overall())[0]["template_applied"] == "clinical_trials"


def test_unknown_template_echoed(spark):
    rep = C.compliance_report(spark.createDataFrame([("x",)], "a string"), template="nope")
    assert rows(rep.overall())[0]["template_applied"] == "nope"
    assert not RS.template_known("nope")


def test_c21_empty_dataset(spark):
    rep = C.compliance_report(spark.createDataFrame([], "a string"))
    o = rows(rep.overall())[0]
    assert o["overall_score"] == 100.0 and o["risk_level"] == "low" and o["total_violations"] == 0


def test_templates_catalog(spark):
    cat = RS.template_catalog(spark)
    names = {r["template"] for r in rows(RS.list_templates(cat))}
    assert names == {"clinical_trials", "ehr", "laboratory", "imaging", "research"}
    assert len(RS.template_rules("imaging")) == 3


def test_rule_store_upsert_delete(spark):
    store = RS.empty_rule_store(spark)
    store = RS.upsert_rules(store, RS.rule_rows(spark, [C.CustomRule("r1", "a"), C.CustomRule("r2", "b")]))
    store = RS.upsert_rules(store, RS.rule_rows(spark, [C.CustomRule("r1", "zzz")], version=2))
    got = {r.name: r.pattern for r in RS.load_rules(store)}
    assert got == {"r1": "zzz", "r2": "b"}
    store = RS.delete_rules(store, "custom", ["r2"])
    assert [r.name for r in RS.load_rules(store)] == ["r1"]


def test_profiles_registry(spark):
    cat = RS.profile_catalog(spark)
    names = {r["profile"] for r in rows(RS.list_profiles(cat))}
    assert {"clinical_trials", "ehr", "imaging", "lab", "covid19", "ehr_real", "heart_disease"} <= names
    assert RS.profile_rules("unknown") is None
    kinds = [type(r).__name__ for r in RS.profile_rules("lab")]
    assert kinds == ["SchemaValidator", "PHIDetector", "DataQualityChecker", "MedicalCodeValidator",
                     "RangeValidator", "DateValidator"]


def test_f15_clinical_trial_profile_passes(spark):
    from datetime import datetime
    from carecheck.operators import validate as V
    df = spark.createDataFrame(
        [("S001", datetime(2024, 1, 1), "A", 45, 24.5), ("S002", datetime(2024, 1, 2), "B", 52, 27.1),
         ("S003", datetime(2024, 1, 3), "A", 38, 22.8)],
        "subject_id string, visit_date timestamp, treatment_group string, age long, bmi double")
    out = rows(V.validate(df, RS.profile_rules("clinical_trials")).issues)
    assert not [i for i in out if i["severity"] == "error"]


def test_options_rule_set():
    names = [type(r).__name__ for r in RS.rules_from_options(phi=False, quality=False)]
    assert names == ["DataQualityChecker"]  # quality always on (parity)
    names = [type(r).__name__ for r in RS.rules_from_options(phi=False, quality=False, always_quality=False)]
    assert names == []


def test_wide_table_compliance(spark):
    cols = [f"note_{i}" for i in range(30)]
    data = [tuple(("John Doe" if (r + i) % 5 == 0 else "x") for i in range(30)) for r in range(10)]
    df = spark.createDataFrame(data, ", ".join(f"{c} string" for c in cols))
    rep = C.compliance_report(df)
    v = rows(rep.violations)
    assert len([x for x in v if x["rule_id"] == "PHI_NAME_DETECTED"]) == 30
    assert scores(rep)["hipaa"]["violations_count"] == 30


def test_empty_table_report_is_complete(spark):
    rep = C.compliance_report(spark.createDataFrame([], "a string, diagnosis string"))
    assert rows(rep.violations) == [] and rows(rep.recommendations()) == []
    assert {(r["score"], r["risk_level"], r["violations_count"], r["compliant"]) for r in rows(rep.scores())} == {(100.0, "low", 0, True)}
    o = rows(rep.overall())[0]
    assert (o["overall_score"], o["risk_level"], o["total_violations"]) == (100.0, "low", 0)


def test_f22_other_templates(spark):
    cases = {
        "ehr": ([("P12345678", "120", "10 mg"), ("X1", "80", "5 ml")], "patient_id string, bp string, dosage string",
                {("patient_id_format", "patient_id"), ("vital_signs_range", "bp"), ("medication_dosage", "dosage")}),
        "laboratory": ([("5.2 (3.5-5.0 mmol)", "SP123456-001", "completed"), ("x", "y", "z")],
                       "result string, specimen string, status string",
                       {("lab_result_format", "result"), ("specimen_id_format", "specimen"), ("test_status", "status")}),
        "imaging": ([("1.2.3.4.5.6", "CT", "3"), ("1.2", "XY", "9")], "dicom_uid string, modality string, quality string",
                    {("dicom_uid_format", "dicom_uid"), ("modality_codes", "modality"), ("image_quality_score", "quality")}),
        "research": ([("R123456", "consented", "1985"), ("X", "n", "x")], "id string, consent string, birth_year string",
                     {("deidentified_id", "id"), ("consent_status", "consent"), ("data_anonymization", "birth_year")}),
    }
    for name, (data, schema, expected) in cases.items():
        rep = C.compliance_report(spark.createDataFrame(data, schema), template=name)
        got = {(x["rule_id"], x["field"]) for x in rows(rep.violations) if x["standard"] == "CUSTOM"}
        assert expected <= got, name
