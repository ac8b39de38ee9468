"""Validation rules on the reference's unit-test fixtures (FIXTURES F1-F14)."""
from pyspark.sql import types as T

from carecheck.operators import rules as R
from carecheck.operators import validate as V
from carecheck.plans.aggplan import Check
from helpers import rows


def issues(spark, data, schema, rule_list):
    df = spark.createDataFrame(data, schema)
    return rows(V.validate(df, rule_list).issues)


def test_f1_missing_required_column(spark):
    out = issues(spark, [(1,), (2,), (3,)], "patient_id long", [R.SchemaValidator(["patient_id", "age"])])
    assert len(out) == 1 and out[0]["severity"] == "error"
    assert "Required column 'age' is missing" in out[0]["message"]


def test_f2_wrong_type(spark):
    out = issues(spark, [("30",), ("40",), ("50",)], "age string", [R.SchemaValidator(column_types={"age": "int"})])
    assert len(out) == 1 and "has type 'object' but expected 'int'" in out[0]["message"]


def test_type_widening_and_strict(spark):
    df = spark.createDataFrame([(1,)], "n int")
    assert rows(V.validate(df, [R.SchemaValidator(column_types={"n": "int"})]).issues) == []
    strict = rows(V.validate(df, [R.SchemaValidator(column_types={"n": "int"}, strict_types=True)]).issues)
    assert len(strict) == 1 and "'int32'" in strict[0]["message"]


def test_f3_phi_column_names(spark):
    out = issues(spark, [("John Doe", "123-45-6789", 30)], "patient_name string, ssn string, age long",
                 [R.PHIDetector()])
    named = {i["column_name"] for i in out if i["check_id"].startswith("phi_name:")}
    assert named == {"patient_name", "ssn"}


def test_f4_phi_values(spark):
    out = issues(spark, [("1", "123-45-6789"), ("2", "234-56-7890"), ("3", "345-67-8901")], "id string, name string",
                 [R.PHIDetector()])
    assert any("SSN" in i["message"] and i["n_affected"] == 3 for i in out)
    out = issues(spark, [("a@b.com",), ("c@d.org",), ("e@f.net",)], "contact string", [R.PHIDetector()])
    assert any("EMAIL" in i["message"] for i in out)
    out = issues(spark, [("555-123-4567",), ("555-987-6543",)], "phone string", [R.PHIDetector()])
    assert any("PHONE" in i["message"] for i in out)


def test_f5_missing_values(spark):
    out = issues(spark, [(1.0, "a"), (None, "b"), (3.0, None), (float("nan"), "d")], "col1 double, col2 string",
                 [R.DataQualityChecker()])
    miss = {i["column_name"]: i for i in out if i["check_id"].startswith("missing:")}
    assert miss["col1"]["n_affected"] == 2 and miss["col1"]["severity"] == "warning"  # 50 % is a warning
    assert miss["col2"]["n_affected"] == 1
    out = issues(spark, [(None,), (None,), (1.0,)], "c double", [R.DataQualityChecker()])
    assert [i["severity"] for i in out if i["check_id"] == "missing:c"] == ["error"]


def test_f6_duplicates(spark):
    out = issues(spark, [(1, "a"), (2, "b"), (1, "a"), (3, "c")], "col1 long, col2 string", [R.DataQualityChecker()])
    d = [i for i in out if i["check_id"] == "duplicates"]
    assert len(d) == 1 and d[0]["n_affected"] == 1 and d[0]["message"] == "Found 1 duplicate rows"


def test_duplicates_with_nulls_and_nan(spark):
    df = spark.createDataFrame([(None, float("nan")), (None, float("nan")), (1, 2.0)], "a long, b double")
    assert R.duplicate_count(df).collect()[0]["n_duplicates"] == 1


def test_f7_empty_column(spark):
    out = issues(spark, [(1, None, "x"), (2, None, "y")], "col1 long, col2 string, col3 string",
                 [R.DataQualityChecker()])
    e = [i for i in out if i["check_id"].startswith("empty:")]
    assert len(e) == 1 and e[0]["message"] == "Column 'col2' is completely empty"


def test_f8_icd10(spark):
    out = issues(spark, [("A01.1",), ("B02.2",), ("C03",), ("INVALID",), ("D04.5",)], "diagnosis string",
                 [R.MedicalCodeValidator({"diagnosis": "icd10"})])
    assert len(out) == 1 and out[0]["n_affected"] == 1 and out[0]["sample"] == ["INVALID"]
    assert out[0]["column_name"] is None
    assert out[0]["message"] == "Found 1 invalid ICD10 codes in column. Sample: ['INVALID']"


def test_f9_other_codes(spark):
    cases = {"icd9": ["001", "002.1", "INVALID"], "loinc": ["1234-5", "12345-6", "INVALID"],
             "cpt": ["1234", "5678A", "INVALID"], "ndc": ["1234-5678-90", "INVALID"]}
    for code, vals in cases.items():
        out = issues(spark, [(v,) for v in vals], "c string", [R.MedicalCodeValidator({"c": code})])
        assert len(out) == 1 and out[0]["n_affected"] == 1, code


def test_f10_code_nulls_exempt(spark):
    out = issues(spark, [("A01.1",), (None,), ("B02.2",), (None,)], "diagnosis string",
                 [R.MedicalCodeValidator({"diagnosis": "icd10"})])
    assert out == []


def test_unknown_code_type_and_absent_column_skipped(spark):
    out = issues(spark, [("x",)], "c string", [R.MedicalCodeValidator({"c": "snomed", "zz": "icd10"})])
    assert out == []


def test_f11_range(spark):
    out = issues(spark, [(25,), (30,), (-5,), (150,), (50,)], "age long",
                 [R.RangeValidator({"age": {"min": 0, "max": 120}})])
    msgs = sorted(i["message"] for i in out)
    assert msgs == ["Column 'age' has 1 values above maximum 120", "Column 'age' has 1 values below minimum 0"]


def test_range_skips_non_numeric(spark):
    assert issues(spark, [("5",)], "age string", [R.RangeValidator({"age": {"min": 10}})]) == []


def test_f12_invalid_dates(spark):
    out = issues(spark, [("2020-01-01",), ("invalid-date",), ("2020-02-02",), ("not-a-date",)], "birth_date string",
                 [R.DateValidator(["birth_date"])])
    assert len(out) == 1 and out[0]["n_affected"] == 2 and out[0]["severity"] == "error"


def test_f13_date_range(spark):
    out = issues(spark, [("1950-01-01",), ("1800-01-01",), ("2025-01-01",)], "birth_date string",
                 [R.DateValidator(["birth_date"], "1900-01-01", "2020-01-01")])
    msgs = sorted(i["message"] for i in out)
    assert msgs == ["Column 'birth_date' has 1 dates after 2020-01-01",
                    "Column 'birth_date' has 1 dates before 1900-01-01"]


def test_f14_summary(spark):
    df = spark.createDataFrame([(1.0, "a"), (None, "b"), (3.0, "c"), (4.0, "d")], "col1 double, col2 string")
    s = V.summarize(df).collect()[0]
    assert (s.total_rows, s.total_columns, s.duplicate_rows) == (4, 2, 0)
    assert s.missing_values == {"col1": 1, "col2": 0}
    assert s.data_types == {"col1": "float64", "col2": "object"}


def test_row_check_and_custom_validator(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(120, 80), (70, 90)], "systolic long, diastolic long")
    r = V.validate(df, [R.RowCheck("bp_order", "systolic <= diastolic", "error", "Found %d rows with systolic <= diastolic")],
                   custom_validators=[R.CustomValidator(
                       lambda d: d.where("systolic > 100").select(F.lit("high systolic").alias("message")),
                       name="high_sys", severity="warning")])
    out = rows(r.issues)
    assert {i["rule_name"] for i in out} == {"bp_order", "high_sys"}
    c = r.counts().collect()[0]
    assert c.error_count == 1 and c.warning_count == 1 and c.is_valid is False


def test_failing_rule_becomes_error_issue(spark):
    class Broken(R.Rule):
        name = "broken"

        def plan(self, df):
            from pyspark.sql import functions as F
            return R.RulePlan(checks=[Check("x", "broken", None, "m", F.count_if(F.col("nope") > 0))])

    df = spark.createDataFrame([(1,)], "a long")
    out = rows(V.validate(df, [Broken(), R.DataQualityChecker()]).issues)
    assert any(i["message"].startswith("Rule 'broken' failed:") for i in out)


def test_empty_table_all_columns_empty(spark):
    df = spark.createDataFrame([], T.StructType([T.StructField("a", T.LongType())]))
    out = rows(V.validate(df, [R.DataQualityChecker()]).issues)
    assert [i["check_id"] for i in out] == ["empty:a"]


def test_wide_table_chunks_keep_results(spark):
    from carecheck.plans import aggplan
    cols = [f"c{i}" for i in range(120)]
    data = [tuple(None if (r + i) % 7 == 0 else r for i in range(120)) for r in range(20)]
    df = spark.createDataFrame(data, ", ".join(f"{c} long" for c in cols))
    checks = R.DataQualityChecker(duplicates=False).missing_checks(df)
    assert len(aggplan._chunks(checks, aggplan.MAX_AGGS_PER_SCAN)) == 3  # 240 checks, 90 per scan
    out = {i["check_id"]: i["n_affected"] for i in rows(V.validate(df, [R.DataQualityChecker()]).issues)}
    expect = {f"missing:c{i}": sum(1 for r in range(20) if (r + i) % 7 == 0) for i in range(120)}
    assert {k: v for k, v in out.items() if k.startswith("missing:")} == {k: v for k, v in expect.items() if v}


def test_duplicates_signed_zero(spark):
    df = spark.createDataFrame([(0.0, "a"), (-0.0, "a"), (1.0, "b")], "x double, y string")
    assert R.duplicate_count(df).collect()[0]["n_duplicates"] == 1


def test_f33_dirty_demo_end_to_end(spark):
    data = [(0, "P001", 38, 98.6, "I10", "1985-03-15", "A", None),
            (1, "P002", 33, 99.2, "INVALID", "1990-07-22", "A", None),
            (2, None, 45, 97.8, "J45.909", "INVALID_DATE", "A", None),
            (3, "P004", 150, 98.9, "F32.1", "1982-04-30", "A", None),
            (4, "P005", 35, 110.0, "G43.909", "1988-09-12", "A", None)]
    df = spark.createDataFrame(data, "k long, patient_id string, age long, temperature double, icd10_code string, "
                                     "date_of_birth string, duplicate_col string, empty_col string")
    r = V.validate(df.drop("k"), [
        R.SchemaValidator(["patient_id", "age"], {"age": "int", "temperature": "float"}),
        R.PHIDetector(), R.DataQualityChecker(),
        R.MedicalCodeValidator({"icd10_code": "icd10"}),
        R.RangeValidator({"age": {"min": 0, "max": 120}, "temperature": {"min": 95.0, "max": 105.0}}),
        R.DateValidator(["date_of_birth"], "1900-01-01", "2024-12-31")])
    msgs = sorted(i["message"] for i in rows(r.issues))
    assert msgs == sorted([
        "Column 'patient_id' may contain PHI/PII based on name",
        "Column 'date_of_birth' may contain PHI/PII based on name",
        "Found 4 potential DATE values in column 'date_of_birth'",
        "Column 'patient_id' has 1 missing values (20.0%)",
        "Column 'empty_col' has 5 missing values (100.0%)",
        "Column 'empty_col' is completely empty",
        "Found 3 invalid ICD10 codes in column. Sample: ['G43.909', 'INVALID', 'J45.909']",
        "Column 'age' has 1 values above maximum 120",
        "Column 'temperature' has 1 values above maximum 105.0",
        "Column 'date_of_birth' has 1 invalid date values"])
    c = r.counts().first()
    assert (c.total_issues, c.error_count, c.is_valid) == (10, 3, False)
    # with an explicit row order the sample follows the rows, as in the reference
    r2 = V.validate(df, [R.MedicalCodeValidator({"icd10_code": "icd10"}, order_by=["k"])])
    assert rows(r2.issues)[0]["sample"] == ["INVALID", "J45.909", "G43.909"]


def test_approx_duplicates_in_fused_scan(spark):
    df = spark.range(0, 3000).selectExpr("id % 2000 AS a")          # 1000 duplicate rows
    out = rows(V.validate(df, [R.DataQualityChecker(duplicates="approx")]).issues)
    d = [i for i in out if i["check_id"] == "duplicates"][0]
    assert abs(d["n_affected"] - 1000) <= 150 and "estimate" in d["message"]
    plan = V.validate(df, [R.DataQualityChecker(duplicates="approx")]).issues._jdf.queryExecution() \
        .executedPlan().toString()
    assert "hashpartitioning" not in plan  # no shuffle of rows or fingerprints
