"""Batch validation (F26, F27), skip-unchanged, sources and sinks."""
import json
import os
import tempfile

import pytest

from carecheck.operators import rules as R
from carecheck.operators import validate as V
from carecheck.plans.rowindex import with_row_index
from carecheck.sources import io as S
from helpers import rows


def test_row_index_dense(spark):
    df = spark.range(0, 1000).selectExpr("id * 7 % 1000 AS k")
    idx = sorted((r["k"], r["i"]) for r in rows(with_row_index(df, ["k"], "i", num_partitions=7)))
    assert [i for _, i in idx] == list(range(1000))


def test_f26_batches(spark):
    df = spark.createDataFrame([(i,) for i in range(1, 8)], "col1 long")
    _, b = V.batch_validate(df, [R.DataQualityChecker()], ["col1"], 3)
    b = sorted(rows(b), key=lambda r: r["batch_num"])
    assert [(r["start_row"], r["end_row"]) for r in b] == [(0, 3), (3, 6), (6, 7)]


def test_f27_batch_issue_rows(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, 1), (3, 1)], "col1 long, col2 long")
    issues, b = V.batch_validate(df, [R.DataQualityChecker(), R.SchemaValidator(["zz"])], ["col1", "col2"], 2)
    got = sorted((r["batch_num"], r["check_id"]) for r in rows(issues))
    assert (0, "empty:col2") in got and (1, "duplicates") in got
    assert (0, "required:zz") in got and (1, "required:zz") in got


def test_changed_batches(spark):
    df = spark.range(0, 50).selectExpr("id", "id * 2 AS v")
    cur = V.batch_fingerprints(df, ["id"], 10, "r1")
    old = V.batch_fingerprints(df.selectExpr("id", "CASE WHEN id = 23 THEN -1 ELSE v END AS v"), ["id"], 10, "r1")
    assert [r["batch_num"] for r in rows(V.changed_batches(cur, old))] == [2]
    assert rows(V.changed_batches(cur, V.batch_fingerprints(df, ["id"], 10, "r2")))  # new rule set: all


def test_readers(spark):
    d = tempfile.mkdtemp(prefix="carecheck-io-")
    with open(os.path.join(d, "a.csv"), "w") as f:
        f.write("patient_id,age,diagnosis\n1,30,A01\n2,40,B02\n")
    with open(os.path.join(d, "b.json"), "w") as f:
        json.dump([{"patient_name": "John Doe", "ssn": "123-45-6789", "age": 30}], f)
    csv = S.read_table(spark, os.path.join(d, "a.csv"))
    assert dict(csv.dtypes)["age"] == "int" and csv.count() == 2
    js = S.read_table(spark, os.path.join(d, "b.json"))
    out = rows(V.validate(js, [R.PHIDetector()]).issues)
    assert any(i["check_id"] == "phi_value:ssn:ssn" for i in out)
    with pytest.raises(ValueError):
        S.read_table(spark, os.path.join(d, "a.txt"))


def test_f31_ragged_columns(spark):
    df = spark.createDataFrame([([None, ""], ["not_a_number", "-1", "999"], ["123", "true"], "site")],
                               "patient_id array<string>, age array<string>, diagnosis array<string>, src string")
    out = rows(S.from_columns(df, ["patient_id", "age", "diagnosis"], ["src"]))
    assert len(out) == 3 and out[2]["patient_id"] is None and out[2]["diagnosis"] is None
    assert {r["src"] for r in out} == {"site"}


def test_admission(spark):
    m = spark.createDataFrame([("/x/ok.csv", 10), ("/x/bad.exe", 10), ("/x/big.csv", 17 * 1024 * 1024),
                               ("/x/we ird.csv", 1)], "path string, length long")
    got = {r["file_name"]: (r["admitted"], r["reason"]) for r in rows(S.admit_files(m))}
    assert got == {"ok.csv": (True, None), "bad.exe": (False, "Invalid file type"),
                   "big.csv": (False, "File too large"), "we ird.csv": (False, "Invalid filename")}


def test_report_and_json(spark):
    df = spark.createDataFrame([(None, "a"), (None, "b")], "x double, y string")
    r = V.validate(df, [R.DataQualityChecker()])
    c = rows(S.result_json(r.issues))[0]
    assert c["is_valid"] is False and c["error_count"] == 2
    lines = [x["line"] for x in sorted(rows(S.report_lines(r.issues, r.counts())), key=lambda x: x["line_no"])]
    from carecheck.functions import patterns as P
    assert lines[0] == P.REPORT_TITLE and "Overall Status: ❌ INVALID" in lines
    assert any(line.startswith("1. [ERROR]") for line in lines)


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() >= 0 and "check_id" in df.columns
    assert set(E.oracle_sql()) <= set(E.queries())


def test_equal_rows_do_not_cancel_in_fingerprints(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x")], "k long, v string")
    b = spark.createDataFrame([(2, "y"), (2, "y")], "k long, v string")
    old = V.batch_fingerprints(a, ["k"], 2, "r")
    assert V.changed_batches(V.batch_fingerprints(b, ["k"], 2, "r"), old).count() == 1
    assert V.changed_batches(V.batch_fingerprints(a, ["k"], 2, "r"), old).count() == 0
    one, two = [R.RowCheck("a", "k > 1")], [R.RowCheck("a", "k > 2")]
    assert V.ruleset_hash(one) == V.ruleset_hash([R.RowCheck("a", "k > 1")]) != V.ruleset_hash(two)


def test_user_rules_see_their_own_batch_and_fail_alone(spark):
    df = spark.createDataFrame([(i, "b" if i == 1 else "a") for i in range(6)], "k long, s string")

    def fn(x):
        return x.where("s = 'b'").selectExpr("'odd' AS message", "k AS row", "s AS value")

    seen = []
    issues, batches = V.batch_validate(df, [R.CustomValidator(fn, "odd"), R.RowCheck("bad", "cast(s as int) > 1"),
                                            R.RowCheck("late", "k > 4")], ["k"], 2, progress=lambda *x: seen.append(x))
    got = sorted((r["batch_num"], r["check_id"], r["row"], r["value"]) for r in rows(issues))
    assert got == [(0, "custom:odd", 1, "b"), (0, "failed:bad", None, None), (1, "failed:bad", None, None),
                   (2, "custom:late", None, None), (2, "failed:bad", None, None)]
    assert [r["end_row"] for r in sorted(rows(batches), key=lambda r: r["batch_num"])] == [2, 4, 6]
    assert [x[1:] for x in seen] == [(1, 3), (2, 3), (3, 3)]
    r = V.validate(df, [R.RowCheck("late", "k > 4"), R.RowCheck("bad", "cast(s as int) > 1"), R.DataQualityChecker()],
                   [R.CustomValidator(lambda x: 1 / 0, "broken"), R.CustomValidator(fn, "odd")])
    assert sorted(x["check_id"] for x in rows(r.issues)) == ["custom:late", "custom:odd", "failed:bad", "failed:broken"]
    lines = [x["line"] for x in sorted(rows(S.report_lines(r.issues, r.counts())), key=lambda x: x["line_no"])]
    assert "   Value: b" in lines and "   Location: , Row: 1" in lines


def test_json_forms(spark, tmp_path):
    forms = {"lines": '{"a": 1, "b": "x"}\n{"a": 2, "b": "y"}\n{"a": 3, "b": null}\n',
             "array": '[{"a": 1, "b": "x"},\n {"a": 2, "b": "y"},\n {"a": 3, "b": null}]',
             "columns": '{"a": [1, 2, 3], "b": ["x", "y", null]}',
             "spread": '{\n "a": [1, 2, 3],\n "b": ["x", "y"]\n}'}
    for name, text in forms.items():
        path = tmp_path / f"{name}.json"
        path.write_text(text)
        got = sorted((r["a"], r["b"]) for r in rows(S.read_table(spark, str(path))))
        assert got == [(1, "x"), (2, "y"), (3, None)], name


def test_batch_code_samples_per_batch(spark):
    df = spark.createDataFrame([(i, "A01" if i % 3 else f"BAD{i}") for i in range(12)], "k long, dx string")
    issues, _ = V.batch_validate(df, [R.MedicalCodeValidator({"dx": "icd10"}, order_by=["k"])], ["k"], 6)
    got = {r["batch_num"]: (r["n_affected"], r["sample"], r["message"]) for r in rows(issues)}
    assert got[0] == (2, ["BAD0", "BAD3"], "Found 2 invalid ICD10 codes in column. Sample: ['BAD0', 'BAD3']")
    assert got[1][1] == ["BAD6", "BAD9"]


def test_write_report_text(spark, tmp_path):
    df = spark.createDataFrame([(None, "a")], "x double, y string")
    r = V.validate(df, [R.DataQualityChecker()])
    S.write_report(S.report_lines(r.issues, r.counts()), str(tmp_path / "rep"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "rep").glob("part-*")))
    from carecheck.functions import patterns as P
    assert text.splitlines()[0] == P.REPORT_TITLE
    assert "1. [ERROR]" in text
