"""PHI inventory, audit, de-identification, sanitising."""
from pyspark.sql import functions as F

from carecheck.operators import phi as H
from helpers import rows


def test_hash_value_fixed_salt(spark):
    df = spark.createDataFrame([("abc",), (None,)], "v string")
    assert [r[0] for r in df.select(H.hash_value(F.col("v"), "salt")).collect()] == ["169b3a2b", None]


def test_masks(spark):
    df = spark.createDataFrame([("555-123-4567", "123-45-6789", "john@example.com", "Johnathan", "noat")],
                               "phone string, ssn string, email string, name string, email2 string")
    out = rows(H.anonymize(df, ["phone", "ssn", "email", "name", "email2"], method="mask"))[0]
    # "email2" is an e-mail column without "@": left unchanged
    assert out == {"phone": "***-***-4567", "ssn": "***-**-6789", "email": "joh***@example.com",
                   "name": "Joh***", "email2": "noat"}


def test_safe_harbor(spark):
    df = spark.createDataFrame([(2, "Bob", "1980-05-01", "1 Main St", "555", "x"),
                                (1, "Al", "05/01/1970", "2 Oak Rd", "556", "y"),
                                (3, "Cy", "junk", "3 Elm", "557", None)],
                               "k long, first_name string, birth_date string, city string, ssn string, other string")
    out = sorted(rows(H.anonymize(df, ["first_name", "birth_date", "city", "ssn", "other", "absent"],
                                  salt="salt", order_by=["k"])), key=lambda r: r["k"])
    assert [r["first_name"] for r in out] == ["Patient_0000", "Patient_0001", "Patient_0002"]
    assert [r["ssn"] for r in out] == ["ID_000000", "ID_000001", "ID_000002"]
    assert [r["birth_date"] for r in out] == ["1970", "1980", "junk"]  # unparseable kept (Quirk 11)
    assert {r["city"] for r in out} == {"[REDACTED]"}
    assert out[2]["other"] is None and len(out[0]["other"]) == 8


def test_unknown_method(spark):
    import pytest
    with pytest.raises(ValueError):
        H.anonymize(spark.createDataFrame([(1,)], "a long"), ["a"], method="nope")


def test_generalize_date_formats(spark):
    df = spark.createDataFrame([("2020-01-05",), ("12/31/2019",), ("31/12/2018",), ("2017/02/03",), ("2020-02-30",), (None,)],
                               "d string")
    out = [r[0] for r in df.select(H.generalize_date(F.col("d"), df.schema["d"].dataType)).collect()]
    assert out == ["2020", "2019", "2018", "2017", "2020-02-30", None]


def test_f32_sanitize(spark):
    df = spark.createDataFrame([("<script>alert('xss')</script>",), ("'; DROP TABLE patients; --",),
                                ("<b>bold</b> /* c */",), (None,)], "diagnosis string")
    out = [r[0] for r in H.sanitize(df).collect()]
    assert out == ["", "' DROP TABLE patients ", "bold  c ", None]


def test_filename(spark):
    df = spark.createDataFrame([("ok_file.csv",), ("bad<>:name?.csv",)], "f string")
    out = df.select(H.filename_valid(F.col("f")).alias("v"), H.sanitize_filename(F.col("f")).alias("s")).collect()
    assert [tuple(r) for r in out] == [(True, "ok_file.csv"), (False, "bad___name_.csv")]


def test_phi_inventory_score_recommendations(spark):
    df = spark.createDataFrame([(1, "call 555-123-4567", "a@b.com"), (2, "none", "MRN 12345")],
                               "id long, note string, contact string")
    inv = H.phi_inventory(df, order_by=["id"])
    got = {(r["column_name"], r["phi_type"]): r["instances"] for r in rows(inv)}
    assert got[("note", "phone")] == 1 and got[("contact", "email")] == 1 and got[("contact", "medical_record")] == 1
    s = rows(H.phi_score(inv))[0]
    assert s["compliant"] is False and s["compliance_score"] == 80
    recs = [r["recommendation"] for r in sorted(rows(H.phi_recommendations(inv)), key=lambda r: r["ordinal"])]
    assert recs[0].startswith("⚠️") and any("email" in r for r in recs) and any("phone" in r.lower() for r in recs)


def test_audit(spark):
    df = spark.createDataFrame([("123-45-6789", "x@y.org")], "s string, e string")
    issues, summary = H.plaintext_audit(df)
    assert len(rows(issues)) >= 2
    s = rows(summary)[0]
    assert s["security_score"] == 100 - 15 * s["n_issues"]
