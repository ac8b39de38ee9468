"""C13 with the rules as rows: equals the compiled form, and plans for thousands of rules; Q2/N3 inside the profile."""
import time

from pyspark.sql import functions as F

from carecheck.operators import analytics as A
from carecheck.operators import compliance as C
from carecheck.operators.rulesets import rule_rows
from helpers import rows


def test_rule_rows_equal_the_compiled_form(spark):
    df = spark.createDataFrame([(i, f"AB{i:06d}" if i % 3 else None, f"x{i % 4}\ny", float(i), [i]) for i in range(40)],
                               "k long, subject_id string, note string, v double, arr array<long>")
    rules = [C.CustomRule("a", r"^[A-Z]{2}\d{6}$", "subject form", "high", "subject|participant"), C.CustomRule("b", "^x1", "starts", "low", "NOTE", "do it"),
             C.CustomRule("c", r"\b3\b", "three"), C.CustomRule("d", "nothing like it", "never"), C.CustomRule("e", "x.y", "dot and newline", "medium", "note"),
             C.CustomRule("f", "(?i)ab0", "inline flag", "low", None)]
    for polarity in ("match", "nonmatch"):
        want = C.compliance_report(df, rules, polarity=polarity).violations.where("standard = 'CUSTOM'")
        got = C.rule_violations(df, rule_rows(spark, rules), polarity).select(*want.columns)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) != []


def test_a_large_column_is_dealt_into_parts_that_meet_all_its_rules(spark, monkeypatch):
    monkeypatch.setattr(C, "PART_BYTES", 500)
    df = spark.createDataFrame([(i, f"note {i} " + "x" * 40, "same" if i % 9 else None) for i in range(300)], "k long, note string, kind string")
    sizes = {}
    for r in C.dealt_values(df)[0].collect():
        sizes.setdefault(r["field"], {}).setdefault(r["part"], []).append(r["value"])
    assert len(sizes["note"]) > 20 and max(map(len, sizes["note"].values())) < 60 and sum(map(len, sizes["note"].values())) == 300
    assert sizes["kind"].popitem()[1] == ["same"]
    rules = [C.CustomRule(f"r{i}", f"^note {i} ", field_pattern="note") for i in (0, 17, 299)] + [C.CustomRule("any", "same"), C.CustomRule("no", "^note 300 ")]
    for polarity in ("match", "nonmatch"):
        want = C.compliance_report(df, rules, polarity=polarity).violations.where("standard = 'CUSTOM'")
        got = C.rule_violations(df, rule_rows(spark, rules), polarity).select(*want.columns)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) != []


def test_thousands_of_rules_over_hundreds_of_columns_plan_in_seconds(spark):
    df = spark.range(0, 20).select(*[F.concat(F.lit(f"c{i}-"), F.col("id") % 3).alias(f"col{i:03d}") for i in range(200)])
    rules = rule_rows(spark, [C.CustomRule(f"r{k}", f"^c{k % 200}-{k % 4}$", "d", "low", f"col{k % 200:03d}") for k in range(5000)])
    t = time.time()
    out = C.rule_violations(df, rules)
    out._jdf.queryExecution().executedPlan()
    assert time.time() - t < 20
    assert out.count() == sum(1 for k in range(5000) if k % 4 < 3)


def test_mixed_types_inside_the_profile(spark):
    df = spark.createDataFrame([(i, '{"a":1}' if i % 2 else "17", "5", None if i < 9 else "true") for i in range(10)], "k long, m string, one string, few string")
    p = A.Profile(df, as_of="2024-01-01 00:00:00", json_columns=["m", "one", "few"])
    assert p.metric_values().first()["consistency"] == 1 - 0.5 / 4
    found = {r["column_name"]: r for r in rows(p.anomalies()) if r["anomaly_type"] == "data_type_mismatch"}
    assert set(found) == {"m"} and found["m"]["n_affected"] == 10 and found["m"]["severity"] == "medium"
