"""V19 on key ranges: which leaves a change touches, and what is validated again."""
import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from carecheck.operators import changes as C
from carecheck.operators import rules as R
from carecheck.operators.validate import issues_by, ruleset_hash
from helpers import rows

N, LEAF = 4000, 40
RULES = [R.DataQualityChecker(), R.RangeValidator({"v": {"max": 50}}), R.SchemaValidator(["k", "missing"], {})]


def table(spark, recs):
    return spark.createDataFrame(recs, "k long, v long, s string")


def base():
    return [(i * 3, i * 7 % 61, None if i % 50 == 0 else f"row {i % 9}") for i in range(N)]


def expected_leaves(recs):
    """key -> leaf by a plain pass over the sorted keys"""
    out, leaf = {}, ""
    for k, *_ in sorted(recs):
        code = hashlib.md5(str(k).encode()).hexdigest()
        leaf = code if int(code[:12], 16) % LEAF == 0 else leaf
        out[k] = leaf
    return out


def contents(recs):
    of, out = expected_leaves(recs), defaultdict(list)
    for r in recs:
        out[of[r[0]]].append(r)
    return {k: sorted(v, key=repr) for k, v in out.items()}


def insert(recs):
    return recs + [(3001, 5, "new")]


def delete(recs):
    return [r for r in recs if r[0] != 600]


def update(recs):
    return [(k, 60, s) if k == 3000 else (k, v, s) for k, v, s in recs]


def move(recs):
    return [(11_111, v, s) if k == 300 else (k, v, s) for k, v, s in recs]


def split(recs):
    k = next(k for k in range(1, 10_000, 3) if int(hashlib.md5(str(k).encode()).hexdigest()[:12], 16) % LEAF == 0)
    return recs + [(k, 1, "starts a leaf")]


def join(recs):
    k = next(k for k, *_ in recs if int(hashlib.md5(str(k).encode()).hexdigest()[:12], 16) % LEAF == 0)
    return [r for r in recs if r[0] != k]


def same(recs):
    return recs


@pytest.fixture(scope="module")
def first(spark):
    df = table(spark, base())
    issues, tree, changes = C.revalidate_leaves(df, RULES, ["k"], C.empty_tree(spark), issue_table(spark, df), LEAF, 6)
    return tree, C.shared_table(issues, "first-issues"), changes


def issue_table(spark, df):
    data = C.leaves(df.limit(0), ["k"], LEAF, 2).drop(C.TIE)
    return issues_by(data, data.select("leaf").distinct(), RULES, "leaf")


def test_leaves_and_levels(spark, first):
    tree, _, changes = first
    nodes = rows(tree)
    want = contents(base())
    assert {r["node"]: r["n_rows"] for r in nodes if r["level"] == 0} == {k: len(v) for k, v in want.items()}
    top = max(r["level"] for r in nodes)
    assert [r["n_rows"] for r in nodes if r["level"] == top] == [N] and top >= 1
    for k in range(top):
        up = defaultdict(int)
        for r in nodes:
            if r["level"] == k:
                up[r["parent"]] += r["n_rows"]
        assert up == {r["node"]: r["n_rows"] for r in nodes if r["level"] == k + 1}
    assert {r["leaf"]: r["change"] for r in rows(changes)} == {k: "added" for k in want}


@pytest.mark.parametrize("edit", [insert, delete, update, move, split, join, same])
def test_only_touched_leaves_are_validated_again(spark, first, edit, monkeypatch):
    tree, stored, _ = first
    recs = edit(base())
    old, new = contents(base()), contents(recs)
    want = {k: "added" if k not in old else "removed" if k not in new else "changed"
            for k in old.keys() | new.keys() if old.get(k) != new.get(k)}
    assert len(want) <= 2
    seen = []
    monkeypatch.setattr(C, "issues_by", lambda data, *a: seen.append(data.count()) or issues_by(data, *a))
    df = table(spark, recs)
    issues, _, changes = C.revalidate_leaves(df, RULES, ["k"], tree, stored, LEAF, 5)
    assert {r["leaf"]: r["change"] for r in rows(changes)} == want
    assert seen == [sum(len(new[k]) for k, c in want.items() if c != "removed")]
    data = C.leaves(df, ["k"], LEAF, 3).drop(C.TIE)
    whole = issues_by(data, data.select("leaf").distinct(), RULES, "leaf")
    key = ["leaf", "check_id", "severity", "column_name", "n_affected", "n_rows", "message"]
    assert sorted(map(repr, issues.select(*key).collect())) == sorted(map(repr, whole.select(*key).collect()))


def test_other_rules_validate_everything_again(spark, first):
    tree, _, _ = first
    data = C.leaves(table(spark, base()), ["k"], LEAF)
    now = C.tree(data, ["k"], ruleset_hash(RULES[:1]), LEAF)
    assert C.changed_leaves(now, tree).where("change = 'changed'").count() == len(contents(base()))


def test_null_and_repeated_keys_maps_and_an_empty_table(spark):
    df = spark.range(0, 300).select(F.when(F.col("id") % 3 > 0, F.col("id") % 20).alias("k"), F.create_map(F.lit("a"), F.col("id")).alias("m"))
    one = C.tree(C.leaves(df, ["k"], 4), ["k"], "r", 4)
    two = C.tree(C.leaves(df.repartition(3), ["k"], 4, 7), ["k"], "r", 4)
    assert C.changed_leaves(one, two).count() == 0 and one.where("level = 0").agg(F.sum("n_rows")).first()[0] == 300
    none = C.tree(C.leaves(df.limit(0), ["k"], 4), ["k"], "r", 4)
    assert {r["change"] for r in rows(C.changed_leaves(none, one))} == {"removed"}
