"""The stored rule table, with two writers."""
import tempfile

from carecheck.operators import rulesets as RS
from carecheck.operators.compliance import CustomRule


def store(spark, path=None):
    return RS.RuleStore(spark, path or f"{tempfile.mkdtemp(prefix='carecheck-rules-')}/store")


def names(df):
    return {(r["rule_id"], r["pattern"]) for r in df.collect()}


def test_upsert_delete_and_snapshots(spark):
    s = store(spark)
    assert s.version() == 0 and names(s.snapshot()) == set()
    assert s.upsert([CustomRule("a", "1"), CustomRule("b", "2")]) == 1
    assert s.upsert([CustomRule("a", "3")]) == 2
    assert s.delete("b") is True and s.delete("b") is False and s.delete("never") is False
    assert s.version() == 3 and names(s.snapshot()) == {("a", "3")}
    assert names(s.snapshot(1)) == {("a", "1"), ("b", "2")} and names(s.snapshot(2)) == {("a", "3"), ("b", "2")}
    s.upsert([CustomRule("b", "back")])
    assert names(s.snapshot()) == {("a", "3"), ("b", "back")}
    s.upsert([CustomRule("a", "other set")], ruleset="site")
    assert names(s.snapshot()) == {("a", "3"), ("b", "back"), ("a", "other set")}


def test_lost_race_is_tried_again_and_loses_nothing(spark):
    one = store(spark)
    two = store(spark, one.path)
    one.upsert([CustomRule("base", "0")])
    calls = []

    def rows(number):
        if not calls:  # the other writer commits after this one has read the version
            two.upsert([CustomRule("theirs", "t"), CustomRule("both", "t")])
        calls.append(number)
        return RS.rule_rows(spark, [CustomRule("ours", "o"), CustomRule("both", "o")], "custom", number)

    assert one._commit(rows) == 3 and calls == [2, 3]
    assert names(one.snapshot()) == {("base", "0"), ("theirs", "t"), ("ours", "o"), ("both", "o")}


def test_number_taken_between_check_and_rename(spark, monkeypatch):
    one = store(spark)
    two = store(spark, one.path)
    one.upsert([CustomRule("base", "0")])
    real = one._fs

    class Fs:
        raced = False

        def __getattr__(self, name):
            return getattr(real, name)

        def exists(self, p):
            found = real.exists(p)
            if not Fs.raced and p.getName() == "v000000000002":
                Fs.raced = True
                two.upsert([CustomRule("theirs", "t")])
            return found

    one._fs = Fs()
    assert one.upsert([CustomRule("ours", "o")]) == 3
    assert names(two.snapshot()) == {("base", "0"), ("theirs", "t"), ("ours", "o")}
    assert names(two.snapshot(2)) == {("base", "0"), ("theirs", "t")}


def test_a_delete_that_lost_a_race_looks_again(spark):
    one = store(spark)
    two = store(spark, one.path)
    one.upsert([CustomRule("a", "1")])
    snapshot, seen = one.snapshot, []

    def stale(version=None):
        out = snapshot(version)
        if not seen:
            seen.append(version)
            two.delete("a")
        return out

    one.snapshot = stale
    assert one.delete("a") is False and names(two.snapshot()) == set()
