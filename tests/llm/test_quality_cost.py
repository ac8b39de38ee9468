"""The cascade's order comes from costs that do not change from run to run."""

import cases
import pytest
from pyspark.sql import functions as F

from carecheck.llm import quality

RULES = (
    quality.Rule("dear", ("n_repeat_words", "n_words"), lambda r, n: (r >= 0) & (n < 60)),
    quality.Rule("never", ("n_symbols",), lambda s: s < 0),
    quality.Rule("cheap", ("n_words",), lambda n: n < 60),
)


@pytest.fixture(scope="module")
def docs(spark):
    return cases.docs(spark, [(i, " ".join(f"w{(i * 31 + j * j) % 211}" for j in range(40 if i % 2 else 400)), None, None, None) for i in range(600)]).cache()


def test_order_is_the_same_in_three_runs(docs):
    runs = [[x["rule"].name for x in quality.estimate(docs, RULES, 1.0)] for _ in range(3)]
    assert runs == [["cheap", "dear", "never"]] * 3


def test_rejections_are_counted_once_however_many_copies(docs):
    found = {x["rule"].name: x for x in quality.estimate(docs, RULES, 1.0)}
    assert found["cheap"]["rejected"] == found["dear"]["rejected"] == 300 and found["never"]["rejected"] == 0
    assert found["dear"]["seconds"] > found["cheap"]["seconds"]


def test_any_order_gives_the_same_verdict(docs):
    df = quality.prepared(docs)
    kept = [{r.doc_id for r in quality.cascade(df, order).where(F.col("failed_rule").isNull()).collect()} for order in (RULES, RULES[::-1])]
    assert kept[0] == kept[1] == {i for i in range(600) if i % 2 == 0}
