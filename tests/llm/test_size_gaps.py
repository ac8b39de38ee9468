"""Groups of a signature are cut where sizes leave a gap; links are those of a brute force over all pairs."""

import random

from pyspark.sql import functions as F
from test_similarity import roots

from carecheck.llm import common


def fits(a, b):
    return 5 * min(a, b) >= 4 * max(a, b)


def compatible(pairs, sizes):
    n = sizes.select("id", "n")
    both = (pairs.join(n.toDF("a", "x"), "a").join(n.toDF("b", "y"), "b")
            .filter(5 * F.least("x", "y") >= 4 * F.greatest("x", "y")))
    return both.select("a", "b")


def test_no_link_is_lost_at_gaps(spark):
    rng = random.Random(7)
    size = {i: rng.choice([1, 2, 4, 5, 8, 10, 12, 15, 40, 50, 62, 63, 64, 200, 251]) for i in range(40)}
    rows = [(rng.randrange(9), i, size[i]) for i in range(40) for _ in range(2)] + [(99, 0, size[0])] * 2
    d = spark.createDataFrame(rows, "sig bigint, id bigint, n int").cache()
    sigs = {i: {s for s, k, _ in rows if k == i} for i in size}
    sizes = d.select("id", "n").distinct()
    compared, apart = [], []

    def verify(pairs):
        compared.extend((r.a, r.b) for r in pairs.collect())
        return compatible(pairs, sizes)

    def cross(left):
        apart.extend(left.collect())
        two = left.select("sig", F.col("id").alias("a")).join(left.select("sig", F.col("id").alias("b")), "sig").filter("a > b")
        return compatible(two.select("a", "b").distinct(), sizes)

    got = {r.node: r.root for r in common.grouped_links(d, verify, cross).collect()}
    want = roots(sorted(size), lambda a, b: bool(sigs[a] & sigs[b]) and fits(size[a], size[b]))
    assert {i: got.get(i, i) for i in size} == {i: want[i] for i in size}
    assert all(r.id != r.rep for r in apart)  # the smallest id has been compared with all others


def test_sizes_apart_are_not_compared(spark):
    d = spark.createDataFrame([(1, 1, 100), (1, 2, 10), (1, 3, 81), (1, 4, 12), (2, 1, 100), (2, 2, 10)], "sig bigint, id bigint, n int")
    pairs = []

    def verify(stars):
        pairs.extend((r.a, r.b) for r in stars.collect())
        return stars

    common.grouped_links(d, verify, lambda left: left.select(F.col("id").alias("a"), F.col("root").alias("b"))).collect()
    assert sorted(pairs) == [(3, 1), (4, 2)]
