"""The mix as rows: each source's cut gives the same documents as the prefix sums."""

from collections import Counter

import cases

from carecheck.llm import mixing


def test_rows_of_the_mix_equal_the_words_taken(spark):
    few = [(i, "w " * (1 + i % 37), None, f"s{i % 4}" if i % 9 else None, None) for i in range(400)]
    same = [(5, "a b c", None, "s0", None)] * 500 + [(5, "a b d", None, "s0", None)] * 300 + [(5, "x " * 9, None, "s0", None)] * 70
    none = [(None, "a b c", None, "s1", None)] * 300 + [(6, None, None, "s1", None), (7, " ", None, "s2", None)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(0, 400, 3)] + [(None, 1, 0)], "doc_id bigint, quality int, toxic int")
    partly = 0
    for rows, given in ((few + same + none, labels), (same, None)):
        docs = cases.docs(spark, rows).coalesce(2)
        m = mixing.mix(docs, None if given is None else mixing.quality_weights(given), buckets=16).collect()
        want, alike = Counter(), {}
        for r in m:
            want[r.skey, r.doc_id, r["size"]] += r.taken // r["size"] if r["size"] else 0
            alike.setdefault((r.skey, r.doc_id, r["size"]), set()).add(r.picked)
        partly += sum(len(x) > 1 for x in alike.values())
        got = mixing.mixed(docs, given)
        assert got.columns == docs.columns
        rows_out = [tuple(r) for r in got.collect()]
        assert Counter((r[3], r[0], len(r[1].split())) for r in rows_out) == +want
    assert partly  # a cut among rows that are alike occurs
