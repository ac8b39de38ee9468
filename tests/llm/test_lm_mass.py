"""The registered language model against an unpruned trigram model of its own, whose contexts each sum to 1."""

import math
import zlib
from collections import Counter

import cases

from carecheck.llm import lm_trie

TEXTS = ["a b c a b d", "a b e f g", "b c a b c", "once seen words stand here", "a b c", "e f h a b"] * 3 + ["other words a b q", ""]


def test_registered_scores_lose_no_probability(spark):
    train = [zlib.crc32(str(i).encode()) % 10 != 0 for i in range(len(TEXTS))]
    assert not all(train)
    tokens = [["<s>", "<s>", *t.split(), "</s>"] for t in TEXTS]
    learned = [t for t, use in zip(tokens, train) if use]
    one = Counter(w for t in learned for w in t[2:])
    two = Counter(x for t in learned for x in zip(t[1:], t[2:]))
    three = Counter(x for t in learned for x in zip(t, t[1:], t[2:]))
    total = sum(one.values())

    def p(a, b, w):
        low = (one[w] + 0.1) / (total + 0.1 * (len(one) + 1))
        c = len(learned) if b == "<s>" else one[b]
        low = 0.6 * two[b, w] / c + 0.4 * low if c else low
        return 0.6 * three[a, b, w] / two[a, b] + 0.4 * low if two[a, b] else low

    for a, b in {(t[i], t[i + 1]) for t in tokens for i in range(len(t) - 2)}:
        assert math.isclose(sum(p(a, b, w) for w in [*one, "never seen"]), 1)
    got = {r.doc_id: r for r in lm_trie.lm_scores(cases.docs(spark, [(i, t, None, None, None) for i, t in enumerate(TEXTS)])).collect()}
    for i, t in enumerate(tokens):
        want = sum(math.log10(p(*t[j - 2:j + 1])) for j in range(2, len(t)))
        assert abs(got[i].score - want) < len(t) * 1.5 / lm_trie.GRID


def test_hashes_travel_whole():
    import numpy as np
    keys = np.array([1, 0x1234567890ABCDEF, 0x1234567890ABCDEE, 2**64 - 1], np.uint64)
    assert lm_trie._unpack(lm_trie._pack(keys)).tolist() == keys.tolist()
    assert not hasattr(lm_trie, "_planes")


def test_messages_of_the_longest_grams_are_counted_apart_and_alike(spark, monkeypatch):
    from pyspark.sql import functions as F
    d = cases.docs(spark, [(i, t, None, None, None) for i, t in enumerate(TEXTS)]).select(
        (F.col("doc_id") % 3).cast("int").alias("block"), "text", lm_trie.is_held_out().alias("held_out"))
    want = cases.collected(lm_trie._answers(lm_trie._asks(d, 4, 3)))
    asks, seen = lm_trie._asks, []
    monkeypatch.setattr(lm_trie, "_asks", lambda docs, ranges, order, least: seen.append((least, order)) or asks(docs, ranges, order, least))
    assert cases.collected(lm_trie._counted(d, 4, 3)) == want and seen == [(1, 2), (3, 3)]
    assert {r.n for r in asks(d, 4, 3, 3).collect()} == {2}
