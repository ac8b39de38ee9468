"""Bands of lines: chance meetings of unlike lines are few, and a part of the bands at a time gives the same rows."""

from itertools import combinations

import cases
import numpy as np
import pytest

from carecheck.llm import line_dedup

SYLLABLES = "th he in er an re on at en nd st or ti ed es of and ing ion the ou ha".split()


def test_unlike_lines_seldom_share_a_band():
    rng = np.random.default_rng(17)
    lines = [" ".join("".join(rng.choice(SYLLABLES, rng.integers(1, 4))) for _ in range(120)) for _ in range(800)]
    met = set()
    for band in line_dedup.line_bands(lines).T:
        groups = {}
        for i, sig in enumerate(band.tolist()):
            groups.setdefault(sig, []).append(i)
        met |= {pair for g in groups.values() for pair in combinations(g, 2)}
    assert len(met) < 100  # of 319,600 pairs of similarity 0.1; bands of four minima let 312 meet


@pytest.mark.parametrize("cut", [(0, 14), (0, 7, 14), (0, 1, 5, 14)])
def test_parts_of_the_bands_are_the_bands(cut):
    lines = ["ab", "a line of words", "x" * 300, "\U0001F600" * 9, "a line of other words"]
    whole, sizes = line_dedup.signed(lines)
    parts = [line_dedup.signed(lines, range(a, b)) for a, b in zip(cut, cut[1:])]
    assert np.array_equal(np.concatenate([p for p, _ in parts], axis=1), whole)
    assert all(np.array_equal(n, sizes) for _, n in parts)


def test_passes_do_not_change_the_result(spark, monkeypatch):
    base = [" ".join(f"{k}w{j * 7919 % 997}" for j in range(40)) for k in range(4)]
    text = "\n".join(x.replace("w", e, 1) + e for x in base for e in ("w", "v", "u"))
    docs = cases.docs(spark, [(1, text, None, None, None), (2, base[0] + "\n\nnew line", None, None, None), (3, None, None, None, None)])
    got = []
    for passes in (1, 5):
        monkeypatch.setattr(line_dedup, "PASSES", passes)
        got.append(sorted(map(tuple, line_dedup.line_dedup(docs).collect())))
    assert got[0] == got[1] and [r[2] for r in got[0]] == [8, 1, 0]
