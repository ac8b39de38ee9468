"""Joins against all pairs on small tables, and held-out accuracy of language ID."""

import re

import cases

from carecheck.llm import common, jaccard_join, language_id, line_dedup
from carecheck.llm.common import components

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def roots(nodes, linked):
    parent = {x: x for x in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    nodes = list(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in nodes}


def word_shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def near_copies():
    """Sizes from one word to hundreds, edits around the threshold, one passage in all of a group."""
    words = [f"v{i}" for i in range(400)]
    rows, k = [], 0
    for size in (1, 4, 5, 6, 8, 12, 20, 33, 60, 150, 399):
        for edits in range(0, max(2, size // 20) + 2):
            for shift in (0, 7):
                w = words[:size]
                for e in range(edits):
                    w[(e * 13 + shift) % size] = f"e{k}x{e}"
                rows.append((k, " ".join(w), None, None, None))
                k += 1
    for i in range(40):  # unrelated, but for a passage
        own = [f"u{i}_{j}" for j in range(30)]
        rows.append((k + i, " ".join(own[:i % 30] + words[200:220] + own[i % 30:]), None, None, None))
    return rows


def test_jaccard_join_equals_all_pairs(spark, monkeypatch):
    for least in (16, 2, 1):  # whatever counts as frequent, the links are the same
        monkeypatch.setattr(jaccard_join, "HOT_LEAST", least)
        monkeypatch.setattr(jaccard_join, "BATCH_HOT", min(3, least))
        monkeypatch.setattr(common, "BLOCK", 5 if least < 16 else 256)  # several blocks, or one
        for rows in (near_copies(), [r for r in cases.ROWS if r[0] is not None]):
            sets = {r[0]: word_shingles(r[1]) for r in rows}
            want = roots(sets, lambda a, b: sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
            got = jaccard_join.jaccard_join(cases.docs(spark, rows)).collect()
            assert {r.doc_id: r.n_shingles for r in got} == {i: len(s) for i, s in sets.items()}
            assert {r.doc_id: r.component_id for r in got} == want


def line_shingles(line):
    line = line.lower()
    return {line[i:i + 5] for i in range(max(1, len(line) - 4))}


def test_line_dedup_equals_all_pairs(spark, small):
    docs = small.select("doc_id", "text", "lang", "source", "n_chars").filter("length(text) < 4000")
    texts = {r.doc_id: r.text for r in docs.collect()}
    where: dict = {}
    for i in sorted(texts):
        for n, line in enumerate(texts[i].split("\n")):
            if re.search(r"[^\x20\x09-\x0D]", line):
                where.setdefault(line, []).append((i, n))
    lines = list(where)
    sets = [line_shingles(x) for x in lines]
    comp = roots(range(len(lines)), lambda a, b: 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b])))
    keep: dict = {}
    for k, line in enumerate(lines):
        keep[comp[k]] = min(keep.get(comp[k], where[line][0]), where[line][0])
    want: dict = {i: [] for i in texts}
    for k, line in enumerate(lines):
        for i, n in where[line]:
            if (i, n) != keep[comp[k]]:
                want[i].append(n)
    got = {r.doc_id: r.dropped for r in line_dedup.line_dedup(docs).collect()}
    assert got == {i: sorted(x) for i, x in want.items()}
    left = {r.doc_id: r.text for r in line_dedup.deduplicated(docs).collect()}
    for i, t in texts.items():
        rest = "\n".join(x for n, x in enumerate(t.split("\n")) if n not in want[i])
        assert left.get(i, "") == (rest if i in left else "") and (i in left or not rest.strip())


def test_lines_of_one_family_on_both_sides_of_the_threshold(spark, monkeypatch):
    # variants of one line, some too far from the smallest to link with it but near each other
    monkeypatch.setattr(common, "BLOCK", 4)
    words = [f"word{i:03d}x" for i in range(60)]
    lines = []
    for k in range(24):
        w = list(words)
        for e in range(k % 12):
            w[(5 * e + 7 * (k // 12)) % 60] = f"edit{k // 12}{e:02d}z"
        lines.append(" ".join(w) + f" end{k:02d}")
    docs = cases.docs(spark, [(i, x, None, None, None) for i, x in enumerate(lines)])
    sets = [line_shingles(x) for x in lines]
    want = roots(range(24), lambda a, b: 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b])))
    got = {r.doc_id for r in line_dedup.line_dedup(docs).collect() if r.n_dropped}
    assert got == {i for i in range(24) if want[i] != i}


def test_histograms_never_rule_out_a_link():
    import numpy as np
    rng = np.random.default_rng(1)
    for _ in range(60):
        base = np.unique(rng.integers(0, 1 << 63, rng.integers(5, 600), dtype=np.uint64) * np.uint64(2))
        sets, rows = [], []
        for i in range(12):
            kept = base[rng.random(len(base)) < rng.choice([0.98, 0.9, 0.8])]
            sets.append(np.unique(np.concatenate([kept, rng.integers(0, 1 << 63, rng.integers(0, len(base) // 6 + 1), dtype=np.uint64)])))
            rows.append((i % 2, i, i, len(sets[i]), jaccard_join.histogram(sets[i]) if i % 5 else b""))
        for p, q in ((0, 1), (0, 0), (1, 1)):
            got = {frozenset(x) for x in jaccard_join._survivors(rows, p, q)}
            for i in range(p, 12, 2):
                for j in range(q, 12, 2):
                    may = jaccard_join.may_link(len(sets[i]), len(sets[j]), rows[i][4], rows[j][4])
                    assert i == j or (frozenset((i, j)) in got) == may
                    assert may or not jaccard_join.do_link(sets[i].tobytes(), sets[j].tobytes())


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 200: 200, 201: 200}


def test_language_id_held_out_accuracy(small):
    truth = {r.doc_id: r.lang for r in small.select("doc_id", "lang").collect()}
    got = language_id.language_id(small).collect()
    held = [r for r in got if r.held_out]
    assert len(held) > 20 and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_automaton_accepts_exactly_the_substrings():
    text = [1, 2, 1, 2, 3, 1, 1, 2]
    table = language_id.suffix_automaton(text, 4)
    subs = {tuple(text[i:j]) for i in range(len(text)) for j in range(i + 1, len(text) + 1)}

    def accepts(word):
        s = 0
        for c in word:
            s = table[s, c]
            if not s:
                return False
        return True

    import itertools
    for n in range(1, 5):
        for word in itertools.product((1, 2, 3), repeat=n):
            assert accepts(word) == (word in subs)


def test_no_letter_and_nothing_learned(spark):
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.language_id(cases.docs(spark)).collect()}
    assert got[4] == got[5] == got[6] == got[11] == ("und", 0.0)
    unlabelled = cases.docs(spark, [(1, "some words", None, None, None)])
    assert language_id.language_id(unlabelled).first().lang_pred == "und"
