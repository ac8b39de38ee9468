"""Line dedup against all pairs, with shingles defined here: every 5 characters of the whole line."""

import os
import re
import time

import cases
import numpy as np
from test_similarity import roots

from carecheck.llm import common, line_dedup


def whole_line_shingles(line):
    line = line.lower()
    return {line[i:i + 5] for i in range(max(1, len(line) - 4))}


def linked(x, y):
    return 5 * len(x & y) >= 4 * len(x | y)


def dropped(spark, lines):
    docs = cases.docs(spark, [(i, x, None, None, None) for i, x in enumerate(lines)])
    return {r.doc_id for r in line_dedup.line_dedup(docs).collect() if r.n_dropped}


def test_lines_without_spaces_that_share_their_first_characters(spark):
    row = ",".join(str(1000 + i * 37) for i in range(30))
    lines = ["https://example.com/a", "https://example.com/b/other/path", "https://example.com/zq?x=1",
             row, row[:13] + ",".join(str(9000 - i * 41) for i in range(30)), row.replace("1370", "1371"),
             '{"key":"value","n":1}', '{"key":"value","other":[7,8,9]}', "今天天气很好我们一起去公园散步吧然后回家", "今天天气很好我们一起去公园散步但是下雨了所以没去",
             "\U0001F600\U0001F601x" * 6 + "abc", "\U0001F600\U0001F601x" * 6 + "what else there is", "ab", "ac", "AB"]
    sets = [whole_line_shingles(x) for x in lines]
    want = roots(range(len(lines)), lambda a, b: linked(sets[a], sets[b]))
    got = dropped(spark, lines)
    assert got == {i for i in range(len(lines)) if want[i] != i}
    assert {1, 2, 4, 7, 9, 11, 13}.isdisjoint(got) and {5, 14} <= got


def test_near_copies_with_one_changed_character_a_word_apart(spark):
    base = "The annual report of the committee was read and adopted by all members present at the meeting on {}"
    lines = [base.format(f"day {i} of {w}") for i, w in enumerate(["May", "June"])] + [base.format("day 1 of June").replace("adopted", "adapted")]
    sets = [whole_line_shingles(x) for x in lines]
    want = roots(range(len(lines)), lambda a, b: linked(sets[a], sets[b]))
    assert dropped(spark, lines) == {i for i in range(len(lines)) if want[i] != i} == {1, 2}


def test_family_of_lines_around_the_threshold_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(common, "BLOCK", 4)
    lines = []
    for k in range(24):
        w = [f"{chr(97 + i % 26)}{i * 7919 % 9973}" for i in range(60)]
        for e in range(k % 12):
            w[(5 * e + 7 * (k // 12)) % 60] = f"edit{k // 12}{e:02d}z"
        lines.append(" ".join(w) + f" end{k:02d}")
    sets = [whole_line_shingles(x) for x in lines]
    want = roots(range(24), lambda a, b: linked(sets[a], sets[b]))
    assert dropped(spark, lines) == {i for i in range(24) if want[i] != i}


def test_measured_recall_of_short_lines_at_the_threshold():
    trials, rng = 2000, np.random.default_rng(5)
    for size in (5, 10, 20, 60):  # of the union; a tenth of it is only on the left, a tenth only on the right
        hits, one = 0, size // 10
        for _ in range(trials):
            union = rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, size, dtype=np.uint64)
            x, y = (union[:size - one], union[one:]) if size > 5 else (union, union[1:])
            low = line_dedup.minima(np.concatenate((x, y)), np.array([0, len(x)])).reshape(line_dedup.BANDS, line_dedup.ROWS, 2)
            hits += bool((low[:, :, 0] == low[:, :, 1]).all(axis=1).any())
        print(size, hits / trials)
        assert hits >= 0.99 * trials  # 0.995 expected of independent permutations


def test_shared_shingles_are_counted_alike_in_parts(monkeypatch):
    lines = ["ab", "ac", "AB", "x" * 40, "abcde", "abcdefgh" * 9, "abcdefgi" * 9, "é" * 3 + "漢字" * 4] + [f"line {i} of words" * 3 for i in range(9)]
    sets = [whole_line_shingles(x) for x in lines]
    for held, columns in ((1 << 22, 4096), (20, 7)):
        monkeypatch.setattr(line_dedup, "GROUP_SHINGLES", held)
        monkeypatch.setattr(line_dedup, "GROUP_COLUMNS", columns)
        n, common = line_dedup.in_common(lines)
        assert n.tolist() == [len(s) for s in sets]
        assert all(common[i, j] == len(x & y) for i, x in enumerate(sets) for j, y in enumerate(sets) if i != j)
    xs, ys = zip(*((x, y) for x in lines for y in lines))
    want = [linked(x, y) for x in sets for y in sets]
    for chars in (1 << 17, 60, 1):
        monkeypatch.setattr(line_dedup, "CHUNK", chars)
        assert line_dedup.do_link(list(xs), list(ys)).tolist() == want
    h, n = line_dedup.shingle_hashes(lines)
    assert n.tolist() == [max(1, len(x) - 4) for x in lines]
    every = [s for x in lines for s in ([x.lower()] if len(x) < 5 else [x.lower()[i:i + 5] for i in range(len(x) - 4)])]
    assert len(set(every)) == len(set(h.tolist())) and len(dict(zip(every, h.tolist()))) == len(set(zip(every, h.tolist())))


def test_sketches_rule_out_most_unlinked_pairs_and_no_link():
    rng = np.random.default_rng(11)
    words = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(300)]
    lines = [" ".join(rng.choice(words, rng.integers(1, 30))) for _ in range(400)] + ["-" * 90, "-" * 40, "", "ab", "abc ", "\U0001F600" * 9]
    near = []
    for x in lines:
        y = list(x) or ["q"]
        for _ in range(rng.integers(0, 5)):
            y[rng.integers(len(y))] = "Z"
        near.append("".join(y))
    xs, ys = lines + lines, near + lines[7:] + lines[:7]
    (n, a), (m, b) = line_dedup.sketch(xs), line_dedup.sketch(ys)
    may = 9 * np.bitwise_count(a ^ b).astype(int).sum(axis=1) <= n + m
    links = np.array([linked(whole_line_shingles(x), whole_line_shingles(y)) for x, y in zip(xs, ys)])
    assert not (links & ~may).any() and links.sum() > 200 and may.sum() < 1.5 * links.sum()


def test_only_lines_that_may_link_move_their_texts(spark, monkeypatch):
    """Lines of one band that their sketches tell apart are not compared by their texts."""
    lines = [" ".join(str(k * 7919 + j) for k in range(20)) + f" end{i}" for j in (1234, 56789) for i in range(3)]
    docs = cases.docs(spark, [(i, x, None, None, None) for i, x in enumerate(lines)])
    ids = line_dedup._named_lines(docs, "text").select("id", "line")
    name = {r.line: bytes(r.id) for r in ids.collect()}
    marks = line_dedup.sketches(docs, "text", ids.select("id"))
    all_pairs = ids.select(ids.id.alias("a")).crossJoin(ids.select(ids.id.alias("b"))).filter("a > b")
    want = {tuple(sorted((name[x], name[y]))) for x in lines for y in lines if x < y and x[:4] == y[:4]}
    assert {tuple(sorted((bytes(r.a), bytes(r.b)))) for r in line_dedup.may_link(all_pairs, marks).collect()} == want
    apart = ids.selectExpr("unhex(md5('one')) AS rep", "id", "id AS root")
    far = apart.filter(apart.id.isin(name[lines[0]], name[lines[3]]))
    for block in (1, 256):
        monkeypatch.setattr(common, "BLOCK", block)
        assert {bytes(r.id) for r in line_dedup.with_partners(apart, marks).collect()} == set(name.values())
        assert line_dedup.with_partners(far, marks).count() == 0


def test_sketches_tell_long_lines_apart(spark):
    rng = np.random.default_rng(3)
    lines = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz "), 900)) for _ in range(40)]
    n, marks = line_dedup.sketch(lines)
    differ = np.bitwise_count(marks[:, None] ^ marks).astype(int).sum(axis=2)
    assert ((9 * differ <= n + n[:, None]) == np.eye(40, dtype=bool)).all()


def test_groups_compared_together_give_the_partners_of_all_pairs(monkeypatch):
    rng = np.random.default_rng(8)
    base = ["".join(rng.choice(list("abcdefghij"), 160)) for _ in range(6)]
    lines = [b[:k] + "#" + b[k:] for b in base for k in (7, 20, 33, 46)] * 3
    n, marks = line_dedup.sketch(lines)
    block, root = np.arange(len(lines)) % 2, np.arange(len(lines)) // 2 % 5
    groups = [(0, 0, 0, 0), (1, 1, 0, 1), (0, 1, 1, 30), (1, 1, 30, 31), (0, 1, 31, 71)]
    want = {i for p, q, s, e in groups for i in range(s, e) for j in range(s, e) if i != j and root[i] != root[j]
            and (p == q or block[i] != block[j]) and 9 * int(np.bitwise_count(marks[i] ^ marks[j]).sum()) <= n[i] + n[j]}
    assert len(want) > 20
    for pairs in (1, 100, 1 << 15):
        monkeypatch.setattr(line_dedup, "PAIRS", pairs)
        assert line_dedup.with_partner(marks, n, block, root, groups).tolist() == sorted(want)


def test_files_that_nothing_reads_any_more_are_deleted(spark):
    lines = [f"a line of words that comes again and again {i % 7} times and ends in {i // 7}" for i in range(40)]
    docs = cases.docs(spark, [(i, x, None, None, None) for i, x in enumerate(lines)])
    with common.recorded() as paths:
        out = line_dedup.line_dedup(docs)
    left = {re.sub("^llm-|-[0-9a-f]{32}$", "", os.path.basename(p)) for p in paths if os.path.exists(p.removeprefix("file://"))}
    assert out.count() == 40 and left == {"lines", "line-components", "line-roots", "kept-lines"}


def test_a_stored_table_leaves_no_shuffle_files(spark):
    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f for f in (found.apply(i).getName() for i in range(found.size())) if f.startswith("shuffle_")}
    setting, before = spark.conf.get(common.CLEANUP, None), files()
    rows = common.stored(spark.range(1000).repartition(3, "id"), "some")
    until = time.time() + 20
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert files() <= before and spark.conf.get(common.CLEANUP, None) == setting and rows.count() == 1000
