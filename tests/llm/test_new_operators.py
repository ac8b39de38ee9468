"""Importance resampling, Merkle manifest and sharding against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import cases
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from carecheck.llm import merkle, resample, sharding

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BIG = "ÄÖ x" + "y" * 300 + " " + "é" * 100 + " Z9-a_b"


# ---------------------------------------------------------------- resampling
def features(text, ngram):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    return len(w), [" ".join(w[i:i + n]) for n in range(1, ngram + 1) for i in range(len(w) - n + 1)]


def resampled(docs, target, ngram, buckets, seed, percent, least):
    of = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(of(f) for _, t in docs for f in features(t, ngram)[1])
    t = Counter(of(f) for x in target for f in features(x, ngram)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    rows = []
    for i, text in docs:
        n, fs = features(text, ngram)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[of(f)] for f in fs)
        rows.append((i, len(fs), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= least))
    pool = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): k + 1 for k, r in enumerate(pool[:percent * len(pool) // 100])}
    return sorted(((*r[:4], rank.get(id(r))) for r in rows), key=repr)


@pytest.mark.parametrize("ngram,buckets,percent,least", [(1, 10_000, 10, 20), (2, 997, 50, 1), (3, 16, 100, 0)])
def test_resampling_equals_brute_force(spark, small, monkeypatch, ngram, buckets, percent, least):
    monkeypatch.setattr(resample, "SLICE", 5_000)
    target = spark.createDataFrame([("the cat sat " + BIG,), (None,), ("",), ("warm window of the house",)], "text string")
    awkward = cases.docs(spark, cases.ROWS + [(20, BIG, None, None, None), (21, " ".join(f"{BIG} {i}" for i in range(40)), None, None, None)])
    for docs in (awkward, small):
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        got = resample.resample(docs, target, ngram, buckets, 7, percent, least)
        assert [f.dataType.simpleString() for f in got.schema] == ["bigint"] * 5
        want = resampled(rows, [r.text for r in target.collect()], ngram, buckets, 7, percent, least)
        assert sorted((tuple(r) for r in got.collect()), key=repr) == want


def test_drawn_rows_keep_their_columns(spark, small):
    target = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    some = resample.drawn(small, target)
    ids = {r.doc_id for r in resample.resample(small, target).collect() if r.rank}
    assert some.columns == small.columns and {r.doc_id for r in some.collect()} == ids and ids


# ---------------------------------------------------------------- manifest
def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def climbed(nodes):
    """All levels of a tree; the last has one node."""
    rows = [nodes]
    while len(rows[-1]) > 1:
        rows.append([sha("".join(rows[-1][i:i + 3])) for i in range(0, len(rows[-1]), 3)])
    return rows


def proven(rows):
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: sha("".join(map(part, (r.doc_id, r.source, r.lang, r.n_chars, text))))
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    keys = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for k in keys:
        by[k].sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r, r.text)))
    trees = {k: climbed([leaf(r, r.text) for r in by[k]]) for k in keys}
    over = climbed([trees[k][-1][0] for k in keys])
    out = []
    for n, k in enumerate(keys):
        for i, r in enumerate(by[k]):
            text = r.text
            if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            cur, proof = leaf(r, text), []
            for tree, at in ((trees[k], i), (over, n)):
                for row in tree[:-1]:
                    run = range(at - at % 3, min(at - at % 3 + 3, len(row)))
                    proof += [row[j] for j in run if j != at]
                    cur = sha("".join(cur if j == at else row[j] for j in run))
                    at //= 3
            root = over[-1][0]
            out.append((r.doc_id, leaf(r, r.text), trees[k][-1][0], root, sha("".join(proof)), cur, cur == root))
    return sorted(out, key=repr)


def test_layout_places_every_node_once_and_splits_at_half_height():
    for levels in range(1, 9):
        place = merkle.addresses(levels)
        assert [len(x) for x in place] == [3 ** d for d in range(levels)]
        assert sorted(a for x in place for a in x) == list(range(merkle.nodes_of(levels)))
    upper, low = merkle.addresses(2), merkle.addresses(2)
    whole = merkle.addresses(4)
    assert [list(x) for x in whole[:2]] == [list(x) for x in upper]
    assert list(whole[3][6:9]) == [4 + 4 * 2 + a for a in low[1]]  # the third lower subtree's leaves


@pytest.mark.parametrize("height", [1, 2, merkle.HEIGHT])
def test_proofs_equal_brute_force(spark, small, height):
    tail = [(100 + i, f"line {i}\nnext", "en", "hot", i) for i in range(31)] + [(200 + i, "one\ntwo", None, f"host{i % 11}", None) for i in range(14)]
    for docs in (cases.docs(spark, cases.ROWS + tail), small, cases.docs(spark, cases.ROWS[:1])):
        got = sorted((tuple(r) for r in merkle.proofs(docs, height).collect()), key=repr)
        assert got == proven(docs.collect())
    broken = [r for r in got if not r[-1]]
    assert all(r[5] != r[3] for r in broken)


def test_trees_with_many_rounds(spark):
    rows = [(i, None, None, None if i % 2 else "one", None) for i in range(400)]
    docs = cases.docs(spark, rows)
    assert sorted((tuple(r) for r in merkle.proofs(docs, 1).collect()), key=repr) == proven(docs.collect())


# ---------------------------------------------------------------- sharding
def spread(sizes, part, parts):
    sums = [0] * parts
    for s, p in zip(sizes, part):
        sums[p] += s
    return max(sums) - min(sums)


def test_differencing_by_hand():
    # 8 7 6 5 4: 8-7=1, 6-5=1, 4-1=3, 3-1=2
    assert spread([8, 7, 6, 5, 4], sharding.differencing([8, 7, 6, 5, 4], 2), 2) == 2
    assert sharding.differencing([], 3) == [] and sharding.differencing([5], 3) == [0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 1000), max_size=60), st.integers(1, 7))
def test_differencing_stays_within_the_largest_item(sizes, parts):
    part = sharding.differencing(sizes, parts)
    assert len(part) == len(sizes) and all(0 <= p < parts for p in part)
    if sizes:
        assert spread(sizes, part, parts) <= max(sizes)


def check_shards(rows, got, shards):
    assert len(got) == len(rows)
    size = {r.doc_id: len((r.text or "").encode()) + 16 for r in rows}
    crc = {r.doc_id: zlib.crc32((r.text or "").encode()) for r in rows}
    text = {r.doc_id: r.text or "" for r in rows}
    slots, of_text, sums = defaultdict(list), {}, [0] * shards
    for r in got:
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (size[r.doc_id], crc[r.doc_id], "bytes", None)
        assert of_text.setdefault(text[r.doc_id], r.shard) == r.shard
        slots[r.shard].append(r.slot)
        sums[r.shard] += r.size
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    return sums


def test_shards_hold_whole_groups_and_near_equal_bytes(spark, small):
    rows = small.collect()
    got = sharding.sharded(small, 8)
    first = sorted(tuple(r) for r in got.drop("grown_shard").collect())
    sums = check_shards(rows, got.collect(), 8)
    by_text = Counter()
    for r in rows:
        by_text[r.text] += len(r.text.encode()) + 16
    mean = sum(sums) / 8
    assert max(by_text.values()) > mean or max(sums) - min(sums) <= min(by_text.values()) + 0.02 * mean
    assert sorted(tuple(r) for r in sharding.sharded(small.repartition(5), 8).drop("grown_shard").collect()) == first


def test_a_group_of_a_third_of_all_rows_stays_whole_and_the_rest_is_even(spark):
    rows = [(i, "copied " * 30 if i % 3 == 0 else f"text number {i} " * (1 + i % 40), None, None, None) for i in range(3000)]
    docs = cases.docs(spark, rows)
    sums = sorted(check_shards(docs.collect(), sharding.sharded(docs, 20).collect(), 20))
    assert sums[-1] == max(1000 * (210 + 16), sums[-2]) and sums[-2] - sums[0] <= 100


def test_awkward_rows_get_shards_and_gapless_slots(spark):
    for docs in (cases.docs(spark), cases.clashing(spark)):
        got = sharding.sharded(docs, 3).collect()
        slots = defaultdict(list)
        for r in got:
            slots[r.shard].append(r.slot)
        assert len(got) == len(cases.ROWS) and all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_written_shards_hold_every_row_once_in_order(spark, small, tmp_path):
    path = f"{tmp_path}/out"
    sharding.write_shards(small, path, 4, 2)
    back = spark.read.parquet(path)
    assert sorted(map(repr, back.select(*small.columns).collect())) == sorted(map(repr, small.collect()))
    want = {r.doc_id: r.shard for r in sharding.sharded(small, 4).collect()}
    assert {r.doc_id: r.shard for r in back.collect()} == want
