"""Exact n-gram Jaccard join by PartEnum signatures.

Two sets of 5-word shingles link when ``100 * |A & B| >= 80 * |A | B|``; then
they differ in at most ``(|A| + |B|) / 9`` shingles.  Sizes fall into bands so
that linked sets lie in the same band or in neighbours; each set is signed for
its own band and the next.  A band's domain is cut into ``k + 1 + e``
partitions, k the largest possible difference: linked sets agree on at least
``e + 1`` of them, and a signature is the set's content in one partition
(subsets of all but k of the partitions need no enumeration beyond single
partitions at these sizes).

Empty contents agree between any sets.  A set with at most e empty partitions
leaves them out without losing a link; one with more keeps them.

Frequent shingles (a line or passage shared by many documents) would make
unrelated sets agree.  Any subset of the domain may be left out of all
signatures, since differences only shrink, so they are; a set that is left
with more than e empty partitions is signed over the full domain as well.  As
two linked sets either have one with at most e, or are both signed in full,
no link is lost whatever the frequent set is: it affects cost only.

Sets with a common signature are linked to the group's smallest document
first; only members that remain in different components are compared with
each other, one document for all of identical sets: block by block, by histograms
of the sets' hashes (an eighth of the sets' size), which bound intersections
from above.  Pairs that pass, few besides the links, are compared exactly over
the two 64-bit hashed sets.  Identical sets of one batch are signed once,
others meet through their digest.

Cases: null or blank text has no shingles and links with nothing; rows of a
repeated doc_id are one document; rows with a null doc_id link with nothing
and get a null component; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carecheck.llm.common import bitmap, blocked, grouped_links, maybe_in, stored
from carecheck.llm.shingles import mix, shingle_set, word_hashes
from carecheck.llm.worker import in_arrow

U = np.uint64
HOT_SHARE = 1 / 1000   # of the documents hold a shingle that counts as frequent
HOT_LEAST = 16         # documents at least
HOT_MOST = 1_000_000   # frequent shingles broadcast at most (8 MB); cost only, see above
BATCH_HOT = 3          # times within a batch that make a shingle worth counting
HELD = 1024            # documents of a batch whose texts or sets are held at a time; memory bound only


def band_starts(most: int) -> list[int]:
    starts = [1]
    while starts[-1] <= most:
        starts.append(starts[-1] * 5 // 4 + 1)
    return starts


_STARTS = np.array(band_starts(1 << 40), np.int64)


def difference(band: int) -> int:
    """The most shingles two linked sets of the band (or the one below) differ in."""
    return 2 * int(_STARTS[band + 1] - 1) // 9


def spare(k: int) -> int:
    return 1 + -(-(k + 1) * 8 // 100)


def _contents(values: np.ndarray, mixed: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a sorted set: the sum of each partition's elements and which are empty.  Partitions are ranges of the hash."""
    bounds = (np.arange(1, parts, dtype=np.uint64) * U((1 << 64) // parts))
    cut = np.concatenate(([0], np.searchsorted(values, bounds), [len(values)]))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed, dtype=np.uint64)))
    return total[cut[1:]] - total[cut[:-1]], cut[1:] == cut[:-1]


def signatures(values: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """All signatures of a sorted set of shingles."""
    if not len(values):
        return values
    band = int(np.searchsorted(_STARTS, len(values), side="right")) - 1
    rare = values
    if len(hot):
        at = np.minimum(np.searchsorted(hot, values), len(hot) - 1)
        rare = values[hot[at] != values]
    out = []
    for b in (band, band + 1):
        k = difference(b)
        if not k:
            continue  # linked sets are identical
        e = spare(k)
        parts = k + 1 + e
        name = np.arange(parts, dtype=np.uint64) + U(b << 32)
        content, empty = _contents(rare, mix(rare), parts)
        out.append(mix(content + mix(name))[~empty])
        if empty.sum() <= e:
            continue
        if len(rare) < len(values):
            content, empty = _contents(values, mix(values ^ U(0x5555)), parts)
            name = name + U(1 << 62)
            out.append(mix(content + mix(name))[~empty])
        if empty.sum() > e:
            out.append(mix(content + mix(name))[empty])
    return np.concatenate(out) if out else values[:0]


def _texts(docs: DataFrame, text: str, key: str) -> DataFrame:
    return docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    return (batch.slice(k, HELD) for k in range(0, batch.num_rows, HELD))


def _sets(batch: pa.RecordBatch) -> Iterator[tuple[int | None, np.ndarray]]:
    for part in _parts(batch):
        yield from zip(part.column(0).to_pylist(), map(shingle_set, word_hashes(part.column(1).to_pylist())))


def repeated(every: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The values found at least ``BATCH_HOT`` times and how often; ``every`` is emptied."""
    if not every:
        return np.zeros(0, U), np.zeros(0, np.int64)
    x = np.concatenate(every)
    every.clear()
    x.sort()
    least = BATCH_HOT - 1
    last = x[least:][x[least:] == x[:len(x) - least]]  # where a run has come to so many
    hot = last[np.concatenate((last[:1] == last[:1], last[1:] != last[:-1]))]
    return hot, np.searchsorted(x, hot, "right") - np.searchsorted(x, hot, "left")


def survey(docs: DataFrame) -> DataFrame:
    """First pass: ``doc_id, n_shingles, digest`` of every row, and ``hot, times`` of shingles frequent in a batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n, digest, every = [], [], [], []
            for i, s in _sets(batch):
                ids.append(i)
                n.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                every.append(s)
            hot, times = repeated(every)
            a, b = len(ids), len(hot)
            yield pa.RecordBatch.from_arrays([
                pa.array(ids + [None] * b, pa.int64()), pa.array(n + [None] * b, pa.int64()),
                pa.array(digest + [None] * b, pa.binary()),
                pa.concat_arrays([pa.nulls(a, pa.int64()), pa.array(hot.view(np.int64), pa.int64())]),
                pa.concat_arrays([pa.nulls(a, pa.int64()), pa.array(times.astype(np.int64), pa.int64())])],
                names=["doc_id", "n_shingles", "digest", "hot", "times"])

    return in_arrow(docs, run, "doc_id bigint, n_shingles bigint, digest binary, hot bigint, times bigint")


def frequent(first: DataFrame) -> np.ndarray:
    """The frequent shingles, at most HOT_MOST of them, sorted."""
    n = first.filter(F.col("n_shingles").isNotNull()).count()
    rows = (first.filter(F.col("hot").isNotNull()).groupBy("hot").agg(F.sum("times").alias("times"))
            .filter(F.col("times") >= max(HOT_LEAST, HOT_SHARE * n)).orderBy(F.desc("times"), "hot").limit(HOT_MOST)
            .select("hot").toArrow())
    return np.sort(rows.column(0).to_numpy().view(np.uint64)) if rows.num_rows else np.zeros(0, np.uint64)


def signed(docs: DataFrame, hot: np.ndarray) -> DataFrame:
    """``sig, doc_id``: second pass; identical sets of one batch are signed once, by one of their doc_ids."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[bytes] = set()
            for part in _parts(batch):
                ids, sigs = [], []
                for i, s in _sets(part):
                    if i is not None and len(s):
                        d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                        if d not in seen:
                            seen.add(d)
                            ids.append(i)
                            sigs.append(signatures(s, shared.value))
                if ids:
                    rows = np.repeat(np.array(ids, np.int64), [len(s) for s in sigs])
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(rows)],
                                                     names=["sig", "doc_id"])

    return in_arrow(docs, run, "sig bigint, doc_id bigint")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """``doc_id, set``: the sorted set as little-endian 64-bit hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in _parts(b)):
            ids, sets = zip(*((i, s.tobytes()) for i, s in _sets(batch)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], names=["doc_id", "set"])

    return in_arrow(docs, run, "doc_id bigint, set binary")


def histogram(values: np.ndarray) -> bytes:
    """How many of a sorted set's hashes fall into each of equal ranges, about as many as it has; none where one
    byte is too small."""
    slots = 1 << max(4, len(values).bit_length())
    cut = np.searchsorted(values, np.arange(slots, dtype=np.uint64) * U((1 << 64) // slots))
    counts = np.diff(np.append(cut, len(values)))
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


def histograms(docs: DataFrame) -> DataFrame:
    """``doc_id, n, histogram``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in _parts(b)):
            ids, n, h = zip(*((i, len(s), histogram(s)) for i, s in _sets(batch)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(h, pa.binary())],
                                             names=["doc_id", "n", "histogram"])

    return in_arrow(docs, run, "doc_id bigint, n bigint, histogram binary")


def may_link(m: int, n: int, x: bytes, y: bytes) -> bool:
    """False only if sets of these sizes and histograms cannot link."""
    if 5 * min(m, n) < 4 * max(m, n):
        return False
    if not x or not y:
        return True
    p, q = np.frombuffer(x, np.uint8).astype(np.int64), np.frombuffer(y, np.uint8).astype(np.int64)
    if len(p) < len(q):
        p, q = q, p
    if len(p) > len(q):  # ranges of the finer one fall into those of the coarser
        p = p.reshape(len(q), -1).sum(axis=1)
    return 9 * int(np.minimum(p, q).sum()) >= 4 * (m + n)


def do_link(x: bytes, y: bytes) -> bool:
    p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    if not len(p) or not len(q):
        return False
    at = np.minimum(np.searchsorted(q, p), len(q) - 1)
    return 9 * int(np.count_nonzero(q[at] == p)) >= 4 * (len(p) + len(q))


def _survivors(rows: list[tuple], p: int, q: int) -> Iterator[tuple[int, int]]:
    """Pairs of blocks p and q (rows: block, id, root, n, histogram) with different roots that may link."""
    left, right = [r for r in rows if r[0] == p], [r for r in rows if r[0] == q]
    slots = sorted({len(r[4]) for r in rows if r[4]})
    folded = {}
    for k in slots:  # sizes within 0.8 have as many slots, or twice as many
        same = [r for r in right if len(r[4]) in (k, 2 * k)]
        if same:
            folded[k] = same, np.array([np.frombuffer(r[4], np.uint8).astype(np.int32).reshape(k, -1).sum(axis=1) for r in same])
    for _, i, root, n, h in left:
        if not h:
            yield from ((i, j) for _, j, other, m, _ in right if other != root and i != j and may_link(n, m, b"", b""))
            continue
        own = np.frombuffer(h, np.uint8).astype(np.int32)
        yield from ((i, j) for _, j, other, m, g in right if not g and other != root and may_link(n, m, b"", b""))
        for k in (len(own), len(own) // 2):
            if k not in folded:
                continue
            others, matrix = folded[k]
            common = np.minimum(own.reshape(k, -1).sum(axis=1), matrix).sum(axis=1)
            for (_, j, other, m, g), c in zip(others, common):
                if other != root and (k == len(own) or len(g) == k) and 5 * min(m, n) >= 4 * max(m, n) and 9 * c >= 4 * (m + n):
                    yield i, j


def crossing(apart: DataFrame, docs: DataFrame) -> DataFrame:
    """``(a, b)``: pairs with a common signature and different roots that may link.  Documents with a common
    signature share its representative, so they are compared by representative: block by block, without a row for a pair that cannot link."""
    ids = apart.select(F.col("id").alias("a"), F.col("id").alias("b")).distinct()
    d = blocked(apart, histograms(_among(docs, ids)).withColumnRenamed("doc_id", "id"))

    def run(table: pa.Table) -> pa.Table:
        p, q = table.column("p")[0].as_py(), table.column("q")[0].as_py()
        rows = list(zip(*(table.column(c).to_pylist() for c in ("block", "id", "root", "n", "histogram"))))
        found = {(max(i, j), min(i, j)) for i, j in _survivors(rows, p, q)}
        a, b = zip(*found) if found else ((), ())
        return pa.Table.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return d.groupBy("rep", "p", "q").applyInArrow(run, "a bigint, b bigint").distinct()


def _among(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The documents that occur in the pairs."""
    ids = stored(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "candidates")
    return maybe_in(docs, "doc_id", bitmap(ids, "doc_id")).join(ids, "doc_id")


def _both(pairs: DataFrame, of: DataFrame, names: list[str]) -> DataFrame:
    """The pairs with their two documents' columns, x_ and y_."""
    side = lambda key, mark: of.select(F.col("doc_id").alias(key), *[F.col(c).alias(mark + c) for c in names])
    return (pairs.join(side("a", "x_"), "a").join(side("b", "y_"), "b")
            .select("a", "b", *[mark + c for c in names for mark in ("x_", "y_")]))


def _passing(both: DataFrame, test) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in _parts(b)):
            keep = [test(*row) for row in zip(*(c.to_pylist() for c in batch.columns[2:]))]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return in_arrow(both, run, "a bigint, b bigint").distinct()


def linked(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of ``pairs(a, b)`` whose sets link: bounded by the histograms first, then compared."""
    near = _both(pairs, histograms(_among(docs, pairs)), ["n", "histogram"])
    near = stored(_passing(near, may_link), "near")
    return _passing(_both(near, shingle_sets(_among(docs, near)), ["set"]), do_link)


def jaccard_join(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row."""
    d = _texts(docs, text, key)
    first = stored(survey(d), "shingle-survey")
    info = first.filter(F.col("n_shingles").isNotNull()).select("doc_id", "n_shingles", "digest")
    named = info.filter("doc_id is not null and digest is not null")
    same = (named.join(named.groupBy("digest").agg(F.min("doc_id").alias("b")), "digest")
            .filter("doc_id <> b").select(F.col("doc_id").alias("a"), "b"))
    firsts = named.groupBy("digest").agg(F.min("doc_id").alias("same"))
    known = (named.join(firsts, "digest").groupBy("doc_id").agg(F.min("same").alias("low"), F.max("same").alias("high"))
             .select(F.col("doc_id").alias("id"),  # a repeated doc_id may hold several sets: it stays itself
                     F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.col("doc_id")).alias("same")))
    final = grouped_links(signed(d, frequent(first)).withColumnRenamed("doc_id", "id"),
                          lambda pairs: stored(linked(pairs, d), "links"),
                          lambda apart: linked(stored(crossing(apart, d), "rest"), d), same, known)
    return (info.join(final.withColumnRenamed("node", "doc_id"), "doc_id", "left")
            .select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id")))
