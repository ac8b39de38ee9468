"""Target-distribution importance resampling with hashed n-gram features.

Features (runs of 1 to ``ngram`` words, words being runs of ASCII letters and
digits and of all characters beyond ASCII, A-Z lower-cased) fall into
``buckets`` by their CRC-32, which ``crc_spans`` computes for all spans of a
batch of texts with a position table.  Bucket counts of the target texts
against those of all documents give each bucket an integer log-ratio gain, a
document weighs the sum of its features' gains, Gumbel noise from a hash of
its doc_id is added, and of the documents long enough the highest scores are
drawn: sampling without replacement in proportion to the importance weights.

Two scans of the texts, both bounded by one batch: the first emits at most
``buckets`` counts a task, the second the weight of each document, with the
gains (``buckets`` integers, whatever the input) in the task.  Ranks come from
one range shuffle of (doc_id, score).

Cases: null and empty texts have no feature, weight 0 and are never drawn;
a null doc_id enters the noise as an empty string and ranks last among equal
scores; repeated rows get ranks of their own in arbitrary order; an empty
table or target gives an empty result or gains by the documents alone; extra
columns are ignored by ``resample`` and kept by ``drawn``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carecheck.llm.crc_spans import crc32_spans
from carecheck.llm.ordered import numbered

NGRAM = 1
BUCKETS = 10_000
SEED = 2024
PERCENT = 10
LEAST_WORDS = 20
SLICE = 4 << 20  # bytes of text worked on at a time

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, dtype=bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = _IN_WORD[128:] = True


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The lower-cased bytes of all texts in a row, and the bounds of each text in them."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    at = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[at[0]:at[-1]]
    return _LOWER[data], at - at[0]


def _words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``start, end, text`` of every word."""
    inside = np.zeros(len(data) + 2, dtype=bool)  # a gap on both sides
    inside[1:-1] = _IN_WORD[data]
    opens, closes = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    full = bounds[:-1] < bounds[1:]
    first, last = bounds[:-1][full], bounds[1:][full] - 1  # a word ends with its text
    opens[first], closes[last] = inside[1:-1][first], inside[1:-1][last]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return start, end, np.searchsorted(bounds[1:], start, "right")


def _features(data, start, end, text, ngram: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``crc, text`` of the features of each order; longer runs are spans of the words written with one space between."""
    yield crc32_spans(data, start, end - start), text
    if ngram > 1 and len(start):
        size = end - start
        at = np.cumsum(size + 1) - (size + 1)
        spaced = np.full(int(at[-1] + size[-1]), 32, dtype=np.uint8)
        i = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        spaced[np.repeat(at, size) + i] = data[np.repeat(start, size) + i]
        for n in range(2, ngram + 1):
            whole = np.flatnonzero(text[:len(text) - n + 1] == text[n - 1:])
            last = whole + n - 1
            yield crc32_spans(spaced, at[whole], at[last] + size[last] - at[whole]), text[whole]


def _slices(batches: Iterator[pa.RecordBatch], column: str):
    for b in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        lo = 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + SLICE, "right")))
            yield b.slice(lo, hi - lo)
            lo = hi


def bucket_counts(texts: DataFrame, text: str = "text", ngram: int = NGRAM, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, n``: how many features of all texts fall into each bucket (those without are left out)."""

    def count(batches):
        n = np.zeros(buckets, dtype=np.int64)
        for b in _slices(batches, "t"):
            data, bounds = _bytes(b.column("t"))
            for crc, _ in _features(data, *_words(data, bounds), ngram):
                n += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        hit = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(hit.astype(np.int64)), pa.array(n[hit])], names=["bucket", "n"])

    each = texts.select(F.col(text).alias("t")).mapInArrow(count, "bucket bigint, n bigint")
    return each.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text",
          ngram: int = NGRAM, buckets: int = BUCKETS) -> list[int]:
    """The gain of every bucket: 1000 times the log of how much likelier it is in the target, rounded down."""
    found = [{r.bucket: r.n for r in bucket_counts(d, c, ngram, buckets).collect()}  # at most ``buckets`` rows
             for d, c in ((docs, text), (target, target_text))]
    all_s, all_t = (float(sum(x.values()) + buckets) for x in found)
    return [math.floor(1000 * math.log((found[1].get(b, 0) + 1) * all_s / ((found[0].get(b, 0) + 1) * all_t)))
            for b in range(buckets)]


def weights(docs: DataFrame, gain: list[int], text: str = "text", key: str = "doc_id", ngram: int = NGRAM) -> DataFrame:
    """``doc_id, n_words, n_features, weight`` of every row."""
    by_bucket = np.array(gain, dtype=np.float64)  # sums below 2^53 are exact

    def weigh(batches):
        for b in _slices(batches, "t"):
            data, bounds = _bytes(b.column("t"))
            start, end, doc = _words(data, bounds)
            n, w = np.zeros(b.num_rows, dtype=np.int64), np.zeros(b.num_rows)
            for crc, of in _features(data, start, end, doc, ngram):
                n += np.bincount(of, minlength=b.num_rows)
                w += np.bincount(of, weights=by_bucket[crc % np.uint32(len(gain))], minlength=b.num_rows)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(np.bincount(doc, minlength=b.num_rows).astype(np.int64)), pa.array(n),
                 pa.array(w.astype(np.int64))], names=["doc_id", "n_words", "n_features", "weight"])

    d = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("t"))
    return d.mapInArrow(weigh, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def noise(key: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of a hash of the seed and the key."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10)
    return F.floor(-1000 * F.log(-F.log((h.cast("double") + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, ngram: int = NGRAM, buckets: int = BUCKETS, seed: int = SEED,
             percent: int = PERCENT, least_words: int = LEAST_WORDS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every row; rank is null for those not drawn."""
    w = weights(docs, gains(docs, target, text, ngram=ngram, buckets=buckets), text, key, ngram)
    scored = w.select("doc_id", "n_features", "weight", (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score"),
                      (F.col("n_words") >= least_words).alias("eligible"))
    at = numbered(scored, [], [F.col("eligible").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last()], "scores")
    n = at.filter("eligible").count()
    rank = F.when(F.col("eligible") & (F.col("at") < percent * n // 100), F.col("at") + 1)
    return at.select("doc_id", "n_features", "weight", "score", rank.cast("bigint").alias("rank"))


def drawn(docs: DataFrame, target: DataFrame, key: str = "doc_id", **kw) -> DataFrame:
    """The rows of ``docs`` that are drawn (all rows of a drawn doc_id; null doc_ids cannot be found again and stay out)."""
    ids = resample(docs, target, key=key, **kw).filter("rank is not null").select(F.col("doc_id").alias("_drawn")).distinct()
    return docs.join(ids, F.col(key).cast("bigint") == F.col("_drawn"), "left_semi")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT {_WORDS} AS w FROM benchmark),
crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i] || [0, 0, 0, 0, 0, 0, 0, 0],
               lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
v AS (SELECT DISTINCT unnest(w) AS word FROM (SELECT w FROM d UNION ALL SELECT w FROM b)),
h AS (SELECT word, xor(list_reduce([4294967295] || list_transform(range(octet_length(encode(word))),
               lambda k: CAST('0x' || substr(hex(encode(word)), CAST(2 * k + 1 AS BIGINT), 2) AS BIGINT)),
               lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255) + 1])), 4294967295) % {BUCKETS} AS bucket FROM v, crc),
dw AS (SELECT doc_id, unnest(w) AS word FROM d),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN h USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM (SELECT unnest(w) AS word FROM b) JOIN h USING (word) GROUP BY bucket),
g AS (SELECT r.bucket, CAST(floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * CAST((SELECT coalesce(sum(s), 0) FROM s) + {BUCKETS} AS DOUBLE)
             / (CAST(coalesce(s, 0) + 1 AS DOUBLE) * CAST((SELECT coalesce(sum(t), 0) FROM t) + {BUCKETS} AS DOUBLE)))) AS BIGINT) AS gain
      FROM range({BUCKETS}) r(bucket) LEFT JOIN s ON s.bucket = r.bucket LEFT JOIN t ON t.bucket = r.bucket),
f AS (SELECT doc_id, count(*) AS n, sum(gain) AS weight FROM dw JOIN h USING (word) JOIN g USING (bucket) GROUP BY doc_id),
x AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
             CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{SEED}:' || d.doc_id), 1, 8) AS BIGINT) + 0.5) / 4294967296.0))) AS BIGINT) AS score
      FROM d LEFT JOIN f ON d.doc_id = f.doc_id),
r AS (SELECT *, n_features >= {LEAST_WORDS} AS eligible FROM x),
k AS (SELECT *, row_number() OVER (PARTITION BY eligible ORDER BY score DESC, doc_id) AS pos, count(*) FILTER (eligible) OVER () AS n FROM r)
SELECT doc_id, n_features, weight, score, CASE WHEN eligible AND pos <= {PERCENT} * n // 100 THEN pos END AS rank FROM k
"""
