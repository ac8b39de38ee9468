"""Language-model scoring with an Elias-Fano n-gram trie.

Counts.  Documents fall into blocks by hash (about ``BLOCK_CHARS`` characters
each).  A block reports each of its distinct n-grams once, with its count in
the block's training documents (0 where only other documents have it), as
sorted 64-bit hashes packed by hash range.  Each hash range adds up all blocks'
counts and answers every block with the global counts of its own n-grams, in
the order asked.  The longest n-grams are counted after the others, so that not
all messages are on disk at once.  So a frequent n-gram costs one entry per block, no count
stays local, and no task or driver ever holds the corpus vocabulary.

Model.  Tokens are lower-cased words and one end per document.  Interpolated:
``p(w|h) = L c(hw)/c(h) + (1 - L) p(w|shorter h)`` down to the additively
smoothed unigram.  No n-gram is pruned (``MIN_COUNT`` is 1), so that ``c(h)`` is
the sum of ``c(hw)`` and each context's probabilities sum to 1.

Trie.  For its own n-grams a block builds the levels of the global model: the
entry (context, word) of a level is the number ``context * V + word``, context
being the entry's index in the level above, so each level is one increasing
sequence.  It is kept in Elias-Fano form (low bits packed, high bits unary)
with a 16-bit quantised log probability per entry, all in one anonymous memory
map.  A query goes from the context's index to the run of entries with the
same high bits and searches the low bits there.

Cases: null text counts as empty (its one token is the end); a null doc_id
counts as the empty text in the split; repeated rows are scored row by row and
count as often as they occur; with no training document every probability is
the smoothed unigram's; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import mmap

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carecheck.llm.common import stored
from carecheck.llm.shingles import mix, word_hashes

U = np.uint64
ORDER = 3
MIN_COUNT = 1  # nothing is pruned: each context's probabilities sum to 1
LAMBDA = 0.6
ADD = 0.1
BLOCK_CHARS = 8_000_000
RANGE_CHARS = 8_000_000  # of text per hash range
GRID = 4096              # quantisation steps per unit of -log10 p
END, BEGIN = U(0x1D872B41F2F1A3C5), U(0x9B97F7D1A65D3C11)


def is_held_out(key: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % 10 == 0


# ------------------------------------------------------------- Elias-Fano
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)
_NTH = np.zeros((256, 8), np.uint8)  # position of the n-th one of a byte
for _b in range(256):
    for _k, _p in enumerate(p for p in range(8) if _b >> p & 1):
        _NTH[_b, _k] = _p


class EliasFano:
    """An increasing sequence of n numbers below ``universe`` in about ``2 + log2(universe / n)`` bits each."""

    def __init__(self, values: np.ndarray, universe: int):
        n = len(values)
        self.n, self.low_bits = n, max(0, (universe // max(n, 1)).bit_length() - 1)
        high = (values >> U(self.low_bits)).astype(np.int64)
        bits = np.zeros((universe >> self.low_bits) + n + 2, np.uint8)
        bits[:] = 1  # a one ends each high value, a zero stands for each entry
        bits[high + np.arange(n)] = 0
        self.highs = len(bits) - n
        unary = np.packbits(bits, bitorder="little")
        ones = np.concatenate(([0], np.cumsum(_ONES[unary], dtype=np.int64)))[:-1]
        low = (values & U((1 << self.low_bits) - 1))
        width = 1 if self.low_bits <= 8 else 2 if self.low_bits <= 16 else 4 if self.low_bits <= 32 else 8
        low = low.astype(f"<u{width}")
        self.map = mmap.mmap(-1, max(1, low.nbytes + unary.nbytes + 4 * (len(ones) // 8 + 1)))
        a, b = low.nbytes, low.nbytes + unary.nbytes
        self.map[:a], self.map[a:b] = low.tobytes(), unary.tobytes()
        sampled = ones[::8].astype("<u4")
        self.map[b:b + sampled.nbytes] = sampled.tobytes()
        self.low = np.frombuffer(self.map, f"<u{width}", n)
        self.unary = np.frombuffer(self.map, np.uint8, len(unary), a)
        self.ones = np.frombuffer(self.map, "<u4", len(sampled), b)  # ones before every 8th byte

    def _end(self, h: np.ndarray) -> np.ndarray:
        """Number of entries whose high value is h or less (-1: none)."""
        at = np.searchsorted(self.ones, h, side="right") - 1
        left = (h - self.ones[np.maximum(at, 0)]).astype(np.int64)
        byte = np.maximum(at, 0) * 8
        for _ in range(7):
            count = _ONES[self.unary[np.minimum(byte, len(self.unary) - 1)]]
            go = left >= count
            left -= np.where(go, count, 0)
            byte += go
            if not go.any():
                break
        bit = byte * 8 + _NTH[self.unary[np.minimum(byte, len(self.unary) - 1)], np.clip(left, 0, 7)]
        return np.where(h < 0, 0, bit - h)

    def find(self, values: np.ndarray) -> np.ndarray:
        """The index of each value, -1 where it is not in the sequence."""
        if not self.n or not len(values):
            return np.full(len(values), -1, np.int64)
        h = (values >> U(self.low_bits)).astype(np.int64)
        low = (values & U((1 << self.low_bits) - 1)).astype(self.low.dtype)
        lo, hi = self._end(h - 1), self._end(h)
        end = hi.copy()
        while (open_ := lo < hi).any():  # the run of equal high bits, halved each time
            mid = (lo + hi) >> 1
            less = open_ & (self.low[np.minimum(mid, self.n - 1)] < low)
            lo = np.where(less, mid + 1, lo)
            hi = np.where(open_ & ~less, mid, hi)
        hit = (lo < end) & (self.low[np.minimum(lo, self.n - 1)] == low)
        return np.where(hit, lo, -1)


class Trie:
    """Levels above the vocabulary; an entry's context is its index in the level above."""

    def __init__(self, vocabulary: int):
        self.v, self.levels, self.codes = vocabulary, [], []

    def add(self, context: np.ndarray, word: np.ndarray, log10: np.ndarray, contexts: int) -> np.ndarray:
        """Adds a level; returns the entries' index in the order given."""
        key = context.astype(np.uint64) * U(self.v) + word.astype(np.uint64)
        order = np.argsort(key)
        self.levels.append(EliasFano(key[order], max(1, contexts * self.v)))
        self.codes.append(np.minimum(np.rint(-log10[order] * GRID), 65535).astype(np.uint16))
        index = np.empty(len(key), np.int64)
        index[order] = np.arange(len(key))
        return index

    def find(self, level: int, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        key = np.maximum(context, 0).astype(np.uint64) * U(self.v) + word.astype(np.uint64)
        return np.where(context >= 0, self.levels[level].find(key), -1)

    def log10(self, level: int, index: np.ndarray) -> np.ndarray:
        return -self.codes[level][index].astype(np.float64) / GRID


# ------------------------------------------------------------- n-grams of a block
class Grams:
    """Distinct n-grams of a block's texts per order, and each token's place among them; none for orders less than
    ``least``."""

    def __init__(self, texts: list[str | None], order: int, least: int = 1):
        words = list(word_hashes(texts))
        self.sizes = np.array([len(w) + 1 for w in words], np.int64)  # with the end
        start = np.array([BEGIN], np.uint64)
        end = np.array([END], np.uint64)
        lead = order - 1
        parts = []
        for w in words:
            parts += [start] * lead + [w, end]
        flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        self.doc = np.repeat(np.arange(len(words)), self.sizes)
        self.token = np.arange(len(self.doc)) + (self.doc + 1) * lead  # place of each token in flat
        self.keys, self.place = [], []
        key = flat[self.token]
        for n in range(1, order + 1):
            if n > 1:  # older word in front
                key = mix(key * U(0xD1342543DE82EF95) + flat[self.token - (n - 1)] * U(2 * n + 1))
            if n < least:
                self.keys.append(None)
                self.place.append(None)
                continue
            k, p = np.unique(key, return_inverse=True)
            if n == 1:
                k = np.append(k, BEGIN)  # its count is the number of texts
            self.keys.append(k)
            self.place.append(p)

    def counts(self, n: int, train: np.ndarray) -> np.ndarray:
        c = np.bincount(self.place[n], train[self.doc].astype(np.float64), len(self.keys[n])).astype(np.int64)
        if n == 0:
            c[-1] = train.sum()
        return c


def _pack(values: np.ndarray) -> bytes:
    """64-bit numbers byte plane by byte plane, compressed: sorted hashes share their top planes, small counts
    have empty ones."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.astype(">u8").view(np.uint8).reshape(-1, 8).T))


def _unpack(raw: bytes) -> np.ndarray:
    m = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(m.T).view(">u8").ravel().astype(np.uint64)


ASK = "range int, block int, n int, keys binary, counts binary"
ANSWER = "block int, range int, n int, counts binary, tokens bigint, words bigint"


def _asks(docs: DataFrame, ranges: int, order: int, least: int = 1) -> DataFrame:
    """Each block's distinct n-grams of ``least`` to ``order`` words by hash range."""
    def run(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        g = Grams(table.column("text").to_pylist(), order, least)
        train = ~np.array(table.column("held_out").to_pylist(), bool)
        rows = []
        for n in range(least - 1, order):
            by = np.argsort(g.keys[n], kind="stable") if n == 0 else slice(None)
            keys, counts = g.keys[n][by], g.counts(n, train)[by]
            cut = np.concatenate(([0], np.searchsorted(keys, _bounds(ranges)), [len(keys)]))
            rows += [(r, block, n, _pack(keys[a:b]), _pack(counts[a:b]))
                     for r, (a, b) in enumerate(zip(cut[:-1], cut[1:])) if b > a]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(
            zip(*rows), (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["range", "block", "n", "keys", "counts"])

    return docs.groupBy("block").applyInArrow(run, ASK)


def _bounds(ranges: int) -> np.ndarray:
    return np.arange(1, ranges, dtype=np.uint64) * U((1 << 64) // ranges)


def _answers(asks: DataFrame) -> DataFrame:
    """Global counts for each block; one row per range (block null) with the unigrams' tokens and words."""
    def run(table: pa.Table) -> pa.Table:
        r = table.column("range")[0].as_py()
        block, order = np.array(table.column("block")), np.array(table.column("n"))
        out: list[tuple] = []
        for n in np.unique(order):
            at = np.flatnonzero(order == n)
            keys = [_unpack(table.column("keys")[int(i)].as_py()) for i in at]
            counts = [_unpack(table.column("counts")[int(i)].as_py()) for i in at]
            every, place = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.bincount(place, np.concatenate(counts), len(every)).astype(np.int64)
            if n == 0:
                word = every != BEGIN
                out.append((None, r, 0, None, int(total[word].sum()), int((total[word] > 0).sum())))
            answer = np.where(total < MIN_COUNT, 0, total) if n else total
            cut = np.cumsum([len(k) for k in keys])[:-1]
            out += [(int(block[i]), r, int(n), _pack(c), None, None)
                    for i, c in zip(at, np.split(answer[place], cut))]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(
            zip(*out), (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64()))],
            names=["block", "range", "n", "counts", "tokens", "words"])

    return asks.groupBy("range").applyInArrow(run, ANSWER)


def _counted(docs: DataFrame, ranges: int, order: int) -> DataFrame:
    """The answers to all blocks.  A query that has ended leaves no message behind."""
    parts = [(1, order - 1), (order, order)] if order > 1 else [(1, 1)]
    found = [stored(_answers(_asks(docs, ranges, most, least)), "lm-counts") for least, most in parts]
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def build(g: Grams, counts: list[np.ndarray], tokens: int, words: int) -> tuple[Trie, np.ndarray, list[np.ndarray]]:
    """The global model's trie over the block's n-grams; the unigrams' log10 probabilities; for each
    distinct n-gram (order 2 and up) its (context n-gram's place, last word's place)."""
    uni = np.log10((counts[0] + ADD) / (tokens + ADD * (words + 1)))
    begin = len(g.keys[0]) - 1
    trie = Trie(len(g.keys[0]))
    # one token stands for each distinct n-gram
    parents, shorter = [], uni[:-1]
    first_of_doc = np.concatenate(([0], np.cumsum(g.sizes)[:-1]))
    context_index = np.arange(len(g.keys[0]))  # the vocabulary is level 0
    for n in range(1, len(g.keys)):
        rep = np.zeros(len(g.keys[n]), np.int64)
        rep[g.place[n][::-1]] = np.arange(len(g.doc))[::-1]
        word = g.place[0][rep]
        before = np.where(np.isin(rep, first_of_doc), -1, rep - 1)
        if n == 1:
            context = np.where(before < 0, begin, g.place[0][before])
            total = counts[0][context]
        else:
            context = np.where(before < 0, -1, g.place[n - 1][before])
            total = np.where(context < 0, 0, counts[n - 1][context])
        back = shorter[g.place[n - 1][rep]] if n > 1 else uni[word]
        c = counts[n]
        with np.errstate(divide="ignore", invalid="ignore"):
            p = np.where(total > 0, LAMBDA * c / np.maximum(total, 1) + (1 - LAMBDA) * 10 ** back, 10 ** back)
        here = np.where(context >= 0, context_index[np.maximum(context, 0)], -1)
        stored_ = (c > 0) & (here >= 0)
        index = np.full(len(c), -1, np.int64)
        index[stored_] = trie.add(here[stored_], word[stored_], np.log10(p[stored_]), max(1, int(context_index.max(initial=0)) + 1))
        parents.append((here, word, total))
        shorter = np.log10(p)
        context_index = index
    return trie, uni, parents


def score_block(texts: list[str | None], counts: list[np.ndarray], tokens: int, words: int, order: int = ORDER):
    """n_tokens, n_known, base_score and score of each text."""
    g = Grams(texts, order)
    docs = len(texts)
    by = np.argsort(g.keys[0], kind="stable")
    back = np.empty_like(by)
    back[by] = np.arange(len(by))
    counts = [counts[0][back], *counts[1:]]  # answers come in the order of the hashes
    trie, uni, parents = build(g, counts, tokens, words)
    logs = uni[:-1]
    place = g.place[0]
    base = np.bincount(g.doc, logs[place], docs)
    known = np.bincount(g.doc, (counts[0][place] > 0).astype(np.float64), docs).astype(np.int64)
    best = logs
    for n in range(1, order):  # for each distinct n-gram: its own entry, or the shorter one's with the context's weight
        here, word, total = parents[n - 1]
        index = trie.find(n - 1, here, word)
        rep = np.zeros(len(g.keys[n]), np.int64)
        rep[g.place[n]] = np.arange(len(g.doc))
        shorter = best[g.place[n - 1][rep]]
        missed = np.where(total > 0, shorter + np.log10(1 - LAMBDA), shorter)
        best = np.where(index >= 0, trie.log10(n - 1, np.maximum(index, 0)) if len(trie.codes[n - 1]) else 0.0, missed)
    score = np.bincount(g.doc, best[g.place[order - 1]], docs)
    return g.sizes, known, base, score


def lm_scores(docs: DataFrame, text: str = "text", key: str = "doc_id", order: int = ORDER) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row."""
    d = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"), is_held_out(key).alias("held_out"))
    chars = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, ranges = max(8, chars // BLOCK_CHARS), max(8, chars // RANGE_CHARS)
    d = d.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))
    answers = _counted(d.select("block", "text", "held_out"), ranges, order)
    n = answers.filter("block is null").agg(F.sum("tokens").alias("tokens"), F.sum("words").alias("words")).first()
    tokens, words = n["tokens"] or 0, n["words"] or 0
    schema = ("doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
              "base_score double, score double")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by([("n", "ascending"), ("range", "ascending")])
        which = np.array(right.column("n"))
        counts = [np.concatenate([_unpack(right.column("counts")[int(i)].as_py()) for i in np.flatnonzero(which == k)]).astype(np.int64)
                  for k in range(order)]
        size, known, base, score = score_block(left.column("text").to_pylist(), counts, tokens, words, order)
        return pa.Table.from_arrays([
            left.column("doc_id"), left.column("held_out"), pa.array(size, pa.int64()), pa.array(known, pa.int64()),
            pa.array(np.full(len(size), tokens), pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64())],
            names=[c.split()[0] for c in schema.split(", ")])

    asked = answers.filter("block is not null").select("block", "range", "n", "counts")
    return d.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(run, schema)
