"""SentencePiece BPE encoding and decoding by backtracking.

A sequence of tokens is the merge result of its text exactly when each token
is the merge result of its own text and each adjacent pair that of their
concatenation.  So a word is encoded from left to right with the longest
Aho-Corasick match that is compatible with the token before it (checked by
re-merging the two), stepping back to shorter matches where nothing fits; a
bitfield holds the positions that cannot be a token boundary, so none is tried
twice.

No piece has a space mark after another character, hence merges never cross
the start of a run of space marks and a text is encoded word by word, through
a bounded per-worker cache.  The runs' own pieces share one lowest score: they
merge last and from the left, which a plain re-merge does.  Characters without
a piece become byte tokens and stop merges.

The vocabulary is read from a model file on the driver (a parameter, never
copied) and broadcast (a fixed size, independent of the data).

Cases: null text counts as empty; the empty text gives only the begin and end
ids; a literal U+2581 is a space, as in the library; null doc_id and repeated
rows are encoded row by row; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carecheck.llm.worker import give_back, held

SPACE = "▁"
LETTER = re.compile(r"[^\W\d_]")
CACHE_WORDS = 1_000_000  # words kept per worker; memory bound only
CACHE_CHARS = 48       # longer words are not kept
NORMAL, BYTE, CONTROL, UNKNOWN = range(4)


def read_model(path: str) -> tuple:
    """Pieces, scores and kinds of a BPE model with byte fallback."""
    import sentencepiece
    p = sentencepiece.SentencePieceProcessor(model_file=path)
    n = p.get_piece_size()
    kind = [BYTE if p.is_byte(i) else CONTROL if p.is_control(i) else UNKNOWN if p.is_unknown(i) else NORMAL for i in range(n)]
    return tuple(p.id_to_piece(i) for i in range(n)), tuple(p.get_score(i) for i in range(n)), tuple(kind), p.bos_id(), p.eos_id()


class _Cache(dict):
    """word -> little-endian ids; forgets everything when full."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        ids = b"".join(i.to_bytes(4, "little") for i in self.encode(word))
        if len(word) <= CACHE_CHARS:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = ids
        return ids


class Codec:
    def __init__(self, model: tuple):
        import ahocorasick
        self.pieces, self.scores, kinds, self.bos, self.eos = model
        self.ids = {p: i for i, p in enumerate(self.pieces) if kinds[i] == NORMAL}
        self.byte_ids = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if kinds[i] == BYTE}
        self.raw = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN
                    else p.replace(SPACE, " ").encode() for p, k in zip(self.pieces, kinds)]
        runs = [p for p in self.ids if p.startswith(SPACE * 2)]
        low = min(self.scores[self.ids[p]] for p in self.ids)
        if any(SPACE in p.lstrip(SPACE) for p in self.ids) or any(p.strip(SPACE) or self.scores[self.ids[p]] != low for p in runs):
            raise ValueError("a piece joins words, or runs of spaces do not merge last: words cannot be encoded one by one")
        self.matches = ahocorasick.Automaton()
        for p, i in self.ids.items():
            if not p.startswith(SPACE * 2) and self.merge(p) == [i]:  # else it is never the result of merges
                self.matches.add_word(p, (len(p), i))
        self.matches.make_automaton()
        self.chars = {c for c in self.ids if len(c) == 1}
        # characters that no longer piece holds beside another one: merges stop there, so a word ends there
        joined = {c for p in self.ids if len(p) > 1 for c in p}
        stop = "".join(re.escape(c) for c in map(chr, range(128)) if c != " " and c not in joined)
        # and it ends where a mark follows a letter that no piece has after a letter
        after = {y for p in self.ids for x, y in zip(p, p[1:]) if LETTER.match(x)}
        ends = "".join(re.escape(c) for c in ".,;:!?)" if c not in after)
        self.words = re.compile("|".join(([rf"{SPACE}*{LETTER.pattern}+(?=[{ends}])"] if ends else [])
                                         + [f"{SPACE}*[^{SPACE}{stop}]+", f"{SPACE}+"] + ([f"[{stop}]"] if stop else [])))
        self.pairs: dict[int, bool] = {}
        self.run_ids: dict[int, list[int]] = {0: []}
        self.cache = _Cache(self.word)

    # -------------------------------------------------- merging
    def merge(self, text: str) -> list[int]:
        """Plain merge: the best-scored adjacent pair first, leftmost among equals."""
        sym, n = list(text), len(text)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list = []

        def offer(a, b):
            if 0 <= a and b < n and (i := self.ids.get(sym[a] + sym[b])) is not None:
                heapq.heappush(heap, (-self.scores[i], a, b, sym[a] + sym[b]))

        for k in range(n - 1):
            offer(k, k + 1)
        while heap:
            _, a, b, joined = heapq.heappop(heap)
            if not sym[a] or not sym[b] or right[a] != b or sym[a] + sym[b] != joined:
                continue
            sym[a], sym[b] = joined, ""
            right[a] = right[b]
            if right[a] < n:
                left[right[a]] = a
            offer(left[a], a)
            offer(a, right[a])
        return [self.ids[s] for s in sym if s]

    def fits(self, a: int, b: int) -> bool:
        """Is [a, b] the merge result of the two tokens' text?"""
        k = a << 32 | b
        if (v := self.pairs.get(k)) is None:
            if len(self.pairs) >= 1_000_000:
                self.pairs.clear()
            v = self.pairs[k] = self.merge(self.pieces[a] + self.pieces[b]) == [a, b]
        return v

    def backtrack(self, text: str) -> list[int]:
        """Encodes text all of whose characters have pieces."""
        starts: list[list] = [[] for _ in text]
        for end, match in self.matches.iter(text):
            starts[end - match[0] + 1].append(match)  # in the order of their end: the longest is last
        n, at, failed, last = len(text), 0, 0, -1
        out: list[tuple[int, int]] = []  # (where it starts, id)
        pairs = self.pairs
        while at < n:
            options = starts[at]
            while options:  # what does not fit here now never will: the tokens before a boundary are unique
                size, i = options.pop()
                if failed >> (at + size) & 1:
                    continue
                if last < 0 or ((ok := pairs.get(last << 32 | i)) is None and self.fits(last, i)) or ok:
                    out.append((at, i))
                    at += size
                    last = i
                    break
            else:
                failed |= 1 << at  # nothing continues from here: no boundary
                at, _ = out.pop()
                last = out[-1][1] if out else -1
        return [i for _, i in out]

    # -------------------------------------------------- words and texts
    def spaces(self, k: int) -> list[int]:
        if k not in self.run_ids:
            if len(self.run_ids) > 10_000:
                self.run_ids = {0: []}
            self.run_ids[k] = self.merge(SPACE * k)
        return self.run_ids[k]

    def known(self, text: str) -> list[int]:
        if self.chars.issuperset(text):
            return self.backtrack(text)
        out: list[int] = []
        part: list[str] = []
        for c in text:
            if c in self.chars:
                part.append(c)
                continue
            if part:
                out += self.backtrack("".join(part))
                part = []
            out += [self.byte_ids[b] for b in c.encode()]
        return out + (self.backtrack("".join(part)) if part else [])

    def word(self, word: str) -> list[int]:
        body = word.lstrip(SPACE)
        k = len(word) - len(body)
        if not body:
            return self.spaces(k)
        if not k:
            return self.known(body)
        ids = self.known(SPACE + body)
        if self.pieces[ids[0]] == SPACE:  # the mark stayed alone: it belongs to the run
            return self.spaces(k) + ids[1:]
        return self.spaces(k - 1) + ids

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids with begin and end."""
        body = b"".join(map(self.cache.__getitem__, self.words.findall(SPACE + text.replace(" ", SPACE)))) if text else b""
        return self.bos.to_bytes(4, "little") + body + self.eos.to_bytes(4, "little")

    def decode(self, ids: bytes) -> str:
        raw = b"".join(map(self.raw.__getitem__, memoryview(ids).cast("I")))
        return raw.removeprefix(b" ").decode(errors="replace")  # the space put before every text goes


def _mapped(docs: DataFrame, model_path: str, schema: str, columns) -> DataFrame:
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(read_model(model_path))
    name = "codec " + hashlib.sha256(repr(model.value).encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = held(name, lambda: Codec(model.value))
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            cols = columns(c, (t.as_py() for t in texts))
            yield pa.RecordBatch.from_arrays([ids, *cols], names=["doc_id", *[f"c{i}" for i in range(len(cols))]])
        give_back()

    return docs.mapInArrow(run, schema)


def encoded(docs: DataFrame, model_path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, c0``: the ids of every text as little-endian 32-bit integers."""
    d = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return _mapped(d, model_path, "doc_id bigint, c0 binary",
                   lambda c, texts: [pa.array([c.encode(t) for t in texts], pa.binary())]).withColumnRenamed("c0", "ids")


def decoded(ids: DataFrame, model_path: str) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``."""
    return _mapped(ids.select("doc_id", "ids"), model_path, "doc_id bigint, c0 string",
                   lambda c, rows: [pa.array([None if r is None else c.decode(r) for r in rows], pa.string())]
                   ).withColumnRenamed("c0", "text")


def round_trip(docs: DataFrame, model_path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` in one pass."""
    def digests(c: Codec, texts):
        n, a, b = [], [], []
        for t in texts:
            ids = c.encode(t)
            n.append(len(ids) // 4)
            a.append(hashlib.sha256(ids).hexdigest())
            b.append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
        return [pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]

    d = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    out = _mapped(d, model_path, "doc_id bigint, c0 bigint, c1 string, c2 string", digests)
    return out.select("doc_id", F.col("c0").alias("n_tokens"), F.col("c1").alias("ids_sha256"), F.col("c2").alias("decoded_sha256"))


def training_tokens(docs: DataFrame, model_path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, n_tokens, ids, decoded_sha256``: the ids themselves, and the digest of what they decode to."""
    def tokens(c: Codec, texts):
        ids = [c.encode(t) for t in texts]
        back = [hashlib.sha256(c.decode(x).encode()).hexdigest() for x in ids]
        return [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(back, pa.string())]

    d = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    out = _mapped(d, model_path, "doc_id bigint, c0 bigint, c1 binary, c2 string", tokens)
    return out.select("doc_id", F.col("c0").alias("n_tokens"), F.col("c1").alias("ids"), F.col("c2").alias("decoded_sha256"))
