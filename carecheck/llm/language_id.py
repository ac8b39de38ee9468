"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text accepts every substring
of it.  A document is parsed greedily into the longest phrases the automaton
accepts; the language that needs the fewest phrases wins, each phrase weighing
``log2`` of the training text it points into (the cross-parsing estimate of
the cross entropy per character).

The automata are fitted on a bounded sample: per language the ``SAMPLE_DOCS``
documents with the smallest hash, at most ``DOC_CHARS`` characters of each and
``TRAIN_CHARS`` symbols in all.  Every whole document is parsed; the parse
restarts every ``SEGMENT`` symbols, so segments of all documents of a batch
advance side by side in numpy through the automata's transition tables.

Cases: text that is null or has no letter gives ``und`` with score 0, as does
everything when nothing was learned; null lang is never learned; a null doc_id
counts as the empty text in the split; ties go to the smallest language by
code point; repeated rows are predicted row by row; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from carecheck.llm.worker import give_back, held

SAMPLE_DOCS = 64
DOC_CHARS = 4096
TRAIN_CHARS = 32_768
SEGMENT = 512
PIECE_CHARS = 1 << 20  # characters handled at a time; memory bound only
ROWS = 1024               # documents handled and returned at a time; memory bound only
UNSEEN, SPACE = 0, 1   # symbols; letters of the training texts follow


def held_out(key: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % 3 == 1


def suffix_automaton(text: list[int], alphabet: int) -> np.ndarray:
    """Transition table [state, symbol] of the automaton of all substrings; 0, the start, means none."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    table = np.zeros((len(nxt), alphabet), np.int32)
    for s, out in enumerate(nxt):
        for c, t in out.items():
            table[s, c] = t
    return table


class Parser:
    def __init__(self, texts: dict[str, str]):
        self.langs = sorted(texts)
        letters = np.array([chr(i).isalpha() for i in range(0x110000)])
        self.symbol = np.where(letters, UNSEEN, SPACE).astype(np.int16)
        seen = sorted({c for t in texts.values() for c in t.lower() if c.isalpha()})
        for k, c in enumerate(seen):
            self.symbol[ord(c)] = 2 + k
        self.alphabet = 2 + len(seen)
        self.tables, self.bits = [], []
        for lang in self.langs:
            text = self.symbols(texts[lang])[:TRAIN_CHARS]
            self.tables.append(suffix_automaton(text.tolist(), self.alphabet).ravel())
            self.bits.append(math.log2(len(text) + 1))

    def symbols(self, text: str) -> np.ndarray:
        """Lower-cased letters as symbols; any run of other characters is one space."""
        s = self.symbol[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
        if len(s) < 2:
            return s
        return s[np.concatenate(([True], (s[1:] != SPACE) | (s[:-1] != SPACE)))]

    def phrases(self, segments: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """[language, segment] number of phrases.  segments: [SEGMENT, n], the longest first."""
        count = np.zeros((len(self.langs), len(sizes)), np.int64)
        state = np.zeros((len(self.langs), len(sizes)), np.int32)
        active = np.searchsorted(-sizes, -np.arange(segments.shape[0]), side="left")  # with size over t
        for t in range(segments.shape[0]):
            n = active[t]
            if not n:
                break
            sym = segments[t, :n].astype(np.int32)
            for k, table in enumerate(self.tables):
                to = table[state[k, :n] * self.alphabet + sym]
                miss = to == 0
                count[k, :n] += miss
                state[k, :n] = np.where(miss, table[sym], to)
        return count + (sizes > 0)  # the last phrase is open

    def parse(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """[language, text] bits of all phrases, and each text's number of letters."""
        letters = np.zeros(len(texts), np.int64)
        bits = np.zeros((len(self.langs), len(texts)))
        pending: list[np.ndarray] = []
        owner: list[int] = []
        held = 0

        def flush():
            sizes = np.array([len(x) for x in pending])
            order = np.argsort(-sizes, kind="stable")
            m = np.zeros((len(pending), SEGMENT), np.int16)
            for row, i in enumerate(order):
                m[row, :sizes[i]] = pending[i]
            found = self.phrases(np.ascontiguousarray(m.T), sizes[order])
            who = np.array(owner)[order]
            for k in range(len(self.langs)):
                bits[k] += np.bincount(who, found[k], len(texts)) * self.bits[k]

        for i, t in enumerate(texts):
            for a in range(0, len(t or ""), PIECE_CHARS):
                s = self.symbols(t[a:a + PIECE_CHARS])
                letters[i] += np.count_nonzero(s != SPACE)
                for b in range(0, len(s), SEGMENT):
                    pending.append(s[b:b + SEGMENT])
                    owner.append(i)
                held += len(s)
                if held > 4 * PIECE_CHARS:
                    flush()
                    pending, owner, held = [], [], 0
        if pending:
            flush()
        return bits, letters

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if not self.langs:
            return ["und"] * len(texts), [0.0] * len(texts)
        bits, letters = self.parse(texts)
        best = np.argmin(bits, axis=0)
        low = np.sort(bits, axis=0)
        second = low[1] if len(self.langs) > 1 else np.full(len(texts), np.inf)
        score = np.where(np.isinf(second), 1.0, second / np.maximum(low[0] + second, 1e-9))
        lang = [self.langs[b] if n else "und" for b, n in zip(best, letters)]
        return lang, [float(s) if n else 0.0 for s, n in zip(score, letters)]


def training_texts(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, text: str = "text", lang: str = "lang",
                   key: str = "doc_id") -> dict[str, str]:
    """The bounded sample, language -> text (``sample_docs * DOC_CHARS`` characters a language at most)."""
    d = (docs.filter(~held_out(key) & F.col(lang).isNotNull())
         .select(F.col(lang).cast("string").alias("lang"), F.substring(F.col(text), 1, DOC_CHARS).alias("t"))
         .filter(F.col("t").rlike(r"\p{L}")).withColumn("h", F.xxhash64("t")))
    top = W.partitionBy("lang").orderBy("h", "t")
    rows = d.withColumn("rank", F.row_number().over(top)).filter(F.col("rank") <= sample_docs).orderBy("lang", "rank").collect()
    out: dict[str, list[str]] = {}
    for r in rows:
        out.setdefault(r["lang"], []).append(r["t"])
    return {k: " ".join(v) for k, v in out.items()}


def identify(docs: DataFrame, texts: dict[str, str], text: str = "text") -> DataFrame:
    """``docs`` with columns ``lang_pred, score`` added (they replace columns of these names)."""
    texts_b = docs.sparkSession.sparkContext.broadcast(texts)
    name = "parser " + hashlib.sha256(repr(sorted(texts.items())).encode()).hexdigest()
    base = docs.drop("lang_pred", "score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = held(name, lambda: Parser(texts_b.value))
        for b in (x.slice(k, ROWS) for x in batches for k in range(0, x.num_rows, ROWS)):
            lang, score = p.predict(b.column(b.schema.get_field_index(text)).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                                             names=[*b.schema.names, "lang_pred", "score"])
        give_back()

    schema = base.withColumns({"lang_pred": F.lit("").cast("string"), "score": F.lit(0.0)}).schema
    return base.mapInArrow(run, schema)


def language_id(docs: DataFrame) -> DataFrame:
    texts = training_texts(docs)
    d = docs.select("doc_id", held_out().alias("held_out"), "text")
    return identify(d, texts).select("doc_id", "held_out", "lang_pred", "score")
