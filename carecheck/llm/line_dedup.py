"""Fuzzy line dedup by MinHash.

A line's shingles are the ``SHINGLE_CHARS`` characters from every character
position of the whole line, lower-cased (a shorter line is its one shingle).
Lines, named by their MD5, get one minimum per permutation of their
shingles' hashes; ``ROWS`` minima make a band.  Lines with a common band are
compared exactly (Jaccard similarity of their shingle sets of 0.8 or more),
distributed union-find makes components, and of each component the first
occurrence by (doc_id, line number) stays.  Odd sketches (Mitzenmacher, Pagh
and Pham) rule out pairs before texts move; they bound how much two sets
differ, so they rule out no link.

Spark splits, names, groups and joins the lines; shingles, minima and
comparisons are numpy over Arrow batches, as the form in SQL functions alone
took more than four times the processor time allowed (figures in the README).

At similarity 0.8 a pair shares a band with probability
``1 - (1 - 0.8^ROWS)^BANDS`` = 0.996; equal lines always meet.  Lines of the
similarity s meet by chance with about ``BANDS * s^ROWS``; such pairs grow with
the square of the input, so a band has enough rows to make them few.

Cases: lines without a word are kept and not compared; null text has no line;
a null doc_id ranks below every number; rows of a repeated doc_id share their
decisions; an empty table gives an empty result; extra columns are ignored by
``line_dedup`` and kept by ``deduplicated``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carecheck.llm.common import bitmap, blocked, discard, grouped_links, maybe_in, recorded, stored
from carecheck.llm.shingles import mix
from carecheck.llm.worker import in_arrow

U = np.uint64
SHINGLE_CHARS = 5
ROWS, BANDS = 5, 14
PASSES = 2                # over the lines, each for a part of the bands: a bound on disk only
NONE = -(1 << 63)  # stands for a null doc_id
CHUNK = 1 << 17           # characters hashed at a time (a longer line alone); cost only
SEEN = 1 << 18            # names of lines a task remembers (some 20 MB); cost only
GROUP_SHINGLES = 1 << 22  # hashes of a group of lines compared at a time; memory bound only
GROUP_COLUMNS = 4096
PAIRS = 1 << 15           # pairs of sketches compared at a time, or those of one group; cost only
_FACTORS = mix(np.arange(1, ROWS * BANDS + 1, dtype=np.uint64)) | U(1)
_SEATS = mix(np.arange(901, 901 + SHINGLE_CHARS, dtype=np.uint64)) | U(1)
_ROW_SEATS = mix(np.arange(951, 951 + ROWS, dtype=np.uint64)) | U(1)
_SHORT = mix(np.arange(971, 971 + SHINGLE_CHARS + 1, dtype=np.uint64))
_BLANK = " \t\x0b\f\r"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _has_word(line: Column) -> Column:
    return F.ltrim(line, F.lit(_BLANK)) != ""


def shingle_hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lines' shingles, position by position, and how many each line has."""
    low = [x.lower() for x in lines]
    size = np.fromiter(map(len, low), np.int64, len(low))
    code = np.frombuffer("".join(x.ljust(SHINGLE_CHARS, "\0") for x in low).encode("utf-32-le", "surrogatepass"), np.uint32)
    code = code.astype(np.uint64)
    n = len(code) - SHINGLE_CHARS + 1
    total = code[:n] * _SEATS[0]
    for j in range(1, SHINGLE_CHARS):
        total += code[j:n + j] * _SEATS[j]
    room = np.maximum(size, SHINGLE_CHARS)
    ends = np.cumsum(room)
    short = size < SHINGLE_CHARS  # their padding counts as such by their size
    total[(ends - room)[short]] += _SHORT[size[short]]
    inside = np.ones(n + SHINGLE_CHARS, bool)
    for j in range(1, SHINGLE_CHARS):
        inside[ends - j] = False
    return mix(total[inside[:n]]), room - SHINGLE_CHARS + 1


def minima(h: np.ndarray, starts: np.ndarray, factors: np.ndarray = _FACTORS) -> np.ndarray:
    """[permutation, line] the least value of each permutation of the line's hashes.  A permutation multiplies
    the mixed hash by an odd number of its own."""
    out = np.empty((len(factors), len(starts)), np.uint64)
    moved = np.empty_like(h)
    for k, factor in enumerate(factors):
        np.multiply(h, factor, out=moved)
        np.minimum.reduceat(moved, starts, out=out[k])
    return out


def _chunks(lines: list[str]) -> Iterator[list[str]]:
    a, held = 0, 0
    for b, x in enumerate(lines):
        if held and held + len(x) > CHUNK:
            yield lines[a:b]
            a, held = b, 0
        held += len(x)
    if held:
        yield lines[a:]


def set_keys(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The lines' sets of shingles, one sorted key (line, hash) each; a chunk has less than 2 ** 18 lines, their
    hashes keep 46 bits."""
    key = np.sort(np.repeat(np.arange(len(n), dtype=np.uint64) << U(46), n) | h >> U(18))
    return key[np.concatenate((key[:1] == key[:1], key[1:] != key[:-1]))]


def set_sizes(key: np.ndarray, lines: int) -> np.ndarray:
    return np.bincount((key >> U(46)).astype(np.int64), minlength=lines)


def signed(lines: list[str], of: range = range(BANDS)) -> tuple[np.ndarray, np.ndarray]:
    """[line, band] the name of each band ``of`` all, and the size of each line's set of shingles."""
    out, sizes = [np.zeros((0, len(of)), np.uint64)], [np.zeros(0, np.int64)]
    factors = _FACTORS[of.start * ROWS:of.stop * ROWS]
    for part in _chunks(lines):
        h, n = shingle_hashes(part)
        m = minima(h, np.cumsum(n) - n, factors).reshape(len(of), ROWS, len(part))
        rows = (mix(m) * _ROW_SEATS[:, None]).sum(axis=1, dtype=np.uint64)
        out.append(mix(rows + _FACTORS[of.start:of.stop, None]).T)
        sizes.append(set_sizes(set_keys(h, n), len(part)))
    return np.concatenate(out), np.concatenate(sizes)


def line_bands(lines: list[str]) -> np.ndarray:
    return signed(lines)[0]


def _named_lines(docs: DataFrame, text: str) -> DataFrame:
    """``id, line``: every line that has a word."""
    lines = docs.select(F.explode(_lines(F.col(text))).alias("line")).filter(_has_word(F.col("line")))
    return lines.select(F.unhex(F.md5("line")).alias("id"), "line")


def bands(docs: DataFrame, text: str = "text", of: range = range(BANDS)) -> DataFrame:
    """``sig, id, n``: the bands (``of`` all) of every line and the size of its set.  A task signs a line once (as far as it
    remembers, ``SEEN`` lines); the lines of different tasks are not brought together for that: a repeated row
    changes no link."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in batches:
            new = []
            for i, name in enumerate(b.column(0).to_pylist()):
                if name not in seen:
                    seen.add(name)
                    new.append(i)
            if len(seen) > SEEN:
                seen.clear()
            fresh = b.take(pa.array(new, pa.int64()))
            names, sizes = signed(fresh.column(1).to_pylist(), of)
            ids = fresh.column(0).take(pa.array(np.repeat(np.arange(len(names)), len(of))))
            yield pa.RecordBatch.from_arrays([pa.array(names.ravel().view(np.int64)), ids,
                                              pa.array(np.repeat(sizes, len(of)), pa.int32())], names=["sig", "id", "n"])

    return in_arrow(_named_lines(docs, text), run, "sig bigint, id binary, n int")


SKETCH_WORDS = 16  # 64 bits each, a power of two; sets of some 2,000 shingles still tell each other apart
_SKETCH = "id binary, n int, " + ", ".join(f"s{k} bigint" for k in range(SKETCH_WORDS))
SKETCH_COLUMNS = [f"s{k}" for k in range(SKETCH_WORDS)]


def sketch(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The size of each line's set of shingles and its odd sketch, [line, word]: each shingle of the set flips one
    bit.  What two sets share cancels out, so two sketches differ in no more bits than the sets in shingles."""
    sizes, maps = [np.zeros(0, np.int64)], [np.zeros((0, SKETCH_WORDS), np.uint64)]
    for part in _chunks(lines):
        h, n = shingle_hashes(part)
        key = set_keys(h, n)
        sizes.append(set_sizes(key, len(part)))
        word = key >> U(46 - SKETCH_WORDS.bit_length() + 1)  # by line and the hash's highest bits, so in order
        first = np.flatnonzero(np.concatenate((word[:1] == word[:1], word[1:] != word[:-1])))
        flips = np.zeros(len(part) * SKETCH_WORDS, np.uint64)
        flips[word[first].astype(np.int64)] = np.bitwise_xor.reduceat(U(1) << (key & U(63)), first)
        maps.append(flips.reshape(-1, SKETCH_WORDS))
    return np.concatenate(sizes), np.concatenate(maps)


def apart_at_least(x: list[Column], y: list[Column]) -> Column:
    """In how many bits two sketches differ: at least so many shingles are in one set only."""
    return sum((F.bit_count(a.bitwiseXOR(b)) for a, b in zip(x[1:], y[1:])), F.bit_count(x[0].bitwiseXOR(y[0])))


def sketches(docs: DataFrame, text: str, ids: DataFrame) -> DataFrame:
    """``id, n, s0, ...`` of some lines."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in batches:
            new = []
            for i, name in enumerate(b.column(0).to_pylist()):
                if name not in seen:
                    seen.add(name)
                    new.append(i)
            if len(seen) > SEEN:
                seen.clear()
            fresh = b.take(pa.array(new, pa.int64()))
            n, maps = sketch(fresh.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([fresh.column(0), pa.array(n, pa.int32()), *map(pa.array, maps.view(np.int64).T.copy())],
                                             names=["id", "n", *SKETCH_COLUMNS])

    with recorded() as spent:
        some = stored(ids.distinct(), "line-candidates")
    found = in_arrow(maybe_in(_named_lines(docs, text), "id", bitmap(some, "id")), run, _SKETCH)
    one = found.groupBy("id").agg(*[F.max(c).alias(c) for c in ["n", *SKETCH_COLUMNS]])  # equal rows
    out = stored(one.join(some, "id"), "sketches")
    discard(docs.sparkSession, spent)
    return out


def may_link(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """Those of ``pairs(a, b)`` that their sketches do not rule out.  At similarity 0.8 or more, at most a ninth of
    the two sets' sizes together are shingles of one set only, so no link is lost."""
    x, y = (marks.select(*[F.col(c).alias(side + c) for c in ("id", "n", *SKETCH_COLUMNS)]) for side in ("a_", "b_"))
    both = pairs.join(x, F.col("a") == F.col("a_id")).join(y, F.col("b") == F.col("b_id"))
    differ = apart_at_least(*[[F.col(side + c) for c in SKETCH_COLUMNS] for side in ("a_", "b_")])
    return both.filter(9 * differ <= F.col("a_n") + F.col("b_n")).select("a", "b")


def _texts(docs: DataFrame, text: str, ids: DataFrame) -> DataFrame:
    """``id, line`` of some lines: the text moves, its set of hashes would take eight times the room."""
    some = stored(ids.distinct(), "line-candidates")
    return maybe_in(_named_lines(docs, text), "id", bitmap(some, "id")).dropDuplicates(["id"]).join(some, "id")


PAIR_BITS = 10  # pairs compared in one sort; their hashes keep 53 bits


def do_link(xs: list[str], ys: list[str]) -> np.ndarray:
    """For each pair: is the Jaccard similarity of its two sets 0.8 or more?  One sort by (pair, hash, side)."""
    low = 64 - PAIR_BITS
    out, a, held = [], 0, 0
    for b in range(1, len(xs) + 1):
        held += len(xs[b - 1]) + len(ys[b - 1])
        if b < len(xs) and b - a < 1 << PAIR_BITS and held + len(xs[b]) + len(ys[b]) <= CHUNK:
            continue
        k = b - a
        h, n = shingle_hashes(xs[a:b] + ys[a:b])
        tag = np.tile(np.arange(k, dtype=np.uint64) << U(low), 2)
        tag[k:] |= U(1)
        key = np.sort((h >> U(PAIR_BITS + 1) << U(1)) | np.repeat(tag, n))
        key = key[np.concatenate((key[:1] == key[:1], key[1:] != key[:-1]))]
        pair = (key >> U(low)).astype(np.int64)
        common = np.bincount(pair[1:][key[1:] >> U(1) == key[:-1] >> U(1)], minlength=k)
        out.append(9 * common >= 4 * np.bincount(pair, minlength=k))
        a, held = b, 0
    return np.concatenate(out) if out else np.zeros(0, bool)


def similar(pairs: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """Those of ``pairs(a, b)`` whose lines link."""
    with recorded() as spent:
        pairs = stored(pairs, "line-pairs")
        lines = _texts(docs, text, pairs.select(F.explode(F.array("a", "b")).alias("id")))
    both = (pairs.join(lines.select(F.col("id").alias("a"), F.col("line").alias("x")), "a")
            .join(lines.select(F.col("id").alias("b"), F.col("line").alias("y")), "b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = do_link(b.column(2).to_pylist(), b.column(3).to_pylist())
            yield pa.RecordBatch.from_arrays(b.columns[:2], names=["a", "b"]).filter(pa.array(keep))

    out = stored(in_arrow(both.select("a", "b", "x", "y"), run, "a binary, b binary"), "line-links")
    discard(docs.sparkSession, spent)
    return out


def in_common(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The size of each line's set and, for each two lines, how many shingles they share.  Many long lines are
    counted by parts of the hashes' domain, so that no more than about ``GROUP_SHINGLES`` are held."""
    passes = 1 + sum(map(len, lines)) // GROUP_SHINGLES
    bits = U(len(lines).bit_length())  # of a key hold the line, the others its hash
    sizes, common = np.zeros(len(lines), np.int64), np.zeros((len(lines), len(lines)), np.int64)
    for k in range(passes):
        parts, at = [], 0
        for part in _chunks(lines):
            h, n = shingle_hashes(part)
            key = h >> bits << bits | np.repeat(np.arange(at, at + len(part), dtype=np.uint64), n)
            parts.append(key[h % U(passes) == U(k)] if passes > 1 else key)
            at += len(part)
        key = np.sort(np.concatenate(parts))
        key = key[np.concatenate((key[:1] == key[:1], key[1:] != key[:-1]))]
        line = (key & ((U(1) << bits) - U(1))).astype(np.int64)
        sizes += np.bincount(line, minlength=len(lines))
        name = key >> bits
        first = np.concatenate((name[:1] == name[:1], name[1:] != name[:-1]))
        column = np.cumsum(first) - 1
        shared = np.bincount(column) > 1  # the others are in no intersection
        use = shared[column]
        line, column = line[use], (np.cumsum(shared) - 1)[column[use]]
        for at in range(0, int(shared.sum()), GROUP_COLUMNS):
            a, b = np.searchsorted(column, (at, at + GROUP_COLUMNS))
            has = np.zeros((len(lines), min(GROUP_COLUMNS, int(shared.sum()) - at)), np.float32)
            has[line[a:b], column[a:b] - at] = 1
            common += (has @ has.T).astype(np.int64)
    return sizes, common


def linked_roots(lines: list[str], block: np.ndarray, root: np.ndarray, p: int, q: int) -> set[tuple[int, int]]:
    """Pairs of roots (as numbers, the larger first) of which two lines, one of block p and one of q, link."""
    n, common = in_common(lines)
    link = (9 * common >= 4 * (n[:, None] + n)) & (block[:, None] == p) & (block == q) & (root[:, None] != root)
    i, j = np.nonzero(link)
    return set(zip(np.maximum(root[i], root[j]).tolist(), np.minimum(root[i], root[j]).tolist()))


def may_link_at(marks: np.ndarray, size: np.ndarray, root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The lines among pairs (i, j) of another root that their sizes and sketches do not rule out."""
    use = (root[i] != root[j]) & (9 * np.abs(size[i] - size[j]) <= size[i] + size[j])
    i, j = i[use], j[use]
    differ = np.zeros(len(i), np.int64)
    for a, b in ((0, SKETCH_WORDS // 4), (SKETCH_WORDS // 4, SKETCH_WORDS)):  # a part of the sketch rules out most
        differ += np.bitwise_count(marks[i, a:b] ^ marks[j, a:b]).sum(axis=1, dtype=np.int64)
        use = 9 * differ <= size[i] + size[j]
        i, j, differ = i[use], j[use], differ[use]
    return np.union1d(i, j)


def with_partner(marks: np.ndarray, size: np.ndarray, block: np.ndarray, root: np.ndarray, groups: list[tuple[int, int, int, int]]) -> np.ndarray:
    """Which lines of groups (p, q, first line, end) may link to one of their group's other block (the same one
    where p is q) and another root.  Pairs of many groups are compared at a time."""
    out, ahead, held = [np.zeros(0, np.int64)], [], 0
    for k, (p, q, s, e) in enumerate(groups, 1):
        if p == q:
            i, j = np.triu_indices(e - s, 1)
        else:
            left, right = np.flatnonzero(block[s:e] == p), np.flatnonzero(block[s:e] == q)
            i, j = np.repeat(left, len(right)), np.tile(right, len(left))
        ahead.append((i + s, j + s))
        held += len(i)
        if held >= PAIRS or k == len(groups):
            out.append(may_link_at(marks, size, root, *map(np.concatenate, zip(*ahead))))
            ahead, held = [], 0
    return np.unique(np.concatenate(out))


def with_partners(apart: DataFrame, marks: DataFrame) -> DataFrame:
    """Those rows ``rep, id, root`` of ``apart`` that may link to a row of the same rep and another root."""
    d = blocked(apart, marks)
    root = F.when(F.col("root") != F.col("id"), F.col("root")).alias("root")  # a line without a link is its own
    cell = F.struct("block", "id", root, "n", *SKETCH_COLUMNS)
    near = d.groupBy("rep", "p", "q").agg(F.collect_list(cell).alias("l")).filter(F.size("l") > 1).select("rep", "p", "q", "l")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells, cut = b.column(3).flatten(), b.column(3).offsets.to_numpy()
            cut = cut - cut[0]
            block, size = cells.field("block").to_numpy(), cells.field("n").to_numpy().astype(np.int64)
            roots = pc.coalesce(cells.field("root"), cells.field("id"))
            root = roots.dictionary_encode().indices.to_numpy()
            maps = np.stack([cells.field(c).to_numpy().view(np.uint64) for c in SKETCH_COLUMNS], axis=1)
            found = with_partner(maps, size, block, root, list(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), cut[:-1], cut[1:])))
            group, at = pa.array(np.searchsorted(cut, found, side="right") - 1), pa.array(found)
            yield pa.RecordBatch.from_arrays([b.column(0).take(group), cells.field("id").take(at), roots.take(at)],
                                             names=["rep", "id", "root"])

    return stored(in_arrow(near, run, "rep binary, id binary, root binary").distinct(), "line-partners")


def crossing(apart: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """``(a, b)``: roots of lines that have a common band and link.  Two blocks of lines (512 at most) are
    compared inside one row, which yields each pair of roots once: pairs of lines make no rows."""
    d = blocked(apart, _texts(docs, text, apart.select("id")))
    near = d.groupBy("rep", "p", "q").agg(F.collect_list(F.struct("block", "root", "line")).alias("l")).select("p", "q", "l")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells, cut = b.column(2).flatten(), b.column(2).offsets.to_numpy()
            cut = cut - cut[0]
            block, lines = cells.field("block").to_numpy(), cells.field("line")
            names = cells.field("root").dictionary_encode()
            root, named, found = names.indices.to_numpy(), names.dictionary, set()
            for p, q, s, e in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), cut[:-1], cut[1:]):
                found |= linked_roots(lines.slice(s, e - s).to_pylist(), block[s:e], root[s:e], p, q)
            x, y = (named.take(pa.array([f[k] for f in found], pa.int32())) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([x, y], names=["a", "b"])

    return in_arrow(near, run, "a binary, b binary").distinct()


def dropped_lines(docs: DataFrame, text: str = "text", key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """``(rows, drops)``: rows has ``doc_id, lines`` (the MD5 of each line, null without a word) of every
    input row; drops has ``doc, dropped`` (sorted line numbers from 0) where any line goes."""
    marks: list[DataFrame] = []  # the sketches of all ids in groups: each is in one of the pairs

    def verify(pairs: DataFrame) -> DataFrame:
        marks.append(sketches(docs, text, pairs.select(F.explode(F.array("a", "b")).alias("id"))))
        return similar(may_link(pairs, marks[0]), docs, text)

    with recorded() as spent:
        cut = [BANDS * k // PASSES for k in range(PASSES + 1)]
        links = grouped_links([bands(docs, text, range(a, b)) for a, b in zip(cut, cut[1:])], verify, lambda apart: crossing(with_partners(apart, marks[0]), docs, text))
    comps = stored(links, "line-components")
    discard(docs.sparkSession, spent)
    rows = stored(docs.select(F.col(key).cast("bigint").alias("doc_id"), F.transform(
        _lines(F.col(text)), lambda x: F.when(_has_word(x), F.unhex(F.md5(x)))).alias("lines")), "lines")
    occ = (rows.select(F.coalesce("doc_id", F.lit(NONE)).alias("doc"), F.posexplode("lines").alias("no", "id"))
           .filter("id is not null"))
    first = occ.groupBy("id").agg(F.min(F.struct("doc", "no")).alias("first"), F.count(F.lit(1)).alias("times"))
    roots = (first.join(comps.withColumnRenamed("node", "id"), "id", "left").filter("times > 1 or root is not null")
             .select("id", "first", F.coalesce("root", "id").alias("root")))  # any other line stays
    roots = stored(roots, "line-roots")
    keep = stored(roots.groupBy("root").agg(F.min("first").alias("keep")).join(roots.select("id", "root"), "root")
                  .select("id", "keep"), "kept-lines")
    gone = maybe_in(occ, "id", bitmap(keep, "id")).join(keep, "id").filter(F.struct("doc", "no") != F.col("keep"))
    return rows, gone.groupBy("doc").agg(F.sort_array(F.collect_set("no")).alias("dropped"))


def line_dedup(docs: DataFrame) -> DataFrame:
    """``doc_id, n_lines, n_dropped, dropped`` of every row; n_lines counts lines with a word."""
    rows, drops = dropped_lines(docs)
    n = F.size(F.filter("lines", lambda x: x.isNotNull())).cast("bigint")
    d = rows.select("doc_id", n.alias("n_lines"), F.coalesce("doc_id", F.lit(NONE)).alias("doc")).join(drops, "doc", "left")
    dropped = F.coalesce("dropped", F.array().cast("array<int>"))
    return d.select("doc_id", "n_lines", F.size(dropped).cast("bigint").alias("n_dropped"), dropped.alias("dropped"))


def deduplicated(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with the dropped lines taken out of the text; a document all of whose lines with a word went is dropped."""
    _, drops = dropped_lines(docs, text, key)
    drops = drops.select(F.col("doc").alias("_doc"), F.col("dropped").alias("_dropped"))
    lines = _lines(F.col(text))
    rest = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_dropped"))
    left = F.transform(F.array(lines), lambda ls: F.array_join(F.transform(rest, lambda i: F.get(ls, i)), "\n"))[0]
    out = (docs.withColumn("_doc", F.coalesce(F.col(key).cast("bigint"), F.lit(NONE))).join(drops, "_doc", "left")
           .withColumn("_text", F.when(F.col("_dropped").isNull(), F.col(text)).otherwise(left))
           .filter(F.col("_dropped").isNull() | F.exists(_lines(F.col("_text")), _has_word)))
    return out.select(*[F.col("_text").alias(c) if c == text else F.col(c) for c in docs.columns])
