"""Merkle manifest of a dataset, its trees laid out after van Emde Boas.

Every row is a leaf (SHA-256 of its fields); the leaves of a source, in the
order of doc_id, form a tree of arity 3 whose last run may be short, and the
subroots of the sources, in the order of the sources, form one more.  A tree
is cut into aligned subtrees of ``3^HEIGHT`` leaves.  A task builds one, and
stores it as one array in the van Emde Boas layout: the levels are split at
half height, the upper half comes first, then each lower subtree, each laid
out alike, so that a walk from leaf to root touches few stretches of memory
whatever their size.  ``addresses`` gives the place of each node by
arithmetic; construction and sibling retrieval go through it.  The roots of
the blocks are the leaves of the next round, until a source fits one block
(three rounds for 10^11 rows).

Only digests are shuffled, never texts; a hot source is many blocks.  Proofs
go down again: each block hands the path above it to its children, and the
leaves meet their block's array and path in one co-group of at most
``3^HEIGHT`` rows.

Cases: null fields count as ``-``; a null source is a source of its own and
comes first, apart from the empty one; null doc_ids come first in their source
and are not tampered with; rows of equal doc_id are ordered by their leaf,
repeated rows are leaves like any other; an empty table has no root and gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carecheck.llm.common import stored
from carecheck.llm.ordered import numbered

ARITY = 3
HEIGHT = 8  # a block: 6,561 leaves, 9,841 nodes, 315 kB
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TREES = "k string, block bigint, total bigint, n int, root binary, nodes binary"


def leaf(fields: dict[str, Column]) -> Column:
    def part(c: Column) -> Column:
        s = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))

    return F.sha2(F.concat(*[part(c) for c in fields.values()]), 256)


def tampered(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 2 == 0, F.lit(False))


# ---------------------------------------------------------------- layout
def nodes_of(levels: int) -> int:
    return (ARITY ** levels - 1) // (ARITY - 1)


@lru_cache(maxsize=None)
def addresses(levels: int) -> tuple[np.ndarray, ...]:
    """The place of every node in a complete tree, by depth (the root's is 0)."""
    if levels == 1:
        return (np.zeros(1, dtype=np.int64),)
    upper = levels // 2
    top, low = addresses(upper), addresses(levels - upper)
    first = nodes_of(upper) + nodes_of(levels - upper) * np.arange(ARITY ** upper, dtype=np.int64)
    return top + tuple((first[:, None] + a[None, :]).ravel() for a in low)


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def build(leaves: list[str], whole: bool, height: int) -> tuple[int, np.ndarray]:
    """``(levels, nodes)`` of one block in its layout; ``whole``: the block is all of its tree and ends at the
    first single node, otherwise it is ``height`` runs high."""
    rows = [leaves]
    while len(rows[-1]) > 1 if whole else len(rows) <= height:
        below = rows[-1]
        rows.append([_hash("".join(below[i:i + ARITY])) for i in range(0, len(below), ARITY)])
    place = addresses(len(rows))
    nodes = np.zeros((nodes_of(len(rows)), 32), dtype=np.uint8)
    for depth, row in enumerate(reversed(rows)):
        nodes[place[depth][:len(row)]] = np.frombuffer(bytes.fromhex("".join(row)), dtype=np.uint8).reshape(-1, 32)
    return len(rows), nodes


def siblings(nodes: np.ndarray, n: int, levels: int) -> list[list[str]]:
    """The digests of a block's levels but the last, from the leaves up, read at their addresses."""
    place, rows = addresses(levels), []
    for depth in range(levels - 1, 0, -1):
        text = nodes[place[depth][:n]].tobytes().hex()
        rows.append([text[64 * i:64 * i + 64] for i in range(n)])
        n = -(-n // ARITY)
    return rows


def path(rows: list[list[str]], i: int) -> list[tuple[str, str]]:
    """What stands left and right of node ``i`` in its run, level by level."""
    out = []
    for row in rows:
        run = i - i % ARITY
        out.append(("".join(row[run:i]), "".join(row[i + 1:run + ARITY])))
        i //= ARITY
    return out


def write_path(p: list[tuple[str, str]]) -> str:
    return ";".join(f"{x}|{y}" for x, y in p)


def read_path(p: str) -> list[tuple[str, str]]:
    return [tuple(x.split("|")) for x in p.split(";")] if p else []


def fold(digest: str, p: list[tuple[str, str]]) -> str:
    """The root that a leaf and its siblings give."""
    for x, y in p:
        digest = _hash(x + digest + y)
    return digest


# ---------------------------------------------------------------- trees
def _levels(nodes: int) -> int:
    levels = 1
    while nodes_of(levels) < nodes:
        levels += 1
    return levels


def _nodes(value: bytes) -> np.ndarray:
    return np.frombuffer(value, dtype=np.uint8).reshape(-1, 32)


def _block(height: int) -> Column:
    return F.floor(F.col("at") / F.lit(ARITY ** height)).alias("block")


def trees(leaves: DataFrame, height: int = HEIGHT) -> list[DataFrame]:
    """The blocks of each round for ``leaves(k, at, total, digest)``: a written table of ``TREES`` a round."""
    span = ARITY ** height

    def grow(key, rows):
        rows = rows.sort_by("at")
        total = rows.column("total")[0].as_py()
        levels, nodes = build([x.hex() for x in rows.column("digest").to_pylist()], total <= span, height)
        root = nodes[addresses(levels)[0][0]].tobytes()
        return pa.table({"k": [key[0].as_py()], "block": [key[1].as_py()], "total": [total], "n": pa.array([rows.num_rows], pa.int32()),
                         "root": pa.array([root], pa.binary()), "nodes": pa.array([nodes.tobytes()], pa.binary())})

    out = []
    while True:
        d = leaves.select("k", _block(height), "at", "total", "digest")
        out.append(stored(d.groupBy("k", "block").applyInArrow(grow, TREES), f"merkle-{len(out)}"))
        more = out[-1].filter(F.col("total") > span)
        if more.isEmpty():
            return out
        leaves = more.select("k", F.col("block").alias("at"), F.ceil(F.col("total") / span).alias("total"), F.col("root").alias("digest"))


def tops(rounds: list[DataFrame], height: int = HEIGHT) -> DataFrame:
    """``k, root``: the root of every tree."""
    out = [r.filter(F.col("total") <= ARITY ** height).select("k", "root") for r in rounds]
    for x in out[1:]:
        out[0] = out[0].unionByName(x)
    return out[0]


def _handed_down(blocks: DataFrame) -> DataFrame:
    """``k, block, up, subroot`` for the children of ``blocks(k, block, n, nodes, first, up, subroot)``; ``first``
    is the number of a block's first leaf, a child's block its number among the leaves of its tree."""

    def down(key, b):
        r = b.to_pylist()[0]
        nodes = _nodes(r["nodes"])
        rows = siblings(nodes, r["n"], _levels(len(nodes)))
        up = read_path(r["up"])
        return pa.table({"k": [r["k"]] * r["n"], "block": pa.array([r["first"] + i for i in range(r["n"])], pa.int64()),
                         "up": [write_path(path(rows, i) + up) for i in range(r["n"])], "subroot": [r["subroot"]] * r["n"]})

    return blocks.groupBy("k", "block").applyInArrow(down, "k string, block bigint, up string, subroot string")


def paths(rounds: list[DataFrame], above: DataFrame, height: int = HEIGHT) -> DataFrame:
    """``k, block, up, subroot`` for the first round's blocks; ``above(k, up, subroot)``: the path above each tree."""
    span, known = ARITY ** height, None
    for r in reversed(rounds):
        ups = r.filter(F.col("total") <= span).select("k", "block").join(above, "k")
        if known is not None:
            ups = ups.unionByName(known)
        if r is rounds[0]:
            return ups
        d = r.join(ups, ["k", "block"]).select("k", "block", "n", "nodes", "up", "subroot", (F.col("block") * span).alias("first"))
        known = stored(_handed_down(d), "merkle-paths")
    raise ValueError("no rounds")


# ---------------------------------------------------------------- manifest
def _source_key(source: Column) -> Column:
    """Orders as the sources do, null first, without being null."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def leaves(docs: DataFrame) -> DataFrame:
    """``k, doc_id, digest, changed, at, total``: numbered leaves; ``changed`` is the digest after tampering
    (null where nothing is done to the row)."""
    fields = {c: F.col(c) for c in FIELDS}
    bare = F.replace(F.col("text"), F.lit("\n"), F.lit(""))
    d = docs.select(_source_key(F.col("source")).alias("k"), F.col("doc_id"), F.unhex(leaf(fields)).alias("digest"),
                    F.when(tampered(F.col("doc_id")), F.unhex(leaf(fields | {"text": bare}))).alias("changed"))
    return numbered(d, ["k"], [F.col("doc_id").asc_nulls_first(), "digest"], "leaves")


def manifest(docs: DataFrame, height: int = HEIGHT) -> tuple[DataFrame, list[DataFrame], DataFrame, list[DataFrame]]:
    """``(leaves, trees of the sources, numbered subroots, trees over the subroots)``; the tables of trees are the manifest."""
    rows = leaves(docs)
    by_source = trees(rows.select("k", "at", "total", "digest"), height)
    subroots = numbered(tops(by_source, height).select("k", F.col("root").alias("digest")), [], ["k"], "subroots")
    return rows, by_source, subroots, trees(subroots.select(F.lit("").alias("k"), "at", "total", "digest"), height)


def root(over_sources: list[DataFrame], height: int = HEIGHT) -> str | None:
    """The dataset's root (of the trees over the subroots); None of an empty table."""
    top = tops(over_sources, height).select(F.lower(F.hex("root"))).first()
    return top[0] if top else None


def proofs(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row."""
    rows, by_source, subroots, over = manifest(docs, height)
    whole = root(over, height)
    start = docs.sparkSession.createDataFrame([("", "", "")], "k string, up string, subroot string")
    heads = over[0].join(paths(over, start, height), ["k", "block"])
    span = ARITY ** height
    heads = _handed_down(heads.select("k", "block", "n", "nodes", "up", "subroot", (F.col("block") * span).alias("first")))
    above = stored(heads.select(F.col("block").alias("at"), "up").join(subroots, "at")
                   .select("k", "up", F.lower(F.hex("digest")).alias("subroot")), "merkle-above")
    blocks = by_source[0].join(paths(by_source, above, height), ["k", "block"]).select("k", "block", "n", "nodes", "up", "subroot")
    cut = rows.select("k", _block(height), "at", "doc_id", "digest", "changed")

    def prove(key, own, block):
        out = {c: [] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")}
        b = block.to_pylist()[0]
        nodes = _nodes(b["nodes"])
        levels, up = siblings(nodes, b["n"], _levels(len(nodes))), read_path(b["up"])
        upper = "".join(x + y for x, y in up)
        first = key[1].as_py() * span
        for at, doc_id, digest, changed in zip(*(own.column(c).to_pylist() for c in ("at", "doc_id", "digest", "changed"))):
            near = path(levels, at - first)
            folded = fold(fold((changed or digest).hex(), near), up)
            for c, v in zip(out, (doc_id, digest.hex(), b["subroot"], whole,
                                  _hash("".join(x + y for x, y in near) + upper), folded, folded == whole)):
                out[c].append(v)
        return pa.table(out, schema=schema)

    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")),
                        ("verified", pa.bool_())])
    return (cut.withColumn("doc_id", F.col("doc_id").cast("bigint")).groupBy("k", "block").cogroup(blocks.groupBy("k", "block"))
            .applyInArrow(prove, "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, "
                                 "folded_root string, verified boolean"))


_LEAF = " || ".join(f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR), '-')" for c in FIELDS)
_CRC_BYTE = "lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
ORACLE = f"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i] || [0, 0, 0, 0, 0, 0, 0, 0], {_CRC_BYTE})) AS tab),
d AS (SELECT doc_id, source, {_LEAF} AS whole, {_LEAF.replace("text", "replace(text, chr(10), '')")} AS bare,
             xor(list_reduce([4294967295] || list_transform(range(length(CAST(doc_id AS VARCHAR))),
                 lambda k: CAST(ascii(substr(CAST(doc_id AS VARCHAR), CAST(k + 1 AS BIGINT), 1)) AS BIGINT)),
                 lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255) + 1])), 4294967295) AS code
      FROM documents, crc),
l AS (SELECT doc_id, source, sha256(whole) AS leaf, CASE WHEN code % 2 = 0 THEN sha256(bare) ELSE sha256(whole) END AS changed FROM d),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
             row_number() OVER (ORDER BY source, doc_id, leaf) AS n FROM l),
lv(source, level, pos, h) AS (
  SELECT source, 0, pos, leaf FROM p
  UNION ALL
  SELECT source, level + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos))
  FROM (SELECT *, count(*) OVER (PARTITION BY source) AS c FROM lv) WHERE c > 1 GROUP BY source, level, pos // 3),
heights AS (SELECT source, max(level) AS height FROM lv GROUP BY source),
subs AS (SELECT lv.source, h AS subroot, height, row_number() OVER (ORDER BY encode(lv.source) NULLS FIRST) - 1 AS pos
         FROM lv JOIN heights t ON lv.source IS NOT DISTINCT FROM t.source AND lv.level = t.height),
top(level, pos, h) AS (
  SELECT 0, pos, subroot FROM subs
  UNION ALL
  SELECT level + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos))
  FROM (SELECT *, count(*) OVER () AS c FROM top) WHERE c > 1 GROUP BY level, pos // 3),
root AS (SELECT h AS root, level AS height FROM top ORDER BY level DESC LIMIT 1),
-- one tree for all: levels of the sources' trees first, those over the subroots from level 1000 on
node AS (SELECT source, level, pos, h FROM lv UNION ALL SELECT NULL, 1000 + level, pos, h FROM top),
up(n, source, slot, height, level, pos, cur, proof) AS (
  SELECT p.n, p.source, s.pos, s.height, CASE WHEN s.height = 0 THEN 1000 ELSE 0 END,
         CASE WHEN s.height = 0 THEN s.pos ELSE p.pos END, changed, ''
  FROM p JOIN subs s ON p.source IS NOT DISTINCT FROM s.source
  UNION ALL
  SELECT n, any_value(u.source), any_value(slot), any_value(height),
         CASE WHEN u.level + 1 = any_value(height) THEN 1000 ELSE u.level + 1 END,
         CASE WHEN u.level + 1 = any_value(height) THEN any_value(slot) ELSE any_value(u.pos) // 3 END,
         sha256(string_agg(CASE WHEN x.pos = u.pos THEN cur ELSE h END, '' ORDER BY x.pos)),
         any_value(proof) || coalesce(string_agg(h, '' ORDER BY x.pos) FILTER (x.pos <> u.pos), '')
  FROM up u JOIN node x ON u.level = x.level AND u.pos // 3 = x.pos // 3 AND (u.level >= 1000 OR u.source IS NOT DISTINCT FROM x.source)
  WHERE u.level < 1000 + (SELECT height FROM root)
  GROUP BY n, u.level),
names AS (SELECT p.n, p.doc_id, p.leaf, s.subroot FROM p JOIN subs s ON p.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = root AS verified
FROM up JOIN names USING (n), root WHERE up.level = 1000 + root.height
"""
