"""Exact dedup by deterministic block naming.

Every text is cut into fixed-size blocks.  All distinct blocks are sorted and
numbered, so a block's integer name stands for its exact content.  Adjacent
names are then paired, distinct pairs sorted and numbered again, and so on
until each document is left with one name.  Names never collide, because they
are numbered from the values themselves; a 64-bit pair of hashes only carries
the name back to the blocks, and it is checked over all distinct blocks to be
one-to-one (otherwise another seed is taken).

Cases: null text counts as empty; the empty text is one block; a null doc_id
ranks below every number; repeated rows are members of one group like any
other copies; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carecheck.llm.common import lower_az, stored

BLOCK_CHARS = 8192


def _key(seed: int, *cols) -> list[Column]:
    return [F.xxhash64(F.lit(2 * seed), *cols).alias("k1"), F.xxhash64(F.lit(2 * seed + 1), *cols).alias("k2")]


def _names(values: DataFrame, cols: list[str], tag: str) -> tuple[int, DataFrame]:
    """(seed, table k1, k2, name): distinct values sorted into integers."""
    for seed in range(100):
        named = stored(values.select(*_key(seed, *cols), *cols).groupBy("k1", "k2", *cols).agg(F.lit(1).alias("_one"))
                       .sortWithinPartitions("k1", "k2", *cols)
                       .select("k1", "k2", F.monotonically_increasing_id().alias("name")), tag)
        if named.groupBy("k1", "k2").count().filter("count > 1").isEmpty():
            return seed, named
    raise RuntimeError("no seed gives one-to-one keys")


def identities(docs: DataFrame, text: str = "text", block_chars: int = BLOCK_CHARS,
               normalise=lower_az, key: str = "doc_id") -> DataFrame:
    """One row per input row: ``doc_id, level, name, text_sha256``; two rows have equal texts (after
    ``normalise``) exactly when ``(level, name)`` are equal."""
    t = normalise(F.coalesce(F.col(text), F.lit("")))
    d = docs.select(F.col(key).alias("doc_id"), t.alias("t"))
    cut = F.regexp_extract_all("t", F.lit("(?s).{1,%d}" % block_chars), F.lit(0))
    blocks = d.select(F.explode(F.when(F.col("t") == "", F.array(F.lit(""))).otherwise(cut)).alias("block"))
    seed, names = _names(blocks, ["block"], "blocks")
    # the same texts always give the same key list, so one row per distinct list is enough from here on
    keyed = d.select(
        "doc_id", F.sha2("t", 256).alias("text_sha256"),
        F.transform(F.when(F.col("t") == "", F.array(F.lit(""))).otherwise(cut),
                    lambda b: F.struct(F.xxhash64(F.lit(2 * seed), b).alias("k1"),
                                       F.xxhash64(F.lit(2 * seed + 1), b).alias("k2"))).alias("ks"))
    one = keyed.filter(F.size("ks") == 1).select(
        "doc_id", "text_sha256", F.col("ks")[0]["k1"].alias("k1"), F.col("ks")[0]["k2"].alias("k2"))
    single = (one.join(names, ["k1", "k2"])
              .select("doc_id", F.lit(0).alias("level"), "name", "text_sha256"))
    many = keyed.filter(F.size("ks") > 1)
    rows = stored(many.select("ks").distinct().select(F.monotonically_increasing_id().alias("row"), "ks"), "lists")
    cur = stored(rows.select("row", F.posexplode("ks").alias("pos", "k")).select("row", "pos", "k.k1", "k.k2")
                 .join(names, ["k1", "k2"]).select("row", "pos", "name"), "level")
    done, level = [], 0
    while not cur.isEmpty():
        level += 1
        pairs = (cur.groupBy("row", F.floor(F.col("pos") / 2).cast("int").alias("pos"))
                 .agg(F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("l"),
                      F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1).cast("bigint")).alias("r")))
        pairs = stored(pairs, "pairs")
        s, named = _names(pairs, ["l", "r"], "pairnames")
        up = stored(pairs.select("row", "pos", *_key(s, "l", "r")).join(named, ["k1", "k2"]).select("row", "pos", "name"), "level")
        whole = up.groupBy("row").agg(F.max("pos").alias("last"))
        done.append(up.join(whole.filter("last = 0"), "row").select("row", F.lit(level).alias("level"), "name"))
        cur = stored(up.join(whole.filter("last > 0"), "row").select("row", "pos", "name"), "rest")
    if not done:
        return single
    ids = done[0]
    for x in done[1:]:
        ids = ids.unionByName(x)
    ids = rows.join(ids, "row").select("ks", "level", "name")
    return single.unionByName(many.join(ids, "ks").select("doc_id", "level", "name", "text_sha256"))


def exact_dedup(docs: DataFrame, **kw) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row; of
    equal texts the row with the largest doc_id stays (of repeated rows with
    that doc_id all are marked kept)."""
    ids = stored(identities(docs, **kw), "identities")
    groups = ids.groupBy("level", "name").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return (ids.join(groups, ["level", "name"])
            .select("doc_id", "keep_id", "group_size",
                    F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"))


ORACLE = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
           FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
