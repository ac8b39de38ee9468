"""Sharding by Karmarkar-Karp differencing.  Law: ``bytes``, shards of near equal size.

Equal texts are one indivisible group.  Differencing starts from a partial
partition per item (the item in one part, the others empty), repeatedly takes
the two of largest spread and joins them oppositely ordered (the fullest part
of one with the emptiest of the other), and unwinds the joins at the end.

The items are bounded, however many groups there are.  A group with more than
one 4096th of all bytes is an item of its own (4,096 at most).  The others are
summed into bundles by a hash of the text, half of them in 1024 bundles, a
quarter in 1024 smaller ones and so on (32 steps): the small bundles are what
differencing fills the last gaps with.  All sums are pre-aggregated on Spark;
one task differences at most 36,864 items, and rows look up their shard in
that table, so no row or text moves for it.  Slots come from windows over
(shard, bucket) and the bucket sums, repeated rows counted as one until then,
so neither a hot group nor a hot row is gathered in one task.

A group larger than a shard's share makes its shard larger: it is indivisible.

Cases: null and empty texts are one group, with a CRC of 0; a null doc_id is a
key like any other; repeated rows get slots of their own; an empty table gives
an empty result; extra columns are ignored by ``sharded`` and kept by ``write_shards``.
"""

from __future__ import annotations

import heapq
from array import array

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from carecheck.llm.common import stored

SHARDS = 40
ROW_BYTES = 16
LARGE = 4096  # a group of more than one LARGE-th of all bytes is an item of its own
BUNDLES, STEPS = 1024, 32
SLOT_BUCKETS = 1024


def differencing(sizes: list[int], parts: int) -> list[int]:
    """The part of every item.  Ties go to the item or partition that came first."""
    none = [0] * (parts - 1)
    heap = [(-s, i, [s] + none) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    joins = []  # (left, right, order): part r of the result is left's part order[r] and right's opposite one
    while len(heap) > 1:
        _, a, left = heapq.heappop(heap)
        _, b, right = heapq.heappop(heap)
        sums = [x + y for x, y in zip(left, reversed(right))]
        order = sorted(range(parts), key=lambda j: -sums[j])
        least = sums[order[-1]]
        joins.append((a, b, array("l", order)))
        heapq.heappush(heap, (least - sums[order[0]], len(sizes) + len(joins) - 1, [sums[j] - least for j in order]))
    part = [0] * len(sizes)
    labels = {len(sizes) + len(joins) - 1: list(range(parts))}
    for n in range(len(joins) - 1, -1, -1):
        a, b, order = joins[n]
        of = labels.pop(len(sizes) + n)
        for child, back in ((a, False), (b, True)):
            own = [0] * parts
            for r, j in enumerate(order):
                own[parts - 1 - j if back else j] = of[r]
            if child < len(sizes):
                part[child] = own[0]
            else:
                labels[child] = own
    return part


def group_id(text: Column) -> Column:
    """The group of a text.  Should two texts ever collide, they only stay together."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def bundle(group: Column) -> Column:
    """The bundle of a small group: step by the trailing zeros of its hash, so that each step has half the
    groups of the one before."""
    low = group.bitwiseAND(F.lit(0xFFFFFFFF))
    step = F.least(F.bit_count(low.bitwiseXOR(low - 1)) - 1, F.lit(STEPS - 1))
    return (step * BUNDLES + F.shiftrightunsigned(group, 40).bitwiseAND(F.lit(BUNDLES - 1))).cast("bigint")


def _size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("bigint")


def assignment(groups: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``large, id, shard`` for ``groups(g, bytes)``: the shard of every large group (id its g) and of every
    bundle of small ones.  LARGE + BUNDLES * STEPS rows at most."""
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    large = F.col("bytes") * LARGE > F.lit(total)
    items = (groups.groupBy(large.alias("large"), F.when(large, F.col("g")).otherwise(bundle(F.col("g"))).alias("id"))
             .agg(F.sum("bytes").alias("bytes")))

    def deal(p):
        p = p.sort_values(["bytes", "large", "id"], ascending=[False, True, True])
        p["shard"] = differencing([int(x) for x in p["bytes"]], shards)
        return p[["large", "id", "shard"]]

    return stored(items.groupBy().applyInPandas(deal, "large boolean, id bigint, shard int"), "shards")


def with_shard(d: DataFrame, table: DataFrame) -> DataFrame:
    """``d(g, ...)`` with ``shard``, looked up in an ``assignment``."""
    own = table.filter("large").select(F.col("id").alias("g"), F.col("shard").alias("_own"))
    small = table.filter("not large").select(F.col("id").alias("_bundle"), F.col("shard").alias("_small"))
    return (d.withColumn("_bundle", bundle(F.col("g"))).join(F.broadcast(own), "g", "left")
            .join(F.broadcast(small), "_bundle", "left")
            .withColumn("shard", F.coalesce("_own", "_small")).drop("_own", "_small", "_bundle"))


def sharded(docs: DataFrame, shards: int = SHARDS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("doc_id"), _size(F.col(text)).alias("size"), F.crc32(t).alias("text_crc32"),
                       group_id(F.col(text)).alias("g"))
    rows = stored(rows.groupBy("doc_id", "size", "text_crc32", "g").agg(F.count(F.lit(1)).alias("n")), "sizes")
    groups = stored(rows.groupBy("g").agg(F.sum(F.col("size") * F.col("n")).alias("bytes")), "texts")
    d = with_shard(rows, assignment(groups, shards))
    d = stored(d.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "g"), F.lit(SLOT_BUCKETS)).cast("int")), "sharded")
    earlier = W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    base = (d.groupBy("shard", "bucket").agg(F.sum("n").alias("n"))
            .select("shard", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base")))
    inner = W.partitionBy("shard", "bucket").orderBy("doc_id", "g").rowsBetween(W.unboundedPreceding, -1)
    first = F.coalesce(F.sum("n").over(inner), F.lit(0)) + F.col("base")
    d = d.join(F.broadcast(base), ["shard", "bucket"]).withColumn("first", first)  # shards * SLOT_BUCKETS rows at most
    return d.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                    F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, pieces: int = 1, text: str = "text", key: str = "doc_id") -> None:
    """All rows of ``docs`` as Parquet below ``path/shard=N``, ``pieces`` files a shard, each in the order of ``key``."""
    sized = docs.select(group_id(F.col(text)).alias("g"), _size(F.col(text)).alias("bytes"))
    groups = stored(sized.groupBy("g").agg(F.sum("bytes").alias("bytes")), "texts")
    row = F.struct(*[F.col(c) for c in docs.columns]).alias("row")
    d = with_shard(docs.select(row, group_id(F.col(text)).alias("g")), assignment(groups, shards)).drop("g")
    piece = F.pmod(F.xxhash64(F.col("row")[key]), F.lit(pieces))
    (d.repartition(shards * pieces, "shard", piece).sortWithinPartitions("shard", F.col("row")[key])
     .select("shard", "row.*").write.partitionBy("shard").parquet(path))
