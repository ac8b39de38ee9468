"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every source gets a word budget.  It first contributes complete epochs; what
is left of its budget goes to documents in the order of exponential keys
``-ln(u) / weight`` (``u`` from a hash of the doc_id, ``weight`` the document's
quality weight), by a prefix sum of their sizes up to the budget.  The
document at the edge is taken when that brings the total nearer to the budget.

The prefix sum never gathers a source: keys fall into ``BUCKETS`` key ranges
per source, one small table holds the sums of earlier ranges, and a window
runs inside one range only.

Cases: null text has size 0 and is never taken; a null source is a source of
its own, ranked last; equal keys go by doc_id, then arbitrarily among repeated
rows (which are alike); an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from carecheck.llm.common import WORD, stored

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
BUCKETS = 4096
SEED = "mix-1"
QUALITY_WEIGHT = {1: 2.0, 0: 0.5}  # of labelled documents; others weigh 1


def quality_weights(labels: DataFrame) -> DataFrame:
    """``doc_id, weight`` from the quality labels."""
    q = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("q"))
    w = F.lit(1.0)
    for k, v in QUALITY_WEIGHT.items():
        w = F.when(F.col("q") == k, F.lit(v)).otherwise(w)
    return q.select("doc_id", w.alias("weight"))


def targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``skey, source_size, target`` from ``skey, source_size`` (one row per source, null ranked last).

    Sources fill like vessels: a source is full at ``max_epochs`` times its
    size, so with sources in the order of (full level = full size / weight) the
    common level is the first one that lies below the next full level."""
    rank = W.orderBy(F.col("skey").asc_nulls_last())
    s = sizes.withColumn("rank", F.row_number().over(rank) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", max_epochs * F.col("source_size")).withColumn("full", F.col("cap") / F.col("weight"))
    by_full = W.orderBy("full", "rank")
    s = (s.withColumn("spent", F.coalesce(F.sum("cap").over(by_full.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
         .withColumn("left", F.sum("weight").over(by_full.rowsBetween(W.currentRow, W.unboundedFollowing)))
         .withColumn("total", F.sum("source_size").over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
         .withColumn("level", (F.col("total") - F.col("spent")) / F.col("left")))
    first = F.min(F.when(F.col("level") <= F.col("full"), F.struct("full", "rank", "level")))
    s = s.withColumn("found", first.over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    return s.select("skey", "source_size",
                    F.least(F.col("cap").cast("double"), F.col("weight") * F.col("found.level")).alias("target"))


def _keyed(docs: DataFrame, weights_by_doc: DataFrame | None, text: str, source: str, key: str, carry: bool = False) -> DataFrame:
    """``doc_id, skey, size, k`` of every input row, and the row itself as the struct ``row`` with ``carry``."""
    row = [F.struct(*[F.col(c) for c in docs.columns]).alias("row")] if carry else []
    d = docs.select(*row, F.col(key).alias("doc_id"), F.col(source).cast("string").alias("skey"),
                    F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("bigint").alias("size"))
    u = (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 13),
                16, 10).cast("double") + 0.5) / float(1 << 52)
    if weights_by_doc is None:
        d = d.withColumn("weight", F.lit(1.0))
    else:
        d = (d.join(weights_by_doc, "doc_id", "left")
             .withColumn("weight", F.coalesce("weight", F.lit(1.0))))
    return d.withColumn("k", -F.log(u) / F.col("weight")).drop("weight")


def mix(docs: DataFrame, weights_by_doc: DataFrame | None = None, text: str = "text", source: str = "source",
        key: str = "doc_id", buckets: int = BUCKETS) -> DataFrame:
    """One row per input row: ``doc_id, skey, size, k, source_size, target, epochs, picked, taken``."""
    d = _keyed(docs, weights_by_doc, text, source, key)
    d = stored(d.withColumn("bucket", F.floor((1 - F.exp(-F.col("k"))) * buckets).cast("int")), "mix-keys")
    sums = stored(d.groupBy("skey", "bucket").agg(F.sum("size").alias("words")), "mix-sums")
    per_source = targets(sums.groupBy("skey").agg(F.sum("words").alias("source_size")))
    before = F.coalesce(F.sum("words").over(W.partitionBy("skey").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn("earlier", before)
    plan = (sums.alias("a").join(per_source.alias("b"), F.col("a.skey").eqNullSafe(F.col("b.skey")))
            .select("a.skey", "a.bucket", "earlier", "source_size", "target"))
    plan = (plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
            .withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size")))
    j = (d.alias("d").join(plan.alias("p"), F.col("d.skey").eqNullSafe(F.col("p.skey")) & (F.col("d.bucket") == F.col("p.bucket")))
         .select("doc_id", "d.skey", "d.bucket", "size", "k", "earlier", "source_size", "target", "epochs", "budget"))
    inner = (W.partitionBy("skey", "bucket").orderBy("k", F.col("doc_id").asc_nulls_first(), "size")
             .rowsBetween(W.unboundedPreceding, -1))
    start = F.col("earlier") + F.coalesce(F.sum("size").over(inner), F.lit(0))
    j = j.withColumn("picked", (F.col("size") > 0) & (start + F.col("size") / 2 <= F.col("budget")))
    return j.select("doc_id", "skey", "size", "k", "source_size", "target", F.col("epochs").cast("int").alias("epochs"), "picked",
                    (F.col("size") * (F.col("epochs") + F.col("picked").cast("int"))).cast("bigint").alias("taken"))


def mixing(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    m = mix(docs, None if labels is None else quality_weights(labels))
    return m.select("doc_id", "size", "source_size", "target", "taken")


def cuts(m: DataFrame) -> DataFrame:
    """``skey, epochs, cut, part``, one row per source: the rows picked beyond the epochs are those up to ``cut``
    in the order of (k, doc_id, size), as the prefix sum grows with it.  Of rows alike in all three at the cut only
    ``part`` are picked; null where all of them are."""
    at = F.struct("k", "doc_id", "size")
    d = m.filter("size > 0").withColumn("at", at)
    ends = d.groupBy("skey").agg(F.max("epochs").alias("epochs"), F.max(F.when(F.col("picked"), F.col("at"))).alias("cut"))
    tie = d.groupBy("skey", "at").agg(F.count(F.lit(1)).alias("n"), F.count_if("picked").alias("part")).filter("part > 0 and part < n")
    return (ends.alias("e").join(tie.alias("t"), F.col("e.skey").eqNullSafe(F.col("t.skey")), "left")
            .select("e.skey", "epochs", "cut", "part"))


def mixed(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """The mix itself: every document's row as often as it is taken.  Only the cut of each source comes back
    from the prefix sums, so the texts move at most once, to meet their label."""
    weights = None if labels is None else quality_weights(labels)
    c = stored(cuts(mix(docs, weights)), "mix-cuts")

    def placed(part: DataFrame, cut: DataFrame) -> DataFrame:
        d = _keyed(part, weights, "text", "source", "doc_id", carry=True).filter("size > 0").withColumn("at", F.struct("k", "doc_id", "size"))
        return d.alias("d").join(cut.alias("c"), F.col("d.skey").eqNullSafe(F.col("c.skey")))

    below = (F.col("at") < F.col("cut")) | ((F.col("at") <= F.col("cut")) & F.col("part").isNull())
    d = placed(docs, c).withColumn("_times", F.col("epochs") + F.coalesce(below, F.lit(False)).cast("int"))
    whole = d.filter("_times > 0").select("row", F.explode(F.sequence(F.lit(1), "_times"))).select("row.*")
    split = c.filter("part is not null")
    ids = split.select(F.col("cut.doc_id").alias("_cut")).distinct()
    alike = docs.join(ids, F.col("doc_id").eqNullSafe(F.col("_cut")), "left_semi")
    at_cut = placed(alike, split).filter((F.col("at") <= F.col("cut")) & (F.col("at") >= F.col("cut")))
    rank = F.row_number().over(W.partitionBy("d.skey").orderBy(F.xxhash64("row.text")))
    return whole.unionByName(at_cut.withColumn("_rank", rank).filter("_rank <= part").select("row.*"))


ORACLE = rf"""
WITH q AS (SELECT doc_id, max(quality) AS q FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
d AS (SELECT x.doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
             CASE q.q WHEN 1 THEN 2.0 WHEN 0 THEN 0.5 ELSE 1.0 END AS w
      FROM documents x LEFT JOIN q ON x.doc_id = q.doc_id),
k AS (SELECT *, -ln((CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) + 0.5)
                    / 4503599627370496.0) / w AS k FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank
      FROM k GROUP BY source),
f AS (SELECT *, [5, 2, 1][rank % 3 + 1] AS weight, 3 * source_size AS cap, 3 * source_size / [5, 2, 1][rank % 3 + 1] AS full_at FROM s),
v AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY full_at, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER (ORDER BY full_at, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM f),
t AS (SELECT v.*, least(CAST(cap AS DOUBLE), weight * (SELECT level FROM v WHERE level <= full_at ORDER BY full_at, rank LIMIT 1)) AS target FROM v),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM t),
p AS (SELECT k.*, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS budget,
             coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY k.k, k.doc_id NULLS FIRST
                                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
      FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (epochs + CASE WHEN size > 0 AND start + size / 2 <= budget THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM p
"""
