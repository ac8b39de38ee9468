"""V19 on key ranges: a hash tree of a table, so that a change touches one leaf.

Position batches (``validate.revalidate``) shift behind an inserted row.  Here
the table is cut by the keys themselves: a row whose key's MD5 is divisible by
``leaf_rows`` starts a leaf, one divisible by ``leaf_rows * FAN`` a node of the
next level, and so on.  Leaves therefore hold ``leaf_rows`` rows on average and
are the same whatever else the table holds: an inserted, deleted or updated row
changes its own leaf (a row that starts a leaf splits or joins two), a moved
row (its key changed) the leaf it left and the one it entered.

Each node carries its row count and the sums of two seeded 64-bit hashes of its
rows (sums, so that partial aggregation works and equal rows do not cancel).
``changed_leaves`` compares two trees from the top: children are looked at only
below nodes that differ.  ``revalidate_leaves`` validates the rows of changed
leaves and takes the issues of the others from the stored ones.

Rows of equal key are in one leaf; null keys come first.  Columns that Spark
cannot hash enter as JSON.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carecheck.functions import exprs as E
from carecheck.operators.rules import Rule
from carecheck.operators.validate import issues_by, ruleset_hash
from carecheck.plans.rowindex import PART, ROW, TIE, filled, ranges
from carecheck.session import shared_table

LEAF_ROWS = 10_000
FAN = 64
TOP = ""  # the node before the first boundary
NODES = "level int, node string, parent string, n_rows long, content_hash string, ruleset_hash string"


def key_code(keys: list[str]) -> Column:
    """The MD5 of a row's key, in hex."""
    return F.md5(F.concat_ws("\x1f", *[F.coalesce(F.col(E.quote(k)).cast("string"), F.lit("\x1e")) for k in keys]))


def _starts(code: Column, every: int) -> Column:
    """Does a key of this code start a node of ``every`` rows on average?"""
    return F.conv(F.substring(code, 1, 12), 16, 10).cast("long") % F.lit(every) == 0


def leaves(df: DataFrame, keys: list[str], leaf_rows: int = LEAF_ROWS, num_partitions: int | None = None) -> DataFrame:
    """``df`` with ``leaf``, the code of the key that starts the row's leaf."""
    code = key_code(keys)
    cut = filled(ranges(df, keys, num_partitions), F.when(_starts(code, leaf_rows), code), "leaf")
    return cut.withColumn("leaf", F.coalesce("leaf", F.lit(TOP))).drop(PART, ROW)


def _content(prefix: str = "h") -> list[Column]:
    return [F.sum(f"{prefix}{i}").alias(f"h{i}") for i in (1, 2)]


def tree(data: DataFrame, keys: list[str], rules: str, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """The nodes (``NODES``) of ``data``, a result of ``leaves``; level 0 are the leaves, each level has a
    FAN-th of the nodes of the one below, up to a single node."""
    wide = lambda seed: F.xxhash64(F.lit(seed), TIE).cast("decimal(38,0)")
    low = F.min(F.struct(*[F.col(E.quote(k)) for k in keys])).alias("low")
    level = (data.withColumns({"h1": wide(1), "h2": wide(2)}).groupBy("leaf")
             .agg(low, F.count(F.lit(1)).alias("n_rows"), *_content()).withColumnRenamed("leaf", "node"))
    out, every, k = [], leaf_rows, 0
    while True:
        every *= FAN
        level = shared_table(level, f"tree-{k}")
        done = level.count() <= 1
        up = F.lit(TOP) if done else None
        if up is None:
            cut = filled(ranges(level, ["low"]), F.when(_starts(F.col("node"), every) & (F.col("node") != TOP), F.col("node")), "parent")
            level = cut.withColumn("parent", F.coalesce("parent", F.lit(TOP))).drop(PART, ROW, TIE)
        else:
            level = level.withColumn("parent", up)
        out.append(level.select(F.lit(k).alias("level"), "node", "parent", "n_rows",
                                F.concat_ws(":", F.col("h1").cast("string"), F.col("h2").cast("string")).alias("content_hash"),
                                F.lit(rules).alias("ruleset_hash")))
        if done:
            return shared_table(reduce(DataFrame.unionByName, out), "tree")
        level = (level.groupBy("parent").agg(F.min("low").alias("low"), F.sum("n_rows").alias("n_rows"), *_content())
                 .withColumnRenamed("parent", "node"))
        k += 1


def changed_leaves(now: DataFrame, before: DataFrame) -> DataFrame:
    """``leaf, change`` (``added``, ``changed``, ``removed``) between two trees, found from the top down."""
    tops = [t.agg(F.max("level")).first()[0] for t in (now, before)]
    top = min(x if x is not None else -1 for x in tops)
    same = ["n_rows", "content_hash", "ruleset_hash"]
    below = None
    for k in range(max(top, 0), -1, -1):
        a, b = (t.where(F.col("level") == k) for t in (now, before))
        if below is not None:  # children of nodes that differ
            a, b = (t.join(below, "parent", "left_semi") for t in (a, b))
        pair = (a.select("node", F.struct(*same).alias("a")).join(b.select("node", F.struct(*same).alias("b")), "node", "full_outer")
                .where(~F.col("a").eqNullSafe(F.col("b"))))
        if k == 0:
            kind = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").otherwise("changed")
            return pair.select(F.col("node").alias("leaf"), kind.alias("change"))
        below = shared_table(pair.select(F.col("node").alias("parent")), "differing")


def revalidate_leaves(df: DataFrame, rules: list[Rule], keys: list[str], stored: DataFrame, stored_issues: DataFrame,
                      leaf_rows: int = LEAF_ROWS, num_partitions: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(issues, tree, changes)``: issues by ``leaf``; only rows of leaves that are new or differ from the
    ``stored`` tree (or were judged by other rules) are validated."""
    data = leaves(df, keys, leaf_rows, num_partitions)
    now = tree(data, keys, ruleset_hash(rules), leaf_rows)
    changes = shared_table(changed_leaves(now, stored), "changes")
    todo = changes.where("change <> 'removed'").select("leaf")
    new = issues_by(data.drop(TIE).join(todo, "leaf", "left_semi"), todo, rules, "leaf")
    kept = stored_issues.join(changes.select("leaf"), "leaf", "left_anti")
    return new.unionByName(kept.select(*new.columns)), now, changes


def empty_tree(spark) -> DataFrame:
    return spark.createDataFrame([], NODES)
