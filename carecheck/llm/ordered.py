"""Positions of rows in an order, without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from carecheck.llm.common import stored

_ROW = (1 << 33) - 1  # the bits of monotonically_increasing_id that count within a partition


def numbered(df: DataFrame, by: list[str], order: list, name: str) -> DataFrame:
    """``df`` with ``at``, its 0-based position in ``order`` within ``by`` (columns without nulls), and
    ``total``, the number of rows there.  Rows that tie in ``by`` and ``order`` are numbered arbitrarily.

    ``df`` is written first, as a range shuffle reads its input twice.  The shuffle sorts the rows (a salt lets
    equal rows spread over several ranges), they are written with their partition and row number, and the counts of earlier partitions shift these into positions.
    The counts have one row per partition and group."""
    salt = F.monotonically_increasing_id()
    d = stored(df, name).withColumn("_salt", salt).repartitionByRange(*by, *order, "_salt").sortWithinPartitions(*by, *order)
    d = stored(d.drop("_salt").withColumns({"_part": F.spark_partition_id(),
                                            "_row": F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW))}), name)
    sums = d.groupBy("_part", *by).agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    group = W.partitionBy(*by)
    earlier = F.sum("_n").over(group.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    sums = sums.select("_part", *by, (F.coalesce(earlier, F.lit(0)) - F.col("_first")).alias("_shift"),
                       F.sum("_n").over(group).alias("total"))
    return (d.join(sums if by else F.broadcast(sums), ["_part", *by])  # without groups one row per partition
            .withColumn("at", F.col("_row") + F.col("_shift")).drop("_part", "_row", "_shift"))
