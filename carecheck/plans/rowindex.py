"""Positions, running sums and earlier rows in a user-given order, without a global window.

The reference numbers rows by position; Spark has no implicit order, so every
position-based operator takes ``order_by``; a hash of the row breaks ties.

1. ``ranges``: Spark range-partitions the rows by the order, the hash and a
   salt, so that a row or key that makes up a third of the table is cut like
   any other; they are sorted and written to the shared folder with their
   partition's number and their row number in it.  That is the only time the
   payload moves, and the written table fixes the partitioning for all later
   steps and recomputed tasks.
2. Counts or sums of the partitions (one row per partition and group) give the
   offsets: ``positions`` adds them to the row numbers, ``sums_before`` to a
   running sum inside the partition.
3. ``earlier_rows``: ``lag`` inside a partition, and for its first rows a halo
   of the last rows of earlier partitions; ``filled`` carries the last value over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carecheck.session import shared_table

TIE, PART, ROW = "__tie_h", "__p", "__r"
_IN_PARTITION = (1 << 33) - 1  # the bits of monotonically_increasing_id that count within a partition


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _cols(names) -> list[Column]:
    return [F.col(_q(c)) for c in names]


def _partitions(df: DataFrame, n: int | None) -> int:
    return n or max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


def _hashable(t: T.DataType) -> bool:
    """Can Spark hash values of this type?"""
    if isinstance(t, T.StructType):
        return all(_hashable(f.dataType) for f in t.fields)
    if isinstance(t, T.ArrayType):
        return _hashable(t.elementType)
    return not isinstance(t, (T.MapType, T.VariantType))


def row_hash(df: DataFrame) -> Column:
    """A 64-bit hash of the row; columns that Spark cannot hash (maps) enter as JSON."""
    parts = [F.col(_q(f.name)) if _hashable(f.dataType) else F.to_json(F.struct(F.col(_q(f.name)))) for f in df.schema.fields]
    return F.xxhash64(*parts) if parts else F.lit(0).cast("long")


def ranges(df: DataFrame, keys: list[str], num_partitions: int | None = None) -> DataFrame:
    """``df`` as a written table with ``TIE``, ``PART`` and ``ROW``: ordering by (PART, ROW) orders by
    ``keys`` and the hash."""
    tied = df.withColumn(TIE, row_hash(df)).withColumn("__salt", F.monotonically_increasing_id())
    dealt = tied.repartitionByRange(_partitions(df, num_partitions), *_cols(keys), F.col(TIE), F.col("__salt")).drop("__salt")
    here = F.monotonically_increasing_id().bitwiseAND(F.lit(_IN_PARTITION))
    return shared_table(dealt.sortWithinPartitions(*_cols(keys), F.col(TIE)).withColumns({PART: F.spark_partition_id(), ROW: here}), "ranges")


def _joined(d: DataFrame, per_part: DataFrame, group: str | None) -> DataFrame:
    """``d`` with the columns of ``per_part(PART, group, ...)``; without a group that is one row per partition."""
    if group is None:
        return d.join(F.broadcast(per_part), PART)
    p = per_part.withColumnRenamed(PART, "__op").withColumnRenamed(group, "__og")
    on = (F.col(PART) == F.col("__op")) & F.col(_q(group)).eqNullSafe(F.col("__og"))
    return d.join(p, on).drop("__op", "__og")


def _offsets(d: DataFrame, sums: dict[str, Column], group: str | None) -> DataFrame:
    """Per partition (and group) each sum over all earlier partitions, and ``__first``, its first row number."""
    by = _cols([group] if group else [])
    part = d.groupBy(PART, *by).agg(F.min(ROW).alias("__first"), *[F.sum(e).alias(n) for n, e in sums.items()])
    upto = Window.partitionBy(*by).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    return part.select(PART, *by, "__first", *[F.coalesce(F.sum(n).over(upto), F.lit(0)).alias(n) for n in sums])


def positions(d: DataFrame, name: str, group: str | None = None) -> DataFrame:
    """The 0-based position of each row of a ``ranges`` table (within ``group``, the first of its keys)."""
    out = _joined(d, _offsets(d, {"__n": F.lit(1)}, group), group)
    return out.withColumn(name, F.col(ROW) - F.col("__first") + F.col("__n")).drop("__first", "__n")


def sums_before(d: DataFrame, sums: dict[str, Column], group: str | None = None) -> DataFrame:
    """Adds each name of ``sums``: the sum of its expression over all earlier rows (within ``group``)."""
    names = {n: f"__o{i}" for i, n in enumerate(sums)}
    here = Window.partitionBy(PART, *_cols([group] if group else [])).orderBy(ROW).rowsBetween(Window.unboundedPreceding, -1)
    out = _joined(d, _offsets(d, {names[n]: e for n, e in sums.items()}, group), group)
    return (out.withColumns({n: F.coalesce(F.sum(e).over(here), F.lit(0)) + F.col(names[n]) for n, e in sums.items()})
            .drop("__first", *names.values()))


def earlier_rows(d: DataFrame, values: list[str], back: int, group: str | None = None) -> DataFrame:
    """Adds ``prev1`` .. ``prev<back>``: the struct of ``values`` of the row so many rows earlier (within
    ``group``), null where there is none.

    The last ``back`` rows that each partition has of a group are its edge (``back`` rows per partition and
    group); a window over the edges gives every partition the rows that precede it."""
    by = _cols([group] if group else [])
    ends = d.groupBy(PART, *by).agg(F.min(ROW).alias("__first"), F.max(ROW).alias("__last"))
    v = F.struct(*_cols(values))
    edge = (_joined(d.select(PART, ROW, *by, v.alias("__v")), ends, group).where(F.col(ROW) > F.col("__last") - back))
    along = Window.partitionBy(*by).orderBy(PART, ROW)
    halo = (edge.withColumns({f"__h{k}": F.lag("__v", k).over(along) for k in range(1, back + 1)})
            .where(F.col(ROW) == F.greatest(F.col("__first"), F.col("__last") - (back - 1)))
            .select(PART, *by, "__first", *[f"__h{k}" for k in range(1, back + 1)]))
    out = _joined(d, halo, group)
    at, inside = F.col(ROW) - F.col("__first"), Window.partitionBy(PART, *by).orderBy(ROW)
    prev = {}
    for k in range(1, back + 1):
        c = F.lag(v, k).over(inside)
        for i in range(k):
            c = F.when(at == i, F.col(f"__h{k - i}")).otherwise(c)
        prev[f"prev{k}"] = c
    return out.withColumns(prev).drop("__first", *[f"__h{k}" for k in range(1, back + 1)])


def filled(d: DataFrame, value: Column, name: str) -> DataFrame:
    """Adds ``name``: the last value that is not null at or before each row."""
    d = d.withColumn("__v", value)
    part = d.where("__v is not null").groupBy(PART).agg(F.max_by("__v", ROW).alias("__end"))
    part = d.select(PART).distinct().join(F.broadcast(part), PART, "left")  # one row per partition
    upto = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    carry = part.select(PART, F.last("__end", ignorenulls=True).over(upto).alias("__carry"))
    here = Window.partitionBy(PART).orderBy(ROW).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (d.join(F.broadcast(carry), PART).withColumn(name, F.coalesce(F.last("__v", ignorenulls=True).over(here), F.col("__carry")))
            .drop("__v", "__carry"))


def plain(d: DataFrame) -> DataFrame:
    """Without the columns that ``ranges`` added."""
    return d.drop(TIE, PART, ROW)


def with_row_index(df: DataFrame, order_by: list[str], name: str = "row_index",
                   num_partitions: int | None = None) -> DataFrame:
    """``df`` with the 0-based position of each row in the given order."""
    return plain(positions(ranges(df, order_by, num_partitions), name))


def rank_in_group(df: DataFrame, group: str, order: list[str], name: str = "__x",
                  num_partitions: int | None = None) -> DataFrame:
    """0-based position of each row within ``group`` by ``order``; a group of any size spreads over many
    partitions.  A null group is a group too."""
    return plain(positions(ranges(df, [group, *order], num_partitions), name, group))
