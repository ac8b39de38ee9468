"""Running (cumulative) sums in a global order without a single-partition window
(see ``plans.rowindex`` for how the order is dealt out)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carecheck.plans.rowindex import plain, ranges, sums_before


def add_running_sums(d: DataFrame, measures: dict[str, Column], prefix: str = "cum_") -> DataFrame:
    """Add ``{prefix}{name}`` = inclusive running sum of each measure (double) to a ``ranges`` table."""
    values = {name: F.coalesce(m.cast("double"), F.lit(0.0)) for name, m in measures.items()}
    out = sums_before(d, {f"{prefix}{name}": v for name, v in values.items()})
    return out.withColumns({f"{prefix}{name}": F.col(f"{prefix}{name}") + v for name, v in values.items()})


def running_sums(df: DataFrame, order_by: list[str], measures: dict[str, Column],
                 num_partitions: int | None = None, prefix: str = "cum_") -> DataFrame:
    return plain(add_running_sums(ranges(df, order_by, num_partitions), measures, prefix))
