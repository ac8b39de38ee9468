"""Input preparation P1-P3 (the clean-up applied to real data before validation)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carecheck.functions import exprs as E
from carecheck.operators.rules import parse_timestamp


def select_existing(df: DataFrame, wanted: list[str]) -> DataFrame:
    """Keep those of ``wanted`` that exist, in the wanted order."""
    have = set(df.columns)
    return df.select(*[E.quote(c) for c in wanted if c in have])


def head(df: DataFrame, n: int, order_by: list[str] | None = None) -> DataFrame:
    """The first ``n`` rows (by ``order_by`` when given: a distributed top-n)."""
    return (df.orderBy(*order_by) if order_by else df).limit(n)


def coerce_and_fill(df: DataFrame, date_column: str | None = "date", formats: list[str] | None = None) -> DataFrame:
    """Parse ``date_column`` (unparseable -> NULL), then fill NULLs of every
    other column with 0 ('0' for text columns, false for booleans); NaN counts
    as missing."""
    types = {f.name: f.dataType for f in df.schema.fields}
    out = {}
    for c, dt in types.items():
        col = F.col(E.quote(c))
        if c == date_column:
            out[c] = parse_timestamp(c, dt, formats)
        elif E.is_numeric(dt):
            out[c] = F.coalesce(E.clean(c, dt), F.lit(0).cast(dt))
        elif E.is_string(dt):
            out[c] = F.coalesce(col, F.lit("0"))
        elif str(dt) == "BooleanType()":
            out[c] = F.coalesce(col, F.lit(False))
        else:
            out[c] = col
    return df.withColumns(out)
