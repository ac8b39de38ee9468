"""Validation rules V1-V11.

A rule turns a DataFrame into *fused checks* (aggregate expressions that the
orchestrator runs in one scan) plus, where an aggregate cannot express it,
*issue frames* (lazy DataFrames of issue rows: catalog joins, the duplicate
``groupBy``).  Rules never collect data.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carecheck.functions import exprs as E
from carecheck.functions import patterns as P
from carecheck.plans.aggplan import ISSUE_COLUMNS, ISSUE_SCHEMA, Check, no_cell



@dataclass
class RulePlan:
    checks: list[Check] = field(default_factory=list)
    frames: list[DataFrame] = field(default_factory=list)
    rows: list[tuple] = field(default_factory=list)  # plan-time issue rows (schema facts)


def _schema_row(check_id: str, rule: str, severity: str, column: str | None, message: str) -> tuple:
    return (check_id, rule, severity, column, "schema", None, None, message, None)


class Rule:
    name = "Rule"
    description = ""
    severity = "error"

    def plan(self, df: DataFrame) -> RulePlan:  # pragma: no cover - interface
        raise NotImplementedError


# --------------------------------------------------------------------------
# V1, V2
# --------------------------------------------------------------------------
class SchemaValidator(Rule):
    name = "SchemaValidator"
    description = "Validates data schema and column types"

    def __init__(self, required_columns=None, column_types=None, strict_types=False,
                 name: str | None = None):
        self.required_columns = list(required_columns or [])
        self.column_types = dict(column_types or {})
        self.strict_types = strict_types
        if name:
            self.name = name

    def plan(self, df: DataFrame) -> RulePlan:
        """Schema facts are known at plan time: no job is needed.  (The same
        checks over many tables run as catalog joins, see ``plans.catalog``.)"""
        types = {f.name: f.dataType for f in df.schema.fields}
        rows = [_schema_row(f"required:{c}", self.name, "error", c, f"Required column '{c}' is missing")
                for c in self.required_columns if c not in types]
        for c, expected in self.column_types.items():
            if c not in types:
                continue
            actual = E.pandas_dtype(types[c])
            match_on = actual if self.strict_types else E.widened_dtype(types[c])
            if not E.type_compatible(match_on, expected):
                rows.append(_schema_row(f"type:{c}", self.name, "error", c,
                                        f"Column '{c}' has type '{actual}' but expected '{expected}'"))
        return RulePlan(rows=rows)


# --------------------------------------------------------------------------
# V3, V4
# --------------------------------------------------------------------------
class PHIDetector(Rule):
    name = "PHIDetector"
    description = "Detects potential PHI/PII in the data"

    def __init__(self, patterns: dict[str, str] | None = None, keywords=None):
        self.patterns = dict(patterns or P.PHI_VALUE_PATTERNS)
        self.keywords = list(keywords or P.PHI_NAME_KEYWORDS)

    def plan(self, df: DataFrame) -> RulePlan:
        rows = [_schema_row(f"phi_name:{c}", self.name, "warning", c,
                            f"Column '{c}' may contain PHI/PII based on name")
                for c in df.columns if any(k in c.lower() for k in self.keywords)]
        checks = []
        for f in df.schema.fields:
            if not E.is_string(f.dataType):
                continue
            text = E.as_text(f.name, f.dataType)
            for pname, pat in self.patterns.items():
                label = pname.upper()
                checks.append(Check(
                    check_id=f"phi_value:{f.name}:{pname}", rule_name=self.name,
                    column=f.name, metric=pname,
                    agg=F.count_if(F.coalesce(E.search(text, pat), F.lit(False))),
                    severity="warning",
                    message=(lambda n, rows, label=label, c=f.name: F.format_string(
                        f"Found %d potential {label} values in column '%s'", n, F.lit(c)))))
        return RulePlan(checks=checks, rows=rows)


# --------------------------------------------------------------------------
# V5, V6, V7
# --------------------------------------------------------------------------
def duplicate_count(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rows minus distinct rows over all columns (NULLs and NaNs compare equal),
    per group of ``keys`` (e.g. a batch number).

    Exact, in two steps: rows are first grouped by a 64-bit fingerprint
    (``xxhash64``), which shuffles 8 bytes per row instead of the row; only
    rows whose fingerprint occurs more than once are then grouped by their
    full values, so a hash collision can cost time but never correctness.  Both aggregations are partial-then-final, so a row
    repeated in a third of the table is pre-counted per task and never lands
    as a whole group in one task.
    """
    keys = keys or []
    types = {f.name: f.dataType for f in df.schema.fields}
    data = [c for c in df.columns if c not in keys]
    # NaN counts as missing (equal to NULL, as in pandas); -0.0 + 0.0 == 0.0 so
    # equal values hash equally
    norm = {c: (E.clean(c, types[c]) + F.lit(0.0).cast(types[c])) if E.is_floating(types[c])
            else F.col(E.quote(c)) for c in data}
    cols = [norm[c].alias(c) for c in data]
    fp = df.select(*keys, *cols).select(*keys, *[F.col(E.quote(c)) for c in data],
                                         F.xxhash64(*[F.col(E.quote(c)) for c in data]).alias("__h1"))
    cols = [F.col(E.quote(c)) for c in data]
    cand = (fp.groupBy(*keys, "__h1").agg(F.count(F.lit(1)).alias("__n"))
            .where(F.col("__n") > 1).select(*keys, "__h1"))
    rows = fp.join(cand, [*keys, "__h1"], "left_semi")
    grouped = rows.groupBy(*keys, *cols).agg(F.count(F.lit(1)).alias("__n"))
    out = grouped.groupBy(*keys).agg(F.sum(F.col("__n") - 1).alias("n_duplicates"))
    if keys:
        return out
    # a global aggregate over zero candidate rows yields one row with NULL
    return out.select(F.coalesce("n_duplicates", F.lit(0)).cast("long").alias("n_duplicates"))


class DataQualityChecker(Rule):
    name = "DataQualityChecker"
    description = "Performs general data quality checks"

    def __init__(self, missing: bool = True, duplicates: bool | str = True, empty: bool = True):
        """``duplicates``: True / "exact" (default, one fingerprint shuffle),
        "approx" (HyperLogLog estimate inside the fused scan, no shuffle; the
        issue message says it is an estimate) or False."""
        self.missing, self.duplicates, self.empty = missing, duplicates, empty

    def approx_duplicate_check(self, df: DataFrame) -> Check:
        types = {f.name: f.dataType for f in df.schema.fields}
        cols = [(E.clean(c, types[c]) + F.lit(0.0).cast(types[c])) if E.is_floating(types[c])
                else F.col(E.quote(c)) for c in df.columns]
        est = F.count(F.lit(1)) - F.approx_count_distinct(F.xxhash64(*cols), 0.01)
        return Check(check_id="duplicates", rule_name=self.name, column=None, metric="duplicates_estimate",
                     agg=F.greatest(est, F.lit(0)), severity="warning",
                     message=lambda n, rows: F.format_string("Found about %d duplicate rows (estimate)", n))

    def missing_checks(self, df: DataFrame) -> list[Check]:
        out = []
        for f in df.schema.fields:
            miss = F.count_if(E.is_missing(f.name, f.dataType))
            if self.missing:
                out.append(Check(
                    check_id=f"missing:{f.name}", rule_name=self.name, column=f.name,
                    metric="missing", agg=miss,
                    severity=lambda n, rows: F.when(F.try_divide(n * 100.0, rows) > 50, "error").otherwise("warning"),
                    message=lambda n, rows, c=f.name: F.format_string(
                        "Column '%s' has %d missing values (%.1f%%)", F.lit(c), n, F.try_divide(n * 100.0, rows))))
            if self.empty:
                out.append(Check(
                    check_id=f"empty:{f.name}", rule_name=self.name, column=f.name,
                    metric="empty", agg=miss, severity="error",
                    message=f"Column '{f.name}' is completely empty",
                    emit=lambda n, rows: n == rows))
        return out

    def duplicate_frame(self, df: DataFrame) -> DataFrame:
        d = duplicate_count(df)
        return d.where("n_duplicates > 0").select(
            F.lit("duplicates").alias("check_id"), F.lit(self.name).alias("rule_name"),
            F.lit("warning").alias("severity"), F.lit(None).cast("string").alias("column_name"),
            F.lit("duplicates").alias("metric"), F.col("n_duplicates").cast("long").alias("n_affected"),
            F.lit(None).cast("long").alias("n_rows"),
            F.format_string("Found %d duplicate rows", "n_duplicates").alias("message"),
            *no_cell())

    def plan(self, df: DataFrame) -> RulePlan:
        checks = self.missing_checks(df)
        if self.duplicates == "approx":
            return RulePlan(checks=checks + [self.approx_duplicate_check(df)])
        frames = [self.duplicate_frame(df)] if self.duplicates else []
        return RulePlan(checks=checks, frames=frames)


# --------------------------------------------------------------------------
# V8
# --------------------------------------------------------------------------
class MedicalCodeValidator(Rule):
    name = "MedicalCodeValidator"
    description = "Validates medical codes"

    def __init__(self, code_columns: dict[str, str] | None = None, patterns=None,
                 order_by: list[str] | None = None):
        self.code_columns = dict(code_columns or {})
        self.patterns = dict(patterns or P.CODE_PATTERNS)
        self.order_by = tuple(order_by or ())

    def plan(self, df: DataFrame) -> RulePlan:
        types = {f.name: f.dataType for f in df.schema.fields}
        checks = []
        for col, code_type in self.code_columns.items():
            if col not in types or code_type not in self.patterns:
                continue  # absent column / unknown code type: skipped silently
            text = E.as_text(col, types[col])
            bad = text.isNotNull() & ~E.match(text, self.patterns[code_type])
            checks.append(Check(
                check_id=f"code:{col}:{code_type}", rule_name=self.name, column=None,
                metric=code_type, agg=F.count_if(bad), severity="warning",
                message=(lambda n, rows, t=code_type.upper(): F.format_string(
                    f"Found %d invalid {t} codes in column. Sample: ", n)),
                sample=text, sample_when=bad, sample_order=self.order_by))
        return RulePlan(checks=checks)


# --------------------------------------------------------------------------
# V9
# --------------------------------------------------------------------------
class RangeValidator(Rule):
    name = "RangeValidator"
    description = "Validates numeric values within expected ranges"

    def __init__(self, ranges: dict[str, dict] | None = None):
        self.ranges = dict(ranges or {})

    def plan(self, df: DataFrame) -> RulePlan:
        types = {f.name: f.dataType for f in df.schema.fields}
        checks = []
        for col, cfg in self.ranges.items():
            if col not in types or not E.is_numeric(types[col]):
                continue
            c = E.clean(col, types[col])
            lo, hi = cfg.get("min"), cfg.get("max")
            if lo is not None:
                checks.append(Check(
                    check_id=f"range_min:{col}", rule_name=self.name, column=col, metric="below_min",
                    agg=F.count_if(c < F.lit(lo)), severity="warning",
                    message=lambda n, rows, col=col, lo=lo: F.format_string(
                        f"Column '%s' has %d values below minimum {E.fmt_number(lo)}", F.lit(col), n)))
            if hi is not None:
                checks.append(Check(
                    check_id=f"range_max:{col}", rule_name=self.name, column=col, metric="above_max",
                    agg=F.count_if(c > F.lit(hi)), severity="warning",
                    message=lambda n, rows, col=col, hi=hi: F.format_string(
                        f"Column '%s' has %d values above maximum {E.fmt_number(hi)}", F.lit(col), n)))
        return RulePlan(checks=checks)


# --------------------------------------------------------------------------
# V10
# --------------------------------------------------------------------------
DEFAULT_DATE_FORMATS = [
    "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy/MM/dd",
    "MM/dd/yyyy", "MM-dd-yyyy", "yyyyMMdd",
]


def parse_timestamp(name: str, dt, formats: list[str] | None = None) -> Column:
    """Value as TIMESTAMP, NULL when it does not parse (never raises)."""
    c = F.col(E.quote(name))
    if E.is_temporal(dt):
        return c.cast("timestamp")
    if E.is_numeric(dt):
        return F.timestamp_micros((E.clean(name, dt) / 1000).try_cast("long"))  # beyond the range of times: NULL
    if isinstance(dt, (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.BooleanType)):
        raise TypeError(f"{dt.simpleString()} is not convertible to a date")
    text = c.cast("string")
    fmts = formats or DEFAULT_DATE_FORMATS
    tries = [F.try_to_timestamp(text, F.lit(f)) for f in fmts]
    if formats is None:
        tries.append(F.try_to_timestamp(text))
    return F.coalesce(*tries).cast("timestamp")


class DateValidator(Rule):
    name = "DateValidator"
    description = "Validates date fields and their ranges"

    def __init__(self, date_columns=None, min_date: str | None = None, max_date: str | None = None,
                 formats: list[str] | None = None):
        self.date_columns = list(date_columns or [])
        self.min_date, self.max_date, self.formats = min_date, max_date, formats

    def plan(self, df: DataFrame) -> RulePlan:
        """A column whose checks cannot be planned or whose format is no format becomes an ``error`` of its
        own (V10d); the other columns proceed in the same scan.  While it runs no check can fail: values go
        through ``try_`` functions and count as invalid where they do not parse."""
        types = {f.name: f.dataType for f in df.schema.fields}
        out = RulePlan()
        for col in self.date_columns:
            if col not in types:
                continue
            try:
                ts = parse_timestamp(col, types[col], self.formats)
                own = self._column_checks(col, ts)
                df.select(*[c.agg for c in own])  # analysis, no job
                self._bounds_and_formats(df)
                out.checks += own
            except Exception as e:  # noqa: BLE001 - whatever is wrong with this column
                text = str(e).splitlines()[0] if str(e) else repr(e)
                out.rows.append((f"date_failed:{col}", self.name, "error", col, "failure", None, None,
                                 f"Failed to validate dates in column '{col}': {text}", None))
        return out

    def _bounds_and_formats(self, df: DataFrame) -> None:
        """Raises where a bound is no time or a format cannot be used: constants, evaluated without a job."""
        probes = [F.to_timestamp(F.lit(x)) for x in (self.min_date, self.max_date) if x]
        probes += [F.try_to_timestamp(F.lit("2000-01-01"), F.lit(f)) for f in self.formats or []]
        if probes:
            df.sparkSession.sql("SELECT 1").select(*probes).collect()

    def _column_checks(self, col: str, ts: Column) -> list[Check]:
        raw = F.col(E.quote(col))
        checks = [Check(
            check_id=f"date_invalid:{col}", rule_name=self.name, column=col, metric="invalid_date",
            agg=F.count_if(raw.isNotNull() & ts.isNull()), severity="error",
            message=lambda n, rows: F.format_string("Column '%s' has %d invalid date values", F.lit(col), n))]
        for bound, name, word, op in ((self.min_date, "min", "before", lambda a, b: a < b), (self.max_date, "max", "after", lambda a, b: a > b)):
            if bound:
                day = bound[:10]
                checks.append(Check(
                    check_id=f"date_{name}:{col}", rule_name=self.name, column=col, metric=f"{word}_{name}",
                    agg=F.count_if(op(ts, F.to_timestamp(F.lit(bound)))), severity="warning",
                    message=lambda n, rows, word=word, day=day: F.format_string(
                        f"Column '%s' has %d dates {word} {day}", F.lit(col), n)))
        return checks


# --------------------------------------------------------------------------
# V11
# --------------------------------------------------------------------------
class RowCheck(Rule):
    """User rule as a row predicate: rows where ``condition`` holds are issues."""

    def __init__(self, name: str, condition: Column | str, severity: str = "error",
                 message: str | None = None, column: str | None = None):
        self.name = name
        self.condition = F.expr(condition) if isinstance(condition, str) else condition
        self.severity = severity
        self.message = message or f"Custom check '{name}' failed for %d rows"
        self.column = column

    def plan(self, df: DataFrame) -> RulePlan:
        msg = self.message
        return RulePlan(checks=[Check(
            check_id=f"custom:{self.name}", rule_name=self.name, column=self.column,
            metric="custom", agg=F.count_if(F.coalesce(self.condition, F.lit(False))),
            severity=self.severity,
            message=lambda n, rows: F.format_string(msg, n) if "%d" in msg else F.lit(msg))])


class CustomValidator(Rule):
    """User rule as a function ``DataFrame -> issues DataFrame``.

    The function may return any DataFrame with a subset of the issue columns;
    missing columns are filled with NULL (``rule_name`` with the rule's name).

    Batch validation calls ``by_batch`` once with all batches if given: a function of the rows with their
    ``batch_num`` that returns issues with it.  Otherwise ``fn`` sees one batch after the other.
    """

    def __init__(self, fn: Callable[[DataFrame], DataFrame], name: str = "CustomValidator",
                 description: str = "", severity: str = "error",
                 by_batch: Callable[[DataFrame], DataFrame] | None = None):
        self.fn, self.name, self.description, self.severity = fn, name, description, severity
        self.by_batch = by_batch

    def plan(self, df: DataFrame) -> RulePlan:
        out = self.fn(df)
        if out is None:
            return RulePlan()
        return RulePlan(frames=[conform_issues(out, self.name, self.severity)])


def conform_issues(df: DataFrame, rule_name: str, severity: str = "error", keep: tuple[str, ...] = ()) -> DataFrame:
    defaults = {"check_id": F.lit(f"custom:{rule_name}"), "rule_name": F.lit(rule_name), "severity": F.lit(severity),
                "metric": F.lit("custom"), "message": F.lit("")}
    sel = [F.col(c) for c in keep]
    for c in ISSUE_COLUMNS:
        have = F.col(E.quote(c)) if c in df.columns else defaults.get(c, F.lit(None))
        sel.append(have.cast(ISSUE_SCHEMA[c].dataType).alias(c))
    return df.select(*sel)
