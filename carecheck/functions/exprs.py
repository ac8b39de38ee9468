"""Column-expression helpers shared by all operators.

Everything here returns a ``pyspark.sql.Column`` built from built-in
functions, so it stays inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carecheck.functions import patterns as P

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
            T.DoubleType, T.DecimalType)
_FLOATING = (T.FloatType, T.DoubleType)


def rx(pattern: str) -> str:
    """Java regex with Python-like line handling (only ``\\n`` ends a line)."""
    return "(?d)" + pattern


def rx_match(pattern: str) -> str:
    """Regex for Python ``re.match`` semantics: anchored at the start only."""
    return "(?d)^(?:" + pattern + ")"


# Literals at least one of which must occur for a pattern to match.  A cheap
# ``instr`` test in front of the regex skips most rows of long free text; the
# result is unchanged.  (Our own optimisation; patterns without an entry run
# the regex directly.)
REQUIRED_LITERALS: dict[str, list[str]] = {
    P.PHI_VALUE_PATTERNS["ssn"]: ["-"],
    P.PHI_VALUE_PATTERNS["email"]: ["@"],
    P.PHI_VALUE_PATTERNS["phone"]: ["-"],
    P.PHI_VALUE_PATTERNS["date"]: ["-"],
    P.HIPAA_SSN: ["-"],
    P.HIPAA_EMAIL: ["@"],
    P.HIPAA_PHONE: ["("],
    P.GDPR_SENSITIVE: ["race", "ethnicity", "religion", "health", "biometric", "genetic", "sexuality"],
    P.HIPAA_PHI_PATTERNS["email"]: ["@"],
    P.HIPAA_PHI_PATTERNS["date"]: ["/", "-"],
    P.HIPAA_PHI_PATTERNS["medical_record"]: ["MRN", "Medical"],
    P.HIPAA_PHI_PATTERNS["account_number"]: ["Account", "Acct"],
    P.HIPAA_PHI_PATTERNS["insurance_id"]: ["Insurance", "Policy"],
    P.HIPAA_PHI_PATTERNS["license_number"]: ["Lic"],
    P.HIPAA_PHI_PATTERNS["vehicle_id"]: ["VIN", "Vehicle"],
    P.HIPAA_PHI_PATTERNS["device_id"]: ["Device", "Serial"],
    P.HIPAA_PHI_PATTERNS["ip_address"]: ["."],
    P.HIPAA_PHI_PATTERNS["url"]: ["http"],
    P.HIPAA_PHI_PATTERNS["biometric"]: ["Fingerprint", "Retina", "Iris", "Voice"],
}


def search(c: Column, pattern: str) -> Column:
    """True when ``pattern`` occurs anywhere; NULL input gives NULL."""
    lits = REQUIRED_LITERALS.get(pattern)
    if not lits:
        return c.rlike(rx(pattern))
    guard = None
    for lit in lits:
        g = F.instr(c, lit) > 0
        guard = g if guard is None else (guard | g)
    # NULL stays NULL; a row without any required literal cannot match
    return F.when(c.isNull(), F.lit(None).cast("boolean")).when(~guard, F.lit(False)).otherwise(c.rlike(rx(pattern)))


def match(c: Column, pattern: str) -> Column:
    return c.rlike(rx_match(pattern))


def is_numeric(dt: T.DataType) -> bool:
    return isinstance(dt, _NUMERIC)


def is_floating(dt: T.DataType) -> bool:
    return isinstance(dt, _FLOATING)


def is_temporal(dt: T.DataType) -> bool:
    return isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType))


def is_string(dt: T.DataType) -> bool:
    return isinstance(dt, (T.StringType, T.VarcharType, T.CharType))


def clean(name: str, dt: T.DataType) -> Column:
    """Column with NaN normalised to NULL (pandas treats NaN as missing)."""
    c = F.col(quote(name))
    if is_floating(dt):
        return F.nanvl(c, F.lit(None).cast(dt))
    return c


def is_missing(name: str, dt: T.DataType) -> Column:
    c = F.col(quote(name))
    if is_floating(dt):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def as_text(name: str, dt: T.DataType) -> Column:
    """String view of a value used by regex checks (NULL stays NULL)."""
    c = clean(name, dt)
    if is_string(dt):
        return c
    return c.cast("string")


def quote(name: str) -> str:
    """Backtick-quote a column name for ``F.col``."""
    return "`" + name.replace("`", "``") + "`"


def pandas_dtype(dt: T.DataType) -> str:
    """Name pandas would give a column of this Spark type."""
    if isinstance(dt, T.LongType):
        return "int64"
    if isinstance(dt, T.IntegerType):
        return "int32"
    if isinstance(dt, T.ShortType):
        return "int16"
    if isinstance(dt, T.ByteType):
        return "int8"
    if isinstance(dt, T.DoubleType):
        return "float64"
    if isinstance(dt, T.FloatType):
        return "float32"
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return "datetime64[ns]"
    if isinstance(dt, T.DateType):
        return "date"
    if isinstance(dt, T.BooleanType):
        return "bool"
    return "object"


def widened_dtype(dt: T.DataType) -> str:
    """Pandas dtype after widening narrow ints/floats/dates (non-strict mode)."""
    if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int64"
    if isinstance(dt, _FLOATING):
        return "float64"
    if is_temporal(dt):
        return "datetime64[ns]"
    return pandas_dtype(dt)


def type_compatible(actual: str, expected: str) -> bool:
    return expected.lower() in P.TYPE_COMPATIBILITY.get(actual, [])


def risk_level(score: Column) -> Column:
    out = None
    for threshold, level in P.RISK_LEVELS:
        cond = score >= F.lit(threshold)
        out = F.when(cond, level) if out is None else out.when(cond, level)
    return out.otherwise("critical")


def threshold_level(value: Column, thresholds: list[tuple[float, str]],
                    below: str = "critical") -> Column:
    out = None
    for threshold, level in thresholds:
        cond = value >= F.lit(threshold)
        out = F.when(cond, level) if out is None else out.when(cond, level)
    return out.otherwise(below)


def py_list_repr(arr: Column) -> Column:
    """Render an array<string> like Python's ``repr(list)``: ['a', 'b']."""
    quoted = F.transform(arr, lambda x: F.concat(F.lit("'"), x, F.lit("'")))
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))


def fmt_number(x: float | int | None) -> str:
    """Python ``str()`` of a bound given by the user (used in messages)."""
    return str(x)
