r"""Registered queries: one per operator of the inventory, each reading the
test tables (whole tables, whole texts) and running the library operators,
plus the equivalent DuckDB SQL used as an independent oracle.

Derived inputs (nulls, codes, contact strings, ...) are deterministic
functions of the table rows written as SQL expression text accepted by both
Spark ``selectExpr`` and DuckDB, so the same rows feed both sides.  They only
add columns; no query filters, samples or caps the tables.

Oracle conventions:

* Java's ``\b`` treats Unicode letters/digits as word characters, DuckDB's RE2
  does not; the oracle spells boundaries as ``(?:^|[^\p{L}\p{Nd}\p{Mn}_])`` ...
  ``(?:[^\p{L}\p{Nd}\p{Mn}_]|$)`` (``wb``), which is exact for existence checks.
* Doubles are rounded to 6 places on both sides; counts are BIGINT on both
  sides (``bigint_counts`` casts DuckDB's HUGEINT ``count_if``).
* Timestamps are compared as formatted text; floor is explicit where a double
  becomes an integer (DuckDB's cast rounds, Spark's truncates).
* Messages with a ``%.1f`` percentage are only compared where no exact tie
  can occur (Java rounds half-up, C/Python half-even).
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carecheck.functions import patterns as P
from carecheck.operators import analytics as A
from carecheck.operators import compliance as C
from carecheck.operators import monitor as M
from carecheck.operators import phi as H
from carecheck.operators import rules as R
from carecheck.operators import validate as V
from carecheck.plans import catalog as K
from carecheck.sources import io as S

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

AS_OF = "2024-02-01 00:00:00"
SALT = "salt"
ROUND = 6


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _derive(spark, d, table, exprs: list[str]) -> DataFrame:
    return _t(spark, d, table).selectExpr(*exprs)


def _sql_derive(table: str, exprs: list[str]) -> str:
    return f"(SELECT {', '.join(exprs)} FROM {table})"


def _r(c):
    return F.round(c, ROUND)


# ==========================================================================
# Shared derivations (valid Spark SQL and DuckDB SQL)
# ==========================================================================
EVENTS_NULLS = [
    "event_id", "ts", "user_id",
    "NULLIF(event_type, 'error') AS event_type",
    "CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END AS value",
    "props",
    "CAST(NULL AS STRING) AS note",
]

CUSTOMER_PII = [
    "c_custkey", "c_name",
    "CASE WHEN c_custkey % 5 = 0 THEN 'unknown' "
    "ELSE printf('%03d-%02d-%04d', c_custkey % 900 + 100, c_nationkey + 10, c_custkey % 10000) END AS ssn",
    "printf('%03d-%03d-%04d', 200 + c_custkey % 800, c_nationkey * 7 % 1000, c_custkey % 10000) AS phone",
    "lpad(CAST(c_custkey * 37 % 100000 AS STRING), 5, '0') AS zip",
    "c_mktsegment",
]

CODES = [
    "p_partkey",
    "CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 7 = 0 THEN 'INVALID' || CAST(p_size AS STRING) "
    "ELSE chr(65 + CAST(p_partkey % 26 AS INTEGER)) || lpad(CAST(p_size AS STRING), 2, '0') || "
    "CASE WHEN p_partkey % 3 = 0 THEN '.' || CAST(p_partkey % 10 AS STRING) ELSE '' END END AS diagnosis",
    "CASE WHEN p_partkey % 13 = 0 THEN 'X' || CAST(p_size AS STRING) "
    "ELSE lpad(CAST(p_size * 7 % 1000 AS STRING), 3, '0') || "
    "CASE WHEN p_partkey % 2 = 0 THEN '.' || CAST(p_partkey % 100 AS STRING) ELSE '' END END AS icd9_code",
    "CAST(p_partkey % 99999 + 1 AS STRING) || '-' || CAST(p_partkey % 10 AS STRING) || "
    "CASE WHEN p_partkey % 17 = 0 THEN 'X' ELSE '' END AS loinc_code",
    "lpad(CAST(p_partkey % 10000 AS STRING), 4, '0') || "
    "CASE WHEN p_partkey % 19 = 0 THEN 'AB' WHEN p_partkey % 5 = 0 THEN 'A' ELSE '' END AS cpt_code",
    "lpad(CAST(p_partkey % 10000 AS STRING), 4, '0') || '-' || lpad(CAST(p_size * 13 % 10000 AS STRING), 4, '0') "
    "|| '-' || lpad(CAST(p_partkey % 100 AS STRING), 2, '0') || "
    "CASE WHEN p_partkey % 23 = 0 THEN '9' ELSE '' END AS ndc_code",
]
CODE_COLUMNS = {"diagnosis": "icd10", "icd9_code": "icd9", "loinc_code": "loinc", "cpt_code": "cpt",
                "ndc_code": "ndc"}

# Patient-like table derived from part (names, contacts, codes, audit fields).
_W1 = "split_part(p_name, ' ', 1)"
_W2 = "split_part(p_name, ' ', 2)"
PATIENTS = [
    "p_partkey AS patient_key",
    f"upper(left({_W1}, 1)) || substr({_W1}, 2) || ' ' || upper(left({_W2}, 1)) || substr({_W2}, 2) AS patient_name",
    "CASE WHEN p_partkey % 4 = 0 THEN printf('%03d-%02d-%04d', p_partkey % 900 + 100, p_size, p_partkey % 10000) "
    "ELSE 'n/a' END AS ssn",
    "CASE WHEN p_partkey % 6 = 0 THEN lower(replace(p_brand, '#', '')) || '.' || CAST(p_partkey AS STRING) "
    "|| '@clinic.example.org' ELSE 'none' END AS email",
    "CASE WHEN p_partkey % 8 = 0 THEN printf('(%03d) %03d-%04d', 200 + p_partkey % 700, p_size * 11 % 1000, "
    "p_partkey % 10000) ELSE '' END AS phone",
    "CASE WHEN p_partkey % 3 = 0 THEN chr(65 + CAST(p_partkey % 26 AS INTEGER)) || lpad(CAST(p_size AS STRING), 2, '0') "
    "ELSE 'E11.9' END AS diagnosis_code",
    "CASE WHEN p_partkey % 9 = 0 THEN 'pending' ELSE CAST(p_partkey % 99999 + 1 AS STRING) || '-' || "
    "CAST(p_partkey % 10 AS STRING) END AS lab_code",
    "CASE WHEN p_partkey % 10 = 0 THEN CAST(p_partkey % 10000 AS STRING) ELSE lpad(CAST(p_partkey % 100000 AS STRING), "
    "5, '0') END AS procedure_code",
    "CASE WHEN p_size % 10 = 0 THEN 'health record' ELSE lower(p_type) END AS race",
    "lower(p_type) || ' ' || CAST(p_size AS STRING) AS username",
    "p_retailprice",
]

ORDERS_TEMPLATE = [
    "o_orderkey",
    "'AB' || lpad(CAST(o_orderkey % 1000000 AS STRING), 6, '0') AS subject_id",
    "CASE WHEN o_orderkey % 3 = 0 THEN 'bad' ELSE lpad(CAST(o_custkey % 100000000 AS STRING), 8, '0') END AS adverse_event",
    "CAST(o_custkey AS STRING) AS patient_mrn",
    "CAST(o_orderkey % 200 AS STRING) AS bp",
    "CAST(o_orderkey % 500 AS STRING) || ' mg' AS dosage",
    "lower(o_orderstatus) || 'x' AS status",
    "CASE WHEN o_orderkey % 2 = 0 THEN 'completed' ELSE 'pending' END AS state",
    "CAST(o_orderkey % 7 AS STRING) AS quality",
    "CASE WHEN o_orderkey % 4 = 0 THEN 'CT' ELSE 'XY' END AS modality",
    "printf('%d.%d.%d.%d.%d.%d', o_orderkey % 10, o_custkey % 10, 1, 2, 3, o_orderkey % 7) AS dicom_uid",
    "'SP' || lpad(CAST(o_orderkey % 1000000 AS STRING), 6, '0') || '-' || lpad(CAST(o_custkey % 1000 AS STRING), 3, '0') AS specimen",
    "CAST(o_totalprice AS STRING) AS result",
    "CASE WHEN o_orderkey % 5 = 0 THEN 'consented' ELSE 'unknown' END AS consent",
    "'R' || lpad(CAST(o_orderkey % 1000000 AS STRING), 6, '0') AS identifier",
    "CAST(1900 + o_orderkey % 200 AS STRING) AS birth_year",
]

# Run log derived from events: one validation run per event.
RUN_LOG_SCALARS = [
    "CAST(event_id AS STRING) AS run_id", "ts",
    "event_type <> 'error' AS is_valid",
    "user_id AS n_rows",
    "CAST(floor(value / 20) AS BIGINT) AS n_issues",
    "value / 100 AS duration_s",
    "event_type AS metric",
    "value / 500 AS metric_value",
    "(event_type = 'error' AND value > 200) AS has_critical",
]


def run_log(spark: SparkSession, d: str) -> DataFrame:
    s = _derive(spark, d, "events", RUN_LOG_SCALARS + ["event_id"])
    viol_t = "array<struct<standard:string,severity:string,field:string,message:string>>"
    crit = F.array(F.struct(F.lit("HIPAA").alias("standard"), F.lit("critical").alias("severity"),
                            F.lit("value").alias("field"), F.lit("SSN pattern detected").alias("message")),
                   F.struct(F.lit("GDPR").alias("standard"), F.lit("high").alias("severity"),
                            F.lit("value").alias("field"), F.lit("Personal data detected").alias("message")))
    return s.select("run_id", "ts", "is_valid", "n_rows", "n_issues", "duration_s",
                    F.create_map("metric", "metric_value").alias("metrics"),
                    F.when(F.col("has_critical"), crit).otherwise(F.array().cast(viol_t)).alias("violations"))


RUN_LOG_SQL = _sql_derive("events", RUN_LOG_SCALARS)

ORDERS_RUNS_SPARK = ["CAST(o_orderkey AS STRING) AS run_id",
                     "timestampadd(SECOND, CAST(o_orderkey % 86400 AS INT), o_orderdate) AS ts"]
ORDERS_RUNS_SQL = ("(SELECT CAST(o_orderkey AS VARCHAR) AS run_id, "
                   "o_orderdate + to_seconds(CAST(o_orderkey % 86400 AS BIGINT)) AS ts FROM orders)")


# ==========================================================================
# SQL helpers for the oracle
# ==========================================================================
_WORD = r"[\p{L}\p{Nd}\p{Mn}_]"
_NONWORD = r"[^\p{L}\p{Nd}\p{Mn}_]"


def wb(inner: str, left: bool = True, right: bool = True) -> str:
    """Java-style ``\\b`` around a pattern that starts/ends with word chars,
    emulated for RE2 (which has an ASCII-only ``\\b``)."""
    return (f"(?:^|{_NONWORD})" if left else "") + f"(?:{inner})" + (f"(?:{_NONWORD}|$)" if right else "")


def sq(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rm(col: str, pat: str) -> str:
    """DuckDB regex search, NULL -> false."""
    return f"coalesce(regexp_matches({col}, {sq(pat)}), false)"


# Oracle versions of the fixed patterns (word boundaries emulated).
ORACLE_PHI_VALUE = {
    "ssn": wb(r"\d{3}-\d{2}-\d{4}"),
    "email": wb(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}", left=False) ,
    "phone": wb(r"\d{3}-\d{3}-\d{4}"),
    "date": wb(r"\d{4}-\d{2}-\d{2}"),
    "zip_code": wb(r"\d{5}(?:-\d{4})?"),
}
# The e-mail local part may start with non-word characters: the leading \b then
# needs a word character right before it, or a word start.  Spell it out.
ORACLE_PHI_VALUE["email"] = (
    rf"(?:(?:^|{_NONWORD})[A-Za-z0-9]|{_WORD}[._%+-])[A-Za-z0-9._%+-]*@[A-Za-z0-9.-]+\.[A-Z|a-z]{{2,}}(?:{_NONWORD}|$)")


def _pandas_type_sql(dt: str) -> str:
    return (f"CASE {dt} WHEN 'BIGINT' THEN 'int64' WHEN 'INTEGER' THEN 'int32' WHEN 'SMALLINT' THEN 'int16' "
            f"WHEN 'TINYINT' THEN 'int8' WHEN 'DOUBLE' THEN 'float64' WHEN 'FLOAT' THEN 'float32' "
            f"WHEN 'TIMESTAMP' THEN 'datetime64[ns]' WHEN 'DATE' THEN 'date' WHEN 'BOOLEAN' THEN 'bool' "
            f"ELSE 'object' END")


def _widened_type_sql(dt: str) -> str:
    return (f"CASE WHEN {dt} IN ('BIGINT','INTEGER','SMALLINT','TINYINT') THEN 'int64' "
            f"WHEN {dt} IN ('DOUBLE','FLOAT') THEN 'float64' WHEN {dt} IN ('TIMESTAMP','DATE') THEN 'datetime64[ns]' "
            f"WHEN {dt} = 'BOOLEAN' THEN 'bool' ELSE 'object' END")


def _kw_sql(col: str, keywords: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({col}), {sq(k)})" for k in keywords) + ")"


COLS_SQL = ("(SELECT table_name, column_name, ordinal_position - 1 AS position, data_type "
            f"FROM information_schema.columns WHERE table_name IN ({', '.join(sq(t) for t in TABLES)}))")


# ==========================================================================
# Query builders (Spark) and oracles (DuckDB)
# ==========================================================================
Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
O: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def deco(fn):
        Q[name] = fn
        if oracle is not None:
            O[name] = oracle
        return fn
    return deco


ISSUE_OUT = ["check_id", "severity", "column_name", "n_affected", "message"]


def bigint_counts(sql: str) -> str:
    """DuckDB's ``count_if`` returns HUGEINT; Spark's counts are BIGINT.  Wrap
    every ``count_if(...)`` (with its OVER clause, if any) in a BIGINT cast."""
    import re as _re
    out, i, key = [], 0, "count_if("
    while True:
        j = sql.find(key, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        depth, k = 0, j + len(key) - 1
        while k < len(sql):
            if sql[k] == "(":
                depth += 1
            elif sql[k] == ")":
                depth -= 1
                if depth == 0:
                    break
            k += 1
        end = k + 1
        m = _re.match(r"\s+OVER\s+(\w+|\([^)]*\))", sql[end:])
        if m:
            end += m.end()
        out.append(sql[i:j])
        out.append("CAST(" + bigint_counts(sql[j + len(key):k]).join(["count_if(", ")"]) + sql[k + 1:end] + " AS BIGINT)")
        i = end


def _issues_out(df: DataFrame) -> DataFrame:
    return df.select(*ISSUE_OUT)


# ---- V3/V4 PHI rule ------------------------------------------------------
def _phi_oracle(table_sql: str, table_name: str, string_cols: list[str], all_cols: list[str]) -> str:
    parts = []
    kws = [c for c in all_cols if any(k in c.lower() for k in P.PHI_NAME_KEYWORDS)]
    for c in kws:
        parts.append(f"SELECT 'phi_name:{c}' AS check_id, 'warning' AS severity, '{c}' AS column_name, "
                     f"CAST(NULL AS BIGINT) AS n_affected, 'Column ''{c}'' may contain PHI/PII based on name' AS message")
    for c in string_cols:
        for pname, pat in ORACLE_PHI_VALUE.items():
            parts.append(
                f"SELECT 'phi_value:{c}:{pname}' AS check_id, 'warning' AS severity, '{c}' AS column_name, n AS n_affected, "
                f"'Found ' || n || ' potential {pname.upper()} values in column ''{c}''' AS message FROM "
                f"(SELECT CAST(count_if({rm(c, pat)}) AS BIGINT) AS n FROM {table_sql}) WHERE n > 0")
    return "\nUNION ALL\n".join(parts)


@query("phi_value_documents", _phi_oracle("documents", "documents", ["text", "lang", "source"],
                                          ["doc_id", "text", "lang", "source", "n_chars"]))
def q_phi_docs(spark, d):
    return _issues_out(V.validate(_t(spark, d, "documents"), [R.PHIDetector()]).issues)


@query("phi_value_customer", _phi_oracle(_sql_derive("customer", CUSTOMER_PII), "customer",
                                         ["c_name", "ssn", "phone", "zip", "c_mktsegment"],
                                         ["c_custkey", "c_name", "ssn", "phone", "zip", "c_mktsegment"]))
def q_phi_customer(spark, d):
    return _issues_out(V.validate(_derive(spark, d, "customer", CUSTOMER_PII), [R.PHIDetector()]).issues)


# ---- V5/V7 missing & empty -------------------------------------------------
_EV_COLS = ["event_id", "ts", "user_id", "event_type", "value", "props", "note"]
_EVN = _sql_derive("events", EVENTS_NULLS)


def _missing_oracle() -> str:
    agg = ", ".join([f"CAST(count_if({c} IS NULL OR (typeof({c}) = 'DOUBLE' AND isnan(TRY_CAST({c} AS DOUBLE)))) AS BIGINT) AS m_{c}"
                     for c in _EV_COLS])
    parts = []
    for c in _EV_COLS:
        parts.append(
            f"SELECT 'missing:{c}' AS check_id, CASE WHEN m_{c} * 100.0 / n > 50 THEN 'error' ELSE 'warning' END AS severity, "
            f"'{c}' AS column_name, m_{c} AS n_affected, "
            f"'Column ''{c}'' has ' || m_{c} || ' missing values (' || printf('%.1f', m_{c} * 100.0 / n) || '%)' AS message "
            f"FROM s WHERE m_{c} > 0")
        parts.append(
            f"SELECT 'empty:{c}' AS check_id, 'error' AS severity, '{c}' AS column_name, m_{c} AS n_affected, "
            f"'Column ''{c}'' is completely empty' AS message FROM s WHERE m_{c} = n")
    return f"WITH s AS (SELECT count(*) AS n, {agg} FROM {_EVN})\n" + "\nUNION ALL\n".join(parts)


MISSING_SQL = _missing_oracle()


def _events_nulls(spark, d):
    return _derive(spark, d, "events", EVENTS_NULLS)


def _quality_issues(spark, d):
    return V.validate(_events_nulls(spark, d), [R.DataQualityChecker()]).issues


@query("missing_values", MISSING_SQL)
def q_missing(spark, d):
    return _issues_out(_quality_issues(spark, d))


@query("severity_counts",
       f"WITH i AS ({MISSING_SQL}) SELECT count(*) AS total_issues, count_if(severity = 'error') AS error_count, "
       "count_if(severity = 'warning') AS warning_count, count_if(severity = 'info') AS info_count, "
       "NOT coalesce(bool_or(severity = 'error'), false) AS is_valid FROM i")
def q_sev_counts(spark, d):
    return V.severity_counts(_quality_issues(spark, d))


@query("issues_by_severity", f"WITH i AS ({MISSING_SQL}) SELECT * FROM i WHERE severity = 'error'")
def q_by_sev(spark, d):
    r = V.validate(_events_nulls(spark, d), [R.DataQualityChecker()])
    return _issues_out(r.by_severity("error"))


@query("issues_by_column", f"WITH i AS ({MISSING_SQL}) SELECT * FROM i WHERE column_name = 'note'")
def q_by_col(spark, d):
    r = V.validate(_events_nulls(spark, d), [R.DataQualityChecker()])
    return _issues_out(r.by_column("note"))


@query("severity_distribution",
       f"WITH i AS ({MISSING_SQL}) SELECT severity, count(*) AS n FROM i GROUP BY severity")
def q_sev_dist(spark, d):
    return A.severity_distribution(_quality_issues(spark, d))


@query("issues_per_column",
       f"WITH i AS ({MISSING_SQL}) SELECT column_name, count(*) AS n FROM i WHERE column_name IS NOT NULL "
       "GROUP BY column_name")
def q_iss_col(spark, d):
    return A.issues_per_column(_quality_issues(spark, d))


@query("missing_by_column",
       "SELECT column_name, CAST(missing_count AS BIGINT) AS missing_count FROM (SELECT "
       + ", ".join(f"count_if({c} IS NULL) AS {c}" for c in _EV_COLS)
       + f" FROM {_EVN}) UNPIVOT (missing_count FOR column_name IN ({', '.join(_EV_COLS)}))")
def q_missing_by_col(spark, d):
    return A.missing_by_column(_events_nulls(spark, d))


@query("missing_summary",
       "SELECT CAST(t AS BIGINT) AS total_missing, round(t * 100.0 / (n * 7), 6) AS missing_percentage, "
       "cols AS columns_with_missing FROM (SELECT count(*) AS n, "
       + " + ".join(f"count_if({c} IS NULL)" for c in _EV_COLS) + " AS t, "
       + "array_to_string(list_filter([" + ", ".join(f"CASE WHEN count_if({c} IS NULL) > 0 THEN '{c}' END" for c in _EV_COLS)
       + "], lambda x: x IS NOT NULL), ',') AS cols FROM " + _EVN + ")")
def q_missing_summary(spark, d):
    m = A.missing_summary(_events_nulls(spark, d))
    return m.select("total_missing", _r("missing_percentage").alias("missing_percentage"),
                    F.array_join("columns_with_missing", ",").alias("columns_with_missing"))


def _repeated(df: DataFrame, condition: str) -> DataFrame:
    """Every row, those that meet the condition twice."""
    return df.withColumn("__k", F.explode(F.when(F.expr(condition), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("__k")


def _sql_repeated(table: str, condition: str) -> str:
    return f"(SELECT * FROM {table} UNION ALL SELECT * FROM {table} WHERE {condition})"


_EVN2 = _sql_repeated(_EVN, "user_id > 50")


@query("validation_summary",
       f"SELECT count(*) AS total_rows, {len(_EV_COLS)} AS total_columns, "
       f"count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {_EVN2})) AS duplicate_rows, CAST("
       + " + ".join(f"count_if({c} IS NULL)" for c in _EV_COLS) + f" AS BIGINT) AS total_missing FROM {_EVN2}")
def q_summary(spark, d):
    s = V.summarize(_repeated(_events_nulls(spark, d), "user_id > 50"))
    return s.select("total_rows", "total_columns", "duplicate_rows",
                    F.aggregate(F.map_values("missing_values"), F.lit(0).cast("long"),
                                lambda a, x: a + x).alias("total_missing"))


# ---- V6 duplicates ----------------------------------------------------------
_DOCS2 = _sql_repeated("documents", "n_chars % 3 = 0")


@query("duplicate_rows",
       "SELECT 'duplicates' AS check_id, n AS n_affected, 'Found ' || n || ' duplicate rows' AS message FROM "
       f"(SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {_DOCS2})) AS n FROM {_DOCS2}) WHERE n > 0")
def q_dups(spark, d):
    docs = _repeated(_t(spark, d, "documents"), "n_chars % 3 = 0")
    r = V.validate(docs, [R.DataQualityChecker(missing=False, empty=False)])
    return r.issues.select("check_id", "n_affected", "message")


# ---- V8 codes --------------------------------------------------------------
def _codes_oracle() -> str:
    parts = []
    for c, t in CODE_COLUMNS.items():
        pat = "^(?:" + P.CODE_PATTERNS[t] + ")"
        bad = f"{c} IS NOT NULL AND NOT regexp_matches({c}, {sq(pat)})"
        parts.append(
            f"SELECT 'code:{c}:{t}' AS check_id, 'warning' AS severity, CAST(NULL AS VARCHAR) AS column_name, n AS n_affected, "
            f"'Found ' || n || ' invalid {t.upper()} codes in column. Sample: [' || smp || ']' AS message FROM "
            f"(SELECT (SELECT count(*) FROM codes WHERE {bad}) AS n, "
            f"(SELECT string_agg('''' || {c} || '''', ', ' ORDER BY p_partkey) FROM "
            f"(SELECT p_partkey, {c} FROM codes WHERE {bad} ORDER BY p_partkey LIMIT 3)) AS smp) WHERE n > 0")
    return f"WITH codes AS {_sql_derive('part', CODES)}\n" + "\nUNION ALL\n".join(parts)


@query("medical_codes", _codes_oracle())
def q_codes(spark, d):
    df = _derive(spark, d, "part", CODES)
    return _issues_out(V.validate(df, [R.MedicalCodeValidator(CODE_COLUMNS, order_by=["p_partkey"])]).issues)


# ---- V9 ranges ---------------------------------------------------------------
RANGES = {"l_quantity": {"min": 5, "max": 45}, "l_extendedprice": {"min": 1000, "max": 90000},
          "l_tax": {"max": 0.07}}


def _range_oracle() -> str:
    parts = []
    for c, cfg in RANGES.items():
        for k, op, word, cid in (("min", "<", "below minimum", "range_min"), ("max", ">", "above maximum", "range_max")):
            if k in cfg:
                parts.append(
                    f"SELECT '{cid}:{c}' AS check_id, 'warning' AS severity, '{c}' AS column_name, n AS n_affected, "
                    f"'Column ''{c}'' has ' || n || ' values {word} {cfg[k]}' AS message FROM "
                    f"(SELECT count_if({c} {op} {cfg[k]}) AS n FROM lineitem) WHERE n > 0")
    return "\nUNION ALL\n".join(parts)


@query("range_checks", _range_oracle())
def q_range(spark, d):
    return _issues_out(V.validate(_t(spark, d, "lineitem"), [R.RangeValidator(RANGES)]).issues)


# ---- V10 dates ---------------------------------------------------------------
_VISIT_SQL = ("(SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 'invalid-date' "
              "ELSE strftime(o_orderdate, '%Y-%m-%d') END AS visit_date FROM orders)")


@query("date_checks",
       f"WITH v AS (SELECT visit_date, try_strptime(visit_date, '%Y-%m-%d') AS t FROM {_VISIT_SQL}) "
       "SELECT * FROM ("
       "SELECT 'date_invalid:visit_date' AS check_id, 'error' AS severity, 'visit_date' AS column_name, "
       "count_if(visit_date IS NOT NULL AND t IS NULL) AS n_affected FROM v "
       "UNION ALL SELECT 'date_min:visit_date', 'warning', 'visit_date', count_if(t < TIMESTAMP '1996-01-01') FROM v "
       "UNION ALL SELECT 'date_max:visit_date', 'warning', 'visit_date', count_if(t > TIMESTAMP '2001-01-01') FROM v"
       ") WHERE n_affected > 0")
def q_dates(spark, d):
    df = _t(spark, d, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 9 == 0, F.lit("invalid-date"))
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("visit_date"))
    r = V.validate(df, [R.DateValidator(["visit_date"], "1996-01-01", "2001-01-01")])
    return r.issues.select("check_id", "severity", "column_name", "n_affected")


# ---- V11 user row check ------------------------------------------------------
@query("custom_row_check",
       "SELECT 'custom:discount_over_tax' AS check_id, 'warning' AS severity, n AS n_affected FROM "
       "(SELECT count_if(l_discount > l_tax) AS n FROM lineitem) WHERE n > 0")
def q_row_check(spark, d):
    r = V.validate(_t(spark, d, "lineitem"), [R.RowCheck("discount_over_tax", "l_discount > l_tax", "warning")])
    return r.issues.select("check_id", "severity", "n_affected")


# ---- V1/V2/V3 + C5/C6 + G4 over the columns table ----------------------------
REQUIRED = [("orders", "o_orderkey"), ("orders", "o_comment"), ("lineitem", "l_comment"),
            ("customer", "c_phone"), ("documents", "doc_id"), ("events", "event_id"),
            ("pages", "url"), ("part", "p_container"), ("conversations", "role"), ("labels", "label")]
EXPECTED = [("orders", "o_totalprice", "float"), ("orders", "o_orderdate", "datetime"),
            ("part", "p_size", "int"), ("customer", "c_acctbal", "int"), ("events", "value", "string"),
            ("lineitem", "l_quantity", "number"), ("documents", "text", "text"),
            ("orders", "o_orderstatus", "int"), ("events", "ts", "date"), ("labels", "toxic", "bool")]


def _all_tables(spark, d) -> dict:
    return {t: _t(spark, d, t) for t in TABLES}


@query("required_columns",
       "SELECT r.table_name, r.column_name, 'Required column ''' || r.column_name || ''' is missing' AS message "
       "FROM (VALUES " + ", ".join(f"({sq(t)}, {sq(c)})" for t, c in REQUIRED) + ") r(table_name, column_name) "
       f"WHERE NOT EXISTS (SELECT 1 FROM {COLS_SQL} c WHERE c.table_name = r.table_name AND c.column_name = r.column_name)")
def q_required(spark, d):
    cols = K.columns_table(spark, _all_tables(spark, d))
    req = spark.createDataFrame(REQUIRED, "table_name string, column_name string")
    return K.required_missing(cols, req).select(
        "table_name", "column_name", F.format_string("Required column '%s' is missing", "column_name").alias("message"))


_COMPAT_VALUES = ", ".join(f"({sq(a)}, {sq(n)})" for a, ns in P.TYPE_COMPATIBILITY.items() for n in ns)


@query("column_types",
       "SELECT e.table_name, e.column_name, " + _pandas_type_sql("c.data_type") + " AS actual_type, e.expected_type, "
       "'Column ''' || e.column_name || ''' has type ''' || " + _pandas_type_sql("c.data_type")
       + " || ''' but expected ''' || e.expected_type || '''' AS message "
       "FROM (VALUES " + ", ".join(f"({sq(t)}, {sq(c)}, {sq(x)})" for t, c, x in EXPECTED) + ") e(table_name, column_name, expected_type) "
       f"JOIN {COLS_SQL} c ON c.table_name = e.table_name AND c.column_name = e.column_name "
       f"WHERE NOT EXISTS (SELECT 1 FROM (VALUES {_COMPAT_VALUES}) m(t, n) WHERE m.t = "
       + _widened_type_sql("c.data_type") + " AND m.n = lower(e.expected_type))")
def q_types(spark, d):
    cols = K.columns_table(spark, _all_tables(spark, d))
    exp = spark.createDataFrame(EXPECTED, "table_name string, column_name string, expected_type string")
    return K.type_mismatches(cols, exp).select(
        "table_name", "column_name", F.col("pandas_type").alias("actual_type"), "expected_type",
        F.format_string("Column '%s' has type '%s' but expected '%s'", "column_name", "pandas_type",
                        "expected_type").alias("message"))


@query("phi_column_names",
       f"SELECT table_name, column_name FROM {COLS_SQL} WHERE " + _kw_sql("column_name", P.PHI_NAME_KEYWORDS))
def q_phi_names(spark, d):
    return K.phi_named_columns(K.columns_table(spark, _all_tables(spark, d))).select("table_name", "column_name")


def _fda_oracle() -> str:
    parts = []
    for std, rid, sev, tokens, prefix, rec in P.FDA_CHECKS:
        lst = "[" + ", ".join(sq(t) for t in tokens) + "]"
        parts.append(
            f"SELECT table_name, '{rid}' AS rule_id, '{sev}' AS severity, {sq(prefix)} || array_to_string(missing, ', ') AS message "
            f"FROM (SELECT table_name, list_filter({lst}, lambda t: NOT list_bool_or(list_transform(names, lambda n: contains(n, t)))) AS missing "
            f"FROM (SELECT table_name, list(lower(column_name)) AS names FROM {COLS_SQL} GROUP BY table_name)) "
            f"WHERE len(missing) > 0")
    return "\nUNION ALL\n".join(parts)


@query("fda_fields", _fda_oracle())
def q_fda(spark, d):
    return C.fda_catalog(K.columns_table(spark, _all_tables(spark, d))).select(
        "table_name", "rule_id", "severity", "message")


@query("dtype_counts",
       "SELECT table_name, " + _pandas_type_sql("data_type") + f" AS dtype, count(*) AS n_columns FROM {COLS_SQL} "
       "GROUP BY ALL")
def q_dtypes(spark, d):
    return K.dtype_counts(K.columns_table(spark, _all_tables(spark, d)))


# ==========================================================================
# Compliance engine C1-C13, C16, C18-C20
# ==========================================================================
ORACLE_COMPLIANCE = {
    "names": wb(r"[A-Z][a-z]+ [A-Z][a-z]+"),
    "ssn": P.HIPAA_SSN, "email": P.HIPAA_EMAIL, "phone": P.HIPAA_PHONE,
    "sensitive": wb(r"race|ethnicity|religion|health|biometric|genetic|sexuality"),
}
DOC_COLS = ["doc_id", "text", "lang", "source", "n_chars"]
PATIENT_COLS = [e.rsplit(" AS ", 1)[-1] if " AS " in e else e for e in PATIENTS]
TEMPLATE_COLS = [e.rsplit(" AS ", 1)[-1] if " AS " in e else e for e in ORDERS_TEMPLATE]


def _violations_sql(table_sql: str, cols: list[str], rules: list[C.CustomRule] = (), builtin: bool = True) -> str:
    parts = []
    import re as _re
    for c in cols:
        t = f"CAST({c} AS VARCHAR)"
        if builtin:
            for key, _, std, rid, sev, msg, rec in P.HIPAA_CHECKS + P.GDPR_CHECKS:
                parts.append(f"SELECT '{std}' AS standard, '{rid}' AS rule_id, '{sev}' AS severity, '{c}' AS field, "
                             f"{sq(msg % c)} AS message, {sq(rec)} AS recommendation FROM {table_sql} "
                             f"HAVING coalesce(bool_or({rm(t, ORACLE_COMPLIANCE[key])}), false)")
        for r in rules:
            if r.field_pattern is not None and not _re.search(r.field_pattern, c, _re.IGNORECASE):
                continue
            pat = r.pattern.replace(r"\b(19|20)\d{2}\b", wb(r"(19|20)\d{2}"))
            parts.append(f"SELECT 'CUSTOM' AS standard, {sq(r.name)} AS rule_id, {sq(r.severity)} AS severity, "
                         f"'{c}' AS field, {sq(f'Custom rule {chr(39)}{r.name}{chr(39)} violation: {r.description}')} AS message, "
                         f"{sq(r.recommendation or P.DEFAULT_CUSTOM_RECOMMENDATION)} AS recommendation FROM {table_sql} "
                         f"HAVING coalesce(bool_or({rm(t, pat)}), false)")
    if builtin:
        names = "[" + ", ".join(sq(c) for c in cols) + "]"
        for std, rid, sev, tokens, prefix, rec in P.FDA_CHECKS:  # required tokens that no column name holds
            listed = "[" + ", ".join(sq(t) for t in tokens) + "]"
            parts.append(f"SELECT {sq(std)} AS standard, {sq(rid)} AS rule_id, {sq(sev)} AS severity, 'system' AS field, "
                         f"{sq(prefix)} || string_agg(tok, ', ' ORDER BY i) AS message, {sq(rec)} AS recommendation FROM "
                         f"(SELECT unnest({listed}) AS tok, unnest(range({len(tokens)})) AS i) WHERE NOT EXISTS "
                         f"(SELECT 1 FROM (SELECT unnest({names}) AS c) WHERE contains(lower(c), tok)) HAVING count(*) > 0")
    return "\nUNION ALL\n".join(parts)


def _coding_sql(table_sql: str, cols: list[str]) -> dict[str, str]:
    out = {}
    for std, (pattern, keywords) in P.CODING_CHECKS.items():
        pat = "^(?:" + pattern + ")"
        named = " OR ".join(f"contains(lower({{c}}), {sq(k)})" for k in keywords)
        out[std] = "(SELECT " + " + ".join(
            f"CASE WHEN {named.format(c=sq(c))} THEN count_if(NOT {rm(f'CAST({c} AS VARCHAR)', pat)}) ELSE 0 END" for c in cols
        ) + f" FROM {table_sql})"
    return out


def _scores_sql(table_sql: str, cols: list[str]) -> str:
    v = _violations_sql(table_sql, cols)
    cod = _coding_sql(table_sql, cols)
    rows = [("hipaa", "(SELECT count(*) FROM v WHERE standard = 'HIPAA')", 10),
            ("gdpr", "(SELECT count(*) FROM v WHERE standard = 'GDPR')", 10),
            ("fda", "(SELECT count(*) FROM v WHERE standard = 'FDA')", 20),
            ("icd10", cod["icd10"], 10), ("loinc", cod["loinc"], 10), ("cpt", cod["cpt"], 10)]
    sel = "\nUNION ALL\n".join(f"SELECT '{s}' AS standard, CAST({n} AS BIGINT) AS violations_count, {p} AS pen"
                                for s, n, p in rows)
    return (f"WITH v AS ({v}), c AS ({sel}), s AS (SELECT standard, violations_count, "
            "CAST(greatest(0, 100 - pen * violations_count) AS DOUBLE) AS score FROM c) "
            "SELECT standard, score, CASE WHEN score >= 90 THEN 'low' WHEN score >= 70 THEN 'medium' "
            "WHEN score >= 50 THEN 'high' ELSE 'critical' END AS risk_level, violations_count, "
            "violations_count = 0 AS compliant FROM s")


def _patients(spark, d):
    return _derive(spark, d, "part", PATIENTS)


PATIENTS_SQL = _sql_derive("part", PATIENTS)


@query("compliance_violations_documents", _violations_sql("documents", DOC_COLS))
def q_cv_docs(spark, d):
    return C.compliance_report(_t(spark, d, "documents")).violations


@query("compliance_violations_patients", _violations_sql(PATIENTS_SQL, PATIENT_COLS))
def q_cv_pat(spark, d):
    return C.compliance_report(_patients(spark, d)).violations


@query("compliance_scores_documents", _scores_sql("documents", DOC_COLS))
def q_cs_docs(spark, d):
    return C.compliance_report(_t(spark, d, "documents")).scores()


@query("compliance_scores_patients", _scores_sql(PATIENTS_SQL, PATIENT_COLS))
def q_cs_pat(spark, d):
    return C.compliance_report(_patients(spark, d)).scores()


def _overall_sql(table_sql, cols) -> str:
    return (f"WITH sc AS ({_scores_sql(table_sql, cols)}), v AS ({_violations_sql(table_sql, cols)}) "
            "SELECT round(avg(score), 6) AS overall_score, CASE WHEN avg(score) >= 90 THEN 'low' WHEN avg(score) >= 70 "
            "THEN 'medium' WHEN avg(score) >= 50 THEN 'high' ELSE 'critical' END AS risk_level, "
            "(SELECT count(*) FROM v) AS total_violations, "
            "(SELECT count_if(severity = 'critical') FROM v) AS critical_violations, "
            "(SELECT count_if(severity = 'high') FROM v) AS high_violations, "
            "(SELECT count_if(severity = 'medium') FROM v) AS medium_violations, "
            "(SELECT count_if(severity = 'low') FROM v) AS low_violations FROM sc")


def _overall_out(df):
    return df.select(_r("overall_score").alias("overall_score"), "risk_level", "total_violations",
                     "critical_violations", "high_violations", "medium_violations", "low_violations")


@query("compliance_overall_patients", _overall_sql(PATIENTS_SQL, PATIENT_COLS))
def q_co_pat(spark, d):
    return _overall_out(C.compliance_report(_patients(spark, d)).overall())


@query("compliance_overall_documents", _overall_sql("documents", DOC_COLS))
def q_co_docs(spark, d):
    return _overall_out(C.compliance_report(_t(spark, d, "documents")).overall())


@query("compliance_recommendations_patients",
       f"WITH sc AS ({_scores_sql(PATIENTS_SQL, PATIENT_COLS)}) SELECT standard, ordinal, recommendation FROM ("
       + " UNION ALL ".join(f"SELECT '{s}' AS standard, {i} AS ordinal, {sq(r)} AS recommendation"
                            for s, recs in P.STANDARD_RECOMMENDATIONS.items() for i, r in enumerate(recs))
       + ") x WHERE (SELECT violations_count FROM sc WHERE sc.standard = x.standard) > 0")
def q_crec(spark, d):
    return C.compliance_report(_patients(spark, d)).recommendations()


@query("compliance_flags",
       f"WITH sc AS ({_scores_sql(PATIENTS_SQL, PATIENT_COLS)}) SELECT "
       "(SELECT score >= 80 AND score = 100 FROM sc WHERE standard = 'hipaa') AS hipaa, "
       "(SELECT score >= 80 FROM sc WHERE standard = 'icd10') AS icd10, "
       "(SELECT score >= 80 FROM sc WHERE standard = 'loinc') AS loinc, "
       "(SELECT score >= 80 FROM sc WHERE standard = 'cpt') AS cpt, true AS fhir, true AS omop")
def q_flags(spark, d):
    return C.compliance_report(_patients(spark, d)).flags()


@query("compliance_json",
       f"WITH sc AS ({_scores_sql('documents', DOC_COLS)}) SELECT string_agg(standard, ',' ORDER BY standard) AS "
       "standards_checked, bool_and(compliant) AS overall_compliant, CAST(sum(violations_count) AS BIGINT) AS total_issues FROM sc")
def q_cjson(spark, d):
    j = S.compliance_json(C.compliance_report(_t(spark, d, "documents")).scores())
    return j.select(F.array_join(F.array_sort("standards_checked"), ",").alias("standards_checked"),
                    "overall_compliant", F.col("total_issues").cast("long").alias("total_issues"))


CUSTOM_RULES = [C.CustomRule("secret_token", r"token\s*=\s*\"", "Secrets must not be stored", "high", "text"),
                C.CustomRule("test_marker", r"\bTEST\b", "Test values present", "low", None)]


@query("custom_rule_hits", _violations_sql("documents", DOC_COLS, CUSTOM_RULES, builtin=False).replace(
    r"\bTEST\b", wb("TEST")))
def q_custom(spark, d):
    v = C.compliance_report(_t(spark, d, "documents"), CUSTOM_RULES).violations
    return v.where(F.col("standard") == "CUSTOM")


def _template_query(name):
    from carecheck.operators.rulesets import template_rules
    rules = template_rules(name)
    sql = _violations_sql(_sql_derive("orders", ORDERS_TEMPLATE), TEMPLATE_COLS, rules, builtin=False)

    def fn(spark, d):
        df = _derive(spark, d, "orders", ORDERS_TEMPLATE)
        v = C.compliance_report(df, template=name).violations
        return v.where(F.col("standard") == "CUSTOM")
    query(f"template_{name}", sql)(fn)


for _tname in ["clinical_trials", "ehr", "laboratory", "imaging", "research"]:
    _template_query(_tname)


def _docs_phi_issues(spark, d):
    return V.validate(_t(spark, d, "documents"), [R.PHIDetector()]).issues


_DOC_PHI_ISSUES = _phi_oracle("documents", "documents", ["text", "lang", "source"], DOC_COLS)


@query("standards_report",
       f"WITH i AS ({_DOC_PHI_ISSUES}), m AS (SELECT "
       "count_if(contains(lower(message), 'phi') OR contains(lower(message), 'pii')) AS hipaa, "
       "count_if(contains(lower(message), 'icd10') OR contains(lower(message), 'diagnosis')) AS icd10, "
       "count_if(contains(lower(message), 'loinc') OR contains(lower(message), 'lab')) AS loinc, "
       "count_if(contains(lower(message), 'cpt') OR contains(lower(message), 'procedure')) AS cpt, "
       "count_if(contains(lower(message), 'fhir')) AS fhir, count_if(contains(lower(message), 'omop')) AS omop FROM i), "
       "dd AS (SELECT " + " + ".join(
           f"CAST(count_if({rm(f'CAST({c} AS VARCHAR)', p)}) > 0 AS INTEGER)"
           for c in DOC_COLS for p in [r"\d{3}-\d{2}-\d{4}", r"@.*\."]) + " AS data_phi FROM documents) "
       "SELECT 'hipaa' AS standard, CAST(hipaa + data_phi AS BIGINT) AS n_issues, "
       "CASE WHEN hipaa + data_phi > 0 THEN 50.0 ELSE 100.0 END AS score, hipaa + data_phi = 0 AS compliant FROM m, dd "
       + " ".join(f"UNION ALL SELECT '{s}', CAST({s} AS BIGINT), CAST(greatest(0, 100 - 10 * {s}) AS DOUBLE), {s} = 0 FROM m"
                  for s in ["icd10", "loinc", "cpt", "fhir", "omop"]))
def q_std_report(spark, d):
    return C.standards_report(_t(spark, d, "documents"), _docs_phi_issues(spark, d))


@query("cli_standards_report",
       f"WITH i AS ({_DOC_PHI_ISSUES}) SELECT "
       "count_if(contains(lower(message), 'phi') OR contains(lower(message), 'pii')) AS hipaa_issues, "
       "count_if(contains(lower(message), 'icd-10') OR contains(lower(message), 'icd10')) AS icd10_issues, "
       "count_if(contains(lower(message), 'loinc')) AS loinc_issues, "
       "count_if(contains(lower(message), 'cpt')) AS cpt_issues FROM i")
def q_cli_report(spark, d):
    return C.cli_standards_report(_docs_phi_issues(spark, d))


# ==========================================================================
# PHI inventory H1-H3, audit U1
# ==========================================================================
ORACLE_HIPAA_PHI = {
    "ssn": wb(r"\d{3}-\d{2}-\d{4}") + "|" + wb(r"\d{9}"),
    "email": ORACLE_PHI_VALUE["email"],
    "phone": wb(r"\d{3}[-.]?\d{3}[-.]?\d{4}"),
    "date": wb(r"\d{1,2}[/-]\d{1,2}[/-]\d{2,4}") + "|" + wb(r"\d{4}-\d{2}-\d{2}"),
    "address": wb(r"\d+\s+[A-Za-z\s]+(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Dr)"),
    "medical_record": wb(r"MRN\s*\d+") + "|" + wb(r"Medical\s*Record\s*\d+"),
    "account_number": wb(r"Account\s*#?\s*\d+") + "|" + wb(r"Acct\s*#?\s*\d+"),
    "insurance_id": wb(r"Insurance\s*ID\s*\d+") + "|" + wb(r"Policy\s*#\s*\d+"),
    "license_number": wb(r"License\s*#\s*\d+") + "|" + wb(r"Lic\s*#\s*\d+"),
    "vehicle_id": wb(r"VIN\s*\d+") + "|" + wb(r"Vehicle\s*ID\s*\d+"),
    "device_id": wb(r"Device\s*ID\s*\d+") + "|" + wb(r"Serial\s*#\s*\d+"),
    "ip_address": wb(r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"),
    "url": f"(?:^|{_NONWORD})https?://[^\\s]*{_WORD}",
    "biometric": f"(?:^|{_NONWORD})Fingerprint|Retina|Iris|Voice\\s*Pattern(?:{_NONWORD}|$)",
}
PAGE_COLS = ["page_id", "url", "html"]


def _inventory_sql(table: str, cols: list[str], key: str) -> str:
    parts = []
    for c in cols:
        t = f"CAST({c} AS VARCHAR)"
        for ptype, pat in ORACLE_HIPAA_PHI.items():
            hit = rm(t, pat)
            parts.append(
                f"SELECT '{c}' AS column_name, '{ptype}' AS phi_type, CAST(count_if({hit}) AS BIGINT) AS instances, "
                f"(SELECT string_agg(v, '<|>' ORDER BY k) FROM (SELECT {key} AS k, {t} AS v FROM {table} WHERE {hit} "
                f"ORDER BY {key} LIMIT 3)) AS sample_text FROM {table}")
    return "SELECT * FROM (" + "\nUNION ALL\n".join(parts) + ") WHERE instances > 0"


def _inventory(spark, d, table, key):
    inv = H.phi_inventory(_t(spark, d, table), order_by=[key])
    return inv.select("column_name", "phi_type", "instances",
                      F.array_join("sample_values", "<|>").alias("sample_text"))


@query("phi_inventory_documents", _inventory_sql("documents", DOC_COLS, "doc_id"))
def q_inv_docs(spark, d):
    return _inventory(spark, d, "documents", "doc_id")


@query("phi_inventory_pages", _inventory_sql("pages", PAGE_COLS, "page_id"))
def q_inv_pages(spark, d):
    return _inventory(spark, d, "pages", "page_id")


@query("phi_score",
       f"SELECT count(*) = 0 AS compliant, CAST(greatest(0, 100 - 10 * count(DISTINCT column_name)) AS BIGINT) AS "
       f"compliance_score, count(*) AS total_phi_instances, count(DISTINCT column_name) AS phi_columns FROM "
       f"({_inventory_sql('pages', PAGE_COLS, 'page_id')})")
def q_phi_score(spark, d):
    return H.phi_score(H.phi_inventory(_t(spark, d, "pages")))


@query("phi_recommendations",
       f"WITH inv AS ({_inventory_sql('pages', PAGE_COLS, 'page_id')}) SELECT ordinal, recommendation FROM ("
       f"SELECT 0 AS ordinal, {sq(P.PHI_FOUND_RECOMMENDATION)} AS recommendation, (SELECT count(*) FROM inv) > 0 AS on_ "
       + " ".join(f"UNION ALL SELECT {i}, {sq(r)}, EXISTS (SELECT 1 FROM inv WHERE phi_type = '{t}')"
                  for i, (t, r) in enumerate(P.PHI_TYPE_RECOMMENDATIONS, start=1))
       + f" UNION ALL SELECT {len(P.PHI_TYPE_RECOMMENDATIONS) + 1}, {sq(P.NO_PHI_RECOMMENDATION)}, "
         "(SELECT count(*) FROM inv) = 0) WHERE on_")
def q_phi_recs(spark, d):
    return H.phi_recommendations(H.phi_inventory(_t(spark, d, "pages")))


_AUDIT_ORACLE = {"ssn": wb(r"\d{3}-\d{2}-\d{4}"), "email": ORACLE_PHI_VALUE["email"],
                 "phone": wb(r"\d{3}[-.]?\d{3}[-.]?\d{4}")}


def _audit_sql(table: str, cols: list[str]) -> str:
    parts = []
    for pname, _ in P.AUDIT_PATTERNS:
        for c in cols:
            parts.append(f"SELECT '{pname}' AS pattern_name, '{c}' AS column_name, "
                         f"'Sensitive data detected in column ''{c}'' without encryption' AS issue, "
                         f"'Encrypt column ''{c}'' or apply anonymization' AS recommendation FROM {table} "
                         f"HAVING coalesce(bool_or({rm(f'CAST({c} AS VARCHAR)', _AUDIT_ORACLE[pname])}), false)")
    return "\nUNION ALL\n".join(parts)


@query("plaintext_audit", _audit_sql("pages", PAGE_COLS))
def q_audit(spark, d):
    return H.plaintext_audit(_t(spark, d, "pages"))[0]


@query("audit_summary",
       f"SELECT count(*) AS n_issues, CAST(greatest(0, 100 - 15 * count(*)) AS BIGINT) AS security_score, "
       f"CASE WHEN greatest(0, 100 - 15 * count(*)) >= 80 THEN 'SECURE' ELSE 'NEEDS_ATTENTION' END AS overall_status "
       f"FROM ({_audit_sql('pages', PAGE_COLS)})")
def q_audit_sum(spark, d):
    return H.plaintext_audit(_t(spark, d, "pages"))[1]


# ==========================================================================
# De-identification A1-A5, sanitising D1-D2
# ==========================================================================
ANON_SPARK = ["c_custkey", "c_name AS patient_name",
              "CASE c_custkey % 5 WHEN 0 THEN date_format(date_add(DATE'1950-01-01', CAST(c_custkey * 7 AS INT)), 'yyyy-MM-dd') "
              "WHEN 1 THEN date_format(date_add(DATE'1950-01-01', CAST(c_custkey * 7 AS INT)), 'MM/dd/yyyy') "
              "WHEN 2 THEN date_format(date_add(DATE'1950-01-01', CAST(c_custkey * 7 AS INT)), 'dd/MM/yyyy') "
              "WHEN 3 THEN date_format(date_add(DATE'1950-01-01', CAST(c_custkey * 7 AS INT)), 'yyyy/MM/dd') "
              "ELSE 'unknown' END AS birth_date",
              "CAST(c_nationkey AS STRING) || ' Main Street' AS home_address",
              "CAST(c_custkey AS STRING) AS account_id", "c_mktsegment", "c_acctbal"]
_D = "(DATE '1950-01-01' + CAST(c_custkey * 7 AS INTEGER))"
ANON_SQL = ("(SELECT c_custkey, c_name AS patient_name, CASE c_custkey % 5 "
            f"WHEN 0 THEN strftime({_D}, '%Y-%m-%d') WHEN 1 THEN strftime({_D}, '%m/%d/%Y') "
            f"WHEN 2 THEN strftime({_D}, '%d/%m/%Y') WHEN 3 THEN strftime({_D}, '%Y/%m/%d') ELSE 'unknown' END AS birth_date, "
            "CAST(c_nationkey AS VARCHAR) || ' Main Street' AS home_address, CAST(c_custkey AS VARCHAR) AS account_id, "
            "c_mktsegment, c_acctbal FROM customer)")
_YEAR_SQL = ("coalesce(CAST(year(try_strptime(birth_date, '%Y-%m-%d')) AS VARCHAR), "
             "CAST(year(try_strptime(birth_date, '%m/%d/%Y')) AS VARCHAR), "
             "CAST(year(try_strptime(birth_date, '%d/%m/%Y')) AS VARCHAR), "
             "CAST(year(try_strptime(birth_date, '%Y/%m/%d')) AS VARCHAR), birth_date)")


@query("anon_safe_harbor",
       "SELECT c_custkey, printf('Patient_%04d', row_number() OVER (ORDER BY c_custkey) - 1) AS patient_name, "
       f"{_YEAR_SQL} AS birth_date, '[REDACTED]' AS home_address, "
       "printf('ID_%06d', row_number() OVER (ORDER BY c_custkey) - 1) AS account_id, "
       "left(sha256(c_mktsegment || 'salt'), 8) AS c_mktsegment, "
       f"left(sha256(CAST(c_acctbal AS VARCHAR) || 'salt'), 8) AS c_acctbal FROM {ANON_SQL}")
def q_anon(spark, d):
    df = _derive(spark, d, "customer", ANON_SPARK)
    return H.anonymize(df, ["patient_name", "birth_date", "home_address", "account_id", "c_mktsegment",
                            "c_acctbal", "absent_column"], salt=SALT, order_by=["c_custkey"])


@query("anon_hash",
       "SELECT c_custkey, left(sha256(c_name || 'salt'), 8) AS c_name, "
       "left(sha256(CAST(c_nationkey AS VARCHAR) || 'salt'), 8) AS c_nationkey FROM customer")
def q_anon_hash(spark, d):
    df = _t(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey")
    return H.anonymize(df, ["c_name", "c_nationkey"], method="hash", salt=SALT)


_EMAIL_EXPR = ("CASE WHEN c_custkey % 3 = 0 THEN 'no-at-sign' ELSE lower(c_mktsegment) || '@' || "
               "CAST(c_nationkey AS STRING) || '@x.org' END AS email")


@query("anon_mask",
       "SELECT c_custkey, '***-***-' || right(phone, 4) AS phone, '***-**-' || right(ssn, 4) AS ssn, "
       "left(c_name, 3) || '***' AS c_name, "
       "CASE WHEN contains(email, '@') THEN left(email, 3) || '***@' || split_part(email, '@', 2) ELSE email END AS email "
       f"FROM {_sql_derive('customer', CUSTOMER_PII + [_EMAIL_EXPR])}")
def q_anon_mask(spark, d):
    df = _derive(spark, d, "customer", CUSTOMER_PII + [_EMAIL_EXPR]).select(
        "c_custkey", "phone", "ssn", "c_name", "email")
    return H.anonymize(df, ["phone", "ssn", "c_name", "email"], method="mask")


@query("date_to_year", f"SELECT c_custkey, {_YEAR_SQL} AS birth_year FROM {ANON_SQL}")
def q_date_year(spark, d):
    df = _derive(spark, d, "customer", ANON_SPARK)
    return df.select("c_custkey", H.generalize_date(F.col("birth_date"), df.schema["birth_date"].dataType)
                     .alias("birth_year"))


def _sanitize_sql(col: str) -> str:
    out = col
    for pat in P.SANITIZE_PATTERNS:
        out = f"regexp_replace({out}, {sq('(?i)' + pat)}, '', 'g')"
    out = f"regexp_replace({out}, {sq(P.SANITIZE_TAG)}, '', 'g')"
    for lit in P.SANITIZE_LITERALS:
        out = f"replace({out}, {sq(lit)}, '')"
    return out


@query("sanitize_text", f"SELECT page_id, url, {_sanitize_sql('html')} AS html FROM pages")
def q_sanitize(spark, d):
    return H.sanitize(_t(spark, d, "pages"))


@query("sanitize_filename",
       "SELECT page_id, NOT regexp_matches(url, '[<>:\"|?*\\\\/]') AS valid, "
       "translate(url, '<>:\"|?*\\/', '_________') AS sanitized FROM pages")
def q_sanitize_fn(spark, d):
    p = _t(spark, d, "pages")
    return p.select("page_id", H.filename_valid(F.col("url")).alias("valid"),
                    H.sanitize_filename(F.col("url")).alias("sanitized"))


# ==========================================================================
# Analytics Q1-Q6, N1-N3, T1-T2, X1-X4
# ==========================================================================
_NUM_EV = ["event_id", "user_id", "value"]


def _iqr_cte(table_sql: str, cols: list[str]) -> str:
    return ", ".join(
        f"b_{c} AS (SELECT quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS lo, "
        f"quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS hi FROM {table_sql})"
        for c in cols)


def _outliers_expr(c: str) -> str:
    return f"count_if({c} < (SELECT lo FROM b_{c}) OR {c} > (SELECT hi FROM b_{c}))"


_QUALITY_SQL = (
    f"WITH {_iqr_cte(_EVN, _NUM_EV)}, s AS (SELECT count(*) AS n, "
    + " + ".join(f"count_if({c} IS NULL)" for c in _EV_COLS) + " AS nulls, "
    + ", ".join(f"{_outliers_expr(c)} AS o_{c}" for c in _NUM_EV)
    + f", max(ts) AS tmax FROM {_EVN}), m AS (SELECT 1 - nulls / (n * 7.0) AS completeness, CAST(1.0 AS DOUBLE) AS consistency, "
    + "(" + " + ".join(f"(1 - o_{c} / n)" for c in _NUM_EV) + f" + {len(_EV_COLS) - len(_NUM_EV)}) / {len(_EV_COLS)}.0 AS accuracy, "
    f"CASE WHEN tmax IS NULL THEN 0.0 ELSE greatest(0.0, 1 - floor(epoch(TIMESTAMP '{AS_OF}' - tmax) / 86400) / 365.0) END "
    "AS timeliness FROM s) ")


@query("quality_metrics",
       _QUALITY_SQL + "SELECT round(completeness, 6) AS completeness, round(consistency, 6) AS consistency, "
       "round(accuracy, 6) AS accuracy, round(timeliness, 6) AS timeliness, "
       "round(0.3 * completeness + 0.25 * consistency + 0.25 * accuracy + 0.2 * timeliness, 6) AS overall_quality FROM m")
def q_quality(spark, d):
    v = A.Profile(_events_nulls(spark, d), as_of=AS_OF).metric_values()
    return v.select(*[_r(c).alias(c) for c in v.columns])


def _sev_sql(col: str, metric: str) -> str:
    th = P.QUALITY_THRESHOLDS[metric]
    return "CASE " + " ".join(f"WHEN {col} >= {t} THEN '{lvl}'" for t, lvl in th) + " ELSE 'critical' END"


@query("metric_severity",
       _QUALITY_SQL + "SELECT metric, round(value, 6) AS value, severity FROM ("
       + " UNION ALL ".join(f"SELECT '{m}' AS metric, {m} AS value, {_sev_sql(m, m)} AS severity FROM m"
                            for m in ["completeness", "consistency", "accuracy", "timeliness"]) + ")")
def q_metric_sev(spark, d):
    m = A.Profile(_events_nulls(spark, d), as_of=AS_OF).metrics()
    return m.select("metric", _r("value").alias("value"), "severity")


@query("anomalies",
       f"WITH {_iqr_cte(_EVN, _NUM_EV)}, s AS (SELECT count(*) AS n, "
       + ", ".join(f"count_if({c} IS NULL) AS m_{c}" for c in _EV_COLS) + ", "
       + ", ".join(f"{_outliers_expr(c)} AS o_{c}" for c in _NUM_EV) + f" FROM {_EVN}) "
       + " UNION ALL ".join(
           f"SELECT '{c}' AS column_name, 'outlier' AS anomaly_type, CASE WHEN o_{c} < n * 0.1 THEN 'medium' ELSE 'high' END "
           f"AS severity, o_{c} AS n_affected FROM s WHERE n - m_{c} > 0 AND o_{c} > 0" for c in _NUM_EV)
       + " UNION ALL "
       + " UNION ALL ".join(
           f"SELECT '{c}', 'missing_pattern', 'high', n FROM s WHERE n - m_{c} > 0 AND m_{c} / n > 0.2" for c in _EV_COLS))
def q_anomalies(spark, d):
    return A.Profile(_events_nulls(spark, d), as_of=AS_OF).anomalies().select(
        "column_name", "anomaly_type", "severity", "n_affected")


@query("outlier_rows",
       f"WITH {_iqr_cte(_EVN, _NUM_EV)} " + " UNION ALL ".join(
           f"SELECT event_id, '{c}' AS column_name FROM {_EVN} WHERE {c} < (SELECT lo FROM b_{c}) OR {c} > (SELECT hi FROM b_{c})"
           for c in _NUM_EV))
def q_outlier_rows(spark, d):
    return A.outlier_rows(_events_nulls(spark, d), ["event_id"])


_LI_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("numeric_summary", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, round(avg({c}), 6) AS mean, round(median({c}), 6) AS median, "
    f"round(stddev_samp({c}), 6) AS std, round(min({c}), 6) AS min, round(max({c}), 6) AS max, "
    f"round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.75), 6) AS q75, "
    f"count_if({c} IS NULL) AS missing_count FROM lineitem" for c in _LI_NUM))
def q_numeric(spark, d):
    s = A.numeric_summary(_t(spark, d, "lineitem"))
    return s.select("column_name", *[_r(c).alias(c) for c in ["mean", "median", "std", "min", "max", "q25", "q75"]],
                    "missing_count")


@query("categorical_summary", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS unique_values, "
    f"(SELECT {c} FROM orders WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS most_common, "
    f"(SELECT count(*) FROM orders WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS most_common_count, "
    f"count_if({c} IS NULL) AS missing_count FROM orders" for c in ["o_orderstatus", "o_orderpriority"]))
def q_cat(spark, d):
    return A.categorical_summary(_t(spark, d, "orders"))[0]


@query("top5_values", " UNION ALL ".join(
    f"SELECT * FROM (SELECT '{c}' AS column_name, row_number() OVER (ORDER BY count(*) DESC, {c}) AS rank, "
    f"{c} AS value, count(*) AS n FROM orders WHERE {c} IS NOT NULL GROUP BY {c}) WHERE rank <= 5"
    for c in ["o_orderstatus", "o_orderpriority"]))
def q_top5(spark, d):
    return A.categorical_summary(_t(spark, d, "orders"))[1].select(
        "column_name", F.col("rank").cast("long").alias("rank"), "value", "n")


@query("dataset_info", "SELECT count(*) AS rows, 6 AS columns FROM orders")
def q_dsinfo(spark, d):
    return A.dataset_info(_t(spark, d, "orders")).select("rows", "columns")


def _trend_sql(table_sql: str, tcol: str, tie: str, cols: list[str]) -> str:
    parts = []
    for c in cols:
        parts.append(
            f"SELECT '{c}' AS metric, regr_slope(y, x) AS b, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, avg(x) AS xbar, "
            f"count(*) AS n FROM (SELECT CAST({c} AS DOUBLE) AS y, CAST(row_number() OVER (ORDER BY {tcol}, {tie}) - 1 AS DOUBLE) AS x "
            f"FROM {table_sql} WHERE {c} IS NOT NULL)")
    return (f"WITH r AS ({' UNION ALL '.join(parts)}), p AS (SELECT min({tcol}) AS t0, max({tcol}) AS t1 FROM {table_sql}) "
            "SELECT metric, CASE WHEN b > 0.01 THEN 'increasing' WHEN b < -0.01 THEN 'decreasing' ELSE 'stable' END AS trend, "
            "round(b, 6) AS slope, round(CASE WHEN syy = 0 THEN 0.0 ELSE b * b * (sxx - n * xbar * xbar) / syy END, 6) AS confidence, "
            "strftime(t0, '%Y-%m-%d %H:%M:%S') AS period_start, strftime(t1, '%Y-%m-%d %H:%M:%S') AS period_end, n "
            "FROM r, p WHERE n >= 3")


def _trend_out(df):
    return df.select("metric", "trend", _r("slope").alias("slope"), _r("confidence").alias("confidence"),
                     F.date_format("period_start", "yyyy-MM-dd HH:mm:ss").alias("period_start"),
                     F.date_format("period_end", "yyyy-MM-dd HH:mm:ss").alias("period_end"), "n")


@query("trend", _trend_sql(_EVN, "ts", "event_id", _NUM_EV))
def q_trend(spark, d):
    return _trend_out(A.trends(_events_nulls(spark, d), "ts", ["event_id"]))


_MONTHLY_SQL = ("(SELECT date_trunc('month', o_orderdate) AS month, CAST(count(*) AS BIGINT) AS n_orders, "
                "sum(o_totalprice) AS revenue FROM orders GROUP BY 1)")


@query("trend_monthly_orders", _trend_sql(_MONTHLY_SQL, "month", "n_orders", ["n_orders", "revenue"]))
def q_trend_monthly(spark, d):
    o = _t(spark, d, "orders")
    m = o.groupBy(F.date_trunc("month", "o_orderdate").alias("month")).agg(
        F.count(F.lit(1)).alias("n_orders"), F.sum("o_totalprice").alias("revenue"))
    return _trend_out(A.trends(m, "month", ["n_orders"]))


@query("trend_r2",
       "SELECT metric, round(regr_r2(y, x), 6) AS confidence FROM (SELECT 'value' AS metric, value AS y, "
       f"CAST(row_number() OVER (ORDER BY ts, event_id) - 1 AS DOUBLE) AS x FROM {_EVN} WHERE value IS NOT NULL) GROUP BY metric")
def q_trend_r2(spark, d):
    t = A.trends(_events_nulls(spark, d).select("ts", "event_id", "value"), "ts", ["event_id"], r2=True)
    return t.where(F.col("metric") == "value").select("metric", _r("confidence").alias("confidence"))


JSON_MIX = ["event_id", "CASE WHEN event_id % 3 = 0 THEN props WHEN event_id % 3 = 1 THEN CAST(user_id AS STRING) "
            "ELSE '\"' || event_type || '\"' END AS payload", "props"]


@query("mixed_types",
       "SELECT column_name, count(*) AS n_types, CAST(sum(n) AS BIGINT) AS n_values FROM (SELECT column_name, t, count(*) AS n "
       "FROM (SELECT 'payload' AS column_name, json_type(payload) AS t FROM " + _sql_derive("events", JSON_MIX)
       + " UNION ALL SELECT 'props', json_type(props) FROM events) GROUP BY ALL) GROUP BY column_name HAVING count(*) > 1")
def q_mixed(spark, d):
    m = A.mixed_types(_derive(spark, d, "events", JSON_MIX), ["payload", "props"])
    return m.select("column_name", F.col("n_types").cast("long").alias("n_types"),
                    F.col("n_values").cast("long").alias("n_values"))


@query("consistency",
       "SELECT round((3 - 0.5 * count(*)) / 3.0, 6) AS consistency FROM (SELECT column_name FROM (SELECT 'payload' AS "
       "column_name, json_type(payload) AS t FROM " + _sql_derive("events", JSON_MIX)
       + " UNION ALL SELECT 'props', json_type(props) FROM events) GROUP BY column_name HAVING count(DISTINCT t) > 1)")
def q_consistency(spark, d):
    c = A.consistency(_derive(spark, d, "events", JSON_MIX), ["payload", "props"])
    return c.select(_r("consistency").alias("consistency"))


# ==========================================================================
# Monitoring M1-M15
# ==========================================================================
_RL = RUN_LOG_SQL
_TS = "strftime(ts, '%Y-%m-%d %H:%M:%S.%f')"


def _ts(c="ts"):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)


@query("run_stats",
       "SELECT count(*) AS total_validations, count_if(is_valid) AS successful_validations, "
       "count_if(NOT is_valid) AS failed_validations, round(avg(duration_s), 6) AS average_processing_time, "
       f"strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last_validation_time, "
       f"round(count_if(is_valid) / greatest(1, count(*)), 6) AS success_rate FROM {_RL}")
def q_run_stats(spark, d):
    s = M.run_stats(run_log(spark, d))
    return s.select("total_validations", "successful_validations", "failed_validations",
                    _r("average_processing_time").alias("average_processing_time"),
                    F.date_format("last_validation_time", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("last_validation_time"),
                    _r("success_rate").alias("success_rate"))


_RUNNING_SQL = ("SELECT run_id, ts, count(*) OVER w AS total_validations, count_if(NOT is_valid) OVER w AS failed_validations, "
                "count_if(is_valid) OVER w AS successful_validations, "
                "count_if(NOT is_valid) OVER w / greatest(1, count(*) OVER w) AS failure_rate, "
                f"avg(duration_s) OVER w AS average_processing_time, sum(duration_s) OVER w AS total_processing_time FROM {_RL} "
                "WINDOW w AS (ORDER BY ts, run_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")


@query("running_stats",
       "SELECT run_id, total_validations, failed_validations, successful_validations, round(failure_rate, 6) AS failure_rate, "
       f"round(total_processing_time, 6) AS total_processing_time FROM ({_RUNNING_SQL})")
def q_running(spark, d):
    r = M.running_stats(run_log(spark, d))
    return r.select("run_id", "total_validations", "failed_validations", "successful_validations",
                    _r("failure_rate").alias("failure_rate"),
                    _r("total_processing_time").alias("total_processing_time"))


def _status_sql(m: str, v: str) -> str:
    w = "CASE " + " ".join(f"WHEN {m} = '{k}' THEN {a}" for k, (a, _) in P.MONITOR_THRESHOLDS.items()) + \
        f" ELSE {P.DEFAULT_METRIC_THRESHOLDS[0]} END"
    c = "CASE " + " ".join(f"WHEN {m} = '{k}' THEN {b}" for k, (_, b) in P.MONITOR_THRESHOLDS.items()) + \
        f" ELSE {P.DEFAULT_METRIC_THRESHOLDS[1]} END"
    return f"CASE WHEN {v} >= {w} THEN 'normal' WHEN {v} >= {c} THEN 'warning' ELSE 'critical' END"


@query("metric_status",
       f"SELECT run_id, metric, round(metric_value, 6) AS value, {_status_sql('metric', 'metric_value')} AS status FROM {_RL}")
def q_metric_status(spark, d):
    s = M.metric_samples(run_log(spark, d))
    return s.select("run_id", "metric", _r("value").alias("value"), "status")


_POS_SQL = (f"(SELECT *, row_number() OVER (PARTITION BY metric ORDER BY ts, run_id) - 1 AS pos, "
            f"count(*) OVER (PARTITION BY metric) AS n_m FROM {_RL})")


@query("history_100",
       f"SELECT metric, run_id, round(metric_value, 6) AS value, pos FROM {_POS_SQL} WHERE pos >= n_m - 100")
def q_history(spark, d):
    h = M.history(run_log(spark, d))
    return h.select("metric", "run_id", _r("value").alias("value"), "pos")


@query("degradation",
       "SELECT 'quality_degradation:' || metric || ':' || run_id AS alert_id, "
       "CASE WHEN tr > -0.2 THEN 'medium' ELSE 'high' END AS severity, "
       "'Quality degradation detected in ' || metric AS message, round(tr, 6) AS trend FROM "
       f"(SELECT *, metric_value - lag(metric_value, 2) OVER (PARTITION BY metric ORDER BY ts, run_id) AS tr FROM {_RL}) "
       "WHERE tr < -0.1")
def q_degradation(spark, d):
    a = M.degradation_alerts(run_log(spark, d))
    return a.select("alert_id", "severity", "message",
                    _r(F.col("details")["trend"].cast("double")).alias("trend"))


@query("failure_rate_alerts",
       f"SELECT 'anomaly_detected:failure_rate:' || run_id AS alert_id, 'high' AS severity, "
       f"round(failure_rate, 6) AS failure_rate FROM ({_RUNNING_SQL}) WHERE failure_rate > 0.3")
def q_failure(spark, d):
    a = M.failure_rate_alerts(run_log(spark, d))
    return a.select("alert_id", "severity", _r(F.col("details")["failure_rate"].cast("double")).alias("failure_rate"))


@query("critical_violations",
       "SELECT 'compliance_violation:' || run_id AS alert_id, 'critical' AS severity, "
       f"'Critical compliance violations detected: 1' AS message FROM {_RL} WHERE has_critical")
def q_critical(spark, d):
    return M.critical_violation_alerts(run_log(spark, d)).select("alert_id", "severity", "message")


@query("issue_volume",
       "SELECT 'anomaly_detected:issues:' || run_id AS alert_id, 'high' AS severity, "
       f"'High number of validation issues: ' || n_issues AS message FROM {_RL} WHERE n_issues > 10")
def q_volume(spark, d):
    return M.issue_volume_alerts(run_log(spark, d)).select("alert_id", "severity", "message")


def _orders_runs(spark, d):
    return _derive(spark, d, "orders", ORDERS_RUNS_SPARK)


@query("inactivity_gaps",
       "SELECT 'system_error:inactivity:' || run_id AS alert_id, 'medium' AS severity, "
       "CAST(epoch(ts) - epoch(prev) AS BIGINT) AS gap_seconds FROM (SELECT run_id, ts, "
       f"lag(ts) OVER (ORDER BY ts, run_id) AS prev FROM {ORDERS_RUNS_SQL}) WHERE epoch(ts) - epoch(prev) > 3600")
def q_inactivity(spark, d):
    a = M.inactivity_alerts(_orders_runs(spark, d))
    return a.select("alert_id", "severity", F.col("details")["gap_seconds"].cast("long").alias("gap_seconds"))


_ALERTS_SQL = (
    "SELECT 'quality_degradation:' || metric || ':' || run_id AS alert_id, ts, 'quality_degradation' AS alert_type FROM "
    f"(SELECT *, metric_value - lag(metric_value, 2) OVER (PARTITION BY metric ORDER BY ts, run_id) AS tr FROM {_RL}) WHERE tr < -0.1 "
    f"UNION ALL SELECT 'anomaly_detected:failure_rate:' || run_id, ts, 'anomaly_detected' FROM ({_RUNNING_SQL}) WHERE failure_rate > 0.3 "
    f"UNION ALL SELECT 'compliance_violation:' || run_id, ts, 'compliance_violation' FROM {_RL} WHERE has_critical "
    f"UNION ALL SELECT 'anomaly_detected:issues:' || run_id, ts, 'anomaly_detected' FROM {_RL} WHERE n_issues > 10 "
    "UNION ALL SELECT 'system_error:inactivity:' || run_id, ts, 'system_error' FROM (SELECT run_id, ts, "
    f"lag(ts) OVER (ORDER BY ts, run_id) AS prev FROM {_RL}) WHERE epoch(ts) - epoch(prev) > 3600")
RETAIN_AS_OF = "2024-01-29 00:00:00"


@query("alert_retention",
       f"SELECT alert_type, count(*) AS n FROM ({_ALERTS_SQL}) WHERE ts >= TIMESTAMP '{RETAIN_AS_OF}' - INTERVAL 7 DAY "
       "GROUP BY alert_type")
def q_retention(spark, d):
    kept = M.retain(M.all_alerts(run_log(spark, d)), RETAIN_AS_OF)
    return kept.groupBy("alert_type").agg(F.count(F.lit(1)).alias("n"))


def _actions(spark, d):
    """One operator action per run of the run log: resolve every 5th run's
    alert, acknowledge every 3rd, otherwise none (a no-op action)."""
    return _derive(spark, d, "events", [
        "'anomaly_detected:issues:' || CAST(event_id AS STRING) AS alert_id", "ts",
        "CASE WHEN event_id % 5 = 0 THEN 'resolve' WHEN event_id % 3 = 0 THEN 'acknowledge' ELSE 'none' END AS action"])


@query("active_alerts",
       "SELECT 'anomaly_detected:issues:' || run_id AS alert_id, CAST(event_id % 3 = 0 AS BOOLEAN) AS acknowledged "
       f"FROM (SELECT *, CAST(run_id AS BIGINT) AS event_id FROM {_RL}) WHERE n_issues > 10 AND event_id % 5 <> 0")
def q_active(spark, d):
    a = M.apply_actions(M.issue_volume_alerts(run_log(spark, d)), _actions(spark, d))
    return M.active_alerts(a).select("alert_id", "acknowledged")


TRENDS_AS_OF = "2024-01-15 12:00:00"


@query("quality_trends",
       f"SELECT run_id, round(metric_value, 6) AS value FROM {_RL} WHERE metric = 'click' AND "
       f"ts >= TIMESTAMP '{TRENDS_AS_OF}' - INTERVAL 24 HOUR AND ts <= TIMESTAMP '{TRENDS_AS_OF}'")
def q_qtrends(spark, d):
    t = M.quality_trends(run_log(spark, d), "click", TRENDS_AS_OF, 24)
    return t.select("run_id", _r("value").alias("value"))


@query("perf_stats",
       "SELECT count(*) AS total_validations, round(avg(duration_s), 6) AS average_time, round(min(duration_s), 6) AS min_time, "
       "round(max(duration_s), 6) AS max_time, CAST(sum(n_rows) AS BIGINT) AS total_rows_processed, "
       f"round(sum(n_rows) / sum(duration_s), 6) AS average_rows_per_second FROM {_RL}")
def q_perf(spark, d):
    s = M.perf_stats(run_log(spark, d))[0]
    return s.select("total_validations", _r("average_time").alias("average_time"), _r("min_time").alias("min_time"),
                    _r("max_time").alias("max_time"), F.col("total_rows_processed").cast("long").alias("total_rows_processed"),
                    _r("average_rows_per_second").alias("average_rows_per_second"))


@query("perf_last10",
       f"SELECT run_id, round(duration_s, 6) AS duration_s, pos FROM (SELECT *, row_number() OVER (ORDER BY ts, run_id) - 1 AS pos, "
       f"count(*) OVER () AS n FROM {_RL}) WHERE pos >= n - 10")
def q_perf_last(spark, d):
    t = M.perf_stats(run_log(spark, d))[1]
    return t.select("run_id", _r("duration_s").alias("duration_s"), "pos")


BENCH_RUNS = ["event_type AS dataset", "user_id % 7 AS size", "value / 100 AS seconds", "user_id % 10 <> 0 AS ok"]


@query("benchmark_summary",
       "SELECT dataset, round(avg(CASE WHEN ok THEN seconds END), 6) AS mean_time, "
       "round(coalesce(stddev_samp(CASE WHEN ok THEN seconds END), 0), 6) AS std_time, "
       "round(min(CASE WHEN ok THEN seconds END), 6) AS min_time, round(max(CASE WHEN ok THEN seconds END), 6) AS max_time, "
       f"round(avg(CAST(ok AS DOUBLE)), 6) AS success_rate, count(*) AS runs FROM {_sql_derive('events', BENCH_RUNS)} GROUP BY dataset")
def q_bench_summary(spark, d):
    b = M.benchmark_summary(_derive(spark, d, "events", BENCH_RUNS))
    return b.select("dataset", *[_r(c).alias(c) for c in ["mean_time", "std_time", "min_time", "max_time", "success_rate"]],
                    "runs")


_BY_SIZE = ("round(avg(CASE WHEN ok THEN seconds END), 6) AS mean_time, round(avg(CAST(ok AS DOUBLE)), 6) AS success_rate, "
            "count(*) AS runs")


def _bench_by(spark, d, by):
    b = M.benchmark_summary(_derive(spark, d, "events", BENCH_RUNS + ["props AS rules"]), by)
    return b.select(by, _r("mean_time").alias("mean_time"), _r("success_rate").alias("success_rate"), "runs")


@query("benchmark_by_size", f"SELECT size, {_BY_SIZE} FROM {_sql_derive('events', BENCH_RUNS)} GROUP BY size")
def q_bench_size(spark, d):
    return _bench_by(spark, d, "size")


@query("benchmark_by_rules", f"SELECT rules, {_BY_SIZE} FROM {_sql_derive('events', BENCH_RUNS + ['props AS rules'])} GROUP BY rules")
def q_bench_rules(spark, d):
    return _bench_by(spark, d, "rules")


@query("active_alert_count",
       "SELECT count(*) AS total_validations, (SELECT count(*) FROM (SELECT run_id FROM (SELECT run_id, max(n_issues) AS n FROM "
       f"{_RL} GROUP BY run_id) WHERE n > 10)) AS active_alerts FROM (SELECT DISTINCT run_id FROM {_RL})")
def q_active_count(spark, d):
    log = run_log(spark, d)
    alerts = M.issue_volume_alerts(log)
    none = alerts.select("alert_id", "ts", F.lit("acknowledge").alias("action"))
    return M.run_stats(log, M.apply_actions(alerts, none)).select("total_validations", "active_alerts")


# ==========================================================================
# Sources S6/S7, sinks K3, batch validation V18/V19
# ==========================================================================
@query("ragged_columns",
       "WITH p AS (SELECT p_partkey, p_name, p_size, p_partkey // 10 AS chunk FROM part), "
       "n AS (SELECT chunk, p_name, row_number() OVER (PARTITION BY chunk ORDER BY p_partkey) AS i FROM p), "
       "s AS (SELECT chunk, p_size, row_number() OVER (PARTITION BY chunk ORDER BY p_partkey) AS i FROM p WHERE p_size > 25) "
       "SELECT n.chunk, n.p_name, s.p_size, 'part' AS source FROM n LEFT JOIN s ON n.chunk = s.chunk AND n.i = s.i")
def q_ragged(spark, d):
    p = _t(spark, d, "part")
    # one payload of at most 10 rows per chunk, one array a column
    payload = p.groupBy(F.floor(F.col("p_partkey") / 10).alias("chunk")).agg(
        F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))).alias("__n"),
        F.array_sort(F.collect_list(F.when(F.col("p_size") > 25, F.struct("p_partkey", "p_size")))).alias("__s"))
    payload = payload.select("chunk", F.transform("__n", lambda x: x["p_name"]).alias("p_name"),
                             F.transform("__s", lambda x: x["p_size"]).alias("p_size"), F.lit("part").alias("source"))
    return S.from_columns(payload, ["p_name", "p_size"], ["chunk", "source"]).select("chunk", "p_name", "p_size", "source")


_EXTS = ", ".join(sq(e) for e in P.ALLOWED_EXTENSIONS)


@query("file_admission",
       "SELECT page_id, file_name, (contains(file_name, '.') AND lower(split_part(file_name, '.', -1)) IN "
       f"({_EXTS}) AND len <= {P.MAX_UPLOAD_BYTES} AND regexp_matches(file_name, '^[a-zA-Z0-9._-]+$')) AS admitted "
       "FROM (SELECT page_id, split_part(url, '/', -1) AS file_name, length(html) AS len FROM pages)")
def q_files(spark, d):
    pg = _t(spark, d, "pages").select("page_id", F.col("url").alias("path"), F.length("html").alias("length"))
    return S.admit_files(pg).select("page_id", "file_name", "admitted")


@query("report_lines",
       f"WITH i AS ({MISSING_SQL}), c AS (SELECT count(*) AS t, count_if(severity = 'error') AS e, "
       "count_if(severity = 'warning') AS w, count_if(severity = 'info') AS f FROM i), "
       "n AS (SELECT *, row_number() OVER (ORDER BY severity, check_id) - 1 AS k FROM i) "
       "SELECT CAST(line_no AS BIGINT) AS line_no, line FROM ("
       f"SELECT 0 AS line_no, {sq(P.REPORT_TITLE)} AS line UNION ALL SELECT 1, repeat('=', 40) "
       "UNION ALL SELECT 2, 'Timestamp: ' UNION ALL SELECT 3, 'Overall Status: ' || CASE WHEN e = 0 THEN '✅ VALID' "
       "ELSE '❌ INVALID' END FROM c UNION ALL SELECT 4, '' UNION ALL SELECT 5, 'Summary:' "
       "UNION ALL SELECT 6, '  - Total Issues: ' || t FROM c UNION ALL SELECT 7, '  - Errors: ' || e FROM c "
       "UNION ALL SELECT 8, '  - Warnings: ' || w FROM c UNION ALL SELECT 9, '  - Info: ' || f FROM c "
       "UNION ALL SELECT 10, '' UNION ALL SELECT 11, 'Issues Found:' FROM c WHERE t > 0 "
       "UNION ALL SELECT 12, repeat('-', 20) FROM c WHERE t > 0 "
       "UNION ALL SELECT 100 + 4 * k, (k + 1) || '. [' || upper(severity) || '] ' || message FROM n "
       "UNION ALL SELECT 101 + 4 * k, '   Location: Column: ' || column_name FROM n WHERE column_name IS NOT NULL "
       "UNION ALL SELECT 103 + 4 * k, '' FROM n)")
def q_report(spark, d):
    iss = _quality_issues(spark, d)
    return S.report_lines(iss, V.severity_counts(iss))


_ORD_NULLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
              "CASE WHEN o_custkey % 97 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority"]


@query("batch_validation",
       "SELECT batch_num, min(k) AS start_row, max(k) + 1 AS end_row, CAST(count_if(o_orderpriority IS NULL) > 0 AS BIGINT) "
       "AS issues_count, true AS is_valid FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS k, "
       "CAST((row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 AS BIGINT) AS batch_num FROM "
       f"{_sql_derive('orders', _ORD_NULLS)}) GROUP BY batch_num")
def q_batches(spark, d):
    df = _derive(spark, d, "orders", _ORD_NULLS)
    return V.batch_validate(df, [R.DataQualityChecker()], ["o_orderkey"], 1000)[1]


@query("batch_issues",
       "SELECT batch_num, 'missing:o_orderpriority' AS check_id, n AS n_affected FROM (SELECT batch_num, "
       "count_if(o_orderpriority IS NULL) AS n FROM (SELECT CAST((row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 "
       f"AS BIGINT) AS batch_num, o_orderpriority FROM {_sql_derive('orders', _ORD_NULLS)}) GROUP BY batch_num) "
       "WHERE n > 0")
def q_batch_issues(spark, d):
    df = _derive(spark, d, "orders", _ORD_NULLS)
    return V.batch_validate(df, [R.DataQualityChecker()], ["o_orderkey"], 1000)[0].select(
        "batch_num", "check_id", "n_affected")


@query("changed_batches",
       "SELECT CAST((k - 1) // 1000 AS BIGINT) AS batch_num, count(*) AS n_rows FROM (SELECT o_orderkey, "
       "row_number() OVER (ORDER BY o_orderkey) AS k FROM orders) GROUP BY 1 HAVING count_if(o_orderkey % 5000 = 0) > 0")
def q_changed(spark, d):
    """Batches of orders whose content changed against the stored fingerprints (of the same orders with every
    5000th price changed)."""
    o = _t(spark, d, "orders")
    rules = [R.DataQualityChecker()]
    cur = V.batch_fingerprints(o, ["o_orderkey"], 1000, rules)
    old = o.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 5000 == 0, F.col("o_totalprice") + 1)
                       .otherwise(F.col("o_totalprice")))
    stored = V.batch_fingerprints(old, ["o_orderkey"], 1000, rules)
    return V.changed_batches(cur, stored).select("batch_num", "n_rows")


@query("revalidated_batches",
       "SELECT batch_num, 'missing:o_orderpriority' AS check_id, n AS n_affected FROM (SELECT batch_num, "
       "count_if(o_orderpriority IS NULL) AS n FROM (SELECT CAST((row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 "
       f"AS BIGINT) AS batch_num, o_orderpriority FROM {_sql_derive('orders', _ORD_NULLS)}) GROUP BY batch_num) "
       "WHERE n > 0")
def q_revalidated(spark, d):
    """Batches that changed since the stored run are validated again, the others' issues are read back."""
    df = _derive(spark, d, "orders", _ORD_NULLS)
    old = df.withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 5000 == 0, F.lit(None)).otherwise(F.col("o_orderpriority")))
    rules = [R.DataQualityChecker()]
    issues, _ = V.batch_validate(old, rules, ["o_orderkey"], 1000)
    stored = V.batch_fingerprints(old, ["o_orderkey"], 1000, rules)
    return V.revalidate(df, rules, ["o_orderkey"], 1000, stored, issues)[0].select("batch_num", "check_id", "n_affected")


@query("user_rule_batches",
       "SELECT CAST((k - 1) // 1000 AS BIGINT) AS batch_num, 'custom:urgent' AS check_id, count(*) AS n_affected FROM (SELECT "
       "o_orderpriority, row_number() OVER (ORDER BY o_orderkey) AS k FROM orders) WHERE o_orderpriority = '1-URGENT' GROUP BY 1")
def q_user_batches(spark, d):
    """A user's function, each batch by itself."""
    def by_batch(df):
        return (df.where("o_orderpriority = '1-URGENT'").groupBy("batch_num").agg(F.count(F.lit(1)).alias("n_affected")))

    rule = R.CustomValidator(lambda df: by_batch(df.withColumn("batch_num", F.lit(0))), "urgent", by_batch=by_batch)
    return V.batch_validate(_t(spark, d, "orders"), [rule], ["o_orderkey"], 1000)[0].select("batch_num", "check_id", "n_affected")


@query("failing_rule",
       "SELECT check_id, severity, n_affected FROM (SELECT 'custom:big' AS check_id, 'error' AS severity, "
       "count_if(o_totalprice > 100000) AS n_affected FROM orders UNION ALL SELECT 'failed:bad', 'error', NULL) "
       "WHERE n_affected IS NULL OR n_affected > 0")
def q_failing(spark, d):
    """V10d/V12: a predicate that fails while it runs becomes an issue; the other rules report."""
    rules = [R.RowCheck("big", "o_totalprice > 100000"), R.RowCheck("bad", "cast(o_orderpriority as int) > 1")]
    return V.validate(_t(spark, d, "orders"), rules).issues.select("check_id", "severity", "n_affected")


# ==========================================================================
# Validation profiles applied to derived tables
# ==========================================================================
HEART = ["l_orderkey", "l_linenumber",
         "CAST(floor(l_quantity * 3) AS BIGINT) AS age", "l_linenumber % 2 AS sex", "l_linenumber AS cp",
         "CAST(floor(l_extendedprice / 500) AS BIGINT) AS trestbps",
         "CAST(floor(l_extendedprice / 150) AS BIGINT) AS chol",
         "l_discount * 100 AS oldpeak"]
COVID = ["o_orderdate AS date", "o_orderpriority AS location", "CAST(floor(o_totalprice) AS BIGINT) AS total_cases",
         "o_custkey - 700 AS new_cases", "CAST(floor(o_totalprice / 1000) AS BIGINT) AS total_deaths",
         "o_totalprice * 10 AS population"]


def _profile_query(name: str, table: str, exprs: list[str]) -> str:
    """Oracle: the profile's required/type/range/date rows evaluated in SQL."""
    cols = [e.rsplit(" AS ", 1)[-1] if " AS " in e else e for e in exprs]
    src = _sql_derive(table, exprs)
    parts = []
    rules = [r for r in P.PROFILE_RULES if r[0] == name]
    for _, kind, c, a, b in rules:
        if kind == "required" and c not in cols:
            parts.append(f"SELECT 'required:{c}' AS check_id, 'error' AS severity, '{c}' AS column_name, "
                         f"CAST(NULL AS BIGINT) AS n_affected, 'Required column ''{c}'' is missing' AS message")
    types = f"(SELECT column_name, data_type FROM (DESCRIBE SELECT * FROM {src}) d(column_name, data_type, n, k, dflt, ex))"
    for _, kind, c, a, b in rules:
        if kind == "type" and c in cols:
            parts.append(
                f"SELECT 'type:{c}' AS check_id, 'error' AS severity, '{c}' AS column_name, "
                f"CAST(NULL AS BIGINT) AS n_affected, 'Column ''{c}'' has type ''' || "
                f"{_pandas_type_sql('data_type')} || ''' but expected ''{a}''' AS message "
                f"FROM {types} WHERE column_name = '{c}' AND NOT EXISTS (SELECT 1 FROM (VALUES {_COMPAT_VALUES}) m(t, n) "
                f"WHERE m.t = {_widened_type_sql('data_type')} AND m.n = lower('{a}'))")
    for _, kind, c, a, b in rules:
        if kind == "range" and c in cols:
            for bound, op, word, cid in ((a, "<", "below minimum", "range_min"), (b, ">", "above maximum", "range_max")):
                if bound is not None:
                    parts.append(f"SELECT '{cid}:{c}' AS check_id, 'warning' AS severity, '{c}' AS column_name, "
                                 f"n AS n_affected, 'Column ''{c}'' has ' || n || ' values {word} {bound}' AS message FROM (SELECT count_if({c} {op} {bound}) AS n FROM {src}) WHERE n > 0")
        if kind == "date" and c in cols:
            for bound, op, word, cid in ((a, "<", "before", "date_min"), (b, ">", "after", "date_max")):
                if bound is not None:
                    parts.append(f"SELECT '{cid}:{c}' AS check_id, 'warning' AS severity, '{c}' AS column_name, "
                                 f"n AS n_affected, 'Column ''{c}'' has ' || n || ' dates {word} {bound}' AS message FROM (SELECT count_if({c} {op} TIMESTAMP '{bound}') AS n FROM {src}) WHERE n > 0")
    return "\nUNION ALL\n".join(parts)


def _profile_fn(name, table, exprs):
    from carecheck.operators.rulesets import profile_catalog, profile_rules

    def fn(spark, d):
        rules = profile_rules(name, profile_catalog(spark))
        return _issues_out(V.validate(_derive(spark, d, table, exprs), rules).issues)
    return fn


query("profile_heart_disease", _profile_query("heart_disease", "lineitem", HEART))(
    _profile_fn("heart_disease", "lineitem", HEART))
query("profile_covid19", _profile_query("covid19", "orders", COVID))(_profile_fn("covid19", "orders", COVID))


# ==========================================================================
# P1-P3 input preparation
# ==========================================================================
COVID_RAW = ["event_id", "CASE WHEN event_id % 7 = 0 THEN 'not a date' ELSE CAST(CAST(ts AS DATE) AS STRING) END AS date",
             "NULLIF(event_type, 'error') AS location", "CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END AS new_cases",
             "CASE WHEN event_id % 6 = 0 THEN NULL ELSE user_id END AS total_cases", "props"]


@query("covid_clean",
       "SELECT event_id, strftime(try_strptime(date, '%Y-%m-%d'), '%Y-%m-%d %H:%M:%S') AS date, "
       "coalesce(location, '0') AS location, "
       "coalesce(new_cases, 0) AS new_cases, coalesce(total_cases, 0) AS total_cases FROM "
       + _sql_derive("events", COVID_RAW))
def q_covid_clean(spark, d):
    from carecheck.operators import prep
    raw = _derive(spark, d, "events", COVID_RAW)
    kept = prep.select_existing(raw, ["event_id", "date", "location", "new_cases", "total_cases", "iso_code"])
    out = prep.coerce_and_fill(kept, "date", formats=["yyyy-MM-dd"])
    return out.withColumn("date", F.date_format("date", "yyyy-MM-dd HH:mm:ss"))


@query("audit_recommendations",
       f"SELECT CAST(0 AS BIGINT) AS ordinal, recommendation FROM ({_audit_sql('pages', PAGE_COLS)}) "
       + " ".join(f"UNION ALL SELECT CAST({1_000_000 + i} AS BIGINT), {sq(r)}"
                  for i, r in enumerate(P.AUDIT_FIXED_RECOMMENDATIONS)))
def q_audit_recs(spark, d):
    return H.audit_recommendations(H.plaintext_audit(_t(spark, d, "pages"))[0])


from carecheck import registry_more  # noqa: E402,F401 - registers its queries here
