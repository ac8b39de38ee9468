"""More registered queries: readers, profiles and rule sets, the rule store, hash trees of key ranges, reports
and the streaming callback.  Conventions as in ``registry``."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from carecheck.functions import patterns as P
from carecheck.operators import analytics as A
from carecheck.operators import changes as X
from carecheck.operators import compliance as C
from carecheck.operators import monitor as M
from carecheck.operators import phi as H
from carecheck.operators import prep
from carecheck.operators import rules as R
from carecheck.operators import rulesets as RS
from carecheck.operators import sketches as K
from carecheck.operators import validate as V
from carecheck.plans import catalog
from carecheck.registry import (_COMPAT_VALUES, _ORD_NULLS, _RL, DOC_COLS, JSON_MIX, ORACLE_PHI_VALUE, _actions, _derive, _pandas_type_sql, _scores_sql,
                                _sql_derive, _t, _violations_sql, _widened_type_sql, query, rm, run_log, sq)
from carecheck.session import shared_dir
from carecheck.sources import io as S


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# ==========================================================================
# S1, S2, S4, S5, P2
# ==========================================================================
_CUST = ["c_custkey", "c_name", "c_nationkey", "c_acctbal",
         "CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment"]


@query("read_csv", "SELECT c_custkey, c_name, CAST(c_nationkey AS INTEGER) AS c_nationkey, round(c_acctbal, 6) AS c_acctbal, c_mktsegment "
       f"FROM {_sql_derive('customer', _CUST)}")
def q_csv(spark, d):
    """Header and inferred types; the suffix picks the reader."""
    path = _folder(spark, "customer") + ".csv"
    _derive(spark, d, "customer", _CUST).write.option("header", True).csv(path)
    t = S.read_table(spark, path)
    return t.select(F.col("c_custkey").cast("bigint").alias("c_custkey"), "c_name", "c_nationkey", F.round("c_acctbal", 6).alias("c_acctbal"), "c_mktsegment")


@query("read_json", "SELECT o_orderkey, o_custkey, round(o_totalprice, 6) AS o_totalprice, o_orderpriority FROM orders")
def q_json(spark, d):
    """JSON lines."""
    path = _folder(spark, "orders") + ".json"
    _t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority").write.json(path)
    return S.read_table(spark, path).select("o_orderkey", "o_custkey", F.round("o_totalprice", 6).alias("o_totalprice"), "o_orderpriority")


@query("records", "SELECT p_partkey, p_name, CAST(p_size AS BIGINT) AS p_size FROM part")
def q_records(spark, d):
    """A payload of JSON objects."""
    lines = _t(spark, d, "part").select(F.to_json(F.struct("p_partkey", "p_name", "p_size")).alias("value"))
    return S.from_records(spark, lines, "p_partkey long, p_name string, p_size long")


@query("first_rows", "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 250")
def q_first(spark, d):
    """The first n rows of an order."""
    o = _t(spark, d, "orders")
    return prep.head(o, 250, [F.col("o_totalprice").desc(), "o_orderkey"]).select("o_orderkey", "o_orderpriority")


# ==========================================================================
# V4d, V15a-d, V15f, V16, V17
# ==========================================================================
FOUND = ["check_id", "severity", "column_name", "n_affected"]


def _row(check: str, sev: str, col: str | None, n: str, src: str | None, where: str = "n > 0") -> str:
    name = "CAST(NULL AS VARCHAR)" if col is None else sq(col)
    if src is None:
        return f"SELECT {sq(check)} AS check_id, {sq(sev)} AS severity, {name} AS column_name, CAST({n} AS BIGINT) AS n_affected"
    return f"SELECT {sq(check)} AS check_id, {sev if sev.startswith('CASE') else sq(sev)} AS severity, {name} AS column_name, CAST(n AS BIGINT) AS n_affected FROM (SELECT {n} AS n, count(*) AS rows FROM {src}) WHERE {where}"


def rule_rows_sql(rules: list[tuple], table: str, exprs: list[str], text: list[str]) -> str:
    """All issues of catalog rows ``(kind, column, arg1, arg2)`` over a derived table; ``text`` names its string columns."""
    cols = [e.rsplit(" AS ", 1)[-1] for e in exprs]
    src = _sql_derive(table, exprs)
    types = f"(SELECT column_name, data_type FROM (DESCRIBE SELECT * FROM {src}) d(column_name, data_type, n, k, dflt, ex))"
    out = []
    for kind, c, a, b in rules:
        if kind == "required" and c not in cols:
            out.append(_row(f"required:{c}", "error", c, "NULL", None))
        elif kind == "type" and c in cols:
            out.append(_row(f"type:{c}", "error", c, "NULL", None) + f" FROM {types} WHERE column_name = '{c}' AND NOT EXISTS (SELECT 1 FROM "
                       f"(VALUES {_COMPAT_VALUES}) m(t, n) WHERE m.t = {_widened_type_sql('data_type')} AND m.n = lower('{a}'))")
        elif kind == "phi":
            out += [_row(f"phi_name:{x}", "warning", x, "NULL", None) for x in cols if any(k in x.lower() for k in P.PHI_NAME_KEYWORDS)]
            out += [_row(f"phi_value:{x}:{p}", "warning", x, f"count_if({rm(x, pat)})", src) for x in text for p, pat in ORACLE_PHI_VALUE.items()]
        elif kind == "quality":
            for x in cols:
                n = f"count_if({x} IS NULL)"
                out.append(_row(f"missing:{x}", "CASE WHEN n * 100.0 / rows > 50 THEN 'error' ELSE 'warning' END", x, n, src))
                out.append(_row(f"empty:{x}", "error", x, n, src, "n = rows"))
            out.append(_row("duplicates", "warning", None, f"count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {src}))", src))
        elif kind == "code" and c in cols:
            out.append(_row(f"code:{c}:{a}", "warning", None, f"count_if({c} IS NOT NULL AND NOT {rm(c, P.CODE_PATTERNS[a])})", src))
        elif kind in ("range", "date") and c in cols:
            lit = (lambda v: str(v)) if kind == "range" else (lambda v: f"TIMESTAMP '{v}'")
            for bound, op, end in ((a, "<", "min"), (b, ">", "max")):
                if bound is not None:
                    value = c if kind == "range" else f"CAST({c} AS TIMESTAMP)"
                    out.append(_row(f"{kind}_{end}:{c}", "warning", c, f"count_if({value} {op} {lit(bound)})", src))
    return "\nUNION ALL\n".join(out)


_CODE = "CASE WHEN o_orderkey % 9 = 0 THEN 'bad' ELSE chr(65 + CAST(o_orderkey % 26 AS INTEGER)) || lpad(CAST(o_custkey % 100 AS STRING), 2, '0') END"
PROFILE_TABLES = {
    "clinical_trials": ("orders", ["CAST(o_custkey AS STRING) AS subject_id", "CAST(o_orderdate AS STRING) AS visit_date", "o_orderdate AS screening_date",
                                   "CAST(o_orderkey % 130 AS BIGINT) AS age", "o_totalprice / 5000 AS bmi",
                                   "CASE WHEN o_orderkey % 10 < 6 THEN NULL ELSE o_orderpriority END AS arm"], ["subject_id", "visit_date", "arm"]),
    "ehr": ("orders", ["o_custkey AS patient_id", "o_orderdate AS encounter_date", f"{_CODE} AS diagnosis_code",
                       "lpad(CAST(o_orderkey % 100000 AS STRING), 4, '0') AS procedure_code", "CAST(NULL AS STRING) AS medication_code"],
            ["diagnosis_code", "procedure_code", "medication_code"]),
    "imaging": ("lineitem", ["CAST(l_orderkey AS STRING) AS image_id", "l_partkey AS patient_id", "l_shipdate AS acquisition_date",
                             "l_discount AS pixel_spacing", "l_quantity + 5 AS slice_thickness"], ["image_id"]),
    "lab": ("orders", ["CAST(o_custkey AS STRING) AS patient_id", "o_orderdate AS test_date", "o_orderdate AS collection_date",
                       "CAST(o_orderkey % 99999 AS STRING) || '-' || CAST(o_orderkey % 12 AS STRING) AS test_code", f"{_CODE} AS diagnosis_code",
                       "o_totalprice - 20000 AS test_value"], ["patient_id", "test_code", "diagnosis_code"]),
    "ehr_real": ("orders", ["o_custkey AS patient_id", "o_orderdate AS admission_date", "o_orderdate AS discharge_date", "o_orderkey % 125 AS age",
                            "o_totalprice / 1000 AS temperature", "o_totalprice / 500 AS heart_rate", "o_totalprice AS total_charges",
                            "o_orderkey % 320 AS blood_pressure_systolic", "o_orderkey % 220 AS blood_pressure_diastolic", "o_orderkey % 55 AS respiratory_rate",
                            "o_orderkey % 101 AS oxygen_saturation", "o_orderkey % 1010 AS glucose", "o_totalprice / 4000 AS creatinine",
                            "o_orderkey % 27 AS hemoglobin", "o_orderkey % 103 AS white_blood_cells", "o_orderkey % 1003 AS platelets",
                            f"{_CODE} AS primary_diagnosis", "lower(o_orderstatus) AS secondary_diagnosis"], ["primary_diagnosis", "secondary_diagnosis"]),
}


def _profile(name: str) -> None:
    table, exprs, text = PROFILE_TABLES[name]
    rows = [r[1:] for r in P.PROFILE_RULES if r[0] == name]

    def fn(spark, d):
        rules = RS.profile_rules(name, RS.profile_catalog(spark))
        return V.validate(_derive(spark, d, table, exprs), rules).issues.select(*FOUND)
    query(f"profile_{name}", rule_rows_sql(rows, table, exprs, text))(fn)


for _name in PROFILE_TABLES:
    _profile(_name)


_DUE = ["o_orderkey", "'due ' || substr(CAST(o_orderdate AS STRING), 1, 10) || ', status ' || o_orderstatus AS remark", "o_orderpriority"]


@query("phi_dates_in_text", rule_rows_sql([("phi", None, None, None)], "orders", _DUE, ["remark", "o_orderpriority"]))
def q_phi_dates(spark, d):
    """V4d: dates written in free text."""
    return V.validate(_derive(spark, d, "orders", _DUE), [R.PHIDetector()]).issues.select(*FOUND)


_OWN = [("required", "o_orderkey", None, None), ("required", "o_region", None, None), ("range", "o_totalprice", "1000", "150000"),
        ("quality", None, None, None)]
_ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


@query("registered_profile", rule_rows_sql(_OWN, "orders", _ORDERS, []))
def q_registered(spark, d):
    """A profile registered as rows beside the built-in ones, looked up by name."""
    catalog = RS.register_profile(RS.profile_catalog(spark), "orders_check", _OWN)
    return V.validate(_t(spark, d, "orders"), RS.profile_rules("orders_check", catalog)).issues.select(*FOUND)


@query("rules_from_options", " UNION ALL ".join(
    f"SELECT '{name}' AS options, * FROM ({rule_rows_sql(rules, 'orders', _ORDERS, ['o_orderstatus', 'o_orderpriority'])})"
    for name, rules in (("default", [("phi", None, None, None), ("quality", None, None, None)]),
                        ("cli", [("required", "o_orderkey", None, None), ("required", "o_region", None, None), ("type", "o_orderkey", "string", None),
                                 ("phi", None, None, None)]),
                        ("profile", [r[1:] for r in P.PROFILE_RULES if r[0] == "lab"]))))
def q_options(spark, d):
    """Options choose the rules; a profile wins outright."""
    o = _t(spark, d, "orders")
    chosen = {"default": RS.rules_from_options(), "profile": RS.rules_from_options("lab", phi=False),
              "cli": RS.rules_from_options(quality=False, always_quality=False, required_columns=["o_orderkey", "o_region"],
                                           column_types={"o_orderkey": "string"})}
    out = [V.validate(o, rules).issues.select(F.lit(k).alias("options"), *FOUND) for k, rules in chosen.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


# ==========================================================================
# Columns that the other rows leave out
# ==========================================================================
def _types_sql(table: str) -> str:
    return (f"(SELECT column_name, {_pandas_type_sql('data_type')} AS pandas_type FROM (DESCRIBE SELECT * FROM {table}) "
            "d(column_name, data_type, n, k, dflt, ex))")


@query("summary_columns", "WITH m AS (SELECT " + ", ".join(
    f"count_if({c} IS NULL) AS {c.rsplit(' ', 1)[-1]}" for c in ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"])
    + f" FROM {_sql_derive('customer', _CUST)}) SELECT column_name, pandas_type, CAST(missing AS BIGINT) AS missing "
    f"FROM (UNPIVOT m ON COLUMNS(*) INTO NAME column_name VALUE missing) JOIN {_types_sql(_sql_derive('customer', _CUST))} USING (column_name)")
def q_summary_columns(spark, d):
    """Type and missing count of every column in the summary."""
    s = V.summarize(_derive(spark, d, "customer", _CUST))
    return (s.select(F.explode(F.map_entries("data_types")).alias("t"), "missing_values")
            .select(F.col("t.key").alias("column_name"), F.col("t.value").alias("pandas_type"),
                    F.col("missing_values")[F.col("t.key")].alias("missing")))


@query("dataset_types", f"SELECT pandas_type, count(*) AS n, (SELECT count(*) FROM lineitem) AS rows FROM {_types_sql('lineitem')} GROUP BY 1")
def q_dataset_types(spark, d):
    """The histogram of column types."""
    i = A.dataset_info(_t(spark, d, "lineitem"))
    return i.select(F.explode(F.map_entries("data_types")).alias("t"), "rows").select(
        F.col("t.key").alias("pandas_type"), F.col("t.value").cast("bigint").alias("n"), "rows")


@query("compliance_json_details", _scores_sql("documents", DOC_COLS))
def q_cjson_details(spark, d):
    """K2: the rows inside ``details``."""
    j = S.compliance_json(C.compliance_report(_t(spark, d, "documents")).scores())
    kind = "array<struct<standard:string,score:double,risk_level:string,violations_count:bigint,compliant:boolean>>"
    return j.select(F.inline(F.from_json("details", kind)))


_QUALITY = [("quality", None, None, None), ("required", "o_region", None, None)]


@query("result_document",
       f"WITH i AS ({rule_rows_sql(_QUALITY, 'orders', _ORDERS[:5] + [_ORD_NULLS[-1]], [])}) SELECT count_if(severity = 'error') = 0 AS is_valid, "
       "count(*) AS total_issues, count_if(severity = 'error') AS error_count, count_if(severity = 'warning') AS warning_count, "
       "CAST(sum(coalesce(n_affected, 0)) AS BIGINT) AS listed, (SELECT count(*) FROM orders) AS total_rows, CAST(6 AS BIGINT) AS total_columns FROM i")
def q_result_document(spark, d):
    """K1: validity, counts, issues and the summary as one JSON text."""
    df = _derive(spark, d, "orders", _ORDERS[:5] + [_ORD_NULLS[-1]])
    rules = [R.DataQualityChecker(), R.SchemaValidator(["o_region"], {})]
    res = V.validate(df, rules)
    doc = S.result_document(res.issues, V.summarize(df, len(rules)))
    kind = ("is_valid boolean, total_issues bigint, error_count bigint, warning_count bigint, issues array<struct<message:string>>, "
            "summary struct<total_rows:bigint,total_columns:bigint,rules_applied:int>")
    j = doc.select(F.from_json("json", kind).alias("j")).select("j.*")
    listed = F.aggregate(F.transform("issues", lambda x: x["message"]), F.lit(0).cast("bigint"), lambda n, m: n + F.coalesce(
        F.regexp_extract(m, r"(?:has|Found) (\d+)", 1).try_cast("bigint"), F.lit(0)))
    return j.select("is_valid", "total_issues", "error_count", "warning_count", listed.alias("listed"), "summary.total_rows", "summary.total_columns")


# ==========================================================================
# C14, C15, C17, C18, C21
# ==========================================================================
_STORED = [C.CustomRule("secret_token", r"token\s*=\s*\"", "Secrets must not be stored", "high", "text"),
           C.CustomRule("upper", r"[A-Z]{9}", "Long capitals", "low", "text|source")]


@query("stored_rules", _violations_sql("documents", DOC_COLS, _STORED, builtin=False))
def q_stored_rules(spark, d):
    """Rules added, updated and removed by name in a stored rule table, then read back and applied."""
    store = RS.RuleStore(spark, _folder(spark, "rules"))
    store.upsert([C.CustomRule("upper", "never", "first version", "high"), C.CustomRule("gone", ".", "removed again", "critical")])
    store.upsert(_STORED)
    assert store.delete("gone") and not store.delete("gone")
    v = C.compliance_report(_t(spark, d, "documents"), RS.load_rules(store.snapshot())).violations
    return v.where(F.col("standard") == "CUSTOM")


@query("template_applied", "SELECT applied.t AS template_applied, CAST(x.n AS BIGINT) AS n_custom FROM (VALUES ('imaging'), ('no such template')) applied(t), "
       "LATERAL (SELECT CASE WHEN applied.t = 'imaging' THEN (SELECT count(*) FROM ("
       + _violations_sql("labels", ["doc_id", "quality", "toxic"], RS.template_rules("imaging"), builtin=False) + ")) ELSE 0 END AS n) x")
def q_template_applied(spark, d):
    """C17: the name is recorded even when no template has it."""
    out = []
    for name in ("imaging", "no such template"):
        rep = C.compliance_report(_t(spark, d, "labels"), template=name)
        n = rep.violations.where(F.col("standard") == "CUSTOM").agg(F.count(F.lit(1)).alias("n_custom")).scalar()
        out.append(rep.overall().select("template_applied", n.alias("n_custom")))
    return out[0].unionByName(out[1])


@query("compliance_empty", "SELECT CAST(100.0 AS DOUBLE) AS overall_score, 'low' AS risk_level, count(*) AS total_violations FROM documents WHERE doc_id IS NULL")
def q_compliance_empty(spark, d):
    """A table without rows has the fixed report."""
    rep = C.compliance_report(_t(spark, d, "documents").where("doc_id IS NULL"))
    return rep.overall().select("overall_score", "risk_level", rep.violations.agg(F.count(F.lit(1)).alias("n")).scalar().alias("total_violations"))


@query("merged_report", "SELECT 'standard' AS part, standard AS name, score, CAST(violations_count AS BIGINT) AS n FROM ("
       + _scores_sql("documents", DOC_COLS) + ") WHERE standard IN ('hipaa', 'gdpr', 'fda') UNION ALL "
       "SELECT 'standard', 'medical_coding', avg(score), CAST(sum(violations_count) AS BIGINT) FROM ("
       + _scores_sql("documents", DOC_COLS) + ") WHERE standard IN ('icd10', 'loinc', 'cpt') UNION ALL "
       "SELECT 'overall', CASE WHEN avg(score) >= 90 THEN 'low' WHEN avg(score) >= 70 THEN 'medium' WHEN avg(score) >= 50 THEN 'high' "
       "ELSE 'critical' END, round(avg(score), 6), (SELECT count(*) FROM (" + _violations_sql("documents", DOC_COLS) + ")) FROM ("
       + _scores_sql("documents", DOC_COLS) + ") UNION ALL SELECT 'template', 'research', NULL, NULL")
def q_merged(spark, d):
    """The issue-based report overwritten by the engine's rows, with overall score, risk and template."""
    df = _t(spark, d, "documents")
    rep = C.compliance_report(df)
    m = C.merged_report(df, V.validate(df, [R.PHIDetector()]).issues, rep, template="research")
    return m.where("name in ('hipaa', 'gdpr', 'fda', 'medical_coding') or part <> 'standard'").select(
        "part", "name", F.round("score", 6).alias("score"), "n")


# ==========================================================================
# A1e, M10, M13, V19
# ==========================================================================
_CONTACT = ["c_custkey", "c_name AS email_address", "CAST(c_acctbal AS STRING) AS fax", "c_mktsegment AS phone"]


@query("anon_contact", "SELECT c_custkey, '[REDACTED]' AS email_address, '[REDACTED]' AS fax, '[REDACTED]' AS phone FROM customer")
def q_anon_contact(spark, d):
    """A1e (``email_address`` is an address first, with the same result)."""
    return H.anonymize(_derive(spark, d, "customer", _CONTACT), ["email_address", "fax", "phone"], salt="s")


@query("action_results", "SELECT 'anomaly_detected:issues:' || CAST(e.event_id AS VARCHAR) AS alert_id, CASE WHEN event_id % 5 = 0 THEN 'resolve' "
       "WHEN event_id % 3 = 0 THEN 'acknowledge' ELSE 'none' END AS action, CAST(floor(value / 20) AS BIGINT) > 10 AS applied FROM events e")
def q_action_results(spark, d):
    """Which actions met an alert."""
    r = M.action_results(M.issue_volume_alerts(run_log(spark, d)), _actions(spark, d))
    return r.select("alert_id", "action", "applied")


@query("alert_callback", f"SELECT 'anomaly_detected:issues:' || run_id AS alert_id, n_issues AS issues FROM {_RL} WHERE n_issues > 10")
def q_alert_callback(spark, d):
    """A handler called for the alerts of each micro-batch of a stream; its errors do not stop the stream."""
    from carecheck.streaming.monitor import alert_callback
    out = _folder(spark, "called")
    log = run_log(spark, d)
    path = _folder(spark, "run-log")
    log.write.parquet(path)

    def handle(alerts, epoch):
        alerts.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")
        raise RuntimeError("the handler fails after its work")

    stream = M.issue_volume_alerts(spark.readStream.schema(log.schema).parquet(path))
    q = (stream.writeStream.foreachBatch(alert_callback(handle)).option("checkpointLocation", _folder(spark, "callback"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out).select("alert_id", F.col("details")["total_issues"].cast("bigint").alias("issues"))


_LEAF = 200
_NOW = ["o_orderkey", "o_custkey", "o_totalprice"]
_THEN = ("SELECT CASE WHEN o_orderkey % 1000 = 7 THEN -o_orderkey ELSE o_orderkey END AS o_orderkey, o_custkey, "
         "CASE WHEN o_orderkey % 1100 = 3 THEN 0.0 ELSE o_totalprice END AS o_totalprice FROM {} WHERE o_orderkey % 1300 <> 5 "
         "UNION ALL SELECT o_orderkey + 1000000000, o_custkey, o_totalprice FROM {} WHERE o_orderkey % 1700 = 11")


def _leaves_sql(table: str) -> str:
    return (f"(SELECT coalesce(leaf, '') AS leaf, count(*) AS n, string_agg(line, ';' ORDER BY line) AS lines FROM (SELECT "
            f"last_value(CASE WHEN CAST('0x' || substr(code, 1, 12) AS BIGINT) % {_LEAF} = 0 THEN code END IGNORE NULLS) OVER "
            "(ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS leaf, concat_ws('|', o_orderkey, o_custkey, o_totalprice) "
            f"AS line FROM (SELECT *, md5(CAST(o_orderkey AS VARCHAR)) AS code FROM {table})) GROUP BY 1)")


@query("changed_leaves", f"SELECT coalesce(a.leaf, b.leaf) AS leaf, CASE WHEN b.leaf IS NULL THEN 'added' WHEN a.leaf IS NULL THEN 'removed' "
       f"ELSE 'changed' END AS change FROM {_leaves_sql('orders')} a FULL JOIN {_leaves_sql('(' + _THEN.format('orders', 'orders') + ')')} b "
       "ON a.leaf = b.leaf WHERE a.lines IS DISTINCT FROM b.lines")
def q_changed_leaves(spark, d):
    """Leaves that inserted, deleted, updated and moved rows touch, found from the top of two hash trees."""
    now = _t(spark, d, "orders").select(*_NOW)
    old = spark.sql(_THEN.format("{t}", "{t}"), t=now)
    trees = [X.tree(X.leaves(t, ["o_orderkey"], _LEAF), ["o_orderkey"], "rules", _LEAF) for t in (now, old)]
    return X.changed_leaves(*trees)


@query("revalidated_leaves", "SELECT leaf, n AS n_affected FROM (SELECT coalesce(leaf, '') AS leaf, count_if(o_totalprice > 100000) AS n FROM (SELECT "
       f"o_totalprice, last_value(CASE WHEN CAST('0x' || substr(code, 1, 12) AS BIGINT) % {_LEAF} = 0 THEN code END IGNORE NULLS) OVER "
       "(ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS leaf FROM (SELECT *, md5(CAST(o_orderkey AS VARCHAR)) AS code "
       "FROM orders)) GROUP BY 1) WHERE n > 0")
def q_revalidated_leaves(spark, d):
    """Touched leaves validated again, the other leaves' issues read back."""
    rules = [R.RangeValidator({"o_totalprice": {"max": 100000}})]
    now = _t(spark, d, "orders").select(*_NOW)
    old = spark.sql(_THEN.format("{t}", "{t}"), t=now)
    none = V.issues_by(now.limit(0).withColumn("leaf", F.lit("")), now.limit(0).select(F.lit("").alias("leaf")), rules, "leaf")
    issues, tree, _ = X.revalidate_leaves(old, rules, ["o_orderkey"], X.empty_tree(spark), none, _LEAF)
    return X.revalidate_leaves(now, rules, ["o_orderkey"], tree, X.shared_table(issues, "issues"), _LEAF)[0].select("leaf", "n_affected")


_FAULTS = ["o_orderkey", "o_orderdate AS ship", "o_totalprice * 1e300 AS number", "substr(CAST(o_orderdate AS STRING), 1, 10) AS day"]


@query("date_faults", "SELECT check_id, severity, column_name, CAST(n AS BIGINT) AS n_affected FROM ("
       "SELECT 'date_failed:visits' AS check_id, 'error' AS severity, 'visits' AS column_name, NULL AS n UNION ALL "
       "SELECT 'date_invalid:number', 'error', 'number', count(number) FROM " + _sql_derive("orders", _FAULTS) + " UNION ALL "
       "SELECT 'date_min:ship', 'warning', 'ship', count_if(ship < TIMESTAMP '1995-01-01') FROM " + _sql_derive("orders", _FAULTS) + " UNION ALL "
       "SELECT 'date_min:day', 'warning', 'day', count_if(CAST(day AS TIMESTAMP) < TIMESTAMP '1995-01-01') FROM " + _sql_derive("orders", _FAULTS)
       + ") WHERE n IS NULL OR n > 0")
def q_date_faults(spark, d):
    """V10d: a column that holds no dates is an error, numbers beyond any time are invalid, the other columns proceed."""
    df = _derive(spark, d, "orders", _FAULTS).withColumn("visits", F.array("ship"))
    return V.validate(df, [R.DateValidator(["visits", "number", "ship", "day", "absent"], "1995-01-01")]).issues.select(*FOUND)


# ==========================================================================
# C13 as rows, X3/X4 from sketches, X5
# ==========================================================================
@query("rule_rows", _violations_sql("documents", DOC_COLS, _STORED, builtin=False))
def q_rule_rows(spark, d):
    """Rules joined as rows, for rule sets too large to compile."""
    return C.rule_violations(_t(spark, d, "documents"), RS.rule_rows(spark, _STORED))


_LI = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("merged_sketches", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) AS n_rows, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, min({c}) AS low, max({c}) AS high, "
    "true AS quantiles_within, CAST(NULL AS VARCHAR) AS top_value, CAST(NULL AS BIGINT) AS top_n FROM lineitem" for c in _LI) + " UNION ALL " + " UNION ALL ".join(
    f"SELECT '{c}', (SELECT count(*) FROM lineitem), NULL, NULL, NULL, NULL, true, v, n FROM (SELECT {c} AS v, count(*) AS n FROM lineitem GROUP BY 1 "
    "ORDER BY n DESC LIMIT 1)" for c in ("l_returnflag", "l_linestatus")) + ")")
def q_merged_sketches(spark, d):
    """One sketch per year of shipment, stored and merged; the quantiles' ranks are held against a count."""
    t = _t(spark, d, "lineitem").select(*_LI, "l_returnflag", "l_linestatus", "l_shipdate")
    path = _folder(spark, "sketches")
    years = [r[0] for r in t.select(F.year("l_shipdate").alias("y")).distinct().collect()]  # a batch each
    for y in years:
        K.sketch(t.where(F.year("l_shipdate").eqNullSafe(F.lit(y))).drop("l_shipdate"), str(y)).write.mode("append").parquet(path)
    m = K.merge(spark.read.parquet(path))
    num, (_, top) = K.numeric_summary(m), K.categorical_summary(m, 1)
    q = {r["column_name"]: r for r in num.collect()}  # one row per column
    n = F.count(F.lit(1))
    ok = [F.struct(F.lit(c).alias("column_name"), _within(c, q[c], n).alias("ok")) for c in _LI]
    ok = t.agg(F.array(*ok).alias("a")).select(F.inline("a"))
    rows = m.select("column_name", "n_rows", F.round("mean", 4).alias("mean"), "low", "high").join(
        num.select("column_name", F.round("std", 4).alias("std")), "column_name", "left").join(ok, "column_name", "left").join(
        top.select("column_name", F.col("value").alias("top_value"), F.col("n").alias("top_n")), "column_name", "left")
    return rows.select("column_name", "n_rows", "mean", "std", "low", "high", F.coalesce("ok", F.lit(True)).alias("quantiles_within"), "top_value", "top_n")


def _within(c: str, q, n):
    """Do the ranks of the quartiles lie within the stated error?"""
    ok = F.lit(True)
    for name, p in (("q25", 0.25), ("median", 0.5), ("q75", 0.75)):
        ok = ok & (F.count_if(F.col(c) < q[name]) <= (p + K.RANK_ERROR) * n) & (F.count_if(F.col(c) <= q[name]) >= (p - K.RANK_ERROR) * n)
    return ok


_MIXED = _sql_derive("events", JSON_MIX)


@query("full_report", "SELECT 'anomaly' AS part, column_name AS name, 'data_type_mismatch' AS kind, n AS value FROM (SELECT column_name, count(t) * 1.0 AS n FROM "
       f"(SELECT 'payload' AS column_name, json_type(payload) AS t FROM {_MIXED} UNION ALL SELECT 'props', json_type(props) FROM {_MIXED}) "
       "GROUP BY 1 HAVING count(DISTINCT t) > 1) UNION ALL SELECT 'metric', 'consistency', 'value', round((3 - 0.5 * count(*)) / 3.0, 6) FROM (SELECT column_name "
       f"FROM (SELECT 'payload' AS column_name, json_type(payload) AS t FROM {_MIXED} UNION ALL SELECT 'props', json_type(props) FROM {_MIXED}) GROUP BY 1 "
       f"HAVING count(DISTINCT t) > 1) UNION ALL SELECT 'info', 'rows', 'value', count(*) FROM {_MIXED} UNION ALL "
       f"SELECT 'values', 'payload', 'distinct', count(DISTINCT payload) FROM {_MIXED}")
def q_full_report(spark, d):
    """Parts of the full report, with Q2 and N3 on columns of JSON values."""
    df = _derive(spark, d, "events", JSON_MIX)
    r = A.full_report(df, as_of="2024-02-01 00:00:00", json_columns=["payload", "props"])
    part = lambda p, name, kind, v: [F.lit(p).alias("part"), name.alias("name"), kind.alias("kind"), F.round(v.cast("double"), 6).alias("value")]
    out = r["anomalies"].where("anomaly_type = 'data_type_mismatch'").select(*part("anomaly", F.col("column_name"), F.col("anomaly_type"), F.col("n_affected")))
    out = out.unionByName(r["quality_metrics"].where("metric = 'consistency'").select(*part("metric", F.col("metric"), F.lit("value"), F.col("value"))))
    out = out.unionByName(r["dataset_info"].select(*part("info", F.lit("rows"), F.lit("value"), F.col("rows"))))
    return out.unionByName(r["categorical_summary"].where("column_name = 'payload'").select(
        *part("values", F.col("column_name"), F.lit("distinct"), F.col("unique_values"))))


_COLUMN_SETS = {"customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"], "orders": _ORDERS,
                "documents": DOC_COLS, "labels": ["doc_id", "quality", "toxic"]}


@query("column_fill", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS n_rows, count({c}) AS n_values FROM {t}" for t, cs in _COLUMN_SETS.items() for c in cs))
def q_column_fill(spark, d):
    """The columns table: rows and values of every column of several tables."""
    return catalog.columns_table(spark, {t: _t(spark, d, t) for t in _COLUMN_SETS}).select("table_name", "column_name", "n_rows", "n_values")


@query("report_in_rule_order", f"SELECT row_number() OVER (ORDER BY starts_with(check_id, 'required') DESC, check_id) AS number, upper(severity) AS severity "
       f"FROM ({rule_rows_sql(_QUALITY, 'orders', _ORDERS[:5] + [_ORD_NULLS[-1]], [])})")
def q_report_order(spark, d):
    """K3: issues numbered in the order of the rules."""
    df = _derive(spark, d, "orders", _ORDERS[:5] + [_ORD_NULLS[-1]])
    rules = [R.SchemaValidator(["o_region"], {}), R.DataQualityChecker()]
    res = V.validate(df, rules)
    form = r"^(\d+)\. \[(\w+)\]"
    lines = S.report_lines(res.issues, V.severity_counts(res.issues), rules=rules).where(F.col("line").rlike(form))
    return lines.select(F.regexp_extract("line", form, 1).cast("bigint").alias("number"), F.regexp_extract("line", form, 2).alias("severity"))
