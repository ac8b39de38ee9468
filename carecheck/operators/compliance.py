"""Compliance engine C1-C21.

``compliance_report(df, rules)`` plans one fused aggregate over the data:
per column ``bool_or`` of every HIPAA/GDPR/custom pattern and ``count_if`` of
bad coding cells.  Violations, per-standard scores, the overall score and the
recommendations are all derived lazily from that one-row result (plus
plan-time facts about the schema for the FDA field checks).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carecheck.functions import exprs as E
from carecheck.functions import patterns as P
from carecheck.plans import catalog as K

VIOLATION_SCHEMA = T.StructType([
    T.StructField("standard", T.StringType()),
    T.StructField("rule_id", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("field", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("recommendation", T.StringType()),
])
VIOLATION_COLUMNS = [f.name for f in VIOLATION_SCHEMA.fields]

STANDARDS = ["hipaa", "gdpr", "fda", "icd10", "loinc", "cpt"]


@dataclass(frozen=True)
class CustomRule:
    """A custom pattern rule (one row of the rule catalog)."""
    name: str
    pattern: str
    description: str = ""
    severity: str = "medium"
    field_pattern: str | None = None
    recommendation: str | None = None


RULE_CATALOG_SCHEMA = ("ruleset string, rule_id string, description string, pattern string, "
                       "severity string, field_pattern string, recommendation string, version long")


def rules_from_rows(rows) -> list[CustomRule]:
    """Compile selected rule-catalog rows (small, metadata) into rules."""
    return [CustomRule(r["rule_id"], r["pattern"], r["description"] or "", r["severity"] or "medium",
                       r["field_pattern"], r["recommendation"]) for r in rows]


def _applies(rule: CustomRule, column: str) -> bool:
    return rule.field_pattern is None or re.search(rule.field_pattern, column, re.IGNORECASE) is not None


def _hit(c: Column) -> Column:
    return F.coalesce(F.bool_or(F.coalesce(c, F.lit(False))), F.lit(False))


@dataclass
class ComplianceReport:
    agg: DataFrame                 # one-row fused aggregate (lazy)
    violation_structs: list        # per-violation struct columns over ``one``
    violation_hits: list           # (severity, hit Column over ``one``) per violation struct
    standard_counts: dict          # standard -> Column over ``one``
    template_applied: str | None
    n_rows: Column
    fda_rows: list
    _one: DataFrame | None = None

    @property
    def one(self) -> DataFrame:
        """The fused aggregate, run once on first use; its one row (fixed size:
        one value per check) becomes literals, so violations, scores, overall
        and flags do not scan the data again."""
        if self._one is None:
            row = self.agg.first()
            self._one = self.agg.sparkSession.createDataFrame([tuple(row)], self.agg.schema)
        return self._one

    @property
    def violations(self) -> DataFrame:
        """(standard, rule_id, severity, field, message, recommendation)."""
        spark = self.one.sparkSession
        parts = []
        if self.violation_structs:
            parts.append(self.one.select(F.inline(F.array(*self.violation_structs)))
                         .where("__hit").select(*VIOLATION_COLUMNS))
        if self.fda_rows:
            rows = F.array(*[F.struct(*[F.lit(v).cast("string").alias(c) for c, v in zip(VIOLATION_COLUMNS, r)]) for r in self.fda_rows])
            parts.append(self.one.where(self.n_rows > 0).select(F.inline(rows)))  # an empty table violates nothing
        if not parts:
            return spark.createDataFrame([], VIOLATION_SCHEMA)
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def scores(self) -> DataFrame:
        """(standard, score, risk_level, violations_count, compliant)."""
        structs = []
        for std in STANDARDS:
            n = self._count(std)
            score = F.greatest(F.lit(0), F.lit(100) - F.lit(P.SCORE_PENALTY[std]) * n).cast("double")
            structs.append(F.struct(F.lit(std).alias("standard"), score.alias("score"),
                                    E.risk_level(score).alias("risk_level"),
                                    n.alias("violations_count"), (n == 0).alias("compliant")))
        return self.one.select(F.inline(F.array(*structs)))

    def _count(self, std: str) -> Column:
        """Violations of a standard; none on an empty table."""
        return F.when(self.n_rows == 0, F.lit(0)).otherwise(self.standard_counts[std]).cast("long")

    def _score(self, std: str) -> Column:
        n = self._count(std)
        return F.greatest(F.lit(0), F.lit(100) - F.lit(P.SCORE_PENALTY[std]) * n).cast("double")

    def overall(self) -> DataFrame:
        """C12 + severity summary (Quirk 14) + template (C17); C21 on empty input.
        Pure arithmetic over the one-row aggregate: a single select."""
        avg = sum_cols([self._score(s) for s in STANDARDS]) / len(STANDARDS)

        def n_with(sev: str | None) -> Column:
            hits = [h.cast("long") for s, h in self.violation_hits if sev is None or s == sev]
            fda = sum(1 for r in self.fda_rows if sev is None or r[2] == sev)
            return (sum_cols(hits) if hits else F.lit(0).cast("long")) + F.lit(fda)

        empty = self.n_rows == 0
        score = F.when(empty, F.lit(100.0)).otherwise(avg)
        counts = [("total_violations", None), ("critical_violations", "critical"), ("high_violations", "high"),
                  ("medium_violations", "medium"), ("low_violations", "low")]
        return self.one.select(
            score.alias("overall_score"), E.risk_level(score).alias("risk_level"),
            *[F.when(empty, F.lit(0)).otherwise(n_with(sev)).cast("long").alias(c) for c, sev in counts],
            F.lit(self.template_applied).cast("string").alias("template_applied"))

    def recommendations(self) -> DataFrame:
        """Two fixed lines per violated HIPAA/GDPR/FDA standard."""
        structs = []
        for std, recs in P.STANDARD_RECOMMENDATIONS.items():
            for i, r in enumerate(recs):
                structs.append(F.struct(F.lit(std).alias("standard"), F.lit(i).alias("ordinal"),
                                        F.lit(r).alias("recommendation"),
                                        (self._count(std) > 0).alias("__on")))
        return self.one.select(F.inline(F.array(*structs))).where("__on").drop("__on")

    def flags(self) -> DataFrame:
        """hipaa = score >= 80 and no violations; codes = score >= 80."""
        p = self.one.select(*[self._score(s).alias(s) for s in STANDARDS])
        return p.select(
            ((F.col("hipaa") >= 80) & (F.col("hipaa") == 100)).alias("hipaa"),
            (F.col("icd10") >= 80).alias("icd10"), (F.col("loinc") >= 80).alias("loinc"),
            (F.col("cpt") >= 80).alias("cpt"), F.lit(True).alias("fhir"), F.lit(True).alias("omop"))


def coding_columns(columns: list[str]) -> dict[str, list[str]]:
    """Which columns each coding standard inspects (by name keyword)."""
    out = {}
    for std, (_, kws) in P.CODING_CHECKS.items():
        out[std] = [c for c in columns if any(k in c.lower() for k in kws)]
    return out


def fda_violation_rows(columns: list[str]) -> list[tuple]:
    """C5/C6 for one table (schema facts, known at plan time)."""
    lowered = [c.lower() for c in columns]
    rows = []
    for std, rid, sev, tokens, prefix, rec in P.FDA_CHECKS:
        missing = [t for t in tokens if not any(t in c for c in lowered)]
        if missing:
            rows.append((std, rid, sev, "system", prefix + ", ".join(missing), rec))
    return rows


def compliance_report(df: DataFrame, custom_rules: list[CustomRule] | None = None,
                      template: str | None = None, polarity: str = "match") -> ComplianceReport:
    """C1-C13, C16 (via ``template``), C21.  One scan of ``df``."""
    custom_rules = list(custom_rules or [])
    if template is not None:
        from carecheck.operators.rulesets import template_rules
        custom_rules = template_rules(template) + custom_rules
    fields = df.schema.fields
    text = {f.name: E.as_text(f.name, f.dataType) for f in fields}

    aggs = [F.count(F.lit(1)).alias("__rows")]
    structs = []
    vhits: list = []
    counts: dict[str, list[Column]] = {s: [] for s in STANDARDS}
    k = 0

    def add(expr: Column) -> Column:
        nonlocal k
        name = f"__a{k}"
        k += 1
        aggs.append(expr.alias(name))
        return F.col(name)

    def violation(hit: Column, std, rid, sev, field, msg, rec):
        vhits.append((sev, hit))
        structs.append(F.struct(F.lit(std).alias("standard"), F.lit(rid).alias("rule_id"),
                                F.lit(sev).alias("severity"), F.lit(field).alias("field"),
                                F.lit(msg).alias("message"), F.lit(rec).alias("recommendation"),
                                hit.alias("__hit")))

    # One bool_or per distinct (column, pattern)
    for f in fields:
        t = text[f.name]
        hits = {}
        for key, pat in [("names", P.HIPAA_NAMES), ("ssn", P.HIPAA_SSN), ("email", P.HIPAA_EMAIL),
                         ("phone", P.HIPAA_PHONE), ("sensitive", P.GDPR_SENSITIVE)]:
            hits[key] = add(_hit(E.search(t, pat)))
        for key, _, std, rid, sev, msg, rec in P.HIPAA_CHECKS:
            violation(hits[key], std, rid, sev, f.name, msg % f.name, rec)
            counts["hipaa"].append(hits[key].cast("int"))
        for key, _, std, rid, sev, msg, rec in P.GDPR_CHECKS:
            violation(hits[key], std, rid, sev, f.name, msg % f.name, rec)
            counts["gdpr"].append(hits[key].cast("int"))

    # FDA fields from the schema
    fda_rows = fda_violation_rows([f.name for f in fields])
    counts["fda"].append(F.lit(len(fda_rows)))

    # Bad coding cells, nulls count as bad (Quirk 5)
    for std, cols in coding_columns([f.name for f in fields]).items():
        pat = P.CODING_CHECKS[std][0]
        for c in cols:
            t = text[c]
            counts[std].append(add(F.count_if(~F.coalesce(E.match(t, pat), F.lit(False)))))

    # Custom rules on the columns their field pattern selects
    for f in fields:
        t = text[f.name]
        for r in custom_rules:
            if not _applies(r, f.name):
                continue
            if polarity == "match":
                cond = E.search(t, r.pattern)
            else:
                cond = t.isNotNull() & ~E.search(t, r.pattern)
            violation(add(_hit(cond)), "CUSTOM", r.name, r.severity, f.name,
                      f"Custom rule '{r.name}' violation: {r.description}",
                      r.recommendation or P.DEFAULT_CUSTOM_RECOMMENDATION)

    one = df.agg(*aggs)
    total = {s: (sum_cols(v) if v else F.lit(0)) for s, v in counts.items()}
    return ComplianceReport(one, structs, vhits, total, template, F.col("__rows"), fda_rows)


PART_BYTES = 16 << 20  # of a column's values that meet its rules in one task


def dealt_values(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(values, parts)``: the distinct ``field, value`` of all columns, each with its ``part`` by hash, and one row
    ``field, parts`` per column: how many parts of about ``PART_BYTES`` its values make."""
    text = [F.struct(F.lit(f.name).alias("field"), E.as_text(f.name, f.dataType).alias("value")) for f in df.schema.fields]
    sizes = df.agg(*[F.sum(F.octet_length(x["value"])).alias(f"_{i}") for i, x in enumerate(text)])
    parts = sizes.select(F.inline(F.array(*[
        F.struct(F.lit(f.name).alias("field"), F.greatest(F.lit(1), F.ceil(F.coalesce(f"_{i}", F.lit(0)) / PART_BYTES)).alias("parts"))
        for i, f in enumerate(df.schema.fields)])))
    values = df.select(F.explode(F.array(*text)).alias("x")).select("x.*").where("value is not null").distinct()
    part = F.pmod(F.xxhash64("value"), F.col("parts")).alias("part")
    return values.join(F.broadcast(parts), "field").select("field", "value", part), parts  # parts: one row per column


def rule_violations(df: DataFrame, rules: DataFrame, polarity: str = "match") -> DataFrame:
    """C13 for rule sets of any size: the CUSTOM violations of ``rules`` (rows of ``RULE_CATALOG_SCHEMA``).

    One expression per rule and column would make a plan of a million expressions.  Here the plan is the
    same for any number of rules: each distinct (column, value) pair meets the rules whose field pattern
    fits the column (a join on the column, both sides by rows) and the pattern is a column of that join.
    Partial aggregation keeps one row per rule and column and task.  Values are de-duplicated first, so a
    frequent value is tried once.  A large column's values are dealt into parts, each of which meets all rules
    of the column, so that no task reads a whole column."""
    values, parts = dealt_values(df)
    fits = F.col("field_pattern").isNull() | F.regexp_like("field", F.concat(F.lit("(?i)"), F.coalesce("field_pattern", F.lit(""))))
    r = rules.select("rule_id", "description", "pattern", "severity", "field_pattern", "recommendation").distinct()
    targets = r.select(F.explode(F.array(*[F.lit(f.name) for f in df.schema.fields])).alias("field"), "rule_id", "pattern", "field_pattern").where(fits)
    targets = targets.join(F.broadcast(parts), "field").select(
        "field", "rule_id", F.concat(F.lit(E.rx("")), "pattern").alias("pattern"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    met = F.regexp_like("value", "pattern")
    hits = values.join(targets, ["field", "part"]).where(met if polarity == "match" else ~met).select("rule_id", "field").distinct()
    return hits.join(r, "rule_id").select(
        F.lit("CUSTOM").alias("standard"), "rule_id", "severity", "field",
        F.concat(F.lit("Custom rule '"), "rule_id", F.lit("' violation: "), F.coalesce("description", F.lit(""))).alias("message"),
        F.coalesce("recommendation", F.lit(P.DEFAULT_CUSTOM_RECOMMENDATION)).alias("recommendation"))


def sum_cols(cols: list[Column]) -> Column:
    out = cols[0]
    for c in cols[1:]:
        out = out + c
    return out


# --------------------------------------------------------------------------
# Issue-based standards reports
# --------------------------------------------------------------------------
STANDARD_KEYWORDS = {
    "icd10": ["icd10", "diagnosis"],
    "loinc": ["loinc", "lab"],
    "cpt": ["cpt", "procedure"],
    "fhir": ["fhir"],
    "omop": ["omop"],
}


def _mentions(msg: Column, words: list[str]) -> Column:
    low = F.lower(msg)
    out = None
    for w in words:
        c = F.instr(low, w) > 0
        out = c if out is None else (out | c)
    return F.coalesce(out, F.lit(False))


def standards_report(df: DataFrame, issues: DataFrame, standards: list[str] | None = None) -> DataFrame:
    """(standard, n_issues, score, compliant) from data + issue messages.

    hipaa: SSN or ``@.*\\.`` anywhere in the data, or an issue mentioning
    phi/pii -> score 50, else 100.  Others: issues mentioning the standard,
    score ``max(0, 100 - 10 n)``.
    """
    standards = standards or ["hipaa", "icd10", "loinc", "cpt", "fhir", "omop"]
    fields = df.schema.fields
    msg = F.col("message")
    iss = issues.agg(
        F.count_if(_mentions(msg, ["phi", "pii"])).alias("hipaa"),
        *[F.count_if(_mentions(msg, kw)).alias(s) for s, kw in STANDARD_KEYWORDS.items()])
    data_hits = []
    for f in fields:
        t = E.as_text(f.name, f.dataType)
        data_hits.append(F.count_if(F.coalesce(E.search(t, r"\d{3}-\d{2}-\d{4}"), F.lit(False))))
        data_hits.append(F.count_if(F.coalesce(E.search(t, r"@.*\."), F.lit(False))))
    d = df.agg((sum_cols([(h > 0).cast("int") for h in data_hits]) if data_hits else F.lit(0))
               .alias("__data_phi")).scalar()
    both = iss.withColumn("__data_phi", d)
    structs = []
    for s in standards:
        if s == "hipaa":
            n = (F.col("hipaa") + F.col("__data_phi")).cast("long")
            score = F.when(n > 0, F.lit(50.0)).otherwise(F.lit(100.0))
        else:
            n = F.col(s).cast("long")
            score = F.greatest(F.lit(0), F.lit(100) - 10 * n).cast("double")
        structs.append(F.struct(F.lit(s).alias("standard"), n.alias("n_issues"),
                                score.alias("score"), (n == 0).alias("compliant")))
    return both.select(F.inline(F.array(*structs)))


def merged_report(df: DataFrame, issues: DataFrame, report: ComplianceReport, standards: list[str] | None = None,
                  template: str | None = None) -> DataFrame:
    """C18 in full: ``part, name, score, n``.  The rows (part ``standard``) of ``standards_report``, with those
    that the engine scores itself taken from ``report`` (hipaa, gdpr, fda and the three coding standards as
    ``medical_coding``: their mean score and summed count); one row ``overall`` (name: the risk level, n: all
    violations) and, with a template, one row ``template``."""
    engine = report.scores()
    coding = F.col("standard").isin(*P.CODING_CHECKS)
    own = engine.where(~coding).select("standard", "score", F.col("violations_count").alias("n"))
    own = own.unionByName(engine.where(coding).agg(F.avg("score").alias("score"), F.sum("violations_count").alias("n"))
                          .select(F.lit("medical_coding").alias("standard"), "score", "n"))
    rest = standards_report(df, issues, standards).where(~F.col("standard").isin("hipaa", "gdpr", "fda"))
    rows = own.unionByName(rest.select("standard", "score", F.col("n_issues").alias("n")))
    total = report.overall()
    out = (rows.select(F.lit("standard").alias("part"), F.col("standard").alias("name"), "score", F.col("n").cast("long").alias("n"))
           .unionByName(total.select(F.lit("overall").alias("part"), F.col("risk_level").alias("name"), F.col("overall_score").alias("score"),
                                     F.col("total_violations").cast("long").alias("n"))))
    if template is None:
        return out
    return out.unionByName(total.select(F.lit("template").alias("part"), F.lit(template).alias("name"),
                                        F.lit(None).cast("double").alias("score"), F.lit(None).cast("long").alias("n")))


def cli_standards_report(issues: DataFrame) -> DataFrame:
    """C20: per-standard issue counts from messages (both ICD-10 spellings, Quirk 15)."""
    msg = F.col("message")
    return issues.agg(
        F.count_if(_mentions(msg, ["phi", "pii"])).alias("hipaa_issues"),
        F.count_if(_mentions(msg, ["icd-10", "icd10"])).alias("icd10_issues"),
        F.count_if(_mentions(msg, ["loinc"])).alias("loinc_issues"),
        F.count_if(_mentions(msg, ["cpt"])).alias("cpt_issues"))


# --------------------------------------------------------------------------
# Catalog form of C5/C6 and P7 over many tables
# --------------------------------------------------------------------------
def fda_catalog(cols: DataFrame) -> DataFrame:
    """C5/C6 over a columns table: one violation row per table and check."""
    out = None
    for std, rid, sev, tokens, prefix, rec in P.FDA_CHECKS:
        m = K.missing_tokens(cols, tokens).where(F.size("missing") > 0).select(
            "table_name", F.lit(std).alias("standard"), F.lit(rid).alias("rule_id"),
            F.lit(sev).alias("severity"), F.lit("system").alias("field"),
            F.concat(F.lit(prefix), F.array_join("missing", ", ")).alias("message"),
            F.lit(rec).alias("recommendation"))
        out = m if out is None else out.unionByName(m)
    return out


def rule_targets(cols: DataFrame, rules: list[CustomRule]) -> DataFrame:
    """(table, column, rule) pairs whose column name matches the rule's
    ``field_pattern`` case-insensitively -- a per-column filter over a literal
    array of the (few) rules, no join."""
    arr = F.array(*[F.struct(F.lit(r.name).alias("rule_id"),
                             F.lit(r.field_pattern).cast("string").alias("field_pattern"))
                    for r in rules])
    sel = F.filter(arr, lambda r: r["field_pattern"].isNull() |
                   F.regexp_like(F.col("column_name"), F.concat(F.lit("(?i)"), r["field_pattern"])))
    return cols.select("table_name", "column_name", F.explode(sel).alias("r")).select(
        "table_name", "column_name", "r.rule_id")
