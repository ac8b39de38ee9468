"""Rule catalog: profiles V15, registry V16, option-driven rule sets V17,
custom-rule management C14/C15, compliance templates C16/C17.

Rules, profiles and templates are *rows*.  Choosing, listing, upserting and
deleting rule sets are DataFrame operations over those rows; the chosen
(small) rows are then compiled into rule objects whose checks are fused into
one aggregation by the orchestrator.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from carecheck.functions import patterns as P
from carecheck.operators.compliance import RULE_CATALOG_SCHEMA, CustomRule, rules_from_rows
from carecheck.operators.rules import (DataQualityChecker, DateValidator, MedicalCodeValidator,
                                       PHIDetector, RangeValidator, Rule, SchemaValidator)

PROFILE_SCHEMA = "profile string, kind string, column_name string, arg1 string, arg2 string"


# --------------------------------------------------------------------------
# Profiles (V15) and registry
# --------------------------------------------------------------------------
def profile_catalog(spark: SparkSession) -> DataFrame:
    rows = [(p, k, c, None if a is None else str(a), None if b is None else str(b))
            for p, k, c, a, b in P.PROFILE_RULES]
    return spark.createDataFrame(rows, PROFILE_SCHEMA)


def list_profiles(catalog: DataFrame) -> DataFrame:
    return catalog.select("profile").distinct()


def _num(x: str | None):
    if x is None:
        return None
    v = float(x)
    return int(v) if v.is_integer() and "." not in x else v


def compile_profile_rows(rows) -> list[Rule]:
    """Turn the (few) catalog rows of one profile into rule objects, in the
    order schema, PHI, quality, codes, ranges, dates."""
    required, types, codes, ranges, dates = [], {}, {}, {}, {}
    phi = quality = False
    for r in rows:
        k, c = r["kind"], r["column_name"]
        if k == "required":
            required.append(c)
        elif k == "type":
            types[c] = r["arg1"]
        elif k == "phi":
            phi = True
        elif k == "quality":
            quality = True
        elif k == "code":
            codes[c] = r["arg1"]
        elif k == "range":
            cfg = {}
            if r["arg1"] is not None:
                cfg["min"] = _num(r["arg1"])
            if r["arg2"] is not None:
                cfg["max"] = _num(r["arg2"])
            ranges[c] = cfg
        elif k == "date":
            dates.setdefault((r["arg1"], r["arg2"]), []).append(c)
    rules: list[Rule] = []
    if required or types:
        rules.append(SchemaValidator(required, types))
    if phi:
        rules.append(PHIDetector())
    if quality:
        rules.append(DataQualityChecker())
    if codes:
        rules.append(MedicalCodeValidator(codes))
    if ranges:
        rules.append(RangeValidator(ranges))
    for (lo, hi), cols in dates.items():
        rules.append(DateValidator(cols, lo, hi))
    return rules


def profile_rules(name: str, catalog: DataFrame | None = None) -> list[Rule] | None:
    """V16 ``get_profile``: rules of a profile; unknown name -> None.

    With no catalog the fixed profile rows are used directly (plan-time data).
    """
    if catalog is None:
        rows = [dict(zip(["profile", "kind", "column_name", "arg1", "arg2"],
                         (p, k, c, None if a is None else str(a), None if b is None else str(b))))
                for p, k, c, a, b in P.PROFILE_RULES if p == name]
    else:
        rows = [r.asDict() for r in catalog.where(F.col("profile") == name).collect()]  # few rule rows
    return compile_profile_rows(rows) if rows else None


def registered_profiles() -> list[str]:
    """The names the registry answers for (the other profiles belong to the real-data benchmarks)."""
    return list(P.REGISTRY_PROFILES)


def register_profile(catalog: DataFrame, name: str, rows: list[tuple]) -> DataFrame:
    """V16 ``register_profile``: append rule rows for a new profile."""
    spark = catalog.sparkSession
    new = spark.createDataFrame([(name, k, c, a, b) for k, c, a, b in rows], PROFILE_SCHEMA)
    return catalog.where(F.col("profile") != name).unionByName(new)


# --------------------------------------------------------------------------
# Options -> rule set
# --------------------------------------------------------------------------
def rules_from_options(profile: str | None = None, phi: bool = True, quality: bool = True,
                       always_quality: bool = True, required_columns=None, column_types=None) -> list[Rule]:
    """Profile wins outright; otherwise quality (always on for parity with the
    HTTP path, Quirk 10, unless ``always_quality=False``), optional PHI, and a
    schema rule when required columns / types are given (CLI variant)."""
    if profile:
        r = profile_rules(profile)
        if r is not None:
            return r
    rules: list[Rule] = []
    if required_columns or column_types:
        rules.append(SchemaValidator(required_columns, column_types))
    if phi:
        rules.append(PHIDetector())
    if quality or always_quality:
        rules.append(DataQualityChecker())
    return rules


# --------------------------------------------------------------------------
# Compliance templates (C16/C17) and custom-rule storage
# --------------------------------------------------------------------------
TEMPLATE_SCHEMA = ("template string, template_description string, rule_id string, description string, "
                   "pattern string, severity string, field_pattern string, recommendation string")


def template_catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(P.TEMPLATE_RULES), TEMPLATE_SCHEMA)


def list_templates(catalog: DataFrame) -> DataFrame:
    """C17 ``list_templates``: name -> description."""
    return catalog.groupBy("template").agg(F.first("template_description").alias("description"))


def template_rules(name: str) -> list[CustomRule]:
    """C17 ``get_template``/``apply_template``: rules of a template ([] if unknown)."""
    return [CustomRule(rid, pat, desc, sev, fp, rec)
            for t, _, rid, desc, pat, sev, fp, rec in P.TEMPLATE_RULES if t == name]


def template_known(name: str) -> bool:
    return any(t == name for t, *_ in P.TEMPLATE_RULES)


def create_custom_template(catalog: DataFrame, name: str, description: str,
                           rules: list[CustomRule]) -> DataFrame:
    spark = catalog.sparkSession
    new = spark.createDataFrame(
        [(name, description, r.name, r.description, r.pattern, r.severity, r.field_pattern,
          r.recommendation) for r in rules], TEMPLATE_SCHEMA)
    return catalog.where(F.col("template") != name).unionByName(new)


def empty_rule_store(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], RULE_CATALOG_SCHEMA)


def rule_rows(spark: SparkSession, rules: list[CustomRule], ruleset: str = "custom",
              version: int = 1) -> DataFrame:
    """Rule-catalog rows; a rule needs a name and a pattern (ValueError otherwise)."""
    for r in rules:
        if not r.name or not r.pattern:
            raise ValueError("Rule name and pattern are required")
    return spark.createDataFrame(
        [(ruleset, r.name, r.description, r.pattern, r.severity, r.field_pattern, r.recommendation,
          version) for r in rules], RULE_CATALOG_SCHEMA)


def upsert_rules(store: DataFrame, updates: DataFrame) -> DataFrame:
    """C14 add / C15 upsert by (ruleset, rule_id): the highest version wins."""
    w = Window.partitionBy("ruleset", "rule_id").orderBy(F.col("version").desc())
    return (store.unionByName(updates).withColumn("__rn", F.row_number().over(w))
            .where("__rn = 1").drop("__rn"))


def delete_rules(store: DataFrame, ruleset: str, rule_ids: list[str]) -> DataFrame:
    """C14 remove / C15 delete by name: left-anti join on the doomed keys."""
    spark = store.sparkSession
    doomed = spark.createDataFrame([(ruleset, r) for r in rule_ids], "ruleset string, rule_id string")
    return store.join(F.broadcast(doomed), ["ruleset", "rule_id"], "left_anti")


def rule_exists(store: DataFrame, ruleset: str, rule_id: str) -> bool:
    """Whether a rule is stored (the reference answers 404 / False otherwise)."""
    return not store.where((F.col("ruleset") == ruleset) & (F.col("rule_id") == rule_id)).isEmpty()


def load_rules(store: DataFrame, ruleset: str = "custom") -> list[CustomRule]:
    """Chosen rule rows (small) compiled for the compliance engine."""
    return rules_from_rows(store.where(F.col("ruleset") == ruleset).collect())


class RuleStore:
    """A rule table in a folder that several writers change safely.

    Every change is one commit: a folder ``v<number>`` with the rows that it
    adds (a deleted rule is a row without a pattern).  The rows are written to
    a folder of their own first and then renamed to the next number; the
    rename fails when another writer has taken that number, and the change is
    tried again on top of it (this needs a file system whose folder renames
    are atomic, as HDFS and local ones are).  Readers take a snapshot: the commits up to a
    number, the highest one winning by (ruleset, rule_id)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm.org.apache.hadoop.fs
        self._at = jvm.Path
        self._fs = jvm.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The number of the last commit; 0 before any."""
        if not self._fs.exists(self._at(self.path)):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at(self.path))]
        return max([0, *[int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit()]])

    def _commits(self, version: int) -> DataFrame:
        if not version:
            return empty_rule_store(self.spark)
        return self.spark.read.schema(empty_rule_store(self.spark).schema).parquet(*[f"{self.path}/v{k:012d}" for k in range(1, version + 1)])

    def snapshot(self, version: int | None = None) -> DataFrame:
        """The rules as of a commit (the last one if not given)."""
        rows = self._commits(self.version() if version is None else version)
        w = Window.partitionBy("ruleset", "rule_id").orderBy(F.col("version").desc())
        return rows.withColumn("__rn", F.row_number().over(w)).where("__rn = 1 and pattern is not null").drop("__rn")

    def _commit(self, rows, retries: int = 20) -> int:
        """``rows(version)`` gives the rows of a commit, None when there is nothing to do."""
        staged = f"{self.path}/_staged-{uuid.uuid4().hex}"
        for _ in range(retries):
            number = self.version() + 1
            new = rows(number)
            if new is None:
                return 0
            new.coalesce(1).write.mode("overwrite").parquet(staged)  # the rows of one change
            target = self._at(f"{self.path}/v{number:012d}")
            # renaming into an existing folder would move below it: the number must be free and stay so
            if not self._fs.exists(target) and self._fs.rename(self._at(staged), target):
                below = self._at(target, staged.rsplit("/", 1)[-1])
                if not self._fs.exists(below):
                    return number
                self._fs.rename(below, self._at(staged))  # another writer was there first
        raise RuntimeError("the rule store is changed by others all the time")

    def upsert(self, rules: list[CustomRule], ruleset: str = "custom") -> int:
        """Adds or replaces rules by name; the commit's number."""
        return self._commit(lambda number: rule_rows(self.spark, rules, ruleset, number))

    def delete(self, rule_id: str, ruleset: str = "custom") -> bool:
        """Removes a rule by name; False when there is none (the reference answers 404)."""
        def gone(number):
            if not rule_exists(self.snapshot(number - 1), ruleset, rule_id):
                return None
            return self.spark.createDataFrame([(ruleset, rule_id, None, None, None, None, None, number)], RULE_CATALOG_SCHEMA)

        return bool(self._commit(gone))
