"""PHI inventory H1-H3, plain-text audit U1, de-identification A1-A5,
sanitising D1-D2.

Detection is one fused aggregate (columns x patterns).  De-identification is
a projection (``withColumns``) -- no shuffle except the position-numbered
pseudonyms (A1a/A1d), which use the distributed row index.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carecheck.functions import exprs as E
from carecheck.functions import patterns as P
from carecheck.plans.rowindex import with_row_index
from carecheck.session import shared_table


def _found(t: Column, pat: str) -> Column:
    return F.coalesce(E.search(t, pat), F.lit(False))


# --------------------------------------------------------------------------
# H1-H3
# --------------------------------------------------------------------------
def phi_inventory(df: DataFrame, patterns: dict[str, str] | None = None, k: int = 3,
                  order_by: list[str] | None = None) -> DataFrame:
    """H1: (column_name, phi_type, pattern, instances, sample_values) for every
    (column, type) with at least one matching row.

    With ``order_by`` every pattern is evaluated once per value: one scan writes
    the keys of rows with any hit and, per column, a bit for each type.  Counts
    and the keys of each check's first ``k`` rows (a partial top-k per task)
    come from that table; the values are then read for these few rows only
    (``k`` per column and type, which bounds the broadcast).  Without
    ``order_by`` the first values are the smallest ones: one scan counts, a
    second one evaluates the patterns that matched somewhere."""
    spark = df.sparkSession
    patterns = patterns or P.HIPAA_PHI_PATTERNS
    checks = []
    for f in df.schema.fields:
        t = E.as_text(f.name, f.dataType)
        for ptype, pat in patterns.items():
            checks.append((f.name, ptype, pat, _found(t, pat), t))
    hits = _hits(df, checks, order_by) if order_by else None
    counts = (df.agg(*[F.count_if(h).alias(f"c{i}") for i, (_, _, _, h, _) in enumerate(checks)]) if hits is None else
              hits.agg(*[F.count_if(_bit(i)).alias(f"c{i}") for i in range(len(checks))])).first()
    live = [(c, pt, pat, h, t, int(counts[f"c{i}"]), i) for i, (c, pt, pat, h, t) in enumerate(checks)
            if counts[f"c{i}"]]
    schema = "column_name string, phi_type string, pattern string, instances long"
    inv = spark.createDataFrame([(c, pt, pat, n) for c, pt, pat, _, _, n, _ in live], schema)
    if not live:
        return inv.withColumn("sample_values", F.lit(None).cast("array<string>"))
    few = df if hits is None else _first_rows(df, hits, [i for *_, i in live], k, order_by)
    samples = _first_values(few, [(f"{c}\u0000{pt}", h, t) for c, pt, _, h, t, _, _ in live], k, order_by)
    samples = samples.select(F.split_part("__cid", F.lit("\u0000"), F.lit(1)).alias("column_name"),
                             F.split_part("__cid", F.lit("\u0000"), F.lit(2)).alias("phi_type"),
                             "sample_values")
    return inv.join(F.broadcast(samples), ["column_name", "phi_type"], "left")


BITS = 62  # checks per integer of the hit table


def _bit(i: int) -> Column:
    return F.col(f"__b{i // BITS}").bitwiseAND(F.lit(1 << i % BITS)) != 0


def _hits(df: DataFrame, checks: list[tuple], order_by: list[str]) -> DataFrame:
    """The keys of the rows that meet any check, with a bit for each check; a written table."""
    words = []
    for lo in range(0, len(checks), BITS):
        one = [F.when(h, F.lit(1 << n)).otherwise(F.lit(0)) for n, (_, _, _, h, _) in enumerate(checks[lo:lo + BITS])]
        words.append(reduce(lambda a, b: a.bitwiseOR(b), [x.cast("long") for x in one]).alias(f"__b{lo // BITS}"))
    keys = [F.col(E.quote(o)).alias(f"__k{n}") for n, o in enumerate(order_by)]
    any_hit = reduce(lambda a, b: a | b, [F.col(f"__b{n}") != 0 for n in range(len(words))])
    return shared_table(df.select(*keys, *words).where(any_hit), "phi-hits")


def _first_rows(df: DataFrame, hits: DataFrame, checks: list[int], k: int, order_by: list[str]) -> DataFrame:
    """The rows of ``df`` that can be among the first ``k`` of a check."""
    from pyspark.sql import Window
    keys = [F.col(f"__k{n}") for n in range(len(order_by))]
    met = F.filter(F.array(*[F.when(_bit(i), F.lit(i)) for i in checks]), lambda x: x.isNotNull())
    each = hits.select(*keys, F.explode(met).alias("__check"))
    w = Window.partitionBy("__check").orderBy(*keys)
    first = each.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= k).select(*keys).distinct()
    same = reduce(lambda a, b: a & b, [F.col(E.quote(o)).eqNullSafe(F.col(f"__k{n}")) for n, o in enumerate(order_by)])
    return df.join(F.broadcast(first), same, "left_semi")  # k rows per check at most


def _first_values(df: DataFrame, items: list[tuple[str, Column, Column]], k: int,
                  order_by: list[str] | None) -> DataFrame:
    """For each (id, predicate, value): first ``k`` values where predicate holds."""
    from pyspark.sql import Window
    stacked = F.array(*[F.when(pred, F.struct(F.lit(cid).alias("cid"), val.cast("string").alias("v")))
                        for cid, pred, val in items])
    keys = [F.col(E.quote(o)) for o in (order_by or [])]
    # explode + filter (no lambda: the predicates may hold a scalar subquery)
    base = df.select(*keys, F.explode(stacked).alias("s")).where(F.col("s").isNotNull())
    w = Window.partitionBy("s.cid").orderBy(*(keys or [F.col("s.v")]))
    top = base.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= k)
    return (top.groupBy(F.col("s.cid").alias("__cid"))
            .agg(F.array_sort(F.collect_list(F.struct("__rn", F.col("s.v").alias("v")))).alias("__s"))
            .select("__cid", F.transform("__s", lambda x: x["v"]).alias("sample_values")))


def phi_score(inventory: DataFrame) -> DataFrame:
    """H2: one row (compliant, compliance_score, total_phi_instances, phi_columns)."""
    return inventory.agg(
        F.count_distinct("column_name").alias("phi_columns"),
        F.count(F.lit(1)).alias("total_phi_instances")).select(
        (F.col("total_phi_instances") == 0).alias("compliant"),
        F.greatest(F.lit(0), F.lit(100) - 10 * F.col("phi_columns")).cast("long").alias("compliance_score"),
        F.col("total_phi_instances").cast("long").alias("total_phi_instances"),
        F.col("phi_columns").cast("long").alias("phi_columns"))


def phi_recommendations(inventory: DataFrame) -> DataFrame:
    """H3: (ordinal, recommendation) -- fixed lines chosen by detected types."""
    types = inventory.agg(F.collect_set("phi_type").alias("types"))  # <= 14 distinct values
    structs = [F.struct(F.lit(0).alias("ordinal"), F.lit(P.PHI_FOUND_RECOMMENDATION).alias("recommendation"),
                        (F.size("types") > 0).alias("__on"))]
    for i, (t, rec) in enumerate(P.PHI_TYPE_RECOMMENDATIONS, start=1):
        structs.append(F.struct(F.lit(i).alias("ordinal"), F.lit(rec).alias("recommendation"),
                                F.array_contains("types", t).alias("__on")))
    structs.append(F.struct(F.lit(len(structs)).alias("ordinal"),
                            F.lit(P.NO_PHI_RECOMMENDATION).alias("recommendation"),
                            (F.size("types") == 0).alias("__on")))
    return types.select(F.inline(F.array(*structs))).where("__on").drop("__on")


# --------------------------------------------------------------------------
# U1
# --------------------------------------------------------------------------
def plaintext_audit(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(issues, summary)``.  issues: one row per (pattern, column) hit with
    message and recommendation; summary: security_score, overall_status."""
    items = []
    for pname, pat in P.AUDIT_PATTERNS:
        for f in df.schema.fields:
            items.append((pname, f.name, _found(E.as_text(f.name, f.dataType), pat)))
    one = df.agg(*[F.bool_or(h).alias(f"__h{i}") for i, (_, _, h) in enumerate(items)])
    structs = [F.struct(F.lit(p).alias("pattern_name"), F.lit(c).alias("column_name"),
                        F.lit(f"Sensitive data detected in column '{c}' without encryption").alias("issue"),
                        F.lit(f"Encrypt column '{c}' or apply anonymization").alias("recommendation"),
                        F.coalesce(F.col(f"__h{i}"), F.lit(False)).alias("__on"))
               for i, (p, c, _) in enumerate(items)]
    issues = one.select(F.inline(F.array(*structs))).where("__on").drop("__on")
    summary = issues.agg(F.count(F.lit(1)).alias("n_issues")).select(
        "n_issues",
        F.greatest(F.lit(0), F.lit(100) - P.AUDIT_PENALTY * F.col("n_issues")).cast("long").alias("security_score"))
    summary = summary.withColumn(
        "overall_status", F.when(F.col("security_score") >= P.AUDIT_SECURE_SCORE, "SECURE")
        .otherwise("NEEDS_ATTENTION"))
    return issues, summary


def audit_recommendations(issues: DataFrame) -> DataFrame:
    """Per-hit recommendations followed by the six fixed lines."""
    spark = issues.sparkSession
    fixed = spark.createDataFrame([(i + 1_000_000, r) for i, r in enumerate(P.AUDIT_FIXED_RECOMMENDATIONS)],
                                  "ordinal long, recommendation string")
    hits = issues.select(F.lit(0).cast("long").alias("ordinal"), "recommendation")
    return hits.unionByName(fixed)


# --------------------------------------------------------------------------
# A1-A5
# --------------------------------------------------------------------------
def hash_value(c: Column, salt: str) -> Column:
    """A2: first 8 hex chars of SHA-256 over str(value) + salt; NULL stays NULL."""
    s = c.cast("string")
    return F.when(s.isNull(), F.lit(None).cast("string")).otherwise(
        F.substring(F.sha2(F.concat(s, F.lit(salt)), 256), 1, 8))


def mask_value(c: Column, column_name: str) -> Column:
    """A3a-d by column-name keyword."""
    s = c.cast("string")
    low = column_name.lower()
    if "phone" in low:
        out = F.concat(F.lit("***-***-"), F.right(s, F.lit(4)))
    elif "ssn" in low:
        out = F.concat(F.lit("***-**-"), F.right(s, F.lit(4)))
    elif "email" in low:
        out = F.when(F.instr(s, "@") > 0,
                     F.concat(F.left(s, F.lit(3)), F.lit("***@"), F.split_part(s, F.lit("@"), F.lit(2))))\
            .otherwise(s)
    else:
        out = F.concat(F.left(s, F.lit(3)), F.lit("***"))
    return F.when(c.isNull(), F.lit(None).cast("string")).otherwise(out)


_STRPTIME_GUARDS = [  # (guard regex, Spark pattern) in the order tried
    (r"^\d{4}-(1[0-2]|0?[1-9])-(3[01]|[12]\d|0?[1-9])$", "y-M-d"),
    (r"^(1[0-2]|0?[1-9])/(3[01]|[12]\d|0?[1-9])/\d{4}$", "M/d/y"),
    (r"^(3[01]|[12]\d|0?[1-9])/(1[0-2]|0?[1-9])/\d{4}$", "d/M/y"),
    (r"^\d{4}/(1[0-2]|0?[1-9])/(3[01]|[12]\d|0?[1-9])$", "y/M/d"),
]


def generalize_date(c: Column, dt, on_fail: str = "keep") -> Column:
    """A4: year of a date; strings are tried in four formats; unparseable text
    is kept unchanged (Quirk 11) unless ``on_fail='redact'``."""
    if E.is_temporal(dt):
        return F.year(c).cast("string")
    s = c.cast("string")
    tries = [F.when(s.rlike(g), F.year(F.try_to_timestamp(s, F.lit(fmt)))) for g, fmt in _STRPTIME_GUARDS]
    year = F.coalesce(*tries).cast("string")
    fallback = s if on_fail == "keep" else F.lit(P.REDACTED)
    return F.when(c.isNull(), F.lit(None).cast("string")).otherwise(F.coalesce(year, fallback))


def safe_harbor_category(column_name: str) -> str:
    low = column_name.lower()
    for cat, kws in P.SAFE_HARBOR_CATEGORIES:
        if any(k in low for k in kws):
            return cat
    return "default"


def anonymize(df: DataFrame, columns: list[str], method: str = "hipaa_safe_harbor",
              salt: str | None = None, order_by: list[str] | None = None,
              on_fail: str = "keep", num_partitions: int | None = None) -> DataFrame:
    """A5: anonymise ``columns`` (absent ones skipped).

    ``order_by`` (unique) defines row positions for the ``Patient_%04d`` /
    ``ID_%06d`` pseudonyms; it is required only when such a column is present.
    """
    if method not in ("hipaa_safe_harbor", "hash", "mask"):
        raise ValueError(f"Unknown anonymization method: {method}")
    salt = salt if salt is not None else str(uuid.uuid4())
    types = {f.name: f.dataType for f in df.schema.fields}
    cols = [c for c in columns if c in types]
    need_index = method == "hipaa_safe_harbor" and any(
        safe_harbor_category(c) in ("names", "identifiers") for c in cols)
    out = df
    if need_index:
        if not order_by:
            raise ValueError("order_by is required for position-numbered pseudonyms")
        out = with_row_index(df, order_by, "__pos", num_partitions)
    repl = {}
    for c in cols:
        col = F.col(E.quote(c))
        if method == "hash":
            repl[c] = hash_value(col, salt)
        elif method == "mask":
            repl[c] = mask_value(col, c)
        else:
            cat = safe_harbor_category(c)
            if cat == "names":
                repl[c] = F.format_string("Patient_%04d", F.col("__pos"))
            elif cat == "dates":
                repl[c] = generalize_date(col, types[c], on_fail)
            elif cat in ("addresses", "contact"):
                repl[c] = F.lit(P.REDACTED)
            elif cat == "identifiers":
                repl[c] = F.format_string("ID_%06d", F.col("__pos"))
            else:
                repl[c] = hash_value(col, salt)
    out = out.withColumns(repl)
    return out.drop("__pos") if need_index else out


# --------------------------------------------------------------------------
# D1, D2
# --------------------------------------------------------------------------
def sanitize_text(c: Column) -> Column:
    """Delete dangerous HTML fragments, tags and injection characters."""
    out = c
    for pat in P.SANITIZE_PATTERNS:
        out = F.regexp_replace(out, "(?iud)" + pat, "")
    out = F.regexp_replace(out, "(?d)" + P.SANITIZE_TAG, "")
    for lit in P.SANITIZE_LITERALS:
        out = F.replace(out, F.lit(lit), F.lit(""))
    return out


def sanitize(df: DataFrame) -> DataFrame:
    """D1 over every string column; NULL stays NULL."""
    repl = {f.name: sanitize_text(F.col(E.quote(f.name))) for f in df.schema.fields if E.is_string(f.dataType)}
    return df.withColumns(repl)


_BAD_FILENAME = "[" + "".join("\\" + ch if ch in "\\^]-[" else ch for ch in P.FILENAME_BAD_CHARS) + "]"


def filename_valid(c: Column) -> Column:
    """No character of ``< > : " | ? * \\ /``."""
    return ~c.rlike(_BAD_FILENAME)


def sanitize_filename(c: Column) -> Column:
    """Replace each dangerous character with ``_``."""
    return F.translate(c, "".join(P.FILENAME_BAD_CHARS), "_" * len(P.FILENAME_BAD_CHARS))
