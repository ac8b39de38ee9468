"""Sources S1-S7 and sinks K1-K4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carecheck.functions import patterns as P

FORMATS = {"csv": "csv", "json": "json", "parquet": "parquet"}


def read_table(spark: SparkSession, path: str, fmt: str | None = None, schema=None,
               infer_schema: bool = True, multi_line: bool | None = None) -> DataFrame:
    """Read CSV (header, inferred types), JSON or Parquet by suffix;
    unknown suffix -> ValueError.  A missing path raises Spark's
    AnalysisException at read time.

    JSON lines are read line by line (splittable).  A single document -- an
    array of records, or one object of columns (see ``from_columns``) -- needs
    ``multi_line``; left open, it is taken where the first line is not an
    object of its own (one line is read to tell)."""
    if fmt is None:
        base = path.rstrip("/").split("/")[-1]
        ext = base.rsplit(".", 1)[-1].lower() if "." in base else ""
        if ext not in FORMATS:
            raise ValueError("Unsupported file format")
        fmt = FORMATS[ext]
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    if fmt == "csv":
        return r.option("header", True).option("inferSchema", infer_schema and schema is None).csv(path)
    if fmt == "json":
        if multi_line is None:
            multi_line = _one_document(spark, path)
        out = r.option("multiLine", multi_line).json(path)
        arrays = [f.name for f in out.schema.fields if f.dataType.typeName() == "array"]
        # one object that only holds arrays is a column-oriented payload
        return from_columns(out, arrays) if multi_line and arrays and len(arrays) == len(out.columns) and schema is None else out
    if fmt == "parquet":
        return r.parquet(path)
    raise ValueError("Unsupported file format")


def _one_document(spark: SparkSession, path: str) -> bool:
    """Does the first line with text not hold a whole JSON object?"""
    first = spark.read.text(path).where(F.length(F.btrim("value")) > 0).select(
        F.btrim("value").startswith("{").alias("opens"), F.expr("try_parse_json(value) IS NOT NULL").alias("whole"),
        F.expr("try_variant_get(try_parse_json(value), '$', 'map<string,variant>')").alias("object")).head(2)
    if not first:
        return False
    if not (first[0]["opens"] and first[0]["whole"]):
        return True
    # a lone one-line object whose values are all arrays holds columns
    values = list((first[0]["object"] or {}).values())
    return len(first) == 1 and bool(values) and all(isinstance(v.toPython(), list) for v in values)


def from_records(spark: SparkSession, json_lines: DataFrame, schema: str) -> DataFrame:
    """A column ``value`` of JSON objects (list-of-dicts payload) -> rows."""
    return json_lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def from_columns(df: DataFrame, array_cols: list[str], scalar_cols: list[str] | None = None) -> DataFrame:
    """A column-oriented payload (one row holding one array per column)
    -> rows.  Shorter arrays are padded with NULL to the longest; scalars are
    repeated on every row; an empty payload gives zero rows."""
    scalar_cols = scalar_cols or []
    longest = F.greatest(*[F.coalesce(F.size(c), F.lit(0)) for c in array_cols]) if len(array_cols) > 1 \
        else F.coalesce(F.size(array_cols[0]), F.lit(0))
    arrays = [F.col(c) for c in array_cols] + [F.array_repeat(F.col(c), longest) for c in scalar_cols]
    names = list(array_cols) + list(scalar_cols)
    z = F.arrays_zip(*[a.alias(n) for a, n in zip(arrays, names)])
    return df.select(F.inline(z))


def file_manifest(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """S7 input: (path, length, modificationTime) of files, via the binaryFile
    source with the content column pruned away (only metadata is read)."""
    r = spark.read.format("binaryFile")
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.load(path).select("path", "length", "modificationTime")


def admit_files(manifest: DataFrame, name_col: str = "path", size_col: str = "length",
                max_bytes: int = P.MAX_UPLOAD_BYTES) -> DataFrame:
    """Extension allow-list, size limit and safe file name, per file."""
    fname = F.element_at(F.split(F.col(name_col), "/"), -1)
    ext = F.lower(F.element_at(F.split(fname, r"\."), -1))
    has_dot = F.instr(fname, ".") > 0
    ok_ext = has_dot & ext.isin(*P.ALLOWED_EXTENSIONS)
    ok_size = F.col(size_col) <= F.lit(max_bytes)
    ok_name = fname.rlike(P.SAFE_FILENAME)
    reason = (F.when(~ok_ext, "Invalid file type").when(~ok_size, "File too large")
              .when(~ok_name, "Invalid filename"))
    return manifest.select("*", fname.alias("file_name"), (ok_ext & ok_size & ok_name).alias("admitted"),
                           reason.alias("reason"))


# --------------------------------------------------------------------------
# Sinks
# --------------------------------------------------------------------------
def result_json(issues: DataFrame) -> DataFrame:
    """K1/K4: one row: is_valid, counts and the issue list as JSON text."""
    s = F.col("severity")
    return issues.agg(
        (~F.coalesce(F.bool_or(s == "error"), F.lit(False))).alias("is_valid"),
        F.count(F.lit(1)).alias("total_issues"), F.count_if(s == "error").alias("error_count"),
        F.count_if(s == "warning").alias("warning_count"), F.count_if(s == "info").alias("info_count"))


def result_document(issues: DataFrame, summary: DataFrame | None = None) -> DataFrame:
    """K1: one JSON text with validity, counts, the issue list and, when given,
    the one-row ``summary`` (``validate.summarize``).  The list
    is bounded by the number of checks (not by the data) for a single
    validation; batch validations should write ``issues`` as a table instead."""
    s = F.col("severity")
    more = [] if summary is None else [summary.select(F.struct(*summary.columns)).scalar().alias("summary")]
    return issues.agg(
        F.to_json(F.struct(
            (~F.coalesce(F.bool_or(s == "error"), F.lit(False))).alias("is_valid"),
            F.count(F.lit(1)).alias("total_issues"), F.count_if(s == "error").alias("error_count"),
            F.count_if(s == "warning").alias("warning_count"), F.count_if(s == "info").alias("info_count"),
            F.collect_list(F.struct("severity", "message", F.col("column_name").alias("column"),
                                    F.col("rule_name"), "row", "value")).alias("issues"), *more)).alias("json"))


def write_issues(issues: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """K1: persist issue rows (any Spark file format)."""
    issues.write.mode(mode).format(fmt).save(path)


def report_lines(issues: DataFrame, counts: DataFrame, order_by: list[str] | None = None,
                 timestamp: str = "", rules: list | None = None) -> DataFrame:
    """K3: the text report as ordered lines ``(line_no, line)``: header, status,
    the four counts, then per issue a numbered line and its location line.
    Issue numbering uses the distributed row index over ``order_by``; with
    ``rules`` (rule objects or names) issues come in the order of the rules
    that found them, those of other rules last."""
    if rules and not order_by:
        names = F.array(*[F.lit(r if isinstance(r, str) else r.name) for r in rules])
        place = F.array_position(names, F.col("rule_name"))
        issues = issues.withColumn("__rule", F.when(place > 0, place).otherwise(len(rules) + 1))
        order_by = ["__rule", "check_id"]
    order_by = order_by or ["severity", "check_id"]
    from carecheck.plans.rowindex import with_row_index
    numbered = with_row_index(issues, order_by, "__i")
    base = F.col("__i") * 4 + 100
    place = F.concat(F.coalesce(F.concat(F.lit("Column: "), "column_name"), F.lit("")),
                     F.coalesce(F.concat(F.lit(", Row: "), F.col("row").cast("string")), F.lit("")))
    loc = F.when(place != "", F.concat(F.lit("   Location: "), place))
    body = numbered.select(F.inline(F.array(
        F.struct(base.alias("line_no"),
                 F.format_string("%d. [%s] %s", F.col("__i") + 1, F.upper("severity"), F.col("message")).alias("line")),
        F.struct((base + 1).alias("line_no"), loc.alias("line")),
        F.struct((base + 2).alias("line_no"), F.concat(F.lit("   Value: "), "value").alias("line")),
        F.struct((base + 3).alias("line_no"), F.lit("").alias("line"))))).where(F.col("line").isNotNull())
    fixed = [P.REPORT_TITLE, P.REPORT_RULE, f"Timestamp: {timestamp}"]
    heads = [F.struct(F.lit(i).cast("long").alias("line_no"), F.lit(t).alias("line")) for i, t in enumerate(fixed)]
    status = F.concat(F.lit("Overall Status: "), F.when(F.col("is_valid"), P.REPORT_VALID).otherwise(P.REPORT_INVALID))
    more = [status, F.lit(""), F.lit("Summary:"),
            F.format_string("  - Total Issues: %d", "total_issues"), F.format_string("  - Errors: %d", "error_count"),
            F.format_string("  - Warnings: %d", "warning_count"), F.format_string("  - Info: %d", "info_count"),
            F.lit(""),
            F.when(F.col("total_issues") > 0, F.lit("Issues Found:")),
            F.when(F.col("total_issues") > 0, F.lit(P.REPORT_ISSUES_RULE))]
    heads += [F.struct(F.lit(len(fixed) + i).cast("long").alias("line_no"), c.alias("line"))
              for i, c in enumerate(more)]
    head = counts.select(F.inline(F.array(*heads))).where(F.col("line").isNotNull())
    return head.unionByName(body)


def write_report(lines: DataFrame, path: str, files: int = 1) -> None:
    """K3 sink: the report lines as text, in line order within and across the files.  The report of one
    validation has a few lines per issue (bounded by the checks, not by the data) and is one file; the issues
    of batches grow with the data, give them ``files``."""
    lines.repartitionByRange(files, "line_no").sortWithinPartitions("line_no") \
        .select(F.coalesce("line", F.lit("")).alias("value")).write.mode("overwrite").text(path)


def compliance_json(scores: DataFrame) -> DataFrame:
    """K2: standards_checked, overall_compliant, total_issues, details as JSON."""
    return scores.agg(
        F.collect_list("standard").alias("standards_checked"),  # one row per standard: bounded
        F.coalesce(F.bool_and("compliant"), F.lit(True)).alias("overall_compliant"),
        F.sum("violations_count").alias("total_issues"),
        F.to_json(F.collect_list(F.struct("standard", "score", "risk_level", "violations_count",
                                          "compliant"))).alias("details"))
