"""Secret scans with an incremental blob ledger.

Every version of a text is content-addressed by its SHA-256.  The ledger is a
table ``blob, rule, version, spans`` in a folder; a run scans only (blob, rule
version) pairs the ledger does not have, each distinct blob once however many
paths hold it, appends what it found (also empty findings: scanned is known),
and joins the findings back to every path.

Cases: null text counts as empty; null doc_id and repeated rows are paths like
any other; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carecheck.llm.common import match_spans, shared_dir

SPANS = "array<struct<s:int,e:int,m:string>>"
LEDGER = "blob binary, rule string, version int, spans array<struct<s:int,e:int>>"
_ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


@dataclass(frozen=True)
class Rule:
    name: str
    version: int
    pattern: str
    test: Callable[[Column], Column]  # cheap, true wherever the pattern can match
    valid: Callable[[Column], Column]

    def spans(self, t: Column) -> Column:
        return F.when(self.test(t), F.transform(F.filter(match_spans(t, self.pattern), lambda x: self.valid(x["m"])),
                                                lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))
                      ).otherwise(F.array().cast("array<struct<s:int,e:int>>"))


def _always(m: Column) -> Column:
    return F.lit(True)


#: a run of too few characters never matches a length bound from a later start either, so the bounds are in the patterns
BASE = (
    Rule("assign", 1, _ASSIGN, lambda t: t.rlike(_ASSIGN), lambda m: F.length(F.regexp_extract(m, _ASSIGN, 2)) >= 6),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}", lambda t: F.instr(t, "AKIA") > 0, _always),
    Rule("hex", 1, r"(?<![0-9a-f])[0-9a-f]{24,}", lambda t: t.rlike(r"[0-9a-f]{24}"), _always),
)
MORE = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", lambda t: F.instr(t, "PRIVATE KEY-----") > 0, _always),
    Rule("forge", 1, r"\bgh[pousr]_[A-Za-z0-9]{36,}", lambda t: t.rlike("gh[pousr]_"), _always),
)
RULES = BASE + MORE


def blobs(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(key).alias("doc_id"), F.unhex(F.sha2(t, 256)).alias("blob"), t.alias("t"))


def read_ledger(spark, path: str) -> DataFrame:
    """The ledger's rows; empty when nothing was written yet."""
    jvm = spark._jvm.org.apache.hadoop.fs
    p = jvm.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(f"{path}/run-*")


def scan(docs: DataFrame, ledger_path: str, rules=RULES) -> DataFrame:
    """Brings the ledger up to date; returns the rows it appended."""
    spark = docs.sparkSession
    ids = {r.name: f"{r.name}:{r.version}" for r in rules}
    ledger = read_ledger(spark, ledger_path)
    seen = (ledger.filter(F.concat_ws(":", "rule", "version").isin(list(ids.values())))
            .groupBy("blob").agg(F.collect_set(F.concat_ws(":", "rule", "version")).alias("seen")))
    todo = F.array_except(F.array(*[F.lit(x) for x in ids.values()]), F.coalesce("seen", F.array().cast("array<string>")))
    distinct = blobs(docs).select("blob", "t").dropDuplicates(["blob"])
    if not ledger.isEmpty():
        distinct = distinct.join(seen, "blob", "left")
    else:
        distinct = distinct.withColumn("seen", F.lit(None).cast("array<string>"))
    unseen = distinct.withColumn("todo", todo).filter(F.size("todo") > 0)
    found = F.array(*[F.when(F.array_contains("todo", ids[r.name]), F.struct(
        F.lit(r.name).alias("rule"), F.lit(r.version).alias("version"), r.spans(F.col("t")).alias("spans"))) for r in rules])
    new = unseen.select("blob", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("x")).select("blob", "x.*")
    path = f"{ledger_path}/run-{uuid.uuid4().hex}"
    new.write.parquet(path)
    return spark.read.schema(LEDGER).parquet(path)


def findings(docs: DataFrame, ledger_path: str, rules=RULES) -> DataFrame:
    """``doc_id, blob, found``: for every path the spans of its blob, ``found`` a map rule -> spans."""
    scan(docs, ledger_path, rules)
    now = F.lit(False)
    for r in rules:
        now = now | ((F.col("rule") == r.name) & (F.col("version") == r.version))
    known = (read_ledger(docs.sparkSession, ledger_path).filter(now & (F.size("spans") > 0))
             .groupBy("blob", "rule").agg(F.first("spans").alias("spans"))
             .groupBy("blob").agg(F.map_from_entries(F.collect_list(F.struct("rule", "spans"))).alias("found")))
    return blobs(docs).select("doc_id", "blob").join(known, "blob", "left")


def secrets(docs: DataFrame, ledger_path: str | None = None) -> DataFrame:
    """The contract's digest of ``findings``; without a ledger it starts a new one."""
    f = findings(docs, ledger_path or f"{shared_dir(docs.sparkSession)}/ledger-{uuid.uuid4().hex}")
    of = lambda name: F.coalesce(F.col("found")[name], F.array().cast("array<struct<s:int,e:int>>"))

    def ranked(i: int, name: str) -> Column:
        return F.transform(of(name), lambda x: F.struct(
            x["s"].alias("s"), F.lit(i).alias("i"),
            F.concat_ws(":", F.lit(name), x["s"].cast("string"), x["e"].cast("string")).alias("w")))

    def listed(rules) -> Column:
        every = F.concat(*[ranked(i, r.name) for i, r in enumerate(rules)])
        return F.array_join(F.transform(F.sort_array(every), lambda x: x["w"]), ",")

    return f.select("doc_id", *[F.size(of(r.name)).cast("bigint").alias(f"n_{r.name}") for r in BASE],
                    F.sha2(listed(BASE), 256).alias("base_sha256"), listed(RULES).alias("spans"))
