"""Quality rules as a short-circuit cascade.

Each rule's cost and rejection rate are estimated on a sample; rules then run
in the order of rejections per second, and a document leaves the cascade at
the first rule that rejects it (``CASE WHEN`` evaluates lazily).  The order
changes the cost only: a document is kept when no rule rejects it.

Cases: null text counts as empty (no words, rejected as too short); null
doc_id and repeated rows are scored like any other row; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import time
from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carecheck.llm.common import stored, words

MIN_WORDS = 50
MAX_REPEAT_PCT = 50
MAX_DUP_LINE_PCT = 50
MAX_SYMBOL_PCT = 10
MEAN_WORD_CHARS = (2, 20)
SAMPLE_FRACTION, SAMPLE_ROWS = 0.01, 2000  # bound of the sample the order is estimated on
COPIES, REPEATS = 2, 3  # of the sample in a timed job, and of the job
SHOWN = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")  # metrics that ``quality`` returns


def _lines_with_word() -> Column:
    return F.filter(F.split("t", "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\x0b\f\r"))) > 0)


def _dup_lines() -> Column:
    lines = _lines_with_word()
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint")


def _repeat_words() -> Column:
    """Words covered by 3-word windows that occur twice or more.  Windows are
    sorted by hash within the document; neighbours with equal words repeat."""
    last = F.size("ws") - 3
    at = lambda i, k: F.get(F.col("ws"), i + k)
    same = lambda i, j: F.reduce(F.array(*[F.lit(k) for k in range(3)]), F.lit(True),
                                 lambda acc, k: acc & (F.get(F.col("ws"), i + k) == F.get(F.col("ws"), j + k)))
    hashed = F.transform(F.sequence(F.lit(0), last),
                         lambda i: F.struct(F.xxhash64(at(i, 0), at(i, 1), at(i, 2)).alias("h"), i.alias("i")))

    def repeated(s: Column) -> Column:
        equal = lambda x, y: F.when(x["h"] == y["h"], same(x["i"], y["i"])).otherwise(False)
        return F.transform(F.filter(s, lambda x, j: F.coalesce(equal(x, F.get(s, j - 1)), F.lit(False))
                                    | F.coalesce(equal(x, F.get(s, j + 1)), F.lit(False))), lambda x: x["i"])

    # bound once through a one-element array, so the sort is not repeated per element
    starts = F.flatten(F.transform(F.array(F.sort_array(hashed)), repeated))
    covered = F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(i, i + 1, i + 2))))
    return F.when(last < 1, F.lit(0)).otherwise(F.size(covered)).cast("bigint")


#: metric name -> expression over t (text) and ws (its words)
METRICS: dict[str, Callable[[], Column]] = {
    "n_words": lambda: F.size("ws").cast("bigint"),
    "word_chars": lambda: F.length(F.array_join("ws", "")).cast("bigint"),
    "n_symbols": lambda: F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("bigint"),
    "n_lines": lambda: F.size(_lines_with_word()).cast("bigint"),
    "n_dup_lines": _dup_lines,
    "n_repeat_words": _repeat_words,
}


@dataclass(frozen=True)
class Rule:
    name: str
    needs: tuple[str, ...]
    rejects: Callable[..., Column]


RULES = (
    Rule("too_few_words", ("n_words",), lambda n: n < MIN_WORDS),
    Rule("repeated_words", ("n_repeat_words", "n_words"), lambda r, n: 100 * r > MAX_REPEAT_PCT * n),
    Rule("word_length", ("word_chars", "n_words"),
         lambda c, n: (c < MEAN_WORD_CHARS[0] * n) | (c > MEAN_WORD_CHARS[1] * n)),
    Rule("symbols", ("n_symbols", "n_words"), lambda s, n: 100 * s > MAX_SYMBOL_PCT * n),
    Rule("duplicate_lines", ("n_dup_lines", "n_lines"), lambda d, n: 100 * d > MAX_DUP_LINE_PCT * n),
)


def prepared(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    return (docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
            .withColumn("ws", words(F.col("t"))))


def rejecting(rule: Rule, have: set[str] = frozenset()) -> Column:
    """The rule's verdict; metrics not yet in the frame are computed on the spot."""
    return rule.rejects(*[F.col(m) if m in have else METRICS[m]() for m in rule.needs])


def estimate(docs: DataFrame, rules=RULES, fraction: float = SAMPLE_FRACTION, rows: int = SAMPLE_ROWS) -> list[dict]:
    """Cost in seconds per 1,000 rows and rejections of every rule on a bounded sample, the most rejections
    per cost first.

    A rule's job is timed ``REPEATS`` times over ``COPIES`` copies of the sample, in turn with the others and
    with a job that only reads it.  The least time counts, less the reading job's, so that what a job costs
    anyway is no part of it; costs are compared in powers of two, so that noise does not change the order."""
    base = docs.sample(fraction, seed=7).limit(rows)
    sample = stored(prepared(base), "quality-sample")
    copies = sample.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(COPIES))))
    nothing = F.coalesce(F.size("ws") + F.length("t") < 0, F.lit(False))
    jobs = [copies.agg(F.count_if(x), F.count(F.lit(1))) for x in (nothing, *[rejecting(r) for r in rules])]
    seconds, counts = [float("inf")] * len(jobs), [(0, 0)] * len(jobs)
    for _ in range(REPEATS):
        for k, job in enumerate(jobs):
            began = time.perf_counter()
            counts[k] = tuple(job.first())
            seconds[k] = min(seconds[k], time.perf_counter() - began)
    found = []
    for r, t, (rejected, n) in zip(rules, seconds[1:], counts[1:]):
        cost = 1000 * max(t - seconds[0], 0.0) / max(n, 1)
        found.append({"rule": r, "rejected": rejected // COPIES, "seconds": cost, "step": max(-10, math.ceil(math.log2(max(cost, 1e-9))))})
    return sorted(found, key=lambda x: (-x["rejected"] / 2.0 ** x["step"], x["step"]))  # equal ones stay in the given order


def cascade(df: DataFrame, ordered, have: set[str] = frozenset()) -> DataFrame:
    """Adds ``failed_rule``: the first rule in the given order that rejects,
    null when none does."""
    verdict = F.lit(None).cast("string")
    for r in reversed(list(ordered)):
        verdict = F.when(rejecting(r, have), F.lit(r.name)).otherwise(verdict)
    return df.withColumn("failed_rule", verdict)


def kept_documents(docs: DataFrame, rules=RULES) -> DataFrame:
    """``doc_id, failed_rule`` with every metric computed only where the
    cascade reaches it."""
    return cascade(prepared(docs), [x["rule"] for x in estimate(docs, rules)]).select("doc_id", "failed_rule")


def quality(docs: DataFrame, rules=RULES) -> DataFrame:
    """The metrics ``SHOWN`` of every document with the cascade's verdict; what they do not give is computed
    only for documents that the cascade asks for it."""
    order = [x["rule"] for x in estimate(docs, rules)]
    m = prepared(docs).withColumns({k: METRICS[k]() for k in SHOWN})
    out = cascade(m, order, have=set(SHOWN))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words"))
    return out.select("doc_id", *SHOWN, failed.alias("base_failed"), (~failed & F.col("failed_rule").isNull()).alias("kept"))


ORACLE = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
      FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
p AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g) WHERE c > 1),
c AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM p) GROUP BY r),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, len(ls) AS n_lines,
             CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN c USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words
            OR word_chars < 2 * n_words OR word_chars > 20 * n_words
            OR 100 * n_symbols > 10 * n_words OR 100 * n_dup_lines > 50 * n_lines) AS kept
FROM m
"""
