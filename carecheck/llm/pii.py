"""Personal data: pattern spans, and information-theoretic sanitisation of the
terms around them.

Patterns find the protected entities (email, ip, card, phone).  Corpus
co-occurrence then tells how strongly a nearby term reveals an entity: with
documents counted over the whole corpus, pointwise mutual information
``log2(p(term, entity) / (p(term) p(entity)))`` is held against the entity's
information content ``-log2 p(entity)``.  A term that gives away at least
``GENERALISE`` of it is generalised wherever it stands in a document with that
entity, at least ``REMOVE`` of it removed.  Entities are rare, so no fixed
number of contexts is asked for: as many different contexts with the entity as
the term has must be unlikely (below ``CHANCE``) if the two were independent.

Everything is Spark SQL functions: no Python on the data path.  Rows that move
are context terms around entities and counts; term counts of the corpus are
pre-aggregated and only for terms seen near an entity (bounded bitmap).

Cases: null text counts as empty; null doc_id and repeated rows are handled
row by row; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carecheck.llm.common import bitmap, match_spans, maybe_in, stored

# The patterns below match what the plain forms match, leftmost first: a start inside a run can only
# repeat the run's own failure, so starts are tried at run starts (or where the last match ended), and
# possessive loops keep very long runs linear.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
KINDS = ("email", "ip", "card", "phone")
TERM = r"\p{L}{3,}"

CONTEXT_CHARS = 200  # to each side, within the line
CHANCE = 0.001
GENERALISE, REMOVE = 0.9, 1.0

SPANS = "array<struct<s:int,e:int,m:string>>"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    d = F.transform(F.split(F.reverse(digits), "(?<=.)(?=.)"), lambda x: x.cast("int"))
    twice = lambda x: F.when(x > 4, 2 * x - 9).otherwise(2 * x)
    total = F.aggregate(F.transform(d, lambda x, i: F.when(i % 2 == 1, twice(x)).otherwise(x)), F.lit(0), lambda a, x: a + x)
    return total % 10 == 0


def kind_spans(t: Column) -> dict[str, Column]:
    """Valid pattern spans of each kind; a cheap test skips texts without any."""
    def of(test: Column, pattern: str, valid) -> Column:
        return F.when(test, F.filter(match_spans(t, pattern), valid)).otherwise(F.array().cast(SPANS))

    return {
        "email": of(F.instr(t, "@") > 0, EMAIL, lambda x: F.lit(True)),
        "ip": of(t.rlike(r"[0-9]\.[0-9]"), IP, lambda x: x["m"].rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")),
        "card": of(t.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"), CARD,
                   lambda x: F.when(F.length(_digits(x["m"])).between(16, 19), _luhn(_digits(x["m"]))).otherwise(False)),
        "phone": of(t.rlike(r"\+[0-9]"), PHONE, lambda x: F.length(_digits(x["m"])).between(8, 15)),
    }


def find(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Stored table ``rid, doc_id, t, email, ip, card, phone``: spans of every row; the text only
    where there are any (later steps need no other)."""
    d = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    d = d.select("doc_id", "t", *[c.alias(k) for k, c in kind_spans(F.col("t")).items()])
    some = F.lit(False)
    for k in KINDS:
        some = some | (F.size(k) > 0)
    return stored(d.select(F.monotonically_increasing_id().alias("rid"), "doc_id",
                           F.when(some, F.col("t")).alias("t"), *KINDS), "pii")


def _each(kind: str, f) -> Column:
    """``f(kind, span)`` over the kind's spans."""
    return F.transform(kind, lambda x: f(kind, x))


def _entity(kind: str, x: Column) -> Column:
    return F.concat(F.lit(kind + ":"), F.lower(F.regexp_replace(x["m"], "[\\x20()-]", "")))


def _listed(kind: str, x: Column) -> Column:
    return F.concat_ws(":", F.lit(kind), x["s"].cast("string"), x["e"].cast("string"))


def contexts(found: DataFrame) -> DataFrame:
    """One row per entity occurrence and term near it: ``rid, entity, ctx, term, s, e``."""
    every = F.concat(*[_each(k, lambda k, x: F.struct(_entity(k, x).alias("entity"), x["s"].alias("s"), x["e"].alias("e")))
                       for k in KINDS])
    d = found.filter("t is not null").select("rid", "t", every.alias("spans")).withColumn("x", F.explode("spans"))
    left = F.substring_index(F.expr("substring(t, greatest(1, x.s + 1 - %d), least(x.s, %d))" % (CONTEXT_CHARS, CONTEXT_CHARS)), "\n", -1)
    right = F.substring_index(F.expr("substring(t, x.e + 1, %d)" % CONTEXT_CHARS), "\n", 1)
    d = d.select("rid", "spans", "x", left.alias("l"), right.alias("r"))
    shift = lambda a, by: F.transform(a, lambda y: F.struct((y["s"] + by).alias("s"), (y["e"] + by).alias("e"),
                                                            F.lower(y["m"]).alias("term")))
    terms = F.concat(shift(match_spans(F.col("l"), TERM), F.col("x.s") - F.length("l")),
                     shift(match_spans(F.col("r"), TERM), F.col("x.e")))
    free = F.filter(terms, lambda y: ~F.exists("spans", lambda z: (z["s"] < y["e"]) & (y["s"] < z["e"])))
    return (d.select("rid", F.col("x.entity").alias("entity"), F.xxhash64("l", "r").alias("ctx"), F.explode(free).alias("y"))
            .select("rid", "entity", "ctx", "y.term", "y.s", "y.e"))


def disclosures(docs: DataFrame, found: DataFrame, near: DataFrame, text: str = "text") -> DataFrame:
    """``entity, term, share``: how much of the entity's information content the term gives away."""
    joint = (near.groupBy("entity", "term", "rid").agg(F.min("ctx").alias("ctx"))
             .groupBy("entity", "term", "ctx").agg(F.count(F.lit(1)).alias("n"))
             .groupBy("entity", "term").agg(F.sum("n").alias("n_et"), F.count(F.lit(1)).alias("support")))
    joint = stored(joint, "pii-joint")
    n_e = (found.filter("t is not null").select(F.explode(F.concat(*[_each(k, _entity) for k in KINDS])).alias("entity"), "rid").distinct()
        .groupBy("entity").agg(F.count(F.lit(1)).alias("n_e")))
    total = docs.agg(F.count(F.lit(1)).alias("n_all"))
    terms = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(
        F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(TERM), F.lit(0)))).alias("term"))
    n_t = maybe_in(terms, "term", bitmap(joint, "term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    c = (joint.join(n_t, "term").join(n_e, "entity").crossJoin(F.broadcast(total)))  # total: one row
    pmi = F.log2(F.col("n_et") * F.col("n_all") / (F.col("n_e") * F.greatest("n_t", "n_et")))
    ic = F.log2(F.col("n_all") / F.col("n_e"))
    expected = F.col("n_e") * F.greatest("n_t", "n_et") / F.col("n_all")
    # Chernoff's bound of a Poisson count of ``support`` or more; below its mean there is no evidence
    tail = F.col("support") * (1 + F.log(expected / F.col("support"))) - expected
    return (c.filter((F.col("support") > expected) & (tail <= math.log(CHANCE)))
            .select("entity", "term", F.when(ic > 0, pmi / ic).otherwise(0.0).alias("share"))
            .filter(F.col("share") >= GENERALISE))


def _everywhere(found: DataFrame, told: DataFrame) -> DataFrame:
    """``rid, terms``: the disclosing terms of a row's entities, at every place in its text outside the entities."""
    spans = F.concat(*[F.col(k) for k in KINDS])
    own = (found.filter("t is not null")
           .select("rid", F.explode(F.array_distinct(F.concat(*[_each(k, _entity) for k in KINDS]))).alias("entity")))
    shares = (own.join(told, "entity").groupBy("rid", "term").agg(F.max("share").alias("share"))
              .groupBy("rid").agg(F.map_from_entries(F.collect_list(F.struct("term", "share"))).alias("shares")))
    d = found.select("rid", "t", spans.alias("spans")).join(shares, "rid")
    here = F.filter(match_spans(F.col("t"), TERM), lambda y: F.map_contains_key("shares", F.lower(y["m"]))
                    & ~F.exists("spans", lambda z: (z["s"] < y["e"]) & (y["s"] < z["e"])))
    marks = F.transform(here, lambda y: F.struct(y["s"].alias("s"), y["e"].alias("e"), F.when(
        F.element_at("shares", F.lower(y["m"])) >= REMOVE, "remove").otherwise("generalise").alias("m")))
    return d.select("rid", F.sort_array(marks).alias("terms"))


def sanitise(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, t, email, ip, card, phone, terms``: spans of every row, ``terms`` an array of
    ``(s, e, m)`` with m ``generalise`` or ``remove``; t only where there are spans."""
    found = find(docs, text, key)
    near = stored(contexts(found), "pii-near")
    told = disclosures(docs, found, near, text)
    marked = _everywhere(found, stored(told, "pii-told"))
    return (found.join(marked, "rid", "left")
            .withColumn("terms", F.coalesce("terms", F.array().cast(SPANS))).drop("rid"))


def redacted(found: DataFrame) -> DataFrame:
    """``doc_id, text``: the texts with their spans replaced (rows without spans keep a null text: unchanged)."""
    label = {k: f"[{k.upper()}]" for k in KINDS}
    parts = [_each(k, lambda k, x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(label[k]).alias("r"))) for k in KINDS]
    parts.append(F.transform("terms", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"),
                                                          F.when(x["m"] == "remove", "").otherwise("[TERM]").alias("r"))))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    cut = lambda a, b: F.substring(F.col("t"), a + 1, F.greatest(b - a, F.lit(0)))

    def step(acc, x):
        start = F.greatest(x["s"], acc["at"])
        return F.struct(F.greatest(x["e"], acc["at"]).alias("at"),
                        F.concat(acc["out"], cut(acc["at"], start), F.when(x["s"] >= acc["at"], x["r"]).otherwise("")).alias("out"))

    done = F.aggregate(F.sort_array(F.concat(*parts)), zero, step,
                       lambda acc: F.concat(acc["out"], F.substring(F.col("t"), acc["at"] + 1, F.length("t"))))
    return found.select("doc_id", done.alias("text"))


def pii(docs: DataFrame) -> DataFrame:
    """The contract's digest of ``sanitise``."""
    f = sanitise(docs)
    terms = F.transform("terms", lambda x: _listed("term", x))
    base = F.concat(*[_each(k, _listed) for k in KINDS])
    return f.select("doc_id", *[F.size(k).cast("bigint").alias(f"n_{k}") for k in KINDS],
                    F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
                    F.array_join(F.concat(base, terms), ",").alias("spans"))
