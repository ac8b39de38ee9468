"""Helpers shared by the operators: text expressions, spans, the shared folder,
distributed connected components and a bounded membership prefilter."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

WORD = r"[^\x20\x09-\x0D]+"

A_Z, a_z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_az(c: Column) -> Column:
    """Lower-case A-Z only.  For pure ASCII text Spark's ``lower`` does exactly
    that and is much cheaper than ``translate``."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, A_Z, a_z))


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(WORD), F.lit(0))


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; a scratch
    folder only where that is unset (local tests)."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = tempfile.mkdtemp(prefix="llm-shared-")
        spark.conf.set("spark.checkpoint.dir", d)
    return d.rstrip("/")


_recorders: list[list[str]] = []


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The paths of the tables that ``stored`` writes meanwhile."""
    paths: list[str] = []
    _recorders.append(paths)
    try:
        yield paths
    finally:
        _recorders[:] = [x for x in _recorders if x is not paths]


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables that nothing reads any more."""
    while paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(paths.pop())
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries run meanwhile delete their shuffle files when they end; else the files stay until the driver
    happens to collect its garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and
    survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/llm-{name}-{uuid.uuid4().hex}"
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    for paths in _recorders:
        paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# ---------------------------------------------------------------- spans
MATCHES = 512  # matches of a text whose positions are added up one by one


def match_spans(text: Column, pattern: str) -> Column:
    """array<struct<s, e, m>> of all leftmost non-overlapping matches, in code
    points.  The text between matches (``split``) and the matches themselves
    (``regexp_extract_all``) come from the same left-to-right search, so the
    running sum of their lengths gives the positions.  It runs over blocks of
    ``MATCHES`` matches and then inside each block, as appending to one array
    of all would copy it for every match; linear in any text that has less
    than some millions of matches.  ``pattern`` must not match the empty string."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    spans = "array<struct<s:int,e:int,m:string>>"

    def grown(acc, length):  # the running sums so far, the last one first in reach
        return F.struct((acc["at"] + length).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    def step(acc, x):
        s = acc["at"] + F.length(x["g"])
        e = s + F.length(x["m"])
        return F.struct(e.alias("at"),
                        F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"), x["m"].alias("m")))).alias("out"))

    def length(block):
        return F.aggregate(block, F.lit(0), lambda n, x: n + F.length(x["g"]) + F.length(x["m"]))

    def block_spans(blocks):
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        starts = F.aggregate(F.transform(blocks, length), zero, grown, lambda acc: acc["out"])
        return F.flatten(F.zip_with(blocks, starts, lambda block, at: F.aggregate(
            block, F.struct(at.alias("at"), F.array().cast(spans).alias("out")), step, lambda acc: acc["out"])))

    def blocks(pairs):
        first = F.sequence(F.lit(1), F.size(pairs), F.lit(MATCHES))
        return F.when(F.size(pairs) > 0, F.transform(first, lambda k: F.slice(pairs, k, MATCHES))).otherwise(F.array())

    def once(value, f):  # what is used several times is made once
        return F.get(F.transform(F.array(value), f), F.lit(0))

    pairs = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.struct(g.alias("g"), m.alias("m")))
    return F.coalesce(once(pairs, lambda p: once(blocks(p), block_spans)), F.array().cast(spans))


# ---------------------------------------------------------------- prefilter
BITMAP_WORDS = 1 << 16  # rows of the broadcast bitmap at most: 64 bits each


def bitmap(keys: DataFrame, key: str) -> DataFrame:
    """A membership bitmap of ``keys[key]``: at most BITMAP_WORDS rows whatever
    the input size (a proven bound, so it may be broadcast).  It never misses a
    key; when it saturates it only stops saving work."""
    pos = F.pmod(F.xxhash64(F.col(key)), F.lit(BITMAP_WORDS * 64))
    return (keys.select(F.floor(pos / 64).cast("int").alias("_bw"), F.pmod(pos, F.lit(64)).cast("int").alias("_bb"))
            .groupBy("_bw").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("_bb"))).alias("_bits")))


def maybe_in(df: DataFrame, key: str, bits: DataFrame) -> DataFrame:
    """Rows of ``df`` whose key may be among those of ``bitmap``.  (Follow it with an inner join: a semi join
    would be planned below it.)"""
    pos = F.pmod(F.xxhash64(F.col(key)), F.lit(BITMAP_WORDS * 64))
    d = df.withColumn("_bw", F.floor(pos / 64).cast("int")).withColumn("_bb", F.pmod(pos, F.lit(64)).cast("int"))
    return (d.join(F.broadcast(bits), "_bw")
            .filter(F.col("_bits").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("_bb"))) != 0)
            .drop("_bw", "_bb", "_bits"))


BLOCK = 256  # ids of one representative compared with each other at a time


def blocked(apart: DataFrame, contents: DataFrame) -> DataFrame:
    """``rep, p, q, block, id, root, ...``: the ids that share a representative, with their ``contents(id, ...)``,
    dealt so that every two blocks of ``BLOCK`` ids meet once as group (rep, p, q).  Ids with a common
    signature share its representative."""
    rows = stored(apart.select("rep", "id", "root").distinct(), "by-rep")
    blocks = rows.groupBy("rep").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    d = (rows.join(blocks, "rep").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
         .join(contents, "id").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))))
    return d.withColumns({"p": F.least("block", "other"), "q": F.greatest("block", "other")}).drop("other", "blocks")


# ---------------------------------------------------------------- components
def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected ``edges(a, b)`` over any orderable
    node type: ``(node, root)``, root the smallest node of the component.

    Distributed union-find by alternating large-star and small-star steps:
    each node hooks its larger (smaller) neighbours to its smallest neighbour.
    All grouping is ``min`` with map-side combine, so a component of any size
    is never gathered in one task.  Rounds are logarithmic; each is written to
    the shared folder and deleted after the next one."""
    with recorded() as own:
        e = stored(edges.filter("a is not null and b is not null and a <> b")
                   .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")

    def mark(d):
        r = d.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        return r["n"], r["s"]

    seen = mark(e)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        spent = own[:]
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        with recorded() as made:
            large = stored(large, "large")
        spent += made
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        with recorded() as own:
            e = stored(small, "small")
        discard(edges.sparkSession, spent)
        now = mark(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return (e.select(F.col("u").alias("node"), F.col("v").alias("root"))
            .unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct())


def without_gaps(rows: DataFrame) -> DataFrame:
    """``sig, id, n`` with ``part``, which grows along the sizes of a signature wherever the next larger size is
    more than 5/4 of the one before: a link across that would take a similarity of 0.8 of sets more unequal
    than that.  Rows alone in their part go."""
    by_size = W.partitionBy("sig").orderBy("n")
    gap = F.coalesce(4 * F.col("n") > 5 * F.lag("n").over(by_size), F.lit(True))
    last = F.coalesce(4 * F.lead("n").over(by_size) > 5 * F.col("n"), F.lit(True))
    parts = F.sum(F.col("gap").cast("int")).over(by_size.rowsBetween(W.unboundedPreceding, W.currentRow))
    return (rows.withColumns({"gap": gap, "last": last}).filter("not (gap and last)")
            .withColumn("part", parts - 1).drop("gap", "last"))


def _groups(rows: DataFrame) -> DataFrame:
    """``sig, id, rep`` of the ids that share a signature with a smaller id, the smallest one being ``rep``."""
    group = W.partitionBy("sig")
    if "n" in rows.columns:
        rows, group = without_gaps(rows), W.partitionBy("sig", "part")
    # a group of two is its one link: its signature is not needed again; copies of one id are no group; the smallest
    # id is compared with all others at once, so it is in no row of its own
    rows = (rows.withColumns({"rep": F.min("id").over(group), "last": F.max("id").over(group),
                              "members": F.count(F.lit(1)).over(group)})
            .filter("rep <> last and id <> rep"))
    if "n" in rows.columns:  # the parts of a signature are signatures from here on
        rows = rows.withColumn("sig", F.when(F.col("part") > 0, F.xxhash64("sig", "part")).otherwise(F.col("sig")))
    return rows.select(F.when(F.col("members") > 2, F.col("sig")).alias("sig"), "id", "rep")


def grouped_links(rows: DataFrame | list[DataFrame], verify, cross, edges: DataFrame | None = None,
                  same: DataFrame | None = None) -> DataFrame:
    """Components ``(node, root)`` of the links that ``verify(pairs)`` confirms among ids with a common
    signature; rows: ``sig, id``, or several such tables that have no signature in common, of which one at a time
    is shuffled; ``edges(a, b)``: links known beforehand.  Where rows also have ``n``, the size
    of the id's set, sets of similarity 0.8 or more are what links: ids of one signature are then taken as
    several groups wherever their sizes leave a gap that no link crosses.

    Each group is first linked to its smallest id, so a group whose members belong together costs one pair
    a member.  Members that this leaves in different components are then compared with each other across
    components, so no link is lost: ``cross(apart)`` gives links (of ids or of roots) that join the same
    components as all such links, from ``sig, rep, id, root``.  ``same(id, same)`` may name one id for all ids of equal content; only that one
    is compared."""
    tables = rows if isinstance(rows, list) else [rows]
    spark, by_sig = tables[0].sparkSession, W.partitionBy("sig")
    with recorded() as spent:
        groups = reduce(DataFrame.unionByName, [stored(_groups(t), "groups") for t in tables])
    stars = groups.select(F.col("id").alias("a"), F.col("rep").alias("b")).distinct()
    if same is not None:
        stars = (stars.join(same.toDF("a", "x"), "a").join(same.toDF("b", "y"), "b").filter("x <> y")
                 .select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct())
    with recorded() as own:
        stars = stored(stars, "stars")
    first = verify(stars)
    with recorded() as rounds:
        links = components(first if edges is None else first.unionByName(edges))
    comps = stored(links, "components")
    discard(spark, own + rounds)
    roots = comps.withColumnRenamed("node", "same")
    if same is not None:  # small tables first, so that the groups' rows move once to find their root
        roots = same.join(roots, "same", "left").select("id", "same", F.coalesce("root", "same").alias("root"))
    else:
        roots = roots.select(F.col("same").alias("id"), "same", "root")
    apart = (groups.filter("sig is not null").select("sig", "rep", "id").join(roots, "id", "left")
             .select("sig", "rep", F.coalesce("same", "id").alias("id"), F.coalesce("root", "id").alias("root"))
             .withColumn("low", F.min("root").over(by_sig)).withColumn("high", F.max("root").over(by_sig))
             .filter("low <> high").select("sig", "rep", "id", "root").distinct())
    apart = stored(apart, "apart")
    discard(spark, spent)
    more = cross(apart)
    return components(comps.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
