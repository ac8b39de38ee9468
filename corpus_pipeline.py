"""From raw documents to training tokens: five stages, each written as Parquet and reread by the next.

A stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the columns of
documents (further columns are kept).  Null doc_ids, null and empty texts, repeated rows and empty tables
pass through each stage as its operator's docstring says.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carecheck.llm import jaccard_join, language_id, line_dedup, mixing, piece_tokens
from carecheck.llm.common import discard, recorded, shared_dir
from carecheck.llm.queries import piece_model

ORACLE_SQL = None  # automata, MinHash and the tokenizer have no SQL form; tests hold the stages against brute force


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null or no letter) go; ``lang`` becomes the predicted one."""
    found = language_id.identify(docs, language_id.training_texts(docs)).filter("lang_pred <> 'und'")
    return found.select(*[F.col("lang_pred").alias(c) if c == "lang" else F.col(c) for c in docs.columns])


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-equal lines the first stays; documents left without a line go; ``n_chars`` follows the text."""
    left = line_dedup.deduplicated(docs)
    return left.select(*[F.length("text").cast(left.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in left.columns])


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays."""
    comps = jaccard_join.jaccard_join(docs)
    gone = comps.filter("doc_id is not null and doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, as often as it takes them."""
    return mixing.mixed(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded_sha256`` of every document of the mix; ids are little-endian 32-bit."""
    return piece_tokens.training_tokens(docs, piece_model())


_left: list[str] = []  # tables that earlier steps of this driver wrote for themselves


def step(stage):
    """``stage``, which first deletes the intermediate tables of the stages before it: what they returned, its
    input, has been written by then."""
    def run_step(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        discard(spark, _left)
        with recorded() as own:
            out = stage(spark, docs, sf_dir)
        _left.extend(own)
        return out

    return run_step


STAGES = [
    ("language_id", step(identify_language)),
    ("line_dedup", step(dedup_lines)),
    ("ngram_jaccard_join", step(dedup_documents)),
    ("mixing", step(mix_sources)),
    ("sentencepiece", step(tokenize)),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/stage-{name}-{uuid.uuid4().hex}"
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
