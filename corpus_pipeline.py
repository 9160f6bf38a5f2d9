"""A corpus pipeline over ``documents``: five stages, each written as Parquet and read again as the next one's input.

Every stage works on all rows that its predecessor kept. Toxicity and quality learn from the labels of the rows they are
given; the near-duplicate stage keeps one document of each component; decontamination removes documents that hold a
benchmark item; the last stage returns token ids whose decoding has been compared with the text.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.llm import bpe, decontaminate, factorization, jaccard, quality_rules
from quillgrid.session import stored

TOXIC_FROM = 0.7
_ROW = "__pipeline_row"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _labelled(spark: SparkSession, docs: DataFrame, sf_dir: str, label: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels").select("doc_id", F.col(label).alias("label"))
    return docs.select("doc_id", "text").join(labels, "doc_id")


def _columns(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def _row() -> Column:
    """A key of the row that null or repeated ids leave distinct; only equal texts under one id share it."""
    return F.concat_ws(":", F.lit("row"), F.col("doc_id").cast("string"), F.hex(F.xxhash64("text")))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity below the threshold."""
    model = factorization.fit(_labelled(spark, docs, sf_dir, "toxic"))
    scored = factorization.score(docs.withColumn(_ROW, F.lit(None).cast("double")), model, name=_ROW)
    return scored.where(F.col(_ROW) < TOXIC_FROM).select(*_columns(docs))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    weights = quality_rules.fit(_labelled(spark, docs, sf_dir, "quality"))
    return quality_rules.keep_rows(docs, weights)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates; documents without words are no duplicates of each other."""
    keyed = docs.withColumn(_ROW, _row())
    found = jaccard.near_duplicates(keyed, key=_ROW)
    first = found.where(F.col(_ROW) == F.col("component_id")).select(_ROW)
    return keyed.join(first, _ROW, "left_semi").dropDuplicates([_ROW]).select(*_columns(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    keyed = docs.withColumn(_ROW, _row())
    leaks = decontaminate.find_leaks(keyed, _table(spark, sf_dir, "benchmark"), key=_ROW)
    return keyed.join(leaks.select(_ROW).distinct(), _ROW, "left_anti").select(*_columns(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document (little-endian unsigned 32-bit) with their number and digests."""
    return bpe.encode_checked(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).drop("text")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("quality rules", quality),
    ("n-gram Jaccard join", deduplicate),
    ("benchmark decontamination", decontamination),
    ("byte-level BPE", encode),
]
#: SQL cannot express the learnt stages, the components or the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
