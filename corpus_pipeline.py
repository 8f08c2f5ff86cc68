"""The corpus pipeline: quality rules, language ID, MinHash near-dedup, mixing to target weights, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and read again as the
next one's docs. All but the last return the columns of documents, and any further columns that the input has, whatever their
names. Results are those that the operators' docstrings define; for the stages that comes to this: a null or empty text
fails the quality rules, so it ends there; a null language or source is kept as it is (the null source is mixed as a
source of its own); repeated rows count as rows until the dedup stage, which keeps one row of a group and of each id;
rows without an id are compared by text; texts of any length are read whole; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cargoscope.llm import bpe, fertility, langid, minhash, mixing
from cargoscope.llm.common import fresh_dir, read


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the fertility bands, with all their columns."""
    return fertility.accepted(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents near enough to a learned language; the model is fitted on the labelled rows of this stage's input."""
    return langid.accepted(docs)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest id, and of its rows the first by text hash."""
    return minhash.deduplicated(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row per document and pass with the words that the pass takes."""
    return mixing.mixed(docs)


def bpe_coding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the text decoded from them, per row of the mix."""
    return bpe.digests(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("language ID", language_id),
    ("MinHash near-dedup", minhash_near_dedup),
    ("mixing sources to target weights", source_mixing),
    ("BPE encoding and decoding", bpe_coding),
]

#: Tokenisers, classifiers and pseudorandom draws have no SQL; tests hold every stage against plain Python
#: on its own input (the fit of the language model and the draws of the mix by what they must meet).
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        made = stage(spark, docs, sf_dir)
        path = fresh_dir(spark, "stage")
        made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
    return docs
