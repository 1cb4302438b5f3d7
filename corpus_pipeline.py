"""From raw documents to packed sequences: each stage is one operator, written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from locusflow.llm.exact_dedup import keep_first_copies
from locusflow.llm.near_dup import keep_one_of_each
from locusflow.llm.packing import pack_documents
from locusflow.llm.queries import tokenizer_file
from locusflow.llm.substring_dedup import cut_repeats
from locusflow.llm.toxicity import keep_harmless, train
from locusflow.session import persisted, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model, fitted on the labelled ones, doesn't reject."""
    return keep_harmless(docs, train(docs, table(spark, sf_dir, "labels")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return keep_first_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return keep_one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with passages that an earlier one holds cut out."""
    return cut_repeats(docs, length_col="n_chars")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences of powers of two."""
    return pack_documents(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("packing", packing),
]

#: A fitted model and a tokenizer decide the rows, which SQL can't express; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the table documents; the rows are those of the last stage, pieces of packed documents.

    A null text is kept as such up to packing, where it is one token, as an empty one; null and empty texts are equal, and
    texts without words near duplicates of each other, so one of each group stays. Of repeated rows one stays. A null id is
    an id like others, smaller than any in exact and larger than any in near deduplication. Without labels of both kinds
    nothing is toxic. An empty table gives no rows. Other columns pass through, whatever their names.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = persisted(stage(spark, docs, sf_dir), name)
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
