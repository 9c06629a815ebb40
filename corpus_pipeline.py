"""A corpus from documents to packed sequences: five stages over all that the stage before kept.

run() writes what each stage returns as Parquet to the shared folder and reads it again for the next.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from loomstrand.llm.common import crc_mod, cut, give_back, table
from loomstrand.llm.decontaminate import decontaminate
from loomstrand.llm.ngram_join import one_of_each
from loomstrand.llm.packing import pack_documents
from loomstrand.llm.pii import DEMO_KEY, masked
from loomstrand.llm.tokens import tokenizer_path
from loomstrand.llm.toxicity import learn_grammar, without_toxic

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar scores under 0.5; it learns from the labelled rows of the training folds."""
    grammar = learn_grammar(docs, table(spark, sf_dir, "labels").where(crc_mod("doc_id", 5) != 0))
    return without_toxic(docs, grammar)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group linked at a similarity of 0.8 of five-word shingles."""
    return one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a ten-word window of a benchmark item."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced; n_chars follows the text where that changed."""
    return masked(docs, key=DEMO_KEY, length_col="n_chars")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens with their places in as few sequences as possible."""
    return pack_documents(docs, tokenizer_path("byte_bpe_50k.json"), 2)


def _alone(stage: Stage) -> Stage:
    """The stage, begun by executors that hold nothing of the one before."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        give_back(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [
    ("toxicity", _alone(toxicity)),
    ("ngram_jaccard_join", _alone(near_duplicates)),
    ("benchmark_decontamination", _alone(benchmark_decontamination)),
    ("pii_pseudonyms", _alone(pii)),
    ("best_fit_packing", _alone(packing)),
]

#: SQL expresses neither the grammar nor the tokenizer; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
