"""From raw documents to packed token sequences, in stages that each write a table.

Every stage takes any table with the columns of documents, empty ones included, whatever other columns it has: null and empty
texts go at the quality rules, and stay in the other stages; rows that are repeated are judged each, and one of them stays
at near-duplicate removal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lucidoc.llm import decontaminate, near_dup, packing, quality_rules, secret_scan
from lucidoc.llm.common import load, scratch, stored
from lucidoc.llm.encoding import vocabulary
from lucidoc.llm.queries import VOCABULARY


def by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality_rules.filtered(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more)."""
    return near_dup.deduplicated(docs)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no more than traces of benchmark items."""
    return decontaminate.decontaminated(docs, load(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced."""
    return secret_scan.masked(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences, with their ids: `packing.assembled` joins them to what a model is trained on."""
    return packing.pack(docs, vocabulary(VOCABULARY), keep_ids=True, remember=60_000)


STAGES = [
    ("quality rules", by_quality),
    ("near-duplicate removal", without_near_copies),
    ("benchmark decontamination", without_benchmarks),
    ("secret scan", without_secrets),
    ("packing", packed),
]

#: Sketches, decoding and token ids are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents that the stages keep; each stage but the last is written before the next begins."""
    docs, folder = load(spark, sf_dir, "documents"), scratch(spark)
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = stored(stage(spark, docs, sf_dir), folder, f"stage-{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
