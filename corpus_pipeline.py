"""The corpus pipeline: toxicity, near-duplicates, repeated passages, benchmark items, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``.  ``run`` hands each stage's result to the next
through a table in the shared folder.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoline.llm import bpe, decontaminate, simhash, suffixdedup, toxicity
from chronoline.llm.common import stage_table
from chronoline.llm.queries import RANKS, bpe_digests, read


#: Rows of an Arrow batch: whole texts and token lists are long, and both sides hold batches outside the heap.
ARROW_ROWS = "1000"


def _sized(spark: SparkSession) -> None:
    """Smaller Arrow batches, unless the session has a setting of its own."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":  # Spark's default
        spark.conf.set(name, ARROW_ROWS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under the threshold; the model learns from labelled documents among ``docs``."""
    _sized(spark)
    return toxicity.keep_clean(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group that SimHash links connect."""
    _sized(spark)
    return simhash.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that stand elsewhere too; n_chars follows the text."""
    _sized(spark)
    return suffixdedup.cut_repeats(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark rule does not flag."""
    _sized(spark)
    return decontaminate.keep_clean(docs, read(spark, sf_dir, "benchmark"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digests of ids and of the decoded text."""
    _sized(spark)
    path = public_tokenizers.path(RANKS)
    return bpe_digests(bpe.decode(bpe.encode(docs, path, public_tokenizers.PATTERN), path), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("benchmark_decontamination", drop_contaminated),
    ("byte_bpe", tokenise),
]
#: SQL cannot express the learned and iterative stages; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
