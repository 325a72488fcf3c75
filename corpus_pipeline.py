"""A training corpus from raw documents: five stages, each a Spark job over all that its predecessor kept.

Defined results: null and empty texts are documents that the classifier judges like others (as a rule it rejects them); a
null doc_id, lang or source is carried along, null sources are mixed as one source; repeated rows and equal texts are one
document after the second stage; very long texts are taken whole; of ties in near-duplicates the smallest id stays; columns
beyond those of documents are dropped by the first stage, whatever their names; without labels every document scores 0.5 and
none is kept; an empty table, or one of which nothing is kept, gives an empty result. Copies that mixing makes are documents
of their own in the files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import bagminhash, decontaminate, huffman_ids, poisson_mix, rule_ensemble
from spindrift.llm.common import pick, work_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble scores 0.7 or more."""
    return pick(rule_ensemble.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), *COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: that of the smallest id."""
    return pick(bagminhash.keep_one(docs), *COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return pick(decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")), *COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents replicated to the sources' target shares, in a global order by hash: the rows of one file after another."""
    return pick(poisson_mix.mix(docs), *COLUMNS)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' ids in Huffman-coded files, read back: doc_id, start, n_tokens, ids_crc32.

    The files keep the order in which Spark reads the mixed rows: whole runs of the mixed order one after another, so the
    copies of a document lie apart.
    """
    return huffman_ids.token_files(docs, order=F.monotonically_increasing_id())


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("token_files", token_files)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each one's result is written as Parquet and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = work_dir(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)


#: A trained classifier, signatures and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None
