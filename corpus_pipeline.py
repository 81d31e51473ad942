"""A corpus pipeline: quality, near-duplicates, benchmark decontamination, mixing, token output.

Each stage takes all that the one before kept.  Every stage but the last returns the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridlens.llm import decontam, mixing, quality, queries, simhash, token_store
from gridlens.llm.common import Scratch


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (operator 5).  Null and empty texts score as text without a difference."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8 or more (operator 7).

    The row of least doc_id stays, nulls last; of rows equal in doc_id and text any one; texts without words are one group."""
    return simhash.drop_similar(docs)


def unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item (operator 6).  Null and empty texts hold none; every repeated row stays or goes alike."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The target mix; a document of a second epoch is a row of its own (operator 10).  Null names are names; texts without tokens
    come with whole epochs."""
    return mixing.mixed(docs, queries.WEIGHTS, seed=queries.SEED).select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Wavelet matrices of the token ids, read back: doc_id, start, n_tokens, ids_crc32 (operator 3).

    Null doc_ids come first, equal ones by text; a null text has the end id alone; no rows give none."""
    scratch = Scratch(spark, "pipeline-tokens")
    return token_store.read_tokens(*token_store.write_tokens(docs, queries.tokenizer_path("byte_bpe_50k.json"), scratch))


STAGES = [("quality", good), ("near-duplicates", unique), ("decontamination", unseen), ("mixing", mix), ("tokens", tokens)]

#: The stages train a classifier, link documents and run a tokenizer, which SQL cannot express; tests hold the
#: pipeline against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as Parquet and read again.  What a stage wrote is removed when the next one has
    written: a lost executor costs tasks of the running stage alone.  Nulls, ties, repeated rows and empty tables are each
    stage's to define; every stage takes them."""
    docs, scratch, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline"), None
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
        if before is not None:
            scratch.drop(before)
        before = docs
    return docs
