"""A corpus pipeline of five stages, each on all that the one before it kept.

toxicity -> SimHash near-dedup -> suffix-array dedup -> mixing -> byte-level BPE

Every stage is written as Parquet and read again as the next one's documents.
All but the last return the columns of documents. Rows with null or empty
texts, null ids and repeated rows pass as each stage's function says; empty
documents give an empty result.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierflow.llm import byte_bpe, mixing, simhash, suffix_dedup, toxicity
from tierflow.session import ensure_checkpoint_dir, read_table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar doesn't reject, learned from the labels that aren't held out. Null texts stay."""
    model = toxicity.learn(docs, read_table(spark, sf_dir, "labels"), ~toxicity.held_out(F.col("doc_id")))
    return toxicity.reject(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: the one with the smallest id."""
    return simhash.representatives(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that repeat a document with a smaller id; characters that lose a byte go. n_chars is counted anew."""
    others = F.struct(*[f"`{c}`" for c in docs.columns if c != "text"]).alias("row")
    cut = suffix_dedup.deduplicate(docs.select("doc_id", "text", others, F.col("text").isNull().alias("bare")), keep=["row", "bare"], kept_as="string")
    text = F.when(~F.col("bare"), F.col("kept"))
    new = {"text": text, "n_chars": F.coalesce(F.length(text), F.lit(0)).cast("long")}
    return cut.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that sources, languages and topics meet their target weights."""
    return mixing.sample(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document left, their digest, and the digest of what they decode to."""
    return byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

#: SQL can express neither the learned grammar nor the components or the merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, written in the shared folder that spark.checkpoint.dir names."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
