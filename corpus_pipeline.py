"""Corpus preparation over ``documents``: each stage works on what the one before it kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents. ``run`` writes each stage's rows before the next one starts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import common, op8_quality
from tideline.llm.op1_suffix import clean
from tideline.llm.op2_minhash import keep_one
from tideline.llm.op6_pii import redact
from tideline.llm.op9_packing import pack

#: Percent of five-word shingles that near copies share; op2_minhash on its own has 85.
NEAR_PERCENT = 80
#: Passages of over 50 words, besides the strings of 400 bytes that op1_suffix removes.
PASSAGE_WORDS = 51


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` says how long the text is now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, and from the others the lines that stand on too many pages of a host."""
    return _counted(op8_quality.clean(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return keep_one(docs, NEAR_PERCENT)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long passages that stand anywhere else go from the texts; every document stays."""
    return _counted(clean(docs, words=PASSAGE_WORDS))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes its kind in brackets."""
    return _counted(redact(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in sequences of at most 1024."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup), ("pii", pii), ("packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    scratch = common.Scratch(spark, "pipeline")
    for _, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
