"""The corpus pipeline: five stages over ``documents``, each an operator of the training-data subpackage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet on
the storage that all executors share and reads it back as the next stage's documents.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phonrisk.llm import bpe, langid, line_dedup, mixing, ngram_join
from phonrisk.llm.store import stored

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; those without letters or without a likely language go."""
    return langid.accepted(docs)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that stand on many sites (each stays in one document)."""
    return line_dedup.drop_lines(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that n-gram similarity links."""
    return ngram_join.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    return mixing.mixed_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, input_ids, n_tokens of each document of the mix."""
    coded = bpe.with_ids(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, ["doc_id", "lang", "source"])
    return coded.withColumn("n_tokens", F.size("input_ids").cast("long"))


STAGES = [
    ("language ID", language_id),
    ("line dedup", drop_boilerplate),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing", mix_sources),
    ("byte-level BPE", encode),
]

#: The first stage is a fitted model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
