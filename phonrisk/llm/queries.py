"""Registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Small enough that buckets split on tables of a few megabytes.
SHARD_BYTES = 256 << 10


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op7_ngram_jaccard_join(spark, sf_dir):
    from phonrisk.llm.ngram_join import link_components

    return link_components(_table(spark, sf_dir, "documents"))


@query
def op9_mixing(spark, sf_dir):
    from phonrisk.llm.mixing import mix

    return mix(_table(spark, sf_dir, "documents"))


@query
def op10_sharding(spark, sf_dir):
    from phonrisk.llm.sharding import assign_shards

    return assign_shards(_table(spark, sf_dir, "documents"), SHARD_BYTES)


@query
def op2_line_dedup(spark, sf_dir):
    from phonrisk.llm.line_dedup import report

    return report(_table(spark, sf_dir, "documents"))


def _oracles() -> None:
    from phonrisk.llm import fingerprints, line_dedup, mixing, runs, sharding

    ORACLES.update(op2_line_dedup=line_dedup.oracle(), op9_mixing=mixing.oracle(), op10_sharding=sharding.oracle(SHARD_BYTES),
                   op11_fingerprints=fingerprints.oracle(), op13_periodic_runs=runs.oracle())


_oracles()


@query
def op3_byte_bpe(spark, sf_dir):
    import public_tokenizers

    from phonrisk.llm.bpe import digests

    return digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@query
def op4_language_id(spark, sf_dir):
    from phonrisk.llm.langid import identify

    return identify(_table(spark, sf_dir, "documents"))


@query
def op5_quality_rules(spark, sf_dir):
    from phonrisk.llm.quality_rules import judge

    return judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@query
def op6_toxicity(spark, sf_dir):
    from phonrisk.llm.toxicity import score

    return score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@query
def op1_nearest_neighbours(spark, sf_dir):
    from phonrisk.llm.ann import search

    vectors = _table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.filter("vec_id % 100 = 0"))


@query
def op8_url_filter(spark, sf_dir):
    from pyspark.sql import functions as F

    from phonrisk.llm.url_rules import judge

    pages, labels = _table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels")
    # A page's URL ends in the doc_id of the document that it shows; that document's labels are the page's.
    bad = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("blocked"))
    numbered = pages.select("url", F.regexp_extract("url", r"/(\d{1,18})[^/?#]*/?(?:[?#].*)?$", 1).alias("n")).filter("n != ''")
    labelled = numbered.withColumn("doc_id", F.col("n").cast("long")).join(bad, "doc_id").select("url", "blocked")
    rules = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
    return judge(pages, rules, labelled)


@query
def op11_fingerprints(spark, sf_dir):
    from phonrisk.llm.fingerprints import compare

    return compare(_table(spark, sf_dir, "documents"))


@query
def op12_whitening(spark, sf_dir):
    from phonrisk.llm.whitening import by_component

    return by_component(_table(spark, sf_dir, "embeddings"))


@query
def op13_periodic_runs(spark, sf_dir):
    from phonrisk.llm.runs import digests

    return digests(_table(spark, sf_dir, "documents"))
