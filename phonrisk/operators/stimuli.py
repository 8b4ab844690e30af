"""Stimulus catalogues and the reference vocabulary."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phonrisk.functions import hangul as hg
from phonrisk.functions.text import uniform
from phonrisk.operators.ordered import rank_rows

# Reference vocabulary size and length mix (syllables, per cent).
REFERENCE_SIZE = 400
LENGTH_MIX = ((1, 20), (2, 45), (3, 25), (4, 10))


def design_syllable(i: Column) -> Column:
    """i-th syllable of the balanced design: three coprime cycles through the alphabets."""
    coda_at = F.call_function("locate", F.substr(F.lit(hg.SURFACE_CODAS), i % 8 + 1, F.lit(1)), F.lit(hg.CODAS)) - 1
    return hg.char_of(F.lit(hg.FIRST) + (i % 19 * 21 + i % 21) * 28 + coda_at)


def balanced_catalog(spark: SparkSession, n: int = hg.DESIGN_SIZE) -> DataFrame:
    if not 1 <= n <= hg.DESIGN_SIZE:
        raise ValueError(f"n must be in 1..{hg.DESIGN_SIZE}")
    s = F.col("syllable")
    return (spark.range(n).withColumnRenamed("id", "pos").withColumn("syllable", design_syllable(F.col("pos")))
            .withColumn("stimulus_id", F.format_string("builtin-%04d", "pos")).withColumn("structure", hg.structure(s)))


def coverage(catalog: DataFrame, keys: list[str]) -> DataFrame:
    return (catalog.select(*keys, F.inline_outer(hg.jamo(F.col("syllable"))))
            .groupBy(*keys, "position", "symbol").agg(F.count("*").alias("n")))


def balance_score(catalog: DataFrame, keys: list[str]) -> DataFrame:
    size = F.when(F.col("position") == "onset", 19).when(F.col("position") == "nucleus", 21).otherwise(8)
    return coverage(catalog, keys).groupBy(*keys, "position").agg(
        F.min("n").alias("_lo"), F.max("n").alias("_hi"), F.count("*").alias("_used")).select(
        *keys, "position", (F.col("_lo") / F.col("_hi") * (F.col("_used") / size)).alias("balance"))


def random_subset(catalog: DataFrame, n: int, seed: int, pos: str = "pos") -> DataFrame:
    """n stimuli by hash order, kept in catalogue order by ``pos``."""
    u = uniform(f"subset{seed}", F.col(pos))
    return rank_rows(catalog.withColumn("_u", u), [], ["_u", pos]).where(F.col("rn") <= n).drop("rn", "_u")


def from_list(lists: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Catalogue rows from an explicit string of syllables, position kept."""
    return lists.select(*keys, F.posexplode_outer(hg.syllables(F.col(text))).alias("pos", "syllable"))


def head(catalog: DataFrame, n: int) -> DataFrame:
    if n < 0:
        raise ValueError("n must be non-negative")
    return catalog.where(F.col("pos") < n)


def greedy_subset(catalogs: DataFrame, key: str, n: int) -> DataFrame:
    """Coverage-maximising subset of each catalogue, least represented categories first.

    The choice is sequential, so one catalogue is one group and many run side by side. Of
    equal syllables only the first n can ever be picked, which bounds a group exactly at
    11,172 x n rows.
    """
    distinct = (rank_rows(catalogs.select(key, "syllable", "pos"), [key, "syllable"], ["pos"])
                .where(F.col("rn") <= n).drop("rn")
                .withColumn("o", hg.onset_index(F.col("syllable"))).withColumn("v", hg.nucleus_index(F.col("syllable")))
                .withColumn("c", hg.coda_index(F.col("syllable"))))

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("pos").reset_index(drop=True)
        onset, nucleus, coda = (rows[c].to_numpy() for c in "ovc")
        seen_o, seen_v, seen_c = (np.zeros(size, np.int64) for size in (19, 21, 28))
        base, free, picked = np.int64(n + 1), np.ones(len(rows), bool), []
        for pick in range(min(n, len(rows))):
            rank = (seen_o[onset] * base + seen_v[nucleus]) * base + seen_c[coda]
            at = int(np.argmin(np.where(free, rank, np.iinfo(np.int64).max)))  # the first of equals
            free[at] = False
            for seen, part in ((seen_o, onset), (seen_v, nucleus), (seen_c, coda)):
                seen[part[at]] += 1
            picked.append((rows.at[at, key], rows.at[at, "syllable"], rows.at[at, "pos"], pick))
        return pd.DataFrame(picked, columns=[key, "syllable", "pos", "pick"])

    kind = dict(catalogs.dtypes)[key]
    return distinct.groupBy(key).applyInPandas(choose, f"`{key}` {kind}, syllable string, pos bigint, pick bigint")


def reference_vocabulary(spark: SparkSession) -> DataFrame:
    """400 deterministic words built by walking the balanced design."""
    rows, cursor = [], 0
    for length, weight in LENGTH_MIX:
        for _ in range(round(REFERENCE_SIZE * weight / 100)):
            rows.append((len(rows), length, cursor))
            cursor += length
    spans = spark.createDataFrame(rows, "v int, n_syll int, start int")
    syl = F.transform(F.sequence(F.lit(0), F.col("n_syll") - 1),
                      lambda j: design_syllable(((F.col("start") + j) % hg.DESIGN_SIZE).cast("long")))
    return spans.select("v", "n_syll", F.array_join(syl, "").alias("word"))
