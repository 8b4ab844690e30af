"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct buckets of its words, its pairs of neighbours and its pairs one
word apart (A-Z lower-cased, punctuation at the ends of words not told apart from the word). Learning
rates are per coordinate, and the L1 penalty leaves most of the weights at exactly zero: what is
broadcast is the list of the others, at most ``2 ** DIM_BITS`` of them whatever the corpus.

Learned from the labelled rows whose crc32(doc_id as text) mod 3 is not 1, at most ``SAMPLE`` of each
label (all of them where there are no more). Where the labels are drawn at different rates, the log of the
ratio of the rates is taken off the bias, so a score means the same whatever the number of labels. Labels,
lang, source and doc_id are never inputs.

Defined cases: null, empty and wordless texts score what the bias alone gives; repeated labels of a
document count as toxic if any does; a null doc_id has no label and is not held out; without labelled
rows all scores are below 1e-12; long texts are read whole; repeated rows score alike; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phonrisk.llm.words import blocks, mix, stream

DIM_BITS = 18
SAMPLE = 2_000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 1.0, 1.0, 8.0, 0.0
TOXIC_WEIGHT = 3.0
THRESHOLD = 0.7
_C = stream("toxic", 4) | np.uint64(1)
_ENDS = r"(?<![^\x20\x09-\x0D])[^\w\s]+|[^\w\s]+(?![^\x20\x09-\x0D])"


def _cells(words: np.ndarray) -> np.ndarray:
    """Distinct buckets of one text's words, neighbours and skip-grams."""
    shift = np.uint64(64 - DIM_BITS)
    parts = [mix(words * _C[0])]
    for gap in (1, 2):
        if len(words) > gap:
            parts.append(mix(words[:-gap] * _C[1] + words[gap:] * _C[1 + gap]))
    return np.unique(np.concatenate(parts) >> shift).astype(np.int32)


def cells(texts: pd.Series) -> list[np.ndarray]:
    plain = texts.fillna("").str.replace(_ENDS, "", regex=True).tolist()
    out = []
    for _, block in blocks(plain):
        out += [_cells(block.words[a:b]) for a, b in zip(block.first[:-1], block.first[1:], strict=True)]
    return out


def _bucket(modulus: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def _cell_rows(frames):
    for frame in frames:
        yield pd.DataFrame({"toxic": frame["toxic"], "at": cells(frame["text"])})


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, float]:
    """(buckets, weights, bias): the weights that are not zero."""
    marks = labels.filter(F.col("toxic").isNotNull() & (_bucket(3) != 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = {r["toxic"]: r["n"] for r in marks.filter("toxic in (0, 1)").groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not n:
        return np.empty(0, np.int32), np.empty(0), -30.0
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rates = {k: min(1.0, sample / m) for k, m in n.items()}
    marks = marks.filter(F.coalesce(*[F.when(F.col("toxic") == k, draw < rate) for k, rate in rates.items()]))
    rows = docs.select("doc_id", "text").join(F.broadcast(marks), "doc_id").select("toxic", "text")  # about twice SAMPLE ids
    got = rows.mapInPandas(_cell_rows, "toxic int, at array<int>").toPandas()  # about SAMPLE rows of each label
    examples = sorted(zip(got["at"].map(np.asarray), got["toxic"], strict=True), key=lambda e: hashlib.md5(e[0].tobytes()).digest())
    del got
    z, s = np.zeros((1 << DIM_BITS) + 1), np.zeros((1 << DIM_BITS) + 1)
    bias = np.array([1 << DIM_BITS])

    def weights(at):
        zz = z[at]
        penalty = np.where(at == bias[0], 0.0, L1)
        return -np.sign(zz) * np.maximum(np.abs(zz) - penalty, 0.0) / ((BETA + np.sqrt(s[at])) / ALPHA + L2)

    for _ in range(epochs):
        for at, y in examples:
            at = np.concatenate((at, bias))
            w = weights(at)
            g = (1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - y) * (TOXIC_WEIGHT if y else 1.0)
            z[at] += g - (np.sqrt(s[at] + g * g) - np.sqrt(s[at])) / ALPHA * w
            s[at] += g * g
    w = weights(np.arange(len(z)))
    used = np.flatnonzero(w[:-1])
    tilt = np.log(rates[1] / rates[0]) if len(rates) == 2 else 0.0  # the sample's log odds of toxic less the table's
    return used.astype(np.int32), w[used], float(w[-1] - tilt)


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, **options))

    @F.pandas_udf("double")
    def toxicity(texts: pd.Series) -> pd.Series:
        used, weights, bias = shared.value
        table = np.zeros(1 << DIM_BITS)
        table[used] = weights
        sums = np.array([table[c].sum() for c in cells(texts)]) + bias
        return pd.Series(1 / (1 + np.exp(-np.clip(sums, -30, 30))))

    out = docs.select("doc_id", F.coalesce(_bucket(3) == 1, F.lit(False)).alias("held_out"), toxicity("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
