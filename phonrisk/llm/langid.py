"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed n-grams of 1 to 3 characters (of the lower-cased text, everything but letters read
as one blank), ``log(1 + tf) * idf``, scaled to unit length. Document frequencies cover
every labelled row that may be learned from. The weights are fitted by follow-the-regularised-leader
with elastic-net penalties on a bounded sample of those rows (``SAMPLE``), and a temperature,
fitted on a part of the sample that the weights never saw, turns their scores into probabilities.
Languages get equal parts of the sample; the logarithms of their drawing rates are taken off the scores,
so that probabilities are those of the corpus at every size. All languages are learned that the sample
meets; with more than ``CELLS`` / 2^14 of them, neighbouring buckets share weights to bound the memory.

Training rows: non-null lang, crc32(doc_id as text) mod 4 is not 2. Language, source and doc_id are
never inputs of a prediction.

Defined cases: a null text, or one without letters, is ``und`` with score 1; a text of any length is read
whole; a null doc_id is never learned from and never held out; without labelled rows all texts are
``und``; repeated rows get equal results; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIM_BITS = 14
ORDERS = (1, 2, 3)
SAMPLE = 3_000
EPOCHS = 2
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-5
REJECT_BELOW = 0.4
#: Up to so many languages, their drawing rates are sent to the rows; else rows are joined by language.
BROADCAST_KINDS = 10_000
#: Weights (buckets x languages) at most.
CELLS = 1 << 24
UNKNOWN = "und"
_BLANK = regex.compile(r"[^\p{L}\p{M}]+")
_LETTER = regex.compile(r"\p{L}")
_MULTIPLIERS = np.array([0, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)  # odd
PIECE = 1 << 18


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of the hashed n-grams of a text; empty without letters."""
    if not text or not _LETTER.search(text):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    data = np.frombuffer((" " + _BLANK.sub(" ", text.lower()) + " ").encode("utf-32-le", "replace"), np.uint32)
    counts = np.zeros(1 << DIM_BITS, np.int64)
    for start in range(0, len(data), PIECE):  # long texts a piece at a time, n-grams across the cuts included
        piece = data[start:start + PIECE + max(ORDERS) - 1].astype(np.uint64)
        code = np.zeros(len(piece), np.uint64)
        for n in range(1, max(ORDERS) + 1):
            code = (code[:len(piece) - n + 1] << np.uint64(21)) | piece[n - 1:]
            if n in ORDERS and len(code):
                mine = code[:PIECE]
                counts += np.bincount(((mine + np.uint64(n)) * _MULTIPLIERS[n] >> np.uint64(64 - DIM_BITS)).astype(np.int64), minlength=1 << DIM_BITS)
    at = np.flatnonzero(counts)
    return at, counts[at]


def _frequency_rows(frames):
    total, n = np.zeros(1 << DIM_BITS, np.int64), 0
    for frame in frames:
        for text in frame["text"]:
            at, _ = features(text)
            total[at] += 1
            n += 1
    used = np.flatnonzero(total)
    yield pd.DataFrame({"bucket": np.append(used, -1), "df": np.append(total[used], n)})


def document_frequencies(texts: DataFrame) -> np.ndarray:
    """Inverse document frequency of every bucket over all rows; at most one number per bucket is collected."""
    rows = texts.select("text").mapInPandas(_frequency_rows, "bucket long, df long").groupBy("bucket").agg(F.sum("df").alias("df")).toPandas()
    n = int(rows.loc[rows["bucket"] == -1, "df"].sum())
    df = np.zeros(1 << DIM_BITS)
    seen = rows[rows["bucket"] >= 0]
    df[seen["bucket"].to_numpy()] = seen["df"].to_numpy()
    return np.log((1 + n) / (1 + df)) + 1.0


def weighed(at: np.ndarray, counts: np.ndarray, idf: np.ndarray, dim: int = 1 << DIM_BITS) -> tuple[np.ndarray, np.ndarray]:
    """(slots, values) of a text; with fewer slots than buckets, neighbouring buckets add up."""
    values = np.log1p(counts) * idf[at]
    values /= max(float(np.sqrt(values @ values)), 1e-12)
    if dim == 1 << DIM_BITS:
        return at, values
    slots = at.astype(np.int64) * dim >> DIM_BITS
    first = np.flatnonzero(np.diff(slots, prepend=-1))
    return slots[first], np.add.reduceat(values, first)


class Ftrl:
    """Follow-the-regularised-leader for one softmax; L1 keeps weights at exactly zero."""

    def __init__(self, dim: int, classes: int):
        self.z, self.n = np.zeros((dim, classes)), np.zeros((dim, classes))

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - L1, 0.0)
        return -shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2)

    def learn(self, at: np.ndarray, values: np.ndarray, label: int) -> None:
        w = self.weights(at)
        p = softmax(values @ w)
        p[label] -= 1.0
        g = values[:, None] * p[None, :]
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max())
    return e / e.sum()


def temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of scores that makes the labels likeliest."""
    grid = np.exp(np.linspace(np.log(0.02), np.log(20), 200))
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        s = scores / t
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(labels)), labels]).mean())
    return float(min(grid, key=loss))


def _bucket(modulus: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def _feature_rows(frames):
    for frame in frames:
        found = [features(t) for t in frame["text"]]
        yield pd.DataFrame({"lang": frame["lang"], "check": frame["check"], "rate": frame["rate"], "at": [a.astype(np.int16) for a, _ in found], "counts": [c.astype(np.int32) for _, c in found]})


def fit(docs: DataFrame, sample: int = SAMPLE, epochs: int = EPOCHS):
    """(languages, weights, idf, temperature, offsets) learned from the training rows of ``docs``."""
    rows = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & (_bucket(4) != 2))
    idf = document_frequencies(rows)
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"))
    kinds = sizes.count()
    if not kinds:
        return [], np.zeros((1 << DIM_BITS, 0)), idf, 1.0, np.zeros(0)
    # Languages get equal parts of the sample, drawn by a hash of the doc_id; the sample bounds what is collected.
    rate = F.least(F.lit(1.0), F.lit(sample / kinds) / F.col("n"))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rates = sizes.withColumn("rate", rate).drop("n")
    drawn = rows.join(F.broadcast(rates) if kinds <= BROADCAST_KINDS else rates, "lang").filter(draw < F.col("rate"))
    drawn = drawn.withColumn("check", F.crc32(F.concat_ws("|", F.lit("calibrate"), F.col("doc_id").cast("string")).cast("binary")) % 5 == 0)
    got = drawn.select("lang", "check", "rate", "text").mapInPandas(_feature_rows, "lang string, check boolean, rate double, at array<smallint>, counts array<int>").toPandas()  # about SAMPLE rows
    seen = got.groupby("lang").rate.first().sort_index()
    langs, offsets = list(seen.index), -np.log(seen.to_numpy())
    if not langs:
        return [], np.zeros((1 << DIM_BITS, 0)), idf, 1.0, np.zeros(0)
    dim = 1 << DIM_BITS
    while dim * len(langs) > CELLS and dim > 1:
        dim //= 2
    place = {k: i for i, k in enumerate(langs)}
    model = Ftrl(dim, len(langs))
    examples = [(np.asarray(r.at), np.asarray(r.counts), place[r.lang], r.check) for r in got.itertuples() if len(r.at)]
    del got
    examples.sort(key=lambda e: hashlib.md5(e[0].tobytes() + e[1].tobytes()).digest())  # a fixed, mixed order
    for _ in range(epochs):
        for at, counts, label, check in examples:
            if not check:
                model.learn(*weighed(at, counts, idf, dim), label)
    w = model.weights()
    held = [(scores(w, idf, a, c), y) for a, c, y, check in examples if check]
    t = temperature(np.array([s for s, _ in held]), np.array([y for _, y in held], int)) if held else 1.0
    return langs, w, idf, t, offsets - offsets.min()


def scores(w: np.ndarray, idf: np.ndarray, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
    slots, values = weighed(at, counts, idf, len(w))
    return values @ w[slots]


def predictor(docs: DataFrame, **options):
    """A column function text -> struct(lang_pred, score), learned from ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, **options))

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        langs, w, idf, t, offsets = shared.value
        out = []
        for text in texts:
            at, counts = features(text)
            if not len(at) or not langs:
                out.append((UNKNOWN, 1.0))
                continue
            p = softmax(scores(w, idf, at, counts) / t + offsets)
            best = int(p.argmax())
            out.append((langs[best], float(p[best])))
        return pd.DataFrame(out, columns=["lang_pred", "score"])
    return predict


def identify(docs: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    predict = predictor(docs, **options)
    return docs.select("doc_id", F.coalesce(_bucket(4) == 2, F.lit(False)).alias("held_out"), predict("text").alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score")


def accepted(docs: DataFrame, reject_below: float = REJECT_BELOW, **options) -> DataFrame:
    """``docs`` without the rows whose language is unknown, or less likely than ``reject_below``."""
    predict = predictor(docs, **options)
    marked = docs.withColumn("_lid", predict("text"))
    return marked.filter((F.col("_lid.lang_pred") != UNKNOWN) & (F.col("_lid.score") >= reject_below)).select(*docs.columns)
