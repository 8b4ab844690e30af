"""Quality rules: a decision list learned by sequential covering.

Each text gets a row of statistics. From labelled rows, conjunctions of thresholds on them are grown
one condition at a time (by information gain, on two thirds of the rows), pruned from the end (on the
other third) and kept while they are precise; the rows a rule covers are taken out before the next is grown. The
list is applied as one Spark conditional expression, first match first; texts that no rule covers are
kept. Rules name bad texts only and must be right on ``MIN_PRECISION`` of what they cover, so that
clean texts stay.

Words are ``[^\\x20\\x09-\\x0D]+``. ``n_repeat_words`` counts the words that stand in some 3-word window
which the text has at least twice, all its occurrences included.

A rule that proves imprecise is set aside with its rows and the next is grown, until too few bad rows are
left; a rule has at most ``MAX_CONDITIONS`` conditions. Learned from about ``SAMPLE`` labelled rows, drawn
by a hash of the doc_id.

Defined cases: a null or empty text has no words and fails the base rules; repeated labels of a document
count as bad if any does; without labels, or of one kind only, there are no rules and the base rules
decide; very long texts are counted whole; repeated rows get equal results; an empty table gives an
empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phonrisk.llm.store import stored

SAMPLE = 20_000
MAX_CONDITIONS = 4
MIN_PRECISION = 0.9
MIN_COVER = 8
MIN_WORDS = 50
MAX_REPEAT = 50
CUTS = 32
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RATIOS = ["mean_word", "symbols_per_word", "dup_lines_share", "repeat_share", "upper_share", "digit_share", "bang_share",
          "pipe_share", "distinct_share", "words_per_line", "max_word", "stop_share"]
_WHITE = re.compile(r"[\x20\x09-\x0D]")
_SYMBOLS = re.compile(r"[#*$%&|<>]")


def repeat_words(words: list) -> int:
    """Words in 3-word windows that occur twice or more."""
    if len(words) < 4:
        return 0
    codes: dict = {}
    ids = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, len(words))
    k = len(codes)
    if k >= 1 << 21:  # three ids no longer fit one number
        _, pair = np.unique(ids[:-1] * k + ids[1:], return_inverse=True)
        window = pair[:-1].astype(np.int64) * k + ids[2:]
    else:
        window = (ids[:-2] * k + ids[1:-1]) * k + ids[2:]
    _, where, count = np.unique(window, return_inverse=True, return_counts=True)
    at = np.flatnonzero(count[where] > 1)
    if not len(at):
        return 0
    covered = np.zeros(len(words), bool)
    covered[at] = covered[at + 1] = covered[at + 2] = True
    return int(covered.sum())


def statistics(text: str | None) -> list:
    raw = (text or "").encode("utf-8", "surrogatepass")
    text = text or ""
    words = raw.split()
    lines = text.split("\n")
    worded = [x for x in lines if _WHITE.sub("", x)]
    n = len(words)
    chars = len(text) - len(_WHITE.findall(text))
    symbols = len(_SYMBOLS.findall(text))
    dup = len(worded) - len(set(worded))
    repeat = repeat_words(words)
    lengths = [len(w) for w in words]
    upper, alpha = sum(map(str.isupper, text)), max(1, sum(map(str.isalpha, text)))
    digits, solid = sum(map(str.isdigit, text)), max(1, chars)
    m = max(1, n)
    return [n, chars, symbols, dup, repeat, chars / m, symbols / m, dup / max(1, len(worded)), repeat / m, upper / alpha, digits / solid,
            text.count("!") / m, text.count("|") / m, len(set(words)) / m, n / max(1, len(worded)), float(max(lengths, default=0)), sum(x <= 3 for x in lengths) / m]


def _statistic_rows(frames):
    for frame in frames:
        rows = pd.DataFrame([statistics(t) for t in frame["text"]], columns=BASE + RATIOS)
        rows.insert(0, "doc_id", frame["doc_id"])
        yield rows


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of every row."""
    schema = ", ".join(["doc_id long", *(f"{c} long" for c in BASE), *(f"{c} double" for c in RATIOS)])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(_statistic_rows, schema)


#: A condition: (column, at_least, threshold); a rule: conditions that hold together.
Condition = tuple[str, bool, float]


def _holds(x: np.ndarray, columns: list[str], conditions: list[Condition]) -> np.ndarray:
    mask = np.ones(len(x), bool)
    for c, at_least, t in conditions:
        v = x[:, columns.index(c)]
        mask &= v >= t if at_least else v < t
    return mask


def _grow(x: np.ndarray, bad: np.ndarray, columns: list[str]) -> list[Condition]:
    conditions, inside = [], np.ones(len(x), bool)
    while len(conditions) < MAX_CONDITIONS and (~bad & inside).any():
        p0, n0 = (bad & inside).sum(), inside.sum()
        best, gain = None, 0.0
        for k, c in enumerate(columns):
            v, b = x[inside, k], bad[inside]
            for t in np.unique(np.quantile(v, np.linspace(0, 1, CUTS + 1)[1:-1])):
                above = v >= t
                for at_least, m in ((True, above), (False, ~above)):
                    p, n = (b & m).sum(), m.sum()
                    if p >= MIN_COVER and n < n0:
                        g = p * (np.log2(p / n) - np.log2(p0 / n0))
                        if g > gain + 1e-9:
                            best, gain = (c, at_least, float(t)), g
        if best is None:
            break
        conditions.append(best)
        inside &= _holds(x, columns, [best])
    return conditions


def _worth(x, bad, columns, conditions) -> float:
    m = _holds(x, columns, conditions)
    p = (bad & m).sum()
    return (p - (m.sum() - p)) / max(1, m.sum())


def learn_rules(x: np.ndarray, bad: np.ndarray, columns: list[str], test: np.ndarray, min_precision: float = MIN_PRECISION) -> list[list[Condition]]:
    """Ordered rules for bad rows. ``test`` marks the rows that prune and judge. Rows of a rule that fails are set aside, and
    rules go on until fewer than ``MIN_COVER`` bad rows are left to grow from."""
    rules, left = [], np.ones(len(x), bool)
    fresh = left.copy()  # not covered by a rule that was tried
    while (bad & fresh & ~test).sum() >= MIN_COVER:
        grow, prune = fresh & ~test, left & test
        rule = _grow(x[grow], bad[grow], columns)
        while len(rule) > 1 and _worth(x[prune], bad[prune], columns, rule[:-1]) >= _worth(x[prune], bad[prune], columns, rule):
            rule = rule[:-1]
        covered = left & _holds(x, columns, rule)
        seen = covered & test
        if not rule or not (covered & fresh).any():
            break
        fresh &= ~covered
        if seen.sum() and (bad & seen).sum() >= min_precision * seen.sum() and (bad & covered).sum() >= max(MIN_COVER, min_precision * covered.sum()):
            rules.append(rule)
            left &= ~covered
    return rules


def as_column(rules: list[list[Condition]]) -> Column:
    """The number of the first rule that holds, from 1; null if none does."""
    out = F.lit(None).cast("int")
    for i, rule in reversed(list(enumerate(rules, 1))):
        holds = F.lit(True)
        for c, at_least, t in rule:
            holds = holds & (F.col(c) >= t if at_least else F.col(c) < t)
        out = F.when(holds, F.lit(i)).otherwise(out)
    return out


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))


def fit(measured: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[list[Condition]]:
    marks = labels.filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg((F.min("quality") == 0).alias("bad"))
    n = marks.count()
    if not n:
        return []
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rows = measured.filter(~base_failed()).join(marks.filter(draw < min(1.0, sample / n)), "doc_id").withColumn("test", F.crc32(F.concat_ws("|", F.lit("prune"), "doc_id").cast("binary")) % 3 == 0)
    got = rows.select("bad", "test", *RATIOS).toPandas()  # about SAMPLE rows of numbers
    return learn_rules(got[RATIOS].to_numpy(float), got["bad"].to_numpy(bool), RATIOS, got["test"].to_numpy(bool))


def judge(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, the base statistics, base_failed, rule (the rule that rejects, else null) and kept of every row."""
    measured = stored(measure(docs), "statistics")
    marked = measured.withColumn("base_failed", base_failed()).withColumn("rule", as_column(fit(measured, labels, **options)))
    return marked.select("doc_id", *BASE, "base_failed", "rule", (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"))
