"""Recogniser evaluation: alignment counts, error rates, timing problems."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phonrisk.functions.text import recogniser_text
from phonrisk.operators.ordered import with_lag


#: Bits of kept columns, beyond which a table is swept in blocks of columns that are made again on the way back.
KEPT_BITS = 1 << 27


def align(ref: Sequence[str], hyp: Sequence[str]) -> tuple[int, int, int]:
    """Substitutions, deletions, insertions of one cheapest alignment, ties in that order.

    Equal ends are cut off first, which changes nothing: a match always takes the diagonal. Columns of
    the rest are integers with a bit a row (Myers, Hyyro): where the cost equals that on the diagonal, and
    where it rises from the row above. The way back needs no more: a cell that matches takes the diagonal, one
    that is dearer than its diagonal is a substitution, else it came from above (a deletion) if it is dearer
    than that, else from the left.
    """
    k, n, m = 0, len(ref), len(hyp)
    while k < n and k < m and ref[k] == hyp[k]:
        k += 1
    while n > k and m > k and ref[n - 1] == hyp[m - 1]:
        n, m = n - 1, m - 1
    a, b = ref[k:n], hyp[k:m]
    n, m = len(a), len(b)
    if n == 0 or m == 0:
        return 0, n, m
    places: dict[str, list[int]] = {}
    for i, x in enumerate(a):
        places.setdefault(x, []).append(i)
    rows, full = {}, (1 << n) - 1
    for x in places.keys() & set(b):
        bits = bytearray(n // 8 + 1)
        for i in places[x]:
            bits[i >> 3] |= 1 << (i & 7)
        rows[x] = int.from_bytes(bits, "little")

    def sweep(first: int, last: int, up: int, down: int) -> tuple[list[int], list[int], int, int]:
        same_of, up_of = [], []
        for j in range(first, last):
            eq = rows.get(b[j], 0) | down
            same = ((((eq & up) + up) ^ up) | eq) & full
            right = (down | (full & ~(same | up))) << 1 | 1
            up, down = (same & up) << 1 & full | (full & ~(same | right)), right & same
            same_of.append(same)
            up_of.append(up)
        return same_of, up_of, up, down

    block = max(KEPT_BITS // (2 * n), math.isqrt(m), 1)
    starts, up, down = [], full, 0
    for first in range(0, m, block):
        starts.append((up, down))
        same_of, up_of, up, down = sweep(first, min(first + block, m), up, down)
    i, j, subs, dels, at = n, m, 0, 0, len(starts) - 1
    while i and j:
        if (j - 1) // block != at:
            at = (j - 1) // block
            same_of, up_of, _, _ = sweep(at * block, (at + 1) * block, *starts[at])
        if a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
        elif not same_of[j - 1 - at * block] >> (i - 1) & 1:
            i, j, subs = i - 1, j - 1, subs + 1
        elif up_of[j - 1 - at * block] >> (i - 1) & 1:
            i, dels = i - 1, dels + 1
        else:
            j -= 1
    dels += i
    return subs, dels, dels - n + m


def edit_counts(df: DataFrame, ref: str, hyp: str, prefix: str, passthrough: list[str]) -> DataFrame:
    """Adds ``prefix``S/D/I/N for two array columns, or two texts taken by character."""
    names = [f"{prefix}{c}" for c in ("sub", "del", "ins", "ref")]
    whole = str if df.schema[ref].dataType == T.StringType() else list

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [(*align(r, h), len(r)) for r, h in zip(map(whole, pdf[ref]), map(whole, pdf[hyp]), strict=True)]
            out = pdf[passthrough].copy()
            for k, name in enumerate(names):
                out[name] = [g[k] for g in got]
            yield out

    schema = T.StructType([df.schema[c] for c in passthrough] + [T.StructField(n, T.LongType()) for n in names])
    return df.select(*dict.fromkeys([*passthrough, ref, hyp])).mapInPandas(run, schema)  # the other columns stay behind


def normalised(df: DataFrame) -> DataFrame:
    """Normalised reference and hypothesis, as words and as text without spaces."""
    words = lambda c: F.filter(F.split(F.col(c), " "), lambda w: w != "")
    letters = lambda c: F.replace(F.col(c), F.lit(" "), F.lit(""))
    base = df.withColumns({"ref_norm": recogniser_text(F.col("reference")), "hyp_norm": recogniser_text(F.col("hypothesis"))})
    return base.withColumns({"ref_words": words("ref_norm"), "hyp_words": words("hyp_norm"),
                             "ref_chars": letters("ref_norm"), "hyp_chars": letters("hyp_norm")})


def evaluate_pairs(df: DataFrame, keep: list[str]) -> DataFrame:
    """Word and character error counts and rates per utterance."""
    base = normalised(df).withColumn("exact", F.col("ref_norm") == F.col("hyp_norm"))
    kept = [*keep, "exact"]
    word = edit_counts(base, "ref_words", "hyp_words", "w_", [*kept, "ref_chars", "hyp_chars"])
    both = edit_counts(word, "ref_chars", "hyp_chars", "c_", [*kept, "w_sub", "w_del", "w_ins", "w_ref"])
    rate = lambda p: F.coalesce(F.try_divide(F.col(f"{p}sub") + F.col(f"{p}del") + F.col(f"{p}ins"), F.col(f"{p}ref")), F.lit(0.0))
    return both.withColumns({"wer": rate("w_"), "cer": rate("c_")})


def corpus_metrics(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Micro-averaged rates over utterances."""
    total = lambda p: F.sum(F.col(f"{p}sub") + F.col(f"{p}del") + F.col(f"{p}ins"))
    return pairs.groupBy(*keys).agg(
        F.count("*").alias("n_utterances"), F.count_distinct("speaker_id").alias("n_speakers"),
        F.try_divide(total("w_"), F.sum("w_ref")).alias("wer"), F.try_divide(total("c_"), F.sum("c_ref")).alias("cer_no_spaces"),
        F.avg(F.col("exact").cast("double")).alias("exact_match_rate"), F.sum("duration_s").alias("audio_duration_s"),
        F.sum("runtime_s").alias("runtime_s"), F.try_divide(F.sum("runtime_s"), F.sum("duration_s")).alias("real_time_factor"))


def corpus_counts(tokens: DataFrame, problems: DataFrame, media: str = "media_id") -> DataFrame:
    """Tokens, tokens with a confidence, and what ``timing_problems`` found: one row."""
    held = tokens.agg(F.count("*").alias("n_tokens"), F.count("confidence").alias("n_tokens_with_confidence"))
    found = problems.agg(F.count_distinct(media).alias("utterances_with_timing_problems"), F.count("*").alias("n_timing_problems"))
    return held.join(F.broadcast(found))  # one row each


def first_per_speaker(utts: DataFrame, n: int, *, speaker: str = "speaker_id", pos: str = "utt_id") -> DataFrame:
    """First utterance of each speaker in file order, exactly n of them."""
    firsts = utts.groupBy(speaker).agg(F.min(pos).alias(pos))
    found = firsts.limit(n).count()
    if found < n:
        raise ValueError(f"requested {n} speakers but only {found} are present")
    return utts.join(firsts.orderBy(pos).limit(n), [speaker, pos], "left_semi")


def timing_problems(tokens: DataFrame, durations: DataFrame, *, media: str = "media_id", idx: str = "tok_idx", bounded: bool | None = None) -> DataFrame:
    """One row per problem, by token index only: the text never leaves the table."""
    prev = with_lag(tokens.select(media, idx, "start_s", "end_s"), [media], [idx], {"_ps": "start_s", "_pe": "end_s"}, bounded=bounded)
    both = prev.join(durations, media, "left")  # without a duration only the order is judged
    kinds: list[Column] = [
        F.when(F.col("end_s") > F.col("duration_s") + 0.5, F.lit("past_end")),
        F.when(F.col("start_s") < F.col("_ps"), F.lit("start_before_previous")),
        F.when(F.col("start_s") < F.col("_pe") - 1e-6, F.lit("overlap"))]
    return both.select(media, idx, F.explode_outer(F.array_compact(F.array(*kinds))).alias("problem")).where("problem is not null")


