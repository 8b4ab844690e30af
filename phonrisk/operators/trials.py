"""Scoring of calibration trials: one response string to three position observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phonrisk.functions import hangul as hg
from phonrisk.functions.text import nfc

# Answers that count as declining to answer.
DECLINE = ("", "?", "??", "-", "x", "X", "모름", "못들음", "무응답")


def _position_error(position: str, target: Column, perceived: Column) -> Column:
    out = F.when(perceived == hg.NO_RESPONSE, "no_response").when(target == perceived, "correct")
    empty = {"coda": hg.NO_CODA, "onset": hg.NULL_ONSET}.get(position)
    if empty:
        out = out.when(perceived == empty, "omission").when(target == empty, "addition")
    return out.otherwise("substitution")


def score_trials(trials: DataFrame) -> DataFrame:
    """Adds response quality, the three observations and the whole-trial error.

    Always three observations: an unusable answer gives three ``no_response`` rows. Targets
    are curated, so a malformed one stops the job.
    """
    target = nfc(F.col("target"))
    cleaned = trials.withColumn("_t", target).withColumn(
        "_r", nfc(F.regexp_replace("response", r"(?U)^\s+|\s+$", "")))
    cleaned = cleaned.withColumn("_t", F.when(hg.is_syllable(F.col("_t")), F.col("_t")).otherwise(
        F.raise_error(F.lit("calibration target must be one Hangul syllable")).cast("string")))
    found = hg.syllables(F.col("_r"))
    quality = (F.when(F.col("_r").isin(*DECLINE), "blank").when(F.size("_f") == 0, "non_hangul")
               .when(F.size("_f") > 1, "multi_syllable").otherwise("ok"))
    parsed = cleaned.withColumn("_f", found).withColumn("quality", quality).withColumn(
        "response_syllable", F.when(F.col("quality").isin("ok", "multi_syllable"), F.element_at("_f", 1)))
    t, r = F.col("_t"), F.col("response_syllable")
    obs = []
    for pos, part in (("onset", hg.onset), ("nucleus", hg.nucleus), ("coda", hg.coda)):
        perceived = F.coalesce(part(r), F.lit(hg.NO_RESPONSE))
        obs.append(F.struct(F.lit(pos).alias("position"), part(t).alias("target"), perceived.alias("perceived"),
                            _position_error(pos, part(t), perceived).alias("error_type")))
    scored = parsed.withColumn("observations", F.array(*obs))
    wrong = F.filter("observations", lambda o: o["error_type"] != "correct")
    error = (F.when(r.isNull(), "no_response").when(F.size(wrong) == 0, "correct")
             .when(F.size(wrong) > 1, "compound").otherwise(F.concat(wrong[0]["position"], F.lit("_error"))))
    return scored.withColumn("trial_error", error).drop("_t", "_r", "_f")


def observations(scored: DataFrame, *keep: str) -> DataFrame:
    """One row per (trial, position)."""
    return scored.select(*keep, F.inline_outer("observations"))


def merge_trials(earlier: DataFrame, incoming: DataFrame) -> DataFrame:
    """Earlier and incoming trials of the same listeners, nothing dropped."""
    return earlier.unionByName(incoming)


def error_distribution(scored: DataFrame, keys: list[str]) -> DataFrame:
    names = ["correct", "onset_error", "nucleus_error", "coda_error", "compound", "no_response"]
    return scored.groupBy(*keys).pivot("trial_error", names).count().na.fill(0, names)
