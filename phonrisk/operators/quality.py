"""Row rules with quarantine, contracts on columns, and profile readiness."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phonrisk.operators import dims
from phonrisk.operators.features import ARMS, arm_columns

# Live input contract.
LIVE_CONTRACT = "live-caption-v1"
FORBIDDEN_LIVE = ("c_snr_db", "c_speaker_male", "c_speaker_female", "c_speaker_unknown")
ALLOWED_LIVE_BLOCKS = ("word", "pta", "clinical", "confusion", "confusion_rich", "exact_target", "exact_target_offdiag")
FAMILIES = (
    ("word", "w_", "available"), ("context", "c_", "unavailable"), ("pta", "h_", "available"), ("clinical", "h_", "available"),
    ("confusion", "x_", "available"), ("confusion_rich", "ix_/w2_/x2_", "available"), ("exact_target", "et_", "available"),
    ("exact_target_offdiag", "eo_", "available"))


class ContractViolation(ValueError):
    """A feature set breaks the input contract it claims to follow."""


def with_reasons(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Adds ``reasons``: the names of the rules a row breaks. Unknown counts as kept."""
    checks = [F.when(F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in rules.items()]
    return df.withColumn("reasons", F.array_compact(F.array(*checks)))


def split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, quarantined) of a table with ``reasons``."""
    return df.where(F.size("reasons") == 0).drop("reasons"), df.where(F.size("reasons") > 0)


def _bad_number(c: str) -> Column:
    x = F.col(c)
    return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))


def token_rules() -> dict[str, Column]:
    return {"bad_time": _bad_number("start_s") | _bad_number("end_s"), "negative_start": F.col("start_s") < 0,
            "ends_before_start": F.col("end_s") < F.col("start_s"), "bad_confidence": ~F.col("confidence").between(0, 1)}


def transcript_rules() -> dict[str, Column]:
    return {"bad_duration": _bad_number("duration_s") | (F.col("duration_s") < 0), "bad_language_probability": ~F.col("language_probability").between(0, 1)}


def risk_rules() -> dict[str, Column]:
    return {"bad_risk": _bad_number("listener_risk") | ~F.col("listener_risk").between(0, 1), "bad_confidence": ~F.col("confidence").between(0, 1)}


def identity_problems(requests: DataFrame, hearing: DataFrame, confusion: DataFrame) -> DataFrame:
    """Whose hearing and confusion profiles do not belong to the requested listener."""
    h = hearing.select("listener_id", F.col("owner_id").alias("_ho"), F.col("is_synthetic").alias("_hs"))
    c = confusion.select("listener_id", F.col("owner_id").alias("_co"), F.col("is_synthetic").alias("_cs"))
    both = requests.join(h, "listener_id", "left").join(c, "listener_id", "left")
    return with_reasons(both, {
        "hearing_of_other_listener": F.col("_ho") != F.col("listener_id"), "confusion_of_other_listener": F.col("_co") != F.col("listener_id"),
        "provenance_mismatch": F.col("_hs") != F.col("_cs")}).drop("_ho", "_hs", "_co", "_cs")


def readiness(requests: DataFrame, hearing: DataFrame, confusion: DataFrame, arm: str, *, min_trials: int = 10, fitted: bool = True) -> DataFrame:
    """Why a listener cannot be scored with ``arm`` yet; empty reasons mean ready."""
    blocks = set(ARMS[arm])
    both = (requests.join(hearing.select("listener_id", F.lit(True).alias("_h")), "listener_id", "left")
            .join(confusion.select("listener_id", "n_trials"), "listener_id", "left"))
    rules = {"model_not_fitted": F.lit(not fitted)}
    if blocks & {"pta", "clinical"}:
        rules["no_hearing_profile"] = F.col("_h").isNull()
    if "confusion" in blocks:
        rules["no_confusion_profile"] = F.col("n_trials").isNull()
        rules["too_few_trials"] = F.col("n_trials") < min_trials
    return with_reasons(both, rules).drop("_h")


def submission_problems(trials: DataFrame, catalog: DataFrame) -> DataFrame:
    """Submitted trials against the catalogue: unknown stimulus, or another target."""
    known = catalog.select("stimulus_id", F.col("syllable").alias("_s"))
    out = trials.join(known, "stimulus_id", "left")
    return with_reasons(out, {"unknown_stimulus": F.col("_s").isNull(), "wrong_target": F.col("_s") != F.col("target")}).drop("_s")


def column_violations(columns: Iterable[str], *, acoustic: bool = False) -> list[str]:
    """Columns a text-only live model may not see."""
    names = list(columns)
    bad = {c for c in names if c in FORBIDDEN_LIVE}
    if not acoustic:
        bad |= {c for c in names if c.startswith("c_")}
    return sorted(bad)


def check_columns(columns: Iterable[str], *, acoustic: bool = False) -> None:
    bad = column_violations(columns, acoustic=acoustic)
    if bad:
        raise ContractViolation(f"columns not allowed under {LIVE_CONTRACT}: {bad}")


def check_blocks(arm: str) -> None:
    bad = [b for b in ARMS[arm] if b not in ALLOWED_LIVE_BLOCKS]
    if bad:
        raise ContractViolation(f"blocks not allowed under {LIVE_CONTRACT}: {bad}")


def schema_hash(columns: Iterable[str], contract: str = LIVE_CONTRACT) -> str:
    """Digest of the contract version and the ordered column names."""
    text = contract + "\0" + "".join(f"{c}\n" for c in columns)
    return hashlib.sha256(text.encode()).hexdigest()


def label_problems(stored: DataFrame, key: list[str]) -> DataFrame:
    """Stored alphabets (key, position, idx, label) that are short, unknown or reordered."""
    d = dims.dim_target(stored.sparkSession).select("position", "idx", F.col("symbol").alias("_s"))
    seen = stored.select(*key, "position").distinct().join(F.broadcast(d), "position")  # 68 rows
    both = seen.join(stored, [*key, "position", "idx"], "full_outer")
    why = (F.when(F.col("label").isNull(), "absent").when(F.col("_s").isNull(), "unknown").when(F.col("label") != F.col("_s"), "mismatch"))
    return both.withColumn("reason", why).where("reason is not null").select(*key, "position", "idx", "label", "reason")


def mixed_provenance(profiles: DataFrame, keys: list[str]) -> DataFrame:
    """Groups that mix synthetic and observed profiles (must be empty)."""
    return profiles.groupBy(*keys).agg(F.count_distinct("is_synthetic").alias("n_kinds"), F.count("*").alias("n_profiles")).where("n_kinds > 1")


def availability(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(FAMILIES), "block string, prefix string, availability string")


def check_matrix(df: DataFrame, arm: str) -> None:
    """The feature columns are exactly the arm's, in order."""
    want = arm_columns(arm)
    have = [c for c in df.columns if c in set(want) or c.split("_")[0] in ("w", "c", "h", "x", "ix", "w2", "x2", "et", "eo")]
    if have != want:
        raise ValueError(f"feature columns drifted: {sorted(set(have) ^ set(want))[:5]}")
