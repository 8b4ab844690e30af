"""Listener-level folds, hold-outs and leakage guards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phonrisk.functions.text import hash32
from phonrisk.operators.ordered import rank_rows


class LeakageError(ValueError):
    """A listener appears on both sides of a split."""


def _seeded(seed: int, listener: str):
    return hash32(F.concat_ws(":", F.lit(f"fold{seed}"), F.col(listener)))


def listener_folds(df: DataFrame, k: int, *, listener: str = "listener_id", y: str = "misheard", stratify: bool = True, seed: int = 0,
                   bounded: bool | None = None) -> DataFrame:
    """(listener, fold): whole listeners, base rates balanced by dealing them out in a snake."""
    if k < 2:
        raise ValueError("at least two folds are needed")
    per = df.groupBy(listener).agg(F.sum(y).alias("pos"), F.count("*").alias("n"))
    if per.limit(k).count() < k:
        raise ValueError(f"fewer than {k} listeners")
    if not stratify:
        ranked = rank_rows(per, [], [F.col("n").desc(), listener], bounded=bounded)
        return ranked.select(listener, F.pmod(F.col("rn") - 1, F.lit(k)).cast("int").alias("fold"))
    ranked = rank_rows(per.withColumn("_h", _seeded(seed, listener)).withColumn("_r", F.round(F.col("pos") / F.col("n"), 9)),
                       [], ["_r", "_h", listener], bounded=bounded)
    i = F.col("rn") - 1
    lap, at = F.floor(i / k), F.pmod(i, F.lit(k))
    return ranked.select(listener, F.when(lap % 2 == 0, at).otherwise(k - 1 - at).cast("int").alias("fold"))


def leave_one_out(df: DataFrame, listener: str = "listener_id", *, bounded: bool | None = None) -> DataFrame:
    ranked = rank_rows(df.select(listener).distinct(), [], [listener], bounded=bounded)
    return ranked.select(listener, (F.col("rn") - 1).alias("fold"))


def fold_summary(df: DataFrame, folds: DataFrame, listener: str = "listener_id", y: str = "misheard") -> DataFrame:
    """Held-out and training sizes of each fold; membership itself stays the (listener, fold) table."""
    per = df.groupBy(listener).agg(F.count("*").alias("n"), F.sum(y).alias("pos")).join(folds, listener)
    test = per.groupBy("fold").agg(F.sum("n").alias("n_test"), F.count("*").alias("n_test_listeners"), (F.sum("pos") / F.sum("n")).alias("test_rate"))
    total = per.agg(F.sum("n").alias("_n"), F.count("*").alias("_l"))
    return test.join(F.broadcast(total)).select(  # one row
        "fold", "n_test", "n_test_listeners", "test_rate", (F.col("_n") - F.col("n_test")).alias("n_train"),
        (F.col("_l") - F.col("n_test_listeners")).alias("n_train_listeners"))


def leaked_listeners(assigned: DataFrame, listener: str = "listener_id") -> DataFrame:
    """Listeners in more than one fold (must be empty)."""
    return assigned.groupBy(listener).agg(F.count_distinct("fold").alias("n_folds")).where("n_folds > 1")


def shared_listeners(train: DataFrame, test: DataFrame, listener: str = "listener_id") -> DataFrame:
    return train.select(listener).intersect(test.select(listener))


def assert_no_leak(leaks: DataFrame) -> None:
    names = [r[0] for r in leaks.limit(5).collect()]
    if names:
        raise LeakageError(f"listeners on both sides of the split, for example {names}")


def prior_leaks(contributors: DataFrame, held_out: DataFrame, listener: str = "listener_id") -> DataFrame:
    """Prior contributors that are also held out (must be empty)."""
    return contributors.select(listener).distinct().join(held_out.select(listener).distinct(), listener, "left_semi")


def leaky_folds(df: DataFrame, k: int, row: str = "row_id") -> DataFrame:
    """Row-level split; exists so that the guard can be shown to fire."""
    return df.withColumn("fold", F.pmod(F.xxhash64(row), F.lit(k)).cast("int"))


def calibration_holdout(df: DataFrame, fraction: float = 0.25, *, listener: str = "listener_id", seed: int = 0, bounded: bool | None = None) -> DataFrame:
    """(listener, held_out): at least one and at most all but one listener held out."""
    if not 0 < fraction < 1:
        raise ValueError("holdout fraction must be in (0, 1)")
    who = df.select(listener).distinct().withColumn("_h", _seeded(seed, listener))
    ranked = rank_rows(who, [], ["_h", listener], total="_n", bounded=bounded)
    size = F.least(F.greatest(F.rint(F.lit(float(fraction)) * F.col("_n")), F.lit(1.0)), F.col("_n") - 1.0)
    return ranked.select(listener, (F.col("rn") <= size).alias("held_out"))


def prediction_gaps(rows: DataFrame, predictions: DataFrame, row: str = "row_id") -> DataFrame:
    """Rows not predicted exactly once (must be empty)."""
    n = predictions.groupBy(row).agg(F.count("*").alias("n"))
    return rows.select(row).join(n, row, "left").withColumn("n", F.coalesce("n", F.lit(0))).where("n <> 1")


def fold_counts(counts: DataFrame, folds: DataFrame, listener: str = "listener_id") -> DataFrame:
    """Training counts of every fold in one pass: total minus the fold's own subtotal."""
    cell = ["position", "target", "perceived"]
    sub = counts.join(folds, listener).groupBy("fold", *cell).agg(F.sum("n").alias("_own"))
    total = sub.groupBy(*cell).agg(F.sum("_own").alias("_all"))
    every = folds.select("fold").distinct()
    grid = total.join(F.broadcast(every))  # cells x folds: alphabet-sized
    return (grid.join(sub, ["fold", *cell], "left")
            .select("fold", *cell, (F.col("_all") - F.coalesce("_own", F.lit(0))).alias("n")).where("n > 0"))
