"""Dimension tables of the jamo alphabets: 68 targets, 71 perceived categories (fixed size)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phonrisk.functions import hangul as hg

SLOT_BASE = {"onset": 0, "nucleus": len(hg.ONSETS), "coda": len(hg.ONSETS) + len(hg.NUCLEI)}
N_TARGETS = sum(len(a) for a in hg.ALPHABET.values())
CLASS_NAMES = (
    [f"onset_manner_{m}" for m in sorted(hg.MANNER)] + [f"onset_phon_{p}" for p in sorted(hg.PHONATION)]
    + [f"nucleus_{s}" for s in sorted(hg.SHAPE)]
    + [f"coda_{'none' if c == hg.NO_CODA else c}" for c in hg.SURFACE_CODAS]
)


def _surface(symbol: str) -> str:
    return hg.class_of(hg.CODA_SURFACE, symbol) or symbol


def sound_class(position: str, symbol: str) -> str | None:
    if position == "onset":
        return hg.class_of(hg.MANNER, symbol)
    if position == "nucleus":
        return hg.class_of(hg.SHAPE, symbol)
    return None if symbol == hg.NO_RESPONSE else _surface(symbol)


def classes_of(position: str, symbol: str) -> list[str]:
    """Weakness / share classes a target counts towards (two for onsets, one otherwise)."""
    if position == "onset":
        return [f"onset_manner_{hg.class_of(hg.MANNER, symbol)}", f"onset_phon_{hg.class_of(hg.PHONATION, symbol)}"]
    if position == "nucleus":
        return [f"nucleus_{hg.class_of(hg.SHAPE, symbol)}"]
    return [f"coda_{'none' if symbol == hg.NO_CODA else _surface(symbol)}"]


def dim_target(spark: SparkSession) -> DataFrame:
    rows = []
    for pos, alphabet in hg.ALPHABET.items():
        for i, s in enumerate(alphabet):
            mask = [j != i and sound_class(pos, t) == sound_class(pos, s) for j, t in enumerate(alphabet)] + [False]
            surface = _surface(s) if pos == "coda" else None
            rows.append((
                pos, i, SLOT_BASE[pos] + i, s, len(alphabet) + 1,
                hg.class_of(hg.MANNER, s) if pos == "onset" else None,
                hg.class_of(hg.PHONATION, s) if pos == "onset" else None,
                hg.class_of(hg.PLACE, s) if pos == "onset" else None,
                hg.class_of(hg.SHAPE, s) if pos == "nucleus" else None,
                (s in hg.ROUNDED) if pos == "nucleus" else None,
                surface, (s in hg.CODA_CLUSTERS) if pos == "coda" else None,
                (s != hg.NO_CODA) if pos == "coda" else None,
                SLOT_BASE[pos] + (alphabet.index(surface) if surface else i),
                sound_class(pos, s), classes_of(pos, s), mask))
    return spark.createDataFrame(rows, (
        "position string, idx int, slot int, symbol string, k int, manner string, phonation string, place string, "
        "shape string, rounded boolean, surface string, is_cluster boolean, present boolean, surface_slot int, "
        "sound_class string, classes array<string>, same_mask array<boolean>"))


def dim_perceived(spark: SparkSession) -> DataFrame:
    rows = [(pos, i, s, sound_class(pos, s) if s != hg.NO_RESPONSE else None)
            for pos, alphabet in hg.ALPHABET.items() for i, s in enumerate(alphabet + hg.NO_RESPONSE)]
    return spark.createDataFrame(rows, "position string, idx int, symbol string, sound_class string")


def perceived_index(position, symbol):
    """Column index of a perceived category inside its position's alphabet."""
    def at(alphabet):
        return F.call_function("locate", symbol, F.lit(alphabet + hg.NO_RESPONSE)) - 1

    return F.when(position == "onset", at(hg.ONSETS)).when(position == "nucleus", at(hg.NUCLEI)).otherwise(at(hg.CODAS))


def unknown_categories(df: DataFrame, symbol: str, *, axis: str = "target") -> DataFrame:
    """Rows whose category is not in its position's alphabet."""
    dim = (dim_target if axis == "target" else dim_perceived)(df.sparkSession)
    dim = dim.select("position", F.col("symbol").alias(symbol))
    return df.join(F.broadcast(dim), ["position", symbol], "left_anti")  # fixed 68 / 71 rows


def alphabet_sizes(spark: SparkSession) -> DataFrame:
    t = dim_target(spark).groupBy("position").agg(F.count("*").alias("n_target"))
    p = dim_perceived(spark).groupBy("position").agg(F.count("*").alias("n_perceived"))
    return t.join(p, "position")


def incomplete_classes(spark: SparkSession) -> DataFrame:
    """Targets without a class (must be empty)."""
    d = dim_target(spark)
    return d.where(F.coalesce("manner", "shape", "surface").isNull() | (F.size("classes") == 0))


def similarity(spark: SparkSession) -> DataFrame:
    """Phonological similarity of every target with every perceived category of its position."""
    a = dim_target(spark).alias("a")
    b = dim_target(spark).alias("b")
    pairs = a.join(F.broadcast(b), F.col("a.position") == F.col("b.position"))  # alphabet-sized
    same = lambda c: F.when(F.col(f"a.{c}") == F.col(f"b.{c}"), 1).otherwise(0)
    value = (
        F.when(F.col("a.symbol") == F.col("b.symbol"), 1.0)
        .when(F.col("a.position") == "onset", (same("place") + same("manner") + same("phonation")) / 3.0)
        .when(F.col("a.position") == "nucleus", (same("shape") + same("rounded")) / 2.0)
        .when((F.col("a.symbol") == hg.NO_CODA) | (F.col("b.symbol") == hg.NO_CODA), 0.0)
        .when(F.col("a.surface") == F.col("b.surface"), 1.0).otherwise(0.25))
    known = pairs.select(F.col("a.position").alias("position"), F.col("a.symbol").alias("target"),
                         F.col("b.symbol").alias("perceived"), value.alias("similarity"))
    silent = dim_target(spark).select("position", F.col("symbol").alias("target"),
                                      F.lit(hg.NO_RESPONSE).alias("perceived"), F.lit(0.0).alias("similarity"))
    return known.unionByName(silent)
