"""Clinical measures derived from audiograms and speech audiometry.

An ear has at most nine standard frequencies and a handful of levels, so one shuffle packs an
ear into a map and everything after it is row-local.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Named averages, standard frequencies, severity bounds (right-open).
PTA_METHODS = {
    "pta3_500_1000_2000": (500, 1000, 2000),
    "pta4_500_1000_2000_4000": (500, 1000, 2000, 4000),
    "pta4_500_1000_2000_3000": (500, 1000, 2000, 3000),
    "pta6_500_1000_2000_3000_4000_6000": (500, 1000, 2000, 3000, 4000, 6000),
    "hfa_1000_2000_4000": (1000, 2000, 4000),
}
DEFAULT_PTA = "pta4_500_1000_2000_4000"
STANDARD_HZ = (125, 250, 500, 1000, 2000, 3000, 4000, 6000, 8000)
HIGH_HZ = (4000, 6000, 8000)
DB_RANGE = (-10.0, 130.0)
SEVERITY = {
    "who2021": ((20, "normal"), (35, "mild"), (50, "moderate"), (65, "moderately_severe"), (80, "severe"),
                (95, "profound"), (None, "complete")),
    "korean_study_4group": ((20, "normal"), (35, "mild"), (50, "moderate"), (None, "severe")),
}
CLINICAL_FIELDS = ("better_ear_pta", "worse_ear_pta", "srt", "wrs", "pbmax", "mcl", "audiogram_slope")
EAR = ["listener_id", "ear"]


def ears(points: DataFrame, keys: list[str] = EAR) -> DataFrame:
    """One row per ear: measured thresholds as MAP<hz, dB>."""
    measured = F.col("db_hl").isNotNull() & ~F.col("no_response")
    return points.groupBy(*keys).agg(F.map_from_entries(
        F.collect_list(F.when(measured, F.struct("hz", "db_hl")))).alias("thr"))  # <= 9 per ear


def _required(method: str) -> Column:
    return F.array(*[F.lit(hz) for hz in PTA_METHODS[method]])


def pta(method: str = DEFAULT_PTA) -> Column:
    """Average over the method's frequencies, null unless every one was measured."""
    values = [F.try_element_at("thr", F.lit(hz)) for hz in PTA_METHODS[method]]
    total = values[0]
    for v in values[1:]:
        total = total + v
    return total / len(values)


def pta_by_method(ear_rows: DataFrame) -> DataFrame:
    """One row per ear and method with its required and missing frequencies."""
    each = F.array(*[F.struct(F.lit(m).alias("method"), pta(m).alias("pta"), _required(m).alias("required"))
                     for m in PTA_METHODS])
    out = ear_rows.select(*EAR, "thr", F.inline_outer(each))
    return out.withColumn("missing", F.filter("required", lambda hz: F.try_element_at("thr", hz).isNull())).drop("thr")


def slope() -> Column:
    """Mean change per octave from 500 to 4000 Hz."""
    return (F.try_element_at("thr", F.lit(4000)) - F.try_element_at("thr", F.lit(500))) / 3.0


def severity(value: Column, scheme: str = "who2021") -> Column:
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for upper, label in SEVERITY[scheme]:
        out = out.when(value < upper, label) if upper is not None else out.otherwise(label)
    return out


def pi_function(pi_points: DataFrame) -> DataFrame:
    """PBmax, its (lowest) level and the rollover index per ear."""
    packed = pi_points.groupBy(*EAR).agg(
        F.max("score_percent").alias("pbmax"),
        F.max_by("level_db_hl", F.struct(F.col("score_percent"), -F.col("level_db_hl"))).alias("pbmax_level"),
        F.collect_list(F.struct("level_db_hl", "score_percent")).alias("_pts"))  # one curve: a few levels
    above = F.transform(F.filter("_pts", lambda p: p["level_db_hl"] > F.col("pbmax_level")), lambda p: p["score_percent"])
    low = F.array_min(above)
    return packed.withColumn("rollover_index", F.when(F.col("pbmax") != 0, (F.col("pbmax") - low) / F.col("pbmax"))).drop("_pts")


def dynamic_range() -> Column:
    return F.col("ucl_db_hl") - F.col("mcl_db_hl")


def ear_summary(points: DataFrame, speech: DataFrame, pi_points: DataFrame, loudness: DataFrame) -> DataFrame:
    base = ears(points).select(
        *EAR, pta().alias("pta"), slope().alias("slope"),
        F.expr("filter(array({}), x -> x is not null)".format(
            ",".join(f"try_element_at(thr, {hz})" for hz in HIGH_HZ))).alias("high"))
    return (base.join(speech, EAR, "full_outer").join(pi_function(pi_points), EAR, "full_outer")
            .join(loudness, EAR, "full_outer"))


def listener_summary(points: DataFrame, speech: DataFrame, pi_points: DataFrame, loudness: DataFrame) -> DataFrame:
    """Flat per-listener measures over both ears, availability and completeness."""
    e = ear_summary(points, speech, pi_points, loudness)
    high = F.flatten(F.collect_list("high"))  # two ears, three frequencies
    out = e.groupBy("listener_id").agg(
        F.max(F.when(F.col("ear") == "left", F.col("pta"))).alias("pta_left"),
        F.max(F.when(F.col("ear") == "right", F.col("pta"))).alias("pta_right"),
        F.min("pta").alias("better_ear_pta"), F.max("pta").alias("worse_ear_pta"), F.avg("slope").alias("audiogram_slope"),
        F.min("srt_db_hl").alias("srt"), F.max("wrs_percent").alias("wrs"), F.avg("wrs_percent").alias("mean_wrs"),
        F.max("pbmax").alias("pbmax"), F.min("mcl_db_hl").alias("mcl"), high.alias("_high"))
    total = F.aggregate("_high", F.lit(0.0), lambda a, x: a + x)
    flags = [F.when(F.col(f).isNull(), F.lit(f)) for f in CLINICAL_FIELDS]
    return (out.withColumn("high_freq_mean", F.when(F.size("_high") > 0, total / F.size("_high"))).drop("_high")
            .withColumn("missing", F.array_compact(F.array(*flags)))
            .withColumn("completeness", 1 - F.size("missing") / float(len(CLINICAL_FIELDS)))
            .withColumn("severity_who", severity(F.col("better_ear_pta")))
            .withColumn("severity_4group", severity(F.col("better_ear_pta"), "korean_study_4group")))


def violations(points: DataFrame, speech: DataFrame, pi_points: DataFrame, loudness: DataFrame, meta: DataFrame) -> DataFrame:
    """One row per broken rule: (listener_id, ear, rule)."""
    lo, hi = DB_RANGE

    def out_of_range(*cols: str) -> Column:
        bad = F.lit(False)
        for c in cols:
            bad = bad | F.coalesce(~F.col(c).between(lo, hi), F.lit(False))
        return bad

    def broken(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
        names = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules.items()]))
        ear = F.col("ear") if "ear" in df.columns else F.lit(None).cast("string")
        return df.select("listener_id", ear.alias("ear"), F.explode_outer(names).alias("rule")).where("rule is not null")

    pct = lambda c: F.coalesce(~F.col(c).between(0, 100), F.lit(False))
    both = F.col("ucl_db_hl") < F.col("mcl_db_hl")
    twice = (pi_points.groupBy(*EAR, "level_db_hl").count().where("count > 1")
             .select(*EAR, F.lit("duplicate_level").alias("rule")).distinct())
    # An ear's speech scores, functions and levels go with an audiogram of the same ear.
    measured = speech.select(*EAR).unionByName(pi_points.select(*EAR)).unionByName(loudness.select(*EAR)).distinct()
    astray = measured.join(points.select(*EAR).distinct(), EAR, "left_anti").select(*EAR, F.lit("ear_without_audiogram").alias("rule"))
    anything = points.select("listener_id").unionByName(measured.select("listener_id")).distinct()
    no_ear = meta.join(anything, "listener_id", "left_anti").select(
        "listener_id", F.lit(None).cast("string").alias("ear"), F.lit("no_ear").alias("rule"))
    return (broken(points, {"db_range": out_of_range("db_hl"), "standard_hz": ~F.col("hz").isin(*STANDARD_HZ),
                            "no_response_needs_level": F.col("no_response") & F.col("db_hl").isNull()})
            .unionByName(broken(speech, {"db_range": out_of_range("srt_db_hl", "wrs_level_db_hl"), "percent_range": pct("wrs_percent"),
                                         "wrs_needs_level": F.col("wrs_percent").isNotNull() & F.col("wrs_level_db_hl").isNull()}))
            .unionByName(broken(pi_points, {"percent_range": pct("score_percent"), "db_range": out_of_range("level_db_hl")}))
            .unionByName(twice)
            .unionByName(broken(loudness, {"db_range": out_of_range("mcl_db_hl", "ucl_db_hl"), "ucl_below_mcl": F.coalesce(both, F.lit(False))}))
            .unionByName(broken(meta, {"source_synthetic": (F.col("source") == "synthetic") != F.col("is_synthetic")}))
            .unionByName(astray)
            .unionByName(no_ear))
