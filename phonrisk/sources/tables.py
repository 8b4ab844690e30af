"""Readers and sinks with fixed schemas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phonrisk.functions.hangul import structure
from phonrisk.operators.ordered import rank_rows
from phonrisk.session import durable, scratch_dir

STIMULUS_COLUMNS = ("Audio Sample ID", "file_name", "Speaker Gender_Pronounced Answer", "Syllable", "Total Duration", "Mean Pitch", "F1", "F2 (Hz)", "F3 (Hz)")
STIMULUS_SCHEMA = ", ".join(f"`{c}` string" for c in STIMULUS_COLUMNS)
RESPONSE_SCHEMA = "trial_id bigint, listener_id bigint, stimulus_id bigint, target string, response string, condition string"
POINT = "struct<db_hl: double, no_response: boolean, masked: boolean>"
EAR = f"struct<audiogram: map<string, {POINT}>>"  # JSON keys are strings
PROFILE_SCHEMA = f"listener_id bigint, source string, is_synthetic boolean, `left` {EAR}, `right` {EAR}"
TOKEN = "struct<tok_idx: bigint, text: string, start_s: double, end_s: double, confidence: double>"
TRANSCRIPT_SCHEMA = f"media_id bigint, part bigint, backend string, duration_s double, tokens array<{TOKEN}>"
PART_TOKENS = 10_000


def read_utterances(spark: SparkSession, path: str, *, columns: tuple[str, ...] = ("utt_id", "speaker_id", "reference"), limit: int | None = None,
                    positions: DataFrame | None = None, pos: str = "utt_id") -> DataFrame:
    """Projected scan: heavy columns are read only when named. ``limit`` keeps file order."""
    df = spark.read.parquet(path).select(*columns)
    if positions is not None:
        df = df.join(positions.select(pos), pos, "left_semi")
    return df.orderBy(pos).limit(limit) if limit is not None else df


def read_stimuli(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(stimuli, quarantined rows) of a published CSV: padded headers, labels like ``남자_가``."""
    raw = spark.read.schema(STIMULUS_SCHEMA).csv(path, header=True, enforceSchema=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    label = F.trim(F.col("Speaker Gender_Pronounced Answer"))
    pattern = r"^\s*([^_]+)_(.+?)\s*$"
    gender = F.regexp_extract(label, pattern, 1)
    number = lambda c: F.expr(f"try_cast(trim(`{c}`) as double)")
    parsed = raw.withColumn("label", label).withColumn("syllable", F.regexp_extract(label, pattern, 2)).select(
        F.concat(F.lit("kmsp-"), F.trim(F.col("Audio Sample ID"))).alias("stimulus_id"), "label", "syllable",
        F.when(gender == "남자", "male").when(gender == "여자", "female").otherwise(gender).alias("speaker"),
        F.coalesce(F.nullif(F.trim(F.col("Syllable")), F.lit("")), structure(F.col("syllable"))).alias("structure"), F.trim(F.col("file_name")).alias("audio_path"),
        number("Total Duration").alias("duration_s"), number("Mean Pitch").alias("mean_pitch_hz"),
        number("F1").alias("f1_hz"), number("F2 (Hz)").alias("f2_hz"), number("F3 (Hz)").alias("f3_hz"))
    ok = F.coalesce(F.col("label").rlike(pattern), F.lit(False))
    return parsed.where(ok), parsed.where(~ok)


def append_responses(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RESPONSE_SCHEMA).option("mode", "FAILFAST").json(path)


def nest_profiles(points: DataFrame, meta: DataFrame) -> DataFrame:
    """Nested profile rows from flat audiogram points (nine frequencies an ear)."""
    entry = F.struct(F.col("hz").cast("int"), F.struct("db_hl", "no_response", "masked"))
    ear = lambda e: F.struct(F.map_from_entries(F.collect_list(F.when(F.col("ear") == e, entry))).alias("audiogram")).alias(e)
    return points.groupBy("listener_id").agg(ear("left"), ear("right")).join(meta.select("listener_id", "source", "is_synthetic"), "listener_id")


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PROFILE_SCHEMA).option("mode", "FAILFAST").json(path)


def flatten_profiles(profiles: DataFrame) -> DataFrame:
    """audiogram_points rows of nested profiles."""
    ears = F.array(*[F.struct(F.lit(e).alias("ear"), F.map_entries(F.col(f"{e}.audiogram")).alias("pts")) for e in ("left", "right")])
    flat = profiles.select("listener_id", F.inline_outer(ears)).select("listener_id", "ear", F.explode_outer("pts").alias("p")).where("p is not null")
    return flat.select("listener_id", "ear", F.col("p.key").cast("int").alias("hz"), F.col("p.value.db_hl").alias("db_hl"),
                       F.col("p.value.no_response").alias("no_response"), F.col("p.value.masked").alias("masked"))


def pack_transcripts(tokens: DataFrame, backend: str, part_tokens: int = PART_TOKENS) -> DataFrame:
    """Transcript rows for a JSON sink. A long media becomes several parts of bounded size."""
    durations = tokens.groupBy("media_id").agg(F.max("end_s").alias("duration_s"))
    item = F.struct(F.col("tok_idx").cast("bigint").alias("tok_idx"), "text", "start_s", "end_s", "confidence")
    parts = tokens.groupBy("media_id", F.floor(F.col("tok_idx") / part_tokens).alias("part")).agg(F.array_sort(F.collect_list(item)).alias("tokens"))
    return parts.join(durations, "media_id").select("media_id", "part", F.lit(backend).alias("backend"), "duration_s", "tokens")


def read_transcripts(spark: SparkSession, path: str, replayed_from: str) -> DataFrame:
    """One row per recorded token; the original backend is kept and the replay is flagged."""
    raw = spark.read.schema(TRANSCRIPT_SCHEMA).option("mode", "FAILFAST").json(path)
    # A media may be stored in several parts; without a stored duration it lasts to its last token.
    last = F.aggregate("tokens", F.lit(None).cast("double"), lambda a, t: F.greatest(a, t["end_s"]))
    lasts = raw.groupBy("media_id").agg(F.max(F.coalesce("duration_s", last)).alias("_lasts"))
    raw = raw.join(lasts, "media_id", "left")
    return raw.select("media_id", "backend", F.coalesce("duration_s", "_lasts").alias("duration_s"), F.lit(replayed_from).alias("replayed_from"),
                      F.inline_outer("tokens")).where("tok_idx is not null")


def media_mismatches(requested: DataFrame, recorded: DataFrame) -> DataFrame:
    """Requested media a recording does not cover."""
    return requested.join(recorded.select("media_id").distinct(), "media_id", "left_anti")


def write_runs(df: DataFrame, path: str) -> None:
    df.write.mode("append").partitionBy("run_id").parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """One CSV file with a header; report tables hold one row per arm and metric."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def export_listener(tables: dict[str, DataFrame], listener: int, key: str = "listener_id") -> DataFrame:
    """Everything held about one listener: (table, row as JSON)."""
    parts = [df.where(F.col(key) == listener).select(F.lit(name).alias("table"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("row"))
             for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def erase(tables: dict[str, DataFrame], listeners: DataFrame, key: str = "listener_id") -> tuple[dict[str, DataFrame], DataFrame]:
    """Tables without the listed listeners, and the rows removed per table. Unknown ids are an error."""
    held = reduce(DataFrame.unionByName, [df.select(key) for df in tables.values()]).distinct()
    unknown = [r[0] for r in listeners.select(key).join(held, key, "left_anti").limit(5).collect()]
    if unknown:
        raise KeyError(f"unknown listeners: {unknown}")
    kept = {n: df.join(listeners.select(key).distinct(), key, "left_anti") for n, df in tables.items()}
    removed = reduce(DataFrame.unionByName, [df.join(listeners.select(key).distinct(), key, "left_semi").agg(F.count("*").alias("n_removed"))
                                             .select(F.lit(n).alias("table"), "n_removed") for n, df in tables.items()])
    return kept, removed


def store_by_listener(tables: dict[str, DataFrame], root: str, key: str = "listener_id", buckets: int = 64) -> None:
    """Write tables in folders by a hash of the listener, so that one listener's rows are in one of them."""
    for name, df in tables.items():
        bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
        df.withColumn("_bucket", bucket).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{root}/{name}")


def erase_stored(spark: SparkSession, root: str, names: list[str], listeners: DataFrame, key: str = "listener_id", buckets: int = 64) -> DataFrame:
    """Erase listeners from stored tables: (table, n_removed, n_left).

    Unknown ids are an error before anything is written. Only folders that hold a listed listener are
    read and replaced. Their new content is written beside the tables and read back; the swap follows if
    no listed listener is in it and only rows of listed ones are gone, for every table.
    """
    tables = {n: spark.read.parquet(f"{root}/{n}") for n in names}
    gone = durable(listeners.select(key).distinct())
    held = reduce(DataFrame.unionByName, [df.select(key) for df in tables.values()]).distinct()
    unknown = [r[0] for r in gone.join(held, key, "left_anti").limit(5).collect()]
    if unknown:
        raise KeyError(f"unknown listeners: {unknown}")
    touched = sorted(r[0] for r in gone.select(F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("b")).distinct().collect())  # at most ``buckets``
    report, staging = [], scratch_dir(spark, "erased")
    for name, df in tables.items():
        old = df.where(F.col("_bucket").isin(touched))
        old.join(gone, key, "left_anti").repartition("_bucket").write.partitionBy("_bucket").parquet(f"{staging}/{name}")
        new = spark.read.schema(df.schema).parquet(f"{staging}/{name}")
        n_old, n_listed, n_new = old.count(), old.join(gone, key, "left_semi").count(), new.count()
        if n_new != n_old - n_listed or not new.join(gone, key, "left_semi").isEmpty():
            raise RuntimeError(f"{name}: what was written is not what should be left; nothing was replaced")
        report.append((name, n_listed, df.count() - n_listed))
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    for name, df in tables.items():
        new = spark.read.schema(df.schema).parquet(f"{staging}/{name}")
        new.repartition("_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(f"{root}/{name}")
        for b in set(touched) - {r[0] for r in new.select("_bucket").distinct().collect()}:  # nothing is left of these
            at = fs_path(f"{root}/{name}/_bucket={b}")
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return spark.createDataFrame(report, "table string, n_removed long, n_left long")


def listener_ids(df: DataFrame, key: str = "listener_id") -> DataFrame:
    return df.select(key).distinct().orderBy(key)


def with_file_position(df: DataFrame, order: str) -> DataFrame:
    return rank_rows(df, [], [order], rn="pos")
