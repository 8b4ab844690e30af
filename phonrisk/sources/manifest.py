"""File-set manifests: digests, verification and expectations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phonrisk.operators.ordered import rank_rows

#: Files in one chunk of a content digest: a fixed part of the format, not a setting.
DIGEST_CHUNK = 10_000


def build(spark: SparkSession, root: str, source_id: str) -> DataFrame:
    """(source_id, path, bytes, sha256) of every file below ``root`` (files up to 2 GB)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rel = F.regexp_replace("path", r"^.*?" + root.rstrip("/").replace(".", r"\.") + "/", "")
    return files.select(F.lit(source_id).alias("source_id"), rel.alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def content_digest(manifest: DataFrame, keys: list[str]) -> DataFrame:
    """Digest of a file set that ignores order and location.

    Files in path order are cut into chunks of ``DIGEST_CHUNK``; the digest is the sha256 of the hex
    sha256 of each chunk's ``path NUL digest LF`` lines, one a line. The chunk is part of the format,
    so a set of any size has one kind of digest and no row holds more than a chunk.
    """
    line = F.concat("path", F.lit("\0"), "sha256", F.lit("\n"))
    ranked = rank_rows(manifest.withColumn("_line", line), keys, ["path"], rn="_rn")
    part = ranked.groupBy(*keys, F.floor((F.col("_rn") - 1) / DIGEST_CHUNK).alias("_c")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_rn", "_line"))), lambda s: s["_line"]), "").alias("_t"))  # <= DIGEST_CHUNK lines
    hashed = part.select(*keys, "_c", F.sha2("_t", 256).alias("_h"))
    whole = hashed.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_c", "_h"))).alias("_hs"))
    return whole.select(*keys, F.sha2(F.array_join(F.transform("_hs", lambda s: F.concat(s["_h"], F.lit("\n"))), ""), 256).alias("digest"))


def verify(recorded: DataFrame, present: DataFrame, *, deep: bool = True) -> DataFrame:
    """State of every path: match, missing, unrecorded, size_mismatch or checksum_mismatch."""
    a = recorded.select("path", F.col("bytes").alias("_b1"), F.col("sha256").alias("_s1"))
    b = present.select("path", F.col("bytes").alias("_b2"), F.col("sha256").alias("_s2"))
    state = (F.when(F.col("_b2").isNull(), "missing").when(F.col("_b1").isNull(), "unrecorded")
             .when(F.col("_b1") != F.col("_b2"), "size_mismatch"))
    if deep:
        state = state.when(F.col("_s1") != F.col("_s2"), "checksum_mismatch")
    return a.join(b, "path", "full_outer").select("path", state.otherwise("match").alias("state"))


def require_verified(recorded: DataFrame, present: DataFrame, *, deep: bool = True) -> None:
    bad = verify(recorded, present, deep=deep).where("state <> 'match'").limit(5).collect()
    if bad:
        raise ValueError("files differ from their manifest: " + "; ".join(f"{r.state}: {r.path}" for r in bad))


def read_verified(spark: SparkSession, root: str, recorded: DataFrame, source_id: str = "", *, deep: bool = True) -> DataFrame:
    """The Parquet table below ``root``, once every file of it is as the manifest says; else an error that names files."""
    require_verified(recorded, build(spark, root, source_id), deep=deep)
    return spark.read.parquet(root)


def expectations(manifest: DataFrame, expected: DataFrame) -> DataFrame:
    """Per source: observed file and byte counts against (source_id, n_files, min_bytes)."""
    seen = manifest.groupBy("source_id").agg(F.count("*").alias("n_seen"), F.sum("bytes").alias("bytes_seen"))
    return expected.join(seen, "source_id", "left").select(
        "source_id", F.coalesce("n_seen", F.lit(0)).alias("n_seen"), (F.coalesce("n_seen", F.lit(0)) == F.col("n_files")).alias("count_ok"),
        (F.coalesce("bytes_seen", F.lit(0)) >= F.col("min_bytes")).alias("bytes_ok"))


def artifact_states(recorded: DataFrame, found: DataFrame) -> DataFrame:
    """match / modified / missing / not_recorded for every listed artifact."""
    both = recorded.select("path", F.col("sha256").alias("_s1")).join(found.select("path", F.col("sha256").alias("_s2")), "path", "left")
    state = (F.when(F.col("_s2").isNull(), "missing").when(F.col("_s1").isNull(), "not_recorded")
             .when(F.col("_s1") == F.col("_s2"), "match").otherwise("modified"))
    return both.select("path", state.alias("state"))


def consumed(manifest: DataFrame, used: DataFrame) -> DataFrame:
    """Manifests of only the sources a run read."""
    return manifest.join(used.select("source_id").distinct(), "source_id", "left_semi")
