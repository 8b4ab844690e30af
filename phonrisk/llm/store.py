"""Tables that a job writes once and reads again, on the storage all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame

from phonrisk.session import scratch_dir


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet beside the checkpoints and read it back: no recomputation, no lineage."""
    spark, path = df.sparkSession, scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
