"""Shards under a byte limit by extendible hashing.

A document's hash is a string of bits. A bucket holds the documents whose hash starts with its prefix;
at first there is one, with the empty prefix. A bucket above the limit splits on its next bit, others
never do. The buckets that are left are the shards; their prefixes, laid out at the longest depth,
are the directory.

Splits need only the bytes of each prefix: sums over ``STEP`` bits at a time, combined before the
shuffle, of the documents whose buckets are still too large. Everything is DataFrame work.

Defined cases: a null or empty text weighs 0 bytes; a null doc_id hashes as an empty string; a document
above the limit gets a shard of its own or shares it with documents that split off no further, and rows that
agree in doc_id and text stay together, so a shard above the limit (``oversized``) is one that all
``BITS`` bits cannot split; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phonrisk.llm.store import stored

MAX_BYTES = 32 << 20
STEP = 12
BITS = 60


def _bits() -> Column:
    """The first 60 bits of the document's md5, as a string of 0 and 1."""
    key = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit(""))))
    return F.lpad(F.conv(F.substring(F.md5(key), 1, 15), 16, 2), BITS, "0")


def directory(sized: DataFrame, max_bytes: int) -> DataFrame:
    """(shard, shard_docs, shard_bytes) from rows of (bits, bytes); shards are prefixes of ``bits``."""
    done, open_, depth = None, sized.select("bits", "bytes", F.lit("").alias("bucket")), 0
    while True:
        # Bytes below each open bucket to STEP more bits, then of every bucket on the way there.
        end = min(depth + STEP, BITS)
        leaves = open_.groupBy("bucket", F.substring("bits", 1, end).alias("leaf")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("docs"))
        ways = leaves.select("bytes", "docs", F.explode(F.sequence(F.lit(depth), F.lit(end))).alias("depth"), "leaf")
        sums = ways.groupBy(F.expr("substring(leaf, 1, depth)").alias("shard"), "depth").agg(F.sum("bytes").alias("bytes"), F.sum("docs").alias("docs"))
        sums = stored(sums, "prefixes")
        large = sums.filter((F.col("bytes") > max_bytes) & (F.col("depth") < end)).select(F.col("shard").alias("parent"))
        fits = (F.col("bytes") <= max_bytes) | (F.col("depth") == BITS)
        split = sums.withColumn("parent", F.expr("substring(shard, 1, depth - 1)")).join(large, "parent", "left_semi") if depth < end else sums
        split = split.unionByName(sums.filter(F.col("depth") == depth).withColumn("parent", F.lit("")))
        found = split.filter(fits & (F.col("depth") > depth) | fits & (F.col("depth") == 0)).select("shard", F.col("docs").alias("shard_docs"), F.col("bytes").alias("shard_bytes"))
        done = found if done is None else done.unionByName(found)
        over = split.filter(~fits & (F.col("depth") == end)).select(F.col("shard").alias("bucket"))
        if end == BITS or over.isEmpty():
            return done
        open_ = sized.select("bits", "bytes", F.substring("bits", 1, end).alias("bucket")).join(over, "bucket", "left_semi")
        depth = end


def assign_shards(docs: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """doc_id, bytes, shard (its prefix), shard_docs, shard_bytes, oversized of every row."""
    sized = stored(docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"), _bits().alias("bits")), "hashes")
    shards = stored(directory(sized.select("bits", "bytes"), max_bytes), "directory")
    depths = [r.d for r in shards.select(F.length("shard").alias("d")).distinct().collect()]  # BITS + 1 at most
    # The directory is looked up at each depth that it has; exactly one of them fits.
    looked = sized.select("doc_id", "bytes", F.explode(F.transform(F.array(*[F.lit(d) for d in sorted(depths)] or [F.lit(0)]),
                          lambda d: F.expr("bits").substr(F.lit(1), d))).alias("shard"))
    return looked.join(shards, "shard").select("doc_id", "bytes", "shard", "shard_docs", "shard_bytes", (F.col("shard_bytes") > max_bytes).alias("oversized"))


def write_shards(docs: DataFrame, path: str, max_bytes: int = MAX_BYTES) -> None:
    """Write ``docs`` with one folder per shard, each written by one task."""
    sized = docs.withColumn("_shard_bits", _bits())
    shards = stored(directory(sized.select(F.col("_shard_bits").alias("bits"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes")), max_bytes), "directory")
    depths = sorted(r.d for r in shards.select(F.length("shard").alias("d")).distinct().collect())
    prefix = F.transform(F.array(*[F.lit(d) for d in depths] or [F.lit(0)]), lambda d: F.col("_shard_bits").substr(F.lit(1), d))
    placed = sized.withColumn("shard", F.explode(prefix)).join(shards.select("shard"), "shard").drop("_shard_bits")
    placed.withColumn("shard", F.concat(F.lit("b"), "shard")).repartition("shard").write.partitionBy("shard").parquet(path)


def oracle(max_bytes: int = MAX_BYTES, depth: int = 30) -> str:
    """DuckDB SQL for ``assign_shards`` over ``documents`` whose shards need at most ``depth`` bits."""
    return f"""
with d as (select doc_id, coalesce(strlen(text), 0)::bigint as bytes,
                  right(repeat('0', 60) || bin(('0x' || left(md5(coalesce(doc_id::varchar, '') || '|' || md5(coalesce(text, ''))), 15))::bigint), 60) as bits from documents),
sums as (select left(bits, k) as shard, k, sum(bytes)::bigint as shard_bytes, count(*) as shard_docs
         from d, (select unnest(range({depth + 1}))::int as k) group by all),
fits as (select s.* from sums s left join sums p on p.k = s.k - 1 and p.shard = left(s.shard, p.k::int)
         where s.shard_bytes <= {max_bytes} and (s.k = 0 or p.shard_bytes > {max_bytes}))
select d.doc_id, d.bytes, f.shard, f.shard_docs, f.shard_bytes, false as oversized
from d join fits f on left(d.bits, f.k) = f.shard"""
