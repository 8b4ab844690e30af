"""Cross-site boilerplate lines by distinct-site spread.

Each line with a word in it is known by a 128-bit hash. The sites (``source``) on which it stands are
gathered in a HyperLogLog sketch per hash; sketches merge in the aggregation, so no list of sites is
ever held and a line that stands everywhere costs one sketch per task. Lines whose estimate is near
the threshold get their sites counted exactly; the estimate alone decides far from it. A line on
``MIN_SITES`` sites or more is boilerplate: it stays in the document with the smallest doc_id that has it
and goes from all others.

Defined cases: null text stays null; lines without a word always stay; a null source is no site;
all copies of a line within one document go or stay together; a null doc_id never counts as smallest
unless all are null; rows equal in doc_id and text are treated alike; extra columns are kept; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phonrisk.llm.store import stored

MIN_SITES = 5
SKETCH_BITS = 12
#: Estimates of ``MIN_SITES`` times this and its inverse, and all between, are counted exactly: with
#: 4,096 registers the error of an estimate is 1.6 %, so this is thirty times its deviation.
NEAR = 1.5
NO_ID = -(1 << 63)


def _lines(docs: DataFrame) -> DataFrame:
    """id_key, text_key, doc_id, site, h (the line's hash), pos of each line with a word."""
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id_key"), F.xxhash64("text").alias("text_key"),
                       F.col("source").alias("site"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return rows.filter(F.col("line").rlike("[^\\x20\\x09-\\x0D]")).withColumn("h", F.unhex(F.md5("line"))).drop("line")


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(h, first_id): hashes of boilerplate lines, and the doc_id in which each stays."""
    lines = _lines(docs)
    spread = lines.groupBy("h").agg(F.hll_sketch_agg("site", F.lit(SKETCH_BITS)).alias("sites"), F.min("doc_id").alias("first_id"))
    spread = spread.select("h", "first_id", F.hll_sketch_estimate("sites").alias("n")).filter(F.col("n") >= min_sites / NEAR)
    spread = stored(spread, "spread")
    near = spread.filter(F.col("n") <= min_sites * NEAR).select("h")
    exact = lines.select("h", "site").join(near, "h").groupBy("h").agg(F.count_distinct("site").alias("k")).filter(F.col("k") >= min_sites)
    sure = spread.filter(F.col("n") > min_sites * NEAR).select("h", "first_id")
    return sure.union(spread.join(exact, "h").select("h", "first_id"))


def _marked(docs: DataFrame, min_sites: int) -> DataFrame:
    """``docs`` with ``_ld_gone``, the positions of the lines that go (null: none)."""
    known = stored(boilerplate(docs, min_sites), "boilerplate")
    gone = _lines(docs).join(known, "h").filter(~F.col("doc_id").eqNullSafe(F.col("first_id")))
    gone = gone.groupBy(F.col("id_key").alias("_ld_id"), F.col("text_key").alias("_ld_text")).agg(F.collect_set("pos").alias("_ld_gone"))
    keyed = docs.withColumns({"_ld_a": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), "_ld_b": F.xxhash64("text")})
    return keyed.join(gone, (F.col("_ld_a") == F.col("_ld_id")) & (F.col("_ld_b") == F.col("_ld_text")), "left")


def _kept_text():
    lines = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("_ld_gone", i))
    return F.when(F.col("_ld_gone").isNull(), F.col("text")).otherwise(F.array_join(lines, "\n"))


def drop_lines(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """``docs`` without boilerplate lines; ``n_chars``, where there is one, follows the text."""
    out = _marked(docs, min_sites).withColumn("text", _kept_text())
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def report(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """doc_id, n_lines, n_removed and the text that is left, of every row."""
    return _marked(docs, min_sites).select(
        "doc_id", F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("_ld_gone"), F.lit(0)).cast("long").alias("n_removed"), _kept_text().alias("text"))


def oracle(min_sites: int = MIN_SITES) -> str:
    """DuckDB SQL for ``report`` over ``documents`` (with distinct doc_ids)."""
    return f"""
with rows as (select doc_id, source, string_split(text, chr(10)) as ls from documents),
lines as (select doc_id, source, unnest(ls) as line, unnest(range(len(ls))) as pos from rows),
known as (select line, min(doc_id) as first_id from lines where regexp_matches(line, '[^\\x20\\x09-\\x0D]')
          group by line having count(distinct source) >= {min_sites}),
marked as (select l.*, k.line is not null and l.doc_id is distinct from k.first_id as gone from lines l left join known k using (line)),
texts as (select doc_id, count(*) as n_lines, count(*) filter (gone) as n_removed,
                 coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '') as text from marked group by doc_id)
select d.doc_id, coalesce(t.n_lines, 0)::bigint as n_lines, coalesce(t.n_removed, 0)::bigint as n_removed, t.text
from documents d left join texts t using (doc_id)"""
