"""Mix sources to target weights by capped water-filling.

Every source asks for its weight's share of all words, but no more than ``MAX_EPOCHS`` times what it
has. The excess of clamped sources goes to the others in proportion to their weights, until none is
above its cap. A source that is to give ``r`` epochs then gives each document ``floor(r)`` times whole,
and a seeded fraction ``r - floor(r)`` of its documents once more.

The fraction is drawn systematically: documents are taken in order of size class, then of a seeded
hash, and document number ``p`` is taken once more if ``floor((p + u) * f)`` rises at it. Sizes near
each other stand together, so the words drawn stay within about one large document of the target, in
small sources and in those with a few giants as well.

Positions come from counts of (source, size class, hash bucket) cells, summed before any shuffle, and a
rank inside one cell; a source with a third of all rows is spread over its cells.

Defined cases: a null text has size 0 and is taken 0 times; a null source is a source of its own, last
in the order of weights; with no words at all nothing is taken; repeated rows are drawn one by one, in
a fixed order where their doc_id and text differ; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phonrisk.llm.store import stored

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
SEED = "mix-1"
BUCKETS = 64


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(totals: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) with ``target``: the words that the mix takes from it.

    Sources get ``weights`` in turn by code point, null last. Only sums go to the driver.
    """
    spread = stored(totals.repartitionByRange(totals["source"].asc_nulls_last()).sortWithinPartitions(totals["source"].asc_nulls_last())
                    .withColumn("mid", F.monotonically_increasing_id()), "sources")
    part, place = F.shiftright("mid", 33), F.col("mid").bitwiseAND((1 << 33) - 1)
    counts = {r.p: r.n for r in spread.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}  # one per partition
    starts, at = [], 0
    for p in range(max(counts, default=-1) + 1):
        starts.append(at)
        at += counts.get(p, 0)
    first = F.array(*[F.lit(x).cast("long") for x in starts or [0]])
    turn = (F.element_at(first, (part + 1).cast("int")) + place) % len(weights)
    given = spread.select("source", "source_size", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (turn + 1).cast("int")).alias("weight"))
    given = stored(given.withColumn("cap", F.col("source_size") * max_epochs), "weights")
    clamped, words, weight = F.lit(False), None, None
    while True:
        free = F.when(~clamped, F.col("weight"))
        s = given.agg(F.sum("source_size"), F.sum(F.when(clamped, F.col("cap"))), F.sum(free), F.sum(F.when(clamped, 1))).first()
        now = ((s[0] or 0) - (s[1] or 0), s[2] or 0)
        if now == (words, weight) or not now[1]:
            break
        words, weight = now
        share = F.col("weight") * F.lit(words).cast("double") / F.lit(weight).cast("double")
        clamped = clamped | (share > F.col("cap"))
    share = F.col("weight") * F.lit(words or 0).cast("double") / F.lit(weight or 1).cast("double")
    return given.select("source", "source_size", F.when(clamped, F.col("cap").cast("double")).otherwise(share).alias("target"))


def _unit(*key) -> Column:
    """A seeded number in [0, 1) with 52 bits."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(SEED), *key)), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def drawn(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """doc_id, text_key, size, source, source_size, target and ``times``, the repetitions of each row."""
    sized = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "source", n_words(F.col("text")).alias("size"))
    sized = sized.withColumn("draw", F.md5(F.concat_ws("|", F.lit(SEED), F.col("doc_id").cast("string"))))
    bits = F.bin("size")
    sized = stored(sized.withColumns({"octave": F.length(bits), "step": F.substring(bits, 1, 6),
                                      "bucket": F.conv(F.substring("draw", 1, 2), 16, 10).cast("int") % BUCKETS}), "sizes")
    goal = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_epochs)
    cells = sized.groupBy("source", "octave", "step", "bucket").agg(F.count("*").alias("n"))
    line = Window.partitionBy("source").orderBy("octave", "step", "bucket")
    cells = cells.select("source", "octave", "step", "bucket", (F.sum("n").over(line) - F.col("n")).alias("before"))
    cell = Window.partitionBy("source", "octave", "step", "bucket").orderBy("draw", "text_key")
    ranked = sized.withColumn("place", F.row_number().over(cell))
    on = [ranked["source"].eqNullSafe(cells["source"]), *(ranked[c] == cells[c] for c in ("octave", "step", "bucket"))]
    placed = ranked.join(cells, on).select(ranked["*"], (F.col("before") + F.col("place")).alias("p"))
    placed = placed.join(goal.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
    epochs = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    part, u = F.col("epochs") - F.floor("epochs"), _unit(F.coalesce("source", F.lit("null source")))
    placed = placed.withColumn("epochs", epochs).withColumn("u", u)
    extra = F.floor((F.col("p") + F.col("u")) * part) - F.floor((F.col("p") - 1 + F.col("u")) * part)
    times = F.when(F.col("size") == 0, 0).otherwise((F.floor("epochs") + extra).cast("long"))
    return placed.select("doc_id", "text_key", "source", "size", "source_size", "target", times.cast("long").alias("times"))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row."""
    return drawn(docs, weights, max_epochs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def mixed_rows(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``docs`` as the mix has them: each row as many times as it is taken, all columns kept."""
    times = drawn(docs, weights, max_epochs).select(
        F.coalesce(F.col("doc_id"), F.lit(-1)).alias("_mix_id"), F.col("text_key").alias("_mix_text"), F.col("source").alias("_mix_source"), "times")
    # Rows equal in id, text and source are told apart by nothing: their repetitions are added up.
    times = times.groupBy("_mix_id", "_mix_text", "_mix_source").agg(F.sum("times").alias("_mix_sum"))
    keyed = docs.withColumns({"_mix_id2": F.coalesce(F.col("doc_id"), F.lit(-1)), "_mix_text2": F.xxhash64("text")})
    same = F.col("_mix_id") == F.col("_mix_id2")
    joined = keyed.join(times, same & (F.col("_mix_text") == F.col("_mix_text2")) & F.col("_mix_source").eqNullSafe(F.col("source")))
    one = joined.dropDuplicates(["_mix_id", "_mix_text", "_mix_source"])
    copies = F.explode(F.sequence(F.lit(1), F.col("_mix_sum").cast("int")))
    return one.filter("_mix_sum > 0").withColumn("_mix_n", copies).select(*docs.columns)


def oracle(weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> str:
    """DuckDB SQL for ``mix`` over ``documents``."""
    turns = " ".join(f"when {i} then {w}" for i, w in enumerate(weights))
    return f"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size,
                  md5('{SEED}|' || doc_id::varchar) as draw from documents),
sized as (select *, length(bin(size)) as octave, left(bin(size), 6) as step, ('0x' || left(draw, 2))::int % {BUCKETS} as bucket from d),
totals as (select source, sum(size)::bigint as source_size from d group by source),
weighed as (select *, case (row_number() over (order by source nulls last) - 1) % {len(weights)} {turns} end as weight,
                   {max_epochs} * source_size as cap from totals),
filled as (select *, cap::double / weight as level, sum(cap) over w - cap as capped, sum(weight) over (order by cap::double / weight desc, source rows unbounded preceding) as free
           from weighed window w as (order by cap::double / weight, source desc rows unbounded preceding)),
water as (select ((select sum(source_size) from totals) - capped)::double as words, free::double as weight from filled
          where ((select sum(source_size) from totals) - capped)::double / free <= level order by level limit 1),
goal as (select f.source, f.source_size, case when f.weight * w.words / w.weight > f.cap then f.cap::double else f.weight * w.words / w.weight end as target
         from weighed f, water w),
ranked as (select *, row_number() over (partition by source order by octave, step, bucket, draw) as p from sized),
placed as (select r.*, g.source_size, g.target, case when g.source_size > 0 then g.target / g.source_size else 0.0 end as epochs,
                  ('0x' || left(md5('{SEED}|' || coalesce(r.source, 'null source')), 13))::bigint / {float(1 << 52)!r} as u
           from ranked r join goal g on r.source is not distinct from g.source)
select doc_id, size, source_size, target,
       (size * (floor(epochs) + floor((p + u) * (epochs - floor(epochs))) - floor((p - 1 + u) * (epochs - floor(epochs)))))::bigint as taken
from placed"""
