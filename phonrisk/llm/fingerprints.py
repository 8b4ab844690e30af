"""Document fingerprints: threshold-scaled sketches of word shingles.

A text's shingles are its runs of five words (all of its words as one, if it has fewer). Each gets the
first 64 bits of its md5, and the sketch keeps every hash below a fixed fraction of the range
(``SIXTEENTHS`` of them). The threshold is the same for all texts, so sketches grow with the text,
merge by union, and the shared part of two sketches estimates the shared part of the texts however
unequal they are. A text of which no hash is below the threshold keeps its smallest hash; that merges as
well, so only texts without words have empty sketches. A fingerprint is the sketch's sorted hashes as one
string; it follows from the text alone.

Likeness is the shared part of the smaller sketch, 1 for equal sketches (empty ones too), 0 if just one
is empty.

All is DataFrame code. Sketches need no shuffle. The following document by ascending doc_id is found by
one exchange: quantiles of doc_id split the table into blocks of consecutive ids (two passes over the
ids; one number per block goes to the driver), each block is sorted in one spilling task, and the first
row of a block is copied to the end of the block before it.

Defined cases: a null text is empty; a null doc_id comes last; rows of one doc_id follow each other by
text, so repeated rows are each other's next; the only row follows itself; extra columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 5
#: Of every sixteen hashes, so many are kept: those whose first hexadecimal digit is below it.
SIXTEENTHS = 2
WORDS = r"[^\x20\x09-\x0D]+"
#: Blocks for each shuffle partition.
BLOCKS = 4


def _let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn(value)`` with ``value`` computed once a row."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def sketch(text: Column) -> Column:
    """Sorted hashes (16 hexadecimal digits) of the text's sketch."""
    def hashes(words: Column) -> Column:
        gram = lambda i: F.md5(F.concat_ws(" ", *[F.get(words, i + k) for k in range(WIDTH)]))  # noqa: E731  missing words are skipped
        count = F.greatest(F.size(words) - (WIDTH - 1), F.least(F.size(words), F.lit(1)))
        all_of = F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: F.substring(gram(i), 1, 16))).otherwise(F.array().cast("array<string>"))
        return _let(all_of, kept)

    def kept(of: Column) -> Column:
        low = F.filter(of, lambda h: h < format(SIXTEENTHS, "x"))
        return _let(F.array_sort(F.array_distinct(low)), lambda x: F.when((F.size(x) > 0) | (F.size(of) == 0), x).otherwise(F.array(F.array_min(of))))

    return _let(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORDS), F.lit(0)), hashes)


def merged(a: Column, b: Column) -> Column:
    """The sketch of both texts' shingles together, from their sketches."""
    def low(x: Column) -> Column:
        below = F.filter(x, lambda h: h < format(SIXTEENTHS, "x"))
        return F.when(F.size(below) > 0, below).otherwise(F.slice(x, 1, 1))

    return low(F.array_sort(F.array_union(a, b)))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of ``a``'s shingles that ``b`` has (null for an empty ``a``)."""
    return F.size(F.array_intersect(a, b)) / F.nullif(F.size(a), F.lit(0))


def likeness(a: Column, b: Column) -> Column:
    """The larger containment of the two, 0 to 1."""
    shared, least = F.size(F.array_intersect(a, b)), F.least(F.size(a), F.size(b))
    return F.when(least > 0, shared / least).otherwise((F.greatest(F.size(a), F.size(b)) == 0).cast("double"))


def fingerprint(sketched: Column) -> Column:
    return F.array_join(sketched, "")


def with_sketches(docs: DataFrame) -> DataFrame:
    """doc_id, text ("" for null) and sketch of each row."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), sketch(text).alias("sketch"))


def _blocks(ids: DataFrame) -> list[int]:
    """First doc_id of each block of consecutive ids, ascending."""
    count = BLOCKS * int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    marks = ids.agg(F.percentile_approx("doc_id", [k / count for k in range(count)], 20 * count)).first()[0]
    marks = sorted(set(marks or []))
    if not marks:
        return []
    firsts = ids.filter("doc_id is not null").groupBy(_block(F.col("doc_id"), marks).alias("b")).agg(F.min("doc_id").alias("first"))
    return sorted(r.first for r in firsts.select(F.col("first")).collect())


def _block(value: Column, firsts: list[int]) -> Column:
    """Number of the last of ``firsts`` that is not above ``value`` (0 before all, the last for null), by bisection."""
    n = len(firsts)
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(max(n - 1, 1).bit_length()))])
    at = F.lit(firsts)
    later = lambda lo, step: F.when((lo + step < n) & F.coalesce(F.get(at, lo + step) <= value, F.lit(True)), lo + step).otherwise(lo)
    return F.when(value.isNull(), F.lit(n - 1)).otherwise(F.aggregate(steps, F.lit(0), later))


def with_next(rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id long, text, sketch) with ``next_text`` and ``next_sketch`` of the following row; after the last comes the first."""
    firsts = _blocks(rows.select("doc_id"))
    if firsts:
        n, own = len(firsts), _block(F.col("doc_id"), firsts)
        opens = F.coalesce(F.get(F.lit(firsts), F.col("block")) == F.col("doc_id"), F.lit(False))
        before = F.when(opens, F.array(F.struct(F.col("block").alias("b"), F.lit(False).alias("copy")), F.struct(((F.col("block") + (n - 1)) % n).alias("b"), F.lit(True).alias("copy"))))
        rows = rows.withColumn("block", own)
        places = before.otherwise(F.array(F.struct(F.col("block").alias("b"), F.lit(False).alias("copy"))))
    else:  # no doc_id at all
        places = F.array(*[F.struct(F.lit(0).alias("b"), F.lit(copy).alias("copy")) for copy in (False, True)])
    rows = rows.select("doc_id", "text", "sketch", F.inline(places))
    order = Window.partitionBy("b").orderBy("copy", F.col("doc_id").asc_nulls_last(), "text")
    rows = rows.select("*", F.lead("text").over(order).alias("next_text"), F.lead("sketch").over(order).alias("next_sketch"))
    return rows.filter("not copy").drop("b", "copy")


def edited(text: Column, following: Column) -> Column:
    """``text`` with its last half replaced by the beginning of ``following``."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.left(text, F.length(text) - half), F.left(following, half))


def compare(docs: DataFrame) -> DataFrame:
    """The result of ``op11``: fingerprints of each text and of its edited text, and their likeness."""
    rows = with_sketches(docs.withColumn("doc_id", F.col("doc_id").cast("long")))
    rows = with_next(rows).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    rows = rows.withColumn("edited_sketch", sketch(F.col("edited")))
    return rows.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("sketch")).alias("fingerprint"), fingerprint(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"))


def oracle() -> str:
    """DuckDB SQL for ``compare`` over ``documents`` (with distinct doc_ids)."""
    def sketched(text: str) -> str:
        words = f"regexp_extract_all({text}, '[^\\x20\\x09-\\x0D]+')"
        return f"""(select case when len(low) > 0 or len(hs) = 0 then low else [list_min(hs)] end from (
            select hs, list_sort(list_distinct(list_filter(hs, lambda h: h < '{SIXTEENTHS:x}'))) as low from (
            select list_transform(range(1, 1 + greatest(len(ws) - {WIDTH - 1}, least(len(ws), 1))),
                                  lambda i: left(md5(array_to_string(ws[i:i + {WIDTH - 1}], ' ')), 16)) as hs from (select {words} as ws))))"""

    def like(a: str, b: str) -> str:
        return f"""case when least(len({a}), len({b})) > 0 then len(list_intersect({a}, {b}))::double / least(len({a}), len({b}))
            when greatest(len({a}), len({b})) = 0 then 1.0::double else 0.0::double end"""

    return f"""
with texts as (select doc_id, coalesce(text, '') as text from documents),
nexts as (select doc_id, text, coalesce(lead(text) over (order by doc_id), first_value(text) over (order by doc_id)) as following from texts),
cut as (select *, left(text, length(text) - length(text) // 2) || left(following, length(text) // 2) as edited from nexts),
sketches as (select *, {sketched("cut.text")} as a, {sketched("cut.edited")} as b, {sketched("cut.following")} as c from cut)
select doc_id, length(text)::bigint as n_chars, sha256(edited) as edited_sha256, array_to_string(a, '') as fingerprint,
       array_to_string(b, '') as edited_fingerprint, {like("a", "b")} as near_edited, {like("a", "c")} as near_next
from sketches"""
