"""Exact n-gram Jaccard self-join by vertical partitioning.

The n-grams of all documents get one global order, rare ones first: by their bucket's count in a
fixed-size sketch, then by hash. Each document's sorted set is cut along that order:

* its prefix (the rarest fifth and one more, for 0.8) is the part in which two similar documents
  must meet, so candidates come from postings of prefix n-grams alone;
* the whole order is cut into ``FRAGMENTS`` pieces of equal mass. Overlaps of candidate pairs are
  counted in each piece separately and summed per pair; the sum decides, exactly.

Documents with equal sets are one class throughout. Within a posting list, every member is first
tried against one hub, the member whose prefix is least rare; linked members become one component,
and only pairs from different components are tried after that. A list of near copies thus costs
as many pairs as it has members. No pair is dropped: hub rounds repeat while each
halves the pairs that are left, and then all remaining pairs are tried.

Defined cases: null, empty and wordless texts have no n-grams and link with nothing; a text shorter
than the width counts as one n-gram; repeated rows and equal texts share a class; a null doc_id is
kept and never names a component unless the component has no other; an empty table gives an empty
result; other columns are ignored.

The sketch (``SKETCH_BITS``, 4 MB when broadcast) only shapes the order. Where a corpus is so large
that frequent n-grams drown in their buckets, results stay exact and lists get longer; raise it then.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phonrisk.llm.components import components
from phonrisk.llm.store import stored
from phonrisk.llm.words import Block, blocks, mix, stream, windows

WIDTH = 5
PERCENT = 80
SKETCH_BITS = 22
FRAGMENTS = 4
_PART_BITS = 16
#: A bucket of this level counts fewer than 560 documents, and so does the list of each n-gram in it.
SHORT_LEVEL = 36
_CODES = stream("n-gram", 64) | np.uint64(1)


def ngram_sets(block: Block, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct n-gram hashes of each document."""
    words, first = block.words, block.first
    every = windows(words, width, _CODES) if len(words) >= width else words[:0]
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= width:
            yield np.unique(every[a:b - width + 1])
        elif b > a:
            yield mix((words[a:b] * _CODES[:b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a))
        else:
            yield words[:0]


def _sketch_rows(width: int):
    def rows(batches):
        counts = np.zeros(1 << SKETCH_BITS, np.uint32)
        for batch in batches:
            for _, block in blocks(batch.column(0).to_pylist()):
                for grams in ngram_sets(block, width):
                    np.add.at(counts, grams >> np.uint64(64 - SKETCH_BITS), 1)
        out = []
        for p, part in enumerate(counts.reshape(-1, 1 << _PART_BITS)):
            if part.any():  # a byte for each count; what exceeds a byte goes beside it
                over = np.flatnonzero(part > 255)
                out.append((p, np.minimum(part, 255).astype(np.uint8).tobytes(), over.astype("<u2").tobytes(), (part[over] - 255).astype("<u4").tobytes()))
        if out:
            yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=["part", "low", "at", "over"]), preserve_index=False)
    return rows


def _add_up(batches):
    """Levels of the summed counts: each part of the sketch is one array, however many tasks filled it."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, low, at, over in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            total = sums.setdefault(part, np.zeros(1 << _PART_BITS, np.uint64))
            total += np.frombuffer(low, np.uint8)
            total[np.frombuffer(at, "<u2")] += np.frombuffer(over, "<u4")
    out = [(p, level_of(s).tobytes(), [int(m) for m in np.bincount(level_of(s), s, 256)]) for p, s in sums.items()]
    if out:
        yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=["part", "levels", "mass"]), preserve_index=False)


def level_of(counts: np.ndarray) -> np.ndarray:
    """Four levels for each doubling of a count."""
    return np.rint(4 * np.log2(np.maximum(counts.astype(float), 1))).astype(np.uint8)


def global_order(texts: DataFrame, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(level of each sketch bucket, composite order keys that cut all n-grams into fragments)."""
    parts = texts.mapInArrow(_sketch_rows(width), "part long, low binary, at binary, over binary")
    parts = parts.repartition("part").mapInArrow(_add_up, "part long, levels binary, mass array<bigint>").collect()
    levels, mass = np.zeros(1 << SKETCH_BITS, np.uint8), np.zeros(256)
    for p in parts:  # a fixed number of parts of a fixed size
        levels[p.part << _PART_BITS:(p.part + 1) << _PART_BITS] = np.frombuffer(p.levels, np.uint8)
        mass += p.mass
    below = np.concatenate(([0.0], np.cumsum(mass)))
    cuts = []
    for goal in below[-1] * np.arange(1, FRAGMENTS) / FRAGMENTS:
        k = min(255, int(np.searchsorted(below, goal, "right")) - 1)
        share = (goal - below[k]) / mass[k] if mass[k] else 0.0
        cuts.append((k << 56) + int(share * (1 << 56)))
    return levels, np.array(cuts, np.uint64)


def _ordered(grams: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Order key of each n-gram: level in the top byte, hash below."""
    level = levels[grams >> np.uint64(64 - SKETCH_BITS)].astype(np.uint64)
    return (level << np.uint64(56)) | (mix(grams) >> np.uint64(8))


def prefix_length(n: int, percent: int = PERCENT) -> int:
    """How many leading n-grams two sets must share one of, if they overlap by ``percent``."""
    return n - -(-percent * n // 100) + 1


def _digest(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def _set_rows(order, width: int, percent: int):
    def rows(batches):
        levels = order.value[0]
        for batch in batches:
            ids, keys, texts = (c.to_pylist() for c in batch.columns)
            for start, block in blocks(texts):
                out = []
                for i, grams in enumerate(ngram_sets(block, width), start):
                    head = np.sort(_ordered(grams, levels))[:prefix_length(len(grams), percent)] if len(grams) else grams
                    heft = int((head >> np.uint64(56)).mean() * 16) if len(head) else 0
                    out.append((ids[i], keys[i], len(grams), _digest(grams), heft, head.view(np.int64)))
                cols = list(zip(*out, strict=True))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                                                 ["doc_id", "text_key", "n", "digest", "heft", "prefix"])
    return rows


def _fragment_rows(order, width: int):
    def rows(batches):
        levels, cuts = order.value
        for batch in batches:
            nodes, digests, texts = (c.to_pylist() for c in batch.columns)
            for start, block in blocks(texts):
                out = []
                for i, grams in enumerate(ngram_sets(block, width), start):
                    if _digest(grams) != digests[i]:  # another text under a repeated id
                        continue
                    piece = np.searchsorted(cuts, _ordered(grams, levels), "right")
                    out += [(nodes[i], len(grams), f, grams[piece == f].view(np.int64)) for f in range(len(cuts) + 1)]
                if out:
                    cols = list(zip(*out, strict=True))
                    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64())]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["node", "n", "piece", "grams"])
    return rows


def _verified(pairs: DataFrame, pieces: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) that link: overlaps counted piece by piece, summed per pair.

    ``pairs`` is stored, so that Spark knows its size and moves only the pieces of its nodes where it is small.
    """
    pairs = stored(pairs, "pairs")
    a_side = pieces.join(pairs.select(F.col("u").alias("node")), "node", "left_semi")
    b_side = pieces.join(pairs.select(F.col("v").alias("node")), "node", "left_semi")
    a = a_side.select(F.col("node").alias("u"), F.col("n").alias("nu"), "piece", F.col("grams").alias("a"))
    b = b_side.select(F.col("node").alias("v"), F.col("n").alias("nv"), "piece", F.col("grams").alias("b"))
    partial = pairs.join(a, "u").join(b, ["v", "piece"]).select("u", "v", "nu", "nv", F.size(F.array_intersect("a", "b")).alias("c"))
    both = partial.groupBy("u", "v").agg(F.sum("c").alias("c"), F.max("nu").alias("nu"), F.max("nv").alias("nv"))
    return both.filter(f"100 * c >= {percent} * (nu + nv - c)").select("u", "v")


def _grown(groups: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, component) after more links (u, v)."""
    links = stored(links, "links")
    if groups is not None:
        if links.isEmpty():
            return groups
        links = links.union(groups.filter("node != component").select("node", "component"))
    return stored(components(links), "groups")


def _may_link(percent: int):
    """Whether two sets can link whose first common n-gram stands at these places of their orders."""
    return F.expr(f"{100 + percent} * least(n - pos, hn - hpos) >= {percent} * (n + hn)")


def row_keys() -> list:
    """What tells rows apart: the doc_id (-1: null) and a hash of the text and of whether there is a doc_id."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("id_key"), F.xxhash64("text", F.col("doc_id").isNull()).alias("text_key")]


def _with_other(short: DataFrame, long_: DataFrame) -> DataFrame:
    """The postings whose n-gram has others, with ``m``, how many it has; ``hn`` and ``hpos`` are those of the other, where there are two.

    The sketch bounds the lists of ``short``, n-grams in buckets of low level, so these meet in a window. Any
    list of ``long_`` may be a hot key: its size and ends are aggregated, and the join back can be split.
    """
    cols = ["gram", "node", "n", "heft", "pos", "m", F.col("other.n").alias("hn"), F.col("other.pos").alias("hpos")]
    order = Window.partitionBy("gram").orderBy("node")
    beside = F.coalesce(F.lead(F.struct("n", "pos")).over(order), F.lag(F.struct("n", "pos")).over(order))
    short = short.withColumns({"m": F.count("*").over(Window.partitionBy("gram")), "other": beside}).filter("m > 1")
    end = F.struct("node", "n", "pos")
    ends = long_.groupBy("gram").agg(F.count("*").alias("m"), F.min(end).alias("lo"), F.max(end).alias("hi")).filter("m > 1")
    long_ = long_.join(ends, "gram").withColumn("other", F.when(F.col("node") == F.col("lo.node"), F.col("hi")).otherwise(F.col("lo")))
    return short.select(*cols).union(long_.select(*cols))


def join_classes(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): each row's doc_id, text_key, n and digest; each class's digest, n and component.

    ``rows`` has as many rows as ``docs``. ``classes``: digest, n, and of the component that the class
    belongs to ``component_id``, the smallest doc_id in it, and ``keep``, the text_key that goes with it.
    """
    spark = docs.sparkSession
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *row_keys(), "text")
    order = spark.sparkContext.broadcast(global_order(given.select("text"), width))
    rows = given.select("doc_id", "text_key", "text").mapInArrow(
        _set_rows(order, width, percent), "doc_id long, text_key long, n long, digest binary, heft int, prefix array<bigint>")
    rows = stored(rows, "sets")
    keys = ["digest", "n", "id_key", "text_key"]
    classes = rows.filter("n > 0").groupBy("digest", "n").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("least"))
    classes = stored(classes.select(F.monotonically_increasing_id().alias("node"), "*", F.coalesce("least.doc_id", F.lit(-1)).alias("id_key"), "least.text_key"), "classes")

    # One row stands for a class: its postings, and its pieces if it is in a list that can hold a link.
    # Both parts of a prefix are cut off before rows move, so that each n-gram moves once.
    short = F.filter("prefix", lambda gram: F.shiftrightunsigned(gram, 56) <= SHORT_LEVEL)
    rest = F.filter("prefix", lambda gram: F.shiftrightunsigned(gram, 56) > SHORT_LEVEL)

    def postings(part, before):
        heads = rows.withColumn("id_key", F.coalesce("doc_id", F.lit(-1))).select(*keys, "heft", part.alias("part"), before.alias("before"))
        heads = heads.filter(F.size("part") > 0).join(classes.select("node", *keys), keys).dropDuplicates(keys)
        heads = heads.select("node", "n", "heft", "before", F.posexplode("part").alias("pos", "gram"))
        return heads.select("node", "n", "heft", (F.col("before") + F.col("pos")).alias("pos"), "gram")

    listed = _with_other(postings(short, F.lit(0)), postings(rest, F.size(short))).filter((F.col("m") > 2) | _may_link(percent))
    lists = stored(listed.select("gram", "node", "n", "heft", "pos"), "lists")

    # Stored, so that Spark knows its size and leaves the texts where they are if it is small.
    wanted = stored(lists.select("node").distinct().join(classes.select("node", "digest", "id_key", "text_key"), "node"), "wanted")
    texts = given.drop("doc_id").join(wanted, ["id_key", "text_key"]).dropDuplicates(["id_key", "text_key", "digest"])
    pieces = stored(texts.select("node", "digest", "text").mapInArrow(_fragment_rows(order, width), "node long, n long, piece int, grams array<bigint>"), "pieces")

    groups, open_, last = None, lists.withColumn("comp", F.col("node")), float("inf")
    while True:
        hubs = open_.groupBy("gram").agg(F.max(F.struct("heft", (-F.col("node")).alias("minus"), "n", "pos", "comp")).alias("h")).select(
            "gram", (-F.col("h.minus")).alias("hub"), F.col("h.n").alias("hn"), F.col("h.pos").alias("hpos"), F.col("h.comp").alias("hc"))
        tried = open_.join(hubs, "gram")
        pairs = tried.filter(F.expr("comp != hc") & _may_link(percent)).select(
            F.greatest("node", "hub").alias("u"), F.least("node", "hub").alias("v")).distinct()
        groups = _grown(groups, _verified(pairs, pieces, percent))
        # A hub is done with; what is left of a list matters while it holds two components.
        rest = tried.filter("node != hub").drop("comp", "hub", "hn", "hpos", "hc")
        rest = rest.join(groups, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")
        mixed = rest.groupBy("gram").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("m")).filter("lo != hi")
        open_ = stored(rest.join(mixed, "gram"), "open")
        work, rows_left = open_.agg(F.sum((F.col("m") - 1) / 2), F.count("*")).first()
        open_ = open_.drop("lo", "hi", "m")
        if not rows_left or work <= 4 * rows_left or work > last / 2:
            break
        last = work
    if rows_left:
        x = open_.select("gram", F.col("node").alias("a"), "n", "pos", F.col("comp").alias("ca"))
        y = open_.select("gram", F.col("node").alias("b"), F.col("n").alias("hn"), F.col("pos").alias("hpos"), F.col("comp").alias("cb"))
        pairs = x.join(y, "gram").filter(F.expr("a > b and ca != cb") & _may_link(percent)).select(F.col("a").alias("u"), F.col("b").alias("v")).distinct()
        groups = _grown(groups, _verified(pairs, pieces, percent))
    placed = classes.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = placed.groupBy("component").agg(F.min("least").alias("k")).select(
        "component", F.col("k.doc_id").alias("component_id"), F.col("k.text_key").alias("keep"))
    return rows.select("doc_id", "text_key", "n", "digest"), placed.join(named, "component").select("digest", "n", "component_id", "keep")


def link_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text)."""
    rows, classes = join_classes(docs, width, percent)
    return rows.join(classes, ["digest", "n"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``docs`` with the row of the smallest doc_id of each component, all its columns kept.

    Rows without n-grams stay. Rows equal in doc_id and text are one document and stay once.
    """
    rows, classes = join_classes(docs, width, percent)
    stays = F.expr("n = 0 or (doc_id <=> component_id and text_key = keep)")
    keys = ["_join_id", "_join_text"]
    fates = rows.join(classes, ["digest", "n"], "left").select(
        F.coalesce("doc_id", F.lit(-1)).alias("_join_id"), F.col("text_key").alias("_join_text"), stays.alias("stays"))
    fates = fates.groupBy(*keys).agg(F.max("stays").alias("stays"), F.count("*").alias("m")).filter("m > 1 or not stays")
    # Only what goes or repeats is looked up; Spark knows its size, and texts of other rows are not moved if it is small.
    fates = stored(fates, "fates")
    keyed = docs.withColumns(dict(zip(keys, row_keys(), strict=True)))
    again = keyed.join(fates.filter("stays").select(*keys), keys, "left_semi").dropDuplicates(keys)
    return keyed.join(fates.select(*keys), keys, "left_anti").select(*docs.columns).union(again.select(*docs.columns))
