"""Periodic runs of words: maximal stretches that repeat a period three times or more.

A run is a stretch of consecutive words with smallest period ``q`` and at least ``max(least, times * q)``
words, which no neighbouring word extends. Within one text:

* Words become small numbers. A run of ``least`` words and three periods repeats some window of
  ``2/3 least`` words inside itself, so only stretches covered by windows that occur twice are looked
  at (hashes of windows; a collision costs time, never a run). Most texts have none.
* Of such a stretch the suffix automaton is built. Its states, hung on their suffix links, are a tree in
  which the words up to place ``i`` are a node, and the deepest node above two places is their longest
  common suffix.
* Places are then taken in order. Access in a link-cut tree recolours the path from the root to the
  place's node, and meets it as segments that were last coloured together: a segment coloured at place
  ``v`` whose deepest node has ``m`` words says that the ``m`` words up to ``v`` end here again and nowhere
  between. With ``d = i - v`` up to ``m`` they overlap or touch, a square: ``m + d`` words of smallest
  period ``d`` end here, and cannot be extended to the left. The last place at which the same start and
  period are seen ends the run. Segments amount to n log n in all.

Rows are worked on where they lie: no shuffle, and one text's automaton at a time in memory.

Defined cases: a null text, or one without words, has no runs and collapses to ""; a null doc_id is
kept; repeated rows are treated alike; runs may overlap; extra columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phonrisk.llm.words import mix, stream

LEAST = 24
TIMES = 3
WORDS = r"[^\x20\x09-\x0D]+"
CODE = stream("runs", 1)[0] | np.uint64(1)


def suffix_automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """(length, link, node of each place) of the automaton; state 0 is the root."""
    length, link, step, nodes, last = [0], [-1], [{}], [], 0
    for word in words:
        new = len(length)
        length.append(length[last] + 1)
        link.append(0)
        step.append({})
        at = last
        while at >= 0 and word not in step[at]:
            step[at][word] = new
            at = link[at]
        if at >= 0:
            to = step[at][word]
            if length[to] != length[at] + 1:
                twin = len(length)
                length.append(length[at] + 1)
                link.append(link[to])
                step.append(step[to].copy())
                link[to] = twin
                while at >= 0 and step[at].get(word) == to:
                    step[at][word] = twin
                    at = link[at]
                to = twin
            link[new] = to
        nodes.append(new)
        last = new
    return length, link, nodes


class Paths:
    """Link-cut tree over the suffix links: paths of nodes that were last coloured together, as splay trees.

    All nodes of a path share one colour, so it is kept at the splay tree's root only. 0, the root of the
    automaton, stands for no node.
    """

    def __init__(self, link: list[int]):
        n = len(link)
        self.up, self.left, self.right, self.colour = [max(x, 0) for x in link], [0] * n, [0] * n, [0] * n

    def _raise(self, x: int) -> None:
        """Splay ``x`` to the root of its path's tree, which hands its colour over."""
        up, left, right = self.up, self.left, self.right

        def turn(a: int, p: int, g: int) -> None:
            if left[p] == a:
                b = left[p] = right[a]
                right[a] = p
            else:
                b = right[p] = left[a]
                left[a] = p
            if b:
                up[b] = p
            if left[g] == p:
                left[g] = a
            elif right[g] == p:
                right[g] = a
            up[a], up[p] = g, a

        p = up[x]
        while p and (left[p] == x or right[p] == x):
            g = up[p]
            if g and (left[g] == p or right[g] == p):
                top = up[g]
                if (left[g] == p) == (left[p] == x):
                    turn(p, g, top)
                    turn(x, p, top)
                else:
                    turn(x, p, g)
                    turn(x, g, top)
                self.colour[x] = self.colour[g]
            else:
                turn(x, p, g)
                self.colour[x] = self.colour[p]
            p = up[x]

    def access(self, node: int, colour: int) -> Iterator[tuple[int, int]]:
        """(former colour, deepest node) of each segment above ``node``, which all get ``colour``."""
        up, left, right, of = self.up, self.left, self.right, self.colour
        below = 0
        while node:
            p = up[node]
            if p and (left[p] == node or right[p] == node):
                self._raise(node)
            if of[node]:
                yield of[node], node
            if right[node]:
                of[right[node]] = of[node]
            right[node] = below
            below, node = node, up[node]
        of[below] = colour


def runs_of(words: list[int], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of each run of ``words``, by start and period."""
    length, link, nodes = suffix_automaton(words)
    paths, ends = Paths(link), {}
    for place, node in enumerate(nodes, 1):
        for seen, deepest in paths.access(node, place):
            d, m = place - seen, length[deepest]
            if m >= (times - 1) * d and m + d >= least:
                ends[seen - m, d] = place
    return [(start, end - start, d) for (start, d), end in sorted(ends.items())]


def _covered(codes: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Stretches of places in windows of ``width`` words that occur at least twice."""
    if len(codes) <= width:
        return []
    h, size = mix(codes.astype(np.uint64) * CODE), 1
    while size < width:
        step = min(size, width - size)
        h = mix(h[:-step] * CODE + h[step:])
        size += step
    order = np.sort(h)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return []
    at = np.flatnonzero(np.isin(h, twice))
    first = np.concatenate(([True], np.diff(at) > width))
    starts = np.flatnonzero(first)
    return list(zip(at[starts].tolist(), (at[np.append(starts[1:], len(at)) - 1] + width).tolist()))


def find_runs(codes: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """``runs_of`` of a whole text, only where windows repeat within one stretch."""
    width = max(1, least * (times - 1) // times)
    found, todo = [], [(0, len(codes), 0)]
    while todo:
        lo, hi, depth = todo.pop()
        parts = [(lo + a, lo + b) for a, b in _covered(codes[lo:hi], width) if b - a >= least]
        if parts == [(lo, hi)] or depth == 3:
            for a, b in parts:
                found += [(a + s, n, q) for s, n, q in runs_of(codes[a:b].tolist(), least, times)]
        else:
            todo += [(a, b, depth + 1) for a, b in parts]
    return sorted((s, q, n) for s, n, q in found)


def _of_text(text: bytes | None, least: int, times: int) -> tuple[int, list, bytes]:
    """(number of words, runs, text without the repeats of its runs)."""
    words = (text or b"").split()  # bytes split at space and \x09-\x0D only
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    codes = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    runs = [(s, n, q) for s, q, n in find_runs(codes, least, times)] if len(words) >= least else []
    if runs:
        kept = np.ones(len(words), bool)
        for start, n, period in runs:
            kept[start + period:start + n] = False
        words = [words[i] for i in np.flatnonzero(kept)]
    return len(codes), runs, b" ".join(words)


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def periodic_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start and period) and collapsed: the text's words
    without those that a run contains after its first period, joined by single spaces."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [_of_text(t, least, times) for t in batch.column(1).to_pylist()]
            runs = [[{"start": s, "length": n, "period": q} for s, n, q in x[1]] for x in done]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x[0] for x in done], pa.int64()), pa.array(runs, RUNS), pa.array([x[2] for x in done], pa.binary())],
                ["doc_id", "n_words", "runs", "collapsed"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    out = rows.mapInArrow(work, f"doc_id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed binary")
    return out.withColumn("collapsed", F.col("collapsed").cast("string"))


def collapsed(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """doc_id and text, in which every run keeps its first period only."""
    return periodic_runs(docs, least, times).select("doc_id", F.col("collapsed").alias("text"))


def with_planted_repeats(docs: DataFrame) -> DataFrame:
    """doc_id and text; in one document of ten (by crc32 of its id) the words from a place on repeat a period."""
    let = lambda value, fn: F.transform(F.array(value), fn)[0]  # noqa: E731  value is computed once
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")

    def repeated(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = F.lit(1).cast("long") + F.floor((n - a) / (F.lit(3) + g % 8)).cast("long")
        place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        chosen = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(words, place(i).cast("int")))
        return F.when(n > 0, F.array_join(chosen, " ")).otherwise("")

    altered = let(F.regexp_extract_all("text", F.lit(WORDS), F.lit(0)), repeated)
    return docs.select("doc_id", F.when(h % 10 == 0, altered).otherwise(F.col("text")).alias("text"))


def digests(docs: DataFrame) -> DataFrame:
    """The result of ``op13``: counts, the strongest run and digests of runs and collapsed text."""
    found = periodic_runs(with_planted_repeats(docs))
    stronger = lambda b, r: (r["length"] * b["period"] > b["length"] * r["period"])  # noqa: E731  runs come by start and period
    best = F.aggregate(F.slice("runs", 2, F.greatest(F.size("runs"), F.lit(1))), F.get("runs", F.lit(0)), lambda b, r: F.when(stronger(b, r), r).otherwise(b))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    out = found.withColumn("best", best)
    return out.select(
        "doc_id", "n_words", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"),
        F.col("best.period").alias("period"), F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def oracle() -> str:
    """DuckDB SQL for ``digests`` over ``documents``: equal windows of 16 words at one distance, in islands."""
    width = LEAST * (TIMES - 1) // TIMES
    window = " || ' ' || ".join(f"lead(word, {k}) over w" for k in range(1, width))
    return f"""
with hashed as (
    select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as ws,
           list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length(doc_id::varchar) + 1), lambda k: ord(substring(doc_id::varchar, k, 1))::bigint)),
                       lambda c, b: list_reduce(list_prepend(xor(c, b), [0::bigint for z in range(8)]),
                                                lambda x, z: xor(x >> 1, (x & 1) * 3988292384))) as crc
    from documents),
params as (select doc_id, ws, len(ws) as n, xor(crc, 4294967295) as h, xor(crc, 4294967295) // 10 as g from hashed),
placed as (select *, case when h % 10 = 0 and n > 0 then g % n end as a from params),
words as (select doc_id, n, unnest(range(n)) as i, a, 1 + (n - a) // (3 + g % 8) as p, ws from placed),
seq as (select doc_id, i, ws[(case when i >= a then a + (i - a) % p else i end) + 1] as word from words),
grams as (select doc_id, i, word || ' ' || {window} as gram from seq window w as (partition by doc_id order by i)),
pairs as (select x.doc_id, x.i, y.i - x.i as q from grams x join grams y on x.doc_id = y.doc_id and x.gram = y.gram and y.i > x.i),
islands as (select doc_id, q, i, i - row_number() over (partition by doc_id, q order by i) as k from pairs),
stretches as (select doc_id, q, min(i) as start, count(*) + {width - 1} + q as length from islands group by doc_id, q, k),
runs as (select doc_id, start, length, min(q) as period from stretches where length >= greatest({LEAST}, {TIMES} * q) group by doc_id, start, length),
told as (select doc_id, count(*) as n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as said from runs group by doc_id),
best as (select distinct on (doc_id) * from (select *, length::double / period as e from runs) order by doc_id, e desc, start, period),
kept as (select s.doc_id, string_agg(word, ' ' order by i) as text from seq s
         where not exists (select 1 from runs r where r.doc_id = s.doc_id and s.i >= r.start + r.period and s.i < r.start + r.length) group by s.doc_id)
select d.doc_id, p.n::bigint as n_words, coalesce(t.n_runs, 0)::bigint as n_runs, b.start::bigint as start, b.length::bigint as length, b.period::bigint as period,
       (1000 * b.length // b.period)::bigint as exponent_milli, sha256(coalesce(t.said, '')) as runs_sha256, sha256(coalesce(k.text, '')) as collapsed_sha256
from documents d join params p using (doc_id) left join told t using (doc_id) left join best b using (doc_id) left join kept k using (doc_id)"""
