"""Approximate nearest neighbours with balanced posting lists.

* Centroids come from a seeded sample of at most ``SAMPLE`` vectors: balanced k-means splits the largest
  cluster again and again until none is above its share, so that dense places get more lists. There is
  a list for every ``LIST_SIZE`` vectors, up to ``MAX_LISTS``, which bounds what is broadcast.
* Centroids are searched in memory over a neighbour graph, best first with a beam of ``BEAM``, whole
  batches of vectors at a time.
* Each vector goes to its nearest list, and boundary vectors to others as well: those whose distance is
  within ``BORDER`` of the nearest, ``COPIES`` at most.
* A query probes every list whose distance is within a ratio of that of its nearest few, and scores their vectors
  exactly. The ratio is learned: it is the smallest that finds ``TARGET`` of the true neighbours of
  ``TRIALS`` sample vectors among the sample. Clustered vectors need few lists; vectors without structure
  (all about equally far apart) need many, as any index on them does.

Lists are cut into blocks of about ``BLOCK`` vectors by a hash, so a list that holds a third of all
vectors (equal ones cannot be split by any centroid) is scored in many tasks, and so are the queries.
Each block returns its best few per query, never all pairs.

Defined cases: vectors that are null, zero or hold null or non-finite components take no part, nor do
vectors of another length than most; fewer candidates than asked for give all of them; ties go to the
smaller vec_id; rows of one vec_id count as one vector per distinct value; an empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phonrisk.llm.store import stored

LIST_SIZE = 256
MAX_LISTS = 1 << 14
SAMPLE = 20_000
DEGREE = 16
BEAM = 16
BORDER, COPIES = 1.03, 3
TARGET, TRIALS = 0.96, 256
NEAREST_FEW = 4
BLOCK = 2_048
K = 10


def valid_vectors(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v) of the vectors that take part."""
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")).filter("vec_id is not null and size(v) > 0")
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter(finite & F.exists(v, lambda x: x != 0)).dropDuplicates(["vec_id", "v"])
    size = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    return rows.filter(F.size("v") == (size["d"] if size else 0))


def balanced_centroids(x: np.ndarray, lists: int, seed: int = 7) -> np.ndarray:
    """Centres of ``lists`` clusters of about equal size, by splitting the largest in two."""
    rng, clusters, done = np.random.default_rng(seed), [np.arange(len(x))], []
    while clusters and len(clusters) + len(done) < lists:
        clusters.sort(key=len)
        members = clusters.pop()
        y = x[members]
        if len(members) < 2 or (y == y[0]).all():
            done.append(members)
            continue
        axis = y[rng.integers(len(y))] - y.mean(0)
        for _ in range(4):  # a median cut across the main direction keeps the halves equal
            side = y @ axis > np.median(y @ axis)
            if not side.any() or side.all():
                break
            axis = y[side].mean(0) - y[~side].mean(0)
        order = np.argsort(y @ axis, kind="stable")
        half = len(order) // 2
        clusters += [members[order[:half]], members[order[half:]]]
    centres = np.array([x[c].mean(0) for c in clusters + done])
    for _ in range(3):  # a few plain rounds settle the borders
        near = np.concatenate([_squares(x[a:a + 2048], centres).argmin(1) for a in range(0, len(x), 2048)])
        n = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T), 0)


class CentroidGraph:
    """Nearest centroids by best-first search over a neighbour graph."""

    def __init__(self, centres: np.ndarray, degree: int = DEGREE):
        self.centres, n = centres, len(centres)
        near, links = min(degree, max(1, n - 1)), [set() for _ in range(n)]
        for a in range(0, n, 1024):
            d = _squares(centres[a:a + 1024], centres)
            d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
            for i, row in enumerate(np.argpartition(d, min(near, n - 1) - 1 if n > 1 else 0, 1)[:, :near], a):
                for j in row:
                    links[i].add(int(j))
                    links[int(j)].add(i)
        rng = np.random.default_rng(3)
        for i in range(n):  # far links, so that no part of the graph is an island
            links[i].update(int(j) for j in rng.integers(0, n, 4))
            links[i].discard(i)
        width = max((len(s) for s in links), default=1) or 1
        self.links = np.array([[*s, *[i] * (width - len(s))] for i, s in enumerate(links)], np.int64)
        self.entries = np.unique(np.linspace(0, n - 1, min(n, 32)).astype(int))

    def search(self, x: np.ndarray, k: int, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """(ids, distances) of about the ``k`` nearest centres of each row, nearest first."""
        n, beam = len(self.centres), min(len(self.centres), max(beam, k))
        k, rows = min(k, beam), np.arange(len(x))[:, None]
        ids = np.broadcast_to(self.entries, (len(x), len(self.entries)))
        dist = _squares(x, self.centres[self.entries])
        seen = np.zeros((len(x), n), bool)
        seen[:, self.entries] = True
        opened = np.zeros((len(x), n), bool)
        while True:
            order = np.argsort(dist, 1, kind="stable")[:, :beam]
            ids, dist = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
            fresh = ~opened[rows, ids] & np.isfinite(dist)
            busy = fresh.any(1)
            if not busy.any():
                return ids[:, :k], np.sqrt(dist[:, :k])
            pick = fresh.argmax(1)
            at = ids[np.arange(len(x)), pick]
            opened[np.arange(len(x))[busy], at[busy]] = True
            new = self.links[at]
            skip = seen[rows, new] | ~busy[:, None]
            seen[rows, new] |= busy[:, None]
            d = ((self.centres[new] - x[:, None, :]) ** 2).sum(2)
            d[skip] = np.inf
            first = np.ones_like(skip)
            srt = np.argsort(new, 1, kind="stable")
            same = np.take_along_axis(new, srt, 1)
            first[rows, srt] = np.concatenate((np.ones((len(x), 1), bool), same[:, 1:] != same[:, :-1]), 1)
            d[~first] = np.inf
            ids, dist = np.concatenate((ids, new), 1), np.concatenate((dist, d), 1)


def _copies(ids: np.ndarray, dist: np.ndarray) -> list[int]:
    """The lists that a vector is filed in."""
    return ids[:COPIES][dist[:COPIES] <= BORDER * dist[0]].tolist()


def _unit(dist: np.ndarray) -> np.ndarray:
    """What distances are compared with: the mean of the nearest few lists."""
    return np.maximum(dist[:, :NEAREST_FEW].mean(1), 1e-300)


def learned_reach(x: np.ndarray, graph: CentroidGraph, k: int) -> tuple[float, int]:
    """(ratio, beam) that find ``TARGET`` of the neighbours of some sample vectors in the sample."""
    trial = np.random.default_rng(11).permutation(len(x))[:TRIALS]
    d = _squares(x[trial], x)
    d[np.arange(len(trial)), trial] = np.inf
    true = np.argsort(d, 1)[:, :min(k, max(1, len(x) - 1))]
    lists, dist = graph.search(x[trial], len(graph.centres), len(graph.centres))
    place = np.argsort(lists, 1)
    near, far = graph.search(x[true.ravel()], COPIES)
    filed = np.where(far <= BORDER * far[:, :1], near, near[:, :1]).reshape(*true.shape, -1)
    at = np.take_along_axis(place, filed.reshape(len(trial), -1), 1)
    needed = np.take_along_axis(dist, at, 1).reshape(filed.shape).min(2) / _unit(dist)[:, None]
    reach = float(np.quantile(needed, TARGET)) * (1 + 1e-9)
    return reach, int((dist <= reach * _unit(dist)[:, None]).sum(1).max())


def _within(graph: CentroidGraph, x: np.ndarray, reach: float, beam: int) -> list[list[int]]:
    """All lists within reach of each row: rows whose last list is still within it are searched again, twice as far."""
    lists, open_rows, k = [[] for _ in x], np.arange(len(x)), 2 * beam
    while len(open_rows):
        ids, dist = graph.search(x[open_rows], k, k)
        near = dist <= reach * _unit(dist)[:, None]
        for row, i, m in zip(open_rows, ids, near, strict=True):
            lists[row] = i[m].tolist()
        if k >= len(graph.centres):
            break
        open_rows, k = open_rows[near[:, -1]], 2 * k
    return lists


def _list_rows(shared, probing: bool):
    def rows(frames):
        graph, reach, beam = shared.value
        for frame in frames:
            for a in range(0, len(frame), 512):
                part = frame.iloc[a:a + 512]
                x = np.stack(part["v"].to_numpy())
                if probing:
                    lists = _within(graph, x, reach, beam)
                else:
                    lists = [_copies(i, d) for i, d in zip(*graph.search(x, COPIES), strict=True)]
                yield pd.DataFrame({"vec_id": part["vec_id"], "v": part["v"], "lists": lists})
    return rows


def _best(queries: pd.DataFrame, block: pd.DataFrame, k: int) -> pd.DataFrame:
    out = []
    if len(block) and len(queries):
        y, ids = np.stack(block["v"].to_numpy()), block["vec_id"].to_numpy()
        for q, v in zip(queries["query_id"], queries["v"], strict=True):
            d = np.sqrt(((y - v) ** 2).sum(1))
            d[ids == q] = np.inf
            for i in np.lexsort((ids, d))[:k]:
                if np.isfinite(d[i]):
                    out.append((q, ids[i], d[i]))
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})


def search(vectors: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest vectors found for each query, itself left out."""
    spark = vectors.sparkSession
    base = stored(valid_vectors(vectors, id_col, vec_col), "vectors")
    asked = valid_vectors(queries, id_col, vec_col)
    n = base.count()
    lists = int(np.clip(-(-n // LIST_SIZE), 1, MAX_LISTS))
    draw = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = base.filter(draw < min(1.0, SAMPLE / max(n, 1))).orderBy("vec_id", "v").select("v").toPandas()  # about SAMPLE rows
    schema = "query_id long, rank int, vec_id long, score double"
    if not len(sample):
        sample = base.select("v").limit(SAMPLE).toPandas()
        if not len(sample):
            return spark.createDataFrame([], schema)
    x = np.stack(sample["v"].to_numpy())
    index = CentroidGraph(balanced_centroids(x, lists))
    graph = spark.sparkContext.broadcast((index, *learned_reach(x, index, k)))
    kinds = "vec_id long, v array<double>, lists array<int>"
    filed = stored(base.mapInPandas(_list_rows(graph, False), kinds).select("vec_id", "v", F.explode("lists").alias("list")), "postings")
    blocks = stored(filed.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "blocks")
    held = filed.join(blocks, "list").withColumn("block", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int"))
    probes = asked.mapInPandas(_list_rows(graph, True), kinds).select(F.col("vec_id").alias("query_id"), "v", F.explode("lists").alias("list"))
    probes = stored(probes.join(blocks, "list").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))), "probes")
    # Queries of a block that has many are dealt out as well, each part with the block's vectors.
    crowd = stored(probes.groupBy("list", "block").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts")), "crowd")
    probes = probes.join(crowd, ["list", "block"]).withColumn("part", F.pmod(F.xxhash64("query_id"), "parts").cast("int"))
    held = held.join(crowd, ["list", "block"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    keys = ["list", "block", "part"]
    probes, held = probes.select("query_id", "v", *keys), held.select("vec_id", "v", *keys)
    found = probes.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(lambda a, b: _best(a, b, k), "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
