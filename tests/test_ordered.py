"""The spread forms give what the plain windows give, with one key holding most rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from phonrisk.operators.ordered import quantile, rank_rows, running, with_lag


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = [("hot" if rng.random() < 0.7 else rng.choice(["a", "b", None]), rng.randrange(9), i, rng.randrange(5)) for i in range(400)]
    return spark.createDataFrame(data, "k string, s int, id int, v int").repartition(5).cache()


def same(a, b):
    cols = sorted(a.columns)
    assert sorted(map(repr, a.select(cols).collect())) == sorted(map(repr, b.select(cols).collect()))


@pytest.mark.parametrize("keys", [["k"], []])
def test_ranks(rows, keys):
    order = [F.col("s").desc(), "id"]
    same(rank_rows(rows, keys, order, total="n", bounded=True), rank_rows(rows, keys, order, total="n", bounded=False))


@pytest.mark.parametrize("lead", [False, True])
@pytest.mark.parametrize("block", [1, 7, 1000])
def test_lag(rows, lead, block):
    args = (["k"], ["s", "id"], {"p": "v", "q": "id"})
    same(with_lag(rows, *args, lead=lead, bounded=True), with_lag(rows, *args, lead=lead, bounded=False, block=block))


@pytest.mark.parametrize("block", [1, 13, 1000])
def test_running(rows, block):
    args = (["k"], ["s", "id"], {"t": "v"}, {"m": "v"})
    same(running(rows, *args, bounded=True), running(rows, *args, bounded=False, block=block))


@pytest.mark.parametrize("bounded", [True, False])
def test_quantile(rows, bounded):
    clean = rows.where("k is not null")
    got = {r.k: r.q for r in quantile(clean, ["k"], "v", 0.8, bounded=bounded).collect()}
    pdf = clean.toPandas()
    for k, g in pdf.groupby("k"):
        assert got[k] == pytest.approx(np.quantile(g.v, 0.8))
