"""Steps that the findings of round 4 name: the same results at less cost a row."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from phonrisk.operators import metrics as mt
from phonrisk.operators import models as md
from phonrisk.operators import ordered
from phonrisk.session import stored


def test_scores_stay_whole_in_slabs(spark, monkeypatch):
    """Scores of more rows than a slab, of several counts a row, and of no positive row, over key and slab edges."""
    rng = random.Random(3)
    data = [(s, i % 23, rng.choice((0.2, 0.5, rng.random())), int(rng.random() < 0.4)) for s in (1, 2) for i in range(1500)]
    data += [(3, i, i / 40, int(i == 30)) for i in range(40)]
    per = mt.score_counts(spark.createDataFrame(data, "seed int, listener_id long, p double, y int"), ["seed", "listener_id"], "y", "p")
    drawn = mt.draws(per, 60)
    monkeypatch.setattr(mt, "SLAB", 8)
    monkeypatch.setattr(mt, "CELLS", 7)
    few, many = ({(r.seed, r.b): (r.roc_auc, r.pr_auc) for r in mt.resampled_rank(per, drawn, ["seed"], few=f).collect()} for f in (True, False))
    assert few.keys() == many.keys() and len(few) == 180
    for k, v in few.items():
        assert many[k] == pytest.approx(v, abs=1e-12) if v[0] is not None else many[k] == v, k


def test_draws_are_counted_where_they_are_made(spark):
    drawn = mt.draws(spark.range(7).select(F.col("id").alias("listener_id")), 40)
    assert "Aggregate" not in drawn._jdf.queryExecution().executedPlan().toString()
    rows = drawn.select("blk", "listener_id", F.posexplode("w").alias("k", "w")).where("w is not null").groupBy("blk", "k").agg(F.sum("w").alias("n")).collect()
    assert len(rows) == 40 and {r.n for r in rows} == {7}


def test_a_study_without_fits_makes_no_other_columns(spark):
    from phonrisk.sources.fixtures import Tables
    from phonrisk.suite import q_studies
    cells = q_studies.study(Tables(spark, "/root/testdata/sf0.001"))
    assert cells.hearing is None
    assert cells.matrix("confusion_only").columns == ["row_id", "listener_id", "misheard", "x_r_phon", "seed", "fold"]


@pytest.fixture(scope="module")
def heard(spark):
    rng = random.Random(8)
    rows = [(i, f"a/{i % 9}" if i % 9 else "hot", int(rng.random() < 0.4), None if i % 7 == 0 else float(i % 5), rng.random(), 1.0) for i in range(700)]
    rows += [(700 + i, "hot", int(i % 50 == 0), 1.0, rng.random(), 1.0) for i in range(900)] + [(2000, "one", 1, 1.0, 2.0, 1.0)]
    return spark.createDataFrame(rows, "row_id long, listener_id string, misheard int, h_a double, x_b double, w_c double").cache()


RANKED = ["h_a", "x_b", "w_c"]


@pytest.mark.parametrize("limit", [2_000_000, 100])
@pytest.mark.parametrize("listwise", [False, True])
def test_rankers_fit_the_drawn_pairs_without_writing_them(heard, monkeypatch, limit, listwise):
    """The optimum over ``sampled_pairs``, from one row a listener; large listeners are ranked over tasks."""
    monkeypatch.setattr(ordered, "MAX_GROUP", limit)
    kept = {}
    monkeypatch.setattr(md, "stored", lambda df, name: kept.setdefault(name, stored(df, name)))
    m = (md.fit_listwise_ranker if listwise else md.fit_pairwise_ranker)(heard, RANKED, cap=60)
    assert kept["pairs"].count() == 9 and kept["pairs"].agg(F.max(F.octet_length("x"))).first()[0] <= 8 * 3 * 120
    rows = heard
    if listwise:
        rows = ordered.rank_rows(md.fit_logistic(heard, RANKED).predict(heard, "_p"), ["listener_id"], [F.col("_p").desc(), "row_id"], rn="_rank")
    d = md._deltas(rows, RANKED, 60, "misheard", 0, ("_rank",) if listwise else ()).toPandas()
    x, v = d[RANKED].to_numpy(), np.ones(len(d))
    if listwise:
        v = np.abs(1 / np.log2(d["pos__rank"] + 1) - 1 / np.log2(d["neg__rank"] + 1)).to_numpy()
    sd = np.sqrt((x * x).mean(0))
    z = x / np.where(sd > 1e-12, sd, 1.0)
    w = np.array(m.coef)
    grad = z.T @ (2 * v * (1 / (1 + np.exp(-z @ w)) - 1)) + v.mean() * w
    assert np.abs(grad).max() < 1e-6 and m.meta["n_pairs"] == len(d) and np.allclose(m.scaling.sds, np.where(sd > 1e-12, sd, 1.0))


def test_ranks_and_places_share_one_shuffle_of_the_matrix(heard):
    """The rank under the first model and the places that pairs are drawn by are both counted where the listener's rows are."""
    placed = md._placed(heard.withColumn("_p", F.col("x_b") / 2), RANKED, "misheard", 0, "_p")
    assert placed._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    got = {r["_name"]: r for r in placed.groupBy("_name").agg(F.max("_rank").alias("n"), F.max("_m").alias("m"), F.max(F.when(F.col("_y") == 1, F.col("_k"))).alias("k")).collect()}
    want = {r.listener_id: r for r in heard.groupBy("listener_id").agg(F.count("*").alias("n"), F.sum("misheard").alias("m")).collect()}
    assert got.keys() == want.keys()
    assert all(got[who].n == r.n and got[who].m == r.m == (got[who].k or 0) for who, r in want.items())
