"""Study runner: fits of many cells, resuming, completeness, contrasts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from phonrisk.operators import cells as ce
from phonrisk.operators import models as md
from phonrisk.plans import runner as rn


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    out = []
    for i in range(3000):
        who = int(rng.integers(30))
        x = rng.normal(size=3)
        h = None if who % 7 == 0 else float(who * 3 % 11)
        p = 1 / (1 + np.exp(-(0.9 * x[0] - 0.4 * x[1] + 0.1 * (h or 5) - 0.7)))
        out.append((i, who, int(rng.random() < p), 1 + i % 2, who % 5, *map(float, x), h, 4.0))
    return spark.createDataFrame(out, "row_id long, listener_id long, misheard int, seed long, fold int, x_a double, x_b double, w_c double, h_d double, w_flat double")


COLS = ["x_a", "x_b", "w_c", "h_d", "w_flat"]


def test_common_fits_equal_single_fits(rows):
    fits = ce.fit_logistic_cells(rows, COLS)
    assert sorted(fits) == [(s, f) for s in (1, 2) for f in range(5)]
    got = {r.row_id: r.p for r in ce.predict_held_out(rows, COLS, fits, ["row_id", "seed", "fold"]).collect()}
    assert len(got) == 3000
    for seed, fold in ((1, 0), (2, 3)):
        own = rows.where(F.col("seed") == seed)
        one = md.fit_logistic(own.where(F.col("fold") != fold), COLS).predict(own.where(F.col("fold") == fold))
        assert max(abs(got[r.row_id] - r.p) for r in one.collect()) < 1e-5


def test_common_fits_of_separable_rows_and_single_classes(spark):
    rows = spark.createDataFrame([(i, i % 10, int(i % 10 > 4), 1, i % 2, float(i % 10)) for i in range(400)], "row_id long, listener_id long, misheard int, seed long, fold int, x_a double")
    fit = ce.fit_logistic_cells(rows, ["x_a"], C=1e6)[1, 0]
    assert np.isfinite(fit.w).all() and fit.w[1] > 5
    with pytest.raises(ValueError, match="single class"):
        ce.fit_logistic_cells(rows.withColumn("misheard", F.lit(1)), ["x_a"])


def test_folds_of_each_seed(spark, rows):
    folds = rn.seeded_folds(rows, 5)
    assert folds.groupBy("seed", "listener_id").count().where("count > 1").isEmpty()
    sizes = folds.groupBy("seed", "fold").count().collect()
    assert len(sizes) == 10 and {r["count"] for r in sizes} == {6}
    with pytest.raises(ValueError, match="fewer than"):
        rn.seeded_folds(rows.where("listener_id < 3"), 5)


def study(spark, root, models=("logistic", rn.INDEPENDENCE, rn.PREVALENCE), arms=("word_context_only",), **kw):
    rng = np.random.default_rng(3)
    words = ["가", "나다", "강산", "바람이", "꽃"]
    trials = [(i, int(rng.integers(12)), words[i % 5], 1 + i % 2, 10, "male", int(rng.random() < 0.2 + 0.1 * (i % 5))) for i in range(900)]
    trials = spark.createDataFrame(trials, "row_id long, listener_id long, word string, seed long, snr_db int, speaker string, misheard int")
    return rn.Runner(spark, root, rn.Study(arms, models, folds=3, **kw), trials)


def test_study_takes_up_where_it_stopped(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "study")
    fail = {"on": True}
    real = md.fit_boosted

    def shaky(train, cols, **kw):
        if fail["on"] and kw.get("y") is None and train.where("seed = 2").limit(1).count():
            raise RuntimeError("lost")
        return real(train, cols, max_iter=2)

    monkeypatch.setitem(md.MODELS, "gradient_boosting", shaky)
    r = study(spark, root, ("logistic", rn.PREVALENCE, rn.INDEPENDENCE, "gradient_boosting"))
    with pytest.raises(ValueError, match="not produced"):
        r.run()
    assert r.done().count() == 2 * 3 * 2 + 3 and r.log().where("error is not null").count() == 3
    fitted = []
    fail["on"] = False
    monkeypatch.setattr(r, "_single", lambda run, cell, real=r._single: (fitted.append(cell), real(run, cell)))
    monkeypatch.setattr(r, "_common", lambda run, cells: fitted.extend(cells))
    r.run()
    assert sorted(fitted) == [(2, 0), (2, 1), (2, 2)]
    assert r.predictions().groupBy("model", "seed", "row_id").count().where("count <> 1").isEmpty()
    assert r.predictions().count() == 3 * 900
    m = {(x.seed, x.model): x for x in r.metrics().collect()}
    assert len(m) == 6 and all(x.n_folds == 3 and x.n_folds_fell_back == 0 and x.n == 450 for x in m.values())
    assert m[1, "logistic"].pr_auc > m[1, "logistic"].floor_pr_auc
    c = r.contrasts((("logistic", rn.PREVALENCE),), between="model", resamples=50).collect()
    assert [(x.model, x.reference, x.arm, x.n_resamples) for x in c] == [("logistic", rn.PREVALENCE, "word_context_only", 50)] * 2
    assert all(x.lo <= x.hi for x in c)
    b = r.contrasts((("logistic", rn.PREVALENCE),), between="model", metric="brier", resamples=50).collect()
    want = {(s, k): m[s, k].brier for s, k in m}
    assert all(abs(x.point - (want[x.seed, "logistic"] - want[x.seed, rn.PREVALENCE])) < 1e-12 for x in b)
    assert {x.n for x in r.summary().collect()} == {2}


def test_calibrated_cells_and_unknown_models(spark, tmp_path):
    r = study(spark, str(tmp_path / "s"), ("logistic",), calibrations=("none", "platt")).run()
    assert {x.calibration for x in r.done().collect()} == {"none", "platt"} and r.predictions().count() == 1800
    with pytest.raises(ValueError, match="unknown models"):
        rn.Study(("clinical",), ("magic",)).runs()
    assert rn.Study(("clinical", "confusion_only"), (rn.INDEPENDENCE,)).runs() == [("confusion_only", rn.INDEPENDENCE, "none")]


def test_narrow_arms_read_the_widest_matrix(spark, tmp_path):
    """An arm whose columns another arm has gets no matrix of its own, and the same rows."""
    from phonrisk.operators import features as ft
    from phonrisk.plans import runner as rn
    data = [(i, i % 12, ("각", "닥나", "봐")[i % 3], 5, "male", i % 7 % 2, 1 + i % 2) for i in range(240)]
    trials = spark.createDataFrame(data, "row_id long, listener_id long, word string, snr_db int, speaker string, misheard int, seed int")
    own = rn.Runner(spark, str(tmp_path / "own"), rn.Study(("live_word_context",), folds=2), trials)
    both = rn.Runner(spark, str(tmp_path / "both"), rn.Study(("live_word_context", "word_context_only"), folds=2), trials)
    cols = ["row_id", "seed", "fold", *ft.arm_columns("live_word_context")]
    rows = lambda r: sorted(tuple(x) for x in r.matrix("live_word_context").select(*cols).collect())
    assert rows(both) == rows(own) and len(rows(both)) == 240
    assert [p.name for p in (tmp_path / "both" / "matrix").iterdir()] == ["word_context_only"]
