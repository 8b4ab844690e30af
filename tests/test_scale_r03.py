"""Steps that the findings of round 3 name: the same results from forms that stay in the row or the task."""

import pytest
from pyspark.sql import functions as F

from phonrisk.operators import confusion as cf
from phonrisk.operators import features as ft
from phonrisk.operators import trials
from phonrisk.streaming import live as lv

L = ["listener_id"]


@pytest.fixture(scope="module")
def counts(spark):
    data = [(i % 3, s, r) for i in range(90) for s, r in (("각", "닥" if i % 4 == 0 else "각"), ("값", "갑"), ("뷁", "모름"), ("봐", "바"))]
    scored = trials.score_trials(spark.createDataFrame(data, "listener_id int, target string, response string"))
    return cf.count_observations(trials.observations(scored, "listener_id"), L).cache()


def test_profiles_of_counts_are_the_profiles_of_estimated_rows(counts):
    slow = {r.listener_id: r for r in ft.profile_vectors(cf.with_probabilities(cf.target_rows(counts, L)), L).collect()}
    fast = {r.listener_id: r for r in ft.profiles(counts, L).collect()}
    assert fast.keys() == slow.keys() == {0, 1, 2}
    for who, row in slow.items():
        for field in (f"prof_{f}" for f in ft.FIELDS):
            assert fast[who][field] == pytest.approx(row[field], abs=1e-12), field
        assert fast[who].global_error == pytest.approx(row.global_error) and fast[who].alpha == row.alpha


def test_weakness_in_the_row(counts):
    est = cf.with_probabilities(cf.target_rows(counts, L))
    slow = {(r.listener_id, r["class"]): r.weakness for r in ft.class_weakness(est, L).collect()}
    fast = {(r.listener_id, r["class"]): r.weakness for r in ft.weakness_of(ft.profiles(counts, L)).select("listener_id", F.explode("weak").alias("class", "weakness")).collect()}
    assert fast == pytest.approx(slow)


def test_estimates_read_the_observations_once(counts):
    lazy = counts.sparkSession.createDataFrame([(1, "onset", "ㄱ", "ㄴ", 2)], "listener_id int, position string, target string, perceived string, n long")
    plan = cf.target_rows(lazy, L)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD[listener_id") == 1


def test_thresholds_and_cues_in_the_row(spark, counts):
    vec = ft.profiles(counts, L)
    grid = lv.vocabulary_grid(vec.select("listener_id"))
    risk = lambda pairs: ft.with_evidence(pairs, vec, L).select("listener_id", "word", ft.independence_risk().alias("risk"))
    taus = lv.reference_thresholds(risk(grid.select("listener_id", "word")))
    with_tau = lv.listener_thresholds(vec)
    slow, fast = ({r.listener_id: r.tau for r in x.select("listener_id", "tau").collect()} for x in (taus, with_tau))
    assert fast == pytest.approx(slow, abs=1e-12)
    cues = spark.createDataFrame([(1, 1, 0, "각 view 값뷁"), (1, 2, 1, ""), (2, 3, 2, "abc  봐"), (9, 4, 9, "각 x")], "stream_id long, seq long, listener_id int, text string")
    pairs = lv.cue_words(cues, ["listener_id"]).select("listener_id", "word").distinct()
    key = ["stream_id", "seq"]
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(lv.score_whole_cues(cues, with_tau, key)) == rows(lv.score_cues(cues, risk(pairs), taus, key))
    plan = lv.listener_thresholds(vec)._jdf.queryExecution().optimizedPlan().toString()
    assert "Sort " not in plan and "Window" not in plan


def test_vocabulary_of_a_listener_stays_in_its_row(counts):
    lists = lv.vocabulary_lists(counts.select("listener_id").distinct())
    grid = lv.vocabulary_grid(counts.select("listener_id").distinct())
    assert lists.count() == 3
    assert {(r.listener_id, w) for r in lists.collect() for w in r.words} == {(r.listener_id, r.word) for r in grid.collect()}


def test_srt_is_one_file_a_media(spark, tmp_path, monkeypatch):
    """A folder a media costs a commit each; the files of all media stand in one folder."""
    from phonrisk.suite import load, q_sources
    monkeypatch.setattr(q_sources, "scratch_dir", lambda spark, name: str(tmp_path / name))
    rows = load()[0]["s19_srt_files"](spark, "/root/testdata/sf0.001").collect()
    made = {p.name for p in (tmp_path / "srt").iterdir() if p.suffix == ".srt"}
    blocks = load()[0]["u04_srt"](spark, "/root/testdata/sf0.001").groupBy("media_id").count().collect()
    assert {r.media_id: r.n_cues for r in rows} == {r.media_id: r["count"] for r in blocks}
    assert rows and made == {f"{r.media_id}.srt" for r in rows}
    assert all((tmp_path / "srt" / f"{r.media_id}.srt").read_text().count(" --> ") == r.n_cues > 0 for r in rows)
