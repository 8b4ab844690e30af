import pytest
from pyspark.sql import functions as F

from phonrisk.operators import confusion as cf
from phonrisk.operators import dims, walk
from phonrisk.operators import features as ft
from phonrisk.operators import hearing as hr
from phonrisk.operators import quality as ql
from phonrisk.operators import trials

L = ["listener_id"]


@pytest.fixture(scope="module")
def rows(spark):
    data = [(1, "각", "닥" if i % 3 == 0 else "각") for i in range(60)] + [(2, "값", "값")]
    scored = trials.score_trials(spark.createDataFrame(data, "listener_id int, target string, response string"))
    counts = cf.count_observations(trials.observations(scored, "listener_id"), L)
    return cf.target_rows(counts, L).cache()


def test_posterior_rows_sum_to_one(rows):
    sums = cf.with_probabilities(rows).select(F.aggregate("probs", F.lit(0.0), lambda a, x: a + x).alias("s")).agg(F.min("s"), F.max("s")).first()
    assert sums[0] == pytest.approx(1) and sums[1] == pytest.approx(1)


def test_p_correct(rows):
    d = {(r.listener_id, r.position, r.target): r for r in cf.diagonal(cf.with_probabilities(rows), L).collect()}
    assert d[(1, "onset", "ㄱ")].p_correct == pytest.approx((40 + 1 / 20) / 61)
    assert d[(1, "onset", "ㅎ")].p_correct == pytest.approx(1 / 20)


def test_zero_alpha_and_no_top(rows):
    with pytest.raises(ValueError, match="no observations"):
        cf.check_smoothing(rows, 0.0)
    assert cf.top_confusions(cf.with_probabilities(rows), L, 0).isEmpty()
    top = cf.top_confusions(cf.with_probabilities(rows), L, 1).where("listener_id = 1 and position = 'onset' and target = 'ㄱ'").first()
    assert (top.perceived, top.n) == ("ㄷ", 20)


def test_coda_backoff(spark, rows):
    vec = ft.profile_vectors(cf.with_probabilities(rows), L)
    pairs = spark.createDataFrame([(1, "넋"), (1, "x1"), (2, "넋")], "listener_id int, word string")
    ev = ft.with_evidence(pairs, vec, L)
    r = {(x.listener_id, x.target): x for x in ft.phoneme_risks(ev, ["listener_id", "word"]).where("position = 'coda'").collect()}
    assert r[(1, "ㄳ")].backed_off and r[(1, "ㄳ")].n_observations == 60
    assert not r[(2, "ㄳ")].backed_off and r[(2, "ㄳ")].n_observations == 0
    got = {(r.listener_id, r.word): r for r in walk.evidence_blocks(ev, ["listener_id", "word"], ["confusion"], ft.block_columns(["confusion"])).collect()}
    risks = {(r.listener_id, r.word): r.risk for r in ev.select("listener_id", "word", ft.independence_risk().alias("risk")).collect()}
    assert all(abs(got[k].x_r_phon - risks[k]) < 1e-12 for k in risks)
    neutral = got[1, "x1"]
    assert neutral.x_r_phon == 0 and neutral.x_min_p_correct == 1 and neutral.x_frac_unobserved == 1


@pytest.mark.parametrize("arm,n", [("word_context_only", 14), ("pta_only", 24), ("clinical", 34), ("confusion_only", 30), ("clinical_plus_confusion", 50),
                                   ("clinical_plus_confusion_rich", 109), ("live_word_context", 10), ("live_word_context_clinical", 30),
                                   ("live_word_context_clinical_confusion", 46)])
def test_column_counts(arm, n):
    assert len(ft.arm_columns(arm)) == n == len(set(ft.arm_columns(arm)))


def test_blocks_make_the_columns_of_their_arms(spark, rows):
    vec = ft.profile_vectors(cf.with_probabilities(rows), L).withColumn("weak", F.create_map(*[x for c in dims.CLASS_NAMES for x in (F.lit(c), F.lit(0.25))]))
    pairs = spark.createDataFrame([(1, "넋"), (1, "x1"), (2, "가나다")], "listener_id int, word string")
    ev = ft.with_evidence(pairs, vec, L)
    for block, n in (("confusion", 16), ("confusion_rich", 59), ("exact_target", 68), ("exact_target_offdiag", 18)):
        names = ft.block_columns([block])
        got = walk.evidence_blocks(ev, ["word"], [block], names).collect()
        assert len(names) == n and len(got) == 3 and all(v is not None and v == v for r in got for v in r)
    assert walk.evidence_blocks(ev.limit(0), ["word"], ["confusion"], ["x_r_phon"]).count() == 0



def test_pta_needs_every_frequency(spark):
    pts = [(1, "right", hz, 55.0, False) for hz in (500, 1000, 2000, 4000)] + [(1, "left", 500, 40.0, False), (1, "left", 1000, 40.0, True)]
    e = hr.ears(spark.createDataFrame(pts, "listener_id int, ear string, hz int, db_hl double, no_response boolean"))
    got = {r.ear: (r.p, r.s) for r in e.select("ear", hr.pta().alias("p"), hr.slope().alias("s")).collect()}
    assert got == {"right": (55.0, 0.0), "left": (None, None)}


def test_severity_bounds_are_right_open(spark):
    df = spark.createDataFrame([(19.9,), (20.0,), (65.0,), (95.0,), (None,)], "v double").select(hr.severity(F.col("v")).alias("s"))
    assert [r.s for r in df.collect()] == ["normal", "mild", "severe", "complete", None]


def test_live_contract():
    with pytest.raises(ql.ContractViolation):
        ql.check_columns(ft.arm_columns("clinical"))
    with pytest.raises(ql.ContractViolation):
        ql.check_blocks("clinical")
    ql.check_columns(ft.arm_columns("live_word_context_clinical_confusion"))
    assert ql.schema_hash(["a", "b"]) != ql.schema_hash(["b", "a"])


def test_smoothing_guard_and_missing_priors(spark):
    counts = spark.createDataFrame([(1, "onset", "ㄱ", "ㄱ", 3)], "listener_id long, position string, target string, perceived string, n long")
    rows = cf.target_rows(counts, ["listener_id"])
    with pytest.raises(ValueError, match="undefined"):
        cf.with_probabilities(rows, alpha=0.0)
    prior = spark.createDataFrame([("onset", "ㄱ", [1.0] + [0.0] * 19)], "position string, target string, prior array<double>")
    est = cf.with_probabilities(rows, prior=prior)
    assert est.count() == 68 and est.where("probs is not null").count() == 1
    assert cf.bad_priors(prior).count() == 67
