import hashlib
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from phonrisk.operators import asr, cues, hearing, lexicon, policy, splits
from phonrisk.operators import metrics as mt
from phonrisk.plans import studies
from phonrisk.sources import manifest
from phonrisk.streaming import live


@pytest.fixture(scope="module")
def tied(spark):
    rng = random.Random(5)
    data = [(i, i // 50, rng.choice([0.2, 0.5, 0.8]), rng.randrange(2)) for i in range(400)]
    return spark.createDataFrame(data, "row_id int, listener_id int, score double, misheard int").cache()


def brute_auc_ap(y, p):
    pos, neg = p[y == 1], p[y == 0]
    auc = np.mean([(a > b) + (a == b) / 2 for a in pos for b in neg])
    ap, last = 0.0, 0.0
    for t in sorted(set(p), reverse=True):
        sel = p >= t
        recall = (y[sel].sum()) / y.sum()
        ap += (recall - last) * y[sel].mean()
        last = recall
    return auc, ap


@pytest.mark.parametrize("bounded", [True, False])
def test_rank_metrics(tied, bounded):
    row = mt.rank_metrics(mt.score_counts(tied, []), [], bounded=bounded).first()
    pdf = tied.toPandas()
    auc, ap = brute_auc_ap(pdf.misheard.to_numpy(), pdf.score.to_numpy())
    assert row.roc_auc == pytest.approx(auc) and row.pr_auc == pytest.approx(ap)


def test_one_class_is_undefined(spark):
    df = spark.createDataFrame([(0.2, 0), (0.8, 0)], "score double, misheard int")
    r = mt.suite(df, []).first()
    assert r.roc_auc is None and r.pr_auc is None and r.recall is None and r.f1 is None and r.brier == pytest.approx(0.34)


def test_ece_bins_are_right_closed(spark):
    df = spark.createDataFrame([(0.0,), (0.1,), (0.11,), (1.0,)], "p double").select(mt.bin_of(F.col("p")).alias("b"))
    assert [r.b for r in df.collect()] == [0, 0, 1, 9]


@pytest.mark.parametrize("budget", [0.0, 0.1, 0.33, 1.0])
@pytest.mark.parametrize("keys", [["listener_id"], []])
def test_exact_volume_under_ties(tied, budget, keys):
    for bounded in (True, False):
        got = policy.ranked_for_budget(tied, keys, bounded=bounded).where(policy.within(budget)).count()
        assert got == (8 * round(budget * 50) if keys else round(budget * 400))


def test_thresholds_at_the_ends(tied):
    assert policy.thresholds(tied, [], 0.0).first().tau == 1.0 and policy.thresholds(tied, [], 1.0).first().tau == 0.0


def test_rate_threshold_meets_the_rate(tied):
    tau = policy.rate_threshold(tied, [], 0.2)
    rows = tied.join(F.broadcast(tau)).withColumn("c", policy.passes("score", "listener_id", "row_id"))
    assert rows.agg(F.avg(F.col("c").cast("double"))).first()[0] == pytest.approx(0.2, abs=0.05)


WORDS = [(1, 0, "오늘", 0.0, 0.3, 0.95, 0.10), (1, 1, "날씨가", 0.4, 0.7, 0.90, 0.80), (1, 2, "정말", 0.8, 1.1, 0.30, 0.45), (1, 3, "좋습니다", 1.2, 1.5, 0.99, 0.95)]
SCHEMA = "media_id int, tok_idx int, text string, start_s double, end_s double, confidence double, listener_risk double"


@pytest.mark.parametrize("bounded", [True, False])
def test_srt_text(spark, bounded):
    shown = policy.threshold_policy(spark.createDataFrame(WORDS, SCHEMA), 0.5).where(policy.is_shown())
    blocks = [r.block for r in cues.srt_blocks(cues.build_cues(shown, bounded=bounded)).orderBy("cue_idx").collect()]
    assert blocks == ["1\n00:00:00,400 --> 00:00:00,800\n날씨가\n\n", "2\n00:00:01,200 --> 00:00:01,600\n좋습니다\n\n"]


def test_ass_line(spark):
    both = policy.full_policy(spark.createDataFrame([WORDS[0], (1, 1, "a{b}", 0.3, 0.7, 0.9, 0.95)], SCHEMA))
    line = cues.ass_lines(cues.build_cues(both)).first().line
    assert line == "Dialogue: 0,0:00:00.00,0:00:00.70,Default,,0,0,0,,{\\c&H00FFFFFF}오늘 {\\c&H004040FF}a\\{b\\}"


def test_cue_word_limit(spark):
    df = policy.full_policy(spark.createDataFrame([(1, i, "가", i * 0.3, i * 0.3 + 0.3, 1.0, 0.5) for i in range(20)], SCHEMA))
    sizes = [len(r.words) for r in cues.build_cues(df, bounded=False).orderBy("cue_idx").collect()]
    assert sizes == [8, 8, 4]
    assert cues.bad_cues(cues.build_cues(df)).isEmpty()


def test_recogniser_floor_is_its_own_decision(spark):
    got = {r.text: r.decision for r in policy.budget_policy(spark.createDataFrame(WORDS, SCHEMA), 0.25, 0.5).collect()}
    assert got == {"오늘": "hidden", "날씨가": "hidden", "정말": "shown_low_asr_confidence", "좋습니다": "shown_high_risk"}


@pytest.mark.parametrize("ref,hyp,want", [(["가", "나", "다"], ["가", "라", "또"], (2, 0, 0)), (list("가나다"), list("가다"), (0, 1, 0)),
                                          (list("가다"), list("가나다"), (0, 0, 1)), ([], ["a"], (0, 0, 1)), (["a"], [], (0, 1, 0))])
def test_alignment_cases(ref, hyp, want):
    assert asr.align(ref, hyp) == want


def test_alignment_cost_is_least():
    from functools import cache
    rng = random.Random(2)
    for _ in range(300):
        r = [rng.choice("abc") for _ in range(rng.randrange(8))]
        h = [rng.choice("abc") for _ in range(rng.randrange(8))]

        @cache
        def dist(i, j, r=tuple(r), h=tuple(h)):
            if not i or not j:
                return i + j
            return min(dist(i - 1, j - 1) + (r[i - 1] != h[j - 1]), dist(i - 1, j) + 1, dist(i, j - 1) + 1)

        s, d, ins = asr.align(r, h)
        assert s + d + ins == dist(len(r), len(h)) and len(r) - d + ins == len(h)


def test_alignment_splits_its_cost():
    """Against a full table with the same order of preference: substitute, delete, insert."""
    rng = random.Random(9)
    for _ in range(200):
        r = [rng.choice("abcd") for _ in range(rng.randrange(12))]
        h = [rng.choice("abcd") for _ in range(rng.randrange(12))]
        best = {(i, 0): (0, i, 0) for i in range(len(r) + 1)} | {(0, j): (0, 0, j) for j in range(len(h) + 1)}
        for i, x in enumerate(r, 1):
            for j, y in enumerate(h, 1):
                step = lambda cell, k: tuple(v + (k == n) for n, v in enumerate(best[cell]))
                best[i, j] = best[i - 1, j - 1] if x == y else min((step((i - 1, j - 1), 0), step((i - 1, j), 1), step((i, j - 1), 2)), key=sum)
        assert asr.align(r, h) == best[len(r), len(h)]


def test_alignment_in_blocks_and_of_many_texts(monkeypatch):
    rng = random.Random(4)
    pairs = [("".join(rng.choice("abcd") for _ in range(60)), "".join(rng.choice("abcd") for _ in range(50))) for _ in range(50)]
    whole = [asr.align(r, h) for r, h in pairs]
    assert whole == [asr.align(list(r), list(h)) for r, h in pairs]
    texts = [("".join(rng.choice("abcd efgh") for _ in range(600)), "".join(rng.choice("abcd efgh") for _ in range(600))) for _ in range(400)]
    start = time.process_time()
    for r, h in texts:
        asr.align(r, h)
    assert time.process_time() - start < 4  # by anti-diagonals about 20 ms a pair
    monkeypatch.setattr(asr, "KEPT_BITS", 1)
    assert whole == [asr.align(r, h) for r, h in pairs]


def test_long_texts_align():
    """Beyond two million units: an edge of one unit on a long shared middle, and a long insertion."""
    same = ["a", "b"] * 1_100_000
    assert asr.align(["x", *same], ["y", *same]) == (1, 0, 0)
    assert asr.align(["x", "b"], ["y", *same]) == (1, 0, len(same) - 1)


def test_content_digest_over_the_chunk_edge(spark):
    for n in (1, manifest.DIGEST_CHUNK, manifest.DIGEST_CHUNK + 1):
        files = spark.range(n).select(F.lit("s").alias("source_id"), F.format_string("%06d", "id").alias("path"), F.md5(F.col("id").cast("string")).alias("sha256"))
        lines = [f"{i:06d}\0{hashlib.md5(str(i).encode()).hexdigest()}\n" for i in range(n)]
        parts = [hashlib.sha256("".join(lines[k:k + manifest.DIGEST_CHUNK]).encode()).hexdigest() + "\n" for k in range(0, n, manifest.DIGEST_CHUNK)]
        want = hashlib.sha256("".join(parts).encode()).hexdigest()
        assert {manifest.content_digest(files.repartition(k), ["source_id"]).first().digest for k in (1, 3)} == {want}


def test_scored_cues_say_what_is_missing(spark):
    cues = spark.createDataFrame([(1, 1, 1, "각 view"), (1, 2, 1, "각 낙"), (2, 1, 2, "각"), (3, 1, 1, "view")], "stream_id int, seq int, listener_id int, text string")
    risks = spark.createDataFrame([(1, "각", 0.7)], "listener_id int, word string, risk double")
    taus = spark.createDataFrame([(1, 0.5)], "listener_id int, tau double")
    got = {(r.stream_id, r.seq): (r.n_words, r.n_selected, r.display_text, r.reason) for r in live.score_cues(cues, risks, taus, ["stream_id", "seq"]).collect()}
    assert got == {(1, 1): (2, 1, "각", None), (1, 2): (2, 1, "각", "unscored_words"), (2, 1): (1, 0, "", "no_threshold"), (3, 1): (1, 0, "", None)}
    words = {(r.stream_id, r.seq, r.word): (r.risk, r.selected, r.reason) for r in live.score_cue_stream(cues, risks, taus).collect()}
    assert words[1, 2, "낙"] == (None, False, "unscored_words") and words[2, 1, "각"][2] == "no_threshold" and words[3, 1, "view"] == (0.0, False, None)


def test_folds(tied):
    folds = splits.listener_folds(tied, 4).collect()
    assert len(folds) == 8 and sorted(r.fold for r in folds) == [0, 0, 1, 1, 2, 2, 3, 3]
    assert splits.leaked_listeners(tied.join(splits.listener_folds(tied, 4), "listener_id")).isEmpty()
    with pytest.raises(splits.LeakageError):
        splits.assert_no_leak(splits.leaked_listeners(splits.leaky_folds(tied, 3)))
    with pytest.raises(ValueError):
        splits.listener_folds(tied, 9)
    held = splits.calibration_holdout(tied, 0.25).where("held_out").count()
    assert held == 2


def test_sampled_pairs_are_distinct_and_capped(tied):
    p = lexicon.sampled_pairs(tied, 30).collect()
    assert len({(r.pos_row, r.neg_row) for r in p}) == len(p) == 8 * 30
    every = lexicon.sampled_pairs(tied, 10_000)
    sizes = tied.groupBy("listener_id").agg((F.sum("misheard") * F.sum(1 - F.col("misheard"))).alias("n")).agg(F.sum("n")).first()[0]
    assert every.distinct().count() == sizes


@pytest.mark.parametrize("m,n", [(33, 42), (1, 900), (700, 1)])
def test_sampled_pairs_are_spread(spark, m, n):
    rows = spark.range(m + n).select(F.col("id").alias("row_id"), F.lit(7).alias("listener_id"), (F.col("id") < m).cast("int").alias("misheard"))
    p = lexicon.sampled_pairs(rows, 400).collect()
    assert len({(r.pos_row, r.neg_row) for r in p}) == len(p) == 400
    pos, neg = {r.pos_row for r in p}, {r.neg_row - m for r in p}
    if m > 1 and n > 1:
        assert len(pos) == m and len(neg) == n
    else:  # the long side is drawn all over, not as one run
        side = sorted(neg if n > m else pos)
        assert len(side) == 400 and side[0] < 20 and side[-1] > max(m, n) - 20 and side != list(range(side[0], side[0] + 400))


def test_minimal_pairs(spark):
    words = spark.createDataFrame([("각",), ("닥",), ("간",), ("각나",), ("단",)], "word string")
    got = {r.word: r.n_neighbours for r in lexicon.competitors(words).collect()}
    assert got == {"각": 2, "닥": 2, "간": 2, "단": 2, "각나": 0}


def test_bootstrap_is_deterministic(tied):
    def run():
        return mt.intervals(mt.bootstrap_rank(tied, mt.draws(tied, 20), []), [], "pr_auc").first()
    a, b = run(), run()
    assert a == b and a.n_resamples == 20 and a.lo <= a.hi
    weights = mt.draws(tied, 60).select("blk", F.posexplode("w").alias("k", "w")).groupBy("blk", "k").agg(F.sum("w").alias("w"))
    assert {(r.blk * mt.WIDTH + r.k): r.w for r in weights.collect()} == {b: 8 if b < 60 else None for b in range(3 * mt.WIDTH)}


def test_many_scores_are_resampled_in_place(spark, monkeypatch):
    rng = random.Random(9)
    data = [(s, f"m{i % 2}", i % 23, rng.randrange(60) / 60 if i % 2 else rng.random(), rng.randrange(2)) for s in (1, 2) for i in range(3000)]
    per = mt.score_counts(spark.createDataFrame(data, "seed int, model string, listener_id long, p double, y int"), ["seed", "model", "listener_id"], "y", "p")
    drawn = mt.draws(per, 60)
    monkeypatch.setattr(mt, "MAX_WEIGHTS", 23 * mt.WIDTH)  # a pass a block
    both = [sorted(tuple(r) for r in mt.resampled_rank(per, drawn, ["seed", "model"], few=few).select("seed", "model", "b", "roc_auc", "pr_auc").collect()) for few in (True, False)]
    assert len(both[0]) == len(both[1]) == 4 * 60
    for a, b in zip(*both):
        assert a[:3] == b[:3] and a[3:] == pytest.approx(b[3:], abs=1e-12)


def test_contrasts_pair_the_same_draws_and_leave_out_absent_arms(spark):
    points = spark.createDataFrame([(1, "a", 0.6), (1, "b", 0.5), (2, "a", 0.5), (2, "b", 0.5)], "seed int, arm string, v double")
    drawn = spark.createDataFrame([(s, arm, b, 0.5 + (0.1 if arm == "a" and s == 1 else 0.0) + b / 100) for s in (1, 2) for arm in "ab" for b in range(5)],
                                  "seed int, arm string, b int, v double")
    got = {r.seed: r for r in studies.contrasts(points, drawn, ["seed"], "v", [("a", "b"), ("a", "not run")]).collect()}
    assert len(got) == 2 and got[1].excludes_zero and not got[2].excludes_zero and got[1].n_valid == 5
    assert abs(got[1].point - 0.1) < 1e-9 and abs(got[1].lo - 0.1) < 1e-9 and got[2].hi == 0


def test_transcript_parts_share_a_duration_and_missing_durations_are_judged_by_order(spark, tmp_path):
    from phonrisk.sources import tables
    item = '{"tok_idx": %d, "text": "x", "start_s": %s, "end_s": %s, "confidence": null}'
    lines = ['{"media_id": 7, "part": 0, "backend": "b", "duration_s": null, "tokens": [%s]}' % (item % (0, 0.0, 1.0)),
             '{"media_id": 7, "part": 1, "backend": "b", "duration_s": null, "tokens": [%s]}' % (item % (1, 0.5, 9.0))]
    (tmp_path / "t.json").write_text("\n".join(lines))
    got = tables.read_transcripts(spark, str(tmp_path), "r")
    assert {r.duration_s for r in got.collect()} == {9.0}
    none = spark.createDataFrame([], "media_id long, duration_s double")
    found = asr.timing_problems(got, none)
    assert [(r.tok_idx, r.problem) for r in found.collect()] == [(1, "overlap")]
    counts = asr.corpus_counts(got, found).first()
    assert (counts.n_tokens, counts.n_tokens_with_confidence, counts.utterances_with_timing_problems, counts.n_timing_problems) == (2, 0, 1, 1)


def test_policies_are_held_to_their_contract(spark):
    words = spark.createDataFrame([(1, 0, 0.9, 0.5), (1, 1, 0.1, None)], "media_id int, tok_idx int, listener_risk double, confidence double")
    assert [r.decision for r in policy.apply_policy(words, "threshold", tau=0.5).orderBy("tok_idx").collect()] == ["shown_high_risk", "hidden"]
    policy.register_policy("odd", lambda w: w.withColumn("decision", F.lit("maybe")))
    policy.register_policy("lossy", lambda w: w.select("media_id", F.lit("hidden").alias("decision")))
    try:
        with pytest.raises(ValueError, match="lost columns"):
            policy.apply_policy(words, "lossy")
        with pytest.raises(Exception, match="made decision maybe"):
            policy.apply_policy(words, "odd").collect()
        with pytest.raises(ValueError, match="registered already"):
            policy.register_policy("odd", lambda w: w)
    finally:
        policy.POLICIES.pop("odd"), policy.POLICIES.pop("lossy")
    with pytest.raises(ValueError, match="unknown policy"):
        policy.apply_policy(words, "none")


def test_ears_without_audiograms_and_listeners_without_ears(spark):
    points = spark.createDataFrame([(1, "left", 500, 20.0, False)], "listener_id int, ear string, hz int, db_hl double, no_response boolean")
    speech = spark.createDataFrame([(1, "right", 20.0, 90.0, 60.0), (2, "left", 20.0, 90.0, 60.0)], "listener_id int, ear string, srt_db_hl double, wrs_percent double, wrs_level_db_hl double")
    pi = spark.createDataFrame([], "listener_id int, ear string, level_db_hl double, score_percent double")
    loud = spark.createDataFrame([(1, "left", 50.0, 90.0)], "listener_id int, ear string, mcl_db_hl double, ucl_db_hl double")
    meta = spark.createDataFrame([(i, "manual", False) for i in (1, 2, 3)], "listener_id int, source string, is_synthetic boolean")
    got = sorted((r.listener_id, r.ear or "", r.rule) for r in hearing.violations(points, speech, pi, loud, meta).collect())
    assert got == [(1, "right", "ear_without_audiogram"), (2, "left", "ear_without_audiogram"), (3, "", "no_ear")]
