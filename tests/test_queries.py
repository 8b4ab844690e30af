"""Registered queries against their oracles on the smallest tables, and registry rules."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHOSEN = ["flagship_risky_words", "c01_score_trials", "d11_top_confusions", "e11_profile_summary", "f08_confusion_block", "j05_minimal_pairs",
          "k01_stratified_folds", "m10_metrics_by_keys", "p13_frontier", "u02_cue_times", "v01_token_rules", "s10_manifest_verify",
          "x07_slice_recall", "l03_emitted_cues_stream", "l06_scored_cues", "j04_sampled_pairs", "s09_content_digest", "l07_stale_results_stream", "a05_timing_problems", "m16_contrasts", "p12_recall_interval", "u05_ass_file", "d20_matrix_layout", "n05_signal_ceiling"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    return float(v) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_oracle(spark, con, name):
    df = entry.queries()[name](spark, SF)
    rel = con.sql(entry.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    want = sorted((tuple(norm(r[rel.columns.index(c)]) for c in cols) for r in rel.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", ["m13_bootstrap_brier", "z03_bootstrap_statistic"])
def test_bootstraps_draw_as_often_as_the_reference(spark, name):
    assert entry.queries()[name](spark, SF).first().n_resamples == 1_000


def test_lengths_and_pairs_are_those_of_the_reference(spark):
    lengths = {r.calibration_length for r in entry.queries()["x04_evidence_length_grid"](spark, SF).collect()}
    assert lengths == {10, 25, 50, 100, 200, 400}
    pairs = entry.queries()["j04_sampled_pairs"](spark, SF).groupBy("listener_id").count().agg({"count": "max"}).first()[0]
    assert 25 < pairs <= 400


def test_every_oracle_has_its_query():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 200


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
