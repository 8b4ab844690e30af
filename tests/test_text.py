import unicodedata

import pytest
from pyspark.sql import functions as F

from phonrisk.functions import hangul as hg
from phonrisk.functions import text as tx
from phonrisk.operators import dims, stimuli, trials
from phonrisk.sources import fixtures


def test_every_syllable_round_trips(spark):
    df = spark.range(11172).select((F.col("id") + 0xAC00).alias("cp")).withColumn("s", hg.char_of(F.col("cp")))
    s = F.col("s")
    back = df.select("cp", "s", hg.compose(hg.onset(s), hg.nucleus(s), hg.coda(s)).alias("b"), hg.structure(s).alias("st")).collect()
    assert all(r.s == chr(r.cp) == r.b for r in back)
    assert len({r.s for r in back}) == 11172
    assert {r.st for r in back} == set(hg.STRUCTURES)


def test_normal_forms(spark):
    word = "각나"
    row = spark.createDataFrame([(unicodedata.normalize("NFD", word), "  안녕, WORLD!_１２３  ")], "a string, b string").select(
        tx.nfc(F.col("a")), tx.recogniser_text(F.col("b"))).first()
    assert tuple(row) == (word, "안녕 world 123")


PAIRS = [("각", "닥", "onset_error", "ok"), ("각", "극", "nucleus_error", "ok"), ("각", "간", "coda_error", "ok"), ("각", "가", "coda_error", "ok"),
         ("가", "각", "coda_error", "ok"), ("각", "던", "compound", "ok"), ("각", "", "no_response", "blank"), ("각", "?", "no_response", "blank"),
         ("각", "abc", "no_response", "non_hangul"), ("각", "각각", "correct", "multi_syllable"), ("각", " 각 ", "correct", "ok"),
         ("각", unicodedata.normalize("NFD", "각"), "correct", "ok")]


def test_scoring_table(spark):
    df = trials.score_trials(spark.createDataFrame([p[:2] for p in PAIRS], "target string, response string"))
    got = {(r.target, r.response): (r.trial_error, r.quality, len(r.observations)) for r in df.collect()}
    for t, r, error, quality in PAIRS:
        assert got[(t, r)] == (error, quality, 3)


@pytest.mark.parametrize("pair,pos,kind", [(("각", "가"), 2, "omission"), (("가", "각"), 2, "addition"), (("가", "아"), 0, "omission"), (("아", "가"), 0, "addition")])
def test_position_errors(spark, pair, pos, kind):
    row = trials.score_trials(spark.createDataFrame([pair], "target string, response string")).first()
    assert row.observations[pos].error_type == kind


def test_bad_target_stops(spark):
    with pytest.raises(Exception, match="one Hangul syllable"):
        trials.score_trials(spark.createDataFrame([("ab", "각")], "target string, response string")).collect()


def test_dims(spark):
    assert dims.incomplete_classes(spark).isEmpty()
    assert dims.dim_target(spark).count() == 68 and dims.dim_perceived(spark).count() == 71
    sim = {(r.position, r.target, r.perceived): r.similarity for r in dims.similarity(spark).collect()}
    assert sim[("onset", "ㄱ", "ㄲ")] == pytest.approx(2 / 3) and sim[("coda", "ㄱ", "ㅋ")] == 1 and sim[("coda", "ㄱ", "-")] == 0


def test_catalogue_and_vocabulary(spark):
    cat = stimuli.balanced_catalog(spark)
    assert cat.select("syllable").distinct().count() == 3192
    ref = stimuli.reference_vocabulary(spark)
    assert [r[0] for r in ref.groupBy("n_syll").count().orderBy("n_syll").select("count").collect()] == [80, 180, 100, 40]


def test_greedy_subset_matches_direct_search(spark):
    import random
    rng = random.Random(1)
    sylls = [chr(0xAC00 + rng.randrange(11172)) for _ in range(60)] + ["각"] * 4
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate(sylls)], "k int, pos int, syllable string")
    got = [r.pos for r in stimuli.greedy_subset(df, "k", 25).orderBy("pick").collect()]
    seen, left, want = [{}, {}, {}], list(range(len(sylls))), []
    part = lambda s: ((ord(s) - 0xAC00) // 588, (ord(s) - 0xAC00) % 588 // 28, (ord(s) - 0xAC00) % 28)
    for _ in range(25):
        best = min(left, key=lambda i: (*[seen[k].get(v, 0) for k, v in enumerate(part(sylls[i]))], i))
        want.append(best)
        left.remove(best)
        for k, v in enumerate(part(sylls[best])):
            seen[k][v] = seen[k].get(v, 0) + 1
    assert got == want


def test_a_small_file_of_many_rows_is_spread(spark, tmp_path, monkeypatch):
    """Each table by its own files: here many orders, as many files, and one file of events."""
    given = "/root/testdata/sf0.001"
    for name in ("part", "events", "orders"):
        df = spark.read.parquet(f"{given}/{name}.parquet")
        df.repartition(16 if name == "orders" else 1).write.parquet(f"{tmp_path}/{name}.parquet")
    monkeypatch.setattr(fixtures, "TASK_ROWS", 50)
    spark.conf.set("spark.sql.files.openCostInBytes", str(1 << 27))
    try:
        t = fixtures.Tables(spark, str(tmp_path))
        events = spark.read.parquet(f"{tmp_path}/events.parquet").count()
        assert t.texts.rdd.getNumPartitions() >= -(-events // 50) and t.texts.count() == events
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
