"""Streams with state and event time: restarts, late rows, copies in other batches, forgotten keys."""

from datetime import datetime, timedelta

from phonrisk.streaming import live as lv

CUES = "stream_id long, seq long, source string, text string, observed_at timestamp, arrival long"
START = datetime(2024, 1, 1)


class Source:
    """Deliveries of one stream, each read by a run of its own."""

    def __init__(self, spark, folder, build):
        self.spark, self.path, self.out, self.build = spark, f"{folder}/in", f"{folder}/run", build

    def deliver(self, *rows):
        self.spark.createDataFrame([(s, q, "p", t, START + timedelta(minutes=m), a) for s, q, t, m, a in rows], CUES).write.mode("append").parquet(self.path)
        return lv.run_available(self.build(self.spark.readStream.schema(CUES).parquet(self.path)), self.out)

    def rows(self, *cols):
        return sorted(tuple(r) for r in self.spark.read.parquet(f"{self.out}/out").select(*cols).collect())


def test_emission_survives_restarts_and_forgets_idle_streams(spark, tmp_path):
    src = Source(spark, tmp_path, lambda s: lv.emitted_stream(s, late="10 minutes", idle="60 minutes"))
    src.deliver((1, 0, "a", 0, 0), (1, 1, "a", 1, 0), (2, 0, None, 0, 0), (2, 1, "z", 1, 0))
    src.deliver((1, 2, "a", 5, 0), (1, 3, None, 6, 0), (1, 4, None, 7, 0), (2, 2, "z", 8, 0))
    run = src.deliver((3, 0, "new", 300, 0))  # moves the watermark past what streams 1 and 2 may be remembered
    assert src.rows("stream_id", "seq", "event") == [(1, 0, "cue"), (1, 3, "clear"), (2, 1, "cue"), (3, 0, "cue")]
    assert run.n_state_rows[-1] == 1
    late = src.deliver((2, 3, "z", 9, 0), (2, 4, "z", 301, 0))
    assert late.n_dropped_late == 1 and (2, 4, "cue") in src.rows("stream_id", "seq", "event")
    many = src.deliver(*[(100 + i, 0, "x", 400, 0) for i in range(50)])
    end = src.deliver((900, 0, "x", 900, 0))
    assert max(many.n_state_rows) >= 50 and end.n_state_rows[-1] == 1


def test_staleness_across_deliveries(spark, tmp_path):
    src = Source(spark, tmp_path, lambda s: lv.stale_stream(s, late="1 day", idle="2 days"))
    src.deliver((1, 5, "a", 0, 1), (1, 3, "a", 1, 2), (2, 1, "a", 1, 1))
    src.deliver((1, 4, "a", 2, 3), (1, 7, "a", 3, 4), (1, 6, "a", 3, 5), (2, 1, "a", 3, 2))
    assert src.rows("stream_id", "seq", "stale") == [(1, 3, True), (1, 4, True), (1, 5, False), (1, 6, True), (1, 7, False), (2, 1, False), (2, 1, False)]


def test_copies_and_late_rows(spark, tmp_path):
    src = Source(spark, tmp_path, lambda s: lv.deduplicated(s.select("stream_id", "seq", "observed_at"), "10 minutes"))
    src.deliver((1, 0, "a", 0, 0), (1, 0, "a", 0, 0), (1, 1, "a", 30, 0))
    run = src.deliver((1, 1, "a", 30, 0), (1, 2, "a", 25, 0), (1, 3, "a", 5, 0))
    assert run.n_dropped_late == 1  # seq 3 lies before 20 minutes
    assert src.rows("stream_id", "seq") == [(1, 0), (1, 1), (1, 2)]


def test_sessions_and_windows_close_behind_the_watermark(spark, tmp_path):
    rows = [(1, 0, "a", 0, 0), (1, 1, "a", 20, 0), (1, 2, "a", 80, 0), (1, 3, "a", 400, 0)]
    src = Source(spark, tmp_path / "s", lambda s: lv.sessions(s, late="10 minutes"))
    src.deliver(*rows[:2])
    assert src.rows("stream_id", "n_cues") == []
    src.deliver(*rows[2:])
    assert src.rows("stream_id", "n_cues") == [(1, 1), (1, 2)]
    late = src.deliver((1, 4, "a", 30, 0))
    assert late.n_dropped_late == 1 and src.rows("stream_id", "n_cues") == [(1, 1), (1, 2)]
    src = Source(spark, tmp_path / "w", lambda s: lv.windowed_volume(s, late="10 minutes"))
    src.deliver(*rows)
    assert src.rows("start", "n_cues") == [(START, 2), (START + timedelta(hours=1), 1)]


def test_a_late_row_joins_a_session_that_was_written(spark, tmp_path):
    src = Source(spark, tmp_path, lambda s: lv.sessions(s, late="10 minutes"))
    closed = lambda run: sorted((r.stream_id, r.start - START, r.n_cues) for r in lv.closed_sessions(spark, run).collect())
    at = lambda m: timedelta(minutes=m)
    src.deliver((1, 0, "a", 0, 0), (1, 1, "a", 20, 0))
    assert closed(src.deliver((2, 0, "a", 65, 0))) == [(1, at(0), 2)]
    assert closed(src.deliver((1, 2, "a", 45, 0))) == []  # ahead of the watermark (55) by the session's end: open again
    assert closed(src.deliver((3, 0, "a", 90, 0))) == [(1, at(0), 3)]


def test_state_of_many_streams_travels_in_batches(spark, tmp_path):
    src = Source(spark, tmp_path, lambda s: lv.stale_stream(s, late="1 day", idle="2 days"))
    assert "FlatMapGroupsInPandasWithState" in lv.stale_stream(spark.readStream.format("rate").load().selectExpr(
        "value stream_id", "value seq", "value arrival", "timestamp observed_at"))._jdf.queryExecution().analyzed().toString()
    rows = [(i % 40, (i * 7) % 101, "a", i % 50, i) for i in range(400)]
    src.deliver(*rows[:150])
    src.deliver(*rows[150:])
    batch = lv.stale(spark.createDataFrame([(s, q, a) for s, q, _, _, a in rows], "stream_id long, seq long, arrival long"))
    assert src.rows("stream_id", "seq", "stale") == sorted(tuple(r) for r in batch.select("stream_id", "seq", "stale").collect())


def test_a_stream_whose_time_is_up_already_is_taken_and_forgotten(spark, tmp_path):
    src = Source(spark, tmp_path, lambda s: lv.stale_stream(s, late="1 day", idle="60 minutes"))
    src.deliver((1, 5, "a", 3000, 0))
    src.deliver((2, 1, "a", 1600, 1))  # ahead of the watermark (1560) but not by the watermark of the next rows
    src.deliver((3, 1, "a", 6000, 2))
    assert src.rows("stream_id", "seq", "stale") == [(1, 5, False), (2, 1, False), (3, 1, False)]
