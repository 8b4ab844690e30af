"""Live subtitle cues: normalise, emit once, score against a per-listener threshold, keep order."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState

from phonrisk.functions.hangul import has_hangul
from phonrisk.functions.text import cue_text
from phonrisk.operators.features import word_slots
from phonrisk.operators.ordered import quantile, running, with_lag
from phonrisk.operators.stimuli import reference_vocabulary

# Cue limits and the default caption rate.
MAX_CUE_CHARS, MAX_CUE_TOKENS, TARGET_RATE = 500, 60, 0.20

CUE_SCHEMA = T.StructType([
    T.StructField("stream_id", T.LongType()), T.StructField("listener_id", T.LongType()), T.StructField("seq", T.LongType()),
    T.StructField("source", T.StringType()), T.StructField("text", T.StringType()), T.StructField("observed_at", T.TimestampType()),
    T.StructField("_corrupt_record", T.StringType())])


def read_cues(spark, path: str, *, stream: bool = True, max_files: int = 100) -> DataFrame:
    """JSON cue source with a fixed schema; malformed lines keep their text for quarantine."""
    reader = (spark.readStream.option("maxFilesPerTrigger", max_files) if stream else spark.read)
    return reader.schema(CUE_SCHEMA).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def shape_reason() -> Column:
    """Why a cue row breaks the wire contract, or null."""
    return (F.when(F.col("_corrupt_record").isNotNull(), "malformed")
            .when(F.coalesce(F.col("source"), F.lit("")) == "", "no_source")
            .when(F.col("observed_at").isNull(), "no_time")
            .when(F.col("text") != cue_text(F.col("text")), "not_normalised"))


def cue_reason(text: Column) -> Column:
    """Why a normalised cue cannot be scored, or null."""
    return (F.when(text == "", "empty").when(F.char_length(text) > MAX_CUE_CHARS, "too_long")
            .when(F.size(F.split(text, " ")) > MAX_CUE_TOKENS, "too_many_tokens"))


def normalise(cues: DataFrame) -> DataFrame:
    out = cues.withColumn("text", cue_text(F.col("text")))
    return out.withColumn("reason", cue_reason(F.col("text")))


def fingerprint() -> Column:
    return F.when(F.col("text").isNotNull(), F.sha2(F.concat_ws("\u0001", "source", "text"), 256))


def emitted(cues: DataFrame, *, stream: str = "stream_id", seq: str = "seq", bounded: bool | None = None) -> DataFrame:
    """Batch form: cues and clears that reach the viewer; only consecutive repeats are dropped."""
    marked = cues.withColumn("_f", fingerprint()).withColumn("_seen", F.lit(True))
    prev = with_lag(marked, [stream], [seq], {"_pf": "_f"}, bounded=bounded)
    event = (F.when(F.col("_f").isNull() & F.col("_pf").isNotNull(), "clear")
             .when(F.col("_f").isNotNull() & ~F.col("_f").eqNullSafe(F.col("_pf")), "cue"))
    return prev.withColumn("event", event).where("event is not null").drop("_f", "_pf", "_seen")


def _emit(batch: pd.DataFrame, mark: str | None) -> tuple[pd.DataFrame, str | None]:
    """Emission of one stream; the value is its last fingerprint."""
    batch = batch.sort_values("seq", kind="stable")  # one stream's cues of one micro-batch
    marks = batch["mark"].astype(object).where(batch["mark"].notna(), None).tolist()
    event = [("clear" if b is not None else None) if m is None else (None if m == b else "cue") for m, b in zip(marks, [mark, *marks[:-1]])]
    return batch.assign(event=event).dropna(subset=["event"])[["stream_id", "seq", "source", "text", "event"]], marks[-1]


def _staleness(batch: pd.DataFrame, top: int | None) -> tuple[pd.DataFrame, int]:
    """Staleness in one stream; the value is its highest sequence."""
    batch = batch.sort_values(["arrival", "seq"], kind="stable")
    tops = batch["seq"].cummax()
    if top is not None:
        tops = tops.clip(lower=top)
    return batch.assign(stale=batch["seq"] < tops)[["stream_id", "seq", "stale"]], int(tops.iloc[-1])


def _stateful(rows: DataFrame, step: Callable, value: str, idle: str, late: str, schema: str) -> DataFrame:
    """``step`` of each stream's rows and its value, which is forgotten once event time is ``idle`` past the stream's last row.

    Values travel with the rows in Arrow batches of many streams, not by a call for each stream.
    """
    idle_ms = span_ms(idle)

    def work(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        batch = pd.concat(list(batches))
        held, until = state.get if state.exists else (None, 0)
        out, held = step(batch, held)
        until = max(until, int(batch["at_ms"].max()) + idle_ms)
        state.update((held, until))
        # A row may be so late that its stream's time is up already; it is forgotten at the next turn then.
        state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs() + 1))
        yield out

    timed = rows.withWatermark("observed_at", late).withColumn("at_ms", F.unix_millis("observed_at"))
    return timed.groupBy("stream_id").applyInPandasWithState(work, schema, f"held {value}, until bigint", "append", "EventTimeTimeout")


def emitted_stream(cues: DataFrame, *, late: str = "1 hour", idle: str = "1 day") -> DataFrame:
    """Streaming form of ``emitted``: cues of a stream are taken in ``seq`` order within each micro-batch.

    Cues behind the watermark (``late``) are dropped. A stream without cues for ``idle`` of event time is
    forgotten, so its next cue is emitted even if it repeats the last one; the store holds a row for each
    stream seen within that time, and a micro-batch writes only those of its own streams.
    """
    marked = cues.select("stream_id", "seq", "source", "text", "observed_at", fingerprint().alias("mark"))
    return _stateful(marked, _emit, "string", idle, late, "stream_id bigint, seq bigint, source string, text string, event string")


def stale_stream(results: DataFrame, *, late: str = "1 hour", idle: str = "1 day") -> DataFrame:
    """Streaming form of ``stale``; a stream without results for ``idle`` of event time starts afresh."""
    rows = results.select("stream_id", "seq", "arrival", "observed_at")
    return _stateful(rows, _staleness, "bigint", idle, late, "stream_id bigint, seq bigint, stale boolean")


def span_ms(span: str) -> int:
    return int(pd.Timedelta(span).total_seconds() * 1000)


STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass
class StreamRun:
    """Folders of a stream's rows and of its checkpoint, and what its operators said after each micro-batch."""

    out: str
    checkpoint: str
    n_dropped_late: int
    n_state_rows: list[int]


def run_available(result: DataFrame, folder: str) -> StreamRun:
    """Run an append stream over what has arrived, from where it stopped last, and end.

    State is kept by RocksDB, with a log of changes in the checkpoint. Runs of one ``folder`` are one stream.
    """
    conf, key = result.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(key, None)
    conf.set(key, STORE)
    try:
        q = (result.writeStream.trigger(availableNow=True).outputMode("append").option("checkpointLocation", f"{folder}/checkpoint")
             .format("parquet").option("path", f"{folder}/out").start())
        q.awaitTermination()
    finally:
        conf.unset(key) if before is None else conf.set(key, before)
    said = [o for p in q.recentProgress for o in p["stateOperators"]]
    return StreamRun(f"{folder}/out", f"{folder}/checkpoint", sum(o["numRowsDroppedByWatermark"] for o in said), [o["numRowsTotal"] for o in said])


def count_batch(batch: DataFrame, batch_id: int, out: str, state: str) -> None:
    """One micro-batch of confusion counts; readers add the batches up."""
    from phonrisk.operators import confusion, trials

    obs = trials.observations(trials.score_trials(batch), "listener_id")
    confusion.count_observations(obs, ["listener_id"]).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")


def run_batches(source: DataFrame, step, folder: str) -> str:
    """Drive ``step`` over a stream until its input is used up; returns the output folder."""
    out, state = f"{folder}/out", f"{folder}/state"
    q = (source.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{folder}/checkpoint")
         .foreachBatch(lambda df, b: step(df, b, out, state)).start())
    q.awaitTermination()
    return out


def vocabulary_grid(listeners: DataFrame) -> DataFrame:
    """Every listener with the 400 reference words (a fixed list, joined by its number)."""
    ref = reference_vocabulary(listeners.sparkSession).select("v", "word")
    return listeners.withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(399)))).join(F.broadcast(ref), "v")  # 400 rows


def vocabulary_lists(listeners: DataFrame) -> DataFrame:
    """Every listener with the reference words as one array: a row a listener, where ``vocabulary_grid`` has 400."""
    ref = reference_vocabulary(listeners.sparkSession).agg(F.array_sort(F.collect_list(F.struct("v", "word"))).alias("_w"))
    return listeners.join(F.broadcast(ref.select(F.col("_w.word").alias("words"))))  # one row


def reference_thresholds(scored: DataFrame, rate: float = TARGET_RATE, *, risk: str = "risk", keys: tuple[str, ...] = ("listener_id",)) -> DataFrame:
    """Per-listener quantile of the reference words' risks."""
    return quantile(scored, list(keys), risk, 1.0 - rate, out="tau")


def listener_thresholds(profiles: DataFrame, rate: float = TARGET_RATE) -> DataFrame:
    """``profiles`` with ``tau``: ``reference_thresholds`` of the reference words, made in each listener's row.

    The 400 words' phonemes are one broadcast row; no (listener, word) row is formed, so nothing is spread or sorted.
    """
    ref = reference_vocabulary(profiles.sparkSession).agg(F.collect_list(word_slots(F.col("word"))).alias("_ref"))
    risks = F.array_sort(F.transform("_ref", _risk_of))
    at = (F.size("_risks") - 1) * F.lit(1.0 - rate)
    lo, hi = F.col("_risks")[F.floor(at).cast("int")], F.col("_risks")[F.ceil(at).cast("int")]
    return (profiles.join(F.broadcast(ref)).withColumn("_risks", risks)  # one row
            .withColumn("tau", lo + (hi - lo) * (at - F.floor(at))).drop("_ref", "_risks"))


def _risk_of(slots: Column) -> Column:
    """Independence risk of a word by its phonemes, beside its listener's ``prof_nlog``."""
    return 1 - F.exp(-F.aggregate(slots, F.lit(0.0), lambda a, s: a + F.col("prof_nlog")[s]))


def score_whole_cues(cues: DataFrame, profiles: DataFrame, keep: list[str]) -> DataFrame:
    """``score_cues`` in the cue's own row, beside its listener's ``prof_nlog`` and ``tau``: words never leave their cue."""
    held = cues.select(*keep, "listener_id", "text").join(profiles.select("listener_id", "prof_nlog", "tau"), "listener_id", "left")
    risk = lambda w: F.when(has_hangul(w), _risk_of(word_slots(w))).otherwise(0.0)
    scored = held.withColumn("words", F.transform(F.split("text", " "), lambda w: F.struct(w.alias("word"), risk(w).alias("risk"))))
    shown = F.transform(F.filter("words", lambda w: has_hangul(w["word"]) & (w["risk"] >= F.col("tau"))), lambda w: w["word"])
    reason = F.when(F.col("tau").isNull(), "no_threshold").when(F.exists("words", lambda w: w["risk"].isNull()), "unscored_words")
    return (scored.withColumn("_shown", shown).select(*keep, F.size("words").alias("n_words"), F.size("_shown").alias("n_selected"),
                                                      F.array_join("_shown", " ").alias("display_text"), reason.alias("reason")))


def cue_words(cues: DataFrame, keep: list[str]) -> DataFrame:
    return cues.select(*keep, F.posexplode_outer(F.split("text", " ")).alias("word_idx", "word")).where("word is not null")


def _scored_words(cues: DataFrame, risks: DataFrame, taus: DataFrame, keep: list[str]) -> DataFrame:
    """Every word of every cue: ``tau``, and ``risk`` (0 without Hangul, null where a Hangul word has none)."""
    words = cue_words(cues, keep).join(taus, "listener_id", "left").join(risks, ["listener_id", "word"], "left")
    ok = has_hangul(F.col("word"))
    return words.withColumns({"risk": F.when(ok, F.col("risk")).otherwise(0.0), "selected": F.coalesce(ok & (F.col("risk") >= F.col("tau")), F.lit(False))})


def score_cues(cues: DataFrame, risks: DataFrame, taus: DataFrame, keep: list[str]) -> DataFrame:
    """Selected words of each cue: ``risk >= tau``; words without Hangul stay, risk 0, unselected.

    No cue is lost: ``reason`` says ``no_threshold`` where the listener has none and ``unscored_words``
    where a Hangul word has no risk; such words stay unselected. It is null where all was scored.
    """
    words = _scored_words(cues, risks, taus, [*keep, "listener_id"])
    picked = F.struct("word_idx", "word", "risk", "selected")
    whole = words.groupBy(*keep).agg(F.array_sort(F.collect_list(picked)).alias("words"), F.max("tau").alias("tau"))  # at most 60 a cue
    shown = F.transform(F.filter("words", lambda w: w["selected"]), lambda w: w["word"])
    reason = F.when(F.col("tau").isNull(), "no_threshold").when(F.exists("words", lambda w: w["risk"].isNull()), "unscored_words")
    return whole.select(*keep, F.size("words").alias("n_words"), F.size(shown).alias("n_selected"), F.array_join(shown, " ").alias("display_text"), reason.alias("reason"))


def score_cue_stream(cues: DataFrame, risks: DataFrame, taus: DataFrame) -> DataFrame:
    """Word-level form for streams: two stream-static left joins, no aggregation state."""
    words = _scored_words(cues, risks, taus, ["stream_id", "seq", "listener_id"])
    reason = F.when(F.col("tau").isNull(), "no_threshold").when(F.col("risk").isNull(), "unscored_words")
    return words.select("stream_id", "seq", "word_idx", "word", "risk", "selected", reason.alias("reason"))


def stale(results: DataFrame, *, stream: str = "stream_id", seq: str = "seq", arrival: str = "arrival", bounded: bool | None = None) -> DataFrame:
    """Adds ``stale``: an older sequence arriving after a newer one of the same stream."""
    top = running(results, [stream], [arrival, seq], maxes={"_top": seq}, bounded=bounded)
    return top.withColumn("stale", F.col(seq) < F.col("_top")).drop("_top")


def route(cues: DataFrame, ready: DataFrame) -> DataFrame:
    """Adds ``route``: why a cue's listener cannot be scored, or ``score``."""
    known = ready.select("listener_id", F.col("n_trials").alias("_n"))
    why = F.when(F.col("_n").isNull(), "unknown_listener").when(F.col("_n") < 10, "not_ready").otherwise("score")
    return cues.join(known, "listener_id", "left").withColumn("route", why).drop("_n")


def content_free(scored: DataFrame) -> DataFrame:
    """Cue metrics without any text."""
    return scored.select("stream_id", "seq", F.length("display_text").alias("n_chars"), "n_words", "n_selected", "reason")


def windowed_volume(cues: DataFrame, length: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    w = F.window("observed_at", length, slide) if slide else F.window("observed_at", length)
    return (cues.withWatermark("observed_at", late).groupBy(w.alias("w")).agg(F.count("*").alias("n_cues"), F.count("text").alias("n_shown"))
            .select(F.col("w.start").alias("start"), "n_cues", "n_shown"))


def sessions(cues: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return (cues.withWatermark("observed_at", late).groupBy("stream_id", F.session_window("observed_at", gap).alias("w"))
            .agg(F.count("*").alias("n_cues")).select("stream_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_cues"))


def closed_sessions(spark, run: StreamRun, *, bounded: bool | None = None) -> DataFrame:
    """Sessions that a stream of ``sessions`` has closed, whole: (stream, start, n_cues).

    A row may be late enough to fall into a session that was written already, and yet be ahead of the
    watermark; the operator then begins a new piece. Pieces that touch are one session. One with
    a piece that is still held in the state is open again, and left out until that piece is written.
    """
    cols = ["stream_id", "start", "end", "n_cues"]
    written = spark.read.parquet(run.out).select(*cols, F.lit(False).alias("open"))
    held = spark.read.format("statestore").load(run.checkpoint).select(
        "value.stream_id", "value.session_window.start", "value.session_window.end", F.col("value.count").alias("n_cues"), F.lit(True).alias("open"))
    prev = with_lag(written.unionByName(held), ["stream_id"], ["start"], {"_end": "end"}, bounded=bounded)
    fresh = F.coalesce(F.col("start") >= F.col("_end"), F.lit(True)).cast("int")
    runs = running(prev.withColumn("_new", fresh), ["stream_id"], ["start"], {"_run": "_new"}, bounded=bounded)
    whole = runs.groupBy("stream_id", "_run").agg(F.min("start").alias("start"), F.sum("n_cues").alias("n_cues"), F.bool_or("open").alias("_open"))
    return whole.where("not _open").select("stream_id", "start", "n_cues")


def deduplicated(cues: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Duplicate deliveries of one (stream, seq) dropped within the watermark; rows behind it are dropped too."""
    return cues.withWatermark("observed_at", late).dropDuplicatesWithinWatermark(["stream_id", "seq"])
