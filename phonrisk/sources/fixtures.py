"""Domain tables derived from the given tables with portable SQL.

The given tables hold no Hangul, so trials, words, tokens, hearing measures and cues are
derived from ``orders``, ``events``, ``part`` and ``customer`` by integer and md5 arithmetic.
One text per table is rendered for two dialects, which gives the same rows in both engines;
every table grows with the table it is derived from.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession

GIVEN = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
         "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


class Spark:
    """Rendering rules for Spark SQL."""

    def __init__(self, sf_dir: str, spread: Callable[[str], int] | None = None, counts: dict[str, int] | None = None):
        self.sf_dir, self.spread, self.counts = sf_dir, spread, counts or {}

    def count(self, name: str) -> str:
        return str(self.counts[name])

    def table(self, name: str) -> str:
        path = f"parquet.`{self.sf_dir}/{name}.parquet`"
        parts = self.spread(name) if self.spread else 0
        return f"(select /*+ REPARTITION({parts}) */ * from {path})" if parts else path

    def h(self, x: str) -> str:
        return f"cast(conv(substring(md5({x}),1,8),16,10) as bigint)"

    def ch(self, cp: str) -> str:
        c = f"cast({cp} as int)"
        return (f"decode(unhex(hex(shiftleft(224 | shiftright({c},12),16) | "
                f"shiftleft(128 | (shiftright({c},6) & 63),8) | (128 | ({c} & 63)))),'UTF-8')")

    def div(self, a: str, b: str) -> str:
        return f"(({a}) div ({b}))"


class Duck(Spark):
    """Rendering rules for DuckDB."""

    def __init__(self):
        super().__init__("")

    def table(self, name: str) -> str:
        return name

    def count(self, name: str) -> str:
        return f"(select count(*) from {name})"

    def h(self, x: str) -> str:
        return f"cast(concat('0x',substr(md5({x}),1,8)) as bigint)"

    def ch(self, cp: str) -> str:
        return f"chr(cast({cp} as integer))"

    def div(self, a: str, b: str) -> str:
        return f"(({a}) // ({b}))"


def _s(x: str) -> str:
    return f"cast({x} as varchar(20))"


def _hash(d: Spark, tag: str, *ids: str) -> str:
    parts = ",':',".join(_s(i) for i in ids)
    return d.h(f"concat('{tag}:',{parts})")


def _coda(k: str) -> str:
    return (f"case {k} when 0 then 0 when 1 then 1 when 2 then 4 when 3 then 7 when 4 then 8 "
            f"when 5 then 16 when 6 then 17 else 21 end")


def _syl(d: Spark, i: str) -> str:
    return d.ch(f"(44032 + (({i})%19*21 + ({i})%21)*28 + {_coda(f'(({i})%8)')})")


def calib_trials(d: Spark) -> str:
    return f"""
select trial_id, listener_id, stimulus_id, is_synthetic, condition,
  {d.ch("44032 + (o*21+n)*28 + c")} target,
  case when e % 17 = 0 then '모름' when e % 19 = 0 then 'abc' when e % 29 = 0 then ' '
       when e % 23 = 0 then concat({d.ch("44032 + (ro*21+rn)*28 + rc")},'각')
       else concat(' ', {d.ch("44032 + (ro*21+rn)*28 + rc")}) end response
from (select *, case when e % 10 < 2 then (o + 1 + listener_id % 5) % 19 else o end ro,
             case when e % 13 = 0 then (n+1) % 21 else n end rn,
             case when e % 7 < 2 then 0 when e % 11 = 0 then 21 else c end rc
      from (select *, i % 19 o, i % 21 n, {_coda("(i % 8)")} c
            from (select o_orderkey trial_id, {d.div("o_custkey", "10")} listener_id,
                    {_hash(d, "t", "o_orderkey")} % 3192 i, {_hash(d, "e", "o_orderkey")} e,
                    {_hash(d, "t", "o_orderkey")} % 3192 stimulus_id,
                    false is_synthetic,
                    case when o_orderstatus = 'F' then 'quiet' else 'noise' end condition
                  from {d.table("orders")}) a) b) c"""


def word_vocab(d: Spark) -> str:
    parts = [_syl(d, f"{_hash(d, 'v', 'p_partkey')} + {k * 131}") for k in range(4)]
    return f"""
select v, n_syll, min(concat(s0, case when n_syll>1 then s1 else '' end,
  case when n_syll>2 then s2 else '' end, case when n_syll>3 then s3 else '' end)) word
from (select p_partkey v,
        case when p_partkey%100<20 then 1 when p_partkey%100<65 then 2 when p_partkey%100<90 then 3 else 4 end n_syll,
        {parts[0]} s0, {parts[1]} s1, {parts[2]} s2, {parts[3]} s3 from {d.table("part")}) q group by v, n_syll"""


def word_trials(d: Spark) -> str:
    e = "e.event_id"
    return f"""
select e.event_id row_id, e.user_id listener_id, w.word, w.n_syll,
  case {_hash(d, "n", e)} % 5 when 0 then 20 when 1 then 10 when 2 then 5 when 3 then 0 else -5 end snr_db,
  case when e.event_id % 2 = 0 then 'male' else 'female' end speaker,
  cast({_hash(d, "s", e)} % 41 as double) / 40 score,
  cast({_hash(d, "b", e)} % 1009 as double) / 1009 score_b,
  case when {_hash(d, "y", e)} % 41 < {_hash(d, "s", e)} % 41 then 1 else 0 end misheard,
  {_hash(d, "q", e)} % 4 n_segment_errors,
  case {_hash(d, "p", e)} % 3 when 0 then w.word when 1 then concat('각', w.word) else substr(w.word, 1, 1) end perceived_word,
  1 + {_hash(d, "d", e)} % 5 seed
from (select *, {_hash(d, "w", "event_id")} % {d.count("part")} vkey from {d.table("events")}) e join word_vocab w on w.v = e.vkey"""


def tokens(d: Spark) -> str:
    r = "row_id"
    return f"""
select {d.div(r, "64")} media_id, row_id % 64 tok_idx, listener_id,
  case when {_hash(d, "x", r)} % 13 = 0 then '2024' else word end text,
  cast((row_id % 64)*400 + {_hash(d, "a", r)} % 7 * 50 as double) / 1000 start_s,
  cast((row_id % 64)*400 + {_hash(d, "a", r)} % 7 * 50 + 100 + {_hash(d, "b", r)} % 5 * 50 as double) / 1000 end_s,
  case when {_hash(d, "c", r)} % 9 = 0 then null else cast({_hash(d, "c", r)} % 100 as double)/100 end confidence,
  score listener_risk
from word_trials"""


def audiogram_points(d: Spark) -> str:
    g = _hash(d, "g", "l.listener_id", "e.ear", "f.hz")
    return f"""
select l.listener_id, e.ear, f.hz,
  case when {g} % 41 = 0 then null else cast({g} % 100 - 10 as double) end db_hl,
  {g} % 37 = 0 and {g} % 41 <> 0 no_response, {g} % 5 = 0 masked
from (select distinct {d.div("c_custkey", "10")} listener_id from {d.table("customer")}) l
cross join (select 'left' ear union all select 'right') e
cross join (select 125 hz union all select 250 union all select 500 union all select 1000 union all select 2000
  union all select 3000 union all select 4000 union all select 6000 union all select 8000) f"""


def speech_scores(d: Spark) -> str:
    g = _hash(d, "sp", "l.listener_id", "e.ear")
    return f"""
select l.listener_id, e.ear, case when {g} % 7 = 0 then null else cast({g} % 80 as double) end srt_db_hl,
  case when {g} % 6 = 0 then null else cast({g} % 101 as double) end wrs_percent,
  case when {g} % 6 = 0 or {g} % 43 = 0 then null else cast({g} % 60 + 40 as double) end wrs_level_db_hl
from (select distinct {d.div("c_custkey", "10")} listener_id from {d.table("customer")}) l
cross join (select 'left' ear union all select 'right') e"""


def pi_points(d: Spark) -> str:
    g = _hash(d, "pi", "l.listener_id", "e.ear", "p.lv")
    k = _hash(d, "pk", "l.listener_id", "e.ear")
    return f"""
select l.listener_id, e.ear, cast(p.lv as double) level_db_hl, cast({g} % 11 * 10 as double) score_percent
from (select distinct {d.div("c_custkey", "10")} listener_id from {d.table("customer")}) l
cross join (select 'left' ear union all select 'right') e
cross join (select 40 lv union all select 55 union all select 70 union all select 85 union all select 100) p
where {k} % 5 <> 0"""


def loudness(d: Spark) -> str:
    g = _hash(d, "lo", "l.listener_id", "e.ear")
    return f"""
select l.listener_id, e.ear, case when {g} % 8 = 0 then null else cast({g} % 50 + 30 as double) end mcl_db_hl,
  case when {g} % 9 = 0 then null else cast({g} % 70 + 50 as double) end ucl_db_hl
from (select distinct {d.div("c_custkey", "10")} listener_id from {d.table("customer")}) l
cross join (select 'left' ear union all select 'right') e"""


def hearing_meta(d: Spark) -> str:
    """Header row of a stored hearing profile, some with contradictory provenance."""
    return f"""
select listener_id, case h % 3 when 0 then 'manual' when 1 then 'clinical_export' else 'synthetic' end source,
  case when h % 19 = 0 then h % 3 <> 2 else h % 3 = 2 end is_synthetic
from (select listener_id, {_hash(d, "hm", "listener_id")} h
      from (select distinct {d.div("c_custkey", "10")} listener_id from {d.table("customer")}) l) x"""


def utterances(d: Spark) -> str:
    return f"""
select conv_id*1000+turn utt_id, conv_id % 10 speaker_id, text reference,
  replace(replace(text,'tion ','tion'),' an',' on') hypothesis,
  cast(length(text) as double) / 15 duration_s, cast({_hash(d, "rt", "conv_id*1000+turn")} % 500 as double) / 100 runtime_s
from {d.table("conversations")}"""


def live_cues(d: Spark) -> str:
    return f"""
select e.user_id stream_id, e.user_id listener_id, e.event_id seq, e.ts observed_at,
  concat('player-', {_s("e.user_id % 3")}) source,
  case when e.event_type='error' then null
       when e.event_type in ('view','click') then concat('자막 ', e.event_type)
       else concat(w.word, ' ', e.event_type) end text,
  e.event_id + {_hash(d, "ar", "e.event_id")} % 400 arrival
from (select *, {_hash(d, "lc", "event_id")} % {d.count("part")} vkey from {d.table("events")}) e join word_vocab w on w.v = e.vkey"""


def texts(d: Spark) -> str:
    return f"""
select row_id text_id, concat(word, case when row_id % 5 = 0 then ' 2024! ' when row_id % 3 = 0 then ' abc  ' else ' ' end, perceived_word) text
from word_trials"""


def dirty_tokens(d: Spark) -> str:
    """Tokens with broken times, confidences and risks."""
    g = _hash(d, "dt", "row_id")
    return f"""
select row_id, {d.div("row_id", "64")} media_id, word text, case when {g} % 31 = 0 then -1.5 else cast(row_id % 64 as double) end start_s,
  case when {g} % 37 = 0 then cast(row_id % 64 - 3 as double) when {g} % 41 = 0 then null else cast(row_id % 64 + 1 as double) end end_s,
  case when {g} % 43 = 0 then 1.5 when {g} % 7 = 0 then null else score end confidence,
  case when {g} % 47 = 0 then -0.1 when {g} % 53 = 0 then null else score_b end listener_risk,
  case when {g} % 29 = 0 then 2 else misheard end label
from word_trials"""


def stored_profiles(d: Spark) -> str:
    """Profile headers as stored: some under another listener's name, some synthetic."""
    h = _hash(d, "pr", "listener_id")
    return f"""
select listener_id, case when {h} % 13 = 0 then listener_id + 1 else listener_id end owner_id, {h} % 3 = 0 is_synthetic, {h} % 40 n_trials, {h} % 17 <> 0 present
from (select distinct {d.div("c_custkey", "10")} listener_id from {d.table("customer")}) l"""


def files_recorded(d: Spark) -> str:
    """A recorded file set: one file per document source row."""
    return f"""
select concat(source, '/', {_s("doc_id")}, '.txt') path, n_chars bytes, md5(text) sha256, source source_id from {d.table("documents")}"""


def files_present(d: Spark) -> str:
    """The same set as found later: some missing, resized, edited or added."""
    h = _hash(d, "fp", "doc_id")
    return f"""
select case when {h} % 23 = 0 then concat(source, '/new-', {_s("doc_id")}, '.txt') else concat(source, '/', {_s("doc_id")}, '.txt') end path,
  case when {h} % 19 = 0 then n_chars + 1 else n_chars end bytes,
  case when {h} % 17 = 0 then md5(concat(text, 'x')) else md5(text) end sha256, source source_id
from {d.table("documents")} where {h} % 29 <> 0"""


def run_log(d: Spark) -> str:
    """An append-only run log: several entries per run, some ids opened twice."""
    r = d.div("o_orderkey", "3")
    return f"""
select o_orderkey entry_id, concat('run-', {_s(r)}) run_id, o_orderpriority name, o_orderdate logged_at,
  case when {_hash(d, "st", r)} % 97 = 0 then o_orderkey else {r} end started_at,
  case o_orderstatus when 'F' then 'completed' when 'O' then 'running' else 'failed' end status, o_totalprice value
from {d.table("orders")}"""


FIXTURES = {f.__name__: f for f in (
    calib_trials, word_vocab, word_trials, tokens, audiogram_points, speech_scores, pi_points,
    loudness, hearing_meta, utterances, live_cues, texts,
    dirty_tokens, stored_profiles, files_recorded, files_present, run_log)}


def needed(sql: str, pool: Mapping[str, str]) -> list[str]:
    """Names in ``pool`` that ``sql`` uses, dependencies first."""
    out: list[str] = []

    def visit(text: str) -> None:
        for name in pool:
            if name not in out and re.search(rf"\b{name}\b", text):
                visit(pool[name])
                if name not in out:
                    out.append(name)

    visit(sql)
    return out


_VOCABULARY: dict[str, int] = {}


class _Bodies(Mapping):
    """Texts of the derived tables, each rendered when it is used, so that only tables in use are looked at."""

    def __init__(self, dialect: Spark):
        self.dialect = dialect

    def __getitem__(self, name: str) -> str:
        return FIXTURES[name](self.dialect)

    def __iter__(self) -> Iterator[str]:
        return iter(FIXTURES)

    def __len__(self) -> int:
        return len(FIXTURES)


#: Rows of a given table that one task derives from: heavy arithmetic a row, few bytes.
TASK_ROWS = 50_000


class Tables:
    """Given and derived tables as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        # The vocabulary size as a number: parquet footers answer this without a scan.
        if sf_dir not in _VOCABULARY:
            _VOCABULARY[sf_dir] = spark.read.parquet(f"{sf_dir}/part.parquet").count()
        self.spark, self._parts = spark, {}
        self.dialect = Spark(sf_dir, self._spread, {"part": _VOCABULARY[sf_dir]})
        self._pool = _Bodies(self.dialect)

    def _spread(self, name: str) -> int:
        """Tasks to spread a table's rows over before the derivation's arithmetic; 0 where its scan has as many.

        Each table is judged by its own files, since a small file of many rows is one scan task.
        """
        if name not in self._parts:
            scan = self.spark.read.parquet(f"{self.dialect.sf_dir}/{name}.parquet")
            tasks = max(self.spark.sparkContext.defaultParallelism, -(-scan.count() // TASK_ROWS))  # from the footers
            self._parts[name] = tasks if scan._jdf.queryExecution().toRdd().getNumPartitions() * 2 < tasks else 0
        return self._parts[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name in GIVEN:
            return self.spark.read.parquet(f"{self.dialect.sf_dir}/{name}.parquet")
        if name not in FIXTURES:
            raise AttributeError(name)
        body = self._pool[name]
        parts = ",\n".join(f"{n} as ({self._pool[n]})" for n in needed(body, self._pool) if n != name)
        return self.spark.sql(f"with {parts} {body}" if parts else body)
