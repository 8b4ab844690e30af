"""Feature blocks of words, listeners and their interaction.

A listener's confusion profile is at most 68 targets, so it travels as one array. Scoring a
(listener, word) pair is then one join by listener and row-local array work: phoneme rows are
never exploded and shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phonrisk.functions import hangul as hg
from phonrisk.operators import confusion as cf
from phonrisk.operators import dims, walk

EPS = 1e-6
SPEAKERS = ("female", "male", "unknown")
CODA0, SLOTS = dims.SLOT_BASE["coda"], dims.N_TARGETS
FIELDS = ("p", "n", "backed_off", "own_p", "own_n", "h", "top1", "same", "nlog")

# Block sets of the named arms.
ARMS: dict[str, tuple[str, ...]] = {
    "word_context_only": ("word", "context"),
    "pta_only": ("word", "context", "pta"),
    "clinical": ("word", "context", "clinical"),
    "confusion_only": ("word", "context", "confusion"),
    "clinical_plus_confusion": ("word", "context", "clinical", "confusion"),
    "confusion_rich_only": ("word", "context", "confusion", "confusion_rich"),
    "clinical_plus_confusion_rich": ("word", "context", "clinical", "confusion", "confusion_rich"),
    "exact_target": ("word", "context", "clinical", "confusion", "confusion_rich", "exact_target"),
    "exact_target_offdiag": ("word", "context", "clinical", "confusion", "confusion_rich", "exact_target", "exact_target_offdiag"),
    "live_word_context": ("word",),
    "live_word_context_clinical": ("word", "clinical"),
    "live_word_context_clinical_confusion": ("word", "clinical", "confusion"),
}


def _surface_slots() -> list[int]:
    out = list(range(CODA0))
    for s in hg.CODAS:
        out.append(CODA0 + hg.CODAS.index(hg.class_of(hg.CODA_SURFACE, s) or s))
    return out


def word_slots(word: Column) -> Column:
    """Target slots (0..67) of every phoneme of a word, in order."""
    return F.flatten(F.transform(hg.syllables(word), lambda s: F.array(
        hg.onset_index(s), hg.nucleus_index(s) + 19, hg.coda_index(s) + CODA0)))


# ---- word and context blocks


def _any_cluster() -> Column:
    changed = [i for i, s in enumerate(_surface_slots()) if s != i]
    return F.exists("slots", lambda s: s.isin(*changed))


def _times(values: Column, wanted: list) -> Column:
    """How many array elements are among ``wanted``."""
    return F.size(F.filter(values, lambda v: v.isin(*wanted)))


def word_block(words: DataFrame, word: str = "word") -> DataFrame:
    """Ten listener-free columns per row of ``words`` (distinct words are enough)."""
    df = words.withColumn("_syl", hg.syllables(F.col(word))).withColumn("slots", word_slots(F.col(word)))
    n = F.size("_syl").cast("double")
    codas = F.size(F.filter("slots", lambda s: s > CODA0)).cast("double")
    kinds = F.transform("_syl", hg.structure)
    part = lambda x: F.coalesce(F.try_divide(x, n), F.lit(0.0))
    cols = {
        "w_n_syllables": n, "w_n_phonemes": n * 3, "w_n_codas": codas, "w_coda_ratio": part(codas),
        "w_n_distinct_onsets": F.size(F.array_distinct(F.filter("slots", lambda s: s < 19))).cast("double"),
        "w_has_cluster_coda": _any_cluster().cast("double"),
    }
    for s in hg.STRUCTURES:
        cols[f"w_struct_{s}"] = part(_times(kinds, [s]).cast("double"))
    return df.select(*words.columns, *[c.alias(name) for name, c in cols.items()])


def context_columns() -> dict[str, Column]:
    out = {"c_snr_db": F.col("snr_db").cast("double")}
    for s in SPEAKERS:
        out[f"c_speaker_{s}"] = (F.col("speaker") == s).cast("double")
    return out


# ---- clinical blocks


def _flagged(values: dict[str, Column]) -> dict[str, Column]:
    out: dict[str, Column] = {}
    for name, value in values.items():
        out[name] = value
        out[f"{name}_missing"] = value.isNull().cast("double")
    return out


def pta_columns() -> dict[str, Column]:
    return _flagged({
        "h_pta_better": F.col("better_ear_pta"), "h_pta_worse": F.col("worse_ear_pta"),
        "h_pta_asymmetry": F.col("worse_ear_pta") - F.col("better_ear_pta"),
        "h_audiogram_slope": F.col("audiogram_slope"), "h_high_freq_mean": F.col("high_freq_mean")})


def clinical_columns() -> dict[str, Column]:
    return pta_columns() | _flagged({
        "h_srt": F.col("srt"), "h_srt_minus_pta": F.col("srt") - F.col("better_ear_pta"),
        "h_wrs": F.col("wrs"), "h_pbmax": F.col("pbmax"), "h_mcl": F.col("mcl")})


# ---- listener profile as one row


def profile_vectors(est: DataFrame, keys: list[str], alpha: float = cf.ALPHA, *, tops: int = 0) -> DataFrame:
    """Pack estimated target rows: one array of 68 values per field (``prof_*``), in slot order.

    Separate arrays let column pruning carry only the fields a block uses through the join.

    Coda back-off depends on listener and target only, so it is settled here, once per listener:
    a coda nobody was tested on takes its surface coda's estimate when that one was observed.
    With ``tops``, ``prof_tops`` holds each target's likeliest wrong answers (perceived, p, n), so that
    phonemes are explained without a join back.
    """
    d = dims.dim_target(est.sparkSession).select("slot", "same_mask")
    rows = est.join(F.broadcast(d), "slot")  # 68 rows
    own = F.col("probs")[F.col("t_idx")]
    off = F.filter(F.transform("probs", lambda p, i: F.when(i != F.col("t_idx"), p)), lambda p: p.isNotNull())
    same = F.aggregate(F.zip_with("probs", "same_mask", lambda p, m: F.when(m, p).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)
    h = -F.aggregate("probs", F.lit(0.0), lambda a, x: a + F.when(x > 0, x * F.log(x)).otherwise(0.0))
    hit = F.coalesce(F.try_element_at("m", F.col("t_idx")), F.lit(0))
    packed = rows.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("slot", own.alias("p"), F.col("big_n").cast("long").alias("n"), h.alias("h"),
                                             F.array_max(off).alias("top1"), same.alias("same"),
                                             *([cf.wrong_answers(tops).alias("tops")] if tops else [])))).alias("_cells"),  # 68 a listener
        F.coalesce(1 - F.try_divide(F.sum(hit), F.sum("big_n")), F.lit(0.5)).alias("global_error"))
    surface = F.array(*[F.lit(s) for s in _surface_slots()])

    def settle(c: Column) -> Column:
        via = F.col("_cells")[surface[c["slot"]]]
        back = (c["slot"] > CODA0) & (surface[c["slot"]] != c["slot"]) & (c["n"] == 0) & (via["n"] > 0)
        p = F.when(back, via["p"]).otherwise(c["p"])
        return F.struct(
            p.alias("p"), F.when(back, via["n"]).otherwise(c["n"]).alias("n"), back.alias("backed_off"),
            c["p"].alias("own_p"), c["n"].alias("own_n"), c["h"].alias("h"), c["top1"].alias("top1"), c["same"].alias("same"),
            (-F.log(F.greatest(p, F.lit(EPS)))).alias("nlog"))

    settled = packed.withColumn("_prof", F.transform("_cells", settle))
    more = [F.col("_cells")["tops"].alias("prof_tops")] if tops else []
    return settled.select(*keys, *[F.col("_prof")[f].alias(f"prof_{f}") for f in FIELDS], *more, "global_error", F.lit(float(alpha)).alias("alpha"))


# One owner's counts as a matrix of targets by perceived categories; the last column is of categories outside the alphabet.
_WIDTH = max(len(a) for a in hg.ALPHABET.values()) + 2
_BLOCK = 500  # owners whose matrices are held at once


def profiles(counts: DataFrame, keys: list[str], alpha: float = cf.ALPHA) -> DataFrame:
    """``profile_vectors`` of counts smoothed with ``alpha`` and a uniform prior, made block by block of owners.

    Only the observed cells move, once, to their owner; the 68 x 29 estimates of an owner are array
    arithmetic in its task and are never rows.
    """
    if alpha <= 0:
        raise ValueError("alpha must be > 0")
    targets = [(pos, i, s) for pos, a in hg.ALPHABET.items() for i, s in enumerate(a)]
    k = np.array([len(hg.ALPHABET[pos]) + 1 for pos, _, _ in targets])
    own = np.array([i for _, i, _ in targets])
    known = np.arange(_WIDTH) < k[:, None]
    same = np.array([[j != i and j < len(hg.ALPHABET[pos]) and dims.sound_class(pos, hg.ALPHABET[pos][j]) == dims.sound_class(pos, s) for j in range(_WIDTH)]
                     for pos, i, s in targets])
    surface, slots = np.array(_surface_slots()), np.arange(SLOTS)
    may_back = (slots > CODA0) & (surface != slots)

    def block(cells: pa.ListArray) -> dict[str, np.ndarray]:
        rows, size = len(cells), SLOTS * _WIDTH
        at = np.repeat(np.arange(rows), cells.value_lengths().to_numpy(zero_copy_only=False)) * size
        inner = cells.flatten()
        at = at + inner.field("cell").to_numpy(zero_copy_only=False)
        m = np.bincount(at, inner.field("n").to_numpy(zero_copy_only=False), rows * size).reshape(rows, SLOTS, _WIDTH)
        n = m.sum(2)
        p = np.where(known, (m + alpha / k[:, None]) / (n + alpha)[:, :, None], 0.0)
        own_p, hit = p[:, slots, own], m[:, slots, own].sum(1)
        off = p.copy()
        off[:, slots, own] = 0.0
        back = may_back & (n == 0) & (n[:, surface] > 0)
        settled = np.where(back, own_p[:, surface], own_p)
        total = n.sum(1)
        return {"p": settled, "n": np.where(back, n[:, surface], n).astype(np.int64), "backed_off": back, "own_p": own_p, "own_n": n.astype(np.int64),
                "h": -(p * np.log(np.where(p > 0, p, 1.0))).sum(2), "top1": off.max(2), "same": (p * same).sum(2), "nlog": -np.log(np.maximum(settled, EPS)),
                "global_error": np.where(total > 0, 1 - hit / np.maximum(total, 1), 0.5)}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, _BLOCK):
                part = batch.slice(start, _BLOCK)
                made = block(part.column("cells"))
                offsets = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * SLOTS)
                arrays = [pa.ListArray.from_arrays(offsets, pa.array(made[f].ravel())) for f in FIELDS]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keys], *arrays, pa.array(made["global_error"])],
                                                 [*keys, *[f"prof_{f}" for f in FIELDS], "global_error"])

    pos = F.col("position")
    slot = (F.when(pos == "onset", hg.position_index(hg.ONSETS, F.col("target")))
            .when(pos == "nucleus", hg.position_index(hg.NUCLEI, F.col("target")) + dims.SLOT_BASE["nucleus"])
            .when(pos == "coda", hg.position_index(hg.CODAS, F.col("target")) + CODA0))
    heard = dims.perceived_index(pos, F.col("perceived"))
    cell = (slot * _WIDTH + F.when(heard < 0, _WIDTH - 1).otherwise(heard)).cast("int")
    packed = counts.withColumn("_cell", cell).groupBy(*keys).agg(F.collect_list(
        F.when(F.col("_cell").isNotNull(), F.struct(F.col("_cell").alias("cell"), F.col("n").cast("double").alias("n")))).alias("cells"))  # at most 1,654
    kind = {"n": "bigint", "own_n": "bigint", "backed_off": "boolean"}
    schema = ", ".join([f"`{c}` {counts.schema[c].dataType.simpleString()}" for c in keys] + [f"prof_{f} array<{kind.get(f, 'double')}>" for f in FIELDS] + ["global_error double"])
    return packed.mapInArrow(work, schema).withColumn("alpha", F.lit(float(alpha)))


def class_weakness(est: DataFrame, keys: list[str]) -> DataFrame:
    """Observation-weighted error per sound class; unobserved classes get the global error."""
    d = dims.dim_target(est.sparkSession).select("slot", "classes")
    rows = est.join(F.broadcast(d), "slot").withColumn("_err", 1 - F.col("probs")[F.col("t_idx")])  # 68 rows
    by_class = (rows.select(*keys, "big_n", "_err", F.explode_outer("classes").alias("class")).groupBy(*keys, "class")
                .agg(F.try_divide(F.sum(F.col("big_n") * F.col("_err")), F.sum("big_n")).alias("_w")))
    hit = F.coalesce(F.try_element_at("m", F.col("t_idx")), F.lit(0))
    overall = est.groupBy(*keys).agg(F.coalesce(1 - F.try_divide(F.sum(hit), F.sum("big_n")), F.lit(0.5)).alias("_g"))
    return by_class.join(overall, keys).select(*keys, "class", F.coalesce("_w", "_g").alias("weakness"))


def weakness_of(vectors: DataFrame) -> DataFrame:
    """``vectors`` with ``weak``, a map of ``class_weakness`` by class, made of each listener's own arrays."""
    n, p = F.col("prof_own_n"), F.col("prof_own_p")

    def value(slots: list[int]) -> Column:
        total = reduce(Column.__add__, [n[s] for s in slots])
        wrong = reduce(Column.__add__, [n[s] * (1 - p[s]) for s in slots])
        return F.coalesce(F.try_divide(wrong, total), F.col("global_error"))

    return vectors.withColumn("weak", F.create_map(*[x for c, slots in _class_slots().items() for x in (F.lit(c), value(slots))]))


def _class_slots() -> dict[str, list[int]]:
    out: dict[str, list[int]] = {c: [] for c in dims.CLASS_NAMES}
    for pos, alphabet in hg.ALPHABET.items():
        for i, s in enumerate(alphabet):
            for c in dims.classes_of(pos, s):
                out[c].append(dims.SLOT_BASE[pos] + i)
    return out


def class_share_columns() -> dict[str, Column]:
    """Share of a word's syllables in each class; needs ``slots``."""
    n = F.size("slots") / 3.0
    return {c: F.coalesce(F.try_divide(_times(F.col("slots"), m), n), F.lit(0.0))
            for c, m in _class_slots().items()}


# ---- evidence of a word for a listener


def with_evidence(pairs: DataFrame, vectors: DataFrame, keys: list[str], word: str = "word") -> DataFrame:
    """Pairs beside their listener's arrays, with ``slots``: the phonemes that index them.

    The pair side may be skewed by listener; AQE splits such partitions.
    """
    return pairs.join(vectors, keys).withColumn("slots", word_slots(F.col(word)))


class At:
    """The listener's estimate for one slot: ``e["p"]`` reads ``prof_p`` there."""

    def __init__(self, slot: Column):
        self.slot = slot

    def __getitem__(self, name: str) -> Column:
        return self.slot if name == "slot" else F.col(f"prof_{name}")[self.slot]


def each(fn, slots: Column | str = "slots") -> Column:
    """``fn`` of every phoneme's estimate, in word order."""
    return F.transform(slots, lambda s: fn(At(s)))


def phoneme_risks(evidence: DataFrame, keep: list[str]) -> DataFrame:
    """One row per phoneme of a pair with its evidence, and ``top_confusions`` where the profiles hold them."""
    tops = ["tops"] if "prof_tops" in evidence.columns else []
    fields = each(lambda e: F.struct(e["slot"].alias("slot"), *[e[f].alias(f) for f in ("p", "n", "backed_off", *tops)]))
    out = evidence.select(*keep, F.posexplode_outer(fields).alias("k", "e")).where("e is not null")
    pos, symbol = slot_name(F.col("e.slot"))
    return out.select(*keep, F.floor(F.col("k") / 3).alias("syllable_idx"), pos.alias("position"), symbol.alias("target"), F.col("e.p").alias("p_correct"),
                      F.col("e.n").alias("n_observations"), F.col("e.backed_off").alias("backed_off"), *[F.col("e.tops").alias("top_confusions") for _ in tops])


def slot_name(slot: Column) -> tuple[Column, Column]:
    """Position and symbol of a slot."""
    pos = F.when(slot < 19, "onset").when(slot < CODA0, "nucleus").otherwise("coda")
    return pos, F.substr(F.lit(hg.ONSETS + hg.NUCLEI + hg.CODAS), slot + 1, F.lit(1))


def _neg_log() -> Column:
    return F.aggregate("slots", F.lit(0.0), lambda a, s: a + F.col("prof_nlog")[s])


def independence_risk() -> Column:
    """1 - product of the phonemes' correct probabilities."""
    return 1 - F.exp(-_neg_log())


def arm_columns(arm: str) -> list[str]:
    """Ordered feature names of an arm."""
    return block_columns(ARMS[arm])


def block_columns(blocks: Iterable[str]) -> list[str]:
    """Ordered feature names of some blocks."""
    word = ["w_n_syllables", "w_n_phonemes", "w_n_codas", "w_coda_ratio", "w_n_distinct_onsets", "w_has_cluster_coda",
            *[f"w_struct_{s}" for s in hg.STRUCTURES]]
    flags = lambda names: [x for n in names for x in (n, f"{n}_missing")]
    pta = flags(["h_pta_better", "h_pta_worse", "h_pta_asymmetry", "h_audiogram_slope", "h_high_freq_mean"])
    names = {
        "word": word, "context": ["c_snr_db", *[f"c_speaker_{s}" for s in SPEAKERS]], "pta": pta,
        "clinical": pta + flags(["h_srt", "h_srt_minus_pta", "h_wrs", "h_pbmax", "h_mcl"]),
        "confusion": ["x_r_phon", "x_neg_log_correct", "x_min_p_correct", "x_mean_p_correct", "x_max_error",
                      *[f"x_mean_p_{p}" for p in hg.POSITIONS], *[f"x_min_p_{p}" for p in hg.POSITIONS],
                      "x_mean_row_entropy", "x_min_evidence", "x_mean_evidence", "x_frac_unobserved", "x_frac_backed_off"],
        "confusion_rich": [f"ix_{c}" for c in dims.CLASS_NAMES] + [f"w2_{c}" for c in dims.CLASS_NAMES] + [
            "x2_top1_share", "x2_within_class_share", "x2_across_class_share", "x2_post_sd_mean", "x2_post_sd_max",
            "x2_frac_thin_evidence", "x2_worst_two_mean", "x2_p_spread", *[f"x2_min_p_{p}" for p in hg.POSITIONS]],
        "exact_target": [f"et_{p}{i:02d}" for p, a in hg.ALPHABET.items() for i in range(len(a))],
        "exact_target_offdiag": [f"eo_{p}_{k}" for p in hg.POSITIONS for k in (
            "expected_errors", "within_class", "across_class", "top1_share", "evidence", "uncertainty")],
    }
    return [c for block in blocks for c in names[block]]


def feature_matrix(trials: DataFrame, arm: str, *, hearing: DataFrame | None = None, est: DataFrame | None = None,
                   keep: tuple[str, ...] = ("row_id", "listener_id", "misheard"), key: str = "listener_id", cols: list[str] | None = None) -> DataFrame:
    """Named columns of ``arm`` for every trial, in fixed order; with ``cols`` only those of them are made.

    Words and (listener, word) pairs are scored once each and joined back. A listener without
    the profile an arm needs is left out here; ``missing_inputs`` lists those rows. ``est`` are estimated
    target rows, or the listeners' ``profiles``.
    """
    blocks = ARMS[arm]
    names = [c for c in arm_columns(arm) if cols is None or c in cols]
    used = [b for b in blocks if b in walk.BLOCKS]
    if used and est is None:
        raise ValueError(f"arm {arm} needs confusion estimates")
    if {"pta", "clinical"} & set(blocks) and hearing is None:
        raise ValueError(f"arm {arm} needs hearing measures")
    df = trials
    if set(block_columns(["word"])) & set(names):
        df = df.join(word_block(trials.select("word").distinct()), "word")
    if used:
        vec = est if "prof_p" in est.columns else profile_vectors(est, [key])
        if "confusion_rich" in used:
            vec = weakness_of(vec)
        ev = with_evidence(trials.select(key, "word").distinct(), vec, [key])
        df = df.join(walk.evidence_blocks(ev, [key, "word"], used, [c for c in block_columns(used) if c in names]), [key, "word"])
    if hearing is not None and {"pta", "clinical"} & set(blocks):
        h = clinical_columns() if "clinical" in blocks else pta_columns()
        df = df.join(hearing.select(key, *[c.alias(n) for n, c in h.items()]), key)
    if "context" in blocks:
        df = df.withColumns(context_columns())
    return df.select(*keep, *names)


def missing_inputs(trials: DataFrame, arm: str, *, hearing: DataFrame | None, est: DataFrame | None, key: str = "listener_id") -> DataFrame:
    """Trials an arm cannot score, with the reason."""
    who = trials.select(key).distinct()
    parts = []
    if set(ARMS[arm]) & {"pta", "clinical"}:
        parts.append(who.join(hearing.select(key), key, "left_anti").select(key, F.lit("no hearing profile").alias("reason")))
    if set(ARMS[arm]) & set(walk.BLOCKS):
        parts.append(who.join(est.select(key).distinct(), key, "left_anti").select(key, F.lit("no confusion profile").alias("reason")))
    return reduce(DataFrame.unionByName, parts) if parts else who.limit(0).withColumn("reason", F.lit(""))


def explain(evidence: DataFrame, keep: list[str], k: int = 3) -> DataFrame:
    """The k weakest phonemes of each pair with evidence and back-off flags, and ``top_confusions`` where the profiles hold them."""
    tops = ["tops"] if "prof_tops" in evidence.columns else []
    cells = F.transform("slots", lambda s, i: F.struct(
        At(s)["p"].alias("p"), i.alias("i"), s.alias("slot"), *[At(s)[f].alias(f) for f in ("n", "backed_off", *tops)]))
    out = evidence.select(*keep, F.posexplode_outer(F.slice(F.array_sort(cells), 1, k)).alias("rank", "w")).where("w is not null")
    pos, symbol = slot_name(F.col("w.slot"))
    return out.select(*keep, (F.col("rank") + 1).alias("rank"), pos.alias("position"), symbol.alias("target"),
                      F.col("w.p").alias("p_correct"), F.col("w.n").alias("n_observations"), (F.col("w.n") == 0).alias("prior_only"),
                      F.col("w.backed_off").alias("backed_off"), *[F.col("w.tops").alias("top_confusions") for _ in tops])
