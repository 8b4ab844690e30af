"""Feature blocks of (listener, word) pairs, by one gather per Arrow batch.

A pair comes with its word's slots (phonemes) and its listener's arrays of 68 values. A batch's arrays are
matrices of 68 columns; one indexed read picks the values of all phonemes of all its pairs, and every
column is a sum, a minimum or a maximum over each pair's stretch of them. Words without Hangul get the
neutral values of their columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phonrisk.functions import hangul as hg
from phonrisk.operators import dims

EPS = 1e-6
SLOTS = sum(len(a) for a in hg.ALPHABET.values())
#: Profile fields that each block reads.
FIELDS = {
    "confusion": ("p", "n", "h", "backed_off", "nlog"), "confusion_rich": ("p", "n", "top1", "same"),
    "exact_target": ("own_p",), "exact_target_offdiag": ("own_p", "own_n", "top1", "same"),
}


class Batch:
    """Slots and gathered profile values of a batch of pairs."""

    def __init__(self, batch: pa.RecordBatch, fields: list[str]):
        lists = batch.column("slots")
        self.rows, self.slots = len(lists), lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        self.size = lists.value_lengths().to_numpy(zero_copy_only=False)
        self.row = np.repeat(np.arange(self.rows), self.size)
        self.profile = {f: self._matrix(batch.column(f"prof_{f}")) for f in fields}
        self.at = {f: m[self.row, self.slots] for f, m in self.profile.items()}

    def _matrix(self, lists: pa.Array) -> np.ndarray:
        return lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(self.rows, SLOTS)

    def part(self, position: str) -> np.ndarray:
        lo = dims.SLOT_BASE[position]
        return (self.slots >= lo) & (self.slots < lo + len(hg.ALPHABET[position]))

    def total(self, values: np.ndarray, where: np.ndarray | slice = slice(None)) -> np.ndarray:
        return np.bincount(self.row[where], values[where], self.rows)

    def mean(self, values: np.ndarray, empty: float, where: np.ndarray | slice = slice(None)) -> np.ndarray:
        n = np.bincount(self.row[where], minlength=self.rows)
        return np.where(n > 0, self.total(values, where) / np.maximum(n, 1), empty)

    def least(self, values: np.ndarray, empty: float, where: np.ndarray | slice = slice(None)) -> np.ndarray:
        rows, out = self.row[where], np.full(self.rows, empty)
        if len(rows):
            first = np.flatnonzero(np.diff(rows, prepend=-1))
            out[rows[first]] = np.minimum.reduceat(values[where], first)
        return out

    def most(self, values: np.ndarray, empty: float) -> np.ndarray:
        return -self.least(-values, -empty)

    def counts(self) -> np.ndarray:
        """How often each slot stands in each pair's word."""
        return np.bincount(self.row * SLOTS + self.slots, minlength=self.rows * SLOTS).reshape(self.rows, SLOTS).astype(float)


def _spread(p: np.ndarray, n: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    q = np.clip(p, EPS, 1 - EPS)
    return np.sqrt(q * (1 - q) / (n + alpha + 1.0))


def _confusion(b: Batch, extra: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    p, n = b.at["p"], b.at["n"]
    total, low = b.total(b.at["nlog"]), b.least(p, 1.0)
    out = {"x_r_phon": 1 - np.exp(-total), "x_neg_log_correct": total, "x_min_p_correct": low, "x_mean_p_correct": b.mean(p, 1.0), "x_max_error": 1 - low}
    parts = {pos: b.part(pos) for pos in hg.POSITIONS}
    out |= {f"x_mean_p_{pos}": b.mean(p, 1.0, m) for pos, m in parts.items()}
    out |= {f"x_min_p_{pos}": b.least(p, 1.0, m) for pos, m in parts.items()}
    return out | {"x_mean_row_entropy": b.mean(b.at["h"], 0.0), "x_min_evidence": b.least(n, 0.0), "x_mean_evidence": b.mean(n, 0.0),
                  "x_frac_unobserved": b.mean((n == 0) * 1.0, 1.0), "x_frac_backed_off": b.mean(b.at["backed_off"], 0.0)}


def _class_matrix() -> np.ndarray:
    out = np.zeros((SLOTS, len(dims.CLASS_NAMES)))
    for pos, alphabet in hg.ALPHABET.items():
        for i, s in enumerate(alphabet):
            for c in dims.classes_of(pos, s):
                out[dims.SLOT_BASE[pos] + i, dims.CLASS_NAMES.index(c)] = 1
    return out


def _rich(b: Batch, extra: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    p, n, alpha = b.at["p"], b.at["n"], extra["alpha"][b.row]
    share = np.where(b.size[:, None] > 0, b.counts() @ _class_matrix() * 3.0 / np.maximum(b.size, 1)[:, None], 0.0)
    out = {f"ix_{c}": extra["weak"][:, k] * share[:, k] for k, c in enumerate(dims.CLASS_NAMES)}
    out |= {f"w2_{c}": share[:, k] for k, c in enumerate(dims.CLASS_NAMES)}
    mass, sd = np.maximum(1 - p, EPS), _spread(p, n, alpha)
    out |= {"x2_top1_share": b.mean(b.at["top1"] / mass, 0.0), "x2_within_class_share": b.mean(b.at["same"] / mass, 0.0),
            "x2_across_class_share": b.mean((mass - b.at["same"]) / mass, 0.0), "x2_post_sd_mean": b.mean(sd, 0.0),
            "x2_post_sd_max": b.most(sd, 0.0), "x2_frac_thin_evidence": b.mean((n < 3) * 1.0, 1.0)}
    order = np.lexsort((p, b.row))  # each pair's phonemes, weakest first
    place = np.arange(len(order)) - np.repeat(np.cumsum(b.size) - b.size, b.size)
    two = np.zeros(len(order), bool)
    two[order] = place < 2
    low = b.least(p, 1.0)
    out |= {"x2_worst_two_mean": b.mean(p, 1.0, two), "x2_p_spread": np.where(b.size > 0, b.most(p, 0.0) - low, 0.0)}
    return out | {f"x2_min_p_{pos}": b.least(p, 1.0, b.part(pos)) for pos in hg.POSITIONS}


def _exact_target(b: Batch, extra: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    expected = b.counts() * (1 - b.profile["own_p"])
    return {f"et_{pos}{i:02d}": expected[:, dims.SLOT_BASE[pos] + i] for pos, a in hg.ALPHABET.items() for i in range(len(a))}


def _exact_offdiag(b: Batch, extra: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    mass, same, out = np.maximum(1 - b.at["own_p"], EPS), b.at["same"], {}
    sd = _spread(b.at["own_p"], b.at["own_n"], extra["alpha"][b.row])
    for pos in hg.POSITIONS:
        m = b.part(pos)
        out |= {f"eo_{pos}_expected_errors": b.total(mass, m), f"eo_{pos}_within_class": b.mean(same, 0.0, m),
                f"eo_{pos}_across_class": b.mean(mass - same, 0.0, m), f"eo_{pos}_top1_share": b.mean(b.at["top1"] / mass, 0.0, m),
                f"eo_{pos}_evidence": b.mean(b.at["own_n"], 0.0, m), f"eo_{pos}_uncertainty": b.mean(sd, 0.0, m)}
    return out


BLOCKS = {"confusion": _confusion, "confusion_rich": _rich, "exact_target": _exact_target, "exact_target_offdiag": _exact_offdiag}


def evidence_blocks(evidence: DataFrame, keep: list[str], blocks: list[str], names: list[str]) -> DataFrame:
    """``keep`` and the columns ``names`` of the given blocks, one row a pair; ``confusion_rich`` needs ``weak``, a map by class."""
    fields = sorted({f for b in blocks for f in FIELDS[b]})
    rich = "confusion_rich" in blocks
    weak = [F.array(*[F.try_element_at("weak", F.lit(c)) for c in dims.CLASS_NAMES]).alias("weak")] if rich else []

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            b = Batch(batch, fields)
            extra = {"alpha": batch.column("alpha").to_numpy(zero_copy_only=False)}
            if rich:
                extra["weak"] = batch.column("weak").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.rows, len(dims.CLASS_NAMES))
            made = {k: v for block in blocks for k, v in BLOCKS[block](b, extra).items()}
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keep], *[pa.array(made[n], pa.float64()) for n in names]], [*keep, *names])

    schema = ", ".join([f"`{k}` {evidence.schema[k].dataType.simpleString()}" for k in keep] + [f"`{n}` double" for n in names])
    rows = evidence.select(*keep, "slots", "alpha", *weak, *[F.col(f"prof_{f}").alias(f"prof_{f}") for f in fields])
    return rows.mapInArrow(work, schema)
