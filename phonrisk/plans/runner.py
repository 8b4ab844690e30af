"""Study runner: every (arm, model, calibration) over all seeds and folds, with stored cells.

A study is a table of cells. Folds and each arm's matrix are written once under the study's folder,
split by seed and fold, so that a cell's training set is a pruned scan. Each cell's held-out predictions
go to a folder of their own and are then logged; a rerun fits only cells that are not in the log. Cells
of a plain logistic model are fitted in common passes (``cells``), cells of all other models by jobs that
run side by side. Metrics, floors, intervals and contrasts are read from the stored predictions of all
cells at once.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phonrisk.functions.text import hash32
from phonrisk.operators import cells as ce
from phonrisk.operators import features as ft
from phonrisk.operators import metrics as mt
from phonrisk.operators import models as md
from phonrisk.operators import splits as sp
from phonrisk.operators.ordered import rank_rows
from phonrisk.plans import studies as st
from phonrisk.session import durable

#: Models without a fit: the phoneme independence risk, and the training rows' base rate.
INDEPENDENCE, PREVALENCE = "phoneme_independence", "prevalence"
CELL = ["arm", "model", "calibration", "seed", "fold"]
RUN = ["seed", "arm", "model", "calibration"]
LOG = "arm string, model string, calibration string, seed long, fold long, n_train long, n_test long, n_features int, effective string, reason string, error string"


@dataclass(frozen=True)
class Study:
    """What is compared; seeds are those of the trials."""

    arms: tuple[str, ...]
    models: tuple[str, ...] = ("logistic",)
    calibrations: tuple[str, ...] = ("none",)
    folds: int = 5
    parallel: int = 4

    def runs(self) -> list[tuple[str, str, str]]:
        """(arm, model, calibration) that are defined: independence needs confusion columns, and it and the base rate are not calibrated."""
        known = {INDEPENDENCE, PREVALENCE, *md.MODELS}
        if bad := sorted(set(self.models) - known):
            raise ValueError(f"unknown models {bad}")
        return [(a, m, c) for m in self.models for a in self.arms for c in self.calibrations
                if not (m == INDEPENDENCE and "confusion" not in ft.ARMS[a]) and not (m in (INDEPENDENCE, PREVALENCE) and c != "none")]


def seeded_folds(trials: DataFrame, k: int, *, listener: str = "listener_id", y: str = "misheard", bounded: bool | None = None) -> DataFrame:
    """(seed, listener, fold): ``listener_folds`` of every seed at once."""
    if k < 2:
        raise ValueError("at least two folds are needed")
    per = trials.groupBy("seed", listener).agg(F.avg(y).alias("_r"))
    few = [r.seed for r in per.groupBy("seed").count().where(F.col("count") < k).limit(5).collect()]
    if few:
        raise ValueError(f"fewer than {k} listeners in seeds {few}")
    tie = hash32(F.concat_ws(":", F.concat(F.lit("fold"), F.col("seed")), F.col(listener)))
    ranked = rank_rows(per.withColumn("_r", F.round("_r", 9)).withColumn("_h", tie), ["seed"], ["_r", "_h", listener], bounded=bounded)
    i = F.col("rn") - 1
    lap, at = F.floor(i / k), F.pmod(i, F.lit(k))
    return ranked.select("seed", listener, F.when(lap % 2 == 0, at).otherwise(k - 1 - at).cast("int").alias("fold"))


class Runner:
    """Runs a study's cells under ``root``, a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str, study: Study, trials: DataFrame, *, hearing: DataFrame | None = None, est: DataFrame | None = None):
        self.spark, self.root, self.study, self.trials, self.hearing, self.est = spark, root, study, trials, hearing, est

    def _exists(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def _table(self, name: str, make: Callable[[], DataFrame], *parts: str) -> DataFrame:
        """A table of the study, written on first use (complete once its success mark is there)."""
        path = f"{self.root}/{name}"
        if not self._exists(f"{path}/_SUCCESS"):
            made = make()
            made = made.repartition(*parts) if parts else made
            made.write.mode("overwrite").partitionBy(*parts).parquet(path)
        return self.spark.read.parquet(path)

    def left_out(self) -> DataFrame:
        """Listeners of the trials that lack what an arm of the study needs, with the reason."""
        parts = [ft.missing_inputs(self.trials, a, hearing=self.hearing, est=self.est) for a in self.study.arms]
        return reduce(DataFrame.unionByName, parts).distinct()

    def rows(self) -> DataFrame:
        """Trials that every arm can score, so that all arms are compared on the same rows."""
        return self._table("trials", lambda: self.trials.join(self.left_out(), "listener_id", "left_anti"))

    def folds(self) -> DataFrame:
        out = self._table("folds", lambda: seeded_folds(self.rows(), self.study.folds))
        sp.assert_no_leak(out.groupBy("seed", "listener_id").agg(F.count_distinct("fold").alias("n")).where("n > 1").select("listener_id"))
        return out

    def matrix(self, arm: str) -> DataFrame:
        """The arm's rows with seed and fold, in folders by both. It is read from the widest arm of the study that has its columns.

        A study whose models are not fitted has no use for other columns than the independence risk.
        """
        fitted = set(self.study.models) - {INDEPENDENCE, PREVALENCE}
        cols = [c for c in ft.arm_columns(arm) if fitted or c == "x_r_phon"]
        wide = max((a for a in self.study.arms if set(ft.arm_columns(arm)) <= set(ft.arm_columns(a))), key=lambda a: len(ft.arm_columns(a)), default=arm)

        def make() -> DataFrame:
            rows = ft.feature_matrix(self.rows(), wide, hearing=self.hearing, est=self.est, keep=("row_id", "listener_id", "misheard", "seed"), cols=None if fitted else ["x_r_phon"])
            return rows.join(self.folds(), ["seed", "listener_id"])

        return self._table(f"matrix/{wide}" if fitted else f"risk/{wide}", make, "seed", "fold").select("row_id", "listener_id", "misheard", *cols, "seed", "fold")

    def log(self) -> DataFrame:
        """What became of each cell that was tried; the last entry of a cell counts."""
        path = f"{self.root}/log"
        return self.spark.read.schema(LOG).option("recursiveFileLookup", "true").parquet(path) if self._exists(path) else self.spark.createDataFrame([], LOG)

    def done(self) -> DataFrame:
        return self.log().where("error is null").dropDuplicates(CELL)

    def _record(self, rows: DataFrame | list[tuple]) -> None:
        rows = rows if isinstance(rows, DataFrame) else self.spark.createDataFrame(rows, LOG)
        # A row a cell, in a folder of its own: cells that end together don't share a committer.
        rows.coalesce(1).write.parquet(f"{self.root}/log/{uuid.uuid4().hex}")

    def _keep(self, predictions: DataFrame, run: tuple[str, str, str], cells: list[tuple[int, int]]) -> None:
        """Store held-out predictions of some cells of one run; a cell that is there already is replaced."""
        arm, model, calibration = run
        path = f"{self.root}/predictions/arm={arm}/model={model}/calibration={calibration}"
        if len(cells) == 1:
            seed, fold = cells[0]
            predictions.drop("seed", "fold").write.mode("overwrite").parquet(f"{path}/seed={seed}/fold={fold}")
        else:
            (predictions.repartition("seed", "fold").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy("seed", "fold").parquet(path))

    def _common(self, run: tuple[str, str, str], cells: list[tuple[int, int]]) -> None:
        """All open cells of a run in common passes: models without a fit, and the logistic model."""
        arm, model, _ = run
        rows, cols = self.matrix(arm), ft.arm_columns(arm)
        mine = F.broadcast(self.spark.createDataFrame(cells, "seed long, fold long"))  # a row a cell
        sizes = rows.groupBy("seed", "fold").agg(F.count("*").alias("n_test"), F.sum("misheard").alias("_pos"))
        all_of = sizes.groupBy("seed").agg(F.sum("n_test").alias("_n"), F.sum("_pos").alias("_all"))
        sizes = durable(sizes.join(all_of, "seed").select("seed", "fold", "n_test", (F.col("_n") - F.col("n_test")).alias("n_train"), (F.col("_all") - F.col("_pos")).alias("_tp")))
        keep = ["row_id", "listener_id", "misheard", "seed", "fold"]
        if model == INDEPENDENCE:
            out = rows.select(*keep, F.round(md.independence(), 9).alias("p"))  # words of equal risk stay tied in any order of summing
        elif model == PREVALENCE:
            rate = sizes.select("seed", "fold", (F.col("_tp") / F.col("n_train")).alias("p"))
            out = rows.select(*keep).join(F.broadcast(rate), ["seed", "fold"])  # a row a cell
        else:
            out = ce.predict_held_out(rows, cols, ce.fit_logistic_cells(rows, cols), keep)
        self._keep(out.join(mine, ["seed", "fold"], "left_semi"), run, cells)
        text = lambda v: F.lit(v).cast("string")
        self._record(sizes.join(mine, ["seed", "fold"], "left_semi").select(
            *[text(v).alias(k) for k, v in zip(CELL, run, strict=False)], F.col("seed").cast("long"), F.col("fold").cast("long"), "n_train", "n_test",
            F.lit(len(cols)).alias("n_features"), text("none").alias("effective"), text(None).alias("reason"), text(None).alias("error")))

    def _single(self, run: tuple[str, str, str], cell: tuple[int, int]) -> None:
        """One cell by its own fit, calibrated on listeners held out of its training rows."""
        arm, model, calibration = run
        seed, fold = cell
        rows, cols = self.matrix(arm).where(F.col("seed") == seed), ft.arm_columns(arm)
        train, test = durable(rows.where(F.col("fold") != fold)), rows.where(F.col("fold") == fold)
        sp.assert_no_leak(sp.shared_listeners(train, test))
        fit = md.fit_calibrated(train, cols, md.MODELS[model], method=calibration, seed=seed)
        self._keep(fit.predict(test, "p").select("row_id", "listener_id", "misheard", "p"), run, [cell])
        self._record([(*run, seed, fold, train.count(), test.count(), len(cols), fit.effective, fit.reason, None)])

    def run(self) -> "Runner":
        """Fit every cell that is not done; a failed cell is logged and the others go on."""
        cells = sorted((int(r.seed), int(r.fold)) for r in self.folds().select("seed", "fold").distinct().collect())  # seeds x folds
        done = {(r.arm, r.model, r.calibration, r.seed, r.fold) for r in self.done().select(*CELL).collect()}  # a row a cell
        single = []
        for run in self.study.runs():
            left = [c for c in cells if (*run, *c) not in done]
            if not left:
                continue
            self.matrix(run[0])
            if run[1] in (INDEPENDENCE, PREVALENCE) or run[1:] == ("logistic", "none"):
                self._common(run, left)
            else:
                single += [(run, c) for c in left]
        failed = []
        with ThreadPoolExecutor(self.study.parallel) as pool:
            jobs = [(run, cell, pool.submit(inheritable_thread_target(self.spark)(self._single), run, cell)) for run, cell in single]
            for run, cell, job in jobs:
                try:
                    job.result()
                except Exception as e:  # noqa: BLE001  whatever stops a cell is kept in the log
                    failed.append((*run, *cell, None, None, None, None, None, str(e)[:500]))
        if failed:
            self._record(failed)
        self.require_complete(cells)
        return self

    def require_complete(self, cells: list[tuple[int, int]]) -> None:
        """Every declared cell has predictions."""
        made = self.done().select(F.concat_ws("/", *CELL).alias("cell"))
        st.require_complete(made, {"cell": ["/".join(map(str, (*run, *c))) for run in self.study.runs() for c in cells]})

    # ---- results, all from stored predictions

    def predictions(self) -> DataFrame:
        path = f"{self.root}/predictions"
        schema = "row_id long, listener_id long, misheard int, p double, arm string, model string, calibration string, seed long, fold long"
        return self.spark.read.schema(schema).option("basePath", path).parquet(path)

    def counts(self) -> DataFrame:
        """Rows and positives per run, listener and score: what all results start from."""
        return self._table(f"counts-{self.done().count()}", lambda: mt.score_counts(self.predictions(), [*RUN, "listener_id"], p="p"))

    def metrics(self) -> DataFrame:
        """Every metric of each run beside its floor and sizes."""
        pooled = durable(self.counts().groupBy(*RUN, "p").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")))
        base = pooled.groupBy(*RUN).agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
        floor = mt.suite_of(base.withColumn("p", F.col("pos") / F.col("n")), RUN).select(*RUN, F.col("prevalence").alias("floor_pr_auc"), F.col("brier").alias("floor_brier"))
        sizes = self.counts().groupBy(*RUN).agg(F.count_distinct("listener_id").alias("n_listeners"))
        fits = self.done().groupBy(*RUN).agg(F.max("n_features").alias("n_features"), F.count("*").alias("n_folds"), F.count_if(F.col("effective") != F.col("calibration")).alias("n_folds_fell_back"))
        return mt.suite_of(pooled, RUN).join(floor, RUN).join(sizes, RUN).join(fits, RUN)

    def summary(self) -> DataFrame:
        """Spread of each metric across seeds."""
        return st.summarise(self.metrics(), ["arm", "model", "calibration"], ["pr_auc", "roc_auc", "brier", "log_loss", "ece", "recall", "precision", "specificity", "f1", "floor_pr_auc"])

    def contrasts(self, pairs=st.DEFAULT_CONTRASTS, *, between: str = "arm", metric: str = "pr_auc", resamples: int = 1_000) -> DataFrame:
        """Paired differences with intervals over listeners, of arms (per seed and model) or of models (per seed and arm)."""
        keys = [k for k in RUN if k != between]
        per = self.counts()
        drawn = mt.draws(self.rows(), resamples)
        if metric == "brier":
            error = F.sum(F.col("pos") * F.pow(F.col("p") - 1, 2) + (F.col("n") - F.col("pos")) * F.pow("p", 2))
            of = lambda rows, by: rows.groupBy(*by).agg((error / F.sum("n")).alias(metric))
            per_listener = per.groupBy(*RUN, "listener_id").agg(error.alias("_e"), F.sum("n").alias("_n"))
            sums = mt.per_resample(mt.resampled_sums(per_listener, drawn, RUN, ["_e", "_n"]), RUN, ["_e", "_n"])
            resampled = sums.select(*RUN, "b", (F.col("_e") / F.col("_n")).alias(metric))
            points = of(per, RUN)
        else:
            points = mt.rank_metrics(per.groupBy(*RUN, "p").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")), RUN)
            resampled = mt.resampled_rank(per, drawn, RUN)
        if between == "arm":
            return st.contrasts(points, resampled, keys, metric, pairs)
        on = lambda rows: rows.withColumnRenamed("arm", "on")  # noqa: E731  the result names what is compared "arm"
        out = st.contrasts(on(points), on(resampled), ["on" if k == "arm" else k for k in keys], metric, pairs, arm=between)
        return out.withColumnsRenamed({"arm": between, "on": "arm"})
