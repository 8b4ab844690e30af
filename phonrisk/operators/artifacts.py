"""Saved risk models with the contract they were fitted for, and the fit over several seeds."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict

from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.regression import IsotonicRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phonrisk.operators import models as md
from phonrisk.operators import quality as ql

#: Contract of models that are applied to recorded media, where acoustic context is known.
MEDIA_CONTRACT = "media-pipeline-v1"


def fit_over_seeds(matrix: DataFrame, cols: list[str], fit: Callable, seeds: list[int] | None = None, **options):
    """One model of the rows of several seeds; a listener of two seeds counts as two listeners."""
    rows = matrix if seeds is None else matrix.where(F.col("seed").isin(seeds))
    return fit(rows.withColumn("listener_id", F.concat_ws("/", "seed", "listener_id")), cols, **options)


def _describe(model, folder: str) -> dict:  # noqa: ANN001
    """Parameters of a model as JSON; Spark ML parts are written below ``folder``."""
    if isinstance(model, md.Linear):
        return {"kind": "linear", **asdict(model)}
    if isinstance(model, md.Residual):
        return {"kind": "residual", "base": _describe(model.base, f"{folder}/base"), "personal": _describe(model.personal, f"{folder}/personal")}
    if isinstance(model, md.Additive):
        return {"kind": "additive", **asdict(model)}
    if isinstance(model, md.Trees):
        model.model.write().overwrite().save(f"{folder}/model")
        return {"kind": "trees", "folder": folder, "scaling": asdict(model.scaling)}
    if isinstance(model, md.Calibrated):
        if model.steps is not None:
            model.steps.write().overwrite().save(f"{folder}/steps")
        return {"kind": "calibrated", "folder": folder, "base": _describe(model.base, f"{folder}/base"), "method": model.method, "effective": model.effective,
                "reason": model.reason, "platt": model.platt, "has_steps": model.steps is not None}
    raise TypeError(f"cannot save a {type(model).__name__}")


def _restore(body: dict, root: str):
    at = f"{root}/{body.get('folder', '')}"
    kind = body["kind"]
    if kind == "linear":
        return md.Linear(md.Scaling(**body["scaling"]), body["coef"], body["intercept"], body["name"], body["centre"], body["spread"], body["meta"])
    if kind == "residual":
        return md.Residual(_restore(body["base"], root), _restore(body["personal"], root))
    if kind == "additive":
        ranges = {k: tuple(v) for k, v in body["ranges"].items()}
        return md.Additive(body["medians"], ranges, [tuple(p) for p in body["pairs"]], body["coef"], body["intercept"])
    if kind == "trees":
        return md.Trees(md.Scaling(**body["scaling"]), GBTClassificationModel.load(f"{at}/model"))
    steps = IsotonicRegressionModel.load(f"{at}/steps") if body["has_steps"] else None
    return md.Calibrated(_restore(body["base"], root), body["method"], body["effective"], body["reason"], tuple(body["platt"]) if body["platt"] else None, steps)


def save_model(model, spark: SparkSession, path: str, *, name: str, cols: list[str], contract: str, arm: str, seeds: list[int]) -> None:  # noqa: ANN001
    """Write any of ``MODELS``, calibrated or not, with its contract, schema hash and seeds.

    Parts are named without the root, so that an artifact can be moved. The description is written last: an
    artifact without it is not complete and cannot be loaded.
    """
    body = _describe(model, f"{path}/parts")
    text = json.dumps({"model": body, "name": name, "contract": contract, "arm": arm, "seeds": seeds, "columns": cols, "schema_hash": ql.schema_hash(cols, contract)})
    spark.createDataFrame([(text.replace(f"{path}/", ""),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/description")


def load_model(spark: SparkSession, path: str, *, cols: list[str] | None = None, contract: str | None = None):
    """(model, description); refused where columns or contract differ from those the model was fitted for."""
    body = json.loads(spark.read.text(f"{path}/description").first().value)
    if cols is not None and body["schema_hash"] != ql.schema_hash(cols, body["contract"]):
        raise ValueError("feature schema differs from the one the model was fitted on")
    if contract is not None and body["contract"] != contract:
        raise ValueError(f"the model was fitted for {body['contract']}, not for {contract}")
    return _restore(body["model"], path), {k: v for k, v in body.items() if k != "model"}
