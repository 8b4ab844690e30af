"""Wide rows of numbers as one array column: a pass over a matrix moves one column through Arrow, not one a regressor.

A projection of fifty separate columns is one long generated method, which the JVM does not compile; an
array of them is made in short ones.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 2_000  # rows whose regressors are held at once


def numbers(xs: Iterable[Column | str]) -> Column:
    """``xs`` as an array of doubles; null is NaN."""
    each = [F.col(x) if isinstance(x, str) else x for x in xs]
    return F.array(*[F.coalesce(x.cast("double"), F.lit(float("nan"))) for x in each])


def matrix(arrays: pa.Array, width: int) -> np.ndarray:
    """The rows of a batch's ``numbers``."""
    return arrays.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
