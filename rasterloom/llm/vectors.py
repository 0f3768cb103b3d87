"""Vectors that take part in a search or a comparison."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VECTOR_ROWS = 4096  # rows of a block, on average


def is_usable(embedding: Column) -> Column:
    """Whether a vector is not null, not zero and holds only finite numbers."""
    e = embedding.cast("array<double>")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    return F.coalesce(e.isNotNull() & fine, F.lit(False))


def usable(vectors: DataFrame, embedding: str = "embedding") -> DataFrame:
    """(vec_id, dim, e) of the usable vectors that have an id; e keeps its type, so floats travel as floats."""
    kept = vectors.filter(F.col("vec_id").isNotNull() & is_usable(F.col(embedding)))
    return kept.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.size(embedding).alias("dim"), F.col(embedding).alias("e"))


def tamed(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows scaled by a power of two so that their largest component is between 1/2 and 1, and that power's exponents.

    Squares of what is scaled neither overflow nor vanish, and its directions are those of ``x`` to the last bit.
    """
    power = np.frexp(np.abs(x).max(1, initial=0.0))[1]
    half = power // 2  # in two steps, since the power itself may be out of range
    return np.ldexp(np.ldexp(x, -half[:, None]), (half - power)[:, None]), power
