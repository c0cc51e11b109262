"""Tolerance joins: pairs whose values differ by at most ``tol``.

A plain ``abs(a - b) <= tol`` condition makes Spark compare all pairs.  Here the
library side gets one bin of width ``w``, the query side is repeated for the few bins
its window touches, the bin is an equi-join key, and the exact condition is the
residual.  A library row has one bin, so no pair comes twice.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import small_or_none

#: Query rows up to which the query side is broadcast (about 50 bytes a row); beyond
#: it the join shuffles by (keys, bin), and adaptive execution splits hot bins.
BROADCAST_ROWS = 400_000


def bin_width(tol: float) -> float:
    """Wide enough that a window touches two bins at most."""
    return max(2 * tol, 0.05)


def band_join(
    query: DataFrame,
    library: DataFrame,
    tol: float,
    left: str,
    right: str,
    keys: Sequence[tuple[str, str]] = (),
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Inner join on ``abs(left - right) <= tol`` (inclusive) and equal ``keys``.

    ``left``/``right`` and the keys must have different names on the two sides.  Null and
    NaN values match nothing.  The size of the query side is measured before it is
    broadcast.
    """
    w = bin_width(tol)
    low, high = F.floor((F.col(left) - tol) / w), F.floor((F.col(left) + tol) / w)
    ok = lambda c: F.col(c).isNotNull() & ~F.isnan(c)
    q = query.filter(ok(left)).withColumn("__bin", F.explode(F.sequence(low, high)))
    lib = library.filter(ok(right)).withColumn("__lib_bin", F.floor(F.col(right) / w))
    if small_or_none(query, broadcast_rows) is not None:
        q = F.broadcast(q)
    cond = F.col("__bin") == F.col("__lib_bin")
    for a, b in keys:
        cond = cond & (F.col(a) == F.col(b))
    cond = cond & (F.abs(F.col(left) - F.col(right)) <= tol)
    return lib.join(q, cond).drop("__bin", "__lib_bin")


def spelt_out(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(k, i)`` for every ``i`` of ``range(low[k], high[k])``, in order of ``k``."""
    n = np.maximum(high - low, 0)
    k = np.repeat(np.arange(len(n)), n)
    return k, np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
