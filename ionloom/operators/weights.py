"""Exploded, weighted peak tables: the common input of all searches.

A peak table has ``spec_id, charge, precursor_mz, peak_id, mz, nl_mz, w``, where ``w`` is
the intensity weight of the scoring strategy.
"""

from __future__ import annotations

from dataclasses import dataclass
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spectral as S


@dataclass(frozen=True)
class Score:
    """A scoring strategy: how a cleaned peak list is weighted and what a match adds.

    ``arrays`` is ``term`` for NumPy arrays, where there is one; hybrid search is faster with it.
    """

    name: str
    weigh: Callable[[Column], Column]
    term: Callable[[Column, Column], Column]
    arrays: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None


def entropy_weigh(peaks: Column) -> Column:
    """Intensities that sum to one, raised to 0.25 + 0.25 S where the entropy S is below 3."""

    def weigh(n: Column) -> Column:
        raised = lambda s: S.normalize(S.with_intensity(n, lambda i: F.pow(i, S.WEIGHT_BASE + S.WEIGHT_SLOPE * s)))
        return S.let(S.entropy(n), lambda s: F.when(s < S.ENTROPY_CUT, raised(s)).otherwise(n))

    return S.let(S.normalize(peaks), weigh)


def _halved(peaks: Column) -> Column:
    return S.with_intensity(peaks, lambda i: i / 2)


def _entropy_term(x: Column, y: Column) -> Column:
    return (x + y) * F.log2(x + y) - x * F.log2(x) - y * F.log2(y)


def _entropy_arrays(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x + y) * np.log2(x + y) - x * np.log2(x) - y * np.log2(y)


#: Sum over matches = 1 - Jensen-Shannon-like divergence of the weighted spectra.
ENTROPY = Score("entropy", lambda p: _halved(entropy_weigh(p)), _entropy_term, _entropy_arrays)
UNWEIGHTED_ENTROPY = Score("unweighted_entropy", lambda p: _halved(S.normalize(p)), _entropy_term, _entropy_arrays)


def cosine(power: float = 0.5) -> Score:
    return Score("cosine" if power == 0.5 else f"cosine_{power}", lambda p: S.power(p, power), lambda x, y: x * y, lambda x, y: x * y)


COSINE = cosine()


def peak_table(spectra: DataFrame, score: Score = ENTROPY) -> DataFrame:
    """One row per weighted peak of cleaned spectra (``spec_id, charge, precursor_mz, peaks``).

    Spectra without any intensity have no rows.  ``peak_id`` is the position in the
    list from 1; (spec_id, peak_id) identifies a peak.
    """
    weighed = spectra.select("spec_id", "charge", "precursor_mz", score.weigh(F.col("peaks")).alias("p"))
    rows = weighed.select("spec_id", "charge", "precursor_mz", F.posexplode("p").alias("n", "p"))
    return rows.select(
        "spec_id", "charge", "precursor_mz", (F.col("n") + 1).alias("peak_id"), F.col("p.mz").alias("mz"),
        (F.col("precursor_mz") - F.col("p.mz")).alias("nl_mz"), F.col("p.intensity").alias("w"),
    ).filter(F.col("w") > 0)
