"""Cleaning spectra: filters, centroiding, isotope removal, normalisation, checks.

Filters are column expressions.  Merging near peaks is sequential within a spectrum
and runs on Arrow batches; spectra without near peaks, nearly all, are passed
through without a Python loop.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spectral as S
from ..functions.chem import ISOTOPE_STEP, isotope_ratios

#: Status codes of :func:`validate`.
OK, HEAVY, NEGATIVE, EMPTY, EMPTY_AFTER_CLEAN = range(5)
MAX_PRECURSOR = 2000.0
#: Fragments closer to the precursor than this are the precursor itself.
PRECURSOR_GAP = 1.6


def merge_gaps(mz: np.ndarray, intensity: np.ndarray, tol: float, weighted: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Chains of peaks less than ``tol`` apart become one (weighted or plain mean m/z, summed intensity)."""
    first = np.append(True, np.diff(mz) >= tol) if len(mz) else np.zeros(0, bool)
    at = np.flatnonzero(first)
    if len(at) == len(mz):
        return mz, intensity
    total = np.add.reduceat(intensity, at)
    size = np.diff(np.append(at, len(mz)))
    mean = np.add.reduceat(mz * intensity, at) / total if weighted else np.add.reduceat(mz, at) / size
    return np.where(size == 1, mz[at], mean), total


def centroid(mz: np.ndarray, intensity: np.ndarray, tol_da: float | None, tol_ppm: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Greedy centroiding: from the strongest peak on (ties: smaller m/z), each remaining
    peak absorbs all remaining ones within the tolerance; repeated until no two
    neighbours are nearer than it.  A tolerance in Da takes precedence."""
    while len(mz) > 1:
        width = np.full(len(mz), tol_da) if tol_da is not None else mz * tol_ppm * 1e-6
        if np.all(np.diff(mz) >= width[1:]):
            break
        free = intensity > 0
        new_mz, new_i = [], []
        for k in np.lexsort((mz, -intensity)):
            if not free[k]:
                continue
            a, b = np.searchsorted(mz, mz[k] - width[k]), np.searchsorted(mz, mz[k] + width[k], side="right")
            near = np.flatnonzero(free[a:b]) + a
            total = intensity[near].sum()
            new_mz.append((mz[near] * intensity[near]).sum() / total)
            new_i.append(total)
            free[near] = False
        order = np.argsort(new_mz, kind="stable")
        done = len(order) == len(mz)
        mz, intensity = np.array(new_mz)[order], np.array(new_i)[order]
        if done:
            break
    return mz, intensity


def remove_isotopes(mz: np.ndarray, intensity: np.ndarray, tol_da: float | None, tol_ppm: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Isotope peaks are added to their base peak.

    For each peak in order of m/z the peaks 1 to 4 isotope steps above are looked for;
    the series ends at the first one missing or stronger than its allowed ratio.
    """
    intensity = intensity.copy()
    gone = np.zeros(len(mz), bool)
    for k in range(len(mz)):
        if gone[k]:
            continue
        base = intensity[k]
        allowed = isotope_ratios(mz[k])
        width = tol_da if tol_da is not None else mz[k] * tol_ppm * 1e-6
        for step in range(1, 5):
            want = mz[k] + step * ISOTOPE_STEP
            a, b = np.searchsorted(mz, want - width), np.searchsorted(mz, want + width, side="right")
            near = [j for j in range(a, b) if not gone[j] and j != k]
            if not near or any(intensity[j] > base * allowed[step - 1] for j in near):
                break
            for j in near:
                gone[j] = True
                intensity[k] += intensity[j]
    return mz[~gone], intensity[~gone]


def _reshape(mode: str, tol_da: float | None, tol_ppm: float | None, isotopes: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(batch.num_columns - 1)
            offsets = col.offsets.to_numpy()
            flat = col.values
            mz, inten = flat.field("mz").to_numpy(zero_copy_only=False), flat.field("intensity").to_numpy(zero_copy_only=False)
            base = offsets[0]
            mz, inten, offsets = mz[base : offsets[-1]], inten[base : offsets[-1]], offsets - base
            size = np.diff(offsets)
            out_mz, out_i, sizes = [], [], size.copy()
            # spectra with two near neighbours, or where isotopes may be
            row = np.repeat(np.arange(len(size)), size)
            gap = np.append(np.inf, np.diff(mz)) if len(mz) else np.zeros(0)
            gap[offsets[:-1][size > 0]] = np.inf
            width = np.full(len(mz), tol_da) if tol_da is not None else mz * (tol_ppm or 0.0) * 1e-6
            touched = np.zeros(len(size), bool)
            touched[np.unique(row[gap < width])] = True
            if isotopes:
                touched |= size > 1
            last = 0
            for k in np.flatnonzero(touched):
                a, b = offsets[k], offsets[k + 1]
                out_mz.append(mz[last:a])
                out_i.append(inten[last:a])
                m, i = mz[a:b], inten[a:b]
                m, i = centroid(m, i, tol_da, tol_ppm) if mode == "greedy" else merge_gaps(m, i, tol_da, mode == "gap")
                if isotopes:
                    m, i = remove_isotopes(m, i, tol_da, tol_ppm)
                out_mz.append(m)
                out_i.append(i)
                sizes[k] = len(m)
                last = b
            out_mz.append(mz[last:])
            out_i.append(inten[last:])
            values = pa.StructArray.from_arrays([pa.array(np.concatenate(out_mz)), pa.array(np.concatenate(out_i))], ["mz", "intensity"])
            peaks = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), values)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], peaks], batch.schema.names)

    return run


PEAKS = "array<struct<mz double, intensity double>>"


def merge_near_peaks(df: DataFrame, tol_da: float | None = 0.05, tol_ppm: float | None = None, mode: str = "greedy", isotopes: bool = False) -> DataFrame:
    """``df`` with near peaks of its sorted ``peaks`` merged; ``peaks`` must not be null.

    ``mode`` is ``greedy`` (centroiding), or ``gap`` or ``plain`` (chains of neighbours, with weighted or plain mean m/z).
    """
    if mode not in ("greedy", "gap", "plain"):
        raise ValueError(f"unknown mode {mode}")
    if tol_da is None and (tol_ppm is None or mode != "greedy"):
        raise ValueError("a tolerance is needed, in Da or, for greedy merging, in ppm")
    rest = [c for c in df.columns if c != "peaks"]
    schema = ", ".join(f"`{c}` {t}" for c, t in df.select(*rest).dtypes) + f", peaks {PEAKS}"
    return df.select(*rest, "peaks").mapInArrow(_reshape(mode, tol_da, tol_ppm, isotopes), schema)


def clean_spectra(
    spectra: DataFrame,
    min_mz: float | None = None,
    max_mz: Column | float | None = None,
    noise: float = 0.01,
    max_peaks: int | None = None,
    tol_da: float | None = 0.05,
    tol_ppm: float | None = None,
    mode: str = "greedy",
    remove_isotope: bool = True,
    normalize: bool = True,
    inclusive: bool = True,
) -> DataFrame:
    """The cleaning chain on a ``peaks`` column; other columns pass through.

    Drop peaks without m/z or intensity (null, NaN or not positive), keep the m/z range,
    sort, merge near peaks, remove isotopes, drop peaks below ``noise`` of the strongest,
    keep the strongest ``max_peaks``, scale to sum one.  A null list counts as empty; an
    empty spectrum stays, with an empty list.
    """
    empty = F.array().cast(PEAKS)
    p = F.filter(F.coalesce("peaks", empty), lambda x: ~F.isnan(x.mz) & ~F.isnan(x.intensity) & (x.mz > 0) & (x.intensity > 0))
    p = S.within(p, min_mz, max_mz, inclusive) if min_mz is not None or max_mz is not None else p
    df = spectra.withColumn("peaks", F.coalesce(S.sort_by_mz(p), empty).cast(PEAKS))
    df = merge_near_peaks(df, tol_da, tol_ppm, mode, remove_isotope)
    p = S.denoise(F.col("peaks"), noise) if noise else F.col("peaks")
    if max_peaks:
        p = S.strongest(p, max_peaks)
    df = df.withColumn("peaks", p)
    return df.withColumn("peaks", F.coalesce(S.normalize(F.col("peaks")), empty)) if normalize else df


def validate(spectra: DataFrame, **clean_options) -> DataFrame:
    """Cleaned spectra with ``status``: 0 good, 1 precursor of 2000 or more, 2 negative,
    3 no peaks, 4 no peaks after cleaning.  Null and NaN precursors count as negative."""
    pm = F.col("precursor_mz")
    first = (
        F.when(pm.isNull() | F.isnan(pm) | (pm < 0), NEGATIVE).when(pm >= MAX_PRECURSOR, HEAVY).when(F.coalesce(F.size("peaks"), F.lit(0)) < 1, EMPTY)
    )
    df = clean_spectra(spectra.withColumn("status", first), max_mz=pm - PRECURSOR_GAP, **clean_options)
    return df.withColumn("status", F.coalesce("status", F.when(F.size("peaks") == 0, EMPTY_AFTER_CLEAN).otherwise(OK)))


def standardize(df: DataFrame, targets: dict[str, tuple[list[str], object, str]], source: str = "metadata", keep: bool = True) -> DataFrame:
    """Columns from aliases in a ``map<string, array<string>>``: the first alias that casts.

    ``targets`` maps a new column to (aliases, default, type); ``keep=False`` drops the
    aliases from the map.
    """
    out = df
    for name, (aliases, default, kind) in targets.items():
        tries = [F.try_element_at(F.try_element_at(F.col(source), F.lit(a)), F.lit(1)).try_cast(kind) for a in aliases]
        out = out.withColumn(name, F.coalesce(*tries, F.lit(default).cast(kind)))
    if not keep:
        used = [a for aliases, _, _ in targets.values() for a in aliases]
        out = out.withColumn(source, F.map_filter(source, lambda k, _: ~k.isin(used)))
    return out


def has_all(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows in which all required columns are present."""
    return df.dropna(subset=cols)
