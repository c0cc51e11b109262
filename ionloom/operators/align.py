"""Alignment of two peak lists within one row, without a shuffle.

Peak ``b`` goes to the first ``a`` not below ``b - tol`` and matches it if that is not above
``b + tol``; several ``b`` may go to one ``a``.  Unmatched peaks stay, with 0 on the other side.
The order (a, b) matters.  Lists must be sorted by m/z.  A null list gives null.

Partners are found by binary search over the Arrow buffers of whole batches, so a pair costs
|a| + |b| log |a| steps; partners are positions, so peaks of equal m/z stay apart.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ALIGNED = "array<struct<mz: double, p: double, q: double>>"
_ALIGNED_MZ = "array<struct<mz_a: double, p: double, mz_b: double, q: double>>"


class _Lists:
    """Peak lists of a batch as flat arrays, with each peak's row."""

    def __init__(self, lists: pa.ListArray) -> None:
        sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        self.start = np.append(0, np.cumsum(sizes))
        self.row = np.repeat(np.arange(len(sizes)), sizes)
        flat = lists.flatten()
        self.mz, self.intensity = (flat.field(i).to_numpy(zero_copy_only=False).astype(float) for i in (0, 1))


def _partners(a: _Lists, b: _Lists, tol_da: float | None, tol_ppm: float | None, shift: np.ndarray | None = None) -> np.ndarray:
    """Position of the peak of ``a`` that each peak of ``b``, moved by its row's shift, goes to, or -1."""
    to = np.full(len(b.mz), -1, np.int64)
    share = 0.0 if tol_da is not None else float(tol_ppm) * 1e-6
    mz = b.mz if shift is None else b.mz + shift[b.row]
    high = a.mz * (1 + share)
    for row in range(len(a.start) - 1):
        i, j, k, n = a.start[row], a.start[row + 1], b.start[row], b.start[row + 1]
        if i == j or k == n:
            continue
        y = mz[k:n]
        at = i + np.searchsorted(high[i:j], y if tol_da is None else y - tol_da)
        last = np.minimum(at, j - 1)
        width = tol_da if tol_da is not None else a.mz[last] * share
        to[k:n] = np.where((at < j) & (a.mz[last] <= y + width), at, -1)
    return to


def _list_of(row: np.ndarray, n_rows: int, null: np.ndarray, order: np.ndarray, **fields: np.ndarray) -> pa.Array:
    """Rows' lists of structs from flat fields in the given order."""
    sizes = np.bincount(row, minlength=n_rows)
    values = pa.StructArray.from_arrays([pa.array(x[order]) for x in fields.values()], list(fields))
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), values, mask=pa.array(null))


def _null(a: pa.Array, b: pa.Array) -> np.ndarray:
    return a.is_null().to_numpy(zero_copy_only=False) | b.is_null().to_numpy(zero_copy_only=False)


def _combine(x: pa.Array, y: pa.Array, a: _Lists, b: _Lists, to: np.ndarray) -> pa.Array:
    """Rows of ``a`` with the sums of what goes there, and of the peaks of ``b`` that go nowhere, by m/z."""
    met, free = to >= 0, to < 0
    q = np.bincount(to[met], weights=b.intensity[met], minlength=len(a.mz))
    null = _null(x, y)
    row = np.append(a.row, b.row[free])
    mz = np.append(a.mz, b.mz[free])
    p, q = np.append(a.intensity, np.zeros(free.sum())), np.append(q, b.intensity[free])
    keep = ~null[row]
    row, mz, p, q = row[keep], mz[keep], p[keep], q[keep]
    return _list_of(row, len(x), null, np.lexsort((q, p, mz, row)), mz=mz, p=p, q=q)


def _udf(run: Callable[..., pa.Array], kind: str):
    return F.arrow_udf(run, kind)


def align(a: Column, b: Column, tol_da: float | None = 0.05, tol_ppm: float | None = None) -> Column:
    """``array<struct<mz, p, q>>``: intensities of a and the sum of b's at each m/z."""

    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        left, right = _Lists(x), _Lists(y)
        return _combine(x, y, left, right, _partners(left, right, tol_da, tol_ppm))

    return _udf(run, _ALIGNED)(a, b)


def align_with_mz(a: Column, b: Column, tol_da: float | None = 0.05, tol_ppm: float | None = None) -> Column:
    """``array<struct<mz_a, p, mz_b, q>>``: as :func:`align`, with b's intensity-weighted m/z; a's peaks come first."""

    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        left, right = _Lists(x), _Lists(y)
        to = _partners(left, right, tol_da, tol_ppm)
        met, free = to >= 0, to < 0
        q = np.bincount(to[met], weights=right.intensity[met], minlength=len(left.mz))
        m = np.bincount(to[met], weights=right.intensity[met] * right.mz[met], minlength=len(left.mz))
        none = np.zeros(free.sum())
        mz_b = np.where(q > 0, m / np.where(q > 0, q, 1.0), 0.0)
        null = _null(x, y)
        row = np.append(left.row, right.row[free])
        cols = {
            "mz_a": np.append(left.mz, none), "p": np.append(left.intensity, none),
            "mz_b": np.append(mz_b, right.mz[free]), "q": np.append(q, right.intensity[free]),
        }
        keep = ~null[row]
        row = row[keep]
        return _list_of(row, len(x), null, np.argsort(row, kind="stable"), **{k: v[keep] for k, v in cols.items()})

    return _udf(run, _ALIGNED_MZ)(a, b)


def merge(a: Column, b: Column, tol_da: float | None = 0.05, tol_ppm: float | None = None) -> Column:
    """One peak list with the intensities of both added up."""
    return F.transform(align(a, b, tol_da, tol_ppm), lambda r: F.struct(r.mz.alias("mz"), (r.p + r.q).alias("intensity")))


def align_strongest(a: Column, b: Column, tol_da: float | None = 0.05, tol_ppm: float | None = None) -> Column:
    """As :func:`align`, but only the strongest b that goes to an a counts (ties: the smaller m/z); the others stay apart."""

    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        left, right = _Lists(x), _Lists(y)
        to = _partners(left, right, tol_da, tol_ppm)
        order = np.lexsort((np.arange(len(to)), right.mz, -right.intensity, to))
        first = np.append(True, to[order][1:] != to[order][:-1]) if len(to) else np.zeros(0, bool)
        best = np.zeros(len(to), bool)
        best[order[first]] = True
        return _combine(x, y, left, right, np.where(best, to, -1))

    return _udf(run, _ALIGNED)(a, b)


def matched_peaks(a: Column, b: Column, tol_da: float | None = 0.05, tol_ppm: float | None = None) -> Column:
    """``array<struct<mz_a, p, mz_b, q, matched>>``: both lists side by side, as for a mirrored drawing."""
    rows = align_with_mz(a, b, tol_da, tol_ppm)
    fields = lambda r: [r[c].alias(c) for c in ("mz_a", "p", "mz_b", "q")]
    return F.transform(rows, lambda r: F.struct(*fields(r), ((r.p > 0) & (r.q > 0)).alias("matched")))


def greedy_cosine(a: Column, b: Column, tol: float = 0.02, mz_power: float = 0.0, intensity_power: float = 1.0) -> Column:
    """``struct<score, matches>``: cosine of peaks paired one to one, the greatest products first.

    Any peaks within ``tol`` may pair (ties: the earlier peaks); a peak is used once.  Peaks weigh
    m/z**mz_power * intensity**intensity_power; a list without weight has score 0.
    """

    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        left, right = _Lists(x), _Lists(y)
        weigh = lambda s: s.mz**mz_power * s.intensity**intensity_power
        u, v = weigh(left), weigh(right)
        n = len(x)
        length = np.sqrt(np.bincount(left.row, weights=u * u, minlength=n) * np.bincount(right.row, weights=v * v, minlength=n))
        score, matches = np.zeros(n), np.zeros(n, np.int64)
        for row in range(n):
            i, j, k, m = left.start[row], left.start[row + 1], right.start[row], right.start[row + 1]
            low = k + np.searchsorted(right.mz[k:m], left.mz[i:j] - tol)
            high = k + np.searchsorted(right.mz[k:m], left.mz[i:j] + tol, side="right")
            size = high - low
            p = np.repeat(np.arange(i, j), size)
            q = np.repeat(low, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            used_p, used_q = set(), set()
            for e in np.lexsort((q, p, -u[p] * v[q])).tolist():
                if p[e] not in used_p and q[e] not in used_q:
                    used_p.add(p[e])
                    used_q.add(q[e])
                    score[row] += u[p[e]] * v[q[e]]
            matches[row] = len(used_p)
        null = pa.array(_null(x, y))
        score = np.divide(score, length, out=np.zeros(n), where=length > 0)
        return pa.StructArray.from_arrays([pa.array(score), pa.array(matches)], ["score", "matches"], mask=null)

    return _udf(run, "struct<score: double, matches: bigint>")(a, b)


def pair_peaks(pairs: DataFrame, spectra: DataFrame, left: str = "query_id", right: str = "spec_id") -> DataFrame:
    """Pairs with the peak lists ``a`` and ``b`` and precursors ``a_mz``, ``b_mz`` of both ends."""
    a = spectra.select(F.col("spec_id").alias(left), F.col("peaks").alias("a"), F.col("precursor_mz").alias("a_mz"))
    b = spectra.select(F.col("spec_id").alias(right), F.col("peaks").alias("b"), F.col("precursor_mz").alias("b_mz"))
    return pairs.select(left, right).distinct().join(a, left).join(b, right)


def hybrid_pair(a: Column, b: Column, shift: Column, tol_da: float = 0.05) -> Column:
    """Alignment in which a b peak matches directly or after moving by ``shift`` (the
    difference of the precursors); where both match, the stronger counterpart wins."""

    def run(x: pa.Array, y: pa.Array, by: pa.Array) -> pa.Array:
        left, right = _Lists(x), _Lists(y)
        move = by.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
        direct, moved = _partners(left, right, tol_da, None), _partners(left, right, tol_da, None, move)
        power = lambda to: np.where(to >= 0, np.append(left.intensity, -1.0)[to], -1.0)
        return _combine(x, y, left, right, np.where(power(moved) > power(direct), moved, direct))

    return _udf(run, _ALIGNED)(a, b, shift)
