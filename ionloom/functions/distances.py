"""Distances of aligned spectra as column expressions over ``array<struct<mz, p, q>>``.

Every method is one or two folds over the aligned list of its own row: no shuffle, any
number of methods in one projection.  ``RANGES`` gives the range that
:func:`normalized` maps to [0, 1]; methods without an entry have [0, 1].
"""

from __future__ import annotations

from collections.abc import Callable
from math import log, pi, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spectral import let

INF = float("inf")


def _div(a: Column, b: Column, empty: float | None = 0.0) -> Column:
    """a / b, or ``empty`` where b is 0."""
    return F.when(b != 0, a / F.nullif(b, F.lit(0.0))).otherwise(F.lit(empty))


class Aligned:
    """Folds over an aligned list."""

    def __init__(self, rows: Column) -> None:
        self.rows = rows

    def sum(self, f: Callable[[Column, Column], Column]) -> Column:
        return F.aggregate(self.rows, F.lit(0.0), lambda s, r: s + f(r.p, r.q))

    def max(self, f: Callable[[Column, Column], Column]) -> Column:
        return F.aggregate(self.rows, F.lit(0.0), lambda s, r: F.greatest(s, f(r.p, r.q)))

    def map(self, p: Callable[[Column], Column], q: Callable[[Column], Column]) -> Aligned:
        return Aligned(F.transform(self.rows, lambda r: F.struct(r.mz.alias("mz"), p(r.p).alias("p"), q(r.q).alias("q"))))

    def where(self, f: Callable[[Column, Column], Column]) -> Aligned:
        return Aligned(F.filter(self.rows, lambda r: f(r.p, r.q)))

    @property
    def n(self) -> Column:
        """Peaks of the query."""
        return self.sum(lambda p, q: F.when(p > 0, 1.0).otherwise(0.0))

    @property
    def rows_n(self) -> Column:
        return F.size(self.rows).cast("double")

    def with_means(self, body: Callable[[Column, Column], Column]) -> Column:
        """``body`` of the mean of both sides over all rows."""
        means = F.struct(_div(self.sum(lambda p, q: p), self.rows_n).alias("p"), _div(self.sum(lambda p, q: q), self.rows_n).alias("q"))
        return let(means, lambda m: body(m.p, m.q))


def _xlogx(x: Column) -> Column:
    return F.when(x > 0, x * F.ln(x)).otherwise(0.0)


def _entropy(a: Aligned, f) -> Column:
    """Entropy of f over the rows, renormalised to sum one."""
    total = a.sum(f)
    return F.when(total > 0, F.ln(F.greatest(total, F.lit(1e-300))) - _div(a.sum(lambda p, q: _xlogx(f(p, q))), total)).otherwise(0.0)


def _pow(x: Column, e: Column) -> Column:
    return F.when(x > 0, F.pow(x, e)).otherwise(0.0)


def _with_weights(a: Aligned, body: Callable[[Aligned], Column]) -> Column:
    """Both sides raised to 0.25 + 0.25 S where their entropy S is below 3, and rescaled."""
    exponent = lambda f: let(_entropy(a, f), lambda s: F.when(s < 3, 0.25 + 0.25 * s).otherwise(1.0))

    def raised(e: Column) -> Column:
        return a.map(lambda p: _pow(p, e.p), lambda q: _pow(q, e.q)).rows

    def scaled(rows: Column) -> Column:
        up = Aligned(rows)
        totals = F.struct(up.sum(lambda p, q: p).alias("p"), up.sum(lambda p, q: q).alias("q"))
        return let(totals, lambda t: up.map(lambda p: _div(p, t.p), lambda q: _div(q, t.q)).rows)

    exponents = F.struct(exponent(lambda p, q: p).alias("p"), exponent(lambda p, q: q).alias("q"))
    return let(let(let(exponents, raised), scaled), lambda rows: body(Aligned(rows)))


def _unweighted_entropy(a: Aligned) -> Column:
    return 2 * _entropy(a, lambda p, q: p + q) - _entropy(a, lambda p, q: p) - _entropy(a, lambda p, q: q)


def _root(a: Column) -> Column:
    return F.sqrt(F.greatest(a, F.lit(0.0)))


def _abs(p: Column, q: Column) -> Column:
    return F.abs(p - q)


def _square(p: Column, q: Column) -> Column:
    return (p - q) * (p - q)


def _dot(a: Aligned) -> Column:
    pq, pp, qq = a.sum(lambda p, q: p * q), a.sum(lambda p, q: p * p), a.sum(lambda p, q: q * q)
    return F.when((pp > 0) & (qq > 0), 1 - _root(_div(pq * pq, pp * qq))).otherwise(1.0)


def _baroni(a: Aligned) -> Column:
    tops = F.greatest(a.max(lambda p, q: p), a.max(lambda p, q: q))
    low, high = a.sum(F.least), a.sum(F.greatest)
    d = let(tops, lambda t: _root(low * a.sum(lambda p, q: t - F.greatest(p, q))))
    return 1 - _div(low + d, high + d)


def _hellinger(a: Aligned) -> Column:
    return a.with_means(lambda mp, mq: _root(2 * a.sum(lambda p, q: F.pow(_root(_div(p, mp)) - _root(_div(q, mq)), F.lit(2.0)))))


def _whittaker(a: Aligned) -> Column:
    return a.with_means(lambda mp, mq: 0.5 * a.sum(lambda p, q: F.abs(_div(p, mp) - _div(q, mq))))


def _symmetric_chi(a: Aligned) -> Column:
    s = lambda mp, mq: a.sum(lambda p, q: _div(F.pow(p * mq - q * mp, F.lit(2.0)), p + q))
    return a.with_means(lambda mp, mq: _root(_div((mp + mq) * s(mp, mq), a.n * (mp + mq) * (mp + mq))))


def _pearson(a: Aligned) -> Column:
    def body(mp: Column, mq: Column) -> Column:
        cov = a.sum(lambda p, q: (p - mp) * (q - mq))
        var = a.sum(lambda p, q: (p - mp) * (p - mp)) * a.sum(lambda p, q: (q - mq) * (q - mq))
        return -_div(cov, _root(var))

    return a.with_means(body)


def _penrose_shape(a: Aligned) -> Column:
    return a.with_means(lambda mp, mq: _root(a.sum(lambda p, q: F.pow((p - mp) - (q - mq), F.lit(2.0)))))


def _spectral_contrast(a: Aligned) -> Column:
    pq, pp, qq = a.sum(lambda p, q: p * q), a.sum(lambda p, q: p * p), a.sum(lambda p, q: q * q)
    return F.when((pp > 0) & (qq > 0), 1 - _div(pq, _root(pp * qq))).otherwise(1.0)


#: Methods on ``array<struct<mz, p, q>>``.
METHODS: dict[str, Callable[[Aligned], Column]] = {
    "unweighted_entropy": _unweighted_entropy,
    "entropy": lambda a: _with_weights(a, _unweighted_entropy),
    "euclidean": lambda a: _root(a.sum(_square)),
    "manhattan": lambda a: a.sum(_abs),
    "chebyshev": lambda a: a.max(_abs),
    "squared_euclidean": lambda a: a.sum(_square),
    "fidelity": lambda a: 1 - a.sum(lambda p, q: _root(p * q)),
    "matusita": lambda a: _root(a.sum(lambda p, q: _square(_root(p), _root(q)))),
    "squared_chord": lambda a: a.sum(lambda p, q: _square(_root(p), _root(q))),
    "bhattacharya_1": lambda a: F.pow(F.acos(F.least(F.lit(1.0), a.sum(lambda p, q: _root(p * q)))), F.lit(2.0)),
    "bhattacharya_2": lambda a: F.when(a.sum(lambda p, q: _root(p * q)) > 0, -F.ln(F.greatest(a.sum(lambda p, q: _root(p * q)), F.lit(1e-300)))).otherwise(INF),
    "harmonic_mean": lambda a: 1 - 2 * a.sum(lambda p, q: _div(p * q, p + q)),
    "probabilistic_symmetric_chi_squared": lambda a: 0.5 * a.sum(lambda p, q: _div(_square(p, q), p + q)),
    "ruzicka": lambda a: _div(a.sum(_abs), a.sum(F.greatest)),
    "roberts": lambda a: 1 - _div(a.sum(lambda p, q: _div((p + q) * F.least(p, q), F.greatest(p, q))), a.sum(lambda p, q: p + q)),
    "intersection": lambda a: 1 - _div(a.sum(F.least), F.least(a.sum(lambda p, q: p), a.sum(lambda p, q: q))),
    "motyka": lambda a: -_div(a.sum(F.least), a.sum(lambda p, q: p + q)),
    "canberra": lambda a: a.sum(lambda p, q: _div(_abs(p, q), F.abs(p) + F.abs(q))),
    "baroni_urbani_buser": _baroni,
    "penrose_size": lambda a: _root(a.n) * a.sum(_abs),
    "mean_character": lambda a: _div(a.sum(_abs), a.n),
    "lorentzian": lambda a: a.sum(lambda p, q: F.ln(1 + _abs(p, q))),
    "penrose_shape": _penrose_shape,
    "clark": lambda a: _root(_div(a.sum(lambda p, q: F.pow(_div(p - q, F.abs(p) + F.abs(q)), F.lit(2.0))), a.n)),
    "hellinger": _hellinger,
    "whittaker_index_of_association": _whittaker,
    "symmetric_chi_squared": _symmetric_chi,
    "pearson_correlation": _pearson,
    "improved_similarity": lambda a: _root(_div(a.sum(lambda p, q: F.pow(_div(p - q, p + q), F.lit(2.0))), a.n)),
    "absolute_value": lambda a: _div(a.sum(_abs), a.sum(lambda p, q: p)),
    "dot_product": _dot,
    "cosine": _dot,
    "dot_product_reverse": lambda a: let(a.where(lambda p, q: q > 0).rows, lambda rows: _dot(Aligned(rows))),
    "spectral_contrast_angle": _spectral_contrast,
    "wave_hedges": lambda a: a.sum(lambda p, q: _div(_abs(p, q), F.greatest(p, q))),
    "jaccard": lambda a: _div(a.sum(_square), a.sum(lambda p, q: p * p + q * q - p * q)),
    "dice": lambda a: _div(a.sum(_square), a.sum(lambda p, q: p * p + q * q)),
    "inner_product": lambda a: 1 - a.sum(lambda p, q: p * q),
    "divergence": lambda a: 2 * a.sum(lambda p, q: _div(_square(p, q), (p + q) * (p + q))),
    "avg_l": lambda a: a.sum(_abs) + a.max(_abs),
    "vicis_symmetric_chi_squared_3": lambda a: a.sum(lambda p, q: _div(_square(p, q), F.greatest(p, q))),
}


def _weighted_dot(rows: Column) -> Column:
    """Dot product of ``I**0.6 * mz**3``; rows of :func:`align_with_mz`."""
    up = F.transform(
        rows,
        lambda r: F.struct(
            F.lit(0.0).alias("mz"),
            (F.pow(r.p, F.lit(0.6)) * F.pow(r.mz_a, F.lit(3.0))).alias("p"),
            (F.pow(r.q, F.lit(0.6)) * F.pow(r.mz_b, F.lit(3.0))).alias("q"),
        ),
    )
    return let(up, lambda rows: _dot(Aligned(rows)))


def _fold(rows: Column, f) -> Column:
    return F.aggregate(rows, F.lit(0.0), lambda s, r: s + f(r))


def _counts(rows: Column) -> tuple[Column, Column, Column, Column]:
    both = F.filter(rows, lambda r: (r.p > 0) & (r.q > 0))
    size = lambda x: F.size(x).cast("double")
    return size(F.filter(rows, lambda r: r.p > 0)), size(F.filter(rows, lambda r: r.q > 0)), size(both), both


def _ms_for_id_v1(rows: Column) -> Column:
    nq, nr, nm, both = _counts(rows)
    delta = _fold(both, lambda r: F.abs(r.mz_a - r.mz_b))
    return F.when(nm > 0, _div(nq * nr * F.pow(delta, F.lit(0.25)), F.pow(nm, F.lit(4.0)))).otherwise(INF)


def _ms_for_id(rows: Column) -> Column:
    rows = F.filter(rows, lambda r: (r.p > 0.05) | (r.q > 0.05))
    rows = F.transform(
        rows,
        lambda r: F.struct(
            r.mz_a.alias("mz_a"), F.when(r.p > 0.05, r.p).otherwise(0.0).alias("p"), r.mz_b.alias("mz_b"), F.when(r.q > 0.05, r.q).otherwise(0.0).alias("q")
        ),
    )
    nq, nr, nm, both = _counts(rows)
    top = F.pow(nm, F.lit(4.0)) * F.pow(_fold(rows, lambda r: r.p) + 2 * _fold(rows, lambda r: r.q), F.lit(1.25))
    low = F.pow(nq + 2 * nr, F.lit(2.0)) + _fold(both, lambda r: F.abs(r.p - r.q)) + _fold(both, lambda r: F.abs(r.mz_a - r.mz_b))
    return -_div(top, low)


#: Methods on ``array<struct<mz_a, p, mz_b, q>>``.
MZ_METHODS: dict[str, Callable[[Column], Column]] = {
    "weighted_dot_product": _weighted_dot,
    "ms_for_id_v1": _ms_for_id_v1,
    "ms_for_id": _ms_for_id,
}

#: Ranges other than [0, 1].
RANGES: dict[str, tuple[float, float]] = {
    "unweighted_entropy": (0.0, log(4)),
    "entropy": (0.0, log(4)),
    "absolute_value": (0.0, 2.0),
    "avg_l": (0.0, 1.5),
    "bhattacharya_1": (0.0, (pi / 2) ** 2),
    "bhattacharya_2": (0.0, INF),
    "canberra": (0.0, INF),
    "clark": (0.0, INF),
    "divergence": (0.0, INF),
    "euclidean": (0.0, sqrt(2)),
    "hellinger": (0.0, INF),
    "improved_similarity": (0.0, INF),
    "lorentzian": (0.0, INF),
    "manhattan": (0.0, 2.0),
    "matusita": (0.0, sqrt(2)),
    "mean_character": (0.0, 2.0),
    "motyka": (-0.5, 0.0),
    "ms_for_id": (-INF, 0.0),
    "ms_for_id_v1": (0.0, INF),
    "pearson_correlation": (-1.0, 1.0),
    "penrose_shape": (0.0, sqrt(2)),
    "penrose_size": (0.0, INF),
    "squared_chord": (0.0, 2.0),
    "squared_euclidean": (0.0, 2.0),
    "symmetric_chi_squared": (0.0, 0.5 * sqrt(2)),
    "vicis_symmetric_chi_squared_3": (0.0, 2.0),
    "wave_hedges": (0.0, INF),
    "whittaker_index_of_association": (0.0, INF),
}


def names() -> list[str]:
    return [*METHODS, *MZ_METHODS]


def distance(method: str, aligned: Column, aligned_mz: Column | None = None) -> Column:
    """Raw distance; unknown methods raise."""
    if method in METHODS:
        return METHODS[method](Aligned(aligned))
    if method in MZ_METHODS and aligned_mz is not None:
        return MZ_METHODS[method](aligned_mz)
    raise ValueError(f"unknown method, or no m/z alignment given: {method}")


def normalized(method: str, d: Column) -> Column:
    """Distance mapped to [0, 1]: open ranges by 1 - 1/(1+d), closed ones linearly."""
    low, high = RANGES.get(method, (0.0, 1.0))
    if high == INF:
        x = F.when(d == INF, 1.0).otherwise(1 - 1 / (1 + d))
    elif low == -INF:
        x = F.when(d == -INF, 0.0).otherwise(-1 / (-1 + d))
    else:
        x = (d - low) / (high - low)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def similarity(method: str, d: Column, normalize: bool = True) -> Column:
    return 1 - normalized(method, d) if normalize else -d


def all_distances(pairs: DataFrame, methods: list[str] | None = None, normalize: bool = False, as_similarity: bool = False, aligned: str = "aligned", aligned_mz: str = "aligned_mz") -> DataFrame:
    """``pairs`` with one column per method (all 44 by default).

    A pair of which either side is empty has distance 1 when normalised, else infinity.
    """
    out = []
    empty = lambda c: F.aggregate(aligned, F.lit(0.0), lambda s, r: s + r[c]) == 0
    none = empty("p") | empty("q")
    for m in methods or names():
        d = distance(m, F.col(aligned), F.col(aligned_mz))
        d = F.when(none, 1.0 if normalize else INF).otherwise(normalized(m, d) if normalize else d)
        out.append((1 - d if normalize else -d).alias(m) if as_similarity else d.alias(m))
    return pairs.select(*[c for c in pairs.columns if c not in (aligned, aligned_mz)], *out)
