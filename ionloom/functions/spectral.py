"""Column expressions on spectra: nested peak lists and exploded peaks.

A peak list is ``array<struct<mz double, intensity double>>``.  Everything here stays
in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Entropy below which weak peaks are raised, and the exponent's constants.
ENTROPY_CUT, WEIGHT_BASE, WEIGHT_SLOPE = 3.0, 0.25, 0.25


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once: Spark evaluates what stands in a
    lambda anew for every element, unless it is a lambda variable itself."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total_intensity(peaks: Column) -> Column:
    return F.aggregate(peaks, F.lit(0.0), lambda a, p: a + p.intensity)


def with_intensity(peaks: Column, f) -> Column:
    """The list with every intensity replaced by ``f(intensity)``."""
    return F.transform(peaks, lambda p: F.struct(p.mz.alias("mz"), f(p.intensity).alias("intensity")))


def normalize(peaks: Column) -> Column:
    """Intensities that sum to one; a list without intensity becomes null."""
    scaled = lambda ps: let(total_intensity(ps), lambda t: F.when(t > 0, with_intensity(ps, lambda i: i / t)))
    return let(peaks, scaled)


def normalize_l2(peaks: Column) -> Column:
    norm = lambda ps: F.sqrt(F.aggregate(ps, F.lit(0.0), lambda a, p: a + p.intensity * p.intensity))
    return let(peaks, lambda ps: let(norm(ps), lambda t: F.when(t > 0, with_intensity(ps, lambda i: i / t))))


def entropy(peaks: Column, base: float | None = None) -> Column:
    """Shannon entropy of intensities that sum to one (natural logarithm, or ``base``)."""
    s = F.aggregate(peaks, F.lit(0.0), lambda a, p: a - F.when(p.intensity > 0, p.intensity * F.ln(p.intensity)).otherwise(0.0))
    return s if base is None else s / F.ln(F.lit(base))


def drop_zero(peaks: Column) -> Column:
    return F.filter(peaks, lambda p: (p.intensity > 0) & (p.mz > 0))


def within(peaks: Column, low: Column | float | None = None, high: Column | float | None = None, inclusive: bool = True) -> Column:
    """Peaks whose m/z is in the range; bounds inclusive or exclusive, None for no bound."""

    def keep(p: Column) -> Column:
        ok = F.lit(True)
        if low is not None:
            ok = ok & ((p.mz >= low) if inclusive else (p.mz > low))
        if high is not None:
            ok = ok & ((p.mz <= high) if inclusive else (p.mz < high))
        return ok

    return F.filter(peaks, keep)


def denoise(peaks: Column, threshold: float) -> Column:
    """Peaks of at least ``threshold`` times the strongest one."""
    top = lambda ps: F.aggregate(ps, F.lit(0.0), lambda a, p: F.greatest(a, p.intensity))
    return let(peaks, lambda ps: let(top(ps), lambda t: F.filter(ps, lambda p: p.intensity >= t * threshold)))


def sort_by_mz(peaks: Column) -> Column:
    return F.array_sort(peaks)


def strongest(peaks: Column, n: int) -> Column:
    """The ``n`` strongest peaks (ties: smaller m/z first), in order of m/z."""
    keyed = F.transform(peaks, lambda p: F.struct((-p.intensity).alias("k"), p.mz.alias("mz"), p.intensity.alias("intensity")))
    top = F.slice(F.array_sort(keyed), 1, n)
    return F.array_sort(F.transform(top, lambda p: F.struct(p.mz.alias("mz"), p.intensity.alias("intensity"))))


def neutral_loss(peaks: Column, precursor_mz: Column) -> Column:
    """Precursor m/z minus m/z, in ascending order."""
    return F.array_sort(F.transform(peaks, lambda p: F.struct((precursor_mz - p.mz).alias("mz"), p.intensity.alias("intensity"))))


def power(peaks: Column, p: float) -> Column:
    """Intensities raised to ``p`` and scaled to length one."""
    return normalize_l2(with_intensity(peaks, lambda i: F.pow(i, F.lit(p))))


def logistic_z(df: DataFrame, value: str, by: list[str], out: str = "z") -> DataFrame:
    """``1 / (1 + exp(-(x - mean) / std))`` with the population deviation of the group.

    Group moments are aggregated (a hot group shrinks on the map side) and joined back;
    a group without spread has 0.5, a null value null.
    """
    stats = df.groupBy(*by).agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s"))
    z = F.when(F.col("__s") > 0, (F.col(value) - F.col("__m")) / F.col("__s")).otherwise(F.when(F.col(value).isNotNull(), 0.0))
    return df.join(stats, by).withColumn(out, 1.0 / (1.0 + F.exp(-z))).drop("__m", "__s")
