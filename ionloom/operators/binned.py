"""Many-to-many scoring on whole m/z bins, hit filters and ranks.

Peaks become (spectrum, bin) cells with a summed, length-one intensity and a count; a
tolerance is a set of bin offsets put on the smaller side, and the score is an
equi-join on the bin followed by one sum.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import spectral as S
from ..session import Shared, small_or_none
from .bandjoin import BROADCAST_ROWS, spelt_out
from .stats import dense_ranks


def discretize(spectra: DataFrame, bin_width: float = 0.001, power: float = 0.5) -> DataFrame:
    """``spec_id, charge, precursor_mz, bin, nl_bin, i, c`` of cleaned spectra.

    Bins are m/z over ``bin_width`` rounded half to even; the neutral-loss bin is the
    precursor's bin minus the peak's.
    """
    w = S.power(F.col("peaks"), power)
    peaks = spectra.select("spec_id", "charge", "precursor_mz", F.explode(w).alias("p"))
    at = F.rint(F.col("p.mz") / bin_width).cast("long")
    loss = F.rint(F.col("precursor_mz") / bin_width).cast("long") - at
    cells = peaks.select("spec_id", "charge", "precursor_mz", at.alias("bin"), loss.alias("nl_bin"), F.col("p.intensity").alias("x"))
    by = ["spec_id", "charge", "precursor_mz", "bin", "nl_bin"]
    return cells.groupBy(*by).agg(F.sum("x").alias("i"), F.count(F.lit(1)).alias("c"))


def offsets(tol: float, bin_width: float, mass_diffs: Sequence[float] = (0.0,), steps: int = 1) -> list[int]:
    """Bin offsets of the tolerance around every sum of ``steps`` signed mass differences."""
    n = int(2 * tol / bin_width - 1) // 2
    moves = sorted({0.0, *mass_diffs, *(-d for d in mass_diffs)})
    centres = {round(sum(c) / bin_width) for c in product(moves, repeat=steps)}
    return sorted({c + k for c in centres for k in range(-n, n + 1)})


def binned_score(
    queries: DataFrame,
    library: DataFrame,
    tol: float = 0.01,
    bin_width: float = 0.001,
    on: str = "bin",
    mass_diffs: Sequence[float] = (0.0,),
    steps: int = 1,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """``query_id, spec_id, score, matches`` of discretised spectra of one charge.

    ``on`` is ``bin`` or ``nl_bin``.  The offsets go on the query side, which is
    the smaller one and is broadcast if its measured size allows.
    """
    shifts = F.array(*[F.lit(o).cast("long") for o in offsets(tol, bin_width, mass_diffs, steps)])
    q = queries.select(F.col("spec_id").alias("query_id"), F.col("charge").alias("q_charge"), F.col(on).alias("at"), F.col("i").alias("qi"), F.col("c").alias("qc"))
    small = small_or_none(q, broadcast_rows // 20) is not None
    q = q.withColumn("__bin", F.explode(F.transform(shifts, lambda o: F.col("at") + o)))
    lib = library.select("spec_id", "charge", F.col(on).alias("__lib_bin"), "i", "c")
    pairs = lib.join(F.broadcast(q) if small else q, (F.col("__bin") == F.col("__lib_bin")) & (F.col("q_charge") == F.col("charge")))
    return pairs.groupBy("query_id", "spec_id").agg(F.sum(F.col("i") * F.col("qi")).alias("score"), F.sum(F.col("c") * F.col("qc")).alias("matches"))


def network_score(by_mz: DataFrame, by_loss: DataFrame) -> DataFrame:
    """The greater of the m/z and the neutral-loss score (and of the match counts)."""
    b = by_loss.select("query_id", "spec_id", F.col("score").alias("s2"), F.col("matches").alias("m2"))
    both = by_mz.join(b, ["query_id", "spec_id"], "full")
    top = lambda a, c: F.greatest(F.coalesce(a, F.lit(0)), F.coalesce(c, F.lit(0)))
    return both.select("query_id", "spec_id", top(F.col("score"), F.col("s2")).alias("score"), top(F.col("matches"), F.col("m2")).alias("matches"))


def filter_hits(hits: DataFrame, good_score: float = 0.5, min_matches: int = 5, good_matches: int = 20, either: bool = False) -> DataFrame:
    """``(score >= good and matches >= min) or matches >= good_matches``; ``either``: a plain or."""
    a, b = F.col("score") >= good_score, F.col("matches") >= min_matches
    return hits.filter((a | b) if either else ((a & b) | (F.col("matches") >= good_matches)))


def without_self(hits: DataFrame) -> DataFrame:
    return hits.filter(F.col("query_id") != F.col("spec_id"))


def match_ratios(hits: DataFrame, sizes: DataFrame) -> DataFrame:
    """Jaccard and overlap of the matches; ``sizes`` is ``spec_id, n_peaks``."""
    q = sizes.select(F.col("spec_id").alias("query_id"), F.col("n_peaks").alias("nq"))
    r = sizes.select("spec_id", F.col("n_peaks").alias("nr"))
    df = hits.join(q, "query_id").join(r, "spec_id")
    m = F.col("matches")
    union = F.nullif(F.col("nq") + F.col("nr") - m, F.lit(0))
    return df.withColumn("jaccard", m / union).withColumn("overlap", m / F.nullif(F.least("nq", "nr"), F.lit(0)))


def ranked(hits: DataFrame) -> DataFrame:
    """Dense ranks per query of score, matches and jaccard, the best first."""
    return dense_ranks(hits, "query_id", ["score", "matches", "jaccard"])


def ppm_filter(hits: DataFrame, ppm: float = 5.0, query: str = "precursor_mz_query", ref: str = "precursor_mz_ref") -> DataFrame:
    """Hits whose precursors differ by less than ``ppm`` millionths of the query's."""
    return hits.filter(1e6 * F.abs(F.col(query) - F.col(ref)) / F.nullif(F.col(query), F.lit(0.0)) < ppm)


#: Matched cells that a task of :func:`ranked_scores` holds; one query's own are always together.
HELD_CELLS = 4_000_000
#: The columns of :func:`ranked_scores`.
RANKED = "query_id long, spec_id long, score double, matches long, jaccard double, overlap double, rank_score long, rank_matches long, rank_jaccard long"


def _cells_of(t: pa.Table | pa.RecordBatch, bin_width: float) -> tuple[np.ndarray, ...]:
    """Row, bin, summed intensity and count of every cell, and the number of peaks by row."""
    p = t.column("peaks")
    p = p.combine_chunks() if isinstance(p, pa.ChunkedArray) else p
    size = pc.list_value_length(p).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(p)), size)
    mz, x = (pc.struct_field(p.flatten(), n).to_numpy(zero_copy_only=False).astype(np.float64) for n in ("mz", "intensity"))
    at = np.rint(mz / bin_width).astype(np.int64)
    order = np.lexsort((at, row))
    row, at, x = row[order], at[order], x[order]
    start = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (at[1:] != at[:-1]))) if len(row) else np.zeros(0, np.int64)
    return row[start], at[start], np.add.reduceat(x, start) if len(row) else x, np.diff(np.append(start, len(row))), size


def _rounded(x: np.ndarray) -> np.ndarray:
    """Six decimals as whole numbers, halves away from zero."""
    return np.copysign(np.floor(np.abs(x) * 1e6 + 0.5), x)


def _dense_rank(q: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Within equal ``q``, the greatest value first, NaN last."""
    value = np.where(np.isnan(value), -np.inf, value)
    order = np.lexsort((-value, q))
    new_q = np.append(True, q[order][1:] != q[order][:-1])
    step = np.cumsum(new_q | np.append(True, value[order][1:] != value[order][:-1]))
    rank = np.empty(len(q), np.int64)
    rank[order] = step - np.repeat(step[new_q], np.diff(np.append(np.flatnonzero(new_q), len(q)))) + 1
    return rank


def _ranked_block(block: Shared, bin_width: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, q_size, by = block.value
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            row, at, x, n, size = _cells_of(batch, bin_width)
            ids, charge = np.asarray(batch.column("spec_id")), np.asarray(batch.column("charge"))
            for c, (q, q_at, q_x, q_n) in by.items():
                mine = np.flatnonzero((charge == c)[row])
                k, i = spelt_out(np.searchsorted(q_at, at[mine]), np.searchsorted(q_at, at[mine], side="right"))
                if not len(k):
                    continue
                k = mine[k]
                pair = row[k] * len(q_ids) + q[i]
                order = np.argsort(pair, kind="stable")
                pair, k, i = pair[order], k[order], i[order]
                start = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
                lib, query = row[k[start]], q[i[start]]
                hit = (query.astype(np.int32), ids[lib], np.add.reduceat(x[k] * q_x[i], start), np.add.reduceat(n[k] * q_n[i], start), size[lib].astype(np.int32))
                other = q_ids[query] != ids[lib]
                held.append(tuple(v[other] for v in hit))
        if not held:
            return
        query, spec, score, matches, n_lib = (np.concatenate(v) for v in zip(*held, strict=True))
        held.clear()
        n_query = q_size[query]
        union, least = n_query + n_lib - matches, np.minimum(n_query, n_lib)
        score = _rounded(score)
        with np.errstate(divide="ignore", invalid="ignore"):
            jaccard, overlap = (_rounded(np.where(d == 0, np.nan, matches / d) + 3e-9) for d in (union, least))
        ranks = [_dense_rank(query, v) for v in (score, matches, jaccard)]
        for a in range(0, len(query), 100_000):
            part = slice(a, a + 100_000)
            cols = [q_ids[query[part]], spec[part], score[part] / 1e6, matches[part], *(pa.array(v[part] / 1e6, from_pandas=True) for v in (jaccard, overlap))]
            names = ["query_id", "spec_id", "score", "matches", "jaccard", "overlap", "rank_score", "rank_matches", "rank_jaccard"]
            yield pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v) for v in [*cols, *(r[part] for r in ranks)]], names)

    return run


def _nothing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return iter(())


def ranked_scores(queries: DataFrame, library: DataFrame, tol: float, bin_width: float, held: int | None = None) -> DataFrame:
    """:func:`binned_score` without self pairs, with :func:`match_ratios` and :func:`ranked`; score and ratios (plus 3e-9) rounded to six decimals.

    Both sides are ``spec_id, charge, peaks`` with intensities already weighted, and stored: the library is read once for each block of queries, by one
    task, which keeps the block's hits and ranks them, so that no hit is shuffled or written.  Blocks are cut by the number of
    matched cells, counted first from the library's bins; a query's own hits stay together, 28 bytes for each library spectrum at most.
    The cells of the queries are collected.
    """
    spark, moves = queries.sparkSession, offsets(tol, bin_width)
    cells = lambda df, shifts: df.filter(F.col("charge").isNotNull()).select(
        "spec_id", "charge", F.explode(F.flatten(F.transform("peaks", lambda p: F.transform(F.array(*[F.lit(o).cast("long") for o in shifts]), lambda o: F.rint(p.mz / bin_width).cast("long") + o)))).alias("bin")
    )
    counts = cells(library, [0]).groupBy("charge", "bin").agg(F.count(F.lit(1)).alias("n"))
    per = cells(queries, moves).join(counts, ["charge", "bin"]).groupBy("spec_id").agg(F.sum("n").alias("n")).toArrow()
    found = dict(zip(per.column("spec_id").to_pylist(), per.column("n").to_pylist(), strict=True))
    t = queries.filter(F.col("charge").isNotNull()).select("spec_id", "charge", "peaks").toArrow()
    row, at, x, n, size = _cells_of(t, bin_width)
    ids, charge = np.asarray(t.column("spec_id")), np.asarray(t.column("charge"))
    pairs = np.array([found.get(i, 0) for i in ids.tolist()], np.int64)
    # every core has a block
    limit = max(1, min(HELD_CELLS if held is None else held, -(-int(pairs.sum()) // spark.sparkContext.defaultParallelism)))
    cuts, total = [0], 0
    for k, v in enumerate(pairs.tolist()):
        if total and total + v > limit:
            cuts.append(k)
            total = 0
        total += v
    # parts of one partition each would be joined to one task, but for a part of another kind, which is empty
    parts = [library.select("spec_id").mapInArrow(_nothing, RANKED)]
    for a, b in zip(cuts, [*cuts[1:], len(ids)], strict=True):
        by = {}
        for c in set(charge[a:b].tolist()):
            k = np.flatnonzero((charge[row] == c) & (row >= a) & (row < b))
            k, near = np.repeat(k, len(moves)), (at[k][:, None] + np.array(moves)).ravel()
            order = np.argsort(near, kind="stable")
            k, near = k[order], near[order]
            by[c] = (row[k] - a, near, x[k], n[k])
        block = Shared(spark, (ids[a:b], size[a:b], by))
        one = library.select("spec_id", "charge", "peaks").coalesce(1)
        parts.append(one.mapInArrow(_ranked_block(block, bin_width), RANKED))
    return reduce(DataFrame.unionByName, parts)
