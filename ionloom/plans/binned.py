"""Registered queries: binned scores, hit filters, ranks and similarity graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import spectral as S
from ..operators import binned as B
from ..operators import graph as G
from ..operators.clean import PRECURSOR_GAP
from ..operators.index import stored
from ..session import cut_lineage, table
from .common import PREP, cleaned, queries_of

BIN, TOL = 0.01, 0.02
SUGAR = 162.0528


def _cells(spark, sf_dir) -> DataFrame:
    return cut_lineage(B.discretize(cleaned(spark, sf_dir), BIN))


def _score(spark, sf_dir, **options) -> DataFrame:
    cells = _cells(spark, sf_dir)
    return B.binned_score(queries_of(cells), cells, TOL, BIN, **options)


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("query_id", "spec_id", F.round("score", 6).alias("score"), F.col("matches").cast("long").alias("matches"))


def binned_cells(spark, sf_dir):
    c = B.discretize(cleaned(spark, sf_dir), BIN)
    return c.select("spec_id", "bin", "nl_bin", F.round("i", 6).alias("i"), "c")


def binned_score(spark, sf_dir):
    return _rounded(_score(spark, sf_dir))


def binned_loss_score(spark, sf_dir):
    return _rounded(_score(spark, sf_dir, on="nl_bin"))


def binned_kernel_massdiff(spark, sf_dir):
    """Peaks may also match at plus or minus one mass difference."""
    return _rounded(_score(spark, sf_dir, mass_diffs=[SUGAR]))


def network_score(spark, sf_dir):
    cells = _cells(spark, sf_dir)
    q = queries_of(cells)
    return _rounded(B.network_score(B.binned_score(q, cells, TOL, BIN), B.binned_score(q, cells, TOL, BIN, on="nl_bin")))


def hit_filter(spark, sf_dir):
    return _rounded(B.filter_hits(_score(spark, sf_dir), good_score=0.1, min_matches=2, good_matches=5))


def hit_ratios_ranks(spark, sf_dir):
    """Hits without self pairs, with Jaccard, overlap and dense ranks (scores rounded first)."""
    weighted = cleaned(spark, sf_dir).select("spec_id", "charge", S.power(F.col("peaks"), 0.5).alias("peaks"))
    lib = stored(table(spark, sf_dir, "spectrum"), ("weighted", PRECURSOR_GAP, 0.5), weighted.write.parquet)
    return B.ranked_scores(queries_of(lib), lib, TOL, BIN)


def edges(spark, sf_dir) -> DataFrame:
    """Undirected edges from the hit table: best rounded score per pair."""
    h = table(spark, sf_dir, "hit").filter("score is not null and query_id != spec_id")
    e = h.select(F.least("query_id", "spec_id").alias("src"), F.greatest("query_id", "spec_id").alias("dst"), F.round("score", 6).alias("score"))
    return e.groupBy("src", "dst").agg(F.max("score").alias("score"))


def hit_edges(spark, sf_dir):
    return edges(spark, sf_dir)


def mutual_topk_edges(spark, sf_dir):
    return G.mutual_top_k(edges(spark, sf_dir), 5)


def connected_components(spark, sf_dir):
    return G.connected_components(edges(spark, sf_dir).filter("score >= 0.5"))


def capped_components(spark, sf_dir):
    """Edges kept so that no component exceeds 50 spectra (sequential by score: no SQL form)."""
    return G.capped_components(edges(spark, sf_dir), 50)


QUERIES = {
    f.__name__: f
    for f in (
        binned_cells, binned_score, binned_loss_score, binned_kernel_massdiff, network_score, hit_filter, hit_ratios_ranks, hit_edges,
        mutual_topk_edges, connected_components, capped_components,
    )
}

# rint(162.0528 / 0.01) = 16205; offsets of the tolerance: int(2 * 0.02 / 0.01 - 1) // 2 = 1 bin
_CELL = f"""WITH {PREP}, cell AS (SELECT spec_id, charge, precursor_mz, CAST(ROUND_EVEN(mz / 1e-2, 0) AS BIGINT) AS bin,
  CAST(ROUND_EVEN(precursor_mz / 1e-2, 0) AS BIGINT) - CAST(ROUND_EVEN(mz / 1e-2, 0) AS BIGINT) AS nl_bin, SUM(c) AS i, COUNT(*) AS c FROM pk GROUP BY 1, 2, 3, 4, 5),
qc AS (SELECT * FROM cell WHERE spec_id % 20 = 0),
bs AS (SELECT q.spec_id AS query_id, l.spec_id, SUM(q.i * l.i) AS score, SUM(q.c * l.c) AS matches FROM qc q JOIN cell l ON q.charge = l.charge AND ABS(q.bin - l.bin) <= 1 GROUP BY 1, 2),
nl AS (SELECT q.spec_id AS query_id, l.spec_id, SUM(q.i * l.i) AS score, SUM(q.c * l.c) AS matches FROM qc q JOIN cell l ON q.charge = l.charge AND ABS(q.nl_bin - l.nl_bin) <= 1 GROUP BY 1, 2)"""
_OUT = "query_id, spec_id, ROUND(score, 6) AS score, CAST(matches AS BIGINT) AS matches"
_EDGES = """WITH {rec} e AS (SELECT LEAST(query_id, spec_id) AS src, GREATEST(query_id, spec_id) AS dst, MAX(ROUND(score, 6)) AS score
  FROM hit WHERE score IS NOT NULL AND query_id <> spec_id GROUP BY 1, 2)"""
_EDGES_SQL = _EDGES.replace("{rec} ", "")

ORACLES = {
    "binned_cells": f"{_CELL} SELECT spec_id, bin, nl_bin, ROUND(i, 6) AS i, c FROM cell",
    "binned_score": f"{_CELL} SELECT {_OUT} FROM bs",
    "binned_loss_score": f"{_CELL} SELECT {_OUT} FROM nl",
    "binned_kernel_massdiff": f"""{_CELL}, md AS (SELECT q.spec_id AS query_id, l.spec_id, SUM(q.i * l.i) AS score, SUM(q.c * l.c) AS matches FROM qc q JOIN cell l ON q.charge = l.charge
  AND (ABS(q.bin - l.bin) <= 1 OR ABS(q.bin + 16205 - l.bin) <= 1 OR ABS(q.bin - 16205 - l.bin) <= 1) GROUP BY 1, 2) SELECT {_OUT} FROM md""",
    "network_score": f"""{_CELL} SELECT query_id, spec_id, ROUND(GREATEST(COALESCE(bs.score, 0e0), COALESCE(nl.score, 0e0)), 6) AS score,
  CAST(GREATEST(COALESCE(bs.matches, 0), COALESCE(nl.matches, 0)) AS BIGINT) AS matches FROM bs FULL JOIN nl USING (query_id, spec_id)""",
    "hit_filter": f"{_CELL} SELECT {_OUT} FROM bs WHERE (score >= 1e-1 AND matches >= 2) OR matches >= 5",
    "hit_ratios_ranks": f"""{_CELL}, sz AS (SELECT spec_id, SUM(c) AS n FROM cell GROUP BY spec_id),
h AS (SELECT {_OUT} FROM bs WHERE query_id <> spec_id),
r AS (SELECT h.*, ROUND(CAST(matches AS DOUBLE) / (a.n + b.n - matches) + 3e-9, 6) AS jaccard, ROUND(CAST(matches AS DOUBLE) / LEAST(a.n, b.n) + 3e-9, 6) AS overlap
  FROM h JOIN sz a ON a.spec_id = h.query_id JOIN sz b ON b.spec_id = h.spec_id)
SELECT *, DENSE_RANK() OVER (PARTITION BY query_id ORDER BY score DESC) AS rank_score, DENSE_RANK() OVER (PARTITION BY query_id ORDER BY matches DESC) AS rank_matches,
  DENSE_RANK() OVER (PARTITION BY query_id ORDER BY jaccard DESC) AS rank_jaccard FROM r""",
    "hit_edges": f"{_EDGES_SQL} SELECT src, dst, score FROM e",
    "mutual_topk_edges": f"""{_EDGES_SQL}, n AS (SELECT src AS node, score FROM e UNION ALL SELECT dst, score FROM e),
c AS (SELECT node, MIN(score) AS cut FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY node ORDER BY score DESC) AS r FROM n) WHERE r <= 5 GROUP BY node)
SELECT src, dst, score FROM e JOIN c a ON a.node = src JOIN c b ON b.node = dst WHERE score >= a.cut AND score >= b.cut""",
    "connected_components": f"""{_EDGES.replace('{rec}', 'RECURSIVE')}, l AS (SELECT src AS a, dst AS b FROM e WHERE score >= 5e-1 UNION SELECT dst, src FROM e WHERE score >= 5e-1),
reach AS (SELECT a AS node, a AS other FROM l UNION SELECT reach.node, l.b FROM reach JOIN l ON l.a = reach.other)
SELECT node, MIN(other) AS component FROM reach GROUP BY node""",
}
