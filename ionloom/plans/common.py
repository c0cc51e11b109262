"""Spectra as all queries take them, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.clean import PRECURSOR_GAP, clean_spectra
from ..operators.hotkeys import latest_wide
from ..operators.index import stored, write_index
from ..operators.weights import ENTROPY, Score
from ..session import spread, table

#: Every spectrum whose id is divisible by this is a query.
QUERY_STEP = 20


def all_spectra(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    """The last delivery of every spectrum, whatever its charge and precursor m/z."""
    df = table(spark, sf_dir, "spectrum")
    if "metadata" in extra:  # maps have no order, their entries have
        df = df.withColumn("metadata", F.map_entries("metadata"))
    # a table of one small file is cleaned on all cores
    one = spread(latest_wide(df, "spec_id", "loaded_at", ["charge", "precursor_mz", "peaks", *extra]), df)
    return one.withColumn("metadata", F.map_from_entries("metadata")) if "metadata" in extra else one


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per spectrum with a charge and a positive precursor m/z."""
    one = all_spectra(spark, sf_dir)
    return one.filter(F.col("charge").isNotNull() & ~F.isnan("precursor_mz") & (F.col("precursor_mz") > 0))


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searchable spectra: fragments below the precursor, near peaks merged, noise dropped.  Stored once
    per session and table."""

    def write(path: str) -> None:
        df = clean_spectra(
            spectra(spark, sf_dir), max_mz=F.col("precursor_mz") - PRECURSOR_GAP, mode="gap", remove_isotope=False
        )
        df.filter(F.size("peaks") > 0).select("spec_id", "charge", "precursor_mz", "peaks").write.parquet(path)

    return stored(table(spark, sf_dir, "spectrum"), ("cleaned", PRECURSOR_GAP), write)


def peak_index(spark: SparkSession, sf_dir: str, score: Score = ENTROPY) -> DataFrame:
    """The weighted peaks of the searchable spectra, partitioned by charge.  Stored once per session, table and score."""
    source = table(spark, sf_dir, "spectrum")
    return stored(source, ("index", PRECURSOR_GAP, score.name), lambda path: write_index(cleaned(spark, sf_dir), path, score))


def queries_of(df: DataFrame) -> DataFrame:
    return df.filter(F.col("spec_id") % QUERY_STEP == 0)


#: The same as common table expressions; ``pk`` is the weighted peak table.
PREP = """
one AS (SELECT * FROM spectrum QUALIFY ROW_NUMBER() OVER (PARTITION BY spec_id ORDER BY loaded_at DESC) = 1),
sp AS (SELECT spec_id, charge, precursor_mz, peaks FROM one
  WHERE charge IS NOT NULL AND precursor_mz IS NOT NULL AND NOT isnan(precursor_mz) AND precursor_mz > 0),
raw AS (SELECT spec_id, charge, precursor_mz, p.mz AS mz, p.intensity AS i FROM (SELECT spec_id, charge, precursor_mz, UNNEST(peaks) AS p FROM sp)),
kept AS (SELECT * FROM raw WHERE i > 0 AND mz > 0 AND mz <= precursor_mz - 16e-1),
brk AS (SELECT *, CASE WHEN mz - LAG(mz) OVER (PARTITION BY spec_id ORDER BY mz, i) < 5e-2 THEN 0 ELSE 1 END AS b FROM kept),
isl AS (SELECT *, SUM(b) OVER (PARTITION BY spec_id ORDER BY mz, i ROWS UNBOUNDED PRECEDING) AS k FROM brk),
mg AS (SELECT spec_id, charge, precursor_mz, CASE WHEN COUNT(*) = 1 THEN MIN(mz) ELSE SUM(mz * i) / SUM(i) END AS mz, SUM(i) AS i
  FROM isl GROUP BY spec_id, charge, precursor_mz, k),
top AS (SELECT *, MAX(i) OVER (PARTITION BY spec_id) AS mx FROM mg),
nm AS (SELECT spec_id, charge, precursor_mz, mz, i / SUM(i) OVER (PARTITION BY spec_id) AS n FROM top WHERE i >= mx * 1e-2),
en AS (SELECT *, -SUM(n * LN(n)) OVER (PARTITION BY spec_id) AS s FROM nm),
pw AS (SELECT *, CASE WHEN s < 3e0 THEN POWER(n, 25e-2 + 25e-2 * s) ELSE n END AS r FROM en),
pk AS (SELECT spec_id, charge, precursor_mz, ROW_NUMBER() OVER (PARTITION BY spec_id ORDER BY mz) AS peak_id, mz, precursor_mz - mz AS nl, n, s,
  r / SUM(r) OVER (PARTITION BY spec_id) / 2e0 AS h, SQRT(n) / SQRT(SUM(n) OVER (PARTITION BY spec_id)) AS c FROM pw)
"""

#: Fragment and neutral-loss matches of queries and library, and the hybrid set.
MATCH = (
    PREP
    + """,
qk AS (SELECT * FROM pk WHERE spec_id % 20 = 0),
prod AS (SELECT q.spec_id AS query_id, q.peak_id AS qp, l.spec_id, l.peak_id AS lp, q.precursor_mz AS qm, l.precursor_mz AS lm,
  q.h AS x, l.h AS y, q.c AS cx, l.c AS cy FROM qk q JOIN pk l ON q.charge = l.charge AND ABS(q.mz - l.mz) <= 2e-2),
nlm AS (SELECT q.spec_id AS query_id, q.peak_id AS qp, l.spec_id, l.peak_id AS lp, q.precursor_mz AS qm, l.precursor_mz AS lm,
  q.h AS x, l.h AS y, q.c AS cx, l.c AS cy FROM qk q JOIN pk l ON q.charge = l.charge AND ABS(q.nl - l.nl) <= 2e-2),
hyb AS (SELECT * FROM prod UNION ALL SELECT * FROM nlm n WHERE
  NOT EXISTS (SELECT 1 FROM prod p WHERE p.query_id = n.query_id AND p.spec_id = n.spec_id AND p.lp = n.lp)
  AND NOT EXISTS (SELECT 1 FROM prod p WHERE p.query_id = n.query_id AND p.spec_id = n.spec_id AND p.qp = n.qp))
"""
)

ENTROPY_SQL = "ROUND(SUM((x + y) * LOG2(x + y) - x * LOG2(x) - y * LOG2(y)), 6)"
COSINE_SQL = "ROUND(SUM(cx * cy), 6)"


def search_sql(source: str, score: str = ENTROPY_SQL, where: str = "TRUE") -> str:
    return f"WITH {MATCH} SELECT query_id, spec_id, {score} AS score, COUNT(*) AS matches FROM {source} WHERE {where} GROUP BY query_id, spec_id"
