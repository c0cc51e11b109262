"""Queries of the training-text operators (problems 5 to 8) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.hotkeys import latest_wide
from ..session import cut_lineage, table
from . import leakage, mixing, personal, quantiles

RUN_KEYS = ["datasource", "ion_mode", "library_number", "measure", "run_id"]
GROUP_KEYS = RUN_KEYS[:-1]
#: A run is slow when its percentile is this many times the median of its group.
SLOW = 2.5


def timings(runs: DataFrame) -> DataFrame:
    """One row per (run, query, measure); repeated deliveries count once (the last), negative
    timings are errors and do not count, rows without run or query number belong to none."""
    cols = ["datasource", "ion_mode", "library_number", "fast_entropy_search", "blink"]
    one = latest_wide(runs, ["run_id", "id"], "loaded_at", cols).filter(F.col("library_number").isNotNull())
    return one.unpivot(GROUP_KEYS[:-1] + ["run_id"], ["fast_entropy_search", "blink"], "measure", "seconds").filter("seconds >= 0")


def p5_run_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of every (run, measure): the tree nodes and their counts."""
    return quantiles.build_digest(timings(table(spark, sf_dir, "benchmark_result")), RUN_KEYS, "seconds")


def p5_group_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles per group, from the merged digests of its runs."""
    runs = p5_run_digests(spark, sf_dir)
    return quantiles.quantiles(quantiles.merge_digests([runs], GROUP_KEYS), GROUP_KEYS, [25, 50, 75, 90, 99])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs whose 50th or 90th percentile is at least 2.5 times their group's median.

    Runs have digests; a group's digest is the merged digests of its runs.
    """
    runs = cut_lineage(p5_run_digests(spark, sf_dir))
    group = quantiles.quantiles(quantiles.merge_digests([runs], GROUP_KEYS), GROUP_KEYS, [50])
    run = quantiles.quantiles(runs, RUN_KEYS, [50, 90])
    mid = group.select(*GROUP_KEYS, F.col("value").alias("mid"))
    cond = [F.col(f"r.{c}").eqNullSafe(F.col(f"g.{c}")) for c in GROUP_KEYS]
    hit = run.alias("r").join(mid.alias("g"), cond).filter(F.col("value") >= SLOW * F.col("mid"))
    return hit.select("run_id", "r.measure", "pct")


def p6_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaks with the repeated share of the item's words and of its question."""
    return leakage.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_leaks(spark, sf_dir).select("doc_id", "item_id")


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mix_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_target"))


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chosen amounts and actual shares per target source: of the documents as p7_mixture repeats them,
    beside the amounts and shares that the fitted rates expect."""
    r = _mix(spark, sf_dir)[0]
    r = r.withColumnsRenamed({"chosen_tokens": "fitted_tokens", "chosen_share": "fitted_share"})
    return r.withColumnRenamed("taken_tokens", "chosen_tokens")


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is taken."""
    return _mix(spark, sf_dir)[1].withColumnRenamed("id", "doc_id")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_report(spark, sf_dir).filter("short").select("source")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.find_personal(table(spark, sf_dir, "documents"), table(spark, sf_dir, "name_list"))


def p8_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.mask_personal(table(spark, sf_dir, "documents"), table(spark, sf_dir, "name_list"))


QUERIES = {f.__name__: f for f in (p5_found, p5_group_percentiles, p6_found, p6_leaks, p7_found, p7_mixture, p7_report, p8_found, p8_masked)}
# In p7_found characters stand for tokens: any usual tokenizer gives the same sources.
ORACLES = {
    # The digests of groups under 8192 rows are exact, up to the cell that holds a value; SQL names its middle.
    "p5_group_percentiles": """
WITH one AS (SELECT DISTINCT run_id, id, datasource, ion_mode, library_number, fast_entropy_search, blink FROM benchmark_result WHERE library_number IS NOT NULL),
t AS (SELECT datasource, ion_mode, library_number, 'fast_entropy_search' AS measure, fast_entropy_search AS s FROM one
      UNION ALL SELECT datasource, ion_mode, library_number, 'blink', blink FROM one),
ok AS (SELECT * FROM t WHERE s IS NOT NULL AND NOT isnan(s) AND s >= 0),
q AS (SELECT datasource, ion_mode, library_number, measure, COUNT(*) AS n_rows, quantile_disc(s, [25e-2, 5e-1, 75e-2, 9e-1, 99e-2]) AS v FROM ok GROUP BY ALL),
r AS (SELECT * EXCLUDE (v), UNNEST([25, 50, 75, 90, 99]) AS pct, UNNEST(v) AS x FROM q), e AS (SELECT *, POWER(2e0, FLOOR(LOG2(NULLIF(x, 0e0)))) AS p FROM r)
SELECT datasource, ion_mode, library_number, measure, pct, n_rows, COALESCE((1e0 + (FLOOR((x / p - 1e0) * 4096e0) + 5e-1) / 4096e0) * p, 0e0) AS value FROM e""",
    "p5_found": """
WITH one AS (SELECT DISTINCT run_id, id, datasource, ion_mode, library_number, fast_entropy_search, blink FROM benchmark_result WHERE library_number IS NOT NULL),
t AS (SELECT datasource, ion_mode, library_number, run_id, 'fast_entropy_search' AS measure, fast_entropy_search AS s FROM one
      UNION ALL SELECT datasource, ion_mode, library_number, run_id, 'blink', blink FROM one),
ok AS (SELECT * FROM t WHERE s IS NOT NULL AND NOT isnan(s) AND s >= 0),
g AS (SELECT datasource, ion_mode, library_number, measure, quantile_disc(s, 5e-1) AS mid FROM ok GROUP BY ALL),
r AS (SELECT datasource, ion_mode, library_number, measure, run_id, 50 AS pct, quantile_disc(s, 5e-1) AS v FROM ok GROUP BY ALL
      UNION ALL SELECT datasource, ion_mode, library_number, measure, run_id, 90, quantile_disc(s, 9e-1) FROM ok GROUP BY ALL)
SELECT r.run_id, r.measure, r.pct FROM r JOIN g ON r.datasource = g.datasource AND r.ion_mode = g.ion_mode
  AND r.library_number = g.library_number AND r.measure = g.measure WHERE r.v >= 25e-1 * g.mid""",
    "p7_found": """
WITH d AS (SELECT LOWER(TRIM(source)) AS s, SUM(LENGTH(text)) AS n FROM documents GROUP BY 1),
t AS (SELECT SUM(n) AS total FROM d WHERE s IN (SELECT LOWER(TRIM(source)) FROM mix_target))
SELECT m.source FROM mix_target m LEFT JOIN d ON d.s = LOWER(TRIM(m.source)), t
WHERE m.max_repeats * COALESCE(d.n, 0) < m.weight * t.total""",
}
