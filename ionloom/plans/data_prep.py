"""Queries of the general data-preparation operators (problems 1 to 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import badrows, drift, hotkeys, packed
from ..session import spread, table

def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hotkeys.hot_pairs(table(spark, sf_dir, "spectrum")).select("charge", "mz_bin")


def p1_pair_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = hotkeys.pair_stats(table(spark, sf_dir, "spectrum"), ["precursor_mz"])
    return s.select(
        "charge", "mz_bin", "n_rows", F.round("sum_precursor_mz", 4).alias("sum_mz"),
        F.col("min_precursor_mz").alias("min_mz"), F.col("max_precursor_mz").alias("max_mz"),
    )


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.schema_changes(table(spark, sf_dir, "export_record"))


def p2_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spectra of all feeds under one set of names and types; ``pepmass`` is the precursor as the file has it."""
    core = {"spec_id": ("spec_id", "long"), "precursor_mz": ("precursor_mz", "double"), "pepmass": ("precursor_mz", "string"), "charge": ("charge", "int"), "rt": ("rt", "double")}
    return drift.unify(table(spark, sf_dir, "export_record"), core)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    spectra = table(spark, sf_dir, "spectrum")
    one = hotkeys.latest_wide(spectra.filter(F.col("comments").isNotNull()), "spec_id", "loaded_at", ["comments"])
    return packed.split_packed(spread(one, spectra), "spec_id", "comments")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return badrows.rejected_rows(table(spark, sf_dir, "raw_row")).select("file_name", "line_no", "reason")


def p4_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return badrows.load_rows(table(spark, sf_dir, "raw_row"))


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_pair_stats, p2_found, p2_unified, p3_found, p4_found, p4_loaded)
}

_PAIRS = """
  SELECT DISTINCT spec_id, charge, CAST(FLOOR(precursor_mz) AS BIGINT) AS mz_bin, precursor_mz FROM spectrum
  WHERE charge IS NOT NULL AND precursor_mz IS NOT NULL AND NOT isnan(precursor_mz) AND precursor_mz > 0
"""

_NUM = "[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?"
_FIELD = '("([^"]|"")*"|[^"{d}]*)'


def _each(make) -> str:
    """A CASE over the delimiters; ``make`` writes the expression for one of them."""
    return "CASE d " + " ".join(f"WHEN {lit} THEN {make(char)}" for char, lit in ((",", "','"), (";", "';'"), ("\\t", "chr(9)"))) + " END"


def _full(d: str) -> str:
    f = _FIELD.replace("{d}", d)
    return f"regexp_full_match(line_text, '{f}({d}{f})*')"


_P4 = f"""
WITH h AS (SELECT file_name, line_text AS head, CASE WHEN contains(line_text, chr(9)) THEN chr(9) WHEN contains(line_text, ';') THEN ';' ELSE ',' END AS d FROM raw_row WHERE line_no = 1),
b AS (SELECT file_name, line_no, line_text, d, string_split(head, d) AS names FROM raw_row JOIN h USING (file_name)
  WHERE line_no <> 1 AND line_text <> '' AND NOT starts_with(line_text, '#')),
q AS (SELECT *, {_each(_full)} AS quoted, {_each(lambda d: f"string_split(regexp_replace(line_text, '{_FIELD.replace('{d}', d)}({d}|$)', '\\1' || chr(31), 'g'), chr(31))")} AS parts,
  LENGTH(regexp_replace(line_text, '"([^"]|"")*"', 'q', 'g')) - LENGTH(replace(regexp_replace(line_text, '"([^"]|"")*"', 'q', 'g'), d, '')) + 1 AS n FROM b),
f AS (SELECT *, parts[list_position(names, 'precursor_mz')] AS a, parts[list_position(names, 'peaks')] AS p, parts[list_position(names, 'num_peaks')] AS k FROM q),
u AS (SELECT file_name, line_no, quoted, n, {", ".join(f"trim(CASE WHEN starts_with({c}, chr(34)) THEN replace(substr({c}, 2, LENGTH({c}) - 2), chr(34) || chr(34), chr(34)) ELSE {c} END) AS {c}" for c in "apk")} FROM f),
v AS (SELECT *, CASE WHEN regexp_full_match(a, '{_NUM}') THEN TRY_CAST(a AS DOUBLE) END AS mz, list_filter(string_split(p, ' '), lambda x: x <> '') AS pairs FROM u),
w AS (SELECT *, len(pairs) > 0 AND CAST(len(pairs) AS VARCHAR) = k AND len(list_filter(pairs, lambda x: regexp_full_match(x, '{_NUM}:{_NUM}')
  AND TRY_CAST(split_part(x, ':', 1) AS DOUBLE) > 0 AND TRY_CAST(split_part(x, ':', 2) AS DOUBLE) >= 0)) = len(pairs) AS good FROM v),
r AS (SELECT file_name, line_no, CASE WHEN NOT quoted THEN 'quotes' WHEN n <> 9 THEN 'columns' WHEN mz IS NULL OR NOT (mz > 0 AND mz < 2000) THEN 'precursor_mz' WHEN NOT COALESCE(good, FALSE) THEN 'peaks' END AS reason FROM w)
SELECT file_name, line_no, reason FROM r WHERE reason IS NOT NULL"""

_P2 = f"""
WITH f AS (SELECT feed, file_name, MIN(exported_at) AS stamp FROM export_record GROUP BY feed, file_name),
o AS (SELECT file_name, LAG(file_name) OVER (PARTITION BY feed ORDER BY stamp, file_name) AS prev FROM f),
k AS (SELECT file_name, record_no, body, json_extract_string(body, '$.spec_id') AS id, UNNEST(json_keys(body)) AS key FROM export_record WHERE json_valid(body)),
v AS (SELECT file_name, record_no, id, LOWER(key) AS field, json_extract(body, '$."' || key || '"') AS j FROM k),
t AS (SELECT *, CASE json_type(j) WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'decimal' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' ELSE 'whole' END AS kind,
  LOWER(TRIM(CASE json_type(j) WHEN 'ARRAY' THEN json_extract_string(j, '$[0]') ELSE json_extract_string(j, '$') END)) AS s FROM v WHERE json_type(j) <> 'NULL'),
u AS (SELECT *, CASE WHEN regexp_full_match(s, '[0-9.]+[+-]') THEN right(s, 1) || left(s, LENGTH(s) - 1) WHEN regexp_full_match(s, '{_NUM}([ ,;]+{_NUM})*') THEN regexp_extract(s, '^{_NUM}') END AS num FROM t),
c AS (SELECT file_name, id, field, kind, COALESCE(CAST(TRY_CAST(num AS DOUBLE) AS VARCHAR), CASE s WHEN 'yes' THEN 'true' WHEN 'no' THEN 'false' ELSE s END) AS x FROM u),
p AS (SELECT file_name, field, MAX(kind) AS kind FROM c GROUP BY file_name, field),
a AS (SELECT o.file_name, o.prev, p.field, p.kind FROM o JOIN p ON p.file_name = o.prev),
b AS (SELECT o.file_name, o.prev, p.field, p.kind FROM o JOIN p ON p.file_name = o.file_name WHERE o.prev IS NOT NULL),
gone AS (SELECT * FROM a ANTI JOIN b USING (file_name, field)), new AS (SELECT * FROM b ANTI JOIN a USING (file_name, field)),
ren AS (SELECT g.file_name, g.field AS field_before, n.field AS field_after, ANY_VALUE(g.kind) AS ka, ANY_VALUE(n.kind) AS kb
  FROM gone g JOIN new n ON n.file_name = g.file_name JOIN c x ON x.file_name = g.prev AND x.field = g.field JOIN c y ON y.file_name = n.file_name AND y.field = n.field AND y.id = x.id
  GROUP BY g.file_name, g.field, n.field HAVING COUNT(*) >= 3 AND AVG(CASE WHEN x.x = y.x THEN 1e0 ELSE 0e0 END) >= 6e-1)
SELECT file_name, 'renamed' AS change, field_before, field_after FROM ren
UNION ALL SELECT file_name, 'retyped', field_before, field_after FROM ren WHERE ka <> kb
UNION ALL SELECT a.file_name, 'retyped', a.field, a.field FROM a JOIN b USING (file_name, field) WHERE a.kind <> b.kind
UNION ALL SELECT file_name, 'removed', field, '' FROM gone g WHERE NOT EXISTS (SELECT 1 FROM ren WHERE ren.file_name = g.file_name AND ren.field_before = g.field)
UNION ALL SELECT file_name, 'added', '', field FROM new n WHERE NOT EXISTS (SELECT 1 FROM ren WHERE ren.file_name = n.file_name AND ren.field_after = n.field)"""

ORACLES = {
    "p2_found": _P2,
    "p4_found": _P4,
    "p1_found": f"""
SELECT charge, mz_bin FROM ({_PAIRS}) GROUP BY charge, mz_bin
HAVING COUNT(*) * 1000 >= 15 * (SELECT COUNT(DISTINCT spec_id) FROM spectrum)""",
    "p1_pair_stats": f"""
SELECT charge, mz_bin, COUNT(*) AS n_rows, ROUND(SUM(precursor_mz), 4) AS sum_mz, MIN(precursor_mz) AS min_mz, MAX(precursor_mz) AS max_mz
FROM ({_PAIRS}) GROUP BY charge, mz_bin""",
}
