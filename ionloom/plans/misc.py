"""Registered queries: chemistry, timing statistics, formats, vectors and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import chem as C
from ..functions import spectral as S
from ..operators import clean
from ..operators import stats as T
from ..operators.hotkeys import latest_per_id
from ..session import ensure_checkpoint_dir, table
from .common import ENTROPY_SQL, MATCH, PREP, all_spectra, cleaned, peak_index, queries_of, spectra

_INCHI = r"InChI\s*=\s*\"?1S/([A-Za-z0-9]+)/"
_ADDUCT = r"adduct\s*=\s*\"?(\[[^\]]*\][0-9]*[+-])"


def _with_text(spark, sf_dir) -> DataFrame:
    one = latest_per_id(table(spark, sf_dir, "spectrum"), "spec_id", "loaded_at", ["precursor_mz", "comments"])
    pick = lambda p: F.nullif(F.regexp_extract("comments", p, 1), F.lit(""))
    return one.select("spec_id", "precursor_mz", pick(_INCHI).alias("formula"), pick(_ADDUCT).alias("adduct"))


def formula_mass(spark, sf_dir):
    """Mass, canonical form and unsaturation of the formula in each spectrum's comments."""
    df = _with_text(spark, sf_dir).filter(F.col("formula").isNotNull())
    f = F.col("formula")
    return df.select(
        "spec_id", "formula", F.round(C.formula_mass(f), 5).alias("mass"), C.canonical_formula(f).alias("canonical"), C.unsaturation(f).alias("unsaturation")
    )


def adduct_mz(spark, sf_dir):
    """Neutral mass and protonated m/z by the adduct in each spectrum's comments."""
    df = _with_text(spark, sf_dir).filter(F.col("adduct").isNotNull() & ~F.isnan("precursor_mz") & (F.col("precursor_mz") > 0))
    df = df.withColumn("a", C.parse_adduct(F.col("adduct")))
    mass = C.adduct_neutral_mass(F.col("precursor_mz"), F.col("a"))
    return df.select(
        "spec_id", "adduct", F.col("a.charge").cast("long").alias("charge"), F.round("a.mass_add", 5).alias("mass_add"), F.round(mass, 4).alias("mass"),
        F.round(C.adduct_mz(mass, F.col("a")), 4).alias("mz"), F.round(C.simple_adduct_mz(F.col("precursor_mz"), F.col("a")), 4).alias("simple_mz"),
    )


def formula_candidates(spark, sf_dir):
    """CHO formulas within 2 mDa of the neutral mass (precursor less a proton), for every spectrum with a valid precursor.

    Each distinct precursor is enumerated once, spread over all tasks: its work grows with the mass, not with its bytes.
    """
    one = latest_per_id(table(spark, sf_dir, "spectrum"), "spec_id", "loaded_at", ["precursor_mz"])
    one = one.filter((F.col("precursor_mz") > 0) & (F.col("precursor_mz") < float("inf"))).select("spec_id", "precursor_mz")  # NaN is above all
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    mass = F.col("precursor_mz") - C.PROTON_MASS
    windows = one.select("precursor_mz").distinct().repartition(tasks, "precursor_mz")
    windows = windows.select("precursor_mz", (mass - 0.002).alias("low"), (mass + 0.002).alias("high"))
    found = C.enumerate_formulas(windows, "low", "high", {"C": None, "O": None, "H": None})
    return one.join(found, "precursor_mz").select("spec_id", "formula", F.round("mass", 5).alias("mass"))


# ------------------------------------------------------------- statistics

_IDS = ["run_id", "id", "datasource", "ion_mode", "library_number"]
_MEASURES = ["fast_entropy_search", "native_entropy_search", "blink", "matchms"]


def _runs(spark, sf_dir) -> DataFrame:
    r = table(spark, sf_dir, "benchmark_result")
    pick = F.max(F.struct("loaded_at", "datasource", "ion_mode", "library_number", *_MEASURES, "max_difference_for_blink")).alias("m")
    return r.groupBy("run_id", "id").agg(pick).select("run_id", "id", "m.*")


def unpivot_stats(spark, sf_dir):
    """Timings in long form, summarised per source, mode and method."""
    long = T.long_form(_runs(spark, sf_dir), _IDS, _MEASURES).filter("seconds >= 0")
    s = T.summary(long, ["datasource", "ion_mode", "method"])
    return s.select("datasource", "ion_mode", "method", "n", *[F.round(F.col(c) + 1e-9, 6).alias(c) for c in ("mean", "max", "q1", "median", "q3")])


def percentiles(spark, sf_dir):
    """Exact quartiles of two measures per group of library size."""
    long = T.long_form(_runs(spark, sf_dir), _IDS, ["fast_entropy_search", "blink"]).filter("seconds >= 0 and library_number is not null")
    s = T.summary(long, ["library_number", "method"])
    return s.select("library_number", "method", "n", *[F.round(F.col(c) + 1e-9, 6).alias(c) for c in ("q1", "median", "q3")])


def max_errors(spark, sf_dir):
    r = _runs(spark, sf_dir).filter(F.col("max_difference_for_blink").isNotNull() & ~F.isnan("max_difference_for_blink"))
    return r.groupBy("datasource", "ion_mode").agg(F.max("max_difference_for_blink").alias("max_error"), F.count(F.lit(1)).alias("n"))


def timing_histogram(spark, sf_dir):
    long = T.long_form(_runs(spark, sf_dir), _IDS, ["blink"]).filter("seconds >= 0")
    h = T.histogram(long, ["datasource"], "seconds", 0.5)
    return h.select("datasource", F.round("bin", 1).alias("bin"), "n")


def repository_times(spark, sf_dir):
    """Whole-repository timings per target and mode, letter case ignored."""
    r = table(spark, sf_dir, "whole_repository").withColumn("target", F.lower("target"))
    long = T.long_form(r, ["idx", "target", "ion_mode"], ["time_open", "time_neutral_loss"])
    s = T.summary(long.dropna(subset=["target", "ion_mode"]), ["target", "ion_mode", "method"])
    return s.select("target", "ion_mode", "method", "n", F.round("median", 6).alias("median"), F.round("max", 6).alias("max"))


def ion_mode_counts(spark, sf_dir):
    mode = F.when(F.col("charge") > 0, "P").when(F.col("charge") < 0, "N")
    return spectra(spark, sf_dir).select(mode.alias("ion_mode")).filter("ion_mode is not null").groupBy("ion_mode").agg(F.count(F.lit(1)).alias("n"))


def z_logistic(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return S.logistic_z(e, "value", ["event_type"]).select("event_id", F.round("z", 6).alias("z"))


def hit_scores_union(spark, sf_dir):
    """Hits and their reverse as one table, without repeated rows."""
    h = table(spark, sf_dir, "hit")
    back = h.select(F.col("spec_id").alias("query_id"), F.col("query_id").alias("spec_id"), "score")
    return h.select("query_id", "spec_id", "score").unionByName(back, allowMissingColumns=True).distinct()


def column_standardize(spark, sf_dir):
    """Named columns from the aliases in the metadata maps."""
    m = table(spark, sf_dir, "spectrum").select("spec_id", "loaded_at", "metadata")
    df = clean.standardize(m, {"title": (["title", "name"], "unnamed", "string"), "device": (["instrument", "instrument_type"], None, "string")})
    return df.select("spec_id", "title", "device").distinct()


def embedding_distances(spark, sf_dir):
    """Distances of each vector to the next one of its label, on absolute, sum-one values."""
    from ..functions import distances as D

    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("v"))
    # only ids are put in order, by ranges; the vectors are joined to them
    ids = T.running_total(e.select("label", "vec_id").distinct(), ["label"], F.col("vec_id"), F.lit(1)).select("label", "vec_id", F.col("__upto").alias("at"))
    after = ids.select(F.col("label").alias("next_label"), (F.col("at") - 1).alias("before"), F.col("vec_id").alias("next"))
    ids = ids.join(after, F.col("label").eqNullSafe(F.col("next_label")) & (F.col("at") == F.col("before"))).select("vec_id", "next")
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x)
    e = e.select("vec_id", "v", total.alias("t"))
    e = ids.join(e, "vec_id").join(e.select(F.col("vec_id").alias("next"), F.col("v").alias("v2"), F.col("t").alias("t2")), "next")
    rows = F.zip_with("v", "v2", lambda a, b: F.struct(F.lit(0.0).alias("mz"), (a / F.col("t")).alias("p"), (b / F.col("t2")).alias("q")))
    e = e.select("vec_id", F.explode(F.array(rows)).alias("aligned"))
    methods = ["manhattan", "euclidean", "dot_product"]
    return D.all_distances(e, methods).select("vec_id", *[F.round(F.col(m) + 3e-9, 6).alias(m) for m in methods])


# ------------------------------------------------------------- formats and streams


def _folder(spark, name: str) -> str:
    """A new folder in the shared checkpoint directory."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def _for_files(spark, sf_dir) -> DataFrame:
    df = spectra(spark, sf_dir)
    meta = F.create_map(F.lit("id"), F.array(F.col("spec_id").cast("string")), F.lit("synonym"), F.array(F.lit("a=b"), F.lit("c: d")))
    return df.select("precursor_mz", "charge", F.lit(None).cast("double").alias("rt"), F.lit(2).alias("ms_level"), "peaks", meta.alias("metadata"))


def _round_trip(spark, sf_dir, kind: str) -> DataFrame:
    from ..sources import records

    path = _folder(spark, kind)
    records.write_spectra(_for_files(spark, sf_dir), path, kind)
    return _read_back(records.read_spectra(spark, path, kind))


def _read_back(back: DataFrame) -> DataFrame:
    spec = F.try_element_at(F.try_element_at("metadata", F.lit("id")), F.lit(1)).cast("long").alias("spec_id")
    return back.select(
        spec, "precursor_mz", "charge", F.size("peaks").cast("long").alias("n_peaks"), F.round(S.total_intensity(F.col("peaks")), 4).alias("total"),
        F.size(F.try_element_at("metadata", F.lit("synonym"))).cast("long").alias("n_synonyms"),
    )


def msp_roundtrip(spark, sf_dir):
    """The searchable spectra with made-up metadata written as MSP text and read back."""
    return _round_trip(spark, sf_dir, "msp")


def mgf_roundtrip(spark, sf_dir):
    """The searchable spectra with made-up metadata written as MGF text and read back."""
    return _round_trip(spark, sf_dir, "mgf")


def _round_trip_all(spark, sf_dir, kind: str) -> DataFrame:
    """Every spectrum with its own fields; ``same`` tells whether all of them, peaks and metadata came back as written."""
    from ..sources import records

    fields = ["precursor_mz", "charge", "rt", "ms_level"]
    none, bare = F.create_map().cast("map<string,array<string>>"), F.array().cast(clean.PEAKS)
    df = all_spectra(spark, sf_dir, "rt", "ms_level", "metadata")
    df = df.withColumn("metadata", F.coalesce("metadata", none)).withColumn("peaks", F.coalesce("peaks", bare))
    path = _folder(spark, kind)
    own_id = F.create_map(F.lit("spec_id"), F.array(F.col("spec_id").cast("string")))
    records.write_spectra(df.withColumn("metadata", F.map_concat("metadata", own_id)), path, kind)
    back = records.read_spectra(spark, path, kind)
    back = back.withColumn("spec_id", F.try_element_at(F.try_element_at("metadata", F.lit("spec_id")), F.lit(1)).cast("long"))
    core = ("spec_id", *records._CORE)  # the lines of the fields come back as metadata as well
    back = back.withColumn("metadata", F.map_filter("metadata", lambda k, _: ~k.isin(*core)))
    shown = lambda d: [*fields, "peaks", F.sort_array(F.map_entries(d["metadata"])).alias("meta")]
    was = df.select("spec_id", F.struct(*shown(df)).alias("was"))
    now = back.select("spec_id", F.lit(True).alias("read"), F.struct(*shown(back)).alias("now"))
    same = F.lit(True)
    for c in (*fields, "peaks", "meta"):
        same = same & F.col(f"was.{c}").eqNullSafe(F.col(f"now.{c}"))
    return was.join(now, "spec_id", "full").select(
        "spec_id", *[f"now.{c}" for c in fields], F.size("now.peaks").cast("long").alias("n_peaks"),
        F.round(S.total_intensity(F.col("now.peaks")), 4).alias("total"), F.col("now.meta").alias("metadata"),
        (F.coalesce("read", F.lit(False)) & same).alias("same"),
    )


def msp_roundtrip_all(spark, sf_dir):
    """All spectra with their own metadata written as MSP text, read back and compared."""
    return _round_trip_all(spark, sf_dir, "msp")


def mgf_roundtrip_all(spark, sf_dir):
    """All spectra with their own metadata written as MGF text, read back and compared."""
    return _round_trip_all(spark, sf_dir, "mgf")


def index_roundtrip(spark, sf_dir):
    """The peak index written by charge and read back for the positive charges."""
    from ..operators import index

    path = _folder(spark, "index")
    index.write_index(cleaned(spark, sf_dir), path)
    df = index.read_index(spark, path, [1, 2, 3])
    return df.groupBy("charge").agg(F.count_distinct("spec_id").alias("n_spectra"), F.round(F.sum("w"), 4).alias("total"))


def stream_static_search(spark, sf_dir):
    """The query spectra as a stream against the static library: best three hits each."""
    from ..streaming.search import search_stream

    source, sink = _folder(spark, "stream-in"), _folder(spark, "stream-out")
    queries_of(cleaned(spark, sf_dir)).write.parquet(source)
    schema = spark.read.parquet(source).schema
    stream = spark.readStream.schema(schema).parquet(source)

    def save(hits: DataFrame, batch_id: int) -> None:
        hits.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    run = search_stream(stream, peak_index(spark, sf_dir), save, k=3).option("checkpointLocation", _folder(spark, "stream-state")).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(sink).select("query_id", "spec_id", F.round("score", 6).alias("score"))


def stream_scan_counts(spark, sf_dir):
    """Scans per library and hour, counted over a stream with a watermark."""
    from ..streaming.search import scan_counts

    state, out = _folder(spark, "counts-state"), _folder(spark, "counts-out")
    raw = table(spark, sf_dir, "spectrum").select("spec_id", "library", "acquired_at")
    source = _folder(spark, "counts-in")
    raw.write.parquet(source)
    stream = spark.readStream.schema(raw.schema).parquet(source)

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    counts = scan_counts(stream.filter(F.col("acquired_at").isNotNull()), width="1 hour")
    run = counts.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", state).trigger(availableNow=True).start()
    run.awaitTermination()
    # a window is written anew whenever it has grown
    last = spark.read.parquet(out).groupBy("window_start", "library").agg(F.max_by("n_scans", "batch").alias("n_scans"))
    return last.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("hour"), "library", "n_scans")


def msp_crlf_roundtrip(spark, sf_dir):
    """The searchable spectra as MSP text with Windows line ends, read back."""
    from ..sources import records

    path = _folder(spark, "msp-crlf")
    text = records.format_msp(_for_files(spark, sf_dir)).select(F.regexp_replace("value", "\n", "\r\n").alias("value"))
    text.write.option("lineSep", "\r\n").text(path)
    return _read_back(records.read_spectra(spark, path, "msp"))


def mzml_gz_roundtrip(spark, sf_dir):
    """The searchable spectra as compressed mzML, one file per task, read back."""
    from ..sources import mzml

    path = _folder(spark, "mzml")
    mzml.write_mzml(spectra(spark, sf_dir).select("spec_id", "precursor_mz", "charge", "peaks"), path, "spec_id")
    back = mzml.read_mzml(spark, path)
    spec = F.regexp_extract("native_id", "([0-9]+)$", 1).cast("long").alias("spec_id")
    return back.select(
        spec, "precursor_mz", "charge", F.size("peaks").cast("long").alias("n_peaks"), F.round(S.total_intensity(F.col("peaks")), 4).alias("total")
    )


def sub_formula_candidates(spark, sf_dir):
    """Parts of each spectrum's formula that weigh between a quarter and half of it."""
    df = formula_mass(spark, sf_dir).select("formula", "mass").distinct()
    df = df.withColumn("low", F.col("mass") / 4).withColumn("high", F.col("mass") / 2)
    return C.sub_formulas(df, "formula", "low", "high").select("formula", "sub_formula", F.round("sub_mass", 5).alias("sub_mass"))


QUERIES = {
    f.__name__: f
    for f in (
        formula_mass, adduct_mz, formula_candidates, unpivot_stats, percentiles, max_errors, timing_histogram, repository_times, ion_mode_counts,
        z_logistic, hit_scores_union, column_standardize, embedding_distances, msp_roundtrip, mgf_roundtrip,
        msp_roundtrip_all, mgf_roundtrip_all, index_roundtrip, stream_static_search, stream_scan_counts,
        msp_crlf_roundtrip, mzml_gz_roundtrip, sub_formula_candidates,
    )
}

_ONE = "one AS (SELECT * FROM spectrum QUALIFY ROW_NUMBER() OVER (PARTITION BY spec_id ORDER BY loaded_at DESC) = 1)"
_SPECTRA = f"{_ONE}, sp AS (SELECT * FROM one WHERE charge IS NOT NULL AND precursor_mz IS NOT NULL AND NOT isnan(precursor_mz) AND precursor_mz > 0)"
_TEXT = f"""{_ONE}, tx AS (SELECT spec_id, precursor_mz, NULLIF(regexp_extract(comments, 'InChI\\s*=\\s*"?1S/([A-Za-z0-9]+)/', 1), '') AS formula,
  NULLIF(regexp_extract(comments, 'adduct\\s*=\\s*"?(\\[[^\\]]*\\][0-9]*[+-])', 1), '') AS adduct FROM one)"""
_N = lambda a: f"COALESCE(SUM(n) FILTER (atom = '{a}'), 0)"
_O, _H = (f"{C.ATOM_MASS[a]!r}e0" for a in "OH")
_MASS = " ".join(f"WHEN '{a}' THEN {C.ATOM_MASS[a]!r}e0" for a in ("H", "C", "N", "O", "S", "P"))
#: The adducts of the test data: public mass, number of molecules, charge.
_ADDUCTS = ", ".join(
    f"('{a}', {m!r}e0, {z})"
    for a, m, z in (
        ("[M+H]+", C.ADDUCT_MASS["[M+H]+"], 1), ("[M+Na]+", C.ADDUCT_MASS["[M+Na]+"], 1), ("[M+NH4]+", C.ADDUCT_MASS["[M+NH4]+"], 1),
        ("[M-H]-", C.ADDUCT_MASS["[M-H]-"], -1), ("[M+Cl]-", C.ADDUCT_MASS["[M+Cl]-"], -1),
        ("[M+2H]2+", 2 * C.ATOM_MASS["H"] - 2 * C.ELECTRON_MASS, 2), ("[M+3H]3+", 3 * C.ATOM_MASS["H"] - 3 * C.ELECTRON_MASS, 3),
        ("[M-2H]2-", -2 * C.ATOM_MASS["H"] + 2 * C.ELECTRON_MASS, -2),
        ("[M+HCOO]-", C.ATOM_MASS["H"] + C.ATOM_MASS["C"] + 2 * C.ATOM_MASS["O"] + C.ELECTRON_MASS, -1),
    )
)
_RUNS = """WITH r AS (SELECT DISTINCT run_id, id, datasource, ion_mode, library_number, fast_entropy_search, native_entropy_search, blink, matchms, max_difference_for_blink FROM benchmark_result),
l AS (SELECT run_id, id, datasource, ion_mode, library_number, method, seconds FROM r UNPIVOT (seconds FOR method IN (fast_entropy_search, native_entropy_search, blink, matchms))
  WHERE NOT isnan(seconds) AND seconds >= 0)"""
_Q = "ROUND(quantile_cont(seconds, 25e-2) + 1e-9, 6) AS q1, ROUND(quantile_cont(seconds, 5e-1) + 1e-9, 6) AS median, ROUND(quantile_cont(seconds, 75e-2) + 1e-9, 6) AS q3"


def _round_trip_sql() -> str:
    return f"""WITH {_SPECTRA}, p AS (SELECT spec_id, UNNEST(peaks) AS p FROM sp), a AS (SELECT spec_id, COUNT(*) AS n, SUM(p.intensity) AS t FROM p GROUP BY spec_id)
SELECT spec_id, precursor_mz, charge, COALESCE(n, 0) AS n_peaks, ROUND(COALESCE(t, 0e0), 4) AS total, CAST(2 AS BIGINT) AS n_synonyms FROM sp LEFT JOIN a USING (spec_id)"""


ORACLES = {
    "formula_mass": f"""WITH {_TEXT}, f AS (SELECT spec_id, formula, regexp_extract_all(formula, '([A-Z][a-z]*)([0-9]*)', 1) AS a, regexp_extract_all(formula, '([A-Z][a-z]*)([0-9]*)', 2) AS c FROM tx WHERE formula IS NOT NULL),
u AS (SELECT spec_id, formula, UNNEST(a) AS atom, UNNEST(c) AS c FROM f), v AS (SELECT *, CASE WHEN c = '' THEN 1 ELSE CAST(c AS INT) END AS n FROM u),
g AS (SELECT spec_id, formula, SUM(n * CASE atom {_MASS} ELSE 0e0 END) AS m, {_N('H')} AS h, {_N('C')} AS c, {_N('N')} AS nn, {_N('O')} AS o FROM v GROUP BY spec_id, formula)
SELECT spec_id, formula, ROUND(m, 5) AS mass, concat(CASE WHEN h > 0 THEN 'H' || CASE WHEN h > 1 THEN CAST(h AS VARCHAR) ELSE '' END ELSE '' END, CASE WHEN c > 0 THEN 'C' || CASE WHEN c > 1 THEN CAST(c AS VARCHAR) ELSE '' END ELSE '' END,
  CASE WHEN nn > 0 THEN 'N' || CASE WHEN nn > 1 THEN CAST(nn AS VARCHAR) ELSE '' END ELSE '' END, CASE WHEN o > 0 THEN 'O' || CASE WHEN o > 1 THEN CAST(o AS VARCHAR) ELSE '' END ELSE '' END) AS canonical,
  CAST((2 * c + 2 + nn - h) AS DOUBLE) / 2e0 AS unsaturation FROM g""",
    "adduct_mz": f"""WITH {_TEXT}, ad(adduct, m, z) AS (VALUES {_ADDUCTS}),
j AS (SELECT spec_id, adduct, precursor_mz, m, z FROM tx JOIN ad USING (adduct) WHERE precursor_mz IS NOT NULL AND NOT isnan(precursor_mz) AND precursor_mz > 0)
SELECT spec_id, adduct, CAST(z AS BIGINT) AS charge, ROUND(m, 5) AS mass_add, ROUND(precursor_mz * ABS(z) - m, 4) AS mass, ROUND(precursor_mz, 4) AS mz,
  ROUND((precursor_mz * ABS(z) - m + 1.007276e0 * z) / ABS(z), 4) AS simple_mz FROM j""",
    "formula_candidates": f"""WITH {_ONE}, v AS (SELECT spec_id, precursor_mz FROM one WHERE precursor_mz > 0 AND precursor_mz < 'inf'::DOUBLE),
w AS (SELECT DISTINCT precursor_mz, precursor_mz - {C.PROTON_MASS!r}e0 - 2e-3 AS lo, precursor_mz - {C.PROTON_MASS!r}e0 + 2e-3 AS hi FROM v),
c AS (SELECT *, UNNEST(range(0, CAST(FLOOR(hi / 12e0) AS BIGINT) + 1)) AS c FROM w WHERE hi >= 0),
o AS (SELECT *, UNNEST(range(0, CAST(FLOOR((hi - c * 12e0) / {_O}) AS BIGINT) + 1)) AS o FROM c),
m AS (SELECT *, c * 12e0 + o * {_O} AS m FROM o),
h AS (SELECT *, UNNEST(range(GREATEST(0, CAST(CEIL((lo - m) / {_H}) AS BIGINT)), CAST(FLOOR((hi - m) / {_H}) AS BIGINT) + 1)) AS h FROM m),
f AS (SELECT precursor_mz, concat(CASE c WHEN 0 THEN '' WHEN 1 THEN 'C' ELSE 'C' || c END, CASE o WHEN 0 THEN '' WHEN 1 THEN 'O' ELSE 'O' || o END, CASE h WHEN 0 THEN '' WHEN 1 THEN 'H' ELSE 'H' || h END) AS formula,
  m + h * {_H} AS mass FROM h WHERE m + h * {_H} BETWEEN lo AND hi)
SELECT spec_id, formula, ROUND(mass, 5) AS mass FROM v JOIN f USING (precursor_mz)""",
    "unpivot_stats": f"{_RUNS} SELECT datasource, ion_mode, method, COUNT(*) AS n, ROUND(AVG(seconds) + 1e-9, 6) AS mean, ROUND(MAX(seconds) + 1e-9, 6) AS max, {_Q} FROM l GROUP BY datasource, ion_mode, method",
    "percentiles": f"{_RUNS} SELECT library_number, method, COUNT(*) AS n, {_Q} FROM l WHERE library_number IS NOT NULL AND method IN ('fast_entropy_search', 'blink') GROUP BY library_number, method",
    "max_errors": f"{_RUNS} SELECT datasource, ion_mode, MAX(max_difference_for_blink) AS max_error, COUNT(*) AS n FROM r WHERE max_difference_for_blink IS NOT NULL AND NOT isnan(max_difference_for_blink) GROUP BY datasource, ion_mode",
    "timing_histogram": f"{_RUNS} SELECT datasource, ROUND(FLOOR(seconds / 5e-1) * 5e-1, 1) AS bin, COUNT(*) AS n FROM l WHERE method = 'blink' GROUP BY 1, 2",
    "repository_times": """WITH l AS (SELECT idx, LOWER(target) AS target, ion_mode, method, seconds FROM whole_repository UNPIVOT (seconds FOR method IN (time_open, time_neutral_loss)) WHERE NOT isnan(seconds))
SELECT target, ion_mode, method, COUNT(*) AS n, ROUND(quantile_cont(seconds, 5e-1), 6) AS median, ROUND(MAX(seconds), 6) AS max FROM l WHERE target IS NOT NULL AND ion_mode IS NOT NULL GROUP BY 1, 2, 3""",
    "ion_mode_counts": f"WITH {_SPECTRA} SELECT CASE WHEN charge > 0 THEN 'P' ELSE 'N' END AS ion_mode, COUNT(*) AS n FROM sp WHERE charge <> 0 GROUP BY 1",
    "z_logistic": """WITH s AS (SELECT event_id, value, AVG(value) OVER (PARTITION BY event_type) AS m, STDDEV_POP(value) OVER (PARTITION BY event_type) AS d FROM events)
SELECT event_id, ROUND(1e0 / (1e0 + EXP(-(value - m) / d)), 6) AS z FROM s""",
    "hit_scores_union": "SELECT query_id, spec_id, score FROM hit UNION SELECT spec_id, query_id, score FROM hit",
    "column_standardize": """SELECT DISTINCT spec_id, COALESCE(metadata['title'][1], metadata['name'][1], 'unnamed') AS title,
  COALESCE(metadata['instrument'][1], metadata['instrument_type'][1]) AS device FROM spectrum""",
    "embedding_distances": """WITH u AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS k, ABS(CAST(UNNEST(embedding) AS DOUBLE)) AS x FROM embeddings),
n AS (SELECT vec_id, label, k, x / SUM(x) OVER (PARTITION BY vec_id) AS x FROM u),
ids AS (SELECT vec_id, LEAD(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS nxt FROM embeddings)
SELECT i.vec_id, ROUND(SUM(ABS(a.x - b.x)) + 3e-9, 6) AS manhattan, ROUND(SQRT(SUM((a.x - b.x) * (a.x - b.x))) + 3e-9, 6) AS euclidean,
  ROUND(1e0 - SQRT(SUM(a.x * b.x) * SUM(a.x * b.x) / (SUM(a.x * a.x) * SUM(b.x * b.x))) + 3e-9, 6) AS dot_product
FROM ids i JOIN n a ON a.vec_id = i.vec_id JOIN n b ON b.vec_id = i.nxt AND b.k = a.k GROUP BY i.vec_id""",
    "msp_crlf_roundtrip": _round_trip_sql(),
    "mzml_gz_roundtrip": f"SELECT spec_id, precursor_mz, charge, n_peaks, total FROM ({_round_trip_sql()})",
    "index_roundtrip": f"WITH {PREP} SELECT charge, COUNT(DISTINCT spec_id) AS n_spectra, ROUND(SUM(h), 4) AS total FROM pk WHERE charge IN (1, 2, 3) GROUP BY charge",
    "stream_static_search": f"""WITH {MATCH}, h AS (SELECT query_id, spec_id, {ENTROPY_SQL} AS score FROM prod GROUP BY query_id, spec_id)
SELECT query_id, spec_id, score FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, spec_id) AS rank FROM h) WHERE rank <= 3""",
    "msp_roundtrip": _round_trip_sql(),
    "mgf_roundtrip": _round_trip_sql(),
    "stream_scan_counts": "SELECT strftime(date_trunc('hour', acquired_at), '%Y-%m-%d %H:%M') AS hour, library, COUNT(*) AS n_scans FROM spectrum WHERE acquired_at IS NOT NULL GROUP BY 1, 2",
}
