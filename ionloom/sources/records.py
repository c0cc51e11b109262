"""Reading and writing MSP and MGF text, gathered into the spectrum schema.

Files are read by Spark's text source with the record separator as line separator, so
a large file is split between tasks; a record's text becomes header fields and peaks
by column expressions.  Compressed text (gz, bz2) is read by the same source, zip files are
unpacked.  Line ends may be of either kind.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FORMATS = ("msp", "mgf", "mzml")
_NUM = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"


def guess_format(path: str) -> str | None:
    """Format by file name; a compression suffix is looked through."""
    parts = path.lower().rstrip("/").split(".")
    if len(parts) > 2 and parts[-1] in ("gz", "bz2", "zip"):
        parts.pop()
    return parts[-1] if parts[-1] in FORMATS else None


def _numbered(df: DataFrame) -> DataFrame:
    """``scan_number`` from 1 within each file, by the order of the records.

    Records are numbered within each split of a file; a split's offset is the count of
    the records in the splits before it, so no task holds more than one split.
    """
    split = ["file_name", "block"]
    df = df.withColumn("__r", F.row_number().over(Window.partitionBy(*split).orderBy("at")))
    counts = df.groupBy(*split).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("file_name").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*split, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    return df.join(starts, split).withColumn("scan_number", (F.col("__before") + F.col("__r")).cast("long"))


def _decoded(value: Column, encoding: str | None) -> Column:
    """Text from the bytes of a record.  Without an ``encoding`` it is UTF-8 where the bytes are, else windows-1250, and
    windows-1252 where a byte has no meaning in that."""
    if encoding is not None and encoding.lower().replace("-", "") == "utf8":
        return value
    if encoding is None:
        none = bytes(i for i in range(128, 256) if bytes([i]).decode("cp1250", "ignore") == "").decode("latin-1")
        bytewise = F.decode(value.cast("binary"), "ISO-8859-1")
        return F.when(F.is_valid_utf8(value), value).when(bytewise.rlike(f"[{none}]"), _single_byte(value, "cp1252")).otherwise(_single_byte(value, "cp1250"))
    return _single_byte(value, encoding)


def _single_byte(value: Column, encoding: str) -> Column:
    upper = bytes(range(128, 256))
    to = "".join(bytes([i]).decode(encoding, "replace") for i in upper)
    return F.translate(F.decode(value.cast("binary"), "ISO-8859-1"), upper.decode("latin-1"), to)


def _unzip(separator: str):
    """mapInArrow function: the records in the members of zip files, as bytes in text columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for k, member in enumerate(n for n in z.namelist() if not n.endswith("/")):
                        parts = z.read(member).replace(b"\r", b"").split(separator.encode())
                        n = len(parts)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(parts, pa.binary()), pa.array([path] * n), pa.array([k] * n, pa.int64()), pa.array(range(n), pa.int64())], ["value", "file_name", "block", "at"]
                        )

    return run


def _text(spark: SparkSession, path: str, separator: str, encoding: str | None) -> DataFrame:
    """Records by ``separator``, with their file, split and place in it.  A zip file is one task's work."""
    shown = spark.read.format("binaryFile").load(path).select("path", "length")
    zipped = shown.filter(F.lower("path").endswith(".zip")).limit(1).count() > 0
    if zipped:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[zZ][iI][pP]").load(path).select("path", "content")
        raw = files.mapInArrow(_unzip(separator), "value binary, file_name string, block long, at long").withColumn("value", F.col("value").cast("string"))
        if shown.filter(~F.lower("path").endswith(".zip")).limit(1).count():
            raise ValueError("zip files and others in one folder: read them apart")
        return raw.withColumn("value", _decoded(F.col("value"), encoding))
    if separator == "\n\n":
        # files with Windows line ends have another separator; which ones is looked up first
        lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("f"), F.endswith("value", F.lit("\r")).alias("cr"))
        ends = lines.groupBy("f").agg(F.max("cr").alias("cr")).collect()  # one row per file
        reads = [(sep, [r["f"] for r in ends if r["cr"] == cr]) for sep, cr in (("\n\n", False), ("\n\r\n", True))]
    else:
        reads = [(separator, [path])]
    out = None
    for sep, paths in reads:
        if not paths:
            continue
        raw = spark.read.option("lineSep", sep).text(paths).select(
            F.regexp_replace(_decoded(F.col("value"), encoding), "\r", "").alias("value"), F.col("_metadata.file_path").alias("file_name"),
            F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"),
        )
        out = raw if out is None else out.unionByName(raw)
    if out is None:
        return spark.createDataFrame([], "value string, file_name string, block long, at long")
    return out


def _peaks(lines: Column, limit: Column | None = None) -> Column:
    """Lines with at least two numbers as peaks; the first ``limit`` of them."""
    rows = F.filter(lines, lambda x: x.rlike(rf"^\s*{_NUM}[\s,;]+{_NUM}"))
    if limit is not None:
        rows = F.slice(rows, 1, F.greatest(limit, F.lit(0)))
    part = lambda x, g: F.regexp_extract(x, rf"^\s*({_NUM})[\s,;]+({_NUM})", g).try_cast("double")
    return F.transform(rows, lambda x: F.struct(part(x, 1).alias("mz"), part(x, 2).alias("intensity")))


def _grouped(keys: Column, values: Column) -> Column:
    """``map<string, array<string>>``: values of a repeated key in order."""
    pairs = F.arrays_zip(keys.alias("k"), values.alias("v"))
    names = F.array_distinct(keys)
    return F.map_from_arrays(names, F.transform(names, lambda n: F.transform(F.filter(pairs, lambda p: p.k == n), lambda p: p.v)))


def _charge(text: Column) -> Column:
    """``2+``, ``+2``, ``-1``, ``1-``, ``1`` as a signed number."""
    digits = F.regexp_extract(text, "([0-9]+)", 1).try_cast("int")
    return F.when(text.contains("-"), -digits).otherwise(digits)


def _first(meta: Column, *names: str) -> Column:
    return F.coalesce(*[F.try_element_at(F.try_element_at(meta, F.lit(n)), F.lit(1)) for n in names])


def read_msp(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """MSP records: ``key: value`` lines up to ``Num peaks: n``, then n peaks.

    Records are parted by blank lines.  Keys are lower-cased; a repeated key keeps all its
    values.  A record may have no peaks; text without a ``Num peaks`` line is no record.
    """
    raw = _text(spark, path, "\n\n", encoding)
    # blank lines may hold blanks
    raw = raw.select("file_name", "block", "at", F.posexplode(F.split("value", r"\n[ \t]*\n")).alias("part", "value")).withColumn("at", F.struct("at", "part"))
    raw = raw.filter(F.col("value").rlike(r"(?i)num peaks\s*:"))
    lines = F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "")
    df = raw.withColumn("lines", lines)
    is_num = lambda x: F.lower(x).rlike(r"^\s*num peaks\s*:")
    at = F.array_position(F.transform("lines", is_num), True)
    df = df.withColumn("n", at.cast("int"))
    df = df.withColumn("head", F.slice("lines", F.lit(1), F.col("n") - 1)).withColumn("head", F.filter("head", lambda x: x.contains(":")))
    df = df.withColumn("count", F.regexp_extract(F.get("lines", F.col("n") - 1), r":\s*([0-9]+)", 1).try_cast("int"))
    df = df.withColumn("body", F.slice("lines", F.col("n") + 1, F.greatest(F.lit(1), F.size("lines"))))
    keys = F.transform("head", lambda x: F.lower(F.trim(F.substring_index(x, ":", 1))))
    values = F.transform("head", lambda x: F.trim(F.regexp_replace(x, "^[^:]*:", "")))
    df = _numbered(df).withColumn("meta", _grouped(keys, values))
    m = F.col("meta")
    mode = F.lower(F.coalesce(_first(m, "ion_mode", "ionmode", "ion mode"), F.lit("")))
    charge = F.coalesce(_charge(_first(m, "charge", "precursor_charge")), F.when(mode.startswith("p"), 1).when(mode.startswith("n"), -1))
    return df.select(
        "file_name",
        "scan_number",
        F.coalesce(F.regexp_extract(_first(m, "ms_level", "spectrum_type"), "([0-9])", 1).try_cast("int"), F.lit(2)).alias("ms_level"),
        _first(m, "precursormz", "precursor_mz", "pepmass").try_cast("double").alias("precursor_mz"),
        charge.alias("charge"),
        F.regexp_extract(_first(m, "retentiontime", "rt", "retention_time"), rf"({_NUM})", 1).try_cast("double").alias("rt"),
        _peaks(F.col("body"), F.col("count")).alias("peaks"),
        F.col("meta").alias("metadata"),
    )


def read_mgf(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """MGF records between ``BEGIN IONS`` and ``END IONS``.

    ``#`` lines and blank lines are skipped; ``PEPMASS`` gives the precursor (its first
    number); other ``KEY=value`` lines are metadata under lower-case keys.
    """
    raw = _text(spark, path, "END IONS", encoding)
    raw = raw.filter(F.col("value").contains("BEGIN IONS")).withColumn("value", F.substring_index("value", "BEGIN IONS", -1))
    lines = F.filter(F.split("value", "\n"), lambda x: (F.trim(x) != "") & ~F.ltrim(x).startswith("#"))
    df = _numbered(raw).withColumn("lines", lines).withColumn("head", F.filter("lines", lambda x: x.rlike(r"^\s*[A-Za-z][^=]*=")))
    keys = F.transform("head", lambda x: F.lower(F.trim(F.substring_index(x, "=", 1))))
    values = F.transform("head", lambda x: F.trim(F.regexp_replace(x, "^[^=]*=", "")))
    df = df.withColumn("meta", _grouped(keys, values))
    m = F.col("meta")
    return df.select(
        "file_name",
        "scan_number",
        F.coalesce(_first(m, "mslevel", "ms_level").try_cast("int"), F.lit(2)).alias("ms_level"),
        F.regexp_extract(_first(m, "pepmass"), rf"(^NaN\b|{_NUM})", 1).try_cast("double").alias("precursor_mz"),
        _charge(_first(m, "charge")).alias("charge"),
        _first(m, "rtinseconds").try_cast("double").alias("rt"),
        _peaks(F.filter("lines", lambda x: ~x.rlike(r"^\s*[A-Za-z][^=]*="))).alias("peaks"),
        F.col("meta").alias("metadata"),
    )


def read_spectra(spark: SparkSession, path: str, kind: str | None = None, ms2_only: bool = False, encoding: str | None = None) -> DataFrame:
    """Any supported format, with ``uniqid``: a 60-bit hash of the file name plus the scan number."""
    kind = kind or guess_format(path)
    if kind == "msp":
        df = read_msp(spark, path, encoding)
    elif kind == "mgf":
        df = read_mgf(spark, path, encoding)
    elif kind == "mzml":
        from .mzml import read_mzml

        df = read_mzml(spark, path)
    else:
        raise ValueError(f"unknown spectrum format: {path}")
    uniq = F.conv(F.substring(F.md5("file_name"), 1, 15), 16, 10).cast("long") + F.col("scan_number")
    df = df.withColumn("uniqid", uniq)
    return df.filter(F.col("ms_level") == 2) if ms2_only else df


def _peak_lines(peaks: Column) -> Column:
    return F.transform(peaks, lambda p: F.concat_ws(" ", p.mz.cast("string"), p.intensity.cast("string")))


def _meta_lines(meta: Column, sep: str, skip: tuple[str, ...], upper: bool = False) -> Column:
    entries = F.filter(F.map_entries(meta), lambda e: ~e.key.isin(*skip) & ~e.key.startswith("_"))
    name = (lambda e: F.upper(e.key)) if upper else (lambda e: e.key)
    rows = F.transform(entries, lambda e: F.transform(e.value, lambda v: F.concat(name(e), F.lit(sep), v)))
    return F.flatten(rows)


_CORE = ("num peaks", "precursormz", "precursor_mz", "pepmass", "charge", "rtinseconds", "retentiontime", "ms_level", "mslevel")


def format_msp(df: DataFrame) -> DataFrame:
    """One text per spectrum, ready for the text sink."""
    head = F.array_compact(
        F.array(
            F.concat(F.lit("precursormz: "), F.col("precursor_mz").cast("string")),
            F.concat(F.lit("charge: "), F.col("charge").cast("string")),
            F.concat(F.lit("retentiontime: "), F.col("rt").cast("string")),
            F.concat(F.lit("ms_level: "), F.col("ms_level").cast("string")),
        )
    )
    peaks = F.coalesce("peaks", F.array().cast("array<struct<mz double, intensity double>>"))
    lines = F.concat(head, F.coalesce(_meta_lines(F.col("metadata"), ": ", _CORE), F.array().cast("array<string>")), F.array(F.concat(F.lit("Num peaks: "), F.size(peaks).cast("string"))), _peak_lines(peaks))
    return df.select(F.concat(F.array_join(lines, "\n"), F.lit("\n")).alias("value"))


def format_mgf(df: DataFrame) -> DataFrame:
    sign = F.when(F.col("charge") < 0, "-").otherwise("+")
    head = F.array_compact(
        F.array(
            F.lit("BEGIN IONS"),
            F.concat(F.lit("PEPMASS="), F.col("precursor_mz").cast("string")),
            F.concat(F.lit("CHARGE="), F.abs("charge").cast("string"), sign),
            F.concat(F.lit("RTINSECONDS="), F.col("rt").cast("string")),
            F.concat(F.lit("MSLEVEL="), F.col("ms_level").cast("string")),
        )
    )
    peaks = F.coalesce("peaks", F.array().cast("array<struct<mz double, intensity double>>"))
    lines = F.concat(head, F.coalesce(_meta_lines(F.col("metadata"), "=", _CORE, True), F.array().cast("array<string>")), _peak_lines(peaks), F.array(F.lit("END IONS\n")))
    return df.select(F.array_join(lines, "\n").alias("value"))


def write_spectra(df: DataFrame, path: str, kind: str | None = None) -> None:
    """Write a folder of MSP or MGF text files."""
    kind = kind or guess_format(path)
    if kind not in ("msp", "mgf"):
        raise ValueError(f"cannot write {kind}")
    (format_msp(df) if kind == "msp" else format_mgf(df)).write.mode("overwrite").text(path)


def parse_comments(df: DataFrame, column: str = "comments") -> DataFrame:
    """``comments_map``: the packed ``name=content`` items as a map of lists (see ``packed``).
    Equal texts are split once and have equal maps; a null text has none."""
    from ..operators.packed import split_packed

    text = df.select(F.col(column).alias("__text")).filter("__text is not null").distinct()
    items = split_packed(text.withColumn("__key", F.col("__text")), "__key", "__text")
    one = items.groupBy("__key").agg(F.sort_array(F.collect_list(F.struct("item_no", "name", "content"))).alias("items"))
    names = F.transform("items", lambda x: x["name"])
    values = F.transform("items", lambda x: x["content"])
    maps = one.select("__key", _grouped(names, values).alias("comments_map"))
    return df.join(maps, df[column] == maps["__key"], "left").drop("__key")
