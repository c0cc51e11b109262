"""Loading delimited lines under an explicit schema, with the bad lines set apart.

Every line is read permissively with Spark's CSV parser under the schema of its
file (column order and delimiter come from the file's header), keeping the raw text of
lines that do not fit.  Only those, and lines with a quote character, are looked at again for quoting
and column count; casts are checked on all.  The first reason that
applies is reported.  All of it is JVM-side column expressions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import spread

#: The columns that the lines of a spectrum table hold.
COLUMNS = ("spec_id", "scan_number", "ms_level", "precursor_mz", "charge", "rt", "num_peaks", "peaks", "title")
DELIMITERS = (",", ";", "\t")
#: A plain decimal number: sign, decimal point and exponent allowed.
NUMBER = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
QUOTED = '"[^"]*+(?:""[^"]*+)*+"'
#: Bytes of header lines up to which the table of files is broadcast.
HEADER_BYTES = 8 << 20


def _lines(raw: DataFrame) -> DataFrame:
    """Lines with their file's delimiter and column order.

    The header table has one row per file.  Its size is measured: a small one is broadcast, so
    that no line is shuffled; a larger one is joined by shuffling, where adaptive execution
    splits files that hold many lines.
    """
    names = F.split(F.lower(F.regexp_replace("line_text", r'["\ufeff ]', "")), "[,;\t]")
    counts = [F.regexp_count("line_text", F.lit(d)).alias(str(i)) for i, d in enumerate(DELIMITERS)]
    best = F.greatest(*[F.struct(c.alias("n"), F.lit(-i).alias("i")) for i, c in enumerate(counts)])
    first = raw.filter(F.col("line_no") == 1)
    heads = (
        first.groupBy("file_name")
        .agg(F.max("line_text").alias("line_text"))
        .select("file_name", names.alias("header"), (-best["i"]).alias("sep"))
    )
    size = first.agg(F.sum(F.length("line_text") + F.length("file_name") + 64)).first()[0] or 0
    body = raw.filter(
        (F.col("line_no") != 1) & (F.length("line_text") > 0) & ~F.startswith(F.col("line_text"), F.lit("#"))
    ).select("file_name", "line_no", "line_text")
    body = spread(body, raw)  # parsing costs far more than moving a small table
    return body.join(F.broadcast(heads) if size <= HEADER_BYTES else heads, "file_name", "left").withColumn("sep", F.coalesce("sep", F.lit(0)))


def _by_sep(make) -> Column:
    out = F.when(F.col("sep") == 0, make(DELIMITERS[0]))
    for i, d in enumerate(DELIMITERS[1:], 1):
        out = out.when(F.col("sep") == i, make(d))
    return out


def _permissive(n: int):
    """The CSV parser's view of a line: n text fields, and the raw text of a line of another count."""
    schema = ", ".join(f"c{i} string" for i in range(n)) + ", corrupt string"

    def parse(d: str) -> Column:
        return F.from_csv(
            "line_text",
            schema,
            {"sep": d, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt", "quote": '"', "escape": '"',
             "maxCharsPerColumn": "-1", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
             "nullValue": "\u0000", "emptyValue": ""},
        )

    return parse


def _well_quoted(d: str) -> Column:
    field = f'(?:{QUOTED}|[^"{d}][^"{d}]*+|)'
    return F.col("line_text").rlike(f"(?s)\\A{field}(?:{d}{field})*+\\z")


def _separators(d: str) -> Column:
    return F.regexp_count(F.regexp_replace("line_text", QUOTED, "q"), F.lit(d))


def peaks_of(text: Column) -> Column:
    """``mz:intensity`` pairs as an array of structs; null where a pair is malformed."""
    pairs = F.filter(F.split(text, " +"), lambda p: p != "")
    cast = F.transform(
        pairs,
        lambda p: F.struct(
            F.when(p.rlike(f"^{NUMBER}:{NUMBER}$"), F.expr("1")).alias("ok"),
            F.try_element_at(F.split(p, ":"), F.lit(1)).try_cast("double").alias("mz"),
            F.try_element_at(F.split(p, ":"), F.lit(2)).try_cast("double").alias("intensity"),
        ),
    )
    good = F.forall(cast, lambda p: p.ok.isNotNull() & (p.mz > 0) & (p.intensity >= 0))
    return F.when(good & (F.size(cast) > 0), F.transform(cast, lambda p: F.struct(p.mz.alias("mz"), p.intensity.alias("intensity"))))


def classify_lines(raw: DataFrame, columns: Sequence[str] = COLUMNS) -> DataFrame:
    """Every non-header line with its fields, its raw text and the ``reason`` it is bad.

    ``columns`` is the schema: the names in the standard order, with ``precursor_mz``, ``num_peaks`` and
    ``peaks`` among them.  ``reason`` is null for a valid line, otherwise the first that applies of
    ``quotes``, ``columns``, ``precursor_mz`` and ``peaks``.  Null and empty lines and
    lines that start with ``#`` are no records.  A file without a header row, or whose header does not name ``columns``, is read as
    comma separated (or by the header's delimiter) in the standard order.  Extra columns of ``raw`` are ignored;
    repeated lines are kept, each with its own verdict.
    """
    n = len(columns)
    df = _lines(raw)
    # explode keeps the optimizer from copying the parser into every use of its result
    df = df.withColumn("__f", F.explode(F.array(_by_sep(_permissive(n)))))
    # the parser mends some bad quoting without a word, so lines with a quote are looked at as well
    doubtful = F.col("__f.corrupt").isNotNull() | F.contains("line_text", F.lit('"'))
    df = df.withColumn("__q", F.when(doubtful, _by_sep(_well_quoted)).otherwise(True))
    df = df.withColumn("__n", F.when(doubtful, _by_sep(_separators) + 1).otherwise(n))
    values = F.array(*[F.col(f"__f.c{i}") for i in range(n)])
    standard = F.array(*[F.lit(c) for c in columns])
    fits = (F.size("header") == n) & (F.size(F.array_intersect(F.col("header"), standard)) == n)
    order = F.when(F.coalesce(fits, F.lit(False)), F.col("header")).otherwise(standard)
    df = df.withColumn("__m", F.explode(F.array(F.map_from_arrays(order, values))))
    get = lambda c: F.coalesce(F.try_element_at("__m", F.lit(c)), F.lit(""))
    mz = F.trim(get("precursor_mz"))
    parsed = F.struct(
        *[get(c).alias(c) for c in columns],
        F.when(mz.rlike(f"^{NUMBER}$"), mz.try_cast("double")).alias("__mz"),
        peaks_of(get("peaks")).alias("__peaks"),
    )
    df = df.select("file_name", "line_no", "line_text", "__q", "__n", F.explode(F.array(parsed)).alias("__p")).select(
        "file_name", "line_no", "line_text", "__q", "__n", "__p.*"
    )
    bad_mz = F.coalesce(~((F.col("__mz") > 0) & (F.col("__mz") < 2000)), F.lit(True))
    told = F.trim("num_peaks")
    # as a number, not cut to a whole one: 2.5 peaks are not 2
    told = F.when(told.rlike(f"^{NUMBER}$"), told.try_cast("double"))
    bad_peaks = F.coalesce(F.size("__peaks").cast("double") != told, F.lit(True)) | F.col("__peaks").isNull()
    reason = (
        F.when(~F.col("__q"), "quotes")
        .when(F.col("__n") != n, "columns")
        .when(bad_mz, "precursor_mz")
        .when(bad_peaks, "peaks")
    )
    return df.withColumn("reason", reason)


def load_rows(raw: DataFrame) -> DataFrame:
    """The valid lines as typed spectra; other fields than precursor and peaks are null where they do not cast."""
    good = classify_lines(raw).filter(F.col("reason").isNull())
    num = lambda c, t: F.trim(c).try_cast(t).alias(c)
    return good.select(
        "file_name",
        "line_no",
        num("spec_id", "long"),
        num("scan_number", "long"),
        num("ms_level", "int"),
        F.col("__mz").alias("precursor_mz"),
        num("charge", "int"),
        num("rt", "double"),
        F.col("__peaks").alias("peaks"),
        "title",
    )


def rejected_rows(raw: DataFrame) -> DataFrame:
    """The lines that do not parse, with the reason and the raw text."""
    return classify_lines(raw).filter(F.col("reason").isNotNull()).select("file_name", "line_no", "reason", "line_text")
