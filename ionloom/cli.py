"""Two steps on files: store a library, then search it.

    python -m ionloom.cli index library.msp lib/
    python -m ionloom.cli search queries.mgf lib/ hits/ --mode open --top 10

Both take ``--config FILE``, a JSON object of option names and values; options on the command
line count before it.
"""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import search as X
from .operators.clean import PRECURSOR_GAP, clean_spectra
from .operators.index import read_index, write_index
from .operators.stats import write_table
from .operators.weights import COSINE, ENTROPY, UNWEIGHTED_ENTROPY, peak_table
from .sources.records import read_spectra

SCORES = {s.name: s for s in (ENTROPY, UNWEIGHTED_ENTROPY, COSINE)}
MODES = {"open": X.open_search, "identity": X.identity_search, "neutral_loss": X.neutral_loss_search, "hybrid": X.hybrid_search}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="ionloom", description=__doc__.split("\n")[0])
    steps = p.add_subparsers(dest="step", required=True)
    for name in ("index", "search"):
        s = steps.add_parser(name)
        s.add_argument("spectra", help="MSP, MGF or mzML, packed or not")
        s.add_argument("library", help="folder of the stored library")
        s.add_argument("--config")
        s.add_argument("--kind", choices=["msp", "mgf", "mzml"], default=None)
        s.add_argument("--score", choices=list(SCORES), default="entropy")
        s.add_argument("--noise", type=float, default=0.01)
        if name == "search":
            s.add_argument("hits", help="folder of the result table")
            s.add_argument("--mode", choices=list(MODES), default="open")
            s.add_argument("--tol", type=float, default=X.MS2_TOLERANCE)
            s.add_argument("--top", type=int, default=0, help="hits per query, 0 for all")
            s.add_argument("--sep", default=",")
    return p


def arguments(argv: Sequence[str] | None = None) -> argparse.Namespace:
    """Options from the command line, then from the JSON file, then their defaults."""
    p = parser()
    first = p.parse_args(argv)
    if first.config:
        with open(first.config) as f:
            given = json.load(f)
        unknown = set(given) - set(vars(first))
        if unknown:
            raise SystemExit(f"unknown options: {', '.join(sorted(unknown))}")
        p._subparsers._group_actions[0].choices[first.step].set_defaults(**given)
        first = p.parse_args(argv)
    return first


def _cleaned(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    df = read_spectra(spark, a.spectra, a.kind).withColumn("spec_id", F.col("uniqid"))
    known = df.filter(F.col("charge").isNotNull() & (F.col("precursor_mz") > 0) & ~F.isnan("precursor_mz"))
    clean = clean_spectra(known.select("spec_id", "charge", "precursor_mz", "peaks"), max_mz=F.col("precursor_mz") - PRECURSOR_GAP, noise=a.noise)
    return clean.filter(F.size("peaks") > 0)


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    a = arguments(argv)
    spark = spark or SparkSession.builder.appName("ionloom").getOrCreate()
    if a.step == "index":
        write_index(_cleaned(spark, a), a.library, SCORES[a.score])
        return
    q = peak_table(_cleaned(spark, a), SCORES[a.score])
    hits = MODES[a.mode](q, read_index(spark, a.library), tol=a.tol, score=SCORES[a.score])
    write_table(X.top_k(hits, a.top) if a.top else hits, a.hits, a.sep)


if __name__ == "__main__":
    main()
