"""Searches over a stream of query spectra, and windowed scan counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.readwriter import DataStreamWriter

from ..operators.search import open_search, top_k
from ..operators.weights import ENTROPY, Score


def search_stream(queries: DataFrame, library: DataFrame, sink: Callable[[DataFrame, int], None], k: int = 10, score: Score = ENTROPY) -> DataStreamWriter:
    """Top hits of each micro-batch of query spectra against a static library (best a stored index, which no
    micro-batch has to prepare again).  Scores are rounded to six digits before they are ranked.

    ``sink(hits, batch_id)`` must be idempotent per batch id, as a batch may be replayed.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        hits = open_search(batch, library, score=score)
        sink(top_k(hits.withColumn("score", F.round("score", 6)), k), batch_id)

    return queries.writeStream.foreachBatch(run)


def scan_counts(scans: DataFrame, time: str = "acquired_at", width: str = "10 minutes", late: str = "1 hour", by: str = "library") -> DataFrame:
    """Scans per tumbling window.  In update and append mode rows later than the watermark are dropped, and the
    state of closed windows is too."""
    return (
        scans.withWatermark(time, late)
        .groupBy(F.window(time, width).alias("w"), by)
        .agg(F.count(F.lit(1)).alias("n_scans"))
        .select(F.col("w.start").alias("window_start"), by, "n_scans")
    )
