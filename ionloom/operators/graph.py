"""Similarity graphs as edge tables ``(src, dst, score)``."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage


def _state(links: DataFrame) -> tuple:
    """Size and hash sums of a table of distinct links: equal tables have equal ones."""
    h = lambda seed: F.sum(F.xxhash64(F.lit(seed), "u", "v").cast("decimal(38,0)"))
    return tuple(links.agg(F.count(F.lit(1)), h(1), h(2)).first())


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(node, component)``: the smallest node each node is connected with.

    Alternating large-star and small-star contractions: every round attaches
    neighbours to the smallest one in reach, so the rounds grow with the logarithm of
    the longest path; they end when nothing changes.  The edge table is written to the shared checkpoint
    folder each round; only its size and the sum of its hashes reach the driver.  Edges with a null
    end are ignored, self-edges keep their node.
    """
    both = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).filter("u is not null and v is not null")
    nodes = both.select(F.col("u").alias("node")).union(both.select("v")).distinct()
    links = cut_lineage(both.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _state(links)
    while state[0]:
        # large star: neighbours greater than u go to the smallest of u and its neighbours
        sym = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sym.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = sym.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        # small star: neighbours not greater than u, and u itself, go to the smallest
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u")
        small = (
            moved.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low.select("u", F.col("m").alias("v")))
            .filter("u != v")
            .distinct()
        )
        small = cut_lineage(small)
        links, before, state = small, state, _state(small)
        if state == before:
            break
    roots = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.join(roots, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def top_k_edges(edges: DataFrame, k: int) -> DataFrame:
    """Per node of either end the score of its k-th best edge: ``(node, cut)``."""
    ends = edges.select(F.col("src").alias("node"), "score").unionAll(edges.select(F.col("dst").alias("node"), "score"))
    w = Window.partitionBy("node").orderBy(F.desc("score"))
    return ends.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).groupBy("node").agg(F.min("score").alias("cut"))


def mutual_top_k(edges: DataFrame, k: int) -> DataFrame:
    """Edges that are among the k best of both ends; ties with the k-th are kept."""
    cut = top_k_edges(edges, k)
    a = cut.select(F.col("node").alias("src"), F.col("cut").alias("cut_a"))
    b = cut.select(F.col("node").alias("dst"), F.col("cut").alias("cut_b"))
    kept = edges.join(a, "src").join(b, "dst").filter("score >= cut_a and score >= cut_b")
    return kept.select("src", "dst", "score")


def _grow(limit: int):
    """Edges of one group between clusters of known sizes, best first: an edge is kept
    when its clusters, with what has been joined to them, stay within ``limit``."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "src", "dst"], ascending=[False, True, True])
        head: dict = {}
        size = dict(zip(pdf["a"], pdf["na"], strict=True)) | dict(zip(pdf["b"], pdf["nb"], strict=True))

        def find(x):
            while head.setdefault(x, x) != x:
                head[x] = head[head[x]]
                x = head[x]
            return x

        keep = []
        for s, d in zip(pdf["a"], pdf["b"], strict=True):
            a, b = find(s), find(d)
            ok = a == b or size[a] + size[b] <= limit
            if ok and a != b:
                a, b = min(a, b), max(a, b)
                head[b], size[a] = a, size[a] + size[b]
            keep.append(ok)
        return pdf.loc[keep, ["src", "dst", "score", "a", "b"]]

    return run


def capped_components(edges: DataFrame, limit: int, bands: int = 4) -> DataFrame:
    """Edges added by falling score so that no component exceeds ``limit`` nodes (0: no cap).

    The outcome is that of adding the edges one by one (ties: smaller src, dst).  Edges
    are taken in ``bands`` of falling score.  Within a band an edge inside a cluster is
    kept, one whose clusters together exceed the limit never can be; only the rest
    depends on order, and only within its connected component of clusters, which is
    what one task handles.  Clusters are as large as the limit at most, and full ones
    no longer connect anything.
    """
    if not limit:
        return edges.select("src", "dst", "score")
    edges = cut_lineage(edges.select("src", "dst", "score"))
    cuts = edges.approxQuantile("score", [i / bands for i in range(1, bands)], 0.01)
    bounds = [None, *sorted(set(cuts), reverse=True), None]
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    member = cut_lineage(nodes.withColumn("c", F.col("node")))
    kinds = dict(edges.dtypes)
    schema = f"src {kinds['src']}, dst {kinds['dst']}, score {kinds['score']}, a {kinds['src']}, b {kinds['src']}"
    kept = None
    for high, low in zip(bounds, bounds[1:], strict=False):
        band = edges if high is None else edges.filter(F.col("score") <= high)
        band = band if low is None else band.filter(F.col("score") > low)
        sizes = member.groupBy("c").agg(F.count(F.lit(1)).alias("n"))
        named = member.join(sizes, "c")
        for end, c, n in (("src", "a", "na"), ("dst", "b", "nb")):
            band = band.join(named.select(F.col("node").alias(end), F.col("c").alias(c), F.col("n").alias(n)), end)
        band = cut_lineage(band)
        inner = band.filter("a = b").select("src", "dst", "score")
        open_ = band.filter((F.col("a") != F.col("b")) & (F.col("na") + F.col("nb") <= limit))
        groups = connected_components(open_, "a", "b").select(F.col("node").alias("a"), F.col("component").alias("g"))
        added = cut_lineage(open_.join(groups, "a").groupBy("g").applyInPandas(_grow(limit), schema))
        found = inner.unionByName(added.select("src", "dst", "score"))
        kept = found if kept is None else kept.unionByName(found)
        merged = connected_components(added, "a", "b").select(F.col("node").alias("c"), F.col("component").alias("to"))
        member = cut_lineage(member.join(merged, "c", "left").select("node", F.coalesce("to", "c").alias("c")))
    return kept
