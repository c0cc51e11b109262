import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionloom.llm import quantiles as Q


def exact(values, pct):
    v = sorted(values)
    return v[math.ceil(pct / 100 * len(v)) - 1]


def test_cells_keep_order_and_width():
    r = random.Random(3)
    xs = [0.0, 1e-320, 1.0, 2.0, 0.5, 1e300] + [r.lognormvariate(0, 8) for _ in range(2000)]
    xs = np.array(sorted(xs + [-x for x in xs]))
    cells = Q.cell_of(xs)
    assert (np.diff(cells) >= 0).all() and 0 <= cells[0] and cells[-1] < 1 << Q.UNIVERSE_BITS
    assert Q.cell_of(np.array([-0.0])) == Q.cell_of(np.array([0.0]))
    big = np.abs(xs) > 1e-300
    assert (np.abs(Q.value_of(cells) - xs) <= np.abs(xs) * 2**-13 * 1.001)[big].all()


def digest_check(spark, values, k):
    df = spark.createDataFrame([("g", float(v)) for v in values], "k string, v double").repartition(4)
    d = Q.build_digest(df, ["k"], "v", k).cache()
    n = len(values)
    assert d.agg(F.sum("n")).first()[0] == n
    for r in Q.quantiles(d, ["k"], [1, 10, 50, 90, 99]).collect():
        wide = abs(r.value) * 2**-12
        rank = sum(v <= r.value + wide for v in values)
        low = sum(v < r.value - wide for v in values)
        want, slack = math.ceil(r.pct / 100 * n), Q.UNIVERSE_BITS * (n // k)
        assert low - slack <= want <= rank + slack
    return d


@pytest.mark.parametrize("k", [50, 8192])
def test_rank_error_is_bounded(spark, k):
    r = np.random.default_rng(0)
    values = np.concatenate([r.lognormal(0, 2, 6000), np.full(2000, 0.25), r.uniform(-1e6, 1e6, 500), -r.lognormal(0, 2, 3000)])
    d = digest_check(spark, values.tolist(), k)
    assert d.count() == 1
    if k == 50:
        assert d.select(F.size("nodes")).first()[0] <= 3 * k * 1.2  # the tree stays small


def test_compression_keeps_totals_and_limits():
    r = np.random.default_rng(1)
    keys, n = np.repeat([0, 1, 2], [5000, 40, 3000]), 8040
    tree = (keys.astype(np.int64) << (Q.UNIVERSE_BITS + 1)) | ((1 << Q.UNIVERSE_BITS) + Q.cell_of(r.normal(size=n)))
    tree, counts = np.unique(tree, return_counts=True)
    got, m = Q._compress(tree, counts.astype(np.int64), 100)
    code, node = got >> (Q.UNIVERSE_BITS + 1), got & ((1 << (Q.UNIVERSE_BITS + 1)) - 1)
    for c, size in ((0, 5000), (1, 40), (2, 3000)):
        assert m[code == c].sum() == size
        inner = m[(code == c) & (node < 1 << Q.UNIVERSE_BITS)]
        assert len(inner) == 0 or inner.max() <= size // 100
    assert (code == 1).sum() == 40 and (np.diff(got) > 0).all()


def test_small_groups_are_exact(spark):
    vals = [3.0, 1.0, 2.0, 10.0, 7.0]
    df = spark.createDataFrame([(v,) for v in vals], "v double").withColumn("k", F.lit(1))
    got = {r.pct: r.value for r in Q.quantiles(Q.build_digest(df, ["k"], "v"), ["k"], [50, 90]).collect()}
    for p in (50, 90):
        assert abs(got[p] - exact(vals, p)) <= exact(vals, p) * 2**-12


def test_negative_values_count(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (-3, -2, -1, 1, 2)], "k string, v double")
    r = Q.quantiles(Q.build_digest(df, ["k"], "v"), ["k"], [50]).first()
    assert r.n_rows == 5 and abs(r.value + 1) < 2**-12


def test_digests_of_days_combine(spark):
    r = np.random.default_rng(5)
    days = [r.lognormal(i, 1, 3000) for i in range(3)]
    parts = [Q.build_digest(spark.createDataFrame([("g", float(v)) for v in d], "k string, v double"), ["k"], "v", 100) for d in days]
    merged = Q.merge_digests(parts, ["k"], 100)
    every = np.concatenate(days)
    for q in Q.quantiles(merged, ["k"], [50, 90]).collect():
        assert q.n_rows == len(every)
        rank = (every <= q.value).mean() * 100
        assert abs(rank - q.pct) <= 100 * Q.UNIVERSE_BITS / 100


def test_many_keys_and_small_memory(spark, monkeypatch):
    data = [(i % 700, i % 3 if i % 3 else None, float(i)) for i in range(9000)]
    df = spark.createDataFrame(data, "a int, b int, v double").repartition(5)
    want = {}
    for a, b, v in data:
        want.setdefault((a, b), []).append(v)
    d = Q.build_digest(df, ["a", "b"], "v")
    got = {(r.a, r.b): (r.value, r.n_rows) for r in Q.quantiles(d, ["a", "b"], [50]).collect()}
    assert got.keys() == want.keys()
    assert all(n == len(want[k]) and abs(v - exact(want[k], 50)) <= max(1.0, v) * 2**-12 for k, (v, n) in got.items())
    coarse = {r.b: r.n_rows for r in Q.quantiles(Q.merge_digests([d], ["b"]), ["b"], [50]).collect()}
    assert coarse == {None: 3000, 1: 3000, 2: 3000}


def test_trees_given_in_pieces_add_up():
    import pyarrow as pa

    batches = [pa.RecordBatch.from_arrays([pa.array(["a", "b"] * 500), pa.array(np.arange(1000.0) + 1000 * i)], ["k", "x"]) for i in range(6)]
    held, Q.HELD, pending, Q.PENDING = Q.HELD, 1500, Q.PENDING, 700
    try:
        pieces = list(Q._build(1, None)(iter(batches)))
    finally:
        Q.HELD, Q.PENDING = held, pending
    assert len(pieces) > 1 and sum(sum(p.column("n").to_pylist()) for p in pieces) == 6000
    table = pa.Table.from_batches(pieces).sort_by("k").to_batches(max_chunksize=1)
    rows = [r for b in Q._merge(1, None, True)(iter(table)) for r in b.to_pylist()]
    assert [(r["k"], r["n"]) for r in rows] == [("a", 3000), ("b", 3000)]


def test_bad_values_null_keys_and_clashing_columns(spark):
    data = [("a", 1.0, 5), ("a", None, 5), ("a", float("nan"), 5), ("a", float("inf"), 5), ("a", float("-inf"), 5), (None, 2.0, 5), (None, 2.0, 5), ("b", None, 5)]
    df = spark.createDataFrame(data, "k string, v double, nodes int")
    got = {(r.k, r.n_rows) for r in Q.quantiles(Q.build_digest(df, ["k"], "v"), ["k"], [50]).collect()}
    assert got == {("a", 1), (None, 2)}
    assert Q.quantiles(Q.build_digest(df.limit(0), ["k"], "v"), ["k"], [50]).collect() == []
