import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ionloom.operators import hotkeys as H

SCHEMA = "spec_id long, charge int, precursor_mz double, loaded_at long, n_rows string, block int"


def rows(n=600):
    r = random.Random(1)
    out = []
    for i in range(n):
        hot = i % 3 == 0  # one pair holds a third of all rows
        out.append((i, 1 if hot else r.choice([-1, 0, 2, None]), 300.5 if hot else r.choice([101.2, 250.0, 999.9, None, float("nan"), -1.0]), 1, "x", 7))
    return out + out[: n // 5]  # repeated deliveries


def expected(data):
    one = {r[0]: r for r in data}.values()
    return Counter((c, int(m)) for _, c, m, *_ in one if c is not None and m is not None and m == m and m > 0)


def test_pairs_match_a_plain_count(spark):
    data = rows()
    got = {(r.charge, r.mz_bin): r.n_rows for r in H.pair_stats(spark.createDataFrame(data, SCHEMA)).collect()}
    assert got == expected(data)


def test_hot_pairs_threshold_is_inclusive(spark):
    data = [(i, 1, 100.0 if i < 15 else 200.0 + i, 1, "", 0) for i in range(1000)]
    got = {(r.charge, r.mz_bin) for r in H.hot_pairs(spark.createDataFrame(data, SCHEMA)).collect()}
    assert got == {(1, 100)}
    data[14] = (14, 1, 999.0, 1, "", 0)
    assert H.hot_pairs(spark.createDataFrame(data, SCHEMA)).count() == 0


@pytest.mark.parametrize("limit", [H.DICTIONARY_LIMIT, 3])
def test_small_dictionaries_agree(spark, limit):
    df = spark.createDataFrame([("a", 1.0), ("a", None), (None, 2.0), (None, float("nan")), ("b", None), ("c", -3.5), ("a", 4.0)], "k string, v double")
    got = {r.k: tuple(r)[1:] for r in H.aggregate_by_key(df, ["k"], ["v"], limit).collect()}
    assert got == {"a": (3, 2, 5.0, 1.0, 4.0), None: (2, 1, 2.0, 2.0, 2.0), "b": (1, 0, None, None, None), "c": (1, 1, -3.5, -3.5, -3.5)}


def test_many_blocks(spark):
    df = spark.range(20_000).select((F.col("id") % 9001).alias("k"))
    got = H.aggregate_by_key(df, ["k"])
    assert got.count() == 9001
    assert got.agg(F.sum("n_rows"), F.max("n_rows")).first()[:] == (20_000, 3)


def test_empty_table(spark):
    assert H.hot_pairs(spark.createDataFrame([], SCHEMA)).collect() == []
    assert H.aggregate_by_key(spark.createDataFrame([], "k int, v double"), ["k"], ["v"]).collect() == []


def test_latest_delivery_counts(spark):
    data = [(1, 1, 100.0, 1, "", 0), (1, 2, 200.0, 2, "", 0), (None, 1, 100.0, 1, "", 0)]
    got = H.charge_mz_pairs(spark.createDataFrame(data, SCHEMA)).collect()
    assert [tuple(r) for r in got] == [(1, 2, 200, 200.0)]


def test_wide_rows_keep_the_last_delivery(spark, monkeypatch):
    data = [(i, [float(i)], 1) for i in range(50)] + [(i, [-1.0], 2) for i in range(5)] + [(7, [9.0], 1), (None, [0.0], 1)]
    df = spark.createDataFrame(data, "id long, peaks array<double>, at long")
    want = {i: ([-1.0] if i < 5 else [9.0] if i == 7 else [float(i)]) for i in range(50)}
    for rows in (H.REPEATED_ROWS, 1):
        monkeypatch.setattr(H, "REPEATED_ROWS", rows)
        got = H.latest_wide(df, "id", "at", ["peaks"]).collect()
        assert len(got) == 50 and {r.id: r.peaks for r in got} == want


def test_ids_of_several_columns(spark):
    data = [(1, 1, "a", 1), (1, 1, "b", 2), (1, 2, "c", 1), (2, 1, "d", 1), (None, 1, "e", 1), (1, None, "f", 1)]
    df = spark.createDataFrame(data, "r long, i long, v string, at long")
    for f in (H.latest_per_id, H.latest_wide):
        assert {tuple(r) for r in f(df, ["r", "i"], "at", ["v"]).collect()} == {(1, 1, "b"), (1, 2, "c"), (2, 1, "d")}
