import json

import pytest
from pyspark.sql import functions as F

import ionloom
from ionloom import cli
from ionloom.operators import align as A

RECORD = "Name: {n}\nPrecursorMZ: {m}\nCharge: 1\nNum peaks: 3\n100.0 1\n101.5 2\n{x} 3\n"


def test_every_public_name_is_there():
    for name in ionloom.__all__:
        assert callable(getattr(ionloom, name)) or name in ("ENTROPY", "UNWEIGHTED_ENTROPY", "COSINE")
    with pytest.raises(AttributeError):
        ionloom.no_such_name  # noqa: B018


def test_index_then_search(spark, tmp_path):
    (tmp_path / "lib.msp").write_text("\n".join(RECORD.format(n=n, m=m, x=x) for n, m, x in (("a", 300, 120.0), ("b", 400, 130.0))))
    (tmp_path / "q.msp").write_text(RECORD.format(n="q", m=300.001, x=120.0))
    cli.main(["index", str(tmp_path / "lib.msp"), str(tmp_path / "index")], spark)
    (tmp_path / "c.json").write_text(json.dumps({"mode": "identity", "sep": "\t"}))
    cli.main(["search", str(tmp_path / "q.msp"), str(tmp_path / "index"), str(tmp_path / "hits"), "--config", str(tmp_path / "c.json")], spark)
    got = spark.read.option("header", True).option("sep", "\t").csv(str(tmp_path / "hits")).collect()
    assert len(got) == 1 and abs(float(got[0].score) - 1) < 1e-6 and got[0].matches == "3"
    cli.main(["search", str(tmp_path / "q.msp"), str(tmp_path / "index"), str(tmp_path / "hits"), "--top", "5"], spark)
    assert spark.read.option("header", True).csv(str(tmp_path / "hits")).count() == 2
    (tmp_path / "c.json").write_text(json.dumps({"nonsense": 1}))
    with pytest.raises(SystemExit):
        cli.arguments(["index", "a", "b", "--config", str(tmp_path / "c.json")])


def test_greedy_cosine(spark):
    schema = "a array<struct<mz double, intensity double>>, b array<struct<mz double, intensity double>>"
    data = [
        ([(100.0, 1.0), (100.01, 3.0)], [(100.005, 2.0)]),  # the stronger of two pairs
        ([(100.0, 3.0), (100.015, 2.0)], [(99.99, 1.0), (100.005, 4.0)]),  # greatest product first, then what is left
        ([], [(1.0, 1.0)]), (None, [(1.0, 1.0)]),
    ]
    got = [r.g for r in spark.createDataFrame(data, schema).coalesce(1).select(A.greedy_cosine(F.col("a"), F.col("b")).alias("g")).collect()]
    assert (round(got[0].score, 6), got[0].matches) == (round(6 / (10**0.5 * 2), 6), 1)
    assert (round(got[1].score, 6), got[1].matches) == (round(12 / (13**0.5 * 17**0.5), 6), 1)
    assert (got[2].score, got[2].matches) == (0.0, 0) and got[3] is None


def test_matched_peaks(spark):
    schema = "a array<struct<mz double, intensity double>>, b array<struct<mz double, intensity double>>"
    df = spark.createDataFrame([([(100.0, 1.0), (200.0, 2.0)], [(100.01, 5.0), (300.0, 1.0)])], schema)
    rows = df.select(F.explode(A.matched_peaks(F.col("a"), F.col("b"))).alias("r")).select("r.*").collect()
    assert [(r.mz_a, round(r.mz_b, 2), r.matched) for r in rows] == [(100.0, 100.01, True), (200.0, 0.0, False), (0.0, 300.0, False)]
