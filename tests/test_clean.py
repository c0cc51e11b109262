import numpy as np
import pytest
from pyspark.sql import functions as F

from ionloom.functions import spectral as S
from ionloom.operators import clean as C

SCHEMA = "spec_id long, precursor_mz double, peaks array<struct<mz double, intensity double>>, status string"


def frame(spark, rows):
    return spark.createDataFrame([(i, p, k, "clash") for i, p, k in rows], SCHEMA).drop("status")


def peaks(df, i=1):
    return [(round(p.mz, 6), round(p.intensity, 6)) for p in df.filter(F.col("spec_id") == i).first().peaks]


def slow_centroid(mz, inten, tol):
    """The greedy pass written out with lists."""
    pts = sorted(zip(mz, inten, strict=True))
    while any(b[0] - a[0] < tol for a, b in zip(pts, pts[1:], strict=False)):
        left, new = list(pts), []
        for p in sorted(pts, key=lambda p: (-p[1], p[0])):
            if p in left:
                near = [x for x in left if p[0] - tol <= x[0] <= p[0] + tol]
                left = [x for x in left if x not in near]
                t = sum(x[1] for x in near)
                new.append((sum(x[0] * x[1] for x in near) / t, t))
        if len(new) == len(pts):
            break
        pts = sorted(new)
    return pts


def test_centroid_against_a_plain_version():
    r = np.random.default_rng(1)
    for _ in range(200):
        mz = np.unique(np.round(r.uniform(100, 101, r.integers(1, 25)), 3))
        inten = r.permutation(len(mz)) + 1.0
        a, b = C.centroid(mz, inten, 0.05)
        want = slow_centroid(mz.tolist(), inten.tolist(), 0.05)
        assert np.allclose(a, [p[0] for p in want]) and np.allclose(b, [p[1] for p in want])
        assert abs(b.sum() - inten.sum()) < 1e-9


def test_centroid_ppm():
    mz, inten = np.array([1000.0, 1000.004, 1000.02]), np.array([1.0, 3.0, 1.0])
    a, _ = C.centroid(mz, inten, None, 10.0)
    assert np.allclose(a, [1000.003, 1000.02])


def test_whole_chain(spark):
    raw = [(41.04, 0.3716), (0.0, 0.3716), (69.07, 7.917962), (69.07, -7.917962), (69.071, 100.0), (86.0969, 66.83), (86.01, 10.0)]
    df = frame(spark, [(1, 200.0, raw)])
    got = peaks(C.clean_spectra(df))
    assert [round(m, 3) for m, _ in got] == [69.071, 86.01, 86.097] and abs(sum(i for _, i in got) - 1) < 1e-5
    assert len(peaks(C.clean_spectra(df, max_peaks=2))) == 2
    assert [m for m, _ in peaks(C.clean_spectra(df, noise=0.0, normalize=False, min_mz=41.04, max_mz=86.01))] == [41.04, pytest.approx(69.0709, abs=1e-3), 86.01]
    assert [m for m, _ in peaks(C.clean_spectra(df, noise=0.0, min_mz=41.04, max_mz=86.01, inclusive=False))] == [pytest.approx(69.0709, abs=1e-3)]
    with pytest.raises(ValueError):
        C.clean_spectra(df, tol_da=None)


def test_nulls_nan_and_empty(spark):
    nan = float("nan")
    df = frame(spark, [(1, 100.0, None), (2, 100.0, []), (3, 100.0, [(nan, 1.0), (50.0, nan), (None, 2.0), (60.0, 3.0)]), (4, None, [(5.0, 1.0)])])
    out = C.clean_spectra(df)
    assert [len(peaks(out, i)) for i in (1, 2, 3, 4)] == [0, 0, 1, 1]
    assert C.clean_spectra(df.limit(0)).collect() == []


def test_isotopes_merge_into_the_base():
    mz = np.array([200.0, 201.00866, 202.0173, 300.0, 301.0087])
    inten = np.array([100.0, 10.0, 1.0, 10.0, 50.0])
    a, b = C.remove_isotopes(mz, inten, 0.05)
    assert a.tolist() == [200.0, 300.0, 301.0087] and b.tolist() == [111.0, 10.0, 50.0]
    same = np.array([100.0, 101.0, 102.0])
    assert C.remove_isotopes(same, np.ones(3), 0.05)[0].tolist() == same.tolist()


def test_gap_merging_keeps_single_peaks():
    a, b = C.merge_gaps(np.array([1.0, 1.03, 1.06, 2.0]), np.array([1.0, 2.0, 1.0, 5.0]), 0.05)
    assert np.allclose(a, [1.03, 2.0]) and b.tolist() == [4.0, 5.0] and a[1] == 2.0


def test_validation_codes(spark):
    one = [(100.0, 1.0)]
    df = frame(spark, [(1, 2000.0, one), (2, -0.1, one), (3, 500.0, []), (4, 101.0, one), (5, 500.0, one), (6, None, one), (7, float("nan"), one), (8, 5.0, None)])
    got = {r.spec_id: r.status for r in C.validate(df).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 0, 6: 2, 7: 2, 8: 3}


def test_standardize(spark):
    df = spark.createDataFrame([(1, {"rt": ["x"], "retention": ["2.5"], "q": ["1"]}), (2, {}), (3, None)], "id int, metadata map<string, array<string>>")
    out = {r.id: r for r in C.standardize(df, {"rt_s": (["rt", "retention"], -1.0, "double")}, keep=False).collect()}
    assert [out[i].rt_s for i in (1, 2, 3)] == [2.5, -1.0, -1.0] and list(out[1].metadata) == ["q"]


def test_column_functions(spark):
    df = frame(spark, [(1, 100.0, [(10.0, 1.0), (20.0, 3.0)]), (2, 100.0, [(10.0, 0.0)])])
    p = F.col("peaks")
    r = df.select("spec_id", S.entropy(S.normalize(p)).alias("e"), S.normalize_l2(p).alias("l2"), S.neutral_loss(p, F.col("precursor_mz")).alias("nl")).collect()
    assert abs(r[0].e - 0.5623351446) < 1e-9 and abs(sum(x.intensity**2 for x in r[0].l2) - 1) < 1e-12
    assert [x.mz for x in r[0].nl] == [80.0, 90.0] and r[1].l2 is None
    z = S.logistic_z(spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 7.0), ("b", None)], "k string, v double"), "v", ["k"]).collect()
    assert sorted(round(x.z, 6) if x.z is not None else -1 for x in z) == [-1, 0.268941, 0.5, 0.731059]
