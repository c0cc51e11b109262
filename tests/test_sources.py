import gzip
import zipfile

import pytest
from pyspark.sql import functions as F

from ionloom.functions import chem as C
from ionloom.operators import stats as T
from ionloom.sources import mzml as Z
from ionloom.sources import records as R

MSP = "Name: {name}\nPrecursorMZ: 150.5\nIon_mode: P\nNum peaks: 2\n100.1 1\n101.2 2\n"


def names(df):
    return sorted((r.metadata["name"][0], r.scan_number, len(r.peaks)) for r in df.collect())


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("blank", ["", " \t"])
def test_line_ends(spark, tmp_path, end, blank):
    text = f"{blank}\n".join(MSP.format(name=n) for n in ("a", "b", "c"))
    (tmp_path / "x.msp").write_bytes(text.replace("\n", end).encode())
    assert names(R.read_spectra(spark, str(tmp_path / "x.msp"))) == [("a", 1, 2), ("b", 2, 2), ("c", 3, 2)]


def test_both_line_ends_in_one_folder(spark, tmp_path):
    for name, end in (("u.msp", "\n"), ("w.msp", "\r\n")):
        (tmp_path / name).write_bytes("\n".join(MSP.format(name=name[0] + n) for n in "ab").replace("\n", end).encode())
    assert names(R.read_msp(spark, str(tmp_path))) == [("ua", 1, 2), ("ub", 2, 2), ("wa", 1, 2), ("wb", 2, 2)]


@pytest.mark.parametrize("name,encoding", [("Säure", "utf-8"), ("kyselina dusičná ř", "cp1250"), ("xˆy", "cp1252")])
def test_encodings_are_told_apart(spark, tmp_path, name, encoding):
    (tmp_path / "x.msp").write_bytes(MSP.format(name=name).encode(encoding))
    assert names(R.read_spectra(spark, str(tmp_path / "x.msp")))[0][0] == name.strip()
    assert names(R.read_spectra(spark, str(tmp_path / "x.msp"), encoding=encoding))[0][0] == name.strip()


def test_packed_text(spark, tmp_path):
    text = "\n".join(MSP.format(name=n) for n in "abc")
    (tmp_path / "x.msp.gz").write_bytes(gzip.compress(text.encode()))
    with zipfile.ZipFile(tmp_path / "y.msp.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("inner.msp", text.replace("\n", "\r\n"))
    want = [("a", 1, 2), ("b", 2, 2), ("c", 3, 2)]
    for f in ("x.msp.gz", "y.msp.zip"):
        assert names(R.read_spectra(spark, str(tmp_path / f))) == want
    with pytest.raises(ValueError):
        R.read_msp(spark, str(tmp_path)).count()


def test_mzml_round_trip_and_packing(spark, tmp_path):
    data = [(1, 300.25, 2, [(100.0, 5.0), (101.5, 7.0)]), (2, None, -1, []), (3, 150.0, None, None)]
    df = spark.createDataFrame(data, "scan_number long, precursor_mz double, charge int, peaks array<struct<mz double, intensity double>>").coalesce(1)
    Z.write_mzml(df, str(tmp_path / "out"))
    got = {int(r.native_id[5:]): (r.precursor_mz, r.charge, [tuple(p) for p in r.peaks], r.ms_level) for r in Z.read_mzml(spark, str(tmp_path / "out")).collect()}
    assert got == {i: (m, z, [tuple(p) for p in peaks or []], 2) for i, m, z, peaks in data}
    part = next((tmp_path / "out").glob("*.gz"))
    with zipfile.ZipFile(tmp_path / "a.mzml.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.mzml", gzip.decompress(part.read_bytes()))
    (tmp_path / "b.mzml.gz").write_bytes(part.read_bytes())
    for f in ("a.mzml.zip", "b.mzml.gz"):
        assert R.guess_format(f) == "mzml" and R.read_spectra(spark, str(tmp_path / f)).count() == 3
    (tmp_path / "c.mzml").write_bytes(b"BZh9 no xml")
    with pytest.raises(Exception, match="neither XML"):
        Z.read_mzml(spark, str(tmp_path / "c.mzml")).count()


def test_comments_keep_equal_texts_and_nulls(spark):
    df = spark.createDataFrame([(1, "a=1; b=2; a=3"), (2, "a=1; b=2; a=3"), (3, None), (4, "")], "scan_number long, comments string")
    got = {r.scan_number: r.comments_map for r in R.parse_comments(df).collect()}
    assert got[1] == got[2] == {"a": ["1", "3"], "b": ["2"]} and got[3] is None


def test_exact_quartiles(spark):
    data = [("a", float(i)) for i in range(101)] + [("b", 5.0)] * 40 + [("b", 1.0)] * 3 + [(None, 2.0), (None, 4.0), ("c", None)]
    df = spark.createDataFrame(data, "k string, seconds double").repartition(4)
    got = {r.k: (r.n, r.q1, r.median, r.q3) for r in T.summary(df, ["k"]).collect()}
    want = {r.k: (r.n, *(r.q or (None,) * 3)) for r in df.groupBy("k").agg(F.count("seconds").alias("n"), F.percentile("seconds", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q")).collect()}
    assert got == want


def test_tables_as_text(spark, tmp_path):
    df = spark.createDataFrame([(1, "x,y", [1.5]), (2, None, [])], "a int, b string, c array<double>")
    for sep in (",", "\t"):
        T.write_table(df, str(tmp_path / "t"), sep)
        back = spark.read.option("header", True).option("sep", sep).csv(str(tmp_path / "t")).orderBy("a").collect()
        assert [tuple(r) for r in back] == [("1", "x,y", "[1.5]"), ("2", None, "[]")]


def test_sub_formulas(spark):
    df = spark.createDataFrame([("C2H6O", 14.0, 32.0), (None, 0.0, 9.0), ("H2O", 100.0, 200.0)], "f string, low double, high double")
    got = {r.sub_formula: round(r.sub_mass, 4) for r in C.sub_formulas(df, "f", "low", "high").collect()}
    m = C.ATOM_MASS
    want = {}
    for c in range(3):
        for h in range(7):
            for o in range(2):
                mass = c * m["C"] + h * m["H"] + o * m["O"]
                if 14 <= mass <= 32:
                    want["".join(a + (str(n) if n > 1 else "") for a, n in (("C", c), ("H", h), ("O", o)) if n)] = round(mass, 4)
    assert got == want


def test_group_masses():
    assert abs(C.GROUP_MASS["MeOH"] - 32.02621) < 1e-4 and abs(C.GROUP_MASS["ACN"] - 41.02655) < 1e-4 and abs(C.GROUP_MASS["HFA"] - 165.98533) < 1e-4
