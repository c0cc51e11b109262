from ionloom.operators import badrows as B

HEAD = "spec_id,scan_number,ms_level,precursor_mz,charge,rt,num_peaks,peaks,title"
MIXED = "peaks;title;precursor_mz;charge;rt;num_peaks;spec_id;scan_number;ms_level"
GOOD = "1,2,2,300.5,1,9.5,2,100:1 200.5:0,name"
LINES = {
    GOOD: None,
    '1,2,2," 3.1e2 ",,,"1","100:1","a, ""b"""': None,
    "1,2,2,+.5,1,,1,1e2:.5,": None,
    '1,2,2,300,1,,1,"100:1,x': "quotes",
    '1,2,2,300,1,,1,"100:1"x,t': "quotes",
    '1,2,2,300,1,,1,10"0:1,t': "quotes",
    '1,2,2,300,1,,1,100:1,t "q"': "quotes",
    "1,2,2,300,1,,1,100:1": "columns",
    "1,2,2,300,1,,1,100:1,t,u": "columns",
    "x": "columns",
    "1,2,2,0,1,,1,100:1,t": "precursor_mz",
    "1,2,2,2000,1,,1,100:1,t": "precursor_mz",
    "1,2,2,-5,1,,1,bad,t": "precursor_mz",
    "1,2,2,,1,,1,100:1,t": "precursor_mz",
    "1,2,2,NaN,1,,1,100:1,t": "precursor_mz",
    "1,2,2,1d2,1,,1,100:1,t": "precursor_mz",
    "1,2,2,300,1,,1,100_1,t": "peaks",
    "1,2,2,300,1,,2,100:1,t": "peaks",
    "1,2,2,300,1,,0,,t": "peaks",
    "1,2,2,300,1,,1,0:1,t": "peaks",
    "1,2,2,300,1,,1,100:-1,t": "peaks",
    "1,2,2,300,1,,1,100:1:2,t": "peaks",
    "1,2,2,300,1,,x,100:1,t": "peaks",
    "1,2,2,300,1,,1.5,100:1,t": "peaks",
    "1,2,2,300,1,,1.0,100:1,t": None,
    '1,2,2,300,1,,1,100:1,"a,b': "quotes",
    '1,2,2,300,1,,1, "100:1",t': "quotes",
    '1,2,2,300,1,,1,100:1,"t",u': "columns",
}


def frame(spark, lines):
    return spark.createDataFrame([(*r, "clash") for r in lines], "file_name string, line_no int, line_text string, reason string")


def test_reasons(spark):
    rows = [("a", 1, HEAD)] + [("a", i + 2, t) for i, t in enumerate(LINES)] + [("a", 90, ""), ("a", 91, "# note"), ("a", 92, None)]
    got = {r.line_text: r.reason for r in B.classify_lines(frame(spark, rows)).collect()}
    assert got == LINES


def test_delimiters_and_order(spark):
    tab = HEAD.replace(",", "\t")
    rows = [
        ("s", 1, MIXED), ("s", 2, '"100:1  200:2";a,b;300.25;-2;;2;7;8;2'), ("s", 3, "100:1;x;300;1;;1;7;8"),
        ("t", 1, tab), ("t", 2, GOOD.replace(",", "\t")), ("t", 2, GOOD.replace(",", "\t")),
    ]
    df = frame(spark, rows)
    got = sorted((r.file_name, r.spec_id, r.precursor_mz, r.charge, r.title, len(r.peaks)) for r in B.load_rows(df).collect())
    assert got == [("s", 7, 300.25, -2, "a,b", 2), ("t", 1, 300.5, 1, "name", 2), ("t", 1, 300.5, 1, "name", 2)]
    assert [tuple(r)[:3] for r in B.rejected_rows(df).collect()] == [("s", 3, "columns")]


def test_file_without_header_and_empty(spark):
    assert B.load_rows(frame(spark, [("n", 2, GOOD)])).count() == 1
    assert B.rejected_rows(frame(spark, [])).collect() == []


def test_long_line(spark):
    peaks = " ".join(f"{i}.5:{i}" for i in range(1, 30_001))
    rows = [("a", 1, HEAD), ("a", 2, f'1,2,2,300,1,,30000,"{peaks}",t'), ("a", 3, '1,2,2,300,1,,1,"' + "x" * 300_000)]
    got = {r.line_no: r.reason for r in B.classify_lines(frame(spark, rows)).collect()}
    assert got == {2: None, 3: "quotes"}


def test_other_schemas_and_headers_too_large_to_broadcast(spark, monkeypatch):
    cols = ("peaks", "num_peaks", "precursor_mz")
    rows = [("a", 1, "num_peaks;precursor_mz;peaks"), ("a", 2, "1;300;100:1"), ("a", 3, "2;300;100:1"), ("a", 4, "1;300"), ("b", 2, "100:1,1,300"), ("c", 1, "x,y,z"), ("c", 2, "100:1,1,300")]
    want = {("a", 2, None), ("a", 3, "peaks"), ("a", 4, "columns"), ("b", 2, None), ("c", 2, None)}
    for size in (B.HEADER_BYTES, 0):
        monkeypatch.setattr(B, "HEADER_BYTES", size)
        got = B.classify_lines(frame(spark, rows), cols)
        assert {(r.file_name, r.line_no, r.reason) for r in got.collect()} == want


def test_only_doubtful_lines_are_read_again(spark):
    plan = B.rejected_rows(frame(spark, [("a", 1, HEAD), ("a", 2, GOOD)]))._jdf.queryExecution().optimizedPlan().toString()
    assert "corrupt" in plan
