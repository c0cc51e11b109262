import random

import pyarrow as pa
import pytest

from ionloom.operators import packed as P

CASES = {
    "adduct=[M+H]+, InChI=1S/C25/c1-7,7-2/h1H, Synonym=2-x": [("adduct", "[M+H]+"), ("inchi", "1S/C25/c1-7,7-2/h1H"), ("synonym", "2-x")],
    "'merged'": [("merged", "")],
    'S="b"|S=7-n\t"SMILES=NC(=O)C=CS";T=C(=O)C': [("s", "b"), ("s", "7-n"), ("smiles", "NC(=O)C=CS"), ("t", "C(=O)C")],
    '"ce=35 (NCE)" "collision energy=ramp 20, 40; 60" \'origin=\'': [("ce", "35 (NCE)"), ("collision energy", "ramp 20, 40; 60"), ("origin", "")],
    "A = C(=O)C=C, b = 3": [("a", "C(=O)C=C"), ("b", "3")],
    'note="drift \\"quill\\" grove"|low signal': [("note", 'drift "quill" grove'), ("low signal", "")],
    '"note=sedge ""ember"" x";;DB=""': [("note", 'sedge "ember" x'), ("db", "")],
    "DB= , a=q , ce=35": [("db", ""), ("a", "q"), ("ce", "35")],
    "low signal ce=5": [("low signal", ""), ("ce", "5")],
    "x='it''s', y=\"\"\"q\"\"\"": [("x", "it's"), ("y", '"q"')],
    'a="never closed; b=2': [("a", '"never closed'), ("b", "2")],
    "Synonym=5'-t, \"Synonym=3,5-p\" adduct=[M+H]+ origin=": [("synonym", "5'-t"), ("synonym", "3,5-p"), ("adduct", "[M+H]+"), ("origin", "")],
    ",a=1,,b=2;c": [("a", "1"), ("b", "2"), ("c", "")],
    'é=ü;"ß=1"': [("é", "ü"), ("ß", "1")],
    "author=plume=drift\nZ=1\r\nq": [("author", "plume=drift"), ("z", "1"), ("q", "")],
    "": [],
    " ; | ": [],
    '""': [],
    "=": [],
}


def items(texts):
    t = P.split_batch(pa.array(range(len(texts))), pa.array(texts, pa.string())).to_pylist()
    out = [[] for _ in texts]
    for r in t:
        assert r["item_no"] == len(out[r["id"]]) + 1
        out[r["id"]].append((r["name"], r["content"]))
    return out


@pytest.mark.parametrize("text", list(CASES))
def test_cases(text):
    assert items([text]) == [CASES[text]]


def test_a_batch_equals_its_rows():
    texts = [None, *CASES] * 3
    random.Random(4).shuffle(texts)
    assert items(texts) == [CASES.get(t, []) for t in texts]


def test_sliced_arrays():
    arr = pa.array(["x=1", "a=1;b=2", None, "c=3"])
    got = P.split_batch(pa.array([5, 6, 7]), arr.slice(1)).to_pylist()
    assert [(r["id"], r["name"]) for r in got] == [(5, "a"), (5, "b"), (7, "c")]


def plain(text):
    """Character by character, for texts without quotes."""
    out, cur = [], ""
    for i, c in enumerate(text):
        if c in ";|\t\n\r":
            out.append(cur)
            cur = ""
        else:
            cur += c
    out.append(cur)
    return [(x.split("=", 1)[0].strip().lower(), x.split("=", 1)[1].strip() if "=" in x else "") for x in out if x.strip()]


def test_random_unquoted_texts():
    r = random.Random(0)
    texts = ["".join(r.choice("abC=;|\t\n1-") for _ in range(r.randint(0, 40))) for _ in range(500)]
    want = [[x for x in plain(t) if x != ("", "")] for t in texts]
    assert items(texts) == want


def test_quoted_round_trip():
    r = random.Random(2)
    for _ in range(200):
        pairs = [(r.choice(["ce", "Note", "x.y"]), "".join(r.choice("ab ,;|='\"\t") for _ in range(r.randint(0, 8)))) for _ in range(r.randint(1, 5))]
        text = r.choice([";", "|", ", ", " "]).join('"' + f"{k}={v}".replace('"', '""') + '"' for k, v in pairs)
        assert items([text]) == [[(k.lower(), v.strip()) for k, v in pairs]]


def test_dataframe(spark):
    df = spark.createDataFrame([(1, "a=1;b", "x"), (1, "a=1;b", "y"), (2, None, "z"), (3, "  ", "")], "spec_id long, comments string, name string")
    got = sorted(tuple(r) for r in P.split_packed(df, "spec_id", "comments").collect())
    assert got == [(1, 1, "a", "1"), (1, 1, "a", "1"), (1, 2, "b", ""), (1, 2, "b", "")]
    assert P.split_packed(df.limit(0), "spec_id", "comments").collect() == []


def test_very_long_text():
    n = 20_000
    got = items([";".join(f"k{i}=v{i}" for i in range(n))])[0]
    assert len(got) == n and got[-1] == (f"k{n - 1}", f"v{n - 1}")
