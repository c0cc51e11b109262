import itertools
import json
import random

import numpy as np

from ionloom.operators import drift as D

SCHEMA = "feed string, file_name string, record_no int, exported_at long, body string, field string, type string"


def table(spark, files):
    """files: (feed, file, time, [dict or text])"""
    data = []
    for feed, name, at, records in files:
        for i, rec in enumerate(records):
            data.append((feed, name, i, at, rec if rec is None or isinstance(rec, str) else json.dumps(rec), "clash", "clash"))
    return spark.createDataFrame(data, SCHEMA)


def changes(spark, files):
    return {tuple(r) for r in D.schema_changes(table(spark, files)).select("file_name", "change", "field_before", "field_after").collect()}


def spec(i):
    r = random.Random(i)
    return {"id": i, "mz": round(r.uniform(50, 900), 4), "z": r.choice([1, -1, 2]), "rt": round(r.uniform(0, 1800), 2), "title": f"compound {r.random():.6f}"}


def test_renames_retypes_and_order(spark):
    a = [{"spec_id": s["id"], "PepMass": s["mz"], "charge": f"{abs(s['z'])}{'+' if s['z'] > 0 else '-'}", "rt": s["rt"], "title": s["title"]} for s in map(spec, range(20))]
    b = [{"spec_id": s["id"], "precursor": [s["mz"], 12.5], "CHARGE": s["z"], "rt": str(s["rt"]), "energy": 30} for s in map(spec, range(10, 30))]
    c = [{"spec_id": s["id"], "precursor": f"{s['mz']} 99.1", "z": float(s["z"]), "rtmin": s["rt"] / 60, "Energy": 30.0} for s in map(spec, range(20, 40))]
    files = [("f", "c", 30, c), ("f", "a", 10, a), ("f", "b", 20, b), ("g", "only", 5, a)]
    assert changes(spark, files) == {
        ("b", "renamed", "pepmass", "precursor"),
        ("b", "retyped", "pepmass", "precursor"),
        ("b", "retyped", "charge", "charge"),
        ("b", "retyped", "rt", "rt"),
        ("b", "removed", "title", ""),
        ("b", "added", "", "energy"),
        ("c", "retyped", "precursor", "precursor"),
        ("c", "renamed", "charge", "z"),
        ("c", "retyped", "charge", "z"),
        ("c", "renamed", "rt", "rtmin"),
        ("c", "retyped", "rt", "rtmin"),
        ("c", "retyped", "energy", "energy"),
    }


def test_nulls_bad_bodies_and_lost_files(spark):
    files = [
        ("f", "a", 1, [{"spec_id": 1, "x": 5, "y": None}, {"spec_id": 1, "x": 5, "y": None}, None, "no json", "[1]"]),
        ("f", "b", 2, [None, "{}"]),
        ("f", "c", 3, [{"spec_id": 1, "x": 5, "y": True}]),
    ]
    assert changes(spark, files) == {
        ("b", "removed", "spec_id", ""),
        ("b", "removed", "x", ""),
        ("c", "added", "", "spec_id"),
        ("c", "added", "", "x"),
        ("c", "added", "", "y"),
    }


def test_empty(spark):
    assert D.schema_changes(spark.createDataFrame([], SCHEMA)).collect() == []


def test_unify_brings_names_together(spark):
    a = [{"spec_id": s["id"], "pepmass": s["mz"]} for s in map(spec, range(12))]
    b = [{"spec_id": s["id"], "parent": f"{s['mz']} 7.5"} for s in map(spec, range(6, 18))]
    got = D.unify(table(spark, [("f", "a", 1, a), ("f", "b", 2, b)]), core=["spec_id"]).collect()
    assert len(got) == 24
    assert {tuple(sorted(r.fields)) for r in got} == {("parent", "spec_id")}
    assert {r.fields["parent"] for r in got if r.spec_id == "7"} == {str(spec(7)["mz"])}


def test_assignment_is_optimal():
    r = np.random.default_rng(0)
    for n, m in [(1, 1), (2, 4), (4, 3), (5, 5)]:
        cost = r.normal(size=(n, m))
        got = sum(cost[i, j] for i, j in D.assign(cost))
        small, big = (cost, m) if n <= m else (cost.T, n)
        best = min(sum(small[i, p[i]] for i in range(len(small))) for p in itertools.permutations(range(big), len(small)))
        assert abs(got - best) < 1e-9
    assert D.assign(np.zeros((0, 3))) == []


def test_names_of_one_feed_hide_no_value_of_another(spark):
    a = [{"spec_id": s["id"], "a": s["mz"]} for s in map(spec, range(12))]
    b = [{"spec_id": s["id"], "b": s["mz"]} for s in map(spec, range(6, 18))]
    both = [{"spec_id": s["id"], "a": 5, "b": 9} for s in map(spec, range(4))]
    got = D.unify(table(spark, [("x", "x1", 1, a), ("x", "x2", 2, b), ("y", "y1", 1, both)])).collect()
    assert {tuple(sorted(r.fields)) for r in got if r.feed == "x"} == {("a", "spec_id")}
    assert {(r.fields["a"], r.fields["b"]) for r in got if r.feed == "y"} == {("5", "9")}


def test_a_name_used_again_for_another_quantity(spark):
    # a becomes b; later a column a comes anew beside b
    one = [{"spec_id": s["id"], "a": s["mz"]} for s in map(spec, range(12))]
    two = [{"spec_id": s["id"], "b": s["mz"]} for s in map(spec, range(6, 18))]
    three = [{"spec_id": s["id"], "b": s["mz"], "a": s["rt"]} for s in map(spec, range(10, 20))]
    got = D.unify(table(spark, [("x", "1", 1, one), ("x", "2", 2, two), ("x", "3", 3, three)])).collect()
    third = [r for r in got if r.file_name == "3"]
    assert len(third) == 10
    assert all({r.fields[k] for k in r.fields if k != "spec_id"} == {str(spec(int(r.fields["spec_id"]))["mz"]), str(spec(int(r.fields["spec_id"]))["rt"])} for r in third)


def test_typed_columns(spark):
    a = [{"spec_id": s["id"], "PepMass": s["mz"], "charge": f"{abs(s['z'])}{'+' if s['z'] > 0 else '-'}"} for s in map(spec, range(12))]
    b = [{"Spec_ID": str(s["id"]), "precursor_mz": [s["mz"], 12.5], "charge": float(s["z"])} for s in map(spec, range(6, 18))]
    c = [{"spec_id": s["id"], "precursor_mz": "none"} for s in map(spec, range(16, 19))]
    core = {"spec_id": ("spec_id", "long"), "mz": ("precursor_mz", "double"), "pepmass": ("precursor_mz", "string"), "charge": ("charge", "int")}
    got = D.unify(table(spark, [("f", "a", 1, a), ("f", "b", 2, b), ("f", "c", 3, c)]), core).collect()
    assert len(got) == 27
    for r in got:
        s = spec(r.spec_id)
        assert r.mz == (None if r.file_name == "c" else s["mz"]) and r.charge == (None if r.file_name == "c" else s["z"])
        assert r.pepmass == {"a": str(s["mz"]), "b": f"[{s['mz']},12.5]", "c": "none"}[r.file_name]


def test_truth_values_in_other_words(spark):
    a = [{"spec_id": i, "checked": i % 3 == 0, "other": i % 2 == 0} for i in range(12)]
    b = [{"spec_id": i, "is_reference": "yes" if i % 3 == 0 else "No", "z": "yes"} for i in range(12)]
    assert ("b", "renamed", "checked", "is_reference") in changes(spark, [("f", "a", 1, a), ("f", "b", 2, b)])


def test_profiles_in_pieces_unite(spark):
    many = [{"spec_id": i, "x": i * 1.5, "t": f"text {i}"} for i in range(400)]
    moved = [{"spec_id": i, "y": i * 1.5, "u": f"TEXT {i}"} for i in range(200, 600)]
    df = table(spark, [("f", "a", 1, many), ("f", "b", 2, moved)]).repartition(6)
    want = {("b", "renamed", "x", "y"), ("b", "renamed", "t", "u")}
    for sketch, held in ((1024, 400_000), (64, 100)):
        prof = D.cut_lineage(D.profile_fields(df, sketch=sketch, held=held))
        got = D._changes(prof, D.file_order(prof), D._kinds(prof), sketch)
        assert {tuple(r)[1:] for r in got.collect()} == want
        assert prof.agg({"h": "count"}).first()[0] > 8
