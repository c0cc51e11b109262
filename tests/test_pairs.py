import math
import random

import numpy as np
from pyspark.sql import functions as F

from ionloom.functions import distances as D
from ionloom.operators import align as A

SCHEMA = "query_id long, spec_id long, a array<struct<mz double, intensity double>>, b array<struct<mz double, intensity double>>"


def two_pointer(a, b, tol):
    """The loop: every b goes to the first a not below b - tol, if that is not above b + tol."""
    out, used = [[m, i, 0.0] for m, i in a], []
    for m, i in b:
        k = next((k for k, (x, _) in enumerate(a) if x >= m - tol), None)
        if k is not None and a[k][0] <= m + tol:
            out[k][2] += i
        else:
            used.append([m, 0.0, i])
    return sorted(out + used)


def random_pairs(n, seed=0):
    r = random.Random(seed)
    spec = lambda: [(m, float(r.randint(1, 9))) for m in sorted({round(r.uniform(100, 102), 3) for _ in range(r.randint(1, 15))})]
    return [(i, i, spec(), spec()) for i in range(n)]


def test_alignment_is_the_two_pointer_loop(spark):
    data = random_pairs(200)
    df = spark.createDataFrame(data, SCHEMA)
    got = {r.query_id: [[x.mz, x.p, x.q] for x in r.r] for r in df.select("query_id", A.align(F.col("a"), F.col("b"), 0.05).alias("r")).collect()}
    for i, _, a, b in data:
        assert got[i] == two_pointer(a, b, 0.05)


def test_other_alignments(spark):
    df = spark.createDataFrame([(1, 1, [(100.0, 2.0), (200.0, 1.0)], [(99.98, 1.0), (100.02, 3.0), (150.0, 5.0)])], SCHEMA)
    row = df.select(
        A.align_with_mz(F.col("a"), F.col("b")).alias("m"), A.merge(F.col("a"), F.col("b")).alias("s"), A.align_strongest(F.col("a"), F.col("b")).alias("t"),
        A.hybrid_pair(F.col("a"), F.col("b"), F.lit(50.0)).alias("h"), A.align(F.col("a"), F.col("b"), None, 50.0).alias("ppm"),
    ).first()
    assert [tuple(round(v, 3) for v in x) for x in row.m] == [(100.0, 2.0, 100.01, 4.0), (200.0, 1.0, 0.0, 0.0), (0.0, 0.0, 150.0, 5.0)]
    assert [tuple(x) for x in row.s] == [(100.0, 6.0), (150.0, 5.0), (200.0, 1.0)]
    assert [tuple(x) for x in row.t] == [(99.98, 0.0, 1.0), (100.0, 2.0, 3.0), (150.0, 0.0, 5.0), (200.0, 1.0, 0.0)]
    assert [tuple(x) for x in row.h] == [(100.0, 2.0, 4.0), (200.0, 1.0, 5.0)]
    assert len(row.ppm) == 5


def test_equal_mz_nulls_and_empty_lists(spark):
    data = [(1, 1, [(100.0, 2.0), (100.0, 1.0)], [(100.01, 3.0)]), (2, 2, [], [(5.0, 1.0)]), (3, 3, None, [(5.0, 1.0)]), (4, 4, [(5.0, 1.0)], [])]
    df = spark.createDataFrame(data, SCHEMA).coalesce(1)
    cols = [f(F.col("a"), F.col("b")).alias(n) for n, f in (("r", A.align), ("m", A.align_with_mz), ("t", A.align_strongest))]
    got = {x.query_id: x for x in df.select("query_id", *cols, A.hybrid_pair(F.col("a"), F.col("b"), F.lit(None).cast("double")).alias("h")).collect()}
    assert sum(x.q for x in got[1].r) == sum(x.q for x in got[1].m) == sum(x.q for x in got[1].t) == sum(x.q for x in got[1].h) == 3.0
    assert [tuple(x) for x in got[2].r] == [(5.0, 0.0, 1.0)] and [tuple(x) for x in got[4].r] == [(5.0, 1.0, 0.0)]
    assert got[3].r is None and got[3].m is None and got[3].h is None


def entropy(x):
    x = np.array(x) / np.sum(x)
    return float(-sum(v * math.log(v) for v in x if v > 0))


def plain(p, q):
    n, mp, mq = (p > 0).sum(), p.mean(), q.mean()
    d, s, hi, lo = np.abs(p - q), p + q, np.maximum(p, q), np.minimum(p, q)
    root = np.sqrt(p * q).sum()
    dot = 1 - math.sqrt((p @ q) ** 2 / ((p @ p) * (q @ q)))
    e = [0.25 + 0.25 * h if (h := entropy(x)) < 3 else 1.0 for x in (p, q)]
    wp, wq = (np.where(x > 0, x**k, 0) for x, k in zip((p, q), e, strict=True))
    wp, wq = wp / wp.sum(), wq / wq.sum()
    r = q > 0
    pp = (p[r] @ p[r])
    b = math.sqrt(lo.sum() * (max(p.max(), q.max()) - hi).sum())
    cov = ((p - mp) * (q - mq)).sum()
    var = ((p - mp) ** 2).sum() * ((q - mq) ** 2).sum()
    return {
        "unweighted_entropy": 2 * entropy(s) - entropy(p) - entropy(q),
        "entropy": 2 * entropy(wp + wq) - entropy(wp) - entropy(wq),
        "euclidean": math.sqrt((d**2).sum()),
        "chebyshev": d.max(),
        "matusita": math.sqrt(((np.sqrt(p) - np.sqrt(q)) ** 2).sum()),
        "bhattacharya_1": math.acos(min(1, root)) ** 2,
        "bhattacharya_2": -math.log(root) if root else math.inf,
        "ruzicka": d.sum() / hi.sum(),
        "roberts": 1 - (s * lo / hi).sum() / s.sum(),
        "motyka": -lo.sum() / s.sum(),
        "baroni_urbani_buser": 1 - (lo.sum() + b) / (hi.sum() + b),
        "penrose_size": math.sqrt(n) * d.sum(),
        "clark": math.sqrt(((d / s) ** 2).sum() / n),
        "hellinger": math.sqrt(2 * ((np.sqrt(p / mp) - np.sqrt(q / mq)) ** 2).sum()),
        "whittaker_index_of_association": 0.5 * np.abs(p / mp - q / mq).sum(),
        "symmetric_chi_squared": math.sqrt((mp + mq) / (n * (mp + mq) ** 2) * ((p * mq - q * mp) ** 2 / s).sum()),
        "pearson_correlation": -cov / math.sqrt(var) if var > 1e-30 else 0.0,
        "penrose_shape": math.sqrt((((p - mp) - (q - mq)) ** 2).sum()),
        "dot_product": dot,
        "dot_product_reverse": 1 - math.sqrt((p[r] @ q[r]) ** 2 / (pp * (q[r] @ q[r]))) if pp > 0 else 1.0,
        "avg_l": d.sum() + d.max(),
        "divergence": 2 * (d**2 / s**2).sum(),
    }


def test_distances_against_numpy(spark):
    r = np.random.default_rng(0)
    rows, want = [], {}
    for i in range(40):
        p, q = (np.where(r.random(8) < 0.5, 0, r.random(8)) for _ in range(2))
        p[i % 8] += 0.1
        q[(i * 3) % 8] += 0.1
        keep = (p > 0) | (q > 0)
        p, q = p[keep] / p.sum(), q[keep] / q.sum()
        rows.append((i, [(float(k), float(x), float(y)) for k, (x, y) in enumerate(zip(p, q, strict=True))]))
        want[i] = plain(p, q)
    df = spark.createDataFrame(rows, "i int, aligned array<struct<mz double, p double, q double>>")
    for row in D.all_distances(df, list(want[0])).collect():
        for m, v in want[row.i].items():
            assert row[m] == v or abs(row[m] - v) < 1e-9, (m, row[m], v)


def test_normalised_ranges_and_empty_sides(spark):
    df = spark.createDataFrame(random_pairs(60, 3), SCHEMA)
    one = df.select("query_id", A.align(F.col("a"), F.col("b")).alias("aligned"), A.align_with_mz(F.col("a"), F.col("b")).alias("aligned_mz"))
    for row in D.all_distances(one, normalize=True).collect():
        assert all(0 <= row[m] <= 1 for m in D.names())
    assert len(D.names()) == 44
    blank = spark.createDataFrame([(1, [(1.0, 1.0, 0.0)])], "i int, aligned array<struct<mz double, p double, q double>>")
    row = D.all_distances(blank, ["cosine", "canberra"], normalize=True).first()
    assert (row.cosine, row.canberra) == (1.0, 1.0)
    assert D.all_distances(blank, ["cosine"]).first().cosine == math.inf
    try:
        D.distance("no_such", F.col("x"))
    except ValueError:
        return
    raise AssertionError
