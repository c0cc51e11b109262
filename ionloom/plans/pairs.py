"""Registered queries on pairs of spectra: alignments and the distance catalogue.

Pairs are the distinct (query, spectrum) pairs of the ``hit`` table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import distances as D
from ..operators import align as A
from ..operators import search as X
from ..operators.weights import ENTROPY, entropy_weigh
from ..session import cut_lineage, table
from .common import MATCH, PREP, cleaned, queries_of

TOL = 0.05


def _pairs(spark, sf_dir) -> DataFrame:
    return A.pair_peaks(table(spark, sf_dir, "hit"), cleaned(spark, sf_dir))


def _aligned(spark, sf_dir) -> DataFrame:
    """Pairs with both alignments, each computed once per row."""
    p = _pairs(spark, sf_dir)
    both = F.explode(F.array(F.struct(A.align(F.col("a"), F.col("b"), TOL).alias("aligned"), A.align_with_mz(F.col("a"), F.col("b"), TOL).alias("aligned_mz"))))
    return p.select("query_id", "spec_id", both.alias("x")).select("query_id", "spec_id", "x.*")


def align_two(spark, sf_dir):
    rows = _pairs(spark, sf_dir).select("query_id", "spec_id", F.explode(A.align(F.col("a"), F.col("b"), TOL)).alias("r"))
    return rows.select("query_id", "spec_id", F.round("r.mz", 5).alias("mz"), F.round("r.p", 6).alias("p"), F.round("r.q", 6).alias("q"))


def align_with_mz(spark, sf_dir):
    rows = _pairs(spark, sf_dir).select("query_id", "spec_id", F.explode(A.align_with_mz(F.col("a"), F.col("b"), TOL)).alias("r"))
    return rows.select(
        "query_id", "spec_id", F.round("r.mz_a", 5).alias("mz_a"), F.round("r.p", 6).alias("p"), F.round("r.mz_b", 5).alias("mz_b"), F.round("r.q", 6).alias("q")
    )


def matched_mask(spark, sf_dir):
    """Both peak lists of a pair side by side, with the matched peaks marked."""
    rows = _pairs(spark, sf_dir).select("query_id", "spec_id", F.explode(A.matched_peaks(F.col("a"), F.col("b"), TOL)).alias("r"))
    return rows.select("query_id", "spec_id", F.round("r.mz_a", 5).alias("mz_a"), F.round("r.mz_b", 5).alias("mz_b"), "r.matched")


def greedy_cosine_pairs(spark, sf_dir):
    """Cosine of the hits' spectra with peaks paired one to one, the greatest products first."""
    g = A.greedy_cosine(F.col("a"), F.col("b"), X.MS2_TOLERANCE)
    p = _pairs(spark, sf_dir).select("query_id", "spec_id", F.explode(F.array(g)).alias("g"))
    return p.select("query_id", "spec_id", F.round("g.score", 6).alias("score"), "g.matches")


def merge_two(spark, sf_dir):
    rows = _pairs(spark, sf_dir).select("query_id", "spec_id", F.explode(A.merge(F.col("a"), F.col("b"), TOL)).alias("r"))
    return rows.select("query_id", "spec_id", F.round("r.mz", 5).alias("mz"), F.round("r.intensity", 6).alias("intensity"))


def align_strongest(spark, sf_dir):
    """Matched peaks only, the strongest counterpart per peak."""
    rows = _pairs(spark, sf_dir).select("query_id", "spec_id", F.explode(A.align_strongest(F.col("a"), F.col("b"), TOL)).alias("r"))
    return rows.filter("r.p > 0 and r.q > 0").select("query_id", "spec_id", F.round("r.mz", 5).alias("mz"), F.round("r.q", 6).alias("q"))


def pair_entropy_similarity(spark, sf_dir):
    """Similarity of the weighted spectra by full alignment, without an index."""
    weighed = cleaned(spark, sf_dir).withColumn("peaks", entropy_weigh(F.col("peaks")))
    p = A.pair_peaks(table(spark, sf_dir, "hit"), weighed).select("query_id", "spec_id", A.align(F.col("a"), F.col("b"), X.MS2_TOLERANCE).alias("r"))
    d = D.distance("unweighted_entropy", F.col("r"))
    return p.select("query_id", "spec_id", F.round(D.similarity("unweighted_entropy", d), 6).alias("score"))


def pair_hybrid_similarity(spark, sf_dir):
    """Entropy similarity where peaks may also match after the precursor shift."""
    r = A.hybrid_pair(F.col("a"), F.col("b"), F.col("a_mz") - F.col("b_mz"), TOL)
    p = _pairs(spark, sf_dir).select("query_id", "spec_id", r.alias("r"))
    d = D.distance("entropy", F.col("r"))
    return p.select("query_id", "spec_id", F.round(D.similarity("entropy", d), 6).alias("score"))


def reverse_entropy_similarity(spark, sf_dir):
    """Similarity to the query's peaks that the library spectrum has, and their share of intensity."""
    p = _aligned(spark, sf_dir)
    seen = F.filter("aligned", lambda r: r.q > 0)
    p = p.select("query_id", "spec_id", F.explode(F.array(seen)).alias("r"))
    matched = F.aggregate("r", F.lit(0.0), lambda s, x: s + x.p)
    d = D.distance("unweighted_entropy", F.col("r"))
    score = F.when(matched > 0, D.similarity("unweighted_entropy", d)).otherwise(0.0)
    return p.select("query_id", "spec_id", F.round(score, 6).alias("score"), F.round(matched, 6).alias("matched_intensity"))


def fast_vs_naive_error(spark, sf_dir):
    """Greatest difference between the indexed and the pairwise score, per query."""
    lib = cleaned(spark, sf_dir)
    fast = X.open_search(queries_of(lib), lib)
    weighed = lib.withColumn("peaks", ENTROPY.weigh(F.col("peaks")))
    p = A.pair_peaks(fast, weighed).select("query_id", "spec_id", A.align(F.col("a"), F.col("b"), X.MS2_TOLERANCE).alias("r"))
    naive = p.select("query_id", "spec_id", D.similarity("unweighted_entropy", D.distance("unweighted_entropy", F.col("r"))).alias("score"))
    return X.score_errors(fast, naive).select("query_id", F.round("max_error", 5).alias("max_error"))


#: SQL of the methods, over the groups of ``st`` (aligned rows with means mp, mq and maxima).
SQL = {
    "euclidean": "SQRT(SUM((p-q)*(p-q)))",
    "manhattan": "SUM(ABS(p-q))",
    "chebyshev": "MAX(ABS(p-q))",
    "squared_euclidean": "SUM((p-q)*(p-q))",
    "canberra": "SUM(ABS(p-q)/(p+q))",
    "lorentzian": "SUM(LN(1e0+ABS(p-q)))",
    "avg_l": "SUM(ABS(p-q))+MAX(ABS(p-q))",
    "wave_hedges": "SUM(ABS(p-q)/GREATEST(p,q))",
    "penrose_size": "SQRT(COUNT(*) FILTER (p>0))*SUM(ABS(p-q))",
    "mean_character": "SUM(ABS(p-q))/COUNT(*) FILTER (p>0)",
    "clark": "SQRT(SUM(((p-q)/(p+q))*((p-q)/(p+q)))/COUNT(*) FILTER (p>0))",
    "absolute_value": "SUM(ABS(p-q))/SUM(p)",
    "ruzicka": "SUM(ABS(p-q))/SUM(GREATEST(p,q))",
    "roberts": "1e0-SUM((p+q)*LEAST(p,q)/GREATEST(p,q))/SUM(p+q)",
    "intersection": "1e0-SUM(LEAST(p,q))/LEAST(SUM(p),SUM(q))",
    "motyka": "-SUM(LEAST(p,q))/SUM(p+q)",
    "baroni_urbani_buser": "1e0-(SUM(LEAST(p,q))+SQRT(SUM(LEAST(p,q))*SUM(GREATEST(xp,xq)-GREATEST(p,q))))/(SUM(GREATEST(p,q))+SQRT(SUM(LEAST(p,q))*SUM(GREATEST(xp,xq)-GREATEST(p,q))))",
    "improved_similarity": "SQRT(SUM(((p-q)/(p+q))*((p-q)/(p+q)))/COUNT(*) FILTER (p>0))",
    "fidelity": "1e0-SUM(SQRT(p*q))",
    "matusita": "SQRT(SUM((SQRT(p)-SQRT(q))*(SQRT(p)-SQRT(q))))",
    "squared_chord": "SUM((SQRT(p)-SQRT(q))*(SQRT(p)-SQRT(q)))",
    "bhattacharya_1": "POWER(ACOS(LEAST(1e0,SUM(SQRT(p*q)))),2e0)",
    "bhattacharya_2": "CASE WHEN SUM(SQRT(p*q))>0 THEN -LN(SUM(SQRT(p*q))) END",
    "harmonic_mean": "1e0-2e0*SUM(p*q/(p+q))",
    "hellinger": "SQRT(2e0*SUM(POWER(SQRT(p/mp)-SQRT(q/mq),2e0)))",
    "probabilistic_symmetric_chi_squared": "5e-1*SUM((p-q)*(p-q)/(p+q))",
    "symmetric_chi_squared": "SQRT((MAX(mp)+MAX(mq))*SUM(POWER(p*mq-q*mp,2e0)/(p+q))/(COUNT(*) FILTER (p>0)*POWER(MAX(mp)+MAX(mq),2e0)))",
    "vicis_symmetric_chi_squared_3": "SUM((p-q)*(p-q)/GREATEST(p,q))",
    "divergence": "2e0*SUM((p-q)*(p-q)/((p+q)*(p+q)))",
    "whittaker_index_of_association": "5e-1*SUM(ABS(p/mp-q/mq))",
    "penrose_shape": "SQRT(SUM(POWER((p-mp)-(q-mq),2e0)))",
    "pearson_correlation": "CASE WHEN SUM(POWER(p-mp,2e0))*SUM(POWER(q-mq,2e0))>1e-24 THEN -SUM((p-mp)*(q-mq))/SQRT(SUM(POWER(p-mp,2e0))*SUM(POWER(q-mq,2e0))) ELSE 0e0 END",
    "dot_product": "1e0-SQRT(SUM(p*q)*SUM(p*q)/(SUM(p*p)*SUM(q*q)))",
    "cosine": "1e0-SQRT(SUM(p*q)*SUM(p*q)/(SUM(p*p)*SUM(q*q)))",
    "dot_product_reverse": "CASE WHEN COALESCE(SUM(p*p) FILTER (q>0),0e0)>0 THEN 1e0-SQRT(SUM(p*q)*SUM(p*q)/(SUM(p*p) FILTER (q>0)*SUM(q*q))) ELSE 1e0 END",
    "spectral_contrast_angle": "1e0-SUM(p*q)/SQRT(SUM(p*p)*SUM(q*q))",
    "jaccard": "SUM((p-q)*(p-q))/SUM(p*p+q*q-p*q)",
    "dice": "SUM((p-q)*(p-q))/SUM(p*p+q*q)",
    "inner_product": "1e0-SUM(p*q)",
}

FAMILIES = {
    "distances_l_family": ["euclidean", "manhattan", "chebyshev", "squared_euclidean", "canberra", "lorentzian", "avg_l", "wave_hedges", "penrose_size", "mean_character", "clark", "absolute_value", "improved_similarity"],
    "distances_overlap_family": ["ruzicka", "roberts", "intersection", "motyka", "baroni_urbani_buser", "jaccard", "dice", "inner_product"],
    "distances_fidelity_family": ["fidelity", "matusita", "squared_chord", "bhattacharya_1", "bhattacharya_2", "harmonic_mean", "hellinger"],
    "distances_chi_family": ["probabilistic_symmetric_chi_squared", "symmetric_chi_squared", "vicis_symmetric_chi_squared_3", "divergence"],
    "distances_correlation": ["whittaker_index_of_association", "penrose_shape", "pearson_correlation", "dot_product", "cosine", "dot_product_reverse", "spectral_contrast_angle"],
}


def _off_tie(x):
    """Rounding is moved off values with few digits, which engines round differently."""
    return F.round(x + 3e-9, 6) + 0.0


def _family(methods: list[str]):
    def query(spark, sf_dir):
        df = D.all_distances(_aligned(spark, sf_dir), methods)
        return df.select("query_id", "spec_id", *[_off_tie(F.when(F.col(m) != D.INF, F.col(m))).alias(m) for m in methods])

    return query


def distances_entropy_family(spark, sf_dir):
    df = D.all_distances(_aligned(spark, sf_dir), ["unweighted_entropy", "entropy"])
    return df.select("query_id", "spec_id", *[_off_tie(F.col(m)).alias(m) for m in ("unweighted_entropy", "entropy")])


def distances_ms(spark, sf_dir):
    methods = ["weighted_dot_product", "ms_for_id_v1", "ms_for_id"]
    df = D.all_distances(_aligned(spark, sf_dir), methods)
    return df.select("query_id", "spec_id", *[(F.round(F.when(F.col(m) != D.INF, F.col(m)) + 3e-9, 5) + 0.0).alias(m) for m in methods])


def normalized_similarity(spark, sf_dir):
    """All 44 methods as similarities from 0 to 1 (SQL covers one of each kind of range)."""
    df = D.all_distances(_aligned(spark, sf_dir), ["manhattan", "canberra", "motyka", "pearson_correlation", "bhattacharya_2"], normalize=True, as_similarity=True)
    return df.select("query_id", "spec_id", *[_off_tie(F.col(m)).alias(m) for m in ("manhattan", "canberra", "motyka", "pearson_correlation", "bhattacharya_2")])


def all_similarities(spark, sf_dir):
    """Every method of the catalogue, normalised."""
    return D.all_distances(_aligned(spark, sf_dir), normalize=True, as_similarity=True)


def _alignment(tol: str, source: str = "nm", value: str = "n") -> str:
    return f"""
pr AS (SELECT DISTINCT query_id, spec_id FROM hit),
pa AS (SELECT pr.query_id, pr.spec_id, x.mz, x.{value} AS v FROM pr JOIN {source} x ON x.spec_id = pr.query_id),
pb AS (SELECT pr.query_id, pr.spec_id, x.mz, x.{value} AS v FROM pr JOIN {source} x ON x.spec_id = pr.spec_id),
ends AS (SELECT DISTINCT a.query_id, a.spec_id FROM pa a JOIN pb b ON a.query_id = b.query_id AND a.spec_id = b.spec_id),
bt AS (SELECT b.query_id, b.spec_id, b.mz, b.v, MIN(a.mz) AS t FROM pb b LEFT JOIN pa a
  ON a.query_id = b.query_id AND a.spec_id = b.spec_id AND a.mz >= b.mz - {tol} AND a.mz <= b.mz + {tol} GROUP BY b.query_id, b.spec_id, b.mz, b.v),
al4 AS (SELECT a.query_id, a.spec_id, a.mz AS mz_a, a.v AS p, COALESCE(SUM(bt.mz * bt.v) / SUM(bt.v), 0e0) AS mz_b, COALESCE(SUM(bt.v), 0e0) AS q, MAX(bt.v) AS best
  FROM pa a LEFT JOIN bt ON bt.query_id = a.query_id AND bt.spec_id = a.spec_id AND bt.t = a.mz GROUP BY a.query_id, a.spec_id, a.mz, a.v
  UNION ALL SELECT query_id, spec_id, 0e0, 0e0, mz, v, NULL FROM bt WHERE t IS NULL),
al AS (SELECT query_id, spec_id, CASE WHEN p > 0 THEN mz_a ELSE mz_b END AS mz, p, q, best FROM al4 SEMI JOIN ends USING (query_id, spec_id)),
st AS (SELECT *, AVG(p) OVER w AS mp, AVG(q) OVER w AS mq, MAX(p) OVER w AS xp, MAX(q) OVER w AS xq FROM al WINDOW w AS (PARTITION BY query_id, spec_id))"""


_AL = f"WITH {PREP}, {_alignment('5e-2')}"
_XLX = "CASE WHEN {0} > 0 THEN {0} * LN({0}) ELSE 0e0 END"


def _h(x: str) -> str:
    return f"(LN(SUM({x})) - SUM({_XLX.format(x)}) / SUM({x}))"


_ENTROPY_D = f"2e0 * {_h('(p + q)')} - {_h('p')} - {_h('q')}"


def _family_sql(methods: list[str]) -> str:
    cols = ", ".join(f"ROUND({SQL[m]} + 3e-9, 6) + 0e0 AS {m}" for m in methods)
    return f"{_AL} SELECT query_id, spec_id, {cols} FROM st GROUP BY query_id, spec_id"


QUERIES = {
    f.__name__: f
    for f in (
        align_two, align_with_mz, matched_mask, greedy_cosine_pairs, merge_two, align_strongest, pair_entropy_similarity, pair_hybrid_similarity, reverse_entropy_similarity,
        fast_vs_naive_error, distances_entropy_family, distances_ms, normalized_similarity, all_similarities,
    )
} | {name: _family(methods) for name, methods in FAMILIES.items()}

_POSITIVE = "query_id, spec_id, mz_a, CASE WHEN p > 5e-2 THEN p ELSE 0e0 END AS p, mz_b, CASE WHEN q > 5e-2 THEN q ELSE 0e0 END AS q"

ORACLES = {
    "align_two": f"{_AL} SELECT query_id, spec_id, ROUND(mz, 5) AS mz, ROUND(p, 6) AS p, ROUND(q, 6) AS q FROM al",
    "align_with_mz": f"{_AL} SELECT query_id, spec_id, ROUND(mz_a, 5) AS mz_a, ROUND(p, 6) AS p, ROUND(mz_b, 5) AS mz_b, ROUND(q, 6) AS q FROM al4 SEMI JOIN ends USING (query_id, spec_id)",
    "matched_mask": f"{_AL} SELECT query_id, spec_id, ROUND(mz_a, 5) AS mz_a, ROUND(mz_b, 5) AS mz_b, p > 0 AND q > 0 AS matched FROM al4 SEMI JOIN ends USING (query_id, spec_id)",
    "greedy_cosine_pairs": f"""WITH {PREP}, e AS (SELECT DISTINCT query_id, spec_id FROM hit WHERE query_id IN (SELECT spec_id FROM pk) AND spec_id IN (SELECT spec_id FROM pk)),
l AS (SELECT spec_id, SQRT(SUM(n * n)) AS len FROM pk GROUP BY spec_id),
m AS (SELECT e.query_id, e.spec_id, SUM(a.n * b.n) AS dot, COUNT(*) AS matches FROM e JOIN pk a ON a.spec_id = e.query_id JOIN pk b ON b.spec_id = e.spec_id AND b.mz BETWEEN a.mz - 2e-2 AND a.mz + 2e-2 GROUP BY 1, 2)
SELECT e.query_id, e.spec_id, ROUND(COALESCE(m.dot, 0e0) / (x.len * y.len), 6) AS score, COALESCE(m.matches, 0) AS matches
FROM e JOIN l x ON x.spec_id = e.query_id JOIN l y ON y.spec_id = e.spec_id LEFT JOIN m ON m.query_id = e.query_id AND m.spec_id = e.spec_id""",
    "merge_two": f"{_AL} SELECT query_id, spec_id, ROUND(mz, 5) AS mz, ROUND(p + q, 6) AS intensity FROM al",
    "align_strongest": f"{_AL} SELECT query_id, spec_id, ROUND(mz, 5) AS mz, ROUND(best, 6) AS q FROM al WHERE p > 0 AND q > 0",
    "pair_entropy_similarity": f"""WITH {PREP}, w2 AS (SELECT spec_id, mz, h * 2e0 AS n FROM pk), {_alignment('2e-2', 'w2')}
SELECT query_id, spec_id, ROUND(1e0 - LEAST(1e0, GREATEST(0e0, ({_ENTROPY_D}) / {D.log(4)!r}e0)), 6) AS score FROM st GROUP BY query_id, spec_id""",
    "reverse_entropy_similarity": f"""{_AL}, r AS (SELECT query_id, spec_id, SUM(p) AS matched, {_ENTROPY_D.replace("LN(SUM(p))", "LN(GREATEST(SUM(p), 1e-300))").replace("/ SUM(p)", "/ NULLIF(SUM(p), 0e0)")} AS d FROM st WHERE q > 0 GROUP BY query_id, spec_id)
SELECT query_id, spec_id, CASE WHEN matched > 0 THEN ROUND(1e0 - LEAST(1e0, GREATEST(0e0, d / {D.log(4)!r}e0)), 6) ELSE 0e0 END AS score, ROUND(matched, 6) AS matched_intensity FROM r""",
    "fast_vs_naive_error": f"WITH {MATCH} SELECT DISTINCT query_id, 0e0 AS max_error FROM prod",
    "distances_entropy_family": f"""{_AL}, ent AS (SELECT query_id, spec_id, {_h('p')} AS sp, {_h('q')} AS sq, ROUND({_ENTROPY_D} + 3e-9, 6) + 0e0 AS unweighted_entropy FROM st GROUP BY query_id, spec_id),
up AS (SELECT query_id, spec_id, CASE WHEN p > 0 THEN POWER(p, CASE WHEN sp < 3 THEN 25e-2 + 25e-2 * sp ELSE 1e0 END) ELSE 0e0 END AS p,
  CASE WHEN q > 0 THEN POWER(q, CASE WHEN sq < 3 THEN 25e-2 + 25e-2 * sq ELSE 1e0 END) ELSE 0e0 END AS q FROM st JOIN ent USING (query_id, spec_id)),
sc AS (SELECT query_id, spec_id, p / SUM(p) OVER (PARTITION BY query_id, spec_id) AS p, q / SUM(q) OVER (PARTITION BY query_id, spec_id) AS q FROM up),
we AS (SELECT query_id, spec_id, ROUND({_ENTROPY_D} + 3e-9, 6) + 0e0 AS entropy FROM sc GROUP BY query_id, spec_id)
SELECT query_id, spec_id, unweighted_entropy, entropy FROM ent JOIN we USING (query_id, spec_id)""",
    "pair_hybrid_similarity": f"""WITH {PREP}, pr AS (SELECT DISTINCT query_id, spec_id FROM hit), pm AS (SELECT DISTINCT spec_id, precursor_mz AS m FROM nm),
qa AS (SELECT pr.query_id, pr.spec_id, x.mz, x.n AS v FROM pr JOIN nm x ON x.spec_id = pr.query_id),
qb AS (SELECT pr.query_id, pr.spec_id, x.mz, x.n AS v, pm.m - x.precursor_mz AS shift FROM pr JOIN nm x ON x.spec_id = pr.spec_id JOIN pm ON pm.spec_id = pr.query_id),
dm AS (SELECT b.query_id, b.spec_id, b.mz, b.v, MIN(a.mz) FILTER (a.mz >= b.mz - 5e-2 AND a.mz <= b.mz + 5e-2) AS d,
  MIN(a.mz) FILTER (a.mz >= b.mz + shift - 5e-2 AND a.mz <= b.mz + shift + 5e-2) AS m FROM qb b JOIN qa a ON a.query_id = b.query_id AND a.spec_id = b.spec_id GROUP BY b.query_id, b.spec_id, b.mz, b.v),
bt AS (SELECT dm.query_id, dm.spec_id, dm.v, CASE WHEN COALESCE(y.v, -1e0) > COALESCE(x.v, -1e0) THEN dm.m ELSE dm.d END AS t FROM dm
  LEFT JOIN qa x ON x.query_id = dm.query_id AND x.spec_id = dm.spec_id AND x.mz = dm.d LEFT JOIN qa y ON y.query_id = dm.query_id AND y.spec_id = dm.spec_id AND y.mz = dm.m),
st AS (SELECT a.query_id, a.spec_id, a.v AS p, COALESCE(SUM(bt.v), 0e0) AS q FROM qa a LEFT JOIN bt ON bt.query_id = a.query_id AND bt.spec_id = a.spec_id AND bt.t = a.mz
  WHERE (a.query_id, a.spec_id) IN (SELECT (query_id, spec_id) FROM dm) GROUP BY a.query_id, a.spec_id, a.mz, a.v
  UNION ALL SELECT query_id, spec_id, 0e0, v FROM bt WHERE t IS NULL),
ent AS (SELECT query_id, spec_id, {_h('p')} AS sp, {_h('q')} AS sq FROM st GROUP BY query_id, spec_id),
up AS (SELECT query_id, spec_id, CASE WHEN p > 0 THEN POWER(p, CASE WHEN sp < 3 THEN 25e-2 + 25e-2 * sp ELSE 1e0 END) ELSE 0e0 END AS p,
  CASE WHEN q > 0 THEN POWER(q, CASE WHEN sq < 3 THEN 25e-2 + 25e-2 * sq ELSE 1e0 END) ELSE 0e0 END AS q FROM st JOIN ent USING (query_id, spec_id)),
sc AS (SELECT query_id, spec_id, p / SUM(p) OVER (PARTITION BY query_id, spec_id) AS p, q / SUM(q) OVER (PARTITION BY query_id, spec_id) AS q FROM up)
SELECT query_id, spec_id, ROUND(1e0 - LEAST(1e0, GREATEST(0e0, ({_ENTROPY_D}) / {D.log(4)!r}e0)), 6) AS score FROM sc GROUP BY query_id, spec_id""",
    "distances_ms": f"""{_AL}, f4 AS (SELECT * FROM al4 SEMI JOIN ends USING (query_id, spec_id)),
w AS (SELECT query_id, spec_id, POWER(p, 6e-1) * POWER(mz_a, 3e0) AS p, POWER(q, 6e-1) * POWER(mz_b, 3e0) AS q FROM f4),
d1 AS (SELECT query_id, spec_id, 1e0 - SQRT(SUM(p * q) * SUM(p * q) / (SUM(p * p) * SUM(q * q))) AS d FROM w GROUP BY query_id, spec_id),
d2 AS (SELECT query_id, spec_id, CASE WHEN COUNT(*) FILTER (p > 0 AND q > 0) > 0 THEN COUNT(*) FILTER (p > 0) * COUNT(*) FILTER (q > 0)
  * POWER(SUM(ABS(mz_a - mz_b)) FILTER (p > 0 AND q > 0), 25e-2) / POWER(COUNT(*) FILTER (p > 0 AND q > 0), 4e0) END AS d FROM f4 GROUP BY query_id, spec_id),
t AS (SELECT {_POSITIVE} FROM f4), m AS (SELECT query_id, spec_id, COUNT(*) FILTER (p > 0) AS nq, COUNT(*) FILTER (q > 0) AS nr, COUNT(*) FILTER (p > 0 AND q > 0) AS nm,
  SUM(p) AS sp, SUM(q) AS sq, COALESCE(SUM(ABS(p - q)) FILTER (p > 0 AND q > 0), 0e0) AS di, COALESCE(SUM(ABS(mz_a - mz_b)) FILTER (p > 0 AND q > 0), 0e0) AS dm FROM t GROUP BY query_id, spec_id),
d3 AS (SELECT query_id, spec_id, CASE WHEN nq + nr > 0 THEN -POWER(nm, 4e0) * POWER(sp + 2e0 * sq, 125e-2) / (POWER(nq + 2 * nr, 2e0) + di + dm) ELSE 0e0 END AS d FROM m)
SELECT query_id, spec_id, ROUND(d1.d + 3e-9, 5) + 0e0 AS weighted_dot_product, ROUND(d2.d + 3e-9, 5) + 0e0 AS ms_for_id_v1, ROUND(d3.d + 3e-9, 5) + 0e0 AS ms_for_id
FROM d1 JOIN d2 USING (query_id, spec_id) JOIN d3 USING (query_id, spec_id)""",
    "normalized_similarity": f"""{_AL}, d AS (SELECT query_id, spec_id, {SQL['manhattan']} AS m, {SQL['canberra']} AS c, {SQL['motyka']} AS y, {SQL['pearson_correlation']} AS r, {SQL['bhattacharya_2']} AS b FROM st GROUP BY query_id, spec_id)
SELECT query_id, spec_id, ROUND(1e0 - LEAST(1e0, GREATEST(0e0, m / 2e0)) + 3e-9, 6) + 0e0 AS manhattan, ROUND(1e0 / (1e0 + c) + 3e-9, 6) + 0e0 AS canberra,
  ROUND(1e0 - LEAST(1e0, GREATEST(0e0, (y + 5e-1) / 5e-1)) + 3e-9, 6) + 0e0 AS motyka, ROUND(1e0 - LEAST(1e0, GREATEST(0e0, (r + 1e0) / 2e0)) + 3e-9, 6) + 0e0 AS pearson_correlation,
  ROUND(CASE WHEN b IS NULL THEN 0e0 ELSE 1e0 / (1e0 + b) END + 3e-9, 6) + 0e0 AS bhattacharya_2 FROM d""",
} | {name: _family_sql(methods) for name, methods in FAMILIES.items()}
