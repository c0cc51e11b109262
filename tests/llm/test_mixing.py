import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ionloom.llm import mixing as M

DOCS = "doc_id long, source string, text string, id string, tokens int, cell string"
TARGET = "source string, weight double, max_repeats int, tokens string"


def docs(spark, rows):
    return spark.createDataFrame([(i, s, t, "clash", 1, "clash") for i, (s, t) in enumerate(rows)], DOCS)


def targets(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], TARGET)


def corpus(n=60):
    r = random.Random(0)
    style = {"law": "court appeal ruling judge", "web": "click here subscribe now", "sea": "harbour vessel cargo tide"}
    return [(s, " ".join(r.choice(words.split()) for _ in range(40))) for s, words in style.items() for _ in range(n)]


def test_tokens_of_whole_texts(spark):
    long = "The appeal is admissible.\n  And " * 20_000
    got = {r.id: r.tokens for r in M.count_tokens(docs(spark, [(" A ", "Hello world"), (None, None), ("b", ""), ("c", long)])).collect()}
    enc = M._encoder(M.TOKENIZER)
    assert (got[0], got[1], got[2], got[3]) == (2, 0, 0, len(enc.encode_ordinary(long)))


def test_pieces_join_and_count_alike():
    enc = M._encoder(M.TOKENIZER)
    r = random.Random(3)
    text = "".join(r.choice(["word", " ", "  ", "\n", " \n ", "it's", "42", " -"]) for _ in range(3000))
    size, M.PIECE = M.PIECE, 97
    try:
        parts = list(M._pieces(text))
    finally:
        M.PIECE = size
    assert "".join(parts) == text and len(parts) > 30
    assert sum(len(enc.encode_ordinary(p)) for p in parts) == len(enc.encode_ordinary(text))


def test_report_meets_targets_or_caps(spark):
    rows = corpus()
    rows = [(" LAW " if s == "law" and i % 2 else s, t) for i, (s, t) in enumerate(rows)]
    plan = [("law", 0.5, 1), ("web", 0.3, 4), ("sea", 0.1, 2), ("none", 0.1, 9)]
    report, chosen = M.mix_report(docs(spark, rows), targets(spark, plan))
    got = {r.source: r for r in report.collect()}
    assert {s for s, r in got.items() if r.short} == {"law", "none"}
    assert got["none"].tokens == 0 and got["none"].chosen_tokens == 0
    assert abs(got["law"].rate - 1.0) < 1e-6
    assert abs(got["web"].chosen_tokens - got["web"].target_tokens) < 1e-3 * got["web"].target_tokens
    assert abs(sum(r.actual_share for r in got.values()) - 1) < 1e-9
    reps = chosen.groupBy(M.normal(F.col("source")).alias("s")).agg(F.max("repeats").alias("m"), F.sum(F.col("repeats") * F.col("tokens")).alias("t"))
    for r in reps.collect():
        assert r.m <= {"law": 1, "web": 4, "sea": 2}[r.s]
        assert abs(r.t - got[r.s].chosen_tokens) < 0.35 * got[r.s].target_tokens


def test_report_sums_the_documents_taken(spark, tmp_path):
    from ionloom.llm import queries as Q

    rows = corpus(20) + [("web", "click here subscribe now " * 400), (None, "court appeal ruling judge " * 30), (None, "harbour click vessel here " * 30)]
    plan = [("law", 0.5, 1), ("web", 0.2, 4), ("sea", 0.3, 2)]  # one document holds most of web, at a rate below 1
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    targets(spark, plan).write.parquet(str(tmp_path / "mix_target.parquet"))
    report = {r.source: r for r in Q.p7_report(spark, str(tmp_path)).collect()}
    taken = Q.p7_mixture(spark, str(tmp_path)).collect()
    everything = sum(r.repeats * r.tokens for r in taken)
    soft = sum(r.repeats * r.tokens for r in taken if r.source is None)
    assert abs(sum(r.chosen_tokens for r in report.values()) - everything) < 1e-6 * everything
    for s, r in report.items():
        labelled = sum(x.repeats * x.tokens for x in taken if x.source == s)
        assert labelled - 1e-6 <= r.chosen_tokens <= labelled + soft + 1e-6
        assert abs(r.actual_share - r.chosen_tokens / everything) < 1e-9
    assert abs(report["web"].chosen_tokens - report["web"].fitted_tokens) > 0.1 * report["web"].target_tokens


def test_short_counts_labelled_tokens_though_soft_documents_meet_the_target(spark):
    rows = [(s, t) for s, t in corpus(40) if s != "sea"]
    rows = [r for k, r in enumerate(rows) if r[0] != "law" or k < 20] + [(None, t) for s, t in corpus(60) if s == "law"]
    report = {r.source: r for r in M.mix_report(docs(spark, rows), targets(spark, [("law", 0.6, 1), ("web", 0.4, 2)]))[0].collect()}
    assert report["law"].tokens < report["law"].target_tokens and report["law"].short
    assert report["law"].chosen_tokens > 0.98 * report["law"].target_tokens and report["law"].rate < 0.9


def test_unlabelled_documents_get_posteriors(spark):
    rows = corpus()
    hidden = [(None if i % 3 == 0 else s, t) for i, (s, t) in enumerate(rows)]
    df = docs(spark, hidden)
    sources = ["law", "sea", "web"]
    model = M.fit_classifier(df, sources, rows=30)
    truth = {i: s for i, (s, _) in enumerate(rows)}
    cells = M.memberships(df, sources, model).collect()
    assert len(cells) == sum(s is None for s, _ in hidden)
    assert all(sum(c.w) == M.STEPS for c in cells)
    right = sum(sources[c.k[c.w.index(max(c.w))]] == truth[c.id] for c in cells)
    assert right / len(cells) > 0.9  # held-out accuracy


def test_rates_solve_a_soft_problem(spark):
    rows = [([0], [10], 1000), ([1], [10], 1000), ([0, 1], [5, 5], 1000)]
    cells = spark.createDataFrame(rows, "k array<int>, w array<int>, tokens long")
    fit = M.fit_rates(cells, [1200.0, 900.0], [2, 1], rounds=200, tolerance=1e-9)
    assert abs(fit.have[0] - 1200) < 2 and abs(fit.have[1] - 900) < 2 and fit.residual <= 1e-9
    rates, _ = fit.rates(M.Cells.of(pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])))
    assert all(0 <= r <= c + 1e-9 for r, c in zip(rates, [2, 1, 1.5], strict=True))


def test_slow_fits_are_carried_to_their_end(spark):
    # much text in two mixed cells: a plain step closes 4 % of the imbalance only
    cells = spark.createDataFrame([([0, 1], [6, 4], 10_000), ([0, 1], [4, 6], 10_000)], "k array<int>, w array<int>, tokens long")
    fit = M.fit_rates(cells, [9_000.0, 8_500.0], [1, 1])
    assert abs(fit.have[0] - 9_000) < 5 and abs(fit.have[1] - 8_500) < 5
    assert fit.residual <= M.TOLERANCE
    cut = M.fit_rates(cells, [9_000.0, 8_500.0], [1, 1], rounds=2)
    assert cut.residual > M.TOLERANCE  # said, not hidden


def test_steps_lose_no_share():
    r = random.Random(2)
    p = np.full(60, 1 / 60)
    total = np.zeros(60)
    for _ in range(2000):
        k, w = M.stepped(p, r.random())
        assert sum(w) == M.STEPS
        total[k] += w
    assert abs(total / total.sum() - p).max() < 0.003


def test_many_sources_and_repeated_ids_lose_no_row(spark):
    rows = [(f"s{k}", f"word{k} of source {k} " * 5) for k in range(60) for _ in range(3)]
    data = [(i, s, t, "clash", 1, "clash") for i, (s, t) in enumerate(rows)]
    data += [(1000 + i // 2, None, f"word{i} of source {i} word{i + 1} " * 4, "clash", 1, "clash") for i in range(20)]
    plan = [(f"s{k}", 1 / 60, 2) for k in range(60)]
    report, chosen = M.mix_report(spark.createDataFrame(data, DOCS), targets(spark, plan))
    got = chosen.collect()
    assert len(got) == len(data) and report.count() == 60
    assert sum(r.id >= 1000 for r in got) == 20
    grown, taken = M.mix_report(spark.createDataFrame(data, DOCS), targets(spark, [(s, w * 3, c) for s, w, c in plan]))
    soft = [r.rate for r in taken.collect() if r.source is None]
    assert len(soft) == 20 and min(soft) > 0.5  # all are needed, none has rate 0


def test_empty_and_null_sources(spark):
    plan = [("law", 1.0, 2), (None, 0.0, 1)]
    report, chosen = M.mix_report(docs(spark, []), targets(spark, plan))
    assert [(r.source, r.tokens, r.short) for r in report.collect()] == [("law", 0, False)]
    assert chosen.collect() == []
    report, _ = M.mix_report(docs(spark, [("law", "a b"), ("law", None), (None, "x")]), targets(spark, plan))
    assert [(r.docs, r.short) for r in report.collect()] == [(2, False)]


@pytest.mark.parametrize("text", ["", "  LAW\t", "law"])
def test_source_names(spark, text):
    got = spark.createDataFrame([(text,)], "s string").select(M.normal(F.col("s"))).first()[0]
    assert got == ("" if not text else got) and (not text or "law" in got)
