"""Mixing sources to target shares of tokens.

Documents carry soft memberships in the target sources: a labelled document belongs
to its source, for the others a classifier trained on labelled rows predicts
posteriors.  Nonnegative rates per document, at most the sources' repeat caps, are
fitted by projected-gradient least squares so that the expected tokens per source meet the
targets: first the rates of the labelled documents, then, for what their caps leave
open, those of the others.

Documents with equal memberships share a rate.  A round of the fit is one Spark
aggregation that returns one number per source; the rates follow from the rounds'
numbers alone, so every task works them out again for its own rows and nothing is
joined or carried from round to round.
"""

from __future__ import annotations

import base64
import sys
from collections.abc import Iterator, Sequence
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import Shared, cut_lineage, spread

#: Vocabulary file of a public byte-level tokenizer (base64 token and rank per line);
#: a parameter of every function that counts tokens.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the public split pattern that goes with the vocabulary.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Labelled rows per source that the classifier is fitted on.
TRAIN_ROWS = 400
#: Features of the classifier (token numbers modulo this); fewer where there are
#: so many sources that the coefficients would pass COEFFICIENTS.
FEATURES = 1 << 13
COEFFICIENTS = 1 << 24
#: Documents that are scored at once.
SCORED = 256
#: Memberships are multiples of 1/STEPS that add up to one.
STEPS = 10
#: Cells that one task of a round handles.
CELLS_PER_TASK = 100_000
#: The fit ends when a further round would move less than this share of the target tokens.
TOLERANCE = 1e-7


def normal(source: Column) -> Column:
    """Sources compare trimmed and in lower case."""
    return F.lower(F.regexp_replace(source, r"^\s+|\s+$", ""))


def _encoder(path: str):
    """The tokenizer, loaded once per worker process."""
    held = sys.__dict__.setdefault("_ionloom_tokenizers", {})
    if path not in held:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
        held[path] = tiktoken.Encoding("public", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    return held[path]


#: Longest piece given to the tokenizer at once; longer texts are cut before blanks,
#: where the split pattern never joins (a longer run without any blank is cut as it is).
PIECE = 200_000


def _pieces(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > PIECE:
        cut = max(text.rfind(" ", at + 1, at + PIECE), text.rfind("\n", at + 1, at + PIECE))
        # the start of a run of blanks: the token before ends there in any case
        while cut > at and text[cut - 1].isspace():
            cut -= 1
        cut = cut if cut > at else at + PIECE
        yield text[at:cut]
        at = cut
    yield text[at:]


def _tokens(enc, text: str | None) -> np.ndarray:
    """The token numbers of a whole text."""
    parts = [np.array(enc.encode_ordinary(piece), np.uint32) for piece in _pieces(text)] if text else []
    return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint32)


class Model(NamedTuple):
    """Multinomial regression over token features; row k is source k."""

    weights: np.ndarray
    intercept: np.ndarray

    def posteriors(self, tokens: list[np.ndarray]) -> np.ndarray:
        """One row per document, from which features its tokens have."""
        seen = np.zeros((len(tokens), self.weights.shape[1]), np.float32)
        for row, ids in zip(seen, tokens, strict=True):
            row[ids % len(row)] = 1.0
        z = seen @ self.weights.T + self.intercept
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def n_features(sources: int) -> int:
    return max(64, min(FEATURES, COEFFICIENTS // max(1, sources)))


def stepped(p: np.ndarray, start: float) -> tuple[list[int], list[int]]:
    """``p`` in whole steps that add up to STEPS: a systematic draw from ``start`` (0 to 1).

    The expected steps of an entry are STEPS times its share, so no small share is lost in
    total, however many there are.
    """
    edge = np.floor(np.cumsum(p) * STEPS + start).astype(np.int64)
    edge[-1] = STEPS
    w = np.diff(np.minimum(edge, STEPS), prepend=0)
    k = np.flatnonzero(w)
    return k.tolist(), w[k].tolist()


def _read(path: str, at: dict[str, int], shared: Shared):
    """mapInArrow function: tokens, memberships and the classifier's guess of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, model = _encoder(path), shared.value
        for batch in chain.from_iterable((b.slice(i, SCORED) for i in range(0, b.num_rows, SCORED)) for b in batches):
            tokens = [_tokens(enc, t) for t in batch.column(2).to_pylist()]
            p = model.posteriors(tokens) if model is not None else None
            members, steps, guesses = [], [], []
            for i, (source, ids, start) in enumerate(zip(batch.column(1).to_pylist(), tokens, batch.column(3).to_pylist(), strict=True)):
                own = at.get(source)
                some = p is not None and len(ids) > 0
                k, w = ([own], [STEPS]) if own is not None else stepped(p[i], start) if some else ([], [])
                members.append(k)
                steps.append(w)
                guesses.append(int(p[i].argmax()) if some else None)
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(t) for t in tokens], pa.int64()), pa.array(members, ints), pa.array(steps, ints), pa.array(guesses, pa.int32())],
                ["id", "source", "tokens", "k", "w", "guess"],
            )

    return run


def read_documents(docs: DataFrame, sources: Sequence[str] = (), model: Model | None = None, tokenizer: str = TOKENIZER) -> DataFrame:
    """``(id, source, tokens, k, w, guess)`` of whole texts, in one pass.

    ``k`` and ``w`` are the sources (numbers in ``sources``) that a document belongs to and their
    shares in steps of 1/STEPS: its own source if that is one of ``sources``, else the
    posteriors of ``model``; both are empty without a model or text.  ``guess`` is the
    source of the greatest posterior.  Null and empty texts have 0 tokens.
    """
    kind = dict(docs.dtypes)["doc_id"]
    start = F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    slim = spread(docs.select(F.col("doc_id").alias("id"), normal(F.col("source")).alias("source"), "text", start.alias("start")))
    schema = f"id {kind}, source string, tokens long, k array<int>, w array<int>, guess int"
    return slim.mapInArrow(_read(tokenizer, {s: i for i, s in enumerate(sources)}, Shared(docs.sparkSession, model)), schema)


def count_tokens(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``(id, source, tokens)`` of whole texts; null and empty texts have 0 tokens."""
    return read_documents(docs, tokenizer=tokenizer).select("id", "source", "tokens")


def _train(path: str, features: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(path)
        for batch in batches:
            seen = [[str(f) for f in np.unique(_tokens(enc, t) % features).tolist()] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(seen, pa.list_(pa.string()))], ["label", "seen"])

    return run


def fit_classifier(docs: DataFrame, sources: list[str], rows: int = TRAIN_ROWS, tokenizer: str = TOKENIZER) -> Model | None:
    """Multinomial regression on at most ``rows`` labelled documents per source, or None
    when fewer than two sources have documents.  Its labels index ``sources``."""
    spark = docs.sparkSession
    named = spark.createDataFrame(list(enumerate(sources)), "label int, name string")
    # one row per source: as small as the target table
    keyed = docs.select("doc_id", normal(F.col("source")).alias("name")).filter("doc_id is not null").join(F.broadcast(named), "name")
    w = Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id")
    picked = cut_lineage(keyed.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= rows).select("doc_id", "label").distinct())
    if picked.select("label").distinct().count() < 2:
        return None
    # at most rows * sources identifiers
    train = docs.filter(F.length("text") > 0).select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("label", "text")
    size = n_features(len(sources))
    seen = spread(train, docs).mapInArrow(_train(tokenizer, size), "label int, seen array<string>")
    vector = CountVectorizerModel.from_vocabulary([str(i) for i in range(size)], inputCol="seen", outputCol="x").setBinary(True)
    table = cut_lineage(vector.transform(seen).select("x", "label").coalesce(4))  # a bounded sample
    fit = LogisticRegression(featuresCol="x", labelCol="label", family="multinomial", regParam=0.02, maxIter=15, aggregationDepth=2).fit(table)
    weights, intercept = fit.coefficientMatrix.toArray(), fit.interceptVector.toArray()
    # labels above the last one seen in training have no row of their own
    lack = len(sources) - len(intercept)
    weights = np.vstack([weights, np.zeros((lack, size))])
    intercept = np.append(intercept, np.full(lack, -50.0))
    return Model(weights.astype(np.float32), intercept.astype(np.float32))


def memberships(docs: DataFrame, sources: list[str], model: Model, tokenizer: str = TOKENIZER) -> DataFrame:
    """``(id, k, w)``: posteriors, in steps of 1/STEPS, of the documents with a text and without a target source."""
    every = read_documents(docs, sources, model, tokenizer)
    own = F.coalesce(F.array_contains(F.array(*[F.lit(s) for s in sources]), F.col("source")), F.lit(False))
    return every.filter(~own & (F.size("k") > 0)).select("id", "k", "w")


# ---------------------------------------------------------------- the fit


class Cells(NamedTuple):
    """Rows with equal memberships: flat source numbers and shares, and each row's part of them."""

    row: np.ndarray
    k: np.ndarray
    p: np.ndarray
    n: int

    @staticmethod
    def of(k: pa.Array, w: pa.Array) -> Cells:
        sizes = np.diff(k.offsets.to_numpy())
        row = np.repeat(np.arange(len(sizes)), sizes)
        shares = w.flatten().to_numpy(zero_copy_only=False).astype(float)
        total = np.bincount(row, weights=shares, minlength=len(sizes))
        return Cells(row, k.flatten().to_numpy(zero_copy_only=False).astype(np.int64), shares / total[row], len(sizes))

    def of_rows(self, per_source: np.ndarray) -> np.ndarray:
        """Sum over each row's sources of share times the source's number."""
        return np.bincount(self.row, weights=self.p * per_source[self.k], minlength=self.n)

    def of_sources(self, per_row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sources met, and their sums over rows of share times the row's number."""
        met, at = np.unique(self.k, return_inverse=True)
        return met, np.bincount(at, weights=self.p * per_row[self.row], minlength=len(met))


class Fit(NamedTuple):
    """Rounds of the fit: the relative errors per source that each saw, and its momentum."""

    caps: np.ndarray
    rounds: list[tuple[np.ndarray, float]]
    #: Tokens per source that the rates expect; None until it is evaluated.
    have: np.ndarray | None = None
    #: Tokens, as a share of the target tokens, that a further round would move.
    residual: float = float("inf")

    def rates(self, cells: Cells) -> tuple[np.ndarray, np.ndarray]:
        """The rates after the last round, and how far that round moved them."""
        cap = cells.of_rows(self.caps)
        at = before = np.minimum(1.0, cap)
        moved = np.zeros(cells.n)
        for error, momentum in self.rounds:
            new = np.clip(at - cells.of_rows(error), 0.0, cap)
            moved = new - at
            at, before = new + momentum * (new - before), new
        return at, moved


def _sums(fit: Fit):
    """mapInArrow function: expected tokens per source, and the tokens last moved (k = -1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = Cells.of(batch.column(0), batch.column(1))
            tokens = batch.column(2).to_numpy(zero_copy_only=False).astype(float)
            rates, moved = fit.rates(cells)
            met, have = cells.of_sources(tokens * rates)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(met, -1), pa.int64()), pa.array(np.append(have, (tokens * np.abs(moved)).sum()), pa.float64())], ["k", "tokens"]
            )

    return run


def fit_rates(cells: DataFrame, targets: Sequence[float], caps: Sequence[float], rounds: int = 5000, tolerance: float = TOLERANCE) -> Fit:
    """Rates of cells ``(k, w, tokens)`` by accelerated projected-gradient least squares.

    Minimises the squared errors of the expected tokens per source, each divided by the
    source's available tokens, under 0 <= rate <= cap, where a cell's cap is the mean of
    its sources' caps by membership.  With steps scaled by a cell's tokens, a step of one
    is the largest that never overshoots.  Momentum starts anew when the error grows.
    Rounds end when a further one would move at most ``tolerance`` of the target tokens; the
    result says how much that is, also where ``rounds`` ends them before.
    """
    want, caps = np.array(targets, float), np.array(caps, float)
    n = len(want)

    def sums(fit: Fit) -> tuple[np.ndarray, float]:
        rows = cells.mapInArrow(_sums(fit), "k long, tokens double").groupBy("k").agg(F.sum("tokens").alias("tokens")).collect()
        out = np.zeros(n + 1)
        for r in rows:  # one row per source
            out[r["k"]] = r["tokens"]
        return out[:n], float(out[n])

    available = np.zeros(n)
    for r in cells.select("tokens", F.explode(F.arrays_zip("k", "w")).alias("m"), F.aggregate("w", F.lit(0), lambda a, x: a + x).alias("all")).groupBy(
        F.col("m.k").alias("k")).agg(F.sum(F.col("tokens") * F.col("m.w") / F.col("all")).alias("t")).collect():
        available[r["k"]] = r["t"]
    scale, all_wanted = np.maximum(available, 1.0), max(1.0, want.sum())
    fit, momentum, last = Fit(caps, []), 1.0, np.inf
    for done in range(rounds + 1):
        have, moved = sums(fit)
        error = np.where(available > 0, (have - want) / scale, 0.0)
        loss = float((error**2 * scale).sum())
        if done and (moved <= tolerance * all_wanted or done == rounds):
            # rates without the momentum that would lead into another round
            final = fit._replace(rounds=[*fit.rounds[:-1], (fit.rounds[-1][0], 0.0)])
            return final._replace(have=sums(final)[0], residual=moved / all_wanted)
        if loss > last:
            momentum = 1.0
        nxt = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        fit = fit._replace(rounds=[*fit.rounds, (error, (momentum - 1) / nxt)])
        momentum, last = nxt, loss
    return fit


def _repeat(labelled: Fit, others: Fit, n_sources: int):
    """mapInArrow function: the rate and the repeats of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.column(3)
            own = batch.column(5).to_numpy(zero_copy_only=False).astype(bool)
            some = np.diff(k.offsets.to_numpy()) > 0
            rate = np.zeros(batch.num_rows)
            for fit, which in ((labelled, own), (others, ~own & some)):
                at = np.flatnonzero(which)
                if len(at):
                    pick = pa.array(at)
                    rate[at] = fit.rates(Cells.of(k.take(pick), batch.column(4).take(pick)))[0]
            whole = np.floor(rate)
            draw = batch.column(6).to_numpy(zero_copy_only=False)
            repeats = (whole + (draw < rate - whole)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(rate), pa.array(repeats)], ["id", "source", "tokens", "k", "w", "rate", "repeats"])

    return run


def _targets(targets: DataFrame) -> list[tuple[str, str, float, int]]:
    """(normal name, name, weight, cap) in the order of names; the first of equal names counts.
    The table of targets is a parameter of the mixture: it comes to the driver, documents never do."""
    plan: dict[str, tuple[str, str, float, int]] = {}
    for r in targets.filter(F.col("source").isNotNull()).select(normal(F.col("source")).alias("key"), "source", "weight", "max_repeats").orderBy("source").collect():
        plan.setdefault(r["key"], (r["key"], r["source"], float(r["weight"] or 0.0), int(r["max_repeats"] or 0)))
    return list(plan.values())


def mix_report(docs: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, use_unlabelled: bool = True) -> tuple[DataFrame, DataFrame]:
    """The report per target source and the rates per document.

    Report: ``source, weight, max_repeats, docs, tokens`` (of the documents labelled with the
    source), ``agreement`` (share of these whose text the classifier gives the source),
    ``expected_tokens`` (with soft members), ``target_tokens`` (weight times the
    tokens of all labelled documents), ``rate`` (chosen over expected tokens), ``chosen_tokens`` and
    ``chosen_share`` (as the rates expect), ``taken_tokens`` and ``actual_share`` (of the documents as they
    are repeated below, soft members by membership), ``labelled_chosen_tokens`` (of labelled documents alone),
    ``short`` (the fit left the labelled documents at their cap and below the target; other
    documents may still fill it) and ``residual`` (the share of all target tokens that a further round of the fit would move).
    Sources without documents have zero everywhere; a source named twice in ``targets``
    counts once.  Documents: ``id, source, tokens, rate, repeats``, one row per row of ``docs``, whatever ids
    they share; a document is taken floor(rate) times and once more with the
    probability of the rest, decided by the hash of its id.  Documents without text, or
    without target source where there is no classifier, have rate 0.
    """
    spark = docs.sparkSession
    plan = _targets(targets)
    sources, n = [p[0] for p in plan], len(plan)
    caps = [float(p[3]) for p in plan]
    model = fit_classifier(docs, sources, tokenizer=tokenizer) if use_unlabelled and sources else None
    at = {s: i for i, s in enumerate(sources)}
    read = read_documents(docs, sources, model, tokenizer)
    own = F.coalesce(F.array_contains(F.lit(sources).cast("array<string>"), F.col("source")), F.lit(False))
    members = cut_lineage(read.withColumn("own", own))
    by_source = {
        at[r["source"]]: r
        for r in members.filter("own").groupBy("source").agg(
            F.count(F.lit(1)).alias("docs"), F.sum("tokens").alias("tokens"), F.avg((F.col("guess") == F.get("k", F.lit(0))).cast("double")).alias("agreement"),
        ).collect()
    }
    total = sum(r["tokens"] for r in by_source.values())
    want = np.array([p[2] * total for p in plan])
    cells = cut_lineage(members.filter((F.size("k") > 0) & (F.col("tokens") > 0)).groupBy("own", "k", "w").agg(F.sum("tokens").alias("tokens")))
    cells = cells.coalesce(1 + cells.count() // CELLS_PER_TASK)
    labelled = fit_rates(cells.filter("own").select("k", "w", "tokens"), want, caps)
    soft = cells.filter("not own").select("k", "w", "tokens")
    others = fit_rates(soft, np.maximum(0.0, want - labelled.have), caps)
    chosen = labelled.have + others.have
    draw = F.pmod(F.xxhash64("id"), F.lit(1_000_000)) / 1_000_000
    kinds = dict(members.dtypes)
    schema = f"id {kinds['id']}, source string, tokens long, k array<int>, w array<int>, rate double, repeats int"
    drawn = members.select("id", "source", "tokens", "k", "w", "own", draw.alias("draw")).mapInArrow(_repeat(labelled, others, n), schema)
    share = F.col("tokens") * F.col("m.w") / F.lit(STEPS)
    taken, expected = np.zeros(n), np.zeros(n)
    for r in drawn.select("tokens", "repeats", F.explode(F.arrays_zip("k", "w")).alias("m")).groupBy(F.col("m.k").alias("k")).agg(
        F.sum(share).alias("expected"), F.sum(share * F.col("repeats")).alias("taken")).collect():
        taken[r["k"]], expected[r["k"]] = r["taken"], r["expected"]
    rows = []
    for i, (_, name, weight, cap) in enumerate(plan):
        r = by_source.get(i)
        tokens = int(r["tokens"]) if r else 0
        # the fit's candidates: at the cap and below the target; then the whole numbers are compared
        at_cap = labelled.have[i] >= cap * tokens * (1 - 1e-9)
        rows.append((
            name, weight, cap, int(r["docs"]) if r else 0, tokens, float(r["agreement"]) if r and r["agreement"] is not None else None, float(expected[i]),
            float(want[i]), float(chosen[i] / expected[i]) if expected[i] else 0.0, float(chosen[i]), float(chosen[i] / chosen.sum()) if chosen.sum() else 0.0,
            float(taken[i]), float(taken[i] / taken.sum()) if taken.sum() else 0.0, float(labelled.have[i]),
            bool(at_cap and labelled.have[i] < want[i] and cap * tokens < want[i]), float(max(labelled.residual, others.residual)),
        ))
    report = spark.createDataFrame(
        rows,
        "source string, weight double, max_repeats int, docs long, tokens long, agreement double, expected_tokens double, target_tokens double, "
        "rate double, chosen_tokens double, chosen_share double, taken_tokens double, actual_share double, labelled_chosen_tokens double, "
        "short boolean, residual double",
    )
    return report, drawn.select("id", "source", "tokens", "rate", "repeats")
