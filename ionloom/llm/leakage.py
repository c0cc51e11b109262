"""Evaluation passages that leaked into training text.

The test items are put into an inverted index of word triples with BM25 impacts.
Every training document is cut into overlapping passages, each of which is run as a
query against the index with block-max WAND; all items that reach their own threshold
are retrieved and then verified word by word: at least half of the
item's words must stand in the document in order, in one place, in runs of three or
more words.  An item's threshold is the least score that half of its words can have, so retrieval
loses none.  Words that the index lacks are looked up by their deletion neighbourhoods and stand
for the indexed words they may be misspellings of.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain, combinations, product, repeat
from math import ceil, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Shared, spread

#: Words of a run, and so of an index term.
RUN = 3
#: Share of an item's words that must be repeated.
SHARE = 0.5
#: Words of foreign text that may stand between two runs of one place.
GAP = 40
#: Test items, and bytes of their text, per pass over the corpus; more items take more passes.
ITEMS_PER_PASS = 50_000
BYTES_PER_PASS = 32 << 20
#: Largest index that is broadcast.
INDEX_BYTES = 1 << 30
#: Bytes of text whose words are held at once; a longer text is a part of its own.
PART_BYTES = 8 << 20
#: Postings per block of a posting list.
BLOCK = 64
#: Words whose look-up a worker keeps.
KEPT_WORDS = 1_000_000
K1, B = 1.2, 0.75

_WORD = re.compile(r"[^\W_]+")
_BROKEN = re.compile(r"-(?<=[^\W\d_]-)[ \t]*\r?\n[ \t]*(?=[^\W\d_])")


def words_of(text: str) -> list[str]:
    """Case-folded words; words broken at a line end are joined."""
    if "-" in text and "\n" in text:
        text = _BROKEN.sub("", text)
    return _WORD.findall(text.casefold())


def needed_words(size: int, share: float) -> int:
    return max(RUN, ceil(share * size - 1e-9))


def least_triples(words: int) -> int:
    """The fewest triples that ``words`` or more words in runs of three or more can hold."""
    return min(c - (RUN - 1) * (c // RUN) for c in range(words, words + RUN))


def reach(size: int, share: float, gap: int) -> int:
    """The longest place, in words, that repeats just enough of an item."""
    words = needed_words(size, share)
    return words + (words // RUN - 1) * gap


def edits(word: str) -> int:
    """Edits that still leave a word the same one; see :func:`similar`."""
    return 0 if len(word) < 4 else max(1, len(word) // 4)


def _deletions(word: str, n: int) -> Iterator[str]:
    """``word`` with up to ``n`` letters taken out."""
    yield word
    for k in range(1, n + 1):
        for gone in combinations(range(len(word)), k):
            yield "".join(c for i, c in enumerate(word) if i not in gone)


class ItemIndex:
    """Block-max inverted index of word triples of the test items.

    Posting lists and places are flat arrays with the start of each term's part.  Impacts are
    scaled so that every item's threshold is one.
    """

    def __init__(self, items: list[tuple[int, str, str]], share: float = SHARE, gap: int = GAP) -> None:
        self.ids = [i for i, _, _ in items]
        self.words = [words_of(p) for _, p, _ in items]
        self.questions = [words_of(q or "") for _, _, q in items]
        vocabulary: dict[str, int] = {}
        for ws in self.words:
            for w in ws:
                vocabulary.setdefault(w, len(vocabulary) + 1)
        self.vocabulary = vocabulary
        self.base = len(vocabulary) + 1
        places: dict[int, list[tuple[int, int]]] = defaultdict(list)  # triple -> (item, position)
        for n, ws in enumerate(self.words):
            code = [vocabulary[w] for w in ws]
            for p in range(len(code) - RUN + 1):
                places[self._key(code, p)].append((n, p))
        self.terms = np.array(sorted(places), np.int64)
        sorted_places = [places[t] for t in self.terms.tolist()]
        self.place_start = np.append(0, np.cumsum([len(x) for x in sorted_places])).astype(np.int64)
        flat = np.array([x for where in sorted_places for x in where], np.int64).reshape(-1, 2)
        self.place_item, self.place_word = flat[:, 0].copy(), flat[:, 1].copy()
        self._impacts(sorted_places, share)
        span = max([reach(len(w), share, gap) for w in self.words], default=1)
        #: Any place of ``span`` words lies within one passage.
        self.window, self.stride = 2 * span, span
        self._start()

    def _start(self) -> None:
        self.known: dict[str, tuple[int, ...]] = {}
        self.deleted: dict[str, list[int]] | None = None

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("known", "deleted")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._start()

    def _key(self, code, p: int) -> int:
        return (code[p] * self.base + code[p + 1]) * self.base + code[p + 2]

    def _impacts(self, places: list[list[tuple[int, int]]], share: float) -> None:
        """Postings per term: items ascending, impacts as shares of the item's threshold,
        and the greatest impact of each block and of the whole list.

        The threshold is what the fewest triples that can hold the needed words score at
        least: the sum of that many smallest impacts, a repeated triple's impact being
        shared between its positions.
        """
        n = len(self.words)
        length = [max(1, len(w) - RUN + 1) for w in self.words]
        mean = sum(length) / max(1, n)
        start, items, impacts = [0], [], []
        single: list[list[float]] = [[] for _ in range(n)]
        for where in places:
            tf = Counter(i for i, _ in where)
            idf = log(1 + (n - len(tf) + 0.5) / (len(tf) + 0.5))
            for i, c in sorted(tf.items()):
                x = idf * c * (K1 + 1) / (c + K1 * (1 - B + B * length[i] / mean))
                items.append(i)
                impacts.append(x)
                single[i] += [x / c] * c
            start.append(len(items))
        need = np.array([sum(sorted(s)[: least_triples(needed_words(len(w), share))]) for s, w in zip(single, self.words, strict=True)])
        self.post_start, self.post_item = np.array(start, np.int64), np.array(items, np.int64)
        self.post_impact = np.array(impacts) / np.maximum(need[self.post_item], 1e-12) * (1 + 1e-9) if items else np.zeros(0)
        tops, block_start = [], [0]
        for a, b in zip(start, start[1:], strict=False):
            tops += [self.post_impact[k : min(k + BLOCK, b)].max() for k in range(a, b, BLOCK)]
            block_start.append(len(tops))
        self.block_max, self.block_start = np.array(tops), np.array(block_start, np.int64)
        self.term_max = np.array([self.block_max[a:b].max() for a, b in zip(block_start, block_start[1:], strict=False)])

    @property
    def postings(self) -> list[list[tuple[int, float]]]:
        return [
            list(zip(self.post_item[a:b].tolist(), self.post_impact[a:b].tolist(), strict=True))
            for a, b in zip(self.post_start, self.post_start[1:], strict=False)
        ]

    def retrieve(self, terms: list[int], threshold: float = 1.0) -> list[int]:
        """Block-max WAND: all items whose summed impact reaches ``threshold``.

        Cursors stand at the next posting of each term.  The pivot is the first item whose terms'
        greatest impacts reach the threshold.  If the greatest impacts of the blocks that
        hold it do not, no item before the first of these blocks ends can
        reach it either, and all cursors move past there.
        """
        lists = []
        for t in terms:
            a, b = self.post_start[t], self.post_start[t + 1]
            lists.append([self.post_item[a:b].tolist(), self.post_impact[a:b].tolist(), self.block_max[self.block_start[t] : self.block_start[t + 1]].tolist(), float(self.term_max[t]), 0])
        out = []
        while lists:
            lists.sort(key=lambda c: c[0][c[4]])
            bound, pivot = 0.0, -1
            for k, c in enumerate(lists):
                bound += c[3]
                if bound >= threshold:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = lists[pivot][0][lists[pivot][4]]
            while pivot + 1 < len(lists) and lists[pivot + 1][0][lists[pivot + 1][4]] == item:
                pivot += 1
            upto = lists[: pivot + 1]
            # the block of each cursor that may hold the pivot
            at = [bisect_left(c[0], item, c[4]) // BLOCK for c in upto]
            if sum(c[2][b] for c, b in zip(upto, at, strict=True) if b < len(c[2])) < threshold:
                ends = [c[0][min((b + 1) * BLOCK, len(c[0])) - 1] + 1 for c, b in zip(upto, at, strict=True) if b < len(c[2])]
                if pivot + 1 < len(lists):
                    ends.append(lists[pivot + 1][0][lists[pivot + 1][4]])
                move_to = max(item + 1, min(ends, default=item + 1))
            elif lists[0][0][lists[0][4]] == item:
                if sum(c[1][c[4]] for c in upto) >= threshold:
                    out.append(item)
                move_to = item + 1
            else:
                move_to = item
            for c in upto:
                c[4] = bisect_left(c[0], move_to, c[4])
            lists = [c for c in lists if c[4] < len(c[0])]
        return out

    def near(self, word: str) -> tuple[int, ...]:
        """Codes of the indexed words that ``word``, which is not indexed, may be a misspelling of:
        those within two edits, and within the edits that :func:`similar` allows."""
        held = self.known.get(word)
        if held is None:
            if len(self.known) > KEPT_WORDS:
                self.known.clear()
            if self.deleted is None:
                self.deleted = defaultdict(list)
                for w, code in self.vocabulary.items():
                    if edits(w):
                        for d in set(_deletions(w, min(2, edits(w)))):
                            self.deleted[d].append(code)
                self.spelt = [""] + list(self.vocabulary)
            limit = min(2, edits(word))
            met = {c for d in set(_deletions(word, limit)) for c in self.deleted.get(d, ())} if limit else ()
            self.known[word] = held = tuple(sorted(c for c in met if similar(word, self.spelt[c])))
        return held


def similar(a: str, b: str) -> bool:
    """Whether two words are one word spelt differently: at most a quarter of the
    letters (at least one, in words of four letters or more) inserted, lost or changed."""
    if a == b:
        return True
    if min(len(a), len(b)) < 4:
        return False
    limit = max(1, max(len(a), len(b)) // 4)
    if abs(len(a) - len(b)) > limit:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
        if min(row) > limit:
            return False
    return row[-1] <= limit


def repeated_words(item: list[str], doc: list[str], hits: list[tuple[int, int]], gap: int = GAP) -> int:
    """Most words of ``item`` that one place of ``doc`` repeats in order in runs.

    ``hits`` are (document position, item position) of equal triples.  Runs grow over
    misspelt words in both directions; the best chain of runs is taken whose item
    positions rise and whose gaps in the document are at most ``gap`` words.
    """
    runs: list[list[int]] = []  # document start, item start, length
    done: set[tuple[int, int]] = set()
    for d, p in sorted(hits):
        if (d, p) in done:
            continue
        a, b = 0, RUN
        while p + b < len(item) and d + b < len(doc) and similar(item[p + b], doc[d + b]):
            b += 1
        while p - a > 0 and d - a > 0 and similar(item[p - a - 1], doc[d - a - 1]):
            a += 1
        done.update((d + k, p + k) for k in range(-a, b))
        runs.append([d - a, p - a, a + b])
    runs.sort()
    best: list[int] = []
    for k, (d, p, n) in enumerate(runs):
        top = n
        for j in range(k):
            dj, pj, nj = runs[j]
            # a run may overlap the one before by a few words, which then count once
            lap = max(0, pj + nj - p, dj + nj - d)
            if pj < p and dj < d and n - lap >= RUN and d - (dj + nj) <= gap:
                top = max(top, best[j] + n - lap)
        best.append(top)
    return max(best, default=0)


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of at most PART_BYTES of text."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
    a = 0
    while a < len(size):
        b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + PART_BYTES, side="right")))
        yield batch.slice(a, b - a)
        a = b


def _leaks(broadcast, share: float, gap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = broadcast.value
        code = index.vocabulary.get
        base = index.base
        for batch in chain.from_iterable(map(_parts, batches)):
            ids = batch.column(0)
            docs = [words_of(t) if t else [] for t in batch.column(1).to_pylist()]
            sizes = np.array([len(d) for d in docs], np.int64)
            flat = np.array(list(map(code, chain.from_iterable(docs), repeat(0))), np.int64)
            first = np.append(0, np.cumsum(sizes))
            rows: list[tuple[int, int, float, float]] = []
            if len(flat) >= RUN and len(index.terms):
                at, term = _triples(index, list(chain.from_iterable(docs)), flat, base)
                doc = np.searchsorted(first, at, side="right") - 1
                inside = at + RUN <= first[doc + 1]
                at, term, doc = at[inside], term[inside], doc[inside]
                cut = np.searchsorted(doc, np.arange(len(docs) + 1))
                for n in np.unique(doc):
                    a, b = cut[n], cut[n + 1]
                    rows += _document(index, docs[n], at[a:b] - first[n], term[a:b], int(n), share, gap)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array([r[0] for r in rows], pa.int64())),
                    pa.array([index.ids[r[1]] for r in rows], pa.int64()),
                    pa.array([r[2] for r in rows], pa.float64()),
                    pa.array([r[3] for r in rows], pa.float64()),
                    pa.array(["passage and question" if r[3] >= share else "passage" for r in rows], pa.string()),
                ],
                ["id", "item_id", "share", "question_share", "leaked"],
            )

    return run


def _triples(index: ItemIndex, words: list[str], flat: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and terms of the indexed triples, in order; words that are not indexed stand for those
    they may be misspellings of (``flat`` gets the first of these)."""
    others: dict[int, tuple[int, ...]] = {}
    for i in np.flatnonzero(flat == 0).tolist():
        near = index.near(words[i])
        if near:
            flat[i] = near[0]
            if len(near) > 1:
                others[i] = near
    at = np.flatnonzero((flat[:-2] > 0) & (flat[1:-1] > 0) & (flat[2:] > 0))
    key = (flat[at] * base + flat[at + 1]) * base + flat[at + 2]
    if others:
        more_at, more_key = [], []
        for p in {q for i in others for q in range(max(0, i - 2), min(i, len(flat) - RUN) + 1)}:
            if flat[p] and flat[p + 1] and flat[p + 2]:
                for a, b, c in product(*[others.get(p + k, (int(flat[p + k]),)) for k in range(RUN)]):
                    more_at.append(p)
                    more_key.append((a * base + b) * base + c)
        at, key = np.append(at, np.array(more_at, np.int64)), np.append(key, np.array(more_key, np.int64))
        pairs = np.unique(np.stack([at, key]), axis=1)
        at, key = pairs[0], pairs[1]
    term = np.minimum(np.searchsorted(index.terms, key), len(index.terms) - 1)
    ok = index.terms[term] == key
    return at[ok], term[ok]


def _document(index: ItemIndex, words: list[str], at: np.ndarray, term: np.ndarray, n: int, share: float, gap: int):
    """Leaks of one document: its passages as queries, then verification."""
    found: dict[int, float] = {}
    tried: set[int] = set()
    hits: dict[int, list[tuple[int, int]]] | None = None
    for start in range(0, max(1, len(words) - index.stride), index.stride):
        a, b = np.searchsorted(at, [start, start + index.window])
        # the largest possible score of the passage; most passages stop here
        if index.term_max[term[a:b]].sum() < 1.0:
            continue
        for item in index.retrieve(sorted(set(term[a:b].tolist()))):
            if item in tried:
                continue
            tried.add(item)
            if hits is None:
                hits = defaultdict(list)
                for d, t in zip(at.tolist(), term.tolist(), strict=True):
                    for k in range(index.place_start[t], index.place_start[t + 1]):
                        hits[int(index.place_item[k])].append((d, int(index.place_word[k])))
            size = len(index.words[item])
            got = repeated_words(index.words[item], words, hits[item], gap)
            if got >= share * size:
                found[item] = min(1.0, got / size)
    if not found:
        return []
    text = set(zip(words, words[1:], words[2:], strict=False))
    out = []
    for item, got in found.items():
        q = index.questions[item]
        grams = list(zip(q, q[1:], q[2:], strict=False))
        out.append((n, item, got, sum(g in text for g in grams) / len(grams) if grams else 0.0))
    # an item in several wordings is one item
    best = {index.ids[r[1]]: r for r in sorted(out, key=lambda r: (r[2], r[3]))}
    return list(best.values())


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    share: float = SHARE,
    gap: int = GAP,
    items_per_pass: int = ITEMS_PER_PASS,
) -> DataFrame:
    """``(id, item_id, share, question_share, leaked)`` for every document and item it leaks.

    ``share`` is the share of the item's words that the document repeats,
    ``question_share`` that of the question's word triples, and ``leaked`` says whether the question came
    along (``passage and question`` from ``share`` of it on) or the ``passage`` alone.  Whole texts are searched.
    The items' index is built once and broadcast after its size has been measured; items beyond
    ``items_per_pass`` or BYTES_PER_PASS take further passes over the corpus, which changes no
    result, as every item has a threshold of its own.  Null and empty texts leak nothing; items with a null or
    very short passage (under three words) cannot leak; repeated items are reported
    once, documents with equal ids each on their own.
    """
    kind = dict(docs.dtypes)[id_col]
    slim = spread(docs.select(F.col(id_col), F.col(text_col)).filter(F.length(text_col) > 0))
    items = items.select(F.col("item_id").cast("long"), "passage", "question").filter("item_id is not null and passage is not null").distinct()
    count, size = items.agg(F.count(F.lit(1)), F.sum(F.length("passage") + F.coalesce(F.length("question"), F.lit(0)))).first()
    blocks = max(1, ceil(count / items_per_pass), ceil((size or 0) / BYTES_PER_PASS))
    out = None
    for b in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b) if blocks > 1 else items
        rows = sorted({(r["item_id"], r["passage"], r["question"] or "") for r in part.collect()})  # a pass's items only
        if not rows and b:
            continue
        index = Shared(docs.sparkSession, ItemIndex(rows, share, gap))
        if index.size > INDEX_BYTES:
            raise ValueError("the index of one pass is too large; take fewer items per pass")
        found = slim.mapInArrow(
            _leaks(index, share, gap), f"id {kind}, item_id long, share double, question_share double, leaked string"
        ).withColumnRenamed("id", id_col)
        out = found if out is None else out.unionByName(found)
    return out
