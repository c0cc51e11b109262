"""Mergeable percentiles of very large columns with a deterministic rank error.

A value is quantised to one of ``2**UNIVERSE_BITS`` ordered cells (the top bits of its IEEE
representation: a relative width of 2**-12, the same for both signs).  Per key the counts live in a
dyadic tree over the cells: a node of level ``l`` (0 = one cell) is the number
``2**(UNIVERSE_BITS-l) + (cell >> l)``.  A digest is one row per key, ``(key..., n, nodes, counts)``.
Digests of partitions, days or runs are merged by adding up equal nodes.  Compression moves
the counts of a light node, its sibling and their parent into the parent while the
sum is at most ``n // k``.  In every merge of digests that were compressed alike a node above
the cells then holds at most ``n / k`` rows, so a rank is off by at most ``UNIVERSE_BITS * n / k``.

Every task builds the trees of its own rows; only trees are shuffled, and a key's trees
are added up as a stream, so a key with a third of all rows costs no more than its tree.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sign, 11 exponent bits and 12 mantissa bits of a double.
UNIVERSE_BITS = 24
_DROPPED = 40
_HALF = 1 << (UNIVERSE_BITS - 1)
#: The greatest finite cell; those beyond it stand for no value.
_LAST = _HALF + (0x7FEF_FFFF_FFFF_FFFF >> _DROPPED)
#: Compression parameter: rank error at most UNIVERSE_BITS / K of the rows (0.29 %).
K = 8192
#: Nodes that a task holds before it adds up equal ones.
PENDING = 1 << 20
#: Nodes after which a task passes its trees on and starts new ones.
HELD = 1 << 22


def cell_of(x: np.ndarray) -> np.ndarray:
    """Order-preserving cell numbers of finite doubles."""
    bits = (x + 0.0).view(np.int64)  # adding zero makes -0.0 a zero like others
    size = (bits & 0x7FFF_FFFF_FFFF_FFFF) >> _DROPPED
    return np.where(bits < 0, _HALF - 1 - size, _HALF + size)


def value_of(cell: np.ndarray) -> np.ndarray:
    """The middles of the cells' ranges of values; the cells next to zero are zero."""
    size = np.where(cell >= _HALF, cell - _HALF, _HALF - 1 - cell).astype(np.int64)
    middle = ((size << _DROPPED) | (1 << (_DROPPED - 1))).view(np.float64)
    return np.where(size == 0, 0.0, np.where(cell >= _HALF, middle, -middle))


def _compress(tree: np.ndarray, n: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Compressed trees; ``tree`` holds key codes above UNIVERSE_BITS + 1 bits of node number, sorted."""
    shift, mask = UNIVERSE_BITS + 1, (1 << (UNIVERSE_BITS + 1)) - 1
    codes, at = np.unique(tree >> shift, return_inverse=True)
    limits = np.bincount(at, weights=n, minlength=len(codes)).astype(np.int64) // k
    if not limits.any():
        return tree, n
    limit_of = lambda t: limits[np.searchsorted(codes, t >> shift)]
    done_t, done_n = [], []
    for level in range(UNIVERSE_BITS):
        here = (tree & mask) >= 1 << (UNIVERSE_BITS - level)
        if not here.any():
            continue
        up = (tree[here] & ~mask) | ((tree[here] & mask) >> 1)
        parent, at = np.unique(up, return_inverse=True)
        total = np.bincount(at, weights=n[here], minlength=len(parent)).astype(np.int64)
        rest_t, rest_n = tree[~here], n[~here]
        order = np.argsort(rest_t)
        rest_t, rest_n = rest_t[order], rest_n[order]
        pos = np.minimum(np.searchsorted(rest_t, parent), max(len(rest_t) - 1, 0))
        has = rest_t[pos] == parent if len(rest_t) else np.zeros(len(parent), bool)
        own = np.where(has, rest_n[pos] if len(rest_t) else 0, 0)
        merge = total + own <= limit_of(parent)
        stay = ~merge[at]
        done_t.append(tree[here][stay])
        done_n.append(n[here][stay])
        rest_n[pos[merge & has]] += total[merge & has]
        new = merge & ~has
        tree, n = np.concatenate([rest_t, parent[new]]), np.concatenate([rest_n, total[new]])
    tree, n = np.concatenate([*done_t, tree]), np.concatenate([*done_n, n])
    order = np.argsort(tree)
    return tree[order], n[order]


class _Trees:
    """The trees of the keys that one task has met."""

    def __init__(self, fields: list[pa.Field], k: int | None) -> None:
        self.fields, self.k = fields, k
        self.clear()

    def clear(self) -> None:
        self.code: dict[tuple, int] = {}
        self.tree, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.more: list[tuple[np.ndarray, np.ndarray]] = []
        self.pending = 0

    def codes(self, columns: list[pa.Array]) -> np.ndarray:
        """A number for each row's key, the same for equal keys (nulls are equal)."""
        joint = np.zeros(len(columns[0]), np.int64)
        for c in columns:
            d = c.dictionary_encode(null_encoding="encode")
            _, joint = np.unique(joint * max(1, len(d.dictionary)) + d.indices.to_numpy(), return_inverse=True)
        _, first = np.unique(joint, return_index=True)
        code = np.zeros(len(first), np.int64)
        order = np.argsort(first)  # new keys are numbered as they come
        for at, row in zip(order, zip(*[c.take(pa.array(first[order])).to_pylist() for c in columns], strict=True), strict=True):
            code[at] = self.code.setdefault(row, len(self.code))
        return code[joint]

    def add(self, code: np.ndarray, node: np.ndarray, n: np.ndarray) -> None:
        self.more.append(((code << (UNIVERSE_BITS + 1)) | node, n))
        self.pending += len(n)
        if self.pending > PENDING:
            self.settle()

    def settle(self) -> None:
        if not self.more:
            return
        tree = np.concatenate([self.tree, *[t for t, _ in self.more]])
        n = np.concatenate([self.n, *[n for _, n in self.more]])
        self.tree, at = np.unique(tree, return_inverse=True)
        self.n = np.bincount(at, weights=n, minlength=len(self.tree)).astype(np.int64)
        self.more, self.pending = [], 0
        if self.k is not None and len(self.tree):
            self.tree, self.n = _compress(self.tree, self.n, self.k)

    def give(self, keep_last: bool = False) -> Iterator[pa.RecordBatch]:
        """The trees as rows; all are given away, or all but the key met last."""
        self.settle()
        if not len(self.tree):
            return
        keys = list(self.code)
        kept = len(keys) - 1 if keep_last else -1
        code = self.tree >> (UNIVERSE_BITS + 1)
        out = code != kept
        held_tree, held_n = self.tree[~out] & ((1 << (UNIVERSE_BITS + 1)) - 1), self.n[~out]
        code, tree, n = code[out], self.tree[out] & ((1 << (UNIVERSE_BITS + 1)) - 1), self.n[out]
        if len(code):
            start = np.append(np.flatnonzero(np.append(True, code[1:] != code[:-1])), len(code))
            rows = [keys[c] for c in code[start[:-1]]]
            offsets = pa.array(start, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    *[pa.array([r[i] for r in rows], f.type) for i, f in enumerate(self.fields)],
                    pa.array(np.add.reduceat(n, start[:-1])),
                    pa.ListArray.from_arrays(offsets, pa.array(tree.astype(np.int32))),
                    pa.ListArray.from_arrays(offsets, pa.array(n)),
                ],
                [*[f.name for f in self.fields], "n", "nodes", "counts"],
            )
        self.clear()
        if kept >= 0:
            self.code = {keys[kept]: 0}
            self.tree, self.n = held_tree, held_n


def _build(n_keys: int, k: int | None):
    """mapInArrow function: the trees of a task's values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = None
        for batch in batches:
            trees = trees or _Trees([batch.schema.field(i) for i in range(n_keys)], k)
            x = batch.column(n_keys).to_numpy(zero_copy_only=False).astype(float)
            if len(x):
                trees.add(trees.codes(batch.columns[:n_keys]), (1 << UNIVERSE_BITS) + cell_of(x), np.ones(len(x), np.int64))
            if len(trees.tree) > HELD:
                yield from trees.give()
        if trees:
            yield from trees.give()

    return run


def _merge(n_keys: int, k: int | None, sorted_by_key: bool):
    """mapInArrow function: sums of trees.  Where rows come sorted by key, each key is given once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = None
        for batch in batches:
            trees = trees or _Trees([batch.schema.field(i) for i in range(n_keys)], k)
            if not batch.num_rows:
                continue
            nodes, counts = batch.column("nodes"), batch.column("counts")
            code = np.repeat(trees.codes(batch.columns[:n_keys]), np.diff(nodes.offsets.to_numpy()))
            trees.add(code, nodes.flatten().to_numpy(zero_copy_only=False).astype(np.int64), counts.flatten().to_numpy(zero_copy_only=False))
            if sorted_by_key:
                # keys are numbered as they come, so the last number is the key still open
                yield from trees.give(keep_last=True)
            elif len(trees.tree) > HELD:
                yield from trees.give()
        if trees:
            yield from trees.give()

    return run


def _schema(df: DataFrame, keys: Sequence[str]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join([*[f"`{c}` {kinds[c]}" for c in keys], "n long, nodes array<int>, counts array<long>"])


def _one_row_per_key(trees: DataFrame, keys: list[str], k: int | None) -> DataFrame:
    """Adds up the trees of each key: as a stream over the key's trees in order."""
    sorted_ = trees.repartition(*keys).sortWithinPartitions(*keys)
    return sorted_.mapInArrow(_merge(len(keys), k, True), _schema(trees, keys))


def build_digest(df: DataFrame, keys: Sequence[str], value: str, k: int | None = K) -> DataFrame:
    """Digest per key of the finite values, whatever their sign; null, NaN and infinite ones are not counted.

    Null keys form a group of their own; keys without any value have no row; columns other
    than ``keys`` and ``value`` are ignored.  ``k=None`` leaves the trees uncompressed.
    """
    keys = list(keys)
    x = F.col(value).cast("double")
    slim = df.select(*keys, x.alias("__x")).filter(F.col("__x").isNotNull() & ~F.isnan("__x") & (F.abs("__x") < float("inf")))
    return _one_row_per_key(slim.mapInArrow(_build(len(keys), k), _schema(df, keys)), keys, k)


def merge_digests(digests: Sequence[DataFrame], keys: Sequence[str], k: int | None = K) -> DataFrame:
    """Digest of all rows behind several digests, whose keys may be finer: equal nodes are added up,
    first within each task."""
    keys = list(keys)
    every = reduce(DataFrame.unionByName, [d.select(*keys, "n", "nodes", "counts") for d in digests])
    return _one_row_per_key(every.mapInArrow(_merge(len(keys), k, False), _schema(every, keys)), keys, k)


def _ranks(n_keys: int, pcts: list[int]):
    """mapInArrow function: the values of given ranks in every digest of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            nodes, counts = batch.column("nodes"), batch.column("counts")
            row = np.repeat(np.arange(batch.num_rows), np.diff(nodes.offsets.to_numpy()))
            node = nodes.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            count = counts.flatten().to_numpy(zero_copy_only=False)
            level = UNIVERSE_BITS + 1 - np.frexp(node.astype(float))[1]
            high = np.minimum(((node + 1) << level) - 1 - (1 << UNIVERSE_BITS), _LAST)
            order = np.lexsort((-node, high, row))  # nodes by the greatest cell they cover, smaller ones first
            upto = np.cumsum(count[order])
            n = batch.column("n").to_numpy()
            before = np.cumsum(n) - n
            parts = []
            for p in pcts:
                rank = np.maximum(1, -(-n * p // 100))
                at = order[np.searchsorted(upto, before + rank)]
                parts.append(
                    pa.RecordBatch.from_arrays(
                        [*batch.columns[:n_keys], pa.array(np.full(len(n), p, np.int32)), pa.array(value_of(high[at])), pa.array(n)],
                        [*batch.schema.names[:n_keys], "pct", "value", "n_rows"],
                    )
                )
            yield from parts

    return run


def quantiles(digest: DataFrame, keys: Sequence[str], pcts: Sequence[int]) -> DataFrame:
    """``(key..., pct, value, n_rows)``: the value of rank ceil(pct/100 * n) per key.

    The rank is off by at most UNIVERSE_BITS/K * n rows and the value by half a cell (2**-13 of it).
    """
    keys = list(keys)
    kinds = dict(digest.dtypes)
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in keys], "pct int, value double, n_rows long"])
    return digest.select(*keys, "n", "nodes", "counts").mapInArrow(_ranks(len(keys), [int(p) for p in pcts]), schema)
