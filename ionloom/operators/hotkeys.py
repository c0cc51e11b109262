"""Per-key aggregates that stay balanced when a few keys hold most rows.

Rows never travel by key.  Every input split dictionary-encodes the keys it meets and fills dense
accumulator arrays indexed by their codes (``numpy.bincount`` and scatter
reductions); only array blocks are shuffled, one per split and range of key hashes, and they are summed range by
range.  A key with a third of all rows costs the same as any other key, and
nothing depends on how many keys there are.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import small_or_none

#: Keys of one dictionary: a split that meets more passes its arrays on and starts anew.
DICTIONARY_LIMIT = 500_000
#: Ranges of key hashes, as a multiple of the shuffle partitions.
RANGES_PER_PARTITION = 4
#: Ids delivered more than once up to which their table is broadcast (16 bytes a row).
REPEATED_ROWS = 500_000


def _ids(id_col: str | Sequence[str]) -> list[str]:
    return [id_col] if isinstance(id_col, str) else list(id_col)


def _known(ids: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in ids])


def latest_per_id(df: DataFrame, id_col: str | Sequence[str], order_col: str, cols: Sequence[str]) -> DataFrame:
    """One row per id (one column or several): the one loaded last (ties: the greatest values).

    Rows with a null id are no delivery of anything and are left out.
    """
    ids = _ids(id_col)
    pick = F.max(F.struct(F.col(order_col).alias("__o"), *[F.col(c) for c in cols])).alias("__m")
    return df.filter(_known(ids)).groupBy(*ids).agg(pick).select(*ids, *[F.col(f"__m.{c}").alias(c) for c in cols])


def latest_wide(df: DataFrame, id_col: str | Sequence[str], order_col: str, cols: Sequence[str]) -> DataFrame:
    """As :func:`latest_per_id`, for rows of which few come more than once.

    Ids are counted first, which shuffles only ids.  Rows delivered once pass as they are; only those
    delivered repeatedly are reduced.  Where too many are, all rows are.
    """
    ids = _ids(id_col)
    df = df.filter(_known(ids))
    named = [f"__id{i}" for i in range(len(ids))]
    counts = df.groupBy(*[F.col(c).alias(n) for c, n in zip(ids, named, strict=True)]).agg(F.count(F.lit(1)).alias("__c"))
    repeated = counts.filter("__c > 1").select(*named)
    if small_or_none(repeated, REPEATED_ROWS) is None:
        return latest_per_id(df, ids, order_col, cols)
    slim = df.select(*ids, F.col(order_col).alias("__order"), *cols)
    same = [F.col(c) == F.col(n) for c, n in zip(ids, named, strict=True)]
    once = slim.join(F.broadcast(repeated), same, "left_anti").select(*ids, *cols)
    again = slim.join(F.broadcast(repeated), same, "left_semi")
    return once.unionByName(latest_per_id(again, ids, "__order", cols))


class _Arrays:
    """Dense accumulators over the codes of one dictionary."""

    def __init__(self, fields: list[pa.Field], n_values: int) -> None:
        self.fields, self.v = fields, n_values
        self.clear()

    def clear(self) -> None:
        self.code: dict[tuple, int] = {}
        self.hash: list[int] = []
        self.ints = np.zeros((1 + self.v, 0), np.int64)
        self.total, self.low, self.high = (np.zeros((self.v, 0)) for _ in range(3))

    def codes(self, columns: list[pa.Array], hashes: pa.Array) -> np.ndarray:
        """Dictionary codes of the rows' keys (nulls are equal); the arrays grow with the dictionary."""
        joint = np.zeros(len(hashes), np.int64)
        for c in columns:
            d = c.dictionary_encode(null_encoding="encode")
            _, joint = np.unique(joint * max(1, len(d.dictionary)) + d.indices.to_numpy(), return_inverse=True)
        _, first = np.unique(joint, return_index=True)
        at = pa.array(first)
        code = np.zeros(len(first), np.int64)
        for i, (key, h) in enumerate(zip(zip(*[c.take(at).to_pylist() for c in columns], strict=True), hashes.take(at).to_pylist(), strict=True)):
            code[i] = known = self.code.setdefault(key, len(self.code))
            if known == len(self.hash):
                self.hash.append(h)
        more = len(self.code) - self.ints.shape[1]
        if more > 0:
            more = max(more, self.ints.shape[1])  # grow by doubling
            self.ints = np.pad(self.ints, ((0, 0), (0, more)))
            self.total = np.pad(self.total, ((0, 0), (0, more)))
            self.low = np.pad(self.low, ((0, 0), (0, more)), constant_values=np.inf)
            self.high = np.pad(self.high, ((0, 0), (0, more)), constant_values=-np.inf)
        return code[joint]

    def add_rows(self, code: np.ndarray, values: list[np.ndarray]) -> None:
        size = self.ints.shape[1]
        self.ints[0] += np.bincount(code, minlength=size)
        for i, x in enumerate(values):
            ok = ~np.isnan(x)
            c, x = code[ok], x[ok]
            self.ints[1 + i] += np.bincount(c, minlength=size)
            self.total[i] += np.bincount(c, weights=x, minlength=size)
            np.minimum.at(self.low[i], c, x)
            np.maximum.at(self.high[i], c, x)

    def add_block(self, code: np.ndarray, ints: list[np.ndarray], floats: list[np.ndarray]) -> None:
        for i, x in enumerate(ints):
            np.add.at(self.ints[i], code, x)
        for i in range(self.v):
            total, low, high = floats[3 * i : 3 * i + 3]
            np.add.at(self.total[i], code, total)
            np.minimum.at(self.low[i], code, low)
            np.maximum.at(self.high[i], code, high)

    def columns(self, pick: np.ndarray) -> list[pa.Array]:
        """The accumulators of the picked codes: the ints, then sum, min and max of each value."""
        out = [pa.array(x[pick]) for x in self.ints]
        for i in range(self.v):
            out += [pa.array(x[i][pick]) for x in (self.total, self.low, self.high)]
        return out

    def keys(self, pick: np.ndarray) -> list[pa.Array]:
        every = list(self.code)
        return [pa.array([every[c][i] for c in pick], f.type) for i, f in enumerate(self.fields)]

    def blocks(self, ranges: int) -> Iterator[pa.RecordBatch]:
        """One row per range of key hashes: its keys and their accumulators as arrays."""
        if not self.code:
            return
        where = np.array(self.hash, np.int64) % ranges
        pick = np.argsort(where, kind="stable")
        met, start = np.unique(where[pick], return_index=True)
        offsets = pa.array(np.append(start, len(pick)), pa.int32())
        arrays = [pa.ListArray.from_arrays(offsets, a) for a in [*self.keys(pick), *self.columns(pick)]]
        yield pa.RecordBatch.from_arrays([pa.array(met), *arrays], ["range", *[f"a{i}" for i in range(len(arrays))]])
        self.clear()


def _accumulate(n_keys: int, n_values: int, ranges: int, limit: int):
    """mapInArrow function: one split -> its array blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = None
        for batch in batches:
            if not batch.num_rows:
                continue
            arrays = arrays or _Arrays([batch.schema.field(i) for i in range(n_keys)], n_values)
            code = arrays.codes(batch.columns[:n_keys], batch.column(n_keys))
            arrays.add_rows(code, [batch.column(n_keys + 1 + i).to_numpy(zero_copy_only=False).astype(float) for i in range(n_values)])
            if len(arrays.code) >= limit:
                yield from arrays.blocks(ranges)
        if arrays:
            yield from arrays.blocks(ranges)

    return run


def _reduce(n_keys: int, n_values: int, names: list[str]):
    """mapInArrow function over blocks sorted by range: the blocks of a range are summed as they come."""

    def close(arrays: _Arrays) -> pa.RecordBatch:
        pick = np.arange(len(arrays.code))
        cols = arrays.columns(pick)
        out = [*arrays.keys(pick), cols[0]]
        for i in range(n_values):
            some = arrays.ints[1 + i][pick] == 0
            out.append(cols[1 + i])
            out += [pa.array(x[i][pick], mask=some) for x in (arrays.total, arrays.low, arrays.high)]
        return pa.RecordBatch.from_arrays(out, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays, at = None, None
        for batch in batches:
            for row in range(batch.num_rows):
                lists = [batch.column(1 + i)[row].values for i in range(batch.num_columns - 1)]
                fields = [pa.field(names[i], lists[i].type) for i in range(n_keys)]
                here = batch.column(0)[row].as_py()
                if here != at:
                    if arrays is not None:
                        yield close(arrays)
                    arrays, at = _Arrays(fields, n_values), here
                code = arrays.codes(lists[:n_keys], pa.nulls(len(lists[0]), pa.int64()))
                rest = [x.to_numpy(zero_copy_only=False) for x in lists[n_keys:]]
                arrays.add_block(code, rest[: 1 + n_values], rest[1 + n_values :])
        if arrays is not None:
            yield close(arrays)

    return run


def aggregate_by_key(df: DataFrame, keys: Sequence[str], values: Sequence[str] = (), limit: int = DICTIONARY_LIMIT) -> DataFrame:
    """Rows per key and, for each value column, ``n_``, ``sum_``, ``min_`` and ``max_``.

    A null in a key is a key value of its own.  Null and NaN values are not counted
    in the value columns; a key without any value has sum, min and max null.  Extra
    columns are ignored.  An empty input gives an empty result.

    A split sends one block per range of key hashes and ``limit`` keys it has met, so a range's task reads
    at most as many accumulators of one key as there are splits.
    """
    keys, values = list(keys), list(values)
    kinds = dict(df.dtypes)
    ranges = RANGES_PER_PARTITION * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slim = df.select(
        *keys, F.pmod(F.xxhash64(*keys), F.lit((1 << 31) - 1)).alias("__h"), *[F.col(v).cast("double").alias(f"__v{i}") for i, v in enumerate(values)]
    )
    arrays = [*[kinds[k] for k in keys], *["long"] * (1 + len(values)), *["double"] * (3 * len(values))]
    schema = ", ".join(["range long", *[f"a{i} array<{t}>" for i, t in enumerate(arrays)]])
    blocks = slim.mapInArrow(_accumulate(len(keys), len(values), ranges, limit), schema)
    names = [*keys, "n_rows", *[f"{a}_{v}" for v in values for a in ("n", "sum", "min", "max")]]
    kind_of = [*[kinds[k] for k in keys], "long", *["long", "double", "double", "double"] * len(values)]
    out = ", ".join(f"`{c}` {t}" for c, t in zip(names, kind_of, strict=True))
    return blocks.repartition("range").sortWithinPartitions("range").mapInArrow(_reduce(len(keys), len(values), names), out)


def _has_pair(df: DataFrame) -> DataFrame:
    ok = F.col("charge").isNotNull() & ~F.isnan("precursor_mz") & (F.col("precursor_mz") > 0)
    return df.filter(ok).withColumn("mz_bin", F.floor("precursor_mz").cast("long"))


def charge_mz_pairs(spectra: DataFrame) -> DataFrame:
    """One row per spectrum that has a (charge, whole precursor m/z) pair.

    Spectra with null charge, or null, NaN or non-positive precursor m/z, have none.
    """
    one = latest_per_id(spectra, "spec_id", "loaded_at", ["charge", "precursor_mz"])
    return _has_pair(one).select("spec_id", "charge", "mz_bin", "precursor_mz")


def pair_stats(spectra: DataFrame, values: Sequence[str] = ()) -> DataFrame:
    """Spectra (and value statistics) per (charge, whole precursor m/z) pair."""
    return aggregate_by_key(charge_mz_pairs(spectra), ["charge", "mz_bin"], values)


def hot_pairs(spectra: DataFrame, permille: int = 15) -> DataFrame:
    """Pairs that hold at least ``permille`` thousandths of the distinct spectra."""
    total = spectra.select(F.count_distinct("spec_id")).first()[0]
    return pair_stats(spectra).filter(F.col("n_rows") * 1000 >= total * permille)
