"""Schemas that drift between the files of a feed.

Each file's columns are profiled (types, counts and a value sketch), columns of
consecutive files are compared by name, and what is left over on either side is
matched by a minimum-cost bipartite assignment on value agreement, type and name.
Matched columns are then unified under one name and type.

Bodies are parsed once.  Every task keeps bounded profiles of the files it meets and passes
on packed sketches, so neither records nor texts are shuffled.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage, small_or_none, spread
from .graph import connected_components

#: Entries of a column's value sketch: the values of the records with the smallest id
#: hashes.  Hashes are the same in all files, so sketches of two files hold the
#: same records as far as both files have them.
SKETCH = 1024
#: Least matching score of a rename; see :func:`_score`.
RENAME_SCORE = 0.5
#: Sketch entries that a task holds before it passes them on.
HELD = 400_000
#: Rows of file or name tables up to which they are broadcast (about 100 bytes a row).
BROADCAST_ROWS = 200_000

#: JSON types in the order of their names, which decides between equally frequent ones.
TYPES = ("array", "boolean", "decimal", "object", "string", "whole")
# fixed values: spellings of truth values
_TRUTH = {"yes": "true", "y": "true", "true": "true", "on": "true", "no": "false", "n": "false", "false": "false", "off": "false"}
_NUM = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
_SIGNED_AFTER = re.compile(r"([0-9]+(?:\.[0-9]+)?)([+-])")
_LEADING = re.compile(rf"\[?\s*({_NUM})(?:\s*[\s,;]\s*{_NUM})*(?:\s*\]|\s+\(?[a-z%]{{1,4}}\)?)?")


def number_of(value: object) -> float | None:
    """The leading number of a value: of ``2+`` or 2 it is 2, of ``[711.2, 66]`` and ``711.2 66`` 711.2."""
    if isinstance(value, bool) or value is None:
        return None
    if isinstance(value, int | float):
        return float(value)
    if isinstance(value, list):
        return number_of(value[0]) if value and not isinstance(value[0], list) else None
    if isinstance(value, str):
        text = value.strip().lower()
        m = _SIGNED_AFTER.fullmatch(text)
        if m:
            return float(m[2] + m[1])
        m = _LEADING.fullmatch(text)
        return float(m[1]) if m else None
    return None


def _type_of(value: object) -> int:
    if isinstance(value, str):
        return TYPES.index("string")
    if isinstance(value, bool):
        return TYPES.index("boolean")
    if isinstance(value, int):
        return TYPES.index("whole")
    if isinstance(value, float):
        return TYPES.index("decimal")
    return TYPES.index("array") if isinstance(value, list) else TYPES.index("object")


def text_of(value: object) -> str:
    """A value as text, numbers (also those written as text) in one notation."""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, list | dict):
        return json.dumps(value, ensure_ascii=False, separators=(",", ":"))
    n = number_of(value)
    if n is None:
        return str(value).strip()
    if isinstance(value, int):
        return str(value)
    return str(int(n)) if n.is_integer() and abs(n) < 2**53 else repr(n)


def _no_constant(name: str) -> None:
    raise ValueError(f"{name} is no JSON")


def _fields(body: str | None) -> dict[str, object]:
    """Non-null top-level fields by lower-case name; of repeated names the first non-null value.
    Bodies that are null, no JSON or no object have none."""
    try:
        doc = json.loads(body, parse_constant=_no_constant) if body else None
    except (ValueError, RecursionError):
        doc = None
    out: dict[str, object] = {}
    if isinstance(doc, dict):
        for k, v in doc.items():
            if v is not None:
                out.setdefault(k.lower(), v)
    return out


def _hash(text: str) -> int:
    return xxhash.xxh32_intdigest(text) - (1 << 31)


class _Profile:
    """Type counts and sketch of one column of one file."""

    __slots__ = ("types", "entries", "cut")

    def __init__(self) -> None:
        self.types = [0] * len(TYPES)
        self.entries: list[tuple[int, float, int]] = []
        self.cut = 1 << 31  # hashes from here on are beyond the sketch

    def add(self, h: int | None, value: object, sketch: int) -> None:
        self.types[_type_of(value)] += 1
        if h is None or h >= self.cut:
            return
        n = number_of(value)
        if n is None:
            text = text_of(value).lower()
            self.entries.append((h, np.nan, _hash(_TRUTH.get(text, text))))
        else:
            self.entries.append((h, n, 0))
        if len(self.entries) >= 2 * sketch:
            self.entries = _smallest(self.entries, sketch)
            self.cut = self.entries[-1][0] if len(self.entries) == sketch else self.cut


def _smallest(entries: list[tuple[int, float, int]], sketch: int) -> list[tuple[int, float, int]]:
    """One entry per hash, the smallest ``sketch`` hashes."""
    one = {e[0]: e for e in sorted(entries, key=lambda e: (e[0], e[2], e[1]), reverse=True)}
    return sorted(one.values(), key=lambda e: e[0])[:sketch]


_PROFILE = "feed string, file_name string, exported_at {at}, field string, types array<int>, h array<int>, number array<float>, code array<int>"


def _profiles(id_field: str, sketch: int, held: int):
    """mapInArrow function: bounded profiles of the files in a split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, _Profile] = {}
        size = 0
        for batch in batches:
            feeds, names, times, bodies = (batch.column(i).to_pylist() for i in range(4))
            for feed, name, at, body in zip(feeds, names, times, bodies, strict=True):
                record = _fields(body)
                ident = record.get(id_field)
                h = None if ident is None else _hash(text_of(ident))
                found.setdefault((feed, name, at, None), _Profile())  # a file without fields is a file too
                for field, value in record.items():
                    key = (feed, name, at, field)
                    p = found.get(key)
                    if p is None:
                        p = found[key] = _Profile()
                    size -= len(p.entries)
                    p.add(h, value, sketch)
                    size += len(p.entries)
            if size > held:
                yield _rows(found, batch.schema.field(2).type, sketch)
                found, size = {}, 0
        if found:
            yield _rows(found, batch.schema.field(2).type, sketch)

    return run


def _rows(found: dict[tuple, _Profile], at: pa.DataType, sketch: int) -> pa.RecordBatch:
    parts = [_smallest(p.entries, sketch) for p in found.values()]
    column = lambda i, t: pa.array([[e[i] for e in part] for part in parts], pa.list_(t))
    keys = list(found)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([k[2] for k in keys], at),
            pa.array([k[3] for k in keys], pa.string()), pa.array([p.types for p in found.values()], pa.list_(pa.int32())),
            column(0, pa.int32()), column(1, pa.float32()), column(2, pa.int32()),
        ],
        ["feed", "file_name", "exported_at", "field", "types", "h", "number", "code"],
    )


def profile_fields(records: DataFrame, id_field: str = "spec_id", sketch: int = SKETCH, held: int = HELD) -> DataFrame:
    """Type counts (in the order of TYPES) and value sketch of each field of each file.

    Fields have lower-case names; a row with a null field stands for the file itself.  A file that
    lies in several splits has rows for each; their counts add up, their sketches unite.  A sketch holds the
    id hashes and, at the same places, the numbers (NaN where a value has none) and text codes.
    """
    slim = records.select("feed", "file_name", "exported_at", "body")
    return spread(slim).mapInArrow(_profiles(id_field, sketch, held), _PROFILE.format(at=dict(records.dtypes)["exported_at"]))


def _kinds(profiles: DataFrame) -> DataFrame:
    """``(feed, file_name, field, type)``: the type that most values have."""
    sums = profiles.filter(F.col("field").isNotNull()).groupBy("feed", "file_name", "field").agg(
        *[F.sum(F.get("types", F.lit(i))).alias(t) for i, t in enumerate(TYPES)]
    )
    most = F.greatest(*[F.struct(F.col(t).alias("n"), F.lit(t).alias("t")) for t in TYPES])
    return sums.select("feed", "file_name", "field", most["t"].alias("type"))


def file_order(records: DataFrame) -> DataFrame:
    """Files with their place in the feed (by exported_at, then name) and the files before and after."""
    files = records.groupBy("feed", "file_name").agg(F.min("exported_at").alias("exported_at"))
    w = Window.partitionBy("feed").orderBy("exported_at", "file_name")
    return files.select(
        "feed", "file_name", F.row_number().over(w).alias("pos"), F.lag("file_name").over(w).alias("prev_file"), F.lead("file_name").over(w).alias("next_file")
    )


def _small(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcast if it has been counted and is small; else it is joined by shuffling."""
    return df if small_or_none(df, BROADCAST_ROWS) is None else F.broadcast(df)


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Minimum-cost assignment of rows to columns by shortest augmenting paths."""
    if cost.size == 0:
        return []
    if cost.shape[0] > cost.shape[1]:
        return [(i, j) for j, i in assign(cost.T)]
    n, m = cost.shape
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    owner = np.zeros(m + 1, int)  # row (from 1) that holds a column (from 1)
    for row in range(1, n + 1):
        owner[0], j0 = row, 0
        dist, back, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            i0 = owner[j0]
            reduced = cost[i0 - 1] - u[i0] - v[1:]
            free = ~used[1:]
            better = free & (reduced < dist[1:])
            dist[1:][better], back[1:][better] = reduced[better], j0
            j1 = 1 + int(np.argmin(np.where(free, dist[1:], np.inf)))
            step = dist[j1]
            u[owner[used]] += step
            v[used] -= step
            dist[~used] -= step
            j0 = j1
            if owner[j0] == 0:
                break
        while j0:
            owner[j0], j0 = owner[back[j0]], back[j0]
    return [(int(owner[j]) - 1, j - 1) for j in range(1, m + 1) if owner[j]]


def _grams(name: str) -> set[str]:
    name = f" {name.replace('_', ' ')} "
    return {name[i : i + 3] for i in range(len(name) - 2)}


class _Column:
    """A left-over column: its name, type and sketch, by record hash."""

    def __init__(self, field: str, kind: str) -> None:
        self.field, self.kind = field, kind
        self.number: dict[int, float] = {}
        self.code: dict[int, int] = {}

    def unite(self, h: list[int], number: list[float], code: list[int]) -> None:
        for k, x, c in zip(h, number, code, strict=True):
            if k not in self.number:
                self.number[k], self.code[k] = x, c

    def settle(self, sketch: int) -> None:
        for k in sorted(self.number)[sketch:]:
            del self.number[k], self.code[k]

    def values(self) -> set:
        return {self.code[k] if x != x else ("n", round(x, 6)) for k, x in self.number.items()}


def _score(a: _Column, b: _Column) -> float:
    """How well column ``b`` continues column ``a``, from 0 to 1.

    Three quarters come from the values: the share of records held by both files whose
    values agree (numbers up to rounding or in one constant ratio, as after a change
    of unit; texts and truth values whatever their spelling), or, with fewer than three such records, half the overlap of the value
    sets.  The rest comes from the names' trigrams and from equal types.
    """
    both = a.number.keys() & b.number.keys()
    agree, ratios = 0, []
    for h in both:
        x, y = a.number[h], b.number[h]
        if x == x and y == y:
            agree += abs(x - y) <= 1e-4 * max(abs(x), abs(y), 1e-9)
            if x and y:
                ratios.append(y / x)
        else:
            agree += x != x and y != y and a.code[h] == b.code[h]
    if len(both) >= 3:
        value = agree / len(both)
        if value < 0.5 and len(ratios) == len(both) and len({a.number[h] for h in both}) >= 3:
            value = float(np.ptp(ratios) <= 1e-3 * abs(np.mean(ratios)))
    else:
        s, t = a.values(), b.values()
        value = 0.5 * len(s & t) / max(1, min(len(s), len(t))) + 0.5 * (agree / len(both) if both else 0)
    g, k = _grams(a.field), _grams(b.field)
    return 0.75 * value + 0.15 * len(g & k) / max(1, min(len(g), len(k))) + 0.1 * (a.kind == b.kind)


def _match(gone: list[_Column], new: list[_Column]) -> list[tuple[str, str, str]]:
    """Left-over columns of a file's predecessor and of the file itself -> changes."""
    score = np.array([[_score(a, b) for b in new] for a in gone]).reshape(len(gone), len(new))
    pairs = [(i, j) for i, j in assign(np.where(score >= RENAME_SCORE, -score, 0.0)) if score[i, j] >= RENAME_SCORE]
    out = []
    for i, j in pairs:
        out.append(("renamed", gone[i].field, new[j].field))
        if gone[i].kind != new[j].kind:
            out.append(("retyped", gone[i].field, new[j].field))
    used_a, used_b = {i for i, _ in pairs}, {j for _, j in pairs}
    out += [("removed", c.field, "") for i, c in enumerate(gone) if i not in used_a]
    return out + [("added", "", c.field) for j, c in enumerate(new) if j not in used_b]


def _matches(sketch: int):
    """mapInArrow function over left-over columns sorted by file: one file after the other is matched.
    A file has as many rows as left-over columns and splits, whatever the number of its records."""

    def close(key: tuple, columns: dict[tuple, _Column]) -> Iterator[pa.RecordBatch]:
        for c in columns.values():
            c.settle(sketch)
        side = lambda s: [c for (t, _), c in sorted(columns.items()) if t == s]
        rows = _match(side("before"), side("after"))
        strings = [pa.array([r[i] for r in rows], pa.string()) for i in range(3)]
        yield pa.RecordBatch.from_arrays([pa.array([key[0]] * len(rows), pa.string()), pa.array([key[1]] * len(rows), pa.string()), *strings], _CHANGE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, columns = None, {}
        for batch in batches:
            for r in batch.to_pylist():
                at = (r["feed"], r["key"])
                if at != key:
                    if key is not None:
                        yield from close(key, columns)
                    key, columns = at, {}
                c = columns.setdefault((r["side"], r["field"]), _Column(r["field"], r["type"]))
                c.unite(r["h"], r["number"], r["code"])
        if key is not None:
            yield from close(key, columns)

    return run


_CHANGE = ["feed", "file_name", "change", "field_before", "field_after"]


def _changes(profiles: DataFrame, order: DataFrame, kinds: DataFrame, sketch: int = SKETCH) -> DataFrame:
    """Changes of every file but a feed's first, from checkpointed profiles."""
    after = kinds.join(_small(order.filter("prev_file is not null").select("feed", "file_name")), ["feed", "file_name"])
    next_of = order.filter("next_file is not null").select("feed", "file_name", F.col("next_file").alias("key"))
    before = kinds.join(_small(next_of), ["feed", "file_name"])
    pair = before.select("feed", F.col("key"), "field", F.col("type").alias("b"), F.col("file_name").alias("b_file")).join(
        after.select("feed", F.col("file_name").alias("key"), "field", F.col("type").alias("a")), ["feed", "key", "field"], "full"
    )
    pair = cut_lineage(pair.filter("a is null or b is null or a <> b"))
    same = pair.filter("a is not null and b is not null").select(
        "feed", F.col("key").alias("file_name"), F.lit("retyped").alias("change"), F.col("field").alias("field_before"), F.col("field").alias("field_after")
    )
    left = pair.filter("a is null or b is null").select(
        "feed", "key", "field", F.when(F.col("a").isNull(), "before").otherwise("after").alias("side"),
        F.coalesce("a", "b").alias("type"), F.coalesce("b_file", "key").alias("file_name"),
    )
    rows = profiles.filter(F.col("field").isNotNull()).select("feed", "file_name", "field", "h", "number", "code").join(_small(left), ["feed", "file_name", "field"])
    in_order = rows.select("feed", "key", "side", "field", "type", "h", "number", "code").repartition("feed", "key").sortWithinPartitions("feed", "key")
    return in_order.mapInArrow(_matches(sketch), ", ".join(f"{c} string" for c in _CHANGE)).unionByName(same)


def schema_changes(records: DataFrame, id_field: str = "spec_id", sketch: int = SKETCH) -> DataFrame:
    """``(file_name, change, field_before, field_after)`` for every file but a feed's first.

    A file without any field has lost all of them.  Repeated records change nothing;
    extra columns of ``records`` are ignored; an empty input has no changes.
    """
    profiles = cut_lineage(profile_fields(records, id_field, sketch))
    found = _changes(profiles, cut_lineage(file_order(profiles)), cut_lineage(_kinds(profiles)), sketch)
    return found.select("file_name", "change", "field_before", "field_after")


def canonical_names(profiles: DataFrame, order: DataFrame, kinds: DataFrame, changes: DataFrame, prefer: Sequence[str] = ()) -> DataFrame:
    """``(feed, file_name, field, canonical)``: one name for each quantity, over all files and feeds.

    A field's stretch of consecutive files is a node, renames link stretches, and linked
    stretches are one quantity of the feed.  Its name is the one that stands for all names which renames
    anywhere connect (the first of ``prefer`` among them, else the smallest).  Where two
    quantities of a feed that exist at the same time would get one name, the one that bears it keeps it
    and the others keep names of their own, so no value hides another.
    """
    place = order.select("feed", "file_name", "pos")
    held = kinds.join(_small(place), ["feed", "file_name"]).select("feed", "file_name", "field", "pos")
    w = Window.partitionBy("feed", "field").orderBy("pos")
    begins = F.when(F.coalesce(F.lag("pos").over(w), F.lit(-1)) != F.col("pos") - 1, F.col("pos"))
    held = held.withColumn("begins", begins).withColumn("start", F.max("begins").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    node = F.concat_ws("\x1f", "feed", "field", F.lpad(F.col("start").cast("string"), 9, "0"))
    held = cut_lineage(held.select("feed", "file_name", "field", "pos", node.alias("node")))
    renames = changes.filter("change = 'renamed'").join(_small(place), ["feed", "file_name"])
    ends = held.select("feed", "field", "pos", "node")
    links = renames.join(ends.select("feed", F.col("field").alias("field_before"), (F.col("pos") + 1).alias("pos"), F.col("node").alias("u")), ["feed", "field_before", "pos"]).join(
        ends.select("feed", F.col("field").alias("field_after"), "pos", F.col("node").alias("v")), ["feed", "field_after", "pos"]
    )
    quantity = connected_components(links.select("u", "v"), "u", "v").withColumnRenamed("component", "quantity")
    held = held.join(_small(quantity), "node", "left").withColumn("quantity", F.coalesce("quantity", "node"))
    names = connected_components(renames, "field_before", "field_after")
    liked = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(p) for p in prefer]).cast("array<string>"), F.col("node")), F.lit(0)), F.lit(len(prefer) + 1))
    chief = names.groupBy("component").agg(F.min_by("node", F.struct(liked.alias("r"), F.col("node").alias("n"))).alias("chief"))
    names = names.join(chief, "component").select(F.col("node").alias("field"), "chief")
    every = held.groupBy("feed", "quantity").agg(F.min("field").alias("field"), F.min("pos").alias("first"), F.max("pos").alias("last"), F.collect_set("field").alias("fields"))
    every = every.join(_small(names), "field", "left").withColumn("chief", F.coalesce("chief", "field"))
    bears = F.array_contains("fields", F.col("chief"))
    w = Window.partitionBy("feed", "chief").orderBy(F.desc(bears), "first", "field")
    so_far = F.max("last").over(w.rowsBetween(Window.unboundedPreceding, -1))
    clash = F.coalesce(so_far >= F.col("first"), F.lit(False))
    every = every.withColumn("clash", clash).withColumn("name", F.when(F.col("clash"), F.col("field")).otherwise(F.col("chief")))
    # a name of its own that another quantity of the feed bears gets a number
    w = Window.partitionBy("feed", "name").orderBy("clash", "first", "field")
    again = F.sum(F.col("clash").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    kept = F.count(F.when(~F.col("clash"), 1)).over(Window.partitionBy("feed", "name"))
    number = again + F.least(kept, F.lit(1))
    every = every.withColumn("canonical", F.when(F.col("clash") & (number > 1), F.concat_ws("#", "name", number.cast("string"))).otherwise(F.col("name")))
    return held.join(_small(every.select("feed", "quantity", "canonical")), ["feed", "quantity"]).select("feed", "file_name", "field", "canonical")


def _unified(columns: list[tuple[str, str, str]]):
    """mapInArrow function: one parse of each body; names and types as unified."""
    make = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}

    def cast(value: object, kind: str):
        if value is None:
            return None
        if kind == "string":
            return text_of(value)
        n = number_of(value)
        if n is None or n != n or abs(n) == float("inf"):
            return None
        if kind == "double":
            return n
        whole = value if isinstance(value, int) else int(n) if n.is_integer() else None
        return whole if whole is not None and abs(whole) < 1 << (63 if kind == "long" else 31) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new_names = [dict(m or ()) for m in batch.column(4).to_pylist()]
            maps, typed = [], [[] for _ in columns]
            for body, names in zip(batch.column(3).to_pylist(), new_names, strict=True):
                record = {names.get(k, k): v for k, v in _fields(body).items()}
                maps.append(sorted((k, text_of(v)) for k, v in record.items()))
                for out, (_, field, kind) in zip(typed, columns, strict=True):
                    out.append(cast(record.get(field), kind))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(maps, pa.map_(pa.string(), pa.string())), *[pa.array(v, make[c[2]]) for v, c in zip(typed, columns, strict=True)]],
                ["feed", "file_name", "record_no", "fields", *[c[0] for c in columns]],
            )

    return run


def unify(records: DataFrame, core: Sequence[str] | Mapping[str, tuple[str, str]] = (), id_field: str = "spec_id") -> DataFrame:
    """All records as one table: ``feed, file_name, record_no`` and ``fields``, a map of canonical
    fields to text with numbers in one notation, and columns of their own for ``core``.

    ``core`` lists canonical names (text columns), or gives for each column the canonical name
    and the type (``long``, ``int``, ``double`` or ``string``); these names are preferred as canonical ones.  A typed
    column holds the leading number of a value, whatever JSON type the file gives it; values without one are null
    there and stay in ``fields``.  Of a record's equal names (in any letter case) the first non-null value counts.
    Rows without any field are kept with an empty map, repeated records (equal but for other columns) once.
    """
    columns = [(c, f, t) for c, (f, t) in core.items()] if isinstance(core, Mapping) else [(c, c, "string") for c in core]
    profiles = cut_lineage(profile_fields(records, id_field))
    order, kinds = cut_lineage(file_order(profiles)), cut_lineage(_kinds(profiles))
    changes = cut_lineage(_changes(profiles, order, kinds))
    prefer = list(dict.fromkeys(f for _, f, _ in columns))
    names = canonical_names(profiles, order, kinds, changes, prefer).filter("field <> canonical")
    per_file = names.groupBy("feed", "file_name").agg(F.map_from_entries(F.collect_list(F.struct("field", "canonical"))).alias("names"))
    rows = records.select("feed", "file_name", "record_no", "body").distinct().join(_small(cut_lineage(per_file)), ["feed", "file_name"], "left")
    kind = dict(records.dtypes)["record_no"]
    schema = f"feed string, file_name string, record_no {kind}, fields map<string,string>" + "".join(f", `{c}` {t}" for c, _, t in columns)
    return rows.select("feed", "file_name", "record_no", "body", "names").mapInArrow(_unified(columns), schema)
