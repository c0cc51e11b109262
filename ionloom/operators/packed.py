"""Splitting several values packed in one text field, one row per value.

The work is done on the Arrow string buffer of a whole batch: byte masks for
quotes, separators and ``=``; quote parity by runs of quote characters; then all
rows of the batch step from item to item together.  Items come out as offsets into
the buffer, are gathered into string arrays, wrapped as a list array by the rows'
child offsets and flattened with the parent ordinals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DQ, SQ, BS, EQ, BLANK, COMMA = (ord(c) for c in "\"'\\= ,")
HARD = np.zeros(256, bool)
HARD[[ord(c) for c in ";|\t\n\r"]] = True
#: Bytes handled at once; a longer text is a chunk of its own.
CHUNK_BYTES = 16 << 20


class _Marks:
    """Masks and jump tables over one byte buffer (``end`` is its length)."""

    def __init__(self, data: np.ndarray, row_of: np.ndarray, row_end: np.ndarray) -> None:
        n = self.end = len(data)
        at = np.arange(n, dtype=np.int64)
        self.data = data
        blank = data == BLANK
        soft = blank | (data == COMMA)
        hard = HARD[data]
        # quotes that are not escaped: preceded by an even number of backslashes
        run = np.zeros(n, np.int64)
        if n and (data == BS).any():
            last_other = np.maximum.accumulate(np.where(data != BS, at, -1))
            before = np.concatenate([[-1], last_other[:-1]])
            run = at - 1 - before
        self.close: dict[int, np.ndarray] = {}
        self.run_end: dict[int, np.ndarray] = {}
        for q in (DQ, SQ):
            mark = (data == q) & (run % 2 == 0)
            new_row = np.concatenate([[True], row_of[1:] != row_of[:-1]]) if n else np.zeros(0, bool)
            first = mark & (np.concatenate([[True], ~mark[:-1]]) | new_row) if n else mark
            last = mark & (np.concatenate([~mark[1:] | new_row[1:], [True]])) if n else mark
            starts, ends = np.flatnonzero(first), np.flatnonzero(last)
            odd = (ends - starts) % 2 == 0
            self.close[q] = ends[odd]  # a run of odd length, met inside quotes, closes at its last character
            to = np.full(n, -1, np.int64)
            for_run = np.repeat(ends, ends - starts + 1)
            to[mark] = for_run
            self.run_end[q] = to
        self.row_end = row_end
        # position of the next byte that is not blank / next '=' / next separator
        self.next_solid = _next(~blank, n)
        self.next_eq = _next(data == EQ, n)
        # a soft run separates where a new "name=" or a quoted item follows it
        stop = hard | soft | (data == EQ) | (data == DQ) | (data == SQ)
        name_end = _next(stop, n)
        solid = np.append(self.next_solid, n)
        run_start = soft & (~np.concatenate([[False], soft[:-1]])) if n else soft
        s = np.flatnonzero(run_start)
        token = _next(~soft, n)[s] if len(s) else s
        inside = token < np.where(len(s), row_end[row_of[s]] if len(s) else 0, 0)
        token = np.minimum(token, max(n - 1, 0))
        opens = np.zeros(len(s), bool)
        if len(s):
            kind = data[token]
            for q in (DQ, SQ):
                m = inside & (kind == q)
                opens[m] = self.closing(token[m], q) >= 0
            ne = name_end[token]
            eq_at = solid[np.minimum(ne, n)]
            ok = inside & (ne > token) & (eq_at < row_end[row_of[s]])
            ok[ok] = data[eq_at[ok]] == EQ
            gap = ok & (eq_at > ne)
            ok[gap] &= data[ne[gap]] == BLANK
            opens |= ok
        self.boundary = np.zeros(n, bool)
        if len(s):
            token_of = _next(~soft, n)
            good = np.zeros(n + 1, bool)
            good[s[opens]] = True
            start_of = np.maximum.accumulate(np.where(run_start, at, -1))
            m = soft & (start_of >= 0)
            self.boundary[m] = good[start_of[m]]
            del token_of
        self.next_sep = _next(hard | self.boundary, n)

    def closing(self, opened: np.ndarray, q: int) -> np.ndarray:
        """Where the quotes opened at ``opened`` close, -1 if they never do."""
        end = self.row_end_of(opened)
        run_end = self.run_end[q][opened]
        # the rest of the opening run, seen from inside the quotes
        rest = run_end - opened
        here = np.where((run_end >= 0) & (rest % 2 == 1), run_end, -1)
        k = np.searchsorted(self.close[q], np.maximum(run_end, opened), side="right")
        later = np.append(self.close[q], self.end)[k]
        found = np.where(here >= 0, here, later)
        return np.where((run_end >= 0) & (found < end), found, -1)

    def row_end_of(self, at: np.ndarray) -> np.ndarray:
        return self.row_end[np.searchsorted(self.row_end, at, side="right")]


def _next(mask: np.ndarray, n: int) -> np.ndarray:
    """For each position the smallest position >= it where the mask holds (n if none); one extra entry."""
    at = np.where(mask, np.arange(n, dtype=np.int64), n)
    return np.append(np.minimum.accumulate(at[::-1])[::-1], n)


def _scan(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> dict[str, np.ndarray]:
    """Item boundaries of all rows; one vectorised step per item number."""
    n = len(data)
    size = end - start
    row_of = np.repeat(np.arange(len(start)), size)
    keep = size > 0
    marks = _Marks(data, np.cumsum(np.append(0, row_of[1:] != row_of[:-1]))[: len(row_of)] if n else row_of, end[keep])
    found: list[tuple] = []
    rows, at, last = np.flatnonzero(keep), start[keep].copy(), end[keep]
    while len(rows):
        # to the start of the next item: blanks, separators of either kind
        skip = np.ones(len(rows), bool)
        while skip.any():
            i = np.flatnonzero(skip)
            a = np.minimum(marks.next_solid[at[i]], last[i])
            inside = a < last[i]
            step = np.zeros(len(i), bool)
            b = a[inside]
            step[inside] = HARD[data[b]] | marks.boundary[b]
            at[i] = a + step
            skip[i] = step
        live = at < last
        rows, at, last = rows[live], at[live], last[live]
        if not len(rows):
            break
        m = len(rows)
        name_a, name_b = at.copy(), np.zeros(m, np.int64)
        val_a, val_b = np.zeros(m, np.int64), np.zeros(m, np.int64)
        quote = np.zeros(m, np.int64)  # the quote character, if quoted
        whole = np.zeros(m, bool)  # quotes around the whole item
        nxt = np.zeros(m, np.int64)
        closed = np.full(m, -1, np.int64)
        for q in (DQ, SQ):
            i = np.flatnonzero(data[at] == q)
            if len(i):
                closed[i] = marks.closing(at[i], q)
                quote[i[closed[i] >= 0]] = q
        whole = closed >= 0
        i = np.flatnonzero(whole)
        if len(i):
            e = np.minimum(marks.next_eq[at[i] + 1], closed[i])
            name_a[i], name_b[i] = at[i] + 1, e
            val_a[i], val_b[i] = np.minimum(e + 1, closed[i]), closed[i]
            nxt[i] = np.minimum(marks.next_sep[np.minimum(closed[i] + 1, n)], last[i])
            # text after the closing quote is no item of its own: it stays in the content
            tail = np.minimum(marks.next_solid[np.minimum(closed[i] + 1, n)], nxt[i]) < nxt[i]
            val_b[i[tail]] = nxt[i[tail]]
        i = np.flatnonzero(~whole)
        if len(i):
            sep = np.minimum(marks.next_sep[at[i]], last[i])
            e = marks.next_eq[at[i]]
            has = e < sep
            j = i[has]
            name_b[j] = e[has]
            c = np.minimum(marks.next_solid[np.minimum(e[has] + 1, n)], last[j])
            val_a[j] = c
            inner = np.full(len(j), -1, np.int64)
            for q in (DQ, SQ):
                k = np.flatnonzero((c < last[j]) & (data[np.minimum(c, n - 1)] == q))
                if len(k):
                    inner[k] = marks.closing(c[k], q)
                    quote[j[k[inner[k] >= 0]]] = q
            quoted = inner >= 0
            after = np.minimum(np.where(quoted, inner + 1, c), last[j])
            nxt[j] = np.minimum(marks.next_sep[after], last[j])
            # quotes go only when nothing but blanks follows them before the separator
            tail = np.minimum(marks.next_solid[after], nxt[j])
            clean = quoted & (tail >= nxt[j])
            val_a[j] = np.where(clean, c + 1, c)
            val_b[j] = np.where(clean, inner, nxt[j])
            j = i[~has]
            name_b[j] = nxt[j] = sep[~has]
            val_a[j] = val_b[j] = name_b[j]
        found.append((rows, name_a, name_b, val_a, val_b, quote))
        at = nxt
    if not found:
        return {k: np.zeros(0, np.int64) for k in ("row", "name_a", "name_b", "val_a", "val_b", "quote")}
    cols = [np.concatenate(x) for x in zip(*found, strict=True)]
    order = np.argsort(cols[0], kind="stable")
    return dict(zip(("row", "name_a", "name_b", "val_a", "val_b", "quote"), [c[order] for c in cols], strict=True))


def _slices(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.Array:
    """Strings ``data[a:b]``, gathered in one step."""
    size = np.maximum(b - a, 0)
    offsets = np.append(0, np.cumsum(size))
    take = np.arange(offsets[-1]) + np.repeat(a - offsets[:-1], size)
    return pa.LargeStringArray.from_buffers(len(a), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[take]))


def _unquote(text: pa.Array, quote: np.ndarray) -> pa.Array:
    """Escaped and doubled quotes of quoted texts become one quote."""
    for q, c in ((DQ, '"'), (SQ, "'")):
        m = quote == q
        if m.any():
            one = pc.replace_substring(pc.replace_substring(text, "\\" + c, c), c + c, c)
            text = pc.if_else(pa.array(m), one, text)
    return text


def split_batch(ids: pa.Array, text: pa.Array) -> pa.Table:
    """All items of a batch of texts: id, item number from 1, name, content."""
    text = text.cast(pa.large_string()).fill_null("")
    ofs = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    raw = text.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[ofs[0] : ofs[-1]] if raw is not None else np.zeros(0, np.uint8)
    ofs = ofs - ofs[0]
    items = _scan(data, ofs[:-1], ofs[1:])
    quote = items["quote"]
    name = pc.utf8_trim_whitespace(pc.utf8_lower(_unquote(_slices(data, items["name_a"], items["name_b"]), quote)))
    content = pc.utf8_trim_whitespace(_unquote(_slices(data, items["val_a"], items["val_b"]), quote))
    # an item of which nothing is left, such as a pair of quotes, does not count
    some = pc.or_(pc.not_equal(name, ""), pc.not_equal(content, ""))
    full = pa.table({"row": items["row"], "name": name, "content": content}).filter(some)
    row = full.column("row").to_numpy()
    # child offsets, list arrays, and the flattened rows with their parents' ordinals
    child = np.searchsorted(row, np.arange(len(text) + 1)).astype(np.int64)
    names = pa.LargeListArray.from_arrays(child, full.column("name").combine_chunks())
    contents = pa.LargeListArray.from_arrays(child, full.column("content").combine_chunks())
    parent = pc.list_parent_indices(names)
    number = np.arange(len(row)) - child[:-1][parent.to_numpy()] + 1 if len(row) else np.zeros(0)
    return pa.table(
        {
            "id": ids.take(parent),
            "item_no": pa.array(number.astype(np.int32)),
            "name": pc.list_flatten(names).cast(pa.string()),
            "content": pc.list_flatten(contents).cast(pa.string()),
        }
    )


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, text = batch.column(0), batch.column(1)
        # chunks of bounded size keep the masks in memory whatever the texts' lengths
        size = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False))
        a = 0
        while a < len(ids):
            base = size[a - 1] if a else 0
            b = max(a + 1, int(np.searchsorted(size, base + CHUNK_BYTES, side="right")))
            yield from split_batch(ids.slice(a, b - a), text.slice(a, b - a)).to_batches()
            a = b


def split_packed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, item_no, name, content)``: one row per item of the packed text.

    A quote opens at the start of an item or of its content, ``'`` and ``"`` alike;
    nothing within quotes separates, and an escaped or doubled quote is one quote.  A
    quote that never closes is ordinary text.  Outside quotes ``; | tab newline``
    separate always, comma and blank only before a new ``name=`` or a quoted item.
    ``name`` is lower-cased; an item without ``=`` has content ''.  Null, empty and
    blank texts give no rows; rows with equal ids are split each on its own.
    """
    kind = dict(df.dtypes)[id_col]
    slim = df.select(F.col(id_col), F.col(text_col).cast("string")).filter(F.length(F.trim(F.col(text_col))) > 0)
    out = slim.mapInArrow(_run, f"id {kind}, item_no int, name string, content string")
    return out.withColumnRenamed("id", id_col)
