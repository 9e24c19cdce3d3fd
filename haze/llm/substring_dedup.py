"""Repeated word windows, found level by level with doubling lengths.

Level 0 asks which windows of ``window`` words occur in more than one document. A window of
twice a level's length is looked at only where both of its halves are repeated at that level,
and the levels go on until none survives. The result gives, for every document, the words that
an earlier document already has and the longest length (``window`` doubled as often as it
survived) at which another document shares a window of it.

How it runs. Documents are written once, bucketed by a hash of the row; level 0 and the result
read that table without a shuffle. Per level a task sends one packed list of its distinct window
hashes to each slice of the hash range, the slice answers with one bit per hash, and the answers
go back to the bucket they came from. A hot window is thus one entry per bucket, however many
documents hold it. Level 0 sends 48-bit hashes first and then, for the windows that survive, an
independent 64-bit hash with the smallest document id, so a chance match of the first is dropped
by the second. The levels after it read no text: what is kept of a bucket is the word hashes of
the windows that may go on, and a bucket without such windows takes no part any more. Slices are
``BUCKETS_PER_SLICE`` times fewer than buckets, so a level exchanges at most
buckets^2 / ``BUCKETS_PER_SLICE`` lists. A level's scratch is deleted once the next is written.
Document ids travel with the hashes of later levels only where some id has several rows, which
may lie in different buckets; otherwise another bucket is another document.

Defined cases: a null or empty text has no words; a document shorter than the window loses
nothing; rows with one id count as one document, rows without one too; a null id counts as
larger than every id and is never called smaller than another null; an empty table gives an empty result. Other columns
travel along untouched, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haze.llm.common import (
    NOT_SPACE, U64, Words, bucket_of, bucketed, chunks, covered, discard, give_back, join_words, materialize, pack, pack_bits,
    partitions_for, spread, text_buffers, unpack, unpack_bits, window_hashes, window_ok,
)

WINDOW = 13
GROUP_BYTES = 2 << 20
BUCKETS_PER_SLICE = 4
MESSAGE = "__g int, kind int, b int, body binary"
FIRST, SECOND, STATE, LIVE, DEPTH = 1, 2, 3, 4, 5
_ARROW = pa.schema([("__g", pa.int32()), ("kind", pa.int32()), ("b", pa.int32()), ("body", pa.binary())])


class _Group:
    """The documents of one bucket in a fixed order, with word hashes."""

    def __init__(self, table: pa.Table, id_col: str, text_col: str, second: bool = False):
        row = table.column("__row").combine_chunks() if table.num_rows else pa.array([], table.schema.field("__row").type)
        if isinstance(row, pa.ChunkedArray):
            row = row.chunk(0) if row.num_chunks else pa.array([], row.type)
        key = pa.table({"id": row.field(id_col), "text": row.field(text_col)})
        order = pa.compute.sort_indices(key, [("id", "ascending"), ("text", "ascending")])
        self.rows = row.take(order)
        self.table = key.take(order).combine_chunks()
        self.ids = spread(self.table.column("id"))
        one, two, at, base, counts = [], [], [], 0, []
        for part in chunks(self.table, "text"):
            words = Words(*text_buffers(part.column("text")), NOT_SPACE)
            one.append(words.hashes(1))
            if second:
                two.append(words.hashes(2))
            at.append(words.row + base)
            counts.append(words.count)
            base += part.num_rows
        cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        self.one, self.two, self.row, self.count = cat(one, U64), cat(two, U64), cat(at, np.int64), cat(counts, np.int64)


def _among(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of ``values`` that are in the ascending ``wanted``."""
    if not len(wanted):
        return np.zeros(0, np.int64)
    table = np.zeros(1 << 22, bool)
    table[(wanted & U64((1 << 22) - 1)).astype(np.int64)] = True
    at = np.flatnonzero(table[(values & U64((1 << 22) - 1)).astype(np.int64)])
    near = values[at]
    return at[wanted[np.minimum(np.searchsorted(wanted, near), len(wanted) - 1)] == near]


def _runs(hashes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct hashes, smallest id, largest id, index of each input among the distinct)."""
    order = np.argsort(hashes)
    h = hashes[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    at = np.flatnonzero(new)
    where = np.empty(len(h), np.int64)
    where[order] = np.cumsum(new) - 1
    if not len(h):
        return h, ids, ids, where
    return h[at], np.minimum.reduceat(ids[order], at), np.maximum.reduceat(ids[order], at), where


def _slices(distinct: np.ndarray, bits: int, buckets: int):
    """(bucket, slice) of each non-empty slice of the hash range."""
    if not len(distinct):
        return
    b = bucket_of(distinct, bits, buckets)
    edges = np.concatenate([[0], np.flatnonzero(np.diff(b)) + 1, [len(b)]])
    for i, j in zip(edges[:-1], edges[1:], strict=True):
        yield int(b[i]), slice(int(i), int(j))


def _out(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, _ARROW.types, strict=True)], schema=_ARROW)


def _bodies(table: pa.Table, kind: int) -> list[bytes]:
    """Bodies of one kind in the order of their bucket."""
    rows = sorted((b, body) for k, b, body in zip(*(table.column(c).to_pylist() for c in ("kind", "b", "body")), strict=True) if k == kind)
    return [x for _, x in rows]


def _flags(table: pa.Table, kind: int, n: int) -> np.ndarray:
    parts = [unpack_bits(x) for x in _bodies(table, kind)]
    out = np.concatenate(parts) if parts else np.zeros(0, bool)
    if len(out) != n:
        raise ValueError(f"answers for {len(out)} of {n} hashes")
    return out


def _with_ids(distinct: np.ndarray, low: np.ndarray) -> bytes:
    base = int(low.min())
    head = pack(distinct, ascending=True)
    return struct.pack("<qI", base, len(head)) + head + pack((low - base).astype(U64))


def _read_ids(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    base, size = struct.unpack_from("<qI", raw)
    return unpack(raw[12:12 + size]), unpack(raw[12 + size:]).astype(np.int64) + base


class RepeatedWindows:
    """Finds repeated windows of ``docs``; ``rewrite`` then applies a function to each bucket."""

    def __init__(self, docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text"):
        if window < 1:
            raise ValueError("window must be at least one word")
        self.window, self.id_col, self.text_col, self.schema = window, id_col, text_col, docs.schema
        self.n = partitions_for(docs, GROUP_BYTES)
        self.slices = -(-self.n // BUCKETS_PER_SLICE)
        rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
        g = F.pmod(F.xxhash64(F.col(f"__row.`{id_col}`"), F.col(f"__row.`{text_col}`")), F.lit(self.n)).cast("int")
        self.docs = bucketed(rows.withColumn("__g", g), "__g", self.n)
        self.levels = 0
        one = self.docs.groupBy(F.col(f"__row.`{id_col}`")).count()
        self.by_id = not one.where("count > 1").isEmpty()
        self.state = self._run()

    # ---- passes over the buckets

    def _pass(self, fn, other: DataFrame | None) -> DataFrame:
        def tidy(table, answers):
            out = fn(table, answers)
            give_back()
            return out

        if other is None:
            return self.docs.groupBy("__g").applyInArrow(lambda t: tidy(t, None), MESSAGE)
        return self.docs.groupBy("__g").cogroup(other.groupBy("__g")).applyInArrow(tidy, MESSAGE)

    def _run(self) -> DataFrame:
        n, w, ids, text, by_id = self.slices, self.window, self.id_col, self.text_col, self.by_id

        def first(table, _):
            group = _Group(table, ids, text)
            g = table.column("__g")[0].as_py()
            ok = np.flatnonzero(window_ok(group.row, w))
            distinct = np.unique(window_hashes(group.one, w)[ok] >> U64(16))
            return _out([(g, FIRST, b, pack(distinct[s], ascending=True)) for b, s in _slices(distinct, 48, n)])

        def candidates(group, answers):
            # asked for by another bucket, or more than once in this one
            ok = np.flatnonzero(window_ok(group.row, w))
            h = window_hashes(group.one, w)[ok] >> U64(16)
            distinct, times = np.unique(h, return_counts=True)
            at = ok[_among(h, distinct[_flags(answers, FIRST, len(distinct)) | (times > 1)])]
            return at, _runs(window_hashes(group.two, w, 13)[at], group.ids[group.row[at]])

        def second(table, answers):
            if not table.num_rows:
                return _out([])
            group = _Group(table, ids, text, second=True)
            g = table.column("__g")[0].as_py()
            _, (distinct, low, _, _) = candidates(group, answers)
            return _out([(g, SECOND, b, _with_ids(distinct[s], low[s])) for b, s in _slices(distinct, 64, n)])

        def level_zero(table, answers):
            if not table.num_rows:
                return _out([])
            group = _Group(table, ids, text, second=True)
            g = table.column("__g")[0].as_py()
            at, (distinct, low, high, where) = candidates(group, answers)
            parts = [_read_answer(x) for x in _bodies(answers, SECOND)]
            again = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, bool)
            least = np.minimum(low, np.concatenate([p[1] for p in parts])) if parts else low
            again = (again | (low != high))[where]
            earlier = at[least[where] < group.ids[group.row[at]]]
            at = at[again]
            repeated = pack_bits(covered(earlier, w, len(group.row)))
            spans = _Spans(group.one, group.row, np.arange(len(group.ids)), group.ids)
            return _out([(g, STATE, 0, repeated)] + _longer(g, 0, at, spans, w, n, by_id))

        def deeper(table):
            g = table.column("__g")[0].as_py()
            live = table.filter(pa.compute.equal(table.column("kind"), LIVE))
            level = live.column("b")[0].as_py()
            spans, at = _Spans.read(live.column("body")[0].as_py())
            distinct, low, high, where = _runs(window_hashes(spans.words, w << level)[at], spans.ids[spans.run[at]])
            if by_id:
                again = np.concatenate([_read_answer(x)[0] for x in _bodies(table, SECOND)])
            else:
                again = _flags(table, FIRST, len(distinct))
            out = _out(_longer(g, level, at[(again | (low != high))[where]], spans, w << level, n, by_id))
            give_back()
            return out

        asked = materialize(self._pass(first, None))
        seen = materialize(_answer(asked, _shared))
        discard(asked)
        asked = materialize(self._pass(second, seen))
        lowest = materialize(_answer(asked, _smallest))
        discard(asked)
        state = materialize(self._pass(level_zero, seen.unionByName(lowest)))
        discard(seen)
        discard(lowest)
        while not (asked := state.where(F.col("kind").isin(FIRST, SECOND))).isEmpty():
            self.levels += 1
            waiting = state.where(F.col("kind") == LIVE).unionByName(_answer(asked, _smallest if by_id else _shared))
            done = state.where(F.col("kind").isin(STATE, DEPTH))
            deep = materialize(done.unionByName(waiting.groupBy("__g").applyInArrow(deeper, MESSAGE)))
            discard(state)
            state = deep
        return state

    def rewrite(self, fn, schema: str) -> DataFrame:
        """``fn(rows, words, words' repeated masks, longest repeated lengths)`` over slices of every bucket."""
        ids, text, w = self.id_col, self.text_col, self.window

        def each(table, state):
            if not table.num_rows:
                return fn(pa.array([], table.schema.field("__row").type), None, None, None)
            group = _Group(table, ids, text)
            repeated = unpack_bits(_bodies(state, STATE)[0])
            longest = np.zeros(len(group.ids), np.int64)
            for level, body in enumerate(_bodies(state, DEPTH)):
                longest[unpack(body).astype(np.int64)] = w << level
            ends = np.concatenate([[0], np.cumsum(group.count)])
            out, base = [], 0
            for part in chunks(group.table, "text"):
                stop = base + part.num_rows
                words = Words(*text_buffers(part.column("text")), NOT_SPACE)
                out.append(fn(group.rows.slice(base, stop - base), words, repeated[ends[base]:ends[stop]], longest[base:stop]))
                base = stop
            give_back()
            return pa.concat_tables(out)

        return self.docs.groupBy("__g").cogroup(self.state.groupBy("__g")).applyInArrow(each, schema)


class _Spans:
    """Word hashes in runs of consecutive words; ``doc`` and ``ids`` say where a run comes from."""

    def __init__(self, words: np.ndarray, run: np.ndarray, doc: np.ndarray, ids: np.ndarray):
        self.words, self.run, self.doc, self.ids = words, run, doc, ids

    def within(self, at: np.ndarray, length: int) -> tuple[_Spans, np.ndarray]:
        """The words of the windows that start at ``at``, and where these windows start there."""
        inside = covered(at, length, len(self.words))
        run = self.run[inside]
        new = np.ones(len(run), bool)
        new[1:] = (run[1:] != run[:-1]) | (np.diff(np.flatnonzero(inside)) > 1)
        kept = _Spans(self.words[inside], np.cumsum(new) - 1, self.doc[run[new]], self.ids[run[new]])
        return kept, (np.cumsum(inside) - 1)[at]

    def body(self, at: np.ndarray) -> bytes:
        known, word = np.unique(self.words, return_inverse=True)
        parts = [pack(known, ascending=True), pack(word), pack(np.bincount(self.run)), pack(self.doc, ascending=True),
                 pack(self.ids.view(U64)), pack(at, ascending=True)]
        return struct.pack("<6I", *map(len, parts)) + b"".join(parts)

    @staticmethod
    def read(raw: bytes) -> tuple[_Spans, np.ndarray]:
        ends = 24 + np.cumsum((0, *struct.unpack_from("<6I", raw)))
        known, word, sizes, doc, ids, at = (unpack(raw[i:j]) for i, j in zip(ends[:-1], ends[1:], strict=True))
        run = np.repeat(np.arange(len(sizes)), sizes.astype(np.int64))
        return _Spans(known[word.astype(np.int64)], run, doc.astype(np.int64), ids.view(np.int64)), at.astype(np.int64)


def _longer(g: int, level: int, at: np.ndarray, spans: _Spans, length: int, slices: int, by_id: bool) -> list[tuple]:
    """What bucket ``g`` says after ``level``, whose repeated windows of ``length`` words start at
    ``at`` (ascending): the rows that got this far, and the windows of twice the length whose halves
    are both repeated, with the questions about them."""
    if not len(at):
        return []
    out = [(g, DEPTH, level, pack(np.unique(spans.doc[spans.run[at]]), ascending=True))]
    half = np.minimum(np.searchsorted(at, at + length), len(at) - 1)
    both = (at[half] == at + length) & (spans.run[at[half]] == spans.run[at])
    if not both.any():
        return out
    spans, at = spans.within(at[both], 2 * length)
    out.append((g, LIVE, level + 1, spans.body(at)))
    distinct, low, _, _ = _runs(window_hashes(spans.words, 2 * length)[at], spans.ids[spans.run[at]])
    if by_id:
        return out + [(g, SECOND, b, _with_ids(distinct[s], low[s])) for b, s in _slices(distinct, 64, slices)]
    return out + [(g, FIRST, b, pack(distinct[s], ascending=True)) for b, s in _slices(distinct, 64, slices)]


def _answer(asked: DataFrame, fn) -> DataFrame:
    return asked.groupBy("b").applyInArrow(fn, MESSAGE)


def _shared(table: pa.Table) -> pa.Table:
    """One bit per hash asked: does another bucket ask for it too?"""
    g, bodies, b = table.column("__g").to_pylist(), table.column("body").to_pylist(), table.column("b")[0].as_py()
    parts = [unpack(x) for x in bodies]
    values = np.concatenate(parts)
    order = np.argsort(values)
    same = values[order][1:] == values[order][:-1]
    twice = np.zeros(len(values), bool)
    twice[1:] |= same
    twice[:-1] |= same
    flags = np.empty(len(values), bool)
    flags[order] = twice
    ends = np.cumsum([0] + [len(p) for p in parts])
    return _out([(x, FIRST, b, pack_bits(flags[i:j])) for x, i, j in zip(g, ends[:-1], ends[1:], strict=True)])


def _smallest(table: pa.Table) -> pa.Table:
    """Per hash asked: is it in documents of several ids, and the smallest of them."""
    g, bodies, b = table.column("__g").to_pylist(), table.column("body").to_pylist(), table.column("b")[0].as_py()
    parts = [_read_ids(x) for x in bodies]
    values, ids = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    distinct, low, high, where = _runs(values, ids)
    again, least = (low != high)[where], low[where]
    ends = np.cumsum([0] + [len(p[0]) for p in parts])
    rows = []
    for x, i, j in zip(g, ends[:-1], ends[1:], strict=True):
        less = least[i:j] < ids[i:j]
        one, two = pack_bits(again[i:j]), pack_bits(less)
        few = least[i:j][less]
        base = int(few.min()) if len(few) else 0
        rows.append((x, SECOND, b, struct.pack("<qII", base, len(one), len(two)) + one + two + pack((few - base).astype(U64))))
    return _out(rows)


def _read_answer(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    base, x, y = struct.unpack_from("<qII", raw)
    again, less = unpack_bits(raw[16:16 + x]), unpack_bits(raw[16 + x:16 + x + y])
    least = np.full(len(less), np.iinfo(np.int64).max)
    least[less] = unpack(raw[16 + x + y:]).astype(np.int64) + base
    return again, least


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every word of a window that an earlier document has removed.

    Texts that lose nothing stay as they are; the others become their kept words joined by one
    space. All columns stay.
    """
    found = RepeatedWindows(docs, window, id_col, text_col)
    types = {f.name: f for f in docs.schema}

    def apply(rows, words, repeated, longest):
        columns = {name: rows.field(i) for i, name in enumerate(types)}
        if words is not None and repeated.any():
            hit = np.zeros(words.rows, bool)
            hit[words.row[repeated]] = True
            data, ends = join_words(words, ~repeated)
            old = columns[text_col].to_pylist()
            for i in np.flatnonzero(hit):
                old[i] = data[ends[i]:max(ends[i], ends[i + 1] - 1)].tobytes().decode()
            columns[text_col] = pa.array(old, columns[text_col].type)
        return pa.table(columns)

    return found.rewrite(apply, docs.schema)


def digest(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: words, words removed, hash of the text kept, and the longest of the lengths
    ``window``, 2 ``window``, 4 ``window``, ... at which another document has a window of it (0: none)."""
    found = RepeatedWindows(docs.select(id_col, text_col), window, id_col, text_col)
    names = ("doc_id", "n_words", "n_removed", "kept_sha256", "longest_repeat")
    types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64())

    def apply(rows, words, repeated, longest):
        if words is None:
            return pa.table([pa.array([], t) for t in types], names=names)
        removed = np.bincount(words.row[repeated], minlength=words.rows)
        data, ends = join_words(words, ~repeated)
        raw = memoryview(data)
        sha = [hashlib.sha256(raw[i:max(i, j - 1)]).hexdigest() for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        return pa.table([rows.field(0).cast(pa.int64()), pa.array(words.count), pa.array(removed), pa.array(sha), pa.array(longest)], names=names)

    return found.rewrite(apply, "doc_id long, n_words long, n_removed long, kept_sha256 string, longest_repeat long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
wins AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS win
         FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 12)) AS i FROM w WHERE len(ws) >= 13)),
least AS (SELECT win, min(doc_id) AS first_id, max(doc_id) AS last_id FROM wins GROUP BY win),
grown AS (
    SELECT CAST(13 AS BIGINT) AS len, doc_id, i, md5(win) AS h FROM wins JOIN least USING (win) WHERE first_id < last_id
    UNION ALL
    SELECT len, doc_id, i, h FROM (
        SELECT 2 * a.len AS len, a.doc_id, a.i, md5(a.h || b.h) AS h,
               min(a.doc_id) OVER (PARTITION BY a.h, b.h) AS lo, max(a.doc_id) OVER (PARTITION BY a.h, b.h) AS hi
        FROM grown a JOIN grown b ON a.doc_id = b.doc_id AND b.i = a.i + a.len) WHERE lo < hi),
longest AS (SELECT doc_id, max(len) AS len FROM grown GROUP BY doc_id),
hit AS (SELECT DISTINCT doc_id, i + k AS pos FROM (SELECT doc_id, i FROM wins JOIN least USING (win) WHERE first_id < doc_id), (SELECT unnest(generate_series(0, 12)) AS k)),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(generate_series(1, len(ws))) AS pos FROM w WHERE len(ws) > 0),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS text, count(*) AS n FROM words ANTI JOIN hit USING (doc_id, pos) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256,
       coalesce(longest.len, 0) AS longest_repeat
FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN longest USING (doc_id)
"""
