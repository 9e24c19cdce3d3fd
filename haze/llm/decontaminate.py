"""Benchmark passages in training documents, found by winnowing.

Both sides are lower-cased (A-Z) and cut into words. Of every ``window`` words only the smallest
hash among its k-grams is kept as a fingerprint; a span of ``window`` words that two texts share
keeps the same fingerprint in both, so joining fingerprints misses no such span. Each joined pair
is extended word by word to both sides, and counts only if the run it lies in has ``window``
words. An item with fewer words is one window as a whole: there the k-gram is the item itself.

A benchmark is usually small: when its text is at most ``MAX_SENT`` bytes (measured, not
assumed) its fingerprints are sent to the tasks and documents are not shuffled. A larger one is
joined with the documents' fingerprints by a shuffle, and only candidate pairs of document and
item meet to be extended.

Defined cases: a null or empty text has no words and is never contaminated; null or empty items
have no windows; an item without an id counts for hit words but not among the items; repeated
item ids count once; repeated document rows are each reported. Result columns replace document
columns of the same name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haze.llm.common import ALNUM, LOWER, U64, Words, chunks, pack_bits, text_buffers, unpack_bits, window_hashes, window_ok

WINDOW, KGRAM, MAX_SENT = 13, 5, 8 << 20
_MEASURES = "n_words long, n_hit long, item_ids array<long>"


def fingerprints(words: np.ndarray, row: np.ndarray, window: int = WINDOW, k: int = KGRAM) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the k-grams that are smallest in some window of ``window`` words."""
    a = window_hashes(words, k)
    span = window - k + 1
    n = len(words) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    least = _sliding(a, span, np.minimum)
    least[~window_ok(row, window)] = 0
    padded = np.concatenate([np.zeros(span - 1, U64), least, np.zeros(span - 1, U64)])
    at = np.flatnonzero((_sliding(padded, span, np.maximum) == a) & (a != 0))
    return at, a[at]


def _sliding(a: np.ndarray, span: int, best) -> np.ndarray:
    """``best`` over each run of ``span`` values."""
    out, have = a.copy(), 1
    while have < span:
        step = min(have, span - have)
        out = best(out[:len(out) - step], out[step:])
        have += step
    return out


class _Index:
    """Fingerprints of the items, sorted, with the item words they come from."""

    def __init__(self, ids: list, texts: pa.Array, window: int, k: int):
        data, offsets = text_buffers(texts)
        words = Words(LOWER[data], offsets, ALNUM)
        self.ids, self.window, self.k = np.array([-1 if x is None else x for x in ids], np.int64), window, k
        self.known = np.array([x is not None for x in ids], bool)
        self.words, self.row, self.first = words.hashes(1), words.row, words.first
        self.count = words.count
        at, fp = fingerprints(self.words, self.row, window, k)
        self.by_length = {}
        if len(at):
            self.by_length[0] = _sorted(fp, at)
        for m in np.unique(self.count[(self.count > 0) & (self.count < window)]).tolist():
            at = self.first[:-1][self.count == m]
            self.by_length[m] = _sorted(window_hashes(self.words, m)[at], at)

    def hits(self, words: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(mask of hit words, document row, item row) of the pairs found."""
        change = np.zeros(len(words) + 1, np.int64)
        pairs = [np.zeros(0, np.int64)]
        for m, (fp, at, table) in self.by_length.items():
            if m:
                pos = np.flatnonzero(window_ok(row, m))
                values = window_hashes(words, m)[pos]
            else:
                pos, values = fingerprints(words, row, self.window, self.k)
            maybe = table[(values & U64(0xFFFF)).astype(np.int64)]
            pos, values = pos[maybe], values[maybe]
            low, high = np.searchsorted(fp, values, "left"), np.searchsorted(fp, values, "right")
            n = high - low
            p = np.repeat(pos, n)
            q = at[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            begin, end = self._extend(words, row, p, q, m or self.k, 0 if m else self.window - self.k)
            full = end - begin >= (m or self.window)
            p, q, begin, end = p[full], q[full], begin[full], end[full]
            np.add.at(change, begin, 1)
            np.add.at(change, end, -1)
            pairs.append(row[p] * len(self.ids) + self.row[q])
        pairs = np.unique(np.concatenate(pairs))
        return np.cumsum(change[:-1]) > 0, pairs // max(1, len(self.ids)), pairs % max(1, len(self.ids))

    def _extend(self, words, row, p, q, size, most) -> tuple[np.ndarray, np.ndarray]:
        """Runs of equal words around each pair, at most ``most`` words to either side."""
        begin, end = p.copy(), p + size
        same = np.ones(len(p), bool)
        for i in range(size):
            same &= words[p + i] == self.words[q + i]
        for side, edge in ((-1, begin), (1, end)):
            going = same.copy()
            for i in range(most):
                a = p - 1 - i if side < 0 else p + size + i
                b = q - 1 - i if side < 0 else q + size + i
                going &= (a >= 0) & (a < len(words)) & (b >= 0) & (b < len(self.words))
                a, b = np.where(going, a, 0), np.where(going, b, 0)
                going &= (row[a] == row[p]) & (self.row[b] == self.row[q]) & (words[a] == self.words[b])
                if not going.any():
                    break
                edge += side * going
        return np.where(same, begin, 0), np.where(same, end, 0)


def _sorted(fp: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(fp, kind="stable")
    table = np.zeros(1 << 16, bool)
    table[(fp & U64(0xFFFF)).astype(np.int64)] = True
    return fp[order], at[order], table


def _lists(rows: int, of: np.ndarray, values: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=rows))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int64()))


def _sent(docs: DataFrame, items: DataFrame, text_col: str, window: int, k: int) -> DataFrame:
    """Measures by fingerprints sent to every task: no shuffle."""
    table = items.toArrow()
    index = docs.sparkSession.sparkContext.broadcast(_Index(table.column(0).to_pylist(), table.column(1), window, k))
    schema = T.StructType([*docs.schema.fields, *T._parse_datatype_string(_MEASURES).fields])

    def measure(batches):
        found = index.value
        for batch in batches:
            batch = batch.append_column("__text", batch.column("__row").field(text_col))
            for part in chunks(batch, "__text"):
                data, offsets = text_buffers(part.column("__text"))
                words = Words(LOWER[data], offsets, ALNUM)
                mask, doc, item = found.hits(words.hashes(1), words.row, words.rows)
                known = found.known[item]
                pairs = np.unique(np.stack([doc[known], found.ids[item[known]]]), axis=1)
                columns = [part.column("__row"), pa.array(words.count, pa.int64()),
                           pa.array(np.bincount(words.row[mask], minlength=words.rows), pa.int64()), _lists(words.rows, pairs[0], pairs[1])]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.mapInArrow(measure, schema)


def _joined(docs: DataFrame, items: DataFrame, text_col: str, window: int, k: int) -> DataFrame:
    """Measures by a shuffled join of fingerprints, for a benchmark of any size."""
    text = F.coalesce(F.col(f"__row.`{text_col}`"), F.lit(""))
    keyed = docs.withColumn("__key", F.xxhash64(F.lit(1), text)).withColumn("__key2", F.xxhash64(F.lit(2), text))
    texts = keyed.select("__key", "__key2", text.alias("text")).dropDuplicates(["__key", "__key2"])
    item = items.toDF("item_id", "text").where(F.length("text") > 0)
    item = item.withColumn("__item", F.xxhash64("item_id", "text"))
    lengths = item.select(F.size(F.expr(r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', 0)")).alias("n"))
    short = [r.n for r in lengths.where(f"n between 1 and {window - 1}").distinct().collect()]

    def prints(keys, whole):
        def run(batches):
            for batch in batches:
                for part in chunks(batch, "text"):
                    data, offsets = text_buffers(part.column("text"))
                    words = Words(LOWER[data], offsets, ALNUM)
                    h = words.hashes(1)
                    at, fp = fingerprints(h, words.row, window, k)
                    found = [(np.zeros(len(at), np.int64), fp, words.row[at])]
                    for m in short:
                        at = words.first[:-1][words.count == m] if whole else np.flatnonzero(window_ok(words.row, m))
                        found.append((np.full(len(at), m), window_hashes(h, m)[at] if len(h) >= m else np.zeros(0, U64), words.row[at]))
                    size, fp, row = (np.concatenate(x) for x in zip(*found, strict=True))
                    columns = [part.column(c).take(pa.array(row)) for c in keys]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(size, pa.int64()), pa.array(fp.view(np.int64))], names=[*keys, "m", "fp"])
        return run

    left = texts.mapInArrow(prints(["__key", "__key2"], False), "__key long, __key2 long, m long, fp long").distinct()
    right = item.select("__item", "text").mapInArrow(prints(["__item"], True), "__item long, m long, fp long").distinct()
    pairs = left.join(right, ["m", "fp"]).select("__key", "__key2", "__item").distinct()
    both = (pairs.join(item.select("__item", "item_id", F.col("text").alias("item_text")).distinct(), "__item")
                 .join(texts, ["__key", "__key2"]))

    def verify(batches):
        for batch in batches:
            rows = batch.to_pylist()
            out = []
            for r in rows:
                words = Words(LOWER[np.frombuffer(r["text"].encode(), np.uint8)], np.array([0, len(r["text"].encode())]), ALNUM)
                mask, doc, _ = _Index([0], pa.array([r["item_text"]]), window, k).hits(words.hashes(1), words.row, 1)
                if len(doc):
                    out.append((r["__key"], r["__key2"], r["item_id"], pack_bits(mask)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["__key", "__key2", "item_id", "mask"])

    def unite(table):
        masks = np.logical_or.reduce([unpack_bits(x) for x in table.column("mask").to_pylist()])
        ids = sorted({x for x in table.column("item_id").to_pylist() if x is not None})
        return pa.table({"__key": table.column("__key")[:1], "__key2": table.column("__key2")[:1], "n_hit": pa.array([int(masks.sum())]), "item_ids": pa.array([ids], pa.list_(pa.int64()))})

    hit = (both.mapInArrow(verify, "__key long, __key2 long, item_id long, mask binary").groupBy("__key", "__key2")
               .applyInArrow(unite, "__key long, __key2 long, n_hit long, item_ids array<long>"))
    n_words = F.size(F.expr(f"regexp_extract_all(translate(__row.`{text_col}`, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\\\x00-\\\\x2F\\\\x3A-\\\\x60\\\\x7B-\\\\x7F]+', 0)"))
    return (keyed.join(hit, ["__key", "__key2"], "left")
            .select("__row", F.when(F.col(f"__row.`{text_col}`").isNull(), 0).otherwise(n_words).cast("long").alias("n_words"),
                    F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("item_ids", F.expr("cast(array() as array<long>)")).alias("item_ids")))


def _measured(docs: DataFrame, items: DataFrame, text_col: str, window: int, k: int, max_sent: int) -> DataFrame:
    if not 1 <= k <= window:
        raise ValueError("k-grams must fit into the window")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    size = items.agg(F.sum(F.octet_length("text") + 16).alias("n"), F.count("*").alias("c")).first()
    fits = (size.n or 0) + 16 * size.c <= max_sent
    out = (_sent if fits else _joined)(rows, items.select("item_id", "text"), text_col, window, k)
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def contamination(docs: DataFrame, items: DataFrame, text_col: str = "text", window: int = WINDOW, k: int = KGRAM,
                  max_sent: int = MAX_SENT) -> DataFrame:
    """``docs`` with n_words, n_hit, item_ids (ascending) and contaminated; ``items`` has item_id and text."""
    out = _measured(docs, items, text_col, window, k, max_sent)
    new = [c for c in out.columns if c != "__row"]
    return out.select(*[F.col(f"__row.`{c}`").alias(c) for c in docs.columns if c not in new], *new)


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", window: int = WINDOW, k: int = KGRAM) -> DataFrame:
    """The documents that are not contaminated, with their columns as they were."""
    out = _measured(docs, items, text_col, window, k, MAX_SENT).where(~F.col("contaminated"))
    return out.select("__row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    names = F.array_join(F.array_sort(F.transform("item_ids", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
                        F.sha2(names, 256).alias("items_sha256"), "contaminated")


SQL = r"""
WITH lowered AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM lowered),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(13, len(ws)) AS m, array_to_string(ws[i:i + 12], ' ') AS win
       FROM (SELECT item_id, ws, unnest(generate_series(1, greatest(1, len(ws) - 12))) AS i FROM b WHERE len(ws) > 0)),
dw AS (SELECT doc_id, m, i, array_to_string(ws[i:i + m - 1], ' ') AS win
       FROM (SELECT doc_id, ws, m, unnest(generate_series(1, len(ws) - m + 1)) AS i FROM d, (SELECT DISTINCT m FROM bw) WHERE len(ws) >= m)),
hit AS (SELECT doc_id, m, i, item_id FROM dw JOIN bw USING (m, win)),
words AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + m - 1)) AS pos FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(words.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(words.n, 0) > 0 AND 20 * coalesce(words.n, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
