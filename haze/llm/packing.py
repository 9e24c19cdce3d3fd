"""Training sequences packed by lexical retrieval.

Every document is tokenized once. Documents are dealt out by ranges of a min-hash of their
token pairs, so copies and close variants lie next to each other and no key, however frequent,
has to go to one task. A task cuts its range into shards of about ``SHARD_TOKENS`` ids and
builds a BM25 inverted index of the shard; term statistics come from all documents. A seed
opens a window, its heaviest terms are looked up, and the unused documents returned, best
first, fill the window; what no longer fits is cut and seeds the next window. The open window
is carried from shard to shard, so only the last window of a task can be short, and that one
is cut into powers of two, which need no padding.

Defined cases: a null or empty text has the end id alone and is packed like any other; repeated
doc_ids are separate documents; null ids are kept; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haze.llm.common import U64, chunks, materialize, mix, partitions_for, tidied
from haze.llm.token_file import packed_rows
from haze.llm.tokens import encoder

WINDOW, SHARD_TOKENS, QUERY_TERMS = 4096, 1 << 20, 48
K1, B = 1.2, 0.75
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _tokenized(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (2 bytes each), n, crc and near: the smallest hash of the document's id pairs."""
    @tidied
    def run(batches):
        enc = encoder(path)
        if enc.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids must fit into two bytes")
        for batch in batches:
            for part in chunks(batch, "text", 8 << 20):
                ids, counts = enc.encode(part.column("text"))
                first = np.cumsum(counts) - counts
                before = np.concatenate([[0], ids[:-1]]).astype(U64)
                before[first] = 1 << 20
                near = np.minimum.reduceat(mix(before * U64(1 << 32) + ids.astype(U64)), first)
                rows = packed_rows(part.column("doc_id"), ids, counts, True)
                yield rows.append_column("near", pa.array(near.view(np.int64)))

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary, n long, crc long, near long")


def document_frequencies(tokens: DataFrame, vocabulary: int) -> np.ndarray:
    """In how many of all documents each id occurs; a task sends one row per id at most."""
    def count(batches):
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for raw in batch.column(0):
                total[np.unique(np.frombuffer(raw.as_buffer(), "<u2"))] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["id", "c"])

    out = np.zeros(vocabulary, np.int64)
    table = tokens.select("ids").mapInArrow(count, "id long, c long").groupBy("id").agg(F.sum("c").alias("c")).toArrow()
    out[table.column("id").to_numpy()] = table.column("c").to_numpy()
    return out


class Shard:
    """BM25 inverted index over a bounded run of documents."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float):
        sizes = np.array([len(d) for d in docs])
        key = np.repeat(np.arange(len(docs)), sizes) * (1 << 16) + np.concatenate(docs)
        key, tf = np.unique(key, return_counts=True)
        doc, term = key >> 16, key & 0xFFFF
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[doc] / mean))
        self.doc_first = np.searchsorted(doc, np.arange(len(docs) + 1))
        self.doc_term, self.doc_weight = term, weight
        order = np.argsort(term, kind="stable")
        self.posting_doc, self.posting_weight = doc[order].astype(np.int32), weight[order].astype(np.float32)
        self.first = np.searchsorted(term[order], np.arange((1 << 16) + 1))
        self.n = len(docs)

    def ranked(self, seed: int, unused: np.ndarray, terms: int = QUERY_TERMS) -> np.ndarray:
        """Unused documents with a positive score for ``seed``, best first, ties in order."""
        span = slice(self.doc_first[seed], self.doc_first[seed + 1])
        term, weight = self.doc_term[span], self.doc_weight[span]
        if len(term) > terms:
            term = term[np.argpartition(-weight, terms)[:terms]]
        a, n = self.first[term], self.first[term + 1] - self.first[term]
        at = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
        score = np.bincount(self.posting_doc[at], weights=self.posting_weight[at], minlength=self.n)
        score[~unused] = 0
        found = np.flatnonzero(score > 0)
        return found[np.argsort(-score[found], kind="stable")]


class Packer:
    """Fills windows; ``pieces`` collects (doc_id, start, length, crc, doc_tokens, sequence, offset)."""

    def __init__(self, first_sequence: int, window: int = WINDOW):
        self.window, self.sequence, self.first, self.pieces = window, 0, first_sequence, []
        self.open: list[tuple] = []  # (doc_id, ids, start, length) in the open window
        self.used = 0

    def _close(self) -> None:
        offset = 0
        for doc_id, ids, start, length in self.open:
            crc = zlib.crc32(ids[start:start + length].astype("<u4").tobytes())
            self.pieces.append((doc_id, start, length, crc, len(ids), self.first + self.sequence, offset))
            offset += length
        self.open, self.used, self.sequence = [], 0, self.sequence + 1

    def put(self, doc_id, ids: np.ndarray, start: int = 0) -> int | None:
        """Place what fits of a document; where the rest begins, or None if all of it is placed."""
        length = min(len(ids) - start, self.window - self.used)
        self.open.append((doc_id, ids, start, length))
        self.used += length
        if self.used == self.window:
            self._close()
        return start + length if start + length < len(ids) else None

    def shard(self, doc_ids: list, docs: list[np.ndarray], idf: np.ndarray, mean: float) -> None:
        index = Shard(docs, idf, mean)
        unused = np.ones(len(docs), bool)
        seed, rest = None, 0
        queue: list[int] = []
        at, after = 0, 0
        while True:
            if seed is None:
                if self.used and at < len(queue):
                    seed, rest = queue[at], 0
                    at += 1
                    if not unused[seed]:
                        seed = None
                        continue
                else:
                    while after < len(docs) and not unused[after]:
                        after += 1
                    if after == len(docs):
                        return
                    seed, rest = after, 0
                    queue, at = index.ranked(seed, unused).tolist(), 0
                unused[seed] = False
            fresh = not self.used
            left = self.put(doc_ids[seed], docs[seed], rest)
            if left is None:
                seed = None
            else:  # the window is full and the rest of this document seeds the next one
                rest = left
                if not fresh:
                    queue, at = index.ranked(seed, unused).tolist(), 0

    def finish(self) -> None:
        """Cut the open window into sequences of a power of two, longest first."""
        held, self.open, left, self.used = self.open, [], self.used, 0
        whole = self.window
        for doc_id, ids, start, length in held:
            while length:
                if not self.used:
                    self.window = 1 << (left.bit_length() - 1)
                take = min(length, self.window - self.used)
                self.open.append((doc_id, ids, start, take))
                self.used += take
                start, length, left = start + take, length - take, left - take
                if self.used == self.window:
                    self._close()
        self.window = whole


def pack(docs: DataFrame, path: str, window: int = WINDOW, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """The pieces of every document of ``docs`` (doc_id, text) in sequences of ``window`` ids."""
    spark = docs.sparkSession
    if window & (window - 1):
        raise ValueError("the window must be a power of two")
    tokens = materialize(_tokenized(docs, path))
    vocabulary = 1 << 16
    df = document_frequencies(tokens, vocabulary)
    total = tokens.agg(F.count("*").alias("c"), F.sum("n").alias("n")).first()
    idf = np.log1p((total.c - df + 0.5) / (df + 0.5))
    idf[2] = 0.0  # the end id is in every document
    shared = spark.sparkContext.broadcast((idf, max(1.0, (total.n or 0) / max(1, total.c))))

    @tidied
    def run(batches):
        from pyspark import TaskContext
        idf, mean = shared.value
        packer = Packer(TaskContext.get().partitionId() << 40, window)
        doc_ids, held, size = [], [], 0

        def rows():
            out, packer.pieces = packer.pieces, []
            columns = list(zip(*out, strict=True)) if out else [[]] * 7
            names = [x.split()[0] for x in PIECES.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

        for batch in batches:
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                ids = np.frombuffer(raw.as_buffer(), "<u2").copy()
                doc_ids.append(doc_id)
                held.append(ids)
                size += len(ids)
                if size >= shard_tokens:
                    packer.shard(doc_ids, held, idf, mean)
                    yield rows()
                    doc_ids, held, size = [], [], 0
        if held:
            packer.shard(doc_ids, held, idf, mean)
        packer.finish()
        yield rows()

    keys = ["near", "crc", "doc_id"]
    n = max(1, min(partitions_for(tokens), int(total.n or 0) // (window * 64)))
    return (tokens.repartitionByRange(n, *keys).sortWithinPartitions(*keys).select("doc_id", "ids").mapInArrow(run, PIECES))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
