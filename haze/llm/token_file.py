"""Token files: ids coded with static range asymmetric numerals under one shared frequency table.

Format of a block (little-endian): magic ``TRN1``, ids n, lanes, documents d, steps between
checkpoints, words w, checkpoints c, crc32 of everything after the header; then the checkpoints
(word offset and one 64-bit state per lane), and w 32-bit words. Id number i belongs to lane
``i % lanes``; all lanes advance together, one numpy step for each run of ``lanes`` ids. A block
needs nothing but the frequency table, so blocks decode in parallel, and inside a block any
checkpoint is a place to start.

The frequency table is counted over all documents as they are tokenized, scaled to 2**20 with at
least 1 for every id of the vocabulary, and stored beside the blocks. Documents are dealt out by ranges of (doc_id,
hash of the text) and tokenized in that order; blocks hold whole documents, named by range and
first row, and a document's start is the number of ids in all blocks and documents before it:
sums per range are added up, not rows.

Defined cases: a null text is the empty text and has the end id alone; repeated doc_ids stand
next to each other and each gets its own row; null ids come first; an empty table gives no blocks.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haze.llm.common import U64, chunks, materialize, partitions_for, scratch_dir, tidied
from haze.llm.tokens import END_ID, encoder

SCALE_BITS, LANES, BLOCK_IDS, STEPS = 20, 1024, 1 << 18, 128
LOW = U64(1 << 31)
MAGIC = b"TRN1"
_HEAD = "<4sQIIIQII"


# ---------------------------------------------------------------- coder

def scaled(counts: np.ndarray, bits: int = SCALE_BITS) -> np.ndarray:
    """Frequencies summing to ``2**bits``, each at least 1, close to the shares in ``counts``."""
    n, total = len(counts), 1 << bits
    if n > total:
        raise ValueError("more ids than the scale can tell apart")
    share = counts.astype(np.float64) / max(1, counts.sum())
    out = 1 + np.floor(share * (total - n)).astype(np.int64)
    out[int(np.argmax(counts))] += total - int(out.sum())
    return out


class Coder:
    """Encodes and decodes blocks under one table of scaled frequencies."""

    def __init__(self, freq: np.ndarray, bits: int = SCALE_BITS):
        self.bits = bits
        self.freq = freq.astype(U64)
        self.start = (np.cumsum(freq) - freq).astype(U64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)

    def encode(self, ids: np.ndarray, documents: int, lanes: int = LANES, steps: int = STEPS) -> bytes:
        n, bits = len(ids), U64(self.bits)
        rounds = -(-n // lanes)
        state = np.full(lanes, LOW, U64)
        words: list[np.ndarray] = []
        marks: list[tuple[int, np.ndarray]] = []
        room = U64(63 - self.bits)
        for t in range(rounds - 1, -1, -1):
            part = ids[t * lanes:(t + 1) * lanes]
            f, c, x = self.freq[part], self.start[part], state[:len(part)]
            full = (x >> room) >= f
            words.append(x[full].astype(np.uint32)[::-1])
            x = np.where(full, x >> U64(32), x)
            q = x // f
            state[:len(part)] = (q << bits) + (x - q * f) + c
            if t % steps == 0:
                marks.append((sum(map(len, words)), state.copy()))
        flat = np.concatenate(words)[::-1] if words else np.zeros(0, np.uint32)
        total = len(flat)
        body = b"".join(struct.pack("<Q", total - w) + s.astype("<u8").tobytes() for w, s in reversed(marks)) + flat.astype("<u4").tobytes()
        return struct.pack(_HEAD, MAGIC, n, lanes, documents, steps, total, len(marks), zlib.crc32(body)) + body

    def decode(self, block: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
        """Ids between checkpoints ``first`` and ``last`` (all by default); checks the checksum."""
        magic, n, lanes, _, steps, total, marks, crc = struct.unpack_from(_HEAD, block)
        body = memoryview(block)[struct.calcsize(_HEAD):]
        if magic != MAGIC or zlib.crc32(body) != crc:
            raise ValueError("damaged block")
        if not n:
            return np.zeros(0, np.uint32)
        size = 8 + 8 * lanes
        words = np.frombuffer(body, "<u4", total, marks * size)
        done = struct.unpack_from("<Q", body, first * size)[0]
        # a checkpoint's offset is the number of words already read when decoding starts there
        state = np.frombuffer(body, "<u8", lanes, first * size + 8).copy()
        begin, end = first * steps * lanes, n if last is None else min(n, last * steps * lanes)
        out = np.empty(end - begin, np.uint32)
        mask, bits = U64((1 << self.bits) - 1), U64(self.bits)
        for i in range(begin, end, lanes):
            m = min(lanes, n - i)
            x = state[:m]
            slot = x & mask
            s = self.symbol[slot.astype(np.int64)]
            out[i - begin:i - begin + m] = s
            x = self.freq[s] * (x >> bits) + slot - self.start[s]
            low = np.flatnonzero(x < LOW)
            x[low] = (x[low] << U64(32)) | words[done:done + len(low)]
            done += len(low)
            state[:m] = x
        return out


# ---------------------------------------------------------------- writing and reading

def sizes(path: str) -> tuple[int, bool]:
    """(ids of the vocabulary, end id included; whether 2 bytes hold one) for the tokenizer file ``path``."""
    tokenizer = encoder(path).tokenizer
    return max(tokenizer.get_vocab_size(with_added_tokens=True), END_ID + 1), tokenizer.get_vocab_size() <= 1 << 16


def tokenized(docs: DataFrame, path: str, n: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents in ascending order: part, row (in its part), doc_id, ids (2 bytes each where the vocabulary allows), n, crc.

    A part ends with a row without ``row``: the ids ``seen`` in the part and how many ``times`` each."""
    lists = pa.list_(pa.int64())
    names = ["part", "row", "doc_id", "ids", "n", "crc", "seen", "times"]

    @tidied
    def run(batches):
        from pyspark import TaskContext
        part, row = TaskContext.get().partitionId(), 0
        enc = encoder(path)
        vocabulary, small = sizes(path)
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for piece in chunks(batch, "text", 8 << 20):
                ids, counts = enc.encode(piece.column("text"))
                total += np.bincount(ids, minlength=vocabulary)
                rows = piece.num_rows
                out = packed_rows(piece.column("doc_id"), ids, counts, small)
                at = np.arange(row, row + rows)
                row += rows
                yield pa.RecordBatch.from_arrays([pa.array(np.full(rows, part)), pa.array(at), *out.columns, pa.nulls(rows, lists), pa.nulls(rows, lists)], names=names)
        if row:
            seen = np.flatnonzero(total)
            none = [pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), *none, pa.array([seen], lists), pa.array([total[seen]], lists)], names=names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    keys = ["doc_id", F.xxhash64("text")]
    ordered = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    return ordered.mapInArrow(run, "part long, row long, doc_id long, ids binary, n long, crc long, seen array<long>, times array<long>")


def packed_rows(doc_ids, ids, counts, small: bool) -> pa.RecordBatch:
    ends = np.cumsum(counts)
    raw = memoryview(ids.astype("<u4").tobytes())
    crc = [zlib.crc32(raw[4 * i:4 * j]) for i, j in zip((ends - counts).tolist(), ends.tolist(), strict=True)]
    width = 2 if small else 4
    narrow = ids.astype("<u2" if small else "<u4").tobytes()
    offsets = np.concatenate([[0], ends]) * width
    packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(narrow)])
    return pa.RecordBatch.from_arrays([doc_ids.cast(pa.int64()), packed.cast(pa.binary()), pa.array(counts), pa.array(crc, pa.int64())], names=["doc_id", "ids", "n", "crc"])


def id_counts(tokens: DataFrame, vocabulary: int) -> np.ndarray:
    """How often each id occurs in all documents, from the counts of each part."""
    out = np.zeros(vocabulary, np.int64)
    table = (tokens.where(F.col("row").isNull()).select(F.inline(F.arrays_zip("seen", "times")))
                   .groupBy("seen").agg(F.sum("times").alias("times")).toArrow())
    out[table.column("seen").to_numpy()] = table.column("times").to_numpy()
    return out


def write_tokens(docs: DataFrame, path: str, out: str, block_ids: int = BLOCK_IDS) -> None:
    """Write the token file of ``docs`` under the folder ``out``: ``blocks`` and ``table``."""
    spark = docs.sparkSession
    vocabulary, small = sizes(path)
    tokens = materialize(tokenized(docs, path, partitions_for(docs)))
    freq = scaled(id_counts(tokens, vocabulary))
    spark.createDataFrame(pa.table({"freq": freq})).coalesce(1).write.parquet(f"{out}/table")
    table = spark.sparkContext.broadcast(freq)

    @tidied
    def blocks(batches):
        coder, held, size = Coder(table.value), [], 0

        def close():
            parts, rows, doc_ids, ns, crcs, raws = zip(*held, strict=True)
            ids = np.concatenate([np.frombuffer(r, "<u2" if small else "<u4") for r in raws]).astype(np.int64)
            lists = [pa.array([list(x)], pa.list_(pa.int64())) for x in (doc_ids, ns, crcs)]
            return pa.RecordBatch.from_arrays([pa.array([parts[0]], pa.int64()), pa.array([rows[0]], pa.int64()), pa.array([len(ids)], pa.int64()),
                                               *lists, pa.array([coder.encode(ids, len(ns))], pa.binary())],
                                              names=["part", "number", "n", "doc_ids", "ns", "crcs", "body"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("part", "row", "doc_id", "n", "crc", "ids")), strict=True):
                # a block holds consecutive documents: a scan may end one file and begin another
                if held and (size >= block_ids or row[0] != held[-1][0] or row[1] != held[-1][1] + 1):
                    yield close()
                    held, size = [], 0
                held.append(row)
                size += row[3]
        if held:
            yield close()

    (tokens.where(F.col("row").isNotNull()).select("part", "row", "doc_id", "n", "crc", "ids")
           .mapInArrow(blocks, "part long, number long, n long, doc_ids array<long>, ns array<long>, crcs array<long>, body binary")
           .write.option("compression", "none").parquet(f"{out}/blocks"))


def read_tokens(spark: SparkSession, out: str) -> DataFrame:
    """doc_id, start, n_tokens and crc of the decoded ids, from the files alone."""
    table = spark.read.parquet(f"{out}/table").toArrow().column("freq").to_numpy()
    blocks = spark.read.parquet(f"{out}/blocks")
    sums = {r.part: r.n for r in blocks.groupBy("part").agg(F.sum("n").alias("n")).collect()}
    base, before = {}, 0
    for part in sorted(sums):
        base[part], before = before, before + sums[part]
    inner = blocks.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("number", "n"))).alias("all"))
    shared = spark.sparkContext.broadcast((table, base))
    # a range holds a bounded number of blocks, so its list of (number, ids) is short
    starts = inner.select("part", F.posexplode("all"), "all").select(
        "part", F.col("col.number").alias("number"),
        F.aggregate(F.slice("all", F.lit(1), F.col("pos")), F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("inside"))

    @tidied
    def decode(batches):
        freq, base = shared.value
        coder = Coder(freq)
        for batch in batches:
            for i in range(batch.num_rows):
                part, inside, body = (batch.column(c)[i] for c in ("part", "inside", "body"))
                ids = coder.decode(body.as_py())
                ns = np.array(batch.column("ns")[i].as_py(), np.int64)
                ends = np.cumsum(ns)
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip((ends - ns).tolist(), ends.tolist(), strict=True)]
                if crc != batch.column("crcs")[i].as_py():
                    raise ValueError("a document's checksum differs")
                start = ends - ns + base[part.as_py()] + inside.as_py()
                yield pa.RecordBatch.from_arrays([batch.column("doc_ids")[i].values, pa.array(start), pa.array(ns), pa.array(crc, pa.int64())],
                                                 names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return (blocks.join(starts, ["part", "number"]).select("part", "inside", "doc_ids", "ns", "crcs", "body")
                  .mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_dir(spark)
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), out)
    return read_tokens(spark, out)
