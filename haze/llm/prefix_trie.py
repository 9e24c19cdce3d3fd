"""Trie of conversation prefixes: a count-min sketch clears the prefixes that only one conversation has.

A turn is reduced to a digest of (role, text) and a byte count before anything is shuffled; a
prefix's digest chains its turns' digests (128-bit BLAKE2b; equal digests are taken as equal
prefixes). Sequences are cut into segments of ``SEGMENT`` turns, one narrow row each.

A prefix seen once makes all longer ones unique, so only prefixes of 1, 2, 4, 8, ... turns enter the
sketch: ``ROWS`` counters each, added up over all tasks. Counters never fall below the truth, so a
counter of one proves a singleton; from the first such prefix on, a conversation's nodes are its own
and are emitted where the segment lies. Tasks need to know of a counter only whether it exceeds one:
a bit each, ``ROWS`` x ``cells`` bits, with eight cells for each prefix entered and at most
``MAX_CELLS`` (32 MB a row of the sketch). Beyond that more prefixes count as possibly shared; the
result is the same.

Possibly shared prefixes are grouped by digest, combined on the map side. Sums over subtrees use
paths: nodes whose smallest member is the same conversation form one path, which hangs on a node of
a path with a smaller conversation. Totals of paths are added up along doubled ancestor distances,
so the rounds are the logarithm of how deep paths nest, and along a path by a running sum.

Defined cases: null role or text is empty; turns are ordered by turn (null first), ties by digest;
rows without conv_id take no part; an empty table gives no rows; a conversation left without turns
is a member of the root; other columns are not read. The list of conversations that end at a node
is hashed as a stream over sorted rows, so its length costs time but no memory.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from haze.llm.common import materialize

FAMILY, HEADS, SEGMENT = 5, 9, 64
ROWS, CELLS_EACH, MAX_CELLS = 2, 8, 1 << 28
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_SEGMENTS = "conv_id long, start long, before binary, digests binary, sizes binary, checked binary, last boolean"


# ---------------------------------------------------------------- sequences

def _turn_digests(batches):
    for batch in batches:
        role, text = batch.column("role").to_pylist(), batch.column("text").to_pylist()
        digests, sizes = [], []
        for r, t in zip(role, text, strict=True):
            r, t = (r or "").encode(), (t or "").encode()
            digests.append(hashlib.blake2b(len(r).to_bytes(8, "little") + r + t, digest_size=16).digest())
            sizes.append(len(t))
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("turn"), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64())],
                                         names=["conv_id", "turn", "digest", "size"])


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 0), digest and UTF-8 bytes of each turn."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string"), F.col("text").cast("string"))
    narrow = rows.where("conv_id is not null").mapInArrow(_turn_digests, "conv_id long, turn long, digest binary, size long")
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest")
    return narrow.select("conv_id", (F.row_number().over(order) - 1).cast("long").alias("place"), "digest", "size")


def heads_taken(conv: Column) -> Column:
    """How many turns a conversation takes from the head of its family."""
    return F.pmod(F.crc32(conv.cast("string").cast("binary")), F.lit(HEADS))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id, place, digest, size of the rebuilt sequences; place -1 stands for the conversation itself."""
    own = materialize(turns(conversations))
    taken = heads_taken(F.col("conv_id"))
    kept = own.where(F.col("place") >= taken)
    # truncated division: the head of a family of negative ids has the largest id
    step = F.explode(F.when(F.col("conv_id") > 0, F.sequence(F.lit(0), F.lit(FAMILY - 1))).when(F.col("conv_id") < 0, F.sequence(F.lit(1 - FAMILY), F.lit(0)))
                     .otherwise(F.sequence(F.lit(1 - FAMILY), F.lit(FAMILY - 1))))
    heads = own.where((F.col("conv_id") % FAMILY == 0) & (F.col("place") < HEADS - 1)).select(step.alias("step"), "*")
    heads = heads.withColumn("conv_id", F.col("conv_id") + F.col("step")).where(F.col("place") < taken).drop("step")
    present = own.where("place = 0").select("conv_id", F.lit(-1).cast("long").alias("place"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("size"))
    return present.unionByName(heads).unionByName(kept)


def _segment(batches):
    """Segments of each conversation from rows in the order of (conv_id, place)."""
    conv, digest, out = None, b"", []
    start, before, digests, sizes, checked, depth = 0, b"", [], [], [], 0

    def row(last):
        return (conv, start, before, b"".join(digests), np.array(sizes, np.int64).tobytes(), b"".join(checked), last)

    def table():
        rows = [list(c) for c in zip(*out, strict=True)]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names=[f.split()[0] for f in _SEGMENTS.split(", ")])

    for batch in batches:
        for c, place, d, size in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "place", "digest", "size")), strict=True):
            if place < 0:
                if conv is not None:
                    out.append(row(True))
                conv, digest, start, before, digests, sizes, checked, depth = c, b"", 0, b"", [], [], [], 0
                continue
            if c != conv:
                continue   # heads for a conversation that is not there
            if len(digests) == SEGMENT:
                out.append(row(False))
                start, before, digests, sizes = depth, digest, [], []
            digest = hashlib.blake2b(digest + d, digest_size=16).digest()
            depth += 1
            digests.append(digest)
            sizes.append(size)
            if depth & (depth - 1) == 0:
                checked.append(digest[:8])
        if len(out) > 4096:
            yield table()
            out = []
    if conv is not None:
        out.append(row(True))
    if out:
        yield table()


def segments(conversations: DataFrame) -> DataFrame:
    """One row per ``SEGMENT`` turns: the prefix digests after each turn, the digest before the first,
    bytes of the turns and the hashes of the checked prefixes (1, 2, 4, ... turns) up to its end."""
    rows = rebuilt(conversations).repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return rows.mapInArrow(_segment, _SEGMENTS)


# ---------------------------------------------------------------- sketch

def cells_of(hashes: np.ndarray, cells: int) -> list[np.ndarray]:
    """The cell of each 64-bit hash in each row of the sketch; ``cells`` is a power of two."""
    out = []
    for r in range(ROWS):
        x = (hashes ^ np.uint64(0x9E3779B97F4A7C15 * (r + 1) & (1 << 64) - 1)) * np.uint64(0xD1342543DE82EF95)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xDABA0B6EB09322E3)
        out.append(((x >> np.uint64(20)) & np.uint64(cells - 1)).astype(np.int64))
    return out


def _new_checked(batch) -> np.ndarray:
    """Hashes of the checked prefixes whose last turn lies in the batch's segments, each once."""
    found = []
    for start, digests, checked in zip(batch.column("start").to_pylist(), batch.column("digests").to_pylist(), batch.column("checked").to_pylist(), strict=True):
        earlier = start.bit_length()          # powers of two up to ``start``
        found.append(checked[8 * earlier:8 * (start + len(digests) // 16).bit_length()])
    return np.frombuffer(b"".join(found), np.uint64)


def _cell_counts(cells: int):
    def count(batches):
        for batch in batches:
            hashes = _new_checked(batch)
            at = np.concatenate([c + r * cells for r, c in enumerate(cells_of(hashes, cells))])
            cell, n = np.unique(at, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n.astype(np.int64))], names=["cell", "n"])
    return count


def repeated_cells(parts: DataFrame, cells: int) -> np.ndarray:
    """Bits of the merged sketch: set where a counter exceeds one. Its size is ``ROWS`` x ``cells`` / 8 bytes."""
    counted = parts.mapInArrow(_cell_counts(cells), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).where("n > 1")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("cell", F.lit(64)).cast("int"))
    words = counted.groupBy(F.shiftright("cell", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))
    out = np.zeros(ROWS * cells // 64, np.uint64)
    for batch in words.toArrow().to_batches():
        out[batch.column("word").to_numpy()] = batch.column("bits").to_numpy().view(np.uint64)
    return out


def _shared_depth(checked: bytes, length: int, bits: np.ndarray, cells: int) -> int:
    """Depth up to which a prefix may be shared: one less than the first checked prefix with a counter of one."""
    hashes = np.frombuffer(checked, np.uint64)
    often = np.ones(len(hashes), bool)
    for r, cell in enumerate(cells_of(hashes, cells)):
        at = (cell + r * cells).astype(np.uint64)
        often &= (bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
    alone = np.flatnonzero(~often)
    return (1 << int(alone[0])) - 1 if len(alone) else length


# ---------------------------------------------------------------- split

_SHARED = "conv_id long, depth long, digest binary, parent binary, size long, goes_on boolean, alone boolean"


def _shared_rows(shared_bits, cells: int):
    """Possibly shared prefixes, and the first prefix of each tail (``alone``)."""
    names = [f.split()[0] for f in _SHARED.split(", ")]

    def split(batches):
        bits = shared_bits.value
        for batch in batches:
            cols = [[] for _ in names]
            for conv, start, before, digests, sizes, checked, last in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "start", "before", "digests", "sizes", "checked", "last")), strict=True):
                n = len(digests) // 16
                end = start + n
                deep = _shared_depth(checked, end, bits, cells)
                size = np.frombuffer(sizes, np.int64)
                for i in range(min(n, deep + 1 - start)):
                    depth = start + i + 1
                    row = (conv, depth, digests[16 * i:16 * i + 16], digests[16 * i - 16:16 * i] if i else before, int(size[i]), depth < end or not last, depth > deep)
                    for col, v in zip(cols, row, strict=True):
                        col.append(v)
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.bool_(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)
    return split


def _tail_nodes(shared_bits, cells: int):
    """Nodes below the first of each tail: one member, one leaf, nothing saved."""
    def emit(batches):
        bits = shared_bits.value
        for batch in batches:
            convs, depths, ends = [], [], []
            for conv, start, digests, checked, last in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "start", "digests", "checked", "last")), strict=True):
                end = start + len(digests) // 16
                own = np.arange(max(start + 1, _shared_depth(checked, end, bits, cells) + 2), end + 1)
                convs.append(np.full(len(own), conv))
                depths.append(own)
                ends.append((own == end) & last)
            if not convs:
                continue
            conv, depth, end = np.concatenate(convs), np.concatenate(depths), np.concatenate(ends).astype(bool)
            sha = [hashlib.sha256(str(c).encode()).hexdigest() if e else EMPTY_SHA for c, e in zip(conv.tolist(), end.tolist(), strict=True)]
            one = np.ones(len(conv), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (conv.astype(np.int64), depth.astype(np.int64), conv.astype(np.int64), one, (~end).astype(np.int64), one, one * 0)]
                                             + [pa.array(sha, pa.string())], names=[f.split()[0] for f in _NODE.split(", ")])
    return emit


def _hash_lists(batches):
    """SHA-256 of each key's comma-joined conversations, from rows in the order of (key, conv_id)."""
    key, running, done = None, None, []
    for batch in batches:
        for k, c in zip(batch.column("digest").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            if running is None or k != key:
                if running is not None:
                    done.append((key, running.hexdigest()))
                key, running = k, hashlib.sha256(str(c).encode())
            else:
                running.update(b",%d" % c)
        if len(done) > 4096:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], names=["digest", "ends"])
            done = []
    if running is not None:
        done.append((key, running.hexdigest()))
    yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], names=["digest", "ends"])


# ---------------------------------------------------------------- trie

def _path_totals(paths: DataFrame, root: int) -> DataFrame:
    """conv_id, parent_conv_id, at, saved, leaves of each path with its subtree's totals.

    ``paths``: conv_id, parent_conv_id (null for ``root``'s path), at (depth it hangs on), saved and
    leaves of its own. Each round adds the totals of the paths hanging 1, 2, 4, ... levels below.
    """
    keep = ["conv_id", "parent_conv_id", "at", "saved", "leaves"]
    now = materialize(paths.withColumn("up", F.col("parent_conv_id")))
    while True:
        hanging = now.where("up is not null")
        if hanging.isEmpty():
            return now.drop("up")
        added = hanging.groupBy(F.col("up").alias("conv_id")).agg(F.sum("saved").alias("more_saved"), F.sum("leaves").alias("more_leaves"))
        summed = now.join(added, "conv_id", "left").na.fill(0, ["more_saved", "more_leaves"]).select(
            "conv_id", "parent_conv_id", "at", (F.col("saved") + F.col("more_saved")).alias("saved"), (F.col("leaves") + F.col("more_leaves")).alias("leaves"), "up")
        # above the root there is nothing to look up, and a large part of all paths may hang on it
        climbing = summed.where(F.col("up") != root).join(
            hanging.select(F.col("conv_id").alias("up"), F.col("up").alias("next_up")), "up", "left").select(*keep, F.col("next_up").alias("up"))
        arrived = summed.where(F.col("up").isNull() | (F.col("up") == root)).select(*keep, F.lit(None).cast("long").alias("up"))
        now = materialize(climbing.unionByName(arrived))


def trie(conversations: DataFrame, cells_each: int = CELLS_EACH, max_cells: int = MAX_CELLS) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = conversations.sparkSession
    parts = materialize(segments(conversations))
    first = F.col("start") == 0
    seen = parts.agg(F.min("conv_id").alias("least"), F.count_if(first).alias("convs"),
                     F.min(F.when(first, F.struct("conv_id", (F.octet_length("digests") > 0).alias("goes_on")))).alias("m"),
                     F.sum(F.octet_length("checked") / 8 - F.when(F.col("start") > 0, F.floor(F.log2(F.greatest("start", F.lit(1)))) + 1).otherwise(0)).alias("checked")).first()
    if not seen.convs:
        return spark.createDataFrame([], _NODE)
    cells = min(max_cells, max(64, 1 << int(cells_each * seen.checked).bit_length()))
    bits = spark.sparkContext.broadcast(repeated_cells(parts, cells))
    rows = materialize(parts.mapInArrow(_shared_rows(bits, cells), _SHARED))
    grouped = materialize(rows.where(~F.col("alone")).groupBy("digest").agg(
        F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("parent").alias("parent"), F.max("size").alias("size"),
        F.count("*").alias("n_convs"), F.min(F.struct("conv_id", "goes_on")).alias("m")))
    tops = rows.where("alone").select("digest", "conv_id", "depth", "parent", "size", F.lit(1).cast("long").alias("n_convs"), "goes_on", "alone")
    nodes = grouped.select("digest", "conv_id", "depth", "parent", "size", "n_convs", F.col("m.goes_on").alias("goes_on"), F.lit(False).alias("alone")).unionByName(tops)
    above = grouped.select(F.col("digest").alias("parent"), F.col("conv_id").alias("above"))
    root = F.lit(seen.least).cast("long")
    nodes = nodes.join(above, "parent", "left").withColumn("parent_conv_id", F.when(F.col("depth") == 1, root).otherwise(F.col("above"))).drop("above")
    top = spark.createDataFrame([(bytearray(), seen.least, 0, 0, seen.convs, seen.m.goes_on, False, None)],
                                "digest binary, conv_id long, depth long, size long, n_convs long, goes_on boolean, alone boolean, parent_conv_id long")
    nodes = materialize(nodes.select(*top.columns).unionByName(top))

    # a path begins where the parent's smallest member is another; what hangs on a node are the paths that begin below it
    begins = nodes.where("parent_conv_id is null or parent_conv_id <> conv_id").select("conv_id", "parent_conv_id", (F.col("depth") - 1).alias("at"))
    hanging = begins.groupBy(F.col("parent_conv_id").alias("conv_id"), F.col("at").alias("depth")).agg(F.count("*").alias("paths"))
    nodes = nodes.join(hanging, ["conv_id", "depth"], "left").na.fill(0, ["paths"])
    # a tail's end is a leaf below its first node; a shared node is one if nothing follows
    nodes = materialize(nodes.withColumns({"saving": (F.col("n_convs") - 1) * F.col("size"),
                                           "leaf": (F.col("alone") | (~F.col("goes_on") & (F.col("paths") == 0))).cast("long")}))
    own = nodes.groupBy("conv_id").agg(F.sum("saving").alias("saved"), F.sum("leaf").alias("leaves"))
    totals = _path_totals(begins.join(own, "conv_id"), seen.least)
    below = totals.groupBy(F.col("parent_conv_id").alias("conv_id"), F.col("at").alias("depth")).agg(F.sum("saved").alias("more_saved"), F.sum("leaves").alias("more_leaves"))
    down = Window.partitionBy("conv_id").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    full = nodes.join(below, ["conv_id", "depth"], "left").na.fill(0, ["more_saved", "more_leaves"]).select(
        "digest", "conv_id", "depth", "parent_conv_id", "n_convs", (F.col("goes_on").cast("long") + F.col("paths")).alias("n_children"),
        F.sum(F.col("leaf") + F.col("more_leaves")).over(down).alias("n_leaves"), F.sum(F.col("saving") + F.col("more_saved")).over(down).alias("saved_tokens"))

    ends = rows.where(~F.col("goes_on")).select("digest", "conv_id").unionByName(
        parts.where((F.col("start") == 0) & (F.octet_length("digests") == 0)).select(F.lit(bytearray()).alias("digest"), "conv_id"))
    lists = ends.repartition("digest").sortWithinPartitions("digest", "conv_id").mapInArrow(_hash_lists, "digest binary, ends string")
    done = full.join(lists, "digest", "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                                                     F.coalesce("ends", F.lit(EMPTY_SHA)).alias("ends_sha256"))
    return done.unionByName(parts.mapInArrow(_tail_nodes(bits, cells), _NODE))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


_CRC = """xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
  lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"""
SQL = f"""
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS i,
                  coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
h AS (SELECT c, c - c % 5 AS b, {_CRC} % 9 AS h FROM (SELECT DISTINCT c FROM t)),
r AS (SELECT h.c, i, role, text FROM h JOIN t ON t.c = h.b AND i < h.h UNION ALL SELECT h.c, i, role, text FROM h JOIN t ON t.c = h.c AND i >= h.h),
s AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY i) AS d, md5(length(role) || ':' || role || text) AS g, strlen(text) AS bytes FROM r),
q AS (SELECT c, coalesce(string_agg(g, '' ORDER BY d), '') AS path, count(g) AS n FROM h LEFT JOIN s USING (c) GROUP BY c),
m AS (SELECT c, d, left(path, 32 * d) AS k, d = n AS final FROM (SELECT *, unnest(generate_series(0, n)) AS d FROM q)),
node AS (SELECT k, d, min(c) AS c, count(*) AS n, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE final), '') AS e FROM m GROUP BY k, d),
kids AS (SELECT left(k, 32 * (d - 1)) AS k, count(*) AS kids FROM node WHERE d > 0 GROUP BY 1),
v AS (SELECT node.*, coalesce(kids, 0) AS kids, (node.n - 1) * coalesce(bytes, 0) AS saving FROM node LEFT JOIN kids USING (k) LEFT JOIN s ON s.c = node.c AND s.d = node.d),
up AS (SELECT left(k, 32 * a) AS k, sum(CASE WHEN kids = 0 THEN 1 ELSE 0 END) AS leaves, sum(saving) AS saved FROM (SELECT *, unnest(generate_series(0, d)) AS a FROM v) GROUP BY 1)
SELECT v.c AS conv_id, v.d AS depth, p.c AS parent_conv_id, v.n AS n_convs, v.kids AS n_children, CAST(leaves AS BIGINT) AS n_leaves,
       CAST(saved AS BIGINT) AS saved_tokens, sha256(v.e) AS ends_sha256
FROM v JOIN up USING (k) LEFT JOIN node p ON p.d = v.d - 1 AND p.k = left(v.k, 32 * (v.d - 1))
"""
