"""Near-duplicate documents by bottom-k sketches of word shingles.

1. Each text becomes its set of distinct shingles (hashes of ``SHINGLE`` words); documents with
   equal sets form a class, and only one member of a class is looked at from then on.
2. The ``K`` smallest hashes of a set are its sketch, for every document under the same hash.
   Two sets of the wanted similarity share at least ``_needed`` retained values: for small sets
   that is arithmetic, for larger ones half of the sketch, which a pair at the threshold misses
   with a probability below 1e-9. So a class is entered only under its rarest values, as many as
   that overlap requires, and two classes that share no such value need not meet.
3. Members of a short list (inverted list of one value) are paired; the sketch of the pair's
   union is counted first, and only a pair that holds enough shared values is verified on the
   full sets. A long list is never expanded into pairs: its members meet in blocks, whose exact
   intersections come from one product of 0/1 matrices, and a block gives back a forest of its
   links, so what leaves a block grows with its members.
4. Links become components by alternating star contractions.

Lists are split by the number and the bytes of their members' sets; nothing is capped. Joins with
texts and sets are sort-merge joins at every size, so that a run grows as its input does.

Defined cases: null, empty or blank texts have no shingles and stand alone; a text of fewer than
``SHINGLE`` words is one shingle; rows with one id count as one document; rows without an id
stand alone (component null, kept); an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haze.llm.common import LOWER, NOT_SPACE, U64, Words, chunks, give_back, materialize, mix, pack, text_buffers, tidied, unpack, window_hashes

SHINGLE, K, SHORT = 5, 64, 32
BLOCK, BLOCK_VALUES = 2048, 2 << 20


def shingle_sets(texts, size: int = SHINGLE):
    """The sorted distinct shingle hashes of each text of an Arrow column."""
    data, offsets = text_buffers(texts)
    words = Words(LOWER[data], offsets, NOT_SPACE)
    h = words.hashes(1)
    wide = window_hashes(h, size)
    firsts, counts = words.first.tolist(), words.count.tolist()
    for i, n in enumerate(counts):
        a = firsts[i]
        if n >= size:
            yield np.unique(wide[a:a + n - size + 1])
        elif n:
            yield window_hashes(h[a:a + n], n)
        else:
            yield np.zeros(0, U64)


def _sketches(docs: DataFrame, id_col: str, text_col: str, size: int, k: int) -> DataFrame:
    @tidied
    def run(batches):
        for batch in batches:
            for part in chunks(batch, text_col):
                n, one, two, sketch = [], [], [], []
                for s in shingle_sets(part.column(text_col), size):
                    n.append(len(s))
                    one.append(int(s.sum(dtype=U64)))
                    two.append(int(mix(s ^ U64(0x9E3779B97F4A7C15)).sum(dtype=U64)) if len(s) else 0)
                    sketch.append(s[:k])
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in sketch])]).astype(np.int32)
                values = np.concatenate(sketch).view(np.int64) if sketch else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([
                    part.column(id_col).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(np.array(one, U64).view(np.int64)),
                    pa.array(np.array(two, U64).view(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))],
                    names=["doc_id", "n", "one", "two", "sketch"])

    return docs.select(id_col, text_col).mapInArrow(run, "doc_id long, n long, one long, two long, sketch array<long>")


def _needed(percent: int, k: int):
    """Retained values that a similar pair shares at least, given one set's size."""
    exact = F.ceil(F.col("n") * percent / 100)
    return F.when(F.col("n") <= k * percent // 100, exact).otherwise(k // 2)


def _postings(classes: DataFrame, percent: int, k: int) -> DataFrame:
    """(value, rep, n): each class under the rarest of its retained values."""
    rows = classes.select("rep", "n", "one", F.explode("sketch").alias("value"))
    common = rows.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    shared = rows.join(common, "value").groupBy("rep", "n", "one").agg(F.array_sort(F.collect_list(F.struct("df", "value"))).alias("all"))
    entered = F.size("all") - _needed(percent, k) + 1
    return shared.where(entered > 0).select("rep", "n", F.explode(F.slice("all", F.lit(1), entered.cast("int"))).alias("x")).select("x.value", "rep", "n")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int, k: int) -> DataFrame:
    """The pairs (a, b) that are similar enough: union sketch first, then the full sets."""
    def check(left, right):
        out = []
        for raw in left.column("mine").to_pylist():
            a = unpack(raw)
            for b_id, other in zip(*(right.column(c).to_pylist() for c in ("b", "other")), strict=True):
                b = unpack(other)
                union = np.union1d(a[:k], b[:k])[:k]
                both = np.isin(union, a[:k], assume_unique=True) & np.isin(union, b[:k], assume_unique=True)
                if 2 * both.sum() < len(union) and max(len(a), len(b)) > k:
                    continue
                shared = len(np.intersect1d(a, b, assume_unique=True))
                if 100 * shared >= percent * (len(a) + len(b) - shared):
                    out.append((right.column("a")[0].as_py(), b_id))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([x for _, x in out], pa.int64())})

    right = pairs.hint("merge").join(sets.select(F.col("rep").alias("b"), F.col("set").alias("other")), "b")
    left = sets.select(F.col("rep").alias("a"), F.col("set").alias("mine")).join(pairs.select("a").distinct().hint("merge"), "a", "left_semi")
    return left.groupBy("a").cogroup(right.groupBy("a")).applyInArrow(check, "a long, b long")


def _block_links(percent: int):
    def links(table):
        sets = [unpack(x) for x in table.column("set").to_pylist()]
        block, rep = table.column("block").to_numpy(), table.column("rep").to_numpy()
        size = np.array([len(s) for s in sets])
        values = np.concatenate(sets)
        row = np.repeat(np.arange(len(sets)), size)
        order = np.argsort(values, kind="stable")
        values, row = values[order], row[order]
        new = np.ones(len(values), bool)
        new[1:] = values[1:] != values[:-1]
        column = np.cumsum(new) - 1
        held = np.bincount(column)[column] > 1
        row, column = row[held], column[held]
        column = np.unique(column, return_inverse=True)[1] if len(column) else column
        one = block == block[0]
        across = not one.all()
        left, right = (np.flatnonzero(one), np.flatnonzero(~one)) if across else (np.arange(len(sets)),) * 2
        shared = np.zeros((len(left), len(right)), np.float32)
        wide = 2048
        begin = 0
        edges = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else 0) + 1 + wide, wide))
        for begin, end in zip(edges[:-1], edges[1:], strict=True):
            if begin == end:
                continue
            x = np.zeros((len(sets), wide), np.float32)
            x[row[begin:end], column[begin:end] % wide] = 1
            shared += x[left] @ x[right].T if across else x @ x.T
        shared = shared.astype(np.int64)
        linked = (100 + percent) * shared >= percent * (size[left][:, None] + size[right][None, :])
        i, j = np.nonzero(linked)
        i, j = left[i], right[j]
        label = np.arange(len(sets))
        while True:
            before = label.copy()
            low = np.minimum(label[i], label[j])
            np.minimum.at(label, i, low)
            np.minimum.at(label, j, low)
            label = label[label]
            if np.array_equal(before, label):
                break
        at = np.flatnonzero(label != np.arange(len(sets)))
        del shared, linked, i, j
        give_back()
        return pa.table({"a": pa.array(rep[label[at]]), "b": pa.array(rep[at])})
    return links


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that has an edge (a, b); component is its smallest node."""
    spark = edges.sparkSession
    e = materialize(edges.select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).where("u <> v").distinct())
    mark = None
    while True:
        seen = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("v").cast("decimal(38,0)"))).first()
        if seen == mark or not seen[0]:
            break
        mark = seen
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
        e = materialize(small.where("u <> v").distinct().select("v", "u"))
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots) if seen[0] else spark.createDataFrame([], "node long, component long")


def near_duplicates(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text",
                    size: int = SHINGLE, k: int = K) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest id reachable over links), kept."""
    sketches = materialize(_sketches(docs, id_col, text_col, size, k))
    named = sketches.where("doc_id is not null and n > 0")
    classes = materialize(named.groupBy("n", "one", "two").agg(F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch")))
    postings = materialize(_postings(classes, percent, k))
    lists = postings.groupBy("value").agg(F.count("*").alias("members"), F.sum("n").alias("held"), F.bit_xor(F.xxhash64("rep", "n")).alias("who")).where("members > 1")
    lists = materialize(lists)
    short = postings.join(lists.where(F.col("members") <= SHORT), "value").select("value", "rep", "n")
    a, b = (short.select("value", F.col("rep").alias(x), F.col("n").alias(f"n{x}")) for x in "ab")
    similar = (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (F.col("a") < F.col("b"))
    pairs = materialize(a.join(b, "value").where(similar).select("a", "b").distinct())

    long_lists = lists.where(F.col("members") > SHORT).dropDuplicates(["members", "held", "who"])
    blocks = F.greatest(F.ceil(F.col("members") / BLOCK), F.ceil(F.col("held") / BLOCK_VALUES)).cast("int")
    members = postings.join(long_lists.select("value", blocks.alias("blocks")), "value")
    members = members.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    members = members.select("value", "rep", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    members = materialize(members.select("value", "rep", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")))

    asked = pairs.select(F.col("a").alias("rep")).unionAll(pairs.select("b")).unionAll(members.select("rep")).distinct()
    # one row of each class asked for: rows of one id and one set repeat only if the table repeats them
    texts = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).alias("text")).join(asked.hint("merge"), "rep", "left_semi")

    @tidied
    def as_sets(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                rows = [pack(s, ascending=True) for s in shingle_sets(part.column("text"), size)]
                yield pa.RecordBatch.from_arrays([part.column("rep"), pa.array(rows, pa.binary())], names=["rep", "set"])

    sets = materialize(texts.mapInArrow(as_sets, "rep long, set binary"))
    found = _verified(pairs, sets, percent, k)
    heavy = members.hint("merge").join(sets, "rep").groupBy("value", "i", "j").applyInArrow(_block_links(percent), "a long, b long")
    linked = components(found.unionByName(heavy))
    named_class = classes.select("n", "one", "two", "rep").join(linked, F.col("rep") == F.col("node"), "left")
    named_class = named_class.select("n", "one", "two", F.coalesce("component", "rep").alias("component"))
    out = sketches.select("doc_id", "n", "one", "two").join(named_class, ["n", "one", "two"], "left")
    component = F.when(F.col("doc_id").isNull() | (F.col("n") == 0), F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component; documents without text stay, columns as they were."""
    gone = near_duplicates(docs, percent, id_col, text_col).where(~F.col("kept")).select(F.col("doc_id").alias("__gone")).distinct()
    # whatever the columns are called, inside a struct they clash with nothing
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    return rows.join(gone, F.col(f"__row.`{id_col}`") == F.col("__gone"), "left_anti").select("__row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), percent=85)


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS sh FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(1, len(ws) - 4))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_in AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM both_in JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * shared >= 85 * (na.n + nb.n - shared)),
two_way AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, two_way.b FROM reach JOIN two_way ON two_way.a = reach.other)
SELECT doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) LEFT JOIN n USING (doc_id)
"""
