"""Nearest vectors by inner product: an inverted file whose lists are scanned in adaptive dimensions.

Centroids are learned on a bounded sample (``TRAIN_ROWS`` vectors); every vector is put into the
list of its nearest centroid. Vectors are clustered with one more component, sqrt(L^2 - |x|^2) for
the table's largest length L: all are equally long then, and those with large inner products are
near in direction, whatever their lengths. A query visits its ``probes`` best lists; if those hold
fewer than ``k`` candidates, it visits the others too.

In a list vectors are compared as squared distances: with one more component sqrt(M^2 - |x|^2), M the
largest length there, and 0 for the query, the distance is |q|^2 + M^2 - 2 <q, x>, so the nearest by
distance have the largest inner product. All vectors are turned by one random rotation and read in
blocks of columns. After b of D columns the partial distance times D / b estimates the whole one with
a relative error of the root of about 1 / sqrt(b); a candidate whose estimate exceeds the distance of
the query's k-th best so far by more than the factor (1 + ``EPS`` / sqrt(b))^2 is given up. What
survives all blocks is scored on the original vectors in double precision.

Lists are dealt out in parts of at most ``PART_ROWS`` rows and queries in groups of at most
``GROUP_QUERIES``, so a list that holds a third of all vectors, or that all queries visit, is many
tasks of bounded size. The number of lists follows the number of vectors (at most ``MAX_LISTS``).

Defined cases: vectors that are null, zero, of another length than the most frequent one (the
smaller, if two are), or that hold null or non-finite components take no part; repeated ids are
separate rows, and a query skips every row of its own id; null ids take no part; fewer candidates
than ``k`` give fewer rows; ties go to the smaller id.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haze.llm.common import materialize

K, TRAIN_ROWS, PART_ROWS, GROUP_QUERIES, CHUNK_QUERIES, MAX_LISTS, BLOCK, EPS, PROBES = 20, 20_000, 4096, 16_384, 256, 4096, 16, 3.0, 0.75
_FOUND = "query_id long, vec_id long, score double"


def _matrix(col) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    values = col.flatten()
    return np.asarray(values).astype(np.float64).reshape(len(col), -1) if len(col) else np.zeros((0, 1))


def valid_vectors(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int]:
    """(vec_id, vec as doubles) of the rows that take part, and their dimension."""
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec")).where("vec_id is not null and vec is not null")
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists("vec", lambda x: x != 0)
    v = v.where(~bad & some)
    lengths = v.groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("n"))
    d = lengths.agg(F.max_by("d", F.struct("n", -F.col("d"))).alias("d")).first().d or 0
    return v.where(F.size("vec") == d), d


def _centroids(sample: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means."""
    rng = np.random.default_rng(5)
    x = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    c = x[rng.choice(len(x), min(lists, len(x)), replace=False)]
    for _ in range(rounds):
        of = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, of, x)
        size = np.linalg.norm(sums, axis=1)
        empty = size < 1e-12
        sums[empty] = x[rng.choice(len(x), int(empty.sum()))]
        c = sums / np.linalg.norm(sums, axis=1, keepdims=True)
    return c


def _scan(queries: np.ndarray, query_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, rotation: np.ndarray, k: int):
    """Best ``k`` of one part for each query: (query place, candidate place, score)."""
    order = np.argsort(ids, kind="stable")
    x, ids = x[order], ids[order]
    squares = np.einsum("ij,ij->i", x, x)
    top = squares.max()
    xr = np.column_stack([x, np.sqrt(np.maximum(0, top - squares))]) @ rotation
    qr = np.column_stack([queries, np.zeros(len(queries))]) @ rotation
    d = xr.shape[1]
    edges = [*range(0, d, BLOCK), d]
    blocks = list(zip(edges[:-1], edges[1:], strict=True))
    x_size = [np.einsum("ij,ij->i", xr[:, a:b], xr[:, a:b]) for a, b in blocks]
    head = max(4 * k, 256)
    out = []
    for at in range(0, len(queries), CHUNK_QUERIES):
        q, qt, own = queries[at:at + CHUNK_QUERIES], qr[at:at + CHUNK_QUERIES], query_ids[at:at + CHUNK_QUERIES, None]
        # the first rows set the bar; the others are read block by block against it
        first = q @ x[:head].T
        first[own == ids[None, :head]] = -np.inf
        bar = np.partition(first, -k, axis=1)[:, -k] if first.shape[1] >= k else np.full(len(q), -np.inf)
        far = np.einsum("ij,ij->i", q, q) + top
        slack = 1e-9 * far   # rounding differs between a product of matrices and one of vectors
        i, j = np.nonzero((first >= (bar - slack)[:, None]) & (first > -np.inf))
        columns = np.arange(min(head, len(x)), len(x))
        alive = own != ids[None, columns]
        partial = np.zeros(alive.shape)
        for (a, b), size in zip(blocks, x_size, strict=True):
            part = qt[:, a:b]
            partial += size[columns] + np.einsum("ij,ij->i", part, part)[:, None] - 2 * (part @ xr[columns, a:b].T)
            factor = (1 + EPS / math.sqrt(b)) ** 2 * b / d if b < d else 1.0
            alive &= partial <= ((far - 2 * bar) * factor + slack)[:, None]
            left = alive.any(axis=0)
            if left.sum() < 0.7 * len(left):
                columns, partial, alive = columns[left], partial[:, left], alive[:, left]
        more, place = np.nonzero(alive)
        i, j = np.concatenate([i, more]), np.concatenate([j, columns[place]])
        score = np.einsum("ij,ij->i", q[i], x[j])
        ranked = np.lexsort((ids[j], -score, i))
        i, j, score = i[ranked], j[ranked], score[ranked]
        keep = np.arange(len(i)) - np.searchsorted(i, i) < k
        out.append((at + i[keep], ids[j[keep]], score[keep]))
    return out


class Lists:
    """The inverted file over ``valid`` vectors (vec_id, vec) of ``d`` components."""

    def __init__(self, valid: DataFrame, n: int, d: int, longest: float, seed: int):
        spark = self.spark = valid.sparkSession
        lists = max(1, min(MAX_LISTS, int(math.sqrt(n) / 2)))
        draw = F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) < min(1.0, TRAIN_ROWS / n) * 1_000_000
        sample = _matrix(valid.where(draw).select("vec").toArrow().column(0))
        if not len(sample):
            sample = _matrix(valid.limit(lists).select("vec").toArrow().column(0))
        rng = np.random.default_rng(seed)
        rotation = np.linalg.qr(rng.standard_normal((d + 1, d + 1)))[0]
        lengthen = lambda x: np.column_stack([x, np.sqrt(np.maximum(0, longest - np.einsum("ij,ij->i", x, x)))])
        self.centers = _centroids(lengthen(sample), lists)
        self.shared = shared = spark.sparkContext.broadcast((self.centers, rotation))

        def assign(batches):
            c, _ = shared.value
            for batch in batches:
                x = _matrix(batch.column("vec"))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((lengthen(x) @ c.T).argmax(1) if len(x) else [], pa.int64())], names=[*batch.schema.names, "list"])

        self.placed = materialize(valid.mapInArrow(assign, "vec_id long, vec array<double>, list long"))

    def route(self, queries: DataFrame, first: int, last: int) -> DataFrame:
        """query_id, vec and list of the lists that stand from place ``first`` up to ``last`` in each query's order."""
        shared = self.shared

        def run(batches):
            c, _ = shared.value
            for batch in batches:
                x = _matrix(batch.column("vec"))
                best = np.argsort(-(x @ c[:, :-1].T), axis=1, kind="stable")[:, first:last] if len(x) else np.zeros((0, 1), np.int64)
                row = pa.array(np.repeat(np.arange(len(x)), best.shape[1]))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(row), batch.column("vec").take(row), pa.array(best.ravel().astype(np.int64))], names=["query_id", "vec", "list"])

        return queries.select("vec_id", "vec").mapInArrow(run, "query_id long, vec array<double>, list long")

    def search(self, asked: DataFrame, k: int) -> DataFrame:
        """query_id, vec_id, score: the best ``k`` of every part of every list asked."""
        asked = materialize(asked)
        # one row per list, MAX_LISTS at most
        count = lambda df, name, most: df.groupBy("list").agg(F.ceil(F.count("*") / most).alias(name))
        shape = count(self.placed, "parts", PART_ROWS).join(count(asked, "groups", GROUP_QUERIES), "list")
        shape = F.broadcast(materialize(shape))
        spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        held = self.placed.join(shape, "list").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts"))).withColumn("group", spread("groups"))
        asked = asked.join(shape, "list").withColumn("group", F.pmod(F.xxhash64("query_id"), F.col("groups"))).withColumn("part", spread("parts"))
        shared = self.shared

        def scan(left, right):
            _, turn = shared.value
            if not left.num_rows or not right.num_rows:
                return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
            ids, query_ids = left.column("vec_id").to_numpy(), right.column("query_id").to_numpy()
            found = _scan(_matrix(right.column("vec")), query_ids, _matrix(left.column("vec")), ids, turn, k)
            q, v, s = (np.concatenate(c) for c in zip(*found, strict=True))
            return pa.table({"query_id": pa.array(query_ids[q]), "vec_id": pa.array(v), "score": pa.array(s)})

        key = ["list", "part", "group"]
        return held.select(*key, "vec_id", "vec").groupBy(*key).cogroup(asked.select(*key, "query_id", "vec").groupBy(*key)).applyInArrow(scan, _FOUND)


def nearest(vectors: DataFrame, queries_where, k: int = K, probes: float = PROBES, id_col: str = "vec_id", vec_col: str = "embedding",
            seed: int = 3) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` nearest found for each row matching ``queries_where``.

    ``probes`` is the share of lists a query visits.
    """
    spark = vectors.sparkSession
    valid, d = valid_vectors(vectors, id_col, vec_col)
    square = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)
    seen = valid.agg(F.count("*").alias("n"), F.max(square).alias("longest")).first()
    if not seen.n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index = Lists(valid, seen.n, d, seen.longest, seed)
    total = len(index.centers)
    visited = min(total, max(1, math.ceil(probes * total)))
    queries = index.placed.where(queries_where)
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id", "score"))), 1, k)
    top = materialize(index.search(index.route(queries, 0, visited), k).groupBy("query_id").agg(best.alias("best")))
    if visited < total:
        # lists that hold too little: those queries see the others as well
        enough = top.where(F.size("best") >= k).select("query_id")
        short = queries.join(enough, F.col("vec_id") == F.col("query_id"), "left_anti")
        if not short.isEmpty():
            more = index.search(index.route(short, visited, total), k)
            rows = more.unionByName(top.select("query_id", F.explode("best").alias("b")).select("query_id", "b.vec_id", "b.score"))
            top = rows.groupBy("query_id").agg(best.alias("best"))
    return top.select("query_id", F.posexplode("best")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), "col.vec_id", "col.score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id % 20 = 0")
