"""How far the word use of sources drifts apart: count-level bitmaps of terms, joint cells by AND and popcount.

Terms are runs of letters, A-Z lower-cased. Each language keeps the V terms that at least
``MIN_DOCS`` of its documents hold. For a group (language, source) the kept terms fall into levels
of equal count; a level is stored as a bitset of term ids, in words of 64 bits. For two groups the
number of terms that occur a times in one and b times in the other is the popcount of the AND of
two levels; it is multiplied by f of the two levels' shares. Count zero has no bitset: what of a
level meets no level of the other group counts against zero, and what is in neither group is V
less both unions.

p = 1 + floor(1e9 (count + 2) / (N + 2 V)) and f = floor((p - q)^2 / (p + q)) are exact integers.

Shape: texts are tokenized and counted inside tasks, so (language, source, term) counts are what is
shuffled, by (language, term): a source or a language with a third of all rows is spread over all
tasks. Terms are dealt into buckets of about ``BUCKET_TERMS`` terms, in which they are numbered by
falling frequency (neighbours have like counts, so a word meets few levels). Each task compares the
groups of one bucket, in blocks of ``BLOCK_GROUPS`` groups, and returns one partial sum per pair:
the result itself has a row for each pair of sources of a language.

Defined cases: null text, lang and source are ''; a group without terms is a group; a language
without kept terms gives pairs of value 0 and no term rows; repeated rows count again (each is a
document); an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from haze.llm.common import LOWER, Words, chunks, materialize, text_buffers

MIN_DOCS, TOP, BUCKET_TERMS, BLOCK_GROUPS = 10, 10, 4096, 64
#: Distinct (group, term) pairs a task holds before it hands them on.
HELD = 1 << 18
#: Terms ``[^\x00-\x40\x5B-\x60\x7B-\x7F]+`` of lower-cased text.
LETTERS = np.zeros(256, bool)
LETTERS[0x61:0x7B] = LETTERS[0x80:] = True
_COUNTED = "lang string, source string, term string, n long, docs long"


def spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The byte ranges [start, end) of ``data`` as an Arrow string array."""
    size = end - start
    ends = np.concatenate([[0], np.cumsum(size)])
    at = np.repeat(start - ends[:-1], size) + np.arange(ends[-1])
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data[at]))


def _count_terms(batches):
    """Occurrences and documents of each term per group; a row without a term names each group."""
    held, rows = [], 0

    def flush():
        table = pa.concat_tables(held).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
        held.clear()
        return table.select(["lang", "source", "term", "n_sum", "docs_sum"]).rename_columns(["lang", "source", "term", "n", "docs"])

    for batch in batches:
        for part in chunks(batch, "text"):
            lang, source = (pc.fill_null(part.column(c), "").cast(pa.large_string()) for c in ("lang", "source"))
            data, offsets = text_buffers(part.column("text"))
            words = Words(LOWER[data], offsets, LETTERS)
            coded = spans(words.data, words.start, words.end).dictionary_encode()
            pair = words.row * max(1, len(coded.dictionary)) + np.asarray(coded.indices).astype(np.int64)
            pair, n = np.unique(pair, return_counts=True)
            row, term = pair // max(1, len(coded.dictionary)), pair % max(1, len(coded.dictionary))
            row, term = pa.array(row), pa.array(term)
            held.append(pa.table({"lang": lang.take(row), "source": source.take(row), "term": coded.dictionary.take(term),
                                  "n": pa.array(n.astype(np.int64)), "docs": pa.array(np.ones(len(n), np.int64))}))
            none = pa.array(np.zeros(part.num_rows, np.int64))
            held.append(pa.table({"lang": lang, "source": source, "term": pa.nulls(part.num_rows, pa.large_string()), "n": none, "docs": none}))
            rows += len(n) + part.num_rows
            if rows > HELD:
                held[:] = [flush()]
                rows = held[0].num_rows
                if rows > HELD // 2:
                    yield from held.pop().to_batches()
                    rows = 0
    if held:
        yield from flush().to_batches()


def share(n: Column | str, total: Column | str, kept: Column | str) -> Column:
    """1 + floor(1e9 (n + 2) / (total + 2 kept)), exact."""
    n, total, kept = (F.col(c) if isinstance(c, str) else c for c in (n, total, kept))
    wide = F.lit(1_000_000_000).cast("decimal(12,0)") * (n + 2).cast("decimal(20,0)")
    return F.when(kept > 0, 1 + F.call_function("div", wide, (total + 2 * kept).cast("decimal(20,0)")))


def distance(p: Column | str, q: Column | str) -> Column:
    """floor((p - q)^2 / (p + q)) of two positive shares, exact: shares stay near 1e9."""
    p, q = (F.col(c) if isinstance(c, str) else c for c in (p, q))
    return F.call_function("div", (p - q) * (p - q), p + q)


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p[:, None] - q[None, :]) ** 2 // (p[:, None] + q[None, :])


def bucket_pairs(source: np.ndarray, word: np.ndarray, bits: np.ndarray, p: np.ndarray, p0: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(value, joint) of each pair of groups over the levels of one bucket.

    ``source``, ``word``, ``bits``, ``p`` describe the levels' 64-bit words; ``p0`` holds each group's
    share of count zero. ``joint`` counts the terms that both groups have; ``value`` leaves out the
    terms that neither has.
    """
    groups = len(p0)
    value, joint = np.zeros((groups, groups), np.int64), np.zeros((groups, groups), np.int64)
    order = np.lexsort((source, word))
    source, word, bits, p = source[order], word[order], bits[order], p[order]
    size = np.bitwise_count(bits).astype(np.int64)
    edges = np.flatnonzero(np.diff(word, prepend=-1, append=-1))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        owner, first = np.unique(source[a:b], return_index=True)
        met = np.zeros((b - a, groups), np.int64)
        step = max(1, (1 << 20) // (b - a))
        for x in range(a, b, step):
            y = min(b, x + step)
            cells = np.bitwise_count(bits[x:y, None] & bits[None, a:b]).astype(np.int64)
            met[x - a:y - a, owner] = np.add.reduceat(cells, first, axis=1)
            far = np.zeros((y - x, groups), np.int64)
            far[:, owner] = np.add.reduceat(cells * _f(p[x:y], p[a:b]), first, axis=1)
            np.add.at(value, source[x:y], far)
        np.add.at(joint, source[a:b], met)
        alone = (size[a:b, None] - met) * _f(p[a:b], p0)
        np.add.at(value, source[a:b], alone)
        np.add.at(value.T, source[a:b], alone)
    return value, joint


def _compare(key, levels, groups):
    low, high = (key[i].as_py() for i in (2, 3))
    name, block, zero = groups.column("source").to_pylist(), groups.column("block").to_numpy(), groups.column("p0").to_numpy()
    order = sorted(range(len(name)), key=lambda i: name[i])
    place = {name[i]: at for at, i in enumerate(order)}
    name, block, zero = [name[i] for i in order], block[order], zero[order]
    source = np.array([place[s] for s in levels.column("source").to_pylist()], np.int64)
    value, joint = bucket_pairs(source, levels.column("word").to_numpy().astype(np.int64), levels.column("bits").to_numpy().view(np.uint64),
                                levels.column("p").to_numpy(), zero)
    i, j = np.triu_indices(len(name), 1)
    between = np.minimum(block[i], block[j]) == low
    between &= np.maximum(block[i], block[j]) == high
    i, j = i[between], j[between]
    names = pa.array(name, pa.string())
    return pa.table({"lang": pa.array([key[0].as_py()] * len(i), pa.string()), "a": names.take(pa.array(i)), "b": names.take(pa.array(j)),
                     "value": pa.array(value[i, j]), "joint": pa.array(joint[i, j])})


class Audit:
    """Kept terms, groups and stored levels of ``docs``; ``pairs()`` and ``terms()`` read them."""

    def __init__(self, docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
                 min_docs: int = MIN_DOCS, bucket_terms: int = BUCKET_TERMS, block_groups: int = BLOCK_GROUPS):
        read = docs.select(*[F.col(f"`{c}`").cast("string").alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
        dealt = read.mapInArrow(_count_terms, _COUNTED).repartition("lang", "term")
        counted = dealt.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        of_term = Window.partitionBy("lang", "term")
        spread = counted.withColumns({"in_docs": F.sum("docs").over(of_term), "n_lang": F.sum("n").over(of_term),
                                      "first": F.row_number().over(of_term.orderBy("source")) == 1})
        kept = materialize(spread.where(F.col("term").isNull() | (F.col("in_docs") >= min_docs)).select("lang", "source", "term", "n", "n_lang", "first"))
        #: One row per (lang, source, kept term) that occurs.
        self.counts = kept.where("term is not null")
        sizes = self.counts.groupBy("lang").agg(F.sum("n").alias("n_all"), F.count_if("first").alias("v"))
        totals = self.counts.groupBy("lang", "source").agg(F.sum("n").alias("n_group"), F.count("*").alias("used"))
        groups = kept.where("term is null").select("lang", "source").join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
        groups = groups.na.fill(0, ["n_group", "used", "n_all", "v"])
        most = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 0
        self.blocks = max(1, -(-most // block_groups))
        #: One row per (lang, source) that occurs.
        self.groups = materialize(groups.withColumns({"block": F.pmod(F.xxhash64("source"), F.lit(self.blocks)).cast("long"), "p0": share(F.lit(0), "n_group", "v")}))
        terms = self.groups.select("lang", "v").distinct().agg(F.sum("v")).first()[0] or 0
        self.buckets = max(1, -(-int(terms) // bucket_terms))

    def levels(self) -> DataFrame:
        """The stored bitsets: (lang, bucket, source, n, word, bits) with bit i for term 64 * word + i of the bucket."""
        numbered = Window.partitionBy("lang", "bucket").orderBy(F.desc("n_lang"), "term")
        placed = self.counts.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(self.buckets)))
        placed = placed.withColumn("id", (F.dense_rank().over(numbered) - 1).cast("long"))
        word = F.shiftright("id", 6).alias("word")
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("id", F.lit(64)).cast("int"))
        return placed.groupBy("lang", "bucket", "source", "n", word).agg(F.bit_or(bit).alias("bits"))

    def pairs(self) -> DataFrame:
        """lang, source, item (each other source of the language), value."""
        stats = self.groups.select("lang", "source", "block", "n_group", "v", "used", "p0")
        stored = materialize(self.levels())
        levels = stored.join(stats, ["lang", "source"]).withColumn("p", share("n", "n_group", "v"))
        other = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(self.blocks - 1).cast("long"))).alias("other")
        block = (F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
        levels = levels.select("lang", "bucket", "source", "word", "bits", "p", "block", other).select("lang", "bucket", "source", "word", "bits", "p", *block)
        bucket = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(self.buckets - 1).cast("long"))).alias("bucket")
        groups = stats.where("v > 0").select("lang", "source", "block", "p0", other).select("lang", "source", "block", "p0", *block, bucket)
        key = ["lang", "bucket", "low", "high"]
        partial = levels.groupBy(*key).cogroup(groups.groupBy(*key)).applyInArrow(_compare, "lang string, a string, b string, value long, joint long")
        summed = partial.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("joint").alias("joint"))
        a, b = stats.alias("a"), stats.alias("b")
        both = a.join(b, (F.col("a.lang") == F.col("b.lang")) & (F.col("a.source") < F.col("b.source"))).select(
            F.col("a.lang").alias("lang"), F.col("a.source").alias("a"), F.col("b.source").alias("b"), F.col("a.v").alias("v"),
            (F.col("a.used") + F.col("b.used")).alias("used"), F.col("a.p0").alias("p"), F.col("b.p0").alias("q"))
        neither = (F.col("v") - F.col("used") + F.coalesce("joint", F.lit(0))) * distance("p", "q")
        value = F.when(F.col("v") > 0, F.coalesce("value", F.lit(0)) + neither).otherwise(0).cast("long")
        found = both.join(summed, ["lang", "a", "b"], "left").select("lang", "a", "b", value.alias("value"))
        way = F.explode(F.array(*[F.struct(F.col(x).alias("source"), F.col(y).alias("item")) for x, y in (("a", "b"), ("b", "a"))]))
        return found.select("lang", "value", way.alias("w")).select("lang", "w.source", "w.item", "value")

    def terms(self) -> DataFrame:
        """lang, source, item (a term used more than in the whole language), value."""
        stats = self.groups.select("lang", "source", "n_group", "n_all", "v")
        used = self.counts.join(stats, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), share("n", "n_group", "v").alias("p"), share("n_lang", "n_all", "v").alias("q"))
        return used.where("p > q").select("lang", "source", "item", distance("p", "q").alias("value"))


def divergence(docs: DataFrame, top: int = TOP, **options) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value and rank; the ``top`` terms of each group."""
    audit = Audit(docs, **options)
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = audit.pairs().withColumn("rank", F.row_number().over(by_value))
    terms = audit.terms().withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top)
    both = pairs.withColumn("part", F.lit("pair")).unionByName(terms.withColumn("part", F.lit("term")))
    return both.select("lang", "source", "part", "item", "value", "rank")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "source", "text"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
o AS (SELECT k, lang, source, unnest(ws) AS term FROM d),
keep AS (SELECT lang, term FROM o GROUP BY 1, 2 HAVING count(DISTINCT k) >= 10),
groups AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(term) AS v FROM (SELECT DISTINCT lang FROM d) LEFT JOIN keep USING (lang) GROUP BY 1),
c AS (SELECT lang, source, term, count(*) AS n FROM o JOIN keep USING (lang, term) GROUP BY 1, 2, 3),
grid AS (SELECT g.lang, g.source, keep.term, coalesce(n, 0) AS n FROM groups g JOIN keep ON keep.lang = g.lang
         LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = keep.term),
shares AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v.v) AS p FROM grid JOIN v USING (lang)),
whole AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang) + 2 * v.v) AS q
          FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY 1, 2) JOIN v USING (lang)),
cells AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
          FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
          FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN cells ON cells.lang = a.lang AND cells.source = a.source AND cells.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) AS value
          FROM shares JOIN whole USING (lang, term) WHERE n > 0 AND p > q)
SELECT * FROM (SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
               FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)) WHERE part = 'pair' OR rank <= 10
"""
