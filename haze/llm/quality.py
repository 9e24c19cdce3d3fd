"""Quality rules whose cut-offs come from quantile sketches of each language and source.

Four rates are measured on every text, in thousandths: code points per word, symbols per word,
repeated lines per line, words in repeated 3-word windows per word. A sketch counts values in
buckets of relative width 1 / 64 (exact below 128), so sketches merge by adding counts: those of
a language's sources give the language's, those give the whole table's. A group's cut-offs are
fences around its middle half,

    [q25 - ``reach`` * spread, q75 + ``reach`` * spread],  spread = max(q75 - q25, a floor per rate),

read from its own sketch if at least ``min_docs`` texts are in it, else from its language's, else
from the whole table's. Only the length of words has a lower fence. The texts counted are those
that pass the fixed base rules, which the fences are to refine. A text is kept if it passes the
base rules and all four rates lie within its group's fences.

Shape: one pass over the texts; a narrow table of measures is written. Sketch rows are counted with
map-side combining (at most a few thousand buckets a group), running sums go over buckets, not
texts. The fences are joined with measures on (language, source, salt), so a group with a third of
all texts is ``SALT`` join partitions.

Defined cases: a null text has no words and fails the base rules; null lang or source is a group of
its own; repeated rows count again; an empty table gives no rows and no fences; with no group large
enough for any sketch the whole table's holds, however small. Ties lie inside the fences.
Columns of the documents come through whatever their names; on a clash the measure's column wins.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from haze.llm.common import NOT_SPACE, Words, chunks, materialize, text_buffers, window_ok
from haze.llm.divergence import spans

#: Fewest texts for a sketch of one's own, reach of the fences in spreads, salt of the join.
MIN_DOCS, REACH, SALT = 200, 3, 16
#: Smallest spread of each rate (thousandths).
FLOORS = {"word_length": 500, "symbols": 20, "dup_lines": 120, "repeats": 80}
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_SYMBOL = np.zeros(256, bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True


def _codes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Equal byte ranges have equal numbers (exact)."""
    return np.asarray(spans(data, start, end).dictionary_encode().indices).astype(np.int64)


def _twice(row: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Masks of the items whose code their row holds before, and holds twice or more."""
    _, code = np.unique(code, return_inverse=True)
    _, first, inverse, n = np.unique(row * (int(code.max(initial=0)) + 1) + code, return_index=True, return_inverse=True, return_counts=True)
    return np.arange(len(code)) != first[inverse], n[inverse] > 1


def measure(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The five measures and the number of lines with a word, for each text."""
    rows = len(offsets) - 1
    words = Words(data, offsets, NOT_SPACE)
    total = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets]).astype(np.int64)
    inside = NOT_SPACE[data]
    chars = total(inside & ((data & 0xC0) != 0x80))
    symbols = total(_SYMBOL[data])
    # lines: cut at every \n and at every text's end
    cuts = np.flatnonzero(data == 10)
    begin = np.sort(np.concatenate([offsets[:-1], cuts + 1]))
    stop = np.sort(np.concatenate([offsets[1:], cuts]))
    row = np.sort(np.concatenate([np.arange(rows), np.searchsorted(offsets, cuts, side="right") - 1]))
    seen = np.concatenate([[0], np.cumsum(inside)])
    full = seen[stop] > seen[begin]
    begin, stop, row = begin[full], stop[full], row[full]
    again = _twice(row, _codes(data, begin, stop))[0] if len(begin) else np.zeros(0, bool)
    n_lines = np.bincount(row, minlength=rows)
    dup_lines = np.bincount(row[again], minlength=rows)
    # words covered by a 3-word window found twice or more
    repeat = np.zeros(len(words), bool)
    ok = window_ok(words.row, 3)
    if ok.any():
        code = _codes(data, words.start, words.end)
        _, pair = np.unique(code[:-2] * (int(code.max()) + 1) + code[1:-1], return_inverse=True)
        at = np.flatnonzero(ok)
        at = at[_twice(words.row[at], (pair * (int(code.max()) + 1) + code[2:])[at])[1]]
        for k in range(3):
            repeat[at + k] = True
    repeats = np.bincount(words.row[repeat], minlength=rows)
    return [words.count.astype(np.int64), chars, symbols, dup_lines.astype(np.int64), repeats.astype(np.int64), n_lines.astype(np.int64)]


def _measured(batches):
    for batch in batches:
        for part in chunks(batch, "text"):
            data, offsets = text_buffers(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("row"), *(pa.array(x) for x in measure(data, offsets))], names=["row", *MEASURES, "n_lines"])


def measures(rows: DataFrame) -> DataFrame:
    """``row`` (any type) with its text's measures and ``base_failed``; ``rows`` has row and text."""
    kind = rows.schema["row"].dataType.simpleString()
    out = rows.select("row", "text").mapInArrow(_measured, f"row {kind}, {', '.join(f'{c} long' for c in [*MEASURES, 'n_lines'])}")
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def rates() -> dict[str, Column]:
    """The four rates in thousandths, whole numbers."""
    per = lambda n, of: F.call_function("div", 1000 * F.col(n), F.greatest(F.col(of), F.lit(1).cast("long")))
    return {"word_length": per("word_chars", "n_words"), "symbols": per("n_symbols", "n_words"),
            "dup_lines": per("n_dup_lines", "n_lines"), "repeats": per("n_repeat_words", "n_words")}


def bucket_floor(v: Column) -> Column:
    """Least value of the sketch bucket of ``v``: its seven leading bits."""
    low = F.greatest(F.length(F.bin(v)) - 7, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", v, low), low)


def sketches(values: DataFrame) -> DataFrame:
    """Counts by (level, lang, source, rate, bucket): level 0 the source's, 1 the language's, 2 the whole table's.

    ``values`` has lang, source and the four rates."""
    rows = values.select("lang", "source", F.explode(F.array(*[F.struct(F.lit(r).alias("rate"), F.col(r).alias("v")) for r in FLOORS])).alias("x"))
    fine = rows.groupBy("lang", "source", F.col("x.rate").alias("rate"), bucket_floor(F.col("x.v")).alias("bucket")).agg(F.count("*").alias("n"))
    merged = fine.select("rate", "bucket", "n", F.explode(F.array(*[
        F.struct(F.lit(level).alias("level"), F.when(F.lit(level < 2), F.col("lang")).alias("lang"), F.when(F.lit(level < 1), F.col("source")).alias("source"))
        for level in range(3)])).alias("g"))
    return merged.groupBy("g.level", "g.lang", "g.source", "rate", "bucket").agg(F.sum("n").alias("n"))


def fences(sketch: DataFrame, reach: int) -> DataFrame:
    """level, lang, source, size and the eight fences of each sketch."""
    group = ["level", "lang", "source"]
    ordered = Window.partitionBy(*group, "rate").orderBy("bucket")
    ranked = sketch.withColumns({"below": F.sum("n").over(ordered), "size": F.sum("n").over(Window.partitionBy(*group, "rate"))})
    at = lambda q: F.min(F.when(4 * F.col("below") >= q * F.col("size"), F.col("bucket")))
    quartiles = ranked.groupBy(*group, "rate").agg(F.max("size").alias("size"), at(1).alias("q25"), at(3).alias("q75"))
    floor = F.create_map(*[x for k, v in FLOORS.items() for x in (F.lit(k), F.lit(v).cast("long"))])[F.col("rate")]
    slack = reach * F.greatest(F.col("q75") - F.col("q25"), floor)
    out = quartiles.withColumns({"low": F.col("q25") - slack, "high": F.col("q75") + slack})
    picks = [F.max(F.when(F.col("rate") == r, F.col(c))).alias(f"{c}_{r}") for r in FLOORS for c in ("low", "high")]
    return out.groupBy(*group).agg(F.max("size").alias("size"), *picks)


def _cuts() -> list[str]:
    return [f"{c}_{r}" for r in FLOORS for c in ("low", "high")]


def group_fences(groups: DataFrame, found: DataFrame, min_docs: int) -> DataFrame:
    """(lang, source) of ``groups`` with the fences of the finest sketch that is large enough, and its level."""
    wanted = groups.select("lang", "source", F.explode(F.array(*[
        F.struct(F.lit(k).alias("level"), F.when(F.lit(k < 2), F.col("lang")).alias("lang"), F.when(F.lit(k < 1), F.col("source")).alias("source"))
        for k in range(3)])).alias("w"))
    large = found.where(F.col("size") >= F.when(F.col("level") < 2, F.lit(min_docs)).otherwise(1))
    large = large.select(*[F.col(c).alias(f"{c}_") for c in ("level", "lang", "source")], F.struct("level", *_cuts()).alias("f"))
    own = (F.col("w.level") == F.col("level_")) & F.col("w.lang").eqNullSafe(F.col("lang_")) & F.col("w.source").eqNullSafe(F.col("source_"))
    return wanted.join(large, own, "left").groupBy("lang", "source").agg(F.min("f").alias("f")).select("lang", "source", "f.*")


class Rules:
    """Measures, sketches and fences of ``docs``; ``verdicts()`` joins them."""

    def __init__(self, docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", id_col: str = "doc_id",
                 min_docs: int = MIN_DOCS, reach: int = REACH):
        q = lambda c: F.col(f"`{c}`")
        rows = docs.select(F.struct(q(id_col).alias("id"), q(lang_col).cast("string").alias("lang"), q(source_col).cast("string").alias("source")).alias("row"),
                           q(text_col).cast("string").alias("text"))
        self.measured = materialize(measures(rows).select("row.*", *MEASURES, "n_lines", "base_failed").withColumns(rates()))
        self.sketch = materialize(sketches(self.measured.where(~F.col("base_failed"))))
        groups = self.measured.groupBy("lang", "source").agg(F.count("*").alias("n")).select("lang", "source")
        #: One row per (lang, source): the fences that hold there and the level of their sketch.
        self.fences = materialize(group_fences(groups, fences(self.sketch, reach), min_docs))

    def verdicts(self) -> DataFrame:
        """id, lang, source, measures, rates, base_failed, ``reasons`` (rates beyond a fence) and kept."""
        salted = self.measured.withColumn("salt", F.pmod(F.xxhash64("id", "n_words", "word_chars"), F.lit(SALT)).cast("int"))
        cuts = self.fences.withColumnsRenamed({"lang": "lang_", "source": "source_"}).withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        both = salted.join(cuts, F.col("lang").eqNullSafe(F.col("lang_")) & F.col("source").eqNullSafe(F.col("source_")) & (F.col("salt") == F.col("salt_")), "left")
        beyond = {r: F.col(r) > F.col(f"high_{r}") for r in FLOORS}
        beyond["word_length"] = beyond["word_length"] | (F.col("word_length") < F.col("low_word_length"))
        reasons = F.filter(F.array(*[F.when(c, F.lit(r)) for r, c in beyond.items()]), lambda x: x.isNotNull())
        out = both.withColumn("reasons", reasons)
        return out.withColumn("kept", ~F.col("base_failed") & (F.size("reasons") == 0)).select(
            "id", "lang", "source", *MEASURES, "n_lines", *FLOORS, "base_failed", "reasons", "kept")


def judge(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One row per document: its id, the measures, ``base_failed``, ``reasons`` and ``kept``."""
    return Rules(docs, id_col=id_col, **options).verdicts().withColumnRenamed("id", id_col)


def drop_low_quality(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents that are kept, with their columns; ``id_col`` must be unique."""
    kept = Rules(docs, id_col=id_col, **options).verdicts().where("kept").select(F.col("id").alias("__kept_id"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(f"`{id_col}`").alias("__id"))
    return rows.join(kept, F.col("__id").eqNullSafe(F.col("__kept_id")), "left_semi").select("__row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", *MEASURES, "base_failed", "kept")


_BUCKET = "((v >> greatest(length(bin(v)) - 7, 0)::BIGINT) << greatest(length(bin(v)) - 7, 0)::BIGINT)"
SQL = rf"""
WITH w AS (SELECT row_number() OVER () AS k, doc_id, lang, source, coalesce(text, '') AS t,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
lines AS (SELECT k, unnest(string_split(t, chr(10))) AS line FROM w),
l AS (SELECT k, sum(n) AS n_lines, sum(n - 1) AS n_dup FROM (SELECT k, line, count(*) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1, 2) GROUP BY 1),
win AS (SELECT k, i, ws[i:i + 2] AS g FROM (SELECT k, ws, unnest(generate_series(1, len(ws) - 2)) AS i FROM w WHERE len(ws) > 2)),
rep AS (SELECT k, count(DISTINCT pos) AS n FROM (SELECT k, unnest(generate_series(i, i + 2)) AS pos
        FROM (SELECT *, count(*) OVER (PARTITION BY k, g) AS c FROM win) WHERE c > 1) GROUP BY 1),
m AS (SELECT k, doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
             CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines
      FROM w LEFT JOIN l USING (k) LEFT JOIN rep USING (k)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
             1000 * word_chars // greatest(n_words, 1) AS word_length, 1000 * n_symbols // greatest(n_words, 1) AS symbols,
             1000 * n_dup_lines // greatest(n_lines, 1) AS dup_lines, 1000 * n_repeat_words // greatest(n_words, 1) AS repeats FROM m),
x AS (UNPIVOT (SELECT lang, source, word_length, symbols, dup_lines, repeats FROM b WHERE NOT base_failed) ON word_length, symbols, dup_lines, repeats INTO NAME rate VALUE v),
s AS (SELECT level, CASE WHEN level < 2 THEN lang END AS lang, CASE WHEN level < 1 THEN source END AS source, rate, {_BUCKET} AS bucket, count(*) AS n
      FROM x, (SELECT unnest([0, 1, 2]) AS level) GROUP BY ALL),
r AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, rate ORDER BY bucket) AS below, sum(n) OVER (PARTITION BY level, lang, source, rate) AS size FROM s),
q AS (SELECT level, lang, source, rate, max(size) AS size, min(bucket) FILTER (WHERE 4 * below >= size) AS q25, min(bucket) FILTER (WHERE 4 * below >= 3 * size) AS q75,
             CASE rate WHEN 'word_length' THEN {FLOORS['word_length']} WHEN 'symbols' THEN {FLOORS['symbols']} WHEN 'dup_lines' THEN {FLOORS['dup_lines']} ELSE {FLOORS['repeats']} END AS least FROM r GROUP BY ALL),
f AS (SELECT level, lang, source, rate, q25 - {REACH} * greatest(q75 - q25, least) AS low, q75 + {REACH} * greatest(q75 - q25, least) AS high
      FROM q WHERE size >= CASE WHEN level < 2 THEN {MIN_DOCS} ELSE 1 END),
bad AS (SELECT DISTINCT k FROM (SELECT k, y.rate, val, coalesce(f0.low, f1.low, f2.low) AS low, coalesce(f0.high, f1.high, f2.high) AS high
  FROM (UNPIVOT (SELECT k, lang, source, word_length, symbols, dup_lines, repeats FROM b) ON word_length, symbols, dup_lines, repeats INTO NAME rate VALUE val) y
  LEFT JOIN f f0 ON f0.level = 0 AND f0.rate = y.rate AND f0.lang IS NOT DISTINCT FROM y.lang AND f0.source IS NOT DISTINCT FROM y.source
  LEFT JOIN f f1 ON f1.level = 1 AND f1.rate = y.rate AND f1.lang IS NOT DISTINCT FROM y.lang
  LEFT JOIN f f2 ON f2.level = 2 AND f2.rate = y.rate) WHERE val > high OR (rate = 'word_length' AND val < low))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND bad.k IS NULL AS kept
FROM b LEFT JOIN bad USING (k)
"""
