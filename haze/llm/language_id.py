"""Language of whole texts: family first, then pairwise linear support vector machines inside it.

Features are shares of byte 2-grams and hashed 3-grams of the letters of a text. A linear SVM
per family (one against the rest) picks the family; inside it one SVM per pair of languages
votes, ties go to the larger sum of margins. Training rows are a bounded sample, ``TRAIN_PER_LANG``
texts of each language at most, drawn by a hash of the id; prediction reads whole texts.

Only rows with a language and crc32(doc_id) mod 3 other than 1 are learned from; lang, source
and doc_id are never inputs of a prediction.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; so is every text if
nothing can be learned; with one learned language every text with letters gets it; languages
without a known family form a family of their own; a null id is not held out.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haze.llm.common import U64, chunks, text_buffers, tidied
from haze.llm.toxicity import folded, held_out

TRAIN_PER_LANG, UNKNOWN = 1500, "und"
BINS = 1 << 17

#: Families of languages, by ISO 639-1 code.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb fy yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tk",
    "celtic": "ga gd cy br",
    "semitic": "ar he mt am",
    "indo-aryan": "hi ur bn pa mr gu ne si",
    "iranian": "fa ku ps tg",
}


def family_of(lang: str) -> str:
    code = lang.lower().replace("_", "-").split("-")[0]
    return next((f for f, codes in FAMILIES.items() if code in codes.split()), lang)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bins of 2-grams, bins of 3-grams, their validity, row starts); bin 0 stands for nothing."""
    text = np.insert(folded(data), offsets, 0x20)
    starts = offsets + np.arange(len(offsets))
    a = text.astype(np.int64)
    if len(a) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), starts
    two = a[:-2] * 256 + a[1:-1]
    three = 65536 + ((((two * 256 + a[2:]).astype(U64)) * U64(0x9E3779B97F4A7C15)) >> U64(48)).astype(np.int64)
    ok = (a[1:-1] != 0x20) | ((a[:-2] != 0x20) & (a[2:] != 0x20))  # not inside a stretch of blanks
    apart = starts[(starts > 0) & (starts <= len(ok))] - 1
    ok[apart] = False  # nothing reaches from one text into the next
    return np.where(ok, two, 0), np.where(ok, three, 0), ok.astype(np.int64), starts


class Model:
    """Linear classifiers side by side: column m of ``weights`` belongs to classifier m."""

    def __init__(self, texts: pa.Array, langs: list[str], rounds: int = 12, cost: float = 4.0):
        self.langs = sorted(set(langs))
        self.families = sorted({family_of(x) for x in self.langs})
        self.members = {f: [x for x in self.langs if family_of(x) == f] for f in self.families}
        self.pairs = [p for f in self.families for p in combinations(self.members[f], 2)]
        rows = self._rows(texts)
        of, family = np.array(langs), np.array([family_of(x) for x in langs])
        columns, self.bias = [], []
        for f in self.families if len(self.families) > 1 else []:
            columns.append(self._fit(rows, np.arange(len(rows)), np.where(family == f, 1.0, -1.0), rounds, cost))
        for x, y in self.pairs:
            at = np.flatnonzero((of == x) | (of == y))
            columns.append(self._fit(rows, at, np.where(of[at] == x, 1.0, -1.0), rounds, cost))
        self.weights = np.stack(columns, axis=1).astype(np.float32) if columns else np.zeros((BINS, 0), np.float32)

    @staticmethod
    def _rows(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        rows = []
        for part in chunks(pa.table({"text": texts}), "text"):
            two, three, ok, starts = features(*text_buffers(part.column("text")))
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                n = max(1, int(ok[a:b].sum()))
                bins, counts = np.unique(np.concatenate([two[a:b], three[a:b]]), return_counts=True)
                keep = bins > 0
                rows.append((bins[keep], 10 * counts[keep] / n))
        return rows

    def _fit(self, rows, at, y, rounds, cost) -> np.ndarray:
        """Dual coordinate descent for the linear SVM with hinge loss; classes weigh alike."""
        w, b = np.zeros(BINS), 0.0
        upper = np.where(y > 0, cost * len(y) / max(1, (y > 0).sum()), cost * len(y) / max(1, (y < 0).sum())) / 2
        alpha, norm = np.zeros(len(at)), np.array([float((rows[i][1] ** 2).sum()) + 1 for i in at])
        rng = np.random.default_rng(7)
        for _ in range(rounds):
            for k in rng.permutation(len(at)):
                bins, x = rows[at[k]]
                g = y[k] * (float(w[bins] @ x) + b) - 1
                new = min(max(alpha[k] - g / norm[k], 0.0), upper[k])
                if new != alpha[k]:
                    step = (new - alpha[k]) * y[k]
                    w[bins] += step * x
                    b += step
                    alpha[k] = new
        self.bias.append(b)
        return w

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
        two, three, ok, starts = features(data, offsets)
        n, m = len(offsets) - 1, self.weights.shape[1]
        margin = np.zeros((n, m))
        if len(two) and m:
            sums = np.concatenate([np.zeros((1, m)), np.cumsum(self.weights[two] + self.weights[three], axis=0, dtype=np.float64)])
            count = np.concatenate([[0], np.cumsum(ok)])
            a, b = np.minimum(starts[:-1], len(two)), np.minimum(starts[1:], len(two))
            margin = 10 * (sums[b] - sums[a]) / np.maximum(1, count[b] - count[a])[:, None]
        margin = margin + np.array(self.bias)
        return self._decide(margin)

    def _decide(self, margin: np.ndarray) -> tuple[list[str], np.ndarray]:
        n, nf = len(margin), len(self.families) if len(self.families) > 1 else 0
        family = margin[:, :nf].argmax(1) if nf else np.zeros(n, np.int64)
        sure = 1 / (1 + np.exp(-2 * np.clip(margin[:, :nf].max(1), -20, 20))) if nf else np.ones(n)
        lang = np.empty(n, object)
        score = sure.copy()
        for f, name in enumerate(self.families):
            members, at = self.members[name], np.flatnonzero(family == f)
            votes, total, least = np.zeros((len(at), len(members))), np.zeros((len(at), len(members))), np.full((len(at), len(members)), 20.0)
            for c, (x, y) in enumerate(self.pairs):
                if x in members:
                    i, j, g = members.index(x), members.index(y), margin[at, nf + c]
                    votes[:, i] += g >= 0
                    votes[:, j] += g < 0
                    total[:, i] += g
                    total[:, j] -= g
                    least[:, i] = np.minimum(least[:, i], g)
                    least[:, j] = np.minimum(least[:, j], -g)
            best = (votes * 1e6 + np.clip(total, -1e5, 1e5)).argmax(1) if len(members) > 1 else np.zeros(len(at), np.int64)
            lang[at] = np.array(members, object)[best]
            if len(members) > 1:
                score[at] *= 1 / (1 + np.exp(-2 * np.clip(least[np.arange(len(at)), best], -20, 20)))
        return lang.tolist(), score


def train(docs: DataFrame, per_lang: int = TRAIN_PER_LANG) -> Model | None:
    """A model from at most about ``per_lang`` texts of each language; None if there is none."""
    known = docs.where("lang is not null and text is not null").where(~held_out())
    counts = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    rates = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, per_lang / n))])
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < rates[F.col("lang")] * 1_000_000
    sample = known.where(draw).select("text", "lang").toArrow()
    letters = pc.match_substring_regex(sample.column("text"), r"\p{L}")
    sample = sample.filter(letters)
    return Model(sample.column("text").combine_chunks(), sample.column("lang").to_pylist()) if sample.num_rows else None


def languages(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and lang_score; these replace columns of the same names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.drop("lang_pred", "lang_score")
    schema = rows.withColumn("lang_pred", F.lit("x")).withColumn("lang_score", F.lit(0.0)).schema

    @tidied
    def run(batches):
        fitted = shared.value
        for batch in batches:
            for part in chunks(batch, text_col):
                text = part.column(text_col)
                letters = np.asarray(pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False))
                if fitted is None or not len(letters):
                    lang, score = [UNKNOWN] * len(letters), np.zeros(len(letters))
                else:
                    lang, score = fitted.predict(*text_buffers(text))
                    lang = [x if ok else UNKNOWN for x, ok in zip(lang, letters, strict=True)]
                    score = np.where(letters, score, 0.0)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*part.schema.names, "lang_pred", "lang_score"])

    return rows.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = languages(docs.select("doc_id", "text", held_out().alias("held_out")), train(docs))
    return found.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))
