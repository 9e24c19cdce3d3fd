"""Toxicity of whole texts, after undoing obfuscation with a noisy-channel decoder.

1. A character language model (3- and 4-grams of letters) is counted over all documents.
2. Spans that look disguised - words with a sign or digit next to a letter or a separator between
   letters, letters repeated three times or more, three or more single letters set apart - become
   a lattice, however long they are: a sign stands for the letters it resembles, for itself or for
   nothing, a blank between single letters for a word break or for nothing, a run of one letter for
   one or two of them. Viterbi decoding picks the most likely string under channel and language
   model, and the text is restored with it.
3. The restored text is scored. Character n-grams whose documents are mostly labelled toxic get
   a weight (log odds over a bounded sample of labelled rows, ``TRAIN_ROWS``); a word counts
   with its heaviest n-gram, and a logistic curve over the sum and the density of these weights
   gives the score.

Labels are read only from rows with crc32(doc_id) mod 3 other than 1; the labels, lang, source
and doc_id of a row are never inputs of its score.

Defined cases: null and empty texts have no evidence and get the score of such a text; without
labelled rows of both kinds every score is 0; labels other than 0 and 1 are ignored, and of
repeated labels of one id the largest counts; a null id is not held out.
"""

from __future__ import annotations

import functools
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haze.llm.common import U64, chunks, text_buffers

TRAIN_ROWS, THRESHOLD = 12_000, 0.7
GRAMS, BINS = (4, 5, 6), 1 << 20
SYMBOLS, FOUR_BINS = 92, 1 << 19

#: Letters that a sign or digit stands for.
LOOKS_LIKE = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
              "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "&": "", "*": "", "#": "", "%": ""}

_L, _S = r"[^\W\d_]", "[" + re.escape("".join(LOOKS_LIKE)) + "]"
_M, _D = "[&*#%]", "[" + re.escape("".join(c for c, x in LOOKS_LIKE.items() if x)) + "]"
#: What makes a word a lattice: a sign beside a letter (one that stands for no letter: between two), a separator between
#: letters, a letter three times. At the edge of a word a sign that stands for no letter is a blank either way.
_MARK = re.compile(rf"{_D}(?={_L})|(?<={_L}){_D}|(?<={_L}){_M}+(?={_L}|{_D})|(?<={_D}){_M}+(?={_L})|(?<={_L})[._\-]+(?={_L}|{_S})|(?<={_S})[._\-]+(?={_L})|([A-Za-z])(?i:\1\1)")
#: Single letters set apart: one sign or one or two blanks between neighbours.
_ALONE = rf"(?<!{_L})(?:{_L}|{_S})(?!{_L})"
_APART = re.compile(rf"{_ALONE}(?:(?:\s{{1,2}}|[^\w\s]|_){_ALONE}){{2,}}")
#: Letters in lower case, everything else a blank; the capitals of Latin-1 follow in ``folded``.
_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)
_CODE = np.zeros(256, np.int64)
_CODE[0x61:0x7B] = np.arange(1, 27)
_CODE[0x80:0xC0] = np.arange(27, 91)
_CODE[0xC0:] = 91


def folded(data: np.ndarray) -> np.ndarray:
    out = _FOLD[data]
    if len(data) > 1:
        capital = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        out[capital] += 0x20
    return out


# ---------------------------------------------------------------- language model

def _four(code: np.ndarray) -> np.ndarray:
    h = ((code[:-3] * SYMBOLS + code[1:-2]) * SYMBOLS + code[2:-1]) * SYMBOLS + code[3:]
    return ((h.astype(U64) * U64(0x9E3779B97F4A7C15)) >> U64(45)).astype(np.int64)


def language_model(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Log counts of letter 3-grams and (hashed) 4-grams over all texts; their size is fixed by the alphabet."""
    cells = SYMBOLS ** 3

    def count(batches):
        three, four = np.zeros(cells, np.int64), np.zeros(FOUR_BINS, np.int64)
        for batch in batches:
            for part in chunks(batch, text_col, 4 << 20):
                data, offsets = text_buffers(part.column(text_col))
                code = _CODE[np.insert(folded(data), offsets, 0x20)]
                if len(code) > 3:
                    three += np.bincount((code[:-2] * SYMBOLS + code[1:-1]) * SYMBOLS + code[2:], minlength=cells)
                    four += np.bincount(_four(code), minlength=FOUR_BINS)
        at = np.flatnonzero(both := np.concatenate([three, four]))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(both[at])], names=["cell", "c"])

    table = docs.select(text_col).mapInArrow(count, "cell long, c long").groupBy("cell").agg(F.sum("c").alias("c")).toArrow()
    total = np.zeros(cells + FOUR_BINS)
    total[table.column("cell").to_numpy()] = table.column("c").to_numpy()
    return np.log(total[:cells] + 0.1).astype(np.float32), np.log(total[cells:] + 0.1).astype(np.float32)


class Decoder:
    """Viterbi search for the word behind a disguised span."""

    def __init__(self, three: np.ndarray, four: np.ndarray):
        self.three, self.four, self.known = three, four, {}
        sums = np.exp(three).reshape(SYMBOLS * SYMBOLS, SYMBOLS).sum(1)
        self.two = np.log(sums)

    def _step(self, a: int, b: int, c: int, d: int) -> float:
        h = (((a * SYMBOLS + b) * SYMBOLS + c) * SYMBOLS + d) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
        abc, bcd, bc = (a * SYMBOLS + b) * SYMBOLS + c, (b * SYMBOLS + c) * SYMBOLS + d, b * SYMBOLS + c
        wide = float(self.four[h >> 45]) - float(self.three[abc])
        narrow = float(self.three[bcd]) - float(self.two[bc])
        return max(wide, narrow - 1.0) if self.three[abc] > 0 else narrow - 1.0

    def decode(self, span: str) -> str:
        """The most likely text behind ``span`` (lower case), or ``span`` if nothing is left of it."""
        if len(span) > 64:
            return self._search(span)
        if span not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[span] = self._search(span)
        return self.known[span]

    def _search(self, span: str) -> str:
        runs: list[list] = []
        for ch in span:
            ch = " " if ch.isspace() else ch
            if runs and runs[-1][0] == ch:
                runs[-1][1] += 1
            else:
                runs.append([ch, 1])
        widths = {n for ch, n in runs if ch == " "}
        few = sum(n for ch, n in runs if ch != " ") <= 3
        # (score, way back) for each state of three codes; a way is (text, way before)
        best: dict = {(0, 0, 0): (0.0, None)}
        for k, (ch, n) in enumerate(runs):
            kept = -1.0
            if _letter(ch):
                options = [(ch, 0.0 if n == 1 else 1.0)] + ([(ch * 2, 0.0 if n == 2 else 1.0)] if n > 1 else [])
            elif ch == " ":
                # where both widths occur the wider one parts words
                wide = len(widths) > 1 and n > 1
                options, kept = [("", 3.0 if wide else 1.0 if few else 0.0)], 0.0 if wide or few else 4.0 if len(widths) > 1 else 2.0
            else:
                looks = LOOKS_LIKE.get(ch, "")
                options = [(x * m, 1.0 + m * 0.2) for x in looks for m in ((1, 2) if n > 1 else (1,))]
                options.append(("", 0.5 if ch in ".-_*#%&" else 6.0))
                after = k + 1 < len(runs) and (_letter(runs[k + 1][0]) or runs[k + 1][0] in LOOKS_LIKE)
                if ch not in LOOKS_LIKE and ch not in ".-_" or ch == "!" and not after or ch == "(" and not k:
                    kept = 0.0
                else:
                    kept = 1.0 if ch in ".-_" else 2.5
            step: dict = {}
            for state, (score, way) in best.items():
                for letters, cost in options:
                    a, s = state, score - cost
                    for letter in letters:
                        for byte in letter.encode(errors="replace"):
                            code = int(_CODE[byte])
                            s += self._step(*a, code)
                            a = (a[1], a[2], code)
                    if a not in step or step[a][0] < s:
                        step[a] = (s, (letters, way) if letters else way)
                if kept >= 0:
                    # the sign stands for itself: words end at it, and a number goes on at less cost
                    after_break = state[2] == 0
                    s = score - (min(kept, 0.5) if after_break else kept) + (0.0 if after_break else self._step(*state, 0))
                    a = state if after_break else (state[1], state[2], 0)
                    if a not in step or step[a][0] < s:
                        step[a] = (s, (" " if ch == " " else ch * n, way))
            best = dict(sorted(step.items(), key=lambda x: -x[1][0])[:64]) if len(step) > 64 else step
        way = max(best.items(), key=lambda x: x[1][0] + (self._step(*x[0], 0) if x[0][2] else 0.0))[1][1]
        out = []
        while way:
            out.append(way[0])
            way = way[1]
        text = "".join(reversed(out))
        return span if not text or few and widths and not self._seen(text) else text

    def _seen(self, text: str) -> bool:
        """Do all 3-grams of the words of ``text`` occur in the documents?"""
        for word in text.split():
            code = [0, *(int(_CODE[b]) for b in word.encode(errors="replace")), 0]
            if any(self.three[(x * SYMBOLS + y) * SYMBOLS + z] <= 0 for x, y, z in zip(code, code[1:], code[2:])):
                return False
        return True


def _letter(ch: str) -> bool:
    """Letters, and whatever else is no ASCII character."""
    return ch.isalpha() or ch > "\x7f" and not ch.isspace()


@functools.cache
def _kinds() -> np.ndarray:
    """Per code point: 1 a letter, 2 a sign, 4 a separator; ASCII letters also tell which one they are."""
    out = np.frombuffer(bytes(chr(c).isalpha() for c in range(0x110000)), np.uint8).copy()
    out[[ord(c) for c in LOOKS_LIKE]] = 2
    out[[ord(c) for c in "._-"]] = 4
    for k in range(26):
        out[[0x41 + k, 0x61 + k]] = 1 + 8 * (k + 2)
    return out


def disguised(text: str) -> list[tuple[int, int]]:
    """Ranges of the spans to decode, ascending and disjoint."""
    if len(text) < 3:
        return []
    # kinds of the characters find the few places where the expressions need to look
    kind = _kinds()[np.frombuffer(text.encode("utf-32-le", errors="replace"), np.uint32)]
    letter, sign = kind & 1 > 0, kind & 2 > 0
    beside = np.zeros(len(kind), bool)
    beside[1:] = letter[:-1]
    lone = (letter | sign) & ~beside
    lone[:-1] &= ~letter[1:]
    at = np.flatnonzero(lone)
    near = np.flatnonzero(np.diff(np.concatenate([[0], (np.diff(at) <= 3).view(np.int8), [0]]))) if len(at) > 2 else np.zeros(0, int)
    found = []
    for m in (m for i, j in zip(near[::2].tolist(), near[1::2].tolist(), strict=True) if j - i > 1 for m in _APART.finditer(text, int(at[i]), int(at[j]) + 1)):
        units = [c for c in m[0] if c.isalpha() or c in LOOKS_LIKE]
        letters = sum(c.isalpha() for c in units)
        if len(set(units)) > 1 and 2 * letters >= len(units) and (len(units) > 3 or letters == len(units)):
            found.append(m.span())
    odd = sign | (kind & 4 > 0)
    marked = odd & beside
    marked[:-1] |= odd[:-1] & (letter | sign)[1:]
    marked[:-2] |= letter[:-2] & (kind[:-2] == kind[1:-1]) & (kind[:-2] == kind[2:]) & (kind[:-2] >= 16)
    end = 0
    for a in np.flatnonzero(marked).tolist():
        if a < end:
            continue
        b = a
        while a > end and not text[a - 1].isspace():
            a -= 1
        while b < len(text) and not text[b].isspace():
            b += 1
        end = b
        if _MARK.search(text, a, b) and sum(c.isalpha() or c in LOOKS_LIKE for c in text[a:b]) > 2:
            found.append((a, b))
    found.sort(key=lambda x: (x[0], -x[1]))
    out: list[tuple[int, int]] = []
    for a, b in found:
        if out and a < out[-1][1]:
            continue
        out.append((a, b))
    return out


def restored(data: np.ndarray, offsets: np.ndarray, decoder: Decoder) -> tuple[np.ndarray, np.ndarray]:
    """Texts with their disguised spans decoded."""
    raw, parts, sizes = data.tobytes(), [], [int(offsets[0])] if len(offsets) else []
    parts.append(raw[:sizes[0]] if sizes else raw)
    for first, last in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        piece = raw[first:last]
        text = piece.decode(errors="replace")
        if spans := disguised(text):
            words, at = [], 0
            for a, b in spans:
                span = text[a:b].lower()
                word = decoder.decode(span)
                words += (text[at:a], text[a:b] if word == span else word)
                at = b
            piece = ("".join(words) + text[at:]).encode(errors="replace")
        parts.append(piece)
        sizes.append(len(piece))
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(sizes).astype(offsets.dtype)


# ---------------------------------------------------------------- n-grams of the restored text

def _grams(data: np.ndarray, offsets: np.ndarray):
    """(folded text with a blank around each row, row starts, per length: bins and validity)."""
    text = np.insert(folded(data), offsets, 0x20)
    starts = offsets + np.arange(len(offsets))
    blank = np.concatenate([[0], np.cumsum(text == 0x20)])
    out = []
    for n in GRAMS:
        m = len(text) - n + 1
        if m <= 0:
            continue
        h = np.zeros(m, np.uint64)
        for i in range(n):
            h = h * U64(0x100000001B3) + text[i:i + m].astype(U64) + U64(1)
        inner = blank[n - 1:n - 1 + m] - blank[1:1 + m] == 0
        out.append((((h * U64(0x9E3779B97F4A7C15)) >> U64(44)).astype(np.int64), inner))
    return text, starts, out


def evidence(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sum over words of each word's heaviest n-gram, words) per text."""
    rows = len(offsets) - 1
    text, starts, grams = _grams(data, offsets)
    heavy = np.zeros(len(text), np.float32)
    for bins, inner in grams:
        w = weights[bins]
        w[~inner] = 0
        np.maximum(heavy[:len(w)], w, out=heavy[:len(w)])
    blank = text == 0x20
    first = np.flatnonzero(blank[:-1] & ~blank[1:])
    if not len(first):
        return np.zeros(rows), np.zeros(rows, np.int64)
    score = np.maximum.reduceat(heavy, first)
    row = np.searchsorted(starts, first, side="right") - 1
    return np.bincount(row, weights=score, minlength=rows)[:rows], np.bincount(row, minlength=rows)[:rows]


class Model:
    """Weights of n-grams and the curve from evidence to a score."""

    def __init__(self, texts: pa.Array, toxic: np.ndarray, decoder: Decoder):
        self.weights, self.curve = np.zeros(BINS, np.float32), np.array([-50.0, 0.0, 0.0])
        positive, negative = int((toxic == 1).sum()), int((toxic == 0).sum())
        if not positive or not negative:
            return
        seen = np.zeros((2, BINS), np.int64)
        table, parts, base = pa.table({"text": texts}), [], 0
        for part in chunks(table, "text"):
            data, offsets = restored(*text_buffers(part.column("text")), decoder)
            y = toxic[base:base + part.num_rows]
            base += part.num_rows
            parts.append((data, offsets))
            _, starts, grams = _grams(data, offsets)
            for bins, inner in grams:
                at = np.flatnonzero(inner)
                row = np.searchsorted(starts, at, side="right") - 1
                ok = row < len(y)
                pairs = np.unique(row[ok] * BINS + bins[at[ok]])
                row, bins = pairs // BINS, pairs % BINS
                for label in (0, 1):
                    seen[label] += np.bincount(bins[y[row] == label], minlength=BINS)
        odds = np.log((seen[1] + 0.5) / (positive + 1)) - np.log((seen[0] + 0.5) / (negative + 1))
        known = (odds > 2.0) & (seen[1] >= max(3, positive // 400))
        self.weights[known] = odds[known]
        found = [evidence(d, o, self.weights) for d, o in parts]
        self.curve = _logistic(_features(np.concatenate([x for x, _ in found]), np.concatenate([n for _, n in found])), toxic)

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        x = _features(*evidence(data, offsets, self.weights))
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + x @ self.curve[1:], -50, 50)))


def _features(total: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.stack([np.log1p(total), np.log1p(100 * total / np.maximum(words, 20))], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton's method for logistic regression with classes weighted alike and a small ridge."""
    x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    b = np.zeros(x.shape[1])
    penalty = ridge * len(y) * np.diag([0.0] + [1.0] * (x.shape[1] - 1)) * 1e-2
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -40, 40)))
        g = x.T @ (weight * (p - y)) + penalty @ b
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + penalty + 1e-6 * np.eye(len(b))
        step = np.linalg.solve(h, g)
        b -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return b


# ---------------------------------------------------------------- Spark

def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[Decoder, Model]:
    """Language model over all ``docs``; weights from at most about ``rows`` labelled texts, half of each kind."""
    decoder = Decoder(*language_model(docs))
    known = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    rate = F.when(F.col("toxic") == 1, min(1.0, rows / 2 / max(1, counts.get(1, 0)))).otherwise(min(1.0, rows / 2 / max(1, counts.get(0, 0))))
    known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < rate * 1_000_000)
    # at most about ``rows`` ids and labels: 12 bytes each
    sample = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(known), "doc_id").select("text", "toxic").toArrow()
    texts = sample.column("text").combine_chunks() if sample.num_rows else pa.array([], pa.string())
    return decoder, Model(texts, np.asarray(sample.column("toxic")).astype(np.int64), decoder)


def toxicity(docs: DataFrame, decoder: Decoder, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    shared = docs.sparkSession.sparkContext.broadcast((decoder.three, decoder.four, model))

    def run(batches):
        three, four, fitted = shared.value
        own = Decoder(three, four)
        for batch in batches:
            for part in chunks(batch, "text"):
                score = fitted.score(*restored(*text_buffers(part.column("text")), own))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32))],
                                                 names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return toxicity(docs, *train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
