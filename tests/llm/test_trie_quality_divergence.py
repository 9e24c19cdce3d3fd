"""The prefix trie, the quality rules and the source audit against brute force on small awkward tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from haze.llm import divergence, prefix_trie, quality

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
LETTERS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


# ---------------------------------------------------------------- trie

def brute_trie(rows):
    """rows: (conv_id, turn, role, text), no two of a conversation with one turn."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [x[1:] for x in sorted(v)] for c, v in own.items()}
    seq = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(np.fmod(c, 5))
        seq[c] = own.get(base, [])[:h] + v[h:]
    members = defaultdict(list)
    for c, v in seq.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    kids = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids[k]
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1].encode()) if k else 0
    out = []
    for k, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in m if len(seq[c]) == len(k)))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations(rng, n, most):
    rows = []
    for c in range(n):
        for turn in range(int(rng.integers(0, most))):
            rows.append((c, turn if turn else None, [None, "user", "assistant"][turn % 3], [None, "", "é", f"t{int(rng.integers(3))}"][int(rng.integers(4))]))
    return rows


_CONV = "conv_id long, turn long, role string, text string, place int, `digest` string"


def as_conversations(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], _CONV)


@pytest.mark.parametrize("options", [{}, {"max_cells": 64}, {"cells_each": 64}])
def test_trie_against_brute_force(spark, options):
    rng = np.random.default_rng(4)
    rows = conversations(rng, 60, 12) + [(-c, t, "user", f"n{t % 2}") for c in range(1, 12) for t in range(c)]
    rows += [(None, 1, "user", "none")] + [(c, t, "user", "copy") for c in (100, 105, 110, 115) for t in range(20)]
    got = sorted((tuple(r) for r in prefix_trie.trie(as_conversations(spark, rows), **options).collect()), key=repr)
    assert got == brute_trie(rows)


def test_trie_of_long_conversations_and_copies(spark):
    long = [(c, t, "user", f"w{t}") for c in (0, 5, 10) for t in range(200)]
    long += [(15, t, "user", f"w{t if t < 130 else -t}") for t in range(400)] + [(20, 0, "user", "alone")]
    got = sorted((tuple(r) for r in prefix_trie.trie(as_conversations(spark, long)).collect()), key=repr)
    assert got == brute_trie(long)


def test_trie_deep_nesting_of_paths(spark):
    """Each conversation leaves the one before it one turn later: paths nest as deep as there are conversations."""
    rows = [(5 * c, t, "u", "same" if t < c + 8 else f"own{c}") for c in range(12, -1, -1) for t in range(c + 10)]
    got = sorted((tuple(r) for r in prefix_trie.trie(as_conversations(spark, rows)).collect()), key=repr)
    assert got == brute_trie(rows)


def test_trie_of_nothing_and_repeated_rows(spark):
    assert prefix_trie.trie(as_conversations(spark, [])).collect() == []
    assert prefix_trie.trie(as_conversations(spark, [(None, 0, "u", "t")])).collect() == []
    rows = [(0, 0, "u", "a"), (0, 0, "u", "a"), (5, 0, "u", "a")]
    got = {(r.depth, r.n_convs) for r in prefix_trie.trie(as_conversations(spark, rows)).collect()}
    assert got == {(0, 2), (1, 2), (2, 1)}


def test_sketch_never_falls_below_the_truth(spark):
    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    for cells in (64, 1 << 14):
        for cell in prefix_trie.cells_of(hashes, cells):
            assert cell.min() >= 0 and cell.max() < cells
    a, b = prefix_trie.cells_of(hashes, 1 << 14)
    assert (a != b).mean() > 0.99 and len(np.unique(a)) > 2500


# ---------------------------------------------------------------- quality

def brute_measures(text):
    t = text or ""
    ws = SPACED.findall(t)
    lines = [x for x in t.split("\n") if SPACED.search(x)]
    windows = Counter(tuple(ws[i:i + 3]) for i in range(len(ws) - 2))
    hit = {p for i in range(len(ws) - 2) if windows[tuple(ws[i:i + 3])] > 1 for p in range(i, i + 3)}
    return (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), len(lines))


AWKWARD = [None, "", " \n\t", "one", "a\nb\na\n\na", "a a a a", "x y z x y z", "# $ é<b>", "\n", "a\n", "\na", "é ä\né ä\n é ä", "w " * 40]


def test_measures_against_brute_force(spark):
    rng = np.random.default_rng(2)
    texts = AWKWARD + ["".join(rng.choice(list("ab #\n\té"), int(rng.integers(0, 60)))) for _ in range(200)]
    texts += [" ".join(f"w{int(x)}" for x in rng.integers(0, 9, 3000))]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "row long, text string")
    got = {r.row: tuple(r[1:7]) for r in quality.measures(rows).collect()}
    assert got == {i: brute_measures(t) for i, t in enumerate(texts)}


def brute_verdicts(rows, min_docs, reach):
    def bucket(v):
        low = max(0, v.bit_length() - 7)
        return v >> low << low

    judged = []
    for k, lang, source, text in rows:
        n, chars, symbols, dup, repeats, lines = brute_measures(text)
        base = n < 50 or 100 * repeats > 50 * n
        judged.append((k, lang, source, base, {"word_length": 1000 * chars // max(n, 1), "symbols": 1000 * symbols // max(n, 1),
                                               "dup_lines": 1000 * dup // max(lines, 1), "repeats": 1000 * repeats // max(n, 1)}))
    held = defaultdict(list)
    for _, lang, source, base, rate in judged:
        if not base:
            for g in ((0, lang, source), (1, lang), (2,)):
                held[g].append(rate)
    out = {}
    for k, lang, source, base, rate in judged:
        g = next((g for g in ((0, lang, source), (1, lang), (2,)) if len(held[g]) >= (min_docs if g[0] < 2 else 1)), None)
        bad = set()
        for r in rate:
            if g is None:
                continue
            values = sorted(bucket(x[r]) for x in held[g])
            q25, q75 = values[-(-len(values) // 4) - 1], values[-(-3 * len(values) // 4) - 1]
            slack = reach * max(q75 - q25, quality.FLOORS[r])
            if rate[r] > q75 + slack or (r == "word_length" and rate[r] < q25 - slack):
                bad.add(r)
        out[k] = (base, not base and not bad, frozenset(bad))
    return out


@pytest.fixture(scope="module")
def mixed():
    rng = np.random.default_rng(6)
    rows = []
    for i in range(240):
        lang, source = ["en", "de", None][i % 3], ["a", "b", None, "rare"][0 if i % 2 else i // 60]
        ws = [f"w{int(x)}" * (3 if lang == "de" else 1) for x in rng.integers(0, 4000, int(rng.integers(40, 120)))]
        if i % 17 == 0:
            ws = [w + "$#" for w in ws]
        if i % 19 == 0:
            ws = ws[:30] + ["x\nsame line again\nsame line again\nsame line again\n"] + ws[30:]
        if i % 23 == 0:
            ws = [w * 9 for w in ws]
        rows.append((i, lang, source, " ".join(ws)))
    return rows + [(1000 + i, "en", "a", t) for i, t in enumerate(AWKWARD)] + [(2000, "en", "a", rows[1][3])]


@pytest.mark.parametrize("min_docs,reach", [(20, 3), (1, 1), (10_000, 2)])
def test_quality_against_brute_force(spark, mixed, min_docs, reach):
    docs = spark.createDataFrame([(*r, 1, "z") for r in mixed], "doc_id long, lang string, source string, text string, n_words int, `__row` string")
    got = {r.doc_id: (r.base_failed, r.kept, frozenset(r.reasons)) for r in quality.judge(docs, min_docs=min_docs, reach=reach).collect()}
    assert got == brute_verdicts(mixed, min_docs, reach)
    kept = quality.drop_low_quality(docs, min_docs=min_docs, reach=reach)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(k for k, v in got.items() if v[1])


def test_sketches_merge(spark, mixed):
    docs = spark.createDataFrame(mixed, "doc_id long, lang string, source string, text string")
    values = quality.Rules(docs).measured
    sketch = {(r.level, r.lang, r.source, r.rate, r.bucket): r.n for r in quality.sketches(values).collect()}
    merged = Counter()
    for (level, lang, _, rate, bucket), n in sketch.items():
        if level == 0:
            merged[lang, rate, bucket] += n
    assert merged == Counter({(lang, rate, b): n for (level, lang, _, rate, b), n in sketch.items() if level == 1})
    assert sum(n for k, n in sketch.items() if k[0] == 2) == 4 * len(mixed)


def test_quality_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, lang string, source string, text string")
    assert quality.judge(docs).collect() == [] and quality.drop_low_quality(docs).collect() == []


# ---------------------------------------------------------------- divergence

def brute_divergence(rows, min_docs, top=10):
    words = [(lang or "", source or "", LETTERS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))) for lang, source, text in rows]
    docs, count, langs = Counter(), defaultdict(Counter), defaultdict(Counter)
    for lang, source, ws in words:
        docs.update((lang, w) for w in set(ws))
    keep = defaultdict(set)
    for (lang, w), n in docs.items():
        if n >= min_docs:
            keep[lang].add(w)
    for lang, source, ws in words:
        count[lang, source].update(w for w in ws if w in keep[lang])
        langs[lang].update(w for w in ws if w in keep[lang])

    def share(c, w, v):
        return 1 + 10 ** 9 * (c[w] + 2) // (sum(c.values()) + 2 * v)

    f = lambda p, q: (p - q) ** 2 // (p + q)
    out = []
    for (lang, source), c in count.items():
        v = len(keep[lang])
        pairs = [(o, sum(f(share(c, w, v), share(count[lang, o], w, v)) for w in keep[lang])) for g, o in count if g == lang and o != source]
        terms = [(w, f(share(c, w, v), share(langs[lang], w, v))) for w in keep[lang] if c[w] and share(c, w, v) > share(langs[lang], w, v)]
        for part, items, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
            items.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, item, value, i + 1) for i, (item, value) in enumerate(items[:most])]
    return sorted(out)


@pytest.mark.parametrize("options", [{}, {"min_docs": 3, "bucket_terms": 7, "block_groups": 2}, {"min_docs": 1, "bucket_terms": 100}, {"min_docs": 500}])
def test_divergence_against_brute_force(spark, options):
    rng = np.random.default_rng(8)
    rows = [(["en", "de", None, "none"][i % 4 if i % 4 < 3 or i < 8 else 0], ["a", "b", "c", "Z", "é", None, ""][int(rng.integers(7))],
             " ".join("abcdefghéÄZ"[int(x) % 11] * (1 + int(x) % 3) for x in rng.zipf(1.3, 80) % 97)) for i in range(160)]
    rows += [("en", "empty", None), ("en", "empty", "12 3"), ("en", "a", "word " * 3000), rows[3], rows[3], ("en", "long", "Aa bB " * 50_000)]
    docs = spark.createDataFrame([(*r, "x", 5) for r in rows], "lang string, source string, text string, term string, n int")
    got = sorted(tuple(r) for r in divergence.divergence(docs, **options).collect())
    assert got == brute_divergence(rows, options.get("min_docs", 10))


def test_divergence_of_nothing(spark):
    docs = spark.createDataFrame([], "lang string, source string, text string")
    assert divergence.divergence(docs).collect() == []
    one = spark.createDataFrame([("en", "a", "x y"), ("en", "b", None)], "lang string, source string, text string")
    assert sorted(tuple(r) for r in divergence.divergence(one).collect()) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_bucket_pairs_large_blocks():
    """Levels of one bucket against a plain table of counts."""
    rng = np.random.default_rng(9)
    counts = rng.integers(0, 4, (5, 200)) * rng.integers(1, 3, (5, 200))
    share = lambda n, g: 10_000_000 * (n + 2) // (1000 + g) + 1
    rows = []
    for g in range(5):
        for n in np.unique(counts[g]):
            for word in range(4):
                ids = np.flatnonzero(counts[g] == n)
                bits = sum(1 << int(i % 64) for i in ids if i // 64 == word)
                if n and bits:
                    rows.append((g, word, bits, share(int(n), g)))
    source, word, bits, p = (np.array(x, np.uint64 if i == 2 else np.int64) for i, x in enumerate(zip(*rows)))
    p0 = np.array([share(0, g) for g in range(5)])
    value, joint = divergence.bucket_pairs(source, word, bits, p, p0)
    for g in range(5):
        for h in range(5):
            if g != h:
                used = (counts[g] > 0) | (counts[h] > 0)
                a, b = share(counts[g], g), share(counts[h], h)
                assert value[g, h] == ((a - b) ** 2 // (a + b))[used].sum()
                assert joint[g, h] == ((counts[g] > 0) & (counts[h] > 0)).sum()
