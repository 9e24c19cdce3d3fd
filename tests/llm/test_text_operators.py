"""The text operators against brute force on small fixtures with awkward rows: nulls, empty and long
texts, ties, repeated rows, empty tables, extra columns whose names clash."""

import hashlib
import re
import zlib
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from haze.llm import decontaminate, language_id, licenses, near_dedup, packing, substring_dedup
from haze.llm import token_file, tokens, toxicity, vector_search, wrappers
from haze.llm.common import Words, NOT_SPACE, materialize, pack, pack_bits, text_buffers, unpack, unpack_bits, window_hashes

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def prose(rng, n, words=400):
    return " ".join(f"w{int(x)}" for x in rng.integers(0, words, n))


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(3)
    base = prose(rng, 60, 5000)
    passage = prose(rng, 25, 5000)
    out = [None, "", "  \n\t ", "one", "Two words", base, base, base.upper(), base + " tail", "x " * 40]
    out += [f"{prose(rng, 20, 5000)} {passage}  {prose(rng, 12, 5000)}" for _ in range(6)]
    changed = base.split()
    for i in (3, 30):
        edited = changed[:]
        edited[i] = "changed"
        out.append(" ".join(edited))
    out += [prose(rng, 4000, 5000), "é è " + passage, "ÄÖ ß", "a a a a a a a a a a a a a a a a"]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i * 3 % 101 + i, t, "n", 7) for i, t in enumerate(texts)]
    rows += [rows[5], (None, texts[5], "n", 7), (rows[8][0], "another text of that id", "n", 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words string, `__g` int")


def rows_of(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def test_helpers_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 1000):
        v = rng.integers(0, 1 << 62, n).astype(np.uint64)
        assert np.array_equal(unpack(pack(v)), v)
        assert np.array_equal(unpack(pack(np.sort(v), ascending=True)), np.sort(v))
        bits = rng.random(n) < 0.5
        assert np.array_equal(unpack_bits(pack_bits(bits)), bits)


def test_words_and_windows_match_regex():
    t = ["", "a", " a  bb\tc ", "é è", None, "x"]
    data, offsets = text_buffers(pa.array(t))
    w = Words(data, offsets, NOT_SPACE)
    want = [SPACED.findall(x or "") for x in t]
    got = [data[a:b].tobytes().decode() for a, b in zip(w.start, w.end)]
    assert got == [x for ws in want for x in ws] and w.count.tolist() == [len(x) for x in want]
    data, offsets = text_buffers(pa.array(["a b c a b", "b c a b c"]))
    w = Words(data, offsets, NOT_SPACE)
    h = window_hashes(w.hashes(), 2)
    assert h[0] == h[3] == h[7] and len({int(h[0]), int(h[1]), int(h[2])}) == 3


def brute_removed(rows, window):
    least = {}
    parsed = [(d, SPACED.findall(t or "")) for d, t in rows]
    for d, ws in parsed:
        for i in range(len(ws) - window + 1):
            k = tuple(ws[i:i + window])
            least[k] = min(least.get(k, float("inf")), float("inf") if d is None else d)
    out = []
    for d, ws in parsed:
        gone = set()
        for i in range(len(ws) - window + 1):
            if least[tuple(ws[i:i + window])] < (float("inf") if d is None else d):
                gone.update(range(i, i + window))
        kept = " ".join(w for i, w in enumerate(ws) if i not in gone)
        out.append((d, len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest(), longest_repeat(parsed, window)[d, tuple(ws)]))
    return sorted(out, key=repr)


@lru_cache
def _longest(parsed, window):
    out, length = dict.fromkeys(parsed, 0), window
    while True:
        holders = {}
        for d, ws in parsed:
            for i in range(len(ws) - length + 1):
                holders.setdefault(ws[i:i + length], set()).add(d)
        found = [(d, ws) for d, ws in parsed if any(len(holders[ws[i:i + length]]) > 1 for i in range(len(ws) - length + 1))]
        if not found:
            return out
        out.update(dict.fromkeys(found, length))
        length *= 2


def longest_repeat(parsed, window):
    return _longest(tuple((d, tuple(ws)) for d, ws in parsed), window)


@pytest.mark.parametrize("window", [13, 2])
def test_substring_dedup(docs, window):
    got = sorted((tuple(r) for r in substring_dedup.digest(docs, window).collect()), key=repr)
    assert got == brute_removed(rows_of(docs), window)


def test_substring_levels_double_until_none_survives(spark):
    t = " ".join(f"w{i}" for i in range(60))
    found = substring_dedup.RepeatedWindows(spark.createDataFrame([(1, t), (2, t + " x"), (3, "y " + t)], "doc_id long, text string"), 13)
    assert found.levels == 2   # repeated at 26 and at 52 words; no text has 104


def test_longest_repeat_counts_documents_not_rows(spark):
    """Rows of one id lie in several buckets; only another id makes a window a repeated one."""
    t = [f"w{i}" for i in range(70)]
    rows = [(1, " ".join(t)), (1, "a " + " ".join(t)), (2, " ".join(t[20:50])), (3, "x " * 40), (4, "x " * 29), (None, " ".join(t[:13])), (None, "b " + " ".join(t[:13]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in substring_dedup.digest(df.repartition(5)).collect()), key=repr)
    assert got == brute_removed(rows, 13)
    assert [r[4] for r in got] == [26, 26, 26, 26, 26, 13, 13]


def test_remove_repeats_keeps_columns_and_untouched_texts(docs):
    out = substring_dedup.remove_repeats(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    whole = {d: h for d, _, n, h, _ in brute_removed(rows_of(docs), 13) if not n}
    plain = {}
    for r in docs.collect():
        plain.setdefault(r.doc_id, []).append(r.text)
    for r in out.collect():
        if r.doc_id in whole and len(plain[r.doc_id]) == 1:
            assert r.text == plain[r.doc_id][0]


def brute_contamination(rows, items):
    out = []
    for d, t in rows:
        ws = ALNUM.findall(lowered(t))
        hit, found = set(), set()
        for item, text in items:
            iw = ALNUM.findall(lowered(text))
            m = min(13, len(iw))
            wins = {tuple(iw[i:i + m]) for i in range(len(iw) - m + 1)} if m else set()
            for i in range(len(ws) - m + 1) if m else []:
                if tuple(ws[i:i + m]) in wins:
                    hit.update(range(i, i + m))
                    if item is not None:
                        found.add(item)
        out.append((d, len(ws), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(ws)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_decontamination(spark, docs, texts, most):
    words = texts[5].split()
    items = [(1, " ".join(words[3:30])), (2, " ".join(words[10:14]) + "!"), (3, None), (4, ""), (None, texts[10][-40:]),
             (5, "ONE"), (6, " ".join(words[:12])), (1, texts[12]), (7, "nothing like it is here at all in any of those texts ever")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(docs, bench, max_sent=most)
    assert set(docs.columns) < set(got.columns)
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.item_ids, r.contaminated) for r in got.collect()), key=repr)
    assert got == brute_contamination(rows_of(docs), items)
    none = decontaminate.contamination(docs, bench.limit(0), max_sent=most)
    assert none.where("n_hit > 0 or contaminated").count() == 0 and none.count() == docs.count()
    assert decontaminate.drop_contaminated(docs, bench).columns == docs.columns


def test_winnowing_guarantee():
    rng = np.random.default_rng(5)
    for _ in range(200):
        shared = rng.integers(0, 1 << 60, 13).astype(np.uint64)
        a, b = (np.concatenate([rng.integers(0, 1 << 60, rng.integers(0, 30)).astype(np.uint64), shared,
                                rng.integers(0, 1 << 60, rng.integers(0, 30)).astype(np.uint64)]) for _ in range(2))
        prints = [set(decontaminate.fingerprints(x, np.zeros(len(x), int))[1].tolist()) for x in (a, b)]
        assert prints[0] & prints[1]


def brute_components(rows, percent):
    sets = {}
    for d, t in rows:
        ws = SPACED.findall(lowered(t))
        s = frozenset(tuple(ws[i:i + 5]) for i in range(max(1, len(ws) - 4))) if ws else frozenset()
        sets.setdefault(d, []).append(s)
    root = {d: d for d in sets if d is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(root, 2):
        if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    out = []
    for d, all_sets in sets.items():
        for s in all_sets:
            own = d if d is None or not s else min(x for x in root if find(x) == find(d))
            out.append((d, len(s), own, d is None or own == d))
    return sorted(out, key=repr)


@pytest.mark.parametrize("percent,short", [(85, 32), (60, 32), (60, 1)])
def test_near_duplicates(monkeypatch, docs, percent, short):
    monkeypatch.setattr(near_dedup, "SHORT", short)
    got = sorted((tuple(r) for r in near_dedup.near_duplicates(docs, percent).collect()), key=repr)
    assert got == brute_components(rows_of(docs), percent)


def test_near_duplicates_in_blocks(monkeypatch, spark):
    """A crowd of variants, met in many small blocks, gives the components of all pairs."""
    monkeypatch.setattr(near_dedup, "SHORT", 2)
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    rng = np.random.default_rng(9)
    base = prose(rng, 120, 5000).split()
    rows = []
    for i in range(40):
        w = base[:]
        for j in rng.integers(0, len(w), rng.integers(0, 6)):
            w[j] = f"edit{rng.integers(0, 9)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in near_dedup.near_duplicates(df, 85).collect()), key=repr)
    assert got == brute_components(rows, 85)


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 50), (100, 60), (7, 7)]
    got = {r.node: r.component for r in near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 50: 50, 60: 50, 100: 50}


HARD = ["", None, " ", "a", "  a  b ", "a\n\n b\t\tc ", "don't you're IT'S 'll 's", "x  y \n z 　 w", "été  à",
        "é é!", "<|endoftext|> <|startoftext|>", "ΣΑΣ İstanbul", "日本 語。a", "a\x85 b\x1c c", "ﬁne",
        "a" * 3000, "   \n  a", "U.S.A.,(x)--y", "1a2b 3.14"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_whole_texts(monkeypatch, texts, name):
    monkeypatch.setattr(tokens, "MAX_PIECES", 50)
    enc = tokens.Encoder(public_tokenizers.path(name))
    for part in (HARD, texts, HARD):
        ids, counts = enc.encode(pa.array(part))
        want = [enc.tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for t in part]
        assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [x for w in want for x in w]


@pytest.mark.parametrize("n", [0, 1, 1023, 1024, 1025, 140_000])
def test_rans_round_trip_and_checkpoints(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n), 50_000).astype(np.int64)
    coder = token_file.Coder(token_file.scaled(np.bincount(ids, minlength=50_257)))
    block = coder.encode(ids, 1)
    assert np.array_equal(coder.decode(block), ids)
    if n > 131_072:
        assert np.array_equal(coder.decode(block, 1), ids[131_072:])
        assert np.array_equal(coder.decode(block, 0, 1), ids[:131_072])
    if n:
        with pytest.raises(ValueError):
            coder.decode(block[:-1] + bytes([block[-1] ^ 1]))


def test_token_file(spark, docs, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    out = str(tmp_path / "tokens")
    token_file.write_tokens(docs, path, out, block_ids=500)
    got = sorted((tuple(r) for r in token_file.read_tokens(spark, out).collect()), key=lambda r: r[1])
    t = Tokenizer.from_file(path)
    want = {}
    for d, text in rows_of(docs):
        a = np.array(t.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        want.setdefault(d, []).append((len(a), zlib.crc32(a.tobytes())))
    assert [r[0] for r in got] == sorted((d for d, _ in rows_of(docs)), key=lambda d: -1 if d is None else d)
    start = 0
    for d, s, n, crc in got:
        assert s == start and (n, crc) in want[d]
        start += n
    assert spark.read.parquet(f"{out}/blocks").count() > 3
    empty = str(tmp_path / "none")
    token_file.write_tokens(docs.limit(0), path, empty)
    assert token_file.read_tokens(spark, empty).count() == 0


def test_token_file_counts_ids_as_it_tokenizes(spark, docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    vocabulary, _ = token_file.sizes(path)
    parts = materialize(token_file.tokenized(docs, path, 3))
    t = Tokenizer.from_file(path)
    want = np.zeros(vocabulary, np.int64)
    for _, text in rows_of(docs):
        np.add.at(want, t.encode(text or "", add_special_tokens=False).ids + [2], 1)
    # the ids themselves are not read again
    assert token_file.id_counts(parts.drop("ids"), vocabulary).tolist() == want.tolist()
    assert parts.where("row is not null").count() == len(rows_of(docs))
    assert parts.where("row is null and ids is null").count() == parts.select("part").distinct().count() > 1
    assert not token_file.id_counts(parts.limit(0), vocabulary).any()


def test_packing(spark, docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    got = [tuple(r) for r in packing.pack(docs, path, window=256, shard_tokens=3000).collect()]
    t = Tokenizer.from_file(path)
    left = {}
    for d, text in rows_of(docs):
        a = np.array(t.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        left.setdefault((d, len(a)), []).append(a)
    total = sum(len(a) for x in left.values() for a in x)
    assert sum(p[2] for p in got) == total
    for d, start, length, crc, n, _, _ in got:
        assert any(zlib.crc32(a[start:start + length].tobytes()) == crc for a in left[(d, n)])
    for (d, n), copies in left.items():
        covered = sorted(x for p in got if (p[0], p[4]) == (d, n) for x in range(p[1], p[1] + p[2]))
        assert covered == sorted(list(range(n)) * len(copies))
    used = {}
    for p in got:
        used.setdefault(p[5], []).append((p[6], p[2]))
    for pieces in used.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == 256 or at & (at - 1) == 0
    assert packing.pack(docs.limit(0), path).count() == 0


def test_packing_prefers_lexical_neighbours():
    rng = np.random.default_rng(2)
    topics = [rng.integers(100 * k, 100 * k + 90, (6, 40)) for k in range(1, 5)]
    docs = [d.astype(np.int64) for row in zip(*topics) for d in row]
    packer = packing.Packer(0, 256)
    packer.shard(list(range(len(docs))), docs, np.ones(1 << 16), 40.0)
    first = [p[0] for p in packer.pieces if p[5] == 0]
    assert len({d % 4 for d in first[:6]}) == 1


def test_vector_search(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((600, 16)).astype(np.float32)
    rows = [(i, v.tolist(), 0, "x") for i, v in enumerate(x)]
    rows += [(1000, x[0].tolist(), 0, "x"), (1020, None, 0, "x"), (1040, [0.0] * 16, 0, "x"), (1060, [float("nan")] * 16, 0, "x"),
             (1080, [1.0, None] * 8, 0, "x"), (1100, [float("inf")] * 16, 0, "x"), (None, x[1].tolist(), 0, "x"), (1120, [1.0], 0, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, list string")
    got = vector_search.nearest(df, "vec_id % 20 = 0", probes=1.0).collect()
    ids = np.array([*range(600), 1000])
    m = np.concatenate([x, x[:1]]).astype(np.float64)
    hit = total = 0
    for q in {r.query_id for r in got}:
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        s = m @ m[np.flatnonzero(ids == q)[0]]
        s[ids == q] = -np.inf
        want = ids[np.lexsort((ids, -s))[:20]]
        hit += len(set(want.tolist()) & {r.vec_id for r in mine})
        total += 20
        assert [r["rank"] for r in mine] == list(range(1, 21))
        for r in mine:
            assert abs(r.score - s[np.flatnonzero(ids == r.vec_id)[0]]) < 1e-12
    assert {r.query_id for r in got} == {*range(0, 600, 20), 1000} and hit / total >= 0.9
    few = vector_search.nearest(df.where("vec_id < 3"), "vec_id = 0").collect()
    assert sorted(r["rank"] for r in few) == [1, 2]
    assert vector_search.nearest(df.limit(0), "true").count() == 0


def test_vector_ties_and_hot_vector(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "PART_ROWS", 16)
    rng = np.random.default_rng(6)
    hot = rng.standard_normal(8)
    rows = [(i, hot.tolist()) for i in range(100)] + [(i, rng.standard_normal(8).tolist()) for i in range(100, 140)]
    got = vector_search.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id = 60").collect()
    assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"])] == list(range(20))


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(8)
    words = {"en": "the and with house river stone green walk over under", "de": "und der nicht haus fluss stein gehen über unter wald",
             "fr": "le la avec maison rivière pierre vert marche sur sous", "es": "el los con casa río piedra verde camino sobre bajo"}
    rows, labels = [], []
    for i in range(800):
        lang = list(words)[i % 4]
        w = list(rng.choice(words[lang].split(), 30))
        bad = i % 5 == 0
        if bad:
            w[3], w[17] = "idiotic", "scumbag"
        rows.append((i, " ".join(w), lang, "s"))
        labels.append((i, 1, int(bad)))
    rows += [(2000, None, "en", "s"), (2001, "", "en", "s"), (2002, "12 34 !!", "en", "s"), (None, "the and with river", "en", "s")]
    return (spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"),
            spark.createDataFrame(labels + [(0, 1, 0), (5000, 1, None)], "doc_id long, quality int, toxic int"))


def test_language_id(labelled):
    docs, _ = labelled
    rows = docs.withColumn("lang_score", docs.lang)
    out = language_id.languages(rows, language_id.train(docs)).collect()
    known = [r for r in out if r.doc_id is not None and r.doc_id < 2000]
    held = [r for r in known if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.97
    assert {r.doc_id: (r.lang_pred, r.lang_score) for r in out if r.doc_id and r.doc_id >= 2000} == {k: ("und", 0.0) for k in (2000, 2001, 2002)}
    assert all(0 <= r.lang_score <= 1 for r in out)
    none = language_id.languages(docs, language_id.train(docs.limit(0)))
    assert {r.lang_pred for r in none.collect()} == {"und"}
    one = docs.where("lang = 'de'")
    assert {r.lang_pred for r in language_id.languages(one, language_id.train(one)).collect()} == {"de"}


def test_prediction_does_not_depend_on_neighbours(labelled):
    docs, _ = labelled
    model = language_id.train(docs)
    texts = ["the and with", "und der nicht", "", "le la avec"]
    together = model.predict(*text_buffers(pa.array(texts)))
    apart = [model.predict(*text_buffers(pa.array([t]))) for t in texts]
    assert together[0] == [a[0][0] for a in apart] and np.allclose(together[1], [a[1][0] for a in apart])


def test_toxicity(labelled):
    docs, labels = labelled
    decoder, model = toxicity.train(docs, labels)
    out = {r.doc_id: r for r in toxicity.toxicity(docs, decoder, model).collect()}
    held = [r for r in out.values() if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out.values() if r.doc_id is not None)
    assert sum(r.predicted == (r.doc_id % 5 == 0) for r in held if r.doc_id < 2000) / len(held) > 0.95
    assert out[2000].predicted == out[2001].predicted == 0 and 0 <= out[2000].score <= 1
    for t in ("the 1d10tic and sc*mbag with scumb4g", "i d i o t i c the scuuumbag and"):
        score = model.score(*toxicity.restored(*text_buffers(pa.array([t])), decoder))[0]
        assert score >= 0.7, t
    _, blank = toxicity.train(docs, labels.limit(0))
    assert blank.score(*text_buffers(pa.array(["idiotic scumbag", ""]))).max() < 0.01


def test_restoring_leaves_plain_text(labelled):
    docs, labels = labelled
    decoder, _ = toxicity.train(docs, labels)
    t = ["plain words, stay as they are.", "", "a b c", "12:30 2024-01-02"]
    data, offsets = toxicity.restored(*text_buffers(pa.array(t)), decoder)
    assert [data[a:b].tobytes().decode() for a, b in zip(offsets[:-1], offsets[1:])] == t


def test_restoring_every_shape(labelled):
    """Signs at the end, separators inside, long words, long or wide or short runs of single letters, other letters."""
    docs, labels = labelled
    decoder, _ = toxicity.train(docs, labels)
    spaced = "the river and the idiotic scumbag with the stone house"
    shapes = {
        "scumba9": "scumbag", "idioti(": "idiotic", "ston3": "stone", "1d10ti(": "idiotic",
        "id.iot.ic": "idiotic", "s-c-umbag": "scumbag", "idi_otic": "idiotic",
        "the/and/with/house/river/stone/green/walk/1d10tic/scumb4g": "the/and/with/house/river/stone/green/walk/idiotic/scumbag",
        " ".join(spaced.replace(" ", "")): None, "  ".join(" ".join(w) for w in spaced.split()): spaced,
        "s  c  u  m  b  a  g": "scumbag", "r i v i è r e": "rivière", "u n d": "und", "m a i s o n": "maison",
    }
    data, offsets = toxicity.restored(*text_buffers(pa.array(list(shapes))), decoder)
    got = [data[a:b].tobytes().decode() for a, b in zip(offsets[:-1], offsets[1:])]
    for (given, want), found in zip(shapes.items(), got):
        assert found == want if want else found != given, given
    through = got[list(shapes).index(" ".join(spaced.replace(" ", "")))]
    assert "idiotic" in through and "scumbag" in through


def brute_blocks(words, threshold):
    """Templates that some run of words holds to ``threshold``, by trying every run."""
    found = set()
    for label, text in licenses.TEMPLATES:
        tw = ALNUM.findall(lowered(text))
        need, span = -(-threshold * len(set(tw)) // 1), -(-licenses.STRETCH * len(tw) // 1)
        for i in range(len(words)):
            if len(set(words[i:i + int(span)]) & set(tw)) >= need - 1e-9:
                found.add(label)
                break
    return found


def test_licenses(spark):
    rows = ["This is Released under the MIT License. Again: under the mit license", "apache license version 2", None, "", "cc-by-nc and CC BY NC",
            "this work is now licensed under the gnu general license version 3 today", "all your rights were reserved", "rights reserved all",
            "free software general public license", "x " * 300 + "Permission is hereby granted, free of charge, to any person who is obtaining a copy of software and associated files" + " y" * 300]
    docs = spark.createDataFrame([(i, t, "b") for i, t in enumerate(rows)], "doc_id long, text string, blocks string")
    out = {r.doc_id: r for r in licenses.license_blocks(docs).collect()}
    for i, t in enumerate(rows):
        words = ALNUM.findall(lowered(t))
        base = [(j, label) for p, label in licenses.PHRASES.items() for j in range(len(words))
                if tuple(words[j:j + len(p.split())]) == tuple(p.split())]
        assert sorted((b["start"], b["label"]) for b in out[i].base) == sorted(base)
        assert {b["label"] for b in out[i].blocks} == brute_blocks(words, licenses.THRESHOLD), (i, t)
        assert out[i].n_words == len(words)
    assert licenses.license_blocks(docs.limit(0)).count() == 0


def test_licenses_are_told_apart_by_their_names(spark):
    creative = "This work is licensed under a Creative Commons Attribution-{} International License"
    want = {
        "Released under the Apache License, Version 2.0": {"apache-2"}, "Released under the Foo License": set(), "Released under the MIT License": {"mit"},
        "Licensed under the Apache License, Version 2.0": {"apache-2"}, "Licensed under CC BY-SA 4.0": set(), "Licensed under CC BY 4.0": set(),
        "Licensed under CC BY-NC 4.0": {"cc-by-nc"}, creative.format("ShareAlike"): {"cc-by-sa"}, creative.format("NonCommercial"): {"cc-by-nc"},
        "Released under the Foo License. Released under the MIT License": {"mit"},
    }
    docs = spark.createDataFrame(list(enumerate(want)), "doc_id long, text string")
    found = licenses.license_blocks(docs).collect()
    assert {r.text: {b["label"] for b in r.blocks if b["decides"]} for r in found} == want
    # the join itself reports every block that meets the threshold
    for r in found:
        assert {b["label"] for b in r.blocks} == brute_blocks(ALNUM.findall(lowered(r.text)), licenses.THRESHOLD), r.text


def test_whole_license_texts(spark):
    """Each template is found in prose, also with words changed, and decides on its own label alone."""
    rng = np.random.default_rng(5)
    prose = [f"w{i}" for i in range(40)]
    rows, want = [], []
    for label, text in licenses.TEMPLATES:
        given = text.split()
        keep = set(ALNUM.findall(lowered(licenses.REQUIRED.get(label, ""))))
        for share in (0.0, 0.08):
            words = ["other" if len(given) > 20 and rng.random() < share and not keep & set(ALNUM.findall(lowered(w))) else w for w in given]
            rows.append((len(rows), " ".join([*prose, *words, *prose])))
            want.append(label)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for r in licenses.license_blocks(docs).collect():
        assert {b["label"] for b in r.blocks if b["decides"]} == {want[r.doc_id]}, (want[r.doc_id], r.blocks)
        assert {b["label"] for b in r.blocks} == brute_blocks(ALNUM.findall(lowered(r.text)), licenses.THRESHOLD)


def page(body, i, head=""):
    return f"<html><head><title>t{i}</title>{head}</head><body><nav><ul><li><a href='/'>home</a></li><li><a>x{i}</a></li></ul></nav>{body}<footer>&copy; {i}</footer></body></html>"


def test_wrappers(spark):
    rows = []
    for i in range(12):
        paragraphs = "".join(f"<p>Text {i} {j} a&amp;b <b>bold</b>" + ("</p>" if j % 2 else "") for j in range(i % 4 + 1))
        body = (f"<div class='ad'>buy {i}</div><div id='main'><h1>Title {i}</h1>{paragraphs}<script>var p='<p>no</p>'</script>"
                f"<form><p>mail {i}</p></form><aside>more {i}</aside></div><div class='comments'><p>I disagree {i} with all of this</p></div>")
        rows.append((i, f"https://h.example/{i}", page(body, i)))
    rows += [(50, "https://empty.example", ""), (51, None, None), (52, "https://cut.example", "<html><body><article><p>cut &lt;off <b"), rows[3]]
    got = {}
    for r in wrappers.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        got.setdefault(r.page_id, []).append((r.text, r.n_chars))
    for i in range(12):
        want = "\n".join([f"Title {i}"] + [f"Text {i} {j} a&b bold" for j in range(i % 4 + 1)])
        assert set(got[i]) == {(want, len(want))}, i
    assert got[50] == got[51] == [("", 0)] and got[52] == [("cut <off", 8)] and len(got[3]) == 2


def test_wrapper_expression():
    pages = ["<ul><li>a</li><li>b</li></ul><p>same</p>", "<ul><li>c</li></ul><p>same</p><hr><div>x</div>", "<ul><li>d</li><li>e</li><li>f</li></ul><p>same</p>"]
    text = wrappers.expression(wrappers.infer(pages))
    assert text == '<ul> (<li> #text </li>)+ </ul> <p> "same" </p> (<div> "x" </div>)?'


def test_wrappers_of_several_layouts(spark):
    """All pages take part, each layout has its own wrapper, and shared blocks inside a container are left out."""
    rows, want = [], {}
    for i in range(150):
        said = [f"Words {i} {j} of the first layout" for j in range(i % 5 + 1)]
        rows.append((i, f"https://two.example/{i}", page(f"<div id='main'><h1>Title {i}</h1>{''.join(f'<p>{t}</p>' for t in said)}<p>Sign up for our letters today</p></div>", i)))
        want[i] = "\n".join([f"Title {i}", *said])
    for i in range(150, 160):
        said = f"The second layout says {i} at some length, and more than the first one"
        rows.append((i, f"https://two.example/{i}", page(f"<div id='main'></div><div id='story'><p>{said}</p><p>{said} again</p></div>", i)))
        want[i] = f"{said}\n{said} again"
    for i in range(160, 164):
        rows.append((i, f"https://gone.example/{i}", page("<div id='main'><p>This page has gone</p></div>", i)))
        want[i] = "This page has gone"
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = {r.page_id: r.text for r in wrappers.main_texts(pages).collect()}
    assert got == want


def test_shared_texts_that_are_no_boilerplate(spark):
    """Headings over text, table cells and the text of near copies stay, however many pages of a host share them."""
    rows, want = [], {}

    def add(host, html, *texts):
        want[len(rows)] = "\n".join(texts)
        rows.append((len(rows), f"https://{host}.example/{len(rows)}", html))

    for i in range(5):
        said = [f"Words {i} {j} that only this article has, some more of them too" for j in range(3)]
        add("headings", page(f"<div class='x1'><h1>Title {i}</h1><h2>Introduction</h2><p>{said[0]}</p><h2>Results</h2><h3>Figures</h3><table><tr><th>Year</th><th>Value</th></tr>"
                             f"<tr><td>2001</td><td>{i}</td></tr></table><h2>References</h2><p>{said[1]}</p><p>Sign up for our letters</p><h2>Read more</h2><p>Sign up for our letters</p></div>", i),
            f"Title {i}", "Introduction", said[0], "Results", "Figures", "Year", "Value", "2001", str(i), "References", said[1])
    for i in range(5):
        same = [f"Sentence {j} stands in all copies of this text, word for word" for j in range(4)]
        add("copies", page(f"<article><p>{same[0]}</p><p>{same[1]}</p><p>edited {i}</p><p>{same[2]}</p><p>{same[3]}</p></article>", i),
            same[0], same[1], f"edited {i}", same[2], same[3])
    got = {r.page_id: r.text for r in wrappers.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


@pytest.mark.parametrize("html", [
    "<body><p>Before</p><script>for(i=0;i<n;i++){f(i)}</script><p>After</p></body>",
    "<body><p>Before</p><SCRIPT>if(a<b){s='it'+\"'\"}</Script ><p>After</p></body>",
    "<body><p>Before</p><script>x='<!--'</script><p>After</p></body>",
    "<body><p>Before</p><style>a<b{content:\"'\"}</style><textarea><p a='</textarea><noscript><p>no</noscript><p>After</p></body>",
    "<html><head><title>t</title><meta charset=utf-8><body><p>Before</p><p>After</p>",
    "<html><head><title>t</title><script>1<2</script><p>Before</p><p>After</p>",
    "<body><p title=it's>Before</p><p>After</p></body>",
    "<body><p>Before</p><embed src=x><canvas><p>After</p></body>",
    "<body><p>Before</p><object><object>no</object>no</object><svg><style></svg></style><title>no</title></svg><p>After</p></body>",
])
def test_raw_text_and_open_heads(html):
    assert wrappers.Page.of(wrappers._Walk(html).events).select([]) == "Before\nAfter"


def test_furniture_words_that_name_no_furniture(spark):
    text = lambda i, j: f"Sentence {j} of page {i} is main text and has some length"
    shapes = {
        "class": lambda i: (f"<html><body class='single right-sidebar'><div class='nav'>menu {i}</div><p>{text(i, 0)}</p><p>{text(i, 1)}</p></body>", [0, 1]),
        "html": lambda i: (f"<html class='no-js has-header'><body><div id='x'><p>{text(i, 0)}</p></div><div class='sidebar'>also {i}</div></body></html>", [0]),
        "form": lambda i: (f"<body><form id='aspnetForm'><nav>menu {i}</nav><div id='c'><h1>{text(i, 0)}</h1><p>{text(i, 1)}</p></div><div class='footer'>end {i}</div></form></body>", [0, 1]),
        "slug": lambda i: (f"<body><article><div class='article-header'><h1>{text(i, 0)}</h1></div><h2 id='related-work'>{text(i, 1)}</h2><p>{text(i, 2)}</p><section id='social-history'>"
                           f"<h2 id='form-of-government'>{text(i, 3)}</h2><p>{text(i, 4)}</p></section><section id='comments'><p>I disagree {i}</p></section></article></body>", [0, 1, 2, 3, 4]),
        "only": lambda i: (f"<body><div class='widget'><p>{text(i, 0)}</p></div></body>", [0]),
    }
    rows, want = [], {}
    for h, (name, shape) in enumerate(shapes.items()):
        for i in range(10 * h, 10 * h + 5):
            html, kept = shape(i)
            rows.append((i, f"https://{name}.example/{i}", html))
            want[i] = "\n".join(text(i, j) for j in kept)
    got = {r.page_id: r.text for r in wrappers.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def test_common_subsequence_lengths():
    rng = np.random.default_rng(2)
    for _ in range(20):
        p, q = (list(map(str, rng.integers(0, 4, rng.integers(0, 12)))) for _ in range(2))
        common = wrappers._common(p, q)
        table = [[0] * (len(q) + 1) for _ in range(len(p) + 1)]
        for i in range(len(p) - 1, -1, -1):
            for j in range(len(q) - 1, -1, -1):
                table[i][j] = table[i + 1][j + 1] + 1 if p[i] == q[j] else max(table[i + 1][j], table[i][j + 1])
        assert all(common(i, j) == table[i][j] for i in range(len(p) + 1) for j in range(len(q) + 1))


def test_pipeline_on_awkward_rows(spark, tmp_path, texts):
    import corpus_pipeline
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, " ".join(texts[10].split()[:30]))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.materialize(stage(spark, docs, str(tmp_path)))
        kept.append([(r.doc_id, r.text) for r in docs.collect()] if "text" in docs.columns else None)
        if kept[-1] is not None:
            assert docs.columns == before.columns
    assert {d for d, _ in kept[0]} == {i for i, t in enumerate(texts) if re.search(r"[^\W\d_]", t or "")}
    components = brute_components(kept[0], 80)
    assert {d for d, _ in kept[1]} == {d for d, _, own, _ in components if own == d}
    removed = {d: h for d, _, _, h, _ in brute_removed(kept[1], 13)}
    assert {d: hashlib.sha256(" ".join(SPACED.findall(t)).encode()).hexdigest() for d, t in kept[2]} == removed
    bad = {r[0] for r in brute_contamination(kept[2], [(1, " ".join(texts[10].split()[:30]))]) if r[4]}
    assert bad and {d for d, _ in kept[3]} == {d for d, _ in kept[2]} - bad
    assert {r.doc_id for r in docs.collect()} == {d for d, _ in kept[3]}
