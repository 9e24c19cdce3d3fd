"""Uniform numbers from md5 hashes of texts, many at a time.

The JVM's ``md5`` hands back hex text, which ``conv`` and a cast turn into a number again; a task
that draws eight numbers a row spends most of its time there.  Here a column of key texts goes to
numpy once and all its draws come back: one array holds a word of every message.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of md5 (RFC 1321): additive constants, rotations and word order of its 64 steps.
_ADD = [np.uint32(int(abs(np.sin(i + 1.0)) * 2 ** 32)) for i in range(64)]
_TURN = [s for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in four * 4]
_WORD = [*range(16), *[(5 * i + 1) % 16 for i in range(16)], *[(3 * i + 5) % 16 for i in range(16)],
         *[7 * i % 16 for i in range(16)]]
_START = [np.uint32(v) for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
#: Bytes of a message that fit into one block of md5.
ONE_BLOCK = 55
#: Texts worked on together: the arrays stay in a core's cache.
CHUNK = 2048


def _first_words(words: list, shape: tuple) -> tuple[np.ndarray, np.ndarray]:
    """The first two state words of md5 for one-block messages; ``words[i]`` holds word i of all."""
    a, b, c, d = (np.full(shape, v) for v in _START)
    f, t = np.empty(shape, np.uint32), np.empty(shape, np.uint32)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.bitwise_not(d, out=f)
            f |= b
            f ^= c
        f += a
        f += _ADD[i]
        if words[_WORD[i]] is not None:
            f += words[_WORD[i]]
        np.right_shift(f, np.uint32(32 - _TURN[i]), out=t)
        f <<= np.uint32(_TURN[i])
        f |= t
        f += b
        a, d, c, b, f = d, c, b, f, a
    return a + _START[0], b + _START[1]


def _chunk_bits(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, prefixes: list[bytes]) -> np.ndarray:
    """First 48 bits of md5(prefix + text) of the texts at ``starts`` in ``data``, a row per prefix;
    all prefixes have one length, and the messages fit into a block."""
    n, p = len(starts), len(prefixes[0])
    block = np.zeros((n, 64), np.uint8)
    longest = int(sizes.max())
    if longest:
        at = np.arange(longest)
        inside = at < sizes[:, None]
        block[:, p:p + longest] = np.where(inside, data[np.where(inside, starts[:, None] + at, 0)], 0)
    block[np.arange(n), p + sizes] = 0x80
    shared = block.view("<u4").T.copy()
    shared[14] = (p + sizes) * 8
    words: list = [w if w.any() else None for w in shared]
    for i in range(-(-p // 4)):  # the words that the prefixes reach into
        own = np.array([np.frombuffer(x.ljust(64, b"\0"), "<u4")[i] for x in prefixes], np.uint32)
        words[i] = shared[i] | own[:, None]
    a, b = _first_words(words, (len(prefixes), n))
    return (a.byteswap().astype(np.uint64) << np.uint64(16)) | (b.byteswap() >> np.uint32(16)).astype(np.uint64)


def md5_bits(texts: pa.Array, prefixes: Sequence[bytes]) -> np.ndarray:
    """The first 48 bits of md5(prefix + text) as whole numbers: a row per prefix, a column per text
    (UTF-8, no nulls)."""
    texts = texts.cast(pa.large_string()).cast(pa.large_binary())
    n = len(texts)
    out = np.empty((len(prefixes), n), np.uint64)
    if not n:
        return out
    _, ends, body = texts.buffers()
    ends = np.frombuffer(ends, np.int64)[texts.offset:texts.offset + n + 1]
    data = np.frombuffer(body, np.uint8) if body is not None and len(body) else np.zeros(1, np.uint8)
    sizes = np.diff(ends)
    for p in sorted({len(x) for x in prefixes}):
        own = [i for i, x in enumerate(prefixes) if len(x) == p]
        fits = sizes + p <= ONE_BLOCK
        short = np.flatnonzero(fits)
        for lo in range(0, len(short), CHUNK):
            rows = short[lo:lo + CHUNK]
            out[np.ix_(own, rows)] = _chunk_bits(data, ends[rows], sizes[rows], [prefixes[i] for i in own])
        for row in np.flatnonzero(~fits):
            text = texts[int(row)].as_py()
            for i in own:
                out[i, row] = int.from_bytes(hashlib.md5(prefixes[i] + text).digest()[:6], "big")
    return out


def uniforms(text: Column, prefixes: Sequence[str]) -> Column:
    """A struct of uniform numbers in (0, 1), ``u0``, ``u1``, ... for the prefixes: the first 48
    bits of md5(prefix + text).  Any engine with md5 draws the same numbers.  ``text`` is not null."""
    heads = [p.encode() for p in prefixes]
    names = [f"u{i}" for i in range(len(heads))]

    def draw(texts: pa.Array) -> pa.Array:
        numbers = (md5_bits(texts, heads).astype(np.float64) + 0.5) / float(1 << 48)
        return pa.StructArray.from_arrays([pa.array(u) for u in numbers], names=names)

    draw.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(draw, "struct<" + ",".join(f"{n}:double" for n in names) + ">")(text)
