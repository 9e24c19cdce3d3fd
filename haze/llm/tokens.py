"""Public tokenizers over Arrow batches, with every distinct piece of text encoded once per worker.

The pre-tokenizers of both files start a new unit before ASCII white space that follows anything
else, and between a letter and an ASCII sign. Texts are therefore cut there, the distinct pieces
of a batch are looked up in a table the worker keeps (two generations, so that a full table loses
what it did not use of late), and only new ones reach the tokenizer. ``tests/llm`` holds the result against encoding the whole text.
"""

from __future__ import annotations

import re
from array import array
from itertools import pairwise

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from haze.llm.common import text_buffers

END_ID = 2
MAX_PIECES = 700_000  # of each generation

_SPACE, _LETTER, _SIGN, _TAIL = 1, 2, 4, 8  # _TAIL: last bytes of white space beyond ASCII
_KIND = bytearray(256)
for _bit, _bytes in ((_SPACE, [0x20, *range(0x09, 0x0E)]), (_LETTER, [*range(0x41, 0x5B), *range(0x61, 0x7B)]),
                     (_SIGN, [*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]),
                     (_TAIL, [0x85, 0xA0, *range(0x80, 0x8B), 0xA8, 0xA9, 0xAF, 0x9F])):
    for _b in _bytes:
        _KIND[_b] |= _bit
_KIND = bytes(_KIND)
_LEAD = np.zeros(256, bool)
_LEAD[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_LOWER = bytes(range(256)).lower()
# UTF-8 of `` ?[A-Za-zÀ-ÖØ-öø-ÿ]+``
_PLAIN = re.compile(rb" ?(?:[A-Za-z]++|\xC3[\x80-\x96\x98-\xB6\xB8-\xBF])++\Z")


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies (a fixed rule)."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Encoder:
    """Encodes texts with the tokenizer file ``path``; one per worker, see ``encoder``."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.normalizer = self.tokenizer.normalizer
        self.letters = _byte_letters()
        self.blind = self.normalizer is not None  # white space and case of ASCII letters make no difference
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _encode_piece(self, piece: bytes) -> bytes:
        if not _PLAIN.match(piece):
            return array("I", self.tokenizer.encode(piece.decode(), add_special_tokens=False).ids).tobytes()
        if self.blind:
            piece = self.normalizer.normalize_str(piece.decode().lstrip(" ")).encode()
        if piece.isascii():
            text = self.letters[0x20] + piece[1:].decode() if piece[:1] == b" " else piece.decode()
        else:
            text = piece.decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(text)]).tobytes()

    def _look_up(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of distinct pieces; the table learns those it did not know."""
        known = self.known
        found = list(map(known.get, pieces))
        for i in [i for i, ids in enumerate(found) if ids is None]:
            if len(known) >= MAX_PIECES:
                self.older, self.known = known, {}
                known = self.known
            piece = pieces[i]
            ids = self.older.get(piece)
            known[piece] = found[i] = self._encode_piece(piece) if ids is None else ids
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids per text); each text's ids end with ``END_ID``, a null is the empty text."""
        data, offsets = text_buffers(texts)
        n = len(offsets) - 1
        if not len(data):
            return np.full(n, END_ID, np.uint32), np.ones(n, np.int64)
        raw = data.tobytes()
        if self.blind:
            raw = raw.translate(_LOWER)
        kind = np.frombuffer(raw.translate(_KIND), np.uint8)
        before, after = kind[:-1], kind[1:]
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = (after & ~before & _SPACE) | (after & (before << 1) & _SIGN)
        # ASCII white space behind other white space begins nothing
        tail = np.flatnonzero(before & (after << 3) & _TAIL)
        wide = (_LEAD[data[tail - 1]] & (tail > 0)) | (_LEAD[data[tail - 2]] & (tail > 1))
        cut[tail[wide] + 1] = False
        cut[offsets] = True
        edges = np.flatnonzero(cut)
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(raw)])
        coded = pieces.dictionary_encode()
        inside, bounds = text_buffers(coded.dictionary)
        inside = inside.tobytes()
        found = self._look_up([inside[i:j] for i, j in pairwise(bounds.tolist())])
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = np.frombuffer(b"".join(found), np.uint32)
        first = np.cumsum(sizes) - sizes
        which = np.asarray(coded.indices)
        size = sizes[which]
        upto = np.cumsum(size)
        ids = flat[np.repeat(first[which] - (upto - size), size) + np.arange(upto[-1])]
        upto = np.concatenate([[0], upto])
        ends = upto[np.searchsorted(edges, offsets[1:])]
        counts = np.diff(np.concatenate([[0], ends]))
        return np.insert(ids, ends, np.uint32(END_ID)), counts + 1


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for the tokenizer file ``path``."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
