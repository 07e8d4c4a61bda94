"""Vectorised scans of Arrow text batches inside Spark tasks: word bounds, word hashes and windows.

White space of the word class is ASCII, so words are found on UTF-8 bytes. Hashes are polynomials
modulo 2**64 over random byte values, mixed at the end; equal words always get equal hashes, and two
different words or windows of one text agree with a chance of about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLD = _BYTE.copy()
_FOLD[65:91] = _BYTE[97:123]
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)
_WORD = np.ones(256, dtype=bool)
_WORD[[9, 10, 11, 12, 13, 32]] = False
_MIX = [np.uint64(x | 1) for x in _rng.integers(1, 2**63, 16, dtype=np.uint64).tolist()]
_pow: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, kept for the worker's life and grown by doubling."""
    if not _pow or len(_pow[0]) < n:
        m = max(1 << 16, 1 << (n - 1).bit_length())
        _pow[:] = []
        for p in (_P, _P_INV):
            a = np.full(m, p, dtype=np.uint64)
            a[0] = 1
            _pow.append(np.multiply.accumulate(a))
    return _pow


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offsets of each; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    if not pa.types.is_string(col.type):
        col = col.cast(pa.string())
    _, offs, data = col.buffers()
    o = np.frombuffer(offs, dtype=np.int32, count=len(col) + 1 + col.offset)[col.offset :].astype(np.int64) if offs else np.zeros(len(col) + 1, np.int64)
    d = np.frombuffer(data, dtype=np.uint8)[o[0] : o[-1]] if data is not None and len(o) else np.zeros(0, np.uint8)
    return d, o - o[0]


def slices(batch: pa.RecordBatch, col: str = "text", limit: int = 500_000) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch with at most about ``limit`` bytes of text each (one row at least)."""
    i = batch.schema.get_field_index(col)
    n = batch.num_rows
    if not n:
        return
    _, o = text_buffer(batch.column(i))
    start = 0
    while start < n:
        end = max(start + 1, int(np.searchsorted(o, o[start] + limit, "right")) - 1)
        yield batch.slice(start, end - start)
        start = end


class Scan:
    """Words of a batch of texts. ``doc`` is non-decreasing; all offsets are bytes."""

    def __init__(self, col: pa.Array, fold: bool = False):
        self.data, self.offs = text_buffer(col)
        n = len(self.data)
        self.n_docs = len(self.offs) - 1
        self.is_word = _WORD[self.data]
        inner = self.offs[1:-1]
        inner = inner[(inner > 0) & (inner < n)]
        start = self.is_word.copy()
        start[1:] &= ~self.is_word[:-1]
        start[inner] = self.is_word[inner]
        end = self.is_word.copy()
        end[:-1] &= ~self.is_word[1:]
        end[inner - 1] = self.is_word[inner - 1]
        self.starts = np.flatnonzero(start)
        self.ends = np.flatnonzero(end) + 1
        self.doc = np.searchsorted(self.offs, self.starts, "right") - 1
        self._fold = fold
        self._cum: np.ndarray | None = None

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of the byte spans."""
        n = len(self.data)
        p, inv = _powers(n + 1)
        if self._cum is None:
            self._cum = np.zeros(n + 1, np.uint64)
            np.cumsum((_FOLD if self._fold else _BYTE)[self.data] * p[:n], out=self._cum[1:])
        h = (self._cum[ends] - self._cum[starts]) * inv[starts]
        return mix(h + (ends - starts).astype(np.uint64) * _MIX[0])

    def word_hashes(self) -> np.ndarray:
        return self.spans(self.starts, self.ends)

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """Sums over each document of a value for each byte."""
        c = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=c[1:])
        return c[self.offs[1:]] - c[self.offs[:-1]]

    def n_words(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.n_docs).astype(np.int64)

    def windows(self, k: int, words: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every window of k words inside one document."""
        w = self.word_hashes() if words is None else words
        n = len(w) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        first = np.flatnonzero(self.doc[:n] == self.doc[k - 1 :])
        h = np.zeros(n, np.uint64)
        for j in range(k):
            h = mix(h * _MIX[j + 1] + w[j : n + j])
        return first, h[first]

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, start and end of every line that has a word."""
        n = len(self.data)
        nl = np.flatnonzero(self.data == 10)
        s = np.unique(np.concatenate([self.offs[:-1], nl + 1]))
        s = s[s < n]
        e = np.concatenate([s[1:], [n]]) if len(s) else s
        e = np.where((e > s) & (self.data[np.maximum(e - 1, 0)] == 10), e - 1, e) if len(s) else e
        has = np.searchsorted(self.starts, e, "left") > np.searchsorted(self.starts, s, "left")
        s, e = s[has], e[has]
        return np.searchsorted(self.offs, s, "right") - 1, s, e


def repeated(doc: np.ndarray, key: np.ndarray) -> np.ndarray:
    """True where the (document, key) pair occurs more than once."""
    k = mix(key + doc.astype(np.uint64) * _MIX[9])
    order = np.argsort(k, kind="stable")
    s = k[order]
    same = np.zeros(len(k), bool)
    if len(k) > 1:
        eq = s[1:] == s[:-1]
        same[order[1:]] = eq
        same[order[:-1]] |= eq
    return same


def base_counts(col: pa.Array) -> dict[str, np.ndarray]:
    """Counts for base quality rules, whole texts."""
    s = Scan(col)
    words = s.word_hashes()
    lead = (s.data & 0xC0) != 0x80
    symbols = np.zeros(256, bool)
    symbols[[ord(c) for c in "#*$%&|<>"]] = True
    first, h = s.windows(3, words)
    rep = first[repeated(s.doc[first], h)]
    cover = np.zeros(len(words) + 3, bool)
    for j in range(3):
        cover[rep + j] = True
    ld, ls, le = s.lines()
    lk = mix(s.spans(ls, le) + ld.astype(np.uint64) * _MIX[9])
    _, uniq = np.unique(lk, return_index=True)
    nd = lambda x: np.bincount(x, minlength=s.n_docs).astype(np.int64)
    return {
        "n_words": s.n_words(),
        "word_chars": s.per_doc(lead & s.is_word),
        "n_symbols": s.per_doc(symbols[s.data]),
        "n_dup_lines": nd(ld) - nd(ld[uniq]),
        "n_repeat_words": nd(s.doc[cover[: len(words)]]),
    }
