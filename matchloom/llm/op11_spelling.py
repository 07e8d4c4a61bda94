"""Operator 11, spelling variant grouping: words one edit apart are found by pivotal bigrams, and each points to its standard form.

Words are runs of letters, counted over all whole texts. Two words are near when one inserted, deleted
or replaced code point makes one of the other. All near pairs are found by a pivotal prefix filter:

1. Bigrams are ordered by how many words' places hold them, rarest first. A word's prefix is its three rarest
   bigrams (and all that equal the third).
2. Dynamic programming over the prefix picks the two disjoint bigrams of least total frequency, the pivots
   P1 < P2. One edit breaks at most one of two disjoint bigrams. If the third bigram of a word is not
   after its near word's one, its unbroken pivot lies in the near word's prefix; so pivots of all words against prefixes of all
   words miss no pair.
3. Position limits: the edit lies in one gap, left of P1, from P1 up to P2, from between them through P2,
   or right of P2, and everything outside the gap is the same in both words, at the same distance from the near
   end. So a pivot is looked up together with the whole text on both sides of the gap and with the
   near word's length (own, one less, one more). Index entries of a word are, for each prefix bigram, the gaps that
   can begin or end at it; keys are 64-bit hashes.
4. Candidates are verified by edit distance, so a hash can't add a pair.

Words of ``LONG`` code points or more have one gap for each side of a bigram (up to the word's end), so their entries grow
with their length and not with its square. Words at the boundary are entered both ways.

The form is the near word with the largest count where that is at least ``ratio`` times the word's own. Forms at least
double the count, so chains are short: roots come by pointer doubling, with hot targets sent to all tasks.

Scale: texts are scanned once, with partial counts in each task; only words are shuffled. Bigrams are at most
90 * 90 (letters a-z, A-Z folded, and U+00C0 to U+00FF), so their order is sent to all tasks. Entries are linear in
the words, and keys hold nearly the whole word, so groups of equal keys are small whatever word is frequent in the texts.

Cases: null and empty texts have no words; a null doc_id counts as empty text in the deletion hash; repeated rows count
again; a word of any length is taken whole; ties of counts go to the smaller word in code-point order; an empty table, or
one without words that are frequent enough, gives no rows; other columns are never read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm.common import materialize, small_batches, table, with_hot_keys
from matchloom.llm.textscan import mix, slices, text_buffer
from matchloom.session import shuffled

MIN_LENGTH, MIN_COUNT, RATIO = 5, 3, 2
#: One run in so many (by hash) loses a code point: the noise that the contract of the query plants.
DROP_ONE_IN = 97
LONG = 64
#: Bytes of text whose words are counted together in a task.
SLICE = 4_000_000

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_rng = np.random.default_rng(20250611)
#: A random odd value for each code point below 256, and powers of an odd base for 64-bit polynomials.
_CHAR = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SALT = [np.uint64(x | 1) for x in _rng.integers(1, 2**63, 4, dtype=np.uint64).tolist()]


# --- words of the texts


def _crc_shift(length: int) -> np.ndarray:
    """Four tables of 256: their XOR over a CRC's bytes is that CRC's part in the CRC of a text continued by ``length`` bytes."""
    zero = bytes(length)
    none = zlib.crc32(zero, 0)
    bits = [zlib.crc32(zero, 1 << b) ^ none for b in range(32)]
    out = np.zeros((4, 256), np.uint32)
    for k in range(4):
        for b in range(8):
            out[k, (np.arange(256) >> b) & 1 == 1] ^= np.uint32(bits[8 * k + b])
    return out


class _Crc:
    """CRC-32 of a prefix continued by a word, for many pairs at once."""

    def __init__(self):
        self.tables: dict[int, np.ndarray] = {}

    def joined(self, prefix: np.ndarray, word: np.ndarray, length: np.ndarray) -> np.ndarray:
        out = word.copy()
        for n in np.unique(length).tolist():
            if n not in self.tables:
                if len(self.tables) > 512:
                    self.tables.clear()
                self.tables[n] = _crc_shift(n)
            t, at = self.tables[n], length == n
            p = prefix[at]
            out[at] ^= t[0, p & 255] ^ t[1, (p >> 8) & 255] ^ t[2, (p >> 16) & 255] ^ t[3, p >> 24]
        return out


def runs(col: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Every run of letters of the texts, A-Z folded, and the text each is in."""
    d, offs = text_buffer(col)
    n = len(d)
    lead = d == 0xC3  # the first byte of U+00C0 to U+00FF, and of no other character
    letter = _LETTER[d] | lead
    letter[1:] |= lead[:-1]
    start = letter.copy()
    start[1:] &= ~letter[:-1]
    inner = offs[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    start[inner] = letter[inner]
    begins = np.flatnonzero(start)
    size = np.diff(np.append(np.cumsum(letter)[begins] - 1, np.count_nonzero(letter))) if len(begins) else np.zeros(0, np.int64)
    ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    words = pa.StringArray.from_buffers(len(begins), pa.py_buffer(ends), pa.py_buffer(_FOLD[d[letter]]))
    return words, np.searchsorted(offs, begins, "right") - 1


def _count_slice(ids: pa.Array, col: pa.Array, crc: _Crc) -> pa.Table:
    words, doc = runs(col)
    coded = words.dictionary_encode()
    code, names = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
    raw = [w.encode() for w in names.to_pylist()]
    own = np.fromiter((zlib.crc32(b) for b in raw), np.uint32, len(raw))
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    prefix = np.fromiter((zlib.crc32(b"%s:" % (b"" if i is None else str(i).encode())) for i in ids.to_pylist()), np.uint32, len(ids))
    h = crc.joined(prefix[doc], own[code], size[code])
    hit = np.flatnonzero(h % DROP_ONE_IN == 0)
    n = np.bincount(code, minlength=len(raw)) - np.bincount(code[hit], minlength=len(raw))
    shorter = []
    for c, x in zip(code[hit].tolist(), h[hit].tolist(), strict=True):
        w = raw[c].decode()
        at = x % len(w)
        shorter.append(w[:at] + w[at + 1 :])
    return pa.table({"word": pa.concat_arrays([names.cast(pa.string()), pa.array(shorter, pa.string())]), "n": pa.array(np.concatenate([n, np.ones(len(shorter), np.int64)]), pa.int64())})


def _count_task(batches):
    crc = _Crc()
    for whole in batches:
        for b in slices(whole, "text", SLICE):
            t = _count_slice(b.column(0), b.column(1), crc)
            long_enough = pc.and_(pc.greater_equal(pc.utf8_length(t["word"]), MIN_LENGTH), pc.greater(t["n"], 0))
            yield from t.filter(long_enough).to_batches(20_000)


def vocabulary(docs: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): words of at least MIN_LENGTH code points and ``min_count`` occurrences."""
    small_batches(docs.sparkSession)
    counts = docs.select("doc_id", "text").mapInArrow(_count_task, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


# --- pivots and entries


def gram_order(words: DataFrame) -> np.ndarray:
    """Frequency rank of every bigram, rarest first, at 256 * first + second code point; at most 90 * 90 differ."""
    spots = F.explode(F.sequence(F.lit(1), F.char_length("word") - 1)).alias("i")
    grams = words.select("word", spots).groupBy(F.expr("substring(word, i, 2)").alias("g")).agg(F.count(F.lit(1)).alias("n")).collect()
    rank = np.zeros(1 << 16, np.int64)
    for i, r in enumerate(sorted(grams, key=lambda r: (r["n"], r["g"]))):
        rank[ord(r["g"][0]) << 8 | ord(r["g"][1])] = i + 1
    freq = np.zeros(len(grams) + 1, np.int64)
    for r in grams:
        freq[rank[ord(r["g"][0]) << 8 | ord(r["g"][1])]] = r["n"]
    return np.stack([rank, freq[rank]])


def prefix_and_pivots(chars: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of one length as rows of code points: the mask of prefix bigrams, and the places of P1 and P2.

    The table ``best`` holds, for each place, the cheapest prefix bigram that ends before it; with it each place's cheapest pair is one sum."""
    gram = chars[:, :-1].astype(np.int64) << 8 | chars[:, 1:]
    rank, cost = order[0][gram], order[1][gram].astype(np.float64)
    prefix = rank <= np.partition(rank, 2, axis=1)[:, 2:3]
    cost = np.where(prefix, cost, np.inf)
    places = cost.shape[1]
    best, at = np.full(len(chars), np.inf), np.zeros(len(chars), np.int64)
    total, p1, p2 = np.full(len(chars), np.inf), np.zeros(len(chars), np.int64), np.zeros(len(chars), np.int64)
    for i in range(2, places):
        cheaper = cost[:, i - 2] < best
        best, at = np.where(cheaper, cost[:, i - 2], best), np.where(cheaper, i - 2, at)
        better = cost[:, i] + best < total
        total, p1, p2 = np.where(better, cost[:, i] + best, total), np.where(better, at, p1), np.where(better, i, p2)
    return prefix, p1, p2


class Keys:
    """Hash keys of (side of the bigram, text left of a gap, text right of it, length of the indexed word), for words of one length."""

    def __init__(self, chars: np.ndarray):
        n, size = chars.shape
        value = _CHAR[chars]
        power = np.full(size, _BASE, np.uint64)
        power[0] = 1
        power = np.multiply.accumulate(power)
        none = np.zeros((n, 1), np.uint64)
        self.left = np.concatenate([none, np.cumsum(value * power, axis=1, dtype=np.uint64)], axis=1)
        self.right = np.concatenate([none, np.cumsum(value[:, ::-1] * power, axis=1, dtype=np.uint64)], axis=1)[:, ::-1]
        self.size = size

    def of(self, side: int, rows: np.ndarray, left: np.ndarray, right: np.ndarray, length: int) -> np.ndarray:
        """``left`` is where the gap begins, ``right`` where it ends; both are kept as distances from their ends."""
        shape = left.astype(np.uint64) << np.uint64(32) | (self.size - right).astype(np.uint64)
        h = mix(self.left[rows, left] * _SALT[0] + self.right[rows, right] * _SALT[1] + mix(shape + _SALT[2]) + mix(np.full(1, 2 * length + side, np.uint64) + _SALT[3]))
        return h.view(np.int64)


def entries(chars: np.ndarray, order: np.ndarray, long: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all index entries of words of one length."""
    size = chars.shape[1]
    prefix, _, _ = prefix_and_pivots(chars, order)
    row, p = np.nonzero(prefix)
    k, rows, keys = Keys(chars), [], []
    for q in [0, size] if long else range(size + 1):
        at = p + 2 <= q  # the gap runs from behind the bigram to q
        rows.append(row[at])
        keys.append(k.of(0, row[at], p[at] + 2, np.full(at.sum(), q), size))
        at = q <= p  # the gap runs from q to the bigram
        rows.append(row[at])
        keys.append(k.of(1, row[at], np.full(at.sum(), q), p[at], size))
    return np.concatenate(rows), np.concatenate(keys)


def probes(chars: np.ndarray, order: np.ndarray, long: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all lookups of words of one length."""
    n, size = chars.shape
    _, p1, p2 = prefix_and_pivots(chars, order)
    k, all_rows, none, end = Keys(chars), np.arange(n), np.zeros(n, np.int64), np.full(n, size)
    gaps = [(0, p2 + 2, end), (1, none, p1)]
    gaps += [(0, p1 + 2, end), (1, none, p2)] if long else [(0, p1 + 2, p2 + 2), (1, p1, p2)]
    rows, keys = [], []
    for side, left, right in gaps:
        for length in (size - 1, size, size + 1):
            fits = left + (size - right) <= length
            rows.append(all_rows[fits])
            keys.append(k.of(side, all_rows[fits], left[fits], right[fits], length))
    return np.concatenate(rows), np.concatenate(keys)


def _key_task(make, order: np.ndarray):
    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column(0).to_pylist()
            sizes = np.fromiter(map(len, text), np.int64, len(text))
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                step = max(1, 4_000_000 // size**2)
                for i in range(0, len(at), step):
                    part = at[i : i + step]
                    chars = np.frombuffer("".join([text[j] for j in part]).encode("latin-1"), np.uint8).reshape(len(part), size)
                    for long in [False] * (size <= LONG + 1) + [True] * (size >= LONG):
                        row, key = make(chars, order, long)
                        key = key ^ np.int64(long)
                        for j in range(0, len(row), 50_000):
                            pick = pa.array(part[row[j : j + 50_000]])
                            yield pa.record_batch([pa.array(key[j : j + 50_000]), b.column(0).take(pick), b.column(1).take(pick)], names=["key", "word", "n"])

    return run


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n): each word with every near word, once. ``words``: (word, n), one row a word, written."""
    order = gram_order(words)
    small_batches(words.sparkSession, 4096)
    index = words.mapInArrow(_key_task(entries, order), "key long, word string, n long")
    lookups = words.mapInArrow(_key_task(probes, order), "key long, word string, n long").toDF("key", "other", "other_n")
    # Spark estimates lookups by the words' compressed files; they are ten rows a word and more, and are not sent
    found = index.join(shuffled(lookups), "key").filter((F.col("word") != F.col("other")) & (F.levenshtein("word", "other", 1) == 1)).select("word", "n", "other", "other_n")
    both = found.union(found.select("other", "other_n", "word", "n"))
    return both.repartition("word").dropDuplicates(["word", "other"])


# --- forms and roots


def roots(forms: DataFrame) -> DataFrame:
    """``forms`` (word, form) with the last word of each word's chain as ``root``; rows without a form are their own root."""
    t = materialize(forms.select("word", F.coalesce("form", "word").alias("root")), "roots")
    while True:
        sizes = t.groupBy("root").agg(F.count(F.lit(1)).alias("pointers"))
        hops = materialize(sizes.join(shuffled(t.select(F.col("word").alias("root"), F.col("root").alias("next"))), "root"), "hops")
        if hops.filter(F.col("next") != F.col("root")).isEmpty():
            return t
        t = materialize(with_hot_keys(t, hops, ["root"], "pointers").select("word", F.col("next").alias("root")), "roots")


def variants(docs: DataFrame, min_count: int = MIN_COUNT, ratio: float = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of the vocabulary."""
    words = materialize(vocabulary(docs, min_count), "words")
    near = near_pairs(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("top"))
    t = words.join(shuffled(near), "word", "left")
    is_form = -F.col("top.less") >= ratio * F.col("n")
    t = materialize(t.select("word", F.when(is_form, F.col("top.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, -F.col("top.less")).alias("form_n")), "forms")
    return t.join(shuffled(roots(t)), "word").select("word", "form", "root", "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))
