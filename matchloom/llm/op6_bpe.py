"""Operator 6, byte-level BPE by prefix dynamic programming, with appends and edits.

For each byte prefix of a piece there is exactly one token that can end a valid encoding of that
prefix; ``Prefixes`` stores it. A token t may follow the last token s of the shorter prefix only if
merging the bytes of s and t by rank gives back s and t; ``Vocabulary.stable`` decides this from the
two tokens' edges alone. Appending bytes only adds entries, and after an edit only entries from the
edit on are computed again. Pieces come from the vocabulary's split pattern; ``append`` and ``edit``
split again from the last piece before the change and stop where old and new pieces agree.

Spark deals the rows; each task encodes whole texts and keeps the codes of recent pieces (memory bounded
in bytes, ``REMEMBERED``) until it ends: a worker serves later steps too, and keeps only the vocabulary for them. Cases: null counts as an empty text (no tokens); repeated rows get equal results; very long
texts and pieces are encoded whole, in time proportional to their length. Of pairs of equal rank the leftmost merges first, as
in the public library; an empty table gives no rows; other columns than doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from matchloom.llm.common import small_batches, table
from matchloom.llm.textscan import slices

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Bytes of pieces and codes that a task remembers, about, in each of two generations, pairs of tokens, and edges of tokens.
REMEMBERED, PAIRS, EDGES = 40_000_000, 250_000, 20_000


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN


class Vocabulary:
    """Ranks of byte strings and the merge tree under each token."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of = {r: b for b, r in ranks.items()}
        self.split = regex.compile(pattern)
        #: Lengths of tokens by their last bytes (up to three), longest first: what may end a prefix.
        ends: dict[bytes, set[int]] = {}
        for b in ranks:
            ends.setdefault(b[-3:], set()).add(len(b))
        self.lengths = {b: tuple(sorted(n, reverse=True)) for b, n in ends.items()}
        self._pairs: dict[int, bool] = {}
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._edges: dict[tuple[int, int], list[tuple[int, int]]] = {}
        #: Tokens that merging can make; the others stand only for a whole piece.
        self.made = {b: r for b, r in ranks.items() if self.reachable(r)}

    def merged(self, b: bytes, below: int) -> list[int]:
        """Tokens left after all merges of ranks under ``below``, lowest rank first, leftmost first."""
        parts = [b[i : i + 1] for i in range(len(b))]
        while len(parts) > 1:
            best, at = below, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1], below)
                if r < best:
                    best, at = r, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a byte or a token that merging can't reach."""
        if token not in self._halves:
            b = self.bytes_of[token]
            parts = self.merged(b, token) if len(b) > 1 else []
            self._halves[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self._halves[token]

    def reachable(self, token: int) -> bool:
        return len(self.bytes_of[token]) == 1 or self.halves(token) is not None

    def edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """Tokens that touch the token's side (0 left, 1 right) while it grows, last first, each with the rank that consumes it."""
        key = (token, side)
        if key not in self._edges:
            out, end = [], len(self.bytes_of) + 1
            while True:
                out.append((token, end))
                if (h := self.halves(token)) is None:
                    break
                end, token = token, h[side]
            if len(self._edges) > EDGES:
                self._edges.clear()
            self._edges[key] = out
        return self._edges[key]

    def stable(self, s: int, t: int) -> bool:
        """Whether the bytes of s and t together encode to s, t: no merge across the seam comes before both sides are done."""
        key = s << 20 | t
        if (known := self._pairs.get(key)) is not None:
            return known
        left, right = self.edge(s, 1), self.edge(t, 0)
        ok = True
        i, j = len(left) - 1, len(right) - 1
        while ok:
            (a, a_end), (b, b_end) = left[i], right[j]
            r = self.ranks.get(self.bytes_of[a] + self.bytes_of[b])
            # on equal ranks the leftmost merge is first: the left token's own one, then the seam's
            if r is not None and r < a_end and r <= b_end:
                ok = False
            elif i == 0 and j == 0:
                break
            elif a_end <= b_end:
                i -= 1
            else:
                j -= 1
        if len(self._pairs) > PAIRS:
            self._pairs.clear()
        self._pairs[key] = ok
        return ok

    def forget(self) -> None:
        """Drops what was worked out for pairs of tokens; it is worked out again when it is needed."""
        self._pairs.clear()
        self._edges.clear()

    def encode_piece(self, b: bytes) -> list[int]:
        whole = self.ranks.get(b)
        return [whole] if whole is not None else Prefixes(self, b).ids()

    def encode_sorted(self, pieces: list[bytes]) -> Iterator[list[int]]:
        """Ids of each piece; a piece keeps the entries of the prefix that it shares with the one before."""
        table = Prefixes(self)
        for b in pieces:
            if (whole := self.ranks.get(b)) is not None:
                yield [whole]
                continue
            old, n = table.b, min(len(table.b), len(b))
            same = next((i for i in range(n) if old[i] != b[i]), n)
            yield table.edit(same, len(old), b[same:]).ids()

    def encode(self, text: str) -> list[int]:
        return [i for p in self.split.findall(text) for i in self.encode_piece(p.encode())]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(self.bytes_of[i] for i in ids)


class Prefixes:
    """The last token of the encoding of each byte prefix of one piece."""

    def __init__(self, vocabulary: Vocabulary, b: bytes = b""):
        self.v, self.b, self.last = vocabulary, b"", []
        self.append(b)

    def append(self, more: bytes) -> Prefixes:
        """Exact: entries of the shorter prefixes stay as they are."""
        v, last = self.v, self.last
        b = self.b = self.b + more
        rank, known, lengths = v.made.get, v._pairs.get, v.lengths.get
        for end in range(len(last) + 1, len(b) + 1):
            for k in (3, 2, 1):  # tokens of three bytes and more share their last three bytes with the prefix
                for n in lengths(b[end - k : end], ()) if k <= end else ():
                    if n > end:
                        continue
                    t = rank(b[end - n : end])
                    if t is None:
                        continue
                    if n < end:
                        s = last[end - n - 1]
                        ok = known(s << 20 | t)
                        if not (v.stable(s, t) if ok is None else ok):
                            continue
                    last.append(t)
                    break
                else:
                    continue
                break
            else:
                raise ValueError("the vocabulary lacks a byte")
        return self

    def edit(self, start: int, end: int, new: bytes) -> Prefixes:
        """Bytes from start to end replaced; prefixes before start keep their entries."""
        tail = self.b[end:]
        self.b, self.last = self.b[:start], self.last[:start]
        return self.append(new + tail)

    def ids(self) -> list[int]:
        out, end = [], len(self.b)
        while end:
            out.append(self.last[end - 1])
            end -= len(self.v.bytes_of[out[-1]])
        return out[::-1]


class Document:
    """An encoded text that can be appended to and edited; pieces away from a change keep their tokens."""

    def __init__(self, vocabulary: Vocabulary, text: str):
        self.v, self.text = vocabulary, text
        self.pieces = [(m.start(), m.group()) for m in vocabulary.split.finditer(text)]
        self.codes = [vocabulary.encode_piece(p.encode()) for _, p in self.pieces]

    def ids(self) -> list[int]:
        return [i for c in self.codes for i in c]

    def append(self, more: str) -> Document:
        return self.edit(len(self.text), len(self.text), more)

    def edit(self, start: int, end: int, new: str) -> Document:
        """Characters from start to end replaced. White space looks one piece ahead, so two pieces before are split again."""
        shift = len(new) - (end - start)
        text = self.text[:start] + new + self.text[end:]
        keep = max(0, sum(p + len(x) < start for p, x in self.pieces) - 2)
        at = self.pieces[keep][0] if keep < len(self.pieces) else 0
        later = {p + shift: i for i, (p, _) in enumerate(self.pieces) if p >= end}
        pieces, codes = self.pieces[:keep], self.codes[:keep]
        for m in self.v.split.finditer(text, at):
            i = later.get(m.start())
            if i is not None and m.start() > start + len(new) and self.pieces[i][1] == m.group():
                pieces += [(p + shift, x) for p, x in self.pieces[i:]]
                codes += self.codes[i:]
                break
            pieces.append((m.start(), m.group()))
            codes.append(self.v.encode_piece(m.group().encode()))
        self.text, self.pieces, self.codes = text, pieces, codes
        return self


def load(path: str, pattern: str) -> Vocabulary:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(r) for a, r in (line.split() for line in f if line.strip())}
    return Vocabulary(ranks, pattern)


class Codes:
    """Ids of recent pieces, as text, in two generations of bounded size. Each piece's ids are decoded when it is learnt, and must give its bytes."""

    def __init__(self, v: Vocabulary):
        self.v, self.new, self.old, self.size = v, {}, {}, 0

    def _keep(self, p: str, c: str) -> None:
        self.new[p] = c
        self.size += 200 + len(p) + len(c)

    def learn(self, pieces: set[str]) -> dict:
        """A table with the codes of all pieces."""
        if self.size >= REMEMBERED:  # codes not used since the last turn go
            self.new, self.old, self.size = {}, self.new, 0
        fresh = []
        for p in pieces:
            if p not in self.new:
                if (c := self.old.get(p)) is not None:
                    self._keep(p, c)
                else:
                    fresh.append(p.encode())
        fresh.sort()
        for b, ids in zip(fresh, self.v.encode_sorted(fresh), strict=True):
            if self.v.decode(ids) != b:
                raise ValueError("the vocabulary doesn't decode what it encodes")
            self._keep(b.decode(), " ".join(map(str, ids)))
        return self.new


@lru_cache(maxsize=1)
def _held(path: str, pattern: str) -> Vocabulary:
    return load(path, pattern)


def _released(run):
    """A task that leaves nothing but the vocabulary in its worker, which stays for other tasks."""

    def task(path: str, pattern: str):
        def over(batches):
            v = _held(path, pattern)
            try:
                yield from run(v, batches)
            finally:
                v.forget()

        return over

    return task


@_released
def _task(v: Vocabulary, batches):
    codes, split = Codes(v), v.split.findall
    for whole in batches:
        for b in slices(whole, "text"):
            every = [split(t.as_py() or "") for t in b.column(1)]
            new = codes.learn(set().union(*every))
            n_tokens, ids_sha, decoded_sha = [], [], []
            for pieces in every:
                ids, decoded, n = hashlib.sha256(), hashlib.sha256(), 0
                for i in range(0, len(pieces), 50_000):
                    part = pieces[i : i + 50_000]
                    got = " ".join([new[p] for p in part])
                    ids.update((b" " if i else b"") + got.encode())
                    decoded.update("".join(part).encode())
                    n += got.count(" ") + 1
                n_tokens.append(n)
                ids_sha.append(ids.hexdigest())
                decoded_sha.append(decoded.hexdigest())
            yield pa.record_batch([b.column(0), pa.array(n_tokens, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


@_released
def _ids_task(v: Vocabulary, batches):
    for b in batches:
        ids = [v.encode(t.as_py() or "") for t in b.column(1)]
        yield pa.record_batch([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, ids): the token ids of every text."""
    small_batches(docs.sparkSession)
    p, r = default_paths()
    return docs.select("doc_id", "text").mapInArrow(_ids_task(path or p, pattern or r), "doc_id long, ids array<int>")


@_released
def _decode_task(v: Vocabulary, batches):
    for b in batches:
        texts = [v.decode(i.as_py() or []).decode("utf-8", "replace") for i in b.column(1)]
        yield pa.record_batch([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])


def decode(encoded: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, text) of token ids."""
    p, r = default_paths()
    return encoded.select("doc_id", "ids").mapInArrow(_decode_task(path or p, pattern or r), "doc_id long, text string")


def digest(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Token count and hashes of the ids and of the decoded bytes of every text."""
    small_batches(docs.sparkSession)
    p, r = default_paths()
    return docs.select("doc_id", "text").mapInArrow(_task(path or p, pattern or r), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))
