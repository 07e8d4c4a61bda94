"""Operator 12, cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes, and how usual each pairing is.

A and B encode the same bytes (a space, then the text). Tasks work on Arrow arrays:

* lists of ids are flattened, with the parent index as document; lengths of the tokens' bytes are taken by id, and cumulative
  sums, less the sum at the document's start, give each token's end;
* an Acero hash join of A's and B's (document, end) keys finds the places where both have a token end: the groups;
* every end of A or of B closes one stretch that lies in exactly one token of each, so the links (overlapping pairs) are read off the
  ends by binary search, without comparing tokens;
* ``Table.group_by`` counts links by document and pair, then documents by pair: partial counts.

Spark merges the partial counts. A link needs its pair's count in all documents, and a document has hundreds of
pairs, so documents go in blocks of about ``BLOCK`` bytes: a block has each pair once, with its number of documents, and its documents name
pairs by their place in that list. Only the lists are exchanged: summed by pair, joined with the sums, and brought back to
their block (a cogroup), where the documents' sums are formed. A pair comes once a block, so no key is hot. Pair counts are never sent
whole to a task; the highest count of each A id is (one row for an id of A's vocabulary at most).

Texts are cut at single spaces between printable characters, where neither tokenizer joins anything: A's pattern begins a new piece at
such a space, and none of B's pieces has a space inside (checked at the start; otherwise texts stay whole). Each distinct
cut is encoded once by the public libraries and remembered, up to ``REMEMBERED`` cuts in two generations.

Cases: null and empty texts, and texts whose tokens' bytes aren't the text (U+2581 in it, which B reads as a space), have no tokens: zeros, an empty
``groups_sha256``, no part in any count; strings of special tokens are plain text; repeated rows count again; a very long text is a block
of its own; ties for an A id's highest count are all best; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm.common import materialize, small_batches, table
from matchloom.llm.textscan import slices, text_buffer

TOKENIZER_A, TOKENIZER_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text that are aligned at once, and whose documents share one list of pairs.
SLICE, BLOCK = 2_000_000, 16_000_000
REMEMBERED = 250_000
SPACE = "▁"

_PRINTABLE = np.zeros(256, bool)
_PRINTABLE[33:127] = True


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER_A), public_tokenizers.path(TOKENIZER_B)


def byte_of_character() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 characters are themselves, the others follow from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizers:
    """Both tokenizers, the bytes of their tokens, and remembered cuts."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals the work
        import sentencepiece
        import tokenizers

        self.a = tokenizers.Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte, size_a = byte_of_character(), self.a.get_vocab_size(with_added_tokens=True)
        self.bytes_a = [b""] * size_a
        for piece, i in self.a.get_vocab(with_added_tokens=True).items():
            self.bytes_a[i] = bytes(byte[c] for c in piece) if all(c in byte for c in piece) else piece.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.length_a, self.length_b = (pa.array(list(map(len, x)), pa.int64()) for x in (self.bytes_a, self.bytes_b))
        with open(path_a, encoding="utf-8") as f:
            kind = (json.load(f).get("pre_tokenizer") or {}).get("type")
        self.cuts = kind == "ByteLevel" and not any(SPACE in p.lstrip(SPACE) for p in pieces)
        self.new: dict[str, tuple[bytes, bytes] | None] = {}
        self.old: dict[str, tuple[bytes, bytes] | None] = {}
        #: Every id with what may follow it in the written groups.
        self.written = pa.array([f"{i}{s}" for i in range(size_a) for s in ",|"] + [f"{i}{s}" for i in range(len(pieces)) for s in (",", ";", "")], pa.binary())

    def cut(self, col: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Cuts of space + text, and the text each is in."""
        d, offs = text_buffer(pc.binary_join_element_wise(" ", pc.fill_null(col, ""), ""))
        start = np.zeros(len(d), bool)
        if self.cuts and len(d) > 2:
            before = _PRINTABLE[d]
            before[1:] |= (d[:-1] == 0xC3) & (d[1:] >= 0x80)
            start[1:-1] = (d[1:-1] == 32) & before[:-2] & (_PRINTABLE[d[2:]] | (d[2:] == 0xC3))
        start[offs[:-1]] = True
        begins = np.flatnonzero(start)
        at = np.append(begins, len(d)).astype(np.int32)
        return pa.StringArray.from_buffers(len(begins), pa.py_buffer(at), pa.py_buffer(d)), np.searchsorted(offs, begins, "right") - 1

    def _learn(self, fresh: list[str]) -> None:
        ids_a = [e.ids for e in self.a.encode_batch_fast(fresh, add_special_tokens=False)]
        ids_b = self.b.encode([t[1:] for t in fresh], num_threads=1)
        for text, a, b in zip(fresh, ids_a, ids_b, strict=True):
            raw = text.encode()
            same = b"".join([self.bytes_a[i] for i in a]) == raw == b"".join([self.bytes_b[i] for i in b])
            self.new[text] = (np.array(a, np.int32).tobytes(), np.array(b, np.int32).tobytes()) if same else None

    def codes(self, texts: list[str]) -> list[tuple[bytes, bytes] | None]:
        """Ids of A and B of each cut; None where their bytes aren't the cut's."""
        if len(self.new) >= REMEMBERED:
            self.new, self.old = {}, self.new
        fresh = []
        for t in texts:
            if t not in self.new:
                if t in self.old:
                    self.new[t] = self.old[t]
                else:
                    fresh.append(t)
        for i in range(0, len(fresh), 5000):
            self._learn(fresh[i : i + 5000])
        return [self.new[t] for t in texts]

    def encode(self, col: pa.Array) -> tuple[pa.ListArray, pa.ListArray]:
        """Ids of A and B of every text; texts without tokens have empty lists."""
        cuts, doc = self.cut(col)
        coded = cuts.dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False)
        known = self.codes(coded.dictionary.to_pylist())
        good = np.fromiter((k is not None for k in known), bool, len(known))
        tokens = np.bincount(doc[~good[code]], minlength=len(col)) == 0
        tokens &= pc.greater(pc.fill_null(pc.binary_length(col), 0), 0).to_numpy(zero_copy_only=False)
        keep = tokens[doc]
        code, doc, out = pa.array(code[keep]), doc[keep], []
        for side in (0, 1):
            ids = [k[side] if k else b"" for k in known]
            offs = np.concatenate([[0], np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)) // 4)])
            lists = pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(np.frombuffer(b"".join(ids), np.int32)))
            mine = lists.take(code)
            n = np.bincount(doc, weights=pc.list_value_length(mine).to_numpy(zero_copy_only=False), minlength=len(col)).astype(np.int64)
            out.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pc.list_flatten(mine)))
        return out[0], out[1]


class Aligned(NamedTuple):
    """Groups and links of many documents. Tokens are numbered through all documents."""

    a: np.ndarray
    b: np.ndarray
    doc_a: np.ndarray
    doc_b: np.ndarray
    #: The last token of A and of B of each group, and its document.
    last_a: np.ndarray
    last_b: np.ndarray
    doc_group: np.ndarray
    #: The tokens of each link.
    link_a: np.ndarray
    link_b: np.ndarray


def _ends(lists: pa.ListArray, length: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, documents and keys (document, end in bytes) of all tokens; keys ascend."""
    ids, doc = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.concatenate([[0], pc.cumulative_sum(length.take(ids)).to_numpy(zero_copy_only=False)])
    offs = lists.offsets.to_numpy(zero_copy_only=False)
    before = total[offs[:-1]]
    return ids.to_numpy(zero_copy_only=False), doc, doc << 32 | (total[1:] - before[doc])


def align(lists_a: pa.ListArray, lists_b: pa.ListArray, length_a: pa.Array, length_b: pa.Array) -> Aligned:
    """Both lists of a document cover the same bytes."""
    a, doc_a, key_a = _ends(lists_a, length_a)
    b, doc_b, key_b = _ends(lists_b, length_b)
    ta = pa.table({"key": key_a, "i": np.arange(len(a))})
    tb = pa.table({"key": key_b, "j": np.arange(len(b))})
    both = ta.join(tb, "key", join_type="inner", use_threads=False)
    last_a, last_b = (np.sort(both[c].to_numpy()) for c in "ij")
    # an end of A closes a stretch in the token of B that ends there or next; so do those ends of B that aren't A's
    in_b = np.searchsorted(key_b, key_a, "left")
    only_b = np.ones(len(b), bool)
    only_b[last_b] = False
    only_b = np.flatnonzero(only_b)
    in_a = np.searchsorted(key_a, key_b[only_b], "left")
    return Aligned(a, b, doc_a, doc_b, last_a, last_b, doc_a[last_a], np.concatenate([np.arange(len(a)), in_a]), np.concatenate([in_b, only_b]))


def written_groups(x: Aligned, n_docs: int, written: pa.Array, size_a: int) -> list[str]:
    """SHA-256 of ``a1,a2|b1;a3|b2,b3`` for every document, '' without tokens."""
    n_a, n_b = len(x.a), len(x.b)
    i, j = np.arange(n_a), np.arange(n_b)
    group_a, group_b = np.searchsorted(x.last_a, i, "left"), np.searchsorted(x.last_b, j, "left")
    b_before = np.concatenate([[0], x.last_b + 1])
    ends_group, final = x.last_b[group_b] == j, np.append(x.doc_b[1:] != x.doc_b[:-1], np.ones(min(n_b, 1), bool))
    code = np.empty(n_a + n_b, np.int64)
    code[i + b_before[group_a]] = x.a.astype(np.int64) * 2 + (x.last_a[group_a] == i)
    code[j + x.last_a[group_b] + 1] = 2 * size_a + x.b.astype(np.int64) * 3 + ends_group + (ends_group & final)
    text = written.take(pa.array(code))
    size = np.bincount(x.doc_a, minlength=n_docs) + np.bincount(x.doc_b, minlength=n_docs)
    _, offs, data = text.buffers()
    at = np.frombuffer(offs, np.int32, len(text) + 1)[np.concatenate([[0], np.cumsum(size)])].tolist()
    view = memoryview(data) if data is not None else memoryview(b"")
    return [hashlib.sha256(view[s:e]).hexdigest() if e > s else "" for s, e in zip(at[:-1], at[1:], strict=True)]


@lru_cache(maxsize=1)
def _held(path_a: str, path_b: str) -> Tokenizers:
    return Tokenizers(path_a, path_b)


BLOCK_SCHEMA = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<int>, times array<int>, pair array<long>, docs array<int>"
_ARROW = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")], ("groups_sha256", pa.string()), ("pairs", pa.list_(pa.int32())), ("times", pa.list_(pa.int32())), ("pair", pa.list_(pa.int64())), ("docs", pa.list_(pa.int32()))])


class Block:
    """Documents that share one list of pairs."""

    def __init__(self, number: int):
        self.number, self.bytes, self.parts, self.links = number, 0, [], []
        self.n_docs = 0

    def add(self, ids: pa.Array, texts: pa.Array, tok: Tokenizers) -> None:
        n = len(ids)
        x = align(*tok.encode(texts), tok.length_a, tok.length_b)
        link_doc = x.doc_a[x.link_a]
        pair = x.a[x.link_a].astype(np.int64) << 32 | x.b[x.link_b]
        # times of each pair in each document
        counted = pa.table({"doc": link_doc, "pair": pair}).group_by(["doc", "pair"], use_threads=False).aggregate([([], "count_all")])
        self.links.append(pa.table({"doc": pc.cast(pc.add(counted["doc"], self.n_docs), pa.int32()), "pair": counted["pair"], "times": counted["count_all"].cast(pa.int32())}))
        of = lambda doc: np.bincount(doc, minlength=n)
        self.parts.append([ids, of(x.doc_a), of(x.doc_b), of(x.doc_group), of(link_doc), written_groups(x, n, tok.written, len(tok.bytes_a))])
        self.n_docs += n
        self.bytes += texts.nbytes

    def rows(self) -> Iterator[pa.RecordBatch]:
        links = pa.concat_tables(self.links).combine_chunks()
        docs_of = links.group_by("pair", use_threads=False).aggregate([([], "count_all")])
        pair = docs_of["pair"].combine_chunks()
        doc = links["doc"].to_numpy()
        order = np.argsort(doc, kind="stable")
        place = pc.index_in(links["pair"], pair).to_numpy()[order]
        times = links["times"].to_numpy()[order]
        at = np.searchsorted(doc[order], np.arange(self.n_docs + 1))
        nothing = lambda n, t: pa.nulls(n, t)
        start = 0
        for ids, *numbers, sha in self.parts:
            n = len(ids)
            for i in range(0, n, 256):
                k = min(256, n - i)
                o = at[start + i : start + i + k + 1]
                lists = [pa.ListArray.from_arrays(pa.array(o - o[0], pa.int32()), pa.array(v[o[0] : o[-1]].astype(np.int32))) for v in (place, times)]
                cols = [pa.array(np.full(k, self.number)), ids.slice(i, k), *[pa.array(v[i : i + k]) for v in numbers], pa.array(sha[i : i + k], pa.string()), *lists]
                yield pa.record_batch([*[c.cast(f.type) for c, f in zip(cols, _ARROW, strict=False)], nothing(k, _ARROW.field("pair").type), nothing(k, _ARROW.field("docs").type)], schema=_ARROW)
            start += n
        if len(pair):
            whole = [pa.ListArray.from_arrays(pa.array([0, len(pair)], pa.int32()), v) for v in (pair, docs_of["count_all"].combine_chunks().cast(pa.int32()))]
            yield pa.record_batch([pa.array([self.number]), *[nothing(1, f.type) for f in list(_ARROW)[1:-2]], *whole], schema=_ARROW)


def _blocks_task(path_a: str, path_b: str, slice_bytes: int, block_bytes: int):
    def run(batches) -> Iterator[pa.RecordBatch]:
        tok = _held(path_a, path_b)
        number = TaskContext.get().partitionId() << 32
        block = Block(number)
        for whole in batches:
            for b in slices(whole, "text", slice_bytes):
                if b.num_rows:
                    block.add(b.column(0), b.column(1), tok)
                if block.bytes >= block_bytes:
                    yield from block.rows()
                    number += 1
                    block = Block(number)
        if block.n_docs:
            yield from block.rows()

    return run


def _sums(docs: pa.Table, counts: pa.Table) -> pa.Table:
    count, best = np.zeros(counts.num_rows, np.int64), np.zeros(counts.num_rows, np.int64)
    at = counts["at"].to_numpy()
    count[at], best[at] = counts["total"].to_numpy(), counts["best"].to_numpy()
    docs = docs.combine_chunks()
    pairs, times = docs["pairs"].combine_chunks(), docs["times"].combine_chunks()
    doc, p, t = pc.list_parent_indices(pairs).to_numpy(zero_copy_only=False), pc.list_flatten(pairs).to_numpy(zero_copy_only=False), pc.list_flatten(times).to_numpy(zero_copy_only=False).astype(np.int64)

    def total(v: np.ndarray) -> pa.Array:
        c = np.concatenate([[0], np.cumsum(v)])
        return pa.array(c[np.searchsorted(doc, np.arange(docs.num_rows), "right")] - c[np.searchsorted(doc, np.arange(docs.num_rows), "left")], pa.int64())

    out = docs.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
    return out.append_column("n_best", total(t * best[p])).append_column("count_sum", total(t * count[p])).append_column("groups_sha256", docs["groups_sha256"])


def alignment(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, slice_bytes: int = SLICE, block_bytes: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The documents' alignment, and the pairs (a, b, docs): how many documents link the two ids."""
    spark = docs.sparkSession
    small_batches(spark)
    defaults = default_paths()
    path_a, path_b = path_a or defaults[0], path_b or defaults[1]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    blocks = materialize(texts.mapInArrow(_blocks_task(path_a, path_b, slice_bytes, block_bytes), BLOCK_SCHEMA), "blocks")
    lists = blocks.filter(F.col("pair").isNotNull()).select("block", F.posexplode(F.arrays_zip("pair", "docs")).alias("at", "x")).select("block", "at", F.col("x.pair").alias("pair"), F.col("x.docs").alias("docs"))
    totals = materialize(lists.groupBy("pair").agg(F.sum("docs").alias("total")), "pairs")
    a = F.shiftright("pair", 32)
    highest = totals.groupBy(a.alias("a")).agg(F.max("total").alias("highest"))  # one row for an id of A at most
    with_best = totals.join(F.broadcast(highest), a == F.col("a")).select("pair", "total", (F.col("total") == F.col("highest")).cast("int").alias("best"))
    counts = lists.select("block", "at", "pair").join(with_best, "pair").select(F.col("block").alias("of_block"), "at", "total", "best")
    rows = blocks.filter(F.col("pair").isNull()).drop("pair", "docs")
    out = rows.groupBy("block").cogroup(counts.groupBy("of_block")).applyInArrow(_sums, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    return out, totals.select(a.alias("a"), F.col("pair").bitwiseAND(0xFFFFFFFF).alias("b"), F.col("total").alias("docs"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment(table(spark, sf_dir, "documents"))[0]
