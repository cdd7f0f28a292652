"""Cost-balanced packing of tokenised documents into sequences of a fixed length.

A piece's cost is linear plus quadratic in its tokens (`LINEAR * n + n * n / capacity`), an estimate of what
attention does with it. Every task packs the documents it reads, block by block, so packing needs no shuffle: whole
sequences are cut off long documents first, the remaining pieces are taken in descending order, each to the
lowest-cost open sequence that has room for it, and those that fit nowhere are cut over the lowest-cost sequences
that have room left. Only full sequences leave a block; what an unfilled one holds goes on to the next block. The
last sequence of a task is cut at powers of two, where sequences need no padding.

Defined results: a null text counts as empty, and an empty text still has its end id; repeated rows are documents each;
doc_id may be null; texts of any length are packed whole; columns other than doc_id and text are ignored; an
empty table gives an empty result. Where a text spells the vocabulary's special token, it gets that token's id, as the
tokenizer has it.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import lean, table

CAPACITY, END_ID, LINEAR = 1024, 0, 1.0
#: Documents, or tokens, that a task packs together, and words whose ids a task remembers.
BLOCK_DOCS, BLOCK_TOKENS, REMEMBERED = 2048, 2_000_000, 200_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long"
_SPACE = "\\s\\x1c-\\x1f\\x85"
_CUT_UNSAFE = re.compile(f"[{_SPACE}] | [{_SPACE}]|^ | $")


class WordIds(dict):
    """Ids (little-endian uint32 bytes) by word, for a vocabulary whose pattern never joins what a single space between two other characters parts.

    Word by word gives the ids of the whole text then; texts with other runs of white space are encoded as one."""

    def __init__(self, path: str | None = None):
        """path: a tokenizers file. Without one it is the 50k vocabulary, whose ranks give the same ids faster for all texts that don't spell its special token."""
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path or public_tokenizers.path("byte_bpe_50k.json"))
        self.encode = self.encode_any = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
        if not path:
            with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.encode = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.special = re.compile("|".join(re.escape(t.content) for t in tokenizer.get_added_tokens_decoder().values()) or "(?!)")

    def __missing__(self, word: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        ids = np.array(self.encode(word), "<u4").tobytes()
        if len(word) < 40:
            self[word] = ids
        return ids

    def ids(self, text: str) -> bytes:
        if self.special.search(text):
            return np.array(self.encode_any(text), "<u4").tobytes()
        if _CUT_UNSAFE.search(text):
            return np.array(self.encode(text), "<u4").tobytes()
        words = text.split(" ")
        return self[words[0]] + b"".join(map(self.__getitem__, [" " + w for w in words[1:]]))


def cost(n: float) -> float:
    return LINEAR * n + n * n / CAPACITY


def pack(lengths: list[int], capacity: int = CAPACITY, carried: int = 0) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start, length) for documents of these lengths; the last list has what didn't fill a sequence.

    carried: tokens that the first open sequence already holds (as document -1)."""
    full, rest = [], []
    for d, n in enumerate(lengths):
        full += [[(d, s, capacity)] for s in range(0, n - capacity + 1, capacity)]
        if n % capacity:
            rest.append((n % capacity, d, n - n % capacity))
    rest.sort(key=lambda p: (-p[0], p[1]))
    total = carried + sum(p[0] for p in rest)
    count = -(-total // capacity)
    if not count:
        return full, []
    room, costs, held = np.full(count, capacity), np.zeros(count), [[] for _ in range(count)]
    left_open = count - 1  # the sequence that may stay unfilled
    room[left_open] = total - (count - 1) * capacity
    if carried:  # what was carried stays together in a sequence of its own; the unfilled one is another, or this one if it is alone
        at = 0 if count > 1 else left_open
        held[at], room[at], costs[at] = [(-1, 0, carried)], room[at] - carried, cost(carried)
    if room[left_open] < 0:
        raise ValueError("carried is more than a sequence")
    late = []

    def put(at: int, d: int, s: int, n: int) -> None:
        held[at].append((d, s, n))
        room[at] -= n
        costs[at] += cost(n)

    for n, d, s in rest:
        at = int(np.where(room >= n, costs, np.inf).argmin())
        if room[at] >= n:
            put(at, d, s, n)
        else:
            late.append((n, d, s))
    for n, d, s in late:
        while n:
            at = int(np.where(room > 0, costs, np.inf).argmin())
            part = int(min(n, room[at]))
            put(at, d, s, part)
            n, s = n - part, s + part
    if total % capacity == 0:
        return full + held, []
    return full + held[:left_open], held[left_open]


def cut_at_powers(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """The pieces in sequences whose lengths are falling powers of two."""
    out, total = [], sum(p[2] for p in pieces)
    queue = list(reversed(pieces))
    while total:
        size = 1 << (total.bit_length() - 1)
        total, own = total - size, []
        while size:
            d, s, n = queue.pop()
            part = min(n, size)
            own.append((d, s, part))
            size -= part
            if n > part:
                queue.append((d, s + part, n - part))
        out.append(own)
    return out


@lean
def _packed(batches: Iterator[pa.RecordBatch], tokenizer_path: str | None, capacity: int) -> Iterator[pa.RecordBatch]:
    words, end = WordIds(tokenizer_path), np.array([END_ID], "<u4").tobytes()
    first, made = TaskContext.get().partitionId() << 40, 0
    unfilled: list[tuple] = []  # pieces: doc_id, start, ids as bytes, tokens of the document

    def rows(sequences: list[list[tuple]]) -> pa.RecordBatch:
        nonlocal made
        out = []
        for pieces in sequences:
            at, total = 0, sum(len(ids) for _, _, ids, _ in pieces) // 4
            for doc_id, start, ids, tokens in pieces:
                out.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), tokens, first + made, at, total))
                at += len(ids) // 4
            made += 1
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 8, names=[x.split()[0] for x in SCHEMA.split(", ")])

    def block(docs: list[tuple[int | None, bytes]]) -> pa.RecordBatch:
        nonlocal unfilled
        full, rest = pack([len(ids) // 4 for _, ids in docs], capacity, sum(len(p[2]) for p in unfilled) // 4)

        def pieces(seq: list[tuple[int, int, int]]) -> list[tuple]:
            return [p for d, s, n in seq for p in (unfilled if d < 0 else [(docs[d][0], s, docs[d][1][4 * s : 4 * (s + n)], len(docs[d][1]) // 4)])]

        full, unfilled = [pieces(s) for s in full], pieces(rest)
        return rows(full)

    docs: list[tuple[int | None, bytes]] = []
    size = 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            docs.append((doc_id, (words.ids(text.as_py()) if text.is_valid else b"") + end))
            size += len(docs[-1][1]) // 4
            if len(docs) >= BLOCK_DOCS or size >= BLOCK_TOKENS:
                yield block(docs)
                docs, size = [], 0
    if docs:
        yield block(docs)
    if unfilled:
        last = cut_at_powers([(n, 0, len(p[2]) // 4) for n, p in enumerate(unfilled)])
        yield rows([[(unfilled[n][0], unfilled[n][1] + s, unfilled[n][2][4 * s : 4 * (s + size)], unfilled[n][3]) for n, s, size in seq] for seq in last])


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, tokenizer_path: str | None = None) -> DataFrame:
    """A row for each piece of docs (doc_id, text): where it lies in its document and in its sequence.

    tokenizer_path: a tokenizers file of a byte-level BPE; None takes the 50k vocabulary of public_tokenizers."""
    ids = docs.selectExpr("cast(doc_id as long) as doc_id", "text")
    return ids.mapInArrow(lambda batches: _packed(batches, tokenizer_path, capacity), SCHEMA)


def op2_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
