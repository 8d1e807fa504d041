"""Problem 8: encoding a corpus with a public byte-level BPE vocabulary.

Method: contiguous rank array. A word (one match of the vocabulary's split pattern, as bytes) is held as its part boundaries and the
ranks of adjacent part pairs; the smallest rank is looked for again and again, the boundary it stands for is deleted and the two
neighbouring ranks are refreshed. Words beyond ``SCAN_BYTES`` keep the same order of merges in a heap, as scanning would be quadratic.

The job is one narrow stage: no shuffle, no broadcast; every Python worker loads the vocabulary file (about a megabyte) once.

Defined cases: null text -> null; empty text -> empty list; strings that look like special tokens are ordinary text; nothing is trimmed
or normalised; unpaired surrogates can't occur in Spark strings. Repeated rows stay repeated rows; other columns are not passed on.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY_DIR = os.environ.get("DOCLOOM_TOKENIZERS", "/opt/tokenizers")
SCAN_BYTES = 256
MEMO_ENTRIES = 200_000
#: Fixed value: the split pattern that belongs to the public byte_bpe vocabularies.
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_NONE = 1 << 62


def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a vocabulary file with one ``base64 rank`` pair a line."""
    ranks = {}
    with open(path, "rb") as lines:
        for line in lines:
            token, _, rank = line.strip().partition(b" ")
            if token:
                ranks[base64.b64decode(token)] = int(rank)
    return ranks


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one word, by the contiguous rank array."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    if len(word) > SCAN_BYTES:
        return _merge_long(word, ranks)
    bounds = list(range(len(word) + 1))
    pairs = [ranks.get(word[i : i + 2], _NONE) for i in range(len(word) - 1)]
    while pairs:
        least = min(pairs)
        if least == _NONE:
            break
        at = pairs.index(least)
        del bounds[at + 1], pairs[at]
        if at < len(pairs):
            pairs[at] = ranks.get(word[bounds[at] : bounds[at + 2]], _NONE)
        if at:
            pairs[at - 1] = ranks.get(word[bounds[at - 1] : bounds[at + 1]], _NONE)
    return [ranks[word[a:b]] for a, b in zip(bounds, bounds[1:], strict=False)]


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges in the same order (lowest rank, then leftmost), from a heap over a linked list of parts."""
    size = len(word)
    after, before = list(range(1, size + 1)), list(range(-1, size - 1))
    alive = [True] * size
    heap = []

    def offer(left: int) -> None:
        right = after[left]
        if right < size and (rank := ranks.get(word[left : after[right]])) is not None:
            heap.append((rank, left, after[right])) if not heap else heapq.heappush(heap, (rank, left, after[right]))

    for left in range(size - 1):
        offer(left)
    while heap:
        _, left, end = heapq.heappop(heap)
        if not alive[left] or after[left] >= size or after[after[left]] != end:
            continue
        gone = after[left]
        alive[gone] = False
        after[left] = end
        if end < size:
            before[end] = left
        offer(left)
        if before[left] >= 0:
            offer(before[left])
    out, at = [], 0
    while at < size:
        out.append(ranks[word[at : after[at]]])
        at = after[at]
    return out


class Encoder:
    """Encodes texts; remembers the ids of chunks between single blanks, in which a split pattern's words never reach over a blank."""

    def __init__(self, path: str):
        import regex

        self.ranks = load_ranks(path)
        self.split = regex.compile(SPLIT_PATTERN).findall
        self.memo: dict[str, bytes] = {}

    def words(self, text: str) -> bytes:
        ids: list[int] = []
        for word in self.split(text):
            ids += merge_word(word.encode("utf-8"), self.ranks)
        return np.asarray(ids, dtype=np.int32).tobytes()

    def chunk(self, chunk: str) -> bytes | None:
        """The ids of a chunk with the blank before it; None where the chunk touches white space, so that words may cross it."""
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            return None
        ids = self.words(" " + chunk)
        if len(self.memo) >= MEMO_ENTRIES:
            self.memo.clear()
        self.memo[chunk] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """The ids of a text as int32 bytes."""
        if not text:
            return b""
        first, *rest = text.split(" ")
        if not first or first[-1].isspace():
            return self.words(text)
        memo, parts = self.memo, [self.words(first)]
        for piece in rest:
            ids = memo.get(piece)
            if ids is None and (ids := self.chunk(piece)) is None:
                return self.words(text)
            parts.append(ids)
        return b"".join(parts)


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """``id_col`` and ``ids`` (array of int) of every row; other columns, whatever their names, are left behind."""
    path = os.path.join(folder or VOCABULARY_DIR, f"{vocabulary}.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path).encode
        for batch in batches:
            coded = [None if text is None else encode(text) for text in batch.column(1).to_pylist()]
            sizes = np.fromiter((0 if c is None else len(c) // 4 for c in coded), dtype=np.int32, count=len(coded))
            offsets = np.concatenate([np.zeros(1, dtype=np.int32), np.cumsum(sizes, dtype=np.int32)])
            values = pa.array(np.frombuffer(b"".join(c for c in coded if c), dtype=np.int32))
            missing = pa.array([c is None for c in coded], type=pa.bool_())
            ids = pa.ListArray.from_arrays(pa.array(offsets), values, mask=missing)
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["key", "ids"])

    kept = df.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    kind = kept.schema["key"].dataType.simpleString()
    return kept.mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", id_col)
