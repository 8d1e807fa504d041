"""Dense vectors: normalisation, a hashing embedder, exact cosine search by blocks of queries."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators.blocks import best, packed, query_parts, ranked_rows, unpacked
from docloom.session import cut_lineage

#: Vectors of queries that a task holds at most.
QUERIES_PER_PASS = 2048
#: Vectors that are compared with them at once.
ROWS_PER_BLOCK = 1024
#: More than rounding to six digits changes.
SLACK = 2e-6


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def normalised(vector: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    return T.let(norm(vector), lambda size: F.transform(vector, lambda x: x.cast("double") / F.when(size > 0, size).otherwise(F.lit(1.0))))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def hash_slot(word: Column, dim: int = 64) -> Column:
    """md5 modulo ``dim`` (a power of two up to 256, so the last two digits decide)."""
    return F.pmod(F.conv(F.substring(F.md5(word), 31, 2), 16, 10).cast("int"), F.lit(dim))


def embedded(text: Column, dim: int = 64) -> Column:
    """The default embedder as an Arrow UDF: unit bag-of-words counts by ``hash_slot``; null texts give zero vectors."""
    memo: dict[str, int] = {}

    @F.pandas_udf("array<double>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        find = re.compile("[a-z0-9]+").findall
        for texts in batches:
            rows = np.zeros((len(texts), dim))
            for at, value in enumerate(texts):
                for word in find((value or "").lower()):
                    slot = memo.get(word)
                    if slot is None:
                        if len(memo) > 200_000:
                            memo.clear()
                        slot = memo[word] = int(hashlib.md5(word.encode()).hexdigest()[-2:], 16) % dim
                    rows[at, slot] += 1
            size = np.linalg.norm(rows, axis=1, keepdims=True)
            yield pd.Series(list(rows / np.where(size > 0, size, 1)))

    return embed(text)


def top_k(vectors: DataFrame, key: str, vector: str, queries: DataFrame, k: int, query: str = "query_id") -> DataFrame:
    """(query, key, score, rank): the ``k`` nearest vectors of each query by cosine, exactly, ties by key; keys and queries of any type.

    Vectors are written once, in blocks; each part of the queries, ``QUERIES_PER_PASS`` at most, meets block after block and keeps its best, so
    nothing a pair is ever shuffled.
    """
    asked = queries.select(F.col(query).alias("q"), normalised(F.col(vector)).alias("v")).where("q is not null and v is not null")
    kept = vectors.select(F.col(key).alias("key"), normalised(F.col(vector)).alias("v")).where(F.col("v").isNotNull())
    schema = f"`{query}` {asked.schema['q'].dataType.simpleString()}, `{key}` {kept.schema['key'].dataType.simpleString()}, score double, rank int"
    return best(query_parts(asked, "q", asked.count(), QUERIES_PER_PASS), written(kept, ROWS_PER_BLOCK), lambda part: _Nearest(part, k), schema)


def written(vectors: DataFrame, most: int) -> DataFrame:
    """Rows of a key and a vector as blocks of ``most`` rows, written."""
    return cut_lineage(vectors.mapInArrow(_vector_blocks(most), "block binary"))


def matrix(vectors) -> np.ndarray:
    """A row for each vector of an Arrow array; null is a zero vector."""
    flat, given = np.asarray(vectors.flatten(), dtype=np.float64), np.asarray(vectors.is_valid())
    if given.all():
        return flat.reshape(len(vectors), -1)
    out = np.zeros((len(vectors), len(flat) // max(int(given.sum()), 1)))
    out[given] = flat.reshape(int(given.sum()), out.shape[1])
    return out


def _vector_blocks(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, most):
                part = batch.slice(first, most)
                keys = pa.concat_arrays([part.column(0)]) if part.num_rows == batch.num_rows else part.column(0).take(pa.array(range(part.num_rows)))
                yield pa.RecordBatch.from_arrays([pa.array([packed((keys, matrix(part.column(1))))], pa.binary())], ["block"])

    return run


class _Nearest:
    """The ``k`` nearest vectors of each of a part's queries, over the blocks met so far."""

    def __init__(self, part: pa.Table, k: int):
        self.k, self.names, self.asked, self.kind = k, part["q"].combine_chunks(), matrix(part["v"].combine_chunks()), pa.null()
        self.top: list[list] = [[] for _ in range(len(self.names))]
        self.least = np.full(len(self.names), -np.inf)

    def meet(self, block: bytes) -> None:
        keys, own = unpacked(block)
        self.kind, names, k = keys.type, keys.to_pylist(), self.k
        scores = self.asked @ own.T
        floor = self.least
        if len(own) > k and not np.isfinite(floor).all():
            floor = np.maximum(floor, np.partition(scores, len(own) - k, axis=1)[:, len(own) - k])
        queries, rows = np.nonzero(scores >= (floor - SLACK)[:, None])  # everything that may tie with the k-th
        found = np.round(scores[queries, rows], 6).tolist()
        ends = np.r_[0, np.cumsum(np.bincount(queries, minlength=len(self.top)))].tolist()
        rows = rows.tolist()
        for q in np.unique(queries).tolist():
            top = self.top[q]
            top += [(-found[i], names[rows[i]] is not None, names[rows[i]]) for i in range(ends[q], ends[q + 1])]
            top.sort()
            del top[k:]
            if len(top) == k:
                self.least[q] = -top[-1][0]

    def result(self) -> Iterator[pa.RecordBatch]:
        yield ranked_rows(self.names, self.top, self.kind)


def embedder(name: str | None = "hashing", dim: int = 64, plugged: dict | None = None):
    """A function from a text column to a vector column, or None where none can be had, which leaves keyword search.

    ``plugged`` maps further names to functions that make one; one that fails counts as not to be had.
    """
    if name in (None, "", "none"):
        return None
    if name == "hashing":
        return lambda text: embedded(text, dim)
    try:
        return (plugged or {})[name]()
    except Exception:  # noqa: BLE001 - a plug-in may fail in any way
        return None


def embedder_of(encode, prefix: str = "", batch: int = 32):
    """An embedder from ``encode`` (a list of texts to a list of vectors), called ``batch`` texts at a time in their order; queries of models
    that ask for one get a ``prefix``."""

    def make(text: Column) -> Column:
        @F.pandas_udf("array<double>")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                rows: list = []
                for first in range(0, len(texts), batch):
                    rows += [np.asarray(v, dtype=float) for v in encode([prefix + (t or "") for t in texts.iloc[first : first + batch]])]
                yield pd.Series(rows)

        return run(text)

    return make
