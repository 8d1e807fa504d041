"""Queries against all items without a row a pair: a task holds a part of the queries while every block of items passes by."""

from __future__ import annotations

import ctypes
import pickle
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Queries a task holds at most.
QUERIES_PER_PART = 4096
#: Queries from which on a part of their own is worth a pass over the items.
LEAST_QUERIES = 256
#: Rows of a result that travel together.
ROWS_PER_BATCH = 50_000


def query_parts(queries: DataFrame, query: str, number: int, most: int = QUERIES_PER_PART) -> DataFrame:
    """(n, part): ``queries`` in one packed row a partition, ``number`` rows of them in all; parts are even, as queries are dealt by hash."""
    cores = queries.sparkSession.sparkContext.defaultParallelism
    parts = max(min(cores, -(-number // LEAST_QUERIES)), -(-number // most), 1)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            whole = pickle.dumps(pa.Table.from_batches(held).combine_chunks(), protocol=5)
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([whole], pa.binary())], ["n", "part"])

    return queries.repartition(parts, F.xxhash64(query)).mapInArrow(pack, "n int, part binary")


def best(parts: DataFrame, blocks: DataFrame, start: Callable, schema: str) -> DataFrame:
    """The rows of ``schema`` that ``start(part)`` gives once it has met every block of ``blocks`` (one binary column, written before).

    ``start`` makes of a table of queries an object with ``meet(bytes)`` and ``result()``, batches of rows. Blocks are read once for each part, one
    after the other; neither they nor anything a pair is shuffled, broadcast or brought to the driver.
    """

    def run(pairs: Iterable) -> Iterator[tuple[bytes]]:
        held: dict = {}
        for (n, part), (block,) in pairs:
            if n not in held:
                held[n] = start(pickle.loads(part))
            held[n].meet(bytes(block))
        state = None
        for n in list(held):
            state = held.pop(n)
            for batch in state.result():
                for first in range(0, batch.num_rows, ROWS_PER_BATCH):
                    yield (pickle.dumps(pa.Table.from_batches([batch.slice(first, ROWS_PER_BATCH)]).combine_chunks(), protocol=5),)
        del state
        give_back()

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in batch.column(0):
                yield from pickle.loads(one.as_py()).to_batches()

    met = parts.rdd.cartesian(blocks.coalesce(1).rdd).mapPartitions(run)
    return parts.sparkSession.createDataFrame(met, "part binary", verifySchema=False).mapInArrow(unpack, schema)


def give_back() -> None:
    """Returns freed memory to the system, as an executor keeps its Python workers beside the next stage's heap."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def packed(value) -> bytes:
    """A compressed pickle, led by its length."""
    whole = pickle.dumps(value, protocol=5)
    return len(whole).to_bytes(8, "little") + pa.compress(whole, codec="zstd", asbytes=True)


def unpacked(block: bytes):
    return pickle.loads(pa.decompress(block[8:], int.from_bytes(block[:8], "little"), codec="zstd", asbytes=True))


def ranked_rows(names: pa.Array, top: list[list], kind: pa.DataType) -> pa.RecordBatch:
    """(query, key, score, rank) of sorted lists of (-score, whether there is a key, key), one for each of ``names``."""
    sizes = np.array([len(x) for x in top], dtype=np.int64)
    flat = [x for own in top for x in own]
    ranks = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1
    columns = (names.take(pa.array(np.repeat(np.arange(len(sizes)), sizes))), pa.array([x[2] for x in flat], kind), pa.array([-x[0] for x in flat], pa.float64()), pa.array(ranks.astype(np.int32)))
    return pa.RecordBatch.from_arrays(list(columns), ["query", "key", "score", "rank"])
