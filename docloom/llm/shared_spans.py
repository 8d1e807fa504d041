"""Problem 4: stretches of at least ``SPAN`` characters that stand, exactly the same, in more than one record.

Method: De Bruijn compaction. Token k-mers are the edges of a graph; repeated edges that follow one another without a branch are
compacted to paths through Spark joins, and source coordinates then verify the stretches at their ends, character by character.

1. Records with the same text are one class; a class of several records is shared as a whole.
2. Every class emits the k-mers of its tokens that are the least (by hash) of some ``REACH`` characters. Two texts that share ``SPAN``
   characters select the same k-mer inside them: token starts depend on the characters before them by at most ``LONG`` characters, so
   beyond the first ``LONG`` both texts are cut alike. Each k-mer is an edge twice, with half of the remaining ``SPAN`` characters after it
   and with half before it; a shared stretch holds at least one of the two, and edges that long seldom repeat by chance.
3. An aggregate by edge (map-side combine) keeps those found in two classes, and a join brings them back to their places. A second one
   tells whether all occurrences of an edge come from and go on to the same next k-mer; neighbours without a branch between them become
   one path. Two classes hold the whole text of a path, so one of ``SPAN`` characters or more is shared for certain.
4. Along each path every window of ``SPAN`` characters that holds one of its edges is hashed at its place in the source; windows found in
   two classes are shared, which settles the ends of stretches to the character. An aggregate and a join again; no pairs of records are ever formed, so a stretch that a third of all records hold costs no
   more than one that two hold.

Hashes are 64 bits of a polynomial over mixed characters; equal hashes are taken as equal text (for a thousand million windows, one
chance in forty of a single wrong window).

Defined cases: null texts, blank texts and texts under ``SPAN`` characters share nothing; rows with the same record and text count once;
a record with several texts keeps the smallest; characters are code points; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.session import cut_lineage

SPAN = 100
K = 3
LONG = 12
REACH = SPAN - 2 * (LONG + 1)

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LETTERS: list[np.ndarray] = []


def _is_word(codes: np.ndarray) -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalnum() for c in range(0x10000)), dtype=bool, count=0x10000))
    out = _LETTERS[0][np.minimum(codes, 0xFFFF)]
    for at in np.flatnonzero(codes > 0xFFFF).tolist():
        out[at] = chr(int(codes[at])).isalnum()
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Coded:
    """Code points of some texts, one after another with a zero between, and prefix sums from which the hash of any stretch follows."""

    def __init__(self, texts: list[str]):
        parts = [np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for text in texts]
        sizes = np.array([len(part) + 1 for part in parts], dtype=np.int64)
        self.ends = np.cumsum(sizes) - 1
        self.starts = self.ends - sizes + 1
        zero = np.zeros(1, dtype=np.uint32)
        self.codes = np.concatenate([piece for part in parts for piece in (part, zero)] or [zero])
        size = len(self.codes)
        steps = np.full(size + 1, _BASE, dtype=np.uint64)
        steps[0] = 1
        powers = np.cumprod(steps, dtype=np.uint64)
        steps[1:] = _INVERSE
        self.inverse = np.cumprod(steps, dtype=np.uint64)
        self.prefix = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_mix(self.codes.astype(np.uint64) + np.uint64(1)) * powers[:-1], dtype=np.uint64)])

    def hashes(self, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
        return _mix((self.prefix[ends] - self.prefix[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64) + np.uint64(salt << 40)).view(np.int64)

    def token_starts(self) -> np.ndarray:
        word, codes = _is_word(self.codes), self.codes
        before = np.concatenate([[False], word[:-1]])
        at = np.arange(len(codes))
        run = at - np.maximum.accumulate(np.where(word & ~before, at, 0))
        starts = (word & (~before | (run >= LONG))) | (~word & ~((codes == 32) & before))
        starts[self.ends] = False
        return np.flatnonzero(starts)

    def selected(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the k-mers that are the least of some ``REACH`` characters, and the text each is of."""
        starts = self.token_starts()
        owner = np.searchsorted(self.ends, starts)
        whole = np.flatnonzero(owner[:-K] == owner[K:]) if len(starts) > K else np.zeros(0, dtype=np.int64)
        begin, end, owner = starts[whole], starts[whole + K], owner[whole]
        if not len(begin):
            return begin, end, owner
        hashed = self.hashes(begin, end)
        last = np.minimum(np.searchsorted(end, begin + REACH, side="right") - 1, np.searchsorted(owner, owner, side="right") - 1)
        least, index, step = hashed.copy(), np.arange(len(begin)), 1
        inside = index[index + 1 <= last]
        while len(inside):
            least[inside] = np.minimum(least[inside], hashed[inside + step])
            step += 1
            inside = inside[inside + step <= last[inside]]
        keep = hashed == least
        for back in range(1, step):
            inside = index[index + back <= last]
            keep[inside[hashed[inside + back] == least[inside]] + back] = True
        return begin[keep], end[keep], owner[keep]

    def edges(self) -> dict[str, np.ndarray]:
        """The selected k-mers as edges: each with its right and its left reach, so long that a shared stretch holds one of the two."""
        begin, end, owner = self.selected()
        reach = (SPAN - (end - begin)) // 2
        same = owner[1:] == owner[:-1]
        follow = np.zeros(len(begin), dtype=np.int64)
        if len(begin) > 1:
            follow[:-1][same] = self.hashes(begin[:-1][same], end[1:][same])
        before = np.zeros(len(begin), dtype=np.int64)
        before[1:][same] = follow[:-1][same]
        right = np.flatnonzero(end + reach <= self.ends[owner])
        left = np.flatnonzero(begin - reach >= self.starts[owner])
        shift = self.starts[owner]
        place = lambda x: np.concatenate([x[right], x[left]])
        return {
            "owner": place(owner),
            "h": np.concatenate([self.hashes(begin[right], (end + reach)[right], 1), self.hashes((begin - reach)[left], end[left], 2)]),
            "begin": place(begin - shift).astype(np.int32),
            "end": place(end - shift).astype(np.int32),
            "side": np.concatenate([np.ones(len(right), dtype=np.int8), np.zeros(len(left), dtype=np.int8)]),
            "prev": place(before),
            "next": place(follow),
        }


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, Coded]]:
    """The texts of a batch (class, text), a million characters or so at a time."""
    classes, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
    first, size = 0, 0
    for at, text in enumerate(texts):
        size += len(text)
        if size > 1_000_000 or at + 1 == len(texts):
            yield classes[first : at + 1], Coded(texts[first : at + 1])
            first, size = at + 1, 0


def _edge_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for classes, coded in _pieces(batch):
            edges = coded.edges()
            yield pa.RecordBatch.from_arrays([pa.array(edges["h"]), pa.array(classes[edges["owner"]])], ["h", "cls"])


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for classes, coded in _pieces(batch):
            edges = coded.edges()
            yield pa.RecordBatch.from_arrays([pa.array(classes[edges["owner"]]), *(pa.array(edges[c]) for c in ("h", "begin", "end", "side", "prev", "next"))], ["cls", "h", "begin", "end", "side", "prev", "next"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names: list[np.ndarray] = []
        starts: list[np.ndarray] = []
        hashes: list[np.ndarray] = []
        for cls, text, paths in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            coded = Coded([text])
            room = len(coded.codes) - SPAN
            if room <= 0:
                continue
            wanted = np.zeros(room, dtype=bool)
            for path in paths:
                for lo, hi in ((path["r0"], path["r1"]), (path["l0"], path["l1"])):
                    if lo is not None:
                        wanted[max(0, lo) : max(0, hi + 1)] = True
            at = np.flatnonzero(wanted)
            names.append(np.full(len(at), cls, dtype=np.int64))
            starts.append(at.astype(np.int32))
            hashes.append(coded.hashes(at, at + SPAN))
        join = lambda parts, kind: pa.array(np.concatenate(parts) if parts else np.zeros(0, dtype=kind))
        yield pa.RecordBatch.from_arrays([join(names, np.int64), join(hashes, np.int64), join(starts, np.int32)], ["cls", "w", "start"])


def shared_spans(records: DataFrame) -> DataFrame:
    """Rows (record_id, start_pos, span_len) from ``records`` (record_id STRING, text STRING): each longest run of shared characters."""
    kept = records.select("record_id", "text").where((F.length("text") >= SPAN) & F.col("text").rlike(r"\S") & F.col("record_id").isNotNull())
    once = kept.groupBy("record_id").agg(F.min("text").alias("text"))
    members = once.select("record_id", F.xxhash64("text").alias("cls"), F.length("text").alias("size"), "text")
    classes = members.groupBy("cls", "text", "size").agg(F.count("*").alias("copies"))
    texts = classes.select("cls", "text")

    hashed = texts.mapInArrow(_edge_hashes, "h bigint, cls bigint")
    repeated = hashed.groupBy("h").agg(F.min("cls").alias("c0"), F.max("cls").alias("c1")).where("c0 < c1").select("h")
    edges = texts.mapInArrow(_edges, "cls bigint, h bigint, begin int, end int, side tinyint, prev bigint, next bigint").join(repeated, "h", "left_semi")
    edges = cut_lineage(edges)
    branches = edges.where("side = 1").groupBy("h").agg(F.expr("min(prev) = max(prev) and min(prev) <> 0").alias("one_in"), F.expr("min(next) = max(next) and min(next) <> 0").alias("one_out"))

    reach = F.floor((SPAN - (F.col("end") - F.col("begin"))) / 2).cast("int")
    along = Window.partitionBy("cls").orderBy("begin", "end")
    rights = edges.where("side = 1").join(branches, "h").withColumn("to", F.col("end") + reach).withColumn("before", F.lag(F.struct("one_out", "begin", "next")).over(along))
    joins = F.coalesce(F.col("one_in") & F.col("before.one_out") & (F.col("before.next") == F.col("prev")), F.lit(False))
    numbered = rights.withColumn("path", F.sum(F.when(joins, 0).otherwise(1)).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    none = F.lit(None).cast("int")
    compact = numbered.groupBy("cls", "path").agg(F.min("begin").alias("a"), F.max("to").alias("b"), F.min(F.col("to") - SPAN).alias("r0"), F.max("begin").alias("r1"))
    compact = compact.select("cls", "a", "b", "r0", "r1", none.alias("l0"), none.alias("l1"))
    lefts = edges.where("side = 0").select("cls", none.alias("a"), none.alias("b"), none.alias("r0"), none.alias("r1"), (F.col("end") - SPAN).alias("l0"), (F.col("begin") - reach).alias("l1"))
    paths = compact.unionByName(lefts)

    sides = paths.groupBy("cls").agg(F.collect_list(F.struct("r0", "r1", "l0", "l1")).alias("paths"))
    windows = texts.join(sides, "cls").select("cls", "text", "paths").mapInArrow(_windows, "cls bigint, w bigint, start int")
    common = windows.groupBy("w").agg(F.min("cls").alias("c0"), F.max("cls").alias("c1")).where("c0 < c1").select("w")
    verified = windows.join(common, "w", "left_semi").select("cls", F.col("start").alias("a"), (F.col("start") + SPAN).alias("b"))
    certain = compact.where(F.col("b") - F.col("a") >= SPAN).select("cls", "a", "b")
    runs = _islands(verified.unionByName(certain))

    whole = classes.where("copies > 1").select("cls", F.lit(0).alias("a"), F.col("size").alias("b"))
    runs = runs.join(whole, "cls", "left_anti").unionByName(whole)
    return members.select("record_id", "cls").join(runs, "cls").select("record_id", (F.col("a") + 1).cast("int").alias("start_pos"), (F.col("b") - F.col("a")).cast("int").alias("span_len"))


def _islands(pieces: DataFrame) -> DataFrame:
    """Stretches [a, b) of each class merged where they overlap or touch."""
    order = Window.partitionBy("cls").orderBy("a", "b")
    reach = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = pieces.withColumn("new", F.when(F.coalesce(F.col("a") <= reach, F.lit(False)), 0).otherwise(1))
    island = marked.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy("cls", "island").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("island")


def passages_and_quotes(citations: DataFrame, qa_items: DataFrame) -> DataFrame:
    """Passages by chunk_id and evidence quotes by ``id:position``."""
    passages = citations.select(F.col("chunk_id").alias("record_id"), "text")
    quotes = qa_items.where("id is not null").select("id", F.posexplode("evidence").alias("at", "quote"))
    quotes = quotes.select(F.concat_ws(":", "id", (F.col("at") + 1).cast("string")).alias("record_id"), F.col("quote.text").alias("text"))
    return passages.unionByName(quotes)


def share_of_records(records: DataFrame) -> DataFrame:
    """(record_id, n_chars, shared_chars, shared_share): how much of each record stands elsewhere too; records without any have 0."""
    sizes = records.where("record_id is not null").groupBy("record_id").agg(F.min("text").alias("text")).select("record_id", F.coalesce(F.length("text"), F.lit(0)).alias("n_chars"))
    shared = shared_spans(records).groupBy("record_id").agg(F.sum("span_len").alias("shared_chars"))
    joined = sizes.join(shared, "record_id", "left").withColumn("shared_chars", F.coalesce("shared_chars", F.lit(0).cast("bigint")))
    return joined.withColumn("shared_share", F.when(F.col("n_chars") > 0, F.round(F.col("shared_chars") / F.col("n_chars"), 6)).otherwise(F.lit(0.0)))
