"""Problem 9: evaluation items that occur, wholly or in part, in corpus documents.

Method: a BM25 inverted index of the items with block-max WAND. The index's terms are runs of ``TERM`` words; every document is a query against it.
Items lie in blocks of ``BLOCK``, items with the same rare terms together, and each term has, beside its postings, the blocks they lie in with its
largest contribution in each. A document sums these bounds over its own terms' blocks only; blocks whose sum stays below the threshold
are never opened, the postings of the others are scored, and items above the threshold are verified against the text. All lists
are sparse: a document that shares no term with any item costs one look-up of its terms.

The threshold is no guess: an item counts only if half of its words lie in shared runs of ``RUN`` words, so its BM25 score is at least the
cheapest way to cover half of its words by such runs (a small dynamic programme, with a term's score divided among its occurrences).
Scores are divided by that bound, item by item, and compared with 1; no case can be lost.

The items are a stated query set. They are taken in passes of at most ``WORDS_PER_PASS`` words (about 50,000 items), so what is on the driver and
broadcast stays bounded however many items there are; each pass is one narrow job over the documents. There is no shuffle of document
text.

Defined cases: null and blank documents or items match nothing; items with fewer than ``RUN`` words can't match; repeated document rows
give one row per pair; columns other than the keys and texts are not used, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.session import cut_lineage

RUN = 8
SHARE = 0.5
TERM = 3
BLOCK = 8
WORDS_PER_PASS = 2_000_000
K1, B = 1.2, 0.75
MEMO_ENTRIES = 200_000
_WORDS = re.compile(r"[^\W_]+").findall


def words_of(text: str | None) -> list[str]:
    """Longest runs of letters and digits, in lower case."""
    return [w.lower() for w in _WORDS(text)] if text else []


def cheapest_covers(costs: list[np.ndarray]) -> np.ndarray:
    """For each item the least sum of costs of words that lie in runs of at least ``RUN`` words and make up at least ``SHARE`` of all.

    ``costs`` has for each word the cost of the term that ends with it; the first words of a run end no term inside it. Dynamic
    programme over words, items of like length together; axes are the item, the length of the open run (0: none, ``RUN``: long enough)
    and the words taken.
    """
    out = np.full(len(costs), np.inf)
    sizes = np.array([len(c) for c in costs], dtype=np.int64)
    order = np.argsort(sizes, kind="stable")
    for first in range(0, len(order), 256):
        own = order[first : first + 256]
        size = sizes[own]
        need = np.ceil(SHARE * size).astype(np.int64)
        most = int(need.max())
        padded = np.full((len(own), int(size.max())), np.inf)
        for row, item in enumerate(own.tolist()):
            padded[row, : sizes[item]] = costs[item]
        least = np.full((len(own), RUN + 1, most + 1), np.inf)
        least[:, 0, 0] = 0.0
        for at in range(padded.shape[1]):
            cost, live = padded[:, at, None], at < size
            taken = np.full_like(least, np.inf)
            taken[:, :, 1:] = least[:, :, :-1]
            taken[np.arange(len(own)), :, need] = np.minimum(taken[np.arange(len(own)), :, need], least[np.arange(len(own)), :, need])
            step = np.full_like(least, np.inf)
            step[:, 0] = np.minimum(least[:, 0], least[:, RUN])
            for run in range(1, RUN):
                step[:, run] = taken[:, run - 1] + (cost if run >= TERM else 0.0)
            step[:, RUN] = np.minimum(taken[:, RUN - 1], taken[:, RUN]) + cost
            least[live] = step[live]
        rows = np.arange(len(own))
        out[own] = np.minimum(least[rows, 0, need], least[rows, RUN, need])
    return out


class ItemIndex:
    """The inverted index of one pass of items: postings and block maxima by term, with the items' own thresholds folded into the scores."""

    def __init__(self, items: list[tuple[int, str]]):
        texts = [(key, words) for key, text in items if len(words := words_of(text)) >= RUN]
        self.vocabulary: dict[str, int] = {}
        coded = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words], dtype=np.int64) for _, words in texts]
        keyed = [self.terms(ids) for ids in coded]
        self.names, found = np.unique(np.concatenate(keyed or [np.zeros(0, dtype=np.int64)]), return_inverse=True)
        ends = np.cumsum([len(k) for k in keyed], dtype=np.int64)
        numbered = np.split(found, ends[:-1]) if keyed else []
        counted = [np.unique(terms, return_counts=True) for terms in numbered]
        frequency = np.bincount(np.concatenate([t for t, _ in counted] or [np.zeros(0, dtype=np.int64)]), minlength=len(self.names))
        # items with the same rarest term lie next to one another
        order = sorted(range(len(texts)), key=lambda i: (int(counted[i][0][np.argmin(frequency[counted[i][0]])]), i))
        self.keys = [texts[i][0] for i in order]
        self.items = [coded[i] for i in order]
        counted, numbered = [counted[i] for i in order], [numbered[i] for i in order]
        mean = max(1.0, sum(map(len, numbered)) / max(1, len(numbered)))
        idf = np.log(1 + (len(order) - frequency + 0.5) / (frequency + 0.5))
        impacts, costs = [], []
        for (terms, counts), places in zip(counted, numbered, strict=True):
            impact = idf[terms] * counts * (K1 + 1) / (counts + K1 * (1 - B + B * len(places) / mean))
            each = (impact / counts)[np.searchsorted(terms, places)]
            impacts.append(impact)
            costs.append(np.concatenate([np.zeros(TERM - 1), each]))
        least = cheapest_covers(costs)
        term = np.concatenate([t for t, _ in counted] or [np.zeros(0, dtype=np.int64)])
        item = np.repeat(np.arange(len(order)), [len(t) for t, _ in counted])
        score = np.concatenate([x / low for x, low in zip(impacts, least, strict=True)] or [np.zeros(0)])
        by_term = np.lexsort((item, term))
        self.item, self.score = item[by_term], score[by_term]
        self.starts = np.searchsorted(term[by_term], np.arange(len(self.names) + 1))
        pairs = term[by_term] * (len(order) // BLOCK + 1) + self.item // BLOCK
        firsts = np.flatnonzero(np.diff(pairs, prepend=-1))
        self.block = self.item[firsts] // BLOCK
        self.bound = np.maximum.reduceat(self.score, firsts) if len(firsts) else self.score
        self.block_starts = np.searchsorted(term[by_term][firsts], np.arange(len(self.names) + 1))
        self.blocks = len(order) // BLOCK + 1

    def terms(self, ids: np.ndarray) -> np.ndarray:
        """A number for each run of ``TERM`` words, -1 for those with a word of no item (-1); from equal numbers equal words follow."""
        if len(ids) < TERM:
            return np.zeros(0, dtype=np.int64)
        parts = [ids[k : len(ids) - TERM + 1 + k] for k in range(TERM)]
        total = np.zeros(len(parts[0]), dtype=np.int64)
        for part in parts:
            total = total * np.int64(2_000_003) + part
        return np.where(np.minimum.reduce(parts) >= 0, total, -1)

    def encode(self, text: str, memo: dict[str, bytes]) -> np.ndarray:
        """Word numbers of a text (-1 for words of no item); words never reach over a blank, so chunks are remembered."""
        get = self.vocabulary.get
        parts = []
        for chunk in text.split(" "):
            ids = memo.get(chunk)
            if ids is None:
                ids = np.array([get(w, -1) for w in words_of(chunk)], dtype=np.int64).tobytes()
                if len(memo) >= MEMO_ENTRIES:
                    memo.clear()
                memo[chunk] = ids
            parts.append(ids)
        return np.frombuffer(b"".join(parts), dtype=np.int64)

    def candidates(self, document: np.ndarray) -> tuple[np.ndarray, int]:
        """Block-max WAND: (the items whose score reaches their threshold, the blocks opened for that)."""
        names = self.terms(document)
        names = np.unique(names[names >= 0])
        at = np.minimum(np.searchsorted(self.names, names), len(self.names) - 1)
        mine = at[self.names[at] == names] if len(self.names) else at[:0]
        if not len(mine):
            return mine, 0
        slack = 1 - 1e-6
        lists = _ranges(self.block_starts[mine], self.block_starts[mine + 1])
        bounds = np.bincount(self.block[lists], weights=self.bound[lists], minlength=self.blocks)
        is_open = bounds >= slack
        opened = int(is_open.sum())
        if not opened:
            return mine[:0], 0
        posts = _ranges(self.starts[mine], self.starts[mine + 1])
        posts = posts[is_open[self.item[posts] // BLOCK]]
        items, place = np.unique(self.item[posts], return_inverse=True)
        return items[np.bincount(place, weights=self.score[posts], minlength=len(items)) >= slack], opened

    def verify(self, document: np.ndarray, candidates: np.ndarray) -> list[int]:
        """The candidates of which words in shared runs of at least ``RUN`` words make up at least half."""
        if len(document) < RUN or not len(candidates):
            return []
        shared = set(map(bytes, np.lib.stride_tricks.sliding_window_view(document, RUN)[self._known(document)]))
        out = []
        for number in candidates.tolist():
            item = self.items[number]
            starts = [i for i, run in enumerate(np.lib.stride_tricks.sliding_window_view(item, RUN)) if run.tobytes() in shared]
            covered = np.zeros(len(item), dtype=bool)
            for start in starts:
                covered[start : start + RUN] = True
            if covered.sum() >= SHARE * len(item):
                out.append(number)
        return out

    @staticmethod
    def _known(document: np.ndarray) -> np.ndarray:
        """Starts of runs of ``RUN`` words all of which some item has."""
        unknown = np.concatenate([[0], np.cumsum(document < 0)])
        return np.flatnonzero(unknown[RUN:] == unknown[:-RUN])


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All places of the ranges, one after another."""
    sizes = ends - starts
    before = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) + np.repeat(starts - before, sizes)


def find_leaks(documents: DataFrame, items: DataFrame, doc_key: str = "doc_id", doc_text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row (``doc_key``, ``item_key``) per document and item that leaked into it."""
    spark = documents.sparkSession
    docs = documents.select(F.col(doc_key).alias("doc"), F.col(doc_text).alias("body")).where(F.col("body").isNotNull() & F.col("doc").isNotNull())
    asked = items.select(F.col(item_key).alias("item"), F.col(item_text).alias("body")).where(F.col("body").rlike(r"\S") & F.col("item").isNotNull())
    asked = asked.groupBy("item").agg(F.min("body").alias("body"))
    kinds = docs.schema["doc"].dataType.simpleString(), asked.schema["item"].dataType.simpleString()
    size = F.size(F.split("body", r"\s+"))
    passes = -(-(asked.agg(F.sum(size)).first()[0] or 0) // WORDS_PER_PASS)
    found = spark.createDataFrame([], f"doc {kinds[0]}, item {kinds[1]}")
    if passes > 1:
        asked = cut_lineage(asked.repartition(2 * passes, "item").withColumn("pass", F.spark_partition_id()))
        passes = 2 * passes
    for number in range(passes):
        rows = sorted((r["item"], r["body"]) for r in (asked.where(F.col("pass") == number) if passes > 1 else asked).select("item", "body").toLocalIterator())
        index = spark.sparkContext.broadcast(ItemIndex(rows))
        found = found.unionByName(docs.mapInArrow(_matcher(index), f"doc {kinds[0]}, item {kinds[1]}"))
    return found.distinct().select(F.col("doc").alias(doc_key), F.col("item").alias(item_key))


def _matcher(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, memo = shared.value, {}
        names = pa.array(index.keys)
        for batch in batches:
            docs, hits = [], []
            for at, text in enumerate(batch.column(1).to_pylist()):
                document = index.encode(text, memo)
                found, _ = index.candidates(document)
                for item in index.verify(document, found):
                    docs.append(at)
                    hits.append(item)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(docs, type=pa.int64())), names.take(pa.array(hits, type=pa.int64()))], ["doc", "item"])

    return run
