"""Ranked lists: fusion, reranking, thresholds, cut-offs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import blocks, vectors

RRF_K = 60
#: Vectors of candidates that are looked through at once.
ITEMS_PER_BLOCK = 4096
#: Queries whose candidates are put in order together.
QUERIES_AT_ONCE = 256
#: Passages kept by answer style.
STYLE_K = {"concise": 4, "medium": 6, "long": 10}


def rank_lists(results: DataFrame) -> DataFrame:
    """(query_id, scorer, chunk_id, score, rank) of scored lists held as arrays; repeated rows count once, null scores are left out."""
    rows = results.select("query_id", "scorer", F.explode("chunks").alias("c")).select("query_id", "scorer", F.col("c.chunk_id").alias("chunk_id"), F.col("c.score").alias("score"))
    rows = rows.where("score is not null and chunk_id is not null").groupBy("query_id", "scorer", "chunk_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id", "scorer").orderBy(F.desc("score"), "chunk_id")
    return rows.withColumn("rank", F.row_number().over(order))


def reciprocal_rank_fusion(lists: DataFrame, query: str, item: str, name: str, k: int) -> DataFrame:
    """(query, item, rrf, rank): sum of 1 / (60 + rank) over the lists, best ``k``; ties by first list, then rank."""
    fused = lists.groupBy(query, item).agg(F.round(F.sum(1.0 / (RRF_K + F.col("rank"))), 9).alias("rrf"), F.min(F.struct(name, "rank")).alias("first"))
    order = Window.partitionBy(query).orderBy(F.desc("rrf"), "first", item)
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(query, item, "rrf", "rank")


def with_section(text: Column, section: Column) -> Column:
    """What of a passage is compared with a question."""
    return F.concat(F.coalesce(text, F.lit("")), F.lit(" "), F.coalesce(section, F.lit("")))


def question_terms(rows: DataFrame, question: str) -> Column:
    """The question's tokens: the column ``q_terms`` where they were made once a question, else made here."""
    return F.col("q_terms") if "q_terms" in rows.columns else T.tokens(F.col(question))


def passage_terms(rows: DataFrame, text: Column, held: str = "t_terms") -> Column:
    return F.col(held) if held in rows.columns else T.tokens(text)


def keyword_scores(candidates: DataFrame, question: str, text: str, section: str) -> DataFrame:
    """Adds ``score`` and ``new_rank``: coverage of the question by text and section (or ``covered``, where it is known), with a small prior for the fused rank."""
    covered = F.col("covered") if "covered" in candidates.columns else T.coverage(question_terms(candidates, question), passage_terms(candidates, with_section(F.col(text), F.col(section))))
    scored = candidates.withColumn("score", F.round(F.least(covered + 0.02 / F.col("rank"), F.lit(1.0)) + 1e-9, 4))
    return scored.withColumn("new_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "rank")))


def sentence_scores(candidates: DataFrame, question: str, text: str, section: str, least: int = 20, embed=None) -> DataFrame:
    """Adds ``score``: the best cosine of a passage's sentences of ``least`` characters or more to the question, 0 for a passage without one.

    Sentences are embedded once for each passage, whatever the number of its questions. A query none of whose passages has such a sentence
    gets its keyword scores.
    """
    embed = embed or vectors.embedded
    rows = keyword_scores(candidates, question, text, section).drop("new_rank").withColumnRenamed("score", "keyword_score")
    asked = rows.groupBy("query_id").agg(F.min(question).alias("question")).select("query_id", embed(F.col("question")).alias("q"))
    passages = candidates.groupBy("chunk_id").agg(F.min(text).alias("t"))
    sentences = passages.select("chunk_id", F.explode(F.filter(T.sentence_spans(F.col("t")), lambda s: F.length(s) >= least)).alias("s")).select("chunk_id", embed(F.col("s")).alias("v"))
    pairs = candidates.select("query_id", "chunk_id").join(sentences, "chunk_id").join(asked, "query_id")
    best = pairs.withColumn("sim", vectors.dot(F.col("q"), F.col("v"))).groupBy("query_id", "chunk_id").agg(F.max("sim").alias("sim"), F.lit(True).alias("judged"))
    joined = rows.join(best, ["query_id", "chunk_id"], "left").withColumn("any", F.max("judged").over(Window.partitionBy("query_id")))
    score = F.when(F.col("any"), F.round(F.greatest(F.coalesce("sim", F.lit(0.0)), F.lit(0.0)), 6)).otherwise(F.col("keyword_score"))
    return joined.withColumn("score", score).drop("sim", "judged", "any", "keyword_score")


def calibrated(score: Column, query: str) -> Column:
    """Scores as probabilities: squashed only where a query's list leaves [0, 1]."""
    own = Window.partitionBy(query)
    return F.when((F.min(score).over(own) >= 0) & (F.max(score).over(own) <= 1), score).otherwise(1 / (1 + F.exp(-score)))


def relevant(scored: DataFrame, query: str, least: float = 0.02, fallback: int = 3) -> DataFrame:
    """Rows at or above the threshold; where none is, the best few with ``low_relevance``. Needs ``score`` and ``rank``."""
    above = F.count(F.when(F.col("score") >= least, 1)).over(Window.partitionBy(query))
    flagged = scored.withColumn("low_relevance", above == 0)
    return flagged.where((F.col("score") >= least) | (F.col("low_relevance") & (F.col("rank") <= fallback)))


def style_k(style: Column) -> Column:
    out = F.lit(STYLE_K["medium"])
    for name, k in STYLE_K.items():
        out = F.when(F.lower(style) == name, F.lit(k)).otherwise(out)
    return out


def mmr(candidates: DataFrame, balance: float = 0.7) -> DataFrame:
    """(query_id, item_id, score, rank): greedy maximal marginal relevance over each query's few candidates (item_id, vector, query_vector).

    Ties go to the candidate that came first: by ``rank`` where there is one, else by item_id.
    """
    given = "rank" if "rank" in candidates.columns else "item_id"
    kinds = {c: candidates.schema[c].dataType.simpleString() for c in ("query_id", "item_id")}

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([given, "item_id"]).reset_index(drop=True)
        picked, relevance = _greedy(np.stack(rows["vector"].to_numpy())[None], np.asarray(rows["query_vector"].iloc[0])[None], len(rows), balance)
        order, relevance = picked[0], relevance[0]
        return pd.DataFrame({"query_id": rows["query_id"].to_numpy()[order], "item_id": rows["item_id"].to_numpy()[order], "score": np.round(np.maximum(relevance[order], 0.0), 6), "rank": np.arange(1, len(order) + 1, dtype=np.int32)})

    return candidates.groupBy("query_id").applyInPandas(pick, f"query_id {kinds['query_id']}, item_id {kinds['item_id']}, score double, rank int")


def _greedy(vectors: np.ndarray, asked: np.ndarray, most: int, balance: float) -> tuple[np.ndarray, np.ndarray]:
    """(order, relevance) of as many candidates for each of some queries: the first ``most`` by marginal relevance, of equals the one that came first."""
    relevance, likeness = (vectors @ asked[:, :, None])[:, :, 0], vectors @ vectors.transpose(0, 2, 1)
    redundant, left, each = np.zeros(relevance.shape), np.ones(relevance.shape, dtype=bool), np.arange(len(vectors))
    order = np.empty((len(vectors), min(most, vectors.shape[1])), dtype=np.int64)
    for n in range(order.shape[1]):
        best = order[:, n] = np.argmax(np.where(left, balance * relevance - (1 - balance) * redundant, -np.inf), axis=1)
        redundant = np.maximum(redundant, likeness[each, best]) if n else likeness[each, best]
        left[each, best] = False
    return order, relevance


def mmr_of_kept(candidates: DataFrame, asked: DataFrame, items: DataFrame, balance: float = 0.7) -> DataFrame:
    """The rows of ``mmr`` up to each query's ``k``, without a vector a pair: of candidates (query_id, item_id, rank), queries (query_id, vector, k)
    and items (item_id, vector).

    Items are written once, in blocks; each part of the queries meets block after block and keeps the vectors of its candidates. Candidates that
    aren't among the items are left out.
    """
    lists = candidates.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "item_id"))).alias("own"))
    lists = lists.join(asked.select("query_id", F.col("vector").alias("v"), "k"), "query_id").select(F.col("query_id").alias("q"), F.col("own.item_id").alias("items"), "v", "k")
    kinds = {c: candidates.schema[c].dataType.simpleString() for c in ("query_id", "item_id")}
    parts = blocks.query_parts(lists, "q", asked.count(), vectors.QUERIES_PER_PASS)
    held = vectors.written(items.select("item_id", "vector"), ITEMS_PER_BLOCK)
    return blocks.best(parts, held, lambda part: _Diverse(part, balance), f"query_id {kinds['query_id']}, item_id {kinds['item_id']}, score double, rank int")


class _Diverse:
    """The vectors of the candidates of a part's queries, as far as the blocks met have them."""

    def __init__(self, part: pa.Table, balance: float):
        self.balance, self.names, self.asked, self.k = balance, part["q"].combine_chunks(), vectors.matrix(part["v"].combine_chunks()), np.asarray(part["k"])
        lists = part["items"].combine_chunks()
        flat = lists.flatten().dictionary_encode()
        self.items, self.code, self.sizes = flat.dictionary, np.asarray(flat.indices), np.asarray(pc.list_value_length(lists))
        self.slots = {item: n for n, item in enumerate(self.items.to_pylist())}
        self.vectors, self.met = np.zeros((len(self.items), self.asked.shape[1])), np.zeros(len(self.items), dtype=bool)

    def meet(self, block: bytes) -> None:
        keys, own = blocks.unpacked(block)
        slots = np.array([self.slots.get(key, -1) for key in keys.to_pylist()], dtype=np.int64)
        wanted = slots >= 0
        self.met[slots[wanted]] = True
        if own.shape[1]:  # else all of them are null
            if not self.asked.shape[1]:
                self.asked = np.zeros((len(self.asked), own.shape[1]))
            if not self.vectors.shape[1]:
                self.vectors = np.zeros((len(self.items), own.shape[1]))
            self.vectors[slots[wanted]] = own[wanted]

    def result(self) -> Iterator[pa.RecordBatch]:
        there = self.met[self.code]
        code, sizes = self.code[there], np.bincount(np.repeat(np.arange(len(self.sizes)), self.sizes)[there], minlength=len(self.sizes))
        starts = np.cumsum(sizes) - sizes
        for size in np.unique(sizes[sizes > 0]).tolist():
            alike = np.flatnonzero(sizes == size)
            for first in range(0, len(alike), QUERIES_AT_ONCE):
                queries = alike[first : first + QUERIES_AT_ONCE]
                own = code[starts[queries][:, None] + np.arange(size)]
                order, relevance = _greedy(self.vectors[own], self.asked[queries], int(self.k[queries].max()), self.balance)
                q, place = np.nonzero(np.arange(order.shape[1]) < self.k[queries][:, None])
                picked = order[q, place]
                columns = (self.names.take(pa.array(queries[q])), self.items.take(pa.array(own[q, picked])), pa.array(np.round(np.maximum(relevance[q, picked], 0.0), 6)), pa.array((place + 1).astype(np.int32)))
                yield pa.RecordBatch.from_arrays(list(columns), ["query_id", "item_id", "score", "rank"])
