"""Keyword search: inverted index, corpus statistics, BM25."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators.blocks import best, give_back, query_parts, ranked_rows
from docloom.session import cut_lineage

K1, B = 1.5, 0.75
#: Postings from which on a block of the corpus ends, and which a search has in memory at once.
HOT = 1_000_000
#: More than rounding to six digits changes.
SLACK = 2e-6


def postings(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(term, key, tf, dl): one row per document and term; the count combines before the shuffle."""
    terms = documents.select(F.col(key), T.tokens(F.col(text)).alias("terms")).withColumn("dl", F.size("terms"))
    return terms.select(key, "dl", F.explode("terms").alias("term")).groupBy("term", key, "dl").agg(F.count("*").alias("tf"))


def corpus_stats(documents: DataFrame, posts: DataFrame) -> DataFrame:
    """One row: number of documents and their mean length in tokens; empty documents count. Lengths come from the postings."""
    total = posts.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("tokens"))
    return documents.agg(F.count("*").alias("n")).crossJoin(total).select("n", (F.col("tokens") / F.greatest("n", F.lit(1))).alias("avg_dl"))  # one row each


def write_index(documents: DataFrame, key: str, text: str, folder: str, buckets: int = 64) -> None:
    """Writes the inverted index: postings in folders by a hash of the term (a search reads those of its terms), and the statistics."""
    posts = postings(documents, key, text).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
    posts.repartition("bucket", F.pmod(F.xxhash64(key), F.lit(8))).write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/postings")
    corpus_stats(documents, posts).write.mode("overwrite").parquet(f"{folder}/stats")


def read_index(spark, folder: str) -> tuple[DataFrame, DataFrame]:
    """(postings, statistics) as ``bm25`` takes them."""
    return spark.read.parquet(f"{folder}/postings").drop("bucket"), spark.read.parquet(f"{folder}/stats")


def idf(n, df):
    return F.ln(1 + (n - df + 0.5) / (df + 0.5))


def term_statistics(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(term, df, idf) of every term."""
    counts = postings(documents, key, text).groupBy("term").agg(F.count("*").alias("df"))
    return counts.join(F.broadcast(documents.agg(F.count("*").alias("n")))).select("term", "df", idf(F.col("n"), F.col("df")).alias("idf"))


def bm25(documents: DataFrame, key: str, text: str, questions: DataFrame, query: str, question: str, k: int, scope: DataFrame | None = None, index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(query, key, score, rank): the best ``k`` documents of each question, ties by key.

    The corpus is tokenised once and written as blocks of postings; document frequencies, one row per term, ride to the distinct question terms
    in an equi-join. Each part of the questions then meets block after block and keeps its best, so no pair of a question and a document is ever a
    row. Statistics are those of the whole corpus even where ``scope`` (a table of keys) narrows the result. ``index`` is a written index to use.
    """
    asked = questions.select(F.col(query).alias("q"), F.explode(F.array_distinct(T.tokens(F.col(question)))).alias("term"))
    if index:
        found = index[0].join(asked.select("term").distinct(), "term", "left_semi")
        rows = found.groupBy(F.col(key).alias("key"), "dl").agg(F.flatten(F.collect_list(F.array_repeat("term", F.col("tf").cast("int")))).alias("terms"))
    else:
        rows = documents.select(F.col(key).alias("key"), T.tokens(F.col(text)).alias("terms")).withColumn("dl", F.size("terms"))
    rows = rows.select("key", F.col("dl").cast("bigint").alias("dl"), "terms")
    if scope is None:
        rows = rows.withColumn("kept", F.lit(True))
    else:
        rows = rows.join(scope.select(F.col(key).alias("key"), F.lit(True).alias("kept")).distinct(), "key", "left").withColumn("kept", F.coalesce("kept", F.lit(False)))
    blocks = cut_lineage(rows.repartition("key").sortWithinPartitions("key", "dl").mapInArrow(_blocks(HOT), "block binary, terms array<string>, dfs array<bigint>, n bigint, tokens bigint"))
    df = blocks.select(F.explode(F.arrays_zip("terms", "dfs")).alias("t")).groupBy(F.col("t.terms").alias("term")).agg(F.sum("t.dfs").alias("df"))
    stats = index[1] if index else blocks.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum("tokens").alias("tokens")).select("n", (F.coalesce("tokens", F.lit(0)) / F.greatest("n", F.lit(1))).alias("avg_dl"))
    weighed = asked.join(df, "term").join(F.broadcast(stats)).select("q", F.struct("term", idf(F.col("n"), F.col("df")).alias("idf")).alias("w"), "avg_dl")
    weighed = weighed.groupBy("q").agg(F.collect_list("w").alias("w"), F.first("avg_dl").alias("avg_dl")).select("q", F.col("w.term").alias("terms"), F.col("w.idf").alias("idfs"), "avg_dl")
    kinds = {c: t.simpleString() for c, t in ((query, questions.schema[query].dataType), (key, rows.schema["key"].dataType))}
    schema = f"`{query}` {kinds[query]}, `{key}` {kinds[key]}, score double, rank int"
    return best(query_parts(weighed, "q", questions.count()), blocks.select("block"), lambda part, most=HOT: _Search(part, k, most), schema)


def _blocks(most: int):
    """Packs rows (key, dl, terms, kept) in the order of keys into blocks of about ``most`` tokens; the rows of a key stay together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += len(batch.column("terms").flatten())
            if size >= most:
                rows = pa.Table.from_batches(held).combine_chunks()
                codes = _codes(rows["key"])
                whole = int(np.flatnonzero(codes == codes[-1])[0])
                if whole:
                    yield _packed(rows.slice(0, whole))
                    held = rows.slice(whole).to_batches()
                    size = sum(len(b.column("terms").flatten()) for b in held)
        if held:
            yield _packed(pa.Table.from_batches(held))
        held = batch = rows = None
        give_back()

    return run


def _codes(keys) -> np.ndarray:
    """Equal numbers for equal keys; null is a key, too."""
    encoded = (keys.combine_chunks() if isinstance(keys, pa.ChunkedArray) else keys).dictionary_encode()
    return np.asarray(pc.fill_null(encoded.indices, -1))


def _packed(rows: pa.Table) -> pa.RecordBatch:
    """One block: documents are distinct keys, their entries distinct (key, dl), as postings are counted."""
    rows = rows.combine_chunks()
    keys, terms, dl, kept = (rows[c].chunk(0) for c in ("key", "terms", "dl", "kept"))
    dl, kept, codes = np.asarray(dl), np.asarray(kept.cast(pa.int8())).astype(bool), _codes(keys)
    new_doc = np.r_[True, codes[1:] != codes[:-1]]
    new = new_doc | np.r_[True, dl[1:] != dl[:-1]]
    entry_of = np.cumsum(new) - 1
    firsts = np.flatnonzero(new)
    entries = len(firsts)
    tokens = terms.flatten().dictionary_encode()
    owner = np.repeat(entry_of, np.asarray(pc.list_value_length(terms)))
    pairs, tf = np.unique(np.asarray(tokens.indices).astype(np.int64) * entries + owner, return_counts=True)
    term, entry = pairs // entries, pairs % entries
    dfs = np.bincount(term, minlength=len(tokens.dictionary))
    shown = kept[firsts][entry]
    term, entry, tf = term[shown], entry[shown], tf[shown]
    small = lambda a: a.astype(np.min_scalar_type(int(a.max()) if len(a) else 0))
    body = (keys.take(pa.array(np.flatnonzero(new_doc))), tokens.dictionary, small(np.bincount(term, minlength=len(dfs))), small(entry), small(tf), dl[firsts], (np.cumsum(new_doc) - 1)[firsts])
    whole = pickle.dumps(body, protocol=5)
    block = len(whole).to_bytes(8, "little") + pa.compress(whole, codec="zstd", asbytes=True)
    values = (pa.array([block], pa.binary()), pa.ListArray.from_arrays([0, len(tokens.dictionary)], tokens.dictionary), pa.array([dfs], pa.list_(pa.int64())), pa.array([rows.num_rows], pa.int64()), pa.array([int(dl.sum())], pa.int64()))
    return pa.RecordBatch.from_arrays(list(values), ["block", "terms", "dfs", "n", "tokens"])


class _Search:
    """The best ``k`` documents of each of a part's questions, over the blocks met so far."""

    def __init__(self, part: pa.Table, k: int, most: int):
        self.k, self.most, self.names, self.avg_dl = k, most, part["q"].combine_chunks(), part["avg_dl"][0].as_py()
        lists = part["terms"].combine_chunks()
        flat = lists.flatten().dictionary_encode()
        self.terms, self.code, self.idf = flat.dictionary, np.asarray(flat.indices).astype(np.int64), np.asarray(part["idfs"].combine_chunks().flatten())
        self.owner = np.repeat(np.arange(len(lists)), np.asarray(pc.list_value_length(lists)))
        self.ends = np.r_[0, np.cumsum(np.asarray(pc.list_value_length(lists)))].tolist()
        self.top: list[list] = [[] for _ in range(len(lists))]
        self.held, self.size, self.docs, self.kind = [], 0, 0, pa.null()

    def meet(self, block: bytes) -> None:
        keys, terms, counts, entry, tf, dl, doc = pickle.loads(pa.decompress(block[8:], int.from_bytes(block[:8], "little"), codec="zstd", asbytes=True))
        own = pc.fill_null(pc.index_in(terms, value_set=self.terms), -1)
        term = np.repeat(np.asarray(own), counts)
        wanted = term >= 0
        term, entry, tf = term[wanted], entry[wanted], tf[wanted].astype(np.float64)
        norm = K1 * (1 - B + B * dl / (self.avg_dl if self.avg_dl > 0 else 1.0))
        weight, place = tf * (K1 + 1) / (tf + norm[entry]), doc[entry]
        if len(doc) > len(keys) and len(term):  # entries of one key add up
            first = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (place[1:] != place[:-1])])
            term, place, weight = term[first], place[first], np.add.reduceat(weight, first)
        self.kind = keys.type
        self.held.append((keys, term, place + self.docs, weight))
        self.docs, self.size = self.docs + len(keys), self.size + len(term)
        if self.size >= self.most:
            self.flush()

    def flush(self) -> None:
        keys, term, place, weight = (pa.concat_arrays([x[0] for x in self.held]), *(np.concatenate([x[i] for x in self.held]) for i in (1, 2, 3)))
        n, self.held, self.size, self.docs = self.docs, [], 0, 0
        if not len(term):
            return
        order = np.argsort(term, kind="stable")
        term, place, weight = term[order], place[order].astype(np.int64), weight[order]
        counts = np.bincount(term, minlength=len(self.terms))
        starts = np.r_[0, np.cumsum(counts)]
        most = np.zeros(len(counts))
        most[counts > 0] = np.maximum.reduceat(weight, starts[:-1][counts > 0])
        by_key = np.empty(n, dtype=np.int64)
        by_key[np.asarray(pc.sort_indices(keys, null_placement="at_start"))] = np.arange(n)
        names = keys.to_pylist()
        # of each question the terms that can add most come first; ``rest``: what a term and those behind it can add at most
        bound = self.idf * most[self.code]
        order = np.lexsort((-bound, self.owner))
        code, idfs, bound = self.code[order], self.idf[order].tolist(), bound[order]
        total = np.cumsum(bound)
        last = np.asarray(self.ends[1:])[self.owner] - 1
        rest = (total[last] - total + bound).tolist()
        low, high = starts[code].tolist(), starts[code + 1].tolist()
        sums = np.zeros(n)
        for q, top in enumerate(self.top):
            self.search(top, low, high, idfs, rest, self.ends[q], self.ends[q + 1], place, weight, sums, by_key, names)

    def search(self, top, low, high, idfs, rest, at, end, place, weight, sums, by_key, names) -> None:
        """Adds up the terms that can still lift a new document among the best, then looks the others up for the documents left."""
        k, full = self.k, len(top) == self.k
        least = -top[-1][0] - SLACK if full else -np.inf
        touched = []
        while at < end and low[at] < high[at] and rest[at] >= least:
            docs = place[low[at] : high[at]]
            sums[docs] += idfs[at] * weight[low[at] : high[at]]
            touched.append(docs)
            at += 1
            if not full and len(docs) >= k:
                reached = sums[docs]
                least = max(least, reached[np.argpartition(reached, len(docs) - k)[len(docs) - k]] - SLACK)
        if not touched:
            return
        left = rest[at] if at < end and low[at] < high[at] else 0.0
        if sum(map(len, touched)) < len(sums) // 16:
            found = np.unique(np.concatenate(touched)) if len(touched) > 1 else touched[0]
            found = found[sums[found] >= least - left]
        else:
            found = np.flatnonzero(sums >= max(least - left, 1e-300))
        scores = sums[found]
        while len(found) and at < end and low[at] < high[at]:
            docs = place[low[at] : high[at]]
            if len(docs) < 5 * len(found):  # adding up costs less than looking up
                sums[docs] += idfs[at] * weight[low[at] : high[at]]
                touched.append(docs)
                scores = sums[found]
            else:
                where = np.minimum(np.searchsorted(docs, found), len(docs) - 1)
                scores = scores + np.where(docs[where] == found, idfs[at] * weight[low[at] : high[at]][where], 0.0)
                sums[found] = scores
            at += 1
            still = scores >= least - (rest[at] if at < end and low[at] < high[at] else 0.0)
            found, scores = found[still], scores[still]
        if sum(map(len, touched)) < len(sums) // 4:
            for docs in touched:
                sums[docs] = 0.0
        else:
            sums.fill(0.0)
        scores = np.round(scores, 6)
        shown = scores > 0
        if full:
            shown &= scores >= -top[-1][0]
        found, scores = found[shown], scores[shown]
        if len(found) > k:
            kth = np.partition(scores, len(scores) - k)[len(scores) - k]
            found, scores = found[scores >= kth], scores[scores >= kth]
            order = np.lexsort((by_key[found], -scores))[:k]
            found, scores = found[order], scores[order]
        if len(found):
            top += [(-s, names[d] is not None, names[d]) for s, d in zip(scores.tolist(), found.tolist())]
            top.sort()
            del top[k:]

    def result(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            self.flush()
        yield ranked_rows(self.names, self.top, self.kind)
