"""A batch of questions through hybrid retrieval over chunks to cited answers, as one plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import answers, lexical, library, models, ranking, vectors
from docloom.session import cut_lineage

RERANKERS = ("keyword", "none", "mmr", "sentence", "cross-encoder")
NO_DOCUMENTS = "No documents are uploaded yet. Upload a PDF, Word, HTML or text file and ask again."
NONE_LEFT = "None of the selected documents exist anymore. Please reselect."
SUMMARY_CHARS = 24_000


@dataclass(frozen=True)
class RetrievalConfig:
    """Which stages run; at least one of dense and keyword search must. ``rerank`` is what is wanted, the ``scorer`` of a row what ran."""

    use_dense: bool = True
    use_bm25: bool = True
    candidate_k: int = 25
    rerank: str = "keyword"
    least_relevance: float = 0.02
    summaries: bool = True
    dim: int = 64

    def __post_init__(self):
        if not (self.use_dense or self.use_bm25):
            raise ValueError("dense search, keyword search or both must be on")
        if self.rerank not in RERANKERS:
            raise ValueError(f"unknown reranker {self.rerank!r}; one of {', '.join(RERANKERS)}")


@dataclass(frozen=True)
class Models:
    """The plugged models: ``embed`` makes a vector column of a text column (None: keyword search only), ``pairs`` scores lists of (question,
    text), ``rewrite`` answers a prompt with searches as JSON, ``generate`` a prompt with an answer."""

    embed: Callable[[Column], Column] | None = None
    pairs: Callable | None = None
    rewrite: Callable[[str], str] | None = None
    generate: Callable[[str], str] | None = None


def default_models(config: RetrievalConfig) -> Models:
    return Models(embed=vectors.embedder("hashing", config.dim))


def deduplicated_queries(standalone, queries, most: int = models.MOST_QUERIES):
    """The standalone question and its rewrites, distinct regardless of case, ``most`` at most."""
    every = F.filter(F.concat(F.array(T.strip(standalone)), F.coalesce(F.transform(queries, T.strip), F.array().cast("array<string>"))), lambda q: q != "")
    first = F.filter(F.transform(every, lambda q, i: F.when(F.array_position(F.transform(every, F.lower), F.lower(q)) == i + 1, q)), lambda q: q.isNotNull())
    return F.slice(first, 1, most)


def scorer_of(wanted: str, plugged: Models) -> str:
    """The reranker that runs: the wanted one, or keyword where its model isn't there."""
    missing = (wanted == "cross-encoder" and plugged.pairs is None) or (wanted in ("mmr", "sentence") and plugged.embed is None)
    return "keyword" if missing else wanted


def as_chunks(rows: DataFrame) -> DataFrame:
    """Chunk rows with all columns retrieval uses; those a table lacks are null, the section "General", the chunk its document."""
    rows = rows if "chunk_id" in rows.columns else rows.withColumn("chunk_id", F.col("doc_id"))
    kinds = {"chunk_id": "string", "doc_id": "string", "filename": "string", "section": "string", "page": "int", "page_end": "int", "text": "string"}
    held = [(F.col(c) if c in rows.columns else F.lit("General" if c == "section" else None)).cast(kind).alias(c) for c, kind in kinds.items()]
    return rows.select(*held).where("chunk_id is not null and text is not null")


def in_scope(chunks: DataFrame, scope: DataFrame | None) -> DataFrame:
    """Chunks of the documents of ``scope`` (doc_id); none or an empty table means all."""
    return chunks if scope is None or scope.isEmpty() else chunks.join(scope.select("doc_id").distinct(), "doc_id", "left_semi")


def ranked_lists(chunks: DataFrame, asked: DataFrame, config: RetrievalConfig, plugged: Models, index=None) -> tuple[DataFrame, str]:
    """((query_id, chunk_id, rank, list) of every search of every question, mode): one dense and one keyword list for each search."""
    searches = asked.select("query_id", F.posexplode("queries").alias("n", "search"))
    named = F.concat_ws(":", "query_id", "n")
    split = lambda rows, leg: rows.select(F.split_part("search_id", F.lit(":"), F.lit(1)).cast(asked.schema["query_id"].dataType).alias("query_id"), "chunk_id", "rank", F.concat(F.lit(leg), F.split_part("search_id", F.lit(":"), F.lit(2))).alias("list"))
    lists = []
    if config.use_dense and plugged.embed is not None:
        embedded = chunks.select("chunk_id", plugged.embed(F.col("text")).alias("v"))
        lists.append(split(vectors.top_k(embedded, "chunk_id", "v", searches.select(named.alias("search_id"), plugged.embed(F.col("search")).alias("v")), config.candidate_k, "search_id"), "1 dense "))
    if config.use_bm25 or not lists:
        texts = chunks.select("chunk_id", T.search_text(F.col("filename"), F.col("section"), F.col("text")).alias("text"))
        lists.append(split(lexical.bm25(texts, "chunk_id", "text", searches.select(named.alias("search_id"), "search"), "search_id", "search", config.candidate_k, index=index), "2 keyword "))
    mode = "hybrid" if len(lists) == 2 else "dense" if config.use_dense and plugged.embed is not None else "keyword"
    return (lists[0] if len(lists) == 1 else lists[0].unionByName(lists[1])), mode


def reranked(rows: DataFrame, config: RetrievalConfig, plugged: Models) -> DataFrame:
    """Adds ``score``, ``new_rank``, ``scorer`` and ``low_relevance`` to fused candidates (query_id, chunk_id, rank, question, text, section)."""
    scorer = scorer_of(config.rerank, plugged)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "rank")
    low = F.lit(False)
    if scorer == "keyword":
        scored = ranking.keyword_scores(rows, "question", "text", "section")
    elif scorer == "none":
        covered = F.col("covered") if "covered" in rows.columns else T.coverage(ranking.question_terms(rows, "question"), ranking.passage_terms(rows, F.col("text"), "text_terms"))
        scored = rows.withColumn("score", F.round(covered, 4)).withColumn("new_rank", F.col("rank"))
    elif scorer == "sentence":
        scored = ranking.sentence_scores(rows, "question", "text", "section", embed=plugged.embed).withColumn("new_rank", F.row_number().over(order))
    else:
        # a query any of whose pairs could not be scored falls back as a whole
        both = ranking.keyword_scores(rows, "question", "text", "section").withColumnRenamed("score", "keyword_score").drop("new_rank")
        both = both.withColumn("raw", models.pair_scores(plugged.pairs, F.col("question"), F.col("text")))
        failed = F.max(F.col("raw").isNull()).over(Window.partitionBy("query_id"))
        both = both.withColumn("failed", failed).withColumn("score", F.when(F.col("failed"), F.col("keyword_score")).otherwise(F.round(ranking.calibrated(F.col("raw"), "query_id"), 4)))
        ranks = both.withColumn("new_rank", F.row_number().over(order))
        above = F.count(F.when(F.col("score") >= config.least_relevance, 1)).over(Window.partitionBy("query_id"))
        ranks = ranks.withColumn("low_relevance", ~F.col("failed") & (above == 0)).where(F.col("failed") | (F.col("score") >= config.least_relevance) | (F.col("low_relevance") & (F.col("new_rank") <= 3)))
        return ranks.withColumn("scorer", F.when(F.col("failed"), "keyword").otherwise("cross-encoder")).drop("raw", "failed", "keyword_score")
    return scored.withColumn("scorer", F.lit(scorer)).withColumn("low_relevance", low)


def prepared(questions: DataFrame, config: RetrievalConfig, plugged: Models) -> DataFrame:
    """(query_id, question, style, k, queries, summary): the standalone question, all its searches, and whether it asks for a summary."""
    prompt = F.concat(F.coalesce(F.col("history"), F.lit("")) if "history" in questions.columns else F.lit(""), F.col("question"))
    queries = models.rewrites(plugged.rewrite, prompt, F.col("question"))
    given = F.col("top_k") if "top_k" in questions.columns else F.lit(None).cast("int")
    style = F.coalesce(F.col("style"), F.lit("medium")) if "style" in questions.columns else F.lit("medium")
    asked = questions.where("question is not null").select("query_id", style.alias("style"), F.when(given > 0, given).otherwise(ranking.style_k(style)).alias("k"), queries.alias("queries"))
    asked = asked.withColumn("question", F.element_at("queries", 1))
    return asked.withColumn("summary", T.is_summary_request(F.col("question")) if config.summaries else F.lit(False)).withColumn("q_terms", F.array_distinct(T.tokens(F.col("question"))))


_COLUMNS = ("query_id", "question", "style", "chunk_id", "doc_id", "filename", "section", "page", "page_end", "text", "score", "rank", "mode", "scorer", "low_relevance")


def retrieve(chunks: DataFrame, questions: DataFrame, config: RetrievalConfig = RetrievalConfig(), scope: DataFrame | None = None, plugged: Models | None = None, index=None) -> DataFrame:
    """The passages each answer is built from: ``_COLUMNS``, ranked from 1 for each question.

    ``chunks``: chunk_id and text, more as ``as_chunks`` names; ``questions``: query_id, question, perhaps style, top_k and history. Each list
    is cut at ``candidate_k`` before fusion and the fusion again; texts are tokenised once for each chunk that is a candidate of any question and
    questions once, not once a pair. Questions that ask for a summary get passages spread through all documents instead.
    """
    plugged = plugged or default_models(config)
    chunks = in_scope(as_chunks(chunks), scope)
    asked = prepared(questions, config, plugged)
    searched = asked.where("not summary")
    lists, mode = ranked_lists(chunks, searched, config, plugged, index)
    fused = cut_lineage(ranking.reciprocal_rank_fusion(lists, "query_id", "chunk_id", "list", config.candidate_k))
    wanted = chunks.join(fused.select("chunk_id").distinct(), "chunk_id", "left_semi")
    about = searched.select("query_id", "question", "style", "k")
    scorer = scorer_of(config.rerank, plugged)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("new_rank"))
    if scorer in ("keyword", "none"):
        # only terms meet the questions; texts are joined to the passages kept
        compared = ranking.with_section(F.col("text"), F.col("section")) if scorer == "keyword" else F.col("text")
        pairs = fused.join(searched.select("query_id", "q_terms"), "query_id").join(wanted.select("chunk_id", T.tokens(compared).alias("terms")), "chunk_id")
        rows = pairs.select("query_id", "chunk_id", "rank", T.coverage(F.col("q_terms"), F.col("terms")).alias("covered"))
        scored = reranked(rows, config, plugged).join(about, "query_id").withColumn("rank", place).where(F.col("rank") <= F.col("k")).join(wanted, "chunk_id")
    elif scorer == "mmr":
        # only vectors meet the questions, by blocks; texts are joined to the passages kept
        about_vectors = searched.select("query_id", plugged.embed(F.col("question")).alias("vector"), "k")
        items = chunks.select(F.col("chunk_id").alias("item_id"), plugged.embed(F.col("text")).alias("vector"))
        picked = ranking.mmr_of_kept(fused.select("query_id", F.col("chunk_id").alias("item_id"), "rank"), about_vectors, items).withColumnRenamed("item_id", "chunk_id")
        scored = picked.join(about, "query_id").join(chunks, "chunk_id").withColumns({"scorer": F.lit(scorer), "low_relevance": F.lit(False)})
    else:
        wanted = wanted.withColumn("t_terms", T.tokens(ranking.with_section(F.col("text"), F.col("section")))).withColumn("text_terms", T.tokens(F.col("text")))
        rows = fused.join(wanted, "chunk_id").join(searched.select("query_id", "question", "style", "k", "q_terms"), "query_id")
        scored = reranked(rows, config, plugged).withColumn("rank", place).where(F.col("rank") <= F.col("k"))
    scored = scored.withColumn("mode", F.lit(mode))
    out = scored.select(*_COLUMNS)
    if not config.summaries:
        return out
    spread = spread_passages(with_ordinals(chunks.withColumn("n_chars", F.length("text")), "doc_id", ["chunk_id"]), SUMMARY_CHARS)
    spread = library.placed(spread, [F.asc("doc_id"), F.asc("ordinal")]).withColumnRenamed("place", "rank")
    summaries = spread.crossJoin(asked.where("summary").select("query_id", "question", "style"))  # the result itself: each such question gets all of them
    more = {"score": F.lit(1.0), "mode": F.lit("summary"), "scorer": F.lit("none"), "low_relevance": F.lit(False)}
    return out.unionByName(summaries.withColumns(more).select(*_COLUMNS))


def answer(chunks: DataFrame, questions: DataFrame, config: RetrievalConfig = RetrievalConfig(), scope: DataFrame | None = None, plugged: Models | None = None, index=None) -> DataFrame:
    """(query_id, answer, confidence, n_sources, mode, scorer, llm_used, notice): an answer to every question of a batch.

    With a model (``plugged.generate``) it writes the answer from the numbered passages; without one, or for the questions it fails on, the answer
    is made of the passages' own sentences under a note that says so. Markers of no source are dropped.
    """
    plugged = plugged or default_models(config)
    empty = as_chunks(chunks).isEmpty()
    if empty or in_scope(as_chunks(chunks), scope).isEmpty():
        told = questions.select("query_id", F.lit(NO_DOCUMENTS if empty else NONE_LEFT).alias("answer"), F.lit("Insufficient Evidence").alias("confidence"), F.lit(0).cast("bigint").alias("n_sources"), F.lit("none").alias("mode"), F.lit("keyword").alias("scorer"))
        return told.withColumns({"llm_used": F.lit(False), "notice": F.lit(None).cast("string")})
    passages = cut_lineage(retrieve(chunks, questions, config, scope, plugged, index))
    built = answers.extractive_answers(passages).withColumnRenamed("answer", "extracted")
    tops = passages.groupBy("query_id").agg(F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top"), F.count("*").alias("n_sources"), *(F.first(c).alias(c) for c in ("mode", "scorer", "low_relevance")))
    rows = questions.select("query_id").join(built, "query_id", "left").join(tops, "query_id", "left")
    failed, written, used = F.lit("no model is configured"), F.col("extracted"), F.lit(False)
    if plugged.generate is not None:
        block = answers.passage_block(*(F.col(c) for c in ("rank", "filename", "page", "page_end", "section", "text")))
        prompts = passages.withColumn("block", block).groupBy("query_id").agg(F.concat(F.first("question"), F.lit("\n\n"), answers.in_order("rank", "block", "\n\n")).alias("prompt"))
        replies = prompts.withColumn("reply", models.generated(plugged.generate, F.col("prompt"))).select("query_id", "reply")
        rows = rows.join(replies, "query_id", "left")
        used = F.coalesce(F.col("reply.text").rlike(r"\S"), F.lit(False))
        failed = F.coalesce(T.error_message(F.lit(0), F.col("reply.error")), F.lit("no answer"))
        shown, _ = answers.split_at_mark(F.col("reply.text"))
        written = F.when(used, T.normal_markers(T.strip(shown), F.col("n_sources"))).otherwise(F.col("extracted"))
    found = F.coalesce(F.col("n_sources"), F.lit(0).cast("bigint"))
    rows = rows.withColumns({"llm_used": used, "bare": F.coalesce(written, F.lit(T.NOT_FOUND)), "n": found})
    notice = F.when((F.col("n") > 0) & ~F.col("llm_used"), answers.extractive_notice(failed))
    label = answers.confidence(F.col("bare"), F.col("top"), F.coalesce("scorer", F.lit("keyword")), F.coalesce("low_relevance", F.lit(False)), F.coalesce("mode", F.lit("keyword")))
    return rows.select("query_id", F.concat(F.coalesce(notice, F.lit("")), "bare").alias("answer"), label.alias("confidence"), F.col("n").alias("n_sources"), F.coalesce("mode", F.lit("keyword")).alias("mode"), F.coalesce("scorer", F.lit("keyword")).alias("scorer"), "llm_used", notice.alias("notice"))


def spread_passages(chunks: DataFrame, budget: int = SUMMARY_CHARS) -> DataFrame:
    """Passages spread evenly through each document, within a budget of characters shared by all documents.

    ``chunks``: doc_id, chunk_id, ordinal (from 0), n_chars.
    """
    docs = chunks.groupBy("doc_id").agg(F.count("*").alias("cnt"), F.avg("n_chars").alias("mean"))
    number = docs.agg(F.count("*").alias("docs"))
    sized = docs.join(F.broadcast(number)).withColumn("n", F.greatest(F.lit(1), F.least(F.col("cnt"), F.floor(F.floor(F.lit(budget) / F.col("docs")) / F.greatest("mean", F.lit(1.0))))).cast("int"))
    picks = sized.select("doc_id", F.explode(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.floor(i * F.col("cnt") / F.col("n")).cast("int"))).alias("ordinal")).distinct()
    return chunks.join(picks, ["doc_id", "ordinal"], "left_semi")


def with_ordinals(rows: DataFrame, doc: str, order: list[str]) -> DataFrame:
    return rows.withColumn("ordinal", F.row_number().over(Window.partitionBy(doc).orderBy(*order)) - 1)


def status(chunks: DataFrame, registry: DataFrame, config: RetrievalConfig, plugged: Models, in_sync: bool = True) -> DataFrame:
    """One row: what is active, how much is held, and what users should know of."""
    scorer = scorer_of(config.rerank, plugged)
    warnings = [text for text, on in (("No LLM configured: answers are extracted sentences, not AI-written.", plugged.generate is None), ("No embedding model available: using keyword search only.", plugged.embed is None), ("Semantic index not ready.", plugged.embed is not None and not in_sync), (f"Reranking by {config.rerank} isn't available: using keyword reranking instead.", scorer != config.rerank)) if on]
    counts = registry.agg(F.countDistinct("doc_id").alias("documents")).crossJoin(chunks.agg(F.countDistinct("chunk_id").alias("chunks")))  # one row each
    return counts.select("documents", "chunks", F.lit(plugged.generate is not None).alias("llm_available"), F.lit(plugged.embed is not None and in_sync).alias("vectors_ready"), F.lit(scorer).alias("reranker"), F.array_join(F.array_sort(F.array(*(F.lit(k.upper()) for k in T.PARSERS))), ", ").alias("supported_formats"), F.array(*map(F.lit, warnings)).cast("array<string>").alias("warnings"))
