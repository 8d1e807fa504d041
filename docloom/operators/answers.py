"""Answers from passages: prompt text, extractive answers, citations, confidence, follow-ups."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as T

#: Sentences of an extractive answer by style, and the marker before follow-up questions.
STYLE_SENTENCES = {"concise": 2, "medium": 5, "long": 10}
FOLLOW_UP_MARK = "<<<FOLLOWUPS>>>"


def passage_block(rank: Column, filename: Column, page: Column, page_end: Column, section: Column, text: Column) -> Column:
    """One numbered passage of a prompt; pages are named for PDF files only."""
    pages = F.when(F.lower(filename).endswith(".pdf") & page.isNotNull(), F.when(page_end > page, F.concat(F.lit("pp. "), page.cast("string"), F.lit("-"), page_end.cast("string"))).otherwise(F.concat(F.lit("p. "), page.cast("string"))))
    part = F.when(section.isNotNull() & (section != "General"), F.concat(F.lit("section: "), section))
    return F.concat(F.lit("["), rank.cast("string"), F.lit("] ("), F.concat_ws(" | ", filename, pages, part), F.lit(")\n"), text)


def in_order(order: str, value: str, between: str) -> Column:
    """Values of a group joined in order; for groups of a few passages or sentences."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]), between)


def extractive_answers(passages: DataFrame) -> DataFrame:
    """(query_id, answer) from ``passages`` (query_id, question, style, rank, text): the sentences that cover the question best.

    Sentences under 25 characters and headings are left out; the kept ones return to reading order, each with its source number. A text is
    cut into sentences and tokenised once, however many questions it answers.
    """
    limit = F.lit(STYLE_SENTENCES["medium"])
    for name, n in STYLE_SENTENCES.items():
        limit = F.when(F.lower("style") == name, F.lit(n)).otherwise(limit)
    keep = (F.length("sentence") >= 25) & ~F.startswith("sentence", F.lit("#"))
    asked = passages.groupBy("query_id").agg(F.min("question").alias("question"), F.min("style").alias("style")).withColumn("terms", F.array_distinct(T.tokens(F.col("question"))))
    texts = passages.select("text").distinct().select("text", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence")).where(keep).withColumn("own", T.tokens(F.col("sentence")))
    texts = texts.select(F.xxhash64("text").alias("h"), F.length("text").alias("size"), F.col("text").alias("body"), "pos", "sentence", "own")
    places = passages.select("query_id", "rank", "text", F.xxhash64("text").alias("h"), F.length("text").alias("size"))
    rows = places.join(texts, ["h", "size"]).where(F.col("text") == F.col("body")).drop("text", "body").join(asked.drop("question"), "query_id")
    rows = rows.withColumn("score", F.round(T.coverage(F.col("terms"), F.col("own")) + 0.15 / F.col("rank"), 9))
    best = rows.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "rank", "pos"))).where(F.col("place") <= limit)
    best = best.withColumn("line", F.concat("sentence", F.lit(" ["), F.col("rank").cast("string"), F.lit("]"))).withColumn("at", F.struct("rank", "pos"))
    concise = F.lower(F.first("style")) == "concise"
    joined = best.groupBy("query_id").agg(F.when(concise, in_order("at", "line", " ")).otherwise(F.concat(F.lit("- "), in_order("at", "line", "\n- "))).alias("answer"))
    every = passages.select("query_id").distinct()
    return every.join(joined, "query_id", "left").select("query_id", F.coalesce("answer", F.lit(T.NOT_FOUND)).alias("answer"))


def extractive_notice(reason: Column) -> Column:
    """Fixed value: what stands above an answer that no model wrote."""
    return F.concat(F.lit("> **Extractive answer** - the AI model is unavailable ("), reason, F.lit("). Below are the most relevant sentences from your documents.\n\n"))


def citations(passages: DataFrame) -> DataFrame:
    """Numbered citations of ranked passages: where each comes from, a snippet, its text and a rounded score."""
    snippet = F.concat(F.substring("text", 1, 300), F.when(F.length("text") > 300, F.lit("...")).otherwise(F.lit("")))
    place = [c for c in ("doc_id", "filename", "page", "page_end", "section") if c in passages.columns]
    return passages.select("query_id", F.concat(F.lit("source-"), F.col("rank").cast("string")).alias("id"), F.col("rank").alias("number"), "chunk_id", *place, snippet.alias("snippet"), "text", F.round("score", 4).alias("score"))


def select_cited(cited: DataFrame, answers: DataFrame) -> DataFrame:
    """The citations an answer names; all if it names none, none if it found nothing."""
    rows = cited.join(answers.select("query_id", T.cited_numbers(F.col("answer")).alias("named"), T.is_not_found(F.col("answer")).alias("nothing")), "query_id").where(~F.col("nothing"))
    rows = rows.withColumn("hit", F.array_contains("named", F.col("number")))
    rows = rows.withColumn("hits", F.sum(F.col("hit").cast("int")).over(Window.partitionBy("query_id")))
    return rows.where(F.col("hit") | (F.col("hits") == 0)).drop("named", "nothing", "hit", "hits")


def confidence(answer: Column, top: Column, scorer: Column, low_relevance: Column, mode: Column) -> Column:
    high, medium = F.when(scorer == "cross-encoder", 0.5).otherwise(0.55), F.when(scorer == "cross-encoder", 0.1).otherwise(0.35)
    return (
        F.when(top.isNull() | T.is_not_found(answer), "Insufficient Evidence").when(mode == "summary", "High").when(low_relevance, "Low")
        .when(top >= high, "High").when(top >= medium, "Medium").otherwise("Low")
    )


def split_at_mark(stream: Column) -> tuple[Column, Column]:
    """(visible answer, tail) of a model's output around the follow-up mark."""
    at = F.instr(stream, FOLLOW_UP_MARK)
    return F.when(at > 0, stream.substr(F.lit(1), at - 1)).otherwise(stream), F.when(at > 0, stream.substr(at + len(FOLLOW_UP_MARK), F.length(stream))).otherwise(F.lit(""))


def shown_parts(pieces: Iterable[str], mark: str = FOLLOW_UP_MARK) -> Iterator[str]:
    """The visible parts of a stream of text as they come, none of the mark or of what may become it; the text after it is returned."""
    held, pieces = "", iter(pieces)
    for piece in pieces:
        shown, found, tail = (held + piece).partition(mark)
        if found:
            yield shown
            return tail + "".join(pieces)
        kept = next((n for n in range(min(len(shown), len(mark) - 1), 0, -1) if mark.startswith(shown[-n:])), 0)
        held = shown[len(shown) - kept :]
        yield shown[: len(shown) - kept]
    yield held
    return ""


def answer_events(answered: DataFrame, cited: DataFrame) -> DataFrame:
    """(query_id, seq, event, payload): what a client is sent for each question, the sources, the text and the final record, as JSON."""
    sources = cited.groupBy("query_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("number", "id", "chunk_id", "snippet", "score")))).alias("sources"))
    rows = answered.join(sources, "query_id", "left")
    record = F.to_json(F.struct(*(c for c in answered.columns if c != "query_id")))
    events = F.array(F.struct(F.lit("sources").alias("event"), F.coalesce("sources", F.lit("[]")).alias("payload")), F.struct(F.lit("token").alias("event"), F.to_json(F.struct(F.col("answer").alias("text"))).alias("payload")), F.struct(F.lit("done").alias("event"), record.alias("payload")))
    return rows.select("query_id", F.posexplode(events).alias("seq", "e")).select("query_id", "seq", "e.event", "e.payload")


def parsed_follow_ups(tail: Column, most: int = 4) -> Column:
    """Up to four questions from the first JSON array of strings in the text."""
    items = F.from_json(F.regexp_extract(tail, r"(?s)\[.*\]", 0), "array<string>")
    return F.slice(F.filter(F.transform(F.coalesce(items, F.array().cast("array<string>")), T.strip), lambda q: q != ""), 1, most)


def follow_ups(passages: DataFrame, most: int = 3) -> DataFrame:
    """(query_id, suggestions): questions about the sections in rank order, then a summary of the first file."""
    last = F.element_at(F.split(F.coalesce("section", F.lit("")), " > "), -1)
    rows = passages.withColumn("topic", last)
    topics = rows.where((F.col("topic") != "") & (F.col("topic") != "General") & (F.length("topic") < 60)).groupBy("query_id", "topic").agg(F.min("rank").alias("rank"))
    topics = topics.select("query_id", "rank", F.concat(F.lit("Tell me more about "), "topic").alias("text"))
    files = passages.where("filename is not null").groupBy("query_id").agg(F.min(F.struct("rank", "filename")).alias("f")).select("query_id", F.lit(1_000_000).alias("rank"), F.concat(F.lit("Summarize "), F.col("f.filename")).alias("text"))
    kept = topics.unionByName(files).withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "text"))).where(F.col("n") <= most)
    return kept.groupBy("query_id").agg(in_order("n", "text", " / ").alias("suggestions"))
