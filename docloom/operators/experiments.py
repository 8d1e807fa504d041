"""Experiments: ways of chunking by ways of retrieving, measured on a set of questions, written pair by pair and taken up again where they ended."""

from __future__ import annotations

import json
import time
from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import chunking, evaluation, library
from docloom.plans import retrieval
from docloom.session import cut_lineage

DEPTH = 10
#: Ways of chunking (strategy, size, overlap) and of retrieving that are compared by default.
CHUNKINGS = {"structure-300": ("structure", 300, 50), "structure-500": ("structure", 500, 100), "structure-250": ("structure", 250, 50), "structure-1000": ("structure", 1000, 200), "fixed-250": ("fixed", 250, 50), "fixed-500": ("fixed", 500, 100), "fixed-500-no-overlap": ("fixed", 500, 0), "sentence-250": ("sentence", 250, 50), "sentence-500": ("sentence", 500, 100), "semantic-500": ("semantic", 500, 0)}
RETRIEVALS = {
    "dense-only": retrieval.RetrievalConfig(use_bm25=False, rerank="none", summaries=False),
    "bm25-only": retrieval.RetrievalConfig(use_dense=False, rerank="none", summaries=False),
    "hybrid-rrf": retrieval.RetrievalConfig(rerank="none", summaries=False),
    "hybrid+keyword": retrieval.RetrievalConfig(rerank="keyword", summaries=False),
    "hybrid+mmr": retrieval.RetrievalConfig(rerank="mmr", summaries=False),
    "hybrid+sentence": retrieval.RetrievalConfig(rerank="sentence", summaries=False),
    "hybrid+cross-encoder": retrieval.RetrievalConfig(rerank="cross-encoder", summaries=False),
}
BASELINE = ("structure-300", "hybrid-rrf")


@dataclass
class Trace:
    """Milliseconds by stage; a stage entered again adds up, and nested stages count for themselves."""

    stages: dict[str, float] = field(default_factory=lambda: defaultdict(float))

    @contextmanager
    def stage(self, name: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            self.stages[name] += (time.perf_counter() - began) * 1000


def unavailable(config: retrieval.RetrievalConfig, plugged: retrieval.Models) -> str | None:
    """Why a way of retrieving can't run with these models, or None."""
    if retrieval.scorer_of(config.rerank, plugged) != config.rerank:
        return f"no model for reranking by {config.rerank}; keyword reranking would run instead"
    if plugged.embed is None and config.use_dense:
        return "no embedding model; keyword search alone would run instead"
    return None


def run(spark: SparkSession, documents: DataFrame, questions: DataFrame, folder: str, chunkings: dict | None = None, retrievals: dict | None = None, plugged: retrieval.Models | None = None) -> dict:
    """Measures every pair and returns {(chunking, retrieval): reason} of those left out.

    ``documents``: doc_id STRING, filename, text; ``questions``: query_id BIGINT, question, type, evidence ARRAY<STRUCT<doc, text>>, evidence_mode. Rows go
    to ``folder``/rows by pair, one per question; a pair that is there already is passed over, so a run that broke off goes on. Chunks of a
    way of chunking are made once.
    """
    plugged = plugged or retrieval.default_models(retrieval.RetrievalConfig())
    left_out = {}
    spans = questions.where("size(evidence) > 0").select(F.col("query_id").alias("qid"), "evidence_mode", F.posexplode("evidence").alias("at", "e"))
    evidence = cut_lineage(spans.select("qid", (F.col("at") + 1).alias("span_no"), F.col("e.doc").alias("doc"), F.col("e.text").alias("span"), F.col("evidence_mode").alias("mode")))
    for chunk_name, (strategy, size, overlap) in (chunkings or CHUNKINGS).items():
        chunks = None
        for name, config in (retrievals or RETRIEVALS).items():
            path = f"{folder}/rows/chunking={chunk_name}/retrieval={name}"
            reason = unavailable(config, plugged)
            if reason or _written(spark, path):
                left_out[chunk_name, name] = reason or "finished before"
                continue
            trace = Trace()
            if chunks is None:
                with trace.stage("index"):
                    named = documents.select(F.col("doc_id").cast("string").alias("doc_id"), "filename")
                    chunks = cut_lineage(chunking.chunk(documents, strategy, size, overlap).join(named, "doc_id"))
            with trace.stage("retrieval"):
                asked = questions.select("query_id", "question", F.lit(DEPTH).alias("top_k"))
                ranked = cut_lineage(retrieval.retrieve(chunks, asked, config, plugged=plugged))
            rows = measured(ranked, chunks, evidence, questions).withColumn("ms", F.lit(trace.stages["retrieval"]) / F.greatest(F.lit(1), F.lit(questions.count())))
            rows.withColumn("wanted", F.lit(config.rerank)).write.mode("overwrite").parquet(path)
    return left_out


def _written(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def measured(ranked: DataFrame, chunks: DataFrame, evidence: DataFrame, questions: DataFrame) -> DataFrame:
    """One row per question with evidence: metrics, what is reachable, tokens and the projected cost of its prompt."""
    lists = ranked.select(F.col("query_id").alias("qid"), "rank", F.col("filename").alias("doc"), "text")
    reach = evaluation.best_recall(chunks.select("chunk_id", F.col("filename").alias("doc"), "text"), evidence)
    facts = evidence.groupBy("qid").agg(F.count("*").alias("n_spans"), (F.min("mode") == "any").alias("any_mode")).join(reach, "qid")
    marks = evaluation.graded(lists, evidence.select("qid", "span_no", "doc", "span"))
    scored = evaluation.metrics(marks, facts.withColumn("n_relevant", F.col("n_relevant").cast("int")))
    prompt = ranked.groupBy(F.col("query_id").alias("qid")).agg(F.sum(T.estimated_tokens(F.col("text"))).alias("prompt_tokens"), F.first("scorer").alias("scorer"))
    kinds = questions.select(F.col("query_id").alias("qid"), "type")
    rows = scored.join(facts.select("qid", "max_recall"), "qid").join(prompt, "qid", "left").join(kinds, "qid")
    return rows.withColumn("cost", library.cost(F.lit("gemini-2.0-flash"), F.col("prompt_tokens"), F.lit(library.PROJECTED["medium"]), F.lit("api")))


def results(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/rows")


def report(spark: SparkSession, folder: str) -> str:
    """Writes ``folder``/summary as JSON and gives the tables as Markdown: every pair, and MRR by chunking and retrieval."""
    summary = cut_lineage(evaluation.config_summary(results(spark, folder)))
    summary.coalesce(1).write.mode("overwrite").json(f"{folder}/summary")
    rows = [json.loads(r) for r in summary.orderBy("chunking", "retrieval").toJSON().collect()]  # a row a pair
    names = ("recall_5", "mrr", "hit_5", "ms_p50", "ms_p95", "usd_per_1k", "fallbacks")
    lines = ["| chunking | retrieval | " + " | ".join(names) + " |", "|" + "-|" * (len(names) + 2)]
    lines += [f"| {r['chunking']} | {r['retrieval']} | " + " | ".join(str(r.get(n, "-")) for n in names) + " |" for r in rows]
    ways = sorted({r["retrieval"] for r in rows})
    lines += ["", "| MRR | " + " | ".join(ways) + " |", "|" + "-|" * (len(ways) + 1)]
    for row in evaluation.grid(summary, "mrr").orderBy("chunking").collect():
        lines.append(f"| {row['chunking']} | " + " | ".join(str(row[w]) if row[w] is not None else "-" for w in ways) + " |")
    return "\n".join(lines)
