"""Evaluation: relevance of ranked passages to evidence, retrieval metrics, judging of answers, resampling."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as T

CUTS = (1, 3, 5, 10)
BUDGETS = (500, 1000, 2000)
COVERED = 0.5
SUPPORTED = 0.75


def graded(ranked: DataFrame, evidence: DataFrame) -> DataFrame:
    """(qid, rank, tokens, span_no or null): ranked passages with the evidence spans they cover; the document must be the span's.

    ``ranked``: qid, rank, doc, text; ``evidence``: qid, span_no, doc, span. One equi-join on question and document.
    """
    own = ranked.select("qid", "rank", "doc", "text", T.estimated_tokens(F.col("text")).alias("tokens"))
    hits = own.join(evidence, ["qid", "doc"]).where(T.span_coverage(F.col("span"), F.col("text")) >= COVERED).select("qid", "rank", "span_no")
    return own.select("qid", "rank", "tokens").join(hits, ["qid", "rank"], "left")


def metrics(marks: DataFrame, spans: DataFrame) -> DataFrame:
    """Metrics per question from ``graded`` rows and ``spans`` (qid, n_spans, any_mode, n_relevant)."""
    per_rank = marks.groupBy("qid", "rank").agg(F.max("tokens").alias("tokens"), F.collect_set("span_no").alias("spans"))
    lists = per_rank.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "tokens", "spans"))).alias("rows"))
    rows = lists.join(spans, "qid", "right").withColumn("rows", F.coalesce("rows", F.expr("cast(array() as array<struct<rank:int,tokens:int,spans:array<int>>>)")))
    is_hit = lambda r: F.size(r["spans"]) > 0
    hits = F.filter("rows", is_hit)

    def recall(upto: Column) -> Column:
        found = F.size(F.array_distinct(F.flatten(F.transform(upto, lambda r: r["spans"]))))
        return F.when(F.col("any_mode"), F.when(found > 0, F.lit(1.0)).otherwise(F.lit(0.0))).otherwise(found / F.col("n_spans"))

    out = [F.when(F.exists("rows", lambda r: is_hit(r) & (r["rank"] <= k)), 1.0).otherwise(0.0).alias(f"hit_{k}") for k in CUTS]
    out += [F.round(recall(F.filter("rows", lambda r: r["rank"] <= k)), 9).alias(f"recall_{k}") for k in CUTS]
    out.append((F.size(F.filter(hits, lambda r: r["rank"] <= 5)) / 5).alias("precision_5"))
    out.append(F.round(F.coalesce(1 / F.array_min(F.transform(hits, lambda r: r["rank"])), F.lit(0.0)), 9).alias("mrr"))
    gain = F.aggregate(F.filter(hits, lambda r: r["rank"] <= 10), F.lit(0.0), lambda acc, r: acc + 1 / F.log2(r["rank"] + F.lit(1.0)))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.col("n_relevant"), F.lit(10)), F.lit(1))), F.lit(0.0), lambda acc, i: acc + 1 / F.log2(i + F.lit(1.0)))
    out.append(F.round(F.when(F.col("n_relevant") > 0, gain / ideal).otherwise(F.lit(0.0)), 9).alias("ndcg_10"))
    out.append(F.aggregate(F.filter("rows", lambda r: r["rank"] <= 5), F.lit(0), lambda acc, r: acc + r["tokens"]).alias("tokens_5"))
    for budget in BUDGETS:
        used = lambda r: F.aggregate(F.filter("rows", lambda x: x["rank"] <= r["rank"]), F.lit(0), lambda acc, x: acc + x["tokens"])
        out.append(F.round(recall(F.filter("rows", lambda r, b=budget: used(r) <= b)), 9).alias(f"recall_{budget}t"))
    return rows.select("qid", *out)


def claims(answer: Column) -> Column:
    """Sentences of an answer that make a checkable statement."""
    # The patterns of markers, headings, bullets and source lines that are no claims.
    text = F.regexp_replace(F.coalesce(answer, F.lit("")), r"(?i)\*?\[(?:Doc|Source)[^\]]*\]\*?|\[\d{1,3}\]", "")
    lines = F.transform(F.split(text, "\n"), T.strip)
    lines = F.filter(lines, lambda x: (x != "") & ~x.rlike("^(?:#|>|---)") & ~x.contains("⚠️"))
    lines = F.transform(lines, lambda x: T.strip(F.regexp_replace(F.regexp_replace(x, "[*_`]+", ""), "^[-• ]+", "")))
    lines = F.filter(lines, lambda x: ~(x.endswith(":") & (F.length(x) < 120)) & ~x.rlike(r"(?i)^\S+\.(?:txt|md|pdf|docx?|html?|json|csv|py) \(Page \d+"))
    return F.filter(F.flatten(F.transform(lines, T.sentence_spans)), lambda s: F.size(T.content_words(s)) >= 4)


def windows(context: Column) -> Column:
    """Content words of every two neighbouring sentences of a context."""


    def pairs(sets: Column) -> Column:
        both = F.transform(F.sequence(F.lit(1), F.size(sets) - 1), lambda i: F.array_union(F.element_at(sets, i), F.element_at(sets, i + 1)))
        return F.when(F.size(sets) >= 2, both).otherwise(sets)

    return T.let(F.transform(T.sentence_spans(context), T.content_words), pairs)


def support(claim: Column, shown: Column, numbers: Column) -> Column:
    """How far one window of the context backs a claim; 0 where the claim has a number the context lacks."""
    missing = F.size(F.array_except(F.regexp_extract_all(claim, F.lit(r"\d+(?:\.\d+)?"), F.lit(0)), numbers)) > 0

    def backed(own: Column) -> Column:
        best = F.array_max(F.transform(shown, lambda w: F.size(F.array_intersect(own, w)) / F.size(own)))
        return F.when(F.size(own) == 0, 1.0).when(missing, 0.0).otherwise(F.coalesce(best, F.lit(0.0)))

    return T.let(T.content_words(claim), backed)


def faithfulness(rows: DataFrame) -> DataFrame:
    """Adds n_claims, n_unsupported and faithfulness (null without claims) to rows with ``answer`` and ``context``."""
    judged = rows.withColumns({"claims": claims(F.col("answer")), "shown": windows(F.col("context")), "numbers": F.regexp_extract_all(F.coalesce("context", F.lit("")), F.lit(r"\d+(?:\.\d+)?"), F.lit(0))})
    weak = F.filter("claims", lambda c: support(c, F.col("shown"), F.col("numbers")) < SUPPORTED)
    judged = judged.withColumns({"n_claims": F.size("claims"), "n_unsupported": F.size(weak)})
    return judged.withColumn("faithfulness", F.when(F.col("n_claims") > 0, F.round(1 - F.col("n_unsupported") / F.col("n_claims"), 9))).drop("claims", "shown", "numbers")


def is_abstention(answer: Column) -> Column:
    return T.is_not_found(answer) | F.coalesce(answer, F.lit("")).rlike(r"(?i)insufficient evidence|do not contain sufficient|does not contain (?:enough|sufficient)|not (?:mentioned|covered|addressed) in the (?:provided )?documents")


def bootstrap_means(values: DataFrame, group: str, value: str, rounds: int = 200, seed: int = 7) -> DataFrame:
    """(group, mean, low, high): the mean and the 95 % interval of means resampled with Poisson(1) weights, for values of any number.

    Weights come from a hash of the row and the round, so each row adds to every round where it stands; one aggregate with map-side combine
    holds groups x rounds sums, whatever the number of rows.
    """
    drawn = values.select(group, value, "row_key", F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round"))
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("row_key").cast("string"), F.col("round").cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("double") / 4294967296.0
    weight, total, cut = F.lit(0), 0.36787944117144233, 0.0
    for n in range(7):
        cut += total
        weight = weight + F.when(u >= cut, 1).otherwise(0)
        total /= n + 1
    sums = drawn.withColumn("w", weight).groupBy(group, "round").agg(F.sum(F.col("w") * F.col(value)).alias("s"), F.sum("w").alias("n")).where("n > 0")
    means = sums.groupBy(group).agg(F.percentile(F.col("s") / F.col("n"), 0.025).alias("low"), F.percentile(F.col("s") / F.col("n"), 0.975).alias("high"))
    point = values.groupBy(group).agg(F.avg(value).alias("mean"))
    return point.join(means, group).select(group, *(F.round(c, 6).alias(c) for c in ("mean", "low", "high")))


def exact_bootstrap(values: DataFrame, group: str, value: str, rounds: int = 2000, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """(group, mean, low, high) by resampling each group's values with replacement, nulls left out; for one row per question and configuration.

    The resamples are multinomial and their stream of numbers is fixed by the seed; a group is one task's work, in order of its values.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        held = np.sort(rows[value].dropna().to_numpy(dtype=float))
        low = high = mean = float("nan")
        if len(held):
            drawn = np.random.default_rng(seed)
            means = np.array([drawn.choice(held, size=len(held), replace=True).mean() for _ in range(rounds)])
            mean, low, high = held.mean(), np.quantile(means, alpha / 2), np.quantile(means, 1 - alpha / 2)
        return pd.DataFrame({group: [rows[group].iloc[0]], "mean": [mean], "low": [low], "high": [high]})

    kind = values.schema[group].dataType.simpleString()
    return values.select(group, value).groupBy(group).applyInPandas(run, f"{group} {kind}, mean double, low double, high double")


def paired_differences(scores: DataFrame, config: str, item: str, metric: str, baseline: str) -> DataFrame:
    """(config, item, difference) of every configuration to the baseline, only where both scored exactly the same items."""
    rows = scores.select(config, item, metric)
    base = rows.where(F.col(config) == baseline).select(item, F.col(metric).alias("base"))
    counts = rows.groupBy(config).agg(F.count("*").alias("own"))
    both = rows.where(F.col(config) != baseline).join(base, item)
    matched = both.groupBy(config).agg(F.count("*").alias("matched")).join(counts, config).crossJoin(base.agg(F.count("*").alias("all")))  # one row
    same = matched.where((F.col("matched") == F.col("own")) & (F.col("matched") == F.col("all"))).select(config)
    return both.join(same, config, "left_semi").select(config, item, (F.col(metric) - F.col("base")).alias("difference"))


def paired_bootstrap(scores: DataFrame, config: str, item: str, metric: str, baseline: str, rounds: int = 5000, seed: int = 0) -> DataFrame:
    """(config, n, difference, p): two-sided p that a configuration's mean equals the baseline's, by resampling centred differences."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        held = rows.sort_values(item)["difference"].to_numpy(dtype=float)
        centred, drawn = held - held.mean(), np.random.default_rng(seed)
        means = np.array([drawn.choice(centred, size=len(held), replace=True).mean() for _ in range(rounds)])
        p = float((np.abs(means) >= abs(held.mean())).mean())
        return pd.DataFrame({config: [rows[config].iloc[0]], "n": [len(held)], "difference": [held.mean()], "p": [p]})

    kind = scores.schema[config].dataType.simpleString()
    return paired_differences(scores, config, item, metric, baseline).groupBy(config).applyInPandas(run, f"{config} {kind}, n bigint, difference double, p double")


def best_recall(chunks: DataFrame, evidence: DataFrame) -> DataFrame:
    """(qid, max_recall, n_relevant): the recall any ranking of these chunks could reach, and the chunks that cover any span.

    ``chunks``: chunk_id, doc, text; ``evidence``: qid, span_no, doc, span, mode.
    """
    hits = chunks.join(evidence, "doc").where(T.span_coverage(F.col("span"), F.col("text")) >= COVERED)
    found = hits.groupBy("qid").agg(F.countDistinct("span_no").alias("spans"), F.countDistinct("chunk_id").alias("n_relevant"))
    asked = evidence.groupBy("qid").agg(F.count("*").alias("n"), (F.min("mode") == "any").alias("any_mode"))
    spans = F.coalesce("spans", F.lit(0))
    recall = F.when(F.col("any_mode"), (spans > 0).cast("double")).otherwise(spans / F.col("n"))
    return asked.join(found, "qid", "left").select("qid", F.round(recall, 9).alias("max_recall"), F.coalesce("n_relevant", F.lit(0).cast("bigint")).alias("n_relevant"))


def config_summary(rows: DataFrame) -> DataFrame:
    """One row per configuration over ``rows`` (chunking, retrieval, qid, recall_5, mrr, hit_5, ms, prompt_tokens, cost, wanted, scorer): means,
    median and 95th percentile of the time, cost of a thousand questions, and how many questions another reranker than the wanted one ranked."""
    mean = lambda c: F.round(F.avg(c), 4).alias(c)
    fallback = F.count(F.when(F.col("scorer") != F.col("wanted"), 1)).alias("fallbacks")
    spread = [F.round(F.percentile("ms", q), 2).alias(n) for q, n in ((0.5, "ms_p50"), (0.95, "ms_p95"))]
    return rows.groupBy("chunking", "retrieval").agg(F.count("*").alias("questions"), *(mean(c) for c in ("recall_5", "mrr", "hit_5")), *spread, F.round(F.avg("prompt_tokens"), 1).alias("prompt_tokens"), F.round(1000 * F.avg("cost"), 4).alias("usd_per_1k"), fallback)


def grid(summary: DataFrame, metric: str, ways: list[str] | None = None) -> DataFrame:
    """One row per chunking, one column per retrieval configuration: those of ``ways``, or those found."""
    return summary.groupBy("chunking").pivot("retrieval", ways).agg(F.first(metric))


def dataset_problems(items: DataFrame, names: DataFrame, chunks: DataFrame) -> DataFrame:
    """(id, problem, n): unknown documents, items without evidence, bad modes, ids with two versions, and evidence that isn't verbatim.

    ``items``: id, question, type, evidence, evidence_mode; ``names``: doc; ``chunks``: doc, text, in one of which evidence has to stand, case
    and white space aside.
    """
    rows = items.where("id is not null")
    one = F.lit(1).cast("bigint").alias("n")
    two = rows.select("id", "question", "type").distinct().groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("two versions").alias("problem"), "n")
    qa = rows.groupBy("id").agg(F.any_value("type").alias("type"), F.any_value("evidence").alias("evidence"), F.min("evidence_mode").alias("mode"))
    spans = qa.select("id", F.posexplode("evidence").alias("at", "e")).select("id", "at", F.col("e.doc").alias("doc"), F.col("e.text").alias("span")).where("doc is not null")
    lost = spans.join(names, "doc", "left_anti").groupBy("id").agg(F.count("*").alias("n")).select("id", F.lit("unknown document").alias("problem"), "n")
    squeezed = chunks.select("doc", T.squeeze(F.col("text")).alias("held"))
    asked = spans.join(names, "doc", "left_semi").withColumn("wanted", T.squeeze(F.col("span")))
    there = asked.join(squeezed, "doc").groupBy("id", "at").agg(F.bool_or(F.contains("held", F.col("wanted"))).alias("there"))
    changed = there.where("not there").groupBy("id").agg(F.count("*").alias("n")).select("id", F.lit("not verbatim").alias("problem"), "n")
    none = qa.where((F.size("evidence") == 0) & (F.col("type") != "unanswerable")).select("id", F.lit("no evidence").alias("problem"), one)
    bad = qa.where(~F.col("mode").isin("all", "any")).select("id", F.lit("bad mode").alias("problem"), one)
    return lost.unionByName(none).unionByName(bad).unionByName(two).unionByName(changed)


def calibration(rows: DataFrame) -> DataFrame:
    """One row: the judge's mean score of faithful answers, and the shares of put-in sentences and changed numbers it notices.

    ``rows``: answer, context, lent (a sentence of another document or null). A put-in sentence is noticed if the answer with it has more
    unsupported claims than without; only answers with figures have them changed.
    """
    plain = faithfulness(rows).withColumnRenamed("faithfulness", "faithful").withColumnRenamed("n_unsupported", "plain_unsupported").drop("n_claims")
    mixed = faithfulness(plain.withColumn("given", F.col("answer")).withColumn("answer", F.concat("answer", F.lit("\n"), "lent")))
    mixed = mixed.withColumn("noticed", F.when(F.col("lent").isNotNull(), (F.col("n_unsupported") > F.col("plain_unsupported")).cast("double"))).drop("n_claims", "n_unsupported", "faithfulness")
    swapped = faithfulness(mixed.withColumn("answer", F.translate("given", "0123456789", "3456789012")))
    swapped = swapped.withColumn("swap", F.when(F.col("given").rlike(r"\d"), (F.col("n_unsupported") > 0).cast("double")))
    return swapped.agg(F.round(F.avg("faithful"), 3).alias("faithful"), F.round(F.avg("noticed"), 3).alias("put_in_noticed"), F.round(F.avg("swap"), 3).alias("numbers_noticed"), F.count("*").alias("items"))
