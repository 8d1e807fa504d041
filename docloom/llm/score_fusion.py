"""Problem 2: one ranking from several scores on different scales.

Method: ideal-point ranking. Every list of scores is winsorised at Tukey's fences, shifted to start at 0 and divided by its vector norm,
so that no list's range counts. For each item the weighted distances to the ideal point (the best value of each list) and to the
anti-ideal point (the worst) are summed over all lists of its query; items are sorted by relative closeness to the ideal.

Lists that arrive as arrays are normalised inside their row, without a shuffle; lists that arrive as rows get their quartiles from
mergeable sketches. Both then meet in one (query, item) aggregate with map-side combine, so that a query that holds a third of all
scores is summed on every task and never gathered.

Defined cases: null, NaN and infinite scores count as missing; an item missing from a list stands at the list's median value; a list of
equal scores has no say; repeated rows count once (an item scored twice in a list keeps the higher score); ties in closeness go to the
item in more lists, then to the smaller id; null query or item ids are left out; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FENCE = 1.5


def _finite(score: Column) -> Column:
    score = score.cast("double")
    return F.when(~F.isnan(score) & (F.abs(score) < F.lit(float("inf"))), score)


def normalise_arrays(lists: DataFrame, query: str, name: str, entries: str, item: str, score: str) -> DataFrame:
    """Rows (query, list, item, value, best, middle) of lists held as arrays of structs; one row of ``lists`` is one list."""
    kept = F.filter(F.transform(F.col(entries), lambda e: F.struct(e[item].alias("item"), _finite(e[score]).alias("score"))), lambda e: e["score"].isNotNull() & e["item"].isNotNull())
    base = lists.select(F.col(query).alias("query"), F.col(name).alias("list"), kept.alias("entries")).where("query is not null and list is not null and size(entries) > 0")
    base = base.withColumn("ordered", F.array_sort(F.transform("entries", lambda e: e["score"]))).withColumn("n", F.size("ordered"))
    at = lambda share: F.element_at("ordered", F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(share))).cast("int"))
    base = base.withColumns({"q1": at(0.25), "q2": at(0.5), "q3": at(0.75)})
    base = base.withColumns({"low": F.greatest(F.col("q1") - FENCE * (F.col("q3") - F.col("q1")), F.element_at("ordered", 1)), "high": F.least(F.col("q3") + FENCE * (F.col("q3") - F.col("q1")), F.element_at("ordered", -1))})
    clip = lambda x: F.least(F.greatest(x, F.col("low")), F.col("high")) - F.col("low")
    base = base.withColumn("norm", F.sqrt(F.aggregate("ordered", F.lit(0.0), lambda acc, x: acc + clip(x) * clip(x))))
    scaled = lambda x: F.when(F.col("norm") > 0, clip(x) / F.col("norm")).otherwise(F.lit(0.0))
    values = F.transform("entries", lambda e: F.struct(e["item"].alias("item"), scaled(e["score"]).alias("value")))
    return base.select("query", "list", scaled(F.col("high")).alias("best"), scaled(F.col("q2")).alias("middle"), F.explode(values).alias("e")).select("query", "list", F.col("e.item").alias("item"), F.col("e.value").alias("value"), "best", "middle")


def normalise_rows(scores: DataFrame, query: str, item: str, score: str, name: str) -> DataFrame:
    """The same of scores held one a row; all rows of a query form the list ``name``."""
    rows = scores.select(F.col(query).alias("query"), F.col(item).alias("item"), _finite(F.col(score)).alias("score")).where("query is not null and item is not null and score is not null")
    rows = rows.groupBy("query", "item").agg(F.max("score").alias("score"))
    stats = rows.groupBy("query").agg(F.percentile_approx("score", [0.25, 0.5, 0.75], 10000).alias("q"), F.min("score").alias("least"), F.max("score").alias("most"))
    spread = FENCE * (F.col("q")[2] - F.col("q")[0])
    stats = stats.select("query", F.greatest(F.col("q")[0] - spread, "least").alias("low"), F.least(F.col("q")[2] + spread, "most").alias("high"), F.col("q")[1].alias("mid"))
    shifted = rows.join(stats, "query").withColumn("value", F.least(F.greatest("score", "low"), "high") - F.col("low"))
    norms = shifted.groupBy("query").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"), F.max(F.col("high") - F.col("low")).alias("top"), F.max(F.col("mid") - F.col("low")).alias("mid0"))
    scaled = lambda x: F.when(F.col("norm") > 0, x / F.col("norm")).otherwise(F.lit(0.0))
    joined = shifted.select("query", "item", "value").join(norms, "query")
    return joined.select("query", F.lit(name).alias("list"), "item", scaled(F.col("value")).alias("value"), scaled(F.col("top")).alias("best"), scaled(F.col("mid0")).alias("middle"))


def closeness(values: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(query, item, closeness, lists) from normalised values; ``weights`` by list name, 1 where none is given."""
    weight = F.lit(1.0)
    for name, x in (weights or {}).items():
        weight = F.when(F.col("list") == name, F.lit(float(x))).otherwise(weight)
    square = lambda x: x * x
    cells = values.groupBy("query", "item", "list").agg(F.max("value").alias("value"), F.max("best").alias("best"), F.max("middle").alias("middle")).withColumn("w", weight)
    away, near = square(F.col("best") - F.col("middle")), square(F.col("middle"))
    cells = cells.withColumns({"up": F.col("w") * (square(F.col("best") - F.col("value")) - away), "down": F.col("w") * (square(F.col("value")) - near)})
    per_list = values.groupBy("query", "list").agg(F.max("best").alias("best"), F.max("middle").alias("middle")).withColumn("w", weight)
    totals = per_list.groupBy("query").agg(F.sum(F.col("w") * away).alias("up0"), F.sum(F.col("w") * near).alias("down0"))
    items = cells.groupBy("query", "item").agg(F.sum("up").alias("up"), F.sum("down").alias("down"), F.count("*").alias("lists"))
    far = F.sqrt(F.greatest(F.col("up") + F.col("up0"), F.lit(0.0)))
    good = F.sqrt(F.greatest(F.col("down") + F.col("down0"), F.lit(0.0)))
    return items.join(totals, "query").select("query", "item", F.when(far + good > 0, F.round(good / (far + good), 9)).otherwise(F.lit(0.5)).alias("closeness"), "lists")


def heads(ranked: DataFrame) -> DataFrame:
    """The first item of every query."""
    first = ranked.groupBy("query").agg(F.min(F.struct(-F.col("closeness"), -F.col("lists"), F.col("item"))).alias("top"))
    return first.select("query", F.col("top.item").alias("item"))


def fuse(results: DataFrame, citations: DataFrame, least_scorers: int = 3) -> DataFrame:
    """(query, item, closeness, lists) for every query with at least ``least_scorers`` scorers; its citations form one more list."""
    many = results.where("query_id is not null and scorer is not null").groupBy("query_id").agg(F.size(F.collect_set("scorer")).alias("scorers")).where(F.col("scorers") >= least_scorers)
    lists = normalise_arrays(results, "query_id", "scorer", "chunks", "chunk_id", "score")
    cited = normalise_rows(citations, "query_id", "chunk_id", "score", "\u0000citations")
    values = lists.unionByName(cited).join(many.select(F.col("query_id").alias("query")), "query", "left_semi")
    return closeness(values)
