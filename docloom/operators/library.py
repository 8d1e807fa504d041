"""The document library: identity, duplicates, replacement, registry, deletion, memory of conversations, costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.session import cut_lineage

#: USD per million tokens (input, output) of priced models.
PRICES = {"gemini-2.0-flash": (0.10, 0.40), "gemini-2.0-flash-lite": (0.075, 0.30), "gemini-2.5-flash": (0.30, 2.50), "gemini-2.5-flash-lite": (0.10, 0.40), "gemini-2.5-pro": (1.25, 10.00), "gemini-embedding-001": (0.15, 0.0)}
#: Providers whose calls cost nothing.
FREE = ("local", "local-onnx", "sentence-transformers")
#: Tokens of an answer by style, of a rewriting call (in, out) and of follow-up questions, for costs not yet measured.
PROJECTED, REWRITE_TOKENS, FOLLOW_UP_TOKENS = {"concise": 100, "medium": 250, "long": 900}, (250, 40), 60
TURNS, CONVERSATIONS, ANSWER_CHARS = 6, 200, 1200


def upload_status(uploads: DataFrame, identity: str, name: str, order: str, content: str) -> DataFrame:
    """Adds ``status``: error for blank content, duplicate for content already seen, replaced for a newer file of a known name, else indexed.

    A name is known once content new at its time came under it. Firsts are aggregates with map-side combine; blank contents and null names
    gather nowhere.
    """
    blank = ~F.coalesce(F.col(content).rlike(r"\S"), F.lit(False))
    own = uploads.withColumn("_same", F.when(~blank, F.col(identity)))
    firsts = own.where("_same is not null").groupBy("_same").agg(F.min(order).alias("_first"))
    names = own.where(F.col("_same").isNotNull() & F.col(name).isNotNull()).join(firsts, "_same").where(F.col(order) == F.col("_first")).groupBy(F.col(name).alias("_name")).agg(F.min(order).alias("_named"))
    rows = own.join(firsts, "_same", "left").join(names, F.col(name) == F.col("_name"), "left")
    status = F.when(blank, "error").when(F.col(order) > F.col("_first"), "duplicate").when(F.col(order) > F.col("_named"), "replaced").otherwise("indexed")
    return rows.withColumn("status", status).drop("_same", "_first", "_name", "_named")


def latest_by(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key, as one aggregate with map-side combine."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return best.select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest))


def placed(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Adds ``place``, from 1 in the whole order: ranges are sorted apart, and each range's rows count on from those before it."""
    ranged = cut_lineage(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    sizes = ranged.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.alias("a").join(sizes.alias("b"), F.col("b.part") < F.col("a.part"), "left").groupBy("a.part").agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("before"))  # a row a range
    own = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return ranged.join(F.broadcast(before), "part").withColumn("place", (own + F.col("before")).cast("int")).drop("part", "before")


def registry_from_chunks(chunks: DataFrame) -> DataFrame:
    """(doc_id, filename, file_type, chunk_count, page_count) of chunk rows."""
    out = chunks.groupBy("doc_id").agg(F.countDistinct("chunk_id").alias("chunk_count"), F.max(F.coalesce("page_end", "page", F.lit(1))).alias("page_count"), F.min("filename").alias("filename"))
    return out.select("doc_id", "filename", T.file_type(F.col("filename")).alias("file_type"), "chunk_count", "page_count")


def cost(model: Column, tokens_in: Column, tokens_out: Column, provider: Column) -> Column:
    """USD of a call: 0 for local providers, null for unpriced models."""
    name = F.regexp_replace(model, "^models/", "")
    price_in, price_out = F.lit(None).cast("double"), F.lit(None).cast("double")
    for known, (i, o) in PRICES.items():
        price_in, price_out = F.when(name == known, F.lit(i)).otherwise(price_in), F.when(name == known, F.lit(o)).otherwise(price_out)
    return F.when(provider.isin(*FREE), F.lit(0.0)).otherwise(F.round((tokens_in * price_in + tokens_out * price_out) / 1e6, 12))


def projected_cost(style: Column, prompt_tokens: Column, question_tokens: Column, whole: bool, model: str = "gemini-2.0-flash", embedding: str = "gemini-embedding-001") -> Column:
    """USD a question would cost: its answer and one embedding, or with ``whole`` also rewriting, follow-ups and three embeddings."""
    out = F.lit(PROJECTED["medium"])
    for name, tokens in PROJECTED.items():
        out = F.when(F.lower(style) == name, F.lit(tokens)).otherwise(out)
    extra_in, extra_out = (REWRITE_TOKENS[0], REWRITE_TOKENS[1] + FOLLOW_UP_TOKENS) if whole else (0, 0)
    written = cost(F.lit(model), prompt_tokens + extra_in, out + extra_out, F.lit("api"))
    return F.round(written + cost(F.lit(embedding), question_tokens * (3 if whole else 1), F.lit(0), F.lit("api")), 12)


def stored_answer(answer: Column) -> Column:
    """An answer as memory keeps it: no citation markers, cut at a blank before 1200 characters."""
    bare = T.strip(F.regexp_replace(F.coalesce(answer, F.lit("")), r"[ \t]*(?:\[\d{1,3}\])+", ""))
    return F.when(F.length(bare) > ANSWER_CHARS, F.concat(F.regexp_replace(bare.substr(1, ANSWER_CHARS), r" [^ ]*$", ""), F.lit(" ..."))).otherwise(bare)


def remembered(turns: DataFrame) -> DataFrame:
    """The last ``TURNS`` turns of the ``CONVERSATIONS`` conversations touched last; ``turns``: conversation_id, turn, question, answer."""
    own = Window.partitionBy("conversation_id").orderBy(F.desc("turn"))
    rows = turns.where("conversation_id is not null").withColumn("back", F.row_number().over(own)).where(F.col("back") <= TURNS)
    touched = rows.groupBy("conversation_id").agg(F.max("turn").alias("touched")).orderBy(F.desc("touched"), "conversation_id").limit(CONVERSATIONS)
    return rows.join(touched, "conversation_id", "left_semi").select("conversation_id", "turn", "question", stored_answer(F.col("answer")).alias("answer"))


def cleared(turns: DataFrame, gone: DataFrame) -> DataFrame:
    """The turns without those of the conversations in ``gone`` (conversation_id); clearing twice changes nothing."""
    return turns.join(gone.where("conversation_id is not null").select("conversation_id").distinct(), "conversation_id", "left_anti")


def history_prompt(kept: DataFrame) -> DataFrame:
    """(conversation_id, prompt) in order of turns."""
    line = F.concat(F.lit("User: "), F.coalesce("question", F.lit("")), F.lit("\nAssistant: "), "answer")
    rows = kept.select("conversation_id", "turn", line.alias("line"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"])
    return rows.groupBy("conversation_id").agg(F.concat(F.lit("Conversation so far:\n"), F.array_join(ordered, "\n"), F.lit("\n\n")).alias("prompt"))
