"""Streaming: incremental ingest of documents and bounded memory of conversations."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from docloom.functions import text as T
from docloom.operators import chunking, library


def ingest(documents: DataFrame, folder: str, checkpoint: str, strategy: str = "structure", available_now: bool = True) -> StreamingQuery:
    """Chunks every new document (doc_id, text) of a stream and appends to ``folder``; a document already there is passed over.

    Known documents are a table of their ids, ``folder``/_known, not the chunks. Both lie in a folder of the stream's own id (which lives in its
    checkpoint) and batch: a batch that is run again writes its folder anew, and another stream, or this one with a new checkpoint, another.
    """
    token: list[str] = []

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        own = f"run={token[0]}/batch={number}"
        fresh = batch.where(F.col("text").rlike(r"\S")).withColumn("doc_id", T.content_id(F.col("text"))).dropDuplicates(["doc_id"])
        if _exists(spark, f"{folder}/_known"):
            known = spark.read.parquet(f"{folder}/_known").where(~((F.col("run") == token[0]) & (F.col("batch") == number)))
            fresh = fresh.join(known.select("doc_id").distinct(), "doc_id", "left_anti")
        fresh = fresh.persist()
        chunking.chunk(fresh, strategy).write.mode("overwrite").parquet(f"{folder}/{own}")
        fresh.select("doc_id").write.mode("overwrite").parquet(f"{folder}/_known/{own}")
        fresh.unpersist()

    spark = documents.sparkSession
    writer = documents.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    token.append(_stream_id(spark, checkpoint))
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _exists(spark: SparkSession, name: str) -> bool:
    files, path = _path(spark, name)
    return files.exists(path)


def _stream_id(spark: SparkSession, checkpoint: str) -> str:
    """A name for the run of a stream, kept beside its checkpoint: the same after a restart, a new one for a new checkpoint."""
    name = f"{checkpoint}/docloom-run"
    if not _exists(spark, name):
        spark.createDataFrame([(uuid.uuid4().hex,)], "run string").coalesce(1).write.mode("overwrite").text(name)
    return spark.read.text(name).first()[0]


class Memory(StatefulProcessor):
    """The last turns of each conversation, as list state that is forgotten when nothing was said for ``hours``."""

    def __init__(self, hours: int):
        self.hours = hours

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.turns = handle.getListState("turns", "turn bigint, question string, answer string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = [tuple(t) for t in self.turns.get()] if self.turns.exists() else []
        for frame in rows:
            held += [(int(r.turn), r.question, r.answer) for r in frame.itertuples()]
        held = sorted({t[0]: t for t in held}.values())[-library.TURNS :]
        self.turns.put(held)
        for timer in [*self.handle.listTimers()]:
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.hours * 3_600_000)
        yield pd.DataFrame({"conversation_id": [key[0]] * len(held), "turn": [t[0] for t in held], "question": [t[1] for t in held], "answer": [t[2] for t in held]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.turns.clear()
        yield pd.DataFrame({"conversation_id": pd.Series(dtype=str), "turn": pd.Series(dtype="int64"), "question": pd.Series(dtype=str), "answer": pd.Series(dtype=str)})

    def close(self) -> None:
        pass


def memory(turns: DataFrame, hours: int = 24) -> DataFrame:
    """The memory of each conversation after every batch of a stream of turns; state is bounded by the conversations of the last ``hours``.

    The limit on the number of conversations is ``library.remembered``'s, over what this writes.
    """
    stored = turns.where("conversation_id is not null").select("conversation_id", "turn", "question", library.stored_answer(F.col("answer")).alias("answer"))
    return stored.groupBy("conversation_id").transformWithStateInPandas(Memory(hours), "conversation_id string, turn bigint, question string, answer string", "Update", "ProcessingTime")


def event_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and sums of events by type and window, with late rows bounded by a watermark (an extra over ``events``)."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def read_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)
