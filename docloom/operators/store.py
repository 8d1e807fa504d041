"""The library as a store of Parquet folders: chunks, vectors and the registry, added to, replaced in and deleted from.

Every change writes folders of its own and then one line into ``commits``; what no commit names isn't there, so a change that dies half-way leaves
nothing behind. Deletions are tombstones: rows of a document written before its tombstone are hidden by an anti-join. Nothing is rewritten
for a change; ``compact`` does that when asked.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import chunking, library, vectors

CHUNKS = "doc_id string, chunk_id string, filename string, chunk_index int, page int, page_end int, section string, text string, char_count int"
VECTORS = "doc_id string, chunk_id string, signature string, embedding array<double>"
REGISTRY = "doc_id string, filename string, file_type string, size_bytes bigint, chunk_count bigint, page_count int, created_at timestamp"
COOLDOWN = 300.0


class NotReady(RuntimeError):
    """Vectors are asked for that the store doesn't hold in its signature."""


class Store:
    def __init__(self, spark: SparkSession, folder: str, embed: Callable[[Column], Column] | None = vectors.embedded, signature: str = "hashing-64", dim: int = 64, strategy: str = "structure"):
        self.spark, self.folder, self.embed, self.signature, self.dim, self.strategy = spark, folder, embed, signature, dim, strategy
        self.failed_at, self.last_error = -COOLDOWN, ""

    # ---- reading

    def _commits(self) -> DataFrame:
        schema = "batch string, seq bigint"
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/commits")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).json(f"{self.folder}/commits")

    def _rows(self, name: str, schema: str, hidden: bool = False) -> DataFrame:
        """Rows of the committed batches, deleted documents left out unless ``hidden``; a batch is a partition, so others aren't read."""
        seqs = {r["batch"]: r["seq"] for r in self._commits().collect()}  # a line a change
        paths = [f"{self.folder}/{name}/batch={batch}" for batch in seqs if self._there(f"{self.folder}/{name}/batch={batch}")]
        if not paths:
            return self.spark.createDataFrame([], schema + ", seq bigint")
        rows = self.spark.read.schema(schema + ", batch string").option("basePath", f"{self.folder}/{name}").parquet(*paths)
        rows = rows.join(F.broadcast(self._commits()), "batch").drop("batch")
        if hidden or name == "removed":
            return rows
        gone = self._rows("removed", "doc_id string").groupBy("doc_id").agg(F.max("seq").alias("gone"))
        return rows.join(gone, "doc_id", "left").where("gone is null or gone < seq").drop("gone")

    def _there(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def chunks(self) -> DataFrame:
        return self._rows("chunks", CHUNKS).drop("seq")

    def vectors(self) -> DataFrame:
        """Vectors of the store's signature."""
        return self._rows("vectors", VECTORS).where(F.col("signature") == self.signature).drop("seq")

    def documents(self) -> DataFrame:
        """The registry, newest first."""
        return self._rows("registry", REGISTRY).drop("seq").orderBy(F.desc("created_at"), "doc_id")

    def totals(self) -> DataFrame:
        return self._rows("registry", REGISTRY).agg(F.count("*").alias("documents"), F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("chunks"))

    def vectors_of(self, wanted: DataFrame) -> DataFrame:
        """(place, chunk_id, embedding) of ``wanted`` (place, chunk_id) in its order."""
        if not self.in_sync():
            raise NotReady("the index isn't in step with the chunks: call ensure_index()")
        return wanted.join(self.vectors().select("chunk_id", "embedding"), "chunk_id").select("place", "chunk_id", "embedding").orderBy("place")

    def missing(self) -> DataFrame:
        """Chunks without a vector of the store's signature."""
        return self.chunks().join(self.vectors().select("chunk_id"), "chunk_id", "left_anti")

    def in_sync(self) -> bool:
        return self.missing().isEmpty()

    # ---- writing

    def _commit(self, **frames: DataFrame) -> None:
        batch = uuid.uuid4().hex
        for name, rows in frames.items():
            rows.write.mode("overwrite").parquet(f"{self.folder}/{name}/batch={batch}")
        self.spark.createDataFrame([(batch, time.time_ns())], "batch string, seq bigint").coalesce(1).write.mode("append").json(f"{self.folder}/commits")

    def _embedded(self, chunks: DataFrame) -> DataFrame:
        right = F.assert_true(F.size("embedding") == self.dim, F.lit(f"the embedder's vectors don't have {self.dim} dimensions"))
        rows = chunks.select("doc_id", "chunk_id", F.lit(self.signature).alias("signature"), self.embed(F.col("text")).alias("embedding"))
        return rows.where(right.isNull())

    def add(self, documents: DataFrame) -> DataFrame:
        """Adds parsed documents (doc_id, filename, file_type, size_bytes, text) and gives (doc_id, filename, status): indexed, duplicate of one
        that is held, replaced (the document the name had before is deleted), or error for one without text."""
        held = self._rows("registry", REGISTRY).select("doc_id", F.col("filename").alias("held_name"))
        rows = documents.dropDuplicates(["doc_id"]).join(held.select("doc_id", F.lit(True).alias("held")), "doc_id", "left")
        names = held.groupBy(F.col("held_name").alias("filename")).agg(F.max("doc_id").alias("before"))
        rows = rows.join(names, "filename", "left")
        blank = ~F.coalesce(F.col("text").rlike(r"\S"), F.lit(False))
        status = F.when(blank, "error").when(F.col("held"), "duplicate").when(F.col("before").isNotNull(), "replaced").otherwise("indexed")
        judged = rows.withColumn("status", status).persist()
        fresh = judged.where("status in ('indexed', 'replaced')")
        made = chunking.chunk(fresh, self.strategy).join(fresh.select(F.col("doc_id").cast("string").alias("doc_id"), "filename"), "doc_id")
        self.add_chunks(made.select(*[c.split()[0] for c in CHUNKS.split(", ")]), fresh.select("doc_id", "file_type", "size_bytes"))
        replaced = judged.where("status = 'replaced'").select("filename")
        old = held.join(replaced, F.col("held_name") == F.col("filename"), "left_semi").join(fresh.select("doc_id"), "doc_id", "left_anti").select("doc_id")
        self._remove(old)
        out = self.spark.createDataFrame(judged.select("doc_id", "filename", "status").collect(), "doc_id string, filename string, status string")  # a line an upload
        judged.unpersist()
        return out

    def add_chunks(self, chunks: DataFrame, facts: DataFrame | None = None) -> None:
        """Adds chunks that are cut already; the registry is made of them, with ``facts`` (doc_id, file_type, size_bytes) where known."""
        entries = library.registry_from_chunks(chunks)
        if facts is not None:
            entries = entries.drop("file_type").join(facts, "doc_id", "left")
        else:
            entries = entries.withColumn("size_bytes", F.lit(None).cast("bigint"))
        entries = entries.select("doc_id", "filename", "file_type", F.col("size_bytes").cast("bigint").alias("size_bytes"), F.col("chunk_count").cast("bigint").alias("chunk_count"), F.col("page_count").cast("int").alias("page_count"), F.current_timestamp().alias("created_at"))
        frames = {"chunks": chunks, "registry": entries}
        if self.embed is not None:
            frames["vectors"] = self._embedded(chunks)
        self._commit(**frames)

    def _remove(self, ids: DataFrame) -> int:
        found = [r[0] for r in ids.select("doc_id").distinct().collect()]  # a line a deleted document
        if found:
            self._commit(removed=self.spark.createDataFrame([(x,) for x in found], "doc_id string"))
        return len(found)

    def delete(self, ids: DataFrame) -> int:
        """Deletes the documents of ``ids`` (doc_id) and says how many there were; nothing is embedded again."""
        return self._remove(ids.select("doc_id").join(self._rows("registry", REGISTRY).select("doc_id"), "doc_id", "left_semi"))

    def ensure_index(self, force: bool = False) -> bool:
        """Embeds what has no vector of the store's signature; after a failure not again for a while unless forced."""
        if self.embed is None or (not force and time.monotonic() - self.failed_at < COOLDOWN):
            return False
        lost = self.missing()
        if not lost.isEmpty():
            try:
                self._commit(vectors=self._embedded(lost))
            except Exception as problem:  # noqa: BLE001 - an embedder may fail in any way
                self.failed_at, self.last_error = time.monotonic(), str(problem)[:300]
                return False
        return True

    def compact(self, folder: str) -> Store:
        """The visible rows as a new store of one batch each."""
        new = Store(self.spark, folder, self.embed, self.signature, self.dim, self.strategy)
        new._commit(chunks=self.chunks(), registry=self._rows("registry", REGISTRY).drop("seq"), vectors=self.vectors())
        return new
