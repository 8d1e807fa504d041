"""Session settings, table reading and lineage cuts shared by every operator."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(app: str = "docloom", master: str | None = None, partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with the engine's settings; ``partitions`` sets the shuffle width where AQE has no say yet."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One Parquet table (a file or a folder of files) of a data folder."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the cluster's checkpoint folder and reads it back, so that a lost executor never costs a recomputation.

    The folder is the one the session names in ``spark.checkpoint.dir``. Only a local session without one gets a temporary folder, removed
    at its end; on a cluster it has to be named, as a folder of one machine would be lost with it.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder")
        if not named:
            named = tempfile.mkdtemp(prefix="docloom-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        context.setCheckpointDir(named)
    return df.checkpoint(eager=True)
