"""An append log as a stream: replayed at least once, applied once; slowed, retried and watched."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.manifest import upsert
from ..sources.volumes import shared


def log_stream(spark: SparkSession, folder: str, name: str, files: int | None = None) -> DataFrame:
    """A growing folder of Parquet files as a stream. files: how many a batch reads at most, which holds back a reader that would fall behind; None: all there are."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", name).option("recursiveFileLookup", False)
    return (stream.option("maxFilesPerTrigger", files) if files else stream).parquet(folder)


def acknowledged(apply: Callable[[DataFrame, int], None], top: str) -> Callable[[DataFrame, int], None]:
    """A sink that applies each batch once: a batch is acknowledged by a mark in the shared folder after it was applied. A batch that comes again with a mark is left; one whose apply failed has none, and comes again."""

    def sink(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        mark = spark._jvm.org.apache.hadoop.fs.Path(f"{top}/acks/{n}")
        store = mark.getFileSystem(spark._jsc.hadoopConfiguration())
        if not store.exists(mark):
            apply(batch, n)
            store.create(mark, True).close()

    return sink


def run(stream: DataFrame, sink: Callable[[DataFrame, int], None], top: str, every: str | None = None, attempts: int = 1) -> int:
    """Run a stream into a sink until all that is there is read, and give the number of starts.

    every: the interval between checkpoints, such as "10 seconds", for a stream
    that goes on; such a query is left running and must be stopped by its owner.
    attempts: how often a query that failed is started anew; each start goes on
    from the last checkpoint, as after a lost connection.
    """
    for n in range(1, attempts + 1):
        writer = stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{top}/log")
        try:
            query = (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
            if not every:
                query.awaitTermination()
            return n
        except StreamingQueryException:
            if n == attempts:
                raise
    return attempts


def replay(spark: SparkSession, folder: str, name: str, slot: str, version: str, top: str, files: int | None = None, attempts: int = 3) -> DataFrame:
    """The last version of each slot of a log, read as a stream.

    Each batch writes its own folder, whole, and is acknowledged then: a batch
    that runs again after a failure replaces what it wrote.
    """

    def merge(batch: DataFrame, n: int) -> None:
        upsert(batch, [slot], version).write.mode("overwrite").parquet(f"{top}/state/batch={n}")

    run(log_stream(spark, folder, name, files), acknowledged(merge, top), top, attempts=attempts)
    return upsert(spark.read.parquet(f"{top}/state").drop("batch"), [slot], version)


def scratch(spark: SparkSession) -> str:
    """A new folder where all executors can read and write."""
    return f"{shared(spark)}/{uuid.uuid4().hex}"


def usage_alerts(events: DataFrame, value: str, limit: float) -> DataFrame:
    """Rows of a stream or table at or above a limit."""
    return events.where(F.col(value) >= limit)


def watch(events: DataFrame, value: str, limit: float, top: str) -> DataFrame:
    """The alerts of a stream, appended to a table as they come; each once, as the sink commits by batch."""
    query = usage_alerts(events, value, limit).writeStream.format("parquet").option("path", f"{top}/alerts").option("checkpointLocation", f"{top}/watch").trigger(availableNow=True).start()
    query.awaitTermination()
    return events.sparkSession.read.schema(events.schema).parquet(f"{top}/alerts")
