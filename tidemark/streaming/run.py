"""Running a streaming query over what is there, and the folders that it needs."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def workspace(spark: SparkSession) -> str:
    """A new folder that the driver and all executors share: under spark.checkpoint.dir, or, where that isn't set, a
    temporary one of this machine, which only a local session may use."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tidemark-stream-")
    return f"{folder}/{uuid.uuid4().hex}"


def drain(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Runs the query over everything that its sources have, with a checkpoint in `folder`, and gives the rows that it
    wrote. Called again with that folder, it goes on where it stopped. In update and complete mode each batch is
    written apart, under its number, so that a repeated batch replaces itself; they have a column `batch`."""
    spark = stream.sparkSession
    writer = stream.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        query = writer.outputMode("append").format("parquet").option("path", f"{folder}/rows").start()
    else:
        query = writer.outputMode(mode).foreachBatch(lambda rows, n: rows.write.mode("overwrite").parquet(f"{folder}/rows/batch={n}")).start()
    query.awaitTermination()
    return spark.read.schema(_schema(stream, mode)).parquet(f"{folder}/rows")


def follow(stream: DataFrame, folder: str, write, every: str = "60 seconds", mode: str = "append") -> StreamingQuery:
    """Starts the query with a checkpoint each `every`; `write` is what foreachBatch calls, with a repeated batch under the
    same number. Stopped and called again with that folder, it goes on where it stopped."""
    return stream.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(processingTime=every).outputMode(mode).foreachBatch(write).start()


def _schema(stream: DataFrame, mode: str) -> str:
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema)
    return kinds if mode == "append" else f"{kinds}, batch long"


def use_rocksdb(spark: SparkSession) -> None:
    """State in RocksDB with incremental checkpoints, for queries that are started from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def saved_state(spark: SparkSession, folder: str) -> DataFrame:
    """What a query's last checkpoint holds, as (key, value) rows."""
    return spark.read.format("statestore").load(f"{folder}/checkpoint").select("key", "value")


def watermark_delay(delay_seconds: int, skew_seconds: int = 0) -> str:
    """The delay of a watermark over sources whose clocks may differ by so much."""
    return f"{delay_seconds + skew_seconds} seconds"
