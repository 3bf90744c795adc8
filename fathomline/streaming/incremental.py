"""Incremental indexing and retries as streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..operators.rules import BLOCK_ERRORS, SKIP_ERRORS
from ..operators.tables import upsert
from ..sources.lists import has_version, read_versioned, write_versioned

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def index_files(spark: SparkSession, folder: str, table: str, checkpoint: str, extract: Callable[[DataFrame], DataFrame], keys: list[str]) -> StreamingQuery:
    """Reads files that came since the last run, and replaces their rows in a versioned table: by content, and by path.

    `extract` makes rows of a batch of binary files.  The run ends when all files there are have been taken."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", True).load(folder)

    def merge(batch: DataFrame, _: int) -> None:
        rows = extract(batch)
        if has_version(spark, table):
            rows = upsert(read_versioned(spark, table, schema=rows.schema), rows, keys)
        write_versioned(rows, table)

    return files.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class RetryState(StatefulProcessor):
    """A video's status over a stream of attempts: as final_states, but across batches.  State: one small row a video."""

    def __init__(self, most: int = 3):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        schema = StructType([StructField("status", StringType()), StructField("attempts", IntegerType()), StructField("error", StringType())])
        self.state = handle.getValueState("state", schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        status, attempts, error = self.state.get() if self.state.exists() else ("pending", 0, None)
        for row in pd.concat(list(rows)).sort_values("n").itertuples():
            if status != "pending":
                break
            name = None if row.error is None or row.error != row.error else row.error
            attempts += name is not None
            if name is None:
                status, error = "done", None
            elif name in BLOCK_ERRORS:
                continue
            else:
                error = name
                status = "skipped" if name in SKIP_ERRORS else "failed" if attempts >= self.most else "pending"
        self.state.update((status, attempts, error))
        yield pd.DataFrame({"video_id": [key[0]], "status": [status], "attempts": [attempts], "error": [error]})

    def close(self) -> None:
        pass


def retry_states(attempts: DataFrame, most: int = 3) -> DataFrame:
    """(video_id, status, attempts, error) after each batch of a stream of attempts (video_id, n, error)."""
    out = "video_id string, status string, attempts int, error string"
    return attempts.groupBy("video_id").transformWithStateInPandas(RetryState(most), out, "Update", "None")


def event_counts(events: DataFrame, every: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts by window and kind of a stream (ts, event_type), final once `late` has passed."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", every), "event_type").agg(F.count("*").alias("n"))
