"""Streams of pages to content: the same operators over ``readStream``, and a seen-set that survives restarts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions import urls

#: Files a micro-batch reads at most: the bound on what is in flight.
MAX_FILES = 1000


def page_stream(spark: SparkSession, path: str, schema: StructType, max_files: int = MAX_FILES) -> DataFrame:
    """Pages as they are added to a folder of parquet files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def first_seen(rows: DataFrame, url_col: str = "url", time_col: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Rows whose normalised address wasn't seen before; with a time column, within the delay (so that state is let go)."""
    keyed = rows.withColumn("_key", urls.normalize(F.col(url_col)))
    if time_col is None:
        return keyed.dropDuplicates(["_key"]).drop("_key")
    return keyed.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def run_available(rows: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hand every micro-batch of what is there now to ``each``; a restart with the same folder goes on after it."""
    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def local_iterator(rows: DataFrame) -> Iterator[Row]:
    """Results one partition at a time."""
    return rows.toLocalIterator()


def running_counts(events: DataFrame, key_col: str, name: str = "pages") -> DataFrame:
    """(key, n) of rows seen by key in each batch's update, kept in the state store."""

    def step(key, batches, state):
        n = state.get[0] if state.exists else 0
        for b in batches:
            n += len(b)
        state.update((n,))
        yield pd.DataFrame({"key": [key[0]], name: [n]})

    from pyspark.sql.streaming.state import GroupStateTimeout

    return events.groupBy(F.col(key_col)).applyInPandasWithState(step, f"key string, {name} long", "n long", "update", GroupStateTimeout.NoTimeout)
