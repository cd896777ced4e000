"""Incremental ingest and features, session by session.

A session is complete when it arrives, so the target's list of recorded sessions is all the state that is needed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from strideframe.config import FeatureConfig
from strideframe.operators.features import feature_frame
from strideframe.sinks import append_unseen, recorded_keys


def ingest_stream(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str,
                  transform: Callable[[DataFrame], DataFrame] = lambda df: df, source_format: str = "parquet",
                  key: str = "session_id") -> None:
    """Drain the files that arrived since the last run into the target, then stop.

    Rows are read with `sinks.read_appended`. A batch repeated after a failure appends what was not published,
    and nothing if its sessions are already recorded.
    """
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).format(source_format).load(source)

    def add(batch: DataFrame, _: int) -> None:
        append_unseen(transform(batch), target, key)

    query = (stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()


def pending(events: DataFrame, target: str, key: str = "session_id") -> DataFrame:
    """Events of sessions the feature table does not hold."""
    seen = recorded_keys(events.sparkSession, target)
    return events if seen is None else events.join(seen, events[key].eqNullSafe(seen[key]), "left_anti")


def incremental_features(events: DataFrame, config: FeatureConfig, target: str, order: str | None = "seq") -> None:
    """Compute and append the features of new sessions."""
    append_unseen(feature_frame(pending(events, target), config, order), target)
