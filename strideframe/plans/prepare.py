"""Raw logs to events to features, each session once."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from strideframe.config import FeatureConfig
from strideframe.functions.digests import membership_digest
from strideframe.operators.normalize import event_layout
from strideframe.operators.windows import duration_filter
from strideframe.sinks import append_unseen, atomic_write, content_keyed_write, read_appended
from strideframe.sources.registry import SourceConfig, read_source
from strideframe.streaming.incremental import incremental_features


def ingest_source(spark: SparkSession, name: str, config: SourceConfig, labels: Mapping[str, int], target: str) -> DataFrame:
    """A training source as one complete event dataset; a second call reads what is there."""
    atomic_write(event_layout(read_source(spark, name, config, labels)), target)
    return spark.read.parquet(target)


def ingest_sessions(spark: SparkSession, name: str, config: SourceConfig, labels: Mapping[str, int], target: str,
                    minimum_seconds: float = 0.0, maximum_seconds: float | None = None,
                    members: DataFrame | None = None) -> DataFrame:
    """Append the sessions of a growing source that are new, long enough and, if given, members of a snapshot."""
    events = duration_filter(read_source(spark, name, config, labels), minimum_seconds, maximum_seconds)
    if members is not None:
        events = events.join(members.select("session_id").distinct(), "session_id", "left_semi")
    append_unseen(event_layout(events), target)
    return read_appended(spark, target)


def missing_members(events: DataFrame, members: DataFrame) -> DataFrame:
    """Sessions a snapshot names that were not ingested."""
    return members.select("session_id").distinct().join(events.select("session_id"), "session_id", "left_anti")


def build_features(events: DataFrame, config: FeatureConfig, target: str, order: str | None = None) -> DataFrame:
    """Features of sessions not featured yet, appended."""
    incremental_features(events, config, target, order)
    return read_appended(events.sparkSession, target)


def keyed_features(features: DataFrame, events: DataFrame, rule: str, columns: Sequence[str], root: str) -> DataFrame:
    """Features stored under a key of their rule and of the events; unchanged input is not rebuilt."""
    return features.sparkSession.read.parquet(content_keyed_write(features, events, rule, columns, root))


def snapshot_digest(members: DataFrame) -> DataFrame:
    """Digest of a snapshot's session ids, as manifests state it."""
    return members.agg(membership_digest(members["session_id"]).alias("digest"))
