"""Named event sources; a new one is a function returning event rows."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from strideframe.operators.normalize import normalize_documents, normalize_path_logs, normalize_row_logs
from strideframe.sources.files import read_documents, read_ragged_logs, read_row_logs, read_sidecars, sidecar_join


@dataclass(frozen=True)
class SourceConfig:
    path: str
    globs: Sequence[str] = ()


Adapter = Callable[[SparkSession, SourceConfig, Mapping[str, int]], DataFrame]
_ADAPTERS: dict[str, Adapter] = {}


def register_source(name: str) -> Callable[[Adapter], Adapter]:
    def add(adapter: Adapter) -> Adapter:
        if name in _ADAPTERS:
            raise ValueError(f"source {name!r} is already registered")
        _ADAPTERS[name] = adapter
        return adapter
    return add


def read_source(spark: SparkSession, name: str, config: SourceConfig, labels: Mapping[str, int]) -> DataFrame:
    if name not in _ADAPTERS:
        raise ValueError(f"unknown source {name!r}; known: {', '.join(sorted(_ADAPTERS))}")
    return _ADAPTERS[name](spark, config, labels)


@register_source("path_logs")
def path_logs(spark: SparkSession, config: SourceConfig, labels: Mapping[str, int]) -> DataFrame:
    return normalize_path_logs(read_ragged_logs(spark, config.path, *([config.globs] if config.globs else [])), labels)


@register_source("row_logs")
def row_logs(spark: SparkSession, config: SourceConfig, labels: Mapping[str, int]) -> DataFrame:
    return normalize_row_logs(read_row_logs(spark, config.path, *([config.globs] if config.globs else [])), labels)


@register_source("session_documents")
def session_documents(spark: SparkSession, config: SourceConfig, labels: Mapping[str, int]) -> DataFrame:
    documents = read_documents(spark, config.path, *([config.globs] if config.globs else []))
    return normalize_documents(sidecar_join(documents, read_sidecars(spark, config.path)), labels)
