"""Writers: all-or-nothing, content-keyed, partitioned and delimited."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from strideframe.functions.digests import content_digest
from strideframe.session import partitioned

#: Column and folders of the pages that are appended together.
PAGE = "_page"


def _file_system(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def is_complete(spark: SparkSession, path: str) -> bool:
    """A committed dataset carries the job's success marker."""
    system, _ = _file_system(spark, path)
    return system.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS"))


def exists(spark: SparkSession, path: str) -> bool:
    system, hadoop = _file_system(spark, path)
    return system.exists(hadoop)


def atomic_write(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> int | None:
    """Write once: a complete dataset is left alone (None); leftovers of a failed write are replaced.

    Spark's committer publishes task output on job success only. The row count is observed during the
    write and kept with the data under `_manifest`, which readers skip.
    """
    spark = df.sparkSession
    if is_complete(spark, path):
        if not is_complete(spark, f"{path}/_manifest"):  # the writer died between the two
            found = spark.read.parquet(path)
            _write_manifest(spark, path, found.count(), found.schema.json())
        return None
    seen = Observation()
    partitioned(df.observe(seen, F.count(F.lit(1)).alias("rows")), partition_by).mode("overwrite").parquet(path)
    rows = int(seen.get["rows"])
    _write_manifest(spark, path, rows, df.schema.json())
    return rows


def _write_manifest(spark: SparkSession, path: str, rows: int, schema: str) -> None:
    spark.range(1).select(F.lit(rows).cast("bigint").alias("rows"), F.lit(schema).alias("schema")).write.mode(
        "overwrite").json(f"{path}/_manifest")


def content_key(df: DataFrame, rule: str, columns: Sequence[str]) -> str:
    """Key of a rule applied to a table: changes with the rule, any value, type or duplicate."""
    digest = content_digest(df, list(columns)).first()["digest"]
    return hashlib.sha256(f"{rule}|{digest}".encode()).hexdigest()


def content_keyed_write(result: DataFrame, source: DataFrame, rule: str, columns: Sequence[str], root: str) -> str:
    """Materialize `result` under the key of (rule, source); unchanged input is not rebuilt."""
    path = f"{root.rstrip('/')}/{content_key(source, rule, columns)}"
    atomic_write(result, path)
    return path


def _published(spark: SparkSession, path: str) -> list[str]:
    system, folder = _file_system(spark, f"{path}/_published")
    return sorted(f.getPath().getName() for f in system.listStatus(folder)) if system.exists(folder) else []


def _batches(spark: SparkSession, path: str, what: str) -> DataFrame | None:
    """Rows or keys of the published batches. A batch that was written with others is a folder `PAGE=n` of theirs."""
    batches = _published(spark, path)
    return spark.read.parquet(*[f"{path}/{what}-{b.replace('.', f'/{PAGE}=')}" for b in batches]) if batches else None


def read_appended(spark: SparkSession, path: str) -> DataFrame | None:
    """Rows of all published batches of an appended table; None before the first."""
    return _batches(spark, path, "rows")


def recorded_keys(spark: SparkSession, path: str) -> DataFrame | None:
    """Keys of the published batches, one row each."""
    return _batches(spark, path, "keys")


def append_unseen(new: DataFrame, path: str, key: str = "session_id", pages: int | None = None) -> None:
    """Append rows of keys the target does not hold yet, all or none of them.

    A batch and the list of its keys are written to folders of their own and then published by one marker file;
    readers (`read_appended`) see published batches only, so what a crash leaves behind is never read. Rows of a
    recorded key that arrive later are ignored.

    With `pages`, the column PAGE (0..pages-1) deals the rows out to as many batches, all rows of a key to one. They are written
    together, and then published one after the other, page 0 first, so a crash leaves whole pages, all those before the first lost one.
    """
    spark = new.sparkSession
    seen = recorded_keys(spark, path)
    if seen is not None:
        new = new.join(seen, new[key].eqNullSafe(seen[key]), "left_anti")
    by = [] if pages is None else [PAGE]
    batch = uuid.uuid4().hex
    partitioned(new, by).parquet(f"{path}/rows-{batch}")
    keys = spark.read.schema(new.schema).parquet(f"{path}/rows-{batch}").select(key, *by).distinct()
    partitioned(keys, by).parquet(f"{path}/keys-{batch}")
    for name in [batch] if pages is None else [f"{batch}.{k}" for k in range(pages) if exists(spark, f"{path}/rows-{batch}/{PAGE}={k}")]:
        system, marker = _file_system(spark, f"{path}/_published/{name}")
        system.create(marker, False).close()


def write_delimited(df: DataFrame, path: str) -> None:
    """Delimited text with a header, also when there are no rows."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_predictions(df: DataFrame, path: str, by: Sequence[str] = ("run_name", "held_out_participant_id")) -> None:
    """Fold predictions, one folder per run and fold; pooled reads are partition scans."""
    partitioned(df, by).mode("overwrite").parquet(path)
