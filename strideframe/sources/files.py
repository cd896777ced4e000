"""Sensor logs and session documents."""

from __future__ import annotations

import csv
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from strideframe.schema import RAGGED_LOG, ROW_LOG_COLUMNS, SESSION_DOCUMENT, SIDECAR, SIDECAR_COLUMNS

SIDECAR_SUFFIX = ".metadata.json"


def _reader(spark: SparkSession, globs: Sequence[str]):
    """Recursive file scan over several name patterns; a file matching two of them is read once."""
    pattern = globs[0] if len(globs) == 1 else "{" + ",".join(globs) + "}"
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern)


def read_ragged_logs(spark: SparkSession, path: str, globs: Sequence[str] = ("*.[cC][sS][vV]",)) -> DataFrame:
    """Headerless logs of five text fields: short rows are padded with NULL, long rows cut."""
    frame = _reader(spark, globs).schema(RAGGED_LOG).option("mode", "PERMISSIVE").csv(path)
    return frame.select("*", F.col("_metadata.file_path").alias("file_path"))


def read_row_logs(spark: SparkSession, path: str, globs: Sequence[str] = ("*.[cC][sS][vV]",)) -> DataFrame:
    """Logs with a header row, projected by name to the needed columns.

    Columns may come in another order in each file: files are read in groups of one header. A file without a needed
    column raises before any row is read. The driver sees the distinct headers and, as for any scan, the file names.
    """
    lines = _reader(spark, globs).text(path).select(
        "value", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("_start"))
    headers = lines.where("_start = 0").groupBy("file_path").agg(F.first("value").alias("header")).groupBy("header").agg(
        F.collect_list("file_path").alias("paths"))
    frame = None
    for row in headers.orderBy("header").collect():
        names = [n.strip() for n in next(csv.reader([row["header"].removeprefix("\ufeff")]))]
        missing = sorted(set(ROW_LOG_COLUMNS) - set(names))
        if missing:
            raise ValueError(f"log {min(row['paths'])} is missing columns: {', '.join(missing)}")
        schema = StructType([StructField(n if names.index(n) == i else f"{n}#{i}", StringType()) for i, n in enumerate(names)])
        part = spark.read.schema(schema).option("header", True).csv(row["paths"]).select(*ROW_LOG_COLUMNS)
        frame = part if frame is None else frame.unionByName(part)
    if frame is None:
        raise ValueError(f"no logs below {path}")
    return frame


def _not_sidecar() -> Column:
    name = F.lower(F.col("_metadata.file_name"))
    return ~name.endswith(SIDECAR_SUFFIX) & ~name.startswith(".")


def read_documents(spark: SparkSession, path: str, globs: Sequence[str] = ("*.json", "*.json.gz"),
                   multi_line: bool = True) -> DataFrame:
    """Session documents, one per file (or per line), plain or gzipped; sidecars are skipped."""
    frame = _reader(spark, globs).schema(SESSION_DOCUMENT).option("multiLine", multi_line).json(path)
    return frame.select("*", F.col("_metadata.file_path").alias("file_path"), _not_sidecar().alias("_keep")).where(
        "_keep").drop("_keep")


def read_sidecars(spark: SparkSession, path: str) -> DataFrame:
    frame = _reader(spark, ("*" + SIDECAR_SUFFIX,)).schema(SIDECAR).option("multiLine", True).json(path)
    return frame.select("*", F.col("_metadata.file_path").alias("file_path"))


def sidecar_join(documents: DataFrame, sidecars: DataFrame, columns: Sequence[str] = SIDECAR_COLUMNS) -> DataFrame:
    """Attach the sidecar struct `side`: that of the full file name, else of the name less its last suffix.

    Which sidecar belongs to which file is found on names alone, so the documents move once.
    """
    described = sidecars.select(
        F.regexp_replace("file_path", "\\.metadata\\.json$", "").alias("_for"), F.struct(*columns).alias("_side"))
    names = documents.select("file_path", F.regexp_replace("file_path", "\\.[^./]*$", "").alias("_stem")).distinct()
    wanted = names.select("file_path", F.inline(F.array(
        F.struct(F.lit(1).alias("_rank"), F.col("file_path").alias("_for")),
        F.struct(F.lit(2).alias("_rank"), F.col("_stem").alias("_for")))))
    sides = wanted.join(described, "_for").groupBy("file_path").agg(F.min_by("_side", "_rank").alias("side"))
    return documents.join(sides, "file_path", "left")


def explode_samples(documents: DataFrame) -> DataFrame:
    """One row per sample; documents without samples yield nothing."""
    return documents.select("file_path", "session_id", F.explode("samples").alias("s")).select(
        "file_path", "session_id", "s.*")
