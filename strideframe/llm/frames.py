"""What the text operators share: their input columns, and batch functions over them.

A document is known by its id and a hash of its text, so repeated ids neither multiply rows in a join nor mix
their texts; fully equal rows are one document and share its result. Ids may be null: null is one more id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ("doc_id", "h")
#: The place of a document without an id: before all others.
NO_ID = -(1 << 63)
ROWS = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, h, text (null: empty) of each row; other columns are left out."""
    text = F.col(f"`{text_col}`").cast("string")
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(text).alias("h"), F.coalesce(text, F.lit("")).alias("text"))


def beside(docs: DataFrame, extra: DataFrame, how: str = "left") -> DataFrame:
    """Columns of `docs`, and those of `extra` that are no key; `extra` has one row for each key at most."""
    extra = extra.select(*[F.col(c).alias(f"_{c}" if c in KEY else c) for c in extra.columns])
    joined = docs.join(extra, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("h") == F.col("_h")), how)
    return joined.drop("_doc_id", "_h")


def keep_rows(docs: DataFrame, dropped: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of the rows of `docs` whose key is not in `dropped`, by the same plan whatever the size of `dropped`."""
    return docs.alias("a").join(dropped.select("doc_id", "h").hint("shuffle_hash").alias("b"), of_row(id_col, text_col), "left_anti")


def of_row(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """Equality of a row of documents, aliased a, and a key, aliased b."""
    return F.expr(f"a.`{id_col}` <=> b.doc_id and xxhash64(cast(a.`{text_col}` as string)) = b.h")


def in_batches(df: DataFrame, do: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """`mapInArrow`, with at most ROWS rows in an Arrow batch, because texts may be long: the session's setting is lowered to it."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) not in range(1, ROWS + 1):
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS)
    return df.mapInArrow(do, schema)


def packed(rows: DataFrame) -> DataFrame:
    """`keyed` rows with their text compressed, for a shuffle; `pieces` unpacks it."""
    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        close = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            yield batch(doc_id=b.column("doc_id"), h=b.column("h"), zip=pa.array([close(x) for x in b.column("text").cast(pa.binary()).to_pylist()], pa.binary()))

    return in_batches(rows, shrink, "doc_id long, h long, zip binary")


def batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in columns.items()})


def strings_as_binary(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, most: int = 1_000_000) -> Iterator[pa.Table]:
    """Whole groups of a key, several at once up to about `most` bytes; the rows come ordered by it."""
    held, size = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        now = b.column(key).to_numpy()
        cut = np.flatnonzero(np.diff(now) != 0) + 1
        if held and held[-1].column(key)[-1].as_py() != now[0]:
            cut = np.append([0], cut)
        at, per_row = 0, b.nbytes / b.num_rows
        for c in cut.tolist():
            if size + (c - at) * per_row >= most or (c == 0 and size >= most):
                if c > at:
                    held.append(b.slice(at, c - at))
                yield pa.Table.from_batches(held)
                held, size, at = [], 0, c
        if at < b.num_rows:
            held.append(b.slice(at))
            size += (b.num_rows - at) * per_row
    if held:
        yield pa.Table.from_batches(held)
