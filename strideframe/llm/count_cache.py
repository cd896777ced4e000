"""Token counts through a cache of counts by content digest and tokenizer version."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.llm.frames import batch, in_batches, keyed
from strideframe.llm.text import pieces
from strideframe.llm.tokens import codec

CACHE = "version string, digest binary, n_tokens long"


def version_of(tokenizer: str) -> str:
    """Digest of the tokenizer's file and of the options that ids depend on."""
    with open(tokenizer, "rb") as f:
        return hashlib.sha256(f.read() + b"|add_special_tokens=False|truncation=None|padding=None").hexdigest()


def token_counts(docs: DataFrame, tokenizer: str, cache: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every row.

    `cache` is a folder of counts in Parquet, made when missing and appended to: only texts whose digest has no
    count for this version are encoded, each distinct text once. The content is normalised to its UTF-8 bytes,
    null to the empty text; anything coarser could change a count. Rows keep their number, repeated ones too.
    Counts that two runs have both appended are equal and read once.
    A text of any length is taken whole, in a batch of its own in one task; an empty table gives no rows; further columns, whatever their
    names, are left out.
    """
    spark, version = docs.sparkSession, version_of(tokenizer)
    rows = keyed(docs, id_col, text_col).withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{cache}/version={version}")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        spark.createDataFrame([], "digest binary, n_tokens long").write.mode("append").parquet(str(folder))

    def stored() -> DataFrame:
        return spark.read.schema("digest binary, n_tokens long").parquet(str(folder)).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))

    # The row that encodes a digest: the smallest key. The text moves once, to meet the digests that miss.
    owner = F.min(F.struct("doc_id", "h")).alias("owner")
    misses = rows.groupBy("digest").agg(owner).join(stored(), "digest", "left_anti").select(F.col("owner.doc_id").alias("m_id"), F.col("owner.h").alias("m_h"), F.col("digest").alias("m_digest"))
    todo = rows.join(misses.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("h") == F.col("m_h")) & (F.col("digest") == F.col("m_digest"))).select("digest", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer)
        for b in pieces(batches, most=2 << 20):
            yield batch(digest=b.column("digest"), n_tokens=pa.array(c.counts(b.column("text")), pa.int64()))

    in_batches(todo, count, "digest binary, n_tokens long").dropDuplicates(["digest"]).write.mode("append").parquet(str(folder))
    sized = rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest")
    return sized.join(stored(), "digest", "left").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
