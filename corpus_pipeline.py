"""The corpus pipeline: each stage works on all that the stage before it kept.

Every stage takes and returns the columns of `documents` (any further columns pass through); the last one returns
token ids. Null and empty texts pass all stages; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideframe.llm import chunk_bpe, odd_sketch, phrase_index, suffix_dedup, toxicity
from strideframe.llm.frames import keep_rows, of_row, table
from strideframe.session import cut_lineage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose score by the nearest labelled examples is under 0.7."""
    judged = toxicity.score(docs, table(spark, sf_dir, "labels"))
    return keep_rows(docs, judged.where("predicted = 1"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least document (by id and hash of the text) of each group of near copies (five-word shingles, 0.8), once; texts without words stay."""
    found = cut_lineage(odd_sketch.near_duplicates(docs, shingle=5))
    # Plain keys, so that equal rows are reduced and joined by one exchange of the texts.
    key = lambda h: {"_near_id": F.coalesce("doc_id", F.lit(0)).cast("long"), "_near_none": F.col("doc_id").isNull(), "_near_h": h}
    least = found.where("kept and h = component_h and n_shingles > 0").select(*[c.alias(k) for k, c in key(F.col("h")).items()]).distinct()
    text = F.col("text").cast("string")
    worded = F.coalesce(text, F.lit("")).rlike("[^ \\t-\\r]")
    rows = docs.where(worded).withColumns(key(F.xxhash64(text))).dropDuplicates(least.columns)
    kept = rows.join(least.hint("shuffle_hash"), least.columns, "left_semi")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns]).union(docs.where(~worded))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of passages that stand earlier too, the other words joined by a blank; untouched texts stay as they are."""
    cut = suffix_dedup.remove_repeats(docs, with_text=True).where("n_removed > 0").dropDuplicates(["doc_id", "h"])
    joined = docs.alias("a").join(cut.alias("b"), of_row(), "left")
    new = {"text": F.coalesce("b.kept", "a.text")}
    if "n_chars" in docs.columns:
        own = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(F.col("b.kept").isNull(), F.col("a.n_chars")).otherwise(F.length("b.kept").cast(own))
    return joined.select(*[new.get(c, F.col(f"a.`{c}`")).alias(c) for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without any window of a benchmark item."""
    return keep_rows(docs, phrase_index.find_phrases(docs, table(spark, sf_dir, "benchmark")).where("contaminated"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, with digests of the ids and of the text decoded from them."""
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return chunk_bpe.decode(chunk_bpe.encode(docs, tokenizer), tokenizer, digests=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("repeated_passages", cut_repeats),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
