"""Quality rules, and a filter by the likelihood ratio of hashed n-grams between trusted texts and the corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.llm.frames import batch, in_batches, keyed, packed
from strideframe.llm.text import SPACE, Words, flat, mix, pieces, runs, span_hashes

#: Hash buckets of the two multinomials.
BUCKETS = 1 << 16
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_SIGN = np.zeros(256, bool)
_SIGN[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True


def _sums(mask: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(mask)])


def _said_before(of: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which entries have an equal one before them in the same text, and which have one anywhere."""
    order = np.lexsort((np.arange(len(of)), hashes, of))
    same = (of[order][1:] == of[order][:-1]) & (hashes[order][1:] == hashes[order][:-1])
    before, any_ = np.zeros(len(of), bool), np.zeros(len(of), bool)
    before[order[1:][same]] = True
    any_[order[1:][same]] = any_[order[:-1][same]] = True
    return before, any_


def rule_counts(column: pa.Array, w: Words, window: int = 5) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    data, offsets = flat(column)
    chars, symbols = _sums((data & 0xC0) != 0x80), _sums(_SYMBOL[data])
    of, hashes = w.of(), w.hashes()
    own = chars[w.end] - chars[w.start]
    # Lines: between line feeds and the borders of texts.
    feed = np.flatnonzero(data == 0x0A)
    start = np.unique(np.concatenate([offsets[:-1], feed + 1]))
    line_of = np.searchsorted(offsets[1:], start, "right")
    good = line_of < len(column)
    start, line_of = start[good], line_of[good]
    next_feed = np.append(feed, len(data))[np.searchsorted(feed, start)]
    end = np.minimum(next_feed, offsets[line_of + 1])
    worded = np.searchsorted(w.start, end) > np.searchsorted(w.start, start)
    start, end, line_of = start[worded], end[worded], line_of[worded]
    line = span_hashes(data, start, end)
    dup, _ = _said_before(line_of, line)
    grams = runs(hashes, window)
    at = np.flatnonzero(of[: len(grams)] == of[window - 1 :]) if len(grams) else np.zeros(0, np.int64)
    _, again = _said_before(of[at], grams[at])
    step = np.zeros(len(of) + 1, np.int64)
    np.add.at(step, at[again], 1)
    np.add.at(step, at[again] + window, -1)
    covered = np.cumsum(step[:-1]) > 0
    n, words = len(column), w.first
    total = lambda x: np.diff(_sums(x)[words])
    return {"n_words": w.counts, "word_chars": total(own), "n_symbols": np.diff(symbols[offsets]), "n_dup_lines": np.bincount(line_of[dup], minlength=n), "n_repeat_words": total(covered)}


def ngram_buckets(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the 1- and 2-grams of tokens, and the text of each. Tokens: the runs of signs and of other characters of words."""
    sign = _SIGN[w.data]
    turn = np.zeros(len(sign) + 1, bool)
    turn[1:-1] = sign[1:] != sign[:-1]
    inside = np.zeros(len(sign) + 1, np.int64)
    np.add.at(inside, w.start, 1)
    np.add.at(inside, w.end, -1)
    turn &= np.cumsum(inside) > 0
    turn[w.start] = True
    start = np.flatnonzero(turn)
    word = np.searchsorted(w.start, start, "right") - 1
    end = np.minimum(np.append(start[1:], len(sign)), w.end[word])
    token, of = span_hashes(w.data, start, end), w.of()[word]
    pair = runs(token, 2)
    good = of[: len(pair)] == of[1:] if len(pair) else np.zeros(0, bool)
    return (np.concatenate([token, mix(pair[good])]) & np.uint64(BUCKETS - 1)).astype(np.int64), np.concatenate([of, of[:-1][good] if len(pair) else of[:0]])


def ratios(docs: DataFrame, labels: DataFrame, label: str) -> np.ndarray:
    """log(p_target / p_corpus) of each bucket; the corpus is all documents, the target all those with an id of label 1.

    Both have one count for each bucket added. Without target rows all are 0.
    """
    trusted = labels.where(F.col(label) == 1).select(F.col("doc_id").cast("long").alias("id")).where("id is not null").distinct()
    # By the same plan whatever the number of ids; texts move once, compressed.
    marked = packed(docs).join(trusted.hint("shuffle_hash"), F.col("doc_id") == F.col("id"), "left").select("zip", F.col("id").isNotNull().alias("mine"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        corpus, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for b in pieces(batches):
            bucket, of = ngram_buckets(Words(b.column("text"), SPACE))
            corpus += np.bincount(bucket, minlength=BUCKETS)
            mine = b.column("mine").to_numpy(zero_copy_only=False)
            if mine.any():
                target += np.bincount(bucket[mine[of]], minlength=BUCKETS)
        at = np.flatnonzero(corpus)
        yield batch(bucket=pa.array(at, pa.int64()), corpus=corpus[at], target=target[at])

    sums = in_batches(marked, count, "bucket long, corpus long, target long").groupBy("bucket").agg(F.sum("corpus").alias("corpus"), F.sum("target").alias("target"))
    corpus, target = np.ones(BUCKETS), np.ones(BUCKETS)
    for r in sums.collect():  # BUCKETS rows
        corpus[r.bucket] += r.corpus
        target[r.bucket] += r.target
    if target.sum() == BUCKETS:
        return np.zeros(BUCKETS)
    return np.log(target / target.sum()) - np.log(corpus / corpus.sum())


def judge(docs: DataFrame, labels: DataFrame, label: str = "quality", least: float = -0.25, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, h, the rule counts, base_failed, ratio and kept of every row.

    `ratio` is the sum of the n-grams' log ratios over their number, 0 without any. A row is kept unless
    base_failed or its ratio is under `least`. Null and empty texts have no words, and so fail.
    A text of any length is taken whole, in a batch of its own in one task; an empty table gives no rows; further columns, whatever their
    names, are left out.
    """
    rows = keyed(docs, id_col, text_col)
    held = docs.sparkSession.sparkContext.broadcast(ratios(rows, labels, label))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            w = Words(b.column("text"), SPACE)
            bucket, of = ngram_buckets(w)
            n = np.bincount(of, minlength=b.num_rows)
            ratio = np.bincount(of, held.value[bucket], b.num_rows) / np.maximum(n, 1)
            counts = {k: pa.array(v.astype(np.int64)) for k, v in rule_counts(b.column("text"), w).items()}
            yield batch(doc_id=b.column("doc_id"), h=b.column("h"), **counts, ratio=ratio)

    counted = in_batches(rows, apply, "doc_id long, h long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, ratio double")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return counted.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("ratio") >= least))
