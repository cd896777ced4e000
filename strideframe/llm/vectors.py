"""Term vectors of texts, labelled examples, and document frequencies over a whole table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideframe.llm.frames import batch, in_batches
from strideframe.llm.text import NOT_ALNUM, SPACE, Words, mix, pieces, span_hashes

#: Terms of a batch of texts: the hash of each, and where each text's terms begin.
Terms = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[0x30:0x3A] = 0x30
_SHAPE[0x41:0x5B] = 0x58
_SHAPE[0x61:0x7B] = 0x78
_SHAPE[0x80:0x9F] = 0x58  # second bytes of Latin-1 capitals
_SHAPE[0x9F:] = 0x78


def word_terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case words."""
    w = Words(column, NOT_ALNUM, lower=True)
    return w.hashes(), w.first


def shape_terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words, their shapes (capitals, letters, digits and signs, each run once), and a mark for a word said twice."""
    w = Words(column, SPACE)
    own = w.hashes()
    kind = _SHAPE[w.data]
    lead = w.data >= 0xC0  # the byte after it says which letter
    inside = np.zeros(len(kind) + 1, np.int64)
    np.add.at(inside, w.start, 1)
    np.add.at(inside, w.end, -1)
    keep = (np.cumsum(inside[:-1]) > 0) & ~lead
    before = np.concatenate([[0], kind[:-1]])
    before[1:][lead[:-1]] = np.concatenate([[0], kind[:-2]])[lead[:-1]] if len(kind) > 1 else 0
    first = np.zeros(len(kind) + 1, bool)
    first[w.start] = True
    after_lead = np.concatenate([[False], lead[:-1]])
    first[1:-1] |= first[:-2] & after_lead[1:] if len(kind) > 1 else False
    keep &= (kind != before) | first[:-1]
    at = np.concatenate([[0], np.cumsum(keep)])
    shapes = mix(span_hashes(kind[keep], at[w.start], at[w.end]) ^ np.uint64(1)) if len(w.start) else own
    twice = np.flatnonzero(own[1:] == own[:-1]) + 1
    twice = twice[~np.isin(twice, w.first)]
    values = np.concatenate([own, shapes, np.full(len(twice), mix(np.array([7], np.uint64))[0])])
    of = np.concatenate([np.tile(w.of(), 2), np.searchsorted(w.first, twice, "right") - 1])
    order = np.argsort(of, kind="stable")
    return values[order], np.searchsorted(of[order], np.arange(len(column) + 1))


def counted(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, term and count of each distinct pair, ordered by text and term."""
    of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((hashes, of))
    of, hashes = of[order], hashes[order]
    head = np.flatnonzero((np.diff(of, prepend=-1) != 0) | np.concatenate([[True], hashes[1:] != hashes[:-1]])[: len(of)])
    return of[head], hashes[head], np.diff(np.append(head, len(of)))


def in_vocabulary(vocabulary: np.ndarray, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for the terms of a sorted vocabulary, which come as indexes."""
    bits = np.zeros(1 << 16, bool)
    bits[(vocabulary & np.uint64(0xFFFF)).astype(np.int64)] = True
    at = np.flatnonzero(bits[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
    place = np.minimum(np.searchsorted(vocabulary, hashes[at]), len(vocabulary) - 1)
    good = vocabulary[place] == hashes[at] if len(vocabulary) else np.zeros(len(at), bool)
    at, place = at[good], place[good]
    of = np.searchsorted(first, at, "right") - 1
    pair, n = np.unique(of * len(vocabulary) + place, return_counts=True)
    return pair // max(1, len(vocabulary)), pair % max(1, len(vocabulary)), n


def examples(docs: DataFrame, labels: DataFrame, label: str, learn: Column, most: int, terms: Terms) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray], np.ndarray, float]:
    """Up to `most` labelled documents of each class, chosen by a hash of id and text among those that `docs` holds, in order of the id.

    Returns ids, term hashes, counts, labels (0 or 1), and the share of label 1 among all rows to learn from. Rows
    without id or label are no examples; of a repeated id the larger label holds; a text is taken once.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("int").alias("y")).where(F.col("id").isNotNull() & F.col("y").isin(0, 1)).groupBy("id").agg(F.max("y").alias("y")).where(learn)
    sizes = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    # Keys only: no text moves before its document is chosen.
    held = docs.select("doc_id", "h").join(known, docs["doc_id"] == known["id"]).groupBy("id", "h").agg(F.max("y").alias("y"))
    order = [F.xxhash64(F.lit(17), "id", "h"), "id", "h"]
    chosen = held.where("y = 0").orderBy(*order).limit(most).union(held.where("y = 1").orderBy(*order).limit(most)).select("id", F.col("h").alias("_h"), "y")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            of, term, n = counted(*terms(b.column("text")))
            ends = np.searchsorted(of, np.arange(b.num_rows + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (term.view(np.int64), n.astype(np.int32))]
            yield batch(id=b.column("id"), h=b.column("h"), y=b.column("y"), terms=lists[0], n=lists[1])

    rows = docs.join(F.broadcast(chosen), (docs["doc_id"] == chosen["id"]) & (docs["h"] == chosen["_h"])).select("id", "h", "y", "text").dropDuplicates(["id", "h"])  # 2 * most rows
    got = in_batches(rows, count, "id long, h long, y int, terms array<long>, n array<int>").toArrow().sort_by([("id", "ascending"), ("h", "ascending")])
    ids, ys = got["id"].to_pylist(), got["y"].to_pylist()
    hashes = [x.values.to_numpy().view(np.uint64) for x in got["terms"]]
    counts = [x.values.to_numpy() for x in got["n"]]
    return np.array(ids, np.int64), hashes, counts, np.array(ys, np.int64), sizes.get(1, 0) / max(1, sum(sizes.values()))


def document_frequency(docs: DataFrame, vocabulary: np.ndarray, terms: Terms) -> tuple[int, np.ndarray]:
    """Number of documents, and in how many each term of the vocabulary stands, over the whole table."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(len(held.value), np.int64), 0
        for b in pieces(batches):
            n += b.num_rows
            df += np.bincount(in_vocabulary(held.value, *terms(b.column("text")))[1], minlength=len(df))
        at = np.flatnonzero(df)
        yield batch(term=pa.array(np.append(at, -1), pa.int64()), n=pa.array(np.append(df[at], n), pa.int64()))

    df = np.zeros(len(vocabulary), np.int64)
    got = in_batches(docs.select("text"), count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # a row for each term
    term, sums = got["term"].to_numpy(), got["n"].to_numpy()
    df[term[term >= 0]] = sums[term >= 0]
    return int(sums[term < 0].sum()), df


def fold(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`; null ids are in fold 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(parts)), F.lit(0))
