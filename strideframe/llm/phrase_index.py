"""Benchmark decontamination with a positional inverted index of the training documents.

The index holds postings (term, document, position) of the benchmark's terms, and of these only the ones that an
occurrence could use: those in an unbroken run of benchmark terms as long as a window. For each window the postings
of its rarest term propose starts (position less offset); at these the other terms' positions, rarest first, are
intersected. Terms are matched by a 64-bit hash of their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.llm.frames import batch, beside, in_batches, keyed
from strideframe.llm.text import NOT_ALNUM, Words, pieces, runs, span_cover
from strideframe.session import cut_lineage

#: Words of benchmark items that one pass over the documents looks for; more items take more passes.
PASS_WORDS = 2_000_000


@dataclass
class Phrases:
    """Distinct windows of some items: a row of `terms` for each (-1 beyond its length), and the items that have it."""

    vocabulary: np.ndarray  # sorted hashes; a term is an index of it
    terms: np.ndarray
    size: np.ndarray
    items: list[list[str]]

    @classmethod
    def of(cls, ids: list[str], texts: list[str], n: int) -> Phrases:
        w = Words(pa.array(texts, pa.string()), NOT_ALNUM, lower=True)
        vocabulary, term = np.unique(w.hashes(), return_inverse=True)
        found: dict[tuple[int, ...], set[str]] = {}
        for item, a, b in zip(ids, w.first[:-1].tolist(), w.first[1:].tolist()):
            own = term[a:b].tolist()
            for i in range(max(1, len(own) - n + 1) if own else 0):
                found.setdefault(tuple(own[i : i + n]), set()).add(item)
        terms = np.full((len(found), n), -1, np.int32)
        for k, window in enumerate(found):
            terms[k, : len(window)] = window
        return cls(vocabulary, terms, (terms >= 0).sum(1).astype(np.int32), [sorted(x) for x in found.values()])

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """Term of each hash, or -1."""
        out = np.full(len(hashes), -1, np.int32)
        if len(self.vocabulary):
            maybe = np.zeros(1 << 16, bool)
            maybe[(self.vocabulary & np.uint64(0xFFFF)).astype(np.int64)] = True
            at = np.flatnonzero(maybe[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
            place = np.minimum(np.searchsorted(self.vocabulary, hashes[at]), len(self.vocabulary) - 1)
            out[at] = np.where(self.vocabulary[place] == hashes[at], place, -1)
        return out


def _usable(term: np.ndarray, of: np.ndarray, phrases: Phrases, n: int, slop: int) -> np.ndarray:
    """Which words an occurrence of a window could use."""
    known = term >= 0
    if slop or not len(term):
        return known
    run = np.where(known, of, -1)
    edge = np.flatnonzero(np.diff(run, prepend=run[0] - 1) != 0)
    size = np.diff(edge, append=len(term))
    length = np.repeat(size, size)
    short = np.zeros(len(phrases.vocabulary) + 1, bool)  # the last is for no term
    small = phrases.terms[phrases.size < n]
    short[small[small >= 0]] = True
    return known & ((length >= n) | short[term])


def _matches(docs: DataFrame, phrases: Phrases, n: int, slop: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, h, n_words) of all rows; (doc_id, h, spans, items) of those with a match."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(phrases)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = held.value
        for b in pieces(batches):
            w = Words(b.column("text"), NOT_ALNUM, lower=True)
            term = p.lookup(w.hashes())
            of = w.of()
            keep = np.flatnonzero(_usable(term, of, p, n, slop))
            place = (keep - w.first[of[keep]]).astype(np.int32)
            ends = np.searchsorted(keep, w.first).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (term[keep], place)]
            yield batch(doc_id=b.column("doc_id"), h=b.column("h"), n_words=pa.array(w.counts.astype(np.int64)), terms=lists[0], places=lists[1])

    stored = cut_lineage(in_batches(docs, index, "doc_id long, h long, n_words long, terms array<int>, places array<int>"))
    with_any = stored.where(F.size("terms") > 0)
    postings = with_any.select("doc_id", "h", F.explode(F.arrays_zip("terms", "places")).alias("p")).select("doc_id", "h", F.col("p.terms").alias("term"), F.col("p.places").alias("place"))
    df = np.zeros(len(phrases.vocabulary), np.int64)  # a number for each benchmark term of this pass
    for term, count in postings.groupBy("term").count().collect():
        df[term] = count
    weight = np.where(phrases.terms >= 0, df[phrases.terms], np.iinfo(np.int64).max)
    order = np.argsort(weight, axis=1, kind="stable")  # each window's offsets from its rarest term on
    can = np.flatnonzero((np.where(phrases.terms >= 0, weight, 1) > 0).all(1))
    if not len(can):
        return stored.select("doc_id", "h", "n_words"), spark.createDataFrame([], "doc_id long, h long, spans array<int>, lengths array<int>, items array<string>")
    rarest = spark.createDataFrame(pa.table({"window": can.astype(np.int32), "term": phrases.terms[can, order[can, 0]], "offset": order[can, 0].astype(np.int32)}))
    proposed = postings.join(rarest, "term").select("doc_id", "h", "window", (F.col("place") - F.col("offset")).alias("start"))
    if not slop:
        proposed = proposed.where("start >= 0")
    by_doc = proposed.groupBy("doc_id", "h").agg(F.collect_list("window").alias("windows"), F.collect_list("start").alias("starts"))
    rank = spark.sparkContext.broadcast(order.astype(np.int32))

    def intersect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, ranked = held.value, rank.value
        for b in batches:
            rows: dict[str, list] = {"doc_id": [], "h": [], "spans": [], "lengths": [], "items": []}
            for i in range(b.num_rows):
                get = lambda c: b.column(c)[i].values.to_numpy(zero_copy_only=False)
                terms, places = get("terms").astype(np.int64), get("places").astype(np.int64)
                window, start = get("windows"), get("starts").astype(np.int64)
                span = int(places.max()) + 2 * n + 2 * slop + 2
                near = terms * span + places
                near = np.unique(np.concatenate([near + k for k in range(-slop, slop + 1)])) if slop else np.sort(near)
                alive = np.arange(len(window))
                for k in range(n):
                    offset = ranked[window[alive], k]
                    term = p.terms[window[alive], offset].astype(np.int64)
                    want = term * span + start[alive] + offset
                    at = np.minimum(np.searchsorted(near, want), len(near) - 1)
                    alive = alive[(term < 0) | (near[at] == want)]
                if len(alive):
                    rows["doc_id"].append(b.column("doc_id")[i].as_py())
                    rows["h"].append(b.column("h")[i].as_py())
                    rows["spans"].append(start[alive].astype(np.int32))
                    rows["lengths"].append(p.size[window[alive]])
                    rows["items"].append(sorted({x for k in set(window[alive].tolist()) for x in p.items[k]}))
            kinds = {"doc_id": pa.int64(), "h": pa.int64(), "spans": pa.list_(pa.int32()), "lengths": pa.list_(pa.int32()), "items": pa.list_(pa.string())}
            yield batch(**{k: pa.array(v, kinds[k]) for k, v in rows.items()})

    hits = in_batches(beside(with_any.select("doc_id", "h", "terms", "places"), by_doc, "inner"), intersect, "doc_id long, h long, spans array<int>, lengths array<int>, items array<string>")
    return stored.select("doc_id", "h", "n_words"), hits


def find_phrases(docs: DataFrame, benchmark: DataFrame, n: int = 10, slop: int = 0, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """doc_id, h, n_words, n_hit, n_items, items (sorted as strings), contaminated of every row.

    A window is n consecutive words of an item, or all of a shorter one. With slop 0 a window occurs where its
    words follow one another; with more, where each stands within `slop` words of its place (proximity). A
    document word inside an occurrence is hit. Null and empty texts have no words; items without words or id
    have no windows; equal items count one by one, equal rows are all returned.
    A text of any length is taken whole, in one task; an empty table gives no rows; further columns are left out.
    """
    items = benchmark.select(F.col(f"`{item_col}`").cast("string").alias("item"), F.col(f"`{text_col}`").cast("string").alias("text")).where("item is not null and text is not null")
    passes = 1 + (items.agg(F.sum(F.length("text"))).first()[0] or 0) // (2 * PASS_WORDS)
    rows, base, hits = keyed(docs, id_col, text_col), None, None
    for k in range(passes):
        part = items.where(F.pmod(F.xxhash64("item"), F.lit(passes)) == k).orderBy("item", "text").collect()
        sized, found = _matches(rows, Phrases.of([r.item for r in part], [r.text for r in part], n), n, slop)
        base, hits = sized if base is None else base, found if hits is None else hits.union(found)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, names, counts = b.column("n_words").to_pylist(), [], []
            for i, many in enumerate(b.column("found").to_pylist()):
                many = many or []
                names.append(sorted({x for m in many for x in m["items"]}))
                starts = np.array([x for m in many for x in m["spans"]], np.int64)
                ends = np.minimum(starts + np.array([x for m in many for x in m["lengths"]], np.int64) + slop, words[i])
                starts = np.maximum(starts - slop, 0)
                counts.append(int(span_cover(starts, ends - starts, words[i]).sum()) if len(starts) else 0)
            yield batch(doc_id=b.column("doc_id"), h=b.column("h"), n_words=b.column("n_words"), n_hit=pa.array(counts, pa.int64()), n_items=pa.array([len(x) for x in names], pa.int64()), items=pa.array(names, pa.list_(pa.string())), contaminated=pa.array([c > 0 for c in counts], pa.bool_()))

    by_doc = hits.groupBy("doc_id", "h").agg(F.collect_list(F.struct("spans", "lengths", "items")).alias("found"))
    return in_batches(beside(base, by_doc), total, "doc_id long, h long, n_words long, n_hit long, n_items long, items array<string>, contaminated boolean")
