"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Terms are all lower-case words of the examples; those whose frequency differs between the two classes beyond chance
weigh more. The examples stand in an inverted index cut into blocks. A block's bound is the highest score that common
words give any of its rows, and each other term's largest weight in it; blocks that can't hold one of the nearest are
passed over, and no other way of pruning is used, so neighbours are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideframe.llm.frames import batch, in_batches, keyed
from strideframe.llm.text import mix, pieces
from strideframe.llm.vectors import counted, document_frequency, examples, fold, word_terms

#: Labelled rows of each class to learn from; examples of a block; blocks that are scored first; texts scored together.
EXAMPLES, BLOCK, LEAD, TEXTS = 3000, 8, 8, 128
#: A term in at least this part (one in so many) of the examples is common.
COMMON = 12
#: How many times more frequent a term is in one class for its full extra weight; the words of a language are weaker than that.
TIMES = 4.0
#: Power by which neighbours farther off than the nearest vote less.
SHARP = 4


def weighted_terms(hashes: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of all terms of the examples, and a factor of at least 1 for each.

    The factor grows with the log-likelihood ratio of the term's frequencies in the two classes, fully where they differ by TIMES.
    """
    if not len(hashes):
        return np.zeros(0, np.uint64), np.zeros(0)
    term, at = np.unique(np.concatenate(hashes), return_inverse=True)
    at, sizes = at.astype(np.int32), [len(h) for h in hashes]
    label = np.repeat(y == 1, sizes)
    # Near copies of a text would make its rare words telling, so texts with the same least term hash count once; the
    # least count of several hashes stays.
    seen, size = np.full((2, len(term)), np.inf), np.full((2, 1), np.inf)
    for k in range(1, 5):
        least = np.array([int(mix(h ^ np.uint64(k)).min(initial=np.uint64(2**64 - 1))) for h in hashes], np.uint64)
        _, text = np.unique(least, return_inverse=True)
        for c in (0, 1):
            own = label == bool(c)
            pair = at[own] * np.int64(len(text) + 1)
            pair += np.repeat(text.astype(np.int32), sizes)[own]
            pair = np.unique(pair)
            seen[c] = np.minimum(seen[c], np.bincount(pair // (len(text) + 1), minlength=len(term)))
            size[c] = np.minimum(size[c], len(np.unique(text[y == c])))
    seen = np.minimum(seen, size)
    share = seen.sum(0) / max(1.0, size.sum())
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = [x * np.log(x / (size * s)) for x, s in ((seen, share), (size - seen, 1 - share))]
    ratio = 2 * sum(np.nan_to_num(p, nan=0.0, posinf=0.0, neginf=0.0).sum(0) for p in parts)
    times = ((seen[0] + 0.5) / (size[0] + 1)) / ((seen[1] + 0.5) / (size[1] + 1))
    return term, 1 + np.maximum(ratio, 0) * np.minimum(1, np.abs(np.log(times)) / np.log(TIMES)) ** 4


def _spread(offsets: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the ranges offsets[i] to offsets[i + 1] for i in index, and the length of each."""
    n = offsets[index + 1] - offsets[index]
    return np.arange(n.sum()) + np.repeat(offsets[index] - np.cumsum(n) + n, n), n


@dataclass
class BlockMaxIndex:
    """Unit vectors by term and block of rows, similar rows side by side.

    A term in many rows has its weights in every row (`dense`), so the common words of a batch of texts are one product.
    Entries `first[t]` to `first[t + 1]` are the blocks of any other term t: an entry has its `block`, the largest weight
    `top`, and where its postings `places`/`weights` begin (`cut`). `rows` has the row of each place.
    """

    rows: np.ndarray
    slot: np.ndarray
    dense: np.ndarray
    places: np.ndarray
    weights: np.ndarray
    first: np.ndarray
    block: np.ndarray
    top: np.ndarray
    cut: np.ndarray

    @classmethod
    def of(cls, rows: np.ndarray, terms: np.ndarray, weights: np.ndarray, n: int, n_terms: int, group: np.ndarray | None = None) -> BlockMaxIndex:
        """`group`: a number for each row; rows of a group, and in it of the same heaviest term, stand together."""
        heaviest = np.zeros(n, np.int64)
        order = np.argsort(weights, kind="stable")
        heaviest[rows[order]] = terms[order]
        by = np.lexsort((np.arange(n), heaviest, np.zeros(n) if group is None else group))
        place_of = np.empty(n, np.int64)
        place_of[by] = np.arange(n)
        size = -(-n // BLOCK) * BLOCK
        many = np.flatnonzero(np.bincount(terms, minlength=n_terms) >= max(2, n / COMMON))
        slot = np.full(n_terms, -1)
        slot[many] = np.arange(len(many))
        own = slot[terms] >= 0
        dense = np.zeros((len(many), size))
        dense[slot[terms[own]], place_of[rows[own]]] = weights[own]
        # By term, then place; small numbers, as the driver holds all of it.
        key = terms[~own] * np.int64(size) + place_of[rows[~own]]
        weights, order = weights[~own], np.argsort(key, kind="stable")
        key, weights = key[order], weights[order]
        places, terms = (key % size).astype(np.int32), (key // size).astype(np.int32)
        head = np.flatnonzero(np.diff(key // BLOCK, prepend=-1)).astype(np.int32)
        top = np.maximum.reduceat(weights, head) if len(head) else np.zeros(0)
        first = np.searchsorted(terms[head], np.arange(n_terms + 1)).astype(np.int32)
        return cls(by, slot.astype(np.int32), dense, places, weights, first, places[head] // BLOCK, top, np.append(head, len(places)).astype(np.int32))

    def nearest(self, of: np.ndarray, terms: np.ndarray, weights: np.ndarray, m: int, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each of m texts (`of`, in order) the k rows of the largest dot products above 0, ties by row number."""
        slot, blocks = self.slot[terms], self.dense.shape[1] // BLOCK
        texts = np.zeros((m, len(self.dense)))
        texts[of[slot >= 0], slot[slot >= 0]] = weights[slot >= 0]
        base = texts @ self.dense
        highest = base.reshape(m, blocks, BLOCK).max(2, initial=0)
        of, terms, weights = of[slot < 0], terms[slot < 0], weights[slot < 0]
        edge, out, self.opened = np.searchsorted(of, np.arange(m + 1)), [], 0
        for i in range(m):
            own = slice(edge[i], edge[i + 1])
            entry, n = _spread(self.first, terms[own])
            weight, block, score = np.repeat(weights[own], n), self.block[entry], base[i]
            bound = highest[i] + np.bincount(block, weight * self.top[entry], blocks)
            # The blocks of the highest bounds give a least score that no neighbour is under; then all that may reach it.
            lead = np.argpartition(-bound, min(LEAD, blocks) - 1)[:LEAD]
            wanted = np.zeros(blocks, bool)
            wanted[lead] = True
            self._add(score, wanted, entry, block, weight)
            seen = score.reshape(blocks, BLOCK)[lead].ravel()
            least = np.partition(seen, -k)[-k] if len(seen) >= k else 0.0
            more = (bound >= least - 1e-12) & (bound > 0) & ~wanted
            self._add(score, more, entry, block, weight)
            wanted |= more
            self.opened += int(wanted.sum())
            hit = (np.flatnonzero(wanted)[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            hit = hit[(score[hit] > 0) & (score[hit] >= least - 1e-12)]
            hit = hit[np.lexsort((self.rows[hit], -np.round(score[hit], 12)))[:k]]
            out.append((self.rows[hit], score[hit]))
        return out

    def _add(self, score: np.ndarray, wanted: np.ndarray, entry: np.ndarray, block: np.ndarray, weight: np.ndarray) -> None:
        """The other terms' part of the scores in some blocks."""
        good = np.flatnonzero(wanted[block])
        if len(good):
            own, n = _spread(self.cut, entry[good])
            score += np.bincount(self.places[own], np.repeat(weight[good], n) * self.weights[own], len(score))


@dataclass
class Model:
    vocabulary: np.ndarray
    idf: np.ndarray  # with the factor of the term
    other: float  # of a word of no example
    index: BlockMaxIndex
    ids: np.ndarray
    y: np.ndarray
    weight: np.ndarray  # of an example's vote: rows that it stands for
    prior: float

    def vectors(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, term and weight in the text's unit vector, ordered by text."""
        of, h, n = counted(hashes, first)
        place = np.minimum(np.searchsorted(self.vocabulary, h), max(0, len(self.vocabulary) - 1))
        good = self.vocabulary[place] == h if len(self.vocabulary) else np.zeros(len(h), bool)
        w = (1 + np.log(n)) * np.where(good, self.idf[place] if len(self.idf) else 0.0, self.other)
        w /= np.sqrt(np.bincount(of, w**2, len(first) - 1))[of]
        return of[good], place[good], w[good]

    def vote(self, rows: np.ndarray, cosine: np.ndarray, trust: float) -> float:
        """Share of label 1 among the neighbours, each by its cosine, its nearness beside the nearest and the rows it stands for, and the prior with weight `trust`."""
        w = cosine * (cosine / cosine.max(initial=1e-12)) ** SHARP * self.weight[rows]
        return float((w @ self.y[rows] + trust * self.prior) / (w.sum() + trust))


def fit(docs: DataFrame, labels: DataFrame, label: str, learn: Column, most: int = EXAMPLES) -> Model:
    """`docs` as `keyed` gives them. At most `most` examples of each class; document frequencies are those of all documents."""
    ids, hashes, counts, y, prior = examples(docs, labels, label, learn, most, word_terms)
    vocabulary, factor = weighted_terms(hashes, y)
    n, df = document_frequency(docs, vocabulary, word_terms)
    idf = (np.log((1 + n) / (1 + df)) + 1) * factor
    ends = np.cumsum([0, *map(len, hashes)])
    terms, weights = np.empty(ends[-1], np.int32), np.empty(ends[-1])
    for h, c, i, j in zip(hashes, counts, ends.tolist(), ends[1:].tolist()):
        terms[i:j] = np.searchsorted(vocabulary, h)
        w = (1 + np.log(c)) * idf[terms[i:j]]
        weights[i:j] = w / max(1e-12, np.sqrt((w**2).sum()))
    rows = np.repeat(np.arange(len(hashes), dtype=np.int32), np.diff(ends))
    del hashes, counts
    index = BlockMaxIndex.of(rows, terms, weights, max(1, len(ids)), len(vocabulary), y if len(y) else None)
    share = max(1e-9, float(y.mean())) if len(y) else 1.0
    weight = np.where(y == 1, prior / share, (1 - prior) / max(1e-9, 1 - share)) if len(y) else np.zeros(0)
    return Model(vocabulary, idf, float(np.log(1 + n) + 1), index, ids, y.astype(float), weight / max(1e-9, weight.max(initial=0)), prior)


def score(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 3, out_fold: int = 1, k: int = 15, trust: float = 0.05, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, h, held_out, score, predicted, evidence (ids and cosines of the neighbours) of every row.

    Cosines are taken over all words; those of no example weigh as if found in no document. A text without words of the examples, such as an empty or null one, has no
    neighbours and gets the share of label 1.
    Without labels all scores are 0. Labels are learnt outside of fold `out_fold`; ids and other columns are no input.
    A text of any length is taken whole, in a batch of its own in one task; an empty table gives no rows; further columns, whatever their
    names, are left out.
    """
    rows = keyed(docs, id_col, text_col)
    model = fit(rows, labels, label, fold("id", folds) != out_fold)
    held = docs.sparkSession.sparkContext.broadcast(model)
    del model  # the driver needs its memory for the jobs
    pa.default_memory_pool().release_unused()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in pieces(batches):
            of, term, w = m.vectors(*word_terms(b.column("text")))
            scores, evidence = np.full(b.num_rows, m.prior), [[] for _ in range(b.num_rows)]
            edge = np.searchsorted(of, np.arange(0, b.num_rows + TEXTS, TEXTS))
            for start, i, j in zip(range(0, b.num_rows, TEXTS), edge, edge[1:]):
                size = min(TEXTS, b.num_rows - start)
                for at, (near, cosine) in enumerate(m.index.nearest(of[i:j] - start, term[i:j], w[i:j], size, k), start):
                    scores[at] = m.vote(near, cosine, trust) if len(near) else m.prior
                    evidence[at] = [{"doc_id": x, "cosine": c} for x, c in zip(m.ids[near].tolist(), cosine.tolist())]
            yield batch(doc_id=b.column("doc_id"), h=b.column("h"), score=scores, evidence=pa.array(evidence, pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64())]))))

    judged = in_batches(rows, judge, "doc_id long, h long, score double, evidence array<struct<doc_id: long, cosine: double>>")
    return judged.select("doc_id", "h", (fold("doc_id", folds) == out_fold).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")
