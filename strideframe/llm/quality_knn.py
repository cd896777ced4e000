"""Quality by nearest-neighbour voting in a latent-semantic space."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideframe.llm.frames import batch, in_batches, keyed
from strideframe.llm.text import pieces
from strideframe.llm.vectors import document_frequency, examples, fold, in_vocabulary, shape_terms

#: Labelled rows of each class to learn from; dimensions at most.
EXAMPLES, RANK = 2000, 64


def product(of: np.ndarray, term: np.ndarray, w: np.ndarray, right: np.ndarray, size: int, step: int = 256) -> np.ndarray:
    """Rows of a sparse matrix (entries ordered by row `of`) times `right`, some rows at a time."""
    out = np.zeros((size, right.shape[1]), np.float32)
    edge = np.searchsorted(of, np.arange(0, size + step, step))
    for a, z in zip(edge.tolist(), edge[1:].tolist()):
        if z > a:
            head = np.flatnonzero(np.diff(of[a:z], prepend=-1))
            out[of[a:z][head]] = np.add.reduceat(right[term[a:z]] * w[a:z, None], head)
    return out


def weighed(of: np.ndarray, term: np.ndarray, n: np.ndarray, idf: np.ndarray, size: int) -> np.ndarray:
    """Weight of each entry in the row's unit vector."""
    w = (1 + np.log(n)) * idf[term]
    return (w / np.sqrt(np.bincount(of, w**2, size))[of]).astype(np.float32)


@dataclass
class Space:
    vocabulary: np.ndarray
    idf: np.ndarray
    basis: np.ndarray  # terms x dimensions
    points: np.ndarray  # examples x dimensions, of length 1
    y: np.ndarray
    weight: np.ndarray
    prior: float

    def project(self, of: np.ndarray, term: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
        """Unit vectors of texts; zero for a text without known terms."""
        out = product(of, term, weighed(of, term, n, self.idf, size), self.basis, size)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def latent(of: np.ndarray, term: np.ndarray, w: np.ndarray, rows: int, columns: int, rank: int) -> np.ndarray:
    """Leading right singular vectors of a sparse matrix by power steps from a fixed start.

    Vectors are made orthogonal on the side of the rows alone, which is short; of the side of the columns, that of all
    terms, there is one matrix at a time.
    """
    if not len(of):
        return np.zeros((columns, 0), np.float32)
    by = np.lexsort((of, term))
    of_, term_, w_ = of[by], term[by], w[by]
    back = lambda x: product(term_, of_, w_, x, columns, 4096)
    k = min(rank + 10, rows, columns)
    q = np.linalg.qr(np.random.default_rng(11).standard_normal((rows, k)).astype(np.float32))[0]
    for _ in range(8):
        q = np.linalg.qr(product(of, term, w, back(q), rows))[0]
    found = back(q)
    squares, turn = np.linalg.eigh((found.T @ found).astype(float))
    size = np.sqrt(np.maximum(squares, 0))[::-1]
    good = min(rank, int((size > 1e-4 * size[0]).sum()))
    return found @ (turn[:, ::-1][:, :good] / size[:good]).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, label: str, learn: Column, most: int = EXAMPLES) -> Space:
    """All terms of at most `most` examples of each class; document frequencies are those of all documents."""
    _, hashes, counts, y, prior = examples(docs, labels, label, learn, most, shape_terms)
    vocabulary, term = np.unique(np.concatenate([np.zeros(0, np.uint64), *hashes]), return_inverse=True)
    n, df = document_frequency(docs, vocabulary, shape_terms)
    idf, of = np.log((1 + n) / (1 + df)) + 1, np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])
    w = weighed(of, term, np.concatenate([np.ones(0), *counts]), idf, len(hashes))
    basis = latent(of, term, w, len(hashes), len(vocabulary), RANK)
    points = product(of, term, w, basis, len(hashes))
    points /= np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-12)
    share = max(1e-9, float(y.mean())) if len(y) else 1.0
    weight = np.where(y == 1, prior / share, (1 - prior) / max(1e-9, 1 - share))
    return Space(vocabulary, idf, basis, points, y.astype(np.float32), (weight / max(1e-9, weight.max(initial=0))).astype(np.float32), prior)


def score(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, out_fold: int = 0, k: int = 15, trust: float = 0.05, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, h, held_out, score, predicted of every row.

    The vote of a neighbour has the weight cosine ** 8 times the rows that the example stands for. A text without
    known terms, such as an empty or null one, gets the share of label 1; without labels all scores are 0.
    A text of any length is taken whole, in a batch of its own in one task; an empty table gives no rows; further columns, whatever their
    names, are left out.
    """
    rows = keyed(docs, id_col, text_col)
    held = docs.sparkSession.sparkContext.broadcast(fit(rows, labels, label, fold("id", folds) != out_fold))
    pa.default_memory_pool().release_unused()  # the driver needs its memory for the jobs

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in pieces(batches):
            scores = np.full(b.num_rows, m.prior)
            if len(m.points):
                points = m.project(*in_vocabulary(m.vocabulary, *shape_terms(b.column("text"))), b.num_rows)
                near = min(k, len(m.points))
                for at in range(0, b.num_rows, 256):
                    cosine = points[at : at + 256] @ m.points.T
                    best = np.sort(np.argpartition(-np.round(cosine, 5), near - 1, axis=1)[:, :near], axis=1)
                    w = np.maximum(np.take_along_axis(cosine, best, 1), 0).astype(float) ** 8 * m.weight[best]
                    scores[at : at + 256] = ((w * m.y[best]).sum(1) + trust * m.prior) / (w.sum(1) + trust)
            yield batch(doc_id=b.column("doc_id"), h=b.column("h"), score=np.clip(scores, 0, 1))

    judged = in_batches(rows, judge, "doc_id long, h long, score double")
    return judged.select("doc_id", "h", (fold("doc_id", folds) == out_fold).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
