"""Scores of texts against plain loops over words."""

import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strideframe.llm import loglik, quality_knn, toxicity
from strideframe.llm.frames import keyed
from strideframe.llm.text import NOT_ALNUM, SPACE, Words
from strideframe.llm.vectors import fold, shape_terms
from tests.llm import brute
from tests.llm.conftest import SF


def real(spark, n):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    return docs.orderBy("doc_id").limit(n).repartition(3), spark.read.parquet(f"{SF}/labels.parquet")


def word_counts(text):
    return Counter(brute.ALNUM.findall(brute.lower(text or "")))


def test_toxicity_by_hand(spark):
    """Cosines over all words, the nearest 15, the vote; the words' factors are the model's, tested on their own below."""
    docs, labels = real(spark, 120)
    texts = {r.doc_id: r.text for r in docs.collect()}
    model = toxicity.fit(keyed(docs), labels, "toxic", fold("id", 3) != 1)
    w = Words(pa.array(sorted({x for t in texts.values() for x in word_counts(t)}), pa.string()), NOT_ALNUM, lower=True)
    name = {h: w.word(i).decode() for i, h in enumerate(w.hashes().tolist())}
    known = {name[h]: k for k, h in enumerate(model.vocabulary.tolist())}
    df = Counter(x for t in texts.values() for x in word_counts(t))
    plain = {x: np.log((1 + len(texts)) / (1 + df[x])) + 1 for x in df}
    factor = {x: model.idf[k] / plain[x] for x, k in known.items()}
    assert min(factor.values()) >= 1 - 1e-9 and max(factor.values()) > 1

    def vector(text):
        v = {x: (1 + np.log(n)) * (model.idf[known[x]] if x in known else model.other) for x, n in word_counts(text).items()}
        size = np.sqrt(sum(y * y for y in v.values()))
        return {x: y / size for x, y in v.items()}

    examples = [vector(texts[i]) for i in model.ids.tolist()]
    for r in toxicity.score(docs, labels).collect():
        own = vector(texts[r.doc_id])
        cosines = [sum(y * own.get(x, 0.0) for x, y in e.items() if x in known) for e in examples]
        near = [k for k in sorted(range(len(examples)), key=lambda k: (-round(cosines[k], 12), k)) if cosines[k] > 0][:15]
        votes = [cosines[k] * (cosines[k] / cosines[near[0]]) ** toxicity.SHARP * model.weight[k] for k in near]
        want = (sum(v for v, k in zip(votes, near) if model.y[k] == 1) + 0.05 * model.prior) / (sum(votes) + 0.05)
        assert r.score == pytest.approx(want, abs=1e-9)
        assert [round(e.cosine, 9) for e in r.evidence] == [round(cosines[k], 9) for k in near]


def test_telling_words_weigh_more():
    every, rare, common = (np.array([x], np.uint64) for x in (1, 2, 3))
    hashes = [np.sort(np.concatenate([every, np.array([100 + i], np.uint64), *([rare] if i < 40 else [common])])) for i in range(80)]
    term, factor = toxicity.weighted_terms(hashes, np.array([1] * 40 + [0] * 40))
    of = dict(zip(term.tolist(), factor.tolist()))
    assert of[1] == pytest.approx(1) and of[2] > 1.5 and of[3] > 1.5 and of[2] >= max(of[100 + i] for i in range(80))


def test_quality_by_hand(spark):
    """With fewer examples than dimensions the space holds them whole, so cosines are those of the projections onto their span."""
    docs, labels = real(spark, 150)
    most, rows = 12, keyed(docs)
    space = quality_knn.fit(rows, labels, "quality", fold("id", 5) != 0, most)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    terms = {i: Counter(shape_terms(pa.array([t], pa.string()))[0].tolist()) for i, t in texts.items()}
    df, place = Counter(x for c in terms.values() for x in c), {h: k for k, h in enumerate(space.vocabulary.tolist())}
    assert np.allclose(space.idf, [np.log((1 + len(texts)) / (1 + df[h])) + 1 for h in place])

    def vector(c):
        v = np.zeros(len(place))
        for x, n in c.items():
            if x in place:
                v[place[x]] = (1 + np.log(n)) * space.idf[place[x]]
        return v / max(1e-12, np.linalg.norm(v))

    every = {i: vector(c) for i, c in terms.items()}
    points = space.points @ space.basis.T  # back among the terms: unit vectors of the examples
    shown = [int(np.argmax([p @ v for v in every.values()])) for p in points]
    examples = np.array([list(every.values())[k] for k in shown])
    assert np.allclose(points, examples, atol=1e-3) and 0 < len(points) <= 2 * most
    q = np.linalg.qr(examples.T)[0]
    for i, own in every.items():
        flat = q.T @ own
        flat /= max(1e-12, np.linalg.norm(flat))
        known = sorted((place[x], n) for x, n in terms[i].items() if x in place)
        term, n = (np.array([x[k] for x in known], np.int64) for k in (0, 1))
        got = space.project(np.zeros(len(known), np.int64), term, n, 1)[0]
        assert np.allclose(space.points @ got, examples @ (q @ flat), atol=2e-3)


def test_quality_votes_by_hand(spark):
    docs, labels = real(spark, 150)
    space = quality_knn.fit(keyed(docs), labels, "quality", fold("id", 5) != 0)
    from strideframe.llm.vectors import in_vocabulary
    for r in quality_knn.score(docs, labels).join(docs, "doc_id").limit(40).collect():
        point = space.project(*in_vocabulary(space.vocabulary, *shape_terms(pa.array([r.text or ""], pa.string()))), 1)[0]
        cosines = space.points @ point
        near = sorted(range(len(cosines)), key=lambda k: -round(float(cosines[k]), 5))[:15]
        if round(float(cosines[near[-1]]), 5) == round(float(np.sort(cosines)[-16]), 5):
            continue  # a tie at the edge: either may vote
        votes = [max(0.0, float(cosines[k])) ** 8 * space.weight[k] for k in near]
        want = (sum(v * space.y[k] for v, k in zip(votes, near)) + 0.05 * space.prior) / (sum(votes) + 0.05)
        assert r.score == pytest.approx(want, abs=1e-4)


def test_ratio_by_hand(spark):
    docs, labels = real(spark, 25)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    good = {r.doc_id for r in labels.where("quality = 1").collect()} & set(texts)
    sign = r"[!-/:-@\[-`{-~]"

    def grams(text):
        tokens = [x for word in brute.SPACED.findall(text) for x in re.findall(rf"{sign}+|(?:(?!{sign}).)+", word, re.S)]
        return [bucket(g) for g in tokens + [" ".join(p) for p in zip(tokens, tokens[1:])]]

    @lru_cache(None)
    def bucket(gram):
        return int(loglik.ngram_buckets(Words(pa.array([gram], pa.string()), SPACE))[0][-1])

    corpus = Counter(g for t in texts.values() for g in grams(t))
    target = Counter(g for i in good for g in grams(texts[i]))
    n, m = sum(corpus.values()) + loglik.BUCKETS, sum(target.values()) + loglik.BUCKETS
    for r in loglik.judge(docs, labels).collect():
        own = grams(texts[r.doc_id])
        want = sum(np.log((target[g] + 1) / m) - np.log((corpus[g] + 1) / n) for g in own) / max(1, len(own))
        assert r.ratio == pytest.approx(want, abs=1e-9)
        assert r.kept == (not r.base_failed and r.ratio >= -0.25)
