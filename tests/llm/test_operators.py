"""Each operator against loops or the library, on awkward rows and on an empty table."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strideframe.llm import chunk_bpe, count_cache, id_files, license_align, loglik, odd_sketch, phrase_index, quality_knn, suffix_dedup, toxicity
from strideframe.llm.components import components
from strideframe.llm.tokens import Codec, codec
from strideframe.session import scratch_path
from tests.llm import brute
from tests.llm.conftest import SF, by_key

WORD, BYTE = (public_tokenizers.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json"))
TEXT = st.text(st.sampled_from(list("aAbé ñß  \n\t'.,|#<>1\xa0́\x1c日ndofthe")), max_size=60)


@pytest.fixture(scope="module")
def library():
    return {p: Tokenizer.from_file(p) for p in (WORD, BYTE)}


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(TEXT, max_size=5))
def test_units_give_the_librarys_ids(texts):
    for path in (WORD, BYTE):
        c = codec(path)
        ids, at = c.encode(pa.array(texts, pa.string()))
        want = [c.library.encode(t, add_special_tokens=False).ids for t in texts]
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == want
        assert c.counts(pa.array(texts, pa.string())).tolist() == [len(x) for x in want]
        assert [x.decode() for x in c.decode(ids, at)] == [c.library.decode(x, skip_special_tokens=False) for x in want]


def test_chunk_bpe(docs, empty, library):
    rows = [r for r in docs.select("doc_id", "text").collect()]
    found = chunk_bpe.decode(chunk_bpe.encode(docs, WORD), WORD, digests=True).collect()
    said = lambda t: library[WORD].encode(t or "", add_special_tokens=False).ids
    want = sorted((str(r.doc_id), len(x := said(r.text)), brute.sha(" ".join(map(str, x))), brute.sha(library[WORD].decode(x, skip_special_tokens=False))) for r in rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in found) == want
    assert chunk_bpe.decode(chunk_bpe.encode(empty, WORD), WORD).count() == 0


def test_chunks_depend_on_their_text_alone():
    shared = " ".join(f"w{k * 7919 % 4001}" for k in range(8000))
    texts = [shared, "something before " + shared, shared[5000:]]
    chunks = []
    for t in texts:
        data = np.frombuffer(t.encode(), np.uint8)
        start, end, _ = chunk_bpe.chunk_bounds(data, np.array([0, len(data)]))
        assert start[0] == 0 and end[-1] == len(data) and (start[1:] == end[:-1]).all()
        chunks.append({t[a:b] for a, b in zip(start, end)})
    assert len(chunks[0] & chunks[1]) > len(chunks[0]) / 2 and len(chunks[0] & chunks[2]) > len(chunks[2]) / 2


def test_joins_are_repaired(library):
    c = Codec(WORD)
    text = ("Hello wörld, don't split " * 40 + "x" * 50 + " end.").encode()
    want = library[WORD].encode(text.decode(), add_special_tokens=False).ids
    asked = []
    encode = c.encode
    c.encode = lambda column: (asked.append(sum(len(x) for x in column.to_pylist())), encode(column))[1]
    for cuts in ([100, 300], [7, 9, 11, 500], [995, 1010], [0, 1042]):
        edges = list(zip(cuts, cuts[1:]))
        held = {}
        for a, b in edges:
            s, e = chunk_bpe._core(text[a:b])
            held[a, b] = encode(pa.array([text[a + s : a + e].decode() if s >= 0 else ""]))[0]
        assert chunk_bpe.assemble(c, [text], [held])[0].tolist() == want
    assert asked[-1] < 120  # one chunk over nearly all: only its ends, with a word on each side, are encoded
    wrong = {(100, 300): np.array([1, 2, 3], c.width)}
    assert chunk_bpe.assemble(c, [text], [wrong])[0].tolist() == want


def test_elias_fano():
    for values in ([], [0], [0, 0, 0], [5, 5, 9, 1 << 40], list(range(0, 5000, 3)), [0] * 600 + [1 << 20] * 600):
        e = id_files.EliasFano.from_bytes(id_files.EliasFano.of(np.array(values, np.uint64)).to_bytes())
        assert e.all().tolist() == values
        assert [e.select(i) for i in range(0, len(values), 7)] == values[::7]
    ends = np.cumsum(np.random.default_rng(1).integers(1, 2000, 10_000))
    assert len(id_files.EliasFano.of(ends).to_bytes()) < 10_000 * 14 / 8  # 2 + log2(1000) bits and the ranks


def test_id_files(spark, docs, empty, library):
    path = scratch_path(spark, "ids")
    id_files.write_ids(docs, path, WORD, block_ids=500)
    found = id_files.crc32_of_ids(id_files.read_ids(spark, path)).orderBy("start", "n_tokens").collect()
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("x")).orderBy(F.col("doc_id").asc_nulls_first(), "x").collect()
    start, want = 0, []
    for r in rows:
        ids = library[WORD].encode(r.text or "", add_special_tokens=False).ids + [2]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert [tuple(r) for r in found] == want
    id_files.write_ids(empty, path + "-none", WORD)
    assert id_files.read_ids(spark, path + "-none").count() == 0


def test_counts_are_stored_once(spark, docs, empty, library):
    cache = scratch_path(spark, "counts")
    want = sorted((str(r.doc_id), len((r.text or "").encode()), n := len(library[BYTE].encode(r.text or "", add_special_tokens=False).ids), n > 512) for r in docs.select("doc_id", "text").collect())
    for _ in range(2):
        found = count_cache.token_counts(docs, BYTE, cache)
        assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in found.collect()) == want
    stored = spark.read.parquet(cache)
    assert stored.count() == docs.select(F.coalesce("text", F.lit(""))).distinct().count()
    count_cache.token_counts(docs.select("doc_id", "text").limit(3).union(spark.createDataFrame([(1, "a new text")], "doc_id long, text string")), BYTE, cache).collect()
    assert spark.read.parquet(cache).count() == stored.count() + 1
    assert count_cache.token_counts(empty, BYTE, cache).count() == 0


@pytest.mark.parametrize("most", [32 << 20, 300])
def test_suffix_dedup(docs, empty, known, monkeypatch, most):
    monkeypatch.setattr(suffix_dedup, "GROUP_BYTES", most)
    found, n = by_key(suffix_dedup.remove_repeats(docs), "n_words", "n_removed", "kept_sha256")
    assert n == docs.count() and found == brute.repeats(known)
    assert suffix_dedup.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("shingle,block", [(4, 4096), (5, 4096), (4, 3)])
def test_near_duplicates(docs, empty, known, monkeypatch, shingle, block):
    monkeypatch.setattr(odd_sketch, "BLOCK", block)
    frame = odd_sketch.near_duplicates(docs, shingle=shingle)
    found, n = by_key(frame, "n_shingles", "component_id")
    assert n == docs.count() and found == brute.groups(known, shingle)
    assert frame.where("kept <> (doc_id <=> component_id)").count() == 0
    assert odd_sketch.near_duplicates(empty).count() == 0


def test_sketches_tell_similar_sets():
    rng = np.random.default_rng(3)
    for share in (0.8, 0.9):
        a = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
        off = int(2000 * (1 - share) / (1 + share))
        b = np.concatenate([a[off:], rng.integers(0, 1 << 63, off, dtype=np.uint64)])
        s = odd_sketch.odd_sketches(odd_sketch.samples(np.concatenate([np.sort(a), np.sort(b)]), np.array([0, 2000, 4000])))
        far = int(np.bitwise_count(s[0] ^ s[1]).sum())
        assert far < odd_sketch.FAR and abs(odd_sketch.similarity(far) - share) < 0.1


def test_components(spark):
    path = [(k, k + 1) for k in range(0, 40)] + [(100, 101), (101, 100), (7, 7), (55, 54)]
    found = {r.node: r.component for r in components(spark.createDataFrame(path, "u long, v long")).collect()}
    assert found == {**{k: 0 for k in range(41)}, 100: 100, 101: 100, 54: 54, 55: 54}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_phrases(spark, docs, empty, known):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").union(spark.createDataFrame(
        [(901, "three LITTLE words"), (902, None), (903, "..."), (None, "no id"), (904, "same same same same same same same same same same same"), (904, "a few words indeed")], "item_id long, text string"))
    found, n = by_key(phrase_index.find_phrases(docs, bench), "n_words", "n_hit", "items")
    assert n == docs.count() and found == brute.phrases(known, [tuple(r) for r in bench.collect()])
    assert phrase_index.find_phrases(empty, bench).count() == 0
    assert phrase_index.find_phrases(docs, bench.where("false")).where("contaminated").count() == 0


def test_phrases_in_passes(docs, known, spark, monkeypatch):
    monkeypatch.setattr(phrase_index, "PASS_WORDS", 2000)
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    found, _ = by_key(phrase_index.find_phrases(docs, bench), "n_words", "n_hit", "items")
    assert found == brute.phrases(known, [(r.item_id, r.text) for r in bench.collect()])


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "alpha x beta gamma delta"), (3, "beta alpha gamma delta"), (4, "alpha beta gamma")], "doc_id long, text string")
    bench = spark.createDataFrame([("i", "alpha beta gamma delta")], "item_id string, text string")
    near = lambda slop: {r.doc_id for r in phrase_index.find_phrases(docs, bench, n=4, slop=slop).where("contaminated").collect()}
    assert near(0) == {1} and near(1) == {1, 2, 3}


def test_rules_and_ratio(docs, empty, known, labels):
    frame = loglik.judge(docs, labels)
    found, n = by_key(frame, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert n == docs.count() and found == brute.rules(known)
    judged = frame.join(labels, "doc_id")
    assert judged.where("quality = 1 and not base_failed and not kept").count() <= 0.02 * judged.where("quality = 1").count()
    assert judged.where("quality = 0 and kept").count() <= 0.1 * judged.where("quality = 0").count()
    assert loglik.judge(empty, labels).count() == 0
    assert loglik.judge(docs, labels.where("false")).where("kept <> (not base_failed)").count() == 0


@pytest.mark.parametrize("module,label,threshold", [(toxicity, "toxic", 0.7), (quality_knn, "quality", 0.3)])
def test_labelled_neighbours(docs, empty, labels, module, label, threshold):
    frame = module.score(docs, labels).cache()
    assert frame.count() == docs.count()
    assert frame.where(f"score is null or score < 0 or score > 1 or predicted <> int(score >= {threshold})").count() == 0
    assert module.score(empty, labels).count() == 0
    assert module.score(docs, labels.where("false")).where("score <> 0").count() == 0
    again = module.score(docs.repartition(2), labels)
    assert frame.select("doc_id", "h", F.round("score", 6)).exceptAll(again.select("doc_id", "h", F.round("score", 6))).count() == 0


@pytest.mark.parametrize("module,label,least", [(toxicity, "toxic", 0.9), (quality_knn, "quality", 0.95)])
def test_held_out_accuracy(spark, module, label, least):
    sf = SF.replace("0.001", "0.01")
    known = spark.read.parquet(f"{sf}/labels.parquet")
    judged = module.score(spark.read.parquet(f"{sf}/documents.parquet"), known).where("held_out").join(known, "doc_id")
    assert judged.where(f"predicted = {label}").count() >= least * judged.count()


def test_index_finds_the_nearest():
    rng = np.random.default_rng(5)
    dense = rng.random((300, 40)) * (rng.random((300, 40)) < 0.1)
    rows, terms = np.nonzero(dense)
    index = toxicity.BlockMaxIndex.of(rows, terms, dense[rows, terms], 300, 40, np.arange(300) % 3)
    texts = [rng.random(40) * (rng.random(40) < 0.2) for _ in range(50)] + [np.zeros(40)]
    of, t = np.nonzero(np.array(texts))
    assert 0 < (index.slot >= 0).sum() < 40  # common terms and others
    for q, (got, cosine) in zip(texts, index.nearest(of, t, np.array(texts)[of, t], len(texts), 7)):
        every = dense @ q
        want = [r for r in np.lexsort((np.arange(300), -np.round(every, 12))) if every[r] > 0][:7]
        assert got.tolist() == want and np.allclose(cosine, every[want])
    assert index.opened < 51 * len(index.dense[0]) // toxicity.BLOCK


@given(a=st.lists(st.integers(0, 6), max_size=25), b=st.lists(st.integers(0, 6), max_size=12))
def test_patience_pairs(a, b):
    pairs = license_align.patience(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(x < y for p, q in zip(pairs, pairs[1:]) for x, y in zip(p, q))
    assert len(license_align.patience(b, b)) == len(b)


def test_license_scan(docs, empty, known):
    templates = [(k, brute.ALNUM.findall(brute.lower(v))) for k, v in sorted(license_align.TEMPLATES.items())]
    found, n = by_key(license_align.scan(docs), "n_words", "notices")
    assert n == docs.count()
    for i, h, text in known:
        words = brute.ALNUM.findall(brute.lower(text))
        want = license_align.find_in(words, templates, 0.8) if len(words) < 5000 else []
        assert found[i, h][0] == len(words) and [tuple(m) for m in found[i, h][1]] == want
    assert [m[0] for m in found[next(k[:2] for k in known if k[0] == 9015)][1]] == ["apache-2.0", "mit", "mit"]
    assert license_align.scan(empty).count() == 0


def test_licenses_are_told_apart(spark):
    texts = license_align.TEXTS
    holder = "Copyright (c) 2020 Some Body. All rights reserved.\n\n"
    rows = {k: (holder + v, [k]) for k, v in texts.items()} | {
        "two": (holder + texts["mit"] + "\nand\n" + texts["bsd-3-clause"].replace("COPYRIGHT HOLDER", "REGENTS"), ["mit", "bsd-3-clause"]),
        "spdx": ("// SPDX-License-Identifier: GPL-2.0-or-later", ["gpl-2.0"]), "spdx mit": ("# SPDX-License-Identifier: MIT", ["mit"]),
        "bsd": ("Released under the BSD License", ["bsd"]), "cc": ("Licensed under CC BY 4.0", ["cc-by-4.0"]), "nc": ("licensed under CC BY-NC-SA 4.0", ["cc-by-nc-sa-4.0"]),
        "gpl2": ("This work is licensed under the GNU General Public License, version 2.", ["gpl-2.0"]), "lgpl": ("under the GNU Lesser General Public License, version 3", ["lgpl-3.0"]),
        "own": ("Released under the Foo License", []), "unknown": ("Licensed under CC BY-NC 9.0", []), "plain": ("the license of the software is not told here " * 50, [])}
    frame = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(rows.values())], "doc_id long, text string")
    found = {r.doc_id: [m.name for m in r.notices] for r in license_align.scan(frame).collect()}
    assert {k: found[i] for i, k in enumerate(rows)} == {k: want for k, (_, want) in rows.items()}
    mine = {r.doc_id: [m.name for m in r.notices] for r in license_align.scan(frame, {**license_align.TEMPLATES, "foo": "Released under the Foo License"}).collect()}
    assert mine[list(rows).index("own")] == ["foo"]


def test_all_trusted_rows_count(spark, docs, labels):
    absent = spark.range(10_000_000, 10_020_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    by = lambda known: {(r.doc_id, r.h): round(r.ratio, 9) for r in loglik.judge(docs, known).collect()}
    want = by(labels)
    assert by(labels.select("doc_id", "quality").union(absent)) == want and len(set(want.values())) > 50


def test_near_equal_examples_are_evidence_without_telling_words(spark):
    text = lambda k: " ".join(f"w{k}x{j}" if j % 2 else f"common{j}" for j in range(60))
    rows = [(k, text(k)) for k in range(60)]
    known = spark.createDataFrame([(k, int(k % 10 == 0)) for k in range(60)], "doc_id long, toxic int")
    learnt = [r.doc_id for r in known.where("toxic = 1").where(toxicity.fold("doc_id", 3) != 1).collect()]
    copy = text(learnt[0]).replace("common4", "other")
    frame = spark.createDataFrame([*rows, (1000, copy), (1001, text(1)), (1002, "common0 " + " ".join(f"new{j}" for j in range(3000)))], "doc_id long, text string")
    found = {r.doc_id: r for r in toxicity.score(frame, known).collect()}
    assert found[1000].predicted == 1 and found[1000].evidence[0].doc_id == learnt[0] and found[1000].evidence[0].cosine < 1
    assert found[1001].predicted == 0 and max(e.cosine for e in found[1002].evidence) < 0.1


def test_examples_are_bounded_after_the_join(spark):
    from strideframe.llm import vectors
    from strideframe.llm.frames import keyed

    rows = [(1, f"text {k} of a hot id") for k in range(50)] + [(1, "text 0 of a hot id")] * 20 + [(k, f"text of {k}") for k in range(2, 6)]
    docs = keyed(spark.createDataFrame(rows, "doc_id long, text string"))
    known = spark.createDataFrame([(1, 1), *[(k, 0) for k in range(2, 6)], *[(k, 0) for k in range(1000, 1500)]], "doc_id long, toxic int")
    ids, hashes, counts, y, _ = vectors.examples(docs, known, "toxic", F.lit(True), 10, vectors.word_terms)
    assert sorted(ids[y == 0]) == [2, 3, 4, 5] and ids[y == 1].tolist() == [1] * 10
    assert len({tuple(h) for h in hashes}) == len(hashes) == len(counts) == 14
