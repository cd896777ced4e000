"""The stages one after another, against the operators' loops."""

import corpus_pipeline
from strideframe.session import cut_lineage
from tests.llm import brute
from tests.llm.conftest import SF, by_key


def test_stages(spark, docs):
    from strideframe.llm.frames import keyed

    kept, columns = docs, docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = kept
        kept = cut_lineage(stage(spark, kept, SF))
        rows = {(r.doc_id, r.h): r.text for r in keyed(before).collect()}
        order = [(i, h, rows[i, h]) for i, h in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))]
        if k < 4:
            assert kept.columns == columns
            after, n = by_key(keyed(kept), "text")
        if name == "near_duplicates":
            want = brute.groups(order, 5)
            alike = [i for i, h, text in order if want[i, h][0] == 0 or want[i, h][1] == i]
            assert sorted(map(str, alike)) == sorted(str(r.doc_id) for r in kept.select("doc_id", "text").collect())
        if name == "repeated_passages":
            cut = brute.repeats(order)
            want = sorted(cut[i, h][2] if cut[i, h][1] else brute.sha(t) for i, h, t in order)
            assert sorted(brute.sha(r.text or "") for r in kept.collect()) == want
        if name == "decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            hit = brute.phrases(order, items)
            assert set(after) == {key for key in hit if not hit[key][1]}
        if name == "bpe":
            assert kept.count() == before.count()


def test_empty_table(spark, empty):
    kept = empty
    for _, stage in corpus_pipeline.STAGES:
        kept = cut_lineage(stage(spark, kept, SF))
    assert kept.count() == 0


def test_one_document_of_each_group_stays(spark):
    text = lambda k, end: " ".join(f"g{k}w{j}" for j in range(60)) + " " + end
    rows = [(None, text(1, "one")), (None, text(1, "two")), (5, text(2, "one")), (5, text(2, "two")), (6, text(2, "three")),
            (7, text(3, "same")), (7, text(3, "same")), (8, ""), (8, ""), (8, None), (8, " \n"), (9, text(4, "alone"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = corpus_pipeline.drop_near_copies(spark, docs, SF).collect()
    found = sorted((r.doc_id or 0, (r.text or "").strip().split(" ")[0][:2]) for r in kept)
    assert found == [(0, "g1"), (5, "g2"), (7, "g3"), (8, ""), (8, ""), (8, ""), (8, ""), (9, "g4")]
    assert {(r.doc_id, r.text) for r in kept} <= set(rows)
