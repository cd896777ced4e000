import pytest
from pyspark.sql import functions as F

from strideframe.llm.frames import keyed

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"word{k % 977}{'x' * (k % 7)}" for k in range(30_000))
PASSAGE = "one passage of a little more than twenty words that several documents share word by word in the very same order as here stated"


@pytest.fixture(scope="session")
def docs(spark):
    """Real documents and awkward ones, with columns whose names the operators use themselves."""
    first = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    text = first.orderBy("doc_id").first().text
    odd = [
        (None, "a text without an id " + PASSAGE), (None, None), (9001, None), (9002, ""), (9003, " \n\t "), (9004, LONG), (9005, LONG + " tail"),
        (9006, "the same row twice, of more than a few words indeed"), (9006, "the same row twice, of more than a few words indeed"),
        (9007, "one id " + PASSAGE), (9007, "but two texts " + PASSAGE), (9008, "three little words"), (9009, "Three little words"),
        (9010, text), (9011, text.upper()), (9012, "<|endoftext|> special <|startoftext|>x"), (9013, "é́ J̌ \xa0   日本語\x1c\x1f 🙂 á,b"),
        (9014, "same same same same same same same same same same same same same same same same same same same same same same same same"),
        (9015, "Licensed under the Apache License, Version 2.0. Released under the MIT license. Released under the MIT License"), (9016, "x"), (-5, PASSAGE + " " + PASSAGE),
        (9017, "word" * 20_000), (9018, "y\n\ny\n \ny"), (9019, "idiot moron"),
    ]
    rows = first.union(spark.createDataFrame(odd, "doc_id long, text string"))
    return rows.withColumns({c: F.lit(i) for i, c in enumerate(["h", "node", "g", "score", "n_tokens", "_doc_id", "_h", "ids", "places", "term", "h text", "n"])}).repartition(5)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")


@pytest.fixture(scope="session")
def known(docs):
    """(doc_id, h, text) of each distinct document, in the operators' order."""
    rows = {(r.doc_id, r.h): r.text for r in keyed(docs).collect()}
    return [(i, h, rows[i, h]) for i, h in sorted(rows, key=lambda k: (k[0] is not None, k[0] or 0, k[1]))]


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def by_key(frame, *columns):
    rows = frame.collect()
    return {(r.doc_id, r.h): tuple(r[c] for c in columns) for r in rows}, len(rows)
