import random

import pytest

import __spark_entry__
import corpus_pipeline
from tamarack.llm import queries


def test_registered():
    names = __spark_entry__.queries()
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 11)}
    assert set(queries.QUERIES) <= set(names) and names["pipeline"] is corpus_pipeline.run
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "substring_dedup", "decontaminate", "byte_bpe"]


@pytest.fixture
def folder(spark, tmp_path):
    rng = random.Random(21)
    words = ["".join(rng.choices("abcdefghijkl", k=rng.randint(3, 8))) for _ in range(3000)]
    some = lambda n: " ".join(rng.choices(words, k=n))
    passage, item = some(55), some(40)
    docs = [some(150) for _ in range(200)]
    for i in range(0, 60):
        docs[i] += " vile nasty " + some(5)
    docs[100] = docs[101].replace(" ", "  ")
    docs[110] = some(60) + " " + passage + " " + some(60)
    docs[111] = some(30) + "\n" + passage + "\n" + some(90)
    docs[120] += " " + item
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(docs)] + [(500, None, None, None, None), (501, "", "en", "s", 0), (None, some(40), "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 0, int(i < 60)) for i in range(0, 200, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), docs, passage


def test_stages(spark, folder):
    at, docs, passage = folder
    frame = spark.read.parquet(f"{at}/documents.parquet")
    columns = frame.columns
    for name, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, at)
        frame = spark.createDataFrame(frame.collect(), frame.schema)
        ids = {r.doc_id for r in frame.collect()}
        assert name == "byte_bpe" or frame.columns == columns
        if name == "toxicity":
            assert len(ids & set(range(60))) <= 3 and set(range(60, 200)) | {500, 501, None} <= ids
        if name == "near_dedup":
            assert 100 in ids and 101 not in ids
        if name == "substring_dedup":
            texts = {r.doc_id: r.text for r in frame.collect()}
            for i in (110, 111):
                a, b = docs[i].split(passage)
                assert texts[i] == a + b.lstrip()
            assert all(texts[i] == docs[i] for i in range(130, 200)) and texts[500] is None
        if name == "decontaminate":
            assert 120 not in ids and set(range(130, 200)) | {110, 111, 500, 501, None} <= ids
    assert {r.doc_id: r.n_tokens for r in frame.collect()}[501] == 0
    result = {(r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, at).collect()}
    assert result == {(r.doc_id, r.ids_sha256) for r in frame.collect()}
