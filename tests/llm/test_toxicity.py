import random
import zlib

import numpy as np

from tamarack.llm import toxicity


def rows():
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(500)]
    out, labels = [], []
    for i in range(600):
        toxic = i % 6 == 0
        text = rng.choices(words, k=rng.randint(20, 200)) + (rng.sample(["vile", "nasty", "awful", "rotten"], 2) if toxic else [])
        rng.shuffle(text)
        out.append((i, " ".join(text)))
        if i % 2 == 0:
            labels.append((i, int(toxic)))
    return out, labels


def test_held_out_accuracy(spark, table):
    docs, labels = rows()
    docs += [(None, "vile nasty"), (1000, None), (1001, ""), (1002, "vile nasty rotten " + "x " * 30_000), docs[0]]
    known = spark.createDataFrame([*labels, (None, 1), (3, None), (4, 0)], "doc_id long, toxic int")
    frame = table(docs)
    found = toxicity.classify(frame, known).collect()
    assert len(found) == len(docs)
    by = {r.doc_id: r for r in found}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    assert all(r.held_out == (k is not None and zlib.crc32(str(k).encode()) % 5 == 0) for k, r in by.items())
    held = [i for i in range(600) if by[i].held_out]
    right = sum(by[i].predicted == (i % 6 == 0) for i in held)
    assert right >= 0.95 * len(held)
    assert by[1000].score == by[1001].score < 0.5 and by[1002].predicted == 1
    clean = toxicity.without_toxic(frame, known)
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in found if not r.predicted}
    assert clean.columns == frame.columns


def test_labels_of_the_held_out_fold_are_not_used(spark, table):
    docs, labels = rows()
    flipped = [(k, 1 - y if zlib.crc32(str(k).encode()) % 5 == 0 else y) for k, y in labels]
    a, b = ({r.doc_id: r.score for r in toxicity.classify(table(docs), spark.createDataFrame(x, "doc_id long, toxic int")).collect()} for x in (labels, flipped))
    assert a == b


def test_without_labels_or_documents(spark, table):
    docs, labels = rows()
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.predicted for r in toxicity.classify(table(docs[:20]), none).collect()} == {0}
    assert toxicity.classify(table(docs).limit(0), spark.createDataFrame(labels, "doc_id long, toxic int")).count() == 0


def test_risk_and_its_gradient_against_sums_and_differences():
    rng = np.random.default_rng(3)
    is_pos = np.arange(40) < 12
    for shift, prior in ((0.0, 0.2), (1.5, 0.4), (-2.0, 0.1), (-3.0, 0.45)):
        z = rng.normal(0, 2, 40) + np.where(is_pos, 3.0, shift)
        value, pull = toxicity.risk(z, is_pos, prior)

        def parts(z, prior=prior):
            as_toxic = sum(np.log1p(np.exp(-x)) for x in z[is_pos]) / 12
            as_clean = sum(np.log1p(np.exp(x)) for x in z[is_pos]) / 12
            return prior * as_toxic, sum(np.log1p(np.exp(x)) for x in z[~is_pos]) / 28 - prior * as_clean

        toxic, rest = parts(z)
        assert abs(value - (toxic + max(rest, 0))) < 1e-9
        for i in range(40):
            step = np.eye(40)[i] * 1e-5
            up, down = parts(z + step), parts(z - step)
            wanted = (sum(up) - sum(down)) / 2e-5 if rest >= 0 else -(up[1] - down[1]) / 2e-5
            assert abs(pull[i] - wanted) < 1e-6


def test_posterior_of_a_tiny_model():
    """One feature, in all confirmed and in a tenth of the unlabelled documents, at a prior of a tenth:
    whoever has it is toxic, whoever hasn't is clean."""
    with_it, without = np.array([5], np.int32), np.array([9], np.int32)
    model = toxicity.train([with_it] * 60, [with_it] * 40 + [without] * 360, 0.1, steps=2000)
    assert model.used.tolist() == [5]
    odds = model.bias + model.values[0]
    assert 1 / (1 + np.exp(-odds)) > 0.9 and 1 / (1 + np.exp(-model.bias)) < 0.05


def test_contradicting_labels_and_several_texts_of_an_id(spark, table):
    docs, labels = rows()
    twice = [*labels, *((k, 0) for k, y in labels if y), *((k, 7) for k, y in labels if not y)]
    more = [*docs, *((i, t) for i, t in docs if i % 3 == 0), (1, "other words of this id")]
    a, b = ({r.doc_id: r.predicted for r in toxicity.classify(table(x), spark.createDataFrame(y, "doc_id long, toxic int")).orderBy("doc_id", "score").collect()} for x, y in ((docs, labels), (more, twice)))
    assert sum(a[i] != b[i] for i in a if i != 1) <= 0.02 * len(a)
