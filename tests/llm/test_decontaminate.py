import random

import numpy as np
from pyspark.sql import Row

from tamarack.llm import decontaminate


def items(rng, words):
    return [(i, " ".join(rng.choices(words, k=n))) for i, n in enumerate([5, 8, 9, 12, 16, 20, 30, 60])]


def edited(rng, text, edits):
    w = text.split()
    for _ in range(edits):
        kind, at = rng.randrange(3), rng.randrange(len(w))
        if kind == 0:
            w[at] = f"new{rng.randrange(10**9)}"
        elif kind == 1:
            w.insert(at, f"new{rng.randrange(10**9)}")
        elif len(w) > 1:
            del w[at]
    return " ".join(w)


def closest(item, text):
    a, b = ([x.strip(".,;:!?\"'()[]{}<>*_-`").lower() or x for x in t.split()] for t in (item, text))
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        after = [i]
        for j, y in enumerate(b, 1):
            after.append(min(row[j] + 1, after[-1] + 1, row[j - 1] + (x != y)))
        row = after
    return min(row)


def test_like_brute_force(spark, table):
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(4000)]
    bench, other = items(rng, words), lambda n: " ".join(rng.choices(words, k=n))
    docs = []
    for _, text in bench:
        n = len(text.split())
        for edits in (0, n // 8, n // 4):
            docs.append(f"{other(rng.randrange(60))} {edited(rng, text, edits)} {other(rng.randrange(60))}")
    docs += [other(200) for _ in range(20)] + ["", None, bench[3][1].upper() + ".", other(20_000) + " " + bench[5][1]]
    whole = [(i, t) for i, t in bench if len(t.split()) < 26]
    rows = [*enumerate(docs), (None, bench[4][1])]
    frame = spark.createDataFrame([Row(*x) for x in [*bench, (None, "a b c d e f"), (77, None), (78, "too short")]], "item_id long, text string")
    found = {(r.doc_id, r.item_id): r for r in decontaminate.matches(table(rows), frame).collect()}
    want = {(k, i) for k, t in rows for i, item in whole if len((t or "").split()) < 5000 and closest(item, t or "") <= len(item.split()) // 4}
    near = {p for p in found if p[1] in dict(whole)} - {(len(docs) - 1, 5)}
    assert near <= want and len(want - near) <= 0.1 * len(want)
    assert all(found[p].edits == closest(dict(bench)[p[1]], dict(rows)[p[0]]) for p in near)
    assert (len(docs) - 1, 5) in found and (None, 4) in found
    part = " ".join(bench[7][1].split()[15:45])
    assert [r.item_id for r in decontaminate.matches(table([(1, other(30) + " " + part)]), frame).collect()] == [7]
    clean = decontaminate.without_matches(table(rows), frame).collect()
    assert {r.doc_id for r in clean} == {k for k, _ in rows} - {k for k, _ in found}


def test_blocks_and_empty_tables(spark, table, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 40)
    rng = random.Random(12)
    bench = items(rng, [f"w{i}" for i in range(500)])
    frame = spark.createDataFrame([Row(*x) for x in bench], "item_id long, text string")
    docs = table(list(enumerate(t for _, t in bench)))
    assert {(r.doc_id, r.item_id) for r in decontaminate.matches(docs, frame).collect()} >= {(i, i) for i, _ in bench}
    assert decontaminate.matches(docs.limit(0), frame).count() == 0
    assert decontaminate.matches(docs, frame.limit(0)).count() == 0
    assert decontaminate.without_matches(docs, frame.limit(0)).count() == len(bench)


def test_edit_distance():
    rng = np.random.default_rng(2)
    for _ in range(30):
        item, text = rng.integers(0, 3, 6).astype(np.uint64), rng.integers(0, 3, 15).astype(np.uint64)
        assert decontaminate.edit_distance(item, text)[0] == closest(" ".join(map(str, item)), " ".join(map(str, text)))


def test_passages_at_every_offset(spark, table):
    rng = random.Random(14)
    words = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(4000)]
    bench = [(n, rng.choices(words, k=n)) for n in (14, 25, 38, 59)]
    other = lambda: rng.choices(words, k=rng.randrange(20, 40))
    docs = []
    for item, text in bench:
        docs += [(item, 0, m, other() + text[a : a + m] + other()) for m in (13, 18, 22, 28) for a in range(item - m + 1)]
        docs += [(item, 6, 24, other() + text[a : a + 9] + other()[:6] + text[a + 15 : a + 24] + other()) for a in range(item - 23)]
    docs += [(None, 0, 12, other() + text[a : a + 12] + other()) for _, text in bench for a in range(len(text) - 11)]
    frame = spark.createDataFrame([(i, " ".join(t)) for i, t in bench], "item_id long, text string")
    data = table([(k, " ".join(d)) for k, (*_, d) in enumerate(docs)])
    found = {r.doc_id: r for r in decontaminate.matches(data, frame).collect()}
    assert {k: found[k].item_id for k in found if docs[k][0]} == {k: d[0] for k, d in enumerate(docs) if d[0]}
    near = [(found[k], d) for k, d in enumerate(docs) if d[0]]
    assert all(r.edits <= r.n_words // 4 and (r.n_words == d[0] or r.edits * d[2] <= d[1] * r.n_words) for r, d in near)
    # twelve words left are a part of 13 with an edit, but where they are the item's last or first there is one, too
    assert all(r.edits for k, r in found.items() if docs[k][0] is None)
    assert decontaminate.without_matches(data, frame).count() == len(docs) - len(found)


def test_closest_part():
    rng = np.random.default_rng(3)
    for _ in range(60):
        n = int(rng.integers(13, 20))
        item = rng.integers(0, 40, n).astype(np.uint64)
        text = np.concatenate([rng.integers(0, 40, 9).astype(np.uint64), item[rng.random(n) > 0.2], rng.integers(0, 40, 9).astype(np.uint64)])
        parts = [(decontaminate.edit_distance(item[a:b], text)[0], b - a) for a in range(n) for b in range(a + 13, n + 1)]
        near = [(k < n, e / k, -k, e) for e, k in parts if e <= k // 4]
        found = decontaminate.closest_part(item, text)
        assert (found and (found[0], found[1])) == (min(near)[3], -min(near)[2]) if near else found is None
