import random
from collections import defaultdict

import numpy as np
import pytest

from tamarack.llm import minhash
from tamarack.llm.components import components


def brute(rows):
    """(n_shingles, component) of each row, from sets of word tuples."""
    sets = []
    for _, text in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    parent = {key: key for key, _ in rows if key is not None}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, (a, _) in enumerate(rows):
        for j in range(i):
            b = rows[j][0]
            x, y = sets[i], sets[j]
            if None not in (a, b) and x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    return {(key, len(s), None if key is None else root(key)) for (key, _), s in zip(rows, sets, strict=True)}


def corpus():
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefg", k=5)) for _ in range(300)]
    rows = []
    for _ in range(12):
        base = rng.choices(words, k=rng.choice([6, 40, 120, 300]))
        for _ in range(6):
            w = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, len(w) // 12])):
                w[rng.randrange(len(w))] = rng.choice(words)
            rows.append(" ".join(w))
    rows += ["", None, " \t\n", "one two", "ONE  two", "one two three four five", "é É", "É é", rows[0].upper(), rows[0]]
    rows += ["x " * 4000]
    out = list(enumerate(rows, 100))
    rng.shuffle(out)
    return out + [(None, rows[0]), out[0]]


def test_like_brute_force(table):
    rows = corpus()
    found = minhash.near_duplicates(table(rows)).collect()
    assert len(found) == len(rows)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in found} == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)
    left = minhash.one_of_each(table(rows)).collect()
    assert {r.doc_id for r in left} == {c if k is not None else None for k, _, c in brute(rows)}


def test_blocks_of_large_groups(table, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 4)
    monkeypatch.setattr(minhash, "LINK_BLOCK", 3)
    rows = corpus()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(table(rows)).collect()} == brute(rows)


def test_signature_estimates_similarity():
    rng = np.random.default_rng(4)
    for share in (0.3, 0.75, 0.9):
        common, n = rng.integers(0, 1 << 63, int(2000 * share), np.uint64), 2000 - int(2000 * share)
        a, b = (np.unique(np.concatenate([common, rng.integers(0, 1 << 63, n // 2, np.uint64)])) for _ in range(2))
        x, y = minhash.signature(a), minhash.signature(b)
        assert abs((x == y).mean() - share) < 0.15
        agree = minhash.agreement(minhash.sketches(x[None]), minhash.sketches(y[None]))[0] / minhash.COORDINATES
        assert abs(agree - (share + (1 - share) / 4)) < 0.15


def test_empty(table):
    assert minhash.near_duplicates(table(corpus()).limit(0)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 60])
def test_components(spark, n):
    rng = random.Random(n)
    links = [(rng.randrange(80), rng.randrange(80)) for _ in range(n)] + [(200 + i, 201 + i) for i in range(40)]
    near = defaultdict(set)
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    want = {}
    for start in sorted(near):
        todo = [start] if start not in want else []
        while todo:
            k = todo.pop()
            if k not in want:
                want[k] = start
                todo += near[k]
    want = {k: c for k, c in want.items() if near[k] - {k}}
    found = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.component for r in found} == want and len(found) == len(want)
