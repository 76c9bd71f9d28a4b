import numpy as np
from pyspark.sql import Row

from tamarack.llm import crosspolytope

SCHEMA = "vec_id long, embedding array<float>, label int, Label string"


def rows():
    rng = np.random.default_rng(6)
    out, ident = [], 0
    for label in (0, 1, None):
        for width in (16, 24):
            for _ in range(8):
                base = rng.normal(size=width)
                for _ in range(5):
                    out.append((ident, (base + rng.normal(size=width) * rng.choice([0, 0.05, 0.15, 0.3])).astype(np.float32).tolist(), label))
                    ident += 1
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None, *[1.0] * 15], [-0.0] * 16]
    out += [(ident + i, v, 0) for i, v in enumerate(odd)]
    out += [(ident + 50 + i, [3.0 * x for x in out[0][1]], 0) for i in range(3)] + [(None, out[0][1], 0)]
    return out


def brute(rows):
    fine = []
    for ident, v, label in rows:
        x = np.array([np.nan if y is None else y for y in v or []], float)
        ok = ident is not None and label is not None and len(x) and np.isfinite(x).all() and x.any()
        fine.append(x / np.linalg.norm(x) if ok else None)
    links = {r[0]: 0 for r in rows}
    parent = {r[0]: r[0] for r in rows}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, (a, _, la) in enumerate(rows):
        for j in range(i):
            b, _, lb = rows[j]
            if fine[i] is not None and fine[j] is not None and la == lb and len(fine[i]) == len(fine[j]) and fine[i] @ fine[j] >= 0.98:
                links[a] += 1
                links[b] += 1
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    return {(k, links[k], root(k) if k is not None else None) for k in links}


def test_like_brute_force(spark, monkeypatch):
    data = rows()
    frame = spark.createDataFrame([Row(*r, "x") for r in data], SCHEMA)
    assert {(r.vec_id, r.n_links, r.component_id) for r in crosspolytope.near_duplicates(frame).collect()} == brute(data)
    monkeypatch.setattr(crosspolytope, "BLOCK", 3)
    found = crosspolytope.near_duplicates(frame).collect()
    assert {(r.vec_id, r.n_links, r.component_id) for r in found} == brute(data)
    assert all(r.kept == (r.vec_id == r.component_id) for r in found) and len(found) == len(data)
    assert crosspolytope.near_duplicates(frame.limit(0)).count() == 0


def test_rotation_keeps_lengths_and_recall_is_high():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(500, 64))
    assert np.allclose((crosspolytope._hadamard(x) ** 2).sum(1), 64 * (x**2).sum(1))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    other = rng.normal(size=x.shape)
    other -= (other * x).sum(1, keepdims=True) * x
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    y = 0.98 * x + np.sqrt(1 - 0.98**2) * other
    a, b = crosspolytope.bucket_codes(x), crosspolytope.bucket_codes(y)
    assert (a[:, :, None] == b[:, None, :]).any((1, 2)).mean() > 0.995
