"""Both removals of repeated strings against brute force."""

import random
from collections import Counter

import numpy as np
import pytest

from tamarack.llm import fmindex, suffixarray, windows
from tamarack.llm.windows import gram_hashes, runs, sliding_least


def brute(texts, width):
    seen = Counter(tuple(t[i : i + width]) for t in texts for i in range(len(t) - width + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - width + 1):
            if seen[tuple(t[i : i + width])] > 1:
                gone[i : i + width] = True
        out.append(gone)
    return out


def corpus():
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdé", k=rng.randint(1, 8))) for _ in range(400)]
    some = lambda n: " ".join(rng.choices(words, k=n))
    passage, line = some(60), some(35)
    rows = [some(200) + " " + passage + " " + some(50), passage + "\n" + some(9), some(10) + "\t" + passage, line, some(5) + " " + line + " " + some(80)]
    rows += [line[:-1], "spam " * 300, some(34), "", None, some(3000), passage.replace(" ", "  ", 1)]
    return list(enumerate(rows)) + [(None, rows[0][:900]), (3, line)]


def test_suffix_array(table):
    rows = corpus()
    data = [(t or "").encode() for _, t in rows]
    want = Counter()
    for (key, _), d, gone in zip(rows, data, brute(data, 200), strict=True):
        starts = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(gone) else 0
        want[key, len(d), int(gone.sum()), starts, np.frombuffer(d, np.uint8)[~gone].tobytes()] += 1
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixarray.remove_repeats(table(rows)).collect()) == want


def test_fm_index(table):
    rows = corpus()
    words = [(t or "").encode().split() for _, t in rows]
    want, left = Counter(), Counter()
    for (key, text), w, gone in zip(rows, words, brute(words, 35), strict=True):
        kept = tuple(x for x, g in zip(w, gone, strict=True) if not g)
        want[key, len(w), int(gone.sum()), b" ".join(kept)] += 1
        left[key, kept, None if gone.any() else text] += 1
    assert Counter((r.doc_id, r.n_words, r.n_removed, bytes(r.kept)) for r in fmindex.remove_repeats(table(rows)).collect()) == want
    texts = table(rows)
    cut = fmindex.without_repeats(texts)
    assert cut.columns == texts.columns
    found = cut.collect()
    untouched = {(k, t) for k, _, t in left if t is not None}
    assert Counter((r.doc_id, tuple((r.text or "").encode().split())) for r in found) == Counter((k, kept) for k, kept, _ in left.elements())
    assert untouched <= {(r.doc_id, r.text) for r in found} and all(r.n_chars == len(r.text or "") for r in found)


@pytest.mark.parametrize("operator", [suffixarray.remove_repeats, fmindex.remove_repeats])
def test_empty_table(table, operator):
    assert operator(table(corpus()).limit(0)).count() == 0


def test_bucket_ids():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 2, 3000).astype(np.uint8)
    ends = np.array([700, 1500, 3000])
    left = ends[np.searchsorted(ends, np.arange(3000), side="right")] - np.arange(3000)
    for depth in (8, 13, 16, 30):
        ids = suffixarray.bucket_ids(data, left, depth)
        at = np.flatnonzero(left >= depth)
        text = [data[p : p + depth].tobytes() for p in at]
        assert len({(i, t) for i, t in zip(ids[at].tolist(), text, strict=True)}) == len(set(text)) == len(set(ids[at].tolist()))


def test_backward_search():
    rng = np.random.default_rng(2)
    text = np.append(rng.integers(1, 6, 400), 0)
    index = fmindex.FMIndex(text, 8)
    for _ in range(50):
        pattern = rng.integers(1, 6, 4)
        low, high = np.array([0]), np.array([len(text)])
        for c in pattern[::-1]:
            low, high = index.extend(np.array([c]), low, high)
        assert int(high[0] - low[0]) == sum((text[i : i + 4] == pattern).all() for i in range(len(text) - 3))


def test_runs_cover_every_window_once():
    values = np.random.default_rng(3).integers(0, 1 << 60, 500, np.uint64)
    values[200:300] = values[200]
    ends = np.array([120, 130, 500])
    kind = fmindex.KIND
    m, begin, length, hits = runs(values, ends, kind)
    windows = [i for b, n in zip(begin, length, strict=True) for i in range(b, b + n)]
    starts = [0, 120, 130]
    assert windows == [i for s, e in zip(starts, ends, strict=True) for i in range(s, e - kind.width + 1)]
    grams = gram_hashes(values, kind.gram)
    assert (sliding_least(grams, kind.span)[windows] == np.repeat(m, length)).all() and (hits >= 1).all()


def test_words_have_one_hash_wherever_they_are():
    texts = [b"", b"one  two\tone", b"two", b"", b" ", b"\xc3\xa9 one\xc2\xa0two", b"two\n", b"x" * 3000 + b" one", b""]
    offsets = np.cumsum([0, *map(len, texts)])
    data = np.frombuffer(b"".join(texts), np.uint8)
    values, ends, begin, stop = windows.words_of(data, offsets)
    words = [w for t in texts for w in t.split()]
    assert [data[a:b].tobytes() for a, b in zip(begin, stop, strict=True)] == words
    assert ends.tolist() == np.cumsum([len(t.split()) for t in texts]).tolist()
    assert len(set(zip(words, values.tolist(), strict=True))) == len(set(words)) == len(set(values.tolist()))
    assert not len(windows.words_of(data[:0], np.array([0, 0]))[0])


@pytest.mark.parametrize("kind", [fmindex.KIND, suffixarray.KIND])
def test_a_shared_passage_is_no_hot_minimizer(table, kind):
    """A passage amid 300 different surroundings: no minimizer has slices that grow with their number."""
    rng = random.Random(8)
    own = lambda: " ".join(f"{rng.randrange(1 << 40):x}" for _ in range(60))
    passage = own()
    texts = [f"{own()} {passage} {own()}" for _ in range(300)]
    classes = np.frombuffer(windows._rarity(windows._keyed(table(list(enumerate(texts))), "doc_id", "text"), kind), np.uint8)
    most = {}
    for name, rarity in (("plain", None), ("rare", classes)):
        found: dict[int, set] = {}
        for text in texts:
            data = np.frombuffer(text.encode(), np.uint8)
            values, ends, first, last = windows.symbols(data, np.array([0, len(data)]), kind)
            for m, begin, length, _ in zip(*runs(values, ends, kind, rarity), strict=True):
                found.setdefault(int(m), set()).add(text.encode()[first[begin] : last[begin + length + kind.width - 2]])
        most[name] = max(map(len, found.values()))
    assert most["plain"] >= 200 and most["rare"] <= 20


def test_equal_rows_gather_as_much_as_two_of_them(table):
    """What is gathered for a row doesn't grow with the number of rows that equal it."""
    text = " ".join(f"w{i * 7 % 90}" for i in range(120))
    few, many = (windows.covered(table([(None, text)] * n + [(1, text)]), fmindex.KIND, fmindex.kernel).collect() for n in (2, 300))
    assert len(many) == 301 and {len(r.starts) for r in many} == {len(r.starts) for r in few}
    assert all(windows.spans(r.starts, r.ranges) == [(0, 120)] for r in many)


def test_hits_are_the_occurrences_in_a_run():
    rng = np.random.default_rng(9)
    values = rng.integers(0, 1 << 60, 900, np.uint64)
    values[100:400] = np.tile(values[:3], 100)
    values[600:700] = values[420:520]
    ends = np.array([20, 20, 54, 500, 530, 900])
    for kind in (fmindex.KIND, windows.Kind(words=False, width=60, gram=7)):
        grams = gram_hashes(values, kind.gram)
        m, begin, length, hits = runs(values, ends, kind)
        assert hits.tolist() == [int((grams[b : b + n + kind.span - 1] == x).sum()) for x, b, n in zip(m, begin, length, strict=True)]
        assert grams[100] == grams[103] != grams[101]


@pytest.mark.parametrize("kind", [fmindex.KIND, windows.Kind(words=False, width=60, gram=7)])
def test_promising_places_hold_every_repeated_window_and_little_else(kind):
    rng = np.random.default_rng(10)
    values = rng.integers(0, 1 << 60, 5000, np.uint64)
    values[3000 : 3000 + kind.width] = values[100 : 100 + kind.width]
    ends = np.array([30, 2000, 2010, 2900, 4400, 5000])
    place, stops = windows.promising(values, ends, np.array([1, 1, 1, 1, 1, 2]), kind)
    want = [*range(100, 100 + kind.width), *range(3000, 3000 + kind.width), *range(4400, 5000)]
    assert set(want) <= set(place.tolist()) and len(place) <= len(want) + 100 and (np.diff(place) > 0).all()
    inner = set(ends.tolist()) & set(place.tolist())
    assert all(int(np.searchsorted(place, e)) in stops for e in inner) and stops[-1] == len(place)


def _costly(kind, monkeypatch):
    """How many symbols of 200 slices with a short common part and one pair of copies are put in order."""
    rng, seen = random.Random(11), []
    word = lambda: f"{rng.randrange(1 << 40):x}"
    some = lambda n: " ".join(word() for _ in range(n))
    common, copy = some(14 if kind.words else 5), some(40)
    slices = [f"{some(15)} {common} {some(15)}".encode() for _ in range(200)] + [f"{copy} {some(3)}".encode(), f"{some(3)} {copy}".encode()]
    module, name = (fmindex, "FMIndex") if kind.words else (suffixarray, "bucket_ids")
    real = getattr(module, name)
    monkeypatch.setattr(module, name, lambda data, *a: seen.append(len(data)) or real(data, *a))
    found = module.kernel(slices, np.ones(len(slices), np.int64))
    texts = [list(x.split()) if kind.words else list(x) for x in slices]
    for ranges, gone in zip(found, brute(texts, kind.width), strict=True):
        held = np.zeros(len(gone), bool)
        for a, b in ranges:
            held[a:b] = True
        assert (held == gone).all()
    return sum(seen), sum(map(len, texts))


def test_words_that_cannot_be_repeated_are_not_indexed(monkeypatch):
    put, every = _costly(fmindex.KIND, monkeypatch)
    assert put < every / 20


def test_bytes_that_cannot_be_repeated_are_not_put_into_buckets(monkeypatch):
    put, every = _costly(suffixarray.KIND, monkeypatch)
    assert put < every / 20


def test_matches_are_not_searched_again_from_each_end(monkeypatch):
    """Strings that hold a long repeated one behind others: few steps of backward search."""
    steps, real = [], fmindex.FMIndex.extend
    monkeypatch.setattr(fmindex.FMIndex, "extend", lambda self, *a: steps.append(1) or real(self, *a))
    long, short = [f"a{i}" for i in range(52)], [f"b{i}" for i in range(4)]
    slices = [" ".join([*short[:2], *long]), " ".join([*short[2:], *long]), " ".join(short)]
    assert fmindex.kernel([x.encode() for x in slices], np.array([1, 1, 2])) == [[(2, 54)], [(2, 54)], []]
    assert len(steps) <= 54 + 2 * 36
