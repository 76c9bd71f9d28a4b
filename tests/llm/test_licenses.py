import random

import numpy as np

from tamarack.llm import licenses


def rows():
    rng = random.Random(13)
    words = ["the", "of", "and", "license", *("".join(rng.choices("abcdefgh", k=5)) for _ in range(300))]
    prose = lambda n: " ".join(rng.choices(words[:3] + words[4:], k=n))
    out = []
    for family, texts in licenses.TEMPLATES.items():
        for text in texts:
            out.append((len(out), f"{prose(30)}\n{text}\n{prose(20)}", family))
    return out + [(len(out) + i, prose(60), None) for i in range(60)], prose


def test_families(table):
    data, prose = rows()
    extra = [(900, None), (901, ""), (902, "\n\n"), (None, "All rights reserved."), (903, prose(5000)), (903, prose(5000))]
    found = licenses.scan(table([(k, t) for k, t, _ in data] + extra)).collect()
    by = {(r.doc_id, r.paragraph): r for r in found if r.family != licenses.UNKNOWN}
    want = {(k, 1): f for k, _, f in data if f} | {(None, 0): "Proprietary"}
    assert set(by) <= set(want)
    right = sum(k in by and by[k].family == f for k, f in want.items())
    assert right >= 0.95 * len(want)
    assert all(0 <= r.probability <= 1 and r.likeness >= 0.75 for r in by.values())


def test_empty(table):
    assert licenses.scan(table([(1, "x")]).limit(0)).count() == 0
    assert licenses.scan(table([(1, None), (2, "")])).count() == 0


def test_notices_amid_other_words(table):
    rng = random.Random(15)
    _, prose = rows()
    data = []
    for family, texts in licenses.TEMPLATES.items():
        for text in texts:
            for n in (20, 30, 40, 55):
                before = rng.randrange(n + 1)
                data.append((len(data), f"{prose(before)} {text} {prose(n - before)}", family))
    for text, family in (("Released under the MIT License.", "MIT"), ("Licensed under CC BY 4.0.", "CC-BY"), ("Licensed under the ISC License.", "ISC")):
        data += [(len(data) + i, f"{prose(20)} {text} {prose(20)}", family) for i in range(10)]
    clean = [(5000 + i, prose(20 + i)) for i in range(60)]
    found = {r.doc_id: r.family for r in licenses.scan(table([(k, t) for k, t, _ in data] + clean)).collect() if r.family != licenses.UNKNOWN}
    right = sum(found.get(k) == f for k, _, f in data)
    assert right >= 0.98 * len(data) and all(found.get(k) == f for k, _, f in data[-30:])
    assert not set(found) & {k for k, _ in clean}


def test_windows():
    rng = np.random.default_rng(16)
    model = licenses.train([rng.integers(0, 1 << 63, 30, np.uint64) for _ in range(20)])
    known = np.concatenate([w for ws in licenses.template_values().values() for w in ws])
    length = np.array([1, 11, 12, 13, 29, 30, 31, 60, 61, 89, 90, 91, 200])
    words = np.where(rng.random(length.sum()) < 0.5, known[np.arange(length.sum()) % len(known)], rng.integers(0, 1 << 63, length.sum(), np.uint64))
    end = np.cumsum(length)
    of, start, stop = licenses.windows(end - length, end)
    assert all((start >= (end - length)[of]) & (stop <= end[of]) & (start < stop))
    for k, n in enumerate(length.tolist()):
        mine = words[end[k] - n : end[k]]
        every = [words[a:b] for a, b in zip(start[of == k].tolist(), stop[of == k].tolist(), strict=True)]
        for size in (*licenses.SHORT, licenses.PIECE):
            step = size // 4 if size in licenses.SHORT else size // 2
            for a in range(n - (size - step) + 1):  # whatever is no longer than that is in a window as a whole
                assert any(len(w) <= max(size, 1) and mine[a : a + size - step].tobytes() in w.tobytes() for w in every)
    assert np.allclose(model.window_logits(words, start, stop), model.logits([words[a:b] for a, b in zip(start, stop, strict=True)]))


def test_several_licences_in_a_paragraph(table):
    _, prose = rows()
    texts = licenses.TEMPLATES
    data = [
        (f"{texts['MIT'][0]} {texts['Apache-2.0'][0]}", {"MIT", "Apache-2.0"}),
        (f"{prose(30)} {texts['GPL'][0]} {prose(8)} {texts['MPL-2.0'][0]} {prose(40)} {texts['CC-BY-NC'][1]} {prose(100)} All rights reserved.", {"GPL", "MPL-2.0", "CC-BY-NC", "Proprietary"}),
        (f"{texts['CC-BY'][0]} {prose(20)} {texts['CC-BY-SA'][0]}", {"CC-BY", "CC-BY-SA"}),
        (" ".join(f"{t[0]} {prose(25)}" for t in texts.values()), set(texts)),
        # one notice that two families' templates are like
        *((f"{prose(10)} {t} {prose(10)}", {f}) for f, ts in texts.items() for t in ts),
    ]
    found = {}
    for r in licenses.scan(table([(k, t) for k, (t, _) in enumerate(data)])).collect():
        found.setdefault(r.doc_id, []).append(r.family)
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(f) for k, (_, f) in enumerate(data)}
