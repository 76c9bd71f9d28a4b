import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tamarack.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def words():
    return bpe.vocabulary(PATH)


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_classes_are_those_of_the_pattern():
    every = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    text, singles = "".join(map(chr, every)), {bytes([i]): i for i in range(256)}
    for name, kind in (("L", bpe.LETTER), ("N", bpe.NUMBER)):
        e = tiktoken.Encoding(name, pat_str=rf"\p{{{name}}}", mergeable_ranks=singles, special_tokens={})
        assert set(map(ord, bytes(e.encode_ordinary(text)).decode())) == set(np.flatnonzero(bpe._classes() == kind).tolist())


def test_random_texts_like_the_library(words, library):
    rng = random.Random(3)
    parts = ["a", "b", "'", "'s", "'re", "'ll", "'t", "s", "t", "r", "e", "l", "v", " ", "  ", "\n", "\t", "1", "é", "中", "🙂", "　", "!", "́", "½", "\x00", "\x85", "​", "\U0010ffff"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 60))) for _ in range(3000)]
    texts += ["".join(chr(rng.choice([rng.randint(0, 0x2FF), rng.randint(0, 0xD7FF), rng.randint(0xE000, 0x1FFFF)])) for _ in range(40)) for _ in range(500)]
    texts += ["", "x" * 5000, "'" * 300, " " * 999, "ab " * 4000]
    for a in range(0, len(texts), 250):
        part = texts[a : a + 250]
        assert words.encode(part) == [library.encode_ordinary(t) for t in part]


def test_slices_that_share_a_hash(words, library, monkeypatch):
    monkeypatch.setattr(bpe, "_hashes", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    assert words.encode(["one two three", "four"]) == [library.encode_ordinary("one two three"), library.encode_ordinary("four")]


def test_scan_is_associative():
    own = np.frombuffer(bpe._tables()[0], np.uint8)[:9]
    symbols = np.random.default_rng(0).integers(0, 9, 100_000)
    state, want = bpe.FRESH, []
    for x in symbols.tolist():
        state = bpe._step(state, x)[0]
        want.append(state)
    assert bpe.states_after(own[symbols]).tolist() == want


def test_frames(table, words):
    docs = table([(1, "It's 12 o'clock."), (2, ""), (3, None), (None, "x"), (1, "It's 12 o'clock.")])
    tokens = bpe.encode(docs, PATH)
    for row in tokens.collect():
        ends = [*row.offsets[1:], None]
        text = words.decode(row.ids)
        assert [text[a:b] for a, b in zip(row.offsets, ends, strict=False)] == [words.bytes_of[i] for i in row.ids]
    assert sorted(bytes(r.bytes) for r in bpe.decode(tokens, PATH).collect()) == [b"", b"", b"It's 12 o'clock.", b"It's 12 o'clock.", b"x"]
    trip = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(docs, PATH).collect()}
    ids = words.encode(["It's 12 o'clock."])[0]
    digest = lambda b: hashlib.sha256(b).hexdigest()
    assert (1, len(ids), digest(",".join(map(str, ids)).encode()), digest(b"It's 12 o'clock.")) in trip
    assert (3, 0, digest(b""), digest(b"")) in trip and len(trip) == 4
    assert bpe.round_trip(docs.limit(0), PATH).count() == 0
