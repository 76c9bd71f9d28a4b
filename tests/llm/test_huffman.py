import itertools
import zlib

import numpy as np
import public_tokenizers
import pytest

from tamarack.llm import huffman

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("n", [1, 2, 127, 128, 129, 5000])
def test_round_trip(n):
    ids = np.minimum(np.random.default_rng(n).zipf(1.3, n), 49_000)
    lengths = huffman.code_lengths(np.bincount(ids))
    bits, marks = huffman.pack(ids, lengths, huffman.codes(lengths))
    assert huffman.unpack(bits, marks, n, huffman.decode_table(lengths)).tolist() == ids.tolist()


def test_lengths_are_the_best_under_the_limit():
    counts = np.array([1, 1, 2, 3, 50])
    best = min(sum(c * b for c, b in zip(counts, bits, strict=True)) for bits in itertools.product(range(1, 4), repeat=5) if sum(2.0**-b for b in bits) <= 1)
    lengths = huffman.code_lengths(counts, 3)
    assert lengths.max() <= 3 and int((counts * lengths).sum()) == best
    with pytest.raises(ValueError):
        huffman.code_lengths(np.ones(9, int), 3)
    assert huffman.code_lengths(np.array([0, 7])).tolist() == [0, 1]


def test_codes_are_canonical_and_free_of_prefixes():
    lengths = np.array([2, 0, 3, 1, 3], np.uint8)
    words = {f"{int(c):0{n}b}" for c, n in zip(huffman.codes(lengths), lengths, strict=True) if n}
    assert words == {"0", "10", "110", "111"}


def test_runs_like_whole_texts():
    from tokenizers import Tokenizer

    whole, words = Tokenizer.from_file(PATH), huffman.Words(PATH)
    texts = ["Hello, World! isn't THE end?", "", "  áb\n\tÉé ẛ̣ İX 12.5 ... <|endoftext|>x", "x" * 300 + "!!", "naïve café, naïve; ﬁn 中文 🙂."]
    for text, found in zip(texts, words.encode([t.encode() for t in texts], 2), strict=True):
        assert np.frombuffer(found, words.dtype).tolist() == [*whole.encode(text, add_special_tokens=False).ids, 2]


def test_files(spark, table, tmp_path, monkeypatch):
    monkeypatch.setattr(huffman, "BLOCK_IDS", 20)
    rows = [(5, "one two three " * 30), (3, None), (9, ""), (1, "Four, five."), (7, "six " * 9)]
    path = huffman.write_corpus(table(rows), PATH, 2, f"file://{tmp_path}/ids")
    found = {r.doc_id: r for r in huffman.checksums(huffman.read(spark, path)).collect()}
    from tokenizers import Tokenizer

    tokenizer, start = Tokenizer.from_file(PATH), 0
    for key, text in sorted(rows):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (found[key].start, found[key].n_tokens, found[key].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    empty = huffman.write_corpus(table(rows).limit(0), PATH, 2, f"file://{tmp_path}/none")
    assert huffman.checksums(huffman.read(spark, empty)).count() == 0


def test_many_texts_like_the_library():
    """Marks, cases, contractions, special tokens, scripts; the cache small enough to forget."""
    import random

    from tokenizers import Tokenizer

    whole, words = Tokenizer.from_file(PATH), huffman.Words(PATH)
    words.known.entries = 200
    rng = random.Random(4)
    parts = ["Word", "word", "WORD", "é", "É", "e\u0301", "\u0301", "ß", "İ", "Σ", "ς", "ΟΔΟΣ", "×", "ﬁ", "中文", "🙂", "12", ".5", ".", ",", "!?", "'s", "'S", "'", "'tis", "'LL", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "<", "|", "_", "-", "</w>", "\u00a0", "\u2028", "\x1c", "\x85", "\u0130x", " ", " ", " ", "\n", "\t"]
    parts += ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzäöüñçéèÀÉ", k=rng.randint(1, 9))) for _ in range(300)]
    for _ in range(40):
        texts = ["".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(20)]
        for text, found in zip(texts, words.encode([t.encode() for t in texts], 2), strict=True):
            assert np.frombuffer(found, words.dtype).tolist() == [*whole.encode(text, add_special_tokens=False).ids, 2], text
