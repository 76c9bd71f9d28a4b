"""Removal of repeated word sequences: a compressed FM-index per shard.

A shard's slices, as word numbers, form one text. Its Burrows-Wheeler transform is held as a
wavelet matrix of packed bits with counts per 64 of them, and a further bit a symbol tells which
suffixes are in slices that occur more than once; the suffixes' order itself isn't kept. Backward
search extends a match one word to the left per step, all slices side by side. While the interval
stands for two occurrences or more the match goes on, so the steps give the matching statistics of
each slice: the longest repeated string that ends at a place. Strings of WIDTH words or more are
reported.

Texts are dealt to the shards as :mod:`tamarack.llm.windows` describes. Every word covered by a
repeated window goes, and windows are judged on the input.

Defined results: null texts have no words; texts shorter than a window lose nothing; repeated rows
lose every window, since each row is the other's copy.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tamarack.llm.common import numbered
from tamarack.llm.minhash import mix
from tamarack.llm.windows import Kind, covered, promising, rows_of, spans

WIDTH, GRAM = 35, 12
KIND = Kind(words=True, width=WIDTH, gram=GRAM)
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


class Bits:
    """Packed bits with the number of ones before each 64 of them."""

    def __init__(self, bits: np.ndarray):
        self.words = np.frombuffer(np.packbits(bits, bitorder="little").tobytes().ljust((len(bits) // 64 + 1) * 8, b"\0"), np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1]])
        self.zeros = len(bits) - int(bits.sum())

    def ones(self, at: np.ndarray) -> np.ndarray:
        """How many ones are before each place."""
        word = at >> 6
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))


class FMIndex:
    """Of a text of numbers, 0 ends each string; suffixes are ordered by their first ``depth`` symbols.
    ``often``: of each symbol's place, whether what is there stands for several occurrences; none does by default."""

    def __init__(self, text: np.ndarray, depth: int, often: np.ndarray | None = None):
        n = len(text)
        often = np.zeros(n, bool) if often is None else often
        rank, known = text.astype(np.int64), 1
        while True:
            both = rank << 32
            both[: n - known] |= rank[known:] + 1
            order = np.argsort(both, kind="stable")
            ordered = both[order]
            change = np.zeros(n, np.int64)
            change[1:] = ordered[1:] != ordered[:-1]
            change = np.cumsum(change)
            rank[order] = change
            known *= 2
            if known >= depth or change[-1] == n - 1:
                break
        self.often = np.packbits(often[order], bitorder="little")
        last = text[order - 1]
        self.size, top = n, int(text.max())
        self.levels: list[tuple[int, Bits]] = []
        counts = np.bincount(last, minlength=top + 1)
        self.smaller = np.concatenate([[0], np.cumsum(counts)[:-1]])
        for level in range(max(1, top.bit_length()) - 1, -1, -1):
            bit = (last >> level) & 1
            self.levels.append((level, Bits(bit.astype(bool))))
            last = np.concatenate([last[bit == 0], last[bit == 1]])
        every = np.arange(top + 1)
        self.origin = self._down(every, np.zeros(top + 1, np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, bits in self.levels:
            ones = bits.ones(at)
            at = np.where((symbol >> level) & 1, bits.zeros + ones, at - ones)
        return at

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the strings with a symbol put before them."""
        at = self._down(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        shift = self.smaller[symbol] - self.origin[symbol]
        return at[: len(symbol)] + shift, at[len(symbol) :] + shift

    def recurs(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether the intervals stand for two occurrences or more."""
        one = np.minimum(low, self.size - 1)
        return (high - low > 1) | ((high - low == 1) & (self.often[one >> 3] >> (one & 7).astype(np.uint8) & 1 > 0))


def kernel(slices: list[bytes], weights: np.ndarray, width: int = WIDTH) -> list[list[tuple[int, int]]]:
    """The ranges that windows with two occurrences or more, by weight, cover in each slice."""
    size = np.fromiter((x.count(b" ") + 1 for x in slices), np.int64, len(slices))
    words = b" ".join(slices).split(b" ")
    number = dict(zip(dict.fromkeys(words), range(len(words)), strict=False))
    flat = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    out: list[list[tuple[int, int]]] = [[] for _ in slices]
    # what can't be repeated isn't indexed
    ends = np.cumsum(size)
    place, stops = promising(mix(flat.astype(np.uint64) + np.uint64(1)), ends, weights, Kind(words=True, width=width, gram=min(GRAM, width)))
    if not len(place):
        return out
    size = np.diff(stops, prepend=0)
    begin, flat = place[stops - size], flat[place]
    of = np.searchsorted(ends, begin, side="right")
    begin, weights = begin - np.append(0, ends[:-1])[of], weights[of]
    owner = np.repeat(np.arange(len(size)), size)
    # words with one occurrence end every match, so one number, 1, stands for them all
    seen = np.bincount(flat, weights[owner], len(number))
    renamed = np.ones(len(number), np.int64)
    renamed[seen > 1] = np.arange(2, 2 + int((seen > 1).sum()))
    starts = np.cumsum(size + 1) - size - 1
    text = np.zeros(int(size.sum()) + len(size), np.int64)
    text[np.arange(len(flat)) + owner] = renamed[flat]
    index = FMIndex(text, width, np.repeat(weights > 1, size + 1))
    lane = np.arange(len(size))
    end, at = size.copy(), size.copy()
    low, high = np.zeros(len(size), np.int64), np.full(len(size), index.size, np.int64)
    while len(lane):
        symbol = text[starts[lane] + at - 1]
        low2, high2 = index.extend(symbol, low, high)
        more = (symbol > 1) & index.recurs(low2, high2)
        at = np.where(more, at - 1, at)
        low, high = low2, high2
        ended = ~more | (at == 0)
        if ended.any():
            for i, a, b in zip(lane[ended].tolist(), at[ended].tolist(), end[ended].tolist(), strict=True):
                if b - a >= width:
                    out[of[i]].append((int(begin[i]) + a, int(begin[i]) + b))
            # a string that goes on to the slice's start holds all that are left; otherwise matches that
            # end earlier are looked for, behind the word of one occurrence if such a word was met, and
            # with the first window that isn't in the match if it holds windows
            single = ended & ~more & (symbol == 1)
            end = np.where(ended, np.where(at == 0, 0, np.where(single, at - 1, np.minimum(end, at + width) - 1)), end)
            at = np.where(ended, end, at)
            low, high = np.where(ended, 0, low), np.where(ended, index.size, high)
            keep = end >= width
            lane, end, at, low, high = lane[keep], end[keep], at[keep], low[keep], high[keep]
    return [[x for r in spans([0] * len(found), [list(r) for r in found]) for x in [r]] for found in out]


def _rows(docs: DataFrame, id_column: str, text_column: str, make, schema: str) -> DataFrame:
    def run(batches):
        for batch in rows_of(batches):
            rows = [make((text or "").encode(), spans(starts, ranges)) for text, starts, ranges in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pylist([{"doc_id": key} | row for key, row in zip(batch.column(0).to_pylist(), rows, strict=True)], schema=pa.schema([(name, {"long": pa.int64(), "binary": pa.binary()}[kind]) for name, kind in (x.split() for x in schema.split(", "))]))

    return covered(docs, KIND, kernel, id_column, text_column).mapInArrow(run, schema)


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept binary: the words left, one space between them."""

    def make(data: bytes, gone: list[tuple[int, int]]) -> dict:
        words = data.split()
        n, removed = len(words), sum(b - a for a, b in gone)
        for a, b in reversed(gone):
            del words[a:b]
        return {"n_words": n, "n_removed": removed, "kept": b" ".join(words)}

    return _rows(docs, id_column, text_column, make, "doc_id long, n_words long, n_removed long, kept binary")


def cut(data: bytes, gone: list[tuple[int, int]]) -> bytes:
    """The text as it was, but for the words of these ranges and the white space behind each."""
    at = [m.start() for m in _WORD.finditer(data)] + [len(data)]
    places = [0, *(at[x] for r in gone for x in r), len(data)]
    return b"".join(data[a:b] for a, b in zip(places[::2], places[1::2], strict=True))


def without_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", length_column: str = "n_chars") -> DataFrame:
    """``docs`` with all its rows and columns: repeated word sequences are cut out of the texts, and a
    length column tells the new lengths. Texts without any stay as they are, null too."""
    place = docs.columns.index(text_column)
    names = docs.columns
    counts = names.index(length_column) if length_column in names else -1

    def run(batches):
        for batch in rows_of(batches):
            texts = batch.column(1).to_pylist()
            columns = batch.column(4).flatten()
            lengths = columns[counts].to_pylist() if counts >= 0 else []
            for i, (starts, ranges) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                if starts:
                    texts[i] = cut(texts[i].encode(), spans(starts, ranges)).decode()
                    if counts >= 0:
                        lengths[i] = len(texts[i])
            columns[place] = pa.array(texts, columns[place].type)
            if counts >= 0:
                columns[counts] = pa.array(lengths, columns[counts].type)
            yield pa.RecordBatch.from_arrays(columns, plain)

    found, plain = covered(docs, KIND, kernel, id_column, text_column, rest=True), [f"_c{i}" for i in range(len(names))]
    return found.mapInArrow(run, numbered(docs).schema).toDF(*names)
