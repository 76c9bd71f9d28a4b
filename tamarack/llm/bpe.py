"""Byte-level BPE encoding and decoding.

Pre-tokenisation looks up a class for every codepoint, turns each into a transition function on
the states of the splitting pattern and composes these by a blocked associative scan: every step
is one table look-up over whole arrays, and no regular expression is matched. The slices between
the boundaries found go through a bounded cache of merged pairs.

Defined results: a null text is treated as empty; an empty text has no ids and decodes to no
bytes; repeated rows give repeated results; columns other than the named ones are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tamarack.llm.common import pick, release, row_groups, text_bytes

#: Bytes of text that one array pass covers. When so many slices are new in a worker's cache, those
#: that haven't been asked for since the last time go.
CHUNK_BYTES = 1 << 21
CACHE_ENTRIES = 1 << 18
#: Slices of up to WIDE bytes are merged many at a time; longer ones singly and, beyond
#: CACHED_SLICE_BYTES, anew each time, so that the cache's memory has a bound.
WIDE, CACHED_SLICE_BYTES = 32, 64
NONE = 1 << 40

# Unicode's White_Space characters.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

# Letters and numbers that Unicode added after version 16, which the pattern's tables follow.
NEWER = [
    (0x0558, 0x0558), (0x058B, 0x058C), (0x088F, 0x088F), (0x0C5C, 0x0C5C), (0x0CDC, 0x0CDC), (0x208F, 0x208F), (0x209D, 0x209F),
    (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D),
    (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB),
    (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8),
    (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D1E), (0x18D1F, 0x18D20),
    (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6),
    (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6FE), (0x1E6FF, 0x1E6FF),
    (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
]

# Symbols that the scan reads. SPACE: U+0020 before a character that isn't white; LAST: another
# white character before one that isn't; WHITE: any other white character; SHORT and LONG: an
# apostrophe before a contraction of one or two letters; END: between texts.
LETTER, NUMBER, OTHER, SPACE, LAST, WHITE, SHORT, LONG, END = range(9)
# States, named for the token that is under way. FRESH: whatever follows begins a token; TAIL1 and
# TAIL2: so many letters of a contraction are still to come.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_SPACE, IN_WHITE, TAIL1, TAIL2 = range(8)


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """The next state, and whether a token begins at the symbol."""
    if state in (TAIL1, TAIL2) and symbol == LETTER:
        return (FRESH if state == TAIL1 else TAIL1), False
    if symbol in (SHORT, LONG) and state not in (IN_OTHERS, AFTER_SPACE):
        return (TAIL1 if symbol == SHORT else TAIL2), True
    runs = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, SHORT: IN_OTHERS, LONG: IN_OTHERS, WHITE: IN_WHITE}
    if symbol in runs:
        kept = (runs[symbol],) if symbol == WHITE else (runs[symbol], AFTER_SPACE)
        return runs[symbol], state not in kept
    return (AFTER_SPACE if symbol == SPACE else FRESH), True


@functools.cache
def _tables() -> tuple[bytes, bytes, bytes, bytes]:
    """Byte tables over the transition functions that symbols can compose to (function 0 is the
    identity): the symbols' own; products, by first * 16 + second; the state that a function leads
    to, by function * 8 + state; and where tokens begin, by state * 16 + symbol."""
    states = range(8)
    own = [tuple(_step(s, x)[0] for s in states) for x in range(9)]
    queue = list(dict.fromkeys([tuple(states), *own]))
    known = {f: i for i, f in enumerate(queue)}
    for f in queue:
        for g in own:
            if (h := tuple(g[x] for x in f)) not in known:
                known[h] = len(queue)
                queue.append(h)
    assert len(queue) <= 16
    product, leads, begins = bytearray(256), bytearray(256), bytearray(256)
    for i, f in enumerate(queue):
        for j, g in enumerate(queue):
            product[i * 16 + j] = known[tuple(g[x] for x in f)]
        for s in states:
            leads[i * 8 + s] = f[s]
    for s in states:
        for x in range(9):
            begins[s * 16 + x] = _step(s, x)[1]
    return bytes(known[f] for f in own).ljust(256, b"\0"), bytes(product), bytes(leads), bytes(begins)


def _mapped(values: np.ndarray, table: bytes) -> np.ndarray:
    return np.frombuffer(values.tobytes().translate(table), np.uint8)


@functools.cache
def _classes() -> np.ndarray:
    """LETTER, NUMBER, OTHER or WHITE for each codepoint, from the Unicode tables of the regex package,
    which are as new as the pattern's; texts themselves are split without it."""
    every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, name in ((LETTER, "L"), (NUMBER, "N")):
        out[np.frombuffer("".join(regex.findall(rf"\p{{{name}}}+", every)).encode("utf-32-le"), np.uint32)] = kind
    for first, last in NEWER:
        out[first : last + 1] = OTHER
    out[WHITE_SPACE] = WHITE
    return out


def states_after(functions: np.ndarray) -> np.ndarray:
    """The state behind each position when the scan begins FRESH; ``functions`` by number.

    Blocks of 64 positions are scanned side by side; their totals are scanned the same way, and
    the state that each block is entered in then settles the states within it."""
    _, product, leads, _ = _tables()
    n, block = len(functions), 64
    if n <= block:
        state, out = FRESH, np.empty(n, np.uint8)
        for i, f in enumerate(functions.tolist()):
            out[i] = state = leads[f * 8 + state]
        return out
    rows = -(-n // block)
    laid = np.zeros(rows * block, np.uint8)
    laid[:n] = functions
    laid = np.ascontiguousarray(laid.reshape(rows, block).T)
    for j in range(1, block):
        laid[j] = _mapped((laid[j - 1] << 4) | laid[j], product)
    entry = np.zeros(rows, np.uint8)
    entry[1:] = states_after(laid[-1])[:-1]
    return _mapped((laid << 3) | entry, leads).reshape(block, rows).T.reshape(-1)[:n]


def boundaries(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' bytes end to end, where each token begins and ends in them, and how many
    tokens each text has."""
    joined = "\0".join(texts) + "\0"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
    symbols = _classes()[points]
    symbols[ends] = END
    white = symbols == WHITE
    firm = np.flatnonzero(white[:-1] & (symbols[1:] <= OTHER))
    symbols[firm] = np.where(points[firm] == 0x20, SPACE, LAST)
    marks = np.flatnonzero(points == 0x27)
    if len(marks):
        padded = np.append(points, [0, 0])
        a, b = padded[marks + 1], padded[marks + 2]
        inside = symbols[np.minimum(marks + 1, len(symbols) - 1)] != END
        short = np.isin(a, [ord(c) for c in "stmd"]) & inside
        long = (((a == ord("r")) | (a == ord("v"))) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        long &= inside & (symbols[np.minimum(marks + 2, len(symbols) - 1)] != END)
        symbols[marks[short]] = SHORT
        symbols[marks[long]] = LONG
    own, _, _, begins = _tables()
    before = np.zeros(len(symbols), np.uint8)
    before[1:] = states_after(_mapped(symbols, own))[:-1]
    starts = _mapped((before << 4) | symbols, begins).astype(bool)
    starts[ends] = False
    at = np.flatnonzero(starts)
    data = joined.encode("utf-8", "surrogatepass")
    stop = np.flatnonzero(starts | (symbols == END))
    stop = stop[np.searchsorted(stop, at, side="right")]
    counts = np.diff(np.searchsorted(at, ends), prepend=0)
    if len(data) != len(points):
        width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        place = np.cumsum(width) - width
        at, stop = place[at], place[stop]
    return data, at, stop, counts


class Vocabulary:
    """Ranks of byte strings, read from a file of base64 strings and numbers."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for piece, rank in self.ranks.items():
            self.bytes_of[rank] = piece
        self.widths = np.fromiter(map(len, self.bytes_of), np.int64, len(self.bytes_of))
        self.held = Strings(self.bytes_of)
        self.digits = Strings([b"%d," % i for i in range(len(self.bytes_of))])
        self.of_byte = np.array([self.ranks[bytes([i])] for i in range(256)])
        self.pairs = Pairs(self.ranks)
        self.cache, self.older = _Merged(self), {}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Lowest rank first, the leftmost of equals, from a heap over linked parts."""
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return (whole,)
        n = len(piece)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        end = list(range(1, n + 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = after[i] if end[i] else n
            if not end[i] or j >= n or end[j] != stop:
                continue  # one of the two parts has been merged meanwhile
            end[i], end[j] = stop, 0
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get(piece[i : end[k]])) is not None:
                    heapq.heappush(heap, (r, i, end[k]))
            if (h := before[i]) >= 0 and (r := ranks.get(piece[h:stop])) is not None:
                heapq.heappush(heap, (r, h, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = after[i]
        return tuple(out)

    def learn(self, pieces: list[bytes]) -> None:
        """Merge the pieces of up to WIDE bytes together, a merge of each in every round, and
        put them into the cache."""
        if len(self.cache) + len(pieces) > CACHE_ENTRIES:
            self.older = dict(self.cache)
            self.cache.clear()
        again = {x: ids for x in pieces if (ids := self.older.get(x)) is not None}
        self.cache.update(again)
        pieces = sorted((x for x in pieces if len(x) <= WIDE and x not in again), key=len)
        for a in range(0, len(pieces), 2048):
            part = pieces[a : a + 2048]
            for piece, ids in zip(part, self._merged(part), strict=True):
                self.cache[piece] = ids

    def _merged(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        n, wide = len(pieces), len(pieces[-1]) + 1
        width = np.fromiter(map(len, pieces), np.int64, n)
        held = np.arange(wide) < width[:, None]
        ids = np.full((n, wide), -1, np.int64)
        ids[held] = self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
        ranks = np.full((n, wide), NONE, np.int64)
        ranks[:, :-1] = self.pairs.find(ids[:, :-1], ids[:, 1:])
        places = np.arange(wide)
        out: list = [None] * n
        live = np.arange(n)
        while len(live):
            at = ranks.argmin(1)
            row = np.arange(len(live))
            best = ranks[row, at]
            if (done := best == NONE).any():
                for i, line in zip(live[done].tolist(), ids[done].tolist(), strict=True):
                    out[i] = tuple(line[: line.index(-1)])
                ids, ranks, live, at, best = ids[~done], ranks[~done], live[~done], at[~done], best[~done]
                row = np.arange(len(live))
                if not len(live):
                    break
            moved = np.minimum(places + (places > at[:, None]), wide - 1)
            ids[row, at] = best
            ids, ranks = np.take_along_axis(ids, moved, 1), np.take_along_axis(ranks, moved, 1)
            ranks[row, at] = self.pairs.find(best, ids[row, at + 1])
            inner = at > 0
            ranks[row[inner], at[inner] - 1] = self.pairs.find(ids[row[inner], at[inner] - 1], best[inner])
        return out

    def slices(self, texts: list[str]) -> tuple[list[tuple[int, ...]], np.ndarray, np.ndarray]:
        """The ids of each distinct slice of the texts, the number of every slice among those, and how
        many slices each text has.

        Slices are told apart by 64-bit hashes. Should two that differ share one, the texts put
        together from the slices differ from the texts, and the slices are compared instead."""
        data, starts, ends, counts = boundaries(texts)
        if not len(starts):
            return [], np.zeros(0, np.int64), counts
        _, first, place = np.unique(_hashes(data, starts, ends), return_index=True, return_inverse=True)
        found = [data[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        if b"".join([found[i] for i in place.tolist()]) != "".join(texts).encode("utf-8", "surrogatepass"):
            every = [data[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            number = {x: i for i, x in enumerate(dict.fromkeys(every))}
            found, place = list(number), np.array([number[x] for x in every], np.int64)
        known = list(map(self.cache.get, found))
        if None in known:
            self.learn([x for x, ids in zip(found, known, strict=True) if ids is None])
            known = [self.cache[x] if ids is None else ids for x, ids in zip(found, known, strict=True)]
        return known, place, counts

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all texts end to end, where in its text's bytes each begins, and the len + 1 places
        where the texts' ids begin."""
        known, place, counts = self.slices(texts)
        n = np.fromiter(map(len, known), np.int64, len(known))
        ids = np.fromiter(chain.from_iterable(known), np.int64, int(n.sum()))[ragged((np.cumsum(n) - n)[place], n[place])]
        at = np.concatenate([[0], np.cumsum(n[place])])[np.concatenate([[0], np.cumsum(counts)])]
        behind = np.concatenate([[0], np.cumsum(self.widths[ids])])
        return ids, behind[:-1] - np.repeat(behind[at[:-1]], np.diff(at)), at

    def encode(self, texts: list[str]) -> list[list[int]]:
        ids, _, at = self.encode_all(texts)
        return [x.tolist() for x in np.split(ids, at[1:-1])]

    def decode(self, ids) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])


def ragged(starts: np.ndarray, width: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each stretch, end to end."""
    return np.arange(int(width.sum())) + np.repeat(starts - (np.cumsum(width) - width), width)


class Strings:
    """Byte strings by number."""

    def __init__(self, strings: list[bytes]):
        self.width = np.fromiter(map(len, strings), np.int64, len(strings))
        self.at, self.data = np.cumsum(self.width) - self.width, np.frombuffer(b"".join(strings), np.uint8)

    def joined(self, numbers: np.ndarray, at: np.ndarray) -> tuple[memoryview, list[int]]:
        """The strings of the numbers end to end, and where those of each group begin that begins ``at``."""
        width = self.width[numbers]
        places = np.concatenate([[0], np.cumsum(width)])[at]
        return memoryview(self.data[ragged(self.at[numbers], width)]), places.tolist()


def _hashes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each slice: of its bytes by place, and of its length."""
    width = ends - starts
    held = np.frombuffer(data, np.uint8)
    ragged = np.arange(int(width.sum())) - np.repeat(np.cumsum(width) - width, width)
    values = _BYTE[held[np.repeat(starts, width) + ragged]] * _place(int(width.max()))[ragged]
    return np.add.reduceat(values, np.cumsum(width) - width) + width.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)


_BYTE = np.random.default_rng(11).integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)


def _place(n: int) -> np.ndarray:
    return np.cumprod(np.full(n, 0xD1342543DE82EF95, np.uint64))


class Pairs:
    """Open-addressed table from two neighbouring ids to the id that they merge to, or NONE."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = {(ranks[t[:i]], ranks[t[i:]]): r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        self.bits = max(10, (4 * len(pairs)).bit_length())
        self.keys, self.ids = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int64)
        both = np.array(list(pairs), np.int64).reshape(-1, 2)
        left, merged, self.far = (both[:, 0] << 32) | both[:, 1], np.array(list(pairs.values()), np.int64), 0
        while len(left):
            slot = (self._home(left) + self.far) & ((1 << self.bits) - 1)
            free = np.flatnonzero(self.keys[slot] < 0)
            self.keys[slot[free]] = left[free]
            placed = self.keys[slot] == left
            self.ids[slot[placed]] = merged[placed]
            left, merged, self.far = left[~placed], merged[~placed], self.far + 1

    def _home(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a << 32) | b
        home = self._home(key)
        out = np.full(key.shape, NONE, np.int64)
        out = np.where(self.keys[home] == key, self.ids[home], out)
        for far in range(1, self.far):
            slot = (home + far) & ((1 << self.bits) - 1)
            out = np.where(self.keys[slot] == key, self.ids[slot], out)
        return np.where(b < 0, NONE, np.where(a < 0, NONE, out))


class _Merged(dict):
    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary

    def __missing__(self, piece: bytes) -> tuple[int, ...]:
        ids = self.vocabulary.merge(piece)
        if len(piece) <= CACHED_SLICE_BYTES:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[piece] = ids
        return ids


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    """One for each Python worker; the file's size bounds it."""
    return Vocabulary(path)


def _parts(column: pa.Array):
    """Runs of rows of about CHUNK_BYTES: the first row's number, and the texts."""
    _, offsets = text_bytes(column)
    for a, b in row_groups(offsets, CHUNK_BYTES):
        yield a, [x or "" for x in column.slice(a, b - a).to_pylist()]


def encode(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, ids array<int>, offsets array<int>: where each id's bytes begin in the UTF-8 text."""

    def run(batches):
        words = vocabulary(path)
        for batch in batches:
            keys, column = batch.column(0), batch.column(1)
            for first, texts in _parts(column):
                ids, offsets, at = words.encode_all(texts)
                yield pa.RecordBatch.from_arrays([keys.slice(first, len(texts)), _lists(ids, at), _lists(offsets, at)], ["doc_id", "ids", "offsets"])

    source = pick(docs, doc_id=id_column, text=text_column)
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, ids array<int>, offsets array<int>")


def decode(tokens: DataFrame, path: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """doc_id, bytes binary: what the ids stand for; null ids are no ids."""

    def run(batches):
        words = vocabulary(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([words.decode(x or ()) for x in batch.column(1).to_pylist()], pa.binary())], ["doc_id", "bytes"])

    source = pick(tokens, doc_id=id_column, ids=ids_column)
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, bytes binary")


def _lists(values: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values.astype(np.int32)))


def round_trip(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, offsets_crc32: digests of the ids, of the bytes that
    decoding the ids gives, and of where each id's bytes begin (little-endian 32-bit numbers), made where
    the ids are, so that these need not leave the worker; ``with_ids``: ids and offsets as well."""

    def run(batches):
        words = vocabulary(path)
        for batch in batches:
            for first, texts in _parts(batch.column(1)):
                ids, offsets, at = words.encode_all(texts)
                decoded, places = words.held.joined(ids, at)
                digits, commas = words.digits.joined(ids, at)
                marks = memoryview(offsets.astype("<i4")).cast("B")
                places, ends = list(zip(places, places[1:], strict=False)), at.tolist()
                columns = [
                    batch.column(0).slice(first, len(texts)),
                    pa.array(np.diff(at)),
                    pa.array([hashlib.sha256(digits[a : b - 1] if b > a else b"").hexdigest() for a, b in zip(commas, commas[1:], strict=False)], pa.string()),
                    pa.array([hashlib.sha256(decoded[a:b]).hexdigest() for a, b in places], pa.string()),
                    pa.array([zlib.crc32(marks[4 * a : 4 * b]) for a, b in zip(ends, ends[1:], strict=False)], pa.int64()),
                    *([_lists(ids, at), _lists(offsets, at)] if with_ids else []),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "offsets_crc32", *(["ids", "offsets"] if with_ids else [])])
        release()

    source = pick(docs, doc_id=id_column, text=text_column)
    more = ", ids array<int>, offsets array<int>" if with_ids else ""
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string, offsets_crc32 long{more}")
