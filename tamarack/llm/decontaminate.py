"""Benchmark decontamination: CGK embedding, bit-sampling LSH and exact edit verification, on words.

Items of PART words or more are looked for as wholes and in all their parts of PART words or more.
Wherever such a part occurs with a quarter of its words in edits, at least two of its three-word
runs are left, not far from each other; the text around any two such runs is aligned with all parts
at once, so that none is missed.

Of shorter items, a window of a document, as long as the item, is a candidate where it shares a run of a few
words with the item in the same place; every window within a quarter of the item's words in edits
has such a run. A CGK random walk maps item and window to sequences whose Hamming distance follows
their edit distance: the walk writes the word it stands on and steps on by a random bit of the word.
Windows that agree with the item in all sampled positions of some repetition go on to the edit
distance proper. How often items with as many edits as may be agree is measured, the worst of them
counts, and of up to SAMPLE positions a repetition as many are taken as reach RECALL in
MOST_REPETITIONS; where even one position doesn't, every candidate goes on. Items of fewer than
FEWEST words are looked for without edits.

Words are compared without ASCII punctuation, and without regard to case in A-Z and Latin-1. Items are
sent to the executors in blocks of BLOCK_WORDS words at most.

Defined results: null and empty texts hold nothing, and items without words occur nowhere; null ids
of items are passed over; repeated rows are reported as often as they occur; an empty benchmark or
corpus gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.llm.common import passed_through, pick, row_groups, text_bytes
from tamarack.llm.minhash import LOWER, mix

#: Edits per word of the item, the fewest words of an item that may have any, the least words of a part of one.
EDITS, FEWEST, PART = 0.25, 5, 13
WALKS, SAMPLE, RECALL, MOST_REPETITIONS, SEED = 4, 3, 0.99, 512, 17
BLOCK_WORDS, CHUNK_BYTES, FILTER_BITS, LANES, STRETCH = 1 << 20, 1 << 21, 22, 4096, 4096
_SPACE, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_MARK[[c for c in range(0x21, 0x7F) if not chr(c).isalnum()]] = True
_LOWER = np.frombuffer(LOWER, np.uint8)
_BYTE = np.random.default_rng(31).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


def word_values(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts end to end: a hash of each word, where each text's words end, and where each word begins.

    A hash is that of the word's bytes but for ASCII punctuation, A-Z and the capitals of Latin-1 as
    small letters. All words are hashed together: bytes by their places in the word, summed up."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64), np.zeros(0, np.int64)
    low, space = _LOWER[data], _SPACE[data]
    latin = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    low[1:][latin] += 0x20
    begins = ~space
    begins[1:] &= space[:-1]
    firsts = offsets[:-1][offsets[:-1] < len(data)]
    begins[firsts] = ~space[firsts]
    number = np.cumsum(begins)
    ends = np.concatenate([[0], number])[offsets[1:]]
    n = int(number[-1])
    at = np.flatnonzero(~(space | _MARK[data]))
    word = number[at] - 1
    size = np.bincount(word, minlength=n)
    start = np.cumsum(size) - size
    place = np.cumprod(np.full(int(size.max()) if n else 0, 0xD1342543DE82EF95, np.uint64))
    out = np.zeros(n, np.uint64)
    if len(at):
        full = np.flatnonzero(size)
        out[full] = np.add.reduceat(_BYTE[low[at]] * place[np.arange(len(at)) - start[word]], start[full])
    return mix(out + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), ends, np.flatnonzero(begins)


def values(text: bytes) -> np.ndarray:
    return word_values(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0]


def allowed(length):
    length = np.asarray(length)
    return np.where(length < FEWEST, 0, np.floor(length * EDITS)).astype(np.int64)


def edit_distance(item: np.ndarray, stretch: np.ndarray) -> tuple[int, int]:
    """The least number of edits that turns the item into a substring of the stretch, and where the
    substring ends."""
    at = np.arange(len(stretch) + 1)
    row = np.zeros(len(stretch) + 1, np.int64)
    for k, word in enumerate(item.tolist(), 1):
        after = row + 1
        after[1:] = np.minimum(after[1:], row[:-1] + (stretch != np.uint64(word)))
        after[0] = k
        row = np.minimum.accumulate(after - at) + at
    end = int(row.argmin())
    return int(row[end]), end


def closest_part(item: np.ndarray, stretch: np.ndarray) -> tuple[int, int, int] | None:
    """Edits, words and end in the stretch of the whole item, if that occurs with as many edits as may
    be, or else of the part of PART words or more that occurs with the least edits per word, the
    longest of those; None if no part occurs. All parts that begin anywhere are aligned side by side."""
    n = len(item)
    other = item[:, None] != stretch[None, :]
    at = np.arange(len(stretch) + 1, dtype=np.int32)
    rows = np.zeros((n - PART + 1, len(stretch) + 1), np.int32)
    best = rank = None
    for k in range(1, n + 1):
        rows = rows[: n - k + 1]
        after = rows + 1
        np.minimum(after[:, 1:], rows[:, :-1] + other[k - 1 : k - 1 + len(rows)], out=after[:, 1:])
        rows = np.minimum.accumulate(after - at, axis=1) + at
        if k >= PART:
            edits = rows.min(1)
            s = int(edits.argmin())
            e = int(edits[s])
            if e <= k * EDITS and (k == n or best is None or (e / k, -k) < rank):
                best, rank = (e, k, int(rows[s].argmin())), (e / k, -k)
    return best


class Patterns:
    """Items, the runs of words that point to them, and the embeddings of those shorter than PART."""

    def __init__(self, items: list[tuple[int, bytes]]):
        self.item, words = [], []
        for item, text in items:
            v = values(text)
            if not len(v):
                continue
            self.item.append(item)
            words.append(v)
        self.words = words
        self.length = np.array([len(w) for w in words], np.int64)
        self.seeds = {q: self._seeds(q) for q in (1, 2, 3)}
        self.sorted = [np.unique(w) for w in words]
        short = np.flatnonzero(self.length < PART)
        if len(short):
            rng = np.random.default_rng(SEED)
            size = np.where(self.length < PART, self.length, 0)
            steps = 3 * int(size.max())
            self.walks = rng.integers(0, 1 << 63, (WALKS, steps), np.uint64)
            flat = np.concatenate(words)
            starts = np.cumsum(self.length) - self.length
            self.embedded = np.stack([embed(flat, starts, starts + size, size, w) for w in self.walks], 1)
            # how long each item's walks are: behind the end there is nothing to tell items by
            self.reach = np.maximum((self.embedded != 0).sum(2), 1)
            n, positions = self._repetitions(rng, short)
            self.samples = (rng.random((n, positions)), np.arange(n) % WALKS) if n else None

    def _seeds(self, q: int):
        """Hashes of q-word runs of the patterns that need runs of q words, each with its pattern and offset."""
        k = allowed(self.length)
        own = np.clip(self.length // (k + 1), 1, 3)
        rows = [(h, p, o) for p in np.flatnonzero(own == q).tolist() for o, h in enumerate(grams(self.words[p], q).tolist())]
        keys = np.array([r[0] for r in rows], np.uint64)
        order = np.argsort(keys, kind="stable")
        held = np.zeros(1 << FILTER_BITS, bool)
        held[(keys & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)] = True
        return keys[order], np.array([r[1] for r in rows], np.int64)[order], np.array([r[2] for r in rows], np.int64)[order], held

    def _repetitions(self, rng, short: np.ndarray) -> tuple[int, int]:
        """How many repetitions of how many positions, so that short items with as many edits as may be are
        met with probability RECALL; none where that takes too many."""
        chosen = rng.choice(short, min(len(short), 64), replace=False)
        edited = []
        for p in chosen.tolist():
            w = self.words[p].tolist()
            for _ in range(int(allowed(len(w)))):
                at, kind = int(rng.integers(len(w))), int(rng.integers(3))
                if kind == 0:
                    w[at] = int(rng.integers(1 << 62))
                elif kind == 1:
                    w.insert(at, int(rng.integers(1 << 62)))
                elif len(w) > 1:
                    del w[at]
            edited.append(np.array(w, np.uint64))
        flat = np.concatenate(edited)
        size = np.array([len(w) for w in edited])
        starts = np.cumsum(size) - size
        agree = []
        for w, walk in enumerate(self.walks):
            mine = embed(flat, starts, starts + size, self.length[chosen], walk)
            for row, p in enumerate(chosen.tolist()):
                n = int(self.reach[p, w])
                agree.append(float((mine[row, :n] == self.embedded[p, w, :n]).mean()))
        for positions in range(SAMPLE, 0, -1):
            p = min(agree) ** positions
            if 0 < p and (n := max(16, int(np.ceil(np.log(1 - RECALL) / np.log1p(-min(p, 0.999)))))) <= MOST_REPETITIONS:
                return n, positions
        return 0, 0

    def find(self, text: np.ndarray, ends: np.ndarray):
        """(text's number, pattern, edits, words looked for, first word) for patterns that occur in the texts."""
        row = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
        first = np.concatenate([[0], ends[:-1]])
        found = []
        for q, (keys, pattern, offset, held) in self.seeds.items():
            g = grams(text, q)
            if not len(g) or not len(keys):
                continue
            at = np.flatnonzero(held[(g & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)])
            at = at[row[at] == row[at + q - 1]]
            low, high = np.searchsorted(keys, g[at], "left"), np.searchsorted(keys, g[at], "right")
            n = high - low
            place = np.repeat(low, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            whole, at = self.length[pattern[place]] < PART, np.repeat(at, n)
            found.append(np.stack([pattern[place], at - offset[place], row[at]], 1)[whole])
            if not whole.all():
                yield from self._parts(text, pattern[place][~whole], at[~whole], row[at][~whole], first, ends)
        if not sum(map(len, found)):
            return
        windows = np.unique(np.concatenate(found), axis=0)
        near = [windows[:0]]
        for a in range(0, len(windows), LANES):
            p, begin, doc = windows[a : a + LANES].T
            near.append(windows[a : a + LANES][self._met(text, p, begin, first[doc], ends[doc])])
        # windows of one item in one text whose surroundings overlap are aligned together
        p, begin, doc = np.concatenate(near).T
        most = allowed(self.length)[p]
        low, high = np.maximum(begin - most, first[doc]), np.minimum(begin + self.length[p] + most, ends[doc])
        order = np.lexsort((low, p, doc))
        best: dict[tuple[int, int], tuple[int, int]] = {}
        k = 0
        while k < len(order):
            i = order[k]
            d, q, start, stop = int(doc[i]), int(p[i]), int(low[i]), int(high[i])
            while k < len(order) and doc[order[k]] == d and p[order[k]] == q and low[order[k]] <= stop:
                stop = max(stop, int(high[order[k]]))
                k += 1
            edits, end = edit_distance(self.words[q], text[start:stop])
            if edits <= allowed(self.length[q]) and ((d, q) not in best or edits < best[d, q][0]):
                best[d, q] = (edits, max(start + end - int(self.length[q]), int(first[d])) - int(first[d]))
        for (d, q), (edits, at) in sorted(best.items()):
            yield d, q, edits, int(self.length[q]), at

    def _parts(self, text, pattern, at, doc, first, ends):
        """As find() has it, of the items of PART words or more and of their parts, from the places of
        their three-word runs.

        A part of m words with m // 4 edits keeps at least m - 2 - 3 * (m // 4) >= 2 of its runs and
        m - m // 4 >= 10 of its words, and covers no more of the text than the item's words and a quarter."""
        order = np.lexsort((at, pattern, doc))
        pattern, at, doc = pattern[order], at[order], doc[order]
        reach = self.length[pattern] + allowed(self.length[pattern])
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(doc) != 0) | (np.diff(pattern) != 0) | (np.diff(at) > reach[1:])
        cut = np.flatnonzero(new)
        last = np.append(cut[1:], len(at)) - 1
        best: dict[tuple[int, int], tuple] = {}
        for i, j in zip(cut.tolist(), last.tolist(), strict=True):
            d, q, far = int(doc[i]), int(pattern[i]), int(reach[i])
            if at[i] == at[j]:
                continue
            item, stop = self.words[q], min(int(at[j]) + far, int(ends[d]))
            for a in range(max(int(at[i]) + 3 - far, int(first[d])), stop, STRETCH):
                stretch = text[a : min(a + STRETCH + far, stop)]
                known = self.sorted[q]
                same = known[np.minimum(np.searchsorted(known, stretch), len(known) - 1)] == stretch
                if same.sum() < PART - allowed(PART) or (part := closest_part(item, stretch)) is None:
                    continue
                edits, n, end = part
                rank = (n < len(item), edits / n, -n)
                if (d, q) not in best or rank < best[d, q][0]:
                    best[d, q] = (rank, edits, n, max(a + end - n, int(first[d])) - int(first[d]))
        for (d, q), (_, edits, n, start) in sorted(best.items()):
            yield d, q, edits, n, start

    def _met(self, text, pattern, begin, low, high) -> np.ndarray:
        """Whether item and window agree in all positions of some repetition."""
        length = self.length[pattern]
        start, stop = np.maximum(begin, low), np.minimum(begin + length, high)
        if self.samples is None:
            return np.ones(len(pattern), bool)
        where, walk_of = self.samples
        met = np.zeros(len(pattern), bool)
        for w, walk in enumerate(self.walks):
            same = embed(text, start, stop, length, walk) == self.embedded[pattern, w][:, : 3 * int(length.max())] if len(pattern) else np.zeros((0, 1), bool)
            for sample in where[walk_of == w]:
                at = (sample * self.reach[pattern, w][:, None]).astype(np.int64)
                met |= np.take_along_axis(same, at, 1).all(1)
        return met


def grams(words: np.ndarray, q: int) -> np.ndarray:
    n = len(words) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, q, np.uint64)
    for i in range(q):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[i : n + i]
    return mix(out)


def embed(words: np.ndarray, start: np.ndarray, stop: np.ndarray, length: np.ndarray, walk: np.ndarray) -> np.ndarray:
    """The CGK embeddings of words[start:stop], three times the longest ``length`` wide; 0 behind the end."""
    steps = 3 * int(length.max()) if len(length) else 0
    out = np.zeros((len(start), steps), np.uint64)
    at = start.copy()
    last = max(len(words) - 1, 0)
    for j in range(steps):
        inside = at < stop
        here = np.where(inside, words[np.minimum(at, last)], 0).astype(np.uint64)
        out[:, j] = here
        at = at + np.where(inside, ((here ^ walk[j]) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(63)).astype(np.int64), 0)
    return out


def _blocks(benchmark: DataFrame, item_column: str, item_text_column: str):
    """The patterns of BLOCK_WORDS words of items or so at a time."""
    items = pick(benchmark, item_id=item_column, text=item_text_column).where(F.col("item_id").isNotNull() & F.col("text").isNotNull())
    size = items.agg(F.sum(F.size(F.split("text", r"\s+"))).alias("n")).first().n or 0
    blocks = max(1, -(-size // BLOCK_WORDS))
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()
        yield benchmark.sparkSession.sparkContext.broadcast(Patterns([(r.item_id, r.text.encode()) for r in part]))


def without_matches(docs: DataFrame, benchmark: DataFrame, text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no item and no part of one."""
    place = docs.columns.index(text_column)
    for kept in _blocks(benchmark, item_column, item_text_column):

        def run(batches, kept=kept):
            for batch in batches:
                data, offsets = text_bytes(batch.column(place))
                clean = np.ones(batch.num_rows, bool)
                for a, b in row_groups(offsets, CHUNK_BYTES) if kept.value.words else ():
                    words, ends, _ = word_values(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                    for row, *_ in kept.value.find(words, ends):
                        clean[a + row] = False
                yield batch.filter(pa.array(clean))

        docs = passed_through(docs, run)
    return docs


def matches(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text") -> DataFrame:
    """doc_id, item_id, edits, n_words, start: of each item in each document that holds it, or a part
    of it, the closest occurrence, of the whole item if that occurs: its edits, the words looked for,
    and the word it starts at."""
    source = pick(docs, doc_id=id_column, text=text_column).withColumn("doc_id", F.col("doc_id").cast("long"))
    schema = "doc_id long, item_id long, edits long, n_words long, start long"
    out = None
    for kept in _blocks(benchmark, item_column, item_text_column):

        def run(batches, kept=kept):
            patterns = kept.value
            if not patterns.words:
                return
            for batch in batches:
                data, offsets = text_bytes(batch.column(1))
                for a, b in row_groups(offsets, CHUNK_BYTES):
                    words, ends, _ = word_values(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                    best: dict[tuple[int, int], tuple] = {}
                    for row, k, edits, n, at in patterns.find(words, ends):
                        key = (row, patterns.item[k])
                        rank = (n < int(patterns.length[k]), edits / n, -n)
                        if key not in best or rank < best[key][0]:
                            best[key] = (rank, edits, n, at)
                    if best:
                        rows = list(best)
                        columns = [[patterns_item for _, patterns_item in rows], [best[k][1] for k in rows], [best[k][2] for k in rows], [best[k][3] for k in rows]]
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([a + row for row, _ in rows])), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", "item_id", "edits", "n_words", "start"])

        found = source.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out
