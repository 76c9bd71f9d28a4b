"""Removal of repeated byte strings: a suffix array by bucket-pointer refinement.

Suffixes are put into buckets by their first eight bytes. A bucket's suffixes are then sorted by the
identifiers of the buckets that lie eight bytes further, which tells them apart by sixteen bytes;
as each round's identifiers serve the next, the offset doubles every time. Suffixes alone in their
bucket leave the refinement, so work shrinks to what really is repeated. After the rounds, two
windows of WIDTH bytes are equal when they are in one bucket.

Texts are dealt to the shards as :mod:`tamarack.llm.windows` describes. Every byte covered by a
repeated window goes, and windows are judged on the input.

Defined results: null texts are empty; texts shorter than a window lose nothing; repeated rows lose
every window, since each row is the other's copy.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tamarack.llm.windows import Kind, covered, promising, rows_of, spans, symbols

WIDTH, GRAM = 200, 40
KIND = Kind(words=False, width=WIDTH, gram=GRAM)


def bucket_ids(data: np.ndarray, left: np.ndarray, depth: int) -> np.ndarray:
    """For each position a bucket identifier. Positions with ``depth`` bytes or more left in their text
    (``left``) have equal identifiers if and only if their next ``depth`` bytes are equal.

    An identifier is the place of the bucket's first suffix in the order, so parts of a bucket can
    be named within the bucket's own range."""
    n, known = len(data), 8
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = (key << np.uint64(8)) | padded[i : n + i]
    active = np.flatnonzero(left >= known)
    active = active[np.argsort(key[active])]
    ids = np.full(n, -1, np.int64)
    change = _changes(key[active])
    first = np.flatnonzero(change)
    ids[active] = first[np.cumsum(change) - 1]
    while known < depth:
        offset = min(known, depth - known)
        active = active[left[active] >= known + offset]
        own = ids[active]
        active = active[np.bincount(own, minlength=n)[own] > 1]
        if not len(active):
            break
        both = (ids[active] << 32) | ids[active + offset]
        by = np.argsort(both)
        active, both = active[by], both[by]
        bucket = both >> 32
        starts, parts = np.flatnonzero(_changes(bucket)), np.flatnonzero(change := _changes(both))
        begin = starts[np.searchsorted(starts, parts, side="right") - 1]
        ids[active] = (bucket[parts] + parts - begin)[np.cumsum(change) - 1]
        known += offset
    return ids


def _changes(ordered: np.ndarray) -> np.ndarray:
    out = np.ones(len(ordered), bool)
    out[1:] = ordered[1:] != ordered[:-1]
    return out


def kernel(slices: list[bytes], weights: np.ndarray, width: int = WIDTH) -> list[list[tuple[int, int]]]:
    """The ranges that windows with two occurrences or more, by weight, cover in each slice."""
    ends = np.cumsum(np.fromiter(map(len, slices), np.int64, len(slices)))
    data = np.frombuffer(b"".join(slices), np.uint8)
    # what can't be repeated isn't put into buckets
    place, stops = promising(symbols(data, ends, KIND)[0], ends, weights, Kind(words=False, width=width, gram=min(GRAM, width)))
    out: list[list[tuple[int, int]]] = [[] for _ in slices]
    left = np.repeat(stops, np.diff(stops, prepend=0)) - np.arange(len(place))
    ids = bucket_ids(data[place], left, width)
    at = np.flatnonzero(left >= width)
    owner = np.searchsorted(ends, place[at], side="right")
    total = np.bincount(ids[at], weights[owner], len(ids))
    again = total[ids[at]] > 1
    at, owner = place[at[again]], owner[again]
    if len(at):
        fresh = np.flatnonzero((np.diff(at) > width) | (np.diff(owner) > 0))
        first, last = np.append(0, fresh + 1), np.append(fresh, len(at) - 1)
        start = np.append(0, ends[:-1])[owner[first]]
        for i, a, b in zip(owner[first].tolist(), (at[first] - start).tolist(), (at[last] + width - start).tolist(), strict=True):
            out[i].append((a, b))
    return out


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans (begin and end of each, in bytes), kept binary."""

    def run(batches):
        for batch in rows_of(batches):
            out: list[list] = [[] for _ in range(5)]
            for text, starts, ranges in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                data = (text or "").encode()
                gone = spans(starts, ranges)
                places = [0, *(x for r in gone for x in r), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(places[::2], places[1::2], strict=True))
                for column, value in zip(out, (len(data), len(data) - len(kept), len(gone), places[1:-1], kept), strict=True):
                    column.append(value)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(out, types, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    return covered(docs, KIND, kernel, id_column, text_column).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<long>, kept binary")
