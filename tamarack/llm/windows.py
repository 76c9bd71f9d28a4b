"""Repeated windows of symbols: how texts are dealt to shards that can be indexed by themselves.

A window is WIDTH consecutive symbols of one text. Equal windows have the same minimizer - the
least among their GRAM-symbol substrings - so windows are dealt to shards by it. Rare substrings
are less than frequent ones, as a table of counts by hash has it, and hashes decide among those as
rare. A passage that very many texts share so gives up the windows that reach into its
surroundings to the minimizers of these, and the windows within it form equal slices. (Of words only:
over bytes the counts cost too much.) Neighbouring
windows with one minimizer travel together as a slice of the text, and equal slices of a map task
travel once, with a count. Minimizers that occur once in all texts can't belong to a repeated
window: a first pass counts them, a bit table of a fixed size holds those that occur again, and
the second pass cuts slices for these alone. A table that fills up lets more slices through and
costs time, not results.

A shard's ``kernel`` gets slices and counts, and gives for each slice the ranges of symbols that
its repeated windows cover.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.llm.common import discard, new_path, numbered, partitions, pick, release, row_groups, stored, text_bytes
from tamarack.llm.minhash import mix

#: log2 of the bits of the table of minimizers that occur again: 16 MB in a task, which are sent as
#: compressed segments, so that what passes through the driver is small while the table is thin.
TABLE_BITS, SEGMENTS, CODEC = 27, 64, "zstd"
#: log2 of the counts of substrings by hash, 1 MB of classes in a task. Counts tell a passage from chance as long as
#: it has more copies than a slot has substrings on average; whatever they tell, results are the same.
RARITY_BITS, RARITY_SEGMENTS, CLASSES = 20, 16, 32
#: Symbols that a shard's kernel gets at a time, unless one minimizer has more; slices held to be combined.
SHARD_SYMBOLS, SHARD_ROWS, COMBINE = 1 << 20, 1 << 11, 1 << 15
#: log2 of the least number of counts by hash that tell which grams of a shard occur once.
SLOT_BITS = 21
CHUNK_BYTES = 1 << 17


@dataclass(frozen=True)
class Kind:
    """Symbols, and the lengths of windows and of grams in symbols."""

    words: bool
    width: int
    gram: int

    @property
    def span(self) -> int:
        """Grams of a window."""
        return self.width - self.gram + 1


def _byte_values() -> np.ndarray:
    return np.random.default_rng(23).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


_BYTES = _byte_values()
#: Weights of symbols are powers of an odd number, so sums over bytes or grams can be shifted to where they begin.
_POWER = 0x9E3779B97F4A7C15


@functools.cache
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _power(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers; those of a shard's usual size are kept."""
    usual = 2 * SHARD_SYMBOLS
    return _powers(base, usual)[:n] if n <= usual else _powers.__wrapped__(base, n)


def gram_hashes(values: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each ``gram`` consecutive values: weighted sums, shifted to their first value."""
    n = len(values) - gram + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    summed = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _power(_POWER, len(values)), out=summed[1:])
    out = summed[gram:] - summed[:n]
    out *= _power(pow(_POWER, -1, 1 << 64), n)
    return mix(out)


def sliding_least(values: np.ndarray, span: int) -> np.ndarray:
    """The least of each ``span`` consecutive values."""
    size = 1
    while size * 2 <= span:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    if rest := span - size:
        values = np.minimum(values[:-rest], values[rest:])
    return values


def _by_rarity(grams: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    """The hashes with the class of their count in the highest bits."""
    slot = (grams >> np.uint64(64 - RARITY_BITS)).astype(np.int64)
    return (rarity[slot].astype(np.uint64) << np.uint64(58)) | (grams & np.uint64((1 << 58) - 1))


def runs(values: np.ndarray, ends: np.ndarray, kind: Kind, rarity: np.ndarray | None = None, count: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts end to end (``values``; text i ends at ``ends[i]``): the minimizer, the first window and
    the number of windows of each run, and how often its minimizer occurs in it (with ``count``). ``rarity``:
    classes of counts by hash; without them hashes alone decide which substring is the least.

    Runs hold neighbouring windows of one text with one minimizer, ``kind.span`` of them at most."""
    none = np.zeros(0, np.int64)
    if len(values) < kind.width:
        return none.view(np.uint64), none, none, none
    grams = gram_hashes(values, kind.gram)
    if rarity is not None:
        grams = _by_rarity(grams, rarity)
    np.maximum(grams, np.uint64(1), out=grams)
    least = sliding_least(grams, kind.span)
    # no window begins in a text's last symbols, so windows of two texts are never neighbours; 0 stands there
    short = np.minimum(kind.width - 1, np.diff(ends, prepend=0))
    off = np.repeat(ends - np.cumsum(short), short) + np.arange(int(short.sum()))
    least[off[off < len(least)]] = 0
    change = np.flatnonzero(least[1:] != least[:-1]) + 1
    begin = np.concatenate([[0], change])
    length = np.diff(np.append(begin, len(least)))
    used = least[begin] > 0
    begin, length = begin[used], length[used]
    pieces = -(-length // kind.span)
    if (pieces > 1).any():
        part = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin, length = np.repeat(begin, pieces) + part * kind.span, np.minimum(np.repeat(length, pieces) - part * kind.span, kind.span)
    m = least[begin]
    return m, begin, length, _hits(grams, least, m, begin, length, kind) if count else none


def _hits(grams: np.ndarray, least: np.ndarray, m: np.ndarray, begin: np.ndarray, length: np.ndarray, kind: Kind) -> np.ndarray:
    """How often the minimizer of each run is among the run's grams: more than once means that it recurs.

    A gram is the minimizer of a window that holds it if it is no more than the greatest of their minimizers."""
    around = np.zeros(len(grams) + kind.span - 1, np.uint64)
    around[kind.span - 1 : kind.span - 1 + len(least)] = least
    np.invert(around, out=around)
    place = np.flatnonzero(grams == ~sliding_least(around, kind.span))
    # the runs with windows that hold a place
    low, high = np.searchsorted(begin + length, place - kind.span + 1, side="right"), np.searchsorted(begin, place, side="right")
    n = high - low
    run = np.repeat(low - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
    return np.bincount(run[m[run] == np.repeat(grams[place], n)], minlength=len(m))


_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A hash of each word of the texts, how many words begin before the end of each text, and the
    bytes at which words begin and stop."""
    none = np.zeros(0, np.int64)
    n = len(data)
    if not n:
        return none.view(np.uint64), np.zeros(len(offsets) - 1, np.int64), none, none
    black = ~_SPACE[data]
    head, tail = black.copy(), black.copy()
    head[1:] &= ~black[:-1]
    tail[:-1] &= ~black[1:]
    # a text's first and last byte are next to none
    firsts, lasts = offsets[:-1][offsets[:-1] < n], offsets[1:][offsets[1:] > 0] - 1
    head[firsts], tail[lasts] = black[firsts], black[lasts]
    begin, stop = np.flatnonzero(head), np.flatnonzero(tail) + 1
    summed = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * _power(_POWER, n))])
    return mix((summed[stop] - summed[begin]) * _power(pow(_POWER, -1, 1 << 64), n)[begin]), np.searchsorted(begin, offsets[1:]), begin, stop


def symbols(data: np.ndarray, offsets: np.ndarray, kind: Kind) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The values of all symbols of the texts, where each text ends among them, and the bytes at which
    each symbol begins and stops."""
    if not kind.words:
        at = np.arange(len(data) + 1)
        return _BYTES[data], offsets[1:], at[:-1], at[1:]
    return words_of(data, offsets)


def _keyed(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """doc_id, text, and a digest of the text that tells rows of one id apart."""
    return pick(docs, doc_id=id_column, text=text_column).withColumn("digest", F.xxhash64("text"))


def _rarity(texts: DataFrame, kind: Kind) -> bytes:
    """For each slot of hashes a byte: the class, by powers of two, of how many substrings of all texts fall
    into it, against the average of those with any; so texts that all occur n times as often have the same classes."""
    size = (1 << RARITY_BITS) // RARITY_SEGMENTS

    def packed(rows):
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([pa.compress(x.tobytes(), CODEC, asbytes=True) for _, x in rows], pa.binary())], ["segment", "counts"])

    def count(batches):
        held = np.zeros(1 << RARITY_BITS, np.int64)
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            for a, b in row_groups(offsets, CHUNK_BYTES):
                values = symbols(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], kind)[0]
                if len(values) >= kind.width:
                    slot = gram_hashes(values, kind.gram) >> np.uint64(64 - RARITY_BITS)
                    held += np.bincount(slot.astype(np.int64), minlength=len(held))
        if held.any():
            yield packed(list(enumerate(np.minimum(held, 0xFFFFFFFF).astype(np.uint32).reshape(RARITY_SEGMENTS, size))))
        release()

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for segment, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[segment] = sums.get(segment, 0) + np.frombuffer(pa.decompress(counts, size * 4, CODEC), np.uint32).astype(np.int64)
        for segment, total in sums.items():
            yield packed([(segment, total)])

    schema = "segment int, counts binary"
    counts = texts.select("text").mapInArrow(count, schema).repartition(RARITY_SEGMENTS, "segment").mapInArrow(add, schema)
    total = np.zeros((RARITY_SEGMENTS, size), np.int64)
    for r in counts.toLocalIterator():
        total[r.segment] = np.frombuffer(pa.decompress(bytes(r.counts), size * 8, CODEC), np.int64)
    average = total.sum() / max(np.count_nonzero(total), 1)
    relative = np.floor(np.log2(np.maximum(total, 1) / max(average, 1)))
    return np.clip(relative + CLASSES // 2, 0, CLASSES - 1).astype(np.uint8).tobytes()


def _again(texts: DataFrame, kind: Kind, rarity) -> dict[int, bytes]:
    """The bit table of the minimizers that occur more than once: compressed segments by their number."""
    bits, spark = TABLE_BITS, texts.sparkSession

    def minimizers(batches):
        rare = np.frombuffer(rarity.value, np.uint8) if kind.words else None
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            for a, b in row_groups(offsets, CHUNK_BYTES):
                part = offsets[a : b + 1] - offsets[a]
                values, ends, _, _ = symbols(data[offsets[a] : offsets[b]], part, kind)
                m, _, _, hits = runs(values, ends, kind, rare)
                if len(m):
                    yield pa.RecordBatch.from_arrays([pa.array(m.view(np.int64)), pa.array(hits)], ["m", "n"])
        release()

    def table(batches):
        parts: dict[int, np.ndarray] = {}
        size = bits - SEGMENTS.bit_length() + 1
        for batch in batches:
            slot = batch.column(0).to_numpy()
            for segment in np.unique(slot >> size).tolist():
                own = slot[(slot >> size) == segment] & ((1 << size) - 1)
                np.bitwise_or.at(parts.setdefault(segment, np.zeros((1 << size) // 8, np.uint8)), own >> 3, (1 << (own & 7)).astype(np.uint8))
        for segment, held in parts.items():
            yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([pa.compress(held.tobytes(), CODEC, asbytes=True)], pa.binary())], ["segment", "bits"])

    again = texts.select("text").mapInArrow(minimizers, "m long, n long").groupBy("m").agg(F.sum("n").alias("n")).where(F.col("n") > 1)
    slots = again.select(F.col("m").bitwiseAND(F.lit((1 << bits) - 1)).alias("slot")).withColumn("segment", F.shiftright("slot", bits - SEGMENTS.bit_length() + 1))
    # a segment is put together in one task
    parts = slots.repartition(min(SEGMENTS, partitions(spark)), "segment").select("slot").mapInArrow(table, "segment int, bits binary")
    return {r.segment: bytes(r.bits) for r in parts.toLocalIterator()}


def _table(segments: dict[int, bytes]) -> np.ndarray:
    size = (1 << TABLE_BITS) // 8 // SEGMENTS
    out = np.zeros((SEGMENTS, size), np.uint8)
    for segment, held in segments.items():
        out[segment] = np.frombuffer(pa.decompress(held, size, CODEC), np.uint8)
    return out.reshape(-1)


def _slices(texts: DataFrame, kind: Kind, table, rarity) -> DataFrame:
    """m, slice, hash, doc_id, digest, start: of every run whose minimizer is in the bit table."""

    def run(batches):
        import xxhash

        held, rare = _table(table.value), np.frombuffer(rarity.value, np.uint8) if kind.words else None
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for a, b in row_groups(offsets, CHUNK_BYTES):
                part, own = offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]]
                values, ends, first, last = symbols(own, part, kind)
                m, begin, length, _ = runs(values, ends, kind, rare, count=False)
                slot = (m & np.uint64((1 << TABLE_BITS) - 1)).astype(np.int64)
                keep = (held[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 > 0
                m, begin, stop = m[keep], begin[keep], begin[keep] + length[keep] + kind.width - 1
                if not len(m):
                    continue
                row = np.searchsorted(ends, begin, side="right")
                start = begin - np.concatenate([[0], ends])[row]
                raw = own.tobytes()
                cut = [raw[x:y] for x, y in zip(first[begin].tolist(), last[stop - 1].tolist(), strict=True)]
                if kind.words:
                    cut = [b" ".join(x.split()) for x in cut]
                row = pa.array(row + a)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(m.view(np.int64)), pa.array(cut, pa.binary()), pa.array(np.array([xxhash.xxh3_64_intdigest(x) for x in cut], np.uint64).view(np.int64)), batch.column(0).take(row), batch.column(2).take(row), pa.array(start, pa.int32())],
                    ["m", "slice", "hash", "doc_id", "digest", "start"],
                )
        del held
        release()

    return texts.mapInArrow(run, "m long, slice binary, hash long, doc_id long, digest long, start int")


Kernel = Callable[[list[bytes], np.ndarray], list[list[tuple[int, int]]]]


def _repeated(slices: DataFrame, kernel: Kernel) -> DataFrame:
    """m, hash, ranges: the ranges of symbols that repeated windows cover, of slices that have any."""

    def combine(batches):
        held: dict[tuple, int] = {}

        def flush():
            keys = list(held)
            batch = pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array([k[2] for k in keys], pa.binary()), pa.array(list(held.values()), pa.int64())], ["m", "hash", "slice", "n"])
            held.clear()
            return batch

        for batch in batches:
            for key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                held[key] = held.get(key, 0) + 1
            if len(held) >= COMBINE:
                yield flush()
        if held:
            yield flush()

    def look(part: pa.Table):
        raw = part.column("slice").to_pylist()
        number: dict[bytes, int] = {}
        place = [number.setdefault(x, len(number)) for x in raw]
        weight = np.bincount(place, part.column("n").to_numpy(), len(number)).astype(np.int64)
        found = kernel(list(number), weight)
        at = dict(zip(place, range(len(raw)), strict=True))
        rows = [i for i in range(len(number)) if found[i]]
        take = pa.array([at[i] for i in rows], pa.int64())
        return pa.RecordBatch.from_arrays([part.column("m").combine_chunks().take(take), part.column("hash").combine_chunks().take(take), pa.array([[x for r in found[i] for x in r] for i in rows], pa.list_(pa.int32()))], ["m", "hash", "ranges"])

    def shards(batches):
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in (b.slice(a, SHARD_ROWS) for b in batches for a in range(0, b.num_rows, SHARD_ROWS)):
            held.append(batch)
            size += batch.column(2).nbytes
            if size > SHARD_SYMBOLS and held[0].column(0)[0] != batch.column(0)[-1]:
                table = pa.Table.from_batches(held)
                m = table.column("m").to_numpy()
                cut = int(np.searchsorted(m, m[-1]))  # the last minimizer may go on
                yield look(table.slice(0, cut))
                held = table.slice(cut).combine_chunks().to_batches()
                size = sum(x.column(2).nbytes for x in held)
        if held:
            yield look(pa.Table.from_batches(held))
        held = []
        release()

    own = slices.select("m", "hash", "slice").mapInArrow(combine, "m long, hash long, slice binary, n long")
    dealt = own.repartition(partitions(slices.sparkSession), "m").sortWithinPartitions("m")
    return dealt.mapInArrow(shards, "m long, hash long, ranges array<int>")


def covered(docs: DataFrame, kind: Kind, kernel: Kernel, id_column: str = "doc_id", text_column: str = "text", rest: bool = False) -> DataFrame:
    """doc_id, text, starts, ranges: with each row of ``docs``, the slices that have repeated windows
    (null for none), where each starts and the ranges in it that such windows cover, in symbols.
    ``rest``: the column rest as well, a structure of all columns by place."""
    spark = docs.sparkSession
    texts = _keyed(docs, id_column, text_column).withColumn("doc_id", F.col("doc_id").cast("long"))
    path = new_path(spark, "slices")
    rarity = spark.sparkContext.broadcast(_rarity(texts, kind) if kind.words else b"")
    table = spark.sparkContext.broadcast(_again(texts, kind, rarity))
    slices = stored(_slices(texts, kind, table, rarity), "slices", path)
    table.destroy()
    rarity.destroy()
    found = _repeated(slices, kernel)
    # rows of one id and text have equal slices, which count once here
    of = slices.select("m", "hash", "doc_id", "digest", "start").join(found, ["m", "hash"]).groupBy("doc_id", "digest").agg(F.collect_set(F.struct("start", "ranges")).alias("found"))
    of = stored(of, "found")
    discard(spark, path)
    if rest:
        plain = numbered(docs)
        key, text = (F.col(f"_c{docs.columns.index(c)}") for c in (id_column, text_column))
        texts = plain.select(key.cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("digest"), F.struct(*plain.columns).alias("rest"))
    on = texts.doc_id.eqNullSafe(of.doc_id) & texts.digest.eqNullSafe(of.digest)
    return texts.join(of, on, "left").select(texts.doc_id, "text", F.col("found.start").alias("starts"), F.col("found.ranges").alias("ranges"), *(["rest"] if rest else []))


#: Rows of texts that are worked on at a time.
ROWS = 256


def rows_of(batches):
    """The batches in pieces of ROWS rows; at the end the worker's memory goes back."""
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS):
            yield batch.slice(a, ROWS)
    release()


def spans(starts: list[int] | None, ranges: list[list[int]] | None) -> list[tuple[int, int]]:
    """The maximal covered runs, ascending."""
    every = sorted((s + r[i], s + r[i + 1]) for s, r in zip(starts or (), ranges or (), strict=True) for i in range(0, len(r), 2))
    out: list[tuple[int, int]] = []
    for a, b in every:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def promising(values: np.ndarray, ends: np.ndarray, weights: np.ndarray, kind: Kind) -> tuple[np.ndarray, np.ndarray]:
    """Of strings end to end, with how often each occurs: the places that windows cover in which no gram
    occurs once, as far as counts by hash tell, and where each stretch of such places of a string ends among them.

    A gram that occurs once is in no repeated window, so nothing repeated is lost; what is left may not be repeated."""
    size = np.diff(ends, prepend=0)
    left = np.repeat(ends, size) - np.arange(len(values))
    grams = gram_hashes(values, kind.gram)
    slot = (grams >> np.uint64(64 - max(len(grams).bit_length(), SLOT_BITS))).astype(np.int64)
    once = np.zeros(len(values) + 1, np.int32)
    once[1 : len(slot) + 1] = np.bincount(slot)[slot] == 1 if len(slot) else 0
    once[1:] &= (left >= kind.gram) & np.repeat(weights == 1, size)
    once = np.cumsum(once, dtype=np.int32)
    at = np.flatnonzero(left >= kind.width)
    at = at[once[at + kind.span] == once[at]]
    if not len(at):
        return at, at
    # windows that overlap or meet within a string are one stretch
    fresh = np.flatnonzero((np.diff(at) > kind.width) | (left[at[1:]] - left[at[:-1]] != at[:-1] - at[1:]))
    begin, stop = at[np.append(0, fresh + 1)], at[np.append(fresh, len(at) - 1)] + kind.width
    last = np.cumsum(stop - begin)
    return np.repeat(stop - last, stop - begin) + np.arange(int(last[-1])), last
