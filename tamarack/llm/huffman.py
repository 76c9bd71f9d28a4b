"""Token ids in files: canonical length-limited Huffman codes in independent blocks.

Ids are counted over the whole corpus; the code lengths follow by package-merge and the codes by
the canonical rule, so a table of one byte per id describes them. A file set is a folder with

* ``header``: one row - magic, version, bits of the longest code, ids per checkpoint, lengths;
* ``blocks``: a row per block - shard, place in the shard, ids before it in the shard, the
  documents with their numbers of ids, the bit offset of every STRIDE-th id (64 bits each), and the bits.

Shards follow one another in ascending doc_id order (null first), and so do the documents in
them. A block holds whole documents and can be read by itself; all lanes between its checkpoints
are decoded side by side, one table look-up an id.

Rows are kept in Parquet, which Spark commits task by task, so a lost executor leaves no half-written file.
"""

from __future__ import annotations

import functools
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.llm.common import discard, new_path, partitions, pick, release, row_groups, stored, text_bytes

MAGIC, VERSION, MAX_BITS, STRIDE, BLOCK_IDS = "THUF", 2, 18, 128, 1 << 19
CHUNK_BYTES, CACHE_ENTRIES, CACHED_BYTES = 1 << 22, 1 << 20, 64
_SPACE, _ALNUM, _MARK = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_ALNUM[[c for c in range(0x80) if chr(c).isalnum()]] = True
_MARK[list(b".,;:!?")] = True
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
_BYTE = np.random.default_rng(11).integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)


def code_lengths(counts: np.ndarray, most: int = MAX_BITS) -> np.ndarray:
    """Bits of each id's code, 0 where it doesn't occur: the least total under ``most`` bits."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        out[used] = 1
        return out
    if len(used) > 1 << most:
        raise ValueError(f"{len(used)} ids need codes of over {most} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves, packages, kinds = counts[order].astype(np.int64), np.zeros(0, np.int64), []
    for _ in range(most):
        both = np.concatenate([leaves, packages])
        by = np.argsort(both, kind="stable")
        kinds.append(by < len(leaves))
        both = both[by]
        packages = both[: len(both) // 2 * 2].reshape(-1, 2).sum(1)
    take, bits = 2 * len(leaves) - 2, np.zeros(len(leaves), np.int64)
    for is_leaf in reversed(kinds):
        n = int(is_leaf[:take].sum())
        bits[:n] += 1
        take = 2 * (take - n)
    out[order] = bits
    return out


def codes(lengths: np.ndarray) -> np.ndarray:
    """The canonical codes: ascending by length, then by id."""
    order = np.flatnonzero(lengths)
    order = order[np.argsort(lengths[order], kind="stable")]
    out, code, last = np.zeros(len(lengths), np.uint64), 0, 0
    bits = lengths[order].tolist()
    values = []
    for n in bits:
        code <<= n - last
        values.append(code)
        code, last = code + 1, n
    out[order] = values
    return out


def pack(ids: np.ndarray, lengths: np.ndarray, code: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bits of the ids' codes, and the bit offset of every STRIDE-th id."""
    width = lengths[ids].astype(np.int64)
    if len(ids) and not width.all():
        raise ValueError("an id has no code")
    end = np.cumsum(width)
    at = end - width
    words = np.zeros(int(end[-1] + 63) // 64 + 1 if len(ids) else 0, np.uint64)
    if len(ids):
        place, room = at >> 6, 64 - (at & 63) - width
        value = code[ids]
        first = np.where(room >= 0, value << np.maximum(room, 0).astype(np.uint64), value >> np.maximum(-room, 0).astype(np.uint64))
        begins = np.flatnonzero(np.diff(place, prepend=-1))
        words[place[begins]] |= np.bitwise_or.reduceat(first, begins)
        over = np.flatnonzero(room < 0)
        words[place[over] + 1] |= value[over] << (64 + room[over]).astype(np.uint64)
    return words.astype(">u8").tobytes(), at[::STRIDE].astype(np.int64)


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For every MAX-bit prefix the id and the bits of the code that it begins with."""
    most = int(lengths.max()) if len(lengths) else 0
    ids, bits = np.zeros(1 << most, np.int32), np.zeros(1 << most, np.int64)
    order = np.flatnonzero(lengths)
    order = order[np.argsort(lengths[order], kind="stable")]
    span = 1 << (most - lengths[order].astype(np.int64))
    ids[: span.sum()] = np.repeat(order, span)
    bits[: span.sum()] = np.repeat(lengths[order], span)
    return ids, bits, most


def unpack(data: bytes, marks: np.ndarray, n: int, table: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    """The n ids: a lane from each checkpoint, all lanes a step at a time."""
    ids, bits, most = table
    out = np.zeros((STRIDE, len(marks)), np.int32)
    words = np.append(np.frombuffer(data, ">u8").astype(np.uint64), np.zeros(2, np.uint64))
    at, left = marks.copy(), 64 - most
    for step in range(min(STRIDE, n)):
        live = len(marks) if step < (n - 1) % STRIDE + 1 else len(marks) - 1
        if not live:
            break
        p = at[:live]
        word, off = p >> 6, (p & 63).astype(np.uint64)
        window = (words[word] << off) | ((words[word + 1] >> np.uint64(1)) >> (np.uint64(63) - off))
        prefix = (window >> np.uint64(left)).astype(np.int64)
        out[step, :live] = ids[prefix]
        at[:live] += bits[prefix]
    return out.T.reshape(-1)[:n]


def _ragged(starts: np.ndarray, width: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each stretch, end to end."""
    return np.arange(int(width.sum())) + np.repeat(starts - (np.cumsum(width) - width), width)


class Known:
    """Pieces of text and their ids, by the pieces' hashes; all in arrays. When there are too many, the
    half that hasn't been asked for the longest goes."""

    def __init__(self, dtype: str, entries: int = CACHE_ENTRIES):
        self.entries, self.now = entries, 0
        self.keys, self.text, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.uint8), np.zeros(0, dtype)
        self.at, self.width, self.begin, self.n, self.used = (np.zeros(0, np.int64) for _ in range(5))

    def find(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, width: np.ndarray) -> np.ndarray:
        """The number of each piece data[start : start + width], or -1."""
        self.now += 1
        if not len(self.keys):
            return np.full(len(keys), -1)
        place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = np.flatnonzero((self.keys[place] == keys) & (self.width[place] == width))
        same = self.text[_ragged(self.at[place[hit]], width[hit])] == data[_ragged(starts[hit], width[hit])]
        if not same.all():
            hit = hit[np.logical_and.reduceat(same, np.cumsum(width[hit]) - width[hit])]
        out = np.full(len(keys), -1)
        out[hit] = place[hit]
        self.used[place[hit]] = self.now
        return out

    def add(self, keys: np.ndarray, pieces: list[bytes], ids: list[bytes]) -> None:
        """Pieces that aren't known, by ascending keys."""
        if len(self.keys) + len(keys) > self.entries:
            kept = np.sort(np.argsort(-self.used, kind="stable")[: self.entries // 2])
            self.text, self.ids = self.text[_ragged(self.at[kept], self.width[kept])], self.ids[_ragged(self.begin[kept], self.n[kept])]
            self.keys, self.width, self.n, self.used = self.keys[kept], self.width[kept], self.n[kept], self.used[kept]
            self.at, self.begin = np.cumsum(self.width) - self.width, np.cumsum(self.n) - self.n
        place = np.searchsorted(self.keys, keys)
        width = np.fromiter(map(len, pieces), np.int64, len(pieces))
        n = np.fromiter(map(len, ids), np.int64, len(ids)) // self.ids.itemsize
        self.at = np.insert(self.at, place, len(self.text) + np.cumsum(width) - width)
        self.begin = np.insert(self.begin, place, len(self.ids) + np.cumsum(n) - n)
        self.width, self.n, self.used = np.insert(self.width, place, width), np.insert(self.n, place, n), np.insert(self.used, place, self.now)
        self.keys = np.insert(self.keys, place, keys)
        self.text = np.append(self.text, np.frombuffer(b"".join(pieces), np.uint8))
        self.ids = np.append(self.ids, np.frombuffer(b"".join(ids), self.ids.dtype))


class Words:
    """The tokenizer's ids by pieces without ASCII white space.

    The vocabulary drops white space and marks the ends of words, and its normalisation never
    reaches across U+0020 or U+0009-U+000D, so a text's ids are those of its runs end to end. A full
    stop and the like behind a letter or digit begins a match of its pattern as well, and A-Z count as
    a-z except in its special tokens, which begin with "<". Pieces are found and told apart as arrays
    over many texts; only those that aren't known go through the tokenizer, words of Latin letters
    many to a call, parted again by the ids that end a word.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = id_type(self.tokenizer)
        self.known = Known(self.dtype)
        ends = {i for word, i in self.tokenizer.get_vocab().items() if word.endswith("</w>")}
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[list(ends)] = True
        latin = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ" + "".join(c for c in map(chr, range(0xC0, 0x250)) if c.isalpha() and len(c.lower()) == 1)
        self.latin = str.maketrans("", "", latin)

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, self.dtype).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        out, width = [], np.dtype(self.dtype).itemsize
        for a in range(0, len(words), 256):
            part = words[a : a + 256]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, self.dtype)
            stops = (np.flatnonzero(self.ends[ids]) + 1) * width
            if len(stops) == len(part) and stops[-1] == ids.nbytes:
                raw, stops = ids.tobytes(), stops.tolist()
                out += [raw[i:j] for i, j in zip([0, *stops], stops, strict=False)]
            else:
                out += self._ids(part)
        return out

    def learn(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece, from the tokenizer."""
        texts = [x.decode() for x in pieces]
        letters = [i for i, x in enumerate(texts) if not x.translate(self.latin)]
        out: list[bytes] = [b""] * len(texts)
        for i, ids in zip(letters, self._words([texts[i] for i in letters]), strict=True):
            out[i] = ids
        other = sorted(set(range(len(texts))).difference(letters))
        for a in range(0, len(other), 4096):
            part = other[a : a + 4096]
            for i, ids in zip(part, self._ids([texts[i] for i in part]), strict=True):
                out[i] = ids
        return out

    def _pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The texts' bytes with A-Z as a-z but in runs with "<", and where each piece begins and ends."""
        space = np.ones(len(data) + 2, bool)
        space[1:-1] = _SPACE[data]
        begins, stops = ~space[1:-1] & space[:-2], ~space[1:-1] & space[2:]
        edges = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
        begins[edges] = ~space[1:-1][edges]
        stops[edges - 1] = ~space[1:-1][edges - 1]
        low = _LOWER[data]
        if (data == 0x3C).any():
            run = np.cumsum(begins)
            special = np.zeros(int(run[-1]) + 1, bool)
            special[run[data == 0x3C]] = True
            low = np.where(special[run], data, low)
        letter = _ALNUM[data]
        letter[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        cut = np.flatnonzero(_MARK[data[1:]] & letter[:-1] & ~begins[1:])
        begins[cut + 1] = True
        stops[cut] = True
        return low, np.flatnonzero(begins), np.flatnonzero(stops) + 1

    def encode(self, texts: list[bytes], end_id: int) -> list[bytes]:
        """Little-endian ids of each text, ``end_id`` last."""
        offsets = np.cumsum([0, *map(len, texts)])
        ids, ends = self.encode_all(np.frombuffer(b"".join(texts), np.uint8), offsets, end_id)
        return [x.tobytes() for x in np.split(ids, ends[:-1])]

    def encode_all(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts data[offsets[i] : offsets[i + 1]] end to end, ``end_id`` behind each, and
        where each text's ids end."""
        texts = len(offsets) - 1
        data, starts, stops = self._pieces(data, offsets)
        if not len(starts):
            return np.full(texts, end_id, self.dtype), np.arange(1, texts + 1)
        width = stops - starts
        begin, size, ids = self._found(data, starts, width)
        behind = np.concatenate([[0], np.cumsum(size)])
        ends = behind[np.searchsorted(starts, offsets[1:])] + np.arange(1, texts + 1)
        out = np.empty(int(behind[-1]) + texts, self.dtype)
        own = np.ones(len(out), bool)
        own[ends - 1] = False
        out[own] = ids[_ragged(begin, size)]
        out[ends - 1] = end_id
        return out, ends

    def _found(self, data: np.ndarray, starts: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each piece's ids begin in the ids that come third, and how many they are.

        Pieces are told apart by 64-bit hashes; should two that differ share one, all are learnt one by one."""
        at, first = _ragged(starts, width), np.cumsum(width) - width
        place = np.cumprod(np.full(int(width.max()), 0xD1342543DE82EF95, np.uint64))
        held = data[at]
        hashes = np.add.reduceat(_BYTE[held] * place[at - np.repeat(starts, width)], first) + width.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        keys, first, number = np.unique(hashes, return_index=True, return_inverse=True)
        raw = data.tobytes()
        if not ((width == width[first][number]).all() and (held == data[_ragged(starts[first][number], width)]).all()):
            every = self.learn([raw[a : a + n] for a, n in zip(starts.tolist(), width.tolist(), strict=True)])
            size = np.fromiter(map(len, every), np.int64, len(every)) // np.dtype(self.dtype).itemsize
            return np.cumsum(size) - size, size, np.frombuffer(b"".join(every), self.dtype)
        starts, width = starts[first], width[first]
        of = self.known.find(keys, data, starts, width)
        new = np.flatnonzero(of < 0)
        pieces = [raw[a : a + n] for a, n in zip(starts[new].tolist(), width[new].tolist(), strict=True)]
        learnt = self.learn(pieces)
        n = np.fromiter(map(len, learnt), np.int64, len(learnt)) // np.dtype(self.dtype).itemsize
        ids = np.append(self.known.ids, np.frombuffer(b"".join(learnt), self.dtype))
        begin, size = np.empty(len(keys), np.int64), np.empty(len(keys), np.int64)
        old = of >= 0
        begin[old], size[old] = self.known.begin[of[old]], self.known.n[of[old]]
        begin[new], size[new] = len(self.known.ids) + np.cumsum(n) - n, n
        # long pieces would make the cache's size unbounded; a key may be another piece's
        short = np.flatnonzero((width[new] <= CACHED_BYTES) & ~np.isin(keys[new], self.known.keys, assume_unique=True))
        self.known.add(keys[new[short]], [pieces[i] for i in short], [learnt[i] for i in short])
        return begin[number], size[number], ids


def id_type(tokenizer) -> str:
    """Two bytes an id where they do, else four."""
    return "<u2" if tokenizer.get_vocab_size() <= 1 << 16 else "<u4"


@functools.cache
def words(path: str) -> Words:
    return Words(path)


def tokenize(docs: DataFrame, path: str, end_id: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, ids binary: each text's ids as little-endian numbers of :func:`id_type`, the end id last.

    A null text is empty and has the end id alone."""

    def run(batches):
        tokenizer = words(path)
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for a, b in row_groups(offsets, CHUNK_BYTES):
                ids, ends = tokenizer.encode_all(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], end_id)
                at = np.concatenate([[0], ends]) * ids.itemsize
                held = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), held.cast(pa.binary())], ["doc_id", "ids"])
        release()

    source = pick(docs, doc_id=id_column, text=text_column)
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, ids binary")


def count_ids(tokens: DataFrame, dtype: str) -> np.ndarray:
    """How often each id occurs: a row per id and partition is summed, the vocabulary's size at most."""

    def run(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            data, _ = text_bytes(batch.column(0))
            seen = np.bincount(data.view(dtype)) if len(data) else np.zeros(0, np.int64)
            if len(seen) > len(total):
                seen[: len(total)] += total
                total = seen
            else:
                total[: len(seen)] += seen
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["id", "n"])

    rows = tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(max((r.id for r in rows), default=-1) + 1, np.int64)
    for r in rows:
        out[r.id] = r.n
    return out


BLOCK_SCHEMA = "shard int, block int, before long, doc_ids array<long>, sizes array<long>, n_ids long, marks binary, bits binary"


def write(tokens: DataFrame, counts: np.ndarray, path: str, dtype: str) -> None:
    """Write ``tokens`` (doc_id long, ids binary, numbers of ``dtype``) as a file set."""
    spark = tokens.sparkSession
    lengths = code_lengths(counts)
    code, packed = codes(lengths), lengths.tobytes()
    spark.createDataFrame([(MAGIC, VERSION, MAX_BITS, STRIDE, bytearray(packed))], "magic string, version int, max_bits int, stride int, lengths binary").coalesce(1).write.parquet(f"{path}/header")

    def run(batches):
        shard = block = before = held = 0
        keys: list = []
        parts: list = []

        def flush():
            ids = np.concatenate(parts) if parts else np.zeros(0, dtype)
            bits, marks = pack(ids, lengths, code)
            values = [[shard], [block], [before], [keys], [[len(x) for x in parts]], [len(ids)], [marks.astype("<u8").tobytes()], [bits]]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], [x.split()[0] for x in BLOCK_SCHEMA.split(", ")])

        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            for row, (number, key) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                shard = number
                ids = data[offsets[row] : offsets[row + 1]].copy().view(dtype)
                keys.append(key)
                parts.append(ids)
                held += len(ids)
                if held >= BLOCK_IDS:
                    yield flush()
                    block, before, held, keys, parts = block + 1, before + held, 0, [], []
        if keys:
            yield flush()

    ordered = tokens.repartitionByRange(partitions(spark), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "ids")
    ordered.select(F.spark_partition_id().alias("shard"), "doc_id", "ids").mapInArrow(run, BLOCK_SCHEMA).write.option("compression", "none").parquet(f"{path}/blocks")


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, ids: each document's ids, and how many ids are before them.

    The driver holds a number per shard, of which there are as many as partitions were written."""
    header = spark.read.parquet(f"{path}/header").first()
    if header is None or header.magic != MAGIC or header.version != VERSION or header.stride != STRIDE:
        raise ValueError(f"{path} isn't such a file set")
    blocks = spark.read.parquet(f"{path}/blocks")
    sizes = sorted((r.shard, r.n) for r in blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect())
    bases = dict(zip([s for s, _ in sizes], np.cumsum([0, *(n for _, n in sizes)]).tolist(), strict=False))
    packed = bytes(header.lengths)

    def run(batches):
        table = decode_table(np.frombuffer(packed, np.uint8))
        for batch in batches:
            for r in batch.to_pylist():
                ids = unpack(r["bits"], np.frombuffer(r["marks"], "<u8").astype(np.int64), r["n_ids"], table).astype("<u4")
                size = np.array(r["sizes"], np.int64)
                at = np.cumsum(size) - size
                start = bases[r["shard"]] + r["before"] + at
                yield pa.RecordBatch.from_arrays([pa.array(r["doc_ids"], pa.int64()), pa.array(start, pa.int64()), pa.array([ids[a : a + n].tobytes() for a, n in zip(at.tolist(), size.tolist(), strict=True)], pa.binary())], ["doc_id", "start", "ids"])

    return blocks.mapInArrow(run, "doc_id long, start long, ids binary")


def checksums(ids: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of what :func:`read` gives."""
    return ids.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def write_corpus(docs: DataFrame, tokenizer: str, end_id: int, path: str | None = None) -> str:
    """Tokenize, count, write; the path of the file set. Ids are kept in the shared folder meanwhile."""
    spark = docs.sparkSession
    path = path or new_path(spark, "ids")
    kept = new_path(spark, "tokens")
    dtype = words(tokenizer).dtype
    tokens = stored(tokenize(docs, tokenizer, end_id), "tokens", kept)
    write(tokens, count_ids(tokens, dtype), path, dtype)
    discard(spark, kept)
    return path
