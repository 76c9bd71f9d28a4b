"""Near-duplicate documents: circulant MinHash, banding and exact verification.

One permutation scatters a document's shingles over a ring, a second one, shifted by k places along
the ring, gives coordinate k of its signature: two permutations serve all coordinates. Documents
that agree in a band of coordinates are candidates, and 100 * intersection >= 75 * union of their
whole sets of shingles makes them linked.

Documents with equal sets form a class and stand for one node. Two steps find the links, and what
either puts out is linear in the nodes, however large a group of copies is. Nodes that share a
bucket and whose sketches are close give a spanning forest of candidates, of whose components each
is a cluster; then the whole sets of each cluster's nodes are compared, but for pairs that are
known to be connected, which gives a spanning forest of links. Buckets and clusters of many nodes
are dealt into blocks, and a task holds two blocks at a time.

Defined results: texts without words, or null, have an empty set and are linked with nothing; a
null id is linked with nothing and kept; an id that occurs with several texts is one node with all
their links; repeated rows are in one class, and each is returned.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tamarack.llm.common import discard, new_path, numbered, partitions, pick, release, stored, text_bytes
from tamarack.llm.components import components, stars

WORDS, BANDS, ROWS = 5, 32, 4
COORDINATES = BANDS * ROWS
#: A link takes NEAR hundredths of the union in common.
NEAR = 75
#: Of the 2-bit sketches of COORDINATES values, so many must agree: six standard deviations less than a
#: similarity of 0.75 gives on average (81 % of them), so about one link in 10**9 is missed here - far
#: fewer than the 5 in 10**6 that share no band.
AGREE = 77
#: Nodes of a block, where sketches alone are held and where whole sets are; links that a task holds at a time.
BLOCK, LINK_BLOCK, HELD_LINKS = 1024, 256, 1 << 20
CACHE_ENTRIES, CACHED_WORD_BYTES = 1 << 17, 48
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        out = xxhash.xxh3_64_intdigest(word)
        if len(word) <= CACHED_WORD_BYTES:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[word] = out
        return out


@functools.cache
def word_hashes() -> _Hashes:
    return _Hashes()


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes) -> np.ndarray:
    """Ascending distinct 64-bit hashes of the text's shingles; of all its words if they are fewer."""
    words = text.translate(LOWER).split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(word_hashes().__getitem__, words), np.uint64, n)
    size = min(n, WORDS)
    out = np.full(n - size + 1, size, np.uint64)
    for i in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + mix(h[i : n - size + 1 + i] + np.uint64(i))
    return np.unique(mix(out))


_SHIFT = np.arange(COORDINATES, dtype=np.uint32)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least place, under each shift of the second permutation, that a shingle of the set has."""
    out = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    ring = (shingles >> np.uint64(32)).astype(np.uint32)  # the first permutation: the hash is mixed already
    for a in range(0, len(ring), 256):
        x = ring[a : a + 256, None] + _SHIFT
        x ^= x >> np.uint32(16)
        x *= np.uint32(0x85EBCA6B)
        x ^= x >> np.uint32(13)
        x *= np.uint32(0xC2B2AE35)
        np.minimum(out, x.min(0), out=out)
    return out


def bands(coordinates: np.ndarray) -> np.ndarray:
    """A 64-bit key per band, of signatures in rows."""
    c = coordinates.reshape(-1, BANDS, ROWS).astype(np.uint64)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), c.shape[:2]).copy()
    for i in range(ROWS):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + c[:, :, i])
    return out.view(np.int64)


def sketches(coordinates: np.ndarray) -> np.ndarray:
    """Two bits of every coordinate: COORDINATES / 32 words each."""
    two = ((coordinates >> np.uint32(9)) & np.uint32(3)).astype(np.uint64).reshape(len(coordinates), -1, 32)
    return np.bitwise_or.reduce(two << (2 * np.arange(32, dtype=np.uint64)), axis=2)


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a ^ b
    return COORDINATES - np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(0x5555555555555555)).sum(-1, dtype=np.int64)


def signatures(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_shingles, class (a digest of the set, null if it is empty), bands, sketch."""

    def run(batches):
        import xxhash

        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for a in range(0, batch.num_rows, 1024):
                n, keys, rows = [], [], []
                for i in range(a, min(a + 1024, batch.num_rows)):
                    s = shingle_set(data[offsets[i] : offsets[i + 1]].tobytes())
                    n.append(len(s))
                    keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                    rows.append(signature(s))
                all_rows = np.stack(rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, len(n)),
                        pa.array(n, pa.int64()),
                        pa.array(keys, pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * BANDS, pa.int32()), pa.array(bands(all_rows).reshape(-1))),
                        pa.array([x.tobytes() for x in sketches(all_rows)], pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "class", "bands", "sketch"],
                )
        release()

    source = pick(docs, doc_id=id_column, text=text_column).withColumn("doc_id", F.col("doc_id").cast("long"))
    return source.mapInArrow(run, "doc_id long, n_shingles long, class binary, bands array<long>, sketch binary")


def near(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two ascending sets have NEAR hundredths of their union in common, of which there is some."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < NEAR * max(len(a), len(b)):
        return False
    at = np.searchsorted(b, a)
    common = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return 100 * common >= NEAR * (len(a) + len(b) - common)


def _merged(labels: np.ndarray, new: np.ndarray, to: int) -> None:
    labels[np.isin(labels, new)] = to


def _close_forest(sketch: np.ndarray):
    """Pairs of places: a spanning forest of the graph of close sketches."""
    labels = np.arange(len(sketch))
    for p in range(len(sketch) - 1):
        q = np.flatnonzero(labels != labels[p])
        q = q[q > p]
        if len(q) and len(q := q[agreement(sketch[q], sketch[p]) >= AGREE]):
            found, first = np.unique(labels[q], return_index=True)
            yield from ((p, int(q[k])) for k in first)
            _merged(labels, found, labels[p])


def _link_forest(sketch: np.ndarray, sets: list[np.ndarray]):
    """Pairs of places: a spanning forest of the graph of near sets."""
    labels = np.arange(len(sketch))
    for p in range(len(sketch) - 1):
        q = np.flatnonzero(labels != labels[p])
        q = q[q > p]
        if not len(q):
            continue
        agree = agreement(sketch[q], sketch[p])
        q = q[np.argsort(-agree, kind="stable")][: int((agree >= AGREE).sum())]
        for k in q.tolist():
            if labels[k] != labels[p] and near(sets[p], sets[k]):
                yield p, k
                _merged(labels, labels[k : k + 1].copy(), labels[p])


def _forests(groups: DataFrame, block: int, with_sets: bool) -> DataFrame:
    """a, b: links that join the same nodes as the forests of the groups (key, node, size, sketch[, shingles]);
    a task's forests are put together, so that few links leave it. Groups of over ``block`` nodes are dealt
    into blocks, each pair of which is looked at together."""

    def forest(part: pa.Table):
        node = part.column("node").to_numpy()
        data, _ = text_bytes(part.column("sketch").combine_chunks())
        sketch = data.copy().view(np.uint64).reshape(part.num_rows, -1)
        if with_sets:
            pairs = _link_forest(sketch, [np.frombuffer(x.as_buffer(), np.uint64) for x in part.column("shingles")])
        else:
            pairs = _close_forest(sketch)
        found = np.array(list(pairs), np.int64).reshape(-1, 2)
        return node[found[:, 0]], node[found[:, 1]]

    def cuts(table: pa.Table) -> np.ndarray:
        k, i, j = (table.column(c).to_numpy() for c in ("key", "i", "j"))
        return np.flatnonzero((k[1:] != k[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1

    def run(batches):
        held: list[pa.RecordBatch] = []
        links: list[tuple[np.ndarray, np.ndarray]] = []

        def forests(table: pa.Table, at: list[int]):
            links.extend(forest(table.slice(a, b - a)) for a, b in zip(at[:-1], at[1:], strict=True) if b - a > 1)

        def joined():
            found = stars(*(np.concatenate([np.zeros(0, np.int64), *(x[k] for x in links)]) for k in (0, 1)))
            links.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["a", "b"])

        for batch in batches:
            if batch.num_rows:
                table = pa.Table.from_batches([*held, batch])
                at = [0, *cuts(table).tolist()]
                forests(table, at)
                held = table.slice(at[-1]).combine_chunks().to_batches()  # the last group may go on
                if sum(len(x) for x, _ in links) > HELD_LINKS:
                    yield joined()
        if held:
            table = pa.Table.from_batches(held)
            forests(table, [0, table.num_rows])
        yield joined()
        held.clear()
        release()

    dealt = groups.withColumn("blocks", F.ceil(F.col("size") / block).cast("int"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # of two blocks or more, a pair of different ones covers the pairs within each as well
    dealt = dealt.where((F.col("blocks") == 1) | (F.col("block") != F.col("other")))
    columns = ["key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "sketch", *(["shingles"] if with_sets else [])]
    dealt = dealt.select(*columns).repartition(partitions(groups.sparkSession), "key", "i", "j")
    return dealt.sortWithinPartitions("key", "i", "j", F.xxhash64("node"), "node").mapInArrow(run, "a long, b long")


def candidates(classes: DataFrame) -> DataFrame:
    """a, b: a spanning forest, bucket by bucket, of nodes with close sketches."""
    members = classes.select("node", "sketch", F.explode("bands").alias("key"))
    members = members.withColumn("size", F.count("*").over(W.partitionBy("key"))).where(F.col("size") > 1)
    return _forests(members, BLOCK, with_sets=False)


def links(clusters: DataFrame, docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """a, b: a spanning forest of the links in each cluster (key, node, size, sketch).

    Texts are joined with the clusters by sorting at any size, as the clusters grow with the corpus."""

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            for a in range(0, batch.num_rows, 512):
                out = [shingle_set(data[offsets[i] : offsets[i + 1]].tobytes()).tobytes() for i in range(a, min(a + 512, batch.num_rows))]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, len(out)) for c in range(1, 5)), pa.array(out, pa.binary())], ["key", "node", "size", "sketch", "shingles"])
        release()

    texts = pick(docs, node=id_column, text=text_column).withColumn("node", F.col("node").cast("long")).join(clusters.hint("merge"), "node").select("text", "key", "node", "size", "sketch")
    return _forests(texts.mapInArrow(run, "key long, node long, size long, sketch binary, shingles binary"), LINK_BLOCK, with_sets=True)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text)."""
    rows = stored(signatures(docs), "signatures")
    classes = rows.where(F.col("class").isNotNull() & F.col("doc_id").isNotNull()).groupBy("class").agg(F.min("doc_id").alias("node"), F.any_value("bands").alias("bands"), F.any_value("sketch").alias("sketch"))
    cluster = components(candidates(classes))
    paths = [new_path(docs.sparkSession, "clusters") for _ in range(2)]
    # written down, so that a large cluster's rows can be split where they are joined
    sizes = stored(cluster.groupBy("component").agg(F.count("*").alias("size")), "sizes", paths[0])
    cluster = cluster.join(sizes.hint("merge"), "component").join(classes.select("node", "sketch").hint("merge"), "node")
    cluster = stored(cluster.select(F.col("component").alias("key"), "node", "size", "sketch"), "clusters", paths[1])
    of = components(links(cluster, docs))
    for path in paths:
        discard(docs.sparkSession, path)
    known = classes.select("class", "node").join(of, "node", "left").select("class", F.coalesce("component", "node").alias("component"))
    out = rows.select("doc_id", "n_shingles", "class").join(known, "class", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, but for those whose component has a smaller id."""
    gone = near_duplicates(pick(docs, doc_id=id_column, text=text_column)).where(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    key = F.col(f"_c{docs.columns.index(id_column)}")
    return numbered(docs).join(gone, key == F.col("_gone"), "left_anti").toDF(*docs.columns)
