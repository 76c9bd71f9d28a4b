"""Near-duplicate embeddings: cross-polytope hashing after fast Hadamard rotations.

A vector is rotated by three rounds of random signs and a fast Hadamard transform; the coordinate
that is largest in size, with its sign, is the nearest vertex of the cross-polytope and its hash.
Each of TABLES tables puts together the hashes of HASHES rotations of its own, which makes buckets
many and small. A vector goes into the buckets of every choice among its PROBES nearest vertices of
each, so two vectors meet where one's best vertex is only the other's second best: at a cosine of
0.98 in 64 dimensions, in 95 of 100 tables.

Vectors are compared only within a label. Equal vectors form a class with a count and stand for
one point. In every bucket, blocks of points are compared by matrix products in double precision; a
pair is counted in the first of the buckets that both points are in, so that it counts once. What
leaves a task are the number of links of each point and a spanning forest of the links, never the
pairs themselves.

Defined results: a null label, and a vector that is null, zero or has null or non-finite
components, links with nothing. Null ids are left as they are and link with nothing either;
repeated ids are links' ends of their own and count as such. Vectors of other lengths than the
most common are compared among their own length.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.llm.common import partitions, pick, stored
from tamarack.llm.components import components

COSINE, TABLES, HASHES, PROBES, BLOCK, SEED = 0.98, 4, 2, 2, 512, 5


@functools.cache
def _signs(width: int, tables: int) -> np.ndarray:
    return np.random.default_rng([SEED, width]).choice([-1.0, 1.0], (tables, 3, width))


def _hadamard(x: np.ndarray) -> np.ndarray:
    """The transform of each row, whose length is a power of two."""
    n, h = x.shape[-1], 1
    while h < n:
        y = x.reshape(*x.shape[:-1], n // (2 * h), 2, h)
        x = np.stack([y[..., 0, :] + y[..., 1, :], y[..., 0, :] - y[..., 1, :]], -2).reshape(x.shape)
        h *= 2
    return x


def vertices(rows: np.ndarray, tables: int = TABLES * HASHES, probes: int = PROBES) -> np.ndarray:
    """The nearest vertices of each row under each rotation, the nearest first: rows x tables x probes."""
    width = 1 << max(1, (rows.shape[1] - 1).bit_length())
    padded = np.zeros((len(rows), width))
    padded[:, : rows.shape[1]] = rows
    out = np.empty((len(rows), tables, min(probes, width)), np.int32)
    for t in range(tables):
        x = padded
        for signs in _signs(width, tables)[t]:
            x = _hadamard(x * signs)
        size = np.abs(x)
        best = np.argsort(-size, 1, kind="stable")[:, : out.shape[2]]
        out[:, t] = 2 * best + (np.take_along_axis(x, best, 1) < 0)
    return out


def bucket_codes(rows: np.ndarray) -> np.ndarray:
    """The buckets of each row, table by table: every choice of a probe from each of the table's hashes."""
    v = vertices(rows).astype(np.int64)
    v = v.reshape(len(rows), TABLES, HASHES, v.shape[2])
    out = np.broadcast_to(np.arange(TABLES)[:, None], (len(rows), TABLES, 1))
    for h in range(HASHES):
        out = (out[..., None] * (2 << max(1, (rows.shape[1] - 1).bit_length())) + v[:, :, h, None, :]).reshape(len(rows), TABLES, -1)
    return out.reshape(len(rows), -1)


def _points(rows: DataFrame) -> DataFrame:
    """label, key (the vector's bytes), vector binary of doubles, ok: whether it can link at all."""

    def run(batches):
        for batch in batches:
            label, column = batch.column(0), batch.column(2)
            size = pc.fill_null(pc.list_value_length(column), 0).to_numpy().astype(np.int64)
            at = np.concatenate([[0], np.cumsum(size)])
            x = pc.cast(pc.list_flatten(column), pa.float64()).fill_null(np.nan).to_numpy() + 0.0  # minus zero is zero
            within = lambda marks, at=at: np.diff(np.concatenate([[0], np.cumsum(marks)])[at])
            fine = label.is_valid().to_numpy(zero_copy_only=False) & (within(np.isfinite(x)) == size) & (within(x != 0) > 0)
            vectors = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(8 * at), pa.py_buffer(x)])
            yield pa.RecordBatch.from_arrays([label, batch.column(1), vectors.cast(pa.binary()), pa.array(fine)], ["label", "vec_id", "vector", "fine"])

    return rows.select("label", "vec_id", "vector").mapInArrow(run, f"label {rows.schema['label'].dataType.simpleString()}, vec_id long, vector binary, fine boolean")


def _bucketed(points: DataFrame) -> DataFrame:
    """point, n, vector, codes, and key: a row for each bucket of each point."""

    def run(batches):
        for batch in batches:
            by_width: dict[int, list[int]] = {}
            raw = [x.as_py() for x in batch.column(2)]
            for i, x in enumerate(raw):
                by_width.setdefault(len(x), []).append(i)
            for at in by_width.values():
                x = np.stack([np.frombuffer(raw[i], np.float64) for i in at])
                unit = x / np.abs(x).max(1, keepdims=True)
                unit /= np.sqrt((unit * unit).sum(1, keepdims=True))
                codes = bucket_codes(unit)
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in (0, 1)), pa.array([u.tobytes() for u in unit], pa.binary()), batch.column(3).take(take), pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * codes.shape[1], pa.int32()), pa.array(codes.reshape(-1)))], ["point", "n", "vector", "label_key", "codes"])

    hashed = points.select("point", "n", "vector", "label_key").mapInArrow(run, "point long, n long, vector binary, label_key long, codes array<long>")
    return hashed.withColumn("code", F.explode("codes"))


def _compared(groups: DataFrame, cosine: float) -> DataFrame:
    """a, b, n: for b null, point a has n more links; else the link (a, b) of a spanning forest."""

    def look(part: pa.Table):
        code, same = int(part.column("code")[0].as_py()), bool(part.column("i")[0].as_py() == part.column("j")[0].as_py())
        node, n, block = (part.column(c).to_numpy() for c in ("point", "n", "block"))
        unit = np.stack([np.frombuffer(x.as_buffer(), np.float64) for x in part.column("vector")])
        codes = np.stack([x.values.to_numpy() for x in part.column("codes")])
        probes = codes.shape[1] // TABLES
        labels, count, edges = np.arange(len(node)), np.zeros(len(node), np.int64), []
        for p in range(0, len(node), 256):
            rows = slice(p, min(p + 256, len(node)))
            near = unit[rows] @ unit.T >= cosine
            near &= np.arange(len(node)) > np.arange(p, rows.stop)[:, None]
            if not same:
                near &= block[rows][:, None] != block
            x, y = np.nonzero(near)
            if not len(x):
                continue
            x += p
            for a in range(0, len(x), 1 << 14):
                u, v = x[a : a + (1 << 14)], y[a : a + (1 << 14)]
                one, other = codes[u].reshape(len(u), -1, probes, 1), codes[v].reshape(len(u), -1, 1, probes)
                earlier = ((one == other) & (one < code)).any((1, 2, 3))  # they met in a bucket before this one
                u, v = u[~earlier], v[~earlier]
                np.add.at(count, u, n[v])
                np.add.at(count, v, n[u])
                while (apart := labels[u] != labels[v]).any():
                    s, t = u[apart.argmax()], v[apart.argmax()]
                    edges.append((node[s], node[t]))
                    labels[labels == labels[t]] = labels[s]
        has = np.flatnonzero(count)
        return [node[has], *([np.array([e[0] for e in edges], np.int64)])], [np.array([e[1] for e in edges], np.int64)], count[has]

    def cuts(table: pa.Table) -> list[int]:
        k, c, i, j = (table.column(x).to_numpy() for x in ("label_key", "code", "i", "j"))
        return (np.flatnonzero((k[1:] != k[:-1]) | (c[1:] != c[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1).tolist()

    def run(batches):
        held: list[pa.RecordBatch] = []

        def out(table: pa.Table, at: list[int]):
            for lo, hi in zip(at[:-1], at[1:], strict=True):
                if hi - lo > 1:
                    (own, a), (b,), count = look(table.slice(lo, hi - lo).combine_chunks())
                    if len(own) or len(a):
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([own, a]), pa.int64()), pa.concat_arrays([pa.nulls(len(own), pa.int64()), pa.array(b, pa.int64())]), pa.concat_arrays([pa.array(count, pa.int64()), pa.nulls(len(b), pa.int64())])], ["a", "b", "n"])

        for batch in batches:
            if batch.num_rows:
                table = pa.Table.from_batches([*held, batch])
                at = [0, *cuts(table)]
                yield from out(table, at)
                held = table.slice(at[-1]).combine_chunks().to_batches()  # the last group may go on
        if held:
            table = pa.Table.from_batches(held)
            yield from out(table, [0, table.num_rows])

    sizes = groups.groupBy("label_key", "code").agg(F.count("*").alias("size")).where(F.col("size") > 1)
    dealt = groups.join(sizes, ["label_key", "code"]).withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("point", F.lit(3)), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("label_key", "code", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "point", "n", "vector", "codes")
    dealt = dealt.repartition(partitions(groups.sparkSession), "label_key", "code", "i", "j").sortWithinPartitions("label_key", "code", "i", "j", "point")
    return dealt.mapInArrow(run, "a long, b long, n long")


def near_duplicates(rows: DataFrame, cosine: float = COSINE, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    source = pick(rows, vec_id=id_column, vector=vector_column, label=label_column)
    source = stored(_points(source.withColumn("vec_id", F.col("vec_id").cast("long"))), "vectors")
    can = source.where(F.col("fine") & F.col("vec_id").isNotNull())
    # equal vectors of a label are one point, named by its smallest id
    points = can.groupBy("label", "vector").agg(F.min("vec_id").alias("point"), F.count("*").alias("n"))
    points = stored(points.withColumn("label_key", F.xxhash64("label", F.octet_length("vector"))), "points")
    found = stored(_compared(_bucketed(points), cosine), "found")
    counts = found.where(F.col("b").isNull()).groupBy(F.col("a").alias("point")).agg(F.sum("n").alias("more"))
    of = components(found.where(F.col("b").isNotNull()).select("a", "b"))
    known = points.join(counts, "point", "left").join(of.withColumnRenamed("node", "point"), "point", "left")
    known = known.select("label", "vector", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("component", "point").alias("component"))
    out = source.join(known.withColumn("fine", F.lit(True)), ["label", "vector", "fine"], "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id"))
    links = F.when(F.col("vec_id").isNull(), 0).otherwise(F.coalesce("n_links", F.lit(0))).cast("long")
    return out.select("vec_id", links.alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))
