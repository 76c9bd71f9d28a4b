"""Toxicity scores from non-negative positive-unlabelled learning.

A linear model over hashed features of words is trained in numpy from confirmed toxic documents
and unlabelled ones. With the class prior p, the risk is p * R+(toxic as toxic) + max(0, R-(unlabelled
as clean) - p * R+(toxic as clean)); where the second part turns negative, its gradient is reversed
instead, which keeps the model from fitting the unlabelled toxic documents as clean.

Training uses a bounded sample: POSITIVES toxic and UNLABELLED other documents, those with the
smallest hashes of their ids. How often each feature occurs in it is counted on the executors; the
driver gets the features that tell, and of the sample those alone. Every document is scored, over
its whole text.

Defined results: a null or empty text has no features and gets the score of the bias; a null id
belongs to no training row and isn't held out; repeated rows get equal scores. An id is confirmed
if any of its labels is 1; other labels and null count as not 1. Of an id with several texts, one
text (that with the least features in byte order) may be learnt from, and each is scored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.llm.common import passed_through, pick, release, row_groups, stored, text_bytes

POSITIVES, UNLABELLED, BITS = 3000, 9000, 18
#: A feature counts if so many confirmed documents have it, so many times the
#: share of the unlabelled, and more than chance explains by so many standard errors.
LEAST, SHARE, RATIO, SIGMAS = 3, 0.008, 2.5, 5.0
STEPS, RATE, DECAY, SEED = 500, 0.1, 1e-6, 7
FOLDS = 5
CACHE_ENTRIES, CACHED_WORD_BYTES, CHUNK_BYTES = 1 << 18, 40, 1 << 21
_WORD = re.compile(rb"[a-z0-9\x80-\xff]+")


def word_features(word: bytes) -> tuple[int, ...]:
    """A word's features: itself, and its beginnings of four, five and six bytes if it is longer."""
    import xxhash

    names = [b"w" + word, *(b"p" + word[:n] for n in (4, 5, 6) if len(word) > n)]
    return tuple(xxhash.xxh3_64_intdigest(x) & ((1 << BITS) - 1) for x in names)


def words_of(text: bytes) -> set[bytes]:
    return set(_WORD.findall(text.lower()))


def features(text: bytes) -> np.ndarray:
    """The distinct hashed features of the whole text."""
    return np.array(sorted({f for w in words_of(text) for f in word_features(w)}), np.int32)


@dataclass
class Model:
    """The features with a weight, ascending, their weights, and the bias."""

    used: np.ndarray
    values: np.ndarray
    bias: float

    def scores(self, texts: list[bytes], cache: dict) -> np.ndarray:
        """``cache``: of the words met so far, the features with a weight."""
        out, weights = np.empty(len(texts)), dict(zip(self.used.tolist(), self.values.tolist(), strict=True))
        for i, text in enumerate(texts):
            heavy: set[int] = set()
            for w in words_of(text):
                if (own := cache.get(w)) is None:
                    own = tuple(f for f in word_features(w) if f in weights)
                    if len(cache) < CACHE_ENTRIES and len(w) <= CACHED_WORD_BYTES:
                        cache[w] = own
                if own:
                    heavy.update(own)
            out[i] = self.bias + sum(weights[f] for f in sorted(heavy))
        return 1 / (1 + np.exp(-np.clip(out, -60, 60)))


def tells(toxic, other, positives: int, unlabelled: int, sqrt):
    """Whether a feature that so many documents of either kind have tells for toxicity; numpy arrays or columns."""
    p, u = (toxic + 0.5) / (positives + 1), (other + 0.5) / (unlabelled + 1)
    error = sqrt(u * (1 - u) * (1 / positives + 1 / unlabelled))
    return (toxic >= max(LEAST, SHARE * positives)) & (p >= RATIO * u) & (p - u >= SIGMAS * error)


def risk(z: np.ndarray, is_pos: np.ndarray, prior: float) -> tuple[float, np.ndarray]:
    """The non-negative risk of the scores z, and how it pulls on each. Where the unlabelled part is below
    zero, that part's gradient is reversed and stands alone."""
    z = np.clip(z, -60, 60)
    s, cost = 1 / (1 + np.exp(-z)), np.logaddexp(0, z)  # of calling a clean document toxic
    share = np.where(is_pos, 1 / max(is_pos.sum(), 1), 1 / max((~is_pos).sum(), 1))
    clean = np.where(is_pos, -prior * s, s) * share
    rest = float((np.where(is_pos, -prior * cost, cost) * share).sum())
    toxic = float((np.where(is_pos, prior * (cost - z), 0) * share).sum())
    if rest >= 0:
        return toxic + rest, clean + np.where(is_pos, -prior * (1 - s), 0) * share
    return toxic, -clean


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = STEPS) -> Model:
    """Non-negative risk, logistic loss, Adam on mini-batches. Evidence only adds up: features that
    tell for toxicity get weights of zero or more, so that a text's length doesn't hide them, and a text without evidence is no likelier toxic than
    the prior. No positives: everything is clean."""
    if not positive or not unlabelled:
        return Model(np.zeros(0, np.int64), np.zeros(0), -4.0)
    rng = np.random.default_rng(SEED)

    def counted(rows):
        return np.bincount(np.concatenate(rows), minlength=1 << BITS).astype(float)

    telling = tells(counted(positive), counted(unlabelled), len(positive), len(unlabelled), np.sqrt)
    used = np.flatnonzero(telling)
    place = np.zeros(1 << BITS, np.int64)
    place[used] = np.arange(len(used))
    rows = [place[r[telling[r]]] for r in [*positive, *unlabelled]]
    n, most = len(positive), float(np.log(prior / (1 - prior)))
    w, b, mean, var, bm, bv = np.zeros(len(used)), most, np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
    for step in range(1, steps + 1):
        pos = rng.choice(n, min(n, 512), replace=False)
        unl = n + rng.choice(len(unlabelled), min(len(unlabelled), 1536), replace=False)
        take = np.concatenate([pos, unl])
        size = np.array([len(rows[i]) for i in take])
        flat = np.concatenate([rows[i] for i in take])
        owner = np.repeat(np.arange(len(take)), size)
        z = np.bincount(owner, w[flat], len(take)) + b
        _, pull = risk(z, np.arange(len(take)) < len(pos), prior)
        grad = np.bincount(flat, pull[owner], len(used)) + DECAY * w
        gb = pull.sum()
        mean, var = 0.9 * mean + 0.1 * grad, 0.999 * var + 0.001 * grad**2
        bm, bv = 0.9 * bm + 0.1 * gb, 0.999 * bv + 0.001 * gb**2
        fix = RATE * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
        w = np.maximum(w - fix * mean / (np.sqrt(var) + 1e-8), 0)
        b = min(b - fix * bm / (np.sqrt(bv) + 1e-8), most)
    heavy = np.abs(w) >= 1e-3
    return Model(used[heavy], w[heavy], float(b))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def _learnt_from(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """positive, features binary: of each of the ``chosen`` ids (doc_id, positive) that ``rows`` has."""

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            out = [features(data[offsets[i] : offsets[i + 1]].tobytes()).tobytes() for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(out, pa.binary())], ["doc_id", "positive", "features"])
        release()

    own = rows.join(F.broadcast(chosen), "doc_id").select("text", "doc_id", "positive")  # ids of a bounded number
    kind = rows.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(run, f"doc_id {kind}, positive boolean, features binary").groupBy("doc_id", "positive").agg(F.min("features").alias("features"))


def _counted(sample: DataFrame) -> DataFrame:
    """feature, toxic, other: in how many documents of either kind each feature occurs."""

    def run(batches):
        total = np.zeros((2, 1 << BITS), np.int64)
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            kind = np.repeat(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), np.diff(offsets) // 4)
            total += np.bincount(kind << BITS | data.view(np.int32), minlength=2 << BITS).reshape(2, -1)
        at = np.flatnonzero(total.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[1, at]), pa.array(total[0, at])], ["feature", "toxic", "other"])
        release()

    parts = sample.select("positive", "features").mapInArrow(run, "feature long, toxic long, other long")
    return parts.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def _kept(sample: DataFrame, telling: np.ndarray) -> dict[bool, list[np.ndarray]]:
    """Of each document of the sample those of its features that tell, by whether it is confirmed."""

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            own = data.view(np.int32)
            tell = np.isin(own, telling)
            ends = np.concatenate([[0], np.cumsum(tell)])[offsets // 4].astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(own[tell]))], ["positive", "features"])

    out: dict[bool, list[np.ndarray]] = {True: [], False: []}
    for r in sorted(sample.select("positive", "features").mapInArrow(run, "positive boolean, features array<int>").collect()):
        out[r.positive].append(np.array(r.features, np.int32))
    return out


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic") -> Model:
    """A model from the documents outside the held-out fold; the driver gets the telling features of
    POSITIVES + UNLABELLED documents at most. The prior is the share of confirmed ones among the ids with labels."""
    rows = pick(docs, doc_id=id_column, text=text_column).where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = pick(labels, doc_id=id_column, toxic=label_column).where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic") == 1).alias("toxic"))
    shares = known.agg(F.count("*").alias("n"), F.count_if("toxic").alias("k")).first()
    prior = min(max((shares.k or 0) / shares.n, 0.001), 0.5) if shares.n else 0.05
    order = F.xxhash64(F.col("doc_id"), F.lit(SEED))
    there = rows.select("doc_id").distinct()
    toxic = known.where("toxic").select("doc_id").join(there, "doc_id", "left_semi").orderBy(order, "doc_id").limit(POSITIVES)
    rest = there.orderBy(order, "doc_id").limit(UNLABELLED)
    chosen = toxic.select("doc_id", F.lit(True).alias("positive")).unionByName(rest.select("doc_id", F.lit(False).alias("positive")))
    sample = stored(_learnt_from(rows, chosen), "sample")
    n = {r.positive: r.n for r in sample.groupBy("positive").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return train([], [], prior)
    telling = _counted(sample).where(tells(F.col("toxic"), F.col("other"), n[True], n[False], F.sqrt)).select("feature").collect()
    kept = _kept(sample, np.array(sorted(r.feature for r in telling), np.int32))
    return train(kept[True], kept[False], prior)


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, score: the model goes with the tasks, the few features that have a weight."""

    def run(batches):
        cache: dict = {}
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            out = []
            for a, b in row_groups(offsets, CHUNK_BYTES):
                out.append(model.scores([data[offsets[i] : offsets[i + 1]].tobytes() for i in range(a, b)], cache))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out) if out else [], pa.float64())], ["doc_id", "score"])
        cache.clear()
        release()

    source = pick(docs, doc_id=id_column, text=text_column)
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, score double")


def without_toxic(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that score under one half."""
    model = fit(docs, labels, id_column, text_column)
    place = docs.columns.index(text_column)

    def run(batches):
        cache: dict = {}
        for batch in batches:
            data, offsets = text_bytes(batch.column(place))
            out = [model.scores([data[offsets[i] : offsets[i + 1]].tobytes() for i in range(a, b)], cache) for a, b in row_groups(offsets, CHUNK_BYTES)]
            if out:
                yield batch.filter(pa.array(np.concatenate(out) < 0.5))
        cache.clear()
        release()

    return passed_through(docs, run)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    rows = score(docs, fit(docs, labels))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
