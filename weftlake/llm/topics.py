"""Topics by spherical k-means over hashed words, fitted to all texts.

Lower-cased words fall into ``BUCKETS`` buckets by their hashes. A text's counts,
damped by a logarithm and weighted by how few texts fill a bucket, are projected
on ``DIMS`` signed sums; these directions are clustered. Everything that is added
up is a whole number, so that a fit depends neither on partitions nor on order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlake.llm.arrays import mix, slices
from weftlake.llm.recompression import Words, word_hashes
from weftlake.session import drop_stash, stash

BUCKETS = 4096
DIMS = 64
TOPICS = 8
ROUNDS = 8
SLICE_BYTES = 1 << 20
#: Texts whose counts stand in one matrix: 16 MB of numbers.
SLICE_ROWS = 512
#: Steps of one of a bucket's weight, of a direction and of a centre.
WEIGHT, SCALE, GRAIN = 256, 1000, 4096


def counted(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(words, matrix of words by bucket) of each text."""
    w = Words(pc.ascii_lower(texts))
    coded = w.array.dictionary_encode()
    bucket = (word_hashes(coded.dictionary) % np.uint64(BUCKETS)).astype(np.int64)[coded.indices.to_numpy()]
    at = np.repeat(np.arange(len(w.n)), w.n) * BUCKETS + bucket
    return w.n, np.bincount(at, minlength=len(w.n) * BUCKETS).reshape(-1, BUCKETS)


def signs() -> np.ndarray:
    """One or minus one for each bucket and dimension."""
    bits = np.unpackbits(mix(np.arange(1, BUCKETS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.uint8).reshape(-1, 8), axis=1)
    return bits[:, :DIMS].astype(np.float64) * 2 - 1


@dataclass(frozen=True)
class TopicModel:
    """Weights of the buckets and centres, all whole numbers."""

    weight: np.ndarray
    centres: np.ndarray

    def directions(self, n: np.ndarray) -> np.ndarray:
        """Whole-numbered directions of SCALE's length of a matrix of counts; zero for texts without words."""
        y = np.rint(np.log2(1 + n) * self.weight) @ signs()  # exact: whole numbers below 2^53
        size = np.sqrt((y * y).sum(axis=1, keepdims=True))
        return np.rint(np.divide(y * SCALE, size, out=np.zeros_like(y), where=size > 0))

    def nearest(self, x: np.ndarray) -> np.ndarray:
        return np.argmax(x.astype(np.float64) @ self.centres.T, axis=1)  # exact; the first of equally near ones

    def topics(self, texts: pa.Array) -> tuple[np.ndarray, list[str]]:
        """(words, topic) of each text; texts without words have the topic ``none``."""
        n, counts = counted(texts)
        k = self.nearest(self.directions(counts))
        return n, ["none" if not m else f"topic{i}" for m, i in zip(n, k)]


def _filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, rows = np.zeros(BUCKETS, np.int64), 0
    for b in batches:
        for _, texts in slices(b, 0, SLICE_BYTES, SLICE_ROWS):
            total += (counted(texts)[1] > 0).sum(axis=0)
            rows += len(texts)
    yield pa.RecordBatch.from_arrays([pa.array([*range(BUCKETS), -1]), pa.array([*total.tolist(), rows])], ["bucket", "n"])


def _directions(batches: Iterator[pa.RecordBatch], model: TopicModel) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for _, texts in slices(b, 0, SLICE_BYTES, SLICE_ROWS):
            x = model.directions(counted(texts)[1])
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x[x.any(axis=1)].astype("<i2")], pa.binary())], ["x"])


def _sums(batches: Iterator[pa.RecordBatch], model: TopicModel) -> Iterator[pa.RecordBatch]:
    total = np.zeros((len(model.centres), DIMS), np.int64)
    for b in batches:
        x = np.frombuffer(b"".join(b.column("x").to_pylist()), "<i2").reshape(-1, DIMS).astype(np.int64)
        np.add.at(total, model.nearest(x), x)
    k, d = np.divmod(np.arange(total.size), DIMS)
    yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(d), pa.array(total.reshape(-1))], ["k", "d", "s"])


def fit_topics(docs: DataFrame, text_col: str = "text", topics: int = TOPICS, rounds: int = ROUNDS) -> TopicModel:
    """A model of at most ``topics`` topics after ``rounds`` rounds over all texts; the driver gets sums by bucket and by centre."""
    texts = docs.select(text_col)
    filled = {r.bucket: r.n for r in texts.mapInArrow(_filled, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()}
    n = np.array([filled.get(k, 0) for k in range(BUCKETS)])
    weight = np.rint(WEIGHT * np.log2((filled.get(-1, 0) + 1) / (n + 1)))
    model = TopicModel(weight, np.zeros((1, DIMS)))
    x = stash(texts.mapInArrow(partial(_directions, model=model), "x binary"), "directions")
    first = x.distinct().orderBy(F.xxhash64("x"), "x").limit(topics).collect()
    if not first:
        return model
    centres = np.stack([np.frombuffer(r.x, "<i2") for r in first]).astype(np.float64)
    for _ in range(rounds):
        model = TopicModel(weight, centres)
        new = np.zeros_like(centres)
        for r in x.mapInArrow(partial(_sums, model=model), "k long, d long, s long").groupBy("k", "d").agg(F.sum("s").alias("s")).collect():
            new[r.k, r.d] = r.s
        size = np.sqrt((new * new).sum(axis=1, keepdims=True))
        new = np.where(size > 0, np.rint(GRAIN * new / np.where(size > 0, size, 1)), centres)
        if (new == centres).all():
            break
        centres = new
    drop_stash(x)
    return TopicModel(weight, centres)


def _with_topics(batches: Iterator[pa.RecordBatch], model: TopicModel) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for rows, texts in slices(b, b.num_columns - 1, SLICE_BYTES, SLICE_ROWS):
            n, topic = model.topics(texts)
            keep = rows.num_columns - 1
            yield pa.RecordBatch.from_arrays([*rows.columns[:keep], pa.array(n, pa.int64()), pa.array(topic, pa.string())], [*rows.schema.names[:keep], "n", "topic"])


def with_topics(docs: DataFrame, model: TopicModel, text_col: str, n_out: str, topic_out: str, keep_text: bool = True) -> DataFrame:
    """Every row with its columns (the text's may be left out), the number of its words and its topic; a null text has no words."""
    kept = [c for c in docs.columns if keep_text or c != text_col]
    plain = docs.select(*kept, F.col(text_col)).toDF(*[f"c{k}" for k in range(len(kept) + 1)])
    schema = plain.select(*plain.columns[:-1]).schema.add("n", "long").add("topic", "string")
    return plain.mapInArrow(partial(_with_topics, model=model), schema).toDF(*kept, n_out, topic_out)
