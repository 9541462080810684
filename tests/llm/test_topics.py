"""The topic model's matrices are bounded, however short the texts of a batch are."""

import numpy as np
import pyarrow as pa

from weftlake.llm import topics
from weftlake.llm.arrays import slices


def test_many_short_texts_are_counted_in_bounded_matrices(monkeypatch):
    texts = [f"w{k % 97} v{k % 11}" for k in range(10_000)] + ["", None]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    assert max(len(t) for _, t in slices(batch, 0, topics.SLICE_BYTES, topics.SLICE_ROWS)) == topics.SLICE_ROWS
    assert sum((t.to_pylist() for _, t in slices(batch, 0, topics.SLICE_BYTES, topics.SLICE_ROWS)), []) == [t or "" for t in texts]
    seen, plain = [], topics.counted

    def watched(t):
        n, counts = plain(t)
        seen.append(counts.shape[0])
        return n, counts

    monkeypatch.setattr(topics, "counted", watched)
    got = {b: n for b, n in zip(*(c.to_pylist() for c in next(topics._filled(iter([batch]))).columns))}
    assert max(seen) == topics.SLICE_ROWS and got[-1] == len(texts)
    whole = (plain(pa.array([t or "" for t in texts]))[1] > 0).sum(axis=0)
    assert np.array_equal(whole, [got[k] for k in range(topics.BUCKETS)])


def test_topics_do_not_depend_on_slices(monkeypatch):
    texts = [f"w{k % 7} x{k % 5} y{k % 3}" for k in range(300)] + ["", None]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(texts)], ["c0", "text"])
    model = topics.TopicModel(np.full(topics.BUCKETS, 256.0), np.random.default_rng(4).integers(-99, 99, (4, topics.DIMS)).astype(float))

    def run():
        return pa.Table.from_batches(list(topics._with_topics(iter([batch]), model))).select(["n", "topic"]).to_pylist()

    want = run()
    monkeypatch.setattr(topics, "SLICE_ROWS", 7)
    assert run() == want and want[-1] == {"n": 0, "topic": "none"}
