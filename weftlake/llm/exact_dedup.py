"""Exact deduplication by two-pass Bloom filtering.

Pass one hashes every text in the JVM and marks hashes in a filter whose cells
saturate at two. A hash whose cells all reach two may be repeated, any other
hash surely is not. Pass two sends only the rows that may be repeated through a
shuffle, where their SHA-256 decides; all other rows pass straight through.

The filter takes ``bits_per_row`` cells a row up to ``max_bits`` (128 MB as one
bit a cell, the proven bound of what is broadcast). Beyond that bound more rows
take the shuffle, so that the result stays exact at every size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlake.llm.common import need
from weftlake.session import stash

PROBES = 3
BLOCK_BITS = 16
FLUSH_ROWS = 1 << 21
#: Groups of equal texts, of 60 bytes each, up to which their table is broadcast after they are counted.
BROADCAST_GROUPS = 200_000


def cells(h: np.ndarray, bits: int) -> np.ndarray:
    """The cells of each hash, one row for each probe; ``bits`` is a power of two."""
    h = h.astype(np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    with np.errstate(over="ignore"):
        return np.stack([((h + np.uint64(i) * step) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits.bit_length() + 1) for i in range(PROBES)])


def _mark(bits: int):
    """Arrow mapper: hashes to rows of (block, cells hit once, cells hit more than once)."""

    def flush(hashes: list[np.ndarray]) -> pa.RecordBatch:
        # A hash is marked once for each of its rows, at most twice: more can't raise a cell further.
        u, n = np.unique(np.concatenate(hashes), return_counts=True)
        at = np.concatenate([u, u[n > 1]])
        c, k = np.unique(cells(at, bits).reshape(-1), return_counts=True)
        block = (c >> np.uint64(BLOCK_BITS)).astype(np.int32)
        inner = (c & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.uint16)
        names, start = np.unique(block, return_index=True)
        ends = np.append(start[1:], len(block))
        once = [inner[a:b][k[a:b] == 1].tobytes() for a, b in zip(start, ends)]
        more = [inner[a:b][k[a:b] > 1].tobytes() for a, b in zip(start, ends)]
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(once, pa.binary()), pa.array(more, pa.binary())], ["block", "once", "more"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        rows = 0
        for b in batches:
            held.append(b.column(0).to_numpy(zero_copy_only=False))
            rows += b.num_rows
            if rows >= FLUSH_ROWS:
                yield flush(held)
                held, rows = [], 0
        if rows:
            yield flush(held)

    return run


def _merge(key: tuple, table: pa.Table) -> pa.Table:
    """All marks of one block to the bits of its cells that reach two."""
    count = np.zeros(1 << BLOCK_BITS, np.uint8)
    for once, more in zip(table.column("once").to_pylist(), table.column("more").to_pylist()):
        at = np.frombuffer(once, np.uint16)
        count[at] = np.minimum(count[at] + 1, 2)
        count[np.frombuffer(more, np.uint16)] = 2
    return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(count == 2, bitorder="little").tobytes()], pa.binary())})


def repeat_filter(hashes: DataFrame, rows: int, bits_per_row: int, max_bits: int) -> np.ndarray:
    """The filter over the one long column of ``hashes``, as packed bits: at most max_bits / 8 bytes."""
    bits = min(max_bits, 1 << max(BLOCK_BITS, (max(rows, 1) * bits_per_row - 1).bit_length()))
    marks = hashes.mapInArrow(_mark(bits), "block int, once binary, more binary")
    out = np.zeros(bits // 8, np.uint8)
    width = (1 << BLOCK_BITS) // 8
    for r in marks.groupBy("block").applyInArrow(_merge, "block int, bits binary").toLocalIterator(prefetchPartitions=True):
        out[r.block * width : (r.block + 1) * width] = np.frombuffer(r.bits, np.uint8)
    return out


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_row: int = 16, max_bits: int = 1 << 30) -> DataFrame:
    """One row for each document: id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty ones. Of equal texts the row with the largest id
    stays; a null id is smaller than all others, and of rows that share the
    largest id exactly one stays. An empty table gives no rows; other columns
    are not read.
    """
    need(docs, id_col, text_col)
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = stash(
        docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("sha"), F.xxhash64(text).alias("h")).withColumn("rid", F.monotonically_increasing_id()),
        "exact",
    )
    held = spark.sparkContext.broadcast(repeat_filter(base.select("h"), base.count(), bits_per_row, max_bits))

    @F.pandas_udf("boolean")
    def maybe_repeated(h):
        import pandas as pd

        f = held.value
        at = cells(h.to_numpy(), len(f) * 8)
        hit = np.ones(len(h), bool)
        for c in at:
            hit &= (f[(c >> np.uint64(3)).astype(np.int64)] >> (c & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return pd.Series(hit)

    rows = base.withColumn("maybe", maybe_repeated("h"))
    repeated = rows.filter("maybe").select("doc_id", "rid", "sha")
    # Written before the join, so that neither side of it is an aggregate: AQE can then split the rows of one hash.
    groups = stash(repeated.groupBy("sha").agg(F.max(F.struct("doc_id", "rid")).alias("keep"), F.count("*").alias("group_size")).filter("group_size > 1"), "groups")
    if groups.count() <= BROADCAST_GROUPS:
        groups = F.broadcast(groups)
    alone = F.col("group_size").isNull()
    shuffled = repeated.join(groups, "sha", "left").select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("rid") == F.col("keep.rid"))).alias("kept"),
        "sha",
    )
    straight = rows.filter("not maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    out = shuffled.unionByName(straight)
    return out.select(F.col("doc_id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))
