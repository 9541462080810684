"""Sharding by sampled splitters.

A size-weighted sample of keys gives quantile boundaries; records are
range-partitioned by them. Overfull ranges are subdivided: by splitters sampled
within them, a key that is too large for a range becoming a range of its own, and
only such ranges of one key by row. The pieces, whose exact sizes are then known,
fill the shards longest first. The key is the hash of the text, so that equal
texts fall into one range. They stay in one shard unless they alone exceed a
shard's share: then their parts go to several shards, as none could hold them.

Only DataFrame functions are used. The driver sees the sample and one row for
each piece; both are bounded by ``max_ranges`` and not by the input.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from weftlake.llm.common import need, unit_hash
from weftlake.session import stash

#: Times that bounds are refined; a sample that still leaves an overfull range makes shards less even.
ATTEMPTS = 4


def quantile_bounds(sample: list[tuple[int, float]], ranges: int) -> list[int]:
    """Ascending keys that cut the weighted sample into about ``ranges`` equal parts; a key equal to a bound belongs to the part above it."""
    sample = sorted(sample)
    total = sum(w for _, w in sample)
    out: list[int] = []
    seen, k = 0.0, 1
    for key, w in sample:
        if seen >= k * total / ranges and (not out or key > out[-1]):
            out.append(key)
        while seen >= k * total / ranges:
            k += 1
        seen += w
    return out


def fill_shards(bundles: list[list[tuple]], n_shards: int) -> list[tuple]:
    """Deal bundles of (bytes, rows, range, part), largest first, each to the emptiest shard; (range, part, shard, first slot) for each piece."""
    load = [(0, 0, s) for s in range(n_shards)]
    heapq.heapify(load)
    at: list[list[tuple]] = [[] for _ in range(n_shards)]
    for b in sorted(bundles, key=lambda b: (-sum(p[0] for p in b), b[0][2:])):
        size, rows, s = heapq.heappop(load)
        at[s] += b
        heapq.heappush(load, (size + sum(p[0] for p in b), rows + sum(p[1] for p in b), s))
    out = []
    for s, pieces in enumerate(at):
        slot = 0
        for _, n, rng, part in sorted(pieces, key=lambda p: p[2:]):
            out.append((rng, part, s, slot))
            slot += n
    return out


def with_ranges(base: DataFrame, bounds: list[int]) -> DataFrame:
    """``base`` with ``rng``, the number of the bounds that aren't above its key. The key's leading bits name the few bounds that it must still be held against."""
    bits = max(1, len(bounds).bit_length())
    table, below = [], 0
    for b in range(-(1 << bits - 1), 1 << bits - 1):
        first = below
        while below < len(bounds) and bounds[below] >> 64 - bits == b:
            below += 1
        table.append((b, first, bounds[first:below]))
    index = base.sparkSession.createDataFrame(table, T.StructType().add("lead", T.IntegerType()).add("first", T.IntegerType()).add("bounds", T.ArrayType(T.LongType())))
    return (
        base.withColumn("lead", F.shiftright("key", 64 - bits).cast("int"))
        .join(F.broadcast(index), "lead")  # a bounded number of rows and bounds
        .withColumn("rng", F.col("first") + F.size(F.filter("bounds", lambda x: x <= F.col("key"))))
        .drop("lead", "first", "bounds")
    )


def sampled(rows: DataFrame, rate, salt: int) -> list[tuple]:
    """(rng or 0, key, weight) of a size-weighted sample, summed by key; rows are drawn one by one, equal ones too."""
    rng = F.col("rng") if "rng" in rows.columns else F.lit(0).alias("rng")
    drawn = rows.filter(unit_hash(F.col("rid"), F.lit(salt)) < F.col("size") * rate).select(rng, "key", F.greatest(F.col("size").cast("double"), 1 / rate).alias("w"))
    return [tuple(r) for r in drawn.groupBy("rng", "key").agg(F.sum("w")).toLocalIterator()]


def shard_by_bytes(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text", samples_per_range: int = 32, rows_per_range: int = 200_000, max_ranges: int = 1 << 16) -> DataFrame:
    """Rows of (id, size, text_crc32, law, shard, slot, grown_shard); law ``bytes``: shards hold nearly equal bytes.

    Size is the UTF-8 bytes of the text plus one; a null text has size one and
    the checksum of the empty text. Equal texts share a shard unless they alone
    exceed a shard's share. Slots count from 0 in each shard. Repeated rows and
    null ids each take a slot of their own. An empty table gives no rows. Other
    columns are not read.
    """
    need(docs, id_col, text_col)
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = stash(
        docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("key"), F.monotonically_increasing_id().alias("rid")),
        "shard",
    )
    rows, total = base.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    n_ranges = min(max_ranges, max(64 * n_shards, math.ceil(rows / rows_per_range)))
    share, aim = total / n_shards, max(total / n_ranges, 1)
    bounds = quantile_bounds([(k, w) for _, k, w in sampled(base, F.lit(samples_per_range / aim), 17)], n_ranges)

    # Overfull ranges get splitters of their own; a key that fills a range by itself becomes a range.
    single: set[int] = set()
    for attempt in range(ATTEMPTS):
        ranged = with_ranges(base, bounds)
        sizes = ranged.groupBy("rng").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()  # one row a range
        start = [None, *bounds]
        over = {r.rng: math.ceil(r.b / aim) for r in sizes if r.b > 2 * aim and r.n > 1 and start[r.rng] not in single}
        if not over or attempt == ATTEMPTS - 1:
            break
        wide = ranged.join(F.broadcast(spark.createDataFrame(list(over), "int").toDF("rng")), "rng")
        heavy = [r.key for r in wide.groupBy("key").agg(F.sum("size").alias("b")).filter(F.col("b") > aim).select("key").collect()]  # fewer than ranges
        single |= set(heavy)
        rest = wide.join(F.broadcast(spark.createDataFrame(heavy, "long").toDF("key")), "key", "left_anti")
        by: dict[int, list] = {}
        for rng, key, w in sampled(rest, F.lit(2 * samples_per_range / aim), 18 + attempt):
            by.setdefault(rng, []).append((key, w))
        more = {x for rng, keys in by.items() for x in quantile_bounds(keys, over[rng])} | {x for k in heavy for x in (k, k + 1) if x < 1 << 63}
        bounds = sorted(set(bounds) | more)

    # Ranges of one key beyond a range's aim are dealt into parts by row; they fill one shard together if they fit its share.
    overfull = [(r.rng, math.ceil(r.b / aim)) for r in sizes if r.b > 2 * aim and r.n > 1]
    cuts = spark.createDataFrame(overfull, "rng int, parts int")
    nth_part = F.floor(unit_hash(F.col("rid"), F.lit(3)) * F.col("parts")).cast("int")
    parted = ranged.join(F.broadcast(cuts), "rng", "left").withColumn("part", F.coalesce(nth_part, F.lit(0)))
    split = {r for r, _ in overfull}
    bundles: dict = {r.rng: [(r.b, r.n, r.rng, 0)] for r in sizes if r.rng not in split}
    if overfull:
        again: dict = {}
        for r in parted.filter("parts is not null").groupBy("rng", "part").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect():  # at most two a range
            again.setdefault(r.rng, []).append((r.b, r.n, r.rng, r.part))
        for rng, pieces in again.items():
            if sum(p[0] for p in pieces) <= share:
                bundles[rng] = pieces
            else:
                bundles |= {(rng, p[3]): [p] for p in pieces}
    place = spark.createDataFrame(fill_shards(list(bundles.values()), n_shards), "rng int, part int, shard int, start long")
    inner = Window.partitionBy("rng", "part").orderBy("key", "doc_id", "rid")
    return (
        parted.withColumn("nth", F.row_number().over(inner))
        .join(F.broadcast(place), ["rng", "part"])
        .select(F.col("doc_id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("nth") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
