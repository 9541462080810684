"""All pairs of texts whose shingle sets reach a Jaccard similarity, by prefixes, verified set against set.

Two sets with a similarity of t or more share one of the first n - ceil(t n) + 1
members of either, in any order that is the same for all sets. Members that are
frequent in a sample of the texts come last in the order: it changes the number
of candidates, never the pairs found. Candidates pass a bound that can't dismiss
a true pair (parities of the members' hashes differ in at most as many bits as
the sets differ in members), then the sets themselves are compared.

All work is on distinct sets. Sets whose fingerprints are linked by multi-index
hashing are verified first, then those that share a prefix. A large group of near
copies must not emit its pairs: rounds of stars link the members of a prefix to
one of them, another one for each prefix and round, and only pairs that still lie
in different components and pass a sketch of 256 parities follow. No link is lost
and none is added. Sets and shingles are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from weftlake.llm.graph import components
from weftlake.llm.simhash import fingerprint, linked, shingle_hashes
from weftlake.session import drop_stash, stash

SHINGLE = 5
#: One text of so many is counted for the order; members counted LEAST times there are frequent. HEAVY of them are told apart.
ONE_OF = 8
LEAST = 3
HEAVY = 1 << 20
#: A round of stars is followed by another if it brings the components of open prefixes below this share.
FEWER = 0.95
SKETCH = [f"s{k}" for k in range(4)]
BROADCAST_ROWS = 200_000
SEED = 42


def shingle_set(text: str | None, n: int) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, n), np.uint64))


def set_id(hashes: np.ndarray) -> int:
    from xxhash import xxh64_intdigest as xx

    h = xx(hashes.tobytes(), SEED)
    return h - (1 << 64) if h >> 63 else h


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Parity of the members at each of 256 places, as four numbers."""
    odd = np.bincount((hashes & np.uint64(255)).astype(np.int64), minlength=256) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def parities(hashes: np.ndarray) -> bytes:
    """Parity of the members at each of 2^k places, one for each member at least."""
    width = max(64, 1 << max(len(hashes) - 1, 0).bit_length())
    odd = np.bincount((hashes & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def may_reach(a: bytes, b: bytes, na: int, nb: int, similarity: float) -> bool:
    """False only if sets of these sizes and parities are less similar."""
    if min(na, nb) < similarity * max(na, nb) - 1e-9:
        return False
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum()) <= (na + nb) * (1 - similarity) / (1 + similarity) + 1e-9


def prefix(hashes: np.ndarray, heavy: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    keys, counts = heavy
    often = np.zeros(len(hashes), np.int64)
    if len(keys):
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        often = np.where(keys[at] == hashes, counts[at], 0)
    return hashes[np.lexsort((hashes, often))][: len(hashes) - ceil(similarity * len(hashes) - 1e-9) + 1] if len(hashes) else hashes


def _members(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(0, b.num_rows, 500):
            sets = [shingle_set(t.as_py(), n) for t in b.column("text").slice(k, 500)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], ["k"])


def _described(batches: Iterator[pa.RecordBatch], n: int, similarity: float, heavy) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [shingle_set(t.as_py(), n) for t in b.column("text")]
        heads = [prefix(s, heavy.value, similarity) for s in sets]
        ends = pa.array(np.cumsum([0, *map(len, heads)]), pa.int32())
        ks = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.empty(0, np.uint64), *heads]).view(np.int64)))
        node, size, bits = pa.array(map(set_id, sets), pa.int64()), pa.array(map(len, sets), pa.int32()), pa.array(map(parities, sets), pa.binary())
        fp = pa.array([fingerprint(s) for s in sets], pa.int64())
        small = [pa.array(c, pa.int64()) for c in np.stack([sketch(s) for s in sets], axis=1)] if sets else [pa.array([], pa.int64())] * 4
        yield pa.RecordBatch.from_arrays([b.column("rid"), b.column("doc_id"), node, size, bits, fp, *small, ks], ["rid", "doc_id", "node", "n", "bits", "fp", *SKETCH, "ks"])


def _possible(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    for b in batches:
        c = b.to_pydict()
        yield b.select(["a", "b"]).filter(pa.array([may_reach(*x, similarity) for x in zip(c["bits_a"], c["bits_b"], c["n_a"], c["n_b"])], pa.bool_()))


def _whole(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [shingle_set(t.as_py(), n) for t in b.column("text")]
        yield pa.RecordBatch.from_arrays([pa.array(map(set_id, sets), pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "members"])


def _similar(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    for b in batches:
        good = []
        for x, y in zip(b.column("members_a"), b.column("members_b")):
            x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            good.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
        yield b.select(["a", "b"]).filter(pa.array(good, pa.bool_()))


def frequent(rows: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, and counts of members that are frequent in a sample of the texts; HEAVY at most."""
    part = rows.filter(F.pmod(F.xxhash64("text", F.lit(SEED)), F.lit(ONE_OF)) == 0).select("text")
    top = part.mapInArrow(partial(_members, n=n), "k long").groupBy("k").agg(F.count("*").alias("m")).filter(f"m >= {LEAST}").orderBy(F.desc("m"), "k").limit(HEAVY).toArrow()
    keys = top.column("k").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], top.column("m").to_numpy()[order]


def similar_components(rows: DataFrame, similarity: float, n: int = SHINGLE) -> DataFrame:
    """(rid, doc_id, component_id, keep_rid) of every row of (rid, doc_id, text), as :func:`weftlake.llm.simhash.near_components`.

    Texts whose sets of ``n``-word shingles have a Jaccard similarity of
    ``similarity`` or more are linked, as are texts without words. ``rid`` must
    depend on the row alone.
    """
    spark = rows.sparkSession
    heavy = spark.sparkContext.broadcast(frequent(rows, n))
    schema = rows.drop("text").schema.add("node", "long").add("n", "integer").add("bits", "binary").add("fp", "long")
    for c in SKETCH:
        schema = schema.add(c, "long")
    base = stash(rows.mapInArrow(partial(_described, n=n, similarity=similarity, heavy=heavy), schema.add("ks", ArrayType(LongType()))), "sets")
    own = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "rid")
    nodes = stash(base.groupBy("node").agg(F.min(own).alias("least"), *(F.first(c).alias(c) for c in ("n", "bits", "fp", *SKETCH))), "nodes")
    heads = base.select("node", F.explode("ks").alias("k")).groupBy("k").agg(F.collect_set("node").alias("at")).filter(F.size("at") > 1)
    groups = stash(heads.select("k", F.explode("at").alias("node")).join(nodes.select("node", "n", *SKETCH), "node"), "heads")
    comp = stash(nodes.select("node", F.col("node").alias("c")), "components")

    def verified(pairs: DataFrame) -> DataFrame:
        """The (a, b, ca, cb) of ``pairs`` that are similar."""
        pairs = stash(pairs.distinct(), "pairs")
        side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}"))
        maybe = stash(pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").mapInArrow(partial(_possible, similarity=similarity), "a long, b long"), "maybe")
        ends = maybe.select(F.col("a").alias("node")).unionByName(maybe.select(F.col("b").alias("node"))).distinct()
        rids = stash(nodes.join(ends, "node", "left_semi").select("least.rid"), "ends")
        found = rows.join(F.broadcast(rids) if rids.count() <= BROADCAST_ROWS else rids, "rid", "left_semi").select("text")
        sets = stash(found.mapInArrow(partial(_whole, n=n), "node long, members binary").dropDuplicates(["node"]), "members")
        side = lambda x: sets.select(F.col("node").alias(x), F.col("members").alias(f"members_{x}"))
        same = maybe.join(side("a"), "a").join(side("b"), "b").mapInArrow(partial(_similar, similarity=similarity), "a long, b long")
        out = stash(pairs.join(same, ["a", "b"]), "similar")
        for x in (pairs, maybe, rids, sets):
            drop_stash(x)
        return out

    def fits(right: str = "r."):
        """Sizes and sketches that two similar sets can have."""
        n, m = F.col("n"), F.col(f"{right}n")
        off = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"{right}{c}"))) for c in SKETCH), F.lit(0))
        return (F.least(n, m) >= F.greatest(n, m) * similarity - 1e-9) & (off <= (n + m) * ((1 - similarity) / (1 + similarity)) + 1e-9)

    def merge(pairs: DataFrame) -> None:
        """Verify pairs (u, c, v, d) and join the components of the similar ones."""
        nonlocal comp
        ordered = pairs.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), F.least("c", "d").alias("ca"), F.greatest("c", "d").alias("cb"))
        over = components(verified(ordered).select("ca", "cb"), "ca", "cb")
        before, comp = comp, stash(comp.join(over.withColumnRenamed("node", "_n"), F.col("c") == F.col("_n"), "left").select("node", F.coalesce("component", "c").alias("c")), "components")
        drop_stash(before)

    side = lambda o, *more: F.min(F.struct(o.alias("o"), "node", "n", *SKETCH, *more)).alias("r")
    # Fingerprints first: each set with one of those that are linked to it.
    by_fp = nodes.select("node", "n", "fp", *SKETCH).join(linked(nodes.select("fp").distinct()).withColumnRenamed("fp", "f"), F.col("fp") == F.col("f"))
    by_fp = stash(by_fp.select("c", "node", "n", *SKETCH), "by_fp")
    rep = stash(by_fp.groupBy("c").agg(side(F.xxhash64("node"))).withColumnRenamed("c", "rc"), "rep")
    merge(by_fp.join(rep, F.col("c") == F.col("rc")).filter((F.col("node") != F.col("r.node")) & fits()).select(F.col("node").alias("u"), F.col("node").alias("c"), F.col("r.node").alias("v"), F.col("r.node").alias("d")))
    # Then prefixes: each of their sets with one of them, another one for each prefix and round, as long as that helps; at last all pairs that are still apart.
    open_, last, number = groups, None, 0
    while True:
        at = open_.join(comp, "node")
        apart = at.groupBy("k").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("k")
        left = stash(at.join(apart, "k", "left_semi"), "open")
        if open_ is not groups:
            drop_stash(open_)
        open_ = left.drop("c")
        left_over = left.select(F.count_distinct("c")).first()[0]
        if not left_over or (last is not None and left_over > FEWER * last):
            break
        last, number = left_over, number + 1
        rep = stash(left.groupBy("k").agg(side(F.xxhash64("node", "k", F.lit(number)), "c")), "rep")
        merge(left.join(rep, "k").filter((F.col("c") != F.col("r.c")) & fits()).select(F.col("node").alias("u"), "c", F.col("r.node").alias("v"), F.col("r.c").alias("d")))
        drop_stash(rep)
    if left_over:
        right = left.select("k", F.struct("node", "n", "c", *SKETCH).alias("r"))
        merge(left.join(right, "k").filter((F.col("c") < F.col("r.c")) & fits()).select(F.col("node").alias("u"), "c", F.col("r.node").alias("v"), F.col("r.c").alias("d")))
    drop_stash(groups)
    all_ = nodes.join(comp, "node").select("node", "least", "c")
    best = stash(all_.groupBy("c").agg(F.min("least").alias("best")), "best")  # written, so that the join's sides are plain exchanges
    by_node = stash(all_.join(best, "c").select("node", F.col("best.doc_id").alias("component_id"), F.col("best.rid").alias("keep_rid")), "by_node")
    return base.select("rid", "doc_id", "node").join(by_node, "node").drop("node")
