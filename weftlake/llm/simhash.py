"""SimHash near-duplicates by multi-index hashing.

Fingerprints of 64 bits are cut into two segments of 32. Fingerprints that
differ in three bits or fewer differ in one bit at most in one of them, so each
fingerprint enumerates the ball of radius one in each segment (33 members),
fetches the fingerprints that hold the member as their segment, and verifies
the complete distance.

All work is on distinct fingerprints, so that copies cost nothing. A segment that
many fingerprints hold is split by the halves of the other one. Such crowds are
near copies mostly and must not emit their pairs: a round for them alone links
fingerprints whose balls meet while the other segment is equal (their distance is
two at most) as stars, of 65 members at most; then only pairs that still lie in
different components are emitted. No link is lost and none is added.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftlake.llm.common import fresh, need
from weftlake.llm.graph import components
from weftlake.session import stash

SHINGLE = 3
MAX_BITS = 3
SEED = 42
PIECE = 1 << 18
#: Fingerprints that make a segment hot; hot segments, of 8 bytes each, up to which they are broadcast after they are counted.
HOT = 64
BROADCAST_HOT = 200_000
#: Rows to leave out, of 16 bytes each, up to which they are broadcast after they are counted.
BROADCAST_DROPPED = 400_000


def shingle_hashes(text: str | None, n: int = SHINGLE) -> list[int]:
    from xxhash import xxh64_intdigest as xx

    w = (text or "").encode().lower().split()  # bytes: A-Z alone, and the six characters of white space
    if not w:
        return []
    if len(w) < n:
        return [xx(b" ".join(w), SEED)]
    line = b" ".join(w)
    at = list(accumulate(map(len, w), lambda a, k: a + k + 1, initial=0))
    return [xx(line[a : b - 1], SEED) for a, b in zip(at, at[n:])]


def fingerprint(hashes: list[int]) -> int:
    """A bit is one if more than half of the hashes have it; 0 for none."""
    x = np.array(hashes, np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(x), PIECE):
        ones += np.unpackbits(x[i : i + PIECE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(x), bitorder="little").view(np.int64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = pa.array([fingerprint(shingle_hashes(t.as_py())) for t in b.column("text")], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column("rid"), b.column("doc_id"), fp], ["rid", "doc_id", "fp"])


def _ball(value: str, bits: int) -> str:
    """SQL for a value and all that differ from it in one of its lower bits."""
    return f"transform(sequence(-1, {bits - 1}), i -> IF(i < 0, {value}, {value} ^ shiftleft(1L, i)))"


LOW, HIGH = "({0} & 4294967295L)", "shiftrightunsigned({0}, 32)"


def _segments(name: str, ball: bool) -> str:
    """SQL for the keys (segment number in bit 32, value below) of a fingerprint's segments, or of their balls."""
    each = [_ball(x.format(name), 32) if ball else f"array({x.format(name)})" for x in (LOW, HIGH)]
    return f"concat({each[0]}, transform({each[1]}, x -> x | 4294967296L))"


def _halves(name: str, key: str, ball: bool) -> str:
    """SQL for the keys below a segment's: the halves of the other segment, or their balls."""
    other = f"IF({key} < 4294967296L, {HIGH.format(name)}, {LOW.format(name)})"
    each = [f"({other} & 65535L)", f"shiftrightunsigned({other}, 16)"]
    each = [_ball(x, 16) if ball else f"array({x})" for x in each]
    return f"transform(concat({each[0]}, transform({each[1]}, x -> x | 65536L)), x -> shiftleft({key}, 17) | x | {1 << 62}L)"


def stars(nodes: DataFrame) -> DataFrame:
    """(fp, c) of ``nodes``: fingerprints linked where the whole, with at most one bit flipped, meets another's."""
    ball = nodes.select("fp", F.explode(F.expr(_ball("fp", 64))).alias("at"))
    met = ball.groupBy("at").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("all")).filter(F.size("all") > 1)  # 65 members at most
    near = components(met.select("a", F.explode("all").alias("b")), "a", "b")
    return nodes.join(near, nodes.fp == near.node, "left").select("fp", F.coalesce("component", "fp").alias("c"))


def linked(nodes: DataFrame, hot: int = HOT) -> DataFrame:
    """(fp, component) of the distinct fingerprints in column ``fp``: component is the smallest fingerprint, as a signed number, that is reachable.

    A segment that ``hot`` fingerprints hold is split by the halves of the other
    segment: two fingerprints that agree in it but for one bit differ in one bit
    at most in one of these. No link is lost.
    """
    table = nodes.select("fp", F.explode(F.expr(_segments("fp", False))).alias("k"))
    heavy = stash(table.groupBy("k").count().filter(F.col("count") >= hot).select(F.col("k").alias("hk")), "hot")
    n = heavy.count()
    first = nodes.withColumn("c", F.col("fp"))
    if n:
        right = F.broadcast(heavy) if n <= BROADCAST_HOT else heavy
        crowded = stash(table.join(right, table.k == right.hk, "left_semi").select("fp").distinct(), "crowded")
        first = stash(first.join(stars(crowded).withColumnsRenamed({"fp": "f", "c": "d"}), F.col("fp") == F.col("f"), "left").select("fp", F.coalesce("d", "c").alias("c")), "stars")

    def keyed(ball: bool) -> DataFrame:
        """(fp, c, k) of the table or of the probes."""
        out = first.select("fp", "c", F.explode(F.expr(_segments("fp", ball))).alias("k"))
        if not n:
            return out
        out = out.join(right, F.col("k") == F.col("hk"), "left")
        return out.filter("hk IS NULL").select("fp", "c", "k").unionByName(out.filter("hk IS NOT NULL").select("fp", "c", F.explode(F.expr(_halves("fp", "k", ball))).alias("k")))

    probes = keyed(True).toDF("p", "pc", "k")
    there = keyed(False).toDF("t", "tc", "tk")
    far = probes.join(there, (probes.k == there.tk) & (F.col("pc") < F.col("tc")) & (F.bit_count(F.col("p").bitwiseXOR(F.col("t"))) <= MAX_BITS))
    over = components(far.select("pc", "tc"), "pc", "tc")
    return stash(first.join(over, F.col("c") == over.node, "left").select("fp", F.coalesce("component", "c").alias("c")), "linked")


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rid: Column | None = None) -> DataFrame:
    """(rid, doc_id, fp, component_id, keep_rid) of every row.

    component_id is the smallest id of the component (null if all are null) and
    keep_rid the row that stays: the one with that id, one of them if several
    have it. ``rid`` is a column that tells rows apart, else one is made.
    """
    rows = docs.select((F.monotonically_increasing_id() if rid is None else rid).alias("rid"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = rows.drop("text").schema.add("fp", "long")
    base = stash(rows.mapInArrow(_fingerprints, schema), "fingerprints")
    own = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "rid")
    nodes = stash(base.groupBy("fp").agg(F.min(own).alias("least")), "nodes")
    comp = linked(nodes.select("fp"))
    best = stash(nodes.join(comp, "fp").groupBy("c").agg(F.min("least").alias("least")), "best")  # written, so that the join's sides are plain exchanges
    by_fp = stash(comp.join(best, "c").select("fp", F.col("least.doc_id").alias("component_id"), F.col("least.rid").alias("keep_rid")), "by_fp")
    return base.join(by_fp, "fp")


def simhash_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: fingerprint (16 hex digits) and component_id.

    Null and wordless texts have fingerprint zero and are linked like any other;
    repeated rows each give a row; an empty table gives none. Other columns are
    not read.
    """
    need(docs, id_col, text_col)
    out = near_components(docs, id_col, text_col)
    return out.select(F.col("doc_id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float | None = None) -> DataFrame:
    """The documents of which one of each component stays, the one with the smallest id, with the columns they came with.

    Texts are linked by their fingerprints. With ``similarity`` they are linked by
    the Jaccard similarity of their sets of five-word shingles: fingerprints of
    these sets bring texts together first, :mod:`weftlake.llm.similar` verifies
    them and adds the links that fingerprints of this radius can't reach.

    Texts without words, null ones too, are one group. Null ids come after all
    others; of rows that share the smallest id the one whose columns' hash is
    least stays, and one of rows that are equal in all columns. An empty table
    gives no rows. Text is not shuffled unless very many rows go.
    """
    need(docs, id_col, text_col)
    k1, k2, m = fresh(docs, "k1", "k2", "m")
    own = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map" not in f.dataType.simpleString()]
    nulls = F.concat(*(F.when(c.isNull(), "1").otherwise("0") for c in own))
    keyed = docs.withColumns({k1: F.xxhash64(*own, nulls), k2: F.xxhash64(F.lit(7), *own, nulls)})  # rows that are equal in all columns share both
    rid = F.struct(F.col(k1).alias("k1"), F.col(k2).alias("k2"))
    if similarity is None:
        found = near_components(keyed, id_col, text_col, rid)
    else:
        from weftlake.llm.similar import similar_components

        found = similar_components(keyed.select(rid.alias("rid"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), similarity)
    goes = F.col("rid") != F.col("keep_rid")
    rids = stash(found.groupBy("rid").agg(F.bool_or(goes).alias("goes"), F.count("*").alias("m")).filter("goes OR m > 1").select(F.col("rid.k1").alias("a"), F.col("rid.k2").alias("b"), "goes"), "rids")
    right = F.broadcast(rids) if rids.count() <= BROADCAST_DROPPED else rids
    met = keyed.join(right.withColumn(m, F.lit(True)), (F.col(k1) == right["a"]) & (F.col(k2) == right["b"]), "left")
    once = met.filter(F.col(m).isNull()).select(*docs.columns)
    equal = met.filter(F.col(m) & ~F.col("goes")).select(*docs.columns, k1, k2)
    if rids.filter("NOT goes").isEmpty():
        return once
    return once.unionByName(equal.dropDuplicates([k1, k2]).select(*docs.columns))
