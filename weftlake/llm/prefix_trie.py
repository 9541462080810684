"""Prefix trie of conversations by an external mergesort that knows common prefixes.

A turn is named by 128 bits of its SHA-256, a conversation by the names of its
turns in order: its path. Tasks sort what they read into runs, cut them at global
splitters, and hand on, for each conversation, how many turns it shares with the
one before (its LCP) and only the turns after these. A second task for each range
merges the runs with a loser tree that compares LCPs first and turns only beyond
them, so that a shared turn is compared once. Equal paths follow each other by id,
so that a splitter can part even the copies of one conversation.

The merged stream keeps the nodes on the path of its last conversation on a stack;
what the next one doesn't share is finished. Nodes on the first and the last path
of a range may go on in its neighbours: they are summed by node over all ranges,
and what lies below them is added up along doubled links to ancestors, in rounds
whose number is the logarithm of the depth.

A range is held in memory by its task (``RANGE_BYTES`` on average); a conversation
is one row of about 40 bytes a turn. Splitters come from a sample of ``SAMPLE``
conversations at most; they balance the ranges and change no result.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlake.llm.common import need, unit_hash, words
from weftlake.session import stash

#: Bytes of a turn's name.
TURN = 16
#: Bytes of paths in a sorted run and, on average, in a range; bytes of a splitter's path.
RUN_BYTES = 16 << 20
RANGE_BYTES = 64 << 20
SPLITTER_BYTES = 1024
#: Sampled conversations, in all and for each range.
SAMPLE = 250_000
SAMPLE_A_RANGE = 32
#: Ids in a piece of the list of conversations that end at an open node.
PIECE = 1 << 16

_BLOCK = "rng int, lcp binary, turns binary, conv binary, path binary, words binary"
_NODE = "kind int, rng int, node binary, parent binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, n_words long, ends binary"
#: Kinds of rows: finished with parent, finished below an open parent, open, a piece of an open node's ends.
WHOLE, BELOW, OPEN, ENDS = range(4)
NO_ENDS = hashlib.sha256(b"").hexdigest()


def paths_of(turns: DataFrame) -> DataFrame:
    """(conv_id, turns) of every conversation: its turns in order, null first, as (turn, name, n_words).

    Null roles and texts are empty; rows without a conv_id are ignored; turns of
    one number are ordered by their names; repeated rows are turns of their own.
    """
    need(turns, "conv_id", "turn", "role", "text")
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    name = F.substring(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * TURN)
    row = F.struct(F.col("turn").alias("turn"), name.alias("name"), F.size(words(text)).alias("n_words"))
    return turns.filter("conv_id is not null").groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(row)).alias("turns"))


def rebuilt(paths: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """``paths`` whose first turns are those of conversation ``conv_id - conv_id % every``: crc32(conv_id) % most of them."""
    c = F.col("conv_id")
    heads = paths.filter(c % every == 0).select(c.alias("base"), F.slice("turns", 1, most).alias("heads"))
    h = (F.crc32(c.cast("string")) % most).cast("int")
    own = paths.withColumn("base", c - c % every).withColumn("h", h)
    tail = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))
    head = F.when(F.col("h") > 0, F.slice(F.coalesce("heads", F.slice("turns", 1, 0)), F.lit(1), F.greatest("h", F.lit(1)))).otherwise(F.slice("turns", 1, 0))
    return own.join(heads, "base", "left").select("conv_id", F.concat(head, tail).alias("turns"))


def shared_turns(a: bytes, b: bytes, at: int = 0) -> int:
    """Turns that two paths share from the start, of which ``at`` are known."""
    k, n = at * TURN, min(len(a), len(b))
    while k < n and a[k : k + TURN] == b[k : k + TURN]:
        k += TURN
    return k // TURN


def _blocks(splitters: list[tuple[bytes, int]]):
    """Arrow mapper: conversations to sorted runs, one block for each range that a run reaches."""

    def block(rng: int, run: list[tuple]) -> dict:
        last, lcps, tails, counts = b"", [], [], []
        for path, _, n in run:
            k = shared_turns(last, path)
            lcps.append(k)
            tails.append(path[k * TURN :])
            counts.append(n[k:])
            last = path
        size = np.array([len(p) // TURN for p, _, _ in run], np.int32)
        return {"rng": rng, "lcp": np.array(lcps, np.int32).tobytes(), "turns": size.tobytes(), "conv": np.array([c for _, c, _ in run], np.int64).tobytes(), "path": b"".join(tails), "words": np.concatenate(counts).astype(np.int32).tobytes()}

    def flush(run: list[tuple]) -> pa.RecordBatch:
        run.sort(key=lambda x: x[:2])
        cuts = [bisect_left(run, s, key=lambda x: x[:2]) for s in splitters]
        ends = [0, *cuts, len(run)]
        rows = [block(k, run[a:b]) for k, (a, b) in enumerate(zip(ends, ends[1:])) if b > a]
        return pa.RecordBatch.from_pylist(rows, pa.schema([("rng", pa.int32()), *((c, pa.binary()) for c in ("lcp", "turns", "conv", "path", "words"))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            count = b.column("words")
            flat, at = count.values.to_numpy(zero_copy_only=False), count.offsets.to_numpy()
            for k, (path, conv) in enumerate(zip(b.column("path").to_pylist(), b.column("conv_id").to_pylist())):
                held.append((path, conv, flat[at[k] : at[k + 1]]))
                size += len(path) + 64
            if size >= RUN_BYTES:
                yield flush(held)
                held, size = [], 0
        if held:
            yield flush(held)

    return run


def _entries(block: dict) -> Iterator[tuple[int, bytes, int, np.ndarray]]:
    """(LCP with the entry before, path, id, words by turn) of a sorted run."""
    lcps, sizes, convs, counts = (np.frombuffer(block[c], t) for c, t in (("lcp", np.int32), ("turns", np.int32), ("conv", np.int64), ("words", np.int32)))
    tails, at = block["path"], 0
    path, n = b"", counts[:0]
    for lcp, size, conv in zip(lcps.tolist(), sizes.tolist(), convs.tolist()):
        more = size - lcp
        path = path[: lcp * TURN] + tails[at * TURN : (at + more) * TURN]
        n = np.concatenate([n[:lcp], counts[at : at + more]])
        at += more
        yield lcp, path, conv, n


def merged(runs: list[Iterator[tuple[int, bytes, int, np.ndarray]]]) -> Iterator[tuple[int, bytes, int, np.ndarray]]:
    """The entries of sorted runs in order of (path, id), each with its LCP to the entry before it.

    A loser tree: each inner node keeps the run that lost there, with the LCP of
    its head and the winner it lost to. Of two heads the one with the greater LCP
    to the last winner is smaller; only equal LCPs need a look at the turns, from
    that LCP on.
    """
    k = len(runs)
    heads: list[tuple | None] = [next(r, None) for r in runs]
    lcps = [0] * k

    def winner(i: int, j: int) -> tuple[int, int]:
        """(winner, loser) of two runs; the loser's LCP becomes that to the winner."""
        a, b = heads[i], heads[j]
        if a is None or b is None:
            return (j, i) if a is None else (i, j)
        if lcps[i] != lcps[j]:
            return (i, j) if lcps[i] > lcps[j] else (j, i)
        n = shared_turns(a[1], b[1], lcps[i])
        i, j = (i, j) if (a[1][n * TURN : (n + 1) * TURN], len(a[1]), a[2]) < (b[1][n * TURN : (n + 1) * TURN], len(b[1]), b[2]) else (j, i)
        lcps[j] = n
        return i, j

    tree = [0] * k  # tree[1:] holds losers; leaf r hangs below node (r + k) // 2

    def build(node: int) -> int:
        if node >= k:
            return node - k
        won, tree[node] = winner(build(2 * node), build(2 * node + 1))
        return won

    best = build(1) if k > 1 else 0
    while heads[best] is not None:
        _, path, conv, n = heads[best]
        yield lcps[best], path, conv, n
        heads[best] = next(runs[best], None)
        lcps[best] = heads[best][0] if heads[best] else 0
        node = (best + k) // 2
        while node:
            best, tree[node] = winner(best, tree[node])
            node //= 2


class _Node:
    __slots__ = ("name", "depth", "open", "conv", "convs", "children", "leaves", "saved", "words", "ends", "rows")

    def __init__(self, name: bytes, depth: int, n_words: int, is_open: bool):
        self.name, self.depth, self.words, self.open = name, depth, n_words, is_open
        self.conv, self.convs, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.ends: list[int] = []
        self.rows: list[dict] = []  # finished children, which wait for this node's smallest conversation


def _child(parent: bytes, turn: bytes) -> bytes:
    return hashlib.sha256(parent + turn).digest()[:TURN]


def finished_nodes(entries: Iterator[tuple[int, bytes, int, np.ndarray]], rng: int) -> Iterator[dict]:
    """Rows of ``_NODE`` for the merged entries of one range, from a stack of the nodes on the open path."""
    stack = [_Node(b"\0" * TURN, 0, 0, True)]

    def close(node: _Node, parent: _Node | None) -> Iterator[dict]:
        if parent:
            parent.convs += node.convs
            parent.conv = node.conv if parent.conv is None else min(parent.conv, node.conv)
        for row in node.rows:
            yield row | ({"kind": BELOW, "parent": node.name} if node.open else {"kind": WHOLE, "parent_conv_id": node.conv})
        row = {"rng": rng, "node": node.name, "conv_id": node.conv, "depth": node.depth, "n_convs": node.convs, "n_children": node.children}
        if node.open:
            yield row | {"kind": OPEN, "parent": parent.name if parent else None, "n_leaves": node.leaves, "saved_tokens": node.saved, "n_words": node.words}
            for k in range(0, len(node.ends), PIECE):
                yield {"kind": ENDS, "rng": rng, "node": node.name, "depth": k // PIECE, "ends": ",".join(map(str, node.ends[k : k + PIECE])).encode()}
            return
        leaves, saved = node.leaves + (node.children == 0), node.saved + (node.convs - 1) * node.words
        parent.children += 1
        parent.leaves += leaves
        parent.saved += saved
        parent.rows.append(row | {"n_leaves": leaves, "saved_tokens": saved, "ends": hashlib.sha256(",".join(map(str, node.ends)).encode()).hexdigest().encode()})

    first = True
    for lcp, path, conv, n in entries:
        while len(stack) > lcp + 1:
            node = stack.pop()
            yield from close(node, stack[-1])
        for d in range(lcp, len(path) // TURN):
            stack.append(_Node(_child(stack[-1].name, path[d * TURN : (d + 1) * TURN]), d + 1, int(n[d]), first))
        node = stack[-1]
        node.convs += 1
        node.conv = conv if node.conv is None else min(node.conv, conv)
        node.ends.append(conv)
        first = False
    for node in stack:
        node.open = True
    while stack:
        node = stack.pop()
        yield from close(node, stack[-1] if stack else None)


def _range_nodes(key: tuple, table: pa.Table) -> pa.Table:
    """All nodes of one range from its runs."""
    rows = finished_nodes(merged([_entries(b) for b in table.to_pylist()]), key[0].as_py())
    long = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "n_words")
    schema = pa.schema([("kind", pa.int32()), ("rng", pa.int32()), ("node", pa.binary()), ("parent", pa.binary()), *((c, pa.int64()) for c in long), ("ends", pa.binary())])
    held, parts = [], []
    for r in rows:
        held.append(r)
        if len(held) == 1 << 14:
            parts.append(pa.Table.from_pylist(held, schema))
            held = []
    return pa.concat_tables([*parts, pa.Table.from_pylist(held, schema)])


def _ends_hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the ids at each node, from pieces that arrive in order; one node's state at a time."""
    schema = pa.schema([("node", pa.binary()), ("sha", pa.string())])
    node, h = None, None
    for b in batches:
        out = []
        for name, ids in zip(b.column("node").to_pylist(), b.column("ends").to_pylist()):
            if name == node:
                h.update(b"," + ids)
                continue
            if h:
                out.append({"node": node, "sha": h.hexdigest()})
            node, h = name, hashlib.sha256(ids)
        yield pa.RecordBatch.from_pylist(out, schema)
    if h:
        yield pa.RecordBatch.from_pylist([{"node": node, "sha": h.hexdigest()}], schema)


def _sums_below(nodes: DataFrame) -> DataFrame:
    """(node, n_leaves, saved_tokens) with the sums over all open nodes below each open node added.

    After round k a node holds the sums of those less than 2^k levels below it and
    links to its ancestor 2^k levels above.
    """
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    s = nodes.select("node", F.col("parent").alias("up"), "n_leaves", "saved_tokens")
    reach = 1
    while reach <= deepest:
        add = s.filter("up is not null").groupBy(F.col("up").alias("node")).agg(F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("t"))
        far = s.select(F.col("node").alias("up"), F.col("up").alias("next"))
        s = s.join(add, "node", "left").join(far, "up", "left")
        s = stash(s.select("node", F.col("next").alias("up"), (F.col("n_leaves") + F.coalesce("l", F.lit(0))).alias("n_leaves"), (F.col("saved_tokens") + F.coalesce("t", F.lit(0))).alias("saved_tokens")), "below")
        reach *= 2
    return s.select("node", "n_leaves", "saved_tokens")


def _open_nodes(found: DataFrame) -> DataFrame:
    """Open nodes summed over the ranges: (node, parent, conv_id, depth, n_convs, n_children, n_leaves, saved_tokens, sha)."""
    rows = found.filter(F.col("kind") == OPEN)
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    nodes = stash(rows.groupBy("node").agg(F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.first("n_words").alias("n_words"), F.min("conv_id").alias("conv_id"), *sums), "open")
    below = nodes.filter("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("open_children"))
    nodes = nodes.join(below, "node", "left").withColumn("n_children", F.col("n_children") + F.coalesce("open_children", F.lit(0)))
    nodes = nodes.withColumn("n_leaves", F.col("n_leaves") + F.when(F.col("n_children") == 0, 1).otherwise(0))
    nodes = nodes.withColumn("saved_tokens", F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("n_words")).drop("open_children", "n_words")
    nodes = stash(nodes, "open")
    pieces = found.filter(F.col("kind") == ENDS).select("node", "rng", F.col("depth").alias("seq"), "ends")
    hashes = pieces.repartition("node").sortWithinPartitions("node", "rng", "seq").select("node", "ends").mapInArrow(_ends_hash, "node binary, sha string")
    return stash(nodes.drop("n_leaves", "saved_tokens").join(_sums_below(nodes), "node").join(hashes, "node", "left"), "open")


def prefix_trie(paths: DataFrame) -> DataFrame:
    """All nodes of the trie of ``paths`` (conv_id, turns), see :func:`paths_of`.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256) of each: its smallest conversation, that of its parent, how many
    conversations start with it, children, leaves below, words saved by storing
    shared turns once, and the hash of the ids that end there. Every conv_id is
    one row; no rows give no nodes.
    """
    spark = paths.sparkSession
    names = F.transform("turns", lambda t: t["name"])
    base = stash(paths.select("conv_id", F.unhex(F.array_join(names, "")).alias("path"), F.transform("turns", lambda t: t["n_words"]).alias("words")), "paths")
    size = F.length("path") + 64
    rows, total = base.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE_BYTES))
    share = min(SAMPLE, ranges * SAMPLE_A_RANGE) / max(rows, 1)
    sample = base.filter(unit_hash(F.col("conv_id")) < share).select(F.substring("path", 1, SPLITTER_BYTES).alias("path"), "conv_id", size.alias("size"))
    keys = sorted((bytes(r.path), r.conv_id, r.size) for r in sample.limit(2 * SAMPLE).collect())
    part, sofar, splitters = sum(k[2] for k in keys) / ranges, 0, []
    for path, conv, n in keys:
        sofar += n
        if sofar >= part * (len(splitters) + 1) and len(splitters) < ranges - 1:
            splitters.append((path, conv))
    blocks = base.mapInArrow(_blocks(splitters), _BLOCK)
    found = stash(blocks.groupBy("rng").applyInArrow(_range_nodes, _NODE), "nodes")
    nodes = _open_nodes(found)
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    above = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("above"))
    whole = found.filter(F.col("kind") == WHOLE).select(*out, F.col("ends").cast("string").alias("ends_sha256"))
    below = found.filter(F.col("kind") == BELOW).drop("parent_conv_id").join(above, "parent").withColumnRenamed("above", "parent_conv_id")
    edges = nodes.join(above, "parent", "left").withColumnRenamed("above", "parent_conv_id")
    return whole.unionByName(below.select(*out, F.col("ends").cast("string").alias("ends_sha256"))).unionByName(edges.select(*out, F.coalesce("sha", F.lit(NO_ENDS)).alias("ends_sha256")))


def trie_report(conversations: DataFrame) -> DataFrame:
    """The trie of all rebuilt conversations, see :func:`rebuilt` and :func:`prefix_trie`."""
    return prefix_trie(rebuilt(stash(paths_of(conversations), "turns")))


#: The same rows: conversations as lists of turns, nodes as their prefixes.
REPORT_SQL = """
    WITH steps AS (
        SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t FROM range(256) r(i)
    ), own AS (
        SELECT conv_id, conv_id::VARCHAR AS k, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS s
        FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
    ), hashed AS (
        SELECT own.*, xor(list_reduce(list_transform(range(1, length(k) + 1), lambda i: ascii(k[i])::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 4 AS h FROM own, steps
    ), built AS (
        SELECT a.conv_id, list_concat(list_slice(coalesce(b.s, []), 1, a.h), list_slice(a.s, a.h + 1, len(a.s))) AS s
        FROM hashed a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 20
    ), starts AS (
        SELECT conv_id, len(s) AS n, d, list_slice(s, 1, d) AS p FROM (SELECT *, unnest(range(0, len(s) + 1)) AS d FROM built)
    ), nodes AS (
        SELECT p, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
               sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = d), '')) AS ends_sha256 FROM starts GROUP BY p, d
    ), kids AS (
        SELECT list_slice(p, 1, depth - 1) AS p, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1
    ), counted AS (
        SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (p)
    ), sums AS (
        SELECT list_slice(p, 1, up) AS p, sum((n_children = 0)::BIGINT)::BIGINT AS n_leaves,
               sum(CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(p[depth].t, '[^\\x20\\x09-\\x0D]+')) END)::BIGINT AS saved_tokens
        FROM (SELECT *, unnest(range(0, depth + 1)) AS up FROM counted) GROUP BY 1
    )
    SELECT c.conv_id, c.depth, u.conv_id AS parent_conv_id, c.n_convs, c.n_children, n_leaves, saved_tokens, c.ends_sha256
    FROM counted c JOIN sums USING (p) LEFT JOIN counted u ON c.depth > 0 AND u.depth = c.depth - 1 AND u.p = list_slice(c.p, 1, c.depth - 1)"""
