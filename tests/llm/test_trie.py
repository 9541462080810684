"""The prefix trie against all prefixes of all rebuilt conversations, and its merge against sorting."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

TURNS = "conv_id long, turn long, role string, text string, turns string, base string, h int, path string, words int, node string, rng int, parent string"


def talks(seed=4, n=130):
    """Shared openings, copies, a hot first turn, a long conversation, nulls and gaps in the ids."""
    r = random.Random(seed)
    rows = []
    for c in range(n):
        if c % 17 == 5:
            continue
        said = [("system", "be kind")] * (c % 3 > 0) + [(r.choice(["user", "assistant", None]), r.choice(["a b", "c", None, "", " d  e\n", "straße  x"])) for _ in range(r.randrange(1, 6))]
        if c % 4 == 0:
            said = [("user", "the same"), ("assistant", "every time")]
        if c == 41:
            said = [("user", f"turn {k % 50}") for k in range(700)]
        numbers = [None, *range(len(said) - 1)] if c % 5 == 0 else range(len(said))
        rows += [(c, k, *x) for k, x in zip(numbers, said)]
    rows += [(None, 0, "user", "nobody's"), (45, 0, "user", "again"), (45, 0, "user", "again")]
    return rows


def brute(rows):
    own = defaultdict(list)
    for c, k, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            name = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]
            own[c].append(((k is not None, k or 0), name, (role, text)))
    turns = {c: [t for *_, t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, own_turns in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(turns.get(c - c % 20, [])[:h] + own_turns[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[built[c][:d]].append(c)
        ends[built[c]].append(c)
    kids = defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        spared = (len(m) - 1) * len(p[-1][1].encode().split()) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += spared
    return sorted(
        (m[0], len(p), members[p[:-1]][0] if p else -1, len(m), kids.get(p, 0), leaves[p], saved[p], hashlib.sha256(",".join(map(str, ends.get(p, []))).encode()).hexdigest()) for p, m in members.items()
    )


@pytest.mark.parametrize("run_bytes", [1 << 24, 3000])
def test_trie(spark, monkeypatch, run_bytes):
    """With runs of few conversations each range merges many."""
    from weftlake.llm import prefix_trie as p

    monkeypatch.setattr(p, "RUN_BYTES", run_bytes)
    monkeypatch.setattr(p, "PIECE", 2)
    rows = talks()
    frame = spark.createDataFrame([(*x, "t", "b", 1, "p", 2, "n", 3, "q") for x in rows], TURNS).repartition(5)
    got = sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in p.trie_report(frame).collect())
    assert got == brute(rows)
    assert p.trie_report(frame.limit(0)).count() == 0


def test_merge_keeps_order_and_prefixes():
    import numpy as np

    from weftlake.llm.prefix_trie import merged, shared_turns

    r = random.Random(8)
    keys = [b"".join(r.choice([b"a", b"b"]) * 16 for _ in range(r.randrange(6))) for _ in range(400)]
    rows = [(k, i) for i, k in enumerate(keys)]
    for k in (1, 2, 3, 7, 16):
        runs = []
        for j in range(k):
            run = sorted(rows[j::k])
            runs.append(iter([(shared_turns(run[i - 1][0], x[0]) if i else 0, *x, np.zeros(0)) for i, x in enumerate(run)]))
        got = list(merged(runs))
        assert [(p, c) for _, p, c, _ in got] == sorted(rows)
        assert [n for n, *_ in got] == [0] + [shared_turns(a[1], b[1]) for a, b in zip(got, got[1:])]
    assert list(merged([iter([]), iter([])])) == []


def test_a_hot_conversation_is_cut_by_id(spark):
    """Copies of one conversation are parted by splitters, and the hash of their ids is that of all in order."""
    from weftlake.llm import prefix_trie as p

    rows = [(c, k, "user", t) for c in range(0, 6000, 20) for k, t in enumerate(["x", "y z"])]
    got = {r.depth: r for r in p.trie_report(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    ids = ",".join(str(c) for c in range(0, 6000, 20))
    assert len(got) == 3 and got[2].ends_sha256 == hashlib.sha256(ids.encode()).hexdigest() and got[0].saved_tokens == 299 * 3 and got[0].n_leaves == 1
