"""A minimal acyclic transducer from byte strings to id sequences, in one memory-mapped file.

States that accept the same set of endings are shared. Each edge carries the
number of words that sort before those behind it, so that the sum along a path
is the word's rank, and the rank is the place of its id sequence.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

import numpy as np


class _State:
    __slots__ = ("edges", "final", "number", "size")

    def __init__(self):
        self.edges: dict[int, _State] = {}
        self.final = False
        self.number = -1
        self.size = 0

    def signature(self) -> tuple:
        return self.final, tuple((b, id(s)) for b, s in self.edges.items())


def build(words: Iterable[tuple[bytes, tuple[int, ...]]], path: str) -> int:
    """Write the automaton of (word, ids) pairs, which needn't be sorted; its number of states."""
    pairs = sorted(dict(words).items())
    root, register, chain = _State(), {}, []  # chain: (parent, byte, child) of the last word's path

    def settle(depth: int) -> None:
        while len(chain) > depth:
            parent, b, child = chain.pop()
            known = register.setdefault(child.signature(), child)
            if known is not child:
                parent.edges[b] = known

    last = b""
    for word, _ in pairs:
        same = 0
        for x, y in zip(word, last):
            if x != y:
                break
            same += 1
        settle(same)
        at = chain[-1][2] if chain else root
        for b in word[same:]:
            nxt = _State()
            at.edges[b] = nxt
            chain.append((at, b, nxt))
            at = nxt
        at.final = True
        last = word
    settle(0)

    order: list[_State] = []
    stack = [(root, False)]
    while stack:  # children before parents
        s, done = stack.pop()
        if done:
            s.size = s.final + sum(t.size for t in s.edges.values())
            order.append(s)
        elif s.number < 0:
            s.number = 0
            stack.append((s, True))
            stack += [(t, False) for t in s.edges.values() if t.number < 0]
    order.reverse()
    for k, s in enumerate(order):
        s.number = k
    edge, target, skip, final = [], [], [], bytearray()
    for s in order:
        before = int(s.final)
        for b, t in sorted(s.edges.items()):
            edge.append(s.number << 8 | b)
            target.append(t.number)
            skip.append(before)
            before += t.size
        final.append(s.final)
    ids = np.array([i for _, v in pairs for i in v], "<u4")
    at = np.cumsum([0] + [len(v) for _, v in pairs]).astype("<u4")
    parts = {"edge": np.array(edge, "<u4"), "target": np.array(target, "<u4"), "skip": np.array(skip, "<u4"), "at": at, "ids": ids, "final": np.frombuffer(bytes(final), np.uint8)}
    head = json.dumps({k: v.nbytes for k, v in parts.items()}).encode().ljust(252)
    with open(path, "wb") as f:
        f.write(len(head).to_bytes(4, "little") + head)
        for v in parts.values():
            f.write(v.tobytes())
    return len(order)


class Lexicon:
    """Reader of a file made by :func:`build`; its pages are shared by all processes that map it."""

    def __init__(self, path: str):
        whole = np.memmap(path, np.uint8, "r")
        n = int.from_bytes(whole[:4].tobytes(), "little")
        pos, part = 4 + n, {}
        for k, size in json.loads(whole[4 : 4 + n].tobytes()).items():
            part[k] = whole[pos : pos + size].view(np.uint8 if k == "final" else "<u4")
            pos += size
        self.ids, self.at = part["ids"], part["at"]
        self._edge, self._target, self._skip, self._final = part["edge"], part["target"], part["skip"], part["final"]

    def find(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The ranks of many words, -1 for those that the lexicon lacks; word k is ``data[at[k] : at[k + 1]]``.

        All words walk the automaton together, one byte a step.
        """
        size = np.diff(at)
        out = np.full(len(size), -1, np.int64)
        live = np.arange(len(size))
        state, rank = np.zeros(len(size), np.uint32), np.zeros(len(size), np.int64)
        k = 0
        while len(live):
            done = size[live] == k
            if done.any():
                end = done & (self._final[state] > 0)
                out[live[end]] = rank[end]
                live, state, rank = live[~done], state[~done], rank[~done]
            if not len(self._edge):
                break
            want = state << np.uint32(8) | data[at[live] + k]
            e = np.minimum(np.searchsorted(self._edge, want), len(self._edge) - 1)
            there = self._edge[e] == want
            e, live, rank = e[there], live[there], rank[there]
            state, rank = self._target[e], rank + self._skip[e]
            k += 1
        return out

    def get(self, word: bytes) -> tuple[int, ...] | None:
        """The ids of a word, or None if it isn't in the lexicon."""
        r = int(self.find(np.frombuffer(word, np.uint8), np.array([0, len(word)]))[0])
        return None if r < 0 else tuple(self.ids[self.at[r] : self.at[r + 1]].tolist())
