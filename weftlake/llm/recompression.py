"""Substring deduplication by recompression.

Spark names the words of all texts and the runs of a word, then, round by round,
the pairs and the runs of symbols. A round counts over the corpus: whatever occurs more than once
gets a number of its own, the place in the sorted file of all that do, and so
equal substrings have equal interior symbols everywhere. Names stand for words,
not for hashes of them: words are told apart by their bytes, runs by symbol and
length, pairs by both symbols.

With a symbol goes the interval of words that decided it: whoever holds the same
words there has the same symbol there. A symbol that occurs once therefore rules
out all windows that hold its interval; nothing is built on it any more. Rounds
go on while they rule windows out, without a bound on their number or on a
symbol's words. Windows that are left hold only symbols which they share. These are looked up by hash and verified by their words: the
names of the words lie in files, and a window is only held to repeat another
after all of its names have been compared with the other's.

Copies never meet in one task: a mapper sends a word, run, pair or window once,
with whether it saw it again. Files are written whole and mapped by workers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlake.llm.arrays import ODD, Lists, mapped, mix, pack, parts, put, range_shard, received, release, runs, slices, unmap, unpack
from weftlake.llm.common import arrow_rows, need
from weftlake.session import drop_stash, shared_path, stash

WINDOW = 35
SLICE_BYTES = 4 << 20  # text that is handled at once
FLUSH_BYTES = 8 << 20  # distinct words or keys that are held before they are sent
SHARD_BYTES = 12 << 20  # text, or symbols, for each file of names; one task holds one
TEXT_ROWS = 2000  # texts that are handed over at once
OPEN_ROWS = 400  # texts with names and symbols that are handed over at once
TASK_BYTES = 16 << 20  # symbols of open texts for each task
BROADCAST_BYTES = 16 << 20  # starts of the windows that are left, up to which they are broadcast
COMPARED = 1 << 15  # windows that are compared at once
#: Rounds go on while one rules out this share of the windows that are left; runs are named where this share of the symbols equal the next.
WORTH = 0.02


class Words:
    """The words of a slice of texts end to end, and the number of each text's."""

    def __init__(self, texts: pa.Array):
        at, data = parts(texts)
        solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
        start = solid.copy()
        start[1:] &= ~solid[:-1]
        first = at[:-1][at[:-1] < at[1:]]
        start[first] = solid[first]
        self.array = Lists(data[solid], np.append(np.flatnonzero(start[solid]), np.count_nonzero(solid))).binary()
        self.n = np.diff(np.concatenate([[0], np.cumsum(start)])[at])

    def runs(self, coded: pa.DictionaryArray) -> tuple[np.ndarray, np.ndarray]:
        """(first words, lengths) of the runs of one word in one text."""
        k = coded.indices.to_numpy()
        new = np.ones(len(k), bool)
        new[1:] = k[1:] != k[:-1]
        begin = np.cumsum(self.n) - self.n
        new[begin[self.n > 0]] = True
        first = np.flatnonzero(new)
        return first, np.diff(first, append=len(k))


def run_names(words: pa.Array, first: np.ndarray, times: np.ndarray) -> pa.Array:
    """What stands for runs among the words: word, blank and length, which no word can be."""
    return pa.array([b"%s %d" % x for x in zip(words.take(pa.array(first)).to_pylist(), times.tolist())], pa.binary())


def joined(words: pa.Array, n: np.ndarray) -> list[bytes]:
    """Each text's words, joined by one blank."""
    at, data = parts(words)
    out = np.full(len(data) + len(words), 32, np.uint8)
    out[np.arange(len(data)) + np.repeat(np.arange(len(words)), np.diff(at)) + 1] = data
    ends = np.cumsum(n)
    ends = at[ends] + ends
    return [out[min(a + 1, b) : b].tobytes() for a, b in zip(np.concatenate([[0], ends[:-1]]), ends)]


def word_hashes(words: pa.Array) -> np.ndarray:
    """A hash of each word, from prefix sums over the bytes of all; what it finds is compared by its bytes."""
    at, data = parts(words)
    with np.errstate(over="ignore"):
        back = np.uint64(pow(ODD, -1, 1 << 64))
        power = np.cumprod(np.full(len(data), ODD, np.uint64))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(np.arange(1, 257, dtype=np.uint64))[data] * power)])
        inverse = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(len(data), back, np.uint64))])
        return mix((total[at[1:]] - total[at[:-1]]) * inverse[at[:-1]] + np.diff(at).astype(np.uint64))


# Names: what occurs more than once, sorted by a hash, in one file a shard.


@dataclass(frozen=True)
class Names:
    """Where the names of a kind lie. Entry p of a shard has the name base[shard] + p + 1; 0 is no name."""

    root: str
    kind: str
    base: np.ndarray

    def find(self, k: np.ndarray, equal: Callable[[str, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        """The names of keys with hashes ``k``; ``equal(file, rows, places)`` tells which rows are what stands at their places."""
        out = np.zeros(len(k), np.int64)
        order = np.argsort(k)
        s = range_shard(k[order], len(self.base) - 1)
        at = runs(s)
        for a, b in zip(at, np.append(at[1:], len(s))):
            file = f"{self.kind}-{s[a]:05d}"
            table, rows = mapped(self.root, f"{file}.k", "<u8"), order[a:b]
            p = np.searchsorted(table, k[rows])
            live = np.flatnonzero(p < len(table))
            while len(live):  # entries that share a hash stand side by side
                live = live[table[p[live]] == k[rows[live]]]
                hit = equal(file, rows[live], p[live]) if len(live) else np.zeros(0, bool)
                out[rows[live[hit]]] = self.base[s[a]] + p[live[hit]] + 1
                live = live[~hit]
                p[live] += 1
                live = live[p[live] < len(table)]
        return out

    def words(self, words: pa.Array) -> np.ndarray:
        def equal(file: str, rows: np.ndarray, p: np.ndarray) -> np.ndarray:
            there = Lists(mapped(self.root, f"{file}.b", "u1"), mapped(self.root, f"{file}.o", "<u8")).take(p).binary()
            return pc.equal(words.take(pa.array(rows)), there).to_numpy(zero_copy_only=False)

        return self.find(word_hashes(words), equal)

    def pairs(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        def equal(file: str, rows: np.ndarray, p: np.ndarray) -> np.ndarray:
            return (mapped(self.root, f"{file}.x", "<u8")[p] == x[rows]) & (mapped(self.root, f"{file}.y", "<u8")[p] == y[rows])

        return self.find(pair_hashes(x, y), equal)


def pair_hashes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(mix(x.astype(np.uint64)) + y.astype(np.uint64) * np.uint64(ODD))


def _named(df: DataFrame, root: str, kind: str, shards: int, task, before: int) -> Names:
    """Bring what was sent to one task a shard, which writes the files; only the number of names comes back."""
    rows = df.repartitionById(shards, "shard").mapInArrow(task, "shard int, n bigint").collect()  # one row a shard
    n = np.zeros(shards, np.int64)
    for r in rows:
        n[r.shard] = r.n
    return Names(root, kind, before + np.concatenate([[0], np.cumsum(n)]))


def _by_shard(k: np.ndarray, shards: int) -> Iterator[tuple[int, int, int]]:
    """(shard, first, stop) in ascending hashes."""
    s = range_shard(k, shards)
    at = runs(s)
    return zip(s[at].tolist(), at.tolist(), np.append(at[1:], len(s)).tolist())


def _bits(x: np.ndarray) -> bytes:
    return np.packbits(x).tobytes()


def _unbits(b: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool)


SENT_WORDS = "shard int, k binary, size binary, word binary, more binary"
SENT_PAIRS = "shard int, k binary, x binary, y binary, more binary"


def _count_words(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    held: list[tuple[pa.Array, np.ndarray]] = []
    size = 0

    def flush() -> pa.RecordBatch:
        coded = pa.concat_arrays([w for w, _ in held]).dictionary_encode()
        times = np.bincount(coded.indices.to_numpy(), np.concatenate([n for _, n in held]), len(coded.dictionary))
        held.clear()
        release()
        k = word_hashes(coded.dictionary)
        order = np.argsort(k)
        k, more, words = k[order], times[order] > 1, coded.dictionary.take(pa.array(order))
        at, data = parts(words)
        rows = [(s, pack(k[a:b]), np.diff(at[a : b + 1]).astype("<u4").tobytes(), data[at[a] : at[b]].tobytes(), _bits(more[a:b])) for s, a, b in _by_shard(k, shards)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), *(pa.binary(),) * 4))], ["shard", "k", "size", "word", "more"])

    for b in batches:
        for _, texts in slices(b, 0, SLICE_BYTES):
            w = Words(texts)
            coded = w.array.dictionary_encode()
            if len(coded):
                found = coded.dictionary, np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary))
                held.append(found)
                first, times = w.runs(coded)
                if (long := first[times > 1]).size:
                    held.append((run_names(w.array, long, times[times > 1]), np.ones(len(long), np.int64)))
                size += held[-1][0].nbytes + found[0].nbytes
            if size > FLUSH_BYTES:
                yield flush()
                size = 0
    if held:
        yield flush()


def _write_words(batches: Iterator[pa.RecordBatch], root: str) -> Iterator[pa.RecordBatch]:
    if (got := received(batches)) is None:
        return
    shard, c = got
    ks = [unpack(b) for b in c["k"]]
    words = pa.concat_arrays([Lists(np.frombuffer(w, np.uint8), np.concatenate([[0], np.cumsum(np.frombuffer(s, "<u4"), dtype=np.int64)])).binary() for w, s in zip(c["word"], c["size"])])
    coded = words.dictionary_encode()
    at = coded.indices.to_numpy()
    more = np.concatenate([_unbits(b, len(x)) for b, x in zip(c["more"], ks)])
    times = np.bincount(at, 1 + more, len(coded.dictionary))
    k = np.zeros(len(times), np.uint64)
    k[at] = np.concatenate(ks)
    keep = np.flatnonzero(times > 1)
    keep = keep[np.argsort(k[keep], kind="stable")]
    if (k[keep][1:] == k[keep][:-1]).any():  # equal hashes stand by their bytes, so that a task that runs again writes the same
        word = coded.dictionary.take(pa.array(keep)).to_pylist()
        keep = keep[sorted(range(len(keep)), key=lambda i: (k[keep[i]], word[i]))]
    at, data = parts(coded.dictionary.take(pa.array(keep)))
    put(root, f"word-{shard:05d}.k", k[keep].astype("<u8"))
    put(root, f"word-{shard:05d}.o", at.astype("<u8"))
    put(root, f"word-{shard:05d}.b", data)
    del words, coded, got, c
    release()
    yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([len(keep)], pa.int64())], ["shard", "n"])


def distinct_pairs(k: np.ndarray, x: np.ndarray, y: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, ...]:
    """(k, x, y, times) of the distinct (x, y), by k."""
    order = np.argsort(k)
    same = k[order][1:] == k[order][:-1]
    if (same & ((x[order][1:] != x[order][:-1]) | (y[order][1:] != y[order][:-1]))).any():
        order = np.lexsort((y, x, k))
    k, x, y = k[order], x[order], y[order]
    at = np.flatnonzero(np.concatenate([np.ones(min(1, len(k)), bool), (k[1:] != k[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])]))
    return k[at], x[at], y[at], np.add.reduceat(times[order], at) if len(at) else times


def _write_pairs(batches: Iterator[pa.RecordBatch], root: str, kind: str) -> Iterator[pa.RecordBatch]:
    if (got := received(batches)) is None:
        return
    shard, c = got
    ks = [unpack(b) for b in c["k"]]
    x, y = (np.concatenate([np.frombuffer(b, "<u8") for b in c[i]]) for i in "xy")
    more = np.concatenate([_unbits(b, len(n)) for b, n in zip(c["more"], ks)])
    k, x, y, times = distinct_pairs(np.concatenate(ks), x, y, 1 + more)
    keep = times > 1
    for name, values in (("k", k), ("x", x), ("y", y)):
        put(root, f"{kind}-{shard:05d}.{name}", values[keep].astype("<u8"))
    yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([int(keep.sum())], pa.int64())], ["shard", "n"])


# Symbols of the texts that may still hold a repeated window.


@dataclass
class Symbols:
    """Live symbols of some texts in their order: name, first word, word after the last, and the words that decided it, ``lo`` to ``hi``.

    Neighbours whose words don't meet have something between them on which
    nothing can be built; between two texts lies a word that neither has.
    """

    name: np.ndarray
    first: np.ndarray
    last: np.ndarray
    lo: np.ndarray
    hi: np.ndarray

    def __getitem__(self, k) -> Symbols:
        return Symbols(self.name[k], self.first[k], self.last[k], self.lo[k], self.hi[k])

    def meets(self) -> np.ndarray:
        """Whether each symbol meets the next one; one less than the symbols."""
        return self.last[:-1] == self.first[1:]


@dataclass
class Round:
    """The symbols after a round: which of them are new, and of what."""

    made: Symbols
    new: np.ndarray
    x: np.ndarray
    y: np.ndarray


def _shift(x: np.ndarray, by: int, fill) -> np.ndarray:
    out = np.full_like(x, fill)
    if by > 0:
        out[by:] = x[:-by]
    else:
        out[:by] = x[-by:]
    return out


def run_round(s: Symbols) -> Round:
    """Runs of one symbol become symbols. Both neighbours of a run decided it: where one is missing it dies."""
    if not len(s.name):
        return Round(s, np.zeros(0, bool), s.name, s.name)
    meets = s.meets()
    starts = np.flatnonzero(np.concatenate([[True], ~(meets & (s.name[1:] == s.name[:-1]))]))
    ends = np.append(starts[1:], len(s.name))
    k = ends - starts
    left, right = np.concatenate([[False], meets])[starts], np.append(meets, False)[ends - 1]
    lo = np.minimum(np.minimum.reduceat(s.lo, starts), s.lo[np.maximum(starts - 1, 0)])
    hi = np.maximum(np.maximum.reduceat(s.hi, starts), s.hi[np.minimum(ends, len(s.name) - 1)])
    live = left & right
    made = Symbols(s.name[starts], s.first[starts], s.last[ends - 1], lo, hi)
    return Round(made[live], (k > 1)[live], s.name[starts][live], k[live])


def pair_round(s: Symbols, number: int) -> Round:
    """Every symbol is dealt to the left or the right by its name; a left one and a right one that follows it become a symbol.

    A left symbol that stays was decided with its right neighbour, a right one
    with its left neighbour: where that is missing it dies.
    """
    n = len(s.name)
    if not n:
        return Round(s, np.zeros(0, bool), s.name, s.name)
    right = (mix(s.name.astype(np.uint64) ^ mix(np.full(1, number, np.uint64))) & np.uint64(1)).astype(bool)
    meets = np.append(s.meets(), False)  # the next one
    met = _shift(meets, 1, False)  # by the one before
    pair = meets & ~right & _shift(right, -1, False)
    gone = _shift(pair, 1, False)
    next_, prev = np.minimum(np.arange(n) + 1, n - 1), np.maximum(np.arange(n) - 1, 0)
    seen = np.where(pair | ~right, next_, prev)
    lo, hi = np.minimum(s.lo, s.lo[seen]), np.maximum(s.hi, s.hi[seen])
    live = ~gone & np.where(right, met, meets)
    last = np.where(pair, s.last[next_], s.last)
    return Round(Symbols(s.name, s.first, last, lo, hi)[live], pair[live], s.name[live], s.name[next_][live])


def ruled_out(n: int, lo: np.ndarray, hi: np.ndarray, window: int) -> np.ndarray:
    """Which starts of windows, of ``n`` words, hold one of the intervals."""
    off = np.bincount(np.maximum(hi - window, 0), minlength=n + 1)[: n + 1] - np.bincount(lo + 1, minlength=n + 1)[: n + 1]
    return np.cumsum(off)[:n] > 0


def needed(s: Symbols, alive: np.ndarray, window: int) -> np.ndarray:
    """Which symbols' intervals lie in a window that is still alive."""
    before = np.concatenate([[0], np.cumsum(alive)])
    return (s.hi - s.lo <= window) & (before[np.minimum(s.lo + 1, len(alive))] > before[np.clip(s.hi - window, 0, len(alive))])


class Open:
    """A batch of texts that may hold a repeated window: names and starts of their words, one word apart, and their symbols."""

    SYMBOLS = ("name", "first", "size", "before", "after")
    COLUMNS = "alive binary, name binary, first binary, size binary, before binary, after binary, windows int, symbols int, twins int"

    def __init__(self, n: np.ndarray, names: np.ndarray, alive: np.ndarray, symbols: Symbols):
        self.n, self.names, self.alive, self.symbols = n, names, alive, symbols
        self.at = np.concatenate([[0], np.cumsum(n + 1)])

    @classmethod
    def read(cls, b: pa.RecordBatch) -> Open:
        """Of rows with or without names, with or without symbols."""
        c = {f: b.column(f).to_pylist() for f in b.schema.names if f != "text"}
        n = np.array(c["n_words"], np.int64)
        at = np.concatenate([[0], np.cumsum(n + 1)])
        names, alive = np.zeros(at[-1], np.int64), np.zeros(at[-1], bool)
        for k, (a, m) in enumerate(zip(at, n)):
            alive[a : a + m] = _unbits(c["alive"][k], m)
            if "names" in c:
                names[a : a + m] = np.frombuffer(c["names"][k], f"<u{len(c['names'][k]) // m}")
        if "first" not in c:
            none = np.zeros(0, np.int64)
            return cls(n, names, alive, Symbols(none, none, none, none, none))
        size = [len(f) // 4 for f in c["first"]]
        first = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(f, "<u4").astype(np.int64) + a for f, a in zip(c["first"], at))])
        long, before, after = (np.concatenate([np.zeros(0, np.uint16), *(np.frombuffer(x, "<u2") for x in c[f])]).astype(np.int64) for f in ("size", "before", "after"))
        name = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(x, f"<u{len(x) // k}" if k else "<u8").astype(np.int64) for x, k in zip(c["name"], size))])
        return cls(n, names, alive, Symbols(name, first, first + long, first - before, first + long + after))

    def columns(self, wide: bool) -> list[pa.Array]:
        """The columns of each text, windows and symbols that equal the next one counted; null for texts that no window is left of."""
        kind, s = "<u8" if wide else "<u4", self.symbols
        name = s.name.astype(kind)
        near = [x.astype("<u2") for x in (s.last - s.first, s.first - s.lo, s.hi - s.last)]
        cut = np.searchsorted(s.first, self.at)
        twin = np.append(s.meets() & (s.name[1:] == s.name[:-1]), False) if len(s.name) else np.zeros(0, bool)
        out: list[list] = [[] for _ in range(9)]
        for a, k, i, j in zip(self.at, self.n, cut, cut[1:]):
            starts = self.alive[a : a + k]
            row = [None] * 9
            if starts.any():
                row = [_bits(starts), name[i:j].tobytes(), (s.first[i:j] - a).astype("<u4").tobytes(), *(x[i:j].tobytes() for x in near), int(starts.sum()), j - i, int(twin[i:j].sum())]
            for c, x in zip(out, row):
                c.append(x)
        return [pa.array(c, pa.binary()) for c in out[:6]] + [pa.array(c, pa.int32()) for c in out[6:]]

    def pruned(self, window: int) -> Open:
        self.symbols = self.symbols[needed(self.symbols, self.alive, window)]
        return self


FIELDS = ["alive", "name", "first", "size", "before", "after", "windows", "symbols", "twins"]


def opened(texts: pa.Array, names: Names, window: int) -> tuple[Words, Open]:
    """The words of some texts, and these as symbols: words, and runs of a word.

    A word that occurs once rules out the windows that hold it, a run that does
    those that hold it and its neighbours, which decided it.
    """
    w = Words(texts)
    coded = w.array.dictionary_encode()
    word = names.words(coded.dictionary)[coded.indices.to_numpy()]
    at = np.concatenate([[0], np.cumsum(w.n + 1)])
    place = np.arange(len(word)) + np.repeat(np.arange(len(w.n)), w.n)
    spread, alive = np.zeros(at[-1], np.int64), np.zeros(at[-1], bool)
    spread[place] = word
    long = np.maximum(w.n - window + 1, 0)
    alive[np.arange(long.sum()) + np.repeat(at[:-1] - (np.cumsum(long) - long), long)] = True
    once = place[word == 0]
    alive &= ~ruled_out(len(alive), once, once + 1, window)
    start, times = w.runs(coded)
    name = word[start]
    if (more := np.flatnonzero(times > 1)).size:
        name[more] = names.words(run_names(w.array, start[more], times[more]))
    first = place[start]
    last = first + times
    real = np.zeros(at[-1] + 1, bool)
    real[place] = True
    s = Symbols(name, first, last, first - 1, last + 1)[(first > 0) & real[first - 1] & real[last]]
    single = (s.name == 0) & (s.last - s.first > 1)
    alive &= ~ruled_out(len(alive), s.lo[single], s.hi[single], window)
    return w, Open(w.n, spread, alive, s[s.name > 0]).pruned(window)


def _count_first(batches: Iterator[pa.RecordBatch], names: Names, shards: int, window: int) -> Iterator[pa.RecordBatch]:
    texts = (t for b in batches for _, t in slices(b, 0, SLICE_BYTES))
    return _sent_pairs((opened(t, names, window)[1] for t in texts), shards, 0, window)


def _apply_first(batches: Iterator[pa.RecordBatch], names: Names, pairs: Names, window: int, wide: bool) -> Iterator[pa.RecordBatch]:
    """Rows of (doc_id, n_words, digest of all words) and, for texts that windows are left of, text, names of the words and the columns of Open after the first round."""
    for b in batches:
        for rows, texts in slices(b, b.schema.get_field_index("text"), SLICE_BYTES):
            w, o = opened(texts, names, window)
            columns = applied(o, pairs, 0, window).columns(wide)
            open_ = columns[0].is_valid().to_numpy(zero_copy_only=False)
            kind = "<u8" if wide else "<u4"
            words = pa.array([o.names[a : a + n].astype(kind).tobytes() if x else None for a, n, x in zip(o.at, o.n, open_)], pa.binary())
            sha = pa.array([hashlib.sha256(t).hexdigest() for t in joined(w.array, w.n)], pa.string())
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(w.n, pa.int64()), sha, _only(texts, open_), words, *columns], ["doc_id", "n_words", "all_sha256", "text", "names", *FIELDS])
            release()
    unmap()


def _only(texts: pa.Array, which: np.ndarray) -> pa.Array:
    """The texts, null where they aren't asked for."""
    return texts.take(pa.array(np.arange(len(texts)), mask=~which))


def _some(batches: Iterator[pa.RecordBatch], most: int = OPEN_ROWS) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(0, b.num_rows, most):
            yield b.slice(k, most)


def _sent_pairs(opens: Iterator[Open], shards: int, number: int | None, window: int) -> Iterator[pa.RecordBatch]:
    """What a round would make of some texts, by shard: of runs without a ``number``, else of pairs."""
    held: list[tuple] = []
    size = 0

    def flush() -> pa.RecordBatch:
        k, x, y, times = distinct_pairs(*(np.concatenate(c) for c in zip(*held)))
        held.clear()
        u8 = lambda v: v.astype("<u8").tobytes()
        rows = [(s, pack(k[a:b]), u8(x[a:b]), u8(y[a:b]), _bits(times[a:b] > 1)) for s, a, b in _by_shard(k, shards)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), *(pa.binary(),) * 4))], ["shard", "k", "x", "y", "more"])

    for o in opens:
        r = run_round(o.symbols) if number is None else pair_round(o.symbols, number)
        use = r.new & needed(r.made, o.alive, window)
        x, y = r.x[use].astype(np.uint64), r.y[use].astype(np.uint64)
        if len(x):
            held.append(distinct_pairs(pair_hashes(x, y), x, y, np.ones(len(x), np.int64)))
            size += 24 * len(held[-1][0])
        if size > FLUSH_BYTES:
            yield flush()
            size = 0
    if held:
        yield flush()


def _count_pairs(batches: Iterator[pa.RecordBatch], shards: int, number: int | None, window: int) -> Iterator[pa.RecordBatch]:
    return _sent_pairs((Open.read(b) for b in _some(batches)), shards, number, window)


def applied(o: Open, names: Names, number: int | None, window: int) -> Open:
    """Open texts after a round: what has no name occurs once and rules windows out."""
    r = run_round(o.symbols) if number is None else pair_round(o.symbols, number)
    keep = needed(r.made, o.alive, window)
    s, new, x, y = r.made[keep], r.new[keep], r.x[keep], r.y[keep]
    s.name = s.name.copy()
    s.name[new] = names.pairs(x[new], y[new])
    once = s.name == 0
    o.alive &= ~ruled_out(len(o.alive), s.lo[once], s.hi[once], window)
    o.symbols = s[~once]
    return o.pruned(window)


def _apply_round(batches: Iterator[pa.RecordBatch], names: Names, number: int | None, window: int, wide: bool) -> Iterator[pa.RecordBatch]:
    """The texts that windows are left of after a round."""
    for b in _some(batches):
        columns = applied(Open.read(b), names, number, window).columns(wide)
        yield pa.RecordBatch.from_arrays([b.column("rid"), b.column("n_words"), *columns], ["rid", "n_words", *FIELDS]).filter(columns[0].is_valid())
    unmap()


# Windows that are left, and their verification.


def window_hashes(x: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """A hash of each run of ``window`` numbers, from prefix sums; the runs may cross texts."""
    n = len(x) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        base = ODD
        back = pow(base, -1, 1 << 64)
        power = np.cumprod(np.full(len(x), base, np.uint64)) * np.uint64(back)  # from the power 0 on
        inverse = np.cumprod(np.full(n, back, np.uint64)) * np.uint64(base)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(x.astype(np.uint64)) * power)])
        return mix((total[window:] - total[:-window]) * inverse)


FILE_BITS = 40  # of a place: the word's number in its file; the file's number stands above


def _names_at(root: str, kind: str, places: np.ndarray, window: int) -> np.ndarray:
    """The names of the windows at some places, one row each."""
    out = np.zeros((len(places), window), np.int64)
    order = np.argsort(places)
    file = (places[order] >> np.uint64(FILE_BITS)).astype(np.int64)
    at = runs(file)
    step = np.arange(window)
    for a, b in zip(at, np.append(at[1:], len(file))):
        rows = order[a:b]
        first = (places[rows] & np.uint64((1 << FILE_BITS) - 1)).astype(np.int64)
        out[rows] = mapped(root, f"flat-{file[a]:07d}", kind)[first[:, None] + step]
    return out


def _classes(n: int, group: np.ndarray, names: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Number of the first row with the same group and the same names, for each of ``n`` rows; ``group`` has the first row of its group."""
    out = group.copy()
    check = np.flatnonzero(group != np.arange(n))
    odd = []
    for k in range(0, len(check), COMPARED):
        rows = check[k : k + COMPARED]
        odd.append(rows[(names(rows) != names(group[rows])).any(axis=1)])
        unmap()
    seen: dict = {}
    for r in np.concatenate(odd).tolist() if odd else ():  # hashes that two windows share
        out[r] = seen.setdefault((int(group[r]), names(np.array([r])).tobytes()), r)
    return out


def _send_windows(batches: Iterator[pa.RecordBatch], root: str, shards: int, window: int, wide: bool) -> Iterator[pa.RecordBatch]:
    """Hash, place and whether it occurred again of each slice's windows; the names go to this task's file."""
    kind, number = "<u8" if wide else "<u4", TaskContext.get().partitionId()
    flat, total = [], 0
    for b in _some(batches):
        o = Open.read(b)
        at = np.flatnonzero(o.alive)
        k = window_hashes(o.names, window)[at]
        order = np.argsort(k, kind="stable")
        k, at = k[order], at[order]
        first = runs(k)
        group = np.repeat(first, np.diff(first, append=len(k)))
        step = np.arange(window)
        of = _classes(len(k), group, lambda rows, names=o.names, at=at: names[at[rows][:, None] + step])
        times = np.bincount(of, minlength=len(k))
        send = np.flatnonzero(times)
        k, place, more = k[send], at[send].astype(np.uint64) + np.uint64(total + (number << FILE_BITS)), times[send] > 1
        flat.append(o.names.astype(kind))
        total += len(o.names)
        rows = [(s, pack(k[a:z]), place[a:z].astype("<u8").tobytes(), _bits(more[a:z])) for s, a, z in _by_shard(k, shards)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), *(pa.binary(),) * 3))], ["shard", "k", "place", "more"])
    if flat:
        put(root, f"flat-{number:07d}", np.concatenate(flat))


def _write_windows(batches: Iterator[pa.RecordBatch], root: str, window: int, wide: bool) -> Iterator[pa.RecordBatch]:
    """Windows that occur more than once, each by its hash and the least place that holds it."""
    if (got := received(batches)) is None:
        return
    shard, c = got
    ks = [unpack(b) for b in c["k"]]
    place = np.concatenate([np.frombuffer(b, "<u8") for b in c["place"]])
    more = np.concatenate([_unbits(b, len(x)) for b, x in zip(c["more"], ks)])
    k = np.concatenate(ks)
    order = np.lexsort((place, k))
    k, place, more = k[order], place[order], more[order]
    first = runs(k)
    group = np.repeat(first, np.diff(first, append=len(k)))
    of = _classes(len(k), group, lambda rows: _names_at(root, "<u8" if wide else "<u4", place[rows], window))
    hit = np.flatnonzero(np.bincount(of, 1 + more, len(k)) > 1)
    unmap()
    put(root, f"window-{shard:05d}.k", k[hit].astype("<u8"))
    put(root, f"window-{shard:05d}.p", place[hit].astype("<u8"))
    yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([len(hit)], pa.int64())], ["shard", "n"])


def _remove(batches: Iterator[pa.RecordBatch], windows: Names, window: int, wide: bool) -> Iterator[pa.RecordBatch]:
    kind, step = "<u8" if wide else "<u4", np.arange(window)
    for b in _some(batches):
        o = Open.read(b)
        at = np.flatnonzero(o.alive)

        def equal(file: str, rows: np.ndarray, p: np.ndarray, o=o, at=at) -> np.ndarray:
            out = np.zeros(len(rows), bool)
            place = mapped(windows.root, f"{file}.p", "<u8")
            for k in range(0, len(rows), COMPARED):
                i = slice(k, k + COMPARED)
                out[i] = (_names_at(windows.root, kind, place[p[i]], window) == o.names[at[rows[i]][:, None] + step]).all(axis=1)
                unmap()
            return out

        at = at[windows.find(window_hashes(o.names, window)[at], equal) > 0]
        off = np.bincount(at, minlength=len(o.names) + 1) - np.bincount(at + window, minlength=len(o.names) + 1)
        gone = np.cumsum(off)[:-1] > 0
        real = np.ones(len(gone), bool)
        real[o.at[1:] - 1] = False
        doc = np.repeat(np.arange(len(o.n)), o.n)
        kept = ~gone[real]
        left = np.bincount(doc[kept], minlength=len(o.n))
        texts = joined(Words(b.column("text")).array.filter(pa.array(kept)), left)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(o.n, pa.int64()), pa.array(o.n - left, pa.int64()), pa.array([t.decode() for t in texts], pa.string())], ["doc_id", "n_words", "n_removed", "kept"])
    unmap()


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(id, n_words, n_removed, kept, kept_sha256) of each document.

    Every word that a repeated window of ``window`` words covers is removed,
    first occurrences too; ``kept`` has what stays, joined by one blank, and is
    null where no word was removed (the text's own words stay then). Null and
    wordless texts have no words. Repeated rows repeat each other's windows. An
    empty table gives no rows; other columns are not read.

    One task holds the names of one shard, which grow with ``shard_bytes`` of
    text and not with the corpus; the shards' number does.
    """
    need(docs, id_col, text_col)
    if not 1 <= window < 1 << 15:
        raise ValueError("window must be 1 to 32767")
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = max(16, -(-size // shard_bytes))
    root = shared_path(spark, "repeats")
    id_type = rows.schema["doc_id"].dataType.simpleString()
    with arrow_rows(spark, TEXT_ROWS):
        sent = rows.select("text").mapInArrow(partial(_count_words, shards=shards), SENT_WORDS)
        names = _named(sent, root, "word", shards, partial(_write_words, root=root), 0)
        number, named = 1, int(names.base[-1])
        sent = rows.select("text").mapInArrow(partial(_count_first, names=names, shards=shards, window=window), SENT_PAIRS)
        pairs = _named(sent, root, "pair0", shards, partial(_write_pairs, root=root, kind="pair0"), named)
        named = int(pairs.base[-1])
        wide = named >= 1 << 31  # names take four bytes while their number fits, then eight
        schema = f"doc_id {id_type}, n_words bigint, all_sha256 string, text string, names binary, {Open.COLUMNS}"
        first = rows.mapInArrow(partial(_apply_first, names=names, pairs=pairs, window=window, wide=wide), schema)
        first = stash(first.withColumn("rid", F.monotonically_increasing_id()), "first")
    open_ = first.filter("alive IS NOT NULL").select("rid", "n_words", *FIELDS)
    schema = f"rid bigint, n_words bigint, {Open.COLUMNS}"

    def left() -> tuple[DataFrame, int, int, int]:
        """The open texts in as many tasks as they fill, their windows, symbols and symbols that equal the next one."""
        n = [int(x) for x in open_.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("windows", "symbols", "twins"))).first()]
        return open_.coalesce(max(spark.sparkContext.defaultParallelism, -(-n[1] * 20 // TASK_BYTES))), *n

    state = None
    with arrow_rows(spark, OPEN_ROWS):
        open_, windows, symbols, twins = left()
        while symbols:
            few = max(4, -(-symbols * 8 // shard_bytes))
            for kind, step in ((f"run{number}", None), (f"pair{number}", number)):
                if step is None and twins <= WORTH * symbols:
                    continue
                sent = open_.mapInArrow(partial(_count_pairs, shards=few, number=step, window=window), SENT_PAIRS)
                found = _named(sent, root, kind, few, partial(_write_pairs, root=root, kind=kind), named)
                if step is None and found.base[-1] == named:
                    continue  # no run of any symbol occurs twice
                named = int(found.base[-1])
                after = stash(open_.mapInArrow(partial(_apply_round, names=found, number=step, window=window, wide=named >= 1 << 31), schema), kind)
                if state is not None:
                    drop_stash(state)
                open_ = state = after
            number, before = number + 1, windows
            open_, windows, symbols, twins = left()
            if windows > before * (1 - WORTH):
                break
        last = stash(open_.select("rid", "alive"), "last")
        size = last.agg(F.coalesce(F.sum(F.octet_length("alive") + 16), F.lit(0))).first()[0]
        if size <= BROADCAST_BYTES:
            last = F.broadcast(last)
        if state is not None:
            drop_stash(state)
        texts = first.select("rid", "doc_id", "n_words", "text", "names").join(last, "rid").drop("rid")
        shards = max(4, -(-windows * 24 // shard_bytes))
        sent = texts.select("n_words", "names", "alive").mapInArrow(partial(_send_windows, root=root, shards=shards, window=window, wide=wide), "shard int, k binary, place binary, more binary")
        repeated = _named(sent, root, "window", shards, partial(_write_windows, root=root, window=window, wide=wide), 0)
        done = texts.mapInArrow(partial(_remove, windows=repeated, window=window, wide=wide), f"doc_id {id_type}, n_words bigint, n_removed bigint, kept string")
        done = stash(done.select("doc_id", "n_words", "n_removed", F.when(F.col("n_removed") > 0, F.col("kept")).alias("kept"), F.sha2("kept", 256).alias("kept_sha256")), "removed")
    same = first.select("rid", "doc_id", "n_words", F.col("all_sha256").alias("kept_sha256")).join(last, "rid", "left_anti")
    out = done.unionByName(same.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.lit(None).cast("string").alias("kept"), "kept_sha256"))
    return out.withColumnRenamed("doc_id", id_col)


def repeat_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: n_words, n_removed and the SHA-256 of the kept words; rows and nulls as in :func:`remove_repeats`."""
    return remove_repeats(docs, id_col, text_col).select(id_col, "n_words", "n_removed", "kept_sha256")
