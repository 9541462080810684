"""Hash arrays: mixing, packing for the shuffle, and sorted files that workers memory-map."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The multipliers of the mixers.
ODD, MIX1, MIX2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX1)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX2)
        return x ^ (x >> np.uint64(31))


def range_shard(h: np.ndarray, shards: int) -> np.ndarray:
    """By leading bits, so that the shards are one sorted array."""
    return ((h >> np.uint64(40)) * np.uint64(shards) >> np.uint64(24)).astype(np.int32)


def pack(x: np.ndarray) -> bytes:
    """Differences of ascending numbers, by byte planes: the leading ones are zero and compress in the shuffle."""
    d = np.diff(x, prepend=np.uint64(0)).astype("<u8")
    return d.view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack(b: bytes) -> np.ndarray:
    planes = np.frombuffer(b, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").reshape(-1), dtype=np.uint64)


def runs(x: np.ndarray) -> np.ndarray:
    """Where equal neighbours begin."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


class Lists:
    """Many lists of numbers, end to end; list k is ``values[at[k] : at[k + 1]]``."""

    def __init__(self, values: np.ndarray, at: np.ndarray):
        self.values, self.at = values, np.asarray(at, np.int64)

    def take(self, k: np.ndarray) -> Lists:
        size = self.at[k + 1] - self.at[k]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        return Lists(self.values[np.arange(total) + np.repeat(self.at[k] - (ends - size), size)], np.concatenate([[0], ends]))

    def grouped(self, first: np.ndarray) -> Lists:
        """Neighbours joined: new list k is lists ``first[k]`` to ``first[k + 1] - 1``."""
        return Lists(self.values, self.at[first])

    def replaced(self, k: int, value: int) -> Lists:
        """With list k as one value."""
        a, b = self.at[k : k + 2]
        at = self.at.copy()
        at[k + 1 :] += 1 - (b - a)
        return Lists(np.concatenate([self.values[:a], np.array([value], self.values.dtype), self.values[b:]]), at)

    def binary(self) -> pa.Array:
        """Lists of bytes as a binary array; below 2 GB."""
        return pa.Array.from_buffers(pa.binary(), len(self.at) - 1, [None, pa.py_buffer(self.at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(self.values))])


def parts(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets from 0, bytes) of a string or binary array without nulls."""
    _, at, data = a.buffers()
    wide = pa.types.is_large_string(a.type) or pa.types.is_large_binary(a.type)
    at = np.frombuffer(at, np.int64 if wide else np.int32)[a.offset : a.offset + len(a) + 1].astype(np.int64) if len(a) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return at - at[0], data


def slices(b: pa.RecordBatch, column: int, most: int, rows: int | None = None) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """A batch in slices of about ``most`` bytes of text and at most ``rows`` rows, with the texts; null texts are empty."""
    texts = pc.fill_null(b.column(column), "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < b.num_rows:
        before = ends[first - 1] if first else 0
        stop = max(first + 1, int(np.searchsorted(ends, before + most, "right")))
        stop = min(stop, first + rows) if rows else stop
        yield b.slice(first, stop - first), texts.slice(first, stop - first)
        first = stop


def received(batches: Iterator[pa.RecordBatch]) -> tuple[int, dict[str, list]] | None:
    """(shard, columns) of all rows of a task that was dealt one shard; None for no rows."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return None
    t = pa.Table.from_batches(held)
    (shard,) = t["shard"].unique().to_pylist()
    return shard, {c: t[c].to_pylist() for c in t.column_names if c != "shard"}


def release() -> None:
    """Give memory that Arrow no longer uses back to the system: workers live as long as their executor."""
    pa.default_memory_pool().release_unused()


def put(root: str, name: str, data: np.ndarray) -> None:
    """Write a file below the shared folder; a task that runs twice leaves one whole file."""
    uri = urlparse(root)
    if uri.scheme in ("", "file"):
        os.makedirs(uri.path, exist_ok=True)
        path = os.path.join(uri.path, name)
        with tempfile.NamedTemporaryFile(dir=uri.path, delete=False) as f:
            data.tofile(f)
        os.replace(f.name, path)
    else:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)
        store.create_dir(base)
        part = f"{base}/.{name}-{uuid.uuid4().hex}"
        with store.open_output_stream(part) as out:
            out.write(data.tobytes())
        store.move(part, f"{base}/{name}")


@lru_cache(maxsize=1 << 14)  # a process may map some 65,000 files
def mapped(root: str, name: str, kind: str) -> np.ndarray:
    """A file of the shared folder as a memory-mapped array; from a remote store it is copied to local disk first."""
    uri = urlparse(root)
    if uri.scheme in ("", "file"):
        path = os.path.join(uri.path, name)
    else:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)
        folder = os.path.join(tempfile.gettempdir(), os.path.basename(base))
        os.makedirs(folder, exist_ok=True)
        path = os.path.join(folder, name)
        if not os.path.exists(path):
            with store.open_input_stream(f"{base}/{name}") as f, tempfile.NamedTemporaryFile(dir=folder, delete=False) as out:
                while block := f.read(1 << 24):
                    out.write(block)
            os.replace(out.name, path)
    return np.asarray(np.memmap(path, kind, "r")) if os.path.exists(path) and os.path.getsize(path) else np.zeros(0, kind)


def unmap() -> None:
    """Let go of all mapped files at the end of a task; the system keeps what it has memory for."""
    mapped.cache_clear()
