"""Embedding through pluggable providers, with retries and a breaker around remote ones."""

from __future__ import annotations

import random
import time
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Default batch sizes by provider.
BATCHES = {"openai": 2048, "cohere": 96, "internal": 128}


class HashingProvider:
    """Vectors without a model: signed hashed words, scaled to unit length."""

    batch = BATCHES["internal"]

    def __init__(self, dim: int = 64):
        self.dim = dim

    def __call__(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * self.dim
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                v[h % self.dim] += 1.0 if h >> 31 else -1.0
            n = sum(x * x for x in v) ** 0.5 or 1.0
            out.append([x / n for x in v])
        return out


@dataclass
class HttpProvider:
    """A remote service; ``post(url, body)`` sends a body and gives the decoded answer."""

    kind: str
    model: str
    post: Callable[[str, dict], dict]
    url: str = ""
    query: bool = False

    @property
    def batch(self) -> int:
        return BATCHES[self.kind]

    def body(self, texts: list[str]) -> dict:
        if self.kind == "openai":
            return {"model": self.model, "input": texts}
        if self.kind == "cohere":
            return {"model": self.model, "texts": texts, "input_type": "search_query" if self.query else "clustering", "embedding_types": ["float"], "truncate": "NONE"}
        return {"model": self.model, "texts": texts}

    def __call__(self, texts: list[str]) -> list[list[float]]:
        answer = self.post(self.url, self.body(texts))
        if self.kind == "openai":
            return [x["embedding"] for x in sorted(answer["data"], key=lambda x: x["index"])]
        return answer["embeddings"]["float"] if self.kind == "cohere" else answer["embeddings"]


def with_retry(call: Callable, tries: int = 3, first: float = 0.5, most: float = 10.0, jitter: float = 0.1, sleep: Callable[[float], None] = time.sleep):
    """The call's value; after a failure up to ``tries`` more calls, the wait doubled each time up to a cap."""
    wait = first
    for k in range(tries + 1):
        try:
            return call()
        except Exception:
            if k == tries:
                raise
            sleep(min(wait, most) * random.uniform(1 - jitter, 1 + jitter))
            wait *= 2


@dataclass
class Breaker:
    """Opens after failures in a window, tries again after a pause, closes after successes."""

    failures: int = 5
    window: float = 60.0
    pause: float = 30.0
    successes: int = 3
    clock: Callable[[], float] = time.monotonic
    _failed: list[float] = field(default_factory=list)
    _opened: float | None = None
    _good: int = 0

    @property
    def state(self) -> str:
        if self._opened is None:
            return "closed"
        return "open" if self.clock() - self._opened < self.pause else "half-open"

    def call(self, f: Callable):
        if self.state == "open":
            raise RuntimeError("circuit open")
        trying = self.state == "half-open"
        try:
            out = f()
        except Exception:
            now = self.clock()
            self._failed = [t for t in self._failed if now - t < self.window] + [now]
            if trying or len(self._failed) >= self.failures:
                self._opened, self._good = now, 0
            raise
        if trying:
            self._good += 1
            if self._good >= self.successes:
                self._opened, self._failed, self._good = None, [], 0
        return out


def embed(df: DataFrame, provider, text_col: str = "text", out: str = "vector", tries: int = 3) -> DataFrame:
    """Every row with the vector of its text; a provider that gives another number of vectors fails the batch."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        breaker = Breaker()
        for s in batches:
            texts, vectors = s.fillna("").tolist(), []
            for i in range(0, len(texts), provider.batch):
                part = texts[i : i + provider.batch]
                got = with_retry(lambda p=part: breaker.call(lambda: provider(p)), tries)
                if len(got) != len(part):
                    raise ValueError(f"{len(got)} vectors for {len(part)} texts")
                vectors += got
            yield pd.Series(vectors, index=s.index)

    return df.withColumn(out, run(text_col))


def embed_batch(provider, texts: list[str], model: str = "", most: int | None = None) -> dict:
    """Answer of an embedding service to one batch: vectors, their number and dimension; a batch above ``most`` is refused, none gives none."""
    most = provider.batch if most is None else most
    if len(texts) > most:
        raise ValueError(f"a batch of {len(texts)} texts is above {most}")
    vectors = provider(texts) if texts else []
    return {"embeddings": vectors, "model": model, "count": len(vectors), "dimensions": len(vectors[0]) if vectors else 0}


class TtlCache:
    """Values that lapse after some seconds; the least recently used go when it is full."""

    def __init__(self, seconds: float, most: int = 10_000, clock: Callable[[], float] = time.monotonic):
        self.seconds, self.most, self.clock = seconds, most, clock
        self._held: dict = {}

    def get(self, key, make: Callable):
        """The value of a key, made anew if there is none that holds."""
        end, value = self._held.pop(key, (float("-inf"), None))
        if end <= self.clock():
            value, end = make(), self.clock() + self.seconds
        self._held[key] = (end, value)
        if len(self._held) > self.most:
            del self._held[next(iter(self._held))]
        return value

    def forget(self, key) -> None:
        self._held.pop(key, None)


def adapt_concurrency(now: int, pressed: bool, calm: int, most: int) -> tuple[int, int]:
    """(concurrency, calm ticks): halved under pressure, one more after two calm ticks."""
    if pressed:
        return max(1, now // 2), 0
    return (min(most, now + 1), 0) if calm + 1 >= 2 else (now, calm + 1)
