"""Interpolated modified Kneser-Ney bigram model in memory-mapped sorted hash arrays.

Training is one Spark job over all texts. Mappers count (context, word) pairs of
64-bit word hashes; pairs are dealt to shards by context, and contexts that a
small sample shows to be very frequent by context and word, so that no shard
grows with one word. A shard's task merges its counts and writes them as sorted
arrays to the shared folder; counts by word go on to a second set of shards,
which write the word table. Only sums over each shard come to the driver.

Scoring maps the files and looks up whole batches by binary search. Nothing is
pruned or capped and all counts have 64 bits: the model grows with its corpus,
and so does the number of its shards, each of which is one task's work and grows
with ``shard_bytes`` alone. Collisions of 64-bit hashes are not resolved.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlake.llm.arrays import ODD, mapped, mix, pack, put, range_shard, received, runs, unpack
from weftlake.llm.common import fresh, need, unit_hash
from weftlake.session import shared_path

#: Hashes of the ends of a text.
BEGIN, END = 0x42, 0x45
FLUSH_TOKENS = 1 << 22
SCORE_TOKENS = 1 << 20
SHARD_BYTES = 24 << 20
#: Texts that are looked at for very frequent words; they only balance the shards.
SAMPLE_TEXTS = 4000
FREQUENT = 0.004


def pair_key(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(v) + w * np.uint64(ODD)


def pair_shard(v: np.ndarray, w: np.ndarray, frequent: np.ndarray, shards: int) -> np.ndarray:
    s = mix(v ^ np.uint64(1))
    if len(frequent):
        hot = np.isin(v, frequent)
        s[hot] = mix(s[hot] + (w[hot] >> np.uint64(56)))
    return (s % np.uint64(shards)).astype(np.int32)


def tokens(text: str | None) -> list[int]:
    from xxhash import xxh64_intdigest as xx

    return [xx(w) for w in (text or "").encode().lower().split()]  # bytes: A-Z alone


def _map_pairs(shards: int, frequent: np.ndarray):
    def flush(h: np.ndarray) -> Iterator[pa.RecordBatch]:
        v, w = h[:-1], h[1:]
        real = w != np.uint64(BEGIN)
        v, w = v[real], w[real]
        key = pair_key(v, w)
        order = np.argsort(key)
        at = runs(key[order])
        n = np.diff(at, append=len(key)).astype("<u4")  # below 2^32, as no more tokens are held
        v, w = v[order[at]], w[order[at]]
        s = pair_shard(v, w, frequent, shards)
        order = np.argsort(v)
        order = order[np.argsort(s[order], kind="stable")]
        v, w, n, s = v[order], w[order], n[order], s[order]
        at = runs(s)
        ends = np.append(at[1:], len(s))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(s[at]),
                pa.array([pack(v[a:b]) for a, b in zip(at, ends)], pa.binary()),
                pa.array([w[a:b].astype("<u8").tobytes() for a, b in zip(at, ends)], pa.binary()),
                pa.array([n[a:b].tobytes() for a, b in zip(at, ends)], pa.binary()),
            ],
            ["shard", "v", "w", "n"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for b in batches:
            for t in b.column(0):
                held.append(np.array([BEGIN, *tokens(t.as_py()), END], np.uint64))
                total += len(held[-1])
                if total > FLUSH_TOKENS:
                    yield from flush(np.concatenate(held))
                    held, total = [], 0
        if held:
            yield from flush(np.concatenate(held))

    return run


WORD = np.dtype([(c, "<u8") for c in ("h", "c", "n1", "n2", "n3", "cont")])


def sums_by(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Exact sums of 64-bit numbers by place."""
    out = np.zeros(n, np.uint64)
    np.add.at(out, at, values.astype(np.uint64))
    return out


def merged(v: np.ndarray, w: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """(key, v, w, count) of the distinct pairs, by key."""
    k = pair_key(v, w)
    order = np.argsort(k)
    k, v, w, n = k[order], v[order], w[order], n[order].astype(np.uint64)
    at = runs(k)
    return k[at], v[at], w[at], np.add.reduceat(n, at) if len(at) else n


def _merge_pairs(root: str, shards: int):
    """All counts of a shard to its sorted file, and to what they add to each word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (got := received(batches)) is None:
            return
        shard, t = got
        v = np.concatenate([unpack(b) for b in t["v"]])
        w = np.concatenate([np.frombuffer(b, "<u8") for b in t["w"]])
        k, v, w, n = merged(v, w, np.concatenate([np.frombuffer(b, "<u4") for b in t["n"]]))
        put(root, f"pair-{shard:05d}.k", k.astype("<u8"))
        put(root, f"pair-{shard:05d}.c", n.astype("<u8"))
        # By word: what it counts as a context, and the contexts that it follows.
        h, inv = np.unique(np.concatenate([v, w]), return_inverse=True)
        iv, iw = inv[: len(v)], inv[len(v) :]
        cols = {
            "c": sums_by(iv, n, len(h)),
            "n1": np.bincount(iv[n == 1], minlength=len(h)),
            "n2": np.bincount(iv[n == 2], minlength=len(h)),
            "n3": np.bincount(iv[n > 2], minlength=len(h)),
            "cont": np.bincount(iw, minlength=len(h)),
        }
        s = range_shard(h, shards)
        at = runs(s)
        ends = np.append(at[1:], len(s))
        classes = [[int((n == i).sum()) if a == 0 else 0 for i in (1, 2, 3, 4)] for a in at]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(s[at]),
                pa.array([pack(h[a:b]) for a, b in zip(at, ends)], pa.binary()),
                *(pa.array([x[a:b].astype("<u8").tobytes() for a, b in zip(at, ends)], pa.binary()) for x in cols.values()),
                pa.array(classes, pa.list_(pa.int64())),
            ],
            ["shard", "h", *cols, "pairs"],
        )

    return run


def _merge_words(root: str):
    """All that shards know of some words to one sorted file; sums over them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (got := received(batches)) is None:
            return
        shard, t = got
        u, inv = np.unique(np.concatenate([unpack(b) for b in t["h"]]), return_inverse=True)
        out = np.zeros(len(u), WORD)
        out["h"] = u
        for c in WORD.names[1:]:
            out[c] = sums_by(inv, np.concatenate([np.frombuffer(b, "<u8") for b in t[c]]), len(u))
        put(root, f"word-{shard:05d}", out)
        pairs = np.sum(t["pairs"], axis=0)
        cont = out["cont"]
        sums = [int(out["c"].sum()), int((cont > 0).sum()), int(cont.sum()), *(int((cont == i).sum()) for i in (1, 2, 3, 4)), int((cont > 2).sum()), *map(int, pairs)]
        yield pa.RecordBatch.from_arrays([pa.array([sums], pa.list_(pa.int64()))], ["sums"])

    return run


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts of counts one, two and more, from the numbers of counts one to four."""
    n1, n2, n3, n4 = n
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    d = (1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return tuple(min(max(x, 0.05), i + 0.95) for i, x in enumerate(d))


@dataclass(frozen=True)
class Model:
    """Where a trained model lies and the sums that belong to it."""

    root: str
    shards: int
    frequent: tuple[int, ...]
    tokens: int
    types: int
    pairs: int
    pair_discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    backoff: float

    def words(self, h: np.ndarray) -> np.ndarray:
        """The rows of the word table of ascending hashes; zeros for unknown words."""
        out = np.zeros(len(h), WORD)
        s = range_shard(h, self.shards)
        at = runs(s)
        for a, b in zip(at, np.append(at[1:], len(s))):
            table = mapped(self.root, f"word-{s[a]:05d}", WORD)
            if len(table):
                k = np.minimum(np.searchsorted(table["h"], h[a:b]), len(table) - 1)
                row = table[k]
                out[a:b] = np.where(row["h"] == h[a:b], row, np.zeros((), WORD))
        return out

    def pair_counts(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        out = np.zeros(len(v), np.uint64)
        key = pair_key(v, w)
        s = pair_shard(v, w, np.array(self.frequent, np.uint64), self.shards)
        order = np.argsort(s, kind="stable")
        at = runs(s[order])
        for a, b in zip(at, np.append(at[1:], len(s))):
            name = f"pair-{s[order[a]]:05d}"
            table = mapped(self.root, f"{name}.k", "<u8")
            if len(table):
                q = key[order[a:b]]
                k = np.minimum(np.searchsorted(table, q), len(table) - 1)
                out[order[a:b]] = np.where(table[k] == q, mapped(self.root, f"{name}.c", "<u8")[k], 0)
        return out

    def scores(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(log10 probability, base log10, known) of every token but BEGIN of the texts' hashes."""
        u, inv = np.unique(h, return_inverse=True)
        row = self.words(u)
        real = h[1:] != np.uint64(BEGIN)
        iv, iw = inv[:-1][real], inv[1:][real]
        n = self.pair_counts(u[iv], u[iw])
        d = np.array((0.0, *self.pair_discounts))
        e = np.array((0.0, *self.word_discounts))
        cont = row["cont"].astype(float)
        lower = (np.maximum(cont - e[np.minimum(row["cont"], 3).astype(int)], 0) / self.pairs if self.pairs else cont) + self.backoff / (self.types + 1)
        c = row["c"].astype(float)
        free = d[1] * row["n1"] + d[2] * row["n2"] + d[3] * row["n3"]
        cv = c[iv]
        seen = cv > 0
        p = np.where(seen, (np.maximum(n.astype(float) - d[np.minimum(n, 3).astype(int)], 0) + free[iv] * lower[iw]) / np.where(seen, cv, 1), lower[iw])
        # As a token the end counts as often as the beginning does as a context.
        c[u == np.uint64(END)] = c[u == np.uint64(BEGIN)]
        base = np.log10((c + 0.5) / (self.tokens + 0.5 * (self.types + 1)))
        return np.log10(p), base[iw], c[iw] > 0


def train(docs: DataFrame, text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> Model:
    """Count all texts of ``docs`` (null: empty) and write the model to the shared folder."""
    need(docs, text_col)
    spark = docs.sparkSession
    texts = docs.select(F.col(text_col).alias("text"))
    size, rows = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    shards = max(16, -(-size // shard_bytes))
    drawn = texts.filter(unit_hash(F.xxhash64("text"), F.lit(2)) < min(1.0, SAMPLE_TEXTS / max(rows, 1))).select(F.lower("text").alias("t"))
    seen = drawn.select(F.explode(F.split("t", r"[\x20\x09-\x0D]+")).alias("w")).groupBy("w").count()
    total = seen.agg(F.sum("count")).first()[0] or 0
    hot = [r.w for r in seen.filter((F.col("count") > FREQUENT * total) & (F.col("w") != "")).collect()]  # at most 1 / FREQUENT
    frequent = np.array(sorted({h for w in hot for h in tokens(w)} | {BEGIN}), np.uint64)
    root = shared_path(spark, "lm")
    pairs = texts.mapInArrow(_map_pairs(shards, frequent), "shard int, v binary, w binary, n binary")
    words = pairs.repartitionById(shards, "shard").mapInArrow(_merge_pairs(root, shards), "shard int, h binary, c binary, n1 binary, n2 binary, n3 binary, cont binary, pairs array<bigint>")
    sums = words.repartitionById(shards, "shard").mapInArrow(_merge_words(root), "sums array<bigint>").collect()  # one row a shard
    n, types, cont, c1, c2, c3, c4, more, p1, p2, p3, p4 = [sum(c) for c in zip(*(r.sums for r in sums))] if sums else [0] * 12
    e = discounts([c1, c2, c3, c4])
    backoff = (e[0] * c1 + e[1] * c2 + e[2] * more) / cont if cont else 1.0
    return Model(root, int(shards), tuple(map(int, frequent)), n, types, cont, discounts([p1, p2, p3, p4]), e, backoff)


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Every row with its columns and n_tokens, n_known, base_score, score and perplexity of its whole text."""
    need(docs, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(b: pa.RecordBatch, first: int, held: list[np.ndarray]) -> pa.RecordBatch:
            n = np.array([len(x) - 1 for x in held])
            p, base, known = model.scores(np.concatenate(held))
            at = np.concatenate([[0], np.cumsum(n)[:-1]])
            total = np.add.reduceat(p, at)
            cols = [pa.array(n), pa.array(np.add.reduceat(known.astype(np.int64), at)), pa.array(np.add.reduceat(base, at)), pa.array(total), pa.array(10 ** np.minimum(-total / n, 300))]
            return pa.RecordBatch.from_arrays([*b.slice(first, len(held)).columns[:-1], *cols], [*b.schema.names[:-1], *added])

        for b in batches:
            first, held, total = 0, [], 0
            for t in b.column(b.num_columns - 1):
                held.append(np.array([BEGIN, *tokens(t.as_py()), END], np.uint64))
                total += len(held[-1])
                if total > SCORE_TOKENS:
                    yield out(b, first, held)
                    first, held, total = first + len(held), [], 0
            if held:
                yield out(b, first, held)

    added = ["n_tokens", "n_known", "base_score", "score", "perplexity"]
    plain = [f"c{k}" for k in range(len(docs.columns))]
    schema = docs.toDF(*plain).schema
    for c, kind in zip(added, ("long", "long", "double", "double", "double")):
        schema = schema.add(c, kind)
    (text,) = fresh(docs, "text")
    return docs.withColumn(text, F.col(text_col)).toDF(*plain, "t").mapInArrow(run, schema).toDF(*docs.columns, *added)


def score_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5) -> DataFrame:
    """One row for each document, held out or not: counts, base_score and score.

    Held out of the model are those whose crc32(id as text) leaves 1; a null id
    counts as the empty text. A null text is its end alone. Repeated rows count
    and are scored each. An empty table gives no rows; other columns aren't read.
    """
    need(docs, id_col, text_col)
    held = F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == 1
    d = docs.select(F.col(id_col).alias("doc_id"), held.alias("held_out"), F.col(text_col).alias("text"))
    model = train(d.filter("NOT held_out"))
    out = score(d, model)
    return out.select(F.col("doc_id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", "perplexity")
