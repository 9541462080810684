"""Approximate vector search: an inverted file of coarse centroids with product-quantized residuals.

Every vector is stored below the centroid nearest to it, as one byte for each
subspace of what it differs from that centroid, beside the vector itself in a
column of its own. A search reads the codes of the lists that a query probes (the
scan's partitions are pruned), adds up its lookup tables, and scores the best
``ef`` again by their vectors. Centroids and codebooks are fitted to a sample of
``SAMPLE`` rows at most, in tasks; all rows are assigned and stored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftlake.operators.search import _units, fan_out

#: Rows that centroids and codebooks are fitted to, at most, and rows of it for each centroid, at least.
SAMPLE = 65_536
ROWS_A_LIST = 16
#: Codes of a subspace, and rounds of k-means at most.
CODES = 256
ROUNDS = 25
#: The list of vectors that have no direction: null, zero or of another dimension. Every query probes it.
NO_LIST = -1
#: Share of the lists that a query probes unless told otherwise: enough for vectors that hardly cluster; an eighth does where they do.
PROBED = 0.6
#: Queries that go to the workers at once, and those whose lookup tables are held at once.
QUERY_BLOCK = 4096
TABLE_BLOCK = 128


def kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """At most ``k`` centers of the rows of ``x``, from distinct rows by Lloyd's rounds until they settle."""
    x = np.unique(x.astype(np.float32), axis=0)
    if len(x) <= k:
        return x
    c = x[np.random.default_rng(seed).choice(len(x), k, replace=False)]
    last = None
    for _ in range(rounds):
        near = nearest(x, c)
        if last is not None and np.array_equal(near, last):
            break
        count = np.bincount(near, minlength=k)
        total = np.zeros_like(c, np.float64)
        np.add.at(total, near, x)
        full = count > 0
        c = np.where(full[:, None], total / np.maximum(count, 1)[:, None], c).astype(np.float32)
        last = near
    return c


def nearest(x: np.ndarray, centers: np.ndarray, block: int = 512) -> np.ndarray:
    """The number of the center nearest to each row."""
    half = (centers.astype(np.float64) ** 2).sum(axis=1) / 2
    return np.concatenate([np.argmax(x[a : a + block] @ centers.T - half, axis=1) for a in range(0, len(x), block)] or [np.zeros(0, np.int64)])


def _parts(dim: int, parts: int) -> list[slice]:
    """``parts`` subspaces of nearly equal width."""
    cuts = np.linspace(0, dim, min(parts, dim) + 1).astype(int)
    return [slice(a, b) for a, b in zip(cuts, cuts[1:])]


def _sampled(points: DataFrame, rows: int, sample: int) -> DataFrame:
    """About ``sample`` rows by a hash of their id: the same ones for the same table."""
    share = min(1.0, sample / max(rows, 1))
    return points.filter(F.pmod(F.xxhash64(F.lit("fit"), F.col("id")), F.lit(1 << 30)) < int(share * (1 << 30)))


def build_index(points: DataFrame, path: str, dim: int, lists: int | None = None, parts: int | None = None, sample: int = SAMPLE) -> None:
    """Write an index of ``points`` (id, embedding, any payload columns) to ``path``.

    ``lists`` defaults to four times the root of the number of rows, within what
    the sample can fit; ``parts`` to a byte for every four dimensions, a sixteenth
    of floats. Rows without id are left out; vectors without a direction are kept
    in a list of their own; repeated rows stay; an empty table gives an empty index.
    """
    spark = points.sparkSession
    points = points.filter("id IS NOT NULL")
    rows = points.count()
    lists = lists or int(max(1, min(4 * rows**0.5, min(rows, sample) / ROWS_A_LIST)))
    cuts = _parts(dim, parts or -(-dim // 4))
    some = _sampled(points.select("id", "embedding"), rows, sample)

    def coarse(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        m = _units(pdf.sort_values("id")["embedding"].tolist(), dim)
        c = kmeans(m[np.abs(m).sum(axis=1) > 0], lists)
        return pd.DataFrame({"list": np.arange(len(c), dtype=np.int32), "center": list(c)})

    some.withColumn("fit", F.lit(0)).groupBy("fit").applyInPandas(coarse, "list int, center array<float>").write.parquet(f"{path}/centroids")
    held = spark.sparkContext.broadcast(_matrix(spark.read.parquet(f"{path}/centroids"), "list", dim))

    def residuals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            m = _units(pdf["embedding"].tolist(), dim)
            m = m[np.abs(m).sum(axis=1) > 0]
            r = m - held.value[nearest(m, held.value)]
            yield pd.concat([pd.DataFrame({"part": np.int32(p), "sub": list(r[:, c].astype(np.float32))}) for p, c in enumerate(cuts)])

    def codebook(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        c = kmeans(np.stack(pdf["sub"].to_numpy()), CODES)
        return pd.DataFrame({"part": np.int32(key[0]), "code": np.arange(len(c), dtype=np.int32), "center": list(c)})

    subs = some.mapInPandas(residuals, "part int, sub array<float>")
    subs.groupBy("part").applyInPandas(codebook, "part int, code int, center array<float>").write.parquet(f"{path}/codebooks")
    books = spark.sparkContext.broadcast(_codebooks(spark, path))

    @F.pandas_udf("struct<list:int,code:binary>")
    def placed(v: pd.Series) -> pd.DataFrame:
        m = _units(v.tolist(), dim)
        at = np.full(len(m), NO_LIST, np.int32)
        codes = np.zeros((len(m), len(cuts)), np.uint8)
        has = np.abs(m).sum(axis=1) > 0
        if has.any():
            at[has] = nearest(m[has], held.value)
            r = m[has] - held.value[at[has]]
            for p, c in enumerate(cuts):
                codes[has, p] = nearest(r[:, c], books.value[p])
        return pd.DataFrame({"list": at, "code": [x.tobytes() for x in codes]})

    entries = points.withColumn("_p", placed("embedding")).select(*points.columns, F.col("_p.code").alias("code"), F.col("_p.list").alias("list"))
    spark.createDataFrame([], entries.schema).write.parquet(f"{path}/columns")
    entries.repartitionByRange("list", "id").write.partitionBy("list").parquet(f"{path}/entries")


def _matrix(centers: DataFrame, number: str, dim: int) -> np.ndarray:
    """Centers in the order of their numbers: at most SAMPLE / ROWS_A_LIST rows."""
    rows = centers.orderBy(number).select("center").collect()
    return np.array([r[0] for r in rows], np.float32).reshape(-1, dim)


def _codebooks(spark: SparkSession, path: str) -> dict[int, np.ndarray]:
    """Centers of each subspace, CODES at most."""
    by: dict[int, list] = {}
    for r in spark.read.parquet(f"{path}/codebooks").orderBy("part", "code").collect():
        by.setdefault(r["part"], []).append(r["center"])
    return {p: np.array(c, np.float32) for p, c in by.items()}


def _first(s: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the ``k`` greatest scores of each row above -inf, of equal ones the first, none below ``least``; the k-th raises ``least``."""
    if s.shape[1] > k:
        kth = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
        np.maximum(least, kth, out=least)
        over, equal = s > kth[:, None], s == kth[:, None]
        keep = over | (equal & (np.cumsum(equal, axis=1) <= (k - over.sum(axis=1))[:, None]))
    else:
        keep = np.ones(s.shape, bool)
    return np.nonzero(keep & (s >= least[:, None]) & (s > -np.inf))


def _ranked(df: DataFrame, k: int, *by: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def search_index(spark: SparkSession, path: str, queries: DataFrame, k: int, dim: int, probes: int | None = None, ef: int = 200, exact: bool = False, where: Column | None = None) -> DataFrame:
    """(query_id, id, score, rank): the ``k`` nearest of the indexed points for each of ``queries`` (query_id, qv).

    Each query probes the lists of its ``probes`` nearest centroids, by default a
    share of ``PROBED`` of all; ``ef`` of their points, at least ``k``, are scored exactly. ``exact`` reads all vectors instead.
    ``where`` is a condition on payload columns, met before anything is scored.
    Queries are a stated set, taken in blocks; null ones and those of another
    dimension have no rows. Equal scores are ordered by id; a row that is stored
    twice is found twice.
    """
    entries = spark.read.schema(spark.read.parquet(f"{path}/columns").schema).parquet(f"{path}/entries")
    if where is not None:
        entries = entries.filter(where)
    queries = queries.filter(F.size("qv") == dim).select("query_id", F.col("qv").cast("array<double>").alias("qv"))
    if exact:
        return fan_out(entries.withColumn("dataset", F.lit(0)), queries, k, -1.0).select("query_id", "id", "score", "rank")
    centers, books = _matrix(spark.read.parquet(f"{path}/centroids"), "list", dim), _codebooks(spark, path)
    cuts = _parts(dim, len(books) or 1)
    probes = probes or -int(-PROBED * len(centers) // 1)
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    kinds = {f.name: f.dataType.simpleString() for f in [*entries.schema, *queries.schema]}
    out = None
    for b in range(blocks):
        part = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b) if blocks > 1 else queries
        asked = [(r["query_id"], r["qv"]) for r in part.collect()]  # a block
        m = _units([v for _, v in asked], dim)
        probed = np.zeros((len(asked), len(centers) + 1), bool)
        for first in range(0, len(asked), TABLE_BLOCK):
            near = m[first : first + TABLE_BLOCK] @ centers.T
            np.put_along_axis(probed[first : first + TABLE_BLOCK], np.argsort(-near, axis=1, kind="stable")[:, :probes], True, axis=1)
        probed[:, NO_LIST] = True
        held = spark.sparkContext.broadcast((np.array([i for i, _ in asked], object), m, np.vstack([centers, np.zeros((1, dim), np.float32)]), books, probed))

        def scan(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            names, m, centers, books, probed = held.value
            least = np.full(len(m), -np.inf)  # what reaches the best of earlier batches
            for pdf in batches:
                pdf = pdf.sort_values("id", kind="stable")
                ids, lists, codes = pdf["id"].to_numpy(object), pdf["list"].to_numpy(), np.frombuffer(b"".join(pdf["code"]), np.uint8).reshape(len(pdf), len(cuts))
                rows = pdf.groupby("list").indices
                for first in range(0, len(m), TABLE_BLOCK):
                    some = slice(first, first + TABLE_BLOCK)
                    tables = [m[some][:, c] @ books[p].T for p, c in enumerate(cuts)] if books else []
                    base = m[some] @ centers.T
                    s = np.full((len(base), len(pdf)), -np.inf)
                    for at, g in rows.items():
                        qs = np.flatnonzero(probed[some, at])
                        x = np.repeat(base[qs, at][:, None], len(g), axis=1)
                        if at != NO_LIST:
                            for p, t in enumerate(tables):
                                x += t[qs][:, codes[g, p]]
                        s[np.ix_(qs, g)] = x
                    q, row = _first(s, max(ef, k), least[some])
                    yield pd.DataFrame({"query_id": names[first + q], "id": ids[row], "list": lists[row], "score": s[q, row]})

        def rescored(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            names, m, *_ = held.value
            row = {i: q for q, i in enumerate(names)}
            for pdf in batches:
                v = _units(pdf["embedding"].tolist(), dim)
                yield pd.DataFrame({"query_id": pdf["query_id"], "id": pdf["id"], "score": (v * m[[row[i] for i in pdf["query_id"]]]).sum(axis=1)})

        reached = entries.filter(F.col("list").isin([NO_LIST, *np.flatnonzero(probed[:, :-1].any(axis=0)).tolist()]))
        chosen = _ranked(reached.select("id", "code", "list").mapInPandas(scan, f"query_id {kinds['query_id']}, id {kinds['id']}, list int, score double"), max(ef, k), "query_id")
        chosen = chosen.select("query_id", "id", "list").distinct()
        found = reached.select("list", "id", "embedding").join(chosen, ["list", "id"]).select("query_id", "id", "embedding")
        found = _ranked(found.mapInPandas(rescored, f"query_id {kinds['query_id']}, id {kinds['id']}, score double"), k, "query_id")
        out = found if out is None else out.unionByName(found)
    return out.select("query_id", "id", "score", "rank")


def recall(found: DataFrame, true: DataFrame) -> DataFrame:
    """(query_id, recall): the share of the true ids of each query (query_id, id) that were found."""
    hit = true.select("query_id", "id").distinct().join(found.select("query_id", "id", F.lit(1).alias("hit")).distinct(), ["query_id", "id"], "left")
    return hit.groupBy("query_id").agg((F.count("hit") / F.count("*")).alias("recall"))
