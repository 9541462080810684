"""Vector search, grouping to documents, filters, fan-out over data sets and reranking."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftlake.functions.vectors import cosine

#: Query vectors that go to the workers at once; more are taken in blocks of some this many.
QUERY_BLOCK = 4096


def scored(points: DataFrame, query: list[float], vector: str = "embedding", threshold: float = 0.0) -> DataFrame:
    """Points with their cosine similarity to a query, at ``threshold`` or above."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return points.withColumn("score", cosine(F.col(vector), q)).filter(F.col("score") >= threshold)


def matvec_scored(points: DataFrame, query: list[float], vector: str = "embedding", threshold: float = 0.0) -> DataFrame:
    """As :func:`scored`, with one product for each Arrow batch, summed by row: equal vectors have equal scores wherever they stand."""
    import numpy as np

    q = np.asarray(query, np.float64)
    q = q / (np.linalg.norm(q) or 1.0)

    @F.pandas_udf("double")
    def sim(v: pd.Series) -> pd.Series:
        out = np.zeros(len(v))
        same = v.map(lambda x: x is not None and len(x) == len(q)).to_numpy(bool)
        if same.any():
            m = np.stack(v[same].to_numpy()).astype(np.float64)
            n = np.linalg.norm(m, axis=1)
            out[same] = np.divide((m * q).sum(axis=1), n, out=np.zeros(len(m)), where=n > 0)
        return pd.Series(out)

    return points.withColumn("score", sim(vector)).filter(F.col("score") >= threshold)


def top_k(df: DataFrame, k: int = 10, offset: int = 0, tie: str = "id") -> DataFrame:
    """Best by score, equal ones by id: a heap in each task and one merge."""
    return df.orderBy(F.desc("score"), tie).offset(offset).limit(k) if offset else df.orderBy(F.desc("score"), tie).limit(k)


def payload_filter(points: DataFrame, wanted: dict[str, object]) -> DataFrame:
    """Points whose columns equal the string or integer values; values of other kinds are ignored."""
    for name, value in wanted.items():
        if isinstance(value, (str, int)) and not isinstance(value, bool):
            points = points.filter(F.col(name) == F.lit(value))
    return points


def group_documents(matches: DataFrame, limit: int = 10) -> DataFrame:
    """(item_id, best_score, chunk_count, best_id) by score: items without id are dropped, a best score is at least 0."""
    g = (
        matches.filter(F.coalesce(F.col("item_id"), F.lit(0)) != 0)
        .groupBy("item_id")
        .agg(F.greatest(F.max("score"), F.lit(0.0)).alias("best_score"), F.count("*").alias("chunk_count"), F.max_by("id", F.struct(F.col("score"), -F.col("id"))).alias("best_id"))
    )
    return g.orderBy(F.desc("best_score"), "item_id").limit(limit)


def search_documents(points: DataFrame, query: list[float], limit: int = 10, threshold: float = 0.0) -> DataFrame:
    return group_documents(matvec_scored(points, query, threshold=threshold), limit)


def _units(vectors, dim: int):
    """Matrix of the vectors over their lengths; those of another dimension, nulls and zero vectors are rows of zeros."""
    import numpy as np

    m = np.zeros((len(vectors), dim))
    fits = np.array([v is not None and len(v) == dim for v in vectors], bool)
    if fits.any():
        m[fits] = np.stack([v for v, ok in zip(vectors, fits) if ok])
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


#: Queries whose products with an Arrow batch are held at once.
PRODUCT_BLOCK = 256


def _best(points: pd.DataFrame, queries: list[tuple], k: int, threshold: float) -> pd.DataFrame:
    """The ``k`` best points of a batch by data set and query.

    Products of matrices choose, with room for their rounding; those chosen are scored again by row, so that equal vectors tie.
    """
    import numpy as np

    out = []
    for dim in {len(v) for _, v in queries}:
        asked = [(i, v) for i, v in queries if len(v) == dim]
        every = _units([v for _, v in asked], dim)
        names = np.array([i for i, _ in asked], object)
        for _, g in points.groupby("dataset", dropna=False):
            m, ids = _units(g["embedding"].tolist(), dim), g["id"].to_numpy(object)
            for at in range(0, len(asked), PRODUCT_BLOCK):
                q = every[at : at + PRODUCT_BLOCK]
                s = m @ q.T
                least = np.partition(s, len(m) - k, axis=0)[len(m) - k] if len(m) > k else np.full(len(q), -2.0)
                row, col = np.nonzero(s >= np.maximum(least, threshold) - 1e-9)
                score = np.concatenate([(m[row[i : i + 65536]] * q[col[i : i + 65536]]).sum(axis=1) for i in range(0, len(row), 65536)] or [np.zeros(0)])
                found = pd.DataFrame({"col": col, "id": ids[row], "score": score})
                found = found[found["score"] >= threshold].sort_values(["col", "score", "id"], ascending=[True, False, True]).groupby("col").head(k)
                out.append(pd.DataFrame({"query_id": names[at + found["col"].to_numpy(int)], "dataset": g["dataset"].iloc[0], "id": found["id"].to_numpy(object), "score": found["score"].to_numpy(float)}))
    return pd.concat(out) if out else pd.DataFrame(columns=["query_id", "dataset", "id", "score"])


def fan_out(points: DataFrame, queries: DataFrame, k: int, threshold: float = 0.0) -> DataFrame:
    """Top ``k`` points of each data set for each query: (query_id, dataset, id, score, rank), equal scores by id.

    A stated set of queries (query_id, qv) against all points (dataset, id, embedding): it is taken in blocks of some
    QUERY_BLOCK queries, each of which goes to the workers whole, and only the best of every Arrow batch are
    shuffled. Vectors of different dimension, nulls and zero vectors have similarity 0; a null ``qv`` has no rows.
    """
    spark = points.sparkSession
    queries = queries.filter("qv IS NOT NULL")
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    p = points.select("dataset", "id", "embedding").filter("id IS NOT NULL")
    kinds = {f.name: f.dataType.simpleString() for f in [*p.schema, *queries.schema]}
    schema = f"query_id {kinds['query_id']}, dataset {kinds['dataset']}, id {kinds['id']}, score double"
    out = None
    for b in range(blocks):
        part = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b) if blocks > 1 else queries
        held = spark.sparkContext.broadcast([(r["query_id"], r["qv"]) for r in part.select("query_id", "qv").collect()])  # a block

        def run(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield _best(pdf, held.value, k, threshold)

        m = p.mapInPandas(run, schema)
        out = m if out is None else out.unionByName(m)
    w = Window.partitionBy("query_id", "dataset").orderBy(F.desc("score"), "id")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def search_sets(points: DataFrame, known: DataFrame, asked: DataFrame, query: list[float], k: int) -> DataFrame:
    """One row for each asked data set: its number of matches, or why it has none.

    ``known`` has (dataset, standalone); unknown and standalone ones give an error and don't fail the others.
    """
    hits = asked.join(known, "dataset", "left").withColumn("error", F.when(F.col("standalone").isNull(), "unknown data set").when(F.col("standalone"), "standalone data sets are not searchable"))
    w = Window.partitionBy("dataset").orderBy(F.desc("score"), "id")
    found = scored(points, query).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).groupBy("dataset").agg(F.count("*").alias("matches"))
    return hits.join(found, "dataset", "left").select("dataset", F.when(F.col("error").isNull(), F.coalesce("matches", F.lit(0).cast("long"))).otherwise(0).alias("matches"), "error")


def overlap_score(query: Column, text: Column) -> Column:
    """Share of the query's distinct words that a text holds: the scorer without a model."""
    q = F.array_distinct(F.split(F.lower(F.trim(query)), r"\s+"))
    t = F.split(F.lower(F.trim(text)), r"\s+")
    return F.size(F.array_intersect(q, t)) / F.size(q)


def rerank(docs: DataFrame, query: str, top: int | None = None, text: str = "text", tie: str = "id") -> DataFrame:
    """Documents by a scorer, best first, with their scores."""
    out = docs.withColumn("score", overlap_score(F.lit(query), F.col(text))).orderBy(F.desc("score"), tie)
    return out.limit(top) if top else out


def latest_points(points: DataFrame, key: str = "id", seq: str = "seq") -> DataFrame:
    """Upsert by id: of each id the point written last; of equal ``seq`` the one with the largest hash of all its columns."""
    w = Window.partitionBy(key).orderBy(F.desc(seq), F.desc(F.xxhash64(F.to_json(F.struct(*[points[c] for c in points.columns])))))
    return points.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


#: Fixed value: the most points of one push.
MAX_PUSH = 1000


def check_push(points: int, standalone: bool) -> None:
    """Raise unless 1 to MAX_PUSH points are pushed to a standalone data set."""
    if not standalone:
        raise ValueError("points are pushed to standalone data sets only")
    if not 1 <= points <= MAX_PUSH:
        raise ValueError(f"a push holds 1 to {MAX_PUSH} points")


def parse_point_id(text: Column) -> Column:
    """struct(uuid, num) of an id as text: a UUID in its usual form, else a whole number of 64 bits without sign, else both null.

    UUIDs may lack hyphens, stand in braces or follow ``urn:uuid:``.
    """
    bare = F.regexp_replace(F.lower(text), r"^(?:urn:uuid:([0-9a-f-]{36})|\{([0-9a-f-]{36})\})$", "$1$2")
    digits = F.when(bare.rlike(r"^(?:[0-9a-f]{32}|[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12})$"), F.regexp_replace(bare, "-", ""))
    uuid = F.regexp_replace(digits, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    significant = F.regexp_extract(text, r"^\+?0*([0-9]{1,20})$", 1)
    number = F.when((significant != "") & digits.isNull(), significant.cast("decimal(20,0)"))
    return F.struct(uuid.alias("uuid"), F.when(number <= F.lit("18446744073709551615").cast("decimal(20,0)"), number).alias("num"))


def check_points(points: DataFrame, dim: int, vector: str = "vector") -> DataFrame:
    """Pushed points with whether their vector has the data set's dimension (1 to 65536)."""
    if not 1 <= dim <= 65536:
        raise ValueError("dimension must be 1 to 65536")
    return points.withColumn("valid", F.size(vector) == dim)
