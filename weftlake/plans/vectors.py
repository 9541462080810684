"""Vector search, clusters and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftlake.functions.vectors import cosine
from weftlake.operators import clusters, density, search
from weftlake.operators.embed import HashingProvider, embed
from weftlake.plans.registry import Tables, query

SCORED = """WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0),
  s AS (SELECT vec_id AS id, label, list_cosine_similarity(embedding::DOUBLE[], (SELECT q FROM q)) AS score FROM embeddings) """


def points(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("id"), (F.col("label") + 1).alias("item_id"), "label", "embedding")


def probe(t: Tables) -> list[float]:
    """The query vector: one row."""
    return t.embeddings.filter("vec_id = 0").select("embedding").first()[0]


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("vector_topk", SCORED + "SELECT id, label, round(score, 6) AS score FROM s WHERE score >= 0 ORDER BY s.score DESC, id LIMIT 10")
def vector_topk(t: Tables) -> DataFrame:
    return rounded(search.top_k(search.matvec_scored(points(t), probe(t))).select("id", "label", "score"), "score")


@query("vector_topk_offset", SCORED + "SELECT id, label, round(score, 6) AS score FROM s WHERE score >= 0 ORDER BY s.score DESC, id LIMIT 10 OFFSET 5")
def vector_topk_offset(t: Tables) -> DataFrame:
    return rounded(search.top_k(search.matvec_scored(points(t), probe(t)), offset=5).select("id", "label", "score"), "score")


@query("vector_topk_per_label", SCORED + "SELECT id, label, round(score, 6) AS score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY label ORDER BY score DESC, id) AS INTEGER) AS rank FROM s) x WHERE rank <= 3")
def vector_topk_per_label(t: Tables) -> DataFrame:
    w = Window.partitionBy("label").orderBy(F.desc("score"), "id")
    r = search.scored(points(t), probe(t), threshold=-1.0).withColumn("rank", F.row_number().over(w)).filter("rank <= 3")
    return rounded(r.select("id", "label", "score", "rank"), "score")


@query("filtered_search", SCORED + "SELECT id, label, round(score, 6) AS score FROM s WHERE label = 3 AND score >= 0 ORDER BY s.score DESC, id LIMIT 10")
def filtered_search(t: Tables) -> DataFrame:
    kept = search.payload_filter(points(t), {"label": 3, "score_like": 0.5})
    return rounded(search.top_k(search.scored(kept, probe(t))).select("id", "label", "score"), "score")


@query(
    "search_documents",
    SCORED + "SELECT label + 1 AS item_id, round(greatest(max(score), 0), 6) AS best_score, count(*) AS chunk_count, arg_max(id, score) AS best_id FROM s WHERE score >= 0 GROUP BY label",
)
def search_documents(t: Tables) -> DataFrame:
    return rounded(search.search_documents(points(t), probe(t)), "best_score")


@query(
    "knn_join",
    """WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id % 100 = 0),
  m AS (SELECT query_id, label AS dataset, vec_id AS id, list_cosine_similarity(embedding::DOUBLE[], qv) AS score FROM embeddings, q),
  r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id, dataset ORDER BY score DESC, id) AS INTEGER) AS rank FROM m WHERE score >= 0)
  SELECT query_id, dataset, id, round(score, 6) AS score, rank FROM r WHERE rank <= 2""",
)
def knn_join(t: Tables) -> DataFrame:
    p = points(t).withColumnRenamed("label", "dataset")
    q = t.embeddings.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))
    return rounded(search.fan_out(p, q, 2), "score")


@query(
    "search_sets",
    SCORED
    + """, a(dataset) AS (VALUES (0), (1), (2), (99)), k AS (SELECT DISTINCT label AS dataset, label = 2 AS standalone FROM embeddings),
  n AS (SELECT label AS dataset, least(count(*), 5) AS matches FROM s WHERE score >= 0 GROUP BY 1)
  SELECT CAST(a.dataset AS INTEGER) AS dataset, CASE WHEN standalone = false THEN coalesce(matches, 0) ELSE 0 END AS matches,
  CASE WHEN standalone IS NULL THEN 'unknown data set' WHEN standalone THEN 'standalone data sets are not searchable' END AS error FROM a LEFT JOIN k USING (dataset) LEFT JOIN n USING (dataset)""",
)
def search_sets(t: Tables) -> DataFrame:
    p = points(t).withColumnRenamed("label", "dataset")
    known = p.select("dataset").distinct().withColumn("standalone", F.col("dataset") == 2)
    asked = t.spark.createDataFrame([(0,), (1,), (2,), (99,)], "dataset int")
    return search.search_sets(p, known, asked, probe(t), 5)


@query("semantic_neighbours", "SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], lag(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id)), 6) AS score FROM embeddings")
def semantic_neighbours(t: Tables) -> DataFrame:
    before = F.lag("embedding").over(Window.partitionBy("label").orderBy("id"))
    return points(t).withColumn("b", before).select("id", F.round(F.when(F.col("b").isNotNull(), cosine(F.col("embedding"), F.col("b"))), 6).alias("score"))


@query("upsert_points", "SELECT id, seq, value FROM (SELECT user_id AS id, event_id AS seq, value FROM events) QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1")
def upsert_points(t: Tables) -> DataFrame:
    return search.latest_points(t.events.select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), "value"))


@query("check_points", "SELECT vec_id AS id, len(CASE WHEN vec_id % 5 = 0 THEN embedding[1:10] ELSE embedding END) = 64 AS valid FROM embeddings")
def check_points(t: Tables) -> DataFrame:
    v = F.when(F.col("vec_id") % 5 == 0, F.slice("embedding", 1, 10)).otherwise(F.col("embedding"))
    return search.check_points(t.embeddings.select(F.col("vec_id").alias("id"), v.alias("vector")), 64).select("id", "valid")


@query("point_payload", "SELECT vec_id AS id, to_json({'item_id': label + 1, 'text': 'p' || vec_id}) AS payload FROM embeddings")
def point_payload(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("id"), F.to_json(F.struct((F.col("label") + 1).alias("item_id"), F.concat(F.lit("p"), F.col("vec_id").cast("string")).alias("text"))).alias("payload"))


@query(
    "rerank_overlap",
    r"""WITH q AS (SELECT list_distinct(string_split_regex(lower(trim(text)), '\s+')) AS q FROM benchmark WHERE item_id = (SELECT min(item_id) FROM benchmark))
  SELECT doc_id AS id, round(len(list_intersect((SELECT q FROM q), string_split_regex(lower(trim(text)), '\s+'))) / len((SELECT q FROM q)), 6) AS score FROM documents ORDER BY score DESC, id LIMIT 20""",
)
def rerank_overlap(t: Tables) -> DataFrame:
    q = t.benchmark.orderBy("item_id").limit(1).select("text").first()[0]
    docs = t.documents.select(F.col("doc_id").alias("id"), "text")
    return rounded(search.rerank(docs, q, 20).select("id", "score"), "score")


@query("quantized_search")
def quantized_search(t: Tables) -> DataFrame:
    """Extension: search over vectors of signed bytes."""
    from weftlake.functions.vectors import quantize

    p = points(t).withColumn("embedding", quantize(F.col("embedding"))["codes"].cast("array<float>"))
    return rounded(search.top_k(search.scored(p, probe(t))).select("id", "score"), "score", digits=3)


@query("embed_documents")
def embed_documents(t: Tables) -> DataFrame:
    e = embed(t.documents.select("doc_id", "text"), HashingProvider(32), "text", "vector")
    return e.select("doc_id", F.size("vector").alias("dim"), F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")), 3).alias("length"))


@query("cluster_stats", "SELECT count(*) AS points, count(DISTINCT CASE WHEN l >= 0 THEN l END) AS clusters, count(*) FILTER (l = -1) AS noise FROM (SELECT CASE WHEN vec_id % 9 = 0 THEN -1 ELSE label END AS l FROM embeddings)")
def cluster_stats(t: Tables) -> DataFrame:
    return clusters.cluster_stats(t.embeddings.withColumn("label", F.when(F.col("vec_id") % 9 == 0, -1).otherwise(F.col("label"))))


@query(
    "cluster_samples",
    "SELECT label, string_agg(text, chr(10) ORDER BY id) AS samples FROM (SELECT vec_id AS id, label, text, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings JOIN documents ON vec_id = doc_id WHERE text <> '') WHERE n <= 5 GROUP BY label",
)
def cluster_samples(t: Tables) -> DataFrame:
    p = points(t).select("id", "label").join(t.documents.select(F.col("doc_id").alias("id"), "text"), "id")
    return clusters.cluster_samples(p)


@query(
    "point_labels",
    "SELECT vec_id AS id, CASE WHEN vec_id % 9 = 0 THEN 'Unlabelled' WHEN label = 0 THEN 'A' ELSE 'Cluster ' || label END AS label_name FROM embeddings",
)
def point_labels(t: Tables) -> DataFrame:
    p = points(t).select("id", F.when(F.col("id") % 9 == 0, -1).otherwise(F.col("label")).alias("label"))
    names = t.spark.createDataFrame([(0, "A")], "cluster int, name string")
    return clusters.point_labels(p, F.broadcast(names)).select("id", "label_name")


@query("reduce_pca")
def reduce_pca(t: Tables) -> DataFrame:
    r = clusters.reduce_2d(points(t))
    return r.select("id", F.round(F.abs("x"), 4).alias("x"), F.round(F.abs("y"), 4).alias("y"))


@query("cluster_density")
def cluster_density(t: Tables) -> DataFrame:
    return density.density_clusters(clusters.reduce_2d(points(t))).groupBy("cluster").agg(F.count("*").alias("n"))


@query("cluster_density_points")
def cluster_density_points(t: Tables) -> DataFrame:
    """Every point with its place and its cluster."""
    return density.density_clusters(clusters.reduce_2d(points(t)))


@query("sample_points")
def sample_points(t: Tables) -> DataFrame:
    return clusters.sample_points(points(t).select("id", "label"), 100)
