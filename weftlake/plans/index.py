"""Indexes: approximate vector search and ranked text search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlake.functions.vectors import quantize
from weftlake.operators import ann, search, textindex
from weftlake.plans.registry import Tables, query
from weftlake.session import shared_path

DIM = 64
#: Nearest points of the recall query; lists and candidates are the search's defaults.
NEAREST = 10


def _points(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("id"), "label", "embedding")


def _asked(t: Tables) -> DataFrame:
    """Every row whose id is divisible by 100, against all rows."""
    return t.embeddings.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))


def _index(t: Tables) -> str:
    path = shared_path(t.spark, "ann")
    ann.build_index(_points(t), path, DIM)
    return path


TRUE = """WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id % 100 = 0),
  m AS (SELECT query_id, vec_id AS id, label, list_cosine_similarity(embedding::DOUBLE[], qv) AS score FROM embeddings, q)"""


@query(
    "ann_all_lists",
    TRUE + "SELECT query_id, id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM m WHERE label <> 3 QUALIFY rank <= 5",
)
def ann_all_lists(t: Tables) -> DataFrame:
    """With all lists probed and a wide pool the index gives the exact answer, a condition on the payload included: every row is stored."""
    found = ann.search_index(t.spark, _index(t), _asked(t), 5, DIM, probes=ann.SAMPLE, ef=1024, where=F.col("label") != 3)
    return found.withColumn("score", F.round("score", 6))


@query("ann_recall")
def ann_recall(t: Tables) -> DataFrame:
    """(method, queries, recall, bytes): recall of the ten nearest against all rows, and bytes of a vector that the search reads first."""
    path, asked = _index(t), _asked(t)
    true = search.fan_out(_points(t).withColumn("dataset", F.lit(0)), asked, NEAREST, -1.0)
    codes = _points(t).withColumn("dataset", F.lit(0)).withColumn("embedding", quantize(F.col("embedding"))["codes"].cast("array<float>"))
    found = {
        ("inverted file, product codes", -(-DIM // 4)): ann.search_index(t.spark, path, asked, NEAREST, DIM),
        ("signed bytes", DIM): search.fan_out(codes, asked, NEAREST, -1.0),
    }
    out = None
    for (name, size), rows in found.items():
        r = ann.recall(rows, true).agg(F.count("*").alias("queries"), F.round(F.avg("recall"), 4).alias("recall")).select(F.lit(name).alias("method"), "queries", "recall", F.lit(size).alias("bytes"))
        out = r if out is None else out.unionByName(r)
    return out


BM25 = r"""WITH w AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, '[\p{L}\p{N}]+'))) AS term FROM documents),
  tf AS (SELECT term, doc_id, count(*) AS tf FROM w GROUP BY ALL),
  dl AS (SELECT doc_id, coalesce(len(regexp_extract_all(text, '[\p{L}\p{N}]+')), 0) AS n FROM documents WHERE doc_id IS NOT NULL),
  c AS (SELECT count(*) AS docs, avg(n) AS mean FROM dl),
  df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
  q AS (SELECT DISTINCT item_id AS query_id, lower(unnest(regexp_extract_all(text, '[\p{L}\p{N}]+'))) AS term FROM benchmark WHERE item_id IS NOT NULL),
  s AS (SELECT query_id, doc_id AS id, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))) AS score
        FROM q JOIN tf USING (term) JOIN df USING (term) JOIN dl USING (doc_id), c GROUP BY ALL)"""


def _text_index(t: Tables) -> str:
    path = shared_path(t.spark, "textindex")
    textindex.build_text_index(t.documents.select(F.col("doc_id").alias("id"), "text"), path)
    return path


def _text_queries(t: Tables) -> DataFrame:
    """Every item of the benchmark is a query; one without an id could not be named in a result."""
    return t.benchmark.filter("item_id IS NOT NULL").select(F.col("item_id").alias("query_id"), "text")


@query("list_ranked", BM25 + "SELECT query_id, id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS INTEGER) AS rank FROM s QUALIFY rank <= 10")
def list_ranked(t: Tables) -> DataFrame:
    """The ten best documents of each query by BM25 over an inverted index of all documents."""
    found = textindex.search_text(t.spark, _text_index(t), _text_queries(t), 10)
    return found.withColumn("score", F.round("score", 6))


@query(
    "rerank_bm25",
    BM25
    + """, v AS (SELECT query_id, item_id AS ignored, id, score FROM s JOIN benchmark ON item_id = query_id)
  SELECT query_id, id, round(score, 6) AS score FROM v""",
)
def rerank_bm25(t: Tables) -> DataFrame:
    """Given candidates (here every document for each query) scored by the index's counts instead of by word overlap."""
    ids = t.documents.select(F.col("doc_id").alias("id"))
    found = textindex.score_candidates(t.spark, _text_index(t), _text_queries(t), ids)
    return found.withColumn("score", F.round("score", 6))


@query(
    "posting_counts",
    r"""SELECT term, count(*) AS docs, sum(n)::BIGINT AS occurrences FROM (SELECT lower(term) AS term, doc_id, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{L}\p{N}]+')) AS term FROM documents) GROUP BY ALL) GROUP BY term""",
)
def posting_counts(t: Tables) -> DataFrame:
    """Documents and occurrences of every term, out of the posting blocks."""
    return textindex.postings(t.spark, _text_index(t)).groupBy("term").agg(F.count("*").alias("docs"), F.sum("tf").cast("long").alias("occurrences"))
